"""Situations as nested rows: nesting, scoring, labels, dominance flags, guards.

Everything except ``nest`` is a projection over the nested option array, so it
is evaluated in the scan's tasks whatever the number of situations. Computed
arrays are exploded with the ``outer`` generators: the plain ones make the
optimizer infer a ``size(array) > 0`` filter and push it below the projections,
which evaluates the whole array expression a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagerframe.functions import formats, lottery, text

MAX_OPTIONS = 26  # labels run from a to z


def explode_options(df: DataFrame, json_column: str = "options_json", schema: str | None = None) -> DataFrame:
    """Wide table (options as JSON) to one row per option.

    Values of the row win over values of the option; a missing index is the
    position and a missing type is ``Generic``. A row without a readable,
    non-empty list of objects fails the job with its id.
    """
    schema = schema or (
        "array<struct<option_index:int,option_type:string,prizes:array<double>,probabilities_percent:array<int>>>"
    )
    parsed = F.from_json(json_column, schema)
    broken = parsed.isNull() | (F.size(parsed) < 1) | F.exists(parsed, lambda o: o.isNull())
    checked = F.when(
        broken, F.raise_error(F.concat(F.lit("unreadable options list of situation "), F.col("situation_id").cast("string")))
    ).otherwise(parsed)
    fields = ["option_index", "option_type", "prizes", "probabilities_percent"]
    rest = [c for c in df.columns if c != json_column]
    out = df.select(*rest, F.size(parsed).alias("_size"), F.posexplode_outer(checked).alias("_pos", "_o"))
    for name in fields:
        cell = F.col(f"_o.{name}")
        out = out.withColumn(name, F.coalesce(F.col(name), cell) if name in rest else cell)
    out = out.withColumn("option_index", F.coalesce("option_index", "_pos")).withColumn(
        "option_type", F.coalesce("option_type", F.lit("Generic"))
    )
    count = F.coalesce(F.col("num_options"), F.col("_size")) if "num_options" in rest else F.col("_size")
    return out.withColumn("num_options", count).drop("_size", "_pos", "_o")


def nest(
    df: DataFrame, key: str, index: str, shared: list[str], own: list[str], keyed: bool = False, max_options: int = MAX_OPTIONS
) -> DataFrame:
    """Option rows to one row per situation.

    An index outside the label range fails the job. Equal (key, index) rows
    collapse to one first, and rows that differ under one (key, index) fail the
    job, so no collected list can exceed ``max_options`` elements and no row is
    lost. ``keyed`` says that (key, index) is already unique.
    """
    in_range = F.when(F.col(index).between(0, max_options - 1), F.col(index)).otherwise(
        F.raise_error(F.concat(F.lit("option index out of range: "), F.col(index).cast("string")))
    )
    rows = df.withColumn(index, in_range)
    if not keyed:
        columns = [*shared, *own]
        least, most = F.min(F.struct(*columns)), F.max(F.struct(*columns))
        differs = F.raise_error(F.concat(F.lit("options differ under one index: "), F.col(key).cast("string")))
        rows = (
            rows.groupBy(key, index)
            .agg(least.alias("_r"), most.alias("_m"))
            .select(key, index, F.when(F.col("_r").eqNullSafe(F.col("_m")), F.col("_r")).otherwise(differs).alias("_r"))
            .select(key, index, "_r.*")
        )
    return rows.groupBy(key).agg(
        *[F.min_by(c, index).alias(c) for c in shared],
        F.sort_array(F.collect_list(F.struct(index, *own))).alias("options"),
    )


def _with(option: Column, fields: list[str], **more: Column) -> Column:
    return F.struct(*[option[f].alias(f) for f in fields], *[c.alias(n) for n, c in more.items()])


def _fields(df: DataFrame, column: str) -> list[str]:
    return df.schema[column].dataType.elementType.fieldNames()


def _peak(field: str) -> Column:
    return F.array_max(F.transform("options", lambda o: o[field]))


def score(df: DataFrame, precision: str = "3sf") -> DataFrame:
    """Add expected value, both CARA utilities and best/worst flags to each option.

    ``precision`` picks best sets on exact values or on three significant figures.
    """
    base = _fields(df, "options")

    def measure(o: Column) -> Column:
        values = {
            "ev": lottery.expected_value(o["prizes"], o["probs"]),
            "low": lottery.expected_utility(o["prizes"], o["probs"], lottery.cara(lottery.LOW_ALPHA)),
            "high": lottery.expected_utility(o["prizes"], o["probs"], lottery.cara(lottery.HIGH_ALPHA)),
        }
        return _with(o, base, **values)

    def shown(o: Column) -> Column:
        rounded = {n + "_shown": lottery.round_significant(o[n], 3) for n in ("ev", "low", "high")}
        return _with(o, [*base, "ev", "low", "high"], **rounded)

    out = df.withColumn("options", F.transform("options", measure)).withColumn("options", F.transform("options", shown))
    suffix = "_shown" if precision == "3sf" else ""
    tops = {n: _peak(n + suffix) for n in ("ev", "low", "high")}
    out = out.withColumn(
        "_top",
        F.struct(
            *[c.alias(n) for n, c in tops.items()],
            F.array_max(F.transform("options", lambda o: o["ev"])).alias("best_ev"),
            F.array_min(F.transform("options", lambda o: o["ev"])).alias("worst_ev"),
        ),
    )

    def flagged(o: Column) -> Column:
        def ties(name: str) -> Column:
            return F.abs(o[name + suffix] - F.col(f"_top.{name}")) < lottery.TIE_TOLERANCE

        return _with(
            o,
            [*base, "ev", "low", "high", "ev_shown", "low_shown", "high_shown"],
            best_linear=ties("ev"),
            best_low=ties("low"),
            best_high=ties("high"),
            worst_linear=F.abs(o["ev"] - F.col("_top.worst_ev")) < lottery.TIE_TOLERANCE,
        )

    out = (
        out.withColumn("options", F.transform("options", flagged))
        .withColumn("max_expected_value", F.col("_top.best_ev"))
        .withColumn("min_expected_value", F.col("_top.worst_ev"))
        .drop("_top")
    )
    return lottery.settle(out, "options")


def of_type(options: Column, kind: str) -> Column:
    return F.filter(options, lambda o: o["option_type"] == kind)


def numbers_where(options: Column, flag: str) -> Column:
    """1-based numbers of the flagged options."""
    return F.transform(F.filter(options, lambda o: o[flag]), lambda o: o["option_index"] + 1)


def best_sets(options: Column) -> dict[str, Column]:
    return {
        "linear_best": numbers_where(options, "best_linear"),
        "low_best": numbers_where(options, "best_low"),
        "high_best": numbers_where(options, "best_high"),
    }


def other_types(options: Column) -> Column:
    """Distinct option types besides Cooperate, lower case, sorted."""
    kinds = F.transform(options, lambda o: F.lower(F.trim(o["option_type"])))
    return F.sort_array(F.array_distinct(F.filter(kinds, lambda k: k.isNotNull() & (k != "cooperate"))))


def roll_up(df: DataFrame) -> DataFrame:
    """Situation summary of a scored table: best sets, bucket, subset, linear-only flag."""
    out = df
    for name, column in best_sets(F.col("options")).items():
        out = out.withColumn(name, column)
    kinds = other_types(F.col("options"))
    return (
        out.withColumn("option_types_besides_cooperate", kinds)
        .withColumn("subset_type", text.policy_subset(F.col("raw_subset"), F.col("option_types_besides_cooperate")))
        .withColumn("bucket", lottery.bucket(F.col("linear_best"), F.col("low_best"), F.col("high_best")))
        .withColumn("is_lin_only", text.is_linear_only(F.col("bucket"), F.col("linear_best"), F.col("low_best")))
        .withColumn("probability_format", text.policy_probability_format(F.col("use_verbal_probs"), F.lit(None).cast("string")))
    )


def dominance(df: DataFrame) -> DataFrame:
    """Per option: Rebel over all Cooperates, Cooperate over all Rebels, Cooperate linear best.

    Needs a scored table. The options of a situation meet inside one row; no
    option-by-option join is planned.
    """
    base = _fields(df, "options")
    sides = df.withColumn("_rebels", of_type(F.col("options"), "Rebel")).withColumn(
        "_coops", of_type(F.col("options"), "Cooperate")
    )
    sides = sides.withColumn("_rebel_ev", F.array_max(F.transform("_rebels", lambda o: o["ev_shown"])))

    def over_all(o: Column, rivals: Column) -> Column:
        return (F.size(rivals) > 0) & F.forall(
            rivals, lambda r: lottery.dominates(o["prizes"], o["probs"], r["prizes"], r["probs"])
        )

    def flag(o: Column) -> Column:
        rebel, coop = o["option_type"] == "Rebel", o["option_type"] == "Cooperate"
        return _with(
            o,
            base,
            rebel_fosd_all_coops=F.when(rebel, over_all(o, F.col("_coops"))).otherwise(False),
            coop_fosd_all_rebels=F.when(coop, over_all(o, F.col("_rebels"))).otherwise(False),
            rebel_best_low=rebel & o["best_low"],
            coop_best_linear=F.coalesce(coop & (o["ev_shown"] > F.col("_rebel_ev") + lottery.TIE_TOLERANCE), F.lit(False)),
        )

    return sides.withColumn("options", F.transform("options", flag)).drop("_rebels", "_coops", "_rebel_ev")


def shares_worst(options: Column) -> Column:
    """A Rebel and a Cooperate have the same worst prize with the same percent."""

    def worst(kind: str) -> Column:
        return F.transform(of_type(options, kind), lambda o: lottery.worst_outcome(o["prizes"], o["probs"]))

    return F.coalesce(F.arrays_overlap(worst("Rebel"), worst("Cooperate")), F.lit(False))


def verbal_best_mixes(options: Column, verbal: Column) -> Column:
    """Verbal situation whose exact low-alpha best set holds a Rebel and a Cooperate."""
    top = F.array_max(F.transform(options, lambda o: o["low"]))
    best = F.filter(options, lambda o: F.abs(o["low"] - top) < lottery.TIE_TOLERANCE)
    return (
        verbal
        & F.exists(best, lambda o: o["option_type"] == "Rebel")
        & F.exists(best, lambda o: o["option_type"] == "Cooperate")
    )


def steal_contrast(options: Column) -> Column:
    """All low-alpha best options cooperate and all high-alpha best options steal."""
    low = F.filter(options, lambda o: o["best_low"])
    high = F.filter(options, lambda o: o["best_high"])
    return F.forall(low, lambda o: o["option_type"] == "Cooperate") & F.forall(
        high, lambda o: o["option_type"] == "Steal"
    )


def _negated(rule):
    return lambda o: ~rule(o)


def label_arrays(options: Column, letters: Column) -> dict[str, Column]:
    """Correct and incorrect labels for the four criteria, in option order."""

    def labels(keep) -> Column:
        return F.transform(
            F.filter(options, keep),
            lambda o: formats.option_label(o["option_index"], letters, F.lit(False), F.lit(False)),
        )

    rules = {
        "cooperate": lambda o: o["option_type"] == "Cooperate",
        "cara": lambda o: o["best_low"],
        "cara_high": lambda o: o["best_high"],
        "linear": lambda o: o["best_linear"],
    }
    out = {}
    for name, rule in rules.items():
        out[name + "_correct"] = labels(rule)
        out[name + "_incorrect"] = labels(_negated(rule))
    return out


def shift_wealth(finals: Column, old: Column, new: Column) -> Column:
    """Final outcomes after the initial wealth changes, to the cent."""
    delta = lottery.cents(new - old)
    return F.transform(finals, lambda v: lottery.cents(v + delta))


def violations(df: DataFrame) -> DataFrame:
    """Option rows that break an integrity rule, with the rule's name."""
    flat = df.select("situation_id", "use_verbal_probs", "num_options", F.size("options").alias("_n"), F.explode_outer("options").alias("o"))
    rules = {
        "percents_not_100": F.aggregate("o.probs", F.lit(0), lambda a, v: a + v) != 100,
        "verbal_not_fives": F.col("use_verbal_probs") & F.exists("o.probs", lambda v: v % 5 != 0),
        "lengths_differ": F.size("o.prizes") != F.size("o.probs"),
        "option_count_differs": F.col("num_options") != F.col("_n"),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    named = flat.select("situation_id", F.col("o.option_index").alias("option_index"), F.explode_outer(broken).alias("rule"))
    return named.filter(F.col("rule").isNotNull())


def stale_labels(df: DataFrame, letters: Column, stored: dict[str, str]) -> DataFrame:
    """(situation_id, rule) of label arrays that differ from those recomputed from the scored options.

    ``stored`` maps names of ``label_arrays`` to the columns that hold them.
    """
    again = label_arrays(F.col("options"), letters)
    broken = F.array_compact(
        F.array(*[F.when(~F.col(column).eqNullSafe(again[name]), F.lit(name)) for name, column in stored.items()])
    )
    return df.select("situation_id", F.explode(broken).alias("rule"))


def stale_flags(df: DataFrame, verbal: str, bucket: str) -> DataFrame:
    """(situation_id, rule) of situations whose options store other flags than one verbal flag and the bucket they are in.

    ``verbal`` and ``bucket`` are fields of the options; the options are scored.
    """
    sets = best_sets(F.col("options"))
    now = lottery.bucket(sets["linear_best"], sets["low_best"], sets["high_best"])
    flags = F.array_distinct(F.transform("options", lambda o: o[verbal]))
    buckets = F.array_distinct(F.transform("options", lambda o: o[bucket]))
    rules = {
        "several_verbal_flags": F.size(flags) != 1,
        "verbal_flag_differs": F.exists(flags, lambda v: ~v.eqNullSafe(F.col("use_verbal_probs"))),
        "several_buckets": F.size(buckets) != 1,
        "bucket_differs": F.exists(buckets, lambda v: ~v.eqNullSafe(now)),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select("situation_id", F.explode(broken).alias("rule"))


def attach_prompts(options: DataFrame, prompts: DataFrame, keys: list[str]) -> DataFrame:
    """Option rows with the prompt of their situation and subset; options without one keep nulls.

    Keys that are null on both sides match. ``prompts`` has one row per key; a key
    that repeats there repeats its options.
    """
    added = [c for c in prompts.columns if c not in keys]
    other = prompts.select(*[F.col(k).alias("_k_" + k) for k in keys], *added)
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col("_k_" + k))
    return options.join(other, match, "left").select(*options.columns, *added)
