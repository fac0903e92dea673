"""Preference pairs: building, selection, audit, metrics, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wagerframe.functions import checks, draws, lottery, text
from wagerframe.operators import ranking

PAIR_KEYS = ["prompt_text", "chosen_full", "rejected_full"]
KINDS = ("rebels_only", "steals_only")
VERBS = ["select", "choose", "pick"]
TIE_EPSILON = 1e-6


def normalise_pairs(df: DataFrame) -> DataFrame:
    """Typed pair table: subset, probability format, clean counts, length relation."""
    kind = "subset_type" if "subset_type" in df.columns else "rejected_type"
    accepted, rejected = text.optional_int(F.col("chosen_output_tokens")), text.optional_int(F.col("rejected_output_tokens"))
    return (
        df.withColumn("subset_type", text.pair_subset(F.col(kind)))
        .withColumn("probability_format", text.pair_probability_format(F.col("prompt_text")))
        .withColumn("accepted_output_tokens", accepted)
        .withColumn("rejected_output_tokens", rejected)
        .withColumn("length_relation", lottery.length_relation(accepted, F.col("rejected_output_tokens")))
    )


def judge(df: DataFrame, tie_epsilon: float = TIE_EPSILON) -> DataFrame:
    """Margin, predicted preference and correctness of scored pairs."""
    margin = F.col("accepted_score") - F.col("rejected_score")
    return (
        df.withColumn("score_margin", margin)
        .withColumn("predicted_preference", lottery.predicted_preference(F.col("score_margin"), tie_epsilon))
        .withColumn("is_correct", F.col("predicted_preference") == "accepted")
    )


def select_pairs(
    df: DataFrame, position: str, start: int | None = None, end: int | None = None, limit: int | None = None
) -> DataFrame:
    """Slice by position, drop exact repeats, then cap."""
    unique = ranking.keep_first(ranking.position_slice(df, position, start, end), PAIR_KEYS, position)
    return unique if limit is None else ranking.head(unique, limit, [F.col(position)])


def selection_counters(df: DataFrame, position: str) -> DataFrame:
    """Rows in the slice, unique rows and repeats."""
    copies = df.groupBy(ranking.key_digest([F.col(k) for k in PAIR_KEYS])).agg(F.count("*").alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw_pair_rows_in_slice"),
        F.count("*").alias("selected_unique_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("exact_duplicate_rows_skipped"),
    )


def _bundle() -> list[Column]:
    correct = F.coalesce(F.col("is_correct"), F.lit(False))
    tie = F.col("predicted_preference") == "tie"
    margin = F.col("score_margin")
    accepted_cut = F.coalesce(F.col("accepted_truncated"), F.lit(False))
    rejected_cut = F.coalesce(F.col("rejected_truncated"), F.lit(False))

    def mean(value: Column) -> Column:
        return F.coalesce(F.avg(value), F.lit(0.0))

    def rate(flag: Column, among: Column | None = None) -> Column:
        value = F.when(flag, 1.0).otherwise(0.0)
        return mean(value if among is None else F.when(among, value))

    relation = F.col("length_relation")
    credit = F.when(F.col("predicted_preference") == "accepted", 1.0).when(tie, 0.5).otherwise(0.0)
    return [
        rate(correct).alias("pairwise_accuracy"),
        mean(credit).alias("pairwise_accuracy_ties_half_credit"),
        rate(tie).alias("tie_rate"),
        mean(lottery.logistic_loss(margin)).alias("preference_log_loss"),
        mean(margin).alias("mean_score_margin"),
        mean(F.abs(margin)).alias("mean_abs_score_margin"),
        mean(F.col("accepted_score")).alias("mean_accepted_score"),
        mean(F.col("rejected_score")).alias("mean_rejected_score"),
        rate(accepted_cut).alias("accepted_truncated_rate"),
        rate(rejected_cut).alias("rejected_truncated_rate"),
        rate(accepted_cut | rejected_cut).alias("truncated_pair_rate"),
        rate(correct, relation == "accepted_longer").alias("pairwise_accuracy_when_accepted_longer"),
        rate(correct, relation == "rejected_longer").alias("pairwise_accuracy_when_rejected_longer"),
        rate(correct, relation == "same_length").alias("pairwise_accuracy_when_same_length"),
        F.count("*").alias("num_total"),
        F.count_if(correct).alias("num_correct"),
        (F.count("*") - F.count_if(correct) - F.count_if(tie)).alias("num_incorrect"),
        F.count_if(tie).alias("num_ties"),
        F.count_if(accepted_cut | rejected_cut).alias("num_truncated_pairs"),
        F.count("length_relation").alias("num_pairs_with_length_data"),
    ]


def pair_metrics(df: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Pairwise bundle; an empty table gives zeros."""
    dims = dims or []
    rates = df.groupBy(*dims).agg(*_bundle()) if dims else df.agg(*_bundle())
    middle = exact_median(df, dims, "score_margin", "median_score_margin")
    if not dims:
        joined = rates.withColumn("median_score_margin", middle.scalar())
    else:
        side = middle.select(*[F.col(d).alias("_m_" + d) for d in dims], "median_score_margin")
        match = F.lit(True)
        for d in dims:
            match = match & F.col(d).eqNullSafe(F.col("_m_" + d))
        joined = rates.join(side, match, "left")
    return joined.withColumn("median_score_margin", F.coalesce("median_score_margin", F.lit(0.0))).select(
        *rates.columns, "median_score_margin"
    )


def _same(prefix: str, names: list[str]) -> Column:
    match = F.lit(True)
    for name in names:
        match = match & F.col(name).eqNullSafe(F.col(prefix + name))
    return match


def exact_median(df: DataFrame, dims: list[str], value: str, out: str, buckets: int = 256, rounds: int = 1) -> DataFrame:
    """Exact median per group without holding a group's values in one place.

    Each round cuts a group at ``buckets`` approximate quantiles, so cells hold about
    equally many rows however the values lie, counts exactly what lies at and between
    the cuts, and keeps the one or two cells with the middle ranks: about a
    ``buckets``-th of the rows. Only the distinct values left at the end are ordered; each
    of the ``rounds`` makes them fewer.
    """
    keys = list(dims)
    rows = df.select(*dims, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    n = F.col("_n")
    targets = rows.groupBy(*dims).agg(F.count("*").alias("_n")).select(
        *[F.col(k).alias("_t" + k) for k in keys], F.floor((n - 1) / 2).alias("_low"), F.floor(n / 2).alias("_high")
    )
    steps = [i / buckets for i in range(1, buckets)]
    for turn in range(rounds):
        grid = F.array_distinct(F.percentile_approx("_v", steps, 50 * buckets)).alias("_grid")
        grids = rows.groupBy(*keys).agg(grid) if keys else rows.agg(grid)
        if keys:
            placed = rows.join(grids.select(*[F.col(k).alias("_g" + k) for k in keys], "_grid"), _same("_g", keys))
        else:
            placed = rows.withColumn("_grid", ranking.one_row(grids)["_grid"])
        below = F.size(F.filter("_grid", lambda c: c < F.col("_v")))
        cell = f"_cell{turn}"
        placed = placed.select(*keys, "_v", (2 * below + F.array_contains("_grid", F.col("_v")).cast("int")).alias(cell))
        before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        counts = placed.groupBy(*keys, cell).agg(F.count("*").alias("_c"))
        counts = counts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        if keys:
            counts = counts.join(targets, _same("_t", keys))
        else:
            counts = counts.withColumn("_told", ranking.one_row(targets)).select("*", "_told.*")
        targets = counts.filter((F.col("_b") <= F.col("_high")) & (F.col("_b") + F.col("_c") > F.col("_low"))).select(
            *[F.col(k).alias("_t" + k) for k in [*keys, cell]],
            (F.col("_low") - F.col("_b")).alias("_low"),
            (F.col("_high") - F.col("_b")).alias("_high"),
        )
        keys.append(cell)
        rows = placed.join(targets.drop("_low", "_high"), _same("_t", keys)).select(*keys, "_v")
    values = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c")).join(targets, _same("_t", keys))
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("_at", F.coalesce(F.sum("_c").over(inside), F.lit(0)))

    def holds(rank: Column) -> Column:
        return F.when((F.col("_at") <= rank) & (F.col("_at") + F.col("_c") > rank), F.col("_v"))

    return ranked.groupBy(*dims).agg(((F.max(holds(F.col("_low"))) + F.max(holds(F.col("_high")))) / 2).alias(out))


def dominant_order(df: DataFrame, field: str, known: list[str]) -> DataFrame:
    """Report order of a field's values: known ones first, others by first appearance."""
    place = F.nullif(F.array_position(F.array(*[F.lit(v) for v in known]), F.col(field)), F.lit(0))
    return df.withColumn("place", F.coalesce(place, F.lit(len(known) + 1)))


def audit(df: DataFrame, options: Column | None = None) -> DataFrame:
    """Reason codes per pair row.

    ``options`` is the parsed option array of the prompt (parsed from
    ``prompt_text`` when not given); the lowest CARA rank score marks the best labels.
    """
    out = df.withColumn("_options", checks.prompt_options(F.col("prompt_text")) if options is None else options)
    scores = F.transform(
        "_options",
        lambda o: F.struct(
            o["label"].alias("label"),
            lottery.cara_rank_score(
                F.transform(o["outcomes"], lambda v: v["x"]), F.transform(o["outcomes"], lambda v: v["p"])
            ).alias("score"),
        ),
    )
    out = out.withColumn("_scores", scores)
    best = lottery.let(
        F.array_min(F.transform("_scores", lambda s: s["score"])),
        lambda low: F.transform(F.filter("_scores", lambda s: F.abs(s["score"] - low) < 1e-10), lambda s: s["label"]),
    )
    out = out.withColumn("computed_best_labels", F.coalesce(F.sort_array(best), F.array().cast("array<string>")))
    chosen = text.normal_label(F.col("chosen_expected"))
    status = (
        F.when(F.col("_options").isNull(), "parse_failed").when(chosen.isNull(), "bad_chosen_label").otherwise("ok")
    )

    def response_ok(side: str) -> Column:
        expected = text.normal_label(F.col(f"{side}_expected"))
        same = (text.normal_label(F.col(f"{side}_answer")) == expected) & (
            checks.audited_answer(F.col(f"{side}_full")) == expected
        )
        return F.coalesce(same, F.lit(False)) & text.ok_flag(F.col(f"{side}_ok"), blank_is_ok=False)

    meta = checks.has_meta_reference(F.col("chosen_full")) | checks.has_meta_reference(F.col("rejected_full"))
    reasons = [
        F.when(meta, "prompt_meta_reference"),
        F.when(status != "ok", status),
        F.when((status == "ok") & ~F.array_contains("computed_best_labels", chosen), "chosen_label_mismatch"),
        F.when(~response_ok("chosen"), "chosen_response_mismatch"),
        F.when(~response_ok("rejected"), "rejected_response_mismatch"),
    ]
    out = out.withColumn("excluded_reason_codes", F.array_compact(F.array(*reasons))).drop("_options", "_scores")
    return lottery.settle(out, "excluded_reason_codes")


def audit_report(audited: DataFrame, key: str = "situation_id") -> DataFrame:
    """Distinct ids per reason and over all reasons, with the rows they touch."""
    per_reason = audited.select(key, F.explode("excluded_reason_codes").alias("reason"))
    every = per_reason.select(key, F.lit("any").alias("reason"))
    return (
        per_reason.unionByName(every)
        .groupBy("reason", key)
        .agg(F.count("*").alias("_n"))
        .groupBy("reason")
        .agg(F.count("*").alias("ids"))
    )


def clean_pairs(audited: DataFrame, key: str = "situation_id", row_id: str = "row_idx", one_per_id: bool = False) -> DataFrame:
    """Drop every row of an id that has any bad row; optionally keep one row per id."""
    bad = audited.filter(F.size("excluded_reason_codes") > 0).select(key).distinct()
    kept = audited.join(bad, key, "left_anti")
    return ranking.keep_first(kept, [key], row_id) if one_per_id else kept


def prepare_held_out(df: DataFrame, row_id: str = "row_idx", per_kind: int | None = None, parts: int | None = None) -> DataFrame:
    """Held-out set: real newlines, no repeats, alternating kinds, verbs spread over prompts."""
    out = df
    for column in PAIR_KEYS:
        out = out.withColumn(column, text.literal_newlines_to_real(F.col(column)))
    out = out.withColumn("subset_type", text.pair_subset(F.col("rejected_type")))
    out = ranking.keep_first(out, [*PAIR_KEYS, "rejected_type"], row_id)
    if per_kind is not None:
        ranked = ranking.rank_within(out, ["subset_type"], [F.col(row_id)], "_k", parts=parts)
        out = ranked.filter(F.col("_k") <= per_kind).drop("_k")
    out = ranking.alternate(out, "subset_type", row_id, KINDS, "position", parts=parts)
    out = ranking.verb_rotation(out, "prompt_text", "position", VERBS)
    return out.withColumn("prompt_text", text.swap_verb(F.col("prompt_text"), F.col("verb")))


def representative_sample(df: DataFrame, n: int, seed: int, key: Column, parts: int | None = None) -> DataFrame:
    """``n`` pairs in proportion to the kinds, at least one of each, new situations first."""
    facts = df.agg(
        F.count_if(F.col("rejected_type") == "lin").alias("_lin"),
        F.count_if(F.col("rejected_type") == "too_risk").alias("_risk"),
    )
    share = F.coalesce(F.try_divide(F.col("_lin"), F.col("_lin") + F.col("_risk")), F.lit(0.5))
    wanted = F.rint(F.lit(n) * share).cast("int")
    wanted = F.when((F.col("_lin") > 0) & (wanted == 0), 1).otherwise(wanted)
    wanted = F.when((F.col("_risk") > 0) & (wanted == n), n - 1).otherwise(wanted)
    quotas = facts.select(
        F.least(wanted, F.col("_lin")).alias("_q_lin"), F.least(F.lit(n) - wanted, F.col("_risk")).alias("_q_risk")
    )
    keyed = df.filter(F.col("rejected_type").isin("lin", "too_risk")).withColumn("_u", draws.uniform(seed, key, "pick"))
    seen = ranking.rank_within(keyed, ["rejected_type", "situation_id"], [F.col("_u")], "_seen", parts=parts)
    # new situations first, then hash order; the fraction keeps the order numeric
    placed = seen.withColumn("_o", F.col("_seen") + F.col("_u"))
    ranked = ranking.rank_within(placed, ["rejected_type"], [F.col("_o")], "_r", parts=parts)
    quota = F.when(F.col("rejected_type") == "lin", F.col("_q._q_lin")).otherwise(F.col("_q._q_risk"))
    return ranked.withColumn("_q", ranking.one_row(quotas)).filter(F.col("_r") <= quota).select(*df.columns)


def dpo_lines(df: DataFrame, extras: list[str]) -> DataFrame:
    """One ASCII JSON line per pair; blank or missing texts are skipped, null extras left out."""
    fields = {"prompt": "prompt_text", "chosen": "chosen_full", "rejected": "rejected_full"}
    cells = [text.strip_blank(F.col(c)).alias(n) for n, c in fields.items()]
    trimmed = df.select(*cells, *extras).filter(
        (F.col("prompt") != "") & (F.col("chosen") != "") & (F.col("rejected") != "")
    )
    line = F.to_json(F.struct(*fields, *extras), {"ignoreNullFields": "true", "writeNonAsciiCharacterAsCodePoint": "true"})
    return trimmed.select(line.alias("value"))


def preference_pairs(df: DataFrame, mode: str, seed: int = 42) -> DataFrame:
    """Chosen and rejected labels per situation from label arrays.

    ``cooperate`` gives one row per eligible rejected option, typed by its flags;
    the other modes give one hash-picked pair per situation and skip equal labels.
    """
    if mode == "cooperate":
        rejected = F.explode_outer("cooperate_incorrect").alias("rejected_label")
        rows = df.filter((F.size("cooperate_correct") > 0) & (F.size("cooperate_incorrect") > 0)).select(
            "situation_id", F.array_min("cooperate_correct").alias("chosen_label"), rejected, "linear_correct", "cara_high_correct"
        )
        kind = F.when(F.array_contains("linear_correct", F.col("rejected_label")), "lin").when(
            F.array_contains("cara_high_correct", F.col("rejected_label")), "too_risk"
        )
        typed = rows.withColumn("rejected_type", kind).filter(F.col("rejected_type").isNotNull())
        return typed.select("situation_id", "chosen_label", "rejected_label", "rejected_type")
    column, kind = {"cara_vs_high": ("cara_high_correct", "too_risk"), "cara_vs_linear": ("linear_correct", "lin")}[mode]

    def picked(labels: str, stream: str) -> Column:
        u = draws.uniform(seed, F.col("situation_id"), stream)
        return F.get(F.sort_array(labels), F.floor(u * F.size(labels)).cast("int"))

    rows = df.filter((F.size("cara_correct") > 0) & (F.size(column) > 0)).select(
        "situation_id",
        picked("cara_correct", "chosen").alias("chosen_label"),
        picked(column, "rejected").alias("rejected_label"),
        F.lit(kind).alias("rejected_type"),
    )
    return rows.filter(F.col("chosen_label") != F.col("rejected_label"))
