"""Numbering, keep-first, latest-wins and interleaving without one-task sorts.

A key may hold a large share of all rows, so a plain ``row_number`` over it
would sort that share in one task. Rows are instead dealt to tasks by ranges of
(keys, order), written, numbered within their part, and shifted by the row
counts of the parts before. Only a count per part and key is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wagerframe.session import save


def one_row(facts: DataFrame) -> Column:
    """A one-row aggregate as a struct column, planned as a scalar subquery."""
    return facts.select(F.struct(*facts.columns).alias("_facts")).scalar()


def _matches(left: DataFrame, right: DataFrame, names: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(prefix + name))
    return condition


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank", parts: int | None = None) -> DataFrame:
    """1-based rank inside each key, ordered ascending by ``order``; without keys, over the whole table.

    Bounds of the ranges are sampled by Spark from keys and order together, so
    neither a heavy key, nor outliers, nor many equal first columns gather in one
    part. The dealt rows are sorted and written once, with their place in their part:
    bounds that were sampled again could differ, and every reader must see the same
    parts. Rows equal in keys and order share a part. ``parts`` defaults to the
    session's number of shuffle partitions.
    """
    ranges = [*[F.col(k) for k in keys], *order]
    dealt = df.repartitionByRange(parts, *ranges) if parts else df.repartitionByRange(*ranges)
    placed = dealt.sortWithinPartitions(*ranges).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row_at")
    )
    dealt = save(placed, "ranked-rows")
    own = [*keys, "_part"]
    facts = dealt.groupBy(*[F.col(k).alias("_b_" + k) for k in own]).agg(F.count("*").alias("_rows"), F.min("_row_at").alias("_first"))
    before = Window.partitionBy(*["_b_" + k for k in keys]).orderBy("_b__part").rowsBetween(Window.unboundedPreceding, -1)
    # Places before a key's own in its part come off, its rows in earlier parts come on.
    shifts = facts.withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).drop("_rows", "_first")
    if not keys:  # one row per part
        shifts = F.broadcast(shifts)
    joined = dealt.join(shifts, _matches(dealt, shifts, own, "_b_"))
    return joined.select(*df.columns, (F.col("_row_at") + F.col("_shift") + 1).cast("long").alias(out))


def dense_index(df: DataFrame, order: list[Column], out: str = "position", start: int = 1, parts: int | None = None) -> DataFrame:
    """Global dense numbering by ``order``; one count per part is all that meets in one place."""
    return rank_within(df, [], order, out, parts).withColumn(out, F.col(out) + (start - 1))


def key_digest(keys: list[Column]) -> Column:
    """Fixed-size stand-in for long text keys; nulls and blanks stay apart."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in keys]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def keep_first(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """First row per key set by a unique row id.

    A partial minimum per digest runs before the shuffle, so a group of copies
    costs one row per task and the texts themselves are not shuffled for grouping.
    """
    firsts = df.groupBy(key_digest([F.col(k) for k in keys]).alias("_digest")).agg(F.min(row_id).alias("_first"))
    return df.join(firsts.select("_first"), df[row_id] == F.col("_first"), "left_semi")


def latest(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Last row per key by an ordering tuple, with a partial maximum before the shuffle.

    Rows that tie in the tuple are ordered by a hash of the row, so the choice
    does not depend on the partitioning.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*sequence, F.xxhash64(*rest))).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def first_positions(df: DataFrame, key: str, row_id: str, out: str = "dataset_position") -> DataFrame:
    """One row per key with its dense position by first appearance."""
    firsts = df.groupBy(key).agg(F.min(row_id).alias("_first"))
    return dense_index(firsts, [F.col("_first")], out).drop("_first")


def alternate(
    df: DataFrame, kind: str, row_id: str, kinds: tuple[str, str], out: str = "position", parts: int | None = None
) -> DataFrame:
    """Alternate two kinds, each in its own order; the longer one ends the table.

    The kind of the first row goes first. Rows of any other kind are dropped.
    Positions come from the rank in the kind and the two totals, so no global
    sort is needed.
    """
    both = df.filter(F.col(kind).isin(*kinds))
    facts = df.agg(
        F.count_if(F.col(kind) == kinds[0]).alias("_n0"),
        F.count_if(F.col(kind) == kinds[1]).alias("_n1"),
        F.min_by(kind, row_id).alias("_lead"),
    )
    ranked = rank_within(both, [kind], [F.col(row_id)], "_rank", parts=parts)
    first = F.when(F.col("_f._lead") == kinds[1], F.lit(kinds[1])).otherwise(F.lit(kinds[0]))
    shared = F.least(F.col("_f._n0"), F.col("_f._n1"))
    paired = (F.col("_rank") - 1) * 2 + F.when(F.col(kind) == first, 1).otherwise(2)
    position = F.when(F.col("_rank") <= shared, paired).otherwise(F.col("_rank") + shared)
    return (
        ranked.withColumn("_f", one_row(facts))
        .withColumn(out, position.cast("long"))
        .select(*df.columns, out)
    )


def dropped_kinds(df: DataFrame, kind: str, kinds: tuple[str, str]) -> DataFrame:
    """Number of rows that alternation leaves out."""
    return df.agg(F.count_if(~F.coalesce(F.col(kind).isin(*kinds), F.lit(False))).alias("dropped_rows"))


def round_robin(
    df: DataFrame, source: str, row_id: str, sources: list[str], out: str = "new_id", parts: int | None = None
) -> DataFrame:
    """Interleave equal sources: item k of source s gets id ``(k - 1) * sources + s``."""
    slots = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(source)) - 1
    ranked = rank_within(df.filter(F.col(source).isin(*sources)), [source], [F.col(row_id)], "_rank", parts=parts)
    return ranked.withColumn(out, ((F.col("_rank") - 1) * len(sources) + slots).cast("long")).drop("_rank")


def deficit_schedule(df: DataFrame, kind: str, rank: str, targets: dict[str, int], out: str = "slot") -> DataFrame:
    """Slot of the k-th item of each kind when the kind with the largest deficit goes next.

    Item k of a kind with target t is due at ``(2k - 1) / t``; its slot is the
    number of items due before it, which has a closed form per kind. Equal due
    times go to the kind declared first.
    """
    names = list(targets)
    due = F.col(rank) * 2 - 1
    own = F.lit(0)
    slot = F.lit(0).cast("long")
    for i, name in enumerate(names):
        own = F.when(F.col(kind) == name, targets[name]).otherwise(own)
    for i, name in enumerate(names):
        ahead = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(kind)) > i + 1
        # items j of `name` with (2j-1) * own < (2k-1) * target, or equal and declared earlier
        bound = due * targets[name]
        strictly = F.floor((bound - 1 + own) / (own * 2))
        inclusive = F.floor((bound + own) / (own * 2))
        count = F.least(F.when(ahead, inclusive).otherwise(strictly), F.lit(targets[name]))
        slot = slot + F.when(F.col(kind) == name, F.col(rank)).otherwise(count)
    kept = df.filter(F.col(kind).isin(*names)).withColumn("_own", own).filter(F.col(rank) <= F.col("_own"))
    return kept.withColumn(out, slot.cast("long")).drop("_own")


def verb_rotation(df: DataFrame, prompt: str, row_id: str, verbs: list[str], out: str = "verb") -> DataFrame:
    """Assign verbs round-robin over distinct prompts in first-seen order."""
    digest = df.withColumn("_digest", key_digest([F.col(prompt)]))
    seen = first_positions(digest.select("_digest", row_id), "_digest", row_id, "_seen")
    pool = F.array(*[F.lit(v) for v in verbs])
    return (
        digest.join(seen, "_digest")
        .withColumn(out, F.get(pool, F.pmod(F.col("_seen") - 1, F.lit(len(verbs))).cast("int")))
        .select(*df.columns, out)
    )


def spread_positions(df: DataFrame, group: str, tie: Column, out: str = "position", parts: int | None = None) -> DataFrame:
    """Order rows so that rows of one group sit far apart.

    Row r of a group of n is placed at ``(r - 0.5) / n``; ties follow ``tie``.
    The rows are written once: sizes, ranks and the samples of both orders read them.
    """
    tied = save(df.withColumn("_tie", tie), "spread-rows")
    sizes = tied.groupBy(group).agg(F.count("*").alias("_n"))
    ranked = rank_within(tied, [group], [F.col("_tie")], "_rank", parts=parts).join(sizes, group)
    placed = ranked.withColumn("_at", (F.col("_rank") - 0.5) / F.col("_n"))
    return dense_index(placed, [F.col("_at"), F.col("_tie")], out).drop("_tie", "_n", "_rank", "_at")


def position_slice(df: DataFrame, position: str, start: int | None = None, end: int | None = None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(position) >= start)
    return df if end is None else df.filter(F.col(position) <= end)


def head(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First ``n`` rows by an order; planned as a top-n per task and one merge."""
    return df.orderBy(*order).limit(n)


def smallest(df: DataFrame, n: int, draw: Column, ties: list[Column], digit_bits: int = 12, few: int = 10_000) -> DataFrame:
    """The ``n`` rows of smallest hash draw in [0, 1), ties by ``ties``; no task merges ``n`` rows.

    A radix selection: the draws' first ``digit_bits`` bits are counted (one number
    per digit reaches the driver), the digit that holds the n-th row is counted by its
    next bits, and so on until at most ``few`` rows share the digits so far. Rows before
    them are taken by a filter, and only those few are ordered. Draws that tie
    in all their bits are ranked by ``rank_within`` instead, however many they are.
    """
    if n <= 0:
        return df.limit(0)
    bits = 52
    keyed = df.withColumn("_bits", F.floor(draw * float(1 << bits)).cast("long"))
    prefix, left, need = 0, bits, n
    while True:
        inside = F.shiftright("_bits", left) == prefix
        width = min(digit_bits, left)
        digit = F.shiftright("_bits", left - width).alias("digit")
        counts = {r["digit"]: r["n"] for r in keyed.filter(inside).groupBy(digit).agg(F.count("*").alias("n")).collect()}
        for value in sorted(counts):
            if need <= counts[value]:
                break
            need -= counts[value]
        else:
            return df  # fewer rows than asked for
        prefix, left, found = value, left - width, counts[value]
        if left == 0 or found <= few:
            break
    before = keyed.filter(F.shiftright("_bits", left) < prefix)
    last = keyed.filter(F.shiftright("_bits", left) == prefix)
    order = [F.col("_bits"), *ties]
    if found <= few:
        last = last.orderBy(*order).limit(need)
    else:
        last = rank_within(last, [], order, "_place").filter(F.col("_place") <= need).drop("_place")
    return before.unionByName(last).drop("_bits")
