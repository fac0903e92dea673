"""Seeded sampling: mixes, whole-situation samples, quotas, training examples.

Random order is a hash of the key, so a sample is the same for any partitioning.
Only counts and size histograms reach the driver, never rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagerframe.functions import draws
from wagerframe.operators import ranking


def seeded_sample(df: DataFrame, n: int | Column, seed: int, key: str, stream: str = "sample") -> DataFrame:
    """``n`` rows of smallest hash; no task merges ``n`` rows."""
    return ranking.smallest(df, n, draws.uniform(seed, F.col(key), stream), [F.col(key)])


def seeded_order(df: DataFrame, seed: int, key: str, out: str = "position", stream: str = "sample") -> DataFrame:
    """Dense position of every row in a seeded shuffle."""
    keyed = df.withColumn("_u", draws.uniform(seed, F.col(key), stream))
    return ranking.dense_index(keyed, [F.col("_u"), F.col(key)], out).drop("_u")


def mix_sizes(pools: DataFrame, wanted: int, percent: float) -> DataFrame:
    """One row (modified, unmodified): how many situations of each pool a mix can have.

    ``pools`` is one row with the pools' sizes under those names. The total is the
    largest that neither pool nor ``wanted`` forbids: a pool of ``n`` rows with a share
    of ``q`` percent allows ``100 * n / q``, one without a share allows any. Modified
    situations are the share of the total, rounded to even; the rest follows.
    """
    share = min(100.0, max(0.0, float(percent)))
    bounds = [F.lit(float(wanted))]
    for name, part in (("modified", share), ("unmodified", 100.0 - share)):
        if part > 0.0:
            bounds.append(F.col(name) * 100.0 / part)
    total = F.floor(F.least(*bounds) if len(bounds) > 1 else bounds[0])
    sizes = pools.select(total.alias("total")).select("total", F.rint(F.col("total") * share / 100.0).cast("long").alias("modified"))
    return sizes.select("modified", (F.col("total") - F.col("modified")).alias("unmodified"))


def two_pool_mix(
    unmodified: DataFrame, modified: DataFrame, wanted: int, percent: float, seed: int, key: str
) -> DataFrame:
    """Situations of both pools at the asked percentage, in one seeded order."""
    pools = {"modified": modified, "unmodified": unmodified}
    named = [df.withColumn("source", F.lit(name)) for name, df in pools.items()]
    both = named[0].unionByName(named[1])
    counts = both.agg(*[F.count_if(F.col("source") == name).alias(name) for name in pools])
    sizes = mix_sizes(counts, wanted, percent).first()
    if sizes["modified"] + sizes["unmodified"] <= 0:
        raise ValueError(f"no mix of {wanted} situations with {percent}% modified ones can be drawn from these pools")
    drawn = [seeded_sample(df, sizes[name], seed, key, f"mix/{name}") for name, df in zip(pools, named) if sizes[name]]
    mixed = drawn[0] if len(drawn) == 1 else drawn[0].unionByName(drawn[1])
    return seeded_order(mixed, seed, key, stream="mix/order")


# --- whole situations --------------------------------------------------------

NEVER = np.int64(1) << np.int64(62)


def size_histogram(df: DataFrame, key: str) -> dict[int, int]:
    """Group size -> number of groups. There are at most ``sqrt(2 * rows)`` distinct sizes."""
    sizes = df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
    return {r["size"]: r["groups"] for r in sizes.collect()}


def _doublings(count: int) -> list[int]:
    """1, 2, 4, ... and a rest, which together make every number up to ``count``."""
    out, batch = [], 1
    while count > 0:
        out.append(min(batch, count))
        count -= out[-1]
        batch *= 2
    return out


class Residues:
    """Lightest choices of groups by their total modulo the base size.

    The base is the size that holds most rows among those with at least as many
    groups as rows in each (else the size of most groups). ``least[r]`` is the smallest
    total of other groups that leaves ``r`` modulo the base. It is found batch by batch
    over an array of ``base`` numbers, so memory depends on the base and not on any target.
    """

    def __init__(self, histogram: dict[int, int], base: int | None = None):
        often = [s for s, c in histogram.items() if c >= s]
        self.base = base or (
            max(often, key=lambda s: (s * histogram[s], -s)) if often else max(histogram, key=lambda s: (histogram[s], -s))
        )
        self.copies = histogram.get(self.base, 0)
        self.least = np.full(self.base, NEVER)
        self.least[0] = 0
        self.steps: list[tuple[int, int, np.ndarray]] = []
        for size in sorted((s for s in histogram if s != self.base), reverse=True):
            # More copies than the base has residues come round to a residue met before.
            for batch in _doublings(min(histogram[size], self.base)):
                weight = size * batch
                moved = np.roll(self.least, weight % self.base) + weight
                better = moved < self.least
                if better.any():
                    self.steps.append((size, batch, np.packbits(better)))
                    self.least = np.where(better, moved, self.least)

    def feasible(self, total: int) -> bool | None:
        """Whether base copies complete a lightest choice to ``total``; null where heavier choices might."""
        lightest = int(self.least[total % self.base])
        if lightest > total:
            return False
        return True if total - lightest <= self.base * self.copies else None

    def takes(self, total: int) -> dict[int, int]:
        """Groups of each size of a feasible total."""
        at, out = total % self.base, {}
        rest = int(self.least[at])
        out[self.base] = (total - rest) // self.base
        for size, batch, better in reversed(self.steps):
            if np.unpackbits(better, count=self.base)[at]:
                out[size] = out.get(size, 0) + batch
                at = (at - size * batch) % self.base
        return out


def _totals(histogram: dict[int, int], limit: int) -> int:
    """Bit set of all totals up to ``limit``: an eighth of a byte each."""
    mask, totals = (1 << (limit + 1)) - 1, 1
    for size, count in histogram.items():
        for batch in _doublings(min(count, limit // size)):
            totals |= (totals << (size * batch)) & mask
    return totals


MIRRORED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).ravel()


def _reversed_bits(bits: int, length: int) -> int:
    width = -(-length // 8)
    data = np.frombuffer(bits.to_bytes(width, "little"), np.uint8)
    return int.from_bytes(MIRRORED[data[::-1]].tobytes(), "little") >> (8 * width - length)


def _divide(histogram: dict[int, int], target: int) -> dict[int, int] | None:
    """Exact answer from bit sets: sizes are halved, and one split of the target between the halves is kept."""
    sizes = sorted(histogram)
    if not target:
        return {}
    if len(sizes) == 1:
        take, rest = divmod(target, sizes[0])
        return {sizes[0]: take} if not rest and take <= histogram[sizes[0]] else None
    halves = [{s: histogram[s] for s in part} for part in (sizes[: len(sizes) // 2], sizes[len(sizes) // 2 :])]
    meeting = _totals(halves[0], target) & _reversed_bits(_totals(halves[1], target), target + 1)
    if not meeting:
        return None
    left = (meeting & -meeting).bit_length() - 1
    del meeting
    return _divide(halves[0], left) | _divide(halves[1], target - left)


def takes_for(histogram: dict[int, int], target: int) -> dict[int, int] | None:
    """How many groups of each size add up to the target exactly; null when none do.

    First by ``Residues``, of the groups to take or of those to leave out, with as
    many large groups taken beforehand as the base's copies cannot make up for. Where that
    does not decide, bit sets of all totals up to the target do.
    """
    histogram = {s: c for s, c in histogram.items() if c > 0}
    everything = sum(s * c for s, c in histogram.items())
    if target < 0 or target > everything:
        return None
    if target in (0, everything):
        return {s: c for s, c in histogram.items() if target}
    residues = Residues(histogram)
    for total, complement in ((target, False), (everything - target, True)):
        known = residues.feasible(total)
        if known is False:
            return None
        if known:
            takes = residues.takes(total)
            return {s: histogram[s] - takes.get(s, 0) for s in histogram} if complement else takes
    taken, left = {}, target
    for size in sorted((s for s in histogram if s != residues.base), reverse=True):
        spare = left - residues.base * residues.copies
        taken[size] = min(histogram[size], left // size, max(0, -(-spare // size)))
        left -= size * taken[size]
    rest = Residues({s: c - taken.get(s, 0) for s, c in histogram.items() if c > taken.get(s, 0)}, residues.base)
    if rest.feasible(left):
        more = rest.takes(left)
        return {s: taken.get(s, 0) + more.get(s, 0) for s in histogram}
    few = min(target, everything - target)
    found = _divide({s: c for s, c in histogram.items() if s <= few}, few)
    if found is None or few == target:
        return found
    return {s: c - found.get(s, 0) for s, c in histogram.items()}


def feasible_totals(histogram: dict[int, int], totals: Iterable[int]) -> Iterator[int]:
    """Those of the totals that can be made of whole groups, in the order given."""
    everything = sum(s * c for s, c in histogram.items())
    residues = Residues(histogram) if histogram else None
    for total in totals:
        if residues is None or not 0 <= total <= everything:
            known = [total == 0]
        else:
            known = [residues.feasible(total), residues.feasible(everything - total)]
        if False not in known and (True in known or takes_for(histogram, total) is not None):
            yield total


def nearest_totals(histogram: dict[int, int], wanted: int, limit: int = 6) -> list[int]:
    """Feasible totals other than the wanted one and 0, nearest and then smallest first."""
    everything = sum(s * c for s, c in histogram.items())
    gaps = range(1, max(wanted, everything - wanted) + 1)
    around = (total for gap in gaps for total in (wanted - gap, wanted + gap) if total > 0)
    return list(itertools.islice(feasible_totals(histogram, around), limit))


def nearest_feasible(df: DataFrame, wanted: int, key: str, limit: int = 6) -> DataFrame:
    """(total, distance): the row counts nearest to ``wanted`` that whole situations can make."""
    totals = nearest_totals(size_histogram(df, key), wanted, limit)
    return df.sparkSession.createDataFrame([(t, abs(t - wanted)) for t in totals], "total long, distance long")


def _pick_groups(df: DataFrame, key: str, takes: dict[int, int], seed: int, parts: int | None = None) -> DataFrame:
    groups = df.groupBy(key).agg(F.count("*").alias("_size"))
    keyed = groups.withColumn("_u", draws.uniform(seed, F.col(key), "group"))
    ranked = ranking.rank_within(keyed, ["_size"], [F.col("_u")], "_r", parts=parts)
    wanted = [(size, take) for size, take in sorted(takes.items()) if take]
    quota = df.sparkSession.createDataFrame(wanted, "_size long, _take long")
    chosen = ranked.join(quota, "_size").filter(F.col("_r") <= F.col("_take")).select(key)
    return df.join(chosen, key, "left_semi")


def exact_rows(df: DataFrame, n: int, key: str, seed: int, parts: int | None = None) -> DataFrame:
    """Exactly ``n`` rows made of whole situations; raises with near totals when impossible."""
    histogram = size_histogram(df, key)
    takes = takes_for(histogram, n)
    if takes is None:
        near = nearest_totals(histogram, n)
        raise ValueError(f"no set of whole situations has {n} rows; near totals {near}, sizes {sorted(histogram)[:50]}")
    return _pick_groups(df, key, takes, seed, parts=parts)


def capped_rows(df: DataFrame, n: int, key: str, seed: int, parts: int | None = None) -> DataFrame:
    """The most rows up to ``n`` that keep situations whole."""
    if n <= 0:
        raise ValueError("the cap must be positive")
    histogram = size_histogram(df, key)
    if sum(s * c for s, c in histogram.items()) <= n:
        return df
    if min(histogram) > n:
        raise ValueError(f"cap {n} is smaller than the smallest situation ({min(histogram)} rows)")
    best = next(feasible_totals(histogram, range(n, 0, -1)))
    return _pick_groups(df, key, takes_for(histogram, best), seed, parts=parts)


def quota_fill(
    df: DataFrame, bucket: str, minima: dict[str, int], total: int, order: str, parts: int | None = None
) -> DataFrame:
    """Guaranteed minimum per bucket, then any allowed bucket in order up to the total."""
    allowed = df.filter(F.col(bucket).isin(*minima))
    ranked = ranking.rank_within(allowed, [bucket], [F.col(order)], "_r", parts=parts)
    need = F.lit(0)
    for name, value in minima.items():
        need = F.when(F.col(bucket) == name, value).otherwise(need)
    first = F.when(F.col("_r") <= need, 0).otherwise(1)
    return ranked.orderBy(first, F.col(order)).limit(total).drop("_r")


# --- examples ----------------------------------------------------------------


def rotated_label(labels: Column, seed: int, row: Column) -> Column:
    return F.get(labels, F.pmod(F.lit(seed) + row, F.nullif(F.size(labels), F.lit(0))).cast("int"))


def incomplete_situations(
    df: DataFrame, key: str, flags: list[Column], label: str, expected_labels: Column, expected_count: str
) -> DataFrame:
    """Ids with a failed flag, a wrong row count, other labels than expected, or rows that expect different ones.

    Labels reduce to one bit per expected label (62 at most), so no set of
    labels is gathered. Without expected labels any are right.
    """
    failed = F.lit(False)
    for flag in flags:
        failed = failed | ~flag
    expected = F.sort_array(F.array_distinct(expected_labels))
    place = F.coalesce(F.array_position(expected, F.lower(F.col(label))), F.lit(0)).cast("int")
    rows = df.select(
        key,
        failed.cast("int").alias("_failed"),
        F.col(expected_count).alias("_want_n"),
        F.coalesce(F.size(expected), F.lit(0)).alias("_labels"),
        F.coalesce(F.array_join(expected, "|"), F.lit("")).alias("_want"),
        F.when(place > 0, F.expr("1L")).alias("_one"),
        place.alias("_place"),
    )
    facts = rows.groupBy(key).agg(
        F.max("_failed").alias("_failed"),
        F.count("*").alias("_n"),
        F.max("_want_n").alias("_want_n"),
        F.max("_labels").alias("_labels"),
        F.min("_place").alias("_least"),
        (F.min("_want") != F.max("_want")).alias("_differ"),
        F.coalesce(F.bit_or(F.expr("shiftleft(_one, _place - 1)")), F.lit(0).cast("long")).alias("_seen"),
    )
    all_seen = F.col("_seen") == F.expr("shiftleft(1L, _labels) - 1")
    other = F.col("_differ") | ((F.col("_labels") > 0) & ((F.col("_least") == 0) | ~all_seen))
    bad = (F.col("_failed") == 1) | (F.col("_n") != F.col("_want_n")) | other
    return facts.filter(bad).select(key)


def source_summary(df: DataFrame, source: str = "source") -> DataFrame:
    name = F.lower(F.trim(F.col(source)))
    modified, unmodified = F.count_if(name == "modified"), F.count_if(name == "unmodified")
    return df.agg(
        modified.alias("modified_examples"),
        unmodified.alias("unmodified_examples"),
        (F.count("*") - modified - unmodified).alias("other_examples"),
        F.coalesce(F.try_divide(modified * 100.0, F.count("*")), F.lit(0.0)).alias("actual_modified_pct_examples"),
    )
