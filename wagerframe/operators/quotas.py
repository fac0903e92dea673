"""Filling a table by quota: how many attempts it takes, and which of them are kept.

Attempts are numbered, and every one belongs to a cell: its bucket and its number
of options. The shortest run of attempts that can fill the quota is found from the
counts of cells alone; of that run the earliest attempts of each cell are reserved for
the minima, and the earliest others fill the table. Nothing is accepted one by one.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerframe.operators import ranking
from wagerframe.session import save

Cell = tuple[str, int]


@dataclass(frozen=True)
class Quota:
    """A total, the least number of each bucket (others are refused), and of each number of options."""

    total: int
    buckets: dict[str, int]
    options: dict[int, int] = field(default_factory=dict)

    def cell(self, bucket: Column, options: Column) -> list[Column]:
        """The columns of a row's cell: numbers of options without a minimum are one class, 0."""
        known = F.when(options.isin(*self.options), options).otherwise(F.lit(0)) if self.options else F.lit(0)
        return [bucket.alias("_bucket"), known.cast("int").alias("_options")]


def shared_minima(counts: dict[Cell, int], quota: Quota) -> int:
    """How many attempts can count for a bucket's and an option number's minimum at once.

    The largest flow from buckets to option numbers through their cells, as the
    least of its cuts: there is one per set of buckets and set of option numbers.
    """
    buckets, options = list(quota.buckets), list(quota.options)
    cuts = []
    for inside in itertools.product([False, True], repeat=len(buckets) + len(options)):
        held = {b for b, flag in zip(buckets, inside) if flag}
        reached = {o for o, flag in zip(options, inside[len(buckets) :]) if flag}
        cut = sum(quota.buckets[b] for b in buckets if b not in held) + sum(quota.options[o] for o in reached)
        cuts.append(cut + sum(counts.get((b, o), 0) for b in held for o in options if o not in reached))
    return min(cuts)


def shortfalls(counts: dict[Cell, int], quota: Quota) -> list[str]:
    """Why a multiset of attempts cannot fill the quota; empty if it can."""
    allowed = {cell: n for cell, n in counts.items() if cell[0] in quota.buckets}
    out = [f"{b}: {have} of {need}" for b, need in quota.buckets.items() if (have := sum(n for c, n in allowed.items() if c[0] == b)) < need]
    out += [
        f"{o} options: {have} of {need}" for o, need in quota.options.items() if (have := sum(n for c, n in allowed.items() if c[1] == o)) < need
    ]
    if sum(allowed.values()) < quota.total:
        out.append(f"all: {sum(allowed.values())} of {quota.total}")
    least = sum(quota.buckets.values()) + sum(quota.options.values())
    if not out and least - shared_minima(allowed, quota) > quota.total:
        out.append(f"the minima need {least - shared_minima(allowed, quota)} situations, the total is {quota.total}")
    return out


def reserved(counts: dict[Cell, int], quota: Quota) -> dict[Cell, int]:
    """How many attempts of each cell the minima need, as few as possible together."""
    cells = [(b, o) for b in quota.buckets for o in quota.options]
    taken: dict[Cell, int] = dict.fromkeys(cells, 0)
    buckets, options = dict(quota.buckets), dict(quota.options)
    for cell in cells:
        step = min(counts.get(cell, 0), buckets[cell[0]], options[cell[1]])
        taken[cell] += step
        buckets[cell[0]] -= step
        options[cell[1]] -= step
    # A unit for an open bucket and an open option number moves along cells that are used already.
    while path := _augmenting(counts, taken, buckets, options):
        for sign, cell in path:
            taken[cell] += sign
        buckets[path[0][1][0]] -= 1
        options[path[-1][1][1]] -= 1
    for axis, open_ in ((0, buckets), (1, options)):
        for name, need in open_.items():
            for cell in sorted(counts, key=lambda c: (c[1 - axis] != 0, c)):
                if need and cell[axis] == name and cell[0] in quota.buckets:
                    step = min(need, counts[cell] - taken.get(cell, 0))
                    taken[cell] = taken.get(cell, 0) + step
                    need -= step
    return {cell: n for cell, n in taken.items() if n}


def _augmenting(counts: dict[Cell, int], taken: dict[Cell, int], buckets: dict[str, int], options: dict[int, int]) -> list[tuple[int, Cell]]:
    """Cells to raise and lower in turn, from a bucket to an option number that both still need one."""
    paths = [[(1, cell)] for cell in taken if buckets[cell[0]] and taken[cell] < counts.get(cell, 0)]
    seen = {path[-1][1][1] for path in paths}
    for path in paths:
        end = path[-1][1][1]
        if options[end]:
            return path
        for lower in (c for c in taken if c[1] == end and taken[c]):
            for rise in (c for c in taken if c[0] == lower[0] and c[1] not in seen and taken[c] < counts.get(c, 0)):
                seen.add(rise[1])
                paths.append([*path, (-1, lower), (1, rise)])
    return []


def _cell_counts(rows: DataFrame, *more: Column) -> list:
    return rows.groupBy(*more, "_bucket", "_options").agg(F.count("*").alias("n")).collect()


def last_attempt(cells: DataFrame, quota: Quota, key: str, parts: int = 256) -> tuple[int, Counter]:
    """The attempt with which the quota can first be filled, and the counts of cells up to it.

    The range of keys is cut into ``parts``, counts per part and cell tell the part
    in which the quota becomes feasible, and that part is cut again.
    """
    low, high = cells.agg(F.min(key), F.max(key)).first()
    before: Counter = Counter()
    while True:
        width = max(1, -(-(high - low + 1) // parts))
        part = F.floor((F.col(key) - low) / width).alias("_part")
        found: dict[int, Counter] = {}
        for row in _cell_counts(cells.filter(F.col(key).between(low, high)), part):
            found.setdefault(row["_part"], Counter())[row["_bucket"], row["_options"]] = row["n"]
        for number in sorted(found):
            upto = before + found[number]
            if not shortfalls(upto, quota):
                break
            before = upto
        else:
            raise ValueError("the quota cannot be filled: " + "; ".join(shortfalls(before, quota)))
        low, high = low + number * width, min(high, low + (number + 1) * width - 1)
        if width == 1:
            return low, upto


def fill_quota(candidates: DataFrame, quota: Quota, key: str, bucket: str, options: str) -> tuple[DataFrame, DataFrame]:
    """(kept, report) of candidates with distinct whole-number keys, taken in their order.

    ``kept`` has the key and its bucket and number of options; ``report`` is one row:
    attempts until the quota was full, kept and rejected, and how many of the rejected
    were in no allowed bucket. Raises when all candidates together do not suffice.
    """
    slim = candidates.select(key, bucket, options, *quota.cell(F.col(bucket), F.col(options)))
    cells = save(slim, "quota-cells")
    last, counts = last_attempt(cells, quota, key)
    takes = reserved(counts, quota)
    run = cells.filter(F.col(key) <= last)
    allowed = run.filter(F.col("_bucket").isin(*quota.buckets))
    ranked = ranking.rank_within(allowed, ["_bucket", "_options"], [F.col(key)], "_r")
    need = F.lit(0)
    for (b, o), n in takes.items():
        need = F.when((F.col("_bucket") == b) & (F.col("_options") == o), n).otherwise(need)
    named = [key, bucket, options]
    spare = quota.total - sum(takes.values())
    first = ranked.filter(F.col("_r") <= need).select(*named)
    rest = ranking.rank_within(ranked.filter(F.col("_r") > need).select(*named), [], [F.col(key)], "_place")
    kept = first.unionByName(rest.filter(F.col("_place") <= spare).select(*named))
    report = run.agg(
        F.count("*").alias("attempts"),
        F.lit(quota.total).cast("long").alias("kept"),
        (F.count("*") - quota.total).alias("rejected"),
        F.count_if(~F.coalesce(F.col("_bucket").isin(*quota.buckets), F.lit(False))).alias("in_no_allowed_bucket"),
    )
    return kept, report


def generate_until(
    spark: SparkSession,
    make: Callable[[DataFrame], DataFrame],
    quota: Quota,
    bucket: str = "bucket",
    options: str = "num_options",
    first: int | None = None,
    most_attempts: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Generate situations by attempt number until the quota is full.

    ``make`` turns a table of attempts (column ``attempt``) into situations with
    ``situation_id``, the attempt, and their bucket and number of options. Rounds cover
    ranges of attempts that double; only the classes of a round are stored. As a
    situation depends on its attempt alone, the kept ones are made again at the
    end. Returns them and the report of ``fill_quota``; raises beyond ``most_attempts``.
    """

    def attempts(begin: int, end: int) -> DataFrame:
        return spark.range(begin, end).withColumnRenamed("id", "attempt")

    begin, end, counts, rounds = 0, first or 4 * quota.total, Counter(), []
    while True:
        end = min(end, most_attempts) if most_attempts else end
        made = make(attempts(begin, end)).select("situation_id", bucket, options)
        rounds.append(save(made, "quota-round"))
        cells = rounds[-1].select(*quota.cell(F.col(bucket), F.col(options)))
        counts.update({(row["_bucket"], row["_options"]): row["n"] for row in _cell_counts(cells)})
        if not (missing := shortfalls(counts, quota)):
            break
        if most_attempts and end >= most_attempts:
            raise ValueError(f"{end} attempts do not fill the quota: " + "; ".join(missing))
        begin, end = end, 2 * end
    seen = rounds[0]
    for more in rounds[1:]:
        seen = seen.unionByName(more)
    kept, report = fill_quota(seen, quota, "situation_id", bucket, options)
    kept = save(kept.select("situation_id"), "quota-kept")
    keys = attempts(0, end).join(kept, F.col("attempt") == F.col("situation_id"), "left_semi")
    return make(keys), report
