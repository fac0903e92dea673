"""Reproducible random draws keyed by (seed, key, stream).

Every draw hashes its key, so a table comes out the same for any partitioning,
after a lost executor, and in another SQL engine. No sequential generator exists.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wagerframe.functions.lottery import let


def uniform(seed: int, key: Column, stream: str | Column) -> Column:
    """A draw in [0, 1): the first 13 hex digits of an md5 over 2**52."""
    stream = F.lit(stream) if isinstance(stream, str) else stream
    digest = F.md5(F.concat(F.lit(str(seed)), _behind("|", key.cast("string")), _behind("|", stream)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def _behind(mark: str, cell: Column) -> Column:
    """A text behind a mark, nothing if it is null: parts of ``concat`` as ``concat_ws`` joins them, at a fraction of its time."""
    return F.coalesce(F.concat(F.lit(mark), cell), F.lit(""))


def own_key(key: Column, part: Column) -> Column:
    """Key of a numbered part of a keyed row; a null key leaves the number."""
    return F.concat(F.coalesce(F.concat(key.cast("string"), F.lit("/")), F.lit("")), part.cast("string"))


def uniform_int(seed: int, key: Column, stream: str | Column, low: Column | int, high: Column | int) -> Column:
    """Integer in [low, high], both ends included."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + F.floor(uniform(seed, key, stream) * (high - low + 1))).cast("int")


def weighted_choice(u: Column, values: list, weights: list[float]) -> Column:
    """Pick by cumulative weight; weights need not add to one."""
    total = float(sum(weights))
    chosen = None
    seen = 0.0
    for value, weight in zip(values[:-1], weights[:-1]):
        seen += weight
        chosen = (F if chosen is None else chosen).when(u < seen / total, F.lit(value))
    return F.lit(values[-1]) if chosen is None else chosen.otherwise(F.lit(values[-1]))


def pick(u: Column, pool: list) -> Column:
    """Equal-chance pick from a short literal pool."""
    return F.get(F.array(*[F.lit(v) for v in pool]), F.floor(u * len(pool)).cast("int"))


def log_uniform(u: Column, low: float | Column, high: float | Column) -> Column:
    low = F.lit(float(low)) if isinstance(low, (int, float)) else low
    high = F.lit(float(high)) if isinstance(high, (int, float)) else high
    return F.exp(F.ln(low) + u * (F.ln(high) - F.ln(low)))


def zero_inflated(u_zero: Column, u: Column, p_zero: float, high: float) -> Column:
    return F.when(u_zero < p_zero, F.lit(0.0)).otherwise(u * high)


def normal(u1: Column, u2: Column, mean: float, sd: float) -> Column:
    """Box-Muller on two uniform draws."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1))
    return F.lit(mean) + F.lit(sd) * radius * F.cos(F.lit(2 * math.pi) * u2)


def distinct_sample(seed: int, key: Column, stream: str, domain: Column, n: Column) -> Column:
    """``n`` distinct members of an array, in hash order."""
    tagged = F.transform(
        domain,
        lambda v: F.struct(uniform(seed, key, F.concat(F.lit(stream + "#"), v.cast("string"))).alias("u"), v.alias("v")),
    )
    return F.slice(F.transform(F.sort_array(tagged), lambda s: s["v"]), F.lit(1), n)


def distinct_ints(seed: int, key: Column, stream: str, low: Column, high: Column, n: Column) -> Column:
    """``n`` distinct integers of [low, high], every set equally likely, with ``n`` draws.

    Each step draws from a range one longer than the last; a value seen before is
    replaced by the range's end.
    """

    def add(seen: Column, end: Column) -> Column:
        u = uniform(seed, key, F.concat(F.lit(stream + "#"), end.cast("string")))
        return let(
            (low + F.floor(u * (end - low + 1))).cast("int"),
            lambda value: F.array_append(seen, F.when(F.array_contains(seen, value), end).otherwise(value)),
        )

    ends = F.when(n > 0, F.sequence(high - n + 1, high)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ends, F.array().cast("array<int>"), add)


def strict_composition(seed: int, key: Column, stream: str, total: Column, parts: Column) -> Column:
    """``parts`` positive integers with the given sum, by sorted distinct cut points."""
    cuts = F.sort_array(distinct_ints(seed, key, stream, F.lit(1), (total - 1).cast("int"), (parts - 1).cast("int")))
    split = let(cuts, lambda c: _gaps(c, total))
    return F.when(parts <= 0, F.array().cast("array<int>")).when(parts == 1, F.array(total)).otherwise(split)


def _gaps(cuts: Column, total: Column) -> Column:
    """Differences of consecutive cut points between 0 and the total."""
    ends, starts = F.concat(cuts, F.array(total)), F.concat(F.array(F.lit(0)), cuts)
    return F.zip_with(ends, starts, lambda e, s: e - s)


def weak_composition(seed: int, key: Column, stream: str, total: Column, parts: Column) -> Column:
    """``parts`` integers >= 0 with the given sum; cut points may repeat."""
    cuts = F.sort_array(
        F.transform(
            F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1))),
            lambda i: F.floor(uniform(seed, key, F.concat(F.lit(stream + "~"), i.cast("string"))) * (total + 1)).cast("int"),
        )
    )
    split = let(cuts, lambda c: _gaps(c, total))
    return F.when(parts <= 0, F.array().cast("array<int>")).when(parts == 1, F.array(total)).otherwise(split)


def composition(seed: int, key: Column, stream: str, total: Column, parts: Column) -> Column:
    """Strict where the total allows it, weak otherwise."""
    return F.when(total < parts, weak_composition(seed, key, stream, total, parts)).otherwise(
        strict_composition(seed, key, stream, total, parts)
    )


def percents(seed: int, key: Column, stream: str, parts: Column, verbal: Column) -> Column:
    """Strict composition of 100; in verbal tables of twenty fives."""
    units = F.when(verbal, F.lit(20)).otherwise(F.lit(100))
    step = F.when(verbal, F.lit(5)).otherwise(F.lit(1))
    return F.transform(strict_composition(seed, key, stream, units, parts), lambda v: v * step)
