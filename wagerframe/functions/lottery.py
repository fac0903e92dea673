"""Lottery mathematics over short parallel arrays of prizes and percents.

A lottery is two arrays of equal length: outcomes ``x`` (double) and weights
``p`` (integer percent). All helpers are higher-order array expressions, so a
row is scored where it is scanned and no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Utility = Callable[[Column], Column]

# Tolerances and the clip applied to the CARA exponent.
TIE_TOLERANCE = 1e-12
CARA_CLIP = 700.0
LOW_ALPHA = 0.01
HIGH_ALPHA = 0.10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Catalyst does not share subexpressions inside lambdas; without this an inner
    lambda would recompute every array it refers to for each of its elements.
    Folding no elements onto the value hands it to the last step as it is; an element
    of an array would be wrapped first, and the result copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def settle(df: DataFrame, column: str) -> DataFrame:
    """Keep later filters above a costly column.

    The optimizer pushes a filter below a projection by inlining the column's
    whole expression, once per use and again at each stage. It does not push one
    below a generator, so the column is passed through a one-element array.
    """
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode_outer(F.array(column)).alias(column)).select(*df.columns)


def sum_of(values: Column, zero: float | int = 0.0) -> Column:
    return F.aggregate(values, F.lit(zero), lambda acc, v: acc + v)


def half_even(value: Column, decimals: int) -> Column:
    """Round half to even at a fixed number of decimals, in plain double arithmetic."""
    scale = float(10**decimals)
    return let(value, lambda v: F.when(F.abs(v) < 1e15, F.rint(v * scale) / scale).otherwise(v))


def cents(value: Column) -> Column:
    return half_even(value, 2)


def round_significant(value: Column, digits: Column | int) -> Column:
    """Keep ``digits`` significant figures; zero and non-finite values pass through.

    The scaling step multiplies or divides by an exact power of ten, so that a
    decimal tie such as 1225 at three figures is still seen as a tie.
    """
    digits = F.lit(digits) if isinstance(digits, int) else digits

    def scaled(v: Column, shift: Column) -> Column:
        size, factor = F.abs(v), F.pow(F.lit(10.0), F.abs(shift))
        up, down = F.rint(size * factor) / factor, F.rint(size / factor) * factor
        return F.signum(v) * F.when(shift >= 0, up).otherwise(down)

    def rounded(v: Column) -> Column:
        size = F.abs(v)
        finite = (size > 0) & ~F.isnan(v) & (size < float("inf"))
        shift = (digits - 1 - F.floor(F.log10(size))).cast("double")
        return F.when(finite, let(shift, lambda by: scaled(v, by))).otherwise(v)

    return let(value, rounded)


def display_round(value: Column, mode: Column) -> Column:
    """Significant-figure mode such as ``3sf`` followed by rounding to cents."""
    digits = F.regexp_extract(mode, r"^([2-5])sf$", 1).try_cast("int")
    return cents(F.when(digits.isNotNull(), round_significant(value, digits)).otherwise(value))


def normalise_percents(weights: Column, total: int = 100) -> Column:
    """Largest-remainder scaling of non-negative integer weights to ``total``.

    Ties of remainders go to the earlier slot; an all-zero vector puts the whole
    total on the first slot; a vector already at the total is returned as is.
    """

    def share(w: Column, mass: Column) -> Column:
        return F.floor(w * total / mass).cast("int")

    def topped_up(bounded: Column, mass: Column) -> Column:
        by_remainder = F.sort_array(
            F.transform(bounded, lambda w, i: F.struct((-F.pmod(w * total, mass)).alias("r"), i.alias("i")))
        )
        left = F.lit(total) - sum_of(F.transform(bounded, lambda w: share(w, mass)), 0)
        winners = F.transform(F.slice(by_remainder, F.lit(1), left), lambda s: s["i"])
        return let(
            winners,
            lambda first: F.transform(
                bounded, lambda w, i: share(w, mass) + F.when(F.array_contains(first, i), 1).otherwise(0)
            ),
        )

    def scaled(bounded: Column) -> Column:
        empty = F.transform(bounded, lambda _, i: F.when(i == 0, F.lit(total)).otherwise(F.lit(0)))
        return let(
            sum_of(bounded, 0),
            lambda mass: F.when(mass == total, bounded).when(mass <= 0, empty).otherwise(topped_up(bounded, mass)),
        )

    return let(F.transform(weights, lambda w: F.greatest(F.lit(0), F.least(F.lit(100), w.cast("int")))), scaled)


def merged(x: Column, p: Column) -> Column:
    """Equal outcomes merged, sorted by outcome, weights renormalised to one."""
    slots = F.zip_with(x, p, lambda a, b: F.struct((a + F.lit(0.0)).alias("x"), b.cast("double").alias("p")))

    def grouped(slots: Column, mass: Column) -> Column:
        return F.transform(
            F.sort_array(F.array_distinct(F.transform(slots, lambda s: s["x"]))),
            lambda v: F.struct(v.alias("x"), (_weight_on(slots, v, 0.0) / mass).alias("p")),
        )

    return let(slots, lambda s: let(positive_mass(p), lambda mass: grouped(s, mass)))


def _weight_on(slots: Column, value: Column, zero: float | int) -> Column:
    return F.aggregate(
        slots, F.lit(zero), lambda acc, s: acc + F.when(s["x"] == value, s["p"]).otherwise(F.lit(zero))
    )


def positive_mass(p: Column, empty: float = 1.0) -> Column:
    """Total weight, or ``empty`` for an all-zero vector."""
    return let(
        F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v),
        lambda mass: F.when(mass > 0, mass).otherwise(F.lit(empty)),
    )


def merged_in_order(x: Column, p: Column) -> Column:
    """Equal prizes (to the cent) merged at their first position; percents renormalised."""
    keyed = F.zip_with(x, p, lambda a, b: F.struct((cents(a) + F.lit(0.0)).alias("x"), b.cast("int").alias("p")))

    def grouped(slots: Column) -> Column:
        return let(
            F.array_distinct(F.transform(slots, lambda s: s["x"])),
            lambda grid: F.zip_with(
                grid,
                normalise_percents(F.transform(grid, lambda v: _weight_on(slots, v, 0))),
                lambda a, b: F.struct(a.alias("x"), b.alias("p")),
            ),
        )

    return let(keyed, grouped)


def linear(w: Column) -> Column:
    return w


def cara(alpha: float) -> Utility:
    """Constant absolute risk aversion: ``1 - exp(-alpha * w)`` with a clipped exponent."""

    def utility(w: Column) -> Column:
        exponent = F.greatest(F.lit(-CARA_CLIP), F.least(F.lit(CARA_CLIP), w * (-alpha)))
        return F.lit(1.0) - F.exp(exponent)

    return utility


def expected_utility(x: Column, p: Column, utility: Utility = linear) -> Column:
    return sum_of(F.zip_with(x, p, lambda a, b: utility(a) * b)) / positive_mass(p)


def expected_value(x: Column, p: Column) -> Column:
    """Expected prize; null when an array is missing, empty or of another length."""
    weighted = sum_of(F.zip_with(x, p, lambda a, b: a * b))
    usable = (F.size(x) > 0) & (F.size(x) == F.size(p))
    return F.when(usable, weighted / positive_mass(p, 100.0))


def cara_rank_score(x: Column, p: Column) -> Column:
    """``logsumexp(log p - 0.01 x)`` over outcomes with p > 0; lower is better."""
    terms = F.transform(
        F.filter(F.zip_with(x, p, lambda a, b: F.struct(a.alias("x"), b.cast("double").alias("p"))), lambda s: s["p"] > 0),
        lambda s: F.ln(s["p"]) - s["x"] * LOW_ALPHA,
    )

    def log_sum(terms: Column) -> Column:
        return let(
            F.array_max(terms), lambda top: top + F.ln(sum_of(F.transform(terms, lambda t: F.exp(t - top))))
        )

    return let(terms, log_sum)


def mass_at_or_below(x: Column, p: Column, t: Column) -> Column:
    """Weight (not normalised) on outcomes up to ``t``."""
    return sum_of(F.zip_with(x, p, lambda a, b: F.when(a <= t + TIE_TOLERANCE, b.cast("double")).otherwise(F.lit(0.0))))


def dominates(x1: Column, p1: Column, x2: Column, p2: Column) -> Column:
    """First-order stochastic dominance of lottery 1 over lottery 2, strict somewhere."""

    def gaps(m: Column) -> Column:
        return F.transform(
            F.array_distinct(F.concat(x1, x2)),
            lambda t: mass_at_or_below(x1, p1, t) / m["a"] - mass_at_or_below(x2, p2, t) / m["b"],
        )

    masses = F.struct(positive_mass(p1).alias("a"), positive_mass(p2).alias("b"))
    return let(
        let(masses, gaps),
        lambda g: F.forall(g, lambda v: v <= TIE_TOLERANCE) & F.exists(g, lambda v: v < -TIE_TOLERANCE),
    )


def worst_outcome(x: Column, p: Column) -> Column:
    """Lowest prize and the total percent on it."""

    def at(low: Column) -> Column:
        hit = F.zip_with(x, p, lambda a, b: F.when(F.abs(a - low) < TIE_TOLERANCE, b.cast("int")).otherwise(F.lit(0)))
        return F.struct((low + F.lit(0.0)).alias("x"), sum_of(hit, 0).alias("p"))

    return let(F.array_min(x), at)


def ev_fraction_of_best(value: Column, best: Column) -> Column:
    return F.when(best != 0, value / best)


def ev_range_score(value: Column, best: Column, worst: Column) -> Column:
    """Position inside the range of expected values; a flat range counts as 1."""
    return F.when(F.abs(best - worst) < TIE_TOLERANCE, F.lit(1.0)).otherwise(
        F.try_divide(value - worst, best - worst)
    ) + F.lit(0.0) * (value + best + worst)


def bucket(linear_best: Column, low_best: Column, high_best: Column) -> Column:
    """Which best sets are disjoint from the low-alpha best set."""
    off_linear = ~F.arrays_overlap(low_best, linear_best)
    off_high = ~F.arrays_overlap(low_best, high_best)
    return (
        F.when(off_linear & off_high, "both")
        .when(off_linear, "lin_only")
        .when(off_high, "010_only")
        .otherwise("other")
    )


def predicted_preference(margin: Column, tie_epsilon: float = 1e-6) -> Column:
    return F.when(margin > tie_epsilon, "accepted").when(margin < -tie_epsilon, "rejected").otherwise("tie")


def logistic_loss(margin: Column) -> Column:
    """``log(1 + exp(-m))`` without overflow."""
    return F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))


def length_relation(accepted: Column, rejected: Column) -> Column:
    return (
        F.when(accepted.isNull() | rejected.isNull(), F.lit(None).cast("string"))
        .when(accepted > rejected, "accepted_longer")
        .when(rejected > accepted, "rejected_longer")
        .otherwise("same_length")
    )
