"""Lottery mathematics on literal rows."""

import math
import random

from pyspark.sql import functions as F

from wagerframe.functions import formats, lottery
from wagerframe.operators import situations as sit


def column(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_percent_normalisation(spark):
    rows = [([1, 1, 1],), ([0, 0],), ([50, 50],), ([120, 30],), ([3],), ([7, 11, 13],)]
    got = column(spark, rows, "w array<int>", lottery.normalise_percents(F.col("w")))
    assert got == [[34, 33, 33], [100, 0], [50, 50], [77, 23], [100], [23, 35, 42]]


def test_rounding_edges(spark):
    rows = [(0.0,), (1225.0,), (1235.0,), (-12.25,), (1e100,), (0.00012349,), (999.6,)]
    got = column(spark, rows, "v double", lottery.round_significant(F.col("v"), 3))
    assert got[:4] == [0.0, 1220.0, 1240.0, -12.2]
    assert math.isclose(got[4], 1e100) and math.isclose(got[5], 0.000123) and got[6] == 1000.0


def test_expected_value_edges(spark):
    rows = [([10.0, 0.0], [25, 75]), ([10.0, 0.0], [1, 1]), ([1.0], [50, 50]), ([], []), (None, [100])]
    got = column(spark, rows, "x array<double>, p array<int>", lottery.expected_value(F.col("x"), F.col("p")))
    assert got == [2.5, 5.0, None, None, None]


def test_dominance_is_irreflexive_and_antisymmetric(spark):
    rng = random.Random(2)

    def draw():
        k = rng.randint(1, 3)
        cuts = sorted(rng.sample(range(1, 100), k - 1))
        return [float(rng.randint(-3, 3)) for _ in range(k)], [b - a for a, b in zip([0, *cuts], [*cuts, 100])]

    rows = [(*draw(), *draw()) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<double>, p array<int>, b array<double>, q array<int>")
    a, p, b, q = (F.col(c) for c in "apbq")
    got = df.select(lottery.dominates(a, p, a, p), lottery.dominates(a, p, b, q), lottery.dominates(b, q, a, p)).collect()
    assert not any(r[0] for r in got)
    assert not any(r[1] and r[2] for r in got)
    assert any(r[1] for r in got)


def test_texts(spark):
    rows = [(1234.5,), (-12.0,), (0.0,), (2.5e10,), (1.0,)]
    assert column(spark, rows, "v double", formats.money(F.col("v"))) == ["$1,234.50", "-$12", "$0", "$2.50e+10", "$1"]
    assert column(spark, rows[:2] + rows[4:], "v double", formats.lives(F.col("v"))) == ["1,234.5 lives", "-12 lives", "1 life"]
    lot = column(spark, [([5.0, -2.0, 5.0], [25, 50, 25])], "x array<double>, p array<int>", formats.lottery_text(F.col("x"), F.col("p")))
    assert lot == ["0.5(-2), 0.5(5)"]


def test_ties_and_zero_best_value(spark):
    options = [[(0, "Rebel", [1.0], [100]), (1, "Cooperate", [1.0], [100]), (2, "Steal", [-1.0], [100])], [(0, "Cooperate", [0.0], [100]), (1, "Steal", [-5.0], [100])]]
    df = spark.createDataFrame(list(enumerate(options)), "situation_id long, options array<struct<option_index:int,option_type:string,prizes:array<double>,probs:array<int>>>")
    rows = {r.situation_id: r for r in sit.score(df).collect()}
    assert [o.best_linear for o in rows[0].options] == [True, True, False]
    assert rows[1].max_expected_value == 0.0
    fraction = sit.score(df).select("situation_id", lottery.ev_fraction_of_best(F.lit(-5.0), F.col("max_expected_value")).alias("f"))
    assert {r.situation_id: r.f for r in fraction.collect()} == {0: -5.0, 1: None}


def test_option_index_out_of_range_fails(spark):
    import pytest

    df = spark.createDataFrame([(1, 40, "x")], "s long, i int, t string")
    with pytest.raises(Exception, match="out of range"):
        sit.nest(df, "s", "i", [], ["t"]).collect()
