"""Whole-situation sampling and mixes."""

import itertools
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from wagerframe.operators import ranking, sampling


def sums(sizes):
    return {sum(c) for r in range(len(sizes) + 1) for c in itertools.combinations(sizes, r)}


def test_takes_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(1, 6) for _ in range(rng.randint(1, 8))]
        histogram = {s: sizes.count(s) for s in sizes}
        for target in range(1, sum(sizes) + 2):
            takes = sampling.takes_for(histogram, target)
            assert (takes is not None) == (target in sums(sizes))
            if takes is not None:
                assert sum(s * n for s, n in takes.items()) == target
                assert all(n <= histogram[s] for s, n in takes.items())


def test_nearest_totals():
    assert sampling.nearest_totals({3: 2, 5: 1}, 7) == [6, 8, 5, 3, 11]


def test_exact_and_capped_rows(spark):
    df = spark.createDataFrame([(g, i) for g in range(40) for i in range(2 + g % 3)], "g long, i int")
    got = sampling.exact_rows(df, 37, "g", 5, parts=5)
    assert got.count() == 37
    assert got.groupBy("g").count().join(df.groupBy("g").agg(F.count("*").alias("full")), "g").filter("count <> full").count() == 0
    fours = df.filter(F.col("g") % 3 == 2)
    with pytest.raises(ValueError, match="near totals"):
        sampling.exact_rows(fours, 9, "g", 5)
    assert sampling.capped_rows(fours, 11, "g", 5).count() == 8
    with pytest.raises(ValueError, match="smaller than"):
        sampling.capped_rows(fours, 3, "g", 5)


def test_huge_targets_need_little_memory():
    tracemalloc.start()
    histogram = {s: 1_000_000 // s for s in range(3, 400)} | {90_000_000: 1}
    for target in (200_000_000, 199_999_999, 90_000_001, 5, sum(s * c for s, c in histogram.items()) - 7):
        takes = sampling.takes_for(histogram, target)
        assert sum(s * n for s, n in takes.items()) == target and all(0 <= n <= histogram[s] for s, n in takes.items())
    assert sampling.takes_for(histogram, 2) is None
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000


def test_few_large_groups_are_decided_exactly():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.choice([2, 4, 9, 30, 31, 47, 100]) for _ in range(rng.randint(2, 9))]
        histogram = {s: sizes.count(s) for s in sizes}
        every = sums(sizes)
        wanted = rng.randint(1, sum(sizes))
        for target in {wanted, *rng.sample(sorted(every), min(4, len(every)))}:
            takes = sampling.takes_for(histogram, target)
            assert (takes is not None) == (target in every)
            assert takes is None or sum(s * n for s, n in takes.items()) == target
            assert takes is None or all(0 <= n <= histogram[s] for s, n in takes.items())
        near = sorted((t for t in every if t > 0 and t != wanted), key=lambda t: (abs(t - wanted), t))[:6]
        assert sampling.nearest_totals(histogram, wanted) == near


def test_mix_sizes(spark):
    def sizes(wanted, percent, modified, unmodified):
        pools = spark.createDataFrame([(modified, unmodified)], "modified long, unmodified long")
        return tuple(sampling.mix_sizes(pools, wanted, percent).first())

    assert sizes(200, 30, 1000, 1000) == (60, 140)
    assert sizes(200, 50, 10, 1000) == (10, 10)
    assert sizes(200, 0, 10, 50) == (0, 50)
    assert sizes(200, 130, 10, 50) == (10, 0)
    assert sizes(10, 50, 0, 5) == (0, 0)
    some = spark.range(5).withColumnRenamed("id", "k")
    with pytest.raises(ValueError, match="no mix"):
        sampling.two_pool_mix(some, some.limit(0), 10, 50, 1, "k")


def test_smallest_equals_sorting(spark):
    rows = [(i, (i * 7919 % 1000) / 1000.0) for i in range(1000)] + [(5000 + i, 0.25) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, u double").repartition(7)
    ordered = [k for k, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    for n in (0, 1, 250, 251, 400, 1300, 2000):
        got = ranking.smallest(df, n, F.col("u"), [F.col("k")], digit_bits=3, few=20)
        assert got.columns == df.columns and sorted(r.k for r in got.collect()) == sorted(ordered[:n])
    assert "TakeOrderedAndProject" not in ranking.smallest(df, 400, F.col("u"), [F.col("k")], few=20)._jdf.queryExecution().toString()


def test_sample_is_independent_of_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one = {r.k for r in sampling.seeded_sample(df.repartition(1), 50, 3, "k").collect()}
    nine = {r.k for r in sampling.seeded_sample(df.repartition(9), 50, 3, "k").collect()}
    assert one == nine and len(one) == 50
