"""Quotas with overlapping minima against trying every choice, and generation until they are filled."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wagerframe.operators import generate, quotas
from wagerframe.operators import situations as sit


def possible(counts, quota):
    """Whether some choice of counts per cell meets every rule."""
    cells = [c for c in counts if c[0] in quota.buckets]
    for takes in itertools.product(*[range(counts[c] + 1) for c in cells]):
        if sum(takes) != quota.total:
            continue
        by = Counter()
        for (b, o), n in zip(cells, takes):
            by[b] += n
            by[o] += n
        if all(by[b] >= n for b, n in quota.buckets.items()) and all(by[o] >= n for o, n in quota.options.items()):
            return True
    return False


def test_feasibility_and_reservation_match_trying_all():
    rng = random.Random(2)
    told = Counter()
    for _ in range(400):
        quota = quotas.Quota(rng.randint(1, 6), {b: rng.randint(0, 2) for b in "xy"}, {o: rng.randint(0, 3) for o in (2, 3)})
        counts = {(b, o): rng.randint(0, 3) for b in "xyz" for o in (0, 2, 3)}
        can = not quotas.shortfalls(counts, quota)
        assert can == possible(counts, quota), (counts, quota)
        told[can] += 1
        if can:
            takes = quotas.reserved(counts, quota)
            assert sum(takes.values()) <= quota.total and all(0 < n <= counts[c] for c, n in takes.items())
            for axis, minima in ((0, quota.buckets), (1, quota.options)):
                assert all(sum(n for c, n in takes.items() if c[axis] == name) >= need for name, need in minima.items())
    assert min(told.values()) > 50


def test_shortest_run_is_filled(spark):
    rng = random.Random(5)
    rows = [(k * 3, rng.choice(["a", "a", "a", "b", "other"]), rng.choice([2, 3, 4, 5])) for k in range(400)]
    quota = quotas.Quota(60, {"a": 20, "b": 15}, {2: 18, 3: 18})
    df = spark.createDataFrame(rows, "k long, bucket string, num_options int").repartition(5)
    kept, report = quotas.fill_quota(df, quota, "k", "bucket", "num_options")
    kept, told = kept.collect(), report.first()

    def cells(n):
        return Counter((b, o if o in (2, 3) else 0) for _, b, o in rows[:n])

    least = next(n for n in range(1, 401) if not quotas.shortfalls(cells(n), quota))
    assert (told.attempts, told.kept, told.rejected) == (least, 60, least - 60)
    assert told.in_no_allowed_bucket == sum(b == "other" for _, b, _ in rows[:least])
    assert len({r.k for r in kept}) == 60 and max(r.k for r in kept) <= rows[least - 1][0]
    assert sum(r.bucket == "b" for r in kept) >= 15 and sum(r.num_options == 3 for r in kept) >= 18
    with pytest.raises(ValueError, match="b: "):
        quotas.fill_quota(df, quotas.Quota(60, {"a": 0, "b": 300}), "k", "bucket", "num_options")


def test_generation_stops_with_the_quota(spark):
    def make(keys):
        made = generate.low_stakes(keys, "attempt", 3, "lives_saved")
        return sit.roll_up(sit.score(made.withColumn("raw_subset", F.lit(None).cast("string")), "exact")).select("situation_id", "num_options", "bucket")

    quota = quotas.Quota(30, {"lin_only": 12, "010_only": 12}, {2: 9, 3: 9})
    made, report = quotas.generate_until(spark, make, quota, first=32)
    rows, told = made.collect(), report.first()
    assert len(rows) == 30 == told.kept and told.attempts == 30 + told.rejected and max(r.situation_id for r in rows) < told.attempts
    assert all(sum(r.bucket == b for r in rows) >= 12 for b in quota.buckets) and sum(r.num_options == 2 for r in rows) >= 9
    again, _ = quotas.generate_until(spark, make, quota, first=500)
    assert sorted(r.situation_id for r in again.collect()) == sorted(r.situation_id for r in rows)
    with pytest.raises(ValueError, match="40 attempts do not fill"):
        quotas.generate_until(spark, make, quota, first=16, most_attempts=40)
