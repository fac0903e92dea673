"""Numbering and interleaving, with heavy keys cut over several parts."""

import random

from pyspark.sql import functions as F

from wagerframe.operators import pairs, ranking

SMALL = {"parts": 7}


def rows_with_hot_key(n=600):
    rng = random.Random(3)
    return [(i, rng.choice(["hot", "hot", "hot", "b", "c", f"k{i % 40}"]), rng.randrange(50)) for i in range(n)]


def test_sliced_rank_equals_plain_rank(spark):
    data = rows_with_hot_key()
    df = spark.createDataFrame(data, "id long, key string, v int").repartition(5)
    got = {r.id: r["rank"] for r in ranking.rank_within(df, ["key"], [F.col("v"), F.col("id")], **SMALL).collect()}
    want = {}
    for key in {k for _, k, _ in data}:
        for place, (_, i) in enumerate(sorted((v, i) for i, k, v in data if k == key), 1):
            want[i] = place
    assert got == want


def test_rank_keeps_null_keys(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(60)], "id long, key string")
    out = ranking.rank_within(df, ["key"], [F.col("id")], **SMALL)
    assert out.filter(F.col("key").isNull()).agg(F.max("rank")).first()[0] == 30


def test_dense_index_is_dense_for_any_number_of_parts(spark):
    df = spark.createDataFrame([(i * i % 997,) for i in range(300)], "v long").repartition(7)
    for parts in (1, 3, 50):
        got = ranking.dense_index(df, [F.col("v")], "p", parts=parts).orderBy("p").collect()
        assert [r.p for r in got] == list(range(1, 301))
        assert [r.v for r in got] == sorted(r.v for r in got)


def test_keep_first_is_idempotent(spark):
    df = spark.createDataFrame([(0, "x", None), (1, "x", None), (2, "x", ""), (3, "y", "z"), (4, "y", "z")], "id long, a string, b string")
    once = ranking.keep_first(df, ["a", "b"], "id")
    assert sorted(r.id for r in once.collect()) == [0, 2, 3]
    assert sorted(r.id for r in ranking.keep_first(once, ["a", "b"], "id").collect()) == [0, 2, 3]


def greedy_alternation(kinds):
    queues = {k: [i for i, x in enumerate(kinds) if x == k] for k in ("a", "b")}
    turn = "b" if kinds and kinds[0] == "b" else "a"
    out = []
    while queues["a"] and queues["b"]:
        out.append(queues[turn].pop(0))
        turn = "b" if turn == "a" else "a"
    return out + queues["a"] + queues["b"]


def test_alternate_equals_queues(spark):
    rng = random.Random(5)
    for n in (0, 1, 7, 90):
        kinds = [rng.choice(["a", "b", "b", "other"]) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(kinds)), "id long, kind string")
        got = ranking.alternate(df, "kind", "id", ("a", "b"), **SMALL).orderBy("position").collect()
        assert [r.id for r in got] == greedy_alternation(kinds)
        assert [r.position for r in got] == list(range(1, len(got) + 1))


def greedy_schedule(targets):
    total, given, out = sum(targets.values()), {k: 0 for k in targets}, []
    for position in range(1, total + 1):
        open_kinds = [k for k in targets if given[k] < targets[k]]
        best = max(open_kinds, key=lambda k: targets[k] * position - given[k] * total)
        given[best] += 1
        out.append(best)
    return out


def test_deficit_schedule_equals_greedy(spark):
    for targets in ({"a": 20, "b": 5}, {"a": 7, "b": 3, "c": 2}, {"a": 4, "b": 4}):
        rows = [(k, i) for k, n in targets.items() for i in range(1, n + 1)]
        df = spark.createDataFrame(rows, "kind string, k long")
        got = ranking.deficit_schedule(df, "kind", "k", targets).orderBy("slot").collect()
        assert [r.slot for r in got] == list(range(1, len(rows) + 1))
        assert [r.kind for r in got] == greedy_schedule(targets)


def test_exact_median(spark):
    rng = random.Random(8)
    for n in (1, 2, 9, 100):
        values = [rng.choice([0.0, 1.5, rng.uniform(-1e6, 1e6)]) for _ in range(n)]
        df = spark.createDataFrame([("g", v) for v in values] + [("h", 4.0)], "g string, v double")
        got = {r.g: r.m for r in pairs.exact_median(df, ["g"], "v", "m", buckets=16).collect()}
        ordered = sorted(values)
        assert got["g"] == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        assert got["h"] == 4.0


def test_spread_positions_computes_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)
    costly = F.udf(lambda v: read.add(1) or v % 7, "long")
    rows = spark.range(300, numPartitions=3).select("id", costly("id").alias("group"))
    found = ranking.spread_positions(rows, "group", F.col("id")).collect()
    assert sorted(r["position"] for r in found) == list(range(1, 301))
    assert read.value == 300
