"""Readers, writers, metrics on edge tables, and restarted streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagerframe.functions import text
from wagerframe.operators import generate, pairs, policy
from wagerframe.operators import situations as sit
from wagerframe.plans import catalogue, views
from wagerframe.sources import catalog, readers, writers
from wagerframe.streaming import jobs

SCORED = (
    "option_type string, is_best_cara boolean, is_best_linear boolean, is_worst_linear boolean, "
    "expected_value_fraction_of_best double, expected_value_relative_to_range double, expected_value_regret double"
)
PAIRS = (
    "accepted_score double, rejected_score double, length_relation string, accepted_truncated boolean, rejected_truncated boolean"
)


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'two\nlines, "quoted"', None), (2, "", "x")]
    df = spark.createDataFrame(rows, "id long, body string, note string")
    writers.write_csv(df.coalesce(1), str(tmp_path / "t.csv"))
    back = readers.read_csv(spark, str(tmp_path / "t.csv"), raw=True).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", 'two\nlines, "quoted"', ""), ("2", "", "x")]
    with pytest.raises(Exception):
        writers.write_csv(df, str(tmp_path / "t.csv"))


def test_bom_and_unnamed_columns(spark, tmp_path):
    (tmp_path / "b.csv").write_text("﻿id,Unnamed: 0\n1,z\n", encoding="utf-8")
    df = readers.drop_unnamed(readers.read_tabular(spark, str(tmp_path / "b.csv")))
    assert df.columns == ["id"]
    readers.require_columns(df, ["id"])
    with pytest.raises(ValueError, match="missing required"):
        readers.require_columns(df, ["id", "prompt_text"])


def test_row_files_and_run_results(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    (tmp_path / "l.jsonl").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "l.json").write_text('[{"a":1},{"a":2}]')
    (tmp_path / "r.json").write_text('{"rows":[{"a":1},{"a":2}]}')
    for name in ("l.jsonl", "l.json", "r.json"):
        assert sorted(r.a for r in readers.read_rows(spark, str(tmp_path / name), schema).collect()) == [1, 2]
    (tmp_path / "run.json").write_text('{"results": [')
    (tmp_path / "run.json.bak").write_text(json.dumps({"resume_records": [{"a": 7}]}))
    assert [r.a for r in readers.read_run_results(spark, str(tmp_path / "run.json"), schema).collect()] == [7]


def test_catalog():
    names = catalog.Catalog(None)
    names.add("steals_test", "/data/steals", "steals")
    assert names.resolve("steals_test", "with_steals") == ("/data/steals", "steals_only", "steals_test")
    assert names.budget("steals_test") == 1000
    with pytest.raises(ValueError, match="no variant"):
        names.resolve("steals_test", "rebels")


def test_newline_gate_and_dpo_lines(spark):
    df = spark.createDataFrame([("p", "a\\nb", "r", None, 1), ("q", " é ", "r", "lin", None), (" ", "c", "r", "lin", 2)], "prompt_text string, chosen_full string, rejected_full string, rejected_type string, situation_id int")
    with pytest.raises(ValueError, match="1 cells in 1 rows"):
        writers.refuse_literal_newlines(df, ["chosen_full", "rejected_full"], "pairs")
    lines = [r.value for r in pairs.dpo_lines(df, ["situation_id", "rejected_type"]).collect()]
    assert [json.loads(v) for v in lines] == [
        {"prompt": "p", "chosen": "a\\nb", "rejected": "r", "situation_id": 1},
        {"prompt": "q", "chosen": "é", "rejected": "r", "rejected_type": "lin"},
    ]
    assert all(v.isascii() for v in lines)


def test_policy_rates_null_rules(spark):
    def rates(rows):
        return policy.metrics(spark.createDataFrame(rows, SCORED)).first()

    none = rates([(None,) * 7])
    assert (none.parse_rate, none.cooperate_rate, none.best_cara_rate, none.avg_expected_value_regret) == (0.0, 0.0, 0.0, None)
    other = rates([("Generic", True, None, None, None, None, None)])
    assert (other.parse_rate, other.cooperate_rate, other.best_cara_rate, other.best_linear_rate) == (1.0, None, 1.0, 0.0)
    empty = rates([])
    assert (empty.parse_rate, empty.num_total) == (0.0, 0)


def test_pair_bundle(spark):
    rows = [(2.0, 1.0, "accepted_longer", False, False), (1.0, 3.0, None, True, False), (1.0, 1.0, "same_length", False, False)]
    got = pairs.pair_metrics(pairs.judge(spark.createDataFrame(rows, PAIRS))).first()
    assert (got.num_correct, got.num_incorrect, got.num_ties, got.num_truncated_pairs) == (1, 1, 1, 1)
    assert abs(got.pairwise_accuracy_ties_half_credit - 0.5) < 1e-12 and got.median_score_margin == 0.0
    assert got.pairwise_accuracy_when_accepted_longer == 1.0 and got.pairwise_accuracy_when_rejected_longer == 0.0
    zero = pairs.pair_metrics(pairs.judge(spark.createDataFrame([], PAIRS))).first()
    assert zero.num_total == 0 and zero.pairwise_accuracy == 0.0 and zero.median_score_margin == 0.0


def test_generated_tables_do_not_depend_on_partitions(spark):
    def rows(n):
        made = generate.high_stakes(spark.range(120).repartition(n), "id", 4, "steals_and_rebels", "astronomical")
        return sorted((r.situation_id, str(r.options)) for r in made.select("situation_id", "options").collect())

    one = rows(1)
    assert one == rows(6) and len(one) == 120


def test_low_stakes_prizes_are_distinct_small_whole_numbers(spark):
    made = generate.low_stakes(spark.range(200), "id", 4).select(F.explode("options").alias("o")).select("o.*").collect()
    assert all(len(set(r.prizes)) == len(r.prizes) or any(abs(v) == 100 for v in r.prizes) for r in made)
    assert all(-100 <= v <= 100 and sum(r.probs) == 100 for r in made for v in r.prizes)


def test_stream_restart_gives_the_same_table(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    key = spark.createDataFrame(
        [(s, 2, "rebels_only", "verbal", "low", 5.0, 1.0, [("Cooperate", True, True, False, 5.0), ("Rebel", False, False, True, 1.0)]) for s in range(6)],
        "situation_id long, num_options int, subset_type string, probability_format string, source_stakes string, max_expected_value double, "
        "min_expected_value double, options array<struct<option_type:string,is_best_cara:boolean,is_best_linear:boolean,is_worst_linear:boolean,expected_value:double>>",
    )
    rows = [(s, f'{{"answer":"{1 + s % 2}"}}', "stop", s) for s in range(6)]
    schema = "situation_id long, response string, finish_reason string, seq long"
    everything = spark.createDataFrame(rows, schema)

    def advance():
        stream = jobs.score_batches(jobs.read_files(spark, source, everything.schema, per_batch=1), key, out, state)
        stream.awaitTermination()

    everything.filter("seq < 3").coalesce(1).write.parquet(source)
    advance()
    everything.filter("seq >= 2").coalesce(1).write.mode("append").parquet(source)  # seq 2 arrives twice
    advance()
    advance()  # nothing new
    final = jobs.read_results(spark, out, ["situation_id"], ["seq"])
    assert sorted((r.situation_id, r.option_type) for r in final.collect()) == [
        (s, "Rebel" if s % 2 else "Cooperate") for s in range(6)
    ]


def test_resume_settings(spark):
    a = spark.createDataFrame([("m", 1, None)], "base_model string, seed int, backend string")
    b = spark.createDataFrame([("m", 2, None)], "base_model string, seed int, backend string")
    jobs.check_resume(a, a)
    with pytest.raises(ValueError, match="seed: 1 -> 2"):
        jobs.check_resume(a, b)
    assert jobs.is_complete(a, ["base_model", "seed"]) and not jobs.is_complete(a, ["backend"])


def test_resume_compares_the_whole_protocol(spark):
    stored = spark.createDataFrame([("m1", "d1", 0.5)], "model_path string, dataset string, min_p double")
    current = spark.createDataFrame([("m2", "d2", 0.5)], "model_path string, dataset string, min_p double")
    found = {r.setting for r in jobs.config_differences(stored, current).collect()}
    assert found == {"model_path", "dataset"}
    with pytest.raises(Exception, match="must be one row"):
        jobs.config_differences(stored.union(current), current).collect()


def test_budgets_of_variants(spark):
    known = catalog.Catalog(spark)
    known.add("medium_stakes_validation", "/none", "steals_only")
    known.add("low_stakes_validation_lin_only", "/none")
    known.add("own_name", "/none", base="high_stakes_test")
    assert known.budget("medium_stakes_validation", "steals_only") == 500
    assert known.budget("medium_stakes_validation") == 200
    assert known.budget("low_stakes_validation_lin_only") == 200
    assert known.budget("own_name") == 1000 and known.budget("unknown") is None


def test_nesting_loses_no_option(spark):
    rows = [(1, 0, "a"), (1, 0, "a"), (1, 1, "b")]
    nested = sit.nest(spark.createDataFrame(rows, "id int, i int, t string"), "id", "i", [], ["t"]).first()
    assert [(o.i, o.t) for o in nested.options] == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="options differ"):
        sit.nest(spark.createDataFrame([*rows, (1, 1, "c")], "id int, i int, t string"), "id", "i", [], ["t"]).collect()
    wide = spark.createDataFrame([(1, 30, "z")], "id int, i int, t string")
    assert sit.nest(wide, "id", "i", [], ["t"], max_options=40).count() == 1


def test_no_options_have_no_labels(spark):
    df = spark.createDataFrame([(0,), (2,)], "n int")
    assert [r[0] for r in df.select(text.label_domain(df.n)).collect()] == [[], ["a", "b", "1", "2"]]


def test_median_of_a_heavy_tail(spark):
    # A million Pareto values in one group: nearly all of the range is empty.
    heavy = spark.range(1_000_000).select(F.lit("p").alias("g"), F.pow(1.0 - (F.col("id") * 7919 % 1_000_003) / 1_000_003.0, -4.0).alias("v"))
    few = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0), ("c", None), (None, 3.0), (None, 3.0), (None, 9.0), ("b", 2.0)], "g string, v double")
    ties = spark.range(5000).select(F.lit("t").alias("g"), F.when(F.col("id") < 2500, 1.0).otherwise(2.0).alias("v"))
    df = heavy.unionByName(few).unionByName(ties)
    exact = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect() if r.m is not None}
    got = {r.g: r.m for r in pairs.exact_median(df, ["g"], "v", "m").collect()}
    assert got == exact and got["t"] == 1.5
    assert pairs.exact_median(heavy, [], "v", "m").first().m == exact["p"]
    assert pairs.exact_median(few.limit(0), [], "v", "m").first().m is None


def test_large_json_list_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(200).select(F.col("id"), F.concat(F.lit("a\n  }\n"), F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("text"))
    readers.write_indented_list(rows, str(tmp_path / "list"), part_bytes=2000)
    parts = sorted((tmp_path / "list").glob("part-*"))
    assert len(parts) > 5 and max(p.stat().st_size for p in parts) < 8000
    want = sorted(map(tuple, rows.collect()))
    assert sorted((r["id"], r["text"]) for r in json.loads("".join(p.read_text() for p in parts))) == want
    assert sorted(map(tuple, readers.read_indented_list(spark, str(tmp_path / "list"), rows.schema).collect())) == want
    readers.write_indented_list(rows.limit(0), str(tmp_path / "none"))
    assert readers.read_indented_list(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_situations_are_made_once_for_all_quantities(spark, tmp_path):
    spark.createDataFrame(
        [(k, k * 3, 1000.0 + k, "3-MEDIUM", "O") for k in range(1, 9)],
        "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    read = catalogue.queries()["transfer_prompts_read_back"](spark, str(tmp_path))
    assert read._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert read.select("domain", "situation_id").distinct().count() == 4 * 8


def test_orders_are_dealt_out_on_a_cluster_too(spark, tmp_path, monkeypatch):
    spark.createDataFrame(
        [(k, k * 3, 1000.0 + k, "3-MEDIUM", "O") for k in range(1, 41)],
        "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string",
    ).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    here = sorted(map(str, views.situations(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://cluster:7077")
    there = views.situations(spark, str(tmp_path))
    filled = there.select(F.spark_partition_id().alias("part")).distinct().count()
    assert there.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and filled > spark.sparkContext.defaultParallelism
    assert sorted(map(str, there.collect())) == here
