"""Queries over answers: parsing, scoring, choice metrics, progress and resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from wagerframe.functions import answers, text
from wagerframe.operators import policy, ranking
from wagerframe.operators import situations as sit
from wagerframe.plans.option_queries import _SETS, six
from wagerframe.plans.registry import query, spread, table
from wagerframe.plans.views import OPTIONS_SQL, RESPONSES_SQL, long_answers, long_answers_sql, responses, situations

FIELDS = ["subset_type", "probability_format", "source_stakes"]
RATES = [
    "parse_rate", "cooperate_rate", "rebel_rate", "steal_rate", "best_cara_rate", "best_linear_rate", "worst_linear_rate",
    "avg_expected_value_fraction_of_best", "avg_expected_value_relative_to_range", "avg_expected_value_regret",
]

SCORED_SQL = f"""WITH {OPTIONS_SQL} {_SETS.rstrip()}, {RESPONSES_SQL}, res AS (
  SELECT r.*, b.subset_type, CASE WHEN b.verbal THEN 'verbal' ELSE 'numerical' END AS probability_format, b.source_stakes,
         o.option_type, o.best_low AS is_best_cara, o.best_linear AS is_best_linear, o.worst_linear AS is_worst_linear,
         o.ev AS expected_value, b.best_ev, b.worst_ev,
         CASE WHEN b.best_ev <> 0 THEN o.ev / b.best_ev END AS fraction_of_best,
         CASE WHEN o.ev IS NULL THEN NULL WHEN abs(b.best_ev - b.worst_ev) < 1e-12 THEN 1.0
              ELSE (o.ev - b.worst_ev) / (b.best_ev - b.worst_ev) END AS relative_to_range, b.best_ev - o.ev AS regret
  FROM resp r LEFT JOIN bucketed b ON b.situation_id = r.situation_id
  LEFT JOIN scored o ON o.situation_id = r.situation_id AND o.option_index = r.number - 1 AND r.choice IS NOT NULL)
"""

BUNDLE_SQL = """round(count(option_type) / count(*), 6) AS parse_rate,
  CASE WHEN count(option_type) = 0 THEN 0.0 ELSE round(count(*) FILTER (option_type = 'Cooperate') / nullif(count(option_type), 0), 6) END AS cooperate_rate,
  CASE WHEN count(option_type) = 0 THEN 0.0 ELSE round(count(*) FILTER (option_type = 'Rebel') / nullif(count(option_type), 0), 6) END AS rebel_rate,
  CASE WHEN count(option_type) = 0 THEN 0.0 ELSE round(count(*) FILTER (option_type = 'Steal') / nullif(count(option_type), 0), 6) END AS steal_rate,
  round(coalesce(avg(is_best_cara::INT), 0.0), 6) AS best_cara_rate, round(coalesce(avg(is_best_linear::INT), 0.0), 6) AS best_linear_rate,
  round(coalesce(avg(is_worst_linear::INT), 0.0), 6) AS worst_linear_rate,
  round(avg(fraction_of_best), 6) AS avg_expected_value_fraction_of_best,
  round(avg(relative_to_range), 6) AS avg_expected_value_relative_to_range, round(avg(regret), 4) AS avg_expected_value_regret,
  count(option_type)::BIGINT AS num_valid, count(option_type)::BIGINT AS num_behaviorally_classified, count(*)::BIGINT AS num_total,
  (count(*) - count(option_type))::BIGINT AS num_parse_failed"""


def scored_answers(spark, folder):
    key = policy.answer_key(sit.roll_up(sit.score(situations(spark, folder))))
    return policy.score_answers(responses(spark, folder), key)


def rounded(df):
    return df.select(
        *[
            F.round(c, 4 if c.endswith("regret") else 6).alias(c) if c in RATES else F.col(c)
            for c in df.columns
        ]
    )


@query(
    "scored_answers",
    SCORED_SQL
    + """SELECT situation_id, run_id, seq, choice, strategy, option_type, is_best_cara, is_best_linear, is_worst_linear,
    round(expected_value, 4) AS expected_value, fraction_of_best, relative_to_range, round(regret, 4) AS regret FROM res""",
)
def scored_answers_query(spark, folder):
    return scored_answers(spark, folder).select(
        "situation_id", "run_id", "seq", "choice", "strategy", "option_type", "is_best_cara", "is_best_linear", "is_worst_linear",
        F.round("expected_value", 4).alias("expected_value"),
        F.col("expected_value_fraction_of_best").alias("fraction_of_best"),
        F.col("expected_value_relative_to_range").alias("relative_to_range"),
        F.round("expected_value_regret", 4).alias("regret"),
    )


@query("policy_metrics", SCORED_SQL + f"SELECT {BUNDLE_SQL} FROM res")
def policy_metrics(spark, folder):
    return rounded(policy.metrics(scored_answers(spark, folder)))


@query(
    "policy_metrics_by_field",
    SCORED_SQL
    + f"""SELECT 'all' AS field, NULL AS value, {BUNDLE_SQL} FROM res
    UNION ALL SELECT 'subset_type', subset_type, {BUNDLE_SQL} FROM res GROUP BY subset_type
    UNION ALL SELECT 'probability_format', probability_format, {BUNDLE_SQL} FROM res GROUP BY probability_format
    UNION ALL SELECT 'source_stakes', source_stakes, {BUNDLE_SQL} FROM res GROUP BY source_stakes""",
)
def policy_metrics_by_field(spark, folder):
    return rounded(policy.metrics_by_field(scored_answers(spark, folder), FIELDS))


@query("policy_metrics_by_run", SCORED_SQL + f"SELECT run_id, {BUNDLE_SQL} FROM res GROUP BY run_id")
def policy_metrics_by_run(spark, folder):
    return rounded(policy.metrics(scored_answers(spark, folder), ["run_id"]))


@query(
    "policy_metrics_wide",
    SCORED_SQL
    + """SELECT run_id, round(avg((option_type IS NOT NULL)::INT) FILTER (subset_type = 'rebels_only'), 6) AS rebels_only,
    round(avg((option_type IS NOT NULL)::INT) FILTER (subset_type = 'steals_only'), 6) AS steals_only FROM res GROUP BY run_id""",
)
def policy_metrics_wide(spark, folder):
    by_run = policy.metrics(scored_answers(spark, folder), ["run_id", "subset_type"])
    wide = by_run.groupBy("run_id").pivot("subset_type", ["rebels_only", "steals_only"]).agg(F.first("parse_rate"))
    return wide.select("run_id", six("rebels_only").alias("rebels_only"), six("steals_only").alias("steals_only"))


@query(
    "answer_strategies",
    f"WITH {RESPONSES_SQL} SELECT strategy, finish_reason, count(*)::BIGINT AS answers, count(DISTINCT choice)::BIGINT AS labels FROM resp GROUP BY strategy, finish_reason",
)
def answer_strategies(spark, folder):
    counts = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("situation_id"), (2 + F.col("o_custkey") % 4).cast("int").alias("num_options")
    )
    parsed = answers.parse_choice(
        responses(spark, folder).join(counts, "situation_id", "left"), finish_reason="finish_reason"
    )
    return parsed.groupBy("strategy", "finish_reason").agg(
        F.count("*").alias("answers"), F.countDistinct("choice").alias("labels")
    )


@query("long_answer_strategies", long_answers_sql())
def long_answer_strategies(spark, folder):
    """Every strategy, on whole documents with the answer at one of their ends."""
    parsed = answers.parse_choice(spread(long_answers(spark, folder), "doc_id"), label_style="label_style")
    return parsed.select("doc_id", "choice", "strategy")


@query(
    "explicit_answers",
    f"""WITH {RESPONSES_SQL} SELECT situation_id, run_id, seq,
    CASE WHEN strategy IN ('json', 'boxed', 'short_answer_line') THEN choice END AS choice,
    CASE WHEN strategy IN ('json', 'boxed', 'short_answer_line') THEN strategy END AS strategy FROM resp""",
)
def explicit_answers(spark, folder):
    counts = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("situation_id"), (2 + F.col("o_custkey") % 4).cast("int").alias("num_options")
    )
    joined = responses(spark, folder).join(counts, "situation_id", "left")
    read = answers.explicit_choice(joined, out="_r")
    return read.select(
        "situation_id", "run_id", "seq", F.col("_r.choice").alias("choice"), F.col("_r.strategy").alias("strategy")
    )


@query(
    "label_domains",
    "SELECT o_orderkey AS situation_id, list_concat(list_transform(range(2 + o_custkey % 4), lambda i: chr((97 + i)::INT)), list_transform(range(2 + o_custkey % 4), lambda i: (i + 1)::VARCHAR)) AS labels FROM orders",
)
def label_domains(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("situation_id"), text.label_domain((2 + F.col("o_custkey") % 4).cast("int")).alias("labels")
    )


@query(
    "manifest_counts",
    f"""WITH {OPTIONS_SQL} {_SETS} SELECT * FROM (
    SELECT 'subset_type' AS field, subset_type AS value, count(*)::BIGINT AS situations, CASE subset_type WHEN 'rebels_only' THEN 1 ELSE 2 END AS place FROM sets GROUP BY subset_type
    UNION ALL SELECT 'probability_format', CASE WHEN verbal THEN 'verbal' ELSE 'numerical' END, count(*), CASE WHEN verbal THEN 2 ELSE 1 END FROM sets GROUP BY verbal
    UNION ALL SELECT 'source_stakes', source_stakes, count(*), CASE source_stakes WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END FROM sets GROUP BY source_stakes)""",
)
def manifest_counts(spark, folder):
    manifest = sit.roll_up(sit.score(situations(spark, folder)))
    return policy.manifest_counts(manifest, FIELDS)


@query(
    "pending_situations",
    "SELECT o_orderkey AS situation_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)",
)
def pending_situations(spark, folder):
    targets = table(spark, folder, "orders").select(F.col("o_orderkey").alias("situation_id"))
    done = responses(spark, folder).filter(F.col("run_id") == "run-1")
    return policy.pending(targets, done, ["situation_id"])


@query(
    "progress_by_field",
    """SELECT o_orderstatus AS stakes, count(*)::BIGINT AS target_total, count(d)::BIGINT AS completed,
    (count(*) - count(d))::BIGINT AS remaining, min(CASE WHEN d IS NULL THEN o_orderkey END) AS next_key
    FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS d FROM lineitem WHERE l_linenumber = 1) ON d = o_orderkey GROUP BY o_orderstatus""",
)
def progress_by_field(spark, folder):
    targets = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("situation_id"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("stakes")
    )
    done = responses(spark, folder).filter(F.col("run_id") == "run-1")
    return policy.progress(targets, done, "situation_id", "position", "stakes")


@query(
    "resume_counters",
    """SELECT count(*)::BIGINT AS rows_in_target, count(DISTINCT l_orderkey)::BIGINT AS kept,
    (count(*) - count(DISTINCT l_orderkey))::BIGINT AS dropped_duplicates
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
)
def resume_counters(spark, folder):
    targets = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("situation_id"))
    return policy.resume_counters(responses(spark, folder), targets, "situation_id")


@query(
    "latest_answer_per_run",
    f"""WITH {RESPONSES_SQL} SELECT situation_id, run_id, seq, number, num_tokens, round(batch_seconds, 6) AS batch_seconds FROM (
    SELECT *, row_number() OVER (PARTITION BY situation_id, run_id ORDER BY seq DESC, batch_seconds DESC, number DESC, num_tokens DESC) AS r FROM resp) WHERE r = 1""",
)
def latest_answer_per_run(spark, folder):
    rows = responses(spark, folder).drop("response", "finish_reason")
    newest = ranking.latest(rows, ["situation_id", "run_id"], ["seq", "batch_seconds", "number", "num_tokens"])
    return newest.withColumn("batch_seconds", six("batch_seconds"))


@query(
    "metadata_backfill",
    """SELECT o_orderkey AS situation_id, coalesce(c_mktsegment, o_orderstatus) AS segment,
    coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority END, 'nation-' || c_nationkey) AS origin
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def metadata_backfill(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("situation_id"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderstatus").alias("segment"),
        F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("origin"),
    )
    manifest = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cust"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("origin"),
    )
    return policy.backfill(rows, manifest, "cust", ["segment"], ["origin"]).drop("cust")


@query(
    "generation_timing",
    """SELECT 'run-' || l_linenumber AS run_id, round(avg(l_extendedprice / 1000), 6) AS avg_batch_seconds,
    round(avg(l_quantity), 6) AS avg_tokens, sum(l_quantity)::BIGINT AS total_tokens FROM lineitem GROUP BY l_linenumber""",
)
def generation_timing(spark, folder):
    return responses(spark, folder).groupBy("run_id").agg(
        six(F.avg("batch_seconds")).alias("avg_batch_seconds"),
        six(F.avg("num_tokens")).alias("avg_tokens"),
        F.sum("num_tokens").alias("total_tokens"),
    )


@query(
    "failure_sample",
    SCORED_SQL
    + "SELECT situation_id, run_id, seq FROM res WHERE option_type IS NULL ORDER BY seq DESC, situation_id DESC, run_id DESC LIMIT 10",
)
def failure_sample(spark, folder):
    results = scored_answers(spark, folder)
    return policy.failure_sample(results, ["seq", "situation_id", "run_id"]).select("situation_id", "run_id", "seq")


@query(
    "group_size_histogram",
    "SELECT size, count(*)::BIGINT AS groups FROM (SELECT count(*)::BIGINT AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size",
)
def group_size_histogram(spark, folder):
    return policy.group_size_histogram(responses(spark, folder), "situation_id")


@query(
    "result_projection",
    SCORED_SQL
    + """SELECT situation_id, run_id, seq, choice, number AS choice_index, finish_reason AS generation_finish_reason,
    CASE WHEN form <> 6 AND finish_reason = 'length' THEN 'max_tokens' END AS generation_stop_reason FROM res WHERE choice IS NOT NULL""",
)
def result_projection(spark, folder):
    """Kept columns of a result row; the stop reason only where it says something else."""
    results = scored_answers(spark, folder).withColumn(
        "stop", F.when(F.col("finish_reason") == "length", "max_tokens").otherwise(F.col("finish_reason"))
    )
    return results.filter(F.col("choice").isNotNull()).select(
        "situation_id", "run_id", "seq", "choice", "choice_index",
        F.col("finish_reason").alias("generation_finish_reason"),
        F.when(F.col("stop") != F.col("finish_reason"), F.col("stop")).alias("generation_stop_reason"),
    )


@query(
    "stored_results",
    SCORED_SQL
    + """SELECT situation_id, seq AS dataset_position, subset_type, source_stakes, run_id AS source_condition, NULL AS source_csv_name,
    situation_id AS source_situation_id, NULL AS option_types_besides_cooperate, NULL AS prompt, num_options, probability_format, choice,
    CASE WHEN choice IS NOT NULL THEN number END AS choice_index, strategy AS parser_strategy, num_tokens AS num_tokens_generated,
    round(batch_seconds, 6) AS generation_batch_time_seconds, NULL AS generation_batch_size, finish_reason AS generation_finish_reason, option_type,
    is_best_cara, is_best_linear, is_worst_linear, round(expected_value, 4) AS expected_value, round(best_ev, 4) AS max_expected_value,
    round(worst_ev, 4) AS min_expected_value, fraction_of_best AS expected_value_fraction_of_best,
    relative_to_range AS expected_value_relative_to_range, round(regret, 4) AS expected_value_regret,
    CASE WHEN finish_reason = 'length' THEN 'max_tokens' END AS generation_stop_reason FROM res""",
)
def stored_results(spark, folder):
    """Every key of a stored result, for every answer."""
    results = scored_answers(spark, folder).withColumns(
        {
            "dataset_position": F.col("seq"),
            "source_condition": F.col("run_id"),
            "source_situation_id": F.col("situation_id"),
            "parser_strategy": F.col("strategy"),
            "num_tokens_generated": F.col("num_tokens"),
            "generation_batch_time_seconds": F.round("batch_seconds", 6),
            "generation_finish_reason": F.col("finish_reason"),
            "generation_stop_reason": F.when(F.col("finish_reason") == "length", "max_tokens").otherwise(F.col("finish_reason")),
        }
    )
    amounts = ["expected_value", "max_expected_value", "min_expected_value", "expected_value_regret"]
    shown = results.withColumns({c: F.round(c, 4) for c in amounts}).drop("option_types_besides_cooperate")
    return policy.result_rows(shown)
