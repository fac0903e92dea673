"""Streams over the benchmark files, run to the end of the input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wagerframe.operators import policy
from wagerframe.operators import situations as sit
from wagerframe.plans.policy_queries import BUNDLE_SQL, SCORED_SQL, rounded
from wagerframe.plans.registry import query, table
from wagerframe.plans.views import answer_rows, situations
from wagerframe.session import save, shared_folder
from wagerframe.streaming import jobs


def workspace(spark) -> str:
    """A new folder for a stream's tables and state, shared by driver and executors."""
    return shared_folder(spark, "stream")


def finish(stream) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query("stream_scored_metrics", SCORED_SQL + f"SELECT {BUNDLE_SQL} FROM res")
def stream_scored_metrics(spark, folder):
    """Answers scored incrementally; metrics over the stored results."""
    place = workspace(spark)
    schema = table(spark, folder, "lineitem").schema
    incoming = answer_rows(jobs.read_files(spark, folder, schema, "lineitem.parquet"))
    # landed once: every micro-batch would otherwise score all situations again
    policy.answer_key(sit.roll_up(sit.score(situations(spark, folder)))).write.parquet(f"{place}/key")
    key = spark.read.parquet(f"{place}/key")
    finish(jobs.score_batches(incoming, key, f"{place}/results", f"{place}/checkpoint"))
    return rounded(policy.metrics(jobs.stored_results(spark, f"{place}/results")))


@query("stream_policy_by_run", SCORED_SQL + f"SELECT run_id, {BUNDLE_SQL} FROM res GROUP BY run_id")
def stream_policy_by_run(spark, folder):
    """Metrics per run from the sums that each batch of answers leaves."""
    place = workspace(spark)
    schema = table(spark, folder, "lineitem").schema
    incoming = answer_rows(jobs.read_files(spark, folder, schema, "lineitem.parquet"))
    key = save(policy.answer_key(sit.roll_up(sit.score(situations(spark, folder)))), "answer-key")
    finish(jobs.keep_policy_sums(incoming, key, ["run_id"], f"{place}/sums", f"{place}/checkpoint"))
    return rounded(jobs.running_policy(spark, f"{place}/sums", ["run_id"]))


@query(
    "stream_running_metrics",
    "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY event_type",
)
def stream_running_metrics(spark, folder):
    place = workspace(spark)
    schema = table(spark, folder, "events").schema
    rows = jobs.read_files(spark, folder, schema, "events.parquet")
    finish(jobs.keep_running(jobs.running_sums(rows, ["event_type"], "value"), f"{place}/metrics", f"{place}/checkpoint"))
    return jobs.latest_batch(spark, f"{place}/metrics").withColumn("total", F.round("total", 4))


@query("stream_once_per_key", "SELECT count(DISTINCT (user_id, event_type))::BIGINT AS n, true AS state_bounded FROM events")
def stream_once_per_key(spark, folder):
    """Distinct (run, metric) keys of a stream; the keys kept as state are at most those of the last two delays."""
    place = workspace(spark)
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = jobs.read_files(spark, folder, table(spark, folder, "events").schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    once = jobs.once_per_key(rows, ["user_id", "event_type"], "ts", "1 day").select("user_id", "event_type")
    stream = (
        once.writeStream.format("parquet").option("path", f"{place}/keys").option("checkpointLocation", f"{place}/checkpoint")
        .trigger(availableNow=True).start()
    )
    finish(stream)
    last = events.agg(F.max("ts") - F.expr("INTERVAL 2 DAYS")).scalar()
    recent = events.filter(F.col("ts") > last).agg(F.count_distinct("user_id", "event_type").alias("recent"))
    return (
        spark.read.parquet(f"{place}/keys")
        .agg(F.count("*").alias("n"))
        .withColumn("state_bounded", F.lit(jobs.state_rows(stream)) <= recent.scalar())
    )
