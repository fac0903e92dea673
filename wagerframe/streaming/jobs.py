"""Incremental scoring, running metrics and resume checks on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wagerframe.operators import policy, ranking
from wagerframe.sources.versions import BatchLog

# Settings that must agree between a stored run and its continuation.
RESUME_KEYS = [
    "model_path",
    "base_model",
    "backend",
    "num_shots",
    "system_prompt",
    "max_new_tokens",
    "disable_thinking",
    "temperature",
    "top_p",
    "top_k",
    "min_p",
    "seed",
    "dtype",
    "subjects",
    "max_eval_examples_per_subject",
    "dataset",
    "protocol",
]


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", per_batch: int = 16) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).parquet(folder)
    )


def score_batches(
    answers: DataFrame, key: DataFrame, results: str, checkpoint: str, finish_reason: str | None = "finish_reason"
) -> StreamingQuery:
    """Score new answers batch by batch and stop when the input is used up.

    Batches go to a ``BatchLog``: one that is replayed after a failure leaves the
    same rows, and the folders of many batches become one.
    """
    log = BatchLog(answers.sparkSession, results)

    def write(batch: DataFrame, batch_id: int) -> None:
        log.write(policy.score_answers(batch, key, finish_reason), batch_id)

    return answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_policy_sums(
    answers: DataFrame, key: DataFrame, dims: list[str], table: str, checkpoint: str, finish_reason: str | None = "finish_reason"
) -> StreamingQuery:
    """Score new answers batch by batch and keep only the additive state of their metrics.

    A batch adds one row per combination of ``dims`` to a ``BatchLog``, so a replay
    counts once and old batches become one set of sums. ``running_policy`` merges the states.
    """

    def merge(sums: DataFrame) -> DataFrame:
        return sums.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in sums.columns if c not in dims])

    log = BatchLog(answers.sparkSession, table, merge)

    def write(batch: DataFrame, batch_id: int) -> None:
        log.write(policy.partial_sums(policy.score_answers(batch, key, finish_reason), dims), batch_id)

    return answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_policy(spark: SparkSession, table: str, dims: list[str]) -> DataFrame:
    """The metric bundle over all batches so far."""
    return policy.merge_sums(BatchLog(spark, table).read(), dims)


def stored_results(spark: SparkSession, results: str) -> DataFrame:
    """All results that ``score_batches`` has stored."""
    return BatchLog(spark, results).read()


def read_results(spark: SparkSession, results: str, keys: list[str], sequence: list[str]) -> DataFrame:
    """Latest result per key over all batches."""
    return ranking.latest(stored_results(spark, results), keys, sequence)


def once_per_key(answers: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within the delay of its first row; state ages out."""
    return answers.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def state_rows(stream: StreamingQuery) -> int:
    """Rows of state that a stream holds after its newest batch."""
    progress = stream.lastProgress
    return sum(operator["numRowsTotal"] for operator in progress["stateOperators"]) if progress else 0


def running_sums(rows: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Counts and sums kept as state, so a batch costs its own rows only."""
    return rows.groupBy(*dims).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"))


def keep_running(sums: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Replace the small metrics table after every batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = sums.writeStream.outputMode("complete").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_batch(spark: SparkSession, table: str) -> DataFrame:
    """State after the newest batch."""
    rows = spark.read.parquet(table)
    newest = rows.agg(F.max("batch").alias("b"))
    return rows.join(newest, rows["batch"] == newest["b"], "left_semi").drop("batch")


def config_differences(stored: DataFrame, current: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Settings that differ between two one-row tables; nulls equal nulls."""
    keys = [k for k in (keys or RESUME_KEYS) if k in stored.columns or k in current.columns]

    def melted(df: DataFrame, side: str) -> DataFrame:
        cells = [
            F.struct(F.lit(k).alias("setting"), (F.col(k).cast("string") if k in df.columns else F.lit(None).cast("string")).alias(side))
            for k in keys
        ]
        known = [c for c in keys if c in df.columns]
        one = df.agg(F.count("*").alias("_n"), *[F.max(F.col(c).cast("string")).alias(c) for c in known])
        sure = one.filter(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"{side} settings must be one row"))))
        return sure.select(F.explode(F.array(*cells)).alias("c")).select("c.*")

    both = melted(stored, "stored").join(melted(current, "current"), "setting")
    return both.filter(~F.col("stored").eqNullSafe(F.col("current")))


def check_resume(stored: DataFrame, current: DataFrame, keys: list[str] | None = None) -> None:
    """Refuse to continue a run under other settings."""
    rows = config_differences(stored, current, keys).orderBy("setting").collect()
    if rows:
        raise ValueError("settings changed: " + "; ".join(f"{r.setting}: {r.stored} -> {r.current}" for r in rows))


def is_complete(ledger: DataFrame, sections: list[str]) -> bool:
    """A finished output has every required section filled."""
    if not set(sections) <= set(ledger.columns):
        return False
    filled = ledger.select(F.min(F.least(*[F.col(s).isNotNull() for s in sections], F.lit(True))).alias("ok")).first()
    return bool(filled["ok"])
