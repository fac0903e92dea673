"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import save, shared_folder


def digest_of(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, code points) of every row, plus ``_row``, a number of its own.

    The digest is SHA-256 of the text without the characters ``[\\x20\\x09-\\x0D]``;
    a null text counts as empty. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        digest_of(text).alias("digest"),
        F.char_length(text).alias("chars"),
        F.monotonically_increasing_id().alias("_row"),
    )


class DigestIndex:
    """Digests seen so far, as a Parquet table bucketed and sorted by digest.

    ``path`` holds the files and, in ``_buckets``, into how many buckets they are
    dealt, so that a later session opens the same index whatever its shuffle
    partitions; another count asked for, or declared by the catalog, is an error. A
    batch is deduplicated by a sort-merge anti-join: only the batch's digests
    are shuffled, the index is read bucket by bucket. Rows carry the name of
    their batch; giving a batch again (after a lost driver, say) finds its own
    digests in the index and decides as before.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._stored_buckets(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        if buckets and buckets != self.buckets:
            raise ValueError(f"{path} has {self.buckets} buckets, not {buckets}")
        self.table = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        told = {row["col_name"]: row["data_type"] for row in spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").collect()}
        if told.get("Num Buckets") != str(self.buckets):
            raise ValueError(f"{path} has {self.buckets} buckets, its table in the catalog {told.get('Num Buckets')}")

    def _stored_buckets(self, new: int) -> int:
        """The bucket count written beside the files; ``new`` is written where there are none yet."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        file = jvm.org.apache.hadoop.fs.Path(folder, "_buckets")
        if store.exists(file):
            stream = store.open(file)
            try:
                return stream.readInt()
            finally:
                stream.close()
        if store.exists(folder) and len(store.listStatus(folder)):
            raise ValueError(f"{self.path} has files, but no bucket count")
        stream = store.create(file, False)
        try:
            stream.writeInt(new)
        finally:
            stream.close()
        return new

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Decide every row of ``docs`` and append its new digests.

        Of equal texts the row with the most code points, then the smallest id
        (null last), stays, unless an earlier batch holds the digest. New digests are
        appended first; decisions are taken from the index as read back. Of repeated
        rows exactly one stays. Returns ``_id, digest, keep_id, group_size, kept``;
        ``group_size`` counts this batch. Very long texts are digested whole. An empty
        table gives an empty result.
        """
        rows = save(digests(docs, id_col, text_col), "digests")
        order = F.struct("chars", F.col("_id").isNotNull(), -F.coalesce("_id", F.lit(0)), -F.col("_row"))
        best = (
            rows.groupBy("digest")
            .agg(F.max_by(F.struct("_id", "_row"), order).alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("best._id").alias("keep_id"), F.col("best._row").alias("keep_row"), "group_size")
        )
        best = save(best, "digest-groups").repartition(self.buckets, "digest")
        fresh = best.join(self.entries().hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.insertInto(self.table)
        )
        entries = self.entries().select("digest", F.col("keep_id").alias("index_id"), "batch")
        best = best.join(entries.hint("merge"), "digest").select(
            "digest",
            F.col("index_id").alias("keep_id"),
            F.when(F.col("batch") == batch, F.col("keep_row")).alias("keep_row"),
            "group_size",
        )
        # Written, so that both sides of the join are exchanged and a digest of many rows can be split.
        best = save(best, "digest-decisions")
        return rows.join(best.hint("merge"), "digest").select(
            "_id",
            "digest",
            "keep_id",
            "group_size",
            F.coalesce(F.col("_row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        )


def drop_exact_copies(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Rows are found again by id and digest; rows equal in both collapse to one.
    """
    kept = index.ingest(docs, batch).filter("kept").select("_id", F.col("digest").alias("_digest"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("id"), text.alias("text"), digest_of(text).alias("digest"))
    return (
        rows.join(kept, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
        .groupBy("id", "digest")
        .agg(F.max_by("whole", F.char_length("text")).alias("whole"))
        .select("whole.*")
    )


@query(
    "op8_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS chars,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS place,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size
        FROM d
    )
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
    """,
)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    index = DigestIndex(spark, shared_folder(spark, "digest-index"))
    decided = index.ingest(table(spark, folder, "documents"), "documents")
    return decided.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )
