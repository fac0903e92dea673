"""Importance resampling of documents towards the distribution of a target table."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import bounded_batches, save
from wagerframe.operators.ranking import dense_index

#: Words of a text in UTF-8 whose A-Z are lower case: every byte from 80 belongs to a character beyond ASCII.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
NO_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")


def _words(text: bytes, step: int) -> Iterator[list[bytes]]:
    """The words of a text in pieces of about ``step`` bytes, which bounds the memory of very long texts."""
    text = text.lower()
    begin = 0
    while begin < len(text):
        cut = NO_WORD.search(text, begin + step) if begin + step < len(text) else None
        end = cut.start() if cut else len(text)
        yield WORD_BYTES.findall(text, begin, end)
        begin = end


def feature_buckets(text: bytes, buckets: int, longest: int, step: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """Per piece of a text its number of words and the buckets of the features that end in it.

    The checksum of a run continues that of the run without its last word, so no
    run of words is ever joined.
    """
    carried: list[bytes] = []
    for new in _words(text, step):
        words = carried + new
        known = len(carried)
        sums = list(map(crc32, words))
        found = [sums[known:]]
        spaced = [b" " + w for w in words]
        for n in range(2, longest + 1):
            sums = list(map(crc32, spaced[n - 1 :], sums))
            found.append(sums[max(0, known - n + 1) :])
        whole = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=sum(map(len, found)))
        yield len(new), whole % np.uint32(buckets)
        carried = words[-(longest - 1) :] if longest > 1 else []


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How many features of all rows fall into each bucket; one row per task and bucket is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            waiting, size = [], 0
            for text in batch.column(0).to_pylist():
                for _, found in feature_buckets(text, buckets, longest):
                    waiting.append(found)
                    size += len(found)
                    if size > 1_000_000:
                        sums += np.bincount(np.concatenate(waiting), minlength=buckets)
                        waiting, size = [], 0
            if waiting:
                sums += np.bincount(np.concatenate(waiting), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    texts = docs.filter(F.col(text_col).isNotNull()).select(F.encode(text_col, "UTF-8").alias("text"))
    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    sums = np.zeros(buckets, dtype=np.int64)
    for row in found.collect():  # one row per bucket, whatever the input
        sums[row["bucket"]] = row["n"]
    return sums


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of the smoothed bucket frequencies, rounded down."""
    buckets = len(source)
    ratio = (target + 1.0) * float(source.sum() + buckets) / ((source + 1.0) * float(target.sum() + buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """Whole thousandths of a Gumbel draw from a digest of (seed, id); a null id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _literal(key: Row, rows: DataFrame) -> Column:
    return F.struct(*[F.lit(v).cast(rows.schema[name].dataType).alias(name) for name, v in key.asDict().items()])


def kth_smallest(rows: DataFrame, keys: list[str], k: int, pivots: int = 63) -> Row | None:
    """The k-th smallest composite key (from 1), or null where there are fewer rows.

    Quickselect: each round draws ``pivots`` keys at random (by a hash of the key
    and the round), counts exactly how many rows lie below, at and between them, and
    keeps the open interval that holds the k-th key, written apart. It ends when a
    pivot is that key, after about log(rows) / log(pivots) rounds. Only pivots and
    their counts reach the driver. Key columns hold no nulls; equal keys share a place.
    """
    key = F.struct(*keys)
    active = rows.select(*keys)
    for turn in itertools.count():
        drawn = active.orderBy(F.xxhash64(F.lit(turn), *keys), *keys).limit(pivots).collect()
        chosen = sorted(set(drawn))
        if not chosen:
            return None
        # Cell 2i lies before pivot i, cell 2i + 1 is the pivot itself.
        cell = F.lit(0)
        bounds = [_literal(pivot, rows) for pivot in chosen]
        for bound in bounds:
            cell = cell + F.when(key > bound, 2).when(key == bound, 1).otherwise(0)
        counts = dict.fromkeys(range(2 * len(chosen) + 1), 0)
        counts |= {row["cell"]: row["n"] for row in active.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
        for at in sorted(counts):
            if k <= counts[at]:
                break
            k -= counts[at]
        else:
            return None
        if at % 2:
            return chosen[at // 2]
        inside = F.lit(True)
        if at > 0:
            inside = inside & (key > bounds[at // 2 - 1])
        if at < 2 * len(chosen):
            inside = inside & (key < bounds[at // 2])
        active = save(active.filter(inside), "select-interval")
    return None


#: Higher scores first, then smaller ids (null last); the row's own number tells equal rows apart.
KEYS = ["_worse", "_no_id", "_id", "_row"]


def importance_scores(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10_000,
    longest: int = 3,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Weight and perturbed score of every row of ``docs``.

    Features are the runs of 1 to ``longest`` words of a text, hashed into
    ``buckets``. Both tables are counted over whole texts; a row's weight is the sum
    of its buckets' gains, read from one array of ``buckets`` numbers (80 KB at
    10,000), the only thing that is sent to all tasks.

    Returns ``doc_id, fingerprint, n_words, n_features, weight, score``. A null or
    empty text has no features and weight 0; a null id is scored as the empty text;
    repeated rows are scored each; an empty ``target`` makes all gains those of
    smoothing alone; no rows give no rows. Other columns are not read. Long texts are
    read in pieces of 1 MB.
    """
    bounded_batches(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = features = weight = 0
                for n, found in feature_buckets(text, buckets, longest):
                    words += n
                    features += len(found)
                    weight += int(gains[found].sum())
                rows.append((words, features, weight))
            counted = np.array(rows, dtype=np.int64).reshape(-1, 3)
            columns = [batch.column("doc_id"), batch.column("fingerprint"), *(pa.array(counted[:, i]) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint", "n_words", "n_features", "weight"])

    text = F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("fingerprint"), text.alias("text"))
        .mapInArrow(weigh, "doc_id long, fingerprint long, n_words long, n_features long, weight long")
        .withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))
    )


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, pivots: int = 63, **parameters
) -> DataFrame:
    """Draw ``percent`` of the rows of at least ``min_words`` words, without replacement, by importance.

    Adding Gumbel noise to log weights and taking the highest sums draws rows
    with chances in proportion to their weights. The lowest sum drawn is found by
    ``kth_smallest`` on slim keys that are written once; rows above it are the only
    ones sorted. Ties go to smaller ids, null ids last; of rows equal in both, as
    many as are due are drawn. Returns the columns of ``importance_scores`` and
    ``rank``, from 1, null for rows not drawn; see there for nulls, empty texts and tables.
    """
    scored = save(
        importance_scores(docs, target, **parameters).select(
            "*",
            (-F.col("score")).alias("_worse"),
            F.col("doc_id").isNull().alias("_no_id"),
            F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "resampling-scores",
    )
    able = F.col("n_words") >= min_words
    k = percent * scored.filter(able).count() // 100
    last = kth_smallest(scored.filter(able), KEYS, k, pivots) if k else None
    drawn = able & (F.struct(*KEYS) <= _literal(last, scored)) if last is not None else F.lit(False)
    winners = dense_index(scored.filter(drawn), [F.col(c) for c in KEYS], "rank")
    losers = scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return winners.unionByName(losers).drop(*KEYS)


def resampled_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The drawn rows of ``docs`` with their own columns, and ``draw_rank`` beside them.

    Rows are found again by id and a hash of the text; repeats of a row are drawn as often as due.
    """
    won = importance_resample(docs, target, id_col=id_col, text_col=text_col, **parameters).filter("rank IS NOT NULL")
    same = Window.partitionBy("_id", "_print")
    won = won.select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_print"), "rank")
    won = save(won.withColumn("_copy", F.row_number().over(same.orderBy("rank"))), "resampling-drawn")
    rows = docs.select(F.struct("*").alias("whole"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("print"))
    met = F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print"))
    found = rows.join(won.select("_id", "_print").distinct(), met, "left_semi")
    found = found.withColumn("copy", F.row_number().over(Window.partitionBy("id", "print").orderBy(F.xxhash64("whole"))))
    return found.join(won, met & (F.col("copy") == F.col("_copy"))).select("whole.*", F.col("rank").alias("draw_rank"))


@query("op11_importance_resampling")
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
