"""Best-two-fit packing of token sequences."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerframe.llm import vocabularies
from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import bounded_batches, save

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int, name: str, path: str | None, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids: whole documents, or full pieces after a first one that may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabularies.encoder(name, path)
        end = struct.pack("<I", end_id)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                total = len(ids) // 4
                begin, upto, piece = 0, (total - 1) % capacity + 1, 0
                while begin < total:
                    row = (doc_id, piece, begin, upto - begin, zlib.crc32(ids[4 * begin : 4 * upto]))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    begin, upto, piece = upto, upto + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def plan_bins(counts: np.ndarray, rounds: int = 8) -> list[tuple[int, list[int]]]:
    """Bin patterns (repeats, lengths) for ``counts[length]`` pieces; the capacity is the largest index.

    A bin starts with the longest piece left and is filled greedily, each time with
    the longest that fits its gap. Then its smallest piece is replaced by the two
    unpacked pieces that fill the gap it would leave most tightly, if they fill it
    better, and again while that helps (``rounds`` times at most). Work is on the
    histogram: a pattern is repeated as often as the counts allow, after which one
    of its lengths is short, so patterns are few, however many pieces there are.
    """
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    patterns = []
    longest = capacity
    while longest > 0:
        if not left[longest]:
            longest -= 1
            continue
        free = left.copy()
        items = [longest]
        free[longest] -= 1
        gap = capacity - longest
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            items.append(int(fits[-1]))
            free[fits[-1]] -= 1
            gap -= int(fits[-1])
        for _ in range(rounds):
            smallest = items[-1]  # items fall in length
            if gap == 0 or len(items) == 1:
                break
            room = gap + smallest
            values = np.flatnonzero(free[: room + 1])
            if not values.size:
                break
            # The best partner of each value is the longest free one in the room it leaves, not above it.
            at = np.searchsorted(values, np.minimum(room - values, values), side="right") - 1
            at = np.where((at >= 0) & (values[at] == values) & (free[values] < 2), at - 1, at)
            sums = np.where(at >= 0, values + values[at], 0)
            best = int(np.argmax(sums))
            if sums[best] <= smallest:
                break
            pair = [int(values[best]), int(values[at[best]])]
            free[smallest] += 1
            for length in pair:
                free[length] -= 1
            items = sorted([*items[:-1], *pair], reverse=True)
            gap = capacity - sum(items)
        use = Counter(items)
        repeats = min(int(left[length]) // n for length, n in use.items())
        for length, n in use.items():
            left[length] -= repeats * n
        patterns.append((repeats, items))
    return patterns


def slot_ranges(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, first bin, offset): rank r of a range lies in bin first + (r - first rank)."""
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: Counter = Counter()
    first_bin = 0
    for repeats, items in patterns:
        offset = 0
        for length in items:
            ranges.setdefault(length, []).append((next_rank[length], first_bin, offset))
            next_rank[length] += repeats
            offset += length
        first_bin += repeats
    return {length: np.asarray(rows, dtype=np.int64) for length, rows in ranges.items()}


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    name: str = "byte_bpe_50k.json",
    path: str | None = None,
    end_id: int = 0,
    buckets: int = 512,
) -> DataFrame:
    """Pack every row of ``docs`` into sequences of at most ``capacity`` tokens.

    The histogram of piece lengths, at most ``capacity`` numbers, is all that
    reaches the driver; bins are planned on it and pieces are placed by their rank
    among pieces of their length. Ranks come from counts per (length, hash bucket),
    so a length that most pieces have is numbered by ``buckets`` tasks.

    A null text is empty and gives the end id alone; null ids stay null; repeated
    rows are packed each; no rows give no rows. Other columns are not read.
    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    pieces = save(
        token_pieces(docs, capacity, name, path, end_id).withColumn(
            "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
        ),
        "pack-pieces",
    )
    per_bucket = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    ranges = slot_ranges(plan_bins(counts))

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = per_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        pieces.withColumn("in_bucket", F.row_number().over(inside))
        .join(first, ["length", "bucket"])
        .withColumn("rank", F.col("first") + F.col("in_bucket") - 1)
        .drop("bucket", "first", "in_bucket")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, lengths = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                rows = ranges[int(length)]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at] = rows[k, 1] + rank[at] - rows[k, 0]
                offset[at] = rows[k, 2]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
