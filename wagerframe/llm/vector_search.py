"""Exact top-k by inner product over vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import bounded_batches, save

#: Whole numbers up to here are exact in double precision; above, scores use Python's integers.
EXACT = 1 << 53
LONG = np.iinfo(np.int64)
FILE = "block long, n int, dims int, bound double, ids binary, exact binary, base binary, width binary, cells binary"
QUERIES = "group long, n int, dims int, bound double, ids binary, exact binary"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): components as ``floor(scale * x)``, of rows whose id and components are all there and finite."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))
    return rows.filter(usable).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows; shorter ones end in zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    dims = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    dims = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in parts])


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of about ``size`` rows at a time."""
    ids, parts, n = [], [], 0
    for batch in batches:
        if not len(batch):
            continue
        ids.append(batch.column("id").to_numpy())
        parts.append(_matrix(batch.column("v")))
        n += len(batch)
        if n >= size:
            yield np.concatenate(ids), _joined(parts)
            ids, parts, n = [], [], 0
    if n:
        yield np.concatenate(ids), _joined(parts)


def _enough(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Which rows can be among the first k of any query.

    Of equal vectors these are the rows of the k + 1 smallest ids (one may be the
    query's own) and of each id at most k rows, so copies do not fill a block.
    """
    order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids, kind="stable")
    sorted_ids, sorted_vectors = ids[order], vectors[order]
    new_vector = np.concatenate([[True], (sorted_vectors[1:] != sorted_vectors[:-1]).any(axis=1)])
    new_id = new_vector | np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]])
    place = np.arange(len(ids))
    ids_seen = np.cumsum(new_id)
    nth_id = ids_seen - np.maximum.accumulate(np.where(new_vector, ids_seen, 0)) + 1
    nth_row = place - np.maximum.accumulate(np.where(new_id, place, 0)) + 1
    return np.sort(order[(nth_id <= k + 1) & (nth_row <= k)])


def _header(ids: np.ndarray, vectors: np.ndarray) -> dict:
    bound = float(max(abs(int(vectors.min(initial=0))), int(vectors.max(initial=0))))
    kind = next(t for t, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", float("inf"))) if bound < most)
    return {
        "n": len(ids),
        "dims": vectors.shape[1],
        "bound": bound,
        "ids": ids.astype("<i8").tobytes(),
        "exact": vectors.astype(kind).tobytes(),
    }


def approximation_file(vectors: DataFrame, k: int, bits: int, block_rows: int) -> DataFrame:
    """Blocks of about ``block_rows`` vectors: ids, exact components, and each component's cell.

    A block cuts the range of each of its dimensions into ``2**bits`` cells of equal
    whole width; a cell is one byte.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for ids, rows in _portions(batches, block_rows):
            kept = _enough(ids, rows, k)
            ids, rows = ids[kept], rows[kept]
            row = {"block": number} | _header(ids, rows)
            if row["bound"] < EXACT:
                base = rows.min(axis=0) if rows.size else np.zeros(rows.shape[1], np.int64)
                span = rows.max(axis=0) - base + 1 if rows.size else np.ones(rows.shape[1], np.int64)
                width = -(-span >> bits) if rows.size else span
                row |= {"base": base.tobytes(), "width": width.tobytes(), "cells": ((rows - base) // width).astype(np.uint8).tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=FILE_ARROW)
            number += 1

    return vectors.mapInArrow(write, FILE)


FILE_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("n", pa.int32()),
        ("dims", pa.int32()),
        ("bound", pa.float64()),
        *((name, pa.binary()) for name in ("ids", "exact", "base", "width", "cells")),
    ]
)


def query_groups(vectors: DataFrame, group_rows: int) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("group", pa.int64()), *(FILE_ARROW.field(name) for name in ("n", "dims", "bound", "ids", "exact"))])
        for ids, rows in _portions(batches, group_rows):
            yield pa.RecordBatch.from_pylist([{"group": number} | _header(ids, rows)], schema=schema)
            number += 1

    return vectors.mapInArrow(write, QUERIES)


def _exact(row: dict) -> np.ndarray:
    kind = "<i2" if row["bound"] < 1 << 15 else "<i4" if row["bound"] < 1 << 31 else "<i8"
    return np.frombuffer(row["exact"], dtype=kind).reshape(row["n"], row["dims"])


class Search:
    """The best rows so far of every query of a group, kept while blocks pass by."""

    def __init__(self, group: dict, k: int):
        self.k, self.group, self.bound = k, group["group"], group["bound"]
        self.ids = np.frombuffer(group["ids"], dtype="<i8")
        self.vectors = _exact(group).astype(np.int64)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.ids)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.ids)
        self.read = 0

    def _take(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[i], scores]), np.concatenate([self.found[i], ids])
        # Bitwise inversion reverses the order without overflow at the smallest number.
        best = np.lexsort((ids, ~scores))[: self.k]
        self.scores[i], self.found[i] = scores[best], ids[best]

    def scan(self, block: dict, chunk: int) -> None:
        """Bound all scores by the cells, then read exact vectors, highest bound first, until the k-th is certain."""
        ids, rows = np.frombuffer(block["ids"], dtype="<i8"), _exact(block)
        dims = min(block["dims"], self.vectors.shape[1])
        vectors = self.vectors[:, :dims]
        if block["cells"] is None or self.bound * block["bound"] * max(dims, 1) * 4 >= EXACT:
            self._scan_wide(ids, rows[:, :dims], vectors)
            return
        base = np.frombuffer(block["base"], dtype=np.int64)[:dims]
        width = np.frombuffer(block["width"], dtype=np.int64)[:dims]
        cells = np.frombuffer(block["cells"], dtype=np.uint8).reshape(block["n"], block["dims"])[:, :dims]
        # Twice the centre of a cell and twice half its width are whole numbers.
        centres = 2 * (base + cells * width) + (width - 1)
        middle = vectors.astype(np.float64) @ centres.T.astype(np.float64)
        slack = np.abs(vectors) @ (width - 1)
        for i, own in enumerate(self.ids):
            upper = middle[i] + slack[i]
            other = ids != own
            known = self.scores[i][-1] * 2.0 if len(self.scores[i]) == self.k else -np.inf
            lower = (middle[i] - slack[i])[other]
            if len(lower) >= self.k:
                known = max(known, np.partition(lower, len(lower) - self.k)[len(lower) - self.k])
            open_rows = np.flatnonzero(other & (upper >= known))
            open_rows = open_rows[np.argsort(-upper[open_rows], kind="stable")]
            for begin in range(0, len(open_rows), chunk):
                if len(self.scores[i]) == self.k and upper[open_rows[begin]] < 2.0 * self.scores[i][-1]:
                    break
                at = open_rows[begin : begin + chunk]
                self.read += len(at)
                self._take(i, rows[at, :dims].astype(np.int64) @ vectors[i], ids[at])

    def _scan_wide(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        scores = vectors.astype(object) @ rows.T.astype(object) if vectors.shape[1] else np.zeros((len(vectors), len(rows)))
        scores = np.clip(scores, LONG.min, LONG.max).astype(np.int64)
        for i, own in enumerate(self.ids):
            other = ids != own
            self._take(i, scores[i][other], ids[other])

    def result(self) -> pa.RecordBatch:
        n = [len(s) for s in self.scores]
        number = np.repeat(np.arange(len(self.ids)), n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(sum(n), self.group)),
                pa.array(number),
                pa.array(np.repeat(self.ids, n)),
                pa.array(np.concatenate([*self.found, np.zeros(0, np.int64)])),
                pa.array(np.concatenate([*self.scores, np.zeros(0, np.int64)])),
            ],
            names=["group", "number", "query_id", "vec_id", "score"],
        )


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    bits: int = 6,
    block_rows: int = 4096,
    group_rows: int = 1024,
    shard_blocks: int = 4,
    chunk: int = 16,
) -> DataFrame:
    """The ``k`` rows of highest inner product for every row that ``is_query``, itself left out.

    Vectors count as whole numbers ``floor(scale * x)``. They are written once as an
    approximation file: blocks with a byte per component beside the exact numbers.
    Blocks are dealt to shards of ``shard_blocks``, groups of queries go to every
    shard. There, per block, one product with the cells' centres bounds the scores of
    a whole group from both sides; the k-th best lower bound, and the k-th best score
    of the blocks before, rule out most rows, and the others are read in the order of
    their upper bounds until the next bound lies below the k-th score. The k rows of
    each shard meet per query. Results are exact.

    Returns ``query_id, rank, vec_id, score``. Ties go to the smaller id. Rows whose
    id or vector is null, or that hold a null or non-finite component, take no part.
    Shorter vectors count as ending in zeros, empty ones score 0. Each row of a
    repeated id is a query and a candidate of its own; rows that share the query's id
    are not its candidates. Whole numbers beyond 64 bits, components or
    scores, count as the largest or smallest such number. Fewer candidates give fewer
    rows, no queries or no rows give none. Other columns are not read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    if not 1 <= bits <= 8:
        raise ValueError("bits must lie between 1 and 8")

    def packed(df: DataFrame, size: int) -> DataFrame:
        """Few rows in many partitions would make many small blocks; larger inputs stay as they are."""
        return df.coalesce(max(1, -(-df.count() // size)))

    vectors = whole_vectors(rows, id_col, vector_col, scale)
    asked = whole_vectors(rows.filter(is_query), id_col, vector_col, scale)
    blocks = save(approximation_file(packed(vectors, block_rows), k, bits, block_rows), "approximation-file")
    groups = save(query_groups(packed(asked, group_rows), group_rows), "query-groups")
    shards = max(1, -(-blocks.count() // shard_blocks))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: Search | None = None
        for batch in batches:
            for pair in batch.to_pylist():
                if running is None or running.group != pair["q"]["group"]:
                    if running is not None:
                        yield running.result()
                    running = Search(pair["q"], k)
                running.scan(pair["b"], chunk)
        if running is not None:
            yield running.result()

    to_all = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.struct(*groups.columns).alias("q"))
    dealt = blocks.select(F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard"), F.struct(*blocks.columns).alias("b"))
    pairs = to_all.join(dealt.hint("merge"), "shard").select("q", "b")
    best = pairs.mapInArrow(search, "group long, number long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("group", "number").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query(
    "op13_vector_search",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5
    """,
)
def op13_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
