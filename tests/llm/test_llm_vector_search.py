"""Approximation files against plain search."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import folder_of, same_as_twin
from pyspark.sql import functions as F

from wagerframe.llm import vector_search as vs
from wagerframe.llm.registry import QUERIES, TWINS

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, is_query):
    """rows: (id, vector); Python integers throughout."""

    def whole(v):
        return [min(max(math.floor(256 * float(np.float32(x))), -(2**63)), 2**63 - 1) for x in v]

    usable = [
        (i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for qi, q in usable:
        if is_query(qi):
            scores = [(-max(min(sum(a * b for a, b in zip(q, v)), 2**63 - 1), -(2**63)), i) for i, v in usable if i != qi]
            out += [(qi, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def vectors(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(n)]


@pytest.mark.parametrize("bits", [1, 4, 6, 8])
def test_against_plain_search(spark, bits):
    rows = list(enumerate(vectors(400, 12, 5)))
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a group of copies
    rows += [(2000 + i, [x * 0.999 for x in rows[8][1]]) for i in range(5)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = vs.nearest(df, F.col("vec_id") % 7 == 0, k=4, bits=bits, block_rows=50, group_rows=20, shard_blocks=2, chunk=3)
    assert result(got) == plain(rows, 4, lambda i: i % 7 == 0)


def test_awkward_rows(spark):
    rows = list(enumerate(vectors(60, 5, 6)))
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [math.nan] * 5), (103, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    rows += [(None, [9.0] * 5), (104, []), (105, [3.0]), (106, [1.0] * 9), (107, [0.0] * 5), (108, [-0.0] * 5)]
    rows += [(5, rows[5][1])] * 7 + [(110, rows[5][1])] * 7 + [(5, rows[6][1])]  # repeated rows and ids
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 AS rank", "2 AS block", "3 AS id")
    got = vs.nearest(df, F.col("vec_id") % 5 == 0, k=3, block_rows=16, group_rows=4)
    assert result(got) == plain(rows, 3, lambda i: i % 5 == 0)


def test_huge_components(spark):
    rows = list(enumerate(vectors(20, 3, 7))) + [(50, [1e30, -1e30, 1.0]), (51, [3e10, 2e10, -1e10]), (52, [1e15, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = vs.nearest(df, F.lit(True), k=2, block_rows=8)
    assert result(got) == plain(rows, 2, lambda i: True)


def test_most_exact_vectors_are_never_read():
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 40, (4000, 32)).astype(np.int64)
    ids = np.arange(4000)
    kept = vs._enough(ids, rows, 5)
    assert len(kept) == 4000 and len(vs._enough(ids, np.zeros((4000, 3), np.int64), 5)) == 6
    base, span = rows.min(axis=0), rows.max(axis=0) - rows.min(axis=0) + 1
    width = -(-span >> 6)
    block = vs._header(ids, rows) | {"base": base.tobytes(), "width": width.tobytes()}
    block["cells"] = ((rows - base) // width).astype(np.uint8).tobytes()
    search = vs.Search({"group": 0} | vs._header(ids[:50], rows[:50]), 5)
    search.scan(block, 8)
    assert search.read < 0.02 * 50 * 4000
    truth = rows[:50] @ rows.T
    for i in range(50):
        truth[i, i] = np.iinfo(np.int64).min
        assert search.scores[i].tolist() == sorted(truth[i].tolist(), reverse=True)[:5]
    assert pa.types.is_int64(search.result().column("score").type)


def test_twin_on_own_table_and_no_rows(spark, tmp_path):
    rows = [(i, v, 0) for i, v in enumerate(vectors(160, 8, 8, 0.1))] + [(161, None, 0), (162, [math.nan] * 8, 1)]
    folder = folder_of(tmp_path, embeddings=spark.createDataFrame(rows, SCHEMA))
    same_as_twin(QUERIES["op13_vector_search"](spark, folder), TWINS["op13_vector_search"], folder, "embeddings")
    assert vs.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert vs.nearest(spark.createDataFrame(rows[:1], SCHEMA), F.lit(True)).count() == 0
