"""Quotient filters by round trips; collocations in small blocks and many merges against the twin."""

import numpy as np
import pytest
from helpers import awkward_rows, folder_of, same_as_twin, words

from wagerframe.llm import collocations as co
from wagerframe.llm.registry import TWINS


@pytest.mark.parametrize("bits", [2, 14, 20, 22, 42])
def test_packed_phrases_are_permuted_without_loss(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << bits, 5000, dtype=np.uint64) for _ in range(3)]
    ids[2][:100] = 0
    half = 3 * bits // 2
    high, low = co.permute(*co.pack(ids, bits), half)
    assert int(high.max()) < 1 << half and int(low.max()) < 1 << half
    for ours, theirs in zip(co.unpack(*co.unpermute(high, low, half), bits), ids, strict=True):
        assert (ours == theirs).all()


@pytest.mark.parametrize("half", [3, 21, 32, 63])
def test_filters_keep_keys_and_counts(half):
    rng = np.random.default_rng(half)
    high = rng.integers(0, 1 << half, 3000, dtype=np.uint64)
    low = rng.integers(0, 1 << half, 3000, dtype=np.uint64)
    counts = rng.integers(1, 1 << 40, 3000)
    counts[:1000] = rng.integers(1, 300, 1000)
    plain = {}
    for h, lo, c in zip(high.tolist(), low.tolist(), counts.tolist(), strict=True):
        plain[h, lo] = plain.get((h, lo), 0) + c
    keys = co.summed(high, low, counts, half)
    found = co.decode(co.encode(*keys, half, half))
    assert list(zip(*(x.tolist() for x in found), strict=True)) == [(h, lo, c) for (h, lo), c in sorted(plain.items())]
    none = co.summed(high[:0], low[:0], None, half)
    assert len(co.decode(co.encode(*none, half, half))[0]) == 0
    once = co.summed(np.repeat(high[:50], 3), np.repeat(low[:50], 3), None, half)
    assert set(once[2].tolist()) >= {3} and once[2].sum() == 150


def corpus(spark):
    rows = [r[:3] for r in awkward_rows()]
    for i in range(40):
        rows.append((100 + i, f"New York City, {words(30, i)}. the end of the day; New York! The\tEnd of it", ("en", None, "und", "de")[i % 4]))
    rows += [(200, "x y " * 30 + "tie one . " * 20 + "tie two . " * 20, "fr"), (201, "Á é Á é. " * 15 + "\x1c \x1f", "fr")]
    rows += [(300, "very long text without a break " * 4000, "es")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("small", [{}, {"block_tokens": 50, "fan": 3, "most": 20, "step": 16}])
def test_against_twin(spark, tmp_path, small):
    docs = corpus(spark)
    folder = folder_of(tmp_path, documents=docs)
    clashing = docs.selectExpr("*", "1 AS score", "'x' AS word", "2 AS id", "3 AS block").repartition(5)
    same_as_twin(co.collocations(clashing, **small), TWINS["op12_collocations"], folder, "documents")


def test_places_are_cut_per_language(spark):
    docs = corpus(spark)
    whole = [tuple(r) for r in co.collocations(docs).orderBy("lang", "rank").collect()]
    three = [tuple(r) for r in co.collocations(docs, top=3, buckets=2).orderBy("lang", "rank").collect()]
    assert three == [r for r in whole if r[1] <= 3] and len(whole) > len(three)


def test_rows_without_words(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, " .,;\n", "de")], "doc_id long, text string, lang string")
    assert co.collocations(docs).count() == 0
