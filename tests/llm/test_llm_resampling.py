"""Importance resampling against a plain version, and quickselect against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from helpers import awkward, awkward_rows, empty, folder_of, words

from wagerframe.llm.resampling import feature_buckets, importance_resample, kth_smallest, op11_importance_resampling, resampled_documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(low)
    return len(found), [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(rows, targets, percent=5, min_words=20):
    """rows: (doc_id, text); every step as the definition states it."""
    s = Counter(bucket(f) for _, text in rows for f in features(text)[1])
    t = Counter(bucket(f) for text in targets for f in features(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))

    out = []
    for doc_id, text in rows:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, n >= min_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def benchmark(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def result(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_buckets_do_not_depend_on_pieces():
    text = ("Ab é " + words(300) + "--x.y ").encode()
    whole = [b for _, found in feature_buckets(text, 10_000, 3) for b in found.tolist()]
    for step in (1, 7, 100):
        parts = list(feature_buckets(text, 10_000, 3, step))
        assert sorted(b for _, found in parts for b in found.tolist()) == sorted(whole)
        assert sum(n for n, _ in parts) == features(text.decode())[0]
    assert sorted(whole) == sorted(bucket(f) for f in features(text.decode())[1])


def test_query_on_awkward_rows(spark, tmp_path):
    targets = [words(60), None, "", words(30, 500, "q"), "é ß THEY"]
    folder = folder_of(tmp_path, documents=awkward(spark), benchmark=benchmark(spark, targets))
    got = result(op11_importance_resampling(spark, folder))
    assert got == plain([(r[0], r[1]) for r in awkward_rows()], targets)


def test_draw_of_half_with_ties_copies_and_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(i, words(rng.randrange(15, 60), rng.randrange(5))) for i in range(60)]
    rows += [(7, rows[7][1])] * 9 + [(None, rows[3][1])] * 9  # equal in score and id
    docs = spark.createDataFrame([(t, i, "x", 0) for i, t in rows], "text string, doc_id long, score string, rank int")
    targets = [words(40)]
    got = importance_resample(docs, benchmark(spark, targets), percent=50, pivots=3)
    assert result(got) == plain(rows, targets, percent=50)
    drawn = resampled_documents(docs, benchmark(spark, targets), percent=50)
    assert drawn.columns == ["text", "doc_id", "score", "rank", "draw_rank"]
    expected = sorted((r[4], str(r[0])) for r in plain(rows, targets, percent=50) if r[4])
    found = sorted((r.draw_rank, str(r.doc_id)) for r in drawn.collect())
    assert [r for r, _ in found] == list(range(1, len(expected) + 1)) and found == expected


def test_empty_tables(spark, tmp_path):
    folder = folder_of(tmp_path, documents=empty(spark), benchmark=benchmark(spark, ["a b c"]))
    assert op11_importance_resampling(spark, folder).count() == 0
    rows = [(i, words(25, i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(importance_resample(docs, benchmark(spark, []), percent=10)) == plain(rows, [], percent=10)


def test_quickselect_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-50, 50), rng.randrange(3)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a long, b long")
    ordered = sorted(rows)
    for k in (1, 2, 999, 1000, 2000):
        assert tuple(kth_smallest(df, ["a", "b"], k, pivots=5)) == ordered[k - 1]
    assert kth_smallest(df, ["a", "b"], 2001, pivots=5) is None
