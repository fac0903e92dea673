"""The pipeline against a brute-force version of what each stage must hold."""

from collections import Counter

import corpus_pipeline
import numpy as np
from helpers import SCHEMA, awkward_rows, empty, folder_of

from wagerframe.llm import mixing, quality, vocabularies
from wagerframe.llm.shared import save


def fixture_rows():
    rng = np.random.default_rng(4)
    rows = awkward_rows()
    for k in range(150):
        text = [f"s{k % 100}w{i}" for i in range(60 + k % 100)]  # every text of the last fifty is a longer or equal one again
        if k % 10 == 3:
            text[int(rng.integers(0, 60))] = "changed"
        rows.append((100 + k, " ".join(text), "en", f"src{k % 4}", 0))
    return rows


def test_stages_by_brute_force(spark, tmp_path):
    folder = folder_of(tmp_path, documents=spark.createDataFrame(fixture_rows(), SCHEMA))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.toPandas()
        docs = save(stage(spark, docs, folder), "test-pipeline")
        assert docs.columns == columns
        seen[name] = (before, docs.toPandas())
    before, after = seen["quality_rules"]
    kept = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).filter("kept").toPandas()
    ids = lambda df: Counter(map(str, df["doc_id"]))
    assert ids(after) == ids(kept) and len(after) < len(before)
    before, after = seen["exact_dedup"]
    bare = lambda t: "".join(t.split())
    assert Counter(after["text"].map(bare)) == Counter(set(before["text"].map(bare)))
    before, after = seen["near_dedup"]
    sets = {}
    for text in before["text"]:
        w = text.lower().split()
        sets[text] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    alike = lambda x, y: 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
    left = list(after["text"])
    assert all(not alike(x, y) for k, x in enumerate(left) for y in left[:k])
    groups: list[set] = []  # components by brute force
    for text in before["text"]:
        touched = [g for g in groups if any(alike(text, other) for other in g)]
        groups = [g for g in groups if g not in touched] + [set().union({text}, *touched)]
    assert len(left) == len(groups) < len(before)
    before, after = seen["mix_sources"]
    n = lambda text: len(text.split())
    taken = mixing.mix(save(spark.createDataFrame(before[columns]), "test-pipeline")).toPandas()
    assert after["text"].map(n).sum() == taken["taken"].sum() > 1.4 * before["text"].map(n).sum()
    whole = set(before["text"])
    assert sum(text not in whole for text in after["text"]) <= before["source"].nunique()

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    library = vocabularies.load("byte_bpe_50k.json", None)
    expected = Counter()
    for i, text in zip(after["doc_id"], after["text"]):
        expected[str(i)] += len(library.encode(text, add_special_tokens=False).ids) + 1
    found = Counter()
    for i, length in zip(packed["doc_id"], packed["length"]):
        found[str(i)] += int(length)
    assert {str(float(k)) if k != "nan" else k: v for k, v in found.items() if k != "<NA>"} == {
        str(float(k)) if k != "nan" else k: v for k, v in expected.items() if k != "<NA>"
    }
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_run_is_the_stages(spark, tmp_path):
    folder = folder_of(tmp_path, documents=spark.createDataFrame(fixture_rows(), SCHEMA))
    rows = corpus_pipeline.run(spark, folder).toPandas()
    assert len(rows) and (rows.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_empty_tables(spark, tmp_path):
    folder = folder_of(tmp_path, documents=empty(spark))
    assert corpus_pipeline.run(spark, folder).count() == 0


