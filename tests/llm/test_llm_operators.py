"""The operators by brute force, round trips and accuracy, on awkward rows."""

import base64
import hashlib
import io
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from helpers import SCHEMA, awkward, awkward_rows, empty, folder_of, words
from pyspark.sql import functions as F

from wagerframe.llm import exact_dedup, language, mixing, near_dedup, packing, quality, sharding, token_counts, toxicity, vocabularies, warc
from wagerframe.llm.components import components
from wagerframe.llm.shared import shared_folder

CLASHING = ["digest", "size", "slot", "group", "salt", "rank", "bucket", "rep", "kept", "_id", "whole", "id", "n", "o", "hash", "chars"]


def clashing(df):
    return df.withColumns({c: F.lit("extra") for c in CLASHING})


# 1 WARC

PAGES = [
    (1, "http://a/x?y=1", "<p>one</p>"), (2, "http://a/\r\nInjected: yes", "<p>one</p>"), (3, None, None), (4, "http://b", ""),
    (5, "http://c", "é" * 70_000), (6, "http://c", "é" * 70_000), (7, "http://c", "Content-Length: 5\r\n\r\nx"), (None, "http://n", "<p>one</p>"),
    (8, "http://r", "r"), (8, "http://r", "r"),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = shared_folder(spark, "test-warc")
    manifest = warc.write_archives(warc.mark_revisits(clashing(pages)), folder, samples=2)
    found = warc.read_archives(manifest, folder, payloads=True).collect()
    assert len(found) == len(PAGES)
    least = {}
    for i, _, html in PAGES:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    by_id = {(i, u): (h or "") for i, u, h in PAGES}
    for r in found:
        assert r.problem is None
        html = next(h for (i, u), h in by_id.items() if i == r.page_id and (u or "").split("\r")[0] == (r.url or "").split("%0D")[0])
        payload = html.encode()
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = least[html]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.payload == (bytearray(payload) if r.record_type == "response" else None)


def test_warc_min_bytes_and_empty(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = Counter(r.record_type for r in warc.archive_pages(pages, shared_folder(spark, "test-warc"), min_bytes=1000).collect())
    assert kinds == {"response": 9, "revisit": 1}
    assert warc.archive_pages(pages.limit(0), shared_folder(spark, "test-warc")).count() == 0


def archive(*records: bytes, dictionary: bytes = b"") -> io.BytesIO:
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary, 3)
    for record in records:
        writer.add(record)
    out.seek(0)
    return out


def test_frames_and_dictionaries():
    records = [warc.page_record(k, f"http://h/{k}", b"payload %d " % k * 20, warc.base32_sha1(b"payload %d " % k * 20), None, "2020-01-01T00:00:00Z") for k in range(300)]
    dictionary = warc.train(records, 4096)
    assert list(warc.read_frames(archive(*records, dictionary=dictionary), chunk=7)) == records
    packed = zstandard.ZstdCompressor().compress(dictionary)  # the dictionary's frame may be compressed
    body = archive(*records, dictionary=dictionary).getvalue()[8 + len(dictionary) :]
    assert list(warc.read_frames(io.BytesIO(struct.pack("<II", 0x184D2A5D, len(packed)) + packed + body))) == records
    skipped = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert list(warc.read_frames(io.BytesIO(archive(*records[:2]).getvalue() + skipped))) == records[:2]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_frames(io.BytesIO(archive(*records).getvalue()[:-3])))
    with pytest.raises((ValueError, zstandard.ZstdError)):  # without its dictionary a frame cannot be read
        list(warc.read_frames(io.BytesIO(struct.pack("<II", 0x184D2A5D, 0) + body)))


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (lambda d: d.replace(b"WARC/1.1", b"WARC/9.9"), "version"),
        (lambda d: d.replace(b"WARC-Date", b"X-Date"), "missing header WARC-Date"),
        (lambda d: d.replace(b"WARC-Date: ", b"WARC-Date "), "malformed"),
        (lambda d: d.replace(b"WARC-Date", b"WARC-Type"), "repeated"),
        (lambda d: d + b"x", "Content-Length says"),
        (lambda d: d.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"), "digest"),
        (lambda d: d.replace(b"Content-Length: 3", b"Content-Length: 4"), "HTTP says"),
        (lambda d: d.replace(b"sha1:", b"sha2:"), "base32"),
        (lambda d: d.replace(b"<urn:page:1>", b"<urn:other:1>"), "is not a page"),
    ],
)
def test_broken_records(change, problem):
    record = warc.page_record(1, "http://h", b"abc", warc.base32_sha1(b"abc"), None, "2020-01-01T00:00:00Z")
    assert warc.page_of(*warc.parse_record(record))["payload"] == b"abc"
    with pytest.raises(ValueError, match=problem):
        warc.page_of(*warc.parse_record(change(record)))


# 2 sharding


def test_shards(spark):
    rows = [*awkward_rows(), *[(100 + k, words(k % 50), "en", "a", 0) for k in range(2000)]]
    found = sharding.shard_documents(clashing(spark.createDataFrame(rows, SCHEMA))).toPandas()
    assert len(found) == len(rows)
    sizes = Counter()
    for shard, part in found.groupby("shard"):
        assert sorted(part["place"]) == list(range(len(part)))
        sizes[shard] = part["size"].sum()
    assert set(sizes) == set(range(16))
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((None if i != i else int(i), s, c) for i, s, c in found[["doc_id", "size", "text_crc32"]].itertuples(index=False)) == expected
    # One text holds most bytes; the other shards still are nearly equal.
    rest = sorted(sizes.values())[:-1]
    assert rest[-1] - rest[0] <= 0.02 * rest[-1] + 400
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_slot_map_versions(spark):
    loads = spark.createDataFrame([(k, (k * 37) % 91, 1) for k in range(256)], "slot int, load long, n long")
    first = sharding.first_map(spark, 256, 4)
    edited = sharding.rebalance(first, loads, 4)
    held = {r.shard: r.load for r in edited.join(loads, "slot").groupBy("shard").agg(F.sum("load").alias("load")).collect()}
    assert edited.count() == 256 and max(held.values()) - min(held.values()) <= 3
    moved = first.join(edited.withColumnRenamed("shard", "now"), "slot").filter("shard <> now").count()
    assert 0 < moved < 64
    grown = {r.slot: r.shard for r in sharding.grow(edited, loads, 4).collect()}
    before = {r.slot: r.shard for r in edited.collect()}
    assert all(grown[s] in (before[s], 4) for s in before)
    share = sum((s * 37) % 91 for s in grown if grown[s] == 4) / sum((s * 37) % 91 for s in grown)
    assert 0.15 <= share <= 0.2
    maps = sharding.SlotMap(spark, shared_folder(spark, "test-map"))
    maps.store(0, first)
    assert maps.store(1, edited).count() == 256 and maps.load(0).filter("slot % 4 = shard").count() == 256


# 3 near duplicates


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is None:
            continue
        w = (t or "").encode().lower().split()
        got = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
        sets.setdefault(i, []).append(got)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    rows = awkward_rows()
    for g in range(12):  # groups of copies with more and more edits
        text = [f"g{g}t{k}" for k in range(60)]
        for k in range(12):
            copy = list(text)
            for at in rng.integers(0, 60, k // 3):
                copy[at] = f"edit{rng.integers(1 << 30)}"
            rows.append((1000 + 100 * g + k, " ".join(copy), "en", "a", 0))
    expected, sets = brute_components(rows)
    found = near_dedup.near_duplicates(clashing(spark.createDataFrame(rows, SCHEMA)), block_docs=5).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([*set(expected.values()), None, None])


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 50), (50, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, 101: 100, 200: 50, 300: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4 token counts and 7 packing

TEXTS = [
    "a  b", "a   b", " a", "a ", "a\n b", "foo\n \nbar", "x <|endoftext|> y", "it's they'll  OK 'S", "  a  b　", "", "   ", "\n\na b\n",
    "é́ \U0001f600x 12 3,4 é", "\t a", "a\t b c\r\n d", "x<|startoftext|>y <|ENDoftext|>", "ΣΑΣ İI ı ẞ ﬁ ǅ",
    "123 4½² x_y--'s", "\x00 a\x00b", "नमस्ते", "word*** !!a!! b%%%", "a \x1c\x1d z\x85q", "x" * 3000, None,
]


def test_encoder_equals_the_library():
    encoder = vocabularies.encoder("byte_bpe_50k.json", None)
    library = vocabularies.load("byte_bpe_50k.json", None)
    for text in [*TEXTS, *(t for _, t, *_ in awkward_rows())]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert encoder.encode(text or "") == np.asarray(ids, dtype="<u4").tobytes(), text


def test_encoder_tokenizes_letters_once_whatever_stands_around_them():
    encoder = vocabularies.Encoder(vocabularies.load("byte_bpe_50k.json", None))
    library, asked = encoder.tokenizer, []
    encoder._pre_token = lambda mapped, ask=encoder._pre_token: asked.append(mapped) or ask(mapped)
    texts = [f"so {word}{marks} {word}{marks}\n{word} {word}{marks}\n\n{word}" for word in ("quorble", "Zanthip") for marks in ("", ".", ",", "!)", "...")]
    for text in [*texts, "a.\n\r b", "a\n\tb c\n d", "it's\nit's 's\n's", "中,\né́ x_\n_y", "a\x85\nb"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.asarray(ids, dtype="<u4").tobytes(), text
    assert sum(a.endswith(("quorble", "Zanthip")) for a in asked) <= 4 + 2 * sum("\n\n" in t for t in texts)


@pytest.mark.parametrize("sizes", [{}, {"block_docs": 2, "hot_docs": 2, "spread": 2}, {"block_words": 5}])
def test_token_counts(spark, sizes):
    texts = [*TEXTS, *(t for _, t, *_ in awkward_rows())]
    library = vocabularies.load("word_bpe_49k.json", None)
    docs = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = token_counts.count_tokens(clashing(docs), **sizes).collect()
    expected = Counter()
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected[k if k % 7 else None, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(tuple(r) for r in found) == expected
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_copies_of_one_text_are_compared_with_their_hub(spark):
    rng = np.random.default_rng(8)
    base = words(120).split()
    rows = []
    for k in range(1200):  # near copies of one text, each with a word of its own somewhere
        text = list(base)
        text[int(rng.integers(len(text)))] = f"own{k}"
        rows.append((k, " ".join(text), "en", "s", 0))
    chain = list(base)
    for k in range(1200, 1230):  # a chain that leads away from the text: alike to its neighbours only
        chain[(k - 1200) * 4 : (k - 1200) * 4 + 2] = [f"c{k}", f"d{k}"]
        rows.append((k, " ".join(chain), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = near_dedup.near_duplicates(docs, block_docs=40).collect()
    whole = near_dedup.near_duplicates(docs, block_docs=5000).collect()
    assert sorted(tuple(r) for r in found) == sorted(tuple(r) for r in whole)
    assert sum(r.component_id == 0 for r in found) >= 1200
    large = spark.range(1200).select(F.lit(0).alias("hub"), F.col("id").alias("rep"), F.lit(30).alias("blocks"), (F.col("id") % 30).cast("int").alias("block"))
    assert near_dedup.star_placements(large).count() == 1200 + 30
    rests = spark.createDataFrame([(0, 1)], "hub int, rests int")
    assert near_dedup.rest_placements(large, large.filter("rep < 10"), rests).count() == 10 * 30 + 1200


def test_rare_pre_tokens_of_all_tasks_meet():
    rows = [(k, f"common common rare{k % 7} {words(3, k % 11)}") for k in range(400)]
    blocks = [token_counts.Block(n << 24, 0, 100, 1000, 64) for n in range(8)]
    for k, text in rows:
        blocks[k % 8].add(k, len(text), text.split())
    split = vocabularies.word_splitter("word_bpe_49k.json", None).split
    postings = [r for b in blocks for batch in b.batches(split) for r in batch.to_pylist() if r["token"] is not None]
    tokens, keys = {r["token"] for r in postings}, {(r["token"], r["salt"]) for r in postings}
    assert len(postings) > 3 * len(tokens) and len(keys) == len(tokens)


def test_packing(spark):
    library = vocabularies.load("byte_bpe_50k.json", None)
    rows = [*awkward_rows(), *[(1000 + k, words(k % 300), "en", "a", 0) for k in range(400)], ((1 << 60) + 1, "large id", None, None, 0)]
    found = packing.pack(clashing(spark.createDataFrame(rows, SCHEMA)), buckets=8)
    found = found.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).toPandas()
    expected = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[-1 if i is None else i, piece, a, b - a, zlib.crc32(np.asarray(ids[a:b], dtype="<u4").tobytes())] += 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(map(int, r)) for r in found[columns].itertuples(index=False)) == expected
    for _, part in found.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part["offset"]) == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 2048
    least = -(-found["length"].sum() // 2048)
    assert found["sequence_id"].nunique() <= least + 1
    assert packing.pack(empty(spark)).count() == 0


def test_best_two_fit():
    # 60 + 33 leaves 7; the 33 gives way to 25 + 15, which fill the bin.
    counts = np.bincount([60, 33, 25, 15], minlength=101)
    assert packing.plan_bins(counts) == [(1, [60, 25, 15]), (1, [33])]
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 2049, 20_000), minlength=2049)
    plan = packing.plan_bins(counts)
    used = np.zeros(2049, dtype=int)
    for repeats, items in plan:
        assert sum(items) <= 2048 and repeats > 0
        for length in items:
            used[length] += repeats
    assert (used == counts).all() and len(plan) < 4 * 2048
    assert sum(r for r, _ in plan) <= 1.01 * (counts * np.arange(2049)).sum() / 2048


# 5 languages and 6 toxicity


def test_languages(spark):
    rng = np.random.default_rng(5)
    stems = {"aa": ["ka", "ko", "ri"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oux", "ent"]}
    rows = []
    for k in range(600):
        lang = list(stems)[k % 3]
        text = " ".join("".join(rng.choice(stems[lang], 3)) for _ in range(1 + k % 20))
        rows.append((k, text, lang if k % 50 else None, "s", 0))
    odd = [(700, None, "aa", None, 0), (701, "", "bb", None, 0), (702, "123 !?", "cc", "s", 0), (None, "kakori", None, None, 0)]
    found = language.identify_languages(clashing(spark.createDataFrame(rows + odd, SCHEMA))).toPandas()
    truth = {k: list(stems)[k % 3] for k in range(600)}
    known = found[found["doc_id"].isin(list(truth))]
    assert (known["held_out"] == known["doc_id"].map(lambda k: zlib.crc32(str(int(k)).encode()) % 4 == 2)).all()
    held = known[known["held_out"]]
    assert (held["lang_pred"] == held["doc_id"].map(truth)).mean() > 0.97
    assert found["score"].between(0, 1).all()
    assert set(found[found["doc_id"].isin([700, 701, 702])]["lang_pred"]) == {"und"}
    assert language.identify_languages(empty(spark)).count() == 0
    blank = language.identify_languages(spark.createDataFrame([(1, "text", None, None, 0)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in blank] == [("und", 0.0)]


def test_temperature_and_sparsity():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    classes = np.asarray([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert abs(language.best_temperature(logits * 4, classes) - 4) < 0.4
    model = language.train(["kako rika"] * 30 + ["schung ein"] * 30, ["a"] * 30 + ["b"] * 30, np.ones(1 << language.BITS))
    assert 0 < np.count_nonzero(model.weights) < 0.01 * model.weights.size
    assert model.predict("rika") [0] == "a"


def test_rare_language_is_fitted():
    texts, labels = ["kako rika"] * 40 + ["schung ein"] * 40, ["a"] * 40 + ["b"] * 40
    first = int(np.random.Generator(np.random.PCG64(7)).permutation(81)[0])  # lies in a fifth drawn over all rows
    texts.insert(first, "zzyzx qvuq")
    labels.insert(first, "c")
    model = language.train(texts, labels, np.ones(1 << language.BITS))
    assert model.predict("zzyzx qvuq")[0] == "c"


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(800):
        bad = k % 4 == 0
        text = " ".join(f"word{rng.integers(300)}" .replace("0", "o").replace("1", "i") for _ in range(60)) + (" idiotic scum" if bad else "")
        rows.append((k, text, "en", "s", 0))
        labels.append((k, int(bad)))
    odd = [(900, None, None, None, 0), (901, "", None, None, 0), (None, "scum", None, None, 0)]
    marks = spark.createDataFrame([*labels, (900, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(clashing(spark.createDataFrame(rows + odd, SCHEMA)), marks).toPandas()
    assert len(found) == len(rows) + 3 and found["score"].between(0, 1).all()
    known = found[found["doc_id"].notna() & (found["doc_id"] < 800)]
    assert (known["held_out"] == known["doc_id"].map(lambda k: zlib.crc32(str(int(k)).encode()) % 5 == 0)).all()
    assert (known["predicted"] == (known["doc_id"] % 4 == 0)).all()
    assert found[found["doc_id"] == 901]["predicted"].tolist() == [0]
    assert toxicity.score_toxicity(empty(spark), marks).count() == 0


def test_counterfactual_penalty():
    texts = [f"the muslim {w} is an idiot" for w in ("man", "cook", "poet")] * 10 + [f"a fine {w} day" for w in ("sunny", "long", "warm")] * 10
    labels = [1] * 30 + [0] * 30
    gap = {}
    for penalty in (0.0, 5.0):
        model = toxicity.train(texts, labels, penalty=penalty)
        gap[penalty] = abs(model.logit({"the", "muslim", "cook"}) - model.logit({"the", "hindu", "cook"}))
        assert model.score("what an idiot") > 0.5
    assert gap[0.0] > 0.5 and gap[5.0] < 0.2 * gap[0.0]


def test_neutral_mentions_in_texts_without_terms(spark):
    # No text names a group, but toxic words share their beginnings with names of groups.
    rng = np.random.default_rng(4)
    other = lambda: " ".join(f"wo{'abcdefghij'[rng.integers(10)]}{'klmnopqrst'[rng.integers(10)]}rd" for _ in range(8))
    texts = [f"{other()} {w}!" for w in ("germanz", "muslimz", "christianz", "blackz") for _ in range(60)]
    texts += [other() for _ in range(400)]
    labels = [1] * 240 + [0] * 400
    clean = [other() for _ in range(50)]
    before, after = (toxicity.train(texts, labels, penalty=p) for p in (0.0, 1.0))
    assert before.pairs == after.pairs == len(toxicity.IDENTITY_TERMS) * 640
    assert toxicity.neutral_mention_errors(before, clean) > 0.02
    assert toxicity.neutral_mention_errors(after, clean) < 0.5 * toxicity.neutral_mention_errors(before, clean)
    hits = [after.score(f"{other()} {w}") > 0.5 for w in ("germanz", "muslimz", "christianz", "blackz") for _ in range(20)]
    assert np.mean(hits) > 0.95
    marks = spark.createDataFrame([(k, int(v)) for k, v in enumerate(labels)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert toxicity.learn_toxicity(docs, marks).pairs == before.pairs


# 8 exact copies


def test_digest_index(spark):
    docs = clashing(awkward(spark))
    path = shared_folder(spark, "test-index")
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    groups = defaultdict(list)
    for i, t, *_ in awkward_rows():
        groups[hashlib.sha256("".join((t or "").split(" ")).translate(str.maketrans("", "", "\t\n\x0b\x0c\r")).encode()).hexdigest()].append((i, t or ""))
    for _ in range(2):  # a batch given again is decided as before
        found = index.ingest(docs, "first").collect()
        assert len(found) == len(awkward_rows())
        for r in found:
            group = groups[r.digest]
            best = min(group, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
            assert (r.keep_id, r.group_size) == (best[0], len(group))
        assert Counter(r.digest for r in found if r.kept) == Counter(groups.keys())
        assert index.entries().count() == len(groups)
    later = spark.createDataFrame([(50, words(80), "en", "a", 0), (51, "new text", "en", "a", 0)], SCHEMA)
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    found = {r._id: r for r in again.ingest(later, "second").collect()}
    assert (found[50].keep_id, found[50].kept) == (3, False) and (found[51].keep_id, found[51].kept) == (51, True)
    assert again.entries().count() == len(groups) + 1
    assert index.ingest(empty(spark), "none").count() == 0


def test_index_under_other_shuffle_partitions(spark):
    path = shared_folder(spark, "test-index")
    docs = spark.createDataFrame([(k, f"text {k}", "en", "a", 0) for k in range(200)], SCHEMA)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        index = exact_dedup.DigestIndex(spark, path)
        assert index.ingest(docs, "first").filter("kept").count() == 200
        for n in ("4", "16"):
            spark.sql(f"DROP TABLE {index.table}")  # as in a session with a catalog of its own
            spark.conf.set("spark.sql.shuffle.partitions", n)
            again = exact_dedup.DigestIndex(spark, path)
            assert again.ingest(docs, f"copies at {n}").filter("kept").count() == 0
            assert again.buckets == 8 and again.entries().count() == 200
        with pytest.raises(ValueError, match="8 buckets"):
            exact_dedup.DigestIndex(spark, path, buckets=16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_decisions_come_from_the_index(spark):
    class Other(exact_dedup.DigestIndex):
        def entries(self):
            return super().entries().withColumn("keep_id", F.col("keep_id") + 1000)

    docs = spark.createDataFrame([(1, "a b", "en", "a", 0), (2, "ab", "en", "a", 0), (3, "c", "en", "a", 0)], SCHEMA)
    found = Other(spark, shared_folder(spark, "test-index"), buckets=4).ingest(docs, "first").collect()
    assert sorted((r._id, r.keep_id, r.group_size, r.kept) for r in found) == [(1, 1001, 2, True), (2, 1001, 2, False), (3, 1003, 1, True)]


def test_index_is_read_without_a_shuffle(spark):
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "test-index"), buckets=4)
    index.ingest(awkward(spark), "first")
    new = spark.createDataFrame([("x",)], "digest string").repartition(4, "digest")
    plan = new.join(index.entries().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_drop_exact_copies(spark):
    docs = clashing(awkward(spark))
    left = exact_dedup.drop_exact_copies(docs, exact_dedup.DigestIndex(spark, shared_folder(spark, "test-index")), "all")
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[3] == 1 and ids[1] == ids[2] == 0 and ids[12] == 1 and ids[7] == 1 and ids[5] == ids[6] == 0


# 9 quality


def test_statistics(spark):
    import re

    rows = [*awkward_rows(), (70, "a b c a b c a b", None, None, 0), (71, "x x x x", None, None, 0), (72, "p q r s p q r s\n\np q r s", None, None, 0)]
    found = quality.with_statistics(clashing(spark.createDataFrame(rows, SCHEMA)), "doc_id").collect()
    expected = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = list(zip(w, w[1:], w[2:]))
        times = Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if times[x] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        expected[i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)] += 1
    assert Counter(tuple(r) for r in found) == expected


def test_outliers(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(400):
        text = [f"w{rng.integers(1 << 30)}" for _ in range(rng.integers(60, 400))]
        if k % 20 == 0:
            text = [x + "***" for x in text]  # five per cent of the rows are full of symbols
        rows.append((k, " ".join(text), "en" if k % 3 else None, "big" if k % 4 else None, 0))
    rows += [(1000, rows[1][1], "xx", "alone", 0), (1001, None, "xx", "alone", 0)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(found) == len(rows)
    assert [i for i in range(400) if found[i].kept == (i % 20 == 0)] == []
    assert found[1000].kept and found[1001].base_failed and not found[1001].kept
    left = quality.drop_low_quality(docs)
    assert left.columns == docs.columns and left.count() == 381
    assert quality.judge(empty(spark)).count() == 0


def test_estimate_resists_outliers(spark):
    rng = np.random.default_rng(2)
    good = rng.multivariate_normal([100, 200, 300, 400], np.diag([400, 900, 400, 900]) * 100, 900)
    bad = rng.normal(9000, 10, (200, 4))  # would drag mean and covariance along
    rows = [("g", k % 16, *map(int, x)) for k, x in enumerate(np.vstack([good, bad]))]
    estimator = quality.Estimator(spark.createDataFrame(rows, "group string, salt int, x0 long, x1 long, x2 long, x3 long"))
    estimate = estimator.start()
    for _ in range(4):
        estimate = estimator.concentrate(estimate)
    row = estimate.first()
    assert all(abs(row[f"m{i}"] - m) < 60 for i, m in enumerate([100, 200, 300, 400]))


def test_copies_are_not_the_norm(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{rng.integers(1000, 10000)}" for _ in range(rng.integers(60, 200))), "en", "s", 0) for k in range(200)]
    junk = " ".join(f"#{k}" if k % 2 else f"word{k}" for k in range(100))
    rows += [(1000 + k, junk, "en", "s", 0) for k in range(100)]  # a third of the group
    docs = spark.createDataFrame(rows, SCHEMA)
    judged = quality.op9_quality_rules(spark, folder_of(tmp_path, documents=docs)).filter("kept")
    for left in (quality.drop_low_quality(docs), judged):
        ids = {r.doc_id for r in left.collect()}
        assert not [i for i in ids if i >= 1000] and len(ids) > 195


# 10 mixing


def test_targets(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1000), (None, 500), ("e", 0)]
    found = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long"), (5, 2, 1), 1.5, 2).collect()}
    goal, weight = 1.5 * 2510, {"a": 5, "b": 2, "c": 1, "e": 5, None: 2}
    size = dict(sizes)
    fixed: dict = {}
    while True:  # reshare until none is above its bound
        free = [s for s in weight if s not in fixed]
        rest = goal - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            break
        fixed |= {s: 2 * size[s] for s in over}
    assert found == pytest.approx(fixed | share)


def test_mix(spark):
    rows = [*awkward_rows(), *[(2000 + k, words(k % 90), "en", "src%d" % (k % 5), 0) for k in range(1500)]]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    found = mixing.mix(docs).toPandas()
    assert len(found) == len(rows) and (found["taken"] <= 2 * found["size"]).all()
    for _, part in found.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 150
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = lambda df: Counter(map(str, df.itertuples(index=False)))
    assert key(found) == key(again)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counted = mixed.select(mixing.n_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert counted == found["taken"].sum()
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("a", 0, 5.0), ("b", 1, 2.0), ("c", 2, 1.0)], "source string, place long, target double")
    found = mixing.schedule(targets, 800, chunk=50, cells=16).toPandas()
    counts = found.groupby("place")["rank"].agg(["count", "max"])
    assert counts["count"].sum() == 800 and (counts["max"] + 1 == counts["count"]).all()
    assert abs(counts["count"] - np.asarray([500, 200, 100])).max() <= 2
