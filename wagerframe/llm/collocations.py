"""Collocations: phrases counted in quotient filters, scored by their weakest cut."""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import bounded_batches, save
from wagerframe.llm.token_counts import Numbered
from wagerframe.operators.ranking import dense_index

#: Phrases have at most three words; two is the fewest.
LONGEST = 3
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
FOLD = bytes.maketrans(UPPER + SEPARATORS + b"\t", UPPER.lower() + b"." * len(SEPARATORS) + b" ")
CUT = re.compile(rb"[ .]")

# --- blocks of texts as streams of numbers -------------------------------------

BLOCKS = "block long, lang string, context int, width int, n_words long, stream binary, words array<string>, counts array<long>"
BLOCKS_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("lang", pa.string()),
        ("context", pa.int32()),
        ("width", pa.int32()),
        ("n_words", pa.int64()),
        ("stream", pa.binary()),
        ("words", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int64())),
    ]
)


def _tokens(text: bytes, step: int) -> Iterator[list[bytes]]:
    """Words and breaks (``.``) of a text, in pieces of about ``step`` bytes."""
    text = text.translate(FOLD)
    begin = 0
    while begin < len(text):
        cut = CUT.search(text, begin + step) if begin + step < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[begin:end].replace(b".", b" . ").split()
        begin = end


def _low_bytes(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _from_bytes(data: memoryview, n: int, bits: int) -> np.ndarray:
    whole = np.zeros((n, 8), dtype=np.uint8)
    width = -(-bits // 8)
    whole[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width).reshape(n, width)
    return whole.view("<u8").reshape(n).astype(np.uint64)


class Block:
    """Words of one language, numbered as they come; 0 is a break.

    The first ``context`` numbers repeat the end of the block before, where a
    piece goes on across the border: phrases that end in them are counted there.
    """

    def __init__(self, lang: str, context: list[bytes] = ()):
        self.lang = lang
        self.index = Numbered({b".": 0})
        self.stream = array("I", map(self.index.__getitem__, context))
        self.context = len(context)

    def row(self, number: int) -> pa.RecordBatch:
        stream = np.frombuffer(self.stream, dtype=np.uint32)
        counts = np.bincount(stream[self.context :], minlength=len(self.index))[1:]
        width = max(1, -(-len(self.index).bit_length() // 8))
        words = pa.array([list(self.index)[1:]], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        columns = [
            pa.array([number], pa.int64()),
            pa.array([self.lang], pa.string()),
            pa.array([self.context], pa.int32()),
            pa.array([width], pa.int32()),
            pa.array([int(counts.sum())], pa.int64()),
            pa.array([_low_bytes(stream, 8 * width)], pa.binary()),
            words,
            pa.array([counts], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=BLOCKS_ARROW)


def text_blocks(docs: DataFrame, block_tokens: int, step: int) -> DataFrame:
    """The texts of each language as blocks of about ``block_tokens`` words and breaks."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        opened: dict[str, Block] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                block = opened.setdefault(lang, Block(lang))
                recent: list[bytes] = []
                for tokens in _tokens(text, step):
                    if len(block.stream) >= block_tokens:
                        yield block.row(number)
                        number += 1
                        block = opened[lang] = Block(lang, recent)
                    block.stream.extend(map(block.index.__getitem__, tokens))
                    recent = (recent + tokens)[1 - LONGEST :]
                block.stream.append(0)
                if len(block.stream) >= block_tokens or sum(len(b.stream) for b in opened.values()) >= 2 * block_tokens:
                    for full in opened.values():
                        yield full.row(number)
                        number += 1
                    opened.clear()
        for block in opened.values():
            yield block.row(number)
            number += 1

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.encode("text", "UTF-8").alias("text"))
    return texts.filter("text IS NOT NULL").mapInArrow(blocks, BLOCKS)


# --- packed phrases and their permutation --------------------------------------

#: Round keys and multipliers of the permutation; any odd multipliers will do.
ROUND_KEYS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def id_bits(words: int) -> int:
    """Even number of bits that holds ids from 1 to ``words`` and 0."""
    bits = max(2, words.bit_length())
    return bits + bits % 2


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _scramble(values: np.ndarray, key: int, half: int) -> np.ndarray:
    mixed = (values ^ np.uint64(key)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(32)
    mixed *= MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    return mixed & _mask(half)


def pack(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Three ids of ``bits`` bits as two halves of 3 * bits / 2 bits each."""
    first, second, third = ids
    cut = np.uint64(bits // 2)
    high = (first << cut) | (second >> cut)
    low = ((second & _mask(bits // 2)) << np.uint64(bits)) | third
    return high, low


def unpack(high: np.ndarray, low: np.ndarray, bits: int) -> list[np.ndarray]:
    cut = np.uint64(bits // 2)
    second = ((high & _mask(bits // 2)) << cut) | (low >> np.uint64(bits))
    return [high >> cut, second, low & _mask(bits)]


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel permutation of the pairs of ``half``-bit numbers: no two phrases meet in one key."""
    for key in ROUND_KEYS:
        high, low = low, high ^ _scramble(low, key, half)
    return high, low


def unpermute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for key in reversed(ROUND_KEYS):
        high, low = low ^ _scramble(high, key, half), high
    return high, low


def summed(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in ascending order with the sums of their counts (1 each where none are given)."""
    n, order = len(high), None
    if not n:
        return high, low, np.zeros(0, np.int64)
    if 2 * half <= 64:
        keys = (high << np.uint64(half)) | low
        if counts is None:
            keys.sort()
        else:
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        high, low = keys[starts] >> np.uint64(half), keys[starts] & _mask(half)
    else:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        starts = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
        high, low = high[starts], low[starts]
    return high, low, np.diff(np.append(starts, n)) if counts is None else np.add.reduceat(counts[order], starts)


# --- counting quotient filters ---------------------------------------------------

HEADER = struct.Struct("<QQQBBB")


def encode(high: np.ndarray, low: np.ndarray, counts: np.ndarray, high_bits: int, low_bits: int) -> bytes:
    """A counting quotient filter of ascending keys (high, low).

    The quotient is the first bits of a key, about one value per key: a bit per
    quotient tells whether it is occupied and a bit per key whether its run ends
    there, so the quotient itself is not stored. The remainder is stored in full. A bit
    per key tells counters above 1, which have one byte each, and eight more from 255 on.
    Nothing is lost.
    """
    n = len(high)
    q = min(high_bits, max(n, 1).bit_length())
    rest = high_bits - q
    quotients = (high >> np.uint64(rest)).astype(np.int64)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotients] = True
    ends = np.concatenate([quotients[1:] != quotients[:-1], [True]]) if n else np.zeros(0, bool)
    several = counts > 1
    more = counts[several]
    large = more[more >= 255].astype("<u8")
    parts = [
        HEADER.pack(n, len(more), len(large), q, high_bits, low_bits),
        np.packbits(occupied).tobytes(),
        np.packbits(ends).tobytes(),
        _low_bytes(high & _mask(rest), rest),
        _low_bytes(low, low_bits),
        np.packbits(several).tobytes(),
        np.minimum(more, 255).astype(np.uint8).tobytes(),
        large.tobytes(),
    ]
    return b"".join(parts)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (high, low), ascending, and counts of a filter."""
    n, n_more, n_large, q, high_bits, low_bits = HEADER.unpack_from(data)
    rest = high_bits - q
    view = memoryview(data)[HEADER.size :]

    def take(size: int) -> memoryview:
        nonlocal view
        part, view = view[:size], view[size:]
        return part

    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(take(-(-(1 << q) // 8)), np.uint8), count=1 << q))
    ends = np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8), count=n).astype(np.int64)
    quotients = occupied[np.cumsum(ends) - ends].astype(np.uint64)
    high = (quotients << np.uint64(rest)) | _from_bytes(take(n * -(-rest // 8)), n, rest)
    low = _from_bytes(take(n * -(-low_bits // 8)), n, low_bits)
    several = np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8), count=n).astype(bool)
    more = np.frombuffer(take(n_more), np.uint8).astype(np.int64)
    more[more == 255] = np.frombuffer(take(8 * n_large), "<u8").astype(np.int64)
    counts = np.ones(n, np.int64)
    counts[several] = more
    return high, low, counts


FILTERS = "shard long, part long, filter binary"


def _filters(part: int, shard: int, keys: tuple, high_bits: int, split: int, half: int) -> pa.Table:
    """One filter per value of the next ``split`` bits of ascending keys of a shard."""
    high, low, counts = keys
    prefix = (high >> np.uint64(high_bits - split)).astype(np.int64)
    borders = np.searchsorted(prefix, np.arange((1 << split) + 1))
    inside = high & _mask(high_bits - split)
    shards, blobs = [], []
    for k in range(1 << split):
        begin, end = borders[k], borders[k + 1]
        if end > begin:
            shards.append((shard << split) | k)
            blobs.append(encode(inside[begin:end], low[begin:end], counts[begin:end], high_bits - split, half))
    return pa.table({"shard": pa.array(shards, pa.int64()), "part": pa.array([part] * len(shards), pa.int64()), "filter": pa.array(blobs, pa.binary())})


def _block_filters(bits: int, split: int, part: int = 1 << 18) -> Callable[[pa.Table, pa.Table], pa.Table]:
    half = 3 * bits // 2

    def build(blocks: pa.Table, known: pa.Table) -> pa.Table:
        if not len(blocks) or not len(known):
            return pa.table({"shard": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "filter": pa.array([], pa.binary())})
        block = blocks.to_pylist()[0]
        ids = np.zeros(block["n_entries"] + 1, dtype=np.uint64)
        ids[known.column("local").to_numpy()] = known.column("id").to_numpy().astype(np.uint64)
        width = block["width"]
        stream = ids[_from_bytes(block["stream"], len(block["stream"]) // width, 8 * width)]
        highs, lows = [ids[:0]], [ids[:0]]
        for n in range(2, LONGEST + 1):
            for begin in range(max(0, block["context"] - n + 1), len(stream) - n + 1, part):
                size = min(part, len(stream) - n + 1 - begin)
                words = [stream[begin + k : begin + k + size] for k in range(n)]
                valid = np.logical_and.reduce([w > 0 for w in words])
                words = [w[valid] for w in words] + [np.zeros(int(valid.sum()), np.uint64)] * (LONGEST - n)
                high, low = permute(*pack(words, bits), half)
                highs.append(high)
                lows.append(low)
        high, low = np.concatenate(highs), np.concatenate(lows)
        del stream, highs, lows
        return _filters(block["block"], 0, summed(high, low, None, half), half, split, half)

    return build


def _merged_filters(half: int, known_bits: int, split: int) -> Callable[[pa.Table], pa.Table]:
    def merge(rows: pa.Table) -> pa.Table:
        shard, part = rows.column("shard")[0].as_py(), rows.column("part")[0].as_py()
        decoded = [decode(blob) for blob in rows.column("filter").to_pylist()]
        high, low, counts = (np.concatenate(x) for x in zip(*decoded, strict=True))
        return _filters(part, shard, summed(high, low, counts, half), half - known_bits, split, half)

    return merge


def _split_bits(parts: int, entries: float, fan: int, most: int, half: int) -> int:
    """Into how many bits' worth of shards to cut parts, so that ``fan`` of them merge to about ``most`` entries."""
    return min(half, max(0, math.ceil(math.log2(max(1.0, min(parts, fan) * entries / most)))))


def merge_filters(filters: DataFrame, parts: int, entries: float, bits: int, half: int, fan: int, most: int) -> tuple[DataFrame, int]:
    """One filter per shard, and how many first bits of a key name the shard.

    ``filters`` come from ``parts`` blocks of about ``entries`` entries, cut by the
    first ``bits`` bits. Each round merges the sorted filters of about ``fan`` parts of a
    shard, then cuts the result by further bits, so that no merge holds many more than
    ``most`` entries however many blocks there are. The last round cuts no more.
    """
    cut = bits
    while True:
        entries = min(parts, fan) * entries / 2**cut
        parts = -(-parts // fan)
        cut = 0 if parts <= 1 else _split_bits(parts, entries, fan, most, half - bits)
        dealt = filters.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts)).cast("long"))
        filters = dealt.groupBy("shard", "part").applyInArrow(_merged_filters(half, bits, cut), FILTERS)
        bits += cut
        if parts <= 1:
            return filters, bits


def counted_phrases(filters: DataFrame, shard_bits: int, bits: int, least: int) -> DataFrame:
    """(id1, id2, id3, a) of the phrases that the filters count at least ``least`` times; id3 is 0 for two words."""
    half = 3 * bits // 2

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("filter").to_pylist(), strict=True):
                high, low, counts = decode(blob)
                often = counts >= least
                high = (np.uint64(shard) << np.uint64(half - shard_bits)) | high[often]
                ids = unpack(*unpermute(high, low[often], half), bits)
                columns = [pa.array(x.astype(np.int64)) for x in (*ids, counts[often])]
                yield pa.RecordBatch.from_arrays(columns, names=["id1", "id2", "id3", "a"])

    return filters.select("shard", "filter").mapInArrow(phrases, "id1 long, id2 long, id3 long, a long")


# --- scores ----------------------------------------------------------------------


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: products are 38-digit decimals."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    over = wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over, wide[1] * wide[2])


def phrase_counts(
    docs: DataFrame, least: int = 10, block_tokens: int = 1 << 21, fan: int = 1024, most: int = 1 << 20, step: int = 1 << 18
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 2 and 3 words found at least ``least`` times, the words they are made of, and words per language.

    Texts become blocks of numbered words, once. The blocks' words are summed per
    language; those of at least ``least`` occurrences get dense ids (a phrase cannot
    be more frequent than its words), which go back to the blocks that hold them, so no
    dictionary is ever whole in one place. Per block the packed ids of all phrases
    are permuted, sorted and stored as counting quotient filters, which are merged
    shard by shard. Returns (id1, id2, id3, a), (id, lang, word, f) and (lang, n).
    """
    bounded_batches(docs.sparkSession)
    blocks = save(text_blocks(docs, block_tokens, step), "phrase-blocks")
    entries = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "entry"))
    postings = entries.select("block", "lang", F.col("entry.words").alias("word"), (F.col("at") + 1).alias("local"), "entry.counts")
    totals = postings.groupBy("lang", "word").agg(F.sum("counts").alias("f")).filter(F.col("f") >= least)
    words = save(dense_index(totals, [F.col("lang"), F.col("word")], "id"), "phrase-words")
    bits = id_bits(words.count())
    if bits > 42:
        raise ValueError("more than 2**42 words: ids do not fit a packed phrase")
    half = 3 * bits // 2
    known = postings.join(words.hint("merge"), ["lang", "word"]).select(F.col("block").alias("held_by"), "local", "id")
    streams = blocks.select("block", "context", "width", "stream", F.size("words").alias("n_entries"))
    parts, tokens = blocks.agg(F.count("*"), F.sum("n_words")).first()
    entries = (LONGEST - 1) * (tokens or 0) / max(parts, 1)
    split = _split_bits(parts, entries, fan, most, half)
    filters = streams.groupBy("block").cogroup(known.groupBy("held_by")).applyInArrow(_block_filters(bits, split), FILTERS)
    filters, shard_bits = merge_filters(filters, parts, entries, split, half, fan, most)
    phrases = save(counted_phrases(filters, shard_bits, bits, least), "phrase-counts")
    return phrases, words, blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, buckets: int = 64, **parameters) -> DataFrame:
    """The ``top`` phrases of every language by the score of their weakest cut.

    Per language: ``a`` counts a phrase, ``l`` and ``r`` the parts of its lowest
    cut, ``n`` all words. A phrase goes if a longer one that holds it is found at
    least ``share`` percent as often. First places are taken within ``buckets``
    hashed parts of a language, then among those, so one language may hold all rows.

    Returns ``lang, rank, phrase, a, l, r, n, score``. Null languages are ``und``
    (and meet rows that say so); null and empty texts hold no words; repeated rows
    count each; ties go to the higher ``a``, then to the smaller phrase by bytes; a
    piece of any length is counted whole; no rows, or none frequent enough, give no
    rows. Other columns than ``lang`` and ``text`` are not read.
    """
    phrases, words, sizes = phrase_counts(docs, least, **parameters)

    def word(k: int) -> DataFrame:
        chosen = words.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), F.col("lang").alias(f"lang{k}"))
        return (chosen if k == 1 else chosen.drop(f"lang{k}")).hint("merge")

    pairs = phrases.filter("id3 = 0").select("id1", "id2", "a")
    triples = phrases.filter("id3 > 0")
    within = triples.select("id1", "id2", "a").union(triples.select("id2", "id3", "a"))
    within = within.groupBy("id1", "id2").agg(F.max("a").alias("longer"))
    two = (
        pairs.join(within.hint("merge"), ["id1", "id2"], "left")
        .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
        .join(word(1), "id1")
        .join(word(2), "id2")
        .select("lang1", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
        .withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r")))
    )
    head = pairs.select("id1", "id2", F.col("a").alias("head")).hint("merge")
    tail = pairs.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("a").alias("tail")).hint("merge")
    cuts = (
        triples.join(head, ["id1", "id2"])
        .join(tail, ["id2", "id3"])
        .join(word(1), "id1")
        .join(word(2), "id2")
        .join(word(3), "id3")
        .withColumn("early", cut_score(F.col("a"), F.col("f1"), F.col("tail")))
        .withColumn("late", cut_score(F.col("a"), F.col("head"), F.col("f3")))
    )
    first = F.col("early") <= F.col("late")
    three = cuts.select(
        "lang1",
        F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"),
        "a",
        F.when(first, F.col("f1")).otherwise(F.col("head")).alias("l"),
        F.when(first, F.col("tail")).otherwise(F.col("f3")).alias("r"),
        F.least("early", "late").alias("score"),
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(buckets))
    ranked = (
        two.unionByName(three)
        .withColumnRenamed("lang1", "lang")
        .withColumn("_place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best)))
        .filter(F.col("_place") <= top)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
        .filter(F.col("rank") <= top)
    )
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query(
    "op12_collocations",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), split AS (
        SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), tokens AS (
        SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM split
    ), runs AS (
        SELECT lang, word, lead(word, 1) OVER (PARTITION BY piece ORDER BY place) AS second,
               lead(word, 2) OVER (PARTITION BY piece ORDER BY place) AS third
        FROM tokens
    ), occurrences AS (
        SELECT lang, 1 AS k, word AS phrase FROM runs
        UNION ALL
        SELECT lang, 2, word || ' ' || second FROM runs WHERE second IS NOT NULL
        UNION ALL
        SELECT lang, 3, word || ' ' || second || ' ' || third FROM runs WHERE third IS NOT NULL
    ), f AS MATERIALIZED (
        SELECT lang, k, phrase, count(*) AS f FROM occurrences GROUP BY lang, k, phrase
    ), sizes AS (
        SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
    ), candidates AS MATERIALIZED (
        SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
    ), longer AS (
        SELECT lang, phrase, max(a) AS a FROM (
            SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE k = 3
            UNION ALL
            SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE k = 3
        ) GROUP BY lang, phrase
    ), cuts AS (
        SELECT lang, phrase, a, 1 AS cut, w[1] AS head, w[2] AS tail FROM candidates WHERE k = 2
        UNION ALL
        SELECT lang, phrase, a, 1, w[1], w[2] || ' ' || w[3] FROM candidates WHERE k = 3
        UNION ALL
        SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE k = 3
    ), often AS MATERIALIZED (
        SELECT lang, phrase, f FROM f WHERE f >= 10
    ), headed AS MATERIALIZED (
        SELECT c.*, o.f AS l FROM cuts c JOIN often o ON o.lang = c.lang AND o.phrase = c.head
    ), scored AS (
        SELECT h.lang, h.phrase, a, cut, l, o.f AS r,
               ((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * o.f::HUGEINT))::BIGINT AS score
        FROM headed h JOIN often o ON o.lang = h.lang AND o.phrase = h.tail
    ), weakest AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
    ), ranked AS (
        SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank
        FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase
        WHERE g.a IS NULL OR 100 * g.a < 50 * w.a
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
    """,
)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
