"""Token counts per document from counts per distinct pre-token."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerframe.llm import vocabularies
from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import bounded_batches

#: White space that str.split() would split at, though the tokenizers need not.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
POSTINGS = "block long, token string, salt long, at binary, counts binary, ids array<bigint>, sizes array<bigint>"
PARTIALS = "block long, at binary, counts binary, ids array<bigint>, sizes array<bigint>"
ARROW = {
    "block": pa.int64(), "token": pa.string(), "salt": pa.int64(), "at": pa.binary(), "counts": pa.binary(),
    "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()),
}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[name]) for name in (part.split()[0] for part in ddl.split(", "))])


def _slices(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array whose k-th entry holds ``values[starts[k] : starts[k + 1]]``."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


class Numbered(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Block:
    """The words of consecutive documents, turned into postings by pre-token."""

    def __init__(self, number: int, together: int, block_docs: int, block_words: int, hot_docs: int):
        self.number, self.together, self.hot_docs = number, together, hot_docs
        self.block_docs, self.block_words = block_docs, block_words
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.lengths: list[int] = []
        self.index = Numbered()
        self.words = array("I")

    def full(self) -> bool:
        return len(self.ids) >= self.block_docs or len(self.words) >= self.block_words

    def add(self, doc_id: int | None, size: int, words: list[str]) -> None:
        self.words.extend(map(self.index.__getitem__, words))
        self.lengths.append(len(words))
        self.ids.append(doc_id)
        self.sizes.append(size)

    def batches(self, split: Callable[[str], list[str]]) -> Iterator[pa.RecordBatch]:
        schema = _schema(POSTINGS)
        header = {"block": self.number, "token": None, "salt": self.number, "ids": self.ids, "sizes": self.sizes}
        yield pa.RecordBatch.from_pylist([header], schema=schema)
        if not self.words:
            return
        # Frequencies of the (word, document) pairs, then of (pre-token, document).
        docs = np.repeat(np.arange(len(self.ids), dtype=np.uint64), self.lengths)
        pairs = (np.frombuffer(self.words, dtype=np.uint32).astype(np.uint64) << np.uint64(16)) | docs
        pairs, counts = np.unique(pairs, return_counts=True)
        tokens = Numbered()
        of_word = [[tokens[t] for t in split(word)] for word in self.index]
        sizes = np.asarray([len(x) for x in of_word])
        flat = np.fromiter((t for x in of_word for t in x), dtype=np.uint64, count=int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        word = (pairs >> np.uint64(16)).astype(np.int64)
        times = sizes[word]
        # Entry k of a pair's word lies k places after that word's first pre-token.
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        keys = (flat[np.repeat(first[word], times) + step] << np.uint64(16)) | np.repeat(pairs & np.uint64(0xFFFF), times)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.repeat(counts, times)[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts, begins).astype(np.uint32) if len(keys) else np.zeros(0, np.uint32)
        keys = keys[begins]
        lengths = np.bincount((keys >> np.uint64(16)).astype(np.int64), minlength=len(tokens))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        salt = np.where(lengths >= self.hot_docs, -1 - self.number, self.together)
        n = len(tokens)
        none = pa.nulls(n, pa.list_(pa.int64()))
        columns = [
            pa.array(np.full(n, self.number)), pa.array(list(tokens), pa.string()), pa.array(salt.astype(np.int64)),
            _slices((keys & np.uint64(0xFFFF)).astype(np.uint16), starts), _slices(counts, starts), none, none,
        ]
        whole = pa.RecordBatch.from_arrays(columns, schema=schema)
        for begin in range(0, n, 10_000):
            yield whole.slice(begin, 10_000)


def _values(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all entries of a binary array without nulls, one after another, and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(dtype).itemsize
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(whole.tobytes(), dtype=dtype), np.diff(offsets) // width


def count_tokens(
    docs: DataFrame,
    name: str = "word_bpe_49k.json",
    path: str | None = None,
    limit: int = 2048,
    block_docs: int = 60_000,
    block_words: int = 4_000_000,
    hot_docs: int = 64,
    spread: int = 4096,
) -> DataFrame:
    """Tokens of every whole text of ``docs``, without materialising ids.

    Three steps. Tasks turn their documents into postings: per block of documents
    and distinct pre-token, the documents and frequencies. Postings are
    partitioned and sorted by pre-token, so that a pre-token's pieces are counted
    once and meet all its frequencies; products are summed per document of a block
    where they arise. Last, the partial sums of a block meet.

    A pre-token found in ``hot_docs`` or more documents of a block is counted for
    that block on its own, others for the blocks of ``spread`` input tasks together, so
    no pre-token gathers the postings of the corpus in one task. A block ends at ``block_docs``
    documents (65,535 at most) or ``block_words`` words, which bounds the
    memory of all three steps by that and one document.

    Null texts are empty and have no tokens; null ids stay null; repeated rows are
    counted each; no rows give no rows. Other columns are not read. Returns
    ``doc_id, n_bytes, n_tokens, over_limit``.
    """
    if not 0 < block_docs <= 65_535:
        raise ValueError("block_docs must lie between 1 and 65535")
    spark = docs.sparkSession
    bounded_batches(spark)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = vocabularies.word_splitter(name, path).split
        task = TaskContext.get().partitionId()
        number = task << 24
        block = Block(number, task // spread, block_docs, block_words, hot_docs)
        for batch in batches:
            for doc_id, text, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                odd = not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f")
                words = re.findall(r"[^ \t\n\r\f\v]+", text) if odd and OTHER_SPACE.search(text) else text.split()
                block.add(doc_id, size, words)
                if block.full():
                    yield from block.batches(split)
                    number += 1
                    block = Block(number, task // spread, block_docs, block_words, hot_docs)
        if block.ids:
            yield from block.batches(split)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_pieces = vocabularies.word_splitter(name, path).n_pieces
        schema = _schema(PARTIALS)
        most, cells = 128, 1 << 16
        sums = np.zeros(most * cells, dtype=np.int64)
        place: dict[int, int] = {}
        last, pieces = None, 0

        def flush() -> pa.RecordBatch:
            rows = []
            for block, k in place.items():
                vector = sums[k * cells : (k + 1) * cells]
                at = np.flatnonzero(vector)
                rows.append({"block": block, "at": at.astype(np.uint16).tobytes(), "counts": vector[at].tobytes()})
                vector[:] = 0
            place.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            is_header = batch.column("token").is_null()
            if is_header.true_count:
                heads = batch.filter(is_header)
                yield pa.RecordBatch.from_arrays([heads.column(f.name) for f in schema], schema=schema)
                batch = batch.filter(pc.invert(is_header))
            counted = []
            for token in batch.column("token").to_pylist():
                if token != last:
                    last, pieces = token, n_pieces(token)
                counted.append(pieces)
            at, lengths = _values(batch.column("at"), "<u2")
            counts, _ = _values(batch.column("counts"), "<u4")
            values = counts.astype(np.int64) * np.repeat(np.asarray(counted, dtype=np.int64), lengths)
            blocks, which = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            # Blocks that do not fit beside those already summed wait for a flush.
            for begin in range(0, len(blocks), most):
                some = blocks[begin : begin + most].tolist()
                if len(place.keys() | set(some)) > most:
                    yield flush()
                slots = np.full(len(blocks), -1)
                slots[begin : begin + most] = [place.setdefault(block, len(place)) for block in some]
                slot = np.repeat(slots[which], lengths)
                now = slot >= 0
                np.add.at(sums, slot[now] * cells + at[now], values[now])
        yield flush()

    def total(partials: pa.Table) -> pa.Table:
        ids, sizes, sums = [], [], np.zeros(65_536, dtype=np.int64)
        for row in partials.select(["at", "counts", "ids", "sizes"]).to_pylist():
            if row["ids"] is not None:
                ids, sizes = row["ids"], row["sizes"]
            else:
                sums[np.frombuffer(row["at"], dtype="<u2")] += np.frombuffer(row["counts"], dtype="<i8")
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(sums[: len(ids)])})

    text = F.coalesce("text", F.lit(""))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
        .mapInArrow(postings, POSTINGS)
        .repartition(partitions, "token", "salt")
        .sortWithinPartitions("token")
        .mapInArrow(multiply, PARTIALS)
        .groupBy("block")
        .applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"))
