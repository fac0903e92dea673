"""Near-duplicates by MinHash bands, signature and set verification, and components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerframe.llm.components import components
from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import bounded_batches, save
from wagerframe.llm.vocabularies import Recent

WORDS = 5
BANDS, ROWS = 48, 5
MINIMA = BANDS * ROWS
#: Links need 100 * intersection >= 75 * union.
PERCENT = 75


@lru_cache(maxsize=1)
def _numbers() -> dict[str, np.ndarray]:
    """Fixed multipliers: of the words of a shingle, of the universal hashes, of the minima of a band."""
    draw = np.random.Generator(np.random.PCG64(20_259)).integers
    odd = lambda *shape: draw(0, 1 << 63, shape, dtype=np.uint64) * 2 + 1
    return {"word": odd(WORDS + 1), "a": odd(MINIMA), "b": draw(0, 1 << 63, MINIMA, dtype=np.uint64), "band": odd(BANDS, ROWS + 1)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_words = Recent(xxhash.xxh3_64_intdigest)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    A-Z become lower case and words are what ``[\\x20\\x09-\\x0D]`` separates, which
    is what bytes.lower() and bytes.split() do. Words are hashed on their own and
    combined by position, so a shingle's hash depends on its words alone.
    """
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    multipliers = _numbers()["word"]
    width = min(n, WORDS)
    summed = hashed[: n - width + 1] * multipliers[0]
    for k in range(1, width):
        summed += hashed[k : n - width + 1 + k] * multipliers[k]
    return np.unique(_mix(summed + multipliers[WORDS:] * np.uint64(width)))


def minima(hashes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """The least value of each universal hash ((a * x + b) mod 2**64) >> 32 over the upper halves x of ``hashes``."""
    numbers = _numbers()
    x = (hashes >> np.uint64(32))[:, None]
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    room = np.empty((min(chunk, len(x)), MINIMA), dtype=np.uint64)
    for begin in range(0, len(x), chunk):
        part = x[begin : begin + chunk]
        values = np.multiply(part, numbers["a"], out=room[: len(part)])
        values += numbers["b"]
        np.minimum(least, values.min(axis=0), out=least)
    return least >> np.uint64(32)


def band_keys(least: np.ndarray) -> np.ndarray:
    band = _numbers()["band"]
    return _mix((least.reshape(BANDS, ROWS) * band[:, :ROWS]).sum(axis=1, dtype=np.uint64) + band[:, ROWS])


SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, bands array<bigint>"
SETS = "rep long, n long, shingles binary, signature binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Per row the size and 128-bit fingerprint of its shingle set, and its band keys (null for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fingerprints, bands = [], np.zeros((batch.num_rows, 2), dtype=np.int64), []
            for k, text in enumerate(batch.column("text").to_pylist()):
                hashes = shingles(text)
                sizes.append(len(hashes))
                fingerprints[k] = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype=np.int64)
                bands.append(band_keys(minima(hashes)).view(np.int64) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(fingerprints[:, 0]), pa.array(fingerprints[:, 1]),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, SKETCH)


def shingle_sets(docs: DataFrame, wanted: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The whole shingle set of the rows whose id is in ``wanted`` (rep), and a signature of eight bits per minimum.

    Texts stay where they are read: a bitmap of ``bits`` hash values of the wanted
    ids, whose size is fixed, goes to the tasks, and what passes it by chance is
    dropped by the join on the id that follows. The fuller the bitmap, the more
    sets that join moves.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = (
        wanted.select(bit("rep").alias("bit"))
        .groupBy(F.floor(F.col("bit") / 64).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("set"))
        .toArrow()  # at most bits / 64 rows
    )
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("set").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((bitmap[at >> 6] >> (at & 63)) & 1 == 1))
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                sets = [shingles(text) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rep"), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([minima(s).astype(np.uint8).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["rep", "n", "shingles", "signature"],
                )

    bounded_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter(F.col("rep").isNotNull())
    return ids.withColumn("bit", bit("rep")).mapInArrow(build, SETS)


def linked(group: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Confirmed links inside one block, or between two, as (node, least node it is joined with here).

    Signatures of eight bits per minimum estimate the similarity of all pairs;
    those within five standard deviations of the threshold or above it are
    confirmed on the full sets, most similar first, unless the two are joined already.
    """
    rep = group.column("rep").to_numpy()
    side = group.column("side").to_numpy()
    sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
    signatures = np.stack([np.frombuffer(s, dtype=np.uint8) for s in group.column("signature").to_pylist()])
    sizes = np.asarray([len(s) for s in sets])
    root = list(range(len(rep)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    share = percent / 100
    least = share - 5 * np.sqrt(share * (1 - share) / MINIMA)
    within = len(np.unique(side)) == 1
    found = []
    for a in range(len(rep)):
        others = np.arange(a + 1, len(rep))
        if not within:
            others = others[side[others] != side[a]]
        others = others[np.minimum(sizes[others], sizes[a]) * 100 >= percent * np.maximum(sizes[others], sizes[a])]
        if len(others):
            equal = np.count_nonzero(signatures[others] == signatures[a], axis=1) / MINIMA
            estimate = (equal - 1 / 256) / (1 - 1 / 256)
            near = estimate >= least
            found += zip(-estimate[near], [a] * int(near.sum()), others[near].tolist(), strict=True)
    found.sort()
    for _, a, b in found:
        x, y = find(a), find(b)
        if x == y:
            continue
        common = np.intersect1d(sets[a], sets[b], assume_unique=True).size
        if 100 * common >= percent * (sizes[a] + sizes[b] - common):
            root[x] = y
    top: dict[int, int] = {}
    roots = [find(k) for k in range(len(rep))]
    for k, r in enumerate(roots):
        top[r] = min(top.get(r, rep[k]), rep[k])
    pairs = {(int(rep[k]), int(top[r])) for k, r in enumerate(roots) if rep[k] != top[r]}
    a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(hub, rep): every document with the hub of each of its bands' buckets.

    Documents that share a bucket share its hub, so comparing within hubs compares
    all that a band brings together. The hub is the member that meets the most
    others over all bands, which is the original among its edited copies; buckets
    of one group of copies then have the same hub and are compared once. Counts
    and hubs are written before they are joined, so that the joins deal out both
    sides and can split a key that most documents have.
    """
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-shared-keys")
    met = save(keys.join(shared, "key"), "near-buckets")
    fame = met.groupBy("rep").agg(F.sum("n").alias("fame"))
    hubs = save(
        met.select("key", "rep").join(fame, "rep").groupBy("key").agg(F.max_by("rep", F.struct("fame", -F.col("rep"))).alias("hub")),
        "near-hubs",
    )
    return met.select("key", "rep").join(hubs, "key").select("hub", "rep").distinct()


def block_count(block_docs: int, block_shingles: int) -> Column:
    return F.ceil(F.greatest(F.count(F.lit(1)) / block_docs, F.sum("n") / block_shingles)).cast("int")


def star_placements(large: DataFrame) -> DataFrame:
    """(hub, i, rep, side): members of large groups in their blocks, and the hub in every block, on a side of its own."""
    hubs = large.select("hub", "blocks").distinct()
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("hub").alias("rep"), F.lit(-1).alias("side"))
    return large.select("hub", F.col("block").alias("i"), "rep", F.col("block").alias("side")).unionByName(hubs)


def rest_placements(large: DataFrame, rest: DataFrame, rests: DataFrame) -> DataFrame:
    """(hub, r, i, rep, side): blocks of the rest beside all blocks of their group."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = F.pmod(F.xxhash64("rep", F.lit("rest")), F.col("rests")).cast("int")
    left = rest.join(rests, "hub").select("hub", own.alias("r"), every("blocks").alias("i"), "rep", F.lit(0).alias("side"))
    right = large.join(rests, "hub").select("hub", every("rests").alias("r"), F.col("block").alias("i"), "rep", F.lit(1).alias("side"))
    return left.unionByName(right)


def links_of(members: DataFrame, sizes: DataFrame, sets: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """Links (a, b) that join what is alike among the members of each hub.

    A group that fits one block is compared whole. In a larger one all members are
    compared with the hub first, block by block; as a component needs one link
    per member, those alike need no more, and only the rest is compared, with all
    members. So copies of one text cost in proportion to their number.
    """
    weighed = members.join(sizes, "rep")
    # Written, so that both sides of the join are exchanged and the members of one hub can be split.
    blocks = save(weighed.groupBy("hub").agg(block_count(block_docs, block_shingles).alias("blocks")), "near-blocks")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = save(weighed.join(blocks, "hub").withColumn("block", block), "near-placed")
    small = placed.filter("blocks = 1").select("hub", "rep", F.lit(0).alias("side"))
    whole = small.join(sets, "rep").groupBy("hub").applyInArrow(lambda group: linked(group), "a long, b long")

    def starred(group: pa.Table) -> pa.Table:
        found = linked(group)
        hub = pa.array([group.column("hub")[0].as_py()] * found.num_rows, pa.int64())
        return pa.table({"hub": hub, "a": found.column("a"), "b": found.column("b")})

    large = placed.filter("blocks > 1")
    stars = save(
        star_placements(large).join(sets, "rep").groupBy("hub", "i").applyInArrow(starred, "hub long, a long, b long"), "near-stars"
    )
    # Only the hub is compared in a star, so every node of its links is joined with the hub.
    done = stars.select("hub", F.col("a").alias("rep")).unionByName(stars.select("hub", F.col("b").alias("rep"))).distinct()
    rest = save(large.filter("rep <> hub").join(done, ["hub", "rep"], "left_anti"), "near-rest")
    rests = rest.groupBy("hub").agg(block_count(block_docs, block_shingles).alias("rests"))
    others = (
        rest_placements(large, rest, save(rests, "near-rest-blocks"))
        .join(sets, "rep")
        .groupBy("hub", "r", "i")
        .applyInArrow(lambda group: linked(group), "a long, b long")
    )
    return whole.unionByName(stars.select("a", "b")).unionByName(others)


def near_duplicates(docs: DataFrame, block_docs: int = 512, block_shingles: int = 1_000_000) -> DataFrame:
    """Components of documents whose five-word shingle sets are 75 % alike, for every row of ``docs``.

    Equal sets form one class before anything else, so exact copies cost one row
    each. Of the classes, those that share a bucket meet at its hub; a hub's
    members are cut into blocks of about ``block_docs`` documents and
    ``block_shingles`` shingles and compared as ``links_of`` says, a block or two in a
    task, which returns at most one link per member. Sets are computed again,
    for the documents that meet others. The bands miss a pair at exactly 75 %
    with probability (1 - 0.75**5)**48 = 2e-6, more similar ones less.

    Null, empty and blank texts have an empty set and are linked with nothing; a
    text of fewer than five words is one shingle. A node is an id: rows of equal id
    are linked. Rows without an id are linked with nothing, have a null component
    and are kept. A very long text is compared by its whole set. No rows give no rows.
    Other columns are not read. Returns
    ``doc_id, n_shingles, component_id, kept``.
    """
    sketched = save(sketches(docs), "near-sketches")
    reps = save(
        sketched.filter(F.col("bands").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "near-classes",
    )
    members = save(candidate_groups(reps), "near-candidates")
    sizes = reps.groupBy("rep").agg(F.sum("n").alias("n"))  # one class per id but for repeated ids
    sets = save(shingle_sets(docs, members.select("rep").distinct()), "near-sets")
    links = links_of(members, sizes, sets, block_docs, block_shingles)
    # An id whose rows fall into several classes joins them.
    classes = sketched.select("doc_id", "n_shingles", "f1", "f2").join(reps.select("f1", "f2", "rep"), ["f1", "f2"], "left")
    classes = save(classes.select("doc_id", "n_shingles", "rep"), "near-rows")
    doubled = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    same = classes.join(doubled, "doc_id").select("a", F.col("rep").alias("b"))
    found = components(links.unionByName(same))
    joined = classes.join(found, classes["rep"] == found["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each component, that of the least id, with its own columns; rows without an id stay."""
    kept = near_duplicates(docs, **parameters).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("id"), F.char_length("text").alias("chars"))
    one = (
        rows.join(kept, F.col("id") == F.col("kept_id"), "left_semi")
        .groupBy("id")
        .agg(F.max_by("whole", F.coalesce("chars", F.lit(-1))).alias("whole"))
        .select("whole.*")
    )
    return one.unionByName(docs.filter(F.col("doc_id").isNull()))


def _twin() -> str:
    return r"""
    WITH RECURSIVE w AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS MATERIALIZED (
        SELECT DISTINCT doc_id, shingle FROM (
            SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
            FROM w)
    ), n AS MATERIALIZED (
        SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
    ), links AS MATERIALIZED (
        SELECT a, b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL
        ) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
        WHERE 100 * common >= 75 * (p.n + q.n - common)
    ), reach AS (
        SELECT a AS doc_id, a AS least FROM links
        UNION
        SELECT links.b, least FROM reach JOIN links ON links.a = reach.doc_id WHERE least < links.b
    ), least AS (SELECT doc_id, min(least) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
    FROM n LEFT JOIN least USING (doc_id)
    """


@query("op3_near_dedup", _twin())
def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
