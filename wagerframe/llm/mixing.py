"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import WHITE_SPACE, save

#: Points of the schedule are multiples of the golden ratio's fraction, in units of 2**-31.
POINTS = 1 << 31
GOLDEN = 1327217885


def n_words(text: Column) -> Column:
    """Words of a text; each becomes one character, so no list of words is built."""
    marks = F.regexp_replace(F.ltrim(text, F.lit(WHITE_SPACE)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")
    return F.coalesce(F.char_length(marks), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """Target words per source: ``share`` of all words by weight, at most ``epochs`` times a source's own.

    ``sizes`` is (source, source_size). Sources by code point, null last, take the
    weights in turn. Excess over a bound is shared again by weight until no source
    is above its bound; that fixed point is ``min(bound, level * weight)``, and the
    level follows from prefix sums over the sources ordered by bound / weight. Along
    that order the candidate levels rise until the first source that keeps below its
    bound and fall from there, so the largest level that fits its source is the one.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), "place")
    ranked = sizes.select(
        "source",
        "source_size",
        (F.row_number().over(by_name) - 1).cast("long").alias("place"),
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
    ).select(
        "source",
        "source_size",
        "place",
        (F.lit(share) * F.col("total")).alias("goal"),
        (F.lit(epochs) * F.col("source_size")).alias("bound"),
        F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
    )
    levels = ranked.withColumns(
        {
            "_before": F.sum("bound").over(by_bound.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bound"),
            "_weights": F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("_level", (F.col("goal") - F.col("_before")) / F.col("_weights"))
    level = F.max(F.when(F.col("_level") * F.col("weight") <= F.col("bound"), F.col("_level"))).over(Window.partitionBy())
    return levels.select(
        "source",
        "source_size",
        "place",
        F.least(F.col("bound").cast("double"), F.coalesce(level * F.col("weight"), F.col("bound").cast("double"))).alias("target"),
    )


def schedule(targets: DataFrame, slots: int, chunk: int = 4096, cells: int = 1024) -> DataFrame:
    """(source, rank): slot k goes to the source whose cumulative weights hold the k-th golden-ratio point.

    Points and bounds are integers, so every run and engine agrees. Points find
    their source by an equi-join on equal cells of the unit interval; slots are
    ranked per source by counts of chunks of slots, then within a chunk.
    """
    spark = targets.sparkSession
    by_place = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = targets.filter(F.col("target") > 0).withColumns(
        {"_sum": F.sum("target").over(by_place), "_all": F.sum("target").over(Window.partitionBy())}
    )
    step = POINTS // cells
    bounds = (
        cumulated.withColumn("_high", F.floor(F.col("_sum") / F.col("_all") * POINTS + 0.5))
        .withColumn("_low", F.lag("_high", 1, 0).over(Window.orderBy("place")))
        .filter(F.col("_high") > F.col("_low"))
        .select(
            "place",
            "_low",
            "_high",
            F.explode(F.sequence(F.floor(F.col("_low") / step), F.floor((F.col("_high") - 1) / step))).alias("cell"),
        )
    )
    points = spark.range(slots).select(
        F.col("id").alias("slot"), (F.col("id") % POINTS * GOLDEN % POINTS).alias("point")
    ).withColumn("cell", F.floor(F.col("point") / step))
    placed = points.join(bounds, "cell").filter((F.col("point") >= F.col("_low")) & (F.col("point") < F.col("_high")))
    placed = save(placed.select("place", "slot", F.floor(F.col("slot") / chunk).alias("chunk")), "mix-slots")
    per_source = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("place", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("place", "chunk", F.coalesce(F.sum("n").over(per_source), F.lit(0)).alias("start"))
    )
    in_chunk = Window.partitionBy("place", "chunk").orderBy("slot")
    return placed.join(starts.hint("merge"), ["place", "chunk"]).select(
        "place", (F.col("start") + F.row_number().over(in_chunk) - 1).alias("rank")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    block_words: int = 32,
    range_bits: int = 12,
    seed: str = "mix",
) -> DataFrame:
    """What a mix of the sources takes of every row of ``docs``.

    The documents of a source, shuffled by a 60-bit digest of (seed, id, size), form
    one stream of words, cut into blocks of ``block_words``. The schedule's r-th slot
    of a source takes its block ``r mod blocks``; after ``epochs`` rounds a source
    is used up. Streams are summed in ``2**range_bits`` ranges of the digest, so no source is
    gathered in one task. What meets in one task is a row per source.

    Returns ``doc_id, source, size, source_size, target, taken, whole_rounds, cut``:
    ``taken`` words in all, made of ``whole_rounds`` complete copies and, where the
    schedule ends inside the document, its first ``cut`` words. Null or empty
    texts have size 0 and nothing is taken of them; null sources are a source;
    repeated rows count each; a very long document is a long stretch of its stream,
    of which a round may take a part; no rows give no rows.
    """
    text = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    sized = save(sized.withColumn("digest", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = save(source_targets(sizes, weights, share, epochs), "mix-targets")
    goal = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = int(-(-goal // block_words))

    placed = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]))
        .select("doc_id", sized["source"], "size", "digest", "place", "source_size", "target")
        .withColumn("range", F.shiftright("digest", 60 - range_bits))
    )
    per_source = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("place", "range")
        .agg(F.sum("size").alias("n"))
        .select("place", "range", F.coalesce(F.sum("n").over(per_source), F.lit(0)).alias("start"))
    )
    in_range = Window.partitionBy("place", "range").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    streams = save(
        placed.join(offsets.hint("merge"), ["place", "range"])
        .withColumn("begin", F.col("start") + F.sum("size").over(in_range) - F.col("size"))
        .drop("range", "digest", "start"),
        "mix-streams",
    )

    blocks = F.ceil(F.col("source_size") / block_words)
    used = save(
        schedule(targets, slots)
        .join(targets.select("place", "source_size"), "place")
        .filter(F.col("rank") < epochs * blocks)
        .groupBy("place", (F.col("rank") % blocks).alias("block"))
        .agg(F.count(F.lit(1)).alias("times")),
        "mix-blocks",
    )
    first, last = F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words)
    parts = (
        streams.filter(F.col("size") > 0)
        .select("place", "begin", "size", F.explode(F.sequence(first, last)).alias("block"))
        .withColumn(
            "words",
            F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words)
            - F.greatest(F.col("begin"), F.col("block") * block_words),
        )
    )
    taken = (
        parts.join(used.hint("merge"), ["place", "block"])
        .groupBy("place", "begin")
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    # Rows of size 0 share the place where the next document begins; they take nothing.
    streams = streams.withColumn("key", F.when(F.col("size") > 0, F.col("begin")))
    return (
        streams.alias("s")
        .join(taken.alias("t").hint("merge"), (F.col("s.place") == F.col("t.place")) & (F.col("s.key") == F.col("t.begin")), "left")
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
        .withColumns(
            {
                "whole_rounds": F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)),
                "cut": F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)),
            }
        )
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    A document taken twice comes twice; where the schedule ends inside a document,
    its first words come as a row of their own, with ``n_chars`` set anew. Rows of
    equal id and size are told apart by number.
    """
    decided = (
        mix(docs, **parameters)
        .withColumn("_o", F.row_number().over(Window.partitionBy("doc_id", "size").orderBy(F.desc("taken"))))
        .filter("taken > 0")
        .select(F.col("doc_id").alias("_id"), F.col("size").alias("_n"), "_o", "whole_rounds", "cut")
    )
    rows = docs.select(
        F.struct("*").alias("whole"), F.col("doc_id").alias("id"), n_words(F.col("text")).alias("n"), F.xxhash64("text", "source").alias("hash")
    ).withColumn("o", F.row_number().over(Window.partitionBy("id", "n").orderBy("hash")))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("n") == F.col("_n")) & (F.col("o") == F.col("_o"))
    rounds = F.col("whole_rounds") + F.when(F.col("cut") > 0, 1).otherwise(0)
    copies = F.transform(
        F.sequence(F.lit(1).cast("long"), rounds), lambda i: F.when(i <= F.col("whole_rounds"), F.lit(-1).cast("long")).otherwise(F.col("cut"))
    )
    words = F.regexp_extract_all("whole.text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    taken = rows.join(decided.hint("merge"), same).select("whole", F.explode(copies).alias("head"))
    first = F.array_join(F.slice(words, F.lit(1), F.col("head").cast("int")), "")
    part = F.col("whole").withField("text", first)
    if "n_chars" in docs.columns:
        part = part.withField("n_chars", F.char_length(first).cast(docs.schema["n_chars"].dataType))
    return taken.select(F.when(F.col("head") < 0, F.col("whole")).otherwise(part).alias("whole")).select("whole.*")


def _twin(weights=(5, 2, 1), share=1.5, epochs=2, block=32, seed="mix") -> str:
    weight = f"CASE place % {len(weights)} " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)) + " END"
    return rf"""
    WITH sized AS MATERIALIZED (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
    ), sizes AS (
        SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
    ), placed AS (
        SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place, {share} * sum(source_size) OVER () AS goal,
               {epochs} * source_size AS bound
        FROM sizes
    ), weighed AS (SELECT *, {weight} AS weight FROM placed),
    levels AS (
        SELECT *, (goal - (sum(bound) OVER (ORDER BY bound / weight, place ROWS UNBOUNDED PRECEDING) - bound))::DOUBLE
                  / (sum(weight) OVER (ORDER BY bound / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
        FROM weighed
    ), targets AS MATERIALIZED (
        SELECT source, source_size, place,
               least(bound::DOUBLE, coalesce((max(CASE WHEN lvl * weight <= bound THEN lvl END) OVER ()) * weight, bound)) AS target
        FROM levels
    ), cumulated AS (
        SELECT place, floor(sum(target) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) / sum(target) OVER () * {POINTS} + 0.5)::BIGINT AS high
        FROM targets WHERE target > 0
    ), bounds AS (
        SELECT place, high, lag(high, 1, 0) OVER (ORDER BY place) AS low FROM cumulated
    ), slots AS (
        SELECT k, k % {POINTS} * {GOLDEN} % {POINTS} AS point
        FROM range((SELECT ceil(sum(target) / {block})::BIGINT FROM targets)) r(k)
    ), ranked AS (
        SELECT place, row_number() OVER (PARTITION BY place ORDER BY k) - 1 AS rank
        FROM slots JOIN bounds ON point >= low AND point < high
    ), used AS (
        SELECT place, rank % ceil(source_size / {block})::BIGINT AS block, count(*) AS times
        FROM ranked JOIN targets USING (place)
        WHERE rank < {epochs} * ceil(source_size / {block})::BIGINT GROUP BY ALL
    ), streams AS (
        SELECT doc_id, place, size, source_size, target,
               sum(size) OVER (PARTITION BY place ORDER BY ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 15))::BIGINT,
                               doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS begin
        FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
    ), parts AS (
        SELECT place, begin, block, least(begin + size, (block + 1) * {block}) - greatest(begin, block * {block}) AS words
        FROM (SELECT *, unnest(range(begin // {block}, (begin + size - 1) // {block} + 1)) AS block FROM streams WHERE size > 0)
    ), taken AS (
        SELECT place, begin, sum(words * times)::BIGINT AS taken FROM parts JOIN used USING (place, block) GROUP BY ALL
    )
    SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
    FROM streams LEFT JOIN taken ON streams.place = taken.place AND streams.begin = taken.begin AND size > 0
    """


@query("op10_mix_sources", _twin())
def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
