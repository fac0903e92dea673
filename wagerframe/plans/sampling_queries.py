"""Queries that number, interleave, sample and mix rows, and join key sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagerframe.functions import draws, text
from wagerframe.operators import ranking, sampling
from wagerframe.operators import situations as sit
from wagerframe.plans.option_queries import _SETS
from wagerframe.plans.pair_queries import uniform_sql
from wagerframe.plans.registry import query, table
from wagerframe.plans.text_queries import COMPLETION_SQL
from wagerframe.plans.views import situations, with_options
from wagerframe.session import shared_folder
from wagerframe.sources import readers, writers

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")


def lines(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@query(
    "first_positions",
    "SELECT c_nationkey, row_number() OVER (ORDER BY min(c_custkey)) AS dataset_position FROM customer GROUP BY c_nationkey",
)
def first_positions(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return ranking.first_positions(rows, "c_nationkey", "c_custkey")


@query(
    "situation_positions",
    "SELECT l_orderkey, row_number() OVER (ORDER BY min(l_partkey), l_orderkey) AS dataset_position FROM lineitem GROUP BY l_orderkey",
)
def situation_positions(spark, folder):
    firsts = lines(spark, folder).groupBy("l_orderkey").agg(F.min("l_partkey").alias("first"))
    return ranking.dense_index(firsts, [F.col("first"), F.col("l_orderkey")], "dataset_position").drop("first")


@query(
    "interleave_sources",
    f"""SELECT o_orderkey, o_orderpriority AS source_condition, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) * 5
    + list_position({PRIORITIES}, o_orderpriority) - 1 AS new_id FROM orders""",
)
def interleave_sources(spark, folder):
    out = ranking.round_robin(orders(spark, folder), "o_orderpriority", "o_orderkey", PRIORITIES)
    return out.select("o_orderkey", F.col("o_orderpriority").alias("source_condition"), "new_id")


@query(
    "source_count_check",
    "SELECT count(DISTINCT n) = 1 AS equal_counts, min(n)::BIGINT AS fewest, max(n)::BIGINT AS most FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)",
)
def source_count_check(spark, folder):
    sizes = orders(spark, folder).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return sizes.agg(
        (F.min("n") == F.max("n")).alias("equal_counts"), F.min("n").alias("fewest"), F.max("n").alias("most")
    )


@query(
    "deficit_schedule",
    """WITH r AS (SELECT o_orderkey, o_orderstatus AS kind, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders),
    t AS (SELECT * FROM (VALUES ('F', 100, 1), ('O', 50, 2), ('P', 30, 3)) v(kind, target, place))
    SELECT o_orderkey, kind, row_number() OVER (ORDER BY (2 * k - 1) / (2.0 * target), place) AS slot FROM r JOIN t USING (kind) WHERE k <= target""",
)
def deficit_schedule(spark, folder):
    ranked = ranking.rank_within(orders(spark, folder), ["o_orderstatus"], [F.col("o_orderkey")], "k")
    kinds = ranked.select("o_orderkey", F.col("o_orderstatus").alias("kind"), "k")
    return ranking.deficit_schedule(kinds, "kind", "k", {"F": 100, "O": 50, "P": 30}).drop("k")


@query(
    "position_slice",
    "SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders) WHERE position BETWEEN 20 AND 900",
)
def position_slice(spark, folder):
    numbered = ranking.dense_index(orders(spark, folder).select("o_orderkey"), [F.col("o_orderkey")])
    return ranking.position_slice(numbered, "position", 20, 900)


@query(
    "spread_situations",
    f"""WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, {uniform_sql(3, "(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey)", 'spread')} AS u FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY u) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM l)
    SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (ORDER BY (k - 0.5)::DOUBLE / n, u) AS position FROM r""",
)
def spread_situations(spark, folder):
    rows = lines(spark, folder)
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    placed = ranking.spread_positions(rows, "l_suppkey", draws.uniform(3, key, "spread"))
    return placed.select("l_suppkey", "l_orderkey", "l_linenumber", "position")


@query("seeded_shuffle", f"SELECT o_orderkey, row_number() OVER (ORDER BY {uniform_sql(5, 'o_orderkey', 'sample')}) AS position FROM orders")
def seeded_shuffle(spark, folder):
    return sampling.seeded_order(orders(spark, folder).select("o_orderkey"), 5, "o_orderkey")


@query("seeded_sample", f"SELECT o_orderkey FROM orders ORDER BY {uniform_sql(5, 'o_orderkey', 'sample')} LIMIT 200")
def seeded_sample(spark, folder):
    return sampling.seeded_sample(orders(spark, folder).select("o_orderkey"), 200, 5, "o_orderkey")


@query(
    "two_pool_mix",
    f"""WITH u AS (SELECT o_orderkey, 'unmodified' AS source FROM orders WHERE o_orderstatus <> 'P' ORDER BY {uniform_sql(9, 'o_orderkey', 'mix/unmodified')} LIMIT 140),
    m AS (SELECT o_orderkey, 'modified' AS source FROM orders WHERE o_orderstatus = 'P' ORDER BY {uniform_sql(9, 'o_orderkey', 'mix/modified')} LIMIT 60)
    SELECT *, row_number() OVER (ORDER BY {uniform_sql(9, 'o_orderkey', 'mix/order')}) AS position FROM (SELECT * FROM u UNION ALL SELECT * FROM m)""",
)
def two_pool_mix(spark, folder):
    pool = orders(spark, folder).select("o_orderkey", "o_orderstatus")
    unmodified = pool.filter(F.col("o_orderstatus") != "P").select("o_orderkey")
    modified = pool.filter(F.col("o_orderstatus") == "P").select("o_orderkey")
    return sampling.two_pool_mix(unmodified, modified, 200, 30, 9, "o_orderkey")


@query(
    "mix_sizes_by_percent",
    """WITH p AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS m, count(*) FILTER (WHERE o_orderstatus <> 'P') AS u FROM orders),
    t AS (SELECT percent, floor(least(1000000, CASE WHEN percent > 0 THEN m * 100.0 / percent ELSE 1e18 END,
      CASE WHEN percent < 100 THEN u * 100.0 / (100 - percent) ELSE 1e18 END))::BIGINT AS total
      FROM p, (VALUES (0), (10), (35), (50), (90), (100)) v(percent))
    SELECT percent, round_even(total * percent / 100.0, 0)::BIGINT AS modified, total - round_even(total * percent / 100.0, 0)::BIGINT AS unmodified FROM t""",
)
def mix_sizes_by_percent(spark, folder):
    """The largest mixes of the two pools at several percentages."""
    is_modified = F.col("o_orderstatus") == "P"
    pools = orders(spark, folder).agg(F.count_if(is_modified).alias("modified"), F.count_if(~is_modified).alias("unmodified"))
    sizes = [
        sampling.mix_sizes(pools, 1_000_000, p).select(F.lit(p).alias("percent"), "modified", "unmodified") for p in (0, 10, 35, 50, 90, 100)
    ]
    out = sizes[0]
    for more in sizes[1:]:
        out = out.unionByName(more)
    return out


def _taken_sql(n: int, seed: int) -> str:
    """Situations of most rows' size, and one of the size that is left over, each first by hash."""
    return f"""WITH g AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey),
    b AS (SELECT size AS a FROM g GROUP BY size HAVING count(*) >= size ORDER BY size * count(*) DESC, size LIMIT 1),
    takes AS (SELECT a AS size, {n} // a AS take FROM b UNION ALL SELECT {n} % a, 1 FROM b WHERE {n} % a > 0),
    r AS (SELECT l_orderkey, size, row_number() OVER (PARTITION BY size ORDER BY {uniform_sql(seed, 'l_orderkey', 'group')}) AS k FROM g)
    SELECT l_orderkey, size AS rows FROM r JOIN takes USING (size) WHERE k <= take"""


def _situations_of(sample):
    return sample.groupBy("l_orderkey").agg(F.count("*").alias("rows"))


@query("exact_rows_whole_situations", _taken_sql(501, 4))
def exact_rows_whole_situations(spark, folder):
    return _situations_of(sampling.exact_rows(lines(spark, folder), 501, "l_orderkey", 4))


@query("capped_rows_whole_situations", _taken_sql(777, 4))
def capped_rows_whole_situations(spark, folder):
    return _situations_of(sampling.capped_rows(lines(spark, folder), 777, "l_orderkey", 4))


@query(
    "nearest_row_totals",
    """WITH c AS (SELECT count(*) FILTER (WHERE n = 4) AS fours, count(*) FILTER (WHERE n = 6) AS sixes FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)),
    t AS (SELECT DISTINCT 4 * i + 6 * j AS total FROM c, range(0, 140) a(i), range(0, 100) b(j) WHERE i <= fours AND j <= sixes)
    SELECT total::BIGINT AS total, abs(total - 501)::BIGINT AS distance FROM t WHERE total > 0 AND total <> 501 ORDER BY abs(total - 501), total LIMIT 6""",
)
def nearest_row_totals(spark, folder):
    """501 rows cannot be made of orders with four or six lines; the nearest totals that can."""
    rows = lines(spark, folder)
    sizes = rows.groupBy("l_orderkey").agg(F.count("*").alias("n")).filter(F.col("n").isin(4, 6))
    return sampling.nearest_feasible(rows.join(sizes, "l_orderkey", "left_semi"), 501, "l_orderkey")


@query(
    "quota_fill",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus IN ('F', 'P'))
    SELECT o_orderkey, o_orderstatus FROM r ORDER BY CASE WHEN k <= CASE o_orderstatus WHEN 'P' THEN 60 ELSE 40 END THEN 0 ELSE 1 END, o_orderkey LIMIT 150""",
)
def quota_fill(spark, folder):
    pool = orders(spark, folder).select("o_orderkey", "o_orderstatus")
    return sampling.quota_fill(pool, "o_orderstatus", {"P": 60, "F": 40}, 150, "o_orderkey")


@query(
    "rotated_labels",
    with_options(
        _SETS + "SELECT situation_id, low_best[1 + (13 + situation_id) % len(low_best)] AS label_number FROM bucketed"
    ),
)
def rotated_labels(spark, folder):
    rolled = sit.roll_up(sit.score(situations(spark, folder)))
    return rolled.select("situation_id", sampling.rotated_label(F.col("low_best"), 13, F.col("situation_id")).alias("label_number"))


@query(
    "label_situations",
    with_options(
        _SETS + "SELECT situation_id, list_transform(low_best, lambda v: CASE WHEN situation_id % 2 = 0 THEN chr(96 + v) ELSE v::VARCHAR END) AS correct_labels FROM bucketed"
    ),
)
def label_situations(spark, folder):
    scored = sit.score(situations(spark, folder))
    labels = sit.label_arrays(F.col("options"), F.col("situation_id") % 2 == 0)["cara_correct"]
    cells = scored.select("situation_id", F.to_json(labels).alias("CARA_correct_labels"))
    return cells.select("situation_id", text.best_labels([F.col("CARA_correct_labels")]).alias("correct_labels"))


@query(
    "sft_label_examples",
    with_options(
        _SETS
        + """SELECT situation_id, chr(96 + v) AS target_label, len(low_best) = 1 AS single FROM (SELECT *, unnest(low_best) AS v FROM bucketed)"""
    ),
)
def sft_label_examples(spark, folder):
    """One example per correct label; the rationale names the ties."""
    scored = sit.score(situations(spark, folder))
    labels = sit.label_arrays(F.col("options"), F.lit(True))["cara_correct"]
    rows = scored.select("situation_id", labels.alias("labels")).select("situation_id", "labels", F.explode_outer("labels").alias("target_label"))
    built = rows.withColumn("target", text.assistant_completion(F.col("target_label"), F.col("labels")))
    return built.select("situation_id", "target_label", F.col("target").contains(" is best.").alias("single"))


@query(
    "sft_examples_in_order",
    with_options(
        _SETS
        + f""", l AS (SELECT situation_id, chr(96 + v) AS target_label, len(low_best) = 1 AS single, {uniform_sql(4, "(situation_id || '-' || chr(96 + v))", 'spread')} AS u
            FROM (SELECT *, unnest(low_best) AS v FROM bucketed)),
        r AS (SELECT *, row_number() OVER (PARTITION BY situation_id ORDER BY u) AS k, count(*) OVER (PARTITION BY situation_id) AS n FROM l)
        SELECT situation_id, target_label, single, row_number() OVER (ORDER BY (k - 0.5)::DOUBLE / n, u) AS position FROM r"""
    ),
)
def sft_examples_in_order(spark, folder):
    """Training examples as they are fed: one per correct label, its completion, situations spread apart."""
    scored = sit.score(situations(spark, folder))
    labels = sit.label_arrays(F.col("options"), F.lit(True))["cara_correct"]
    rows = scored.select("situation_id", labels.alias("labels")).select("situation_id", "labels", F.explode_outer("labels").alias("target_label"))
    rows = rows.filter(F.col("target_label").isNotNull())  # a plain explode would read the costly labels once more to filter by them
    built = rows.withColumn("target", text.assistant_completion(F.col("target_label"), F.col("labels")))
    slim = built.select("situation_id", "target_label", F.col("target").contains(" is best.").alias("single"))
    key = F.concat_ws("-", "situation_id", "target_label")
    return ranking.spread_positions(slim, "situation_id", draws.uniform(4, key, "spread"))


_TURN = "(conv_id || '-' || turn)"


@query(
    "cot_examples_in_order",
    f"""WITH s AS (SELECT conv_id, turn, text, {uniform_sql(6, _TURN, 'spread')} AS u FROM conversations WHERE role = 'assistant' AND trim(text) <> ''
      ORDER BY {uniform_sql(6, _TURN, 'sample')} LIMIT 200),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY u) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM s)
    SELECT conv_id, turn, md5({COMPLETION_SQL}) AS target_md5, row_number() OVER (ORDER BY (k - 0.5)::DOUBLE / n, u) AS position FROM r""",
)
def cot_examples_in_order(spark, folder):
    """Training examples from reasoning: a seeded sample, its completions, turns of one conversation spread apart."""
    turns = table(spark, folder, "conversations").filter((F.col("role") == "assistant") & text.not_blank(F.col("text")))
    key = F.concat_ws("-", "conv_id", "turn")
    sampled = sampling.seeded_sample(turns.withColumn("key", key), 200, 6, "key")
    thought = F.concat("text", F.lit('\n{"answer": "b"}\n'))
    built = sampled.select(
        "conv_id", "turn", "key", F.md5(text.assistant_completion(F.lit("b"), F.array(F.lit("b")), thought)).alias("target_md5")
    )
    return ranking.spread_positions(built, "conv_id", draws.uniform(6, F.col("key"), "spread")).drop("key")


@query("sampled_ids", f"SELECT o_orderkey AS id FROM orders ORDER BY {uniform_sql(5, 'o_orderkey', 'sample')} LIMIT 300")
def sampled_ids(spark, folder):
    """The ids of a sample, stored beside a training set and read back."""
    path = shared_folder(spark, "sampled-ids") + ".jsonl"
    sample = sampling.seeded_sample(orders(spark, folder).select("o_orderkey"), 300, 5, "o_orderkey")
    writers.write_lines(sample.select(F.to_json(F.struct(F.col("o_orderkey").alias("id"))).alias("value")), path)
    return readers.read_tabular(spark, path, schema=T.StructType([T.StructField("id", T.LongType())]))


@query(
    "drop_bad_situations",
    """WITH b AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R' AND l_linenumber = 7) OR count(*) <> max(l_linenumber)
      OR count(DISTINCT l_returnflag) <> 1)
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM b)""",
)
def drop_bad_situations(spark, folder):
    rows = lines(spark, folder)
    ok = ~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7))
    own = rows.withColumn("want", F.array(F.lower("l_returnflag")))
    bad = sampling.incomplete_situations(own, "l_orderkey", [ok], "l_returnflag", F.col("want"), "l_linenumber")
    return rows.join(bad, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "load_cot_examples",
    """WITH c AS (SELECT min(doc_id) AS doc_id FROM documents d WHERE trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id // 4, text)
    SELECT doc_id, doc_id // 4 AS situation_id FROM c""",
)
def load_cot_examples(spark, folder):
    """Drop flagged rows, decode and trim texts, keep one row per situation and completion."""
    bad = table(spark, folder, "labels").filter(~text.ok_flag(F.col("toxic") == 0)).select("doc_id")
    rows = table(spark, folder, "documents").join(bad, "doc_id", "left_anti").select(
        "doc_id", F.floor(F.col("doc_id") / 4).alias("situation_id"), text.strip_blank(text.unescape(F.col("text"))).alias("completion")
    )
    kept = rows.filter(F.col("completion") != "")
    return ranking.keep_first(kept, ["situation_id", "completion"], "doc_id").select("doc_id", "situation_id")


@query(
    "mix_summary",
    """SELECT count(*) FILTER (l_returnflag = 'R')::BIGINT AS modified_examples, count(*) FILTER (l_returnflag = 'A')::BIGINT AS unmodified_examples,
    count(*) FILTER (l_returnflag NOT IN ('A', 'R'))::BIGINT AS other_examples, round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS actual_modified_pct_examples FROM lineitem""",
)
def mix_summary(spark, folder):
    source = F.when(F.col("l_returnflag") == "R", "Modified ").when(F.col("l_returnflag") == "A", "unmodified").otherwise("n")
    out = sampling.source_summary(lines(spark, folder).withColumn("source", source))
    return out.withColumn("actual_modified_pct_examples", F.round("actual_modified_pct_examples", 6))


@query(
    "training_manifest",
    "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS example_index, o_orderkey AS situation_id, o_orderstatus AS source FROM orders",
)
def training_manifest(spark, folder):
    rows = orders(spark, folder).select(F.col("o_orderkey").alias("situation_id"), F.col("o_orderstatus").alias("source"))
    return ranking.dense_index(rows, [F.col("situation_id")], "example_index", start=0)


@query("unmodified_pool", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unmodified_pool(spark, folder):
    modified = lines(spark, folder).filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders(spark, folder).select("o_orderkey").join(modified, "o_orderkey", "left_anti")


@query("labelled_documents", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labelled_documents(spark, folder):
    keep = table(spark, folder, "labels").filter(F.col("quality") == 1).select("doc_id")
    return table(spark, folder, "documents").select("doc_id", "lang").join(keep, "doc_id", "left_semi")


@query(
    "union_by_name",
    "SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier",
)
def union_by_name(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s, allowMissingColumns=True)


@query("shared_keys", "SELECT o_custkey AS custkey FROM orders INTERSECT SELECT c_custkey FROM customer")
def shared_keys(spark, folder):
    return orders(spark, folder).select(F.col("o_custkey").alias("custkey")).intersect(
        table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"))
    )


@query("keys_without_lines", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def keys_without_lines(spark, folder):
    return orders(spark, folder).select("o_orderkey").subtract(lines(spark, folder).select(F.col("l_orderkey").alias("o_orderkey")))


@query("distinct_situations", "SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem")
def distinct_situations(spark, folder):
    return lines(spark, folder).select("l_orderkey", "l_returnflag").distinct()


@query(
    "category_dimension",
    "SELECT n_nationkey, n_name, coalesce(r_name, 'other') AS category FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey",
)
def category_dimension(spark, folder):
    dim = table(spark, folder, "region").filter(F.col("r_regionkey") < 3).select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, folder, "nation").join(dim, "n_regionkey", "left").select(
        "n_nationkey", "n_name", F.coalesce("r_name", F.lit("other")).alias("category")
    )
