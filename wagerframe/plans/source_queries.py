"""Sources and sinks: tables are written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagerframe.plans.registry import query, table
from wagerframe.session import save, shared_folder
from wagerframe.sources import catalog, readers, writers
from wagerframe.sources.versions import VersionedTable
from wagerframe.streaming import jobs


@query(
    "csv_round_trip",
    """SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS lang, coalesce(md5(text), md5('')) AS text_md5, n_chars::VARCHAR AS n_chars FROM documents""",
)
def csv_round_trip(spark, folder):
    """Whole texts, with quotes and line breaks, through a quoted CSV file read as raw cells; a nameless column goes."""
    path = shared_folder(spark, "documents") + ".csv"
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text", "n_chars")
    writers.write_csv(docs.withColumn("Unnamed: 0", F.col("doc_id")), path)
    read = readers.drop_unnamed(readers.read_tabular(spark, path, raw=True))
    read = readers.require_columns(read, ["doc_id", "text"], ["lang", "language"])
    return read.select("doc_id", "lang", F.md5("text").alias("text_md5"), "n_chars")


@query("csv_typed", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_typed(spark, folder):
    """Typed cells through CSV under a schema."""
    path = shared_folder(spark, "customers") + ".csv"
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    writers.write_csv(rows, path)
    return readers.read_csv(spark, path, rows.schema)


@query(
    "json_rows_round_trip",
    """SELECT 'lines' AS layout, conv_id, turn, role, md5(coalesce(text, '')) AS text_md5 FROM conversations
    UNION ALL SELECT 'rows', n_nationkey, n_regionkey, n_name, md5(n_name) FROM nation""",
)
def json_rows_round_trip(spark, folder):
    """Conversations as JSON lines, nations as the ``rows`` of one JSON object."""
    turns = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    lines = shared_folder(spark, "turns") + ".jsonl"
    writers.write_lines(turns.select(F.to_json(F.struct("*")).alias("value")), lines)
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("conv_id"), F.col("n_regionkey").cast("long").alias("turn"), F.col("n_name").alias("role"), F.col("n_name").alias("text")
    )
    listed = shared_folder(spark, "nations") + ".json"
    whole = nations.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("rows"))).alias("value"))  # 25 rows
    writers.write_lines(whole, listed)
    read = [readers.read_tabular(spark, path, schema=turns.schema).withColumn("layout", F.lit(name)) for name, path in (("lines", lines), ("rows", listed))]
    return read[0].unionByName(read[1]).select("layout", "conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query(
    "json_list_in_splits",
    "SELECT doc_id, lang, md5(coalesce(text, '')) AS text_md5, true AS several_tasks FROM documents",
)
def json_list_in_splits(spark, folder):
    """Documents as one JSON list in one file, read by several tasks."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long"), "lang", "text")
    path = shared_folder(spark, "documents-list")
    readers.write_indented_list(docs, path)
    key, size = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "256k")
    try:
        read = readers.read_indented_list(spark, path, docs.schema)
        digest = F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")
        tasks = save(read.select("doc_id", "lang", digest, F.spark_partition_id().alias("task")), "read-list")
    finally:
        spark.conf.set(key, size)
    used = tasks.agg(F.count_distinct("task") > 1).scalar()
    return tasks.select("doc_id", "lang", "text_md5", used.alias("several_tasks"))


@query(
    "run_results_round_trip",
    "SELECT s_suppkey AS example, s_nationkey AS run, s_acctbal AS score FROM supplier",
)
def run_results_round_trip(spark, folder):
    """One run file per nation; results of every second one stand under ``resume_records``."""
    schema = T.StructType([T.StructField("example", T.LongType()), T.StructField("run", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("long").alias("example"), F.col("s_nationkey").cast("long").alias("run"), F.col("s_acctbal").cast("double").alias("score")
    )
    # a run file is one object by its format: a run's results are few
    files = rows.groupBy("run").agg(F.collect_list(F.struct("example", "run", "score")).alias("r")).select(
        F.when(F.col("run") % 2 == 0, F.to_json(F.struct(F.col("r").alias("results")))).otherwise(
            F.to_json(F.struct(F.col("r").alias("resume_records")))
        ).alias("value")
    )
    path = shared_folder(spark, "runs")
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_run_results(spark, path, schema)


@query(
    "published_versions",
    """SELECT 1 AS version, count(*)::BIGINT AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 2, count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 9, count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderstatus = 'O'""",
)
def published_versions(spark, folder):
    """Two versions of a table, the second one current (9) although a third write failed half-way."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    place = VersionedTable(spark, shared_folder(spark, "published"))
    place.publish(orders.filter("o_orderstatus = 'F'"))
    place.publish(orders.filter("o_orderstatus = 'O'"), replace=True)
    for broken in (
        orders,  # refused: there is a version
        orders.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 97 == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("o_orderkey"))),
    ):
        try:
            place.publish(broken, replace=broken is not orders)
        except Exception as error:  # noqa: BLE001  (whatever the writer met, readers keep the second version)
            if broken is orders and "replace=True" not in str(error):
                raise
        else:
            raise AssertionError("a refused or broken write became a version")
    facts = [F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys")]
    read = [place.read(v).agg(*facts).withColumn("version", F.lit(n)) for v, n in ((1, 1), (2, 2), (None, 9))]
    return read[0].unionByName(read[1]).unionByName(read[2]).select("version", "rows", "keys")


_PAIR_LISTS = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Ties' WHEN doc_id % 3 = 1 THEN 'Focus' ELSE 'Other' END AS subset,
  CASE WHEN doc_id % 3 = 0 THEN 'tied:' || doc_id ELSE doc_id::VARCHAR END AS id, 1 + doc_id % 2 AS chosen, 1 + doc_id % 4 AS rejected FROM documents WHERE doc_id % 3 < 2)"""


@query(
    "best_of_items",
    _PAIR_LISTS
    + """, t AS (SELECT doc_id, subset, CASE WHEN subset = 'Ties' THEN 'tied' END AS sample_type, CASE WHEN subset = 'Ties' THEN doc_id::VARCHAR END AS prompt_id,
      CASE WHEN subset = 'Ties' THEN chosen ELSE 1 END AS correct, (CASE WHEN subset = 'Ties' THEN chosen ELSE 1 END) + rejected AS items FROM d)
    SELECT doc_id, subset, sample_type, prompt_id, unnest(range(items))::INT AS candidate_idx, unnest(range(items)) < correct AS is_correct FROM t""",
)
def best_of_items(spark, folder):
    """Lists of chosen and rejected texts as one row per text to score."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "Ties").when(F.col("doc_id") % 3 == 1, "Focus").otherwise("Other").alias("subset"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("tied:"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string")).alias("id"),
        F.array_repeat(F.lit("good"), (1 + F.col("doc_id") % 2).cast("int")).alias("chosen"),
        F.array_repeat(F.lit("bad"), (1 + F.col("doc_id") % 4).cast("int")).alias("rejected"),
        F.col("text").alias("prompt"),
        F.lit(None).cast("int").alias("num_correct"),
        F.col("doc_id").alias("row_idx"),
    )
    items = readers.best_of_items(readers.read_best_of(docs, ["Ties", "Focus"]))
    return items.select(F.col("row_idx").alias("doc_id"), "subset", "sample_type", "prompt_id", "candidate_idx", "is_correct")


@query(
    "catalog_datasets",
    "SELECT 'orders_' || lower(o_orderstatus) AS dataset, count(*)::BIGINT AS rows, NULL::BIGINT AS budget FROM orders GROUP BY o_orderstatus",
)
def catalog_datasets(spark, folder):
    """Data sets by name: registered paths are read with the reader of their kind."""
    known = catalog.Catalog(spark)
    parts = []
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        path = shared_folder(spark, f"orders-{status}") + ".parquet"
        orders.filter(F.col("o_orderstatus") == status).write.parquet(path)
        known.add(f"orders_{status.lower()}", path)
        found, _, _ = known.resolve(f"orders_{status.lower()}")
        rows = readers.read_tabular(spark, found).agg(F.count("*").alias("rows"))
        budget = known.budget(f"orders_{status.lower()}")
        parts.append(rows.select(F.lit(f"orders_{status.lower()}").alias("dataset"), "rows", F.lit(budget).cast("long").alias("budget")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "resume_differences",
    """SELECT a.n_nationkey AS nation, k.setting, CASE k.setting WHEN 'seed' THEN a.n_nationkey::VARCHAR ELSE a.n_regionkey::VARCHAR END AS stored,
      CASE k.setting WHEN 'seed' THEN b.n_nationkey::VARCHAR ELSE b.n_regionkey::VARCHAR END AS current
    FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1, (VALUES ('seed'), ('dataset')) k(setting)
    WHERE a.n_nationkey < 4 AND (k.setting = 'seed' OR a.n_regionkey <> b.n_regionkey)""",
)
def resume_differences(spark, folder):
    """Settings that changed from one run to the next, of the first five runs."""
    nation = save(table(spark, folder, "nation").select("n_nationkey", "n_regionkey", "n_name"), "settings")

    def settings(key):
        return nation.filter(F.col("n_nationkey") == key).select(
            F.col("n_nationkey").cast("string").alias("seed"), F.col("n_regionkey").cast("string").alias("dataset"), F.lit("same").alias("backend")
        )

    parts = [jobs.config_differences(settings(k), settings(k + 1)).withColumn("nation", F.lit(k).cast("long")) for k in range(4)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("nation", "setting", "stored", "current")


@query(
    "complete_runs",
    """SELECT c_nationkey AS run, count(*) FILTER (c_acctbal < 0) = 0 AS complete FROM customer WHERE c_nationkey < 3 GROUP BY c_nationkey""",
)
def complete_runs(spark, folder):
    """Whether every required section of a run's ledger is filled; an overdrawn account leaves its section empty."""
    ledger = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("run"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance")
    )
    runs = [r["run"] for r in ledger.filter("run < 3").select("run").distinct().collect()]
    told = [(run, jobs.is_complete(ledger.filter(F.col("run") == run), ["name", "balance"])) for run in sorted(runs)]
    return spark.createDataFrame(told, "run long, complete boolean")
