"""The corpus pipeline: quality rules, exact and near copies, a source mix, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
returns a DataFrame; every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wagerframe.llm.exact_dedup import DigestIndex, drop_exact_copies
from wagerframe.llm.mixing import mixed_documents
from wagerframe.llm.near_dedup import drop_near_duplicates
from wagerframe.llm.packing import pack
from wagerframe.llm.quality import drop_low_quality
from wagerframe.llm.shared import save, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that it rejects go."""
    return drop_low_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, against an index of this run: one document of each group of equal texts stays."""
    return drop_exact_copies(docs, DigestIndex(spark, shared_folder(spark, "digest-index")), "documents")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each component stays."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents come as often as the mix takes them."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of the mixed documents in sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: The last stage needs a tokenizer, which SQL has not; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
