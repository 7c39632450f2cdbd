"""Documents to packed training sequences: each stage is one operator, written as Parquet before the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that
stay, the last one the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import saved
from rillflow.llm.decontaminate import decontaminated
from rillflow.llm.minhash import near_duplicates
from rillflow.llm.packing import packed
from rillflow.llm.quality import filtered
from rillflow.llm.suffixes import without_repeats


def _counted(docs: DataFrame) -> DataFrame:
    """The stated length follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rejected documents, and without lines that many documents of a host share."""
    return _counted(filtered(docs))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without byte strings that an earlier document holds as well."""
    return _counted(without_repeats(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages, and without documents that mostly consist of them."""
    return _counted(decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules), ("minhash_dedup", minhash_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("pack", pack),
]

#: Stages of this kind are beyond SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
