"""From raw documents to shards of training text, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.decontaminate import drop_contaminated
from weftline.llm.kd_shards import kd_shards
from weftline.llm.mixing import Mix, mix_sources
from weftline.llm.near_dup import drop_near_duplicates
from weftline.llm.quality import fit_quality, score_quality
from weftline.llm.queries import QUALITY_CUT, remainder, table
from weftline.session import persist_state

SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of at least QUALITY_CUT; labels are learnt from all of ``documents``."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    model = fit_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return score_quality(docs, model).where(F.col("score") >= QUALITY_CUT).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five-word shingles, 0.8)."""
    return drop_near_duplicates(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 3 times)."""
    mixed = mix_sources(docs, Mix()).where("repeats > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("_copy")
    return mixed.select(*docs.columns, copies).drop("_copy")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    return kd_shards(docs, shards=SHARDS)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist_state(stage(spark, docs, sf_dir), name)
    return docs
