"""The corpus pipeline: documents to packed training windows, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slim.llm.common import row_hash, stored
from slim.llm.darts import near_duplicates
from slim.llm.mixing import mix_sources
from slim.llm.packing import pack
from slim.llm.quality import quality_verdicts
from slim.llm.suffix import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MAX_REPEATS = 1.5


def _same(docs: DataFrame, ids: DataFrame):
    """Joins rows to decisions about (id, hash); null ids are ids."""
    return F.col("doc_id").eqNullSafe(ids["_id"]) & (docs["_h"] == ids["_hash"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    kept = quality_verdicts(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"))
    rows = docs.select(*COLUMNS, row_hash("lang", "source", "text").alias("_h"))
    return rows.join(kept, _same(rows, kept), "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the least id; of rows
    equal in id and text one. A null text has no duplicates and stays."""
    judged = near_duplicates(docs)
    kept = judged.where(F.col("first") & F.col("text_hash").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(*COLUMNS, F.unhex(F.sha2("text", 256)).alias("_h"))
    chosen = rows.join(kept, _same(rows, kept), "left_semi").dropDuplicates(["doc_id", "_h"])
    return chosen.select(*COLUMNS).unionByName(docs.where(F.col("text").isNull()).select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that a document with a smaller id has are cut out;
    every document stays, if need be with an empty text."""
    cut = remove_repeats(docs, 50, carry=["lang", "source"], as_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("bigint").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is read at least once; small sources are read again in
    part until tempered weights are met, up to MAX_REPEATS times as often as the
    largest. Rows come out in the order of the mixture's blocks."""
    plan = mix_sources(docs, max_repeats=MAX_REPEATS).select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "block", "slot")
    rows = docs.select(*COLUMNS, row_hash("source", "text").alias("_h"))
    read = rows.join(plan, _same(rows, plan)).repartitionByRange("block", "slot")
    return read.sortWithinPartitions("block", "slot").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens, each with the sources in proportion."""
    return pack(docs, 2048).drop("tokens")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mix),
    ("packing", packed),
]

# Robust covariance, signatures, byte suffixes and BPE are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i + 1}")
    return docs
