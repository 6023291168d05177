"""Size records and the savings report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slim.functions.text import known_source, saved_pct, saved_permille

RECENT = 10
RECENT_SOURCE_CHARS = 20


def measure(df: DataFrame, raw: str = "raw_chars", opt: str = "opt_chars") -> DataFrame:
    """Adds ``saved_chars``, ``saved_pct`` (one decimal) and
    ``saved_permille`` (whole thousandths); an empty input saves nothing."""
    return (
        df.withColumn("saved_chars", F.col(raw) - F.col(opt))
        .withColumn("saved_pct", saved_pct(F.col(raw), F.col(opt)))
        .withColumn("saved_permille", saved_permille(F.col(raw), F.col(opt)))
    )


def savings_report(ledger: DataFrame) -> DataFrame:
    """Calls and sizes by source, with a TOTAL row, sources ascending."""
    rows = ledger.select(known_source(F.col("source")).alias("source"), "raw_chars", "opt_chars")
    sums = rows.rollup("source").agg(
        F.grouping("source").cast("int").alias("is_total"),
        F.count("*").alias("calls"),
        F.coalesce(F.sum("raw_chars"), F.lit(0)).alias("raw_chars"),
        F.coalesce(F.sum("opt_chars"), F.lit(0)).alias("opt_chars"),
    )
    named = sums.withColumn("source", F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("source")))
    return measure(named).orderBy("is_total", "source")


def recent_entries(ledger: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` records in append order, oldest of them first."""
    last = ledger.orderBy(F.desc("seq")).limit(n)
    shown = measure(last)
    return shown.select(
        "seq",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.substring(F.coalesce("source", F.lit("")), 1, RECENT_SOURCE_CHARS).alias("source"),
        "raw_chars",
        "opt_chars",
        "saved_pct",
        "saved_permille",
    ).orderBy("seq")
