"""Comparison tables: sizes of the variants, totals and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slim.functions.text import saved_permille, token_estimate


def token_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Token estimates of text columns: ``{text column: output column}``."""
    return df.select(
        *[c for c in df.columns if c not in columns], *[token_estimate(F.col(c)).alias(o) for c, o in columns.items()]
    )


def compare_variants(df: DataFrame, raw: str = "raw", pruned: str = "pruned", schema: str = "schema") -> DataFrame:
    """Adds ``best`` (the smaller variant), ``schema_shown`` (``n/a`` when it
    is no separate variant), ``saved`` and ``saved_permille``."""
    best = F.least(F.col(pruned), F.col(schema))
    return (
        df.withColumn("best", best)
        .withColumn("schema_shown", F.when(F.col(schema) != F.col(pruned), F.col(schema).cast("string")).otherwise("n/a"))
        .withColumn("saved", F.col(raw) - best)
        .withColumn("saved_permille", saved_permille(F.col(raw), best))
    )


def comparison_totals(compared: DataFrame, name: str = "name", raw: str = "raw", best: str = "best") -> DataFrame:
    """Sums per name and over everything (TOTAL)."""
    sums = compared.rollup(name).agg(
        F.grouping(name).cast("int").alias("is_total"),
        F.count("*").alias("n"),
        F.sum(raw).alias("raw"),
        F.sum(best).alias("best"),
    )
    return sums.select(
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col(name)).alias("name"),
        "is_total",
        "n",
        "raw",
        "best",
        (F.col("raw") - F.col("best")).alias("saved"),
        saved_permille(F.col("raw"), F.col("best")).alias("saved_permille"),
    )


def cost_summary(totals: DataFrame, prices: list[tuple[str, float]]) -> DataFrame:
    """Money saved at each price per million units. The price list is short
    and fixed, so it becomes literals on every total row."""
    rows = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(p).cast("decimal(18,6)").alias("usd_per_million")) for m, p in prices]
    )
    return totals.where("is_total = 1").select("saved", F.inline(rows)).select(
        "model",
        "usd_per_million",
        "saved",
        (F.col("saved").cast("decimal(20,0)") * F.col("usd_per_million")).alias("micro_usd"),
    )
