"""Crawled pages and fetch logs: scan, routing by content, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slim.operators.large import is_large

# Substrings of the content type that decide the route.
JSON_TYPES = ("json", "javascript")
PDF_TYPE = "pdf"


def page_table(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """``(page_id, url, html)`` from Parquet, or from a folder of HTML files."""
    if binary:
        files = spark.read.format("binaryFile").load(path)
        return files.select(
            F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.col("content").cast("string").alias("html")
        )
    return spark.read.parquet(path).select("page_id", "url", "html")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def is_json_content(content_type: Column) -> Column:
    found = F.lit(False)
    for part in JSON_TYPES:
        found = found | content_type.contains(part)
    return F.coalesce(found, F.lit(False))


def route_by_content(responses: DataFrame) -> DataFrame:
    """Adds ``route`` (json, html or pdf) and ``note``: ``invalid_json`` where
    a JSON answer could not be read and falls back to HTML."""
    declared = is_json_content(F.col("content_type"))
    # A text too large for a VARIANT is JSON all the same.
    valid = F.when(is_large(F.col("body")), F.get_json_object("body", "$").isNotNull()).otherwise(F.try_parse_json("body").isNotNull())
    return responses.withColumn(
        "route",
        F.when(declared & valid, "json")
        .when(~declared & F.coalesce(F.col("content_type").contains(PDF_TYPE), F.lit(False)), "pdf")
        .otherwise("html"),
    ).withColumn("note", F.when(declared & ~valid, "invalid_json").otherwise(""))


def outcome_class(status: Column, error: Column) -> Column:
    return (
        F.when(error.contains("Timeout"), "timeout")
        .when(error.isNotNull(), "error")
        .when((status < 200) | (status >= 300), "http")
        .otherwise("ok")
    )


def outcome_message(status: Column, error: Column, detail: Column) -> Column:
    """Fixed value: the error texts shown for a failed fetch; NULL if it worked."""
    kind = outcome_class(status, error)
    return (
        F.when(kind == "timeout", F.concat(F.lit("Error: Request timed out — "), detail))
        .when(kind == "http", F.concat(F.lit("Error: HTTP "), status.cast("string"), F.lit(" — "), detail))
        .when(kind == "error", F.concat(F.lit("Error: "), error, F.lit(" — "), detail))
    )


def browser_note(status: Column, text: Column) -> Column:
    """Rendered pages answered with an error status carry it as a first line."""
    return F.when(status >= 400, F.concat(F.lit("HTTP status from browser: "), status.cast("string"), F.lit("\n\n"), text)).otherwise(text)


def pdf_fallback(text: Column) -> Column:
    """Text of a page that was asked for as PDF but is not one."""
    return F.concat(F.lit("Note: URL did not return a PDF. Returning HTML content instead.\n\n"), text)


def fetch_outcomes(fetch_log: DataFrame) -> DataFrame:
    """Counts by host, outcome class and status. The counts are combined
    before the shuffle, so a busy host is one row per task."""
    return (
        fetch_log.select(
            host_of(F.col("url")).alias("host"),
            outcome_class(F.col("status"), F.col("error")).alias("outcome"),
            F.when(F.col("error").isNull(), F.col("status")).alias("status"),
        )
        .groupBy("host", "outcome", "status")
        .agg(F.count("*").alias("n"))
    )


