"""Fetched responses of any type, slimmed: the route decides the work, every
answer ends in one size record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slim.functions.text import MAX_CHARS, MAX_DEPTH, source_label, truncate_text
from slim.operators.ledger import measure
from slim.operators.markup import to_markdown
from slim.plans.optimize import optimize_payloads
from slim.sources.pages import outcome_class, outcome_message, pdf_fallback, route_by_content


def slim_responses(
    fetch_log: DataFrame, prefix: str, max_depth: int = MAX_DEPTH, max_chars: int = MAX_CHARS, pdf_texts: DataFrame | None = None,
    with_metadata: bool = False, path: list | None = None, expression: str | None = None,
) -> DataFrame:
    """``(fetch_id, url, route, note, text, source, raw_chars, opt_chars, ...)``:
    one row for every fetch in ``(fetch_id, url, content_type, status, error,
    body)``.

    JSON answers are optimised, narrowed by ``path`` if one is given; pages are
    rendered as markdown, ``with_metadata`` behind their front matter, and so
    are JSON answers that could not be read (note ``invalid_json``). PDF answers
    take their text from ``pdf_texts`` (url, text); one without has note
    ``no_text``. A failed fetch has route ``error`` and its message as text.
    """
    outcome = outcome_class(F.col("status"), F.col("error"))
    failed = fetch_log.where(outcome != "ok").select(
        "fetch_id", "url", F.lit("error").alias("route"), F.lit("failed").alias("note"), F.lit(0).cast("bigint").alias("raw_chars"),
        F.lit(0).cast("bigint").alias("opt_chars"), outcome_message(F.col("status"), F.col("error"), F.col("url")).alias("text"),
    )
    routed = route_by_content(fetch_log.where(outcome == "ok"))
    as_json = routed.where("route = 'json'").select(
        F.struct("fetch_id", "url").alias("payload_id"), F.col("body").alias("raw")
    )
    slim_json = optimize_payloads(as_json, path, expression, max_depth=max_depth, max_chars=max_chars).select(
        "payload_id.fetch_id", "payload_id.url", F.lit("json").alias("route"), F.lit("").alias("note"),
        "raw_chars", "opt_chars", "text",
    )
    as_pages = routed.where("route = 'html'").select(
        F.struct("fetch_id", "note").alias("page_id"), "url", F.col("body").alias("html")
    )
    slim_html = to_markdown(as_pages, max_chars, with_metadata).select(
        "page_id.fetch_id", "url", F.lit("html").alias("route"), "page_id.note",
        "raw_chars", F.char_length("markdown").cast("bigint").alias("opt_chars"), F.col("markdown").alias("text"),
    )
    as_pdf = routed.where("route = 'pdf'").select("fetch_id", "url", F.char_length("body").cast("bigint").alias("raw_chars"))
    if pdf_texts is None:
        as_pdf = as_pdf.withColumn("text", F.lit(None).cast("string"))
    else:
        as_pdf = as_pdf.join(pdf_texts.select("url", truncate_text(F.col("text"), max_chars).alias("text")), "url", "left")
    slim_pdf = as_pdf.select(
        "fetch_id", "url", F.lit("pdf").alias("route"), F.when(F.col("text").isNull(), "no_text").otherwise("").alias("note"),
        "raw_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("opt_chars"), "text",
    )
    every = slim_json.unionByName(slim_html).unionByName(slim_pdf).unionByName(failed)
    return measure(every).withColumn("source", source_label(prefix, F.col("url")))


def size_records(slimmed: DataFrame) -> DataFrame:
    """The ledger rows of slimmed responses; JSON that could not be read, PDF
    without text and failed fetches are not recorded."""
    return slimmed.where("note = ''").select("fetch_id", "source", "raw_chars", "opt_chars", "saved_chars", "saved_pct")


def pdf_answers(fetch_log: DataFrame, texts: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``(url, text)`` for addresses asked for as PDF: the extracted text from
    ``texts(url, text)`` where the answer was a PDF, markdown with a note where
    it was not."""
    routed = fetch_log.withColumn(
        "is_pdf", F.coalesce(F.col("content_type").contains("pdf"), F.lit(False))
    )
    pdf = routed.where("is_pdf").select("url").join(texts, "url").select("url", "text")
    pages = routed.where("not is_pdf").select(F.col("url").alias("page_id"), "url", F.col("body").alias("html"))
    md = to_markdown(pages, max_chars).select("url", pdf_fallback(F.col("markdown")).alias("text"))
    return pdf.unionByName(md)
