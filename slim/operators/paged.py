"""Paged documents: page selection, document text, documents without text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slim.functions.text import MAX_CHARS, is_blank, strip, truncate_text
from slim.operators.render import joined

# The forms of one part of a page range, and the messages.
SINGLE_PAGE = r"^\s*(\+?\d+)\s*$"
PAGE_SPAN = r"^\s*(\+?\d+)\s*-\s*(\+?\d+)\s*$"
BAD_RANGE = "Error: Invalid page range format. Use e.g. '1-5' or '3'."
CHUNK_PAGES = 1024


def page_ranges(specs: DataFrame) -> DataFrame:
    """``(doc_id, ranges, valid)`` from specs such as ``1-5,8``. NULL ranges
    mean every page: no spec, or one that names no page at all."""
    part = F.split("spec", ",")
    lo = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, PAGE_SPAN, 1), F.lit("")), F.regexp_extract(p, SINGLE_PAGE, 1))
    hi = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, PAGE_SPAN, 2), F.lit("")), F.regexp_extract(p, SINGLE_PAGE, 1))
    ranges = F.transform(
        part, lambda p: F.struct(lo(p).try_cast("bigint").alias("lo"), hi(p).try_cast("bigint").alias("hi"))
    )
    given = F.col("spec").isNotNull() & (F.col("spec") != "")
    valid = ~given | F.forall(part, lambda p: p.rlike(SINGLE_PAGE) | p.rlike(PAGE_SPAN))
    named = F.filter(ranges, lambda r: r["lo"] <= r["hi"])
    return specs.select("doc_id", F.when(given & valid & (F.size(named) > 0), named).alias("ranges"), valid.alias("valid"))


def select_pages(page_text: DataFrame, specs: DataFrame) -> DataFrame:
    """Pages named by the spec of their document; without a spec all pages.
    The ranges of a spec travel as one array, so the join has one row per page
    and no page is found twice."""
    ranges = page_ranges(specs)
    wanted = F.col("ranges").isNull() | F.exists("ranges", lambda r: F.col("page_no").between(r["lo"], r["hi"]))
    return (
        page_text.join(ranges, "doc_id", "left")
        .where(F.coalesce("valid", F.lit(True)) & wanted)
        .select("doc_id", "page_no", "text")
    )


def bad_specs(specs: DataFrame) -> DataFrame:
    return page_ranges(specs).where(~F.col("valid")).select("doc_id", F.lit(BAD_RANGE).alias("error"))


def document_text(page_text: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``(doc_id, text)``: pages joined in order, stripped, truncated.

    The sizes of page chunks tell which chunks can reach into the first
    ``max_chars`` characters. Only their text is joined per document, however
    many pages it has; the chunks themselves are joined apart from each other.
    """
    pages = page_text.select(
        "doc_id", F.floor(F.col("page_no") / CHUNK_PAGES).alias("chunk"), "page_no", F.coalesce("text", F.lit("")).alias("text")
    )
    sizes = pages.groupBy("doc_id", "chunk").agg(
        F.sum(F.char_length("text")).alias("len"), F.min(is_blank(F.col("text"))).alias("blank")
    )
    w = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Nothing is counted up to and including the first chunk with text, as its
    # leading whitespace goes; that keeps at most one chunk too many.
    counted = sizes.withColumn("own", F.when(F.coalesce(F.min("blank").over(w), F.lit(True)), 0).otherwise(F.col("len")))
    reach = counted.withColumn("kept", F.coalesce(F.sum("own").over(w), F.lit(0)) <= max_chars)
    any_dropped = F.max(~F.col("kept") & ~F.col("blank")).over(Window.partitionBy("doc_id"))
    kept = reach.withColumn("more", any_dropped).where("kept").select("doc_id", "chunk", "more")
    docs = (
        pages.join(kept, ["doc_id", "chunk"])
        .groupBy("doc_id", "chunk", "more")
        .agg(joined(F.col("text"), "page_no").alias("part"))
        .groupBy("doc_id")
        .agg(F.max("more").alias("more"), joined(F.col("part"), "chunk").alias("text"))
    )
    lead_free = F.regexp_replace("text", r"(?U)^[\s\x{1c}-\x{1f}]+", "")
    return docs.select(
        "doc_id",
        F.when(F.col("more"), truncate_text(lead_free, max_chars)).otherwise(truncate_text(strip(F.col("text")), max_chars)).alias("text"),
    )


def no_text_documents(page_text: DataFrame) -> DataFrame:
    """Documents without any text, with their page count and the warning."""
    docs = page_text.groupBy("doc_id").agg(
        F.min(F.coalesce(is_blank(F.col("text")), F.lit(True))).alias("blank"), F.count("*").alias("pages")
    )
    warning = F.concat(
        F.lit("Warning: No extractable text found in PDF ("),
        F.col("pages").cast("string"),
        F.lit(" pages). May be scanned. Consider using browser_fetch with OCR if available."),
    )
    return docs.where("blank").select("doc_id", "pages", warning.alias("warning"))
