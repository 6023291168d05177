"""Keyword search over a document table and its markdown listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slim.operators.render import joined

# Limits and texts of the listing.
MAX_RESULTS = 20
NO_RESULTS = "No results found."
WORD = r"[\p{L}\p{N}]+"


def words(col: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0)))


def _document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(word, weight)``: millionths of the logarithm of inverse document
    frequency, as whole numbers, so sums do not depend on their order. The
    corpus size is a scalar subquery."""
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = docs.select(F.explode(words(F.col("text"))).alias("word")).join(terms, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    return df.select("word", F.floor(F.log((total + 1) / (F.col("df") + 0.5)) * 1_000_000).cast("bigint").alias("weight"))


def search_topk(docs: DataFrame, queries: DataFrame, k: int = 10, weighted: bool = False) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: best ``k`` (1-20) documents.

    The score is the number of query words a document has, or with
    ``weighted`` the sum of their weights in millionths. Equal scores rank by
    document id. Documents are reduced to their distinct words before the join;
    only ids and words move, and the rank filter runs per task before the
    ranks are exchanged.
    """
    if not 1 <= k <= MAX_RESULTS:
        raise ValueError(f"k must be between 1 and {MAX_RESULTS}")
    terms = queries.select("query_id", F.col("lang").alias("want"), F.explode(words(F.col("query"))).alias("word"))
    score = F.count("*")
    if weighted:
        terms = terms.join(_document_frequencies(docs, terms.select("word").distinct()), "word")
        score = F.sum("weight")
    found = docs.select("doc_id", "lang", F.explode(words(F.col("text"))).alias("word"))
    hits = found.join(terms, "word").where(F.col("want").isNull() | (F.col("want") == F.col("lang")))
    scored = hits.groupBy("query_id", "doc_id").agg(score.alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "score")


def with_documents(ranked: DataFrame, docs: DataFrame, snippet_chars: int | None = None) -> DataFrame:
    """``(query_id, rank, title, url, snippet)`` of ranked documents. The
    snippet is the whole text on one line, or its first ``snippet_chars``."""
    line = F.regexp_replace("text", r"[ \t\r\n]+", " ")
    shown = docs.select("doc_id", "title", "url", (line if snippet_chars is None else F.substring(line, 1, snippet_chars)).alias("snippet"))
    return ranked.join(shown, "doc_id").select("query_id", "rank", "title", "url", "snippet")


def result_listing(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, listing)``: a numbered markdown list per query, or the
    message that nothing was found."""
    entry = F.concat(
        F.lit("### "), F.col("rank").cast("string"), F.lit(". ["), F.coalesce("title", F.lit("Untitled")), F.lit("]("),
        F.coalesce("url", F.lit("")), F.lit(")\n"), F.coalesce("snippet", F.lit("")), F.lit("\n"),
    )
    lists = hits.groupBy("query_id").agg(joined(entry, "rank", "\n").alias("body"))
    head = F.concat(F.lit("## Search results for: "), F.col("query"), F.lit("\n\n"))
    return queries.join(lists, "query_id", "left").select(
        "query_id", F.when(F.col("body").isNull(), F.lit(NO_RESULTS)).otherwise(F.concat(head, F.col("body"))).alias("listing")
    )
