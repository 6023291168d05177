"""Payload, page and log views made from the test tables.

Every view is a projection of one table: a payload is built from one input row,
so making the views needs no shuffle and no group grows with the data. The
same definitions are repeated in SQL by the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(payload_id, raw)``: every document as a JSON list with one object
    per line; templated links, blanks, nulls, empty lists, constant values and
    repeated sub-objects occur."""
    docs = table(spark, sf_dir, "documents")
    link = F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string"))
    items = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            (i + 1).alias("line"),
            line.alias("text"),
            F.char_length(line).alias("chars"),
            F.concat(link, F.lit("/"), i.cast("string"), F.lit("{/rev}")).alias("detail_url"),
            link.alias("link"),
            F.lit("  ").alias("note"),
            F.lit(None).cast("string").alias("gift"),
            F.array().cast("array<string>").alias("tags"),
            F.lit(False).alias("seen"),
            F.struct(F.col("source").alias("name"), F.col("lang").alias("lang")).alias("origin"),
            F.struct(F.floor(F.char_length(line) / 200).alias("band"), (F.char_length(line) > 500).alias("long")).alias(
                "shape"
            ),
        ),
    )
    return docs.select(
        F.col("doc_id").alias("payload_id"), F.to_json(items, {"ignoreNullFields": "false"}).alias("raw")
    )


def deep_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(payload_id, raw)``: every customer as an object below 25 to 40 lists,
    with a templated address and an empty member at the bottom."""
    c = table(spark, sf_dir, "customer")
    n = (F.lit(25) + F.col("c_custkey") % 16).cast("int")
    body = F.concat(F.lit('{"id":'), F.col("c_custkey").cast("string"), F.lit(',"u":"http://h/{x}","n":null}'))
    return c.select(F.col("c_custkey").alias("payload_id"), F.concat(F.repeat(F.lit("["), n), body, F.repeat(F.lit("]"), n)).alias("raw"))


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(payload_id, raw)``: every event as a deeply nested object with
    templated addresses at several depths and a dotted key that collides when
    the nested one is flattened."""
    ev = table(spark, sf_dir, "events")
    text = F.format_string(
        '{"event":{"id":%1$d,"who":{"user":{"id":%2$d,"card":{"home":"https://u.example.com/%2$d{?tab}",'
        '"mail":"u%2$d@example.com","none":null,"urls":["https://u.example.com/%2$d/{n}",""],'
        '"geo":{"x":%3$d,"y":null,"z":[{"q":%4$d,"r":null}]},"geo.x":%4$d}}},'
        '"what":{"type":"%5$s","props":%6$s,"pad":"","void":{},"deep":{"list":[null,[],{"e":null}]},'
        '"marks":[null,%1$d,"",[null,"%5$s"],{"n":null},"end"]}},'
        '"self":"https://e.example.com/%1$d{#part}","ok":false,"zero":0}',
        F.col("event_id"),
        F.col("user_id"),
        (F.col("event_id") % 90).cast("bigint"),
        (F.col("event_id") % 7).cast("bigint"),
        F.col("event_type"),
        F.col("props"),
    )
    return ev.select(F.col("event_id").alias("payload_id"), text.alias("raw"))


def mixed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(payload_id, raw)``: event properties, every 10th cut short and every
    7th replaced by plain text."""
    ev = table(spark, sf_dir, "events")
    raw = (
        F.when(F.col("event_id") % 10 == 0, F.expr("left(props, char_length(props) - 1)"))
        .when(F.col("event_id") % 7 == 0, F.concat(F.lit("event "), F.col("event_type")))
        .otherwise(F.col("props"))
    )
    return ev.select(F.col("event_id").alias("payload_id"), raw.alias("raw"))


def payload_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(payload_id, data)``: payload text given directly, by path, or in a
    wrapper; a few paths do not exist."""
    ev = table(spark, sf_dir, "events")
    path = F.concat(F.lit("/spill/"), (F.col("event_id") - F.col("event_id") % 3).cast("string"), F.lit(".json"))
    form = F.col("event_id") % 6
    data = (
        F.when(form == 0, F.concat(F.lit("  "), F.col("props"), F.lit(" ")))
        .when(form == 1, path)
        .when(form == 2, F.concat(F.lit('{"file": "'), path, F.lit('", "note": 1}')))
        .when(form == 3, F.concat(F.lit('{"result": "plain '), F.col("event_type"), F.lit(' "}')))
        .when(form == 4, F.concat(F.lit('{"result": " '), path, F.lit('"}')))
        .otherwise(F.concat(F.lit("/gone/"), F.col("event_id").cast("string")))
    )
    return ev.select(F.col("event_id").alias("payload_id"), data.alias("data"))


def spill_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``: one stored payload file per event; some are wrappers."""
    ev = table(spark, sf_dir, "events")
    content = F.when(
        F.col("event_id") % 2 == 0, F.concat(F.lit('{"result": "stored '), F.col("event_type"), F.lit('"}'))
    ).otherwise(F.col("props"))
    return ev.select(
        F.concat(F.lit("/spill/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"),
        content.alias("content"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(fetch_id, url, content_type, status, error, body)``: pages as HTML and event
    properties as JSON, some broken, some failed."""
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("fetch_id"),
        "url",
        F.when(F.col("page_id") % 11 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(F.col("page_id") % 13 == 0, 404).otherwise(200).alias("status"),
        F.when(F.col("page_id") % 17 == 0, "TimeoutException").alias("error"),
        F.col("html").alias("body"),
    )
    mixed = mixed_payloads(spark, sf_dir).select(
        F.concat(F.lit("e"), F.col("payload_id").cast("string")).alias("fetch_id"),
        F.concat(F.lit("https://api.example.com/e/"), F.col("payload_id").cast("string")).alias("url"),
        F.when(F.col("payload_id") % 4 == 0, "application/javascript").otherwise("application/json").alias("content_type"),
        F.when(F.col("payload_id") % 19 == 0, 503).otherwise(200).alias("status"),
        F.when(F.col("payload_id") % 23 == 0, "ConnectError").alias("error"),
        F.col("raw").alias("body"),
    )
    return pages.unionByName(mixed)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(req_id, url, headers, params, ts)``: events as requests; the header
    order alternates and a quarter has no headers."""
    ev = table(spark, sf_dir, "events")
    agent, lang = F.lit("agent"), F.lit("lang")
    user = F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))
    headers = (
        F.when(F.col("event_id") % 4 == 0, F.create_map(agent, user, lang, F.lit("en")))
        .when(F.col("event_id") % 4 == 1, F.create_map(lang, F.lit("en"), agent, user))
        .when(F.col("event_id") % 4 == 2, F.create_map(agent, user))
    )
    return ev.select(
        F.col("event_id").alias("req_id"),
        F.concat(F.lit("https://api.example.com/"), F.col("event_type")).alias("url"),
        headers.alias("headers"),
        F.create_map(F.lit("max_depth"), F.lit("5")).alias("params"),
        "ts",
    )


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, page_no, text)``: conversations as paged documents, every
    9th blank."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).alias("page_no"),
        F.when(F.col("conv_id") % 9 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("text"),
    )


def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, spec)``: page ranges in every form, some malformed."""
    specs = F.array(*[F.lit(s) for s in ("1-3", "2", "1, 4-5", "x-2", "3-1", "", "0,2-2,2")])
    return (
        table(spark, sf_dir, "conversations")
        .where("turn = 0")
        .select(F.col("conv_id").alias("doc_id"), F.get(specs, (F.col("conv_id") % 7).cast("int")).alias("spec"))
    )


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, url, text, lang)``; some titles are missing."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 5 != 0, F.get(F.split("text", "\n"), F.lit(0))).alias("title"),
        F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        "text",
        "lang",
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, query, lang)``: the first three words of the benchmark
    texts; every fourth is restricted to one language."""
    words = F.slice(F.split("text", r"[ \n]"), 1, 3)
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.array_join(words, " ").alias("query"),
        F.when(F.col("item_id") % 4 == 0, F.lit("en")).alias("lang"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, ts, source, raw_chars, opt_chars)``: events as size records;
    one source is empty and some inputs have no characters."""
    ev = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 50 == 0, F.lit(0)).otherwise((F.col("event_id") * 37) % 4001).cast("bigint")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("fetch:"), F.col("event_type"))).alias("source"),
        raw.alias("raw_chars"),
        F.when(raw == 0, 0).otherwise((F.col("event_id") * 11) % 2003).cast("bigint").alias("opt_chars"),
    )
