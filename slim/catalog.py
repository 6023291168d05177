"""One query per operator over the test tables.

Each takes ``(spark, folder)`` and returns a DataFrame with flat, aliased
columns. All of them run over their whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slim import fixtures as fx
from slim.functions.sql import register_functions
from slim.functions.text import is_template_url, ord_text, path_text, request_key, source_label, token_estimate, truncate_text
from slim.operators import compare, fresh, ledger, markup, paged, paths, profile, prune, search, select
from slim.operators.factor import factor_items, fingerprints, shared_objects, uniform_values
from slim.operators.leaves import nesting_depth, parse, parse_payloads, payload_leaves
from slim.operators.paths import Any, Descend, Index, Key, Slice, Where
from slim.operators.render import rebuild
from slim.operators.select import Css
from slim.plans.optimize import evaluate_corpus, optimize_payloads
from slim.plans.responses import pdf_answers, size_records, slim_responses
from slim.session import configure, shared_folder
from slim.sources.ledger import append_ledger, read_ledger
from slim.sources.pages import fetch_outcomes, page_table, route_by_content
from slim.sources.payloads import payload_table, resolve_refs
from slim.streaming.streams import read_leaves, savings_report_stream, ttl_dedup_stream, write_leaves

Query = Callable[[SparkSession, str], DataFrame]

DAY = 86_400
HALF_HOUR = 1_800
PRICES = [("small", 3.0), ("large", 15.0)]
DOCUMENT = ("doc", "copy")  # what tells documents with one id apart
NAV_LINKS = [[Css("nav"), " ", Css("a")]]


def _leaf_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "payload_id", path_text(F.col("steps")).alias("path"), ord_text(F.col("ord")).alias("ord"), "kind", "scalar"
    )


def _matches(leaves: DataFrame, path: list, label: str) -> DataFrame:
    found = paths.match_values(paths.select_path(leaves, path))
    return found.select(F.lit(label).alias("path"), "payload_id", "match_path", F.col("text").alias("value"))


# Sources, routing, sinks

def payload_scan(spark, d):
    rows = payload_table(fx.doc_payloads(spark, d))
    return rows.select("payload_id", F.char_length("raw").cast("bigint").alias("raw_chars"), F.sha2("raw", 256).alias("raw_hash"))


def page_scan(spark, d):
    return page_table(spark, f"{d}/pages.parquet").select("page_id", "url", F.char_length("html").cast("bigint").alias("chars"))


def reference_resolution(spark, d):
    return resolve_refs(fx.payload_refs(spark, d), fx.spill_files(spark, d)).select("payload_id", "raw")


def content_routes(spark, d):
    return route_by_content(fx.fetch_log(spark, d)).groupBy("route", "note").agg(F.count("*").alias("n"))


def fetch_outcome_report(spark, d):
    return fetch_outcomes(fx.fetch_log(spark, d))


def _measured(spark, d):
    return ledger.measure(fx.ledger(spark, d))


def ledger_round_trip(spark, d):
    path = shared_folder(spark, "ledger")
    append_ledger(_measured(spark, d).where("seq % 2 = 0"), path)
    append_ledger(_measured(spark, d).where("seq % 2 = 1"), path)
    return read_ledger(spark, path).select(
        "seq", F.unix_micros("ts").alias("ts_us"), "source", "raw_chars", "opt_chars", "saved_chars"
    )


def numbered_records(spark, d):
    """Responses slimmed, recorded in two appends, and read again."""
    path = shared_folder(spark, "ledger")
    for kind in ("p", "e"):
        log = fx.fetch_log(spark, d).where(F.col("fetch_id").startswith(kind))
        append_ledger(size_records(slim_responses(log, "smart_fetch")), path, ["fetch_id"])
    return read_ledger(spark, path).select("seq", "source", "raw_chars", F.col("ts").isNotNull().alias("dated"))


# JSON trees

def parse_split(spark, d):
    good, bad = parse_payloads(fx.mixed_payloads(spark, d))
    return good.select("payload_id", F.lit("").alias("error")).unionByName(bad.select("payload_id", "error"))


def leaf_table(spark, d):
    return _leaf_rows(payload_leaves(fx.doc_payloads(spark, d)))


def path_child(spark, d):
    rows = paths.select_static(parse(fx.event_payloads(spark, d)), [Key("event"), Key("who"), Key("user"), Key("id")])
    return rows.select("payload_id", F.col("v").cast("bigint").alias("value"))


def path_wildcard(spark, d):
    return _matches(payload_leaves(fx.doc_payloads(spark, d)), [Any(), Key("origin"), Key("name")], "$[*].origin.name")


def path_positions(spark, d):
    rows = payload_leaves(fx.doc_payloads(spark, d))
    parts = [
        ("$[0].chars", [Index(0), Key("chars")]),
        ("$[-1].chars", [Index(-1), Key("chars")]),
        ("$[1:3].line", [Slice(1, 3), Key("line")]),
        ("$[-2:].line", [Slice(-2, None), Key("line")]),
    ]
    out = None
    for label, path in parts:
        part = _matches(rows, path, label)
        out = part if out is None else out.unionByName(part)
    return out


def path_item_filter(spark, d):
    return _matches(
        payload_leaves(fx.doc_payloads(spark, d)), [Where("chars", ">", 500), Key("shape")], "$[?@.chars>500].shape"
    )


def path_descend(spark, d):
    return _matches(payload_leaves(fx.event_payloads(spark, d)), [Descend("id")], "$..id")


def path_collapse(spark, d):
    docs = fx.doc_payloads(spark, d)
    found = paths.select_path(payload_leaves(docs), [Where("chars", ">", 500), Key("line")])
    return paths.collapse_matches(found, docs, "$[?@.chars>500].line")


def template_urls_dropped(spark, d):
    return _leaf_rows(prune.drop_template_urls(payload_leaves(fx.event_payloads(spark, d)))).drop("ord")


def empties_dropped(spark, d):
    return _leaf_rows(prune.drop_empty(payload_leaves(fx.doc_payloads(spark, d)))).drop("ord", "scalar")


def surviving_containers(spark, d):
    return prune.surviving_containers(payload_leaves(fx.event_payloads(spark, d))).select("payload_id", "path")


def positions_compacted(spark, d):
    rows = prune.compact_positions(prune.clean(payload_leaves(fx.event_payloads(spark, d))))
    return _leaf_rows(rows)


def flattened_below(spark, d):
    rows = prune.flatten_below(payload_leaves(fx.event_payloads(spark, d)), 4)
    return _leaf_rows(rows)


def _clean_docs(spark, d):
    return prune.clean(payload_leaves(fx.doc_payloads(spark, d)))


def uniform_value_keys(spark, d):
    return uniform_values(_clean_docs(spark, d)).drop(*DOCUMENT)


def object_fingerprints(spark, d):
    return fingerprints(_clean_docs(spark, d)).drop("text", *DOCUMENT)


def shared_object_registry(spark, d):
    return shared_objects(fingerprints(_clean_docs(spark, d))).drop(*DOCUMENT)


def factored_items(spark, d):
    return factor_items(_clean_docs(spark, d)).drop(*DOCUMENT)


def schema_gate(spark, d):
    return profile.is_uniform_array(parse(fx.doc_payloads(spark, d))).select("payload_id", "n_items", "gate")


def type_labels(spark, d):
    rows = paths.select_static(parse(fx.event_payloads(spark, d)), [Key("event"), Key("what")]).alias("t")
    members = rows.lateralJoin(spark.tvf.variant_explode(F.col("t.v").outer()).alias("e"))
    return members.select("t.payload_id", F.col("e.key").alias("key"), profile.type_label(F.col("e.value")).alias("type"))


def first_item_schema(spark, d):
    return profile.first_item_schema(parse(fx.doc_payloads(spark, d)))


def corpus_schema_profile(spark, d):
    return profile.schema_profile(parse(fx.doc_payloads(spark, d))).drop("approx_values")


def head_samples(spark, d):
    rows = profile.sample_items(parse(fx.doc_payloads(spark, d)))
    return rows.select(
        "payload_id", F.col("item").cast("bigint").alias("item"), F.variant_get("v", "$.text", "string").alias("text")
    )


def schema_summaries(spark, d):
    return profile.schema_summary(parse(fx.doc_payloads(spark, d)))


def rebuilt_text(spark, d):
    return rebuild(payload_leaves(fx.doc_payloads(spark, d))).select("payload_id", F.sha2("text", 256).alias("text_hash"))


def truncated_text(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        truncate_text(F.col("text"), 500, "json").alias("json_text"),
        truncate_text(F.col("text"), 1000, "text").alias("plain_text"),
    )


def optimized_payloads(spark, d):
    return optimize_payloads(fx.doc_payloads(spark, d)).drop("saved_pct")


def optimized_by_path(spark, d):
    rows = optimize_payloads(
        fx.doc_payloads(spark, d), [Where("chars", ">", 500), Key("line")], "$[?@.chars>500].line", max_chars=1000
    )
    return rows.drop("saved_pct")


def slimmed_responses(spark, d):
    rows = slim_responses(fx.fetch_log(spark, d), "smart_fetch")
    return rows.select("fetch_id", "route", "note", "source", "raw_chars", (F.col("opt_chars") > 0).alias("answered"))


def failed_responses(spark, d):
    return slim_responses(fx.fetch_log(spark, d), "smart_fetch").where("route = 'error'").select("fetch_id", "text")


def deep_leaves(spark, d):
    return payload_leaves(fx.deep_payloads(spark, d)).select("payload_id", F.size("steps").cast("bigint").alias("levels"), "kind", "scalar")


def deep_descend(spark, d):
    return _matches(payload_leaves(fx.deep_payloads(spark, d)), [Descend("id")], "$..id").select("payload_id", "value")


def deep_optimized(spark, d):
    rows = optimize_payloads(fx.deep_payloads(spark, d), max_chars=None)
    return rows.select("payload_id", "mode", F.regexp_replace("text", r"\s", "").alias("text"))


def depth_of_payloads(spark, d):
    parsed = parse(fx.deep_payloads(spark, d))
    return parsed.select("payload_id", nesting_depth(F.col("v")).cast("bigint").alias("depth"))


# Pages

def _pages(spark, d):
    return page_table(spark, f"{d}/pages.parquet")


def page_tokens(spark, d):
    return markup.markup_tokens(_pages(spark, d)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "kind", "tag", F.char_length("token").cast("bigint").alias("chars")
    )


def page_elements(spark, d):
    return markup.element_spans(_pages(spark, d)).select(
        "page_id", "tag", F.col("open_pos").cast("bigint").alias("open_pos"), F.col("close_pos").cast("bigint").alias("close_pos")
    )


def noise_dropped(spark, d):
    kept = markup.drop_noise(markup.page_nodes(_pages(spark, d)))
    return kept.select("page_id", F.inline("nodes")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "kind", "tag")


def page_visible_text(spark, d):
    return markup.visible_text(markup.drop_noise(markup.page_nodes(_pages(spark, d))))


def page_markdown(spark, d):
    return markup.to_markdown(_pages(spark, d), max_chars=5000)


def page_markdown_with_metadata(spark, d):
    return markup.to_markdown(_pages(spark, d), max_chars=None, with_metadata=True).select("page_id", "markdown")


def page_meta(spark, d):
    return markup.page_metadata(_pages(spark, d))


def elements_simple(spark, d):
    rows = select.select_elements(_pages(spark, d), [[Css(classes=("ad",))], [Css("h1")], [Css("a", attr="href")]])
    return rows.select("page_id", F.col("open_pos").cast("bigint").alias("open_pos"), "tag")


def elements_combined(spark, d):
    rows = select.select_elements(
        _pages(spark, d), [NAV_LINKS[0], [Css("ul"), ">", Css("li")], [Css("article"), ">", Css("p"), " ", Css("b")]]
    )
    return rows.select("page_id", F.col("open_pos").cast("bigint").alias("open_pos"), "tag")


def css_fragments(spark, d):
    return select.css_query(_pages(spark, d), NAV_LINKS, "nav a", 1000)


def css_fragments_rendered(spark, d):
    return select.css_query(_pages(spark, d), [[Css(classes=("ad",))], [Css("h1")]], ".ad, h1", 1000, rendered=True)


def repeated_blocks_by_host(spark, d):
    return markup.boilerplate_blocks(markup.text_blocks(_pages(spark, d)), 2)


def repeated_blocks(spark, d):
    return markup.boilerplate_blocks(markup.text_blocks(_pages(spark, d)), 2, by=())


def pages_without_boilerplate(spark, d):
    blocks = markup.text_blocks(_pages(spark, d))
    kept = markup.strip_boilerplate(blocks, markup.boilerplate_blocks(blocks, 2, by=()), by=())
    return kept.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.sum(F.char_length("block")).alias("chars"))


# Paged documents

def pages_selected(spark, d):
    rows = paged.select_pages(fx.page_text(spark, d), fx.page_specs(spark, d))
    return rows.select("doc_id", "page_no", F.char_length("text").cast("bigint").alias("chars"))


def page_specs_rejected(spark, d):
    return paged.bad_specs(fx.page_specs(spark, d))


def paged_document_text(spark, d):
    return paged.document_text(fx.page_text(spark, d), 2000)


def documents_without_text(spark, d):
    return paged.no_text_documents(fx.page_text(spark, d))


def pdf_addresses_answered(spark, d):
    """Pages asked for as PDF: extracted text where the answer was one, else the page with a note."""
    log = fx.fetch_log(spark, d).where("fetch_id like 'p%'")
    own = _pages(spark, d).select("page_id", "url").where("page_id % 11 = 0")
    texts = own.join(paged.document_text(fx.page_text(spark, d), 2000), F.col("page_id") == F.col("doc_id")).select("url", "text")
    return pdf_answers(log, texts, 2000)


# Search

def search_hits(spark, d):
    rows = search.search_topk(fx.search_docs(spark, d), fx.search_queries(spark, d), 10)
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


def search_hits_weighted(spark, d):
    rows = search.search_topk(fx.search_docs(spark, d), fx.search_queries(spark, d), 10, weighted=True)
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


def search_listing(spark, d):
    docs, queries = fx.search_docs(spark, d), fx.search_queries(spark, d)
    hits = search.with_documents(search.search_topk(docs, queries, 5), docs)
    return search.result_listing(hits, queries)


# Freshness

def _keyed_requests(spark, d):
    r = fx.requests(spark, d)
    return r.select("req_id", "url", "ts", request_key(F.col("url"), F.col("headers"), F.col("params")).alias("key"))


def request_keys(spark, d):
    return _keyed_requests(spark, d).select("req_id", "key")


def _served(spark, d):
    keyed = _keyed_requests(spark, d)
    # Every fifth request wrote an answer, with a lifetime of its own.
    stored = keyed.where("req_id % 5 = 0").select(
        "key",
        F.col("ts").alias("stored_at"),
        (F.lit(600) + (F.col("req_id") % 7) * 900).cast("bigint").alias("ttl"),
        F.concat(F.lit("answer "), F.col("req_id").cast("string")).alias("content"),
        (F.col("req_id") % 1000).alias("raw_chars"),
    )
    return fresh.fresh_lookup(keyed.where("req_id % 5 != 0").select("req_id", "url", "key", "ts"), stored)


def fresh_answers(spark, d):
    found = _served(spark, d)
    return found.select("req_id", "hit", F.unix_micros("stored_at").alias("stored_us"), "content", "raw_chars")


def cache_hit_savings(spark, d):
    return ledger.savings_report(fresh.hit_records(_served(spark, d))).drop("saved_pct")


def kept_events(spark, d):
    rows = fresh.ttl_dedup(fx.table(spark, d, "events"), "user_id", "ts", DAY, "event_id")
    return rows.select("user_id", F.unix_micros("kept_at").alias("kept_us"), "first_id")


def labelled_hits(spark, d):
    ev = fx.table(spark, d, "events").select("event_id", "event_type", "ts")
    rows = fresh.label_hits(ev, "event_type", "ts", HALF_HOUR, "event_id")
    return rows.select("event_id", F.unix_micros("kept_at").alias("kept_us"), "hit")


# Ledger and comparison

def size_measures(spark, d):
    return _measured(spark, d).select("seq", "raw_chars", "opt_chars", "saved_chars", "saved_permille")


def source_labels(spark, d):
    p = _pages(spark, d)
    return p.select("page_id", source_label("smart_fetch", F.col("url")).alias("source"))


def savings_by_source(spark, d):
    return ledger.savings_report(fx.ledger(spark, d)).drop("saved_pct")


def recent_records(spark, d):
    return ledger.recent_entries(fx.ledger(spark, d)).drop("saved_pct")


def token_estimates(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def _page_sizes(spark, d):
    md = markup.to_markdown(_pages(spark, d), max_chars=None)
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return md.select(
        host.alias("name"), "page_id", F.col("raw_chars").alias("raw"),
        F.char_length("markdown").cast("bigint").alias("pruned"), F.lit(None).cast("bigint").alias("schema"),
    )


def variants_compared(spark, d):
    sizes = _page_sizes(spark, d).withColumn(
        "schema", F.when(F.col("page_id") % 3 == 0, F.col("pruned")).otherwise((F.col("raw") / 4).cast("bigint"))
    )
    return compare.compare_variants(sizes).drop("name")


def payload_tokens_compared(spark, d):
    """Tokens of every payload as it is, pruned, and as a summary."""
    sizes = evaluate_corpus(fx.doc_payloads(spark, d), tokens=True)
    rows = sizes.select("payload_id", *[F.col(f"{v}_tokens").cast("bigint").alias(v) for v in ("raw", "pruned", "schema")])
    return compare.compare_variants(rows)


def comparison_table(spark, d):
    sizes = _page_sizes(spark, d)
    return compare.comparison_totals(sizes, best="pruned")


def comparison_cost(spark, d):
    cost = compare.cost_summary(compare.comparison_totals(_page_sizes(spark, d), best="pruned"), PRICES)
    return cost.select("model", "saved", F.col("micro_usd").cast("bigint").alias("micro_usd"))


def corpus_eval(spark, d):
    return evaluate_corpus(fx.doc_payloads(spark, d))


# Streams: run to the end of the input, results read back from the sink

def _file_stream(spark, d, name):
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _run(spark, stream: DataFrame, name: str) -> DataFrame:
    out, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def kept_events_stream(spark, d):
    rows = ttl_dedup_stream(_file_stream(spark, d, "events"), "user_id", "ts", "event_id", DAY, "2 days")
    out = _run(spark, rows, "kept")
    return out.select("user_id", F.unix_micros("kept_at").alias("kept_us"), "first_id")


def savings_by_source_stream(spark, d):
    ev = _file_stream(spark, d, "events")
    raw = F.when(F.col("event_id") % 50 == 0, F.lit(0)).otherwise((F.col("event_id") * 37) % 4001).cast("bigint")
    led = ev.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("fetch:"), F.col("event_type"))).alias("source"),
        raw.alias("raw_chars"),
        F.when(raw == 0, 0).otherwise((F.col("event_id") * 11) % 2003).cast("bigint").alias("opt_chars"),
    )
    rows = savings_report_stream(led)
    out, state = shared_folder(spark, "report"), shared_folder(spark, "report-state")

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        rows.writeStream.foreachBatch(store).option("checkpointLocation", state)
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    updates = spark.read.parquet(out)
    latest = updates.groupBy("source").agg(F.max_by(F.struct("calls", "raw_chars", "opt_chars"), "batch").alias("r"))
    return latest.select("source", "r.*")


def _stream_leaves(payloads: DataFrame) -> DataFrame:
    out, state = shared_folder(payloads.sparkSession, "leaves"), shared_folder(payloads.sparkSession, "leaves-state")
    write_leaves(payloads, out, state).trigger(availableNow=True).start().awaitTermination()
    return read_leaves(payloads.sparkSession, out, payloads.schema["payload_id"].dataType)


def leaves_streamed(spark, d):
    ev = _file_stream(spark, d, "events")
    return _leaf_rows(_stream_leaves(ev.select(F.col("event_id").alias("payload_id"), F.col("props").alias("raw")))).drop("ord")


def deep_leaves_streamed(spark, d):
    payloads, source = fx.deep_payloads(spark, d), shared_folder(spark, "deep")
    payloads.write.parquet(source)
    return _leaf_rows(_stream_leaves(spark.readStream.schema(payloads.schema).parquet(source))).drop("ord")


# SQL functions

def sql_scalars(spark, d):
    register_functions(spark)
    fx.table(spark, d, "documents").createOrReplaceTempView("slim_documents")
    return spark.sql(
        """SELECT doc_id, is_template_url(concat('https://x.example.com/', lang, '{', source, '}')) AS templated,
                  is_blank(left(text, 1)) AS blank, saved_permille(n_chars, doc_id) AS permille,
                  truncate_text(text, 100, 'json') AS head,
                  request_key(lang, map('b', source, 'a', lang), NULL) AS key
           FROM slim_documents"""
    )


def sql_children(spark, d):
    register_functions(spark)
    parse(fx.event_payloads(spark, d)).createOrReplaceTempView("slim_events")
    return spark.sql(
        """SELECT payload_id, c.key, CAST(c.pos AS BIGINT) AS pos
           FROM slim_events, LATERAL children(variant_get(v, '$.event', 'variant')) c"""
    )


QUERIES: dict[str, Query] = {
    "s1_payload_scan": payload_scan,
    "s2_page_scan": page_scan,
    "s3_reference_resolution": reference_resolution,
    "s4_content_routes": content_routes,
    "s5_fetch_outcomes": fetch_outcome_report,
    "s6_s7_ledger_round_trip": ledger_round_trip,
    "s6_numbered_records": numbered_records,
    "j1_parse_split": parse_split,
    "j2_leaf_table": leaf_table,
    "j2_deep_leaves": deep_leaves,
    "j2_nesting_depth": depth_of_payloads,
    "j7_deep_descend": deep_descend,
    "j26_deep_payloads": deep_optimized,
    "j3_path_child": path_child,
    "j4_path_wildcard": path_wildcard,
    "j5_path_positions": path_positions,
    "j6_path_item_filter": path_item_filter,
    "j7_path_descend": path_descend,
    "j8_path_collapse": path_collapse,
    "j9_template_urls_dropped": template_urls_dropped,
    "j10_empties_dropped": empties_dropped,
    "j11_surviving_containers": surviving_containers,
    "j12_positions_compacted": positions_compacted,
    "j13_flattened_below": flattened_below,
    "j14_uniform_values": uniform_value_keys,
    "j15_fingerprints": object_fingerprints,
    "j16_shared_objects": shared_object_registry,
    "j17_factored_items": factored_items,
    "j18_schema_gate": schema_gate,
    "j19_type_labels": type_labels,
    "j20_first_item_schema": first_item_schema,
    "j21_schema_profile": corpus_schema_profile,
    "j22_head_samples": head_samples,
    "j23_schema_summaries": schema_summaries,
    "j24_rebuilt_text": rebuilt_text,
    "j25_truncated_text": truncated_text,
    "j26_optimized_payloads": optimized_payloads,
    "j26_optimized_by_path": optimized_by_path,
    "smart_responses": slimmed_responses,
    "smart_failures": failed_responses,
    "h1_page_tokens": page_tokens,
    "h2_page_elements": page_elements,
    "h3_noise_dropped": noise_dropped,
    "h4_visible_text": page_visible_text,
    "h5_markdown": page_markdown,
    "h6_markdown_with_metadata": page_markdown_with_metadata,
    "h6_page_metadata": page_meta,
    "h7_elements_simple": elements_simple,
    "h8_elements_combined": elements_combined,
    "h9_css_fragments": css_fragments,
    "h9_css_fragments_rendered": css_fragments_rendered,
    "h10_repeated_blocks_by_host": repeated_blocks_by_host,
    "h10_repeated_blocks": repeated_blocks,
    "h10_pages_without_boilerplate": pages_without_boilerplate,
    "p1_pages_selected": pages_selected,
    "p1_page_specs_rejected": page_specs_rejected,
    "p2_document_text": paged_document_text,
    "p3_documents_without_text": documents_without_text,
    "p3_pdf_answers": pdf_addresses_answered,
    "q1_search_hits": search_hits,
    "q1_search_hits_weighted": search_hits_weighted,
    "q2_search_listing": search_listing,
    "c1_request_keys": request_keys,
    "c2_fresh_answers": fresh_answers,
    "c2_cache_hit_savings": cache_hit_savings,
    "c3_kept_events": kept_events,
    "c4_labelled_hits": labelled_hits,
    "l1_size_measures": size_measures,
    "l2_source_labels": source_labels,
    "l3_savings_by_source": savings_by_source,
    "l4_recent_records": recent_records,
    "b1_token_estimates": token_estimates,
    "b2_variants_compared": variants_compared,
    "b2_payload_tokens": payload_tokens_compared,
    "b3_comparison_totals": comparison_table,
    "b4_comparison_cost": comparison_cost,
    "b5_corpus_eval": corpus_eval,
    "t1_kept_events_stream": kept_events_stream,
    "t2_savings_stream": savings_by_source_stream,
    "t3_leaves_stream": leaves_streamed,
    "t3_deep_leaves_stream": deep_leaves_streamed,
    "u1_sql_scalars": sql_scalars,
    "u2_sql_children": sql_children,
}


def queries() -> dict[str, Query]:
    def bound(fn: Query) -> Query:
        return lambda spark, sf_dir: fn(configure(spark), sf_dir)

    return {name: bound(fn) for name, fn in QUERIES.items()}
