"""Freshness, ledger, paged documents, search, sources, functions, streams."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slim.functions import text
from slim.functions.sql import register_functions
from slim.operators import compare, fresh, ledger, paged, search
from slim.plans.responses import pdf_answers, size_records, slim_responses
from slim.sources.ledger import append_ledger, broken_lines, read_ledger
from slim.sources.pages import fetch_outcomes, outcome_message, page_table, route_by_content
from slim.sources.payloads import payload_table, resolve_refs
from slim.streaming.streams import leaves_stream, read_leaves, savings_report_stream, ttl_dedup_stream, write_leaves

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def kept_by_hand(times, ttl):
    due, kept = None, []
    for t in sorted(set(times)):
        if due is None or t >= due:
            kept.append(t)
            due = t + ttl
    return kept


@pytest.mark.parametrize("slices", [1, 2, 16])
def test_ttl_dedup_with_a_hot_key(spark, slices):
    rng = random.Random(slices)
    rows = [("hot", rng.randint(0, 20_000)) for _ in range(3000)]
    rows += [(f"k{rng.randint(0, 20)}", rng.randint(0, 20_000)) for _ in range(600)]
    rows += [("edge", t) for t in (0, 60, 119, 120, 179, 180, 960, 1020)] + [("one", 5)]
    df = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(rows)], "id int, k string, ts timestamp")
    got = {}
    for r in fresh.ttl_dedup(df, "k", "ts", 60, "id", slices).collect():
        got.setdefault(r.k, []).append(int((r.kept_at - START).total_seconds()))
        assert rows[r.first_id][1] == got[r.k][-1]
    want = {k: kept_by_hand([t for key, t in rows if key == k], 60) for k, _ in rows}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_labels(spark):
    times = [0, 10, 59, 60, 61, 200]
    df = spark.createDataFrame([(i, "k", at(t)) for i, t in enumerate(times)], "id int, k string, ts timestamp")
    rows = {r.id: r.hit for r in fresh.label_hits(df, "k", "ts", 60, "id").collect()}
    assert rows == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False}


@pytest.mark.parametrize("width", [7, 100, 100_000])
def test_fresh_lookup(spark, width):
    rng = random.Random(width)
    stored = {(rng.choice("ab"), rng.randint(0, 900)): rng.randint(1, 120) for _ in range(60)}
    asked = [(i, rng.choice("abc"), rng.randint(0, 1000)) for i in range(300)]
    responses = spark.createDataFrame(
        [(k, at(t), ttl, f"{k}{t}", 1) for (k, t), ttl in stored.items()],
        "key string, stored_at timestamp, ttl long, content string, raw_chars long",
    )
    requests = spark.createDataFrame([(i, k, at(t)) for i, k, t in asked], "id int, key string, ts timestamp")
    got = {r.id: r.content if r.hit else None for r in fresh.fresh_lookup(requests, responses, width).collect()}
    for i, k, t in asked:
        before = [s for key, s in stored if key == k and s <= t]
        last = max(before, default=None)
        want = f"{k}{last}" if last is not None and t < last + stored[(k, last)] else None
        assert got[i] == want, (k, t)


def test_request_key(spark):
    df = spark.sql(
        "SELECT request_key_col.* FROM (SELECT 1) LATERAL VIEW inline(array("
        "named_struct('u','x','h',map('A','1','B','2')), named_struct('u','x','h',map('B','2','A','1')),"
        "named_struct('u','x','h',map('A','2')), named_struct('u','y','h',map()), "
        "named_struct('u','y','h',CAST(NULL AS MAP<STRING,STRING>)))) request_key_col AS u, h"
    )
    keys = [r[0] for r in df.select(text.request_key(F.col("u"), F.col("h"), F.lit(None).cast("map<string,string>"))).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] == keys[4] and len(set(keys)) == 3


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql(
        """SELECT is_template_url('https://a/{x}') a, is_template_url('https://a/{}') b, is_template_url('ftp://a/{x}') c,
           is_blank('  ') d, is_blank('x') e, saved_pct(0, 5) f, saved_pct(3, 1) g, truncate_text('abcdef', 3, 'text') h,
           request_key('u', map('b', '1', 'a', '2'), NULL) = request_key('u', map('a', '2', 'b', '1'), map()) i"""
    ).collect()[0]
    assert tuple(row) == (True, False, False, True, False, 0.0, 66.7, "abc\n\n[... truncated]", True)
    rows = spark.sql("""SELECT c.key, CAST(c.value AS STRING) v FROM (SELECT parse_json('{"a":1,"b":[2]}') v) t, LATERAL children(t.v) c""").collect()
    assert [tuple(r) for r in rows] == [("a", "1"), ("b", "[2]")]


def ledger_rows(spark):
    return spark.createDataFrame(
        [(1, at(1), "cli", 100, 40), (2, at(2), "", 0, 0), (3, at(3), None, 10, 20), (4, at(4), "cli", 100, 60)],
        "seq long, ts timestamp, source string, raw_chars long, opt_chars long",
    )


def test_report_and_recent(spark):
    rows = [(r.source, r.calls, r.raw_chars, r.opt_chars, r.saved_chars, r.saved_pct) for r in ledger.savings_report(ledger_rows(spark)).collect()]
    assert rows == [("cli", 2, 200, 100, 100, 50.0), ("unknown", 2, 10, 20, -10, -100.0), ("TOTAL", 4, 210, 120, 90, 42.9)]
    last = ledger.recent_entries(ledger_rows(spark), 2).collect()
    assert [(r.seq, r.at, r.source) for r in last] == [(3, "2024-01-01 00:00:03", ""), (4, "2024-01-01 00:00:04", "cli")]


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    append_ledger(ledger.measure(ledger_rows(spark)), path)
    append_ledger(ledger.measure(ledger_rows(spark)).limit(1), path)
    (tmp_path / "ledger" / "extra.json").write_text('\n\n{"source":"x","raw_chars":5,"opt_chars":1}\nbroken\n')
    assert read_ledger(spark, path).count() == 6


def test_comparison(spark):
    df = spark.createDataFrame([("a", 100, 50, 20), ("b", 10, 10, 10), ("a", 0, 0, 0)], "name string, raw long, pruned long, schema long")
    rows = [(r.best, r.schema_shown, r.saved_permille) for r in compare.compare_variants(df).collect()]
    assert rows == [(20, "20", 800), (10, "n/a", 0), (0, "n/a", 0)]
    totals = compare.comparison_totals(compare.compare_variants(df))
    assert {r.name: (r.n, r.raw, r.best) for r in totals.collect()} == {"a": (2, 100, 20), "b": (1, 10, 10), "TOTAL": (3, 110, 30)}
    costs = {r.model: float(r.micro_usd) for r in compare.cost_summary(totals, [("m", 3.0)]).collect()}
    assert costs == {"m": 240.0}


def test_page_ranges(spark):
    pages = spark.createDataFrame([(d, p, f"{d}.{p}") for d in range(8) for p in range(1, 6)], "doc_id int, page_no int, text string")
    specs = spark.createDataFrame(
        [(0, "1-2,5"), (1, " 3 "), (2, "3-"), (3, "-3"), (4, "5-3"), (5, ""), (6, "0,9-12"), (7, "1-2-3")], "doc_id int, spec string"
    )
    got = {}
    for r in paged.select_pages(pages, specs).collect():
        got.setdefault(r.doc_id, []).append(r.page_no)
    assert {d: sorted(p) for d, p in got.items()} == {0: [1, 2, 5], 1: [3], 4: [1, 2, 3, 4, 5], 5: [1, 2, 3, 4, 5]}
    assert {r.doc_id for r in paged.bad_specs(specs).collect()} == {2, 3, 7}


def test_long_documents(spark, monkeypatch):
    monkeypatch.setattr(paged, "CHUNK_PAGES", 3)
    rng = random.Random(1)
    docs = {d: [rng.choice([" ", "\n", "ab", " cd ", "efg", ""]) for _ in range(rng.randint(1, 30))] for d in range(60)}
    df = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc_id int, page_no int, text string")
    got = {r.doc_id: r.text for r in paged.document_text(df, 12).collect()}
    for d, ts in docs.items():
        whole = "".join(ts).strip()
        assert got[d] == (whole[:12] + "\n\n[... truncated]" if len(whole) > 12 else whole), ts
    blank = {r.doc_id: r.pages for r in paged.no_text_documents(df).collect()}
    assert blank == {d: len(ts) for d, ts in docs.items() if not "".join(ts).strip()}


def test_search(spark):
    docs = spark.createDataFrame(
        [(1, None, "u1", "red fox, red", "en"), (2, "B", "u2", "the red FOX jumps", "de"), (3, "C", None, "nothing", "en")],
        "doc_id int, title string, url string, text string, lang string",
    )
    queries = spark.createDataFrame([(1, "Red fox jumps", None), (2, "red", "en"), (3, "absent", None)], "query_id int, query string, lang string")
    top = search.search_topk(docs, queries, 2)
    assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in top.collect()) == [(1, 1, 2, 3), (1, 2, 1, 2), (2, 1, 1, 1)]
    weighted = search.search_topk(docs, queries, 1, weighted=True).collect()
    assert {(r.query_id, r.doc_id) for r in weighted} == {(1, 2), (2, 1)}
    lists = {r.query_id: r.listing for r in search.result_listing(search.with_documents(top, docs), queries).collect()}
    assert lists[3] == "No results found."
    assert lists[2] == "## Search results for: red\n\n### 1. [Untitled](u1)\nred fox, red\n"
    with pytest.raises(ValueError):
        search.search_topk(docs, queries, 21)


def test_references(spark):
    files = spark.createDataFrame([("/f/a", '{"x":1}'), ("/f/b", '{"result":"inner"}'), ("/f/c", "text")], "path string, content string")
    data = [
        " /f/a ", '{"file":"/f/b"}', '{"result":" /f/c"}', '{"result":" plain "}', '{"result":"a","b":1}', "//no", "/gone", '{"file":5}',
        '{"file":"/f/a","result":"z"}', " 5 ", None,
    ]
    rows = {r.payload_id: r.raw for r in resolve_refs(spark.createDataFrame(list(enumerate(data)), "payload_id int, data string"), files).collect()}
    assert rows == {
        0: '{"x":1}', 1: "inner", 2: "text", 3: "plain", 4: '{"result":"a","b":1}', 5: "//no",
        6: '{"_error": "File not found: /gone"}', 7: '{"file":5}', 8: '{"x":1}', 9: "5", 10: None,
    }


def log(spark):
    return spark.createDataFrame(
        [
            ("1", "https://a.example.com/x", "application/json; charset=utf-8", 200, None, '{"a":1,"b":null}'),
            ("2", "https://a.example.com/y", "application/javascript", 200, None, "<p>not json</p>"),
            ("3", "https://B.example.com/z?q", "text/html", 200, None, "<h1>T</h1>"),
            ("4", "https://b.example.com/p", "application/pdf", 200, None, "%PDF"),
            ("5", "https://b.example.com/e", "text/html", 404, None, ""),
            ("6", "https://b.example.com/t", None, None, "ReadTimeout", None),
            ("7", "https://b.example.com/t", None, None, "ValueError", None),
        ],
        "fetch_id string, url string, content_type string, status int, error string, body string",
    )


def test_routes_and_outcomes(spark):
    rows = {r.fetch_id: (r.route, r.note) for r in route_by_content(log(spark)).collect()}
    assert [rows[str(i)] for i in range(1, 6)] == [("json", ""), ("html", "invalid_json"), ("html", ""), ("pdf", ""), ("html", "")]
    counts = {(r.host, r.outcome, r.status): r.n for r in fetch_outcomes(log(spark)).collect()}
    assert counts[("b.example.com", "timeout", None)] == 1 and counts[("b.example.com", "http", 404)] == 1
    assert counts[("a.example.com", "ok", 200)] == 2 and counts[("b.example.com", "error", None)] == 1
    messages = [r[0] for r in log(spark).select(outcome_message(F.col("status"), F.col("error"), F.lit("d"))).collect()]
    assert messages[4:] == ["Error: HTTP 404 — d", "Error: Request timed out — d", "Error: ValueError — d"] and messages[0] is None


def test_slim_responses(spark):
    texts = spark.createDataFrame([("https://b.example.com/p", "pdf text")], "url string, text string")
    rows = {r.fetch_id: r for r in slim_responses(log(spark), "smart_fetch", pdf_texts=texts).collect()}
    assert rows["1"].text == '{\n  "a": 1\n}' and rows["1"].source == "smart_fetch:https://a.example.com/x"
    assert rows["2"].text == "not json" and rows["3"].text == "# T" and len(rows) == log(spark).count()
    assert (rows["4"].route, rows["4"].text) == ("pdf", "pdf text")
    assert rows["5"].text == "Error: HTTP 404 — https://b.example.com/e" and rows["6"].route == "error"
    plain = slim_responses(log(spark), "smart_fetch")
    assert {r.fetch_id: r.note for r in plain.collect()}["4"] == "no_text" and size_records(plain).count() == 2
    answers = {r.url: r.text for r in pdf_answers(log(spark).where("status = 200"), texts).collect()}
    assert answers["https://b.example.com/p"] == "pdf text"
    assert answers["https://B.example.com/z?q"] == "Note: URL did not return a PDF. Returning HTML content instead.\n\n# T"


def test_file_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{\n "a": 1\n}')
    (tmp_path / "lines.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert [r.raw for r in payload_table(spark, str(tmp_path / "docs")).collect()] == ['{\n "a": 1\n}']
    rows = payload_table(spark, str(tmp_path / "lines.jsonl"), lines=True).collect()
    assert len({r.payload_id for r in rows}) == 2 and {r.raw for r in rows} == {'{"a":1}', '{"a":2}'}
    (tmp_path / "docs" / "p.html").write_text("<p>é</p>")
    assert {r.html for r in page_table(spark, str(tmp_path / "docs" / "p.html"), binary=True).collect()} == {"<p>é</p>"}


def run(stream, tmp_path, name, mode="append"):
    out = str(tmp_path / name)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_streaming_dedup_over_batches(spark, tmp_path):
    """Several batches in time order give what one batch gives; an event
    older than the kept one is late and suppressed."""
    rng = random.Random(5)
    rows = sorted((rng.randint(0, 4000), rng.choice("abc")) for _ in range(200))
    source = tmp_path / "in"
    schema = "id int, k string, ts timestamp"
    for part in range(4):
        chunk = [(i, k, at(t)) for i, (t, k) in enumerate(rows) if i // 50 == part]
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(str(source / f"part{part}"))
        out = run(
            ttl_dedup_stream(spark.readStream.schema(schema).parquet(str(source / "*")), "k", "ts", "id", 60, "10 minutes"),
            tmp_path, "kept",
        )
    got = sorted((r.k, r.first_id) for r in out.collect())
    whole = spark.createDataFrame([(i, k, at(t)) for i, (t, k) in enumerate(rows)], schema)
    want = sorted((r.k, r.first_id) for r in fresh.ttl_dedup(whole, "k", "ts", 60, "id").collect())
    assert got == want


def test_streaming_report_windows_and_leaves(spark, tmp_path):
    led = ledger_rows(spark).unionByName(
        spark.createDataFrame([(9, at(90_000), "late", 1, 1)], "seq long, ts timestamp, source string, raw_chars long, opt_chars long")
    )
    led.write.parquet(str(tmp_path / "led"))
    stream = spark.readStream.schema(led.schema).parquet(str(tmp_path / "led"))
    rows = run(savings_report_stream(stream, window="1 hour"), tmp_path, "report").collect()
    assert {r.source: (r.calls, r.saved_chars) for r in rows} == {"cli": (2, 100), "unknown": (2, -10)}
    docs = spark.createDataFrame([(1, json.dumps({"a": None, "u": "http://h/{x}", "b": [1, ""]})), (2, "bad")], "payload_id int, raw string")
    docs.write.parquet(str(tmp_path / "docs"))
    out = run(leaves_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))), tmp_path, "leaves")
    assert [(r.payload_id, list(r.steps), r.scalar) for r in out.collect()] == [(1, ["b", "[0]"], "1")]


def test_streamed_leaves_below_any_level(spark, tmp_path):
    deep = lambda n: "[" * n + '{"id":7,"u":"http://h/{x}","n":null}' + "]" * n
    docs = spark.createDataFrame([(n, deep(n)) for n in (1, 31, 32, 41, 70)] + [(99, "bad")], "payload_id int, raw string")
    docs.repartition(3).write.parquet(str(tmp_path / "deep"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "deep"))
    path = str(tmp_path / "leaves")
    write_leaves(stream, path, path + "-state").trigger(availableNow=True).start().awaitTermination()
    got = read_leaves(spark, path, docs.schema["payload_id"].dataType).collect()
    assert sorted((r.payload_id, tuple(r.steps), r.kind, r.scalar) for r in got) == [(n, ("[0]",) * n + ("id",), "int", "7") for n in (1, 31, 32, 41, 70)]
    (tmp_path / "none").mkdir()
    nothing = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "none"))
    write_leaves(nothing, path + "-none", path + "-none-state").trigger(availableNow=True).start().awaitTermination()
    assert read_leaves(spark, path + "-none", docs.schema["payload_id"].dataType).count() == 0
    one_plan = run(leaves_stream(stream), tmp_path, "one-plan").collect()
    assert sorted((r.payload_id, len(r.steps), r.scalar) for r in one_plan) == [(n, n + 1, "7") for n in (1, 31, 32, 41, 70)]


def test_appended_records_are_numbered_on(spark, tmp_path):
    path = str(tmp_path / "numbers")
    batch = lambda ids: spark.createDataFrame([(i, f"s{i}", 10 * i, i) for i in ids], "k int, source string, raw_chars long, opt_chars long").repartition(5)
    append_ledger(ledger.measure(batch(range(20, 0, -1))), path, ["k"])
    append_ledger(ledger.measure(batch([])), path)
    append_ledger(ledger.measure(batch([99, 30, 50])), path, ["k"])
    append_ledger(ledger.measure(batch([7, 8, 9])), path)  # in any order, but each with a number of its own
    rows = sorted((r.seq, r.source, r.ts is not None) for r in read_ledger(spark, path).collect())
    assert rows[:23] == [(i, f"s{k}", True) for i, k in enumerate([*range(1, 21), 30, 50, 99], 1)]
    assert [r[0] for r in rows] == list(range(1, 27)) and broken_lines(spark, path).count() == 0
    assert [r.source for r in ledger.recent_entries(read_ledger(spark, path), 4).collect()][0] == "s99"
