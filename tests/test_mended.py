"""Cases that earlier versions got wrong."""

from pyspark.sql import functions as F

from slim.operators.fresh import label_hits, ttl_dedup
from slim.operators.leaves import nesting_depth, payload_leaves
from slim.operators.markup import to_markdown
from slim.operators.paths import Descend, Where, match_values, select_path
from slim.operators.prune import clean, compact_positions
from slim.operators.profile import type_label
from slim.operators.select import Css, css_query
from slim.plans.optimize import optimize_payloads
from slim.sources.ledger import broken_lines, read_ledger


def test_filters_compare_by_kind(spark):
    raw = '[{"id":42},{"id":"42"},{"id":null},{"id":[42]},{"other":1},{"id":{"x":42}},{"id":true},{"id":42.0}]'
    leaves = payload_leaves(spark.createDataFrame([(1, raw)], "payload_id long, raw string"))

    def hits(op, value):
        return sorted(r["match_ord"][0] for r in match_values(select_path(leaves, [Where("id", op, value)])).collect())

    assert hits("==", 42) == [0, 7]
    assert hits("==", "42") == [1]
    assert hits("!=", 42) == [1, 2, 3, 5, 6]
    assert hits("!=", "42") == [0, 2, 3, 5, 6, 7]
    assert hits("==", None) == [2] and hits("==", True) == [6]
    assert hits(">", 41) == [0, 7]


def test_rules_are_page_content(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<hr><p>secret</p><hr><p>tail</p>")], "page_id long, url string, html string")
    assert to_markdown(pages).first()["markdown"] == "---\n\nsecret\n\n---\n\ntail"


def test_rendered_fragments_share_a_line(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<nav><a href='1'>x</a> <a href='2'>y</a></nav><h1>t</h1>")], "page_id long, url string, html string")
    assert css_query(pages, [[Css("a")]], "a", rendered=True).first()["result"] == "[x](1) [y](2)"


def test_null_keys_are_kept(spark):
    events = spark.createDataFrame([(1, None, 0), (2, None, 10), (3, None, 100), (4, "a", 5)], "id long, k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    kept = {(r["k"], r["first_id"]) for r in ttl_dedup(events, "k", "ts", 60, "id").collect()}
    assert kept == {(None, 1), (None, 3), ("a", 4)}
    assert {r["id"]: r["hit"] for r in label_hits(events, "k", "ts", 60, "id").collect()} == {1: False, 2: True, 3: False, 4: False}


def test_broken_ledger_lines_are_shown(spark, tmp_path):
    (tmp_path / "ledger.json").write_text('{"seq":1,"raw_chars":5,"opt_chars":2}\n\nnot json\n{"seq":2}\n')
    assert [r["seq"] for r in read_ledger(spark, str(tmp_path)).collect()] == [1]
    assert sorted(r["line"] for r in broken_lines(spark, str(tmp_path)).collect()) == ["not json", '{"seq":2}']


def test_any_depth(spark):
    for n in (3, 22, 40):
        raw = '{"k":' * n + "[" * n + '{"id":5,"u":"http://h/{x}","n":null}' + "]" * n + "}" * n
        payloads = spark.createDataFrame([(1, raw)], "payload_id long, raw string")
        rows = payload_leaves(payloads).collect()
        assert len(rows) == 3 and {len(r["steps"]) for r in rows} == {2 * n + 1}
        assert [r["text"] for r in match_values(select_path(payload_leaves(payloads), [Descend("id")])).collect()] == ["5"]
    lists = spark.createDataFrame([(1, "[" * 38 + '{"id":5,"u":"http://h/{x}","n":null}' + "]" * 38)], "payload_id long, raw string")
    text = optimize_payloads(lists).first()["text"]
    assert "http" not in text and "null" not in text and '"id": 5' in text


def test_depth_counts_brackets_outside_strings(spark):
    raws = ["1", "[]", '{"a":"[[[["}', '{"a\\\\":["\\"]]",[{}]]}', '["\\\\",[[1]]]']
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select(nesting_depth(F.parse_json("raw")).alias("d")).collect()
    assert [r["d"] for r in got] == [0, 1, 1, 4, 3]


def test_labels_of_nested_lists(spark):
    cases = {"[[[[[[[[[1,2]]]]]]]]]": "[" * 9 + "int, ...2]" + ", ...1]" * 8, "[[],1]": "[[], ...2]", "[]": "[]", '[{"a":1}]': "[object(1 keys), ...1]", "[null]": "[null, ...1]", '["[["]': "[string, ...1]"}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", type_label(F.parse_json("raw")).alias("t"))
    assert {r["raw"]: r["t"] for r in rows.collect()} == cases


def test_lists_in_flattened_objects_keep_their_positions(spark):
    raw = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":[10,null,20]}}}}}},"l":[null,{"m":["",3]},4]}'
    rows = compact_positions(clean(payload_leaves(spark.createDataFrame([(1, raw)], "payload_id long, raw string")))).collect()
    assert sorted((".".join(r["steps"]), r["scalar"]) for r in rows) == [
        ("a.b.c.d.e.f.g.[0]", "10"), ("a.b.c.d.e.f.g.[1]", None), ("a.b.c.d.e.f.g.[2]", "20"), ("l.[0].m.[0]", "3"), ("l.[1]", "4"),
    ]
