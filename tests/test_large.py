"""Texts larger than a VARIANT, repeated ids, numbers by value."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slim.operators import large, leaves
from slim.operators.factor import factor_items, fingerprints, shared_objects, uniform_values
from slim.operators.large import LARGE, cut_documents, parts
from slim.operators.leaves import payload_leaves
from slim.operators.paths import Any, Index, Key, Where, collapse_matches, match_values, select_path
from slim.operators.prune import clean, compact_positions, flatten_below, surviving_containers
from slim.operators.render import rebuild
from slim.plans import optimize
from slim.plans.optimize import evaluate_corpus, optimize_payloads
from slim.sources.pages import route_by_content

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6),
    lambda own: st.lists(own, max_size=4) | st.dictionaries(st.text(alphabet='ab[\\",:{é', max_size=4), own, max_size=4),
    max_leaves=15,
)


def at(value, steps):
    for s in steps:
        value = value[int(s[1:-1])] if isinstance(value, list) else value[s[1:] if s[:1] == "\\" else s]
    return value


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from([1, 8, 40]), st.booleans(), st.sampled_from([None, 2]), st.integers(1, 9))
def test_parts_make_up_the_text(value, limit, escaped, indent, block):
    before, large.BLOCK = large.BLOCK, block
    try:
        text = json.dumps(value, ensure_ascii=escaped, indent=indent).encode()
        cut = parts(text, limit)
        assert [o for _, o, *_ in cut] == sorted(o for _, o, *_ in cut)
        for steps, order, a, z in cut:
            assert json.loads(text[a:z]) == at(value, steps) and len(steps) == len(order)
            assert z - a <= limit or text[a : a + 1] not in (b"[", b"{") or not json.loads(text[a:z])
    finally:
        large.BLOCK = before


@pytest.mark.parametrize("text", ["[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "{1:2}", "[1]]", "[[1]", '{"a":NaN}', "", "[}", '{"a":1:2}', "[1:2]", "[1],[2]", '"a', '{"a":}'])
def test_what_is_not_json_is_not_cut(text):
    assert parts(text.encode(), 1) is None


def docs():
    item = lambda i: {"id": i, "n": None, "u": "http://h/{x}", "name": f"é {i}", "o": {"k": [1, {"z": i}], "e": {}}}
    return [
        [item(i) for i in range(9)], {"data": [item(i) for i in range(3)], "[x]": 1, "b": {"c": {"d": {"e": {"f": {"g": "deep"}}}}}}, [1, [2, [3, "four"]], {}],
        [], {}, {"a": []}, "text", 5, None, [item(0)] * 4 + [7], {"é": {"\\": [[], [[]]]}},
    ]


def test_cut_documents_give_what_whole_ones_do(spark, monkeypatch):
    """With a small bound the same documents take the way of large ones."""
    frame = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs())] + [(90, "{"), (91, "nope"), (92, '{"a":1,"a":2}'), (93, None)], "payload_id int, raw string")

    def results():
        rows = payload_leaves(frame)
        return [
            sorted(map(repr, (r.drop("doc", "copy") if "doc" in r.columns else r).collect()))
            for r in (rows, rebuild(rows, 2), optimize_payloads(frame), optimize_payloads(frame, schema_mode=False, max_chars=None), optimize_payloads(frame, [Any(), Key("name")], "$[*].name"))
        ]

    whole = results()
    small = lambda raw, limit=4: F.coalesce(F.octet_length(raw) > limit, F.lit(False))
    cut = lambda rows, *args: cut_documents(rows, *args, **({"limit": 4} if len(args) == 2 else {"min_items": None, "limit": 4}))
    for module in (leaves, optimize):
        monkeypatch.setattr(module, "is_large", small)
        monkeypatch.setattr(module, "cut_documents", cut)
    assert results() == whole


def test_list_larger_than_a_variant(spark):
    """140 MB of items, made by Spark: summarised like a short list; still JSON to the router."""
    item = F.concat(F.lit('{"id":'), F.lit(7), F.lit(',"none":null,"text":"'), F.repeat(F.lit("word "), F.lit(200)), F.lit('"}'))
    long = F.concat(F.lit("["), F.array_join(F.array_repeat(item, 140_000), ","), F.lit("]"))
    frame = spark.range(1).select(F.lit(1).alias("payload_id"), long.alias("raw"))
    short = frame.withColumn("raw", F.concat(F.lit("["), F.array_join(F.array_repeat(item, 6), ","), F.lit("]")))
    got, want = optimize_payloads(frame).first(), optimize_payloads(short).first()
    assert got["raw_chars"] > 140_000_000 > 8 * LARGE
    assert (got["mode"], got["text"]) == ("schema", want["text"].replace('"_count": 6', '"_count": 140000').replace("out of 6", "out of 140000"))
    routed = route_by_content(frame.select(F.lit("application/json").alias("content_type"), F.col("raw").alias("body")))
    assert routed.select("route", "note").first() == ("json", "")


def test_repeated_ids_are_documents_of_their_own(spark):
    texts = ['[{"a":1,"o":{"x":1}},{"a":1,"o":{"x":1}}]', '[{"a":2,"o":{"x":2}},{"b":[null,3]}]', '{"b":[null,{"c":9}]}', '{"b":[null,{"c":9}]}', "{"]
    payloads = spark.createDataFrame([(1, t) for t in texts] + list(enumerate(texts, 10)), "payload_id int, raw string").coalesce(2)
    steps = {
        "optimize": optimize_payloads,
        "narrowed": lambda p: optimize_payloads(p, [Any(), Key("a")], "$[*].a"),
        "evaluate": evaluate_corpus,
        "rebuild": lambda p: rebuild(payload_leaves(p)),
        "compact": lambda p: compact_positions(clean(payload_leaves(p))),
        "flatten": lambda p: flatten_below(payload_leaves(p), 1),
        "containers": lambda p: surviving_containers(payload_leaves(p)),
        "uniform": lambda p: uniform_values(payload_leaves(p)),
        "factor": lambda p: factor_items(payload_leaves(p)),
        "shared": lambda p: shared_objects(fingerprints(payload_leaves(p))),
        "last": lambda p: match_values(select_path(payload_leaves(p), [Index(-1)])),
        "where": lambda p: collapse_matches(select_path(payload_leaves(p), [Where("a", ">", 1), Key("a")]), p, "$"),
    }
    for name, step in steps.items():
        found = {True: [], False: []}
        for r in step(payloads).collect():
            found[r["payload_id"] == 1].append(repr({k: v for k, v in r.asDict(True).items() if k not in ("payload_id", "doc", "copy")}))
        assert found[True] and sorted(found[True]) == sorted(found[False]), name


def test_numbers_are_uniform_by_value(spark):
    raw = '[{"a":100,"b":1.5,"c":1,"d":0,"e":"100"},{"a":1e2,"b":1.50,"c":true,"d":-0.0,"e":100},{"a":100.0,"b":15e-1,"c":1,"d":0.0,"e":100}]'
    rows = uniform_values(payload_leaves(spark.createDataFrame([(1, raw)], "payload_id int, raw string"))).collect()
    assert {r["key"] for r in rows} == {"a", "b", "d"}
