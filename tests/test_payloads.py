"""Leaf tables, pruning, paths, factoring and the end-to-end plan against
small literal documents and a plain Python statement of the rules."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from slim import Any, Descend, Index, Key, Slice, Where, optimize_payloads, parse_payloads, payload_leaves, select_path
from slim.operators import prune
from slim.operators.factor import factor_items, fingerprints, shared_objects, uniform_values
from slim.operators.paths import collapse_matches, select_static
from slim.operators.profile import is_uniform_array, schema_summary
from slim.operators.render import rebuild
from slim.plans.optimize import evaluate_corpus


def payloads(spark, docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "payload_id int, raw string")


def texts(df, column="text"):
    return {r["payload_id"]: r[column] for r in df.collect()}


BLANK, TEMPLATED = re.compile(r"\s*"), re.compile(r"https?://.*\{[^}]+\}", re.DOTALL)


def blank(v):
    return v is None or v == [] or v == {} or (isinstance(v, str) and BLANK.fullmatch(v) is not None)


def templated(v):
    return isinstance(v, str) and TEMPLATED.match(v) is not None


def leaf_pairs(doc):
    """(path, value) of every scalar and empty container, keys in order."""
    todo, pairs = [((), doc)], []
    while todo:
        path, v = todo.pop()
        inside = sorted(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
        if not inside:
            pairs.append((path, v))
        todo += [((*path, step), x) for step, x in reversed(inside)]
    return pairs


def slimmed(doc, limit):
    """The rules as filters on the pairs, then the document they make up."""
    kept, sources = [], {}
    for path, v in leaf_pairs(doc):
        keys = [i for i, step in enumerate(path) if isinstance(step, str)]
        if len(keys) <= limit:
            if path and (blank(v) or (isinstance(path[-1], str) and templated(v))):
                continue
        else:
            first = keys[limit]
            stop = next((i for i in range(first, len(path)) if isinstance(path[i], int)), len(path))
            if stop == len(path) and blank(v):
                continue
            source, path = path[first:stop], (*path[:first], ".".join(path[first:stop]), *path[stop:])
            sources[path[: first + 1]] = source  # of two under one dotted key the later wins
            kept.append((path, v, path[: first + 1], source))
            continue
        kept.append((path, v, None, None))
    if isinstance(doc, dict | list) and not doc or not isinstance(doc, dict | list):
        return doc
    made = {(): type(doc)()}
    for path, v, node, source in kept:
        if node is not None and sources[node] != source:
            continue
        for n in range(1, len(path) + 1):
            if path[:n] not in made:
                made[path[:n]] = v if n == len(path) else [] if isinstance(path[n], int) else {}
                around = made[path[: n - 1]]
                around.append(made[path[:n]]) if isinstance(around, list) else around.update({path[n - 1]: made[path[:n]]})
    return made[()]


def unfactored(result):
    """The list a factored document stands for."""
    if not (isinstance(result, dict) and "items" in result and {"_common", "_common_values"} & set(result)):
        return result
    common, values = result.get("_common", {}), result.get("_common_values", {})
    restored = []
    for item in result["items"]:
        full = dict(values)
        for key, value in item.items():
            if isinstance(value, str) and value.startswith("→ (same as _common."):
                value = common[value[len("→ (same as _common."):-1]]
            full[key] = value
        restored.append(full)
    return restored


def random_value(rng, depth):
    kind = rng.choice("ddllssssnnbz0" if depth else "dl")
    if depth > 6:
        kind = rng.choice("sn0b")
    if kind == "d":
        return {rng.choice(["a", "b", "c", "a.b", "[0]", "\\x", "é\""]): random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if kind == "l":
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {
        "s": rng.choice(["", " \t", "x", "http://h/{id}", "https://h/a", "line\nbreak \"q\" \\ é→", "http://h/{}"]),
        "n": rng.choice([1, -5, 2**40, 1.5, 12345678901234567890]), "b": rng.choice([True, False]), "z": None, "0": 0,
    }[kind]


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_random_documents_are_pruned_like_the_rules_say(spark, limit):
    rng = random.Random(limit)
    docs = [random_value(rng, 0) for _ in range(120)]
    # Lists of objects with something to factor out.
    docs += [
        [{"k": random_value(rng, 2), "c": 1, "o": {"v": rng.randint(0, 1)}} for _ in range(rng.randint(1, 4))] for _ in range(20)
    ]
    got = texts(optimize_payloads(payloads(spark, docs), max_depth=limit, max_chars=None, schema_mode=False))
    for i, doc in enumerate(docs):
        want = slimmed(doc, limit)
        assert unfactored(json.loads(got[i])) == want, (doc, got[i])
        # Two-space indentation throughout.
        assert got[i] == json.dumps(json.loads(got[i]), indent=2, ensure_ascii=False)


def test_rebuild_round_trip(spark):
    rng = random.Random(7)
    docs = [random_value(rng, 0) for _ in range(80)] + [None, "s", 5, True, [], {}]
    df = payloads(spark, [json.dumps(d) for d in docs])
    leaves = payload_leaves(df)
    for indent in (None, 2):
        for i, text in texts(rebuild(leaves, indent)).items():
            assert json.loads(text) == docs[i]


def test_duplicate_keys_keep_the_last_and_bad_text_is_split_off(spark):
    df = payloads(spark, ['{"a":1,"a":2}', "nope", '{"a":NaN}', '{"a"'])
    good, bad = parse_payloads(df)
    assert [r.payload_id for r in good.collect()] == [0]
    assert {r.payload_id for r in bad.collect()} == {1, 2, 3}
    assert texts(rebuild(payload_leaves(df))) == {0: '{"a":2}'}
    out = {r.payload_id: (r.mode, r.text) for r in optimize_payloads(df).collect()}
    assert out[1] == ("error", "Error: Invalid JSON") and out[0] == ("pruned", '{\n  "a": 2\n}')


def test_empties_go_false_and_zero_stay(spark):
    df = payloads(spark, [{"a": None, "b": "", "c": [], "d": {}, "e": 1}, {"a": False, "b": 0, "c": None, "u": " "}])
    assert texts(rebuild(prune.clean(payload_leaves(df)))) == {0: '{"e":1}', 1: '{"a":false,"b":0}'}


def test_lists_in_flattened_objects_stay_whole(spark):
    df = payloads(spark, [{"a": {"b": {"c": [None, "", {"d": {}}], "u": "http://h/{x}", "e": None}}}])
    assert texts(rebuild(prune.clean(payload_leaves(df), 1))) == {0: '{"a":{"b.c":[null,"",{"d":{}}],"b.u":"http://h/{x}"}}'}


def test_compaction_and_survival(spark):
    df = payloads(spark, [[None, [None, 1], {"x": None}, {"y": [None, None, 2]}]])
    rows = prune.compact_positions(prune.clean(payload_leaves(df))).collect()
    assert sorted(tuple(r.steps) for r in rows) == [("[0]", "[0]"), ("[1]", "y", "[0]")]
    alive = {r.path: r.survives for r in prune.container_survival(payload_leaves(df)).collect()}
    assert alive == {"$": True, "$[1]": True, "$[2]": False, "$[3]": True, "$[3].y": True}


@pytest.mark.parametrize(
    "path, want",
    [
        ([Any(), Key("id")], "[1,2]"),
        ([Index(0)], '{"id":1}'),
        ([Index(-1), Key("id")], "2"),
        ([Slice(0, 5), Key("id")], "[1,2]"),
        ([Slice(-1, None)], '{"id":2,"n":{"id":9},"s":"open"}'),
        ([Slice(None, None, 2), Key("id")], "1"),
        ([Where("id", "==", 2), Key("s")], '"open"'),
        ([Where("s", "==", "open"), Key("id")], "2"),
        ([Where("id", ">=", 1), Key("id")], "[1,2]"),
        ([Where("n"), Key("id")], "2"),
        ([Descend("id")], "[1,2,9]"),
        ([Key("foo")], '{"_info":"No matches for JSONPath expression","jsonpath":"p"}'),
    ],
)
def test_paths(spark, path, want):
    df = payloads(spark, [[{"id": 1}, {"id": 2, "s": "open", "n": {"id": 9}}]])
    found = collapse_matches(select_path(payload_leaves(df), path), df, "p")
    assert texts(found, "result") == {0: want}


def test_static_path_is_taken_before_shredding(spark):
    good, _ = parse_payloads(payloads(spark, [{"a": {"b": [7, 8]}}, {"x": 1}]))
    rows = select_static(good, [Key("a"), Key("b"), Index(1)]).select("payload_id", F.col("v").cast("int").alias("text"))
    assert texts(rows) == {0: 8, 1: None}


def test_path_then_pruning(spark):
    df = payloads(spark, [[{"id": 1, "e": None}, {"id": 2}], {"x": 1}, "bad"])
    out = texts(optimize_payloads(df, [Index(0)], "$[0]"))
    assert json.loads(out[0]) == {"id": 1}
    assert json.loads(out[1]) == {"_info": "No matches for JSONPath expression", "jsonpath": "$[0]"}
    assert out[2] == "Error: Invalid JSON"


def test_gate(spark):
    docs = [[{"id": i} for i in range(n)] for n in (10, 5, 4)] + [[], [1, 2, 3, 4, 5], {"a": 1}, [{}, {}, {}, {}, 1]]
    rows = is_uniform_array(parse_payloads(payloads(spark, docs))[0]).collect()
    assert {r.payload_id: r.gate for r in rows} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_schema_summary(spark):
    pair = [{"id": 1, "name": "x", "f": 1.0, "l": [[1], 2], "o": {"a": 1, "b": None}}, {"id": 2, "name": "y" * 81, "n": None}]
    row = schema_summary(parse_payloads(payloads(spark, [pair]))[0], gated=False).collect()[0]
    assert (row.mode, row.n_items) == ("schema", 2)
    assert json.loads(row.schema) == {
        "id": "int", "name": "string", "f": "float", "l": "[[int, ...1], ...2]", "o": "object(1 keys)"
    }
    assert json.loads(row.sample_1) == {"id": 1, "name": "x", "f": 1.0, "l": [[1], 2], "o": {"a": 1}}
    assert json.loads(row.sample_2) == {"id": 2, "name": "y" * 81}
    assert row.hint.startswith("Returned schema + 2 sample items out of 2.")


def test_summary_text(spark):
    docs = [[{"id": i, "t": "z" * 90, "e": None} for i in range(6)], [{"e": None}] * 5]
    out = {r.payload_id: r for r in optimize_payloads(payloads(spark, docs)).collect()}
    first = json.loads(out[0].text)
    assert first["_count"] == 6 and first["_schema"] == {"id": "int", "t": "string(long)"}
    assert first["_sample"] == [{"id": 0, "t": "z" * 90}, {"id": 1, "t": "z" * 90}]
    second = json.loads(out[1].text)
    assert second["_schema"] == {} and second["_sample"] == [{}, {}] and second["_count"] == 5
    assert out[0].text == json.dumps(first, indent=2)


def test_truncation_marker(spark):
    out = optimize_payloads(payloads(spark, [{"a": "x" * 50}]), max_chars=20).collect()[0]
    assert out.text == '{\n  "a": "xxxxxxxxxx'[:20] + "\n\n... [truncated]" and out.opt_chars == len(out.text)


def test_factoring(spark):
    docs = [[
        {"a": {"x": 1}, "b": {"x": 1}, "s": 1, "t": True},
        {"a": {"x": 2}, "b": {"y": 3}, "s": 1.0, "t": True},
        {"a": {"x": 2}, "b": {"x": 1}, "s": 1, "t": True, "only": 5},
    ]]
    leaves = payload_leaves(payloads(spark, docs))
    assert {r.key for r in uniform_values(leaves).collect()} == {"s", "t"}
    shared = {(r.ref_name, r.n, r.first_item) for r in shared_objects(fingerprints(leaves)).collect()}
    assert shared == {("a", 3, 0), ("a", 2, 1)}
    rows = {(r.section, r.item, r.key): r.text for r in factor_items(leaves).collect()}
    # Two repeated objects first seen under one key get distinct names.
    assert rows[("_common", None, "a")] == '{"x":1}' and rows[("_common", None, "a#2")] == '{"x":2}'
    assert rows[("items", 1, "a")] == '"→ (same as _common.a#2)"' and rows[("items", 1, "b")] == '{"y":3}'
    assert rows[("_common_values", None, "t")] == "true"


def test_corpus_eval(spark):
    docs = [[{"id": i, "e": None, "t": "é"} for i in range(6)], {"a": None, "b": 1}]
    rows = {r.payload_id: r for r in evaluate_corpus(payloads(spark, docs), ascii_only=True).collect()}
    assert rows[0].raw_chars == len(json.dumps(docs[0], indent=2))
    assert rows[1].raw_chars == len(json.dumps(docs[1], indent=2))
    assert rows[1].pruned_chars == rows[1].schema_chars == len(json.dumps({"b": 1}, indent=2))
    assert rows[0].pruned_chars != rows[0].schema_chars


def test_deep_documents_stay_whole(spark):
    doc = 1
    for _ in range(30):
        doc = [doc]
    assert json.loads(texts(rebuild(payload_leaves(payloads(spark, [doc]))))[0]) == doc


def test_one_exchange_per_document(spark):
    plan = optimize_payloads(payloads(spark, [[1]]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
