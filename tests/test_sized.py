"""Work per task follows the data: partitions, exchanges, passes."""

import json
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from slim.functions.text import TOKEN_PATTERN, token_estimate
from slim.operators.leaves import payload_leaves, spread
from slim.operators.markup import _pages_of
from slim.operators.profile import schema_summary
from slim.operators.prune import _ranks, container_survival, surviving_containers
from slim.operators.render import rebuild
from slim.plans.optimize import evaluate_corpus, optimize_payloads
from slim.session import configure
from slim.sources.ledger import append_ledger, read_ledger


def test_partitions_follow_the_documents(spark):
    # Text that hardly compresses: some 32 MB, and a few bytes.
    words = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.sha2(F.concat_ws("-", i, F.col("id")), 256))
    many = spark.range(500).select(F.col("id").alias("payload_id"), F.array_join(words, "").alias("raw"))
    assert spread(many).rdd.getNumPartitions() > 4
    assert spread(many.limit(3)).rdd.getNumPartitions() <= 4


def test_coarse_sessions_still_cut_finely(spark, monkeypatch):
    size, number = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    built = spark.sparkContext.getConf()
    monkeypatch.setattr(spark.sparkContext, "getConf", lambda: built)
    words = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.sha2(F.concat_ws("-", i, F.col("id")), 256))
    many = spark.range(500).select(F.col("id").alias("payload_id"), F.array_join(words, "").alias("raw"))
    try:
        for given, kept in (("64MB", "4m"), ("8388608", "4m"), ("1m", "1m")):
            built.set(size, given).set(number, "8")
            configure(spark)
            assert (spark.conf.get(size), spark.conf.get(number)) == (kept, "2000")
            assert spread(many).rdd.getNumPartitions() > 4
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert configure(spark).conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    finally:
        monkeypatch.undo()
        configure(spark)


def test_dead_leaves_only_show_the_root(spark):
    docs = [{"a": {"b": [None, {"c": None}]}, "d": [1, {"e": 2}]}, {"a": {"b": None}}, [[], {"x": ""}], 5, {"k": {"u": "http://h/{x}", "v": [0]}}]
    rows = payload_leaves(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "payload_id int, raw string"))
    # Also where the first leaf of a document is missing.
    for table in (rows, rows.where("try_element_at(ord, -1) > 0"), rows.where("kind = 'null'")):
        found = surviving_containers(table)
        want = container_survival(table).where("survives").drop("survives")
        key = lambda df: sorted((r["payload_id"], r["path"], r["ord"]) for r in df.collect())
        assert found.columns == want.columns and key(found) == key(want)
    assert {(r["payload_id"], r["path"]) for r in surviving_containers(rows).collect()} == {
        (0, "$"), (0, "$.d"), (0, "$.d[1]"), (1, "$"), (2, "$"), (4, "$"), (4, "$.k"), (4, "$.k.v")
    }
    # Nothing is aggregated but the containers themselves.
    plan = surviving_containers(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(alive" not in plan


def test_corpus_eval_moves_payloads_once(spark):
    docs = [[{"id": i, "e": None} for i in range(6)], [[{"id": i, "e": None} for i in range(6)]], {"b": 1}, {"b": 1}, 5, "no"]
    rows = [(min(i, 2), json.dumps(d)) for i, d in enumerate(docs[:4])] + [(3, "5"), (4, "no JSON")]
    sizes = evaluate_corpus(spark.createDataFrame(rows, "payload_id int, raw string"))
    found = sorted(tuple(r) for r in sizes.collect())
    # Copies of a payload have a row each, text that is not JSON has none.
    assert [r[0] for r in found] == [0, 1, 2, 2, 3]
    small = len(json.dumps({"b": 1}, indent=2))
    assert found[2] == found[3] == (2, small, small, small) and found[4] == (3, 1, 1, 1)
    assert found[0][3] != found[0][2] and found[1][3] == found[1][2]
    plan = sizes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_sibling_ranks_over_batches():
    for seed in range(200):
        rng, rows = random.Random(seed), []
        for _ in range(rng.randint(1, 6)):
            doc = set()
            for _ in range(rng.randint(1, 9)):
                leaf = tuple(rng.choice([0, 2, 3, 5]) for _ in range(rng.randint(0, 4)))
                doc = {x for x in doc if x[: len(leaf)] != leaf and leaf[: len(x)] != x} | {leaf}
            for i, leaf in enumerate(sorted(doc)):
                want = [len({x[n] for x in doc if x[:n] == leaf[:n] and len(x) > n and x[n] < leaf[n]}) for n in range(len(leaf))]
                rows.append((leaf, i == 0, want))
        last, got, at = (np.empty(0, np.int32), np.empty(0, np.int32)), [], 0
        while at < len(rows):
            batch = rows[at : at + rng.randint(1, 5)]
            at += len(batch)
            ranks, last = _ranks(pa.array([list(r[0]) for r in batch], pa.list_(pa.int32())), np.array([r[1] for r in batch]), last)
            got += ranks.to_pylist()
        assert got == [r[2] for r in rows], seed


def test_one_page_at_a_time_is_python_objects():
    lists = pa.array([[1, None], [], [7] * 3], pa.list_(pa.int32()))
    assert list(_pages_of(lists)) == [[1, -1], [], [7, 7, 7]]
    assert list(_pages_of(lists.slice(1))) == [[], [7, 7, 7]]


def test_summaries_parse_and_move_lists_once(spark):
    rows = [(1, json.dumps([{"b": i, "a": {"x": None, "y": [i]}, "e": None} for i in range(6)]))] * 2 + [(2, "[{},{},{},{},{}]"), (3, "5")]
    found = schema_summary(spark.createDataFrame(rows, "payload_id int, raw string").withColumn("v", F.parse_json("raw")))
    got = sorted((r["payload_id"], r["n_items"], r["schema"], r["sample_1"], r["sample_2"]) for r in found.collect())
    one = (1, 6, '{"a":"object(1 keys)","b":"int"}', '{"a":{"y":[0]},"b":0}', '{"a":{"y":[1]},"b":1}')
    # Rows with one id have a summary each.
    assert got == [one, one, (2, 5, "{}", "{}", "{}")]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange ") == 1


def test_ordered_appends_make_their_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(100).select("id", F.lit("s").alias("source"), F.lit(2).cast("long").alias("raw_chars"), F.lit(1).cast("long").alias("opt_chars"))
    append_ledger(rows.mapInArrow(counted, rows.schema), str(tmp_path / "ledger"), ["id"])
    assert made.value == 100
    assert sorted(r["seq"] for r in read_ledger(spark, str(tmp_path / "ledger")).collect()) == list(range(1, 101))


def test_texts_come_from_batches_of_sorted_rows(spark):
    # Documents of several batches, and several documents in one.
    docs = [[{"b": {"x": i % 2, "y": "q\u001f\n"}, "a[": [i, None, {}], "u": 1} for i in range(n)] for n in (1, 4, 9)] + [{"k": {}}, [], 5, "é"]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "payload_id int, raw string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = sorted(tuple(r) for r in optimize_payloads(rows, schema_mode=False, max_chars=None).collect())
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        found = {r["payload_id"]: r["text"] for r in rebuild(payload_leaves(rows), 2).collect()}
        assert sorted(tuple(r) for r in optimize_payloads(rows, schema_mode=False, max_chars=None).collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sort = lambda d: json.dumps(d, indent=2, sort_keys=True, ensure_ascii=False).replace("\\u001f", "\\u001F")
    assert found == {i: sort(d) for i, d in enumerate(docs)}
    two = json.loads(whole[1][-1])
    assert two["_common_values"] == {"u": 1} and two["_common"] == {"b": docs[1][0]["b"], "b#2": docs[1][1]["b"]}
    assert two["items"][3] == {"a[": [3], "b": "→ (same as _common.b#2)"}


def test_corpus_eval_sorts_members_once(spark):
    sizes = evaluate_corpus(spark.createDataFrame([(1, "[]")], "payload_id int, raw string"))
    plan = sizes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Leaves as they are; flattened, and beside each other; members by item, and in order.
    assert plan.count("- Sort [") == 5
    # Texts are put together in document order; only members are aggregated, in two steps.
    assert plan.count("- ObjectHashAggregate") == 2


def test_tokens_are_counted_without_a_list_of_them(spark):
    texts = ["a\x0b\x00  b😀😀 12345 \r\n!!\n\n", "", " ", None, "٣٤٥٦é́ x", "x$1\\", '{\n  "id": 1234,\n  "t": "a-b_c"\n}']
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    listed = F.size(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0))).cast("bigint")
    counted = rows.select(token_estimate(F.col("text")).alias("n"), listed.alias("want"))
    assert [r["n"] for r in counted.collect()] == [r["want"] for r in counted.collect()]
    assert "extract_all" not in str(rows.select(token_estimate(F.col("text")))._jdf.queryExecution().optimizedPlan().toString())
