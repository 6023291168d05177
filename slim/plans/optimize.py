"""The end-to-end payload pipeline as one plan.

scan -> parse -> gate -> cut gated lists to their samples -> one exchange by
document -> shred -> prune -> members -> factor -> text. After the exchange all
windows and aggregates are keyed by document and stay in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slim.functions.text import (
    MAX_CHARS,
    MAX_DEPTH,
    SAMPLE_ITEMS,
    SCHEMA_MIN_ITEMS,
    is_index,
    json_string,
    quoted,
    saved_pct,
    step_key,
    token_estimate,
    truncate_text,
)
from slim.operators.factor import member_output, members, with_factors, with_items
from slim.operators.large import cut_documents, is_large
from slim.operators.leaves import identity, leaves, spread
from slim.operators.paths import reroot, select_path, with_result
from slim.operators.profile import hint_text, is_uniform_array, items_of, member_label
from slim.operators.prune import PRUNED, clean
from slim.operators.render import flags, joined_runs, pooled, rebuild, whole_documents

KEEP = ("mode", "n_raw", "raw_chars")

# Fixed value: the message for text that is not JSON.
INVALID = "Error: Invalid JSON"


def _anchor():
    """The first leaf of a document; in schema mode, of every sample item."""
    whole = F.forall("ord", lambda o: o == 0)
    per_item = F.forall(F.slice("ord", 2, 1_000_000), lambda o: o == 0) & (F.size("ord") > 0)
    return F.when(F.col("mode") == "schema", per_item).otherwise(whole)


def _documents(pruned: DataFrame) -> DataFrame:
    """Indented result text per document from pruned leaves with KEEP columns."""
    # Placeholders of pruned documents take no part in factoring.
    void = F.col("kind") == PRUNED
    shown = F.when(~void | (F.col("mode") == "schema"), F.col("item"))
    rows = members(pruned, KEEP, 2).withColumns({"void": void, "item": shown})
    prune_mode = F.col("mode") == "pruned"
    facts = with_factors(with_items(rows))
    facts = facts.withColumns({name: F.col(name) & prune_mode for name in ("uniform", "shared", "leads")})

    key = F.when(is_index(F.col("key")), F.lit("")).otherwise(
        F.concat(quoted(step_key(F.col("key"))), F.lit(": "))
    )
    line = F.concat(F.lit("\n    "), key, member_output(F.col("text")))
    visible = ~F.col("void") & ~F.col("uniform") & F.col("key").isNotNull()
    common_value = F.concat(F.lit("\n    "), quoted(step_key(F.col("key"))), F.lit(": "), F.col("text"))
    common = F.concat(F.lit("\n    "), json_string(F.col("ref")), F.lit(": "), F.col("text"))
    label = F.concat(
        F.lit("\n    "),
        key,
        json_string(member_label(F.col("shape"), F.col("kind"), F.col("scalar"), F.col("text"))),
    )

    top_key = F.when(is_index(F.col("top")), F.lit("")).otherwise(
        F.concat(quoted(step_key(F.col("top"))), F.lit(": "))
    )
    pieces = facts.select(
        *identity(facts), *KEEP, "_first", "item", "top", "void", top_key.alias("head"),
        F.when(visible, line).alias("line"),
        F.when(F.col("uniform") & (F.col("item") == F.col("first_item")), common_value).alias("common_values"),
        F.when(F.col("leads"), common).alias("common"),
        F.when(visible & (F.col("mode") == "schema") & (F.col("item") == 0), label).alias("labels"),
        F.when(F.col("key").isNull(), F.col("text")).alias("plain"),
        is_index(F.col("key")).alias("in_list"),
        is_index(F.col("top")).alias("of_list"),
    )
    names = [*identity(facts), *KEEP]
    made = [T.StructField(c, T.StringType()) for c in (*JOINED, "root")]
    schema = T.StructType([*facts.select(*names).schema, *made, T.StructField("is_list", T.BooleanType())])
    docs = pieces.mapInArrow(lambda batches: _joined_documents(batches, names), schema)

    def block(name: str, body: str, left: str = "{", right: str = "}"):
        return F.concat(F.lit(f'\n  "{name}": {left}'), F.col(body), F.lit(f"\n  {right}"))

    factored = (F.col("common_values") != "") | (F.col("common") != "")
    wrapped = F.concat(
        F.lit("{"),
        F.when(F.col("common_values") != "", F.concat(block("_common_values", "common_values"), F.lit(","))).otherwise(""),
        F.when(F.col("common") != "", F.concat(block("_common", "common"), F.lit(","))).otherwise(""),
        block("items", "body", "[", "]"),
        F.lit("\n}"),
    )
    summary = F.concat(
        F.lit('{\n  "_mode": "schema",\n  "_count": '),
        F.col("n_raw").cast("string"),
        F.lit(","),
        F.when(F.col("labels") == "", F.lit('\n  "_schema": {}')).otherwise(block("_schema", "labels")),
        F.lit(","),
        block("_sample", "body", "[", "]"),
        F.lit(',\n  "_hint": '),
        json_string(hint_text(F.col("n_raw"), F.least(F.col("n_raw"), F.lit(SAMPLE_ITEMS)))),
        F.lit("\n}"),
    )
    left, right = F.when(F.col("is_list"), "[").otherwise("{"), F.when(F.col("is_list"), "]").otherwise("}")
    plain = (
        F.when(F.col("root").isNotNull(), F.col("root"))
        .when(F.col("body") == "", F.concat(left, right))
        .otherwise(F.concat(left, F.col("body"), F.lit("\n"), right))
    )
    text = (
        F.when(F.col("mode") == "error", F.lit(INVALID))
        .when(F.col("mode") == "schema", summary)
        .when(factored, wrapped)
        .otherwise(plain)
    )
    return docs.select(*identity(docs), "mode", "raw_chars", text.alias("text"))


JOINED = ("body", "common_values", "common", "labels")
# Elements stand one level deeper where the list has something beside it.
MARKS = [b"", b",", b"\n  ", b",\n  ", b"\n    ", b",\n    ", b"{", b"[", b"{}", b"[]", b"\n  }", b"\n  ]", b"\n    }", b"\n    ]"]


def _joined_documents(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Members in document order to one row per document: its elements, what is
    common to them, the labels of the first, and the text of a scalar root."""
    for rows, starts in whole_documents(batches):
        n = len(rows["_first"])
        doc, at = _runs(n, starts), np.arange(n)
        tops = rows["top"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        items = rows["item"].fill_null(-1).to_numpy(zero_copy_only=False)
        moved = (np.diff(tops) != 0) | (np.diff(items) != 0) | (np.diff(doc) != 0)
        begins = np.flatnonzero(np.append(True, moved))
        element, last = _runs(n, begins), np.append(begins[1:], n) - 1

        held = {c: rows[c].is_valid().to_numpy(zero_copy_only=False) for c in ("line", "common_values", "common", "labels", "plain")}
        summary = flags(pc.equal(rows["mode"], "schema"))
        beside = np.logical_or.reduceat(held["common_values"] | held["common"], starts)
        nested = summary | beside[doc]
        deeper = lambda c: pc.if_else(pa.array(nested), pc.replace_substring(rows[c], "\n", "\n  "), rows[c])

        void = np.logical_and.reduceat(flags(rows["void"]), begins)
        shown = (~void | summary[begins]) & (tops[begins] >= 0)
        whose = np.full(len(begins), -1)
        whose[element[held["plain"]]] = at[held["plain"]]
        plain = ~void & (whose >= 0)
        lists = np.logical_or.reduceat(flags(rows["in_list"]), begins)
        filled = np.logical_or.reduceat(held["line"], begins)

        pool, (mark, head, line, text) = pooled(MARKS, rows["head"], deeper("line"), deeper("plain"))
        parts = np.zeros((n, 6), np.int64) + mark
        e = np.flatnonzero(shown)
        parts[begins[e], 0] = mark + np.where(nested[begins[e]], 4, 2) + _later(shown, _firsts(doc[begins]))[e]
        parts[begins[e], 1] = np.where(nested[begins[e]], mark, head + begins[e])
        parts[begins[e], 2] = np.where(plain[e], text + whose[e], mark + np.where(filled[e], 6, 8) + lists[e])
        inside = np.flatnonzero(held["line"] & (shown & ~plain)[element])
        parts[inside, 3] = mark + _later(held["line"], begins)[inside]
        parts[inside, 4] = line + inside
        e = np.flatnonzero(shown & ~plain & filled)
        parts[last[e], 5] = mark + 10 + 2 * nested[begins[e]] + lists[e]
        out = [rows[c].take(pa.array(starts)) for c in names]
        out.append(joined_runs(pool, parts.ravel(), at * 6, starts))

        for c in JOINED[1:]:
            pool, (mark, own) = pooled(MARKS, rows[c])
            pair = np.stack([_later(held[c], starts), own + at], axis=1)
            out.append(joined_runs(pool, np.where(held[c][:, None], pair, mark).ravel(), at * 2, starts))
        lone = np.flatnonzero(held["plain"] & (tops < 0))
        root = np.full(len(starts), -1)
        root[doc[lone]] = lone
        out.append(rows["plain"].take(pa.array(root, mask=root < 0)))
        out.append(pa.array(np.logical_or.reduceat(flags(rows["of_list"]), starts)))
        yield pa.RecordBatch.from_arrays(out, names=[*names, *JOINED, "root", "is_list"])


def _runs(n: int, starts: np.ndarray) -> np.ndarray:
    """The number of the run that each of n rows is in."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def _firsts(runs: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(runs, prepend=-1))


def _later(marked: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1 where an earlier row of the run is marked, else 0."""
    before = np.cumsum(marked) - marked
    return (before > before[starts][_runs(len(marked), starts)]).astype(np.int64)


def optimize_payloads(
    payloads: DataFrame,
    path: list | None = None,
    expression: str | None = None,
    max_depth: int = MAX_DEPTH,
    max_chars: int | None = MAX_CHARS,
    schema_mode: bool = True,
) -> DataFrame:
    """``(payload_id, mode, raw_chars, opt_chars, saved_pct, text)`` per payload.

    Large lists of objects become a schema with samples, everything else is
    pruned and factored. A ``path`` (see :mod:`slim.operators.paths`) narrows
    the payload first and turns schema mode off. ``max_chars=None`` never
    truncates. Ids may repeat: every row has its own result. Texts too large
    for a VARIANT are cut first and give what a smaller one would; finding them
    reads the text column a second time, which costs little beside parsing it.
    """
    docs = _texts(payloads, max_depth, schema_mode) if path is None else _narrowed(_rows(payloads), path, expression or str(path), max_depth)
    text = F.col("text") if max_chars is None else truncate_text(F.col("text"), max_chars, "json")
    opt = F.char_length("text").cast("bigint")
    return (
        docs.withColumn("text", text)
        .withColumn("opt_chars", opt)
        .select(
            "payload_id", "mode", "raw_chars", "opt_chars",
            saved_pct(F.col("raw_chars"), F.col("opt_chars")).alias("saved_pct"), "text",
        )
    )


def _rows(payloads: DataFrame) -> DataFrame:
    raw_chars = F.char_length("raw").cast("bigint")
    return payloads.select("payload_id", raw_chars.alias("raw_chars"), F.xxhash64("payload_id", "raw").alias("doc"), "raw")


def _texts(payloads: DataFrame, max_depth: int, schema_mode: bool) -> DataFrame:
    """Whole result texts with what tells documents apart."""
    return _whole(_rows(payloads), max_depth, schema_mode)


def _parsed(rows: DataFrame) -> DataFrame:
    """Texts that fit a VARIANT, parsed; ``v`` is null where they are not JSON."""
    whole = rows.where(~is_large(F.col("raw"))).withColumn("v", F.try_parse_json("raw")).drop("raw")
    return whole.withColumns({"steps": F.array().cast("array<string>"), "ord": F.array().cast("array<int>")})


def _large(rows: DataFrame, schema_mode: bool) -> DataFrame:
    """Texts that do not, cut into parsed parts; lists that pass the gate into their samples."""
    numbered = rows.where(is_large(F.col("raw"))).withColumn("copy", F.monotonically_increasing_id())
    cut = cut_documents(numbered, SCHEMA_MIN_ITEMS if schema_mode else None, SAMPLE_ITEMS)
    return cut.withColumn("v", F.try_parse_json("raw")).drop("raw")


def _placed(small: DataFrame, large: DataFrame) -> DataFrame:
    """Both on one exchange: a document's rows share its content hash. Copies of
    a small document are told apart where they arrived."""
    columns = [*large.columns]
    placed = spread(small.withColumn("copy", F.lit(None).cast("bigint")).select(*columns).unionByName(large.select(*columns)))
    return placed.withColumn("copy", F.coalesce("copy", -1 - F.monotonically_increasing_id()))


def _mode() -> Column:
    return F.when(F.col("v").isNull(), "error").when(F.col("gate"), "schema").otherwise("pruned")


def _whole(rows: DataFrame, max_depth: int, schema_mode: bool) -> DataFrame:
    """One plan for both modes: gated lists shrink to their samples before
    anything is moved or shredded."""
    parsed = _parsed(rows)
    if schema_mode:
        gated = is_uniform_array(parsed)
    else:
        gated = parsed.withColumn("gate", F.lit(False)).withColumn("n_items", F.lit(0))
    head = F.to_variant_object(F.slice(items_of(F.col("v")), 1, SAMPLE_ITEMS))
    columns = ["payload_id", "doc", "steps", "ord", _mode().alias("mode"), F.col("n_items").cast("bigint").alias("n_raw"), "raw_chars"]
    small = gated.select(*columns, F.when(F.col("gate"), head).otherwise(F.col("v")).alias("v"))
    large = _large(rows, schema_mode).select(*columns, "copy", "v")
    return _documents(clean(leaves(_placed(small, large), KEEP), max_depth, _anchor()))


def _narrowed(rows: DataFrame, path: list, expression: str, max_depth: int) -> DataFrame:
    """The path is applied first; payloads without a match get the marker."""
    columns = ["payload_id", "doc", "steps", "ord", F.lit("pruned").alias("mode"), F.lit(0).cast("bigint").alias("n_raw"), "raw_chars"]
    valid = F.col("v").isNotNull()
    small, large = _parsed(rows), _large(rows, False)
    placed = _placed(small.where(valid).select(*columns, "v"), large.where(valid).select(*columns, "copy", "v"))
    found = reroot(select_path(leaves(placed, KEEP), path))
    docs = _documents(clean(found, max_depth, _anchor()))
    marker = F.concat(
        F.lit('{\n  "_info": "No matches for JSONPath expression",\n  "jsonpath": '),
        json_string(F.lit(expression)),
        F.lit("\n}"),
    )
    answer = docs.select(*identity(docs), "text")
    failed = large.where(~valid).select("payload_id", "doc").distinct().withColumn("bad", F.lit(True))
    every = small.select("payload_id", "doc", "raw_chars", (~valid).alias("bad")).unionByName(
        rows.where(is_large(F.col("raw"))).select("payload_id", "doc", "raw_chars").join(failed, ["payload_id", "doc"], "left")
    )
    return with_result(every, answer).select(
        "payload_id",
        F.when(F.col("bad"), "error").otherwise("pruned").alias("mode"),
        "raw_chars",
        F.when(F.col("bad"), F.lit(INVALID)).otherwise(F.coalesce("text", marker)).alias("text"),
    )


def evaluate_corpus(payloads: DataFrame, max_depth: int = MAX_DEPTH, ascii_only: bool = False, tokens: bool = False) -> DataFrame:
    """Characters of every payload, indented alike: as it is, pruned, and as a
    summary. Payloads that are not summarised repeat the pruned size.
    ``ascii_only`` counts non-ASCII characters as escapes, ``tokens`` adds token
    estimates of the same texts. Payloads move once; only sizes leave their place."""
    size = ascii_chars if ascii_only else (lambda c: F.char_length(c).cast("bigint"))
    measures = {"chars": size, "tokens": token_estimate} if tokens else {"chars": size}
    placed = _measurable(_rows(payloads))
    raw = rebuild(leaves(placed.where("mode != 'schema'"), ABOUT), 2, ABOUT)
    texts = _documents(clean(leaves(_variants(placed), KEEP), max_depth, _anchor()))
    rows = raw.withColumn("mode", F.lit("raw")).select(*identity(raw), "mode", "text").unionByName(texts.select(*identity(texts), "mode", "text"))
    sized = rows.select("payload_id", "doc", "mode", *[f(F.col("text")).alias(m) for m, f in measures.items()])
    # Copies of a payload, equal in id and text, have equal sizes.
    of = lambda mode, m: F.max(F.when(F.col("mode") == mode, F.col(m)))
    names = [f"{name}_{m}" for m in measures for name in VARIANTS]
    found = sized.groupBy("payload_id", "doc").agg(
        F.count_if(F.col("mode") == "raw").cast("int").alias("_n"),
        *[(of(name, m) if name != "schema" else F.coalesce(of(name, m), of("pruned", m))).alias(f"{name}_{m}") for m in measures for name in VARIANTS],
    )
    return found.select("payload_id", *names, F.explode(F.sequence(F.lit(1), F.col("_n")))).select("payload_id", *names)


VARIANTS, ABOUT = ("raw", "pruned", "schema"), ("gate", "n_raw")


def _measurable(rows: DataFrame) -> DataFrame:
    """Valid payloads on one exchange with the gate's verdict; ``mode`` is
    ``schema`` for the samples of lists that were cut, which come beside their
    parts. Both uses read all its columns, so that they share the exchange."""
    columns = ["payload_id", "doc", "steps", "ord", "gate", F.col("n_items").cast("bigint").alias("n_raw"), "mode"]
    valid = F.col("v").isNotNull()
    pruned, schema = F.lit("pruned"), F.lit("schema")
    small = is_uniform_array(_parsed(rows)).withColumn("mode", pruned).where(valid).select(*columns, "v")
    parts = _large(rows, False).withColumn("mode", pruned).where(valid).select(*columns, "copy", "v")
    samples = _large(rows, True).withColumn("mode", schema).where(valid & F.col("gate")).select(*columns, "copy", "v")
    return _placed(small, parts.unionByName(samples))


def _variants(placed: DataFrame) -> DataFrame:
    """Every document to be pruned, and lists that pass the gate also as their
    samples to be summarised, each with a ``copy`` of its own."""
    head = F.to_variant_object(F.slice(items_of(F.col("v")), 1, SAMPLE_ITEMS))
    one = lambda mode, v: F.struct(mode.alias("mode"), v.alias("v"))
    both = F.array(one(F.lit("pruned"), F.col("v")), one(F.lit("schema"), head))
    ways = F.when(F.col("gate") & (F.col("mode") == "pruned"), both).otherwise(F.array(one(F.col("mode"), F.col("v"))))
    rows = placed.select("payload_id", "doc", "copy", "steps", "ord", "n_raw", F.explode(ways).alias("_w"))
    copy = F.col("copy") * 2 + F.when(F.col("_w.mode") == "schema", 1).otherwise(0)
    zero = F.lit(0).cast("bigint").alias("raw_chars")
    return rows.select("payload_id", "doc", copy.alias("copy"), "steps", "ord", "n_raw", zero, "_w.mode", "_w.v")


def ascii_chars(col):
    """Length of JSON text whose non-ASCII characters are written as
    ``\\uXXXX`` escapes (two of them beyond the basic plane)."""
    other = F.regexp_replace(col, r"[\x00-\x7F]", "")
    astral = F.regexp_replace(col, r"[\x{0}-\x{FFFF}]", "")
    return (F.char_length(col) + F.char_length(other) * 5 + F.char_length(astral) * 6).cast("bigint")
