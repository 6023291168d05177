"""Leaf tables back to JSON text.

In document order every leaf contributes one self-contained piece: the opening
brackets and keys since its path parts from the previous leaf, its value, and
the closing brackets until the next leaf. One sort gives the neighbours, one
ordered aggregate joins the pieces; no level-by-level rebuilding is needed.
Whole documents are put together from Arrow batches of sorted leaves.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slim.functions.text import is_index, json_scalar, json_string, step_key
from slim.operators.leaves import document_key, identity


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading steps two paths have in common (0 without a path)."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True).cast("int")
    return F.when(b.isNull(), F.lit(0)).when(at == 0, F.least(F.size(a), F.size(b))).otherwise(at - 1)


def _pad(level: Column, indent: int | None) -> Column:
    if indent is None:
        return F.lit("")
    return F.concat(F.lit("\n"), F.repeat(F.lit(" " * indent), level))


def _key_prefix(step: Column, indent: int | None) -> Column:
    colon = ": " if indent is not None else ":"
    return F.when(is_index(step), F.lit("")).otherwise(F.concat(json_string(step_key(step)), F.lit(colon)))


def leaf_piece(steps: Column, c_prev: Column, c_next: Column, body: Column, base: int, indent: int | None) -> Column:
    """Text of one leaf between its neighbours, for a node at level ``base``.

    ``c_prev`` / ``c_next`` are the shared prefix lengths with the neighbours.
    """
    n = F.size(steps)
    first = c_prev < base
    low = F.greatest(c_prev, F.lit(base))
    # Containers of level low+1 .. n-1 open here; level low opens on the first leaf.
    opened = F.when(
        n > low,
        F.array_join(
            F.transform(
                F.sequence(low, n - 1),
                lambda lv: F.concat(
                    F.when((lv > low) | first, F.when(is_index(F.get(steps, lv)), F.lit("[")).otherwise(F.lit("{")))
                    .otherwise(F.lit(",")),
                    _pad(lv + 1, indent),
                    _key_prefix(F.get(steps, lv), indent),
                ),
            ),
            "",
        ),
    ).otherwise(F.lit(""))
    # c_next is the level of the container both leaves sit in: it stays open.
    last = c_next < base
    stop = F.when(last, F.lit(base)).otherwise(c_next + 1)
    closed = F.when(
        n > stop,
        F.array_join(
            F.transform(
                F.sequence(n - 1, stop, F.lit(-1)),
                lambda lv: F.concat(
                    _pad(lv, indent), F.when(is_index(F.get(steps, lv)), F.lit("]")).otherwise(F.lit("}"))
                ),
            ),
            "",
        ),
    ).otherwise(F.lit(""))
    return F.concat(opened, body, closed)


def with_neighbours(leaves: DataFrame, group: list[str], base: int = 0) -> DataFrame:
    """Adds ``_cp`` and ``_cn``, the prefix lengths shared with the previous
    and the next leaf of the group; -1 at its ends, and for leaves at level
    ``base``, which open and close nothing."""
    w = Window.partitionBy(*group).orderBy("ord")
    # Placeholders of pruned content are no neighbours.
    path = F.when(F.col("kind") != "pruned", F.col("steps"))
    near = leaves.withColumns({"_prev": F.lag(path).over(w), "_next": F.lead(path).over(w)})
    shared = {
        name: F.when(F.col(other).isNull() | (F.size("steps") <= base), F.lit(-1)).otherwise(shared_prefix(F.col("steps"), F.col(other)))
        for name, other in (("_cp", "_prev"), ("_cn", "_next"))
    }
    return near.withColumns(shared).drop("_prev", "_next")


def joined(piece: Column, order: Column | str, sep: str = "") -> Column:
    """Aggregate: the pieces of a group in order."""
    o = F.col(order) if isinstance(order, str) else order
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), piece.alias("t")))), lambda x: x["t"]), sep)


def joined_when(cond: Column, piece: Column, order: str, sep: str = "") -> Column:
    """Aggregate: the pieces of the rows that meet the condition, in order."""
    item = F.when(cond, F.struct(F.col(order).alias("o"), piece.alias("t")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), sep)


def render_groups(leaves: DataFrame, group: list[str], extra: list[Column] = (), indent: int | None = None) -> DataFrame:
    """JSON text per group, each group being one (sub)document whose leaf
    paths start at its root."""
    near = with_neighbours(leaves, group)
    piece = leaf_piece(
        F.col("steps"), F.col("_cp"), F.col("_cn"), json_scalar(F.col("kind"), F.col("scalar")), 0, indent
    )
    return near.withColumn("_piece", piece).groupBy(*group).agg(joined(F.col("_piece"), "ord").alias("text"), *extra)


def rebuild(leaves: DataFrame, indent: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(payload_id, text)`` from a leaf table; compact, or indented. ``keep``
    names columns that all leaves of a document share."""
    names = [*identity(leaves), *keep]
    rows = in_document_order(leaves, "ord").select(*names, "_first", "steps", json_scalar(F.col("kind"), F.col("scalar")).alias("body"))
    schema = T.StructType([*leaves.select(*names).schema, T.StructField("text", T.StringType())])

    def run(batches):
        for docs, starts in whole_documents(batches):
            texts = joined_runs(*leaf_pieces(docs["steps"], starts, docs["body"], indent), starts)
            yield pa.RecordBatch.from_arrays([*(docs[c].take(pa.array(starts)) for c in names), texts], names=[*names, "text"])

    return rows.mapInArrow(run, schema)


def in_document_order(rows: DataFrame, order: str) -> DataFrame:
    """Documents whole and sorted within their partition, with ``_first`` at the
    first row of each. The window asks for an exchange only where there was none."""
    w = Window.partitionBy(*document_key(rows)).orderBy(order)
    return rows.withColumn("_first", F.row_number().over(w) == 1)


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, pa.Array], np.ndarray]]:
    """The columns of whole documents and the first row of each, from batches in
    document order; the last document of a batch waits for the next one."""
    held, schema = [], None

    def table(parts):
        rows = pa.Table.from_batches(parts, schema).combine_chunks()
        columns = {c: rows[c].chunk(0) for c in rows.column_names}
        return columns, np.flatnonzero(flags(columns["_first"]))

    for batch in batches:
        schema = batch.schema
        starts = np.flatnonzero(flags(batch.column("_first")))
        if len(starts) and (held or starts[-1]):
            held.append(batch.slice(0, int(starts[-1])))
            if any(part.num_rows for part in held):
                yield table([part for part in held if part.num_rows])
            held = [batch.slice(int(starts[-1]))]
        elif batch.num_rows:
            held.append(batch)
    if held:
        yield table(held)


def flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def joined_runs(pool: pa.Array, parts: np.ndarray, at: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Texts of runs of rows: the ``parts`` of ``pool`` in a row, where row i
    begins with part ``at[i]`` and a run with row ``starts[j]``."""
    taken = pool.take(pa.array(parts))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(taken) + 1][np.append(at[starts], len(parts))]
    if ends[-1] > 2**31 - 1:
        raise ValueError("texts of one batch over 2 GB")
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), data])


def pooled(*columns: pa.Array | list[bytes]) -> tuple[pa.Array, list[int]]:
    """One array of texts, and where each of the columns begins in it."""
    arrays = [pa.array(c, pa.large_binary()) if isinstance(c, list) else c.cast(pa.large_binary()) for c in columns]
    return pa.concat_arrays(arrays), np.cumsum([0, *map(len, arrays)])[:-1].tolist()


# What JSON text escapes inside a string.
ESCAPES = {chr(i): f"\\u{i:04X}" for i in range(32)} | {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


def key_text(step: bytes, colon: str) -> bytes:
    """The key a step stands for and a colon; nothing for an index step."""
    if step[:1] == b"[":
        return b""
    key = step[step[:1] == b"\\" :].decode("utf-8", "surrogateescape")
    return f'"{key.translate(str.maketrans(ESCAPES))}"{colon}'.encode("utf-8", "surrogateescape")


def shared_steps(codes: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of leading steps every leaf shares with the one before it, -1 at
    the first leaf of a document."""
    shared = np.zeros(len(sizes), np.int64)
    shared[starts] = -1
    rows, level = np.flatnonzero(shared == 0), 0
    while len(rows):
        rows = rows[(sizes[rows] > level) & (sizes[rows - 1] > level)]
        rows = rows[codes[offsets[rows] + level] == codes[offsets[rows - 1] + level]]
        level += 1
        shared[rows] = level
    return shared


def leaf_pieces(steps: pa.ListArray, starts: np.ndarray, body: pa.Array, indent: int | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What :func:`leaf_piece` gives for whole documents, for all leaves of a
    batch at once: a pool of texts, the parts of it that follow each other, and
    the first part of every leaf. Leaves without a body give nothing."""
    offsets = np.asarray(steps.offsets, np.int64) - steps.offsets[0].as_py()
    sizes, offsets = np.diff(offsets), offsets[:-1]
    known = steps.flatten().dictionary_encode()
    codes = known.indices.to_numpy(zero_copy_only=False)
    names = known.dictionary.cast(pa.binary()).to_pylist()
    real = body.is_valid().to_numpy(zero_copy_only=False)

    shared = shared_steps(codes, offsets, sizes, starts)
    # Placeholders of pruned content are no neighbours.
    before = np.where(np.append(False, real[:-1]), shared, -1)
    behind = np.where(np.append(real[1:], False), np.append(shared[1:], -1), -1)
    low, stop = np.maximum(before, 0), behind + 1
    opened = np.where(real, np.maximum(sizes - low, 0), 0)
    closed = np.where(real, np.maximum(sizes - stop, 0), 0)
    count = opened + real + closed
    at = np.cumsum(count) - count

    leaf = np.repeat(np.arange(len(sizes)), sizes)
    level = np.arange(len(leaf)) - np.repeat(offsets, sizes)
    indexed = np.array([n[:1] == b"[" for n in names], bool)
    texts = [key_text(n, ":" if indent is None else ": ") for n in names]
    # Index steps differ in their brackets only.
    first_index = int(indexed.argmax()) if indexed.any() else 0
    name = np.where(indexed[codes], first_index, codes) if len(codes) else codes

    def pad(n):
        return b"" if indent is None else b"\n" + b" " * (indent * n)

    # Containers above a leaf open with a bracket, or a comma where the first of them is open already.
    o = np.flatnonzero((level >= low[leaf]) & real[leaf])
    comma = (level[o] == low[leaf[o]]) & (before[leaf[o]] >= 0)
    opening, which = np.unique((name[o] * (level.max(initial=0) + 1) + level[o]) * 2 + comma, return_inverse=True)
    heads = []
    for k in opening.tolist():
        n, lv = divmod(k // 2, int(level.max(initial=0)) + 1)
        heads.append((b"," if k % 2 else b"[" if indexed[n] else b"{") + pad(lv + 1) + texts[n])
    # They close behind it down to the container that the next leaf is in, too.
    c = np.flatnonzero((level >= stop[leaf]) & real[leaf])
    closing, whose = np.unique(level[c] * 2 + (indexed[codes[c]] if len(codes) else False), return_inverse=True)
    tails = [pad(k // 2) + (b"]" if k % 2 else b"}") for k in closing.tolist()]

    pool, (head, tail, own) = pooled(heads, tails, body)
    parts = np.empty(int(count.sum()), np.int64)
    parts[at[leaf[o]] + level[o] - low[leaf[o]]] = head + which
    parts[(at + opened)[real]] = own + np.flatnonzero(real)
    parts[(at + opened)[leaf[c]] + sizes[leaf[c]] - level[c]] = tail + whose
    return pool, parts, at
