"""JSON texts larger than a VARIANT can be, cut into parts that fit.

A text is cut at the commas of its outermost container; members that are still
too large are cut the same way. A part is a payload row with the path and the
positions in front of it, and shredding goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of text. A VARIANT holds 128 MiB; small numbers take up to six bytes there for two of text.
LARGE = 16 << 20
WIDEST = 120 << 20  # a single value; longer ones are refused
BLOCK = 1 << 20
BATCH = 8 << 20


def is_large(raw: Column, limit: int = LARGE) -> Column:
    return F.coalesce(F.octet_length(raw) > limit, F.lit(False))


def separators(data: np.ndarray, start: int, stop: int) -> tuple[list[int], list[int], int] | None:
    """Commas and colons directly inside the container that begins at ``start``,
    and the place of its closing bracket; None if it does not close at
    ``stop - 1``. The text is read block by block: what is carried on is
    whether a string is open, a run of backslashes, and the nesting."""
    commas, colons, quoted, slashes, depth = [], [], 0, 0, 0
    for at in range(start, stop, BLOCK):
        block = data[at : min(at + BLOCK, stop)]
        n = len(block)
        index = np.arange(n, dtype=np.int32)
        slash = block == 92
        # Backslashes directly in front of each character; an odd number escapes it.
        last = np.maximum.accumulate(np.where(slash, -1, index))
        run = np.where(last < 0, index + 1 + slashes, index - last)
        before = np.empty(n, dtype=np.int32)
        before[0], before[1:] = slashes, run[:-1]
        slashes = int(run[-1])
        inside = (np.cumsum((block == 34) & (before % 2 == 0), dtype=np.int32) + quoted) % 2
        quoted = int(inside[-1])
        marks = np.flatnonzero((inside == 0) & ((block == 44) | (block == 58) | (block == 91) | (block == 93) | (block == 123) | (block == 125)))
        kinds = block[marks]
        step = np.where((kinds == 91) | (kinds == 123), 1, np.where((kinds == 93) | (kinds == 125), -1, 0))
        depths = depth + np.cumsum(step)
        closed = np.flatnonzero(depths <= 0)
        if len(closed) and (at + int(marks[closed[0]]) != stop - 1):
            return None
        here = depths == 1
        commas += (at + marks[here & (kinds == 44)]).tolist()
        colons += (at + marks[here & (kinds == 58)]).tolist()
        depth = int(depths[-1]) if len(depths) else depth
    return (commas, colons, stop - 1) if depth == 0 and not quoted else None


def trimmed(data: bytes, start: int, stop: int) -> tuple[int, int]:
    """Without JSON white space at both ends."""
    while start < stop and data[start] in b" \t\n\r":
        start += 1
    while stop > start and data[stop - 1] in b" \t\n\r":
        stop -= 1
    return start, stop


def members(data: bytes, start: int, stop: int) -> list[tuple[str | None, int, int]] | None:
    """(key, start, stop) of the members of a container, keys of objects sorted
    as a VARIANT sorts them with the later of two equal ones kept; None where
    the text is not JSON."""
    pair = data[start : start + 1] + data[stop - 1 : stop]
    if pair not in (b"[]", b"{}"):
        return None
    found = separators(np.frombuffer(data, np.uint8), start, stop)
    if found is None:
        return None
    commas, colons, end = found
    edges = [start, *commas, end]
    if trimmed(data, start + 1, end) == (end, end) and not commas:
        return []
    if pair == b"[]":
        return None if colons else [(None, *trimmed(data, a + 1, z)) for a, z in zip(edges, edges[1:])]
    if len(colons) != len(edges) - 1:
        return None
    own = {}
    for a, colon, z in zip(edges, colons, edges[1:]):
        if not a < colon < z:
            return None
        p, q = trimmed(data, a + 1, colon)
        key = plain_json(data[p:q])
        if not isinstance(key, str):
            return None
        own[key] = trimmed(data, colon + 1, z)
    return [(k, *own[k]) for k in sorted(own, key=lambda k: k.encode("utf-16-be", "surrogatepass"))]


class NotJson:
    """What a text that is not JSON is read as."""


def plain_json(text: bytes):
    def refuse(name):
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return NotJson


def parts(data: bytes, limit: int) -> Iterator[tuple[list[str], list[int], int, int]] | None:
    """(steps, ord, start, stop) of parts no larger than ``limit`` (or single
    values) that make up the text; None where it is not JSON or where a single
    value is more than a VARIANT holds."""
    out, work = [], [([], [], *trimmed(data, 0, len(data)))]
    while work:
        steps, order, start, stop = work.pop()
        if stop - start <= limit or data[start : start + 1] not in (b"[", b"{"):
            if plain_json(data[start:stop]) is NotJson or stop - start > WIDEST:
                return None
            out.append((steps, order, start, stop))
            continue
        own = members(data, start, stop)
        if own is None:
            return None
        if not own:
            out.append((steps, order, start, stop))
        for i, (key, a, z) in enumerate(own):
            step = f"[{i}]" if key is None else "\\" + key if key[:1] in ("[", "\\") else key
            work.append(([*steps, step], [*order, i], a, z))
    return sorted(out, key=lambda p: p[1])


def cut_documents(payloads: DataFrame, min_items: int | None = None, samples: int = 0, limit: int = LARGE) -> DataFrame:
    """Parts (steps, ord, raw) of each row's text ``raw``, with its other
    columns and ``n_items``: the length of a list, null for other texts.

    With ``min_items``, a list of at least that many items, all of them objects,
    comes as one row: its first ``samples`` items as a list, ``gate`` true. Every
    part is checked; text that is not JSON comes as one row with null ``raw``."""
    keep = [c for c in payloads.columns if c != "raw"]

    def run(batches):
        for batch in batches:
            kept = batch.select(keep)
            for i, text in enumerate(batch.column("raw")):
                data = text.as_buffer().to_pybytes()
                cut = parts(data, limit)
                if cut is None:
                    yield table(kept, i, [([], [], None)], None, False)
                    continue
                start, stop = trimmed(data, 0, len(data))
                top = members(data, start, stop) if data[start : start + 1] == b"[" else None
                objects = top is not None and all(data[a : a + 1] == b"{" for _, a, _ in top)
                n = None if top is None else len(top)
                if min_items is not None and objects and n >= min_items:
                    yield table(kept, i, [([], [], b"[" + b",".join(data[a:z] for _, a, z in top[:samples]) + b"]")], n, True)
                    continue
                rows, size = [], 0
                for steps, order, a, z in cut:
                    rows.append((steps, order, data[a:z]))
                    size += z - a
                    if size > BATCH:
                        yield table(kept, i, rows, n, False)
                        rows, size = [], 0
                if rows:
                    yield table(kept, i, rows, n, False)

    def table(kept, i, rows, n_items, gate):
        n = len(rows)
        own = [c.take(pa.array([i] * n)) for c in kept.columns]
        made = [
            pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            pa.array([None if r[2] is None else r[2].decode() for r in rows], pa.string()), pa.array([n_items] * n, pa.int64()), pa.array([gate] * n, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays([*own, *made], names=[*keep, "steps", "ord", "raw", "n_items", "gate"])

    schema = payloads.select(*keep).schema
    own = (("steps", T.ArrayType(T.StringType())), ("ord", T.ArrayType(T.IntegerType())), ("raw", T.StringType()), ("n_items", T.LongType()), ("gate", T.BooleanType()))
    for name, kind in own:
        schema = schema.add(name, kind)
    return payloads.mapInArrow(run, schema)
