"""Pruning a leaf table: template addresses, empties, cascade, compaction and
flattening below a depth. Filters and projections are narrow; the windows run
on the document distribution of the leaf table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slim.functions.text import MAX_DEPTH, is_blank, is_index, is_template_url, path_text, step_key
from slim.operators.leaves import document_key, identity

PRUNED = "pruned"


def flatten_start(steps: Column, max_depth: int) -> Column:
    """1-based position of the first step inside a flattened object, or NULL.
    Objects deepen the nesting, lists do not, so it is the key step number
    ``max_depth + 1``."""
    numbered = F.transform(steps, lambda s, i: F.when(~is_index(s), i + 1))
    # Most paths are too short to be looked at.
    return F.when(F.size(steps) > max_depth, F.get(F.filter(numbered, lambda p: p.isNotNull()), F.lit(max_depth)))


def _annotate(leaves: DataFrame, max_depth: int) -> DataFrame:
    """Adds ``_f`` (start of the flattened run of keys) and ``_g`` (the number
    of keys in that run)."""
    start = flatten_start(F.col("steps"), max_depth)
    rest = F.slice("steps", F.col("_f"), F.size("steps") - F.col("_f") + 1)
    first_index = F.array_position(F.transform(rest, is_index), True)
    run = F.when(F.col("_f").isNull(), None).otherwise(
        F.when(first_index == 0, F.size(rest)).otherwise(first_index.cast("int") - 1)
    )
    return leaves.withColumn("_f", start).withColumn("_g", run)


def _is_url_leaf() -> Column:
    last_is_key = ~is_index(F.element_at("steps", -1))
    reachable = F.col("_f").isNull()
    return (
        (F.col("kind") == "string")
        & (F.size("steps") > 0)
        & F.when(F.size("steps") > 0, last_is_key).otherwise(False)
        & reachable
        & is_template_url(F.col("scalar"))
    )


def _is_empty_leaf() -> Column:
    empty = F.col("kind").isin("null", "[]", "{}") | ((F.col("kind") == "string") & is_blank(F.col("scalar")))
    inside_kept_list = F.col("_f").isNotNull() & (F.col("_f") + F.col("_g") <= F.size("steps"))
    return empty & ~inside_kept_list & (F.size("steps") > 0)


def drop_template_urls(leaves: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Remove templated addresses that are direct values of object keys.
    List items and everything below the flatten depth are left alone."""
    return _annotate(leaves, max_depth).where(~F.coalesce(_is_url_leaf(), F.lit(False))).drop("_f", "_g")


def drop_empty(leaves: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Remove null, blank strings and empty containers; ``false`` and ``0``
    stay, as do the insides of lists in a flattened object."""
    return _annotate(leaves, max_depth).where(~F.coalesce(_is_empty_leaf(), F.lit(False))).drop("_f", "_g")


def _flattened_steps() -> Column:
    f, g = F.col("_f"), F.col("_g")
    dotted = F.array_join(F.transform(F.slice("steps", f, g), step_key), ".")
    joined = F.when(dotted.rlike(r"^[\[\\]"), F.concat(F.lit("\\"), dotted)).otherwise(dotted)
    tail = F.slice("steps", f + g, F.greatest(F.size("steps") - f - g + 1, F.lit(0)))
    return F.when(f.isNull(), F.col("steps")).otherwise(
        F.concat(F.slice("steps", F.lit(1), f - 1), F.array(joined), tail)
    )


def _flatten(annotated: DataFrame) -> DataFrame:
    """Join the flattened keys; where two sources meet under one dotted key
    the later one wins."""
    f, g = F.col("_f"), F.col("_g")
    flat = annotated.withColumns(
        {"_new": _flattened_steps(), "_src": F.when(f.isNotNull(), F.slice("ord", F.lit(1), f + g - 1))}
    )
    node = F.struct(F.slice("ord", F.lit(1), f - 1).alias("o"), F.get("_new", f - 1).alias("k"))
    # Only dotted keys can collide; other rows have groups of their own, in the
    # order that they have already.
    groups = {"_own": F.when(f.isNull(), F.col("ord")), "_spot": F.when(f.isNotNull(), F.to_json(node))}
    last = F.max("_src").over(Window.partitionBy(*document_key(annotated), *groups))
    kept = flat.withColumns(groups).withColumn("_last", last).where(f.isNull() | (F.col("_src") == F.col("_last")))
    return kept.withColumn("steps", F.col("_new")).drop("_new", "_src", "_last", *groups)


def flatten_below(leaves: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Dotted keys for objects at ``max_depth`` and deeper. Empty values of
    flattened keys are dropped first, as they never reach the result."""
    ann = _annotate(leaves, max_depth).where(F.col("_f").isNull() | ~F.coalesce(_is_empty_leaf(), F.lit(False)))
    return _flatten(ann).drop("_f", "_g")


def clean(leaves: DataFrame, max_depth: int = MAX_DEPTH, anchor: Column | None = None) -> DataFrame:
    """Template addresses, empties and flattening in one pass over the leaves.

    Leaves for which ``anchor`` holds are kept even when pruned, with the kind
    ``pruned``: a document (or sample item) without survivors still has a row.
    """
    ann = _annotate(leaves, max_depth)
    gone = F.coalesce(_is_url_leaf() | _is_empty_leaf(), F.lit(False))
    if anchor is None:
        return _flatten(ann.where(~gone)).drop("_f", "_g")
    ann = ann.withColumn("_gone", gone).where(~F.col("_gone") | anchor)
    # A pruned anchor must not win a dotted key: it takes no part in flattening.
    ann = ann.withColumns(
        {
            "_f": F.when(~F.col("_gone"), F.col("_f")),
            "kind": F.when(F.col("_gone"), F.lit(PRUNED)).otherwise(F.col("kind")),
        }
    )
    return _flatten(ann).drop("_f", "_g", "_gone")


def _containers(leaves: DataFrame, max_depth: int, levels: Column) -> DataFrame:
    """The first ``levels`` containers around every leaf, from the root, with
    ``alive``: whether pruning keeps the leaf."""
    gone = F.coalesce(_is_url_leaf() | _is_empty_leaf(), F.lit(False))
    flagged = _annotate(leaves, max_depth).select(*identity(leaves), "steps", "ord", (~gone).alias("alive"))
    inside = flagged.where(F.size("steps") > 0)
    return inside.select("*", F.explode(F.sequence(F.lit(0), levels - 1)).alias("n")).select(
        *identity(leaves),
        F.slice("ord", F.lit(1), F.col("n")).alias("ord"),
        F.slice("steps", F.lit(1), F.col("n")).alias("steps"),
        "alive",
    )


def container_survival(leaves: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Every container with ``survives``: whether any leaf below it does.
    The root always survives."""
    around = _containers(leaves, max_depth, F.size("steps"))
    found = around.groupBy(*identity(leaves), "ord", "steps").agg(F.max("alive").alias("alive"))
    survives = F.col("alive") | (F.size("ord") == 0)
    return found.select(*identity(leaves), path_text(F.col("steps")).alias("path"), "ord", survives.alias("survives"))


def surviving_containers(leaves: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Containers that keep at least one descendant after pruning. Only leaves
    that are kept show more of them than the root."""
    around = _containers(leaves, max_depth, F.when(F.col("alive"), F.size("steps")).otherwise(1))
    return around.select(*identity(leaves), "ord", "steps").distinct().select(*identity(leaves), path_text(F.col("steps")).alias("path"), "ord")


def _ranks(ords: pa.Array, firsts: np.ndarray, last: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray]]:
    """For every step of leaves in document order, how many siblings with leaves
    stand before it. ``firsts`` marks the first leaf of a document, ``last`` is
    the previous leaf and its result."""
    offsets = np.asarray(ords.offsets) - ords.offsets[0].as_py()
    sizes = np.concatenate([[len(last[0])], np.diff(offsets)])
    values = np.concatenate([last[0], np.asarray(ords.flatten())])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros(len(values), dtype=np.int32)
    out[: len(last[0])] = last[1]
    # Whether a leaf has left the path of the leaf before it above the level.
    left = np.concatenate([[True], firsts])
    for level in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > level)
        here = values[starts[rows] + level]
        # The leaf before has this level too if both are still on one path.
        moved = left[rows].copy()
        moved[1:] |= here[1:] != here[:-1]
        moved[1:] |= np.diff(rows) != 1
        counted = np.cumsum(moved)
        opened = np.maximum.accumulate(np.where(left[rows], np.arange(len(rows)), 0))
        base = np.where((opened == 0) & (rows[0] == 0), out[level] if rows[0] == 0 else 0, 0)
        out[starts[rows] + level] = counted - counted[opened] + base
        left[rows] = moved
        left[sizes <= level] = True
    tail = slice(starts[-1], starts[-1] + sizes[-1])
    ranks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out[len(last[0]) :], pa.int32()))
    return ranks, (values[tail], out[tail])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def sibling_ranks(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """:func:`_ranks` over the batches of a task; a document may run over several."""
    last = np.empty(0, np.int32), np.empty(0, np.int32)
    for ords, firsts in batches:
        ranks, last = _ranks(ords, firsts.to_numpy(zero_copy_only=False), last)
        yield ranks


# It counts on the order of the rows, so nothing may move past it.
sibling_ranks = sibling_ranks.asNondeterministic()


def compact_positions(leaves: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Renumber list positions without gaps. In document order a step's new
    position is told by the leaf before, so one sort and one pass do for all
    levels. Lists in objects flattened below ``max_depth`` are whole and keep their
    positions."""
    doc = document_key(leaves)
    flat = F.when(F.size("ord") > F.size("steps"), flatten_start(F.col("steps"), max_depth))
    first = F.row_number().over(Window.partitionBy(*doc).orderBy("ord")) == 1
    ranked = leaves.withColumn("_first", first).sortWithinPartitions(*doc, "ord").withColumn("_new", sibling_ranks("ord", "_first"))
    listed = F.transform("steps", lambda s, i: is_index(s) & (flat.isNull() | (i + 1 < flat)))
    rows = ranked.withColumn("_in", listed)
    inside = lambda i: F.coalesce(F.get("_in", i), F.lit(False))
    place = lambda i: F.concat(F.lit("["), F.get("_new", i), F.lit("]"))
    return rows.select(
        *identity(leaves),
        F.transform("steps", lambda s, i: F.when(inside(i), place(i)).otherwise(s)).alias("steps"),
        F.transform("ord", lambda o, i: F.when(inside(i), F.get("_new", i)).otherwise(o)).alias("ord"),
        "kind",
        "scalar",
    )
