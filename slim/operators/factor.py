"""Factoring repeated content out of lists of objects.

Works on the member table: one row per (document, item, key) with the member's
JSON text. It is made from the leaf table by one aggregate. What members share is
found document by document, in Arrow batches of sorted members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slim.functions.text import is_index, json_scalar, json_string, let, step_key
from slim.operators.leaves import document_key, identity
from slim.operators.prune import PRUNED
from slim.operators.render import flags, in_document_order, joined, leaf_piece, whole_documents, with_neighbours

REFERENCE = "→ (same as _common.{})"


def members(leaves: DataFrame, keep: tuple[str, ...] = (), indent: int | None = None) -> DataFrame:
    """Nodes two levels below the root. Shallower leaves have no ``key``
    (and, for scalar roots, no ``item``)."""
    near = with_neighbours(leaves, document_key(leaves), 2)
    body = json_scalar(F.col("kind"), F.col("scalar"))
    third = F.get("steps", F.lit(2))
    shape = (
        F.when(third.isNotNull(), F.when(is_index(third), "list").otherwise("object"))
        .when(F.col("kind").isin("[]", "array"), "list")
        .when(F.col("kind").isin("{}", "object"), "object")
        .otherwise("scalar")
    )
    rows = near.select(
        *identity(leaves),
        *keep,
        "ord",
        F.get("ord", F.lit(0)).alias("item"),
        F.get("steps", F.lit(0)).alias("top"),
        F.get("steps", F.lit(1)).alias("key"),
        shape.alias("shape"),
        "kind",
        "scalar",
        leaf_piece(F.col("steps"), F.col("_cp"), F.col("_cn"), body, 2, indent).alias("piece"),
    )
    # A placeholder of pruned content says nothing about a member that has more.
    real = F.col("kind") != PRUNED
    return rows.groupBy(*identity(leaves), *keep, "item", "top", "key").agg(
        F.min("ord").alias("pos"),
        F.first(F.when(real, F.col("shape")), ignorenulls=True).alias("shape"),
        F.coalesce(F.first(F.when(real, F.col("kind")), ignorenulls=True), F.lit(PRUNED)).alias("kind"),
        F.first(F.when(real, F.col("scalar")), ignorenulls=True).alias("scalar"),
        joined(F.col("piece"), "ord").alias("text"),
    )


def with_items(member_rows: DataFrame) -> DataFrame:
    """Adds ``n_items``, ``first_item`` and ``of_objects`` (the root is a list
    and every item an object) per document."""
    by_doc = Window.partitionBy(*document_key(member_rows))
    ranked = member_rows.withColumn("_r", F.dense_rank().over(by_doc.orderBy("item")))
    is_member = F.coalesce(is_index(F.col("top")) & ~is_index(F.col("key")), F.lit(False))
    return ranked.select(
        *member_rows.columns,
        F.max("_r").over(by_doc).alias("n_items"),
        F.min("item").over(by_doc).alias("first_item"),
        F.min(is_member).over(by_doc).alias("of_objects"),
    )


def _canonical() -> Column:
    """Equal numbers are equal whatever their spelling; booleans are not numbers."""

    def number(d: Column) -> Column:
        whole = (d == F.floor(d)) & (F.abs(d) < 1e37)
        return F.when(whole, F.col("scalar").try_cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))

    is_number = F.col("kind").isin("int", "float")
    value = F.when(is_number, let(F.col("scalar").try_cast("double"), number)).otherwise(F.coalesce("scalar", F.lit("")))
    return F.concat_ws(":", F.when(is_number, F.lit("number")).otherwise(F.col("kind")), value)


def with_factors(counted: DataFrame) -> DataFrame:
    """Adds ``uniform`` (same scalar in every item), ``fp`` and ``shared``
    (sub-object seen more than once), ``ref`` (its label) and ``leads`` (this
    row is its first occurrence). Rows come in document order; ``_first`` is
    true at the first of each document."""
    print_ = F.when(F.col("of_objects") & (F.col("shape") == "object"), F.sha2("text", 256))
    rows = in_document_order(counted.withColumns({"_c": F.when(F.col("shape") == "scalar", _canonical()), "fp": print_}), "pos")
    # The order of the rows stands for their position from here on.
    names = [*(c for c in counted.columns if c != "pos"), "fp", "_first"]
    added = [T.StructField(c, T.BooleanType()) for c in ("uniform", "shared", "leads")]
    schema = T.StructType([*rows.select(*names).schema, *added, T.StructField("ref", T.StringType())])

    def run(batches):
        for docs, starts in whole_documents(batches):
            found = _factors(docs, starts)
            yield pa.RecordBatch.from_arrays([*(docs[c] for c in names), *found], names=schema.names)

    return rows.select(*names, "_c").mapInArrow(run, schema)


def _codes(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of equal texts, -1 for none, and the texts."""
    known = column.dictionary_encode()
    return known.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), known.dictionary.cast(pa.binary()).to_pylist()


def _factors(rows: dict[str, pa.Array], starts: np.ndarray) -> list[pa.Array]:
    """``uniform``, ``shared``, ``leads`` and ``ref`` of the members of whole documents."""
    n = len(rows["fp"])
    doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    key, names = _codes(rows["key"])
    value, _ = _codes(rows["_c"])
    wanted = rows["n_items"].to_numpy(zero_copy_only=False)
    # Uniform: as many values of a key as items, each equal to the first.
    _, first, group = np.unique(doc * (len(names) + 1) + key, return_index=True, return_inverse=True)
    count, equal = np.bincount(group), np.bincount(group, weights=(value >= 0) & (value == value[first][group]))
    uniform = flags(rows["of_objects"]) & (count[group] == wanted) & (equal[group] == wanted)

    prints, texts = _codes(rows["fp"])
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    item = rows["item"].fill_null(-1).to_numpy(zero_copy_only=False)
    # Sub-objects by document and print, in order of item and key.
    some = np.flatnonzero(prints >= 0)
    some = some[np.lexsort((rank[key[some]], item[some], prints[some], doc[some]))]
    same = (np.diff(doc[some]) == 0) & (np.diff(prints[some]) == 0)
    new = np.append(True, ~same)[: len(some)]
    group = np.cumsum(new) - 1
    often = np.bincount(group, minlength=1) > 1
    shared, leads, place = np.zeros(n, bool), np.zeros(n, bool), np.full(n, -1)
    shared[some] = often[group]
    leads[some[new]] = often[: new.sum()]
    place[some] = np.where(often[group], (np.cumsum(often) - 1)[group], -1)

    # Labels are numbered where several shared objects were first seen under one key.
    lead = some[new][often[: new.sum()]]
    plain = [names[k][names[k][:1] == b"\\" :] for k in key[lead]]
    order = sorted(range(len(lead)), key=lambda g: (doc[lead[g]], plain[g], item[lead[g]], texts[prints[lead[g]]]))
    labels, nth, before = [b""] * len(lead), 0, None
    for g in order:
        nth = nth + 1 if before == (doc[lead[g]], plain[g]) else 1
        before = doc[lead[g]], plain[g]
        labels[g] = plain[g] if nth == 1 else plain[g] + b"#%d" % nth
    refs = pa.array(labels, pa.binary()).cast(pa.string()).take(pa.array(place, mask=place < 0))
    return [pa.array(uniform), pa.array(shared), pa.array(leads), refs]


def uniform_values(leaves: DataFrame) -> DataFrame:
    """Keys with one scalar value over all items of a list of objects."""
    rows = with_factors(with_items(members(leaves)))
    return rows.where(F.col("uniform") & (F.col("item") == F.col("first_item"))).select(
        *identity(leaves), step_key(F.col("key")).alias("key"), "kind", "scalar"
    )


def fingerprints(leaves: DataFrame) -> DataFrame:
    """SHA-256 over the key-sorted JSON text of every direct sub-object."""
    return (
        members(leaves)
        .where((F.col("shape") == "object") & is_index(F.col("top")) & ~is_index(F.col("key")))
        .select(*identity(leaves), "item", step_key(F.col("key")).alias("key"), F.sha2("text", 256).alias("fp"), "text")
    )


def shared_objects(prints: DataFrame) -> DataFrame:
    """Sub-objects seen more than once in a document, with the key and item
    where they were first seen."""
    return (
        prints.groupBy(*identity(prints), "fp")
        .agg(
            F.count("*").alias("n"),
            F.min_by("key", F.struct("item", "key")).alias("ref_name"),
            F.min("item").alias("first_item"),
            F.first("text").alias("text"),
        )
        .where("n > 1")
    )


def member_output(text: Column) -> Column:
    """Text of a member inside its item: the reference label when shared."""
    label = F.concat(F.lit(REFERENCE.split("{}")[0]), F.col("ref"), F.lit(REFERENCE.split("{}")[1]))
    return F.when(F.col("shared"), json_string(label)).otherwise(text)


def factor_items(leaves: DataFrame) -> DataFrame:
    """The factored document as rows ``(payload_id, section, item, key,
    text)``; sections are ``_common_values``, ``_common`` and ``items``.
    Documents with nothing to factor only have ``items`` rows."""
    rows = with_factors(with_items(members(leaves)))
    key = step_key(F.col("key"))
    no_item = F.lit(None).cast("int")

    def entry(section: str, item: Column, name: Column, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.alias("item"), name.alias("key"), text.alias("text"))

    parts = F.array_compact(
        F.array(
            F.when(
                F.col("uniform") & (F.col("item") == F.col("first_item")),
                entry("_common_values", no_item, key, F.col("text")),
            ),
            F.when(F.col("leads"), entry("_common", no_item, F.col("ref"), F.col("text"))),
            F.when(~F.col("uniform"), entry("items", F.col("item"), key, member_output(F.col("text")))),
        )
    )
    return rows.select(*identity(leaves), F.inline(parts))
