"""Payload tables: where documents come from, and references to stored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slim.functions.text import json_string, strip


def payload_table(
    source: SparkSession | DataFrame,
    path: str | None = None,
    id_col: str = "payload_id",
    json_col: str = "raw",
    lines: bool = False,
) -> DataFrame:
    """``(payload_id, raw)``, one row per JSON document.

    From a DataFrame: two of its columns. From a session and a path: whole
    files (id = file path), or with ``lines`` one document per line
    (id = file path and a running number within its split).
    """
    if isinstance(source, DataFrame):
        return source.select(F.col(id_col).alias("payload_id"), F.col(json_col).alias("raw"))
    if lines:
        rows = source.read.text(path).where(F.length(F.trim("value")) > 0)
        number = F.monotonically_increasing_id().cast("string")
        return rows.select(F.concat_ws("#", F.col("_metadata.file_path"), number).alias("payload_id"), F.col("value").alias("raw"))
    files = source.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("payload_id"), F.col("value").alias("raw"))


def _text_member(v: Column, name: str) -> Column:
    """The member if it is a string, else NULL."""
    member = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", member.cast("string"))


def _lone_result(v: Column, text: Column) -> Column:
    """The string of an object whose only member is ``result``."""
    return F.when(F.size(F.json_object_keys(text)) == 1, _text_member(v, "result"))


def resolve_refs(payloads: DataFrame, files: DataFrame) -> DataFrame:
    """Replace references by the content they point to.

    ``data`` may be a path, ``{"file": path}``, ``{"result": text or path}`` or
    the payload itself; ``files`` is ``(path, content)``. A missing file gives
    an error object. Only rows with a reference are joined; the payloads
    themselves, the bulk of the bytes, do not move.
    """
    text = strip(F.col("data"))
    rows = payloads.select("*", text.alias("_text")).withColumn("_v", F.try_parse_json("_text"))
    direct = F.col("_text").startswith("/") & ~F.col("_text").startswith("//") & ~F.col("_text").contains("\n")
    in_file = _text_member(F.col("_v"), "file")
    inner = strip(_lone_result(F.col("_v"), F.col("_text")))
    ref = (
        F.when(direct, F.col("_text"))
        .when(in_file.startswith("/"), in_file)
        .when(inner.startswith("/") & ~inner.contains("\n"), inner)
    )
    rows = rows.withColumn("_ref", ref).withColumn("_inner", F.when(~F.coalesce(in_file.startswith("/"), F.lit(False)), inner))
    rows = rows.withColumn("_join", strip(F.col("_ref"))).drop("_v")
    stored = files.select(
        F.col("path").alias("_join"),
        F.coalesce(_lone_result(F.try_parse_json("content"), F.col("content")), F.col("content")).alias("_content"),
    )
    missing = F.concat(
        F.lit('{"_error": '), json_string(F.concat(F.lit("File not found: "), F.col("_ref"))), F.lit("}")
    )
    inline = rows.where(F.col("_ref").isNull()).select(*payloads.columns, F.coalesce("_inner", "_text").alias("raw"))
    linked = rows.where(F.col("_ref").isNotNull()).join(stored, "_join", "left")
    return inline.unionByName(linked.select(*payloads.columns, F.coalesce("_content", missing).alias("raw")))
