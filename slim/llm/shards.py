"""Byte-balanced contiguous shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slim.llm.common import running_totals


def byte_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in ascending id order, into ``n_shards`` runs of near
    equal size. Only (id, size, checksum) moves, never a text.

    Sizes are UTF-8 bytes plus 1, so null and empty texts have size 1. Prefix
    sums come from per-partition totals; a document belongs to the shard in
    whose equal part of all bytes its middle lies, so a shard misses its target
    by one document at most on either side. Null ids come first; rows with the
    same id are ordered by checksum and size, and rows equal in all three are
    interchangeable. Empty input gives no rows. Other columns are not read.

    Returns id, size, text_crc32, shard, slot (gapless from 0 in a shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
    )
    placed = running_totals(sized, [], ["_id", "_crc", "_size"], "_size").withColumn(
        "_shard",
        F.expr(f"cast(least({n_shards - 1}, (2 * _start + _size) * {n_shards} div (2 * _total)) as int)"),
    )
    firsts = placed.groupBy("_shard").agg(F.min("_row").alias("_first"))
    return placed.join(firsts, "_shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        (F.col("_row") - F.col("_first")).alias("slot"),
    )
