"""What several operators share: tables in the shared folder, prefix sums, bytes and words of a batch."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What parts words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is
    set, a local session gets a temporary one; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="slim-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession, size: int = 1 << 23) -> None:
    """Hand texts to Python in batches of so many bytes, whatever their lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there,
    and every later pass sees the same rows in the same files."""
    path = f"{shared_base(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_totals(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Global prefix sums: adds ``_start`` (sum of ``value`` over the rows before
    this one within ``keys``), ``_row`` (how many rows those are), ``_total`` and
    ``_rows`` (of the whole key).

    Rows are range-partitioned on (keys, order), so a hot key spreads over many
    partitions; only one total per partition and key is summed globally.
    ``order`` must tell apart all rows that are not interchangeable."""
    parts = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = parts.groupBy("_part", *keys).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    bases = totals.select(
        F.col("_part").alias("_p"),
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base_row"),
        F.sum("_s").over(whole).alias("_total"),
        F.sum("_n").over(whole).alias("_rows"),
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = parts.withColumns({"_upto": F.sum(value).over(inside), "_at": F.row_number().over(inside)})
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    return ranked.join(bases, same).select(
        *df.columns,
        (F.col("_base") + F.col("_upto") - F.col(value)).cast("bigint").alias("_start"),
        (F.col("_base_row") + F.col("_at") - 1).cast("bigint").alias("_row"),
        F.col("_total").cast("bigint").alias("_total"),
        F.col("_rows").cast("bigint").alias("_rows"),
    )


def words(text: Column) -> Column:
    """The words of a text; of null or a text without words an empty array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )


def row_hash(*cols: str) -> Column:
    """Tells apart rows with the same id by other columns, null apart from empty.
    Rows that agree in it are interchangeable to the operators that use it."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c), F.isnull(c))])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system: tasks that hold large arrays for a
    moment leave the rest of the executor its share."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def joined_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column end to end (null: none), and the
    n + 1 offsets between its rows."""
    import pyarrow as pa

    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]
