"""The size ledger on disk: JSON lines, appended to and scanned with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slim.session import shared_folder

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("raw_chars", T.LongType()),
        T.StructField("opt_chars", T.LongType()),
        T.StructField("saved_chars", T.LongType()),
        T.StructField("saved_pct", T.DoubleType()),
    ]
)


def _is_record():
    return F.col("raw_chars").isNotNull() & F.col("opt_chars").isNotNull()


def append_ledger(measured: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Append size records; every task adds its own files.

    Records without ``seq`` are numbered on from the last append, in the order
    of ``order`` or as they come; ``ts`` is the time of the append where there is
    none. Numbers are reserved before the records are written, so a failed append
    leaves a gap and gives no number twice. One append runs at a time."""
    rows = measured if "ts" in measured.columns else measured.withColumn("ts", F.current_timestamp())
    if "seq" not in measured.columns:
        rows = _numbered(rows, path, order)
    names = [f.name for f in LEDGER_SCHEMA if f.name in rows.columns]
    rows.select(*names).write.mode("append").json(path)


def _numbered(rows: DataFrame, path: str, order: list[str] | None) -> DataFrame:
    """Adds ``seq``: what was given out before, the records in earlier
    partitions, and the place in the own one. The batch is written first, so
    that counting and numbering see the same rows in the same order; one count
    per partition is all that is put together. Where it is to be ordered it is
    written before that too: finding ranges reads it once more than moving it."""
    spark, staged = rows.sparkSession, shared_folder(rows.sparkSession, "append")
    if order:
        made = shared_folder(spark, "made")
        rows.write.parquet(made)
        rows = spark.read.schema(rows.schema).parquet(made).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(staged)
    batch = spark.read.parquet(staged)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = batch.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    start, total = _given_out(spark, path), counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    spark.createDataFrame([(start, total)], NUMBERS).write.mode("append").json(f"{path}/{RESERVED}")
    # monotonically_increasing_id counts rows in its lower 33 bits; bases is one row per partition of the batch.
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return batch.join(F.broadcast(bases), "_part").withColumn("seq", F.lit(start + 1) + F.col("_base") + place)


def _given_out(spark: SparkSession, path: str) -> int:
    """The highest number reserved so far."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{RESERVED}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0
    return spark.read.schema(NUMBERS).json(f"{path}/{RESERVED}").agg(F.max(F.col("first") + F.col("n"))).first()[0] or 0


# Beside the records, under a name that scans pass over: one line per append.
RESERVED, NUMBERS = "_numbers", "first long, n long"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Scan the ledger: its records. Lines that are none are in :func:`broken_lines`."""
    return _scan(spark, path).where(F.col("_broken").isNull() & _is_record()).drop("_broken")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line)``: what is not blank and no size record, so that nothing gets lost unseen."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER_SCHEMA)
    record = F.from_json("value", f"{kinds}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    parsed = lines.select("value", record.alias("r")).select("value", "r.*")
    return parsed.where(F.col("_broken").isNotNull() | ~_is_record()).select(F.col("value").alias("line"))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*LEDGER_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(path)
