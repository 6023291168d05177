"""The cache and the append log as unbounded inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slim.functions.text import MAX_DEPTH, known_source
from slim.operators.leaves import leaves, parse, payload_leaves
from slim.operators.ledger import measure
from slim.operators.prune import drop_empty, drop_template_urls


def ttl_dedup_stream(events: DataFrame, key: str, ts: str, id_col: str, ttl_seconds: int, watermark: str) -> DataFrame:
    """Keep an event per key and suppress later ones until ttl after the kept
    one; ``(key, kept_at, first_id)`` as they are kept.

    The state of a key is one instant. It leaves the store when the watermark
    passes its expiry: no event can refer to it any more. An event older than
    the kept instant is late and suppressed.
    """
    ttl = int(ttl_seconds * 1_000_000)
    key_type, id_type = events.schema[key].dataType, events.schema[id_col].dataType

    def step(names: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(c["at"].to_numpy(), c["id"].to_numpy()) for c in chunks]
        at = np.concatenate([p[0] for p in parts])
        ids = np.concatenate([p[1] for p in parts])
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        due = state.get[0] + ttl if state.exists else np.iinfo(np.int64).min
        kept = []
        i = int(np.searchsorted(at, due, side="left"))
        while i < len(at):
            kept.append(i)
            i = int(np.searchsorted(at, at[i] + ttl, side="left"))
        if kept:
            state.update((int(at[kept[-1]]),))
        if state.exists:
            expiry = (state.get[0] + ttl) // 1000 + 1
            state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({"k": [names[0]] * len(kept), "at": at[kept], "first_id": ids[kept]})

    slim = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    slim = slim.select(F.col(key).alias("k"), "_ts", F.unix_micros("_ts").alias("at"), F.col(id_col).alias("id"))
    out = T.StructType([T.StructField("k", key_type), T.StructField("at", T.LongType()), T.StructField("first_id", id_type)])
    kept = slim.groupBy("k").applyInPandasWithState(
        step, out, T.StructType([T.StructField("kept", T.LongType())]), "append", GroupStateTimeout.EventTimeTimeout
    )
    return kept.select(F.col("k").alias(key), F.timestamp_micros("at").alias("kept_at"), "first_id")


def savings_report_stream(ledger: DataFrame, window: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Running totals by source (for update or complete mode). With a window
    length, totals per window and source; rows later than the watermark are
    dropped and closed windows can be appended."""
    rows = ledger.select("ts", known_source(F.col("source")).alias("source"), "raw_chars", "opt_chars")
    keys = ["source"]
    if window is not None:
        rows = rows.withWatermark("ts", watermark)
        keys = [F.window("ts", window).alias("window"), "source"]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("raw_chars").alias("raw_chars"), F.sum("opt_chars").alias("opt_chars")
    )
    return measure(sums)


def leaves_stream(payloads: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Surviving leaves of a stream of payloads of any nesting; stateless, one
    plan for all batches."""
    rows = leaves(parse(payloads)).where("kind != 'none'")
    return drop_empty(drop_template_urls(rows, max_depth), max_depth)


def write_leaves(payloads: DataFrame, path: str, checkpoint: str, max_depth: int = MAX_DEPTH) -> DataStreamWriter:
    """Surviving leaves of a payload stream of any nesting, to Parquet under
    ``path``: start the writer returned, and read them with ``read_leaves``.

    Unlike the file sink, which keeps a log of its own, a batch that runs again
    replaces its own folder, so a path belongs to one checkpoint."""
    spark = payloads.sparkSession
    none = spark.createDataFrame([], _leaf_schema(spark, payloads.schema["payload_id"].dataType))
    none.write.mode("overwrite").parquet(f"{path}/batch=-1")  # a stream without batches reads as empty

    def shred(batch: DataFrame, number: int) -> None:
        rows = drop_empty(drop_template_urls(payload_leaves(batch), max_depth), max_depth)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return payloads.writeStream.foreachBatch(shred).option("checkpointLocation", checkpoint)


def read_leaves(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """What ``write_leaves`` has written below ``path``."""
    return spark.read.schema(_leaf_schema(spark, id_type).add("batch", T.LongType())).parquet(path).drop("batch")


def _leaf_schema(spark: SparkSession, id_type: T.DataType) -> T.StructType:
    ids = T.StructType([T.StructField("payload_id", id_type), T.StructField("raw", T.StringType())])
    return payload_leaves(spark.createDataFrame([], ids)).schema
