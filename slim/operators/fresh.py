"""Freshness: which stored answer serves a request, and which requests of a
log have to be answered anew.

Keys may be hot. Time is therefore cut into slices, the work is spread by
(key, slice), and only one small summary row per slice is looked at per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slim.functions.text import source_label
from slim.operators.ledger import measure

SLICE_SECONDS = 3600
SLICE_TTLS = 16
NEVER = -(2**63)


def _micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def asof_latest(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_cols: list[str],
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Every left row with the latest right row at or before it (same key),
    as a struct ``found`` (NULL if there is none).

    Both sides are merged per (key, time slice). What a slice inherits from
    earlier ones is one row: the last right row of each slice, carried on by a
    window over those rows only. Several right rows at one instant: the
    greatest in column order counts.
    """
    width = slice_seconds * 1_000_000
    payload = F.struct(F.col("_at").alias("at"), *[F.col(c) for c in right_cols])
    r = (
        right.withColumn("_at", _micros(F.col(right_ts)))
        .select(F.col(key).alias("_k"), "_at", F.lit(1).alias("_kind"), payload.alias("_r"))
        .withColumn("_s", F.floor(F.col("_at") / width))
    )
    lcols = left.columns
    lrows = left.select(
        F.col(key).alias("_k"), _micros(F.col(left_ts)).alias("_at"), F.lit(2).alias("_kind"), F.struct(*lcols).alias("_l")
    ).withColumn("_s", F.floor(F.col("_at") / width))

    heads = r.groupBy("_k", "_s").agg(F.max("_r").alias("_r"), F.lit(False).alias("_need"))
    needs = lrows.groupBy("_k", "_s").agg(F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(True).alias("_need"))
    per_slice = heads.unionByName(needs).groupBy("_k", "_s").agg(F.max("_r").alias("_r"), F.max("_need").alias("_need"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_slice.withColumn("_r", F.last("_r", ignorenulls=True).over(before))
        .where(F.col("_need") & F.col("_r").isNotNull())
        .select("_k", (F.col("_s") * width).alias("_at"), F.lit(0).alias("_kind"), "_r", "_s")
    )
    merged = carried.unionByName(r).unionByName(lrows, allowMissingColumns=True)
    upto = Window.partitionBy("_k", "_s").orderBy("_at", "_kind", "_r").rowsBetween(Window.unboundedPreceding, 0)
    return (
        merged.withColumn("found", F.last("_r", ignorenulls=True).over(upto))
        .where("_kind = 2")
        .select("_l.*", "found")
    )


def fresh_lookup(requests: DataFrame, responses: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Requests ``(key, ts, ...)`` with the stored answer that serves them:
    the latest one stored at or before the request, if it has not expired.
    ``responses`` is ``(key, stored_at, ttl, content, raw_chars)``, ttl in
    seconds; expiry is exact to the instant (an answer of age ttl is stale)."""
    met = asof_latest(
        requests, responses, "key", "ts", "stored_at", ["ttl", "raw_chars", "content"], slice_seconds
    )
    alive = F.col("found").isNotNull() & (_micros(F.col("ts")) < F.col("found.at") + F.col("found.ttl") * 1_000_000)
    alive = F.coalesce(alive, F.lit(False))
    return met.select(
        *requests.columns,
        alive.alias("hit"),
        F.when(alive, F.timestamp_micros("found.at")).alias("stored_at"),
        F.when(alive, F.col("found.content")).alias("content"),
        F.when(alive, F.col("found.raw_chars")).alias("raw_chars"),
    )


def hit_records(found: DataFrame) -> DataFrame:
    """Size records of the requests that a stored answer served: what
    :func:`fresh_lookup` returns for requests with a ``url``, as ``(source,
    raw_chars, opt_chars, saved_...)`` with the sources ``cache_hit:address``."""
    served = found.where("hit").select(
        source_label("cache_hit", F.col("url")).alias("source"), F.col("raw_chars").cast("bigint").alias("raw_chars"),
        F.char_length("content").cast("bigint").alias("opt_chars"),
    )
    return measure(served)


def _group_starts(*columns: np.ndarray) -> np.ndarray:
    """Positions where a new group begins in rows sorted by these columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for col in columns:
        new[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(new)


def _transfer(batches: Iterator[pd.DataFrame], ttl: int, width: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (k, s, at) to summary rows: a deadline at or before
    ``upto`` (and after the previous ``upto``) leaves its slice as ``leave``."""

    def whole_groups() -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            starts = _group_starts(pdf["k"].to_numpy(), pdf["s"].to_numpy())
            cut = int(starts[-1]) if len(starts) else 0
            if cut:
                yield pdf.iloc[:cut]
            rest = pdf.iloc[cut:]
        if rest is not None and len(rest):
            yield rest

    for pdf in whole_groups():
        k, s, at = pdf["k"].to_numpy(), pdf["s"].to_numpy(), pdf["at"].to_numpy()
        n, starts = len(at), _group_starts(k, s)
        group = np.zeros(n, dtype=np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        end = np.append(starts[1:], n)[group]
        # Offsets of different groups are kept apart, so one search serves all.
        line = group * (width + 2 * ttl) + (at - s * width)
        nxt = np.minimum(np.searchsorted(line, line + ttl, side="left"), end)
        jump, leave = np.where(nxt < end, nxt, np.arange(n)), at + ttl
        while True:  # follow the chain to its last member, doubling the jumps
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        leave = leave[jump]
        # Deadlines lie in the first ttl of a slice: later starts cannot be hit,
        # except the first one behind it.
        first_out = np.minimum(np.searchsorted(line, group * (width + 2 * ttl) + ttl, side="left"), end - 1)
        reach = np.arange(n) <= first_out
        last_of_run = np.append((leave[1:] != leave[:-1]) | (group[1:] != group[:-1]) | ~reach[1:], True) & reach
        yield pd.DataFrame({"k": k[last_of_run], "s": s[last_of_run], "upto": at[last_of_run], "leave": leave[last_of_run]})


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summary rows sorted by (k, s, upto) to the deadline each slice is
    entered with. The state is one deadline."""
    key, cell, due, open_slice = None, None, None, False
    for pdf in batches:
        out = []
        for k, s, upto, leave in zip(pdf["k"].tolist(), pdf["s"].tolist(), pdf["upto"].tolist(), pdf["leave"].tolist()):
            if k != key or due is None:
                key, cell, due = k, None, NEVER
            if s != cell:
                cell, open_slice = s, True
                out.append((k, s, due))
            if open_slice and due <= upto:
                due, open_slice = leave, False
        yield pd.DataFrame(out, columns=["k", "s", "due"])


def _follow(batches: Iterator[pd.DataFrame], ttl: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (k, s, at) with the deadline of their slice to the kept
    rows. The state is one deadline."""
    key, cell, due = None, None, None
    for pdf in batches:
        keep = []
        for i, (k, s, at, entry) in enumerate(zip(pdf["k"].tolist(), pdf["s"].tolist(), pdf["at"].tolist(), pdf["due"].tolist())):
            if s != cell or k != key or due is None:
                key, cell, due = k, s, entry
            if at >= due:
                keep.append(i)
                due = at + ttl
        yield pdf.iloc[keep][["k", "at", "first_id"]]


def ttl_dedup(
    events: DataFrame, key: str, ts: str, ttl_seconds: int, id_col: str | None = None, slice_ttls: int = SLICE_TTLS
) -> DataFrame:
    """``(key, kept_at[, first_id])``: per key keep an event, ignore later
    ones until ttl after the *kept* one, and so on. Exact.

    1. Equal instants of a key collapse (before the shuffle).
    2. Per (key, slice of ``slice_ttls`` ttls): for every possible incoming
       deadline, where the chain leaves the slice. Chains run together within
       a few ttls, so this is a handful of rows per slice.
    3. Per key: walk over its slice summaries to get each incoming deadline.
    4. Per (key, slice): follow the chain from there and emit what is kept.

    Each step streams over sorted partitions; a key with a large share of the
    log is spread over its slices.
    """
    ttl = int(ttl_seconds * 1_000_000)
    width = ttl * slice_ttls
    key_type = events.schema[key].dataType
    id_type = events.schema[id_col].dataType if id_col else T.LongType()
    first_id = F.min(id_col) if id_col else F.lit(None)
    instants = (
        events.select(F.col(key).alias("k"), _micros(F.col(ts)).alias("at"), *([id_col] if id_col else []))
        .groupBy("k", "at")
        .agg(first_id.cast(id_type).alias("first_id"))
        .withColumn("s", F.floor(F.col("at") / width))
        .repartition("k", "s")
    )

    def typed(**kinds: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in kinds.items()])

    long = T.LongType()
    sums = (
        instants.select("k", "s", "at")
        .sortWithinPartitions("k", "s", "at")
        .mapInPandas(lambda b: _transfer(b, ttl, width), typed(k=key_type, s=long, upto=long, leave=long))
    )
    dues = (
        sums.repartition("k")
        .sortWithinPartitions("k", "s", "upto")
        .mapInPandas(_walk, typed(k=key_type, s=long, due=long))
    )
    kept = (
        instants.join(dues.withColumnsRenamed({"k": "_k", "s": "_s"}), F.col("k").eqNullSafe(F.col("_k")) & (F.col("s") == F.col("_s")))
        .select("k", "s", "at", "first_id", "due")
        .sortWithinPartitions("k", "s", "at")
        .mapInPandas(lambda b: _follow(b, ttl), typed(k=key_type, at=long, first_id=id_type))
    )
    out = kept.select(F.col("k").alias(key), F.timestamp_micros("at").alias("kept_at"), "first_id")
    return out if id_col else out.drop("first_id")


def label_hits(events: DataFrame, key: str, ts: str, ttl_seconds: int, id_col: str) -> DataFrame:
    """Events with ``kept_at`` (the stored answer that serves them) and
    ``hit``: false for the event that had to be answered anew."""
    kept = ttl_dedup(events, key, ts, ttl_seconds, id_col)
    met = asof_latest(events, kept, key, ts, "kept_at", ["first_id"])
    return met.select(
        *events.columns,
        F.timestamp_micros("found.at").alias("kept_at"),
        (F.col(id_col) != F.col("found.first_id")).alias("hit"),
    )
