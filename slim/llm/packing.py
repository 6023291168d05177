"""Mixture-controlled packing: deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slim.llm.common import bound_batches, stored
from slim.llm.tokens import encoder

BROADCAST_ROWS = 200_000  # rows of (task, source, total) that are sent to all; more are joined by a shuffle
CYCLE = 1024  # windows after which all deficits are settled


@dataclass
class Phase:
    """Windows during which the same sources have tokens left. A regular phase
    deals ``dealt`` tokens per source in every cycle; a closing one is a single
    window that takes exactly ``dealt``."""

    first: int
    windows: int
    used: list[int]  # tokens of each source before this phase
    dealt: list[int]
    regular: bool

    def table(self, window: int) -> np.ndarray:
        return deal(self.dealt, window) if self.regular else np.array([[0] * len(self.dealt), self.dealt], dtype=np.int64)

    @property
    def cycle(self) -> int:
        return CYCLE if self.regular else 1


def deal(dealt: list[int], window: int) -> np.ndarray:
    """Deficit round-robin through one cycle: row i holds what each source has
    given after i windows. Every window each source earns its quantum, gives its
    whole tokens, and the few places left go to the largest deficits; what a
    source is owed or owes is carried to the next window. After a cycle each
    source has given exactly ``dealt`` tokens."""
    quantum = np.array(dealt, dtype=np.int64)
    credit = np.zeros_like(quantum)
    given = np.zeros((CYCLE + 1, len(dealt)), dtype=np.int64)
    for i in range(1, CYCLE):
        credit += quantum
        take = np.maximum(credit, 0) // CYCLE
        short = window - int(take.sum())
        by_rest = np.argsort(-(credit - take * CYCLE), kind="stable")
        if short > 0:
            take[by_rest[:short]] += 1
        elif short < 0:
            take[[s for s in by_rest[::-1] if take[s] > 0][: -short]] -= 1
        credit -= take * CYCLE
        given[i] = given[i - 1] + take
    given[CYCLE] = quantum
    return given


def apportion(weights: np.ndarray, total: int) -> list[int]:
    """Whole shares of ``total`` in proportion to ``weights``, by largest remainder."""
    exact = weights / weights.sum() * total
    whole = np.floor(exact).astype(np.int64)
    rest = np.argsort(whole - exact, kind="stable")[: total - int(whole.sum())]
    whole[rest] += 1
    return whole.tolist()


def plan_phases(totals: list[int], weights: list[float], window: int) -> list[Phase]:
    """Phases until every queue is empty. When a source runs dry, the others
    share its place in proportion; at most two phases per source."""
    left, used = np.array(totals, dtype=np.int64), np.zeros(len(totals), dtype=np.int64)
    phases, first = [], 0
    while left.any():
        wanted = np.where(left > 0, weights, 0.0)
        if not wanted.any():
            wanted = left.astype(float)
        dealt = np.array(apportion(wanted, CYCLE * window))
        given = deal(dealt.tolist(), window)
        fits = []
        for s in np.flatnonzero(dealt):
            cycles, rest = divmod(int(left[s]), int(dealt[s]))
            fits.append(cycles * CYCLE + int(np.searchsorted(given[:, s], rest, side="right")) - 1)
        n = min(fits)
        if n > 0:
            take = n // CYCLE * dealt + given[n % CYCLE]
            phases.append(Phase(first, n, used.tolist(), dealt.tolist(), True))
        else:
            n, take = 1, np.minimum(given[1], left)
            for s in np.argsort(take - left, kind="stable"):  # the longest queues fill what is free
                take[s] += min(window - int(take.sum()), int(left[s] - take[s]))
            phases.append(Phase(first, 1, used.tolist(), take.tolist(), False))
        left, used, first = left - take, used + take, first + n
    return phases


def token_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, end_id: int, path: str | None) -> DataFrame:
    """One row per document with its ids (unsigned 16-bit), and how many tokens
    of the same source its task had before it."""

    def encode(batches):
        to_ids, part, before = encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            ids = [np.array([*to_ids(t), end_id], dtype="<u2") for t in batch.column("_text").to_pylist()]
            starts = []
            for source, x in zip(batch.column("_source").to_pylist(), ids):
                starts.append(before[source])
                before[source] += len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), batch.column("_source"), pa.array([part] * len(ids), pa.int32()),
                    pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                ],
                names=["_id", "_source", "_part", "_start", "_n", "_ids"],
            )

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    kind = narrow.schema
    return narrow.mapInArrow(
        encode,
        f"_id {kind['_id'].dataType.simpleString()}, _source {kind['_source'].dataType.simpleString()}, "
        "_part int, _start bigint, _n bigint, _ids binary",
    )


def pack(
    docs: DataFrame, window: int = 2048, targets: dict | None = None, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", path: str | None = None,
) -> DataFrame:
    """Pack every token of ``docs`` into windows of ``window`` tokens, each of
    which holds the sources in target proportions, to within a token of the
    deficits carried along.

    A document is its ids and ``end_id``; a null or empty text is that one id.
    Each source is a queue of its documents; a null source is a queue of its
    own. ``targets`` gives weights by source (others 0: they follow when the
    named ones are dry); by default they are the sources' shares of all tokens,
    so the queues end together. All windows but the last one are full. Because
    deficits are settled in fixed cycles, the state before any window follows
    from its number, and each task cuts its own documents: no text and no ids
    are shuffled, only the token totals per task and source. The driver holds
    one total per source. Repeated rows are packed as often as they occur;
    empty input gives no rows; other columns are not read.

    Returns per piece: id, source, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and tokens (the ids, little-endian 32-bit)."""
    bound_batches(docs.sparkSession)
    encoded = stored(token_rows(docs, id_col, text_col, source_col, end_id, path), "tokens")
    ends = encoded.groupBy("_part", "_source").agg(F.max(F.col("_start") + F.col("_n")).alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select(
        F.col("_part").alias("_p"), F.col("_source").alias("_s"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    summed = ends.groupBy("_source").agg(F.sum("_sum").alias("_t"), F.count(F.lit(1)).alias("_n")).collect()
    totals = {r["_source"]: r["_t"] for r in summed}
    if sum(r["_n"] for r in summed) <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    sources = sorted(totals, key=lambda s: (s is None, s or ""))
    amounts = [totals[s] for s in sources]
    weights = [float(targets.get(s, 0.0)) for s in sources] if targets else [float(x) for x in amounts]
    phases = plan_phases(amounts, weights, window)
    placed = encoded.join(
        bases, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s"))
    ).select("_id", "_source", (F.col("_start") + F.col("_base")).alias("_start"), "_n", "_ids")
    index = {s: i for i, s in enumerate(sources)}
    kind = encoded.schema

    def cut(batches):
        tables = {}

        def lookup(p):
            if p not in tables:
                given = phases[p].table(window)
                takes = np.diff(given, axis=0)
                tables[p] = given, np.cumsum(takes, axis=1) - takes
            return tables[p]

        begins = np.array([ph.used for ph in phases], dtype=np.int64)
        for batch in batches:
            out = [[] for _ in range(9)]
            for doc, source, at, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                s, ids, done = index[source], np.frombuffer(raw, "<u2").astype("<u4"), 0
                p = int(np.searchsorted(begins[:, s], at, side="right")) - 1
                while done < n:
                    phase = phases[p]
                    until = amounts[s] if p + 1 == len(phases) else int(begins[p + 1, s])
                    m = min(n - done, until - (at + done))
                    if m <= 0:
                        p += 1
                        continue
                    given, behind = lookup(p)
                    x, per = at + done - phase.used[s], phase.dealt[s]
                    ends_at = []
                    for y in (x, x + m - 1):
                        cycles, rest = divmod(y, per)
                        ends_at.append(cycles * phase.cycle + int(np.searchsorted(given[:, s], rest, side="right")) - 1)
                    i = np.arange(ends_at[0], ends_at[1] + 2)
                    edges = i // phase.cycle * per + given[i % phase.cycle, s]
                    cuts = np.clip(edges, x, x + m)
                    sizes = np.diff(cuts)
                    j = i[:-1] % phase.cycle
                    offsets = behind[j, s] + cuts[:-1] - edges[:-1]
                    for window_no, start, size, offset in zip((phase.first + i[:-1]).tolist(), (cuts[:-1] - x + done).tolist(), sizes.tolist(), offsets.tolist()):
                        if size:
                            piece = ids[start : start + size].tobytes()
                            for column, v in zip(out, (doc, source, start, size, zlib.crc32(piece), n, window_no, offset, piece)):
                                column.append(v)
                    done += m
            types = [batch.schema.field("_id").type, batch.schema.field("_source").type, *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=NAMES)

    return placed.mapInArrow(
        cut,
        f"_id {kind['_id'].dataType.simpleString()}, _source {kind['_source'].dataType.simpleString()}, start bigint, length bigint, "
        "ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tokens binary",
    ).withColumnsRenamed({"_id": id_col, "_source": source_col})


NAMES = ["_id", "_source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tokens"]
