"""Temperature mixing of sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slim.llm.common import row_hash, running_totals, stored, words


def entropy(weights: list[float]) -> float:
    """Entropy in bits."""
    return -sum(w * math.log2(w) for w in weights if w > 0)


def tempered(totals: list[int], exponent: float) -> list[float]:
    """Shares of all tokens raised to ``exponent`` and normalised."""
    most = max(totals)
    raised = [(n / most) ** exponent if n else 0.0 for n in totals]
    return [x / sum(raised) for x in raised]


def find_exponent(totals: list[int], max_repeats: float | None, target_entropy: float | None) -> float:
    """The flattest exponent in [0, 1] that keeps the limits, by bisection.

    ``max_repeats``: how often the most repeated source may be read when the
    least repeated one is read once. ``target_entropy``: bits; entropy falls as
    the exponent grows, and the exponent found meets it from below. With both,
    the larger exponent holds both; 1 (shares as they are) always keeps repeats."""
    present = [n for n in totals if n]

    def ok(p: float) -> bool:
        w = tempered(present, p)
        reads = [x / n for x, n in zip(w, present)]
        return (max_repeats is None or max(reads) / min(reads) <= max_repeats * (1 + 1e-12)) and (
            target_entropy is None or entropy(w) <= target_entropy + 1e-12
        )

    if not present or ok(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if ok(middle) else (middle, high)
    return high


def mixture_plan(totals: dict, max_repeats: float | None, target_entropy: float | None, budget: int | None) -> tuple[float, dict]:
    """The exponent, and per source its weight and its token target. Without a
    budget the target total is the least with which every source is read in
    full at least once."""
    named = sorted(totals, key=lambda s: (s is None, s or ""))
    amounts = [totals[s] for s in named]
    if not any(amounts):
        return 0.0, {s: (0.0, 0) for s in named}
    exponent = find_exponent(amounts, max_repeats, target_entropy)
    weights = tempered(amounts, exponent)
    total = budget if budget is not None else max(n / w for n, w in zip(amounts, weights) if n)
    return exponent, {s: (w, round(w * total)) for s, w in zip(named, weights)}


def mix_sources(
    docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None,
    block_tokens: int = 1 << 22, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Choose how often each document is read so that sources meet tempered
    weights, and deal the readings into blocks that all hold the same mixture.

    Tokens are words. A source with target t and n tokens is read floor(t / n)
    times in full; the rest comes from one more pass in its own pseudo-random
    order, as long as documents end within the rest, so a source misses its
    target by less than its next document. Pass e permutes by a hash of (seed,
    e, id, row); a reading's block is its place in the source's stream as a
    part of the target, times the number of blocks; inside a block readings are
    ordered by hash, so blocks are permutations with budgets.

    Prefix sums are global over range partitions, so a source with a third of
    all rows is no hot spot. The driver holds one token total per source.
    Rows equal in all of id, source and text move together (``copies`` of
    them). Documents without words follow every full pass. A null source is a
    source. Empty input gives no rows; other columns are not read.

    Returns id, source, row_hash, copies, n_tokens, epoch, block, slot (gapless
    in a block), weight and exponent."""
    text, source = F.col(text_col), F.col(source_col)
    rows = (
        docs.select(
            F.col(id_col).alias("_id"), source.alias("_source"), row_hash(source_col, text_col).alias("_hash"),
            F.size(words(text)).cast("bigint").alias("_tokens"),
        )
        .groupBy("_id", "_source", "_hash")
        .agg(F.count(F.lit(1)).alias("_copies"), F.sum("_tokens").alias("_n"))
    )
    rows = stored(rows, "rows")
    totals = {r["_source"]: r["_t"] for r in rows.groupBy("_source").agg(F.sum("_n").alias("_t")).collect()}
    exponent, plan = mixture_plan(totals, max_repeats, target_entropy, budget)
    spark = docs.sparkSession
    limits = spark.createDataFrame(
        [(s, w, t // totals[s] if totals[s] else 1, t % totals[s] if totals[s] else 0, t) for s, (w, t) in plan.items()],
        f"_s {rows.schema['_source'].dataType.simpleString()}, _weight double, _full bigint, _rest bigint, _target bigint",
    )
    readings = rows.join(limits, rows["_source"].eqNullSafe(limits["_s"])).withColumn(
        "_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full")))
    )
    ordered = readings.withColumn("_key", F.xxhash64(F.lit(seed), "_epoch", "_id", "_hash")).drop("_s")
    placed = running_totals(ordered, ["_source", "_epoch"], ["_key", "_id", "_hash"], "_n").where(
        (F.col("_epoch") < F.col("_full")) | ((F.col("_start") + F.col("_n") <= F.col("_rest")) & (F.col("_n") > 0))
    )
    blocks = max(1, math.ceil(sum(t for _, t in plan.values()) / block_tokens))
    stream = F.col("_epoch") * F.col("_total") + F.col("_start")
    dealt = placed.withColumn(
        "_block", F.when(F.col("_target") > 0, F.least(F.lit(blocks - 1), F.floor(stream / F.col("_target") * blocks))).otherwise(0).cast("bigint")
    )
    in_block = Window.partitionBy("_block").orderBy("_key", "_id", "_hash", "_epoch")
    return dealt.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_hash").alias("row_hash"), F.col("_copies").alias("copies"),
        F.col("_n").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"),
        (F.row_number().over(in_block) - 1).cast("bigint").alias("slot"), F.col("_weight").alias("weight"), F.lit(exponent).alias("exponent"),
    )

