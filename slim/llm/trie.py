"""Prefix tries of conversations from composable fingerprints; rebuilt texts are never written."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slim.llm.common import bound_batches, stored

PRIME = (1 << 31) - 1
LANES = range(4)
STEP = 1 << 12
HEAVY = 1000  # a key with more than this part of all rows is heavy; so there are no more than this many
KEY = ["depth", "_k1", "_k2"]


def bases(seed: int) -> list[int]:
    """One multiplier per lane."""
    return [int(x) for x in np.random.default_rng(seed).integers(1 << 20, PRIME - 1, len(LANES))]


class Powers:
    """Powers of the multipliers modulo the prime, for any exponents."""

    def __init__(self, multipliers: list[int]):
        self.low = [self._row(b, STEP) for b in multipliers]
        self.multipliers, self.high = multipliers, [self._row(pow(b, STEP, PRIME), 2) for b in multipliers]

    @staticmethod
    def _row(base, n):
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
        return out

    def of(self, lane: int, n: np.ndarray) -> np.ndarray:
        most = int(n.max(initial=0)) // STEP + 1
        if len(self.high[lane]) < most:
            self.high[lane] = self._row(pow(self.multipliers[lane], STEP, PRIME), most)
        return self.high[lane][n // STEP] * self.low[lane][n % STEP] % np.uint64(PRIME)


def power(n: Column, base: int) -> Column:
    """``base ** n`` modulo the prime."""
    squares = F.array(*[F.lit(pow(base, 1 << k, PRIME)).cast("bigint") for k in range(40)])
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(39)),
        F.lit(1).cast("bigint"),
        lambda a, k: F.when(F.call_function("shiftright", n, k).bitwiseAND(F.lit(1)) == 1, a * F.element_at(squares, k + 1) % PRIME).otherwise(a),
    )


def folded(turns: DataFrame, seed: int) -> DataFrame:
    """Running products of every conversation's turns, each partition for itself.

    A turn is the map x -> x + t * b**i at its place i; maps compose by adding, a
    later stretch by shifting its places. Per turn (``_kind`` 0): place ``_i``,
    own part ``_x*`` and running product ``_s*`` in each lane, characters ``_p``
    up to it. Per partition one row names its first conversation (1) and one
    holds the totals of its last one (2)."""

    def run(batches):
        from pyspark import TaskContext

        task, powers = TaskContext.get().partitionId(), Powers(bases(seed))
        last = None  # conversation, turns, products, characters so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            digest = np.stack([batch.column(f"_d{k}").to_numpy() for k in LANES])
            chars = batch.column("n_chars").to_numpy()
            heads = np.r_[True, conv[1:] != conv[:-1]]
            starts = np.flatnonzero(heads)
            run_of = np.cumsum(heads) - 1
            goes_on = last is not None and last[0] == conv[0]
            more = lambda x: np.where(run_of == 0, x if goes_on else 0, 0)  # noqa: E731, B023
            i = np.arange(n) - starts[run_of] + 1 + more(last[1] if goes_on else 0)
            upto = np.cumsum(chars)
            p = upto - (upto - chars)[starts][run_of] + more(last[3] if goes_on else 0)
            own, products = [], []
            for k in LANES:
                x = (digest[k].view(np.uint64) % np.uint64(PRIME)) * powers.of(k, i) % np.uint64(PRIME)
                total = np.cumsum(x)
                s = (total - (total - x)[starts][run_of]) % np.uint64(PRIME)
                own.append(x.astype(np.int64))
                products.append((s.astype(np.int64) + more(last[2][k] if goes_on else 0)) % PRIME)
            if last is None:
                yield edge(1, task, int(conv[0]), 0, [0] * len(LANES), 0)
            last = int(conv[-1]), int(i[-1]), [int(s[-1]) for s in products], int(p[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, task, np.int32)), batch.column("conv_id"), pa.array(i), pa.array(p), batch.column("n_chars"),
                 *[pa.array(s.astype(np.int32)) for s in products], *[pa.array(x.astype(np.int32)) for x in own], *[batch.column(f"_d{k}") for k in LANES]],
                names=FOLDED,
            )
        if last is not None:
            yield edge(2, task, last[0], last[1], last[2], last[3])

    bound_batches(turns.sparkSession)
    sorted_ = turns.repartitionByRange("conv_id", "turn", "_d0").sortWithinPartitions("conv_id", "turn", *[f"_d{k}" for k in LANES])
    kinds = ["int", "int", *["bigint"] * 4, *["int"] * 8, *["bigint"] * 4]
    return stored(sorted_.drop("turn").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(FOLDED, kinds))), "folded")


FOLDED = ["_kind", "_part", "conv_id", "_i", "_p", "n_chars", *[f"_s{k}" for k in LANES], *[f"_x{k}" for k in LANES], *[f"_d{k}" for k in LANES]]


def edge(kind, task, conv, n, products, chars):
    """A row on a partition's first or last conversation."""
    ints = lambda *xs: [pa.array([x], pa.int32()) for x in xs]
    longs = lambda *xs: [pa.array([x], pa.int64()) for x in xs]
    zeros = [0] * len(LANES)
    return pa.RecordBatch.from_arrays([*ints(kind, task), *longs(conv, n, chars, 0), *ints(*products, *zeros), *longs(*zeros)], names=FOLDED)


def placed(parts: DataFrame, seed: int) -> DataFrame:
    """Every turn with its place and product in the whole conversation: what a
    conversation has in earlier partitions is composed in front. Only the first
    conversation of a partition has any, so the table of these is no larger than
    the number of partitions, and is broadcast."""
    before = Window.partitionBy("conv_id").orderBy("_part", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.where("_kind > 0").select(*[c for c in FOLDED if c[:2] not in ("_x", "_d")])
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    ends = ends.withColumns({"_n": so_far(F.col("_i")), "_c": so_far(F.col("_p"))})
    ends = ends.withColumns({f"_w{k}": power(F.col("_n"), b) for k, b in zip(LANES, bases(seed))})
    ends = ends.withColumns({f"_b{k}": so_far(F.col(f"_w{k}") * F.col(f"_s{k}") % PRIME) % PRIME for k in LANES})
    carry = ends.where("_kind = 1 and _n > 0").select(
        F.col("_part").alias("_to"), F.col("conv_id").alias("_of"), "_n", "_c", *[f"_w{k}" for k in LANES], *[f"_b{k}" for k in LANES]
    )
    rows = parts.where("_kind = 0").join(F.broadcast(carry), (F.col("_part") == F.col("_to")) & (F.col("conv_id") == F.col("_of")), "left")
    behind = lambda c, w: F.when(F.col("_n").isNull(), c.cast("bigint")).otherwise(c.cast("bigint") * w % PRIME)
    return rows.select(
        "conv_id", (F.col("_i") + F.coalesce("_n", F.lit(0))).alias("_i"), (F.col("_p") + F.coalesce("_c", F.lit(0))).alias("_p"), "n_chars",
        *[((behind(F.col(f"_s{k}"), F.col(f"_w{k}")) + F.coalesce(f"_b{k}", F.lit(0))) % PRIME).alias(f"_s{k}") for k in LANES],
        *[behind(F.col(f"_x{k}"), F.col(f"_w{k}")).alias(f"_x{k}") for k in LANES],
        *[f"_d{k}" for k in LANES],
    )


def joined(rows: DataFrame, one: DataFrame, on: list[tuple[str, str]], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key. Keys with more than a
    thousandth of the ``total`` rows are few (a thousand at most) and broadcast;
    no other key can be a hot spot. ``size`` is how many rows a key has."""
    heavy = F.col(size) * HEAVY > total
    same = lambda other: [rows[a] == other[b] for a, b in on]
    few, many = one.where(heavy), one.where(~heavy)
    rest = rows.join(F.broadcast(few.select(*[b for _, b in on])), same(few), "left_anti")
    return rows.join(F.broadcast(few), same(few)).unionByName(rest.join(many, [rest[a] == many[b] for a, b in on]))


def prefix_rows(turns: DataFrame, base: Callable[[Column], Column], kept: Callable[[Column], Column], max_kept: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, prefixes): a row per rebuilt conversation, and one per
    rebuilt conversation and depth with the prefix's fingerprint, its parent's,
    the digest of its last turn, and the characters before that turn."""
    multipliers = bases(seed)
    own = placed(folded(turns, seed), seed)
    products = [f"_s{k}" for k in LANES]
    head = F.struct("_i", "_p", "n_chars", *products, *[f"_d{k}" for k in LANES])
    convs = own.groupBy("conv_id").agg(
        F.max("_i").alias("_n"), F.max("_p").alias("_all"), F.sort_array(F.collect_list(F.when(F.col("_i") <= max_kept, head))).alias("_heads")
    ).withColumns({"_base": base(F.col("conv_id")), "_h": F.least(kept(F.col("conv_id")), F.lit(max_kept)).cast("int")})
    convs = stored(convs, "conversations")
    others = convs.select(F.col("conv_id").alias("_b"), F.col("_heads").alias("_front"))
    rebuilt = convs.join(others, F.col("_base") == F.col("_b"), "left")
    front = F.coalesce(F.slice("_front", F.lit(1), F.col("_h")), F.array().cast(convs.schema["_heads"].dataType))
    rebuilt = rebuilt.withColumn("_front", front).withColumn("_m", F.size("_front").cast("bigint"))
    # Nothing is in front of the first turn.
    at = lambda heads, n, name: F.when(n > 0, F.get(F.col(heads), (n - 1).cast("int"))[name]).otherwise(0).cast("bigint")
    m, h = F.col("_m"), F.least(F.col("_h"), F.col("_n"))
    rebuilt = rebuilt.select(
        "conv_id", "_n", "_h", "_m", "_front",
        (m + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).alias("_len"),
        (at("_front", m, "_p") + F.col("_all") - at("_heads", h, "_p")).alias("_total"),
        (at("_front", m, "_p") - at("_heads", h, "_p")).alias("_shift"),
        *[at("_front", m, f"_s{k}").alias(f"_f{k}") for k in LANES], *[at("_heads", h, f"_s{k}").alias(f"_o{k}") for k in LANES],
    )
    rebuilt = stored(rebuilt, "rebuilt")
    pack = lambda s: [F.shiftleft(s[0].cast("bigint"), 31).bitwiseOR(s[1].cast("bigint")), F.shiftleft(s[2].cast("bigint"), 31).bitwiseOR(s[3].cast("bigint"))]
    zero = F.lit(0).cast("bigint")

    def shaped(depth, here, parent, last, n_chars, before):
        (k1, k2), (q1, q2) = pack(here), pack(parent)
        return [
            "conv_id", depth.cast("bigint").alias("depth"), k1.alias("_k1"), k2.alias("_k2"), q1.alias("_q1"), q2.alias("_q2"),
            *[d.alias(f"_d{k}") for k, d in enumerate(last)], n_chars.alias("n_chars"), before.alias("_before"), "_len", "_total",
        ]

    roots = rebuilt.select(*shaped(zero, [zero] * 4, [zero] * 4, [zero] * 4, zero, zero))
    turn, index = F.col("_turn"), F.col("_at").cast("int")
    fronts = rebuilt.select("*", F.posexplode("_front").alias("_at", "_turn"))
    above = [F.when(index > 0, F.get(F.col("_front"), index - 1)[s]).otherwise(0) for s in products]
    fronts = fronts.select(
        *shaped(index + 1, [turn[s] for s in products], above, [turn[f"_d{k}"] for k in LANES], turn["n_chars"], turn["_p"] - turn["n_chars"])
    )
    n_turns = convs.agg(F.sum("_n")).first()[0] or 0
    longer = rebuilt.where(F.col("_n") > F.col("_h")).drop("_front").withColumnRenamed("conv_id", "_c")
    rest = joined(own, longer, [("conv_id", "_c")], "_n", n_turns).where(F.col("_i") > F.col("_h"))
    # Own turns move from place _i to place _i - (_h - _m): their product is divided by that power.
    back = [F.element_at(F.array(*[F.lit(pow(b, -j, PRIME)).cast("bigint") for j in range(max_kept + 1)]), (F.col("_h") - m + 1).cast("int")) for b in multipliers]
    moved = lambda k, s: (F.col(f"_f{k}") + (s - F.col(f"_o{k}") + PRIME) % PRIME * back[k]) % PRIME
    here = [moved(k, F.col(f"_s{k}")) for k in LANES]
    parent = [moved(k, (F.col(f"_s{k}") - F.col(f"_x{k}") + PRIME) % PRIME) for k in LANES]
    rest = rest.select(
        *shaped(m + F.col("_i") - F.col("_h"), here, parent, [F.col(f"_d{k}") for k in LANES], F.col("n_chars"), F.col("_p") - F.col("n_chars") + F.col("_shift"))
    )
    return rebuilt, stored(roots.unionByName(fronts).unionByName(rest), "prefixes")


def ends_of(prefixes: DataFrame) -> DataFrame:
    """Per node where conversations end the digest of their ids. Ids are sorted
    over all partitions and joined to strings there; a node's strings are then
    hashed one after the other, so a node with very many ends needs little memory."""

    def written(batches):
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in KEY])
            ids = batch.column("conv_id")
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            text = ids.cast(pa.string()).to_pylist()
            bounds = [*starts.tolist(), batch.num_rows]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(k[starts]) for k in keys], ids.take(pa.array(starts)), pa.array([",".join(text[a:z]) for a, z in zip(bounds, bounds[1:])])],
                names=[*KEY, "_first", "_ids"],
            )

    def hashed(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for *this, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "_ids")]):
                if this == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = this, hashlib.sha256(ids.encode())
            yield table(out)
        if key:
            yield table([(*key, digest.hexdigest())])

    def table(rows):
        kinds = [*[pa.int64()] * 3, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*KEY, "ends_sha256"])

    ends = prefixes.where("depth = _len").select(*KEY, "conv_id").repartitionByRange("_k1", "_k2", "conv_id").sortWithinPartitions(*KEY, "conv_id")
    key = "depth bigint, _k1 bigint, _k2 bigint"
    parts = ends.mapInArrow(written, f"{key}, _first bigint, _ids string").repartition(*KEY).sortWithinPartitions(*KEY, "_first")
    return parts.mapInArrow(hashed, f"{key}, ends_sha256 string")


def prefix_trie(
    turns: DataFrame,
    base: Callable[[Column], Column],
    kept: Callable[[Column], Column],
    max_kept: int,
    seed: int = 0,
) -> DataFrame:
    """The trie of rebuilt conversations: each is the first ``kept(id)`` (at most
    ``max_kept``) turns of conversation ``base(id)`` and then its own turns after
    its first ``kept(id)``. A node is a distinct sequence of first turns.

    Turns are fingerprinted where they lie and their running products composed
    over partitions; a rebuilt prefix's fingerprint is the head's product times
    the own stretch's, so texts neither move nor are put together. Prefixes meet
    by fingerprint (124 bits) and depth. Every group is then verified through
    what its members refer to: all must have the same last turn (SHA-256 of role
    and text) and the same parent group, which by induction makes them equal; if
    any group fails, all is done again with other multipliers.

    All sums over subtrees are sums over members: a conversation is the least
    member of its nodes from some depth on, so what it saves at a node and below
    is the difference of two of its running character counts. No group is
    collected; conversations, parents and turns that hold more than a thousandth
    of the rows are joined by broadcast, of which there are at most a thousand.

    ``turns`` is (conv_id, turn, role, text). Turns are ordered by ``turn``, null
    first; ties by the digest of role and text, so the result does not depend on
    row order; repeated rows are turns of their own. Null role or text is empty.
    Rows with a null conv_id belong to no conversation and are left out. A
    missing base has no turns; empty input gives no rows; other columns are not
    read, whatever their names.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    # 64 bits a lane, as signed numbers.
    lanes = [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("bigint").alias(f"_d{k}") for k in LANES]
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.char_length(text).cast("bigint").alias("n_chars"), *lanes
    )
    while True:
        rebuilt, prefixes = prefix_rows(rows, base, kept, max_kept, seed)
        checked = [f"_d{k}" for k in LANES] + ["_q1", "_q2", "n_chars", "_before"]
        nodes = stored(
            prefixes.groupBy(*KEY).agg(
                F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("_len").alias("_longest"),
                *[F.min(c).alias(c) for c in checked], *[F.max(c).alias(f"{c}_") for c in checked],
            ),
            "nodes",
        )
        differ = F.lit(False)
        for c in checked:
            differ = differ | (F.col(c) != F.col(f"{c}_"))
        if nodes.where(differ).isEmpty():
            break
        seed += 1
    nodes = nodes.select(*KEY, "conv_id", "n_convs", "_longest", "_q1", "_q2", "_before")

    # From the first depth on at which a conversation is a node's least member it is so down to its end.
    firsts = nodes.groupBy(F.col("conv_id").alias("_r")).agg(F.min("_before").alias("_from"), F.max((F.col("_longest") == F.col("depth")).cast("bigint")).alias("_leaf"))
    own = rebuilt.select(F.col("conv_id").alias("_c"), F.col("_len").alias("_l"), F.col("_total").alias("_t")).join(firsts, F.col("_c") == F.col("_r"), "left")
    own = own.select("_c", (F.col("_l") + 1).alias("_rows"), F.coalesce("_from", "_t").alias("_from"), F.coalesce("_leaf", F.lit(0)).alias("_leaf"))
    members = joined(prefixes.select(*KEY, "conv_id", "_before"), stored(own, "members"), [("conv_id", "_c")], "_rows", prefixes.count())
    sums = members.groupBy(*KEY).agg(
        F.sum("_leaf").cast("bigint").alias("n_leaves"), F.sum(F.greatest(F.col("_from") - F.col("_before"), F.lit(0))).cast("bigint").alias("saved_tokens")
    )

    named = lambda df, mark: df.withColumnsRenamed({c: f"{mark}{c}" for c in KEY})
    same = lambda mark: [F.col(c) == F.col(f"{mark}{c}") for c in KEY]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("_q1").alias("_k1"), F.col("_q2").alias("_k2")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(named(sums, "s"), same("s")).join(named(children, "c"), same("c"), "left").join(named(ends_of(prefixes), "e"), same("e"), "left")
    full = stored(
        full.select(
            *KEY, "_q1", "_q2", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        ),
        "trie",
    )
    parents = full.where("n_children > 0").select(F.col("depth").alias("_pd"), F.col("_k1").alias("_p1"), F.col("_k2").alias("_p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_many"))
    below = full.where("depth > 0").withColumn("_up", F.col("depth") - 1)
    found = joined(below, parents, [("_up", "_pd"), ("_q1", "_p1"), ("_q2", "_p2")], "_many", full.count())
    root = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return found.select(*COLUMNS).unionByName(root.select(*COLUMNS))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
