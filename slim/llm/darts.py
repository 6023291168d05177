"""Near-duplicates by DartMinHash over weighted word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slim.llm.common import bound_batches, joined_bytes, mix64, stored
from slim.llm.graph import components

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SHINGLE = 5
SLICE = 1 << 22  # bytes of text looked at together
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the document it is in."""
    hashes, owners, begin = [], [], 0
    while begin < len(flat):
        end = min(len(flat), begin + SLICE)
        while end < len(flat):  # to the next space or end of a document
            stop = int(offsets[np.searchsorted(offsets, end)])
            gap = np.flatnonzero(SPACE[flat[end : min(stop, end + SLICE)]])
            end = end + int(gap[0]) if len(gap) else min(stop, end + SLICE)
            if len(gap) or end == stop:
                break
        part = flat[begin:end]
        word = ~SPACE[part]
        edges = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end)] - begin
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        starts[edges] = word[edges]
        first = np.flatnonzero(starts)
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        inner = edges[edges > 0] - 1
        stops[inner] = word[inner]
        last = np.flatnonzero(stops) + 1
        powers = np.cumprod(np.full(len(part), BASE), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
        back = np.cumprod(np.full(len(part), BASE_INVERSE), dtype=np.uint64)
        hashes.append(mix64((sums[last] - sums[first]) * back[first]))
        owners.append(np.searchsorted(offsets, first + begin, side="right") - 1)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, ascending, and how often each occurs:
    documents, hashes, counts. Fewer words than a shingle are one shingle."""
    h, doc = word_hashes(flat, offsets)
    n = len(h) - SHINGLE + 1
    combined = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE):
        combined = mix64(combined * BASE + h[k : k + n]) if n > 0 else combined
    whole = np.flatnonzero(doc[: max(n, 0)] == doc[SHINGLE - 1 :]) if n > 0 else np.zeros(0, np.int64)
    owner, value = doc[whole], combined[whole]
    sizes = np.bincount(doc, minlength=len(offsets) - 1)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        first = np.searchsorted(doc, short)
        folded = sizes[short].astype(np.uint64)
        for k in range(SHINGLE - 1):
            more = k < sizes[short]
            folded[more] = mix64(folded[more] * BASE + h[first[more] + k])
        owner, value = np.concatenate([owner, short]), np.concatenate([value, folded])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(fresh)
    return owner[at], value[at], np.diff(np.append(at, len(order)))


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int, seed: int = 0) -> np.ndarray:
    """k coordinates for each of n weighted sets; a coordinate of two sets is
    equal with the probability of their generalised Jaccard similarity.

    Darts are a Poisson process of unit density over (element, weight, rank),
    drawn from hashes, so all sets see the same ones. A set catches those under
    its elements' weights, up to a rank at which about k (ln k + 2) are caught;
    each dart names a coordinate, which keeps its earliest. The few sets with an
    empty coordinate look to twice the rank. Empty sets keep zeros."""
    signature = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weight, minlength=n)
    reach = np.divide(k * (np.log(k) + 2), total, out=np.zeros(n), where=total > 0)
    active = total > 0
    while active.any():
        mine = active[owner]
        who, what, high = owner[mine], element[mine], weight[mine]
        cells = np.ceil(high).astype(np.int64)
        at = np.repeat(np.arange(len(who)), cells)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        who, high = who[at], high[at] - cell
        state = mix64(what[at] + BASE * (cell.astype(np.uint64) + np.uint64(seed + 1)))
        rank = np.zeros(len(at))
        caught = []
        while len(who):
            state = mix64(state + BASE)
            rank = rank - np.log(uniform(state))
            near = rank <= reach[who]
            who, high, state, rank = who[near], high[near], state[near], rank[near]
            if not len(who):
                break
            dart = mix64(state ^ np.uint64(0xD6E8FEB86659FD93))
            under = (high >= 1) | (uniform(mix64(dart + BASE)) <= high)
            caught.append((who[under] * k + (dart[under] % np.uint64(k)).astype(np.int64), rank[under], dart[under]))
        place, ranks, darts = (np.concatenate(c) for c in zip(*caught)) if caught else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))
        best = np.full(n * k, np.inf)
        np.minimum.at(best, place, ranks)
        won = ranks == best[place]
        flat = np.zeros(n * k, np.uint64)
        flat[place[won]] = darts[won]
        full = active & np.isfinite(best.reshape(n, k)).all(axis=1)
        signature[full] = flat.reshape(n, k)[full]
        active &= ~full
        reach[active] *= 2
    return signature


def slices(offsets: np.ndarray):
    """Ranges of documents of about SLICE bytes, one document at least."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, side="right")) - 1)
        yield begin, end
        begin = end


def signature_table(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Of (_id, _hash, _text): number of shingles, band keys, and 16 bits of each coordinate."""

    def sign(batches):
        for batch in batches:
            flat, offsets = joined_bytes(batch.column("_text"))
            for a, b in slices(offsets):
                own = offsets[a : b + 1] - offsets[a]
                owner, value, count = shingles(flat[offsets[a] : offsets[b]], own)
                signature = dart_signatures(owner, value, count.astype(float), b - a, bands * rows)
                keys = np.repeat(np.arange(bands, dtype=np.uint64)[None], b - a, axis=0)
                for r in range(rows):
                    keys = mix64(keys * BASE + signature.reshape(b - a, bands, rows)[:, :, r])
                sizes = np.bincount(owner, count, minlength=b - a).astype(np.int64)
                keys = [x if s else [] for x, s in zip(keys.view(np.int64).tolist(), sizes.tolist())]
                brief = [x.tobytes() for x in (signature & np.uint64(0xFFFF)).astype("<u2")]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_hash"), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), pa.array(brief, pa.binary())],
                    names=["_id", "_hash", "n_shingles", "_bands", "_brief"],
                )

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"_id {kind}, _hash binary, n_shingles bigint, _bands array<bigint>, _brief binary")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have generalised Jaccard similarity of ``threshold`` or more."""

    def compare(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            index = {}
            for nodes, column in ((a, "_ta"), (b, "_tb")):
                for i, node in enumerate(nodes):
                    index.setdefault(node, (column, i))
            tables = [batch.column(c).filter(pa.array([index[x] == (c, i) for i, x in enumerate(nodes)])) for nodes, c in ((a, "_ta"), (b, "_tb"))]
            order = [x for nodes, c in ((a, "_ta"), (b, "_tb")) for i, x in enumerate(nodes) if index[x] == (c, i)]
            sets, at = Sets(pa.concat_arrays(tables)), {node: i for i, node in enumerate(order)}
            good = [sets.linked(at[x], at[y], threshold) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good)], names=["a", "b", "linked"])

    left = texts.select(F.col("node").alias("_na"), F.col("_text").alias("_ta"))
    right = texts.select(F.col("node").alias("_nb"), F.col("_text").alias("_tb"))
    joined = pairs.join(right, F.col("b") == F.col("_nb")).join(left, F.col("a") == F.col("_na")).select("a", "b", "_ta", "_tb")
    return joined.mapInArrow(compare, "a bigint, b bigint, linked boolean")


class Sets:
    """Shingle sets of some texts, for comparing pairs of them."""

    def __init__(self, texts):
        flat, offsets = joined_bytes(texts)
        self.sets = []
        for x, y in slices(offsets):
            owner, value, count = shingles(flat[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            cuts = np.searchsorted(owner, np.arange(y - x + 1))
            self.sets += [(value[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]]) for i in range(y - x)]
        self.total = [int(c.sum()) for _, c in self.sets]

    def linked(self, i: int, j: int, threshold: float) -> bool:
        (v, p), (w, q) = self.sets[i], self.sets[j]
        _, s, t = np.intersect1d(v, w, assume_unique=True, return_indices=True)
        both = int(np.minimum(p[s], q[t]).sum())
        return both >= threshold * (self.total[i] + self.total[j] - both) - 1e-9


def across(nodes: DataFrame, threshold: float, least: float, block: int = 2048) -> DataFrame:
    """Links (a, b) between components of a group, as many as join what is linked.

    ``nodes`` is (group, node, label, brief, text): a group holds all nodes that
    share buckets, directly or through others, a label a component found so
    far. Only groups with several labels are looked at. Every pair of a group
    meets in one task, block against block; pairs of different labels whose
    signatures agree in at least ``least`` of their places are compared by their
    whole texts, most alike first, and a link joins two labels. No pair is
    written that is not a link."""
    sizes = nodes.groupBy("group").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_m")).where("_lo < _hi")
    split = F.ceil(F.col("_m") / block).cast("int")
    dealt = nodes.join(sizes.select("group", split.alias("_split")), "group").withColumn("_own", F.pmod(F.xxhash64("node"), "_split").cast("int"))
    pairs = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_split") - 1)))
    key = ["group", "_p", "_q"]
    blocks = pairs.select("group", F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q"), "_own", "node", "label", "brief", "text")

    def links_of(table, p, q):
        own, node, label = (table.column(c).to_numpy() for c in ("_own", "node", "label"))
        brief = np.frombuffer(b"".join(table.column("brief").to_pylist()), "<u2").reshape(table.num_rows, -1)
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        sets, parent, found = None, {}, []

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for i in range(0, len(left), 64):
            part = left[i : i + 64]
            alike = np.zeros((len(part), len(right)))
            for j in range(0, len(right), 512):
                alike[:, j : j + 512] = (brief[part][:, None, :] == brief[right[j : j + 512]][None]).mean(axis=2)
            s, t = np.nonzero((alike >= least) & (label[part][:, None] != label[right][None]) & ((p != q) | (node[part][:, None] < node[right][None])))
            for n in np.argsort(-alike[s, t], kind="stable").tolist():
                x, y = int(part[s[n]]), int(right[t[n]])
                a, b = root(int(label[x])), root(int(label[y]))
                if a == b:
                    continue
                sets = sets or Sets(table.column("text"))
                if sets.linked(x, y, threshold):
                    parent[max(a, b)] = min(a, b)
                    found.append((int(node[x]), int(node[y])))
        return found

    def compare(batches):
        rest = None

        def run(table, last):
            keys = np.stack([table.column(c).to_numpy() for c in key])
            edges = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))).tolist()
            ends = [*edges[1:], table.num_rows]
            done = len(edges) if last else len(edges) - 1
            found = [x for e, f in zip(edges[:done], ends[:done]) for x in links_of(table.slice(e, f - e), keys[1, e], keys[2, e])]
            return found, None if last else table.slice(edges[done])

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if table.num_rows:
                found, rest = run(table, False)
                yield batch_of(found)
        if rest is not None:
            yield batch_of(run(rest, True)[0])

    return blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, bands: int = 24, rows: int = 4, slack: float = 0.17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Classes of documents linked by near-duplicate texts.

    Texts are weighted sets of five-word shingles (weight: how often), words as
    everywhere in this package; a text of one to four words is one shingle. Two
    texts are linked when their generalised Jaccard similarity is ``threshold``
    or more; classes are the connected components of links, and equal texts are
    always together. Texts without words match only equal ones; a null text is
    alone. Rows with the same id are judged by their texts. Empty input gives no
    rows; other columns are not read.

    Equal texts become one node. DartMinHash signatures are cut into bands;
    nodes with an equal band are candidates (missed at similarity 0.8: 3 in a
    million by default). Each node is first compared with the least node it
    shares most bands with. Where that leaves several components among nodes
    that share bands, all pairs across them whose signatures agree to within
    ``slack`` (four standard errors) of the threshold are compared, block by
    block in tasks that write nothing but links. Every link is verified on whole
    texts; pairs inside a component are never formed.

    Returns id, class_id (least id of the class), first (this row's text holds
    the least id), n_shingles and text_hash."""
    bound_batches(docs.sparkSession)
    lettered = docs.select(
        F.col(id_col).alias("_id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("_hash"), F.col(text_col).alias("_text")
    )
    signed = stored(signature_table(lettered, bands, rows), "signatures")
    grouped = signed.where(F.col("_hash").isNotNull()).groupBy("_hash").agg(F.min("_id").alias("_first"), F.first("_bands").alias("_bands"), F.first("_brief").alias("_brief"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.posexplode("_bands").alias("band", "key"))
    leads = banded.groupBy("band", "key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m")
    members = stored(banded.join(leads, ["band", "key"]), "buckets")
    votes = members.where("node != lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("_c"))
    first_pairs = votes.groupBy(F.col("node").alias("a")).agg(F.max_by("lead", F.struct("_c", -F.col("lead"))).alias("b"))
    wanted = members.select("node").distinct().join(nodes.select("node", "_hash", "_first"), "node")
    texts = stored(
        lettered.join(wanted, ["_hash"]).where(F.col("_id").eqNullSafe(F.col("_first"))).select("node", "_text").dropDuplicates(["node"]), "texts"
    )
    linked = stored(verified(first_pairs, texts, threshold), "tried").where("linked").select("a", "b")
    groups = components(members.where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    own = groups.join(components(linked).withColumnsRenamed({"node": "_n", "label": "_l"}), F.col("node") == F.col("_n"), "left")
    sorted_out = stored(own.select("node", F.col("label").alias("group"), F.coalesce("_l", "node").alias("label")), "groups")
    wide = sorted_out.join(nodes.select("node", F.col("_brief").alias("brief")), "node").join(texts.withColumnRenamed("_text", "text"), "node")
    more = stored(across(wide, threshold, threshold - slack), "links")
    labels = components(linked.unionByName(more)).withColumnsRenamed({"node": "_n", "label": "_l"})
    placed = nodes.select("node", "_hash", "_first").join(labels, F.col("node") == F.col("_n"), "left").select(
        F.col("_hash").alias("_h"), F.col("_first").alias("_f"), F.coalesce("_l", "node").alias("_label"), "node"
    )
    classes = placed.groupBy("_label").agg(F.min("_f").alias("_class"), F.min_by("node", F.struct(F.isnull("_f"), "_f", "node")).alias("_chosen"))
    judged = placed.join(classes, "_label").select("_h", "_f", "_class", (F.col("node") == F.col("_chosen")).alias("_lead"))
    out = signed.select("_id", "_hash", "n_shingles").join(judged, F.col("_hash") == F.col("_h"), "left")
    return out.select(
        F.col("_id").alias(id_col), F.when(F.col("_hash").isNull(), F.col("_id")).otherwise(F.col("_class")).alias("class_id"),
        (F.col("_hash").isNull() | (F.col("_lead") & F.col("_id").eqNullSafe(F.col("_f")))).alias("first"), "n_shingles", F.col("_hash").alias("text_hash"),
    )
