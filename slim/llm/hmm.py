"""A hidden Markov language model, trained by Baum-Welch counts from all partitions."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slim.llm.common import bound_batches, give_back, stored

DIGEST = 12  # bytes that stand for a word: 96 bits of a hash
SEGMENT = 256  # tokens of a document that are followed together
RESCALE = 8  # steps between two scalings of a score
ALPHA, SMOOTH = 0.1, 0.1
LN10 = float(np.log(10.0))


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def last_letters(word: bytes) -> bytes:
    """The last two letters of a word in UTF-8."""
    end = word[-2:]
    return end if end.isascii() else word[-8:].decode(errors="ignore")[-2:].encode()


def word_class(letters: bytes, classes: int) -> int:
    """The emission class of a word that is not among the frequent ones: by its
    last two letters, which tell languages and forms apart."""
    return zlib.crc32(letters) % classes


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def bucket_of(digest: bytes, buckets: int) -> int:
    return int.from_bytes(digest[:4], "big") * buckets >> 32


def code_texts(docs: DataFrame, buckets: int, classes: int, chunk_bytes: int) -> DataFrame:
    """Chunks of documents as numbers of their own words (bucket -1), and per
    chunk and bucket its words: digests in order, how often training documents
    have them, and their classes."""
    schema = "chunk bigint, bucket int, ids binary, sizes binary, codes binary, words binary"

    def code(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column("_id").to_pylist(), batch.column("_text")
            texts = texts.cast(pa.large_binary()).fill_null(b"")
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(ids) + 1, 8 * texts.offset)) if len(ids) else []
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(ids):
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + chunk_bytes, side="right")))
                table, codes, lengths = defaultdict(), [], []
                table.default_factory = table.__len__
                for text in texts.slice(begin, end - begin).to_pylist():
                    # Of bytes, these lower A-Z and split at \x20 and \x09-\x0D only.
                    own = text.lower().split()
                    codes.append(np.fromiter(map(table.__getitem__, own), np.uint32, len(own)))
                    lengths.append(len(own))
                chosen = ids[begin:end]
                test = np.array([held_out(i) for i in chosen])
                flat = np.concatenate(codes)
                seen = np.bincount(flat[~np.repeat(test, lengths)], minlength=len(table))
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w)[:DIGEST] for w in table]), f"V{DIGEST}")
                sortable = as_digests(digests)
                rank = np.lexsort((sortable["b"], sortable["a"]))
                place = np.empty(len(rank), np.uint32)
                place[rank] = np.arange(len(rank), dtype=np.uint32)
                letters = [last_letters(w) for w in table]
                kind_of = {x: word_class(x, classes) for x in set(letters)}
                kinds = np.array([kind_of[x] for x in letters], "<u2")[rank]
                ordered = digests[rank].tobytes()
                heads = np.frombuffer(ordered, ">u4")[:: DIGEST // 4].astype(np.uint64)
                cuts = np.searchsorted((heads * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
                meta = pa.BufferOutputStream()
                with pa.ipc.new_stream(meta, pa.schema([batch.schema.field("_id")])) as writer:
                    writer.write_table(pa.table([batch.column("_id").slice(begin, end - begin)], names=["_id"]))
                rows = [(number, -1, meta.getvalue().to_pybytes(), np.array(lengths, "<i8").tobytes(), squeeze(planes(place[flat])), None)]
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    x, y = int(cuts[b]), int(cuts[b + 1])
                    rows.append((number, b, None, squeeze(seen[rank[x:y]].astype("<i8").tobytes()), kinds[x:y].tobytes(), ordered[DIGEST * x : DIGEST * y]))
                yield pa.RecordBatch.from_pylist([dict(zip(("chunk", "bucket", "ids", "sizes", "codes", "words"), r)) for r in rows], schema=CODED)
                number, begin = number + 1, end
            give_back()

    return docs.mapInArrow(code, schema)


CODED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), *[(n, pa.binary()) for n in ("ids", "sizes", "codes", "words")]])


def planes(codes: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: the high ones are nearly empty."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def as_digests(data: bytes) -> np.ndarray:
    """Digests as pairs of numbers that sort alike."""
    return np.frombuffer(data, [("a", ">u8"), ("b", ">u4")])


def merged(blobs: list[bytes]):
    """All digests of some chunks: distinct ones in order, and the number of each."""
    both = np.concatenate([as_digests(x) for x in blobs])
    a, b = both["a"].astype(np.uint64), both["b"].astype(np.uint64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return a[fresh], b[fresh], number


class Sequences:
    """Documents cut in segments that run side by side. Step t holds the t-th
    token of all segments longer than t, longest first."""

    def __init__(self, classes: np.ndarray, lengths: np.ndarray):
        pieces = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = (np.cumsum(lengths) - lengths)[doc] + nth * SEGMENT
        sizes = np.minimum(SEGMENT, lengths[doc] - nth * SEGMENT)
        order = np.argsort(-sizes, kind="stable")
        self.doc, self.nth, self.starts, self.sizes = doc[order], nth[order], starts[order], sizes[order]
        self.active = len(order) - np.searchsorted(self.sizes[::-1], np.arange(self.sizes[0] if len(order) else 0), side="right")
        self.classes = classes

    def step(self, t):
        return self.classes[self.starts[: self.active[t]] + t]


def expected_counts(seq: Sequences, start, move, emit, counts):
    """Adds a chunk's expected starts, moves and emissions. Segments begin with
    the start distribution; the cut changes the counts of one move in SEGMENT.
    States are rows and segments columns, so that every operation runs along
    memory; emissions are counted once, over all steps."""
    steps, k = len(seq.active), len(start)
    n = int(seq.active[0]) if steps else 0
    onward, shown = np.ascontiguousarray(move.T), np.ascontiguousarray(emit.T)
    codes, forward, scales = [seq.step(t) for t in range(steps)], [], []
    for t in range(steps):
        a = shown.take(codes[t], axis=1)
        a *= start[:, None] if t == 0 else onward @ forward[-1][:, : seq.active[t]]
        scale = a.sum(axis=0)
        a /= scale
        forward.append(a)
        scales.append(scale)
    back = np.ones((k, n))
    starts, moves, emissions = counts
    for t in range(steps - 1, -1, -1):
        m = seq.active[t]
        if t:
            ahead = shown.take(codes[t], axis=1)
            ahead *= back[:, :m]
            ahead /= scales[t]
            moves += move * (forward[t - 1][:, :m] @ ahead.T)
        # Where the forward values were, the shares of the states stay.
        gamma = forward[t]
        gamma *= back[:, :m]
        gamma /= gamma.sum(axis=0)
        if t:
            back[:, :m] = move @ ahead
        else:
            starts += gamma[:, seq.nth[:m] == 0].sum(axis=1)
    if steps:
        every = np.concatenate(codes)
        for z in range(k):
            emissions[:, z] += np.bincount(every, np.concatenate([gamma[z] for gamma in forward]), minlength=len(emissions))


def followed(seq: Sequences, at: np.ndarray, entries, onward, shown):
    """Forward values at the ends of some segments (columns), one table for each
    distribution of the first state, and the logarithm of their common scale.
    RESCALE steps without scaling stay far above the smallest double."""
    starts, sizes = seq.starts[at], seq.sizes[at]
    active = len(at) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(at) else 0), side="right")
    tables, scale = [np.empty((len(onward), len(at))) for _ in entries], np.zeros(len(at))
    for t, m in enumerate(active):
        here = shown.take(seq.classes[starts[:m] + t], axis=1)
        for a, entry in zip(tables, entries):
            np.multiply(entry[:, None] if t == 0 else onward @ a[:, :m], here, out=a[:, :m])
        if t % RESCALE == RESCALE - 1:
            total = sum(a[:, :m].sum(axis=0) for a in tables)
            for a in tables:
                a[:, :m] /= total
            scale[:m] += np.log(total)
    return tables, scale


def log_likelihoods(seq: Sequences, n_docs, start, move, emit) -> np.ndarray:
    """Exact natural log probability of each document's classes, by the scaled
    forward recursion. A first segment carries a distribution; a later one the
    transfer matrix from each possible state before it, and the matrices of a
    document are applied one after the other."""
    out, state = np.zeros(n_docs), np.zeros((len(start), n_docs))
    onward, shown = np.ascontiguousarray(move.T), np.ascontiguousarray(emit.T)
    heads, rest = np.flatnonzero(seq.nth == 0), np.flatnonzero(seq.nth > 0)
    (ends,), scale = followed(seq, heads, [start], onward, shown)
    total = ends.sum(axis=0)
    state[:, seq.doc[heads]] = ends / total
    out[seq.doc[heads]] = scale + np.log(total)
    ways, scale = followed(seq, rest, list(move), onward, shown)
    order = np.argsort(seq.nth[rest], kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(seq.nth[rest][order])) + 1) if len(rest) else []:
        d = seq.doc[rest[at]]
        v = sum(state[z, d] * ways[z][:, at] for z in range(len(start)))
        total = v.sum(axis=0)
        state[:, d] = v / total
        out[d] += scale[at] + np.log(total)
    return out


def hmm_scores(
    docs: DataFrame, states: int = 8, rounds: int = 4, frequent: int = 4096, classes: int = 4096, chunk_bytes: int = 1 << 23, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Log probability of every text under a hidden Markov model of its words.

    Training documents are those whose crc32 of the id as text is not 0 modulo
    10 (a null id counts as empty text, which is held out). Words are lower-cased
    (A-Z) and end with one end token. A latent state emits a class: each of the
    ``frequent`` most common training words (ties by digest) is a class, the end
    is one, all other words fall into ``classes`` classes by their last letters.
    Within those, words have add-``ALPHA`` unigram probabilities, with one share
    for the words of the class that training has not seen; so the model is a
    probability over the training vocabulary and one unknown per class. The
    model's size is bounded by its parameters, not by the corpus; word counts,
    which do grow, are exchanged between partitions as sorted digests.

    ``rounds`` of Baum-Welch start from all words' frequencies, tilted by hash
    for each state; each sums expected counts over all training documents. The
    score is the exact likelihood of the whole text. Null and empty texts are the
    end token alone. Repeated rows each count and each get their score. Empty
    input gives no rows; other columns are not read.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1
    unigram) and score, both log10."""
    spark = docs.sparkSession
    bound_batches(spark)
    if frequent + classes >= 1 << 16:
        raise ValueError("frequent + classes must be below 65536")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    end, n_classes = frequent + classes, frequent + classes + 1
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    coded = stored(code_texts(narrow, buckets, classes, chunk_bytes), "codes")
    kind = docs.schema[id_col].dataType.simpleString()

    # Counts of every word, in the bucket of its digest.
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, number = merged(rows["words"].tolist())
        seen = np.concatenate([np.frombuffer(unsqueeze(x), "<i8") for x in rows["sizes"]])
        kinds = np.concatenate([np.frombuffer(x, "<u2") for x in rows["codes"]])
        total = np.bincount(number, seen, minlength=len(a)).astype("<i8")
        of = np.empty(len(a), "<u2")
        of[number] = kinds
        top = np.lexsort((b, a, -total))[:frequent]
        top = top[total[top] > 0]
        place = np.zeros(len(a), "<u2")
        place[top] = np.arange(1, len(top) + 1)
        best = [a[top].astype("<u8").tobytes(), b[top].astype("<u8").tobytes(), total[top].tobytes(), of[top].astype("<u4").tobytes()]
        sums = np.bincount(of, total, minlength=classes).astype("<i8"), np.bincount(of, total > 0, minlength=classes).astype("<i8")
        out = [(-1, rows["bucket"].iloc[0], sums[0].tobytes(), sums[1].tobytes(), b"".join(best), len(top))]
        cuts = np.cumsum([0, *[len(x) // DIGEST for x in rows["words"]]])
        for c, x, y in zip(rows["chunk"], cuts, cuts[1:]):
            own = number[x:y]
            out.append((c, rows["bucket"].iloc[0], squeeze(total[own].tobytes()), squeeze(place[own].tobytes()), of[own].tobytes(), 0))
        give_back()
        return pd.DataFrame(out, columns=["chunk", "bucket", "counts", "distinct", "best", "n"])

    counted = stored(
        coded.where("bucket >= 0").groupBy("bucket").applyInPandas(count, "chunk bigint, bucket int, counts binary, distinct binary, best binary, n int"), "counts"
    )

    # Bounded sums: per class, and the most frequent words (spread as rows, so that no bucket's list meets another's whole).
    def listed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, raw = row["n"], row["best"]
                a, b, c = (np.frombuffer(raw, "<i8", n, 8 * n * i) for i in range(3))
                k = np.frombuffer(raw, "<u4", n, 24 * n).astype(np.int64)
                place = np.arange(1, n + 1)
                bucket = np.full(n, row["bucket"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, c, k, bucket, place)], names=["a", "b", "c", "k", "bucket", "place"])

    def class_sums(batches):
        total, distinct = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += np.frombuffer(row["counts"], "<i8")
                distinct += np.frombuffer(row["distinct"], "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(total), pa.array(distinct)], names=["k", "t", "d"])

    whole = counted.where("chunk = -1")
    tops = whole.select("best", "n", "bucket").mapInArrow(listed, "a bigint, b bigint, c bigint, k bigint, bucket bigint, place bigint")
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    tops = tops.orderBy(F.desc("c"), unsigned("a"), unsigned("b")).limit(frequent).collect()
    sums = whole.select("counts", "distinct").mapInArrow(class_sums, "k bigint, t bigint, d bigint").groupBy("k").agg(F.sum("t").alias("t"), F.sum("d").alias("d")).collect()
    train_docs = narrow.where(F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0).count()
    mass, distinct = np.zeros(n_classes), np.zeros(n_classes)
    for r in sums:
        mass[frequent + r["k"]], distinct[frequent + r["k"]] = r["t"], r["d"]
    train_tokens, vocabulary = int(mass.sum()) + train_docs, int(distinct.sum()) + (train_docs > 0)
    for i, r in enumerate(tops):
        mass[i], mass[frequent + r["k"]], distinct[frequent + r["k"]] = r["c"], mass[frequent + r["k"]] - r["c"], distinct[frequent + r["k"]] - 1
    mass[end] = train_docs
    top_index = {}
    for i, r in enumerate(tops):
        top_index.setdefault(r["bucket"], {})[r["place"]] = i

    # Every document as classes, with what does not depend on the states.
    def classify(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        row, counts, of = rows.iloc[0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for bucket, count, place, kinds in replies.sort_values("bucket")[["bucket", "counts", "distinct", "best"]].itertuples(index=False):
            counts.append(np.frombuffer(unsqueeze(count), "<i8"))
            own = frequent + np.frombuffer(kinds, "<u2").astype(np.int64)
            place = np.frombuffer(unsqueeze(place), "<u2")
            for i in np.flatnonzero(place):
                own[i] = top_index.get(bucket, {}).get(int(place[i]), own[i])
            of.append(own)
        counts, of = np.concatenate(counts), np.concatenate(of)
        inside = np.where(of < frequent, 0.0, np.log((counts + ALPHA) / (mass[of] + ALPHA * (distinct[of] + 1))))
        base = np.log10((counts + 0.1) / (train_tokens + 0.1 * (vocabulary + 1)))
        flat, lengths = from_planes(unsqueeze(row["codes"])), np.frombuffer(row["sizes"], "<i8")
        edges = np.concatenate([[0], np.cumsum(lengths)])
        add = lambda v: np.bincount(np.repeat(np.arange(len(lengths)), lengths), v[flat], minlength=len(lengths))
        end_base = np.log10((train_docs + 0.1) / (train_tokens + 0.1 * (vocabulary + 1)))
        facts = np.stack([lengths + 1, add((counts > 0).astype(float)) + (train_docs > 0), add(base) + end_base, add(inside)])
        with_end = np.insert(of[flat], edges[1:], end).astype("<u2")
        return pd.DataFrame({"chunk": [row["chunk"]], "ids": [row["ids"]], "facts": [facts.astype("<f8").tobytes()], "classes": [squeeze(with_end.tobytes())]})

    replies = counted.where("chunk >= 0").select("chunk", "bucket", "counts", "distinct", "best")
    ready = stored(
        coded.where("bucket < 0").select("chunk", "ids", "sizes", "codes").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(classify, "chunk bigint, ids binary, facts binary, classes binary"), "classes"
    )

    def sequences(row, training):
        facts = np.frombuffer(row["facts"], "<f8").reshape(4, -1)
        lengths, classes_of = facts[0].astype(np.int64), np.frombuffer(unsqueeze(row["classes"]), "<u2").astype(np.int64)
        ids = pa.ipc.open_stream(row["ids"]).read_all().column("_id")
        test = np.array([held_out(i) for i in ids.to_pylist()])
        if training:
            classes_of, lengths = classes_of[~np.repeat(test, lengths)], lengths[~test]
        return ids, test, facts, Sequences(classes_of, lengths), len(lengths)

    def fold(start, move, emit):
        def run(batches):
            counts = np.zeros(states), np.zeros((states, states)), np.zeros((n_classes, states))
            for batch in batches:
                for row in batch.to_pylist():
                    seq = sequences(row, True)[3]
                    if len(seq.active):
                        expected_counts(seq, start, move, emit, counts)
            rows = np.concatenate([counts[0][None], counts[1], counts[2]])
            some = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(rows[some, z]) for z in range(states)]], names=["i", *[f"c{z}" for z in range(states)]])

        return run

    rng = np.random.default_rng(seed)
    tilt = np.exp(rng.normal(size=(n_classes, states)))
    emit = (mass[:, None] + SMOOTH) * tilt
    emit /= emit.sum(axis=0)
    start, move = np.full(states, 1 / states), np.full((states, states), 0.05 / states) + 0.95 * np.eye(states)
    kinds_out = "i bigint, " + ", ".join(f"c{z} double" for z in range(states))
    for _ in range(rounds if train_docs else 0):
        summed = ready.select("ids", "facts", "classes").mapInArrow(fold(start, move, emit), kinds_out).groupBy("i").agg(*[F.sum(f"c{z}").alias(f"c{z}") for z in range(states)])
        counts = np.zeros((1 + states + n_classes, states))
        for r in summed.collect():
            counts[r["i"]] = r[1:]
        start = (counts[0] + SMOOTH) / (counts[0] + SMOOTH).sum()
        move = (counts[1 : 1 + states] + SMOOTH) / (counts[1 : 1 + states] + SMOOTH).sum(axis=1, keepdims=True)
        # A class that a state never met keeps a share by its frequency.
        prior = (mass + SMOOTH) / (mass + SMOOTH).sum()
        emit = counts[1 + states :] + SMOOTH * n_classes * prior[:, None]
        emit /= emit.sum(axis=0)

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, test, facts, seq, n = sequences(row, False)
                total = (log_likelihoods(seq, n, start, move, emit) + facts[3]) / LN10
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.combine_chunks(), pa.array(test), pa.array(facts[0].astype(np.int64)), pa.array(facts[1].astype(np.int64)),
                        pa.array(np.full(n, train_tokens)), pa.array(facts[2]), pa.array(total),
                    ],
                    names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return ready.select("ids", "facts", "classes").mapInArrow(
        score, f"_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    ).withColumnRenamed("_id", id_col)
