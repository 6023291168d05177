"""Two tokenizers' tokens of the same bytes, aligned by galloping intersection of their ends."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slim.llm.common import bound_batches, give_back, joined_bytes, stored
from slim.llm.tokens import ranks_path

BLOCK = 1 << 20  # bytes of text that are aligned at once
SLICE = 1 << 21  # links that are written out at once
WIDE = 1 << 12  # a group with more links is counted by distinct ids first
B_BITS = 16  # an id pair is a_id << B_BITS | b_id


class ByteTokenizer:
    """Byte-level BPE: ids of texts, and the bytes of every id."""

    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or ranks_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw
        self.encode = lambda texts: [bpe.encode_ordinary(" " + t) for t in texts]


class PieceTokenizer:
    """Sentence pieces, which begin texts with a space of their own."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.bytes = [b""] * model.get_piece_size()
        for i in range(len(self.bytes)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not model.is_control(i) and not model.is_unknown(i):
                self.bytes[i] = piece.replace("▁", " ").encode()
        self.encode = lambda texts: model.encode(texts, num_threads=1)


def gallop(keys: np.ndarray, near: np.ndarray, longer: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Per key the place of the least value not below it in its own ascending
    stretch ``longer[first:stop]`` (``stop`` if there is none).

    Each key starts at ``near`` and takes steps of 1, 2, 4 ... towards its place
    until it has passed it; binary search ends between the last two stops. The
    cost is the logarithm of the way, not of the list. All keys step together."""
    lo, hi = first - 1, stop.copy()
    near = np.clip(near, first, np.maximum(stop - 1, first))
    some = first < stop
    below = np.zeros(len(keys), bool)
    below[some] = longer[near[some]] < keys[some]
    lo[below] = near[below]
    above = some & ~below
    hi[above] = near[above]
    for going, sign in ((np.flatnonzero(below), 1), (np.flatnonzero(above), -1)):
        step = 1
        while len(going):
            at = (near[going] + sign * step).astype(np.int64)
            inside = (at < stop[going]) if sign > 0 else (at >= first[going])
            going, at = going[inside], at[inside]
            less = longer[at] < keys[going]
            lo[going[less]] = np.maximum(lo[going[less]], at[less])
            hi[going[~less]] = np.minimum(hi[going[~less]], at[~less])
            going = going[less if sign > 0 else ~less]
            step *= 2
    open_ = np.flatnonzero(hi - lo > 1)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        less = longer[mid] < keys[open_]
        lo[open_[less]], hi[open_[~less]] = mid[less], mid[~less]
        open_ = open_[hi[open_] - lo[open_] > 1]
    return hi


def common_ends(ends_a: np.ndarray, docs_a: np.ndarray, ends_b: np.ndarray, docs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of the ends that both have. ``docs_*`` are the n + 1
    offsets of each text's ends. Of each text the shorter list drives and gallops
    through the longer, starting where its ends would lie if they were even."""
    size_a, size_b = np.diff(docs_a), np.diff(docs_b)
    found = []
    for drives, ends, offsets, sizes, longer, into, spread in (
        (size_a <= size_b, ends_a, docs_a, size_a, ends_b, docs_b, size_b),
        (size_a > size_b, ends_b, docs_b, size_b, ends_a, docs_a, size_a),
    ):
        doc = np.repeat(np.arange(len(sizes)), np.where(drives, sizes, 0))
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(np.where(drives, sizes, 0)) - np.where(drives, sizes, 0), np.where(drives, sizes, 0))
        mine = offsets[doc] + rank
        near = into[doc] + rank * spread[doc] // np.maximum(sizes[doc], 1)
        place = gallop(ends[mine], near, longer, into[doc], into[doc + 1])
        same = place < into[doc + 1]
        same[same] = longer[place[same]] == ends[mine[same]]
        found.append((mine[same], place[same]))
    (a1, b1), (b2, a2) = found
    at_a, at_b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(at_a, kind="stable")
    return at_a[order], at_b[order]


def summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their times."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, time = np.concatenate(codes), np.concatenate(times)
    if not len(code):
        return code, time
    order = np.argsort(code, kind="stable")
    code, time = code[order], time[order]
    heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[heads], np.add.reduceat(time, heads)


def linked(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, A id, B id) of all pairs within a group, as one number,
    and how often each occurs. Groups follow each other; ``doc`` is each one's text."""
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    links = size_a * size_b
    codes, times = [], []
    plain = np.flatnonzero(links <= WIDE)
    total = np.cumsum(links[plain])
    for part in np.split(plain, np.searchsorted(total, np.arange(SLICE, int(total[-1]) if len(total) else 0, SLICE))):
        n = links[part]
        group = np.repeat(part, n)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        x, y = k // size_b[group], k % size_b[group]
        code = (doc[group] << 40) | (a[start_a[group] + x] << B_BITS) | b[start_b[group] + y]
        code, n = np.unique(code, return_counts=True)
        codes.append(code)
        times.append(n)
    for g in np.flatnonzero(links > WIDE).tolist():
        ids_a, n_a = np.unique(a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
        codes.append(((doc[g] << 40) | (ids_a[:, None] << B_BITS) | ids_b[None, :]).ravel())
        times.append((n_a[:, None] * n_b[None, :]).ravel())
    return summed(codes, times)


def labels(n: int, end: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids with what follows them: a comma, or ``end`` behind the last of a group."""
    width = len(str(n)) + 1
    table = np.array([[str(i).encode() + mark for i in range(n)] for mark in (b",", end)], dtype=f"S{width}")
    return table, np.char.str_len(table[0])


class Aligner:
    """Aligns blocks of texts."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << B_BITS:
            raise ValueError(f"vocabularies of more than {1 << B_BITS} ids are not supported")
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b))
        self.label_a, self.digits_a = labels(len(self.a.bytes), b"|")
        self.label_b, self.digits_b = labels(len(self.b.bytes), b";")

    def tokens(self, texts: list[str]):
        """Ids of both tokenizers, none where a text is empty or its joined bytes are not space and text."""
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        for i, text in enumerate(texts):
            whole = (" " + text).encode()
            if not text or b"".join(map(self.a.bytes.__getitem__, ids_a[i])) != whole or b"".join(map(self.b.bytes.__getitem__, ids_b[i])) != whole:
                ids_a[i], ids_b[i] = [], []
        return ids_a, ids_b

    def align(self, texts: list[str]):
        """Per text (n_a, n_b, n_groups, n_links, groups), and its distinct linked pairs with their times as :func:`linked` has them."""
        ids_a, ids_b = self.tokens(texts)
        docs_a, docs_b = (np.cumsum([0, *map(len, ids)]) for ids in (ids_a, ids_b))
        a, b = (np.fromiter((x for ids in lists for x in ids), np.int64, n) for lists, n in ((ids_a, docs_a[-1]), (ids_b, docs_b[-1])))
        del ids_a, ids_b
        bytes_a, bytes_b = self.size_a[a], self.size_b[b]
        # Ends go on from text to text, as both lists of a text cover the same bytes.
        at_a, at_b = common_ends(np.cumsum(bytes_a), docs_a, np.cumsum(bytes_b), docs_b)
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        doc = np.searchsorted(docs_a, at_a, side="right") - 1
        group_a, group_b = np.repeat(np.arange(len(doc)), size_a), np.repeat(np.arange(len(doc)), size_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        written, lengths = np.empty(len(a) + len(b), dtype=max(self.label_a.dtype, self.label_b.dtype)), np.empty(len(a) + len(b), np.int64)
        for ids, last, table, digits, place in (
            (a, last_a, self.label_a, self.digits_a, np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]),
            (b, last_b, self.label_b, self.digits_b, np.arange(len(b)) + np.cumsum(size_a)[group_b]),
        ):
            written[place], lengths[place] = table[last, ids], digits[ids]
        text = written.tobytes().translate(None, b"\0")
        ends = np.r_[0, np.cumsum(lengths)][docs_a + docs_b].tolist()
        n_groups = np.bincount(doc, minlength=len(texts)).tolist()
        # As whole numbers: a sum of floats would lose the last digits of large products.
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, doc, size_a * size_b)
        rows = [
            (x, y, g, n, text[p : max(p, q - 1)])
            for x, y, g, n, p, q in zip(np.diff(docs_a).tolist(), np.diff(docs_b).tolist(), n_groups, n_links.tolist(), ends, ends[1:])
        ]
        return rows, *linked(a, b, size_a, size_b, doc.astype(np.int64))


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False
) -> DataFrame:
    """Groups of tokens of two tokenizers over the same bytes, and how usual the
    links in them are in the whole corpus.

    A text is encoded by both (paths: the byte-level ranks and the sentence-piece
    model, by default the public ones). Where both have a token's end the text is
    cut, which gives the groups; all A-B pairs in a group are links. A pair of ids
    counts the rows that link it, over all rows.

    Texts are aligned in chunks, one per Arrow batch. A chunk sends each distinct
    pair once, with how many of its rows have it; sums go back the same way, so
    neither a token nor a link is shuffled, and a pair that every text has is one
    row per chunk. Each pair's highest count is one row per A id (at most the
    vocabulary, which is broadcast). A task holds one chunk: texts of one batch or
    a single longer text, and the distinct pairs of its links.

    Null and empty texts, and texts whose joined tokens are not a space and the
    text (some characters are normalised by the pieces), have no tokens: zeros,
    and '' for the digest. Special tokens' strings are ordinary text. Repeated
    rows are rows of their own with equal results; null ids are passed on; empty
    input gives no rows; other columns are not read, whatever their names.

    Returns id, n_a, n_b, n_groups, n_links, n_best (links whose count is the
    highest of their A id), count_sum (over links) and groups_sha256; with
    ``keep_groups`` also ``groups``: ids of A and B, ``a1,a2|b1;a3|b2,b3``."""

    def run(batches):
        from pyspark import TaskContext

        aligner, task = Aligner(path_a, path_b), TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            chunk = (task << 32) | number
            flat, ends = joined_bytes(batch.column("_text"))
            data, ends = flat.tobytes(), ends.tolist()
            rows, codes, times, first = [], [], [], 0
            while first < len(ends) - 1:
                last = first + 1
                while last < len(ends) - 1 and ends[last + 1] - ends[first] <= BLOCK:
                    last += 1
                found, code, n = aligner.align([data[p:q].decode("utf-8", "replace") for p, q in zip(ends[first:last], ends[first + 1 : last + 1])])
                rows += found
                codes.append(code + (first << 40))
                times.append(n)
                first = last
            code, time = np.concatenate([np.zeros(0, np.int64), *codes]), np.concatenate([np.zeros(0, np.int64), *times])
            pairs, refs, n_docs = np.unique(code & ((1 << 40) - 1), return_inverse=True, return_counts=True)
            bounds = np.searchsorted(code >> 40, np.arange(len(rows) + 1))
            cut = lambda x, kind: [x[p:q].astype(kind).tobytes() for p, q in zip(bounds, bounds[1:])]  # noqa: E731, B023
            n, m = len(rows), len(pairs)
            hashes = [hashlib.sha256(r[4]).hexdigest() if r[0] else "" for r in rows]
            none = lambda kind, k: pa.nulls(k, kind)
            texts = pa.array([r[4].decode() for r in rows], pa.string()) if keep_groups else none(pa.string(), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * n, pa.int64()), batch.column("_id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], pa.array(hashes, pa.string()),
                 texts, pa.array(cut(refs, "<u4"), pa.binary()), pa.array(cut(time, "<u8"), pa.binary()), none(pa.int64(), n), none(pa.int64(), n)],
                names=ROW,
            )
            del code, time, codes, times, refs, data
            for p in range(0, m, SLICE):
                q = min(m, p + SLICE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(q - p, chunk)), none(batch.schema.field("_id").type, q - p), *[none(pa.int64(), q - p)] * 4, none(pa.string(), q - p),
                     none(pa.string(), q - p), none(pa.binary(), q - p), none(pa.binary(), q - p), pa.array(pairs[p:q]), pa.array(n_docs[p:q].astype(np.int64))],
                    names=ROW,
                )
            give_back()

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    made = stored(
        narrow.mapInArrow(
            run, f"_chunk bigint, _id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, _refs binary, _times binary, _pair bigint, _n bigint"
        ),
        "aligned",
    )
    pairs = made.where(F.col("_pair").isNotNull()).select("_chunk", "_pair", "_n")
    counts = pairs.groupBy("_pair").agg(F.sum("_n").alias("_count")).withColumn("_a", F.shiftright("_pair", B_BITS))
    highest = counts.groupBy(F.col("_a").alias("_of")).agg(F.max("_count").alias("_most"))
    # One row per A id: no more than the vocabulary has, which is below 1 << B_BITS.
    judged = counts.join(F.broadcast(highest), F.col("_a") == F.col("_of")).select(
        F.col("_pair").alias("_p"), "_count", (F.col("_count") == F.col("_most")).alias("_best")
    )
    replies = pairs.join(judged, F.col("_pair") == F.col("_p")).select(F.col("_chunk").alias("_to"), "_pair", "_count", "_best")
    texts = made.where(F.col("_pair").isNull()).drop("_pair", "_n")

    def total(own, replies):
        replies = replies.sort_by("_pair")
        count, best = replies.column("_count").to_numpy(), replies.column("_best").to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for refs, times in zip(own.column("_refs").to_pylist(), own.column("_times").to_pylist()):
            refs, times = np.frombuffer(refs, "<u4"), np.frombuffer(times, "<u8").astype(np.int64)
            sums.append(int((times * count[refs]).sum()) if len(refs) else 0)
            bests.append(int(times[best[refs]].sum()) if len(refs) else 0)
        out = own.select(["_id", *MEASURES, "groups_sha256", "groups"])
        out = out.append_column("n_best", pa.array(bests, pa.int64()))
        return out.append_column("count_sum", pa.array(sums, pa.int64()))

    done = texts.groupBy("_chunk").cogroup(replies.groupBy("_to")).applyInArrow(
        total, f"_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, n_best bigint, count_sum bigint"
    )
    columns = [*MEASURES, "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else [])]
    return done.select(F.col("_id").alias(id_col), *columns)


MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
ROW = ["_chunk", "_id", *MEASURES, "groups_sha256", "groups", "_refs", "_times", "_pair", "_n"]
