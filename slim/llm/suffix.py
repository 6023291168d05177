"""Exact removal of repeated substrings by a distributed merge sort of suffixes.

A string of ``length`` bytes contains ``length - GRAM + 1`` grams of GRAM bytes.
The least of their hashes picks the string's anchor, so equal strings have their
anchors at equal places. The suffixes that are sorted start at anchors, about
one in sixteen bytes: all strings that share an anchor form one item, its key is
the text to the right of the anchor and, reversed, the text to its left.

1. Runs (some MB of documents) exchange sorted hashes of their anchors' grams and
   get back which of them another document has. Others cannot repeat.
2. Runs sort the keys of what is left, merge equal ones, and send them front-coded
   to key ranges. There a loser tree merges the runs; a stream's place in it is
   its common prefix with the last key given out, so only bytes beyond known
   prefixes are compared. Each key gets back, for each of its strings, the
   smallest document that has it.
3. Runs read the answers in the order of their keys and cut their documents.
"""

from __future__ import annotations

import uuid
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slim.llm.common import bound_batches, give_back, joined_bytes, mix64, shared_base

GRAM = 20
BLOCK = 1 << 18  # strings looked at together, below 2 ** 24
LAST = np.iinfo(np.int64).max  # a null id comes after all others


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=np.uint64(0))
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every position on."""
    base = np.uint64(0x9E3779B97F4A7C15)
    one = flat.astype(np.uint64) + np.uint64(1)

    def double(h, width):
        return h[: len(h) - width] * base**np.uint64(width) + h[width:]

    two = double(one, 1)
    four = double(two, 2)
    sixteen = double(double(four, 4), 8)
    n = len(flat) - GRAM + 1
    return mix64(sixteen[:n] * base ** np.uint64(4) + four[16 : 16 + n])


def items(flat: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, first and last string start, document index and gram hash of every
    item; strings do not cross documents."""
    reach, found = length - GRAM + 1, []
    for begin in range(0, max(0, len(flat) - length + 1), BLOCK):
        part = flat[begin : begin + BLOCK + length - 1]
        hashes = gram_hashes(part)
        low = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width * 2 <= reach:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if width < reach:
            low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(begin, begin + len(anchor))
        doc = np.searchsorted(offsets, start, side="right") - 1
        inside = np.flatnonzero(start + length <= offsets[doc + 1])
        if not len(inside):
            continue
        anchor, start, doc = anchor[inside], start[inside], doc[inside]
        new = np.flatnonzero(np.diff(anchor, prepend=-1) | np.diff(doc, prepend=-1))
        end = np.append(new[1:], len(anchor)) - 1
        # Least hashes are small ones; scrambled again they fill all parts alike.
        found.append((anchor[new] + begin, start[new], start[end], doc[new], mix64(hashes[anchor[new]] + np.uint64(1))))
    if not found:
        return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found))


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, first places in sorted order, and that order."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.diff(ranked, prepend=ranked[:1] + np.uint64(1)) if len(ranked) else ranked)
    return ranked[first], first, order


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def keys_of(flat, offsets, length, found, state):
    """Sorted distinct keys of the items that may repeat, and each item's key.

    A key is: kind, text from the anchor on, reversed text before it, how long
    that is, and how long the first is; both texts padded. An item with a gram
    that is hot everywhere is dealt as its single strings (kind 1), which
    need no class of their own to meet in."""
    anchor, first, last, doc, _ = (x[state > 0] for x in found)
    hot = state[state > 0] == 2
    if hot.any():
        many = np.where(hot, last - first + 1, 1)
        at = np.repeat(np.arange(len(anchor)), many)
        step = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        split = hot[at]
        first, last = np.where(split, first[at] + step, first[at]), np.where(split, first[at] + step, last[at])
        anchor, doc, hot = anchor[at], doc[at], split
    left, right = anchor - first, last + length - anchor
    lefts = length - GRAM
    width = length + lefts + 3
    n = len(anchor)
    matrix = np.zeros((n, width), np.uint8)
    padded = np.concatenate([np.zeros(lefts, np.uint8), flat, np.zeros(length, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, length + lefts)[anchor]
    matrix[:, 1 : 1 + length] = around[:, lefts:] * (np.arange(length) < right[:, None])
    matrix[:, 1 + length : 1 + length + lefts] = around[:, :lefts][:, ::-1] * (np.arange(lefts) < left[:, None])
    matrix[:, 0], matrix[:, -2], matrix[:, -1] = hot, left, right
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{width}").ravel(), kind="stable")
    matrix = matrix[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (matrix[1:] != matrix[:-1]).any(axis=1)
    of_item = np.empty(n, np.int64)
    of_item[order] = np.cumsum(fresh) - 1
    return matrix[fresh], of_item, anchor, doc


def ranges(matrix: np.ndarray, splitters: np.ndarray, parts: int) -> np.ndarray:
    """Key range of each key; single strings of hot grams go by hash."""
    prefix = np.ascontiguousarray(matrix[:, : GRAM + 1]).view(f"S{GRAM + 1}").ravel()
    by_range = np.searchsorted(splitters, prefix, side="right")
    single = matrix[:, 0] == 1
    if single.any():
        folded = np.zeros(int(single.sum()), np.uint64)
        for column in matrix[single].T:
            folded = mix64(folded + column.astype(np.uint64) + np.uint64(1))
        by_range[single] = part_of(folded, parts)
    return by_range


class LoserTree:
    """Merges sorted front-coded streams; ``pop`` gives (stream, key, common
    prefix with the key before). ``known[i]`` is the common prefix of stream i's
    key with the last key given out: of two candidates the one with the longer
    is smaller, and with equal ones comparison starts behind it."""

    def __init__(self, streams):
        self.streams = streams
        k = self.size = max(1, len(streams))
        self.key, self.known = [None] * k, [-1] * k
        self.node = [0] * k
        for i in range(len(streams)):
            self._advance(i)
        winners = [0] * k + list(range(k))
        for j in range(k - 1, 0, -1):
            winners[j], self.node[j] = self._play(winners[2 * j], winners[2 * j + 1])
        self.top = winners[1] if k > 1 else 0

    def _advance(self, i):
        step = next(self.streams[i], None)
        if step is None:
            self.key[i], self.known[i] = None, -1
        else:
            self.known[i], tail = step
            self.key[i] = self.key[i][: self.known[i]] + tail if self.key[i] else tail

    def _play(self, a, b):
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        known = self.known
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y, n = self.key[a], self.key[b], known[a]
        if x is None:
            return a, b
        if x == y:
            known[b] = len(x)
            return a, b
        while x[n] == y[n]:
            n += 1
        if x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def __iter__(self):
        node, size = self.node, self.size
        while self.key[self.top] is not None:
            i = self.top
            yield i, self.key[i], self.known[i]
            self._advance(i)
            j = (i + size) >> 1
            while j:
                i, node[j] = self._play(i, node[j])
                j >>= 1
            self.top = i


def front_code(matrix: np.ndarray, docs: np.ndarray) -> bytes:
    n, width = matrix.shape
    common = np.zeros(n, np.uint8)
    common[1:] = (matrix[1:] != matrix[:-1]).argmax(axis=1)
    tails = matrix[np.arange(width) >= common[:, None]]
    return squeeze(np.array([n, width], "<i8").tobytes() + common.tobytes() + docs.astype("<i8").tobytes() + tails.tobytes())


def front_decode(data: bytes):
    """Smallest documents of the keys, and the stream of (common prefix, tail)."""
    raw = unsqueeze(data)
    n, width = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16 + 9 * n

    def stream(at=at):
        for common in raw[16 : 16 + n]:
            yield common, raw[at : at + width - common]
            at += width - common

    return np.frombuffer(raw, "<i8", n, 16 + n).tolist(), stream()


def resolve(blobs: list[bytes], length: int) -> list[bytes]:
    """The answers of one key range: per run and key, runs of strings (places of
    the anchor, from and to) and the smallest document that has them."""
    docs, streams = zip(*map(front_decode, blobs)) if blobs else ((), ())
    next_doc = [iter(d).__next__ for d in docs]
    counts, spans, owners = [bytearray() for _ in blobs], [bytearray() for _ in blobs], [array("q") for _ in blobs]
    group = []  # of the class: [key, smallest document, streams that have it]

    def answer(run, found):
        counts[run].append(len(found))
        for low, high, owner in found:
            spans[run] += bytes((low, high))
            owners[run].append(owner)

    def close():
        if len(group) == 1:
            key, owner, runs = group[0]
            found = [(length - key[-1], key[-2], owner)]
            for run in runs:
                answer(run, found)
        else:
            least = {}
            for key, owner, _ in group:
                for o in range(length - key[-1], key[-2] + 1):
                    string = o, key[1 : 1 + length - o], key[1 + length : 1 + length + o]
                    if least.get(string, LAST) >= owner:
                        least[string] = owner
            for key, _, runs in group:
                found = []
                for o in range(length - key[-1], key[-2] + 1):
                    owner = least[o, key[1 : 1 + length - o], key[1 + length : 1 + length + o]]
                    if found and found[-1][2] == owner:
                        found[-1] = found[-1][0], o, owner
                    else:
                        found.append((o, o, owner))
                for run in runs:
                    answer(run, found)
        group.clear()

    for run, key, common in LoserTree(list(streams)):
        owner = next_doc[run]()
        if common == len(key):
            group[-1][2].append(run)
            group[-1][1] = min(group[-1][1], owner)
            continue
        if group and (common <= GRAM or key[0]):
            close()
        group.append([key, owner, [run]])
    if group:
        close()
    return [squeeze(len(c).to_bytes(8, "little") + bytes(c) + bytes(s) + np.array(o, "<i8").tobytes()) for c, s, o in zip(counts, spans, owners)]


def read_answers(data: bytes):
    raw = unsqueeze(data)
    n = int.from_bytes(raw[:8], "little")
    count = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    total = int(count.sum())
    spans = np.frombuffer(raw, np.uint8, 2 * total, 8 + n).reshape(-1, 2).astype(np.int64)
    return count, spans, np.frombuffer(raw, "<i8", total, 8 + n + 2 * total)


class Run:
    """One run's documents, as stored."""

    def __init__(self, row, id_col, length):
        self.meta = pa.ipc.open_stream(row["meta"]).read_all()
        self.flat = np.frombuffer(unsqueeze(row["data"]), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], "<i8"))])
        self.ids = self.meta.column(id_col).cast(pa.int64()).fill_null(LAST).to_numpy()
        self.length = length
        self.found = items(self.flat, self.offsets, length)

    def keys(self, shared: pd.DataFrame):
        """Its keys and items, given which of its grams others have."""
        hashes, first, order = grouped(self.found[4])
        state = np.frombuffer(b"".join(unsqueeze(x) for x in shared.sort_values("part")["data"]), np.uint8)
        each = np.repeat(state, np.diff(np.append(first, len(order))))
        of_item = np.empty(len(order), np.uint8)
        of_item[order] = each
        return keys_of(self.flat, self.offsets, self.length, self.found, of_item)


def remove_repeats(
    docs: DataFrame, length: int = 50, carry: list[str] | None = None, as_text: bool = False, run_bytes: int = 1 << 23,
    hot: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Remove every byte of a document that is covered by a string of ``length``
    bytes which also starts in a document with a smaller id.

    All strings of all whole texts count, overlapping ones too, judged on the
    input. Null text is empty; texts under ``length`` bytes keep everything. A
    null id counts as the largest. Rows with the same id do not remove from each
    other, but each loses what smaller ids have. Empty input gives no rows.
    ``length`` is between GRAM + 1 and 255 - GRAM.

    A gram that occurs more than ``hot`` times is dealt as single strings. Runs
    hold about ``run_bytes``, or one longer document. What meets in one task is
    bounded by the number of runs and distinct contexts, not by copies: runs
    merge equal keys before they are sent.

    Returns the id, the columns in ``carry``, n_bytes, spans (array of start and
    length in bytes, maximal runs that were removed) and kept (the other bytes;
    with ``as_text`` a string without the halves of cut characters)."""
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    carried = [id_col, *[c for c in carry or [] if c != id_col]]
    path = f"{shared_base(spark)}/llm/runs-{uuid.uuid4().hex}"
    schema = "run bigint, part int, meta binary, sizes binary, data binary, kind int"
    names = ["run", "part", "meta", "sizes", "data", "kind"]

    def split(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            flat, offsets = joined_bytes(batch.column("_text"))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + run_bytes, side="right")) - 1)
                own, own_offsets = flat[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema.remove(batch.schema.get_field_index("_text"))) as writer:
                    writer.write_batch(batch.slice(begin, end - begin).drop_columns(["_text"]))
                rows = [(number, 0, sink.getvalue().to_pybytes(), np.diff(own_offsets).astype("<i8").tobytes(), squeeze(own.tobytes()), 0)]
                anchor, _, _, doc, hashes = items(own, own_offsets, length)
                distinct, first, order = grouped(hashes)
                if len(order):
                    last = np.append(first[1:], len(order)) - 1
                    many = doc[order[first]] != doc[order[last]]  # the order is stable, so documents ascend
                    count = (last - first + 1).astype("<u4")
                    cuts = np.searchsorted(part_of(distinct, parts), np.arange(parts + 1))
                    for p in np.flatnonzero(np.diff(cuts)).tolist():
                        piece = slice(cuts[p], cuts[p + 1])
                        rows.append((number, p, None, squeeze(many[piece].astype(np.uint8).tobytes() + count[piece].tobytes()), pack_sorted(distinct[piece]), 1))
                    pick = np.linspace(0, len(anchor) - 1, min(len(anchor), 256)).astype(np.int64)
                    sample = np.lib.stride_tricks.sliding_window_view(own, GRAM)[anchor[pick]]
                    rows.append((number, 0, None, None, sample.tobytes(), 2))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=ARROW)
                number, begin = number + 1, end
            give_back()

    narrow = docs.select(*carried, F.col(text_col).alias("_text"))
    narrow.mapInArrow(split, schema).write.partitionBy("kind").parquet(path)
    kept = spark.read.schema(schema).parquet(path)
    runs = kept.where("kind = 0").select("run", "meta", "sizes", "data")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        packed = [unpack_sorted(x) for x in rows["data"]]
        notes = [unsqueeze(x) for x in rows["sizes"]]
        hashes = np.concatenate(packed)
        many = np.concatenate([np.frombuffer(x, np.uint8, len(h)) for x, h in zip(notes, packed)])
        count = np.concatenate([np.frombuffer(x, "<u4", len(h), len(h)) for x, h in zip(notes, packed)])
        _, first, order = grouped(hashes)
        sizes = np.diff(np.append(first, len(order)))
        total = np.add.reduceat(count[order].astype(np.int64), first)
        shared = (sizes > 1) | (np.add.reduceat(many[order], first, dtype=np.int64) > 0)
        state = np.empty(len(order), np.uint8)
        state[order] = np.repeat(np.where(shared, np.where(total > hot, 2, 1), 0).astype(np.uint8), sizes)
        cuts = np.cumsum([0, *map(len, packed)])
        data = [squeeze(state[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        give_back()
        return pd.DataFrame({"run": rows["run"], "part": rows["part"], "data": data, "kind": 1})

    reply = "run bigint, part int, data binary, kind int"
    shared = kept.where("kind = 1").groupBy("part").applyInPandas(compare, reply)
    shared_path = f"{path}-shared"
    shared.write.parquet(shared_path)
    shared = spark.read.schema(reply).parquet(shared_path)
    samples = kept.where("kind = 2").orderBy(F.xxhash64("run")).limit(1000).select("data").collect()
    grams = np.sort(np.frombuffer(b"".join(bytes(r["data"]) for r in samples), f"S{GRAM}"))
    picks = grams[(np.arange(1, parts) * len(grams)) // parts] if len(grams) else grams
    splitters = np.array([b"\0" + bytes(x).ljust(GRAM, b"\0") for x in np.unique(picks)], f"S{GRAM + 1}")

    def sort(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(replies):
            run = Run(rows.iloc[0], id_col, length)
            matrix, of_item, _, doc = run.keys(replies)
            owner = np.full(len(matrix), LAST)
            np.minimum.at(owner, of_item, run.ids[doc])
            part = ranges(matrix, splitters, parts)
            for p in np.unique(part).tolist():
                out.append((rows["run"].iloc[0], p, front_code(matrix[part == p], owner[part == p]), 2))
        give_back()
        return pd.DataFrame(out, columns=["run", "part", "data", "kind"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run": rows["run"], "part": rows["part"], "data": resolve(rows["data"].tolist(), length), "kind": 2})

    coded = runs.groupBy("run").cogroup(shared.groupBy("run")).applyInPandas(sort, reply)
    answers = coded.groupBy("part").applyInPandas(merge, reply)
    fields = [docs.schema[c] for c in carried]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    out_schema = T.StructType(
        [*fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    )

    def cut(key, rows: pa.Table, replies: pa.Table) -> pa.Table:
        run, replies = Run(rows.to_pylist()[0], id_col, length), replies.to_pandas()
        covered = np.zeros(len(run.flat) + 1, np.int32)
        answered = replies[replies["kind"] == 2].sort_values("part")
        if len(answered):
            matrix, of_item, anchor, doc = run.keys(replies[replies["kind"] == 1])
            read = [read_answers(x) for x in answered["data"]]
            count, spans, owners = (np.concatenate(c) for c in zip(*read))
            place = np.empty(len(matrix), np.int64)
            place[np.argsort(ranges(matrix, splitters, parts), kind="stable")] = np.arange(len(matrix))
            first, entry = np.cumsum(count) - count, place[of_item]
            many = count[entry]
            item = np.repeat(np.arange(len(entry)), many)
            at = np.repeat(first[entry], many) + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
            hit = owners[at] < run.ids[doc[item]]
            item, at = item[hit], at[hit]
            np.add.at(covered, anchor[item] - spans[at, 1], 1)
            np.add.at(covered, anchor[item] - spans[at, 0] + length, -1)
        gone = np.cumsum(covered[:-1]) > 0
        removed, keep = [], []
        for a, b in zip(run.offsets.tolist(), run.offsets[1:].tolist()):
            edges = np.flatnonzero(np.diff(gone[a:b].view(np.int8), prepend=np.int8(0), append=np.int8(0))).reshape(-1, 2)
            removed.append([{"start": x, "length": y - x} for x, y in edges.tolist()])
            left = run.flat[a:b][~gone[a:b]].tobytes() if len(edges) else run.flat[a:b].tobytes()
            keep.append(left.decode("utf-8", "ignore") if as_text else left)
        columns = [*run.meta.columns, pa.array(np.diff(run.offsets), pa.int64()), pa.array(removed, SPANS), pa.array(keep, pa.string() if as_text else pa.binary())]
        give_back()
        return pa.table(columns, names=out_schema.names)

    both = shared.unionByName(answers)
    return runs.groupBy("run").cogroup(both.groupBy("run")).applyInArrow(cut, out_schema)


ARROW = pa.schema([("run", pa.int64()), ("part", pa.int32()), ("meta", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("kind", pa.int32())])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
