"""Edit-aware token counts over segment trees of pre-tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slim.llm.common import bound_batches
from slim.llm.tokens import ranks_path

LEAF = 64  # pre-tokens of a fresh leaf; one of four times as many is split
LOOK = 3  # code points past its end that can decide where a pre-token ends
MEMO = 1 << 18  # pre-tokens whose counts a task remembers


def counters(path: str | None = None):
    """The pre-token splitter, and a count of one pre-token's ids."""
    import base64

    import public_tokenizers
    import regex
    import tiktoken

    with open(path or ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    memo: dict[str, int] = {}

    def count(piece: str) -> int:
        n = memo.get(piece)
        if n is None:
            if len(memo) >= MEMO:
                memo.clear()
            n = memo[piece] = len(bpe.encode_ordinary(piece))
        return n

    return regex.compile(public_tokenizers.PATTERN), count


class CountTree:
    """A document's pre-tokens in leaves, and above them, in a binary tree, how
    many code points and tokens each subtree holds."""

    def __init__(self, text: str, split, count):
        self.split, self.count, self.encoded = split, count, 0
        pieces = split.findall(text)
        self._build(pieces, self._counts(pieces))

    def _counts(self, pieces):
        self.encoded += len(pieces)
        return [self.count(p) for p in pieces]

    def _build(self, pieces, counts):
        self.leaves = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (own, n) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, own)), sum(n)
        for j in range(self.size - 1, 0, -1):
            self._sum(j)

    def _sum(self, j):
        self.chars[j] = self.chars[2 * j] + self.chars[2 * j + 1]
        self.tokens[j] = self.tokens[2 * j] + self.tokens[2 * j + 1]

    def _put(self, i, pieces, counts):
        self.leaves[i] = pieces, counts
        j = self.size + i
        self.chars[j], self.tokens[j] = sum(map(len, pieces)), sum(counts)
        while j > 1:
            j >>= 1
            self._sum(j)

    def _find(self, at):
        """The leaf that holds code point ``at`` (the last one behind the end), and where it begins."""
        j, begin = 1, 0
        while j < self.size:
            j *= 2
            if at >= begin + self.chars[j] and self.chars[j + 1]:
                begin, j = begin + self.chars[j], j + 1
        return min(j - self.size, len(self.leaves) - 1), begin

    @property
    def n_chars(self):
        return self.chars[1]

    @property
    def n_tokens(self):
        return self.tokens[1]

    def edit(self, start: int, length: int, new: str):
        """Replace ``length`` code points from ``start`` on by ``new``; ranges
        are clipped to the text. Pre-tokens are split again from the one LOOK
        code points before the edit to the first old boundary behind it."""
        start = min(max(start, 0), self.n_chars)
        stop = min(start + max(length, 0), self.n_chars)
        first, begin = self._find(max(0, start - LOOK))
        pieces, counts = [], []
        last = first
        for last in range(first, len(self.leaves)):
            pieces += self.leaves[last][0]
            counts += self.leaves[last][1]
            reach = begin + sum(map(len, pieces)) if last == first else reach + self.chars[self.size + last]
            if reach > stop + LOOK:
                found = self._resplit(pieces, counts, begin, start, stop, new, last + 1 == len(self.leaves))
                if found:
                    break
        else:
            found = self._resplit(pieces, counts, begin, start, stop, new, True)
        if len(found[0]) > 4 * LEAF:
            before, after = self.leaves[:first], self.leaves[last + 1 :]
            self._build(
                [p for own, _ in before for p in own] + found[0] + [p for own, _ in after for p in own],
                [n for _, own in before for n in own] + found[1] + [n for _, own in after for n in own],
            )
            return
        self._put(first, *found)
        for i in range(first + 1, last + 1):
            self._put(i, [], [])

    def _resplit(self, pieces, counts, begin, start, stop, new, whole):
        """Pieces and counts of the touched leaves after the edit; None if no
        old boundary is met within them and more text follows."""
        at, k = begin, 0
        while k < len(pieces) and at + len(pieces[k]) + LOOK <= start:
            at += len(pieces[k])
            k += 1
        old = "".join(pieces[k:])
        text = old[: start - at] + new + old[stop - at :]
        boundaries, p = {}, at
        shift = at - (len(new) - (stop - start))  # place in the new text -> place in the old document
        for i in range(k, len(pieces)):
            if p >= stop:
                boundaries[p] = i
            p += len(pieces[i])
        boundaries[p] = len(pieces)
        fresh, q = [], 0
        while q < len(text) or (q == 0 and not text):
            if q >= start - at + len(new) and shift + q in boundaries:
                break
            if not text:
                break
            m = self.split.match(text, q)
            if not whole and m.end() + LOOK > len(text):
                return None
            fresh.append(m.group())
            q = m.end()
        i = boundaries.get(shift + q, len(pieces)) if q >= start - at + len(new) else len(pieces)
        return pieces[:k] + fresh + pieces[i:], counts[:k] + self._counts(fresh) + counts[i:]


def edited_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """Token counts of each text before and after its edits.

    ``edits`` is an array of (start, length, new) in code points, applied in
    order, each to what the ones before left; null means none, a null ``new``
    deletes, and ranges are clipped to the text. A text is split and encoded
    once into a tree; an edit encodes only the pre-tokens it touches and those
    next to it, and updates the sums above them. Null text is empty; empty texts
    have no tokens. Marks of special tokens are ordinary text. Repeated rows
    give repeated results, null ids are passed on; empty input gives no rows;
    other columns are not read. A row needs nothing but itself.

    Returns id, n_tokens, n_pretokens, edited_chars, edited_tokens, and
    reencoded (pre-tokens encoded for all edits)."""

    def run(batches):
        split, count = counters(path)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column("_text").to_pylist(), batch.column("_edits").to_pylist()):
                tree = CountTree(text or "", split, count)
                first, pretokens = tree.n_tokens, tree.encoded
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["length"] or 0, e["new"] or "")
                out.append((first, pretokens, tree.n_chars, tree.n_tokens, tree.encoded - pretokens))
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names=["_id", *COUNTS])

    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(edits_col).alias("_edits"))
    return narrow.mapInArrow(run, f"_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)).withColumnRenamed("_id", id_col)


COUNTS = ["n_tokens", "n_pretokens", "edited_chars", "edited_tokens", "reencoded"]


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``edits`` from a table (id, seq, start, length, new);
    documents without edits get null, edits without a document are left out."""
    own = edits.groupBy(F.col(id_col).alias("_eid")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "new"))).alias("_all"))
    steps = F.transform("_all", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["new"].alias("new")))
    return docs.join(own, F.col(id_col).eqNullSafe(F.col("_eid")), "left").withColumn("edits", steps).drop("_eid", "_all")
