import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slim.llm import align as module
from slim.llm.align import Aligner, align_tokenizers, common_ends, gallop, linked

SCHEMA = "doc_id long, text string, n_a string, groups int, _chunk int"


def byte_table():
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
CHARS = byte_table()


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def brute_groups(text):
    """By definition: groups of (A ids, B ids) between offsets that end a token of both."""
    if not text:
        return []
    whole = (" " + text).encode()
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    parts_a = [bytes(CHARS[c] for c in A.id_to_token(i)) for i in ids_a]
    parts_b = [b_bytes(i) for i in ids_b]
    if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return []
    ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
    groups, before = [], 0
    for end in sorted({*ends_a} & {*ends_b}):
        groups.append(([i for i, e in zip(ids_a, ends_a) if before < e <= end], [i for i, e in zip(ids_b, ends_b) if before < e <= end]))
        before = end
    return groups


def brute(texts):
    all_groups = [brute_groups(t) for t in texts]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in all_groups]
    counts = Counter(p for own in links for p in own)
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(n, highest.get(x, 0))
    rows = []
    for groups, own in zip(all_groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()),
            sum(n for p, n in own.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "", text,
        ))
    return rows


TEXTS = [
    None, "", " ", "a", "\n\n", "<|endoftext|> and <s> or </s>", "x▁y", "½ ﬁ Å", "日本語のテキスト", "данные и слова", "😀😀 👩‍👩‍👧", "\x00\x01", "a" * 3000, "ab" * 2500,
    "Thtion be, esaned that thntwhre.", "  indented\n    code = {1: 2}\t\r\n", "naïve café — “quoted”", "0123456789" * 40, "é" * 500,
]


def corpus():
    rng = random.Random(5)
    words = ["the", "tion", "Thntwhre", "été", "данные", "12345", "foo_bar()", "\n", "😀", "http://a.b/c?d=1", "aaaaaaaaaaaaaaaaaaaaaaaa", "日本"]
    made = [" ".join(rng.choice(words) + rng.choice(["", ",", "s", "."]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return TEXTS + made + made[:7] + ["long text of words, " * 500]


def test_alignment_matches_brute_force(spark):
    texts = corpus()
    rows = [(i if i % 40 else None, t, "clash", 1, 2) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)  # several chunks in a task
    try:
        got = align_tokenizers(spark.createDataFrame(rows, SCHEMA).repartition(3), keep_groups=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = [(r[0], *b) for r, b in zip(rows, brute(texts))]
    assert sorted(((r["doc_id"], *[r[n] for n in names]) for r in got), key=key) == sorted(want, key=key)


def test_shape_and_empty_table(spark):
    empty = align_tokenizers(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and empty.count() == 0
    none = align_tokenizers(spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string")).collect()
    assert sorted(map(tuple, none)) == [("a", 0, 0, 0, 0, 0, 0, ""), ("b", 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(texts):
    rows, codes, times = ALIGNER.align(texts)
    want = brute(texts)
    assert [(*r[:4], r[4].decode()) for r in rows] == [(*w[:4], w[7]) for w in want]
    assert int(times.sum()) == sum(w[3] for w in want) and len(set(codes.tolist())) == len(codes)


ALIGNER = Aligner()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), max_size=5), st.randoms())
def test_galloping_intersection(lists, rng):
    a, b = [sorted(x) for x, _ in lists], [sorted(y) for _, y in lists]
    flat = lambda xs: np.array([x for own in xs for x in own], dtype=np.int64)
    offsets = lambda xs: np.cumsum([0, *map(len, xs)])
    at_a, at_b = common_ends(flat(a), offsets(a), flat(b), offsets(b))
    want = [(p, q) for i in range(len(lists)) for p in range(offsets(a)[i], offsets(a)[i + 1]) for q in range(offsets(b)[i], offsets(b)[i + 1]) if flat(a)[p] == flat(b)[q]]
    assert list(zip(at_a.tolist(), at_b.tolist())) == want
    for longer in (flat(a), flat(b)):
        longer = np.unique(longer)
        keys = np.arange(0, 62)
        near = np.array([rng.randrange(-3, 70) for _ in keys])
        found = gallop(keys, near, longer, np.zeros_like(keys), np.full_like(keys, len(longer)))
        assert found.tolist() == np.searchsorted(longer, keys).tolist()


def test_wide_groups_and_slices(monkeypatch):
    rng = np.random.default_rng(1)
    size_a, size_b = rng.integers(1, 30, 50), rng.integers(1, 30, 50)
    a, b, doc = rng.integers(0, 9, size_a.sum()), rng.integers(0, 9, size_b.sum()), np.sort(rng.integers(0, 4, 50))
    want = linked(a, b, size_a, size_b, doc)
    for wide, part in ((10, 1 << 20), (1 << 20, 64), (100, 200)):
        monkeypatch.setattr(module, "WIDE", wide)
        monkeypatch.setattr(module, "SLICE", part)
        got = linked(a, b, size_a, size_b, doc)
        assert all((x == y).all() for x, y in zip(got, want))
    assert int(want[1].sum()) == int((size_a * size_b).sum())
