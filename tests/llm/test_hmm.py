import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from slim.llm import hmm
from slim.llm.hmm import Sequences, expected_counts, hmm_scores, log_likelihoods

SCHEMA = "doc_id long, text string, chunk string, score int, ids string"


def test_forward_and_counts_match_plain_recursion():
    rng = np.random.default_rng(3)
    k, m = 3, 7
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k).T
    lengths = np.array([1, 5, hmm.SEGMENT, hmm.SEGMENT + 1, 3 * hmm.SEGMENT + 17])
    classes = rng.integers(0, m, lengths.sum())
    got = log_likelihoods(Sequences(classes, lengths), len(lengths), start, move, emit)
    counts = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
    expected_counts(Sequences(classes, lengths), start, move, emit, counts)
    want, at = (np.zeros(k), np.zeros((k, k)), np.zeros((m, k))), 0
    for d, n in enumerate(lengths):
        own, at = classes[at : at + n], at + n
        a, total = start * emit[own[0]], 0.0
        for c in own[1:]:
            total += math.log(a.sum())
            a = (a / a.sum()) @ move * emit[c]
        assert got[d] == pytest.approx(total + math.log(a.sum()), rel=1e-9)
        for s in range(0, n, hmm.SEGMENT):
            piece = own[s : s + hmm.SEGMENT]
            f = [start * emit[piece[0]]]
            for c in piece[1:]:
                f.append(f[-1] @ move * emit[c])
            b = [np.ones(k)]
            for c in piece[:0:-1]:
                b.insert(0, move @ (emit[c] * b[0]))
            p = f[-1].sum()
            for t, c in enumerate(piece):
                want[2][c] += f[t] * b[t] / p
                if t:
                    want[1][:] += np.outer(f[t - 1], emit[c] * b[t]) * move / p
            if s == 0:
                want[0][:] += f[0] * b[0] / p
    for x, y in zip(counts, want):
        assert np.allclose(x, y, rtol=1e-6)


def test_bytes_are_read_as_letters():
    for word in ("é", "aé", "éa", "日本", "x日", "日x", "👍🏽", "a👍", "ab", "b", "xé\u0301", "naïve", "\x1c\x85\xa0"):
        assert hmm.last_letters(word.encode()) == word[-2:].encode()
    text = "Ä\x1cB c\x0bD\x0cE\u2003F\x85G\xa0H İ\rJ\x00K"
    plain = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert text.encode().lower().split() == [w.encode() for w in plain]


def test_first_segments_are_followed_once():
    # Rare classes on end: scaling now and then is enough, and only later segments need a table per state.
    rng = np.random.default_rng(4)
    k, m = 4, 5
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), np.full((m, k), 1e-18)
    emit[0] = 1 - emit[1:].sum(axis=0)
    lengths = np.array([40, 0, 3, hmm.SEGMENT, 2 * hmm.SEGMENT + 7])
    classes = rng.integers(1, m, lengths.sum())
    seq = Sequences(classes, lengths)
    for t in range(len(seq.active)):
        assert len(seq.step(t)) == seq.active[t]
    assert len(hmm.followed(seq, np.flatnonzero(seq.nth == 0), [start], move.T.copy(), emit.T.copy())[0]) == 1
    # Equal emissions in all states: the states do not matter.
    assert np.allclose(log_likelihoods(seq, len(lengths), start, move, emit), lengths * math.log(1e-18), rtol=1e-9)


def test_base_scores_and_model(spark):
    rng = random.Random(5)
    tongues = [[f"{a}{b}{c}" for a in x for b in x for c in y] for x, y in (("aeiou", "st"), ("bdfgk", "xz"))]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(rng.choice([3, 30, 400])))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, "NEW Words Here"), (None, "aet bdx"), (503, "É e\x0bf\tG  h\n"), (7, "AET aet"), (7, "AET aet")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)] += 1
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    for frequent, chunk_bytes in ((4096, 1 << 23), (20, 500)):
        got = hmm_scores(df, states=4, frequent=frequent, classes=64, chunk_bytes=chunk_bytes).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        test = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
        assert all(r["score"] < 0 for r in got)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hmm_scores(df).count() == 0
    alone = spark.createDataFrame([(None, "only held out")], "doc_id long, text string")
    assert [r["n_known"] for r in hmm_scores(alone).collect()] == [0]
