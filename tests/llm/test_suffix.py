import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slim.llm.suffix import LoserTree, remove_repeats

SCHEMA = "doc_id long, text string, spans string, kept int, source string"


def brute(rows, length):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            first[s] = min(first.get(s, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, text in rows:
        data, own = (text or "").encode(), (1 << 63) - 1 if i is None else i
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < own:
                gone[p : p + length] = b"\1" * length
        spans, p = [], 0
        while p < len(data):
            q = p
            while q < len(data) and gone[q]:
                q += 1
            if q > p:
                spans.append((p, q - p))
            p = max(q, p + 1)
        out.append((i, len(data), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "tion", "éa", "and ", "ß", "in", "x"]
    base = lambda n: "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(n))
    passages = [base(40) for _ in range(4)]
    rows = [(i, base(rng.randint(0, 60)) + rng.choice(["", *passages]) + base(rng.randint(0, 40)) + rng.choice(["", *passages])) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 20, 3)]
    rows += [(200 + i, rows[i][1][: len(rows[i][1]) // 2] + "!" + rows[i][1][len(rows[i][1]) // 2 :]) for i in range(0, 30, 4)]
    rows += [(300, "a" * 400), (301, "a" * 120), (302, "ab" * 100), (303, "xab" + "ab" * 60), (304, None), (305, ""), (306, "a" * 50), (307, "a" * 49)]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (7, rows[3][1]), (7, rows[8][1]), (400, "\0" * 130), (401, "\0" * 77 + "z" * 60), (402, "\0" * 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot,run_bytes", [(1 << 17, 1 << 24), (1, 700), (6, 3000)])
def test_removal_matches_brute_force(spark, hot, run_bytes):
    rows = corpus(hot)
    df = spark.createDataFrame([(*r, "clash", 1, f"s{j % 3}") for j, r in enumerate(rows)], SCHEMA).repartition(5)
    got = remove_repeats(df, 50, carry=["source"], hot=hot, run_bytes=run_bytes).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    have = sorted([(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got], key=key)
    assert have == sorted(brute(rows, 50), key=key)
    assert {r["source"] for r in got} == {"s0", "s1", "s2"}


def test_text_form_and_empty_table(spark):
    df = spark.createDataFrame([(1, "é" * 60, None, 0, None), (2, "zé" + "é" * 40, None, 0, None)], SCHEMA)
    assert {r["doc_id"]: r["kept"] for r in remove_repeats(df, as_text=True).collect()} == {1: "é" * 60, 2: "z"}
    assert remove_repeats(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=4, max_size=4), max_size=12), max_size=7))
def test_loser_tree_merges_front_coded_streams(streams):
    def coded(keys):
        before = b""
        for key in sorted(keys):
            n = next((i for i in range(len(before)) if before[i] != key[i]), len(before))
            yield n, key[n:]
            before = key

    got = list(LoserTree([coded(s) for s in streams]))
    assert [k for _, k, _ in got] == sorted(k for s in streams for k in s)
    for (_, a, _), (_, b, n) in zip(got, got[1:]):
        assert a[:n] == b[:n] and (n == 4 or a[n] != b[n])
