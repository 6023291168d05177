import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slim.llm import trie as module
from slim.llm.trie import PRIME, Powers, bases, power, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, _k1 int, _len int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def signed(d):
    return [int.from_bytes(d[8 * k : 8 * k + 8], "big", signed=True) for k in range(4)]


def brute(rows):
    """By definition, with whole texts as keys."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0, signed(digest(role, text))), (role, text)))
    turns = {c: [t for _, t in sorted(own)] for c, own in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = (*turns.get(c - c % 100, [])[:h], *own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        here = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = here + sum(saved[k] for k in children[node])
    joined = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), len(children[node]), leaves[node], saved[node], joined(ends[node]))
        for node, own in members.items()
    )


def run(spark, rows, parts=4):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = prefix_trie(frame, base=lambda c: c - c % 100, kept=lambda c: F.crc32(c.cast("string")) % 6, max_kept=5)
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got.collect())


def corpus(seed=1):
    rng, rows = random.Random(seed), []
    texts = ["hi", "hello", "", None, "été 😀", "a longer answer", "x" * 50]
    for c in [*range(0, 40), *range(100, 140), *range(250, 290), 300, 301, 700]:
        for t in range(rng.randrange(0, 9)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(texts), "clash", 1, 2))
    rows += [rows[5], rows[5], rows[9]]  # repeated rows
    rows += [(None, 0, "user", "of no conversation", None, None, None), (305, None, None, None, None, None, None), (399, 3, "r", "long " * 20_000, None, None, None)]
    rows += [(c, 0, "user", "same first turn", None, None, None) for c in range(400, 480)]
    rows += [(c, 1, "assistant", f"answer {c % 7}", None, None, None) for c in range(400, 480, 2)]
    return rows


@pytest.mark.parametrize("heavy", [1000, 3])
def test_matches_brute_force(spark, monkeypatch, heavy):
    """With few heavy keys both ways of the joins are taken."""
    monkeypatch.setattr(module, "HEAVY", heavy)
    rows = corpus(heavy)
    assert run(spark, rows, 5) == brute(rows)


def test_long_conversation_over_many_partitions(spark):
    """One conversation holds most rows and spans partitions, others begin with it."""
    rng = random.Random(2)
    rows = [(500, t, "user", rng.choice(["a", "bc", "def"]), None, None, None) for t in range(400)]
    rows += [(c, t, "user", rng.choice(["a", "bc"]), None, None, None) for c in range(501, 520) for t in range(rng.randrange(1, 9))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows, 7) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_collisions_are_found_and_mended(spark, monkeypatch):
    """A multiplier of one forgets the order of turns; the groups fail and others are taken."""
    good, asked = module.bases, []

    def weak(seed):
        asked.append(seed)
        return [1] * 4 if seed == 0 else good(seed)

    monkeypatch.setattr(module, "bases", weak)
    rows = [(c, t, "u", f"{(c % 3 + t) % 7}", None, None, None) for c in range(30) for t in range(7)]
    assert run(spark, rows) == brute(rows)
    assert max(asked) == 1


def test_empty_and_rootless(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b", None, None, None)]) == []
    one = [(7, 0, None, None, None, None, None)]
    assert run(spark, one) == brute(one)


def test_powers(spark):
    p, n = Powers(bases(3)), np.array([0, 1, 5, 4095, 4096, 70_000, 4096 * 9])
    for k, b in enumerate(bases(3)):
        assert p.of(k, n).tolist() == [pow(b, int(x), PRIME) for x in n]
    frame = spark.createDataFrame([(int(x),) for x in [*n, 123_456_789_012]], "n long")
    assert [r[0] for r in frame.select(power(F.col("n"), 48271)).collect()] == [pow(48271, int(x), PRIME) for x in [*n, 123_456_789_012]]
