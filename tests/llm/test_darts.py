import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from slim.llm.common import joined_bytes
from slim.llm.darts import dart_signatures, near_duplicates, shingles, word_hashes
from slim.llm.graph import components

SCHEMA = "doc_id long, text string, node string, label int, class_id string"


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sets = [brute_set(t) for _, t in rows]
    for i, (_, t) in enumerate(rows):
        for j in range(i):
            if t is not None and rows[j][1] is not None and (t == rows[j][1] or (sets[i] and jaccard(sets[i], sets[j]) >= 0.8)):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], rows[i][1], min(ids, default=None)) for i in members]
    return out


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return w

    docs = [text(rng.choice([3, 6, 40, 200, 900])) for _ in range(60)]
    for base in docs[:12]:
        docs += [edited(base, max(1, len(base) // 100)) for _ in range(4)]
    chain = text(300)
    for _ in range(25):
        chain = edited(chain, 5)
        docs.append(chain)
    star = text(250)
    docs += [edited(star, 5) for _ in range(30)]
    docs += [["rep"] * 300, ["rep"] * 320, ["rep"] * 40, docs[0], docs[20]]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    rows += [(900, None), (901, None), (902, ""), (903, ""), (904, " \n"), (None, rows[5][1]), (None, "only here five words are"), (3, rows[9][1]), (9, rows[9][1]), (905, "a\x0bb\tc  d\r\ne"), (906, "a b c d e")]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [rows[i] for i in order]


def test_classes_match_brute_force(spark):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(6)).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r["doc_id"], r["class_id"]) for r in got], key=key) == sorted([(i, c) for i, _, c in brute_classes(rows)], key=key)
    firsts = Counter(r["class_id"] for r in got if r["first"] and r["class_id"] is not None)
    assert set(firsts) == {r["class_id"] for r in got if r["class_id"] is not None}
    assert sum(firsts.values()) - len(firsts) <= 2  # a repeated row is twice the first


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(2)
    k = 4096
    for scale in (1.0, 7.3):
        weights = rng.integers(0, 4, (2, 60)) * rng.random((2, 60)) * scale
        owner, element = np.nonzero(weights)
        sig = dart_signatures(owner, element.astype(np.uint64) * np.uint64(977), weights[owner, element], 3, k)
        want = np.minimum(*weights).sum() / np.maximum(*weights).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k) + 0.005
        assert not sig[2].any()


def test_words_and_shingles_of_bytes():
    texts = ["a b c d e a b c d e f", None, "", "  x\ty ", "é é ß\x85ß z z z z z z z", "tail"]
    flat, offsets = joined_bytes(pa.array(texts))
    h, doc = word_hashes(flat, offsets)
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    owner, _, count = shingles(flat, offsets)
    for i, t in enumerate(texts):
        assert sorted(count[owner == i].tolist()) == sorted(brute_set(t).values())


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 70)] + [(200, 100), (100, 150), (300, 301)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}
