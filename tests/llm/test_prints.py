import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from slim.llm.prints import both_prints, edit_fingerprints, fingerprints, phrases, weighted_samples

SCHEMA = "doc_id long, text string, fingerprint string, _id int, n_chars string"


def test_edits_and_prints(spark):
    words = ["ab", "cé", "dog", "tree", "mint,", "x", "ß"]
    rows = [(i * 3 % 41, " ".join(words[(i * k) % 7] + str(k % (i + 2)) for k in range(i * 7))) for i in range(41)]
    rows += [(None, "null id text here"), (50, None), (51, ""), (52, "abc"), (7, "same id other text"), (7, "same id other text"), (60, "x " * 4000), (61, " \n")]
    got = edit_fingerprints(spark.createDataFrame([(*r, "c", 1, "z") for r in rows], SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    known = {}
    for r in rows:
        known.setdefault((r[0] is not None, r[0] or 0), set()).add(r[1])
    alone = sorted(k for k, v in known.items() if len(v) == 1)
    order = sorted(known)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    prints = {}
    for k in alone:
        (text,) = known[k]
        text = text or ""
        (r, *more) = by_id[k[1] if k[0] else None]
        assert all(x == r for x in more) and r["n_chars"] == len(text)
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_next"] <= 1
        after = order[(order.index(k) + 1) % len(order)]
        if len(known[after]) == 1:
            m, (tail,) = len(text) // 4, known[after]
            edited = text[: len(text) - m] + (tail or "")[:m]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    same = lambda a, b: np.mean([a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)])
    assert all(abs(r["near_edited"] - same(r["fingerprint"], r["edited_fingerprint"])) < 1e-9 for r in got)
    assert edit_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collision_rate_is_generalised_jaccard(spark):
    a = " ".join(["one,"] * 5 + ["two,"] * 2 + ["six,"] + [f"w{i}," for i in range(20)])
    b = " ".join(["one,"] * 2 + ["two,"] * 6 + [f"w{i}," for i in range(8, 26)])
    frame = spark.createDataFrame([(i, form, t.replace("w", f"w{i}-")) for i in range(16) for form, t in enumerate([a, b])] + [(99, 0, "")], "i int, form int, t string")
    parts = [Counter(t.split(" ")) for t in (a, b)]
    want = sum((parts[0] & parts[1]).values()) / sum((parts[0] | parts[1]).values())
    got = {(r["i"], r["form"]): np.array(r["_print"]) for r in fingerprints(frame, ["i", "form"], "t", 24).collect()}
    rate = np.mean([(got[i, 0] == got[i, 1]).mean() for i in range(16)])
    assert abs(rate - want) < 4 * np.sqrt(want * (1 - want) / 300)  # words that all pairs have make them less than independent
    assert not got[99, 0].any()


def test_samples_equal_numpy(spark):
    """Values of r, c, b, t and a by definition from the same hashes, with real weights."""
    rng = np.random.default_rng(1)
    rows = [(i, j, float(w)) for i in range(6) for j, w in enumerate(np.r_[1.0, 1.0, rng.gamma(0.5, 4, 30), 1e-6, 1e6])] + [(7, 1, 0.0), (7, 2, -1.0), (7, 3, None)]
    frame = spark.createDataFrame(rows, "i int, _j int, _w double").withColumn("_h", F.xxhash64("_j"))
    samples = 4
    got = {r["i"]: [r[f"_s{k}"] & 0xFFFF for k in range(samples)] for r in weighted_samples(frame, ["i"], samples).collect()}
    assert set(got) == set(range(6))
    for k in range(samples):
        u = F.xxhash64(F.lit(k), "_h")
        best = {}
        for r in frame.where("_w > 0").select("i", "_w", u.alias("u"), F.xxhash64(u).alias("v"), F.xxhash64(F.xxhash64(u)).alias("z")).collect():
            part = lambda h, shift: (((h >> shift) & ((1 << 26) - 1)) + 0.5) / (1 << 26)
            gamma = -np.log(part(r["u"], 0) * part(r["u"], 32))
            c, beta = -np.log(part(r["v"], 0) * part(r["v"], 32)), part(r["z"], 0)
            t = int(np.floor(np.log(r["_w"]) / gamma + beta))
            y = np.exp(gamma * (t - beta))
            a = c / (y * np.exp(gamma))
            name = ((r["z"] >> 48) & 0xFFFF) ^ ((t * 40503) & 0xFFFF)
            best[r["i"]] = min(best.get(r["i"], (np.inf, 0)), (a, name))
        assert {i: n for i, (_, n) in best.items()} == {i: s[k] for i, s in got.items()}


def test_collision_rate_of_real_weights(spark):
    rng = np.random.default_rng(2)
    a, b = rng.gamma(0.7, 3, (2, 40)) * (rng.random((2, 40)) < 0.8)
    rows = [(i, form, i * 100 + j, float(w)) for i in range(120) for form, ws in enumerate((a, b)) for j, w in enumerate(ws)]
    frame = spark.createDataFrame(rows, "i int, form int, _j int, _w double").withColumn("_h", F.xxhash64("_j"))
    got = {(r["i"], r["form"]): [r[f"_s{k}"] & 0xFFFF for k in range(8)] for r in weighted_samples(frame, ["i", "form"], 8).collect()}
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    rate = np.mean([x == y for i in range(120) for x, y in zip(got[i, 0], got[i, 1])])
    assert abs(rate - want) < 4 * np.sqrt(want * (1 - want) / 960)


def test_shared_draws_equal_single_ones(spark):
    """A pair of texts gets the prints that each gets alone."""
    rows = [(1, "a b c c d", "a b c e"), (2, "", "x"), (3, "y y", ""), (4, "", ""), (5, "one two", "two one"), (6, "p " * 300 + "q", "p " * 299 + "q r")]
    frame = spark.createDataFrame(rows, "i int, t string, u string")
    got = {r["i"]: (r["_own"], r["_new"]) for r in both_prints(frame, ["i"], ["t", "u"], 8).collect()}
    alone = [{r["i"]: r["_print"] for r in fingerprints(frame, ["i"], c, 8).collect()} for c in ("t", "u")]
    assert got == {i: (alone[0][i], alone[1][i]) for i, *_ in rows}


def test_main_path_is_native(spark):
    plan = edit_fingerprints(spark.createDataFrame([(1, "a", "", 1, "")], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_word_counts_in_any_script(spark):
    """Texts whose words end in none of a few letters keep the likeness of their
    words when a quarter of them changes."""
    letters = {"upper": "BCDFGHK", "digits": "0123456", "cyrillic": "бвгджзк", "symbols": ")}];:_#"}
    rows = []
    for kind, ends in letters.items():
        own = [f"{ends[i % 7]}{i}{ends[i % 5]}" for i in range(80)]
        rows += [(kind, 0, " ".join(own)), (kind, 1, "\t".join(own[:60] + [x * 2 for x in own[60:]]))]
    han = "".join(chr(0x4E00 + i) for i in range(80))
    rows += [("han", 0, han), ("han", 1, han[:60] + "".join(chr(0x5E00 + i) for i in range(20)))]
    frame = spark.createDataFrame(rows, "kind string, i int, t string")
    assert {r["n"] for r in frame.select(F.size(phrases(F.col("t"))).alias("n")).collect()} == {80}
    got = {(r["kind"], r["i"]): np.array(r["_print"]) for r in fingerprints(frame, ["kind", "i"], "t", 32).collect()}
    for kind in [*letters, "han"]:
        assert abs((got[kind, 0] == got[kind, 1]).mean() - 0.6) < 4 * np.sqrt(0.24 / 32), kind


def test_terms_are_words_and_letters_of_unspaced_scripts(spark):
    texts = {"Ab  c\tAb ": ["Ab", "c", "Ab"], "x漢字 y。": ["x", "漢", "字", "y。"], "\u3000ไท\u3000": ["ไ", "ท"], "𠀀𠀁b": ["𠀀", "𠀁", "b"], " ": [], "": [], "\u3000": ["\u3000"]}
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", phrases(F.col("t")).alias("p"))
    assert {r["t"]: r["p"] for r in frame.collect()} == {**texts, None: []}
