import random
import re
from collections import Counter

import numpy as np
import pytest

from slim.llm import quality
from slim.llm.quality import BINS, BINS_PER_UNIT, CONSISTENCY, COORDINATES, CUTOFF, PART, SCALE, quality_verdicts

SCHEMA = "doc_id long, text string, lang string, source string, kept string, n_words int"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def vector(s):
    n, chars, symbols, dups, rep, _ = s
    return [np.log(n + 1), np.log((chars + 200) / (n + 40)), np.log1p(1000 * symbols / (chars + 100)), np.log1p(dups), rep / (n + 20)]


def mcd(x, steps):
    """Brute force: the same estimate with numpy."""
    floors = np.array([f for *_, f in COORDINATES]) * SCALE
    low = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    y = np.floor(x / 10 + 0.5)
    med = low(y)
    m, c = med * 10, np.diag((low(np.abs(y - med)) * 10 * 1.4826) ** 2 + floors**2)
    d2 = lambda: (np.linalg.solve(np.linalg.cholesky(c), (x - m).T) ** 2).sum(axis=0)
    for _ in range(steps):
        bins = np.minimum(BINS, np.floor(np.minimum(d2(), BINS) * BINS_PER_UNIT))
        edge = np.sort(bins)[int(np.ceil(len(x) * PART)) - 1]
        near = x[bins <= edge]
        m, c = near.mean(axis=0), np.cov(near.T, bias=True) * CONSISTENCY + np.diag(floors**2)
    return d2()


def texts(rng, n, lang):
    syll = {"en": ["the", "of", "tion", "er", "an"], "de": ["der", "keit", "ung", "ch", "ein"]}[lang]
    for _ in range(n):
        k = int(np.exp(rng.gauss(4.5, 0.8))) + 12
        yield " ".join("".join(rng.choices(syll, k=rng.randint(1, 4))) + ("\n" if rng.random() < 0.05 else "") for _ in range(k))


def test_verdicts_match_brute_force(spark):
    rng, rows = random.Random(1), []
    for lang, source, n in (("en", "a", 150), ("en", "b", 60), ("de", "a", 70), ("de", "c", 20), ("de", None, 40), (None, "a", 5)):
        rows += [(t, lang, source) for t in texts(rng, n, lang or "en")]
    junk = ["# $ % & | < > * " * 30 + " ".join(f"w{i}" for i in range(40)), "x" * 40000 + " a b c d e f g h i j k"]
    rows += [(j, "en", "a") for j in junk] + [(None, "en", "a"), ("", "de", "a"), ("a b\n\na b\n a b\n\x0b", "en", "b"), ("one two three four five six " * 20, "de", "c"), ("same text of ten words and more is here twice " * 1, "en", "a")]
    rows = [(i, *r, "clash", 1) for i, r in enumerate(rows)] + [(None, rows[0][0], "en", "a", None, None), (0, *rows[0], "clash", 1)]
    got = {r["row_hash"] if r["doc_id"] is None else r["doc_id"]: r for r in quality_verdicts(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert quality_verdicts(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    want = {i: base(t) for i, t, *_ in rows}
    groups = {}
    for i, t, lang, source, *_ in rows:
        if not want[i][5]:
            groups.setdefault((lang, source), []).append(i)
    for key in [k for k, v in groups.items() if len(v) < 50]:
        groups.setdefault((key[0],), []).extend(groups.pop(key))
    far = {}
    for key, ids in groups.items():
        if len(ids) >= 50:
            x = np.array([np.floor(np.array(vector(want[i])) * SCALE + 0.5) for i in ids])
            far |= dict(zip(ids, mcd(x, 4)))
    for i, s in want.items():
        if i is None:
            continue
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == s, i
        if s[5]:
            assert not r["kept"]
        elif i in far:
            assert r["distance"] == pytest.approx(far[i], rel=1e-6)
            assert r["kept"] == (far[i] <= CUTOFF)
        else:
            assert r["kept"] and r["distance"] is None
    first = len(rows) - 9
    assert not got[first]["kept"] and not got[first + 1]["kept"]
    assert sum(not r["kept"] for r in got.values()) < 12


def test_empty_table(spark):
    assert quality_verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_is_native(spark):
    plan = quality_verdicts(spark.createDataFrame([(1, "a", "en", "s", None, 0)], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and quality.DIM == 5
