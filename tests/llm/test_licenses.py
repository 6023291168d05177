import random
import re

import regex

from slim.llm.licenses import NOTICES, Notice, Scanner, merged, pieces, scan_licenses

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
SCHEMA = "doc_id long, text string, places string, label string, score int"


def words_of(text):
    folded = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_places(words):
    hits = []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return sorted(hits)


def brute_spans(words, notices=NOTICES):
    """The patterns over the whole text, without seeds or windows."""
    text, out = " " + " ".join(words) + " ", []
    for n in notices:
        for m in regex.finditer(f"(?e)(?:{regex.escape(n.text)}){{e<={n.edits}}}", text):
            a, z = m.start() + (text[m.start()] == " "), m.end() - (text[m.end() - 1] == " ")
            a, z = text.rfind(" ", 0, a + 1) + 1, text.find(" ", z)
            if m.group().strip(" ") and all(c in text[a:z].split(" ") for c in n.core):
                out.append((n.label, n.text, text[a:z], text.count(" ", 0, a) - 1, sum(m.fuzzy_counts)))
    return sorted(out)


def least_edits(pattern, text):
    """Sellers: the fewest edits that turn the pattern into some part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, s, k):
    for _ in range(k):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abc xé") + s[i:], s[:i] + rng.choice("abc xé") + s[i + 1 :]])
    return s


def corpus():
    rng = random.Random(7)
    vocabulary = ["the", "license", "under", "mit", "cc", "by", "nc", "version", "2", "general", "public", "gnu", "rights", "all", "été", "данные", "word"]
    texts = [None, "", " \n.,;", "MIT", "Under the MIT license", "cc BY-NC cc by nc cc by nc 4.0", "xcc by nc", "cc by ncx", "cc by\x00nc", " cc by nc", "cc by nc",
             "Released under the MTI License", "Relesed under teh MIT Licence.", "Licenced under the Apache Licence, Version 1.0", "Licensed undr the Apache License Version 2.0",
             "GNU General Public License, version 30", "GNU Generl Public License, version 3", "all rights reservd all rights reserved al right reserved"]
    for _ in range(120):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            n = rng.choice(NOTICES)
            parts.insert(rng.randrange(len(parts) + 1), edited(rng, n.text, rng.randrange(n.edits + 3)))
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    return [*texts, "lorem ipsum " * 5_000 + "released undr the mit license", texts[-1], texts[-2]]


def test_scan_matches_brute_force(spark):
    texts = corpus()
    rows = [(i if i % 50 else None, t, "clash", "clash", 1) for i, t in enumerate(texts)]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3), PHRASES).collect()
    assert len(got) == len(rows)

    def key(i, words, places, spans, score):
        return (i is not None, i or 0, words, places, spans, score)

    have = sorted(
        key(r["doc_id"], r["n_words"], sorted((p["first_word"], p["label"]) for p in r["places"]),
            sorted((s["label"], s["notice"], s["found"], s["first_word"], s["edits"]) for s in r["spans"]), round(r["score"], 9)) for r in got
    )
    want = []
    for i, text, *_ in rows:
        words = words_of(text)
        places, spans = brute_places(words), brute_spans(words)
        allowed = {n.text: n.edits + 1 for n in NOTICES}
        score = 1.0 if places else max((1 - s[4] / allowed[s[1]] for s in spans), default=0.0)
        want.append(key(i, len(words), places, spans, round(score, 9)))
    assert have == sorted(want)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_seeds_lose_no_match():
    """A notice is found exactly where the edit distance to some part of the text allows it."""
    rng = random.Random(3)
    notices = (Notice("a", "all rights reserved", 2), Notice("b", "released under the mit license", 3))
    scanner = Scanner(notices, {})
    found = 0
    for _ in range(300):
        n = rng.choice(notices)
        words = edited(rng, f"some words {n.text} and more all the rights", rng.randrange(6)).split()
        _, spans = scanner.scan([w.encode() for w in words])
        for n in notices:
            near = least_edits(n.text, " " + " ".join(words) + " ") <= n.edits
            assert near == any(s[1] == n.text for s in spans), (words, n)
            found += near
    assert found > 100


def test_pieces_cover_the_notice():
    for n in NOTICES:
        parts = pieces(n)
        assert len(parts) == n.edits + 1 and "".join(p for _, p in parts) == n.text
        assert all(n.text[o : o + len(p)] == p and len(p) > 4 for o, p in parts)
    assert merged([[5, 9], [0, 3], [3, 4], [8, 12]]) == [[0, 4], [5, 12]]


def test_clean_texts_and_empty_table(spark):
    clean = ["The general public had rights to all of it.", "A version of two licenses under review.", "He was under the bit lice."]
    got = scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(clean)], "doc_id string, text string"), PHRASES).collect()
    assert all(not r["places"] and not r["spans"] and r["score"] == 0 for r in got)
    assert scan_licenses(spark.createDataFrame([], SCHEMA), PHRASES).count() == 0
    assert scan_licenses(spark.createDataFrame([(1, "cc by nc")], "doc_id long, text string"), {}, ()).collect()[0]["spans"] == []
