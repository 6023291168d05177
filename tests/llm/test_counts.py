import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slim.llm.counts import CountTree, counters, edited_counts, with_edits

SCHEMA = "doc_id long, text string, n_tokens string, _text int"
SPLIT, COUNT = counters()
CHARS = st.text(alphabet="ab's re \n\t 12.,é ß　", max_size=12)


def tokens(text):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    return len(tk.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(CHARS, max_size=30).map("".join), st.lists(st.tuples(st.integers(0, 200), st.integers(0, 40), CHARS), max_size=6))
def test_tree_matches_full_split(text, edits):
    tree = CountTree(text, SPLIT, COUNT)
    for start, length, new in edits:
        tree.edit(start, length, new)
        start = min(start, len(text))
        text = text[:start] + new + text[start + length :]
        pieces = [p for own, _ in tree.leaves for p in own]
        assert pieces == SPLIT.findall(text)
        assert tree.n_chars == len(text) and tree.n_tokens == sum(map(COUNT, pieces))


def test_counts_match_tokenizer(spark):
    rng = random.Random(2)
    texts = ["", None, "a", " \n ", "word " * 4000, "x" * 5000, "don't we'll <|endoftext|> 12 é" * 30]
    texts += ["".join(rng.choice(["the ", "tion", "é", "\n", "  ", "12", "'s", "!?"]) for _ in range(rng.randint(1, 900))) for _ in range(30)]
    rows, edits, after = [], [], {}
    for i, t in enumerate(texts):
        rows.append((i, t, "c", 1))
        now = t or ""
        for seq in range(i % 5):
            start, length, new = rng.randint(0, len(now) + 5), rng.randint(0, 50), rng.choice([None, "", " new", "'s\n", "long new text " * 90])
            edits.append((i, seq, start, length, new))
            at = min(start, len(now))
            now = now[:at] + (new or "") + now[at + length :]
        after[i] = now
    docs = spark.createDataFrame([*rows, (None, "no id", None, None)], SCHEMA)
    table = spark.createDataFrame([*edits, (999, 0, 0, 0, "x")], "doc_id long, seq int, start long, length long, new string").repartition(3)
    got = {r["doc_id"]: r for r in edited_counts(with_edits(docs, table)).collect()}
    assert len(got) == len(rows) + 1 and got[None]["n_tokens"] == tokens("no id") == got[None]["edited_tokens"]
    for i, t, *_ in rows:
        assert (got[i]["n_tokens"], got[i]["edited_tokens"], got[i]["edited_chars"]) == (tokens(t or ""), tokens(after[i]), len(after[i])), i
    few = CountTree("word " * 4000, SPLIT, COUNT)
    few.encoded = 0
    few.edit(10_000, 3, "new")
    assert few.encoded < 12
    assert edited_counts(with_edits(docs.limit(0), table)).count() == 0
