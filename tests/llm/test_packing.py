import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from slim.llm.packing import CYCLE, deal, pack, plan_phases

SCHEMA = "doc_id long, text string, source string, start string, tokens int"


def rows():
    texts = ["", None, "plain words here", "a\n\n  b\tc", "Ünïcödé ñandú 123 's", "end <|endoftext|> inside", "x" * 3000, "long text and more " * 900]
    out = [(i, texts[i % len(texts)] if i % 9 else f"document {i} " * (i % 40), "big" if i % 3 else f"s{i % 4}", "clash", 7) for i in range(120)]
    return out + [(None, "null id", None, None, None), (7, "twice", None, None, None), (7, "twice", None, None, None)]


def test_pieces_rebuild_every_document_and_fill_windows(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for targets in (None, {"big": 0.5, "s0": 0.5}, {"s3": 1.0}):
        got = pack(spark.createDataFrame(rows(), SCHEMA).repartition(5), 64, targets).collect()
        want = defaultdict(int)
        for i, t, s, *_ in rows():
            want[i, s, tuple([*tk.encode(t or "", add_special_tokens=False).ids, 1])] += 1
        docs, windows = defaultdict(list), defaultdict(list)
        for r in got:
            ids = np.frombuffer(r["tokens"], "<u4")
            assert len(ids) == r["length"] > 0 and zlib.crc32(r["tokens"]) == r["ids_crc32"]
            docs[r["doc_id"], r["source"], r["doc_tokens"]].append((r["start"], tuple(ids)))
            windows[r["sequence_id"]].append((r["offset"], r["length"], r["source"]))
        have = defaultdict(int)
        for (i, s, n), pieces in docs.items():
            pieces.sort()
            copies = len(pieces) // len({p[0] for p in pieces}) if i != 7 else 1
            if i != 7:
                assert copies == 1
                at, ids = 0, []
                for start, piece in pieces:
                    assert start == at
                    at, ids = at + len(piece), ids + [*piece]
                assert at == n
                have[i, s, tuple(ids)] += 1
        assert {k: v for k, v in have.items()} == {k: v for k, v in want.items() if k[0] != 7}
        last = max(windows)
        assert sorted(windows) == list(range(last + 1))
        for w, pieces in windows.items():
            at = 0
            for offset, length, _ in sorted(pieces):
                assert offset == at
                at += length
            assert at == 64 or w == last
        if targets is None:
            total = sum(n for p in windows.values() for _, n, _ in p)
            share = sum(n for p in windows.values() for _, n, s in p if s == "big") / total
            for w, pieces in windows.items():
                if w < last - 8:
                    assert abs(sum(n for _, n, s in pieces if s == "big") - share * 64) < 2


def test_deficits_settle_in_a_cycle():
    for dealt in ([CYCLE * 64], [CYCLE * 63, CYCLE], [CYCLE * 64 - 3, 1, 1, 1], [*range(300), CYCLE * 64 - sum(range(300))]):
        given = deal(dealt, 64)
        assert (np.diff(given, axis=0) >= 0).all() and (np.diff(given.sum(axis=1)) == 64).all()
        quota = np.arange(CYCLE + 1)[:, None] * np.array(dealt) / CYCLE
        if min(dealt) >= CYCLE:
            assert np.abs(given - quota).max() < 1
    assert plan_phases([], [], 64) == []


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
