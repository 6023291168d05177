from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_darts import brute_classes
from test_suffix import brute
from tokenizers import Tokenizer

import corpus_pipeline as cp
from slim.llm.mixing import mix_sources
from slim.llm.packing import pack
from slim.llm.quality import quality_verdicts

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    assert df.columns == cp.COLUMNS
    return [tuple(r) for r in df.collect()]


def test_each_stage_on_its_own_input(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    docs += [(None, docs[3][1], "en", None, 5), (400, None, None, "src1", None), (401, "", "en", "src1", 0), docs[5], (402, docs[7][1] + " more", "en", "src2", 9)]
    frame = lambda rows: spark.createDataFrame(rows, schema).repartition(4)

    verdict = Counter((r["doc_id"], r["n_words"]) for r in quality_verdicts(frame(docs)).where("kept").collect())
    kept = rows_of(cp.quality_rules(spark, frame(docs), FOLDER))
    assert Counter((r[0], len((r[1] or "").split())) for r in kept) == verdict and not Counter(kept) - Counter(docs)

    extra = [*kept, (400, None, None, "src1", None), kept[0]]
    single = rows_of(cp.near_dedup(spark, frame(extra), FOLDER))
    classes = brute_classes([(r[0], r[1]) for r in extra])
    want = {c for _, t, c in classes if t is not None}
    assert sorted(r[0] for r in single if r[1] is not None and r[0] is not None) == sorted(c for c in want if c is not None)
    assert sum(r[1] is None for r in single) == 1

    cut = rows_of(cp.suffix_dedup(spark, frame(single), FOLDER))
    after = {i: k.decode("utf-8", "ignore") for i, _, _, k in brute([(r[0], r[1]) for r in single], 50)}
    assert {r[0]: r[1] for r in cut} == after and all(r[4] == len(r[1]) for r in cut)
    assert {(r[0], r[2], r[3]) for r in cut} == {(r[0], r[2], r[3]) for r in single}

    mixed = rows_of(cp.mix(spark, frame(cut), FOLDER))
    plan = Counter(r["doc_id"] for r in mix_sources(frame(cut), max_repeats=cp.MAX_REPEATS).collect())
    assert Counter(r[0] for r in mixed) == plan and set(mixed) == set(cut)

    pieces = cp.packed(spark, frame(mixed), FOLDER).collect()
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {r[0]: len(tk.encode(r[1], add_special_tokens=False).ids) + 1 for r in mixed}
    total = Counter()
    for p in pieces:
        assert p["doc_tokens"] == size[p["doc_id"]]
        total[p["doc_id"]] += p["length"]
    assert total == {i: size[i] * n for i, n in plan.items()}


def test_whole_run(spark):
    pieces = cp.run(spark, FOLDER).collect()
    windows = defaultdict(int)
    for p in pieces:
        windows[p["sequence_id"]] += p["length"]
    sizes = np.array([windows[i] for i in sorted(windows)])
    assert sorted(windows) == list(range(len(windows))) and (sizes[:-1] == 2048).all()
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
