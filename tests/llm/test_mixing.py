from collections import Counter, defaultdict

import pytest

from slim.llm.mixing import entropy, find_exponent, mix_sources, mixture_plan, tempered

SCHEMA = "doc_id long, text string, source string, weight string, block int"


def test_exponent_meets_its_limits():
    totals = [9000, 3000, 500, 100]
    for limit in (1.0, 1.5, 4.0, 30.0):
        w = tempered(totals, find_exponent(totals, limit, None))
        reads = [x / n for x, n in zip(w, totals)]
        assert max(reads) / min(reads) == pytest.approx(limit, rel=1e-9)
    assert find_exponent(totals, 1000.0, None) == 0.0
    for bits in (1.2, 1.5, 1.9):
        assert entropy(tempered(totals, find_exponent(totals, None, bits))) == pytest.approx(bits, abs=1e-9)


@pytest.mark.parametrize("limit,budget,block", [(2.0, None, 1 << 22), (3.0, 900, 300), (1.0, None, 100)])
def test_readings_meet_targets_and_blocks_hold_the_mixture(spark, limit, budget, block):
    rows = [(i, "w " * (i % 17 + 1), "big" if i % 3 else f"s{i % 2}", "x", 1) for i in range(300)]
    rows += [(None, "null id", "s0", None, None), (1, None, None, None, None), (2, "", "s1", "", 0), (9, "same", "big", "", 0), (9, "same", "big", "", 0)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(6), limit, None, budget, block).collect()
    totals = defaultdict(int)
    for _, t, s, *_ in rows:
        totals[s] += len((t or "").split())
    _, plan = mixture_plan(totals, limit, None, budget)
    read, seen = Counter(), Counter()
    for r in got:
        read[r["source"]] += r["n_tokens"]
        seen[r["doc_id"], r["source"], r["row_hash"], r["epoch"]] += 1
    assert set(seen.values()) == {1}
    for s, (_, target) in plan.items():
        assert target - 17 * 2 < read[s] <= target
    full = {s: t // totals[s] if totals[s] else 1 for s, (_, t) in plan.items()}
    per_doc = Counter((r["doc_id"], r["source"], r["row_hash"]) for r in got)
    assert all(full[k[1]] <= n <= full[k[1]] + 1 for k, n in per_doc.items())
    if budget is None:
        assert {(r["doc_id"], r["source"]) for r in got} == {(i, s) for i, _, s, *_ in rows}
    slots = defaultdict(list)
    for r in got:
        slots[r["block"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if len(slots) > 2:
        share = plan["big"][0]
        for b in list(slots)[1:-1]:
            inside = [r for r in got if r["block"] == b]
            assert abs(sum(r["n_tokens"] for r in inside if r["source"] == "big") / sum(r["n_tokens"] for r in inside) - share) < 0.2


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
