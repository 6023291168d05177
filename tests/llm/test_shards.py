import zlib

from slim.llm.shards import byte_shards

SCHEMA = "doc_id long, text string, size string, shard string"


def expected(rows, n):
    """Brute force: (id, crc, size) in order, each in the shard of its middle byte."""
    items = sorted(((r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    total, at, slots, out = sum(x[2] for x in items), 0, [0] * n, []
    for i, crc, size in items:
        shard = min(n - 1, (2 * at + size) * n // (2 * total))
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    return out


def test_shards_match_brute_force(spark):
    rows = [(i * 7 % 101, "é" * (i % 13) if i % 11 else None, "x", "y") for i in range(100)]
    rows += [(None, "no id", "", ""), (None, None, "", ""), (5, "", "", ""), (5, "same", "", ""), (5, "same", "", ""), (3, "long " * 400, "", "")]
    got = byte_shards(spark.createDataFrame(rows, SCHEMA).repartition(7), 4)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    key = lambda x: (x[0] is not None, *[v or 0 for v in x])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows, 4), key=key)


def test_empty_table(spark):
    assert byte_shards(spark.createDataFrame([], SCHEMA)).count() == 0
