"""The registered queries of this subpackage: thin readings of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slim.llm import oracles
from slim.llm.align import align_tokenizers
from slim.llm.counts import edited_counts
from slim.llm.darts import near_duplicates
from slim.llm.hmm import hmm_scores
from slim.llm.licenses import scan_licenses
from slim.llm.mixing import mix_sources
from slim.llm.packing import pack
from slim.llm.prints import edit_fingerprints
from slim.llm.quality import quality_verdicts
from slim.llm.shards import byte_shards
from slim.llm.suffix import remove_repeats
from slim.llm.trie import prefix_trie
from slim.llm.urls import judge_urls

# Verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]

LICENSE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def quality_rules(spark, d):
    return quality_verdicts(_table(spark, d, "documents"))


def repeats_removed(spark, d):
    cut = remove_repeats(_table(spark, d, "documents"), 50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def near_duplicate_classes(spark, d):
    return near_duplicates(_table(spark, d, "documents")).select("doc_id", "class_id", "first", "n_shingles")


def packed_windows(spark, d):
    return pack(_table(spark, d, "documents"), 2048).drop("tokens")


def hidden_markov_scores(spark, d):
    return hmm_scores(_table(spark, d, "documents"))


def byte_balanced_shards(spark, d):
    rows = byte_shards(_table(spark, d, "documents"), 8)
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def edit_aware_counts(spark, d):
    """Three edits of each document: a passage from its beginning replaces ten
    code points, some are deleted before that, and a new end is written."""
    docs = _table(spark, d, "documents")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    edit = lambda start, length, new: F.struct(start.cast("bigint").alias("start"), F.lit(length).cast("bigint").alias("length"), new.alias("new"))
    edits = F.array(
        edit(F.floor(n / 3), 10, F.coalesce(F.substring("text", 1, 30), F.lit(""))),
        edit(F.floor(n / 4), 25, F.lit("")),
        edit(F.greatest(n - 20, F.lit(0)), 20, F.lit("and that's the 2nd end.\n")),
    )
    return edited_counts(docs.withColumn("edits", edits))


def edited_fingerprints(spark, d):
    return edit_fingerprints(_table(spark, d, "documents"))


def mixed_sources(spark, d):
    return mix_sources(_table(spark, d, "documents"), max_repeats=2.0)


def judged_urls(spark, d):
    return judge_urls(_table(spark, d, "pages"), URL_RULES)


def license_notices(spark, d):
    found = scan_licenses(_table(spark, d, "documents"), LICENSE_PHRASES)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    words = F.transform("places", lambda p: p["first_word"])
    base = F.transform("places", lambda p: p["label"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"), "score",
        F.size("spans").cast("bigint").alias("n_spans"),
    )


def conversation_trie(spark, d):
    """Every conversation begins with up to five turns of the first one of its hundred."""
    turns = _table(spark, d, "conversations")
    return prefix_trie(turns, base=lambda c: c - c % 100, kept=lambda c: F.crc32(c.cast("string")) % 6, max_kept=5)


def aligned_tokenizers(spark, d):
    return align_tokenizers(_table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules,
        "op2_repeats_removed": repeats_removed,
        "op3_near_duplicates": near_duplicate_classes,
        "op4_mixture_packing": packed_windows,
        "op5_hidden_markov_scores": hidden_markov_scores,
        "op6_byte_shards": byte_balanced_shards,
        "op7_temperature_mixing": mixed_sources,
        "op8_edit_aware_counts": edit_aware_counts,
        "op9_weighted_fingerprints": edited_fingerprints,
        "op10_url_verdicts": judged_urls,
        "op11_license_notices": license_notices,
        "op12_conversation_trie": conversation_trie,
        "op13_aligned_tokenizers": aligned_tokenizers,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
