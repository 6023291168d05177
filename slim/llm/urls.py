"""URL verdicts: list rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ["length", "depth", "digit_ratio", "entropy", "n_params", "host_labels", "host_length", "suffix_rate", "suffix_count"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as its text; null if none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in longest_first]
    return F.coalesce(*[F.when(ok, F.lit(h + p)) for ok, (_, h, p) in zip(fits, longest_first)], F.lit(None).cast("string"))


def char_entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a + F.when(c != "", -share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need no statistics; of a null url those of an empty one."""
    u = F.coalesce(url, F.lit(""))
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return {
        "length": F.length(u).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "digit_ratio": F.when(F.length(u) > 0, digits / F.length(u)).otherwise(0.0),
        "entropy": char_entropy(u),
        "n_params": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
        "host_labels": F.regexp_count(host, F.lit("[^.]+")).cast("double"),
        "host_length": F.length(host).cast("double"),
    }


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], sample_rows: int = 20_000, trees: int = 12, depth: int = 4,
    seed: int = 0, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """Allow or block every url. Where rules (verdict, host, path) fit, the
    longest decides; these urls are also the labelled ones. The others get the
    verdict of gradient-boosted trees on lexical features: length, depth, digit
    ratio, entropy, parameter count, host shape, and of the host's last two
    labels how many labelled urls have them and which part of those is blocked.

    Suffix statistics cover all labelled urls, less the url itself when it is
    one. The trees are fitted on at most ``sample_rows`` labelled urls, those
    first in hash order. If all labels agree, they are the verdict; without
    labels it is allow. Null urls and urls without ``://`` have empty host and
    path and are judged like others. Equal urls get equal verdicts. Empty input
    gives no rows; other columns are not read.

    Returns id, host, path, rule, verdict, score (block margin; null where a rule decides)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    verdicts = {h + p: v for v, h, p in rules}
    parts = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumns(
        {"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))}
    )
    ruled = parts.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules)).withColumn(
        "_blocked", F.coalesce(*[F.when(F.col("_rule") == r, F.lit(float(v == "block"))) for r, v in verdicts.items()], F.lit(None).cast("double"))
    )
    plain = ruled.withColumns({k: v for k, v in lexical(F.col("_url"), F.col("_host"), F.col("_path")).items()}).withColumn("_suffix", suffix_of(F.col("_host")))
    known = plain.where(F.col("_blocked").isNotNull())
    by_suffix = known.groupBy(F.col("_suffix").alias("_s")).agg(F.count(F.lit(1)).alias("_seen"), F.sum("_blocked").alias("_bad"))
    seen = F.coalesce("_seen", F.lit(0)) - F.when(F.col("_blocked").isNotNull(), 1).otherwise(0)
    bad = F.coalesce("_bad", F.lit(0.0)) - F.coalesce("_blocked", F.lit(0.0))
    full = plain.join(by_suffix, F.col("_suffix") == F.col("_s"), "left").withColumns(
        {"suffix_rate": (bad + 1) / (seen + 2), "suffix_count": F.log1p(seen.cast("double"))}
    )
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    sample = full.where(F.col("_blocked").isNotNull()).select("_url", "_blocked", *FEATURES)
    sample = sample.orderBy(F.xxhash64(F.lit(seed), "_url"), "_url").limit(sample_rows)
    labels = [r["_blocked"] for r in known.select("_blocked").distinct().collect()]
    if len(labels) == 2:
        train = assembler.transform(sample).select("_features", "_blocked").repartition(1).cache()
        model = GBTClassifier(
            featuresCol="_features", labelCol="_blocked", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxMemoryInMB=512,
        ).fit(train)
        train.unpersist()
        judged = model.transform(assembler.transform(full)).withColumn("_score", vector_to_array("rawPrediction")[1])
    else:
        judged = full.withColumn("_score", F.lit(1.0 if labels == [1.0] else -1.0))
    decided = F.coalesce(F.col("_blocked") > 0, F.col("_score") > 0)
    return judged.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.when(decided, "block").otherwise("allow").alias("verdict"), F.when(F.col("_rule").isNull(), F.col("_score")).alias("score"),
    )
