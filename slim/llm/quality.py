"""Quality rules: base rules, then robust multivariate outliers per language and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slim.llm.common import row_hash, stored, words

SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"


def base_statistics(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, each
    computed inside its row by array functions.

    Repeated windows are found by 64-bit hashes of five words: sorted with
    their positions, equal neighbours are repeats, and each repeat covers the
    words up to the next one, five at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))
    first = rows.withColumns({"_words": words(F.col(text_col)), "_lines": lines})
    counted = first.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_h": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - 5), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(5)]))
    hashed = counted.withColumn("_g", F.when(F.size("_h") >= 5, windows).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    pairs = F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    ordered = hashed.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs)).drop("_g")
    value = lambda k: F.get("_s", k)["g"]
    repeats = F.filter(
        F.sequence(F.lit(0), F.size("_s") - 1),
        lambda k: F.coalesce(value(k - 1) == value(k), F.lit(False)) | F.coalesce(value(k + 1) == value(k), F.lit(False)),
    )
    found = ordered.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(repeats, lambda k: F.get("_s", k)["i"])))).drop("_s")
    steps = F.transform("_p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_p", k + 1) - p, F.lit(5))))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_p")


# The statistic vector: how it is transformed, and the least spread assumed in
# each coordinate. Most documents have no symbols, no equal lines and no
# repeats, so without a floor any half of them would be singular.
COORDINATES = [
    ("log_words", lambda: F.log(F.col("n_words") + 1), 0.3),
    # Forty words of mean length five temper the mean of short texts.
    ("log_word_length", lambda: F.log((F.col("word_chars") + 200) / (F.col("n_words") + 40)), 0.04),
    ("log_symbol_rate", lambda: F.log1p(F.lit(1000.0) * F.col("n_symbols") / (F.col("word_chars") + 100)), 0.5),
    ("log_dup_lines", lambda: F.log1p(F.col("n_dup_lines").cast("double")), 0.5),
    ("repeat_share", lambda: F.col("n_repeat_words") / (F.col("n_words") + 20), 0.05),
]
DIM = len(COORDINATES)
SCALE = 1000  # coordinates are whole thousandths, so sums are exact in any order
PART = 0.75  # of a group's documents that the determinant is minimised over
CONSISTENCY = 1.412  # 0.75 / P(chi2(7) <= the 0.75 quantile of chi2(5)): the subset's covariance for normal data
CUTOFF = 30.86  # the quantile of chi2(5) that one normal document in 100,000 exceeds
BINS, BINS_PER_UNIT = 4096, 16  # squared distances are ordered by bins of 1/16, those beyond 256 together


def _with_distance(rows: DataFrame, params: DataFrame, how: str) -> DataFrame:
    """Adds ``_d2`` by forward substitution through the factor of the covariance."""
    out = rows.join(params, rows["_key"] == params["_pkey"], how).drop("_pkey")
    for i in range(DIM):
        rest = F.col(f"_v{i}") - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_l{i}{j}") * F.col(f"_y{j}")
        out = out.withColumn(f"_y{i}", rest / F.col(f"_l{i}{i}"))
    return out.withColumn("_d2", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(DIM)), F.lit(0.0)))


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and median absolute deviations per group, from counts of whole hundredths."""

    def median(counts: DataFrame, value: str, out: str) -> DataFrame:
        key = Window.partitionBy("_key", "_i")
        upto = counts.withColumns({"_upto": F.sum("_c").over(key.orderBy(value)), "_all": F.sum("_c").over(key)})
        return upto.where(F.col("_upto") * 2 >= F.col("_all")).groupBy("_key", "_i").agg(F.min(value).alias(out))

    tall = vectors.select("_key", F.posexplode(F.array(*[F.round(F.col(f"_v{i}") / 10).cast("bigint") for i in range(DIM)])).alias("_i", "_x"))
    counts = tall.groupBy("_key", "_i", "_x").agg(F.count(F.lit(1)).alias("_c"))
    centres = median(counts, "_x", "_med")
    off = counts.join(centres, ["_key", "_i"]).groupBy("_key", "_i", F.abs(F.col("_x") - F.col("_med")).alias("_off")).agg(F.sum("_c").alias("_c"))
    both = centres.join(median(off, "_off", "_mad"), ["_key", "_i"])
    one = lambda name, i: F.max(F.when(F.col("_i") == i, F.col(name) * 10.0))
    columns = {}
    for i, (_, _, floor) in enumerate(COORDINATES):
        columns[f"_m{i}"] = one("_med", i)
        columns[f"_l{i}{i}"] = F.sqrt(F.pow(one("_mad", i) * 1.4826, 2) + (floor * SCALE) ** 2)
        columns |= {f"_l{i}{j}": F.lit(0.0) for j in range(i)}
    return both.groupBy(F.col("_key").alias("_pkey")).agg(*[c.alias(n) for n, c in columns.items()])


def _concentrate(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step: mean and covariance of the nearest part of each
    group. One pass; a group is a sum per distance bin before it is ordered."""
    number = lambda c: c.cast("decimal(20,0)")
    near = _with_distance(vectors, params, "inner").withColumn("_bin", F.least(F.lit(BINS), F.floor(F.least(F.col("_d2"), F.lit(float(BINS))) * BINS_PER_UNIT)))
    pairs = [(i, j) for i in range(DIM) for j in range(i + 1)]
    sums = near.groupBy("_key", "_bin").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(number(F.col(f"_v{i}"))).alias(f"_s{i}") for i in range(DIM)],
        *[F.sum(number(F.col(f"_v{i}") * F.col(f"_v{j}"))).alias(f"_s{i}{j}") for i, j in pairs],
    )
    key = Window.partitionBy("_key")
    ranked = sums.withColumns(
        {"_before": F.coalesce(F.sum("_n").over(key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(key)}
    )
    total = lambda name: F.sum(name).cast("double")
    half = ranked.where(F.col("_before") < F.ceil(F.col("_all") * PART)).groupBy(F.col("_key").alias("_pkey")).agg(
        F.sum("_n").alias("_k"), *[total(f"_s{i}").alias(f"_t{i}") for i in range(DIM)], *[total(f"_s{i}{j}").alias(f"_t{i}{j}") for i, j in pairs]
    )
    out = half.withColumns({f"_m{i}": F.col(f"_t{i}") / F.col("_k") for i in range(DIM)})
    spread = lambda i, j: (F.col(f"_t{i}{j}") / F.col("_k") - F.col(f"_m{i}") * F.col(f"_m{j}")) * CONSISTENCY
    out = out.withColumns({f"_c{i}{j}": spread(i, j) + ((COORDINATES[i][2] * SCALE) ** 2 if i == j else 0.0) for i, j in pairs})
    for j in range(DIM):
        left = F.col(f"_c{j}{j}") - sum((F.pow(F.col(f"_l{j}{k}"), 2) for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"_l{j}{j}", F.sqrt(F.greatest(left, F.lit((COORDINATES[j][2] * SCALE) ** 2 / 2))))
        below = {
            f"_l{i}{j}": (F.col(f"_c{i}{j}") - sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"_l{j}{j}")
            for i in range(j + 1, DIM)
        }
        out = out.withColumns(below) if below else out
    return out.select("_pkey", *[f"_m{i}" for i in range(DIM)], *[f"_l{i}{j}" for i, j in pairs])


def quality_verdicts(
    docs: DataFrame, min_group: int = 50, steps: int = 4, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Base rules, then rejection of documents far from the robust centre of
    their language and source.

    A document fails the base rules with under 10 words, or with more than a
    fifth of its words in repeated five-word windows. The others get a vector of
    transformed statistics (``COORDINATES``). Per language and source the
    minimum-covariance-determinant estimate comes from concentration steps that
    start at medians and median absolute deviations: nearest three quarters by
    Mahalanobis distance, their mean and covariance, again. A document is
    rejected when its squared distance exceeds ``cutoff``.

    Groups of under ``min_group`` documents are pooled within their language; a
    pool that is still smaller gives no verdict and its documents are kept.
    Null languages and sources are values of their own. Null and empty texts
    have no words and fail. Repeated rows get the same verdict; a null id is
    passed on. Empty input gives no rows; other columns are not read.

    Texts are read once, inside their rows; what is stored, joined and summed
    are vectors of whole numbers, so results do not depend on partitioning.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance (squared; null without estimate), row_hash."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_hash", row_hash("_lang", "_source", "_text"))
    based = base_statistics(rows, "_text").drop("_text").withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )
    measured = stored(based.withColumns({f"_v{i}": F.round(make() * SCALE).cast("bigint") for i, (_, make, _) in enumerate(COORDINATES)}), "statistics")
    group = F.to_json(F.struct("_lang", "_source"))
    sizes = measured.where(~F.col("base_failed")).groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_size"))
    own = F.coalesce(F.col("_size") >= min_group, F.lit(False))
    keyed = measured.join(sizes, group == F.col("_g"), "left").withColumn(
        "_key", F.when(own, F.col("_g")).otherwise(F.concat(F.lit("*"), F.to_json(F.struct("_lang"))))
    ).drop("_g", "_size")
    vectors = keyed.where(~F.col("base_failed")).select("_key", *[f"_v{i}" for i in range(DIM)])
    pools = vectors.groupBy(F.col("_key").alias("_pool")).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_group)
    params = _start(vectors.join(pools, F.col("_key") == F.col("_pool"), "left_semi"))
    for _ in range(steps):
        params = _concentrate(vectors, stored(params, "centres"))
    judged = _with_distance(keyed, stored(params, "centres"), "left")
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("_d2") <= cutoff, F.lit(True))).alias("kept"),
        F.col("_d2").alias("distance"), F.col("_hash").alias("row_hash"),
    )
