"""Document fingerprints by consistent weighted sampling, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slim.llm.common import row_hash, running_totals, stored, words

SAMPLES = 32
GROUP = 4  # samples drawn in one row
# Letters of scripts that are written without spaces between words, each a term:
# Thai to Tibetan, Myanmar, Khmer, kana, Han.
UNSPACED = r"[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}]"


def phrases(text: Column) -> Column:
    """The text's terms: every word, and every letter of scripts without spaces;
    of a text without words an empty array."""
    apart = F.regexp_replace(F.translate(text, "\u3000", " "), UNSPACED, " $0 ")
    foreign = (F.octet_length(text) > F.length(text)) & text.rlike(UNSPACED)
    return F.when(foreign, words(apart)).otherwise(words(text))


def _runs(values: Column) -> Column:
    """Of a sorted array its distinct values and how often each occurs."""
    starts = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | (F.get(values, i) != F.coalesce(F.get(values, i - 1), F.lit(0))))
    return F.when(F.size(values) > 0, starts).otherwise(F.array().cast("array<int>"))


def weighted_terms(rows: DataFrame, texts: list[str]) -> DataFrame:
    """Replaces one or two text columns by ``_terms``: hash, weight (how often
    the term occurs) and form: 0 or 1 for terms of one of the texts, 2 for terms
    that both have equally often, which come once. A row stays a row."""
    # The last bit of a hash tells the text, so equal terms of both are neighbours.
    def hashed(text: str, form: int) -> Column:
        return F.transform(phrases(F.col(text)), lambda p: F.xxhash64(p).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(form)))

    hashes = F.concat(*[hashed(t, form) for form, t in enumerate(texts)])
    rest = [c for c in rows.columns if c not in texts]
    runs = rows.select(*rest, F.sort_array(hashes).alias("_h")).select(*rest, "_h", _runs(F.col("_h")).alias("_starts")).select(
        *rest,
        F.transform(
            "_starts",
            lambda s, k: F.struct(F.get("_h", s).alias("e"), (F.coalesce(F.get("_starts", k + 1), F.size("_h")) - s).alias("w")),
        ).alias("_r"),
    )

    def term(x: Column, k: Column) -> Column:
        form = x["e"].bitwiseAND(F.lit(1))
        other = F.get("_r", F.when(form == 0, k + 1).otherwise(k - 1))
        both = F.coalesce((other["e"] == x["e"].bitwiseXOR(F.lit(1))) & (other["w"] == x["w"]), F.lit(False))
        return F.when(
            ~both | (form == 0), F.struct(F.shiftright(x["e"], 1).alias("h"), x["w"].cast("double").alias("w"), F.when(both, 2).otherwise(form.cast("int")).alias("form"))
        )

    return runs.select(*rest, F.filter(F.transform("_r", term), lambda x: x.isNotNull()).alias("_terms"))


def _uniform(h: Column, shift: int) -> Column:
    """26 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 26) - 1)).cast("double") + 0.5) / float(1 << 26)


def _sampled(terms: DataFrame, key: list[str], samples: int, term: str, log_weight: str) -> DataFrame:
    """(key, _g, _m0, _m1, ...): consistent weighted samples ``_g * GROUP`` and
    following of each key's terms.

    For each term and sample r and c are Gamma(2, 1) and b is uniform, all from
    hashes of the term; t = floor(ln w / r + b), ln a = ln c - r (t - b + 1). The
    sample is the (term, t) of the least a. ln a, in steps of 2**-32, is the upper
    part of a whole number and 16 bits of (term, t) the lower one, so one minimum
    finds the least and says what it is.

    A term is a row for each group of samples, as one expression for all of them
    outgrows what the JVM compiles, and each value is a column that the next ones
    use. Partial minima are formed before anything is shuffled."""
    groups, own = F.sequence(F.lit(0), F.lit(-(-samples // GROUP) - 1)), [*key, "_g", log_weight]
    each = terms.select(*key, term, log_weight, F.explode(groups).alias("_g"))
    j = range(GROUP)
    rows = each.select(*own, *[F.xxhash64(F.col("_g") * GROUP + i, F.col(term)).alias(f"_u{i}") for i in j])
    rows = rows.select(*own, *[f"_u{i}" for i in j], *[F.xxhash64(f"_u{i}").alias(f"_v{i}") for i in j])
    rows = rows.select(
        *own, *[(-F.log(_uniform(F.col(f"_u{i}"), 0) * _uniform(F.col(f"_u{i}"), 32))).alias(f"_r{i}") for i in j],
        *[F.log(-F.log(_uniform(F.col(f"_v{i}"), 0) * _uniform(F.col(f"_v{i}"), 32))).alias(f"_c{i}") for i in j],
        *[F.xxhash64(f"_v{i}").alias(f"_z{i}") for i in j],
    )
    keep = [f"{x}{i}" for x in ("_r", "_c", "_z") for i in j]
    rows = rows.select(*own, *keep, *[_uniform(F.col(f"_z{i}"), 0).alias(f"_b{i}") for i in j])
    # Of weight 1 the logarithm is 0 and so is t.
    t = lambda i: F.when(F.col(log_weight) == 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.col(log_weight) / F.col(f"_r{i}") + F.col(f"_b{i}")))
    rows = rows.select(*key, "_g", *keep, *[f"_b{i}" for i in j], *[t(i).alias(f"_t{i}") for i in j])

    def packed(i):
        log_a = F.col(f"_c{i}") - F.col(f"_r{i}") * (F.col(f"_t{i}") - F.col(f"_b{i}") + 1)
        name = F.shiftrightunsigned(f"_z{i}", 48).bitwiseXOR(F.col(f"_t{i}") * 40503).bitwiseAND(F.lit(0xFFFF))
        return F.shiftleft(F.floor(log_a * float(1 << 32)), 16).bitwiseOR(name)

    return rows.groupBy(*key, "_g").agg(*[F.min(packed(i)).alias(f"_m{i}") for i in j])


def _spread_out(samples: int, least) -> list[Column]:
    """Aggregates over the groups: sample k as ``least`` of its rows."""
    return [least(F.when(F.col("_g") == k // GROUP, F.col(f"_m{k % GROUP}"))) for k in range(samples)]


def weighted_samples(terms: DataFrame, key: list[str], samples: int, term: str = "_h", weight: str = "_w") -> DataFrame:
    """(key, _s0, _s1, ...): the samples of a table (key, term hash, weight).
    Weights are any positive numbers; other rows have no part. Two keys agree in
    a sample with the probability of the generalised Jaccard similarity of their
    weights."""
    logs = terms.select(*key, term, F.when(F.col(weight) > 0, F.log(weight)).alias("_lw")).where("_lw is not null")
    parts = _sampled(logs, key, samples, term, "_lw")
    return parts.groupBy(*key).agg(*[x.alias(f"_s{k}") for k, x in enumerate(_spread_out(samples, F.min))])


def _print(least: list[Column]) -> Column:
    """The names in the samples; 0 where there are no terms."""
    return F.array(*[F.coalesce(x.bitwiseAND(F.lit(0xFFFF)), F.lit(0).cast("bigint")) for x in least])


def fingerprints(rows: DataFrame, key: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """Of each key (one row each) ``_print``: the samples of its text's terms, weighted by their counts."""
    # Outer: the filter that a plain explode adds would be pushed into the arrays' making and repeat it per element.
    terms = weighted_terms(rows.select(*key, text), [text]).select(*key, F.explode_outer("_terms").alias("_t"))
    least = weighted_samples(terms.select(*key, F.col("_t.h").alias("_h"), F.col("_t.w").alias("_w")), key, samples)
    named = least.withColumnsRenamed({k: f"_of{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in key]
    return rows.select(*key).join(named, same, "left").select(*key, _print([F.col(f"_s{k}") for k in range(samples)]).alias("_print"))


def both_prints(rows: DataFrame, key: list[str], texts: list[str], samples: int) -> DataFrame:
    """Of each key the prints ``_own`` and ``_new`` of two texts. A term that both
    have with the same weight is drawn once for both."""
    listed = weighted_terms(rows.select(*key, *texts), texts)
    # A row of its own for texts without terms.
    terms = listed.select(*key, F.explode_outer("_terms").alias("_t"))
    drawn = terms.select(*key, F.coalesce("_t.form", F.lit(2)).alias("_form"), F.col("_t.h").alias("_h"), F.log("_t.w").alias("_lw"))
    parts = _sampled(drawn, [*key, "_form"], samples, "_h", "_lw")
    of = lambda form: _spread_out(samples, lambda m: F.min(F.when(F.col("_form").isin(2, form), m)))
    return parts.groupBy(*key).agg(*[x.alias(f"_{form}_{k}") for form in (0, 1) for k, x in enumerate(of(form))]).select(
        *key, _print([F.col(f"_0_{k}") for k in range(samples)]).alias("_own"), _print([F.col(f"_1_{k}") for k in range(samples)]).alias("_new")
    )


def likeness(a: str, b: str) -> Column:
    """The part of equal samples, 0 to 1."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)
    return F.size(same) / F.size(a)


def printed(a: str) -> Column:
    """Four hexadecimal digits a sample."""
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")))


def edit_fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form: the last quarter of its
    code points replaced by as many first ones (or all) of the next document in
    ascending id order, the first after the last.

    Terms are all words, and the letters of scripts that are written without
    spaces; weights are how often they occur. Terms that a text and its edited
    form have equally often are drawn once for both. A null text is empty; texts without words have the sample 0 in every
    place. Null ids come first; rows with the same id are ordered by a hash of
    the text, and rows equal in both count as one document, whose result each of
    them gets. A single document is its own next. Empty input gives no rows;
    other columns are not read.

    Texts are shuffled once, by (id, hash), for their edits; everything else
    stays where that put them or moves without texts.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (likeness to the edited and to the next text's)."""
    key, nxt = ["_id", "_null", "_hash"], ["_nid", "_nnull", "_nhash"]
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(0).cast("bigint")).alias("_id"), F.isnull(id_col).alias("_null"), row_hash(text_col).alias("_hash"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    known = rows.select(*key, F.length("_text").cast("bigint").alias("_n")).groupBy(*key).agg(F.first("_n").alias("_n"), F.count(F.lit(1)).alias("_copies"))
    ordered = known.withColumn("_notnull", ~F.col("_null"))
    numbered = stored(running_totals(ordered, [], ["_notnull", "_id", "_hash"], "_n").select(*key, "_n", "_copies", "_row", "_rows"), "order")
    following = numbered.select(*[F.col(k).alias(n) for k, n in zip(key, nxt)], F.col("_row").alias("_at"))
    plan = stored(numbered.join(following, F.col("_at") == F.pmod(F.col("_row") + 1, F.col("_rows"))).select(*key, *nxt, "_n", "_copies"), "next")
    asked = plan.select(*[F.col(n).alias(k) for k, n in zip(key, nxt)], *[F.col(k).alias(f"_for{k}") for k in key], F.floor(F.col("_n") / 4).cast("int").alias("_m"))
    texts = rows.select(*key, "_text").repartition(*key)
    once = texts.dropDuplicates(key)
    heads = once.join(asked, key).select(*[F.col(f"_for{k}").alias(k) for k in key], "_m", F.substring("_text", F.lit(1), F.col("_m")).alias("_head"))
    both = once.join(heads, key).withColumn("_edited", F.concat(F.expr("left(_text, char_length(_text) - _m)"), "_head")).select(*key, "_text", "_edited")
    digests = both.select(*key, F.sha2("_edited", 256).alias("edited_sha256"))
    paired = both_prints(both, key, ["_text", "_edited"], samples)
    done = stored(paired.join(digests, key), "prints")
    after = done.select(*[F.col(k).alias(n) for k, n in zip(key, nxt)], F.col("_own").alias("_after"))
    return done.join(plan, key).join(after, nxt).select(
        F.when(~F.col("_null"), F.col("_id")).alias(id_col), F.col("_n").alias("n_chars"), "edited_sha256",
        printed("_own").alias("fingerprint"), printed("_new").alias("edited_fingerprint"),
        likeness("_own", "_new").alias("near_edited"), likeness("_own", "_after").alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")
