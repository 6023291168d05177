"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults, markers and patterns that decide the results.
MAX_CHARS = 20_000
MAX_DEPTH = 5
SCHEMA_MIN_ITEMS = 5
SAMPLE_ITEMS = 2
LONG_STRING = 80
SOURCE_URL_CHARS = 60
TRUNCATION_MARKERS = {
    "json": "\n\n... [truncated]",
    "text": "\n\n[... truncated]",
}
BLANK_PATTERN = r"(?U)^[\s\x{1c}-\x{1f}]*$"
EDGE_BLANK_PATTERN = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"
ESCAPED_PATTERN = r'["\\\x00-\x1f]'
TEMPLATE_GROUP_PATTERN = r"\{[^}]+\}"
TOKEN_PATTERN = r"[^ \t\r\n\f\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^ \t\r\n\f\p{L}\p{N}]+[\r\n]*|[ \t\r\n\f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(col: Column) -> Column:
    """True for strings made of (Unicode) whitespace only."""
    return col.rlike(BLANK_PATTERN)


def strip(col: Column) -> Column:
    """Remove (Unicode) whitespace at both ends."""
    return F.regexp_replace(col, EDGE_BLANK_PATTERN, "")


def is_template_url(col: Column) -> Column:
    """True for http(s) addresses that carry a non-empty ``{...}`` group."""
    return (col.startswith("http://") | col.startswith("https://")) & col.rlike(TEMPLATE_GROUP_PATTERN)


def truncate_text(col: Column, max_chars: int | Column = MAX_CHARS, style: str = "text") -> Column:
    """Cut to ``max_chars`` code points and append the marker of ``style``."""
    limit = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    return F.when(
        F.char_length(col) > limit,
        F.concat(F.substring(col, F.lit(1), limit), F.lit(TRUNCATION_MARKERS[style])),
    ).otherwise(col)


def saved_pct(raw: Column, opt: Column) -> Column:
    """Percentage saved with one decimal, zero for an empty input."""
    ratio = (raw - opt) / raw.cast("double") * 100
    return F.when(raw == 0, F.lit(0.0)).otherwise(F.bround(ratio, 1))


def saved_permille(raw: Column, opt: Column) -> Column:
    """Share saved in whole thousandths, rounded towards zero."""
    return F.when(raw == 0, F.lit(0).cast("bigint")).otherwise(
        (((raw - opt) * 1000) / raw.cast("decimal(20,0)")).cast("bigint")
    )


def source_label(prefix: str | Column, url: Column) -> Column:
    """``prefix:`` followed by the first 60 characters of the address."""
    head = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.concat(head, F.lit(":"), F.substring(url, 1, SOURCE_URL_CHARS))


def known_source(col: Column) -> Column:
    """Missing or empty source labels become ``unknown``."""
    return F.when(col.isNull() | (col == ""), F.lit("unknown")).otherwise(col)


def request_key(url: Column, headers: Column, params: Column) -> Column:
    """SHA-256 request key; header and parameter order does not matter and a
    missing map equals an empty one."""

    def pairs(col: Column) -> Column:
        entries = F.transform(F.map_entries(col), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
        return F.coalesce(F.to_json(F.array_sort(entries), {"ignoreNullFields": "false"}), F.lit("[]"))

    return F.sha2(F.concat(url, F.lit("\n"), pairs(headers), F.lit("\n"), pairs(params)), 256)


def token_estimate(col: Column) -> Column:
    """Number of pre-tokens: words with a leading mark, digit triples,
    punctuation runs and whitespace runs. Every character is in one of them, so
    with a letter for each, the letters are their number."""
    return F.char_length(F.regexp_replace(col, TOKEN_PATTERN, "x")).cast("bigint")


# Steps of a leaf path. An index step reads ``[3]``; an object key that itself
# starts with ``[`` or a backslash is prefixed by a backslash, so both differ.

def escape_key(key: str) -> str:
    return "\\" + key if key[:1] in ("[", "\\") else key


def is_index(step: Column) -> Column:
    return step.startswith("[")


def step_key(step: Column) -> Column:
    """The object key a key step stands for."""
    return F.when(step.startswith("\\"), F.substring(step, 2, 2_000_000_000)).otherwise(step)


def path_text(steps: Column) -> Column:
    """Readable path such as ``$[0].owner.login``."""
    parts = F.transform(steps, lambda s: F.when(is_index(s), s).otherwise(F.concat(F.lit("."), step_key(s))))
    return F.concat(F.lit("$"), F.array_join(parts, ""))


def ord_text(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ".")


def json_string(col: Column) -> Column:
    """A string as a quoted JSON literal (non-ASCII characters kept)."""
    return F.to_json(col.cast("variant"))


def quoted(col: Column) -> Column:
    """:func:`json_string` of a column that costs nothing to read twice: few
    strings need more than the quotes."""
    quote = F.lit('"')
    return F.when(col.rlike(ESCAPED_PATTERN), json_string(col)).otherwise(F.concat(quote, col, quote))


def json_scalar(kind: Column, scalar: Column) -> Column:
    """JSON text of one leaf, NULL for a placeholder of pruned content."""
    return (
        F.when(kind == "pruned", F.lit(None))
        .when(kind == "string", quoted(scalar))
        .when(kind == "null", F.lit("null"))
        .when(kind.isin("[]", "{}"), kind)
        .when((kind == "float") & ~scalar.rlike("[.EeNI]"), F.concat(scalar, F.lit(".0")))
        .otherwise(scalar)
    )
