"""The predicates and labels as SQL functions. Their bodies are inlined by the
optimizer, so they cost what the expression costs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from slim.functions.text import BLANK_PATTERN, TEMPLATE_GROUP_PATTERN, TRUNCATION_MARKERS


def _text(value: str) -> str:
    body = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{body}'"


def _pairs(name: str) -> str:
    sorted_pairs = f"array_sort(transform(map_entries({name}), e -> named_struct('k', e.key, 'v', e.value)))"
    return f"coalesce(to_json({sorted_pairs}, map('ignoreNullFields', 'false')), '[]')"


SCALAR_FUNCTIONS = {
    "is_template_url(s STRING) RETURNS BOOLEAN": (
        f"(startswith(s, 'http://') OR startswith(s, 'https://')) AND s RLIKE {_text(TEMPLATE_GROUP_PATTERN)}"
    ),
    "is_blank(s STRING) RETURNS BOOLEAN": f"s RLIKE {_text(BLANK_PATTERN)}",
    "saved_pct(raw BIGINT, opt BIGINT) RETURNS DOUBLE": (
        "CASE WHEN raw = 0 THEN 0D ELSE bround((raw - opt) / CAST(raw AS DOUBLE) * 100, 1) END"
    ),
    "saved_permille(raw BIGINT, opt BIGINT) RETURNS BIGINT": (
        "CASE WHEN raw = 0 THEN 0L ELSE CAST(((raw - opt) * 1000) / CAST(raw AS DECIMAL(20,0)) AS BIGINT) END"
    ),
    "truncate_text(s STRING, n INT, style STRING) RETURNS STRING": (
        "CASE WHEN char_length(s) > n THEN concat(left(s, n), CASE style "
        + " ".join(f"WHEN '{k}' THEN {_text(v)}" for k, v in TRUNCATION_MARKERS.items())
        + " END) ELSE s END"
    ),
    "request_key(url STRING, headers MAP<STRING, STRING>, params MAP<STRING, STRING>) RETURNS STRING": (
        f"sha2(concat(url, '\\n', {_pairs('headers')}, '\\n', {_pairs('params')}), 256)"
    ),
}

CHILDREN = (
    "children(v VARIANT) RETURNS TABLE(pos INT, key STRING, value VARIANT) "
    "RETURN SELECT e.pos, e.key, e.value FROM variant_explode(children.v) e"
)


def register_functions(spark: SparkSession) -> None:
    """Create the session's temporary functions: ``is_template_url``,
    ``is_blank``, ``saved_pct``, ``saved_permille``, ``truncate_text``,
    ``request_key`` and the table function ``children``."""
    for head, body in SCALAR_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {CHILDREN}")
