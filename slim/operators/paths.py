"""Path selection on leaf tables.

A path is a list of steps, e.g. ``[Any(), Key("name")]`` for "the name of every
item". Steps become filters on the step arrays; positions that depend on list
lengths and item filters become windows over the document distribution, so the
leaf table is neither shredded twice nor joined to itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slim.functions.text import escape_key, is_index, json_string, path_text
from slim.operators.leaves import document_key, identity
from slim.operators.render import render_groups


@dataclass(frozen=True)
class Key:
    """Member of an object."""

    name: str


@dataclass(frozen=True)
class Any:
    """Every item of a list."""


@dataclass(frozen=True)
class Index:
    """One list item; negative counts from the end."""

    i: int


@dataclass(frozen=True)
class Slice:
    """List items ``start <= position < stop``; bounds may be open or negative."""

    start: int | None = None
    stop: int | None = None
    stride: int = 1


@dataclass(frozen=True)
class Where:
    """List items whose member ``key`` compares true; with no operator the
    member only has to exist."""

    key: str
    op: str | None = None
    value: object = None


@dataclass(frozen=True)
class Descend:
    """Members called ``name`` at any depth."""

    name: str


def static_path(path: list) -> str | None:
    """Path text for :func:`narrow`, when every leading step is fixed."""
    out = "$"
    for step in path:
        if isinstance(step, Key) and "'" not in step.name and "\\" not in step.name:
            out += f"['{step.name}']"
        elif isinstance(step, Index) and step.i >= 0:
            out += f"[{step.i}]"
        else:
            return None
    return out


def select_static(parsed: DataFrame, path: list) -> DataFrame:
    """Fixed member / position paths on parsed payloads, taken before any
    shredding: one extraction per row. Payloads without the path have NULL."""
    text = static_path(path)
    if text is None:
        raise ValueError("select_static takes Key and non-negative Index steps only")
    return parsed.withColumn("v", F.try_variant_get("v", text, "variant"))


def _compare(op: str, value: object) -> Column:
    """A leaf against a value of its own kind; kinds that differ are unequal
    and have no order. ``!=`` is answered by :func:`_where`."""
    scalar, kind = F.col("scalar"), F.col("kind")
    if value is None:
        return (kind == "null") & F.lit(op in ("==", "<=", ">="))
    if isinstance(value, bool):
        left, right, same = scalar, F.lit(str(value).lower()), kind == "bool"
    elif isinstance(value, (int, float)):
        left, right, same = scalar.try_cast("double"), F.lit(float(value)), kind.isin("int", "float")
    else:
        left, right, same = scalar, F.lit(str(value)), kind == "string"
    table = {
        "==": left == right,
        "<": left < right,
        "<=": left <= right,
        ">": left > right,
        ">=": left >= right,
    }
    return same & table[op]


def select_path(leaves: DataFrame, path: list) -> DataFrame:
    """Leaves below every match of ``path``. ``match_ord`` and ``match_path``
    name the matched node, ``steps`` and ``ord`` are relative to it."""
    cur = leaves.withColumn("_at", F.lit(0))
    for step in path:
        at = F.col("_at")
        here = F.get("steps", at)
        pos = F.get("ord", at)
        if isinstance(step, Key):
            cur = cur.where(here == escape_key(step.name)).withColumn("_at", at + 1)
        elif isinstance(step, Any):
            cur = cur.where(is_index(here)).withColumn("_at", at + 1)
        elif isinstance(step, Index) and step.i >= 0:
            cur = cur.where(here == f"[{step.i}]").withColumn("_at", at + 1)
        elif isinstance(step, Index):
            cur = _with_length(cur).where(pos == F.col("_len") + step.i).drop("_len").withColumn("_at", at + 1)
        elif isinstance(step, Slice):
            cur = _slice(cur, step).withColumn("_at", at + 1)
        elif isinstance(step, Where):
            cur = _where(cur, step).withColumn("_at", at + 1)
        elif isinstance(step, Descend):
            below = F.filter(
                F.sequence(at, F.size("steps")), lambda j: F.get(F.col("steps"), j) == escape_key(step.name)
            )
            cur = cur.withColumn("_at", F.explode(F.transform(below, lambda j: j + 1)))
        else:
            raise TypeError(f"unknown path step {step!r}")
    at = F.col("_at")
    tail = F.size("steps") - at
    return cur.select(
        "payload_id",
        *_carried(leaves),
        F.slice("ord", F.lit(1), at).alias("match_ord"),
        path_text(F.slice("steps", F.lit(1), at)).alias("match_path"),
        F.slice("steps", at + 1, tail).alias("steps"),
        F.slice("ord", at + 1, tail).alias("ord"),
        "kind",
        "scalar",
    )


def _with_length(cur: DataFrame) -> DataFrame:
    """Only list items at the cursor, with the list length ``_len``."""
    at = F.col("_at")
    w = Window.partitionBy(*document_key(cur), F.slice("ord", F.lit(1), at))
    return cur.where(is_index(F.get("steps", at))).withColumn("_len", F.max(F.get("ord", at)).over(w) + 1)


def _slice(cur: DataFrame, step: Slice) -> DataFrame:
    pos = F.get("ord", F.col("_at"))
    bounds = (step.start, step.stop)
    if step.stride == 1 and all(b is None or b >= 0 for b in bounds):
        cur = cur.where(is_index(F.get("steps", F.col("_at"))))
        length = None
    else:
        cur = _with_length(cur)
        length = F.col("_len")

    def bound(b: int) -> Column:
        return F.lit(b) if b >= 0 else F.greatest(length + b, F.lit(0))

    start = bound(step.start) if step.start is not None else F.lit(0)
    cond = pos >= start
    if step.stop is not None:
        cond = cond & (pos < bound(step.stop))
    if step.stride != 1:
        cond = cond & ((pos - start) % step.stride == 0)
    return cur.where(cond).drop("_len")


def _where(cur: DataFrame, step: Where) -> DataFrame:
    """Items that have the member, or whose member compares as asked. Unequal
    is every member that is not equal: null, containers and other kinds too."""
    at = F.col("_at")
    member = F.get("steps", at + 1) == escape_key(step.key)
    w = Window.partitionBy(*document_key(cur), F.slice("ord", F.lit(1), at + 1))
    some = lambda c: F.max(F.coalesce(c, F.lit(False))).over(w)
    hit = some(member)
    if step.op == "!=":
        hit = hit & ~some(member & (F.size("steps") == at + 2) & _compare("==", step.value))
    elif step.op is not None:
        hit = some(member & (F.size("steps") == at + 2) & _compare(step.op, step.value))
    return cur.where(is_index(F.get("steps", at))).withColumn("_hit", hit).where("_hit").drop("_hit")


def match_values(matches: DataFrame) -> DataFrame:
    """One row per match with its value as compact JSON text."""
    return render_groups(matches, [*identity(matches), "match_ord"], [F.first("match_path").alias("match_path")])


def collapse_matches(matches: DataFrame, payloads: DataFrame, expression: str) -> DataFrame:
    """Per payload: the marker object without a match, the bare value with
    one, a list with several."""
    values = match_values(matches)
    grouped = values.groupBy(*identity(values)).agg(
        F.count("*").alias("n"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("match_ord", "text"))), lambda m: m["text"]), ","
        ).alias("body"),
    )
    marker = F.concat(
        F.lit('{"_info":"No matches for JSONPath expression","jsonpath":'), json_string(F.lit(expression)), F.lit("}")
    )
    return (
        with_result(payloads, grouped)
        .select(
            "payload_id",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches"),
            F.when(F.col("n").isNull(), marker)
            .when(F.col("n") == 1, F.col("body"))
            .otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
            .alias("result"),
        )
    )


def with_result(payloads: DataFrame, results: DataFrame, drop: bool = True) -> DataFrame:
    """Every payload, also one without leaves, beside its row of ``results``.
    Copies of a payload, equal in id and text, have equal results: one stands
    for all."""
    if "doc" not in results.columns:
        return payloads.join(results, "payload_id", "left")
    every = payloads if "doc" in payloads.columns else payloads.withColumn("doc", F.xxhash64("payload_id", "raw"))
    joined = every.join(results.dropDuplicates(["payload_id", "doc"]).drop("copy"), ["payload_id", "doc"], "left")
    return joined.drop("doc") if drop else joined


def _carried(rows: DataFrame) -> list[str]:
    known = ("payload_id", "match_ord", "match_path", "steps", "ord", "kind", "scalar")
    return [c for c in rows.columns if c not in known]


def reroot(matches: DataFrame) -> DataFrame:
    """Matches as a leaf table again: a single match becomes the root, several
    become the items of a list, in document order."""
    w = Window.partitionBy(*document_key(matches)).orderBy("match_ord")
    total = Window.partitionBy(*document_key(matches))
    ranked = matches.withColumn("_i", F.dense_rank().over(w) - 1).withColumn("_n", F.max("_i").over(total) + 1)
    many = F.col("_n") > 1
    head = F.array(F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("]")))
    return ranked.select(
        "payload_id",
        *_carried(matches),
        F.when(many, F.concat(head, F.col("steps"))).otherwise(F.col("steps")).alias("steps"),
        F.when(many, F.concat(F.array("_i"), F.col("ord"))).otherwise(F.col("ord")).alias("ord"),
        "kind",
        "scalar",
    )
