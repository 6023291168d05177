"""Schema mode: the gate, type descriptors, samples and the corpus profile.

Everything here looks only as deep as it must: the gate and the samples read
the parsed list, the profile opens two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slim.functions.text import LONG_STRING, MAX_DEPTH, SAMPLE_ITEMS, SCHEMA_MIN_ITEMS, is_index, json_string, let, step_key
from slim.operators.leaves import identity, leaves
from slim.operators.prune import PRUNED, clean
from slim.operators.render import joined_when, render_groups

BIG_INT = "^DECIMAL[(](19|[2-3][0-9]),0[)]$"


def items_of(v: Column) -> Column:
    """Items of a list as an array of VARIANT; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT<")


def is_uniform_array(parsed: DataFrame) -> DataFrame:
    """Adds ``n_items`` (NULL unless the root is a list) and ``gate``: a list
    of at least five items, all of them objects. Narrow, no shredding."""
    items = items_of(F.col("v"))
    gate = F.coalesce((F.size(items) >= SCHEMA_MIN_ITEMS) & F.forall(items, is_object), F.lit(False))
    return parsed.withColumn("n_items", F.when(items.isNotNull(), F.size(items)).cast("bigint")).withColumn("gate", gate)


def type_label(v: Column) -> Column:
    """Short type descriptor; lists are described by their first item, at any
    nesting: the opening brackets of a value's text are its lists in lists."""

    def plain(x: Column, t: Column) -> Column:
        members = F.size(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")))
        return (
            F.when(t == "STRING", F.when(F.char_length(x.cast("string")) > LONG_STRING, "string(long)").otherwise("string"))
            .when(t == "BIGINT", "int")
            .when(t == "VOID", "null")
            .when(t == "BOOLEAN", "bool")
            .when(t.startswith("OBJECT<"), F.concat(F.lit("object("), members.cast("string"), F.lit(" keys)")))
            .when(t.startswith("ARRAY<"), "[]")
            .when(t.rlike(BIG_INT), "int")
            .otherwise("float")
        )

    def within(x: Column, brackets: Column) -> Column:
        """The innermost first item, and how many items each list above it has."""
        start = F.struct(x.alias("v"), F.array().cast("array<int>").alias("sizes"))
        open_one = lambda acc, _: F.struct(F.get(items_of(acc["v"]), F.lit(0)).alias("v"), F.array_append(acc["sizes"], F.size(items_of(acc["v"]))).alias("sizes"))
        return F.aggregate(F.sequence(F.lit(1), brackets), start, open_one)

    def wrapped(acc: Column) -> Column:
        inner = let(F.schema_of_variant(acc["v"]), lambda t: plain(acc["v"], t))
        tails = F.transform(F.reverse(acc["sizes"]), lambda n: F.concat(F.lit(", ..."), n.cast("string"), F.lit("]")))
        return F.concat(F.repeat(F.lit("["), F.size(acc["sizes"])), inner, F.array_join(tails, ""))

    def label(x: Column, t: Column) -> Column:
        # A list that is empty is described as it is, not opened.
        head = F.regexp_extract(x.cast("string"), r"^(\[*)(\]?)", 1)
        empty = F.length(F.regexp_extract(x.cast("string"), r"^(\[*)(\]?)", 2))
        lists = let(F.length(head) - empty, lambda n: F.when(n > 0, let(within(x, n), wrapped)).otherwise("[]"))
        return F.when(t.startswith("ARRAY<"), lists).otherwise(plain(x, t))

    return let(v, lambda x: let(F.schema_of_variant(x), lambda t: label(x, t)))


def member_label(shape: Column, kind: Column, scalar: Column, text: Column) -> Column:
    """Type descriptor of a rendered member; only containers are read again."""
    plain = F.when(
        (kind == "string"), F.when(F.char_length(scalar) > LONG_STRING, "string(long)").otherwise("string")
    ).otherwise(kind)
    return F.when(shape == "scalar", plain).otherwise(type_label(F.try_parse_json(F.when(shape != "scalar", text))))


def sample_items(parsed: DataFrame, k: int = SAMPLE_ITEMS) -> DataFrame:
    """The first ``k`` items of every list, before any shredding:
    ``(payload_id, item, v)``."""
    head = F.slice(items_of(F.col("v")), 1, k)
    return parsed.select(*identity(parsed), F.posexplode(head).alias("item", "v"))


def _sample_leaves(parsed: DataFrame, k: int, max_depth: int) -> DataFrame:
    rows = leaves(sample_items(parsed, k), ("item",))
    # Kept even if everything below is pruned: its item is still shown as {}.
    anchor = F.forall("ord", lambda o: o == 0)
    return clean(rows, max_depth, anchor)


def first_item_schema(parsed: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(payload_id, key, type)`` of the pruned first item."""
    rows = _sample_leaves(parsed, 1, max_depth).where((F.col("kind") != PRUNED) & (F.size("steps") > 0))
    tops = rows.select(
        *identity(rows),
        F.get("steps", F.lit(0)).alias("key"),
        F.slice("steps", F.lit(2), F.size("steps")).alias("steps"),
        "ord",
        "kind",
        "scalar",
    )
    shape = F.when(F.max(F.size("steps")) > 0, "container").otherwise("scalar").alias("shape")
    values = render_groups(tops, [*identity(rows), "key"], [shape, F.first("kind").alias("kind"), F.first("scalar").alias("scalar")])
    return values.select(
        *identity(values),
        step_key(F.col("key")).alias("key"),
        member_label(F.col("shape"), F.col("kind"), F.col("scalar"), F.col("text")).alias("type"),
    )


def hint_text(n: Column, shown: Column) -> Column:
    """Fixed value: the hint that closes a summary."""
    return F.concat(
        F.lit("Returned schema + "),
        shown.cast("string"),
        F.lit(" sample items out of "),
        n.cast("string"),
        F.lit(
            ". Use the jsonpath parameter to fetch specific items or fields. "
            "Examples: '$[0:5]' (first 5 items), '$[*].name' (all names), "
            "'$[?@.id==42]' (item with id 42)."
        ),
    )


def schema_summary(parsed: DataFrame, max_depth: int = MAX_DEPTH, gated: bool = True) -> DataFrame:
    """Mode, count, schema, samples and hint per list of objects.

    With ``gated`` only lists that pass the gate are summarised. ``schema`` and
    the samples are compact JSON text.
    """
    lists = is_uniform_array(parsed)
    lists = lists.where("gate") if gated else lists.where(F.col("n_items") > 0)
    head = F.slice(items_of(F.col("v")), 1, SAMPLE_ITEMS)
    # Samples move once, by document; all that follows is keyed by it.
    placed = lists.select("payload_id", F.col("payload_id").alias("doc"), "n_items", head.alias("head")).repartition("doc")
    numbered = placed.withColumn("row", F.monotonically_increasing_id())
    items = numbered.select("payload_id", "doc", "n_items", "row", F.posexplode("head").alias("item", "v"))
    rows = leaves(items.withColumn("copy", F.col("row") * SAMPLE_ITEMS + F.col("item")), ("n_items", "row", "item"))
    found = _sample_texts(clean(rows, max_depth, F.forall("ord", lambda o: o == 0)))
    first = lambda c, i: F.max(F.when(F.col("item") == i, F.col(c)))
    lists = found.groupBy("payload_id", "doc", "row", "n_items").agg(
        first("schema", 0).alias("schema"), first("text", 0).alias("sample_1"), first("text", 1).alias("sample_2")
    )
    return lists.select(
        "payload_id",
        F.lit("schema").alias("mode"),
        "n_items",
        F.concat(F.lit("{"), F.col("schema"), F.lit("}")).alias("schema"),
        "sample_1",
        "sample_2",
        hint_text(F.col("n_items"), F.least(F.col("n_items"), F.lit(SAMPLE_ITEMS))).alias("hint"),
    )


def _sample_texts(rows: DataFrame) -> DataFrame:
    """Text and member types of every sample item, from its pruned leaves."""
    item = ["payload_id", "doc", "copy", "row", "n_items", "item"]
    shown = F.col("kind") != PRUNED
    tops = rows.select(
        *item,
        F.when(shown, F.get("steps", F.lit(0))).alias("key"),
        F.slice("steps", F.lit(2), F.size("steps")).alias("steps"),
        "ord",
        "kind",
        "scalar",
    )
    shape = F.when(F.max(F.size("steps")) > 0, "container").otherwise("scalar").alias("shape")
    facts = [shape, F.first("kind").alias("kind"), F.first("scalar").alias("scalar"), F.min("ord").alias("pos")]
    values = render_groups(tops, [*item, "key"], facts).withColumn("name", step_key(F.col("key")))
    label = json_string(member_label(F.col("shape"), F.col("kind"), F.col("scalar"), F.col("text")))
    name = F.concat(json_string(F.col("name")), F.lit(":"))
    member = F.concat(F.when(is_index(F.col("key")), F.lit("")).otherwise(name), F.col("text"))
    items = values.groupBy(*item).agg(
        joined_when(F.col("key").isNotNull(), member, "pos", ",").alias("body"),
        joined_when(F.col("key").isNotNull(), F.concat(name, label), "name", ",").alias("schema"),
        F.max(F.when(F.col("key").isNull() & shown, F.col("text"))).alias("plain"),
        F.coalesce(F.max(is_index(F.col("key"))), F.lit(False)).alias("is_list"),
    )
    left, right = F.when(F.col("is_list"), "[").otherwise("{"), F.when(F.col("is_list"), "]").otherwise("}")
    return items.select(*item, "schema", F.coalesce("plain", F.concat(left, F.col("body"), right)).alias("text"))


def schema_profile(parsed: DataFrame, by: list[str] = ()) -> DataFrame:
    """Schema of a whole corpus of lists, over every item: per key the types,
    how many items have it, how often it is null, and a distinct estimate.

    Partial aggregates run before the shuffle, so a key that occurs in every
    item costs one row per task.
    """
    spark = parsed.sparkSession
    groups = list(by)
    opened = (
        parsed.select(*groups, F.explode(items_of(F.col("v"))).alias("v"))
        .alias("t")
        .lateralJoin(spark.tvf.variant_explode(F.col("t.v").outer()).alias("e"))
        .select(*[f"t.{g}" for g in groups], F.col("e.key").alias("key"), F.col("e.value").alias("value"))
        .where("key is not null")
        .select(*groups, "key", type_label(F.col("value")).alias("type"), F.col("value").cast("string").alias("text"))
    )
    return opened.groupBy(*groups, "key").agg(
        F.count("*").alias("n_present"),
        F.count_if(F.col("type") == "null").alias("n_null"),
        F.array_join(F.sort_array(F.collect_set("type")), "|").alias("types"),
        F.approx_count_distinct("text").alias("approx_values"),
    )
