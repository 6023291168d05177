"""JSON documents as leaf tables.

A leaf row is ``(payload_id, doc, copy, steps, ord, kind, scalar)``: the path
from the root, the sibling position at every level, the value type and its
text. The document is spread once, before it is shredded; every later window,
aggregate or join keyed by the document then runs in place. ``payload_id`` need
not be unique: ``doc`` and ``copy`` tell documents apart (:func:`spread`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slim.functions.text import let
from slim.operators.large import cut_documents, is_large


def spread(df: DataFrame, content: str = "raw", id_col: str = "payload_id") -> DataFrame:
    """Distribute whole documents and give each a key of its own. The compact
    text is what moves; the much wider leaf rows made from it do not move again.

    Ids may repeat: ``doc``, a hash of id and content, decides where a document
    goes, and where it arrived ``copy`` numbers the rows. Nothing that moves
    depends on row order, so a task that runs again deals alike. Parts of a cut
    document (:mod:`slim.operators.large`) share both already."""
    if "doc" in df.columns:
        return df.repartition("doc")
    return df.withColumn("doc", F.xxhash64(id_col, content)).repartition("doc").withColumn("copy", F.monotonically_increasing_id())


def document_key(df: DataFrame) -> list[str]:
    """The columns that tell documents apart: the id alone in tables that were not spread."""
    return ["doc", "copy"] if "doc" in df.columns else ["payload_id"]


def identity(df: DataFrame) -> list[str]:
    """The id and what else tells documents apart."""
    return ["payload_id", *(c for c in document_key(df) if c != "payload_id")]


def parse(df: DataFrame, json_col: str = "raw") -> DataFrame:
    """Adds the VARIANT ``v``, NULL where the text is not JSON. There is no
    filter, so the text is parsed once."""
    return df.withColumn("v", F.try_parse_json(json_col))


def parse_payloads(df: DataFrame, json_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Split into ``(good, bad)``: parsed rows with a VARIANT ``v``, and rows
    whose text is not JSON with an ``error`` message. Text that is JSON but
    larger than a VARIANT can be says so instead."""
    parsed = parse(df, json_col)
    good = parsed.where(F.col("v").isNotNull())
    bad = parsed.where(F.col("v").isNull()).drop("v").withColumn("error", parse_error(F.col(json_col)))
    return good, bad


def parse_error(raw: Column) -> Column:
    """Why a text has no VARIANT."""
    return F.when(F.get_json_object(raw, "$").isNotNull(), "Error: JSON too large").otherwise("Error: Invalid JSON")


# Type names of a VARIANT value to leaf kinds: null, bool, int, float, string,
# [] and {}; none where there is no value, as the text is not JSON.
KIND_SQL = """CASE
    WHEN {t} IS NULL THEN 'none'
    WHEN {t} = 'STRING' THEN 'string'
    WHEN {t} = 'BIGINT' THEN 'int'
    WHEN {t} = 'VOID' THEN 'null'
    WHEN {t} = 'BOOLEAN' THEN 'bool'
    WHEN {t} = 'OBJECT<>' THEN '{{}}'
    WHEN startswith({t}, 'OBJECT<') THEN 'object'
    WHEN {t} = 'ARRAY<VOID>' AND CAST({v} AS STRING) = '[]' THEN '[]'
    WHEN startswith({t}, 'ARRAY<') THEN 'array'
    WHEN {t} RLIKE '^DECIMAL[(](19|[2-3][0-9]),0[)]$' THEN 'int'
    ELSE 'float' END"""

# A key that starts like an index step gets a backslash in front.
STEP_SQL = r"""coalesce(if(left(e.key, 1) IN ('[', '\\'), concat('\\', e.key), e.key), concat('[', e.pos, ']'))"""


def nesting_depth(v: Column) -> Column:
    """How many containers enclose the deepest value, counting empty ones: the
    most brackets open at once outside strings."""
    text = F.replace(F.replace(v.cast("string"), F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    # Closed pairs at the bottom go first, so few brackets are walked.
    return F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["most"])


def leaves(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per scalar or empty container of every parsed payload.

    The first levels are a chain of outer explodes: rows that are already leaves
    pass through, containers open by one level. What is still a container then is
    opened inside its own row, round by round, as often as that container nests,
    and exploded once. So the plan has one length for all corpora and streams,
    a document pays for its own depth only, and nothing is parsed or counted
    beforehand. There is no shuffle or union.

    ``keep`` names payload columns repeated on every leaf. Parts of a document
    that was cut (:mod:`slim.operators.large`) bring their own ``steps`` and ``ord``.
    """
    cut = "steps" in parsed.columns
    steps = F.col("steps") if cut else F.array().cast("array<string>").alias("steps")
    order = F.col("ord") if cut else F.array().cast("array<int>").alias("ord")
    keep = (*identity(parsed)[1:], *keep)
    return _as_leaves(_finished(_opened(parsed.select("payload_id", *keep, steps, order, "v"), CHAIN, keep), keep), keep)


# Levels that are opened row by row; passing a leaf through one costs far less
# than opening a small container inside its row.
CHAIN = 8


def _open_container(v: Column, t: Column) -> Column:
    return (t.startswith("OBJECT<") & (t != "OBJECT<>")) | (t.startswith("ARRAY<") & ~((t == "ARRAY<VOID>") & (v.cast("string") == "[]")))


def _children(x: Column) -> Column:
    """The members of a node (steps, ord, v) as such nodes; of a leaf itself."""
    members = F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>"))
    items = F.try_variant_get(x["v"], "$", "array<variant>")

    def node(step: Column, i: Column, v: Column) -> Column:
        return F.struct(F.array_append(x["steps"], step).alias("steps"), F.array_append(x["ord"], i).alias("ord"), v.alias("v"))

    def of_object(m: Column) -> Column:
        escaped = lambda k: F.when(k.rlike(r"^[\[\\]"), F.concat(F.lit("\\"), k)).otherwise(k)
        return F.when(F.size(m) > 0, F.transform(m, lambda e, i: node(escaped(e["key"]), i, e["value"])))

    def of_list(m: Column) -> Column:
        return F.when(F.size(m) > 0, F.transform(m, lambda v, i: node(F.concat(F.lit("["), i, F.lit("]")), i, v)))

    return F.coalesce(let(members, of_object), let(items, of_list), F.array(x))


def _finished(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Rows whose value is still a container become its leaves; adds the type ``t``."""
    start = F.array(F.struct("steps", "ord", "v"))
    rounds = F.sequence(F.lit(1), nesting_depth(F.col("v")))
    below = F.aggregate(rounds, start, lambda front, _: F.flatten(F.transform(front, _children)))
    rows = rows.select("payload_id", *keep, "steps", "ord", "v", F.schema_of_variant("v").alias("t"))
    rows = rows.select("*", F.explode_outer(F.when(_open_container(F.col("v"), F.col("t")), below)).alias("_b"))
    through = lambda c, below: F.when(F.col("_b").isNull(), F.col(c)).otherwise(below).alias(c)
    own = [through(c, F.col(f"_b.{c}")) for c in ("steps", "ord", "v")]
    return rows.select("payload_id", *keep, *own, through("t", F.schema_of_variant("_b.v")))


def _opened(rows: DataFrame, levels: int, keep: tuple[str, ...]) -> DataFrame:
    """Rows (payload_id, kept, steps, ord, v) with their containers opened ``levels`` times."""
    kept = "".join(f"`{c}`, " for c in keep)
    text = f"SELECT payload_id, {kept} steps, ord, v FROM {{docs}}"
    for _ in range(levels):
        text = f"""SELECT payload_id, {kept}
            if(e.pos IS NULL, steps, array_append(steps, {STEP_SQL})) steps,
            if(e.pos IS NULL, ord, array_append(ord, e.pos)) ord,
            if(e.pos IS NULL, v, e.value) v
            FROM ({text}), LATERAL variant_explode_outer(v) e"""
    return rows.sparkSession.sql(text, docs=rows)


def _as_leaves(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    kept = "".join(f"`{c}`, " for c in keep)
    kind = KIND_SQL.format(t="t", v="v").replace("{", "{{").replace("}", "}}")
    text = f"""SELECT payload_id, {kept} steps, ord, kind, if(kind IN ('null', '[]', '{{{{}}}}'), NULL, CAST(v AS STRING)) scalar
        FROM (SELECT *, {kind} kind FROM {{docs}})"""
    return rows.sparkSession.sql(text, docs=rows)


def payload_leaves(payloads: DataFrame, json_col: str = "raw") -> DataFrame:
    """Spread, parse and shred a payload table; unparsable rows have no leaves.
    Texts too large for a VARIANT are cut into parts first."""
    rows = payloads.select("payload_id", F.col(json_col).alias("raw"), F.xxhash64("payload_id", json_col).alias("doc"))
    none = {"steps": F.array().cast("array<string>"), "ord": F.array().cast("array<int>"), "copy": F.lit(None).cast("bigint")}
    whole = rows.where(~is_large(F.col("raw"))).withColumns(none)
    cut = cut_documents(rows.where(is_large(F.col("raw"))).withColumn("copy", F.monotonically_increasing_id()))
    placed = spread(whole.unionByName(cut.drop("n_items", "gate")))
    # Copies that were not cut are numbered where they arrived, below zero.
    placed = placed.withColumn("copy", F.coalesce("copy", -1 - F.monotonically_increasing_id()))
    return leaves(parse(placed).drop("raw")).where("kind != 'none'")
