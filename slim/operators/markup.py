"""HTML pages as token and element tables, visible text and markdown.

A page is one row and stays one row until its tokens are asked for: tokens
live in an array, so noise removal, text and markdown are projections without
any shuffle. Only the matching of opening and closing tags is a stack walk; it
runs over Arrow batches of short tag codes (:func:`nesting`).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from html.entities import name2codepoint

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slim.functions.text import MAX_CHARS, let, truncate_text
from slim.sources.pages import host_of

# Token grammar, tag classes, entities and markdown marks.
TOKEN_PATTERN = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]+>|[^<]+|<"
TAG_NAME = r"^</?([A-Za-z][A-Za-z0-9:-]*)"
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
NOISE_TAGS = ("nav", "footer", "aside", "head", "noscript", "template")
AD_CLASSES = ("ad", "ads", "advert", "advertisement", "sponsored")
BLOCK_TAGS = (
    "p", "div", "article", "section", "main", "header", "footer", "nav", "aside", "ul", "ol", "table", "tr",
    "blockquote", "pre", "form", "figure", "body", "html", "title", "head",
)
HEADINGS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### "}
EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
CELL_TAGS = ("td", "th")
NUMBERED = {"li": ("+ol", "+ul"), "td": ("+tr",), "th": ("+tr",)}
REFERENCE = r"&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]*);"
# Named characters of the standard library's table; a no-break space is shown as a space.
ENTITIES = {**{name: chr(point) for name, point in name2codepoint.items()}, "apos": "'", "nbsp": " "}
# What the numbers 128 to 159 stand for on pages: the Windows code page.
C1_CHARS = bytes(range(128, 160)).decode("cp1252", "replace")
# Spaces, tabs and line ends of preformatted text, until the lines around it are tidied.
PROTECTED = "\ue000\ue001\ue002"
FRONT_MATTER = r"(?s)\A---\n.*?\n---\n*"


def _character(ref: Column) -> Column:
    """The character a reference stands for; the reference itself if none."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def of_number(n: Column) -> Column:
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return (
            F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd")
            .when(n == 160, " ")
            .when(n.between(128, 159), F.substring(F.lit(C1_CHARS), (n - 127).cast("int"), F.lit(1)))
            .otherwise(char)
        )

    hexed = ref.rlike("^&#[xX]")
    digits = F.regexp_extract(ref, "([0-9A-Fa-f]+);$", 1)
    number = F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
    return F.when(ref.startswith("&#"), let(number, of_number)).otherwise(
        F.coalesce(F.try_element_at(named, F.substring(ref, F.lit(2), F.length(ref) - 2)), ref)
    )


def decode_entities(col: Column) -> Column:
    """Character references, named and numeric, decoded once."""
    refs = F.regexp_extract_all(col, F.lit(REFERENCE), F.lit(0))
    chars = F.concat(F.transform(refs, _character), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(col, REFERENCE), chars, lambda part, char: F.concat(part, char)), "")
    return F.when(col.rlike(REFERENCE), joined).otherwise(col)


def attribute(token: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, empty without a value, NULL
    if absent."""
    found = F.lower(token).contains(name) & token.rlike(rf"(?is)\s{name}(\s|=|>|/)")
    value = F.regexp_extract(token, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    text = F.regexp_replace(F.regexp_replace(value, rf"(?is)^\s{name}\s*=\s*", ""), "^[\"']|[\"']$", "")
    return F.when(found, let(text, decode_entities))


def _kind(token: Column) -> Column:
    return (
        F.when(~token.startswith("<"), "text")
        .when(token.startswith("<!--"), "comment")
        .when(token.rlike(r"(?i)^<(script|style)[\s>/]"), "raw")
        .when(token.startswith("<!") | token.startswith("<?"), "decl")
        .when(token.rlike("^</[A-Za-z]"), "close")
        .when(token.rlike("^<[A-Za-z]"), "open")
        .otherwise("text")
    )


NESTING_TYPE = T.StructType(
    [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("close", "depth", "parent", "opener", "extra")]
    + [T.StructField("inside", T.ArrayType(T.BooleanType()))]
)


def _pages_of(lists: pa.ListArray) -> Iterator[list]:
    """The lists one after the other, so that only one page is Python objects at
    a time; -1 for null numbers."""
    bounds, values = lists.offsets.to_numpy().tolist(), lists.values
    if pa.types.is_integer(values.type):
        values = values.fill_null(-1)
    for start, stop in zip(bounds, bounds[1:]):
        yield values.slice(start, stop - start).to_numpy(zero_copy_only=False).tolist()


@F.arrow_udf(NESTING_TYPE)
def nesting(codes: pa.Array, flags: pa.Array) -> pa.Array:
    """Match tags the way lenient HTML readers do: a closing tag closes the
    latest open element of its name and everything opened since; a closing tag
    without such an element is ignored; what is open at the end closes there.

    ``codes`` holds ``+tag``, ``-tag``, ``.tag`` (spans itself) or an empty
    string per token. ``inside`` tells tokens within a flagged element. ``extra``
    numbers items within the ordered list and cells within the row around them;
    for other tokens it is 1 within preformatted text, else 0.
    """
    out = {"close": array("i"), "depth": array("i"), "parent": array("i"), "opener": array("i"), "extra": array("i"), "inside": array("b")}
    sizes = [0]
    for page, marks in zip(_pages_of(codes), _pages_of(flags)):
        n = len(page)
        # -1 stands for null.
        close, depth, parent, opener, extra, inside = [-1] * n, [0] * n, [-1] * n, [-1] * n, [0] * n, [False] * n
        stack, names, flagged, numbered = [], {}, 0, {}
        for i, code in enumerate(page):
            mark, name = code[:1], code[1:]
            if mark == "-" and names.get(name):
                while True:
                    top = stack.pop()
                    label = page[top][1:]
                    names[label] -= 1
                    flagged -= bool(marks[top])
                    if label == name:
                        break
                    close[top] = i - 1
                close[top], opener[i] = i, top
                inside[i] = flagged > 0 or bool(marks[top])
            else:
                inside[i] = flagged > 0 or bool(marks[i])
            depth[i] = len(stack)
            parent[i] = stack[-1] if stack else -1
            if mark == "+" and name in NUMBERED:
                around = next((p for p in reversed(stack) if page[p] in NUMBERED[name]), None)
                if around is not None and page[around] != "+ul":
                    extra[i] = numbered[around] = numbered.get(around, 0) + 1
            elif name not in NUMBERED:
                extra[i] = int(names.get("pre", 0) > 0)
            if mark == "+":
                stack.append(i)
                names[name] = names.get(name, 0) + 1
                flagged += bool(marks[i])
            elif mark == ".":
                close[i] = i
        for top in stack:
            close[top] = n - 1
        sizes.append(sizes[-1] + n)
        for key, value in zip(out, (close, depth, parent, opener, extra, inside)):
            out[key].fromlist(value)
    return _struct_of_lists(NESTING_TYPE.names, out.values(), sizes)


# Declared non-deterministic so that filters on its results stay above it and
# the walk runs once per page.
nesting = nesting.asNondeterministic()



def _struct_of_lists(names: list[str], columns: Iterable[array], sizes: list[int]) -> pa.StructArray:
    """Lists of numbers (-1 is null) or flags as fields of one struct."""
    offsets, fields = pa.array(sizes, pa.int32()), []
    for column in columns:
        values = np.asarray(column)
        made = pa.array(values.astype(bool)) if column.typecode == "b" else pa.array(values, pa.int32(), mask=values == -1)
        fields.append(pa.ListArray.from_arrays(offsets, made))
    return pa.StructArray.from_arrays(fields, names)


KIN_TYPE = T.StructType([T.StructField(n, T.ArrayType(T.BooleanType())) for n in ("child", "under")])


@F.arrow_udf(KIN_TYPE)
def kin(parents: pa.Array, flags: pa.Array) -> pa.Array:
    """Per node whether its enclosing element is flagged (``child``) and
    whether any element around it is (``under``)."""
    every, sizes = (array("b"), array("b")), [0]
    for up, marks in zip(_pages_of(parents), _pages_of(flags)):
        child, under = [False] * len(up), [False] * len(up)
        for i, p in enumerate(up):
            if p >= 0:
                child[i] = marks[p]
                under[i] = child[i] or under[p]
        sizes.append(sizes[-1] + len(up))
        every[0].fromlist(child)
        every[1].fromlist(under)
    return _struct_of_lists(KIN_TYPE.names, every, sizes)


kin = kin.asNondeterministic()


def page_tokens(pages: DataFrame) -> DataFrame:
    """``(page_id, url, raw_chars, _t)``: the tokens of each page with position,
    kind and tag, in one projection."""
    tokens = F.regexp_extract_all("html", F.lit(TOKEN_PATTERN), F.lit(0))

    def node(token: Column, i: Column) -> Column:
        def shaped(kind: Column) -> Column:
            tag = F.when(kind.isin("open", "close", "raw"), F.lower(F.regexp_extract(token, TAG_NAME, 1)))
            return F.struct(i.alias("pos"), kind.alias("kind"), tag.alias("tag"), token.alias("token"))

        return let(_kind(token), shaped)

    def settled(t: Column) -> Column:
        void = (t["kind"] == "open") & (t["tag"].isin(*VOID_TAGS) | t["token"].endswith("/>"))
        return F.when(void, t.withField("kind", F.lit("void"))).otherwise(t)

    return pages.select(
        "page_id",
        "url",
        F.char_length("html").cast("bigint").alias("raw_chars"),
        F.transform(F.transform(tokens, node), settled).alias("_t"),
    )


def page_nodes(pages: DataFrame) -> DataFrame:
    """``(page_id, url, raw_chars, nodes)``; a node is a token with its kind,
    tag, nesting and whether it is page noise (navigation, footers, asides,
    advertisements, scripts, styles, comments, the head)."""
    toks = page_tokens(pages)
    code = F.transform(
        "_t",
        lambda t: F.when(t["kind"] == "open", F.concat(F.lit("+"), t["tag"]))
        .when(t["kind"] == "close", F.concat(F.lit("-"), t["tag"]))
        .when(t["kind"].isin("void", "raw"), F.concat(F.lit("."), t["tag"]))
        .otherwise(""),
    )
    flag = F.transform(
        "_t",
        lambda t: F.coalesce(
            (t["kind"] == "open")
            & (t["tag"].isin(*NOISE_TAGS) | F.arrays_overlap(class_list(t["token"]), F.array(*map(F.lit, AD_CLASSES)))),
            F.lit(False),
        ),
    )
    nested = toks.withColumn("_n", nesting(code, flag))

    def whole(t: Column, i: Column) -> Column:
        at = lambda name: F.get(F.col(f"_n.{name}"), i).alias(name)
        noise = F.get(F.col("_n.inside"), i) | t["kind"].isin("comment", "raw", "decl")
        return F.struct(
            t["pos"].alias("pos"), t["kind"].alias("kind"), t["tag"].alias("tag"), t["token"].alias("token"),
            at("close"), at("depth"), at("parent"), at("opener"), at("extra"), noise.alias("noise"),
        )

    return nested.select("page_id", "url", "raw_chars", F.transform("_t", whole).alias("nodes"))


def class_list(token: Column) -> Column:
    return F.split(F.coalesce(attribute(token, "class"), F.lit("")), r"\s+")


def markup_tokens(pages: DataFrame) -> DataFrame:
    """Every token in order: ``(page_id, pos, kind, tag, token)``."""
    return page_tokens(pages).select("page_id", F.inline("_t")).select("page_id", "pos", "kind", "tag", "token")


def element_spans(pages: DataFrame) -> DataFrame:
    """Every element with its token range, depth and enclosing element."""
    spans = F.filter("nodes", lambda n: n["kind"].isin("open", "void", "raw"))
    return (
        page_nodes(pages)
        .select("page_id", F.inline(spans))
        .select("page_id", F.col("pos").alias("open_pos"), F.col("close").alias("close_pos"), "depth", "parent", "tag", "token")
    )


def drop_noise(nodes: DataFrame) -> DataFrame:
    """Nodes without scripts, styles, comments, navigation, footers, asides,
    advertisements and the head."""
    return nodes.withColumn("nodes", F.filter("nodes", lambda n: ~n["noise"]))


def squeeze(col: Column) -> Column:
    return F.regexp_replace(col, r"[ \t\r\n\f]+", " ")


def visible_text(nodes: DataFrame) -> DataFrame:
    """``(page_id, text)``: decoded text tokens, whitespace collapsed."""
    texts = F.transform(F.filter("nodes", lambda n: n["kind"] == "text"), lambda n: decode_entities(n["token"]))
    return nodes.select("page_id", F.trim(squeeze(F.array_join(texts, " "))).alias("text"))


def _mark(n: Column, nodes: Column) -> Column:
    """Markdown of one node."""
    opens, closes = n["kind"] == "open", n["kind"] == "close"
    tag = n["tag"]
    start = F.get(nodes, n["opener"])
    # An emphasis that is never closed explicitly is no emphasis.
    paired = F.when(opens, F.get(nodes, n["close"])["opener"] == n["pos"]).otherwise(n["opener"].isNotNull())
    heading = F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])
    emphasis = F.create_map(*[F.lit(x) for pair in EMPHASIS.items() for x in pair])
    href = F.coalesce(attribute(start["token"], "href"), F.lit(""))
    preformatted = n["extra"] == 1
    first_line = F.get(nodes, n["pos"] - 1)["tag"] == "pre"
    kept = F.when(first_line, F.regexp_replace(n["token"], r"\A\r?\n", "")).otherwise(n["token"])
    image = F.concat(F.lit("!["), F.coalesce(attribute(n["token"], "alt"), F.lit("")), F.lit("]("), attribute(n["token"], "src"), F.lit(")"))
    return (
        F.when((n["kind"] == "text") & preformatted, F.translate(decode_entities(kept), " \t\n\r", PROTECTED))
        .when(n["kind"] == "text", squeeze(decode_entities(n["token"])))
        .when(tag == "br", F.when(preformatted, PROTECTED[2]).otherwise("\n"))
        .when(tag == "img", F.coalesce(image, F.lit("")))
        .when((tag == "pre") & paired, F.when(opens, "\n\n```\n").otherwise("\n```\n\n"))
        .when(tag == "hr", "\n\n---\n\n")
        .when(tag.isin(*HEADINGS), F.when(opens, F.concat(F.lit("\n\n"), F.element_at(heading, tag))).otherwise("\n\n"))
        .when((tag == "li") & opens & (n["extra"] > 0), F.concat(F.lit("\n"), n["extra"].cast("string"), F.lit(". ")))
        .when(tag == "li", F.when(opens, "\n- ").otherwise(""))
        .when(tag.isin(*CELL_TAGS), F.when(opens & (n["extra"] > 1), " | ").otherwise(""))
        .when((tag == "a") & paired, F.when(opens, "[").otherwise(F.concat(F.lit("]("), href, F.lit(")"))))
        .when(tag.isin(*EMPHASIS) & paired, F.when(preformatted, "").otherwise(F.element_at(emphasis, tag)))
        .when(tag.isin(*BLOCK_TAGS) & (opens | closes), "\n\n")
        .otherwise("")
    )


def tidy(col: Column) -> Column:
    """Spaces around line ends go, blank lines collapse to one."""
    lines = F.regexp_replace(col, r" *\n *", "\n")
    tidied = F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"\A[ \n]+|[ \n]+\z", "")
    fenced = F.regexp_replace(tidied, PROTECTED[2] + "?\n```", "\n```")
    return F.when(tidied.contains("```"), F.translate(fenced, PROTECTED, " \t\n")).otherwise(tidied)


def markdown_of(part: Column, nodes: Column) -> Column:
    """Markdown of some nodes of a page (``nodes`` are all of them)."""
    return tidy(F.array_join(F.transform(part, lambda n: _mark(n, nodes)), ""))


def front_matter(title: Column, lang: Column, description: Column) -> Column:
    def line(name: str, col: Column) -> Column:
        return F.when(col.isNotNull(), F.concat(F.lit(f"{name}: "), col))

    return F.concat(
        F.lit("---\n"), F.concat_ws("\n", line("title", title), line("lang", lang), line("description", description)), F.lit("\n---\n\n")
    )


def strip_front_matter(col: Column) -> Column:
    return F.regexp_replace(col, FRONT_MATTER, "")


def _meta(nodes: Column) -> tuple[Column, Column, Column]:
    def first(cond):
        return F.get(F.filter(nodes, cond), F.lit(0))

    title_open = first(lambda n: (n["kind"] == "open") & (n["tag"] == "title"))
    # A title ends at its own closing tag or at that of an element around it.
    outer = F.transform(F.filter(F.slice(nodes, F.lit(1), title_open["pos"] + 1), lambda n: n["kind"] == "open"), lambda n: n["tag"])
    end = F.get(F.filter(nodes, lambda n: (n["kind"] == "close") & (n["pos"] > title_open["pos"]) & F.array_contains(outer, n["tag"])), F.lit(0))["pos"]
    inner = F.slice(nodes, title_open["pos"] + 1, F.coalesce(end, F.size(nodes)) - title_open["pos"])
    words = F.transform(F.filter(inner, lambda n: n["kind"] == "text"), lambda n: decode_entities(n["token"]))
    title = F.when(title_open.isNotNull(), F.trim(squeeze(F.array_join(words, ""))))
    html = first(lambda n: (n["kind"] == "open") & (n["tag"] == "html"))
    meta = first(
        lambda n: (n["tag"] == "meta") & (F.lower(F.coalesce(attribute(n["token"], "name"), F.lit(""))) == "description")
    )
    return title, attribute(html["token"], "lang"), attribute(meta["token"], "content")


def page_metadata(pages: DataFrame) -> DataFrame:
    """``(page_id, title, lang, description)``; NULL where a page has none."""
    title, lang, description = _meta(F.col("_t"))
    return page_tokens(pages).select("page_id", title.alias("title"), lang.alias("lang"), description.alias("description"))


def to_markdown(pages: DataFrame, max_chars: int | None = MAX_CHARS, with_metadata: bool = False) -> DataFrame:
    """``(page_id, url, raw_chars, markdown)`` without page noise; with
    metadata a front-matter block comes first."""
    nodes = F.col("nodes")
    body = markdown_of(F.filter(nodes, lambda n: ~n["noise"]), nodes)
    if with_metadata:
        body = F.concat(front_matter(*_meta(nodes)), body)
    out = page_nodes(pages).select("page_id", "url", "raw_chars", body.alias("markdown"))
    return out if max_chars is None else out.withColumn("markdown", truncate_text(F.col("markdown"), max_chars))


def text_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, host, block_no, block)``: blocks between blank lines,
    navigation and the like included."""
    nodes = F.col("nodes")
    shown = F.filter(nodes, lambda n: ~n["kind"].isin("comment", "raw", "decl"))
    blocks = F.filter(F.split(markdown_of(shown, nodes), "\n\n"), lambda b: b != "")
    return page_nodes(pages).select("page_id", host_of(F.col("url")).alias("host"), F.posexplode(blocks).alias("block_no", "block"))


def boilerplate_blocks(blocks: DataFrame, min_pages: int = 2, by: tuple[str, ...] = ("host",)) -> DataFrame:
    """Blocks found on at least ``min_pages`` pages of one host. A page counts
    once per block; both steps combine before the shuffle, and only hashes
    travel with the counts."""
    once = blocks.select(*by, F.sha2("block", 256).alias("block_hash"), "page_id").distinct()
    return once.groupBy(*by, "block_hash").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)


def strip_boilerplate(blocks: DataFrame, repeated: DataFrame, by: tuple[str, ...] = ("host",)) -> DataFrame:
    """Blocks that are not boilerplate of their host."""
    hashed = blocks.withColumn("block_hash", F.sha2("block", 256))
    return hashed.join(repeated.select(*by, "block_hash"), [*by, "block_hash"], "left_anti").drop("block_hash")
