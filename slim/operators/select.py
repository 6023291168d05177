"""Selecting page elements and rendering them.

A selector is a list of alternatives; an alternative is a list of
:class:`Css` steps with the combinators ``" "`` (descendant) or ``">"``
(child) between them, e.g. ``[[Css("nav"), " ", Css("a")], [Css("h1")]]``.
Matching works on the node array of each page: no rows are paired.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slim.functions.text import MAX_CHARS, let, truncate_text
from slim.operators.markup import attribute, class_list, kin, markdown_of, page_nodes

RULE = "\n\n---\n\n"


@dataclass(frozen=True)
class Css:
    """One compound: tag, id, classes, an attribute (with or without value)."""

    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attr: str | None = None
    value: str | None = None

    def test(self, n: Column) -> Column:
        ok = n["kind"].isin("open", "void", "raw")
        if self.tag is not None:
            ok = ok & (n["tag"] == self.tag.lower())
        if self.id is not None:
            ok = ok & (attribute(n["token"], "id") == self.id)
        for name in self.classes:
            ok = ok & F.array_contains(class_list(n["token"]), name)
        if self.attr is not None:
            found = attribute(n["token"], self.attr)
            ok = ok & (found.isNotNull() if self.value is None else found == self.value)
        return F.coalesce(ok, F.lit(False))


def _matched(nodes: DataFrame, selector: list[list]) -> DataFrame:
    """Adds ``hits``: the matching nodes in document order. Flags travel as
    arrays beside the nodes and are zipped with them, one pass per step."""
    marks = []
    for a, steps in enumerate(selector):
        mark, combinator = None, None
        for s, step in enumerate(steps):
            if isinstance(step, str):
                combinator = step
            elif mark is None:
                mark = F.transform("nodes", step.test)
            else:
                related = f"_k{a}_{s}"
                nodes = nodes.withColumn(related, kin(F.col("nodes.parent"), mark))
                side = f"{related}.child" if combinator == ">" else f"{related}.under"
                test = step.test
                mark = F.zip_with("nodes", F.col(side), lambda n, k: test(n) & k)
        marks.append(mark)
    either = marks[0]
    for mark in marks[1:]:
        either = F.zip_with(either, mark, lambda x, y: x | y)
    hits = F.filter(F.zip_with("nodes", either, lambda n, m: F.when(m, n)), lambda n: n.isNotNull())
    return nodes.select("page_id", "url", "raw_chars", "nodes", hits.alias("hits"))


def select_elements(pages: DataFrame, selector: list[list]) -> DataFrame:
    """``(page_id, open_pos, close_pos, tag, token)`` of matching elements."""
    return (
        _matched(page_nodes(pages), selector)
        .select("page_id", F.inline("hits"))
        .select("page_id", F.col("pos").alias("open_pos"), F.col("close").alias("close_pos"), "tag", "token")
    )


def css_query(
    pages: DataFrame, selector: list[list], label: str, max_chars: int = MAX_CHARS, rendered: bool = False
) -> DataFrame:
    """``(page_id, url, n, raw_chars, result)``: the matching elements as
    markdown, or the message that nothing matched.

    Elements are rendered one by one, truncated, joined by a rule and
    truncated again. ``rendered`` puts the fragments behind each other with a
    space between them and renders once.
    """
    nodes = F.col("nodes")
    plain = lambda part: F.filter(part, lambda n: ~n["kind"].isin("comment", "raw", "decl"))
    piece = lambda h: F.slice(nodes, h["pos"] + 1, h["close"] - h["pos"] + 1)
    if rendered:
        # A text node of one space between two fragments: those of a line stay on it.
        gap = lambda h: F.array(F.get(nodes, h["pos"]).withField("kind", F.lit("text")).withField("token", F.lit(" ")))
        result = markdown_of(F.flatten(F.transform("hits", lambda h: F.concat(plain(piece(h)), gap(h)))), nodes)
    else:
        texts = F.transform(
            "hits", lambda h: let(markdown_of(plain(piece(h)), nodes), lambda md: truncate_text(md, max_chars))
        )
        result = F.array_join(texts, RULE)
    miss = F.lit(f"No elements matched selector: {label}")
    found = _matched(page_nodes(pages), selector).select(
        "page_id", "url", F.size("hits").cast("bigint").alias("n"), "raw_chars", result.alias("joined")
    )
    shown = F.when(F.col("n") == 0, miss).otherwise(truncate_text(F.col("joined"), max_chars))
    return found.select("page_id", "url", "n", "raw_chars", shown.alias("result"))
