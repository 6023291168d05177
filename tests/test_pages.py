"""Pages: nesting, noise, markdown, metadata, selectors, boilerplate."""

import random

import pytest
from pyspark.sql import functions as F

from slim import Css, css_query, select_elements, to_markdown
from slim.operators import markup
from slim.operators.markup import decode_entities, markup_tokens, page_metadata


def pages(spark, *html, url="https://h.example.com/p"):
    return spark.createDataFrame([(i, f"{url}{i}", h) for i, h in enumerate(html)], "page_id int, url string, html string")


def markdown(spark, html, **options):
    return to_markdown(pages(spark, html), **options).collect()[0].markdown


def test_headings_paragraphs_and_noise(spark):
    html = (
        "<html><head><title>T</title></head><body><nav>skip</nav><!-- c --><script>var x='<p>'</script><style>p{}</style>"
        "<h1>Hello</h1><p>World &amp; <b>all</b><br>two</p><div class='box ad'>buy</div><aside>x</aside>"
        "<ul><li>a<li><a href=\"/q?a=1&amp;b=2\">b</a></ul><footer>f</footer></body></html>"
    )
    assert markdown(spark, html) == "# Hello\n\nWorld & **all**\ntwo\n\n- a\n- [b](/q?a=1&b=2)"


def test_truncation_and_empty_input(spark):
    out = markdown(spark, "<p>" + "x" * 1000 + "</p>", max_chars=100)
    assert out == "x" * 100 + "\n\n[... truncated]"
    assert markdown(spark, "") == "" and "truncated" not in markdown(spark, "<p>short</p>")


def test_front_matter(spark):
    html = "<html lang='de'><head><title>My  Page</title><meta name=description content='about it'></head><body><p>c</p></body></html>"
    assert markdown(spark, html, with_metadata=True) == "---\ntitle: My Page\nlang: de\ndescription: about it\n---\n\nc"
    assert markdown(spark, html) == "c"
    row = markup.page_metadata(pages(spark, html, "<p>x</p>")).orderBy("page_id").collect()
    assert (row[0].title, row[0].lang, row[0].description) == ("My Page", "de", "about it")
    assert row[1].title is None and row[1].lang is None


def test_unclosed_emphasis_is_plain(spark):
    assert markdown(spark, "<p><b>one<p>two</p>") == "one\n\ntwo"


def expected_spans(html_tokens):
    """Open elements as a list; an end tag closes back to its own start."""
    open_now, spans = [], []
    for pos, token in enumerate(html_tokens):
        name = token.strip("</>")
        if token.startswith("</"):
            if any(n == name for n, _ in open_now):
                while True:
                    n, start = open_now.pop()
                    spans.append((n, start, pos if n == name else pos - 1))
                    if n == name:
                        break
        elif token.startswith("<"):
            open_now.append((name, pos))
    return sorted(spans + [(n, start, len(html_tokens) - 1) for n, start in open_now])


def test_nesting_of_malformed_pages(spark):
    rng = random.Random(3)
    docs = [[rng.choice(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>"]) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    rows = markup.element_spans(pages(spark, *["".join(d) for d in docs])).collect()
    for i, doc in enumerate(docs):
        got = sorted((r.tag, r.open_pos, r.close_pos) for r in rows if r.page_id == i)
        assert got == expected_spans(doc)


@pytest.mark.parametrize(
    "selector, found",
    [
        ([[Css("p")]], ["p", "p"]),
        ([[Css(id="x")]], ["p"]),
        ([[Css(classes=("one", "two"))]], ["div"]),
        ([[Css(attr="href")]], ["a"]),
        ([[Css(attr="href", value="/z")]], []),
        ([[Css("div"), " ", Css("a")]], ["a"]),
        ([[Css("div"), ">", Css("a")]], []),
        ([[Css("div"), ">", Css("p"), ">", Css("a")], [Css("h1")]], ["h1", "a"]),
    ],
)
def test_selectors(spark, selector, found):
    html = "<h1>t</h1><div class='two  one'><p id=x>a <a href='/y'>l</a></p></div><p>b</p>"
    rows = select_elements(pages(spark, html), selector).orderBy("open_pos").collect()
    assert [r.tag for r in rows] == found


def test_css_query(spark):
    df = pages(spark, "<ul><li>a</li><li><b>b</b></li></ul>", "<p>x</p>")
    rows = {r.page_id: (r.n, r.result) for r in css_query(df, [[Css("li")]], "li").collect()}
    assert rows == {0: (2, "- a\n\n---\n\n- **b**"), 1: (0, "No elements matched selector: li")}
    rows = {r.page_id: r.result for r in css_query(df, [[Css("li")]], "li", rendered=True).collect()}
    assert rows[0] == "- a\n- **b**"
    cut = css_query(pages(spark, "<p>" + "y" * 30 + "</p>"), [[Css("p")]], "p", max_chars=10).collect()[0].result
    assert cut == "y" * 10 + "\n\n[... truncated]"


def test_boilerplate_by_host(spark):
    same = "<p>menu</p><p>own {}</p>"
    df = pages(spark, *[same.format(i) for i in range(3)]).unionByName(
        pages(spark, "<p>menu</p>", url="https://other.example.com/").selectExpr("page_id + 10 AS page_id", "url", "html")
    )
    blocks = markup.text_blocks(df)
    repeated = markup.boilerplate_blocks(blocks, 3)
    assert [(r.host, r.n_pages) for r in repeated.collect()] == [("h.example.com", 3)]
    left = {(r.page_id, r.block) for r in markup.strip_boilerplate(blocks, repeated).collect()}
    assert left == {(0, "own 0"), (1, "own 1"), (2, "own 2"), (10, "menu")}


def test_page_rendering_needs_no_exchange(spark):
    plan = to_markdown(pages(spark, "<p>x</p>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_references_lists_images_and_preformatted_text(spark):
    cases = {
        "<p>it&#8217;s caf&eacute; &#x2014; 5 &lt; 6 &amp;lt; &unknown; &#150; &#0; &NoBreak; a&b; &nbsp;&#160;x</p>": "it’s café — 5 < 6 &lt; &unknown; – � &NoBreak; a&b; x",
        "<ol><li>one<li>two<ul><li>in</li></ul></li><li>three</ol><ol><li>again</li></ol>": "1. one\n2. two\n\n- in\n\n3. three\n\n1. again",
        "<p>see <img alt='a &amp; b' src='/x.png'> and <img src=y> <img alt=z></p>": "see ![a & b](/x.png) and ![](y)",
        "<pre>\nif x:\n    y = <b>1</b>\n\n\n  z &lt; 2\n</pre><p>after   all</p>": "```\nif x:\n    y = 1\n\n\n  z < 2\n```\n\nafter all",
        "<pre>open": "open",
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1<td>2</tr></table>": "a | b\n\n1 | 2",
        "<p><code>x</code> <pre><code>a  b</code></pre>": "`x`\n\n```\na  b\n```",
    }
    pages = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["markdown"] for r in to_markdown(pages).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_every_character_reference(spark):
    from html.entities import name2codepoint

    numbers = [*range(1, 128), *range(160, 0x300), 0x20AC, 0x1F600, 0x10FFFF]
    text = {f"&{n};": chr(c) for n, c in name2codepoint.items() if n != "nbsp"} | {f"&#{n};": chr(n) for n in numbers if n != 160} | {f"&#x{n:X};": chr(n) for n in numbers if n != 160}
    text |= {"&nbsp;": " ", "&#55296;": "\ufffd", "&#999999999;": "\ufffd", "&#1114112;": "\ufffd", "&#128;": "€", "&;": "&;", "&#;": "&#;"}
    frame = spark.createDataFrame([(k,) for k in text], "t string")
    got = {r["t"]: r["d"] for r in frame.select("t", decode_entities(F.col("t")).alias("d")).collect()}
    assert {k: v for k, v in got.items() if text[k] != v} == {}


def test_metadata_and_tokens_need_no_walk(spark):
    pages = spark.createDataFrame([(1, "u", "<html lang=en><head><title>a <b>c</b></title><meta name=description content='d'></head>"), (2, "u", "<head><title>x</head>y"), (3, "u", "<title>z"), (4, "u", "no")], "page_id long, url string, html string")
    rows = page_metadata(pages)
    assert {r["page_id"]: (r["title"], r["lang"], r["description"]) for r in rows.collect()} == {1: ("a c", "en", "d"), 2: ("x", None, None), 3: ("z", None, None), 4: (None, None, None)}
    for df in (rows, markup_tokens(pages)):
        assert "Python" not in df._jdf.queryExecution().toString() and "ArrowEval" not in df._jdf.queryExecution().toString()
