"""The queries of :mod:`slim.catalog` as DuckDB SQL, written from the base
tables: what a view must contain is stated directly, not by repeating the
processing steps. Queries without an entry have no SQL equivalent."""

from __future__ import annotations

import re

# Fixed value: Unicode white space and the ASCII separators.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

LINES = """lines AS (
  SELECT d.doc_id AS payload_id, d.source, d.lang, u.i - 1 AS i, u.line, length(u.line) AS chars,
         'https://docs.example.com/' || d.doc_id AS link
  FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(line, i))"""

TEXT_KEPT = (
    f"NOT regexp_full_match(line, '{SPACE}*') AND NOT "
    r"((starts_with(line, 'http://') OR starts_with(line, 'https://')) AND regexp_matches(line, '\{[^}]+\}'))"
)
LONG = "CASE WHEN chars > 500 THEN 'true' ELSE 'false' END"

# (key path, position, kind, value)
DOC_LEAVES = [
    ("chars", "0", "int", "CAST(chars AS VARCHAR)"),
    ("detail_url", "1", "string", "link || '/' || i || '{/rev}'"),
    ("gift", "2", "null", "NULL"),
    ("line", "3", "int", "CAST(i + 1 AS VARCHAR)"),
    ("link", "4", "string", "link"),
    ("note", "5", "string", "'  '"),
    ("origin.lang", "6.0", "string", "lang"),
    ("origin.name", "6.1", "string", "source"),
    ("seen", "7", "bool", "'false'"),
    ("shape.band", "8.0", "int", "CAST(chars // 200 AS VARCHAR)"),
    ("shape.long", "8.1", "bool", LONG),
    ("tags", "9", "[]", "NULL"),
    ("text", "10", "string", "line"),
]

ORIGIN = """'{"lang":' || to_json(lang) || ',"name":' || to_json(source) || '}'"""
SHAPE = f"""'{{"band":' || (chars // 200) || ',"long":' || {LONG} || '}}'"""

# (key, JSON text, kept) of the members of an item, keys in order
DOC_MEMBERS = [
    ("chars", "CAST(chars AS VARCHAR)", "true"),
    ("line", "CAST(i + 1 AS VARCHAR)", "true"),
    ("link", "CAST(to_json(link) AS VARCHAR)", "true"),
    ("origin", ORIGIN, "true"),
    ("seen", "'false'", "true"),
    ("shape", SHAPE, "true"),
    ("text", "CAST(to_json(line) AS VARCHAR)", TEXT_KEPT),
]

# Leaves of an event payload: path, kind, value, pruned because: url, empty or
# nothing ("-"); "in" marks the inside of a list below the flatten depth 5.
CARD = "$.event.who.user.card"
EVENT_LEAVES = [
    ("$.event.id", "int", "event_id", "-"),
    ("$.event.what.deep.list[0]", "null", "NULL", "empty"),
    ("$.event.what.deep.list[1]", "[]", "NULL", "empty"),
    ("$.event.what.deep.list[2].e", "null", "NULL", "empty"),
    ("$.event.what.marks[0]", "null", "NULL", "empty"),
    ("$.event.what.marks[1]", "int", "event_id", "-"),
    ("$.event.what.marks[2]", "string", "''", "empty"),
    ("$.event.what.marks[3][0]", "null", "NULL", "empty"),
    ("$.event.what.marks[3][1]", "string", "event_type", "-"),
    ("$.event.what.marks[4].n", "null", "NULL", "empty"),
    ("$.event.what.marks[5]", "string", "'end'", "-"),
    ("$.event.what.pad", "string", "''", "empty"),
    ("$.event.what.props.k", "int", "json_extract_string(props, '$.k')", "-"),
    ("$.event.what.type", "string", "event_type", "-"),
    ("$.event.what.void", "{}", "NULL", "empty"),
    (f"{CARD}.geo.x", "int", "event_id % 90", "-"),
    (f"{CARD}.geo.y", "null", "NULL", "empty"),
    (f"{CARD}.geo.z[0].q", "int", "event_id % 7", "in"),
    (f"{CARD}.geo.z[0].r", "null", "NULL", "in"),
    (f"{CARD}.geo.x", "int", "event_id % 7", "-"),
    (f"{CARD}.home", "string", "'https://u.example.com/' || user_id || '{?tab}'", "url"),
    (f"{CARD}.mail", "string", "'u' || user_id || '@example.com'", "-"),
    (f"{CARD}.none", "null", "NULL", "empty"),
    (f"{CARD}.urls[0]", "string", "'https://u.example.com/' || user_id || '/{n}'", "-"),
    (f"{CARD}.urls[1]", "string", "''", "empty"),
    ("$.event.who.user.id", "int", "user_id", "-"),
    ("$.ok", "bool", "'false'", "-"),
    ("$.self", "string", "'https://e.example.com/' || event_id || '{#part}'", "url"),
    ("$.zero", "int", "0", "-"),
]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _doc_leaves(columns: str) -> str:
    parts = []
    for path, pos, kind, value in DOC_LEAVES:
        values = {
            "path": f"'$[' || i || '].{path}' AS path",
            "ord": f"i || '.{pos}' AS ord",
            "kind": f"'{kind}' AS kind",
            "scalar": f"CAST({value} AS VARCHAR) AS scalar",
        }
        cols = ", ".join(values[c] for c in columns.split())
        parts.append(f"SELECT payload_id, {cols} FROM lines")
    return f"WITH {LINES} {_union(parts)}"


def _event_leaves(keep, paths: dict | None = None) -> str:
    parts = []
    for path, kind, value, why in EVENT_LEAVES:
        if keep(path, why):
            shown = (paths or {}).get(path, path)
            parts.append(
                f"SELECT event_id AS payload_id, '{shown}' AS path, '{kind}' AS kind, CAST({value} AS VARCHAR) AS scalar FROM events"
            )
    return _union(parts)


NESTED_X = "event_id % 90"


def _steps(path: str, value: str) -> list[str | int]:
    if path == f"{CARD}.geo.x" and value != NESTED_X:
        return [*_steps(CARD, ""), "geo.x"]
    return [int(s[:-1]) if s[-1] == "]" else s for s in re.split(r"\.|\[", path.removeprefix("$."))]


def _placed_leaves(keep, compact: bool) -> str:
    """Leaves of the events with their positions: keys count in sorted order,
    items as they are or, compacted, those that are kept. Lists in the card are
    not compacted, as it is flattened there."""
    every = [_steps(path, value) for path, _, value, _ in EVENT_LEAVES]
    shown = [s for s, (path, _, value, why) in zip(every, EVENT_LEAVES) if keep(path, value, why)]
    parts = []
    for steps, (path, kind, value, why) in zip(every, EVENT_LEAVES):
        if not keep(path, value, why):
            continue
        order = []
        for n, step in enumerate(steps):
            within = shown if compact and isinstance(step, int) and "geo" not in steps else every
            order.append(sorted({s[n] for s in within if s[:n] == steps[:n]}).index(step))
        text = "".join(f"[{o}]" if isinstance(s, int) else f".{s}" for s, o in zip(steps, order)) if compact else path[1:]
        parts.append(
            f"SELECT event_id AS payload_id, '${text}' AS path, '{'.'.join(map(str, order))}' AS ord, '{kind}' AS kind, CAST({value} AS VARCHAR) AS scalar FROM events"
        )
    return _union(parts)


def _members() -> str:
    parts = [
        f"SELECT payload_id, i, '{key}' AS key, {text} AS text FROM lines" + ("" if kept == "true" else f" WHERE {kept}")
        for key, text, kept in DOC_MEMBERS
    ]
    return f"{LINES}, members AS ({_union(parts)})"


# What pruning and factoring makes of a document: the members of all items,
# which keys are the same in all of them, which sub-objects repeat.
FACTS = f"""{_members()},
items AS (SELECT payload_id, max(i) + 1 AS n FROM lines GROUP BY 1),
uniform AS (
  SELECT payload_id, key, any_value(kind) AS kind, min(text) AS text, min(scalar) AS scalar FROM (
    SELECT m.payload_id, key, text,
           CASE key WHEN 'seen' THEN 'bool' WHEN 'link' THEN 'string' WHEN 'text' THEN 'string' ELSE 'int' END AS kind,
           CASE WHEN key = 'text' THEN line WHEN key = 'link' THEN link ELSE text END AS scalar
    FROM members m JOIN lines l ON l.payload_id = m.payload_id AND l.i = m.i
    WHERE key NOT IN ('origin', 'shape')) x
  JOIN items USING (payload_id)
  GROUP BY payload_id, key, n HAVING count(*) = n AND count(DISTINCT text) = 1),
shared AS (
  SELECT payload_id, key, text, count(*) AS n, min(i) AS first_item FROM members
  WHERE key IN ('origin', 'shape') GROUP BY 1, 2, 3 HAVING count(*) > 1),
named AS (
  SELECT *, CASE WHEN r = 1 THEN key ELSE key || '#' || r END AS ref FROM (
    SELECT *, row_number() OVER (PARTITION BY payload_id, key ORDER BY first_item) AS r FROM shared))"""

KIND_OF = r"""CASE
    WHEN NOT starts_with(token, '<') THEN 'text'
    WHEN starts_with(token, '<!--') THEN 'comment'
    WHEN regexp_matches(token, '(?i)^<(script|style)[\s>/]') THEN 'raw'
    WHEN starts_with(token, '<!') OR starts_with(token, '<?') THEN 'decl'
    WHEN regexp_matches(token, '^</[A-Za-z]') THEN 'close'
    WHEN regexp_matches(token, '^<[A-Za-z]') THEN
      CASE WHEN lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) IN
                ('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr')
             OR ends_with(token, '/>') THEN 'void' ELSE 'open' END
    ELSE 'text' END"""

TOKENS = rf"""tokens AS (
  SELECT page_id, pos, token, {KIND_OF} AS kind,
         CASE WHEN regexp_matches(token, '^</?[A-Za-z]') THEN lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) END AS tag
  FROM (SELECT page_id, u.i - 1 AS pos, u.token FROM pages,
          unnest(regexp_extract_all(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]+>|[^<]+|<'))
          WITH ORDINALITY AS u(token, i)))"""

# Opening tags paired by nesting level of their name; what stays open ends at
# the end of the nearest closed element around it, or of the page.
SPANS = f"""{TOKENS},
levels AS (
  SELECT *, sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY pos)
            + CASE kind WHEN 'open' THEN 0 ELSE 1 END AS lvl
  FROM tokens WHERE kind IN ('open', 'close')),
paired AS (
  SELECT *, lead(CASE kind WHEN 'close' THEN pos END) OVER (PARTITION BY page_id, tag, lvl ORDER BY pos) AS mate FROM levels),
opened AS (SELECT * FROM paired WHERE kind = 'open'),
closed AS (SELECT page_id, pos, mate FROM opened WHERE mate IS NOT NULL),
last AS (SELECT page_id, max(pos) AS last_pos FROM tokens GROUP BY 1),
open_spans AS (
  SELECT o.page_id, o.tag, o.token, o.pos AS open_pos,
         coalesce(o.mate, (SELECT min(c.mate) - 1 FROM closed c WHERE c.page_id = o.page_id AND c.pos < o.pos AND c.mate > o.pos),
                  l.last_pos) AS close_pos, o.mate
  FROM opened o JOIN last l ON l.page_id = o.page_id),
spans AS (
  SELECT page_id, tag, token, open_pos, close_pos, mate FROM open_spans
  UNION ALL SELECT page_id, tag, token, pos, pos, NULL FROM tokens WHERE kind IN ('void', 'raw'))"""

NOISE = f"""{SPANS},
noise AS (
  SELECT page_id, open_pos, close_pos FROM open_spans
  WHERE tag IN ('nav', 'footer', 'aside', 'head', 'noscript', 'template') OR token LIKE '% class="ad"%'),
clean AS (
  SELECT t.* FROM tokens t WHERE t.kind NOT IN ('comment', 'raw', 'decl')
  AND NOT EXISTS (SELECT 1 FROM noise n WHERE n.page_id = t.page_id AND t.pos BETWEEN n.open_pos AND n.close_pos))"""


def _decoded(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _squeezed(x: str) -> str:
    return rf"regexp_replace({x}, '[ \t\r\n\f]+', ' ', 'g')"


def _tidied(x: str) -> str:
    lines = rf"regexp_replace(regexp_replace({x}, ' *\n *', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({lines}, '^[ \n]+', ''), '[ \n]+$', '')"


TRUNCATED = "CASE WHEN length({x}) > {n} THEN left({x}, {n}) || chr(10) || chr(10) || '[... truncated]' ELSE {x} END"
HREF = _decoded("""regexp_extract({token}, 'href="([^"]*)"', 1)""")


def _mark(t: str, opener: str) -> str:
    """Markdown of a token; ``opener`` is the token an end tag belongs to."""
    return f"""CASE
    WHEN {t}.kind = 'text' THEN {_squeezed(_decoded(f"{t}.token"))}
    WHEN {t}.tag = 'br' THEN chr(10)
    WHEN {t}.tag IN ('h1','h2','h3','h4','h5','h6') THEN
      CASE WHEN {t}.kind = 'open' THEN chr(10) || chr(10) || repeat('#', CAST({t}.tag[2:2] AS INT)) || ' ' ELSE chr(10) || chr(10) END
    WHEN {t}.tag = 'li' THEN CASE WHEN {t}.kind = 'open' THEN chr(10) || '- ' ELSE '' END
    WHEN {t}.tag = 'a' THEN CASE WHEN {t}.kind = 'open' THEN '[' ELSE '](' || {HREF.format(token=opener)} || ')' END
    WHEN {t}.tag IN ('b', 'i', 'em', 'strong', 'code') THEN ''
    WHEN {t}.tag IN ('p','div','article','section','main','header','footer','nav','aside','ul','ol','table','tr','blockquote',
      'pre','form','figure','body','html','title','head') AND {t}.kind IN ('open', 'close') THEN chr(10) || chr(10)
    ELSE '' END"""


MARKED = f"""{NOISE},
marked AS (
  SELECT t.page_id, t.pos, {_mark("t", "o.token")} AS mark
  FROM clean t LEFT JOIN open_spans o ON o.page_id = t.page_id AND o.mate = t.pos),
rendered AS (
  SELECT p.page_id, p.url, p.html, coalesce({_tidied("string_agg(m.mark, '' ORDER BY m.pos)")}, '') AS md
  FROM pages p LEFT JOIN marked m USING (page_id) GROUP BY ALL)"""

# The same with navigation and the like left in, cut at blank lines.
BLOCKS = (
    MARKED.replace("n.page_id = t.page_id AND t.pos BETWEEN n.open_pos AND n.close_pos", "false")
    + """,
blocks AS (SELECT page_id, block FROM (SELECT page_id, unnest(string_split(md, chr(10) || chr(10))) AS block FROM rendered) WHERE block != '')"""
)

TITLE = "trim(" + _squeezed(_decoded(r"regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")) + ")"
LANG = """regexp_extract(html, '<html lang="([^"]*)"', 1)"""

PAGED = """paged AS (
  SELECT conv_id AS doc_id, turn + 1 AS page_no, CASE WHEN conv_id % 9 = 0 THEN ' ' || chr(10) ELSE text END AS text
  FROM conversations)"""
SPECS = """specs AS (
  SELECT conv_id AS doc_id, list_extract(['1-3', '2', '1, 4-5', 'x-2', '3-1', '', '0,2-2,2'], CAST(conv_id % 7 AS INT) + 1) AS spec
  FROM conversations WHERE turn = 0)"""

WORDS = r"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'))"
HITS = rf"""queries AS (
  SELECT item_id AS query_id, array_to_string(regexp_split_to_array(text, '[ \n]')[1:3], ' ') AS query,
         CASE WHEN item_id % 4 = 0 THEN 'en' END AS want FROM benchmark),
terms AS (SELECT query_id, want, unnest({WORDS.format(x="query")}) AS word FROM queries),
found AS (SELECT doc_id, lang, unnest({WORDS.format(x="text")}) AS word FROM documents),
scored AS (
  SELECT query_id, doc_id, count(*) AS score FROM found JOIN terms USING (word)
  WHERE want IS NULL OR want = lang GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""

LEDGER = """ledger AS (
  SELECT event_id AS seq, ts, CASE WHEN event_type = 'error' THEN '' ELSE 'fetch:' || event_type END AS source,
         CASE WHEN event_id % 50 = 0 THEN 0 ELSE (event_id * 37) % 4001 END AS raw_chars,
         CASE WHEN event_id % 50 = 0 OR (event_id * 37) % 4001 = 0 THEN 0 ELSE (event_id * 11) % 2003 END AS opt_chars
  FROM events)"""


def _permille(raw: str, opt: str) -> str:
    return f"CASE WHEN {raw} = 0 THEN 0 ELSE CAST(sign({raw} - {opt}) * ((abs({raw} - {opt}) * 1000) // {raw}) AS BIGINT) END"


REQUESTS = """requests AS (
  SELECT event_id AS req_id, ts, event_type, 'https://api.example.com/' || event_type AS url,
         CASE WHEN event_id % 4 IN (0, 1) THEN '[{"k":"agent","v":"u' || (user_id % 3) || '"},{"k":"lang","v":"en"}]'
              WHEN event_id % 4 = 2 THEN '[{"k":"agent","v":"u' || (user_id % 3) || '"}]' ELSE '[]' END AS headers
  FROM events),
keyed AS (SELECT *, sha256(url || chr(10) || headers || chr(10) || '[{"k":"max_depth","v":"5"}]') AS key FROM requests)"""


# The stored answer that each request meets.
SERVED = """stored AS (
            SELECT key, ts AS stored_at, 600 + (req_id % 7) * 900 AS ttl, 'answer ' || req_id AS content, req_id % 1000 AS raw_chars
            FROM keyed WHERE req_id % 5 = 0),
          met AS (SELECT r.req_id, r.url, epoch_us(r.ts) < epoch_us(s.stored_at) + s.ttl * 1000000 AS alive, s.stored_at, s.content, s.raw_chars
            FROM (SELECT * FROM keyed WHERE req_id % 5 != 0) r ASOF LEFT JOIN stored s ON r.key = s.key AND r.ts >= s.stored_at)"""


def _kept(key: str, ttl_us: int) -> str:
    return f"""RECURSIVE stamped AS (SELECT {key} AS k, epoch_us(ts) AS us, min(event_id) AS id FROM events GROUP BY 1, 2),
nxt AS (SELECT a.k, a.us, a.id, (SELECT min(b.us) FROM stamped b WHERE b.k = a.k AND b.us >= a.us + {ttl_us}) AS nxt_us FROM stamped a),
kept AS (
  SELECT n.k, n.us, n.id, n.nxt_us FROM nxt n JOIN (SELECT k, min(us) AS first_at FROM stamped GROUP BY 1) f ON f.k = n.k AND f.first_at = n.us
  UNION ALL
  SELECT n.k, n.us, n.id, n.nxt_us FROM kept p JOIN nxt n ON n.k = p.k AND n.us = p.nxt_us)"""


KEPT_EVENTS = f"WITH {_kept('user_id', 86_400_000_000)} SELECT k AS user_id, us AS kept_us, id AS first_id FROM kept"
TOKEN = r"[^ \t\r\n\f\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^ \t\r\n\f\p{L}\p{N}]+[\r\n]*|[ \t\r\n\f]+"

MIXED = """mixed AS (
  SELECT event_id, event_type, user_id,
         CASE WHEN event_id % 10 = 0 THEN left(props, length(props) - 1)
              WHEN event_id % 7 = 0 THEN 'event ' || event_type ELSE props END AS raw,
         event_id % 10 = 0 OR event_id % 7 = 0 AS bad
  FROM events)"""
FETCHED = f"""{MIXED}, log AS (
  SELECT 'p' || page_id AS fetch_id, url, CASE WHEN page_id % 11 = 0 THEN 'pdf' ELSE 'html' END AS route, '' AS note,
         CASE WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 17 = 0 THEN 'timeout' END AS failed, html AS body
  FROM pages
  UNION ALL
  SELECT 'e' || event_id, 'https://api.example.com/e/' || event_id, CASE WHEN bad THEN 'html' ELSE 'json' END,
         CASE WHEN bad THEN 'invalid_json' ELSE '' END, CASE WHEN event_id % 19 = 0 THEN 503 ELSE 200 END,
         CASE WHEN event_id % 23 = 0 THEN 'error' END, raw
  FROM mixed)"""

HINT = (
    "'Returned schema + 2 sample items out of ' || n || '. Use the jsonpath parameter to fetch specific items or fields. "
    "Examples: ''$[0:5]'' (first 5 items), ''$[*].name'' (all names), ''$[?@.id==42]'' (item with id 42).'"
)
LABELS = [
    ("chars", "'int'", "true"), ("line", "'int'", "true"),
    ("link", "CASE WHEN length(link) > 80 THEN 'string(long)' ELSE 'string' END", "true"),
    ("origin", "'object(2 keys)'", "true"), ("seen", "'bool'", "true"), ("shape", "'object(2 keys)'", "true"),
    ("text", "CASE WHEN chars > 80 THEN 'string(long)' ELSE 'string' END", TEXT_KEPT),
]
TYPES = "types AS (" + _union(
    [f"SELECT payload_id, '{k}' AS key, {v} AS type FROM lines WHERE i = 0 AND {c}" for k, v, c in LABELS]
) + ")"


def _path_values(label: str, member: str, text: str, where: str) -> str:
    return (
        f"SELECT '{label}' AS path, payload_id, '$[' || i || '].{member}' AS match_path, {text} AS value "
        f"FROM lines JOIN items USING (payload_id) WHERE {where}"
    )


ITEM_COUNT = "items AS (SELECT payload_id, max(i) + 1 AS n FROM lines GROUP BY 1)"

# A document as compact JSON with sorted keys, nothing pruned.
WHOLE_ITEM = """'{"chars":' || chars || ',"detail_url":' || to_json(link || '/' || i || '{/rev}') || ',"gift":null,"line":' || (i + 1)
  || ',"link":' || to_json(link) || ',"note":"  ","origin":' || """ + ORIGIN + """ || ',"seen":false,"shape":' || """ + SHAPE + """
  || ',"tags":[],"text":' || to_json(line) || '}'"""
# The same as written by the view: construction order of the keys.
RAW_ITEM = """'{"line":' || (i + 1) || ',"text":' || to_json(line) || ',"chars":' || chars || ',"detail_url":'
  || to_json(link || '/' || i || '{/rev}') || ',"link":' || to_json(link) || ',"note":"  ","gift":null,"tags":[],"seen":false,"origin":{"name":'
  || to_json(source) || ',"lang":' || to_json(lang) || '},"shape":' || """ + SHAPE + """ || '}'"""
RAWS = f"""raws AS (SELECT payload_id, '[' || string_agg({RAW_ITEM}, ',' ORDER BY i) || ']' AS raw FROM lines GROUP BY 1)"""

LINES_ONLY = f"WITH {LINES}"

# Indented results. Members of an item, two or three levels deep.
NL = "chr(10)"


def _indented(text: str, key: str, level: int) -> str:
    """An ``origin`` or ``shape`` text spread over lines; other texts as they are."""
    pad = " " * (2 * level)
    spread = f"replace(replace(replace({text}, '{{', '{{' || {NL} || '{pad}  '), ',\"', ',' || {NL} || '{pad}  \"'), '}}', {NL} || '{pad}' || '}}')"
    return f"CASE WHEN {key} IN ('origin', 'shape') THEN replace({spread}, '\":', '\": ') ELSE {text} END"


RESULTS = f"""{FACTS}, {RAWS}, {TYPES},
shown AS (
  SELECT m.payload_id, m.i, m.key, n.n >= 5 AS summary,
         CASE WHEN s.ref IS NOT NULL AND n.n < 5 THEN '"→ (same as _common.' || s.ref || ')"' ELSE {_indented("m.text", "m.key", 3)} END AS text
  FROM members m JOIN items n USING (payload_id)
  LEFT JOIN named s ON s.payload_id = m.payload_id AND s.key = m.key AND s.text = m.text
  WHERE n.n >= 5 AND m.i < 2
     OR n.n < 5 AND NOT EXISTS (SELECT 1 FROM uniform u WHERE u.payload_id = m.payload_id AND u.key = m.key)),
item_text AS (
  SELECT l.payload_id, l.i,
         coalesce('{{' || string_agg({NL} || '      "' || key || '": ' || s.text, ',' ORDER BY key) || {NL} || '    }}', '{{}}') AS text
  FROM lines l LEFT JOIN shown s ON s.payload_id = l.payload_id AND s.i = l.i GROUP BY 1, 2),
item_list AS (
  SELECT t.payload_id, string_agg({NL} || '    ' || text, ',' ORDER BY t.i) AS body
  FROM item_text t JOIN items n USING (payload_id) WHERE n.n < 5 OR t.i < 2 GROUP BY 1),
values_list AS (
  SELECT payload_id, string_agg({NL} || '    "' || key || '": ' || text, ',' ORDER BY key) AS body FROM uniform GROUP BY 1),
common_list AS (
  SELECT payload_id, string_agg({NL} || '    "' || ref || '": ' || {_indented("text", "key", 2)}, ',' ORDER BY first_item, key) AS body
  FROM named GROUP BY 1),
schema_list AS (SELECT payload_id, string_agg({NL} || '    "' || key || '": "' || type || '"', ',' ORDER BY key) AS body FROM types GROUP BY 1),
results AS (
  SELECT r.payload_id, CASE WHEN n.n >= 5 THEN 'schema' ELSE 'pruned' END AS mode, length(r.raw) AS raw_chars,
    CASE WHEN n.n >= 5 THEN
      '{{' || {NL} || '  "_mode": "schema",' || {NL} || '  "_count": ' || n.n || ',' || {NL} || '  "_schema": {{' || s.body || {NL} || '  }},'
      || {NL} || '  "_sample": [' || i.body || {NL} || '  ],' || {NL} || '  "_hint": "' || {HINT} || '"' || {NL} || '}}'
    ELSE
      '{{' || coalesce({NL} || '  "_common_values": {{' || v.body || {NL} || '  }},', '')
      || coalesce({NL} || '  "_common": {{' || c.body || {NL} || '  }},', '')
      || {NL} || '  "items": [' || i.body || {NL} || '  ]' || {NL} || '}}' END AS text
  FROM raws r JOIN items n USING (payload_id) JOIN item_list i USING (payload_id)
  LEFT JOIN values_list v USING (payload_id) LEFT JOIN common_list c USING (payload_id) LEFT JOIN schema_list s USING (payload_id))"""
# Everything pruned, no summaries: no list is long enough for one.
PRUNED = RESULTS.replace("n.n >= 5", "n.n >= 1000000000").replace("n.n < 5", "n.n < 1000000000")

# A document indented as it is, nothing pruned.
INDENTED_ITEM = f"""'{{' || {NL} || '    "chars": ' || chars || ',' || {NL} || '    "detail_url": ' || to_json(link || '/' || i || '{{/rev}}')
  || ',' || {NL} || '    "gift": null,' || {NL} || '    "line": ' || (i + 1) || ',' || {NL} || '    "link": ' || to_json(link)
  || ',' || {NL} || '    "note": "  ",' || {NL} || '    "origin": ' || {_indented(ORIGIN, "'origin'", 2)}
  || ',' || {NL} || '    "seen": false,' || {NL} || '    "shape": ' || {_indented(SHAPE, "'shape'", 2)}
  || ',' || {NL} || '    "tags": [],' || {NL} || '    "text": ' || to_json(line) || {NL} || '  }}'"""
JSON_CUT = "CASE WHEN length({x}) > {n} THEN left({x}, {n}) || chr(10) || chr(10) || '... [truncated]' ELSE {x} END"


def oracle_sql() -> dict[str, str]:
    big = "chars > 500"
    collapsed = """SELECT d.doc_id AS payload_id, coalesce(g.n, 0) AS n_matches,
      CASE WHEN g.n IS NULL THEN '{"_info":"No matches for JSONPath expression","jsonpath":"$[?@.chars>500].line"}'
           WHEN g.n = 1 THEN g.body ELSE '[' || g.body || ']' END AS result
      FROM documents d LEFT JOIN (SELECT payload_id, count(*) AS n, string_agg(CAST(i + 1 AS VARCHAR), ',' ORDER BY i) AS body
      FROM lines WHERE chars > 500 GROUP BY 1) g ON g.payload_id = d.doc_id"""
    element = "SELECT page_id, open_pos, tag FROM spans s WHERE "
    inside = (
        "EXISTS (SELECT 1 FROM spans a WHERE a.page_id = s.page_id AND a.tag = '{tag}' AND a.open_pos < s.open_pos AND s.open_pos <= a.close_pos)"
    )
    parent_tag = (
        "(SELECT arg_max(a.tag, a.open_pos) FROM spans a WHERE a.page_id = {s}.page_id AND a.open_pos < {s}.open_pos "
        "AND {s}.open_pos <= a.close_pos)"
    )
    return {
        "s1_payload_scan": f"WITH {LINES}, {RAWS} SELECT payload_id, length(raw) AS raw_chars, sha256(raw) AS raw_hash FROM raws",
        "s2_page_scan": "SELECT page_id, url, length(html) AS chars FROM pages",
        "s3_reference_resolution": """
          WITH e AS (SELECT *, event_id - event_id % 3 AS file_id FROM events)
          SELECT e.event_id AS payload_id, CASE e.event_id % 6
            WHEN 0 THEN trim(e.props)
            WHEN 3 THEN 'plain ' || e.event_type
            WHEN 5 THEN '{"_error": "File not found: /gone/' || e.event_id || '"}'
            ELSE CASE WHEN f.event_id % 2 = 0 THEN 'stored ' || f.event_type ELSE f.props END END AS raw
          FROM e LEFT JOIN events f ON f.event_id = e.file_id""",
        "s4_content_routes": f"WITH {FETCHED} SELECT route, note, count(*) AS n FROM log GROUP BY 1, 2",
        "s5_fetch_outcomes": rf"""WITH {FETCHED} SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
          coalesce(failed, CASE WHEN status >= 300 THEN 'http' ELSE 'ok' END) AS outcome,
          CASE WHEN failed IS NULL THEN status END AS status, count(*) AS n FROM log GROUP BY 1, 2, 3""",
        "s6_s7_ledger_round_trip": f"""WITH {LEDGER} SELECT seq, epoch_us(ts) // 1000 * 1000 AS ts_us, source, raw_chars, opt_chars,
          raw_chars - opt_chars AS saved_chars FROM ledger""",
        "j1_parse_split": f"WITH {MIXED} SELECT event_id AS payload_id, CASE WHEN bad THEN 'Error: Invalid JSON' ELSE '' END AS error FROM mixed",
        "j2_leaf_table": _doc_leaves("path ord kind scalar"),
        "j2_deep_leaves": """SELECT c_custkey AS payload_id, 26 + c_custkey % 16 AS levels, kind,
          CASE kind WHEN 'int' THEN CAST(c_custkey AS VARCHAR) WHEN 'string' THEN 'http://h/{x}' END AS scalar
          FROM customer, (SELECT unnest(['int', 'string', 'null']) AS kind)""",
        "j2_nesting_depth": "SELECT c_custkey AS payload_id, 26 + c_custkey % 16 AS depth FROM customer",
        "j7_deep_descend": "SELECT c_custkey AS payload_id, CAST(c_custkey AS VARCHAR) AS value FROM customer",
        "j26_deep_payloads": """SELECT c_custkey AS payload_id, 'pruned' AS mode,
          repeat('[', CAST(25 + c_custkey % 16 AS INTEGER)) || '{"id":' || c_custkey || '}' || repeat(']', CAST(25 + c_custkey % 16 AS INTEGER)) AS text FROM customer""",
        "j3_path_child": "SELECT event_id AS payload_id, user_id AS value FROM events",
        "j4_path_wildcard": f"WITH {LINES}, {ITEM_COUNT} "
        + _path_values("$[*].origin.name", "origin.name", "CAST(to_json(source) AS VARCHAR)", "true"),
        "j5_path_positions": f"WITH {LINES}, {ITEM_COUNT} " + _union([
            _path_values("$[0].chars", "chars", "CAST(chars AS VARCHAR)", "i = 0"),
            _path_values("$[-1].chars", "chars", "CAST(chars AS VARCHAR)", "i = n - 1"),
            _path_values("$[1:3].line", "line", "CAST(i + 1 AS VARCHAR)", "i IN (1, 2)"),
            _path_values("$[-2:].line", "line", "CAST(i + 1 AS VARCHAR)", "i >= n - 2"),
        ]),
        "j6_path_item_filter": f"WITH {LINES}, {ITEM_COUNT} " + _path_values("$[?@.chars>500].shape", "shape", SHAPE, big),
        "j7_path_descend": """SELECT '$..id' AS path, event_id AS payload_id, '$.event.id' AS match_path, CAST(event_id AS VARCHAR) AS value FROM events
          UNION ALL SELECT '$..id', event_id, '$.event.who.user.id', CAST(user_id AS VARCHAR) FROM events""",
        "j8_path_collapse": f"WITH {LINES} {collapsed}",
        "j9_template_urls_dropped": _event_leaves(lambda p, why: why != "url"),
        "j10_empties_dropped": f"WITH {LINES} " + _union([
            f"SELECT payload_id, '$[' || i || '].{path}' AS path, '{kind}' AS kind FROM lines"
            + (f" WHERE NOT regexp_full_match(line, '{SPACE}*')" if path == "text" else "")
            for path, _, kind, _ in DOC_LEAVES if path not in ("gift", "note", "tags")
        ]),
        "j11_surviving_containers": "SELECT event_id AS payload_id, path FROM events, (VALUES ('$'), ('$.event'), ('$.event.what'), "
        "('$.event.what.marks'), ('$.event.what.marks[3]'), ('$.event.what.props'), ('$.event.who'), ('$.event.who.user'), "
        f"('{CARD}'), ('{CARD}.geo'), ('{CARD}.geo.z'), ('{CARD}.geo.z[0]'), ('{CARD}.urls')) AS p(path)",
        "j12_positions_compacted": _placed_leaves(lambda path, value, why: why in ("-", "in"), compact=True),
        # Below depth 4 the card is flattened: its empties go, lists stay whole,
        # and the literal key "geo.x" comes after the nested one. So deep is the "e".
        "j13_flattened_below": _placed_leaves(
            lambda path, value, why: value != NESTED_X and not (why == "empty" and (path.startswith(CARD) and "urls" not in path or path.endswith(".e"))),
            compact=False,
        ),
        "j14_uniform_values": f"WITH {FACTS} SELECT payload_id, key, kind, scalar FROM uniform",
        "j15_fingerprints": f"""WITH {_members()} SELECT payload_id, i AS item, key, sha256(text) AS fp FROM members WHERE key IN ('origin', 'shape')""",
        "j16_shared_objects": f"WITH {FACTS} SELECT payload_id, sha256(text) AS fp, n, key AS ref_name, first_item, text FROM shared",
        "j17_factored_items": f"""WITH {FACTS}
          SELECT payload_id, '_common_values' AS section, NULL AS item, key, text FROM uniform
          UNION ALL SELECT payload_id, '_common', NULL, ref, text FROM named
          UNION ALL SELECT m.payload_id, 'items', m.i, m.key,
            CASE WHEN s.ref IS NULL THEN m.text ELSE '"→ (same as _common.' || s.ref || ')"' END
          FROM members m LEFT JOIN named s ON s.payload_id = m.payload_id AND s.key = m.key AND s.text = m.text
          WHERE NOT EXISTS (SELECT 1 FROM uniform u WHERE u.payload_id = m.payload_id AND u.key = m.key)""",
        "j18_schema_gate": f"WITH {LINES}, {ITEM_COUNT} SELECT payload_id, n AS n_items, n >= 5 AS gate FROM items",
        "j19_type_labels": """SELECT event_id AS payload_id, key, type FROM events, (VALUES ('type', 'string'), ('props', 'object(1 keys)'),
          ('pad', 'string'), ('void', 'object(0 keys)'), ('deep', 'object(1 keys)'), ('marks', '[null, ...6]')) AS t(key, type)""",
        "j20_first_item_schema": f"WITH {LINES}, {TYPES} SELECT payload_id, key, type FROM types",
        "j21_schema_profile": f"""WITH {LINES}, opened AS ({_union([
            f"SELECT '{k}' AS key, {t} AS type FROM lines" for k, t in (
                ("chars", "'int'"), ("line", "'int'"), ("seen", "'bool'"), ("gift", "'null'"), ("tags", "'[]'"), ("note", "'string'"),
                ("origin", "'object(2 keys)'"), ("shape", "'object(2 keys)'"),
                ("detail_url", "CASE WHEN length(link || '/' || i || '{/rev}') > 80 THEN 'string(long)' ELSE 'string' END"),
                ("link", "CASE WHEN length(link) > 80 THEN 'string(long)' ELSE 'string' END"),
                ("text", "CASE WHEN chars > 80 THEN 'string(long)' ELSE 'string' END"))])})
          SELECT key, count(*) AS n_present, count(*) FILTER (type = 'null') AS n_null,
                 string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM opened GROUP BY 1""",
        "j22_head_samples": f"WITH {LINES} SELECT payload_id, i AS item, line AS text FROM lines WHERE i < 2",
        "j23_schema_summaries": f"""WITH {_members()}, {ITEM_COUNT}, {TYPES},
          sampled AS (SELECT payload_id, i, '{{' || string_agg('"' || key || '":' || text, ',' ORDER BY key) || '}}' AS text
                      FROM members WHERE i < 2 GROUP BY 1, 2)
          SELECT n.payload_id, 'schema' AS mode, n AS n_items,
            (SELECT '{{' || string_agg('"' || key || '":"' || type || '"', ',' ORDER BY key) || '}}' FROM types t WHERE t.payload_id = n.payload_id) AS schema,
            a.text AS sample_1, b.text AS sample_2, {HINT} AS hint
          FROM items n JOIN sampled a ON a.payload_id = n.payload_id AND a.i = 0 JOIN sampled b ON b.payload_id = n.payload_id AND b.i = 1
          WHERE n >= 5""",
        "j24_rebuilt_text": f"""WITH {LINES} SELECT payload_id, sha256('[' || string_agg({WHOLE_ITEM}, ',' ORDER BY i) || ']') AS text_hash
          FROM lines GROUP BY 1""",
        "j25_truncated_text": f"""SELECT doc_id, {JSON_CUT.format(x="text", n=500)} AS json_text,
          {TRUNCATED.format(x="text", n=1000)} AS plain_text FROM documents""",
        "j26_optimized_payloads": f"""WITH {RESULTS}, cut AS (SELECT payload_id, mode, raw_chars, {JSON_CUT.format(x="text", n=20000)} AS text FROM results)
          SELECT payload_id, mode, raw_chars, length(text) AS opt_chars, text FROM cut""",
        "j26_optimized_by_path": f"""WITH {LINES}, {RAWS}, g AS (
            SELECT payload_id, count(*) AS n, string_agg(CAST(i + 1 AS VARCHAR), ',' || {NL} || '  ' ORDER BY i) AS body
            FROM lines WHERE chars > 500 GROUP BY 1),
          t AS (SELECT r.payload_id, length(raw) AS raw_chars,
            CASE WHEN g.n IS NULL THEN '{{' || {NL} || '  "_info": "No matches for JSONPath expression",' || {NL} || '  "jsonpath": "$[?@.chars>500].line"'
                   || {NL} || '}}'
                 WHEN g.n = 1 THEN g.body ELSE '[' || {NL} || '  ' || g.body || {NL} || ']' END AS text
            FROM raws r LEFT JOIN g USING (payload_id)), cut AS (SELECT payload_id, raw_chars, {JSON_CUT.format(x="text", n=1000)} AS text FROM t)
          SELECT payload_id, 'pruned' AS mode, raw_chars, length(text) AS opt_chars, text FROM cut""",
        "smart_responses": f"""WITH {FETCHED}, told AS (SELECT *, failed IS NULL AND status = 200 AS ok FROM log)
          SELECT fetch_id, CASE WHEN ok THEN route ELSE 'error' END AS route,
          CASE WHEN NOT ok THEN 'failed' WHEN route = 'pdf' THEN 'no_text' ELSE note END AS note, 'smart_fetch:' || left(url, 60) AS source,
          CASE WHEN ok THEN length(body) ELSE 0 END AS raw_chars, ok AND route != 'pdf' AS answered FROM told""",
        "s6_numbered_records": f"""WITH {FETCHED}, kept AS (
            SELECT fetch_id, fetch_id[1] = 'e' AS later, 'smart_fetch:' || left(url, 60) AS source, length(body) AS raw_chars FROM log
            WHERE failed IS NULL AND status = 200 AND route != 'pdf' AND note = '')
          SELECT row_number() OVER (ORDER BY later, encode(fetch_id)) AS seq, source, raw_chars, true AS dated FROM kept""",
        "smart_failures": f"""WITH {FETCHED} SELECT fetch_id, 'Error: ' || CASE failed WHEN 'timeout' THEN 'Request timed out' WHEN 'error' THEN 'ConnectError'
          ELSE 'HTTP ' || status END || ' — ' || url AS text FROM log WHERE failed IS NOT NULL OR status != 200""",
        "h1_page_tokens": f"WITH {TOKENS} SELECT page_id, pos, kind, tag, length(token) AS chars FROM tokens",
        "h2_page_elements": f"WITH {SPANS} SELECT page_id, tag, open_pos, close_pos FROM spans",
        "h3_noise_dropped": f"WITH {NOISE} SELECT page_id, pos, kind, tag FROM clean",
        "h4_visible_text": f"""WITH {NOISE} SELECT p.page_id,
          coalesce(trim({_squeezed("string_agg(" + _decoded("t.token") + ", ' ' ORDER BY t.pos)")}), '') AS text
          FROM pages p LEFT JOIN (SELECT * FROM clean WHERE kind = 'text') t USING (page_id) GROUP BY 1""",
        "h5_markdown": f"""WITH {MARKED} SELECT page_id, url, length(html) AS raw_chars, {TRUNCATED.format(x="md", n=5000)} AS markdown FROM rendered""",
        "h6_markdown_with_metadata": f"""WITH {MARKED} SELECT page_id,
          '---' || {NL} || 'title: ' || {TITLE} || {NL} || 'lang: ' || {LANG} || {NL} || '---' || {NL} || {NL} || md AS markdown FROM rendered""",
        "h6_page_metadata": f"SELECT page_id, {TITLE} AS title, {LANG} AS lang, CAST(NULL AS VARCHAR) AS description FROM pages",
        "h7_elements_simple": f"WITH {SPANS} {element} token LIKE '% class=\"ad\"%' OR tag = 'h1' OR tag = 'a' AND token LIKE '% href=%'",
        "h8_elements_combined": f"""WITH {SPANS} {element} tag = 'a' AND {inside.format(tag="nav")}
          OR tag = 'li' AND {parent_tag.format(s="s")} = 'ul'
          OR tag = 'b' AND EXISTS (SELECT 1 FROM spans q WHERE q.page_id = s.page_id AND q.tag = 'p' AND q.open_pos < s.open_pos
             AND s.open_pos <= q.close_pos AND {parent_tag.format(s="q")} = 'article')""",
        "h9_css_fragments": f"""WITH {SPANS}, links AS (
            SELECT t.page_id, t.open_pos, '[' || {_squeezed(_decoded("w.token"))} || '](' || {HREF.format(token="t.token")} || ')' AS md
            FROM spans t JOIN tokens w ON w.page_id = t.page_id AND w.pos = t.open_pos + 1
            WHERE t.tag = 'a' AND {inside.format(tag="nav").replace("s.", "t.")}),
          j AS (SELECT page_id, count(*) AS n, string_agg(md, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY open_pos) AS r FROM links GROUP BY 1)
          SELECT p.page_id, p.url, coalesce(n, 0) AS n, length(html) AS raw_chars,
            CASE WHEN n IS NULL THEN 'No elements matched selector: nav a' ELSE {TRUNCATED.format(x="r", n=1000)} END AS result
          FROM pages p LEFT JOIN j USING (page_id)""",
        "h9_css_fragments_rendered": f"""WITH {SPANS}, picked AS (
            SELECT t.page_id, t.open_pos, CASE WHEN t.tag = 'h1' THEN '# ' ELSE '' END || trim({_squeezed(_decoded("w.token"))}) AS md
            FROM spans t JOIN tokens w ON w.page_id = t.page_id AND w.pos = t.open_pos + 1
            WHERE t.tag = 'h1' OR t.token LIKE '% class="ad"%'),
          j AS (SELECT page_id, count(*) AS n, string_agg(md, {NL} || {NL} ORDER BY open_pos) AS r FROM picked GROUP BY 1)
          SELECT p.page_id, p.url, coalesce(n, 0) AS n, length(html) AS raw_chars,
            CASE WHEN n IS NULL THEN 'No elements matched selector: .ad, h1' ELSE {TRUNCATED.format(x="r", n=1000)} END AS result
          FROM pages p LEFT JOIN j USING (page_id)""",
        "h10_repeated_blocks_by_host": f"""WITH {BLOCKS} SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host,
          sha256(block) AS block_hash, count(DISTINCT page_id) AS n_pages FROM blocks JOIN (SELECT page_id, url FROM pages) USING (page_id)
          GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 2""",
        "h10_repeated_blocks": f"""WITH {BLOCKS} SELECT sha256(block) AS block_hash, count(DISTINCT page_id) AS n_pages FROM blocks
          GROUP BY 1 HAVING count(DISTINCT page_id) >= 2""",
        "h10_pages_without_boilerplate": f"""WITH {BLOCKS} SELECT page_id, count(*) AS n_blocks, CAST(sum(length(block)) AS BIGINT) AS chars FROM blocks
          WHERE block NOT IN (SELECT block FROM blocks GROUP BY 1 HAVING count(DISTINCT page_id) >= 2) GROUP BY 1""",
        "p1_pages_selected": f"""WITH {PAGED}, {SPECS} SELECT doc_id, page_no, length(text) AS chars FROM paged JOIN specs USING (doc_id)
          WHERE CASE spec WHEN '1-3' THEN page_no <= 3 WHEN '2' THEN page_no = 2 WHEN '1, 4-5' THEN page_no IN (1, 4, 5)
            WHEN 'x-2' THEN false WHEN '0,2-2,2' THEN page_no = 2 ELSE true END""",
        "p1_page_specs_rejected": f"""WITH {SPECS} SELECT doc_id, 'Error: Invalid page range format. Use e.g. ''1-5'' or ''3''.' AS error
          FROM specs WHERE spec = 'x-2'""",
        "p2_document_text": rf"""WITH {PAGED}, docs AS (
            SELECT doc_id, regexp_replace(regexp_replace(string_agg(text, '' ORDER BY page_no), '^{SPACE}+', ''), '{SPACE}+$', '') AS text FROM paged GROUP BY 1)
          SELECT doc_id, {TRUNCATED.format(x="text", n=2000)} AS text FROM docs""",
        "p3_documents_without_text": f"""WITH {PAGED} SELECT doc_id, count(*) AS pages, 'Warning: No extractable text found in PDF (' || count(*)
          || ' pages). May be scanned. Consider using browser_fetch with OCR if available.' AS warning FROM paged
          GROUP BY 1 HAVING bool_and(regexp_full_match(text, '{SPACE}*'))""",
        "p3_pdf_answers": rf"""WITH {MARKED}, {PAGED}, docs AS (
            SELECT doc_id, regexp_replace(regexp_replace(string_agg(text, '' ORDER BY page_no), '^{SPACE}+', ''), '{SPACE}+$', '') AS text FROM paged GROUP BY 1),
          texts AS (SELECT url, {TRUNCATED.format(x="text", n=2000)} AS text FROM pages JOIN docs ON doc_id = page_id WHERE page_id % 11 = 0)
          SELECT url, text FROM (SELECT url FROM pages WHERE page_id % 11 = 0) JOIN texts USING (url)
          UNION ALL SELECT url, 'Note: URL did not return a PDF. Returning HTML content instead.' || {NL} || {NL} || {TRUNCATED.format(x="md", n=2000)}
          FROM rendered WHERE page_id % 11 != 0""",
        "q1_search_hits": f"WITH {HITS} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10",
        "q1_search_hits_weighted": f"""WITH {HITS}, size AS (SELECT count(*) AS n FROM documents),
          weights AS (SELECT word, CAST(floor(ln((n + 1) / (df + 0.5)) * 1000000) AS BIGINT) AS weight
            FROM (SELECT word, count(*) AS df FROM found WHERE word IN (SELECT word FROM terms) GROUP BY 1), size),
          heavy AS (SELECT query_id, doc_id, CAST(sum(weight) AS BIGINT) AS score FROM found JOIN terms USING (word) JOIN weights USING (word)
            WHERE want IS NULL OR want = lang GROUP BY ALL),
          best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM heavy)
          SELECT query_id, rank, doc_id, score FROM best WHERE rank <= 10""",
        "q2_search_listing": rf"""WITH {HITS}, body AS (
            SELECT query_id, string_agg('### ' || rank || '. [' || CASE WHEN doc_id % 5 = 0 THEN 'Untitled' ELSE string_split(text, {NL})[1] END
              || '](https://docs.example.com/' || doc_id || ')' || {NL} || {_squeezed("text")} || {NL}, {NL} ORDER BY rank) AS b
            FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1)
          SELECT query_id, CASE WHEN b IS NULL THEN 'No results found.' ELSE '## Search results for: ' || query || {NL} || {NL} || b END AS listing
          FROM queries LEFT JOIN body USING (query_id)""",
        "c1_request_keys": f"WITH {REQUESTS} SELECT req_id, key FROM keyed",
        "c2_fresh_answers": f"""WITH {REQUESTS}, {SERVED}
          SELECT req_id, coalesce(alive, false) AS hit, CASE WHEN alive THEN epoch_us(stored_at) END AS stored_us,
            CASE WHEN alive THEN content END AS content, CASE WHEN alive THEN raw_chars END AS raw_chars FROM met""",
        "c2_cache_hit_savings": f"""WITH {REQUESTS}, {SERVED},
          hits AS (SELECT 'cache_hit:' || left(url, 60) AS source, raw_chars, length(content) AS opt_chars FROM met WHERE alive),
          sums AS (SELECT source, 0 AS is_total, count(*) AS calls, sum(raw_chars) AS raw_chars, sum(opt_chars) AS opt_chars FROM hits GROUP BY 1
            UNION ALL SELECT 'TOTAL', 1, count(*), coalesce(sum(raw_chars), 0), coalesce(sum(opt_chars), 0) FROM hits)
          SELECT source, CAST(is_total AS INTEGER) AS is_total, calls, CAST(raw_chars AS BIGINT) AS raw_chars, CAST(opt_chars AS BIGINT) AS opt_chars,
            CAST(raw_chars - opt_chars AS BIGINT) AS saved_chars, {_permille("raw_chars", "opt_chars")} AS saved_permille FROM sums""",
        "c3_kept_events": KEPT_EVENTS,
        "c4_labelled_hits": f"""WITH {_kept("event_type", 1_800_000_000)}
          SELECT e.event_id, k.us AS kept_us, e.event_id != k.id AS hit
          FROM (SELECT *, epoch_us(ts) AS us FROM events) e ASOF JOIN kept k ON e.event_type = k.k AND e.us >= k.us""",
        "l1_size_measures": f"""WITH {LEDGER} SELECT seq, raw_chars, opt_chars, raw_chars - opt_chars AS saved_chars,
          {_permille("raw_chars", "opt_chars")} AS saved_permille FROM ledger""",
        "l2_source_labels": "SELECT page_id, 'smart_fetch:' || left(url, 60) AS source FROM pages",
        "l3_savings_by_source": f"""WITH {LEDGER}, sums AS (
            SELECT CASE WHEN source = '' THEN 'unknown' ELSE source END AS source, 0 AS is_total, count(*) AS calls,
              sum(raw_chars) AS raw_chars, sum(opt_chars) AS opt_chars FROM ledger GROUP BY 1
            UNION ALL SELECT 'TOTAL', 1, count(*), sum(raw_chars), sum(opt_chars) FROM ledger)
          SELECT source, CAST(is_total AS INTEGER) AS is_total, calls, CAST(raw_chars AS BIGINT) AS raw_chars, CAST(opt_chars AS BIGINT) AS opt_chars,
            CAST(raw_chars - opt_chars AS BIGINT) AS saved_chars, {_permille("raw_chars", "opt_chars")} AS saved_permille FROM sums""",
        "l4_recent_records": f"""WITH {LEDGER} SELECT seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, left(source, 20) AS source, raw_chars, opt_chars,
          {_permille("raw_chars", "opt_chars")} AS saved_permille FROM ledger ORDER BY seq DESC LIMIT 10""",
        "b1_token_estimates": f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS tokens FROM documents",
        "b2_variants_compared": f"""WITH {MARKED}, v AS (SELECT page_id, length(html) AS raw, length(md) AS pruned,
            CASE WHEN page_id % 3 = 0 THEN length(md) ELSE length(html) // 4 END AS schema FROM rendered)
          SELECT page_id, raw, pruned, schema, least(pruned, schema) AS best,
            CASE WHEN schema != pruned THEN CAST(schema AS VARCHAR) ELSE 'n/a' END AS schema_shown, raw - least(pruned, schema) AS saved,
            {_permille("raw", "least(pruned, schema)")} AS saved_permille FROM v""",
        "b2_payload_tokens": f"""WITH r AS ({LINES_ONLY} SELECT payload_id,
              len(regexp_extract_all('[' || string_agg({NL} || '  ' || {INDENTED_ITEM}, ',' ORDER BY i) || {NL} || ']', '{TOKEN}')) AS raw FROM lines GROUP BY 1),
            p AS (WITH {PRUNED} SELECT payload_id, len(regexp_extract_all(text, '{TOKEN}')) AS pruned FROM results),
            s AS (WITH {RESULTS} SELECT payload_id, len(regexp_extract_all(text, '{TOKEN}')) AS schema FROM results)
          SELECT payload_id, raw, pruned, schema, least(pruned, schema) AS best,
            CASE WHEN schema != pruned THEN CAST(schema AS VARCHAR) ELSE 'n/a' END AS schema_shown, raw - least(pruned, schema) AS saved,
            {_permille("raw", "least(pruned, schema)")} AS saved_permille FROM r JOIN p USING (payload_id) JOIN s USING (payload_id)""",
        "b3_comparison_totals": rf"""WITH {MARKED}, v AS (
            SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS name, length(html) AS raw, length(md) AS best FROM rendered),
          s AS (SELECT name, 0 AS is_total, count(*) AS n, sum(raw) AS raw, sum(best) AS best FROM v GROUP BY 1
            UNION ALL SELECT 'TOTAL', 1, count(*), sum(raw), sum(best) FROM v)
          SELECT name, CAST(is_total AS INTEGER) AS is_total, n, CAST(raw AS BIGINT) AS raw, CAST(best AS BIGINT) AS best,
            CAST(raw - best AS BIGINT) AS saved, {_permille("raw", "best")} AS saved_permille FROM s""",
        "b4_comparison_cost": f"""WITH {MARKED}, s AS (SELECT CAST(sum(length(html)) - sum(length(md)) AS BIGINT) AS saved FROM rendered)
          SELECT model, saved, CAST(saved * usd AS BIGINT) AS micro_usd FROM s, (VALUES ('small', 3), ('large', 15)) AS p(model, usd)""",
        "b5_corpus_eval": f"""WITH r AS ({LINES_ONLY} SELECT payload_id,
              length('[' || string_agg({NL} || '  ' || {INDENTED_ITEM}, ',' ORDER BY i) || {NL} || ']') AS raw_chars FROM lines GROUP BY 1),
            p AS (WITH {PRUNED} SELECT payload_id, length(text) AS pruned_chars FROM results),
            s AS (WITH {RESULTS} SELECT payload_id, length(text) AS schema_chars FROM results)
          SELECT payload_id, raw_chars, pruned_chars, schema_chars FROM r JOIN p USING (payload_id) JOIN s USING (payload_id)""",
        "t1_kept_events_stream": KEPT_EVENTS,
        "t2_savings_stream": f"""WITH {LEDGER} SELECT CASE WHEN source = '' THEN 'unknown' ELSE source END AS source, count(*) AS calls,
          CAST(sum(raw_chars) AS BIGINT) AS raw_chars, CAST(sum(opt_chars) AS BIGINT) AS opt_chars FROM ledger GROUP BY 1""",
        "t3_leaves_stream": "SELECT event_id AS payload_id, '$.k' AS path, 'int' AS kind, json_extract_string(props, '$.k') AS scalar FROM events",
        "u1_sql_scalars": f"""SELECT doc_id, true AS templated, regexp_full_match(left(text, 1), '{SPACE}*') AS blank,
          {_permille("n_chars", "doc_id")} AS permille, {JSON_CUT.format(x="text", n=100)} AS head,
          sha256(lang || chr(10) || '[{{"k":"a","v":"' || lang || '"}},{{"k":"b","v":"' || source || '"}}]' || chr(10) || '[]') AS key FROM documents""",
        "u2_sql_children": "SELECT event_id AS payload_id, key, pos FROM events, (VALUES ('id', 0), ('what', 1), ('who', 2)) AS c(key, pos)",
    }
