"""SQL for the registered queries, over the driver's tables: derived from the tables themselves (not by parsing Markdown
again), or the results worked out by hand for the literal documents."""

from __future__ import annotations

from .plans.corpora import EDGES

# The outline's headings with their places: a region has one line, a nation one, a customer two. Documents are ranges of
# 100 customer keys in a region.
_OUTLINE = """
oc AS (SELECT r_name || '-' || (c_custkey // 100) AS doc_name, * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (
  SELECT DISTINCT doc_name, NULL::INTEGER AS nk, NULL::BIGINT AS ck, 1 AS level, r_name AS title, NULL::VARCHAR AS body FROM oc
  UNION ALL SELECT DISTINCT doc_name, n_nationkey, NULL, 2, n_name, NULL FROM oc
  UNION ALL SELECT doc_name, n_nationkey, c_custkey, 3, c_name, c_mktsegment FROM oc
),
p AS (
  SELECT *, row_number() OVER w AS pos, 1 + (body IS NOT NULL)::BIGINT AS n_lines,
    repeat('#', level) || ' ' || title || coalesce(chr(10) || body, '') AS content FROM o WINDOW w AS (PARTITION BY doc_name ORDER BY nk NULLS FIRST, ck NULLS FIRST)
),
q AS (SELECT *, (sum(n_lines) OVER (PARTITION BY doc_name ORDER BY pos))::BIGINT AS own_end FROM p),
t AS (
  SELECT *, own_end - n_lines + 1 AS start_line, format('{:04d}', pos) AS node_id,
    CASE level WHEN 1 THEN max(own_end) OVER d WHEN 2 THEN max(own_end) OVER n ELSE own_end END AS end_line,
    CASE level WHEN 1 THEN max(pos) OVER d WHEN 2 THEN max(pos) OVER n ELSE pos END AS last_pos,
    CASE level WHEN 1 THEN NULL WHEN 2 THEN 1 ELSE min(pos) OVER n END AS parent_pos,
    first_value(title) OVER (PARTITION BY doc_name ORDER BY pos) AS top, first_value(title) OVER (PARTITION BY doc_name, nk ORDER BY pos) AS middle, coalesce(body, '') AS summary
  FROM q WINDOW d AS (PARTITION BY doc_name), n AS (PARTITION BY doc_name, nk)
)
"""

_CHATS = """
c AS (SELECT 'conv-' || conv_id AS doc_name, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
h AS (
  SELECT DISTINCT doc_name, -1 AS turn, 1 AS level, 'Conversation ' || conv_id AS title, NULL::VARCHAR AS text FROM c
  UNION ALL SELECT doc_name, turn, 2, role || ' ' || turn, text FROM c
),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY turn) AS pos, 1 + coalesce(len(string_split(text, chr(10))), 0) AS n_lines FROM h),
t AS (SELECT *, (sum(n_lines) OVER (PARTITION BY doc_name ORDER BY pos))::BIGINT AS end_line, repeat('#', level) || ' ' || title || coalesce(chr(10) || text, '') AS content FROM s)
"""

_SCORES = """
e AS (SELECT 'doc-' || label AS doc_name, format('{:04d}', vec_id) AS node_id, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT doc_name, node_id, vec_id, label, round(list_dot_product(v, (SELECT v FROM e WHERE vec_id = 0)), 6) AS score FROM e)
"""

_FUSED = f"""
WITH {_SCORES},
v AS (SELECT doc_name, node_id, score, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM s WHERE score >= 0.05 ORDER BY rank LIMIT 40),
r0 AS (SELECT doc_name, node_id, vec_id % 11 / 10.0::DOUBLE AS score, 'by number' AS reasoning, vec_id AS rank FROM e WHERE label <> 2),
r AS (SELECT * FROM r0 UNION ALL SELECT doc_name, node_id, score / 2, 'again', rank + 1000000 FROM r0 WHERE doc_name = 'doc-3'),
l AS (SELECT doc_name, node_id, arg_max(score, rank) AS rs, arg_max(reasoning, rank) AS reasoning, min(rank) AS rr, count(*) AS n FROM r GROUP BY ALL),
f AS (
  SELECT coalesce(v.doc_name, l.doc_name) AS doc_name, coalesce(v.node_id, l.node_id) AS node_id, CASE WHEN v.node_id IS NOT NULL THEN 'vector ' ELSE 'reason ' END || coalesce(v.node_id, l.node_id) AS title,
    CASE WHEN rs IS NULL THEN v.score * 0.4::DOUBLE ELSE coalesce(v.score, 0) * 0.4::DOUBLE + rs * 0.6::DOUBLE END AS final_score, v.score AS vector_score, rs AS reasoning_score, reasoning,
    CASE WHEN rs IS NULL THEN 'vector' WHEN v.score IS NOT NULL OR n > 1 THEN 'both' ELSE 'reasoning' END AS source, v.rank AS vr, rr
  FROM v FULL JOIN l ON v.doc_name = l.doc_name AND v.node_id = l.node_id ORDER BY final_score DESC, vr NULLS LAST, rr LIMIT 500
)
"""

_HITS = """
hits AS (
  SELECT r_name || '-0' AS doc_name, node_id, relevance, rank FROM region
  JOIN (VALUES (0, '0002', 0.4::DOUBLE, 1), (1, '0003', 0.5::DOUBLE, 2), (2, '0001', 0.7::DOUBLE, 5)) x(k, node_id, relevance, rank) ON r_regionkey = k
),
ctx AS (
  SELECT hits.doc_name, hits.node_id, a.title, relevance, rank, string_agg(b.content, chr(10) || chr(10) ORDER BY b.pos) AS content
  FROM hits JOIN t a ON a.doc_name = hits.doc_name AND a.node_id = hits.node_id JOIN t b ON b.doc_name = a.doc_name AND b.pos BETWEEN a.pos AND a.last_pos GROUP BY ALL
)
"""

_TREE = "doc_name, pos::BIGINT AS pos, node_id, title, level::BIGINT AS level, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line"
_LINE = "repeat('  ', level - 1) || '- [' || node_id || '] ' || title"
_URL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', {})"


def _values(columns: str, rows: list[tuple]) -> str:
    """SELECT of literal rows; columns: names with types."""
    kinds = [c.split() for c in columns.split(", ")]
    quote = lambda x: "NULL" if x is None else str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"
    text = ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)
    return f"SELECT {', '.join(f'{n}::{t} AS {n}' for n, t in kinds)} FROM (VALUES {text}) x({', '.join(n for n, _ in kinds)})"


#: By hand: (doc_name, level, title, line) of the headings of EDGES.
_EDGE_HEADINGS = [
    ("preamble", 1, "One", 2), ("nospace", 1, "#", 3), ("nospace", 2, "T", 4), ("indent", 1, "Yes", 2), ("setext", 1, "Title", 1), ("setext", 2, "Sub", 5),
    ("underlines", 1, "A", 1), ("underlines", 1, "===", 3), ("rule", 1, "H", 1), ("fence", 1, "A", 1), ("fence", 2, "B", 5), ("fence", 3, "C", 9), ("unclosed", 1, "A", 1),
    ("jump", 1, "A", 1), ("jump", 4, "D", 2), ("jump", 2, "B", 3), ("jump", 3, "C", 4), ("jump", 1, "E", 5), ("deep_first", 3, "X", 1), ("deep_first", 1, "Y", 2), ("deep_first", 2, "Z", 3),
    ("trailing", 1, "A", 1), ("return", 1, "A", 1), ("return", 2, "B", 2), ("wide", 1, "Ünï 标题 😀", 1),
]


def _numbered(rows: list[tuple]) -> list[tuple]:
    seen: dict[str, int] = {}
    out = []
    for doc, level, title, line in rows:
        seen[doc] = seen.get(doc, 0) + 1
        out.append((doc, seen[doc], line, level, title))
    return out


def _edge_tree() -> list[tuple]:
    """The trees of EDGES by a stack, one heading after another."""
    rows = []
    for doc, content in EDGES.items():
        total = len(content.split("\n"))
        heads = [r[1:] for r in _EDGE_HEADINGS if r[0] == doc] or [(0, "Document", 1)]
        for i, (level, title, line) in enumerate(heads):
            above: list[int] = []
            for j in range(i + 1):
                while above and heads[above[-1]][0] >= heads[j][0]:
                    above.pop()
                above.append(j)
            last = next((j for j in range(i + 1, len(heads)) if heads[j][0] <= level), len(heads))
            end = heads[last][2] - 1 if last < len(heads) else total
            parent = f"{above[-2] + 1:04d}" if len(above) > 1 else None
            rows.append((doc, i + 1, f"{i + 1:04d}", title, level, line, end, parent, len(above) - 1, " > ".join(heads[j][1] for j in above), last))
    return rows


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_QUOTES = "replace(replace({}, '&quot;', '\"'), '&#x27;', chr(39))"
_PLAIN = f"replace(replace(replace(replace(replace({_QUOTES}, '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TEXT_OF = _STRIP.format(_PLAIN.format("x"))
_INNER = "string_split_regex({}, '<[^>]*>')"


def _without(html: str, *names: str) -> str:
    for n in names:
        html = f"regexp_replace({html}, '<{n}[ >].*?</{n}>', '<x>', 'gs')"
    return html


# A page has a heading and paragraphs in an article. A paragraph that opens with bold type isn't closed: what follows is in it.
_PAGES = f"""
g AS (
  SELECT page_id, url, html, {_STRIP.format(_PLAIN.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))} AS title,
    {_STRIP.format(_PLAIN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"))} AS h1, string_split(regexp_extract(html, '</h1>(.*)</article>', 1, 's'), '<p>')[2:] AS ps FROM pages
),
l AS (
  SELECT *, list_transform(ps, lambda y, k: CASE WHEN starts_with(y, '<b>') THEN array_to_string(list_transform({_INNER.format("array_to_string(ps[k:], '<p>')")}, lambda x: {_TEXT_OF}), '')
    ELSE list_transform([regexp_extract(y, '^(.*?)</p>', 1, 's')], lambda x: {_TEXT_OF})[1] END) AS every, coalesce(list_position(list_transform(ps, lambda y: starts_with(y, '<b>')), true), 1000000) AS opened FROM g
),
m AS (
  SELECT *, array_to_string(list_filter(['# ' || title, '## ' || h1, *every[1:opened]], lambda x: x <> ''), chr(10) || chr(10)) || chr(10) AS markdown,
    array_to_string(list_filter(['# ' || title, '## ' || h1, *every], lambda x: x <> ''), chr(10) || chr(10)) || chr(10) AS simple FROM l
)
""".replace("['# ' || title, '## ' || h1, *every[1:opened]]", "list_concat(['# ' || title, '## ' || h1], every[1:opened])").replace("['# ' || title, '## ' || h1, *every]", "list_concat(['# ' || title, '## ' || h1], every)")


def _page_lines(*gone: str) -> str:
    """All texts of a page, one line after another, without those of some elements."""
    pieces = f"array_to_string(list_transform({_INNER.format(_without('html', *gone))}, lambda x: {_PLAIN.format('x')}), chr(10))"
    return f"array_to_string(list_filter(list_transform(string_split({pieces}, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), chr(10))"


def _embedded(source: str) -> str:
    """v (key, place, x): the hashed vectors of a query's (key, txt); keys are any values."""
    return f"""
vw AS (SELECT key, unnest(list_filter(regexp_split_to_array(lower(txt), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM {source}),
vp AS (SELECT key, (('0x' || substring(md5(w), 1, 8))::BIGINT % 64) AS place, 1 - 2 * (('0x' || substring(md5(w), 9, 1))::BIGINT % 2) AS sign FROM vw),
vg AS (SELECT key, place, sum(sign)::DOUBLE AS x FROM vp GROUP BY ALL HAVING sum(sign) <> 0),
v AS (SELECT key, place, x / sqrt(sum(x * x) OVER (PARTITION BY key)) AS x FROM vg)"""


def _title_hits(query: str, threshold: float, limit: int) -> str:
    """hits (doc_name, node_id, title, score, rank): the outline's nodes by the products of their titles' vectors."""
    return f"""{_OUTLINE}, told AS (SELECT doc_name || '|' || node_id AS key, title AS txt FROM t UNION ALL SELECT '', '{query}'), {_embedded("told")},
products AS (SELECT a.key, sum(a.x * b.x) AS score FROM v a JOIN v b ON b.key = '' AND a.place = b.place WHERE a.key <> '' GROUP BY a.key),
hits AS (SELECT doc_name, node_id, title, score, row_number() OVER (ORDER BY score DESC, doc_name, node_id) AS rank FROM products JOIN t ON key = doc_name || '|' || node_id WHERE score >= {threshold} ORDER BY rank LIMIT {limit})"""


def _chunks(source: str) -> str:
    """c (doc_name, k, c): the pieces of the texts (doc_name, t) of more than 100 characters; k numbers them, not from 0 on."""
    return f"""
d AS (SELECT doc_name, t, length(t)::BIGINT AS n FROM {source} WHERE length(t) > 100),
w AS (
  SELECT doc_name, t, n, 0::BIGINT AS k, 0::BIGINT AS s, CASE WHEN n <= 500 THEN n ELSE 0 END::BIGINT AS e FROM d
  UNION ALL
  SELECT doc_name, t, n, k + 1, s2, s2 + CASE
    WHEN s2 + 500 >= n THEN 500
    WHEN r1 > 250 THEN r1 + 2 WHEN r2 > 250 THEN r2 + 1 WHEN r3 > 250 THEN r3 + 1 WHEN r4 > 250 THEN r4 + 2 WHEN r5 > 250 THEN r5 + 2 ELSE 500 END
  FROM (
    SELECT *, CASE WHEN k = 0 THEN 0 ELSE e - 50 END AS s2, reverse(substring(t, (CASE WHEN k = 0 THEN 0 ELSE e - 50 END + 1)::BIGINT, 500)) AS v,
      500 - (CASE WHEN strpos(v, ' .') > 0 THEN strpos(v, ' .') ELSE 999 END) - 1 AS r1, 500 - (CASE WHEN strpos(v, '。') > 0 THEN strpos(v, '。') ELSE 999 END) AS r2,
      500 - (CASE WHEN strpos(v, chr(10)) > 0 THEN strpos(v, chr(10)) ELSE 999 END) AS r3, 500 - (CASE WHEN strpos(v, ' !') > 0 THEN strpos(v, ' !') ELSE 999 END) - 1 AS r4,
      500 - (CASE WHEN strpos(v, ' ?') > 0 THEN strpos(v, ' ?') ELSE 999 END) - 1 AS r5
    FROM w WHERE n > 500 AND (k = 0 OR e - 50 < n - 50)
  )
),
c AS (SELECT doc_name, k, CASE WHEN n <= 500 THEN t ELSE regexp_replace(substring(t, s + 1, e - s), '^\\s+|\\s+$', '', 'g') END AS c FROM w WHERE n <= 500 OR k > 0)"""


# The web of nations: (page number, level) of what a crawl visits, given what it follows and how deep.
_WEB = """c AS (SELECT 0 AS k, 0 AS level UNION ALL SELECT * FROM (SELECT unnest([2 * k + 1, 2 * k + 2]) AS k, level + 1 AS level FROM c WHERE level < {depth} AND {follows}) WHERE {to})"""
_FAILS = "k < 25 AND k % 5 <> 4"

# A page's links in order, each once, with the names they have in its table of contents; n of these; and all lines of its document.
_PAGED = f"""{_PAGES},
x AS (SELECT *, list_transform(regexp_extract_all(html, '<a href="(/[^"#]*)', 1), lambda y: regexp_extract(url, '^(https?://[^/]*)', 1) || y) AS every_link FROM m),
y AS (SELECT *, list_filter(every_link, lambda z, i: list_position(every_link, z) = i) AS links FROM x),
z AS (SELECT *, len(links) AS n, list_transform(links, lambda w: coalesce(nullif(regexp_replace(w, '^.*/', ''), ''), 'top')) AS names FROM y),
doc AS (
  SELECT 'page-' || page_id AS doc_name, *, list_transform(names, lambda w, i: CASE WHEN (i - 1) % 3 = 2 THEN 2 ELSE 1 END) AS levels,
    list_concat(list_concat(list_concat(list_concat(['# Page ' || page_id, '## Contents'], list_transform(links, lambda w, i: CASE WHEN (i - 1) % 3 = 2 THEN '  ' ELSE '' END || '- [' || names[i] || '](' || w || ')')),
      ['```url', '# ' || url, title, '```']), list_transform(list_filter(names, lambda w, i: i % 2 = 1), lambda w: '## ' || w)), string_split(markdown, chr(10))) AS lines FROM z
),
line AS (SELECT doc_name, n, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM doc),
mark AS (SELECT doc_name, line_no, line, CASE WHEN starts_with(line, '```') THEN 'fence' ELSE 'atx' END AS kind, line_no > n + 3 AND line_no <= n + 6 AS in_code FROM line WHERE regexp_matches(line, '^(```|#{{1,6}}\\s+\\S)'))
"""

ORACLES: dict[str, str] = {
    "md_lines": """
        WITH d AS (SELECT 'conv-' || conv_id AS doc_name, '# Conversation ' || conv_id || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS c FROM conversations GROUP BY conv_id)
        SELECT doc_name, unnest(range(1, len(string_split(c, chr(10))) + 1)) AS line_no, unnest(string_split(c, chr(10))) AS line FROM d""",
    "md_headings": f"WITH {_CHATS} SELECT doc_name, pos, end_line - n_lines + 1 AS line_no, level::BIGINT AS level, title FROM t",
    "md_headings_edges": _values("doc_name VARCHAR, pos BIGINT, line_no BIGINT, level BIGINT, title VARCHAR", _numbered(_EDGE_HEADINGS)),
    "md_fence_states": _values("doc_name VARCHAR, line_no BIGINT, kind VARCHAR, in_code BOOLEAN", [
        *[(d, n, "atx", "false") for d, _, t, n in _EDGE_HEADINGS if d not in ("setext", "underlines")], ("setext", 1, "setext", "false"), ("setext", 5, "setext", "false"),
        ("underlines", 1, "setext", "false"), ("underlines", 2, "setext", "false"), ("underlines", 3, "setext", "false"),
        ("fence", 2, "fence", "false"), ("fence", 3, "atx", "true"), ("fence", 4, "fence", "true"), ("fence", 6, "fence", "false"), ("fence", 7, "atx", "true"), ("fence", 8, "fence", "true"),
        ("unclosed", 2, "fence", "false"), ("unclosed", 3, "atx", "true"), ("unclosed", 4, "atx", "true"),
    ]),
    "md_sections": f"""WITH {_CHATS} SELECT doc_name, pos, level::BIGINT AS level, title, end_line - n_lines + 1 AS start_line, end_line, content, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS raw_content FROM t""",
    "md_prose_sections": "SELECT 'doc-' || doc_id AS doc_name, 'Document' AS title, 0::BIGINT AS level, 1::BIGINT AS start_line, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS end_line, md5(coalesce(text, '')) AS content_md5 FROM documents",
    "doc_titles": """
        SELECT DISTINCT r_name || '-' || (c_custkey // 100) AS doc_name, r_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT 'conv-' || conv_id, 'Conversation ' || conv_id FROM conversations
        UNION ALL SELECT 'doc-' || doc_id, 'Untitled Document' FROM documents""",
    "structure_overview": f"WITH {_OUTLINE} SELECT doc_name, string_agg(repeat('  ', level - 1) || '- ' || title || ' (lines ' || start_line || '-' || own_end || ')', chr(10) ORDER BY pos) AS overview FROM t GROUP BY doc_name",
    "tree_nodes": f"""
        WITH {_OUTLINE} SELECT {_TREE}, format('{{:04d}}', parent_pos) AS parent_id, (level - 1)::BIGINT AS depth,
          CASE level WHEN 1 THEN title WHEN 2 THEN top || ' > ' || title ELSE top || ' > ' || middle || ' > ' || title END AS path, last_pos::BIGINT AS last_pos FROM t""",
    "tree_edges": _values("doc_name VARCHAR, pos BIGINT, node_id VARCHAR, title VARCHAR, level BIGINT, start_line BIGINT, end_line BIGINT, parent_id VARCHAR, depth BIGINT, path VARCHAR, last_pos BIGINT", _edge_tree()),
    "toc_render": f"WITH {_OUTLINE} SELECT doc_name, string_agg({_LINE}, chr(10) ORDER BY pos) AS toc FROM t GROUP BY doc_name",
    "toc_render_two_levels": f"WITH {_OUTLINE} SELECT doc_name, string_agg({_LINE}, chr(10) ORDER BY pos) AS toc FROM t WHERE level <= 2 GROUP BY doc_name",
    "high_level_view": f"""
        WITH {_OUTLINE}, k AS (SELECT *, CASE WHEN level = 2 THEN row_number() OVER (PARTITION BY doc_name, level ORDER BY pos) END AS child_rank FROM t WHERE level <= 2)
        SELECT doc_name, pos, node_id, title, '' AS summary, last_pos > pos AS has_children, (level - 1)::BIGINT AS depth, child_rank FROM k WHERE child_rank IS NULL OR child_rank <= 5""",
    "enhanced_view": f"WITH {_OUTLINE} SELECT doc_name, pos, node_id, title, level::BIGINT AS level, (level - 1)::BIGINT AS depth, summary, start_line || '-' || end_line AS line_range FROM t",
    "subtree_view": f"WITH {_OUTLINE} SELECT b.doc_name, a.node_id AS of_id, b.node_id, b.title, (b.level - a.level)::BIGINT AS rel_depth FROM t a JOIN t b ON a.doc_name = b.doc_name AND a.nk = b.nk WHERE a.level = 2",
    "find_node": f"WITH {_OUTLINE} SELECT doc_name, pos, node_id, title, level::BIGINT AS level FROM t WHERE node_id = '0003'",
    "node_map": f"WITH {_OUTLINE} SELECT doc_name, node_id, title FROM t",
    "subtree_contents": f"""
        WITH {_OUTLINE}, s AS (SELECT a.doc_name, a.node_id, string_agg(b.content, chr(10) || chr(10) ORDER BY b.pos) AS c FROM t a JOIN t b ON a.doc_name = b.doc_name AND b.pos BETWEEN a.pos AND a.last_pos WHERE a.level <= 2 GROUP BY ALL)
        SELECT doc_name, node_id, md5(c) AS content_md5, length(c)::BIGINT AS n_chars FROM s""",
    "first_roots": _values("doc_name VARCHAR, node_id VARCHAR, relevance DOUBLE", [(d, i, 0.5) for d, n, i, *_, depth, _p, _l in _edge_tree() if depth == 0]),
    "kb_statistics": f"""
        WITH {_OUTLINE}, a AS (SELECT doc_name, content FROM t), {_CHATS.replace(chr(10) + "t AS", chr(10) + "u AS")}, z AS (SELECT * FROM a UNION ALL SELECT doc_name, content FROM u)
        SELECT sum(length(content))::BIGINT AS total_chars, (sum(length(content)) // 3)::BIGINT AS estimated_tokens, count(*) AS total_nodes, count(DISTINCT doc_name) AS total_documents FROM z""",
    "doc_listing": f"""
        WITH {_OUTLINE} SELECT doc_name, substring(string_agg(content, chr(10) ORDER BY pos), 1, 200) AS description, count(*) AS total_nodes, count(*) FILTER (summary <> '') AS nodes_with_summary,
        count(*) = count(*) FILTER (summary <> '') AS has_full_summary FROM t GROUP BY doc_name""",
    "summary_coverage": f"WITH {_OUTLINE} SELECT count(*) AS total_nodes, count(*) FILTER (summary <> '') AS nodes_with_summary, count(*) FILTER (summary <> '') / count(*)::DOUBLE AS coverage FROM t",
    "thinking_text": f"""
        WITH {_SCORES}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM s)
        SELECT string_agg('- ' || doc_name || '/' || node_id || ': ' || CASE WHEN rank = 2 THEN 'because' ELSE 'score=' || printf('%.2f', score) END, chr(10) ORDER BY rank) AS thinking FROM k WHERE rank <= 3""",
    "contexts": f"WITH {_OUTLINE}, {_HITS} SELECT doc_name, node_id, title, md5(content) AS content_md5, relevance FROM ctx",
    "combined_context": f"""
        WITH {_OUTLINE}, {_HITS}, j AS (SELECT string_agg('## [' || doc_name || '] ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY relevance DESC, rank) AS x, string_agg(DISTINCT doc_name, ',' ORDER BY doc_name) AS f FROM ctx)
        SELECT length(x)::BIGINT AS n_chars, md5(x) AS context_md5, f AS source_files FROM j""",
    "context_savings": f"""
        WITH {_OUTLINE}, {_HITS}, k AS (SELECT sum(length(content))::BIGINT AS a FROM t), u AS (SELECT sum(length(content))::BIGINT AS b FROM ctx)
        SELECT a AS kb_chars, b AS context_chars, b // 3 AS context_tokens, round((a - b) * 100.0::DOUBLE / a, 1) AS saved_percent FROM k, u""",
    "vec_topk": f"WITH {_SCORES} SELECT doc_name, node_id, score FROM s ORDER BY score DESC, node_id LIMIT 20",
    "vec_threshold": f"WITH {_SCORES} SELECT doc_name, node_id, score FROM s WHERE score >= 0.1",
    "vec_chunk_search": """
        WITH s AS (SELECT vec_id // 5 AS k, vec_id % 5 AS c, list_sum(list_transform(embedding, lambda x: x::DOUBLE * 0.125)) AS s FROM embeddings),
        g AS (SELECT k, max(s) FILTER (c = 0) AS own, coalesce(sum(s) FILTER (c > 0), 0) / sqrt(count(*) FILTER (c > 0) + 1) AS pieces, count(*) FILTER (c > 0) AS n FROM s GROUP BY k)
        SELECT 'all' AS doc_name, format('{:04d}', k) AS node_id, round(CASE WHEN n = 0 THEN own ELSE greatest(own, pieces) END, 6) AS score, n AS n_chunks FROM g ORDER BY score DESC, node_id LIMIT 25""",
    "vec_statistics": "SELECT count(*) FILTER (vec_id % 5 = 0) AS total_nodes, max(len(embedding))::BIGINT AS dimension, count(DISTINCT label) FILTER (vec_id % 5 = 0) AS total_documents, count(*) FILTER (vec_id % 5 > 0) AS total_chunks FROM embeddings",
    "fuse_hybrid": f"{_FUSED} SELECT doc_name, node_id, title, round(final_score, 6) AS final_score, vector_score, reasoning_score, reasoning, source FROM f",
    "fuse_sources": f"{_FUSED} SELECT source, count(*) AS n FROM f GROUP BY source",
    "previews": r"""
        WITH c AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '```.*?```', '', 'gs'), '`[^`]+`', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '!\[([^\]]*)\]\([^)]+\)', '', 'g') AS p FROM documents)
        SELECT 'doc-' || doc_id AS doc_name, regexp_replace(substring(p, 1, 300), '^\s+|\s+$', '', 'g') || CASE WHEN length(t) > 300 THEN '...' ELSE '' END AS preview FROM c""",
    "reply_cleaning": _values("k VARCHAR, clean VARCHAR, unwrapped VARCHAR", [
        ("fence", '```json\n{"a": 1}\n```', '```json\n{"a": 1}'), ("prose", 'Sure: {"a": [1, 2]} done', 'Sure: {"a": [1, 2]} done'), ("think", '{"b": "x"}', '<think>no {</think>{"b": "x"}'),
        ("bad", "{not json}", "{not json}"), ("none", "nothing", "nothing"), ("label", "Short text", "**Summary:** Short text"), ("cjk", "内容", "摘要：内容"), ("colon", "odd\nsecond", ": odd\nDescription: second"),
        ("plain", "keep", "keep"), ("markdown", "```markdown\n# T\nx\n```", "# T\nx"),
    ]),
    "reply_json": _values("k VARCHAR, json VARCHAR", [
        ("fence", '{"a":1}'), ("prose", '{"a":[1,2]}'), ("think", '{"b":"x"}'), ("bad", None), ("none", None), ("label", None), ("cjk", None), ("colon", None), ("plain", None), ("markdown", None),
    ]),
    "code_blocks": _values("doc_name VARCHAR, n BIGINT, language VARCHAR, code VARCHAR", [("a", 0, "python", "print(1)\n"), ("a", 1, "", "plain\n"), ("c", 0, "sql", "select 1\n")]),
    "chunk_texts": f"""
        WITH RECURSIVE src AS (SELECT 'doc-' || doc_id AS doc_name, text AS t FROM documents), {_chunks("src")}
        SELECT doc_name, row_number() OVER (PARTITION BY doc_name ORDER BY k) - 1 AS chunk_no, length(c)::BIGINT AS n_chars, md5(c) AS chunk_md5 FROM c WHERE c <> ''""",
    "hashed_vectors": """
        WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM conversations),
        p AS (SELECT conv_id, turn, (('0x' || substring(md5(w), 1, 8))::BIGINT % 64) AS place, 1 - 2 * (('0x' || substring(md5(w), 9, 1))::BIGINT % 2) AS sign FROM w),
        g AS (SELECT conv_id, turn, place, sum(sign)::DOUBLE AS x FROM p GROUP BY ALL)
        SELECT conv_id, turn, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)), 6) AS x FROM g WHERE x <> 0""",
    "toc_detected": _values("doc_name VARCHAR, kind VARCHAR, start_line BIGINT, end_line BIGINT, confidence DOUBLE, entries VARCHAR", [
        ("marker", "marker", 3, 3, 1.0, ""), ("links", "links", 2, 7, 0.8, "1|A;2|B;1|C;1|D"), ("numbered", "text", 1, 4, 0.6, "1|First;1|1 Second;1|Third"), ("dotted", "text", 2, 6, 0.6, "1|Intro;1|Body;1|End"),
    ]),
    "toc_levels": _values("doc_name VARCHAR, pos BIGINT, title VARCHAR, level BIGINT", [("x", 1, "Doc", 1), ("x", 2, "Contents", 2), ("x", 3, "deep one", 1), ("x", 4, "Two", 3), ("x", 5, "three", 1), ("x", 6, "four", 1)]),
    "page_urls": f"""
        WITH u AS (SELECT page_id, url, {_URL.format(1)} AS d, {_URL.format(2)} AS p FROM pages)
        SELECT page_id, d AS domain, substring(regexp_replace(replace(d, '.', '_') || replace(p, '/', '_'), '^_+|_+$', '', 'g'), 1, 100) AS doc_name,
          regexp_replace(regexp_replace(regexp_replace(d || p, '[^\\pL\\pM\\pN_.-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS file_name,
          NOT regexp_matches(lower(p), '\\.(jpg|jpeg|png|gif|bmp|svg|webp|ico|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z|tar|gz|mp3|mp4|avi|mov|wmv|flv|css|js|json|xml|exe|dmg|apk)$') AS crawlable FROM u""",
    "page_titles": "SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages",
    "page_links": """
        SELECT DISTINCT url, regexp_extract(url, '^(https?://[^/]*)', 1) || unnest(regexp_extract_all(html, '<a href="(/[^"#]*)', 1)) AS link FROM pages""",
    "crawl_levels": """
        WITH RECURSIVE c AS (SELECT 0 AS k, 0 AS level UNION ALL SELECT unnest([2 * k + 1, 2 * k + 2]), level + 1 FROM c WHERE level < 3 AND k < 25)
        SELECT 'http://web.test/n/' || k AS url, level::BIGINT AS level, k < 25 AS found FROM c""",
    "crawl_counts": "SELECT 25::BIGINT AS success_count, 6::BIGINT AS failed_count, 100::BIGINT AS total_links",
    "missing_documents": f"WITH {_OUTLINE} SELECT DISTINCT doc_name FROM o WHERE doc_name NOT LIKE 'A%'",
    "upserted_documents": f"WITH {_OUTLINE} SELECT DISTINCT doc_name, CASE WHEN r_regionkey >= 3 THEN 'new' ELSE 'old' END AS content FROM oc UNION ALL SELECT 'EXTRA', 'new'",
    "event_windows": "SELECT (epoch(date_trunc('hour', ts)))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    # The completer's choice: the share of the query's four (two) words that stand in a node's title and summary.
    "reasoning_search": f"""
        WITH {_OUTLINE}, s AS (SELECT doc_name, node_id, title, (CASE WHEN title = 'NATION_3' THEN 0.5 WHEN level = 2 OR body = 'MACHINERY' THEN 0.25 END)::DOUBLE AS score FROM t)
        SELECT *, row_number() OVER (ORDER BY score DESC, doc_name, node_id) AS rank FROM s WHERE score IS NOT NULL ORDER BY rank LIMIT 20""",
    "single_round": f"""
        WITH {_OUTLINE} SELECT doc_name, node_id, title, (CASE WHEN body = 'BUILDING' THEN 1.0 ELSE 0.5 END)::DOUBLE AS score FROM t WHERE level = 3 ORDER BY score DESC, doc_name, node_id LIMIT 10""",
    "fallback_search": f"WITH {_OUTLINE} SELECT DISTINCT doc_name, '0001' AS node_id, 0.5::DOUBLE AS relevance, 'Fallback selection' AS reason FROM o",
    "decomposed_queries": _values("query VARCHAR, sub_question VARCHAR", [("who paid and when was it shipped?", "who paid"), ("who paid and when was it shipped?", "when was it shipped"), ("one thing", "one thing")]),
    "judged_passages": """
        WITH w AS (SELECT item_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['the', 'of', 'and', 'to'])) / 4.0::DOUBLE AS s FROM benchmark)
        SELECT item_id, s >= 0.5 AS relevant, s AS confidence, s >= 0.5 AS contains_answer, s AS answer_confidence FROM w""",
    "md_files": f"WITH {_OUTLINE} SELECT doc_name, md5(string_agg(content, chr(10) ORDER BY pos) || chr(10)) AS content_md5 FROM t GROUP BY doc_name",
    "upload_names": "SELECT doc_id, 'doc ' || doc_id || ['.md', '.PDF', '.Markdown', '.txt', '', '.tar.txt', '.md.exe'][doc_id % 7 + 1] AS name FROM documents WHERE doc_id % 7 IN (0, 2, 3, 5)",
    "index_round_trip": f"WITH {_OUTLINE} SELECT {_TREE}, (level - 1)::BIGINT AS depth, md5(content) AS content_md5 FROM t",
    "index_documents": f"WITH {_OUTLINE} SELECT doc_name, any_value(top) AS title, '' AS description, max(own_end)::BIGINT AS total_lines FROM t GROUP BY doc_name",
    "vector_round_trip": """
        SELECT 'doc-' || label AS doc_name, format('{:04d}', vec_id) AS node_id, CASE WHEN vec_id % 5 = 0 THEN 't' || format('{:04d}', vec_id) ELSE '' END AS title,
          round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings""",
    "saved_knowledge_base": f"WITH {_OUTLINE} SELECT doc_name, count(*) AS n_nodes, sum(length(content))::BIGINT AS n_chars, count(*) AS n_vectors FROM t GROUP BY doc_name",
    "added_documents": f"""
        WITH {_OUTLINE} SELECT doc_name, count(*) + CASE WHEN doc_name LIKE 'E%' OR doc_name LIKE 'AS%' THEN 2 ELSE 0 END AS total_nodes, total_nodes AS n_vectors FROM t
        WHERE doc_name LIKE 'A%' OR doc_name LIKE 'E%' GROUP BY doc_name""",
    "short_texts": "SELECT 'doc-' || doc_id AS doc_name, substring(coalesce(text, ''), 1, 120) || CASE WHEN length(text) > 120 THEN '...' ELSE '' END AS short FROM documents",
    "page_markdown": f"WITH {_PAGES} SELECT page_id, markdown FROM m",
    "page_simple_markdown": f"WITH {_PAGES} SELECT page_id, md5(simple) AS markdown_md5 FROM m",
    "page_texts": f"SELECT page_id, md5({_page_lines('script', 'style', 'nav', 'footer', 'header', 'aside')}) AS text_md5 FROM pages",
    "page_whole_texts": f"SELECT page_id, md5({_page_lines('script', 'style')}) AS text_md5 FROM pages",
    "page_documents": f"""
        WITH {_PAGES}, n AS (SELECT *, {_URL.format(1)} AS domain, substring(regexp_replace(replace({_URL.format(1)}, '.', '_') || replace({_URL.format(2)}, '/', '_'), '^_+|_+$', '', 'g'), 1, 100) AS doc_name FROM m)
        SELECT doc_name, arg_max(length(markdown), url)::BIGINT AS n_chars, arg_max(domain, url) AS domain FROM n GROUP BY doc_name""",
    "converted_pages": f"""
        WITH {_PAGES}, w AS (SELECT page_id, title, {_QUOTES.format("trim(regexp_replace(regexp_replace(" + _without("regexp_extract(html, '<body>(.*)', 1, 's')", 'script', 'style', 'nav', 'footer') + ", '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))")} AS words FROM g)
        SELECT page_id, md5({_STRIP.format("'# ' || title || chr(10) || chr(10) || words")}) AS markdown_md5 FROM w""",
    "page_metadata": "SELECT page_id, unnest(['og_url', 'author']) AS name, unnest([url, 'a' || page_id]) AS value FROM pages",
    "page_fences": f"""
        WITH {_PAGED} SELECT doc_name, line_no::BIGINT AS line_no, kind, in_code FROM mark""",
    "page_code_blocks": f"""
        WITH {_PAGED} SELECT doc_name, 'url' AS language, '# ' || url || chr(10) || title || chr(10) AS code FROM doc""",
    "page_tocs": f"""
        WITH {_PAGED} SELECT doc_name, 'links' AS kind, 2::BIGINT AS start_line, (n + 3)::BIGINT AS end_line, least(1, n / 5.0)::DOUBLE AS confidence, array_to_string(list_transform(names, lambda w, i: levels[i] || '|' || w || '|' || links[i]), ';') AS entries FROM doc WHERE n >= 3""",
    "page_toc_texts": f"""
        WITH {_PAGED} SELECT doc_name, array_to_string(list_transform(names, lambda w, i: repeat('  ', levels[i] - 1) || '- ' || w), chr(10)) AS toc FROM doc WHERE n >= 3""",
    "page_toc_levels": f"""
        WITH {_PAGED}, e AS (SELECT doc_name, unnest(names) AS name, unnest(levels) AS level, generate_subscripts(names, 1) AS i FROM doc), k AS (SELECT doc_name, lower(name) AS key, arg_max(level, i) AS level FROM e GROUP BY ALL),
        h AS (SELECT doc_name, row_number() OVER (PARTITION BY doc_name ORDER BY line_no) AS pos, trim(regexp_replace(regexp_replace(line, '^#+', ''), '\\s*#*\\s*$', '')) AS title, length(regexp_extract(line, '^#+')) AS level FROM mark WHERE kind = 'atx' AND NOT in_code)
        SELECT h.doc_name, pos::BIGINT AS pos, title, coalesce(k.level, h.level)::BIGINT AS level FROM h LEFT JOIN k ON k.doc_name = h.doc_name AND k.key = lower(title)""",
    "crawl_failures": f"WITH RECURSIVE {_WEB.format(depth=4, follows=_FAILS, to='true')} SELECT 'http://web.test/n/' || k AS url, level::BIGINT AS level, {_FAILS} AS found FROM c",
    "crawl_failure_counts": f"WITH RECURSIVE {_WEB.format(depth=4, follows=_FAILS, to='true')} SELECT count(*) FILTER ({_FAILS}) AS success_count, count(*) FILTER (NOT ({_FAILS})) AS failed_count, 4 * count(*) FILTER ({_FAILS}) AS total_links FROM c",
    "crawl_capped": "SELECT 'http://web.test/n/' || n_nationkey AS url, floor(log2(n_nationkey + 1))::BIGINT AS level, true AS found FROM nation WHERE n_nationkey < 6",
    "crawl_filtered": f"WITH RECURSIVE {_WEB.format(depth=4, follows='k < 25', to='k % 10 <> 2')} SELECT 'http://web.test/n/' || k AS url, level::BIGINT AS level, k < 25 AS found FROM c",
    "crawl_of_pages": f"""
        WITH f AS (SELECT * FROM pages ORDER BY url LIMIT 1), l AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]*)', 1) || unnest(regexp_extract_all(html, '<a href="(/[^"#]*)', 1)) AS url FROM f)
        SELECT url, 0::BIGINT AS level, true AS found FROM f UNION ALL SELECT url, 1, url IN (SELECT url FROM pages) FROM l""",
    "crawled_documents": f"""
        WITH RECURSIVE {_WEB.format(depth=3, follows=_FAILS, to='true')}, {_OUTLINE}
        SELECT doc_name, count(*) AS total_nodes FROM t GROUP BY doc_name UNION ALL SELECT 'web_test_n_' || k, 1 FROM c WHERE {_FAILS}""",
    "summaries": f"""
        WITH {_CHATS} SELECT doc_name, format('{{:04d}}', pos) AS node_id, {_STRIP.format("substring(split_part(" + _STRIP.format("substring(" + _STRIP.format("coalesce(text, '')") + ", 1, 2000)") + ", '. ', 1), 1, 200)")} AS summary FROM t""",
    "descriptions": f"WITH {_OUTLINE} SELECT doc_name, {_STRIP.format('substring(string_agg(content, chr(10) ORDER BY pos), 1, 200)')} AS description FROM t GROUP BY doc_name",
    "misnamed_nodes": f"WITH {_OUTLINE} SELECT doc_name, node_id, title, 0.4::DOUBLE AS score, 'why' AS reasoning FROM t WHERE level = 2",
    "fallback_to_one_round": f"WITH {_OUTLINE} SELECT doc_name, node_id, title, 1.0::DOUBLE AS score FROM t WHERE body = 'FURNITURE' ORDER BY doc_name, node_id LIMIT 10",
    "path_to_node": f"WITH {_OUTLINE} SELECT a.doc_name, a.pos::BIGINT AS pos, a.node_id, a.title FROM t a JOIN t b ON a.doc_name = b.doc_name AND b.node_id = '0003' AND b.pos BETWEEN a.pos AND a.last_pos",
    "relevance_map": f"WITH {_OUTLINE}, {_HITS} SELECT doc_name || ':' || node_id AS node, relevance FROM ctx",
    "chat_answer": f"""
        WITH {_title_hits("NATION 3", 0.1, 10)}, whole AS (SELECT h.rank, h.title, string_agg(b.content, chr(10) || chr(10) ORDER BY b.pos) AS content FROM hits h JOIN t a USING (doc_name, node_id) JOIN t b ON b.doc_name = a.doc_name AND b.pos BETWEEN a.pos AND a.last_pos GROUP BY ALL),
        j AS (SELECT string_agg('## ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM whole) SELECT trim(substring(context, 1, 500)) AS answer, md5(context) AS context_md5 FROM j""",
    "query_answer": f"""
        WITH {_title_hits("NATION 3", 0.1, 10)}, whole AS (SELECT h.doc_name, h.rank, h.title, string_agg(b.content, chr(10) || chr(10) ORDER BY b.pos) AS content FROM hits h JOIN t a USING (doc_name, node_id) JOIN t b ON b.doc_name = a.doc_name AND b.pos BETWEEN a.pos AND a.last_pos GROUP BY ALL)
        SELECT string_agg('## [' || doc_name || '] ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(DISTINCT doc_name, ',' ORDER BY doc_name) AS source_files, (SELECT sum(length(content)) FROM t)::BIGINT AS total_chars, 'vector' AS mode FROM whole""",
    # Reasoning looks at the documents of the ten best hits: first at nations, then at what lies below those that share a word.
    "hybrid_search": f"""
        WITH {_title_hits("nation 3 customer", 0.1, 20)}, near AS (SELECT DISTINCT doc_name FROM hits WHERE rank <= 10),
        shares AS (SELECT *, round(len(list_intersect(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')), ['nation', '3', 'customer'])) / 3.0::DOUBLE, 2) AS share, row_number() OVER (PARTITION BY doc_name, level ORDER BY pos) AS nth FROM t JOIN near USING (doc_name)),
        candidates AS (SELECT * FROM shares WHERE level = 1 AND share > 0 OR level = 2 AND nth <= 5 AND share > 0),
        found AS (SELECT DISTINCT b.doc_name, b.node_id, b.title, b.share AS score FROM candidates a JOIN shares b ON a.doc_name = b.doc_name AND b.pos BETWEEN a.pos AND a.last_pos WHERE b.share >= 0.3),
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_name, node_id) AS rank FROM found ORDER BY rank LIMIT 10),
        f AS (SELECT coalesce(h.doc_name, r.doc_name) AS doc_name, coalesce(h.node_id, r.node_id) AS node_id, coalesce(h.title, r.title) AS title, CASE WHEN r.score IS NULL THEN h.score * 0.4::DOUBLE ELSE coalesce(h.score, 0) * 0.4::DOUBLE + r.score * 0.6::DOUBLE END AS final_score,
          CASE WHEN r.score IS NULL THEN 'vector' WHEN h.score IS NOT NULL THEN 'both' ELSE 'reasoning' END AS source, h.rank AS hr, r.rank AS rr FROM hits h FULL JOIN r ON h.doc_name = r.doc_name AND h.node_id = r.node_id)
        SELECT doc_name, node_id, title, round(final_score, 6) AS final_score, source FROM f ORDER BY f.final_score DESC, hr NULLS LAST, rr, doc_name, node_id LIMIT 10""",
    "contexts_flagship": f"""
        WITH RECURSIVE {_CHATS}, src AS (SELECT doc_name || '|' || pos AS doc_name, content AS t FROM t), {_chunks("src").replace(chr(10) + "d AS", chr(10) + "cd AS").replace("FROM d" + chr(10), "FROM cd" + chr(10)).replace("c AS (SELECT doc_name, k, CASE", "pieces AS (SELECT doc_name, k, CASE").replace(chr(10) + "w AS (", chr(10) + "cw AS (").replace("FROM w WHERE", "FROM cw WHERE")},
        told AS (SELECT doc_name || '|' || pos AS node, -1 AS k, title AS txt FROM t UNION ALL SELECT doc_name, k, c FROM pieces WHERE c <> '' UNION ALL SELECT '', 0, 'the user asked about the answer'),
        keyed AS (SELECT (node, k) AS key, txt FROM told), {_embedded("keyed")},
        q AS (SELECT place, x FROM v WHERE key[1] = ''), products AS (SELECT a.key, sum(a.x * q.x) AS s FROM v a JOIN q USING (place) GROUP BY a.key),
        own AS (SELECT t.doc_name, t.pos, coalesce(p.s, 0) AS own FROM t LEFT JOIN products p ON p.key[1] = t.doc_name || '|' || t.pos AND p.key[2] = -1),
        n AS (SELECT node, count(*) AS n FROM told WHERE k >= 0 AND node <> '' GROUP BY node), ps AS (SELECT key[1] AS node, sum(s) AS s FROM products WHERE key[2] >= 0 AND key[1] <> '' GROUP BY 1),
        scored AS (SELECT o.doc_name, o.pos, CASE WHEN n.n IS NULL THEN own ELSE greatest(own, coalesce(ps.s, 0) / sqrt(n.n + 1)) END AS score FROM own o LEFT JOIN n ON n.node = o.doc_name || '|' || o.pos LEFT JOIN ps ON ps.node = n.node),
        best AS (SELECT * FROM scored WHERE score >= 0 ORDER BY score DESC, doc_name, format('{{:04d}}', pos) LIMIT 10)
        SELECT b.doc_name, format('{{:04d}}', b.pos) AS node_id, any_value(a.title) AS title, string_agg(z.content, chr(10) || chr(10) ORDER BY z.pos) AS content, round(b.score, 6) AS relevance
        FROM best b JOIN t a USING (doc_name, pos) JOIN t z ON z.doc_name = b.doc_name AND (z.pos = b.pos OR a.level = 1) GROUP BY b.doc_name, b.pos, b.score""",
    "turn_replies": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations)
        SELECT conv_id, turn, md5({_STRIP.format("CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || '{\"turn\": ' || turn || '}' || chr(10) || '```' WHEN 1 THEN '{\"b\": [' || turn || ', 1]}' WHEN 2 THEN x ELSE '```markdown' || chr(10) || x || chr(10) || '```' END")}) AS clean_md5,
          md5({_STRIP.format("CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || '{\"turn\": ' || turn || '}' WHEN 1 THEN '<think>{ ' || x || ' </think>{\"b\": [' || turn || ', 1]}' WHEN 2 THEN '**Summary:** ' || x ELSE x END")}) AS unwrapped_md5,
          CASE turn % 4 WHEN 0 THEN '{{"turn":' || turn || '}}' WHEN 1 THEN '{{"b":[' || turn || ',1]}}' END AS json FROM c""",
    "decomposed_turns": f"""
        WITH q AS (SELECT DISTINCT text FROM conversations WHERE role = 'user' AND trim(text) <> ''),
        p AS (SELECT text, list_filter(list_transform(string_split(replace(text, '?', ' and '), ' and '), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS parts FROM q)
        SELECT md5(text) AS query_md5, unnest(CASE WHEN len(parts) > 1 THEN parts ELSE [text] END) AS sub_question FROM p""",
}
