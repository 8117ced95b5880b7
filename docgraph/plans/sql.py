"""Common table expressions of the DuckDB side, by name; a query names those it needs last."""

from __future__ import annotations

import re

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return _STRIP.format(x)


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def markup(x: str) -> str:
    s = strip(x)
    return f"({s} = '' OR starts_with({s}, '#') OR (starts_with({s}, '<!--') AND suffix({s}, '-->')) OR regexp_full_match({s}, '[-=*]{{3,}}'))"


def text_line(x: str) -> str:
    return f"(NOT {markup(x)} AND regexp_matches({x}, '[A-Za-z0-9]'))"


def last_index(x: str, what: str, n: int) -> str:
    return f"(CASE WHEN instr(reverse({x}), reverse({what})) > 0 THEN length({x}) - instr(reverse({x}), reverse({what})) - {n - 1} ELSE -1 END)"


def cut_at_sentence(x: str, most: int) -> str:
    h = f"left({x}, {most})"
    cut = f"greatest({last_index(h, repr('. '), 2)}, {last_index(h, 'chr(10)', 1)})"
    return f"(CASE WHEN {cut} > length({h}) * 0.7::DOUBLE THEN left({h}, {cut} + 1) ELSE {h} END || '...')"


PB = "<!-- page break -->"
CTES: dict[str, str] = {
    "md": rf"""
SELECT doc_id, string_agg(line, chr(10) ORDER BY n, k) AS markdown FROM (
    SELECT doc_id, n, u.k, u.line FROM (
        SELECT doc_id, n, x, coalesce(w[1], '') AS a, coalesce(w[2], '') AS b, coalesce(w[3], '') AS c, coalesce(w[4], '') AS d, w
        FROM (SELECT doc_id, n, x, string_split(x, ' ') AS w FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS l(x, n))
    ), unnest(
        (CASE WHEN n % 3 = 1 THEN [repeat('#', (1 + (n // 3) % 3)::INT) || ' ' || array_to_string(w[1:3], ' ')] ELSE [] END)
        || (CASE WHEN n % 7 = 3 THEN ['| ' || a || ' | ' || b || ' | ' || b || ' |', '|---|---|---|', '| 1. | ' || c || ' |  |', '|  | ' || a || ' | ' || b || ' |  |', '| ' || d || ' | ' || d || ' |'] ELSE [] END)
        || [x] || (CASE WHEN n % 5 = 0 THEN ['{PB}'] ELSE [] END)
    ) WITH ORDINALITY AS u(line, k)
) GROUP BY doc_id""",
    "lines": "SELECT doc_id, u.line_no::INT AS line_no, u.text FROM md, unnest(string_split(markdown, chr(10))) WITH ORDINALITY AS u(text, line_no)",
    "paged": f"SELECT *, (1 + coalesce(sum((contains(text, '{PB}'))::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS page_number FROM lines",
    "pages_nb": rf"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number))::INT AS nonblank_page_no, page_number::INT AS page_number, text FROM (SELECT doc_id, u.page_number, {strip('u.t')} AS text FROM md, unnest(string_split(markdown, '{PB}')) WITH ORDINALITY AS u(t, page_number)) WHERE text != ''",
    "heads": rf"SELECT doc_id, line_no AS line, length(regexp_extract({strip('text')}, '^(#+)\s+(.+)$', 1))::INT AS level, regexp_extract({strip('text')}, '^(#+)\s+(.+)$', 2) AS title FROM lines WHERE regexp_matches({strip('text')}, '^(#+)\s+(.+)$')",
    "headers": """
SELECT doc_id, i.line, i.level, i.title, string_agg(j.title, ' > ' ORDER BY j.line) AS section_path
FROM heads i JOIN heads j USING (doc_id)
WHERE j.line = i.line OR (j.line < i.line AND j.level < i.level
      AND NOT EXISTS (SELECT 1 FROM heads k WHERE k.doc_id = i.doc_id AND k.line > j.line AND k.line <= i.line AND k.level <= j.level))
GROUP BY doc_id, i.line, i.level, i.title""",
    "tlines": f"SELECT *, starts_with({strip('text')}, '|') AS is_table FROM lines",
    "trows": rf"""
SELECT doc_id, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run, line_no, text,
       list_transform(string_split(regexp_replace(text, '^\|+|\|+$', '', 'g'), '|'), lambda c: {strip('c')}) AS cells
FROM tlines WHERE is_table""",
    "trows2": rf"""
SELECT doc_id, run, line_no, (row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) - 1)::INT AS row_no, cells,
       list_filter(list_transform(cells, lambda c: {collapse('c')}), lambda c: c != '') AS filled,
       array_to_string(list_transform(cells, lambda c: {collapse('c')}), '') AS all_text
FROM trows""",
    "tkinds": rf"""
SELECT doc_id, run, line_no, row_no, cells, filled,
       coalesce((length(all_text) - length(replace(all_text, '-', ''))) / nullif(length(all_text), 0) > 0.8::DOUBLE, false) AS is_separator,
       len(list_filter(filled, lambda c: NOT regexp_full_match(c, '[0-9.,%-]+'))) / greatest(len(cells), 1) > 0.7::DOUBLE AS is_header_like,
       len(cells) >= 3 AND regexp_full_match(cells[1], '[0-9]+\.') AND {collapse('cells[len(cells)]')} = '' AND {collapse('cells[2]')} != '' AS is_group,
       {collapse('cells[1]')} = '' AND {collapse('cells[len(cells)]')} != '' AS is_child
FROM trows2""",
    "tsub": "SELECT *, (sum((row_no > 0 AND NOT is_separator AND len(list_distinct(filled)) = 1)::INT) OVER (PARTITION BY doc_id, run ORDER BY line_no))::INT AS sub FROM tkinds",
    "tunder": """
SELECT *, last_value(CASE WHEN is_group THEN 'group' WHEN NOT is_child THEN 'other' END IGNORE NULLS) OVER (PARTITION BY doc_id, run, sub ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under
FROM tsub WHERE NOT is_separator""",
    "tcells": f"""
SELECT doc_id, run, sub, line_no, CASE WHEN is_group THEN cells
    WHEN is_child AND under = 'group' THEN list_transform(cells, lambda c, i: CASE WHEN i = 2 THEN '↳ ' || c ELSE c END)
    WHEN is_header_like THEN list_transform(cells, lambda c, i: CASE WHEN i > 1 AND {collapse('c')} = {collapse('cells[i - 1]')} THEN '' ELSE c END)
    ELSE cells END AS cells
FROM tunder""",
    "tlast": f"SELECT *, max(list_max(list_transform(cells, lambda c, i: CASE WHEN {collapse('c')} != '' THEN i ELSE 0 END))) OVER (PARTITION BY doc_id, run, sub) AS last FROM tcells",
    "tcut": "SELECT doc_id, run, sub, line_no, CASE WHEN last > 0 THEN cells[1:last] ELSE cells END AS cells FROM tlast",
    "tfixed": "SELECT doc_id, run, sub, line_no, list_concat(cells, list_transform(range(max(len(cells)) OVER (PARTITION BY doc_id, run, sub) - len(cells)), lambda i: '')) AS cells FROM tcut",
    "regions": rf"""
SELECT doc_id, h.line, h.level, h.title, h.section_path, least(1000, greatest(300, length(markdown) // 8))::INT AS size,
       array_to_string(own, chr(10)) || chr(10) AS region
FROM (SELECT h.*, markdown, ls[h.line + 1:coalesce(nxt - 1, len(ls))] AS own
      FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM headers) h
      JOIN (SELECT doc_id, markdown, string_split(markdown, chr(10)) AS ls FROM md) m USING (doc_id)) h
WHERE len(list_filter(own, lambda x: {text_line('x')})) > 0""",
    "cuts": """
SELECT doc_id, line, level, title, section_path, size, k::INT AS k, substr(region, (k * size + 1)::INT, size) AS content,
       (line + 1 + length(left(region, (k * size)::INT)) - length(replace(left(region, (k * size)::INT), chr(10), '')))::INT AS start_line,
       (row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1)::INT AS position
FROM regions, unnest(range(0, ((length(region) + size - 1) // size))) AS u(k)""",
    "filled_cuts": rf"""
SELECT *, len(rows) > 0 AS has_table, CASE WHEN len(rows) > 0 THEN array_to_string(rows[1:3], chr(10)) END AS table_context, CASE WHEN len(rows) > 0 THEN 'table' ELSE 'text' END AS chunk_type,
       list_distinct(list_filter(string_split(left({collapse('content')}, 1500), ' '), lambda w: w != '')) AS words
FROM (SELECT *, list_filter(string_split(content, chr(10)), lambda x: starts_with({strip('x')}, '|')) AS rows FROM cuts)
WHERE len(list_filter(string_split(content, chr(10)), lambda x: NOT {markup('x')} AND regexp_matches(x, '[A-Za-z0-9]'))) > 0""",
    "dup_pairs": """
SELECT a.doc_id, a.position AS p, b.position AS q FROM filled_cuts a JOIN filled_cuts b ON a.doc_id = b.doc_id AND a.position < b.position
WHERE len(a.words) > 0 AND len(list_intersect(a.words, b.words)) / nullif(len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)), 0) >= 0.9::DOUBLE""",
    "ranked_cuts": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS rk FROM filled_cuts",
    "fold": """
SELECT doc_id, 0::BIGINT AS rk, []::INT[] AS kept FROM (SELECT DISTINCT doc_id FROM filled_cuts)
UNION ALL
SELECT f.doc_id, r.rk, CASE WHEN EXISTS (SELECT 1 FROM dup_pairs d WHERE d.doc_id = r.doc_id AND d.q = r.position AND list_contains(f.kept, d.p)) THEN f.kept ELSE list_append(f.kept, r.position) END
FROM fold f JOIN ranked_cuts r ON r.doc_id = f.doc_id AND r.rk = f.rk + 1""",
    "kept_cuts": "SELECT c.* FROM filled_cuts c JOIN (SELECT doc_id, arg_max(kept, rk) AS kept FROM fold GROUP BY doc_id) k ON k.doc_id = c.doc_id AND list_contains(k.kept, c.position)",
    "chunks": r"""
SELECT doc_id, chunk_index, content, length(content)::INT AS chunk_size,
       coalesce(nullif(title, ''), nullif(section_path, ''), 'Chunk ' || (position + 1)) AS heading, section_path, title AS section_title, level AS section_level,
       chunk_type, table_context, start_line, has_table,
       list_filter([chunk_index - 2, chunk_index - 1], lambda x: x >= 0) AS prev_chunk_ids, list_filter([chunk_index + 1, chunk_index + 2], lambda x: x < n) AS next_chunk_ids, chunk_index AS sequential_position
FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY doc_id)::INT AS n FROM kept_cuts)""",
}


def query(last: str) -> str:
    """``last`` with the expressions that it needs, and those that these need, in order."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(CTES[name])

    need(last)
    own = last.strip()
    parts = [f"{n} AS {'' if n == 'fold' else 'MATERIALIZED '}({CTES[n].strip()})" for n in CTES if n in needed]
    if not parts:
        return last
    rest = f", {own.removeprefix('WITH ').removeprefix('RECURSIVE ')}" if own.startswith("WITH ") else f"\n{own}"
    return f"WITH {'RECURSIVE ' if 'fold' in needed or own.startswith('WITH RECURSIVE') else ''}{', '.join(parts)}{rest}"
