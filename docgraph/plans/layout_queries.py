"""Queries over layout, table repair and chunking, each with its DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import chunking as C
from docgraph.operators import layout as L
from docgraph.operators import tables as R
from docgraph.plans import sql as S
from docgraph.plans.adapters import markdown, table

QUERIES, SQL = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = S.query(sql)


def lines(s, d):
    return L.lines(markdown(s, d))


def paged(s, d):
    return L.line_pages(lines(s, d))


def chunks(s, d, of=None):
    return C.chunk_documents(markdown(s, d, of))


PB = T.PAGE_BREAK
register("l01_lines", lines, "SELECT * FROM lines")
register("l02_line_pages", paged, "SELECT * FROM paged")
register("l03_page_spans", lambda s, d: L.page_spans(paged(s, d)), f"SELECT doc_id, page_number, min(line_no) - 1 AS start_line, max(line_no) - 1 AS end_line FROM paged GROUP BY ALL HAVING bool_or(NOT contains(text, '{PB}'))")
register("l04_page_counts", lambda s, d: L.page_counts(markdown(s, d)), f"SELECT doc_id, (count(*) FILTER (WHERE contains(text, '{PB}')) + 1)::INT AS total_pages FROM lines GROUP BY doc_id")
register(
    "l05_approximate_pages", lambda s, d: L.approximate_pages(markdown(s, d)),
    "SELECT doc_id, ((line_no - 1) // 50 + 1)::INT AS page_number, min(line_no) - 1 AS start_line, max(line_no) - 1 AS end_line, (max(n) // 50 + 1)::INT AS total_pages FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) GROUP BY 1, 2",
)
register("l06_join_fragments", lambda s, d: L.join_pages(L.join_fragments(paged(s, d).select("doc_id", "page_number", F.col("line_no").alias("seq"), "text"))),
         f"SELECT doc_id, string_agg(t, chr(10) || '{PB}' || chr(10) ORDER BY page_number) AS markdown FROM (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY line_no) AS t FROM paged GROUP BY 1, 2) GROUP BY 1")
register("l07_split_pages", lambda s, d: L.split_pages(markdown(s, d)), "SELECT * FROM pages_nb")
register("l08_l09_headers", lambda s, d: L.headers(markdown(s, d)), "SELECT * FROM headers")
register("l10_table_ranges", lambda s, d: L.table_ranges(lines(s, d)), """
SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, min(section) AS section FROM (
  SELECT t.*, t.line_no - row_number() OVER (PARTITION BY t.doc_id ORDER BY t.line_no) AS g, (SELECT arg_max(title, line) FROM heads h WHERE h.doc_id = t.doc_id AND h.line < t.line_no) AS section FROM tlines t WHERE is_table
) JOIN (SELECT doc_id, max(line_no) AS last_line FROM lines GROUP BY 1) USING (doc_id) GROUP BY doc_id, g HAVING max(line_no) < max(last_line)""")
register("l11_level_histogram", lambda s, d: L.level_histogram(L.headers(markdown(s, d))), "SELECT doc_id, level, count(*) AS n_headers FROM heads GROUP BY 1, 2")
register("l12_deepest_sections", lambda s, d: L.deepest_sections(lines(s, d), L.headers(markdown(s, d))), """
SELECT l.doc_id, line_no, best.section_path, best.level, best.line AS start_line FROM (
  SELECT l.doc_id, l.line_no, arg_max({'section_path': section_path, 'level': level, 'line': line}, level * 1000000 + line) AS best
  FROM lines l LEFT JOIN headers h ON h.doc_id = l.doc_id AND h.line <= l.line_no GROUP BY 1, 2) l""")
register("l13_image_only", lambda s, d: L.image_only(markdown(s, d)), f"SELECT doc_id, bool_and({S.strip('text')} IN ('', '{PB}', '<!-- image -->')) AS image_only FROM lines GROUP BY 1")
register("l14_l15_cells", lambda s, d: lines(s, d).select("doc_id", "line_no", T.collapse(F.col("text")).alias("cell"), T.is_numeric(F.col("text")).alias("is_numeric")),
         f"SELECT doc_id, line_no, {S.collapse('text')} AS cell, regexp_full_match({S.collapse('text')}, '[0-9.,%-]+') AS is_numeric FROM lines")
register("l16_l19_table_rows", lambda s, d: R.table_rows(lines(s, d)).drop("run"), "SELECT doc_id, line_no, row_no, cells, is_separator, is_header_like, is_group, is_child FROM tkinds")
register("l20_blank_repeats", lambda s, d: R.table_rows(lines(s, d)).where("is_header_like").select("doc_id", "line_no", R.blank_repeats(F.col("cells")).alias("cells")),
         f"SELECT doc_id, line_no, list_transform(cells, lambda c, i: CASE WHEN i > 1 AND {S.collapse('c')} = {S.collapse('cells[i - 1]')} THEN '' ELSE c END) AS cells FROM tkinds WHERE is_header_like")
register("l21_split_tables", lambda s, d: R.split_tables(R.table_rows(lines(s, d))).select("doc_id", "line_no", "sub"), "SELECT doc_id, line_no, sub FROM tsub")
register("l22_l23_repaired_rows", lambda s, d: R.repaired_rows(R.table_rows(lines(s, d))).drop("run"), "SELECT doc_id, sub, line_no, cells FROM tfixed")
register("l24_repair_markdown", lambda s, d: R.repair_markdown(lines(s, d)), f"""
SELECT doc_id, string_agg(out, chr(10) ORDER BY line_no, k) AS markdown FROM (
  SELECT doc_id, line_no, 0 AS k, CASE WHEN contains(text, '{PB}') THEN '{PB}' ELSE text END AS out FROM tlines WHERE NOT is_table
  UNION ALL SELECT doc_id, line_no, 2, '| ' || array_to_string(cells, ' | ') || ' |' FROM tfixed
  UNION ALL SELECT doc_id, line_no, 3, '| ' || array_to_string(list_transform(cells, lambda c: '---'), ' | ') || ' |' FROM tfixed QUALIFY row_number() OVER (PARTITION BY doc_id, run, sub ORDER BY line_no) = 1
  UNION ALL SELECT doc_id, line_no, 1, '' FROM tfixed QUALIFY row_number() OVER (PARTITION BY doc_id, run, sub ORDER BY line_no) = 1 AND lag(sub) OVER (PARTITION BY doc_id, run ORDER BY line_no) IS NOT NULL
) GROUP BY doc_id""")
register("c01_chunk_size", lambda s, d: markdown(s, d).select("doc_id", C.chunk_size(F.length("markdown")).alias("size")), "SELECT doc_id, least(1000, greatest(300, length(markdown) // 8))::INT AS size FROM md")
register("c02_text_lines", lambda s, d: lines(s, d).select("doc_id", "line_no", T.is_text_line(F.col("text")).alias("is_text")), f"SELECT doc_id, line_no, {S.text_line('text')} AS is_text FROM lines")
register("c03_regions", lambda s, d: C.regions(markdown(s, d)), "SELECT * FROM regions")
register("c04_slices", lambda s, d: C.slices(C.regions(markdown(s, d))), "SELECT * FROM cuts")
register("c05_headings", lambda s, d: C.slices(C.regions(markdown(s, d))).select("doc_id", "position", C.chunk_heading(F.when(F.col("k") == 0, F.col("title")), F.col("content"), F.col("section_path"), F.col("position")).alias("heading")),
         rf"SELECT doc_id, position, coalesce(CASE WHEN k = 0 THEN nullif(title, '') END, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_extract({S.strip('x')}, '^(#+)\s+(.+)$', 2)), lambda t: t != '')[1], nullif(string_split(section_path, ' > ')[-1], ''), 'Chunk ' || (position + 1)) AS heading FROM cuts")
register("c06_c08_table_flags", lambda s, d: C.with_table_flags(C.slices(C.regions(markdown(s, d))).where(~C.is_empty_chunk(F.col("content")))).select("doc_id", "position", "has_table", "table_context", "chunk_type"),
         "SELECT doc_id, position, has_table, table_context, chunk_type FROM filled_cuts")
register("c07_chunk_pages", lambda s, d: C.with_pages(chunks(s, d), paged(s, d)).select("doc_id", "chunk_index", "page_number"), "SELECT doc_id, chunk_index, page_number FROM chunks JOIN paged ON paged.doc_id = chunks.doc_id AND line_no = start_line".replace("SELECT doc_id", "SELECT chunks.doc_id"))
register("c09_near_repeats", lambda s, d: C.drop_near_repeats(C.slices(C.regions(markdown(s, d))).where(~C.is_empty_chunk(F.col("content")))).select("doc_id", "position"), "SELECT doc_id, position FROM kept_cuts")
register("c10_c11_chunks", chunks, "SELECT * FROM chunks")
register("c12_model_tokens", lambda s, d: table(s, d, "documents").select("doc_id", T.model_tokens(F.col("text")).alias("tokens")), "SELECT doc_id, floor(length(text) / 1.5)::BIGINT AS tokens FROM documents")
CUT = f"(CASE WHEN length(text) > 1000 THEN {S.cut_at_sentence('text', 1000)} ELSE text END)"
register("c13_fit_embedding", lambda s, d: table(s, d, "documents").select("doc_id", C.fit_embedding(F.col("text")).alias("e")).select("doc_id", "e.*"),
         f"SELECT doc_id, {CUT} AS text, length(text) > 1000 AS truncated, floor(length({CUT}) / 1.5)::BIGINT AS tokens FROM documents")
register("c14_fit_tokens", lambda s, d: table(s, d, "documents").select("doc_id", C.fit_tokens(F.col("text"), 800).alias("text")), f"SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text ELSE {S.cut_at_sentence('text', 1200)} END AS text FROM documents")
register("c15_final_cut", lambda s, d: table(s, d, "documents").select("doc_id", C.final_cut(F.col("text")).alias("text")), "SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS text FROM documents")
register("c16_stored_heading", lambda s, d: chunks(s, d).select("doc_id", "chunk_index", C.stored_heading(F.when(F.col("chunk_index") % 2 == 0, F.col("heading")).otherwise("Chunk 1"), F.col("section_title"), F.col("section_path"), F.col("chunk_index")).alias("heading"), C.end_line(F.col("start_line"), F.col("content")).alias("end_line")),
         "SELECT doc_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN heading ELSE section_title END AS heading, (start_line + length(content) - length(replace(content, chr(10), '')))::INT AS end_line FROM chunks")
register("c17_chunk_statistics", lambda s, d: C.chunk_statistics(table(s, d, "documents").select("doc_id", F.col("text").alias("content"))),
         f"SELECT doc_id, count(*) AS total_chunks, count(*) FILTER (WHERE length(text) > 1000) AS truncated_chunks, sum(floor(length({CUT}) / 1.5))::BIGINT AS embedding_tokens, sum(floor(length(text) / 1.5))::BIGINT AS llm_tokens FROM documents GROUP BY 1")
register("c18_pack_paragraphs", lambda s, d: C.pack_paragraphs(table(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("markdown"))),
         """WITH RECURSIVE para AS (SELECT doc_id, u.k, u.x || chr(10) || chr(10) AS p FROM documents, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) WITH ORDINALITY AS u(x, k) WHERE text != ''),
         walk AS (SELECT doc_id, k, 0 AS piece, length(p) AS n FROM para WHERE k = 1
                  UNION ALL SELECT b.doc_id, b.k, CASE WHEN a.n + length(b.p) <= 400 THEN a.piece ELSE a.piece + 1 END, CASE WHEN a.n + length(b.p) <= 400 THEN a.n + length(b.p) ELSE length(b.p) END FROM walk a JOIN para b ON b.doc_id = a.doc_id AND b.k = a.k + 1)
         SELECT doc_id, piece::INT AS piece, string_agg(p, '' ORDER BY k) AS text FROM walk JOIN para USING (doc_id, k) GROUP BY 1, 2""")  # fmt: skip
TOKENS = re.compile(r"\s*\S+|\s+$", re.ASCII).findall  # in place of a tokenizer, for SQL: words with the blanks before them
register("c12_tokens_by_tokenizer", lambda s, d: table(s, d, "documents").select("doc_id", T.tokens_by(TOKENS)(F.col("text")).alias("tokens")), r"SELECT doc_id, floor(len(regexp_extract_all(text, '\s*\S+|\s+$')) * 1.3::DOUBLE)::BIGINT AS tokens FROM documents")
register("c14_fit_by_tokenizer", lambda s, d: table(s, d, "documents").select("doc_id", C.fit_tokens_by(TOKENS, "".join)(F.col("text"), 200).alias("text")),
         rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+|\s+$') AS ids FROM documents), h AS (SELECT doc_id, text, len(ids) AS n, array_to_string(ids[1:190], '') AS head FROM t)
         SELECT doc_id, CASE WHEN n <= 200 THEN text ELSE {S.cut_at_sentence('head', 2**30)} END AS text FROM h""")  # fmt: skip
DENSE = "floor(2 * length({0}) * 1.3::DOUBLE)::BIGINT"
register("c15_final_cut_by_tokenizer", lambda s, d: table(s, d, "documents").select("doc_id", C.final_cut(F.col("text"), T.tokens_by(lambda t: t + t)).alias("text")),
         f"WITH x AS (SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS once FROM documents) SELECT doc_id, CASE WHEN {DENSE.format('once')} > 1500 THEN left(once, 800) || '...' ELSE once END AS text FROM x")
register("c17_statistics_by_tokenizer", lambda s, d: C.chunk_statistics(table(s, d, "documents").select("doc_id", F.substring("text", 1, 900).alias("content")), T.tokens_by(lambda t: t + t), lambda x, n: F.substring(x, 1, n // 3)),
         f"""WITH x AS (SELECT doc_id, left(text, 900) AS text FROM documents), f AS (SELECT doc_id, text, {DENSE.format('text')} AS llm, CASE WHEN {DENSE.format('text')} > 1275 THEN left(text, 425) ELSE text END AS e FROM x)
         SELECT doc_id, count(*) AS total_chunks, count(*) FILTER (WHERE llm > 1275) AS truncated_chunks, sum({DENSE.format('e')})::BIGINT AS embedding_tokens, sum(llm)::BIGINT AS llm_tokens FROM f GROUP BY 1""")  # fmt: skip
