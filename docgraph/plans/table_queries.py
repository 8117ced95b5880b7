"""Queries over inference, usage, the catalog, stored tables and streams, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docgraph.operators import catalog as K
from docgraph.operators import inference as P
from docgraph.operators import layout as L
from docgraph.operators import usage as U
from docgraph.functions import text as T
from docgraph.plans import sql as S
from docgraph.plans.adapters import markdown, table
from docgraph.plans.graph_queries import D_pages, chunks, used, query_rows, vectors, labelled
from docgraph.sources import readers
from docgraph.sources.shared import shared_dir
from docgraph.streaming import streams as Z

QUERIES, SQL = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = S.query(sql)


def usage_events(s, d):
    """events as usage: the type is the step, the user the document."""
    v = F.floor(F.col("value")).cast("long")
    return table(s, d, "events").select(
        "event_id", "ts", F.when(F.col("user_id") % 3 == 0, "pdf_upload").when(F.col("user_id") % 3 == 1, "vectorization").otherwise(F.col("event_type")).alias("step"), F.col("event_type").alias("phase"), F.col("user_id").alias("document_id"),
        v.alias("input_tokens"), F.call_function("div", v, F.lit(2)).alias("output_tokens"), (v * 3).alias("embedding_tokens"),
        F.when(F.col("event_id") % 4 == 0, "ollama").otherwise("openai").alias("provider"), F.when(F.col("event_id") % 3 == 0, "text-embedding-3-large").otherwise("other").alias("embedding_model"), F.lit("gpt-4o-mini").alias("llm_model"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("model"), F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") / 1000, 6)).alias("cost_estimate_usd"),
        F.struct((F.col("event_id") % 9).cast("int").alias("total_pages"), v.cast("int").alias("total_words"), F.lit(1).alias("total_chunks"), v.alias("total_tokens"), (F.col("value") / 2).alias("duration_seconds"), F.col("event_type").alias("filename"), (v * 4096).alias("file_size_bytes")).alias("extra"),
    )


S.CTES |= {
    "ue": """SELECT event_id, ts, CASE WHEN user_id % 3 = 0 THEN 'pdf_upload' WHEN user_id % 3 = 1 THEN 'vectorization' ELSE event_type END AS step, event_type AS phase, user_id AS document_id, floor(value)::BIGINT AS input_tokens,
        (floor(value)::BIGINT // 2) AS output_tokens, floor(value)::BIGINT * 3 AS embedding_tokens, value, event_type, CASE WHEN event_id % 7 != 0 THEN round(value / 1000, 6) END AS cost_estimate_usd FROM events""",
    "msgs": "SELECT conv_id AS session_id, turn AS id, role, text AS content FROM conversations",
    "sess": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 500 AS document_id, o_orderstatus = 'F' AS is_archived, o_orderdate AS updated_at FROM orders",
    "replies": """SELECT conv_id, turn, text, 'SUMMARY: ' || text || chr(10) || 'KEY_POINTS:' || chr(10) || '- ' || text || chr(10) || '* ' || text || chr(10) || 'CLASS: ' || CASE WHEN turn % 2 = 0 THEN 'page_summary' ELSE 'USE_HISTORY' END || chr(10) || 'PAGE_NUMBER: p ' || turn AS response FROM conversations""",
}


def replies(s, d):
    """conversations as model responses with the marks that parsers look for."""
    n = F.lit("\n")
    t = F.col("text")
    made = F.concat(F.lit("SUMMARY: "), t, n, F.lit("KEY_POINTS:"), n, F.lit("- "), t, n, F.lit("* "), t, n, F.lit("CLASS: "), F.when(F.col("turn") % 2 == 0, "page_summary").otherwise("USE_HISTORY"), n, F.lit("PAGE_NUMBER: p "), F.col("turn").cast("string"))
    return table(s, d, "conversations").select("conv_id", "turn", "text", made.alias("response"))


def class_replies(s, d):
    """Responses of a classifier: a text, then its class and a page in lines of their own; some classes are none, some pages no number."""
    t, turn = F.col("text"), F.col("turn")
    said = F.when(turn % 3 == 0, "page_summary").when(turn % 3 == 1, "use_history").otherwise(F.upper(F.substring(t, 1, 12)))
    page = F.concat(F.substring(t, 1, 3), F.lit(" "), F.when(F.col("conv_id") % 3 == 0, "").otherwise(turn.cast("string")))
    return table(s, d, "conversations").select(*by, F.concat(t, F.lit("\nClass: "), said, F.lit("\npage_number: "), page).alias("response"))


def overview_replies(s, d):
    """Responses with a summary and queries, as JSON and as parts."""
    ws = F.split("text", " ")
    parts = F.concat(F.lit("SUMMARY: "), "text", F.lit("\nQUERIES:\n"), F.array_join(ws, "\n"))
    return table(s, d, "conversations").select(*by, F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("summary"), ws.alias("queries")))).otherwise(parts).alias("response"))


def bulleted(text):
    """A text as a list of questions: a line after each comma and full stop."""
    return F.regexp_replace(text, "([.,]) ", "$1\n2) ")


def extraction_replies(s, d):
    """conversations as replies to the kinds in turn: an array with text around it, lines, a broken array, a failed call."""
    turn, text = F.col("turn"), F.col("text")
    array = F.concat(F.lit("Here: "), F.to_json(F.array(text, F.lit(""), F.lit(None), F.lit("b"))), F.lit(" done"))
    said = F.when(turn % 4 == 0, array).when(turn % 4 == 1, text).when(turn % 4 == 2, F.concat(F.lit("["), text, F.lit('", ]')))
    kind = F.get(F.array(*map(F.lit, P.EXTRACTION_KINDS)), (turn % 4).cast("int"))
    return table(s, d, "conversations").select((F.col("conv_id") * 1000 + turn).alias("doc_id"), kind.alias("kind"), said.alias("response"))


def messages(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


def sessions(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 500).alias("document_id"), (F.col("o_orderstatus") == "F").alias("is_archived"), F.col("o_orderdate").alias("updated_at"))


def records(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"))


def page_summaries(s, d):
    """pages as page summaries: five pages a document."""
    return table(s, d, "pages").select(F.floor(F.col("page_id") / 5).cast("long").alias("doc_id"), (F.col("page_id") % 5 + 1).cast("int").alias("page_number"), F.col("url").alias("summary"))


S.CTES["psum"] = "SELECT page_id // 5 AS doc_id, (page_id % 5 + 1)::INT AS page_number, url AS summary FROM pages"
S.CTES["excerpts"] = """SELECT doc_id, CASE WHEN length(x) > 12000 THEN left(x, 12000) || chr(10) || '...[truncated]' ELSE x END AS context
FROM (SELECT doc_id, string_agg(left(content, 800), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index) AS x FROM chunks WHERE chunk_index < 30 GROUP BY 1)"""
by = ("conv_id", "turn")
register("p01_complete", lambda s, d: P.complete(table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt")), lambda p: str(len(p))).select("conv_id", "turn", "response", "error"), "SELECT conv_id, turn, length(text)::VARCHAR AS response, NULL::VARCHAR AS error FROM conversations")
register("p02_page_texts", lambda s, d: P.page_texts(D_pages(s, d)), "SELECT doc_id, page_number, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM cpages GROUP BY 1, 2")
register("p03_page_contents", lambda s, d: P.page_contents(L.page_counts(markdown(s, d)).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("total_pages") + 3)).alias("page")), D_pages(s, d)), f"""
WITH r AS (SELECT doc_id, unnest(range(1, count(*) FILTER (WHERE contains(text, '{T.PAGE_BREAK}')) + 5))::INT AS page FROM lines GROUP BY doc_id),
f AS (SELECT r.doc_id, page, chunk_index, page_number, content, section_path, abs(page_number - page) AS away, min(abs(page_number - page)) OVER (PARTITION BY r.doc_id, page) AS least FROM r JOIN cpages c ON c.doc_id = r.doc_id AND abs(page_number - page) <= 2),
g AS (SELECT * FROM f WHERE away = least),
sec AS (SELECT doc_id, page, list(section_path ORDER BY k) AS sections FROM (SELECT doc_id, page, section_path, min(chunk_index) AS k FROM g WHERE section_path != '' GROUP BY ALL) GROUP BY 1, 2),
made AS (SELECT doc_id, page, bool_or(least > 0) AS used_adjacent, list_sort(list(DISTINCT page_number)) AS pages_used, list(chunk_index ORDER BY chunk_index) AS chunk_ids, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM g GROUP BY 1, 2)
SELECT r.doc_id, r.page, used_adjacent, pages_used, chunk_ids, CASE WHEN text IS NOT NULL THEN coalesce(sections, []) END AS sections, text, text IS NOT NULL AS has_content FROM r LEFT JOIN made USING (doc_id, page) LEFT JOIN sec USING (doc_id, page)""")  # fmt: skip
register("p04_page_prompts", lambda s, d: P.page_texts(D_pages(s, d)).select("doc_id", "page_number", P.page_prompt(F.col("page_number"), F.col("text"), "Label it.").alias("prompt")),
         "WITH t AS (SELECT doc_id, page_number, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM cpages GROUP BY 1, 2) SELECT doc_id, page_number, 'Page ' || page_number || ' of a document:' || chr(10) || chr(10) || left(text, 3000) || CASE WHEN length(text) > 3000 THEN '...' ELSE '' END || chr(10) || chr(10) || 'Label it.' AS prompt FROM t")
register("p05_clean_label", lambda s, d: table(s, d, "conversations").select(*by, P.clean_label(F.concat(F.lit('"Label: '), "text")).alias("label")),
         rf"""WITH l AS (SELECT conv_id, turn, regexp_replace(regexp_replace({S.strip("string_split('Label: ' || " + S.strip('text') + ", chr(10))[1]")}, '^[:\-"'']+\s*', ''), '\s*[:\-"'']+$', '') AS a FROM (SELECT conv_id, turn, text FROM conversations)),
         m AS (SELECT conv_id, turn, regexp_replace({S.strip("substr(a, 7)")}, '^[:\-"'']+\s*', '') AS b FROM l)
         SELECT conv_id, turn, CASE WHEN length(b) < 2 THEN 'Unknown' WHEN length(b) > 50 THEN left(b, 47) || '...' ELSE b END AS label FROM m""")  # fmt: skip
register("p06_parse_summary", lambda s, d: replies(s, d).select(*by, P.parse_summary(F.col("response")).alias("p")).select(*by, "p.*"),
         rf"""WITH p AS (SELECT conv_id, turn, {S.strip('text')} AS summary, list_filter(list_transform(string_split(split_part({S.strip('response')}, 'KEY_POINTS:', 2), chr(10)), lambda x: {S.strip('x')}), lambda x: x != '') AS ls FROM replies)
         SELECT conv_id, turn, CASE WHEN summary = '' THEN '{P.NO_SUMMARY}' ELSE summary END AS summary, list_filter(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^[-*]') THEN {S.strip("regexp_replace(x, '^[-* ]+', '')")} ELSE x END), lambda x: x != '')[1:5] AS key_points FROM p""")  # fmt: skip
register("p07_one_sentence", lambda s, d: table(s, d, "conversations").select(*by, P.one_sentence(F.col("text")).alias("sentence")), rf"""
WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split({S.strip('text')}, chr(10)), lambda x: {S.strip('x')}), lambda x: x != '')[1] AS line FROM conversations),
p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {S.strip('x')}), lambda x: x != '') AS parts FROM l),
c AS (SELECT conv_id, turn, coalesce(list_filter(parts, lambda x: len(regexp_extract_all(x, '\S+')) >= 5)[1], parts[1], '') AS chosen FROM p),
m AS (SELECT *, regexp_extract_all(chosen, '\S+') AS many FROM c),
k AS (SELECT conv_id, turn, CASE WHEN len(many) > 35 THEN regexp_replace(array_to_string(many[1:35], ' '), '[ ,;]+$', '') || '...' ELSE chosen END AS cut FROM m)
SELECT conv_id, turn, CASE WHEN cut = '' THEN '{P.NO_SUMMARY}' ELSE cut END AS sentence FROM k""")
register("p08_extractive", lambda s, d: table(s, d, "conversations").select(*by, P.extractive_summary(F.col("text")).alias("p")).select(*by, "p.*"),
         rf"""WITH x AS (SELECT conv_id, turn, string_split(text, '. ') AS parts, regexp_extract_all(string_split(text, '. ')[1], '\S+') AS many FROM conversations),
         c AS (SELECT *, CASE WHEN len(many) > 50 THEN regexp_replace(array_to_string(many[1:50], ' '), '[ ,;]+$', '') || '...' ELSE parts[1] END AS cut FROM x)
         SELECT conv_id, turn, CASE WHEN cut = '' THEN '{P.NO_SUMMARY}' ELSE cut END AS summary, list_transform(list_filter(parts[1:5], lambda x: length({S.strip('x')}) > 20), lambda x: {S.strip('x')} || '.') AS key_points FROM c""")  # fmt: skip


def range_responses(s, d):
    row = lambda a, b: F.struct(F.lit("T").alias("title"), F.lit(a).alias("start_page"), F.lit(b).alias("end_page"), F.concat(F.lit("s"), F.col("doc_id")).alias("summary"))
    return P.range_prompts(page_summaries(s, d)).select("doc_id", F.concat(F.lit("Here: "), F.to_json(F.when(F.col("doc_id") % 2 == 0, F.array(row(1, 2), row(5, 3), row(3, 4))).otherwise(F.array(row(0, 2))))).alias("response"))


register("p09_range_prompts", lambda s, d: P.range_prompts(page_summaries(s, d)), "SELECT doc_id, string_agg('Page ' || page_number || ': ' || summary, chr(10) ORDER BY page_number) AS block FROM psum GROUP BY 1")
register("p09_ranges", lambda s, d: P.ranges_or_pages(P.parse_ranges(range_responses(s, d)), page_summaries(s, d)),
         "SELECT DISTINCT doc_id, 'T' AS title, u.a AS start_page, u.a + 1 AS end_page, 's' || doc_id AS summary FROM psum, unnest([1, 3]) AS u(a) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'Page ' || page_number, page_number, page_number, summary FROM psum WHERE doc_id % 2 = 1")
register("p09_range_chunks", lambda s, d: P.range_chunks(P.parse_ranges(range_responses(s, d)), D_pages(s, d)), "SELECT r.doc_id, a AS start_page, a + 1 AS end_page, list_sort(list(DISTINCT chunk_index)) AS chunk_ids FROM (SELECT DISTINCT doc_id, u.a FROM psum, unnest([1, 3]) AS u(a) WHERE doc_id % 2 = 0) r JOIN cpages c ON c.doc_id = r.doc_id AND page_number BETWEEN a AND a + 1 GROUP BY 1, 2")
register("p09_supported_ranges", lambda s, d: P.supported_ranges(P.ranges_or_pages(P.parse_ranges(range_responses(s, d)).limit(0), page_summaries(s, d)), D_pages(s, d)), rf"""
WITH sn AS (SELECT * FROM (SELECT doc_id, page_number, u.k, {S.strip('u.x')} AS x FROM psum, unnest(regexp_split_to_array(summary, '[.!?]+')) WITH ORDINALITY AS u(x, k)) WHERE length(x) > 10),
st AS (SELECT DISTINCT doc_id, page_number, k, t FROM sn, unnest(string_split(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' ')) AS u(t) WHERE length(t) > 2),
tot AS (SELECT doc_id, page_number, k, count(*) AS total FROM st GROUP BY ALL),
ct AS (SELECT c.doc_id, p.page_number, c.chunk_index, c.t FROM ctoks c JOIN cpages p ON p.doc_id = c.doc_id AND p.chunk_index = c.chunk_index WHERE length(c.t) > 2),
hits AS (SELECT st.doc_id, st.page_number, st.k, ct.chunk_index, count(*) AS n FROM st JOIN ct ON ct.doc_id = st.doc_id AND ct.page_number = st.page_number AND ct.t = st.t GROUP BY ALL),
best AS (SELECT h.* FROM hits h JOIN tot USING (doc_id, page_number, k) WHERE n / total >= 0.1::DOUBLE QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, k ORDER BY n / total DESC, chunk_index) <= 3),
ids AS (SELECT doc_id, page_number, list_sort(list(DISTINCT chunk_index)) AS chunk_ids FROM best GROUP BY ALL)
SELECT doc_id, 'Page ' || page_number AS title, page_number AS start_page, page_number AS end_page, summary, coalesce(chunk_ids, []) AS chunk_ids,
       summary || CASE WHEN chunk_ids IS NULL THEN '' ELSE '^[' || array_to_string(list_transform(chunk_ids, lambda i: 'C' || i), ',') || ']' END AS summary_with_references
FROM psum LEFT JOIN ids USING (doc_id, page_number)""")
register("p10_overviews", lambda s, d: overview_replies(s, d).select(*by, P.parse_overview(F.col("response")).alias("p")).select(*by, "p.*"), rf"""
WITH lists AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(replace(text, chr(10), ' '), ' '), lambda x: {S.strip("regexp_replace(" + S.strip('x') + r", '^([-*]|[0-9]+[.)])\s*', '')")}), lambda x: x != '') AS listed FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE {S.strip('text')} END AS doc_summary, (CASE WHEN turn % 2 = 0 THEN string_split(text, ' ') ELSE listed END)[1:10] AS suggested_queries FROM lists""")
register("p10_overview_prompts", lambda s, d: P.overview_prompts(page_summaries(s, d)), r"SELECT doc_id, 'Page summaries of a document:' || chr(10) || chr(10) || left(string_agg('Page ' || page_number || ': ' || summary, chr(10) ORDER BY page_number), 8000) || chr(10) || chr(10) || 'Write SUMMARY: and QUERIES: (a list).' AS prompt FROM psum GROUP BY 1")
register("p11_context_prompts", lambda s, d: P.context_prompts(used(s, d).join(query_rows(s, d).select("query_id", "doc_id"), "query_id").withColumn("score", F.lit(0.5)), vectors(s, d).select("doc_id", "chunk_index", F.lit("S").alias("section_path"), F.lit("H").alias("heading"), F.col("chunk_index").cast("string").alias("content"))),
         "SELECT query_id, string_agg('[C' || id || '] S / H (0.500)' || chr(10) || id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context FROM used WHERE place <= 12 GROUP BY 1")
register("p12_parse_class", lambda s, d: class_replies(s, d).select(*by, P.parse_class(F.col("response")).alias("p")).select(*by, "p.*"), rf"""
WITH r AS (SELECT conv_id, turn, text || chr(10) || 'Class: ' || CASE turn % 3 WHEN 0 THEN 'page_summary' WHEN 1 THEN 'use_history' ELSE upper(left(text, 12)) END || chr(10) || 'page_number: ' || left(text, 3) || ' ' || CASE WHEN conv_id % 3 = 0 THEN '' ELSE turn::VARCHAR END AS response FROM conversations),
l AS (SELECT conv_id, turn, upper(list_filter(string_split({S.strip('response')}, chr(10)), lambda x: contains(upper(x), 'CLASS:'))[1]) AS c, list_filter(string_split({S.strip('response')}, chr(10)), lambda x: contains(upper(x), 'PAGE_NUMBER:'))[1] AS p FROM r),
n AS (SELECT *, CASE WHEN contains(c, 'PAGE_SUMMARY') THEN 'PAGE_SUMMARY' WHEN contains(c, 'USE_HISTORY') THEN 'USE_HISTORY' ELSE 'FULL_RETRIEVAL' END AS said, try_cast(nullif(regexp_extract(regexp_replace(coalesce(p, ''), '^[^:]*:', ''), '(\d+)', 1), '') AS INT) AS number FROM l)
SELECT conv_id, turn, CASE WHEN said = 'PAGE_SUMMARY' AND number IS NULL THEN 'FULL_RETRIEVAL' ELSE said END AS class, CASE WHEN said = 'PAGE_SUMMARY' THEN number END AS page_number FROM n""")


def parsed_more_sql() -> str:
    """What ``parse_more`` reads, step by step as a chain of tables."""
    bare = lambda x: S.strip(rf"""regexp_replace(regexp_replace({x}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')""")
    steps = [f"CASE WHEN starts_with(lower(q), '{p}') THEN {bare(S.strip(f'substr(q, {len(p) + 1})'))} ELSE q END" for p in P.QUERY_PREFIXES]
    steps.append(f"CASE WHEN contains(lower(q), ' or ') THEN {bare(S.strip(chr(39).join(['string_split(q, ', ' or ', ')[1]'])))} ELSE q END")
    steps += [f"CASE WHEN instr(q, '{m}') - 1 < length(q) - 10 AND instr(q, '{m}') - 1 > 10 THEN {S.strip(f'left(q, instr(q, {chr(39)}{m}{chr(39)}) - 1)')} ELSE q END" for m in P.EXPLANATION_MARKS]
    steps.append(rf"array_to_string(regexp_extract_all({bare('q')}, '\S+'), ' ')")
    first = f"SELECT conv_id, turn, turn % 2 = 0 AS needs, {bare(S.strip('chr(34) || string_split(text, chr(10))[1] || chr(34)'))} AS q FROM conversations"
    chain = [f"s0 AS ({first})"] + [f"s{k} AS (SELECT conv_id, turn, needs, {x} AS q FROM s{k - 1})" for k, x in enumerate(steps, 1)]
    none = ", ".join(f"'{x}'" for x in P.NO_QUERY)
    last = f"v AS (SELECT *, lower(q) NOT IN ({none}) AND length(q) > 10 AND length(q) < 200 AS valid FROM s{len(steps)})"
    return "WITH " + ", ".join([*chain, last]) + " SELECT conv_id, turn, needs AND valid AS needs_more, CASE WHEN needs AND valid THEN q END AS new_query FROM v"


register("p13_parse_more", lambda s, d: table(s, d, "conversations").select(*by, P.parse_more(F.concat(F.lit("NEEDS_MORE: "), F.when(F.col("turn") % 2 == 0, "YES").otherwise("no"), F.lit("\nRELATED_QUERY: \""), F.get(F.split("text", "\n", -1), F.lit(0)), F.lit("\""))).alias("p")).select(*by, "p.*"), parsed_more_sql())
register("p14_clean_answer", lambda s, d: table(s, d, "conversations").select(*by, P.clean_answer(F.concat("text", F.lit(" (Chunk 3) see  Chunk 4 , , ok . . end\n\n\n\nx "))).alias("answer")),
         r"SELECT conv_id, turn, {} AS answer FROM conversations".format(S.strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' (Chunk 3) see  Chunk 4 , , ok . . end' || chr(10) || chr(10) || chr(10) || chr(10) || 'x ', '\([Cc]hunk\s+\d+\)', '', 'g'), '\[[Cc]hunk\s+\d+\]', '', 'g'), '[Cc]hunk\s+\d+', '', 'g'), '[ \t]+', ' ', 'g'), '\s*,\s*,', ',', 'g'), '\s*\.\s*\.', '.', 'g'), ' +([,.!?;:])', '\1', 'g'), ' +(\n)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")))
register("p15_follow_ups", lambda s, d: P.follow_up_questions(table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), bulleted(F.col("text")).alias("response"))), rf"""
WITH l AS (SELECT conv_id * 1000 + turn AS query_id, u.k, {S.strip('u.x')} AS x FROM conversations, unnest(string_split(regexp_replace(text, '([.,]) ', '\1' || chr(10) || '2) ', 'g'), chr(10))) WITH ORDINALITY AS u(x, k)),
b AS (SELECT query_id, k, {S.strip(r"CASE WHEN regexp_matches(x, '^[-*]') THEN substr(x, 2) ELSE regexp_replace(x, '^[0-9]+[.)]\s*', '') END")} AS question FROM l),
f AS (SELECT * FROM b WHERE question != '' QUALIFY row_number() OVER (PARTITION BY query_id, lower(question) ORDER BY k) = 1)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY k))::INT AS place, question FROM f QUALIFY place <= 7""")
register("p16_extraction_context", lambda s, d: P.extraction_context(chunks(s, d)), "SELECT * FROM excerpts")
register("p16_extraction_prompts", lambda s, d: P.extraction_prompts(P.extraction_context(chunks(s, d))), f"""
SELECT doc_id, u.kind, 'Parts of a document:' || chr(10) || chr(10) || context || chr(10) || chr(10) || u.task || chr(10) || 'Answer with a JSON array of strings alone.' AS prompt FROM excerpts, (VALUES {", ".join(f"('{k}', '{t}')" for k, t in P.EXTRACTION_TASKS.items())}) AS u(kind, task)""")  # fmt: skip
register("p16_extracted", lambda s, d: P.extracted(extraction_replies(s, d)), rf"""
SELECT conv_id * 1000 + turn AS doc_id, ['key_facts', 'entities', 'dates', 'obligations'][1 + turn % 4] AS kind,
       CASE turn % 4 WHEN 0 THEN list_filter([text, 'b'], lambda x: x != '') WHEN 1 THEN list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}), lambda x: x != '')[1:50] ELSE [] END AS items FROM conversations""")  # fmt: skip
register("p16_parse_list", lambda s, d: table(s, d, "conversations").select(*by, P.parse_list(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("here: "), F.to_json(F.split("text", " ")), F.lit(" end"))).otherwise(F.col("text"))).alias("items")), rf"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN list_filter(string_split(text, ' '), lambda x: x != '')
    WHEN regexp_matches(text, '(?s)\[.*\]') THEN [] ELSE list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}), lambda x: x != '')[1:50] END AS items FROM conversations""")
register("p17_history", lambda s, d: P.history_text(messages(s, d)), "SELECT session_id, string_agg(role || ': ' || left(content, 600) || CASE WHEN length(content) > 600 THEN '...' ELSE '' END, chr(10) || chr(10) ORDER BY id) AS history FROM (SELECT * FROM msgs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 5) GROUP BY 1")
register("p17_full_history", lambda s, d: P.full_history_text(messages(s, d).withColumn("chunks", F.array(F.struct(F.col("id").cast("int").alias("chunk_index"), F.col("role").alias("content"))))),
         rf"SELECT session_id, 'Previous conversation:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' || {S.strip('content')} ELSE 'Assistant: ' || {S.strip('content')} || chr(10) || '  [Chunk ' || id || ']: ' || role END, chr(10) ORDER BY id) AS history FROM msgs GROUP BY 1")

register("u01_billed_tokens", lambda s, d: table(s, d, "documents").select("doc_id", T.billed_tokens(F.col("text")).alias("tokens")), rf"SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(1, length({S.strip('text')}) // 4) END::BIGINT AS tokens FROM documents")
# the cost is rounded once, scaled first as DuckDB rounds: what lies next to a half goes the same way
COST = "CASE WHEN event_id % 4 != 0 THEN input_tokens * (0.15::DOUBLE / 1000000) + output_tokens * (0.6::DOUBLE / 1000000) + CASE WHEN event_id % 3 = 0 THEN embedding_tokens * (0.13::DOUBLE / 1000000) ELSE 0 END END"
register("u02_price", lambda s, d: U.price(usage_events(s, d), U.price_table(s)).select("event_id", (F.round(U.total_usd(F.col("components")) * 1e5) / 1e5).alias("cost"), F.size("components").alias("n")), f"SELECT event_id, round({COST}, 5) AS cost, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 3 ELSE 2 END::INT AS n FROM ue")
register("u03_enrich", lambda s, d: U.enrich(usage_events(s, d), U.price_table(s)).select("event_id", "total_tokens", "model"), "SELECT event_id, input_tokens + output_tokens + embedding_tokens AS total_tokens, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END AS model FROM ue")
register("u04_query_totals", lambda s, d: U.query_totals(usage_events(s, d).withColumn("query_id", F.col("document_id"))), "SELECT document_id AS query_id, step, input_tokens, output_tokens, embedding_tokens, NULL::BIGINT AS sub_steps FROM ue UNION ALL SELECT document_id, 'query_total', sum(input_tokens)::BIGINT, sum(output_tokens)::BIGINT, sum(embedding_tokens)::BIGINT, count(*) FROM ue GROUP BY 1")
register("u05_daily_summary", lambda s, d: U.daily_summary(usage_events(s, d)), """SELECT ts::DATE AS date, CASE WHEN grouping(phase) = 1 AND grouping(step) = 1 THEN 'day' WHEN grouping(step) = 1 THEN 'phase' ELSE 'step' END AS level, phase, step, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
    sum(embedding_tokens)::BIGINT AS embedding_tokens, sum(input_tokens + output_tokens + embedding_tokens)::BIGINT AS total_tokens, count(*) AS events FROM ue GROUP BY GROUPING SETS ((ts::DATE), (ts::DATE, phase), (ts::DATE, step))""")  # fmt: skip
register("u06_timeline", lambda s, d: U.pipeline_timeline(usage_events(s, d)).select("document_id", "event_id", "step", "place"), "SELECT document_id, event_id, step, (row_number() OVER (PARTITION BY document_id ORDER BY ts, event_id))::INT AS place FROM ue WHERE step IN ('pdf_upload', 'pdf_processing', 'vectorization')")
register("u07_pipeline_totals", lambda s, d: U.pipeline_totals(usage_events(s, d)).withColumn("cost_estimate_usd", F.round("cost_estimate_usd", 5)).drop("pipeline_start", "pipeline_end"), "SELECT document_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(embedding_tokens)::BIGINT AS embedding_tokens, round(coalesce(sum(cost_estimate_usd), 0), 5) AS cost_estimate_usd, greatest(0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE) AS pipeline_seconds FROM ue WHERE step IN ('pdf_upload', 'pdf_processing', 'vectorization') GROUP BY 1")
register("u08_latest", lambda s, d: U.latest_by_document(usage_events(s, d)).drop("ts"), "SELECT document_id, event_id, input_tokens, output_tokens, embedding_tokens FROM ue WHERE step = 'vectorization' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1")
register("u09_flat", lambda s, d: U.flat_vectorization(usage_events(s, d)).select("document_id", "embedding_tokens", "total_pages", "total_words", "duration_seconds"), "SELECT document_id, embedding_tokens, (event_id % 9)::INT AS total_pages, input_tokens::INT AS total_words, value / 2 AS duration_seconds FROM ue WHERE step = 'vectorization'")
register("u10_listing", lambda s, d: U.listing_with_total(usage_events(s, d).select(F.col("event_id").alias("id"), "document_id", F.col("input_tokens").alias("total_tokens"), (F.col("output_tokens") / 4).alias("cost_estimate_usd")), F.col("document_id") % 2 == 0).withColumnRenamed("cost_estimate_usd", "cost"),
         "SELECT event_id AS id, document_id, input_tokens AS total_tokens, output_tokens / 4 AS cost FROM ue WHERE document_id % 2 = 0 UNION ALL SELECT NULL, NULL, sum(input_tokens)::BIGINT, sum(output_tokens) / 4 FROM ue WHERE document_id % 2 = 0")
register("u11_query_sums", lambda s, d: U.query_totals(usage_events(s, d).withColumn("query_id", F.col("document_id"))).where("step = 'query_total'").drop("step"), "SELECT document_id AS query_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(embedding_tokens)::BIGINT AS embedding_tokens, count(*) AS sub_steps FROM ue GROUP BY 1")
register("u12_page_summary_tokens", lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(T.page_summary_tokens(F.count("*")).alias("tokens")), "SELECT conv_id, ((500 * count(*) + 500) // 4)::BIGINT AS tokens FROM conversations GROUP BY 1")
register("u13_run_facts", lambda s, d: U.run_facts(table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.floor(F.col("n_chars") / 3000).alias("total_pages")), table(s, d, "documents").select(F.col("doc_id").alias("document_id"), T.model_tokens(F.col("text")).alias("total_tokens"))),
         r"SELECT doc_id AS document_id, len(regexp_extract_all(text, '\S+'))::INT AS total_words, n_chars // 3000 AS total_pages, floor(length(text) / 1.5)::BIGINT AS total_tokens FROM documents")
register("u14_run_header", lambda s, d: U.run_header(usage_events(s, d)).select("document_id", "total_pages", "filename", "file_mb"), "SELECT document_id, arg_min(event_id % 9, ts) FILTER (WHERE step = 'vectorization')::INT AS total_pages, arg_min(event_type, ts) FILTER (WHERE step = 'pdf_upload') AS filename, arg_min(round(input_tokens * 4096 / 1048576, 2), ts) FILTER (WHERE step = 'pdf_upload') AS file_mb FROM ue GROUP BY 1")


def part_of(s, d, m):
    return table(s, d, "documents").where(F.col("doc_id") % m == 0).select(F.col("doc_id").alias("document_id"))


register("k01_status", lambda s, d: K.document_status(part_of(s, d, 1), part_of(s, d, 2), part_of(s, d, 4), part_of(s, d, 4), part_of(s, d, 8)), "SELECT doc_id AS document_id, CASE WHEN doc_id % 8 = 0 THEN 'ready' WHEN doc_id % 4 = 0 THEN 'vectorized' WHEN doc_id % 2 = 0 THEN 'processing' ELSE 'uploaded' END AS status FROM documents")
register("k02_display_name", lambda s, d: table(s, d, "documents").select("doc_id", K.display_name(F.when(F.col("doc_id") % 3 == 0, F.lit("  ")), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("lang")).alias("name")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS name FROM documents")
register("k03_documents_of_users", lambda s, d: K.documents_of_users(records(s, d), table(s, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("document_id"))).drop("created_at"),
         "SELECT o_custkey AS user_id, o_orderkey AS document_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey))::INT AS place FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
register("k04_owned_by", lambda s, d: K.owned_by(sessions(s, d).select("id", "user_id", F.col("id").alias("document_id")), records(s, d).where("document_id % 2 = 0")), "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey AS document_id FROM orders WHERE o_orderkey % 2 = 0")
register("k05_active_sessions", lambda s, d: K.active_sessions(sessions(s, d)).select("id", "place"), "SELECT id, (row_number() OVER (PARTITION BY user_id, document_id ORDER BY updated_at DESC, id))::INT AS place FROM sess WHERE NOT is_archived")
register("k06_session_messages", lambda s, d: K.session_messages(messages(s, d).withColumn("created_at", F.col("id"))).select("session_id", "id", "place"), "SELECT session_id, id, (row_number() OVER (PARTITION BY session_id ORDER BY id))::INT AS place FROM msgs QUALIFY place <= 500")
register("k07_messages_before", lambda s, d: K.messages_before(messages(s, d).groupBy("session_id").agg(F.max("id").alias("before_id")), messages(s, d)).select("session_id", "before_id", "id", "place"),
         "SELECT session_id, before_id, id, (row_number() OVER (PARTITION BY session_id ORDER BY id))::INT AS place FROM (SELECT m.session_id, before_id, id FROM msgs m JOIN (SELECT session_id, max(id) AS before_id FROM msgs GROUP BY 1) r ON r.session_id = m.session_id AND id < before_id QUALIFY row_number() OVER (PARTITION BY m.session_id ORDER BY id DESC) <= 7)")


def messages_with_chunks(s, d):
    c = lambda i: F.struct(i.cast("int").alias("chunk_index"), F.col("content").alias("content"))
    m = messages(s, d).withColumn("chunks", F.array(*[c(F.col("id") + k) for k in range(4)]))
    return m.withColumn("content", F.concat(F.lit("see [C"), F.col("id") + 2, F.lit("] [c99] [C"), F.col("id"), F.lit("] [C"), F.col("id") + 1, F.lit("]"))).withColumn("id", F.col("session_id") * 100 + F.col("id"))


register("k08_cited_chunks", lambda s, d: K.cited_chunks(messages_with_chunks(s, d)), "SELECT session_id * 100 + id AS id, u.k::INT AS place, (msgs.id + u.x)::INT AS chunk_index, content FROM msgs, unnest([2, 0]) WITH ORDINALITY AS u(x, k) WHERE role = 'assistant'")
register("k09_archive", lambda s, d: K.archive(sessions(s, d), sessions(s, d).where("id % 7 = 0").select("id")).select("id", "is_archived"), "SELECT id, is_archived OR id % 7 = 0 AS is_archived FROM sess")
register("k10_validate", lambda s, d: K.validate_requests(sessions(s, d).select(F.col("id").alias("request_id"), (F.col("id") + F.when(F.col("id") % 11 == 0, 1_000_000_000).otherwise(0)).alias("session_id"), (F.col("user_id") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("user_id"), (F.col("document_id") + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("document_id")), sessions(s, d)),
         "WITH r AS (SELECT id AS request_id, CASE WHEN id % 11 = 0 THEN 'no such session' WHEN id % 5 = 0 THEN 'not the user''s' WHEN is_archived THEN 'archived' WHEN id % 3 = 0 THEN 'another document' END AS reason FROM sess) SELECT request_id, reason IS NULL AS ok, reason FROM r")
register("k11_suggested", lambda s, d: K.suggested_questions(part_of(s, d, 1), table(s, d, "labels").select(F.col("doc_id").alias("document_id"), F.array(F.lit("q")).alias("suggested_queries"))), "SELECT doc_id AS document_id, CASE WHEN l.doc_id IS NULL THEN [] ELSE ['q'] END AS suggested_queries FROM documents LEFT JOIN labels l USING (doc_id)")
register("s07_page_ranges", lambda s, d: K.page_ranges(page_summaries(s, d).select(F.col("doc_id").alias("document_id"), F.when(F.col("page_number") == 3, "x").otherwise(F.col("page_number").cast("string")).alias("start_page"), F.lit("4").alias("end_page"), "summary")),
         "SELECT doc_id AS document_id, page_number AS start_page, 4 AS end_page, summary, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, summary))::INT AS place FROM psum WHERE page_number <= 4 AND page_number != 3 AND trim(summary) != ''")
register("s08_brief_summary", lambda s, d: K.brief_summary(part_of(s, d, 1), table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("source")).alias("brief")), table(s, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("overview"))),
         "SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 != 0 THEN source WHEN doc_id % 3 = 0 THEN lang END AS summary FROM documents")
register("s10_relational", lambda s, d: readers.relational(s, d, "customer.parquet"), "SELECT * FROM customer")
register("s10_owners", lambda s, d: readers.relational(s, d, "customer.parquet").join(readers.relational(s, d, "orders.parquet"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n_documents")), "SELECT c_custkey, count(*) AS n_documents FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
register("s17_delete", lambda s, d: K.delete_messages(messages(s, d), sessions(s, d), part_of(s, d, 1).where("document_id < 100")).select("session_id", "id"), "SELECT session_id, id FROM msgs WHERE session_id NOT IN (SELECT id FROM sess WHERE document_id IN (SELECT doc_id FROM documents WHERE doc_id < 100))")
register("s17_delete_documents", lambda s, d: K.delete_documents(records(s, d), table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("document_id"))).drop("created_at"), "SELECT o_custkey AS user_id, o_orderkey AS document_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
register("s18_register", lambda s, d: K.register_documents(records(s, d).where("document_id % 2 = 0"), table(s, d, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("document_id"), F.col("l_shipdate").alias("created_at"))).select("user_id", "document_id"),
         "SELECT o_custkey AS user_id, o_orderkey AS document_id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_suppkey) AS k FROM lineitem) WHERE k = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")


def stream(s, d, write):
    """Run a stream over the events table to its end and give what it has stored, in the checkpoint folder."""
    raw = table(s, d, "events")
    source = s.readStream.schema(raw.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    v = F.floor(F.col("value")).cast("long")
    events = source.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("step"), F.col("event_type").alias("phase"), F.col("user_id").alias("document_id"), v.alias("input_tokens"), v.alias("output_tokens"), v.alias("embedding_tokens"))
    path = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    write(events, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return s.read.parquet(f"{path}/out")


register("z01_daily_rollup", lambda s, d: stream(s, d, lambda e, *to: Z.write_rollup(Z.daily_rollup(e), *to)), "SELECT ts::DATE AS day, event_type AS phase, event_type AS step, sum(floor(value))::BIGINT AS input_tokens, sum(floor(value))::BIGINT AS output_tokens, sum(floor(value))::BIGINT AS embedding_tokens, count(*) AS events FROM events GROUP BY 1, 2, 3")
register("z03_latest_events", lambda s, d: stream(s, d, Z.write_latest).select("document_id", "event_id", "input_tokens", "output_tokens", "embedding_tokens"), "SELECT user_id AS document_id, event_id, floor(value)::BIGINT AS input_tokens, floor(value)::BIGINT AS output_tokens, floor(value)::BIGINT AS embedding_tokens FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
