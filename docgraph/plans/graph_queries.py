"""Queries over duplicates, grounding, the structure graph, vectors and retrieval, each with its DuckDB SQL."""

from __future__ import annotations

import re
import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import chunking as C
from docgraph.operators import dedup as D
from docgraph.operators import graph as G
from docgraph.operators import grounding as N
from docgraph.operators import layout as L
from docgraph.operators import retrieval as R
from docgraph.operators import vectors as V
from docgraph.plans import flows
from docgraph.plans import sql as S
from docgraph.plans.adapters import markdown, table
from docgraph.plans.layout_queries import chunks
from docgraph.sources.shared import stored

QUERIES, SQL = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = S.query(sql)


def vectors(s, d):
    """embeddings as chunk vectors: the label is the document, the place by id the chunk."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(s, d, "embeddings").select(F.col("label").alias("doc_id"), (F.row_number().over(order) - 1).alias("chunk_index"), F.col("embedding").alias("vec"))


def vector_chunks(s, d):
    i = F.col("chunk_index")
    return vectors(s, d).select(
        "doc_id", "chunk_index", F.concat(F.lit("S"), F.floor(i / 10), F.lit(" > T"), F.floor(i / 5)).alias("section_path"), F.concat(F.lit("H"), i).alias("heading"),
        (F.floor(i / 8) + 1).cast("int").alias("page_number"), F.filter(F.array(i - 2, i - 1), lambda x: x >= 0).alias("prev_chunk_ids"),
    )


def vector_edges(s, d):
    c = vector_chunks(s, d)
    follows = G.follow_edges(c)
    return stored(G.containment_edges(c).unionByName(G.page_edges(c)).unionByName(follows).unionByName(G.similar_edges(vectors(s, d), follows)), "edges")


def chain_edges(s, d):
    """Only what follows what: a walk takes one or two chunks a step."""
    return G.follow_edges(vector_chunks(s, d))


def vector_graph(s, d):
    c = vector_chunks(s, d)
    nodes = G.chunk_nodes(c).select("doc_id", "id", "type").unionByName(G.page_nodes(c).select("doc_id", "id", "type"))
    return nodes, vector_edges(s, d)


def vector_ids(s, d):
    return vectors(s, d).withColumnRenamed("chunk_index", "id")


def query_rows(s, d, salt=0):
    return table(s, d, "embeddings").where(F.col("vec_id") % 20 == salt).select(F.col("vec_id").alias("query_id"), F.col("label").alias("doc_id"), F.col("embedding").alias("vec"))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def summaries(s, d):
    """benchmark texts as summaries, each of the document of its number."""
    return table(s, d, "benchmark").select(F.col("item_id").alias("text_id"), F.col("item_id").alias("doc_id"), "text")


def doc_graph(s, d):
    """The texts are written once, and so are their chunks, headers and sections, as the graph reads each of them several times."""
    md = stored(markdown(s, d), "markdown")
    c = C.paged_chunks(md)
    sections = stored(G.section_nodes(stored(L.headers(md), "headers")), "sections")
    nodes = G.all_nodes(sections, G.chunk_nodes(c), G.page_nodes(c))
    edges = G.section_edges(sections).unionByName(G.containment_edges(c)).unionByName(G.page_edges(c)).unionByName(G.follow_edges(c))
    return nodes, edges


def D_pages(s, d):
    return C.paged_chunks(markdown(s, d))


S.CTES |= {
    "norm_pages": rf"SELECT doc_id, nonblank_page_no, page_number, trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS norm FROM pages_nb",
    "letters": "SELECT doc_id, nonblank_page_no, norm, list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda c: (length(norm) - length(replace(norm, c, '')))::DOUBLE) AS v FROM norm_pages",
    "near_pages": """
SELECT a.doc_id, a.nonblank_page_no AS first, b.nonblank_page_no AS second, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score
FROM letters a JOIN letters b ON a.doc_id = b.doc_id AND a.nonblank_page_no < b.nonblank_page_no AND length(a.norm) / greatest(length(b.norm), 1) BETWEEN 0.8::DOUBLE AND 1.25::DOUBLE
WHERE list_sum(a.v) > 0 AND list_sum(b.v) > 0 AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9""",
    "vc": "SELECT label AS doc_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS chunk_index, embedding AS vec FROM embeddings",
    "vchunks": "SELECT doc_id, chunk_index, 'S' || (chunk_index // 10) || ' > T' || (chunk_index // 5) AS section_path, 'H' || chunk_index AS heading, (chunk_index // 8 + 1)::INT AS page_number FROM vc",
    "dist": "SELECT a.doc_id, a.chunk_index AS i, b.chunk_index AS j, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM vc a JOIN vc b ON a.doc_id = b.doc_id",
    "vfollow": "SELECT a.doc_id, a.chunk_index AS s, b.chunk_index AS t FROM vc a JOIN vc b ON a.doc_id = b.doc_id AND b.chunk_index - a.chunk_index BETWEEN 1 AND 2",
    "near8": "SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY d, j) <= 8",
    "near5": "SELECT * FROM near8 WHERE i != j QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY d, j) <= 5",
    "vscored": "SELECT *, 1 - (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w + 1e-9) AS similarity FROM near5 WINDOW w AS (PARTITION BY doc_id, i)",
    "vsim": "SELECT doc_id, i, j, similarity FROM vscored WHERE similarity > 0.5 AND abs(i - j) > 2 QUALIFY row_number() OVER (PARTITION BY doc_id, least(i, j), greatest(i, j) ORDER BY i) = 1",
    "vsim2": "SELECT doc_id, i AS chunk_id, j AS neighbour, similarity FROM vsim UNION ALL SELECT doc_id, j, i, similarity FROM vsim",
    "vadj": """SELECT doc_id, chunk_id, neighbour, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY side, neighbour)::INT AS place FROM (
        SELECT doc_id, t AS chunk_id, s AS neighbour, 0 AS side FROM vfollow UNION ALL SELECT doc_id, s, t, 1 FROM vfollow) QUALIFY place <= 2""",
    "vsteps": "SELECT doc_id, chunk_id, neighbour FROM vadj UNION SELECT doc_id, chunk_id, neighbour FROM vsim2 UNION SELECT a.doc_id, a.chunk_index, b.chunk_index FROM vc a JOIN vc b ON a.doc_id = b.doc_id AND a.chunk_index // 5 = b.chunk_index // 5 AND a.chunk_index != b.chunk_index",
    "q": "SELECT vec_id AS query_id, label AS doc_id, embedding AS vec FROM embeddings WHERE vec_id % 20 = 0",
    "q2": "SELECT vec_id - 1 AS query_id, label AS doc_id, embedding AS vec FROM embeddings WHERE vec_id % 20 = 1",
    "qd": "SELECT query_id, q.doc_id, chunk_index AS id, list_sum(list_transform(list_zip(q.vec, vc.vec), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance FROM q JOIN vc ON vc.doc_id = q.doc_id",
    "qrank": "SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INT AS rank FROM qd",
    "q2d": "SELECT query_id, q2.doc_id, chunk_index AS id, list_sum(list_transform(list_zip(q2.vec, vc.vec), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance FROM q2 JOIN vc ON vc.doc_id = q2.doc_id",
    "q2rank": "SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INT AS rank FROM q2d",
    "seeds": "SELECT *, 1 / (1 + distance / 150.0::DOUBLE) AS score FROM qrank WHERE rank <= 5",
    "seeds2": "SELECT *, 1 / (1 + distance / 150.0::DOUBLE) AS score FROM q2rank WHERE rank <= 5",
    "grow_all": """
        SELECT query_id, rank AS seed_rank, s.doc_id, s.id AS seed, neighbour AS id, 0 AS priority FROM seeds s JOIN vsim2 v ON v.doc_id = s.doc_id AND v.chunk_id = s.id WHERE rank <= 2
        UNION ALL SELECT query_id, rank, s.doc_id, s.id, chunk_index, 1 FROM seeds s JOIN vc ON vc.doc_id = s.doc_id AND vc.chunk_index // 5 = s.id // 5 WHERE rank <= 2
        UNION ALL SELECT query_id, rank, s.doc_id, s.id, chunk_index, 2 FROM seeds s JOIN vc ON vc.doc_id = s.doc_id AND vc.chunk_index // 8 = s.id // 8 WHERE rank <= 2""",
    "grown": "SELECT query_id, seed_rank, doc_id, seed, id, min(priority)::INT AS priority FROM grow_all WHERE id != seed GROUP BY query_id, seed_rank, doc_id, seed, id QUALIFY row_number() OVER (PARTITION BY query_id, seed_rank ORDER BY min(priority), id) <= 10",
    "seed_near": "SELECT query_id, seed_rank, seed, d.j AS id, d.d AS distance, row_number() OVER (PARTITION BY query_id, seed_rank ORDER BY d.d, d.j) AS place FROM (SELECT DISTINCT query_id, rank AS seed_rank, doc_id, id AS seed FROM seeds WHERE rank <= 2) g JOIN dist d ON d.doc_id = g.doc_id AND d.i = g.seed",
    "reranked": """SELECT query_id, seed_rank, id, 1 / (1 + distance / 150.0::DOUBLE) AS score, (row_number() OVER (PARTITION BY query_id, seed_rank ORDER BY distance, id))::INT AS rank
        FROM seed_near n WHERE place <= 64 AND EXISTS (SELECT 1 FROM grown g WHERE g.query_id = n.query_id AND g.seed_rank = n.seed_rank AND g.id = n.id) QUALIFY rank <= 5""",
    "used": """SELECT query_id, id, min(stage)::INT AS stage, (row_number() OVER (PARTITION BY query_id ORDER BY min(stage * 1000 + rank), id))::INT AS place
        FROM (SELECT query_id, id, 0 AS stage, rank FROM seeds UNION ALL SELECT query_id, id, seed_rank, rank FROM reranked) GROUP BY query_id, id QUALIFY place <= 15""",
    "used2": """SELECT query_id, id, min(stage)::INT AS stage, (row_number() OVER (PARTITION BY query_id ORDER BY min(stage * 1000 + rank), id))::INT AS place
        FROM (SELECT query_id, id, 0 AS stage, rank FROM seeds2 UNION ALL SELECT query_id, id, seed_rank, rank FROM reranked) GROUP BY query_id, id QUALIFY place <= 15""",
    "provenance": """SELECT u.query_id, u.id, u.place, CASE WHEN s.score IS NOT NULL THEN 'seed' WHEN r.score IS NOT NULL THEN 'graph_expanded' ELSE 'initial' END AS source, s.score AS similarity_score, r.score AS rerank_score
        FROM used u LEFT JOIN seeds s ON s.query_id = u.query_id AND s.id = u.id LEFT JOIN (SELECT query_id, id, max(score) AS score FROM reranked GROUP BY 1, 2) r ON r.query_id = u.query_id AND r.id = u.id""",
    "cpages": "SELECT chunks.*, paged.page_number FROM chunks JOIN paged ON paged.doc_id = chunks.doc_id AND paged.line_no = start_line",
    "snodes": """SELECT doc_id, 'section:' || section_path AS id, 'section' AS type, section_path, arg_max(title, line) AS section_title, arg_max(level, line) AS level, max(line) AS start_line FROM headers GROUP BY doc_id, section_path""",
    "sedges": """SELECT a.doc_id, b.id AS source, a.id AS target, 'contains_section' AS relation, NULL::DOUBLE AS similarity FROM snodes a JOIN snodes b ON a.doc_id = b.doc_id
        AND contains(a.section_path, ' > ') AND b.section_path = array_to_string(string_split(a.section_path, ' > ')[:-2], ' > ')""",
    "dedges": """SELECT * FROM sedges
        UNION ALL SELECT doc_id, 'section:' || section_path, 'chunk:' || chunk_index, 'contains', NULL FROM cpages UNION ALL SELECT doc_id, 'chunk:' || chunk_index, 'section:' || section_path, 'belongs_to', NULL FROM cpages
        UNION ALL SELECT doc_id, 'page:' || page_number, 'chunk:' || chunk_index, 'on_page', NULL FROM cpages UNION ALL SELECT doc_id, 'chunk:' || p, 'chunk:' || chunk_index, 'follows', NULL FROM cpages, unnest(prev_chunk_ids) AS u(p)""",
    "ids_of": "SELECT doc_id, id, type FROM snodes UNION ALL SELECT doc_id, 'chunk:' || chunk_index, 'chunk' FROM chunks UNION ALL SELECT DISTINCT doc_id, 'page:' || page_number, 'page' FROM cpages",
    "sents": rf"SELECT item_id AS text_id, item_id AS doc_id, (row_number() OVER (PARTITION BY item_id ORDER BY k) - 1)::INT AS sentence_no, x FROM (SELECT item_id, u.k, {S.strip('u.x')} AS x FROM benchmark, unnest(regexp_split_to_array(text, '[.!?]+')) WITH ORDINALITY AS u(x, k)) WHERE length(x) > 10",
    "stoks": "SELECT DISTINCT text_id, doc_id, sentence_no, t FROM sents, unnest(string_split(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' ')) AS u(t) WHERE length(t) > 2",
    "ctoks": "SELECT DISTINCT doc_id, chunk_index, t FROM chunks, unnest(string_split(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g'), ' ')) AS u(t) WHERE length(t) > 0",
    "support": """SELECT text_id, doc_id, sentence_no, chunk_index, n / total AS score, (row_number() OVER (PARTITION BY text_id, sentence_no ORDER BY n / total DESC, chunk_index))::INT AS rank
        FROM (SELECT text_id, doc_id, sentence_no, chunk_index, count(*) AS n FROM stoks JOIN ctoks USING (doc_id, t) WHERE length(t) > 2 GROUP BY ALL) JOIN (SELECT text_id, sentence_no, count(*) AS total FROM stoks GROUP BY ALL) USING (text_id, sentence_no)
        WHERE n / total >= 0.1::DOUBLE QUALIFY rank <= 3""",
    "cited": "SELECT conv_id, turn, text || ' ^[C' || (turn + 5) || ',C' || turn || '] y [c' || turn || '] [C' || (conv_id % 7) || ']' AS text FROM conversations",
}


def cited(s, d):
    """conversations with citation marks made of their numbers."""
    t, n = F.col("turn"), lambda c: c.cast("string")
    return table(s, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" ^[C"), n(t + 5), F.lit(",C"), n(t), F.lit("] y [c"), n(t), F.lit("] [C"), n(F.col("conv_id") % 7), F.lit("]")).alias("text"))


def pages_nb(s, d):
    return L.split_pages(markdown(s, d))


def page_vectors(pages):
    """A page's letter counts as its vector, which SQL can make too."""
    norm = T.normalize_page(F.col("text"))
    return pages.select("doc_id", "nonblank_page_no", F.array(*[(F.length(norm) - F.length(F.replace(norm, F.lit(c), F.lit("")))).cast("double") for c in string.ascii_lowercase]).alias("vec"))


def near_pages(s, d, pages=None):
    """The pages are written once and read for their sizes and their vectors."""
    pages = stored(pages_nb(s, d), "texts") if pages is None else pages
    return rounded(D.near_pairs(pages, page_vectors(pages)), "score")


def duplicate_entries(s, d):
    pages = stored(pages_nb(s, d), "texts")
    report = D.duplicate_report(pages, D.exact_clusters(pages), near_pages(s, d, pages))
    return report.select("doc_id", "total_pages", F.explode_outer("duplicates").alias("e")).select("doc_id", "total_pages", "e.pages", "e.score")


def summary_chunks(s, d):
    """The chunks of the documents that have summaries; other documents aren't cut."""
    return chunks(s, d, summaries(s, d).select("doc_id"))


register("d01_normalize", lambda s, d: pages_nb(s, d).select("doc_id", "nonblank_page_no", T.normalize_page(F.col("text")).alias("norm")), "SELECT doc_id, nonblank_page_no, norm FROM norm_pages")
register("d02_exact_clusters", lambda s, d: D.exact_clusters(pages_nb(s, d)).drop("page_hash"), "SELECT doc_id, list_sort(list(nonblank_page_no)) AS pages, 1.0::DOUBLE AS score FROM norm_pages GROUP BY doc_id, md5(norm) HAVING count(*) > 1")
register("d03_near_pairs", near_pages, "SELECT * FROM near_pages")
register("d04_report", duplicate_entries, """
WITH e AS (SELECT doc_id, list_sort(list(nonblank_page_no)) AS pages, 1.0::DOUBLE AS score FROM norm_pages GROUP BY doc_id, md5(norm) HAVING count(*) > 1 UNION ALL SELECT doc_id, [first, second], score FROM near_pages)
SELECT doc_id, total_pages, pages, score FROM (SELECT doc_id, count(*)::INT AS total_pages FROM norm_pages GROUP BY 1) LEFT JOIN e USING (doc_id)""")
register("d05_reconcile", lambda s, d: D.reconcile(table(s, d, "lineitem").select((F.col("l_orderkey") % 100).alias("doc_id"), F.array(F.col("l_partkey") % 20, F.col("l_suppkey") % 20).alias("pages"), F.when(F.col("l_linenumber") == 1, 1.0).otherwise(F.col("l_linenumber") / 10).alias("score"))),
         """WITH p AS (SELECT l_orderkey % 100 AS doc_id, least(l_partkey % 20, l_suppkey % 20) AS first, greatest(l_partkey % 20, l_suppkey % 20) AS second, CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE ELSE l_linenumber / 10 END AS score FROM lineitem),
         ex AS (SELECT DISTINCT * FROM p WHERE score = 1.0), taken AS (SELECT doc_id, first AS page FROM ex UNION SELECT doc_id, second FROM ex),
         nr AS (SELECT doc_id, first, second, max(score) AS score FROM p WHERE score < 1.0 AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc_id = p.doc_id AND t.page IN (p.first, p.second)) GROUP BY 1, 2, 3),
         u AS (SELECT * FROM ex UNION ALL SELECT * FROM nr)
         SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, second))::INT AS rank FROM u""")  # fmt: skip
register("d06_cluster_members", lambda s, d: D.cluster_members(table(s, d, "documents"), "doc_id").select("doc_id", "representative", "n_pages"),
         r"WITH n AS (SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))) AS h FROM documents) SELECT doc_id, representative, n_pages FROM n JOIN (SELECT h, min(doc_id) AS representative, count(*) AS n_pages FROM n GROUP BY h HAVING count(*) > 1) USING (h)")
register("d06_near_pages_lsh", lambda s, d: rounded(D.near_pages_lsh(V.hashed_words(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), width=32).select("id", "vec")), "score"))

register("t01_tokens", lambda s, d: table(s, d, "benchmark").select("item_id", F.array_sort(T.tokens(F.col("text"), 2)).alias("tokens")), "SELECT item_id, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 2))) AS tokens FROM benchmark")
register("t02_sentences", lambda s, d: summaries(s, d).select("text_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence")), "SELECT text_id, sentence_no, x AS sentence FROM sents")
register("t03_support", lambda s, d: rounded(N.supporting_chunks_by_sentence(summaries(s, d), summary_chunks(s, d), 3, 0.1), "score"), "SELECT text_id, doc_id, sentence_no, chunk_index, round(score, 6) AS score, rank FROM support")
register("t03_supporting_chunks", lambda s, d: N.supporting_chunks(summaries(s, d), summary_chunks(s, d), 3, 0.1), "SELECT item_id AS text_id, item_id AS doc_id, coalesce(list_sort(list(DISTINCT chunk_index) FILTER (WHERE chunk_index IS NOT NULL)), []) AS chunk_ids FROM benchmark LEFT JOIN support ON text_id = item_id GROUP BY item_id")
register("t04_answer_chunks", lambda s, d: N.answer_chunks(summaries(s, d), summary_chunks(s, d), 4), """
WITH atoks AS (SELECT DISTINCT item_id, t FROM benchmark, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS u(t) WHERE length(t) > 0),
r AS (SELECT item_id, chunk_index, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, chunk_index) AS rank FROM atoks JOIN ctoks ON ctoks.doc_id = item_id AND ctoks.t = atoks.t GROUP BY 1, 2 QUALIFY rank <= 4)
SELECT b.item_id AS text_id, b.item_id AS doc_id, coalesce(f.ids, e.ids) AS chunk_ids FROM benchmark b LEFT JOIN (SELECT item_id, list(chunk_index ORDER BY rank) AS ids FROM r GROUP BY 1) f USING (item_id)
LEFT JOIN (SELECT doc_id, list(chunk_index ORDER BY chunk_index) AS ids FROM chunks GROUP BY 1) e ON e.doc_id = b.item_id""".replace("WITH atoks", "WITH atoks"))  # fmt: skip
register("t05_format_references", lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("int")).alias("ids")).select("conv_id", N.format_references(F.col("ids")).alias("refs")),
         "SELECT conv_id, '^[' || array_to_string(list_transform(list_sort(list(DISTINCT turn)), lambda x: 'C' || x), ',') || ']' AS refs FROM conversations GROUP BY 1")
S.CTES["refs"] = r"SELECT conv_id, turn, try_cast(nullif(regexp_extract(x, '^\s*C([0-9]+)\s*$', 1), '') AS INT) AS id FROM (SELECT conv_id, turn, unnest(string_split(g, ',')) AS x FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\^\[([^\]]+)\]', 1)) AS g FROM cited))"
register("t06_extract_references", lambda s, d: cited(s, d).select("conv_id", "turn", N.extract_references(F.col("text")).alias("ids")), "SELECT c.conv_id, c.turn, coalesce(r.ids, []) AS ids FROM cited c LEFT JOIN (SELECT conv_id, turn, list_sort(list(DISTINCT id)) AS ids FROM refs WHERE id IS NOT NULL GROUP BY ALL) r ON r.conv_id = c.conv_id AND r.turn = c.turn")
register("t07_union_references", lambda s, d: N.union_references(cited(s, d), "conv_id"), "SELECT conv_id, list_sort(list(DISTINCT id)) AS chunk_ids FROM refs WHERE id IS NOT NULL GROUP BY 1")
register("t08_cited_in_order", lambda s, d: cited(s, d).select("conv_id", "turn", N.cited_in_order(F.col("text")).alias("ids")), r"""
WITH marks AS (SELECT conv_id, turn, u.x::INT AS id, min(u.k) AS k FROM cited, unnest(regexp_extract_all(text, '(?i)\[C(\d+)\]', 1)) WITH ORDINALITY AS u(x, k) GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(m.ids, []) AS ids FROM cited c LEFT JOIN (SELECT conv_id, turn, list(id ORDER BY k) AS ids FROM marks GROUP BY ALL) m ON m.conv_id = c.conv_id AND m.turn = c.turn""")
register("t09_expand_groups", lambda s, d: cited(s, d).select("conv_id", "turn", N.expand_groups(F.col("text")).alias("text")), "SELECT conv_id, turn, text || ' [C' || (turn + 5) || '] [C' || turn || '] y [c' || turn || '] [C' || (conv_id % 7) || ']' AS text FROM conversations")
register("t10_strip_groups", lambda s, d: cited(s, d).select("conv_id", "turn", N.strip_groups(F.col("text")).alias("text")), r"SELECT conv_id, turn, trim(regexp_replace(text, '\s*\^?\[C\d+(?:\s*,\s*C\d+)*\]', '', 'g')) AS text FROM cited")

register("g01_section_nodes", lambda s, d: G.section_nodes(L.headers(markdown(s, d))), "SELECT * FROM snodes")
register("g02_chunk_nodes", lambda s, d: G.chunk_nodes(chunks(s, d)), "SELECT doc_id, 'chunk:' || chunk_index AS id, 'chunk' AS type, chunk_index AS chunk_id, section_path, heading FROM chunks")
register("g03_page_nodes", lambda s, d: G.page_nodes(D_pages(s, d)), "SELECT DISTINCT doc_id, 'page:' || page_number AS id, 'page' AS type, page_number, NULL::VARCHAR AS classification FROM cpages")
register("g04_section_edges", lambda s, d: G.section_edges(G.section_nodes(L.headers(markdown(s, d)))), "SELECT * FROM sedges")
register("g05_g07_edges", lambda s, d: doc_graph(s, d)[1], "SELECT * FROM dedges")
register("g08_similar_edges", lambda s, d: rounded(G.similar_edges(vectors(s, d), G.follow_edges(vector_chunks(s, d))), "similarity"), "SELECT doc_id, 'chunk:' || i AS source, 'chunk:' || j AS target, 'similar_to' AS relation, round(similarity, 6) AS similarity FROM vsim")
register("g09_parent_sections", lambda s, d: G.parent_sections(vector_edges(s, d)), "SELECT doc_id, chunk_index AS chunk_id, section_path FROM vchunks")
register("g10_section_chunks", lambda s, d: G.section_chunks(vector_edges(s, d)), "SELECT doc_id, section_path, list_sort(list(chunk_index)) AS chunk_ids FROM vchunks GROUP BY 1, 2")
register("g11_adjacent_chunks", lambda s, d: G.adjacent_chunks(vector_edges(s, d)), "SELECT * FROM vadj")
register("g12_page_chunks", lambda s, d: G.page_chunks(vector_edges(s, d)), "SELECT doc_id, page_number, list_sort(list(chunk_index)) AS chunk_ids FROM vchunks GROUP BY 1, 2")
register("g13_chunk_pages", lambda s, d: G.chunk_pages(vector_edges(s, d)), "SELECT doc_id, chunk_index AS chunk_id, page_number FROM vchunks")
register("g14_similar_chunks", lambda s, d: rounded(G.similar_chunks(vector_edges(s, d)), "similarity"), "SELECT doc_id, chunk_id, neighbour, round(similarity, 6) AS similarity FROM vsim2")
#: Breadth first without a bound on hops, from a table of start rows (query_id, doc_id, ids): each round's new ids, while there are any and room is left.
WALK = """walk AS (
    SELECT query_id, doc_id, 0 AS hop, ids AS new, ids AS seen FROM start
    UNION ALL
    SELECT w.query_id, w.doc_id, w.hop + 1, list(DISTINCT v.neighbour), list_concat(any_value(w.seen), list(DISTINCT v.neighbour))
    FROM walk w JOIN {steps} v ON v.doc_id = w.doc_id AND list_contains(w.new, v.chunk_id) AND NOT list_contains(w.seen, v.neighbour)
    WHERE len(w.seen) < {most} GROUP BY w.query_id, w.doc_id, w.hop
),
hops AS (SELECT query_id, doc_id, u.chunk_id, hop FROM walk, unnest(new) AS u(chunk_id)),
reached AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY hop, chunk_id))::INT AS rank FROM hops QUALIFY rank <= {most})"""
register("g15_expand", lambda s, d: G.expand(query_rows(s, d).select("query_id", "doc_id", F.lit(3).alias("chunk_id")), vector_edges(s, d), 30),
         "WITH RECURSIVE start AS (SELECT query_id, doc_id, [3] AS ids FROM q),\n" + WALK.format(most=30, steps="vsteps") + "\nSELECT query_id, doc_id, chunk_id, hop, rank FROM reached")
register("g15_expand_chain", lambda s, d: G.expand(query_rows(s, d).select("query_id", "doc_id", F.lit(3).alias("chunk_id")), chain_edges(s, d), 30, section_step=False),
         "WITH RECURSIVE start AS (SELECT query_id, doc_id, [3] AS ids FROM q), csteps AS (SELECT doc_id, chunk_id, neighbour FROM vadj),\n" + WALK.format(most=30, steps="csteps") + "\nSELECT query_id, doc_id, chunk_id, hop, rank FROM reached")
register("g16_expand_prioritized", lambda s, d: G.expand_prioritized(R.seeds(query_rows(s, d), vector_ids(s, d)).where("rank = 1").select("query_id", "doc_id", F.col("id").alias("chunk_id")), vector_edges(s, d)),
         "SELECT query_id, doc_id, id AS chunk_id, priority, (row_number() OVER (PARTITION BY query_id ORDER BY priority, id))::INT AS rank FROM grown WHERE seed_rank = 1")
register("g17_g18_graph_stats", lambda s, d: rounded(G.graph_stats(*doc_graph(s, d)).select("doc_id", "n_nodes", "n_sections", "n_chunks", "n_pages", "n_edges", "n_contains_section", "n_contains", "n_belongs_to", "n_on_page", "n_follows", "density", "chunks_per_section"), "density", "chunks_per_section"), """
SELECT doc_id, n_nodes, n_sections, n_chunks, n_pages, coalesce(n_edges, 0) AS n_edges, coalesce(n_contains_section, 0) AS n_contains_section, coalesce(n_contains, 0) AS n_contains, coalesce(n_belongs_to, 0) AS n_belongs_to, coalesce(n_on_page, 0) AS n_on_page, coalesce(n_follows, 0) AS n_follows,
  round(CASE WHEN n_nodes > 1 THEN coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)) ELSE 0 END, 6) AS density, round(CASE WHEN n_sections > 0 THEN n_chunks / n_sections ELSE 0 END, 6) AS chunks_per_section
FROM (SELECT doc_id, count(*) AS n_nodes, count(*) FILTER (WHERE type = 'section') AS n_sections, count(*) FILTER (WHERE type = 'chunk') AS n_chunks, count(*) FILTER (WHERE type = 'page') AS n_pages FROM ids_of GROUP BY 1)
LEFT JOIN (SELECT doc_id, count(*) AS n_edges, count(*) FILTER (WHERE relation = 'contains_section') AS n_contains_section, count(*) FILTER (WHERE relation = 'contains') AS n_contains, count(*) FILTER (WHERE relation = 'belongs_to') AS n_belongs_to,
  count(*) FILTER (WHERE relation = 'on_page') AS n_on_page, count(*) FILTER (WHERE relation = 'follows') AS n_follows FROM dedges GROUP BY 1) USING (doc_id)""")
SIMILARITY = ("n_chunks", "n_pages", "n_edges", "n_follows", "n_similar_to", "n_similarities", "avg_similarity", "min_similarity", "max_similarity")
register("g17_similarity_stats", lambda s, d: rounded(G.graph_stats(*vector_graph(s, d)).select("doc_id", *SIMILARITY), *SIMILARITY[-3:]), """
WITH n AS (SELECT doc_id, count(*) AS n_chunks, count(DISTINCT page_number) AS n_pages FROM vchunks GROUP BY 1), f AS (SELECT doc_id, count(*) AS n_follows FROM vfollow GROUP BY 1),
e AS (SELECT doc_id, count(*) AS n_similar_to, count(similarity) FILTER (WHERE similarity != 0) AS n_similarities, round(avg(similarity) FILTER (WHERE similarity != 0), 6) AS avg_similarity, round(min(similarity) FILTER (WHERE similarity != 0), 6) AS min_similarity, round(max(similarity) FILTER (WHERE similarity != 0), 6) AS max_similarity FROM vsim GROUP BY 1)
SELECT doc_id, n_chunks, n_pages, 3 * n_chunks + coalesce(n_follows, 0) + coalesce(n_similar_to, 0) AS n_edges, coalesce(n_follows, 0) AS n_follows, coalesce(n_similar_to, 0) AS n_similar_to, coalesce(n_similarities, 0) AS n_similarities, avg_similarity, min_similarity, max_similarity
FROM n LEFT JOIN f USING (doc_id) LEFT JOIN e USING (doc_id)""")
register("g19_simplified", lambda s, d: G.simplified(*doc_graph(s, d))[1].select("doc_id", "source", "target", "relation"), """
WITH kept AS (SELECT doc_id, id FROM snodes UNION ALL SELECT doc_id, 'chunk:' || chunk_index FROM chunks LEFT JOIN (SELECT doc_id, 100 - count(*) AS room FROM snodes GROUP BY 1) USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) <= coalesce(room, 100))
SELECT e.doc_id, source, target, relation FROM dedges e SEMI JOIN kept k ON k.doc_id = e.doc_id AND k.id = e.source SEMI JOIN kept l ON l.doc_id = e.doc_id AND l.id = e.target""")
register("g20_display_nodes", lambda s, d: G.display_nodes(doc_graph(s, d)[0]), """
WITH n AS (SELECT doc_id, id, section_title AS name, 'Section: ' || section_path AS title, type FROM snodes UNION ALL SELECT doc_id, 'chunk:' || chunk_index, coalesce(nullif(heading, ''), 'Chunk ' || chunk_index), 'Chunk ' || chunk_index || ': ' || heading, 'chunk' FROM chunks
UNION ALL SELECT DISTINCT doc_id, 'page:' || page_number, 'Page ' || page_number, 'Page ' || page_number, 'page' FROM cpages)
SELECT doc_id, id, CASE WHEN length(name) > 30 THEN left(name, 27) || '...' ELSE name END AS label, title, type AS "group" FROM n""")

register("v01_hashed_words", lambda s, d: V.hashed_words(table(s, d, "documents").select("doc_id", "text"), width=16).select("doc_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec")))
register("v02_nearest", lambda s, d: rounded(V.nearest(query_rows(s, d), vector_ids(s, d), 5), "distance"), "SELECT query_id, doc_id, id, round(distance, 6) AS distance, rank FROM qrank WHERE rank <= 5")
register("v03_v04_scores", lambda s, d: V.all_scores(query_rows(s, d), vector_ids(s, d)).select("query_id", F.col("id").alias("chunk_index"), F.round(T.distance_to_similarity(F.col("distance")), 6).alias("similarity"), F.round("cosine", 5).alias("cosine")),
         "SELECT query_id, chunk_index, round(1 / (1 + list_sum(list_transform(list_zip(q.vec, vc.vec), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ^ 2)) / 150.0::DOUBLE), 6) AS similarity, round(list_cosine_similarity(q.vec::DOUBLE[], vc.vec::DOUBLE[]), 5) AS cosine FROM q JOIN vc ON q.doc_id = vc.doc_id")
register("v05_rerank", lambda s, d: rounded(R.seed_expansions(R.seeds(query_rows(s, d), vector_ids(s, d)), vector_edges(s, d), vector_ids(s, d)), "score"), "SELECT query_id, seed_rank, id, round(score, 6) AS score, rank FROM reranked")
register("v06_score_summary", lambda s, d: rounded(V.score_summary(R.seeds(query_rows(s, d), vector_ids(s, d))), "avg_score", "max_score", "min_score"), "SELECT query_id, count(*) AS n, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score FROM seeds GROUP BY 1")


def first(s, d):
    return R.first_pass(query_rows(s, d), vector_ids(s, d), vector_edges(s, d))


def again(s, d, grown):
    """A second pass of every query, by the vector after its own."""
    return R.later_pass(query_rows(s, d, 1).withColumn("query_id", F.col("query_id") - 1), vector_ids(s, d), grown)


def used(s, d):
    return first(s, d).used


def labelled(s, d):
    return R.provenance(*first(s, d))


def labelled_passes(s, d):
    """Both passes of each query, and page summaries: rows of another remainder ask for the first page of their document."""
    one = first(s, d)
    pages = query_rows(s, d, 2).select("query_id", "doc_id").join(vector_chunks(s, d).where("page_number = 1").select("doc_id", F.col("chunk_index").alias("id")), "doc_id").select("query_id", "id")
    return R.provenance(*one, again(s, d, one.grown), pages)


def context(s, d):
    one = first(s, d)
    return R.answer_context(one.used, again(s, d, one.grown).used.where("query_id % 40 = 0"))


def stub_model(prompt):
    """A model that any database can play: every second question needs the vector after its own, and the answer is the first chunk's name."""
    number = int(re.search(r"vector number (\d+)", prompt)[1])
    if "NEEDS_MORE" in prompt:
        return f"NEEDS_MORE: YES\nRELATED_QUERY: vector number {number + 1} please" if number % 40 == 0 else "NEEDS_MORE: NO\nRELATED_QUERY: None"
    if "CLASS:" in prompt:
        return "CLASS: FULL_RETRIEVAL"
    return f"It is in t{re.search(r'.C(.*?). ', prompt)[1]}" if "from these chunks" in prompt else "- and t1?\n- And T1?"


def answers(s, d):
    """The whole answer loop over every query, with vectors in place of an embedding."""
    chunk = vector_chunks(s, d).withColumns({"content": F.concat(F.lit("t"), F.col("chunk_index")), "section_path": F.lit("S")})
    corpus = flows.Corpus(stored(chunk, "chunks"), vectors(s, d), None, vector_edges(s, d))
    texts = query_rows(s, d).select("query_id", "doc_id", F.concat(F.lit("vector number "), F.col("query_id"), F.lit(" please")).alias("text"))
    named = table(s, d, "embeddings").select(F.col("vec_id").alias("number"), F.col("embedding").alias("vec"))
    embed = lambda rows: rows.withColumn("number", F.regexp_extract("text", r"(\d+)", 1).cast("long")).join(named, "number").drop("number")
    return flows.answer(texts, corpus, stub_model, embed=embed)


register("r01_route", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", R.route(F.col("turn") % 3 == 0, F.col("turn"), F.col("role") == "user").alias("route")),
         "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn > 0 THEN 'summarize_page' WHEN role = 'user' THEN 'use_history' ELSE 'normal_retrieval' END AS route FROM conversations")
register("r02_initial_retrieval", used, "SELECT * FROM used")
register("r03_seed_quality", lambda s, d: R.seed_quality(R.seeds(query_rows(s, d), vector_ids(s, d)), 0.99), "SELECT query_id, count(*) AS n_seeds, count(*) FILTER (WHERE score >= 0.99::DOUBLE) AS n_good FROM seeds GROUP BY 1")
register("r04_second_retrieval", lambda s, d: again(s, d, first(s, d).grown).used, "SELECT * FROM used2")
register("r05_next_step", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", R.next_step(F.col("turn"), F.col("role") == "user", F.when(F.col("conv_id") % 2 == 0, F.col("text"))).alias("step")),
         "SELECT conv_id, turn, CASE WHEN turn >= 3 THEN 'generate_answer' WHEN role = 'user' AND conv_id % 2 = 0 AND text != '' THEN 'second_retrieval' ELSE 'generate_answer' END AS step FROM conversations")
register("r06_answer_context", context, "SELECT query_id, id, place FROM used WHERE query_id % 40 != 0 UNION ALL SELECT query_id, id, place FROM used2 WHERE query_id % 40 = 0")
register("r06_answer_loop", answers, """
WITH more AS (SELECT e.vec_id AS query_id, vc.chunk_index AS id, list_sum(list_transform(list_zip(n.embedding, vc.vec), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d
    FROM embeddings e JOIN embeddings n ON n.vec_id = e.vec_id + 1 JOIN vc ON vc.doc_id = e.label WHERE e.vec_id % 40 = 0),
best AS (SELECT query_id, id FROM used WHERE place = 1 AND query_id % 40 != 0 UNION ALL SELECT query_id, id FROM more QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) = 1)
SELECT query_id, doc_id, 'normal_retrieval' AS route, CASE WHEN query_id % 40 = 0 THEN 2 ELSE 1 END AS passes, 'It is in t' || id AS answer, [id] AS chunk_ids, '^[C' || id || ']' AS "references", ['and t1?'] AS questions FROM best JOIN q USING (query_id)""")
register("r07_search", lambda s, d: R.search(query_rows(s, d), vector_ids(s, d), vector_edges(s, d)), """
WITH RECURSIVE near AS (SELECT * FROM qrank WHERE rank <= 20),
start AS (SELECT query_id, doc_id, list(id) AS ids FROM near WHERE rank <= 5 GROUP BY ALL),
""" + WALK.format(most=15, steps="vsteps") + """,
g AS (SELECT query_id, chunk_id AS id, rank FROM reached)
SELECT query_id, id, min(stage)::INT AS stage, (row_number() OVER (PARTITION BY query_id ORDER BY min(stage * 1000 + rank), id))::INT AS place
FROM (SELECT query_id, id, 0 AS stage, rank FROM near UNION ALL SELECT query_id, id, 1, rank FROM g) GROUP BY query_id, id QUALIFY place <= 15""")
register("r08_provenance", lambda s, d: rounded(labelled(s, d), "similarity_score", "rerank_score"), "SELECT query_id, id, place, source, round(similarity_score, 6) AS similarity_score, round(rerank_score, 6) AS rerank_score FROM provenance")
register("r09_retrieval_statistics", lambda s, d: R.retrieval_statistics(labelled(s, d)), "SELECT query_id, count(*) AS total_chunks_used, count(*) FILTER (WHERE source = 'seed') AS seed_chunks, count(*) FILTER (WHERE source = 'graph_expanded') AS graph_expanded_chunks, count(rerank_score) AS reranked_chunks FROM provenance GROUP BY 1")
BOTH_PASSES = """late AS (SELECT u.query_id, u.id, row_number() OVER (PARTITION BY u.query_id ORDER BY u.place, u.id) + coalesce(n, 0) AS place, s.score AS similarity_score, r.score AS rerank_score
    FROM used2 u LEFT JOIN (SELECT query_id, max(place) AS n FROM used GROUP BY 1) b ON b.query_id = u.query_id
    LEFT JOIN seeds2 s ON s.query_id = u.query_id AND s.id = u.id LEFT JOIN (SELECT query_id, id, max(score) AS score FROM reranked GROUP BY 1, 2) r ON r.query_id = u.query_id AND r.id = u.id
    WHERE NOT EXISTS (SELECT 1 FROM used f WHERE f.query_id = u.query_id AND f.id = u.id)),
asked AS (SELECT vec_id AS query_id, label AS doc_id FROM embeddings WHERE vec_id % 20 = 2),
passes AS (
    SELECT query_id, id, place, source, similarity_score, rerank_score FROM provenance
    UNION ALL SELECT query_id, id, place, CASE WHEN similarity_score IS NOT NULL THEN 'second_seed' WHEN rerank_score IS NOT NULL THEN 'second_expanded' ELSE 'second_retrieval' END, similarity_score, rerank_score FROM late
    UNION ALL SELECT query_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY chunk_index), 'page_summary', NULL, NULL FROM asked JOIN vchunks USING (doc_id) WHERE page_number = 1)
"""
LABELS = {"seed_chunks": "seed", "graph_expanded_chunks": "graph_expanded", **{f"{x}_chunks": x for x in ("second_seed", "second_expanded", "second_retrieval", "page_summary")}}
register("r08_provenance_both_passes", lambda s, d: rounded(labelled_passes(s, d), "similarity_score", "rerank_score"),
         "WITH " + BOTH_PASSES + "SELECT query_id, id, place::INT AS place, source, round(similarity_score, 6) AS similarity_score, round(rerank_score, 6) AS rerank_score FROM passes")
register("r09_statistics_both_passes", lambda s, d: R.retrieval_statistics(labelled_passes(s, d), all_labels=True),
         "WITH " + BOTH_PASSES + "SELECT query_id, count(*) AS total_chunks_used, count(rerank_score) AS reranked_chunks, " + ", ".join(f"count(*) FILTER (WHERE source = '{x}') AS {c}" for c, x in LABELS.items()) + " FROM passes GROUP BY 1")
register("r10_only_grounded", lambda s, d: R.only_grounded(used(s, d), used(s, d).where("place % 2 = 0").groupBy("query_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("chunk_ids"))), "SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY id DESC))::INT AS place FROM used WHERE place % 2 = 0")
register("r11_lookup", lambda s, d: R.lookup(table(s, d, "labels").select(F.col("doc_id").alias("request_id"), "doc_id", F.array(F.lit(2), F.lit(0), F.lit(2)).alias("ids")), chunks(s, d).select("doc_id", "chunk_index", "heading")),
         "SELECT l.doc_id AS request_id, l.doc_id, CASE chunk_index WHEN 2 THEN 0 ELSE 1 END AS place, chunk_index, heading FROM labels l JOIN chunks c ON c.doc_id = l.doc_id AND chunk_index IN (0, 2)")
