"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9 = rf"""
WITH docs AS (
    SELECT doc_id, source, len({WORDS})::BIGINT AS size,
           md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS mix_key
    FROM documents
),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight
    FROM docs GROUP BY source
),
level AS (
    SELECT *, 2 * source_size AS cap,
           sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight,
           coalesce(sum(2 * source_size) OVER w, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
    FROM sources
    WINDOW w AS (ORDER BY 2 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
capped AS (
    SELECT *, 100 * cap * (all_weight - weight_before) <= weight * (150 * all_size - 100 * cap_before) AS is_capped FROM level
),
targets AS (
    SELECT source, source_size,
           CASE WHEN is_capped THEN cap::DOUBLE
                ELSE (weight * (150 * all_size - 100 * coalesce(sum(cap) FILTER (WHERE is_capped) OVER (), 0)::BIGINT))::DOUBLE
                     / (100 * coalesce(sum(weight) FILTER (WHERE NOT is_capped) OVER (), 0)::BIGINT)::DOUBLE END AS target
    FROM capped
),
placed AS (
    SELECT docs.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mix_key, doc_id, size
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM docs
)
SELECT doc_id, size, source_size, target,
       ((CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END) * size
        + greatest(0, least(size, (CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END) - before)))::BIGINT AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
"""

OP4 = rf"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT row_id, doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
    FROM docs, unnest(generate_series(1, greatest(1, len(w) - 2))) AS u(i)
    WHERE len(w) > 0
),
sizes AS (SELECT row_id, count(*) AS n FROM shingles GROUP BY row_id),
shared AS (
    SELECT a.row_id AS a, b.row_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.row_id < b.row_id
    GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.row_id = a JOIN sizes y ON y.row_id = b
    WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT row_id AS a, row_id AS b FROM docs
    UNION
    SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a
)
SELECT d.doc_id, coalesce(max(sizes.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM docs d JOIN reach ON reach.a = d.row_id JOIN docs o ON o.row_id = reach.b LEFT JOIN sizes ON sizes.row_id = d.row_id
GROUP BY d.row_id, d.doc_id
"""

ORACLES: dict[str, str] = {"op4_ngram_jaccard": OP4, "op9_mixing": OP9}

OP1 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.e, x.e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id != x.vec_id
),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

OP2 = r"""
WITH rules(rule_host, rule_path, verdict) AS (
    VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
),
parts AS (
    SELECT row_number() OVER () AS row_id, page_id,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
),
fits AS (
    SELECT row_id, rule_host || rule_path AS rule, verdict,
           row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS k
    FROM parts JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.row_id = fits.row_id AND k = 1
"""

OP6 = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
windows AS (
    SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n
    FROM docs, unnest(generate_series(1, len(w) - 4)) AS u(i)
),
repeats AS (
    SELECT row_id, count(DISTINCT i + k) AS n FROM windows, unnest([0, 1, 2, 3, 4]) AS u(k) WHERE n > 1 GROUP BY row_id
),
lines AS (
    SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
    FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id
),
measured AS (
    SELECT doc_id, text, len(w)::BIGINT AS n_words,
           length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
           (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
           coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
           length(text) - length(translate(text, '!', '')) AS n_shouts,
           length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_capitals,
           greatest(1, length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))) AS n_letters,
           greatest(1, coalesce(n_lines, 0)) AS n_lines
    FROM docs LEFT JOIN repeats USING (row_id) LEFT JOIN lines USING (row_id)
),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(1, n_words) AS n FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 100 > n * 30 OR n_shouts * 100 > n * 40 OR (n_capitals * 100 > n_letters * 50 AND n_letters >= 40)
            OR word_chars > n * 20 OR word_chars * 2 < n * 3 OR n_dup_lines * 100 > n_lines * 50) AS kept
FROM based
"""


def _escaped_length(column: str) -> str:
    """Code points after escaping: one more for each backslash and each control string."""
    strings = ["\\", "<s>", "</s>", "[INST]", "[/INST]"]
    return f"(length({column}) + " + " + ".join(f"(length({column}) - length(replace({column}, '{s}', ''))) // {len(s)}" for s in strings) + ")"


OP7 = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({_escaped_length("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped_length("text")} + CASE WHEN role = 'assistant' THEN 8 ELSE 14 END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLES |= {"op1_pivot_top_k": OP1, "op2_url_filter": OP2, "op6_quality_rules": OP6, "op7_chat_format": OP7}

OP12 = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT row_id, doc_id, u.i, ls[u.i] AS line, regexp_replace(ls[u.i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM docs, unnest(generate_series(1, len(ls))) AS u(i)),
keyed AS (SELECT *, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
listed AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
    GROUP BY k HAVING count(DISTINCT doc_id) + CASE WHEN count(*) > count(doc_id) THEN 1 ELSE 0 END >= 5
),
judged AS (
    SELECT row_id, doc_id, i, line, listed.k IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN listed ON keyed.k = listed.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_id, doc_id
"""

ORACLES |= {"op12_line_dedup": OP12}

OP11 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
),
terms AS (SELECT row_id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
cells AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS n_terms, sum(n) AS total FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
grouped AS (
    SELECT g.lang, g.source, coalesce(sums.total, 0)::HUGEINT AS total, coalesce(n_terms, 0)::HUGEINT AS n_terms
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sums USING (lang, source) LEFT JOIN langs USING (lang)
),
dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.n_terms) AS p,
           1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.n_terms) AS q
    FROM grouped g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
distances AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
),
judged AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source != b.source
    LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM dense WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM judged)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES |= {"op11_source_audit": OP11}
