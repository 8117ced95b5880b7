"""Golden cases worked by hand, and properties."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import chunking as C
from docgraph.operators import dedup as D
from docgraph.operators import graph as G
from docgraph.operators import grounding as N
from docgraph.operators import inference as P
from docgraph.operators import layout as L
from docgraph.operators import retrieval as Q
from docgraph.operators import tables as R
from docgraph.operators import usage as U
from docgraph.operators import vectors as V
from docgraph.plans import flows, registry
from docgraph.sources import ledger, readers, sinks
from docgraph.streaming import streams as Z

PB = T.PAGE_BREAK


def md(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")


def test_header_paths(spark):
    text = "# A\n## B\n### C\n## D\n#### E\n# F\n#x\n####### deep"
    assert [(r.title, r.section_path) for r in L.headers(md(spark, text)).orderBy("line").collect()] == [
        ("A", "A"), ("B", "A > B"), ("C", "A > B > C"), ("D", "A > D"), ("E", "A > D > E"), ("F", "F"), ("deep", "F > deep"),
    ]


def test_pages(spark):
    paged = L.line_pages(L.lines(md(spark, f"a\n{PB}\nb", PB, "x")))
    assert [r.page_number for r in paged.where("doc_id = 0").orderBy("line_no").collect()] == [1, 1, 2]
    assert {(r.doc_id, r.start_line, r.end_line, r.page_number) for r in L.page_spans(paged).collect()} == {(0, 0, 1, 1), (0, 2, 2, 2), (2, 0, 0, 1)}
    assert {r.doc_id: r.total_pages for r in L.page_counts(md(spark, f"a\n{PB}\nb", "x")).collect()} == {0: 2, 1: 1}
    assert [(r.nonblank_page_no, r.page_number) for r in L.split_pages(md(spark, f"a\n{PB}\n \n{PB}\nb")).collect()] == [(1, 1), (2, 3)]


def test_slices(spark):
    region = spark.createDataFrame([(0, 4, 1, "T", "T", 5, "abc\nde\n")], "doc_id long, line int, level int, title string, section_path string, size int, region string")
    assert [(r.content, r.start_line) for r in C.slices(region).orderBy("k").collect()] == [("abc\nd", 5), ("e\n", 6)]


def test_chunk_sizes_and_neighbours(spark):
    sizes = spark.createDataFrame([(100,), (4000,), (1_000_000,)], "n long").select(C.chunk_size(F.col("n")).alias("s")).collect()
    assert [r.s for r in sizes] == [300, 500, 1000]
    four = C.with_neighbours(spark.createDataFrame([(0, p) for p in (2, 5, 7, 9)], "doc_id long, position int"))
    rows = four.orderBy("chunk_index").collect()
    assert [r.prev_chunk_ids for r in rows] == [[], [0], [0, 1], [1, 2]] and [r.next_chunk_ids for r in rows] == [[1, 2], [2, 3], [3], []]
    assert G.follow_edges(four).count() == 5


def test_near_repeats(spark):
    chunks = spark.createDataFrame([(0, k, t) for k, t in enumerate(["a b c", "c a b", "x", " ", "x"])], "doc_id long, position int, content string")
    assert sorted(r.position for r in C.drop_near_repeats(chunks).collect()) == [0, 2, 3]


def test_slices_make_up_their_regions(spark):
    text = "# H\n" + "\n".join(f"line {k} é😀 " + "z" * (k * 7 % 60) for k in range(60)) + "\n## I\n\n---\n## J\nlast"
    regions = C.regions(md(spark, text))
    assert {r.title for r in regions.collect()} == {"H", "J"}
    joined = C.slices(regions).groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]), "").alias("t"))
    assert {r.line: r.t for r in joined.collect()} == {r.line: r.region for r in regions.collect()}


def test_table_repair(spark):
    text = "x\n| Name | Name | Sum |\n|---|---|---|\n| 1. | Group |  |\n|  | child | 5 |\n| Only | Only |  |\n| a | 1 |  |\nend\n" + f"z {PB}"
    out = R.repair_markdown(L.lines(md(spark, text))).first().markdown
    assert out == f"x\n| Name |  | Sum |\n| --- | --- | --- |\n| 1. | Group |  |\n|  | ↳ child | 5 |\n\n| Only | Only |\n| --- | --- |\n| a | 1 |\nend\n{PB}"


def test_support(spark):
    chunks = spark.createDataFrame([(0, 0, "Solar panels convert sunlight into power"), (0, 1, "Wind turbines need steady wind"), (0, 2, "Batteries store power overnight"), (0, 3, "zzz")], "doc_id long, chunk_index int, content string")
    texts = spark.createDataFrame([(9, 0, "Solar panels make power. Batteries store it overnight! ok.")], "text_id long, doc_id long, text string")
    row = N.supporting_chunks(texts, chunks, 2, 0.1).first()
    assert row.chunk_ids == [0, 2]
    assert spark.range(1).select(N.format_references(F.array(F.lit(5), F.lit(1), F.lit(5))).alias("r")).first().r == "^[C1,C5]"
    assert N.answer_chunks(texts.withColumn("text", F.lit("nothing shared here")), chunks).first().chunk_ids == [0, 1, 2, 3]


def test_citations(spark):
    row = spark.createDataFrame([("x ^[C5,C1] y ^[C12] [c3] [C5]",)], "t string")
    t = F.col("t")
    r = row.select(N.extract_references(t).alias("e"), N.cited_in_order(t).alias("o"), N.expand_groups(t).alias("g"), N.strip_groups(t).alias("s")).first()
    assert r.e == [1, 5, 12] and r.o == [12, 3, 5] and r.g == "x [C5] [C1] y [C12] [c3] [C5]" and r.s == "x y [c3]"


def test_cost(spark):
    event = spark.createDataFrame([("openai", "text-embedding-3-large", "x", 0, 0, 37522), ("ollama", "text-embedding-3-large", "x", 1, 1, 1)], "provider string, embedding_model string, llm_model string, input_tokens long, output_tokens long, embedding_tokens long")
    rows = U.price(event, U.price_table(spark)).collect()
    assert (rows[0].cost_estimate_usd, rows[0].cost_display) == (0.00487786, "0.004878") and (rows[1].cost_estimate_usd, rows[1].cost_display) == (None, "N.A")


def test_parsing(spark):
    def one(expr, text):
        return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first().r

    assert one(P.clean_label, '"Label: "Terms of use":\nmore') == "Terms of use" and one(P.clean_label, "x") == "Unknown" and len(one(P.clean_label, "y" * 80)) == 50
    assert tuple(one(P.parse_summary, "SUMMARY: Two. Parts\nKEY_POINTS:\n- a\n* b\n\nc")) == ("Two. Parts", ["a", "b", "c"])
    assert one(P.parse_summary, "First line").key_points == ["First line"]
    assert one(P.one_sentence, "\nShort one. This one has five words or more! Third.") == "This one has five words or more!"
    assert tuple(one(P.parse_class, "class: page_summary\npage_number: 7 or so")) == ("PAGE_SUMMARY", 7) and one(P.parse_class, "CLASS: PAGE_SUMMARY")["class"] == "FULL_RETRIEVAL"
    assert tuple(one(P.parse_more, "NEEDS_MORE: yes\nRELATED_QUERY: 'query: where are the batteries stored or kept?'")) == (True, "where are the batteries stored")
    assert tuple(one(P.parse_more, "NEEDS_MORE: YES\nRELATED_QUERY: none")) == (False, None)
    assert one(P.clean_answer, "See (Chunk 3) this ,, and  Chunk 4 .\n\n\n\nEnd . ") == "See this, and.\n\nEnd."
    assert one(P.parse_list, 'sure: ["a","b"]') == ["a", "b"] and one(P.parse_list, "- a\n\n- b") == ["- a", "- b"] and one(P.parse_list, '["a", ') == ["[\"a\","] and one(P.parse_list, '["a" "b"]') == []


def test_tokenizer_slots(spark):
    def encode(text):
        if "bad" in text:
            raise ValueError("no")
        return list(text)

    rows = spark.createDataFrame([(0, None), (1, ""), (2, "abcde"), (3, "bad text"), (4, "x" * 30 + ". " + "y" * 8), (5, "bad" * 10)], "id int, t string")
    fit = C.fit_tokens_by(encode, "".join)
    out = {r.id: (r.n, r.cut) for r in rows.select("id", T.tokens_by(encode)(F.col("t")).alias("n"), fit(F.col("t"), 38).alias("cut")).collect()}
    assert out == {0: (None, None), 1: (0, ""), 2: (6, "abcde"), 3: (5, "bad text..."), 4: (52, "x" * 30 + "...."), 5: (20, "bad" * 10 + "...")}


def test_limits_by_a_tokenizer(spark):
    texts = ["short", "x" * 580, "One. Two\n" * 130, "y" * 3000, None, ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, content string")
    tokens = T.tokens_by(lambda t: t + t)  # 2.6 a character: 1500 are exceeded from 577 characters on
    fit = C.fit_tokens_by(lambda t: list(t + t), lambda ids: "".join(ids))
    fitted = {r.doc_id: r.e for r in rows.select("doc_id", C.fit_embedding(F.col("content"), tokens, fit).alias("e")).collect()}
    assert (fitted[0].text, fitted[0].truncated, fitted[0].tokens) == ("short", False, 13) and fitted[1].truncated and fitted[4].text is None and fitted[5].tokens == 0
    cut = {r.doc_id: r.t for r in rows.select("doc_id", C.final_cut(F.col("content"), tokens).alias("t")).collect()}
    assert cut[0] == "short" and cut[1] == "x" * 580 + "..." and cut[3] == "y" * 800 + "..." and cut[4] is None and len(cut[2]) == 803
    stats = {r.doc_id: (r.total_chunks, r.truncated_chunks, r.llm_tokens) for r in C.chunk_statistics(rows, tokens, fit).collect()}
    assert stats[0] == (1, 0, 13) and stats[1][1] == stats[2][1] == stats[3][1] == 1 and stats[3][2] == 7800


def test_model_errors_stay_in_their_rows(spark):
    def model(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    rows = P.complete(spark.createDataFrame([("a",), ("bad",)], "prompt string"), model).collect()
    assert {(r.prompt, r.response, r.error) for r in rows} == {("a", "A", None), ("bad", None, "ValueError: no")}


def test_duplicates(spark):
    pages = spark.createDataFrame([(0, 1, "Same  text!"), (0, 2, "same text"), (0, 3, "other page")], "doc_id long, nonblank_page_no int, text string")
    exact = D.exact_clusters(pages)
    assert exact.first().pages == [1, 2]
    near = D.near_pairs(pages, V.hashed_words(pages, width=64).select("doc_id", "nonblank_page_no", "vec"), 0.3)
    report = D.duplicate_report(pages, exact, near).first()
    assert report.total_pages == 3 and len(report.duplicates) >= 1
    lsh = D.near_pages_lsh(V.hashed_words(spark.createDataFrame([(k, "alpha beta gamma delta" + (" x" if k % 2 else "")) for k in range(20)], "id long, text string")).select("id", "vec"), 0.8)
    assert lsh.count() >= 19


def test_near_pages_among_strangers(spark):
    rng = np.random.default_rng(5)
    strangers = rng.normal(size=(600, 8))
    copies = strangers[:150] + 0.05 * rng.normal(size=(150, 8))
    v = np.concatenate([strangers, copies, strangers[:20]])  # a copy's id is far from its original's: strangers lie between them
    ids = [int(x) for x in np.concatenate([rng.permutation(750), np.arange(750, 770)])]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id long, vec array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)))]
    for block_rows in (8192, 8):
        links = D.near_pages_lsh(rows, 0.95, planes=3, tables=8, block_rows=block_rows).collect()
        group = {i: i for i in ids}

        def root(i):
            while group[i] != i:
                i = group[i]
            return i

        for x in links:
            assert x.first < x.second and x.score >= 0.95
            group[root(x.first)] = root(x.second)
        assert sum(root(a) == root(b) for a, b in near) >= 0.9 * len(near)
        true = {frozenset(p) for p in near}
        assert all(frozenset((x.first, x.second)) in true for x in links)
        assert sum(x.score == 1.0 for x in links) >= 20


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "docs"
    for name, text in (("d1", "# A\nhello"), ("d2", "plain")):
        (root / name).mkdir(parents=True)
        (root / name / "x.md").write_text(text)
    (root / "d1" / "x_page_mapping.json").write_text(json.dumps({"line_to_page": [1, 1], "page_boundaries": [[0, 1, 1]], "total_pages": 1}))
    (root / "d1" / "x_confidence.json").write_text(json.dumps({"layout_score": 0.5, "pages": {"1": {"parse_score": 0.25}, "x": {}}}))
    (root / "d1" / "my_chunks.json").write_text(json.dumps([{"vector_number": 0, "content": ["a", "b"], "metadata": {"chunk_index": 0}}]))
    (root / "d1" / "my_graph.json").write_text(json.dumps({"nodes": [{"id": "chunk:0", "type": "chunk"}], "edges": [{"source": "a", "target": "b", "relation": "follows"}]}))
    (root / "d1" / "dup_duplicates.json").write_text(json.dumps({"total_pages": 2, "duplicates": [{"pages": [1, 2], "score": 1.0}]}))
    docs = readers.markdown_files(spark, str(root))
    assert {(r.doc_id, r.name, r.markdown) for r in docs.collect()} == {("d1", "x", "# A\nhello"), ("d2", "x", "plain")}
    assert {r.doc_id: r.total_pages for r in readers.with_page_mapping(docs, readers.page_mappings(spark, str(root))).collect()} == {"d1": 1, "d2": None}
    assert [(r.page_number, r.parse_score) for r in readers.confidence(spark, str(root))[1].collect()] == [(1, 0.25)]
    assert readers.stored_chunks(spark, str(root)).first().content == "a\nb"
    nodes, edges = readers.stored_graph(spark, str(root))
    assert nodes.first().id == "chunk:0" and edges.first().relation == "follows"
    assert readers.duplicate_reports(spark, str(root)).first().pages == [1, 2]
    files = readers.artifact_files(spark, str(root), "*graph*.json", "graph")
    assert readers.newest_artifacts(files).count() == 1
    log = tmp_path / "usage.jsonl"
    log.write_text('{"timestamp": "2026-01-02T03:04:05Z", "step": "s", "input_tokens": 3}\n\nnot json\n')
    assert [(r.step, str(r.date)) for r in readers.usage_log(spark, str(log)).collect()] == [("s", "2026-01-02")]
    table = str(tmp_path / "table")
    sinks.write_chunks(spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, chunk_index int"), table)
    ledger.replace_rows(spark.createDataFrame([("a", 9)], "doc_id string, chunk_index int"), table)
    assert {(r.doc_id, r.chunk_index) for r in spark.read.parquet(table).collect()} == {("a", 9), ("b", 2)}


def test_streams(spark, tmp_path):
    raw = spark.createDataFrame([(k, f"2026-01-0{1 + k // 4} 10:00:00", "p", "s", k % 2, 1, 2, 3) for k in range(12)], "event_id long, ts string, phase string, step string, document_id long, input_tokens long, output_tokens long, embedding_tokens long")
    path = str(tmp_path / "in")
    raw.write.parquet(path)
    q = Z.daily_rollup(Z.usage_stream(spark, path, raw.schema)).writeStream.outputMode("append").format("memory").queryName("closed_days").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {str(r.day): r.events for r in spark.table("closed_days").collect()}
    assert closed and all(n == 4 for n in closed.values())  # closed windows agree with the batch


def test_provenance_of_both_passes(spark):
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    place, score = "query_id long, id int, place int", "query_id long, id int, score double"
    first, found, grown = rows(place, (0, 1, 1), (0, 2, 2), (0, 3, 3)), rows(score, (0, 1, 0.9)), rows(score, (0, 2, 0.5))
    again, found2, grown2 = rows(place, (0, 1, 1), (0, 4, 2), (0, 5, 3), (0, 6, 4), (7, 8, 1)), rows(score, (0, 1, 0.8), (0, 4, 0.7)), rows(score, (0, 5, 0.4))
    pages = rows("query_id long, id int", (9, 5), (9, 2))
    out = Q.provenance(first, found, grown, Q.Pass(again, found2, grown2), pages)
    assert {(r.query_id, r.place, r.id, r.source, r.similarity_score, r.rerank_score) for r in out.collect()} == {
        (0, 1, 1, "seed", 0.9, None), (0, 2, 2, "graph_expanded", None, 0.5), (0, 3, 3, "initial", None, None),
        (0, 4, 4, "second_seed", 0.7, None), (0, 5, 5, "second_expanded", None, 0.4), (0, 6, 6, "second_retrieval", None, None),
        (7, 1, 8, "second_retrieval", None, None), (9, 1, 2, "page_summary", None, None), (9, 2, 5, "page_summary", None, None),
    }
    counts = {r.query_id: r for r in Q.retrieval_statistics(out, all_labels=True).collect()}
    assert (counts[0].total_chunks_used, counts[0].second_seed_chunks, counts[0].second_expanded_chunks, counts[0].second_retrieval_chunks, counts[9].page_summary_chunks) == (6, 1, 1, 1, 2)


def test_graph_usage_and_report_sinks(spark, tmp_path):
    edges = spark.createDataFrame(
        [(1, "chunk:0", "chunk:1", "similar_to", 0.8), (1, "chunk:0", "chunk:1", "follows", None), (1, "chunk:0", "chunk:1", "similar_to", 0.9), (1, "page:1", "chunk:0", "on_page", None), (2, "page:1", "chunk:0", "on_page", None)],
        "doc_id long, source string, target string, relation string, similarity double",
    )
    nodes = spark.createDataFrame([(1, "chunk:0", "chunk"), (1, "chunk:1", "chunk"), (2, "chunk:0", "chunk")], "doc_id long, id string, type string")
    sinks.write_graph(nodes, edges, f"{tmp_path}/graph")
    stored = spark.read.parquet(f"{tmp_path}/graph/edges")
    assert {(r.doc_id, r.source, r.target, r.relation, r.similarity) for r in stored.collect()} == {(1, "chunk:0", "chunk:1", "similar_to", 0.9), (1, "page:1", "chunk:0", "on_page", None), (2, "page:1", "chunk:0", "on_page", None)}
    assert spark.read.parquet(f"{tmp_path}/graph/nodes").count() == 3
    sinks.write_vectors(spark.createDataFrame([("a", 0, [1.0]), ("b", 0, [2.0])], "doc_id string, chunk_index int, embedding array<double>"), f"{tmp_path}/vectors")
    assert {(r.doc_id, r.embedding[0]) for r in spark.read.parquet(f"{tmp_path}/vectors").collect()} == {("a", 1.0), ("b", 2.0)}
    events = spark.createDataFrame([(k, f"2026-01-0{1 + k % 2} 10:00:00") for k in range(40)], "event_id long, t string").selectExpr("event_id", "timestamp(t) AS ts")
    for _ in range(2):  # an append keeps what is there
        sinks.append_usage(events, f"{tmp_path}/usage")
    log = spark.read.parquet(f"{tmp_path}/usage")
    assert log.count() == 80 and {str(r.date) for r in log.select("date").distinct().collect()} == {"2026-01-01", "2026-01-02"}
    sinks.write_reports(nodes, f"{tmp_path}/reports")
    assert spark.read.json(f"{tmp_path}/reports").count() == 3


def test_flow(spark):
    text = "# Energy\nSolar panels convert sunlight into power.\n## Storage\nBatteries store power overnight.\n" + f"{PB}\n# Wind\nTurbines need steady wind."
    corpus = flows.build(flows.ingest(md(spark, text)), similar=True, width=16)
    kinds = {r.relation for r in corpus.edges.select("relation").distinct().collect()}
    assert {"contains", "belongs_to", "on_page", "follows", "contains_section"} <= kinds
    asked = spark.createDataFrame([(7, 0, "Where do batteries store power?")], "query_id long, doc_id long, text string")
    row = flows.answer(asked, corpus, lambda p: "Batteries store power overnight.").first()
    assert row.answer == "Batteries store power overnight." and 1 in row.chunk_ids and row.references.startswith("^[C")


@pytest.mark.parametrize("column", ["a  b", " x\t"])
def test_collapse(spark, column):
    assert spark.createDataFrame([(column,)], "t string").select(T.collapse(F.col("t")).alias("r")).first().r == " ".join(column.split())
