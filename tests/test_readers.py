"""Files chosen by name and time before they are read."""

import json
import os

from docgraph.sources import readers


def write(path, text, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at:
        os.utime(path, (at, at))


def test_the_first_file_of_each_folder(spark, tmp_path):
    for k in range(6):
        write(tmp_path / f"d {k}" / "b é.md", f"second {k}")
        if k % 2:
            write(tmp_path / f"d {k}" / "a.md", f"first {k}")
    write(tmp_path / "d 0" / "z.txt", "no markdown")
    expected = {(f"d {k}", "a", f"first {k}") if k % 2 else (f"d {k}", "b é", f"second {k}") for k in range(6)}
    for most in (1_000_000, 0):
        docs = readers.markdown_files(spark, str(tmp_path), most)
        assert {(r.doc_id, r.name, r.markdown) for r in docs.collect()} == expected
        plan = docs._jdf.queryExecution().executedPlan().toString()
        if most:  # no text goes through a shuffle
            assert not [line for line in plan.splitlines() if "Exchange" in line and "value" in line]


def test_nothing_is_joined_where_all_files_are_chosen(spark, tmp_path):
    write(tmp_path / "d" / "a.md", "text")
    docs = readers.markdown_files(spark, str(tmp_path))
    assert "Join" not in docs._jdf.queryExecution().executedPlan().toString() and docs.first().markdown == "text"


def test_newest_artifacts_by_name_time_and_path(spark, tmp_path):
    def graph(doc, name, node, at):
        write(tmp_path / doc / name, json.dumps({"nodes": [{"id": node, "type": "chunk"}], "edges": []}), at)

    graph("d1", "unified_graph.json", "chunk:1", 1_000)  # the preferred name, though older
    graph("d1", "x_graph.json", "chunk:2", 9_000)
    graph("d2", "a_graph.json", "chunk:3", 2_000)
    graph("d2", "enhanced_graph.json", "chunk:4", 1_000)  # the alternative name
    graph("d2", "unrelated.json", "chunk:9", 9_999)
    graph("d3", "a_graph.json", "chunk:5", 3_000)
    graph("d3", "b_graph.json", "chunk:6", 4_000)  # the latest
    graph("d4", "b_graph.json", "chunk:7", 5_000)
    graph("d4", "a_graph.json", "chunk:8", 5_000)  # a tie: the first path
    nodes, edges = readers.newest_graphs(spark, str(tmp_path))
    assert {(r.doc_id, r.id) for r in nodes.collect()} == {("d1", "chunk:1"), ("d2", "chunk:4"), ("d3", "chunk:6"), ("d4", "chunk:8")} and edges.count() == 0


def test_newest_chunks_ranges_and_overviews(spark, tmp_path):
    for at, text in ((1_000, "old"), (2_000, "new")):
        write(tmp_path / "d1" / f"{text}_chunks.json", json.dumps([{"vector_number": 0, "content": [text, "line"], "metadata": {"chunk_index": 0}}]), at)
    assert [r.content for r in readers.newest_chunks(spark, str(tmp_path)).collect()] == ["new\nline"]
    ranges = [{"title": "T", "start_page": 3, "end_page": 4, "summary": "later"}, {"title": "T", "start_page": 1, "end_page": 2, "summary": "first"}, {"title": "T", "start_page": 0, "end_page": 2, "summary": "x"}, {"title": "T", "start_page": 2, "end_page": 1, "summary": "x"}, {"title": "T", "start_page": 2, "end_page": 2, "summary": " "}]
    write(tmp_path / "d1" / "x_page_ranges.json", json.dumps(ranges))
    assert [(r.document_id, r.start_page, r.summary, r.place) for r in readers.page_ranges(spark, str(tmp_path)).orderBy("place").collect()] == [("d1", 1, "first", 1), ("d1", 3, "later", 2)]
    write(tmp_path / "d1" / "x_overview.json", json.dumps({"doc_summary": "all", "suggested_queries": ["a?"]}))
    row = readers.overviews(spark, str(tmp_path)).first()
    assert row.document_id == "d1" and row.suggested_queries == ["a?"]
