"""Whole flows with stub models."""

import time

from pyspark.sql import functions as F

from docgraph.functions.text import PAGE_BREAK as PB
from docgraph.operators import inference as P
from docgraph.plans import flows

TEXT = "\n".join(f"# Part {k}\nThis part tells about topic{k} and thing{k} in words of its own number{k}." + (f"\n{PB}" if k % 3 == 2 else "") for k in range(24))


def stub(prompt):
    """Classes by the question; needs as many passes as it says; answers by naming a topic."""
    question = prompt.split("Question: ")[-1].split("\n")[0]
    if "Class this question" in prompt:
        if "page" in question:
            return f"CLASS: PAGE_SUMMARY\nPAGE_NUMBER: {question.split()[-1]}"
        return "CLASS: USE_HISTORY\nPAGE_NUMBER: None" if "before" in question else "CLASS: FULL_RETRIEVAL\nPAGE_NUMBER: None"
    if "Do these chunks answer" in prompt:
        if "never" in question:
            return "NEEDS_MORE: YES\nRELATED_QUERY: never enough about topic9 of this"
        if "twice" in question:
            return "NEEDS_MORE: YES\nRELATED_QUERY: thing5 and number5 wanted"
        return "NEEDS_MORE: NO\nRELATED_QUERY: None"
    if "Answer the question" in prompt:
        if "broken" in question:
            raise ValueError("no")
        return "It tells about topic5 and thing5 (Chunk 3)." if "twice" in question else "zzz" if "nothing" in question else "This part tells about topic7."
    if "might follow" in prompt:
        return "- What is topic1?\n2) what is TOPIC1?\n* And topic2?"
    if "KEY_POINTS" in prompt:
        return "SUMMARY: A page about topics.\n\nKEY_POINTS:\n- one\n- two"
    return "You said hello before."


def test_answers_in_one_two_and_three_passes(spark):
    corpus = flows.build(spark.createDataFrame([(0, TEXT), (1, "no header here")], "doc_id long, markdown string"), similar=True, width=64)
    asked = [(1, 0, "what of topic7?"), (2, 0, "twice: what of topic5?"), (3, 0, "never enough of topic9"), (4, 0, "summarize page 2"), (5, 0, "what did I say before?"), (6, 0, "before what?"), (7, 0, "nothing is shared"), (8, 1, "of an empty document"), (9, 0, "broken one"), (10, 0, "page 99")]
    queries = spark.createDataFrame(asked, "query_id long, doc_id long, text string")
    history = spark.createDataFrame([(5, 1, "user", "hello", None), (5, 2, "assistant", "hi", None)], "query_id long, id long, role string, content string, chunks array<struct<chunk_index:int,content:string>>")
    rows = {r.query_id: r for r in flows.answer(queries, corpus, stub, history).collect()}
    assert {k: (r.route, r.passes) for k, r in rows.items()} == {
        1: ("normal_retrieval", 1), 2: ("normal_retrieval", 2), 3: ("normal_retrieval", 3), 4: ("summarize_page", 0), 5: ("use_history", 0), 6: ("use_history", 0),
        7: ("normal_retrieval", 1), 8: ("normal_retrieval", 1), 9: ("normal_retrieval", 1), 10: ("summarize_page", 0),
    }
    assert rows[2].answer == "It tells about topic5 and thing5." and 5 in rows[2].chunk_ids and rows[1].questions == ["What is topic1?", "And topic2?"]
    assert rows[4].answer == "A page about topics.\n\nKey points:\n- one\n- two" and rows[4].chunk_ids == [3, 4, 5] and rows[4].references == "^[C3,C4,C5]"
    assert rows[5].answer == "You said hello before." and rows[5].chunk_ids == [] and rows[6].answer == flows.NO_HISTORY
    assert rows[8].answer == flows.NO_CHUNKS and rows[9].answer == flows.NO_ANSWER and rows[10].answer == flows.NO_CONTENT and rows[9].references == "" == rows[10].references
    vecs = flows.hashed(64)
    context, _ = flows.retrieve(queries.where("query_id IN (1, 2, 3, 7)"), corpus, stub, vecs)
    used = {}
    for r in context.collect():
        used.setdefault(r.query_id, set()).add(r.id)
        assert 0 < r.score <= 1
    assert all(set(rows[k].chunk_ids) <= used[k] for k in (1, 2, 3, 7))  # nothing is cited that wasn't retrieved
    assert set(rows[7].chunk_ids) == used[7] and len(used[7]) < corpus.chunks.where("doc_id = 0").count()  # without shared words, all that was shown
    assert {r.query_id: r.passes for r in flows.answer(queries.where("query_id = 3"), corpus, stub, most_passes=2).collect()} == {3: 2}


def test_build_with_a_model(spark):
    def model(prompt):
        if "one sentence" in prompt:
            if "topic3" in prompt:
                raise ValueError("no")
            return "Other words stand here altogether." if "altogether" in prompt else "It is about topic0 and thing0 here."
        if "JSON array" in prompt:
            return 'Here: [{"title": "T", "start_page": 1, "end_page": 2, "summary": "It tells about topic4 and thing4."}, {"title": "bad", "start_page": 3, "end_page": 1, "summary": "x"}]' if "topic0" in prompt else "nothing"
        return '{"summary": "All about number6 in words of its own.", "queries": ["a?", "b?"]}'

    other = f"# X\nother words altogether\n{PB}\n# X\nother words altogether"
    corpus = flows.build(spark.createDataFrame([(0, TEXT), (1, other)], "doc_id long, markdown string"), model=model, in_flight=4)
    pages = {(r.doc_id, r.page_number): r for r in corpus.page_summaries.collect()}
    assert pages[0, 1].chunk_ids == [0, 1, 2] and pages[0, 1].summary_with_references.endswith("^[C0,C1,C2]")
    assert pages[0, 2].summary.startswith("This part tells about topic3")  # a failed call: the page's own words
    ranges = {(r.doc_id, r.start_page, r.end_page): r for r in corpus.ranges.collect()}
    assert set(ranges) >= {(0, 1, 2)} and (0, 3, 1) not in ranges and {k: r.chunk_ids for k, r in ranges.items() if k[0] == 1} == {(1, 1, 1): [0], (1, 2, 2): [1]}
    assert ranges[0, 1, 2].chunk_ids[0] >= 0 and 4 in ranges[0, 1, 2].chunk_ids and max(ranges[0, 1, 2].chunk_ids) <= 5
    overview = {r.doc_id: r for r in corpus.overviews.collect()}[0]
    assert overview.suggested_queries == ["a?", "b?"] and 6 in overview.chunk_ids and "^[C" in overview.summary_with_references
    report = {r.doc_id: r for r in corpus.duplicates.collect()}
    assert report[1].total_pages == 2 and [e.pages for e in report[1].duplicates if e.score == 1.0][0] == [1, 2]


def test_model_slot(spark):
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(12)] + [(12, None)], "id int, prompt string").coalesce(1)
    flaky_seen = {}

    def flaky(prompt):
        flaky_seen[prompt] = flaky_seen.get(prompt, 0) + 1
        if flaky_seen[prompt] < 3:
            raise ConnectionError("try again")
        return prompt.upper()

    rows = {r.id: (r.response, r.error) for r in P.complete(prompts, flaky, retries=2, wait=0.01, in_flight=4).collect()}
    assert all(rows[k] == (f"P{k}", None) for k in range(12)) and rows[12] == (None, None)
    rows = {r.id: r.error for r in P.complete(prompts, flaky, retries=1, wait=0.01).collect()}
    assert rows[3] == "ConnectionError: try again"

    def hanging(prompt):
        if prompt == "p4":
            time.sleep(60)
        return prompt

    began = time.perf_counter()
    rows = {r.id: (r.response, r.error) for r in P.complete(prompts, hanging, time_limit=1.0, in_flight=3).collect()}
    assert time.perf_counter() - began < 30 and rows[4] == (None, "TimeoutError: no response in 1.0 s") and rows[5] == ("p5", None)

    def slow(prompt):
        time.sleep(0.3)
        return prompt

    began = time.perf_counter()
    P.complete(prompts, slow, in_flight=12).collect()
    assert time.perf_counter() - began < 3

    def batch(texts):
        assert len(texts) <= 5
        if "p7" in texts:
            raise ValueError("bad prompt")
        return [t + "!" for t in texts]

    rows = {r.id: (r.response, r.error) for r in P.complete(prompts, batch, batch_size=5).collect()}
    assert rows[7] == (None, "ValueError: bad prompt") and rows[6] == ("p6!", None) and rows[11] == ("p11!", None) and rows[12] == (None, None)
    assert P.complete(prompts, lambda texts: texts[1:], batch_size=1).where(F.col("error").startswith("ValueError: 0 responses")).count() == 12
