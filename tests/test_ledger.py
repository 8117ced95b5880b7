"""Stored tables that change by batches, streams into them, and cascades of deletes."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from docgraph.plans import registry
from docgraph.sources import ledger, sinks
from docgraph.streaming import streams as Z

ROWS = "doc_id string, chunk_index int"


def held(spark, path):
    return sorted((r.doc_id, r.chunk_index) for r in spark.read.parquet(path).collect())


def files(path):
    return {os.path.join(at, f) for at, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_ledger" not in at}


def test_replaced_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), ROWS)
    assert ledger.replace_rows(rows(("a", 1), ("b", 2), (None, 7)), path, buckets=8, files=2)
    assert ledger.replace_rows(rows(("a", 9)), path, ids=rows(("b", 0), ("unknown", 0)))  # b is built again and gives nothing
    assert sorted((r.doc_id or "", r.chunk_index) for r in spark.read.parquet(path).collect()) == [("", 7), ("a", 9)]
    assert ledger.layout(spark, path) == (8, 2)  # as the first write has fixed it


def test_a_batch_counts_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        calls.add(1)
        return x

    rows = spark.createDataFrame([("a", 1), ("b", 2)], ROWS).withColumn("chunk_index", counted.asNondeterministic()("chunk_index"))
    assert ledger.replace_rows(rows, path, batch="one") and calls.value == 2  # the build runs once
    assert not ledger.replace_rows(spark.createDataFrame([("a", 5)], ROWS), path, batch="one")
    assert held(spark, path) == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("moved", [0, 1])
def test_stopped_between_write_and_swap(spark, tmp_path, monkeypatch, moved):
    path = str(tmp_path / "t")
    start = [(x, 0) for x in "abcdefgh"]
    ledger.replace_rows(spark.createDataFrame(start, ROWS), path, batch="0", buckets=4)
    move, left = ledger._move, [1 + moved]

    def stop(*args):
        if not left[0]:
            raise OSError("the driver is lost")
        left[0] -= 1
        move(*args)

    monkeypatch.setattr(ledger, "_move", stop)
    new, ids = spark.createDataFrame([("a", 1), ("b", 1)], ROWS), spark.createDataFrame([("c",), ("d",)], "doc_id string")
    with pytest.raises(OSError, match="lost"):
        ledger.replace_rows(new, path, ids=ids, batch="1")
    monkeypatch.undo()
    assert not ledger.replace_rows(new, path, ids=ids, batch="1")  # it held, and is put in place
    assert held(spark, path) == [("a", 1), ("b", 1), ("e", 0), ("f", 0), ("g", 0), ("h", 0)] and ledger.names(spark, f"{path}/_staged") == []
    monkeypatch.setattr(ledger, "_move", lambda *_: (_ for _ in ()).throw(OSError("lost before it held")))
    with pytest.raises(OSError, match="before"):
        ledger.replace_rows(spark.createDataFrame([("e", 4)], ROWS), path, batch="2")
    monkeypatch.undo()
    assert len(held(spark, path)) == 6
    assert ledger.replace_rows(spark.createDataFrame([("e", 4)], ROWS), path, batch="2") and ("e", 4) in held(spark, path)


def test_empty_buckets_go(spark, tmp_path):
    path = str(tmp_path / "t")
    ledger.replace_rows(spark.createDataFrame([("a", 1)], ROWS), path)
    ledger.replace_rows(spark.createDataFrame([], ROWS), path, ids=spark.createDataFrame([("a",)], "doc_id string"))
    assert not [n for n in ledger.names(spark, path) if n.startswith("bucket")]
    assert ledger.replace_rows(spark.createDataFrame([("z", 3)], ROWS), path) and held(spark, path) == [("z", 3)]


def test_cascade_over_five_tables(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("owners", "sessions", "messages", "chunks", "edges")}
    docs = [f"d{k}" for k in range(12)]
    ledger.replace_rows(spark.createDataFrame([("u", d) for d in docs], "user_id string, document_id string"), at["owners"], "document_id", buckets=16)
    ledger.replace_rows(spark.createDataFrame([(f"s{k}{d}", d) for d in docs for k in range(2)], "id string, document_id string"), at["sessions"], "document_id", buckets=16)
    ledger.replace_rows(spark.createDataFrame([(f"s{k}{d}", n) for d in docs for k in range(2) for n in range(3)], "session_id string, n int"), at["messages"], "session_id", buckets=16)
    for name in ("chunks", "edges"):
        ledger.replace_rows(spark.createDataFrame([(d, n) for d in docs for n in range(3)], ROWS), at[name], buckets=16)
    gone = spark.createDataFrame([("d3",), ("d7",), ("not there",)], "document_id string")
    tables = [ledger.Stored(at["messages"], "session_id", (at["sessions"], "document_id", "id")), ledger.Stored(at["sessions"]), ledger.Stored(at["owners"]), ledger.Stored(at["chunks"], "doc_id"), ledger.Stored(at["edges"], "doc_id"), ledger.Stored(str(tmp_path / "nothing"))]
    before = {n: files(p) for n, p in at.items()}
    ledger.delete_cascade(gone, tables, "del-1")
    counts = {n: spark.read.parquet(p).count() for n, p in at.items()}
    assert counts == {"owners": 10, "sessions": 20, "messages": 60, "chunks": 30, "edges": 30}
    assert not {r.session_id for r in spark.read.parquet(at["messages"]).collect()} & {f"s{k}d{n}" for k in range(2) for n in (3, 7)}
    for name, old in before.items():  # buckets without these documents keep their files
        touched = {f.split("bucket=")[1].split("/")[0] for f in old - files(at[name])}
        assert 1 <= len(touched) <= (2 if name != "messages" else 4) and old & files(at[name])
    after = {n: files(p) for n, p in at.items()}
    ledger.delete_cascade(gone, tables, "del-1")
    assert after == {n: files(p) for n, p in at.items()}


def test_documents_that_land_again(spark, tmp_path):
    source, out, calls = str(tmp_path / "in"), str(tmp_path / "out"), []
    schema = "doc_id long, markdown string"

    def build(batch):
        calls.append(1)
        return batch.select("doc_id", F.explode(F.filter(F.split("markdown", " "), lambda x: x != "")).alias("word"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        Z.build_documents(stream, build, out, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.doc_id, r.word) for r in spark.read.parquet(out).collect())

    spark.createDataFrame([(1, "one two"), (2, "three")], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == [(1, "one"), (1, "two"), (2, "three")]
    spark.createDataFrame([(1, "")], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == [(2, "three")] and len(calls) == 2
    assert run() == [(2, "three")] and len(calls) == 2


EVENTS = "event_id long, ts timestamp, phase string, step string, document_id long, input_tokens long, output_tokens long, embedding_tokens long"


def event(k, day, hour=10, document=1):
    return (k, datetime.datetime(2026, 1, day, hour), "p", "s", document, 1, 2, 3)


def land(spark, path, *rows):
    spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_late_events_in_three_batches(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        events = spark.readStream.schema(spark.createDataFrame([], EVENTS).schema).parquet(source)
        Z.write_closed(Z.daily_rollup(events), out, cp).awaitTermination()
        return sorted((str(r.day), r.events, r.input_tokens) for r in spark.read.parquet(out).collect())

    land(spark, source, *(event(k, 1 + k // 4) for k in range(16)))  # four a day; the watermark is a day behind the 4th
    assert run() == [("2026-01-01", 4, 4), ("2026-01-02", 4, 4)]
    land(spark, source, event(90, 1), event(91, 3, 11), event(92, 6))  # the first is too late; the second isn't, its day is open
    assert run() == [("2026-01-01", 4, 4), ("2026-01-02", 4, 4), ("2026-01-03", 5, 5), ("2026-01-04", 4, 4)]
    land(spark, source, event(93, 2), event(94, 9))
    assert run()[-1] == ("2026-01-06", 1, 1) and len(run()) == 5
    state = spark.read.format("statestore").load(cp)
    assert state.count() == 1  # only the last day is still held


def test_latest_events_in_three_batches(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        Z.write_latest(spark.readStream.schema(spark.createDataFrame([], EVENTS).schema).parquet(source), out, cp).awaitTermination()
        return {r.document_id: r.event_id for r in spark.read.parquet(out).collect()}

    land(spark, source, *(event(k, 5, k, document=k % 7) for k in range(20)))
    assert run() == {k: max(e for e in range(20) if e % 7 == k) for k in range(7)}
    before = files(out)
    land(spark, source, event(50, 1, document=3), event(51, 6, document=4), event(52, 6, document=4), event(53, 5, 19, document=5))
    assert run() == {0: 14, 1: 15, 2: 16, 3: 17, 4: 52, 5: 53, 6: 13}  # of equal times the higher number
    assert len(before - files(out)) == len({f.split("bucket=")[1].split("/")[0] for f in before - files(out)}) <= 2
    land(spark, source, event(60, 2, document=9))
    assert run()[9] == 60


def test_stream_queries_are_stored(spark, tmp_path):
    events = spark.createDataFrame([(k, f"2026-01-0{1 + k // 40} 10:00:00", k % 30, "view", float(k)) for k in range(120)], "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("props", F.lit("{}")).write.parquet(f"{tmp_path}/events.parquet")
    for name, rows in (("z03_latest_events", 30), ("z01_daily_rollup", 1)):
        out = registry.QUERIES[name](spark, str(tmp_path))
        assert out.count() == rows and out.inputFiles()  # read from files, not from a table in the driver's memory
    latest = registry.QUERIES["z03_latest_events"](spark, str(tmp_path))
    assert {(r.document_id, r.event_id) for r in latest.collect()} == {(k, 90 + k) for k in range(30)}


def test_writes_by_document_keep_their_layout(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_by_document(spark.createDataFrame([("a", 1), ("b", 2)], ROWS), path, buckets=4)
    sinks.write_by_document(spark.createDataFrame([("a", 3)], ROWS), path, buckets=128)
    assert ("a", 3) in held(spark, path) and ("a", 1) not in held(spark, path) and ledger.layout(spark, path) == (4, 1)
