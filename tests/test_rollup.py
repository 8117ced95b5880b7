"""The daily rollup of a stream: every day counts, open ones and late events too."""

import datetime

from pyspark.sql import functions as F

from docgraph.plans import registry
from docgraph.streaming import streams as Z

EVENTS = "event_id long, ts timestamp, phase string, step string, document_id long, input_tokens long, output_tokens long, embedding_tokens long"


def test_rollup_keeps_open_days_and_late_events(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run(*days):
        rows = [(k, datetime.datetime(2026, 1, day, 10), "p", "s", 1, 1, 2, 3) for k, day in enumerate(days)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        Z.write_rollup(Z.daily_rollup(spark.readStream.schema(EVENTS).parquet(source)), out, cp).awaitTermination()
        return sorted((r.day.day, r.events, r.embedding_tokens) for r in spark.read.parquet(out).collect())

    assert run(1, 1, 2, 3) == [(1, 2, 6), (2, 1, 3), (3, 1, 3)]
    assert run(9, 1) == [(1, 3, 9), (2, 1, 3), (3, 1, 3), (9, 1, 3)]  # the 1st is eight days late


def test_registered_rollup_gives_all_days(spark, tmp_path):
    events = spark.createDataFrame([(k, f"2026-01-0{1 + k // 40} 10:00:00", k % 30, "view", float(k)) for k in range(120)], "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("props", F.lit("{}")).write.parquet(f"{tmp_path}/events.parquet")
    out = registry.QUERIES["z01_daily_rollup"](spark, str(tmp_path))
    assert sorted((str(r.day), r.events, r.input_tokens) for r in out.collect()) == [(f"2026-01-0{d + 1}", 40, sum(range(40 * d, 40 * d + 40))) for d in range(3)]
    assert "HAVING" not in registry.SQL["z01_daily_rollup"]
