"""Costs of usage against their SQL, most of all where they lie next to a half of the last digit."""

import pytest

from docgraph.operators import usage as U
from docgraph.plans import registry

EVENTS = "event_id long, ts string, user_id long, event_type string, value double, props string"


def made(spark, folder, values):
    """Each value as an event of every remainder by 12."""
    rows = [(12 * k + r, "2026-01-01 10:00:00", r, "view", v, "{}") for k, v in enumerate(values) for r in range(12)]
    spark.createDataFrame(rows, EVENTS).selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    return {r.event_id: (r.cost, r.n) for r in registry.QUERIES["u02_price"](spark, str(folder)).collect()}


def test_cost_is_rounded_once(spark, tmp_path):
    rows = made(spark, tmp_path, [300.0, 100.0, None, -3.0, 700.9])
    assert [rows[k] for k in (1, 3, 4)] == [(0.00013, 2), (0.00025, 3), (None, 0)]  # 0.00013499999999999997 USD
    assert rows[13] == (0.00005, 2)  # 4.4999999999999996e-05 USD, a half once it is scaled
    assert rows[25] == (None, 2) and rows[27] == (None, 3) and rows[28] == (None, 0)
    assert rows[49] == (0.00031, 2)


def test_cost_is_that_of_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = made(spark, tmp_path, [None, *[float(v) for v in range(-2500, 2500)]])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert {k: (cost, n) for k, cost, n in db.execute(registry.SQL["u02_price"]).fetchall()} == rows


def test_components_add_up_as_in_the_reference(spark):
    one = "provider string, embedding_model string, llm_model string, input_tokens long, output_tokens long, embedding_tokens long"
    tokens = [(7, 3, 21), (1700, 850, 5100), (123457, 61728, 370371), (2, None, 6), (None, None, None)]
    events = spark.createDataFrame([("openai", "text-embedding-3-large", "gpt-4o-mini", *t) for t in tokens], one)
    rows = U.price(events, U.price_table(spark)).withColumn("usd", U.total_usd(U.F.col("components"))).collect()
    for (given, answered, embedded), r in zip(tokens[:3], rows):
        assert r.usd == embedded * (0.13 / 1_000_000) + (given * (0.15 / 1_000_000) + answered * (0.60 / 1_000_000)) and r.cost_estimate_usd == round(r.usd, 8)
    assert rows[3].cost_estimate_usd == 0.00000108 and rows[3].components["llm_output_usd"] is None
    assert (rows[4].usd, rows[4].cost_estimate_usd, rows[4].cost_display, len(rows[4].components)) == (None, None, "N.A", 3)
