"""The duplicate report reads its pages as they are stored, and doesn't make them from the documents for each of its parts."""

from docgraph.plans import registry


def test_pages_are_made_once(spark, tmp_path):
    spark.createDataFrame([(k, "\n".join(["same words here"] * 12)) for k in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    report = registry.QUERIES["d04_report"](spark, str(tmp_path))
    assert not any("documents.parquet" in f for f in report.inputFiles())
    assert {r.doc_id for r in report.collect()} == {0, 1, 2}
