"""The given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.text import PAGE_BREAK, let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """documents (those of the ids in ``of``, if given) as (doc_id, markdown): every third line gets a header of its first words, every seventh a small table, every fifth a page break."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    docs = docs.join(of, "doc_id", "left_semi") if of is not None else docs
    none = F.array().cast("array<string>")

    def made(x: Column, i: Column, ws: Column) -> Column:
        n = i + 1
        w = lambda k: F.coalesce(F.get(ws, F.lit(k)), F.lit(""))
        row = lambda *cells: F.concat(F.lit("|"), *[x for c in cells for x in (F.lit(" "), c, F.lit(" |"))])
        e = F.lit("")
        rows = F.array(row(w(0), w(1), w(1)), F.lit("|---|---|---|"), row(F.lit("1."), w(2), e), row(e, w(0), w(1), e), row(w(3), w(3)))
        head = F.array(F.concat(F.repeat(F.lit("#"), 1 + F.floor(n / 3).cast("int") % 3), F.lit(" "), F.array_join(F.slice(ws, 1, 3), " ")))
        return F.concat(F.when(n % 3 == 1, head).otherwise(none), F.when(n % 7 == 3, rows).otherwise(none), F.array(x), F.when(n % 5 == 0, F.array(F.lit(PAGE_BREAK))).otherwise(none))

    pieces = F.transform(F.split("text", "\n", -1), lambda x, i: let(F.split(x, " ", 5), lambda ws: made(x, i, ws)))
    again = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return docs.select("doc_id", F.array_join(F.flatten(pieces), "\n").alias("markdown"))
    each = docs.select("doc_id", F.posexplode(pieces).alias("n", "made"))  # the lines of an id's rows are put together
    return each.groupBy("doc_id").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "made"))), lambda p: p["made"])), "\n").alias("markdown"))
