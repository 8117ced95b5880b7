"""Mixing sources to target weights by hash-random prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import materialize, words


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], one_task: bool) -> DataFrame:
    """``rows`` with what comes before each in ``order``, added up: of all rows in one window, or in two levels.

    In two levels, rows are in ranges, written with their number; the ranges' own sums (a row each) are added up, and then the rows within a range.
    """
    before = lambda window: {name: F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for name, c in sums.items()}
    if one_task:
        return rows.withColumns(before(Window.orderBy(*order)))
    ranged = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "source-ranges")
    ranges = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = ranges.select("_range", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    placed = ranged.withColumns(before(Window.partitionBy("_range").orderBy(*order))).join(F.broadcast(offsets), "_range")
    return placed.select(*rows.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])


def _of_all(rows: DataFrame, sums: dict[str, Column], one_task: bool) -> dict[str, Column]:
    """Sums over all rows: windows, or numbers worked out first."""
    if one_task:
        return {name: F.coalesce(F.sum(c).over(Window.partitionBy()), F.lit(0)) for name, c in sums.items()}
    found = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()]).first()
    return {name: F.lit(found[name]) for name in sums}


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, one_task: bool = True) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code-point order, null last, weigh ``weights``, repeating, and share
    ``percent`` of the total. A target stops at ``most`` times its source's size;
    the excess is shared again until none is above. In closed form: by rising size
    per weight, a source is capped while the level that the rest would get reaches
    its cap. The table has a row per source; with ``one_task`` its running sums are plain windows, else they are in ranges.
    An empty table gives no rows.
    """
    by_source = [F.col("source").isNull(), F.col("source")]
    numbered = running_sums(sizes, by_source, {"number": F.lit(1).cast("long")}, one_task)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int")).cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_level = [F.col("cap") / F.col("weight"), *by_source]
    level = running_sums(weighed, by_level, {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, one_task)
    level = level.withColumns(_of_all(level, {"all_size": F.col("source_size"), "all_weight": F.col("weight")}, one_task))
    capped = level.withColumn("capped", F.lit(100) * F.col("cap") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.lit(percent) * F.col("all_size") - F.lit(100) * F.col("cap_before")))
    rest = capped.withColumns(_of_all(capped, {"cap_sum": F.when(F.col("capped"), F.col("cap")), "free_weight": F.when(~F.col("capped"), F.col("weight"))}, one_task))
    share = (F.col("weight") * (F.lit(percent) * F.col("all_size") - F.lit(100) * F.col("cap_sum"))).cast("double") / (F.lit(100) * F.nullif("free_weight", F.lit(0))).cast("double")
    return rest.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    percent: int = 150,
    most: int = 2,
    seed: str = "mix",
    bucket_rows: int = 4_096,
    one_task_sources: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: Column | None = None,
    carry: bool = False,
) -> DataFrame:
    """Words taken of each document: doc_id, source, size, source_size, target, taken, mix_key.

    With ``carry``, a column ``row`` holds all columns of ``docs`` too.

    Each document gets a random key, md5 of seed and id. Within a source, documents
    are put in key order; a document's prefix sum is what precedes it. Whole epochs
    are taken of all, and the rest of the source's budget cuts the order at the
    exact word. Prefix sums are in two levels: the key's leading digits make ranges
    of about ``bucket_rows`` rows of the largest source, whose sums are added up
    first, so a hot source is spread over all tasks. Beyond ``one_task_sources`` sources, these are ranked and added up in ranges too.

    Null text or text without words has size 0 and takes nothing; a null source is a
    source; a null id has a key of its own; repeated rows count each and tie in any order;
    an empty table gives no rows. Other columns are not read.
    """
    own = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"), (F.size(words(F.col(text_col))) if size is None else size).cast("long").alias("size")]
    measured = materialize(docs.select(*own), "sizes")
    sources = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    largest, n_sources = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    digits = 0
    while largest > bucket_rows * 16**digits:
        digits += 1
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    ranged = lambda rows: rows.withColumn("mix_key", key).withColumn("range", F.substring("mix_key", 1, digits) if digits else F.lit(""))
    keyed = ranged(docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))) if carry else ranged(measured)

    by_range = ["no_source", "source_key", "range"]  # keys without nulls: the window and the join share one shuffle
    ranges = ranged(measured).groupBy("source", *by_range).agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    targets = source_targets(sources.select("source", "source_size"), weights, percent, most, n_sources <= one_task_sources)
    offsets = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(*by_range, "range_before", "source_size", "target")

    within = Window.partitionBy(*by_range).orderBy("mix_key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("in_range", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(offsets, by_range)
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("range_before") - F.col("in_range")))
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"), "mix_key", *(["row"] if carry else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row once per epoch, and a document that the budget cuts is whole.

    So a source's words exceed its target by less than one document. Columns are those of ``docs``, whatever their names.
    Rows without words (null text too) are never taken; null ids and sources stay null; repeated rows are taken each; an empty table gives no rows.
    """
    mixed = mix_sources(docs, carry=True, **options).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), times)).alias("epoch")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
