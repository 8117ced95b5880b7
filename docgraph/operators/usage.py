"""Token usage and cost.

events: ts, step, phase, document_id, input_tokens, output_tokens, embedding_tokens and more; see ``schemas``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: USD per million tokens of billed models; what isn't listed isn't billed.
PRICES = {("openai", "text-embedding-3-large"): {"embedding": 0.13}, ("openai", "gpt-4o-mini"): {"input": 0.15, "output": 0.60}}
PIPELINE_STEPS = ("pdf_upload", "pdf_processing", "vectorization")
KINDS = ("input_tokens", "output_tokens", "embedding_tokens")


def price_table(spark) -> DataFrame:
    """provider, model, kind, usd_per_million: a handful of rows."""
    rows = [(p, m, kind, usd) for (p, m), kinds in PRICES.items() for kind, usd in kinds.items()]
    return spark.createDataFrame(rows, "provider string, model string, kind string, usd_per_million double")


def total_usd(components: Column) -> Column:
    """What the components of a price add up to, unrounded: embeddings and the sum of the other two; null where there are none."""
    embeddings, given, made = (F.try_element_at(components, F.lit(name)) for name in ("embeddings_usd", "llm_input_usd", "llm_output_usd"))
    usd = lambda c: F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(embeddings, given, made).isNotNull(), usd(embeddings) + (usd(given) + usd(made)))


def price(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds components (map of USD of what is billed, null where its tokens are), cost_estimate_usd (8 digits, null where nothing is billed) and cost_display, by provider, embedding_model and llm_model.

    The price table is one broadcast row: a map from provider, model and kind.
    """
    book = F.broadcast(prices.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "provider", "model", "kind"), F.col("usd_per_million") / 1_000_000))).alias("book")))
    rate = lambda model, kind: F.try_element_at("book", F.concat_ws("|", "provider", model, F.lit(kind)))
    parts = [("embeddings_usd", "embedding_tokens", rate("embedding_model", "embedding")), ("llm_input_usd", "input_tokens", rate("llm_model", "input")), ("llm_output_usd", "output_tokens", rate("llm_model", "output"))]
    billed = F.array_compact(F.array(*[F.when(usd.isNotNull(), F.struct(F.lit(n).alias("key"), (F.col(tokens) * usd).alias("value"))) for n, tokens, usd in parts]))
    made = events.crossJoin(book).withColumn("components", F.map_from_entries(billed))
    cost = total_usd(F.col("components"))
    return made.withColumns({"cost_estimate_usd": F.round(cost, 8), "cost_display": F.coalesce(F.when(cost.isNotNull(), F.format_string("%.6f", cost)), F.lit("N.A"))}).drop("book")


def enrich(events: DataFrame, prices: DataFrame, default_model: str = "unknown") -> DataFrame:
    """Adds total_tokens and pricing, and a model label where none is given."""
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("embedding_tokens")
    return price(events, prices).withColumns({"total_tokens": total, "model": F.coalesce("model", F.lit(default_model))})


def query_totals(steps: DataFrame, key: str = "query_id") -> DataFrame:
    """A query's steps and one ``query_total`` event that sums them."""
    sums = steps.groupBy(key).agg(*[F.sum(k).alias(k) for k in KINDS], F.count("*").alias("sub_steps")).withColumn("step", F.lit("query_total"))
    return steps.select(key, "step", *KINDS).withColumn("sub_steps", F.lit(None).cast("long")).unionByName(sums.select(key, "step", *KINDS, "sub_steps"))


def daily_summary(events: DataFrame, exclude_totals: bool = False) -> DataFrame:
    """date, phase, step, tokens of each kind, total and events: totals of the day, by phase and by step, in one pass of grouping sets.

    ``level`` tells them apart. Query totals repeat their steps and are counted too, unless ``exclude_totals``.
    """
    rows = events.where("step != 'query_total'") if exclude_totals else events
    rows = rows.select(F.to_date("ts").alias("date"), F.coalesce("phase", F.lit("unknown")).alias("phase"), F.coalesce("step", F.lit("unknown")).alias("step"), *KINDS)
    sets = rows.groupingSets([[F.col("date")], [F.col("date"), F.col("phase")], [F.col("date"), F.col("step")]], "date", "phase", "step")
    out = sets.agg(*[F.sum(k).alias(k) for k in KINDS], F.count("*").alias("events"), F.grouping("phase").alias("gp"), F.grouping("step").alias("gs"))
    level = F.when((F.col("gp") == 1) & (F.col("gs") == 1), "day").when(F.col("gs") == 1, "phase").otherwise("step")
    return out.select("date", level.alias("level"), "phase", "step", *KINDS, (F.col("input_tokens") + F.col("output_tokens") + F.col("embedding_tokens")).alias("total_tokens"), "events")


def pipeline_timeline(events: DataFrame, steps: tuple[str, ...] = PIPELINE_STEPS) -> DataFrame:
    """The events of a document's build, with their place by time."""
    from pyspark.sql import Window

    return events.where(F.col("step").isin(*steps)).withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("ts", "event_id")))


def pipeline_totals(events: DataFrame, steps: tuple[str, ...] = PIPELINE_STEPS) -> DataFrame:
    """document_id, tokens, cost (nulls ignored), first and last time, seconds between (0 at least)."""
    own = events.where(F.col("step").isin(*steps))
    out = own.groupBy("document_id").agg(*[F.sum(k).alias(k) for k in KINDS], F.round(F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)), 8).alias("cost_estimate_usd"), F.min("ts").alias("pipeline_start"), F.max("ts").alias("pipeline_end"))
    seconds = F.unix_micros(F.col("pipeline_end").cast("timestamp")) - F.unix_micros(F.col("pipeline_start").cast("timestamp"))
    return out.withColumn("pipeline_seconds", F.greatest(F.lit(0.0), seconds / 1e6))


def latest_by_document(events: DataFrame, step: str = "vectorization") -> DataFrame:
    """document_id and its last event of a step: event_id, ts, tokens."""
    row = F.struct("event_id", "ts", *KINDS)
    return events.where(F.col("step") == step).groupBy("document_id").agg(F.max_by(row, F.struct("ts", "event_id")).alias("e")).select("document_id", "e.*")


def flat_vectorization(events: DataFrame) -> DataFrame:
    """The measures of build events out of their ``extra`` struct."""
    own = events.where("step = 'vectorization'")
    return own.select("document_id", "ts", "embedding_tokens", "cost_estimate_usd", *[F.col(f"extra.{c}").alias(c) for c in ("total_pages", "total_words", "total_chunks", "total_tokens", "duration_seconds")])


def listing_with_total(queries: DataFrame, where: Column | None = None) -> DataFrame:
    """id, document_id, tokens, cost; the grand total is the row whose id is null, by rollup."""
    rows = queries.where(where) if where is not None else queries
    return rows.rollup("id", "document_id").agg(F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("cost_estimate_usd"), 8).alias("cost_estimate_usd"), F.grouping_id().alias("g")).where("g IN (0, 3)").drop("g")


def run_facts(docs: DataFrame, pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """document_id, total_words, total_pages, total_tokens of a build."""
    from docgraph.functions.text import word_count

    return docs.select("document_id", word_count(F.col("text")).alias("total_words")).join(pages, "document_id", "left").join(tokens, "document_id", "left")


def run_header(events: DataFrame) -> DataFrame:
    """document_id and the first event of each build step, with pages of processing, else of vectorization, and the file's size in MB."""
    first = lambda step: F.min_by(F.when(F.col("step") == step, F.struct("ts", "extra")), F.when(F.col("step") == step, F.col("ts")))
    out = events.groupBy("document_id").agg(*[first(s).alias(s) for s in PIPELINE_STEPS])
    return out.select(
        "document_id", F.col("pdf_upload.ts").alias("uploaded_at"), F.col("pdf_processing.ts").alias("processed_at"), F.col("vectorization.ts").alias("vectorized_at"),
        F.coalesce("pdf_processing.extra.total_pages", "vectorization.extra.total_pages").alias("total_pages"), F.col("pdf_upload.extra.filename").alias("filename"), F.round(F.col("pdf_upload.extra.file_size_bytes") / 1048576, 2).alias("file_mb"),
    )
