"""Token counts: an exact length histogram and its suffix sums."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import slices, small_batches

_ENCODINGS: dict[str, object] = {}


def rank_encoding(path: str):
    """A byte-pair encoding of a rank file without special tokens; one per worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One column ``n_tokens``: the length of each whole text under the encoding at ``path``; null and empty texts have 0.

    A row per row of ``docs``, repeated ones too; texts are encoded whole, however long; an empty table gives no rows. Other columns, whatever their
    names, are not read."""

    small_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(measure, "n_tokens long")


def length_histogram(lengths: DataFrame, band: int = 256) -> DataFrame:
    """For each length that occurs, as a context limit, what the whole corpus gives: exact, one row per length.

    Columns: n_tokens (the length, and the limit), n_docs of that length, docs_longer, tokens_longer
    (what those hold), total_tokens and total_docs, truncated_tokens (each document cut at the limit),
    docs_at_most, and quantile (the share of documents of at most that length).

    Documents are counted by length first, with map-side partial counts. Suffix sums over the histogram are
    in two levels, bands of ``band`` lengths and lengths in a band, so no task holds all lengths. Documents of equal length, and so
    repeated rows, are counted each; null lengths are not; other columns are not read. For a limit
    between two lengths see ``at_limits``. An empty table gives no rows.
    """
    histogram = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("band", F.floor(F.col("n_tokens") / band))
    bands = histogram.groupBy("band").agg(F.sum("n_docs").alias("band_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("band_tokens"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bands = bands.select(
        "band",
        *[F.coalesce(F.sum(f"band_{x}").over(above), F.lit(0)).alias(f"{x}_above") for x in ("docs", "tokens")],
        *[F.sum(f"band_{x}").over(every).alias(f"total_{x}") for x in ("docs", "tokens")],
    )
    within = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    own = histogram.withColumns({"docs_in": F.coalesce(F.sum("n_docs").over(within), F.lit(0)), "tokens_in": F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(within), F.lit(0))})
    longer = own.join(bands, "band").withColumns({"docs_longer": F.col("docs_in") + F.col("docs_above"), "tokens_longer": F.col("tokens_in") + F.col("tokens_above")})
    return longer.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_tokens"),
        (F.col("total_docs") - F.col("docs_longer")).alias("docs_at_most"),
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens, docs_longer) of any limits, from the result of ``length_histogram``.

    What is longer than a limit is what is longer than the largest length of at most the limit; a limit below all lengths cuts every document.
    """
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    found = histogram.join(F.broadcast(asked), F.col("n_tokens") <= F.col("context_limit")).groupBy("context_limit").agg(F.max_by(F.struct("docs_longer", "tokens_longer"), "n_tokens").alias("at"))
    totals = histogram.agg(F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"))
    joined = asked.join(F.broadcast(totals)).join(found, "context_limit", "left")
    docs, tokens = F.coalesce("at.docs_longer", "total_docs", F.lit(0)), F.coalesce("at.tokens_longer", "total_tokens", F.lit(0))
    return joined.select("context_limit", (F.coalesce("total_tokens", F.lit(0)) - tokens + docs * F.col("context_limit")).alias("truncated_tokens"), docs.alias("docs_longer"))


def length_at_quantile(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of documents doesn't exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return histogram.join(F.broadcast(asked), F.col("docs_at_most") >= F.col("share") * F.col("total_docs")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
