"""Language identification by Bayesian evidence fusion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import array_slices, free_name, materialize, slices, small_batches

#: Hash buckets of byte trigrams.
BUCKETS = 1 << 16
#: The class of texts in none of a model's languages.
OTHER = "other"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram of lower-cased letters, row of each); what isn't a letter counts as one blank."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if len(raw) < 3:
        return np.empty(0, dtype=np.intp), np.empty(0, dtype=np.intp)
    c = _LOWER[raw]
    letter = _LETTER[c]
    c = np.where(letter, c, np.uint32(32))
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keep = (row[:-2] == row[2:]) & letter[1:-1]
    bucket = ((code[keep] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.intp)
    return bucket, row[:-2][keep]


@dataclass(frozen=True)
class LanguageModel:
    """Log probability of each trigram bucket in each language."""

    languages: list[str]
    log_p: np.ndarray  # bucket, language
    own: np.ndarray | None = None  # language: mean log likelihood of its training text; None: not known, so no text is foreign

    def foreign(self, share: float) -> np.ndarray:
        """Mean log likelihood below which a text isn't in the language: ``share`` of the way from its own text's to that of uniform trigrams."""
        if self.own is None:
            return np.full(len(self.languages), -np.inf)
        return self.own + share * (-np.log(BUCKETS) - self.own)

    def mean_log_likelihood(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(mean log likelihood of a text's trigrams by language, number of trigrams)."""
        bucket, row = _trigrams(texts)
        n = np.bincount(row, minlength=len(texts))
        sums = np.stack([np.bincount(row, weights=self.log_p[bucket, k], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        return sums / np.maximum(n, 1)[:, None], n


def train_language_model(docs: DataFrame, most_rows: int = 1500, smooth: float = 0.5, text_col: str = "text", lang_col: str = "lang", most_languages: int = 200) -> LanguageModel:
    """Trigram frequencies of about ``most_rows`` rows of each declared language, chosen by a hash of the text.

    Declarations are read as in ``identify_language``: letters up to the first other character, in lower case, so ``en-US`` and ``EN`` are one.
    The bounds are parameters, so what comes to the driver (a bucket count per language) doesn't
    grow with the corpus. There are fewer languages with a code of two letters than ``most_languages``; if there are more declarations than
    that, the commonest are learned, and texts in others are in the class ``OTHER``. Null texts and languages take no part; equal texts are chosen
    together, and count as often as they come. An empty table gives a model of one language, ``und``.
    """
    small_batches(docs.sparkSession)
    usable = docs.select(F.col(text_col).alias("text"), _code(F.col(lang_col)).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    there = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    languages = sorted(there)
    if not languages:
        return LanguageModel(["und"], np.zeros((BUCKETS, 1)))
    odds = F.lit(0.0)
    for name, n in there.items():
        odds = F.when(F.col("lang") == name, F.lit(min(1.0, most_rows / n))).otherwise(odds)
    chosen = usable.where(F.pmod(F.xxhash64("text", F.lit(23)), F.lit(1 << 20)) < odds * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS))
        for whole in batches:
            for batch in slices(whole, "text"):
                bucket, row = _trigrams(batch.column(0))
                lang = np.searchsorted(languages, batch.column(1).to_numpy(zero_copy_only=False))
                counts += np.bincount(lang[row] * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts.ravel()[at])], names=["cell", "n"])

    found = chosen.mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape(len(languages), BUCKETS)
    log_p = np.log((counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True))
    seen = counts.sum(axis=1)
    own = np.where(seen > 0, (counts * log_p).sum(axis=1) / np.maximum(seen, 1), -np.inf)
    return LanguageModel(languages, log_p.T.copy(), own)


def identify_language(
    docs: DataFrame,
    model: LanguageModel,
    text: Column,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    trust_declared: float = 0.9,
    trust_suffix: float = 0.8,
    host_rows: float = 20.0,
    suffix_rows: float = 20.0,
    sharpness: float = 60.0,
    least: float = 0.5,
    foreign_share: float = 0.6,
    other_prior: float = 0.01,
    broadcast_hosts: int = 100_000,
) -> DataFrame:
    """``docs`` with one column ``language``: struct(lang, posterior, text_lang, kept).

    log posterior = text + declared language + address suffix + host prior.
    Text: mean log likelihood of the trigrams times at most ``sharpness``, so that a long
    text isn't trusted without bound. A declared language is right with
    ``trust_declared``, and so is a suffix that names a language. The prior of a row is its host's
    share of each language by text, smoothed by ``host_rows`` rows of its suffix's shares, and these by ``suffix_rows`` rows
    of the shares of all: grouped aggregates of one vote per row, of which the row's own is taken back, so no text counts twice. Values that are no
    known language (regions cut off, case ignored) are no evidence. The votes are broadcast up to
    ``broadcast_hosts`` hosts, so texts aren't shuffled; beyond, they are joined by a shuffle.

    A text in none of the model's languages is in the class ``OTHER``. The evidence for it is how far the text's trigrams, each in the
    language that has it most, lie below a floor: ``foreign_share`` of the way from the mean log likelihood of the best
    language's own training text to that of uniform trigrams. Its prior is ``other_prior``.

    A row is kept if its best class is a language, with a posterior of at least ``least``, and its text has letters. Null or
    letterless texts have no text evidence and aren't kept; without any evidence at all lang is the commonest language. Null hosts and suffixes are
    groups of their own. Repeated rows are a row and a vote each; ties between languages go to the later in code-point order; long texts are read whole. An empty
    table gives no rows. A column named ``language`` in ``docs`` stays, and the result gets underscores before its name.
    """
    languages, n = model.languages, len(model.languages)
    floor = model.foreign(foreign_share)
    # a text of two known languages is in neither, but not foreign: each trigram counts by the language that has it most
    measured = LanguageModel([*languages, OTHER], np.append(model.log_p, model.log_p.max(axis=1, keepdims=True), axis=1))
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<text_part:array<double>,top:int>")
    def likelihoods(texts: pa.Array) -> pa.Array:
        parts, tops = [np.empty((0, n + 1))], [np.empty(0, dtype=np.int64)]
        for part in array_slices(texts):
            mean, count = measured.mean_log_likelihood(part)
            top = mean[:, :n].argmax(axis=1)
            foreign = floor[top] - mean[:, n]
            both = np.append(mean[:, :n] - mean[:, :n].max(axis=1, keepdims=True), foreign[:, None], axis=1)
            parts.append(np.where(count > 0, np.minimum(count, sharpness), 0)[:, None] * np.maximum(both, -1e6))
            tops.append(np.where(count > 0, np.where(foreign > 0, n, top), -1))
        return pa.StructArray.from_arrays([pa.array(list(np.concatenate(parts)), pa.list_(pa.float64())), pa.array(np.concatenate(tops), pa.int32())], names=["text_part", "top"])

    likelihoods = likelihoods.asNondeterministic()  # else a filter on its result evaluates it once more, in workers of its own
    null = F.lit(None).cast("string")
    evidence_of = [
        likelihoods(text.cast("string")).alias("seen"),
        _known(declared if declared is not None else null, languages).alias("declared"),
        F.lower(suffix if suffix is not None else null).alias("suffix"),
        F.lower(host if host is not None else null).alias("host"),
    ]
    votes = docs.select(*evidence_of).select("suffix", "host", F.col("seen.top").alias("top")).where(F.col("top").between(0, n - 1)).groupBy("suffix", "host", "top").agg(F.count("*").alias("n"))
    priors = materialize(_host_votes(votes, n), "host-votes")
    if priors.count() <= broadcast_hosts:
        priors = F.broadcast(priors)

    keep = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"), *evidence_of).select("own", "declared", "suffix", "host", "seen.*")
    rows = rows.alias("d").join(priors.alias("p"), F.col("d.suffix").eqNullSafe(F.col("p.suffix")) & F.col("d.host").eqNullSafe(F.col("p.host")), "left")
    by_suffix = _known(F.col("d.suffix"), languages)
    voted = F.when(F.col("top").between(0, n - 1), 1.0).otherwise(0.0)

    def log_prior(k: int) -> Column:
        own = F.when(F.col("top") == k, 1.0).otherwise(0.0)
        at = lambda counts, less: (F.get(counts, F.lit(k)) - own, F.get(counts, F.lit(n)) - less)  # noqa: E731  count and total
        (host_n, host_all), (suffix_n, suffix_all) = at("host_votes", voted), at("suffix_votes", voted)
        by_suffix_rows = (suffix_n + suffix_rows * F.get("all_shares", F.lit(k))) / (suffix_all + suffix_rows)
        return F.coalesce(F.log((host_n + host_rows * by_suffix_rows) / (host_all + host_rows)), F.lit(-float(np.log(n))))

    terms = []
    for k, name in enumerate([*languages, OTHER]):
        prior = F.lit(float(np.log(other_prior))) if k == n else log_prior(k)
        evidence = F.get("text_part", F.lit(k)) + prior
        for said, trust in ((F.col("declared"), trust_declared), (by_suffix, trust_suffix)):
            other = (1 - trust) / max(1, n - 1)
            evidence = evidence + F.when(said.isNull() | F.lit(n == 1), 0.0).when(F.lit(k < n) & (said == name), float(np.log(trust))).otherwise(float(np.log(max(other, 1e-9))))
        terms.append(F.struct(evidence.alias("e"), F.lit(name).alias("lang"), F.lit(k < n).alias("known")))
    judged = rows.withColumn("terms", F.array(*terms)).withColumn("best", F.array_max("terms"))
    total = F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.exp(t["e"] - F.col("best.e")))
    posterior = 1 / total
    text_lang = F.when(F.col("top") >= 0, F.get(F.array(*map(F.lit, [*languages, OTHER])), F.col("top")))
    result = F.struct(F.col("best.lang").alias("lang"), posterior.alias("posterior"), text_lang.alias("text_lang"), ((posterior >= least) & F.col("best.known") & (F.col("top") >= 0)).alias("kept"))
    return judged.select(*[F.col("own").getField(c).alias(c) for c in keep], result.alias(free_name(docs, "language")))


def _code(value: Column) -> Column:
    """The language of a declaration: its first letters, in lower case; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), "^([A-Za-z]+)", 1)), F.lit(""))


def _known(value: Column, languages: list[str]) -> Column:
    return F.when(_code(value).isin(*languages), _code(value))


def _host_votes(votes: DataFrame, n: int) -> DataFrame:
    """(suffix, host, host_votes, suffix_votes, all_shares) of vote counts (suffix, host, top, n): votes by language with their total last, shares by language."""
    count = lambda k: F.sum(F.when(F.col("top") == k, F.col("n")).otherwise(0)).cast("double")
    hosts = votes.groupBy("suffix", "host").agg(F.array(*map(count, range(n)), F.sum("n").cast("double")).alias("host_votes"))
    add = lambda c: F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(n + 1)))
    suffixes = hosts.groupBy("suffix").agg(add("host_votes").alias("suffix_votes"))
    everything = suffixes.agg(add("suffix_votes").alias("v")).select(F.array(*((F.get("v", F.lit(k)) + 1 / n) / (F.get("v", F.lit(n)) + 1) for k in range(n))).alias("all_shares"))
    joined = hosts.alias("h").join(suffixes.alias("s"), F.col("h.suffix").eqNullSafe(F.col("s.suffix"))).join(F.broadcast(everything))
    return joined.select("h.suffix", "h.host", "host_votes", "suffix_votes", "all_shares")
