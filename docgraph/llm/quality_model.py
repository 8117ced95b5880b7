"""Quality classifier: Bradley-Terry pairwise ranking."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import array_slices, drop, free_name, materialize, slices, small_batches
from docgraph.llm.shingles import word_hashes

#: Character classes whose shares of a text are features.
_CLASSES = [b"#*$%&<>@^~=+", b"|", b"!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"?", b"()[]{}", b"-_/\\", b"\"'`", b"\n"]
_CLASS_OF = np.zeros(256, dtype=np.intp)
for _k, _chars in enumerate(_CLASSES, 1):
    _CLASS_OF[list(_chars)] = _k
_CLASS_OF[[9, 11, 12, 13, 32]] = len(_CLASSES) + 1
_CLASS_OF[128:] = len(_CLASSES) + 2
_N_CLASSES = len(_CLASSES) + 3
#: Buckets of hashed words, and how much more their weights are held down than those of the other features.
WORD_BUCKETS = 128
WORD_RIDGE = 50.0


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of bounded features per text, of the text alone; null counts as empty.

    Shares of character classes, square-rooted so that small shares show; how often a word
    equals the one before or the one before that; how many words are distinct; word and text
    length; and what the words are, as shares of hash buckets. Shares are smoothed by a few neutral words, so that very short texts say little.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    hashes, rows = word_hashes(texts)
    n_words = np.diff(rows).astype(np.float64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    n_bytes = np.diff(bounds).astype(np.float64)
    counts = np.zeros((len(texts), _N_CLASSES))
    distinct = np.zeros(len(texts))
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b > a:
            counts[k] = np.bincount(_CLASS_OF[raw[a:b]], minlength=_N_CLASSES)
            distinct[k] = len(np.unique(hashes[rows[k] : rows[k + 1]]))
    doc = np.repeat(np.arange(len(texts)), np.diff(rows))
    again = [np.bincount(doc[step:], weights=(hashes[step:] == hashes[:-step]) & (doc[step:] == doc[:-step]), minlength=len(texts)) if len(hashes) > step else np.zeros(len(texts)) for step in (1, 2)]
    shares = np.sqrt(counts / (n_bytes + 30)[:, None])
    repeats = np.sqrt(np.stack(again, axis=1) / (n_words + 8)[:, None])
    rest = np.stack([(distinct + 8) / (n_words + 8), n_bytes / (n_words + 1) / 10, np.log1p(n_words) / 10, np.log1p(n_words) * (distinct + 8) / (n_words + 8) / 10], axis=1)
    buckets = np.bincount(doc * WORD_BUCKETS + (hashes >> np.uint64(57)).astype(np.int64), minlength=len(texts) * WORD_BUCKETS).reshape(len(texts), WORD_BUCKETS)
    return np.hstack([shares, repeats, np.minimum(rest, 4), np.sqrt(buckets / (n_words + 8)[:, None])])


@dataclass(frozen=True)
class PairwiseModel:
    """Weights of a linear score, and the line that makes it a number from 0 to 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(features) - self.threshold), -30, 30)))


def fit_bradley_terry(features: np.ndarray, labels: np.ndarray, pairs: int = 20_000, seed: int = 0, ridge: float = 1e-3, rounds: int = 25) -> PairwiseModel:
    """Learn from pairs of a preferred and another text that P(preferred wins) = sigmoid(score difference).

    That is a logistic loss on feature differences without an intercept, minimized by
    Newton steps. The threshold is the quantile of the training scores that parts the
    labels best, halfway between its neighbours. With one label only, every text gets that label.
    """
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    width = features.shape[1]
    held = _held(width, ridge)
    if not len(good) or not len(bad):
        return PairwiseModel(np.zeros(width), np.ones(width), np.zeros(width), 1.0 if len(bad) else -1.0, 1.0)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = (features - mean) / scale
    rng = np.random.default_rng(seed)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(rounds):
        lose = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = held * w - d.T @ lose / pairs
        hessian = (d * (lose * (1 - lose))[:, None]).T @ d / pairs + np.diag(held)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = x @ w
    order = np.argsort(raw, kind="stable")
    ranked, wins = raw[order], labels[order] == 1
    # at cut k, the k lowest are called bad
    right = np.concatenate([[0], np.cumsum(~wins)]) / len(bad) + (len(good) - np.concatenate([[0], np.cumsum(wins)])) / len(good)
    inner = np.flatnonzero(np.diff(ranked) > 0) + 1
    cut = int(inner[np.argmax(right[inner])]) if len(inner) else len(ranked)
    threshold = float((ranked[cut - 1] + ranked[min(cut, len(ranked) - 1)]) / 2)
    return PairwiseModel(mean, scale, w, threshold, float(4 / max(1e-6, np.median(np.abs(raw - threshold)))))


def held_out(doc_id: Column) -> Column:
    """Rows that no model is fitted on: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def group_sums(x: np.ndarray, good: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, gradient and Hessian of the loss over all pairs of a good and a bad row of a group, in one vector; no difference is made."""
    a, b = x[good], x[~good]
    lose = 1 / (1 + np.exp(np.clip((a @ w)[:, None] - (b @ w)[None, :], -30, 30)))
    bend = lose * (1 - lose)
    cross = a.T @ (bend @ b)
    hessian = (a * bend.sum(axis=1)[:, None]).T @ a + (b * bend.sum(axis=0)[:, None]).T @ b - cross - cross.T
    return np.concatenate([[lose.size], b.T @ lose.sum(axis=0) - a.T @ lose.sum(axis=1), hessian.ravel()])


def _held(width: int, ridge: float) -> np.ndarray:
    """How much each weight is held down."""
    held = np.full(width, ridge)
    held[-WORD_BUCKETS:] *= WORD_RIDGE if width > WORD_BUCKETS else 1
    return held


def fit_groups(grouped: DataFrame, width: int, ridge: float = 1e-3, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a Bradley-Terry model over a table of groups (group, n, labels, features: those of its rows in a row); see ``deal_groups``.

    A round is a pass over the table: each task gives the sums over its groups, of a size that depends on the number of features only, and the driver adds these up and
    makes a Newton step.
    """

    def summed(of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for labels, once, features in zip(*(batch.column(c) for c in ("labels", "once", "features")), strict=True):
                    x = features.values.to_numpy().reshape(-1, width).astype(np.float64)
                    part = of(x, labels.values.to_numpy() == 1, once.values.to_numpy() == 1)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total])], names=["sums"])

        return functools.reduce(np.add, (v.values.to_numpy() for v in grouped.mapInArrow(run, "sums array<double>").toArrow()["sums"]))

    n, total = np.split(summed(lambda x, good, once: np.concatenate([[once.sum()], x[once].sum(axis=0)])), [1])
    mean = total / n
    scale = np.sqrt(summed(lambda x, good, once: ((x[once] - mean) ** 2).sum(axis=0)) / n) + 1e-6
    held, w = _held(width, ridge), np.zeros(width)
    for _ in range(rounds):
        sums = summed(lambda x, good, once, w=w: group_sums((x - mean) / scale, good, w))
        pairs, gradient, hessian = sums[0], sums[1 : width + 1], sums[width + 1 :].reshape(width, width)
        step = np.linalg.solve(hessian / pairs + np.diag(held), held * w + gradient / pairs)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def deal_groups(described: DataFrame, counts: dict[int, int], group_rows: int = 256, least: int = 8) -> DataFrame:
    """(id, label, features) -> group, labels, once, features: all rows dealt into groups of about ``group_rows`` by a hash of the id.

    Every row is in a group, so that it is compared with all the group's rows of the other label. Where a label is so rare that groups would hold fewer than ``least``
    of it, its rows are in several groups each; ``once`` is 1 for one of a row's places. A group is sorted, so that runs agree.
    """
    groups = max(1, sum(counts.values()) // group_rows)
    copies = {label: min(groups, max(1, -(-least * groups // n))) for label, n in counts.items()}
    times = functools.reduce(lambda rest, c: F.when(F.col("label") == c[0], F.lit(c[1])).otherwise(rest), copies.items(), F.lit(1))
    first = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(groups))
    dealt = described.withColumn("k", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("group", F.pmod(first + F.col("k"), F.lit(groups)))

    def gather(rows: pa.Table) -> pa.Table:
        x = rows["features"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        label, once = rows["label"].to_numpy(), (rows["k"].to_numpy() == 0).astype(np.int32)
        order = np.lexsort((once, *x.T[:20], label, rows["id"].to_numpy(zero_copy_only=False)))
        return pa.table([rows["group"].slice(0, 1), pa.array([label[order]]), pa.array([once[order]]), pa.array([x[order].ravel()])], names=["group", "labels", "once", "features"])

    return dealt.groupBy("group").applyInArrow(gather, "group long, labels array<int>, once array<int>, features array<float>")


def best_threshold(scored: DataFrame, counts: dict[int, int]) -> float:
    """Halfway between the neighbouring values of (raw, label) that part the labels best; of equally good ones the lowest.

    Distinct values lie in ranges; counts below them are added up within a range and then over ranges, so no value's place needs all in one task.
    """
    values = materialize(scored.groupBy("raw").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).repartitionByRange("raw").withColumn("range", F.spark_partition_id()), "values")
    ranges = values.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("raw").alias("last")).orderBy("range").collect()
    before, good, bad, last = [], 0, 0, None
    for r in ranges:
        before.append((r["range"], good, bad, last))
        good, bad, last = good + r["good"], bad + r["bad"], r["last"]
    spark = scored.sparkSession
    earlier = F.broadcast(spark.createDataFrame(before, "range int, good_before long, bad_before long, last_before double"))
    within = Window.partitionBy("range").orderBy("raw")
    below = within.rowsBetween(Window.unboundedPreceding, -1)
    cuts = values.withColumns({"good_below": F.coalesce(F.sum("good").over(below), F.lit(0)), "bad_below": F.coalesce(F.sum("bad").over(below), F.lit(0)), "prior": F.lag("raw").over(within)})
    cuts = cuts.join(earlier, "range").withColumn("prior", F.coalesce("prior", "last_before"))
    right = (F.col("bad_below") + F.col("bad_before")) / counts[0] + (counts[1] - F.col("good_below") - F.col("good_before")) / counts[1]
    best = cuts.where("prior IS NOT NULL").agg(F.max(F.struct(right.alias("right"), (-F.col("raw")).alias("low"), "prior")).alias("best")).first()["best"]
    drop(values)
    return (best["prior"] - best["low"]) / 2 if best else last


def train_quality_model(docs: DataFrame, labels: DataFrame, most_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", broadcast_rows: int = 1_000_000) -> PairwiseModel:
    """Fit on all labelled rows that aren't held out.

    Features (not texts) are written in groups of rows, within which each row of one label is compared with each of the other (``deal_groups``); Newton steps and
    the threshold are passes over these tables, and only sums come to the driver. ``most_rows`` is a bound for those who ask for it: about so many rows
    of each label, chosen by a hash of the id. Null ids and labels other than 0 and 1 take no part; null and empty
    texts count as empty. An id with both labels is in both; a repeated label counts once, and a repeated row of ``docs`` each time. Without rows of both
    labels (an empty table too), every text gets the one label there is, or 1. Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    if most_rows is not None:
        odds = F.lit(0.0)
        for r in usable.groupBy("label").count().collect():
            odds = F.when(F.col("label") == r["label"], F.lit(min(1.0, most_rows / r["count"]))).otherwise(odds)
        usable = usable.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) < odds * (1 << 20))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = text_features(batch.column(2)).astype(np.float32)
                at = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(found.ravel()))], names=["id", "label", "features"])

    usable = materialize(usable, "labels")
    few = F.broadcast(usable) if usable.count() <= broadcast_rows else usable
    texts = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, "id").select("id", "label", "text")
    described = materialize(texts.mapInArrow(describe, f"id {usable.schema['id'].dataType.simpleString()}, label int, features array<float>"), "features")
    counts = {r["label"]: r["count"] for r in described.groupBy("label").count().collect()}
    width = text_features(pa.array([""])).shape[1]
    if len(counts) < 2:
        drop(usable, described)
        return PairwiseModel(np.zeros(width), np.ones(width), np.zeros(width), 1.0 if 0 in counts else -1.0, 1.0)
    grouped = materialize(deal_groups(described, counts), "groups")
    mean, scale, w = fit_groups(grouped, width)

    @F.arrow_udf("double")
    def raw(features: pa.Array) -> pa.Array:
        return pa.array(((features.flatten().to_numpy().reshape(len(features), width).astype(np.float64) - mean) / scale) @ w)

    scored = materialize(described.select("label", raw("features").alias("raw")), "raw")
    threshold = best_threshold(scored, counts)
    spread = scored.agg(F.avg(F.abs(F.col("raw") - threshold))).first()[0]
    drop(usable, described, grouped, scored)
    return PairwiseModel(mean, scale, w, threshold, float(4 / max(1e-6, spread)))


def score_quality(docs: DataFrame, model: PairwiseModel, text_col: str = "text", score_name: str = "score") -> DataFrame:
    """``docs`` with a column ``score_name`` from 0 to 1; at 0.5 or more label 1 is the likelier.

    Every text is scored whole, however long, by the text alone; null counts as empty. Equal texts get equal scores, and repeated
    rows stay; an empty table gives none. A column of ``docs`` by that name is kept, and the score gets underscores before its name.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [model.score(text_features(part)) for part in array_slices(texts)]
        return pa.array(np.concatenate(found) if found else np.empty(0))

    return docs.withColumn(free_name(docs, score_name), score(F.col(text_col).cast("string")))


def keep_good(docs: DataFrame, model: PairwiseModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more (a tie with the threshold stays), with the columns of ``docs``; see ``score_quality``."""
    name = free_name(docs, "score")
    return score_quality(docs, model, text_col).where(F.col(name) >= 0.5).select(*docs.columns)
