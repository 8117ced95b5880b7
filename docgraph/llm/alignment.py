"""Alignment of two tokenizers' tokens on the same text: shared ends by galloping intersection, links counted corpus-wide."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import free_memory, materialize, slices, small_batches
from docgraph.llm.piece_store import _LETTERS as BYTE_LETTERS

#: Links of one group beyond which its distinct ids are paired instead of all its tokens.
LARGE_GROUP = 1 << 16
#: Texts with characters from here on are left to the tokenizer's own library, as two libraries might class those unlike.
RARE_FROM = 0x250
#: Runs without a blank, or of blanks, that are left to it too.
LONG_RUN = 4096


class ByteLevelTokens:
    """Ids and token bytes of a byte-level BPE file; special strings in a text are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        byte_of = {letter: byte for byte, letter in BYTE_LETTERS.items()}
        special = {t["id"]: t["content"].encode() for t in made.get("added_tokens") or []}
        entries = {i: bytes(map(byte_of.__getitem__, token)) for token, i in made["model"]["vocab"].items() if i not in special}
        self.tokens = _by_id(entries | special)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        merged = [bytes(map(byte_of.__getitem__, "".join(m if isinstance(m, list) else m.split(" ", 1)))) for m in made["model"]["merges"]]
        ids = {token: i for i, token in entries.items()}
        ranks = [ids[m] for m in merged]
        plain = ranks == sorted(ranks) and made.get("normalizer") is None and (made.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not made["pre_tokenizer"].get("add_prefix_space")
        self.fast = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={}) if plain else None
        self.odd = re.compile(rf"[^\x00-{chr(RARE_FROM - 1)}]|\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")

    def encode(self, text: str) -> list[int]:
        plain = len(text) < LONG_RUN and text.isascii()
        if self.fast is None or not plain and self.odd.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """Ids and token bytes of a sentence-piece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.tokens = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def _by_id(entries: dict[int, bytes]) -> list[bytes]:
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


_LOADED: dict[str, ByteLevelTokens | PieceTokens] = {}


def tokens_of(path: str) -> ByteLevelTokens | PieceTokens:
    """The tokenizer at ``path``, one per worker: a sentence-piece model if it ends in ``.model``, else a byte-level file."""
    if path not in _LOADED:
        _LOADED[path] = PieceTokens(path) if path.endswith(".model") else ByteLevelTokens(path)
    return _LOADED[path]


def gallop(ends: np.ndarray, targets: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Rank of the first of the rising ``ends`` that isn't below each target (no target is above all).

    From the guess, steps double until they have passed the target; the stretch they end in is halved until one rank is left.
    All targets take their steps at the same time.
    """
    most = len(ends) - 1
    below = ends[guess] < targets
    low, high = np.where(below, guess + 1, 0), np.where(below, most, guess)
    step = 1
    going = np.flatnonzero(below)
    while len(going):
        probe = np.minimum(guess[going] + step, most)
        passed = ends[probe] >= targets[going]
        high[going[passed]] = probe[passed]
        going, probe = going[~passed], probe[~passed]
        low[going] = probe + 1
        step *= 2
    step = 1
    going = np.flatnonzero(~below & (guess > 0))
    while len(going):
        probe = np.maximum(guess[going] - step, 0)
        passed = ends[probe] < targets[going]
        low[going[passed]] = probe[passed] + 1
        high[going[~passed]] = probe[~passed]
        going = going[~passed & (probe > 0)]
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        reached = ends[middle] >= targets[going]
        high[going[reached]] = middle[reached]
        low[going[~reached]] = middle[~reached] + 1
        going = going[low[going] < high[going]]
    return low


def common_ends(a: np.ndarray, a_rows: np.ndarray, b: np.ndarray, b_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and in ``b`` of the ends that both hold. Rows lie one after another, ends rise over all rows, and a row has the same last end in both.

    In each row the list with fewer ends drives the search into the other, from where an even spread of ends would have it.
    """
    n_a, n_b = np.diff(a_rows), np.diff(b_rows)
    found = []
    for drives, short, short_rows, n_short, long, long_rows, n_long in ((n_a <= n_b, a, a_rows, n_a, b, b_rows, n_b), (n_a > n_b, b, b_rows, n_b, a, a_rows, n_a)):
        n = np.where(drives, n_short, 0)
        row = np.repeat(np.arange(len(n)), n)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        own = short_rows[row] + rank
        at = gallop(long, short[own], long_rows[row] + rank * n_long[row] // n_short[row]) if len(own) else own
        same = long[at] == short[own]
        found.append((own[same], at[same]))
    in_a, in_b = np.concatenate([found[0][0], found[1][1]]), np.concatenate([found[0][1], found[1][0]])
    order = np.argsort(in_a, kind="stable")
    return in_a[order], in_b[order]


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.cumsum([0, *map(len, rows)])
    return np.fromiter((i for row in rows for i in row), dtype=np.int64, count=int(bounds[-1])), bounds


def align_texts(texts: list[str | None], one: ByteLevelTokens | PieceTokens, other: ByteLevelTokens | PieceTokens) -> tuple[np.ndarray, ...]:
    """(ids, row bounds) of both tokenizers, the sizes of groups in ids of both, and row bounds of the groups."""
    a, b = [], []
    for text in texts:
        ids = other_ids = []
        if text:
            whole = " " + text
            ids, other_ids = [t.encode(text if isinstance(t, PieceTokens) else whole) for t in (one, other)]
            raw = whole.encode()
            if any(b"".join(map(t.tokens.__getitem__, own)) != raw for t, own in ((one, ids), (other, other_ids))):
                ids = other_ids = []
        a.append(ids)
        b.append(other_ids)
    (a_ids, a_rows), (b_ids, b_rows) = _flat(a), _flat(b)
    a_size, b_size = (np.fromiter(map(len, t.tokens), dtype=np.int64) for t in (one, other))
    in_a, in_b = common_ends(np.cumsum(a_size[a_ids]), a_rows, np.cumsum(b_size[b_ids]), b_rows)
    return a_ids, a_rows, b_ids, b_rows, np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1), np.searchsorted(in_a, a_rows)


def align_tokens(docs: DataFrame, one_path: str, other_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How two tokenizers cut each text: id, a_ids, b_ids, a_sizes, b_sizes (ids per group, so many from each).

    Texts are encoded whole after a space (which sentence-piece models add themselves); ids are without special tokens. Byte offsets
    at which a token ends in both cut the tokens into groups, the finest that hold the same bytes. Null and empty texts, and those
    that a tokenizer doesn't give back byte by byte, have empty lists. A row per row of ``docs``, repeated ones too; ids may be null; an
    empty table gives no rows. Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = tokens_of(one_path), tokens_of(other_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                a_ids, a_rows, b_ids, b_rows, a_sizes, b_sizes, groups = align_texts(batch.column(1).to_pylist(), one, other)
                lists = [_lists(x, rows) for x, rows in ((a_ids, a_rows), (b_ids, b_rows), (a_sizes, groups), (b_sizes, groups))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "a_ids", "b_ids", "a_sizes", "b_sizes"])
        free_memory()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(align, f"id {rows.schema['id'].dataType.simpleString()}, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")
    return found.withColumnRenamed("id", id_col)


def _lists(values: np.ndarray, rows: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(values, kind or pa.int32()))


def _values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, row bounds) of a list column."""
    rows = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).astype(np.int64)[rows[0] : rows[-1]], rows - rows[0]


_DIGITS: list[np.ndarray] = []


def _digits(most: int) -> np.ndarray:
    """Row k holds k in decimal digits, right-aligned after zero bytes."""
    if not _DIGITS or len(_DIGITS[-1]) <= most:
        width = len(str(most))
        places = 10 ** np.arange(width - 1, -1, -1, dtype=np.int64)
        numbers = np.arange(most + 1, dtype=np.int64)[:, None]
        table = (numbers // places % 10 + 48).astype(np.uint8)
        table[:, :-1][numbers < places[:-1]] = 0
        _DIGITS.append(table)
    return _DIGITS[-1]


def _written(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each id's begin) of ids in decimal digits, each with the mark after it."""
    digits = _digits(int(ids.max()) if len(ids) else 0)
    table = np.empty((len(ids), digits.shape[1] + 1), dtype=np.uint8)
    table[:, :-1] = digits[ids]
    table[:, -1] = marks
    used = table != 0
    return table[used], np.append(0, np.cumsum(used.sum(axis=1)))


def group_digests(a_ids: np.ndarray, a_rows: np.ndarray, b_ids: np.ndarray, b_rows: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> list[str]:
    """SHA-256 of each row's groups as text, ``a1,a2|b1;a3|b2,b3`` in decimal ids; empty for a row without groups."""
    n_a, n_b = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_group, b_group = np.repeat(np.arange(len(a_sizes)), a_sizes), np.repeat(np.arange(len(b_sizes)), b_sizes)
    a_place, b_place = np.arange(len(a_ids)) + (n_b - b_sizes)[a_group], np.arange(len(b_ids)) + n_a[b_group]
    ids = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
    ids[a_place], ids[b_place] = a_ids, b_ids
    marks = np.full(len(ids), ord(","), dtype=np.uint8)
    marks[a_place[n_a - 1]], marks[b_place[n_b - 1]] = ord("|"), ord(";")
    raw, starts = _written(ids, marks)
    view = memoryview(np.ascontiguousarray(raw))
    bounds = starts[a_rows + b_rows]
    return [hashlib.sha256(view[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def distinct_links(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id pairs as ``a * width + b``, how often each, row bounds): the distinct linked pairs of each row; ``row`` is each group's."""
    a_start, b_start = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    n = a_sizes * b_sizes
    few = np.where(n > LARGE_GROUP, 0, n)
    group = np.repeat(np.arange(len(n)), few)
    rank = np.arange(len(group)) - np.repeat(np.cumsum(few) - few, few)
    pair = a_ids[a_start[group] + rank // b_sizes[group]] * width + b_ids[b_start[group] + rank % b_sizes[group]]
    order = np.lexsort((pair, row[group])) if n_rows > 1 else np.argsort(pair)
    pair, of = pair[order], row[group][order]
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1]))) if len(pair) else np.empty(0, dtype=np.int64)
    pair, of, times = pair[first], of[first], np.diff(np.append(first, len(pair)))
    large = np.flatnonzero(n > LARGE_GROUP)
    if len(large):
        more = [(pair, of, times)]
        for g in large.tolist():
            x, x_times = np.unique(a_ids[a_start[g] : a_start[g] + a_sizes[g]], return_counts=True)
            y, y_times = np.unique(b_ids[b_start[g] : b_start[g] + b_sizes[g]], return_counts=True)
            both = (x[:, None] * width + y[None, :]).ravel()
            more.append((both, np.full(len(both), row[g]), (x_times[:, None] * y_times[None, :]).ravel()))
        pair, of, times = (np.concatenate(x) for x in zip(*more, strict=True))
        order = np.lexsort((pair, of))
        pair, of, times = pair[order], of[order], times[order]
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])))
        pair, of, times = pair[first], of[first], np.add.reduceat(times, first)
    return pair, times, np.searchsorted(of, np.arange(n_rows + 1))


def link_rows(aligned: DataFrame, width: int, id_col: str = "doc_id") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times: what ``align_tokens`` gave, in figures, with the distinct linked id pairs (``a * width + b``) and how often each is linked."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                (a_ids, a_rows), (b_ids, b_rows), (a_sizes, groups), (b_sizes, _) = map(_values, batch.columns[1:5])
                row = np.repeat(np.arange(batch.num_rows), np.diff(groups))
                pairs, times, bounds = distinct_links(a_ids, b_ids, a_sizes, b_sizes, row, batch.num_rows, width)
                n_links = np.bincount(row, weights=a_sizes * b_sizes, minlength=batch.num_rows).astype(np.int64)
                figures = [pa.array(np.asarray(x, dtype=np.int64)) for x in (np.diff(a_rows), np.diff(b_rows), np.diff(groups), n_links)]
                digests = pa.array(group_digests(a_ids, a_rows, b_ids, b_rows, a_sizes, b_sizes), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *figures, digests, _lists(pairs, bounds, pa.int64()), _lists(times, bounds, pa.int64())], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
        free_memory()

    rows = aligned.select(F.col(id_col).alias("id"), "a_ids", "b_ids", "a_sizes", "b_sizes")
    return rows.mapInArrow(describe, f"id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>").withColumnRenamed("id", id_col)


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """pair, n_docs (rows that hold it), is_best (no pair of its first id is in more)."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    of_first = Window.partitionBy(F.floor(F.col("pair") / width))  # at most as many rows as the other vocabulary has ids
    return counts.withColumn("is_best", F.col("n_docs") == F.max("n_docs").over(of_first))


def _count_here(links: DataFrame, counts: DataFrame, id_col: str) -> DataFrame:
    found = counts.orderBy("pair").toArrow()
    table = links.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("pair", "n_docs", "is_best")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_docs, is_best = table.value
        for batch in batches:
            (pairs, bounds), (times, _) = _values(batch.column(6)), _values(batch.column(7))
            at = np.searchsorted(known, pairs)
            sums = [np.append(0, np.cumsum(x))[bounds] for x in (times * is_best[at], times * n_docs[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(np.diff(x)) for x in sums)], names=[*batch.schema.names[:6], "n_best", "count_sum"])

    kept = f"id {links.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return links.withColumnRenamed(id_col, "id").mapInArrow(add, kept).withColumnRenamed("id", id_col)


def _count_by_join(links: DataFrame, counts: DataFrame, hot_share: int = 10_000) -> DataFrame:
    """As ``_count_here``, by joins: pairs that hold more than a part in ``hot_share`` of all rows, and so are at most that many, are broadcast, the rest shuffled."""
    links = materialize(links.withColumn("row", F.monotonically_increasing_id()), "link_rows")
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    hot_from = (counts.agg(F.sum("n_docs")).first()[0] or 0) // hot_share
    hot, rest = counts.where(F.col("n_docs") > hot_from), counts.where(F.col("n_docs") <= hot_from)
    marked = each.join(F.broadcast(hot), "pair", "left")
    joined = marked.where(F.col("n_docs").isNotNull()).unionByName(marked.where(F.col("n_docs").isNull()).select("row", "pair", "times").join(rest, "pair"))
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    return links.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}).drop("row", "pairs", "times")


def alignment_figures(aligned: DataFrame, width: int, broadcast_pairs: int = 6_000_000, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``align_tokens``: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    Every token of a group's one side is linked with every one of its other side. A pair of ids counts the rows, corpus-wide, in which it is linked;
    ``count_sum`` adds the counts of a row's links, ``n_best`` counts its links than whose pair none of the same first id counts more (ties too).
    ``width`` is above every second id. Counts of up to ``broadcast_pairs`` pairs (24 bytes each) go to all tasks; beyond that they are joined.
    Repeated rows count each. Rows without tokens have zeros and an empty digest.
    """
    links = materialize(link_rows(aligned, width, id_col), "links")
    counts = materialize(pair_counts(links, width), "pair_counts")
    return _count_here(links, counts, id_col) if counts.count() <= broadcast_pairs else _count_by_join(links, counts)
