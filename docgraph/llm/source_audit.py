"""How the sources of a language differ in their words: terms counted by sorting word-start pointers, smoothed shares compared exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import free_memory, materialize, small_batches

#: Shares are in billionths, and every term counts as seen so many times more.
PARTS, EXTRA = 1_000_000_000, 5
#: Bytes of text whose pointers are sorted at a time.
SHARD_BYTES = 1 << 23

_INSIDE = np.zeros(256, dtype=bool)  # bytes of terms: ASCII letters and all of other characters
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_pointers(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each term in UTF-8 rows that lie one after another; a row's end ends a term."""
    inside = np.append(_INSIDE[raw], False)
    edge = np.zeros(len(inside), dtype=bool)
    edge[bounds] = True
    before = np.append(False, inside[:-1])
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    return start, end - start


def sort_pointers(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pointers by their words' bytes, number of the run of equal words at each place of that order).

    Multikey sort: pointers are parted by the next eight bytes of their words; within each run of equal ones, only those whose
    words go on are parted again, by the eight bytes after. No word is copied. ``raw`` has no zero bytes inside words.
    """
    windows = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(8, dtype=np.uint8)), 8)
    in_word = np.frombuffer(b"".join(b"\xff" * k + b"\0" * (8 - k) for k in range(9)), dtype=">u8")

    def key(of: np.ndarray, depth: int) -> np.ndarray:
        at = np.minimum(start[of] + depth, len(raw))
        return (windows[at].copy().view(">u8").ravel() & in_word[np.clip(length[of] - depth, 0, 8)]).astype(np.uint64)

    order = np.arange(len(start))
    run = np.zeros(len(start), dtype=np.int64)
    places, depth = np.arange(len(start)), 0
    while len(places):
        keys = key(order[places], depth)
        sort = np.lexsort((keys, run[places])) if depth else np.argsort(keys)
        order[places] = order[places][sort]
        keys = keys[sort]
        same = np.zeros(len(order), dtype=bool)  # as the place before
        same[1:] = run[1:] == run[:-1]
        same[places[1:]] &= (keys[1:] == keys[:-1]) | (np.diff(places) > 1)
        run = np.cumsum(~same) - 1
        again = (keys & np.uint64(255)) != 0
        alone = ~same & ~np.append(same[1:], False)
        places = places[again & ~alone[places]]
        depth += 8
    return order, run


def shard_counts(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of each term in each group; ``group`` is each text's."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = _LOWER[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    start, length = word_pointers(raw, bounds)
    order, run = sort_pointers(raw, start, length)
    by_group = np.argsort(group, kind="stable")  # documents of a group are neighbours
    place = np.empty(len(group), dtype=np.int64)
    place[by_group] = np.arange(len(group))
    document = place[np.searchsorted(bounds, start[order], side="right") - 1]
    each = np.sort(run * len(group) + document)
    first = np.flatnonzero(np.append(True, each[1:] != each[:-1])) if len(each) else np.empty(0, dtype=np.int64)
    times = np.diff(np.append(first, len(each)))
    word, own = each[first] // max(1, len(group)), group[by_group][each[first] % max(1, len(group))]
    cell = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (own[1:] != own[:-1]))) if len(word) else first
    leader = order[np.flatnonzero(np.append(True, run[1:] != run[:-1]))[word[cell]]] if len(cell) else cell
    size = length[leader]
    ends = np.cumsum(size)
    letters = raw[np.repeat(start[leader] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    terms = pa.Array.from_buffers(pa.string(), len(cell), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(letters)])
    return terms, own[cell], np.add.reduceat(times, cell) if len(cell) else times, np.diff(np.append(cell, len(word)))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, n_docs: occurrences and documents by shard (a term comes once per shard and group, not once in all).

    Words are pointers to their starts in the texts' Arrow buffer; sorting these puts equal words side by side, and a run's length and
    its documents and sources are what is counted. A shard is about ``SHARD_BYTES`` of text, or one longer text.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += pc.sum(pc.binary_length(batch.column(2))).as_py() or 0
            if held >= SHARD_BYTES:
                yield shard(waiting)
                waiting, held = [], 0
        if waiting:
            yield shard(waiting)
        free_memory()

    def shard(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        names = pa.table({"lang": rows["lang"], "source": rows["source"], "at": np.arange(rows.num_rows)})
        groups = names.group_by(["lang", "source"], use_threads=False).aggregate([("at", "list")])
        members = groups["at_list"].combine_chunks()
        group = np.empty(rows.num_rows, dtype=np.int64)
        group[members.flatten().to_numpy()] = np.repeat(np.arange(groups.num_rows), np.diff(members.offsets.to_numpy()))
        text = pa.concat_arrays([c.cast(pa.large_string()) for c in rows["text"].chunks])
        terms, own, n, n_docs = shard_counts(text, group)
        own = pa.array(own)
        return pa.RecordBatch.from_arrays([*(groups[c].combine_chunks().take(own) for c in ("lang", "source")), terms, pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())], names=["lang", "source", "term", "n", "n_docs"])

    return _texts(docs, text_col, lang_col, source_col).mapInArrow(count, "lang string, source string, term string, n long, n_docs long")


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def share(n: Column, total: Column, n_terms: Column) -> Column:
    """Smoothed share in billionths, one at least, in exact integers; null where there are no terms."""
    parts = F.lit(PARTS).cast("decimal(38,0)") * (n + F.lit(EXTRA))
    whole = F.nullif(total + F.lit(EXTRA) * n_terms, F.lit(0))
    return F.lit(1) + F.call_function("div", parts.cast("decimal(38,0)"), whole.cast("decimal(38,0)"))


def _tile(key: tuple, cells: pa.Table, zeros: pa.Table) -> pa.Table:
    """What the terms of one tile add to the distances of two blocks of sources, beyond what terms that neither has would add."""
    lang, a, b = (k.as_py() for k in key[:3])
    blocks = {}
    for block in (a, b):
        own = zeros.filter(pc.equal(zeros["block"], block))
        slot = own["slot"].to_numpy()
        z = np.zeros(slot.max() + 1 if len(slot) else 0, dtype=np.int64)
        z[slot] = own["z"].to_numpy()
        blocks[block] = z
    coded = cells["term"].combine_chunks().dictionary_encode()
    code, n_terms = coded.indices.to_numpy(), len(coded.dictionary)
    block, slot, p = (cells[c].to_numpy() for c in ("block", "slot", "p"))
    shares = {k: np.repeat(z[:, None], n_terms, axis=1) for k, z in blocks.items()}
    for k, dense in shares.items():
        own = block == k
        dense[slot[own], code[own]] = p[own]
    one, other, delta = [], [], []
    for i, (z, row) in enumerate(zip(blocks[a], shares[a], strict=True)):
        later = np.arange(i + 1 if a == b else 0, len(blocks[b]))
        one.append(np.full(len(later), i))
        other.append(later)
        delta.append(np.abs(shares[b][later] - row).sum(axis=1) - n_terms * np.abs(blocks[b][later] - z))
    join = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0), pa.int64())
    one, other, delta = join(one), join(other), join(delta)
    constant = lambda value, kind: pa.repeat(pa.scalar(value, kind), len(delta))
    return pa.table([constant(lang, pa.string()), constant(a, pa.int64()), constant(b, pa.int64()), one, other, delta], names=["lang", "a", "b", "a_slot", "b_slot", "delta"])


def pair_distances(groups: DataFrame, cells: DataFrame, block_sources: int = 256, tile_terms: int = 2048) -> DataFrame:
    """lang, source, item (each other source of the language), value: the sum over its terms of the absolute differences of shares.

    ``groups``: lang, source, n_terms (of the language), z (share of a term that the group lacks); ``cells``: lang, source, term, p.
    Sources are in blocks and terms in buckets; a tile of two blocks and a bucket is a dense array of bounded size, whatever the
    numbers of sources and terms. A term that neither source has adds the same each time, so it isn't looked at. Not more than the pairs themselves,
    which are the result, is joined within a language.
    """
    in_lang = Window.partitionBy("lang").orderBy("source")
    numbered = groups.withColumn("no", F.row_number().over(in_lang) - 1).withColumns({"block": F.floor(F.col("no") / block_sources), "slot": F.col("no") % block_sources})
    numbered = numbered.join(groups.groupBy("lang").agg(F.ceil(F.count("*") / block_sources).alias("n_blocks")), "lang")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / tile_terms))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("with")
    tile = [F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b")]
    placed = cells.join(numbered.select("lang", "source", "block", "slot", "n_blocks", buckets.alias("buckets")), ["lang", "source"])
    in_tiles = placed.select("lang", "block", "slot", "term", "p", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), others).select("lang", *tile, "bucket", "block", "slot", "term", "p")
    own = [F.col(c).alias(c) for c in ("lang", "block", "slot", "z")]  # names of their own, as both sides come from the same tables
    zeros = numbered.where("n_terms > 0").select(*own, buckets.alias("buckets"), others).select("lang", *tile, F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"), "block", "slot", "z")
    key = ["lang", "a", "b", "bucket"]
    tiles = in_tiles.groupBy(*key).cogroup(zeros.groupBy(*key)).applyInArrow(_tile, "lang string, a long, b long, a_slot long, b_slot long, delta long")
    deltas = tiles.groupBy("lang", (F.col("a") * block_sources + F.col("a_slot")).alias("least"), (F.col("b") * block_sources + F.col("b_slot")).alias("greatest")).agg(F.sum("delta").alias("delta"))
    one = numbered.select("lang", F.col("source"), F.col("no"), "z", "n_terms", others)
    other = numbered.select("lang", F.col("source").alias("item"), F.col("no").alias("item_no"), F.col("z").alias("item_z"), F.col("block").alias("with"))
    both = one.join(other, ["lang", "with"]).where("no != item_no").withColumns({"least": F.least("no", "item_no"), "greatest": F.greatest("no", "item_no")})
    base = F.coalesce(F.col("n_terms") * F.abs(F.col("z") - F.col("item_z")), F.lit(0))
    return both.join(deltas, ["lang", "least", "greatest"], "left").select("lang", "source", "item", (base + F.coalesce("delta", F.lit(0))).alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    Terms are runs of ASCII letters and other characters beyond ASCII, A-Z lower-cased; a language keeps those in ``least_docs`` of its
    documents or more. Part ``pair``: every other source of the language with the sum of absolute differences of the terms' shares. Part
    ``term``: up to ``most_terms`` terms whose share in the source is above the language's, with the difference. Ranks are by value descending,
    ties by item (UTF-8) ascending. All figures are exact integers.

    Null texts, languages and sources count as empty; empty texts have no terms, but their group is there, and a language without kept terms has
    pairs at value 0. Every text is read whole, however long. Repeated rows are documents each. An empty table gives no rows. Other
    columns, whatever their names, are not read.
    """
    of_term = Window.partitionBy("lang", "term")
    shards = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")  # shards are counted out before: a very common term is a row per shard and group
    summed = shards.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    cells = materialize(summed.withColumns({"n_docs": F.sum("n_docs").over(of_term), "lang_n": F.sum("n").over(of_term)}).where(F.col("n_docs") >= least_docs).drop("n_docs"), "cells")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_cells"))
    langs = cells.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("n_terms"))
    groups = _texts(docs, text_col, lang_col, source_col).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "lang_total")
    groups = materialize(groups.withColumn("z", share(F.lit(0), F.col("total"), F.col("n_terms"))), "groups")
    shared = cells.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("n_terms")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))})
    pairs = pair_distances(groups.select("lang", "source", "n_terms", "z"), shared.select("lang", "source", "term", "p")).withColumn("part", F.lit("pair"))
    terms = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    in_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(in_group)).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    ranked = pairs.withColumn("rank", F.row_number().over(in_group))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(best.select(*columns))
