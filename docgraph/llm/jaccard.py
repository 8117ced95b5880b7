"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import free_memory, free_name, longs, materialize, slices, small_batches, words
from docgraph.llm.components import connected_components, in_blocks
from docgraph.llm.shingles import mix, shingle_sets

_U = np.uint64
_FILTER_BITS = 1024


def band_edges(most: int, p: int, q: int) -> list[int]:
    """Sizes at which bands begin: two sets with a Jaccard similarity of p/q are in the same band or in adjacent ones."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * q // p + 1)
    return [*edges, edges[-1] * q // p + 1, (edges[-1] * q // p + 1) * q // p + 1]


def most_difference(smaller: int, p: int, q: int) -> int:
    """The largest symmetric difference of two sets of similarity p/q, of which the smaller has ``smaller`` members."""
    return (q - p) * (smaller + smaller * q // p) // (q + p)


def filter_bits(size: int) -> int:
    """Bits of the filter sketch of a set: a power of two and at least its size, so that unrelated sets differ in more bits than similar ones may."""
    return max(_FILTER_BITS, 1 << (size - 1).bit_length())


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """XOR of one-hot codes: bit h of the sketch is the parity of the hashes that fall on it, in 64-bit words.

    A token in one set only flips one bit, so the Hamming distance of two
    sketches is at most the symmetric difference of their sets.
    """
    odd = np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(_U)


@lru_cache(4096)
def part_count(scheme: int, edges: tuple[int, ...], p: int, q: int) -> int:
    """Parts of a scheme: more than the symmetric difference may be, and so many that, by five standard deviations, a set has more parts that aren't empty than that."""
    largest = most_difference(edges[scheme + 1] - 1, p, q)
    sizes = [(n, min(largest, most_difference(n, p, q))) for n in (edges[scheme], edges[scheme + 1] - 1, edges[scheme + 2] - 1)]
    parts = largest + 1
    while parts < 256 + 8 * largest:
        share = [n / parts for n, _ in sizes]
        filled = [parts * (1 - math.exp(-c)) - 5 * math.sqrt(parts * math.exp(-c) * max(0.0, 1 - (1 + c) * math.exp(-c))) for c in share]
        if all(f > d for f, (_, d) in zip(filled, sizes, strict=True)):
            break
        parts += max(1, parts // 20)
    return parts


def part_keys(hashes: np.ndarray, scheme: int, edges: list[int], p: int, q: int) -> np.ndarray:
    """Keys of a set's sketch in the scheme of one size band: one for each part of the sketch that has tokens.

    The scheme has more parts than the symmetric difference may be, so by the pigeonhole
    principle two sets that link agree in a part: a token in one set only changes one part. A part is wide
    (one bit per possible token), so it is kept as the XOR of its tokens' codes. Empty parts, which unrelated sets share, have no key:
    if two sets that link agreed in empty parts only, neither would have more filled parts than the tokens by which a set of its
    size may differ. Only the few sets for which that is so have keys of their empty parts too, so no link is lost.
    """
    largest = most_difference(edges[scheme + 1] - 1, p, q)
    if not largest:  # similar sets are equal ones, and these are one class already
        return np.empty(0, dtype=_U)
    parts = part_count(scheme, tuple(edges[: scheme + 3]), p, q)
    part = ((hashes >> _U(32)) * _U(parts)) >> _U(32)  # rises with the sorted hashes
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    filled = part[start]
    keys = mix(np.bitwise_xor.reduceat(mix(hashes), start) ^ mix(filled + _U(scheme << 40)))
    if len(filled) > min(largest, most_difference(len(hashes), p, q)):
        return keys
    empty = np.setdiff1d(np.arange(parts, dtype=_U), filled)
    return np.append(keys, mix(mix(empty + _U(scheme << 40))))


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bits: bits whose numbers agree modulo the new length are XORed."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0) if len(sketch) > words else sketch


def similar_to(x: int, others: np.ndarray, sizes: np.ndarray, bits: np.ndarray, sets: list[np.ndarray] | None, p: int, q: int) -> np.ndarray:
    """Those of ``others`` that may be (or with ``sets``, are) similar to member ``x``.

    Two whose sketches differ in more bits than similar sets may are apart; with ``sets``, the rest are verified by their exact intersection.
    """
    if not len(others):
        return others
    small, large = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
    near = np.flatnonzero(q * small >= p * large)
    if len(near):
        apart = np.bitwise_count(bits[others[near]] ^ bits[x]).sum(axis=1, dtype=np.int64)
        near = near[(q + p) * apart <= (q - p) * (small + large)[near]]
    if sets is not None and len(near):
        own, compared = sets[x], [sets[k] for k in others[near]]
        joined = np.concatenate(compared)
        found = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
        both = np.add.reduceat(found, np.cumsum([0, *(len(o) for o in compared[:-1])]), dtype=np.int64)
        near = near[q * both >= p * (sizes[others[near]] + sizes[x] - both)]
    return others[near]


def linked_forest(sizes: np.ndarray, sketches: list[np.ndarray], sets: list[np.ndarray] | None, p: int, q: int, roots: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that span the components of one task's members.

    Breadth first: a member that was reached is compared with all not yet reached, once. Members with a root (not -1) are
    known to be in one component: they are only compared with those without, and one link to them is enough.
    """
    words = min(len(s) for s in sketches)
    bits = np.stack([_fold(s, words) for s in sketches])
    left = np.arange(len(sizes))
    settled = np.empty(0, dtype=np.int64)
    if roots is not None:
        left, settled = left[roots == -1], left[roots != -1]
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue:
            x = queue.pop()
            if len(settled):
                hits = similar_to(x, settled, sizes, bits, sets, p, q)
                for y in hits[np.unique(roots[hits], return_index=True)[1]].tolist():
                    yield x, y
            reached = similar_to(x, left, sizes, bits, sets, p, q)
            for y in reached.tolist():
                yield x, y
                queue.append(y)
            if len(reached):
                left = left[~np.isin(left, reached)]


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each task, of a partition that is sorted by task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != task[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


_LINKS = "a long, b long"


def _forests(members: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b) links among members (task, node, root, size, sketch[, members_sorted]) of each task."""
    exact = "members_sorted" in members.columns

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for rows in _tasks(batches):
            if exact:  # rows of one class that a repeated id has brought in twice
                nodes = rows.column("node").to_numpy()
                rows = rows.filter(pa.array(np.append(True, nodes[1:] != nodes[:-1])))
            nodes, sizes = rows.column("node").to_numpy(), rows.column("size").to_numpy()
            if len(nodes) > 1:
                view = lambda c: [np.frombuffer(x, dtype=_U) for x in rows.column(c).to_pylist()]
                found = rows.column("root")
                _, roots = np.unique(found.fill_null(0).to_numpy(), return_inverse=True)
                roots = np.where(found.is_null().to_numpy(), -1, roots) if found.null_count < len(found) else roots
                for x, y in linked_forest(sizes, view("sketch"), view("members_sorted") if exact else None, p, q, None if found.null_count == len(found) else roots):
                    a.append(nodes[x])
                    b.append(nodes[y])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        free_memory()

    columns = ["task", "node", "root", "size", "sketch", *(["members_sorted"] if exact else [])]
    return members.select(*columns).repartition("task").sortWithinPartitions("task", "node").mapInArrow(link, _LINKS)


def _with_representatives(members: DataFrame, group: str, heavy: DataFrame, p: int, q: int, rounds: int, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members of heavy groups with a column ``root``, links (a, b) that tie those with a root together).

    First, ``tries`` members of a group are compared with all; the one that most are similar to is the group's root. Then, round by
    round, another member that has come to it is compared with all that have not. Each time is one join, linear in the group. Near
    copies of one text are settled by the first or second.
    """
    exact = "members_sorted" in members.columns
    payload = ["node", "size", "sketch", *(["members_sorted"] if exact else [])]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
            hits: list[int] = []
            for k in range(batch.num_rows):
                pair = [np.frombuffer(rows[c][k], dtype=_U) for c in ("sketch", "sketch_of")]
                words = min(map(len, pair))
                sets = [np.frombuffer(rows[c][k], dtype=_U) for c in ("members_sorted", "members_sorted_of")] if exact else None
                sizes = np.array([rows["size"][k], rows["size_of"][k]])
                if rows["node"][k] == rows["node_of"][k] or len(similar_to(0, np.array([1]), sizes, np.stack([_fold(x, words) for x in pair]), sets, p, q)):
                    hits.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hits, pa.int64())), batch.column(1).take(pa.array(hits, pa.int64())), pa.array([rows["node_of"][k] for k in hits], pa.int64())], names=["group", "node", "via"])

    def compared(some: DataFrame, chosen: DataFrame) -> DataFrame:
        return some.join(chosen, "group").select("group", "node", *payload[1:], *[F.col(f"r.{c}").alias(f"{c}_of") for c in payload]).mapInArrow(verify, "group long, node long, via long")

    of_heavy = members.withColumnRenamed(group, "group").join(heavy.withColumnRenamed(group, "group"), "group")
    member = F.struct(*payload)
    tried = of_heavy.groupBy("group").agg(F.array(*[F.min_by(member, F.xxhash64("node", F.lit(k))) for k in range(tries)]).alias("some")).select("group", F.explode(F.array_distinct("some")).alias("r"))
    hits = materialize(compared(of_heavy, tried), "first-hits")
    best = hits.groupBy("group", "via").count().groupBy("group").agg(F.max_by("via", F.struct("count", "via")).alias("root"))
    settled = materialize(hits.join(best, "group").where("via = root"), "settled")
    for k in range(rounds):
        chosen = of_heavy.join(settled.where("node != root"), ["group", "node"], "left_semi").groupBy("group").agg(F.min_by(member, F.xxhash64("node", F.lit(tries + k))).alias("r"))
        more = compared(of_heavy.join(settled, ["group", "node"], "left_anti"), chosen).join(best, "group")
        settled = materialize(settled.unionByName(more), "settled")
    with_root = of_heavy.join(settled.select("group", "node", "root"), ["group", "node"], "left").withColumnRenamed("group", group)
    return with_root, settled.where("node != via").select(F.col("node").alias("a"), F.col("via").alias("b"))


def spanning_links(members: DataFrame, group: str, weight: str, most_weight: int, p: int, q: int, rounds: int = 1) -> DataFrame:
    """(a, b) links that span the similar members (node, size, sketch[, members_sorted]) of each group.

    Groups of up to ``most_weight`` are compared in one task. In heavier ones, most members are settled by a few representatives;
    what is left is compared with all, block by block (``in_blocks``), so no link is lost and no task grows with a group. Only
    groups of very many members that are not alike cost the square of their size.
    """
    heavy = members.groupBy(group).agg(F.sum(weight).alias("_all")).where(F.col("_all") > most_weight).select(group)
    no_root = F.lit(None).cast("long")
    if heavy.isEmpty():
        return _forests(members.withColumns({"task": F.xxhash64(group), "root": no_root}), p, q)
    heavy = materialize(heavy, "heavy-groups")
    light = members.join(heavy, group, "left_anti").withColumns({"task": F.xxhash64(group), "root": no_root})
    rooted, links = _with_representatives(members, group, heavy, p, q, rounds)
    blocks = in_blocks(rooted, group, "node", weight, most_weight)
    columns = ["task", "root", *[c for c in members.columns if c != group]]
    return _forests(light.select(*columns).unionByName(blocks.select(*columns)), p, q).unionByName(links)


def jaccard_components(
    docs: DataFrame,
    shingle: int = 5,
    at_least: tuple[int, int] = (80, 100),
    most_size: int = 1 << 32,
    group_rows: int = 8192,
    task_shingles: int = 1_000_000,
    broadcast_rows: int = 200_000,
    hot_rows: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least p/q.

    Returns one row per row of ``docs``: id, n_shingles, class_id (equal for equal sets),
    component_id, the least id reachable by links, its own included, component (null
    without words), text_hash, which tells rows of one id apart, and first, the component's row of the least id (then text
    hash; null ids last). Exact but for 64-bit hash collisions of words and shingles.

    1. Each text gives its shingle set, a class hash, a filter sketch, and the keys of its
       parity sketch in the schemes of its size band and the one below. A task gives keys for each class once.
    2. Rows that share a key are grouped by the key. A key that one class alone has is
       useless; groups of equal membership count once.
    3. In each group, sketches that are near enough span a forest (``spanning_links``, groups over ``group_rows`` in
       blocks). Its components are families.
    4. The sets of each family (and only those) are verified exactly in the same way, in tasks
       of about ``task_shingles``; the verified links span the result's components.
    5. Components and least ids are worked out per class, not per row. Classes are joined to their rows by a broadcast up to
       ``broadcast_rows`` of them; beyond, only those of over ``hot_rows`` copies are, and the others by a shuffle.
    No pairs are emitted but forests, and nothing is capped. The families' ids are broadcast
    to the texts up to ``broadcast_rows`` of them; beyond, texts and ids are shuffled.

    Null texts and texts without words have an empty set, linked with nothing. Equal texts share
    a class, also under one id. A null id is kept, and ignored as a least id. Very long texts are read whole. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    p, q = at_least
    edges = band_edges(most_size, p, q)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(edges)
        seen: set[int] = set()  # classes that this task has given keys of
        for whole in batches:
            for batch in slices(whole, "text"):
                size, node, sketch, keys = [], [], [], []
                for own in shingle_sets(batch.column(1), shingle):
                    n = len(own)
                    size.append(n)
                    node.append(int(_node(own)) if n else 0)
                    sketch.append(parity(own, filter_bits(n)).tobytes() if n else None)
                    if not n or node[-1] in seen:
                        keys.append(None)
                        continue
                    seen.add(node[-1])
                    band = int(np.searchsorted(starts, n, side="right")) - 1
                    keys.append(np.concatenate([part_keys(own, s, edges, p, q) for s in (band - 1, band) if s >= 0]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(size, pa.int64()), longs(np.array(node, dtype=_U)), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "text_hash", "size", "node", "sketch", "keys"],
                )
        free_memory()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    id_type = texts.schema["id"].dataType.simpleString()
    described = materialize(texts.mapInArrow(describe, f"id {id_type}, text_hash long, size long, node long, sketch binary, keys array<long>"), "described")
    worded = described.where("size > 0")

    rows = described.where(F.size("keys") > 0).select("node", F.explode("keys").alias("key"))
    by_key = Window.partitionBy("key")
    other = F.xxhash64("node", F.lit(3))
    shared = rows.withColumns({"low": F.min("node").over(by_key), "high": F.max("node").over(by_key), "least": F.min(other).over(by_key), "most": F.max(other).over(by_key)}).where("low != high")
    groups = materialize(shared.select(F.xxhash64("low", "high", "least", "most").alias("group"), "node").distinct(), "groups")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    classes = materialize(worded.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.min(row).alias("first")).join(groups.select("node").distinct(), "node", "left_semi"), "classes")
    near = groups.withColumn("one", F.lit(1)).join(classes.drop("first"), "node")
    family = connected_components(spanning_links(near, "group", "one", group_rows, p, q))

    wanted = materialize(classes.join(family, "node").select("node", "component", "size", "first.id", "first.text_hash"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = list(shingle_sets(batch.column(1), shingle))
                own = pa.array([x.tobytes() for x in found], pa.binary())
                keep = pa.array([int(_node(x)) if len(x) else 0 for x in found], pa.uint64()).view(pa.int64())
                sketch = pa.array([parity(x, filter_bits(len(x))).tobytes() for x in found], pa.binary())
                out = pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(4), sketch, own], names=["node", "component", "size", "sketch", "members_sorted"])
                yield out.filter(pc.equal(keep, out.column(0)))  # another text of the same id and hash
        free_memory()

    few = wanted.count() <= broadcast_rows  # of some 50 bytes each
    same = F.col("t.id").eqNullSafe(F.col("w.id")) & F.col("t.text_hash").eqNullSafe(F.col("w.text_hash"))
    of_wanted = texts.alias("t").join((F.broadcast(wanted) if few else wanted).alias("w"), same).select("t.id", "t.text", "w.node", "w.component", "w.size")
    members = of_wanted.mapInArrow(sets, "node long, component long, size long, sketch binary, members_sorted binary")
    linked = connected_components(spanning_links(materialize(members, "sets"), "component", "size", task_shingles, p, q))

    counted = worded.groupBy("node").agg(F.min(row).alias("first"), F.count("*").alias("copies"))
    linked_classes = counted.join(linked, "node")
    firsts = linked_classes.groupBy("component").agg(F.min("first").alias("first"))
    alone = counted.where("copies > 1").join(linked, "node", "left_anti").select("node", F.col("node").alias("component"), "first", "copies")
    info = materialize(linked_classes.drop("first").join(firsts, "component").select("node", "component", "first", "copies").unionByName(alone), "class-info")
    every = described.select("id", "text_hash", "size", "node")
    if info.count() <= broadcast_rows:
        named = every.join(F.broadcast(info), "node", "left")
    else:
        hot = info.where(F.col("copies") > hot_rows)
        if hot.count() > broadcast_rows:
            named = every.join(info, "node", "left")
        else:
            named = every.join(F.broadcast(hot), "node").unionByName(every.join(F.broadcast(hot.select("node")), "node", "left_anti").join(info.where(F.col("copies") <= hot_rows), "node", "left"), allowMissingColumns=True)
    has_words = F.col("size") > 0
    first = F.coalesce("first", row)
    return named.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("node").alias("class_id"), F.when(has_words, first["id"]).otherwise(F.col("id")).alias("component_id"),
        F.when(has_words, F.coalesce("component", "node")).alias("component"), "text_hash", F.when(has_words, first).alias("first"),
    )


def keep_one_of_each(docs: DataFrame, shingle: int = 5, at_least: tuple[int, int] = (80, 100), broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least id (then text hash).

    Rows without words all stay. Rows that agree in id and text count as one. What goes is
    broadcast up to ``broadcast_rows`` rows; beyond, it is joined by a shuffle. Null ids come last; an empty
    table stays empty; columns of any names stay as they are.
    """
    found = jaccard_components(docs, shingle, at_least, broadcast_rows=broadcast_rows, id_col=id_col, text_col=text_col)
    found = materialize(found.select(F.col(id_col).alias("id"), "text_hash", "first"), "near-copies").where("first IS NOT NULL")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gone = materialize(found.where(~same).select("id", "text_hash").distinct(), "gone")
    few = gone.count() <= broadcast_rows
    hashed = docs.withColumn(own := free_name(docs, "text_hash"), F.xxhash64(text_col))
    kept = hashed.join((F.broadcast(gone) if few else gone).alias("g"), hashed[id_col].eqNullSafe(F.col("g.id")) & (hashed[own] == F.col("g.text_hash")), "left_anti")
    if not found.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        worded = F.size(words(F.col(text_col))) > 0
        kept = kept.where(worded).dropDuplicates([id_col, own]).unionByName(kept.where(~worded))
    return kept.select(*docs.columns)


def _node(own: np.ndarray) -> np.uint64:
    """One hash for a whole set of sorted distinct shingles."""
    sums = np.stack([mix(own), mix(own ^ _U(0x5851F42D4C957F2D))]).sum(axis=1, dtype=_U)
    return mix(sums[:1] * _U(0x9FB21C651E98DF25) ^ (sums[1:] + _U(len(own))))[0]
