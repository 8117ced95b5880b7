"""Duplicate pages, within a document and over the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.text import normalize_page
from docgraph.operators.vectors import alike_pairs
from docgraph.sources.shared import stored


def exact_clusters(pages: DataFrame, within: str | None = "doc_id", page: str = "nonblank_page_no") -> DataFrame:
    """Pages of equal normalized text: [doc_id,] page_hash, pages (sorted), score 1.0; ``within=None`` clusters over all documents.

    Grouping by the hash of the text keeps texts out of the shuffle. A cluster is one value, so over a corpus with very
    large clusters take ``cluster_members`` instead.
    """
    keys = [within] if within else []
    hashed = pages.select(*keys, F.md5(normalize_page(F.col("text")).cast("binary")).alias("page_hash"), page)
    return hashed.groupBy(*keys, "page_hash").agg(F.array_sort(F.collect_list(page)).alias("pages")).where(F.size("pages") > 1).withColumn("score", F.lit(1.0))


def cluster_members(pages: DataFrame, id_col: str) -> DataFrame:
    """id, page_hash, representative (least id) and cluster size of every page whose normalized text occurs more than once over the corpus.

    Texts are hashed once: the hashes are written and read again.
    """
    hashed = stored(pages.select(id_col, F.md5(normalize_page(F.col("text")).cast("binary")).alias("page_hash")), "hashes")
    groups = hashed.groupBy("page_hash").agg(F.min(id_col).alias("representative"), F.count("*").alias("n_pages")).where("n_pages > 1")
    return hashed.join(groups, "page_hash")


def near_pairs(pages: DataFrame, vectors: DataFrame, at_least: float = 0.9, page: str = "nonblank_page_no") -> DataFrame:
    """doc_id, first, second, score of page pairs of a document with lengths within a quarter and cosine of at least 0.9.

    Pages (doc_id, page, text) and vectors (doc_id, page, vec). Exact pairs are among them; ``reconcile`` removes these. A document's pages are
    compared in tiles of bounded size (``vectors.alike_pairs``), which give out near pairs only.
    """
    sized = pages.select("doc_id", page, F.length(normalize_page(F.col("text"))).alias("size")).join(vectors, ["doc_id", page])
    return alike_pairs(stored(sized.select("doc_id", F.col(page).alias("id"), "size", "vec"), "pages"), at_least)


def duplicate_report(pages: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, total_pages, duplicates: array of (pages, score), exact clusters and near pairs."""
    entries = exact.select("doc_id", "pages", "score").unionByName(near.select("doc_id", F.array("first", "second").alias("pages"), "score"))
    lists = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pages", "score"))).alias("duplicates"))
    totals = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"))
    return totals.join(lists, "doc_id", "left").select("doc_id", "total_pages", F.coalesce("duplicates", F.array().cast("array<struct<pages:array<int>,score:double>>")).alias("duplicates"))


def reconcile(entries: DataFrame) -> DataFrame:
    """(doc_id, pages, score) -> doc_id, first, second, score, rank: two-page entries only.

    Exact pairs once; of near pairs the best score per unordered pair, without those that touch a page of an exact pair; by falling score.
    """
    pairs = entries.where(F.size("pages") == 2).select("doc_id", F.array_min("pages").alias("first"), F.array_max("pages").alias("second"), "score")
    exact = pairs.where("score = 1.0").distinct()
    near = pairs.where("score < 1.0").groupBy("doc_id", "first", "second").agg(F.max("score").alias("score"))
    taken = exact.select("doc_id", F.col("first").alias("page")).union(exact.select("doc_id", "second")).distinct()
    for side in ("first", "second"):
        near = near.join(taken.withColumnRenamed("page", side), ["doc_id", side], "left_anti")
    both = exact.unionByName(near)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "first", "second")))


def lsh_shape(n: int, at_least: float, recall: float, bucket_rows: int = 512) -> tuple[int, int]:
    """(planes, tables) for ``n`` vectors: enough planes for buckets of about ``bucket_rows`` unlike ones, and enough tables for the recall asked.

    A random plane parts two vectors with a probability of their angle over pi, so two that are just ``at_least`` alike share all signs of a table with
    the power of the rest to the number of planes, and miss each other in all tables with the power of the complement to the number of these. Liker ones do so less.
    A bucket's pairs are matrix products, which cost less than sending its rows once more, so buckets are large and tables few.
    """
    planes = min(24, max(8, math.ceil(math.log2(max(n, 1) / bucket_rows))))
    same = (1 - math.acos(max(-1.0, min(1.0, at_least))) / math.pi) ** planes
    return planes, 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same))


def near_pages_lsh(vectors: DataFrame, at_least: float = 0.9, recall: float = 0.95, seed: int = 1, id_col: str = "id", block_rows: int = 65536, planes: int | None = None, tables: int | None = None, n_hubs: int = 1024) -> DataFrame:
    """(first, second, score) links over the corpus: sign hashes of random planes give buckets, whose members are compared with each other.

    Equal vectors are one class: each member has a link to the class's least id, and only that is hashed. Classes near one of
    ``n_hubs`` hubs (chosen by a hash of the id) are linked to it first, and to one hub of each other group of hubs that they are near to; whatever is joined
    so is not compared again. All other pairs of a bucket are compared; one of more than ``block_rows`` is dealt into blocks (``in_tasks``), and each pair of
    blocks is a task. A task gives a forest of links that connects what its pairs of ``at_least`` connect, so many near copies don't give all their pairs, and
    documents joined by near pairs are reached along links. Pairs that share a hash in no table are not compared: planes and tables are chosen
    (``lsh_shape``) so that a pair just ``at_least`` alike shares one with a probability of ``recall``, at any size of the corpus; the
    tests measure it.
    Null vectors and vectors with null or NaN in them have no links.
    """
    spark = vectors.sparkSession
    given = stored(vectors.select(F.col(id_col).alias("id"), F.col("vec").cast("array<double>").alias("vec")), "vectors")  # stored before the filter, which would have the vectors made twice
    usable = given.where("vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL OR isnan(x)) AND exists(vec, x -> x != 0)")
    classes = stored(usable.groupBy("vec").agg(F.min("id").alias("id")), "classes")
    shape = lsh_shape(classes.count(), at_least, recall)
    planes, tables = planes or shape[0], tables or shape[1]
    copies = usable.join(classes.withColumnRenamed("id", "first"), "vec").where("id != first").select("first", F.col("id").alias("second"), F.lit(1.0).alias("score"))

    kind = usable.schema["id"].dataType.simpleString()
    chosen = classes.orderBy(F.xxhash64("id"), "id").limit(n_hubs).collect()
    hubs, group, links = _hub_groups([r.vec for r in chosen], at_least)
    found = stored(classes.mapInArrow(lambda batches: _near_hubs(batches, hubs, group, at_least), f"id {kind}, vec array<double>, hubs array<int>, scores array<double>, groups array<int>"), "hubs")
    pairs = found.where(F.size("groups") > 1).select(F.col("groups")[0].alias("a"), F.explode(F.slice("groups", 2, n_hubs)).alias("b")).distinct().collect()  # at most a pair of hubs each
    group_of = _joined(len(chosen), [(r.a, r.b) for r in pairs])
    names = F.broadcast(spark.createDataFrame([(k, r.id) for k, r in enumerate(chosen)], f"hub int, hub_id {kind}"))
    to_hubs = found.select("id", F.explode(F.arrays_zip("hubs", "scores")).alias("x")).select("id", F.col("x.hubs").alias("hub"), "x.scores").join(names, "hub").where("id != hub_id").select(F.least("id", "hub_id").alias("first"), F.greatest("id", "hub_id").alias("second"), F.col("scores").alias("score"))
    between = spark.createDataFrame([(*sorted((chosen[a].id, chosen[b].id)), score) for a, b, score in links], f"first {kind}, second {kind}, score double")

    own = found.select("id", "vec", F.when(F.size("groups") > 0, F.element_at(F.lit(group_of.tolist() or [0]), F.col("groups")[0] + 1)).otherwise(-1).cast("int").alias("group"))
    keyed = lambda vecs: own.mapInArrow(lambda batches: _buckets(batches, planes, tables, seed, vecs), f"id {kind}, group int, {'vec array<double>, ' if vecs else ''}bucket long")
    members = in_tasks(keyed(True), keyed(False), block_rows).repartition("task").sortWithinPartitions("task", "side", "id")
    near = members.mapInArrow(lambda batches: _links(batches, at_least), f"first {kind}, second {kind}, score double")
    return near.unionByName(to_hubs).unionByName(between).groupBy("first", "second").agg(F.max("score").alias("score")).unionByName(copies)


def in_tasks(rows: DataFrame, keys: DataFrame, block_rows: int) -> DataFrame:
    """Rows (id, group, bucket, ..) with the tasks that they belong to: task, side (0 or 1), inside (whether the side's own pairs are this task's).

    ``keys`` are the same rows, or their group and bucket. A bucket of up to ``block_rows`` is a task. In a larger one the largest group is joined within itself already,
    so its blocks meet those of the other rows only, and these meet all: the rows dealt grow with the bucket, times the blocks of rows outside that group.
    """
    by_group = keys.groupBy("bucket", "group").agg(F.count("*").alias("n"))
    sizes = by_group.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.when(F.col("group") >= 0, F.struct("n", "group"))).alias("top")).where(F.col("n") > block_rows)
    blocks = lambda n: F.ceil(n * 2 / block_rows).cast("int")
    top = F.coalesce("top.n", F.lit(0))
    large = sizes.select("bucket", F.col("top.group").alias("top"), blocks(F.col("n") - top).alias("rest"), blocks(top).alias("most"))
    dealt = rows.join(F.broadcast(large), "bucket", "left")
    in_top = F.coalesce(F.col("group") == F.col("top"), F.lit(False))
    turn = lambda n: F.pmod(F.xxhash64("id", F.lit(11)), F.greatest(n, F.lit(1))).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("rest").isNull(), 0).when(in_top, F.col("rest") + turn(F.col("most"))).otherwise(turn(F.col("rest"))))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    others = F.when(F.col("rest").isNull(), F.array(F.lit(0))).when(in_top, upto(F.col("rest"))).otherwise(F.array_except(upto(F.col("rest") + F.col("most")), F.array("own")))
    other, parts = F.col("other"), F.col("rest") + F.col("most")
    inside = F.when(F.col("rest").isNull(), True).when(in_top, False).otherwise(other == F.pmod(F.col("own") + 1, parts))
    columns = [c for c in rows.columns if c != "bucket"]
    return dealt.withColumn("other", F.explode(others)).select(*columns, F.xxhash64("bucket", F.least("own", other), F.greatest("own", other)).alias("task"), (F.col("own") > other).cast("int").alias("side"), inside.alias("inside"))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of each width in a column of lists."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(width))


def _unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.nan_to_num(v / np.sqrt((v * v).sum(axis=1, keepdims=True)))  # infinite ones are near nothing


def _buckets(batches: Iterator[pa.RecordBatch], planes: int, tables: int, seed: int, vecs: bool = False) -> Iterator[pa.RecordBatch]:
    """(id, .., vec) -> id, .., bucket, with the vectors if ``vecs``: one row per table, the signs of its planes as bits after the vector's width and the table's number."""
    normals: dict[int, np.ndarray] = {}
    for batch in batches:
        names = [c for c in batch.schema.names if c != "vec"] + ["vec"] * vecs
        for own, v in _vectors(batch.column("vec")):
            width = v.shape[1]
            if width not in normals:
                normals[width] = np.random.default_rng([seed, width]).normal(size=(width, tables * planes))
            signs = (v @ normals[width] > 0).reshape(len(own), tables, planes)
            bits = signs @ (1 << np.arange(planes, dtype=np.int64))
            kept = [batch.column(c).take(pa.array(own)) for c in names]
            for table in range(tables):
                yield pa.RecordBatch.from_arrays([*kept, pa.array(((width * tables + table) << planes) + bits[:, table])], names=[*names, "bucket"])


def _joined(n: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The least number that each of ``n`` numbers is joined with by ``pairs``."""
    root = np.arange(n)
    for a, b in pairs:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    while (root[root] != root).any():
        root = root[root]
    return root


def _hub_groups(vecs: list[list[float]], at_least: float) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray, list[tuple[int, int, float]]]:
    """Hubs by width (numbers, unit vectors), the group of each, the links that make these groups."""
    hubs, links = {}, []
    for width in {len(x) for x in vecs}:
        numbers = np.array([k for k, x in enumerate(vecs) if len(x) == width])
        v = _unit(np.array([vecs[k] for k in numbers]))
        hubs[width] = numbers, v
        links += [(int(numbers[a]), int(numbers[b]), float(score)) for a, b, score in zip(*_forest(v, at_least), strict=True)]
    return hubs, _joined(len(vecs), [x[:2] for x in links]), links


def _near_hubs(batches: Iterator[pa.RecordBatch], hubs: dict[int, tuple[np.ndarray, np.ndarray]], group: np.ndarray, at_least: float, tile_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """(id, vec) -> id, vec, and the nearest hub of each group with one of ``at_least``: hubs, scores, groups."""
    sorted_hubs = {}
    for width, (numbers, v) in hubs.items():
        order = np.argsort(group[numbers], kind="stable")
        sorted_hubs[width] = numbers[order], np.ascontiguousarray(v[order].T), np.flatnonzero(np.append(True, np.diff(group[numbers[order]]) != 0))
    for batch in batches:
        for own, v in _vectors(batch.column("vec")):
            for at in range(0, len(own), tile_rows):
                rows = own[at : at + tile_rows]
                row, hub, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
                if v.shape[1] in sorted_hubs:
                    numbers, h, starts = sorted_hubs[v.shape[1]]
                    scores = _unit(v[at : at + tile_rows]) @ h
                    row, part = np.nonzero(np.maximum.reduceat(scores, starts, axis=1) >= at_least)
                    column, ends = np.empty(len(row), dtype=np.int64), np.append(starts[1:], len(numbers))
                    for k in np.unique(part):
                        hit = part == k
                        column[hit] = starts[k] + scores[row[hit], starts[k] : ends[k]].argmax(axis=1)
                    hub, score = numbers[column], np.minimum(scores[row, column], 1.0)
                ends = pa.array(np.searchsorted(row, np.arange(len(rows) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(hub, pa.int32()), pa.array(score, pa.float64()), pa.array(group[hub], pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("id", "vec")), *lists], names=["id", "vec", "hubs", "scores", "groups"])


def _forest(v: np.ndarray, at_least: float, group: np.ndarray | None = None, side: np.ndarray | None = None, inside: tuple[bool, bool] = (True, True), tile_rows: int = 512, tile_columns: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, score) links that connect the unit rows whose product is ``at_least`` or more, where ``group`` (-1: none) doesn't connect them already.

    Rows between two sides, and those of a side if ``inside``, are compared in tiles by single-precision products; what may be near is computed in double precision. Rows spread over all come first:
    they join dense parts, and a tile of rows that are joined leaves out all others that are joined with them.
    """
    group = np.full(len(v), -1) if group is None else group
    side = np.zeros(len(v), dtype=np.int64) if side is None else side
    known, at = np.unique(group, return_inverse=True)
    comp = np.where(group < 0, len(known) + np.arange(len(v)), at)
    root = np.arange(len(known) + len(v))
    low, line, links = v.astype(np.float32), at_least - 1e-5, []

    def top(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal comp, root
        for at in range(0, len(i), 65536):
            a, b = i[at : at + 65536], j[at : at + 65536]
            apart = comp[a] != comp[b]
            a, b = a[apart], b[apart]
            score = np.einsum("ij,ij->i", v[a], v[b])
            a, b, score = (x[score >= at_least] for x in (a, b, score))
            one, two = np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])
            first = np.unique(one * len(root) + two, return_index=True)[1]
            for k in first.tolist():
                x, y = top(one[k]), top(two[k])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((a[k], b[k], score[k]))
            if len(first):
                while (root[root] != root).any():
                    root = root[root]
                comp = root[comp]

    def compare(rows: np.ndarray, columns: np.ndarray | slice) -> None:
        numbers, left = np.arange(len(v))[columns], [(rows[:0], rows[:0])]
        for at in range(0, len(numbers), tile_columns):  # products that stay in the cache
            part = numbers[at : at + tile_columns]
            scores = low[rows] @ low[part[0] : part[-1] + 1].T if isinstance(columns, slice) else low[rows] @ low[part].T
            if not scores.max() >= line:
                continue
            hit = np.flatnonzero(scores.ravel() >= line)
            if len(hit) > 4 * len(part):
                best = scores.argmax(axis=0)
                near = np.flatnonzero(scores[best, np.arange(len(part))] >= line)
                join(rows[best[near]], part[near])
            i, j = rows[hit // len(part)], part[hit % len(part)]
            apart = comp[i] != comp[j]
            left.append((i[apart], j[apart]))
            if sum(len(x) for x, _ in left) > 1 << 20:
                join(*map(np.concatenate, zip(*left)))
                left = left[:1]
        join(*map(np.concatenate, zip(*left)))

    compare(np.unique(np.linspace(0, len(v) - 1, min(tile_rows, len(v))).astype(np.int64)), slice(None))
    order = np.lexsort((comp, side))
    if len(v) > tile_rows:
        v, low, comp, side = v[order], low[order], comp[order], side[order]
        of_first, found, links = int((side == 0).sum()), links, []
        for begin, end, own in ((0, of_first, inside[0]), (of_first, len(v), inside[1])):
            for at in range(begin, end, tile_rows):
                rows = np.arange(at, min(end, at + tile_rows))
                start = at if own else of_first if begin == 0 else len(v)
                columns = slice(start, None)
                if (comp[rows] == comp[at]).all():
                    columns = start + np.flatnonzero(comp[start:] != comp[at])
                if start < len(v) and (isinstance(columns, slice) or len(columns)):
                    compare(rows, columns)
        links = found + [(order[a], order[b], score) for a, b, score in links]
    a, b, score = zip(*links, strict=True) if links else ((), (), ())
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(score, dtype=np.float64)


def _links(batches: Iterator[pa.RecordBatch], at_least: float) -> Iterator[pa.RecordBatch]:
    """Links among the members (task, side, inside, id, group, vec), sorted by task, of each task."""

    def link(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if len(rows) < 2:
            return
        v = _unit(rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
        group, side, inside = (rows.column(c).to_numpy() for c in ("group", "side", "inside"))
        a, b, score = _forest(v, at_least, group, side, (bool(inside[side == 0].any()), bool(inside[side == 1].any())))
        ids = rows.column("id").combine_chunks()
        one, two = ids.take(pa.array(a)), ids.take(pa.array(b))
        ordered = pc.less(one, two)
        yield pa.RecordBatch.from_arrays([pc.if_else(ordered, one, two), pc.if_else(ordered, two, one), pa.array(np.minimum(score, 1.0))], names=["first", "second", "score"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        task = batch.column("task").to_numpy()
        starts = np.flatnonzero(np.append(True, task[1:] != task[:-1])) if len(task) else np.empty(0, dtype=np.int64)
        for a, b in zip(starts, np.append(starts[1:], len(task))):
            if task[a] != last and held:
                yield from link(held)
                held = []
            last = task[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from link(held)
