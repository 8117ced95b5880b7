"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import free_memory, materialize, slices, small_batches
from docgraph.llm.piece_store import KEPT_BETWEEN_TASKS, piece_store

def differencing(sizes: np.ndarray, ways: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``ways`` parts of near-equal sums.

    Karmarkar-Karp for several ways: each item begins as a partial partition of
    its own; the two with the largest spread merge, the largest part of one with
    the smallest of the other, until one is left. A partial partition keeps its sums in
    falling order without the empty ones; which part went where is kept per merge and
    followed back at the end.
    """
    n = len(sizes)
    if not n:
        return []
    heap = [(-int(size), k) for k, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {k: sizes[k : k + 1].astype(np.int64) for k in range(n)}
    merges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        of_a, of_b = sums.pop(a), sums.pop(b)
        width = min(ways, len(of_a) + len(of_b))
        # place of each part of a from the front, of each part of b from the back
        at_b = width - 1 - np.arange(len(of_b))
        total = np.zeros(width, dtype=np.int64)
        total[: len(of_a)] = of_a
        total[at_b] += of_b
        order = np.argsort(-total, kind="stable")
        place = np.empty(width, dtype=np.int64)
        place[order] = np.arange(width)
        merged = total[order]
        made = n + len(merges)
        merges.append((a, b, place[: len(of_a)], place[at_b]))
        sums[made] = merged
        heapq.heappush(heap, (-int(merged[0] - (merged[-1] if width == ways else 0)), made))
    where: dict[int, np.ndarray] = {heap[0][1]: np.arange(len(sums[heap[0][1]]))}
    for made in range(n + len(merges) - 1, n - 1, -1):
        a, b, place_a, place_b = merges[made - n]
        own = where.pop(made)
        where[a], where[b] = own[place_a], own[place_b]
    parts: list[list[int]] = [[] for _ in range(ways)]
    for k in range(n):
        parts[int(where[k][0])].append(k)
    return parts


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Parts of ``sizes`` (each at most ``capacity``), none with a sum over ``capacity``; their number rises until that holds."""
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        parts = differencing(sizes, ways)
        if all(int(sizes[p].sum()) <= capacity for p in parts):
            return [p for p in parts if p]
        ways += max(1, ways // 100)


def cut_rows(ids: np.ndarray, rows: np.ndarray, end_id: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """(row, start, length, crc32, row's ids) of the pieces of each row of ``ids``, an end id put after each row."""
    tail = np.array([end_id], dtype="<u4").tobytes()
    sizes = np.diff(rows) + 1
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
    length = np.minimum(capacity, sizes[row] - start)
    view = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    first = 4 * (rows[row] + start)
    last = np.minimum(first + 4 * length, 4 * rows[row + 1])  # without the end id
    ends = (start + length == sizes[row]).tolist()
    crc = [zlib.crc32(tail, zlib.crc32(view[a:b])) if end else zlib.crc32(view[a:b]) for a, b, end in zip(first.tolist(), last.tolist(), ends, strict=True)]
    return row, start, length, crc, sizes[row]


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, batch_items: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document's ids into pieces and pack these into windows of ``capacity`` ids.

    A document of several windows' length is cut into full windows, which need no
    packing, and a rest. The rests are dealt by a random key into batches of about
    ``batch_items``; in each, differencing gives near-equal windows, one more at a
    time while any is over ``capacity``. No task holds more than one batch at a time, whatever
    the number of documents, and equal rows are dealt apart.

    Returns one row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null, empty and blank texts are the end id alone; very long ones are read whole. Repeated rows are packed as
    often as they come; ties in size fall in order of the pieces' row numbers. A null id is kept as null; an empty
    table gives no rows. Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = piece_store(path)
        try:
            for whole in batches:
                for batch in slices(whole, "text", 1 << 21):
                    row, *numbers = cut_rows(*store.encode(batch.column(1)), end_id, capacity)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in numbers)], names=["id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            store.keep_first(KEPT_BETWEEN_TASKS)  # a worker lives on after its task, and others need its memory
            free_memory()

    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    rests = pieces.where(F.col("length") < capacity)
    batches = max(1, -(-rests.count() // batch_items))
    dealt = rests.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(batches)).alias("batch"))

    def place(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid", ignore_index=True)
        sizes = part["length"].to_numpy()
        window, offset = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        for w, members in enumerate(windows(sizes, capacity)):
            window[members] = w
            offset[members] = np.cumsum(sizes[members]) - sizes[members]
        return pd.DataFrame({"uid": part["uid"], "sequence_id": int(key[0]) * (1 << 32) + window, "offset": offset})

    tasks = min(100_000, -(-batches // 16))  # a stated number, as a batch is more work than its bytes say
    placed = dealt.repartition(tasks, "batch").groupBy("batch").applyInPandas(place, "uid long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    return rests.join(placed, "uid").unionByName(full).drop("uid").withColumnRenamed("id", id_col)
