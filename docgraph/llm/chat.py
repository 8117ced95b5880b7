"""Chat formatting by token-level assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import slices, small_batches
from docgraph.llm.token_counts import rank_encoding

#: The template's control strings, opening and closing, for an assistant's turns and all others.
TEMPLATE = {True: ("<s>", "</s>"), False: ("[INST]", "[/INST]")}
CONTROL = [s for pair in TEMPLATE.values() for s in pair]
#: Reserved ids, after the vocabulary's.
FIRST_RESERVED = 50_257
RESERVED = {s: FIRST_RESERVED + k for k, s in enumerate(CONTROL)}
BREAK = FIRST_RESERVED + len(CONTROL)  # between a turn's role and its text, written as a line feed

_SPECIAL = re.compile("|".join(re.escape(s) for s in ["\\", *CONTROL]))
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """A backslash goes before every backslash and after the first character of every control string, so none is left."""
    if "<" not in text and "[" not in text and "\\" not in text:
        return text
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def assemble(roles: list[str], texts: list[str], encode) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(ids, loss mask, row bounds into both, formatted strings) of turns.

    Role and text are escaped and encoded each by itself; reserved ids are put around them. Steps of
    +1 where the loss mask begins and -1 where it ends are put down, and their prefix sums are the mask, which
    covers the text of an assistant's turn and nothing else.
    """
    ids: list[int] = []
    bounds, begin, end, formatted = [0], [], [], []
    head_of = lru_cache(4096)(lambda said: encode(said))
    for role, text in zip(roles, texts, strict=True):
        trained = role == "assistant"
        opening, closing = TEMPLATE[trained]
        said, content = escape(role).replace("\n", "\\\n"), escape(text)
        ids.append(RESERVED[opening])
        ids += head_of(said)
        ids.append(BREAK)
        if trained:
            begin.append(len(ids))
        ids += encode(content)
        if trained:
            end.append(len(ids))
        ids.append(RESERVED[closing])
        bounds.append(len(ids))
        formatted.append(f"{opening}{said}\n{content}{closing}")
    steps = np.zeros(len(ids) + 1, dtype=np.int32)
    np.add.at(steps, begin, 1)
    np.add.at(steps, end, -1)
    return np.array(ids, dtype=np.int32), np.cumsum(steps[:-1], dtype=np.int32), np.array(bounds, dtype=np.int64), formatted


class Decoder:
    """The bytes of each id of a rank file, one after another."""

    def __init__(self, path: str):
        tokens = rank_encoding(path)
        own = [tokens.decode_single_token_bytes(k) for k in range(tokens.n_vocab)]
        self.bytes, self.ends = np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum([0, *map(len, own)])

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of the ids, where those of each id begin, and the end); reserved ids have none."""
        plain = np.minimum(ids, len(self.ends) - 1)
        start, size = self.ends[plain], np.where(ids < len(self.ends) - 1, self.ends[np.minimum(plain + 1, len(self.ends) - 1)] - self.ends[plain], 0)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(start - (ends - size), size) + np.arange(total)].tobytes(), np.append(0, ends)


def read_back(ids: np.ndarray, mask: np.ndarray, bounds: np.ndarray, decoder: Decoder) -> tuple[list[str], list[str], list[str]]:
    """(roles, texts, texts under the mask) of the ids of turns: what lies between reserved ids, decoded and unescaped."""
    at = np.flatnonzero(ids >= FIRST_RESERVED).reshape(-1, 3)
    spoken, place = decoder.decode(ids)
    part = lambda a, b: [unescape(spoken[x:y].decode()) for x, y in zip(place[a].tolist(), place[b].tolist(), strict=True)]
    trained, place_of_mask = decoder.decode(ids[mask.astype(bool)])
    under = place_of_mask[np.append(0, np.cumsum(mask))[bounds]].tolist()
    return part(at[:, 0], at[:, 1]), part(at[:, 1], at[:, 2]), [unescape(trained[x:y].decode()) for x, y in zip(under[:-1], under[1:], strict=True)]


_DECODERS: dict[str, Decoder] = {}


def _decoder(path: str) -> Decoder:
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def format_turns(turns: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, n_ids, ids, loss_mask, formatted.

    Turns are formatted row by row, in any task and without a shuffle, so a conversation of any length is a run of rows,
    never one value. Null roles and texts are empty; a null conversation is one; repeated rows are turns each; a very long
    text is one row of as many ids. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    small_batches(turns.sparkSession)

    def assemble_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoding(path).encode_ordinary
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, mask, bounds, text = assemble([r or "" for r in batch.column(2).to_pylist()], [t or "" for t in batch.column(3).to_pylist()], encode)
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (ids, mask)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.diff(bounds), pa.int64()), *lists, pa.array(text, pa.string())], names=["conv_id", "turn", "n_ids", "ids", "loss_mask", "formatted"])

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(assemble_rows, "conv_id long, turn long, n_ids long, ids array<int>, loss_mask array<int>, formatted string")


def place_turns(formatted: DataFrame, block_turns: int = 1024) -> DataFrame:
    """``formatted`` with each turn's position in its conversation (from 1) and token_offset (ids of the conversation before it).

    Prefix sums in order of turn (nulls last), then formatted text, in two levels: blocks of ``block_turns`` turn numbers,
    whose sums are added up first, and turns within a block. So a very long conversation is spread over many tasks;
    only rows that share a turn number, or have none, stay together.
    """
    blocked = formatted.withColumns({"conv_key": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "block": F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(1 << 62))})
    key = ["conv_key", "block"]
    sums = blocked.groupBy(*key).agg(F.count("*").alias("turns"), F.sum("n_ids").alias("all_ids"))
    earlier = Window.partitionBy("conv_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*key, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("turns", "all_ids")])
    within = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_last(), "formatted")
    own = blocked.withColumns({"place": F.row_number().over(within), "ids_in": F.coalesce(F.sum("n_ids").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return own.join(before, key).select("conv_id", "turn", (F.col("place") + F.col("turns_before")).alias("position"), (F.col("ids_in") + F.col("all_ids_before")).alias("token_offset"), "n_ids", "ids", "loss_mask", "formatted")


def conversation_digests(formatted: DataFrame, path: str) -> DataFrame:
    """One row per conversation, read back from the ids: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Ids are read back in any task; what is shuffled is the texts, once. The digest of a conversation must see its turns in order (turn,
    nulls last, then role and text); they are streamed through it in a sorted partition, one row at a time, so memory
    doesn't grow with the conversation. A null conversation is one; an empty table gives no rows; other columns are not read.
    """
    small_batches(formatted.sparkSession)

    def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = batch.column(2).offsets.to_numpy().astype(np.int64)
            ids, mask = (batch.column(k).flatten().to_numpy() for k in (2, 3))
            roles, texts, under = read_back(ids, mask, bounds - bounds[0], decoder)
            # mostly all of a text or none is under the mask; a count of characters says so
            rest = [None if not u or u == t else u for u, t in zip(under, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(rest, pa.string()), pa.array(list(map(len, under)), pa.int64()), batch.column(4)],
                names=["conv_id", "turn", "role", "text", "loss", "loss_chars", "n_chars"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        begun, conv, turns, loss, counts = False, None, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        done: list[tuple] = []
        for batch in batches:
            for key, _, role, text, part, n_loss, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or key != conv:
                    if begun:
                        done.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
                    begun, conv, turns, loss, counts = True, key, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                turns.update(f"{role}\n{text}\n".encode())
                if n_loss:
                    loss.update((text if part is None else part).encode())
                counts[0] += 1
                counts[1] += n_loss
                counts[2] += chars
            yield _digest_batch(done, names)
            done = []
        if begun:
            yield _digest_batch([(conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])], names)

    columns = "conv_id long, turn long, role string, text string, loss string, loss_chars long, n_chars long"
    back = formatted.select("conv_id", "turn", "ids", "loss_mask", F.length("formatted").cast("long").alias("n_chars")).mapInArrow(decode_rows, columns)
    ordered = back.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
