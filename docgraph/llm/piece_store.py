"""Token ids of many texts at once, by way of their distinct pieces."""

from __future__ import annotations

import itertools
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that one Python worker keeps the ids of; the store is emptied when it is full, and cut down at a task's end.
KEPT_PIECES = 400_000
KEPT_BETWEEN_TASKS = 40_000

#: Endings that are pieces of their own after a single quote, and the steps of tokenizers whose pieces are found here.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WHITE_SPACE = "\\s+"
WORD_END = "</w>"

_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _classes() -> np.ndarray:
    """The class of each byte: of printable ASCII; all other bytes are odd, those of Latin-1 letters are found apart."""
    of = np.full(256, _ODD, dtype=np.uint8)
    of[33:127] = _SIGN
    of[48:58] = _DIGIT
    of[[*range(65, 91), *range(97, 123)]] = _LETTER
    of[[9, 10, 32]] = _BLANK
    return of


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one after U+0100 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def splits_as_here(path: str) -> bool:
    """Whether the tokenizer at ``path`` composes, lower-cases and splits texts as ``pieces`` does."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    steps = ((made.get("normalizer") or {}).get("normalizers") or [], (made.get("pre_tokenizer") or {}).get("pretokenizers") or [])
    if [s.get("type") for s in steps[0]] != ["NFC", "Replace", "Lowercase"] or [s.get("type") for s in steps[1]] != ["Split", "ByteLevel"]:
        return False
    space, split, model = steps[0][1], steps[1][0], made.get("model") or {}
    plain = not (made.get("post_processor") or made.get("truncation") or made.get("padding") or steps[1][1].get("add_prefix_space") or steps[1][1].get("use_regex"))
    special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made.get("added_tokens") or [])
    return plain and special and (space["pattern"], space["content"]) == ({"Regex": WHITE_SPACE}, " ") and split["pattern"] == {"Regex": PATTERN} and bool(split["invert"]) and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", WORD_END, None)


def pieces(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pieces of all rows, row bounds into them, which are odd) of UTF-8 rows that lie one after another.

    Pieces are what a lower-casing tokenizer encodes apart: runs of letters, single digits, runs of signs, endings
    after a single quote. Words with ``<|``, of which special tokens are made, and words with other bytes than those of
    printable ASCII and Latin-1 letters are odd: one piece each, as they stand.
    """
    n = len(raw)
    kind, text = _CLASS[raw], _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.empty(0, dtype=np.int64)
    follows = raw[lead + 1]
    latin = (follows != 0x97) & (follows != 0xB7)
    lead, follows = lead[latin], follows[latin]
    kind[lead] = kind[lead + 1] = _LETTER
    text[lead + 1] += np.where(follows < 0x9F, 32, 0).astype(np.uint8)

    row_starts = bounds[:-1][bounds[:-1] < n]
    inside = kind != _BLANK
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[:1] = _BLANK
    before[row_starts] = _BLANK
    begins = inside & ((kind != before) | (kind == _DIGIT))

    quotes = np.flatnonzero((raw == 39) & begins)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kind[quotes + 1] == _LETTER) & (before[quotes + 1] != _BLANK)]
    if len(quotes):
        padded = np.concatenate([text, np.zeros(3, dtype=np.uint8)])
        same_row = np.append(before, [_BLANK] * 3)
        for ending in ENDINGS:
            at = quotes[padded[quotes + 1] == ord(ending[0])]
            if len(ending) == 2:
                at = at[(padded[at + 2] == ord(ending[1])) & (same_row[at + 2] != _BLANK)]
            begins[at + 1] = False
            after = at + 1 + len(ending)
            after = after[after < n]
            begins[after[inside[after]]] = True

    odd_bytes = kind == _ODD
    if n > 1:
        odd_bytes[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
    odd_at = np.flatnonzero(odd_bytes)
    odd_start = np.empty(0, dtype=np.int64)
    if len(odd_at):
        word_starts = np.flatnonzero(inside & (before == _BLANK))
        word_ends = np.append(word_starts[1:], n)
        word = np.unique(np.searchsorted(word_starts, odd_at, side="right") - 1)
        odd_start = word_starts[word]
        steps = np.zeros(n + 1, dtype=np.int8)
        steps[odd_start] += 1
        steps[word_ends[word]] -= 1
        odd = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
        text[odd] = raw[odd]
        begins[odd] = False
        begins[odd_start] = True

    starts = np.flatnonzero(begins)
    offsets = np.append(np.flatnonzero(begins[inside]), int(inside.sum())).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])])
    is_odd = np.zeros(len(starts), dtype=bool)
    is_odd[np.searchsorted(starts, odd_start)] = True
    return found, np.searchsorted(starts, bounds), is_odd


class PieceStore:
    """Ids of the pieces met so far, in one array."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.splits = Tokenizer.from_file(path), splits_as_here(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)  # where the ids of piece k end is at k + 1

    def add(self, found: list[bytes], odd: set[bytes]) -> None:
        ids, sizes = array("I"), []
        tokenize = self.tokenizer.model.tokenize
        for piece in found:
            if piece in odd:
                own = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
            else:
                own = [t.id for t in tokenize(piece.decode() if piece.isascii() else piece.decode("latin-1").translate(_LETTERS))]
            ids.extend(own)
            sizes.append(len(own))
        n, used = len(self.known), int(self.ends[len(self.known)])
        self.ids = _room(self.ids, used + len(ids))
        self.ends = _room(self.ends, n + len(sizes) + 1)
        self.ids[used : used + len(ids)] = np.frombuffer(ids, dtype=np.uint32) if len(ids) else []
        self.ends[n + 1 : n + 1 + len(sizes)] = used + np.cumsum(sizes, dtype=np.int64)
        self.known.update(zip(found, range(n, n + len(found)), strict=True))

    def keep_first(self, n: int) -> None:
        """Keep what was met first, and so mostly is frequent."""
        if len(self.known) > n:
            used = int(self.ends[n])
            self.ids, self.ends = self.ids[:used].copy(), self.ends[: n + 1].copy()
            self.known = {piece: k for piece, k in self.known.items() if k < n}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows as unsigned 32-bit values, row bounds into them); null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.splits:
            own = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in own for i in x], dtype=np.uint32), np.cumsum([0, *map(len, own)])
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        found, rows, is_odd = pieces(raw, bounds - bounds[0])
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > KEPT_PIECES:
            self.clear()
        own = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(own < 0)
        if len(new):
            own[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.add([distinct[k] for k in new.tolist()], set(found.filter(pa.array(is_odd)).to_pylist()) if is_odd.any() else set())
        code = coded.indices.to_numpy()
        start, size = self.ends[own][code], (self.ends[own + 1] - self.ends[own])[code]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.append(0, ends)[rows]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, copied to at least twice its length if it is shorter than ``n``."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])


_STORES: dict[str, PieceStore] = {}


def piece_store(path: str) -> PieceStore:
    """The store of the tokenizer at ``path``; one per worker."""
    if path not in _STORES:
        _STORES[path] = PieceStore(path)
    return _STORES[path]
