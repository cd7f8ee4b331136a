"""SentencePiece (BPE) encoding and decoding in vectorised merge rounds.

A text is cut into words: runs of the space mark with what follows them.  No piece of a vocabulary that this
module accepts for cutting has a space mark after another character, so no merge crosses a cut.  Nor does one cross two neighbouring characters that stand
together in no piece, so words are cut there too, which keeps even a text without spaces in short stretches.  Distinct words are encoded together:
all their symbols lie in one flat array; each round finds every stretch's lowest pair rank by a segmented minimum, merges such pairs of all stretches at once from the left, as far as no
merge makes a pair that would come before the next of them, compacts the array, and drops the stretches in which no pair is left.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Bytes of text encoded at a time; words remembered in a worker.
SLICE_BYTES, REMEMBERED = 1 << 18, 60_000
_NO_RANK = np.int64(1) << 62
_NORMAL, _UNKNOWN, _CONTROL, _USER_DEFINED, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


class PieceModel:
    """A BPE model file with the identity normaliser and byte fallback."""

    def __init__(self, data: bytes) -> None:
        self.pieces, scores, kinds, normalizer = [], [], [], {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, _NORMAL))
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(1) != b"identity" or normalizer.get(4, 1) or _BYTE not in kinds:
            raise ValueError("only models with the identity normaliser, kept white space and byte fallback are supported")
        if _USER_DEFINED in kinds or _UNUSED in kinds:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefixed = bool(normalizer.get(3, 1))
        self.unknown, self.end = kinds.index(_UNKNOWN), self.pieces.index("</s>")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = frozenset(i for i, k in enumerate(kinds) if k == _CONTROL)
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == _NORMAL}
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in normal)
        self.surfaces = [p.replace(SPACE, " ") if k == _NORMAL else "" for p, k in zip(self.pieces, kinds)]
        self.surfaces[self.unknown] = " ⁇ "
        # symbols: ids of pieces, then characters that are only parts of pieces
        self.symbols = dict(normal)
        for piece in normal:
            for c in piece:
                self.symbols.setdefault(c, len(self.pieces) + len(self.symbols))
        self._stride = len(self.pieces) + len(self.symbols) + 1
        self.no_symbol = self._stride - 1
        self._symbol_of = np.full(0x110000, self.no_symbol, dtype=np.int32)
        for piece, i in self.symbols.items():
            if len(piece) == 1:
                self._symbol_of[ord(piece)] = i
        # a byte below 128 is a character of its own, wherever it stands
        for b, i in self.bytes.items():
            if b < 128:
                self.surfaces[i] = chr(b)
                if self._symbol_of[b] == self.no_symbol:
                    self._symbol_of[b] = i
        self._is_byte = np.array([k == _BYTE and self.byte_of[i] > 127 for i, k in enumerate(kinds)])
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self._stride + right] = (order[scores[i]], i)
        self._keys = np.array(sorted(pairs), dtype=np.int64)
        self._ranks = np.array([pairs[k][0] for k in self._keys.tolist()], dtype=np.int64)
        self._merged = np.array([pairs[k][1] for k in self._keys.tolist()], dtype=np.int64)
        self._together = np.array(sorted({ord(a) << 21 | ord(b) for piece in normal for a, b in zip(piece, piece[1:])}), dtype=np.int64)
        self.reset()

    def reset(self) -> None:
        """Forget the words seen so far."""
        self._place, self._starts, self._ids, self._size = {}, [np.zeros(1, dtype=np.int64)], [], 0

    # -- encoding of words ---------------------------------------------------------------

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * self._stride + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        known = self._keys[at] == keys
        return np.where(known, self._ranks[at], _NO_RANK), self._merged[at]

    def _merge_rounds(self, symbol: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' symbols in a row, and each word's number of symbols, before and after merging."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbol), _NO_RANK)
        result = np.zeros(len(symbol), dtype=np.int64)

        def refresh(at: np.ndarray) -> None:
            """Rank of the pair that begins at each position, none at a word's last symbol."""
            inside = at[at < len(symbol) - 1]
            inside = inside[word[inside] == word[inside + 1]]
            rank[at] = _NO_RANK
            rank[inside], result[inside] = self._lookup(symbol[inside], symbol[inside + 1])

        refresh(np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbol)])
            settled = least == _NO_RANK
            if settled.any():
                stay = np.repeat(~settled, size)
                done.append((symbol[~stay], word[~stay]))
                symbol, word, rank, result = symbol[stay], word[stay], rank[stay], result[stay]
                least, size = least[~settled], size[~settled]
                if not len(symbol):
                    break
                first = np.r_[0, np.cumsum(size)[:-1]]
            hits = np.flatnonzero(rank == np.repeat(least, size))
            merged = self._without_interruption(hits, symbol, word, rank, result)
            symbol[merged] = result[merged]
            stay = np.ones(len(symbol), dtype=bool)
            stay[merged + 1] = False
            moved = merged - np.arange(len(merged))  # each earlier merge took one symbol out
            symbol, word, rank, result = symbol[stay], word[stay], rank[stay], result[stay]
            refresh(np.r_[moved, moved[moved > 0] - 1])
        if not done:
            return symbol, np.zeros(len(lengths), dtype=np.int64)
        symbol, word = (np.concatenate(x) for x in zip(*done))
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))

    def _without_interruption(self, hits: np.ndarray, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, result: np.ndarray) -> np.ndarray:
        """Of the lowest pairs of each word those that are merged one after the other, from the left, before any other pair.

        Of overlapping pairs every other one; and none after a merge whose new pairs, with the symbols that stand beside it at that time, rank as low.
        """
        if not len(hits):
            return hits
        n, at = len(symbol), np.arange(len(hits))
        run = np.maximum.accumulate(np.where(np.r_[True, hits[1:] != hits[:-1] + 1], at, 0))
        hits = hits[(at - run) % 2 == 0]
        of = word[hits]
        several = np.r_[False, of[1:] == of[:-1]]
        several[:-1] |= several[1:]
        if not several.any():
            return hits
        some = hits[several]
        made, own, least = result[some], word[some], rank[some]
        right, left = np.minimum(some + 2, n - 1), np.maximum(some - 1, 0)
        has_right, has_left = (some + 2 < n) & (word[right] == own), (some > 0) & (word[left] == own)
        before = np.where(np.r_[False, some[1:] == some[:-1] + 2], np.r_[made[:1], made[:-1]], symbol[left])
        bad = has_right & (self._lookup(made, symbol[right])[0] <= least)
        bad |= has_left & (self._lookup(before, made)[0] <= least)
        earlier = np.cumsum(bad) - bad
        first = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(len(some)), 0))
        keep = np.ones(len(hits), dtype=bool)
        keep[several] = earlier == earlier[first]
        return hits[keep]

    def _ids_of(self, symbols: list[int], word: str) -> list[int]:
        """Symbols to ids; characters that are no piece become their UTF-8 bytes."""
        ids, at = [], 0
        for s in symbols:
            if s < len(self.pieces):
                ids.append(s)
                at += 1 if s in self.byte_of else len(self.pieces[s])
            else:
                ids.extend(self.bytes[b] for b in word[at].encode("utf-8"))
                at += 1
        return ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each); no word is empty, its spaces are space marks."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        symbol = self._symbol_of[points].astype(np.int64)
        keys = (points[:-1] << 21) | points[1:]
        at = np.minimum(np.searchsorted(self._together, keys), len(self._together) - 1)
        cut = np.r_[True, self._together[at] != keys]
        ends = np.cumsum(lengths)
        cut[ends[:-1]] = True
        start = np.flatnonzero(cut)
        merged, sizes = self._merge_rounds(symbol, np.diff(np.r_[start, len(symbol)]))
        sizes = np.add.reduceat(sizes, np.searchsorted(start, ends - lengths))
        if not (len(merged) and int(merged.max()) >= len(self.pieces)):
            return merged.astype(np.int32), sizes
        # words with characters that are no piece, one by one
        out: list[list[int]] = []
        at = 0
        for w, size in zip(words, sizes.tolist()):
            ids = merged[at : at + size].tolist()
            at += size
            out.append(ids if max(ids) < len(self.pieces) else self._ids_of(ids, w))
        return np.fromiter(chain.from_iterable(out), dtype=np.int32), np.fromiter(map(len, out), dtype=np.int64, count=len(out))

    # -- texts ---------------------------------------------------------------------------

    _WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def words_of(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (SPACE if self.prefixed else "") + text.replace(" ", SPACE)
        return self._WORDS.findall(marked) if self.cuttable else [marked]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of all texts, an end id after each; where each text's ids end)."""
        if len(self._place) > REMEMBERED:
            self.reset()
        cut = [self.words_of(t) for t in texts]
        place = self._place
        fresh = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in place]
        for start in range(0, len(fresh), 1 << 16):
            part = fresh[start : start + (1 << 16)]
            ids, sizes = self.encode_words(part)
            place.update(zip(part, range(len(place), len(place) + len(part))))
            self._ids.append(ids)
            self._starts.append(self._size + np.cumsum(sizes))
            self._size += len(ids)
        self._ids, self._starts = [np.concatenate(self._ids or [np.zeros(0, np.int32)])], [np.concatenate(self._starts)]
        store, starts = self._ids[0], self._starts[0]
        which = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), dtype=np.int64)
        begin, size = starts[which], starts[which + 1] - starts[which]
        word_ends = np.cumsum(size)
        total = int(word_ends[-1]) if len(which) else 0
        flat = store[np.arange(total) + np.repeat(begin - (word_ends - size), size)]
        ends = np.r_[0, word_ends][np.cumsum([len(words) for words in cut], dtype=np.int64)]
        return np.insert(flat, ends, self.end), ends + np.arange(1, len(texts) + 1)

    def decode_batch(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of what ``encode_batch`` returns."""
        values, bounds = flat.tolist(), [0, *ends.tolist()]
        runs = np.r_[0, np.cumsum(self._is_byte[flat])][np.r_[0, ends]]
        return [self.decode(values[a:b], has_bytes) for a, b, has_bytes in zip(bounds, bounds[1:], (np.diff(runs) > 0).tolist())]

    def decode(self, ids: list[int], has_bytes: bool = True) -> str:
        """Text of the ids: pieces joined, runs of byte pieces read as UTF-8, the prefix's space dropped."""
        surfaces, byte_of = self.surfaces, self.byte_of
        if self.prefixed:
            at = next((k for k, i in enumerate(ids) if i not in self.silent), None)
            dropped = at is not None and ids[at] not in byte_of and ids[at] != self.unknown and surfaces[ids[at]].startswith(" ")
        else:
            dropped = False
        if not has_bytes:
            text = "".join(map(surfaces.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in byte_of:
                    run.append(byte_of[i])
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run.clear()
                parts.append(surfaces[i])
            parts.append(run.decode("utf-8", "replace"))
            text = "".join(parts)
        return text[1:] if dropped else text


_MODELS: dict[int, tuple[bytes, PieceModel]] = {}


def _loaded(data: bytes) -> PieceModel:
    key = hash(data)
    if key not in _MODELS:
        _MODELS[key] = (data, PieceModel(data))
    return _MODELS[key][1]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def encode_and_decode(docs: DataFrame, model_path: str, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus ``ids array<int>`` (with an end id) and ``decoded string``.

    Whole texts of any length; a null or empty text has the end id alone and decodes to ''.  Of pairs with one rank the leftmost is merged first.  Rows are independent, so repeated rows
    repeat their result and an empty table gives an empty one.  Columns of ``docs`` named ``ids`` or ``decoded`` are replaced, other names do not matter.
    The model file is read on the driver and its bytes travel with the task.
    """
    model = read_model(model_path)
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("ids", "decoded")]
    source = docs.select(*kept, docs[text_column].alias("_pieces_text"))
    schema = docs.select(*kept).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, stop in _slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                flat, ends = coder.encode_batch([t or "" for t in texts.slice(start, stop - start).to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32()))
                columns = [batch.column(i).slice(start, stop - start) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(coder.decode_batch(flat, ends), pa.string())], [*kept, "ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(work, schema)
