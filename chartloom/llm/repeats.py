"""Exact removal of repeated byte strings by prefix-free parsing.

A byte starts a repeat if the ``length`` bytes from it on also start in a document with a smaller id.

1. Parse.  A rolling hash triggers phrase starts (hash modulo ``PHRASE`` is 0), so equal text is cut alike wherever it
   stands.  A phrase is taken with the ``length - 1`` bytes after it, which makes it hold every window that starts in it.
2. Dictionary.  Equal phrases are one entry, owned by the smallest document that has them.  All other occurrences are
   repeats as a whole and need no further look: highly repetitive text shrinks to its dictionary.
3. Corpus order of the dictionary's suffixes.  Suffixes that can agree with another document's for ``length`` bytes have the same smallest
   ``ANCHOR``-byte hash in these bytes, a test that cannot miss one; a hash that one document alone has needs no order.  The others are dealt by that
   hash, as stretches of text (neighbours share it).  Where they meet, the suffix arrays of the stretches' own dictionary and parse
   (``suffixes``) give their corpus order, in which equal suffixes are neighbours: each run that agrees in ``length`` bytes has a smallest owner.
4. Parse and order together give each document's repeated starts, and so its remaining bytes.

Documents are dealt into chunks by a hash of id and text once, and every step works on the chunks of that one exchange.  What
travels between the steps are sorted hash arrays and stretches, dealt into buckets by hash.  A chunk sends a hash once, however often it has it,
and nothing to a bucket for which it has none, so messages never outnumber the phrases and anchors of the input.
Runs are compared byte by byte.  Equal phrases are told by 96 bits of BLAKE2b; the rolling hash only places phrases and anchors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.suffixes import corpus_order

LENGTH, ANCHOR, PHRASE = 50, 24, 64
#: Bytes of a chunk: one part of ``SPREAD`` of the input, within these bounds; of the input for a bucket; of a chunk's text looked at at a time.
LEAST_CHUNK, CHUNK_BYTES, BUCKET_BYTES, SEGMENT, SPREAD = 1 << 16, 8 << 20, 12 << 20, 1 << 16, 256
_LAST = np.int64(2**63 - 1)
_U = np.uint64

#: Most starts of a stretch.
STRETCH = 32
_MESSAGE = "bucket int, chunk int, kind int, h1 binary, h2 binary, doc binary"
_PHRASES, _ANCHORS, _WINDOWS = 0, 1, 2


class _Hasher:
    """A rolling polynomial hash from prefix sums, modulo 2**64, over random byte values; it places triggers and anchors and decides nothing."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20_240_229)
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(2**62, 2**63, dtype=np.uint64)) | 1
        self._powers, self._inverse = self._progression(base), self._progression(pow(base, -1, 2**64))

    @staticmethod
    def _progression(base: int) -> np.ndarray:
        out = np.full(SEGMENT + LENGTH + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def rolling(self, data: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from each position on."""
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self._powers[: len(data)], out=sums[1:])
        n = max(0, len(sums) - size)
        return _mixed((sums[size:] - sums[:n]) * self._inverse[:n])


def _digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of BLAKE2b of each byte range, as 64 and 32."""
    view = memoryview(data.tobytes())
    joined = b"".join(blake2b(view[a:b], digest_size=12).digest() for a, b in zip(start.tolist(), stop.tolist()))
    both = np.frombuffer(joined, dtype=[("one", "<u8"), ("two", "<u4")])
    return both["one"].copy(), both["two"].copy()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


_HASHER: list[_Hasher] = []


def _hasher() -> _Hasher:
    if not _HASHER:
        _HASHER.append(_Hasher())
    return _HASHER[0]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each position on (as far as whole windows go)."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


class _Chunk:
    """Documents of one chunk as one byte array."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("doc_id").combine_chunks()
        texts = table.column("text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        self.null_id = np.asarray(ids.is_null())
        self.doc = np.asarray(ids.fill_null(int(_LAST))).astype(np.int64)
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=n + 1 + texts.offset)[texts.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
        body = texts.buffers()[2]
        self.bytes = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.start, self.stop = offsets[:-1], offsets[1:]

    def segments(self) -> Iterator["_Segment"]:
        """Stretches of at most ``SEGMENT`` bytes: several documents, or part of one."""
        first, size = 0, 0
        for i in range(len(self.doc)):
            n = int(self.stop[i] - self.start[i])
            if n > SEGMENT:
                if i > first:
                    yield _Segment(self, first, i, int(self.start[first]), int(self.stop[i - 1]))
                for at in range(int(self.start[i]), int(self.stop[i]), SEGMENT):
                    yield _Segment(self, i, i + 1, at, min(at + SEGMENT, int(self.stop[i])))
                first, size = i + 1, 0
            elif size + n > SEGMENT:
                yield _Segment(self, first, i, int(self.start[first]), int(self.stop[i - 1]))
                first, size = i, n
            else:
                size += n
        if first < len(self.doc):
            yield _Segment(self, first, len(self.doc), int(self.start[first]), int(self.stop[-1]))


class _Segment:
    """Windows that start in bytes [a, b) of a chunk; positions are relative to ``a``."""

    def __init__(self, chunk: _Chunk, first: int, last: int, a: int, b: int) -> None:
        self.chunk, self.a, self.n, self._first = chunk, a, b - a, first
        self._begin = np.maximum(chunk.start[first:last], a) - a
        self._stop = np.minimum(chunk.stop[first:last], b) - a
        self._end = chunk.stop[first:last] - a
        self.data = chunk.bytes[a : min(int(chunk.stop[last - 1]), b + LENGTH - 1)]
        self._rolled: np.ndarray | None = None

    def _place(self, at: np.ndarray) -> np.ndarray:
        """Which of the segment's documents each position lies in."""
        return np.searchsorted(self._stop, at, side="right")

    def docs(self, at: np.ndarray) -> np.ndarray:
        return self.chunk.doc[self._first + self._place(at)]

    def valid(self) -> np.ndarray:
        """Whether a whole window starts at each position."""
        whole = np.clip(self._end - (LENGTH - 1) - self._begin, 0, self._stop - self._begin)
        runs = np.stack([whole, self._stop - self._begin - whole], axis=1).ravel()
        return np.repeat(np.arange(len(runs)) % 2 == 0, runs)

    def rolled(self) -> np.ndarray:
        if self._rolled is None:
            self._rolled = _hasher().rolling(self.data, ANCHOR)
        return self._rolled

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each phrase, its digest); a phrase ends where the next starts or its document ends."""
        rolled = self.rolled()[: self.n]
        triggers = np.zeros(self.n, dtype=bool)
        np.equal(rolled & _U(PHRASE - 1), _U(0), out=triggers[: len(rolled)])
        triggers[self._begin[self._begin < self._stop]] = True
        start = np.flatnonzero(triggers)
        if not len(start):
            return start, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        stop = np.minimum(np.r_[start[1:], self.n] + LENGTH - 1, self._end[self._place(start)])
        return start, *_digests(self.data, start, stop)

    def smallest_hashes(self) -> np.ndarray:
        """For each start, the smallest anchor hash in its window; where the window is not valid, any value."""
        out = np.zeros(self.n, dtype=np.uint64)
        width = LENGTH - ANCHOR + 1
        if len(self.rolled()) >= width:
            least = _sliding_min(self.rolled(), width)[: self.n]
            out[: len(least)] = least
        return out


class _Known:
    """Sorted hashes with a smallest document each."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> None:
        order = np.argsort(h1)
        h1, h2, doc = h1[order], h2[order], doc[order]
        tied = np.flatnonzero(h1[1:] == h1[:-1]) if len(h1) else np.zeros(0, np.int64)
        if len(tied):  # equal first hashes are sorted by the rest, on their own
            rows = np.union1d(tied, tied + 1)
            inner = np.lexsort((doc[rows], h2[rows], h1[rows]))
            h2[rows], doc[rows] = h2[rows][inner], doc[rows][inner]
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
        self.h1, self.h2, self.doc = h1[new], h2[new], doc[new]

    def least(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Smallest document of each hash, the last possible id where it is unknown."""
        out = np.full(len(h1), _LAST)
        if len(self.h1):
            at = np.searchsorted(self.h1, h1)
            while True:  # more than one step only where 64 bits are equal and the others differ
                inside = at < len(self.h1)
                spot = np.where(inside, at, 0)
                equal = inside & (self.h1[spot] == h1)
                hit = equal & (self.h2[spot] == h2)
                out[hit] = self.doc[spot[hit]]
                going = equal & ~hit
                if not going.any():
                    break
                at = np.where(going, at + 1, len(self.h1))
        return out


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _messages(chunk: int, kind: int, h1: np.ndarray, h2: np.ndarray | None, doc: np.ndarray | None, buckets: int) -> list[tuple]:
    """Hashes, sorted, as one row per bucket."""
    bucket, cuts = _bucket_cuts(h1, buckets)
    small = doc is not None and len(doc) and int(doc.max()) < 2**31
    out = []
    for a, b in cuts:
        docs = b"" if doc is None else doc[a:b].astype(np.int32 if small else np.int64).tobytes()
        out.append((int(bucket[a]), chunk, kind, h1[a:b].tobytes(), b"" if h2 is None else h2[a:b].tobytes(), docs))
    return out


def _as_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "chunk", "kind", "h1", "h2", "doc"), columns, kinds)})


def _docs_of(h1: bytes, doc: bytes) -> np.ndarray:
    return np.frombuffer(doc, dtype=np.int64 if len(doc) == len(h1) else np.int32).astype(np.int64)


def _received(table: pa.Table, kind: int) -> _Known:
    rows = [(a, b, d) for k, a, b, d in zip(*(table.column(c).to_pylist() for c in ("kind", "h1", "h2", "doc"))) if k == kind]
    h1 = np.frombuffer(b"".join(r[0] for r in rows), dtype=np.uint64)
    if kind == _ANCHORS:
        return _Known(h1, np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64))
    docs = [_docs_of(a, d) for a, _, d in rows]
    return _Known(h1, np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint32), np.concatenate(docs) if docs else np.zeros(0, np.int64))


def _concatenated(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)]


class _Parse:
    """The phrases of a chunk, segment by segment, and its dictionary."""

    def __init__(self, chunk: _Chunk) -> None:
        self.chunk, self._phrases, parts = chunk, [], []
        for segment in chunk.segments():
            start, one, two = segment.phrases()
            self._phrases.append((start, one, two))
            parts.append((one, two, segment.docs(start)))
        self.known = _Known(*_concatenated(parts))

    def owned(self, others: _Known) -> Iterator[tuple[_Segment, np.ndarray]]:
        """Each segment with the starts that lie in phrases that no smaller document has."""
        for segment, (start, one, two) in zip(self.chunk.segments(), self._phrases):
            least = np.minimum(self.known.least(one, two), others.least(one, two))
            yield segment, np.repeat(segment.docs(start) <= least, np.diff(np.r_[start, segment.n]))


def _key(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def _send_phrases(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        known = _Parse(_Chunk(table)).known
        return _as_table(_messages(_key(table), _PHRASES, known.h1, known.h2, known.doc, buckets))

    return send


def _turns(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)


def _anchor_names(least: np.ndarray) -> np.ndarray:
    """Smallest hashes crowd at low values; mixed again, they spread evenly over the buckets.  The lowest bit is left free."""
    return _mixed(least) & ~_U(1)


def _send_anchors(buckets: int):
    def send(docs: pa.Table, messages: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _as_table([])
        parts = []
        for segment, owned in _Parse(_Chunk(docs)).owned(_received(messages, _PHRASES)):
            at = np.flatnonzero(segment.valid() & owned)
            least = segment.smallest_hashes()[at]
            turn = _turns(least)  # neighbours share their smallest hash
            turn[1:] |= np.diff(at) >= LENGTH  # another document begins at least that far on
            parts.append((_anchor_names(least[turn]), segment.docs(at[turn])))
        name, doc = [np.concatenate(x) for x in zip(*parts)] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(name)
        name, doc = name[order], doc[order]
        first = np.flatnonzero(_turns(name))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        # the lowest bit tells whether the chunk itself has the hash in several documents
        return _as_table(_messages(_key(docs), _ANCHORS, name[first] | several.astype(np.uint64), None, None, buckets))

    return send


class _Stretches:
    """Runs of neighbouring starts in owned phrases that have one smallest hash, which several documents have.

    Equal stretches of a chunk are one entry, owned by its smallest document; entries are sorted by the hash's name and their own hashes.
    """

    def __init__(self, parse: _Parse, phrases: _Known, shared: _Known, each=None) -> None:
        columns = []
        for segment, owned in parse.owned(phrases):
            valid = segment.valid()
            if each is not None:
                each(segment, valid & ~owned)
            at = np.flatnonzero(valid & owned)
            if not len(at) or not len(shared.h1):
                continue
            least = segment.smallest_hashes()[at]
            turn = _turns(least)
            turn[1:] |= np.diff(at) > 1
            first = np.flatnonzero(turn)
            name = _anchor_names(least[first])
            hit = shared.h1[np.minimum(np.searchsorted(shared.h1, name), len(shared.h1) - 1)] == name
            begin, size = at[first][hit], np.diff(np.r_[first, len(at)])[hit]
            pieces = -(-size // STRETCH)
            nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            name, begin, size = np.repeat(name[hit], pieces), np.repeat(begin, pieces) + STRETCH * nth, np.minimum(np.repeat(size, pieces) - STRETCH * nth, STRETCH)
            columns.append((name, *_digests(segment.data, begin, begin + size + LENGTH - 1), segment.docs(begin), begin + segment.a, size))
        if columns:
            name, one, two, self.doc, self.at, self.size = (np.concatenate(x) for x in zip(*columns))
        else:
            name, one, two = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            self.doc = self.at = self.size = np.zeros(0, np.int64)
        order = np.lexsort((self.doc, two, one, self.size, name))
        self.doc, self.at, self.size = self.doc[order], self.at[order], self.size[order]
        name, one, two = name[order], one[order], two[order]
        new = _turns(one) | _turns(two) | _turns(name) | _turns(self.size)
        self.first = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1  # of each stretch
        self.name, self.owner = name[self.first], self.doc[self.first]
        self.bytes = parse.chunk.bytes

    def texts(self, entries: slice) -> bytes:
        at, size = self.at[self.first[entries]], self.size[self.first[entries]] + LENGTH - 1
        ends = np.cumsum(size)
        return self.bytes[np.arange(int(ends[-1])) + np.repeat(at - (ends - size), size)].tobytes()


def _bucket_cuts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Bucket of each of some sorted hashes, and where each bucket's begin and end."""
    bucket = ((h >> _U(32)) * _U(buckets)) >> _U(32)
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(h)].tolist() if len(h) else [0]
    return bucket, list(zip(cuts[:-1], cuts[1:]))


def _send_stretches(buckets: int):
    def send(docs: pa.Table, messages: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _as_table([])
        found = _Stretches(_Parse(_Chunk(docs)), _received(messages, _PHRASES), _received(messages, _ANCHORS))
        bucket, cuts = _bucket_cuts(found.name, buckets)
        key, out = _key(docs), []
        for a, b in cuts:  # sizes travel in h1, texts in h2
            sizes = found.size[found.first[a:b]].astype(np.uint8).tobytes()
            out.append((int(bucket[a]), key, _WINDOWS, sizes, found.texts(slice(a, b)), found.owner[a:b].tobytes()))
        return _as_table(out)

    return send


def _answer_stretches(table: pa.Table) -> pa.Table:
    """To each chunk, for each of its stretches, which starts (bits) a smaller document has."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "h1", "h2", "doc"))))
    size = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).astype(np.int64)
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    owner = np.frombuffer(b"".join(r[4] for r in rows), np.int64)
    ends = np.cumsum(size + LENGTH - 1)
    starts, order, new = corpus_order(data, ends - (size + LENGTH - 1), ends, LENGTH)
    doc = np.repeat(owner, size)  # a stretch has as many starts as its size
    sorted_doc = doc[order]
    least = np.minimum.reduceat(sorted_doc, np.flatnonzero(new))
    behind = np.empty(len(starts), dtype=bool)
    behind[order] = least[np.cumsum(new) - 1] < sorted_doc
    first = np.cumsum(size) - size
    bits = np.left_shift(_U(1), (np.arange(len(doc)) - np.repeat(first, size)).astype(np.uint64)) * behind
    masks = np.add.reduceat(bits, first).astype(np.uint32)
    out, at = [], 0
    for bucket, chunk, sizes, _, _ in rows:
        mine = masks[at : at + len(sizes)]
        at += len(sizes)
        if mine.any():
            out.append((bucket, chunk, _WINDOWS, mine.tobytes(), b"", bucket.to_bytes(8, "little")))
    return _as_table(out)


def _answer_least(table: pa.Table) -> pa.Table:
    """Of the hashes in a bucket: to each chunk those that a smaller document of another chunk has."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "kind", "h1", "h2", "doc"))))
    h1, h2, doc = _joined(table.column("h1"), np.uint64), _joined(table.column("h2"), np.uint32), np.concatenate([_docs_of(r[2], r[4]) for r in rows])
    least = _Known(h1, h2, doc).least(h1, h2)
    out, at = [], 0
    for chunk, kind, a, _, _ in rows:
        n = len(a) // 8
        here = slice(at, at + n)
        behind = least[here] < doc[here]
        if behind.any():
            out += _messages(chunk, kind, h1[here][behind], h2[here][behind], least[here][behind], 1)
        at += n
    return _as_table(out)


def _answer_shared(table: pa.Table) -> pa.Table:
    """Of the anchor hashes in a bucket: to each chunk those that several documents have."""
    arrays = [np.frombuffer(x, dtype=np.uint64) for x in table.column("h1").to_pylist()]
    flagged = np.sort(np.concatenate(arrays))
    plain = flagged & ~_U(1)
    again = plain[1:][plain[1:] == plain[:-1]]
    shared = np.union1d(again, plain[(flagged & _U(1)) == 1])
    out = []
    for chunk, own in zip(table.column("chunk").to_pylist(), arrays):
        mine = own & ~_U(1)
        mine = mine[np.isin(mine, shared, assume_unique=True)] if len(shared) else mine[:0]
        if len(mine):
            out += _messages(chunk, _ANCHORS, mine, None, None, 1)
    return _as_table(out)


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _results(buckets: int):
    def finish(docs: pa.Table, messages: pa.Table) -> pa.Table:
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        if not docs.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
        chunk = _Chunk(docs)
        begins = np.zeros(len(chunk.bytes), dtype=bool)

        def mark(segment: _Segment, hit: np.ndarray) -> None:
            begins[segment.a : segment.a + segment.n] = hit

        found = _Stretches(_Parse(chunk), _received(messages, _PHRASES), _received(messages, _ANCHORS), mark)
        bucket, cuts = _bucket_cuts(found.name, buckets)
        answers = {int.from_bytes(d, "little"): m for k, m, d in zip(*(messages.column(c).to_pylist() for c in ("kind", "h1", "doc"))) if k == _WINDOWS}
        masks = np.zeros(len(found.name), dtype=np.uint32)
        for a, b in cuts:
            if answer := answers.get(int(bucket[a])):
                masks[a:b] = np.frombuffer(answer, np.uint32)
        mask = np.where(found.doc > found.owner[found.entry], np.uint32(0xFFFFFFFF), masks[found.entry]) if len(found.doc) else masks
        nth = np.arange(int(found.size.sum())) - np.repeat(np.cumsum(found.size) - found.size, found.size)
        hit = (np.repeat(mask, found.size) >> nth.astype(np.uint32)) & np.uint32(1) == 1
        begins[(np.repeat(found.at, found.size) + nth)[hit]] = True
        at = np.flatnonzero(begins)
        gone = np.zeros(len(chunk.bytes), dtype=bool)
        if len(at):  # runs of starts that are at most LENGTH apart cover one stretch
            cut = np.flatnonzero(np.diff(at) > LENGTH)
            for a, b in zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + LENGTH).tolist()):
                gone[a:b] = True
        out = []
        for i, (a, b) in enumerate(zip(chunk.start.tolist(), chunk.stop.tolist())):
            mask, data = gone[a:b], chunk.bytes[a:b]
            removed = int(mask.sum())
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
            kept = (data[~mask] if removed else data).tobytes()
            out.append((None if chunk.null_id[i] else int(chunk.doc[i]), b - a, removed, spans, kept))
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*out), kinds)})

    return finish


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row; ``kept`` are the remaining bytes.

    A null text has no bytes.  Texts of fewer than ``LENGTH`` bytes are untouched.  Matches never cross documents.
    Rows with equal ids, repeated rows among them, do not remove each other's bytes; a null id counts as larger than any other, so
    rows with null ids lose to all others and not to each other.  An empty table gives an empty result; other columns are ignored,
    whatever their names.  Memory in a task: a chunk's text (at most 8 MiB, or one document where that is longer) and its hashes, a bounded part of the text at a time.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    total = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    size = min(CHUNK_BYTES, max(LEAST_CHUNK, total // SPREAD))
    chunks = max(1, math.ceil(total / size))
    buckets = max(1, math.ceil(total / min(BUCKET_BYTES, 2 * size)))
    # the text belongs to the key: rows without an id, or with one id, are spread as well
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    def answered(sent: DataFrame, answer) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(answer, _MESSAGE).drop("bucket")

    def with_messages(messages: DataFrame):
        return dealt.groupBy("chunk").cogroup(messages.groupBy("chunk"))

    phrases = answered(dealt.groupBy("chunk").applyInArrow(_send_phrases(buckets), _MESSAGE), _answer_least)
    shared = answered(with_messages(phrases).applyInArrow(_send_anchors(buckets), _MESSAGE), _answer_shared)
    known = phrases.unionByName(shared)
    windows = answered(with_messages(known).applyInArrow(_send_stretches(buckets), _MESSAGE), _answer_stretches)
    return with_messages(known.unionByName(windows)).applyInArrow(_results(buckets), _RESULT)
