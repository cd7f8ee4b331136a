"""Corpus order of suffixes by prefix-free parsing.

A hash of ``TRIGGER`` bytes marks triggers.  A phrase runs from one trigger to the end of the next, so neighbours share a trigger and
no suffix of a phrase that is longer than a trigger is the beginning of another such suffix.  Repetitive text has few distinct phrases:

* the suffix array of the dictionary orders the suffixes of the distinct phrases, each looked at once however often its phrase occurs;
* the suffix array of the parse orders, by prefix doubling, what follows each occurrence of a phrase;
* a position of the corpus is ordered by the dictionary's rank of the rest of its phrase and then by the parse's rank of what follows it.

Bytes decide everything; hashes only place the triggers.
"""

from __future__ import annotations

import numpy as np

TRIGGER, SPACING = 8, 16
_U = np.uint64
_KEEP = np.array([(0xFFFFFFFFFFFFFFFF << (8 * (8 - k))) & 0xFFFFFFFFFFFFFFFF for k in range(9)], dtype=np.uint64)


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number that orders as they do; zeros after the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint64)
    padded[: len(data)] = data
    out = padded[: len(data)].copy()
    for k in range(1, 8):
        out <<= _U(8)
        out |= padded[k : k + len(data)]
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _ranked(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rank of each byte string ``[at, at + size)`` in lexicographic order, equal for equal strings."""
    n = len(at)
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)  # group: of each place of the order, its first place
    open_, depth = np.arange(n), 0
    while len(open_):
        rows = order[open_]
        left = np.clip(size[rows] - depth, 0, 9)  # 9: goes on
        spot = np.minimum(at[rows] + depth, len(words) - 1)
        word = words[spot] & _KEEP[np.minimum(left, 8)]
        by = np.lexsort((left, word, group[open_]))
        word, left, base = word[by], left[by], group[open_]
        order[open_] = rows[by]
        new = np.r_[True, (base[1:] != base[:-1]) | (word[1:] != word[:-1]) | (left[1:] != left[:-1])]
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        group[open_] = open_[first][of]
        alone = np.diff(np.r_[first, len(open_)]) == 1
        depth += 8
        open_ = open_[~(alone[of] | (left < 9))]
    out = np.empty(n, dtype=np.int64)
    out[order] = group
    return out


def _parse_ranks(phrase: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rank of the parse from each phrase on to its text's end (1 at least), by prefix doubling."""
    n = len(phrase)
    rank = _dense(phrase) + 1
    end = np.flatnonzero(last)
    left = end[np.searchsorted(end, np.arange(n))] - np.arange(n)  # phrases after this one in its text
    step = 1
    while step <= (int(left.max()) if n else 0):
        after = np.where(left >= step, rank[np.minimum(np.arange(n) + step, n - 1)], 0)
        rank = _dense(rank * (n + 2) + after) + 1
        step *= 2
    return rank


def corpus_order(data: np.ndarray, begin: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, order, new): positions at which ``depth`` bytes begin within one text, their corpus order, and which differ from the one before in those bytes.

    The texts ``[begin, end)`` follow one another in ``data``.
    """
    counts = np.maximum(end - begin - depth + 1, 0)
    total = int(counts.sum())
    starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(total)
    if not total:
        return starts, starts, np.zeros(0, dtype=bool)
    words = big_endian_words(data)
    mixed = words * _U(0x9E3779B97F4A7C15)
    cuts = ((mixed ^ (mixed >> _U(29))) >> _U(32)) % _U(SPACING) == 0
    text_end = np.zeros(len(data), dtype=np.int64)
    text_end[begin[end > begin]] = end[end > begin]
    text_end = np.maximum.accumulate(text_end)
    cuts &= np.arange(len(data)) + TRIGGER <= text_end
    cuts[begin[end > begin]] = True
    s = np.flatnonzero(cuts)
    after = np.r_[s[1:], len(data)]
    last = after >= text_end[s]
    e = np.where(last, text_end[s], after + TRIGGER)
    # dictionary: distinct phrases, and their suffixes that are longer than a trigger (of a text's last phrase, those with enough bytes)
    raw = data.tobytes()
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(s.tolist(), e.tolist())), dtype=np.int64, count=len(s))
    _, sample = np.unique(which, return_index=True)
    size = e[sample] - s[sample]
    n_suffixes = np.where(last[sample], np.maximum(size - depth + 1, 1), size - TRIGGER)
    base = np.cumsum(n_suffixes) - n_suffixes
    nth = np.arange(int(n_suffixes.sum())) - np.repeat(base, n_suffixes)
    dictionary = _ranked(words, np.repeat(s[sample], n_suffixes) + nth, np.repeat(size, n_suffixes) - nth)
    following = np.r_[_parse_ranks(dictionary[base[which]], last)[1:], 0]
    following[last] = 0
    phrase = np.searchsorted(s, starts, side="right") - 1
    order = np.lexsort((following[phrase], dictionary[base[which[phrase]] + starts - s[phrase]]))
    new = np.ones(total, dtype=bool)
    at = starts[order]
    same = np.ones(total - 1, dtype=bool)
    for k in (*range(0, depth - 8, 8), depth - 8):
        word = words[at + k]
        same &= word[1:] == word[:-1]
    new[1:] = ~same
    return starts, order, new
