import random

import numpy as np
import pytest

from chartloom.llm import suffixes


def assert_ordered(texts, depth):
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    end = np.cumsum([len(t) for t in texts])
    begin = end - np.array([len(t) for t in texts])
    starts, order, new = suffixes.corpus_order(data, begin, end, depth)
    suffix = {b + i: t[i:] for t, b in zip(texts, begin.tolist()) for i in range(len(t) - depth + 1)}
    assert starts.tolist() == sorted(suffix)
    found = [suffix[int(x)] for x in starts[order]]
    assert found == sorted(found)
    assert new.tolist() == [True for _ in found[:1]] + [a[:depth] != b[:depth] for a, b in zip(found, found[1:])]


@pytest.mark.parametrize("alphabet", [b"ab", b"a", b"\0\1", bytes(range(256)), b"abcdefgh \0"])
def test_corpus_order_is_that_of_sorted_suffixes(alphabet):
    rng = random.Random(1)
    for _ in range(25):
        base = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(4)]
        texts = [b"".join(rng.choice(base) for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(1, 12))]
        for depth in (8, 10, 50):
            assert_ordered(texts, depth)


def test_short_and_empty_texts():
    assert_ordered([b""], 50)
    assert_ordered([b"", b"x" * 49, b"", b"x" * 50, b"x" * 50, b"y"], 50)


def test_ranks_of_the_parse():
    phrase, last = np.array([2, 1, 2, 1, 2, 1]), np.array([False, False, True, False, False, True])
    # (2,1,2) (1,2) (2) | (1,2,1) (2,1) (1)
    assert suffixes._parse_ranks(phrase, last).tolist() == [6, 2, 4, 3, 5, 1]
