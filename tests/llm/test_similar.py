import random

import numpy as np
import pytest

from chartloom.llm import similar, simhash
from tests.llm.fixtures import documents, frame, text_of
from tests.llm.test_simhash import brute_components


def shingles(text, width=5):
    words = (text or "").lower().split(" ") if (text or "").strip() else []
    words = [w for part in words for w in part.split()]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_similar(texts):
    """id of the smallest linked text, by comparing all pairs."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                pairs += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in texts}, pairs


def edited(rng, text, edits):
    words = text.split()
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("frequent", [16, 0])
def test_all_pairs_of_four_fifths_are_linked(spark, monkeypatch, frequent):
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    monkeypatch.setattr(similar, "SAMPLED", 8 if frequent else 1)
    rng = random.Random(2)
    passage = text_of(rng, 25)
    texts = {d: t for d, t, *_ in documents(5)[:60] if d not in (10, 11, 12, 13, 14, 15)}
    for i in range(12):
        base = text_of(rng, 40 + 40 * i, 10_000)
        texts[100 + i] = base
        for k in range(8):  # to both sides of the bound
            texts[200 + 10 * i + k] = edited(rng, base, rng.randrange(1, 3 + i))
        texts[400 + i] = passage + " " + text_of(rng, 30, 10_000)
    chain = text_of(rng, 200, 10_000).split()
    for i in range(60):  # neighbours are similar, the ends share nothing
        texts[500 + i] = " ".join(chain[2 * i : 2 * i + 70])
    rows = [(d, t, "en", "a", 1, 1, 1, "g", "x") for d, t in texts.items()]
    want, pairs = brute_similar(texts)
    found = {r.doc_id: r.component_id for r in similar.similar_components(frame(spark, rows)).collect()}
    assert pairs > 200 and found == want
    kept = simhash.keep_representatives(frame(spark, rows), shingle=5, similar_percent=80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_the_stage_links_copies_with_one_word_replaced(spark):
    import corpus_pipeline as cp

    rng = random.Random(4)
    texts = {}
    for i in range(20):
        texts[i] = text_of(rng, 200, 10_000)
        texts[100 + i] = edited(rng, texts[i], 1)
    kept = cp.simhash_near_dedup(spark, frame(spark, [(d, t, "en", "a", 1, 1, 1, "g", "x") for d, t in texts.items()]), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    assert len(set(brute_components([(d, simhash.fingerprint(t)) for d, t in texts.items()]).values())) > 20  # the three-bit rule leaves some


def test_edges(spark):
    assert similar.shingle_hashes(None).size == similar.shingle_hashes(" \n").size == 0
    assert np.array_equal(similar.shingle_hashes("a B"), similar.shingle_hashes("A  b\n"))
    assert [similar.prefix_length(n, 80) for n in (0, 1, 4, 5, 10, 100)] == [0, 1, 1, 2, 3, 21]
    rows = [(None, "a b c", *[None] * 7), (3, "a b c", *[None] * 7), (3, "a b c", *[None] * 7), (3, "d e f", *[None] * 7), (5, "D e f", *[None] * 7), (6, None, *[None] * 7), (7, " ", *[None] * 7)]
    found = sorted((r.doc_id, r.component_id) for r in similar.similar_components(frame(spark, rows)).collect())
    assert found == [(3, 3), (3, 3), (3, 3), (5, 3), (6, 6), (7, 6)]
    assert sorted(str(r.doc_id) for r in simhash.keep_representatives(frame(spark, rows), 5, 80).collect()) == ["3", "6", "None"]
    assert similar.similar_components(frame(spark, rows).limit(0)).count() == 0
