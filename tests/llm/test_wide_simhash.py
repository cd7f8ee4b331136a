import random

import numpy as np
import pytest

from chartloom.llm import similar, wide_simhash
from tests.llm.fixtures import frame, text_of
from tests.llm.test_similar import edited


def brute_fingerprint(shingles):
    mask, bits = 2**64 - 1, []
    for lane in range(16):
        hashes = []
        for h in shingles:
            x = (h + (lane + 1) * 0x9E3779B97F4A7C15) & mask
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
            hashes.append(x ^ (x >> 31))
        bits += [2 * sum(h >> b & 1 for h in hashes) > len(hashes) for b in range(64)]
    return bits


def bits_of(longs):
    return [bool(int(w) >> b & 1) for w in longs for b in range(64)]


@pytest.mark.parametrize("count", [0, 1, 2, 5, 255, 256, 600])
def test_a_bit_is_set_where_over_half_of_the_hashes_have_it(count):
    hashes = [random.Random(count + i).getrandbits(64) for i in range(count)]
    assert bits_of(wide_simhash.fingerprint_of(np.array(hashes, dtype=np.uint64))) == brute_fingerprint(hashes)


def test_the_radius_reaches_the_similarity_and_no_unlike_sets():
    rng = np.random.default_rng(3)
    for a, b, common in [(5, 4, 4), (6, 5, 5), (9, 9, 8), (90, 90, 80), (900, 720, 720), (50, 50, 0)]:
        for _ in range(50):
            of = rng.integers(0, 2**64, a + b - common, dtype=np.uint64)
            x, y = (bits_of(wide_simhash.fingerprint_of(s)) for s in (of[:a], of[a - common :]))
            assert (sum(p != q for p, q in zip(x, y)) <= wide_simhash.radius(80)) == (common > 0)


def nodes_of(spark, texts):
    sets = {i: similar.shingle_hashes(t) for i, t in texts.items()}
    rows = [(i, len(s), [int(w) for w in wide_simhash.fingerprint_of(s)]) for i, s in sets.items()]
    return spark.createDataFrame(rows, "node bigint, n int, simhash array<bigint>")


def test_the_stage_finds_near_copies_by_simhash(spark, monkeypatch):
    import corpus_pipeline as cp

    rng = random.Random(8)
    texts = {i: text_of(rng, 200, 10_000) for i in range(40)}
    texts |= {100 + i: edited(rng, texts[i], 2) for i in range(40)}
    nodes = nodes_of(spark, texts)
    assert {(r.a, r.b) for r in wide_simhash.candidates(nodes, 80).collect()} >= {(i, 100 + i) for i in range(40)}
    assert wide_simhash.candidates(nodes.limit(0), 80).count() == 0
    monkeypatch.setattr(similar, "prefix_length", lambda n, percent: 0)  # nothing is left to the exact way for the rest
    kept = cp.simhash_near_dedup(spark, frame(spark, [(d, t, "en", "a", 1, 1, 1, "g", "x") for d, t in texts.items()]), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_a_large_group_of_near_copies_is_linked_and_not_squared(spark):
    rng = random.Random(6)
    base = text_of(rng, 200, 10_000)
    texts = {i: edited(rng, base, 1) for i in range(300)}
    pairs = [(r.a, r.b) for r in wide_simhash.candidates(nodes_of(spark, texts), 80).collect()]
    assert len(pairs) == len(set(pairs)) <= 300 * wide_simhash.PARTNERS and all(a < b for a, b in pairs)
    reached, found = {0}, True
    while found:
        found = {x for p in pairs if reached & set(p) for x in p} - reached
        reached |= found
    assert reached == set(texts)


def group_of(spark, components):
    """Sets 0, 1, ... of these components, whose fingerprints agree in the first five segments and nowhere else."""
    rng = random.Random(7)
    signed = lambda word: word - 2**64 if word >> 63 else word
    rows = [(i, c, 100, [0, *(signed(rng.getrandbits(64) & (2**64 - 2**16 if k == 0 else -1)) for k in range(15))]) for i, c in enumerate(components)]
    return spark.createDataFrame(rows, "node bigint, component bigint, n int, simhash array<bigint>")


def test_a_group_gives_at_most_a_pair_for_each_member_and_segment(spark):
    pairs = wide_simhash.candidates(group_of(spark, range(200)), 80).collect()
    assert {(i, i + 1) for i in range(199)} <= {(r.a, r.b) for r in pairs} and len(pairs) <= 199 * 6


def test_members_of_a_component_do_not_take_each_others_places(spark):
    pairs = wide_simhash.candidates(group_of(spark, [0, *[1] * 20]), 80).collect()
    assert {(r.a, r.b) for r in pairs} == {(0, i) for i in range(1, 21)}
