import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from chartloom.llm import components, simhash
from tests.llm.fixtures import documents, frame


def brute_fingerprint(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(marked):
    """marked: list of (id, unsigned fingerprint)."""
    root = {f: f for _, f in marked}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 3 and find(a) != find(b):
                root[find(a)] = find(b)
    least = {}
    for d, f in marked:
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: least[find(f)] for d, f in marked}


@pytest.mark.parametrize("block", [1 << 22, 7, 40])
def test_fingerprints_match_brute_force(monkeypatch, block):
    monkeypatch.setattr(simhash, "_BLOCK", block)
    for text in {r[1] for r in documents()} | {"one", "one two", "one two  ", "a b c", " x" * 50}:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_components_match_brute_force(spark):
    rows = documents() + documents(7, 40)[:0]
    base = rows[40][1]
    rng = random.Random(1)
    for i in range(30):
        words = base.split()
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((100 + i, " ".join(words), "en", "a", 1, 1, 1, "g", "x"))
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    marked = [(r.doc_id, r.fp % (1 << 64)) for r in found]
    assert {r.doc_id: r.component_id for r in found} == brute_components(marked)


@pytest.mark.parametrize("key_rows", [1, 64])
def test_every_pair_within_three_bits_is_found(spark, monkeypatch, key_rows):
    monkeypatch.setattr(simhash, "KEY_ROWS", key_rows)
    rng = np.random.default_rng(3)
    centres = rng.integers(-(2**63), 2**63, 12)
    values = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(12):
            mask = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            values.add(((c % 2**64) ^ mask) - 2**64 if ((c % 2**64) ^ mask) >> 63 else (c % 2**64) ^ mask)
    values = sorted(values)
    found = {(r.a, r.b) for r in simhash.links_between(spark.createDataFrame([(v,) for v in values], "fp bigint")).collect()}
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    assert found == want


@pytest.mark.parametrize("few,hub", [(50_000, 20_000), (0, 20_000), (0, 3)])
def test_chains_rings_and_stars(spark, monkeypatch, few, hub):
    monkeypatch.setattr(components, "BROADCAST_LINKS", few)
    monkeypatch.setattr(components, "HUB", hub)
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (32, 30), (5, 5)] + [(40, 40 + i) for i in range(1, 9)] + [(None, 3)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(21)}, **{i: 30 for i in (30, 31, 32)}, **{i: 40 for i in range(40, 49)}}


def test_representatives_and_empty_tables(spark):
    docs = frame(spark, documents())
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    marked = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(marked.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_representatives(docs.limit(0)).count() == 0
    nulls = simhash.near_duplicates(frame(spark, [(None, "a b c d", "en", "a", 1, 1, 1, "g", "x"), (4, "a b c d", None, None, None, None, None, None, None)])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in nulls) == [(False, 4), (True, None)]


def test_representatives_of_clashing_names_and_empty_tables(spark):
    rows = [(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3), (3, "other words here now", 1, 2, 3), (3, "another", 1, 2, 3), (None, "no id", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int, _rows int, _doc int")
    for percent in (None, 80):
        kept = simhash.keep_representatives(docs, 3 if percent is None else 5, percent)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text, r._kept) for r in kept.collect()) == [(0, "no id", 1), (1, "a b c d e f", 1), (3, "another", 1)]
        assert simhash.keep_representatives(docs.limit(0), 3 if percent is None else 5, percent).count() == 0
