import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chartloom.llm import mixing, pii, quality, sharding, simhash
from tests.llm.fixtures import documents, frame, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_quality_counts_match_brute_force(spark):
    rows = documents()
    found = quality.with_verdicts(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in found:
        counts = brute_quality(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, r.doc_id
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r.base_failed and r.kept)


def test_a_bad_host_is_rejected_and_small_ones_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good, "en", "good", 1, 1, 1, "g", "x") for i in range(200)]
    rows += [(1000 + i, "too short" if i else good, "en", "bad", 1, 1, 1, "g", "x") for i in range(200)]
    rows += [(3000 + i, good, "en", f"small{i}", 1, 1, 1, "g", "x") for i in range(5)]
    kept = {r.doc_id for r in quality.kept_documents(frame(spark, rows)).collect()}
    assert kept == {*range(200), *range(3000, 3005)}
    by_host = {r.host: r for r in quality.host_verdicts(spark.createDataFrame([("a", 100, 5), ("b", 100, 90), ("c", 1, 1)], "host string, docs bigint, failed bigint")).collect()}
    assert by_host["c"].rate < 1 and by_host["a"].rate > 0.05


@pytest.mark.parametrize("seed", [0, 1])
def test_mixture_meets_targets(spark, seed):
    rows = documents(seed)
    found = mixing.mixture(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets, taken, largest = brute_targets(sizes), defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 2 * largest[s]
    again = mixing.mixture(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_taken_words_match_a_brute_force_mix(spark, seed):
    """Documents in order of their hash up to the target, the last one if that comes nearer."""
    rows = documents(seed) + [(None, text_of(random.Random(i), 30 + i), "en", "b", 1, 1, 1, "g", "x") for i in range(20)]
    docs = frame(spark, rows)
    found = mixing.mixture(docs).collect()
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", mixing.document_hash(F.col("doc_id"), F.col("text")).alias("h")).collect()}
    by_source = defaultdict(lambda: defaultdict(int))
    for r in rows:
        by_source[r[3]][hashes[r[0], r[1]]] += len(WORD.findall(r[1] or ""))
    sizes = {s: sum(v.values()) for s, v in by_source.items()}
    want = {}
    for s, target in brute_targets(sizes).items():
        whole = min(2, int(target // sizes[s])) if sizes[s] else 0
        total, rest = whole * sizes[s], target - whole * sizes[s]
        part = 0
        for h in sorted(by_source[s]):
            if rest <= 0 or part >= rest:
                break
            n = by_source[s][h]
            if part + n >= rest and not part + n - rest < rest - part:
                break
            part += n
        want[s] = total + part
    taken = defaultdict(int)
    for r in found:
        taken[r.source] += r.taken
    assert dict(taken) == want


CLASHES = ["n_words", "n_symbols", "rate", "base_failed", "kept", "counts", "row", "host", "of", "h", "whole", "threshold", "copies", "copy", "id", "size", "before", "need", "bucket", "_s", "lane", "shard", "part", "bytes", "group_key", "slot", "original", "found", "new", "fp", "digest", "node"]


def test_columns_may_have_any_name(spark):
    rows = [r[:5] for r in documents(4)] + [(None, "a text without an id " * 9, "en", "a", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = docs.select("*", *(F.lit("mine").alias(c) for c in CLASHES))
    plain = lambda df: sorted(map(str, df.collect()))
    for operator in (quality.kept_documents, mixing.mixed_documents, simhash.keep_representatives, lambda d: pii.with_pseudonyms(d, "k")):
        out = operator(extra)
        assert out.columns == extra.columns and {r[c] for r in out.collect() for c in CLASHES} == {"mine"}
        assert plain(out.select(docs.columns)) == plain(operator(docs))
    for operator in (mixing.mixture, sharding.assign_shards, simhash.near_duplicates):
        assert plain(operator(extra)) == plain(operator(docs))
    added = quality.COUNTS + ["base_failed", "rate", "kept"]
    judged = quality.with_verdicts(extra)
    assert len(judged.columns) == len(set(judged.columns)) and plain(judged.select("doc_id", *added)) == plain(quality.with_verdicts(docs).select("doc_id", *added))


def test_larger_budgets_take_supersets(spark):
    rows = [r for r in documents(2) if r[1]]
    small = {r.doc_id: r.copies for r in mixing.mixture(frame(spark, rows), share=0.5).collect()}
    large = {r.doc_id: r.copies for r in mixing.mixture(frame(spark, rows), share=0.9).collect()}
    assert all(large[d] >= c for d, c in small.items())


def test_mixed_documents_repeat_what_is_taken_twice(spark):
    docs = frame(spark, documents())
    copies = {r.doc_id: r.copies for r in mixing.mixture(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    count = Counter(r.doc_id for r in mixed.collect())
    repeated = {20: 2}
    assert count == {d: c * repeated.get(d, 1) for d, c in copies.items() if c}


def naive_best_fit(sizes, capacity):
    """Room left in each bin, one item and one bin at a time."""
    room = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, r in enumerate(room) if r >= size]
        if fitting:
            room[min(fitting, key=lambda i: (room[i], i))] -= size
        else:
            room.append(capacity - size)
    return room


def histogram(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def rooms(placed, capacity):
    room = {}
    for size, which, number in placed:
        room[which] = room.get(which, capacity) - size * number
    return [room[i] for i in sorted(room)]


def test_best_fit_decreasing_uses_the_tightest_room():
    assert sharding.best_fit_decreasing(histogram([6, 5, 4, 3]), 10) == [(6, 0, 1), (5, 1, 1), (4, 0, 1), (3, 1, 1)]
    assert sharding.best_fit_decreasing(histogram([11]), 10) is None
    assert sharding.best_fit_decreasing(histogram([5, 5, 5]), 10, most=1) is None
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([rng.randrange(1, 100), 7, 30]) for _ in range(rng.randrange(1, 120))]
        capacity = rng.randrange(100, 300)
        assert sorted(rooms(sharding.best_fit_decreasing(histogram(sizes), capacity), capacity)) == sorted(naive_best_fit(sizes, capacity))


def test_shards_are_packed_as_tight_as_naive_best_fit_allows():
    sizes = [(i * 7919) % 97 + 1 for i in range(500)]
    placed = sharding.pack(histogram(sizes), 8)
    assert Counter(s for s, _, n in placed for _ in range(n)) == Counter(sizes)
    load = Counter()
    for size, which, number in placed:
        load[which] += size * number
    best = next(c for c in range(-(-sum(sizes) // 8), sum(sizes)) if len(naive_best_fit(sizes, c)) <= 8)
    assert set(load) <= set(range(8)) and best <= max(load.values()) <= 1.002 * best + 1
    assert sharding.pack([(1000, 1), (1, 70)], 8)[0] == (1000, 0, 1)
    assert sharding.pack([], 8) == []


def test_many_sizes_are_bisected_by_classes_and_packed_exactly():
    rng = random.Random(8)
    sizes = [rng.randrange(17, 1 << rng.randrange(6, 24)) for _ in range(30_000)]
    assert len(set(sizes)) > 2 * sharding.EXACT_SIZES
    classes = sharding._classes(histogram(sizes))
    assert len(classes) < sharding.EXACT_SIZES and sum(n for _, n in classes) == len(sizes)
    placed = sharding.pack(histogram(sizes), 40)
    assert Counter(s for s, _, n in placed for _ in range(n)) == Counter(sizes)
    load = Counter()
    for size, which, number in placed:
        load[which] += size * number
    assert len(load) == 40 and max(load.values()) <= 1.003 * sum(sizes) / 40


def test_shards_are_even_gapless_and_keep_groups(spark):
    rows = documents(3, 400)
    rows += [(5000 + i, "copy of a very common text " * 3, "en", "a", 1, 1, 1, "g", "x") for i in range(1500)]
    rows += [(None, f"no id {i}", "en", "a", 1, 1, 1, "g", "x") for i in range(5)]
    found = sharding.assign_shards(frame(spark, rows), shards=8).collect()
    assert len(found) == len(rows)
    load, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    text = {r[0]: r[1] for r in rows}
    for r in found:
        if r.doc_id is None:
            load[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
            continue
        data = (text[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 16 and r.text_crc32 == zlib.crc32(data)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of_text[data].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(v) == 1 for v in of_text.values())
    of_group = Counter()
    for r in found:
        of_group[(text[r.doc_id] or "").encode() if r.doc_id is not None else b"?%d" % r.text_crc32] += r["size"]
    (common, largest), (_, second) = of_group.most_common(2)
    assert common.startswith(b"copy of") and largest > sum(load.values()) / 8
    (shard,) = of_text[common]
    assert set(load) == set(range(8)) and load[shard] == largest
    assert max(v for k, v in load.items() if k != shard) <= max(second, 1.03 * (sum(load.values()) - largest) / 7)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert quality.with_verdicts(empty).count() == 0
    assert quality.kept_documents(empty).count() == 0
    assert mixing.mixture(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert sharding.assign_shards(empty).count() == 0
