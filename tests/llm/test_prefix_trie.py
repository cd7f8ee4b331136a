"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest

from chartloom.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def table(seed, conversations=150):
    """Copies, shared openings, one long conversation, gaps in ids and turns, nulls."""
    rng = random.Random(seed)
    rows, texts = [], ["hello", "what is it", "", None, "ünï 😀", "again", "yes", "no"]
    for c in rng.sample(range(0, 420), conversations) + [400, -5, -101]:
        kind = rng.random()
        words = ["hello", "what is it", "again"] if kind < 0.4 else [rng.choice(texts) for _ in range(rng.randrange(1, 9))]
        start = rng.choice([0, 1, 7])
        for i, text in enumerate(words):
            turn = None if i == 0 and rng.random() < 0.2 else start + 2 * i
            rows.append((c, turn, rng.choice(["user", "user", "assistant", None]) if kind >= 0.4 else "user", text))
    rows += [(777, i, "user", f"t{i % 3}") for i in range(300)] + [(778, i, "user", f"t{i % 3}") for i in range(290)]
    rows += [(None, 0, "user", "no id"), (None, 1, "user", "no id")]
    rng.shuffle(rows)
    return rows


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, said in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = turns.get(base, [])[:h] + said[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
            saved[node[:d]] = saved.get(node[:d], 0) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children.get(n, 0), leaves[n], saved[n], digest(ends.get(n, []))) for n, m in members.items()), key=repr)


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard_turns", [50_000, 40, 3])
def test_against_brute_force(spark, shard_turns):
    rows = table(shard_turns)
    assert nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), shard_turns)) == brute(rows)


def test_conversations_over_several_partitions_and_pieces(spark, monkeypatch):
    """Without coalescing, the long conversations are cut by the sort; small batches, flushes and pieces of paths."""
    rows = table(9)
    monkeypatch.setattr(prefix_trie, "PATH_PIECE", 7)
    monkeypatch.setattr(prefix_trie, "FLUSH_TURNS", 20)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), 25)) == brute(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_empty_table_clashing_names_and_turnless_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(empty).count() == 0
    rows = [(c, 0, "user", "x") for c in range(1, 40)] + [(5, 0, "user", "x")] * 2  # without an origin and with one turn most are left with none
    clash = "conv_id bigint, turn bigint, role string, text string, depth int, k1 int, part string, is_top int, `n.x` int, h int"
    df = spark.createDataFrame([(*r, 1, 1, "p", 1, 1, 1) for r in rows], clash)
    for shard_turns in (1, 100):
        assert nodes(prefix_trie.prefix_trie(df, shard_turns)) == brute(rows)


def test_order_of_ties(spark):
    """Turns of one number go by role; null turns come first."""
    rows = [(1000, None, "z", "first"), (1000, 1, "b", "third"), (1000, 1, "a", "second"), (1000, 1, None, "then"), (1000, 2, "a", "last")]
    assert nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_query_and_louds(spark, tmp_path):
    rows = table(4)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op12_trie(spark, str(tmp_path))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert nodes(found) == brute(rows)


def test_louds_bits():
    """Root with children a, b; a with children c, d: 10 for the super-root, then 110 110 0 0 0."""
    import numpy as np

    trie = prefix_trie.Louds(np.array([1, 2, 2, 0, 0, 0]), np.zeros((5, 2), np.int64))
    assert "".join("01"[int(b)] for b in trie.bits) == "10110110000"
    assert trie.parents().tolist() == [-1, 0, 0, 1, 1]
    assert trie.degrees().tolist() == [2, 2, 0, 0, 0]


def test_hash_arithmetic():
    import numpy as np

    rng, p = random.Random(3), prefix_trie.PRIME
    a, b = ([rng.choice([0, 1, p - 1, rng.randrange(p)]) for _ in range(3000)] for _ in range(2))
    assert prefix_trie.multiplied(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b)]
    assert prefix_trie.powers(prefix_trie.BASES[1], 70).tolist() == [pow(prefix_trie.BASES[1], i, p) for i in range(71)]
    sums = [sum(a[: i + 1]) % p for i in range(len(a))]
    assert prefix_trie.running(np.array(a, np.uint64)).tolist() == sums
