import hashlib
import random

import numpy as np
import pytest

from chartloom.llm import repeats
from tests.llm.fixtures import documents, frame


def brute(rows, length=50):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            x = data[i : i + length]
            first[x] = min(first.get(x, 2**62), 2**62 if doc is None else doc)
    out = {}
    for doc, text in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (2**62 if doc is None else doc):
                mask[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(data, mask) if not m)
        spans = sum(1 for i in range(len(mask)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.setdefault(doc, []).append((len(data), sum(mask), spans, kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["ü", "é", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.choice([2, 8, 40, 120]))) for i in range(60)]
    passages = [text(15) for _ in range(5)]
    rows += [(i, text(rng.randrange(20)) + rng.choice(passages) + text(rng.randrange(20)) + rng.choice(passages)) for i in range(60, 140)]
    for i in range(140, 170):
        w = rows[rng.randrange(60)][1].split()
        w[rng.randrange(len(w))] = "EDIT"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[rng.randrange(100)][1]) for i in range(170, 180)]
    rows += [(200, None), (201, ""), (202, "a" * 300), (203, "a" * 200), (204, "ab" * 100 + "a" * 60), (None, rows[3][1] + rows[70][1])]
    rows.append(rows[150])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk,segment", [(16 << 20, 1 << 20), (3000, 700)])
def test_remaining_bytes_match_brute_force(spark, monkeypatch, chunk, segment):
    """The small sizes cut documents over segments and deal them over many chunks and buckets."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(repeats, "LEAST_CHUNK", chunk)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", chunk)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rows = corpus(1)
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) in want[r.doc_id]


def assert_like_brute_force(spark, rows):
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) in want[r.doc_id]
    return found


def test_texts_that_collide_under_power_of_two_moduli(spark):
    """A Thue-Morse string and its complement have one polynomial hash modulo 2**64, whatever the base."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    rows = [(1, "x" * 30 + morse + "END"), (2, "x" * 30 + morse.translate(str.maketrans("ab", "ba")) + "END")]
    assert_like_brute_force(spark, rows)


def test_null_and_repeated_ids(spark):
    passage = "a passage of more than fifty bytes that several rows have in common, " * 3
    rows = [(None, passage + str(i)) for i in range(8)] + [(7, f"{i} " + passage) for i in range(4)] + [(9, passage), (9, passage), (None, None), (None, passage + "0")]
    found = assert_like_brute_force(spark, rows)
    assert all(r.n_removed == 0 for r in found if r.doc_id == 7) and all(r.n_removed >= len(passage) for r in found if r.doc_id is None and r.n_bytes)


def test_query_and_clashing_columns(spark, tmp_path):
    from chartloom.llm.queries import op4_repeats

    rows = documents(4)
    frame(spark, rows).withColumnsRenamed({"h": "chunk", "group": "kind", "size": "n_bytes", "fp": "kept"}).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([r[:2] for r in rows])
    found = op4_repeats(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in [(a, b, c, hashlib.sha256(k).hexdigest()) for a, b, c, k in want[r.doc_id]]


def test_empty_table(spark):
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_sliding_minimum():
    values = np.random.default_rng(0).integers(0, 100, 200).astype(np.uint64)
    for width in (1, 2, 3, 27, 32):
        assert repeats._sliding_min(values, width).tolist() == [int(values[i : i + width].min()) for i in range(200 - width + 1)]
