import hashlib
import random

import pytest

from chartloom.llm import pieces
from tests.llm.fixtures import documents, frame

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.read_model(PATH))


def assert_same(model, library, texts):
    flat, ends = model.encode_batch(texts)
    bounds = [0, *ends.tolist()]
    for text, a, b in zip(texts, bounds, bounds[1:]):
        ids = flat[a:b].tolist()
        assert ids == library.encode(text, add_eos=True), text[:80]
        assert model.decode(ids) == library.decode(ids), text[:80]


def test_awkward_texts(model, library):
    assert_same(model, library, ["", " ", "  ", "▁", "▁▁a", "\n", "\n a", "a" * 5000, "ab" * 300, " " * 3000, "x" + " " * 17 + "y", "日本" * 200, "😀😀", "a\0b", "<s></s><unk><0x0A>", " \n "])


def test_random_texts(model, library):
    rng = random.Random(5)
    parts = ["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "ß", "😀", "<s>", "日", "ing", "tion", "A", "1", "22", ".", "　"]
    assert_same(model, library, ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)])


def test_long_words_without_spaces(model, library):
    """Unspaced scripts, encoded bytes, long runs: all of them go through the rounds."""
    import base64

    rng = random.Random(8)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(20_000))
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    blocks = [rng.choice(["ab", "aab", "aba", "tion", "ing", "inging", "ssss", "mississippi", "ea"]) for _ in range(4000)]
    assert_same(model, library, [cjk, letters, "".join(blocks), base64.b64encode(rng.randbytes(30_000)).decode(), " " * 10_001, "=" * 5003, "a" * 9999, "-=" * 3000, "ha" * 5001])


def test_interrupted_merges(model, library):
    """Repeats of short strings, where merging one pair can make a pair that comes before the next of its kind."""
    rng = random.Random(9)
    alphabets = ["ab", "esr", "ntio", "=-", "the", "aeiou", "01", "ing", "()"]
    texts = []
    for _ in range(4000):
        letters = rng.choice(alphabets)
        texts.append("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) * rng.randrange(1, 12) + rng.choice(letters))
    assert_same(model, library, texts)


def test_forgetting_words_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    for _ in range(3):
        assert_same(model, library, ["some few words", "and some others"])


def test_operator_matches_the_library(spark, library):
    rows = documents()
    docs = frame(spark, rows).withColumnRenamed("fp", "ids")
    found = pieces.encode_and_decode(docs, PATH).collect()
    assert len(found) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in found:
        want = library.encode(text[r.doc_id], add_eos=True)
        assert r.ids == want and r.decoded == library.decode(want)
    assert pieces.encode_and_decode(frame(spark, []), PATH).count() == 0


def test_query_digests(spark, library, tmp_path):
    from chartloom.llm.queries import op5_sentencepiece

    rows = documents(1)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] or "" for r in rows}
    for r in op5_sentencepiece(spark, str(tmp_path)).collect():
        ids = library.encode(text[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
