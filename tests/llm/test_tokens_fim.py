"""Token counts against the libraries, fill-in-middle against its definition in plain Python."""

import hashlib
import random
import re
import unicodedata

import pytest

from chartloom.llm import fill_in_middle, queries, token_counts
from tests.llm.fixtures import documents, frame

tokenizers = pytest.importorskip("public_tokenizers")


def library(name):
    path = tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        return lambda text: len(coder.encode(text, add_special_tokens=False))
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(coder.encode(text))


def counter(name):
    with open(tokenizers.path(name), "rb") as file:
        return token_counts.LengthCounter(file.read(), name[name.rindex(".") :])


NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
AWKWARD = [
    "", " ", "  ", "\n\n a", "a ", "a  ", " a  b ", "a　 b", "a\x85\x85 b", "a\x1c b", "x'll 's  don't", "a<|endoftext|>b", "a  <|endoftext|>  b", "<|endoftext|>", "<|startoftext|> x", "▁", "a▁ b", "a ▁b▁", "▁ ▁a  ▁", "日本 語。", "a\0 b",
    "é" * 3000, "ab cd " * 5000, " " * 4000, "a   b", "﻿ a", "</s> <s>", "👩‍👩‍👧 ok", "é ́x",
]


@pytest.mark.parametrize("name", NAMES)
def test_counts_equal_the_library(name, monkeypatch):
    count, own = library(name), counter(name)
    rng = random.Random(11)
    parts = ["a", "The", " ", "  ", "\n", "\t", "　", "\x1c", "\x85", "é", "'s", "12", "!?", "<|endoftext|>", "▁", "日", "😀", "\r\n", ".", "́"]
    texts = AWKWARD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    expected = [count(t) for t in texts]
    assert own.count(texts) == expected
    assert own.count(texts) == expected  # from what is remembered
    monkeypatch.setattr(token_counts, "STRIDE", 7)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 10)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    assert counter(name).count(texts) == expected
    assert own.count([None]) == [0]


def test_boundaries_next_to_every_space_and_control():
    count, own = library("byte_bpe_50k.json"), counter("byte_bpe_50k.json")
    odd = [chr(i) for i in range(0x3100) if unicodedata.category(chr(i)) in ("Zs", "Zl", "Zp", "Cc", "Cf")]
    for form in ("x{} y", "!{} !", "1{}  2", "a {}b", "{}\n{}", "  {}  a"):
        texts = [form.replace("{}", c) for c in odd]
        assert own.count(texts) == [count(t) for t in texts]


def test_counts_of_a_table(spark):
    rows = documents()
    count = library("byte_bpe_50k.json")
    docs = frame(spark, rows).withColumnRenamed("h", "n_tokens").withColumnRenamed("size", "row")
    found = token_counts.with_token_counts(docs, tokenizers.path("byte_bpe_50k.json"), limit=100).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted((r[0], len((r[1] or "").encode()), count(r[1] or ""), count(r[1] or "") > 100) for r in rows)
    assert token_counts.with_token_counts(docs.limit(0), tokenizers.path("byte_bpe_50k.json")).columns == [*(c for c in docs.columns if c != "n_tokens"), "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.with_token_counts(docs.limit(0), tokenizers.path("byte_bpe_50k.json")).count() == 0


def by_definition(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form, output = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < 80 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return (doc_id, n, form, len(prefix), len(middle), sha(output), sha(text))


def fim_rows():
    rows = [list(r) for r in documents(3, 300)]
    for i, text in enumerate(["<P> inside", "x <M", "P> y <", "😀 ok 😀😀 é́", "one", " ", "\n\n", "a b　c d", "<<S", "a\0b c"]):
        for k in range(6):
            rows.append([1000 + 10 * i + k, text, "en", "a", 1, 1, 1, "g", "x"])
    rows += [[None, "null id here", "en", "a", 1, 1, 1, "g", "x"]] * 2
    return [tuple(r) for r in rows]


def test_fill_in_middle_against_its_definition(spark, tmp_path):
    rows = fim_rows()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in queries.op13_fim(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(found, key=key) == sorted((by_definition(r[0], r[1]) for r in rows), key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_clashing_names_and_empty_tables(spark):
    docs = frame(spark, fim_rows()).withColumnRenamed("h", "_row").withColumnRenamed("size", "form").withColumnRenamed("fp", "_fill_in_middle")
    made = fill_in_middle.with_fill_in_middle(docs)
    assert made.columns == [*(c for c in docs.columns if c != "form"), *fill_in_middle.RESULTS]
    back = made.where(f"not (coalesce(text, '') <=> {'x'!r}) ").select("text", fill_in_middle.restored(made["output"], made["form"]).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)
    assert fill_in_middle.with_fill_in_middle(docs.limit(0)).count() == 0


def test_token_ends_over_strides(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(fill_in_middle, "STRIDE", 5)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "\n", "bcd", "é", "　", "😀"]) for _ in range(rng.randrange(60)))
        ends = [m.end() for m in re.finditer(fill_in_middle.TOKENS, text)]
        assert fill_in_middle.token_ends(text).tolist() == ends
