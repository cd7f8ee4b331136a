from collections import Counter

import pytest

from tests.llm.fixtures import SCHEMA, documents, text_of
from tests.llm.test_quality_mixing_sharding import brute_quality
from tests.llm.test_similar import brute_similar

pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


def test_every_stage_does_its_work(spark, tmp_path):
    import random

    import public_tokenizers

    import corpus_pipeline as cp

    rng = random.Random(9)
    rows = [(d, t, lang, source or "none", len(t or "")) for d, t, lang, source, *_ in documents(5)[:60]]
    rows += [(200 + i, text_of(rng, 60) + f" mail me.{i}@example.org", "en", "a", 1) for i in range(5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert SCHEMA.startswith(schema)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}

    passed = {d for d, t in text.items() for c in [brute_quality(t)] if not (c[0] < 20 or 100 * c[4] > 30 * c[0])}
    kept = cp.quality_rules(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == passed and kept.columns == docs.columns
    single = cp.simhash_near_dedup(spark, kept, "")
    classes, _ = brute_similar({d: text[d] for d in passed})
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    clean = cp.pii_pseudonyms(spark, single, "")
    out = {r.doc_id: r for r in clean.collect()}
    assert set(out) == set(classes.values()) and clean.columns == docs.columns
    for d, r in out.items():
        assert (r.text == text[d]) == (d < 200) and r.n_chars == len(r.text)
    mixed = cp.mix_sources(spark, clean, "")
    assert mixed.columns == docs.columns and set(Counter(r.doc_id for r in mixed.collect()).values()) <= {1, 2}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = cp.sentencepiece_ids(spark, mixed, "").collect()
    for r in coded:
        assert r.ids == library.encode(out[r.doc_id].text, add_eos=True) and r.n_tokens == len(r.ids) and r.round_trip
    whole = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((r.doc_id, r.n_tokens) for r in coded)
    assert [len(s) for s in cp.STAGES] == [2] * 5 and cp.ORACLE_SQL is None
