"""Columns named like outputs are replaced, others kept; nulls everywhere; rows repeated."""

import pytest

from pagemint.llm import bpe, decontaminate, license_join, pii, quality, secret_scan, simhash, suffix_dedup, tiff, toxicity

COLUMNS = [
    "score", "predicted", "pii", "n_words", "hit_spans", "hit_items", "longest_match", "labels", "base_labels", "n_base", "first_word", "last_word",
    "page", "width", "samples", "error", "payload", "feature", "ids", "decoded", "fingerprint", "component", "removed", "kept", "row", "value", "key", "id", "spans",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a few words here", "o", "r"), (1, "a few words here", "o", "r"), (None, None, None, None), (2, "", None, "r"), (3, "x" * 70000, "o", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string, repository string")
    return df.selectExpr("*", *(f"'mine' as {c}" for c in COLUMNS)).cache()


def test_all_operators(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, None, None)], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([(1, "few words"), (None, None)], "item_id long, text string")
    import public_tokenizers as P

    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    outputs = {
        "bpe": bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks),
        "round trip": bpe.round_trip(docs, ranks, P.PATTERN),
        "secrets": secret_scan.scan(docs),
        "pii": pii.scan(docs),
        "redacted": pii.redact(docs),
        "scan": decontaminate.scan(docs, items),
        "remove": decontaminate.remove(docs, items),
        "features": tiff.features(tiff.store(docs)),
        "suffixes": suffix_dedup.dedup(docs),
        "simhash": simhash.dedup(docs),
        "licenses": license_join.scan(docs),
        "toxicity": toxicity.score(docs, toxicity.learn(docs, labels)),
        "quality": quality.score(docs, quality.learn(docs, labels)),
    }
    for name, df in outputs.items():
        rows = df.collect()
        assert len(rows) == (5 if name != "remove" else len(rows)), name
        assert len(set(df.columns)) == len(df.columns), name
    assert {r.score for r in outputs["redacted"].collect()} == {"mine"}
    assert {r.width for r in outputs["toxicity"].collect()} == {"mine"}
    assert simhash.keep_one(docs).count() == 3
    assert tiff.pages(tiff.store(docs)).count() == 6
