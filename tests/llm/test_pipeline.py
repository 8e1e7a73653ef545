import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from test_duplicates import near_copies, plain_components, plain_removal  # noqa: E402

import corpus_pipeline  # noqa: E402
from loomgrid.llm import bpe, mixing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra_ string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "thing", "ever", "stone", "hand", "water"]) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(n))
    passage = prose(140)
    texts = [prose(rng.randrange(30, 120)) for _ in range(25)] + near_copies(4, 8, 120, 1) + [prose(20) + " " + passage + " " + prose(25) for _ in range(3)]
    rows = [(i, t, "en" if i % 9 else None, f"s{i % 3}", len(t), "x") for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, "123 456", "en", "s1", 7, "x"), (n + 1, None, None, None, None, None), (n + 2, "", "en", "s1", 0, "x"), (n + 3, texts[0], "en", "s1", len(texts[0]), "x"), (n + 4, passage, None, "s2", 1, "x")]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return rows, str(folder)


def test_each_stage_against_brute_force(spark, docs):
    rows, folder = docs
    df = spark.read.parquet(f"{folder}/documents.parquet")
    said = corpus_pipeline.languages(spark, df, folder)
    assert said.columns == df.columns
    kept = sorted((tuple(r) for r in said.collect()), key=lambda r: r[0])
    assert kept == [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]

    unique = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(kept, SCHEMA), folder)
    assert unique.columns == df.columns
    least = {i for i, n, c in plain_components([(r[0], r[1]) for r in kept], 5, 80) if i == c}
    left = sorted((tuple(r) for r in unique.collect()), key=lambda r: r[0])
    assert left == [r for r in kept if r[0] in least] and len(left) < len(kept) - 6

    cut = corpus_pipeline.passages(spark, spark.createDataFrame(left, SCHEMA), folder)
    assert cut.columns == df.columns
    raw = [r[1].encode() for r in left]
    want = {}
    for r, b, g in zip(left, raw, plain_removal(raw, 400), strict=True):
        if not all(g):
            text = bytes(x for x, y in zip(b, g, strict=True) if not y).decode("utf-8", "ignore")
            want[r[0]] = (r[0], text, *r[2:4], len(text) if any(g) else r[4], r[5])
    short = {r[0]: tuple(r) for r in cut.collect()}
    assert short == want and len(short) < len(left)

    frame = spark.createDataFrame(list(short.values()), SCHEMA)
    planned = {r["key"]: r["copies"] for r in mixing.taken(mixing.plan(frame)).collect()}
    mixed = [tuple(r) for r in corpus_pipeline.mixture(spark, frame, folder).collect()]
    assert sorted(mixed) == sorted(short[i] for i, n in planned.items() for _ in range(n))

    done = corpus_pipeline.tokens(spark, spark.createDataFrame(mixed, SCHEMA), folder).collect()
    c = bpe.coder(bpe.default_path(), bpe.default_pattern())
    for r in done:
        ids = c.encode([short[r["doc_id"]][1]])[0]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(short[r["doc_id"]][1].encode()).hexdigest()
    assert np.sum([r["n_tokens"] for r in done]) > 0

    whole = corpus_pipeline.run(spark, folder)
    key = lambda rs: sorted((r["doc_id"], r["ids_sha256"]) for r in rs)
    assert key(whole.collect()) == key(done)


def test_passages_of_over_fifty_words_go(spark):
    """Passages of 51 to 59 words, of fewer than 400 bytes each, in several documents; shorter ones stay."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages, phrases = [prose(rng.randrange(51, 60)) for _ in range(6)], [prose(20) for _ in range(6)]
    assert all(corpus_pipeline.PASSAGE < len(p.encode()) < 400 for p in passages) and all(len(p.encode()) < 200 for p in phrases)
    texts = [f"{prose(rng.randrange(5, 60))} {p} {prose(rng.randrange(5, 60))}" for p in (passages + phrases) * 4]
    out = corpus_pipeline.passages(spark, spark.createDataFrame([(i, t, "en", "s", len(t), None) for i, t in enumerate(texts)], SCHEMA), "")
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    raw = [t.encode() for t in texts]
    want = [bytes(x for x, y in zip(b, g, strict=True) if not y).decode("utf-8", "ignore") for b, g in zip(raw, plain_removal(raw, corpus_pipeline.PASSAGE), strict=True)]
    assert got == dict(enumerate(want))
    assert not any(p in t for p in passages for t in got.values()) and sum(p in t for p in phrases for t in got.values()) == 24


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
