import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loomgrid.llm import bpe, mixing

HARD = ["", " ", "\n\n \t", "a", "The   quick\tbrown fox's 12345 été ß 漢字 \U0001f600‍ x", "a" * 300, "%" * 200 + "=" * 77, "thequickbrown" * 30, "\x00\x01 \x7f", "don't I'll", "naïve—dash…"]


@pytest.fixture(scope="module")
def tokenizer():
    c = bpe.coder(bpe.default_path(), bpe.default_pattern())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def texts(n):
    rng = random.Random(n)
    return ["".join(rng.choice(["th", "e", " ", "ing", "é", "\n", "7", "x!", "ß", " of"]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_encodes_as_the_library_and_decodes_back(tokenizer):
    c = bpe.Coder(bpe.default_path(), bpe.default_pattern())
    for t, ids in zip(HARD + texts(200), c.encode(HARD + texts(200)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode_ordinary(t), t
    assert c.decode(c.encode(HARD)) == [t.encode() for t in HARD]


def test_pieces_cut_where_no_token_lies_across(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "PLAIN", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    c = bpe.Coder(bpe.default_path(), bpe.default_pattern())
    for t, ids in zip(HARD + texts(100), c.encode(HARD + texts(100)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode_ordinary(t)


def test_frames(spark, tokenizer):
    rows = [(i, t, "x") for i, t in enumerate([*HARD, None, HARD[4], HARD[4]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.digests(df).collect()}
    for i, t, _ in rows:
        ids = np.array(tokenizer.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    both = bpe.decoded(bpe.encoded(df)).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in both} == {i: t or "" for i, t, _ in rows}
    assert bpe.digests(df.filter("false")).collect() == []


def plain_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return share | {s: most * sizes[s] for s in capped}
        capped |= over


def corpus(seed, n=1500):
    rng = random.Random(seed)
    names = ["b", "a", "é", "B", None, "tiny", "hot"]
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), "hot" if rng.random() < 0.4 else rng.choice(names)) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "", None), (5, "x y", "tiny"), (5, "x y", "tiny"), (None, "q r s", "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mixture_is_near_targets(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(mixing.plan(df)).collect()
    assert len(got) == len(rows)
    own, want, most = {}, {}, {}
    for r in got:
        own[r["source"]] = own.get(r["source"], 0) + r["size"]
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
        assert r["taken"] <= 3 * r["size"] and r["copies"] >= 0
    expected = plain_targets(own)
    for r in got:
        assert r["source_size"] == own[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
    for s in own:
        assert abs(want[s] - expected[s]) <= most[s] + 1e-6
    again = mixing.taken(mixing.plan(df.repartition(5))).collect()
    key = lambda rs: sorted(tuple(str(x) for x in r) for r in rs)
    assert key(got) == key(again)


def test_whole_documents_are_repeated_as_planned(spark):
    rows = corpus(3, 400)
    df = spark.createDataFrame([(*r, r[0]) for r in rows], "doc_id long, text string, source string, size long")
    planned = {}
    for r in mixing.taken(mixing.plan(df)).collect():
        planned[(r["key"], r["source"])] = planned.get((r["key"], r["source"]), 0) + (1 if r["size"] == 0 else r["copies"])
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[(r["doc_id"], r["source"])] = got.get((r["doc_id"], r["source"]), 0) + 1
    assert got == {k: v for k, v in planned.items() if v}


def test_clashing_columns_and_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "AT_ONCE", 7)
    rows = [(1, "a b c", "s", "size_", "key_", "src", 5)] * 100 + [(i, "w " * (i % 9), "t", f"z{i}", "k", "x", i) for i in range(2, 60)]
    names = ["size_", "key_", "src", "copies"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size_ string, key_ string, src string, copies int").selectExpr("*", "1 as part", "2 as m", "3 as size")
    done = mixing.taken(mixing.plan(df)).collect()
    assert len(done) == len(rows)
    out = mixing.mixed(df).collect()
    given = {r[0]: r[3:] for r in rows}
    assert all(tuple(r[c] for c in names) == given[r["doc_id"]] and (r["part"], r["m"], r["size"]) == (1, 2, 3) for r in out)
    assert sum(r["doc_id"] == 1 for r in out) == sum(r["copies"] for r in done if r["key"] == 1)


def test_fractions_are_kept_in_expectation(spark):
    df = spark.createDataFrame([(i, "w " * (3 + i % 5), "a" if i % 10 else "b") for i in range(200)], "doc_id long, text string, source string")
    total = {}
    runs = 12
    for seed in range(runs):
        for r in mixing.taken(mixing.plan(df, weights=(1, 3), seed=seed)).collect():
            if r["source"] == "a":
                total[r["size"]] = total.get(r["size"], 0) + r["copies"]
    wanted = plain_targets({"a": sum(3 + i % 5 for i in range(200) if i % 10), "b": sum(3 + i % 5 for i in range(200) if not i % 10)}, (1, 3))["a"] / sum(3 + i % 5 for i in range(200) if i % 10)
    for z, n in total.items():
        of = sum(1 for i in range(200) if i % 10 and 3 + i % 5 == z)
        assert abs(n / (runs * of) - wanted) < 0.12


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(mixing.plan(df)).collect() == [] and mixing.mixed(df).collect() == []
    df = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted((r["key"], r["size"], r["taken"], r["target"]) for r in mixing.taken(mixing.plan(df)).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert mixing.mixed(df).count() == 2
