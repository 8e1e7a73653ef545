import hashlib
import random
import re

import pytest

from loomgrid.llm import jaccard, suffix
from loomgrid.llm.suffix import agreeing

import numpy as np


def plain_components(rows, width, percent):
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            ids[x] = min(i, ids.get(x, i))
    return sorted(((i, len(s), ids.get(x) if s else i) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def near_copies(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(words * 3)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,heavy", [(1, 2), (2, 10**6)])
def test_components_equal_brute_force(spark, monkeypatch, seed, heavy):
    monkeypatch.setattr(jaccard, "HEAVY_LOCAL", heavy)
    rng = random.Random(seed)
    texts = near_copies(seed, 60, 80, 5) + near_copies(seed + 10, 25, 12, 1) + [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(8))) for _ in range(60)]
    texts += [None, "", "  \n", "One two", "one TWO", "ONE", texts[0], texts[0].upper(), texts[3], "é É"]
    texts += ["shared opening line of ten words in many a text " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(20)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (7, texts[7]), (None, "entirely alone here")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_shingles", "1 as component_id")
    for width, percent in ((3, 90), (5, 80)):
        got = sorted((tuple(r) for r in jaccard.joined(df, width=width, percent=percent).collect()), key=str)
        assert got == plain_components(rows, width, percent)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_extended_texts_beside_short_ones_link(spark, monkeypatch, width, percent):
    """Short texts hold the phrases that stand in both prefixes, so that the short one is each phrase's hub."""
    monkeypatch.setattr(jaccard, "HEAVY_LOCAL", 10**6)
    rng = random.Random(width)
    texts = []
    for k in range(40):
        size = 60 + rng.randrange(60)
        a = [f"w{k}x{rng.randrange(10**9)}" for _ in range(size + width - 1)]
        most = size * (100 - percent) // percent
        b = a + [f"e{k}x{rng.randrange(10**9)}" for _ in range(most - k % 3)]
        sa, sb = (jaccard.shingles(" ".join(x), width) for x in (a, b))
        both = set(sa[: jaccard.prefix_length(len(sa), percent)].tolist()) & set(sb[: jaccard.prefix_length(len(sb), percent)].tolist())
        phrases = [" ".join(a[i : i + width]) for i in range(size)]
        texts += [" ".join(a), " ".join(b)] + [p for p in phrases if jaccard.shingles(p, width)[0] in both]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.joined(df, width=width, percent=percent).collect()), key=str)
    want = plain_components(rows, width, percent)
    assert sum(i != c for i, _, c in want) == 40
    assert got == want


def test_empty_tables_and_representatives(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.joined(df).collect() == [] and jaccard.representatives(df).collect() == []
    copies = near_copies(5, 20, 200, 1)
    rows = [(i, t) for i, t in enumerate(copies)] + [(50, None), (51, ""), (52, "a clean text of its own with words enough"), (0, copies[0])]
    got = sorted(r["doc_id"] for r in jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [0, 50, 51, 52]


def test_representatives_are_rows(spark):
    """An id of several texts loses only the text that has a copy; columns named like those used inside are passed on."""
    a, b = near_copies(6, 2, 60, 0)[0], "something else that stands nowhere but here and has words enough to count"
    rows = [(3, a, 1, "x"), (5, a, 2, "y"), (5, b, 3, "z"), (None, a, 4, "w"), (None, None, 5, "v"), (None, None, 6, "u"), (7, " ", 7, "t"), (7, " ", 8, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id_ int, row string").selectExpr("*", "'k' as key", "1 as bit", "2 as label")
    got = sorted((r["id_"], r["row"], r["key"], r["bit"], r["label"]) for r in jaccard.representatives(df).collect())
    assert got == [(i, x, "k", 1, 2) for i, x in ((1, "x"), (3, "z"), (5, "v"), (6, "u"), (7, "t"), (8, "s"))]


def test_a_token_of_a_third_of_all_sets(spark):
    """Texts that share a passage link only where they are alike; one large group of near copies stays one component."""
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [passage + " " + " ".join(f"u{rng.randrange(10**8)}" for _ in range(14)) for _ in range(150)]
    texts += near_copies(13, 150, 90, 2) + [passage] * 40 + [" ".join(f"s{rng.randrange(10**8)}" for _ in range(30)) for _ in range(100)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain_components(rows, 3, 90)


def test_alike_but_unlinked_sets_are_not_verified(spark, monkeypatch):
    """Many edits of one text, mostly too far from each other to link: parities keep nearly all pairs from verification."""
    pairs = []
    plain = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda p, *rest: pairs.append(p.count()) or plain(p, *rest))
    rng = random.Random(31)
    base = [f"w{k}" for k in range(140)]
    texts = []
    for _ in range(120):
        w = list(base)
        for k in rng.sample(range(140), 8):
            w[k] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts + near_copies(32, 20, 120, 2)))
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain_components(rows, 3, 90)
    assert pairs[-1] < 300


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = rng.integers(-(1 << 63), (1 << 63) - 1, rng.integers(0, 400), np.int64)
        b = np.concatenate((a[rng.integers(0, len(a) + 1) :], rng.integers(-(1 << 63), (1 << 63) - 1, rng.integers(0, 60), np.int64)))
        apart = (jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64)
        assert sum(int(x).bit_count() for x in apart) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_chains_reach_their_least_key(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 99), (200, 199)], "x long, y long")
    got = {r["key"]: r["label"] for r in jaccard.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {99: 99, 100: 99, 101: 99, 199: 199, 200: 199}


def test_interval_expansion_equals_comparing_suffixes():
    rng = random.Random(3)
    for _ in range(150):
        t = [rng.randrange(3) for _ in range(rng.randrange(1, 70))]
        n = rng.randrange(1, 7)
        order, same = agreeing(np.array(t, np.int64), n)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want
        assert same.tolist() == [r > 0 and len(t[want[r] :]) >= n and t[want[r] :][:n] == t[want[r - 1] :][:n] for r in range(len(t))]


def plain_removal(texts, length):
    seen = {}
    for k, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    gone = [bytearray(len(b)) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    return gone


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(150), prose(90)
    texts = [prose(rng.randrange(5, 300)) for _ in range(30)]
    texts += [prose(rng.randrange(40)) + passage + prose(rng.randrange(40)) for _ in range(12)]
    texts += [passage[k : k + 500] + other for k in (0, 37, 200)]
    texts += ["ab " * 400, "x" * 1000, "x" * 450, "x" * 399, passage, passage, "", None, "é" * 300, other[:399], other * 2]
    edited = list(passage)
    edited[300] = "#"
    return [*texts, "".join(edited), "".join(edited) + "!"]


@pytest.mark.parametrize("seed,hot", [(1, 512), (2, 1), (3, 2), (4, -1)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, hot):
    """hot 1: cores are cut to single strings; 2: every shared fingerprint goes the way of windows; -1: long texts come in parts."""
    if 0 < hot < 3:
        monkeypatch.setattr(suffix, "CELLS", ((1, 64), (hot, 32)))
    if hot == 1:
        monkeypatch.setattr(suffix, "AROUND", 1)
    if hot < 0:
        monkeypatch.setattr(suffix, "PART", 450)
    monkeypatch.setattr(suffix, "BLOCK", 4000)
    texts = corpus(seed)
    rows = list(enumerate(texts)) + [(33, texts[33]), (None, texts[40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_bytes", "'x' as spans")
    raw = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), b, g in zip(rows, raw, plain_removal(raw, 400), strict=True):
        runs = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        want.append((i, len(b), sum(g), runs, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest()))
    got = [tuple(r) for r in suffix.deduplicated(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_hot_place_meets_one_span(spark, monkeypatch, tmp_path):
    """Places of a hot passage are joined with one row for each window, however many ranges its strings were cut into."""
    monkeypatch.setattr(suffix, "CELLS", ((1, 64), (2, 32)))
    joined = []
    plain = suffix.Scratch.written
    monkeypatch.setattr(suffix.Scratch, "written", lambda self, df, *by: joined.append(out := plain(self, df, *by)) or out)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(80)) + passage + "".join(rng.choice("ij") for _ in range(k)) for k in range(30)]
    scratch = suffix.Scratch(spark)
    df = spark.createDataFrame([(i, 0, 1, t.encode()) for i, t in enumerate(texts)], "a long, b long, m long, bytes binary")
    got = {r["a"]: suffix.merged([(x["s"], x["e"]) for x in r["spans"]], len(texts[r["a"]])) for r in suffix.spans(df, 400, scratch).collect()}
    assert all(got[i][0][0] <= 80 and got[i][0][1] >= 980 for i in range(30))
    held = next(t for t in reversed(joined) if t.columns == ["fp", "wh", "s", "e"])
    assert held.count() == held.select("fp", "wh").distinct().count() > 0
    scratch.drop()


def test_clashing_columns_and_long_texts(spark):
    """Columns named like those used inside are passed on; a very long text with itself repeated loses what repeats."""
    rng = random.Random(8)
    once = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, once + once[:5000], 5, "x", 2, 3), (2, "short", 6, None, 4, 5), (3, "y" * 150_000, 7, "z", 6, 7)]
    df = spark.createDataFrame(rows, "id long, text string, bit int, spans string, a int, bytes int")
    got = {r["id"]: r for r in suffix.deduplicated(df, keep_text=True).collect()}
    assert [(got[i]["bit"], got[i]["spans"], got[i]["a"], got[i]["bytes"]) for i in (1, 2, 3)] == [r[2:] for r in rows]
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2, 3)] == [(10_000, 2), (0, 0), (150_000, 1)]


def test_kept_text_and_empty_table(spark):
    rows = [(1, "é" * 300 + "tail"), (2, "é" * 300), (3, None), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.deduplicated(df, keep_text=True).collect()}
    assert got[1]["kept_text"] == "tail" and got[2]["kept_text"] == "" and got[3]["kept_text"] is None and got[4]["kept_text"] == "short"
    assert suffix.deduplicated(df.filter("false")).collect() == []
