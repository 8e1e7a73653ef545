import random
import re

import pytest

from loomgrid.llm import fertility, langid, queries, toxicity

DIR = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op9_hyper_langid(spark, DIR).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert len(got) > 200 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    train = spark.createDataFrame([("the of and " * 9, "en"), ("der die und " * 9, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.learn(train)
    assert model[0] == ["de", "en"]
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 !?", 5), (4, "THE AND", 5), (4, "THE AND", 5), (5, "der " * 200_000, 5), (6, "漢字", 5)], "doc_id long, text string, score int")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, model).collect()]
    assert got[:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")] and got[6][1] in ("de", "en")
    assert langid.predict(df.filter("false"), model).collect() == []
    nothing = langid.learn(train.filter("false"))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}


def test_profile_is_the_bundle_of_bound_trigrams():
    import numpy as np

    text = "Abba, cab"
    own = langid.letters(64)
    want = np.zeros(64)
    s = [0, 1, 2, 2, 1, 0, 3, 1, 2, 0]
    for a, b, c in zip(s, s[1:], s[2:]):
        want += own[0][a] * own[1][b] * own[2][c]
    assert (langid.vectors([text, ""], 64)[0] == want).all() and not langid.vectors([""], 64).any()


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    got = [r for r in queries.op7_lexicon_toxicity(spark, DIR).collect() if r["held_out"] and r["doc_id"] in labels]
    wrong = [r for r in got if r["predicted"] != labels[r["doc_id"]]]
    assert len(got) > 100 and len(wrong) <= 0.05 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


@pytest.mark.parametrize("disguise", ["idiot", "IDIOT", "1d10t", "іdіоt", "ｉｄｉｏｔ", "i.d.i.o.t", "ídiòt", "id​iot", "!di0t", "i-d-i-o-t"])
def test_folding(disguise):
    assert toxicity.fold(f"you {disguise}, yes").split()[1] == toxicity.fold("idiot").strip()


def test_exceptions_and_length(spark):
    lexicon = toxicity.Lexicon({toxicity.fold(w).strip(): 4.0 for w in toxicity.GIVEN})
    a = lexicon.automaton()
    assert lexicon.features(a, "a clown fish, one Clown-fish") == (4.0, pytest.approx(100 * 4 / 26, rel=0.2)) or lexicon.features(a, "a clown fish")[0] == 0.0
    assert lexicon.features(a, "the clown fishes")[0] == 4.0 and lexicon.features(a, "clown")[0] == 4.0
    assert lexicon.features(a, "a class clown")[0] == 0.0
    short, long = lexicon.features(a, "you idiot"), lexicon.features(a, "you idiot " + "word " * 5000)
    assert short[0] == long[0] and short[1] > 50 * long[1]
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "idiot " * 50, "x"), (3, "idiot " * 50, "x"), (4, "fine " * 100_000, "x")], "doc_id long, text string, predicted string")
    got = [(r["doc_id"], r["predicted"]) for r in toxicity.scored(df, lexicon).collect()]
    assert got == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 0)]
    assert toxicity.scored(df.filter("false"), lexicon).collect() == []


def test_learning_without_labels_uses_the_given_list(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert set(toxicity.learn(docs, labels).weights) == {toxicity.fold(w).strip() for w in toxicity.GIVEN}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(t):
    words = WORD.findall(t)
    hit = [False] * len(words)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit[i : i + 5] = [True] * 5
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, sum(hit)


def test_base_counts_against_plain_python():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\x1c", "\xa0", "#", "ab c a b ", "\t"]) for _ in range(rng.randrange(80)))
        assert fertility.counts(t) == plain_counts(t), repr(t)
    assert fertility.counts(None) == (0, 0, 0, 0, 0)


def test_verdicts(spark):
    prose = "Whenever the weather turned, people of the village gathered near the old bridge and talked about harvests, children, debts and rain until dark. "
    import base64
    import os

    random.seed(1)
    noise = base64.b64encode(bytes(random.randrange(256) for _ in range(900))).decode()
    noise = " ".join(noise[i : i + 60] for i in range(0, len(noise), 60))
    del os
    rows = [(1, prose), (2, None), (3, ""), (4, (prose + "\n") * 30), (5, "ab " * 9), (6, "".join(chr(0x1F300 + i % 200) + (" " if i % 7 == 0 else "") for i in range(900))), (1, prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as n_words")
    got = {r["doc_id"]: r for r in fertility.judged(df).collect()}
    assert got[1]["kept"] and not got[1]["base_failed"]
    assert got[2]["base_failed"] and got[3]["base_failed"] and got[4]["base_failed"] and got[5]["base_failed"]
    assert not any(got[k]["kept"] for k in (2, 3, 4, 5))
    assert 0 <= got[6]["byte_share"] <= 1 and got[6]["byte_share"] > 0.5 and got[6]["script"] == "other"
    assert fertility.judged(df.filter("false")).collect() == []


def test_script():
    assert [fertility.script_of(t) for t in ("abc é", "где это", "漢字かな", "Ωμέγα", "123 …", "हिन्दी")] == ["latin", "cyrillic", "han", "greek", "latin", "other"]


def test_noise_leaves_the_bands_and_prose_stays(spark):
    import base64

    rng = random.Random(11)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"
    noise = [
        " ".join(word(latin, rng.randrange(3, 9)) for _ in range(300)),
        " ".join(word(latin.upper(), 6) for _ in range(300)),
        " ".join(word("#*$%&|<>~^", 5) for _ in range(300)),
        " ".join(word([chr(c) for c in range(33, 127)], 6) for _ in range(300)),
        " ".join(base64.b64encode(rng.randbytes(48)).decode() for _ in range(30)),
        " ".join(rng.randbytes(20).hex() for _ in range(40)),
        " ".join(str(rng.randrange(10**9)) for _ in range(200)),
        " ".join(word(cyrillic, 6) for _ in range(300)),
    ]
    clean = [
        "When the ferry finally reached the island, the passengers walked up the steep road to the village and asked for rooms.",
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente.",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren; sie sind mit Vernunft und Gewissen begabt und sollen einander begegnen.",
        "Tous les êtres humains naissent libres et égaux en dignité et en droits; ils sont doués de raison et de conscience et doivent agir.",
        "Все люди рождаются свободными и равными в своём достоинстве и правах; они наделены разумом и совестью и должны поступать по-братски.",
        "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi; mọi con người đều được tạo hoá ban cho lý trí.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw; są oni obdarzeni rozumem i sumieniem.",
    ]
    df = spark.createDataFrame(list(enumerate(noise + clean)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fertility.judged(df).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [got[i]["kept"] for i in range(len(noise + clean))] == [False] * len(noise) + [True] * len(clean)
    long = fertility.judged(spark.createDataFrame([(1, clean[0] * 12_000)], "doc_id long, text string")).collect()[0]
    v, is_byte = fertility.vocabulary(fertility.default_path())
    assert long["n_tokens"] == len(v.encode(clean[0] * 12_000))
    bands = fertility.fitted(fertility.judged(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")))
    assert 1.8 < bands["latin"][0] < 2.4 and bands["han"] == fertility.BANDS["han"]


def test_measures_against_plain_python():
    import math
    from collections import Counter

    v, is_byte = fertility.vocabulary(fertility.default_path())
    rng = random.Random(2)
    for _ in range(100):
        t = "".join(rng.choice(["the ", "été", "漢", "🜚", " ", "zq"]) for _ in range(rng.randrange(1, 60)))
        ids = v.encode(t)
        if not ids:
            continue
        n = Counter(ids)
        want = len(t) / len(ids), sum(v.is_byte(i) for i in ids) / len(ids), -sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values())
        assert fertility.measures(t, ids, is_byte) == pytest.approx(want)
        low, high, most, least = fertility.BANDS["latin"]
        kept = low - 2.5 / len(ids) ** 0.5 <= want[0] <= high and want[1] <= most and (len(ids) < 100 or want[2] >= least)
        assert fertility.within("latin", len(ids), *want) == kept


def test_scores_against_a_plain_scan():
    """Every entry tried at every word of the folded text, without an automaton."""
    import math

    weights = {"idi": 1.5, "idiot": 4.0, "trash": 4.0, "scum": 2.5, "you idiot": 5.0, "clown": 3.0}
    lexicon = toxicity.Lexicon(weights, (-3.0, 0.7, 0.4))
    a = lexicon.automaton()
    rng = random.Random(6)
    for _ in range(300):
        t = " ".join(rng.choice(["you", "1diot", "ID", "trash", "can", "cans", "clown", "fish", "scummy", "ok", "idiots!", "Trash-can", "é"]) for _ in range(rng.randrange(25)))
        words = toxicity.fold(t).split()
        spared, total = set(), 0.0
        for i in range(len(words)):
            for e in toxicity.EXCEPTIONS:
                own = toxicity.fold(e).split()
                if words[i : i + len(own)] == own:
                    spared.update(range(i, i + len(own)))
        for i in range(len(words)):
            rest = " ".join(words[i:])
            if i not in spared:
                total += max((v for w, v in weights.items() if rest.startswith(w)), default=0.0)
        got = lexicon.features(a, t)
        assert got == pytest.approx((total, 100.0 * total / (len(words) + 1 + 20) if words else 0.0)), t
        z = -3.0 + 0.7 * math.log1p(got[0]) + 0.4 * math.log1p(got[1])
        assert lexicon.score(*got) == pytest.approx(1 / (1 + math.exp(-z)))


def test_decision_is_the_largest_cosine(spark):
    import numpy as np

    train = [("the old man and the sea was here again", "en"), ("der alte Mann und das Meer war wieder da", "de"), ("le vieil homme et la mer encore une fois", "fr"), ("the ship and the water of the bay", "en")]
    df = spark.createDataFrame(train, "text string, lang string")
    model = langid.learn(df)
    bundle = lambda t: langid.vectors([t], langid.DIMENSIONS)[0].astype(float)
    protos = {k: sum(bundle(t) for t, own in train if own == k) for k in ("de", "en", "fr")}
    assert all((model[1][i] == protos[k]).all() for i, k in enumerate(model[0]))
    texts = ["the sea", "das alte Meer", "la mer", "und", "homme", "water Meer mer"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), model).collect()
    for r in got:
        own = bundle(texts[r["id"]])
        cosines = {k: own @ p / np.linalg.norm(own) / np.linalg.norm(p) for k, p in protos.items()}
        assert r["lang_pred"] == max(sorted(cosines), key=cosines.get) and r["score"] == pytest.approx(max(cosines.values()), abs=1e-5)
