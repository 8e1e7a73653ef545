"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding makes disguises alike: case, accents, homoglyphs (Cyrillic, Greek, full-width letters), digits and signs that stand
for letters, marks between single letters, invisible characters. An entry is the beginning of a word, or a whole phrase, in
folded form. Matches inside an exception phrase don't count. A text's score is a logistic function of its matched weight,
in total and for each hundred words, so that long texts aren't condemned for a chance hit.

The lexicon is learned from a bounded sample of labelled rows (``FIT_ROWS``): word beginnings that toxic texts hold much
more often than others, weighted by their log odds; beside them stands a short list of given insults.

Defined edge cases: null and empty texts have no match and get the score of a text without any; with no labelled rows the
given list alone scores; rows are judged one by one; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows of either class are learned from, those of the smallest hashes.
FIT_ROWS = 10_000
#: Lengths of word beginnings that may become entries; entries at most.
SHORTEST, LONGEST, ENTRIES = 4, 12, 2_000
#: Word beginnings of the sample that are weighed, those in most toxic texts.
CANDIDATES = 100_000

#: Given insults and their weight, phrases in which they are harmless.
GIVEN = ("idiot", "moron", "stupid", "trash", "pathetic", "disgusting", "worthless", "clown", "loser", "scum")
GIVEN_WEIGHT = 4.0
EXCEPTIONS = ("clown fish", "clownfish", "class clown", "trash can", "trash bin", "trash bag", "idiot proof", "sore loser")

#: Characters that pass for Latin letters, in the order of what they pass for.
LOOKALIKES = {
    "a": "аαɑ@4", "b": "Ьβ8", "c": "сϲ¢(", "d": "ԁɗ", "e": "еεє3€", "g": "ɡԍ9", "h": "һн", "i": "іιıl1!|ӏ", "j": "јϳ", "k": "кκ", "m": "мμ", "n": "пη",
    "o": "оοσ0", "p": "рρ", "q": "ԛ", "r": "гя", "s": "ѕ$5", "t": "тτ7+", "u": "υц", "v": "ѵν", "w": "ԝωшѡ", "x": "хχ×", "y": "уγү¥", "z": "ᴢ2",
}
INVISIBLE = "­​‌‍⁠﻿"


@functools.lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    out = {}
    for p in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(p).lower())
        out[p] = "".join(c for c in base if not unicodedata.combining(c))
    out |= {p: "" for p in range(0x300, 0x370)} | {ord(c): "" for c in INVISIBLE}
    own = {}
    for to, froms in LOOKALIKES.items():
        own |= {ord(c): to for c in froms} | {ord(c.upper()): to for c in froms if len(c.upper()) == 1 and not c.isascii()}
    out |= own
    # what decomposes to a lookalike's own form follows it
    return {p: v if p in own else "".join(own.get(ord(c), c) for c in v) for p, v in out.items()}


SPELT = re.compile(r"(?<![^\W_])[^\W_](?:[.*_\-]{1,2}[^\W_]){2,}(?![^\W_])")
INNER = re.compile(r"(?<=[^\W\d_])[*_'’](?=[^\W\d_])")


def fold(text: str) -> str:
    """Folded text: words of letters, single blanks between and around them."""
    t = SPELT.sub(lambda m: re.sub(r"[.*_\-]", "", m[0]), text) if any(c in text for c in ".*_-") else text
    t = INNER.sub("", t).lower().translate(_table())
    return " " + " ".join(re.findall(r"[^\W\d_]+", t)) + " "


def beginnings(folded: str) -> set[str]:
    """Beginnings of the words of a folded text, whole words marked by a blank."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= SHORTEST:
            out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def sample(labels: DataFrame, key: str, label: str, bound: int) -> DataFrame:
    """At most bound rows of each class, those of the smallest hashes: sorted in parts, never in one task."""
    slim = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter("key is not null and y in (0, 1)").withColumn("h", F.xxhash64("key", F.lit("fit")))
    return slim.filter("y = 1").orderBy("h", "key").limit(bound).unionByName(slim.filter("y = 0").orderBy("h", "key").limit(bound)).select("key", "y")


def _counted(rows: DataFrame, keep: frozenset | None) -> DataFrame:
    """term, n1, n0, and the number of texts as term ''; with keep None, terms of toxic texts only."""

    def each(batches):
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if keep is None and not y:
                    n[0][""] += 1
                    continue
                terms = beginnings(fold(t or ""))
                n[y].update(terms if keep is None else terms & keep)
                n[y][""] += 1
        terms = sorted(n[0].keys() | n[1].keys())
        if terms:
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([n[1][t] for t in terms], pa.int64()), pa.array([n[0][t] for t in terms], pa.int64())], names=["term", "n1", "n0"])

    found = rows.select("y", "text").mapInArrow(each, "term string, n1 long, n0 long")
    return found.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


class Lexicon:
    """Entries with weights, and the logistic function over (1, matched weight, weight for each hundred words)."""

    def __init__(self, weights: dict[str, float], logistic=(-4.0, 0.5, 1.0), exceptions=EXCEPTIONS):
        self.weights, self.logistic, self.exceptions = weights, tuple(logistic), tuple(exceptions)

    def automaton(self):
        a = ahocorasick.Automaton()
        for w in self.exceptions:
            a.add_word(f" {fold(w).strip()}", (0.0, len(fold(w).strip()) + 1, True))
        for w, v in self.weights.items():
            if f" {w}" not in a:
                a.add_word(f" {w}", (v, len(w) + 1, False))
        a.make_automaton()
        return a

    def features(self, a, text: str | None) -> tuple[float, float]:
        """Matched weight, and that for each hundred words; of the entries that begin a word the heaviest counts."""
        if not text:
            return 0.0, 0.0
        folded = fold(text)
        safe: list[tuple[int, int]] = []
        at: dict[int, float] = {}
        for end, (v, n, spared) in a.iter(folded):
            start = end - n + 1
            if spared:
                if folded[end + 1 : end + 2] == " ":
                    safe.append((start, end))
            elif v > at.get(start, 0.0):
                at[start] = v
        total = sum(v for s, v in at.items() if not any(b <= s <= e for b, e in safe))
        return total, 100.0 * total / (folded.count(" ") + 20)

    def score(self, total: float, density: float) -> float:
        b, u, v = self.logistic
        z = b + u * math.log1p(total) + v * math.log1p(density)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Lexicon:
    """docs and labels hold only rows that may be learned from. Three passes: terms of toxic texts, their counts in the others, the logistic function."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample(labels, key, label, fit_rows)), "key")
    given = {fold(w).strip(): GIVEN_WEIGHT for w in GIVEN}
    first = _counted(rows, None).filter("n1 >= 5").orderBy(F.desc("n1"), "term").limit(CANDIDATES).collect()
    keep = frozenset(r["term"] for r in first if r["term"])
    if not keep:
        return Lexicon(given)
    counts = {r["term"]: (r["n1"], r["n0"]) for r in _counted(rows, keep).collect()}
    pos, neg = counts.pop("")
    least = max(5, pos // 200)
    odds = {t: math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1)) for t, (a, b) in counts.items() if a >= least}
    chosen: dict[str, float] = {}
    for t in sorted((t for t, v in odds.items() if v >= 2.0), key=lambda t: (len(t), t)):
        shorter = max((odds[t[:n]] for n in range(SHORTEST, len(t)) if t[:n] in chosen), default=None)
        if shorter is None or odds[t] >= shorter + 0.5:  # a longer beginning must say more
            chosen[t] = odds[t]
    weights = given | dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])
    return _fitted(Lexicon(weights), rows)


def _fitted(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    def each(batches):
        a = lexicon.automaton()
        for batch in batches:
            got = [lexicon.features(a, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), *(pa.array([g[k] for g in got], pa.float64()) for k in (0, 1))], names=["key", "y", "u", "v"])

    found = rows.select("key", "y", "text").mapInArrow(each, f"key {rows.schema['key'].dataType.simpleString()}, y int, u double, v double").orderBy("key", "u", "v").collect()
    x = np.array([(1.0, math.log1p(r["u"]), math.log1p(r["v"])) for r in found])
    y = np.array([r["y"] for r in found], float)
    if not 0 < y.sum() < len(y):
        return lexicon
    w, shrink = np.zeros(3), np.diag([1e-6, 1e-3, 1e-3]) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
    return Lexicon(lexicon.weights, [float(v) for v in w], lexicon.exceptions)


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows with score and predicted; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def each(batches):
        a = lexicon.automaton()
        for batch in batches:
            got = [lexicon.score(*lexicon.features(a, t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"])

    slim = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("text__"))
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "score double, predicted int"])
    return slim.mapInArrow(each, fields)
