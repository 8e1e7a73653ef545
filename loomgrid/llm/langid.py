"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter's place in an n-gram permutes (rotates) its vector, the product of
the permuted vectors binds them into the n-gram's vector, and a text's vector is the sum (bundle) of its n-grams' vectors. A
language's prototype is the bundle of all its training texts. A document gets the language whose prototype has the
largest cosine with its own vector.

Bundling is linear, so a text's n-gram counts times the n-gram vectors give its vector; only the n-grams that occur are
ever bound. Training adds one vector for each language and partition, summed by Spark: prototypes are whole numbers and
don't depend on the order. Whole texts are read, in batches bounded by characters.

Defined edge cases: null texts and texts without a letter are ``und`` with score 0; with no training text at all, every
document is ``und``; ties go to the first language by code point; rows are judged one by one; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
#: Letters: 0 is any run of others, 1 to 26 are a to z, the rest share what is left by code point.
SYMBOLS = 64
BATCH_CHARS, BATCH_DOCS = 1 << 20, 256
SEED = 20240229
#: Trigrams whose vectors are held at once; entries of a table of counts, unless a single text has more.
SLICE, TABLE = 4096, 1 << 21


@functools.lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Symbol of each code point, without regard to case."""
    out = np.zeros(0x110000, np.uint8)
    for p in range(0x110000):
        if not 0xD800 <= p < 0xE000 and chr(p).isalpha():
            q = ord(chr(p).lower()[0])
            out[p] = q - 96 if 97 <= q <= 122 else 27 + (q * 2654435761 >> 7) % (SYMBOLS - 27)
    return out


@functools.lru_cache(maxsize=2)
def letters(dimensions: int) -> np.ndarray:
    """For each place in a trigram the symbols' vectors, rotated."""
    own = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, dimensions), np.int8) * 2 - 1
    return np.stack([np.roll(own, 2 - k, axis=1) for k in range(3)]).astype(np.int8)


def trigram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    own = letters(dimensions)
    return (own[0][codes // (SYMBOLS * SYMBOLS)] * own[1][codes // SYMBOLS % SYMBOLS] * own[2][codes % SYMBOLS]).astype(np.float32)


def trigrams(text: str | None) -> np.ndarray:
    """Codes of a text's trigrams; runs of other characters count as one."""
    if not text:
        return np.zeros(0, np.int64)
    s = symbols()[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    if len(s) < 3:
        return np.zeros(0, np.int64)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def vectors(texts: list, dimensions: int) -> np.ndarray:
    """A vector for each text; zero where it has no letter."""
    codes = [trigrams(t) for t in texts]
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    if not len(flat):
        return np.zeros((len(texts), dimensions), np.float32)
    place = np.zeros(SYMBOLS**3, np.int64)
    place[flat] = 1
    known = np.flatnonzero(place)
    if len(texts) > 1 and len(texts) * len(known) > TABLE:
        half = len(texts) // 2
        return np.concatenate([vectors(texts[:half], dimensions), vectors(texts[half:], dimensions)])
    place[known] = np.arange(len(known))
    at = np.repeat(np.arange(len(texts)), [len(c) for c in codes]) * len(known) + place[flat]
    counts = np.bincount(at, minlength=len(texts) * len(known)).reshape(len(texts), len(known)).astype(np.float32)
    out = np.zeros((len(texts), dimensions), np.float32)
    for k in range(0, len(known), SLICE):
        out += counts[:, k : k + SLICE] @ trigram_vectors(known[k : k + SLICE], dimensions)
    return out


def groups(texts: list):
    """Slices of bounded size."""
    first = chars = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and (i - first >= BATCH_DOCS or chars + n > BATCH_CHARS):
            yield slice(first, i)
            first, chars = i, 0
        chars += n
    if texts:
        yield slice(first, len(texts))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their prototypes. What reaches the driver is one vector for each language."""

    def each(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang_").to_pylist()
            by: dict[str, list] = {}
            for k, t in zip(langs, batch.column("text_").to_pylist(), strict=True):
                by.setdefault(k, []).append(t)
            for k, texts in by.items():
                if k not in sums:
                    sums[k] = np.zeros(SYMBOLS**3, np.int64)
                for t in texts:
                    np.add.at(sums[k], *np.unique(trigrams(t), return_counts=True))
        for k, counts in sums.items():
            known = np.flatnonzero(counts)
            total = np.zeros(dimensions)
            for i in range(0, len(known), 4096):
                part = known[i : i + 4096]
                total += counts[part].astype(np.float64) @ trigram_vectors(part, dimensions)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.string()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["lang", "v"])

    slim = docs.select(F.col(lang).cast("string").alias("lang_"), F.col(text).alias("text_")).filter("lang_ is not null and text_ is not null")
    summed = slim.mapInArrow(each, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.transform("v", lambda e: e.x).alias("v")).collect()
    rows = sorted((r["lang"], r["v"]) for r in rows if any(r["v"]))
    return [k for k, _ in rows], np.array([v for _, v in rows], np.float64).reshape(len(rows), dimensions)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows with lang_pred and score (the cosine, 0 at least). Columns of these names are replaced."""
    langs, prototypes = model
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def each(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores = [], []
            for part in groups(texts):
                own = vectors(texts[part], dimensions)
                size = np.linalg.norm(own, axis=1)
                if langs:
                    cosines = own @ unit.T / np.maximum(size, 1e-12)[:, None]
                    best = cosines.argmax(axis=1)
                for i in range(len(own)):
                    known = bool(langs) and size[i] > 0
                    names.append(langs[best[i]] if known else "und")
                    scores.append(float(min(1.0, max(0.0, cosines[i, best[i]]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    slim = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("text__"))
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double"])
    return slim.mapInArrow(each, fields)


