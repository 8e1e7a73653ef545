"""Quality rules on tokeniser fertility, after the base rules on words, symbols, lines and repeats.

A public vocabulary with byte fallback splits a text; characters per token, the share of byte-fallback tokens and the
entropy of the token distribution are held against the band of the text's script. Encoded data, words of random letters,
strings of symbols or digits and endless repeats leave the band; Latin letters with many marks, as languages have them that
the vocabulary knows less well, have a band of their own.

The bands' lower edges lie below the least characters per token of prose of 300 tokens or more: 2.03 over the first 3,000
documents of the sf0.1 test table (four languages in Latin script; random letters have 1.85, capitals 1.6, symbols 1.36), 2.3
for Russian (random letters 1.35). Shorter texts vary more, so the edge falls by ``SLACK`` over the root of the number of
tokens. ``fitted`` measures bands anew from any corpus.

Defined edge cases: null and empty texts have no words and fail the base rules; rows are judged one by one, whole texts, in
batches of bounded size; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
#: Bands by script: least and most characters per token, most byte-fallback share, least entropy (bits) of a text of 100 tokens or more.
BANDS = {
    "latin": (2.0, 8.0, 0.15, 4.0),
    "marked latin": (1.3, 8.0, 0.3, 4.0),
    "cyrillic": (1.55, 6.0, 0.15, 4.0),
    "greek": (0.6, 4.0, 0.5, 3.5),
    "han": (0.3, 3.0, 0.8, 4.0),
    "other": (0.25, 6.0, 0.95, 3.0),
}
SLACK = 2.5
#: Of the Latin letters, more than this share (and one) outside a to z make a text marked.
MARKED = 0.15
#: First code points of blocks and their script; what lies before belongs to the block before.
BLOCKS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x1E00, "latin"), (0x2E80, "han"), (0xA000, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str):
    import sentencepiece

    v = sentencepiece.SentencePieceProcessor(model_file=path)
    return v, np.array([v.is_byte(i) for i in range(v.vocab_size())])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def script_of(text: str) -> str:
    """The script of most letters; Latin where there is none."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letters = points[(points > 0xBF) | ((points | 32) - 97 < 26)]
    if not len(letters):
        return "latin"
    n = np.bincount(np.searchsorted([b for b, _ in BLOCKS], letters, "right") - 1, minlength=len(BLOCKS))
    by: dict[str, int] = {}
    for (_, s), k in zip(BLOCKS, n, strict=True):
        by[s] = by.get(s, 0) + int(k)
    most = max(sorted(by), key=by.get)
    return "marked latin" if most == "latin" and by["latin"] - int(((letters | 32) - 97 < 26).sum()) > MARKED * by["latin"] + 1 else most


def repeated(words: list[str], width: int = 5) -> int:
    """Words that lie in a window of width words which the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    own: dict[str, int] = {}
    codes = np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words))
    ids, span = codes, 1
    while span < width:  # exact: windows get the rank of their (first part, second part)
        step = min(span, width - span)
        pairs = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        if span + step == width:
            ids = pairs
        else:
            ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        span += step
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


WORDS = re.compile(WORD)


def counts(text: str | None) -> tuple[int, ...]:
    """The columns of COUNTS."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


def measures(text: str, ids: list[int], is_byte: np.ndarray) -> tuple[float, float, float]:
    """The columns of MEASURES."""
    if not ids:
        return 0.0, 0.0, 0.0
    got = np.asarray(ids)
    n = np.unique(got, return_counts=True)[1] / len(got)
    return len(text) / len(got), float(is_byte[got].mean()), float(-(n * np.log2(n)).sum())


def within(script: str, n_tokens: int, chars_per_token: float, byte_share: float, entropy: float, bands=None) -> bool:
    low, high, most, least = (bands or BANDS)[script]
    return low - SLACK / math.sqrt(max(n_tokens, 1)) <= chars_per_token <= high and byte_share <= most and (n_tokens < 100 or entropy >= least)


def judged(docs: DataFrame, text: str = "text", path: str | None = None, bands=None) -> DataFrame:
    """The rows with COUNTS, base_failed, kept, script, n_tokens and MEASURES; columns of these names are replaced."""
    path = path or default_path()
    added = [*COUNTS, "base_failed", "kept", "script", "n_tokens", *MEASURES]
    kept_columns = [c for c in docs.columns if c not in added]

    def each(batches):
        v, is_byte = vocabulary(path)
        for batch in batches:
            rows = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                t = t or ""
                base = counts(t)
                failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
                ids = v.encode(t, num_threads=1)
                m, script = measures(t, ids, is_byte), script_of(t)
                rows.append((*base, failed, not failed and within(script, len(ids), *m, bands), script, len(ids), *m))
            columns = list(zip(*rows, strict=True)) or [[]] * len(added)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int64()] + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names[:-1], *added])

    slim = docs.select(*[F.col(f"`{c}`") for c in kept_columns], F.col(text).alias("text__"))
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept_columns), *(f"{c} long" for c in COUNTS), "base_failed boolean, kept boolean, script string, n_tokens long", *(f"{c} double" for c in MEASURES)])
    return slim.mapInArrow(each, fields)


def fitted(measured: DataFrame, edge: float = 0.005, least_tokens: int = 300) -> dict[str, tuple[float, float, float, float]]:
    """Bands from the quantiles of judged documents of least_tokens or more that pass the base rules, edge of them outside each side.

    Scripts without such documents keep their band of ``BANDS``.
    """
    quantile = lambda c, q: F.percentile_approx(c, q, 10_000)
    rows = measured.filter(~F.col("base_failed") & (F.col("n_tokens") >= least_tokens)).groupBy("script")
    got = rows.agg(quantile("chars_per_token", edge).alias("low"), quantile("chars_per_token", 1 - edge).alias("high"), quantile("byte_share", 1 - edge).alias("most"), quantile("token_entropy", edge).alias("least"))
    return BANDS | {r["script"]: (r["low"], r["high"], r["most"], r["least"]) for r in got.collect()}
