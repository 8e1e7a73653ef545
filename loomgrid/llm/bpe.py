"""Byte-level BPE encoding and decoding by DuckDB queries in each partition.

A text is cut by the public pattern; the pieces not known yet go into one recursive query: rows (word, position, token)
join the merge table, and each step contracts each word's leftmost pair of least rank; words of which no pair is in the
table are done. Decoding joins token rows to the vocabulary and aggregates their bytes in order.

That takes rows with the square of a word's bytes, so words over ``PLAIN`` bytes have a query that contracts more at once, to
the same result: where no contraction of the least rank makes a pair of lower rank, all of that rank are made in one step,
as they would be one after another. No merge crosses a place that lies inside no occurrence of any token; long pieces are
cut there first into words of their own.
Each task remembers up to ``REMEMBERED`` words, then starts anew; words go to DuckDB in blocks of ``BLOCK`` words or
``BLOCK_BYTES``, so memory has a bound, unless a single word is longer. Nothing is shuffled.

Defined edge cases: null texts count as empty and have no tokens; lone surrogates can't occur in Spark strings; rows are
encoded one by one; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN = 32
REMEMBERED, BLOCK, BLOCK_BYTES = 200_000, 30_000, 1 << 19
#: Tokens that one decoding query aggregates, at most, unless a single text has more.
DECODED_AT_ONCE = 1 << 20

#: One contraction of each word a step: its leftmost pair of least rank.
ENCODE = """
WITH RECURSIVE steps(word, pos, id, done) AS (
    SELECT word, pos, id, false FROM bytes_of
    UNION ALL
    (WITH pairs AS (
        SELECT p.word, p.pos, p.id, p.after, (m.merged << 32) + p.pos AS here
        FROM (SELECT *, CASE WHEN lead(word) OVER w = word THEN lead(id) OVER w END AS next, lead(pos) OVER w AS after FROM steps WHERE NOT done WINDOW w AS (ORDER BY pos)) p
        LEFT JOIN merges m ON m.pair = (CAST(p.id AS BIGINT) << 32) + p.next
    ), best AS (SELECT word, min(here) AS least, arg_min(after, here) AS gone FROM pairs GROUP BY word)
    SELECT p.word, p.pos, CASE WHEN p.here = b.least THEN b.least >> 32 ELSE p.id END, b.least IS NULL
    FROM pairs p JOIN best b USING (word) WHERE b.least IS NULL OR p.pos <> b.gone)
)
SELECT word, id FROM steps WHERE done ORDER BY pos
"""
#: All contractions of a word's least rank in one step, unless one of them makes a pair of lower rank (``odd``), which would
#: come before the next one; then the leftmost only. Pairs that overlap stand side by side (``run``); every other one is made.
ENCODE_LONG = """
WITH RECURSIVE steps(word, pos, id, done) AS (
    SELECT word, pos, id, false FROM bytes_of
    UNION ALL
    (WITH given AS (
        SELECT *, row_number() OVER w AS nr, lead(pos) OVER w AS after, CASE WHEN lag(word) OVER w = word THEN lag(id) OVER w END AS before,
            CASE WHEN lead(word) OVER w = word THEN lead(id) OVER w END AS next, CASE WHEN lead(word, 2) OVER w = word THEN lead(id, 2) OVER w END AS third
        FROM steps WHERE NOT done WINDOW w AS (ORDER BY pos)
    ), pairs AS (
        SELECT g.*, m.merged FROM given g LEFT JOIN merges m ON m.pair = (CAST(g.id AS BIGINT) << 32) + g.next
    ), best AS (SELECT word, min((merged << 32) + pos) AS least FROM pairs GROUP BY word),
    met AS (SELECT p.*, b.least FROM pairs p JOIN best b ON b.word = p.word AND b.least >> 32 = p.merged),
    made AS (SELECT word, merged, (merged << 32) + third AS pair FROM met UNION ALL SELECT word, merged, (before << 32) + merged FROM met UNION ALL SELECT word, merged, (merged << 32) + merged FROM met),
    odd AS (SELECT DISTINCT n.word FROM made n JOIN merges m USING (pair) WHERE m.merged < n.merged),
    runs AS (SELECT t.pos, t.after, t.nr - row_number() OVER (ORDER BY t.pos) AS run FROM met t LEFT JOIN odd USING (word) WHERE odd.word IS NULL OR t.least = (t.merged << 32) + t.pos),
    gone AS (SELECT pos, after FROM (SELECT pos, after, row_number() OVER (PARTITION BY run ORDER BY pos) AS nth FROM runs) WHERE nth % 2 = 1)
    SELECT p.word, p.pos, CASE WHEN t.pos IS NULL THEN p.id ELSE p.merged END, b.least IS NULL
    FROM pairs p JOIN best b USING (word) LEFT JOIN gone t ON t.pos = p.pos
    WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.after = p.pos))
)
SELECT word, id FROM steps WHERE done ORDER BY pos
"""
DECODE = "SELECT t.text AS text, string_agg(v.chars, '' ORDER BY t.pos) AS chars FROM tokens t JOIN vocabulary v USING (id) GROUP BY t.text ORDER BY t.text"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


class Coder:
    """One worker's connection, tables and words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32) + b)
                    merged.append(rank)
        self.begun = {t[:k] for t in self.ranks for k in range(1, len(t) + 1)}
        self._table("merges", pair=np.array(pairs, np.int64), merged=np.array(merged, np.int64))
        ids = sorted(self.ranks.values())
        by_id = {v: k for k, v in self.ranks.items()}
        self._table("vocabulary", id=np.array(ids, np.int64), chars=pa.array([by_id[i].decode("latin-1") for i in ids]))

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def cuts(self, b: bytes) -> list[bytes]:
        """b in parts between which no token lies across."""
        out, start, reach = [], 0, 0
        for i in range(len(b)):
            if i >= reach and i > start:
                out.append(b[start:i])
                start = i
            j = i + 1
            while j < len(b) and b[i : j + 1] in self.begun:
                j += 1
                if j > reach and b[i:j] in self.ranks:
                    reach = j
        return [*out, b[start:]]

    def learn(self, words) -> None:
        """Remembers the tokens of words."""
        short: list[str] = []
        long: dict[str, list[bytes]] = {}
        for w in words:
            b = w.encode("utf-8", "replace")
            if (rank := self.ranks.get(b)) is not None:
                self.known[w] = rank.to_bytes(4, "little")
            elif len(b) <= PLAIN:
                short.append(w)
            else:
                long[w] = self.cuts(b)
        for k in range(0, len(short), BLOCK):
            own = short[k : k + BLOCK]
            self.known.update(zip(own, self._learned(ENCODE, [w.encode("utf-8", "replace") for w in own]), strict=True))
        if long:
            parts = {x: self.ranks.get(x) for own in long.values() for x in own}
            done = {x: rank.to_bytes(4, "little") for x, rank in parts.items() if rank is not None}
            block, size = [], 0
            for x in [*(x for x, rank in parts.items() if rank is None), None]:
                if block and (x is None or len(block) >= BLOCK or size >= BLOCK_BYTES):
                    done.update(zip(block, self._learned(ENCODE_LONG, block), strict=True))
                    block, size = [], 0
                if x is not None:
                    block.append(x)
                    size += len(x)
            self.known.update((w, b"".join(map(done.__getitem__, own))) for w, own in long.items())

    def _learned(self, query: str, block: list[bytes]) -> list[bytes]:
        sizes = np.array([len(b) for b in block])
        word = np.repeat(np.arange(len(block), dtype=np.int32), sizes)
        ids = self.single[np.frombuffer(b"".join(block), np.uint8)]
        self.db.register("bytes_of", pa.table({"word": word, "pos": np.arange(len(word)), "id": ids}))
        got = self.db.sql(query).to_arrow_table()
        self.db.unregister("bytes_of")
        flat = got.column("id").to_numpy().astype("<u4")
        at = np.searchsorted(got.column("word").to_numpy(), np.arange(len(block) + 1))
        raw, at = flat.tobytes(), (4 * at).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        k = 0
        while k < len(texts):  # texts together whose words can all be remembered at once
            cut, pending = [], set()
            while k < len(texts) and (not cut or len(pending) < BLOCK):
                cut.append(self.split(texts[k]))
                pending.update(cut[-1])
                k += 1
            if new := pending.difference(self.known):
                if len(self.known) + len(new) > REMEMBERED:
                    self.known.clear()
                    new = pending
                self.learn(new)
            out += [b"".join(map(self.known.__getitem__, words)) for words in cut]
        return out

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each text."""
        out = [b""] * len(encoded)
        sizes = np.array([len(e) // 4 for e in encoded], np.int64)
        k = 0
        while k < len(encoded):
            first, total = k, 0
            while k < len(encoded) and (k == first or total + sizes[k] <= DECODED_AT_ONCE):
                total += sizes[k]
                k += 1
            if not total:
                continue
            text = np.repeat(np.arange(first, k), sizes[first:k])
            ids = np.frombuffer(b"".join(encoded[first:k]), "<u4").astype(np.int64)
            self.db.register("tokens", pa.table({"text": text, "pos": np.arange(total), "id": ids}))
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for i, chars in zip(got.column("text").to_pylist(), got.column("chars").to_pylist(), strict=True):
                out[i] = chars.encode("latin-1")
        return out


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with ``ids`` (array of int) instead of the text."""
    return _mapped(docs, text, "ids array<int>", path, pattern, lambda c, texts: [pa.array([np.frombuffer(e, "<i4") for e in c.encode(texts)], pa.list_(pa.int32()))])


def decoded(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with ``decoded`` (binary) instead of the ids; null ids decode to nothing."""
    return _mapped(rows, ids, "decoded binary", path, pattern, lambda c, lists: [pa.array(c.decode([np.asarray(x if x else [], "<u4").tobytes() for x in lists]), pa.binary())])


def digests(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with n_tokens, ids_sha256, decoded_sha256 instead of the text: encoded, then decoded from the ids."""

    def of(c: Coder, texts: list[str]) -> list[pa.Array]:
        ids = c.encode(texts)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array([len(e) // 4 for e in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, c.decode(ids)), pa.string())]

    return _mapped(docs, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, of)


def _mapped(rows: DataFrame, column: str, added: str, path: str | None, pattern: str | None, of) -> DataFrame:
    path, pattern = path or default_path(), pattern or default_pattern()
    names = [x.split()[0] for x in added.split(", ")]
    kept = [c for c in rows.columns if c != column and c not in names]
    text = rows.schema[column].dataType.simpleString() == "string"

    def each(batches):
        c = coder(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                given = part.column(part.num_columns - 1).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *of(c, [x or "" for x in given] if text else given)], names=[*part.schema.names[:-1], *names])

    slim = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias("given__"))
    return slim.mapInArrow(each, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), added]))
