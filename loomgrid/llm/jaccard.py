"""N-gram Jaccard join by vertical partitioning.

All shingles stand in one global order, the frequent ones last. The order is cut into fragments: a document's prefix (the
part that any similar document must share something of) and, behind it, ranges of the order. Overlaps are counted fragment
by fragment and summed per pair; what the prefix fragment alone rules out goes no further.

1. ``set_rows``: each document's distinct shingles as 64-bit hashes; equal sets become one set. Shingles that are frequent
   within some partition are counted over all; the ``HEAVY`` most frequent come last in the order. The list decides only
   how much work is done, never the result.
2. Prefix rows (token, set, size, position) of tokens that several sets have in their prefixes are written, with their
   ranks among these.
3. First round: in every token's group, each set is paired with one hub, the set of least key. So a group of n near copies
   yields about n pairs, as most of their tokens have the same hub. Verified links give components.
4. Second round, exact: all pairs of a group whose components differ, filtered by size, by position, by rank among
   the prefix tokens that other prefixes have too, and by parities: each token flips one of ``PARITIES`` bits of its set, so
   two sets differ in as many tokens at least as their bits differ. What survives the prefix count is verified. Pairs inside a component
   need no test, for only components are returned; they aren't formed: of a token's rows, those whose component isn't the
   hub's meet the others.

Verification reads the candidate documents again (a bitmap of fixed size tells which), cuts their sets into fragments,
joins the pairs to them and sums the partial overlaps. Links, components and pairs stay DataFrames throughout; hubs and
hot tokens are joined from written tables, so that adaptive execution can split them.

Defined edge cases: null and blank texts have an empty set and link with nothing; texts shorter than a shingle are one
shingle as a whole; repeated rows and equal sets share a component; rows with a null id take part and have the smallest
non-null id of their component; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BITS, Scratch, bits_of, cut, has_bit, passing, written

#: Frequent shingles that are put last; a shingle is reported by a partition from so many sets on.
HEAVY, HEAVY_LOCAL = 1_000_000, 4
#: Ranges of the order behind the prefix.
FRAGMENTS = 4
#: Hubs that a set is verified against in the first round, those it shares most with; the second round is for all others.
HUBS = 4
#: Tokens that similar sets must share beyond one in the compared part of their prefixes.
MORE = 2
#: Bits of a set's parities, a multiple of 64; more bits tell larger sets apart. They decide only how much is verified.
PARITIES = 512
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 500_000


class _Hashes(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


_hashes = _Hashes()


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted hashes (int64) of a text's distinct shingles."""
    # of bytes, lower() changes A-Z only and split() parts at the blanks that words end at
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, 0x51ED270B * span, np.uint64)
    for k in range(span):
        out = _rotated(out * np.uint64(0x9E3779B97F4A7C15), 29) ^ h[k : len(h) - span + 1 + k]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((out ^ (out >> np.uint64(29))).view(np.int64))


def key_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))).view(np.int64)) if len(tokens) else 0


def parities(tokens: np.ndarray) -> np.ndarray:
    """PARITIES bits, as int64: of the tokens that fall to a bit, is the number odd?"""
    at = (tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    odd = np.bincount((at % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Order:
    """The global order: light tokens by hash, then heavy ones by count and hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]

    def sorted(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """A set in order, and how many of it are light."""
        if not len(self.tokens) or not len(s):
            return s, len(s)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        heavy = self.tokens[at] == s
        late = s[heavy]
        return np.concatenate([s[~heavy], late[np.lexsort((late, self.counts[at[heavy]]))]]), len(s) - len(late)


def prefix_length(n: int, percent: int) -> int:
    """So many first tokens; a set similar enough has one of them in its own first tokens."""
    return n - -(-percent * n // 100) + 1 if n else 0


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: (id, row, n, key, par) of each document, par its set's parities; kind 1: shingles frequent in a partition, with their counts, as (key, n)."""
    fields = [f"p{k}" for k in range(PARITIES // 64)]
    kind = pa.struct([(f, pa.int64()) for f in fields])

    def each(batches):
        kept: list[np.ndarray] = []
        seen: set[int] = set()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def count():
            tokens, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= HEAVY_LOCAL
            found.append((tokens[often], n[often]))
            kept.clear()

        for batch in batches:
            keys, sizes, pars = [], [], np.zeros((batch.num_rows, len(fields)), np.int64)
            for k, t in enumerate(batch.column("text").to_pylist()):
                s = shingles(t, width)
                keys.append(key_of(s))
                sizes.append(len(s))
                pars[k] = parities(s)
                if len(s) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    kept.append(s)
                    waiting += len(s)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(keys), pa.int32()), batch.column("id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.StructArray.from_arrays([pa.array(x.copy()) for x in pars.T], fields=list(kind))], names=["kind", "id", "row", "n", "key", "par"])
            if waiting > 6_000_000:
                count()
                seen.clear()
                waiting = 0
        if kept:
            count()
        for tokens, n in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int32)), pa.nulls(len(tokens), pa.int64()), pa.nulls(len(tokens), pa.int64()), pa.array(n), pa.array(tokens), pa.nulls(len(tokens), kind)], names=["kind", "id", "row", "n", "key", "par"])

    return docs.mapInArrow(each, f"kind int, id long, row long, n long, key long, par struct<{', '.join(f'{f}: bigint' for f in fields)}>")


def prefix_rows(docs: DataFrame, width: int, percent: int, order: Order) -> DataFrame:
    """(token, key, n, pos) of each set's prefix; a set that a partition holds more than once comes once from it."""

    def each(batches):
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for t in batch.column("text").to_pylist():
                s = shingles(t, width)
                key = key_of(s)
                if not len(s) or key in seen:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(key)
                out.append((order.sorted(s)[0][: prefix_length(len(s), percent)], key, len(s)))
            if out:
                sizes = [len(p) for p, _, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p for p, _, _ in out])), pa.array(np.repeat([k for _, k, _ in out], sizes)), pa.array(np.repeat([n for _, _, n in out], sizes).astype(np.int32)), pa.array(np.concatenate([np.arange(k) for k in sizes]).astype(np.int32))],
                    names=["token", "key", "n", "pos"],
                )

    return docs.mapInArrow(each, "token long, key long, n int, pos int")


def fragment_rows(docs: DataFrame, width: int, order: Order, bits: np.ndarray) -> DataFrame:
    """(key, frags) of the documents whose bit is set: light tokens by ranges of the order, heavy ones last."""

    def each(batches):
        for batch in batches:
            wanted = np.flatnonzero(has_bit(bits, batch.column("bit").to_numpy()))
            keys, lists = [], []
            for t in batch.column("text").take(pa.array(wanted)).to_pylist():
                s = shingles(t, width)
                if len(s):
                    inorder, light = order.sorted(s)
                    cuts = [0, *np.searchsorted(inorder[:light], EDGES), light, len(s)]
                    keys.append(key_of(s))
                    lists.append([inorder[cuts[f] : cuts[f + 1]] for f in range(len(cuts) - 1)])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.list_(pa.int64())))], names=["key", "frags"])

    return docs.mapInArrow(each, "key long, frags array<array<long>>")


#: Cuts of the hash range between the light fragments.
EDGES = np.array([-(1 << 63) + k * ((1 << 64) // (FRAGMENTS - 1)) for k in range(1, FRAGMENTS - 1)], np.int64)


def _needed(percent: int, n: Column, m: Column) -> Column:
    """Least overlap of similar sets of sizes n and m."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100.0 + percent) - F.lit(1e-9))


def _reach(percent: int, n: Column, m: Column) -> Column:
    """How many of the first tokens of a set of size n are compared with a set of size m.

    Similar sets share one of the first n - need + 1 tokens of both. MORE tokens make them share that many more, as far as
    the stored prefix goes.
    """
    stored = n - F.ceil(F.lit(percent) * n / F.lit(100.0) - F.lit(1e-9)) + 1
    return F.least(stored, n - _needed(percent, n, m) + 1 + MORE)


def _may(percent: int, a: str, b: str) -> Column:
    """Exact filters for a shared token: sizes, positions, and how much the sets can share before and behind it.

    What both hold before the token stands in both prefixes, so it counts to the ranks of both. Behind it, a prefix token
    that no other prefix has may still be shared: the other set can hold it behind its own prefix.
    """
    n, m, i, j, r, s = (F.col(f"{x}.{c}") for c in ("n", "pos", "rank") for x in (a, b))
    need = _needed(percent, n, m)
    compared = (i < _reach(percent, n, m)) & (j < _reach(percent, m, n))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & compared & (F.least(r, s) + 1 + F.least(n - i - 1, m - j - 1) >= need)


def _near(percent: int, a: str, b: str) -> Column:
    """Exact filter by parities: similar sets differ in no more tokens than their sizes and least overlap leave."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = [F.bit_count(F.col(f"{a}.par.p{k}").bitwiseXOR(F.col(f"{b}.par.p{k}"))) for k in range(PARITIES // 64)]
    return sum(bits[1:], bits[0]) <= n + m - 2 * _needed(percent, n, m)


def _promising(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x, n, y, m, c) whose count c of shared prefix tokens doesn't rule them out."""
    counted = pairs.groupBy("x", "y").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    n, m = F.col("n"), F.col("m")
    rest = F.greatest(n - _reach(percent, n, m), m - _reach(percent, m, n))
    return counted.filter(F.col("c") + rest >= _needed(percent, n, m)).select("x", "n", "y", "m", "c")


def verified(pairs: DataFrame, docs: DataFrame, first_ids: DataFrame, width: int, percent: int, order: Order, scratch: Scratch) -> DataFrame:
    """The links (x, y) among pairs (x, n, y, m): partial overlaps counted fragment by fragment and summed per pair.

    The fragments of candidate sets are stored in buckets by key, so pairs come to their y without moving sets. Few sets are
    an x; their fragments are stored apart, so that the join with them can be split where one x has many pairs.
    """
    wanted = pairs.select(F.col("x").alias("key")).unionByName(pairs.select(F.col("y").alias("key"))).distinct()
    bits = bits_of(first_ids.join(wanted, "key", "left_semi").select(F.xxhash64("id")))
    rows = fragment_rows(docs.withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(BITS))), width, order, bits)
    parts = scratch.bucketed(rows.groupBy("key").agg(F.first("frags").alias("frags")), "key")
    hubs = scratch.written(parts.join(pairs.select(F.col("x").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("x"), F.col("frags").alias("fx")))
    placed = pairs.join(parts.select(F.col("key").alias("y"), F.col("frags").alias("fy")), "y").join(hubs, "x")
    each = F.zip_with("fx", "fy", lambda a, b: F.size(F.array_intersect(a, b)))
    summed = placed.select("x", "y", "n", "m", F.aggregate(each, F.lit(0), lambda a, b: a + b).alias("o"))
    return summed.filter(F.col("o") * 100 >= (F.col("n") + F.col("m") - F.col("o")) * percent).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the least key reachable by links. Labels spread to neighbours and then jump to their label's label."""
    both = cut(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("l")).select(F.col("x").alias("key"), F.least("x", "l").alias("label")))
    while True:
        near = both.join(labels, both["x"] == labels["key"]).select(F.col("y").alias("key"), "label")
        spread = cut(near.unionByName(labels).groupBy("key").agg(F.min("label").alias("label")))
        to = spread.select(F.col("key").alias("label"), F.col("label").alias("further"))
        now = cut(spread.join(to, "label").select("key", F.least("label", "further").alias("label")))
        if not now.exceptAll(labels).limit(1).count():
            return now
        labels = now


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(key, n_shingles, component_id) for every row."""
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("row"))
    out = _placed(slim, width, percent)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _placed(slim: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, row, n, key, label, component_id) of every row (id, text, row); label and component_id are null for empty sets."""
    first = written(set_rows(slim, width), "kind")
    told = first.filter("kind = 0")
    rows = told.select("id", "row", "n", "key")
    heavy = first.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(HEAVY).toArrow()
    order = Order(heavy.column("key").to_numpy(), heavy.column("n").to_numpy())
    sets = written(told.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("par").alias("par")))
    links = _links(slim, sets, width, percent, order, Scratch(slim.sparkSession))
    label = components(links)
    least = sets.join(label, "key", "left").select("key", "id", F.coalesce("label", "key").alias("label"))
    least = written(least)
    of = least.groupBy("label").agg(F.min("id").alias("component_id"))
    placed = written(least.join(cut(of), "label").select("key", "label", "component_id"))
    return rows.join(placed, "key", "left")


def _links(slim: DataFrame, sets: DataFrame, width: int, percent: int, order: Order, scratch: Scratch) -> DataFrame:
    """Links between sets that connect all that are connected."""
    prefix = scratch.written(prefix_rows(slim, width, percent, order))
    several = scratch.written(prefix.groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("token"))
    shared = prefix.join(several, "token").groupBy("token", "key").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    shared = scratch.written(shared.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1))
    scratch.drop(prefix, several)
    # the same set is the hub of most tokens that its near copies share
    hubs = scratch.written(shared.groupBy("token").agg(F.min(F.struct("key", "n", "pos", "rank")).alias("b")))
    star = shared.join(hubs, "token").withColumn("a", F.struct("n", "pos", "rank"))
    star = star.filter((F.col("key") != F.col("b.key")) & _may(percent, "a", "b")).select(F.col("b.key").alias("x"), F.col("b.n").alias("n"), F.col("key").alias("y"), F.col("a.n").alias("m"))
    most = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("c"), "x"))  # a set has no more hubs than prefix tokens
    star = _promising(star, percent).withColumn("r", most).filter(F.col("r") <= HUBS).select("x", "n", "y", "m")
    star = scratch.written(star)
    found = written(verified(star, slim, sets, width, percent, order, scratch))
    scratch.drop(but=[shared])
    known = sets.select("key", "par").join(components(found), "key", "left").withColumn("label", F.coalesce("label", "key"))
    rows = scratch.written(shared.join(known, "key"))
    scratch.drop(shared)
    # pairs of one label need no test: only tokens of several labels count, and of these the rows that lack the hub's
    labels = rows.groupBy("token").agg(F.min_by("label", "key").alias("main"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    every, rows = rows, scratch.written(rows.join(scratch.written(labels.select("token", "main")), "token"))
    scratch.drop(every)
    a, b = rows.filter("label <> main").alias("a"), rows.alias("b")
    apart = (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.main")) | (F.col("a.key") < F.col("b.key")))
    cross = a.join(b, (F.col("a.token") == F.col("b.token")) & apart & _may(percent, "a", "b") & _near(percent, "a", "b"))
    first = F.col("a.key") < F.col("b.key")
    x, y = F.struct("a.key", "a.n"), F.struct("b.key", "b.n")
    cross = cross.select(F.when(first, x).otherwise(y).alias("x"), F.when(first, y).otherwise(x).alias("y")).select(F.col("x.key").alias("x"), F.col("x.n").alias("n"), F.col("y.key").alias("y"), F.col("y.n").alias("m"))
    cross = scratch.written(_promising(cross, percent))
    scratch.drop(rows)
    more = written(verified(cross, slim, sets, width, percent, order, scratch))
    scratch.drop()
    return found.unionByName(more)


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, whole: the one of least id, and of such the one of least shingle set and text hash.

    Rows that repeat both id and text are one document; documents with an empty set all stay. Null ids come last. What goes
    is joined by a hash of text and id; a bitmap of fixed size keeps the texts of most other rows out of the shuffle.
    """
    names = docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_, text_ = F.col(f"c{names.index(key)}").cast("long"), F.col(f"c{names.index(text)}")
    own = own.withColumns({"id": id_, "row": F.xxhash64(text_, id_)})
    placed = written(_placed(own.select("id", text_.alias("text"), "row"), width, percent).filter("n > 0").select("id", "row", "key", "label"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key", "row")
    best = placed.groupBy("label").agg(F.min(order).alias("best")).select("label", F.col("best.row").alias("stays"))
    gone = placed.join(written(best), "label").filter("row <> stays").select("row").distinct()
    again = placed.groupBy("row").agg(F.count("*").alias("c")).filter("c > 1").select("row")
    gone = written(gone.select("row", F.lit(True).alias("goes")).unionByName(again.join(gone, "row", "left_anti").select("row", F.lit(False).alias("goes"))))
    bits = bits_of(gone.select("row"))
    known = own.withColumn("bit", F.pmod("row", F.lit(BITS)))
    kinds = own.schema
    plain = known.mapInArrow(passing(bits, False), kinds)
    told = known.mapInArrow(passing(bits, True), kinds).join(gone, "row", "left")
    left = told.filter("goes is null").unionByName(told.filter("not goes").dropDuplicates(["row"]))
    out = plain.unionByName(left.select(*plain.columns))
    return out.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
