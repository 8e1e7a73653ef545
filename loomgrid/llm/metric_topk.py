"""Exact top-k inner products by M-trees and best-first search.

The largest inner product is a nearest neighbour in one dimension more: x becomes (x, sqrt(M^2 - |x|^2)) with M the largest
norm, a query (q, 0), and |q|^2 + M^2 - 2 q.x is their squared Euclidean distance. In that metric the upper level of the tree
is a table of at most ``CELLS`` pivots with the distances, least and largest, of the vectors nearest to each; every shard of
a cell gets an M-tree of pages: a node holds its entries' pivots, covering radii and distances to the node's own pivot.

A query visits nodes by their smallest possible distance. An entry whose stored parent distance already shows, by the
triangle inequality, that it lies beyond the k-th best costs no distance computation; a node beyond it ends the search.
Bounds only decide what is skipped; scores themselves are exact integers.

A cell's vectors are dealt out evenly to shards of about ``SHARD`` rows whatever they hold, so a vector that repeats a
million times fills no single one; each shard is a task of its own. A query first asks one shard of its nearest cell; its
k-th best score there rules out whole cells and starts the search in the others, of which each returns what beats it.

How much is skipped depends on the data: vectors in tight clusters are searched in few cells, while independent random
directions in 64 dimensions lie about equally far from each other, and next to every one of them is computed.

Defined edge cases: vectors null or with a null or non-finite component take no part; only vectors of the same length as
the query are candidates; rows with the query's id are its own and no candidates; of several rows with one query id the
smallest vector asks; repeated candidate rows count each; scores beyond 64 bits saturate; null ids take no part; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a shard, entries of a leaf page, children of an inner page, queries of a block.
SHARD, PAGE, FANOUT = 8_192, 256, 16
#: Pivots of the upper level.
CELLS = 64
#: Below this, sums of products of whole doubles are exact.
EXACT = float(1 << 52)
LONG = (1 << 63) - 1


class Node:
    """A page. ``centre``: its pivot; ``radius`` covers all below; ``to_parent``: the pivot's distance to the parent's pivot."""

    __slots__ = ("centre", "radius", "to_parent", "children", "pivots", "radii", "between", "rows", "to_centre")


class MTree:
    """Bulk-loaded from the rows of one shard; vectors are whole numbers as doubles."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        squares = (vectors * vectors).sum(axis=1)
        self.top = float(squares.max(initial=0.0))
        self.points = np.column_stack([vectors, np.sqrt(np.maximum(self.top - squares, 0.0))])
        self.whole = self.top < EXACT
        self.root = self._load(np.arange(len(ids)), self.points[0], np.random.default_rng(len(ids)))
        self.root.to_parent = 0.0
        self.visited = self.computed = 0

    def _distances(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        d = self.points[rows] - to
        return np.sqrt((d * d).sum(axis=1))

    def _load(self, rows: np.ndarray, centre: np.ndarray, rng) -> Node:
        node = Node()
        node.centre = centre
        far = self._distances(rows, centre)
        node.radius = float(far.max(initial=0.0))
        node.children, node.rows = None, None
        if len(rows) <= PAGE or node.radius == 0.0:
            order = np.argsort(far, kind="stable")
            node.rows, node.to_centre = rows[order], far[order]
            return node
        chosen = self.points[rng.choice(rows, min(FANOUT, len(rows)), replace=False)]
        near = ((chosen * chosen).sum(axis=1)[None, :] - 2 * self.points[rows] @ chosen.T).argmin(axis=1)
        parts = [rows[near == j] for j in range(len(chosen))]
        if max(map(len, parts)) == len(rows):  # no split: pivots coincide
            half = rows[np.argsort(far, kind="stable")]
            parts, chosen = [half[: len(half) // 2], half[len(half) // 2 :]], self.points[[half[0], half[-1]]]
        node.children = []
        for j, part in enumerate(parts):
            if len(part):
                child = self._load(part, chosen[j], rng)
                child.to_parent = float(np.sqrt(((chosen[j] - centre) ** 2).sum()))
                node.children.append(child)
        node.pivots = np.array([c.centre for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.between = np.array([c.to_parent for c in node.children])
        return node

    def _scores(self, rows: np.ndarray, query: np.ndarray, exact: bool) -> list[int]:
        if exact:
            return (self.vectors[rows] @ query).astype(np.int64).tolist()
        q = [int(v) for v in query]
        return [max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(self.vectors[r], q, strict=True)))) for r in rows]

    def best(self, query_id: int, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) with a score of least or more, the smaller id first among equal scores."""
        square = float(query @ query)
        exact = self.whole and math.sqrt(square * self.top) < EXACT
        point = np.append(query, 0.0)
        found: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        slack = 1e-9 * (square + self.top + 1.0)

        def limit() -> float:
            """Beyond this distance nothing can enter: that of the worst score kept; equal ones may still enter by a smaller id."""
            worst = max((x for x in (least, found[0][0] if len(found) == k else None) if x is not None), default=None)
            return math.inf if worst is None else math.sqrt(max(0.0, square + self.top - 2.0 * worst + slack)) + 1e-9

        reach = limit()

        queue: list[tuple[float, int, float, Node]] = []
        start = float(np.sqrt(((point - self.root.centre) ** 2).sum()))
        heapq.heappush(queue, (max(0.0, start - self.root.radius), 0, start, self.root))
        pushed = 1
        while queue:
            nearest, _, own, node = heapq.heappop(queue)
            if nearest > reach:
                break
            self.visited += 1
            if node.children is None:
                lo, hi = (np.searchsorted(node.to_centre, own - reach), np.searchsorted(node.to_centre, own + reach, "right")) if reach < math.inf else (0, len(node.rows))
                rows = node.rows[lo:hi]  # the others lie beyond by the triangle inequality
                if not len(rows):
                    continue
                self.computed += len(rows)
                rows = rows[self.ids[rows] != query_id]
                if exact:
                    scores = self.vectors[rows] @ query
                    if len(found) == k:
                        keep = scores >= found[0][0]
                    elif len(rows) > 4 * k + 64:
                        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    else:
                        keep = np.ones(len(rows), bool)
                    rows, listed = rows[keep], scores[keep].astype(np.int64).tolist()
                else:
                    listed = self._scores(rows, query, exact)
                for s, i in zip(listed, self.ids[rows].tolist(), strict=True):
                    if least is not None and s < least:
                        continue
                    if len(found) < k:
                        heapq.heappush(found, (s, -i))
                    elif (s, -i) > found[0]:
                        heapq.heapreplace(found, (s, -i))
                reach = limit()
                continue
            ahead = np.flatnonzero(np.abs(own - node.between) - node.radii <= reach)
            if not len(ahead):
                continue
            self.computed += len(ahead)
            d = node.pivots[ahead] - point
            d = np.sqrt((d * d).sum(axis=1))
            for j, dist in zip(ahead.tolist(), d.tolist(), strict=True):
                if (low := max(0.0, dist - node.radii[j])) <= reach:
                    heapq.heappush(queue, (low, pushed, dist, node.children[j]))
                    pushed += 1
        return sorted(((s, -i) for s, i in found), key=lambda x: (-x[0], x[1]))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(True))


class Upper:
    """The cells: pivots by vector length, and for each cell its shards and the range of its vectors' distances to the pivot."""

    def __init__(self, top: float, pivots: list[np.ndarray]):
        self.top = top
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p in pivots}):
            own = [k for k, p in enumerate(pivots) if len(p) == n]
            self.by[n] = np.array(own), self.raised(np.array([pivots[k] for k in own], np.float64).reshape(len(own), n))
        self.shards: dict[int, tuple[int, int]] = {}  # cell: first shard, number
        self.range: dict[int, tuple[float, float]] = {}

    def raised(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.top - (v * v).sum(axis=1), 0.0))])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each point (all of one length, raised) and its distance to the pivot; without pivots of that length one cell holds all."""
        n = points.shape[1] - 1
        if n not in self.by:
            return np.full(len(points), -1 - n % CELLS), np.zeros(len(points))
        cells, pivots = self.by[n]
        d = np.sqrt(np.maximum(((points[:, None, :] - pivots[None]) ** 2).sum(axis=2), 0.0)) if len(points) * pivots.size < 1 << 22 else np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
        at = d.argmin(axis=1)
        return cells[at], d[np.arange(len(points)), at]

    def first(self, query_id: int, query: np.ndarray) -> int | None:
        """The shard that a query asks first."""
        cell = int(self.nearest(np.append(query, 0.0)[None])[0][0])
        if cell not in self.shards:
            return None
        base, n = self.shards[cell]
        return base + query_id % n

    def others(self, query_id: int, query: np.ndarray, least: int | None) -> list[int]:
        """The other shards that may hold a score of least or more."""
        point, done, out = np.append(query, 0.0), self.first(query_id, query), []
        square = float(query @ query)
        reach = math.inf if least is None else math.sqrt(max(0.0, square + self.top - 2.0 * least + 1e-9 * (square + self.top + 1.0))) + 1e-9
        cells, pivots = self.by.get(len(query), (np.array([-1 - len(query) % CELLS]), None))
        far = np.sqrt(((pivots - point) ** 2).sum(axis=1)) if pivots is not None else np.zeros(1)
        for cell, d in zip(cells.tolist(), far.tolist(), strict=True):
            if cell in self.shards:
                lo, hi = self.range[cell] if cell >= 0 else (0.0, math.inf)
                if not max(d - hi, lo - d) - 1e-9 * (d + hi + 1.0) > reach:  # what can't be compared isn't ruled out
                    base, n = self.shards[cell]
                    out += [x for x in range(base, base + n) if x != done]
        return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def placed(rows: DataFrame, upper: Upper) -> DataFrame:
    """(id, v, cell, far) of rows (id, v)."""

    def each(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                lists = _lists(part.column("v"))
                cell, far = np.zeros(len(lists), np.int64), np.zeros(len(lists))
                sizes = np.array([len(x) for x in lists])
                for n in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == n)
                    cell[own], far[own] = upper.nearest(upper.raised(np.array([lists[i] for i in own], np.float64).reshape(len(own), n)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])

    return rows.select("id", "v").mapInArrow(each, "id long, v array<double>, cell int, far double")


def routed(asked: DataFrame, upper: Upper, again: bool) -> DataFrame:
    """(shard, id, v, least) of queries (id, v, least): the first shard, or all others that may matter."""

    def each(batches):
        for batch in batches:
            out = []
            lists = batch.column("v")
            for k, (i, least, q) in enumerate(zip(batch.column("id").to_pylist(), batch.column("least").to_pylist(), _lists(lists), strict=True)):
                to = upper.others(i, q, least) if again else [upper.first(i, q)]
                out += [(s, k) for s in to if s is not None]
            shard, at = (pa.array([x[j] for x in out], pa.int32()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([shard, batch.column("id").take(at), lists.take(at), batch.column("least").take(at)], names=["shard", "id", "v", "least"])

    return asked.select("id", "v", "least").mapInArrow(each, "shard int, id long, v array<double>, least long")


def _found(rows: DataFrame, asked: DataFrame, shards: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, computed) of what each shard finds for the queries routed to it."""
    both = rows.select("shard", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("long").alias("least")).unionByName(asked.select("shard", F.lit(1).alias("kind"), "id", "v", "least"))
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")

    def each(batches):
        shard, held, trees = None, [], None
        for batch in batches:
            which, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((which[1:] != which[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(which)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if which[lo] != shard:
                    shard, held, trees = which[lo], [], None
                part = batch.slice(lo, hi - lo)
                if not kinds[lo]:
                    held.append((part.column("id").to_numpy(), part.column("v")))
                    continue
                if trees is None:
                    trees = _trees(held)
                    held = []
                out = []
                for i, q, least in zip(part.column("id").to_pylist(), _lists(part.column("v")), part.column("least").to_pylist(), strict=True):
                    if tree := trees.get(len(q)):
                        before = tree.computed
                        got = tree.best(i, q, k, least)
                        out += [(i, i2, s, tree.computed - before if not j else 0) for j, (s, i2) in enumerate(got or [(0, None)])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score", "computed"])

    return dealt.mapInArrow(each, "query_id long, vec_id long, score long, computed long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, b): the k best as an array; partial results are cut to k before they are shuffled together."""
    entry = F.struct((-F.col("score").cast("decimal(20,0)")).alias("o"), "vec_id", "score")
    return found.filter("vec_id is not null").groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("b"))


def searched(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "v", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score, computed) of all shards' finds, and the queries; computed: distances and scores computed for it."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null")
    rows = written(rows)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("least", F.lit(None).cast("long"))
    top = rows.agg(F.max(square).alias("t")).first()["t"] or 0.0
    pivots = rows.select(F.xxhash64("v").alias("h"), "v").orderBy("h").limit(CELLS).collect()
    upper = Upper(float(top), [np.array(r["v"], np.float64) for r in pivots])
    cells = written(placed(rows, upper))
    shards = 0
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).orderBy("cell").collect():
        upper.shards[r["cell"]], upper.range[r["cell"]] = (shards, -(-r["n"] // SHARD)), (r["lo"], r["hi"])
        shards += -(-r["n"] // SHARD)
    first = F.create_map(*[x for c, (b, _) in upper.shards.items() for x in (F.lit(c), F.lit(b))]) if shards else F.create_map(F.lit(0), F.lit(0))
    number = F.create_map(*[x for c, (_, n) in upper.shards.items() for x in (F.lit(c), F.lit(n))]) if shards else F.create_map(F.lit(0), F.lit(1))
    dealt = cells.withColumn("shard", (first[F.col("cell")] + F.monotonically_increasing_id() % number[F.col("cell")]).cast("int"))
    dealt = written(dealt)
    near = written(_found(dealt, routed(asked, upper, False), max(shards, 1), k))
    floor = _best(near, k).filter(F.size("b") == k).select(F.col("query_id").alias("id"), F.element_at("b", k)["score"].alias("least"))
    again = asked.drop("least").join(floor, "id", "left")
    return near.unionByName(_found(dealt, routed(again, upper, True), max(shards, 1), k)), asked


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "v", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: ids with arrays of whole doubles; see ``usable``."""
    best = _best(searched(vectors, queries, key, vector, k)[0], k)
    ranked = best.select("query_id", F.posexplode("b").alias("i", "e"))
    return ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def _trees(held) -> dict[int, MTree]:
    """A tree for each length of vector."""
    by: dict[int, tuple[list, list]] = {}
    for ids, lists in held:
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        sizes = np.diff(at)
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            a, b = by.setdefault(n, ([], []))
            a.append(ids[own])
            b.append(flat[at[own][:, None] + np.arange(n)] if n else np.zeros((len(own), 0)))
    return {n: MTree(np.concatenate(a), np.concatenate(b).astype(np.float64)) for n, (a, b) in by.items()}
