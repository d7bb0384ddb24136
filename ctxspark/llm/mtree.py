"""Exact top-k by inner product: best-first search in M-trees."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm.common import cut

#: Entries of a tree's page; vectors of a tree, about; most pivots, and rings around each.
PAGE, SHARD, PIVOTS, RINGS = 128, 8192, 256, 64
#: Queries that one copy of a tree serves, and that go through it at a time.
QUERY_BLOCK, TOGETHER = 65_536, 1024


class Space:
    """Inner products as a metric: with one more component, a vector x gets the common length m, and a query 0 there.
    Then |q - x|^2 = |q|^2 + m^2 - 2 q.x, so the nearest vectors are those of the largest inner product."""

    def __init__(self, square: float):
        self.square = square

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.square - (x**2).sum(1, keepdims=True), 0))])

    def distance(self, qq: float, dots: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(qq + self.square - 2.0 * dots, 0))

    def limit(self, qq: float, score: float) -> float:
        """No vector with that inner product or a larger one is farther (with slack for rounding)."""
        return np.inf if score == -np.inf else float(self.distance(qq, np.float64(score))) * (1 + 1e-9) + 1e-6 * (1 + self.square) ** 0.5


class _Node:
    """A page: routing objects with covering radii and children, or (a leaf) vectors; each with its distance to the
    page's own routing object."""

    __slots__ = ("at", "children", "parent", "radius")


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, space: Space):
        self.ids, self.vectors, self.space = ids, vectors, space
        self.lifted = space.lift(vectors)
        self.top = self._build(np.arange(len(ids)), self.lifted[0])
        self.center = self.lifted[0]
        self.computed = 0  # distances and products so far, and those of each query of the last search
        self.by_query = np.zeros(0, np.int64)

    def _far(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.lifted[rows] - to) ** 2).sum(1))

    def _build(self, rows: np.ndarray, center: np.ndarray) -> _Node:
        node = _Node()
        if len(rows) <= PAGE:
            node.at, node.children = rows, None
            node.parent, node.radius = self._far(rows, center), np.zeros(len(rows))
            return node
        k = min(PAGE, ceil(len(rows) / PAGE))
        seeds = rows[np.linspace(0, len(rows) - 1, max(2, k)).astype(int)]
        a = self.lifted[rows]
        near = ((a**2).sum(1)[:, None] - 2 * a @ self.lifted[seeds].T + (self.lifted[seeds] ** 2).sum(1)).argmin(1)
        if np.bincount(near).max() > 0.9 * len(rows):  # mostly copies of one vector
            near = np.arange(len(rows)) * len(seeds) // len(rows)
        groups = [rows[near == g] for g in range(len(seeds))]
        seeds, groups = zip(*[(s, g) for s, g in zip(seeds, groups) if len(g)])
        node.at = np.array(seeds)
        node.children = [self._build(g, self.lifted[s]) for s, g in zip(seeds, groups)]
        node.parent = self._far(node.at, center)
        node.radius = np.array([self._far(g, self.lifted[s]).max() for s, g in zip(seeds, groups)])
        return node

    def _limits(self, qq: np.ndarray, score: np.ndarray) -> np.ndarray:
        out = np.full(len(qq), np.inf)
        some = score > -np.inf
        out[some] = self.space.distance(qq[some], score[some]) * (1 + 1e-9) + 1e-6 * (1 + self.space.square) ** 0.5
        return out

    def _leaves(self, q: np.ndarray, qq: np.ndarray, limit: np.ndarray):
        """Which leaf pages each query may need: (query, leaf, least distance, distance to its routing object). A routing
        object's distance is only computed for queries that the stored distances don't rule out."""
        far = self.space.distance(qq, q @ self.center[:-1])
        open_, out = [(self.top, np.arange(len(q)), np.zeros(len(q)), far)], []
        while open_:
            node, rows, low, far = open_.pop()
            if node.children is None:
                out.append((rows, node, low, far))
                continue
            near = np.abs(far[:, None] - node.parent) - node.radius <= limit[rows, None]
            for j, child in enumerate(node.children):
                at = np.flatnonzero(near[:, j])
                if len(at):
                    self.computed += len(at)
                    self.by_query[rows[at]] += 1
                    d = self.space.distance(qq[rows[at]], q[rows[at]] @ self.lifted[node.at[j], :-1])
                    least = np.maximum(d - node.radius[j], 0)
                    keep = least <= limit[rows[at]]
                    open_.append((child, rows[at][keep], least[keep], d[keep]))
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), a row per query: the k best of this tree that score at least known, ties to smaller ids, without
        the query's own id; places that stay empty have the least score. Each query takes its leaf pages from the
        nearest on and stops at the first beyond its bound; all queries go step by step together, by single pages at
        first and by a few at a time later on."""
        q = queries.astype(np.float64)
        qq = (q**2).sum(1)
        exact = self.space.square * max(1.0, float(qq.max(initial=0))) < 2.0**100  # |q.x| < 2^50
        none = np.iinfo(np.int64).min
        best, ids = np.full((len(q), k), none), np.full((len(q), k), np.iinfo(np.int64).max)
        limit = self._limits(qq, known)
        self.by_query = np.zeros(len(q), np.int64)
        pages = self._leaves(q, qq, limit)
        if not pages:
            return best, ids
        query = np.concatenate([p[0] for p in pages])
        page = np.concatenate([np.full(len(p[0]), i) for i, p in enumerate(pages)])
        low, far = (np.concatenate([p[i] for p in pages]) for i in (2, 3))
        order = np.lexsort((low, query))
        query, page, low, far = query[order], page[order], low[order], far[order]
        turn = np.arange(len(query)) - np.searchsorted(query, query)
        turn = np.where(turn < 4, turn, 4 + (turn - 4) // 8)
        for step in range(int(turn.max(initial=-1)) + 1):
            now = np.flatnonzero((turn == step) & (low <= limit[query]))
            for i in np.unique(page[now]).tolist():
                at, node = now[page[now] == i], pages[i][1]
                may = np.abs(far[at][:, None] - node.parent) <= limit[query[at], None]
                rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
                if not len(rows):
                    continue
                x, entries = query[at[rows]], node.at[cols]
                self.computed += len(rows) * len(cols)
                self.by_query[x] += len(cols)
                score = (q[x] @ self.vectors[entries].astype(np.float64).T).astype(np.int64) if exact else queries[x] @ self.vectors[entries].T
                score = np.where((score >= known[x, None]) & (self.ids[entries] != own[x, None]), score, none)
                better = score.max(1) >= best[x, -1]
                x, score = x[better], score[better]
                both = np.hstack([best[x], score])
                names = np.hstack([ids[x], np.broadcast_to(self.ids[entries], score.shape)])
                names[both == none] = np.iinfo(np.int64).max
                take = np.lexsort((names, ~both), axis=1)[:, :k]  # ~x falls as x rises, without overflow
                best[x], ids[x] = np.take_along_axis(both, take, 1), np.take_along_axis(names, take, 1)
                full = best[x, -1] > none
                limit[x[full]] = np.minimum(limit[x[full]], self._limits(qq[x[full]], best[x[full], -1].astype(np.float64)))
        return best, ids


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Cells:
    """Where vectors lie: each in the cell of its nearest pivot, and there in a ring of distances to it, so that a
    vector's distance to a query is at least what separates its ring from the query's own. A ring of more than SHARD
    vectors is several trees, dealt by hash. All of it is bounded by the numbers of pivots and rings."""

    def __init__(self, space: Space, ids: np.ndarray, pivots: np.ndarray):
        self.space, self.ids, self.pivots = space, ids, pivots
        self.cuts: dict[int, np.ndarray] = {}
        self.trees: dict[tuple[int, int], tuple[int, float, float]] = {}

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, centers = self.space.lift(vectors), self.space.lift(self.pivots)
        cell = np.maximum((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1), 0).argmin(1)
        return cell, np.sqrt(((x - centers[cell]) ** 2).sum(1))

    def ring(self, cell: np.ndarray, far: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), np.int64)
        for c in np.unique(cell).tolist():
            at = cell == c
            out[at] = np.searchsorted(self.cuts[c], far[at], "right")
        return out

    def close(self) -> None:
        """The rings, as arrays: cell, ring, trees, and least and largest distance to the pivot."""
        keys = sorted(self.trees)
        self.cell, self.at = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
        self.count = np.array([self.trees[k][0] for k in keys], np.int64)
        self.low, self.high = (np.array([self.trees[k][i] for k in keys], np.float64) for i in (1, 2))

    def reached(self, q: np.ndarray, own: int, k: int, known: float) -> tuple[np.ndarray, int, float]:
        """(rings that may hold one of the k best, the one that looks nearest, the score that they must reach)."""
        dots = self.pivots @ q
        others = np.sort(dots[self.ids != own])
        known = max(known, float(others[-k]) if len(others) >= k else -np.inf)
        qq = float((q.astype(np.float64) ** 2).sum())
        far = self.space.distance(qq, dots.astype(np.float64))[self.cell]
        apart = np.maximum(np.maximum(far - self.high, self.low - far), 0)
        slack = 1e-6 * (1 + self.space.square + qq) ** 0.5
        home = int(np.lexsort((self.low, apart, far))[0])
        return np.flatnonzero(apart <= self.space.limit(qq, known) + slack), home, known


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "id", vector_col: str = "vector", report: bool = False) -> DataFrame:
    """(query_id, rank, id, score): for each row of vectors with is_query the k rows of other ids with the largest inner
    product, ties to the smaller id. vectors: id bigint, vector array<bigint>; a row with a null id or a vector that is
    null or holds nulls takes no part; a shorter vector counts as filled up with zeros; rows that repeat a query's id
    are one query with the candidates of all. Products that might not fit 64 bits raise an error. With report, instead:
    (query_id, trees, computed), the trees that each query was sent to and the distances computed there.

    Each query first meets one tree, in the ring that looks nearest; its k-th score there, or among the pivots, bounds
    what it is sent to next: the trees of all rings that may hold a better one. A tree is built once for QUERY_BLOCK
    queries, which stream through it."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v"), is_query.alias("q"))
    v = cut(v.where("id is not null and v is not null").where(~F.exists("v", lambda x: x.isNull())))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, most, asked_most, n_queries = v.agg(F.count("*"), F.max(F.size("v")), F.max(square), F.max(F.when(F.col("q"), square)), F.count_if("q")).first()
    if float(most or 0) ** 0.5 * float(asked_most or 0) ** 0.5 >= 2.0**63:
        raise ValueError("inner products of these vectors may not fit 64 bits")
    space, width = Space(float(most or 0)), width or 0
    pivots = v.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, ceil(n / SHARD) or 1)).select("id", "v").collect()
    cells = Cells(space, np.array([r.id for r in pivots], np.int64), np.array([r.v + [0] * (width - len(r.v)) for r in pivots], np.int64).reshape(len(pivots), width))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = cells.nearest(_matrix(b.column("v"), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "v", "q", "cell", "far"])

    dealt = cut(v.mapInArrow(deal, "id long, v array<bigint>, q boolean, cell int, far double"))
    quantiles = F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 10_000)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), quantiles.alias("at")).collect():
        rings = min(RINGS, ceil(r.n / SHARD))
        cells.cuts[r.cell] = np.unique([r.at[RINGS * i // rings - 1] for i in range(1, rings)])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ring = cells.ring(b.column("cell").to_numpy(), b.column("far").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ring.astype(np.int32))], ["id", "v", "cell", "far", "ring"])

    entered = cut(dealt.select("id", "v", "cell", "far").mapInArrow(enter, "id long, v array<bigint>, cell int, far double, ring int"))
    for r in entered.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect():
        cells.trees[r.cell, r.ring] = (ceil(r.n / SHARD), r.low, r.high)
    cells.close()
    blocks = max(1, ceil(n_queries / QUERY_BLOCK))

    def send(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, ids, bound = _matrix(b.column("v"), width), b.column("id").to_numpy(), b.column("known").to_numpy(zero_copy_only=False)
                at, ring, tree, known = [], [], [], []
                for i in range(len(ids)):
                    rings, home, score = cells.reached(q[i], ids[i], k, -np.inf if np.isnan(bound[i]) else bound[i])
                    begin = int(ids[i]) % int(cells.count[home])
                    pairs = [(home, begin)] if first else [(r, t) for r in rings.tolist() for t in range(int(cells.count[r])) if (r, t) != (home, begin)]
                    at += [i] * len(pairs)
                    known += [score] * len(pairs)
                    ring += [r for r, _ in pairs]
                    tree += [t for _, t in pairs]
                take, ring = pa.array(at, pa.int64()), np.array(ring, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells.cell[ring].astype(np.int32)), pa.array(cells.at[ring].astype(np.int32)), pa.array(tree, pa.int32()), b.column("id").take(take), b.column("v").take(take), pa.array(known, pa.float64())], ["cell", "ring", "tree", "id", "v", "known"])

        return run

    sizes = spark.createDataFrame([(c, r, t) for (c, r), (t, _, _) in cells.trees.items()], "cell int, ring int, trees int")
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block")
    held = entered.join(F.broadcast(sizes), ["cell", "ring"])  # at most PIVOTS * RINGS rows
    held = held.select("cell", "ring", F.pmod(F.xxhash64("id", F.lit(1)), F.col("trees")).cast("int").alias("tree"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("q"), "id", "v", F.lit(None).cast("double").alias("known"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, tree = None, [], None
        for b in batches:  # rows come sorted by tree and block, the vectors before the queries
            t = pa.Table.from_batches([b])
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("cell", "ring", "tree", "block", "q")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if (where := key[a, :4].tolist()) != at:
                    at, parts, tree = where, [], None
                if not key[a, 4]:
                    parts.append(t.slice(a, z - a))
                    continue
                if tree is None and parts:
                    own = pa.concat_tables(parts).combine_chunks()
                    tree = MTree(own.column("id").to_numpy(), _matrix(own.column("v").chunk(0), width), space)
                    parts = []
                for i in range(a, z, TOGETHER) if tree is not None else ():
                    yield search(tree, t.slice(i, min(TOGETHER, z - i)).combine_chunks())

    def search(tree: MTree, t: pa.Table) -> pa.RecordBatch:
        ids = t.column("id").to_numpy()
        score, found = tree.search(_matrix(t.column("v").chunk(0), width), ids, k, t.column("known").to_numpy())
        out = np.stack([np.repeat(ids, k), found.ravel(), score.ravel()])[:, score.ravel() > np.iinfo(np.int64).min]
        work = np.concatenate([np.zeros(out.shape[1], np.int64), tree.by_query + 1])  # a row each for the report
        out = np.concatenate([out, np.stack([ids, ids, np.zeros(len(ids), np.int64)])], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in [*out, work]], ["query_id", "id", "score", "work"])

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInArrow(send(first), "cell int, ring int, tree int, id long, v array<bigint>, known double")
        sent = sent.select("cell", "ring", "tree", block, F.lit(True).alias("q"), "id", "v", "known")
        units = held.unionByName(sent).repartition("cell", "ring", "tree", "block").sortWithinPartitions("cell", "ring", "tree", "block", "q")
        return units.mapInArrow(meet, "query_id long, id long, score long, work long")

    queries = v.where("q").select("id", "v")
    near = cut(searched(queries.withColumn("known", F.lit(None).cast("double")), True))
    best = near.where("work = 0").groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s"))  # k a query
    best = best.select(F.col("query_id").alias("of"), F.get("s", F.lit(k - 1)).cast("double").alias("known"))
    found = near.unionByName(searched(queries.join(best, F.col("id") == F.col("of"), "left").select("id", "v", "known"), False))
    if report:
        return found.where("work > 0").groupBy("query_id").agg(F.count("*").alias("trees"), F.sum(F.col("work") - 1).alias("computed"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.where("work = 0").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
