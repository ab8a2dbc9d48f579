"""Exact top-k by inner product with M-trees.

Vectors get one coordinate more, sqrt(M - |x|^2) with M the largest squared length (0 for queries),
so that the squared distance |q|^2 + M - 2 q.x falls as the inner product rises: the nearest
neighbours in that metric are the highest scores. The vectors are dealt to cells by their nearest
pivot; each cell is an M-tree of pages whose entries hold a routing vector, its covering radius and
its distance to the parent's routing vector. A query opens pages best first and stops when the next
one can't hold a better neighbour; entries that the stored parent distance and the triangle
inequality rule out are passed over without computing their distance.

A query first searches the cell of its nearest pivot. The score of its k-th result there is a bound
with which it then visits only those cells whose ball reaches beyond it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import narrow, written

SCALE = 1024
EXACT = 1 << 50        # squared scaled lengths below this go to the trees: all their products are exact in doubles
CELL, MAX_PIVOTS = 2048, 8192
TREE = 8192            # vectors of a tree; larger cells are several trees
PAGE = 64              # entries of a page
BLOCK = 4096           # queries that one task searches a tree for, or vectors of a block of the exact path
ROWS = 512             # rows whose distances to all pivots are computed at once

_PAGES = pa.schema([("tree", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), ("ids", pa.binary()), ("vectors", pa.binary()), ("radius", pa.binary()), ("parent", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


_SCALED = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("norm", pa.int64()), ("d", pa.int32()), ("wide", pa.binary())])


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(SCALE * x) of every component: as 32-bit integers (``v``), or as doubles (``wide``) where the squared
    length reaches EXACT; vectors that take no part are left out."""
    for batch in batches:
        ids, small, wide, norms, size = [], [], [], [], []
        for key, x in zip(batch.column("vec_id").to_pylist(), batch.column("x"), strict=True):
            if key is None or not x.is_valid or x.values.null_count:
                continue
            v = np.floor(SCALE * x.values.to_numpy(zero_copy_only=False).astype(float))
            if np.isfinite(v).all():
                norm = float(v @ v)
                near = norm < EXACT
                ids.append(key)
                small.append(v.astype("<i4").tobytes() if near else None)
                wide.append(None if near else v.astype("<f8").tobytes())
                norms.append(int(norm) if near else None)
                size.append(len(v))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, small, norms, size, wide), _SCALED, strict=True)], schema=_SCALED)


def matrix(rows: list[bytes], d: int) -> np.ndarray:
    """Vectors as rows of whole float64 numbers (short ones filled with zeros)."""
    return np.frombuffer(b"".join(r.ljust(4 * d, b"\0") for r in rows), "<i4").reshape(-1, d).astype(float)


class Metric:
    """Distances in the space with one more coordinate; products are exact as squared lengths are below
    EXACT, and distances are compared with a margin."""

    def __init__(self, d: int, most: int):
        self.d, self.most = d, float(most)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))])

    def of_query(self, norm: float, products: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norm + self.most - 2 * products, 0))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each row of x to each row of y."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def _margin(x: float) -> float:
    return x * (1 + 1e-9) + 1e-3


class Tree:
    """Pages of an M-tree. Page 0 is the root; entry k of an inner page is the parent of page ids[k]."""

    def __init__(self, metric: Metric):
        self.metric, self.pages = metric, {}

    def build(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Bulk load: the vectors are shared out to the nearest of some of them, again and again."""
        self.x, self.lifted, self.ids, self.free = x, self.metric.lift(x), ids, 1
        self._page(0, np.arange(len(ids)), None)

    def _page(self, page: int, rows: np.ndarray, parent: np.ndarray | None) -> float:
        """Make the page; returns the covering radius of its rows around ``parent``."""
        far = _apart(self.lifted[rows], parent[None])[:, 0] if parent is not None else np.zeros(len(rows))
        if len(rows) <= PAGE:
            self.pages[page] = (True, self.ids[rows], self.x[rows], np.zeros(len(rows)), far)
            return float(far.max(initial=0))
        count = min(PAGE, -(-len(rows) // PAGE))
        chosen = rows[np.linspace(0, len(rows) - 1, count + 1).astype(int)[:-1]] if count > 1 else rows[:1]
        near = _apart(self.lifted[rows], self.lifted[chosen]).argmin(1)
        groups = [(c, rows[near == k]) for k, c in enumerate(chosen) if (near == k).any()]
        if len(groups) < 2:  # all alike: share them out evenly
            groups = [(part[0], part) for part in np.array_split(rows, max(2, count))]
        children, radius = [], []
        for center, part in groups:
            children.append(self.free)
            self.free += 1
            radius.append(self._page(children[-1], part, self.lifted[center]))
        centers = np.array([c for c, _ in groups])
        away = _apart(self.lifted[centers], parent[None])[:, 0] if parent is not None else np.zeros(len(centers))
        self.pages[page] = (False, np.array(children, np.int64), self.x[centers], np.array(radius), away)
        return float(far.max(initial=0))

    def search(self, query: np.ndarray, own: int, k: int, bound: float | None) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best of the tree that score ``bound`` or more: (ids, scores, distances computed)."""
        norm = float(query @ query)
        ids, scores, computed = np.zeros(0, np.int64), np.zeros(0), 0

        def reach() -> float:
            least = scores[-1] if len(scores) == k else -math.inf
            least = max(least, bound) if bound is not None else least
            return math.inf if least == -math.inf else _margin(float(self.metric.of_query(norm, np.array(least))))

        limit = reach()
        heap: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
        while heap:
            least, page, to_parent = heapq.heappop(heap)
            if least > limit:
                break
            leaf, keys, x, radius, parent = self.pages[page]
            if to_parent >= 0 and limit < math.inf:
                # by the triangle inequality, from distances that are stored
                near = np.abs(to_parent - parent) - radius <= limit
                if not near.all():
                    keys, x, radius = keys[near], x[near], radius[near]
            computed += len(keys)
            product = x @ query
            if leaf:
                keep = keys != own
                if bound is not None:
                    keep &= product >= bound
                if len(scores) == k:
                    keep &= product >= scores[-1]
                if keep.any():
                    ids, scores = np.concatenate([ids, keys[keep]]), np.concatenate([scores, product[keep]])
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                    limit = reach()
            else:
                away = self.metric.of_query(norm, product)
                for key, distance, r in zip(keys.tolist(), away.tolist(), radius.tolist(), strict=True):
                    if (lower := max(0.0, distance - r)) <= limit:
                        heapq.heappush(heap, (lower, key, distance))
        return ids, scores.astype(np.int64), computed


def build_trees(vectors: DataFrame, metric: Metric) -> DataFrame:
    """Pages of the trees of rows (tree, vec_id, v); a tree has about TREE vectors at most."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        tree = Tree(metric)
        tree.build(group.column("vec_id").to_numpy(), matrix(group.column("v").to_pylist(), metric.d))
        number = group.column("tree")[0].as_py()
        rows = [(number, p, leaf, ids.astype("<i8").tobytes(), x.astype("<i4").tobytes(), r.tobytes(), far.tobytes()) for p, (leaf, ids, x, r, far) in tree.pages.items()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGES, strict=True)], schema=_PAGES)

    return vectors.select("tree", "vec_id", "v").groupBy("tree").applyInArrow(build, "tree int, page int, leaf boolean, ids binary, vectors binary, radius binary, parent binary")


def search_trees(queries: DataFrame, pages: DataFrame, metric: Metric, k: int, blocks: int) -> DataFrame:
    """Search trees for queries (tree, query_id, v, bound), BLOCK of them at a time or so."""

    def search(mine: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if mine.num_rows and own.num_rows:
            tree = Tree(metric)
            for page, leaf, ids, x, radius, parent in zip(*(own.column(c).to_pylist() for c in ("page", "leaf", "ids", "vectors", "radius", "parent")), strict=True):
                tree.pages[page] = (leaf, np.frombuffer(ids, "<i8"), np.frombuffer(x, "<i4").reshape(-1, metric.d).astype(float), np.frombuffer(radius), np.frombuffer(parent))
            for key, q, bound in zip(mine.column("query_id").to_pylist(), matrix(mine.column("v").to_pylist(), metric.d), mine.column("bound").to_pylist(), strict=True):
                ids, scores, _ = tree.search(q, key, k, bound)
                out += zip([key] * len(ids), ids.tolist(), scores.tolist(), strict=True)
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], schema=_FOUND)

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    left = queries.withColumn("block", block).groupBy("tree", "block")
    # a tree's pages go to the blocks that have a query for it
    asked = queries.select("tree", block.alias("block")).distinct()
    right = pages.join(asked, "tree").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score long")


def _exact_best(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, rough: np.ndarray, slack: float, k: int) -> list[tuple[int, int, int]]:
    """The k best of a block for one query by exact integers: products in doubles, off by ``slack`` at most, tell
    which vectors can be among them."""
    mine = np.flatnonzero(ids != own)
    if len(mine) > k:
        least = np.partition(rough[mine], len(mine) - k)[len(mine) - k] - 2 * slack
        mine = mine[~(rough[mine] < least)]
    whole = [int(c) for c in q]
    scores = sorted((-sum(a * int(b) for a, b in zip(whole, x[i], strict=True)), int(ids[i])) for i in mine)
    return [(own, key, -score) for score, key in scores[:k]]


def exact_search(queries: DataFrame, vectors: DataFrame, k: int, d: int, query_blocks: int, blocks: int) -> DataFrame:
    """(query_id, vec_id, score as decimal text): the k best of each block of ``vectors`` for each query, both (id, v, wide); for
    vectors too long for products in doubles. Blocks of queries meet blocks of vectors, about BLOCK by BLOCK."""

    def wide(table: pa.Table) -> np.ndarray:
        rows = [np.frombuffer(w if w is not None else v, "<f8" if w is not None else "<i4").astype(float) for v, w in zip(table.column(1).to_pylist(), table.column(2).to_pylist(), strict=True)]
        return np.array([np.pad(r, (0, d - len(r))) for r in rows]).reshape(-1, d)

    def search(mine: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if mine.num_rows and own.num_rows:
            q, x, ids = wide(mine), wide(own), own.column(0).to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                slack = np.abs(q) @ np.abs(x).T * (d * 2.0 ** -50)
                rough = q @ x.T
            for i, key in enumerate(mine.column(0).to_pylist()):
                most = float(slack[i].max())
                out += _exact_best(q[i], key, ids, x, rough[i] if math.isfinite(most) else np.zeros(len(x)), most if math.isfinite(most) else 1.0, k)
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([str(r[2]) for r in out], pa.string())})

    def dealt(rows: DataFrame, side: str, own: str, n: int, other: str, others: int) -> DataFrame:
        rows = rows.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "v", "wide")], F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(f"{side}_{own}"))
        return rows.withColumn(f"{side}_{other}", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy(f"{side}_qb", f"{side}_xb")

    left, right = dealt(queries, "q", "qb", query_blocks, "xb", blocks), dealt(vectors, "x", "xb", blocks, "qb", query_blocks)
    return left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score string")


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k others
    of the highest integer inner product of floor(1024 * x), ties to the smaller id.

    Null ids, null vectors, and vectors holding null or non-finite components (also when scaled) take
    no part. Vectors whose scaled squared length reaches EXACT are not in the trees: for them, and for queries
    like them, an exact path compares blocks in whole numbers. Scores beyond a long are given as its
    ends, and ranked by their true values. Vectors of different lengths are compared as if the
    shorter ended in zeros. Of rows that repeat an id one counts (a small vector before a long one, then the
    smallest). Other columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    shape = "query_id long, rank int, vec_id long, score long"
    rows = narrow(embeddings, vec_id=id_col, x=vector_col)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("x").cast("array<double>").alias("x")).mapInArrow(scaled, "vec_id long, v binary, norm long, d int, wide binary")
    first = F.min(F.struct(F.col("v").isNull().alias("long"), "v", "wide", "norm", "d")).alias("s")
    rows = written(rows.groupBy("vec_id").agg(first).select("vec_id", "s.v", "s.norm", "s.d", "s.wide"), "vectors")
    query, long = F.col("vec_id") % every == 0, F.col("wide").isNotNull()
    d, most, count, longs, queries, long_queries = rows.agg(
        F.max("d"), F.max("norm"), F.count("v"), F.count("wide"), F.count(F.when(query, 1)), F.count(F.when(query & long, 1))).first()
    if not queries or not d:
        return spark.createDataFrame([], shape)
    found = []
    if count and queries > long_queries:
        found.append(_by_trees(rows.filter("wide is null").select("vec_id", "v"), d, most, count, k, every).withColumn("score", F.col("score").cast("string")))
    each = rows.select(F.col("vec_id").alias("id"), "v", "wide")
    asked = F.col("id") % every == 0

    def blocks(n: int) -> int:
        return max(1, -(-n // BLOCK))

    if longs:
        found.append(exact_search(each.filter(asked), each.filter("wide is not null"), k, d, blocks(queries), blocks(longs)))
    if long_queries and count:
        found.append(exact_search(each.filter(asked & F.col("wide").isNotNull()), each.filter("wide is null"), k, d, blocks(long_queries), blocks(count)))
    if not found:
        return spark.createDataFrame([], shape)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    if longs:  # whole numbers of any length: by sign, then by digits
        plus, digits = ~F.col("score").startswith("-"), F.regexp_replace("score", "^-", "")
        order = [plus.desc(), F.when(plus, F.length(digits)).otherwise(-F.length(digits)).desc(), F.when(plus, digits).desc(), F.when(~plus, digits).asc(), F.col("vec_id").asc()]
        ends = F.when(plus, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63)))
        score = F.coalesce(F.col("score").try_cast("long"), ends)
    else:
        score = F.col("score").cast("long")
        order = [score.desc(), F.col("vec_id").asc()]
    best = W.partitionBy("query_id").orderBy(*order)
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _by_trees(rows: DataFrame, d: int, most: int, count: int, k: int, every: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best, and perhaps more, among small vectors (vec_id, v)."""
    spark = rows.sparkSession
    metric = Metric(d, most)

    # pivots: MAX_PIVOTS vectors at most, by a hash of the id
    wanted = min(MAX_PIVOTS, max(1, count // CELL))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("v").collect()
    pivots = metric.lift(matrix(sorted({bytes(r["v"]) for r in chosen}), d))
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                away = _apart(metric.lift(matrix(batch.column("v").to_pylist(), d)), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(away.argmin(1).astype(np.int32)), pa.array(away.min(1))], names=["vec_id", "v", "cell", "away"])

    placed = written(rows.mapInArrow(assign, "vec_id long, v binary, cell int, away double"), "cells")
    # a row for each pivot: the cell's vectors and radius
    cells = sorted(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect())
    number = np.array([c["cell"] for c in cells], np.int64)
    parts = np.array([-(-c["n"] // TREE) for c in cells], np.int64)  # trees of each cell
    first = np.cumsum(parts) - parts
    radius = np.array([c["r"] for c in cells])
    trees = spark.createDataFrame([(int(c), int(f), int(n)) for c, f, n in zip(number, first, parts, strict=True)], "cell int, first int, parts int")
    placed = placed.join(F.broadcast(trees), "cell").withColumn("tree", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))  # MAX_PIVOTS rows
    pages = written(build_trees(placed, metric), "pages")

    queries = placed.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    blocks = max(1, -(-queries.count() // BLOCK))

    def targets(home: bool):
        """Trees for each query: those of the nearest pivot, or all others that its bound allows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers = shared.value[number]
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    q = matrix(batch.column("v").to_pylist(), d)
                    norm = (q * q).sum(1)
                    away = np.sqrt(np.maximum(norm[:, None] + (centers ** 2).sum(1)[None] - 2 * q @ centers[:, :-1].T, 0))
                    ids = batch.column("query_id").to_numpy()
                    near = away.argmin(1)
                    own = first[near] + ids % parts[near]  # the tree at home that is searched first
                    if home:
                        row, tree = np.arange(len(q)), own
                    else:
                        bound = np.array([math.nan if b is None else float(b) for b in batch.column("bound").to_pylist()])
                        limit = np.where(np.isnan(bound), np.inf, _margin(np.sqrt(np.maximum(norm + metric.most - 2 * np.nan_to_num(bound), 0))))
                        row, cell = np.nonzero(away - radius[None] <= limit[:, None])
                        row, cell, part = np.repeat(row, parts[cell]), np.repeat(cell, parts[cell]), np.concatenate([np.arange(parts[c]) for c in cell] or [np.zeros(0, np.int64)])
                        tree = first[cell] + part
                        row, tree = row[tree != own[row]], tree[tree != own[row]]
                    yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), batch.column("query_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), batch.column("bound").take(pa.array(row))], names=["tree", "query_id", "v", "bound"])

        return run

    shape = "tree int, query_id long, v binary, bound long"
    at_home = queries.withColumn("bound", F.lit(None).cast("long")).mapInArrow(targets(True), shape)
    near = written(search_trees(at_home, pages, metric, k, blocks), "near")
    bound = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    others = queries.join(bound, "query_id", "left").select("query_id", "v", "bound").mapInArrow(targets(False), shape)
    return near.unionByName(search_trees(others, pages, metric, k, blocks))
