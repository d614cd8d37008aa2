"""Exact top-k by inner product with a paged M-tree.

Vectors become integers (floor(scale * x)).  With one more coordinate that gives every
candidate the same length, the order by inner product is the order by distance, so a
metric tree serves it exactly.

The tree is a table of leaf pages below routing objects: a page has its routing object,
covering radius, distance to its parent, and for each member the distance to the routing
object.  Spark deals rows out to routing objects (one that attracts many, as copies do, is
split over several groups), and each group is cut into pages.  A search goes best first:
pages wait in a heap by a bound that needs no distance (from the parent's), a page that
comes up has its own distance computed, and members whose stored distance already shows
that they are too far are not looked at.  Scores are exact integers.

Queries go over the pages in blocks of bounded size.
"""

from __future__ import annotations

import functools
import heapq
import math
import operator
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from censorium.llm.common import saved, table

K, SCALE, EVERY = 5, 256.0, 50
#: Routing objects; members of a page; rows of a group that is cut into pages; queries of a block.
ROUTERS, PAGE, GROUP, BLOCK = 64, 256, 50_000, 4_096
#: Relative slack of floating-point bounds; exact scores decide inside it.
SLACK = 1e-7
#: Bits of the largest squared length whose scores are certain to fit a long.
LENGTH_BITS = 62


def integer_vectors(rows: DataFrame, *, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """``(id, v array<long>)``; rows without id, without vector, or with a null, NaN or infinite component drop out.

    So do vectors whose squared length, in integers, is 2^62 or more: scores of the others are below that, fit a long and are exact.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float(1 << (LENGTH_BITS // 2))))
    whole = rows.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return whole.where(length < float(1 << LENGTH_BITS))


def finite_vectors(rows: DataFrame, *, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x array<double>)``: all finite vectors, not scaled."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("x"))


def wide_vectors(rows: DataFrame, *, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """Those of ``finite_vectors`` that ``integer_vectors`` leaves out for their size."""
    whole = F.transform("x", lambda x: F.floor(x * scale).cast("double"))
    length = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x)
    large = F.exists("x", lambda x: F.abs(x * scale) >= float(1 << (LENGTH_BITS // 2))) | (length >= float(1 << LENGTH_BITS))
    return finite_vectors(rows, id_col=id_col, vector_col=vector_col).where(large)


def _whole(x: float, scale: float) -> int:
    """floor(scale * x) of any finite x, of any size."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else math.floor(int(x) * Fraction(scale))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dim)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """With the coordinate that makes all lengths equal."""
    x = x.astype(np.float64)
    return np.hstack((x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))[:, None]))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T))


PAGES = "dim int, router int, parent_distance double, radius double, object binary, ids binary, vectors binary, distances binary"


def _cut(at: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Rows as pages: halves by the direction of two far rows, until they fit."""
    work = [at]
    while work:
        rows = work.pop()
        if len(rows) <= PAGE:
            yield rows
            continue
        a = x[rows[rng.integers(len(rows))]]
        b = x[rows[np.argmax(((x[rows] - a) ** 2).sum(axis=1))]]
        order = np.argsort(x[rows] @ (b - a), kind="stable")
        work += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


def build(vectors: DataFrame, *, routers: int = ROUTERS) -> tuple[DataFrame, dict[int, tuple[np.ndarray, float]]]:
    """Leaf pages of all ``vectors(id, v)``, and by dimension the routing objects and the largest squared length.

    Routing objects are ``routers`` rows with the smallest hashes; they only shape the tree.
    """
    spark = vectors.sparkSession
    sized = vectors.withColumn("dim", F.size("v"))
    top = {r["dim"]: float(r["top"]) for r in sized.groupBy("dim").agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)).alias("top")).collect()}
    tree: dict[int, tuple[np.ndarray, float]] = {}
    for dim in top:
        chosen = sized.where(F.col("dim") == dim).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(routers).collect()
        tree[dim] = (_lifted(np.array([r["v"] for r in chosen], dtype=np.int64), top[dim]), top[dim])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            near = np.zeros(batch.num_rows, dtype=np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                objects, most = tree[int(dim)]
                near[at] = _distances(_lifted(_matrix(batch.column(1).take(pa.array(at)), int(dim)), most), objects).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["id", "v", "dim", "router"])

    routed = saved(sized.mapInArrow(route, "id long, v array<long>, dim int, router int"), "routed")
    splits = F.lit(1)
    for r in routed.groupBy("dim", "router").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).collect():
        splits = F.when((F.col("dim") == r["dim"]) & (F.col("router") == r["router"]), -(-r["n"] // GROUP)).otherwise(splits)
    grouped = routed.withColumn("part", F.pmod(F.xxhash64("id", "v"), splits).cast("int"))

    def pages(rows: pa.Table) -> pa.Table:
        dim, router = rows.column("dim")[0].as_py(), rows.column("router")[0].as_py()
        rows = rows.sort_by("id")
        ids, whole = np.asarray(rows.column("id")), _matrix(rows.column("v"), dim)
        objects, most = tree[dim]
        x, out = _lifted(whole, most), []
        for at in _cut(np.arange(len(ids)), x, np.random.default_rng(1)):
            middle = x[at].mean(axis=0)
            pick = at[np.argmin(((x[at] - middle) ** 2).sum(axis=1))]
            far = np.sqrt(((x[at] - x[pick]) ** 2).sum(axis=1))
            parent = float(np.sqrt(((x[pick] - objects[router]) ** 2).sum()))
            out.append((dim, router, parent, float(far.max()), x[pick].tobytes(), ids[at].tobytes(), whole[at].tobytes(), far.tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["dim", "router", "parent_distance", "radius", "object", "ids", "vectors", "distances"])

    return saved(grouped.groupBy("dim", "router", "part").applyInArrow(pages, PAGES), "pages"), tree


class Best:
    """The k best (score, smaller id first) of one query so far."""

    def __init__(self, k: int, least: float) -> None:
        self.k, self.least, self.rows = k, least, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
            self.add_one(s, i)
        if len(self.rows) == self.k:
            self.least = max(self.least, self.rows[0][0])

    def add_one(self, score: int, key: int) -> None:
        entry = (score, -key)
        if len(self.rows) < self.k:
            heapq.heappush(self.rows, entry)
        elif entry > self.rows[0]:
            heapq.heapreplace(self.rows, entry)


def search(pages: DataFrame, tree: dict[int, tuple[np.ndarray, float]], queries: list[tuple[int, list[int]]], k: int = K) -> DataFrame:
    """``(query_id, vec_id, score)``: of each task's pages the k best for each query, which hold the k best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {i: Best(k, -np.inf) for i, _ in queries}
        by_dim = {d: [(i, np.array(v, dtype=np.int64)) for i, v in queries if len(v) == d] for d in {len(v) for _, v in queries}}
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for dim, asked in by_dim.items():
                if dim in tree and (rows := [i for i, d in enumerate(cols[0]) if d == dim]):
                    _search(dim, asked, best, [[c[i] for i in rows] for c in cols], *tree[dim])
        out = [(q, -i, s) for q, b in best.items() for s, i in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return pages.mapInArrow(run, "query_id long, vec_id long, score long")


def scan(rows: DataFrame, queries: list[tuple[int, list[int]]], k: int = K, scale: float = SCALE) -> DataFrame:
    """``(query_id, vec_id, score)`` as ``search``, of ``rows(id, x)``, by whole numbers of any size without a tree.

    A pair whose score doesn't fit a long can't be told and takes no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {i: Best(k, -np.inf) for i, _ in queries}
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = [_whole(c, scale) for c in x]
                for i, v in queries:
                    if i != key and len(v) == len(whole):
                        score = sum(map(operator.mul, v, whole))
                        if -(1 << 63) <= score < 1 << 63:
                            best[i].add_one(score, key)
        out = [(q, -i, s) for q, b in best.items() for s, i in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def _search(dim: int, asked: list, best: dict[int, Best], cols: list[list], objects: np.ndarray, top: float) -> None:
    _, routers, parents, radii, routing, ids, vectors, distances = cols
    routers, parents, radii = np.array(routers), np.array(parents), np.array(radii)
    routing = np.stack([np.frombuffer(b) for b in routing])
    ids, distances = [np.frombuffer(b, dtype=np.int64) for b in ids], [np.frombuffer(b) for b in distances]
    vectors = [np.frombuffer(b, dtype=np.int64).reshape(-1, dim) for b in vectors]
    for key, v in asked:
        q = np.append(v.astype(np.float64), 0.0)
        length = float(v.astype(np.float64) @ v.astype(np.float64)) + top
        slack = SLACK * (length + 1) ** 0.5 + 1e-6
        found = best[key]
        # no distance to a page yet: only that between its routing object and the parent
        to_parent = np.sqrt(((objects - q) ** 2).sum(axis=1))
        bounds = np.maximum(0.0, np.abs(to_parent[routers] - parents) - radii)
        order = np.argsort(bounds, kind="stable")
        heap: list[tuple[float, int, float]] = []
        nxt = 0
        while nxt < len(order) or heap:
            reach = np.sqrt(max(0.0, length - 2 * found.least)) + slack if found.least > -np.inf else np.inf
            if nxt < len(order) and (not heap or bounds[order[nxt]] <= heap[0][0]):
                p = order[nxt]
                nxt += 1
                if bounds[p] > reach:
                    nxt = len(order)
                    continue
                d = float(np.sqrt(((routing[p] - q) ** 2).sum()))
                if (low := max(0.0, d - radii[p])) <= reach:
                    heapq.heappush(heap, (low, p, d))
                continue
            low, p, d = heapq.heappop(heap)
            if low > reach:
                continue
            near = np.abs(d - distances[p]) <= reach
            near &= ids[p] != key
            if near.any():
                scores = vectors[p][near] @ v  # whole numbers, exact
                fine = scores >= found.least
                found.add(scores[fine], ids[p][near][fine])


def top_k(rows: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE, block: int = BLOCK, wide: bool = False) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its k largest inner products among rows, ties to the smaller id.

    A query finds no row with its own id.  Vectors of another length than the query's are no
    candidates; invalid vectors (see ``integer_vectors``) take no part on either side; of query rows
    with equal ids the first vector counts.  With ``wide``, finite vectors too large for the tree (see
    ``integer_vectors``) take part as well: they are compared one by one, a block of queries at a time, and
    only pairs whose score doesn't fit a long are left out.  Fewer candidates give fewer rows; empty tables none.
    """
    spark = rows.sparkSession
    asked = saved(integer_vectors(queries, id_col=id_col, vector_col=vector_col, scale=scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    pages, tree = build(integer_vectors(rows, id_col=id_col, vector_col=vector_col, scale=scale))
    blocks = -(-asked.count() // block)
    found: list[DataFrame] = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        found.append(search(pages, tree, [(r["id"], r["v"]) for r in part], k))
    if wide:
        found += _with_wide(rows, queries, asked, k=k, block=block, id_col=id_col, vector_col=vector_col, scale=scale)
    parts = functools.reduce(DataFrame.union, found) if found else None
    if parts is None:
        parts = spark.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_wide(rows: DataFrame, queries: DataFrame, asked: DataFrame, *, k: int, block: int, **how) -> list[DataFrame]:
    """The best pairs with a wide vector on either side; a query's id that ``asked`` has is no wide query."""
    out: list[DataFrame] = []
    scale = how["scale"]
    large = saved(wide_vectors(rows, **how), "wide")
    many = saved(wide_vectors(queries, **how).groupBy("id").agg(F.min("x").alias("v")).join(asked, "id", "left_anti"), "wide_queries")
    every = finite_vectors(rows, id_col=how["id_col"], vector_col=how["vector_col"])
    for source, against in ((asked, large), (many, every)):
        blocks = 0 if against.isEmpty() else -(-source.count() // block)
        for b in range(blocks):
            part = source.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
            out.append(scan(against, [(r["id"], [_whole(c, scale) for c in r["v"]] if source is many else r["v"]) for r in part], k, scale))
    return out


def op2_metric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best of each vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0), wide=True)


#: The same by brute force.
OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
