"""Nearest neighbours by a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks by a hash of id and vector; every pair
of a query block and a candidate block is a tile.  A tile quantises its vectors
to int8, takes all products in one matrix product (of whole numbers, exact in
the floats it runs in) and so has each distance between quantised vectors.
The lengths of the quantisation errors bound how far the true distance may be:

    |d(x, y) - d(q(x), q(y))| <= |x - q(x)| + |y - q(y)|.

A candidate whose lower bound is above the k-th smallest upper bound of its
query cannot be among the k nearest and is dropped; the others are recomputed
from the original vectors in double precision.  Each tile sends its k best for
each query, kept in heaps, and the heaps of a query's tiles are merged.  The
result is exact: recall is 1.

Only a tile's vectors are together in a task, whatever the corpus; the join is
an equality on block numbers, each vector being sent once to each tile of its
row or column.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; vectors of another length than the query's are no
candidates; a null id takes no part; ties go to the smaller id; rows that
share an id, equal or not, are one query and one candidate, whose distance is
the least between any of their vectors, so that the k ranks of a query hold k
different ids; an empty table gives no rows.  Only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ship, written

#: Candidates and queries of one tile, about.
TILE_ROWS = 4096
TILE_QUERIES = 1024
#: Rounding of the float arithmetic on the bounds.
SLACK = 1e-5


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes by row, the rows' scales, and the lengths of the errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def tile_distances(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between ``queries`` and ``rows`` (double precision)."""
    (a, sa, ea), (b, sb, eb) = quantised(queries), quantised(rows)
    product = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):  # 1024 products of 127 * 127 stay below 2**24, so that floats hold them exactly
        product += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    na, nb = (a.astype(np.float64) ** 2).sum(1) * sa**2, (b.astype(np.float64) ** 2).sum(1) * sb**2
    near = np.sqrt(np.maximum(0.0, na[:, None] + nb[None, :] - 2.0 * product * sa[:, None] * sb[None, :]))
    error = (ea[:, None] + eb[None, :]) + SLACK * (np.sqrt(na)[:, None] + np.sqrt(nb)[None, :])
    return near - error, near + error


def tile_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, distance) of the k nearest ids of each row of ``queries`` in one tile, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    low, high = tile_distances(queries, rows)
    own = query_ids[:, None] == ids[None, :]
    low[own] = high[own] = np.inf
    kinds, first = np.unique(ids, return_index=True)
    nearest_of = high if len(kinds) == len(ids) else np.minimum.reduceat(high, first, axis=1)
    kth = np.partition(nearest_of, k - 1, axis=1)[:, k - 1] if len(kinds) > k else np.full(len(query_ids), np.inf)
    out: list[tuple[int, int, float]] = []
    for i, q in enumerate(query_ids):
        left = np.flatnonzero((low[i] <= kth[i]) & np.isfinite(low[i]))
        exact = np.sqrt(np.add.accumulate((rows[left] - queries[i]) ** 2, axis=1)[:, -1])  # component by component, the same on every machine
        if len(kinds) == len(ids):
            best = heapq.nsmallest(k, zip(exact.tolist(), ids[left].tolist(), strict=True))
        else:
            least: dict[int, float] = {}
            for c, d in zip(ids[left].tolist(), exact.tolist(), strict=True):
                least[c] = min(d, least.get(c, d))
            best = heapq.nsmallest(k, ((d, c) for c, d in least.items()))
        out += [(int(q), c, d) for d, c in best]
    return out


def offer(heap: list[tuple[float, int]], held: dict[int, float], k: int, distance: float, c: int) -> None:
    """Put a candidate into a query's heap of the ``k`` nearest, the farthest on top; ``held`` has the distances of those in it."""
    before = held.get(c)
    if before is not None:
        if distance < before:
            heap[heap.index((-before, -c))] = (-distance, -c)
            heapq.heapify(heap)
            held[c] = distance
    elif len(heap) < k:
        heapq.heappush(heap, (-distance, -c))
        held[c] = distance
    elif (-distance, -c) > heap[0]:
        del held[-heapq.heapreplace(heap, (-distance, -c))[1]]
        held[c] = distance


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, width)


def nearest(
    vectors: DataFrame,
    queries: Column | None = None,
    k: int = 10,
    tile_rows: int = TILE_ROWS,
    tile_queries: int = TILE_QUERIES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each query, its own id excluded.

    ``queries`` says which rows of ``vectors`` are queries; as it stands those
    whose id is divisible by 100.
    """
    ship(vectors.sparkSession)
    is_query = F.col(id_col) % 100 == 0 if queries is None else queries
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    usable = written(usable.where(F.col("id").isNotNull() & _usable(F.col("x"))).withColumn("width", F.size("x")), "vectors")
    sizes = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    n_rows, n_queries = max(1, -(-sizes["n"] // tile_rows)), max(1, -(-sizes["q"] // tile_queries))

    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "x"), F.lit(n))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = usable.select("id", "x", "width", block(n_rows, 1).alias("row_block"), numbers(n_queries).alias("query_block"))
    asked = usable.where("is_query").select("id", "x", "width", block(n_queries, 2).alias("query_block"), numbers(n_rows).alias("row_block"))
    key = ["width", "query_block", "row_block"]

    def tile(where: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        width = where[0].as_py()
        if left.num_rows == 0 or right.num_rows == 0:
            found: list[tuple[int, int, float]] = []
        else:
            found = tile_best(np.asarray(left["id"]), _matrix(left["x"], width), np.asarray(right["id"]), _matrix(right["x"], width), k)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    tiles = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(tile, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bounded heaps, at most k entries for each query of the partition, which arrives sorted by query."""

        def ranked(query: int, heap: list[tuple[float, int]]) -> list[tuple[int, int, int, float]]:
            return [(query, i, -c, -d) for i, (d, c) in enumerate(sorted(heap, reverse=True), 1)]

        query, heap, held, out = None, [], {}, []
        for batch in batches:
            for q, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if q != query:
                    out += ranked(query, heap)
                    query, heap, held = q, [], {}
                offer(heap, held, k, d, c)
            if out:
                yield _ranks(out)
                out = []
        out += ranked(query, heap)
        if out:
            yield _ranks(out)

    return tiles.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _ranks(rows: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])


#: DuckDB SQL of ``nearest`` over ``embeddings``: every distance, ranked.
SQL = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""
