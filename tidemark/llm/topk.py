"""Exact k best inner products by a vector-approximation file.

Every vector is filed as small cells, one byte per dimension, that bound each entry from both
sides. A scan of the cells bounds all scores of a query. The k-th best lower bound over the
file rules most vectors out; what is left is scored exactly, best bound first, until no bound
reaches the k-th exact score any more.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import materialized
from tidemark.llm.vectors import binary_rows, bytes_matrix, matrix, usable_vectors

#: Cells per dimension (at most 256), and how many vectors their edges are taken from. Every
#: vector is filed; edges from a sample only decide how tight the bounds are, not what is found.
CELLS, SAMPLE = 64, 8_192
#: Query vectors of one scan, which are broadcast, and how many of them a task bounds at a time.
QUERIES, TILE = 8_192, 256
#: Filed vectors that a task bounds at a time.
ROWS = 4_096
#: Entries beyond this are held at it.
FARTHEST = 1 << 50


def scaled(v: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(v * scale), -FARTHEST, FARTHEST).astype(np.int64)


@dataclass
class Cells:
    """Edges of every dimension: cell c holds the whole numbers from low[d, c] to high[d, c]."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int) -> Cells:
        """Cells of about equally many vectors; the outer ones reach to the least and most entry of all."""
        ranks = np.arange(1, cells) * len(sample) // cells
        low = np.concatenate([least[:, None], np.sort(sample, axis=0)[ranks].T], axis=1)
        return cls(low, np.concatenate([low[:, 1:] - 1, most[:, None]], axis=1))

    def of(self, z: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(low[1:], z[:, d], "right") for d, low in enumerate(self.low)], axis=1).astype(np.uint8)

    def middles(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice the middle and twice the half-width of every cell, as doubles."""
        d = np.arange(len(self.low))
        low, high = self.low[d, cells].astype(float), self.high[d, cells].astype(float)
        return low + high, high - low


def inner(q: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, exact: doubles or longs where they hold all sums, else Python numbers."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(z).max(initial=0)) * q.shape[1]
    if most < 1 << 62:
        return np.einsum("ij,ij->i", q, z)
    return np.array([min(max(int(s), 1 - (1 << 63)), (1 << 63) - 1) for s in (q.astype(object) * z.astype(object)).sum(axis=1)], np.int64)


class Scan:
    """One task's search for a block of query vectors; sees filed vectors batch by batch."""

    def __init__(self, q: np.ndarray, cells: Cells, k: int, floor: np.ndarray | None = None):
        self.q, self.cells, self.k = q, cells, k
        self.wide, self.sides = q.astype(float), np.abs(q).astype(float)
        reach = np.maximum(np.abs(cells.low), np.abs(cells.high)).max(axis=1).astype(float)
        # What rounding may add to a bound: nothing while doubles hold every sum exactly.
        total = 2 * self.sides @ reach
        self.slack = np.where(total < 2.0 ** 53, 0.0, total * q.shape[1] * 2.0 ** -50)
        self.lows = np.full((len(q), k), -np.inf)
        self.floor = np.full(len(q), -np.inf) if floor is None else floor
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [])

    def _bounds(self, tile: slice, middle: np.ndarray, half: np.ndarray, side: int) -> np.ndarray:
        """Twice the lower (side -1) or upper (1) bounds of a tile of queries."""
        return (self.wide[tile] @ middle.T + side * (self.sides[tile] @ half.T)) + side * self.slack[tile, None]

    def lower(self, cells: np.ndarray) -> None:
        """First phase: keep the k best lower bounds of every query."""
        for at in range(0, len(cells), ROWS):
            middle, half = self.cells.middles(cells[at:at + ROWS])
            for start in range(0, len(self.q), TILE):
                tile = slice(start, start + TILE)
                both = np.concatenate([self.lows[tile], self._bounds(tile, middle, half, -1)], axis=1)
                self.lows[tile] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:]

    def exact(self, cells: np.ndarray, z: np.ndarray, first: np.ndarray, ids: list) -> None:
        """Second phase: read exact vectors by falling upper bound until the k best are certain."""
        for at in range(0, len(cells), ROWS):
            middle, half = self.cells.middles(cells[at:at + ROWS])
            for start in range(0, len(self.q), TILE):
                tile = slice(start, start + TILE)
                upper = self._bounds(tile, middle, half, 1)
                query, row = np.nonzero(upper >= self.floor[tile, None])
                bound = upper[query, row]
                order = np.lexsort((-bound, query))
                self._read(query[order] + start, row[order] + at, bound[order], z, first, ids)

    def _read(self, query, row, bound, z, first, ids) -> None:
        size = self.k
        while len(query):
            # Each query's next candidates, then those whose bound is still in reach.
            begin = np.r_[0, np.flatnonzero(query[1:] != query[:-1]) + 1]
            rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.r_[begin, len(query)]))
            now = rank < size
            got = row[now]
            self._keep(query[now], inner(self.q[query[now]], z[got]), first[got], [ids[r] for r in got])
            left = ~now & (bound >= self.floor[query])
            query, row, bound, size = query[left], row[left], bound[left], 2 * size

    def _keep(self, query, score, first, ids) -> None:
        q, s, f = (np.concatenate(p) for p in zip(self.best[:3], (query, score, first)))
        every = self.best[3] + ids
        order = np.lexsort((f, -s, q))
        q, s, f = q[order], s[order], f[order]
        begin = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
        keep = rank < self.k
        last = rank == self.k - 1
        # Twice the k-th exact score: a vector whose bound equals it may still win by its id.
        self.floor[q[last]] = np.maximum(self.floor[q[last]], 2.0 * s[last] - self.slack[q[last]])
        self.best = (q[keep], s[keep], f[keep], [every[i] for i in order[keep]])


def _file(rows: DataFrame, width: int, scale: int, cells: Cells, dtype: str, k: int, long_id) -> DataFrame:
    """(z, cells, ids): distinct vectors with the k smallest ids of each, written once.

    Equal vectors have equal scores, so no id beyond the k smallest can be among the k best.
    The limit of a window is applied in every task before the shuffle: a vector that a third of
    the rows share sends k rows a task.
    """
    def run(batches):
        for batch in batches:
            z = scaled(matrix(batch.column(1), width), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_rows(z.astype(dtype))], names=["id", "z"])

    packed = rows.select(long_id.alias("id"), "_v").mapInArrow(run, "id long, z binary").distinct()
    few = packed.withColumn("rank", F.row_number().over(Window.partitionBy("z").orderBy("id"))).where(F.col("rank") <= k)
    unique = few.groupBy("z").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_rows(cells.of(bytes_matrix(batch.column(0), dtype)))], names=["z", "ids", "cells"])

    return materialized(unique.mapInArrow(add, "z binary, ids array<long>, cells binary"))


def _fit(rows: DataFrame, width: int, scale: int) -> tuple[Cells, str]:
    def run(batches):
        for batch in batches:
            z = scaled(matrix(batch.column(0), width), scale)
            if len(z):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(z.min(axis=0)), pa.array(z.max(axis=0))],
                                                 names=["d", "low", "high"])

    ends = rows.select("_v").mapInArrow(run, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = sorted(ends.collect())
    low, high = np.array([e.low for e in ends]), np.array([e.high for e in ends])
    sample = rows.orderBy(F.xxhash64("_v"), "_v").limit(SAMPLE).select("_v").toArrow()["_v"].combine_chunks()
    most = max(int(np.abs(low).max()), int(np.abs(high).max()))
    return Cells.fit(scaled(matrix(sample, width), scale), low, high, CELLS), next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)


def _search(filed: DataFrame, keys: list[bytes], cells: Cells, dtype: str, k: int) -> DataFrame:
    """(z, hits): for each query vector its k best filed vectors, as (score, ids)."""
    spark = filed.sparkSession
    q = spark.sparkContext.broadcast(keys)

    def queries() -> np.ndarray:
        return np.frombuffer(b"".join(q.value), dtype).reshape(len(q.value), -1).astype(np.int64)

    def lower(batches):
        scan = Scan(queries(), cells, k)
        seen = False
        for batch in batches:
            scan.lower(bytes_matrix(batch.column(0), "u1"))
            seen = seen or batch.num_rows > 0
        if seen:
            lows = pa.FixedSizeListArray.from_arrays(pa.array(scan.lows.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lows), dtype=np.int32)), lows], names=["q", "lows"])

    lows = filed.select("cells").mapInArrow(lower, "q int, lows array<double>").groupBy("q").agg(
        F.sort_array(F.flatten(F.collect_list("lows")), asc=False)[k - 1].alias("floor"))
    floors = dict(lows.collect())
    floor = spark.sparkContext.broadcast(np.array([floors[i] for i in range(len(keys))]))

    def exact(batches):
        scan = Scan(queries(), cells, k, floor.value.copy())
        for batch in batches:
            ids = batch.column(1).to_pylist()
            scan.exact(bytes_matrix(batch.column(2), "u1"), bytes_matrix(batch.column(0), dtype).astype(np.int64),
                       np.array([i[0] for i in ids], np.int64), ids)
        at, score, _, ids = scan.best
        yield pa.RecordBatch.from_arrays([pa.array([q.value[i] for i in at], pa.binary()), pa.array(score), pa.array(ids, pa.list_(pa.int64()))],
                                         names=["z", "score", "ids"])

    found = filed.select("z", "ids", "cells").mapInArrow(exact, "z binary, score long, ids array<long>")
    best = Window.partitionBy("z").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return materialized(found.groupBy("z").agg(F.collect_list(F.struct("score", "ids")).alias("hits")))


def top_k(table: DataFrame, queries: Column, k: int = 5, scale: int = 256, name: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query, rank, name, score): the k best inner products of every row that ``queries`` names.

    Entries x become floor(scale * x), held within ±2^50; scores are exact whole numbers (held
    within a long), ties go to the smaller id. ``queries`` is a condition on the id column.
    Candidates are all rows but those with the query's own id. Left out are rows with a null id
    or a vector that is null, holds null or non-finite entries or is unusually long
    (``usable_vectors``). Rows repeated with the same id and vector count once; equal vectors
    under different ids all count. Other columns are not looked at. An empty table gives no rows.

    Query vectors go in blocks of at most ``QUERIES`` distinct ones; each block is broadcast and
    scans the file twice. What a block sends to the driver is one bound per query.
    """
    rows, width = usable_vectors(table, name, vector)
    rows = rows.where(F.col(f"`{name}`").isNotNull())
    spark = table.sparkSession
    empty = spark.createDataFrame([], f"query_id long, rank int, `{name}` long, score long")
    if not width or rows.isEmpty():
        return empty
    cells, dtype = _fit(rows, width, scale)
    # One more than k: the query's own row may be among them.
    filed = _file(rows, width, scale, cells, dtype, k + 1, F.col(f"`{name}`").cast("long"))

    def pack(batches):
        for batch in batches:
            z = scaled(matrix(batch.column(1), width), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_rows(z.astype(dtype))], names=["query_id", "z"])

    asked = rows.where(queries).select(F.col(f"`{name}`").cast("long").alias("query_id"), "_v").mapInArrow(pack, "query_id long, z binary")
    asked = materialized(asked.distinct())
    vectors = materialized(asked.select("z").distinct().withColumn("part", F.pmod(F.xxhash64("z"), F.lit(1 << 30))))
    n = vectors.count()
    parts = -(-n // (QUERIES // 2))
    found = []
    for p in range(parts):  # about half a block each; a larger part takes more scans
        keys = [r.z for r in vectors.where(F.col("part") % parts == p).select("z").toLocalIterator()]
        found += [_search(filed, [bytes(z) for z in keys[at:at + QUERIES]], cells, dtype, k + 1) for at in range(0, len(keys), QUERIES)]
    if not found:
        return empty
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    pairs = F.flatten(F.transform("hits", lambda h: F.transform(h["ids"], lambda i: F.struct((-h["score"]).alias("s"), i.alias("i")))))
    others = F.slice(F.array_sort(F.filter(pairs, lambda p: p["i"] != F.col("query_id"))), 1, k)
    out = asked.join(hits, "z").select("query_id", F.posexplode(others).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.i").alias(name), (-F.col("hit.s")).alias("score"))
