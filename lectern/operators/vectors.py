"""Exact nearest rows by inner product, within blocks: tiles of vectors meet as matrices.

The matrix product gives each inner product to within a bound; what may still be among the best k is summed again in double,
first number to last, and only those sums decide. Of equal vectors of a block the k + 1 smallest ids are candidates.
A task meets a fixed number of tiles, and gives k rows for each of its queries.

Vectors that are null or empty, or hold nulls, non-finite or huge numbers, and rows without an id, have no place in a matrix: their pairs
are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.staging import staged

#: Rows and bytes of a tile; tiles of queries and of candidates that a task meets.
ROWS, TILE_BYTES = 2048, 1 << 20
ASKED, MET = 4, 12
#: Candidates that are multiplied, and pairs that are summed again, at once.
SPAN, PAIRS = 1024, 1 << 16


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, in double."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _tiles(rows: DataFrame, n: int) -> DataFrame:
    """(block, dim, tile, ids, body) of n rows (block, id, v)."""
    of, kind = (rows.schema[c].dataType.simpleString() for c in ("block", "id"))

    def pack(batches):
        part, seq, now, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def out():
            nonlocal seq, held, size
            seq += 1
            ids, body = pa.concat_arrays([i for i, _ in held]), np.concatenate([x for _, x in held]).tobytes()
            held, size = [], 0
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([now[2], pa.array([now[1]], pa.int32()), pa.array([part * (1 << 32) + seq]), lists, pa.array([body], pa.binary())], names=["block", "dim", "tile", "ids", "body"])

        for batch in batches:
            blocks, ids, vectors = (batch.column(k) for k in range(3))
            dims = np.diff(vectors.offsets.to_numpy())
            flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
            names = list(zip(blocks.to_pylist(), dims.tolist()))
            edges = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
            for at, to in zip(edges, [*edges[1:], len(names)]):
                if size and names[at] != now[:2]:
                    yield out()
                now = (*names[at], blocks.slice(at, 1))
                most = max(1, min(ROWS, TILE_BYTES // (8 * now[1])))
                while at < to:
                    cut = min(to, at + most - size)
                    held.append((ids.slice(at, cut - at), flat[starts[at] : starts[at] + (cut - at) * now[1]].reshape(-1, now[1])))
                    size, at = size + cut - at, cut
                    if size == most:
                        yield out()
        if size:
            yield out()

    parts = max(1, -(-n // (8 * ROWS)))  # whatever the session's partitions: small tiles would meet often
    dealt = rows.withColumn("dim", F.size("v")).repartitionByRange(parts, "block", "dim", "id").coalesce(parts).sortWithinPartitions("block", "dim", "id")
    return staged(dealt.select("block", "id", "v").mapInArrow(pack, f"block {of}, dim int, tile long, ids array<{kind}>, body binary"), "vector-tiles", **{"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"})


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first number to the last."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T):
        total += a * b
    return total


class Best:
    """The best k so far of each query of a tile, by their sums in order; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, own: bool):
        self.ids, self.x, self.k, self.own = ids, x, k, own
        self.norm, self.floor = np.linalg.norm(x, axis=1), np.full(len(x), -np.inf)
        self.row, self.nbr, self.sim = np.empty(0, np.int64), ids[:0], np.empty(0)

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(y), SPAN):
            self._meet(ids[at : at + SPAN], y[at : at + SPAN])

    def _meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        product = self.x @ y.T
        # both sums are off by no more than half of this
        slack = 8 * y.shape[1] * 2.0**-53 * self.norm * np.linalg.norm(y, axis=1).max() + 1e-290
        if not self.own:
            product[self.ids[:, None] == ids[None, :]] = -np.inf
        floor = self.floor
        if len(y) >= self.k and np.isinf(floor).any():
            floor = np.maximum(floor, np.partition(product, len(y) - self.k, axis=1)[:, len(y) - self.k] - slack)
        row, col = np.nonzero((product >= (floor - slack)[:, None]) & (product > -np.inf))
        if not len(row):
            return
        sim = np.concatenate([in_order(self.x[row[k : k + PAIRS]], y[col[k : k + PAIRS]]) for k in range(0, len(row), PAIRS)])
        row, nbr, sim = np.concatenate([self.row, row]), np.concatenate([self.nbr, ids[col]]), np.concatenate([self.sim, sim])
        order = np.lexsort((nbr, -sim, row))
        row, nbr, sim = row[order], nbr[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep, last = place < self.k, place == self.k - 1
        self.floor[row[last]] = sim[last]
        self.row, self.nbr, self.sim = row[keep], nbr[keep], sim[keep]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, own: bool) -> DataFrame:
    """(id, nbr, sim, rank): for each id of queries the k rows of corpus with the largest inner product in its block, ties to the smaller
    id; own: a row may be its own neighbour. Both have id, v (array<double>) and block. An id that repeats counts by all its rows.
    """
    regular = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    regular = F.coalesce(F.col("v").isNotNull() & regular, F.lit(False))
    queries, corpus = (d.filter("block is not null").withColumn("regular", regular).select("block", "id", "v", "regular") for d in (queries, corpus))
    asked, met = (d.filter("regular").drop("regular") for d in (queries, corpus))
    kind = corpus.schema["id"].dataType.simpleString()
    # k + 1 ids of a vector leave k beside a query's own
    copies = F.dense_rank().over(Window.partitionBy("block", "v").orderBy("id"))
    thin = met.withColumn("_copy", copies).filter(F.col("_copy") <= k + 1).drop("_copy")
    asked, met = _tiles(asked, asked.count()), _tiles(thin, met.count())

    def grouped(tiles: DataFrame, most: int, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("block", "dim").orderBy("tile")) - 1
        return tiles.select("block", "dim", "tile", F.floor(place / most).alias(name))

    qs, cs = staged(grouped(asked, ASKED, "qg"), "query-groups"), staged(grouped(met, MET, "cg"), "candidate-groups")
    cells = staged(qs.select("block", "dim", "qg").distinct().join(cs.select("block", "dim", "cg").distinct(), ["block", "dim"]), "cells")
    columns = "block", "dim", "qg", "cg", "kind", "tile", "ids", "body"
    sides = [cells.join(heads, ["block", "dim", group]).join(tiles.select("tile", "ids", "body"), "tile").withColumn("kind", F.lit(n)).select(*columns) for n, (heads, group, tiles) in enumerate(((qs, "qg", asked), (cs, "cg", met)))]
    work = sides[0].unionByName(sides[1]).repartition(max(1, min(cells.count(), 10_000)), *columns[:4]).sortWithinPartitions(*columns[:6])

    def meet(batches):
        now, tiles = None, []

        def done():
            for t in tiles:
                yield pa.RecordBatch.from_arrays([pa.array(t.ids[t.row]), pa.array(t.nbr), pa.array(t.sim)], names=["id", "nbr", "sim"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in range(4))
                ids, dim = batch.column(6)[i].values, key[1]
                ids = ids.to_numpy() if not pa.types.is_string(ids.type) else np.array(ids.to_pylist())
                x = np.frombuffer(batch.column(7)[i].as_py(), np.float64).reshape(-1, dim)
                if key != now:
                    yield from done()
                    now, tiles = key, []
                if batch.column(4)[i].as_py():
                    for t in tiles:
                        t.meet(ids, x)
                else:
                    tiles.append(Best(ids, x, k, own))
        yield from done()

    found = work.mapInArrow(meet, f"id {kind}, nbr {kind}, sim double")
    if not queries.filter("not regular").isEmpty() or not corpus.filter("not regular").isEmpty():
        q = queries.select("block", "id", F.col("v").alias("va"), F.col("regular").alias("ra"))
        c = corpus.select("block", F.col("id").alias("nbr"), F.col("v").alias("vb"), F.col("regular").alias("rb"))
        pairs = q.filter("not ra").join(c, "block").unionByName(q.filter("ra").join(c.filter("not rb"), "block"))
        found = found.unionByName((pairs if own else pairs.filter("id <> nbr")).select("id", "nbr", dot("va", "vb").alias("sim")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("sim").desc(), "nbr"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
