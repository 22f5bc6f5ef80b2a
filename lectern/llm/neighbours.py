"""Operator 3: exact nearest neighbours by a block matrix join of int8 tiles.

Vectors are cut into blocks of their int8 forms; only these travel to the blocks of queries. A block of queries meets a
fixed number of blocks of candidates in a task: the product of the int8 forms, with each vector's scale, gives
every inner product to within a bound that the residuals' norms prove. Pairs that can still be among a query's best k by
that bound are bounded anew with the int8 forms of the residuals; what survives in all tasks is cut once more by the k-th
best lower bound of the query, computed again from the original vectors in double precision, and merged by heaps.

Equal vectors stand in one block, under their k + 1 smallest ids; others of that vector cannot be among any k best.

Vectors that are null, empty, zero, or hold nulls or non-finite numbers take no part, nor do rows without an id.
A candidate id that repeats counts once, by the best of its vectors; of a query id that repeats one row is taken, that of
the smallest vector. Blocks only meet blocks of vectors of the same length. With fewer candidates than k all are
returned; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import as_batch, column_of, staged

#: Rows of a block of candidates, and of queries.
CANDIDATES = 4096
QUERIES = 2048
#: Blocks of candidates that a task meets at most; tasks there should be at least.
MEETINGS = 16
TASKS = 48
#: Pairs that are computed again at once.
PAIRS = 1 << 17


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _by_length(batches):
    """(length, ids, rows as doubles) of each batch's vectors."""
    for batch in batches:
        vectors = column_of(batch, "vector")
        ids, sizes = column_of(batch, "id").to_numpy(), np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes):
            which = np.flatnonzero(sizes == dim)
            yield int(dim), ids[which], flat[starts[which][:, None] + np.arange(dim)].astype(np.float64)


def _fewest(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k + 1 smallest ids of each vector, once each."""
    x = x + 0.0  # -0 and 0 are one number
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    first = np.r_[True, (x[1:] != x[:-1]).any(1)]
    once = first | np.r_[True, ids[1:] != ids[:-1]]
    ids, x, first = ids[once], x[once], first[once]
    place = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    return ids[place <= k], x[place <= k]


def _thinned(k: int, rows: int = 8192):
    """Rows of a task without those whose vector has k + 1 smaller ids in it."""

    def run(batches):
        held: dict[int, list] = {}

        def out(ids, x):
            ids, x = _fewest(ids, x, k)
            return as_batch(id=pa.array(ids, pa.int64()), vector=pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1))))

        for dim, ids, x in _by_length(batches):
            old = held.pop(dim, None)
            ids, x = (ids, x) if old is None else (np.concatenate([old[0], ids]), np.concatenate([old[1], x]))
            if len(ids) >= rows:
                yield out(ids, x)
            else:
                held[dim] = [ids, x]
        for ids, x in held.values():
            yield out(ids, x)

    return run


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, norms of what the int8 form leaves, norms of the int8 form)."""
    scale = np.maximum(np.abs(x).max(1) / 127, 1e-300)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    form = q * scale[:, None]
    return q, scale, np.linalg.norm(x - form, axis=1), np.linalg.norm(form, axis=1)


_BLOCK = "dim int, ids binary, body binary, sizes binary"


def _pack(rows: int, k: int | None):
    """Blocks of int8 forms and the int8 forms of what those leave, with each row's scales and norms; k: of candidates only."""

    def block(dim: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        q, *norms = quantise(x)
        left, scale, rest, _ = quantise(x - q * norms[0][:, None])
        sizes, q = np.stack([*norms, np.linalg.norm(x, axis=1), scale, rest]), np.concatenate([q, left], 1)
        return as_batch(dim=pa.array([dim], pa.int32()), ids=pa.array([ids.tobytes()], pa.binary()), body=pa.array([q.tobytes()], pa.binary()), sizes=pa.array([sizes.tobytes()], pa.binary()))

    def run(batches):
        held: dict[int, list] = {}
        for dim, ids, x in _by_length(batches):
            held.setdefault(dim, []).append((ids, x))
        for dim, parts in held.items():
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            if k is not None:
                ids, x = _fewest(ids, x, k)
            for at in range(0, len(ids), rows):
                yield block(dim, ids[at : at + rows], x[at : at + rows])

    return run


class Form:
    """A block as it travels."""

    def __init__(self, dim: int, ids: bytes, body: bytes, sizes: bytes):
        both = np.frombuffer(body, np.int8).reshape(-1, 2 * dim)
        self.ids, self.q, self.left = np.frombuffer(ids, np.int64), both[:, :dim], both[:, dim:]
        self.scale, self.rest, self.form, self.norm, self.scale_left, self.rest_left = np.frombuffer(sizes, np.float64).reshape(6, -1)

    def fine(self, rows: np.ndarray) -> np.ndarray:
        """The sum of both forms of some rows."""
        return self.q[rows] * self.scale[rows, None] + self.left[rows] * self.scale_left[rows, None]


def kth_of(ids: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Of each row of bounds the k-th largest over distinct ids (an id counts by its best); -inf with fewer."""
    order = np.argsort(ids, kind="stable")
    names, first = np.unique(ids[order], return_index=True)
    if len(names) < k:
        return np.full(len(bounds), -np.inf)
    best = bounds if len(names) == len(ids) else np.maximum.reduceat(bounds[:, order], first, axis=1)
    return np.partition(best, len(names) - k, axis=1)[:, len(names) - k]


class Survivors:
    """What may be among the best k of each query of one block, so far: (id, lower, upper) by row."""

    def __init__(self, queries: Form, k: int):
        self.of, self.k = queries, k
        self.floor = np.full(len(queries.ids), -np.inf)
        self.rows: list[np.ndarray] = []  # of row, id, and of bounds
        self.bounds: list[np.ndarray] = []

    def meet(self, other: Form, span: int = 1024) -> None:
        for at in range(0, len(other.ids), span):
            self._meet(other, slice(at, at + span))
        self._cut()

    def _meet(self, other: Form, part: slice) -> None:
        mine, ids = self.of, other.ids[part]
        exact = np.float32 if mine.q.shape[1] < 1000 else np.float64  # sums of int8 products below 2 ** 24 are exact
        tile = (mine.q.astype(exact) @ other.q[part].astype(exact).T).astype(np.float64)
        tile *= mine.scale[:, None]
        tile *= other.scale[None, part]
        slack = mine.form[:, None] * other.rest[None, part] + mine.rest[:, None] * other.norm[None, part]
        slack += 1e-9 * (np.abs(tile) + 1e-30) + 1e-12 * mine.norm[:, None] * other.norm[None, part]
        own = mine.ids[:, None] == ids[None, :]
        self.floor = np.maximum(self.floor, kth_of(ids, np.where(own, -np.inf, tile - slack), self.k))
        row, col = np.nonzero((tile + slack >= self.floor[:, None]) & ~own)
        # vectors that lie closer than int8 tells apart: what is left of both gives bounds that are over a hundred times closer
        value, col = np.empty(len(row)), col + part.start
        for at in range(0, len(row), PAIRS):
            r, c = row[at : at + PAIRS], col[at : at + PAIRS]
            value[at : at + PAIRS] = (mine.fine(r) * other.fine(c)).sum(1)
        width = (mine.norm[row] + mine.rest_left[row]) * other.rest_left[col] + mine.rest_left[row] * other.norm[col] + 1e-12 * mine.norm[row] * other.norm[col]
        self.rows.append(np.stack([row, other.ids[col]]))
        self.bounds.append(np.stack([value - width, value + width]))

    def _cut(self) -> None:
        rows, bounds = np.concatenate(self.rows, 1), np.concatenate(self.bounds, 1)
        # the k-th lower bound of a row's distinct ids
        order = np.lexsort((-bounds[0], rows[1], rows[0]))
        lead = order[np.r_[True, (np.diff(rows[0][order]) != 0) | (np.diff(rows[1][order]) != 0)]] if len(order) else order
        lead = lead[np.lexsort((-bounds[0][lead], rows[0][lead]))]
        row = rows[0][lead]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        at = lead[place == self.k - 1]
        self.floor[rows[0][at]] = np.maximum(self.floor[rows[0][at]], bounds[0][at])
        keep = bounds[1] >= self.floor[rows[0]]
        self.rows, self.bounds = [rows[:, keep]], [bounds[:, keep]]

    def out(self) -> pa.RecordBatch | None:
        if not self.rows or not self.rows[0].shape[1]:
            return None
        rows, bounds = self.rows[0], self.bounds[0]
        return as_batch(query_id=pa.array(self.of.ids[rows[0]]), id=pa.array(rows[1]), lower=pa.array(bounds[0]), upper=pa.array(bounds[1]))


def merged(lists, k: int) -> list[tuple[float, int]]:
    """The first k of sorted lists of (-score, id); an id counts once."""
    out: list[tuple[float, int]] = []
    seen: set[int] = set()
    for pair in heapq.merge(*lists):
        if pair[1] not in seen:
            seen.add(pair[1])
            out.append(pair)
            if len(out) == k:
                break
    return out


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first number to the last."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T):
        total += a * b
    return total


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k rows of vectors with the largest inner product with each row of queries.

    A query's own id is no candidate. Best first, ties to the smaller id.
    """

    def clean(df: DataFrame) -> DataFrame:
        return df.filter(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    asked, every = clean(queries).groupBy("id").agg(F.min("vector").alias("vector")), clean(vectors)
    n_asked, n_every = asked.count(), every.count()
    # equal vectors are thinned where they lie, then brought together
    thin = every.mapInArrow(_thinned(k), "id long, vector array<double>")
    blocks = max(1, -(-n_every // CANDIDATES))  # whatever the session's partitions: small blocks would meet often
    thin = thin.repartition(blocks, F.xxhash64("vector")).coalesce(blocks)
    others = staged(thin.mapInArrow(_pack(CANDIDATES, k), _BLOCK), "candidates").withColumn("block", F.monotonically_increasing_id())
    mine = asked.coalesce(max(1, -(-n_asked // QUERIES))).mapInArrow(_pack(QUERIES, None), _BLOCK)
    mine = staged(staged(mine, "raw-queries").withColumn("qb", F.monotonically_increasing_id()), "queries")
    n_mine, n_others = max(1, mine.count()), max(1, others.count())
    # a task meets a fixed number of blocks, however many there are; fewer where that leaves cores idle
    groups = min(n_others, max(-(-n_others // MEETINGS), -(-TASKS // n_mine)))
    dealt = others.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    columns = "qb", "part", "kind", "dim", "ids", "body", "sizes"
    candidates = dealt.join(mine.select("dim", "qb"), "dim").withColumn("kind", F.lit(1)).select(*columns)
    heads = mine.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(0)).select(*columns)
    work = heads.unionByName(candidates).repartition(min(n_mine * groups, 100_000), "qb", "part").sortWithinPartitions("qb", "part", "kind")

    def meet(batches):
        now: Survivors | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                kind, *parts = (column_of(batch, c)[i].as_py() for c in ("kind", "dim", "ids", "body", "sizes"))
                if kind == 1:
                    now.meet(Form(*parts))
                    continue
                if now is not None and (done := now.out()) is not None:
                    yield done
                now = Survivors(Form(*parts), k)
        if now is not None and (done := now.out()) is not None:
            yield done

    found = staged(work.mapInArrow(meet, "query_id long, id long, lower double, upper double"), "survivors")
    # the best lower bounds of all tasks: a pair below the k-th of its query is out
    bounds = found.groupBy("query_id", "id").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    lists = bounds.groupBy("query_id").agg(F.sort_array(F.collect_list("lower"), asc=False).alias("l"), F.collect_list(F.struct("id", "upper")).alias("c"))
    floor = F.when(F.size("l") >= k, F.element_at("l", k)).otherwise(F.lit(float("-inf")))
    kept = lists.withColumn("floor", floor).select("query_id", F.explode(F.expr("filter(c, x -> x.upper >= floor)")).alias("c"))
    pairs = kept.select("query_id", F.col("c.id").alias("id"))
    left = asked.select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    joined = staged(pairs, "pairs").join(every, "id").join(left, "query_id").filter(F.size("q") == F.size("vector"))

    def again(batches):
        for batch in batches:
            q, x = column_of(batch, "q"), column_of(batch, "vector")
            sizes = np.diff(x.offsets.to_numpy())
            score = np.empty(len(sizes))
            flat_q, flat_x = (c.flatten().to_numpy(zero_copy_only=False) for c in (q, x))
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                which = np.flatnonzero(sizes == dim)
                for at in range(0, len(which), PAIRS):
                    some = which[at : at + PAIRS]
                    place = starts[some][:, None] + np.arange(dim)
                    score[some] = _in_order(flat_q[place], flat_x[place])
            yield as_batch(query_id=column_of(batch, "query_id"), id=column_of(batch, "id"), score=pa.array(score))

    scored = joined.select("query_id", "id", "q", "vector").mapInArrow(again, "query_id long, id long, score double")
    gathered = scored.groupBy("query_id").agg(F.collect_list(F.struct("id", "score")).alias("list"))

    def merge(batches):
        for batch in batches:
            rows = []
            for query, found in zip(column_of(batch, "query_id").to_pylist(), column_of(batch, "list").to_pylist(), strict=True):
                best = merged([heapq.nsmallest(len(found), ((-x["score"], x["id"]) for x in found))], k)
                rows += [(query, rank, i, -s) for rank, (s, i) in enumerate(islice(best, k), 1)]
            q, rank, ids, score = zip(*rows) if rows else ((), (), (), ())
            yield as_batch(query_id=pa.array(q, pa.int64()), rank=pa.array(rank, pa.int32()), **{id_col: pa.array(ids, pa.int64())}, score=pa.array(score, pa.float64()))

    return gathered.mapInArrow(merge, f"query_id long, rank int, `{id_col}` long, score double")
