"""Connected components of a link table by repeated contraction; nothing is gathered on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.staging import dropped, staged

#: So few links are finished in one task.
LOCAL = 1 << 20


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n places the least that links a-b reach."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label[label] == label).all():
            label = label[label]
    return label


def finished(links: DataFrame) -> DataFrame:
    """(node, component) of a bounded number of links (src, dst), in one task."""

    def run(batches):
        held = list(batches)
        if not held:
            return
        ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in held]).combine_chunks().dictionary_encode()
        names = ends.dictionary
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[ends.indices.to_numpy()]
        label = least_reachable(len(order), code[: len(code) // 2], code[len(code) // 2 :])
        names = names.take(pa.array(order))
        for at in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([names.slice(at, 100_000), names.take(pa.array(label[at : at + 100_000]))], names=["node", "component"])

    kind = links.schema["src"].dataType.simpleString()
    return links.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def roots(moves: DataFrame) -> DataFrame:
    """(node, component) with each node's component replaced by the end of its chain; moves never go up.

    Each step joins the table with itself, so chains of n nodes end after log2 n steps.
    """
    while True:
        up = moves.filter("node <> component").select(F.col("node").alias("component"), F.col("component").alias("next"))
        ahead = staged(moves.join(up, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")), "jumps")
        more = not ahead.filter("moved").isEmpty()
        dropped(moves)
        moves = ahead.drop("moved")
        moves._staged_at = ahead._staged_at
        if not more:
            return moves


def components(links: DataFrame, src: str = "src", dst: str = "dst", local: int = LOCAL) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link to another.

    Each round every node points to its smallest neighbour, chains of pointers are followed to their ends, and links move
    there. A node without a smaller neighbour either draws another in or is next to a smaller one after the
    round, so two rounds halve the nodes at least: rounds grow as the logarithm of the nodes, steps of a round likewise.
    Once there are `local` links or fewer, one task finishes them. Joined tables are read from files, which lets Spark split
    what a hot node deals out.
    """
    e = staged(links.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).filter("src <> dst").distinct(), "links")
    out = None

    def followed(move: DataFrame) -> DataFrame:
        if out is None:
            return move
        step = move.select(F.col("node").alias("component"), F.col("component").alias("next"))
        joined = staged(out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "components")
        dropped(out, move)
        return joined

    while (n := e.count()) > local:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        first = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component"))
        move = roots(staged(first, "moves"))
        a = move.select(F.col("node").alias("src"), F.col("component").alias("a"))
        b = move.select(F.col("node").alias("dst"), F.col("component").alias("b"))
        moved = e.join(a, "src").join(b, "dst").filter("a <> b")
        left = staged(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "links")
        out = followed(move)
        dropped(e)
        e = left
    if n or out is None:
        out = followed(staged(finished(e), "finished"))
    dropped(e)
    return out
