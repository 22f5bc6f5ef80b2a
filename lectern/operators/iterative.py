"""Iterative graph analytics over edges (src, dst): paths, centralities, PageRank and walks.

Each step is a join and an aggregate; every few steps the lineage is cut through the shared folder.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.staging import staged


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) in either direction, once each."""
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def distances(edges: DataFrame, sources: DataFrame, max_steps: int | None = None) -> DataFrame:
    """(source, id, d): steps from each source (id) to each node that it reaches, itself included; all of them unless max_steps is given."""
    adj = staged(both_ways(edges), "adjacency")
    frontier = staged(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("d")), "frontier")
    seen = frontier
    for step in count(1) if max_steps is None else range(1, max_steps + 1):
        ahead = frontier.join(adj, frontier.id == adj.u).select("source", F.col("v").alias("id")).distinct()
        new = staged(ahead.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("d", F.lit(step)), "frontier")
        if new.isEmpty():
            return seen
        frontier, seen = new, seen.unionByName(new)
        if step % 4 == 0:
            seen = staged(seen, "seen")
    return seen


def closeness(edges: DataFrame) -> DataFrame:
    """(id, closeness): (r - 1) / sum d, scaled by (r - 1) / (n - 1), over the r nodes that id reaches."""
    nodes = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    n = nodes.count()
    per = distances(edges, nodes).groupBy("source").agg(F.count("*").alias("r"), F.sum("d").alias("total"))
    value = F.when(F.col("total") > 0, (F.col("r") - 1) / F.col("total") * (F.col("r") - 1) / max(n - 1, 1)).otherwise(0.0)
    return per.select(F.col("source").alias("id"), value.alias("closeness"))


def betweenness(edges: DataFrame, max_steps: int | None = None) -> DataFrame:
    """(id, betweenness), scaled by 1 / ((n - 1)(n - 2)): path counts forward from every source, shares back."""
    adj = staged(both_ways(edges), "adjacency")
    nodes = adj.select(F.col("u").alias("id")).distinct()
    n = nodes.count()
    level = staged(nodes.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")), "level")
    levels, seen = [level], level.select("s", "id")
    for _ in count() if max_steps is None else range(max_steps):
        ahead = level.join(adj, level.id == adj.u).groupBy("s", F.col("v").alias("id")).agg(F.sum("sigma").alias("sigma"))
        level = staged(ahead.join(seen, ["s", "id"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "id"))
    total = None
    share = None
    for upper, lower in zip(reversed(levels[:-1]), reversed(levels[1:])):
        own = lower if share is None else lower.join(share, ["s", "id"], "left")
        delta = F.lit(0.0) if share is None else F.coalesce("delta", F.lit(0.0))
        down = own.select("s", F.col("id").alias("w"), F.col("sigma").alias("sw"), delta.alias("dw"))
        back = down.join(adj, down.w == adj.v).select("s", F.col("u").alias("id"), "sw", "dw").join(upper, ["s", "id"])
        share = staged(back.groupBy("s", "id").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("dw"))).alias("delta")), "share")
        part = share.filter("s <> id").select("id", "delta")
        total = part if total is None else total.unionByName(part)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    summed = nodes.withColumn("delta", F.lit(0.0)) if total is None else nodes.withColumn("delta", F.lit(0.0)).unionByName(total)
    return summed.groupBy("id").agg((F.sum("delta") * scale).alias("betweenness"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, weight: str | None = None, tolerance: float | None = None) -> DataFrame:
    """(id, rank) after a fixed number of rounds; with a tolerance also as soon as all ranks together move by less than n times it.

    Every node of an undirected edge list has an edge out, so no rank is left over. `weight` names the edges' weights.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), w.cast("double").alias("w"))
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    out = both.groupBy("u").agg(F.sum("w").alias("total"))
    links = staged(both.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("share")), "links")
    nodes = staged(links.select(F.col("u").alias("id")).distinct(), "nodes")
    n = max(nodes.count(), 1)
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        sent = links.join(ranks.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        before = ranks
        ranks = nodes.join(sent, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 4 == 3 or tolerance is not None:
            ranks = staged(ranks, "ranks")
        if tolerance is not None:
            moved = ranks.join(before.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if (moved or 0.0) < n * tolerance:
                break
    return ranks


def eigenvector(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, eigenvector): power iteration on A + I from equal values, of length 1."""
    adj = staged(both_ways(edges), "adjacency")
    x = adj.select(F.col("u").alias("id")).distinct().withColumn("x", F.lit(1.0))
    for k in range(rounds):
        moved = adj.join(x, adj.u == x.id).select(F.col("v").alias("id"), "x").unionAll(x).groupBy("id").agg(F.sum("x").alias("x"))
        moved = staged(moved, "power")
        norm = moved.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        x = moved.select("id", (F.col("x") / norm).alias("x"))
    return x.withColumnRenamed("x", "eigenvector")


def _pick(seed: int, *parts) -> F.Column:
    """A number from the first 8 hex digits of an md5, which any SQL engine can repeat."""
    key = F.concat_ws(":", F.lit(seed), *parts)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def random_walks(edges: DataFrame, starts: DataFrame, length: int = 8, seed: int = 42, important: DataFrame | None = None, bias: float = 0.3) -> DataFrame:
    """(walk, step, id): walks from starts (walk, id) over edges, one uniform step at a time, until none is left.

    With important (id), a step from an important node's neighbour list takes, with probability bias, an important one if any.
    """
    adj = both_ways(edges)
    lists = adj.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("all"))
    if important is not None:
        chosen = adj.join(important.select(F.col("id").alias("v")), "v", "left_semi").groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("some"))
        lists = lists.join(chosen, "u", "left")
    else:
        lists = lists.withColumn("some", F.lit(None).cast(lists.schema["all"].dataType))
    lists = staged(lists, "neighbours")
    now = starts.select("walk", F.lit(0).alias("step"), "id")
    steps = [now]
    for k in range(1, length):
        at = now.join(lists, now.id == lists.u)
        use = F.col("some").isNotNull() & (F.pmod(_pick(seed + 1, F.col("walk"), F.lit(k)), F.lit(1000)) < int(1000 * bias))
        options = F.when(use, F.col("some")).otherwise(F.col("all"))
        place = F.pmod(_pick(seed, F.col("walk"), F.lit(k)), F.size(options).cast("long"))
        now = staged(at.select("walk", F.lit(k).alias("step"), F.element_at(options, (place + 1).cast("int")).alias("id")), "walk-step")
        steps.append(now)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out
