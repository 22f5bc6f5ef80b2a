"""Shaping records: nested fields, flattened results, totals, progress, reports, and the walk-based selection as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import truthy
from lectern.operators.iterative import _pick, random_walks
from lectern.operators.selection import article_pairs, entity_details, quality, walk_sets


def typed_items(items: Column, kind: str, type_field: str = "type", field: str = "interpretation") -> Column:
    """Of an array of structs the texts of one type, without empty ones."""
    return truthy(F.transform(F.filter(items, lambda x: x[type_field] == kind), lambda x: x[field]))


def with_extra(df: DataFrame, keep: list[str], name: str = "extra") -> DataFrame:
    """The kept columns and a map of all others that are not null, as text."""
    rest = [c for c in df.columns if c not in keep]
    pairs = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]) if rest else F.create_map().cast("map<string,string>")
    return df.select(*keep, F.map_filter(pairs, lambda _, v: v.isNotNull()).alias(name))


def flattened(pages: Column, joiner: str = "\n") -> Column:
    """Pages of paragraphs (text, table) as one text: each paragraph's text, or else its table."""
    return F.array_join(F.transform(F.flatten(pages), lambda p: F.coalesce(p["text"], p["table"], F.lit(""))), joiner)


def most_common(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, the smaller of equally frequent ones."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def line_count(text: Column | str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def totals(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, characters, tokens, failed): failed where a document has no token at all."""
    tokens = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return df.groupBy(key).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("characters"), F.sum(tokens).alias("tokens"), F.count_if(tokens == 0).alias("failed"))


def progress(tasks: DataFrame, key: str, done: Column) -> DataFrame:
    """(key, total, done, left) of each rollout."""
    return tasks.groupBy(key).agg(F.count("*").alias("total"), F.count_if(done).alias("done"), (F.count("*") - F.count_if(done)).alias("left"))


def eta(finished: DataFrame, key: str, order: list, seconds: str, total: Column | int) -> DataFrame:
    """Adds completed, elapsed and remaining (the mean so far times what is left) in the order of finishing, for each key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = finished.withColumn("completed", F.count("*").over(w)).withColumn("elapsed", F.sum(seconds).over(w))
    total = total if isinstance(total, Column) else F.lit(total)
    return out.withColumn("remaining", F.col("elapsed") / F.col("completed") * F.greatest(total - F.col("completed"), F.lit(0)))


def report_lines(by: DataFrame, name: str, counts: list[str]) -> DataFrame:
    """(rank, line) of a text report: a line for each name, then the totals. by: one row for each name, a bounded number."""
    said = lambda label: F.concat(label, F.lit(": "), F.concat_ws(", ", *[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in counts]))
    every = by.agg(*[F.sum(c).alias(c) for c in counts]).select(F.lit(1).alias("rank"), said(F.lit("TOTAL")).alias("line"))
    return by.select(F.lit(0).alias("rank"), said(F.col(name)).alias("line")).unionByName(every)


def stratified_starts(titles: DataFrame, important: DataFrame, walks: int, share: float = 0.7, seed: int = 42) -> DataFrame:
    """(walk, id): int(walks * share) walks start at titles, the others at important entities, picked with replacement.

    Both tables have a column id. A pick is a number from an md5 modulo the table's size, so the same walks come back.
    """
    from lectern.operators.scheduling import numbered

    first = int(walks * share)
    spark = titles.sparkSession

    def picked(nodes: DataFrame, low: int, high: int) -> DataFrame:
        placed = numbered(nodes.select("id").distinct(), "id", "_place")
        n = nodes.select("id").distinct().count()
        if not n or low >= high:
            return spark.createDataFrame([], "walk string, id string")
        asked = spark.range(low, high).select(F.col("id").cast("string").alias("walk"))
        asked = asked.withColumn("_place", F.pmod(_pick(seed, F.col("walk"), F.lit("start")), F.lit(n)))
        return asked.join(placed, "_place").select("walk", "id")

    return picked(titles, 0, first).unionByName(picked(important, first, walks))


def select_by_walks(bipartite: DataFrame, scores: DataFrame, walks: DataFrame, is_title: Column, least: int, limit: int) -> DataFrame:
    """(a1, a2, common, quality_score): pairs of articles among what walks passed, the best `limit` by quality.

    Articles only count with the entities of their walks, and only where the graph has that edge.
    """
    sets = walk_sets(walks, is_title).join(bipartite, ["title", "entity"], "left_semi")
    pairs = article_pairs(sets, least)
    return quality(pairs, sets, scores).orderBy(F.col("quality_score").desc(), "a1", "a2").limit(limit)


def orchestrated(bipartite: DataFrame, edges: DataFrame, nodes: DataFrame, walks: int = 2000, length: int = 12, least: int = 3, limit: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The whole selection: stratified starts, biased walks, pairs with enough in common, the best of them, their entities' details.

    nodes: (id, node_type, frequency, importance) with type 'title' for articles. Gives (pairs, details).
    """
    titles = nodes.filter("node_type = 'title'").select("id")
    others = nodes.filter("node_type <> 'title'")
    important = others.filter(F.col("frequency") >= least).select("id")
    walked = random_walks(edges, stratified_starts(titles, important, walks, seed=seed), length, seed, important)
    marked = walked.join(titles.withColumn("_title", F.lit(True)), "id", "left").withColumn("_title", F.coalesce("_title", F.lit(False)))
    scores = others.select(F.col("id").alias("entity"), "importance")
    best = select_by_walks(bipartite, scores, marked, F.col("_title"), least, limit)
    return best, entity_details(best, bipartite, others)


def summary_lines(best: DataFrame, details: DataFrame, combos: int = 5, entities: int = 8) -> DataFrame:
    """(a1, a2, line): the best combinations, each with its first entities by importance."""
    top = best.orderBy(F.col("quality_score").desc(), "a1", "a2").limit(combos)
    named = top.join(details.select("a1", "a2", "entity", "importance"), ["a1", "a2"])
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "entity"))), 1, entities), lambda x: x["entity"])
    said = F.concat(F.col("a1"), F.lit(" + "), F.col("a2"), F.lit(": "), F.array_join("names", ", "))
    return named.groupBy("a1", "a2").agg(names.alias("names")).select("a1", "a2", said.alias("line"))
