"""Groups of articles that share entities, over a bipartite table (title, entity)."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.graph import shared_pairs


def article_pairs(bipartite: DataFrame, least: int = 1) -> DataFrame:
    """(a1, a2, common): pairs of articles by how many entities they share."""
    return shared_pairs(bipartite, "entity", "title", least).withColumnsRenamed({"a": "a1", "b": "a2"})


def combinations(bipartite: DataFrame, k: int, least: int) -> DataFrame:
    """(a1 .. ak, common) with a1 < ... < ak: every k articles with at least `least` common entities.

    A set only grows from one that has enough in common, so each round joins few rows.
    """
    b = bipartite.select("title", "entity").distinct()
    wide = b.select(F.col("title").alias("a1"), "entity")
    for i in range(2, k + 1):
        names = [f"a{j}" for j in range(1, i + 1)]
        grown = wide.join(b.withColumnRenamed("title", f"a{i}"), "entity").filter(F.col(f"a{i - 1}") < F.col(f"a{i}"))
        enough = grown.groupBy(*names).agg(F.count("*").alias("common")).filter(F.col("common") >= least)
        if i == k:
            return enough
        wide = grown.join(enough.drop("common"), names, "left_semi")
    return wide.groupBy("a1").agg(F.count("*").alias("common")).filter(F.col("common") >= least)


def combinations_fpgrowth(bipartite: DataFrame, k: int, least: int) -> DataFrame:
    """(a1 .. ak, common) as combinations() gives them, by frequent item sets: a basket for each entity, articles as items."""
    baskets = bipartite.groupBy("entity").agg(F.collect_set("title").alias("items")).filter(F.size("items") >= k)
    n = baskets.count()
    if not n:
        return combinations(bipartite, k, least).limit(0)
    sets = FPGrowth(itemsCol="items", minSupport=max((least - 1e-6) / n, 0.0)).fit(baskets).freqItemsets
    ordered = sets.filter((F.size("items") == k) & (F.col("freq") >= least)).select(F.array_sort("items").alias("s"), "freq")
    return ordered.select(*[F.col("s")[i].alias(f"a{i + 1}") for i in range(k)], F.col("freq").alias("common"))


def pairwise_expansion(bipartite: DataFrame, least: int, top_pairs: int = 50) -> DataFrame:
    """(a1, a2, a3, common), sorted within: the best pairs, each with every third article that shares enough with both."""
    b = bipartite.select("title", "entity").distinct()
    pairs = article_pairs(b, least).orderBy(F.col("common").desc(), "a1", "a2").limit(top_pairs).select("a1", "a2")
    inside = F.broadcast(pairs).join(b.withColumnRenamed("title", "a1"), "a1").join(b.withColumnRenamed("title", "a2"), ["a2", "entity"])
    third = inside.join(b.withColumnRenamed("title", "a3"), "entity").filter("a3 <> a1 AND a3 <> a2")
    found = third.groupBy("a1", "a2", "a3").agg(F.count("*").alias("common")).filter(F.col("common") >= least)
    s = F.array_sort(F.array("a1", "a2", "a3"))
    return found.select(s[0].alias("a1"), s[1].alias("a2"), s[2].alias("a3"), "common").distinct()


def quality(pairs: DataFrame, bipartite: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds quality_score to (a1, a2): 0.4 * 2|C| + 0.3 mean importance of C + 0.2 mean richness + 0.1 |C| / |union|.

    scores: (entity, importance), 1 where unknown; richness is an article's number of entities.
    """
    b = bipartite.select("title", "entity").distinct()
    rich = b.groupBy("title").agg(F.count("*").alias("n"))
    common = pairs.select("a1", "a2").join(b.withColumnRenamed("title", "a1"), "a1").join(b.withColumnRenamed("title", "a2"), ["a2", "entity"])
    stats = common.join(scores, "entity", "left").groupBy("a1", "a2").agg(F.count("*").alias("c"), F.avg(F.coalesce("importance", F.lit(1.0))).alias("imp"))
    r1, r2 = rich.select(F.col("title").alias("a1"), F.col("n").alias("n1")), rich.select(F.col("title").alias("a2"), F.col("n").alias("n2"))
    joined = stats.join(r1, "a1").join(r2, "a2")
    score = 0.4 * 2 * F.col("c") + 0.3 * F.col("imp") + 0.2 * (F.col("n1") + F.col("n2")) / 2 + 0.1 * F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))
    return joined.select("a1", "a2", F.col("c").alias("common"), score.alias("quality_score"))


def entity_details(combos: DataFrame, bipartite: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flat (a1, a2, entity, node_type, frequency, importance) of each common entity; nodes: (id, node_type, frequency, importance)."""
    b = bipartite.select("title", "entity").distinct()
    common = combos.select("a1", "a2").join(b.withColumnRenamed("title", "a1"), "a1").join(b.withColumnRenamed("title", "a2"), ["a2", "entity"])
    return common.join(nodes.withColumnRenamed("id", "entity"), "entity").select("a1", "a2", "entity", "node_type", "frequency", "importance")


def union_first(first: DataFrame, second: DataFrame, keys: list[str], method: str = "method") -> DataFrame:
    """All rows of first, and those of second whose keys first lacks; `method` tells which."""
    a = first.dropDuplicates(keys).withColumn(method, F.lit(1))
    b = second.dropDuplicates(keys).join(first.select(*keys), keys, "left_anti").withColumn(method, F.lit(2))
    return a.unionByName(b)


def walk_sets(walks: DataFrame, is_title) -> DataFrame:
    """(title, entity) of every article and every entity that one walk (walk, step, id) passes."""
    t = walks.filter(is_title).select("walk", F.col("id").alias("title")).distinct()
    e = walks.filter(~is_title).select("walk", F.col("id").alias("entity")).distinct()
    return t.join(e, "walk").select("title", "entity").distinct()
