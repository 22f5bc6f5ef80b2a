"""Entity graphs: building article graphs, merging them, subgraphs and statistics.

Edges are undirected rows (src, dst) with src < dst; self-loops are left out. Articles and entities are strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Precedence of edge types on one pair of nodes.
EDGE_PRIORITY = {"contains": 1, "same_type": 2, "cross_type": 3, "co_occurrence": 0}


def canonical(df: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """(src, dst, kept columns) with src < dst; pairs of equal ends go."""
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), *keep)


def unpivot_entities(articles: DataFrame, title: str, lists: list[str]) -> DataFrame:
    """(article, entity_type, pos, entity) from array columns, in list order; null lists give nothing."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("entity_type"), F.col(c).alias("list")) for c in lists])).alias("p")
    each = articles.select(F.col(title).alias("article"), pairs).select("article", "p.entity_type", F.posexplode("p.list").alias("pos", "entity"))
    return each.filter(F.trim("entity") != "")


def without_stopwords(entities: DataFrame, stopwords: DataFrame, entity: str = "entity", word: str = "word") -> DataFrame:
    """Drop entities that are, trimmed and in lower case, a stop word."""
    words = stopwords.select(F.lower(F.trim(word)).alias("_word")).distinct()
    return entities.join(words, F.lower(F.trim(entity)) == F.col("_word"), "left_anti")


def same_type_edges(entities: DataFrame) -> DataFrame:
    """(article, src, dst) for each pair of entities of one type in an article."""
    e = entities.select("article", "entity_type", "entity").distinct()
    other = e.withColumnRenamed("entity", "entity_b")
    return e.join(other, ["article", "entity_type"]).filter("entity < entity_b").select("article", F.col("entity").alias("src"), F.col("entity_b").alias("dst")).distinct()


def cross_type_edges(entities: DataFrame) -> DataFrame:
    """(article, src, dst) for each pair of entities of different types in an article."""
    e = entities.select("article", "entity_type", "entity").distinct()
    other = e.select("article", F.col("entity_type").alias("type_b"), F.col("entity").alias("entity_b"))
    return e.join(other, "article").filter("entity_type <> type_b AND entity < entity_b").select("article", F.col("entity").alias("src"), F.col("entity_b").alias("dst")).distinct()


def article_edges(entities: DataFrame) -> DataFrame:
    """(article, src, dst, edge_type) of every article's graph: its title's star, then pairs by type.

    Where several types meet on a pair, cross_type counts before same_type before contains.
    """
    e = entities.select("article", "entity_type", "entity").distinct()
    other = e.select("article", F.col("entity_type").alias("type_b"), F.col("entity").alias("entity_b"))
    kind = F.when(F.col("entity_type") == F.col("type_b"), EDGE_PRIORITY["same_type"]).otherwise(EDGE_PRIORITY["cross_type"])
    pairs = e.join(other, "article").filter("entity < entity_b").select("article", F.col("entity").alias("src"), F.col("entity_b").alias("dst"), kind.alias("p"))
    star = canonical(e.select("article", F.col("article").alias("a"), "entity"), "a", "entity", "article").withColumn("p", F.lit(EDGE_PRIORITY["contains"]))
    best = star.select("article", "src", "dst", "p").unionByName(pairs).groupBy("article", "src", "dst").agg(F.max("p").alias("p"))
    names = F.create_map(*[F.lit(x) for name, rank in EDGE_PRIORITY.items() for x in (rank, name)])
    return best.select("article", "src", "dst", F.element_at(names, F.col("p")).alias("edge_type"))


def priority(edge_type: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EDGE_PRIORITY.items() for x in kv])
    return F.element_at(table, F.col(edge_type))


def global_nodes(entities: DataFrame) -> DataFrame:
    """(id, node_type, frequency, article_count, articles) over all article graphs.

    A title's type is 'title', whatever entity has its name; else the type named last by article wins.
    """
    titles = entities.select(F.col("article").alias("id"), F.lit("title").alias("node_type"), "article").distinct()
    found = entities.select(F.col("entity").alias("id"), F.col("entity_type").alias("node_type"), "article").distinct()
    rank = F.struct((F.col("node_type") == "title").cast("int"), "article", "node_type")
    nodes = titles.unionByName(found).groupBy("id").agg(F.max_by("node_type", rank).alias("node_type"), F.array_sort(F.collect_set("article")).alias("articles"))
    return nodes.select("id", "node_type", F.size("articles").cast("long").alias("frequency"), F.size("articles").cast("long").alias("article_count"), "articles")


def global_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, edge_type): pairs whose ends are both nodes; the first article's type wins."""
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept.groupBy("src", "dst").agg(F.min_by("edge_type", "article").alias("edge_type"))


def shared_pairs(membership: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """(a, b, common): pairs of items and in how many groups both are, at least `least`."""
    m = membership.select(F.col(group).alias("g"), F.col(item).alias("a")).distinct()
    return m.join(m.withColumnRenamed("a", "b"), "g").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common")).filter(F.col("common") >= least)


def cooccurrence(bipartite: DataFrame, existing: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(src, dst, weight, jaccard_similarity) of entities that share articles; pairs in existing (src, dst) are left out."""
    sizes = bipartite.groupBy("entity").agg(F.countDistinct("title").alias("n"))
    pairs = shared_pairs(bipartite, "title", "entity", least)
    na, nb = sizes.select(F.col("entity").alias("a"), F.col("n").alias("na")), sizes.select(F.col("entity").alias("b"), F.col("n").alias("nb"))
    out = pairs.join(na, "a").join(nb, "b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("common").alias("weight"), (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard_similarity"))
    return out if existing is None else out.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree); with nodes (id) those without an edge have 0. A self-loop counts twice."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    counted = ends.groupBy("id").agg(F.count("*").alias("degree"))
    if nodes is None:
        return counted
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between nodes (id)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def importance(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """Adds importance = 0.7 frequency (1 if unknown) + 0.3 degree."""
    joined = nodes.join(degree, "id", "left")
    return joined.withColumn("importance", 0.7 * F.coalesce("frequency", F.lit(1)) + 0.3 * F.coalesce("degree", F.lit(0)))


def top_fraction(scored: DataFrame, score: str, key: str, parts: int = 5) -> DataFrame:
    """The best max(1, n // parts) rows by score, ties by key; ranks come from sorted partitions, no task gets all rows."""
    from lectern.operators.scheduling import numbered

    n = scored.count()
    if not n:
        return scored
    placed = numbered(scored.withColumn("_best", F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))), "_best", "_place")
    return placed.filter(F.col("_place") < max(1, n // parts)).drop("_best", "_place")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, each pair an edge. Wedges start at the end of smaller degree, which bounds hubs."""
    d = degrees(edges)
    e = edges.select("src", "dst").distinct()
    ranked = e.join(d.withColumnRenamed("id", "src").withColumnRenamed("degree", "ds"), "src").join(d.withColumnRenamed("id", "dst").withColumnRenamed("degree", "dd"), "dst")
    first = F.struct("ds", "src") < F.struct("dd", "dst")
    directed = ranked.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedge = directed.join(directed.withColumnRenamed("v", "w"), "u").filter("v < w")
    closed = wedge.join(e.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"], "left_semi")
    corners = F.array_sort(F.array("u", "v", "w"))
    return closed.select(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, triangles, clustering): 2 T / (d (d - 1)), 0 for degree below 2."""
    t = triangles(edges)
    corner = t.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    d = degrees(edges.select("src", "dst").distinct())
    n = F.coalesce("triangles", F.lit(0))
    return d.join(corner, "id", "left").select("id", n.cast("long").alias("triangles"), F.when(F.col("degree") < 2, 0.0).otherwise(2 * n / (F.col("degree") * (F.col("degree") - 1))).alias("clustering"))


def merge_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, node_type, frequency, article_count) after contraction; groups: (node, component)."""
    joined = nodes.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("rep", F.coalesce("component", "id"))
    articles = F.array_sort(F.array_distinct(F.flatten(F.collect_list("articles"))))
    return joined.groupBy("rep").agg(F.min_by("node_type", "id").alias("node_type"), F.sum("frequency").alias("frequency"), articles.alias("articles")).select(F.col("rep").alias("id"), "node_type", "frequency", F.size("articles").cast("long").alias("article_count"), "articles")


def remap_edges(edges: DataFrame, groups: DataFrame, weight: str = "weight") -> DataFrame:
    """(src, dst, weight) between representatives, weights summed, self-loops left out."""
    a, b = groups.select(F.col("node").alias("src"), F.col("component").alias("ra")), groups.select(F.col("node").alias("dst"), F.col("component").alias("rb"))
    ends = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("ra", "src").alias("u"), F.coalesce("rb", "dst").alias("v"), weight)
    return canonical(ends, "u", "v", weight).groupBy("src", "dst").agg(F.sum(weight).alias(weight))


def hierarchical_layout(nodes: DataFrame, layer: str, key: str = "id") -> DataFrame:
    """(key, layer, x, y): layers in order from top, nodes of a layer evenly between -1 and 1."""
    layers = nodes.select(layer).distinct().withColumn("level", F.row_number().over(Window.orderBy(layer)) - 1)
    w = Window.partitionBy(layer)
    placed = nodes.join(F.broadcast(layers), layer).withColumn("i", F.row_number().over(w.orderBy(key)) - 1).withColumn("n", F.count("*").over(w))
    x = F.when(F.col("n") == 1, -1.0).otherwise(-1.0 + 2.0 * F.col("i") / (F.col("n") - 1))
    return placed.select(key, layer, x.alias("x"), (-F.col("level")).cast("double").alias("y"))


def clustered_layout(nodes: DataFrame, cluster: str, key: str = "id") -> DataFrame:
    """(key, cluster, x, y): clusters on a circle of radius 3, members on circles of radius 0.5 + 0.1 n around them."""
    clusters = nodes.groupBy(cluster).agg(F.count("*").alias("n"))
    numbered = clusters.withColumn("c", F.row_number().over(Window.orderBy(cluster)) - 1).withColumn("k", F.count("*").over(Window.partitionBy(F.lit(1))))
    placed = nodes.join(F.broadcast(numbered), cluster).withColumn("i", F.row_number().over(Window.partitionBy(cluster).orderBy(key)) - 1)
    turn, spin = 2 * F.pi() * F.col("c") / F.col("k"), 2 * F.pi() * F.col("i") / F.col("n")
    radius = 0.5 + 0.1 * F.col("n")
    return placed.select(key, cluster, (3 * F.cos(turn) + radius * F.cos(spin)).alias("x"), (3 * F.sin(turn) + radius * F.sin(spin)).alias("y"))
