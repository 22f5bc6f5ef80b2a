"""Tables and views that several queries use, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Similarity from which embeddings of one label count as the same node.
SAME_NODE = 0.30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, entity): suppliers as articles, parts as entities, an edge where a line has 45 pieces or more."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45")
    return lines.select(F.concat(F.lit("S"), "l_suppkey").alias("title"), F.concat(F.lit("P"), "l_partkey").alias("entity")).distinct()


BIP = "bip AS (SELECT DISTINCT 'S' || l_suppkey AS title, 'P' || l_partkey AS entity FROM lineitem WHERE l_quantity >= 45)"


def typed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article, entity_type, entity): the bipartite view with each part's type."""
    types = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("entity"), F.col("p_type").alias("entity_type"))
    return bipartite(spark, sf_dir).withColumnRenamed("title", "article").join(types, "entity").select("article", "entity_type", "entity")


ENT = BIP + ", ent AS (SELECT b.title AS article, p.p_type AS entity_type, b.entity FROM bip b JOIN part p ON b.entity = 'P' || p.p_partkey)"


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bipartite view as undirected edges (src, dst)."""
    return bipartite(spark, sf_dir).select(F.least("title", "entity").alias("src"), F.greatest("title", "entity").alias("dst"))


EDGES = BIP + ", edges AS (SELECT least(title, entity) AS src, greatest(title, entity) AS dst FROM bip)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, node_type, frequency, article_count) of titles and entities; frequency counts the articles of a node."""
    e = typed_entities(spark, sf_dir)
    titles = e.select("article").distinct().select(F.col("article").alias("id"), F.lit("title").alias("node_type"), F.lit(1).cast("long").alias("frequency"))
    parts = e.groupBy("entity", "entity_type").agg(F.count("*").alias("frequency")).select(F.col("entity").alias("id"), F.col("entity_type").alias("node_type"), "frequency")
    return titles.unionByName(parts).withColumn("article_count", F.col("frequency"))


NODES = (
    ENT
    + ", nodes AS (SELECT DISTINCT article AS id, 'title' AS node_type, CAST(1 AS BIGINT) AS frequency, CAST(1 AS BIGINT) AS article_count FROM ent"
    + " UNION ALL SELECT entity, entity_type, count(*), count(*) FROM ent GROUP BY ALL)"
)


def article_graph(spark: SparkSession, sf_dir: str, least: int = 5) -> DataFrame:
    """(src, dst) of articles with at least `least` common entities."""
    from lectern.operators.selection import article_pairs

    return article_pairs(bipartite(spark, sf_dir), least).select(F.col("a1").alias("src"), F.col("a2").alias("dst"))


ARTICLES = (
    BIP
    + ", ag AS (SELECT x.title AS src, y.title AS dst FROM bip x JOIN bip y ON x.entity = y.entity AND x.title < y.title GROUP BY 1, 2 HAVING count(*) >= 5)"
    + ", adj AS (SELECT src AS u, dst AS v FROM ag UNION ALL SELECT dst, src FROM ag)"
)


def similar(spark: SparkSession, sf_dir: str, threshold: float | None = SAME_NODE, k: int = 20) -> DataFrame:
    """(a, b, sim) of embeddings of one label among each other's k nearest, at least threshold (none: all)."""
    from lectern.operators.dedup import candidate_pairs, neighbours

    pairs = candidate_pairs(neighbours(table(spark, sf_dir, "embeddings"), k, "vec_id", "embedding", "label"))
    return pairs if threshold is None else pairs.filter(F.col("sim") >= threshold)


KNN = """scored AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
            FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
        near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS r FROM scored) WHERE r <= 20),
        cand AS (SELECT least(id, nbr) AS a, greatest(id, nbr) AS b, max(sim) AS sim FROM near GROUP BY 1, 2)"""

COMPONENTS = (
    KNN
    + f""", pairs AS (SELECT a, b FROM cand WHERE sim >= {SAME_NODE}),
        both_ways AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
        reach(node, other) AS (SELECT u, u FROM both_ways UNION SELECT r.node, w.v FROM reach r JOIN both_ways w ON r.other = w.u),
        comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""
)
