"""Similar-node detection: vector and token similarity, thresholds, contraction."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.components import components
from lectern.operators.graph import merge_nodes, remap_edges
from lectern.operators.vectors import dot, nearest


def unit(v: Column | str) -> Column:
    """The vector over its length, as doubles; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def neighbours(vectors: DataFrame, k: int, key: str, vector: str, block: str) -> DataFrame:
    """(id, nbr, sim): the k most similar others of each row within its block, ties to the smaller key."""
    v = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(block).alias("block"))
    return nearest(v, v, k, own=False).drop("rank")


def candidate_pairs(near: DataFrame) -> DataFrame:
    """(a, b, sim) with a < b, once for each pair that either side names."""
    return near.groupBy(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).agg(F.max("sim").alias("sim"))


def approximate_pairs(vectors: DataFrame, threshold: float, key: str, vector: str, block: str, bucket: float = 0.5, tables: int = 6) -> DataFrame:
    """(a, b, sim) at least threshold, by random-projection hashing; unit vectors are expected, some pairs may be missed."""
    v = vectors.select(F.col(key).alias("id"), F.col(block).alias("block"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=42).fit(v)
    found = model.approxSimilarityJoin(v, v, (2 - 2 * threshold) ** 0.5 + 1e-9, "d")
    near = found.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), F.col("datasetA.block").alias("ba"), F.col("datasetB.block").alias("bb"), "d")
    return near.filter("a < b AND ba = bb").select("a", "b", (1 - F.col("d") * F.col("d") / 2).alias("sim"))


def token_jaccard(a: Column, b: Column) -> Column:
    """|common| / |all| of two token arrays; two empty ones are equal, one empty is unlike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_pairs(texts: DataFrame, threshold: float, key: str = "id", text: str = "text") -> DataFrame:
    """(a, b, sim) of texts whose token sets reach threshold: pairs meet on a shared token, counts give the sizes."""
    sets = texts.select(F.col(key).alias("id"), F.array_distinct(F.split(F.trim(text), " +")).alias("tokens")).withColumn("n", F.size("tokens"))
    each = sets.select("id", "n", F.explode("tokens").alias("token")).filter("token <> ''")
    other = each.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), "token")
    common = each.join(other, "token").filter("id < id_b").groupBy("id", "id_b", "n", "n_b").agg(F.count("*").alias("c"))
    sim = F.col("c") / (F.col("n") + F.col("n_b") - F.col("c"))
    return common.select(F.col("id").alias("a"), F.col("id_b").alias("b"), sim.alias("sim")).filter(F.col("sim") >= threshold)


def contract(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, weight: str = "weight") -> tuple[DataFrame, DataFrame]:
    """Merge the nodes that pairs (a, b) connect; gives the merged nodes and edges. The smallest id represents a group."""
    groups = components(pairs, "a", "b")
    return merge_nodes(nodes, groups), remap_edges(edges, groups, weight)
