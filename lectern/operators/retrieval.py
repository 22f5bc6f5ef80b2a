"""Text chunks, vector search and reranking under a length budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.vectors import nearest


def chunks(documents: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """(key, pos, chunk): pieces of `size` characters that overlap; the last one ends the text. Null and empty texts give none."""
    n, step = F.length(text), size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step).cast("int"))
    pos = F.explode(F.sequence(F.lit(0), count - 1)).alias("pos")
    return documents.filter(F.length(text) > 0).select(key, text, pos).select(key, "pos", F.substring(F.col(text), F.col("pos") * step + 1, F.lit(size)).alias("chunk"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, key: str, vector: str, query_key: str = "query_id") -> DataFrame:
    """(query_key, key, score, rank): the k best of corpus by inner product for each query; ties to the smaller key.

    Either may be large: tiles of queries meet tiles of the corpus.
    """
    q, c = (d.select(F.col(name).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(0).alias("block")) for d, name in ((queries, query_key), (corpus, key)))
    return nearest(q, c, k, own=True).select(F.col("id").alias(query_key), F.col("nbr").alias(key), F.col("sim").alias("score"), "rank")


def within_budget(scored: DataFrame, key: str, order: list, text: str, budget: int) -> DataFrame:
    """Rows by order until their texts reach the budget; the one that passes it is cut, what follows is dropped."""
    n = F.length(text)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(n).over(w), F.lit(0))
    kept = scored.withColumn("_before", before).filter(F.col("_before") < budget)
    return kept.withColumn(text, F.substring(F.col(text), F.lit(1), (budget - F.col("_before")).cast("int"))).drop("_before")


def rerank(documents: DataFrame, key: str, text: str, score, budget: int = 10_000, size: int = 500, overlap: int = 100) -> DataFrame:
    """(key, content): texts up to the budget as they are; longer ones as their best chunks, in text order, joined by a space.

    score: Column -> Column over a chunk.
    """
    short = documents.filter(F.length(text) <= budget).select(key, F.col(text).alias("content"))
    pieces = chunks(documents.filter(F.length(text) > budget), key, text, size, overlap).withColumn("score", score(F.col("chunk")))
    best = within_budget(pieces, key, [F.col("score").desc(), "pos"], "chunk", budget)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"])
    return short.unionByName(best.groupBy(key).agg(F.array_join(parts, " ").alias("content")))


def token_overlap(tokens: list[str]):
    """A score for rerank(): how many of some words a chunk holds."""

    def score(chunk: Column) -> Column:
        words = F.split(F.lower(chunk), "[ \n]+")
        return F.size(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, tokens))))

    return score


def equal_share(documents: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, content): each text cut to floor(budget / number of texts) words."""
    share = F.floor(F.lit(budget) / F.greatest(F.count("*"), F.lit(1))).cast("int").alias("_share")
    n = documents.agg(share)
    return documents.crossJoin(F.broadcast(n)).select(key, F.array_join(F.slice(F.split(text, " "), F.lit(1), F.greatest(F.col("_share"), F.lit(0))), " ").alias("content"))
