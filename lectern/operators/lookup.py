"""Title lookups and link joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(title: Column | str) -> Column:
    return F.lower(F.trim(title))


def last_by_key(titles: DataFrame, title: str, order: str) -> DataFrame:
    """One row for each normalised title, the last by order; adds _key."""
    keyed = titles.withColumn("_key", normalised(title))
    picked = keyed.groupBy("_key").agg(F.max_by(F.struct(*titles.columns), F.col(order)).alias("_row"))
    return picked.select("_key", *[F.col("_row")[c].alias(c) for c in titles.columns])


def exact(queries: DataFrame, query: str, titles: DataFrame, title: str, order: str) -> DataFrame:
    """Each query with the columns of the last title that equals it, normalised; null where none does."""
    found = last_by_key(titles, title, order)
    return queries.withColumn("_key", normalised(query)).join(found, "_key", "left").drop("_key")


def containing(queries: DataFrame, query: str, titles: DataFrame, title: str, order: str) -> DataFrame:
    """Each query with the first title by order that it contains or that contains it, normalised.

    This has no key to join on; give it the queries that exact() left, and titles of a bounded size.
    """
    q, k = normalised(query), normalised(title)
    pairs = queries.select(query).distinct().join(titles, F.contains(k, q) | F.contains(q, k))
    cols = titles.columns
    first = pairs.groupBy(query).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_row"))
    return first.select(query, *[F.col("_row")[c].alias(c) for c in cols])


def search(queries: DataFrame, query: str, titles: DataFrame, title: str, limit: int = 5) -> DataFrame:
    """(query, title, rank): the first `limit` titles in order that contain the query."""
    hits = queries.select(query).distinct().join(titles.select(title).distinct(), F.contains(normalised(title), normalised(query)))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(title))).filter(F.col("rank") <= limit)


def placeholder(title: Column | str) -> Column:
    return F.concat(F.lit("placeholder_link_for_"), F.replace(title, F.lit(" "), F.lit("_")), F.lit(".pdf"))


def links(groups: DataFrame, group: str, titles: str, known: DataFrame, title: str, link: str, inner: bool = False, limit: int | None = None) -> DataFrame:
    """(group, links): the links of a title list in its order, joined by '|'.

    Unknown titles get a placeholder, or with inner are left out, as are links that aren't http; then `limit` holds.
    """
    each = groups.select(group, F.posexplode(titles).alias("pos", "_title"))
    joined = each.join(known.select(F.col(title).alias("_title"), F.col(link).alias("_link")), "_title", "inner" if inner else "left")
    if inner:
        joined = joined.filter(F.col("_link").startswith("http"))
    out = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_link", placeholder("_title")).alias("l")))), lambda x: x["l"])
    out = F.slice(out, 1, limit) if limit else out
    return joined.groupBy(group).agg(F.array_join(out, "|").alias("links"))


def ordered_documents(questions: DataFrame, question: str, refs: str, documents: DataFrame, key: str, text: str, missing: str = "Document not found: ") -> DataFrame:
    """(question, n_docs, body): the documents that a question lists, in its order; a missing one gives a message."""
    each = questions.select(question, F.posexplode(refs).alias("pos", "_ref"))
    joined = each.join(documents.select(F.col(key).alias("_ref"), F.col(text).alias("_text")), "_ref", "left")
    body = F.coalesce("_text", F.concat(F.lit(missing), F.col("_ref").cast("string")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("b")))), lambda x: x["b"])
    return joined.groupBy(question).agg(F.count("*").alias("n_docs"), F.array_join(parts, "\n").alias("body"))
