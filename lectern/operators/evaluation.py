"""Scores of answers, their summaries, verification and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalise


def exact_match(prediction: Column | str, gold: Column | str) -> Column:
    return F.when(F.trim(normalise(prediction)) == F.trim(normalise(gold)), 1.0).otherwise(0.0)


def ranking_scores(ranked: DataFrame, gold: DataFrame, query: str, item: str, k: int = 5) -> DataFrame:
    """(query, recall, ndcg) at k; ranked: (query, item, rank from 1), gold: (query, item). Queries without a hit get 0."""
    g = gold.select(query, item).distinct()
    sizes = g.groupBy(query).agg(F.count("*").alias("_n"))
    hits = ranked.filter(F.col("rank") <= k).join(g, [query, item], "left_semi").groupBy(query).agg(F.count("*").alias("_hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return sizes.join(hits, query, "left").select(query, (F.coalesce("_hits", F.lit(0)) / F.col("_n")).alias("recall"), (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def reasoning_summary(scores: DataFrame, *keys: str) -> DataFrame:
    """total, valid, correct_count and accuracy in percent; rows with an error are not valid."""
    ok = F.col("error").isNull()
    return scores.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(ok & (F.col("score") >= 1.0)).alias("correct_count"),
        F.round(100 * F.coalesce(F.avg(F.when(ok, F.col("score"))), F.lit(0.0)), 4).alias("accuracy"),
    )


def mean_summary(scores: DataFrame, dims: list[str], scale: float, average: str, *keys: str) -> DataFrame:
    """The valid rows' mean of each dimension times scale, and the mean of those; 0 where none is valid."""
    ok = F.col("error").isNull()
    means = {d: F.coalesce(F.avg(F.when(ok, F.col(d))), F.lit(0.0)) * scale for d in dims}
    return scores.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid"), *[F.round(m, 4).alias(f"avg_{d}") for d, m in means.items()], F.round(sum(means.values()) / len(dims), 4).alias(average)
    )


def verification(rows: DataFrame, verified: str, confidence: str) -> DataFrame:
    """(confidence, n, n_verified, share): and one row 'all' over every row; share in percent of all rows."""
    by = rows.groupBy(F.col(confidence).alias("confidence")).agg(F.count("*").alias("n"), F.count_if(F.col(verified)).alias("n_verified"))
    every = by.agg(F.lit("all").alias("confidence"), F.sum("n").alias("n"), F.sum("n_verified").alias("n_verified"))
    both = by.unionByName(every)
    return both.withColumn("share", F.round(100.0 * F.col("n_verified") / F.greatest(F.col("n"), F.lit(1)), 1))


def phase_summary(samples: DataFrame, phase: str, ts: str, memory: str) -> DataFrame:
    """duration in seconds, peak, mean and change of memory, and number of samples of each phase."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return samples.groupBy(phase).agg(
        F.count("*").alias("samples"), F.round((F.max(t) - F.min(t)) / 1e6, 3).alias("duration"), F.max(memory).alias("peak_memory"), F.round(F.avg(memory), 6).alias("avg_memory"),
        F.round(F.max_by(memory, F.struct(t, memory)) - F.min_by(memory, F.struct(t, memory)), 6).alias("memory_delta"),
    )


def islands(df: DataFrame, changed: Column, name: str, order: list, *keys: str) -> DataFrame:
    """Adds a number that goes up by one at each row where `changed` holds, from 0 at the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(changed, 1).otherwise(0)).over(w))


def page_groups(rows: DataFrame, key: str, order: str, page: str, text: str) -> DataFrame:
    """(key, grp, page, n, content): consecutive rows of one page together; a page that comes back is a new group."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_prev", F.lag(page).over(w))
    numbered = islands(marked, F.col("_prev").isNotNull() & (F.col("_prev") != F.col(page)), "grp", [order], key)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return numbered.groupBy(key, "grp", page).agg(F.count("*").alias("n"), F.array_join(parts, "\n").alias("content"))


def merge_paragraphs(rows: DataFrame, key: str, order: str, size: str, height: str, text: str) -> DataFrame:
    """(key, grp, n, content): a paragraph joins the one before if font sizes differ by less than 2 and it is less than size + 1 high."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_prev", F.lag(size).over(w))
    joins = (F.abs(F.col(size) - F.col("_prev")) < 2) & (F.col(height) < F.col(size) + 1)
    numbered = islands(marked, F.col("_prev").isNotNull() & ~joins, "grp", [order], key)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return numbered.groupBy(key, "grp").agg(F.count("*").alias("n"), F.array_join(parts, " ").alias("content"))


def outside_boxes(texts: DataFrame, boxes: DataFrame, page: str = "page") -> DataFrame:
    """Texts (x0, y0, x1, y1) that lie in no box of their page; boxes have the same columns."""
    b = boxes.select(F.col(page).alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = (F.col(page) == F.col("_p")) & (F.col("x0") >= F.col("_x0")) & (F.col("y0") >= F.col("_y0")) & (F.col("x1") <= F.col("_x1")) & (F.col("y1") <= F.col("_y1"))
    return texts.join(b, inside, "left_anti")


def parsed_hits(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, hit, title, url, description, date) from lines of the form `[i] Field: value`; other lines are ignored."""
    pattern = r"^\[([0-9]+)\] (Title|URL Source|Description|Date): (.*)$"
    parts = lines.select(key, order, F.regexp_extract(line, pattern, 1).alias("i"), F.regexp_extract(line, pattern, 2).alias("field"), F.regexp_extract(line, pattern, 3).alias("value")).filter("i <> ''")

    def first(field: str) -> Column:
        return F.coalesce(F.min_by(F.when(F.col("field") == field, F.col("value")), F.when(F.col("field") == field, F.col(order))), F.lit(""))

    return parts.groupBy(key, F.col("i").cast("long").alias("hit")).agg(first("Title").alias("title"), first("URL Source").alias("url"), first("Description").alias("description"), first("Date").alias("date"))
