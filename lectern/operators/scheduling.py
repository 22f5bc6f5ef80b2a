"""Scheduling work: splits, rollouts, sticky assignment, resuming, first-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order (unique within a key); a partial aggregate, not a sort of each group."""
    cols = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in cols]).select(*df.columns)


def numbered(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Adds the place of each row by order, from 0: sorted partitions count on from those before, in no single task."""
    from lectern.staging import staged

    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    local = staged(ranged.withColumn("_id", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_id", "_part", "_at", "_before")


def split(df: DataFrame, parts: int, order: str) -> DataFrame:
    """Adds worker: contiguous blocks of ceil(n / parts) rows by order, workers from 1."""
    n = df.count()
    block = max(1, -(-n // parts))
    return numbered(df, order, "_n").withColumn("worker", (F.floor(F.col("_n") / block) + 1).cast("long")).drop("_n")


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """Adds batch: blocks of `size` rows by order, from 0."""
    return numbered(df, order, "_n").withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def sticky_round_robin(tasks: DataFrame, key: str, order: str, slots: int) -> DataFrame:
    """Adds slot: the k-th key to appear, by order, always gets slot k mod slots."""
    firsts = tasks.groupBy(key).agg(F.min(order).alias("_first"))
    slotted = numbered(firsts, "_first", "_k").select(key, (F.col("_k") % slots).cast("long").alias("slot"))
    return tasks.join(slotted, key)


def expand(items: DataFrame, values: list, name: str) -> DataFrame:
    """Each row once for each value."""
    return items.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def pending(tasks: DataFrame, done: DataFrame, keys: list[str], error: str | None = None) -> DataFrame:
    """Tasks that no done row has by keys; done rows with an error don't count."""
    ok = done if error is None else done.filter(F.col(error).isNull())
    return tasks.join(ok.select(*keys).distinct(), keys, "left_anti")
