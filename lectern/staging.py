"""Cutting lineage: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; it is removed when the interpreter ends."""
    sc = spark.sparkContext
    if sc.applicationId in _roots:
        return _roots[sc.applicationId]
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        sc.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/lectern-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
    _roots[sc.applicationId] = root

    def drop() -> None:
        try:
            path = sc._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may have gone before the interpreter ends
            pass

    atexit.register(drop)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder, with options of the writer, and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
