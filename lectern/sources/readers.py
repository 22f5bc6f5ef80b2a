"""Scans: JSON lines, metadata trees, corpora, graphs, stop words and tables.

Schemas are given, not inferred. Paths may be in any file system that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Array columns of an entity record.
ENTITY_LISTS = ("research_background", "classification_tags", "key_contributions", "methodology", "datasets", "results", "metrics", "figure", "table", "algorithm", "formulas", "limitations")
ENTITIES = T.StructType([T.StructField("title", T.StringType()), *[T.StructField(c, T.ArrayType(T.StringType())) for c in ENTITY_LISTS]])
METADATA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "session", "pdf_link")])
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "tiff")


def strict_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a line that doesn't parse ends the read with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines; blank and broken lines are skipped, and rows that lack a required value."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for c in required:
        rows = rows.filter(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return rows


def counted_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """tolerant_lines with what was broken in `_corrupt_record` (null where a line is fine)."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)


def directory_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All *.jsonl files directly in a folder."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").json(path)


def by_extension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """.json holds a list of objects, .jsonl one object a line; anything else is an error."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def from_line(lines: DataFrame, order: str, skip: int) -> DataFrame:
    """Rows whose place by `order` is past the first `skip`."""
    from lectern.operators.scheduling import numbered

    return numbered(lines, order, "_n").filter(F.col("_n") >= skip).drop("_n")


def metadata_tree(spark: SparkSession, path: str, prune: tuple[str, ...] = ("paper_map", "results")) -> DataFrame:
    """(title, paper_path, metadata_path, id, session, pdf_link) of every metadata.json below path that has a title.

    Files that lie directly in a folder of a pruned name are left out.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").text(path)
    rows = files.select(F.col("_metadata.file_path").alias("metadata_path"), F.from_json("value", METADATA).alias("m"))
    folder = F.regexp_replace("metadata_path", "/[^/]*$", "")
    kept = rows.filter(~F.element_at(F.split(folder, "/"), -1).isin(*prune) & (F.trim(F.col("m.title")) != ""))
    return kept.select("m.title", folder.alias("paper_path"), "metadata_path", "m.id", "m.session", "m.pdf_link")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, conference, paper_id, file_type, file_path, text, image): markdown and images at least three folders deep."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md," + ",".join(IMAGES) + "}").load(path)
    base = F.lit(path.rstrip("/").split(":")[-1].lstrip("/"))
    inner = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), F.concat(F.lit("^"), base, F.lit("/")), "")
    parts = files.select("path", "content", F.split(inner, "/").alias("p")).filter(F.size("p") >= 3)
    kind = F.lower(F.regexp_extract(F.element_at("p", -1), r"\.([^.]+)$", 1))
    key = F.concat_ws("/", F.col("p")[0], F.col("p")[1])
    is_text = kind == "md"
    return parts.select(
        F.when(is_text, key).otherwise(F.concat(key, F.lit("/images/"), F.element_at("p", -1))).alias("doc_key"), F.col("p")[0].alias("conference"), F.col("p")[1].alias("paper_id"), kind.alias("file_type"),
        F.col("path").alias("file_path"), F.when(is_text, F.decode("content", "UTF-8")).alias("text"), F.when(~is_text, F.col("content")).alias("image"),
    )


_DATA = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_VALUE", T.StringType())]))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: (id, attributes map) and (src, dst, attributes map), attributes by name."""
    if not path.endswith((".graphml", ".xml")):
        raise ValueError(f"not a GraphML file: {path}")
    keys_schema = T.StructType([T.StructField(c, T.StringType()) for c in ("_id", "_attr.name", "_for")])
    read = spark.read.format("xml")
    names = F.broadcast(read.option("rowTag", "key").schema(keys_schema).load(path).select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name")))

    def named(rows: DataFrame, *ids: str) -> DataFrame:
        each = rows.select(*ids, F.explode_outer("data").alias("d")).select(*ids, F.col("d._key").alias("k"), F.col("d._VALUE").alias("v")).join(names, "k", "left")
        pairs = F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "v"))))
        return each.groupBy(*ids).agg(pairs.alias("attributes"))

    nodes = read.option("rowTag", "node").schema(T.StructType([T.StructField("_id", T.StringType()), T.StructField("data", _DATA)])).load(path).withColumnRenamed("_id", "id")
    edge_schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()), T.StructField("data", _DATA)])
    edges = read.option("rowTag", "edge").schema(edge_schema).load(path).withColumnsRenamed({"_source": "src", "_target": "dst"})
    return named(nodes, "id"), named(edges, "src", "dst")


def gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GEXF file, as graphml() gives them; a node's label and an edge's weight are attributes too."""
    if not path.endswith((".gexf", ".xml")):
        raise ValueError(f"not a GEXF file: {path}")
    text = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
    read = spark.read.format("xml")
    names = F.broadcast(read.option("rowTag", "attribute").schema(text("_id", "_title")).load(path).select(F.col("_id").alias("k"), F.col("_title").alias("name")).distinct())
    values = T.StructField("attvalues", T.StructType([T.StructField("attvalue", T.ArrayType(text("_for", "_value")))]))

    def named(rows: DataFrame, own: dict[str, str], *ids: str) -> DataFrame:
        each = rows.select(*ids, *own, F.explode_outer("attvalues.attvalue").alias("d")).select(*ids, *own, F.col("d._for").alias("k"), F.col("d._value").alias("v")).join(names, "k", "left")
        pairs = F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "v"))))
        extra = F.create_map(*[x for c, name in own.items() for x in (F.lit(name), F.col(c))])
        out = each.groupBy(*ids, *own).agg(pairs.alias("a"))
        return out.select(*ids, F.map_concat(F.map_filter(extra, lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys("a"), k)), "a").alias("attributes"))

    node = T.StructType([*text("_id", "_label").fields, values])
    edge = T.StructType([*text("_source", "_target", "_weight").fields, values])
    nodes = read.option("rowTag", "node").schema(node).load(path).withColumnRenamed("_id", "id")
    edges = read.option("rowTag", "edge").schema(edge).load(path).withColumnsRenamed({"_source": "src", "_target": "dst"})
    return named(nodes, {"_label": "label"}, "id"), named(edges, {"_weight": "weight"}, "src", "dst")


def graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """graphml() or gexf() by the path's ending; any other is an error."""
    if path.endswith(".gexf"):
        return gexf(spark, path)
    return graphml(spark, path)


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word): trimmed lower-case lines that are neither blank nor comments (#)."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    return lines.filter((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def tabular(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def probe(df: DataFrame, sample: int = 3) -> dict:
    """Columns with types, a few rows and the number of rows."""
    return {"columns": dict(df.dtypes), "sample": [r.asDict() for r in df.limit(sample).collect()], "rows": df.count()}


def results_tree(spark: SparkSession, path: str, schema: T.StructType, first_only: bool = False) -> DataFrame:
    """Rows of results/<model>/<type_x>/*.jsonl with model and question_type; first_only keeps each folder's first file."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path).withColumn("_file", F.col("_metadata.file_path"))
    parts: Column = F.split("_file", "/")
    out = rows.withColumns({"model": F.element_at(parts, -3), "question_type": F.split_part(F.element_at(parts, -2), F.lit("_"), F.lit(1))})
    if first_only:
        first = out.groupBy("model", "question_type").agg(F.min("_file").alias("_file"))
        out = out.join(F.broadcast(first), ["model", "question_type", "_file"], "left_semi")
    return out.drop("_file")


def last_per_question(knowledge: DataFrame, question: str, order: str) -> DataFrame:
    """One row for each question, the last by order."""
    picked = knowledge.groupBy(question).agg(F.max_by(F.struct(*knowledge.columns), F.col(order)).alias("_row"))
    return picked.select(*[F.col("_row")[c].alias(c) for c in knowledge.columns])
