"""Sinks: JSON lines, tables, reports and GraphML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import safe_title, slug


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a line, whatever the row's shape."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_by_session(papers: DataFrame, path: str, conference: str = "conference", session: str = "session") -> None:
    """A folder for each conference and session, with names that are safe in paths."""
    named = papers.withColumns({conference: slug(conference), session: slug(session)})
    named.write.mode("overwrite").partitionBy(conference, session).parquet(path)


def write_article_graphs(edges: DataFrame, path: str, article: str = "article") -> None:
    """A folder of edges for each article."""
    edges.withColumn("article_name", safe_title(article)).write.mode("overwrite").partitionBy("article_name").parquet(path)


def write_split(rows: DataFrame, path: str, verified: str) -> None:
    """All rows and the verified ones, from one staged table."""
    from lectern.staging import staged

    held = staged(rows, "split")
    held.write.mode("overwrite").json(f"{path}/all")
    held.filter(F.col(verified)).write.mode("overwrite").json(f"{path}/verified")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): a GraphML document in order of `rank`; lists are joined by '|'. nodes: (id, ...), edges: (src, dst, ...)."""

    def plain(df: DataFrame, c: str):
        v = F.concat_ws("|", c) if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
        return F.replace(F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    def data(df: DataFrame, kind: str, skip: tuple[str, ...]):
        return F.concat_ws("", *[F.concat(F.lit(f'<data key="{kind}_{c}">'), plain(df, c), F.lit("</data>")) for c in df.columns if c not in skip])

    spark = nodes.sparkSession
    keys = [f'<key id="{k}_{c}" for="{k}" attr.name="{c}" attr.type="string"/>' for k, df, skip in (("node", nodes, ("id",)), ("edge", edges, ("src", "dst"))) for c in df.columns if c not in skip]
    head = spark.createDataFrame([(0, '<?xml version="1.0" encoding="utf-8"?>'), (1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), *[(2, k) for k in keys], (3, '<graph edgedefault="undirected">'), (6, "</graph>"), (7, "</graphml>")], "rank int, value string")
    n = nodes.select(F.lit(4).alias("rank"), F.concat(F.lit('<node id="'), plain(nodes, "id"), F.lit('">'), data(nodes, "node", ("id",)), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(5).alias("rank"), F.concat(F.lit('<edge source="'), plain(edges, "src"), F.lit('" target="'), plain(edges, "dst"), F.lit('">'), data(edges, "edge", ("src", "dst")), F.lit("</edge>")).alias("value"))
    return head.unionByName(n).unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML file in folder path: the format has one root, so this is for graphs that one task can write."""
    graphml_lines(nodes, edges).orderBy("rank", "value").coalesce(1).select("value").write.mode("overwrite").text(path)


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): a GEXF document in order of `rank`; columns as in graphml_lines()."""

    def plain(df: DataFrame, c: str):
        v = F.concat_ws("|", c) if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            v = F.replace(v, F.lit(sign), F.lit(name))
        return v

    def values(df: DataFrame, skip: tuple[str, ...]):
        each = F.concat_ws("", *[F.concat(F.lit(f'<attvalue for="{c}" value="'), plain(df, c), F.lit('"/>')) for c in df.columns if c not in skip])
        return F.concat(F.lit("<attvalues>"), each, F.lit("</attvalues>"))

    spark = nodes.sparkSession
    kinds = [(k, [c for c in df.columns if c not in skip]) for k, df, skip in (("node", nodes, ("id",)), ("edge", edges, ("src", "dst")))]
    keys = ["".join([f'<attributes class="{k}">', *[f'<attribute id="{c}" title="{c}" type="string"/>' for c in cs], "</attributes>"]) for k, cs in kinds]
    head = spark.createDataFrame([(0, '<?xml version="1.0" encoding="utf-8"?>'), (1, '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected">'), *[(2, k) for k in keys], (3, "<nodes>"), (5, "</nodes><edges>"), (7, "</edges></graph></gexf>")], "rank int, value string")
    n = nodes.select(F.lit(4).alias("rank"), F.concat(F.lit('<node id="'), plain(nodes, "id"), F.lit('" label="'), plain(nodes, "id"), F.lit('">'), values(nodes, ("id",)), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(6).alias("rank"), F.concat(F.lit('<edge source="'), plain(edges, "src"), F.lit('" target="'), plain(edges, "dst"), F.lit('">'), values(edges, ("src", "dst")), F.lit("</edge>")).alias("value"))
    return head.unionByName(n).unionByName(e)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GEXF file in folder path, for graphs that one task can write."""
    gexf_lines(nodes, edges).orderBy("rank", "value").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_json_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Folders nodes and edges of JSON lines: what a node-link document holds, in parts."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_variants(rows: DataFrame, path: str, variants: dict[str, dict]) -> None:
    """Two or more rows for each input row, one a variant: its columns (name to Column) over the row's; replaces path."""
    out = None
    for name, columns in variants.items():
        some = rows.withColumns(columns).withColumn("variant", F.lit(name))
        out = some if out is None else out.unionByName(some)
    if out is not None:
        out.write.mode("overwrite").json(path)


#: Kinds of artefact that parsing a document leaves.
ARTEFACTS = ("markdown", "content_list", "middle", "model", "original")


def write_artefacts(parsed: DataFrame, path: str, key: str = "path") -> None:
    """A table for each kind of artefact that is a column of parsed, below path; rows without it are left out."""
    for kind in ARTEFACTS:
        if kind in parsed.columns:
            parsed.filter(F.col(kind).isNotNull()).select(key, kind).write.mode("overwrite").parquet(f"{path}/{kind}")


def cache_misses(paths: DataFrame, cache: DataFrame, path: str = "path", key: str = "key", suffix: str = "_ori") -> DataFrame:
    """Paths whose key (sha256 of the path and a suffix) the cache table lacks; adds the key."""
    keyed = paths.withColumn(key, F.concat(F.sha2(path, 256), F.lit(suffix)))
    return keyed.join(cache.select(key), key, "left_anti")
