"""Queries of selection, lookup and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import lookup, retrieval, selection
from lectern.plans.common import BIP, bipartite, table
from lectern.plans.graph import _IMPORTANCE, scored
from lectern.plans.registry import register

_PAIRS = "pairs AS (SELECT x.title AS a1, y.title AS a2, count(*) AS common FROM bip x JOIN bip y ON x.entity = y.entity AND x.title < y.title GROUP BY 1, 2)"
_TRIPLES = "triples AS (SELECT x.title AS a1, y.title AS a2, z.title AS a3, count(*) AS common FROM bip x JOIN bip y ON x.entity = y.entity AND x.title < y.title JOIN bip z ON z.entity = y.entity AND y.title < z.title GROUP BY 1, 2, 3)"


@register("article_pairs", f"WITH {BIP}, {_PAIRS} SELECT * FROM pairs WHERE common >= 2")
def article_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.article_pairs(bipartite(spark, sf_dir), 2)


@register("combo_overlap_k2", f"WITH {BIP}, {_PAIRS} SELECT * FROM pairs WHERE common >= 3")
def combo_overlap_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.combinations(bipartite(spark, sf_dir), 2, 3)


@register("combo_overlap_k3", f"WITH {BIP}, {_TRIPLES} SELECT * FROM triples WHERE common >= 2")
def combo_overlap_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.combinations(bipartite(spark, sf_dir), 3, 2)


@register("combo_fpgrowth", f"WITH {BIP}, {_TRIPLES} SELECT * FROM triples WHERE common >= 2")
def combo_fpgrowth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.combinations_fpgrowth(bipartite(spark, sf_dir), 3, 2)


_PAIRWISE = """top AS (SELECT a1, a2 FROM pairs WHERE common >= 2 ORDER BY common DESC, a1, a2 LIMIT 50),
    third AS (SELECT t.a1, t.a2, z.title AS a3, count(*) AS common FROM top t JOIN bip x ON x.title = t.a1 JOIN bip y ON y.title = t.a2 AND y.entity = x.entity JOIN bip z ON z.entity = x.entity AND z.title <> t.a1 AND z.title <> t.a2
              GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    pw AS (SELECT DISTINCT list_sort([a1, a2, a3])[1] AS a1, list_sort([a1, a2, a3])[2] AS a2, list_sort([a1, a2, a3])[3] AS a3, common FROM third)"""


@register("combo_pairwise", f"WITH {BIP}, {_PAIRS}, {_PAIRWISE} SELECT * FROM pw")
def combo_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pairwise_expansion(bipartite(spark, sf_dir), 2)


@register("combo_union_dedup", f"WITH {BIP}, {_PAIRS}, {_TRIPLES}, {_PAIRWISE}, one AS (SELECT * FROM triples WHERE common >= 3) SELECT *, 1 AS method FROM one UNION ALL SELECT pw.*, 2 FROM pw ANTI JOIN one USING (a1, a2, a3)")
def combo_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bipartite(spark, sf_dir)
    return selection.union_first(selection.combinations(b, 3, 3), selection.pairwise_expansion(b, 2), ["a1", "a2", "a3"])


_QUALITY = f"""{_IMPORTANCE}, {_PAIRS}, rich AS (SELECT title, count(*) AS n FROM bip GROUP BY 1),
    q AS (SELECT p.a1, p.a2, p.common, round(0.4 * 2 * p.common + 0.3 * avg(coalesce(importance, 1)) + 0.2 * (any_value(r.n) + any_value(s.n)) / 2 + 0.1 * p.common / (any_value(r.n) + any_value(s.n) - p.common), 6) AS quality_score
          FROM pairs p JOIN bip x ON x.title = p.a1 JOIN bip y ON y.title = p.a2 AND x.entity = y.entity LEFT JOIN imp ON imp.id = x.entity JOIN rich r ON r.title = p.a1 JOIN rich s ON s.title = p.a2
          WHERE p.common >= 3 GROUP BY p.a1, p.a2, p.common)"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bipartite(spark, sf_dir)
    scores = scored(spark, sf_dir).select(F.col("id").alias("entity"), "importance")
    return selection.quality(selection.article_pairs(b, 3), b, scores).withColumn("quality_score", F.round("quality_score", 6))


@register("combo_quality", f"WITH {_QUALITY} SELECT * FROM q")
def combo_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir)


@register("topk_quality", f"WITH {_QUALITY} SELECT * FROM q ORDER BY quality_score DESC, a1, a2 LIMIT 20")
def topk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).orderBy(F.col("quality_score").desc(), "a1", "a2").limit(20)


@register("combo_entity_details", f"WITH {_IMPORTANCE}, {_PAIRS} SELECT p.a1, p.a2, x.entity, imp.node_type, imp.frequency, imp.importance FROM pairs p JOIN bip x ON x.title = p.a1 JOIN bip y ON y.title = p.a2 AND x.entity = y.entity JOIN imp ON imp.id = x.entity WHERE p.common >= 3")
def combo_entity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bipartite(spark, sf_dir)
    return selection.entity_details(selection.article_pairs(b, 3), b, scored(spark, sf_dir))



@register(
    "walk_cooccurrence",
    """WITH w AS (SELECT o_custkey AS walk, 'S' || l_suppkey AS title, 'P' || l_partkey AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45)
       SELECT DISTINCT a.title, b.entity FROM (SELECT DISTINCT walk, title FROM w) a JOIN (SELECT DISTINCT walk, entity FROM w) b ON a.walk = b.walk""",
)
def walk_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("walk"))
    w = lines.join(o, "l_orderkey").select("walk", F.explode(F.array(F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey"))).alias("id"))
    return selection.walk_sets(w, F.col("id").startswith("S"))


_TITLES = "titles AS (SELECT p_partkey, p_name AS title FROM part)"


@register(
    "title_lookup_exact",
    f"""WITH {_TITLES}, last AS (SELECT lower(trim(title)) AS k, max(p_partkey) AS found FROM titles GROUP BY 1), q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE ' ' || upper(p_name) || ' ' END AS query FROM supplier JOIN part ON p_partkey = s_suppkey)
        SELECT s_suppkey, query, found FROM q LEFT JOIN last ON k = lower(trim(query))""",
)
def title_lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    q = table(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))).alias("query"))
    titles = part.select(F.col("p_partkey").alias("found"), F.col("p_name").alias("title"))
    return lookup.exact(q, "query", titles, "title", "found").select("s_suppkey", "query", "found")


_WORDS = "q AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS query FROM part)"


@register("title_lookup_fuzzy", f"WITH {_WORDS} SELECT query, min(p_partkey) AS found FROM q JOIN part ON contains(lower(trim(p_name)), lower(trim(query))) OR contains(lower(trim(query)), lower(trim(p_name))) GROUP BY 1")
def title_lookup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    q = part.select(F.explode(F.split("p_name", " ")).alias("query")).distinct()
    return lookup.containing(q, "query", part.select(F.col("p_partkey").alias("found"), F.col("p_name").alias("title")), "title", "found").select("query", "found")


@register("title_search", f"WITH {_WORDS}, t AS (SELECT DISTINCT p_name AS title FROM part) SELECT query, title, CAST(r AS INTEGER) AS rank FROM (SELECT query, title, row_number() OVER (PARTITION BY query ORDER BY title) AS r FROM q JOIN t ON contains(lower(title), lower(query))) WHERE r <= 5")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"))
    return lookup.search(part.select(F.explode(F.split("title", " ")).alias("query")), "query", part, "title")


_GROUPS = """grp AS (SELECT o_orderkey, l_linenumber AS pos, s_name AS title FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey),
    known AS (SELECT s_name AS title, CASE WHEN s_suppkey % 5 = 4 THEN 'ftp://x/' || s_suppkey ELSE 'http://papers.example/' || s_suppkey || '.pdf' END AS link FROM supplier WHERE s_suppkey % 3 <> 0)"""


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("title"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"), "l_linenumber").join(s, "s_suppkey")
    lists = lines.groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "title"))), lambda x: x["title"]).alias("titles"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    link = F.when(F.col("s_suppkey") % 5 == 4, F.concat(F.lit("ftp://x/"), "s_suppkey")).otherwise(F.concat(F.lit("http://papers.example/"), "s_suppkey", F.lit(".pdf")))
    return orders.join(lists, "o_orderkey"), s.filter("s_suppkey % 3 <> 0").select("title", link.alias("link"))


@register("link_join_placeholder", f"WITH {_GROUPS} SELECT o_orderkey, string_agg(coalesce(link, 'placeholder_link_for_' || replace(grp.title, ' ', '_') || '.pdf'), '|' ORDER BY pos, grp.title) AS links FROM grp LEFT JOIN known ON grp.title = known.title GROUP BY 1")
def link_join_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, known = _groups(spark, sf_dir)
    return lookup.links(groups, "o_orderkey", "titles", known, "title", "link")


@register("link_join_inner", f"WITH {_GROUPS}, k AS (SELECT o_orderkey, link, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos, grp.title) AS r FROM grp JOIN known ON grp.title = known.title WHERE starts_with(link, 'http')) SELECT o_orderkey, string_agg(link, '|' ORDER BY r) AS links FROM k WHERE r <= 5 GROUP BY 1")
def link_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, known = _groups(spark, sf_dir)
    return lookup.links(groups, "o_orderkey", "titles", known, "title", "link", inner=True, limit=5)


@register(
    "gold_docs",
    """WITH q AS (SELECT item_id, unnest([item_id * 3, item_id * 5 + 1, 1000000 + item_id]) AS ref, unnest([0, 1, 2]) AS pos FROM benchmark)
       SELECT item_id, count(*) AS n_docs, string_agg(coalesce(text, 'Document not found: ' || ref), chr(10) ORDER BY pos) AS body FROM q LEFT JOIN documents ON doc_id = ref GROUP BY 1""",
)
def gold_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array(i * 3, i * 5 + 1, i + 1000000).alias("refs"))
    return lookup.ordered_documents(q, "item_id", "refs", table(spark, sf_dir, "documents"), "doc_id", "text")


_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


@register("vector_topk", f"SELECT query_id, vec_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON true WHERE q.label = 0) WHERE r <= 3")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("label = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.top_k(q, e, 3, "vec_id", "embedding").withColumn("score", F.round("score", 6))


def _chunk_sql(where: str = "true") -> str:
    return f"""ch AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, substr(text, CAST(pos * 400 + 1 AS BIGINT), 500) AS chunk FROM
        (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(ceil((length(text) - 100) / 400) AS BIGINT) END)) AS pos FROM documents WHERE length(text) > 0 AND {where}))"""


@register("chunk_documents", f"WITH {_chunk_sql()} SELECT doc_id, pos, chunk FROM ch")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


_TOKENS = ["the", "that", "der", "que", "des"]
_OVERLAP = "len(list_intersect(list_distinct(regexp_split_to_array(lower(chunk), '[ \\n]+')), ['the', 'that', 'der', 'que', 'des']))"


@register(
    "chunk_rerank",
    f"""WITH {_chunk_sql('length(text) > 10000')}, s AS (SELECT *, {_OVERLAP} AS score FROM ch),
            b AS (SELECT *, coalesce(sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
        SELECT doc_id, text AS content FROM documents WHERE length(text) <= 10000
        UNION ALL SELECT doc_id, string_agg(substr(chunk, 1, CAST(10000 - before AS BIGINT)), ' ' ORDER BY pos) FROM b WHERE before < 10000 GROUP BY 1""",
)
def chunk_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(table(spark, sf_dir, "documents"), "doc_id", "text", retrieval.token_overlap(_TOKENS))


@register(
    "budget_fill",
    f"""WITH {_chunk_sql()}, b AS (SELECT *, coalesce(sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY length(chunk) DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ch)
        SELECT doc_id, pos, substr(chunk, 1, CAST(1200 - before AS BIGINT)) AS chunk FROM b WHERE before < 1200""",
)
def budget_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = retrieval.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return retrieval.within_budget(pieces, "doc_id", [F.length("chunk").desc(), "pos"], "chunk", 1200)


@register("equal_share_truncate", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:CAST(100000 // (SELECT count(*) FROM documents) AS BIGINT)], ' ') AS content FROM documents")
def equal_share_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.equal_share(table(spark, sf_dir, "documents"), "doc_id", "text", 100_000)
