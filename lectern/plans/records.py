"""Queries of the record operators: nested fields, flattened results, totals, progress, reports, walk-based selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import graph, iterative, records, selection
from lectern.operators.components import components
from lectern.plans.common import NODES, bipartite, graph_edges, nodes, table
from lectern.plans.registry import register


@register(
    "nested_projection",
    """SELECT conv_id, array_to_string(list_transform(list_filter(l, lambda x: x.role = 'user' AND x.text <> ''), lambda x: x.text), '|') AS users, len(list_filter(l, lambda x: x.role = 'assistant' AND x.text <> '')) AS assistants
       FROM (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS l FROM conversations GROUP BY 1)""",
)
def nested_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("type"), x["text"].alias("interpretation")))
    papers = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(items.alias("items"))
    return papers.select("conv_id", F.array_join(records.typed_items(F.col("items"), "user"), "|").alias("users"), F.size(records.typed_items(F.col("items"), "assistant")).cast("long").alias("assistants"))


_PATHS = "f AS (SELECT page_id, html, CASE page_id % 6 WHEN 0 THEN '/data/a b.PDF' WHEN 1 THEN url WHEN 2 THEN '/data/p' || page_id WHEN 3 THEN 'https://x.org/y/z.jsonl?q=1' WHEN 4 THEN '/img/a.png' ELSE 'http://x.org/paper' END AS path, CASE WHEN page_id % 12 = 5 THEN 'application/pdf; q' ELSE '' END AS mime FROM pages)"


@register(
    "file_kinds",
    f"""WITH {_PATHS}, e AS (SELECT *, lower(regexp_extract(regexp_extract(regexp_replace(regexp_replace(path, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '([^/]*)$', 1), '([^.]*)$', 1)) AS ending FROM f)
        SELECT page_id, CASE WHEN regexp_matches(lower(path), '(jpg|jpeg|png|gif|bmp|webp|tiff)$') THEN 'image' WHEN ending IN {T.KINDS} THEN ending
          WHEN path LIKE 'http://%' OR path LIKE 'https://%' THEN CASE WHEN contains(mime, 'application/pdf') THEN 'pdf' ELSE 'html' END
          WHEN regexp_matches(html, '<(p|span|div|li|html|script)[^>]*?') THEN 'html' ELSE 'txt' END AS kind FROM e""",
)
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    path = F.when(i % 6 == 0, "/data/a b.PDF").when(i % 6 == 1, F.col("url")).when(i % 6 == 2, F.concat(F.lit("/data/p"), i)).when(i % 6 == 3, "https://x.org/y/z.jsonl?q=1").when(i % 6 == 4, "/img/a.png").otherwise("http://x.org/paper")
    mime = F.when(i % 12 == 5, "application/pdf; q").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", T.file_kind(path, mime, F.col("html")).alias("kind"))


@register(
    "question_extract",
    "SELECT conv_id, turn, role, nullif(coalesce(nullif(trim(CASE WHEN turn % 3 = 0 THEN '  ' WHEN turn % 3 = 1 THEN ' q' || conv_id || ' ' END), ''), CASE WHEN conv_id % 2 = 0 THEN trim(split_part('head User:' || text || 'User: x', 'User:', 2)) ELSE text END), '') AS question FROM conversations",
)
def question_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = F.when(F.col("turn") % 3 == 0, "  ").when(F.col("turn") % 3 == 1, F.concat(F.lit(" q"), "conv_id", F.lit(" ")))
    message = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("head User:"), "text", F.lit("User: x"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.question_of(question, message).alias("question"))


@register("extra_keys", "SELECT c_custkey, 'c_mktsegment=' || c_mktsegment || '|c_name=' || c_name || CASE WHEN c_nationkey % 2 = 0 THEN '|c_nationkey=' || c_nationkey ELSE '' END AS extra FROM customer")
def extra_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment")
    pairs = F.transform(F.array_sort(F.map_entries("extra")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return records.with_extra(c, ["c_custkey"]).select("c_custkey", F.array_join(pairs, "|").alias("extra"))


@register("truthy_titles", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '|' ELSE '' END || p_type AS titles FROM part")
def truthy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.lit(None).cast("string"), F.col("p_type"), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.truthy(given), "|").alias("titles"))


@register("flatten_result", "SELECT conv_id, string_agg(CASE WHEN turn % 3 = 2 THEN 'table ' || turn ELSE text END, chr(10) ORDER BY turn, role, text) AS content FROM conversations GROUP BY 1")
def flatten_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.array(F.struct(F.when(x["turn"] % 3 != 2, x["text"]).alias("text"), F.concat(F.lit("table "), x["turn"].cast("string")).alias("table"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(each.alias("pages")).select("conv_id", records.flattened(F.col("pages")).alias("content"))


@register(
    "search_hit_text",
    "SELECT page_id, '[' || page_id || '] Title: page ' || page_id || chr(10) || '    URL: ' || url || CASE WHEN page_id % 2 = 0 AND html <> '' THEN chr(10) || '    Summary: ' || substr(html, 1, 300) ELSE '' END || CASE WHEN page_id % 3 = 0 THEN chr(10) || '    Date: 2024' ELSE '' END || chr(10) AS hit FROM pages",
)
def search_hit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    hit = T.rendered_hit(i, F.concat(F.lit("page "), i), F.col("url"), F.when(i % 2 == 0, F.col("html")), F.when(i % 3 == 0, "2024"), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", hit.alias("hit"))


@register("font_mode", "WITH c AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) % 5 AS font, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, arg_min(font, -n * 10 + font) AS font, max(n) AS n FROM c GROUP BY 1")
def font_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.most_common(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("long") % 5).alias("font")), "l_orderkey", "font")


@register("newline_counts", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS lines FROM documents")
def newline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", records.line_count("text").cast("long").alias("lines"))


@register("token_totals", r"SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS characters, CAST(sum(k) AS BIGINT) AS tokens, count(*) FILTER (k = 0) AS failed FROM (SELECT source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS k FROM documents) GROUP BY 1")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.totals(table(spark, sf_dir, "documents"), "source", "text")


@register("rollout_progress", "SELECT rollout, count(*) AS total, count(*) FILTER (turns >= 4) AS done, count(*) FILTER (turns < 4) AS \"left\" FROM (SELECT conv_id, conv_id % 3 AS rollout, count(*) AS turns FROM conversations GROUP BY 1) GROUP BY 1")
def rollout_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).withColumn("rollout", F.col("conv_id") % 3)
    return records.progress(tasks, "rollout", F.col("turns") >= 4)


@register(
    "eta_progress",
    "SELECT event_id, user_id, completed, round(elapsed + 1e-9, 6) AS elapsed, round(elapsed / completed * (total - completed) + 1e-9, 6) AS remaining FROM (SELECT event_id, user_id, count(*) OVER w AS completed, sum(value) OVER w AS elapsed, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))",
)
def eta_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("total", F.count("*").over(Window.partitionBy("user_id")))
    out = records.eta(e, "user_id", ["event_id"], "value", F.col("total"))
    return out.select("event_id", "user_id", "completed", F.round(F.col("elapsed") + 1e-9, 6).alias("elapsed"), F.round(F.col("remaining") + 1e-9, 6).alias("remaining"))


@register(
    "session_report_text",
    """WITH b AS (SELECT n_name, count(*) AS papers, count(DISTINCT c_mktsegment) AS sessions FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
       SELECT 0 AS rank, n_name || ': papers ' || papers || ', sessions ' || sessions AS line FROM b UNION ALL SELECT 1, 'TOTAL: papers ' || CAST(sum(papers) AS BIGINT) || ', sessions ' || CAST(sum(sessions) AS BIGINT) FROM b""",
)
def session_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return records.report_lines(c.groupBy("n_name").agg(F.count("*").alias("papers"), F.countDistinct("c_mktsegment").alias("sessions")), "n_name", ["papers", "sessions"])


@register(
    "config_merge",
    """SELECT p_partkey, 'k=[' || p_brand || ']|stop=[a,' || CASE WHEN p_size % 2 = 0 THEN 'b' ELSE 'a' END || ',c]|t=[1]' AS config FROM part WHERE p_size % 2 = 0
       UNION ALL SELECT p_partkey, 'k=[' || p_brand || ']|stop=[a,c]|t=[1]' FROM part WHERE p_size % 2 <> 0""",
)
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.create_map(F.lit("k"), F.array(F.lit("x")), F.lit("t"), F.array(F.lit("1")), F.lit("stop"), F.array_distinct(F.array(F.lit("a"), F.when(F.col("p_size") % 2 == 0, "b").otherwise("a"))))
    new = F.create_map(F.lit("k"), F.array("p_brand"), F.lit("stop"), F.array(F.lit("c"), F.lit("a")))
    pairs = F.transform(F.array_sort(F.map_entries(T.merged_config(old, new, "stop"))), lambda x: F.concat(x["key"], F.lit("=["), F.array_join(x["value"], ","), F.lit("]")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(pairs, "|").alias("config"))


@register("lenient_json", "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_brand END AS brand, CASE WHEN p_size % 3 < 2 THEN CAST(p_size AS BIGINT) END AS size FROM part")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = F.concat(F.lit('{"brand": "'), "p_brand", F.lit('", "size": '), "p_size", F.lit("}"))
    loose = F.concat(F.lit("Here it is:\n```json\n{brand: '"), "p_brand", F.lit("', /* note */ size: "), "p_size", F.lit("}\n```\nbye"))
    said = F.when(F.col("p_size") % 3 == 0, strict).when(F.col("p_size") % 3 == 1, loose).otherwise("no json")
    return table(spark, sf_dir, "part").select("p_partkey", T.lenient_json(said, "brand string, size bigint").alias("j")).select("p_partkey", "j.brand", "j.size")


@register("decoded_data", "SELECT p_partkey, p_name AS name, CAST(round(p_size * (112.0::DOUBLE / least(p_size, p_partkey % 90 + 1))) AS BIGINT) AS height, CAST(round((p_partkey % 90 + 1) * (112.0::DOUBLE / least(p_size, p_partkey % 90 + 1))) AS BIGINT) AS width FROM part")
def decoded_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = T.decoded(T.data_url(F.col("p_name").cast("binary"))).cast("string")
    sides = T.short_side(F.col("p_size"), F.col("p_partkey") % 90 + 1, 112)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), sides.alias("r")).select("p_partkey", "name", "r.height", "r.width")


# --- snapshots -------------------------------------------------------------------------------------------------------


@register(
    "temporal_structure",
    """WITH RECURSIVE snap AS (SELECT DISTINCT year(l_shipdate) AS y, l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity >= 45),
        e AS (SELECT a.y, a.s AS src, b.s AS dst FROM snap a JOIN snap b ON a.y = b.y AND a.p = b.p AND a.s < b.s GROUP BY ALL),
        adj AS (SELECT y, src AS u, dst AS v FROM e UNION ALL SELECT y, dst, src FROM e),
        d AS (SELECT y, u, count(*) AS d FROM adj GROUP BY ALL),
        t AS (SELECT a.y, a.u, count(*) AS t FROM adj a JOIN adj b ON a.y = b.y AND a.u = b.u AND a.v < b.v JOIN e ON e.y = a.y AND e.src = a.v AND e.dst = b.v GROUP BY ALL),
        c AS (SELECT d.y, d.u, d.d, CASE WHEN d.d < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(t, 0) / (d.d * (d.d - 1)) END AS c FROM d LEFT JOIN t USING (y, u)),
        reach(y, u, v) AS (SELECT y, u, u FROM d UNION SELECT r.y, r.u, a.v FROM reach r JOIN adj a ON a.y = r.y AND a.u = r.v),
        m AS (SELECT y, count(*) AS n_components FROM (SELECT y, u, min(v) AS m FROM reach GROUP BY ALL) WHERE u = m GROUP BY 1)
       SELECT CAST(y AS INTEGER) AS year, count(*) AS num_nodes, round(avg(d), 6) AS avg_degree, round(avg(c), 6) AS avg_clustering, any_value(n_components) AS num_components FROM c JOIN m USING (y) GROUP BY y""",
)
def temporal_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's graph of articles that share an entity; the years are measured together, a node being of one year."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45")
    snap = lines.select(F.concat_ws(":", F.year("l_shipdate"), "l_partkey").alias("entity"), F.concat_ws(":", F.year("l_shipdate"), "l_suppkey").alias("title"))
    edges = selection.article_pairs(snap).select(F.col("a1").alias("src"), F.col("a2").alias("dst"))
    per = graph.clustering(edges).join(graph.degrees(edges), "id").join(components(edges).withColumnRenamed("node", "id"), "id")
    by = per.groupBy(F.split_part("id", F.lit(":"), F.lit(1)).cast("int").alias("year"))
    return by.agg(F.count("*").alias("num_nodes"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.round(F.avg("clustering"), 6).alias("avg_clustering"), F.count_if(F.col("id") == F.col("component")).alias("num_components"))


# --- walks -----------------------------------------------------------------------------------------------------------

WALKS, LENGTH, COMMON = 300, 8, 2


def walk_sql(starts: str, important: str, length: int, seed: int = 42) -> str:
    """CTEs: nb (neighbour lists), w0 .. and walks(walk, step, id), after `edges` and the given start and important queries."""
    pick = lambda s, k: f"CAST('0x' || substr(md5('{s}:' || walk || ':{k}'), 1, 8) AS BIGINT)"
    parts = [
        f"imp AS ({important}), adj AS (SELECT DISTINCT u, v FROM (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges)),"
        " nb AS (SELECT u, list(v ORDER BY v) AS al, list(v ORDER BY v) FILTER (v IN (SELECT id FROM imp)) AS sm FROM adj GROUP BY u)",
        f"w0 AS ({starts})",
    ]
    for k in range(1, length):
        some = f"CASE WHEN len(coalesce(sm, [])) > 0 AND {pick(seed + 1, k)} % 1000 < 300 THEN sm ELSE al END"
        parts.append(f"w{k} AS (SELECT walk, {k} AS step, o[CAST({pick(seed, k)} % len(o) AS BIGINT) + 1] AS id FROM (SELECT walk, {some} AS o FROM w{k - 1} JOIN nb ON w{k - 1}.id = nb.u))")
    return ", ".join(parts) + ", walks AS (" + " UNION ALL ".join(f"SELECT walk, step, id FROM w{k}" for k in range(length)) + ")"


_STARTS = f"""SELECT walk, 0 AS step, id FROM (SELECT walk, CAST('0x' || substr(md5('42:' || walk || ':start'), 1, 8) AS BIGINT) AS h, g FROM (SELECT CAST(i AS VARCHAR) AS walk, i < {int(WALKS * 0.7)} AS g FROM range({WALKS}) t(i)))
    JOIN (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT id, node_type = 'title' AS g FROM nodes WHERE node_type = 'title' OR frequency >= {COMMON})) USING (g) WHERE place = h % n"""
_WALKS = f"{NODES}, edges AS (SELECT least(title, entity) AS src, greatest(title, entity) AS dst FROM bip), {walk_sql(_STARTS, f'''SELECT id FROM nodes WHERE node_type <> 'title' AND frequency >= {COMMON}''', LENGTH)}"
_SELECTED = f"""{_WALKS}, ws AS (SELECT DISTINCT a.id AS title, b.id AS entity FROM walks a JOIN walks b ON a.walk = b.walk AND a.id IN (SELECT id FROM nodes WHERE node_type = 'title') AND b.id IN (SELECT id FROM nodes WHERE node_type <> 'title') JOIN bip ON bip.title = a.id AND bip.entity = b.id),
    deg AS (SELECT u AS id, count(*) AS d FROM adj GROUP BY 1), sc AS (SELECT id AS entity, 0.7 * frequency + 0.3 * coalesce(d, 0) AS importance FROM nodes LEFT JOIN deg USING (id) WHERE node_type <> 'title'),
    rich AS (SELECT title, count(*) AS n FROM ws GROUP BY 1),
    st AS (SELECT x.title AS a1, y.title AS a2, count(*) AS c, avg(importance) AS imp FROM ws x JOIN ws y ON x.entity = y.entity AND x.title < y.title JOIN sc ON sc.entity = x.entity GROUP BY 1, 2 HAVING count(*) >= {COMMON}),
    sel AS (SELECT a1, a2, c AS common, round(0.4 * 2 * c + 0.3 * imp + 0.2 * (p.n + q.n) / 2 + 0.1 * c / (p.n + q.n - c), 6) AS quality_score FROM st JOIN rich p ON p.title = a1 JOIN rich q ON q.title = a2)"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.importance(nodes(spark, sf_dir), graph.degrees(graph_edges(spark, sf_dir))).select("id", "node_type", "frequency", "importance")


@register("stratified_starts", f"WITH {NODES}, w0 AS ({_STARTS}) SELECT walk, id FROM w0")
def stratified_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return records.stratified_starts(n.filter("node_type = 'title'"), n.filter(f"node_type <> 'title' AND frequency >= {COMMON}"), WALKS)


@register("walk_selection", f"WITH {_SELECTED} SELECT * FROM sel")
def walk_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, _ = records.orchestrated(bipartite(spark, sf_dir), graph_edges(spark, sf_dir), _weighted(spark, sf_dir), WALKS, LENGTH, COMMON, 1_000_000)
    return best.withColumn("quality_score", F.round("quality_score", 6))


@register("walk_selection_details", f"WITH {_SELECTED} SELECT a1, a2, x.entity, n.node_type, n.frequency, round(sc.importance, 6) AS importance FROM sel JOIN bip x ON x.title = a1 JOIN bip y ON y.title = a2 AND y.entity = x.entity JOIN nodes n ON n.id = x.entity JOIN sc ON sc.entity = x.entity")
def walk_selection_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, details = records.orchestrated(bipartite(spark, sf_dir), graph_edges(spark, sf_dir), _weighted(spark, sf_dir), WALKS, LENGTH, COMMON, 1_000_000)
    return details.withColumn("importance", F.round("importance", 6))


_EDGES = "edges AS (SELECT least(title, entity) AS src, greatest(title, entity) AS dst FROM bip)"


@register("random_walk", f"WITH {NODES}, {_EDGES}, " + walk_sql("SELECT DISTINCT title AS walk, 0 AS step, title AS id FROM bip", "SELECT id FROM nodes WHERE frequency >= 4", 8) + " SELECT * FROM walks")
def random_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = nodes(spark, sf_dir).filter("frequency >= 4").select("id")
    starts = bipartite(spark, sf_dir).select("title").distinct().select(F.col("title").alias("walk"), F.col("title").alias("id"))
    return iterative.random_walks(graph_edges(spark, sf_dir), starts, 8, important=top)


@register("walk_summary", f"WITH {_SELECTED}, top AS (SELECT * FROM sel ORDER BY quality_score DESC, a1, a2 LIMIT 5), r AS (SELECT a1, a2, x.entity, row_number() OVER (PARTITION BY a1, a2 ORDER BY sc.importance DESC, x.entity) AS k FROM top JOIN bip x ON x.title = a1 JOIN bip y ON y.title = a2 AND y.entity = x.entity JOIN sc ON sc.entity = x.entity) SELECT a1, a2, a1 || ' + ' || a2 || ': ' || string_agg(entity, ', ' ORDER BY k) AS line FROM r WHERE k <= 8 GROUP BY 1, 2")
def walk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, details = records.orchestrated(bipartite(spark, sf_dir), graph_edges(spark, sf_dir), _weighted(spark, sf_dir), WALKS, LENGTH, COMMON, 1_000_000)
    return records.summary_lines(best.withColumn("quality_score", F.round("quality_score", 6)), details)
