"""Queries of the text functions, document parsing, scheduling and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import evaluation, lookup, scheduling
from lectern.plans.common import table
from lectern.plans.registry import register
from lectern.sources.parsers import html_paragraphs as parse_html


@register("normalize_text", r"SELECT doc_id, regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s]', '', 'g') AS norm FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise("text").alias("norm"))


@register("session_slug", r"""SELECT doc_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(trim(text), '[^\p{L}\p{N}_\s-]', '_', 'g'), '[\s_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 100) AS s FROM documents)""")
def session_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.slug("text").alias("slug"))


@register("doc_summary", "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS summary FROM documents")
def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.shortened("text").alias("summary"))


_ARXIV = "u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://arxiv.org/abs/' || (2000 + page_id % 500) || '.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') WHEN 1 THEN 'see http://arxiv.org/pdf/hep-th/' || lpad(CAST(page_id % 10000000 AS VARCHAR), 7, '0') ELSE url END AS link FROM pages)"


@register("arxiv_id", f"WITH {_ARXIV} SELECT page_id, link, coalesce(nullif(regexp_extract(link, 'arxiv\\.org/(?:abs|pdf)/([0-9]{{4}}\\.[0-9]{{4,5}})', 1), ''), regexp_extract(link, 'arxiv\\.org/(?:abs|pdf)/([a-z-]+/[0-9]{{7}})', 1)) AS arxiv_id FROM u")
def arxiv_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    abs_link = F.concat(F.lit("https://arxiv.org/abs/"), (i % 500 + 2000).cast("string"), F.lit("."), F.lpad((i % 100000).cast("string"), 5, "0"))
    short = F.concat(F.lit("see http://arxiv.org/pdf/hep-th/"), F.lpad((i % 10000000).cast("string"), 7, "0"))
    link = F.when(i % 3 == 0, abs_link).when(i % 3 == 1, short).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", link.alias("link")).withColumn("arxiv_id", T.arxiv_id("link"))


@register("text_flags", "SELECT page_id, regexp_matches(html, '[一-鿿]') AS cjk, regexp_matches(html, '<(p|div|a|span|html|body|br)[^>]*>') AS tags, starts_with(url, 'http://') OR starts_with(url, 'https://') AS http, regexp_matches(lower(url), '(jpg|jpeg|png|gif|bmp|webp|tiff)$') AS image FROM pages")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.has_cjk("html").alias("cjk"), T.has_tags("html").alias("tags"), T.is_http("url").alias("http"), T.is_image("url").alias("image"))


@register("extract_urls", r"""SELECT page_id, len(l) AS n_urls, array_to_string(l, '|') AS urls FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, 'https?://[^ \t\n\r\f\x0B"<>]+') AS l FROM pages)""")
def extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", T.urls(F.concat_ws(" ", "url", "html")).alias("l"))
    return found.select("page_id", F.size("l").cast("long").alias("n_urls"), F.array_join("l", "|").alias("urls"))


@register("url_basename", "SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '([^/]*)$', 1) AS name FROM pages")
def url_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_basename("url").alias("name"))


@register("clean_text", r"SELECT doc_id, trim(regexp_replace(replace(regexp_replace(text || chr(10) || chr(10) || '--------- end', '\n+', chr(10), 'g'), 'License', ''), '-{6,}', '-----', 'g')) AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.concat("text", F.lit("\n\n--------- end")), "License").alias("cleaned"))


_TAGGED = "t AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 'note <answer> ' || text || ' </answer> rest' WHEN role = 'user' THEN '<tool_call>{\"name\": \"x\"}</tool_call>' ELSE text END AS body FROM conversations)"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), F.concat(F.lit("note <answer> "), "text", F.lit(" </answer> rest"))).when(F.col("role") == "user", F.lit('<tool_call>{"name": "x"}</tool_call>')).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", body.alias("body"))


_TERM = "CASE WHEN contains(body, '<answer>') AND contains(body, '</answer>') THEN 'answer' WHEN contains(body, '<tool_call>') THEN 'tool call' ELSE 'answer not found' END"


@register("answer_extract", f"WITH {_TAGGED} SELECT conv_id, turn, role, CASE WHEN contains(body, '<answer>') AND contains(body, '</answer>') THEN trim(regexp_extract(body, '(?s)<answer>(.*?)</answer>', 1)) END AS answer FROM t")
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("conv_id", "turn", "role", T.answer("body").alias("answer"))


@register("rollout_termination", f"WITH {_TAGGED}, l AS (SELECT conv_id, max_by(body, turn) AS body, count(*) AS rounds, CAST(sum(len(string_split(body, ' '))) AS BIGINT) AS words FROM t GROUP BY 1) SELECT {_TERM} AS termination, count(*) AS n, round(avg(rounds), 6) AS avg_rounds, round(avg(words), 6) AS avg_words FROM l GROUP BY 1")
def rollout_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _tagged(spark, sf_dir).groupBy("conv_id").agg(F.max_by("body", "turn").alias("body"), F.count("*").alias("rounds"), F.sum(F.size(F.split("body", " "))).alias("words"))
    return last.groupBy(T.termination("body").alias("termination")).agg(F.count("*").alias("n"), F.round(F.avg("rounds"), 6).alias("avg_rounds"), F.round(F.avg("words"), 6).alias("avg_words"))


@register("markdown_rows", "SELECT p_partkey, '|' || p_name || '|' || p_brand || '|' || p_size || '|' || 'None' || '|' AS row FROM part")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.markdown_row(F.col("p_name"), F.col("p_brand"), F.col("p_size"), F.lit(None).cast("string")).alias("row"))


@register("last_user_turn", "SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END) AS turn FROM conversations GROUP BY 1")
def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("turn"))


@register("conversation_transcript", "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY 1")
def conversation_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(parts, "\n").alias("transcript"))


@register("html_paragraphs")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_html(table(spark, sf_dir, "pages"), "page_id", "html")


_LINES = r"l AS (SELECT page_id, unnest([0, 1, 2, 3, 4]) AS pos, unnest(['[1] Title: page ' || page_id, '[1] URL Source: ' || url, 'noise', '[2] Title: other ' || (page_id * 2), '[2] Date: 2024-01-0' || (1 + page_id % 9)]) AS line FROM pages)"


@register("search_lines_parse", f"WITH {_LINES} SELECT page_id, CAST(regexp_extract(line, '^\\[([0-9]+)\\]', 1) AS BIGINT) AS hit, coalesce(max(CASE WHEN contains(line, '] Title: ') THEN regexp_extract(line, 'Title: (.*)$', 1) END), '') AS title, coalesce(max(CASE WHEN contains(line, '] URL Source: ') THEN regexp_extract(line, 'URL Source: (.*)$', 1) END), '') AS url, '' AS description, coalesce(max(CASE WHEN contains(line, '] Date: ') THEN regexp_extract(line, 'Date: (.*)$', 1) END), '') AS date FROM l WHERE starts_with(line, '[') GROUP BY 1, 2")
def search_lines_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    lines = F.array(F.concat(F.lit("[1] Title: page "), i), F.concat(F.lit("[1] URL Source: "), F.col("url")), F.lit("noise"), F.concat(F.lit("[2] Title: other "), i * 2), F.concat(F.lit("[2] Date: 2024-01-0"), i % 9 + 1))
    return evaluation.parsed_hits(table(spark, sf_dir, "pages").select("page_id", F.posexplode(lines).alias("pos", "line")), "page_id", "pos", "line")


# --- scheduling ------------------------------------------------------------------------------------------------------


@register("resume_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "failed").alias("error"))
    return scheduling.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"], "error")


@register("prompt_expand", "SELECT item_id, p AS prompt_type, 'Summarise (' || p || '): ' || text AS prompt FROM benchmark, (SELECT unnest(['background', 'methods', 'results']) AS p)")
def prompt_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = scheduling.expand(table(spark, sf_dir, "benchmark"), ["background", "methods", "results"], "prompt_type")
    return items.select("item_id", "prompt_type", F.concat(F.lit("Summarise ("), "prompt_type", F.lit("): "), "text").alias("prompt"))


@register("rollout_tasks", "SELECT item_id, CAST(r AS INTEGER) AS rollout_idx FROM benchmark, (SELECT unnest([1, 2, 3]) AS r)")
def rollout_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.expand(table(spark, sf_dir, "benchmark").select("item_id"), [1, 2, 3], "rollout_idx")


@register("sticky_round_robin", "SELECT event_id, user_id, slot FROM events JOIN (SELECT user_id, (row_number() OVER (ORDER BY min(event_id)) - 1) % 4 AS slot FROM events GROUP BY 1) USING (user_id)")
def sticky_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.sticky_round_robin(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 4).select("event_id", "user_id", "slot")


@register("worker_split", "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / ceil(count(*) OVER () / 7)) + 1 AS BIGINT) AS worker FROM orders")
def worker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.split(table(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey")


@register("batch_numbers", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.batches(table(spark, sf_dir, "documents").select("doc_id"), 32, "doc_id")


# --- evaluation ------------------------------------------------------------------------------------------------------

_SCORES = "s AS (SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN 'failed' END AS error, quality::DOUBLE AS score, toxic::DOUBLE AS other, (doc_id % 10)::DOUBLE AS third FROM labels JOIN documents USING (doc_id))"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return joined.select("doc_id", "source", F.when(F.col("doc_id") % 11 == 0, "failed").alias("error"), F.col("quality").cast("double").alias("score"), F.col("toxic").cast("double").alias("other"), (F.col("doc_id") % 10).cast("double").alias("third"))


def _means(dims: dict[str, str], scale: float, average: str) -> str:
    means = {d: f"coalesce(avg({d}) FILTER (error IS NULL), 0) * {scale}" for d in dims}
    total = " + ".join(means.values())
    return f"WITH {_SCORES} SELECT source, count(*) AS total, count(*) FILTER (error IS NULL) AS valid, {', '.join(f'round({m}, 4) AS avg_{d}' for d, m in means.items())}, round(({total}) / {len(dims)}, 4) AS {average} FROM s GROUP BY 1"


@register("eval_reasoning", f"WITH {_SCORES} SELECT source, count(*) AS total, count(*) FILTER (error IS NULL) AS valid, count(*) FILTER (error IS NULL AND score >= 1) AS correct_count, round(100 * coalesce(avg(score) FILTER (error IS NULL), 0), 4) AS accuracy FROM s GROUP BY 1")
def eval_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.reasoning_summary(_scores(spark, sf_dir), "source")


@register("eval_induction", _means({"score": "", "other": ""}, 100, "average"))
def eval_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_summary(_scores(spark, sf_dir), ["score", "other"], 100, "average", "source")


@register("eval_summary", _means({"score": "", "other": "", "third": ""}, 1, "average_score"))
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_summary(_scores(spark, sf_dir), ["score", "other", "third"], 1, "average_score", "source")


@register("eval_solution", _means({"third": "", "score": ""}, 1, "mean_score"))
def eval_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_summary(_scores(spark, sf_dir), ["third", "score"], 1, "mean_score", "source")


@register(
    "verify_stats",
    """WITH v AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'low' WHEN doc_id % 4 = 1 THEN 'medium' ELSE 'high' END AS confidence, quality = 1 AS verified FROM labels),
            b AS (SELECT confidence, count(*) AS n, count(*) FILTER (verified) AS n_verified FROM v GROUP BY 1), u AS (SELECT * FROM b UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT), CAST(sum(n_verified) AS BIGINT) FROM b)
       SELECT *, round(100.0::DOUBLE * n_verified / greatest(n, 1), 1) AS share FROM u""",
)
def verify_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("doc_id") % 4 == 0, "low").when(F.col("doc_id") % 4 == 1, "medium").otherwise("high")
    return evaluation.verification(table(spark, sf_dir, "labels").select(conf.alias("confidence"), (F.col("quality") == 1).alias("verified")), "verified", "confidence")


@register("exact_match", "SELECT p_partkey, CASE WHEN lower(trim(p_type)) = lower(trim(p_brand)) OR p_size % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("  "), F.lower("p_type"), F.lit("!"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", evaluation.exact_match("p_type", gold).alias("score"))


_RANKED = "ranked AS (SELECT l_orderkey AS query, l_linenumber AS rank, l_partkey AS item FROM lineitem WHERE l_linenumber <= 7), gold AS (SELECT DISTINCT l_orderkey AS query, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'), one AS (SELECT query, item, min(rank) AS rank FROM ranked GROUP BY 1, 2)"


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    ranked = lines.groupBy(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("item")).agg(F.min("l_linenumber").alias("rank"))
    gold = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("item"))
    return evaluation.ranking_scores(ranked, gold, "query", "item", 5)


_HITS = f"WITH {_RANKED}, n AS (SELECT query, count(*) AS n FROM gold GROUP BY 1), h AS (SELECT query, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM one JOIN gold USING (query, item) WHERE rank <= 5 GROUP BY 1)"


@register("recall_at_k", f"{_HITS} SELECT query, round(coalesce(hits, 0) / n, 6) AS recall FROM n LEFT JOIN h USING (query)")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranking(spark, sf_dir).select("query", F.round("recall", 6).alias("recall"))


@register("ndcg_at_k", f"{_HITS} SELECT query, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM n LEFT JOIN h USING (query)")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranking(spark, sf_dir).select("query", F.round("ndcg", 6).alias("ndcg"))


@register(
    "knowledge_lookup",
    """WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 2 = 0 THEN ' ring' ELSE '' END AS question FROM part), k AS (SELECT p_name AS title, min(p_partkey) AS score FROM part GROUP BY 1),
            e AS (SELECT question, score FROM q JOIN k ON title = question),
            f AS (SELECT question, min_by(score, title) AS score FROM q JOIN k ON contains(title, question) OR contains(question, title) WHERE question NOT IN (SELECT question FROM e) GROUP BY 1)
       SELECT q.question, coalesce(e.score, f.score, 0) AS score FROM q LEFT JOIN e USING (question) LEFT JOIN f USING (question)""",
)
def knowledge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    q = part.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.when(F.col("p_partkey") % 2 == 0, " ring").otherwise("")).alias("question")).distinct()
    k = part.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("score"))
    e = lookup.exact(q, "question", k, "title", "title").select("question", "score")
    rest = lookup.containing(e.filter("score IS NULL"), "question", k, "title", "title").select("question", F.col("score").alias("near"))
    return e.join(rest, "question", "left").select("question", F.coalesce("score", "near", F.lit(0)).alias("score"))


@register(
    "session_report",
    """WITH b AS (SELECT r_name AS conference, count(*) FILTER (c_acctbal >= 0) AS processed, count(*) FILTER (c_acctbal < 0) AS errors, count(DISTINCT n_name) AS sessions FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
       SELECT * FROM b UNION ALL SELECT 'TOTAL', CAST(sum(processed) AS BIGINT), CAST(sum(errors) AS BIGINT), CAST(sum(sessions) AS BIGINT) FROM b""",
)
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    by = c.groupBy(F.col("r_name").alias("conference")).agg(F.count_if(F.col("c_acctbal") >= 0).alias("processed"), F.count_if(F.col("c_acctbal") < 0).alias("errors"), F.countDistinct("n_name").alias("sessions"))
    return by.unionByName(by.agg(F.lit("TOTAL").alias("conference"), *[F.sum(x).alias(x) for x in ("processed", "errors", "sessions")]))


@register(
    "phase_summary",
    "SELECT event_type, count(*) AS samples, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration, max(value) AS peak_memory, round(avg(value), 6) AS avg_memory, round(max_by(value, (ts, value)) - min_by(value, (ts, value)), 6) AS memory_delta FROM events GROUP BY 1",
)
def phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.phase_summary(table(spark, sf_dir, "events"), "event_type", "ts", "value")


@register("phase_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS samples, max(value) AS peak_memory, round(avg(value), 6) AS avg_memory FROM events GROUP BY 1, 2")
def phase_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming.monitor import windowed

    out = windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "samples", "peak_memory", F.round("avg_memory", 6).alias("avg_memory"))


_PAGES = "r AS (SELECT conv_id, turn, CAST(turn // 2 % 2 AS BIGINT) AS page, text FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2))"


@register(
    "page_grouping",
    f"""WITH {_PAGES}, m AS (SELECT *, lag(page) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM r), g AS (SELECT *, sum(CASE WHEN prev <> page THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM m)
        SELECT conv_id, CAST(grp AS BIGINT) AS grp, page, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS content FROM g GROUP BY 1, 2, 3""",
)
def page_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("page", F.floor(F.col("turn") / 2) % 2)
    return evaluation.page_groups(rows, "conv_id", "turn", "page", "text")


@register(
    "paragraph_merge",
    """WITH u AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, 'P' || min(l_partkey) AS t FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey, l_linenumber, CAST(floor(q / 10) AS BIGINT) AS size, CAST(floor(q / 9) AS BIGINT) AS height, t FROM u),
            m AS (SELECT *, lag(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev FROM r),
            g AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND NOT (abs(size - prev) < 2 AND height < size + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS grp FROM m)
       SELECT l_orderkey, CAST(grp AS BIGINT) AS grp, count(*) AS n, string_agg(t, ' ' ORDER BY l_linenumber) AS content FROM g GROUP BY 1, 2""",
)
def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_partkey").alias("p"))
    rows = lines.select("l_orderkey", "l_linenumber", F.floor(F.col("q") / 10).alias("size"), F.floor(F.col("q") / 9).alias("height"), F.concat(F.lit("P"), "p").alias("t"))
    return evaluation.merge_paragraphs(rows, "l_orderkey", "l_linenumber", "size", "height", "t")


@register(
    "bbox_dedup",
    """WITH t AS (SELECT p_partkey, p_partkey % 5 AS page, p_size AS x0, p_partkey % 40 AS y0, p_size + 3 AS x1, p_partkey % 40 + 2 AS y1 FROM part), b AS (SELECT s_suppkey % 5 AS page, s_suppkey % 50 AS x0, s_suppkey % 30 AS y0, s_suppkey % 50 + 10 AS x1, s_suppkey % 30 + 9 AS y1 FROM supplier)
       SELECT p_partkey FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = t.page AND t.x0 >= b.x0 AND t.y0 >= b.y0 AND t.x1 <= b.x1 AND t.y1 <= b.y1)""",
)
def bbox_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    texts = table(spark, sf_dir, "part").select("p_partkey", (p % 5).alias("page"), F.col("p_size").cast("long").alias("x0"), (p % 40).alias("y0"), (F.col("p_size") + 3).cast("long").alias("x1"), (p % 40 + 2).alias("y1"))
    boxes = table(spark, sf_dir, "supplier").select((s % 5).alias("page"), (s % 50).alias("x0"), (s % 30).alias("y0"), (s % 50 + 10).alias("x1"), (s % 30 + 9).alias("y1"))
    return evaluation.outside_boxes(texts, boxes).select("p_partkey")


@register("keyframe_times", "SELECT event_id, CAST(i AS INTEGER) AS pos, round(value / (n + 1) * (i + 1), 6) AS t FROM (SELECT event_id, value, n, unnest(range(n)) AS i FROM (SELECT event_id, value, CAST(1 + event_id % 4 AS INTEGER) AS n FROM events))")
def keyframe_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 4 + 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(T.keyframe_times(F.col("value"), n)).alias("pos", "t")).withColumn("t", F.round("t", 6))


_RESIZE = """z AS (SELECT p_partkey, CAST(p_size * 37 + 5 AS DOUBLE) AS h, CAST(p_partkey % 900 + 3 AS DOUBLE) * CASE WHEN p_partkey % 50 = 0 THEN 300 ELSE 1 END AS w FROM part),
    e AS (SELECT *, greatest(28, CAST(round_even(h / 28, 0) AS BIGINT) * 28) AS hb, greatest(28, CAST(round_even(w / 28, 0) AS BIGINT) * 28) AS wb, sqrt(h * w / 1003520) AS shrink, sqrt(200704 / (h * w)) AS grow FROM z),
    f AS (SELECT p_partkey, CAST(CASE WHEN hb * wb > 1003520 THEN floor(h / shrink / 28) * 28 WHEN hb * wb < 200704 THEN ceil(h * grow / 28) * 28 ELSE hb END AS BIGINT) AS h, CAST(CASE WHEN hb * wb > 1003520 THEN floor(w / shrink / 28) * 28 WHEN hb * wb < 200704 THEN ceil(w * grow / 28) * 28 ELSE wb END AS BIGINT) AS w FROM e)"""


@register("smart_resize", f"WITH {_RESIZE} SELECT p_partkey, CASE WHEN h > 200 * w THEN 200 * w ELSE h END AS height, CASE WHEN w > 200 * h THEN 200 * h ELSE w END AS width FROM f")
def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.smart_resize(F.col("p_size") * 37 + 5, (F.col("p_partkey") % 900 + 3) * F.when(F.col("p_partkey") % 50 == 0, 300).otherwise(1))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("r")).select("p_partkey", "r.height", "r.width")
