"""One query for each operator of this package over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.runtime import tune


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; executors call this too, for each has its own copy of the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.postings import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.archives import page_archives

    return page_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.hidden_markov import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.private_data import find_private

    return find_private(table(spark, sf_dir, "documents"))


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.token_planes import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language": op2_language,
    "op3_neighbours": op3_neighbours,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_hidden_markov": op7_hidden_markov,
    "op8_toxicity": op8_toxicity,
    "op9_token_planes": op9_token_planes,
    "op10_private_data": op10_private_data,
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_decontaminate": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[k : k + least(13, len(ws)) - 1], ' ') AS t
                FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        d AS (SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS t
              FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, sizes WHERE len(ws) >= n)),
        occ AS (SELECT DISTINCT doc_id, k, d.n, item_id FROM d JOIN win ON d.t = win.t AND d.n = win.n),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM occ) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op3_neighbours": """
        WITH v AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20
    """,
    # the 40 hex digits of a SHA-1 are 8 groups of 20 bits, 4 base32 digits each
    "op5_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i:
                   substr('{_BASE32}', CAST((CAST(('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5)) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM q
    """,
}
