"""A corpus pipeline: language, near duplicates, benchmark passages, personal data, then token ids.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; all but the last return the columns
of documents. run() writes each stage's rows as Parquet to the shared folder and reads them again.

Null texts have no language and go in the first stage. Rows without an id are judged by their own text, and
near-duplicate removal keeps them. Of rows that repeat an id one stays for each
text that is no near copy. Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.language import keep_identified
from lectern.llm.pieces import round_trip
from lectern.llm.postings import keep_clean
from lectern.llm.private_data import mask_private
from lectern.llm.queries import table, tokenizer_file
from lectern.llm.runtime import staged, tune
from lectern.llm.simhash import keep_distinct

#: A text whose best language has a smaller share is rejected.
LEAST_SHARE = 0.4

#: No SQL for the language, personal data and token stages.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter or without a clear language."""
    tune(spark)
    return keep_identified(docs, LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates: Jaccard 0.8 or more of 5-word shingles."""
    tune(spark)
    return keep_distinct(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages, by the rule of the decontamination query."""
    tune(spark)
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts."""
    tune(spark)
    return mask_private(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): each text's ids as decimal text, and what they decode to."""
    tune(spark)
    return round_trip(docs, tokenizer_file("piece_bpe_32k.model"), digest=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("private_data", private_data),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
