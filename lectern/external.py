"""Calls to models and services as functions that can be exchanged, with deterministic local stand-ins.

Each stand-in is built from expressions; a real model is a Column -> Column function too, usually a pandas UDF.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.dedup import unit

Model = Callable[[Column], Column]


def hashed_embedding(dims: int = 64) -> Model:
    """Text to a unit vector: words hashed to places, with signs."""

    def embed(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
        places = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dims)).alias("at"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
        raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(places, F.lit(0.0), lambda s, p: s + F.when(p["at"] == i, p["sign"]).otherwise(0.0)))
        return unit(raw)

    return embed


def keyword_entities(least: int = 6, most: int = 20) -> Model:
    """Text to its distinct long words, in order."""
    return lambda text: F.slice(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) >= least)), 1, most)


def extract_entities(papers: DataFrame, fields: dict[str, str], extractor: Model | None = None, title: str = "title") -> DataFrame:
    """(title, one array of entities for each field): fields maps an entity type to the column it is drawn from."""
    model = extractor or keyword_entities()
    return papers.select(title, *[model(F.col(c)).alias(kind) for kind, c in fields.items()])


def fallback_queries(title: Column) -> Column:
    """What to search for when no model proposes anything."""
    return F.array(F.concat(F.lit('arxiv "'), title, F.lit('"')), title)


def backoff(attempt: int, jitter: float = 0.0, longest: float = 30.0) -> float:
    """Seconds to wait before the next attempt."""
    return min(2.0**attempt + jitter, longest)


def linear_backoff(attempt: int, step: float = 2.0) -> float:
    return step * attempt


def retried(call: Callable, tries: int, wait: Callable[[int], float] = backoff, sleep: Callable[[float], None] = time.sleep):
    """call() until it does not raise, `tries` times at most; the last error is raised."""
    for attempt in range(tries):
        try:
            return call()
        except Exception:
            if attempt + 1 == tries:
                raise
            sleep(wait(attempt))
    raise ValueError("no try allowed")


#: A service: from one request (a text) to its answer's rows. Real ones call out; the stand-ins here answer by rule.
Service = Callable[[str], list[tuple]]


def asked(df: DataFrame, request: str, service: Service, schema: str, tries: int = 5) -> DataFrame:
    """The rows that a service gives for each request, each with its request; requests that fail for good give none."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch[request]:
                try:
                    rows += [(x, *r) for r in retried(lambda x=x: service(x), tries)]
                except Exception:  # a request that fails for good must not end the job
                    continue
            yield pd.DataFrame(rows, columns=[request, *names])

    return df.select(F.col(request).cast("string")).mapInPandas(run, f"`{request}` string, {schema}")


HIT = "rank int, title string, url string, description string, date string"


def no_search(query: str, results: int = 10) -> list[tuple]:
    """Stand-in for a web search: a hit that only repeats the query."""
    return [(1, query, f"https://example.org/search?q={re.sub(r'[^A-Za-z0-9]+', '+', query)}", "", "")][:results]


def searched(queries: DataFrame, query: str = "query", search: Service = no_search) -> DataFrame:
    """(query, rank, title, url, description, date) of every query."""
    return asked(queries, query, search, HIT)


def searched_together(queries: DataFrame, key: str, query: str, rendered: Column, search: Service = no_search) -> DataFrame:
    """(key, content): the rendered hits of each query, queries in order, between rules of seven equal signs."""
    hits = searched(queries.select(query).distinct(), query, search).withColumn("_hit", rendered)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "_hit"))), lambda x: x["_hit"])
    each = queries.select(key, query).distinct().join(hits.groupBy(query).agg(F.array_join(lines, "\n").alias("_text")), query)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(query, "_text"))), lambda x: x["_text"])
    return each.groupBy(key).agg(F.array_join(parts, "\n=======\n").alias("content"))


def read_urls(urls: DataFrame, url: str = "url", reader: Service = lambda u: [("",)]) -> DataFrame:
    """(url, content) through a reading service."""
    return asked(urls, url, reader, "content string")


def parsed_documents(files: DataFrame, parser: Service, path: str = "path") -> DataFrame:
    """(path, page, kind, content) through a layout parser (PDF and the like); pages from 0, kind text or table or image."""
    return asked(files, path, parser, "page int, kind string, content string")


def polled(submit: Callable[[str], str], ready: Callable[[str], int], page: Callable[[str, int, int], list[tuple]], tries: int = 10, pause: float = 10.0, step: int = 3000, sleep: Callable[[float], None] = time.sleep) -> Service:
    """A parsing service that works by jobs: submit a path, ask until it tells how many layouts there are, fetch them in steps."""

    def service(path: str) -> list[tuple]:
        job = submit(path)
        for _ in range(tries):
            n = ready(job)
            if n >= 0:
                return [row for at in range(0, n, step) for row in page(job, at, min(step, n - at))]
            sleep(pause)
        raise TimeoutError(f"{path}: not parsed after {tries} looks")

    return service


def safe_path(url: str, folder: str) -> str:
    """Where a download of url goes: its last part, without signs that file systems mind, inside folder."""
    name = re.sub(r"[?#].*$", "", url).rstrip("/").rpartition("/")[2]
    return f"{folder.rstrip('/')}/{re.sub(r'[^A-Za-z0-9._-]+', '_', name).lstrip('.') or 'unnamed'}"


def decoded_text(raw: bytes, charsets: tuple[str, ...] = ("utf-8", "gb18030", "latin-1")) -> str:
    """Bytes as text by the first charset that fits."""
    for name in charsets:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


#: Endings of media, and the bytes that a file may have.
MEDIA = (".mp3", ".wav", ".aac", ".ogg", ".flac", ".mp4", ".mov", ".avi", ".mkv", ".webm")
MEDIA_BYTES = 500 << 20


def media_problem(path: Column, size: Column) -> Column:
    """Why a file can't be taken as audio or video; null if it can."""
    known = F.rlike(F.lower(path), F.lit("(" + "|".join(re.escape(e) for e in MEDIA) + ")$"))
    return F.when(~known, "unknown ending").when(size > MEDIA_BYTES, "too large")


def transcribed(files: DataFrame, transcriber: Service, path: str = "path") -> DataFrame:
    """(path, start, end, content) through a transcription service."""
    return asked(files, path, transcriber, "start double, end double, content string")


def captioned(images: DataFrame, model: Model | None = None, image: str = "image") -> DataFrame:
    """Adds caption: what a model reads in or says of an image; the stand-in gives its size."""
    model = model or (lambda c: F.concat(F.lit("image of "), F.octet_length(c).cast("string"), F.lit(" bytes")))
    return images.withColumn("caption", model(F.col(image)))


def generated(rows: DataFrame, prompt: Column, name: str, model: Model | None = None) -> DataFrame:
    """Adds a generator's answer to a prompt (summary, question, solution, judgement); the stand-in gives the prompt's end."""
    model = model or (lambda p: F.substring(p, -200, 200))
    return rows.withColumn(name, model(prompt))


#: Tools by name, as an agent is offered them: what each needs, and whether it is offered.
TOOLS: dict[str, tuple[list[str], bool]] = {}


def register_tool(name: str, needs: list[str], offered: bool = True) -> None:
    if name in TOOLS:
        raise ValueError(f"{name} is registered twice")
    TOOLS[name] = (needs, offered)


for _name, _needs, _offered in (("file_search", ["query", "documents"], True), ("web_search", ["query"], False), ("no_retrieval", ["question"], False), ("video_analysis", ["path"], False)):
    register_tool(_name, _needs, _offered)


def offered_tools() -> list[str]:
    return [name for name, (_, offered) in TOOLS.items() if offered]
