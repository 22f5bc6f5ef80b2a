"""Formats, services and the operators over records that have no query of their own."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lectern import external
from lectern.functions import text as T
from lectern.operators import iterative, records
from lectern.operators.components import components
from lectern.sources import readers, sinks
from lectern.streaming.monitor import timed


@pytest.mark.parametrize("kind", ["graphml", "gexf"])
def test_graph_files_round_trip(spark, tmp_path, kind):
    nodes = spark.createDataFrame([("a<b", ["x", "y"], 2), ("c", [], 1)], "id string, articles array<string>, frequency long")
    edges = spark.createDataFrame([("a<b", "c", 3)], "src string, dst string, weight long")
    path = str(tmp_path / f"g.{kind}")
    (sinks.write_gexf if kind == "gexf" else sinks.write_graphml)(nodes, edges, path)
    n, e = readers.graph_file(spark, path)
    got = {r.id: r.attributes for r in n.collect()}
    assert got["a<b"]["articles"] == "x|y" and got["c"]["frequency"] == "1"
    assert [(r.src, r.dst, r.attributes["weight"]) for r in e.collect()] == [("a<b", "c", "3")]
    with pytest.raises(ValueError):
        readers.graph_file(spark, "g.txt")


def test_json_graph_variants_and_artefacts(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    sinks.write_json_graph(nodes, edges, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "edges")).first().dst == "b"
    sinks.write_variants(nodes, str(tmp_path / "v"), {"plain": {}, "loud": {"id": F.upper("id")}})
    assert {(r.id, r.variant) for r in spark.read.json(str(tmp_path / "v")).collect()} == {("a", "plain"), ("A", "loud")}
    sinks.write_artefacts(spark.createDataFrame([("p", "# t", None)], "path string, markdown string, middle string"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "markdown")).count() == 1 and spark.read.parquet(str(tmp_path / "p" / "middle")).count() == 0


def test_services(spark):
    asked = spark.createDataFrame([(1, "b q"), (1, "a q"), (2, "a q")], "k long, query string")
    out = {r.k: r.content for r in external.searched_together(asked, "k", "query", F.col("title")).collect()}
    assert out == {1: "a q\n=======\nb q", 2: "a q"}
    looks = iter([-1, -1, 5])
    service = external.polled(lambda p: p + "!", lambda job: next(looks), lambda job, at, n: [(at, "text", job)] * n, step=3, sleep=lambda s: None)
    assert [r[0] for r in service("x")] == [0, 0, 0, 3, 3]
    with pytest.raises(TimeoutError):
        external.polled(lambda p: p, lambda job: -1, None, sleep=lambda s: None)("x")
    calls = []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        external.retried(fails, 3, sleep=lambda s: None)
    assert len(calls) == 3
    assert external.safe_path("https://x.org/a/b c.pdf?x=1", "/d/") == "/d/b_c.pdf" and external.safe_path("https://x.org/..", "/d") == "/d/unnamed"
    assert external.decoded_text("é".encode("latin-1")) in ("é", "窯") and external.decoded_text(b"abc") == "abc"
    assert external.offered_tools() == ["file_search"]
    files = spark.createDataFrame([("a.mp4", 1), ("b.txt", 1), ("c.wav", 600 << 20)], "path string, size long")
    assert [r[0] for r in files.select(external.media_problem(F.col("path"), F.col("size"))).collect()] == [None, "unknown ending", "too large"]
    assert external.read_urls(spark.createDataFrame([("u",)], "url string")).first().content == ""
    assert external.captioned(spark.createDataFrame([(b"123",)], "image binary")).first().caption == "image of 3 bytes"


def test_records(spark):
    d = spark.createDataFrame([(1, [[("t", None), (None, "tab")], [("u", "x")]])], "k long, pages array<array<struct<text: string, table: string>>>")
    assert d.select(records.flattened(F.col("pages"))).first()[0] == "t\ntab\nu"
    texts = spark.createDataFrame([(1, "a  b"), (1, " "), (2, None)], "k long, text string")
    assert {tuple(r) for r in records.totals(texts, "k", "text").collect()} == {(1, 5, 2, 1), (2, 0, 0, 1)}
    assert [r.size for r in spark.createDataFrame([("{size: 3}",), ("none",), (None,)], "t string").select(T.lenient_json("t", "size bigint").alias("j")).select("j.size").collect()] == [3, None, None]
    assert timed("x", lambda: 1, iter([0.0, 2.0]).__next__, iter([5.0, 7.5]).__next__) == (1, {"x_duration": 2.0, "x_memory_delta": 2.5})


def test_smart_resize_cuts_after_resizing(spark):
    r = spark.createDataFrame([(10, 100_000), (28, 28), (4000, 3000)], "h long, w long").select(T.smart_resize(F.col("h"), F.col("w")).alias("r")).select("r.*").collect()
    assert (r[0].height, r[0].width) == (0, 0) or r[0].width <= 200 * r[0].height
    assert all(x.height * x.width <= 1280 * 28 * 28 for x in r) and r[1].height == r[1].width == 448


@pytest.mark.parametrize("n", [61, 62, 500])
@pytest.mark.parametrize("local", [0, 1 << 20])
def test_components_of_ascending_paths(spark, n, local):
    c = components(spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst"), local=local)
    assert c.count() == n and c.filter("component <> 0").count() == 0


def test_pagerank_stops_by_tolerance(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 3.0)], "src string, dst string, w double")
    near = {r.id: r.rank for r in iterative.pagerank(e, 100, weight="w", tolerance=1e-9).collect()}
    far = {r.id: r.rank for r in iterative.pagerank(e, 60, weight="w").collect()}
    assert all(abs(near[k] - far[k]) < 1e-3 for k in far) and near["c"] > near["a"]


def test_entry_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
