import json
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import external
from lectern.functions import text
from lectern.operators import evaluation, lookup, retrieval, scheduling
from lectern.sources import parsers, readers, sinks
from lectern.streaming import monitor


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, text.normalise("v"), "  A  b,  c! ") == "a b c"
    assert one(spark, text.normalise("v"), None) == ""
    assert one(spark, text.slug("v"), " Oral / Main ") == "Oral_Main" and one(spark, text.slug("v"), " ") == "unknown"
    assert one(spark, text.url_basename("v"), "http://x.org/a/b.pdf?q=1") == "b.pdf"
    assert one(spark, text.answer("v"), "a <answer> 7 </answer>") == "7" and one(spark, text.answer("v"), "none") is None
    assert one(spark, text.first_fence("v"), 'see\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.markdown_links("v"), "[a](http://x) [b](y)") == ["http://x", "y"]


def test_chunks_cover_the_text(spark):
    texts = ["", "a" * 500, "".join(chr(97 + i % 26) for i in range(1234)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for i, t in enumerate(texts):
        parts = [r.chunk for r in retrieval.chunks(df.filter(F.col("id") == i), "id", "text").orderBy("pos").collect()]
        assert parts == [] if not t else "".join([parts[0], *(p[100:] for p in parts[1:])]) == t


def test_budget(spark):
    df = spark.createDataFrame([(1, p, "x" * 40) for p in range(5)], "id long, pos int, chunk string")
    got = retrieval.within_budget(df, "id", ["pos"], "chunk", 100).orderBy("pos").collect()
    assert [len(r.chunk) for r in got] == [40, 40, 20]


def test_lookup(spark):
    titles = spark.createDataFrame([("Deep Nets", 1), ("deep nets ", 2), ("Graphs", 3)], "title string, n int")
    q = spark.createDataFrame([(" DEEP nets",), ("Graph",), ("none",)], "q string")
    assert {r.q: r.n for r in lookup.exact(q, "q", titles, "title", "n").collect()} == {" DEEP nets": 2, "Graph": None, "none": None}
    assert {r.q: r.n for r in lookup.containing(q, "q", titles, "title", "n").collect()} == {" DEEP nets": 1, "Graph": 3}


def test_scheduling(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(10)], "id long")
    assert [r.n for r in scheduling.numbered(df, "id").orderBy("id").collect()] == list(range(10))
    assert [r.worker for r in scheduling.split(df, 3, "id").orderBy("id").collect()] == [1] * 4 + [2] * 4 + [3] * 2


def test_scores(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "q string, i string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "c"), ("r", "z")], "q string, i string")
    got = {r.q: r for r in evaluation.ranking_scores(ranked, gold, "q", "i").collect()}
    assert got["q"].recall == 0.5 and got["r"].ndcg == 0.0


def test_readers_and_sinks(spark, tmp_path):
    schema = T.StructType([T.StructField("question", T.StringType()), T.StructField("n", T.LongType())])
    (tmp_path / "in.jsonl").write_text('{"question": "a", "n": 1}\n\nbroken\n{"question": " ", "n": 2}\n{"question": "a", "n": 3}\n')
    rows = readers.tolerant_lines(spark, str(tmp_path / "in.jsonl"), schema, ("question",))
    assert sorted(r.n for r in rows.collect()) == [1, 3]
    assert readers.last_per_question(rows, "question", "n").first().n == 3
    sinks.write_lines(rows, str(tmp_path / "out"))
    assert readers.directory_lines(spark, str(tmp_path), schema).count() >= 2
    (tmp_path / "tree/conf/p1").mkdir(parents=True)
    (tmp_path / "tree/conf/p1/metadata.json").write_text(json.dumps({"id": "1", "title": "T", "session": "S"}))
    (tmp_path / "tree/results").mkdir()
    (tmp_path / "tree/results/metadata.json").write_text(json.dumps({"title": "left out"}))
    (tmp_path / "tree/conf/p1/deep").mkdir()
    (tmp_path / "tree/conf/p1/deep/a.md").write_text("# hello")
    assert [r.title for r in readers.metadata_tree(spark, str(tmp_path / "tree")).collect()] == ["T"]
    doc = readers.corpus(spark, str(tmp_path / "tree")).collect()
    assert [(d.doc_key, d.text) for d in doc] == [("conf/p1", "# hello")]
    (tmp_path / "stop.txt").write_text("# note\nFigure 1\n\n table 2 \n")
    assert sorted(r.word for r in readers.stopwords(spark, str(tmp_path / "stop.txt")).collect()) == ["figure 1", "table 2"]


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a & b", "title"), ("c", "x")], "id string, node_type string")
    edges = spark.createDataFrame([("a & b", "c", 2)], "src string, dst string, weight int")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g"))
    file = tmp_path / "graph.graphml"
    file.write_text(next((tmp_path / "g").glob("part-*")).read_text())
    n, e = readers.graphml(spark, str(file))
    assert {r.id: r.attributes["node_type"] for r in n.collect()} == {"a & b": "title", "c": "x"}
    assert [(r.src, r.dst, r.attributes["weight"]) for r in e.collect()] == [("a & b", "c", "2")]


def test_parsers(spark):
    html = "<title>T</title><script>x</script><div>one<p>two<p>three &amp; four</div>"
    assert parsers.html_blocks(html) == ("T", ["one", "two", "three & four"]) and parsers.html_blocks(None) == ("", [])
    assert parsers.xml_skeleton("<a><b k='1'>t</b><b/></a>") == "a\n  b @k [text]"


def test_stand_ins(spark):
    df = spark.createDataFrame([("graph neural networks",), ("",)], "t string")
    vectors = [r[0] for r in df.select(external.hashed_embedding(16)(F.col("t"))).collect()]
    assert abs(sum(x * x for x in vectors[0]) - 1) < 1e-9 and sum(map(abs, vectors[1])) == 0
    assert external.backoff(3) == 8 and external.backoff(9) == 30


def test_streaming_monitor_and_append(spark, tmp_path):
    schema = "ts timestamp, phase string, v double, id long"
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' phase, 1.0D v, 1L id UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 3.0D, 2L").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = monitor.windowed(stream, "ts", "phase", "v", lateness="1 hour").writeStream.outputMode("complete").format("memory").queryName("monitored").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.samples, r.peak_memory) for r in spark.table("monitored").collect()] == [(2, 3.0)]
    for run in range(2):
        monitor.append_new(stream, str(tmp_path / "out"), str(tmp_path / f"ck{run}"), ["id"]).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    result, took = monitor.timed("x", lambda: 7, time.time)
    assert result == 7 and took["x_duration"] >= 0
