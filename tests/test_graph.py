import itertools
import random

from pyspark.sql import functions as F

from lectern.operators import dedup, graph, iterative, retrieval, selection
from lectern.operators.components import components


def random_edges(n, m, seed):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def reach(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        seen, todo = {s: 0}, [s]
        for x in todo:
            for y in near[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        out[s] = seen
    return out


def test_components_and_distances(spark):
    edges = random_edges(40, 30, 1)
    found = {r.node: r.component for r in components(frame(spark, edges)).collect()}
    expected = reach(edges)
    assert found == {s: min(seen) for s, seen in expected.items()}
    ids = spark.createDataFrame([(s,) for s in expected], "id long")
    got = {(r.source, r.id): r.d for r in iterative.distances(frame(spark, edges), ids).collect()}
    assert got == {(s, t): d for s, seen in expected.items() for t, d in seen.items()}


def test_components_of_a_long_path(spark):
    found = components(frame(spark, [(i, i + 1) for i in range(60)]))
    assert {r.component for r in found.collect()} == {0} and found.count() == 61


def test_no_links(spark):
    assert components(frame(spark, []).limit(0)).count() == 0


def test_triangles_and_clustering(spark):
    edges = random_edges(14, 40, 2)
    have = set(edges)
    expected = [t for t in itertools.combinations(range(14), 3) if all(p in have for p in itertools.combinations(t, 2))]
    assert sorted(tuple(r) for r in graph.triangles(frame(spark, edges)).collect()) == expected
    for r in graph.clustering(frame(spark, edges)).collect():
        d = sum(r.id in e for e in edges)
        t = sum(r.id in x for x in expected)
        assert r.triangles == t and abs(r.clustering - (2 * t / (d * (d - 1)) if d > 1 else 0)) < 1e-12


def test_betweenness_of_a_star(spark):
    got = {r.id: r.betweenness for r in iterative.betweenness(frame(spark, [(0, i) for i in range(1, 6)])).collect()}
    # each pair of leaves counts in both directions over (n - 1)(n - 2)
    assert abs(got[0] - 1.0) < 1e-9 and all(got[i] == 0 for i in range(1, 6))


def test_pagerank_against_dense_rounds(spark):
    edges = random_edges(12, 20, 3)
    nodes = sorted({x for e in edges for x in e})
    near = {x: [b if a == x else a for a, b in edges if x in (a, b)] for x in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(6):
        rank = {x: 0.15 / len(nodes) + 0.85 * sum(rank[y] / len(near[y]) for y in near[x]) for x in nodes}
    got = {r.id: r["rank"] for r in iterative.pagerank(frame(spark, edges), 6).collect()}
    assert all(abs(got[x] - rank[x]) < 1e-9 for x in nodes)


def test_walks_follow_edges(spark):
    edges = random_edges(20, 40, 4)
    both = set(edges) | {(b, a) for a, b in edges}
    starts = spark.createDataFrame([(i, edges[i][0]) for i in range(6)], "walk long, id long")
    rows = iterative.random_walks(frame(spark, edges), starts, 5).collect()
    paths = {}
    for r in rows:
        paths.setdefault(r.walk, {})[r.step] = r.id
    assert all((p[k], p[k + 1]) in both for p in paths.values() for k in range(len(p) - 1)) and len(rows) == 30


def test_combinations_agree(spark):
    r = random.Random(5)
    rows = sorted({(f"t{r.randrange(8)}", f"e{r.randrange(12)}") for _ in range(60)})
    b = spark.createDataFrame(rows, "title string, entity string")
    sets = {}
    for t, e in rows:
        sets.setdefault(t, set()).add(e)
    expected = sorted((*c, n) for c in itertools.combinations(sorted(sets), 3) if (n := len(set.intersection(*(sets[x] for x in c)))) >= 2)
    assert sorted(tuple(x) for x in selection.combinations(b, 3, 2).collect()) == expected
    assert sorted(tuple(x) for x in selection.combinations_fpgrowth(b, 3, 2).collect()) == expected


def test_contraction_keeps_frequency(spark):
    nodes = spark.createDataFrame([(i, "x", 2, [f"a{i % 2}"]) for i in range(5)], "id long, node_type string, frequency long, articles array<string>")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 4.0), (3, 4, 1.0)], "src long, dst long, weight double")
    merged, kept = dedup.contract(nodes, edges, spark.createDataFrame([(0, 1)], "a long, b long"))
    assert merged.agg(F.sum("frequency")).first()[0] == 10 and merged.count() == 4
    assert sorted(tuple(r) for r in kept.collect()) == [(0, 2, 6.0), (3, 4, 1.0)]


def test_entity_records(spark):
    rows = [("A", ["x", " ", "y"], ["z"]), ("B", ["x"], None)]
    e = graph.unpivot_entities(spark.createDataFrame(rows, "title string, m array<string>, d array<string>"), "title", ["m", "d"])
    assert sorted((r.article, r.entity_type, r.entity) for r in e.collect()) == [("A", "d", "z"), ("A", "m", "x"), ("A", "m", "y"), ("B", "m", "x")]
    kinds = {(r.src, r.dst): r.edge_type for r in graph.article_edges(e).filter("article = 'A'").collect()}
    assert kinds[("x", "y")] == "same_type" and kinds[("x", "z")] == "cross_type" and kinds[("A", "x")] == "contains"


def test_approximate_pairs_are_true_pairs(spark):
    r = random.Random(6)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    rows = [(i, [x + r.gauss(0, 0.01) for x in base[i % 10]], 0) for i in range(20)]
    v = spark.createDataFrame(rows, "id long, v array<double>, k int").withColumn("v", dedup.unit("v"))
    got = {(x.a, x.b) for x in dedup.approximate_pairs(v, 0.95, "id", "v", "k").collect()}
    assert {(i, i + 10) for i in range(10)} & got and all(b - a == 10 for a, b in got)


def test_nearest_by_tiles_against_brute_force(spark):
    r = random.Random(8)
    rows = [(i, [round(r.gauss(0, 1), 1) for _ in range(3)], i % 2) for i in range(120)]
    rows += [(200 + i, [0.5, -0.5, 1.0], 1) for i in range(60)] + [(7, [9.0, 9.0, 9.0], 1), (400, [float("nan"), 1.0, 1.0], 0), (401, None, 0), (402, [-40.0, 0.0, 0.0], 2), (403, [40.0, 0.0, 0.0], 2)]
    v = spark.createDataFrame(rows, "id long, v array<double>, b int").repartition(5)

    def dots(x, y):
        total = 0.0
        for p, q in zip(x, y):
            total += p * q
        return total

    def order(pair):
        sim = pair[0]
        return (2, 0, pair[1]) if sim is None else (0, 0, pair[1]) if sim != sim else (1, -sim, pair[1])

    def brute(asked, same_block, own):
        found = {}
        for i, x, b in asked:
            found.setdefault(i, []).extend((None if x is None or y is None else dots(x, y), j) for j, y, c in rows if (b == c or not same_block) and (own or i != j))
        return {(i, *map(str, p)) for i, pairs in found.items() for p in sorted(pairs, key=order)[:4]}

    assert {(x.id, str(x.sim), str(x.nbr)) for x in dedup.neighbours(v, 4, "id", "v", "b").collect()} == brute(rows, True, False)
    q = v.filter("b = 1").select(F.col("id").alias("query_id"), "v")
    assert {(x.query_id, str(x.score), str(x.id)) for x in retrieval.top_k(q, v, 4, "id", "v").collect()} == brute([x for x in rows if x[2] == 1], False, True)


def test_nearest_meets_tiles_not_pairs(spark):
    v = spark.range(300).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), F.lit(0).alias("b"))
    plan = dedup.neighbours(v, 3, "id", "v", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(zip_with" not in plan


def test_distances_reach_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(66)], "src long, dst long").coalesce(1)
    got = iterative.distances(edges, spark.createDataFrame([(0,)], "id long"))
    assert got.agg(F.max("d")).first()[0] == 66
