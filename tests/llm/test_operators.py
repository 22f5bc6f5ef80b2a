"""Small cases: nulls, empty and long texts, repeated rows, ties, empty tables, and columns with clashing names."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import archives, hidden_markov, language, neighbours, pieces, postings, private_data, simhash, token_planes, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"word{i % 97}" for i in range(20_000))
TEXTS = ["The cat sat.", "", None, "The cat sat.", "  two  spaces ", "日本語 ▁ \U0001f642", LONG, "x" * 3000, "\n\t a\nb", "123 a@b.example.com"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 7 else i, t, "en" if i % 2 else None, f"s{i}", 1, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string").withColumns({c: F.lit(1) for c in ("fp", "rank", "slice", "word", "row", "component")})


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = pieces.PieceModel(path)
    r = random.Random(1)
    cases = [t or "" for t in TEXTS] + ["".join(r.choice("abcdehnrst ▁éß日\n.1") for _ in range(r.randint(1, 60))) for _ in range(400)]
    for t in cases:
        ids = sp.encode(t)
        assert model.encode(t) == ids and model.decode(ids) == sp.decode(ids)
    got = pieces.round_trip(docs, path)
    want = []
    for row in docs.select("doc_id", "text").collect():
        ids = [*sp.encode(row.text or ""), 2]
        want.append((row.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert plain(got.collect()) == sorted(want, key=str)
    assert pieces.round_trip(docs.limit(0), path).count() == 0
    back = pieces.decode_documents(pieces.encode_documents(docs, path), path).filter("doc_id = 6").first().text
    assert back == LONG


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, at, want = Tokenizer.from_file(path), 0, []
    for row in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*t.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((row.doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    for unit in (1, 8):
        assert plain(token_planes.token_files(docs, path, unit=unit).collect()) == sorted(want, key=str)
    assert token_planes.token_files(docs.limit(0), path).count() == 0
    sized = token_planes.SHARD_BYTES
    token_planes.SHARD_BYTES = 4000  # many shards, in the same order
    assert plain(token_planes.token_files(docs, path).collect()) == sorted(want, key=str)
    token_planes.SHARD_BYTES = sized
    writer = token_planes.ShardWriter(3, block_ids=8)
    lists = [np.arange(n, dtype="<u4").tobytes() for n in (0, 5, 30, 1)]
    frames = [f for k, ids in enumerate(lists) for f in writer.add(k, ids)] + list(writer.close())
    assert [(d, i) for _, d, i in token_planes.read_shard(b"\n".join([*frames, b""]))] == list(enumerate(lists))


def test_language(spark):
    r, rows = random.Random(2), []
    for i in range(240):
        words = ("the and of with that", "der und die nicht das")[i % 2].split()
        rows.append((i, " ".join(r.choice(words) for _ in range(30)), ("en", "de")[i % 2]))
    rows += [(900, None, "en"), (901, "12 !", "en"), (902, "", None), (903, "the and of", None), (903, "the and of", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.identify(d).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(240))
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"] and all(0 <= x.score <= 1 for x in got.values())
    assert got[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    assert language.identify(d.filter("lang IS NULL")).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(d.limit(0)).count() == 0
    kept = language.keep_identified(d.withColumn("score", F.lit("clash")))
    assert kept.columns[-1] == "score" and kept.count() == 242


def test_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(70, 6))
    x[20:40] = x[20]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 6), (102, [float("nan")] * 6), (103, [None] * 6), (104, []), (5, x[5].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, d.filter("vec_id % 10 = 0"), 7).collect()
    for q in range(0, 70, 10):
        s = (x[q] * x).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(70), -s))[:7]
        assert [(g.vec_id, g.score) for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == [(int(b), float(s[b])) for b in best]
    assert neighbours.nearest(d.limit(0), d.limit(0)).count() == 0
    few = neighbours.nearest(d.filter("vec_id < 3"), d.filter("vec_id = 0"), 7)
    assert few.count() == 2


def test_neighbours_of_repeated_ids(spark):
    r = np.random.default_rng(12)
    x = r.normal(size=(300, 8))
    x[200:] = x[:100] * 0.999  # the second vector of an id
    ids = np.r_[np.arange(200), np.arange(100)]
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x) for _ in range(4)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, d.filter("vec_id IN (150, 160, 199)"), 20).collect()
    for q in (150, 160, 199):
        s = np.full(200, -np.inf)
        np.maximum.at(s, ids, (x[q] * x).sum(1))
        s[q] = -np.inf
        assert [g.vec_id for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == np.lexsort((np.arange(200), -s))[:20].tolist()


def test_equal_vectors_keep_distinct_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(6) for _ in range(9)] + [(9, [2.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, d.filter("vec_id = 9"), 4).collect()
    assert sorted((g.rank, g.vec_id) for g in got) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_neighbours_in_a_cluster_that_int8_cannot_part(spark):
    r = np.random.default_rng(14)
    x = np.r_[1 + 1e-4 * r.normal(size=(900, 16)), r.normal(size=(300, 16))]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, d.filter("vec_id % 100 = 0"), 10).collect()
    for q in range(0, 1200, 100):
        s = neighbours._in_order(np.repeat(x[q : q + 1], len(x), 0), x)
        s[q] = -np.inf
        assert [g.vec_id for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == np.lexsort((np.arange(len(x)), -s))[:10].tolist()


def test_neighbours_int8_bound():
    r = np.random.default_rng(4)
    a, b = r.normal(size=(50, 9)), r.normal(size=(60, 9)) * 10
    (qa, sa, ra, fa), (qb, sb, rb, _) = neighbours.quantise(a), neighbours.quantise(b)
    tile = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb[None, :]
    assert (np.abs(tile - a @ b.T) <= fa[:, None] * rb[None, :] + ra[:, None] * np.linalg.norm(b, axis=1)[None, :] + 1e-9).all()


def brute_hits(texts, items):
    windows = {}
    for item, text in items:
        w = postings.words_of(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(item))
    out = []
    for doc, text in texts:
        w, hit, found = postings.words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if o := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= o
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, part_bytes):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(40)] + [(r_.doc_id, r_.text) for r_ in docs.select("doc_id", "text").collect()]
    items = [(1, " ".join(r.choice("abc") for _ in range(14))), (2, "A b, c"), (2, "cat SAT"), (3, None), (4, ""), (5, rows[4][1])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert plain(postings.decontaminate(d, b, part_bytes=part_bytes).collect()) == brute_hits(rows, items)


def test_decontamination_edges_and_proximity(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert postings.decontaminate(docs, none).filter("contaminated").count() == 0
    assert postings.decontaminate(docs.limit(0), none).count() == 0
    assert postings.keep_clean(docs, spark.createDataFrame([(1, "the cat sat")], "item_id long, text string")).count() == len(TEXTS) + 1 - 3
    d = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x b"), (4, "a")], "doc_id long, text string")
    index = postings.build_index(d)
    assert sorted(r.doc_id for r in postings.proximity_hits(index, ["a", "b"], 4).collect()) == [1, 2]
    assert postings.proximity_hits(index, ["a", "none"], 4).count() == 0


def test_phrases_of_frequent_words_in_slices(monkeypatch):
    r = random.Random(15)
    words = [r.choice([b"a", b"b", b"c"]) for _ in range(4000)]
    names = sorted(set(words))
    lists = [np.array([i for i, w in enumerate(words) if w == n], np.int32) for n in names]
    seg = postings.Segment(names, np.cumsum([0, *map(len, lists)]), np.concatenate(lists), len(words))
    find = postings.Phrases([("1", " ".join(r.choice("abc") for _ in range(300))), ("2", b" ".join(words[50:80]).decode()), ("3", "a b")])
    whole = plain(zip(*seg.phrases(find)))
    monkeypatch.setattr(postings, "SLICE", 2000)
    assert plain(zip(*seg.phrases(find))) == whole
    numbers = [find.vocabulary[w] for w in words]
    want = [(k, row) for row, w in enumerate(find.windows) for n in [find.lengths[row]] for k in range(len(words) - n + 1) if numbers[k : k + n] == w[:n].tolist()]
    assert whole == plain(want)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(spark, version):
    blocks = [(" http://x/ y", b"HTTP/1.1 200 OK\r\n\r\nbody\nfiledesc://x 1 2 3 4\n"), (None, b"no http")]
    records = list(archives.read_arc(io.BytesIO(archives.arc_bytes(iter(blocks), "n", version))))
    assert [r.block for r in records] == [b for _, b in blocks] and records[0].url == "http://x/%20y"
    stream = b"\n".join([*map(archives.convert, records), b""])
    fields = [f for f, _ in archives.read_warc(io.BytesIO(stream))]
    assert [f["warc-type"] for f in fields] == ["response", "resource"] and fields[0]["warc-date"] == "2024-01-01T00:00:00Z"
    assert len({f["warc-record-id"] for f in fields}) == 2


def test_page_archives(spark):
    rows = [(4, "u", "same"), (2, "u", "same"), (9, "u", None), (7, None, ""), (1, "v w", "WARC/1.1\r\n\r\n"), (2, "u", "same"), (None, "n", "same"), (5, "u", "é" * 9000)]
    got = archives.page_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_key", F.lit(1)))
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = min(p for p, _, h in rows if p is not None and (h or "") == (html or ""))
        want.append((page, len(raw), archives.base32_sha1(raw), "response" if page == first else "revisit", None if page == first else first))
    assert plain(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == sorted(want, key=str)
    assert archives.page_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_of_several_files_a_task(spark, monkeypatch):
    monkeypatch.setattr(archives, "FILE_RECORDS", 7)
    d = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "concat('body ', id % 30) AS html").coalesce(1)
    got = archives.page_archives(d)
    assert got.filter("record_type = 'response'").count() == 30 and got.filter("refers_to = page_id - 30").count() == 10


def test_simhash(spark, docs):
    r = random.Random(6)
    base = [[r.choice("abcdefgh") + str(r.randrange(60)) for _ in range(200)] for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(i // 20):
            w[r.randrange(200)] = "new"
        rows.append((i + 100, " ".join(w)))
    rows += [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=16).collect()
    import pyarrow as pa

    prints = {i: int(f) for i, f in zip(range(len(rows)), simhash.fingerprints_of(pa.array([t or "" for _, t in rows])))}
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = [i for i, (d, _) in enumerate(rows) if d is not None]
    for i in linked:
        for j in linked:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i in linked:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    want = [(rows[i][0], f"{prints[i]:016x}", least[root(i)] if rows[i][0] is not None else None) for i in range(len(rows))]
    assert plain(got) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_at_the_jaccard_bound(spark, docs):
    r, rows = random.Random(13), []
    common = " ".join(f"licence{k}" for k in range(12))
    for g in range(12):
        base = [f"{r.choice('abcdef')}{r.randrange(300)}" for _ in range(r.choice([8, 40, 120]))]
        for k in range(8):
            w = list(base)
            for _ in range(k % 5):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((g * 8 + k, " ".join(w) + (f" {common}" if g % 2 else "")))
    rows += [(500 + k, f"{common} tail{k}") for k in range(6)] + [(5, "another text of that id"), (5, rows[5][1]), (200, rows[9][1].upper()), (None, rows[9][1])]
    rows += [(700 + (x.doc_id or 0), x.text) for x in docs.select("doc_id", "text").collect()]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    named = [i for i, (d, _) in enumerate(rows) if d is not None]
    for i in named:
        for j in named:
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i in named:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash.keep_distinct(d)
    small = simhash.keep_distinct(d, tile=16, set_bytes=6000)  # many tiles, some of one set
    assert plain(small.select("doc_id").collect()) == plain(got.select("doc_id").collect())
    assert sorted(x.doc_id for x in got.collect() if x.doc_id is not None) == sorted(least.values())
    assert got.filter("doc_id is null").count() == 1 and len(least) < 90
    assert simhash.keep_distinct(docs.limit(0)).count() == 0 and simhash.keep_distinct(docs).columns == docs.columns


def test_tiles_travel_in_small_pieces(spark, docs):
    rng = np.random.default_rng(3)
    rows = [(k, 50, rng.bytes(64), rng.bytes(400)) for k in range(120)]
    d = spark.createDataFrame(rows, "node long, n long, fp binary, set binary")
    tiles = simhash.tile_table(d, ["n", "node"], 8, 1 << 15, 2, lambda x, _: (0, 0), 20_000, 2000)
    pairs = simhash.tile_pairs(tiles, 512, 1)
    assert pairs.select(F.max(F.length("body") + F.length("sets"))).first()[0] <= 2000 + 480
    met = list(simhash.met_tiles(pairs.coalesce(1).sortWithinPartitions("ta", "tb", "side", "piece").toArrow().to_batches(), 2, 8))
    assert sum(len(x) for same, (x, _), _, _ in met if same) == 120 and len(met) == 6  # three tiles
    sets = {k: s for k, _, _, s in rows}
    for _, tables, _, flat in met:
        for x, s in zip(tables, flat):
            assert s.tobytes() == b"".join(sets[k] for k in x[:, 0])
    some = docs.limit(300)
    kept = [{r.doc_id for r in simhash.keep_distinct(some, tile=16, set_bytes=6000, piece=p).collect()} for p in (1, 500, 1 << 20)]
    assert kept[0] == kept[1] == kept[2]


def test_pipeline_drops_near_copies_of_five_word_shingles(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{k}" for k in range(100)]
    near = " ".join(words[:50] + ["other", "words"] + words[52:])
    d = spark.createDataFrame([(1, " ".join(words)), (2, near), (3, "a text of its own that stays")], "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, d, "").collect()) == [1, 3]


def test_hidden_markov(spark, docs):
    r, rows = random.Random(7), []
    for i in range(120):
        words = ("ab ac ad ae", "za zb zc zd")[i % 2].split()
        rows.append((i, " ".join(r.choice(words) for _ in range(20)) + f" rare{i % 50} only{i}"))
    rows += [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect() if x.doc_id != 6]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = hidden_markov.score_documents(d, head=6, known=12, states=2, rounds=6).collect()
    words = [(t or "").encode().lower().split() for _, t in rows]
    train = [w for (i, _), w in zip(rows, words) if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    counts = {}
    for w in train:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1

    def base(c):
        return np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))

    want = sorted([(i, len(w) + 1, sum(x in counts for x in w) + 1, round(sum(base(counts.get(x, 0)) for x in w) + base(len(train)), 6)) for (i, _), w in zip(rows, words)], key=str)
    assert sorted([(g.doc_id, g.n_tokens, g.n_known, round(g.base_score, 6)) for g in got], key=str) == want and {g.train_tokens for g in got} == {total}
    held = [g for g in got if g.held_out and g.n_tokens == 23]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)
    assert hidden_markov.score_documents(d.limit(0)).count() == 0


def test_forward_sums_over_all_paths():
    r = np.random.default_rng(8)
    chain = hidden_markov.Chain(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.4, 0.6]]), (e := r.random((5, 2))) / e.sum(0))
    seqs = [[1], [0, 2, 4], [3, 3, 1, 0, 2]]
    symbols, lengths = np.concatenate(seqs).astype(np.uint16), np.array(list(map(len, seqs)))
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths)
    got = np.zeros(3)
    got[order] = hidden_markov.forward(chain, symbols, starts[order], lengths[order])
    import itertools

    for k, s in enumerate(seqs):
        p = sum(chain.start[z[0]] * np.prod([chain.emit[a, b] for a, b in zip(s, z)]) * np.prod([chain.move[a, b] for a, b in zip(z, z[1:])]) for z in itertools.product(range(2), repeat=len(s)))
        assert abs(got[k] - np.log10(p)) < 1e-10


def test_toxicity(spark):
    r, rows, labels = random.Random(9), [], []
    plain_words = [a + b + c for a in ("ta", "re", "mo", "li") for b in ("ne", "so", "da") for c in ("r", "n", "st", "m")]
    for i in range(400):
        w = [r.choice(plain_words) for _ in range(40)]
        if i % 4 == 0:
            for k in (5, 20, 30):
                w[k] = r.choice(["grobian", "schurken", "halunken"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (5, rows[5][1])]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (900, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(d, lab).collect()}
    held = [got[i] for i in range(400) if got[i].held_out]
    assert np.mean([x.predicted == (x.doc_id % 4 == 0) for x in held]) > 0.95
    assert got[900].score == got[901].score and got[900].predicted == 0 and all((x.score >= 0.3) == bool(x.predicted) for x in got.values())
    assert {x.score for x in toxicity.toxicity(d, lab.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), lab).count() == 0


def test_toxicity_sample_of_repeated_ids(spark):
    rows = [(i, "plain words of an ordinary text") for i in range(8) for _ in range(40)] + [(100 + i, "grobian schurken halunken") for i in range(8)]
    labels = [(i, 0) for i in range(8)] + [(100 + i, 1) for i in range(8)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.train(d, lab, sample=8) is not None


def test_private_data(spark, docs):
    text = "mail a.b@c.example.com, host 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111, +1 (416) 555-0199 end"
    rows = [(1, text), (2, None), (3, ""), (1, text), (4, "a" * 50_000 + "@"), (5, "1" * 50_000)]
    got = private_data.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = [g for g in got if g.doc_id == 1]
    assert len(first) == 2 and [(g.n_email, g.n_ip, g.n_card, g.n_phone) for g in first] == [(1, 1, 1, 1)] * 2
    spelled = private_data.spelled(private_data.base_spans(text))
    assert first[0].base_sha256 == hashlib.sha256(spelled.encode()).hexdigest() and set(spelled.split(",")) <= set(first[0].spans.split(","))
    assert all((g.n_email, g.n_ip, g.n_card, g.n_phone) == (0, 0, 0, 0) for g in got if g.doc_id != 1)
    assert private_data.find_private(docs.limit(0)).count() == 0
    masked = private_data.mask_private(docs)
    assert masked.columns == docs.columns and masked.filter("doc_id = 9").first().text == "123 <EMAIL>"


def test_network_learns_and_its_gradient_is_right():
    x, y = private_data.examples(["call 10.0.0.1 now", "plain words only"], least=120)
    tagger = private_data.Tagger.new()
    _, grads = tagger.gradients(x[:4, :10], y[:4, :10])
    for name, at in (("out", (3, 2)), ("move", (0, 1)), ("fh", (1, 5)), ("bb", (7,))):
        tagger.p[name][at] += 1e-5
        up, _ = tagger.gradients(x[:4, :10], y[:4, :10])
        tagger.p[name][at] -= 2e-5
        down, _ = tagger.gradients(x[:4, :10], y[:4, :10])
        tagger.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5
    losses = tagger.fit(x, y, steps=40)
    assert np.mean(losses[-5:]) < losses[0] / 5


def test_patterns_equal_the_plain_expressions():
    import re

    plain_patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    r = random.Random(16)
    for _ in range(4000):
        text = "".join(r.choice("0123456789" * 2 + "..--  @@+()ab%é\n") for _ in range(r.randint(0, 60)))
        want = []
        for kind, pattern in enumerate(plain_patterns):
            for m in re.finditer(pattern, text):
                d = re.sub("[^0-9]", "", m.group())
                total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
                ok = (True, kind != 1 or all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and total % 10 == 0, 9 <= len(d) <= 15)[kind]
                if ok:
                    want.append((m.start(), kind, m.end()))
        assert private_data.base_spans(text) == sorted(want)


def test_network_adds_spans_that_no_pattern_has():
    r = random.Random(17)
    words = "the river runs under a stone bridge and then it is gone with that old cat of mine , who knows".split()

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    tagger = private_data.Tagger.new()
    tagger.fit(*private_data.examples([prose(12)[:64] for _ in range(300)]))
    met, all_of = [0] * 4, [0] * 4
    for k in range(240):
        kind, s = private_data._invented(r)
        v = private_data._variant(kind, s, r)
        head = prose(r.randint(2, 40)) + " "
        text = f"{head}{v} {prose(20)}"
        base = private_data.base_spans(text)
        if any(e > len(head) for _, _, e in base):
            continue
        added = private_data.with_added(base, private_data.found_by(tagger, [text])[0])
        all_of[kind] += 1
        met[kind] += any(i == kind and b < len(head) + len(v) and e > len(head) for b, i, e in added)
    assert all(m >= 0.9 * n and n > 20 for m, n in zip(met, all_of)), (met, all_of)
    # a span over the seam of two windows is one span, wherever it lies
    for shift in range(20, 50):
        text = "x" * shift + " 416.555.0199 " + prose(10)
        assert (shift + 1, 3, shift + 13) in private_data.found_by(tagger, [text])[0]


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    passage = " ".join(f"passage{i}" for i in range(20))
    r = random.Random(10)
    prose = [" ".join(r.choice(["the", "cat", "with", "that", "river", "stone", "walks", "under"]) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose)]
    rows += [(100, prose[0], "en", "s", 1), (101, "12345", "en", "s", 5), (102, None, None, None, None), (103, prose[1] + " " + passage, "en", "s", 1), (104, prose[2] + " x y z q@mail.example.com", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {100, 101, 102, 103} & set(out) and set(range(30)) - {2} <= set(out)
    assert all(out[i].decoded == prose[i] for i in range(30) if i in out)
    if 104 in out:
        assert "<EMAIL>" in out[104].decoded
