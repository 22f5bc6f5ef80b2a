"""Operator 6: SimHash fingerprints and exact near-duplicate groups by tiled comparison.

Fingerprints are kept once each, ordered by their population counts (the whole, then each 16-bit lane) and cut
into tiles. Two fingerprints within the radius differ by no more than the radius in the sum over lanes of the
population counts' differences, so a pair of tiles whose counts lie further apart is skipped, and so is each
pair of small runs inside them. What is left is compared by exclusive-or and bit counts. A pair of tiles gives
the links of a spanning star of each group it sees, not all pairs, so a large group stays linear in its tiles.

near_duplicates() links 64-bit fingerprints within a radius of 3. keep_distinct() removes near copies by the sets of
five-word shingles: fingerprints of WIDE_LANES words of 64 bits, compared tile by tile as above (tiles are also skipped
by the sizes of the sets), find the pairs whose similarity may be 0.8 or more, and the sets themselves decide on those.
See keep_distinct() for its rounds and what the radius can miss.

Null texts count as empty: they have no shingle, fingerprint zero, and link like any other. Rows without an id are
fingerprinted, but carry no link and have no component. Repeated ids give a row each. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import as_batch, column_of, lookup_join, staged, text_slices, texts_of
from lectern.operators.components import components
from lectern.staging import dropped

#: Fingerprints of a tile, and of the runs that are skipped or compared inside it.
TILE = 16_384
RUN = 256
#: Comparisons of fingerprints that make a task.
TASK_WORK = 1 << 27
#: Near copies: words of a shingle, the least similarity as a fraction, 64-bit words of a fingerprint.
WIDE_SIZE = 5
SIMILAR = (4, 5)
WIDE_LANES = 8
#: The most bits that fingerprints of near copies may differ in, and in their first word. At a similarity of 0.8 a bit
#: differs with a probability of 0.152 (of 0.188 for sets of 4 and 5), so 78 of 512 with a deviation of 8.
WIDE_RADIUS, FIRST_RADIUS = 112, 24
#: Sets of fewer shingles can't reach the similarity without being equal.
LEAST_SET = 4
#: Bytes of sets that a tile holds, of a piece in which tiles travel, and of the tiles that a task meets.
SET_BYTES = 8 << 20
PIECE = 1 << 20
TASK_BYTES = 16 << 20
#: Spark reads a row group of up to 4,096 rows at once, so groups of large rows are kept small.
SMALL_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}
#: Pairs whose fingerprints are compared in full at once.
PAIRS = 1 << 16
#: Bits of the filter through which documents pass whose sets are asked for.
FILTER_BITS = 1 << 24
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def fingerprints_of(texts: pa.Array, size: int = 3, seed: int = 42) -> np.ndarray:
    """Of each text the 64-bit fingerprint over its lower-cased (A-Z) word shingles."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in pc.cast(texts, pa.binary()).to_pylist():
        words = text.lower().split()  # bytes: ASCII letters and white space only
        if len(words) >= size:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
        else:
            shingles = [b" ".join(words)] if words else []
        before = len(hashes)
        hashes += [digest(s, seed) for s in shingles]
        counts.append(len(hashes) - before)
    n = np.array(counts, np.int64)
    h = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    owner = np.repeat(np.arange(len(n)) * 256, n)
    out = np.zeros((len(n), 8), np.uint8)
    for k in range(8):
        seen = np.bincount(owner + h[:, k], minlength=256 * len(n)).reshape(-1, 256).astype(np.float32)
        out[:, k] = np.packbits(2 * (seen @ _BITS) > n[:, None], axis=1, bitorder="little")[:, 0]
    return out.view("<u8").reshape(-1)


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long with the same bits."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in text_slices(batches, text_col):
            fp = fingerprints_of(texts_of(batch, text_col), size).view(np.int64)
            yield as_batch(**{id_col: column_of(batch, id_col), "fp": pa.array(fp, pa.int64())})

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def lane_counts(fp: np.ndarray) -> np.ndarray:
    """Population counts: of the 16-bit lanes of one word, or of each word of wider fingerprints (rows, words)."""
    if fp.ndim == 2 and fp.shape[1] > 1:
        return np.bitwise_count(fp).astype(np.int16)
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _local_components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Join label (the least index of each group) along the links a-b, in place."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _runs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.arange(0, len(fp), RUN)
    lanes = lane_counts(fp)
    return starts, np.minimum.reduceat(lanes, starts), np.maximum.reduceat(lanes, starts)


def close_pairs(a_fp: np.ndarray, b_fp: np.ndarray | None, radius: int, first: int, sizes: tuple | None = None):
    """Yields (i, j, distance) of pairs within the radius, i of a tile and j of the same (i < j) or of another.

    Fingerprints are (rows, words); `first` bounds the difference of the first word. sizes: (of a, of b, similarity)
    leaves out runs, and pairs, whose set sizes cannot reach the similarity.
    """
    same = b_fp is None
    other = a_fp if same else b_fp
    a_at, a_lo, a_hi = _runs(a_fp)
    b_at, b_lo, b_hi = (a_at, a_lo, a_hi) if same else _runs(b_fp)
    head = np.ascontiguousarray(other[:, 0])
    if sizes:
        n_a, n_b, (top, below) = sizes
        a_least, a_most = np.minimum.reduceat(n_a, a_at), np.maximum.reduceat(n_a, a_at)
        b_least, b_most = np.minimum.reduceat(n_b, b_at), np.maximum.reduceat(n_b, b_at)
    for r, start in enumerate(a_at):
        gap = np.maximum(0, np.maximum(b_lo - a_hi[r], a_lo[r] - b_hi)).sum(1)
        near = np.flatnonzero(gap <= radius)
        if sizes:
            near = near[(below * b_most[near] >= top * a_least[r]) & (below * a_most[r] >= top * b_least[near])]
        if same:
            near = near[near >= r]
        mine = a_fp[start : start + RUN, :1]
        for k in range(0, len(near), 16):
            places = np.concatenate([np.arange(b_at[c], min(b_at[c] + RUN, len(other))) for c in near[k : k + 16]])
            i, j = np.nonzero(np.bitwise_count(mine ^ head[places][None, :]) <= first)
            i, j = i + start, places[j]
            ok = i < j if same else np.ones(len(i), bool)
            if sizes:
                ok &= below * np.minimum(n_a[i], n_b[j]) >= top * np.maximum(n_a[i], n_b[j])
            i, j = i[ok], j[ok]
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                apart = np.bitwise_count(a_fp[p] ^ other[q]).sum(1)
                ok = apart <= radius
                if ok.any():
                    yield p[ok], q[ok], apart[ok]


def tile_links(a_fp: np.ndarray, b_fp: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) places of the groups that links within a tile, or between two, make; b follows a."""
    shift = 0 if b_fp is None else len(a_fp)
    label = np.arange(len(a_fp) + (0 if b_fp is None else len(b_fp)))
    wide = [None if x is None else x.reshape(-1, 1) for x in (a_fp, b_fp)]
    for i, j, _ in close_pairs(*wide, radius, radius):
        _local_components(len(label), i, j + shift, label)
    member = np.flatnonzero(label != np.arange(len(label)))
    return label[member], member


_TILE = "tile long, piece int, rows long, bytes long, lo array<int>, hi array<int>, least int, most int, body binary, sets binary"


def tile_table(rows: DataFrame, order: list[str], lanes: int, tile: int, fields: int, reach, set_bytes: int | None = None, piece: int = PIECE) -> DataFrame:
    """Tiles of rows (columns of int64: fields, then fp, one word or binary), cut in the given order.

    A tile is a few records of about `piece` bytes or one row, so that no whole tile passes through Spark as one record;
    the first has what describes the tile.

    reach: the least and greatest place of a tile's rows (a pair of numbers), by which tiles find each other.
    set_bytes: rows have a column set (binary) too, which stays with them; a tile holds so many bytes of it, or one set.
    """

    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        sets: list[bytes] = []
        n = 0

        def out(x: np.ndarray, mine: list[bytes]):
            nonlocal seq
            pops = lane_counts(np.ascontiguousarray(x[:, fields:]).view(np.uint64))
            least, most = reach(x, pops)
            seq += 1
            sizes = np.full(len(x), x.itemsize * x.shape[1], np.int64)
            if mine:
                sizes += list(map(len, mine))
            ends = np.cumsum(sizes)
            starts = np.r_[0, np.flatnonzero(np.diff((ends - 1) // piece)) + 1]
            about = {"rows": (len(x), pa.int64()), "bytes": (int(ends[-1]), pa.int64()), "lo": (pops.min(0), pa.list_(pa.int32())), "hi": (pops.max(0), pa.list_(pa.int32())), "least": (int(least), pa.int32()), "most": (int(most), pa.int32())}
            for k, (at, to) in enumerate(zip(starts, [*starts[1:], len(x)])):
                head = {name: pa.array([None if k else value], kind) for name, (value, kind) in about.items()}
                yield as_batch(tile=pa.array([part * (1 << 32) + seq]), piece=pa.array([k], pa.int32()), **head, body=pa.array([x[at:to].tobytes()], pa.binary()), sets=pa.array([b"".join(mine[at:to])], pa.binary()))

        for batch in batches:
            front = [column_of(batch, batch.schema.names[k]).to_numpy() for k in range(fields)]
            fp = column_of(batch, "fp")
            words = (fp.to_numpy() if pa.types.is_int64(fp.type) else np.frombuffer(b"".join(fp.to_pylist()), np.int64)).reshape(-1, lanes)
            held.append(np.concatenate([np.stack(front, 1), words], 1))
            n += batch.num_rows
            if set_bytes:
                sets += column_of(batch, "set").to_pylist()
            x = np.concatenate(held)
            while n:
                fit = n if not set_bytes else max(1, int(np.searchsorted(np.cumsum(list(map(len, sets))), set_bytes, side="right")))
                if min(fit, n) < n or n >= tile:
                    cut = min(fit, tile)
                    yield from out(np.ascontiguousarray(x[:cut]), sets[:cut])
                    x, sets, n = x[cut:], sets[cut:], n - cut
                else:
                    break
            held = [x]
        if n:
            yield from out(np.concatenate(held), sets)

    # few partitions give full tiles; an eighth of a million fingerprints, or eight tiles of sets, is a light task
    if set_bytes:
        parts = -(-(rows.agg(F.sum("n")).first()[0] or 0) // set_bytes)
    else:
        parts = -(-rows.count() // (8 * tile))
    parts = max(1, parts)  # whatever the session's partitions: small tiles would meet in many pairs
    ordered = rows.repartitionByRange(parts, *order).coalesce(parts).sortWithinPartitions(*order).select(*rows.columns[:fields], "fp", *["set"][: bool(set_bytes)])
    return staged(ordered.mapInArrow(pack, _TILE), "tiles", **SMALL_GROUPS)


def tile_pairs(tiles: DataFrame, radius: int, reach: int) -> DataFrame:
    """(ta, tb, side, piece, body, sets) of the tiles whose rows may be within the radius, ta <= tb: a task has the pieces of
    a pair one after another, first those of ta (side 0), then those of tb unless it is the same. Pairs are evenly dealt.
    """
    head = tiles.filter("piece = 0").drop("piece", "body", "sets")
    a = head.select(F.col("tile").alias("ta"), F.col("rows").alias("na"), F.col("bytes").alias("ba"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.explode(F.sequence("least", "most")).alias("p"))
    b = head.select(F.col("tile").alias("tb"), F.col("rows").alias("nb"), F.col("bytes").alias("bb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.explode(F.sequence(F.col("least") - reach, F.col("most") + reach)).alias("p"))
    gaps = F.zip_with(F.arrays_zip("la", "ha"), F.arrays_zip("lb", "hb"), lambda x, y: F.greatest(F.lit(0), y["lb"] - x["ha"], x["la"] - y["hb"]))
    close = a.join(b, "p").filter("ta <= tb").filter(F.aggregate(gaps, F.lit(0), lambda s, x: s + x) <= radius)
    pairs = staged(close.select("ta", "tb", (F.col("na") * F.col("nb")).alias("work"), (F.col("ba") + F.when(F.col("ta") < F.col("tb"), F.col("bb")).otherwise(0)).alias("bytes")).distinct(), "tile-pairs")
    # the number of tasks follows the work, and what they read
    total = pairs.agg(F.sum("work").alias("work"), F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    tasks = min(total.n, max(-(-(total.work or 0) // TASK_WORK), -(-(total.bytes or 0) // TASK_BYTES)), 10_000)
    pieces, both = tiles.select("tile", "piece", "body", "sets"), pairs.select("ta", "tb")
    columns = "ta", "tb", "side", "piece", "body", "sets"
    sides = [both.filter(where).join(pieces, F.col(at) == F.col("tile")).withColumn("side", F.lit(k)).select(*columns) for k, (at, where) in enumerate((("ta", "true"), ("tb", "ta < tb")))]
    return sides[0].unionByName(sides[1]).repartition(max(tasks, 1), "ta", "tb").sortWithinPartitions("ta", "tb", "side", "piece")


def met_tiles(batches, fields: int, lanes: int):
    """(same, rows, prints, sets) of each pair of tiles whose pieces come in order: of either tile the rows, fingerprints and sets."""
    now, held = None, ([], [])

    def whole():
        same = not held[1]
        sides = held[:1] if same else held
        rows = [np.frombuffer(b"".join(x for x, _ in side), np.int64).reshape(-1, fields + lanes) for side in sides]
        sets = [np.frombuffer(b"".join(x for _, x in side), np.uint64) for side in sides]
        for side in held:
            side.clear()
        prints = [np.ascontiguousarray(v[:, fields:]).view(np.uint64) for v in rows]
        return same, *((x * 2 if same else x) for x in (rows, prints, sets))

    for batch in batches:
        columns = [column_of(batch, c) for c in ("ta", "tb", "side", "body", "sets")]
        for i in range(batch.num_rows):
            ta, tb, side, body, sets = (c[i].as_py() for c in columns)
            if now is not None and now != (ta, tb):
                yield whole()
            now = ta, tb
            held[side].append((body, sets))
    if now is not None:
        yield whole()


def near_links(classes: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(src, dst) links between representatives; classes: (rep long, fp long), one row for each fingerprint."""

    def count(lane: int):
        return F.bit_count(F.shiftright("fp", 16 * lane).bitwiseAND(0xFFFF))

    keyed = classes.select("rep", "fp", F.bit_count("fp").alias("_n"), *[count(k).alias(f"_l{k}") for k in range(4)])
    tiles = tile_table(keyed, ["_n", "_l0", "_l1", "_l2", "_l3", "fp"], 1, tile, 1, lambda _, pops: (pops.sum(1).min(), pops.sum(1).max()))

    def compare(batches):
        for same, (x, y), (a, b), _ in met_tiles(batches, 1, 1):
            root, member = tile_links(a, None if same else b, radius)
            rep = x[:, 0] if same else np.concatenate([x[:, 0], y[:, 0]])
            if len(root):
                yield as_batch(src=pa.array(rep[root]), dst=pa.array(rep[member]))

    return tile_pairs(tiles, radius, radius).mapInArrow(compare, "src long, dst long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id): component_id is the smallest id reachable by links."""
    prints = staged(fingerprint_documents(documents, id_col, text_col, size), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min(id_col).cast("long").alias("rep"), F.count("*").alias("copies")), "classes")
    found = components(near_links(classes.filter("rep is not null").select("rep", "fp"), radius, tile))
    rooted = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "copies", F.coalesce("component", "rep").alias("component_id"))
    out = lookup_join(prints, staged(rooted, "rooted"), "fp", "copies")
    component = F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component)


# --- near copies by five-word shingles -------------------------------------------------------------------------------

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = WIDE_SIZE) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles (A-Z lowered, words parted by ASCII white space).

    A shorter text is one shingle, one without words has none.
    """
    words = [t.lower().split() for t in pc.cast(texts, pa.binary()).to_pylist()]
    lengths = np.array(list(map(len, words)), np.int64)
    seen: dict[bytes, int] = {}
    flat = []
    for w in words:
        for x in w:
            h = seen.get(x)
            if h is None:
                h = seen[x] = xxhash.xxh64_intdigest(x, 42) | 1
            flat.append(h)
    h = np.array(flat, np.uint64)
    row_end = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(h))
    total = np.zeros(len(h), np.uint64)
    for k in range(size):
        at = place + k
        inside = at < row_end
        total += np.where(inside, _mixed(h[np.minimum(at, len(h) - 1)] * _ODD[k % 8] + np.uint64(k)), np.uint64(0)) if len(h) else 0
    total = _mixed(total)
    starts, n = np.cumsum(lengths) - lengths, np.where(lengths > 0, np.maximum(lengths - size + 1, 1), 0)
    return [np.unique(total[s : s + c]) for s, c in zip(starts, n)]


def wide_prints(sets: list[np.ndarray], lanes: int = WIDE_LANES) -> np.ndarray:
    """(sets, lanes) words: a bit is set if it is in over half of a set's hashes, mixed anew for each word."""
    n = np.array(list(map(len, sets)), np.int64)
    every = np.concatenate([*sets, np.empty(0, np.uint64)])
    out = np.zeros((len(n), lanes, 8), np.uint8)
    owner = np.repeat(np.arange(len(n)) * 256, n)
    for lane in range(lanes):
        h = _mixed(every + _ODD[lane]).astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            seen = np.bincount(owner + h[:, k], minlength=256 * len(n)).reshape(-1, 256).astype(np.float32)
            out[:, lane, k] = np.packbits(2 * (seen @ _BITS) > n[:, None], axis=1, bitorder="little")[:, 0]
    return out.reshape(len(n), -1).view("<u8")


def _blocks_of(sets: list[np.ndarray], most: int = 512):
    """Ranges of sets, so that counts of their bytes stay small."""
    return ((k, sets[k : k + most]) for k in range(0, len(sets), most))


def set_prints(documents: DataFrame, id_col: str, text_col: str, size: int = WIDE_SIZE, lanes: int = WIDE_LANES) -> DataFrame:
    """(id, hash of the text, node, n, fp) of every row: node stands for the set of n shingles."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in text_slices(batches, text_col):
            sets = shingle_sets(texts_of(batch, text_col), size)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = [p.tobytes() for _, some in _blocks_of(sets) for p in wide_prints(some, lanes)]
            yield as_batch(**{id_col: column_of(batch, id_col)}, hash=column_of(batch, "_hash"), node=pa.array(node), n=pa.array([len(s) for s in sets], pa.int64()), fp=pa.array(prints, pa.binary()))

    hashed = documents.filter(F.col(id_col).isNotNull()).select(id_col, text_col, F.xxhash64(text_col).alias("_hash"))
    return hashed.mapInArrow(run, f"`{id_col}` {kind}, hash long, node long, n long, fp binary")


def with_candidates(tiles: DataFrame, radius: int, first: int, similar: tuple[int, int], lanes: int = WIDE_LANES) -> DataFrame:
    """(node) of the rows (node, n) that have another within the radius, of a size that allows the similarity."""

    def run(batches):
        for same, (x, y), (a, b), _ in met_tiles(batches, 2, lanes):
            met_x, met_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
            for p, q, _ in close_pairs(a, None if same else b, radius, first, (x[:, 1], y[:, 1], similar)):
                met_x[p], met_y[q] = True, True
            yield as_batch(node=pa.array(np.concatenate([x[met_x, 0], y[met_y, 0]])))

    return tile_pairs(tiles, radius, 1).mapInArrow(run, "node long").distinct()


def shared_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many numbers each of some sorted sets has in common with one; none is empty."""
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    starts = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat(hit.astype(np.int64), starts)


def set_links(tiles: DataFrame, radius: int, first: int, similar: tuple[int, int], lanes: int = WIDE_LANES) -> DataFrame:
    """(src, dst) of nodes whose sets are similar enough: of each pair of tiles the links of a spanning star of each group."""
    top, below = similar

    def run(batches):
        for same, (x, y), (a, b), flat in met_tiles(batches, 2, lanes):
            sets = [np.split(f, np.cumsum(v[:, 1])[:-1]) for f, v in zip(flat, (x, y))]
            shift, sizes = 0 if same else len(x), y[:, 1]
            node = x[:, 0] if same else np.concatenate([x[:, 0], y[:, 0]])
            label = np.arange(len(node))
            for p, q, _ in close_pairs(a, None if same else b, radius, first, (x[:, 1], y[:, 1], similar)):
                order = np.argsort(p, kind="stable")
                p, q = p[order], q[order]
                lead = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                for i, some in zip(p[lead], np.split(q, lead[1:])):
                    some = some[label[some + shift] != label[i]]  # those in its group already need no look
                    if not len(some):
                        continue
                    both = shared_counts(sets[0][i], [sets[1][j] for j in some])
                    near = some[below * both >= top * (x[i, 1] + sizes[some] - both)]
                    _local_components(len(label), np.full(len(near), i), near + shift, label)
            member = np.flatnonzero(label != np.arange(len(label)))
            yield as_batch(src=pa.array(node[label[member]]), dst=pa.array(node[member]))

    return tile_pairs(tiles, radius, 1).mapInArrow(run, "src long, dst long")


def _size_class(top: int, below: int):
    """Places of tiles by the sizes of their sets: sizes within the similarity are a place apart at most."""
    step = np.log(below / top)
    return lambda x, _: (np.floor(np.log(x[:, 1].min()) / step), np.floor(np.log(x[:, 1].max()) / step))


def sets_of(documents: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int, bits: int = FILTER_BITS) -> DataFrame:
    """(node, set) of the nodes in wanted (id, hash, node). Documents pass a filter of fixed size, so only what may be wanted
    is hashed anew and moved.
    """
    block = 1 << 16  # bytes
    place = F.pmod(F.xxhash64(F.col(id_col), F.col("hash")), F.lit(bits))

    def mark(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = column_of(batch, "at").to_numpy()
            for b in np.unique(at >> 19):
                mine = at[at >> 19 == b] & 0x7FFFF
                np.bitwise_or.at(held.setdefault(int(b), np.zeros(block, np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        if held:
            yield as_batch(block=pa.array(list(held), pa.int32()), bits=pa.array([v.tobytes() for v in held.values()], pa.binary()))

    def unite(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(column_of(batch, "block").to_pylist(), column_of(batch, "bits").to_pylist(), strict=True):
                held[b] = held.get(b, 0) | np.frombuffer(x, np.uint8)
        if held:
            yield as_batch(block=pa.array(list(held), pa.int32()), bits=pa.array([v.tobytes() for v in held.values()], pa.binary()))

    schema = "block int, bits binary"
    table = np.zeros(bits // 8, np.uint8)
    for r in wanted.select(place.alias("at")).mapInArrow(mark, schema).repartition("block").mapInArrow(unite, schema).collect():
        table[r.block * block : (r.block + 1) * block] = np.frombuffer(r.bits, np.uint8)
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = shared.value
        seen: set[int] = set()
        for batch in text_slices(batches, text_col):
            at = column_of(batch, "_at").to_numpy()
            some = batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            sets = [s.tobytes() for s in shingle_sets(texts_of(some, text_col), size)]
            node = [xxhash.xxh64_intdigest(s) for s in sets]
            new = [k for k, x in enumerate(node) if not (x in seen or seen.add(x))]
            yield as_batch(node=pa.array(np.array(node, np.uint64).view(np.int64)[new]), set=pa.array([sets[k] for k in new], pa.binary()))

    passed = documents.filter(F.col(id_col).isNotNull()).select(text_col, F.col(id_col), F.xxhash64(text_col).alias("hash")).select(text_col, place.alias("_at"))
    found = passed.mapInArrow(run, "node long, set binary")
    return staged(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets", **SMALL_GROUPS)


def near_copies(documents: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int = WIDE_SIZE, similar: tuple[int, int] = SIMILAR, tile: int = 2 * TILE, set_bytes: int = SET_BYTES, piece: int = PIECE) -> DataFrame:
    """(node, component) of the sets that have a near copy; classes: (node, n, fp, lead), one row a set."""
    reach, bounds = _size_class(*similar), (WIDE_RADIUS, FIRST_RADIUS, similar)
    rows = classes.filter(F.col("n") >= LEAST_SET)
    tiles = tile_table(rows.select("node", "n", "fp"), ["n", "node"], WIDE_LANES, tile, 2, reach, piece=piece)
    named = staged(with_candidates(tiles, *bounds), "named")
    dropped(tiles)
    mine = staged(rows.join(named, "node", "left_semi"), "with-candidates")
    bodies = sets_of(documents, mine.select(F.col(f"lead.{id_col}").alias(id_col), F.col("lead.hash").alias("hash"), "node"), id_col, text_col, size)
    tiles = tile_table(mine.join(bodies, "node").select("node", "n", "fp", "set"), ["n", "node"], WIDE_LANES, tile, 2, reach, set_bytes, piece)
    out = components(set_links(tiles, *bounds))
    dropped(named, mine, bodies, tiles)
    return out


def keep_distinct(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WIDE_SIZE, similar: tuple[int, int] = SIMILAR, **tiling) -> DataFrame:
    """A row of each group of near copies, that of the smallest id (then text hash); rows without id stay.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; groups are what such
    links connect. Candidates are pairs of fingerprints within WIDE_RADIUS bits: at a similarity of exactly 0.8 that
    misses a pair in some ten thousand, above it far fewer. Texts that have a candidate are tiled once more, now with their
    sets, and each pair of tiles links its candidates by the sets themselves; a text is not checked against those of its
    group, and a pair of tiles gives a spanning star of each group, so a large group costs links in proportion. No pair is
    linked without its sets.

    Each row is judged by its own text, so an id may stay with several texts; of equal rows one stays.
    """
    prints = staged(set_prints(documents, id_col, text_col, size), "set-prints")
    found = prints.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min(F.struct(id_col, "hash")).alias("lead"))
    classes = staged(found, "set-classes")
    groups = near_copies(documents, classes, id_col, text_col, size, similar, **tiling)
    leads = classes.join(groups, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("lead").alias("lead"))
    keys = staged(leads.select(F.col(f"lead.{id_col}").alias("_id"), F.col("lead.hash").alias("_hash")), "leads")
    again = staged(prints.groupBy(F.col(id_col).alias("_id"), F.col("hash").alias("_hash")).count().filter("count > 1").select("_id", "_hash"), "repeated")
    some_again = not again.isEmpty()
    dropped(prints, classes)
    identified = documents.select(F.struct(*documents.columns).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash")).filter("_id is not null")
    kept = identified.join(keys, ["_id", "_hash"], "left_semi")
    if some_again:  # only rows that are repeated are gathered by key
        once = kept.join(again, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
        kept = kept.join(again, ["_id", "_hash"], "left_anti").unionByName(once)
    return kept.select("row.*").unionByName(documents.filter(F.col(id_col).isNull()))
