"""Operator 4: benchmark decontamination with a positional inverted index.

The index is made of the training texts alone, before any test set, and dealt by documents: each segment holds the
postings of all tokens of some documents and is a row of a Parquet table. A search visits each segment once. For a phrase
it starts from the term with the fewest postings in the segment, shifts its list by the term's offset, and
intersects it with the shifted lists of the other terms from rare to frequent; a proximity search takes the same order and
looks for the nearest postings. Phrases are searched in slices, so that the lists that begin them hold SLICE postings
at once. No postings leave their segment, so nothing is shuffled and a frequent word or a passage in many documents
stays dealt like the documents are.

Test sets are sent to the executors in parts of PART_BYTES of text at most; a larger set is searched part by part in the
one index, and the hits of a document are then put together by its place in the index.

Null and empty texts have no words: such documents have no hit, such items no window. Repeated document rows give a
row each; item rows with one id count as one item. Items without an id count under the empty string. Empty tables
give no hits, or no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import as_batch, column_of, free_name, fresh_path, row_key, text_slices, texts_of

#: Words of a window.
WINDOW = 13
#: Text of a test set that is searched in one pass, and broadcast for it.
PART_BYTES = 4 << 20
#: Postings with which the phrases of one slice begin.
SLICE = 1 << 20
#: A-Z in lower case, what is no word character as a space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
_BETWEEN = b" \xff "  # no UTF-8 text holds this byte
_INDEX = "segment long, ids array<{}>, n_words array<int>, terms binary, starts binary, positions binary, size int"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Phrases:
    """The distinct windows of some items, as rows of term numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int | None = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        texts = [np.array([number(w, len(self.vocabulary)) for w in words_of(t)], np.int32) for _, t in items]
        wide = window or max(map(len, texts), default=1) or 1
        self.items = sorted({i for (i, _), t in zip(items, texts) if len(t)})
        place = {item: k for k, item in enumerate(self.items)}
        rows, owners = [np.empty((0, wide), np.int32)], [np.empty(0, np.int64)]
        for (item, _), t in zip(items, texts):
            if len(t) >= wide:
                rows.append(np.lib.stride_tricks.sliding_window_view(t, wide))
            elif len(t):
                rows.append(np.pad(t, (0, wide - len(t)), constant_values=-1)[None])
            if len(t):
                owners.append(np.full(len(rows[-1]), place[item], np.int64))
        self.windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.windows >= 0).sum(1).astype(np.int64)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)], 1), axis=0)
        self.owner_starts = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.owner_items = pairs[:, 1]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges start, start + 1, ... of each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Segment:
    """Postings of one segment: positions[starts[k] : starts[k + 1]] are the places of terms[k], ascending."""

    def __init__(self, terms: list[bytes], starts: np.ndarray, positions: np.ndarray, size: int):
        self.terms, self.starts, self.positions, self.size = terms, starts.astype(np.int64), positions, size

    def lists(self, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each term of the vocabulary starts, and how long it is."""
        first, count = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        number = np.fromiter((vocabulary.get(t, -1) for t in self.terms), np.int64, len(self.terms))
        here = np.flatnonzero(number >= 0)
        first[number[here]] = self.starts[here]
        count[number[here]] = self.starts[here + 1] - self.starts[here]
        return first, count

    def phrases(self, find: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(start position, window) of every exact occurrence."""
        none = np.empty(0, np.int64)
        if not len(find.lengths) or not self.terms:
            return none, none
        first, count = self.lists(find.vocabulary)
        seen = np.where(find.windows >= 0, count[find.windows], np.iinfo(np.int64).max)
        live = np.flatnonzero(seen.min(1) > 0)
        if not len(live):
            return none, none
        order = np.argsort(seen[live], axis=1, kind="stable")
        fewest = seen[live, order[:, 0]]
        # all asked lists one after another: ascending by term, then by place
        asked = np.unique(find.windows[live])
        asked = asked[asked >= 0]
        span = self.size + 1
        keys = np.repeat(asked, count[asked]) * np.int64(span) + self.positions[_ragged(first[asked], count[asked])]
        cuts = np.searchsorted(np.cumsum(fewest), np.arange(SLICE, fewest.sum() + SLICE, SLICE), side="left") + 1
        found = []
        for some in np.split(np.arange(len(live)), np.unique(np.minimum(cuts, len(live)))):
            if not len(some):
                continue
            windows, turn, length = find.windows[live[some]], order[some], find.lengths[live[some]]
            rarest = windows[np.arange(len(some)), turn[:, 0]]
            which = np.repeat(np.arange(len(some)), count[rarest])
            at = self.positions[_ragged(first[rarest], count[rarest])].astype(np.int64) - turn[which, 0]
            for k in range(1, windows.shape[1]):
                offset = turn[which, k]
                want = windows[which, offset].astype(np.int64) * span + at + offset
                place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                keep = (k >= length[which]) | ((keys[place] == want) & (at + offset < self.size) & (at + offset >= 0))
                which, at = which[keep], at[keep]
                if not len(at):
                    break
            keep = at >= 0
            found.append((at[keep], live[some[which[keep]]]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def near(self, terms: list[bytes], width: int) -> np.ndarray:
        """Positions of the rarest term that have every other term less than width places away."""
        place = {t: k for k, t in enumerate(self.terms)}
        if any(t not in place for t in terms) or not terms:
            return np.empty(0, np.int64)
        lists = sorted((self.positions[self.starts[place[t]] : self.starts[place[t] + 1]] for t in set(terms)), key=len)
        at = lists[0].astype(np.int64)
        for other in lists[1:]:
            k = np.searchsorted(other, at - width + 1)
            at = at[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] < at + width)]
        return at

    def list_of(self, term: bytes) -> np.ndarray:
        k = self.terms.index(term) if term in self.terms else -1
        return self.positions[self.starts[k] : self.starts[k + 1]] if k >= 0 else self.positions[:0]


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a segment, with the postings of all its tokens and the word count of every document."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        seq = TaskContext.get().partitionId() << 32
        for batch in text_slices(batches, text_col):
            raw = pc.cast(texts_of(batch, text_col), pa.binary()).to_pylist()
            words = pa.array(_BETWEEN.join([*raw, b""]).translate(_FOLD).split(), pa.binary()).dictionary_encode()
            names, code = words.dictionary.to_pylist(), words.indices.to_numpy()
            mark = names.index(b"\xff")
            ends = np.flatnonzero(code == mark)
            order = np.argsort(code, kind="stable").astype("<i4")
            sizes = np.bincount(code, minlength=len(names))
            begin = int(sizes[:mark].sum())
            positions = np.concatenate([order[:begin], order[begin + sizes[mark] :]])  # without the marks
            del names[mark]
            starts = np.concatenate([[0], np.cumsum(np.delete(sizes, mark))]).astype("<i4")
            seq += 1
            ids = column_of(batch, id_col)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([seq]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([np.diff(ends, prepend=-1) - 1], pa.list_(pa.int32())),
                    pa.array([b"\n".join(names)], pa.binary()), pa.array([starts.tobytes()], pa.binary()), pa.array([positions.tobytes()], pa.binary()), pa.array([len(code)], pa.int32()),
                ],
                names=["segment", "ids", "n_words", "terms", "starts", "positions", "size"],
            )

    return documents.select(id_col, text_col).mapInArrow(run, _INDEX.format(kind))


def stored_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """build_index, written to the shared folder."""
    index = build_index(documents, id_col, text_col)
    path = fresh_path(documents.sparkSession, "postings")
    index.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return documents.sparkSession.read.schema(index.schema).parquet(path)


def _segments(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            part = {c: column_of(batch, c)[i] for c in batch.schema.names}
            ids, n_words, terms = part["ids"].values, part["n_words"].values.to_numpy(), part["terms"].as_py()
            starts, positions = (np.frombuffer(part[c].as_py(), "<i4") for c in ("starts", "positions"))
            yield part["segment"].as_py(), ids, n_words, Segment(terms.split(b"\n") if terms else [], starts, positions, part["size"].as_py())


def phrase_hits(index: DataFrame, find: Phrases) -> DataFrame:
    """(segment, row, doc_id, n_words, runs, items) of each document: runs are its hit words as start << 32 | end."""
    shared = index.sparkSession.sparkContext.broadcast(find)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        find = shared.value
        for number, ids, n_words, seg in _segments(batches):
            at, window = seg.phrases(find)
            begins = np.cumsum(n_words + 1) - (n_words + 1)
            step = np.zeros(seg.size + 2, np.int32)
            np.add.at(step, at, 1)
            np.add.at(step, at + find.lengths[window], -1)
            edge = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
            runs_at, runs_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            run_row = np.searchsorted(begins, runs_at, side="right") - 1
            packed = (runs_at - begins[run_row]) << 32 | (runs_end - begins[run_row])
            row = np.searchsorted(begins, at, side="right") - 1
            n_owned = np.diff(find.owner_starts)[window]
            pairs = np.unique(np.stack([np.repeat(row, n_owned), find.owner_items[_ragged(find.owner_starts[window], n_owned)]], 1), axis=0)
            rows = np.arange(len(n_words) + 1)
            items = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], rows), pa.int32()), pa.array(find.items, pa.string()).take(pa.array(pairs[:, 1])))
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(run_row, rows), pa.int32()), pa.array(packed, pa.int64()))
            n = len(n_words)
            yield as_batch(segment=pa.array([number] * n, pa.int64()), row=pa.array(range(n), pa.int64()), doc_id=ids, n_words=pa.array(n_words, pa.int64()), runs=runs, items=items)

    return index.mapInArrow(run, f"segment long, row long, doc_id {kind}, n_words long, runs array<bigint>, items array<string>")


def proximity_hits(index: DataFrame, terms: list[str], width: int) -> DataFrame:
    """(doc_id, position) of the rarest of some terms, where all others stand less than width words away."""
    asked = list(dict.fromkeys(w for t in terms for w in words_of(t)))
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for _, ids, n_words, seg in _segments(batches):
            at = seg.near(asked, width)
            begins = np.cumsum(n_words + 1) - (n_words + 1)
            row = np.searchsorted(begins, at, side="right") - 1
            # lists of one segment run across its documents: look again within the document
            ok = np.ones(len(at), bool)
            for t in asked:
                other = seg.list_of(t)
                low = np.maximum(at - width + 1, begins[row])
                high = np.minimum(at + width, begins[row] + n_words[row])
                ok &= np.searchsorted(other, low) < np.searchsorted(other, high)
            yield as_batch(doc_id=ids.take(pa.array(row[ok])), position=pa.array((at - begins[row])[ok], pa.int64()))

    return index.mapInArrow(run, f"doc_id {kind}, position long")


def _verdict(batches):
    for batch in batches:
        n_hit, digests, n_items = [], [], []
        for runs, items in zip(column_of(batch, "runs").to_pylist(), column_of(batch, "items").to_pylist(), strict=True):
            hit = last = 0
            for run in sorted(runs):
                start, end = max(run >> 32, last), run & 0xFFFFFFFF
                if end > start:
                    hit, last = hit + end - start, end
            names = sorted(set(items))
            n_hit.append(hit)
            n_items.append(len(names))
            digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        words, hits = column_of(batch, "n_words"), pa.array(n_hit, pa.int64())
        bad = pc.and_(pc.greater(hits, 0), pc.greater_equal(pc.multiply(hits, 20), words))
        yield as_batch(doc_id=column_of(batch, "doc_id"), n_words=words, n_hit=hits, n_items=pa.array(n_items, pa.int64()), items_sha256=pa.array(digests, pa.string()), contaminated=bad)


def decontaminate(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of documents."""
    tests = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    total = tests.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    index, found = stored_index(documents, id_col, text_col), None
    for k in range(parts):
        some = tests if parts == 1 else tests.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
        find = Phrases([tuple(r) for r in some.collect()], window)
        hits = phrase_hits(index, find)
        found = hits if found is None else found.unionByName(hits)
    if parts > 1:
        gathered = F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items")
        found = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *gathered)
    kind = documents.schema[id_col].dataType.simpleString()
    out = found.select("doc_id", "n_words", "runs", "items").mapInArrow(_verdict, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return out.withColumnRenamed("doc_id", id_col)


def keep_clean(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of documents that are not contaminated; a row is known by its id and its text's hash, either may be null."""
    key = free_name(documents, "_key")
    keyed = documents.withColumn(key, row_key(id_col, text_col))
    bad = decontaminate(keyed, items, key, text_col, **options).filter("contaminated").select(key).distinct()
    return keyed.join(bad, key, "left_anti").select(*documents.columns)
