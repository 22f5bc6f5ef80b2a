"""Operator 7: a hidden Markov language model.

Words are mapped to a bounded alphabet: the HEAD most frequent training words have a symbol each, all others share a
symbol by their frequency class (seen 1, 2, 3-4, 5-8, ... times, or never). STATES hidden states emit symbols; a word
of a class is then drawn from the class by its smoothed count, which no state changes. Baum-Welch counts are
summed over all training texts, partition by partition, and each round re-estimates the model. A text's score is its
exact log likelihood by the scaled forward recursion over all its symbols, plus what the class words add.

The word counts are corpus statistics over all training texts. Only the KNOWN most frequent are broadcast, a fixed
number; counts of rarer words reach the texts by a join, for which each slice of texts names a word once. The states start from a hash of the head words' characters; nothing else
is drawn at random.

Null and empty texts are the end token alone. Repeated rows are counted, and scored, as often as they occur. Text of
any length is scored whole. With no training text every count is 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import as_batch, column_of, fold, fold_of, staged, text_slices, texts_of

#: Training words with a symbol of their own.
HEAD = 60_000
#: Training words whose count every task has.
KNOWN = 262_144
STATES = 4
ROUNDS = 3
#: What every symbol's expected count gets in each state, over the number of symbols.
SMOOTH = 0.1
#: Tokens of one batch of the recursions.
BATCH_TOKENS = 1 << 18
_CLASSES = 40


def lowered_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text as binary, A-Z lowered, parted by ASCII white space."""
    raw = [t.lower().split() for t in pc.cast(texts, pa.binary()).to_pylist()]
    return pa.array(raw, pa.list_(pa.binary()))


def word_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c long) over all texts; the end token is not among them."""

    def run(batches):
        for batch in text_slices(batches, text_col):
            counted = pc.value_counts(lowered_words(texts_of(batch, text_col)).flatten())
            yield as_batch(word=counted.field("values"), c=pc.cast(counted.field("counts"), pa.int64()))

    return documents.select(text_col).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequency_class(c: int) -> int:
    """0: never seen; k: seen over 2**(k-2) and up to 2**(k-1) times."""
    return 0 if c <= 0 else min(_CLASSES - 1, 1 + math.ceil(math.log2(c)))


@dataclass
class Alphabet:
    """Symbols: the first `own` known words, then frequency classes, then the end."""

    known: dict[bytes, int]  # place by falling count
    counts: np.ndarray  # of the known words
    own: int
    tokens: int  # N, ends included
    words: int  # V, the end included
    ends: int
    class_words: np.ndarray  # distinct training words without a symbol of their own, by class
    class_counts: np.ndarray

    @property
    def size(self) -> int:
        return self.own + _CLASSES + 1

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def symbols(self, c: np.ndarray) -> np.ndarray:
        """The class symbols of counts."""
        return self.own + np.array([frequency_class(x) for x in c.tolist()], np.int64)

    def in_class(self, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; all unseen words share their class as one."""
        k = self.symbols(c) - self.own
        return np.where(k > 0, np.log10((c + 0.5) / np.maximum(self.class_counts[k] + 0.5 * self.class_words[k], 0.5)), 0.0)


def known_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, c) of the most frequent words, `most` at most, best first: all words above a count that a histogram gives."""
    bucket = F.when(F.col("c") <= 4096, F.col("c")).otherwise(4096 + F.floor(F.log2("c") * 64)).cast("long")
    have, least = 0, None
    for row in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.col("b").desc()).collect():
        have += row.n
        if have > most:
            break
        least = row.c
    if least is None:
        return []
    found = counts.filter(F.col("c") >= least).select("word", "c").toArrow()
    return sorted(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def alphabet(counts: DataFrame, documents: int, head: int = HEAD, known: int = KNOWN) -> Alphabet:
    """counts: (word, c) of the training texts, documents: how many texts they come from."""
    top = known_words(counts, max(known, head))
    own = min(head, len(top))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    words, seen = np.zeros(_CLASSES), np.zeros(_CLASSES)
    if own < total.v:
        word, c = top[own - 1] if own else (b"", 1 << 62)
        rest = counts.filter((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > F.lit(bytearray(word)))))
        k = F.least(F.lit(_CLASSES - 1), 1 + F.ceil(F.round(F.log2("c"), 12))).cast("int")
        for row in rest.groupBy(k.alias("k")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect():
            words[row.k], seen[row.k] = row.v, row.n
    index = {w: i for i, (w, _) in enumerate(top)}
    return Alphabet(index, np.array([c for _, c in top], np.int64), own, int(total.n or 0) + documents, int(total.v) + (documents > 0), documents, words, seen)


@dataclass
class Chain:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (symbols, states), each state's column sums to 1


def first_chain(letters: Alphabet, states: int = STATES) -> Chain:
    """Head words lean to a state by the bigrams of their characters, grouped by k-means from fixed seeds."""
    words = list(letters.known)[: letters.own]
    sets = np.zeros((len(words), 256), np.float32)
    for row, w in zip(sets, words, strict=True):
        raw = np.frombuffer(b" " + w + b" ", np.uint8).astype(np.uint32)
        row[((raw[:-1] * 31 + raw[1:]) * np.uint32(2654435761)) >> np.uint32(24)] = 1
    sets /= np.maximum(np.linalg.norm(sets, axis=1, keepdims=True), 1)
    lean = np.zeros(len(words), np.int64)
    if len(words) >= states:
        centres = [sets[0]]
        for _ in range(1, states):
            centres.append(sets[(sets[:2000] @ np.array(centres).T).max(1).argmin()])
        centres = np.array(centres)
        for _ in range(8):
            lean = (sets @ centres.T).argmax(1)
            for s in range(states):
                if (lean == s).any():
                    mean = sets[lean == s].mean(0)
                    centres[s] = mean / max(np.linalg.norm(mean), 1e-9)
    emit = np.full((letters.size, states), 1.0)
    emit[: len(words)] = letters.counts[: letters.own, None] + 0.5
    emit[np.arange(len(words)), lean] *= 3
    emit[len(words) : -1] = (letters.class_counts + 1)[:, None]
    emit[-1] = letters.ends + 1
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    return Chain(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _batches(lengths: np.ndarray) -> list[np.ndarray]:
    """Rows in descending length, cut so that a batch holds about BATCH_TOKENS tokens."""
    order = np.argsort(-lengths, kind="stable")
    cuts = np.searchsorted(np.cumsum(lengths[order]), np.arange(BATCH_TOKENS, lengths.sum() + BATCH_TOKENS, BATCH_TOKENS))
    return [x for x in np.split(order, np.unique(cuts + 1)) if len(x)]


def _steps(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all tokens step by step, ends of the steps); rows come in descending length."""
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    ends = np.cumsum(alive)
    step = np.repeat(np.arange(lengths[0]), alive)
    row = np.arange(ends[-1]) - np.repeat(ends - alive, alive)
    return starts[row] + step, ends


def forward(chain: Chain, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """log10 likelihood of each row; with keep also what backward() takes."""
    places, ends = _steps(symbols, starts, lengths)
    emitted = chain.emit[symbols[places]]
    alphas, total, a, begin = [], np.zeros(len(starts)), None, 0
    scales = []
    for end in ends:
        b = emitted[begin:end]
        a = b * chain.start if a is None else (a[: end - begin] @ chain.move) * b
        scale = a.sum(1)
        a = a / scale[:, None]
        total[: end - begin] += np.log10(scale)
        if keep:
            alphas.append(a)
            scales.append(scale)
        begin = end
    return (total, places, ends, emitted, alphas, scales) if keep else total


def expected(chain: Chain, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> float:
    """Add the Baum-Welch counts of some rows to emit, move and start; gives their log10 likelihood."""
    total, places, ends, emitted, alphas, scales = forward(chain, symbols, starts, lengths, keep=True)
    beta = np.ones((0, chain.move.shape[0]))
    gammas = [None] * len(ends)
    for t in range(len(ends) - 1, -1, -1):
        n = len(alphas[t])
        full = np.ones((n, chain.move.shape[0]))
        if t + 1 < len(ends):
            begin = ends[t]
            m = ends[t + 1] - begin
            ahead = emitted[begin : ends[t + 1]] * beta / scales[t + 1][:, None]
            full[:m] = ahead @ chain.move.T
            move += chain.move * (alphas[t][:m].T @ ahead)
        gammas[t] = alphas[t] * full
        beta = full
    start += gammas[0].sum(0)
    seen = symbols[places]
    weights = np.concatenate(gammas)
    for s in range(weights.shape[1]):
        emit[:, s] += np.bincount(seen, weights[:, s], len(emit))
    return float(total.sum())


_SLICE = "slice long, ids array<{}>, held_out array<boolean>, n array<int>, symbols binary, known array<bigint>, base array<double>, add array<double>, rare array<binary>, rare_at binary, rare_word binary"


def encode(documents: DataFrame, letters: Alphabet, id_col: str, text_col: str, folds: int, held_out: int) -> DataFrame:
    """A row for each slice of texts: their symbols (ends included) with what is known of their words so far.

    `rare` names the slice's words that are not among the known ones, rare_at where they stand.
    """
    shared = documents.sparkSession.sparkContext.broadcast(letters)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        letters = shared.value
        get, end = letters.known.get, letters.size - 1
        base = np.append(letters.base(letters.counts), 0.0)  # the last place is that of rare words
        own = np.arange(len(letters.counts)) < letters.own
        symbol = np.append(np.where(own, np.arange(len(own)), letters.symbols(letters.counts)), 0)
        add = np.append(np.where(own, 0.0, letters.in_class(letters.counts)), 0.0)
        number = TaskContext.get().partitionId() << 32
        for batch in text_slices(batches, text_col):
            words = lowered_words(texts_of(batch, text_col))
            offsets, flat = words.offsets.to_numpy() - words.offsets[0].as_py(), words.flatten().dictionary_encode()
            lengths, n = np.diff(offsets), len(offsets) - 1
            place = np.array([get(w, -1) for w in flat.dictionary.to_pylist()], np.int64)
            index = flat.indices.to_numpy()
            place = place[index] if len(index) else np.empty(0, np.int64)
            where = np.arange(len(place)) + np.repeat(np.arange(n), lengths)
            symbols = np.full(len(place) + n, end, np.uint16)
            symbols[where] = symbol[place]
            rare = np.flatnonzero(place < 0)
            names, word = np.unique(index[rare], return_inverse=True) if len(rare) else (np.empty(0, np.int64), np.empty(0, np.int64))
            sums = [np.where(lengths > 0, np.add.reduceat(np.append(x, 0), offsets[:-1]), 0) for x in ((place >= 0).astype(np.int64), base[place], add[place])]
            ids = column_of(batch, id_col)
            number += 1
            columns = {
                "slice": pa.array([number]), "ids": pa.array([ids.to_pylist()], pa.list_(ids.type)), "held_out": pa.array([(fold_of(ids, folds) == held_out).tolist()]), "n": pa.array([lengths + 1], pa.list_(pa.int32())),
                "symbols": pa.array([symbols.tobytes()]), "known": pa.array([sums[0]], pa.list_(pa.int64())), "base": pa.array([sums[1]], pa.list_(pa.float64())), "add": pa.array([sums[2]], pa.list_(pa.float64())),
                "rare": pa.array([flat.dictionary.take(pa.array(names)).to_pylist() if len(names) else []], pa.list_(pa.binary())), "rare_at": pa.array([where[rare].astype("<i4").tobytes()]), "rare_word": pa.array([word.astype("<i4").tobytes()]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return documents.select(id_col, text_col).mapInArrow(run, _SLICE.format(kind))


def with_classes(encoded: DataFrame, counts: DataFrame, letters: Alphabet, id_col: str) -> DataFrame:
    """A row for each text, rare words filled in: symbols, n_known, base_score, rare_score (what class words add)."""
    shared = encoded.sparkSession.sparkContext.broadcast(letters)
    words = encoded.select("slice", F.posexplode("rare").alias("pos", "word"))
    found = words.join(counts, "word", "left").select("slice", "pos", F.coalesce("c", F.lit(0)).alias("c"))
    lists = found.groupBy("slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("cs"))
    joined = encoded.drop("rare").join(lists, "slice", "left")
    kind = encoded.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        letters = shared.value
        end_base = float(letters.base(np.array(letters.ends)))
        for batch in batches:
            for i in range(batch.num_rows):
                part = {c: column_of(batch, c)[i] for c in batch.schema.names}
                n = part["n"].values.to_numpy().astype(np.int64)
                ends = np.cumsum(n)
                symbols = np.frombuffer(part["symbols"].as_py(), np.uint16).copy()
                at, word = (np.frombuffer(part[c].as_py(), "<i4") for c in ("rare_at", "rare_word"))
                c = part["cs"].values.to_numpy() if part["cs"].is_valid and len(word) else np.empty(0, np.int64)
                symbols[at] = letters.symbols(c)[word]
                text = np.searchsorted(ends, at, side="right")
                known, base, add = (np.bincount(text, x[word], len(n)) for x in ((c > 0).astype(float), letters.base(c), letters.in_class(c)))
                yield as_batch(
                    **{id_col: part["ids"].values}, held_out=part["held_out"].values, n_tokens=pa.array(n),
                    symbols=pa.array([symbols[e - k : e].tobytes() for e, k in zip(ends, n)], pa.binary()),
                    n_known=pa.array(part["known"].values.to_numpy() + known.astype(np.int64) + (letters.ends > 0)),
                    base_score=pa.array(part["base"].values.to_numpy() + base + end_base), rare_score=pa.array(part["add"].values.to_numpy() + add),
                )

    return joined.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, symbols binary, n_known long, base_score double, rare_score double")


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = column_of(batch, "symbols").to_pylist()
    lengths = np.array([len(x) // 2 for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint16), np.cumsum(lengths) - lengths, lengths


def baum_welch(encoded: DataFrame, letters: Alphabet, states: int = STATES, rounds: int = ROUNDS) -> tuple[Chain, list[float]]:
    """Re-estimate over all rows of encoded; also the log10 likelihood that each round began with.

    A task adds up its rows and gives one row a state and block of symbols; those are summed by key.
    """
    spark = encoded.sparkSession
    chain, seen = first_chain(letters, states), []
    block = 8192
    blocks = -(-letters.size // block)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chain)

        def run(batches, shared=shared):
            chain = shared.value
            emit, move, start, total = np.zeros_like(chain.emit), np.zeros_like(chain.move), np.zeros_like(chain.start), 0.0
            for batch in batches:
                symbols, starts, lengths = _rows(batch)
                for some in _batches(lengths):
                    total += expected(chain, symbols, starts[some], lengths[some], emit, move, start)
            if start.any():
                flat = emit.T
                rows = [(s, b, flat[s, b * block : (b + 1) * block]) for s in range(states) for b in range(blocks)]
                rows += [(states, s, move[s]) for s in range(states)] + [(states + 1, 0, start), (states + 2, 0, np.array([total]))]
                for at in range(0, len(rows), 16):
                    a, b, x = zip(*rows[at : at + 16])
                    yield as_batch(kind=pa.array(a, pa.int32()), block=pa.array(b, pa.int32()), sums=pa.array([v.tobytes() for v in x], pa.binary()))

        def add(batches):
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for a, b, x in zip(*(column_of(batch, c).to_pylist() for c in ("kind", "block", "sums")), strict=True):
                    v = np.frombuffer(x, np.float64)
                    held[a, b] = held[a, b] + v if (a, b) in held else v
            if held:
                yield as_batch(kind=pa.array([k[0] for k in held], pa.int32()), block=pa.array([k[1] for k in held], pa.int32()), sums=pa.array([v.tobytes() for v in held.values()], pa.binary()))

        schema = "kind int, block int, sums binary"
        parts = encoded.select("symbols").mapInArrow(run, schema).repartition("kind", "block").mapInArrow(add, schema).collect()
        if not parts:
            break
        emit, move, start = np.zeros_like(chain.emit), np.zeros_like(chain.move), np.zeros_like(chain.start)
        for r in parts:
            v = np.frombuffer(r.sums, np.float64)
            if r.kind < states:
                emit[r.block * block : r.block * block + len(v), r.kind] = v
            elif r.kind == states:
                move[r.block] = v
            elif r.kind == states + 1:
                start = v.copy()
            else:
                seen.append(float(v[0]))
        emit += SMOOTH * np.maximum(emit.sum(1, keepdims=True), 0.5) / states
        move, start = move + 1e-3, start + 1e-3
        chain = Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return chain, seen




def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, head: int = HEAD, known: int = KNOWN, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the texts outside the held-out fold and score all:

    (id, held_out, n_tokens, n_known, train_tokens, base_score, score); scores are log10 probabilities.
    """
    spark = documents.sparkSession
    training = documents.filter(fold(id_col, folds) != held_out)
    counts = staged(word_counts(training, text_col), "word-counts")
    letters = alphabet(counts, training.count(), head, known)
    encoded = staged(encode(documents, letters, id_col, text_col, folds, held_out), "encoded")
    filled = staged(with_classes(encoded, counts, letters, id_col), "symbols")
    chain, _ = baum_welch(filled.filter(~F.col("held_out")), letters, states, rounds)
    shared = spark.sparkContext.broadcast(chain)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        chain = shared.value
        for batch in batches:
            symbols, starts, lengths = _rows(batch)
            score = np.zeros(len(lengths))
            for some in _batches(lengths):
                score[some] = forward(chain, symbols, starts[some], lengths[some])
            score += column_of(batch, "rare_score").to_numpy()
            yield as_batch(**{c: column_of(batch, c) for c in (id_col, "held_out", "n_tokens", "n_known")}, train_tokens=pa.array([letters_tokens] * len(score), pa.int64()), base_score=column_of(batch, "base_score"), score=pa.array(score))

    letters_tokens = letters.tokens
    return filled.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
