"""Operator 8: toxicity by compression distance.

zstandard trains dictionaries on ordinary and, apart, on toxic text; a text is cut into windows of WORDS words, and
each window compressed with the ordinary dictionary alone and with the toxic one before it: the bytes that the
toxic dictionary saves are the window's evidence. The toxic dictionary is trained on windows of toxic texts without
the words that several ordinary texts have, the ordinary one on windows of ordinary texts and, in ROUNDS rounds, on
those that showed evidence (hard negatives).

One such pair of dictionaries also saves bytes on words that happen to look like its samples. So PAIRS pairs are
trained, each without another part of the toxic texts and on another part of the ordinary windows: what is evidence to
all of them counts, chance is not. A text's features (its greatest, mean, summed and agreed evidence) are put on
a scale from 0 to 1 by a logistic fit on labelled texts that the dictionaries have not seen, moved so that
FALSE_RATE of the ordinary ones among those stand at THRESHOLD or above.

The model is fitted on SAMPLE labelled texts of either label at most, drawn by a hash of their id; of
an id that repeats the smallest text. Every text is
scored whole. Null and empty texts have no evidence and get the score of a text without any. With no text of one of the
labels every score is 0. Repeated rows are scored alike; an empty table gives no rows. Where there is too little text
for zstandard to train on, the samples themselves are the dictionary.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import as_batch, column_of, fold, fold_of, once, text_slices

#: Labelled texts of either label, at most.
SAMPLE = 1800
WORDS = 32
#: Pairs of dictionaries, and rounds of hard negatives of each.
PAIRS = 5
ROUNDS = 4
#: Bytes of the dictionaries: of ordinary windows, of hard negatives, of toxic windows.
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES = 4096, 12_288, 3072
#: A word that so many ordinary texts have is left out of the toxic samples.
COMMON = 2
THRESHOLD = 0.3
#: Of ordinary calibration texts, the share that may reach THRESHOLD.
FALSE_RATE = 0.005


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def windows_of(text: str | None) -> list[bytes]:
    words = words_of(text)
    return [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, len(words), WORDS)]


def trained(samples: list[bytes], size: int, segment: int = 16, unit: int = 8) -> bytes:
    """A zstandard dictionary of `size` bytes at most, trained on the samples."""
    samples = [s for s in samples if len(s) >= unit]
    if not samples:
        return b""
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=unit, level=19).as_bytes()
    except zstd.ZstdError:  # too little to train on
        return b"".join(samples)[-size:]


def _compressor(content: bytes):
    rules = zstd.ZstdCompressionParameters.from_level(19, window_log=17, min_match=6, strategy=zstd.STRATEGY_GREEDY)
    if not content:
        return zstd.ZstdCompressor(compression_params=rules).compress
    book = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    book.precompute_compress(compression_params=rules)
    return zstd.ZstdCompressor(compression_params=rules, dict_data=book).compress


class Pair:
    """Two compressors: ordinary text stands at the end of either dictionary, so what it saves is equal."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.toxic = _compressor(ordinary), _compressor(toxic + ordinary)

    def evidence(self, windows: list[bytes]) -> list[int]:
        return [len(self.plain(w)) - len(self.toxic(w)) for w in windows]


def features(pairs: list[Pair], text: str | None) -> list[float]:
    windows = windows_of(text)
    if not windows:
        return [0.0] * 9
    each = np.array([p.evidence(windows) for p in pairs])
    mean, agreed = each.mean(0), (each > 0).mean(0)
    return [
        mean.max(), mean.mean(), np.log1p(mean[mean > 0].sum()), mean.sum() / len(mean) ** 0.5, np.sort(mean)[-3:].mean(),
        agreed.max(), (agreed >= 0.75).mean(), np.log1p((agreed == 1).sum()), min(each.min(0).max(), 10),
    ]


@dataclass
class ToxicModel:
    books: list[tuple[bytes, bytes]]  # ordinary, toxic
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the features, then the bias

    def pairs(self) -> list[Pair]:
        return [Pair(*b) for b in self.books]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def train_pair(toxic: list[bytes], ordinary: list[bytes], common: set[bytes], rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from windows of either label."""
    own = [b" " + b" ".join(w for w in x.split() if w not in common) + b" " for x in toxic]
    book, base = trained(own, TOXIC_BYTES), trained(ordinary, ORDINARY_BYTES, 12, 6)
    hard: list[bytes] = []
    plain = base
    for _ in range(rounds):
        found = [w for w, saved in zip(ordinary, Pair(plain, book).evidence(ordinary), strict=True) if saved > 0]
        if not found:
            break
        hard += found
        plain = trained(hard, HARD_BYTES) + base
    return plain, book


def fit(toxic: list[str], ordinary: list[str], pairs: int = PAIRS) -> ToxicModel:
    """Two thirds of the texts train the dictionaries, the rest the scale."""
    seen_t, seen_o = [t for i, t in enumerate(toxic) if i % 3], [t for i, t in enumerate(ordinary) if i % 3]
    seen_t, seen_o = seen_t or toxic, seen_o or ordinary
    texts = Counter(w for t in seen_o for w in set(words_of(t)))
    common = {w for w, n in texts.items() if n >= COMMON}
    windows = [w for t in seen_o for w in windows_of(t)]
    books = []
    for k in range(pairs):
        mine = [t for i, t in enumerate(seen_t) if i % pairs != k] or seen_t
        books.append(train_pair([w for t in mine for w in windows_of(t)], windows[k::pairs] or windows, common))
    model = ToxicModel(books, np.zeros(9), np.ones(9), np.zeros(10))
    made = model.pairs()
    rest_t, rest_o = toxic[::3], ordinary[::3]
    x = np.array([features(made, t) for t in (*rest_t, *rest_o)])
    y = np.r_[np.ones(len(rest_t)), np.zeros(len(rest_o))]
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.centre) / model.spread, y)
    z = (x - model.centre) / model.spread @ model.weights[:-1] + model.weights[-1]
    high = np.sort(z[y == 0])[::-1]
    most = high[min(int(FALSE_RATE * len(high)), len(high) - 1)]  # the first ordinary text that stays below
    above = z[z > most]
    cut = (most + above.min()) / 2 if len(above) else most + 1e-6
    model.weights[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return model


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> ToxicModel | None:
    """Fit on labelled rows outside the held-out fold; of an id's label rows the largest label counts."""
    named = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held_out))
    known = named.groupBy(id_col).agg(F.max(label).cast("int").alias("_label")).withColumn("_h", F.xxhash64(F.lit(11), id_col))
    of = [known.filter(F.col("_label") == v).orderBy("_h", id_col).limit(sample) for v in (0, 1)]
    # 2 * sample ids at most are broadcast, so no text is shuffled
    rows = documents.select(id_col, text_col).filter(F.col(text_col).isNotNull()).join(F.broadcast(of[0].unionByName(of[1])), id_col)
    # an id may repeat: one text of each, so neither label takes the other's places
    texts = rows.groupBy("_label", "_h", id_col).agg(F.min(text_col).alias("_text"))
    found = texts.orderBy("_label", "_h", id_col).select("_label", "_text").collect()
    toxic, ordinary = [r[1] for r in found if r[0] == 1], [r[1] for r in found if r[0] == 0]
    return fit(toxic, ordinary) if toxic and ordinary else None


def score(documents: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        model = shared.value
        pairs = once("toxicity", hash(tuple(model.books)), model.pairs) if model else None
        for batch in text_slices(batches, text_col):
            ids, texts = column_of(batch, id_col), column_of(batch, text_col).to_pylist()
            if pairs:
                known = {t: features(pairs, t) for t in set(texts)}
                scores = model.scores(np.array([known[t] for t in texts]))
            else:
                scores = np.zeros(len(texts))
            yield as_batch(**{id_col: ids, "held_out": pa.array(fold_of(ids, folds) == held_out), "score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= THRESHOLD).astype(np.int32))})

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold, then score all rows."""
    return score(documents, train(documents, labels, **options))
