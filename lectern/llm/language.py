"""Operator 2: language identification with string kernels.

A text is the set of its character n-grams of 1 to 4 characters (lower-cased, hashed to a fixed number of
buckets). The blended-spectrum presence kernel of two texts is the cosine of their sets, the shared n-grams over
the root of the product of the sizes. A Nyström map over landmark texts turns kernels with the landmarks into features;
one kernel ridge regression for each language, one against the rest, is solved in closed form. Batches of texts are
scored by products of their presence matrix with the landmarks' and of the kernels with the coefficients.

The model is fitted on TRAIN_TEXTS labelled texts of each language at most, and LANDMARKS of them, drawn by a hash of
their id, so its size is fixed. Every text is scored whole.

A null text, or one without any letter, is "und" with score 0. Repeated rows are scored alike. With no labelled text
every text is "und". Text of any length is handled; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.runtime import as_batch, column_of, fold, fold_of, text_slices

#: Hash buckets of n-grams, longest n-gram.
BUCKETS = 1 << 14
LONGEST = 4
#: Labelled texts of each language that the model is fitted on, and landmarks, at most.
TRAIN_TEXTS = 400
LANDMARKS = 48
RIDGE = 1e-2
SHARPNESS = 8.0
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def presence(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS) of 0 and 1."""
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    for row, text in zip(out, texts, strict=True):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        code = points * _MIX[0]
        row[(code * _MIX[3]) >> shift] = 1
        for n in range(1, min(LONGEST, len(points))):
            code = (code[:-1] ^ (code[:-1] >> np.uint32(15))) * _MIX[1] + points[n:] * _MIX[2] + np.uint32(n)
            row[(code * _MIX[3]) >> shift] = 1
    return out


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # (m, BUCKETS), each row over its norm
    weights: np.ndarray  # (m + 1, languages), the last row is the bias

    def scores(self, sets: np.ndarray) -> np.ndarray:
        dense = sets.astype(np.float32)
        norms = np.sqrt(np.maximum(dense.sum(1), 1))
        kernels = dense @ self.landmarks.T / norms[:, None]
        return kernels @ self.weights[:-1] + self.weights[-1]


def fit(sets: np.ndarray, languages: list[str], landmarks: np.ndarray, ridge: float = RIDGE) -> KernelModel:
    """landmarks: places in sets. Each language's texts have the same total weight."""
    names = sorted(set(languages))
    dense = sets.astype(np.float32)
    dense /= np.sqrt(np.maximum(dense.sum(1, keepdims=True), 1))
    marks = dense[landmarks]
    kernel = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = np.c_[(dense @ marks.T).astype(np.float64) @ whiten, np.ones(len(dense))]
    index = np.array([names.index(x) for x in languages])
    weight = 1 / np.bincount(index)[index]
    target = np.where(index[:, None] == np.arange(len(names)), 1.0, -1.0)
    left = features.T @ (features * weight[:, None])
    left[np.diag_indices(len(left) - 1)] += ridge * len(names) / 100
    left[-1, -1] += 1e-9
    solved = np.linalg.solve(left, features.T @ (target * weight[:, None]))
    return KernelModel(names, marks, np.r_[whiten @ solved[:-1], solved[-1:]].astype(np.float32))


def sample_labelled(documents: DataFrame, label: str, per_label: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """per_label rows of each label at most, by a hash of their id: a rate thins them before they are ranked."""
    known = documents.filter(F.col(label).isNotNull() & F.col(text_col).isNotNull())
    rates = known.groupBy(label).agg((F.lit(3.0 * per_label + 30) / F.count("*")).alias("_rate"))
    mixed = F.xxhash64(F.lit(11), F.col(id_col))
    thin = known.join(F.broadcast(rates), label).withColumn("_h", mixed).filter(F.pmod("_h", F.lit(1 << 30)) < F.col("_rate") * (1 << 30))
    ranked = thin.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy("_h", id_col, text_col)))
    return ranked.filter(F.col("_rank") <= per_label)


def train(documents: DataFrame, label: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_label: int = TRAIN_TEXTS, landmarks: int = LANDMARKS) -> KernelModel | None:
    def run(batches):
        for batch in batches:
            packed = [np.packbits(s).tobytes() for s in presence(column_of(batch, text_col).to_pylist())]
            yield as_batch(label=column_of(batch, label), rank=column_of(batch, "_rank"), bits=pa.array(packed, pa.binary()))

    rows = sample_labelled(documents, label, per_label, id_col, text_col).select(label, text_col, "_rank").mapInArrow(run, "label string, rank int, bits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, r.rank))
    sets = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in rows])
    each = max(1, landmarks // len({r.label for r in rows}))
    return fit(sets, [r.label for r in rows], np.array([i for i, r in enumerate(rows) if r.rank <= each]))


def judged(model: KernelModel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its share, 0 to 1, of each text."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and model and _LETTER.search(t)]
    for at in range(0, len(known), 128):
        some = known[at : at + 128]
        raw = model.scores(presence([texts[i] for i in some])).astype(np.float64)
        share = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        scores[some] = share[np.arange(len(some)), best]
        for i, b in zip(some, best, strict=True):
            names[i] = model.languages[b]
    return names, scores


def predict(documents: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; score is the share of the chosen language, 0 to 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in text_slices(batches, text_col):
            ids = column_of(batch, id_col)
            names, scores = judged(shared.value, column_of(batch, text_col).to_pylist())
            held = fold_of(ids, folds) == held_out
            yield as_batch(**{id_col: ids, "held_out": pa.array(held), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def _train_rows(documents: DataFrame, label: str, id_col: str, text_col: str, folds: int, held_out: int) -> DataFrame:
    return documents.filter(fold(id_col, folds) != held_out).select(id_col, text_col, label)


def identify(documents: DataFrame, label: str = "lang", id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Fit on the rows outside the held-out fold, then predict all rows."""
    model = train(_train_rows(documents, label, id_col, text_col, folds, held_out), label, id_col, text_col)
    return predict(documents, model, id_col, text_col, folds, held_out)


def keep_identified(documents: DataFrame, least: float = 0.0, label: str = "lang", id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows whose text is not "und" and whose language has a share of at least `least`, unchanged."""
    model = train(_train_rows(documents, label, id_col, text_col, folds, held_out), label, id_col, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_slices(batches, text_col):
            names, scores = judged(shared.value, column_of(batch, text_col).to_pylist())
            keep = np.array([n != UNKNOWN for n in names], bool) & (scores >= least)
            if keep.any():
                yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
