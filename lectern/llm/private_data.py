"""Operator 10: personal data by patterns and by a character-level bidirectional LSTM with a CRF.

Four kinds of span have a pattern: email, ip, card, phone. The patterns' spans always stay. The network, trained here
in numpy on labelled spans, adds spans that no pattern has. It reads windows of WINDOW characters that start every
WINDOW / 2 around each digit or at sign (a span of any kind holds one, so other text cannot hold a span). The windows'
label scores are averaged where they overlap, those near a window's ends counting less, and each stretch of windows is decoded as a whole with the CRF's
transitions, so a span may cross windows. A decoded span is added if it has what its kind needs and meets no other.

Training spans: the patterns' spans in windows of TRAIN_WINDOWS rows at most, drawn by a hash of their id, and
written variants of them that the patterns miss (digits grouped otherwise, spaces around signs). The fit is
deterministic.

Positions are code points, ends exclusive. Null texts count as empty and have no spans. Repeated rows are treated
alike; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import as_batch, column_of, text_slices

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
TRAIN_WINDOWS = 600
#: Invented spans among the training windows.
INVENTED = 1000
HIDDEN = 16
STEPS = 440
_TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match fails at all starts of a run of digits or at none, so only the first is tried
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MARK = re.compile("[0-9@]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them; each at sign is tried once, with all local characters left of it."""
    out, bound, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > bound and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            bound = m.end()
        at = text.find("@", max(at + 1, bound))
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 12 <= len(d) <= 19 and _luhn(d)
    return kind == "email" or 9 <= len(_digits(s)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            if kind != 3 or "+" in text:
                out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(KINDS[kind], m.group())]
    return sorted(out)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


# --- the network ---------------------------------------------------------------------------------------------------

#: Characters up to this one have an input of their own; all others share BUCKETS, the last input stands for no character.
OWN, BUCKETS = 384, 64
_N_CLASSES = OWN + BUCKETS + 1


def classes_of(text: str) -> np.ndarray:
    """The input of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(points < OWN, points, OWN + points % BUCKETS)


@dataclass
class Tagger:
    """p: forward and backward LSTM (x, h, bias each), output (weights, bias), CRF transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, hidden: int = HIDDEN, seed: int = 5) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"out": r.normal(0, 0.3, (2 * hidden, _TAGS)), "out_b": np.zeros(_TAGS), "move": np.zeros((_TAGS, _TAGS))}
        for d in "fb":
            p[d + "x"] = r.normal(0, 0.3, (1, 4 * hidden)) + r.normal(0, 0.1, (_N_CLASSES, 4 * hidden))
            p[d + "h"] = r.normal(0, 0.3, (hidden, 4 * hidden))
            p[d + "b"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
        return cls(p)

    def _lstm(self, d: str, x: np.ndarray):
        """States of one direction over x (batch, time); the gates are kept for training."""
        wh, n = self.p[d + "h"], self.p[d + "h"].shape[0]
        z_in = self.p[d + "x"][x] + self.p[d + "b"]
        h = c = np.zeros((len(x), n))
        states, kept = np.zeros((*x.shape, n)), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            z = z_in[:, t] + h @ wh
            s = 1 / (1 + np.exp(-z[:, : 3 * n]))
            g = np.tanh(z[:, 3 * n :])
            before = h, c
            c = s[:, n : 2 * n] * c + s[:, :n] * g
            tc = np.tanh(c)
            h = s[:, 2 * n :] * tc
            states[:, t] = h
            kept.append((t, s, g, tc, *before))
        return states, kept

    def unary(self, x: np.ndarray) -> np.ndarray:
        """Label scores (batch, time, labels)."""
        both = np.concatenate([self._lstm("f", x)[0], self._lstm("b", x)[0]], 2)
        return both @ self.p["out"] + self.p["out_b"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the labels y, and its gradient."""
        f, f_kept = self._lstm("f", x)
        b, b_kept = self._lstm("b", x)
        both = np.concatenate([f, b], 2)
        u = both @ self.p["out"] + self.p["out_b"]
        move, steps, rows = self.p["move"], x.shape[1], len(x)
        ahead = [u[:, 0]]
        for t in range(1, steps):
            ahead.append(u[:, t] + _lse(ahead[-1][:, :, None] + move, 1))
        back = [np.zeros((rows, _TAGS))]
        for t in range(steps - 2, -1, -1):
            back.append(_lse(move[None] + (u[:, t + 1] + back[-1])[:, None, :], 2))
        back = back[::-1]
        total = _lse(ahead[-1], 1)
        alpha, beta = np.stack(ahead, 1), np.stack(back, 1)
        du = np.exp(alpha + beta - total[:, None, None])
        pairs = np.exp(alpha[:, :-1, :, None] + move + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        d_move = pairs.sum((0, 1))
        np.add.at(d_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        i, j = np.indices(y.shape)
        gold = u[i, j, y].sum() + move[y[:, :-1], y[:, 1:]].sum()
        du[i, j, y] -= 1
        n = self.p["fh"].shape[0]
        grads = {"move": d_move, "out": np.einsum("btk,btl->kl", both, du), "out_b": du.sum((0, 1))}
        d_both = du @ self.p["out"].T
        for d, kept, d_states in (("f", f_kept, d_both[:, :, :n]), ("b", b_kept, d_both[:, :, n:])):
            wh = self.p[d + "h"]
            g_x, g_h = np.zeros_like(self.p[d + "x"]), np.zeros_like(wh)
            g_b = np.zeros_like(self.p[d + "b"])
            dh = dc = np.zeros((rows, n))
            for t, s, g, tc, h0, c0 in reversed(kept):
                dh = dh + d_states[:, t]
                dc = dc + dh * s[:, 2 * n :] * (1 - tc * tc)
                gates = np.concatenate([dc * g, dc * c0, dh * tc], 1) * s * (1 - s)
                dz = np.concatenate([gates, dc * s[:, :n] * (1 - g * g)], 1)
                np.add.at(g_x, x[:, t], dz)
                g_h += h0.T @ dz
                g_b += dz.sum(0)
                dh, dc = dz @ wh.T, dc * s[:, n : 2 * n]
            grads |= {d + "x": g_x, d + "h": g_h, d + "b": g_b}
        return float(total.sum() - gold) / rows, {k: v / rows for k, v in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 48, rate: float = 0.03) -> list[float]:
        """Adam over deterministic batches; gives the losses."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, losses = np.random.default_rng(7), []
        for step in range(1, steps + 1):
            some = order.integers(0, len(x), batch)
            loss, grads = self.gradients(x[some], y[some])
            losses.append(loss)
            speed = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in grads.items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                self.p[k] -= speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def best_path(self, u: np.ndarray) -> np.ndarray:
        """The labels of one stretch with scores u (time, labels)."""
        move, score, back = self.p["move"], u[0], np.zeros(u.shape, np.int64)
        for t in range(1, len(u)):
            ways = score[:, None] + move
            back[t] = ways.argmax(0)
            score = ways[back[t], np.arange(_TAGS)] + u[t]
        path = np.zeros(len(u), np.int64)
        path[-1] = score.argmax()
        for t in range(len(u) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


# --- windows, training spans, decoding -----------------------------------------------------------------------------


#: Weights of a window's scores: what stands near an end has been read with little around it.
_TRUST = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW))[:, None] ** 2 / WINDOW


def window_starts(text: str) -> list[int]:
    """Multiples of half a window whose window holds a digit or an at sign, or is next to one that does."""
    half, out = WINDOW // 2, set()
    for m in _MARK.finditer(text):
        out.update(range(max(0, m.start() // half - 2), (m.end() - 1) // half + 2))
    return [k * half for k in sorted(out) if k * half < len(text)]


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for s, k, e in spans:
        if s < length and not y[s : min(e, length)].any():
            y[s:e] = 2 + 2 * k
            y[s] = 1 + 2 * k
    return y


def _variant(kind: int, s: str, r: random.Random) -> str:
    """Another way to write a span."""
    d = _digits(s)
    if kind == 0:
        return s.replace("@", r.choice([" @ ", " @", "@ "]))
    if kind == 1:
        return s.replace(".", r.choice([" . ", ". "]))
    if kind == 2:
        sep = r.choice([".", "/", " - "])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:]
    return r.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"])


def _invented(r: random.Random) -> tuple[int, str]:
    kind = r.choice((0, 0, 1, 2, 3))
    if kind == 0:
        return 0, "".join(r.choice("abcdefghiklmnoprst") for _ in range(r.randint(3, 8))) + f".{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com"
    if kind == 1:
        return 1, ".".join(str(r.randint(1, 255)) for _ in range(4))
    if kind == 2:
        body = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return 2, next(body + c for c in "0123456789" if _luhn(body + c))
    return 3, f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"


def examples(windows: list[str], least: int = INVENTED) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels: the given ones, as they are and with spans written otherwise, and some invented spans."""
    r, out = random.Random(3), []

    def add(text: str, spans):
        text, x, y = text[:WINDOW], np.full(WINDOW, _N_CLASSES - 1), np.zeros(WINDOW, np.int64)
        x[: len(text)], y[: len(text)] = classes_of(text), tags_of(len(text), spans)
        out.append((x, y))

    plain = [w for w in windows if w and not base_spans(w)] or ["the word of that and other text here, with more words. "]
    for w in windows:
        spans = base_spans(w)
        add(w, spans)
        for s, k, e in spans[:1]:
            v = _variant(k, w[s:e], r)
            add(w[:s] + v + w[e:], [(s, k, s + len(v))])
    for _ in range(least):
        kind, s = _invented(r)
        s = s if r.random() < 0.25 else _variant(kind, s, r)
        w = r.choice(plain)
        # a window may begin or end anywhere in a span's surroundings, or inside it
        at = r.randrange(-6, 40)
        head = w[: max(at, 0)].rsplit(" ", 1)[0] + " " if at > 0 else ""
        cut = max(-at, 0)
        add(head + s[cut:] + r.choice([" ", ", ", ". ", "\n"]) + w[max(at, 0) :].lstrip(), [(len(head), kind, len(head) + len(s) - cut)])
        add(w, [])
    return np.stack([x for x, _ in out]), np.stack([y for _, y in out])


def _needs(kind: int, s: str) -> bool:
    d = len(_digits(s))
    if kind == 0:
        return "@" in s and "." in s.partition("@")[2] and len(s) <= 254 and s.count("@") == 1 and bool(s.partition("@")[0].strip())
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search("[A-Za-z]", s)
    if re.search(r"[^\W\d_]", s):
        return False
    return 12 <= d <= 19 and _luhn(_digits(s)) if kind == 2 else 9 <= d <= 15 and len(s) <= 24


def found_by(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the network decodes in each text, those that their kind allows."""
    jobs = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    scores: dict[int, dict[int, np.ndarray]] = {}
    for at in range(0, len(jobs), 512):
        some = jobs[at : at + 512]
        x = np.full((len(some), WINDOW), _N_CLASSES - 1)
        for row, (i, s) in zip(x, some, strict=True):
            piece = texts[i][s : s + WINDOW]
            row[: len(piece)] = classes_of(piece)
        for (i, s), u in zip(some, tagger.unary(x), strict=True):
            scores.setdefault(i, {})[s] = u
    half = WINDOW // 2
    for i, windows in scores.items():
        text, starts = texts[i], sorted(windows)
        begin = 0
        for k in range(1, len(starts) + 1):
            if k < len(starts) and starts[k] - starts[k - 1] <= half:
                continue
            first, end = starts[begin], min(starts[k - 1] + WINDOW, len(text))
            u, n = np.zeros((end - first, _TAGS)), np.zeros((end - first, 1))
            for s in starts[begin:k]:
                size = min(WINDOW, end - s)
                u[s - first : s - first + size] += _TRUST[:size] * windows[s][:size]
                n[s - first : s - first + size] += _TRUST[:size]
            path = tagger.best_path(u / n)
            at = 0
            while at < len(path):
                if path[at] and path[at] % 2:
                    kind, stop = (path[at] - 1) // 2, at + 1
                    while stop < len(path) and path[stop] == path[at] + 1:
                        stop += 1
                    s = text[first + at : first + stop]
                    lead, tail = len(s) - len(s.lstrip()), len(s) - len(s.rstrip(" .,;\n"))
                    if lead + tail < len(s) and _needs(int(kind), s[lead : len(s) - tail]):
                        out[i].append((first + at + lead, int(kind), first + stop - tail))
                    at = stop
                else:
                    at += 1
            begin = k
    return out


def with_added(base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """base and those found spans that meet none of it, nor an earlier one."""
    out = list(base)
    for s, k, e in found:
        if all(e <= a or s >= b for a, _, b in out):
            out.append((s, k, e))
    return sorted(out)


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_WINDOWS) -> Tagger:
    """Fit on windows of `rows` documents at most that hold a digit or an at sign."""
    some = documents.select(id_col, text_col).filter(F.col(text_col).rlike("[0-9@]")).withColumn("_h", F.xxhash64(F.lit(29), id_col))

    def run(batches):
        for batch in text_slices(batches, text_col):
            kept, order = [], []
            for h, text in zip(column_of(batch, "_h").to_pylist(), column_of(batch, text_col).to_pylist(), strict=True):
                spans = base_spans(text)
                s = max(0, (spans[abs(h) % len(spans)][0] if spans else _MARK.search(text).start()) - abs(h) % 20)
                kept.append(text[s : s + WINDOW])
                order.append(h)
            yield as_batch(_h=pa.array(order, pa.int64()), window=pa.array(kept, pa.string()))

    found = some.select("_h", text_col).mapInArrow(run, "_h long, window string").orderBy("_h", "window").limit(rows).collect()
    tagger = Tagger.new()
    tagger.fit(*examples([r.window for r in found]))
    return tagger


def find_private(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): the counts and the digest are the patterns'."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger or train(documents, id_col, text_col))
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in text_slices(batches, text_col):
            texts = [t or "" for t in column_of(batch, text_col).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [with_added(b, f) for b, f in zip(base, found_by(shared.value, texts), strict=True)]
            counts = {f"n_{k}": pa.array([sum(s[1] == i for s in b) for b in base], pa.int64()) for i, k in enumerate(KINDS)}
            yield as_batch(
                **{id_col: column_of(batch, id_col)}, **counts, base_sha256=pa.array([hashlib.sha256(spelled(b).encode()).hexdigest() for b in base]),
                spans=pa.array([spelled(e) for e in every]), n_added=pa.array([len(e) - len(b) for e, b in zip(every, base, strict=True)], pa.int64()),
            )

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span as <EMAIL>, <IP>, ...; of spans that overlap, one mark for all, by the first."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_private(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """documents with the spans in text masked; other columns stay (n_chars, if there, follows the text)."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger or train(documents, id_col, text_col))

    def run(batches):
        for batch in text_slices(batches, text_col):
            texts = column_of(batch, text_col).to_pylist()
            plain = [t or "" for t in texts]
            spans = [with_added(base_spans(t), f) for t, f in zip(plain, found_by(shared.value, plain), strict=True)]
            done = [t if t is None or not s else masked(t, s) for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns)
            columns[batch.schema.get_field_index(text_col)] = pa.array(done, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = documents.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
