"""Operator 1: SentencePiece BPE encoding by backtracking, and decoding.

The model file is parsed here (its protobuf wire format is public); no merge is replayed over a whole
word. An Aho-Corasick automaton gives every vocabulary match of a segment in one pass. From the left, the
longest match is tried first; a match is kept if the pair it makes with its left neighbour is *stable*,
which means that merging the characters of both anew, best score first and leftmost among equals, gives
exactly these two pieces. Where no match fits, the position is marked in a bit field of dead ends and the
last piece gives way to its next shorter one. An encoding with stable neighbours only is the one that
merging the whole segment gives.

Null and empty texts have no pieces (the end id is still appended on request). Texts of any length and
characters outside the vocabulary (byte pieces) are handled; rows are independent, so repeated rows give
repeated results, and columns other than the two named stay untouched.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lectern.llm.runtime import TwoGenerations, as_batch, column_of, once, text_slices, texts_of

SPACE = "▁"
#: Words of which a worker keeps the pieces.
MEMO_WORDS = 80_000
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_LETTERS = re.compile(f"{SPACE}*[^\\W\\d_]+|{SPACE}*[\\W\\d_]+")
_ALONE = (1 << 21) - 1
_NEVER = float("-inf")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            (value,), at = struct.unpack_from("<f", data, at), at + 4
        else:
            (value,), at = struct.unpack_from("<d", data, at), at + 8
        yield tag >> 3, value


class PieceModel:
    """A BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                if spec.get(3, 1) != 2:
                    raise ValueError("only merge-type (BPE) models are supported")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only the identity normaliser with a dummy prefix and kept spaces is supported")
        if _USER in self.kinds:
            raise ValueError("user-defined pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == _NORMAL}
        self.scores = scores
        self.unknown = self.kinds.index(_UNKNOWN)
        self.end = self.pieces.index("</s>")
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == _BYTE}
        self.machine = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.machine.add_word(p, (len(p), i))
        self.machine.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self.shorter = [self._shorter(p) if k == _NORMAL else -1 for p, k in zip(self.pieces, self.kinds)]
        letter = re.compile("[^\\W\\d_]").match
        beside = {y if letter(x) else x for p in self.ids for x, y in zip(p, p[1:]) if bool(letter(x)) != bool(letter(y)) and x != SPACE}
        #: Characters that are no letters, but may share a piece with a letter at their side.
        self.beside = re.compile("[" + "".join(map(re.escape, sorted(beside))) + "]") if beside else re.compile("(?!)")
        self._edges: dict[int, dict[int, tuple[list[str], list[float]]]] = {0: {}, -1: {}}
        self._parts = TwoGenerations(memo_words)
        self._stable: dict[int, bool] = {}
        self._words = TwoGenerations(memo_words)
        self._plain = [self._plain_bytes(i) for i in range(len(self.pieces))]

    def _shorter(self, piece: str) -> int:
        """The id of the longest other piece that the piece begins with."""
        return next((i for n in range(len(piece) - 1, 0, -1) if (i := self.ids.get(piece[:n])) is not None), -1)

    def _plain_bytes(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == _BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == _UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == _CONTROL else self.pieces[i].replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[str]:
        """Merge the characters of a short text: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            at, _ = self._best(parts)
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, left: int, right: int) -> bool:
        """Do the two pieces stay apart, and whole, when their characters are merged anew?"""
        key = left << 21 | right
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) >= 1 << 19:
                self._stable.clear()
            if left == _ALONE:
                known = len(self.merged(self._part(right))) == 1
            else:
                known = self._apart(left, right)
            self._stable[key] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Re-merge both sides only along the boundary: does a merge across it ever come first?"""
        (xs, x_ends), (ys, y_ends) = self._edge(left, -1), self._edge(right, 0)
        if not xs or not ys:
            a, b = self._part(left), self._part(right)
            return self.merged(a + b) == [a, b]
        i = j = 0
        while True:
            across = self.ids.get(xs[i] + ys[j])
            score = None if across is None else self.scores[across]
            if score is not None and score > x_ends[i] and score >= y_ends[j]:
                return False
            if x_ends[i] == y_ends[j] == _NEVER:
                return True
            if x_ends[i] >= y_ends[j]:
                i += 1
            else:
                j += 1

    def _edge(self, piece: int, side: int) -> tuple[list[str], list[float]]:
        """The parts that lie at one end of a piece one after another while it is merged, from the character
        to the whole, and the score of the merge that ends each. Empty if scores do not fall along them."""
        known = self._edges[side].get(piece)
        if known is None:
            text = self._part(piece)
            trace = [text[side]]
            ends: list[float] = []
            parts = list(text)
            while len(parts) > 1:
                at, best = self._best(parts)
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if parts[side] != trace[-1]:
                    trace.append(parts[side])
                    ends.append(best)
            falls = all(x > y for x, y in zip(ends, ends[1:]))
            known = self._edges[side][piece] = (trace, [*ends, _NEVER]) if len(parts) == 1 and falls else ([], [])
        return known

    def _best(self, parts: list[str]) -> tuple[int, float]:
        best, at = _NEVER, -1
        for i in range(len(parts) - 1):
            j = self.ids.get(parts[i] + parts[i + 1])
            if j is not None and self.scores[j] > best:
                best, at = self.scores[j], i
        return at, best

    def _part(self, i: int) -> str:
        return self.pieces[i] if i < len(self.pieces) else chr(i - len(self.pieces))

    def backtrack(self, segment: str) -> list[int]:
        """Vocabulary ids; a character that no piece covers is len(pieces) plus its code point."""
        n = len(segment)
        if (whole := self.ids.get(segment)) is not None and self.stable_alone(whole):
            return [whole]
        longest = [0] * n
        for last, (size, i) in self.machine.iter(segment):
            longest[last - size + 1] = i  # matches come by their end, so the longest from a start comes last
        base, sizes, shorter, known = len(self.pieces), self.sizes, self.shorter, self._stable
        dead = 0  # bit i: nothing that reached position i could go on
        out: list[int] = []
        at, left = 0, _ALONE
        choice = longest[0] or base + ord(segment[0])
        while at < n:
            while choice >= 0:
                end = at + (sizes[choice] if choice < base else 1)
                if not dead >> end & 1:
                    fits = known.get(left << 21 | choice)
                    if fits if fits is not None else self.stable(left, choice):
                        break
                choice = shorter[choice] if choice < base else -1
                if choice < 0 and end - at > 1:
                    choice = base + ord(segment[at])
            if choice >= 0:
                out.append(choice)
                at, left = end, choice
                if at < n:
                    choice = longest[at] or base + ord(segment[at])
            else:
                if not out:
                    raise ValueError("no encoding")
                dead |= 1 << at
                choice = out.pop()
                at -= sizes[choice] if choice < base else 1
                left = out[-1] if out else _ALONE
        return out

    def stable_alone(self, i: int) -> bool:
        """Does merging the piece's characters give the piece?"""
        return self.stable(_ALONE, i)

    def segment_ids(self, segment: str) -> list[int]:
        """Between a letter and another character no piece reaches, but for those in self.beside: cut there first."""
        parts = [segment] if self.beside.search(segment) else _LETTERS.findall(segment)
        out: list[int] = []
        for part in parts:
            ids = self._parts.get(part)
            if ids is None:
                ids = self.backtrack(part)
                if len(part) <= 64:
                    self._parts.put(part, ids)
            out += ids
        base = len(self.pieces)
        return self._with_bytes(out) if out and max(out) >= base else out

    def _with_bytes(self, found: list[int]) -> list[int]:
        base, out = len(self.pieces), []
        for i in found:
            if i < base:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(i - base).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def word(self, key: str) -> tuple[int, str, bytes]:
        """(number of ids, ids as decimal text, decoded bytes) of the segment that one space and key make."""
        known = self._words.get(key)
        if known is None:
            ids = self.segment_ids(SPACE + key)
            known = len(ids), " ".join(map(str, ids)), b"".join(self._plain[i] for i in ids)
            if len(key) <= 64:
                self._words.put(key, known)
        return known

    @staticmethod
    def segments(text: str) -> list[str]:
        """The keys for word(): a segment is a run of spaces with what follows, and no piece crosses its ends."""
        return [s[1:] for s in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))] if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for key in self.segments(text or "") for i in self.segment_ids(SPACE + key)]

    def decode(self, ids: list[int]) -> str:
        """Invalid byte sequences become U+FFFD; the space of the dummy prefix is taken off."""
        raw = b"".join(self._plain[i] for i in ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", errors="replace")

    def columns(self, texts: pa.StringArray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of each text: number of ids, ids as decimal text, decoded bytes with the prefix space."""
        odd = pc.or_(pc.match_substring_regex(texts, f"  |^ | $|{SPACE}"), pc.equal(pc.binary_length(texts), 0))
        words = pc.split_pattern(texts, " ")
        offsets, flat = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        offsets = offsets - offsets[0]
        known = list(map(self.word, flat.dictionary.to_pylist()))
        counts = np.fromiter((k[0] for k in known), np.int64, len(known))
        index = flat.indices
        sums = np.concatenate(([0], np.cumsum(counts[index.to_numpy()])))
        n = sums[offsets[1:]] - sums[offsets[:-1]]
        ends = pa.array(offsets, pa.int32())
        ids = pc.binary_join(pa.ListArray.from_arrays(ends, pa.array([k[1] for k in known], pa.string()).take(index)), " ")
        plain = pc.binary_join(pa.ListArray.from_arrays(ends, pa.array([k[2] for k in known], pa.binary()).take(index)), b"")
        if pc.any(odd).as_py():
            which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            own = {int(r): [self.word(key) for key in self.segments(texts[int(r)].as_py())] for r in which}
            ids, plain = ids.to_pylist(), plain.to_pylist()
            for r, parts in own.items():
                n[r], ids[r], plain[r] = sum(p[0] for p in parts), " ".join(p[1] for p in parts), b"".join(p[2] for p in parts)
            ids, plain = pa.array(ids, pa.string()), pa.array(plain, pa.binary())
        return n, ids, plain


def piece_model(path: str) -> PieceModel:
    return once("pieces", path, lambda: PieceModel(path))


def encode_documents(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True) -> DataFrame:
    """(id, ids array<int>): the ids of every text, in the row order of documents, without a shuffle."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        model = piece_model(model_path)
        tail = [model.end] if add_end else []
        for batch in text_slices(batches, text_col):
            _, ids, _ = model.columns(texts_of(batch, text_col))
            rows = [[*map(int, x.split()), *tail] for x in ids.to_pylist()]
            yield as_batch(**{id_col: column_of(batch, id_col), "ids": pa.array(rows, pa.list_(pa.int32()))})

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text that each id list stands for; null lists give the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        model = piece_model(model_path)
        for batch in batches:
            texts = [model.decode(x or []) for x in column_of(batch, ids_col).to_pylist()]
            yield as_batch(**{id_col: column_of(batch, id_col), "text": pa.array(texts, pa.string())})

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """Encode, append the end id and decode each text in one pass.

    With digest: (id, n_tokens, ids_sha256, decoded_sha256); else (id, n_tokens, ids as decimal text, decoded).
    """
    kind = documents.schema[id_col].dataType.simpleString()
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")

    def run(batches):
        model = piece_model(model_path)
        for batch in text_slices(batches, text_col):
            n, ids, plain = model.columns(texts_of(batch, text_col))
            ids = [f"{x} {model.end}" if x else str(model.end) for x in ids.to_pylist()]
            texts = [(x[1:] if x[:1] == b" " else x).decode("utf-8", errors="replace") for x in plain.to_pylist()]
            if digest:
                ids = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
                texts = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
            yield as_batch(**{id_col: column_of(batch, id_col), "n_tokens": pa.array(n + 1, pa.int64()), names[0]: pa.array(ids, pa.string()), names[1]: pa.array(texts, pa.string())})

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {names[0]} string, {names[1]} string")
