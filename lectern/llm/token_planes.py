"""Operator 9: token ids in a binary file format of compressed bit or byte planes.

A shard is a sequence of frames, each followed by one newline byte, as the text writer leaves them:

    frame   = kind (1 byte: B or X) + payload size (uint32) + payload
    B       = one block: number of ids (uint32), unit (1 byte: 1 bit planes, 8 byte planes),
              32 // unit plane sizes (uint32), then the planes, each a zstandard frame, empty if all zero
    X       = the chunk index, last in the shard, zstandard over: shard number (uint32), block size (uint32),
              documents n (uint32), blocks m (uint32), m block positions (uint64),
              n id-list lengths (uint64), then the n document ids as JSON

All numbers are little-endian. Blocks hold a fixed count of ids but for the last and run across documents; the
k-th document's ids start at the sum of the lengths before it. Shards are numbered in ascending document order.

A null text counts as empty (its only id is the end id). A repeated document id gives a list for each row; null ids
come first. An empty table gives no shard and no row. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.runtime import TwoGenerations, as_batch, column_of, free_name, fresh_path, once, read_files, staged, text_slices, texts_of, write_frames

#: Ids of a block.
BLOCK_IDS = 65_536
#: Text bytes of a shard, about; a longer text is not cut.
SHARD_BYTES = 64 << 20
#: Bytes of text for a byte that the plan's statistics give for it, at most.
COMPRESSED = 6
#: Chunks of which a worker keeps the ids.
MEMO_PARTS = 200_000
LEVEL = 1
_WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The pre-tokenizer also cuts where a letter or digit meets a sign (an apostrophe may start a token with letters),
#: and at both sides of a line feed between two characters that are no white space.
_CUTS = ((rf"([\p{{L}}\p{{N}}])([^{_WHITE}\p{{L}}\p{{N}}'\x00])", "\\1\0\\2"), (rf"([^{_WHITE}\x00])\n([^{_WHITE}\x00])", "\\1\0\n\0\\2"))
#: Where a space stands beside other white space or at an end, cutting at spaces may not agree with the tokenizer.
_UNSAFE = rf"\x00|^ | $| [{_WHITE}]|[{_WHITE}] "


class ChunkEncoder:
    """Byte-level BPE through the tokenizers library, with a memo of chunks.

    The pre-tokenizer starts a token at each space between two characters that are no white space, and where _CUTS
    says, so the chunks' ids add up to the text's. Texts with other spacing, with a NUL, or with a special token's
    string, are encoded whole.
    """

    def __init__(self, path: str, memo: int = MEMO_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.unsafe = "|".join([_UNSAFE, *(f"\\Q{t}\\E" for t in special)])
        self.parts = TwoGenerations(memo)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, texts: list[str]) -> list[bytes]:
        found = list(map(self.parts.get, texts))
        missing = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(missing, self.whole([texts[i] for i in missing]), strict=True):
            found[i] = ids
            if len(ids) <= 128:
                self.parts.put(texts[i], ids)
        return found

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        odd = pc.match_substring_regex(texts, self.unsafe)
        cut = pc.replace_substring(texts, " ", "\0 ")
        for pattern, parted in _CUTS:
            cut = pc.replace_substring_regex(cut, pattern, parted)
        words = pc.split_pattern(cut, "\0")
        offsets, flat = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        known = self.chunks(flat.dictionary.to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(known, pa.binary()).take(flat.indices))
        out = pc.binary_join(lists, b"").to_pylist()
        if pc.any(odd).as_py():
            which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            for r, ids in zip(which, self.whole([texts[int(r)].as_py() for r in which]), strict=True):
                out[r] = ids
        return out


def encoder(path: str) -> ChunkEncoder:
    return once("token planes", path, lambda: ChunkEncoder(path))


def pack_block(ids: np.ndarray, unit: int = 8, level: int = LEVEL) -> bytes:
    """One block's payload. unit 8: byte planes, 1: bit planes, most significant last."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == 8:
        planes = [raw[:, k].tobytes() for k in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    press = zstandard.ZstdCompressor(level=level)
    packed = [press.compress(p) if any(p) else b"" for p in planes]
    return struct.pack("<IB", len(ids), unit) + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def unpack_block(payload: bytes) -> np.ndarray:
    n, unit = struct.unpack_from("<IB", payload)
    count = 32 // unit
    sizes = struct.unpack_from(f"<{count}I", payload, 5)
    at, plain, out = 5 + 4 * count, zstandard.ZstdDecompressor(), np.zeros((n, 4), np.uint8)
    bits = np.zeros((n, 32), np.uint8) if unit == 1 else None
    for k, size in enumerate(sizes):
        if size:
            plane = np.frombuffer(plain.decompress(payload[at : at + size]), np.uint8)
            if unit == 8:
                out[:, k] = plane
            else:
                bits[:, k] = np.unpackbits(plane, count=n, bitorder="little")
            at += size
    if unit == 1:
        out = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").reshape(-1)


def frame(kind: bytes, payload: bytes) -> bytes:
    return kind + struct.pack("<I", len(payload)) + payload


class ShardWriter:
    """Turns id lists into the frames of one shard."""

    def __init__(self, shard: int, unit: int = 8, block_ids: int = BLOCK_IDS):
        self.shard, self.unit, self.block = shard, unit, block_ids
        self.rest, self.rest_n, self.at = [], 0, 0
        self.positions: list[int] = []
        self.docs: list = []
        self.lengths: list[int] = []

    def _block(self, ids: np.ndarray) -> bytes:
        out = frame(b"B", pack_block(ids, self.unit))
        self.positions.append(self.at)
        self.at += len(out) + 1
        return out

    def add(self, doc, ids: bytes) -> Iterator[bytes]:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.rest.append(ids)
        self.rest_n += len(ids) // 4
        if self.rest_n >= self.block:
            have = np.frombuffer(b"".join(self.rest), "<u4")
            whole = len(have) // self.block * self.block
            for k in range(0, whole, self.block):
                yield self._block(have[k : k + self.block])
            self.rest, self.rest_n = [have[whole:].tobytes()], len(have) - whole

    def close(self) -> Iterator[bytes]:
        if self.rest_n:
            yield self._block(np.frombuffer(b"".join(self.rest), "<u4"))
        head = struct.pack("<4I", self.shard, self.block, len(self.docs), len(self.positions))
        body = np.array(self.positions, "<u8").tobytes() + np.array(self.lengths, "<u8").tobytes() + json.dumps(self.docs).encode()
        yield frame(b"X", zstandard.compress(head + body))


def read_shard(content: bytes) -> Iterator[tuple[int, object, bytes]]:
    """(shard, document id, its ids as little-endian bytes), in the order of writing."""
    view, at, blocks, index = memoryview(content), 0, [], None
    while at < len(content):
        kind, (size,) = content[at : at + 1], struct.unpack_from("<I", content, at + 1)
        if kind == b"B":
            blocks.append(at + 5)
        else:
            index = zstandard.decompress(bytes(view[at + 5 : at + 5 + size]))
        at += 6 + size
    if index is None:
        if blocks:
            raise ValueError("the shard has no index")
        return
    shard, _, n, m = struct.unpack_from("<4I", index)
    positions = np.frombuffer(index, "<u8", m, 16)
    lengths = np.frombuffer(index, "<u8", n, 16 + 8 * m)
    docs = json.loads(index[16 + 8 * (m + n) :])
    if [int(p) + 5 for p in positions] != blocks:
        raise ValueError("the index does not fit the blocks")
    held, held_n, b = [], 0, 0
    for doc, length in zip(docs, lengths.tolist(), strict=True):
        while held_n < length:
            (size,) = struct.unpack_from("<I", content, blocks[b] - 4)
            ids = unpack_block(bytes(view[blocks[b] : blocks[b] + size]))
            held.append(ids)
            held_n += len(ids)
            b += 1
        have = np.concatenate(held) if len(held) > 1 else held[0] if held else np.empty(0, "<u4")
        yield shard, doc, have[:length].tobytes()
        held, held_n = [have[length:]], held_n - length


def _text_bytes(documents: DataFrame, text_col: str) -> int:
    """About how many bytes of text there are: from the plan's statistics of the files, or else counted."""
    known = int(str(documents.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return known * COMPRESSED
    return documents.select(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0


def write_tokens(documents: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, unit: int = 8) -> None:
    """Encode every text, append end_id, and write shards in ascending id order below path."""
    end = struct.pack("<I", end_id)

    def run(batches):
        coder = encoder(tokenizer_path)
        writer = ShardWriter(TaskContext.get().partitionId(), unit)
        for batch in text_slices(batches, text_col):
            out: list[bytes] = []
            for doc, ids in zip(column_of(batch, id_col).to_pylist(), coder.encode(texts_of(batch, text_col)), strict=True):
                out += writer.add(doc, ids + end)
            if out:
                yield as_batch(frame=pa.array(out, pa.binary()))
        if writer.docs:
            yield as_batch(frame=pa.array(list(writer.close()), pa.binary()))

    # shards are sized by their text, whatever the session's partitions; rows of null and repeated ids are dealt on in the order read
    size = _text_bytes(documents, text_col)
    least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = free_name(documents, "_order")
    keyed = documents.select(id_col, text_col, F.monotonically_increasing_id().alias(order))
    ranged = keyed.repartitionByRange(max(least, -(-size // SHARD_BYTES)), id_col, order).sortWithinPartitions(id_col, order).select(id_col, text_col)
    write_frames(ranged.mapInArrow(run, "frame binary"), path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "long", with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files; start counts the ids before it."""
    kind = {"int": pa.int32(), "string": pa.string()}.get(id_type, pa.int64())

    def run(batches):
        for batch in batches:
            for content in column_of(batch, "content"):
                rows: list[tuple] = []
                at = 0

                def flush(rows=rows):
                    columns = dict(zip(("shard", "doc_id", "local", "n_tokens", "ids_crc32"), map(list, zip(*((r[0], r[1], r[2], r[3], r[4]) for r in rows))), strict=True))
                    if with_ids:
                        columns["ids"] = [np.frombuffer(r[5], "<u4").astype(np.int32) for r in rows]
                    columns["doc_id"] = pa.array(columns["doc_id"], kind)  # all ids of a shard may be null
                    out = pa.RecordBatch.from_pydict(columns)
                    rows.clear()
                    return out

                size = 0
                for shard, doc, ids in read_shard(content.as_py()):
                    n = len(ids) // 4
                    rows.append((shard, doc, at, n, zlib.crc32(ids), ids))
                    at, size = at + n, size + len(ids)
                    if size > 8 << 20:
                        yield flush()
                        size = 0
                if rows:
                    yield flush()

    schema = f"shard long, doc_id {id_type}, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = staged(read_files(spark, path).select("content").mapInArrow(run, schema), "token-index")
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = _running(totals)
    return found.join(F.broadcast(before), "shard").select("doc_id", (F.col("local") + F.col("_before")).alias("start"), *[c for c in found.columns if c not in ("shard", "doc_id", "local")])


def _running(totals: DataFrame, span: int = 4096) -> DataFrame:
    """(shard, _before): the sum of _n over smaller shards; spans of shards are summed apart, then together."""
    from pyspark.sql import Window

    part = totals.withColumn("_span", F.floor(F.col("shard") / span))
    spans = part.groupBy("_span").agg(F.sum("_n").alias("_sn"))
    ahead = spans.select("_span", (F.sum("_sn").over(Window.orderBy("_span")) - F.col("_sn")).alias("_ahead"))
    inside = F.sum("_n").over(Window.partitionBy("_span").orderBy("shard")) - F.col("_n")
    return part.withColumn("_inside", inside).join(F.broadcast(ahead), "_span").select("shard", (F.col("_inside") + F.col("_ahead")).alias("_before"))


def token_files(documents: DataFrame, tokenizer_path: str, end_id: int = 0, unit: int = 8) -> DataFrame:
    """Write the files to the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = documents.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(documents, tokenizer_path, path, end_id=end_id, unit=unit)
    return read_tokens(spark, path, documents.schema["doc_id"].dataType.simpleString(), with_ids=False)
