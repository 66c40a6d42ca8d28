"""Token files as wavelet matrices: access, counting and occurrence lookup in one compressed file.

A shard's symbols are ranked by frequency.  A selector bit tells the 255 most frequent
symbols from the rest, and each class has a wavelet matrix of its own: bit-planes from
the highest bit, after each of which the zeros move stably before the ones.  Bit vectors
are cut into blocks that are compressed one by one, with the number of ones before each
block beside them, so a lookup decompresses one block a plane.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops, wordbpe
from .shared import integer_id, local_path, prepare, scratch, written

MAGIC = b"WMTOKEN1"
BLOCK, FREQUENT = 8192, 255
#: Tokens after which a shard is closed.
SHARD = 4 << 20
_FILES = "file string, part int, before long, tokens long, docs long"


def _put(cols: list[np.ndarray]) -> bytes:
    raw = b"".join(struct.pack("<2sq", c.dtype.str[1:].encode(), len(c)) + np.ascontiguousarray(c).tobytes() for c in cols)
    body = zstandard.ZstdCompressor(level=1).compress(raw)
    return struct.pack("<qq", len(cols), len(body)) + body


def _get(raw: memoryview, at: int) -> tuple[list[np.ndarray], int]:
    n, size = struct.unpack_from("<qq", raw, at)
    body, cols, k = zstandard.ZstdDecompressor().decompress(raw[at + 16 : at + 16 + size]), [], 0
    for _ in range(n):
        kind, count = struct.unpack_from("<2sq", body, k)
        dtype = np.dtype(kind.decode())
        cols.append(np.frombuffer(body, dtype, count, k + 10))
        k += 10 + count * dtype.itemsize
    return cols, at + 16 + size


def _bits(b: np.ndarray) -> bytes:
    """A bit vector: its length, ones before each block, block sizes, blocks."""
    raw = np.packbits(b, bitorder="little")
    raw = np.concatenate([raw, np.zeros(-len(raw) % BLOCK, np.uint8)])
    ones = np.bitwise_count(raw).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
    packer = zstandard.ZstdCompressor(level=1)
    blocks = [packer.compress(raw[k : k + BLOCK].data) for k in range(0, len(raw), BLOCK)]
    head = _put([np.array([len(b), int(ones.sum())]), np.cumsum(ones) - ones, np.array([len(x) for x in blocks], np.int64)])
    return head + b"".join(blocks)


class Bits:
    """rank and select over a compressed bit vector."""

    def __init__(self, raw: memoryview, at: int):
        ((n, ones), self.before, sizes), at = _get(raw, at)
        self.n, self.ones, self.raw = int(n), int(ones), raw
        self.at = at + np.concatenate([[0], np.cumsum(sizes)])
        self.end = int(self.at[-1])
        self.block = lru_cache(4)(self._block)

    def _block(self, k: int) -> np.ndarray:
        body = zstandard.ZstdDecompressor().decompress(self.raw[int(self.at[k]) : int(self.at[k + 1])], max_output_size=BLOCK)
        return np.frombuffer(body, np.uint8)

    def bit(self, i: int) -> int:
        return int(self.block(i // (8 * BLOCK))[i // 8 % BLOCK]) >> (i % 8) & 1

    def rank1(self, i: int) -> int:
        """Ones before position i."""
        if i >= self.n:
            return self.ones
        k = i // (8 * BLOCK)
        own = self.block(k)
        whole = i // 8 % BLOCK
        return int(self.before[k]) + int(np.bitwise_count(own[:whole]).sum()) + (int(own[whole]) & ((1 << i % 8) - 1)).bit_count()

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, j: int) -> int:
        """The position of the j-th (from 0) such bit."""
        starts = np.arange(len(self.before)) * 8 * BLOCK
        before = self.before if bit else starts - self.before
        k = int(np.searchsorted(before, j, side="right")) - 1
        flags = np.unpackbits(self.block(k), bitorder="little")
        return k * 8 * BLOCK + int(np.flatnonzero(flags == bit)[j - int(before[k])])

    def all(self) -> np.ndarray:
        whole = np.concatenate([self._block(k) for k in range(len(self.before))] or [np.zeros(0, np.uint8)])
        return np.unpackbits(whole, count=self.n, bitorder="little").view(bool)


def _matrix(seq: np.ndarray, width: int) -> bytes:
    out = [struct.pack("<q", width)]
    for level in reversed(range(width)):
        b = (seq >> level & 1).view(np.uint8 if seq.itemsize == 1 else seq.dtype).astype(bool)
        out.append(_bits(b))
        seq = np.concatenate([np.compress(~b, seq), np.compress(b, seq)])
    return b"".join(out)


class Matrix:
    """A wavelet matrix: access, rank and select of symbols."""

    def __init__(self, raw: memoryview, at: int):
        (width,) = struct.unpack_from("<q", raw, at)
        self.planes, at = [], at + 8
        for _ in range(width):
            self.planes.append(Bits(raw, at))
            at = self.planes[-1].end
        self.end = at

    def access(self, i: int) -> int:
        value = 0
        for p in self.planes:
            bit = p.bit(i)
            value = 2 * value + bit
            i = p.n - p.ones + p.rank1(i) if bit else i - p.rank1(i)
        return value

    def _down(self, symbol: int, i: int) -> int:
        for k, p in enumerate(self.planes):
            bit = symbol >> (len(self.planes) - 1 - k) & 1
            i = p.rank(bit, i) + bit * (p.n - p.ones)
        return i

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of the symbol before position i."""
        return self._down(symbol, i) - self._down(symbol, 0)

    def select(self, symbol: int, j: int) -> int:
        i = self._down(symbol, 0) + j
        for k, p in reversed(list(enumerate(self.planes))):
            bit = symbol >> (len(self.planes) - 1 - k) & 1
            i = p.select(bit, i - bit * (p.n - p.ones))
        return i

    def all(self, n: int) -> np.ndarray:
        now = np.zeros(n, np.uint8 if len(self.planes) <= 8 else np.uint32)
        for k, p in enumerate(reversed(self.planes)):
            b = p.all()
            up, zeros = np.empty_like(now), p.n - p.ones
            up[np.flatnonzero(b)] = now[zeros:] | now.dtype.type(1 << k)
            up[np.flatnonzero(~b)] = now[:zeros]
            now = up
        return now


def write(path: str, ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> None:
    """One shard: token ids of its documents in a row, the documents' integer ids (nulls allowed) and lengths."""
    counts = np.bincount(ids)
    ranked = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())].astype(np.uint32)
    rank = np.zeros(len(counts), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    seq = rank[ids]
    rare = seq >= FREQUENT
    names = doc_ids.cast(pa.int64()).fill_null(0).to_numpy()
    nulls = doc_ids.is_null().to_numpy(zero_copy_only=False).view(np.uint8)
    others = np.compress(rare, seq) - np.uint32(FREQUENT)
    width = max(1, int(max(0, len(ranked) - FREQUENT - 1)).bit_length())
    others = others.astype(np.uint16) if width <= 16 else others
    made = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with open(made, "wb") as f:
        f.write(MAGIC + _put([ranked, names, nulls, lengths.astype(np.int64)]) + _bits(rare))
        f.write(_matrix(np.compress(~rare, seq).astype(np.uint8), 8))
        f.write(_matrix(others, width))
    os.replace(made, path)


class Shard:
    """One token file, memory-mapped."""

    def __init__(self, path: str):
        raw = memoryview(np.memmap(path, np.uint8, "r"))
        if bytes(raw[:8]) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        (self.symbols, names, nulls, self.lengths), at = _get(raw, 8)
        self.doc_ids = pa.array(names, mask=nulls.astype(bool))
        self.rare = Bits(raw, at)
        self.frequent = Matrix(raw, self.rare.end)
        self.others = Matrix(raw, self.frequent.end)
        self.place = {int(s): k for k, s in enumerate(self.symbols)}

    def __len__(self) -> int:
        return self.rare.n

    def token(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        if self.rare.bit(i):
            return int(self.symbols[FREQUENT + self.others.access(self.rare.rank1(i))])
        return int(self.symbols[self.frequent.access(self.rare.rank(0, i))])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token occurs in positions lo to hi."""
        if (k := self.place.get(token)) is None:
            return 0
        other = k >= FREQUENT
        own, symbol = (self.others, k - FREQUENT) if other else (self.frequent, k)
        a, b = (self.rare.rank(int(other), min(max(x, 0), len(self))) for x in (lo, len(self) if hi is None else hi))
        return max(0, own.rank(symbol, b) - own.rank(symbol, a))

    def locate(self, token: int, j: int) -> int:
        """The position of the token's j-th occurrence, from 0."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        k = self.place[token]
        other = k >= FREQUENT
        own, symbol = (self.others, k - FREQUENT) if other else (self.frequent, k)
        return self.rare.select(int(other), own.select(symbol, j))

    def decode(self) -> np.ndarray:
        """All tokens in order."""
        rare = self.rare.all()
        out = np.empty(len(rare), np.uint32)
        out[np.flatnonzero(~rare)] = self.symbols[self.frequent.all(self.rare.n - self.rare.ones)]
        out[np.flatnonzero(rare)] = self.symbols[FREQUENT:][self.others.all(self.rare.ones)] if self.rare.ones else []
        return out


def write_tokens(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write all documents' ids as shards in ascending order of id (null ids first) under uri; the list of files.

    Columns: file, part, before (tokens earlier in the part), tokens, docs.  Repeated ids
    keep each of their rows, in the order of the texts' hashes, so rows of one id need not share a task.
    Null and empty texts have the end id alone, very long texts are encoded whole.  Ids have to be
    integers (an error otherwise).  An empty table writes no file; other columns are not read.
    """
    integer_id(docs, id_col)
    spark = prepare(docs.sparkSession)
    path, folder = vocabulary or wordbpe.vocabulary_path(), local_path(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = wordbpe.encoder(path), TaskContext.get().partitionId()
        before, k = 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal before, k
            ids = np.concatenate([x[1] for x in held])
            lengths = np.concatenate([np.diff(x[2]) for x in held])
            file = f"{folder}/tokens-{part:06d}-{k:04d}.wm"
            os.makedirs(folder, exist_ok=True)
            write(file, ids, pa.concat_arrays([x[0] for x in held]), lengths)
            row = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([part], pa.int32()), pa.array([before]), pa.array([len(ids)]), pa.array([len(lengths)])], ["file", "part", "before", "tokens", "docs"])
            before, k = before + len(ids), k + 1
            held.clear()
            return row

        # More texts at once repeat more words, each of which is encoded once a chunk.
        for batch in textops.chunks(batches, "_text", 16 << 20):
            held.append((batch.column("_id"), *encoder.encode(batch.column("_text"))))
            if sum(len(x[1]) for x in held) >= SHARD:
                yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "_id", "_hash").sortWithinPartitions("_id", "_hash").select("_id", "_text")
    # Larger batches for this job alone.
    wide = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}
    before = {k: spark.conf.get(k) for k in wide}
    for k, v in wide.items():
        spark.conf.set(k, v)
    try:
        return written(ordered.mapInArrow(run, _FILES), f"{uri}/list")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_tokens(files: DataFrame, id_type: str = "long") -> DataFrame:
    """Per document of the listed files: doc_id, start among all documents, n_tokens and ids_crc32, all from the files.

    Null ids stay null, repeated rows have a result each, an empty list has none.
    """
    spark = prepare(files.sparkSession)
    # One total a part: as many numbers as shuffle partitions wrote files.
    totals = sorted(files.groupBy("part").agg(F.sum("tokens")).collect())
    ahead = dict(zip([p for p, _ in totals], np.cumsum([0, *(n for _, n in totals)]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"])
                raw = memoryview(shard.decode().astype("<u4").tobytes())
                upto = np.concatenate([[0], np.cumsum(shard.lengths)])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                start = upto[:-1] + (ahead[row["part"]] + row["before"])
                yield pa.RecordBatch.from_arrays([shard.doc_ids, pa.array(start), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None) -> DataFrame:
    """write_tokens() to uri (default: a scratch folder), then read_tokens(), with their rules for nulls, empty texts and repeated rows."""
    return read_tokens(write_tokens(docs, uri or scratch(docs.sparkSession, "tokens"), id_col, text_col)).withColumnRenamed("doc_id", id_col)
