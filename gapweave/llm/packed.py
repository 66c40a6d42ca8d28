"""Sorted hash arrays: packed for the shuffle, stored as shards, memory-mapped for lookups.

Map tasks pack their entries into one blob for each shard (sorted keys as deltas,
byte planes, zstd), so that a shuffle moves a few bytes an entry instead of a row
each.  A shard holds the keys whose top bits equal its number, so shards in order
are one sorted array.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

BLOBS = "bucket int, blob binary"
_HEAD = struct.Struct("<qi")
_COL = struct.Struct("<2sq")


def encode(cols: list[np.ndarray], deltas: bool = True) -> bytes:
    """Columns of equal length as one blob; the first, if ascending, as deltas."""
    out, level = [_HEAD.pack(len(cols[0]), len(cols) * (1 if deltas else -1))], zstandard.ZstdCompressor(level=1)
    for i, col in enumerate(cols):
        if deltas and not i:
            col = np.diff(col, prepend=col.dtype.type(0))
        planes = np.ascontiguousarray(col).view(np.uint8).reshape(len(col), col.itemsize).T
        body = level.compress(np.ascontiguousarray(planes).tobytes())
        out += [_COL.pack(col.dtype.str[1:].encode(), len(body)), body]
    return b"".join(out)


def decode(blob: bytes) -> list[np.ndarray]:
    """The columns that encode() packed."""
    n, k = _HEAD.unpack_from(blob)
    at, cols, reader = _HEAD.size, [], zstandard.ZstdDecompressor()
    for i in range(abs(k)):
        kind, size = _COL.unpack_from(blob, at)
        at += _COL.size
        dtype = np.dtype(kind.decode())
        raw = np.frombuffer(reader.decompress(blob[at : at + size], max_output_size=max(1, n * dtype.itemsize)), np.uint8)
        at += size
        col = np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
        cols.append(np.cumsum(col, dtype=dtype) if k > 0 and not i else col)
    return cols


def blobs(keys: np.ndarray, cols: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """One row a shard from ascending keys and their columns."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    lo, hi = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
    full = np.flatnonzero(hi > lo)
    made = [encode([keys[a:b], *(c[a:b] for c in cols)]) for a, b in zip(lo[full], hi[full])]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(made, pa.binary())], ["bucket", "blob"])


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """The decoded blobs of a partition shard by shard, so that one shard is held at a time; rows have to come sorted by shard."""
    now, got = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != now:
                if got:
                    yield now, got
                now, got = bucket, []
            got.append(decode(blob.as_buffer().to_pybytes()))
    if got:
        yield now, got


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int, most: int = 2 << 20) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches in pieces of about so many rows that never cut a run of equal keys (the first columns)."""
    held: list[list[np.ndarray]] = []
    size, limit = 0, most
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size < limit:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0))
        if not len(change):
            held, limit = [cols], 2 * size
            continue
        cut = int(change[-1]) + 1
        yield [c[:cut] for c in cols]
        held, size, limit = [[c[cut:] for c in cols]], size - cut, most
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def merge(parts: list[list[np.ndarray]], how: list[Callable]) -> list[np.ndarray]:
    """Join parts, sort by the first column and reduce the others over equal keys by the ufuncs given."""
    keys, *cols = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)
    return [keys[at], *(f.reduceat(c[order], at) if len(at) else c for f, c in zip(how, cols))]


def write_shard(folder: str, bucket: int, cols: list[np.ndarray]) -> None:
    """One file a shard, put in place whole, so that a task that runs twice leaves the same file."""
    os.makedirs(folder, exist_ok=True)
    made = f"{folder}/.{bucket}-{uuid.uuid4().hex}"
    with open(made, "wb") as f:
        f.write(struct.pack("<q", len(cols[0])))
        for c in cols:
            f.write(np.ascontiguousarray(c).data)
    os.replace(made, f"{folder}/{bucket}")


class Store:
    """Lookups in shards by memory map.  kinds: the dtypes of the key and of each value."""

    def __init__(self, folder: str, bits: int, kinds: list[str], full: set[int]):
        self.folder, self.bits, self.kinds, self.full = folder, bits, kinds, full

    def shard(self, bucket: int) -> list[np.ndarray]:
        raw = np.memmap(f"{self.folder}/{bucket}", np.uint8, "r")
        n, at, cols = int(raw[:8].view(np.int64)[0]), 8, []
        for kind in self.kinds:
            size = n * np.dtype(kind).itemsize
            cols.append(raw[at : at + size].view(kind))
            at += size
        return cols

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of ascending keys: which are stored, and their values (0 where not)."""
        found = np.zeros(len(keys), bool)
        values = [np.zeros(len(keys), k) for k in self.kinds[1:]]
        edges = np.searchsorted(keys, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        lo, hi = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        for bucket in np.flatnonzero(hi > lo):
            if int(bucket) not in self.full:
                continue
            a, b = lo[bucket], hi[bucket]
            own, *cols = self.shard(bucket)
            at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
            hit = own[at] == keys[a:b]
            found[a:b] = hit
            for v, c in zip(values, cols):
                v[a:b][hit] = c[at[hit]]
        return found, values

    def lookup_pair(self, keys: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of ascending keys with a second part: which are stored with it, and their values.  The store's second column is the second part; equal keys lie together."""
        found = np.zeros(len(keys), bool)
        values = [np.zeros(len(keys), k) for k in self.kinds[2:]]
        edges = np.searchsorted(keys, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        lo, hi = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        for bucket in np.flatnonzero(hi > lo):
            if int(bucket) not in self.full:
                continue
            a, b = lo[bucket], hi[bucket]
            own, other, *cols = self.shard(bucket)
            at = np.searchsorted(own, keys[a:b])
            todo = np.flatnonzero(at < len(own))
            while len(todo):
                todo = todo[own[at[todo]] == keys[a:b][todo]]
                right = other[at[todo]] == second[a:b][todo]
                hit = todo[right]
                found[a + hit] = True
                for v, c in zip(values, cols):
                    v[a + hit] = c[at[hit]]
                todo = todo[~right]
                at[todo] += 1
                todo = todo[at[todo] < len(own)]
        return found, values


def pair_store(table, folder: str, bits: int) -> Store:
    """A table (k1 long, k2 long, value long; no nulls, keys distinct) as sorted arrays of (k1, k2, value) by mixed k1; see pair_values()."""
    from .textops import mix

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k1, k2, value = (c.to_numpy() for c in batch.columns)
                k1 = mix(k1.astype(np.uint64))
                order = np.argsort(k1, kind="stable")
                yield blobs(k1[order], [k2[order], value[order]], bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in streamed(batches):
            k1, k2, value = (np.concatenate(c) for c in zip(*got))
            order = np.argsort(k1, kind="stable")
            write_shard(folder, bucket, [k1[order], k2[order], value[order]])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32())], ["bucket"])

    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = table.mapInArrow(spread, BLOBS).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(keep, "bucket int").collect()
    return Store(folder, bits, ["u8", "i8", "i8"], {r[0] for r in full})


def pair_values(store: Store, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys (int64) which a pair_store() has, and their values."""
    from .textops import mix

    keys = mix(k1.astype(np.uint64))
    order = np.lexsort((k2, keys))
    found, (value,) = store.lookup_pair(keys[order], k2[order])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return found[back], value[back]


def id_store(ids, folder: str, bits: int) -> Store:
    """A table's integer column of ids (no nulls), as sorted arrays of mixed ids; see holds()."""
    from .textops import mix

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield blobs(np.unique(mix(batch.column(0).cast(pa.int64()).to_numpy().astype(np.uint64))), [], bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in streamed(batches):
            write_shard(folder, bucket, [np.unique(np.concatenate([g[0] for g in got]))])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32())], ["bucket"])

    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = ids.mapInArrow(spread, BLOBS).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(keep, "bucket int").collect()
    return Store(folder, bits, ["u8"], {r[0] for r in full})


def holds(store: Store, ids: pa.Array) -> np.ndarray:
    """Which ids an id_store() has; null is never one."""
    from .textops import mix

    own = ids.cast(pa.int64())
    keys, back = np.unique(mix(own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)), return_inverse=True)
    return store.lookup(keys)[0][back] & own.is_valid().to_numpy(zero_copy_only=False)
