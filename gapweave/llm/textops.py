"""Words and their hashes for whole Arrow columns at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of a word up to which its hash is a sum over its bytes.
LONG = 64
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit values (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of 64-bit values."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD1B54A32D192ED03)))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about that many text bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def split(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and where each text's words start (one more entry ends the last); a null text has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    keep = pc.greater(pc.binary_length(flat), 0)
    if pc.all(keep).as_py() is not False:
        return flat, ends
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return flat.filter(keep), before[ends]


def encoded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word and the distinct words in order of code."""
    d = words.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """encoded() with the distinct words as a list."""
    codes, distinct = encoded(words)
    return codes, distinct.to_pylist()


@cache
def _table(seed: int) -> np.ndarray:
    """A random 64-bit value for each place in a word and byte there."""
    at = np.arange(LONG * 256, dtype=np.uint64) + np.uint64(seed * LONG * 256)
    return mix(mix(at + np.uint64(0x9E3779B97F4A7C15)) ^ _C2).reshape(LONG, 256)


def hashed(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words: the sum of a random value for each byte by its place (tabulation), mixed with the length; words over ``LONG`` bytes by XXH64."""
    n = len(distinct)
    if not n:
        return np.zeros(0, np.uint64)
    _, offsets, data = distinct.buffers()
    start = np.frombuffer(offsets, np.int32)[distinct.offset : distinct.offset + n + 1].astype(np.int64)
    raw, size = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.diff(start)
    order = np.argsort(-size, kind="stable")
    at, length, table = start[:-1][order], size[order], _table(seed)
    total = np.zeros(n, np.uint64)
    for j in range(min(int(length[0]), LONG)):
        k = int(np.searchsorted(-length, -j))
        total[:k] += table[j][raw[at[:k] + j]]
    out = np.empty(n, np.uint64)
    out[order] = mix(total ^ (length.astype(np.uint64) << np.uint64(32)))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(distinct[k].as_py(), seed)
    return out


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive values, by doubling; one less than width entries shorter."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    while done < width:
        if width & size:
            if out is None:
                out = power
            else:
                n = min(len(out), len(power) - done)
                out = pair(out[:n], power[done : done + n])
            done += size
        if done < width:
            power = pair(power[: len(power) - size], power[size:])
            size *= 2
    return out[: len(h) - width + 1]


def within(starts: np.ndarray, width: int) -> np.ndarray:
    """Which word positions start a run of width words inside one text."""
    total = int(starts[-1])
    ends = np.repeat(starts[1:], np.diff(starts))
    return np.arange(total) + width <= ends
