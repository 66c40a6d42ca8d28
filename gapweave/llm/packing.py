"""Best-fit decreasing packing of documents into windows of fixed length.

Each task packs its own rows without a shuffle, a block of tokens at a time, so memory
is bounded whatever the input; a block of a thousand windows ends with at most a few
that are not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops, wordbpe
from .shared import prepare

WINDOW = 4096
#: Tokens that are packed together: about 1,000 windows.
BLOCK = 4 << 20


class OpenWindows:
    """Open windows by the room that is left, with a segment tree over room for the tightest fit."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.held: list[list[int]] = [[] for _ in range(self.base)]

    def add(self, room: int, which: int) -> None:
        self.held[room].append(which)
        at = self.base + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room that is at least need, and its room; it is no longer open."""
        count, at = self.count, self.base + need
        if not count[at]:
            # Up to the first ancestor with something to its right, then down its left edge.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.base:
                at *= 2
                at += not count[at]
        room = at - self.base
        while at:
            count[at] -= 1
            at >>= 1
        return self.held[room].pop(), room


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """For pieces of at most a window: each one's window and offset there, and the number of windows.  Longest first; equal lengths in order."""
    bins, where, offset, n = OpenWindows(window), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        if (got := bins.take(need)) is None:
            got, n = (n, window), n + 1
        where[i], offset[i] = got[0], window - got[1]
        if got[1] > need:
            bins.add(got[1] - need, got[0])
    return where, offset, n


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Per piece: id, start, length, doc_tokens, sequence_id, offset and ids (32-bit little-endian).

    Documents end with an end id; those longer than a window are first cut into full
    windows and a rest.  A null or empty text has the end id alone.  Windows are numbered
    by task and in a task, uniquely; what a window does not hold is padding up to its
    length.  Rows with equal or null ids are packed each for itself, an empty table gives no rows,
    and of pieces of one length the earlier row goes first.  Other columns are not read.
    """
    prepare(docs.sparkSession)
    path = vocabulary or wordbpe.vocabulary_path()
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])

    def packed(held: list[tuple[pa.Array, np.ndarray, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
        ids = np.concatenate([x[1] for x in held])
        sizes = np.concatenate([np.diff(x[2]) for x in held])
        begin = np.cumsum(sizes) - sizes
        pieces = -(-sizes // window)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
        length = np.minimum(window, sizes[doc] - start)
        where, offset, n = best_fit(length.tolist(), window)
        at = (begin[doc] + start).tolist()
        cut = [ids[a : a + k].astype("<u4").tobytes() for a, k in zip(at, length.tolist())]
        names = pa.concat_arrays([x[0] for x in held]).take(pa.array(doc))
        cols = [names, pa.array(start), pa.array(length), pa.array(sizes[doc]), pa.array(np.array(where, np.int64) + first), pa.array(offset, pa.int64()), pa.array(cut, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, schema.names), first + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordbpe.encoder(path)
        held, tokens, first = [], 0, TaskContext.get().partitionId() << 32
        for batch in textops.chunks(batches, "_text"):
            ids, starts = encoder.encode(batch.column("_text"))
            held.append((batch.column("_id"), ids, starts))
            tokens += len(ids)
            if tokens >= BLOCK:
                made, first = packed(held, first)
                yield made
                held, tokens = [], 0
        if held:
            yield packed(held, first)[0]

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
