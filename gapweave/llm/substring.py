"""Removal of long word runs that an earlier document already has.

Difference-cover anchors: with a difference cover of the residues modulo a period,
any two equal runs of ``width`` words, wherever they lie, share an anchor of
``width - period + 1`` words at a position that the cover holds in both texts.  So
only anchors at cover positions are hashed and counted (a fifth of all positions).
Anchors that two documents hold are stored as sorted hash arrays; only windows that
contain one extend to their whole width and are compared, by 128 bits of hash.  Documents whose text
repeats an earlier one wholly stay out of the search: their windows are all repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed, textops
from .shared import buckets, integer_id, local_path, prepare, scratch

WIDTH = 50
#: Text bytes that are hashed at a time.
CHUNK = 4 << 20
#: A perfect difference set: every residue modulo 31 is a difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_INF = np.iinfo(np.int64).max


def _cover(period: int, width: int) -> tuple[int, tuple[int, ...]]:
    """The period and its cover; for narrow windows all positions."""
    return (period, COVER) if period == PERIOD and width > PERIOD else (1, (0,))


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, Callable[[], np.ndarray]]:
    """Word hashes, where texts start, the words, and a second family of hashes, made where it is asked for."""
    flat, starts = textops.split(texts)
    codes, distinct = textops.encoded(flat)
    return textops.hashed(distinct)[codes], starts, flat, lambda: textops.hashed(distinct, 1)[codes]


def _anchors(h: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and hashes of anchors at cover positions, and their width."""
    period, cover = _cover(PERIOD, width)
    size = width - period + 1
    inside = np.arange(len(h)) - np.repeat(starts[:-1], np.diff(starts))
    held = np.zeros(period, bool)
    held[list(cover)] = True
    at = np.flatnonzero(textops.within(starts, size) & held[inside % period])
    return at, textops.windows(h, size)[at] if len(at) else np.zeros(0, np.uint64), size


def _least(keys: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """For each distinct key the smallest and the largest document."""
    return packed.merge([[keys, docs, docs]], [np.minimum, np.maximum])


def _docs_of(batch: pa.RecordBatch, starts: np.ndarray) -> np.ndarray:
    """The document of each word; a null id counts as larger than any and is never the earlier one."""
    ids = pc.fill_null(batch.column("_id").cast(pa.int64()), _INF).to_numpy(zero_copy_only=False)
    return np.repeat(ids, np.diff(starts))


def _candidates(h: np.ndarray, starts: np.ndarray, width: int, live: packed.Store) -> np.ndarray:
    """Positions of windows that hold a stored anchor."""
    at, keys, size = _anchors(h, starts, width)
    sorted_keys, back = np.unique(keys, return_inverse=True)
    hit = live.lookup(sorted_keys)[0][back] if len(keys) else np.zeros(0, bool)
    # A window that starts in [anchor - slack, anchor] holds the anchor.
    slack, mark = width - size, np.zeros(len(h) + 1, np.int64)
    at = at[hit]
    np.add.at(mark, np.maximum(at - slack, 0), 1)
    np.add.at(mark, at + 1, -1)
    return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & textops.within(starts, width))


def _merged(got: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Join (key, second, least, most) entries, ascending by both parts of the key: smallest and largest document of each."""
    keys, second, least, most = (np.concatenate(c) for c in zip(*got))
    order = np.lexsort((second, keys))
    keys, second, least, most = keys[order], second[order], least[order], most[order]
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (second[1:] != second[:-1])])) if len(keys) else np.zeros(0, np.int64)
    return [keys[at], second[at], np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)]


def _shards(parts: DataFrame, spark, folder: str, bits: int, merge: Callable, kinds: list[str]) -> packed.Store:
    """Merge packed (key ..., least, most) entries shard by shard and store those that two documents share, with the smaller one."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in packed.streamed(batches):
            *keys, least, most = merge(got)
            both = least < most
            if both.any():
                packed.write_shard(folder, bucket, [*(k[both] for k in keys), least[both]])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32())], ["bucket"])

    full = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, "bucket int").collect()
    return packed.Store(folder, bits, kinds, {r[0] for r in full})


class Search:
    """Where repeated windows of a table are stored."""

    def __init__(self, copies: packed.Store, live: packed.Store, shared: packed.Store, width: int):
        self.copies, self.live, self.shared, self.width = copies, live, shared, width

    def removed(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of a batch of _id and _text: each text's words and how many of them go, and the words left, text by text."""
        width, h, starts, flat, other = self.width, *_hashes(batch.column("_text"))
        counts = np.diff(starts)
        gone = np.zeros(len(h), bool)
        at = _candidates(h, starts, width, self.live)
        if len(at):
            keys, second = textops.windows(h, width)[at], textops.windows(other(), width)[at]
            order = np.argsort(keys)
            found, (least,) = self.shared.lookup_pair(keys[order], second[order])
            at = np.sort(at[order][found & (least < _docs_of(batch, starts)[at[order]])])
            mark = np.zeros(len(h) + 1, np.int64)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + width, -1)
            gone = np.cumsum(mark[:-1]) > 0
        gone |= np.repeat(_is_copy(batch, self.copies) & (counts >= width), counts)
        ends = np.concatenate([[0], np.cumsum(~gone)])[starts]
        kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(~gone)))
        return counts, counts - np.diff(ends), pc.binary_join(kept, " ").cast(pa.string())


def _text_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text, and the ids."""
    ids = pc.fill_null(batch.column("_id").cast(pa.int64()), _INF).to_numpy(zero_copy_only=False)
    raw = b"".join(xxhash.xxh3_128_digest(t or "") for t in batch.column("_text").to_pylist())
    pairs = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], ids


def _copy_keys(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the key of a text and its id."""
    own = ids.astype(np.uint64)
    return textops.pair(a, own), textops.pair(b, own)


def _is_copy(batch: pa.RecordBatch, copies: packed.Store) -> np.ndarray:
    keys, second = _copy_keys(*_text_keys(batch))
    order = np.argsort(keys)
    out = np.zeros(len(keys), bool)
    out[order] = copies.lookup_pair(keys[order], second[order])[0]
    return out


def search(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> Search:
    """Find the windows of ``width`` words that documents share; the rules are those of dedup()."""
    integer_id(docs, id_col)
    spark = prepare(docs.sparkSession)
    folder, bits = local_path(scratch(spark, "substring")), buckets(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # Whole copies: rows whose text an earlier document has, by a 128-bit hash, as sorted hashes of text and id.
    copies_dir = f"{folder}/copies"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "_text", CHUNK):
            a, b, ids = _text_keys(batch)
            order = np.argsort(a, kind="stable")
            yield packed.blobs(a[order], [b[order], ids[order]], bits)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in packed.streamed(batches):
            a, b, ids = (np.concatenate(c) for c in zip(*got))
            order = np.lexsort((ids, b, a))
            a, b, ids = a[order], b[order], ids[order]
            same = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
            later = ids > ids[first]
            keys, second = _copy_keys(a[later], b[later], ids[later])
            order = np.argsort(keys)
            yield packed.blobs(keys[order], [second[order]], bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in packed.streamed(batches):
            keys, second = (np.concatenate(c) for c in zip(*got))
            order = np.argsort(keys)
            packed.write_shard(copies_dir, bucket, [keys[order], second[order]])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32())], ["bucket"])

    found = rows.mapInArrow(texts, packed.BLOBS).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(repeats, packed.BLOBS)
    full = found.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(keep, "bucket int").collect()
    copies = packed.Store(copies_dir, bits, ["u8", "u8"], {r[0] for r in full})

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without whole copies, whose windows an earlier document holds too."""
        for batch in textops.chunks(batches, "_text", CHUNK):
            yield batch.filter(pa.array(~_is_copy(batch, copies)))

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in searched(batches):
            h, starts, *_ = _hashes(batch.column("_text"))
            at, keys, _ = _anchors(h, starts, width)
            if len(at):
                keys, least, most = _least(keys, _docs_of(batch, starts)[at])
                yield packed.blobs(keys, [least, most], bits)

    anchors = lambda got: packed.merge(got, [np.minimum, np.maximum])
    live = _shards(rows.mapInArrow(count_anchors, packed.BLOBS), spark, f"{folder}/anchors", bits, anchors, ["u8", "i8"])

    def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in searched(batches):
            h, starts, _, other = _hashes(batch.column("_text"))
            at = _candidates(h, starts, width, live)
            if len(at):
                docs_of = _docs_of(batch, starts)[at]
                keys, *cols = _merged([[textops.windows(h, width)[at], textops.windows(other(), width)[at], docs_of, docs_of]])
                yield packed.blobs(keys, cols, bits)

    shared = _shards(rows.mapInArrow(count_windows, packed.BLOBS), spark, f"{folder}/windows", bits, _merged, ["u8", "u8", "i8"])
    return Search(copies, live, shared, width)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: id, n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a window of ``width`` words that covers it also starts in a document
    with a smaller id; windows are those of the input.  Null and empty texts have no
    words, very long ones are read whole.  A row with a null id loses what any document with an id has, and is never the
    earlier one.  Rows that share an id are one document for this, so repeated rows stay alike.  Ids have to be
    integers (an error otherwise).  Other columns are not read, so clashing names do no harm.
    """
    found = search(docs, id_col, text_col, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "_text", CHUNK):
            counts, removed, texts = found.removed(batch)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), texts], ["_id", "n_words", "n_removed", "kept_text"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of docs, with all their columns; a text that loses words becomes what is left of it, others stay byte for byte, null ones null.

    What goes is what dedup() says of the same rows, with its rules for null ids, repeated rows and empty texts.
    """
    found = search(docs, id_col, text_col, width)
    at, ident = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, text_col, CHUNK):
            _, removed, texts = found.removed(pa.RecordBatch.from_arrays([batch.column(ident), batch.column(at)], ["_id", "_text"]))
            own = pc.if_else(pa.array(removed > 0), texts, batch.column(at))
            yield batch.set_column(at, batch.schema.field(at), own)

    return docs.mapInArrow(run, docs.schema)
