"""SimHash near-duplicates: a byte-position index with count filtering.

Fingerprints that differ in at most ``max_bits`` bits share at least
``n_bytes - max_bits`` positional bytes.  Posting lists of single positional bytes
would hold 1/256 of all documents each, so the index is keyed by sets of positional
bytes that every qualifying pair must share whole: one key for each choice of
``max_bits`` bytes left out.  Inside a posting list the shared positional bytes of a
pair are tallied, pairs below the guaranteed minimum go, and the rest are verified by
their Hamming distance.  Only distinct fingerprints are indexed, and a list gives a
spanning forest of its links, so hot groups never give all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed, textops
from .shared import buckets, drop, integer_id, local_path, prepare, scratch, written

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: For each byte value, its bits from the lowest.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Lists up to this size compare each pair; longer ones look up each fingerprint's few possible neighbours.
_SMALL = 64


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    planes = h.view(np.uint8).reshape(-1, 8)
    bits = np.concatenate([np.bincount(planes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def _shingle_hashes(raw: bytes, starts: list[int], ends: list[int], width: int, seed: int) -> np.ndarray:
    """XXH64 of the words of each shingle joined by one space; they lie so in raw already."""
    digest, n = xxhash.xxh64_intdigest, max(1, len(starts) - width + 1)
    spans = zip(starts[:n], ends[width - 1 :] or ends[-1:])
    return np.fromiter((digest(raw[a:b], seed) for a, b in spans), np.uint64, n)


def _of_texts(texts: pa.Array, width: int, seed: int) -> list[int]:
    flat, starts = textops.split(texts, lower=True)
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)
    out = []
    for joined, a, b in zip(pc.binary_join(lists, " ").cast(pa.binary()), starts[:-1].tolist(), starts[1:].tolist()):
        if a == b:
            out.append(0)
            continue
        own = sizes[a:b]
        ends = np.cumsum(own + 1) - 1
        out.append(fingerprint(_shingle_hashes(joined.as_py(), (ends - own).tolist(), ends.tolist(), width, seed)))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row: id and fp (64 bits as a long).  Texts without words, null ones too, have 0."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "_text"):
            made = np.array(_of_texts(batch.column("_text"), width, seed), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(made)], ["_id", "fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _masks(max_bits: int) -> list[int]:
    """For each choice of the bytes left out, the mask of those that form the key."""
    full = (1 << 64) - 1
    return [full ^ sum(0xFF << (8 * k) for k in left) for left in combinations(range(8), max_bits)]


def _close(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification: at least 8 - max_bits equal positional bytes, at most max_bits differing bits."""
    d = x ^ y
    shared = (d.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (shared >= 8 - max_bits) & (np.bitwise_count(d) <= max_bits)


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The links that join two trees so far, of all links in turn."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for x, y in zip(a, b):
        if (p := find(x)) != (q := find(y)):
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _links(keys: np.ndarray, fps: np.ndarray, free: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each posting list; keys ascend, free holds the bytes outside a list's key."""
    n = len(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, n))
    size = np.repeat(sizes, sizes)
    left, right = [], []
    for step in range(1, min(_SMALL, int(sizes.max(initial=1)))):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & (size[step:] <= _SMALL))
        at = at[_close(fps[at], fps[at + step], max_bits)]
        left.append(fps[at])
        right.append(fps[at + step])
    for k in np.flatnonzero(sizes > _SMALL):
        own = np.sort(fps[starts[k] : starts[k] + sizes[k]])
        bits = [1 << j for j in range(64) if int(free[starts[k]]) >> j & 1]
        a, b = [], []
        for count in range(1, max_bits + 1):
            for flip in combinations(bits, count):
                near = own ^ np.uint64(sum(flip))
                at = np.minimum(np.searchsorted(own, near), len(own) - 1)
                hit = (own[at] == near) & (own < near)
                a += own[hit].tolist()
                b += near[hit].tolist()
        kept = np.array(_forest(a, b), np.uint64).reshape(-1, 2)
        left.append(kept[:, 0])
        right.append(kept[:, 1])
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect all that differ in at most max_bits bits.

    A list whose key leaves max_bits bytes out holds at most 256^max_bits fingerprints, whatever the input.
    """
    spark = prepare(distinct.sparkSession)
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks(max_bits)]
    held = F.array(*[F.lit(m) for m in masks])
    keyed = distinct.select("fp", F.posexplode(held).alias("choice", "mask")).select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    frees = np.array([~m & ((1 << 64) - 1) for m in _masks(max_bits)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for choice, key, fp in packed.whole_runs(batches, 2):
            for k in np.unique(choice):
                own = slice(*np.searchsorted(choice, [k, k + 1]))
                a, b = _links(key[own], fp[own].view(np.uint64), np.full(own.stop - own.start, frees[k]), max_bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "choice", "key").sortWithinPartitions("choice", "key").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, root), root the smallest node; only nodes with links.

    Alternating large and small stars, each written to the shared folder; the number of
    rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    at = scratch(spark, "components")
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{at}/0")
    last, k = None, 0
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            break
        last, k = state, k + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()
        large = written(large, f"{at}/{k}-large")
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        before, now = now, written(small.unionByName(least.select("u", F.col("w").alias("v"))).distinct(), f"{at}/{k}")
        drop(spark, f"{at}/{k}-large")
        drop(spark, f"{at}/{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: id, fp and component_id, the smallest id that links reach from it, itself included.

    Rows with a null id take part and keep their null; a component of such rows alone has
    a null component_id.  Repeated rows stay repeated.  Texts without words, null ones too,
    have fingerprint 0 and are linked like any other; very long texts are read whole.  Ids have
    to be integers (an error otherwise).  Other columns are not read.
    """
    integer_id(docs, id_col)
    spark = prepare(docs.sparkSession)
    at = scratch(spark, "simhash")
    own = written(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", width), f"{at}/fps")
    least = own.groupBy("fp").agg(F.min("_id").alias("least"))
    roots = components(links(least.select("fp"), max_bits))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, f"{at}/rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").where("component_id IS NOT NULL").select("fp", F.lit(0).cast("long").alias("zero"), F.col("component_id").cast("long"))
    # Copies look their fingerprint up, so that a group of them, however large, never meets in one task.
    store = packed.pair_store(by_fp, f"{local_path(at)}/classes", buckets(spark))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            found, value = packed.pair_values(store, fp, np.zeros(len(fp), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, mask=~found)], ["_id", "fp", "component_id"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("fp", T.LongType()), T.StructField("component_id", T.LongType())])
    return own.mapInArrow(look_up, schema).select(F.col("_id").alias(id_col), "fp", F.col("component_id").cast(kind).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, with all their columns, without those of which a class holds a smaller id.

    The ids that go are memory-mapped, so texts are not shuffled.  Rows with a null id stay.
    """
    spark = prepare(docs.sparkSession)
    home = scratch(spark, "later")
    gone = written(classes(docs, id_col, text_col, width, max_bits).where(F.col("component_id") < F.col(id_col)).select(id_col), f"{home}/ids")
    store = packed.id_store(gone, local_path(f"{home}/store"), buckets(spark))
    at = docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~packed.holds(store, batch.column(at))))

    return docs.mapInArrow(run, docs.schema)
