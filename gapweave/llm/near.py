"""Operator 6 at a similarity: near-duplicates by SimHash, verified on whole shingle sets, complete at the similarity asked for.

Texts have a SimHash fingerprint of their word shingles.  The byte-position index brings
together fingerprints that reach the guaranteed minimum of equal positional bytes, and
the pairs it gives are verified by the Jaccard similarity of the whole sets.

Sets of similarity 0.8 can lie in fingerprints of any distance (near ten of 64 bits in the mean), for
which no minimum is guaranteed.  So a second search is exact: two sets of n and more hashes
that agree by 0.8 or more share one of the first n - ceil(0.8 n) + 1 hashes of each in any
fixed order (prefix filter).  The order puts shingles that few texts hold first; counts
of hashed slots make it, which steer the cost but never the result.  Texts that share such a
hash form a list, and links are verified inside the lists, before anything is left out:
what remains unvisited after a search from verified neighbour to neighbour has been compared
with every text it could be linked to.  Classes that the first search has found are known to
the second, which need not compare their members again.  Equal texts are one node throughout.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed, simhash, textops
from .shared import buckets, drop, integer_id, local_path, prepare, scratch, written

SHINGLE, SIMILARITY = 5, 0.8
#: Slots of the counts that order shingles and of the bitmap that bounds overlaps; hashes that are compared at a time.
SLOTS, AT_ONCE = 1 << 20, 4 << 20
_SLOT, _PLACE = np.uint64(SLOTS - 1), 40


def _shingles(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the width-word shingles of all texts in a row (shorter texts: of all their words), and where each text's start."""
    flat, starts = textops.split(batch.column("_text"), lower=True)
    code, distinct = textops.encoded(flat)
    h = textops.hashed(distinct)[code]
    n = np.diff(starts)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(begin[-1]), np.uint64)
    whole = textops.windows(h, width)
    long = n >= width
    place = np.repeat(np.where(long, starts[:-1] - begin[:-1], 0), counts) + np.arange(len(out))
    is_long = np.repeat(long, counts)
    out[is_long] = whole[place[is_long]]
    for k in np.flatnonzero(~long & (n > 0)):
        v = h[starts[k] : starts[k + 1]]
        out[begin[k]] = np.bitwise_xor.reduce(textops.pair(v, np.arange(len(v), dtype=np.uint64)))
    return out, begin


def prefix(n: int, similarity: float) -> int:
    """How many of the first of n hashes a set has to be found by."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _order(folder: str, to: str) -> None:
    """Ranks of slots by the counts that tasks have left in a folder, scaled to 16 bits."""
    total = np.zeros(SLOTS, np.int64)
    for name in os.listdir(folder):
        if not name.startswith("."):
            total += np.load(f"{folder}/{name}")
    np.save(to, np.minimum(total * (1000 / max(total.mean(), 1)), 65535).astype(np.uint16))


class _Sets:
    """Sorted sets of hashes in the files that tasks wrote, by node: the file's number and the place in it.  Sets are read one at a time, so what a task has visited does not stay in memory."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def _read(self, node: int, skip: int, n: int) -> np.ndarray:
        number = node >> _PLACE
        if number not in self.files:
            self.files[number] = os.open(f"{self.folder}/{number}", os.O_RDONLY)
        return np.frombuffer(os.pread(self.files[number], 8 * n, 8 * ((node & ((1 << _PLACE) - 1)) + skip)), np.uint64)

    def close(self) -> None:
        for f in self.files.values():
            os.close(f)
        self.files.clear()

    def ident(self, node: int) -> int:
        return int(self._read(node, 0, 1).view(np.int64)[0])

    def of(self, node: int) -> np.ndarray:
        return self._read(node, 2, int(self._read(node, 1, 1)[0]))


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same) if len(a) + len(b) else 1.0


def _alike(x: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, similarity: float, bits: np.ndarray) -> Iterator[int]:
    """Which of the sets are similar to x.  Hashes whose slot x has bound the overlap from above; what passes is compared exactly."""
    bits[x & _SLOT] = True
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, side="right")))
        hit = bits[np.concatenate(sets[a:b]) & _SLOT]
        most = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[a : b - 1])]), dtype=np.int64)
        most = np.minimum(most, np.minimum(sizes[a:b], len(x)))
        for k in np.flatnonzero(most / (sizes[a:b] + len(x) - most) >= similarity):
            if _similarity(x, sets[a + k]) >= similarity:
                yield a + int(k)
        a = b
    bits[x & _SLOT] = False


def _links(nodes: list[int], store: _Sets, similarity: float, root: dict[int, int], bits: np.ndarray) -> Iterator[tuple[int, int]]:
    """Verified pairs of a list's nodes that connect all that similar pairs connect.  root (union-find) knows the links of other lists and learns these."""

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = v = root.get(up, up)
        return v

    group = np.array([find(v) for v in nodes])
    if (group == group[0]).all():
        return
    sets = [store.of(v) for v in nodes]
    sizes = np.array([len(x) for x in sets])
    unseen = np.ones(len(nodes), bool)
    for first in range(len(nodes)):
        if not unseen[first]:
            continue
        front = np.flatnonzero(unseen & (group == group[first])).tolist()
        unseen[front] = False
        while front and unseen.any():
            k = front.pop()
            n = sizes[k]
            rest = np.flatnonzero(unseen & (np.minimum(sizes, n) >= similarity * np.maximum(sizes, n) - 1e-9))
            if not len(rest):
                continue
            for j in [*_alike(sets[k], [sets[r] for r in rest], sizes[rest], similarity, bits)]:
                z = int(rest[j])
                if unseen[z]:
                    root[find(nodes[z])] = find(nodes[k])
                    yield nodes[k], nodes[z]
                    more = np.flatnonzero(unseen & (group == group[z]))
                    unseen[more] = False
                    front += more.tolist()


def _alike_pairs(nodes: DataFrame, home: str, similarity: float) -> DataFrame:
    """Verified links (a, b) between nodes (fp, node) whose fingerprints are equal or that the byte-position index brings together."""
    path = local_path(home)
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), f"{home}/first")
    near = simhash.links(first.select("fp"))
    linked = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    pairs = linked.unionByName(nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Sets(f"{path}/sets")
        for batch in batches:
            ok = [_similarity(store.of(x), store.of(y)) >= similarity for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns], ["a", "b"])
        store.close()

    return pairs.mapInArrow(verify, "a long, b long")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(doc_id, root) of rows that are not the first of their class; root is the smallest id.

    Classes are connected by equal texts and by verified pairs.  Rows with a null id take no
    part; rows that share an id, as repeated ones do, are one.  Texts without words, null ones
    too, are alike; texts of under ``width`` words have one shingle, all their words.  Long texts
    are compared whole.  Ids have to be integers (an error otherwise); other columns are not read.
    """
    integer_id(docs, id_col)
    spark = prepare(docs.sparkSession)
    home = scratch(spark, "near")
    path = local_path(home)
    for name in ("counts", "sets"):
        os.makedirs(f"{path}/{name}", exist_ok=True)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in textops.chunks(batches, "_text", 4 << 20):
            h, begin = _shingles(batch, width)
            seen += np.bincount((h & _SLOT).astype(np.int64), minlength=SLOTS)
            texts = batch.column("_text").to_pylist()
            raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t if k else "") for t, k in zip(texts, np.diff(begin))), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(np.ascontiguousarray(raw[:, k])) for k in (0, 1))], ["_id", "t1", "t2"])
        if seen.any():
            made = uuid.uuid4().hex
            np.save(f"{path}/counts/.{made}.npy", np.minimum(seen, 65535).astype(np.uint16))
            os.replace(f"{path}/counts/.{made}.npy", f"{path}/counts/{made}.npy")

    own = written(rows.mapInArrow(run, "_id long, t1 long, t2 long"), f"{home}/own")
    _order(f"{path}/counts", f"{path}/order.npy")
    drop(spark, f"{home}/counts")
    texts = written(own.groupBy("t1", "t2").agg(F.min("_id").alias("least")), f"{home}/texts")
    asked = packed.id_store(texts.select("least"), f"{path}/least", buckets(spark))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, at = np.load(f"{path}/order.npy"), 0
        number = TaskContext.get().taskAttemptId() % (1 << 23)
        with open(f"{path}/sets/{number}", "wb") as f:
            for batch in textops.chunks(batches, "_text", 4 << 20):
                batch = batch.filter(pa.array(packed.holds(asked, batch.column("_id"))))
                h, begin = _shingles(batch, width)
                keys, nodes, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for i, x, y in zip(batch.column("_id").to_pylist(), begin[:-1], begin[1:]):
                    if y > x:
                        u = np.unique(h[x:y])
                        f.write(np.array([i, len(u)], np.int64).data)
                        f.write(u.data)
                        first = np.argsort(order[u & _SLOT], kind="stable")[: prefix(len(u), similarity)]
                        keys += [u[first], np.array([simhash.fingerprint(u)], np.uint64)]
                        nodes += [np.full(len(first), number << _PLACE | at), np.array([number << _PLACE | at])]
                        kinds += [np.zeros(len(first), bool), np.ones(1, bool)]
                        at += 2 + len(u)
                cols = [np.concatenate(keys).view(np.int64), np.concatenate(nodes), np.concatenate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "node", "print"])

    # Written, so that nodes name the files of the attempts that count.
    made = written(rows.mapInArrow(post, "key long, node long, print boolean"), f"{home}/posted")
    posted = made.where("NOT print").select("key", "node").repartition(n, "key").sortWithinPartitions("key", "node")
    alike = written(_alike_pairs(made.where("print").select(F.col("key").alias("fp"), "node"), home, similarity), f"{home}/alike")
    zero = F.lit(0).cast("long")
    known = packed.pair_store(simhash.components(alike).select("node", zero.alias("zero"), "root"), f"{path}/known", buckets(spark))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node in packed.whole_runs(batches, 1):
            at = packed.runs(key)
            ends = np.append(at[1:], len(key))
            made = {node[at[k] : ends[k]].tobytes() for k in np.flatnonzero(ends - at > 1)}
            yield pa.RecordBatch.from_arrays([pa.array([*made], pa.binary())], ["nodes"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root, bits, done = _Sets(f"{path}/sets"), {}, np.zeros(SLOTS, bool), set()
        for batch in batches:
            pairs = []
            for x in batch.column(0):
                raw = x.as_buffer().to_pybytes()
                if (name := xxhash.xxh3_128_digest(raw)) not in done:
                    done.add(name)
                    nodes = np.frombuffer(raw, np.int64)
                    found, roots = packed.pair_values(known, nodes, np.zeros(len(nodes), np.int64))
                    for v, up in zip(nodes[found].tolist(), roots[found].tolist()):
                        root.setdefault(v, up)
                    pairs += _links(nodes.tolist(), store, similarity, root, bits)
            ends = [pa.array([store.ident(p[k]) for p in pairs], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])
        store.close()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Sets(f"{path}/sets")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([store.ident(x) for x in c.to_pylist()], pa.int64()) for c in batch.columns], ["a", "b"])
        store.close()

    # Equal lists, as near copies share many, meet in one partition and are looked at once.
    linked = posted.mapInArrow(lists, "nodes binary").repartition(n, "nodes").mapInArrow(verify, "a long, b long")
    roots = simhash.components(linked.unionByName(alike.mapInArrow(named, "a long, b long"))).withColumnRenamed("node", "least")
    by_text = texts.join(roots, "least", "left").select("t1", "t2", F.coalesce("root", "least").alias("root"))
    # Copies look their text up, so that a group of them, however large, never meets in one task.
    classes = packed.pair_store(by_text, f"{path}/classes", buckets(spark))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t1, t2 = (c.to_numpy() for c in batch.columns)
            _, root = packed.pair_values(classes, t1, t2)
            later = root < ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[later]), pa.array(root[later])], [id_col, "root"])

    return own.mapInArrow(look_up, T.StructType([T.StructField(id_col, T.LongType()), T.StructField("root", T.LongType())]))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their class; rows with a null id stay.

    The ids that go are memory-mapped, so texts are not shuffled.
    """
    spark = prepare(docs.sparkSession)
    home = scratch(spark, "later")
    # Written, as a second Python step in one task would take workers of its own.
    gone = written(duplicates(docs, id_col, text_col, similarity, width).select(id_col), f"{home}/ids")
    store = packed.id_store(gone, local_path(f"{home}/store"), buckets(spark))
    at = docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~packed.holds(store, batch.column(at))))

    return docs.mapInArrow(run, docs.schema)
