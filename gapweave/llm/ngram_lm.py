"""Interpolated modified Kneser-Ney language model over word triples.

A first pass counts words and numbers them, frequent ones low, so that n-grams are exact
numbers that pack tightly.  A second counts (before last, last, word) triples.  Where a
triple is counted follows its middle word, so that a context and the pairs that end in it meet in one shard and
need no second shuffle; a middle word that is frequent is spread by context, and a context
that is frequent by the whole triple, with their sums merged by a small second shuffle.  A
shard is merged once and written as sorted hash arrays, which workers memory-map to score
texts; nothing but counts of counts and the frequent contexts reaches the driver.

Words are known by 64 bits of their hash, n-grams in the arrays by their shard and 40 bits of
theirs: of the n-grams that were never seen, about one in 2^40 by a shard's entries is
taken for a seen one.  Counts while training are exact.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed, textops
from .shared import local_path, prepare, scratch, shard_bits

#: Hash of the end of a text, which is scored as a word; number of its start, and of a word that the model does not know.
_END, _START, _UNKNOWN = np.uint64(2), 0, np.uint64((1 << 32) - 1)
_LOW, _KEY = np.uint64((1 << 32) - 1), np.uint64((1 << 40) - 1)
#: Text bytes that are counted and scored at a time; pairs that make up this share of a chunk are counted as frequent ones.
CHUNK, SCORED, SHARE = 8 << 20, 4 << 20, 1 / 4096
_ROWS = "kind int, bucket int, blob binary, sums array<long>"
#: Kinds of rows between the passes: triples by how their context is spread, sums of frequent contexts, pairs of frequent words, sums of words, figures for the driver.
_PLAIN, _BY_CONTEXT, _BY_TRIPLE, _CONTEXTS, _PAIRS, _WORDS, _FIGURES = range(7)


def _scatter(x: np.ndarray) -> np.ndarray:
    return textops.mix(x ^ np.uint64(0xA0761D6478BD642F))


class Arrays:
    """Sorted arrays by shard: 40-bit keys with values, in three classes: values that are the usual ones (keys only), of a byte each, and wider."""

    def __init__(self, folder: str, bits: int, usual: tuple[int, ...]):
        self.folder, self.bits, self.usual, self.full = folder, bits, usual, set()

    def write(self, bucket: int, keys: np.ndarray, values: list[np.ndarray]) -> None:
        """A shard's file, put in place whole."""
        os.makedirs(self.folder, exist_ok=True)
        usual = np.logical_and.reduce([v == u for v, u in zip(values, self.usual)]) if values else np.ones(len(keys), bool)
        wide = np.logical_or.reduce([v > 255 for v in values]) if values else np.zeros(len(keys), bool)
        made = f"{self.folder}/.{bucket}-{uuid.uuid4().hex}"
        with open(made, "wb") as f:
            parts = [np.flatnonzero(usual), np.flatnonzero(~usual & ~wide), np.flatnonzero(~usual & wide)]
            f.write(np.array([len(p) for p in parts], np.int64).data)
            for p, kind in zip(parts, (None, np.uint8, np.uint64)):
                p = p[np.argsort(keys[p], kind="stable")]
                f.write((keys[p] >> np.uint64(8)).astype(np.uint32).data)
                f.write(keys[p].astype(np.uint8).data)
                for v in values if kind else ():
                    f.write(np.ascontiguousarray(v[p]).astype(kind).data)
        os.replace(made, f"{self.folder}/{bucket}")

    def _parts(self, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray] | None]]:
        raw = np.memmap(f"{self.folder}/{bucket}", np.uint8, "r")
        at = 24

        def take(n: int, kind: type) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            at += size
            # Wider values need not lie at a multiple of their size.
            return np.frombuffer(raw, kind, n, at - size) if n else np.zeros(0, kind)

        for n, kind in zip(raw[:24].view(np.int64).tolist(), (None, np.uint8, np.uint64)):
            hi, lo = take(n, np.uint32), take(n, np.uint8)
            yield hi, lo, [take(n, kind) for _ in self.usual] if kind else None

    def lookup(self, route: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of n-grams, by their routes (shard in the top bits) and 40-bit keys: which are there, and their values (0 where not)."""
        whole, back = np.unique(((route >> np.uint64(64 - self.bits)) << np.uint64(40)) | keys, return_inverse=True)
        shard = whole >> np.uint64(40)
        hi, lo = (whole >> np.uint64(8)).astype(np.uint32), whole.astype(np.uint8)
        found, values = np.zeros(len(whole), bool), [np.zeros(len(whole), np.uint64) for _ in self.usual]
        starts = packed.runs(shard)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
            if int(shard[a]) not in self.full:
                continue
            for own_hi, own_lo, cols in self._parts(int(shard[a])):
                if not len(own_hi):
                    continue
                at = np.searchsorted(own_hi, hi[a:b])
                todo = np.flatnonzero(at < len(own_hi))
                while len(todo):
                    todo = todo[own_hi[at[todo]] == hi[a + todo]]
                    right = own_lo[at[todo]] == lo[a + todo]
                    hit = todo[right]
                    found[a + hit] = True
                    for v, u, c in zip(values, self.usual, cols or self.usual):
                        v[a + hit] = c[at[hit]] if cols else u
                    todo = todo[~right]
                    at[todo] += 1
                    todo = todo[at[todo] < len(own_hi)]
        return found[back], [v[back] for v in values]


@dataclass
class Model:
    """Where the counts are, and the few numbers that the formulas need."""

    words: packed.Store
    triples: Arrays
    contexts: Arrays
    frequent_contexts: Arrays
    pairs: Arrays
    frequent_pairs: Arrays
    sums: Arrays
    tokens: int
    distinct: int
    frequent: int
    spread: np.ndarray
    types: int = 0
    discounts: tuple[tuple[float, float, float], ...] = ()
    continuations: tuple[int, int, int] = (0, 0, 0)


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Chen and Goodman's discounts from the numbers of types seen 1, 2, 3 and 4 times; where one is missing, absolute discounting by at most 0.75."""
    n1, n2, n3, n4 = (int(x) for x in n)
    if not n1 or not n2:
        return (0.5, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 3 * y
    return tuple(float(np.clip(x, 0.05, k - 0.05)) for x, k in zip(d, (1, 2, 3)))


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def _chunk(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row, an end after each: the distinct tokens' hashes, ascending, each token's place among them, and where texts start."""
    flat, starts = textops.split(texts, lower=True)
    codes, distinct = textops.encoded(flat)
    keys, place = np.unique(np.append(np.maximum(textops.hashed(distinct), np.uint64(3)), _END), return_inverse=True)
    begin = starts + np.arange(len(starts))
    token = np.full(int(begin[-1]), place[-1])
    is_word = np.ones(len(token), bool)
    is_word[begin[1:] - 1] = False
    token[is_word] = place[:-1][codes]
    return keys, token, begin


def _before(token: np.ndarray, begin: np.ndarray, start: int, back: int = 1) -> np.ndarray:
    """The token so many places before each, ``start`` at a text's beginning."""
    out = np.full(len(token), start, token.dtype)
    out[back:] = token[:-back]
    for k in range(back):
        at = begin[:-1] + k
        out[at[at < begin[1:]]] = start
    return out


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return textops.pair(a, b)


def _often(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that make up ``SHARE`` of all or more, and their counts; a count of slots leaves few to look at."""
    least = max(2, int(SHARE * len(hashes)))
    slot = (hashes & np.uint64((1 << 16) - 1)).astype(np.int64)
    own = hashes[(np.bincount(slot, minlength=1 << 16) >= least)[slot]]
    keys, counts = np.unique(own, return_counts=True)
    return keys[counts >= least], counts[counts >= least].astype(np.uint64)


def _row(kind: int, bucket: int, blob: bytes | None = None, sums: list[int] | None = None) -> tuple:
    return kind, bucket, blob, sums


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, bucket, blob, sums = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary()), pa.array([x if x is None else [int(v) for v in x] for x in sums], pa.list_(pa.int64()))], ["kind", "bucket", "blob", "sums"])


def _blobs(kind: int, keys: np.ndarray, route: np.ndarray, cols: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """Rows of one kind, one a shard: entries by route, inside a shard by key."""
    shard = (route >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((keys, shard))
    edges = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    for k in np.flatnonzero(np.diff(edges)):
        own = order[edges[k] : edges[k + 1]]
        yield _row(kind, int(k), packed.encode([keys[own], *(_narrow(c[own]) for c in cols)]))


def _narrow(c: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold all values, never wrapped."""
    most = int(c.max(initial=0))
    return c.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _summed(keys: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums over equal keys, ascending, in 64 bits."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = packed.runs(keys)
    return keys[at], [np.add.reduceat(c[order].astype(np.uint64), at) if len(at) else c.astype(np.uint64) for c in cols]


def _joined(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate([c.astype(np.uint64) for c in cols]) for cols in zip(*map(packed.decode, blobs))]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]], list[list[int]]]]:
    """Rows of a partition, sorted by bucket, shard by shard: blobs by kind, and figures that pass through."""
    now, got, figures = None, {}, []
    for batch in batches:
        for kind, bucket, blob, sums in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                if now is not None:
                    yield now, got, figures
                now, got, figures = bucket, {}, []
            if kind == _FIGURES:
                figures.append(sums)
            else:
                got.setdefault(kind, []).append(blob)
    if now is not None:
        yield now, got, figures


def _types(counts: np.ndarray) -> list[int]:
    """Numbers of counts that are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _context_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """By key (ascending runs): the total, and the numbers of types seen once, twice and more."""
    at = packed.runs(keys)
    if not len(at):
        return keys, [keys] * 4
    return keys[at], [np.add.reduceat(x.astype(np.uint64), at) for x in (counts, counts == 1, counts == 2, counts > 2)]


def _word_rows(pairs: np.ndarray, n: np.ndarray, bits: int) -> Iterator[tuple]:
    """What whole pairs (ascending; n: their types) add to the sums of their words: types that end in a word; of a word as context, total and types by n."""
    second, one = pairs & _LOW, np.ones(len(pairs), np.uint64)
    ends, (cont,) = _summed(second, [one])
    context, sums = _context_sums(pairs >> np.uint64(32), n)
    none = lambda k: [np.zeros(k, np.uint64)]
    keys, cols = _summed(np.concatenate([ends, context]), [np.concatenate(c) for c in zip([cont, *none(len(ends)) * 4], [*none(len(context)), *sums])])
    yield from _blobs(_WORDS, keys, _scatter(keys), cols, bits)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count a model on every text (null: an empty one) and store it in the shared folder.

    Very long texts are one chunk; repeated rows count again.  An empty table gives a model
    without counts, by which every word has the same probability.  Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    bits = shard_bits(docs)
    shards = 1 << bits
    folder = local_path(scratch(spark, "lm"))
    rows = docs.select(F.col(text_col).alias("_text"))
    dealt = lambda df: df.repartition(shards, "bucket").sortWithinPartitions("bucket")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "_text", CHUNK):
            keys, token, begin = _chunk(batch.column("_text"))
            often, times = _often(_pair_hash(_before(keys[token], begin, 1), keys[token]))
            made = [*_blobs(_WORDS, keys, keys, [np.bincount(token, minlength=len(keys)).astype(np.uint64)], bits), *_blobs(_CONTEXTS, often, often, [times], bits)]
            yield _batch(made)

    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got, _ in _shards(batches):
            often, (times,) = _summed(*(lambda k, *c: (k, [*c]))(*_joined(got[_CONTEXTS]))) if _CONTEXTS in got else (np.zeros(0, np.uint64), [np.zeros(0, np.uint64)])
            first = np.argsort(times)[::-1][:64]
            figures = [0, 0]
            if _WORDS in got:
                keys, *cols = _joined(got[_WORDS])
                keys, (counts,) = _summed(keys, cols)
                number = np.empty(len(keys), np.uint64)
                number[np.argsort(counts, kind="stable")[::-1]] = np.arange(len(keys), dtype=np.uint64)
                number = 1 + number * shards + bucket
                if int(number.max()) >= int(_UNKNOWN):
                    raise OverflowError("words can't be numbered in 32 bits")
                packed.write_shard(f"{folder}/words", bucket, [keys, counts, number.astype(np.uint32)])
                figures = [len(keys), int(counts.sum())]
            yield _batch([_row(_FIGURES, bucket, None, [*figures, *often[first].view(np.int64).tolist(), *times[first].astype(np.int64).tolist()])])

    counted = dealt(rows.mapInArrow(count_words, _ROWS)).mapInArrow(store_words, _ROWS).select("bucket", "sums").collect()
    tokens, distinct = sum(r["sums"][1] for r in counted), sum(r["sums"][0] for r in counted)
    words = packed.Store(f"{folder}/words", bits, ["u8", "u8", "u4"], {r["bucket"] for r in counted if r["sums"][0]})
    frequent = max(2, tokens // (4 * shards))
    spread = []
    for r in counted:
        keys, times = np.split(np.array(r["sums"][2:], np.int64), 2)
        spread.append(keys[times >= frequent].view(np.uint64))
    arrays = lambda name, *usual: Arrays(f"{folder}/{name}", bits, usual)
    model = Model(
        words, arrays("triples", 1), arrays("contexts", 0, 0, 0, 0), arrays("frequent_contexts", 0, 0, 0, 0), arrays("pairs", 1), arrays("frequent_pairs", 1),
        arrays("sums", 1, 1, 1, 0, 0), tokens, distinct, frequent, np.sort(np.concatenate([np.zeros(0, np.uint64), *spread])),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "_text", CHUNK):
            t = _Tokens(batch.column("_text"), model)
            order = np.lexsort((t.c, t.context))
            context, c = t.context[order], t.c[order]
            at = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (c[1:] != c[:-1])]))
            times, first = np.diff(np.append(at, len(order))).astype(np.uint64), order[at]
            context, c, kind, route = context[at], c[at], t.kind[first], t.route[first]
            for k in (_PLAIN, _BY_CONTEXT, _BY_TRIPLE):
                own = np.flatnonzero(kind == k)
                if len(own):
                    yield _batch([*_triple_blobs(k, context[own], c[own], times[own], route[own], bits)])

    def store_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got, _ in _shards(batches):
            triple, kept, own_pairs, made, figures = [], [], [], [], np.zeros(9, np.int64)
            for kind in sorted(got):
                context, c, times = _joined(got.pop(kind))
                order = np.lexsort((c, context))
                context, c, times = context[order], c[order], times[order]
                at = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (c[1:] != c[:-1])]))
                context, c, times = context[at], c[at], np.add.reduceat(times, at)
                triple.append((textops.pair(context, c) & _KEY, times))
                figures[1:5] += _types(times)
                keys, sums = _context_sums(context, times)
                if kind == _BY_TRIPLE:
                    made += _blobs(_CONTEXTS, keys, _scatter(keys), sums, bits)
                else:
                    # A context seen once is known from its pair; those at a text's start have none that could tell.
                    more = (sums[0] > 1) | (keys & _LOW == _START)
                    kept.append((_scatter(keys[more]) & _KEY, *(x[more] for x in sums)))
                # Types of a pair are the words before it; after a text's start its occurrences.
                pairs, (types, whole) = _summed(((context & _LOW) << np.uint64(32)) | c, [np.ones(len(c), np.uint64), times])
                types = np.where(pairs >> np.uint64(32) == _START, whole, types)
                if kind == _PLAIN:
                    own_pairs.append((_scatter(pairs) & _KEY, types))
                    figures[5:9] += _types(types)
                    made += _word_rows(pairs, types, bits)
                else:
                    made += _blobs(_PAIRS, pairs, _scatter(pairs), [types], bits)
            for name, parts in ((model.triples, triple), (model.contexts, kept), (model.pairs, own_pairs)):
                if parts:
                    keys, *values = (np.concatenate(x) for x in zip(*parts))
                    name.write(bucket, keys, values)
            made.append(_row(_FIGURES, bucket, None, [_PLAIN, bucket, bool(triple), bool(kept), bool(own_pairs), *figures[1:].tolist()]))
            yield _batch(made)

    def store_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got, figures in _shards(batches):
            made, types = [_row(_FIGURES, bucket, None, x) for x in figures], [0] * 4
            if _CONTEXTS in got:
                keys, *sums = _joined(got[_CONTEXTS])
                keys, sums = _summed(keys, sums)
                model.frequent_contexts.write(bucket, _scatter(keys) & _KEY, sums)
            if _PAIRS in got:
                pairs, n = _joined(got[_PAIRS])
                pairs, (n,) = _summed(pairs, [n])
                model.frequent_pairs.write(bucket, _scatter(pairs) & _KEY, [n])
                types = _types(n)
                made += _word_rows(pairs, n, bits)
            if _WORDS in got:
                keys, *cols = _joined(got[_WORDS])
                keys, cols = _summed(keys, cols)
                made += _blobs(_WORDS, keys, _scatter(keys), cols, bits)
            made.append(_row(_FIGURES, bucket, None, [_BY_CONTEXT, bucket, _CONTEXTS in got, _PAIRS in got, *types]))
            yield _batch(made)

    def store_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got, figures in _shards(batches):
            made = [_row(_FIGURES, bucket, None, x) for x in figures]
            if _WORDS in got:
                keys, *cols = _joined(got[_WORDS])
                keys, cols = _summed(keys, cols)
                model.sums.write(bucket, keys << np.uint64(8), cols)
                cont = cols[0]
                made.append(_row(_FIGURES, bucket, None, [_WORDS, bucket, int(cont.sum()), int((cont > 0).sum()), *_types(cont)]))
            if made:
                yield _batch(made)

    found = dealt(dealt(dealt(rows.mapInArrow(count, _ROWS)).mapInArrow(store_triples, _ROWS)).mapInArrow(store_frequent, _ROWS)).mapInArrow(store_sums, _ROWS)
    # A dozen numbers a shard and pass.
    figures = [r["sums"] for r in found.where(F.col("kind") == _FIGURES).select("sums").collect()]
    n3, n2, n1 = np.zeros(4, np.int64), np.zeros(4, np.int64), np.zeros(6, np.int64)
    for kind, bucket, *own in figures:
        if kind == _PLAIN:
            for name, there in zip((model.triples, model.contexts, model.pairs), own):
                name.full |= {bucket} if there else set()
            n3, n2 = n3 + own[3:7], n2 + own[7:11]
        elif kind == _BY_CONTEXT:
            for name, there in zip((model.frequent_contexts, model.frequent_pairs), own):
                name.full |= {bucket} if there else set()
            n2 = n2 + own[2:6]
        else:
            model.sums.full.add(bucket)
            n1 = n1 + own
    model.types, model.discounts = int(n1[0]), (_discounts(n3), _discounts(n2), _discounts(n1[2:]))
    model.continuations = (int(n1[2]), int(n1[3]), int(n1[1] - n1[2] - n1[3]))
    return model


def _triple_blobs(kind: int, context: np.ndarray, c: np.ndarray, times: np.ndarray, route: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows of triples that ascend by context and word, one a shard."""
    shard = (route >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    for k in np.flatnonzero(np.diff(edges)):
        own = order[edges[k] : edges[k + 1]]
        yield _row(kind, int(k), packed.encode([context[own], c[own].astype(np.uint32), _narrow(times[own])]))


class _Tokens:
    """A chunk's tokens by number, with their contexts and where those are counted."""

    def __init__(self, texts: pa.Array, m: Model):
        keys, token, self.begin = _chunk(texts)
        found, (counts, numbers) = m.words.lookup(keys)
        number = np.where(found, numbers.astype(np.uint64), _UNKNOWN)
        self.seen = counts.astype(np.float64)[token]
        self.known = found[token]
        self.words, self.place = number, token
        self.c = number[token]
        self.b, self.a = (_before(self.c, self.begin, _START, k) for k in (1, 2))
        self.context = self.a << np.uint64(32) | self.b
        self.often = _before(counts[token] >= m.frequent, self.begin, True)
        self.kind = np.where(self.often, _BY_CONTEXT, _PLAIN)
        self.route = _scatter(np.where(self.often, self.context, self.b))
        own = np.flatnonzero(self.often)
        if len(own) and len(m.spread):
            hashes = keys[token]
            pair = _pair_hash(_before(hashes, self.begin, 1, 2), _before(hashes, self.begin, 1))[own]
            at = np.minimum(np.searchsorted(m.spread, pair), len(m.spread) - 1)
            own = own[m.spread[at] == pair]
            self.kind[own] = _BY_TRIPLE
            self.route[own] = textops.pair(self.context[own], self.c[own])


def _gamma(total: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The share that a context leaves to the lower order; 1 where the context is unknown."""
    return np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)


def _level(n: np.ndarray, total: np.ndarray, gamma: np.ndarray, lower: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """A discounted share of the context's total, and what it leaves by the lower order."""
    return np.where(total > 0, np.maximum(n - _discount(n, d), 0) / np.maximum(total, 1), 0.0) + gamma * lower


def _split_lookup(plain: Arrays, frequent: Arrays, often: np.ndarray, route: np.ndarray, scattered: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lookups in the arrays of a plain route and in those of a frequent one, whose route is the n-gram's own hash."""
    found, values = np.zeros(len(often), bool), [np.zeros(len(often), np.uint64) for _ in plain.usual]
    for arrays, own, way in ((plain, np.flatnonzero(~often), route), (frequent, np.flatnonzero(often), scattered)):
        if len(own):
            there, got = arrays.lookup(way[own], scattered[own] & _KEY)
            found[own] = there
            for v, x in zip(values, got):
                v[own] = x
    return found, values


def _log10(t: _Tokens, m: Model) -> np.ndarray:
    """log10 p(token | the two before) of each token."""
    d3, d2, d1 = m.discounts
    words, back = np.unique(np.concatenate([t.words, [np.uint64(_START)]]), return_inverse=True)
    _, sums = m.sums.lookup(_scatter(words), words << np.uint64(8))
    cont, total, n1, n2, n3 = (x.astype(np.float64) for x in sums)
    rest = sum(d * x for d, x in zip(d1, m.continuations)) / m.types if m.types else 1.0
    one = np.maximum(cont - _discount(cont, d1), 0) / max(m.types, 1) + rest / (m.distinct + 1)
    gamma = _gamma(total, n1, n2, n3, d2)
    own = back[:-1][t.place]
    last = _before(own, t.begin, back[-1])
    pair = t.b << np.uint64(32) | t.c
    there, (n,) = _split_lookup(m.pairs, m.frequent_pairs, t.often, _scatter(t.b), _scatter(pair))
    ok = t.known & (t.b != _UNKNOWN)
    two = _level(np.where(ok, n, 0).astype(np.float64), total[last], gamma[last], one[own], d2)
    # The pair that is the context was looked up with the token before.
    single = _before(there & ok, t.begin, False)
    by_triple = t.kind == _BY_TRIPLE
    stored, sums = _split_lookup(m.contexts, m.frequent_contexts, by_triple, t.route, _scatter(t.context))
    total, n1, n2, n3 = (np.where(stored, x, single & (k < 2)).astype(np.float64) for k, x in enumerate(sums))
    seen, (n,) = m.triples.lookup(t.route, textops.pair(t.context, t.c) & _KEY)
    n = np.where(ok & (t.a != _UNKNOWN) & (total > 0), n, 0).astype(np.float64)
    return np.log10(_level(n, total, _gamma(total, n1, n2, n3, d3), two, d3))


def score(docs: DataFrame, model: Model, id_col: str, text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens (words and one end), n_known, train_tokens, base_score and score.

    score is the sum of log10 p(token | the two before), base_score the sum under an
    add-0.1 unigram model, perplexity 10^(-score / n_tokens).  A null text counts as
    empty: one end token.  Repeated rows score alike, very long texts whole.  Other columns are not read.
    """
    prepare(docs.sparkSession)
    m = model
    base_all = np.log10(m.tokens + 0.1 * (m.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "_text", SCORED):
            t = _Tokens(batch.column("_text"), m)
            starts = t.begin[:-1]
            sums = [np.add.reduceat(x, starts) for x in (t.known.astype(np.int64), np.log10(t.seen + 0.1) - base_all, _log10(t, m))]
            cols = [pa.array(np.diff(t.begin), pa.int64()), pa.array(sums[0]), pa.array(np.full(batch.num_rows, m.tokens)), *map(pa.array, sums[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *cols], ["_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("_id", id_col)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold (null id: it does not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
