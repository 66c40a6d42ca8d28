"""Benchmark passages in documents, also slightly edited ones.

An item of m words is looked for where any run of words is within its bound of e edits
(insertions, deletions and substitutions of words).  Cut into e + 1 pieces, one piece of it
is then there unchanged, so an index of the pieces tells, without a look at every item, at
which places of a document an item-sized window has to be laid.  A CGK random walk embeds
item and window, outward from the shared piece, into sequences whose Hamming distance follows the edit
distance; keys of a few sampled positions, drawn again and again from several walks
(bit-sampling LSH), keep the pairs that share one, and the edit distance to the best run of
words around the window is then computed exactly.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import prepare

#: Edits allowed, as a share of an item's words; shorter items have to be there unchanged.
EDITS, LEAST_WORDS = 0.2, 8
#: Positions of a key, walks, the recall aimed at for a pair whose embeddings differ in that share of the positions, and cells of embeddings that are held at a time.
SAMPLED, WALKS, RECALL, DIFFER, CELLS = 2, 4, 0.995, 0.6, 8_000_000
#: Items that a pass over the documents holds; more take further passes.  Pairs of piece and place that are held at a time.
BLOCK, AT_ONCE = 20_000, 1_000_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…"


def normal(word: str) -> str:
    """A word without case and marks at its ends."""
    return word.lower().strip(_MARKS)


def _scores(a: list[int], b: list[int], free: bool) -> Iterator[int]:
    """Levenshtein distances of a and each prefix of b but the empty one, by Myers' bit vectors; free: of a and the best run that ends there."""
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full, top, first = (1 << len(a)) - 1, 1 << (len(a) - 1), 0 if free else 1
    up, down, score = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp, hn = (down | ~(d0 | up)) & full, up & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1 | first) & full, hn << 1 & full
        up, down = (hn | ~(d0 | hp)) & full, hp & d0
        yield score


def best_run(a: list[int], b: list[int], most: int) -> tuple[int, int, int] | None:
    """(edits, start, length) of the run of b with the fewest edits from a, at most that many; ties go to the first end, then to the length nearest to a's."""
    scores = [*_scores(a, b, True)]
    if not scores or (d := min(scores)) > most:
        return None
    end = scores.index(d) + 1
    back = _scores(a[::-1], b[max(0, end - len(a) - d) : end][::-1], False)
    n = min((k for k, own in enumerate(back, 1) if own == d), key=lambda k: (abs(k - len(a)), k))
    return d, end - n, n


def _row_hashes(codes: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """A hash of each window of m codes: a linear one with random weights, modulo 2^64."""
    weights = textops.mix(np.arange(1, m + 1, dtype=np.uint64))
    scattered = textops.mix(codes.astype(np.uint64) + np.uint64(7)) if len(at) * m > len(codes) else None
    out = np.zeros(len(at), np.uint64)
    for j in range(m):
        own = codes[at + j]
        out += (scattered[at + j] if scattered is not None else textops.mix(own.astype(np.uint64) + np.uint64(7))) * weights[j]
    return out


def repeats(recall: float = RECALL, differ: float = DIFFER, sampled: int = SAMPLED) -> int:
    """Keys that bring a pair together with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** sampled))


def embed(words: np.ndarray, start: np.ndarray, size: np.ndarray, way: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK embeddings: a row of symbols for each run of ``size`` words from ``start`` on, read forward or backward (way 1 or -1); 0 after its end.

    At each step the word the walk stands on is written down, and a coin that step and word share decides whether it goes on.
    """
    out, at = np.zeros((len(start), steps), np.uint64), np.zeros(len(start), np.int64)
    for j in range(steps):
        symbol = np.where(at < size, words[np.minimum(np.maximum(start + way * at, 0), len(words) - 1)] + 2, 0).astype(np.uint64)
        out[:, j] = symbol
        at += (textops.pair(symbol, np.full(len(symbol), (seed << 32) + j, np.uint64)) >> np.uint64(63)).astype(np.int64)
    return out


def _sampled(length: int, left: int, k: int) -> np.ndarray:
    """Places of the k-th key: ``SAMPLED`` steps of the two walks from a piece over an item, as indices of the forward walk (from 0) and of the backward one (from -1 down).

    A walk takes two steps a word in the mean, so places are drawn over both walks by their lengths.
    """
    right = length - left
    return np.random.default_rng([length, left, k]).choice(np.arange(-2 * left, 2 * right), min(SAMPLED, 2 * length), replace=False)


@dataclass
class Size:
    """The items of one length: their ids, words and the allowed edits."""

    length: int
    edits: int
    ids: list = field(default_factory=list)
    words: list[list[int]] = field(default_factory=list)


class Items:
    """A block of benchmark items, ready to be looked up in."""

    def __init__(self, items: list[tuple[object, str]], edits: float = EDITS):
        self.codes: dict[str, int] = {}
        by_size: dict[int, Size] = {}
        for ident, text in items:
            words = [w for x in textops.split(pa.array([text], pa.string()))[0].to_pylist() if (w := normal(x))]
            if words:
                size = by_size.setdefault(len(words), Size(len(words), int(edits * len(words) + 1e-9) if len(words) >= LEAST_WORDS else 0))
                size.ids.append(ident)
                size.words.append([self.codes.setdefault(w, len(self.codes) + 1) for w in words])
        self.sizes = [by_size[k] for k in sorted(by_size)]
        self.every = [(ident, w, s.edits) for s in self.sizes for ident, w in zip(s.ids, s.words)]
        cut: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, w, most) in enumerate(self.every):
            edges = [len(w) * j // (most + 1) for j in range(most + 2)]
            for x, y in zip(edges, edges[1:]):
                if y > x:
                    cut[y - x].append((i, x))
        #: By length of the pieces: their hashes in order, and of which items and from which places they are.
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, own in cut.items():
            words = np.array([self.every[i][1][x : x + n] for i, x in own], np.int64)
            h = _row_hashes(words.reshape(-1), np.arange(len(own)) * n, n)
            order = np.argsort(h, kind="stable")
            of = np.array(own, np.int64)[order]
            self.pieces[n] = h[order], of[:, 0], of[:, 1]
        self.length = np.array([len(w) for _, w, _ in self.every], np.int64)
        self.edits = np.array([most for *_, most in self.every], np.int64)
        self.flat = np.array([x for _, w, _ in self.every for x in w] or [0], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.places: dict[tuple[int, int], np.ndarray] = {}

    def find(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, object, int, int, int]]:
        """(text, item id, position, words, edits) of each matching pair of text and item, its best run of words."""
        text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        upto = np.concatenate([[0], np.cumsum(codes > 0)])
        found = [np.zeros((0, 4), np.int64)]
        for n, (keys, item, offset) in self.pieces.items():
            if len(codes) < n:
                continue
            at = np.flatnonzero(upto[n:] - upto[:-n] == n)
            at = at[text_of[at] == text_of[at + n - 1]]
            h = _row_hashes(codes, at, n)
            left = np.searchsorted(keys, h)
            hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == h)
            at, left = at[hit], left[hit]
            times = np.searchsorted(keys, h[hit], side="right") - left
            block = np.cumsum(times) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(at)]
            found += [self._windows(codes, starts, text_of, upto, at[a:b], left[a:b], times[a:b], item, offset) for a, b in zip(cuts, cuts[1:]) if b > a]
        text, i, lo, hi = np.unique(np.concatenate(found), axis=0).T
        if not len(text):
            return
        # Places of one text and item that overlap are one.
        first = np.concatenate([[True], (text[1:] != text[:-1]) | (i[1:] != i[:-1]) | (lo[1:] > hi[:-1])])
        at = np.flatnonzero(first)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, k, x, y in zip(text[at].tolist(), i[at].tolist(), lo[at].tolist(), np.maximum.reduceat(hi, at).tolist()):
            if run := best_run(self.every[k][1], codes[x:y].tolist(), self.every[k][2]):
                own = run[0], x + run[1], run[2]
                best[t, k] = min(best.get((t, k), own), own)
        for (t, k), (d, pos, n) in sorted(best.items()):
            yield t, self.every[k][0], pos, n, d

    def _windows(self, codes: np.ndarray, starts: np.ndarray, text_of: np.ndarray, upto: np.ndarray, at: np.ndarray, left: np.ndarray, times: np.ndarray, item: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """(text, item, from, to) around the windows of pieces found whose embeddings share a key with the item's; with as many of all items' words there as the bound leaves."""
        row = np.repeat(np.arange(len(at)), times)
        k = left[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        i, text, off, place = item[k], text_of[at[row]], offset[k], at[row]
        m, most = self.length[i], self.edits[i]
        lo, hi = np.maximum(starts[text], place - off - most), np.minimum(starts[text + 1], place - off + m + most)
        ok = np.flatnonzero(upto[hi] - upto[lo] >= m - most)
        # One and the same piece and place of an item are looked at once.
        own = np.unique(np.stack([i, off, place, text, lo, hi], axis=1)[ok], axis=0)
        shares = np.zeros(len(own), bool)
        steps = 2 * self.length[own[:, 0]]
        a = 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(np.cumsum(steps[a:]), CELLS // WALKS)) + a)
            shares[a:b] = self._alike(codes, starts, *own[a:b, :4].T)
            a = b
        return own[shares][:, [3, 0, 4, 5]]

    def _alike(self, codes: np.ndarray, starts: np.ndarray, i: np.ndarray, off: np.ndarray, place: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which windows share one of the keys with their item: equal symbols at all sampled places of a walk."""
        m = self.length[i]
        right, count = m - off, repeats()
        picked = np.stack([self._picked(int(n), int(x)) for n, x in zip(m, off)])
        hit = np.zeros(len(i), bool)
        ahead, behind = np.minimum(right, starts[text + 1] - place), np.minimum(off, place - starts[text])
        for w in range(WALKS):
            same = []
            for way, mine, theirs, size, own in ((1, self.start[i] + off, place, ahead, right), (-1, self.start[i] + off - 1, place - 1, behind, off)):
                n = 2 * int(own.max(initial=0))
                ways = np.full(len(i), way)
                same.append(embed(self.flat, mine, own, ways, n, w) == embed(codes, theirs, size, ways, n, w))
            both = np.concatenate([*(x for x in same), np.zeros((len(i), 1), bool)], axis=1)
            forward = same[0].shape[1]
            rows = np.arange(len(i))[:, None]
            for k in range(w, count, WALKS):
                p = picked[:, k]
                hit |= both[rows, np.where(p >= 0, p, forward - 1 - p)].all(axis=1)
        return hit

    def _picked(self, length: int, left: int) -> np.ndarray:
        if (length, left) not in self.places:
            all_keys = np.zeros((repeats(), SAMPLED), np.int64)
            for k in range(len(all_keys)):
                p = _sampled(length, left, k)
                all_keys[k] = np.resize(p, SAMPLED)
            self.places[length, left] = all_keys
        return self.places[length, left]


def _coded(texts: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the normal words (0: in no item), where texts start, and each word's place among the words of its text."""
    flat, starts = textops.split(texts)
    code, distinct = textops.coded(flat)
    table = np.fromiter(((items.codes.get(n, 0) if (n := normal(w)) else -1) for w in distinct), np.int64, len(distinct))
    codes = table[code]
    place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    keep = codes >= 0
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[starts], place[keep]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, edits: float) -> Iterator[Items]:
    """Items in blocks of bounded size, by id."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    if rows.limit(BLOCK + 1).count() <= BLOCK:
        yield Items(sorted(((r["i"], r["t"]) for r in rows.collect()), key=lambda x: (x[0] is None, x[0], x[1])), edits)
        return
    n = -(-rows.count() // (BLOCK // 2))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield Items(sorted(((r["i"], r["t"]) for r in own), key=lambda x: (x[0] is None, x[0], x[1])), edits)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """Per document row and item found in it: both ids, start_word, n_words and edit_distance of the best run of words.

    Words compare without case and marks at their ends; start_word counts white-space
    separated words from 0.  Items under eight words are found unchanged only; null and empty ones give no rows,
    nor do null and empty texts.  A very long text is read whole, alone in its slice.  Repeated rows give
    repeated results; ties go to the first run.  Other columns are not read.  If both id columns have
    one name, the item's becomes item_<name>.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    item_type = pa.int64() if benchmark.schema[item_col].dataType.typeName() in ("long", "integer", "short", "byte") else pa.string()
    item_name = item_col if item_col != id_col else f"item_{item_col}"
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_name, T.LongType() if item_type == pa.int64() else T.StringType()), *(T.StructField(n, T.LongType()) for n in ("start_word", "n_words", "edit_distance"))])
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, edits):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in textops.chunks(batches, "_text"):
                codes, starts, place = _coded(batch.column("_text"), items)
                found = [*items.find(codes, starts)]
                text, ident, pos, m, d = zip(*found) if found else ((),) * 5
                names = batch.column("_id").take(pa.array(text, pa.int64()))
                cols = [names, pa.array(ident, item_type), pa.array(place[np.array(pos, np.int64)]), pa.array(m, pa.int64()), pa.array(d, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item, as find() finds them.

    Null and empty texts hold none and stay, as do all rows where there are no items; repeated rows stay or go together.
    """
    prepare(docs.sparkSession)
    out = docs
    for items in _blocks(benchmark, item_col, item_text_col, edits):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in textops.chunks(batches, text_col):
                codes, starts, _ = _coded(batch.column(text_col), items)
                bad = np.zeros(batch.num_rows, bool)
                bad[[x[0] for x in items.find(codes, starts)]] = True
                yield batch.filter(pa.array(~bad))

        out = out.mapInArrow(run, out.schema)
    return out
