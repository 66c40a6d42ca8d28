"""Document quality: random-indexing word vectors, pooled, under a small calibrated network.

Each word gives units: its letters (if the sample has them often enough, else its shape
and ending), its case shape, its marks, and whether it repeats a word just before.  A
unit's vector starts from a sparse random index vector and gathers those of the units
around it in the sample (random indexing).  A document is the mean of its words'
vectors; a two-layer network scores it, and its logits are divided by a temperature
that fits labels which training has not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import prepare

#: The fit's bounds: labelled rows of each class, and the longest text (characters) taken from them.
SAMPLE, LONGEST = 2000, 40_000
DIM, SPARSE, REACH, UNITS, LEAST = 64, 4, 2, 20_000, 3
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
THRESHOLD = 0.7
_LETTERS = re.compile(r"[^\W\d_]+")
_SAME, _NEAR = "r:1", "r:3"


def _units(word: str) -> tuple[str, str, str, str]:
    """A word's letters, its ending by shape, its case shape and its marks."""
    found = _LETTERS.findall(word)
    core = "".join(found)
    if not core:
        return "", "e:", "s:0" if any(c.isdigit() for c in word) else "s:-", "m:" + word[:3]
    shape = "aa" if core.islower() else "AA" if core.isupper() and len(core) > 1 else "Aa" if core[1:].islower() or len(core) == 1 else "aA"
    tail = word[word.rfind(core[-1]) + 1 :][:3]
    inside = len(found) > 1
    return core.lower(), "e:" + core[-2:].lower(), f"s:{shape}{'+' * inside}", "m:" + tail


def _index_vector(unit: str) -> np.ndarray:
    """A few +1 and -1 at places that the unit's hash gives."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(unit))
    v = np.zeros(DIM, np.float32)
    v[rng.choice(DIM, SPARSE, replace=False)] = rng.choice([-1.0, 1.0], SPARSE)
    return v


@dataclass
class Model:
    """Unit vectors and the network; constant holds the answer where labels are of one class or missing."""

    place: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def _places(units: list[tuple[str, str, str, str]], place: dict[str, int]) -> np.ndarray:
    """The three rows of vectors that make up each word; row 0 is that of unknown units."""
    at = np.zeros((len(units), 3), np.int32)
    for k, (core, ending, shape, marks) in enumerate(units):
        at[k] = place.get(core) or place.get(ending, 0), place.get(shape, 0), place.get(marks, 0)
    return at


def _word_vectors(at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = vectors[at[:, 0]]
    for k in (1, 2):
        for lo in range(0, len(at), 20_000):
            out[lo : lo + 20_000] += vectors[at[lo : lo + 20_000, k]]
    return out


def _again(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words repeat the one before, and which one of the two before that, in the same text."""
    begin = np.repeat(starts[:-1], np.diff(starts))
    place = np.arange(len(code))

    def equal(k: int) -> np.ndarray:
        out = np.zeros(len(code), bool)
        out[k:] = (code[k:] == code[:-k]) & (place[k:] - k >= begin[k:])
        return out

    same = equal(1)
    return same, ~same & (equal(2) | equal(3))


def pooled(texts: pa.Array, place: dict[str, int], vectors: np.ndarray) -> np.ndarray:
    """Per text: the mean of its words' vectors, and the logarithm of one more than their number."""
    flat, starts = textops.split(texts)
    n = np.diff(starts)
    out = np.zeros((len(n), DIM + 1))
    out[:, -1] = np.log1p(n)
    if not len(flat):
        return out
    code, distinct = textops.coded(flat)
    own = _word_vectors(_places([_units(w) for w in distinct], place), vectors)
    same, near = _again(code, starts)
    step = 100_000
    text_of = np.repeat(np.arange(len(n)), n)
    for lo in range(0, len(code), step):
        hi = min(lo + step, len(code))
        rows = text_of[lo:hi]
        at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[at], :DIM] += np.add.reduceat(own[code[lo:hi]], at, axis=0)
    for flag, unit in ((same, _SAME), (near, _NEAR)):
        out[:, :DIM] += np.bincount(text_of[flag], minlength=len(n))[:, None] * vectors[place.get(unit, 0)]
    out[:, :DIM] /= np.maximum(n, 1)[:, None]
    return out


def _random_indexing(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Units of the sample and their vectors: their own index vector, and those of the words around, each half of the length."""
    flat, starts = textops.split(pa.array(texts, pa.string()))
    code, distinct = textops.coded(flat)
    counts, units = Counter(), [_units(w) for w in distinct]
    for u, c in zip(units, np.bincount(code, minlength=len(distinct)).tolist()):
        counts.update({x: c for x in set(u) if x})
    kept = [u for u, c in counts.most_common() if c >= LEAST][:UNITS]
    place = {u: k + 1 for k, u in enumerate([*kept, _SAME, _NEAR])}
    index = np.zeros((len(place) + 1, DIM), np.float32)
    for u, k in place.items():
        index[k] = _index_vector(u)
    at = _places(units, place)
    gathered = np.zeros_like(index)
    text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
    for d in range(1, REACH + 1):
        for lo in range(0, len(code) - d, 50_000):
            a, b = code[lo : min(lo + 50_000, len(code) - d)], code[lo + d : lo + d + 50_000]
            inside = text_of[lo : lo + len(a)] == text_of[lo + d : lo + d + len(a)]
            for x, y in ((a[inside], b[inside]), (b[inside], a[inside])):
                seen = _word_vectors(at[y], index)
                for k in range(3):
                    own = at[x, k]
                    order = np.argsort(own, kind="stable")
                    first = np.flatnonzero(np.diff(own[order], prepend=-1))
                    if len(first):
                        gathered[own[order][first]] += np.add.reduceat(seen[order], first, axis=0)
    gathered[0] = 0
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return place, (unit(index) + unit(gathered)).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Adam on the weighted logistic loss; the same rows give the same network."""
    rng = np.random.default_rng(7)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            k = order[lo : lo + 128]
            h = np.maximum(x[k] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[k]) * weight[k] / len(k)
            gh = np.outer(g, p[2]) * (h > 0)
            grads = [x[k].T @ gh + DECAY * p[0], gh.sum(0), h.T @ g + DECAY * p[2], np.array([g.sum()])]
            t += 1
            for q, gq, mq, vq in zip(p, grads, m, v):
                mq += 0.1 * (gq - mq)
                vq += 0.001 * (gq * gq - vq)
                q -= RATE * (mq / (1 - 0.9**t)) / (np.sqrt(vq / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def _temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature from 0.25 to 8 with the least weighted log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    loss = [(weight * np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Fit on at most ``sample`` rows of each class, those with the smallest hash of the id, and texts up to ``longest`` characters.

    usable says of a row of labels whether it may be learned from.  Labels of an id that
    has several are averaged; null ids and labels are left out.  Null texts count as empty, rows
    repeated whole are learned from once.  Labels of one class, or none, give a constant score.
    """
    spark = prepare(docs.sparkSession)
    known = labels.where(usable).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(1)
    blank = Model({}, np.zeros((1, DIM), np.float32), none, none + 1, none, none, none, 0.0)
    if len(totals) < 2:
        blank.constant = float(next(iter(totals), 0.5))
        return blank
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample).collect() for y in (0, 1)]
    small = spark.createDataFrame([tuple(r) for p in picked for r in p], known.schema)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= longest)
    del picked
    got = sorted({(r["_id"], r["text"], r["y"]) for r in rows.join(F.broadcast(small), "_id").collect()})
    y = np.array([r[2] for r in got], float)
    if len(set(y.tolist())) < 2:
        blank.constant = float(max(totals, key=totals.get))
        return blank
    texts = [r[1] for r in got]
    place, vectors = _random_indexing(texts)
    x = np.concatenate([pooled(pa.array(texts[k : k + 500], pa.string()), place, vectors) for k in range(0, len(texts), 500)])
    # The sample holds the classes in other shares than the labels.
    share = np.array([totals[0], totals[1]]) / sum(totals.values())
    weight = np.where(y > 0, share[1] / y.mean(), share[0] / (1 - y.mean()))
    late = np.array([xxhash.xxh64_intdigest(str(r[0]), 3) % 4 == 0 for r in got])
    if len(set(y[late])) < 2 or len(set(y[~late])) < 2:
        late[:] = False
    mean, scale = x[~late].mean(axis=0), x[~late].std(axis=0) + 1e-3
    net = _train((x[~late] - mean) / scale, y[~late], weight[~late])
    model = Model(place, vectors, mean, scale, *net)
    model.temperature = _temperature(model.logits(x[late]), y[late], weight[late]) if late.any() else 1.0
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, score (0 to 1) and predicted (1 from the threshold on).  Null texts count as empty; empty ones have the score of a text without words."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "_text", 4 << 20):
            s = model.scores(pooled(batch.column("_text"), model.place, model.vectors))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that reach the threshold.

    Ids are not read, so null and repeated ones do no harm; null texts count as empty ones, repeated
    texts score alike, very long ones are read whole, and a score at the threshold stays.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, text_col, 4 << 20):
            yield batch.filter(pa.array(model.scores(pooled(batch.column(text_col), model.place, model.vectors)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
