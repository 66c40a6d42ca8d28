"""Estimators per AOI and year that built-in functions can't express (M3-M5, M8, M10, M11, M14-M16) and learned ones.

Each grouped map sees one AOI's year, at most 366 days a sensor (cross_year: one AOI's years, pair_models:
one pair's dates, completed: 64 AOIs' year), so groups are bounded by the calendar and tasks
by AQE's partition sizes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr

#: M3: days by which a source's dates are shifted towards a target.
LAGS = {("s2", "modis"): 8, ("modis", "s2"): -8, ("landsat", "modis"): 5, ("modis", "landsat"): -5}
OUT = "aoi string, yr long, ord long, pred double"


def _clip(v: float, y: np.ndarray, lo: float = 0.05, margin: float = 0.04) -> float:
    a, b = np.quantile(y, [lo, 1 - lo])
    return float(min(max(v, a - margin), b + margin))


def local_polynomial(x: np.ndarray, y: np.ndarray, q: float, k: int = 16, degree: int = 3) -> float:
    """M3: the intercept of a weighted polynomial on the k nearest; up to degree points give the nearest."""
    order = np.lexsort((x, np.abs(x - q)))[:k]
    xx, yy = x[order], y[order]
    if len(xx) <= degree:
        return float(yy[0])
    z = (xx - q) / max(1.0, float(np.abs(xx - q).max()))
    w = 1 / (1 + 2 * np.abs(z))
    coef = np.linalg.lstsq(np.vander(z, degree + 1, increasing=True) * w[:, None], yy * w, rcond=None)[0]
    return _clip(float(coef[0]), yy)


def kernel_mean(x: np.ndarray, y: np.ndarray, q: float, bandwidth: float = 14, kind: str = "tricube") -> float:
    """M4: a Gaussian, tricube or Epanechnikov mean; the nearest value where no weight is left."""
    u = np.abs(x - q) / bandwidth
    w = {"gauss": np.exp(-0.5 * u * u), "tricube": np.clip(1 - u**3, 0, None) ** 3, "epanechnikov": np.clip(1 - u * u, 0, None)}[kind]
    return _clip(float(w @ y / w.sum()), y, 0.03, 0.05) if w.sum() > 1e-12 else float(y[np.argmin(u)])


def weighted_median(x: np.ndarray, y: np.ndarray, q: float, bandwidth: float = 14) -> float:
    """M4: the value at which Gaussian weights reach half their sum; the nearest value where no weight is left."""
    u = np.abs(x - q) / bandwidth
    w = np.exp(-0.5 * u * u)
    if w.sum() <= 1e-12:
        return float(y[np.argmin(u)])
    order = np.argsort(y, kind="stable")
    up = np.cumsum(w[order])
    return float(y[order][np.searchsorted(up, 0.5 * up[-1])])


def _huber_weights(r: np.ndarray, cut: float) -> np.ndarray:
    """1 up to ``cut`` scaled MADs, beyond that falling with the residual."""
    s = 1.4826 * float(np.median(np.abs(r - np.median(r)))) + 0.01
    return np.minimum(1, cut * s / np.maximum(np.abs(r), 1e-8))


def _ridge_fit(b: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: np.ndarray, rounds: int, cut: float = 2.5) -> np.ndarray:
    """Coefficients of a weighted ridge, refitted with Huber weights on top."""
    own = w
    for k in range(rounds + 1):
        c = np.linalg.solve(b.T @ (b * own[:, None]) + np.diag(penalty), b.T @ (y * own))
        if k < rounds:
            own = w * _huber_weights(y - b @ c, cut)
    return c


def loess(x: np.ndarray, y: np.ndarray, q: float, bandwidth: float = 20, degree: int = 2, rounds: int = 3) -> float:
    """M4: a Gaussian-weighted polynomial on the nearest 2 bandwidths' worth of points, refitted with Huber weights; too few points give the kernel's mean."""
    far = np.abs(x - q)
    pick = np.argsort(far, kind="stable")[: max(8, math.ceil(2 * bandwidth))]
    if len(pick) < degree + 2:
        return kernel_mean(x, y, q, bandwidth, "gauss")
    z = (x[pick] - q) / max(1.0, float(far[pick].max()))
    w = np.maximum(np.exp(-0.5 * (far[pick] / bandwidth) ** 2), 1e-12)
    c = _ridge_fit(np.vander(z, degree + 1, increasing=True), y[pick], w, np.array([1e-8, *[1e-3] * degree]), rounds)
    return _clip(float(c[0]), y, 0.03, 0.05)


#: Correlation by distance in lengths.
KERNELS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "matern32": lambda u: (1 + np.sqrt(3) * u) * np.exp(-np.sqrt(3) * u),
    "matern52": lambda u: (1 + np.sqrt(5) * u + 5 * u * u / 3) * np.exp(-np.sqrt(5) * u),
    "rbf": lambda u: np.exp(-0.5 * u * u),
}


def gaussian_process(x: np.ndarray, y: np.ndarray, q: float, length: float = 25, noise: float = 0.05, kind: str = "matern32") -> float:
    """M5: posterior mean around the median, under a Matérn-3/2, Matérn-5/2 or squared exponential kernel."""
    kern = lambda d: KERNELS[kind](d / length)
    m = float(np.median(y))
    s = max(float(np.var(y)), 1e-4)
    return m + float(s * kern(np.abs(x - q)) @ np.linalg.solve(s * kern(np.abs(x[:, None] - x)) + noise**2 * np.eye(len(x)), y - m))


def bump_ridge(x: np.ndarray, y: np.ndarray, q: float, width: float = 30, alpha: float = 0.3, rounds: int = 3) -> float:
    """M5: Gaussian bumps every ``width`` days over the known range and a constant, by a ridge with Huber weights."""
    at = np.arange(x.min(), x.max() + width, width)
    basis = lambda t: np.concatenate([np.ones((len(t), 1)), np.exp(-0.5 * ((t[:, None] - at) / width) ** 2)], axis=1)
    c = _ridge_fit(basis(x), y, np.ones(len(x)), np.array([1e-8, *[alpha] * len(at)]), rounds)
    return _clip(float(basis(np.array([q], float))[0] @ c), y, 0.03, 0.05)


def kalman(x: np.ndarray, y: np.ndarray, q: float, drift: float = 1e-3, noise: float = 2.5e-3) -> float:
    """M5: a random walk smoothed forward and backward to the day asked for."""

    def side(days: np.ndarray, values: np.ndarray) -> tuple[float, float]:
        m, p, at = 0.0, 1e6, None
        for d, v in zip(days, values):
            p += drift * (d - at if at is not None else 0)
            gain = p / (p + noise)
            m, p, at = m + gain * (v - m), (1 - gain) * p, d
        return (m, p + drift * abs(q - at)) if at is not None else (0.0, 1e9)

    order = np.argsort(x)
    xs, ys = x[order], y[order]
    a, pa = side(xs[xs <= q], ys[xs <= q])
    b, pb = side(-xs[xs > q][::-1], ys[xs > q][::-1]) if (xs > q).any() else (0.0, 1e9)
    if (xs > q).any():
        pb = pb - drift * abs(q + xs[xs > q][0]) + drift * abs(xs[xs > q][0] - q)
    return float((a / pa + b / pb) / (1 / pa + 1 / pb))


def fourier_ridge(x: np.ndarray, y: np.ndarray, q: float, harmonics: int = 3, alpha: float = 0.1, rounds: int = 3) -> float:
    """M5: harmonics of the year with a ridge and Huber weights."""
    basis = lambda t: np.stack([np.ones_like(t), *(f(2 * np.pi * k * t / 366) for k in range(1, harmonics + 1) for f in (np.sin, np.cos))], axis=-1)
    b, w = basis(x), np.ones(len(x))
    for _ in range(rounds):
        c = np.linalg.solve(b.T @ (b * w[:, None]) + alpha * np.eye(b.shape[1]), b.T @ (y * w))
        r = np.abs(y - b @ c)
        s = max(1.4826 * float(np.median(r)), 1e-3)
        w = np.minimum(1, 1.5 * s / np.maximum(r, 1e-9))
    return _clip(float(basis(np.array([q], float))[0] @ c), y, 0.03, 0.05)


def _collapsed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days in order, each once, with the median of its values."""
    s = pd.Series(y).groupby(x).median().sort_index()
    return s.index.to_numpy(float), s.to_numpy(float)


def nearest_value(x: np.ndarray, y: np.ndarray, q: float) -> float:
    """The value of the nearest day, the earlier of two."""
    xs, ys = _collapsed(x, y)
    return float(ys[np.lexsort((xs, np.abs(xs - q)))[0]])


def local_quadratic(x: np.ndarray, y: np.ndarray, q: float, bandwidth: float = 30, k: int = 12) -> float:
    """The value at q of a Gaussian-weighted parabola through the k nearest days, with a small ridge on its slope and bend; under three days their weighted mean.

    Three normal equations, solved by determinants.
    """
    xs, ys = _collapsed(x, y)
    pick = np.lexsort((xs, np.abs(xs - q)))[:k]
    d, v = xs[pick] - q, ys[pick]
    w = np.exp(-0.5 * (d / bandwidth) ** 2)
    if len(pick) < 3 or w.sum() < 1e-9:
        return float(w @ v / w.sum()) if w.sum() >= 1e-9 else float(v[0])
    s = [float(w @ d**p) for p in range(5)]
    t = [float(w @ (v * d**p)) for p in range(3)]
    a, e, i = s[0] + 1e-8, s[2] + 1e-4, s[4] + 1e-4
    det = a * (e * i - s[3] * s[3]) - s[1] * (s[1] * i - s[3] * s[2]) + s[2] * (s[1] * s[3] - e * s[2])
    first = t[0] * (e * i - s[3] * s[3]) - s[1] * (t[1] * i - s[3] * t[2]) + s[2] * (t[1] * s[3] - e * t[2])
    return _clip(first / det, v, 0.05, 0.05)


def smoothing_spline(x: np.ndarray, y: np.ndarray, q: float, slack: float = 1e-3) -> float:
    """The natural cubic spline of least bend whose mean squared residual is at most ``slack``, held at the ends.

    The penalty is found by bisection on the second-difference equations (Reinsch); two days give their line.
    """
    xs, ys = _collapsed(x, y)
    n = len(xs)
    if n < 3:
        return float(np.interp(q, xs, ys))
    h = np.diff(xs)
    second, inner = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        second[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        inner[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            inner[j, j - 1] = inner[j - 1, j] = h[j] / 6
    gram, right = second.T @ second, second.T @ ys

    def fit(penalty: float) -> tuple[np.ndarray, np.ndarray]:
        bend = np.linalg.solve(inner + penalty * gram, right)
        return ys - penalty * (second @ bend), bend

    lo, hi = -6.0, 12.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.mean((ys - fit(10**mid)[0]) ** 2) <= slack else (lo, mid)
    g, bend = fit(10**lo)
    q = min(max(q, xs[0]), xs[-1])
    k = min(int(np.searchsorted(xs, q, side="right")), n - 1) - 1
    m = np.concatenate([[0.0], bend, [0.0]])
    u, v = xs[k + 1] - q, q - xs[k]
    return _clip(float((u * g[k] + v * g[k + 1]) / h[k] - u * v / 6 * ((1 + u / h[k]) * m[k] + (1 + v / h[k]) * m[k + 1])), ys, 0.03, 0.05)


def pchip(x: np.ndarray, y: np.ndarray, q: float) -> float:
    """Monotone cubic interpolation, held at the ends; repeated days by their median."""
    xs, ys = _collapsed(x, y)
    if len(xs) == 1 or q <= xs[0] or q >= xs[-1]:
        return float(np.interp(q, xs, ys))
    h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
    m = np.empty(len(xs))
    m[0], m[-1] = d[0], d[-1]
    for k in range(1, len(xs) - 1):
        w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
        m[k] = 0.0 if d[k - 1] * d[k] <= 0 else (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])
    k = int(np.searchsorted(xs, q) - 1)
    t = (q - xs[k]) / h[k]
    return float((2 * t**3 - 3 * t**2 + 1) * ys[k] + (t**3 - 2 * t**2 + t) * h[k] * m[k] + (3 * t**2 - 2 * t**3) * ys[k + 1] + (t**3 - t**2) * h[k] * m[k + 1])


ESTIMATORS: dict[str, Callable] = {
    "cubic": local_polynomial, "kernel": kernel_mean, "median": weighted_median, "loess": loess, "gp": gaussian_process, "kalman": kalman, "fourier": fourier_ridge,
    "bumps": bump_ridge, "pchip": pchip, "nearest": nearest_value, "quadratic": local_quadratic, "spline": smoothing_spline,
}


def estimate(panel: DataFrame, name: str, **options) -> DataFrame:
    """(aoi, yr, ord, pred) of all gap rows whose AOI and year have a known value, by one of ESTIMATORS."""
    f = ESTIMATORS[name]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        known = g[g.y.notna() & ~g.gap].sort_values("ord")
        asked = g[g.gap]
        if not len(known) or not len(asked):
            return asked[["aoi", "yr", "ord"]].iloc[:0].assign(pred=np.zeros(0))
        x, y = known.ord.to_numpy(float), known.y.to_numpy()
        return asked[["aoi", "yr", "ord"]].assign(pred=[f(x, y, float(q), **options) for q in asked.ord])

    return panel.select("aoi", "yr", "ord", "y", "gap").groupBy("aoi", "yr").applyInPandas(run, OUT)


def lagged_long(panel: DataFrame, maps: DataFrame, target: str = "s2") -> DataFrame:
    """All sensors' known values in long form (aoi, yr, ord, source, y), mapped into the target's domain over all bins and shifted by LAGS."""
    long = panel.where("NOT gap").select("aoi", "yr", "ord", F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(s).alias("v")) for s in expr.SENSORS))).alias("p")).select("aoi", "yr", "ord", "p.*").where("v IS NOT NULL")
    own = maps.where((F.col("target") == target) & F.col("bin").isNull()).select("source", "a", "b")
    lag = F.coalesce(*(F.when(F.col("source") == s, d) for (t, s), d in LAGS.items() if t == target), F.lit(0))
    return long.join(F.broadcast(own), "source", "left").select("aoi", "yr", (F.col("ord") + lag).cast("long").alias("ord"), "source", F.coalesce(F.col("a") + F.col("b") * F.col("v"), F.col("v")).alias("y"))


def lagged_cubic(panel: DataFrame, maps: DataFrame, target: str = "s2") -> DataFrame:
    """M3: a local cubic over all sensors' values in the target's domain (see lagged_long())."""
    known = lagged_long(panel, maps, target).select("aoi", "yr", "ord", "y", F.lit(False).alias("gap"))
    asked = panel.where("gap").select("aoi", "yr", "ord", F.lit(None).cast("double").alias("y"), F.lit(True).alias("gap"))
    return estimate(known.unionByName(asked), "cubic")


def huber_affine(x: np.ndarray, y: np.ndarray, rounds: int = 6) -> tuple[float, float]:
    """M8: y = a + b x by reweighted least squares, a within 0.4 of zero and b from 0 to 2.5.

    Residuals further than 1.5 scaled MADs from their median lose weight.  Under four points,
    or without spread in x, the line is flat at the median.
    """
    if len(x) < 4 or np.std(x) < 1e-8:
        return (float(np.median(y)) if len(y) else 0.35), 0.0
    w = np.ones(len(x))
    for k in range(rounds + 1):
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        b = float((w * (x - mx) * (y - my)).sum() / (w * (x - mx) ** 2).sum())
        a = float(my - b * mx)
        if k < rounds:
            far = np.abs((y - a - b * x) - np.median(y - a - b * x))
            w = 1 / np.maximum(1, far / (1.5 * (1.4826 * np.median(far) + 1e-5)))
    return float(np.clip(a, -0.4, 0.4)), float(np.clip(b, 0, 2.5))


def cross_validated(x: np.ndarray, y: np.ndarray, least: int = 6) -> tuple[float, float, float, float] | None:
    """M8: (a, b, RMSE, MAE) of the Huber line, errors from two to five interleaved folds; None where it can't be judged."""
    n = len(x)
    if n < least or np.std(x) < 1e-7 or np.std(y) < 1e-7:
        return None
    fold = np.arange(n) % min(5, max(2, n // 5))
    out = np.full(n, np.nan)
    for f in range(fold.max() + 1):
        rest = fold != f
        if rest.sum() >= 4:
            a, b = huber_affine(x[rest], y[rest])
            out[~rest] = a + b * x[~rest]
    e = (out - y)[np.isfinite(out)]
    if len(e) < max(4, n // 2):
        return None
    return *huber_affine(x, y), float(np.sqrt(np.mean(e * e))), float(np.mean(np.abs(e)))


def pair_models(panel: DataFrame, reach: int = 4, least: int = 6) -> DataFrame:
    """M8: (aoi, peer, n, a, b, cv_rmse, cv_mae) of AOIs at most ``reach`` apart in id over their common dates.

    A group is one pair's dates, so the calendar bounds it; the reach bounds the pairs of an AOI.
    """
    own = panel.where("y IS NOT NULL").select("date", "ord", "aoi", "num", "y")
    peers = own.select("date", F.explode(F.array(*(F.col("num") + k for k in range(-reach, reach + 1) if k))).alias("num"), F.col("aoi").alias("peer"), F.col("y").alias("x"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ord")
        got = cross_validated(g.x.to_numpy(), g.y.to_numpy(), least)
        rows = [] if got is None else [(g.aoi.iloc[0], g.peer.iloc[0], len(g), *got)]
        return pd.DataFrame(rows, columns=["aoi", "peer", "n", "a", "b", "cv_rmse", "cv_mae"])

    return own.join(peers, ["date", "num"]).select("aoi", "peer", "ord", "x", "y").groupBy("aoi", "peer").applyInPandas(run, "aoi string, peer string, n long, a double, b double, cv_rmse double, cv_mae double")


def low_rank(matrix: np.ndarray, rank: int = 4, rounds: int = 20, limit: float | None = None) -> np.ndarray:
    """Missing cells of a small matrix by an iterated truncated SVD, from column medians; ``limit`` bounds what is filled in."""
    seen = np.isfinite(matrix)
    start = np.array([np.median(v[np.isfinite(v)]) if np.isfinite(v).any() else 0.0 for v in matrix.T])
    x = np.where(seen, matrix, start)
    for _ in range(rounds):
        u, s, v = np.linalg.svd(x, full_matrices=False)
        z = (u[:, :rank] * s[:rank]) @ v[:rank]
        x = np.where(seen, matrix, z if limit is None else np.clip(z, -limit, limit))
    return x


def completed(panel: DataFrame, width: int = 64, rank: int = 4) -> DataFrame:
    """Gap rows from the low-rank completion of date x AOI residuals around each AOI's monthly median.

    A matrix holds one year and at most ``width`` AOIs, so its size does not grow with the input.
    """
    p = panel.withColumn("bin", expr.profile_bin(F.col("doy")))
    base = p.where("y IS NOT NULL").groupBy("aoi", "bin").agg(F.median("y").alias("m"))
    rows = p.join(base, ["aoi", "bin"]).select("aoi", "yr", "ord", "gap", "m", (F.col("y") - F.col("m")).alias("r"), F.floor(F.col("num") / width).alias("block"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        asked = g[g.gap]
        known = g[g.r.notna()]
        if not len(asked) or not len(known):
            return asked[["aoi", "yr", "ord"]].iloc[:0].assign(pred=np.zeros(0))
        ids, days = np.unique(g.aoi.astype(str)), np.unique(g.ord)
        m = np.full((len(days), len(ids)), np.nan)
        m[np.searchsorted(days, known.ord), np.searchsorted(ids, known.aoi.astype(str))] = known.r
        limit = float(np.clip(np.quantile(np.abs(known.r), 0.995), 0.12, 0.8))
        x = low_rank(m, rank, limit=limit)
        return asked[["aoi", "yr", "ord"]].assign(pred=np.clip(asked.m.to_numpy() + x[np.searchsorted(days, asked.ord), np.searchsorted(ids, asked.aoi.astype(str))], -0.2, 1.1))

    return rows.groupBy("yr", "block").applyInPandas(run, OUT)


def seasonal_curve(doy: np.ndarray, y: np.ndarray, q: float, radius: float = 18.0, k: int = 24) -> float:
    """A weighted parabola at day q through the k nearest days within the radius (the k nearest at all where under four lie in it)."""
    far = np.abs(doy - q)
    pick = np.argsort(far, kind="stable")
    near = pick[far[pick] <= radius]
    pick = (near if len(near) >= 4 else pick)[:k]
    w = 1 / (1 + far[pick] / radius)
    b = np.vander((doy[pick] - q) / radius, min(2, len(pick) - 1) + 1, increasing=True)
    return float(np.linalg.lstsq(b * w[:, None], y[pick] * w, rcond=None)[0][0])


def cross_year(panel: DataFrame, local: DataFrame | None = None, anchors: int = 40) -> DataFrame:
    """(aoi, yr, ord, pred) of gap rows from the AOI's curve over other years.

    The curve is fitted to the year's own values by a Huber line, trusted the more the more
    anchors there are (all from twelve on).  ``local`` (aoi, yr, ord, pred) is blended in with 0.2 to 0.75,
    as the year's values number up to 90.  AOIs seen in no other year have no row.  A group is one AOI.
    """
    rows = panel.select("aoi", "yr", "ord", "doy", "y", "gap")
    rows = rows.withColumn("local", F.lit(None).cast("double")) if local is None else rows.join(local.select("aoi", "yr", "ord", F.col("pred").alias("local")), ["aoi", "yr", "ord"], "left")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        parts = []
        known = g[g.y.notna() & ~g.gap].sort_values(["yr", "doy"])
        for yr, asked in g[g.gap].groupby("yr"):
            old, cur = known[known.yr != yr], known[known.yr == yr]
            if not len(old):
                continue
            hx, hy, cx, cy = old.doy.to_numpy(float), old.y.to_numpy(), cur.doy.to_numpy(float), cur.y.to_numpy()
            at = {d: seasonal_curve(hx, hy, d) for d in np.unique(np.concatenate([cx, asked.doy.to_numpy(float)]))}
            pred = np.array([at[d] for d in asked.doy.astype(float)])
            if len(cx) >= 4:
                share = min(1.0, min(len(cx), anchors) / 12)
                for j, d in enumerate(asked.doy.astype(float)):
                    pick = np.argsort(np.abs(cx - d), kind="stable")[:anchors]
                    a, b = huber_affine(np.array([at[c] for c in cx[pick]]), cy[pick])
                    pred[j] = (1 - share) * pred[j] + share * (a + b * pred[j])
            own = asked.local.to_numpy(float)
            w = np.where(np.isfinite(own), min(0.75, max(0.2, len(cx) / 90)), 0.0)
            parts.append(asked[["aoi", "yr", "ord"]].assign(pred=np.clip(w * np.nan_to_num(own) + (1 - w) * pred, -0.2, 1.1)))
        return pd.concat(parts) if parts else g[["aoi", "yr", "ord"]].iloc[:0].assign(pred=np.zeros(0))

    return rows.groupBy("aoi").applyInPandas(run, OUT)


def year_analogues(panel: DataFrame, k: int = 3, overlap: int = 3, decay: float = 0.3, alpha: float = 0.25) -> DataFrame:
    """(aoi, date, pred, n_years) of gap rows from the AOI's other years whose curves are nearest to what is known of this one.

    A year is compared on the known days inside its own support by the root mean square of
    differences clipped to half; the k nearest of those with ``overlap`` days vote by exp(-distance / decay),
    each where it has support, and the line between the row's neighbours counts alpha where there is one.

    Other years' values at a row's day come from one window over AOI and year, which the rows
    of all other years enter without a value of their own.
    """
    from .windows import neighbours

    rows = panel.select("aoi", "date", "yr", "doy", "ord", "y", "gap")
    seen = rows.where("y IS NOT NULL").groupBy("aoi", "yr", "doy").agg(F.avg("y").alias("v"))
    support = seen.groupBy("aoi").agg(F.collect_set("yr").alias("years"))
    counted = F.count("*").over(Window.partitionBy("aoi", "hyr"))
    past = seen.select("aoi", F.col("yr").alias("hyr"), "doy", "v").withColumn("_c", counted).where("_c >= 3").drop("_c")
    asked = rows.where("gap OR y IS NOT NULL").join(support, "aoi").withColumn("hyr", F.explode("years")).where("hyr <> yr").drop("years")
    both = past.withColumn("_s", F.struct(F.col("doy").alias("d"), F.col("v").alias("v"))).unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy("aoi", "hyr").orderBy("doy")
    both = both.withColumns({
        "_p": F.last("_s", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)),
        "_n": F.first("_s", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)),
    }).where("_s IS NULL AND _p IS NOT NULL AND _n IS NOT NULL")
    p, n = F.col("_p"), F.col("_n")
    line = F.when(n["d"] > p["d"], p["v"] + (n["v"] - p["v"]) * (F.col("doy") - p["d"]) / (n["d"] - p["d"])).otherwise(p["v"])
    curves = both.select("aoi", "date", "yr", "hyr", "y", "gap", line.alias("h"))
    off = expr.clip(F.col("y") - F.col("h"), -0.5, 0.5)
    score = curves.where("y IS NOT NULL").groupBy("aoi", "yr", "hyr").agg(F.count("*").alias("c"), F.sqrt(F.avg(off * off)).alias("far")).where(F.col("c") >= overlap)
    near = score.withColumn("_r", F.row_number().over(Window.partitionBy("aoi", "yr").orderBy(F.round("far", 10), "hyr"))).where(F.col("_r") <= k)
    weight = F.exp(-F.col("far") / decay)
    voted = curves.where("gap").join(near.select("aoi", "yr", "hyr", "far"), ["aoi", "yr", "hyr"]).groupBy("aoi", "date").agg((F.sum(weight * F.col("h")) / F.sum(weight)).alias("a"), F.count("*").alias("n_years"))
    own = neighbours(rows).where("gap").select("aoi", "date", F.when(~F.col("edge"), F.col("lerp")).alias("c"))
    return voted.join(own, ["aoi", "date"], "left").select("aoi", "date", F.when(F.col("c").isNotNull(), (1 - alpha) * F.col("a") + alpha * F.col("c")).otherwise(F.col("a")).alias("pred"), "n_years")


def component_stack(train: DataFrame, names: list[str], target: str, rank: int = 2, least: int = 30) -> Column | None:
    """The target from the first principal components of base predictions; missing ones count as their mean.  None under ``least`` rows.

    Means, covariances and products with the target are sums in Spark; a matrix of a few columns is solved on the driver.
    """
    means = train.agg(*(F.avg(c).alias(c) for c in names)).first()
    mid = [float(means[c] or 0.0) for c in names]
    cols = [F.coalesce(F.col(c), F.lit(m)) - F.lit(m) for c, m in zip(names, mid)]
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    known = F.when(F.col(target).isNotNull(), F.lit(1.0))
    row = train.agg(*(F.sum(cols[i] * cols[j]) for i, j in pairs), *(F.sum(known * cols[i] * cols[j]) for i, j in pairs), *(F.sum(known * c) for c in cols), *(F.sum(c * F.col(target)) for c in cols), F.count(target), F.sum(target)).first()
    whole, own = np.zeros((k, k)), np.zeros((k, k))
    for at, (i, j) in enumerate(pairs):
        whole[i, j] = whole[j, i] = row[at] or 0.0
        own[i, j] = own[j, i] = row[len(pairs) + at] or 0.0
    sums, products, (n, total) = np.array(row[2 * len(pairs) : -2], float)[:k], np.array(row[2 * len(pairs) : -2], float)[k:], row[-2:]
    if n < max(least, 5 * rank):
        return None
    basis = np.linalg.eigh(whole)[1][:, ::-1][:, :rank]
    gram = np.block([[np.array([[n]]), (sums @ basis)[None, :]], [(sums @ basis)[:, None], basis.T @ own @ basis]])
    c = np.linalg.lstsq(gram, np.concatenate([[total], products @ basis]), rcond=None)[0]
    weights = basis @ c[1:]
    return reduce(lambda x, y: x + y, [float(w) * col for w, col in zip(weights, cols)], F.lit(float(c[0])))


def z_space(panel: DataFrame, floor: float = 0.02) -> DataFrame:
    """Gap rows by the line between neighbours in units of the AOI's monthly mean and deviation."""
    from .windows import neighbours

    p = panel.withColumn("bin", expr.profile_bin(F.col("doy")))
    norm = p.where("y IS NOT NULL").groupBy("aoi", "bin").agg(F.avg("y").alias("m"), F.greatest(F.lit(floor), F.coalesce(F.stddev_pop("y"), F.lit(0.0))).alias("s"))
    z = neighbours(p.join(norm, ["aoi", "bin"], "left").withColumn("z", (F.col("y") - F.col("m")) / F.col("s")), "z")
    return z.where("gap").select("aoi", "date", expr.clip(F.col("m") + F.col("s") * F.col("lerp"), -0.2, 1.1).alias("pred"))


def peer_ridge(panel: DataFrame, reach: int = 4, k: int = 8, alpha: float = 10.0, least: int = 30) -> DataFrame:
    """The residual of gap rows from same-date residuals of the AOIs at most ``reach`` apart in id.

    Each pair's slope comes from deviations from medians over common dates, shrunk by alpha and
    within two; the k best correlated peers count by their correlation, 0.05 at least.
    """
    p = panel.withColumn("bin", expr.profile_bin(F.col("doy")))
    base = p.where("y IS NOT NULL").groupBy("aoi", "bin").agg(F.median("y").alias("m"))
    rows = p.join(base, ["aoi", "bin"]).withColumn("r", F.col("y") - F.col("m"))
    seen = rows.where("r IS NOT NULL").select("date", "num", "aoi", F.col("r").alias("z"))
    peers = seen.select("date", "aoi", "z", F.explode(F.array(*(F.col("num") + d for d in range(-reach, reach + 1) if d))).alias("num")).select("date", "num", F.col("aoi").alias("peer"), F.col("z").alias("x"))
    pairs = seen.join(peers, ["date", "num"])
    mid = pairs.groupBy("aoi", "peer").agg(F.count("*").alias("n"), F.median("x").alias("xm"), F.median("z").alias("zm"), expr.correlation(F.col("x"), F.col("z")).alias("c")).where((F.col("n") >= least) & F.col("c").isNotNull())
    dx, dz = F.col("x") - F.col("xm"), F.col("z") - F.col("zm")
    fit = pairs.join(mid, ["aoi", "peer"]).groupBy("aoi", "peer", "xm", "zm", "c").agg(expr.clip(F.sum(dx * dz) / (F.sum(dx * dx) + alpha), -2, 2).alias("b"))
    best = fit.withColumn("_r", F.row_number().over(Window.partitionBy("aoi").orderBy(F.round("c", 12).desc(), "peer"))).where(F.col("_r") <= k)
    asked = rows.where("gap").select("aoi", "num", "date", "m").join(peers, ["date", "num"]).join(best, ["aoi", "peer"])
    w = F.greatest(F.col("c"), F.lit(0.05))
    return asked.groupBy("aoi", "date").agg((F.first("m") + F.sum(w * (F.col("zm") + F.col("b") * dx)) / F.sum(w)).alias("pred"), F.count("*").alias("n_peers"))


def route(counts: list[dict[str, Column]], posterior: dict[str, Column], least: int = 1, purity: float = 0.67) -> Column:
    """M7: the sensor most neighbours have at the first radius where enough of them agree; else the posterior's mode.  Ties go to the first sensor."""
    mode = lambda d: F.coalesce(*(F.when(c == F.greatest(*d.values()), s) for s, c in d.items()))
    out = F.lit(None).cast("string")
    for c in reversed(counts):
        total = reduce(lambda a, b: a + b, c.values())
        out = F.when((total >= least) & (F.greatest(*c.values()) >= purity * F.greatest(F.lit(1), total)), mode(c)).otherwise(out)
    return F.coalesce(out, mode(posterior))


def soft_route(counts: dict[str, Column], posterior: dict[str, Column], prior: float = 0.25, power: float = 2.0) -> dict[str, Column]:
    """M7: shares of the sensors from counts and a share of the posterior, sharpened by a power."""
    q = {s: c + prior * posterior[s] for s, c in counts.items()}
    total = reduce(lambda a, b: a + b, q.values())
    w = {s: F.pow(expr.clip(F.when(total > 0, c / total).otherwise(posterior[s]), 1e-9, 1.0), power) for s, c in q.items()}
    whole = reduce(lambda a, b: a + b, w.values())
    return {s: c / whole for s, c in w.items()}


def trust(days: Column, far: float = 0.30) -> Column:
    """M7: the weight of a neighbour by its distance: 0.5 up to 2, 0.4 up to 8, else the far one."""
    return F.when(days <= 2, 0.50).when(days <= 8, 0.40).otherwise(far)


def source_counts(panel: DataFrame, radii: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """M7: for gap rows, the sensors of same-crop AOIs that day within each id distance, and the nearest one's distance."""
    reach = max(radii)
    seen = panel.where("y IS NOT NULL AND source <> 'none'").select("date", "crop_type", "source", F.col("num").alias("p_num"))
    near = seen.select("date", "crop_type", "source", "p_num", F.explode(F.array(*(F.col("p_num") + d for d in range(-reach, reach + 1) if d))).alias("num"))
    far = F.abs(F.col("num") - F.col("p_num"))
    asked = panel.where("gap").select("aoi", "num", "date", "crop_type").join(near, ["date", "crop_type", "num"], "left")
    return asked.groupBy("aoi", "date").agg(F.min(far).alias("nearest"), *(F.count_if((far <= r) & (F.col("source") == s)).alias(f"{s}_{r}") for r in radii for s in expr.SENSORS))


def blend(weights: dict[str, float], lo: float = -0.2, hi: float = 1.1) -> Column:
    """M9: a weighted sum of prediction columns, clipped."""
    first, *rest = [w * F.col(c) for c, w in weights.items()]
    return expr.clip(sum(rest, first), lo, hi)


def _present(train: DataFrame, features: list[str]) -> list[str]:
    """The features that have a value in some row; medians of the others can't be taken."""
    counts = train.agg(*(F.count(f).alias(f) for f in features)).first()
    return [f for f in features if counts[f]]


def trees(train: DataFrame, features: list[str], target: str, kind: str = "gbt", seed: int = 7, weight: str | None = None, rounds: int = 40):
    """Medians for missing values, then boosted trees (squared or absolute loss), a forest, a linear model on scaled features (ridge, plain or Huber) or a forest classifier; a fitted PipelineModel.

    ``weight`` names a column of row weights.  Features without a value in any row are left out.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    features = _present(train, features)
    stages = [Imputer(strategy="median", inputCols=features, outputCols=[f"{f}_i" for f in features]), VectorAssembler(inputCols=[f"{f}_i" for f in features], outputCol="features")]
    if kind in ("ridge", "ols", "huber"):
        stages[-1].setOutputCol("raw")
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    if kind == "source":
        stages += [StringIndexer(inputCol=target, outputCol="label"), RandomForestClassifier(numTrees=30, maxDepth=8, seed=seed)]
    else:
        stages.append({
            "gbt": lambda: GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed),
            "absolute": lambda: GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed, lossType="absolute"),
            "forest": lambda: RandomForestRegressor(labelCol=target, numTrees=60, maxDepth=9, minInstancesPerNode=5, seed=seed),
            "extra": lambda: RandomForestRegressor(labelCol=target, numTrees=60, maxDepth=9, minInstancesPerNode=5, seed=seed, bootstrap=False, featureSubsetStrategy="onethird", maxBins=8),
            "ridge": lambda: LinearRegression(labelCol=target, regParam=0.1),
            "ols": lambda: LinearRegression(labelCol=target, solver="normal"),
            "huber": lambda: LinearRegression(labelCol=target, loss="huber", regParam=0.01),
        }[kind]())
    if weight:
        stages[-1].setWeightCol(weight)
    # Each stage and each round of a solver reads the rows again.
    own = train.select(*features, target, *([weight] if weight else [])).persist()
    try:
        return Pipeline(stages=stages).fit(own)
    finally:
        own.unpersist()


def source_experts(train: DataFrame, asked: DataFrame, features: list[str], target: str, least: int = 40, **options) -> DataFrame:
    """M6: one model a sensor on its own rows, and one on all for sensors with under ``least``; pred mixes them by the posterior (p_s2, ...)."""
    counts = {r["source"]: r["n"] for r in train.groupBy("source").agg(F.count("*").alias("n")).collect()}
    whole = trees(train, features, target, **options) if any(counts.get(s, 0) < least for s in expr.SENSORS) else None
    out = asked
    for s in expr.SENSORS:
        model = trees(train.where(F.col("source") == s), features, target, **options) if counts.get(s, 0) >= least else whole
        out = model.transform(out).select(*out.columns, F.col("prediction").alias(f"e_{s}"))
    share = reduce(lambda a, b: a + b, [F.col(f"p_{s}") for s in expr.SENSORS])
    mixed = reduce(lambda a, b: a + b, [F.col(f"p_{s}") * F.col(f"e_{s}") for s in expr.SENSORS])
    return out.withColumn("pred", F.try_divide(mixed, share))


def boosted_quantile(train: DataFrame, asked: DataFrame, features: list[str], target: str, share: float = 0.5, rounds: int = 12, rate: float = 0.3, depth: int = 4, seed: int = 7) -> DataFrame:
    """M6: ``asked`` with pred, the target's quantile by boosted trees on the pinball loss.

    A round grows a tree on the loss's gradient and moves each of its leaves by the quantile of
    the leaf's residuals; leaves are told apart by their predictions, a small table.
    """
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    features = _present(train, features)
    imputed = [f"{f}_i" for f in features]
    prepare = Imputer(strategy="median", inputCols=features, outputCols=imputed).fit(train)
    assemble = VectorAssembler(inputCols=imputed, outputCol="_x")
    slim = lambda df, *more: assemble.transform(prepare.transform(df)).drop(*imputed)
    start = train.agg(F.expr(f"percentile({target}, {share}D)")).first()[0]
    rows, out = slim(train.select(*features, target)).select("_x", F.col(target).alias("_t")).persist(), slim(asked)
    moves = []
    try:
        for k in range(rounds):
            now = _moved(rows, moves, start, rate).withColumn("_r", F.col("_t") - F.col("pred")).withColumn("_g", F.when(F.col("_r") > 0, share).otherwise(share - 1))
            tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_g", predictionCol="_leaf", maxDepth=depth, minInstancesPerNode=10, seed=seed + k).fit(now)
            leaves = tree.transform(now).groupBy("_leaf").agg(F.expr(f"percentile(_r, {share}D)").alias("v")).collect()
            moves.append((tree, {r["_leaf"]: r["v"] for r in leaves}))
    finally:
        rows.unpersist()
    return _moved(out, moves, start, rate).drop("_x")


def _moved(df: DataFrame, moves: list, start: float, rate: float) -> DataFrame:
    """pred: the start and all rounds' moves."""
    out = df.withColumn("pred", F.lit(float(start)))
    for tree, leaves in moves:
        table = F.create_map(*(F.lit(float(x)) for item in leaves.items() for x in item))
        out = tree.transform(out).withColumn("pred", F.col("pred") + rate * F.coalesce(table[F.col("_leaf")], F.lit(0.0))).drop("_leaf")
    return out


def out_of_fold(rows: DataFrame, fold: str, folds: list, predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Each fold's rows as ``predict(the others, the fold)`` returns them, so no row is scored by a fit that saw it."""
    return reduce(lambda a, b: a.unionByName(b), [predict(rows.where(F.col(fold) != f), rows.where(F.col(fold) == f)) for f in folds])
