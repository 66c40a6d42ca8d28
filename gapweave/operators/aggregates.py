"""Grouped statistics: errors by slice, shocks, loadings, corrections and quality figures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr


def robust_scale(df: DataFrame, by: list[str], value: str, floor: float) -> DataFrame:
    """max(floor, 1.4826 MAD, 0.15 population deviation) by group."""
    mid = df.groupBy(*by).agg(F.median(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    both = df.join(mid, by) if by else df.join(F.broadcast(mid), how="left")
    return both.groupBy(*by).agg(F.greatest(F.lit(floor), 1.4826 * F.median(F.abs(F.col(value) - F.col("_m"))), 0.15 * F.first("_s")).alias("scale"))


def sensitivity(df: DataFrame, by: list[str], least: int = 12) -> DataFrame:
    """Residual on temperature and rain with intercept, by the normal equations of centred sums; signs forced, sizes clipped, defaults where it can't be fitted."""
    fine = df.where("resid IS NOT NULL AND temp_c IS NOT NULL AND precip_mm IS NOT NULL")
    c = lambda a, b: F.covar_pop(a, b)
    g = fine.groupBy(*by).agg(F.count("*").alias("n"), c("temp_c", "temp_c").alias("tt"), c("precip_mm", "precip_mm").alias("pp"), c("temp_c", "precip_mm").alias("tp"), c("temp_c", "resid").alias("tr"), c("precip_mm", "resid").alias("pr"))
    det = F.col("tt") * F.col("pp") - F.col("tp") * F.col("tp")
    ok = (F.col("n") >= least) & (det > 1e-9)
    bt = F.when(ok, (F.col("pp") * F.col("tr") - F.col("tp") * F.col("pr")) / det)
    bp = F.when(ok, (F.col("tt") * F.col("pr") - F.col("tp") * F.col("tr")) / det)
    return g.select(*by, "n", F.coalesce(expr.clip(-F.abs(bt), -0.10, -0.008), F.lit(-0.035)).alias("beta_t"), F.coalesce(expr.clip(F.abs(bp), 0.008, 0.08), F.lit(0.025)).alias("beta_p"))


def counterfactual(df: DataFrame, beta: DataFrame, temp_delta: float = 2.0, precip_factor: float = 0.7, severity: float = 1.0, by: str = "aoi") -> DataFrame:
    """Values under another weather, within [-1, 1]; delta is what is left of the change after clipping."""
    dt, dp = F.lit(temp_delta * severity), F.coalesce("precip_mm", F.lit(0.0)) * ((precip_factor - 1) * severity)
    out = df.join(beta, by)
    change = F.col("beta_t") * dt / F.col("sigma_t") + F.col("beta_p") * dp / F.col("sigma_p")
    out = out.withColumn("scenario", expr.clip(F.col("value") + change, -1, 1))
    return out.withColumn("delta", F.col("scenario") - F.col("value"))


def date_shock(df: DataFrame, value: str, least: int = 3) -> DataFrame:
    """A10: per date the median over AOIs of a residual clipped to half, where three AOIs have one; and how many."""
    r = df.where(F.col(value).isNotNull()).groupBy("date", "aoi").agg(F.median(expr.clip(F.col(value), -0.5, 0.5)).alias("r"))
    return r.groupBy("date").agg(F.median("r").alias("shock"), F.count("*").alias("n_aoi")).where(F.col("n_aoi") >= least)


def loadings(df: DataFrame, by: str = "aoi", shrink: float = 0.5, least: int = 8) -> DataFrame:
    """Response b of residuals r to the factor f, shrunk and within [-2, 2]; 1 under eight pairs."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("f") * F.col("r")).alias("fr"), F.sum(F.col("f") * F.col("f")).alias("ff"))
    return g.select(by, "n", F.when(F.col("n") >= least, expr.clip(F.col("fr") / (F.col("ff") + shrink), -2, 2)).otherwise(1.0).alias("loading"))


def channel_stats(df: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """Median, mean, sample deviation and count of each channel by group, in one pass."""
    return df.groupBy(*by).agg(*(f(c).alias(f"{c}_{n}") for c in channels for n, f in (("median", F.median), ("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))))


def error_summary(df: DataFrame, dims: list[str], error: Column, bins: dict[str, list[str]] | None = None) -> DataFrame:
    """N, RMSE and MAE over all and by each dimension, in one pass of GROUPING SETS; NULL groups stay, and so do empty ones of the named bins."""
    own = df.select(*dims, error.alias("e"))
    name = F.lit("all")
    level = F.lit(None).cast("string")
    for d in dims:
        name = F.when(F.grouping(d) == 0, d).otherwise(name)
        level = F.when(F.grouping(d) == 0, F.col(d).cast("string")).otherwise(level)
    e = F.col("e")
    out = own.groupingSets([[], *([F.col(d)] for d in dims)], *map(F.col, dims)).agg(name.alias("dimension"), level.alias("level"), F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")).select("dimension", "level", "n", "rmse", "mae")
    if bins:
        all_bins = df.sparkSession.createDataFrame([(d, b) for d, labels in bins.items() for b in labels], "dimension string, level string")
        empty = all_bins.join(out, ["dimension", "level"], "left_anti")
        out = out.unionByName(empty.select("*", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("rmse"), F.lit(None).cast("double").alias("mae")))
    return out


def corrections(df: DataFrame, by: list[str], lo: float = 0.01, trim: float = 0.1) -> DataFrame:
    """Per group n, the clipped affine map of pred onto truth (plain, and on truth winsorised at 1 and 99 %), the median bias and the mean of residuals within the inner 80 %; the identity under twenty rows."""
    q = lambda c, t: F.expr(f"percentile({c}, array({t}D, {1 - t}D))")
    fine = df.where("pred IS NOT NULL AND truth IS NOT NULL").withColumn("r", F.col("truth") - F.col("pred"))
    edges = fine.groupBy(*by).agg(q("truth", lo).alias("_t"), q("r", trim).alias("_q"))
    both = fine.join(edges, by)
    clipped = F.greatest(F.col("_t")[0], F.least(F.col("_t")[1], F.col("truth")))
    g = both.withColumn("w", clipped).groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_intercept("truth", "pred").alias("a"), F.regr_slope("truth", "pred").alias("b"), F.regr_intercept("w", "pred").alias("wa"), F.regr_slope("w", "pred").alias("wb"),
        F.median("r").alias("m"), F.avg(F.when(F.col("r").between(F.col("_q")[0], F.col("_q")[1]), F.col("r"))).alias("t"),
    )
    few = F.col("n") < 20
    fit = lambda c, low, high, none: F.when(few | F.col("b").isNull(), none).otherwise(expr.clip(F.col(c), low, high))
    return g.select(
        *by, "n", fit("a", -0.08, 0.08, 0.0).alias("a"), fit("b", 0.85, 1.15, 1.0).alias("b"), fit("wa", -0.08, 0.08, 0.0).alias("robust_a"), fit("wb", 0.85, 1.15, 1.0).alias("robust_b"),
        expr.clip(F.col("m"), -0.04, 0.04).alias("bias_median"), F.col("t").alias("trimmed_mean"),
    )


def nested_rules(df: DataFrame, fold: str, truth: str, bases: list[str], peer: str, weights: tuple[float, ...] = (0.05, 0.10, 0.15), ridge: float = 1e-4, least: int = 30) -> DataFrame:
    """For each fold the rule (base, peer weight, mode) with the smallest error on the other folds, its coefficients, and its error on the fold.

    Modes use no feature, shock, state or both; a missing feature counts 0 and a missing peer leaves
    the base.  Coefficients on shock and state are ridge solutions within [0, 0.4] and
    [-0.4, 0.1], (0.15, -0.05) under thirty rows.  All errors follow from one pass of sums by
    fold and rule, those of the other folds as the whole less the fold; ties go to the rule first in order.
    """
    rules = F.array(*(F.struct(F.lit(b).alias("base"), F.lit(w).alias("weight"), F.when(F.col(peer).isNull(), F.col(b)).otherwise((1 - w) * F.col(b) + w * F.col(peer)).alias("p")) for b in bases for w in weights))
    s, t, r = F.coalesce("shock", F.lit(0.0)), F.coalesce("state", F.lit(0.0)), F.col(truth) - F.col("p")
    long = df.where(F.col(truth).isNotNull()).select(fold, truth, s.alias("s"), t.alias("t"), F.explode(rules).alias("_")).select("*", "_.*").withColumn("r", r).where("r IS NOT NULL")
    pairs = {"ss": ("s", "s"), "st": ("s", "t"), "tt": ("t", "t"), "rs": ("r", "s"), "rt": ("r", "t"), "rr": ("r", "r")}
    sums = long.groupBy(fold, "base", "weight").agg(F.count("*").cast("double").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(k) for k, (a, b) in pairs.items()))
    whole = Window.partitionBy("base", "weight")
    other = sums.withColumns({f"o_{k}": F.sum(k).over(whole) - F.col(k) for k in ("n", *pairs)})
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(i).alias("us"), F.lit(j).alias("ut")) for m, i, j in (("none", 0.0, 0.0), ("shock", 1.0, 0.0), ("state", 0.0, 1.0), ("joint", 1.0, 1.0))))
    m = other.select("*", F.explode(modes).alias("_")).select("*", "_.*").where("o_n > 0")
    ss, tt, st = F.col("us") * F.col("o_ss") + ridge, F.col("ut") * F.col("o_tt") + ridge, F.col("us") * F.col("ut") * F.col("o_st")
    rs, rt, det = F.col("us") * F.col("o_rs"), F.col("ut") * F.col("o_rt"), ss * tt - st * st
    few = F.col("o_n") < least
    m = m.withColumns({
        "a": F.col("us") * F.when(few, 0.15).otherwise(expr.clip((tt * rs - st * rt) / det, 0.0, 0.4)),
        "b": F.col("ut") * F.when(few, F.when(F.col("us") > 0, -0.05).otherwise(0.0)).otherwise(expr.clip((ss * rt - st * rs) / det, -0.4, 0.1)),
    })
    a, b = F.col("a"), F.col("b")
    mse = lambda o: (F.col(f"{o}rr") - 2 * a * F.col(f"{o}rs") - 2 * b * F.col(f"{o}rt") + a * a * F.col(f"{o}ss") + 2 * a * b * F.col(f"{o}st") + b * b * F.col(f"{o}tt")) / F.col(f"{o}n")
    m = m.withColumns({"train_mse": mse("o_"), "test_mse": mse("")})
    first = Window.partitionBy(fold).orderBy(F.round("train_mse", 12), "base", "weight", "mode")
    return m.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(fold, "base", "weight", "mode", "a", "b", "train_mse", "test_mse", F.col("n").cast("long").alias("n"))


def group_bias(df: DataFrame, by: str, least: int, most: float = 0.04, prior: float = 8) -> DataFrame:
    """Mean residual by group, shrunk by n / (n + 8), clipped, for groups with enough rows."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.avg("resid").alias("m")).where(F.col("n") >= least)
    return g.select(by, "n", expr.clip(F.col("m") * F.col("n") / (F.col("n") + prior), -most, most).alias("bias"))


def group_slope(df: DataFrame, by: str, least: int = 40, shrink: float = 100.0, lo: float = 0.0, hi: float = 2.0) -> DataFrame:
    """Slope of residuals on x through the origin by group, shrunk towards the slope over all."""
    whole = df.agg((F.sum(F.col("x") * F.col("resid")) / F.sum(F.col("x") * F.col("x"))).alias("a0"), F.avg(F.col("x") * F.col("x")).alias("m2"))
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("resid")).alias("xr"), F.sum(F.col("x") * F.col("x")).alias("xx")).where(F.col("n") >= least)
    prior = shrink * F.col("m2")
    return g.join(F.broadcast(whole), how="left").select(by, "n", expr.clip((F.col("xr") + prior * F.col("a0")) / (F.col("xx") + prior), lo, hi).alias("slope"))


def flag_quality(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Confusion counts, precision, recall and F1 of flags."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    g = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return g.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def leave_own_out(df: DataFrame, by: str = "date", own: str = "aoi") -> DataFrame:
    """The mean of the other AOIs that day, from sums."""
    w = Window.partitionBy(by)
    mine = Window.partitionBy(by, own)
    s, n = F.sum("y").over(w) - F.coalesce(F.sum("y").over(mine), F.lit(0.0)), F.count("y").over(w) - F.count("y").over(mine)
    return df.withColumns({"others_n": n, "others_mean": F.when(n > 0, s / n)})


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, distinct values, mean, sample deviation, extremes and quartiles by group."""
    q = F.expr(f"percentile({value}, array(0.25D, 0.5D, 0.75D))")
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.count_distinct(value).alias("n_distinct"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return g.select(*by, "n", "n_distinct", "mean", "std", "min", *(F.col("q")[k].alias(c) for k, c in enumerate(("q25", "median", "q75"))), "max")


def fold_ridge(df: DataFrame, fold: str, features: list[str], target: str, alpha: float, most: float) -> DataFrame:
    """Per fold the ridge coefficients (no intercept, clipped) of target on features over the other folds' rows; missing features count 0.

    Sums by fold come from one pass; another fold's rows are all less its own.  A row a fold is solved on the driver.
    """
    cols = [F.coalesce(F.col(f), F.lit(0.0)) for f in features]
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = df.where(F.col(target).isNotNull()).groupBy(fold).agg(*(F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i, j in pairs), *(F.sum(c * F.col(target)).alias(f"r{i}") for i, c in enumerate(cols))).collect()
    gram = {r[fold]: np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for r in sums}
    right = {r[fold]: np.array([r[f"r{i}"] for i in range(k)]) for r in sums}
    g, r = sum(gram.values()), sum(right.values())
    rows = [(f, *(float(c) for c in np.clip(np.linalg.solve(g - gram[f] + alpha * np.eye(k), r - right[f]), -most, most))) for f in gram]
    kind = df.schema[fold].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, ", ".join([f"{fold} {kind}", *(f"c_{f} double" for f in features)]))


def fold_corrected(df: DataFrame, coefs: DataFrame, fold: str, base: str, features: list[str], lo: float = -0.5, hi: float = 1.2) -> DataFrame:
    """Rows with pred, the base and the correction by their fold's coefficients (see fold_ridge(); one row a fold, so broadcast)."""
    out = df.join(F.broadcast(coefs), fold)
    whole = sum((F.col(f"c_{f}") * F.coalesce(F.col(f), F.lit(0.0)) for f in features), F.lit(0.0))
    return out.withColumn("corrected", expr.clip(F.col(base) + whole, lo, hi)).drop(*(f"c_{f}" for f in features))


def ridge(df: DataFrame, features: list[str], target: str, alpha: float, most: float | None = None, intercept_alpha: float = 0.0, most_intercept: float | None = None) -> np.ndarray:
    """Intercept and coefficients from the Gram matrix, which is summed in Spark and solved on the driver; the intercept has a penalty and a bound of its own."""
    cols = [F.lit(1.0), *map(F.col, features)]
    fine = df.dropna(subset=[*features, target])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = fine.agg(*(F.sum(cols[i] * cols[j]) for i, j in pairs), *(F.sum(c * F.col(target)) for c in cols)).first()
    k = len(cols)
    gram, right = np.zeros((k, k)), np.array([x or 0.0 for x in row[len(pairs) :]], float)
    for (i, j), v in zip(pairs, row):
        gram[i, j] = gram[j, i] = v or 0.0
    gram += np.diag([intercept_alpha, *[alpha] * (k - 1)])
    coef = np.linalg.lstsq(gram, right, rcond=None)[0]
    if most is not None:
        coef[1:] = np.clip(coef[1:], -most, most)
    if most_intercept is not None:
        coef[0] = np.clip(coef[0], -most_intercept, most_intercept)
    return coef


def corrected(base: Column, coef: np.ndarray, features: list[str], lo: float = -0.2, hi: float = 1.1) -> Column:
    """Base plus the ridge correction; rows that miss a feature get the intercept alone."""
    whole = sum((float(c) * F.col(f) for c, f in zip(coef[1:], features)), F.lit(0.0))
    return expr.clip(base + float(coef[0]) + F.coalesce(whole, F.lit(0.0)), lo, hi)


def simplex_weights(df: DataFrame, candidates: list[str], target: str, anchor: float = 0.0, steps: int = 2000) -> np.ndarray:
    """Weights of blends, none negative, of sum 1, by projected gradient on the Gram matrix; anchor pulls to equal shares."""
    k = len(candidates)
    e = [F.col(c) - F.col(target) for c in candidates]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*(F.avg(e[i] * e[j]) for i, j in pairs)).first()
    g = np.zeros((k, k))
    for (i, j), v in zip(pairs, row):
        g[i, j] = g[j, i] = v
    g += anchor * np.eye(k)
    w, rate = np.full(k, 1 / k), 1 / max(np.linalg.eigvalsh(g).max(), 1e-12)
    for _ in range(steps):
        v = w - rate * (g @ w - anchor / k)
        u = np.sort(v)[::-1]
        c = np.cumsum(u) - 1
        r = np.flatnonzero(u - c / np.arange(1, k + 1) > 0)[-1]
        w = np.maximum(v - c[r] / (r + 1), 0)
    return w


def stratified_mask(df: DataFrame, by: list[str], key: Column, fraction: float, seed: int) -> DataFrame:
    """V2: at least one and about the given share of each group's rows, those with the smallest MD5 of seed and key."""
    token = F.md5(F.concat_ws(":", F.lit(str(seed)), key))
    w = Window.partitionBy(*by)
    quota = F.greatest(F.lit(1), F.bround(fraction * F.count("*").over(w)))
    return df.withColumn("_k", F.row_number().over(w.orderBy(token))).withColumn("masked", F.col("_k") <= quota).drop("_k")


def folds(df: DataFrame, by: list[str], key: Column, n: int = 5) -> DataFrame:
    """V4: fold 0 to n - 1 in MD5 order inside each group."""
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(key))) - 1) % n).cast("long"))


def project_fold(panel: DataFrame, year: int) -> DataFrame:
    """Rows of a year whose AOI and day some gap has lose their dynamic columns; the truth stays aside."""
    pattern = panel.where("gap").select("aoi", "doy").distinct().withColumn("hit", F.lit(True))
    hide = F.coalesce("hit", F.lit(False)) & (F.col("yr") == year) & F.col("y_true").isNotNull()
    out = panel.join(pattern, ["aoi", "doy"], "left").withColumn("hidden", hide).withColumn("_truth", F.col("y_true")).drop("hit")
    return out.select(*(F.when(~F.col("hidden"), F.col(c)).alias(c) if c in ("s2", "landsat", "modis", "y_true", "y") else F.col(c) for c in out.columns))


def contract(rows: DataFrame, keys: DataFrame, by: tuple[str, ...] = ("aoi", "date"), value: str = "pred") -> DataFrame:
    """V6: numbers of violations: missing, extra and repeated keys, and values that are not finite."""
    want, got = keys.select(*by).distinct().withColumn("_w", F.lit(1)), rows.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).alias("_bad"))
    both = want.join(got, list(by), "full_outer")
    return both.agg(F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("extra"), F.count_if(F.col("_n") > 1).alias("repeated"), F.sum(F.coalesce("_bad", F.lit(0))).alias("not_finite"))


def ordered_contract(rows: DataFrame, keys: DataFrame, columns: tuple[str, ...] = ("aoi", "date", "pred"), index: str = "k") -> DataFrame:
    """V6: one row of violations of a candidate table: its columns and their order (the index aside), dates that are none, rows out of place, repeated keys and values that are not finite.

    Rows and keys (aoi, date) carry their place in ``index``; the candidate's date and value may be texts.
    """
    aoi, date, value = columns
    own = rows.select(index, F.col(aoi).cast("string").alias("a"), F.col(date).cast("string").try_cast("date").alias("d"), F.col(value).cast("string").try_cast("double").alias("v"))
    want = keys.select(index, F.col("aoi").cast("string").alias("wa"), F.col("date").cast("date").alias("wd"), F.lit(True).alias("_w"))
    both = own.withColumn("_o", F.lit(True)).join(want, index, "full_outer")
    # Keys repeat as often as there are rows beyond their first.
    repeated = own.groupBy("a", "d").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("repeated"))
    placed = F.coalesce((F.col("a") == F.col("wa")) & (F.col("d") == F.col("wd")), F.lit(False))
    off = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    found = both.agg(
        F.lit(int([c for c in rows.columns if c != index] != list(columns))).cast("long").alias("wrong_columns"), F.count_if(F.col("_o") & F.col("d").isNull()).alias("bad_dates"),
        F.count_if(~placed).alias("misplaced"), F.count_if(F.col("_o") & off).alias("not_finite"),
    )
    return found.join(F.broadcast(repeated), how="left")


def weighted_sample(df: DataFrame, by: list[str], weight: Column, key: Column, n: int) -> DataFrame:
    """V9: n rows a group without replacement, by Efraimidis and Spirakis; the uniforms come from the key's hash."""
    u = (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 1) / (2**48 + 1)
    w = Window.partitionBy(*by).orderBy(-F.log(u) / weight)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def exact_mask(df: DataFrame, key: Column, fraction: float, seed: int) -> DataFrame:
    """V3: exactly floor(fraction n) rows of all are masked, those with the smallest MD5 of seed and key.

    4,096 counts by the first digits give the bucket where the quota ends; only its rows are ranked.
    """
    rows = df.withColumn("_t", F.md5(F.concat_ws(":", F.lit(str(seed)), key))).withColumn("_b", F.substring("_t", 1, 3))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    # At most 4,096 rows, so one partition of them is no bottleneck.
    before = counts.withColumns({"_before": F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"), "_quota": F.floor(fraction * F.sum("_n").over(Window.partitionBy()))})
    both = rows.join(F.broadcast(before), "_b")
    open_bucket = (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") > F.col("_quota"))
    settled = both.where(~open_bucket).withColumn("masked", F.col("_before") < F.col("_quota"))
    ranked = both.where(open_bucket).withColumn("masked", F.row_number().over(Window.partitionBy("_b").orderBy("_t")) + F.col("_before") <= F.col("_quota"))
    return settled.unionByName(ranked).drop("_t", "_b", "_n", "_before", "_quota")


def leave_part_out(rows: DataFrame, part: str, key: list[str], alpha: float = 1.0) -> DataFrame:
    """V5: per part the slope of resid on x through the origin over the other parts, and its error on the part.

    Rows whose key the part holds too are no training rows.  Sums over all, less those of the part's keys, give each fit in one pass.
    """
    slim = rows.select(part, *key, "x", "resid")
    keys = slim.groupBy(*key).agg(F.collect_set(part).alias("_parts"), F.count("*").alias("_n"), F.sum(F.col("x") * F.col("resid")).alias("_xr"), F.sum(F.col("x") * F.col("x")).alias("_xx"))
    mine = keys.select(F.explode("_parts").alias(part), "_n", "_xr", "_xx").groupBy(part).agg(*(F.sum(c).alias(f"_o{c}") for c in ("_n", "_xr", "_xx")))
    whole = keys.agg(*(F.sum(c).alias(f"_w{c}") for c in ("_n", "_xr", "_xx")))
    fit = mine.join(F.broadcast(whole), how="left").select(part, (F.col("_w_n") - F.col("_o_n")).alias("n_train"), ((F.col("_w_xr") - F.col("_o_xr")) / (F.col("_w_xx") - F.col("_o_xx") + alpha)).alias("slope"))
    test = slim.groupBy(part).agg(F.count("*").alias("n_test"), *(F.sum(a * b).alias(n) for n, a, b in (("_rr", F.col("resid"), F.col("resid")), ("_xr", F.col("x"), F.col("resid")), ("_xx", F.col("x"), F.col("x")))))
    mse = (F.col("_rr") - 2 * F.col("slope") * F.col("_xr") + F.col("slope") * F.col("slope") * F.col("_xx")) / F.col("n_test")
    return test.join(fit, part).select(part, "n_test", "n_train", "slope", F.sqrt(F.greatest(F.lit(0.0), mse)).alias("rmse"))
