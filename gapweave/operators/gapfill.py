"""Sensor calibration (A4), source posteriors (A5, A6), neighbours in time (J13) and local regression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..storage import saved

SENSORS = expr.SENSORS


def trimmed_affine(pairs: DataFrame, by: list[str], least: int, trim: float = 0.02) -> DataFrame:
    """A4: y = a + b x by group (columns x, y) on the inner 96 % of both axes.

    Under ``least`` pairs a group is left out, under 12 trimmed ones or without spread it
    is a shift of medians, and a slope over 3 gives the identity.
    """
    fine = pairs.where("x IS NOT NULL AND y IS NOT NULL AND abs(x) < 2 AND abs(y) < 2")
    q = lambda c: F.expr(f"percentile({c}, array({trim}, {1 - trim}))")
    edges = fine.groupBy(*by).agg(F.count("*").alias("n_all"), q("x").alias("qx"), q("y").alias("qy")).where(F.col("n_all") >= least)
    inner = fine.join(edges, by).where("x BETWEEN qx[0] AND qx[1] AND y BETWEEN qy[0] AND qy[1]")
    fit = inner.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"),
        (F.max("x") - F.min("x")).alias("spread"), F.median("x").alias("mx"), F.median("y").alias("my"),
    )
    flat = (F.col("n") < 12) | (F.col("spread") < 1e-8)
    wild = F.col("s").isNull() | (F.abs("s") > 3)
    a = F.when(flat, F.col("my") - F.col("mx")).when(wild, 0.0).otherwise(F.col("i"))
    return fit.select(*by, "n", a.alias("a"), F.when(flat | wild, 1.0).otherwise(F.col("s")).alias("b"))


def sensor_pairs(panel: DataFrame, width: int = 30) -> DataFrame:
    """Rows (target, source, bin, x, y) of two sensors on one AOI and day."""
    both = [F.struct(F.lit(t).alias("target"), F.lit(s).alias("source"), F.col(s).alias("x"), F.col(t).alias("y")) for t in SENSORS for s in SENSORS if s != t]
    rows = panel.where("NOT gap").select(expr.calibration_bin(F.col("doy"), width).alias("bin"), F.explode(F.array(*both)).alias("p")).select("bin", "p.*")
    return rows.where("x IS NOT NULL AND y IS NOT NULL")


def sensor_maps(panel: DataFrame, width: int = 30) -> DataFrame:
    """A4: (target, source, bin, a, b) from 30 pairs on by bin and, with a NULL bin, from 20 on over all; a few dozen rows."""
    pairs = sensor_pairs(panel, width)
    binned = trimmed_affine(pairs, ["target", "source", "bin"], 30)
    whole = trimmed_affine(pairs, ["target", "source"], 20).select("target", "source", F.lit(None).cast("long").alias("bin"), "n", "a", "b")
    return binned.unionByName(whole)


def posterior(panel: DataFrame, by: list[str], pseudo: float = 0.25) -> DataFrame:
    """A5: smoothed shares of the sensors among observed rows, by key."""
    seen = panel.where("y IS NOT NULL AND source <> 'none'")
    counts = [F.count_if(F.col("source") == s) + pseudo for s in SENSORS]
    return seen.groupBy(*by).agg(*((c / (F.count("*") + 3 * pseudo)).alias(f"p_{s}") for c, s in zip(counts, SENSORS)))


def query_posterior(queries: DataFrame, panel: DataFrame, date_weight: float = 1.0) -> DataFrame:
    """AOI and day of year, else crop and day, else day, else (.4, .4, .2), mixed with the date's own shares where it has some."""
    out = queries
    levels = [["aoi", "doy"], ["crop_type", "doy"], ["doy"], ["yr", "doy"]]
    for k, by in enumerate(levels):
        p = posterior(panel, by)
        out = out.join(p.select(*by, F.struct(*(f"p_{s}" for s in SENSORS)).alias(f"_{k}")), by, "left")
    prior = F.struct(*(F.lit(v).alias(f"p_{s}") for s, v in zip(SENSORS, (0.4, 0.4, 0.2))))
    base, date = F.coalesce(*(F.col(f"_{k}") for k in range(3)), prior), F.col("_3")
    mixed = [F.when(date.isNotNull(), (1 - date_weight) * base[f"p_{s}"] + date_weight * date[f"p_{s}"]).otherwise(base[f"p_{s}"]).alias(f"p_{s}") for s in SENSORS]
    return out.select(*queries.columns, *mixed)


def nearest(known: Column, at: Column, k: int = 8) -> Column:
    """Of an array of structs that ascends by their first field ``ord``, the k nearest to a day; ties by earlier day.

    Each gets its distance, ``far``, in front.  Nearest are among the k on either side, so only those are sorted.
    """
    before = F.size(F.filter(known, lambda x: x["ord"] < at))
    beside = F.slice(known, F.greatest(before - k + 1, F.lit(1)), F.lit(2 * k))
    return F.slice(F.sort_array(F.transform(beside, lambda x: F.struct(F.abs(x["ord"] - at).alias("far"), x.alias("row")))), 1, k)


def _quantile(v: Column, q: float) -> Column:
    """Of an ascending array, by linear interpolation."""
    at = (F.size(v) - 1) * q
    lo = F.floor(at).cast("int")
    return F.get(v, lo) + (at - lo) * (F.coalesce(F.get(v, lo + 1), F.get(v, lo)) - F.get(v, lo))


def local_linear(df: DataFrame, near: str, values: list[str], at: Column, lo: float = 0.05, margin: float = 0.04) -> DataFrame:
    """M1: for each value field of the neighbours (see nearest()) the intercept of a weighted line at the query, under the field's name.

    Weights 1 / (1 + 2 |z|) enter squared; one point gives its value, a degenerate line the
    weighted mean, and the result stays within the outer 5 % of the neighbours, 0.04 wider.
    All of it are closed sums over the row's own array.
    """
    far = F.greatest(F.lit(1.0), F.array_max(F.transform(near, lambda n: n["far"])).cast("double"))
    z = lambda n: (n["row"]["ord"] - at) / F.col("_far")
    points = F.transform(near, lambda n: F.struct(z(n).alias("z"), F.pow(1 / (1 + 2 * F.abs(z(n))), F.lit(2.0)).alias("w"), *(n["row"][v].alias(v) for v in values)))
    out = df.withColumn("_far", far).withColumn("_points", points)
    total = lambda f: F.aggregate("_points", F.lit(0.0), lambda s, p: s + f(p))
    times = lambda *names: lambda p: reduce(lambda a, b: a * b, [p[n] for n in names])
    sums = {"w": times("w"), "wz": times("w", "z"), "wzz": times("w", "z", "z")} | {f"wy_{v}": times("w", v) for v in values} | {f"wzy_{v}": times("w", "z", v) for v in values}
    out = out.withColumns({f"_{k}": total(f) for k, f in sums.items()} | {f"_o_{v}": F.sort_array(F.transform("_points", times(v))) for v in values})
    c = lambda k: F.col(f"_{k}")
    det = c("w") * c("wzz") - c("wz") * c("wz")
    made = {}
    for v in values:
        line = F.when(det > 1e-12, F.try_divide(c("wzz") * c(f"wy_{v}") - c("wz") * c(f"wzy_{v}"), det)).otherwise(F.try_divide(c(f"wy_{v}"), c("w")))
        made[v] = F.when(F.size("_points") > 0, F.greatest(_quantile(c(f"o_{v}"), lo) - margin, F.least(_quantile(c(f"o_{v}"), 1 - lo) + margin, line)))
    return out.withColumns(made).drop("_far", "_points", *(f"_{k}" for k in sums), *(f"_o_{v}" for v in values))


def calibrated(known: DataFrame, maps: DataFrame, width: int = 30) -> DataFrame:
    """Known rows with their value in each sensor's domain (v_s2, ...): by bin, else over all, else as it is."""
    by_target = lambda name: [F.max(F.when(F.col("target") == t, F.struct("a", "b"))).alias(f"_{name}_{t}") for t in SENSORS]
    # At most three sensors and thirteen bins.
    by_bin = F.broadcast(maps.where("bin IS NOT NULL").groupBy("source", "bin").agg(*by_target("b")))
    whole = F.broadcast(maps.where("bin IS NULL").groupBy("source").agg(*by_target("g")))
    rows = known.withColumn("bin", expr.calibration_bin(F.col("doy"), width)).join(by_bin, ["source", "bin"], "left").join(whole, "source", "left")
    mapped = lambda m: m["a"] + m["b"] * F.col("y")
    value = lambda t: F.when(F.col("source") == t, F.col("y")).otherwise(F.coalesce(mapped(F.col(f"_b_{t}")), mapped(F.col(f"_g_{t}")), F.col("y")))
    return rows.select(*known.columns, *(value(t).alias(f"v_{t}") for t in SENSORS))


def fill(panel: DataFrame, k: int = 8, width: int = 30) -> DataFrame:
    """Predictions (aoi, date, pred) for all gap rows.

    Known values are mapped into each sensor's domain, a local line over a row's neighbours
    gives that sensor's value, and the posterior mixes the three; without a neighbour that
    year the AOI's nearest observation stands in, then the global median.  A year's known
    values are one array, which its gap rows join; the panel's columns are saved first, as
    maps, posterior and neighbours all read them.
    """
    panel = saved(panel.select("aoi", "crop_type", "date", "yr", "doy", "ord", "source", "y", "gap", *SENSORS), "panel")
    known, queries = panel.where("y IS NOT NULL AND NOT gap"), panel.where("gap")
    values = [f"v_{s}" for s in SENSORS]
    years = calibrated(known, sensor_maps(panel, width), width).groupBy("aoi", "yr").agg(F.sort_array(F.collect_list(F.struct("ord", *values))).alias("known"))
    asked = query_posterior(queries.select("aoi", "crop_type", "date", "yr", "doy", "ord"), panel)
    near = asked.join(years, ["aoi", "yr"], "left").withColumn("near", nearest(F.col("known"), F.col("ord"), k)).drop("known")
    both = local_linear(near, "near", values, F.col("ord")).drop("near")
    part = lambda f: reduce(lambda a, b: a + b, [F.when(F.col(f"v_{s}").isNotNull(), f(s)).otherwise(0.0) for s in SENSORS])
    mixed = F.try_divide(part(lambda s: F.col(f"p_{s}") * F.col(f"v_{s}")), part(lambda s: F.col(f"p_{s}")))
    w = Window.partitionBy("aoi").orderBy("ord")
    seen = F.struct(F.col("ord").alias("o"), F.col("y").alias("v"))
    line = panel.select("aoi", "date", "ord", "y", "gap").withColumns({
        "prev": F.last(F.when(F.col("y").isNotNull() & ~F.col("gap"), seen), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.first(F.when(F.col("y").isNotNull() & ~F.col("gap"), seen), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    }).where("gap")
    closer = F.when(F.col("prev").isNull() | (F.col("next")["o"] - F.col("ord") < F.col("ord") - F.col("prev")["o"]), F.col("next")["v"]).otherwise(F.col("prev")["v"])
    middle = known.agg(F.median("y").alias("middle"))
    out = both.join(line.select("aoi", "date", closer.alias("closer")), ["aoi", "date"]).join(F.broadcast(middle), how="left")
    return out.select("aoi", "date", expr.clip(F.coalesce(mixed, "closer", "middle", F.lit(0.3)), -0.5, 1.2).alias("pred"))


def weighted_posterior(queries: DataFrame, panel: DataFrame, width: int = 8) -> DataFrame:
    """Shares of the sensors at four grains, each weighted by its factor and the root of its count: date 8, AOI and day 3, day 1, AOI and bin 1.

    Without any count the prior (.4, .4, .2) stands.  The grains are small tables by key, joined on from coarse data.
    """
    by_bin = lambda df: df.withColumn("bin", expr.calibration_bin(F.col("doy"), width))
    seen, out = by_bin(panel.where("y IS NOT NULL AND source <> 'none'")), by_bin(queries)
    grains = [(["yr", "doy"], 8.0), (["aoi", "doy"], 3.0), (["doy"], 1.0), (["aoi", "bin"], 1.0)]
    for k, (by, _) in enumerate(grains):
        counts = seen.groupBy(*by).agg(F.struct(F.count("*").alias("n"), *(F.count_if(F.col("source") == s).alias(s) for s in SENSORS)).alias(f"_{k}"))
        out = out.join(counts, by, "left")
    weight = [F.coalesce(f * F.sqrt(F.col(f"_{k}")["n"]), F.lit(0.0)) for k, (_, f) in enumerate(grains)]
    total = reduce(lambda a, b: a + b, weight)
    share = lambda s: reduce(lambda a, b: a + b, [w * F.coalesce(F.col(f"_{k}")[s] / F.col(f"_{k}")["n"], F.lit(0.0)) for k, w in enumerate(weight)])
    return out.select(*queries.columns, *(F.when(total > 0, share(s) / total).otherwise(p).alias(f"p_{s}") for s, p in zip(SENSORS, (0.4, 0.4, 0.2))))


def expected_correction(queries: DataFrame, residuals: DataFrame) -> DataFrame:
    """The sum over sensors of their posterior (p_s2, ...) times the mean residual of their rows (source, resid)."""
    means = residuals.agg(*(F.coalesce(F.avg(F.when(F.col("source") == s, F.col("resid"))), F.lit(0.0)).alias(f"_c_{s}") for s in SENSORS))
    total = reduce(lambda a, b: a + b, [F.col(f"p_{s}") * F.col(f"_c_{s}") for s in SENSORS])
    return queries.join(F.broadcast(means), how="left").withColumn("correction", total).drop(*(f"_c_{s}" for s in SENSORS))
