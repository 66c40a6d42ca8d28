"""Leakage-safe historical norms (J6, A7) and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..storage import saved

#: Levels behind the AOI's own history, in order.
WIDER = (("crop_type",), ())
YEAR = 366


def _middle(v: Column) -> Column:
    """The median of an ascending array; NULL of an empty one."""
    n = F.size(v)
    return F.when(n > 0, (F.get(v, ((n - 1) / 2).cast("int")) + F.get(v, (n / 2).cast("int"))) / 2)


def _scaled(mad: Column, floor: float) -> Column:
    return F.greatest(1.4826 * mad, F.lit(floor))


def _own_level(panel: DataFrame, window: int, least: int, floor: float) -> DataFrame:
    """The panel with _0: the AOI's own norm, NULL under ``least`` values.

    One sort by AOI and day of year: a row's frame are all years' values near its day, of
    which the earlier years' are picked inside the array.  Days near the year's end come a
    second time beyond it, so the frame goes round.  The calendar bounds a frame.
    """
    if window >= YEAR // 2:
        raise ValueError("the window has to be under half a year")
    doy = F.col("doy")
    places = F.when(doy <= window, F.array(doy, doy + YEAR)).when(doy > YEAR - window, F.array(doy, doy - YEAR)).otherwise(F.array(doy))
    frame = Window.partitionBy("aoi").orderBy("_at").rangeBetween(-window, window)
    seen = F.collect_list(F.when(F.col("y").isNotNull(), F.struct("yr", "y"))).over(frame)
    rows = panel.withColumn("_at", F.explode(places)).withColumn("_h", seen).where(F.col("_at") == doy)
    rows = rows.withColumn("_h", F.filter("_h", lambda x: x["yr"] < F.col("yr"))).withColumn("_v", F.sort_array(F.transform("_h", lambda x: x["y"])))
    rows = rows.withColumns({"_n": F.size("_v").cast("long"), "_m": _middle(F.col("_v")), "_k": F.size(F.array_distinct(F.transform("_h", lambda x: x["yr"]))).cast("long")})
    mad = _middle(F.sort_array(F.transform("_v", lambda x: F.abs(x - F.col("_m")))))
    rows = rows.withColumn("_d", F.when((F.col("_n") >= least) & F.col("aoi").isNotNull(), mad))
    norm = F.struct(F.col("_m").alias("clim_mean"), _scaled(F.col("_d"), floor).alias("clim_std"), F.col("_n").alias("clim_n"), F.col("_k").alias("clim_years"))
    return rows.select(*panel.columns, F.when(F.col("_d").isNotNull(), norm).alias("_0"))


def _wider_level(open_keys: DataFrame, history: DataFrame, level: tuple[str, ...], window: int, least: int, floor: float) -> DataFrame:
    """Norms of a level that the input's width is behind, by key: medians over counted values, for open keys only.

    The circular band becomes an equi-join: each key goes to its 2 window + 1 days.
    """
    by = [*level, "yr", "doy"]
    near = open_keys.select(*by).distinct().withColumn("hdoy", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("hdoy", F.pmod(F.col("doy") - 1 + F.col("hdoy"), F.lit(YEAR)) + 1)
    hist = history.groupBy(*level, F.col("yr").alias("hyr"), F.col("doy").alias("hdoy"), "y").agg(F.count("*").alias("k"))
    pairs = near.join(hist, [*level, "hdoy"]).where("hyr < yr")
    mid = pairs.groupBy(*by).agg(F.expr("percentile(y, 0.5, k)").alias("clim_mean"), F.sum("k").alias("clim_n"), F.count_distinct("hyr").alias("clim_years")).where(F.col("clim_n") >= least)
    mad = pairs.join(mid, by).groupBy(*by).agg(F.expr("percentile(abs(y - clim_mean), 0.5, k)").alias("mad"))
    return mid.join(mad, by).select(*by, F.struct("clim_mean", _scaled(F.col("mad"), floor).alias("clim_std"), "clim_n", "clim_years").alias("_w"))


def climatology(panel: DataFrame, window: int = 15, min_samples: int = 3, floor: float = 0.03, wider: tuple = WIDER) -> DataFrame:
    """The panel with clim_mean, clim_std, clim_n, clim_years, clim_se and clim_source.

    History are observed values (y) of strictly earlier years.  The AOI's own comes first,
    then its crop's, then all; the first with min_samples values wins.  The AOI level is
    saved, as wider levels are computed from it and only for what it leaves open.
    """
    own = saved(_own_level(panel, window, min_samples, floor), "climatology")
    history, open_keys = own.where("y IS NOT NULL").select("aoi", "crop_type", "yr", "doy", "y"), own.where("_0 IS NULL")
    names = {("crop_type",): "crop_historical", (): "global_historical"}
    out = own.withColumn("clim_source", F.when(F.col("_0").isNotNull(), "aoi_historical"))
    for level in wider:
        got = _wider_level(open_keys, history, level, window, min_samples, floor)
        open_row = F.col("_0").isNull() & F.col("_w").isNotNull()
        out = out.join(got, [*level, "yr", "doy"], "left").withColumns({"clim_source": F.when(open_row, names[level]).otherwise(F.col("clim_source")), "_0": F.coalesce("_0", "_w")}).drop("_w")
    cols = [F.col("_0")[c].alias(c) for c in ("clim_mean", "clim_std", "clim_n", "clim_years")]
    return out.select(*panel.columns, *cols, (F.col("_0")["clim_std"] / F.sqrt(F.col("_0")["clim_n"])).alias("clim_se"), F.coalesce("clim_source", F.lit("unavailable")).alias("clim_source"))


def anomalies(panel: DataFrame, value: Column | None = None, **options) -> DataFrame:
    """Climatology, z, status, outliers and provenance; value (default y) is what is judged."""
    out = climatology(panel, **options).withColumn("value", value if value is not None else F.col("y"))
    out = out.withColumn("z", F.try_divide(F.col("value") - F.col("clim_mean"), F.col("clim_std")))
    return out.withColumns({"status": expr.status(F.col("z")), "provenance": expr.provenance(F.col("y"), F.col("value")), **expr.outliers(F.col("value"), F.col("z"))})


def periods(rows: DataFrame) -> DataFrame:
    """Runs of stress days of one status; a gap of over one calendar day or another status starts a new run.

    Input: aoi, date, status, z, provenance and, for the weather label, temp_c and precip_mm.
    """
    w = Window.partitionBy("aoi").orderBy("date")
    stress = rows.where(F.col("status").isin("suppression", "critical"))
    new = F.coalesce(((F.datediff("date", F.lag("date").over(w)) > 1) | (F.col("status") != F.lag("status").over(w))).cast("int"), F.lit(1))
    runs = stress.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dry, hot = F.coalesce(F.avg("precip_mm") < 1, F.lit(False)), F.coalesce(F.avg("temp_c") > 30, F.lit(False))
    return runs.groupBy("aoi", "run", "status").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n_days"), F.avg("z").alias("mean_z"), F.min("z").alias("min_z"),
        F.count_if(F.col("provenance") == "observed").alias("n_observed"), F.count_if(F.col("provenance") == "reconstructed").alias("n_reconstructed"),
        F.when(F.min("z") < -3.5, "critical").when(F.min("z") < -2.75, "high").otherwise("moderate").alias("severity"),
        F.when(dry & hot, "dry_and_hot_context").when(dry, "dry_context").when(hot, "hot_context").otherwise("weather_unavailable_or_unusual").alias("weather"),
    ).drop("run")


def region_summary(rows: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """A1, A2: counts, coverage and mean z by AOI, and the number of runs."""
    out = rows.groupBy("aoi").agg(
        F.count("*").alias("n_rows"), *(F.count_if(F.col("provenance") == p).alias(p) for p in ("observed", "reconstructed", "missing")),
        F.avg(F.col("z").isNotNull().cast("int")).alias("coverage"), F.count_if(F.col("status").isin("suppression", "critical")).alias("anomaly_n"),
        F.count_if(F.col("status") == "critical").alias("critical_n"), F.avg("z").alias("mean_z"),
    )
    if runs is None:
        return out
    return out.join(runs.groupBy("aoi").agg(F.count("*").alias("n")), "aoi", "left").withColumn("periods_n", F.coalesce("n", F.lit(0))).drop("n")


def radar(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """An explainable risk score by AOI, highest first."""
    s = rows.groupBy("aoi").agg(
        F.avg((F.col("status") == "critical").cast("int")).alias("crit"), F.avg((F.col("status") == "suppression").cast("int")).alias("supp"),
        F.avg("z").alias("mean_z"), F.avg((F.col("provenance") == "reconstructed").cast("int")).alias("recon"), F.avg(F.col("z").isNotNull().cast("int")).alias("cov"),
    )
    r = runs.groupBy("aoi").agg(F.max("n_days").alias("max_days"), F.count("*").alias("runs"))
    both = s.join(r, "aoi", "left").withColumns({"max_days": F.coalesce("max_days", F.lit(0)), "runs": F.coalesce("runs", F.lit(0))})
    part = {
        "low_z": expr.clip(F.coalesce(-F.col("mean_z"), F.lit(0.0)) / 3, 0, 1), "critical": F.col("crit"), "suppression": F.col("supp"),
        "persistence": expr.clip(F.col("max_days") / 14, 0, 1), "uncertainty": expr.clip(0.55 * F.col("recon") + 0.45 * (1 - F.col("cov")), 0, 1),
    }
    weights = (0.35, 0.25, 0.15, 0.15, 0.10)
    score = sum((w * p for w, p in zip(weights[1:], list(part.values())[1:])), weights[0] * part["low_z"])
    ranked = F.sort_array(F.array(*(F.struct((-p).alias("v"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, (n, p) in enumerate(part.items()))))
    top = F.array_join(F.transform(F.filter(F.slice(ranked, 1, 2), lambda x: x["v"] < -0.05), lambda x: x["name"]), ", ")
    out = both.withColumns({"risk_score": F.bround(100 * score, 1), "factors": F.when(top == "", "stable").otherwise(top)})
    return out.withColumn("risk_level", expr.cut(F.col("risk_score"), [20, 50], ["low", "medium", "high"])).orderBy(F.desc("risk_score"), "aoi")
