"""Sequence operators over one AOI and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import correlation
from .joins import near_ids

BY = ("aoi", "yr")


def _order(by: tuple[str, ...] = BY, order: str = "ord"):
    return Window.partitionBy(*by).orderBy(order)


def neighbours(df: DataFrame, y: str = "y") -> DataFrame:
    """Previous and next known values and days, the line between, its slope, and the gap's geometry; the row itself is not its own neighbour."""
    s = F.when(F.col(y).isNotNull(), F.struct(F.col("ord").alias("o"), F.col(y).alias("v")))
    out = df.withColumns({
        "_p": F.last(s, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)),
        "_n": F.first(s, ignorenulls=True).over(_order().rowsBetween(1, Window.unboundedFollowing)),
    })
    left, right = F.col("ord") - F.col("_p")["o"], F.col("_n")["o"] - F.col("ord")
    slope = (F.col("_n")["v"] - F.col("_p")["v"]) / (F.col("_n")["o"] - F.col("_p")["o"])
    return out.withColumns({
        "prev_y": F.col("_p")["v"], "next_y": F.col("_n")["v"], "left_days": left, "right_days": right, "slope": slope,
        "lerp": F.coalesce(F.col("_p")["v"] + slope * left, F.col("_p")["v"], F.col("_n")["v"]), "gap_days": F.least(left, right), "bracket": left + right, "edge": left.isNull() | right.isNull(),
    }).drop("_p", "_n")


def hidden_runs(df: DataFrame, hidden: str = "gap") -> DataFrame:
    """Length of the run of consecutive hidden days that a hidden row is part of."""
    own = df.where(F.col(hidden))
    own = own.withColumn("_new", F.coalesce((F.col("ord") - F.lag("ord").over(_order()) != 1).cast("int"), F.lit(1)))
    own = own.withColumn("_run", F.sum("_new").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    return own.withColumn("run_len", F.count("*").over(Window.partitionBy(*BY, "_run"))).drop("_new", "_run")


def rolling(df: DataFrame, columns: list[str], widths: tuple[int, ...] = (3, 7, 14), centered: bool = True) -> DataFrame:
    """Mean, sum and sample deviation over a number of rows, centred (even widths reach one row further back) or causal."""
    made = {}
    for w in widths:
        frame = _order().rowsBetween(-(w // 2), w - 1 - w // 2) if centered else _order().rowsBetween(1 - w, 0)
        for c in columns:
            made |= {f"{c}_mean_{w}": F.avg(c).over(frame), f"{c}_sum_{w}": F.sum(c).over(frame), f"{c}_std_{w}": F.stddev_samp(c).over(frame)}
    return df.withColumns(made)


def cumulative(df: DataFrame) -> DataFrame:
    """Growing degree days above 5 and rain since the year began."""
    frame = _order().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"gdd": F.sum(F.greatest(F.col("temp_c") - 5, F.lit(0.0))).over(frame), "rain": F.sum("precip_mm").over(frame)})


def within_days(df: DataFrame, days: tuple[int, ...] = (7, 14, 30, 60, 120), y: str = "y") -> DataFrame:
    """Number and sum of other known values within so many days."""
    made = {}
    for d in days:
        frame = _order().rangeBetween(-d, d)
        made |= {f"n_{d}": F.count(y).over(frame) - F.col(y).isNotNull().cast("int"), f"sum_{d}": F.coalesce(F.sum(y).over(frame), F.lit(0.0)) - F.coalesce(F.col(y), F.lit(0.0))}
    return df.withColumns(made)


def differences(df: DataFrame, y: str = "y") -> DataFrame:
    """The value before among known ones, the difference and the jump per day."""
    own = df.where(F.col(y).isNotNull())
    d = F.col(y) - F.lag(y).over(_order())
    return own.withColumns({"lag_y": F.lag(y).over(_order()), "diff": d, "per_day": d / (F.col("ord") - F.lag("ord").over(_order()))})


def robust_z(df: DataFrame, by: list[str], y: str = "y", floor: float = 0.03) -> DataFrame:
    """Deviation from the group's median in units of its scaled MAD."""
    mid = df.groupBy(*by).agg(F.median(y).alias("_m"))
    both = df.join(mid, by)
    mad = both.groupBy(*by).agg(F.median(F.abs(F.col(y) - F.col("_m"))).alias("_d"))
    return both.join(mad, by).withColumn("robust_z", (F.col(y) - F.col("_m")) / F.greatest(F.lit(floor), 1.4826 * F.col("_d"))).drop("_m", "_d")


def calendar(df: DataFrame, y: str = "y") -> DataFrame:
    """Every day 1 to 366 of each AOI and year that has a value, linearly interpolated, held at the edges; repeated days averaged."""
    known = df.where(F.col(y).isNotNull()).groupBy(*BY, "doy").agg(F.avg(y).alias("y"))
    grid = known.select(*BY).distinct().withColumn("doy", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(366).cast("long"))))
    w = _order(order="doy")
    s = F.when(F.col("y").isNotNull(), F.struct(F.col("doy").alias("o"), F.col("y").alias("v")))
    out = grid.join(known, [*BY, "doy"], "left").withColumns({
        "_p": F.last(s, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.first(s, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    p, n = F.col("_p"), F.col("_n")
    line = F.when(n["o"] > p["o"], p["v"] + (n["v"] - p["v"]) * (F.col("doy") - p["o"]) / (n["o"] - p["o"]))
    return out.select(*BY, "doy", F.coalesce(line, p["v"], n["v"]).alias("y"))


def quartile_of_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Quartile of the row's place in order."""
    return df.withColumn("quartile", F.ntile(4).over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def smooth_factor(df: DataFrame, at: str, value: str, sigma: float = 3.0, reach: int = 9) -> DataFrame:
    """Gaussian mean over days; the band is an equi-join on shifted days."""
    near = df.select(F.col(at).alias("_o"), F.col(value).alias("_v")).withColumn("_s", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).select((F.col("_o") + F.col("_s")).alias(at), F.exp(-F.col("_s") * F.col("_s") / (2 * sigma * sigma)).alias("_w"), "_v")
    return df.select(at).join(near, at).groupBy(at).agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("smooth"))


def autocorrelation(df: DataFrame, lags: tuple[int, ...] = (1, 2, 3, 4, 5, 7, 8, 16, 32), least: int = 20, y: str = "y") -> DataFrame:
    """Correlation of values exactly so many days apart, and the number of pairs."""
    own = df.where(F.col(y).isNotNull()).select("aoi", "ord", F.col(y).alias("a"))
    later = own.select("aoi", F.explode(F.array(*(F.struct((F.col("ord") - k).alias("ord"), F.lit(k).cast("long").alias("lag")) for k in lags))).alias("s"), F.col("a").alias("b")).select("aoi", "s.*", "b")
    return own.join(later, ["aoi", "ord"]).groupBy("lag").agg(F.count("*").alias("n"), correlation(F.col("a"), F.col("b")).alias("r")).where(F.col("n") >= least)


def loo_residual(df: DataFrame) -> DataFrame:
    """Known rows between two neighbours with resid, their distance from the line that leaves them out."""
    return neighbours(df).where("y IS NOT NULL AND NOT edge").withColumn("resid", F.col("y") - F.col("lerp"))


def shock(resid: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Median by group (date, with crop or source) of each AOI's own median, and the number of AOIs, at least three."""
    own = resid.groupBy(*by, "aoi").agg(F.median("resid").alias("r"))
    return own.groupBy(*by).agg(F.median("r").alias("shock"), F.count("*").alias("n_aoi")).where(F.col("n_aoi") >= least)


def near_shock(queries: DataFrame, resid: DataFrame, reach: int = 8, sigma: float = 3.5, least: int = 3, tail: float = 0.1, ids: int = 8) -> DataFrame:
    """Per query row (aoi, num, ord) the Gaussian mean of the residuals of other AOIs, at most ``ids`` apart, within some days, winsorised at their weighted 10 and 90 %.

    Both bands are equi-joins, on shifted days and ids, so AOIs of a date never meet in all pairs.
    """
    other = near_ids(resid.select("num", F.col("aoi").alias("p_aoi"), F.col("resid").alias("r"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("s"), F.col("ord").alias("o")), ids)
    other = other.select("num", "p_aoi", "r", (F.col("o") + F.col("s")).alias("ord"), F.exp(-0.5 * F.pow(F.col("s") / sigma, 2)).alias("w"))
    pairs = queries.select("aoi", "num", "ord").join(other, ["num", "ord"])
    by = Window.partitionBy("aoi", "ord")
    up = pairs.withColumns({"c": F.sum("w").over(by.orderBy("r", "p_aoi", "w").rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum("w").over(by)})
    edge = lambda q: F.min(F.when(F.col("c") >= q * F.col("whole"), F.col("r"))).over(by)
    cut = up.withColumns({"lo": edge(tail), "hi": edge(1 - tail)})
    value = F.greatest("lo", F.least("hi", "r"))
    return cut.groupBy("aoi", "ord").agg((F.sum(F.col("w") * value) / F.sum("w")).alias("shock_near"), F.count("*").alias("n")).where(F.col("n") >= least)


def residual_correlation(df: DataFrame, item: str, at: list[str], value: str, reach: int = 8, least: int = 30) -> DataFrame:
    """Correlation of a value between two items (AOI numbers, years) at most ``reach`` apart, over what they have in common, from so many pairs on.

    ``at`` names what makes two values a pair (a date, or AOI and day); repeated ones are averaged.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(item, *at).agg(F.avg(value).alias("x"))
    ahead = own.select(*at, F.explode(F.array(*(F.col(item) - d for d in range(1, reach + 1)))).alias(item), F.col(item).alias("other"), F.col("x").alias("y"))
    both = own.join(ahead, [item, *at])
    return both.groupBy(item, "other").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("r")).where(F.col("n") >= least)


def distance_means(df: DataFrame, y: str = "y", k: int = 3, reach: int = 120, tau: float = 30.0) -> DataFrame:
    """Per row the inverse-distance mean of its k nearest other known values of the AOI and year, and mean, deviation and number of those within some days, weighted by exp(-days / tau).

    A year's known values are one array, which its rows join; ties of distance go to the earlier day.
    """
    own = df.where(F.col(y).isNotNull()).groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("o"), F.col(y).alias("v")))).alias("_k"))
    far = lambda x: F.abs(x["o"] - F.col("ord"))
    rows = df.join(own, list(BY), "left").withColumn("_k", F.filter("_k", lambda x: x["o"] != F.col("ord")))
    ranked = F.sort_array(F.transform("_k", lambda x: F.struct(far(x).alias("d"), x["o"].alias("o"), x["v"].alias("v"))))
    rows = rows.withColumns({"_n": F.slice(ranked, 1, k), "_w": F.transform(F.filter("_k", lambda x: far(x) <= reach), lambda x: F.struct(F.exp(-far(x) / tau).alias("w"), x["v"].alias("v")))})
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x))
    rows = rows.withColumns({"_s": total("_w", lambda x: x["w"]), "decay_n": F.coalesce(F.size("_w"), F.lit(0)).cast("long")})
    rows = rows.withColumn("decay_mean", F.try_divide(total("_w", lambda x: x["w"] * x["v"]), F.col("_s")))
    rows = rows.withColumn("decay_std", F.sqrt(F.try_divide(total("_w", lambda x: x["w"] * F.pow(x["v"] - F.col("decay_mean"), F.lit(2.0))), F.col("_s"))))
    return rows.withColumn("idw", F.try_divide(total("_n", lambda x: x["v"] / x["d"]), total("_n", lambda x: 1 / x["d"]))).drop("_k", "_n", "_w", "_s")


def state(pairs: DataFrame, by: list[str], days: Column, resid: Column, tau: float = 45.0, reach: int = 120, k: int = 8) -> DataFrame:
    """Exponentially weighted mean of the k nearest residuals within the reach, clipped; two are required."""
    w = Window.partitionBy(*by).orderBy(days, "k_ord")
    own = pairs.where(days <= reach).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).withColumn("_w", F.exp(-days / tau))
    clipped = F.greatest(F.lit(-0.3), F.least(F.lit(0.3), resid))
    return own.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(F.col("_w") * clipped) / F.sum("_w")).alias("state")).where("n >= 2")
