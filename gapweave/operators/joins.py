"""Keyed, temporal and neighbour joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILL_MODES = ("fill_null", "overwrite_gap", "null_and_gap")


def keyed_fill(panel: DataFrame, predictions: DataFrame, mode: str, by: tuple[str, ...] = ("aoi", "date")) -> DataFrame:
    """Y from pred where y is NULL, where the row is a gap, or where both hold; of repeated predictions the smallest counts."""
    if mode not in FILL_MODES:
        raise ValueError(f"mode is one of {FILL_MODES}")
    one = predictions.groupBy(*by).agg(F.min("pred").alias("pred"))
    cond = {"fill_null": F.col("y").isNull(), "overwrite_gap": F.col("gap"), "null_and_gap": F.col("y").isNull() & F.col("gap")}[mode]
    return panel.join(one, list(by), "left").withColumn("filled", F.when(cond, F.col("pred")).otherwise(F.col("y")))


def first_rows(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row a key: the first in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def with_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """Temperature and rain by date, first row of a date; the panel's own columns of these names go."""
    one = first_rows(weather.select("date", "temp_c", "precip_mm"), ["date"], ["temp_c", "precip_mm"])
    return panel.drop("temp_c", "precip_mm").join(one, "date", "left")


def outer_with_indicator(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """A full outer join and _merge, which is left_only, right_only or both."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), by, "full_outer")
    return both.withColumn("_merge", F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")).drop("_l", "_r")


def validated_left(left: DataFrame, right: DataFrame, by: list[str], validate: str = "one_to_one") -> DataFrame:
    """A left join after a check that keys are unique on the right (and on the left, for one_to_one)."""
    for side, df in (("right", right), *((("left", left),) if validate == "one_to_one" else ())):
        if df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise ValueError(f"keys {by} repeat on the {side}")
    return left.join(right, by, "left")


def near_ids(rows: DataFrame, reach: int, num: str = "num") -> DataFrame:
    """Rows once for each other id at most ``reach`` away, under that id: neighbours then meet by an equi-join, never by all pairs of a date."""
    return rows.withColumn(num, F.explode(F.array(*(F.col(num) + d for d in range(-reach, reach + 1) if d))))


def same_date_peers(panel: DataFrame, radii: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Per row, the number and mean of other AOIs' values that day within each id distance; rows without any have no result.

    An equi-join on date and id; one aggregation serves all radii.
    """
    peer = near_ids(panel.where("y IS NOT NULL").select("date", "num", F.col("num").alias("p_num"), F.col("y").alias("p_y")), max(radii))
    far = F.abs(F.col("num") - F.col("p_num"))
    pairs = panel.select("aoi", "num", "date").join(peer, ["date", "num"])
    stats = [a for r in radii for a in (F.count_if(far <= r).alias(f"n_{r}"), F.avg(F.when(far <= r, F.col("p_y"))).alias(f"mean_{r}"))]
    return pairs.groupBy("aoi", "date").agg(*stats)


_SUMS = {"n": ("1", "1"), "x": ("x", "1"), "y": ("y", "1"), "xx": ("x", "x"), "xy": ("x", "y"), "yy": ("y", "y")}


def _affine(s) -> tuple[Column, Column, Column]:
    """Intercept, slope and the spread of x from sums; flat at the mean without spread."""
    vx = s("xx") - F.try_divide(s("x") * s("x"), s("n"))
    b = F.when(vx > 1e-12 * s("n"), F.try_divide(s("xy") - F.try_divide(s("x") * s("y"), s("n")), vx)).otherwise(0.0)
    return F.try_divide(s("y") - b * s("x"), s("n")), b, vx


def pair_fits(panel: DataFrame, reach: int = 8, least: int = 6) -> DataFrame:
    """Ordered AOI pairs of a year, at most ``reach`` apart in id, fitted y = a + b x over common dates, with their cross-validated error.

    Dates fall in turn into two to five folds; a fold's error comes from the line of the other
    folds, whose sums are those of all less its own.  Pairs need six dates, spread in x, and
    errors of half of them, from lines of four dates or more.
    """
    own = panel.where("y IS NOT NULL").select("yr", "date", "ord", "num", "aoi", "y")
    peers = near_ids(own.select("yr", "date", "num", F.col("aoi").alias("peer"), F.col("y").alias("x")), reach)
    by = ["yr", "aoi", "peer"]
    pair = Window.partitionBy(*by)
    rows = own.join(peers, ["yr", "date", "num"]).withColumns({"_n": F.count("*").over(pair), "_r": F.row_number().over(pair.orderBy("ord"))}).where(F.col("_n") >= least)
    folds = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("_n") / 5)))
    value = {"1": F.lit(1.0), "x": F.col("x"), "y": F.col("y")}
    own_sums = rows.groupBy(*by, ((F.col("_r") - 1) % folds).alias("fold")).agg(*(F.sum(value[i] * value[j]).alias(f"f_{k}") for k, (i, j) in _SUMS.items()))
    both = own_sums.withColumns({f"w_{k}": F.sum(f"f_{k}").over(pair) for k in _SUMS})
    f, w = (lambda k: F.col(f"f_{k}")), (lambda k: F.col(f"w_{k}"))
    a, b, _ = _affine(lambda k: w(k) - f(k))
    judged = w("n") - f("n") >= 4
    both = both.withColumns({"_a": F.when(judged, a), "_b": F.when(judged, b)})
    a, b = F.col("_a"), F.col("_b")
    sse = f("yy") - 2 * a * f("y") - 2 * b * f("xy") + f("n") * a * a + 2 * a * b * f("x") + b * b * f("xx")
    fit = both.groupBy(*by).agg(F.sum(sse).alias("sse"), F.sum(F.when(judged, f("n"))).alias("seen"), *(F.first(w(k)).alias(f"w_{k}") for k in _SUMS))
    a, b, vx = _affine(w)
    fit = fit.where((vx > 1e-12 * w("n")) & (F.col("seen") >= F.greatest(F.lit(4.0), F.floor(w("n") / 2))))
    return fit.select(*by, w("n").cast("long").alias("n"), a.alias("a"), b.alias("b"), F.sqrt(F.greatest(F.lit(0.0), F.col("sse") / F.col("seen"))).alias("cv_rmse"))


def peer_predict(queries: DataFrame, panel: DataFrame, k: int = 3, reach: int = 8) -> DataFrame:
    """For gap rows the weighted mean of that day's mapped values of the k peers with the smallest cross-validated error; ties go to more dates, then by name."""
    fits = pair_fits(panel, reach)
    seen = panel.where("y IS NOT NULL").select("date", F.col("aoi").alias("peer"), F.col("y").alias("x"))
    cand = queries.select("aoi", "yr", "date").join(fits, ["aoi", "yr"]).join(seen, ["date", "peer"])
    w = Window.partitionBy("aoi", "date").orderBy(F.round("cv_rmse", 10), F.desc("n"), "peer")
    best = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    weight = F.least(F.lit(1.0), F.col("n") / 24) / (F.col("cv_rmse") * F.col("cv_rmse") + 0.0009)
    return best.groupBy("aoi", "date").agg((F.sum(weight * (F.col("a") + F.col("b") * F.col("x"))) / F.sum(weight)).alias("pred"), F.count("*").alias("n_peers"))


def as_of(rows: DataFrame, observed: Column, value: Column, by: list[str], order: str = "ord", tolerance: int = 90, strict: bool = True) -> DataFrame:
    """The nearer of the last and the next observed value within the tolerance; ties go back.  One window each way, no join."""
    w = Window.partitionBy(*by).orderBy(order)
    s = F.when(observed, F.struct(F.col(order).alias("o"), value.alias("v")))
    step = 1 if strict else 0
    both = rows.withColumns({
        "_p": F.last(s, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -step)),
        "_n": F.first(s, ignorenulls=True).over(w.rowsBetween(step, Window.unboundedFollowing)),
    })
    back, ahead = F.col(order) - F.col("_p")["o"], F.col("_n")["o"] - F.col(order)
    b = F.when(back <= tolerance, back)
    a = F.when(ahead <= tolerance, ahead)
    pick = F.when(b.isNotNull() & (a.isNull() | (b <= a)), F.col("_p")["v"]).when(a.isNotNull(), F.col("_n")["v"])
    return both.withColumns({"as_of": pick, "as_of_days": F.least(a, b)}).drop("_p", "_n")


def cascade(rows: DataFrame, tables: list[tuple[list[str], DataFrame]], value: str, default: float | None = None) -> DataFrame:
    """Left joins to grouped tables from fine to coarse; the first value that is there wins."""
    out = rows
    for k, (by, t) in enumerate(tables):
        own = t.select(*by, F.col(value).alias(f"_{k}"))
        out = out.join(own, by, "left") if by else out.join(F.broadcast(own), how="left")
    return out.select(*rows.columns, F.coalesce(*(F.col(f"_{k}") for k in range(len(tables))), F.lit(default).cast("double")).alias(value))


def cross_year_nearest(queries: DataFrame, panel: DataFrame, k: int = 12) -> DataFrame:
    """Mean of the AOI's k values of other years nearest by circular day of year; ties by year, then day.

    An AOI's history, which the calendar bounds, is one array that its query rows join and pick from.
    """
    from ..functions.expr import circular_days

    past = panel.where("y IS NOT NULL").groupBy("aoi").agg(F.collect_list(F.struct("yr", "doy", "y")).alias("_h"))
    asked = queries.select("aoi", "date", "yr", "doy").join(past, "aoi")
    asked = asked.where(F.exists("_h", lambda x: x["yr"] != F.col("yr"))).withColumn("_h", F.filter("_h", lambda x: x["yr"] != F.col("yr")))
    ranked = F.sort_array(F.transform("_h", lambda x: F.struct(circular_days(F.col("doy"), x["doy"]).alias("far"), x.alias("row"))))
    near = asked.withColumn("_h", F.slice(ranked, 1, k))
    total = F.aggregate("_h", F.lit(0.0), lambda s, x: s + x["row"]["y"])
    return near.select("aoi", "date", (total / F.size("_h")).alias("analog"), F.size("_h").cast("long").alias("n"))


def same_trajectory(rows: DataFrame, by: str, at: str, values: list[str], least: int = 30) -> DataFrame:
    """For each id the other id with all of at least ``least`` common times equal in all values; the most times, then the smallest id.

    Ids with the same times and values are one class, which its two smallest ids stand for.
    Only classes that share a time with its values are candidates, and only those have their
    common times counted, so neither ids of one class nor all ids of a time are paired.
    """
    v = F.struct(*values)
    # The calendar bounds an id's times.
    own = rows.groupBy(F.col(by).alias("a")).agg(F.sort_array(F.collect_set(F.struct(F.col(at).alias("at"), v.alias("v")))).alias("path"))
    own = own.withColumn("class", F.md5(F.to_json("path").cast("binary")))
    first = own.groupBy("class").agg(F.min("a").alias("first"))
    named = own.join(first, "class")
    second = named.where(F.col("a") != F.col("first")).groupBy("class").agg(F.min("a").alias("second"))
    classes = named.where(F.col("a") == F.col("first")).join(second, "class", "left").select("class", "path", "first", "second")
    long = classes.select(F.col("class").alias("c"), F.explode("path").alias("p")).select("c", "p.*")
    shared = long.join(long.select(F.col("c").alias("d"), "at", "v"), ["at", "v"]).where("c <> d").groupBy("c", "d").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    times = classes.select(F.col("class").alias("c"), F.transform("path", lambda x: x["at"]).alias("times"))
    both = shared.join(times, "c").join(times.select(F.col("c").alias("d"), F.col("times").alias("others")), "d")
    other = both.where(F.size(F.array_intersect("times", "others")) == F.col("n")).join(classes.select(F.col("class").alias("d"), F.col("first").alias("peer")), "d")
    other = other.groupBy("c").agg(F.min_by(F.struct("peer", "n"), F.struct(-F.col("n"), F.col("peer"))).alias("_o"))
    mine = named.select("a", F.col("class").alias("c")).join(classes.select(F.col("class").alias("c"), "first", "second", F.size("path").cast("long").alias("k")), "c").join(other, "c", "left")
    twin = F.when(F.col("k") >= least, F.when(F.col("a") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    found = F.array_compact(F.array(F.when(twin.isNotNull(), F.struct((-F.col("k")).alias("n"), twin.alias("peer"))), F.when(F.col("_o").isNotNull(), F.struct((-F.col("_o")["n"]).alias("n"), F.col("_o")["peer"].alias("peer")))))
    best = F.array_min(found)
    return mine.where(F.size(found) > 0).select("a", best["peer"].alias("peer"), (-best["n"]).alias("n"))
