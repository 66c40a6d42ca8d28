"""Scalar expressions (P1-P33) as Column functions; doubles are expected with NaN already NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENSORS = ("s2", "landsat", "modis")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all double columns become NULL, once, at ingestion."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select([F.when(~bad(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def source_label(s2: Column, landsat: Column, modis: Column) -> Column:
    """The first sensor that has a value."""
    return F.when(s2.isNotNull(), "s2").when(landsat.isNotNull(), "landsat").when(modis.isNotNull(), "modis").otherwise("none")


def to_bool(c: Column) -> Column:
    """True, 1, yes and y in any case; all else, NULL too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def ordinal(date: Column) -> Column:
    """Proleptic day number, 1 on 0001-01-01."""
    return (F.datediff(date, F.lit("0001-01-01").cast("date")) + 1).cast("long")


def number(c: Column) -> Column:
    """P5: a double where the text is a finite number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def circular_days(a: Column, b: Column, period: int = 366) -> Column:
    """Days between two days of year around the year's end."""
    d = F.abs(a - b)
    return F.least(d, F.lit(period) - d)


def calibration_bin(doy: Column, width: int = 30) -> Column:
    """Bins of calibration, which start at day 0."""
    return F.floor(doy / width).cast("long")


def profile_bin(doy: Column, width: int = 30) -> Column:
    """Bins of profiles, which start at day 1."""
    return F.floor((doy - 1) / width).cast("long")


def harmonics(doy: Column, k: int, period: float = 366) -> tuple[Column, Column]:
    """Sine and cosine of the k-th harmonic."""
    phase = doy * (2 * 3.141592653589793 * k / period)
    return F.sin(phase), F.cos(phase)


def clip(x: Column, lo: float, hi: float) -> Column:
    """P10: NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of these columns that exists, else NULL."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None).cast("double"))


def status(z: Column) -> Column:
    """Unknown, normal from -1, suppression from -2, critical below."""
    return F.when(z.isNull(), "unknown").when(z >= -1, "normal").when(z >= -2, "suppression").otherwise("critical")


def outliers(y: Column, z: Column) -> dict[str, Column]:
    """Physical, robust and vegetation limits, their union and the reason (the last rule that holds wins)."""
    no = F.lit(False)
    physical = F.coalesce((y < -1) | (y > 1), no)
    robust = F.coalesce(F.abs(z) >= 4, no)
    vegetation = F.coalesce((y < -0.05) | (y > 1), no)
    reason = F.when(physical, "physical_range").when(robust & vegetation, "robust_and_vegetation_range").when(robust, "robust_z").otherwise("")
    return {"is_physical_outlier": physical, "is_robust_outlier": robust, "is_outlier": physical | (robust & vegetation), "outlier_reason": reason}


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation of rows that have both values, as an aggregate; NULL without spread, where corr() raises an error."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def crop_or_unknown(c: Column) -> Column:
    """The crop, or unknown where there is none."""
    return F.coalesce(c, F.lit("unknown"))


def percent(x: Column, digits: int = 1) -> Column:
    """A share as a text in percent, a dash where there is none."""
    return F.coalesce(F.concat(F.format_number(100 * x, digits), F.lit(" %")), F.lit("-"))


def quantile_edges(df: DataFrame, by: list[str], value: str, parts: int) -> DataFrame:
    """Per group the inner edges of so many parts of equal weight, as an array (exact, by linear interpolation)."""
    shares = ", ".join(str(k / parts) + "D" for k in range(1, parts))
    return df.groupBy(*by).agg(F.expr(f"percentile({value}, array({shares}))").alias("edges"))


def quantile_bin(x: Column, edges: Column) -> Column:
    """The right-closed bin of a value among ascending edges, from 0; NULL stays NULL."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x)).cast("long"))


def provenance(y: Column, value: Column) -> Column:
    """Whether a value was observed, reconstructed or is missing."""
    return F.when(y.isNotNull(), "observed").when(value.isNotNull(), "reconstructed").otherwise("missing")


def id_number(c: Column) -> Column:
    """The first digits of an id, -1 where there are none."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lit(-1)).cast("long")


def safe_ratio(a: Column, b: Column, eps: float = 0.03, most: float = 10.0) -> Column:
    """A ratio whose divisor keeps a distance from zero, clipped."""
    return clip(a / F.when(F.abs(b) >= eps, b).otherwise(F.when(b < 0, -eps).otherwise(eps)), -most, most)


def spectral(evi: Column, ndwi: Column) -> dict[str, Column]:
    """Eight transforms of a sensor's two indices."""
    e, w = clip(evi, -1, 1.5), clip(ndwi, -1, 1)
    return {
        "evi": e, "ndwi": w, "total": e + w, "difference": e - w, "ratio": safe_ratio(e, w), "inverse": safe_ratio(w, e),
        "normalized": safe_ratio(e - w, e + w), "product": e * w,
    }


def parity(aoi: Column, date: Column) -> Column:
    """The last hexadecimal digit of a key's SHA-1, modulo 2."""
    return (F.conv(F.substring(F.sha1(F.concat_ws("|", aoi, F.date_format(date, "yyyy-MM-dd"))), -1, 1), 16, 10).cast("long") % 2).cast("long")


def key(aoi: Column, date: Column) -> Column:
    """The row's key as text."""
    return F.concat_ws("|", aoi, F.date_format(date, "yyyy-MM-dd"))


def cut(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins; NULL stays NULL."""
    found = F.when(x.isNull(), None)
    for e, label in zip(edges, labels):
        found = found.when(x <= e, label)
    return found.otherwise(labels[-1])


def gap_score(rmse: Column) -> Column:
    """30 points for no error, none from 0.10 on; half to even."""
    return F.bround(30 * F.greatest(F.lit(0.0), 1 - rmse / 0.10), 2)


def entropy(*p: Column) -> Column:
    """Of a posterior; empty shares count nothing."""
    return -reduce(lambda a, b: a + b, [F.when(x > 0, x * F.log(x)).otherwise(0.0) for x in p])


def tail_gates(z: Column) -> dict[str, Column]:
    """How far z lies outside [-1, 1], and whether below -2."""
    return {"low": F.when(z.isNotNull(), F.least(z + 1, F.lit(0.0))), "high": F.when(z.isNotNull(), F.greatest(z - 1, F.lit(0.0))), "deep": z < -2}
