"""Queries of defaults, geometry, contracts, analogue years and further smoothers, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expr, geo
from ..operators import aggregates as agg
from ..operators import estimators, gapfill, joins
from ..operators import windows as win
from ..sources import io
from ..storage import base
from .core_queries import _MAPS, grid, gridded, query
from .panel import panel, tables
from .stat_queries import _NB, _SHOCK, _residuals
from .transfer_queries import _STACKED, _g, _stacked


@query(""",
e AS (SELECT source, quantile_cont(y, [0.25, 0.5, 0.75]) AS q FROM panel GROUP BY source)
SELECT p.aoi, p.date, CASE WHEN num % 7 <> 0 THEN crop_type ELSE 'unknown' END AS crop, CASE WHEN num NOT IN (3, 4) THEN y_true END AS finite, landsat AS first_found,
  printf('%.1f', 100.0 * (doy % 97) / 97) || ' %' AS label, CASE WHEN y IS NOT NULL THEN CAST(y > q[1] AS BIGINT) + CAST(y > q[2] AS BIGINT) + CAST(y > q[3] AS BIGINT) END AS bin FROM panel p JOIN e USING (source)""")
def p4_p6_p11_p22_p27_defaults(spark, sf):
    p = panel(spark, sf).withColumn("x", F.when(F.col("num") == 3, float("nan")).when(F.col("num") == 4, float("inf")).otherwise(F.col("y_true")))
    both = expr.nan_to_null(p).join(expr.quantile_edges(p, ["source"], "y", 4), "source")
    return both.select(
        "aoi", "date", expr.crop_or_unknown(F.when(F.col("num") % 7 != 0, F.col("crop_type"))).alias("crop"), F.col("x").alias("finite"), expr.first_present(p, "absent", "landsat", "s2").alias("first_found"),
        expr.percent((F.col("doy") % 97) / 97).alias("label"), expr.quantile_bin(F.col("y"), F.col("edges")).alias("bin"),
    )


@query(
    """WITH c AS (SELECT c_custkey, c_custkey % 6 AS k, (c_custkey * 7) % 340 - 170.0 AS lon, (c_custkey * 13) % 160 - 80.0 AS lat FROM customer)
SELECT c_custkey, k IN (0, 4) AS ok, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'not a Polygon or MultiPolygon' WHEN 2 THEN 'a ring is open' WHEN 3 THEN 'a point is outside WGS84' WHEN 4 THEN 'ok' ELSE 'not a Polygon or MultiPolygon' END AS message,
  round(CASE k WHEN 0 THEN (4 * lat + 0.5) / 4 WHEN 4 THEN (8 * lat + 1 + 4) / 8 END, 9) AS lat, round(CASE k WHEN 0 THEN (4 * lon + 2) / 4 WHEN 4 THEN (8 * lon + 4) / 8 END, 9) AS lon FROM c""",
    base="",
)
def p23_p25_geometry(spark, sf):
    """Vertex lists and GeoJSON of all kinds, sound and broken."""
    (c,) = tables(spark, sf, "customer")
    lon, lat = (F.col("c_custkey") * 7) % 340 - F.lit(170.0), (F.col("c_custkey") * 13) % 160 - F.lit(80.0)
    c = c.select("c_custkey", (F.col("c_custkey") % 6).alias("k"), lon.alias("lon"), lat.alias("lat"))
    square = lambda up, ring=True: F.format_string("[[[%s,%s],[%s,%s],[%s,%s]" + (",[%s,%s]" if ring else "") + "]]", F.col("lon"), F.col("lat") + up, F.col("lon") + 1, F.col("lat") + up, F.col("lon") + 1, F.col("lat") + up + 0.5, *([F.col("lon"), F.col("lat") + up] if ring else []))
    lines = F.format_string("%s,%s # first\n%s;%s\n\n# note\n%s,%s", F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat"), F.col("lon") + 1, F.col("lat") + 0.5)
    point = F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}]}')
    far = F.format_string("[[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]", F.col("lon") + 400, F.col("lat"), F.col("lon") + 1, F.col("lat"), F.col("lon") + 1, F.col("lat"), F.col("lon") + 400, F.col("lat"))
    opened = F.format_string("[[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]", F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat"), F.col("lon") + 1, F.col("lat") + 0.5, F.col("lon") + 0.5, F.col("lat"))
    polygon = lambda body: F.concat(F.lit('{"type":"Polygon","coordinates":'), body, F.lit("}"))
    multi = F.concat(F.lit('{"type":"Feature","properties":{"a":1},"geometry":{"type":"MultiPolygon","coordinates":['), square(0.0), F.lit(","), square(1.0), F.lit("]}}"))
    c = geo.with_polygon(c.withColumn("lines", F.when(F.col("k") == 0, lines).otherwise("1,1\n2,2")), "lines")
    k = F.col("k")
    text = F.when(k <= 1, F.col("geojson")).when(k == 2, polygon(opened)).when(k == 3, polygon(far)).when(k == 4, multi).otherwise(point)
    got = geo.checked(c.withColumn("text", text), "text").select("c_custkey", "geometry.*")
    return got.select("c_custkey", "ok", "message", (F.round("lat", 9) + 0.0).alias("lat"), (F.round("lon", 9) + 0.0).alias("lon"))


@query(""",
cd AS (SELECT num * 10000000 + ord + CASE WHEN num = 6 THEN 1 ELSE 0 END AS k, aoi AS a, CASE WHEN NOT (num = 3 AND doy % 2 = 0) THEN date END AS d, CASE WHEN num = 4 THEN 'nan'::DOUBLE ELSE y_true END AS v FROM panel WHERE gap AND num <> 5),
al AS (SELECT * FROM cd UNION ALL SELECT num * 10000000 + ord, aoi, date, 0.1 FROM panel WHERE gap AND num = 7),
ky AS (SELECT num * 10000000 + ord AS k, aoi AS wa, date AS wd FROM panel WHERE gap)
SELECT 1::BIGINT AS wrong_columns, CAST(count_if(al.k IS NOT NULL AND d IS NULL) AS BIGINT) AS bad_dates, CAST(count_if(NOT coalesce(a = wa AND d = wd, false)) AS BIGINT) AS misplaced, CAST(count_if(al.k IS NOT NULL AND (v IS NULL OR NOT isfinite(v))) AS BIGINT) AS not_finite,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM al GROUP BY a, d)) AS repeated FROM al FULL JOIN ky ON al.k = ky.k""")
def v6_ordered_contract(spark, sf):
    p = panel(spark, sf).where("gap").withColumn("k", F.col("num") * 10000000 + F.col("ord"))
    text = F.when((F.col("num") == 3) & (F.col("doy") % 2 == 0), "soon").otherwise(F.date_format("date", "yyyy-MM-dd"))
    value = F.when(F.col("num") == 4, F.lit("nan")).otherwise(F.col("y_true").cast("string"))
    rows = p.where("num <> 5").select((F.col("k") + (F.col("num") == 6).cast("int")).alias("k"), "aoi", value.alias("pred"), text.alias("date"))
    rows = rows.unionByName(p.where("num = 7").select("k", "aoi", F.lit("0.1").alias("pred"), F.date_format("date", "yyyy-MM-dd").alias("date")))
    return agg.ordered_contract(rows, p.select("k", "aoi", "date"))


@query("""SELECT crop_type, count(y) AS n, count(DISTINCT y) AS n_distinct, """ + ", ".join(_g(c, n) for n, c in (("mean", "avg(y)"), ("std", "stddev_samp(y)"), ("min", "min(y)"), ("q25", "quantile_cont(y, 0.25)"), ("median", "median(y)"), ("q75", "quantile_cont(y, 0.75)"), ("max", "max(y)"))) + " FROM panel GROUP BY crop_type")
def a20_describe(spark, sf):
    return gridded(agg.describe(panel(spark, sf), ["crop_type"], "y"))


@query(_SHOCK + """,
ra AS (SELECT num, date, avg(resid) AS x FROM rs GROUP BY ALL), ry AS (SELECT yr, aoi, doy, avg(resid) AS x FROM rs GROUP BY ALL)
SELECT 'aoi' AS kind, a.num AS item, b.num AS other, count(*) AS n, """ + _g("corr(a.x, b.x)", "r") + """ FROM ra a JOIN ra b ON a.date = b.date AND b.num - a.num BETWEEN 1 AND 8 GROUP BY a.num, b.num HAVING count(*) >= 30
UNION ALL SELECT 'year', a.yr, b.yr, count(*), """ + _g("corr(a.x, b.x)", "r") + " FROM ry a JOIN ry b ON a.aoi = b.aoi AND a.doy = b.doy AND b.yr - a.yr BETWEEN 1 AND 8 GROUP BY a.yr, b.yr HAVING count(*) >= 20")
def w12_a21_residual_correlation(spark, sf):
    r = _residuals(spark, sf)
    part = lambda kind, item, at, least: win.residual_correlation(r, item, at, "resid", 8, least).select(F.lit(kind).alias("kind"), F.col(item).alias("item"), "other", "n", grid("r").alias("r"))
    return part("aoi", "num", ["date"], 30).unionByName(part("year", "yr", ["aoi", "doy"], 20))


@query(""",
dk AS (SELECT q.aoi, q.date, abs(k.ord - q.ord) AS d, k.y, row_number() OVER (PARTITION BY q.aoi, q.date ORDER BY abs(k.ord - q.ord), k.ord) AS r FROM panel q JOIN panel k ON k.aoi = q.aoi AND k.yr = q.yr AND k.y IS NOT NULL AND k.ord <> q.ord),
dm AS (SELECT aoi, date, sum(CASE WHEN r <= 3 THEN y / d END) / sum(CASE WHEN r <= 3 THEN 1.0 / d END) AS idw, count_if(d <= 120) AS n, sum(CASE WHEN d <= 120 THEN exp(-d / 30.0) * y END) / sum(CASE WHEN d <= 120 THEN exp(-d / 30.0) END) AS m FROM dk GROUP BY ALL),
ds AS (SELECT aoi, date, sqrt(sum(exp(-d / 30.0) * pow(y - m, 2)) / sum(exp(-d / 30.0))) AS s FROM dk JOIN dm USING (aoi, date) WHERE d <= 120 GROUP BY ALL)
SELECT p.aoi, p.date, """ + _g("idw", "idw") + ", CAST(coalesce(n, 0) AS BIGINT) AS decay_n, " + _g("m", "decay_mean") + ", " + _g("s", "decay_std") + " FROM panel p LEFT JOIN dm USING (aoi, date) LEFT JOIN ds USING (aoi, date)")
def w5_distance_means(spark, sf):
    return gridded(win.distance_means(panel(spark, sf)).select("aoi", "date", "idw", "decay_n", "decay_mean", "decay_std"))


_NEAR = """,
nk AS (SELECT q.aoi, q.yr, q.ord, k.ord - q.ord AS d, k.ord AS k_ord, k.y, row_number() OVER (PARTITION BY q.aoi, q.yr, q.ord ORDER BY abs(k.ord - q.ord), k.ord) AS r FROM panel q JOIN panel k ON k.aoi = q.aoi AND k.yr = q.yr AND k.y IS NOT NULL WHERE q.gap)"""


def _by_name(name: str, **options):
    return lambda spark, sf: gridded(estimators.estimate(panel(spark, sf), name, **options))


@query(_NEAR + """,
kw AS (SELECT *, pow(greatest(0, 1 - pow(abs(d) / 14.0, 3)), 3) AS w FROM nk),
kg AS (SELECT aoi, yr, ord, sum(w) AS s, sum(w * y) AS t, quantile_cont(y, [0.03, 0.97]) AS q, arg_min(y, r) AS one FROM kw GROUP BY ALL)
SELECT aoi, yr, ord, """ + _g("CASE WHEN s > 1e-12 THEN least(greatest(t / s, q[1] - 0.05), q[2] + 0.05) ELSE one END", "pred") + " FROM kg")
def m4_kernel(spark, sf):
    return _by_name("kernel")(spark, sf)


@query(_NEAR + "SELECT aoi, yr, ord, " + _g("y", "pred") + " FROM nk WHERE r = 1")
def m15_nearest(spark, sf):
    return _by_name("nearest")(spark, sf)


@query(_NEAR + """,
qw AS (SELECT *, exp(-0.5 * pow(d / 30.0, 2)) AS w FROM nk WHERE r <= 12),
qs AS (SELECT aoi, yr, ord, count(*) AS n, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * pow(d, 3)) AS s3, sum(w * pow(d, 4)) AS s4, sum(w * y) AS t0, sum(w * y * d) AS t1, sum(w * y * d * d) AS t2, quantile_cont(y, [0.05, 0.95]) AS q, arg_min(y, r) AS one FROM qw GROUP BY ALL),
qd AS (SELECT *, s0 + 1e-8 AS a, s2 + 1e-4 AS e, s4 + 1e-4 AS i FROM qs)
SELECT aoi, yr, ord, """ + _g("CASE WHEN s0 < 1e-9 THEN one WHEN n < 3 THEN t0 / s0 ELSE least(greatest((t0 * (e * i - s3 * s3) - s1 * (t1 * i - s3 * t2) + s2 * (t1 * s3 - e * t2)) / (a * (e * i - s3 * s3) - s1 * (s1 * i - s3 * s2) + s2 * (s1 * s3 - e * s2)), q[1] - 0.05), q[2] + 0.05) END", "pred") + " FROM qd")
def m15_quadratic(spark, sf):
    return _by_name("quadratic")(spark, sf)


@query(_NB + """,
ah AS (SELECT aoi, yr AS hyr, doy, avg(y) AS v FROM panel WHERE y IS NOT NULL GROUP BY ALL),
ac AS (SELECT * FROM ah QUALIFY count(*) OVER (PARTITION BY aoi, hyr) >= 3),
aq AS (SELECT p.aoi, p.date, p.yr, p.doy, p.y, p.gap, h.hyr, h.lo, h.hi FROM panel p JOIN (SELECT aoi, hyr, min(doy) AS lo, max(doy) AS hi FROM ac GROUP BY ALL) h ON h.aoi = p.aoi AND h.hyr <> p.yr WHERE (p.gap OR p.y IS NOT NULL) AND p.doy BETWEEN lo AND hi),
ap AS (SELECT aq.*, b.doy AS pd, b.v AS pv FROM aq ASOF JOIN ac b ON b.aoi = aq.aoi AND b.hyr = aq.hyr AND b.doy <= aq.doy),
an AS (SELECT ap.*, b.doy AS nd, b.v AS nv FROM ap ASOF JOIN ac b ON b.aoi = ap.aoi AND b.hyr = ap.hyr AND b.doy >= ap.doy),
al AS (SELECT *, CASE WHEN nd > pd THEN pv + (nv - pv) * (doy - pd) / (nd - pd) ELSE pv END AS h FROM an),
sc AS (SELECT aoi, yr, hyr, sqrt(avg(pow(greatest(-0.5, least(0.5, y - h)), 2))) AS far FROM al WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
nr AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY aoi, yr ORDER BY round(far, 10), hyr) <= 3),
vt AS (SELECT aoi, date, sum(exp(-far / 0.3) * h) / sum(exp(-far / 0.3)) AS a, count(*) AS n_years FROM al JOIN nr USING (aoi, yr, hyr) WHERE gap GROUP BY ALL)
SELECT v.aoi, v.date, """ + _g("CASE WHEN c IS NOT NULL THEN 0.75 * a + 0.25 * c ELSE a END", "pred") + ", n_years FROM vt v LEFT JOIN (SELECT aoi, date, CASE WHEN NOT edge THEN lerp END AS c FROM nb) n ON n.aoi = v.aoi AND n.date = v.date")
def m10_year_analogues(spark, sf):
    return gridded(estimators.year_analogues(panel(spark, sf)))


@query("SELECT aoi, date, crop_type, gap, round(y, 8) AS y FROM panel")
def s1_s2_s8_csv_round_trip(spark, sf):
    """The panel as CSV, written by all tasks and read back with its encoding found."""
    uri = f"{base(spark)}/csv-{uuid.uuid4().hex}"
    p = panel(spark, sf).select("aoi", "date", "crop_type", "gap", "y")
    io.write_csv(p, uri)
    return io.read_csv(spark, uri, p.schema)


@query("""SELECT count(*) AS n_rows, count(DISTINCT (aoi, date)) AS n_keys, bool_and(y_true IS NOT NULL AND isfinite(y_true)) AS finite, """ + ", ".join(_g(f"{f}(y_true)", n) for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp"))) + " FROM panel")
def s9_v8_manifest(spark, sf):
    m = io.manifest(panel(spark, sf), ["aoi", "date"], "y_true")
    return gridded(spark.createDataFrame([(m["rows"], m["keys"], m["finite"], m["min"], m["max"], m["mean"], m["std"])], "n_rows long, n_keys long, finite boolean, min double, max double, mean double, std double"))


@query(""",
l1 AS (SELECT aoi, doy, avg(y) AS v FROM panel WHERE yr < 1998 GROUP BY ALL), l2 AS (SELECT crop_type, doy, avg(y) AS v FROM panel WHERE yr < 1997 GROUP BY ALL), l3 AS (SELECT avg(y) AS v FROM panel WHERE yr < 1996)
SELECT aoi, date, """ + _g("coalesce(l1.v, l2.v, l3.v, 0.3)", "v") + " FROM panel LEFT JOIN l1 USING (aoi, doy) LEFT JOIN l2 USING (crop_type, doy) CROSS JOIN l3")
def j12_cascade(spark, sf):
    p = panel(spark, sf)
    levels = [(by, p.where(F.col("yr") < last).groupBy(*by).agg(F.avg("y").alias("v"))) for by, last in ((["aoi", "doy"], 1998), (["crop_type", "doy"], 1997), ([], 1996))]
    return gridded(joins.cascade(p, levels, "v", 0.3).select("aoi", "date", "v"))


@query(_MAPS + """,
ll AS (SELECT aoi, yr, ord, unnest([{'source': 's2', 'v': s2}, {'source': 'landsat', 'v': landsat}, {'source': 'modis', 'v': modis}], recursive := true) FROM panel WHERE NOT gap)
SELECT aoi, yr, ord - CASE source WHEN 'modis' THEN -8 ELSE 0 END AS ord, source, """ + _g("coalesce(a + b * v, v)", "y") + " FROM ll LEFT JOIN maps ON target = 's2' AND source_ = source AND g IS NULL WHERE v IS NOT NULL")
def m14_lagged_long(spark, sf):
    p = panel(spark, sf)
    return gridded(estimators.lagged_long(p, gapfill.sensor_maps(p)))


@query(_STACKED + """,
sw AS (SELECT greatest(0, least(1, sum((lerp - truth) * (lerp - pred)) / sum(pow(pred - lerp, 2)))) AS w FROM zz0 WHERE pred IS NOT NULL AND lerp IS NOT NULL)
SELECT 'lerp' AS candidate, round(1 - w, 5) + 0.0 AS weight FROM sw UNION ALL SELECT 'pred', round(w, 5) + 0.0 FROM sw""")
def a18_simplex_weights(spark, sf):
    """Weights of two blends; for two the best share has a closed form, which is the twin."""
    z = _stacked(spark, sf).where("truth IS NOT NULL AND pred IS NOT NULL AND lerp IS NOT NULL")
    w = agg.simplex_weights(z, ["lerp", "pred"], "truth")
    return spark.createDataFrame([(n, round(float(x), 5) + 0.0) for n, x in zip(("lerp", "pred"), w)], "candidate string, weight double")
