"""Queries of the reference-style operators with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import climatology as clim
from ..operators import gapfill, joins
from .panel import SQL as PANEL
from .panel import panel, tables, weather

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str, base: str = PANEL) -> Callable:
    """Register a query under its function's name, with the SQL that follows the panel's."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = base + sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    """Doubles at the digits that both engines agree on."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("""SELECT aoi, date, crop_type, source, yr, doy, ord, s2, landsat, modis, y_true, gap, y FROM panel""")
def p1_panel(spark, sf):
    return panel(spark, sf).select("aoi", "date", "crop_type", "source", "yr", "doy", "ord", "s2", "landsat", "modis", "y_true", "gap", "y")


@query("""SELECT aoi, date, least(abs(doy - 15), 366 - abs(doy - 15)) AS days, CAST(floor(doy / 30) AS BIGINT) AS bin_cal, CAST(floor((doy - 1) / 30) AS BIGINT) AS bin_prof,
  round(sin(2 * pi() * doy / 366), 10) AS s1, round(cos(2 * pi() * doy / 366), 10) AS c1,
  CASE WHEN y IS NULL THEN NULL ELSE greatest(0.1, least(0.4, y)) END AS clipped,
  CAST(regexp_extract(aoi, '(\\d+)', 1) AS BIGINT) AS id_num, aoi || '|' || strftime(date, '%Y-%m-%d') AS key,
  CAST(('0x' || right(sha1(aoi || '|' || strftime(date, '%Y-%m-%d')), 1))::INT % 2 AS BIGINT) AS parity FROM panel""".replace("\\\\d", "\\d"))
def p7_p10_p16_p21_scalars(spark, sf):
    p, d = panel(spark, sf), F.col("doy")
    s, c = expr.harmonics(d, 1)
    return rounded(p.select(
        "aoi", "date", expr.circular_days(d, F.lit(15)).alias("days"), expr.calibration_bin(d).alias("bin_cal"), expr.profile_bin(d).alias("bin_prof"), s.alias("s1"), c.alias("c1"),
        expr.clip(F.col("y"), 0.1, 0.4).alias("clipped"), expr.id_number(F.col("aoi")).alias("id_num"), expr.key(F.col("aoi"), F.col("date")).alias("key"), expr.parity(F.col("aoi"), F.col("date")).alias("parity"),
    ))


def grid(c: str):
    """A double on a grid of a prime number of steps: decimal ties, which engines round differently, do not fall on half steps."""
    return F.round(F.col(c) * 1048573) / 1048573


def gridded(df: DataFrame) -> DataFrame:
    return df.select([grid(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_TEXTS = "element_at(array('True','false','1','0',' YES ','y','n','2.5','abc','-3',NULL), cast(o_orderkey % 11 + 1 as int))"


@query(
    """WITH t AS (SELECT o_orderkey, (['True','false','1','0',' YES ','y','n','2.5','abc','-3',NULL])[CAST(o_orderkey % 11 + 1 AS INT)] AS t FROM orders)
SELECT o_orderkey, coalesce(lower(trim(t)) IN ('true','1','yes','y'), false) AS flag, TRY_CAST(t AS DOUBLE) AS num FROM t""",
    base="",
)
def p2_p5_tolerant_parse(spark, sf):
    (o,) = tables(spark, sf, "orders")
    t = o.select("o_orderkey", F.expr(_TEXTS).alias("t"))
    return t.select("o_orderkey", expr.to_bool(F.col("t")).alias("flag"), expr.number(F.col("t")).alias("num"))


@query("""SELECT aoi, date, round(e, 10) AS evi, round(w, 10) AS ndwi, round(e + w, 10) AS total, round(e - w, 10) AS difference,
  round(greatest(-10, least(10, e / CASE WHEN abs(w) >= 0.03 THEN w WHEN w < 0 THEN -0.03 ELSE 0.03 END)), 10) AS ratio,
  round(greatest(-10, least(10, w / CASE WHEN abs(e) >= 0.03 THEN e WHEN e < 0 THEN -0.03 ELSE 0.03 END)), 10) AS inverse,
  round(greatest(-10, least(10, (e - w) / CASE WHEN abs(e + w) >= 0.03 THEN e + w WHEN e + w < 0 THEN -0.03 ELSE 0.03 END)), 10) AS normalized, round(e * w, 10) AS product
  FROM (SELECT aoi, date, greatest(-1, least(1.5, s2)) AS e, greatest(-1, least(1, landsat)) AS w FROM panel WHERE s2 IS NOT NULL AND landsat IS NOT NULL)""")
def p18_spectral(spark, sf):
    p = panel(spark, sf).where("s2 IS NOT NULL AND landsat IS NOT NULL")
    return rounded(p.select("aoi", "date", *(c.alias(n) for n, c in expr.spectral(F.col("s2"), F.col("landsat")).items())))


_CLIM = """,
hist AS (SELECT aoi, crop_type, yr AS hyr, doy AS hdoy, y FROM panel WHERE y IS NOT NULL),
keys AS (SELECT DISTINCT aoi, crop_type, yr, doy FROM panel),
m1 AS (SELECT k.aoi, k.crop_type, k.yr, k.doy, median(h.y) AS m, count(*) AS n, count(DISTINCT hyr) AS ny FROM keys k JOIN hist h ON h.aoi = k.aoi AND hyr < yr AND least(abs(doy - hdoy), 366 - abs(doy - hdoy)) <= 15 GROUP BY ALL HAVING count(*) >= 3),
d1 AS (SELECT k.aoi, k.crop_type, k.yr, k.doy, median(abs(h.y - m)) AS mad FROM m1 k JOIN hist h ON h.aoi = k.aoi AND hyr < yr AND least(abs(doy - hdoy), 366 - abs(doy - hdoy)) <= 15 GROUP BY ALL),
c1 AS (SELECT m1.*, mad, 'aoi_historical' AS src FROM m1 JOIN d1 USING (aoi, crop_type, yr, doy)),
k2 AS (SELECT * FROM keys ANTI JOIN c1 USING (aoi, crop_type, yr, doy)),
q2 AS (SELECT DISTINCT crop_type, yr, doy FROM k2),
m2 AS (SELECT k.crop_type, k.yr, k.doy, median(h.y) AS m, count(*) AS n, count(DISTINCT hyr) AS ny FROM q2 k JOIN hist h ON h.crop_type = k.crop_type AND hyr < yr AND least(abs(doy - hdoy), 366 - abs(doy - hdoy)) <= 15 GROUP BY ALL HAVING count(*) >= 3),
d2 AS (SELECT k.crop_type, k.yr, k.doy, median(abs(h.y - m)) AS mad FROM m2 k JOIN hist h ON h.crop_type = k.crop_type AND hyr < yr AND least(abs(doy - hdoy), 366 - abs(doy - hdoy)) <= 15 GROUP BY ALL),
c2 AS (SELECT k2.aoi, k2.crop_type, k2.yr, k2.doy, m, n, ny, mad, 'crop_historical' AS src FROM k2 JOIN m2 USING (crop_type, yr, doy) JOIN d2 USING (crop_type, yr, doy)),
k3 AS (SELECT * FROM k2 ANTI JOIN c2 USING (aoi, crop_type, yr, doy)),
q3 AS (SELECT DISTINCT yr, doy FROM k3),
m3 AS (SELECT k.yr, k.doy, median(h.y) AS m, count(*) AS n, count(DISTINCT hyr) AS ny FROM q3 k JOIN hist h ON hyr < yr AND least(abs(doy - hdoy), 366 - abs(doy - hdoy)) <= 15 GROUP BY ALL HAVING count(*) >= 3),
d3 AS (SELECT k.yr, k.doy, median(abs(h.y - m)) AS mad FROM m3 k JOIN hist h ON hyr < yr AND least(abs(doy - hdoy), 366 - abs(doy - hdoy)) <= 15 GROUP BY ALL),
c3 AS (SELECT k3.aoi, k3.crop_type, k3.yr, k3.doy, m, n, ny, mad, 'global_historical' AS src FROM k3 JOIN m3 USING (yr, doy) JOIN d3 USING (yr, doy)),
c AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3),
cl AS (SELECT p.*, c.m AS clim_mean, greatest(1.4826 * c.mad, 0.03) AS clim_std, c.n AS clim_n, c.ny AS clim_years, coalesce(c.src, 'unavailable') AS clim_source FROM panel p LEFT JOIN c USING (aoi, crop_type, yr, doy)),
an AS (SELECT *, y_true AS value, (y_true - clim_mean) / clim_std AS z FROM cl),
st AS (SELECT *, CASE WHEN z IS NULL THEN 'unknown' WHEN z >= -1 THEN 'normal' WHEN z >= -2 THEN 'suppression' ELSE 'critical' END AS status,
  CASE WHEN y IS NOT NULL THEN 'observed' WHEN value IS NOT NULL THEN 'reconstructed' ELSE 'missing' END AS provenance FROM an)"""


def _anomalies(spark, sf):
    return clim.anomalies(panel(spark, sf), F.col("y_true"))


@query(_CLIM + """SELECT aoi, date, round(clim_mean, 10) AS clim_mean, round(CASE WHEN clim_mean IS NOT NULL THEN clim_std END * 1048573) / 1048573 AS clim_std, clim_n, clim_years, round(CASE WHEN clim_mean IS NOT NULL THEN clim_std / sqrt(clim_n) END * 1048573) / 1048573 AS clim_se, clim_source FROM cl""")
def j6_a7_climatology(spark, sf):
    c = clim.climatology(panel(spark, sf))
    return c.select("aoi", "date", F.round("clim_mean", 10).alias("clim_mean"), grid("clim_std").alias("clim_std"), "clim_n", "clim_years", grid("clim_se").alias("clim_se"), "clim_source")


@query(_CLIM + """SELECT aoi, date, round(z, 10) AS z, status, provenance, coalesce(value < -1 OR value > 1, false) AS is_physical_outlier, coalesce(abs(z) >= 4, false) AS is_robust_outlier,
  coalesce(value < -1 OR value > 1, false) OR (coalesce(abs(z) >= 4, false) AND coalesce(value < -0.05 OR value > 1, false)) AS is_outlier,
  CASE WHEN coalesce(value < -1 OR value > 1, false) THEN 'physical_range' WHEN coalesce(abs(z) >= 4, false) AND coalesce(value < -0.05 OR value > 1, false) THEN 'robust_and_vegetation_range' WHEN coalesce(abs(z) >= 4, false) THEN 'robust_z' ELSE '' END AS outlier_reason FROM st""")
def p12_p15_status(spark, sf):
    return rounded(_anomalies(spark, sf).select("aoi", "date", "z", "status", "provenance", "is_physical_outlier", "is_robust_outlier", "is_outlier", "outlier_reason"))


_RUNS = _CLIM + """,
w1 AS (SELECT st.*, temp_c, precip_mm FROM st LEFT JOIN weather USING (date)),
s1 AS (SELECT *, CASE WHEN date - lag(date) OVER w <= 1 AND status = lag(status) OVER w THEN 0 ELSE 1 END AS new FROM w1 WHERE status IN ('suppression', 'critical') WINDOW w AS (PARTITION BY aoi ORDER BY date)),
s2 AS (SELECT *, sum(new) OVER (PARTITION BY aoi ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM s1),
runs AS (SELECT aoi, status, min(date) AS start, max(date) AS "end", count(*) AS n_days, avg(z) AS mean_z, min(z) AS min_z, count_if(provenance = 'observed') AS n_observed, count_if(provenance = 'reconstructed') AS n_reconstructed,
  CASE WHEN min(z) < -3.5 THEN 'critical' WHEN min(z) < -2.75 THEN 'high' ELSE 'moderate' END AS severity,
  CASE WHEN avg(precip_mm) < 1 AND avg(temp_c) > 30 THEN 'dry_and_hot_context' WHEN avg(precip_mm) < 1 THEN 'dry_context' WHEN avg(temp_c) > 30 THEN 'hot_context' ELSE 'weather_unavailable_or_unusual' END AS weather
  FROM s2 GROUP BY aoi, run, status)"""


def _runs(spark, sf):
    rows = _anomalies(spark, sf).join(weather(spark, sf), "date", "left")
    return rows, clim.periods(rows)


@query(_RUNS + """SELECT aoi, status, start, "end", n_days, round(mean_z, 10) AS mean_z, round(min_z, 10) AS min_z, CAST(n_observed AS BIGINT) AS n_observed, CAST(n_reconstructed AS BIGINT) AS n_reconstructed, severity, weather FROM runs""")
def w1_a26_periods(spark, sf):
    return rounded(_runs(spark, sf)[1])


@query(_RUNS + """SELECT aoi, count(*) AS n_rows, CAST(count_if(provenance = 'observed') AS BIGINT) AS observed, CAST(count_if(provenance = 'reconstructed') AS BIGINT) AS reconstructed, CAST(count_if(provenance = 'missing') AS BIGINT) AS missing,
  round(avg(CASE WHEN z IS NOT NULL THEN 1 ELSE 0 END), 10) AS coverage, CAST(count_if(status IN ('suppression', 'critical')) AS BIGINT) AS anomaly_n, CAST(count_if(status = 'critical') AS BIGINT) AS critical_n, round(avg(z), 10) AS mean_z,
  coalesce(any_value(k), 0) AS periods_n FROM st LEFT JOIN (SELECT aoi, count(*) AS k FROM runs GROUP BY aoi) USING (aoi) GROUP BY aoi""")
def a1_a2_regions(spark, sf):
    rows, runs = _runs(spark, sf)
    return rounded(clim.region_summary(rows, runs))


@query(_RUNS + """,
a AS (SELECT aoi, avg(CASE WHEN status = 'critical' THEN 1 ELSE 0 END) AS crit, avg(CASE WHEN status = 'suppression' THEN 1 ELSE 0 END) AS supp, avg(z) AS mean_z, avg(CASE WHEN provenance = 'reconstructed' THEN 1 ELSE 0 END) AS recon, avg(CASE WHEN z IS NOT NULL THEN 1 ELSE 0 END) AS cov FROM st GROUP BY aoi),
b AS (SELECT a.*, coalesce(md, 0) AS max_days, coalesce(rn, 0) AS runs FROM a LEFT JOIN (SELECT aoi, max(n_days) AS md, count(*) AS rn FROM runs GROUP BY aoi) USING (aoi)),
p AS (SELECT *, greatest(0, least(1, coalesce(-mean_z, 0) / 3)) AS f0, crit AS f1, supp AS f2, greatest(0, least(1, max_days / 14)) AS f3, greatest(0, least(1, 0.55 * recon + 0.45 * (1 - cov))) AS f4 FROM b),
l AS (SELECT aoi, string_agg(name, ', ' ORDER BY v DESC, k) FILTER (WHERE v > 0.05) AS factors FROM (
  SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY v DESC, k) AS r FROM (
    SELECT aoi, f0 AS v, 0 AS k, 'low_z' AS name FROM p UNION ALL SELECT aoi, f1, 1, 'critical' FROM p UNION ALL SELECT aoi, f2, 2, 'suppression' FROM p UNION ALL SELECT aoi, f3, 3, 'persistence' FROM p UNION ALL SELECT aoi, f4, 4, 'uncertainty' FROM p)) WHERE r <= 2 GROUP BY aoi),
s AS (SELECT aoi, crit, supp, mean_z, recon, cov, max_days, runs, round_even(100 * (0.35 * f0 + 0.25 * f1 + 0.15 * f2 + 0.15 * f3 + 0.10 * f4), 1) AS risk_score FROM p)
SELECT aoi, round(crit, 10) AS crit, round(supp, 10) AS supp, round(mean_z, 10) AS mean_z, round(recon, 10) AS recon, round(cov, 10) AS cov, max_days, runs, risk_score, coalesce(factors, 'stable') AS factors,
  CASE WHEN risk_score <= 20 THEN 'low' WHEN risk_score <= 50 THEN 'medium' ELSE 'high' END AS risk_level FROM s JOIN l USING (aoi)""")
def a3_p29_p30_radar(spark, sf):
    rows, runs = _runs(spark, sf)
    return rounded(clim.radar(rows, runs))


_MAPS = """,
long AS (SELECT CAST(floor(doy / 30) AS BIGINT) AS bin, target, source_, x, y_ FROM (
  SELECT doy, gap, unnest([{'target': 's2', 'source_': 'landsat', 'x': landsat, 'y_': s2}, {'target': 's2', 'source_': 'modis', 'x': modis, 'y_': s2}, {'target': 'landsat', 'source_': 's2', 'x': s2, 'y_': landsat},
    {'target': 'landsat', 'source_': 'modis', 'x': modis, 'y_': landsat}, {'target': 'modis', 'source_': 's2', 'x': s2, 'y_': modis}, {'target': 'modis', 'source_': 'landsat', 'x': landsat, 'y_': modis}], recursive := true) FROM panel WHERE NOT gap)
  WHERE x IS NOT NULL AND y_ IS NOT NULL AND abs(x) < 2 AND abs(y_) < 2),
grouped AS (SELECT *, bin AS g, 30 AS need FROM long UNION ALL SELECT *, NULL AS g, 20 AS need FROM long),
edges AS (SELECT target, source_, g, quantile_cont(x, [0.02, 0.98]) AS qx, quantile_cont(y_, [0.02, 0.98]) AS qy FROM grouped GROUP BY target, source_, g, need HAVING count(*) >= need),
fits AS (SELECT l.target, l.source_, l.g, count(*) AS n, regr_slope(y_, x) AS s, regr_intercept(y_, x) AS i, max(x) - min(x) AS spread, median(x) AS mx, median(y_) AS my
  FROM grouped l JOIN edges e ON l.target = e.target AND l.source_ = e.source_ AND l.g IS NOT DISTINCT FROM e.g WHERE x BETWEEN qx[1] AND qx[2] AND y_ BETWEEN qy[1] AND qy[2] GROUP BY ALL),
maps AS (SELECT target, source_, g, n, CASE WHEN n < 12 OR spread < 1e-8 THEN my - mx WHEN s IS NULL OR abs(s) > 3 THEN 0.0 ELSE i END AS a, CASE WHEN n < 12 OR spread < 1e-8 OR s IS NULL OR abs(s) > 3 THEN 1.0 ELSE s END AS b FROM fits)"""


@query(_MAPS + """SELECT target, source_ AS source, g AS bin, n, round(a, 8) AS a, round(b, 8) AS b FROM maps""")
def a4_sensor_maps(spark, sf):
    return rounded(gapfill.sensor_maps(panel(spark, sf)), 8)


_POST = """,
seen AS (SELECT * FROM panel WHERE y IS NOT NULL AND source <> 'none'),
g1 AS (SELECT aoi, doy, (count_if(source = 's2') + 0.25) / (count(*) + 0.75) AS p1, (count_if(source = 'landsat') + 0.25) / (count(*) + 0.75) AS p2, (count_if(source = 'modis') + 0.25) / (count(*) + 0.75) AS p3 FROM seen GROUP BY ALL),
g2 AS (SELECT crop_type, doy, (count_if(source = 's2') + 0.25) / (count(*) + 0.75) AS p1, (count_if(source = 'landsat') + 0.25) / (count(*) + 0.75) AS p2, (count_if(source = 'modis') + 0.25) / (count(*) + 0.75) AS p3 FROM seen GROUP BY ALL),
g3 AS (SELECT doy, (count_if(source = 's2') + 0.25) / (count(*) + 0.75) AS p1, (count_if(source = 'landsat') + 0.25) / (count(*) + 0.75) AS p2, (count_if(source = 'modis') + 0.25) / (count(*) + 0.75) AS p3 FROM seen GROUP BY ALL),
g4 AS (SELECT yr, doy, (count_if(source = 's2') + 0.25) / (count(*) + 0.75) AS p1, (count_if(source = 'landsat') + 0.25) / (count(*) + 0.75) AS p2, (count_if(source = 'modis') + 0.25) / (count(*) + 0.75) AS p3 FROM seen GROUP BY ALL),
post AS (SELECT q.aoi, q.date, coalesce(g4.p1, g1.p1, g2.p1, g3.p1, 0.4) AS p_s2, coalesce(g4.p2, g1.p2, g2.p2, g3.p2, 0.4) AS p_landsat, coalesce(g4.p3, g1.p3, g2.p3, g3.p3, 0.2) AS p_modis
  FROM panel q LEFT JOIN g1 USING (aoi, doy) LEFT JOIN g2 USING (crop_type, doy) LEFT JOIN g3 USING (doy) LEFT JOIN g4 USING (yr, doy) WHERE q.gap)"""


@query(_POST + """SELECT aoi, date, round(p_s2, 10) AS p_s2, round(p_landsat, 10) AS p_landsat, round(p_modis, 10) AS p_modis FROM post""")
def a5_a6_j12_posterior(spark, sf):
    p = panel(spark, sf)
    return rounded(gapfill.query_posterior(p.where("gap").select("aoi", "crop_type", "date", "yr", "doy"), p).select("aoi", "date", "p_s2", "p_landsat", "p_modis"))


_FILL = _MAPS + _POST + """,
kn AS (SELECT * FROM panel WHERE y IS NOT NULL AND NOT gap), qs AS (SELECT * FROM panel WHERE gap),
nn AS (SELECT * FROM (SELECT q.aoi, q.yr, q.date, q.ord AS q_ord, k.ord AS k_ord, k.source, k.y, CAST(floor(k.doy / 30) AS BIGINT) AS bin, row_number() OVER (PARTITION BY q.aoi, q.yr, q.ord ORDER BY abs(k.ord - q.ord), k.ord) AS r FROM qs q JOIN kn k ON q.aoi = k.aoi AND q.yr = k.yr) WHERE r <= 8),
mp AS (SELECT n.*, t.target, CASE WHEN n.source = t.target THEN n.y WHEN b.a IS NOT NULL THEN b.a + b.b * n.y WHEN g.a IS NOT NULL THEN g.a + g.b * n.y ELSE n.y END AS v
  FROM nn n CROSS JOIN (VALUES ('s2'), ('landsat'), ('modis')) t(target) LEFT JOIN maps b ON b.target = t.target AND b.source_ = n.source AND b.g = n.bin LEFT JOIN maps g ON g.target = t.target AND g.source_ = n.source AND g.g IS NULL),
zz AS (SELECT *, (k_ord - q_ord) / greatest(1.0, max(abs(k_ord - q_ord)) OVER (PARTITION BY aoi, yr, q_ord, target)) AS z FROM mp),
ww AS (SELECT *, pow(1 / (1 + 2 * abs(z)), 2) AS w FROM zz),
ss AS (SELECT aoi, date, target, sum(w) AS sw, sum(w * z) AS swz, sum(w * z * z) AS swzz, sum(w * v) AS swy, sum(w * z * v) AS swzy, quantile_cont(v, [0.05, 0.95]) AS q FROM ww GROUP BY ALL),
lv AS (SELECT aoi, date, target, greatest(q[1] - 0.04, least(q[2] + 0.04, CASE WHEN sw * swzz - swz * swz > 1e-12 THEN (swzz * swy - swz * swzy) / (sw * swzz - swz * swz) ELSE swy / sw END)) AS v FROM ss),
mix AS (SELECT aoi, date, sum(v * CASE target WHEN 's2' THEN p_s2 WHEN 'landsat' THEN p_landsat ELSE p_modis END) / sum(CASE target WHEN 's2' THEN p_s2 WHEN 'landsat' THEN p_landsat ELSE p_modis END) AS m FROM lv JOIN post USING (aoi, date) GROUP BY aoi, date),
near_any AS (SELECT q.aoi, q.date, arg_min(k.y, abs(k.ord - q.ord) * 10000000 + k.ord) AS v FROM qs q JOIN kn k USING (aoi) GROUP BY ALL),
filled AS (SELECT q.aoi, q.date, greatest(-0.5, least(1.2, coalesce(m, v, (SELECT median(y) FROM kn), 0.3))) AS pred FROM qs q LEFT JOIN mix USING (aoi, date) LEFT JOIN near_any USING (aoi, date))"""


@query(_FILL + """SELECT aoi, date, round(pred * 1048573) / 1048573 AS pred FROM filled""")
def j13_m1_m2_j16_gap_fill(spark, sf):
    return gridded(gapfill.fill(panel(spark, sf)))


@query(_FILL + """SELECT yr, count(*) AS n, round(sqrt(avg(pow(pred - y_true, 2))), 8) AS rmse, round(avg(abs(pred - y_true)), 8) AS mae, round(avg(pred - y_true), 8) AS bias,
  round_even(30 * greatest(0, 1 - sqrt(avg(pow(pred - y_true, 2))) / 0.10), 2) AS gap_score FROM filled JOIN panel USING (aoi, date) GROUP BY yr""")
def j5_a16_p31_scores(spark, sf):
    p = panel(spark, sf)
    e = F.col("pred") - F.col("y_true")
    rmse = F.sqrt(F.avg(e * e))
    both = gapfill.fill(p).join(p.select("aoi", "date", "yr", "y_true"), ["aoi", "date"])
    return rounded(both.groupBy("yr").agg(F.count("*").alias("n"), rmse.alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), expr.gap_score(rmse).alias("gap_score")), 8)


@query("""SELECT aoi, date, CASE WHEN y IS NULL THEN pred ELSE y END AS fill_null, CASE WHEN gap THEN pred ELSE y END AS overwrite_gap, CASE WHEN y IS NULL AND gap THEN pred ELSE y END AS null_and_gap
  FROM panel LEFT JOIN (SELECT aoi, date, y_true / 2 AS pred FROM panel WHERE doy % 2 = 0) USING (aoi, date)""")
def j1_keyed_fill(spark, sf):
    p = panel(spark, sf)
    pred = p.where("doy % 2 = 0").select("aoi", "date", (F.col("y_true") / 2).alias("pred"))
    out = None
    for mode in joins.FILL_MODES:
        own = joins.keyed_fill(p, pred, mode).select("aoi", "date", F.col("filled").alias(mode))
        out = own if out is None else out.join(own, ["aoi", "date"])
    return out


@query("""SELECT aoi, date, y, temp_c, precip_mm FROM panel LEFT JOIN weather USING (date)""")
def j2_weather_join(spark, sf):
    return joins.with_weather(panel(spark, sf), weather(spark, sf)).select("aoi", "date", "y", "temp_c", "precip_mm")


@query("""SELECT date, a, b, CASE WHEN b IS NULL THEN 'left_only' WHEN a IS NULL THEN 'right_only' ELSE 'both' END AS _merge
  FROM (SELECT date, count(*) AS a FROM panel WHERE num < 12 AND yr < 1998 GROUP BY date) FULL JOIN (SELECT date, count(*) AS b FROM panel WHERE num >= 12 AND yr > 1995 GROUP BY date) USING (date)""")
def j3_outer_indicator(spark, sf):
    p = panel(spark, sf)
    a = p.where("num < 12 AND yr < 1998").groupBy("date").agg(F.count("*").alias("a"))
    b = p.where("num >= 12 AND yr > 1995").groupBy("date").agg(F.count("*").alias("b"))
    return joins.outer_with_indicator(a, b, ["date"])


@query("""SELECT p.aoi, p.date, p.y, k.m FROM panel p LEFT JOIN (SELECT aoi, yr, max(y) AS m FROM panel GROUP BY ALL) k USING (aoi, yr)""")
def j4_validated_left(spark, sf):
    p = panel(spark, sf)
    yearly = p.groupBy("aoi", "yr").agg(F.max("y").alias("m"))
    return rounded(joins.validated_left(p, yearly, ["aoi", "yr"], "many_to_one").select("aoi", "date", "y", "m"))


@query("""SELECT q.aoi, q.date, """ + ", ".join(f"CAST(count_if(abs(q.num - k.num) <= {r}) AS BIGINT) AS n_{r}, round(coalesce(sum(CASE WHEN abs(q.num - k.num) <= {r} THEN k.y END), 0), 9) AS sum_{r}" for r in (1, 2, 4, 8)) + """
  FROM panel q JOIN panel k ON q.date = k.date AND k.y IS NOT NULL AND abs(q.num - k.num) BETWEEN 1 AND 8 GROUP BY ALL""")
def j7_same_date_peers(spark, sf):
    j = joins.same_date_peers(panel(spark, sf))
    sums = [c for r in (1, 2, 4, 8) for c in (F.col(f"n_{r}"), F.round(F.coalesce(F.col(f"mean_{r}") * F.col(f"n_{r}"), F.lit(0.0)), 9).alias(f"sum_{r}"))]
    return j.select("aoi", "date", *sums)


_LINE = "CASE WHEN {p}xx - {p}x * {p}x / {p}n > 1e-12 * {p}n THEN ({p}xy - {p}x * {p}y / {p}n) / ({p}xx - {p}x * {p}x / {p}n) ELSE 0.0 END"
_PAIRS = """,
own AS (SELECT yr, date, ord, num, aoi, y FROM panel WHERE y IS NOT NULL),
pj AS (SELECT a.yr, a.aoi, b.aoi AS peer, a.y, b.y AS x, count(*) OVER w AS cnt, row_number() OVER (w ORDER BY a.ord) AS r FROM own a JOIN own b ON a.yr = b.yr AND a.date = b.date AND abs(a.num - b.num) BETWEEN 1 AND 8 WINDOW w AS (PARTITION BY a.yr, a.aoi, b.aoi)),
fs AS (SELECT yr, aoi, peer, (r - 1) % least(5, greatest(2, cnt // 5)) AS fold, count(*)::DOUBLE AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM pj WHERE cnt >= 6 GROUP BY ALL),
fo AS (SELECT *, """ + ", ".join(f"sum({k}) OVER (PARTITION BY yr, aoi, peer) AS w_{k}, sum({k}) OVER (PARTITION BY yr, aoi, peer) - {k} AS o_{k}" for k in ("n", "x", "y", "xx", "xy", "yy")) + """ FROM fs),
fb AS (SELECT *, """ + _LINE.format(p="o_") + """ AS sl FROM fo WHERE o_n >= 4),
fe AS (SELECT *, (o_y - sl * o_x) / o_n AS ic FROM fb),
fc AS (SELECT yr, aoi, peer, sum(yy - 2 * ic * y - 2 * sl * xy + n * ic * ic + 2 * ic * sl * x + sl * sl * xx) AS sse, sum(n) AS seen, """ + ", ".join(f"any_value(w_{k}) AS w_{k}" for k in ("n", "x", "y", "xx", "xy")) + """ FROM fe GROUP BY ALL),
fl AS (SELECT *, """ + _LINE.format(p="w_") + """ AS b FROM fc WHERE w_xx - w_x * w_x / w_n > 1e-12 * w_n AND seen >= greatest(4, floor(w_n / 2))),
pf AS (SELECT yr, aoi, peer, CAST(w_n AS BIGINT) AS n, (w_y - b * w_x) / w_n AS a, b, sqrt(greatest(0, sse / seen)) AS cv FROM fl)"""


@query(_PAIRS + """,
cd AS (SELECT q.aoi, q.date, pf.*EXCLUDE (aoi, yr), k.y AS x, row_number() OVER (PARTITION BY q.aoi, q.date ORDER BY round(cv, 10), n DESC, peer) AS r FROM panel q JOIN pf USING (aoi, yr) JOIN own k ON k.date = q.date AND k.aoi = pf.peer WHERE q.gap)
SELECT aoi, date, round(sum(least(1.0, n / 24) / (cv * cv + 0.0009) * (a + b * x)) / sum(least(1.0, n / 24) / (cv * cv + 0.0009)), 8) AS pred, count(*) AS n_peers FROM cd WHERE r <= 3 GROUP BY ALL""")
def j8_pair_peers(spark, sf):
    p = panel(spark, sf)
    return rounded(joins.peer_predict(p.where("gap"), p), 8)


@query(""",
a AS (SELECT q.aoi, q.date, q.ord, (SELECT max(k.ord) FROM panel k WHERE k.aoi = q.aoi AND k.yr = q.yr AND k.y IS NOT NULL AND k.ord < q.ord) AS po, (SELECT min(k.ord) FROM panel k WHERE k.aoi = q.aoi AND k.yr = q.yr AND k.y IS NOT NULL AND k.ord > q.ord) AS no, q.yr FROM panel q),
b AS (SELECT a.*, CASE WHEN ord - po <= 90 THEN ord - po END AS bd, CASE WHEN no - ord <= 90 THEN no - ord END AS ad FROM a)
SELECT b.aoi, b.date, k.source AS as_of, least(bd, ad) AS as_of_days FROM b LEFT JOIN panel k ON k.aoi = b.aoi AND k.ord = CASE WHEN bd IS NOT NULL AND (ad IS NULL OR bd <= ad) THEN po WHEN ad IS NOT NULL THEN no END""")
def j9_as_of(spark, sf):
    return joins.as_of(panel(spark, sf), F.col("y").isNotNull(), F.col("source"), ["aoi", "yr"]).select("aoi", "date", "as_of", "as_of_days")


@query("""SELECT 'semi' AS kind, count(*) AS n FROM panel p SEMI JOIN (SELECT aoi FROM panel WHERE gap AND yr = 1998) q USING (aoi) UNION ALL
SELECT 'anti', count(*) FROM panel p ANTI JOIN (SELECT aoi, doy FROM panel WHERE gap AND yr = 1998) q USING (aoi, doy) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM panel WHERE gap UNION ALL SELECT * FROM panel) UNION ALL
SELECT 'minus', count(*) FROM (SELECT aoi, doy FROM panel EXCEPT SELECT aoi, doy FROM panel WHERE gap)""")
def j10_j11_h_set_operations(spark, sf):
    p = panel(spark, sf)
    gaps = p.where("gap")
    kinds = {
        "semi": p.join(gaps.where("yr = 1998").select("aoi"), "aoi", "left_semi"), "anti": p.join(gaps.where("yr = 1998").select("aoi", "doy"), ["aoi", "doy"], "left_anti"),
        "union": gaps.unionByName(p), "minus": p.select("aoi", "doy").subtract(gaps.select("aoi", "doy")),
    }
    out = None
    for k, df in kinds.items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT aoi, date, round(avg(y2), 10) AS analog, count(*) AS n FROM (SELECT q.aoi, q.date, h.y AS y2, row_number() OVER (PARTITION BY q.aoi, q.date ORDER BY least(abs(q.doy - h.doy), 366 - abs(q.doy - h.doy)), h.yr, h.doy) AS r
  FROM panel q JOIN panel h ON h.aoi = q.aoi AND h.y IS NOT NULL AND h.yr <> q.yr WHERE q.gap) WHERE r <= 12 GROUP BY ALL""")
def j14_cross_year_nearest(spark, sf):
    p = panel(spark, sf)
    return rounded(joins.cross_year_nearest(p.where("gap"), p))


@query(""",
t AS (SELECT num, date, num % 5 + yr AS v FROM panel),
f AS (SELECT a.num AS a, b.num AS b, count(*) AS n FROM t a JOIN t b ON a.date = b.date AND a.num <> b.num GROUP BY ALL HAVING count(*) >= 30 AND bool_and(a.v = b.v))
SELECT a, arg_min(b, -n * 1000 + b) AS peer, max(n) AS n FROM f GROUP BY a""")
def j15_trajectory(spark, sf):
    t = panel(spark, sf).select("num", "date", (F.col("num") % 5 + F.col("yr")).alias("v"))
    return joins.same_trajectory(t, "num", "date", ["v"])
