"""Queries of windows, aggregates and validation with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import aggregates as agg
from ..operators import estimators, gapfill, joins
from ..operators import windows as win
from .core_queries import _FILL, grid, gridded, query, rounded
from .panel import panel, tables, weather

_NB = """,
nb0 AS (SELECT *, (SELECT max(k.ord) FROM panel k WHERE k.aoi = p.aoi AND k.yr = p.yr AND k.y IS NOT NULL AND k.ord < p.ord) AS po, (SELECT min(k.ord) FROM panel k WHERE k.aoi = p.aoi AND k.yr = p.yr AND k.y IS NOT NULL AND k.ord > p.ord) AS no FROM panel p),
nb1 AS (SELECT n.*, a.y AS pv, b.y AS nv FROM nb0 n LEFT JOIN panel a ON a.aoi = n.aoi AND a.ord = n.po LEFT JOIN panel b ON b.aoi = n.aoi AND b.ord = n.no),
nb AS (SELECT *, ord - po AS left_days, no - ord AS right_days, (nv - pv) / (no - po) AS slope, coalesce(pv + (nv - pv) / (no - po) * (ord - po), pv, nv) AS lerp, po IS NULL OR no IS NULL AS edge FROM nb1)"""


@query(_NB + """SELECT aoi, date, pv AS prev_y, nv AS next_y, left_days, right_days, round(slope * 1048573) / 1048573 AS slope, round(lerp * 1048573) / 1048573 AS lerp, least(left_days, right_days) AS gap_days, left_days + right_days AS bracket, edge FROM nb""")
def w5_w9_neighbours(spark, sf):
    n = win.neighbours(panel(spark, sf))
    return n.select("aoi", "date", "prev_y", "next_y", "left_days", "right_days", grid("slope").alias("slope"), grid("lerp").alias("lerp"), "gap_days", "bracket", "edge")


_HR = """,
hr AS (SELECT *, count(*) OVER (PARTITION BY aoi, yr, run) AS run_len FROM (SELECT *, ord - row_number() OVER (PARTITION BY aoi, yr ORDER BY ord) AS run FROM panel WHERE gap))"""


@query(_HR + """SELECT aoi, date, run_len FROM hr""")
def w2_hidden_runs(spark, sf):
    return win.hidden_runs(panel(spark, sf)).select("aoi", "date", "run_len")


@query("""SELECT aoi, date, """ + ", ".join(
    f"round(coalesce(sum(y_true) OVER (PARTITION BY aoi, yr ORDER BY ord ROWS BETWEEN {w // 2} PRECEDING AND {w - 1 - w // 2} FOLLOWING), 0), 8) AS sum_{w}, round(stddev_samp(y_true) OVER (PARTITION BY aoi, yr ORDER BY ord ROWS BETWEEN {w // 2} PRECEDING AND {w - 1 - w // 2} FOLLOWING), 7) AS std_{w}" for w in (3, 14)) + " FROM panel")
def w3_rolling(spark, sf):
    r = win.rolling(panel(spark, sf), ["y_true"], (3, 14))
    return r.select("aoi", "date", *(c for w in (3, 14) for c in (F.round(F.coalesce(f"y_true_sum_{w}", F.lit(0.0)), 8).alias(f"sum_{w}"), F.round(f"y_true_std_{w}", 7).alias(f"std_{w}"))))


@query("""SELECT aoi, date, round((sum(greatest(temp_c - 5, 0)) OVER w) * 1048573) / 1048573 AS gdd, round((sum(precip_mm) OVER w) * 1048573) / 1048573 AS rain FROM panel LEFT JOIN weather USING (date) WINDOW w AS (PARTITION BY aoi, yr ORDER BY ord ROWS UNBOUNDED PRECEDING)""")
def w4_cumulative(spark, sf):
    return win.cumulative(panel(spark, sf).join(weather(spark, sf), "date", "left")).select("aoi", "date", grid("gdd").alias("gdd"), grid("rain").alias("rain"))


@query("""SELECT aoi, date, """ + ", ".join(
    f"count(y) OVER w{d} - CASE WHEN y IS NULL THEN 0 ELSE 1 END AS n_{d}, round(coalesce(sum(y) OVER w{d}, 0) - coalesce(y, 0), 8) + 0.0 AS sum_{d}" for d in (7, 14, 30, 60, 120)) + " FROM panel WINDOW " + ", ".join(f"w{d} AS (PARTITION BY aoi, yr ORDER BY ord RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING)" for d in (7, 14, 30, 60, 120)))
def w5_within_days(spark, sf):
    r = win.within_days(panel(spark, sf))
    return r.select("aoi", "date", *(c for d in (7, 14, 30, 60, 120) for c in (f"n_{d}", (F.round(f"sum_{d}", 8) + 0.0).alias(f"sum_{d}"))))


@query("""SELECT aoi, date, lag(y) OVER w AS lag_y, round((y - lag(y) OVER w) * 1048573) / 1048573 AS diff, round(((y - lag(y) OVER w) / (ord - lag(ord) OVER w)) * 1048573) / 1048573 AS per_day FROM panel WHERE y IS NOT NULL WINDOW w AS (PARTITION BY aoi, yr ORDER BY ord)""")
def w6_differences(spark, sf):
    return win.differences(panel(spark, sf)).select("aoi", "date", "lag_y", grid("diff").alias("diff"), grid("per_day").alias("per_day"))


@query(""",
m AS (SELECT aoi, median(y) AS m FROM panel GROUP BY aoi), d AS (SELECT aoi, median(abs(y - m)) AS d FROM panel JOIN m USING (aoi) GROUP BY aoi)
SELECT aoi, date, round((y - m) / greatest(0.03, 1.4826 * d), 7) AS robust_z FROM panel JOIN m USING (aoi) JOIN d USING (aoi)""")
def w7_robust_z(spark, sf):
    return win.robust_z(panel(spark, sf), ["aoi"]).select("aoi", "date", F.round("robust_z", 7).alias("robust_z"))


@query(""",
k AS (SELECT aoi, yr, doy, avg(y) AS y FROM panel WHERE y IS NOT NULL AND num < 3 GROUP BY ALL), g AS (SELECT aoi, yr, unnest(range(1, 367)) AS doy FROM (SELECT DISTINCT aoi, yr FROM k)),
e AS (SELECT g.*, (SELECT max(doy) FROM k WHERE k.aoi = g.aoi AND k.yr = g.yr AND k.doy <= g.doy) AS po, (SELECT min(doy) FROM k WHERE k.aoi = g.aoi AND k.yr = g.yr AND k.doy >= g.doy) AS no FROM g)
SELECT e.aoi, e.yr, CAST(e.doy AS BIGINT) AS doy, round((CASE WHEN no > po THEN a.y + (b.y - a.y) * (e.doy - po) / (no - po) ELSE coalesce(a.y, b.y) END) * 1048573) / 1048573 AS y FROM e LEFT JOIN k a ON a.aoi = e.aoi AND a.yr = e.yr AND a.doy = po LEFT JOIN k b ON b.aoi = e.aoi AND b.yr = e.yr AND b.doy = no""")
def w8_calendar(spark, sf):
    return win.calendar(panel(spark, sf).where("num < 3")).select("aoi", "yr", "doy", grid("y").alias("y"))


@query("""SELECT aoi, date, CAST(ntile(4) OVER (PARTITION BY yr ORDER BY y_true, aoi, date) AS BIGINT) AS quartile FROM panel WHERE y_true IS NOT NULL""")
def w10_quartiles(spark, sf):
    return win.quartile_of_rank(panel(spark, sf).where("y_true IS NOT NULL"), ["yr"], ["y_true", "aoi", "date"]).select("aoi", "date", "quartile")


@query(""",
f AS (SELECT ord, median(y) AS v FROM panel WHERE y IS NOT NULL GROUP BY ord)
SELECT a.ord, round(sum(exp(-pow(a.ord - b.ord, 2) / 18) * b.v) / sum(exp(-pow(a.ord - b.ord, 2) / 18)), 7) AS smooth FROM f a JOIN f b ON abs(a.ord - b.ord) <= 9 GROUP BY a.ord""")
def w11_m4_smooth_factor(spark, sf):
    f = panel(spark, sf).where("y IS NOT NULL").groupBy("ord").agg(F.median("y").alias("v"))
    return rounded(win.smooth_factor(f, "ord", "v"), 7)


@query("""SELECT CAST(k AS BIGINT) AS lag, count(*) AS n, round(corr(a.y, b.y), 8) AS r FROM (SELECT unnest([1, 2, 3, 4, 5, 7, 8, 16, 32]) AS k) JOIN panel a ON a.y IS NOT NULL JOIN panel b ON b.aoi = a.aoi AND b.ord = a.ord + k AND b.y IS NOT NULL GROUP BY k HAVING count(*) >= 20""")
def w12_a21_autocorrelation(spark, sf):
    return rounded(win.autocorrelation(panel(spark, sf)), 8)


@query(_NB + """SELECT date, round((median(y - lerp)) * 1048573) / 1048573 AS shock, count(DISTINCT aoi) AS n_aoi FROM nb WHERE y IS NOT NULL AND NOT edge GROUP BY date HAVING count(DISTINCT aoi) >= 3""")
def w13_loo_shock(spark, sf):
    return gridded(win.shock(win.loo_residual(panel(spark, sf)), ["date"]))


@query(""",
m AS (SELECT aoi, median(y) AS m, stddev_pop(y) AS s FROM panel GROUP BY aoi)
SELECT aoi, round(greatest(0.03, 1.4826 * median(abs(y - m)), 0.15 * any_value(s)), 8) AS scale FROM panel JOIN m USING (aoi) GROUP BY aoi""")
def a8_robust_scale(spark, sf):
    return rounded(agg.robust_scale(panel(spark, sf), ["aoi"], "y", 0.03), 8)


_SENS = """,
r AS (SELECT p.*, y - avg(y) OVER (PARTITION BY aoi) AS resid, temp_c, precip_mm FROM panel p LEFT JOIN weather USING (date)),
g AS (SELECT aoi, count(*) AS n, covar_pop(temp_c, temp_c) AS tt, covar_pop(precip_mm, precip_mm) AS pp, covar_pop(temp_c, precip_mm) AS tp, covar_pop(temp_c, resid) AS tr, covar_pop(precip_mm, resid) AS pr FROM r WHERE resid IS NOT NULL AND temp_c IS NOT NULL GROUP BY aoi),
b AS (SELECT aoi, n, CASE WHEN n >= 12 AND tt * pp - tp * tp > 1e-9 THEN greatest(-0.10, least(-0.008, -abs((pp * tr - tp * pr) / (tt * pp - tp * tp)))) ELSE -0.035 END AS beta_t,
  CASE WHEN n >= 12 AND tt * pp - tp * tp > 1e-9 THEN greatest(0.008, least(0.08, abs((tt * pr - tp * tr) / (tt * pp - tp * tp)))) ELSE 0.025 END AS beta_p FROM g)"""


def _sensitivity(spark, sf):
    from pyspark.sql import Window

    p = panel(spark, sf).join(weather(spark, sf), "date", "left")
    p = p.withColumn("resid", F.col("y") - F.avg("y").over(Window.partitionBy("aoi")))
    return p, agg.sensitivity(p, ["aoi"])


@query(_SENS + """SELECT aoi, n, round(beta_t, 8) AS beta_t, round(beta_p, 8) AS beta_p FROM b""")
def a9_sensitivity(spark, sf):
    return rounded(_sensitivity(spark, sf)[1], 8)


@query(_SENS + """,
c AS (SELECT r.aoi, r.date, y_true, greatest(-1, least(1, y_true + beta_t * 2 / 10 + beta_p * (coalesce(precip_mm, 0) * (0.7 - 1)) / 2)) AS sc FROM r JOIN b USING (aoi))
SELECT date, round((avg(y_true)) * 1048573) / 1048573 AS mean_value, round((avg(sc)) * 1048573) / 1048573 AS mean_scenario, round((median(sc - y_true)) * 1048573) / 1048573 AS median_delta, CAST(count_if(sc - y_true < -0.02) AS BIGINT) AS n_loss FROM c GROUP BY date""")
def p28_a14_a24_counterfactual(spark, sf):
    p, b = _sensitivity(spark, sf)
    b = b.select("aoi", "beta_t", "beta_p", F.lit(10.0).alias("sigma_t"), F.lit(2.0).alias("sigma_p"))
    c = agg.counterfactual(p.withColumn("value", F.col("y_true")), b)
    return gridded(c.groupBy("date").agg(F.avg("value").alias("mean_value"), F.avg("scenario").alias("mean_scenario"), F.median("delta").alias("median_delta"), F.count_if(F.col("delta") < -0.02).alias("n_loss")))


_SHOCK = """,
pr AS (SELECT aoi, CAST(floor((doy - 1) / 30) AS BIGINT) AS bin, median(y) AS m FROM panel GROUP BY ALL),
rs AS (SELECT p.*, CAST(floor((doy - 1) / 30) AS BIGINT) AS bin, y - m AS resid FROM panel p JOIN pr ON pr.aoi = p.aoi AND pr.bin = CAST(floor((doy - 1) / 30) AS BIGINT) WHERE y IS NOT NULL),
sh AS (SELECT date, median(r) AS shock, count(*) AS n_aoi FROM (SELECT date, aoi, median(greatest(-0.5, least(0.5, resid))) AS r FROM rs GROUP BY ALL) GROUP BY date HAVING count(*) >= 3)"""


def _residuals(spark, sf):
    p = panel(spark, sf).where("y IS NOT NULL").withColumn("bin", expr.profile_bin(F.col("doy")))
    prof = p.groupBy("aoi", "bin").agg(F.median("y").alias("m"))
    return p.join(prof, ["aoi", "bin"]).withColumn("resid", F.col("y") - F.col("m"))


@query(_SHOCK + """SELECT date, round((shock) * 1048573) / 1048573 AS shock, n_aoi FROM sh""")
def a10_date_shock(spark, sf):
    return gridded(agg.date_shock(_residuals(spark, sf), "resid"))


@query(_SHOCK + """SELECT aoi, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN greatest(-2, least(2, sum(shock * resid) / (sum(shock * shock) + 0.5))) ELSE 1.0 END, 8) AS loading FROM rs JOIN sh USING (date) GROUP BY aoi""")
def a11_loadings(spark, sf):
    r = _residuals(spark, sf)
    both = r.join(agg.date_shock(r, "resid"), "date").select("aoi", F.col("resid").alias("r"), F.col("shock").alias("f"))
    return rounded(agg.loadings(both), 8)


@query("""SELECT date, """ + ", ".join(f"median({c}) AS {c}_median, round(sum({c}), 8) AS {c}_sum, round(stddev_samp({c}), 7) AS {c}_std, count({c}) AS {c}_n" for c in ("s2", "landsat")) + " FROM panel GROUP BY date")
def a12_a13_channel_stats(spark, sf):
    s = agg.channel_stats(panel(spark, sf), ["date"], ["s2", "landsat"])
    return s.select("date", *(x for c in ("s2", "landsat") for x in (f"{c}_median", F.round(F.col(f"{c}_mean") * F.col(f"{c}_n"), 8).alias(f"{c}_sum"), F.round(f"{c}_std", 7).alias(f"{c}_std"), f"{c}_n")))


@query(_FILL + """,
er AS (SELECT f.pred - p.y_true AS e, CAST(p.yr AS VARCHAR) AS yr, p.source, p.crop_type FROM filled f JOIN panel p USING (aoi, date))
SELECT 'all' AS dimension, NULL AS level, count(*) AS n, round(sqrt(avg(e * e)), 8) AS rmse, round(avg(abs(e)), 8) AS mae FROM er UNION ALL
SELECT 'yr', yr, count(*), round(sqrt(avg(e * e)), 8), round(avg(abs(e)), 8) FROM er GROUP BY yr UNION ALL SELECT 'source', source, count(*), round(sqrt(avg(e * e)), 8), round(avg(abs(e)), 8) FROM er GROUP BY source UNION ALL
SELECT 'crop_type', crop_type, count(*), round(sqrt(avg(e * e)), 8), round(avg(abs(e)), 8) FROM er GROUP BY crop_type""")
def a15_v7_error_summary(spark, sf):
    p = panel(spark, sf)
    both = gapfill.fill(p).join(p.select("aoi", "date", "yr", "source", "crop_type", "y_true"), ["aoi", "date"])
    return rounded(agg.error_summary(both, ["yr", "source", "crop_type"], F.col("pred") - F.col("y_true")), 8)


@query(_SHOCK + """SELECT source, count(*) AS n, round(greatest(-0.04, least(0.04, avg(resid) * count(*) / (count(*) + 8))), 9) AS bias FROM rs GROUP BY source HAVING count(*) >= 40""")
def a17_group_bias(spark, sf):
    return rounded(agg.group_bias(_residuals(spark, sf), "source", 40), 9)


@query(_SHOCK + """,
x AS (SELECT aoi, resid, m AS x FROM rs JOIN pr USING (aoi, bin)), w AS (SELECT sum(x * resid) / sum(x * x) AS a0, avg(x * x) AS m2 FROM x)
SELECT aoi, count(*) AS n, round(greatest(0, least(2, (sum(x * resid) + 100 * any_value(m2) * any_value(a0)) / (sum(x * x) + 100 * any_value(m2)))), 9) + 0.0 AS slope FROM x, w GROUP BY aoi HAVING count(*) >= 40""")
def a28_group_slope(spark, sf):
    r = _residuals(spark, sf).select("aoi", "resid", F.col("m").alias("x"))
    return agg.group_slope(r, "aoi").select("aoi", "n", (F.round("slope", 9) + 0.0).alias("slope"))


@query(_FILL + """,
q AS (SELECT y_true < 0.3 AS t, pred < 0.3 AS p FROM filled JOIN panel USING (aoi, date)),
c AS (SELECT CAST(count_if(t AND p) AS BIGINT) AS tp, CAST(count_if(NOT t AND p) AS BIGINT) AS fp, CAST(count_if(t AND NOT p) AS BIGINT) AS fn, CAST(count_if(NOT t AND NOT p) AS BIGINT) AS tn FROM q)
SELECT *, round(tp / (tp + fp), 10) AS precision, round(tp / (tp + fn), 10) AS recall, round(2 * tp / (2 * tp + fp + fn), 10) AS f1 FROM c""")
def a19_flag_quality(spark, sf):
    p = panel(spark, sf)
    both = gapfill.fill(p).join(p.select("aoi", "date", "y_true"), ["aoi", "date"])
    return rounded(agg.flag_quality(both, F.col("y_true") < 0.3, F.col("pred") < 0.3))


@query("""SELECT crop_type, CAST(count_if(source = 's2') AS BIGINT) AS s2, CAST(count_if(source = 'landsat') AS BIGINT) AS landsat, CAST(count_if(source = 'modis') AS BIGINT) AS modis, count(DISTINCT aoi) AS n_aoi FROM panel GROUP BY crop_type""")
def a20_crosstab(spark, sf):
    p = panel(spark, sf)
    wide = p.groupBy("crop_type").pivot("source", ["s2", "landsat", "modis"]).count()
    return wide.na.fill(0).join(p.groupBy("crop_type").agg(F.count_distinct("aoi").alias("n_aoi")), "crop_type")


@query("""SELECT aoi, count(*) AS n_rows, min(date) AS first_day, max(date) AS last_day, count(y) AS n_observed, count(DISTINCT doy) AS n_doys, min(y) AS y_min, max(y) AS y_max, count(*) - count(DISTINCT date) AS repeated FROM panel GROUP BY aoi""")
def a22_a23_a25_passport(spark, sf):
    return panel(spark, sf).groupBy("aoi").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("y").alias("n_observed"), F.count_distinct("doy").alias("n_doys"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), (F.count("*") - F.count_distinct("date")).alias("repeated"))


@query("""SELECT aoi, date, n AS others_n, CASE WHEN n > 0 THEN round(s, 8) + 0.0 END AS others_sum FROM (SELECT aoi, date, count(y) OVER (PARTITION BY date) - count(y) OVER (PARTITION BY date, aoi) AS n, sum(y) OVER (PARTITION BY date) - coalesce(sum(y) OVER (PARTITION BY date, aoi), 0) AS s FROM panel)""")
def a30_leave_own_out(spark, sf):
    d = agg.leave_own_out(panel(spark, sf))
    return d.select("aoi", "date", "others_n", (F.round(F.col("others_mean") * F.col("others_n"), 8) + 0.0).alias("others_sum"))


@query(_SHOCK + """,
nr AS (SELECT * FROM (SELECT q.aoi, q.date, abs(k.ord - q.ord) AS d, k.resid, row_number() OVER (PARTITION BY q.aoi, q.date ORDER BY abs(k.ord - q.ord), k.ord) AS r FROM panel q JOIN rs k ON k.aoi = q.aoi AND k.yr = q.yr AND abs(k.ord - q.ord) <= 120 WHERE q.gap) WHERE r <= 8)
SELECT aoi, date, count(*) AS n, round(sum(exp(-d / 45.0) * greatest(-0.3, least(0.3, resid))) / sum(exp(-d / 45.0)), 8) AS state FROM nr GROUP BY ALL HAVING count(*) >= 2""")
def a31_state(spark, sf):
    r = _residuals(spark, sf).select("aoi", "yr", F.col("ord").alias("k_ord"), "resid")
    q = panel(spark, sf).where("gap").select("aoi", "yr", "date", "ord")
    return rounded(win.state(q.join(r, ["aoi", "yr"]), ["aoi", "date"], F.abs(F.col("k_ord") - F.col("ord")), F.col("resid")), 8)


@query("""SELECT aoi, date, yr, row_number() OVER (PARTITION BY aoi, yr ORDER BY md5('7:' || aoi || '|' || strftime(date, '%Y-%m-%d'))) <= greatest(1, round_even(0.15 * count(*) OVER (PARTITION BY aoi, yr), 0)) AS masked,
  CAST((row_number() OVER (PARTITION BY aoi ORDER BY md5(aoi || '|' || strftime(date, '%Y-%m-%d'))) - 1) % 5 AS BIGINT) AS fold FROM panel""")
def v2_v4_masks_and_folds(spark, sf):
    k = expr.key(F.col("aoi"), F.col("date"))
    return agg.folds(agg.stratified_mask(panel(spark, sf), ["aoi", "yr"], k, 0.15, 7), ["aoi"], k).select("aoi", "date", "yr", "masked", "fold")


@query(""",
h AS (SELECT p.*, coalesce(hit, false) AND yr = 1998 AND y_true IS NOT NULL AS hidden FROM panel p LEFT JOIN (SELECT DISTINCT aoi, doy, true AS hit FROM panel WHERE gap) USING (aoi, doy))
SELECT aoi, date, hidden, CASE WHEN NOT hidden THEN s2 END AS s2, CASE WHEN NOT hidden THEN y END AS y, y_true AS _truth FROM h""")
def v1_v10_f7_fold(spark, sf):
    return agg.project_fold(panel(spark, sf), 1998).select("aoi", "date", "hidden", "s2", "y", "_truth")


@query(""",
pr AS (SELECT aoi, date, CASE WHEN num = 3 THEN 'NaN'::DOUBLE ELSE y_true END AS pred FROM panel WHERE num <> 5 UNION ALL SELECT aoi, date, 0.1 FROM panel WHERE num = 7),
k AS (SELECT DISTINCT aoi, date FROM panel WHERE gap), g AS (SELECT aoi, date, count(*) AS n, count_if(pred IS NULL OR NOT isfinite(pred)) AS bad FROM pr GROUP BY ALL)
SELECT CAST(count_if(g.n IS NULL) AS BIGINT) AS missing, CAST(count_if(k.aoi IS NULL) AS BIGINT) AS extra, CAST(count_if(g.n > 1) AS BIGINT) AS repeated, CAST(sum(coalesce(bad, 0)) AS BIGINT) AS not_finite FROM k FULL JOIN g ON k.aoi = g.aoi AND k.date = g.date""")
def v6_contract(spark, sf):
    p = panel(spark, sf)
    pred = p.where("num <> 5").select("aoi", "date", F.when(F.col("num") == 3, F.lit(float("nan"))).otherwise(F.col("y_true")).alias("pred"))
    return agg.contract(pred.unionByName(p.where("num = 7").select("aoi", "date", F.lit(0.1).alias("pred"))), p.where("gap"))


@query(""",
u AS (SELECT aoi, date, exp(-0.5 * pow(least(abs(doy - 100), 366 - abs(doy - 100)) / 5, 2)) + 0.025 AS w, (CAST('0x' || left(md5(aoi || '|' || strftime(date, '%Y-%m-%d')), 12) AS BIGINT) + 1) / (pow(2, 48) + 1) AS u FROM panel)
SELECT aoi, date FROM (SELECT aoi, date, row_number() OVER (PARTITION BY aoi ORDER BY -ln(u) / w) AS k FROM u) WHERE k <= 10""")
def v9_weighted_sample(spark, sf):
    w = F.exp(-0.5 * F.pow(expr.circular_days(F.col("doy"), F.lit(100)) / 5, 2)) + 0.025
    return agg.weighted_sample(panel(spark, sf), ["aoi"], w, expr.key(F.col("aoi"), F.col("date")), 10).select("aoi", "date")


@query("""SELECT aoi, date, CASE WHEN gap_days <= 7 THEN '<=7' WHEN gap_days <= 15 THEN '8-15' WHEN gap_days <= 30 THEN '16-30' WHEN gap_days IS NOT NULL THEN '>30' END AS bracket_bin,
  round(-(CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END + CASE WHEN 1 - y > 0 THEN (1 - y) * ln(1 - y) ELSE 0 END), 8) AS entropy, round(least(z + 1, 0), 7) + 0.0 AS low, round(greatest(z - 1, 0), 7) + 0.0 AS high, z < -2 AS deep
  FROM (SELECT aoi, date, y, doy % 41 AS gap_days, (y - 0.5) * 8 AS z FROM panel WHERE y IS NOT NULL AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND crop_type IN ('ASIA', 'EUROPE') AND y BETWEEN 0.05 AND 0.95)""")
def p26_p32_p33_f2_f5(spark, sf):
    p = panel(spark, sf).where("y IS NOT NULL AND date BETWEEN DATE'1996-01-01' AND DATE'1999-12-31' AND crop_type IN ('ASIA', 'EUROPE') AND y BETWEEN 0.05 AND 0.95")
    t = expr.tail_gates((F.col("y") - 0.5) * 8)
    return p.select("aoi", "date", expr.cut(F.col("doy") % 41, [7, 15, 30], ["<=7", "8-15", "16-30", ">30"]).alias("bracket_bin"), F.round(expr.entropy(F.col("y"), 1 - F.col("y")), 8).alias("entropy"), (F.round(t["low"], 7) + 0.0).alias("low"), (F.round(t["high"], 7) + 0.0).alias("high"), t["deep"].alias("deep"))


@query("""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""", base="")
def x_daily_events(spark, sf):
    """The batch twin of the streaming roll-up."""
    (e,) = tables(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _estimated(name: str, **options):
    def run(spark, sf):
        return rounded(estimators.estimate(panel(spark, sf), name, **options), 6)

    run.__doc__ = f"Predictions for gap rows by {name}; SQL can't express it, tests compare it with NumPy."
    return run


ROWS_ONLY = {
    "m3_lagged_cubic": lambda spark, sf: rounded(estimators.lagged_cubic(panel(spark, sf), gapfill.sensor_maps(panel(spark, sf))), 6),
    "m4_median": _estimated("median"), "m4_loess": _estimated("loess"), "m5_gaussian_process": _estimated("gp"), "m5_matern52_process": _estimated("gp", kind="matern52"), "m5_rbf_process": _estimated("gp", kind="rbf"), "m5_kalman": _estimated("kalman"),
    "m5_fourier": _estimated("fourier"), "m5_bumps": _estimated("bumps"), "m15_pchip": _estimated("pchip"), "m15_spline": _estimated("spline"),
}


_FEATURES = ["prev_y", "next_y", "left_days", "right_days", "lerp", "sin1", "cos1"]


def _features(spark, sf):
    n = win.neighbours(panel(spark, sf)).withColumns(dict(zip(("sin1", "cos1"), expr.harmonics(F.col("doy"), 1))))
    # Rows far from what is known count less.
    return n.withColumns({f: F.col(f).cast("double") for f in _FEATURES} | {"weight": 1 / (1 + F.coalesce("gap_days", F.lit(30)) / 30)})


def _trees(kind: str, **options):
    def run(spark, sf):
        n = _features(spark, sf)
        model = estimators.trees(n.where("y IS NOT NULL"), _FEATURES, "y", kind, **options)
        return model.transform(n.where("gap")).select("aoi", "date", F.round("prediction", 6).alias("pred"))

    run.__doc__ = f"Gap rows by {kind} on neighbours and season, fitted on known rows, whose neighbours leave them out."
    return run


def m6_source_experts(spark, sf):
    """Boosted trees for each sensor, mixed by the posterior."""
    n = _features(spark, sf)
    asked = gapfill.query_posterior(n.where("gap").select("aoi", "crop_type", "date", "yr", "doy", *_FEATURES), panel(spark, sf))
    return estimators.source_experts(n.where("y IS NOT NULL"), asked, _FEATURES, "y", rounds=10).select("aoi", "date", F.round("pred", 6).alias("pred"))


def m6_quantile(spark, sf):
    """The upper quartile by boosting on the pinball loss."""
    n = _features(spark, sf)
    asked = n.where("gap").select("aoi", "date", *_FEATURES)
    return estimators.boosted_quantile(n.where("y IS NOT NULL"), asked, _FEATURES, "y", 0.75, rounds=6).select("aoi", "date", F.round("pred", 6).alias("pred"))


ROWS_ONLY |= {
    "m6_forest": _trees("forest"), "m6_extra_trees": _trees("extra"), "m6_boosted": _trees("gbt", rounds=20, weight="weight"), "m6_boosted_absolute": _trees("absolute", rounds=10),
    "m6_source_experts": m6_source_experts, "m6_quantile": m6_quantile,
}


@query(_FILL + """SELECT aoi, date, round(greatest(-0.2, least(1.1, 0.8 * pred + 0.2 * lerp)) * 1048573) / 1048573 AS blend, least(abs(doy - 200), 366 - abs(doy - 200)) AS far
  FROM filled JOIN (SELECT aoi, date, doy, coalesce(pv + (nv - pv) / (no - po) * (ord - po), pv, nv) AS lerp FROM (
    SELECT n.*, a.y AS pv, b.y AS nv FROM (SELECT *, (SELECT max(k.ord) FROM panel k WHERE k.aoi = p.aoi AND k.yr = p.yr AND k.y IS NOT NULL AND k.ord < p.ord) AS po, (SELECT min(k.ord) FROM panel k WHERE k.aoi = p.aoi AND k.yr = p.yr AND k.y IS NOT NULL AND k.ord > p.ord) AS no FROM panel p WHERE gap) n
    LEFT JOIN panel a ON a.aoi = n.aoi AND a.ord = n.po LEFT JOIN panel b ON b.aoi = n.aoi AND b.ord = n.no)) USING (aoi, date)""")
def m9_blend(spark, sf):
    p = panel(spark, sf)
    n = win.neighbours(p).where("gap").select("aoi", "date", "doy", "lerp")
    both = gapfill.fill(p).join(n, ["aoi", "date"])
    return both.select("aoi", "date", (F.round(estimators.blend({"pred": 0.8, "lerp": 0.2}) * 1048573) / 1048573).alias("blend"), expr.circular_days(F.col("doy"), F.lit(200)).alias("far"))


@query("""SELECT q.aoi, q.date, round((sum((9 - abs(q.num - k.num)) * k.y) / sum(9 - abs(q.num - k.num))) * 1048573) / 1048573 AS kernel FROM panel q JOIN panel k ON k.date = q.date AND k.crop_type = q.crop_type AND k.y IS NOT NULL AND abs(q.num - k.num) BETWEEN 1 AND 8 WHERE q.gap GROUP BY ALL""")
def m16_distance_kernel(spark, sf):
    p = panel(spark, sf)
    k = joins.near_ids(p.where("y IS NOT NULL").select("date", "crop_type", "num", F.col("num").alias("k_num"), F.col("y").alias("k_y")), 8)
    w = 9 - F.abs(F.col("num") - F.col("k_num"))
    pairs = p.where("gap").select("aoi", "num", "date", "crop_type").join(k, ["date", "crop_type", "num"])
    return gridded(pairs.groupBy("aoi", "date").agg((F.sum(w * F.col("k_y")) / F.sum(w)).alias("kernel")))


_WP = """,
sn AS (SELECT *, CAST(floor(doy / 8) AS BIGINT) AS b8 FROM panel WHERE y IS NOT NULL AND source <> 'none'),
""" + ",\n".join(f"w{k} AS (SELECT {by}, count(*) AS n, count_if(source = 's2') AS a, count_if(source = 'landsat') AS b, count_if(source = 'modis') AS c FROM sn GROUP BY ALL)" for k, by in enumerate(("yr, doy", "aoi, doy", "doy", "aoi, b8"))) + """,
wj AS (SELECT q.aoi, q.date, q.ord, """ + ", ".join(f"coalesce({f} * sqrt(w{k}.n), 0) AS f{k}, coalesce(w{k}.a / w{k}.n, 0) AS a{k}, coalesce(w{k}.b / w{k}.n, 0) AS b{k}, coalesce(w{k}.c / w{k}.n, 0) AS c{k}" for k, f in enumerate((8, 3, 1, 1))) + """
  FROM panel q LEFT JOIN w0 ON w0.yr = q.yr AND w0.doy = q.doy LEFT JOIN w1 ON w1.aoi = q.aoi AND w1.doy = q.doy LEFT JOIN w2 ON w2.doy = q.doy LEFT JOIN w3 ON w3.aoi = q.aoi AND w3.b8 = CAST(floor(q.doy / 8) AS BIGINT) WHERE q.gap),
wp AS (SELECT aoi, date, """ + ", ".join(f"CASE WHEN f0 + f1 + f2 + f3 > 0 THEN (f0 * {x}0 + f1 * {x}1 + f2 * {x}2 + f3 * {x}3) / (f0 + f1 + f2 + f3) ELSE {d} END AS p_{s}" for x, s, d in (("a", "s2", 0.4), ("b", "landsat", 0.4), ("c", "modis", 0.2))) + " FROM wj)"


def _weighted_posterior(spark, sf):
    p = panel(spark, sf)
    return gapfill.weighted_posterior(p.where("gap").select("aoi", "date", "yr", "doy"), p)


@query(_WP + """SELECT aoi, date, round(p_s2 * 1048573) / 1048573 AS p_s2, round(p_landsat * 1048573) / 1048573 AS p_landsat, round(p_modis * 1048573) / 1048573 AS p_modis FROM wp""")
def a27_weighted_posterior(spark, sf):
    return gridded(_weighted_posterior(spark, sf).select("aoi", "date", "p_s2", "p_landsat", "p_modis"))


@query(_WP + _SHOCK + """,
cs AS (SELECT coalesce(avg(CASE WHEN source = 's2' THEN resid END), 0) AS c1, coalesce(avg(CASE WHEN source = 'landsat' THEN resid END), 0) AS c2, coalesce(avg(CASE WHEN source = 'modis' THEN resid END), 0) AS c3 FROM rs)
SELECT aoi, date, round((p_s2 * c1 + p_landsat * c2 + p_modis * c3) * 1048573) / 1048573 AS correction FROM wp, cs""")
def a32_expected_correction(spark, sf):
    return gridded(gapfill.expected_correction(_weighted_posterior(spark, sf), _residuals(spark, sf)).select("aoi", "date", "correction"))
