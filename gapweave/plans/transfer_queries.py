"""Queries of shocks by group, routing, peers, other years and nested validation, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import aggregates as agg
from ..operators import estimators, gapfill, joins
from ..operators import windows as win
from ..storage import saved
from .core_queries import _FILL, gridded, query, rounded
from .panel import panel, weather
from .stat_queries import _HR, _NB, _SHOCK, ROWS_ONLY, _residuals

_BINS = ["<=7", "8-15", "16-30", "31-365", ">365"]
_LOO = _NB + """,
lr AS (SELECT aoi, num, date, ord, crop_type, source, y - lerp AS resid FROM nb WHERE y IS NOT NULL AND NOT edge)"""


def _g(sql: str, name: str) -> str:
    return f"round(({sql}) * 1048573) / 1048573 AS {name}"


@query(_FILL + _NB + _HR + """,
er AS (SELECT f.pred - p.y_true AS e, CAST(p.yr AS VARCHAR) AS yr, p.source, p.crop_type, CAST(run_len AS VARCHAR) AS run_len, CAST(edge AS VARCHAR) AS edge,
  CASE WHEN bracket <= 7 THEN '<=7' WHEN bracket <= 15 THEN '8-15' WHEN bracket <= 30 THEN '16-30' WHEN bracket <= 365 THEN '31-365' WHEN bracket IS NOT NULL THEN '>365' END AS bracket_bin
  FROM filled f JOIN panel p USING (aoi, date) JOIN (SELECT aoi, date, edge, left_days + right_days AS bracket FROM nb) USING (aoi, date) JOIN (SELECT aoi, date, run_len FROM hr) USING (aoi, date))
SELECT 'all' AS dimension, NULL AS level, count(*) AS n, round(sqrt(avg(e * e)), 8) AS rmse, round(avg(abs(e)), 8) AS mae FROM er""" + "".join(
    f" UNION ALL SELECT '{d}', {d}, count(*), round(sqrt(avg(e * e)), 8), round(avg(abs(e)), 8) FROM er GROUP BY {d}" for d in ("yr", "source", "crop_type", "run_len", "edge", "bracket_bin"))
    + " UNION ALL SELECT 'bracket_bin', b, 0, NULL, NULL FROM (VALUES ('<=7'), ('8-15'), ('16-30'), ('31-365'), ('>365')) v(b) WHERE b NOT IN (SELECT bracket_bin FROM er WHERE bracket_bin IS NOT NULL)")
def a15_error_bins(spark, sf):
    p = panel(spark, sf)
    shape = win.neighbours(p).where("gap").select("aoi", "date", "yr", "source", "crop_type", "y_true", "edge", expr.cut(F.col("bracket"), [7, 15, 30, 365], _BINS).alias("bracket_bin"))
    both = gapfill.fill(p).join(shape, ["aoi", "date"]).join(win.hidden_runs(p).select("aoi", "date", "run_len"), ["aoi", "date"])
    return rounded(agg.error_summary(both, ["yr", "source", "crop_type", "run_len", "edge", "bracket_bin"], F.col("pred") - F.col("y_true"), {"bracket_bin": _BINS}), 8)


@query(_LOO + "".join(
    f"{' UNION ALL ' if d == 'source' else ''} SELECT '{d}' AS kind, date, {d} AS level, {_g('median(r)', 'shock')}, count(*) AS n_aoi FROM (SELECT date, {d}, aoi, median(resid) AS r FROM lr GROUP BY ALL) GROUP BY date, {d} HAVING count(*) >= 3" for d in ("crop_type", "source")))
def w13_group_shocks(spark, sf):
    r = win.loo_residual(panel(spark, sf))
    part = lambda d: win.shock(r, ["date", d]).select(F.lit(d).alias("kind"), "date", F.col(d).alias("level"), "shock", "n_aoi")
    return gridded(part("crop_type").unionByName(part("source")))


@query(_LOO + """,
np AS (SELECT q.aoi, q.ord, k.aoi AS p, k.resid AS r, exp(-0.5 * pow((q.ord - k.ord) / 3.5, 2)) AS w FROM panel q JOIN lr k ON k.ord BETWEEN q.ord - 8 AND q.ord + 8 AND abs(k.num - q.num) BETWEEN 1 AND 8 WHERE q.gap),
nc AS (SELECT *, sum(w) OVER (PARTITION BY aoi, ord ORDER BY r, p, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY aoi, ord) AS whole FROM np),
ne AS (SELECT aoi, ord, min(CASE WHEN c >= 0.1 * whole THEN r END) AS lo, min(CASE WHEN c >= 0.9 * whole THEN r END) AS hi FROM nc GROUP BY ALL)
SELECT aoi, ord, """ + _g("sum(w * greatest(lo, least(hi, r))) / sum(w)", "shock_near") + """, count(*) AS n FROM np JOIN ne USING (aoi, ord) GROUP BY ALL HAVING count(*) >= 3""")
def w13_near_shock(spark, sf):
    p = panel(spark, sf)
    return gridded(win.near_shock(p.where("gap"), win.loo_residual(p)))


_RADII = (1, 2, 4)
_MODE = "CASE WHEN {0} = greatest({0}, {1}, {2}) THEN 's2' WHEN {1} = greatest({0}, {1}, {2}) THEN 'landsat' ELSE 'modis' END"


@query(_FILL + """,
sc AS (SELECT q.aoi, q.date, min(abs(q.num - k.num)) AS nearest, """ + ", ".join(f"count(*) FILTER (WHERE abs(q.num - k.num) <= {r} AND k.source = '{s}') AS {s}_{r}" for r in _RADII for s in expr.SENSORS) + """
  FROM panel q LEFT JOIN panel k ON k.date = q.date AND k.crop_type = q.crop_type AND k.y IS NOT NULL AND abs(q.num - k.num) BETWEEN 1 AND 4 WHERE q.gap GROUP BY ALL),
sq AS (SELECT *, """ + ", ".join(f"pow(greatest(1e-9, least(1.0, ({s}_4 + 0.25 * p_{s}) / (s2_4 + landsat_4 + modis_4 + 0.25 * (p_s2 + p_landsat + p_modis)))), 2) AS w_{s}" for s in expr.SENSORS) + """ FROM sc JOIN (SELECT aoi, date, p_s2, p_landsat, p_modis FROM post) USING (aoi, date))
SELECT aoi, date, nearest, CASE WHEN nearest <= 2 THEN 0.5 WHEN nearest <= 8 THEN 0.4 ELSE 0.3 END::DOUBLE AS trust, CASE """ + " ".join(
    f"WHEN s2_{r} + landsat_{r} + modis_{r} >= 1 AND greatest(s2_{r}, landsat_{r}, modis_{r}) >= 0.67 * (s2_{r} + landsat_{r} + modis_{r}) THEN {_MODE.format(f's2_{r}', f'landsat_{r}', f'modis_{r}')}" for r in _RADII)
    + f" ELSE {_MODE.format('p_s2', 'p_landsat', 'p_modis')} END AS route, " + ", ".join(_g(f"w_{s} / (w_s2 + w_landsat + w_modis)", f"q_{s}") for s in expr.SENSORS) + " FROM sq")
def m7_route(spark, sf):
    p = panel(spark, sf)
    both = estimators.source_counts(p, _RADII).join(gapfill.query_posterior(p.where("gap").select("aoi", "crop_type", "date", "yr", "doy"), p), ["aoi", "date"])
    post = {s: F.col(f"p_{s}") for s in expr.SENSORS}
    counts = [{s: F.col(f"{s}_{r}") for s in expr.SENSORS} for r in _RADII]
    soft = estimators.soft_route(counts[-1], post)
    return both.select("aoi", "date", "nearest", estimators.trust(F.col("nearest")).alias("trust"), estimators.route(counts, post).alias("route"), *((F.round(soft[s] * 1048573) / 1048573).alias(f"q_{s}") for s in expr.SENSORS))


@query(_NB.replace("FROM panel", "FROM zs") .replace("JOIN panel", "JOIN zs").replace("panel p)", "zs p)").replace(".y IS", ".z IS").replace("a.y AS pv, b.y AS nv", "a.z AS pv, b.z AS nv").replace(",\nnb0", """,
zn AS (SELECT aoi, CAST(floor((doy - 1) / 30) AS BIGINT) AS bin, avg(y) AS m, greatest(0.02, coalesce(stddev_pop(y), 0)) AS s FROM panel WHERE y IS NOT NULL GROUP BY ALL),
zs AS (SELECT p.*, m, s, (y - m) / s AS z FROM panel p LEFT JOIN zn ON zn.aoi = p.aoi AND zn.bin = CAST(floor((p.doy - 1) / 30) AS BIGINT)),
nb0""", 1) + "SELECT aoi, date, " + _g("CASE WHEN m + s * lerp IS NOT NULL THEN greatest(-0.2, least(1.1, m + s * lerp)) END", "pred") + " FROM nb WHERE gap")
def m10_z_space(spark, sf):
    return gridded(estimators.z_space(panel(spark, sf)))


@query(_SHOCK + """,
pp AS (SELECT a.aoi, b.aoi AS peer, a.date, a.resid AS z, b.resid AS x FROM rs a JOIN rs b ON a.date = b.date AND abs(a.num - b.num) BETWEEN 1 AND 4),
pm AS (SELECT aoi, peer, median(x) AS xm, median(z) AS zm, corr(x, z) AS c FROM pp GROUP BY ALL HAVING count(*) >= 30 AND corr(x, z) IS NOT NULL),
pf AS (SELECT aoi, peer, xm, zm, c, greatest(-2, least(2, sum((x - xm) * (z - zm)) / (sum(pow(x - xm, 2)) + 10))) AS b FROM pp JOIN pm USING (aoi, peer) GROUP BY ALL),
pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY round(c, 12) DESC, peer) AS k FROM pf) WHERE k <= 8),
pq AS (SELECT q.aoi, q.date, pr.m, greatest(c, 0.05) AS w, zm + b * (k.resid - xm) AS v FROM panel q JOIN pr ON pr.aoi = q.aoi AND pr.bin = CAST(floor((q.doy - 1) / 30) AS BIGINT) AND pr.m IS NOT NULL JOIN pb ON pb.aoi = q.aoi JOIN rs k ON k.aoi = pb.peer AND k.date = q.date WHERE q.gap)
SELECT aoi, date, """ + _g("any_value(m) + sum(w * v) / sum(w)", "pred") + ", count(*) AS n_peers FROM pq GROUP BY ALL")
def m11_peer_ridge(spark, sf):
    return gridded(estimators.peer_ridge(panel(spark, sf)))


@query(_FILL + """,
cr AS (SELECT p.source, f.pred, p.y_true AS truth, p.y_true - f.pred AS r FROM filled f JOIN panel p USING (aoi, date) WHERE p.y_true IS NOT NULL),
ce AS (SELECT source, quantile_cont(truth, [0.01, 0.99]) AS t, quantile_cont(r, [0.1, 0.9]) AS q FROM cr GROUP BY source),
cb AS (SELECT source, count(*) AS n, regr_intercept(truth, pred) AS a, regr_slope(truth, pred) AS b, regr_intercept(greatest(t[1], least(t[2], truth)), pred) AS wa, regr_slope(greatest(t[1], least(t[2], truth)), pred) AS wb,
  median(r) AS m, avg(CASE WHEN r BETWEEN q[1] AND q[2] THEN r END) AS tr FROM cr JOIN ce USING (source) GROUP BY source)
SELECT source, n, """ + ", ".join(_g(f"CASE WHEN n < 20 OR b IS NULL THEN {none} ELSE greatest({lo}, least({hi}, {c})) END", name) for c, lo, hi, none, name in (
    ("a", -0.08, 0.08, 0.0, "a"), ("b", 0.85, 1.15, 1.0, "b"), ("wa", -0.08, 0.08, 0.0, "robust_a"), ("wb", 0.85, 1.15, 1.0, "robust_b"))) + ", " + _g("greatest(-0.04, least(0.04, m))", "bias_median") + ", " + _g("tr", "trimmed_mean") + " FROM cb")
def a17_corrections(spark, sf):
    p = panel(spark, sf)
    both = gapfill.fill(p).join(p.select("aoi", "date", "source", F.col("y_true").alias("truth")), ["aoi", "date"])
    return gridded(agg.corrections(both, ["source"]))


_STACKED = _FILL + _NB + _SHOCK + """,
nr AS (SELECT * FROM (SELECT q.aoi, q.date, abs(k.ord - q.ord) AS d, k.resid, row_number() OVER (PARTITION BY q.aoi, q.date ORDER BY abs(k.ord - q.ord), k.ord) AS r FROM panel q JOIN rs k ON k.aoi = q.aoi AND k.yr = q.yr AND abs(k.ord - q.ord) <= 120 WHERE q.gap) WHERE r <= 8),
st AS (SELECT aoi, date, sum(exp(-d / 45.0) * greatest(-0.3, least(0.3, resid))) / sum(exp(-d / 45.0)) AS state FROM nr GROUP BY ALL HAVING count(*) >= 2),
pe AS (SELECT q.aoi, q.date, avg(k.y) AS peer FROM panel q JOIN panel k ON k.date = q.date AND k.y IS NOT NULL AND abs(q.num - k.num) BETWEEN 1 AND 4 WHERE q.gap GROUP BY ALL),
zz0 AS (SELECT p.aoi, p.date, p.yr, p.y_true AS truth, f.pred, n.lerp, pe.peer, coalesce(sh.shock, 0) AS s, coalesce(st.state, 0) AS t FROM panel p JOIN filled f ON f.aoi = p.aoi AND f.date = p.date JOIN nb n ON n.aoi = p.aoi AND n.date = p.date
  LEFT JOIN pe ON pe.aoi = p.aoi AND pe.date = p.date LEFT JOIN sh ON sh.date = p.date LEFT JOIN st ON st.aoi = p.aoi AND st.date = p.date WHERE p.gap AND p.y_true IS NOT NULL)"""


def _stacked(spark, sf):
    """Gap rows with two base predictions, the mean of near AOIs that day, the date's shock and the AOI's state."""
    p, r = panel(spark, sf), _residuals(spark, sf)
    q = p.where("gap")
    state = win.state(q.select("aoi", "yr", "date", "ord").join(r.select("aoi", "yr", F.col("ord").alias("k_ord"), "resid"), ["aoi", "yr"]), ["aoi", "date"], F.abs(F.col("k_ord") - F.col("ord")), F.col("resid"))
    base = win.neighbours(p).where("gap").select("aoi", "date", "yr", "ord", F.col("y_true").alias("truth"), "lerp").join(gapfill.fill(p), ["aoi", "date"])
    peers = joins.same_date_peers(p, (4,)).select("aoi", "date", F.col("mean_4").alias("peer"))
    return base.join(peers, ["aoi", "date"], "left").join(agg.date_shock(r, "resid").select("date", "shock"), "date", "left").join(state.select("aoi", "date", "state"), ["aoi", "date"], "left")


@query(_STACKED + """,
zb AS (SELECT *, 'lerp' AS base, lerp AS bv FROM zz0 UNION ALL SELECT *, 'pred', pred FROM zz0),
lg AS (SELECT yr, base, weight, s, t, truth - CASE WHEN peer IS NULL THEN bv ELSE (1 - weight) * bv + weight * peer END AS r FROM zb, (SELECT unnest([0.05::DOUBLE, 0.1, 0.15]) AS weight) WHERE bv IS NOT NULL),
h0 AS (SELECT yr, base, weight, count(*) AS n, sum(s * s) AS ss, sum(s * t) AS st, sum(t * t) AS tt, sum(r * s) AS rs, sum(r * t) AS rt, sum(r * r) AS rr FROM lg GROUP BY ALL),
h1 AS (SELECT *, """ + ", ".join(f"sum({k}) OVER (PARTITION BY base, weight) - {k} AS o_{k}" for k in ("n", "ss", "st", "tt", "rs", "rt", "rr")) + """ FROM h0),
h2 AS (SELECT *, us * o_ss + 1e-4 AS a1, ut * o_tt + 1e-4 AS a2, us * ut * o_st AS a3, us * o_rs AS b1, ut * o_rt AS b2 FROM h1, (VALUES ('none', 0, 0), ('shock', 1, 0), ('state', 0, 1), ('joint', 1, 1)) m(mode, us, ut) WHERE o_n > 0),
h3 AS (SELECT *, us * CASE WHEN o_n < 30 THEN 0.15 ELSE greatest(0, least(0.4, (a2 * b1 - a3 * b2) / (a1 * a2 - a3 * a3))) END::DOUBLE AS a, ut * CASE WHEN o_n < 30 THEN CASE WHEN us > 0 THEN -0.05 ELSE 0 END ELSE greatest(-0.4, least(0.1, (a1 * b2 - a3 * b1) / (a1 * a2 - a3 * a3))) END::DOUBLE AS b FROM h2),
h4 AS (SELECT *, (o_rr - 2 * a * o_rs - 2 * b * o_rt + a * a * o_ss + 2 * a * b * o_st + b * b * o_tt) / o_n AS train_mse, (rr - 2 * a * rs - 2 * b * rt + a * a * ss + 2 * a * b * st + b * b * tt) / n AS test_mse FROM h3)
SELECT yr, base, weight, mode, """ + ", ".join(_g(f"{c}", c) for c in ("a", "b", "train_mse", "test_mse")) + """, n FROM (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY round(train_mse, 12), base, weight, mode) AS k FROM h4) WHERE k = 1""")
def a33_nested_rules(spark, sf):
    got = agg.nested_rules(_stacked(spark, sf), "yr", "truth", ["lerp", "pred"], "peer")
    return gridded(got).withColumn("weight", F.round("weight", 2))


@query("""SELECT aoi, date, row_number() OVER (ORDER BY md5('43:' || aoi || '|' || strftime(date, '%Y-%m-%d'))) <= floor(0.15::DOUBLE * count(*) OVER ()) AS masked FROM panel WHERE y_true IS NOT NULL""")
def v3_exact_mask(spark, sf):
    return agg.exact_mask(panel(spark, sf).where("y_true IS NOT NULL"), expr.key(F.col("aoi"), F.col("date")), 0.15, 43).select("aoi", "date", "masked")


@query(_SHOCK + """,
x AS (SELECT rs.aoi, rs.date, rs.resid, pr.m AS x, rs.aoi || '|' || strftime(rs.date, '%Y-%m-%d') AS k FROM rs JOIN pr USING (aoi, bin)),
mk AS (SELECT * FROM (SELECT seed AS part, aoi, date, resid, x, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || k)) AS r, count(*) OVER (PARTITION BY seed) AS n FROM x, (SELECT unnest(range(1, 4)) AS seed)) WHERE r <= floor(0.3::DOUBLE * n)),
ft AS (SELECT p.part, count(*) AS n_train, sum(t.x * t.resid) / (sum(t.x * t.x) + 1) AS slope FROM (SELECT DISTINCT part FROM mk) p JOIN mk t ON t.part <> p.part WHERE NOT EXISTS (SELECT 1 FROM mk o WHERE o.part = p.part AND o.aoi = t.aoi AND o.date = t.date) GROUP BY p.part)
SELECT part, count(*) AS n_test, any_value(n_train) AS n_train, """ + _g("any_value(slope)", "slope") + ", " + _g("sqrt(avg(pow(resid - slope * x, 2)))", "rmse") + " FROM mk JOIN ft USING (part) GROUP BY part")
def v5_leave_part_out(spark, sf):
    r = _residuals(spark, sf).select("aoi", "date", "resid", F.col("m").alias("x"))
    parts = [agg.exact_mask(r, expr.key(F.col("aoi"), F.col("date")), 0.3, s).where("masked").withColumn("part", F.lit(s).cast("long")) for s in (1, 2, 3)]
    return gridded(agg.leave_part_out(parts[0].unionByName(parts[1]).unionByName(parts[2]), "part", ["aoi", "date"]))


def m8_pair_predict(spark, sf):
    """Gap rows from the pair with the smallest cross-validated error that has a value that day."""
    p = panel(spark, sf)
    seen = p.where("y IS NOT NULL").select("date", F.col("aoi").alias("peer"), F.col("y").alias("x"))
    cand = p.where("gap").select("aoi", "date").join(estimators.pair_models(p), "aoi").join(seen, ["date", "peer"])
    best = cand.groupBy("aoi", "date").agg(F.min_by(F.struct("peer", (F.col("a") + F.col("b") * F.col("x")).alias("pred")), F.struct("cv_rmse", "peer")).alias("_"))
    return rounded(best.select("aoi", "date", "_.peer", "_.pred"), 6)


def m10_cross_year(spark, sf):
    p = panel(spark, sf)
    local = gapfill.fill(p).join(p.select("aoi", "yr", "ord", "date"), ["aoi", "date"])
    return rounded(estimators.cross_year(p, local), 6)


def m11_low_rank(spark, sf):
    return rounded(estimators.completed(panel(spark, sf)), 6)


_LOCAL = ["local", "shock", "state"]


@query(_STACKED + """,
r0 AS (SELECT aoi, date, yr, pred, truth - pred AS t0, coalesce(peer - pred, 0) AS x1, s AS x2, t AS x3 FROM zz0),
r1 AS (SELECT yr, """ + ", ".join(f"sum(x{i} * x{j}) AS g{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j) + """, sum(x1 * t0) AS h1, sum(x2 * t0) AS h2, sum(x3 * t0) AS h3 FROM r0 GROUP BY yr),
r2 AS (SELECT yr, """ + ", ".join(f"sum({k}) OVER () - {k} + {0.1 if k in ('g11', 'g22', 'g33') else 0.0} AS {k}" for k in ("g11", "g12", "g13", "g22", "g23", "g33", "h1", "h2", "h3")) + """ FROM r1),
r3 AS (SELECT *, g11 * (g22 * g33 - g23 * g23) - g12 * (g12 * g33 - g23 * g13) + g13 * (g12 * g23 - g22 * g13) AS det FROM r2),
r4 AS (SELECT yr, (h1 * (g22 * g33 - g23 * g23) - g12 * (h2 * g33 - g23 * h3) + g13 * (h2 * g23 - g22 * h3)) / det AS c1,
  (g11 * (h2 * g33 - g23 * h3) - h1 * (g12 * g33 - g23 * g13) + g13 * (g12 * h3 - h2 * g13)) / det AS c2,
  (g11 * (g22 * h3 - h2 * g23) - g12 * (g12 * h3 - h2 * g13) + h1 * (g12 * g23 - g22 * g13)) / det AS c3 FROM r3)
SELECT aoi, date, """ + _g("greatest(-0.5, least(1.2, pred + " + " + ".join(f"greatest(-0.8, least(0.8, c{i})) * x{i}" for i in (1, 2, 3)) + "))", "pred") + " FROM r0 JOIN r4 USING (yr)")
def a29_ridge_correction(spark, sf):
    """The ridge on near AOIs, shock and state, each year corrected by the fit of the others."""
    z = saved(_stacked(spark, sf).where("truth IS NOT NULL").withColumns({"local": F.col("peer") - F.col("pred"), "resid": F.col("truth") - F.col("pred")}), "stacked")
    coefs = agg.fold_ridge(z, "yr", _LOCAL, "resid", 0.1, 0.8)
    return gridded(agg.fold_corrected(z, coefs, "yr", "pred", _LOCAL).select("aoi", "date", F.col("corrected").alias("pred")))


def _meta(kind: str):
    def run(spark, sf):
        z = _stacked(spark, sf).join(weather(spark, sf), "date", "left").where("truth IS NOT NULL")
        z = saved(agg.folds(z, ["yr"], expr.key(F.col("aoi"), F.col("date")), 3), "stacked")
        features = ["pred", "lerp", "peer", "shock", "state", "temp_c"]

        def predict(train, asked):
            return estimators.trees(train, features, "truth", kind).transform(asked).select("aoi", "date", F.round(expr.clip(F.col("prediction"), -0.2, 1.1), 6).alias("pred"))

        return estimators.out_of_fold(z, "fold", [0, 1, 2], predict)

    run.__doc__ = f"A {kind} meta-model over base predictions, peers, shocks and weather; each third of the rows by a fit on the others."
    return run


def m11_component_stack(spark, sf):
    """Base predictions stacked by their principal components, half of the years by a fit on the other half."""
    z = saved(_stacked(spark, sf).withColumn("fold", F.col("yr") % 2), "stacked")

    def predict(train, asked):
        stack = estimators.component_stack(train, ["pred", "lerp", "peer"], "truth")
        return asked.select("aoi", "date", F.round(expr.clip(F.col("pred") if stack is None else stack, -0.5, 1.2), 6).alias("pred"))

    return estimators.out_of_fold(z, "fold", [0, 1], predict)


def m13_source_classifier(spark, sf):
    """The sensor of gap rows by a forest on day, date counts and neighbour counts; pred is the probability of the sensor chosen."""
    from pyspark.ml.functions import vector_to_array

    p = panel(spark, sf)
    counts = p.where("y IS NOT NULL").groupBy("date").agg(*(F.count_if(F.col("source") == s).cast("double").alias(f"c_{s}") for s in expr.SENSORS))
    s1, c1 = expr.harmonics(F.col("doy"), 1)
    rows = p.withColumns({"sin1": s1, "cos1": c1}).join(counts, "date", "left")
    # A known row does not count itself.
    rows = rows.withColumns({f"c_{s}": F.coalesce(f"c_{s}", F.lit(0.0)) - ((F.col("source") == s) & F.col("y").isNotNull()).cast("double") for s in expr.SENSORS})
    model = estimators.trees(rows.where("y IS NOT NULL"), ["sin1", "cos1", *(f"c_{s}" for s in expr.SENSORS)], "source", "source")
    labels = F.array(*map(F.lit, model.stages[-2].labels))
    got = model.transform(rows.where("gap AND source <> 'none'"))
    return got.select("aoi", "date", "source", labels[F.col("prediction").cast("int")].alias("predicted"), F.round(F.array_max(vector_to_array("probability")), 6).alias("pred"))


ROWS_ONLY |= {f.__name__: f for f in (m8_pair_predict, m10_cross_year, m11_low_rank, m11_component_stack, m13_source_classifier)}
ROWS_ONLY |= {f"m12_{k}": _meta(k) for k in ("ridge", "huber")}
