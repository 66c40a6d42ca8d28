"""Small cases with known answers."""

import datetime as dt
import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.functions import expr, geo
from gapweave.operators import aggregates, climatology, estimators, gapfill, joins
from gapweave.sources import io
from gapweave.streaming import status


def small(spark, rows):
    """Rows of (aoi, date, y, gap, crop) as a panel."""
    df = spark.createDataFrame([(a, dt.date.fromisoformat(d), y, g, c) for a, d, y, g, c in rows], "aoi string, date date, y double, gap boolean, crop_type string")
    d = F.col("date")
    return df.select("*", F.lit(1).cast("long").alias("num"), F.year(d).cast("long").alias("yr"), F.dayofyear(d).cast("long").alias("doy"), expr.ordinal(d).alias("ord"), F.lit("s2").alias("source"),
                     F.col("y").alias("s2"), F.lit(None).cast("double").alias("landsat"), F.lit(None).cast("double").alias("modis"), F.col("y").alias("y_true"))


def test_two_points_give_their_middle(spark):
    p = small(spark, [("A", "2024-05-01", 0.4, False, "w"), ("A", "2024-05-02", None, True, "w"), ("A", "2024-05-03", 0.8, False, "w")])
    assert gapfill.fill(p).first()["pred"] == pytest.approx(0.6, abs=1e-6)


def test_history_is_strictly_earlier(spark):
    p = small(spark, [("A", "2023-06-01", 0.4, False, "w"), ("A", "2024-06-01", 0.9, False, "w"), ("A", "2024-06-02", None, False, "w"), ("A", "2025-06-01", 0.5, False, "w")])
    got = {str(r["date"]): r["clim_mean"] for r in climatology.climatology(p, min_samples=1).collect()}
    assert got["2025-06-01"] == pytest.approx(0.65) and got["2024-06-01"] == pytest.approx(0.4) and got["2023-06-01"] is None


def test_window_goes_round_the_year(spark):
    p = small(spark, [("A", "2023-12-31", 0.2, False, "w"), ("A", "2024-01-01", 0.4, False, "w"), ("A", "2025-01-02", 0.5, False, "w")])
    last = climatology.climatology(p, window=3, min_samples=1).orderBy("date").collect()[-1]
    assert last["clim_mean"] == pytest.approx(0.3) and last["clim_n"] == 2 and np.isfinite(last["clim_se"])


def test_stress_run(spark):
    rows = [("A", dt.date(2024, 7, k), "critical", -3.0, p, 0.0, 35.0) for k, p in ((1, "observed"), (2, "reconstructed"), (3, "reconstructed"))]
    runs = climatology.periods(spark.createDataFrame(rows, "aoi string, date date, status string, z double, provenance string, precip_mm double, temp_c double")).collect()
    assert [(r["n_days"], r["n_observed"], r["n_reconstructed"], r["weather"]) for r in runs] == [(3, 1, 2, "dry_and_hot_context")]


def test_booleans(spark):
    df = spark.createDataFrame([(v,) for v in ("True", "False", "true", "false", "1", "0", None)], "v string")
    assert [r[0] for r in df.select(expr.to_bool(F.col("v"))).collect()] == [True, False, True, False, True, False, False]


def test_encodings_and_hash(spark, tmp_path):
    for name, enc in (("u", "utf-8"), ("c", "cp1251")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_bytes("crop_type,y\nозимая пшеница,NaN\n".encode(enc))
        row = io.read_csv(spark, str(tmp_path / name)).first()
        assert row["crop_type"] == "озимая пшеница" and row["y"] is None
    (tmp_path / "h").write_bytes(b"abc")
    assert io.sha256_of(spark, str(tmp_path / "h")).first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "o")
    df = spark.createDataFrame([("A", 0.5)], "k string, v double")
    io.write_csv(df, out, single=True)
    assert "A,0.50000000" in next((tmp_path / "o").glob("*.csv")).read_text()
    with pytest.raises(FileExistsError):
        io.write_csv(df, out)
    m = io.manifest(df, ["k"], "v", str(tmp_path / "m.json"))
    assert m["rows"] == 1 and json.loads((tmp_path / "m.json").read_text())["finite"]
    assert "<polyline" in io.passport("A", {"rows": 1}, [0.1, None, 0.2, 0.3])


def test_geometry(spark):
    lines = spark.createDataFrame([("37.0,55.0 # first\n37.1;55.0\n37.1,55.1\n37.0,55.1",), ("1,1\n2,1\n2,2",), ("1,1\n2,2",), ("1,1\n2,x\n3,3",), (None,)], "t string")
    made = [r["geojson"] for r in geo.with_polygon(lines, "t").collect()]
    assert json.loads(made[0])["geometry"]["coordinates"][0][-1] == [37.0, 55.0] and made[2:] == [None] * 3
    whole = json.loads(made[0])
    broken = json.loads(made[0])
    broken["geometry"]["coordinates"][0][-1] = [180.1, 55]
    nan = made[0].replace("37.1", "NaN", 1)
    collection = json.dumps({"type": "FeatureCollection", "features": [whole, whole]})
    texts = [made[0], made[1], json.dumps(broken), json.dumps(whole["geometry"]), collection, '{"type":"FeatureCollection","features":[]}', '{"type":"Polygon","coordinates":[[[1,2],[3,4],[1,2]]]}', '{"type":"Polygon","coordinates":"x"}', '{"type":"Polygon","coordinates":[[["a",2],[3,4],[5,6],["a",2]]]}', '{"type":"Polygon","coordinates":[[]]}', '{"type":"Polygon","coordinates":[[[1],[2],[3],[1]]]}', nan, '{"type":"Point","coordinates":[1,2]}', "nope", None]
    got = [r["geometry"] for r in geo.checked(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()]
    assert [g["ok"] for g in got] == [True, True, False, True, True, *[False] * 10]
    assert all((g["message"] == "ok") == g["ok"] and g["message"] and (g["lat"] is not None) == g["ok"] for g in got)
    assert got[2]["message"] == "a ring is open; a point is outside WGS84" and got[6]["message"] == "a ring has under four points"
    assert 55.0 < got[0]["lat"] < 55.1 and 37.0 < got[0]["lon"] < 37.1 and got[0]["lat"] == pytest.approx((2 * 55.1 + 3 * 55.0) / 5) and got[4]["lat"] == pytest.approx(got[0]["lat"])


def test_adapters_with_a_mock(spark, tmp_path):
    found = io.farmland_around(1, 2, "x", transport=lambda *a: {"elements": [{"id": 7, "center": {"lat": 1.0, "lon": 2.0}}, {"id": 8}]})
    assert found == [{"osm_id": 7, "lat": 1.0, "lon": 2.0, "crop": None}]
    w = lambda *a: {"daily": {"time": ["2025-01-01", "2025-01-02"], "temperature_2m_mean": [1.0, None], "precipitation_sum": [0.0, 2.0]}}
    assert io.region_context(spark, [{"id": "a", "lat": 1, "lon": 2}], "2025-01-01", "2025-01-02", str(tmp_path / "w"), w)["rows"] == 2
    frame = spark.createDataFrame([(dt.date(2025, 1, 2), 0.1)], "date date, v double")
    assert joins.with_weather(frame, io.daily_weather(spark, 1, 2, "a", "b", w)).first()["temp_c"] is None
    assert io.search_scenes({"type": "FeatureCollection", "features": [{"geometry": {"type": "Point"}}]}, "a", "b", "u", lambda u, p, f: {"features": [p["intersects"]]}) == [{"type": "Point"}]


def test_downloads(spark, tmp_path):
    df = spark.createDataFrame([("A", "2024-01-02", 0.5), ("A", "2024-01-01", None), ("B", "2024-01-01", 0.1)], "aoi string, date string, v double")
    io.download(df, str(tmp_path / "d"), aoi="A", start="2024-01-01")
    assert next((tmp_path / "d").glob("*.csv")).read_text().split() == ["aoi,date,v", "A,2024-01-01,", "A,2024-01-02,0.50000000"]
    ring = "[[[37,55],[38,55],[38,56],[37,55]]]"
    regions = spark.createDataFrame([("r1", '{"type":"Polygon","coordinates":%s}' % ring), ("r2", '{"type":"Feature","geometry":{"type":"Polygon","coordinates":%s}}' % ring), ("bad", "{}"), (None, None)], "name string, g string")
    whole = json.loads(io.feature_collection(regions, "g", ["name"]))
    assert [f["properties"]["name"] for f in whole["features"]] == ["r1", "r2"] and {f["geometry"]["type"] for f in whole["features"]} == {"Polygon"}
    io.write_features(regions, "g", [], str(tmp_path / "f"))
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "f").glob("part*")) == 2


def test_load_by_environment(spark, tmp_path):
    (tmp_path / "t.csv").write_text("anon_polygon_id,date,primary_ndvi,is_synthetic_gap\na,2024-01-01,0.4,False\n")
    (tmp_path / "private_features.csv").write_text("anon_polygon_id,date,primary_ndvi,is_synthetic_gap\na,2024-01-01,0.4,False\na,2024-01-02,,True\na,2024-01-03,,False\n")
    (tmp_path / "p.csv").write_text("anon_polygon_id,date,primary_ndvi_pred\na,2024-01-01,0.9\na,2024-01-02,0.6\na,2024-01-02,0.7\na,2024-01-03,0.8\n")
    tables = io.load(spark, str(tmp_path / "p.csv"), {io.FOLDER: str(tmp_path), "GAPWEAVE_TRAIN_FILENAME": "t.csv"})
    assert [r["ndvi_filled"] for r in tables["private"].orderBy("date").collect()] == [0.4, 0.6, None] and tables["train"].count() == 1
    assert all(t.is_cached for t in tables.values())
    io.release(tables)
    assert not any(t.is_cached for t in tables.values())


def test_http_retries(monkeypatch):
    seen, waits = [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["Content-Type"], self.rfile.read(int(self.headers["Content-Length"]))))
            self.answer()

        def do_GET(self):
            seen.append(("get", b""))
            self.answer()

        def answer(self):
            self.send_response(500 if len(seen) < 3 else 200)
            self.end_headers()
            self.wfile.write(b'{"a": 1}')

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    monkeypatch.setattr(io.time, "sleep", waits.append)
    assert io.http_json(url, {"q": "x y"}, form=True) == {"a": 1} and waits == [0.5, 1.0]
    assert seen[-1] == ("application/x-www-form-urlencoded", b"q=x+y") and len(seen) == 3
    assert io.http_json(url, {"q": 1}) == {"a": 1} and seen[-1] == ("application/json", b'{"q": 1}')
    assert io.http_json(url) == {"a": 1} and seen[-1][0] == "get"
    seen.clear()
    with pytest.raises(OSError):
        io.http_json(url, attempts=2)
    server.shutdown()


def test_model_artefacts(spark, tmp_path):
    df = spark.createDataFrame([(float(k), float(2 * k)) for k in range(20)], "x double, y double")
    model = estimators.trees(df, ["x"], "y", "ols")
    io.save_model(model, str(tmp_path / "m"))
    with pytest.raises(FileExistsError):
        io.save_model(model, str(tmp_path / "m"))
    again = io.load_model(str(tmp_path / "m"))
    assert [r["prediction"] for r in again.transform(df).collect()] == pytest.approx([2.0 * k for k in range(20)])


def test_group_without_spread_has_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 3.0, None)], "k string, x double, y double")
    got = {r["k"]: r["r"] for r in df.groupBy("k").agg(expr.correlation(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1)


def test_peers_are_ranked_by_cross_validated_error(spark):
    rng = np.random.default_rng(3)
    y = rng.random((40, 3))
    y[:, 1] = 0.2 + 0.5 * y[:, 0] + rng.normal(size=40) * 0.01
    rows = [(f"A{k}", dt.date(2024, 3, 1) + dt.timedelta(int(d)), float(y[d, k]), False, "w") for d in range(40) for k in range(3)]
    p = small(spark, [(a, str(d), v, g, c) for a, d, v, g, c in rows]).withColumn("num", F.substring("aoi", 2, 1).cast("long"))
    got = {(r["aoi"], r["peer"]): r for r in joins.pair_fits(p).collect()}
    fold = np.arange(40) % 5
    for a, b in ((0, 1), (1, 0), (2, 0)):
        e = []
        for f in range(5):
            s, i = np.polyfit(y[fold != f, b], y[fold != f, a], 1)
            e += (y[fold == f, a] - i - s * y[fold == f, b]).tolist()
        mine = got[f"A{a}", f"A{b}"]
        assert mine["cv_rmse"] == pytest.approx(np.sqrt(np.mean(np.square(e)))) and (mine["b"], mine["a"]) == pytest.approx(tuple(np.polyfit(y[:, b], y[:, a], 1)))


def test_same_trajectory_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    paths = {k: {(d, int(v)) for d, v in zip(range(50), rng.integers(0, 3, 50))} for k in range(4)}
    paths |= {10 + k: set(paths[k % 4]) for k in range(8)}
    paths[30] = {x for x in paths[0] if x[0] < 40}
    paths[31] = {x for x in paths[1] if x[0] >= 15} | {(60 + d, 1) for d in range(5)}
    rows = [(k, d, v) for k, own in paths.items() for d, v in own]
    want = {}
    for a, x in paths.items():
        found = []
        for b, y in paths.items():
            common = {d for d, _ in x} & {d for d, _ in y}
            if a != b and len(common) >= 30 and len(x & y) == len(common):
                found.append((-len(common), b))
        if found:
            want[a] = (min(found)[1], -min(found)[0])
    got = joins.same_trajectory(spark.createDataFrame(rows, "num long, day long, v long"), "num", "day", ["v"]).collect()
    assert {r["a"]: (r["peer"], r["n"]) for r in got} == want


def test_joins_check_their_keys(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        joins.validated_left(a.select("k").distinct(), a, ["k"])
    with pytest.raises(ValueError):
        joins.keyed_fill(a, a, "other")


def test_estimators_against_numpy():
    x, y = np.arange(0, 100, 5.0), np.sin(np.arange(0, 100, 5.0) / 30) / 2 + 0.4
    for f in estimators.ESTIMATORS.values():
        assert abs(f(x, y, 42.0) - (np.sin(1.4) / 2 + 0.4)) < 0.12
    assert estimators.huber_affine(x / 100, 0.1 + 0.5 * x / 100) == pytest.approx((0.1, 0.5))
    m = np.outer(np.arange(1, 9), np.arange(1, 6)) / 10.0
    hole = m.copy()
    hole[2, 3] = np.nan
    assert estimators.low_rank(hole, 1, 200)[2, 3] == pytest.approx(m[2, 3], abs=0.05)


def test_estimators_by_value():
    """Each estimator against a formula of its own, on points that its bounds leave alone."""
    rng = np.random.default_rng(2)
    x = np.sort(rng.choice(200, 30, replace=False)).astype(float)
    y, q = 0.5 + 0.2 * np.sin(x / 40), 101.0
    u = np.abs(x - q)
    near = np.argsort(u, kind="stable")
    w = 1 / (1 + 2 * (u / u[near[:16]].max()))[near[:16]]
    assert estimators.local_polynomial(x, y, q) == pytest.approx(np.polyval(np.polyfit((x - q)[near[:16]], y[near[:16]], 3, w=w), 0))
    t = np.clip(1 - (u / 14) ** 3, 0, None) ** 3
    assert estimators.kernel_mean(x, y, q) == pytest.approx(np.average(y, weights=t))
    g = np.exp(-0.5 * (u / 14) ** 2)
    order = np.argsort(y)
    assert estimators.weighted_median(x, y, q) == y[order][np.flatnonzero(np.cumsum(g[order]) >= g.sum() / 2)[0]]
    for kind, k in (("rbf", lambda d: np.exp(-d * d / 2)), ("matern52", lambda d: (1 + np.sqrt(5) * d + 5 / 3 * d * d) * np.exp(-np.sqrt(5) * d))):
        s, mid = max(y.var(), 1e-4), np.median(y)
        gram = s * k(np.abs(np.subtract.outer(x, x)) / 25) + 0.05**2 * np.eye(30)
        assert estimators.gaussian_process(x, y, q, kind=kind) == pytest.approx(mid + s * k(u / 25) @ np.linalg.inv(gram) @ (y - mid))
    # A random walk is a Gaussian process with covariance drift * min(day), from a wide start.
    days = x - x[0] + 1
    cov = 1e-3 * np.minimum.outer(days, days) + 1e4
    to = 1e-3 * np.minimum(days, q - x[0] + 1) + 1e4
    assert estimators.kalman(x, y, q) == pytest.approx(to @ np.linalg.solve(cov + 2.5e-3 * np.eye(30), y), abs=1e-4)
    assert estimators.nearest_value(np.array([1.0, 3.0, 3.0]), np.array([5.0, 7.0, 9.0]), 2.0) == 5.0 and estimators.nearest_value(np.array([1.0, 3.0, 3.0]), np.array([5.0, 7.0, 9.0]), 2.5) == 8.0
    pick = near[:12]
    d, v, gw = (x - q)[pick], y[pick], np.exp(-0.5 * (u[pick] / 30) ** 2)
    b = np.vander(d, 3, increasing=True)
    assert estimators.local_quadratic(x, y, q) == pytest.approx(np.linalg.solve(b.T @ (b * gw[:, None]) + np.diag([1e-8, 1e-4, 1e-4]), b.T @ (gw * v))[0])
    # No bend costs nothing: a line is kept, whatever the slack; without slack the values are.
    assert estimators.smoothing_spline(x, 0.1 + 0.002 * x, q) == pytest.approx(0.1 + 0.002 * q)
    assert estimators.smoothing_spline(x, y, float(x[7]), slack=1e-12) == pytest.approx(y[7], abs=1e-5)
    rough = y + rng.normal(size=30) * 0.05
    fitted = np.array([estimators.smoothing_spline(x, rough, float(a), slack=0.001) for a in x])
    assert np.mean((fitted - rough) ** 2) == pytest.approx(0.001, rel=0.25)
    for f in (estimators.fourier_ridge, estimators.bump_ridge, estimators.loess):
        off = y.copy()
        off[3] += 5
        assert abs(f(x, off, q) - f(x, y, q)) < 0.03


def test_driver_solves(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), float(b), float(1 + 2 * a - b), float(a)) for a, b in x], "a double, b double, t double, c double")
    assert aggregates.ridge(df, ["a", "b"], "t", 1e-9) == pytest.approx([1, 2, -1], abs=1e-5)
    w = aggregates.simplex_weights(df.withColumn("good", F.col("t") + 0.01), ["good", "c"], "t")
    assert w.sum() == pytest.approx(1) and w[0] > 0.95


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = status.daily(stream).writeStream.format("memory").queryName("daily_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["day"], r["event_type"]): r["n"] for r in spark.table("daily_out").collect()}
    want = {(r["day"], r["event_type"]): r["n"] for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_pair_models_against_brute_force(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2024, 5, 1) + dt.timedelta(days=k) for k in range(20)]
    a, b = rng.uniform(0.2, 0.6, 20), rng.normal(0, 0.02, 20)
    rows = [("A", 1, d, float(x)) for d, x in zip(days, a)] + [("B", 3, d, float(0.1 + 0.8 * x + e)) for d, x, e in zip(days, a, b)] + [("C", 30, d, 0.5) for d in days]
    p = spark.createDataFrame(rows, "aoi string, num long, date date, y double").withColumn("ord", expr.ordinal(F.col("date")))
    got = {(r["aoi"], r["peer"]): r for r in estimators.pair_models(p).collect()}
    assert set(got) == {("A", "B"), ("B", "A")}
    x, y = a, 0.1 + 0.8 * a + b
    want = estimators.huber_affine(x, y)
    assert (got["B", "A"]["a"], got["B", "A"]["b"]) == pytest.approx(want)
    err = [estimators.huber_affine(x[np.arange(20) % 4 != k % 4], y[np.arange(20) % 4 != k % 4]) for k in range(20)]
    e = np.array([i + s * v for (i, s), v in zip(err, x)]) - y
    assert got["B", "A"]["cv_rmse"] == pytest.approx(float(np.sqrt(np.mean(e**2))))


def test_other_years_give_their_curve(spark):
    curve = lambda d: 0.3 + 0.2 * ((d - 150) / 60) ** 2
    rows = [("A", yr, yr * 366 + d, d, curve(d), False) for yr in (1, 2) for d in range(100, 200, 5)] + [("A", 3, 3 * 366 + 150, 150, None, True), ("B", 3, 3 * 366 + 150, 150, None, True)]
    p = spark.createDataFrame(rows, "aoi string, yr long, ord long, doy long, y double, gap boolean")
    got = estimators.cross_year(p).collect()
    assert [(r["aoi"], r["yr"]) for r in got] == [("A", 3)] and got[0]["pred"] == pytest.approx(0.3, abs=1e-6)


def test_ridge_bounds_and_missing_features(spark):
    df = spark.createDataFrame([(1.0, 3.0, 0.2), (2.0, 5.0, 0.2), (None, 4.0, 0.2), (3.0, 7.0, 0.2)], "a double, t double, base double")
    coef = aggregates.ridge(df, ["a"], "t", 0.5, 0.75, intercept_alpha=0.05, most_intercept=0.03)
    assert coef == pytest.approx([0.03, 0.75])
    got = [r[0] for r in df.select(aggregates.corrected(F.col("base"), coef, ["a"], 0, 9)).collect()]
    assert got == pytest.approx([0.98, 1.73, 0.23, 2.48])
