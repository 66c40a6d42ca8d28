"""Readers and writers (S1-S15): CSV with its encoding found, guarded sinks, manifests, contexts and passports."""

from __future__ import annotations

import html
import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import nan_to_null, to_bool

#: Columns of the production tables; absent ones are added as NULL.
PANEL = T.StructType([
    T.StructField("anon_polygon_id", T.StringType()), T.StructField("date", T.DateType()),
    *(T.StructField(c, T.DoubleType()) for c in ("s2_ndvi", "s2_evi", "s2_ndwi", "landsat_ndvi", "landsat_evi", "landsat_ndwi", "modis_ndvi", "modis_evi", "era5_temp_c", "era5_precip_mm", "primary_ndvi")),
    T.StructField("crop_type", T.StringType()), T.StructField("is_synthetic_gap", T.StringType()),
])


#: S3: environment variables that name the folder and its files, with the files' usual names.
FOLDER, FILES = "GAPWEAVE_DATA_DIR", {"train": ("GAPWEAVE_TRAIN_FILENAME", "train_dataset.csv"), "private": ("GAPWEAVE_PRIVATE_FILENAME", "private_features.csv")}


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether all files are strict UTF-8; read line by line on the executors, so a file of any size is never held whole.

    Lines end at the byte 10, which is part of no other UTF-8 or CP1251 character.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.is_valid_utf8("value").alias("ok"))
    return lines.where(~F.col("ok")).limit(1).count() == 0


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str | None = None) -> DataFrame:
    """UTF-8 if all of it is, else CP1251; NaN and infinities become NULL.

    Spark reads CP1251 only with spark.sql.legacy.javaCharsets on.  It is set for such files and stays set,
    as their plans are read later than this returns.
    """
    if encoding is None:
        encoding = "UTF-8" if is_utf8(spark, path) else "windows-1251"
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("header", True).option("encoding", encoding).option("mode", "FAILFAST")
    return nan_to_null((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def load(spark: SparkSession, predictions: str | None = None, env: Mapping[str, str] = os.environ) -> dict[str, DataFrame]:
    """S3: the train and private tables that the environment names and, if given, the predictions, one a key; each cached, so that a session reads its file once.

    private has y filled from the predictions where it is a gap without a value (primary_ndvi_pred and ndvi_filled).  release() frees them.
    """
    folder = env[FOLDER].rstrip("/")
    tables = {name: read_csv(spark, f"{folder}/{env.get(variable, usual)}") for name, (variable, usual) in FILES.items()}
    if predictions:
        pred = read_csv(spark, predictions)
        keys = ["anon_polygon_id", "date"]
        one = pred.groupBy(*keys).agg(F.min("primary_ndvi_pred").alias("primary_ndvi_pred"))
        gap = F.col("primary_ndvi").isNull() & to_bool(F.col("is_synthetic_gap"))
        tables |= {"predictions": pred, "private": tables["private"].join(one, keys, "left").withColumn("ndvi_filled", F.when(gap, F.col("primary_ndvi_pred")).otherwise(F.col("primary_ndvi")))}
    return {name: df.persist() for name, df in tables.items()}


def release(tables: dict[str, DataFrame]) -> None:
    """S3: free what load() cached."""
    for df in tables.values():
        df.unpersist()


def save_model(model, path: str) -> None:
    """A fitted PipelineModel; refuses a target that exists."""
    refuse_existing(SparkSession.getActiveSession(), path)
    model.write().save(path)


def load_model(path: str):
    """What save_model() wrote."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def ensure_columns(df: DataFrame, schema: T.StructType = PANEL) -> DataFrame:
    """All columns of a schema, absent ones NULL, others kept behind them."""
    have = set(df.columns)
    own = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*own, *(c for c in df.columns if c not in schema.names))


def refuse_existing(spark: SparkSession, *paths: str) -> None:
    """An error before any job if one of the targets exists."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise FileExistsError(p)


def write_csv(df: DataFrame, path: str, digits: int = 8, single: bool = False) -> None:
    """Doubles with fixed digits, NULL as an empty field; one file only where asked for, as that is one task."""
    refuse_existing(df.sparkSession, path)
    fixed = df.select([F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    (fixed.coalesce(1) if single else fixed).write.option("header", True).csv(path)


def download(df: DataFrame, path: str, aoi: str | None = None, start: str | None = None, end: str | None = None, by: str = "aoi", at: str = "date") -> None:
    """The rows of one AOI and span of dates (all that are not named), in order, as one CSV file; a slice for a person, so one task."""
    slim = df.where(F.col(by) == aoi) if aoi is not None else df
    slim = slim.where(F.col(at) >= start) if start is not None else slim
    slim = slim.where(F.col(at) <= end) if end is not None else slim
    write_csv(slim.orderBy(by, at), path, single=True)


def feature_collection(df: DataFrame, geometry: str, properties: list[str]) -> str:
    """GeoJSON of a table of regions, with a column of geometry texts (Feature or geometry); rows whose geometry fails its checks are left out.

    For the few regions of one download; write_features() is for tables.
    """
    rows = _features(df, geometry, properties).collect()
    return '{"type":"FeatureCollection","features":[' + ",".join(r["value"] for r in rows) + "]}"


def write_features(df: DataFrame, geometry: str, properties: list[str], path: str) -> None:
    """GeoJSON, one Feature a line, written by all tasks."""
    refuse_existing(df.sparkSession, path)
    _features(df, geometry, properties).write.text(path)


def _features(df: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    from ..functions.geo import checked

    rows = checked(df.select(*properties, F.col(geometry).alias("_g")), "_g", "_c").where("_c.ok")
    body = F.coalesce(F.get_json_object("_g", "$.geometry"), F.col("_g"))
    facts = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    return rows.select(F.concat(F.lit('{"type":"Feature","properties":'), facts, F.lit(',"geometry":'), body, F.lit("}")).alias("value"))


def sha256_of(spark: SparkSession, path: str) -> DataFrame:
    """Path and SHA-256 of each file, hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest(df: DataFrame, keys: list[str], value: str, path: str | None = None, **more) -> dict:
    """Rows, distinct keys and the value's range from one aggregation; written as JSON if a path is given."""
    v = F.col(value)
    row = df.agg(F.count("*").alias("rows"), F.count_distinct(*keys).alias("keys"), F.bool_and(v.isNotNull() & ~F.isnan(v)).alias("finite"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")).first()
    out = row.asDict() | {"columns": df.columns} | more
    if path:
        Path(path).write_text(json.dumps(out, indent=1, default=str), encoding="utf-8")
    return out


Transport = Callable[[str, dict | None, bool], dict]


def http_json(url: str, payload: dict | None = None, form: bool = False, attempts: int = 3, timeout: float = 20) -> dict:
    """GET, or POST of JSON or a form; later attempts wait 0.5, 1, ... seconds."""
    body = None if payload is None else urllib.parse.urlencode(payload).encode() if form else json.dumps(payload).encode()
    kind = "application/x-www-form-urlencoded" if form else "application/json"
    for k in range(attempts):
        try:
            ask = urllib.request.Request(url, data=body, headers={"Content-Type": kind} if body else {})
            with urllib.request.urlopen(ask, timeout=timeout) as answer:
                return json.load(answer)
        except (OSError, ValueError):
            if k == attempts - 1:
                raise
            time.sleep(0.5 * 2**k)
    raise AssertionError


def daily_weather(spark: SparkSession, lat: float, lon: float, start: str, end: str, transport: Transport = http_json) -> DataFrame:
    """(date, temp_c, precip_mm) of a place from a public archive."""
    ask = urllib.parse.urlencode({"latitude": lat, "longitude": lon, "start_date": start, "end_date": end, "daily": "temperature_2m_mean,precipitation_sum", "timezone": "UTC"})
    d = transport(f"https://archive-api.open-meteo.com/v1/archive?{ask}", None, False).get("daily", {})
    rows = list(zip(d.get("time", []), d.get("temperature_2m_mean", []), d.get("precipitation_sum", [])))
    return spark.createDataFrame(rows, "date string, temp_c double, precip_mm double").withColumn("date", F.to_date("date"))


def search_scenes(geometry: dict, start: str, end: str, url: str, transport: Transport = http_json) -> list[dict]:
    """Satellite scenes over a geometry (the first one of a collection)."""
    if geometry.get("type") == "FeatureCollection":
        geometry = geometry["features"][0]
    geometry = geometry.get("geometry", geometry)
    return transport(url, {"collections": ["sentinel-2-l2a"], "intersects": geometry, "datetime": f"{start}/{end}", "limit": 100}, False).get("features", [])


def farmland_around(lat: float, lon: float, url: str, radius_m: int = 5000, limit: int = 20, transport: Transport = http_json) -> list[dict]:
    """Farmland outlines around a point: the first ``limit`` elements, of those the ones with a centre."""
    ask = f'[out:json];way["landuse"="farmland"](around:{radius_m},{lat},{lon});out center tags;'
    found = transport(url, {"data": ask}, True).get("elements", [])[:limit]
    return [{"osm_id": e["id"], "lat": e["center"]["lat"], "lon": e["center"]["lon"], "crop": e.get("tags", {}).get("crop")} for e in found if "center" in e]


def region_context(spark: SparkSession, places: list[dict], start: str, end: str, out: str, transport: Transport = http_json, scenes_url: str | None = None, farmland_url: str | None = None) -> dict:
    """Weather of some places as one table and, where an address is given, their satellite scenes and farmland, each as a folder of its own; a manifest beside them.

    Places are dicts of id, lat and lon, and of a GeoJSON geometry for the scenes.  Refuses targets that exist before any request.
    """
    names = ["weather", *(n for n, url in (("scenes", scenes_url), ("farmland", farmland_url)) if url)]
    refuse_existing(spark, *(f"{out}/{n}" for n in names))
    parts = [daily_weather(spark, p["lat"], p["lon"], start, end, transport).withColumn("place", F.lit(p["id"])) for p in places]
    reduce(lambda a, b: a.unionByName(b), parts).write.parquet(f"{out}/weather")
    found = {}
    if scenes_url:
        rows = [(p["id"], json.dumps(s)) for p in places if "geometry" in p for s in search_scenes(p["geometry"], start, end, scenes_url, transport)]
        spark.createDataFrame(rows, "place string, item string").write.parquet(f"{out}/scenes")
        found["scenes"] = len(rows)
    if farmland_url:
        rows = [(p["id"], *(f[c] for c in ("osm_id", "lat", "lon", "crop"))) for p in places for f in farmland_around(p["lat"], p["lon"], farmland_url, transport=transport)]
        spark.createDataFrame(rows, "place string, osm_id long, lat double, lon double, crop string").write.parquet(f"{out}/farmland")
        found["farmland"] = len(rows)
    return manifest(spark.read.parquet(f"{out}/weather"), ["place", "date"], "temp_c", places=len(places), start=start, end=end, **found)


def sparkline(values: list[float | None], width: int = 240, height: int = 40) -> str:
    """A line of values as SVG; gaps break it."""
    known = [v for v in values if v is not None]
    if not known:
        return f'<svg width="{width}" height="{height}"></svg>'
    lo, span = min(known), max(max(known) - min(known), 1e-9)
    step, runs, run = width / max(1, len(values) - 1), [], []
    for k, v in enumerate([*values, None]):
        if v is not None:
            run.append(f"{k * step:.1f},{height - (v - lo) / span * height:.1f}")
        elif run:
            runs.append(f'<polyline fill="none" stroke="green" points="{" ".join(run)}"/>')
            run = []
    return f'<svg width="{width}" height="{height}">{"".join(runs)}</svg>'


def passport(title: str, figures: dict, values: list[float | None]) -> str:
    """A page about one AOI that needs no other file."""
    rows = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(str(v))}</td></tr>" for k, v in figures.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{rows}</table>{sparkline(values)}</body></html>"
