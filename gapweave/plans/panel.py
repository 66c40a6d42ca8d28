"""The fixture panel: nations as AOIs, regions as crops, order status as sensors, one row an AOI and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num, aoi, date, crop_type, s2, landsat, modis, y_true, gap, yr, doy, ord, source; y is y_true where there is no gap."""
    orders, customer, nation, region = tables(spark, sf_dir, "orders", "customer", "nation", "region")
    price = lambda s: F.round(F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))) / 500000, 9)
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    raw = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_nationkey", F.col("o_orderdate").cast("date").alias("date"))
        .agg(price("F").alias("s2"), price("O").alias("landsat"), price("P").alias("modis"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    num, date = F.col("c_nationkey").cast("long"), F.col("date")
    doy = F.dayofyear("date").cast("long")
    made = raw.select(
        num.alias("num"), F.format_string("AOI-%04d", num).alias("aoi"), "date", F.col("r_name").alias("crop_type"), "s2", "landsat", "modis",
        F.coalesce("s2", "landsat", "modis").alias("y_true"), ((num * 31 + doy) % 7 == 0).alias("gap"), F.year("date").cast("long").alias("yr"),
        doy.alias("doy"), expr.ordinal(date).alias("ord"), expr.source_label(F.col("s2"), F.col("landsat"), F.col("modis")).alias("source"),
    )
    return made.withColumn("y", F.when(~F.col("gap"), F.col("y_true")))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """temp_c and precip_mm by date."""
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    return lineitem.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.round(F.avg("l_quantity"), 6).alias("temp_c"), F.round(100 * F.avg("l_discount"), 6).alias("precip_mm"))


#: The same panel for DuckDB; queries go on from "panel" and "weather".
SQL = """
WITH raw AS (
  SELECT c_nationkey AS num, CAST(o_orderdate AS DATE) AS date, r_name AS crop_type,
    round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 500000, 9) AS s2,
    round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) / 500000, 9) AS landsat,
    round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) / 500000, 9) AS modis
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY ALL),
named AS (
  SELECT CAST(num AS BIGINT) AS num, printf('AOI-%04d', num) AS aoi, date, crop_type, s2, landsat, modis, coalesce(s2, landsat, modis) AS y_true,
    (num * 31 + dayofyear(date)) % 7 = 0 AS gap, CAST(year(date) AS BIGINT) AS yr, CAST(dayofyear(date) AS BIGINT) AS doy,
    CAST(date - DATE '0001-01-01' + 1 AS BIGINT) AS ord,
    CASE WHEN s2 IS NOT NULL THEN 's2' WHEN landsat IS NOT NULL THEN 'landsat' WHEN modis IS NOT NULL THEN 'modis' ELSE 'none' END AS source
  FROM raw),
panel AS (SELECT *, CASE WHEN NOT gap THEN y_true END AS y FROM named),
weather AS (
  SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_quantity), 6) AS temp_c, round(100 * avg(l_discount), 6) AS precip_mm FROM lineitem GROUP BY ALL)
"""
