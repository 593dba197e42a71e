"""The driver's tables seen as velocity observations: lineitem as 40 pixels with a 12-day repeat cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import loaders


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """xi, yi, x, y, date1, date2, temporal_baseline, vx, vy, errorx, errory, sensor_raw, source."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = F.lit("1995-01-02").cast("date")
    off = F.expr("cast(12 * (datediff(cast(l_shipdate as date), date'1995-01-02') div 12) as int)")
    df = item.select("*", off.alias("off"), (12 * (1 + F.col("l_quantity").cast("int") % 24)).alias("tb"))
    angle = 2 * F.pi() * (F.col("off") + F.col("tb") / 2.0) / 365.25
    xi, yi = (F.col("l_suppkey") % 8).cast("int"), (F.col("l_partkey") % 5).cast("int")
    gone = F.col("l_quantity") == 13
    vx = 120 + 40 * F.sin(angle) + 200 * (F.col("l_discount") - 0.05) + F.when(F.col("l_linenumber") == 7, 900).otherwise(0)
    vy = 60 + 20 * F.cos(angle) + 100 * (F.col("l_tax") - 0.04) - F.when(F.col("l_linenumber") == 7, 500).otherwise(0)
    return df.select(
        xi.alias("xi"), yi.alias("yi"), (500000 + 100 * (F.col("l_suppkey") % 8)).cast("double").alias("x"), (5000000 - 100 * (F.col("l_partkey") % 5)).cast("double").alias("y"),
        F.date_add(start, F.col("off")).alias("date1"), F.date_add(start, F.col("off") + F.col("tb")).alias("date2"), F.col("tb").alias("temporal_baseline"),
        F.when(~gone, vx).alias("vx"), F.when(~gone, vy).alias("vy"), (1 + 100 * F.col("l_discount")).alias("errorx"), (1 + 100 * F.col("l_tax")).alias("errory"),
        F.when(F.col("l_returnflag") == "A", "L8").when(F.col("l_returnflag") == "N", "S2A ").otherwise("S1B").alias("sensor_raw"), F.when(F.col("l_linestatus") == "O", "ITS_LIVE").otherwise("IGE").alias("source"),
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaders.load(raw(spark, sf_dir)).drop("sensor_raw")


#: The same for DuckDB, as common table expressions `raw` and `obs`.
SQL = """raw AS (SELECT CAST(l_suppkey % 8 AS INTEGER) AS xi, CAST(l_partkey % 5 AS INTEGER) AS yi,
  CAST(500000 + 100*(l_suppkey % 8) AS DOUBLE) AS x, CAST(5000000 - 100*(l_partkey % 5) AS DOUBLE) AS y,
  d1 AS date1, CAST(d1 + tb AS DATE) AS date2, tb AS temporal_baseline,
  CASE WHEN l_quantity = 13 THEN NULL ELSE 120 + 40*sin(2*pi()*(off + tb/2.0)/365.25) + 200*(l_discount-0.05)
       + CASE WHEN l_linenumber = 7 THEN 900 ELSE 0 END END AS vx,
  CASE WHEN l_quantity = 13 THEN NULL ELSE 60 + 20*cos(2*pi()*(off + tb/2.0)/365.25) + 100*(l_tax-0.04)
       - CASE WHEN l_linenumber = 7 THEN 500 ELSE 0 END END AS vy,
  1 + 100*l_discount AS errorx, 1 + 100*l_tax AS errory,
  CASE l_returnflag WHEN 'A' THEN 'L8' WHEN 'N' THEN 'S2A ' ELSE 'S1B' END AS sensor_raw,
  CASE l_linestatus WHEN 'O' THEN 'ITS_LIVE' ELSE 'IGE' END AS source
FROM (SELECT *, 12*(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE))//12)::INTEGER AS off,
        CAST(DATE '1995-01-02' + 12*(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE))//12)::INTEGER AS DATE) AS d1,
        12*(1 + CAST(l_quantity AS INTEGER) % 24) AS tb FROM lineitem)),
obs AS (SELECT xi, yi, x, y, date1, date2, temporal_baseline, vx, vy, errorx, errory, source,
  CASE trim(sensor_raw) WHEN 'L8' THEN 'Landsat-8' WHEN 'S2A' THEN 'Sentinel-2' ELSE 'Sentinel-1' END AS sensor,
  CAST(date1 AS TIMESTAMP) + INTERVAL (12 * temporal_baseline) HOUR AS mid_date FROM raw)"""
