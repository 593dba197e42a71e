"""Acquisitions as a stream: windows over event time with late data, and re-inversion of touched pixels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.invert import NEEDED, Inversion, invert

LATE = "10 days"


def acquisitions(events: DataFrame) -> DataFrame:
    """ts, pixel, vx, vy of an events table: a batch or a stream."""
    ts = F.col("ts").cast("timestamp").alias("ts")
    return events.select(ts, (F.col("user_id") % 40).alias("pixel"), F.col("value").alias("vx"), F.get_json_object("props", "$.k").cast("double").alias("vy"))


def read_events(spark: SparkSession, sf_dir: str, stream: bool = True) -> DataFrame:
    where = f"{sf_dir}/events.parquet"
    if not stream:
        return acquisitions(spark.read.parquet(where))
    # a single file is its folder's only match
    folder, _, name = where.rpartition("/")
    return acquisitions(spark.readStream.schema(spark.read.parquet(where).schema).option("pathGlobFilter", name).parquet(folder))


def _sums(rows):
    return rows.agg(F.count("*").alias("n"), F.avg("vx").alias("vx"))


def tumbling(acq: DataFrame, length: str = "30 days", late: str = LATE) -> DataFrame:
    own = acq.withWatermark("ts", late) if acq.isStreaming else acq
    return _sums(own.groupBy(F.window("ts", length), "pixel")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "pixel", "n", "vx")


def sliding(acq: DataFrame, length: str = "30 days", every: str = "5 days", late: str = LATE) -> DataFrame:
    own = acq.withWatermark("ts", late) if acq.isStreaming else acq
    return _sums(own.groupBy(F.window("ts", length, every), "pixel")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "pixel", "n", "vx")


def sessions(acq: DataFrame, gap: str = "1 day", late: str = LATE) -> DataFrame:
    own = acq.withWatermark("ts", late) if acq.isStreaming else acq
    return _sums(own.groupBy(F.session_window("ts", gap), "pixel")).select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), "pixel", "n", "vx")


def running_state(acq: DataFrame) -> DataFrame:
    """pixel, n, vx: how many acquisitions a pixel has had and their mean, kept as state between batches."""

    def update(key, frames: Iterator[pd.DataFrame], state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["vx"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"pixel": [key[0]], "n": [n], "vx": [total / max(n, 1)]})

    return acq.groupBy("pixel").applyInPandasWithState(update, "pixel long, n long, vx double", "n long, total double", "update", "NoTimeout")


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote: tables in the shared folder, one for each batch, of
    which `complete` needs the last alone. A batch that runs again overwrites its own."""
    spark = df.sparkSession
    where = f"{_shared(spark)}/drained_{uuid.uuid4().hex}"
    written: list[str] = []

    def batch(rows: DataFrame, number: int) -> None:
        at = f"{where}/rows/{number}"
        rows.write.mode("overwrite").parquet(at)
        if mode == "complete":
            written.clear()
        if at not in written:
            written.append(at)

    query = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(df.schema).parquet(*written) if written else spark.createDataFrame([], df.schema)


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only if there is none and the session has one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="firnline_")


def reinvert(store: str, p: Inversion | None = None):
    """A foreachBatch function: appends new pairs to a table below `store` and writes the series of the pixels that the
    batch touches, one folder for each batch, so a batch that runs again overwrites its own results only."""
    p = p or Inversion(regu="1", solver="LS")

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.select(*NEEDED).write.mode("overwrite").parquet(f"{store}/obs/batch={number}")
        touched = df.select("x", "y").distinct()
        obs = spark.read.parquet(f"{store}/obs").join(touched, ["x", "y"], "left_semi")
        invert(obs, p).write.mode("overwrite").parquet(f"{store}/ilf/batch={number}")

    return batch
