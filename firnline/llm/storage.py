"""Tables written between stages, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_written: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none: a temporary folder on one machine, as in tests, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="firnline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, noted for `sweep`."""
    where = f"{shared_dir(spark)}/firnline-{name}-{uuid.uuid4().hex}"
    _written.append(("path", where))
    return where


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: its lineage ends there, and lost executors cost nothing already written."""
    where = path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new name in the catalogue and its place in the shared folder, noted for `sweep`."""
    where = path(spark, name)
    called = "firnline_" + where.rpartition("/")[2].replace("-", "_")
    _written.append(("table", called))
    return called, where


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written in here gives the files of its shuffles back once it is written, not when the driver collects its
    garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mark() -> int:
    """What is written from here on can be swept."""
    return len(_written)


def sweep(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Drops what was written since a mark, but for the files that `but` reads. Call it once what depends on those is
    saved."""
    kept = [f.rpartition("/")[0] for f in but.inputFiles()] if but is not None else []
    stay = []
    for kind, name in _written[since:]:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        elif any(k.endswith(name.rpartition("/")[2]) for k in kept):
            stay.append((kind, name))
        else:
            target = spark._jvm.org.apache.hadoop.fs.Path(name)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written[since:] = stay


def broadcast_if_small(df: DataFrame, rows: int, width: int, most: int = 64 << 20) -> DataFrame:
    """df marked for broadcast if `rows` of about `width` bytes are within `most` bytes, else df for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows * width <= most else df
