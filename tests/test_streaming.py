from pyspark.sql import functions as F

from firnline.operators import invert as V
from firnline.plans import bridge
from firnline.streaming import acquisitions as A


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_streams_equal_batches(spark, sf):
    batch = A.read_events(spark, sf, stream=False)
    for window in (A.tumbling, A.sliding):
        assert rows(A.drain(window(A.read_events(spark, sf)), "complete")) == rows(window(batch))


def test_closed_windows_are_appended_once(spark, sf):
    got = A.drain(A.tumbling(A.read_events(spark, sf)))
    assert got.groupBy("start", "pixel").count().where("count > 1").count() == 0
    assert set(rows(got)) <= set(rows(A.tumbling(A.read_events(spark, sf, stream=False))))


def test_running_state(spark, sf):
    batch = A.read_events(spark, sf, stream=False).groupBy("pixel").agg(F.count("*").alias("n"))
    assert rows(A.drain(A.running_state(A.read_events(spark, sf)), "update").select("pixel", "n")) == rows(batch)


def test_reinversion_of_touched_pixels(spark, sf, tmp_path):
    obs = bridge.obs(spark, sf).where("xi < 2 and yi < 2")
    run = A.reinvert(f"file://{tmp_path}")
    first, second = obs.where("source = 'IGE'"), obs.where("source <> 'IGE' and xi = 0")
    run(first, 0)
    run(second, 1)
    run(second, 1)  # again, as after a failure
    want = V.invert(first.where("xi = 0").unionByName(second), V.Inversion(regu="1", solver="LS")).orderBy("x", "y", "k").select("x", "y", "k", F.round("result_dx", 6))
    got = spark.read.parquet(f"file://{tmp_path}/ilf/batch=1").orderBy("x", "y", "k").select("x", "y", "k", F.round("result_dx", 6))
    assert got.collect() == want.collect()


def test_drain_of_an_empty_stream_keeps_the_schema(spark, tmp_path):
    source = spark.readStream.schema("pixel long, vx double").parquet(str(tmp_path))
    got = A.drain(source)
    assert got.columns == ["pixel", "vx"] and got.count() == 0
