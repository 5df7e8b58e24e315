import datetime

from pyspark.sql import functions as F

from skeinworks import schema
from skeinworks.functions import text
from skeinworks.operators import cache, identity
from skeinworks.streaming import changes


def test_one_job_at_a_time_for_a_key(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    seen = []
    for rows in ([("a", 0), ("a", 1), ("b", 1)], [("a", 2), ("c", 3)], [("b", 500)], [("a", 501), ("b", 502)]):
        spark.createDataFrame([(k, at(s)) for k, s in rows], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
        first = changes.first_of_each(stream, "key", "10 seconds")
        query = first.writeStream.foreachBatch(lambda b, n: seen.extend(r["key"] for r in b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    # Long after, a key's window is closed and it may come again.
    assert seen[:3].count("a") == 1 and sorted(seen) == ["a", "a", "b", "b", "c"]


def test_what_can_be_made_again(spark):
    df = spark.createDataFrame([(s, t, f) for s in (True, False) for t in (True, False) for f in (True, False)], "s boolean, t boolean, f boolean")
    got = df.where(cache.is_regenerable(F.col("s"), F.col("t"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(True, False, True)]


def test_fresh_ids_and_known_labels(spark):
    ids = identity.capability_ids(200)
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert len(set(ids)) == 200 and df.where(text.is_capability(F.col("id"))).count() == 200
    labels = spark.createDataFrame([("full",), ("",), ("x",), (None,)], "label string")
    for known in (schema.known_or_null, text.known_label):
        assert [r[0] for r in labels.select(known(F.col("label"), ("full", "saver"))).collect()] == ["full", None, None, None]
