import datetime
import random

from pyspark.sql import functions as F

from skeinworks.operators import cache
from skeinworks.streaming import eviction

CHANGES = "path string, kind string, length long, mtime long, keep boolean, ts timestamp, book_dir string"
at = lambda s: datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=s)


def feed(spark, folder, batches, ttl, owners=None, name="evicted"):
    """What fires after each batch; a query is stopped and started again between them."""
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(CHANGES).parquet(f"{folder}/in")
        found = eviction.expiries(stream, ttl, owners)
        got = []
        query = found.writeStream.foreachBatch(lambda b, n: got.extend((r["path"], r["mtime"]) for r in b.collect())).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        seen.append(sorted(got))
    return seen


def test_what_fires_is_what_a_listing_would_show(spark, tmp_path):
    rng, ttl = random.Random(1), 20
    batches, now, listing, want, fired = [], 0, {}, [], set()
    for _ in range(4):
        rows = []
        for _ in range(12):
            now += rng.randrange(1, 4)
            path, kind = f"p{rng.randrange(14)}", rng.choice(["create", "modify", "remove"])
            mtime = now + rng.choice([0, 0, -3, 500])
            keep = path == "p3"
            rows.append((path, kind, 1, mtime, keep, at(now), "d"))
            if kind == "remove":
                listing.pop(path, None)
            else:
                listing[path] = (path, mtime, keep)
            fired -= {x for x in fired if x[0] == path}
        batches.append(rows)
        table = spark.createDataFrame([(p, 1, m, k) for p, m, k in listing.values()], "path string, length long, mtime long, keep boolean")
        old = {(r["path"], r["mtime"]) for r in cache.expired(table, F.lit(now), ttl, F.col("keep")).collect()}
        want.append(sorted(old - fired))
        fired |= old
    assert sum(map(len, want)) > 3
    assert feed(spark, str(tmp_path), batches, ttl) == want


def test_only_what_can_be_made_again_expires(spark, tmp_path):
    rows = [("a", "create", 1, 0, False, at(1), "mine"), ("b", "create", 1, 0, None, at(1), "other"), ("c", "create", 1, 95, False, at(100), "mine"), ("d", "create", 1, 90, False, at(100), "mine")]
    owners = spark.createDataFrame([("mine",)], "book_dir string")
    assert feed(spark, str(tmp_path / "x"), [rows], 10, owners) == [[("a", 0)]]
    assert feed(spark, str(tmp_path / "y"), [rows], None, owners) == [[]]
