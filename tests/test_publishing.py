import os
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from skeinworks.sources import episodes, files, tables


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def test_one_of_many_writers_creates_a_file(tmp_path):
    code = "import sys; sys.path.insert(0, sys.argv[1]); from skeinworks.sources import files; sys.stdin.readline(); print(files.create_new(sys.argv[2], sys.argv[3].encode()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for target in (str(tmp_path / "a/claimed"), f"file://{tmp_path}/b/claimed"):
        runs = [subprocess.Popen([sys.executable, "-c", code, root, target, str(k)], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True) for k in range(6)]
        for r in runs:
            r.stdin.write("go\n")
            r.stdin.flush()
        said = [r.communicate()[0].strip() for r in runs]
        assert sorted(said) == ["False"] * 5 + ["True"]
        assert files.read(target) == str(said.index("True")).encode()
        assert files.names(os.path.dirname(target)) == ["claimed"]


def test_only_one_of_two_writers_gets_a_version(spark, tmp_path):
    where = str(tmp_path / "t")
    one, two = (tables.stage({tables.ONLY: rows(spark, v)}, where) for v in "ab")
    assert tables.commit(where, one, None) == 1
    with pytest.raises(tables.Conflict):
        tables.commit(where, two, None)
    assert [r["x"] for r in tables.read_or_empty(spark, where, rows(spark, "").schema).collect()] == ["a"]


def test_the_loser_starts_again_from_what_the_winner_wrote(spark, tmp_path):
    where, schema = str(tmp_path / "t"), rows(spark, "").schema
    calls = []

    def late(now):
        calls.append(sorted(r["x"] for r in now[tables.ONLY].collect()))
        if len(calls) == 1:
            tables.publish(rows(spark, "other"), where)
        return {tables.ONLY: now[tables.ONLY].unionByName(rows(spark, "mine"))}

    assert tables.update(spark, where, {tables.ONLY: schema}, late) == 2
    assert calls == [[], ["other"]]
    assert sorted(r["x"] for r in tables.read_or_empty(spark, where, schema).collect()) == ["mine", "other"]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    where, schema = str(tmp_path / "t"), rows(spark, "").schema

    def add(k):
        tables.update(spark, where, {tables.ONLY: schema}, lambda now: {tables.ONLY: now[tables.ONLY].unionByName(rows(spark, str(k)))})

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["x"] for r in tables.read_or_empty(spark, where, schema).collect()) == ["0", "1", "2", "3"]
    assert tables.versions(where) == [1, 2, 3, 4]


def test_a_step_is_taken_once_and_tables_appear_together(spark, tmp_path):
    where, schema = str(tmp_path / "t"), rows(spark, "").schema
    schemas = {"a": schema, "b": schema}
    both = lambda now: {n: df.unionByName(rows(spark, n)) for n, df in now.items()}
    assert tables.update(spark, where, schemas, both, step=("s", 3)) == 1
    assert tables.update(spark, where, schemas, both, step=("s", 3)) is None
    assert tables.update(spark, where, schemas, both, step=("s", 2)) is None
    old = tables.newest(where)
    assert tables.update(spark, where, schemas, lambda now: {"a": now["a"].limit(0)}, step=("other", 1)) == 2
    assert tables.newest(where).steps == {"s": 3, "other": 1}
    assert tables.read_or_empty(spark, where, schema, "a").count() == 0 and tables.read_or_empty(spark, where, schema, "b").count() == 1
    assert tables.read_version(spark, where, old, schema, "a").count() == 1
    tables.stage({"a": rows(spark, "lost")}, where)  # a writer that stopped before its commit
    assert tables.read_or_empty(spark, where, schema, "a").count() == 0


CHAPTERS = "book_id string, idx long, ext string, content binary, error string"


def published(spark, where):
    return {(r["book_id"], r["idx"]): (files.read(r["file"]), r["length"], os.path.basename(r["file"])) for r in episodes.published_files(spark, where).collect()}


def test_a_failing_chapter_publishes_none_of_its_book(spark, tmp_path):
    where = str(tmp_path / "out")
    first = [("a", 0, "m4a", b"a0", None), ("a", 1, "m4a", b"a1+", None), ("b/..", 0, "mp3", b"", None)]
    out = episodes.publish_episodes(spark.createDataFrame(first, CHAPTERS), where).collect()
    assert all(r["published"] for r in out)
    want = {("a", 0): (b"a0", 2, "001.m4a"), ("a", 1): (b"a1+", 3, "002.m4a"), ("b/..", 0): (b"", 0, "001.mp3")}
    assert published(spark, where) == want
    second = [("a", 0, "m4a", b"new", None), ("a", 2, "m4a", None, "cut 2"), ("a", 1, "m4a", None, None), ("c", 0, "m4a", b"c", None), ("c", 0, "m4a", b"c", None), ("d", 0, "m4a", b"d", None)]
    out = {r["book_id"]: (r["published"], r["first_error"], r["error"]) for r in episodes.publish_episodes(spark.createDataFrame(second, CHAPTERS), where).collect()}
    assert out == {"a": (False, 1, "not produced"), "c": (False, None, "a chapter is there twice"), "d": (True, None, None)}
    assert published(spark, where) == want | {("d", 0): (b"d", 1, "001.m4a")}
    episodes.publish_episodes(spark.createDataFrame([("a", 0, "m4a", b"one", None)], CHAPTERS), where)
    assert {k: v[0] for k, v in published(spark, where).items() if k[0] == "a"} == {("a", 0): b"one"}
    episodes.publish_episodes(spark.createDataFrame([("a", 0, "m4a", None, "all bad")], CHAPTERS), where)
    assert len(tables.versions(where)) == 3 and episodes.published_files(spark, where).where(F.col("row") == 1).count() == 3
