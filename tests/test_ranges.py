import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import cache, feed, identity, metrics, ranges

#: A third of all rows has one key.
KEYS = ["hot"] * 300 + [f"k{n % 40}" for n in range(560)] + [None] * 40


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(k, n, rng.randrange(-3, 9)) for n, k in enumerate(rng.sample(KEYS, len(KEYS)))]


@pytest.fixture(autouse=True, scope="module")
def many_ranges(spark):
    """Keys of more than 60 rows are dealt in ranges here; small ranges are read together otherwise."""
    before, ranges.LARGE = ranges.LARGE, 60
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    ranges.LARGE = before
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(params=[0, 60, 1_000_000], ids=["all keys", "hot keys", "no keys"])
def in_ranges(request, monkeypatch):
    """Which keys are dealt in ranges; the rows must be the same."""
    monkeypatch.setattr(ranges, "LARGE", request.param)


def test_only_large_keys_are_crowded(spark, rows):
    df = spark.createDataFrame(rows, "k string, n int, v int")
    assert [r["k0"] for r in ranges.crowded(df, ["k"]).collect()] == ["hot"]
    assert ranges.crowded(df, ["k", "n"]).count() == 0


def test_running_sums_and_neighbours(spark, rows, in_ranges):
    df = spark.createDataFrame(rows, "k string, n int, row int")
    got = ranges.running(df, ["k"], ["n"], {"total": F.col("row"), "place": F.lit(1)})
    assert got.columns == ["k", "n", "row", "total", "place"]
    sums, places, want = defaultdict(int), defaultdict(int), {}
    for k, n, v in rows:
        sums[k] += v
        places[k] += 1
        want[n] = (sums[k], places[k])
    assert {r["n"]: (r["total"], r["place"]) for r in got.collect()} == want
    after = {r["n"]: r["next"] for r in ranges.following(df, ["k"], ["n"], F.col("n"), "next").collect()}
    later = {}
    for k, n, _ in reversed(rows):
        want[n], later[k] = later.get(k), n
    assert after == want
    assert ranges.running(df.limit(0), ["k"], ["n"], {"place": F.lit(1)}).count() == 0
    alone = ranges.running(df, [], ["n"], {"place": F.lit(1)})
    assert sorted((r["n"], r["place"]) for r in alone.collect()) == [(n, n + 1) for n in range(len(rows))]


def test_totals_and_what_came_before(spark, rows, in_ranges):
    data = [(k, n, v if v % 3 else None, k) for k, n, v in rows]
    df = spark.createDataFrame(data, "k string, n int, k0 int, s0 string")
    sums, last, before = defaultdict(int), {}, {}
    for k, n, v, _ in data:
        sums[k] += v or 0
        before[n] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    got = ranges.totals(df, ["k"], {"total": F.col("k0")})
    assert {r["n"]: (r["k"], r["k0"], r["s0"], r["total"]) for r in got.collect()} == {n: (k, v, s, sums[k]) for k, n, v, s in data}
    assert {r["n"]: r["seen"] for r in ranges.last_before(df, ["k"], ["n"], F.col("k0"), "seen").collect()} == before
    assert {r["total"] for r in ranges.totals(df, [], {"total": F.lit(1)}).collect()} == {len(data)}
    assert ranges.totals(df.limit(0), ["k"], {"total": F.lit(1)}).count() == 0
    assert ranges.last_before(df.limit(0), ["k"], ["n"], F.col("k0"), "seen").count() == 0


def test_chapters_and_dates_of_a_hot_book(spark, rows, in_ranges):
    """Starts that come again, and one after the end."""
    df = spark.createDataFrame([(k, n, float(v + 3), 5.0) for k, n, v in rows], "book string, n int, start double, total double")
    of_book = defaultdict(list)
    for k, n, v in rows:
        of_book[k].append((float(v + 3), n))
    ends, places = {}, {}
    for found in of_book.values():
        found.sort()
        for k, (start, n) in enumerate(found):
            ends[n] = found[k + 1][0] if k + 1 < len(found) else max(5.0, start)
            places[n] = (k, 1000 - 60 * (len(found) - 1 - k))
    assert {r["n"]: r["end_sec"] for r in feed.close_intervals(df, ["book"], "start", "total", ["n"]).collect()} == ends
    dated = feed.item_dates(feed.renumber(df, ["book"], ["start", "n"]).withColumn("anchor", F.lit(1000)), ["book"], "anchor")
    assert {r["n"]: (r["idx"], r["pubdate_epoch"]) for r in dated.collect()} == places


def test_order_of_the_dates_of_a_hot_feed(spark, in_ranges):
    """A date is held against the last one that can be read, of an item with a number."""
    rng = random.Random(5)
    day = lambda n: f"{n:02} Jan 2024 00:00:00 +0000"
    data = []
    for n in range(400):
        date = rng.choice([day(1 + n % 28), day(rng.randrange(1, 29)), "soon"])
        data.append(("hot" if n % 3 else f"f{n % 5}", n, rng.choice([str(n), str(rng.randrange(400)), "x"]), "u", "1", "1", date))
    late, last = set(), {}
    for f, pos, episode, *_, date in sorted((d for d in data if d[2] != "x" and d[6] != "soon"), key=lambda d: (int(d[2]), d[1])):
        at = int(date[:2])
        if f in last and at <= last[f]:
            late.add((f, pos, int(episode)))
        last[f] = at
    items = spark.createDataFrame(rng.sample(data, len(data)), "feed string, pos int, episode string, enclosure_url string, enclosure_length string, duration string, pub_date string")
    found = feed.feed_problems(items.select("feed"), items).collect()
    assert {(r["feed"], r["pos"], r["episode"]) for r in found if r["problem"] == "not_later"} == late and late
    assert sum(r["problem"] != "not_later" for r in found) == sum((d[2] == "x") + (d[6] == "soon") for d in data)


def test_a_cap_within_a_hot_group(spark, rows, in_ranges):
    files = [(k, f"p{n:03}", v + 4, n // 7) for k, n, v in rows]
    of_group, gone = defaultdict(list), set()
    for f in files:
        of_group[f[0]].append(f)
    kept = lambda path: path.endswith("3")
    for found in of_group.values():
        total = sum(f[2] for f in found)
        for _, path, length, _ in sorted(found, key=lambda f: (f[3], f[1])):
            if not kept(path) and total > 40:
                gone.add(path)
                total -= length
    df = spark.createDataFrame(files, "dir string, path string, length long, mtime long")
    out = cache.over_cap(df, 40, F.col("path").endswith("3"), within=["dir"])
    assert out.columns == df.columns and {r["path"] for r in out.collect()} == gone


def test_a_hot_key_lies_in_many_ranges(spark, rows):
    dealt, *_ = ranges._ranged(spark.createDataFrame(rows, "k string, n int, v int"), ["k"], ["n"], {})
    of_hot = {r["range"]: r["count"] for r in dealt.where("k0 = 'hot'").groupBy("range").count().collect()}
    assert len(of_hot) > 1 and max(of_hot.values()) < 250


def test_tracks_of_a_hot_folder(spark):
    rng = random.Random(2)
    files = [("hot", n, f"F{n}") for n in range(200)] + [("twice", n // 2, f"{'aB'[n % 2]}{n:03}") for n in range(100)] + [(None, None, "x"), (None, 2, "A")]
    rng.shuffle(files)
    got = feed.track_order(spark.createDataFrame(files, "dir string, track int, name string"), ["dir"], "track", "name")
    found = {(r["dir"], r["name"]): r["idx"] for r in got.collect()}
    want = {("hot", f"F{n}"): n for n in range(200)} | {(None, "A"): 0, (None, "x"): 1}
    want |= {("twice", name): k for k, name in enumerate(sorted((f[2] for f in files if f[0] == "twice"), key=str.lower))}
    assert found == want


def plain_place(values, p):
    return sorted(values)[int((len(values) - 1) * p)]


def test_places_are_selected_without_sorting_a_group(spark):
    rng = random.Random(3)
    groups = {
        "wide": [rng.choice([rng.random(), rng.random() * 1e9, -1e300]) for _ in range(900)],
        "ties": [1.0] * 500 + [2.0] * 400 + [3.0],
        "one": [7.0],
        "same": [5.0] * 300,
        "odd": [float("inf"), float("-inf"), *[float(k) for k in range(100)]],
        None: [float(k % 10) for k in range(50)],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None), ("none", None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, v double")
    ps = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = metrics.place_percentiles(df, "v", ps, ["g"], buckets=8, few=4).collect()
    assert len(got) == len(groups)
    for r in got:
        vs = groups[r["g"]]
        assert (r["p0"], r["p50"], r["p95"], r["p99"], r["p100"], r["max"], r["n"]) == (*[plain_place(vs, p) for p in ps], max(vs), len(vs)), r["g"]
    whole = [v for vs in groups.values() for v in vs]
    (r,) = metrics.place_percentiles(df, "v", (0.5,), buckets=8, few=4).collect()
    assert r["p50"] == plain_place(whole, 0.5) and r["n"] == len(whole)
    texts = spark.createDataFrame([(f"t{k:03}",) for k in range(60)], "v string")
    assert metrics.place_percentiles(texts, "v", (0.5,), few=4).first()["p50"] == "t029"
    assert metrics.place_percentiles(df.limit(0), "v", (0.5,)).count() == 0


def plain_slugs(items, owned):
    """``owned``: slug and source pairs; a slug of several sources is nobody's."""
    seen, out, owners = set(), [], defaultdict(set)
    for slug, source in owned:
        owners[slug].add(source)
    for base, source in items:
        n = 1
        while True:
            slug = base if n == 1 else f"{base}-{n}"
            if slug not in seen and owners.get(slug, {source}) <= {source}:
                break
            n += 1
        seen.add(slug)
        out.append(slug)
    return out


def assigned(spark, items, owned):
    df = spark.createDataFrame([(b, s, k) for k, (b, s) in enumerate(items)], "base string, source_path string, position int").repartition(3)
    held = spark.createDataFrame(owned, "slug string, source_path string") if owned else None
    got = {r["source_path"]: r["slug"] for r in identity.assign_slugs(df, held).collect()}
    return [got[s] for _, s in items]


@pytest.mark.parametrize("seed", range(3))
def test_slugs_of_many_roots_match_a_plain_loop(spark, seed):
    """Roots don't meet, so one table has a case in each."""
    rng = random.Random(seed)
    items, owned = [], []
    for root in range(120):
        ends = rng.sample(["", "-2", "-2-2", "-2-3", "-3", "-4", "-02", "-1", "-5"], rng.randrange(1, 6))
        mine = [(f"r{root}x{rng.choice(ends)}", f"/{root}/{k}") for k in range(rng.randrange(1, 16))]
        items += mine
        for _ in range(rng.choice([0, 0, 3, 8])):
            source = rng.choice([*[s for _, s in mine], f"/gone/{root}"])
            owned.append((f"r{root}x{rng.choice(['', '-2', '-3', '-4', '-6', '-2-2', '-9'])}", source))
    rng.shuffle(items)
    assert assigned(spark, items, owned) == plain_slugs(items, owned)


def test_slugs_of_a_second_scan_stay(spark):
    rng = random.Random(9)
    items = [(rng.choice(["book", "book", "book-2", "book-7", f"own{k}"]), f"/s{k}") for k in range(150)]
    first = plain_slugs(items, [])
    owned = [(slug, source) for slug, (_, source) in zip(first, items, strict=True) if source != "/s3"]
    again = [x for x in items if x[1] != "/s5"] + [("book", "/new")]
    assert assigned(spark, again, owned) == plain_slugs(again, owned)
