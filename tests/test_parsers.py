import random
import re
import time

from pyspark.sql import functions as F

from skeinworks.functions import parsers

CUE = ["TRACK 01 AUDIO", "track 2 x", "TRACK", '  TITLE "a b"', "title x", "TITLE ", 'TITLE ""', "INDEX 01 00:10:00", "index 01 1:2:3", "INDEX 01 bad", "INDEX 00 00:00:00", "INDEX 01 00:05:00", "FILE x", "", "\tINDEX 01 00:10:37 x"]
FFMETA = ["[CHAPTER]", "[chapter] ", "[STREAM]", "TIMEBASE=1/1000", "timebase=1/0", "TIMEBASE=3/2", "timebase=x", "START=10", "START=x", "END = 20", "end=", "END=30", "title=a", "title=", "title=b=c", ";x", "", "START=5", "novalue", "=1"]


def plain_cue(text, total):
    tracks = []
    for line in (x.strip() for x in text.split("\n")):
        upper = line.upper()
        if upper.startswith("TRACK "):
            tracks.append([None, None])
        elif tracks and upper.startswith("TITLE "):
            tracks[-1][1] = re.sub(r'\A"(.*)"\Z', r"\1", line[6:].strip())
        elif tracks and upper.startswith("INDEX 01 "):
            parts = line.split()[2].split(":")
            if len(parts) >= 3 and all(p.isdigit() for p in parts[:3]):
                m, s, f = map(int, parts[:3])
                tracks[-1][0] = m * 60 + s + f / 75
    found = sorted((t[0], k, t[1]) for k, t in enumerate(tracks) if t[0] is not None)
    ends = [x[0] for x in found[1:]] + [max(total, found[-1][0])] if found else []
    return [(k, s, e, t or None) for k, ((s, _, t), e) in enumerate(zip(found, ends, strict=True))]


def plain_ffmeta(text):
    done, block, title = [], None, None

    def close():
        nonlocal title
        if block and block.get("start") is not None and block.get("end") is not None:
            num, den = block.get("base", (1, 1000))
            done.append((len(done), block["start"] * num / den, block["end"] * num / den, title or None))
            title = None

    for line in (x.strip() for x in text.split("\n")):
        if line.startswith("["):
            close()
            block = {} if line.upper() == "[CHAPTER]" else None
        elif block is not None and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            key = key.lower()
            if key in ("start", "end"):
                block[key] = int(value) if value.isdigit() else None
            elif key == "title":
                title = value
            elif key == "timebase" and re.fullmatch("[0-9]+/[1-9][0-9]*", value):
                block["base"] = tuple(map(int, value.split("/")))
    close()
    return done


def test_sidecars_match_a_plain_loop(spark):
    rng = random.Random(3)
    texts = [("\r\n".join(rng.choice(CUE) for _ in range(rng.randrange(14))), "\n".join(rng.choice(FFMETA) for _ in range(rng.randrange(60)))) for _ in range(1500)]
    df = spark.createDataFrame(texts, "cue string, ff string").repartition(4)
    got = df.select("cue", "ff", parsers.parse_cue(F.col("cue"), F.lit(900.0)).alias("c"), parsers.parse_ffmeta(F.col("ff")).alias("f")).collect()
    near = lambda rows: [(k, round(s, 9), round(e, 9), t) for k, s, e, t in rows]
    for r in got:
        assert near(map(tuple, r["c"])) == near(plain_cue(r["cue"], 900)), r["cue"]
        assert near(map(tuple, r["f"])) == near(plain_ffmeta(r["ff"])), r["ff"]
    assert sum(len(r["c"]) for r in got) > 500 and sum(len(r["f"]) for r in got) > 300


def test_long_sidecars_take_linear_time(spark):
    def seconds(n):
        cue = "\n".join(f"TRACK {k}\nTITLE t{k}\nINDEX 01 {k}:00:00" for k in range(n))
        ff = "\n".join(f"[CHAPTER]\nSTART={k}\nEND={k + 1}\ntitle=t{k}" for k in range(n))
        df = spark.createDataFrame([(cue, ff)], "cue string, ff string")
        began = time.perf_counter()
        row = df.select(parsers.parse_cue(F.col("cue"), F.lit(9.0)).alias("c"), parsers.parse_ffmeta(F.col("ff")).alias("f")).select(F.size("c").alias("c"), F.size("f").alias("f"), F.col("c")[n - 1]["title"].alias("t")).first()
        assert tuple(row) == (n, n, f"t{n - 1}")
        return time.perf_counter() - began

    seconds(500)
    # Quadratic work would take 64 times as long.
    assert seconds(32_000) < 20 * seconds(4_000) + 5


def test_sidecars_are_read_by_few_patterns(spark):
    # Expressions within arrays run as written: one that stands in several places is evaluated in each.
    df = spark.createDataFrame([("x",)], "t string")
    plan = lambda c: df.select(c)._jdf.queryExecution().analyzed().expressions().head().toString()
    cue, ff = plan(parsers.parse_cue(F.col("t"), F.lit(1.0))), plan(parsers.parse_ffmeta(F.col("t")))
    # The text has each twice, in the expression and in its name.
    assert cue.count("split(") <= 6 and "translate(" not in cue
    assert ff.count("filter(") <= 6 and ff.count("regexp_extract(") <= 10 and "regexp_replace(" not in ff


def test_edges_of_sidecar_lines(spark):
    sheet = "\n\xa0track 1\x85\n TRACK \n\x85TITLE \"a\tb\"  \nTITLE \n\tINDEX 01  \t1:2:3 x\x85\nINDEX 01 \nTRACK 2\nxTITLE c\nindex 01 0:1:0\xa0\r\n"
    doc = "start=1\n \xa0[chapter]\x85\n\tSTART \xa0= 5\x85\nEnd=+7\nend=x\nEND= 9 \ntitle =a=b\nxtitle=c\nTIMEBASE=1/2\ntimebase=1/0\n[x]\nSTART=1\n\n"
    row = spark.createDataFrame([(sheet, doc)], "s string, d string").select(parsers.parse_cue(F.col("s"), F.lit(5.0)).alias("c"), parsers.parse_ffmeta(F.col("d")).alias("f")).first()
    assert [tuple(x) for x in row["c"]] == [(0, 1.0, 62.04, None), (1, 62.04, 62.04, "a\tb")]
    assert [tuple(x) for x in row["f"]] == [(0, 2.5, 4.5, "a=b")]
