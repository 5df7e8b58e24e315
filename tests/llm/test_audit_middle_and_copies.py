import hashlib
import random
import re
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinworks.llm import exact_dedup, fill_in_middle, filter_audit

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_flags(rows):
    out = []
    for d, t, source in rows:
        t, w = t or "", WORD.findall(t or "")
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in rows),
        }
        out.append((d, source or "", fails))
    return out


def plain_audit(rows, good, toxic):
    flags, counts = plain_flags(rows), {}
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for part in {p for _, p, _ in flags}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for d, p, f in flags if p == part]
            gone = []
            for k, x in enumerate(order, 1):
                here = [(d, f) for d, f in left if f[x]]
                left = [(d, f) for d, f in left if not f[x]]
                unique = sum(p == part and f[x] and sum(f.values()) == 1 for _, p, f in flags)
                values = (len(left), len(here), sum(f[x] for _, f in gone), unique, sum(d in good for d, _ in here), sum(d in toxic for d, _ in here))
                counts[part, order, k] = dict(zip(names, values, strict=True))
                gone += here
    for (part, order, k), row in counts.items():
        row["shapley"] = sum(counts[part, o, o.index(order[k - 1]) + 1]["removed"] for o in map("".join, permutations("ABCDE")))
    return counts


def audited(spark, docs, labels):
    got = filter_audit.replay(filter_audit.document_flags(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    found = {(r["part"], r["filter_order"], r["step"]): {k: v for k, v in r.asDict().items() if k not in ("part", "filter_order", "step")} for r in got}
    assert len(found) == len(got)
    return found


def test_the_audit_matches_a_replay_filter_by_filter(spark):
    rng = random.Random(5)
    rows = []
    for k in range(70):
        text = " ".join(rng.choice(["word%d" % rng.randrange(rng.choice([20, 4000])), "Big", "x"]) for _ in range(rng.choice([0, 50, 199, 200, 300])))
        rows.append((k, text + rng.choice(["", "", " #", " a|b"]), rng.choice(["a", "b", None, ""])))
    rows += [(100 + k, rows[k % 7][1], "a") for k in range(30)]
    labels = [(d, rng.randrange(2), rng.randrange(2)) for d in range(0, 130, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain_audit(rows, {d for d, q, _ in labels if q}, {d for d, _, t in labels if t})
    assert audited(spark, df.repartition(5), labels) == want
    assert sum(r["shapley"] for r in want.values()) > 0


def test_awkward_rows_are_audited(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    labels = [(5, 1, 0), (5, 0, 1), (9, None, 1), (None, 1, 1)]
    assert audited(spark, awkward, labels) == plain_audit(rows, {5}, {5, 9})
    assert audited(spark, nothing, labels) == {} and len(audited(spark, awkward, [])) == 5 * 600 - 600 * (5 - len({s or "" for _, _, s in rows}))


def test_limits_are_whole_numbers(spark):
    words = [f"w{k}" for k in range(100)]
    cases = {1: " ".join(words + ["w0"] * 100), 2: " ".join(words + ["w0"] * 101), 3: "A" + "b" * 49, 4: "A" + "b" * 48, 5: "é" * 49 + "A"}
    df = spark.createDataFrame([(k, t, "s") for k, t in cases.items()], "doc_id long, text string, source string")
    failed = {r["doc_id"]: r["failed"] for r in filter_audit.text_failures(df).collect()}
    assert failed == {1: 0, 2: 2, 3: 1, 4: 5, 5: 1}


def test_the_orders_are_of_fixed_size(spark):
    assert filter_audit.orders(spark).count() == 120 and filter_audit.orders(spark, "AB").count() == 2
    flags = spark.createDataFrame([("p", 3, False, False)], "part string, failed int, good boolean, toxic boolean")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in filter_audit.replay(flags, "AB").collect()}
    assert got == {("AB", 1): (0, 1, 0, 1), ("AB", 2): (0, 0, 1, 1), ("BA", 1): (0, 1, 0, 1), ("BA", 2): (0, 0, 1, 1)}


def plain_middle(d, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall("[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return d, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return d, n, form, len(p), len(m), sha(out), sha(text)


def middles(docs):
    out = fill_in_middle.fill_in_middle(docs)
    back = F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256)
    rows = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), back).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_middles_match_a_plain_loop(spark, awkward, nothing):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é日\U0001f600\n\n\r \x0b") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["a<P>b", "x\n<S>", "<M>", "\n", "a", "<p>\n<X>\n< P>", "line\n" * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = middles(df)
    assert got == sorted((plain_middle(d, t) for d, t in enumerate(texts)), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"} and [r[5] for r in got] != [r[6] for r in got]
    assert middles(awkward) == sorted((plain_middle(r["doc_id"], r["text"]) for r in awkward.collect()), key=str)
    assert middles(nothing) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_units_end_where_the_pattern_says(text):
    assert fill_in_middle.unit_ends(text) == [m.end() for m in re.finditer("[^\n]*\n|[^\n]+", text)]


def test_transformed_documents_keep_their_columns(awkward):
    out = fill_in_middle.transformed(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    never = fill_in_middle.transformed(awkward.where("text IS NOT NULL"), cut=0)
    assert sorted(never.collect(), key=str) == sorted(awkward.where("text IS NOT NULL").collect(), key=str)


def plain_copies(rows, largest=True):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out, seen = [], set()
    for d, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        first = d == keep and (t or "") not in seen
        seen |= {t or ""} if first else set()
        out.append((d, keep, len(groups[t or ""]), first, sha(t or "")))
    return sorted(out, key=str)


def copies(docs, **settings):
    out = exact_dedup.exact_duplicates(docs, **settings)
    return sorted((tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()), key=str)


def test_copies_match_a_plain_loop_for_any_number_of_leaves(spark, awkward, nothing):
    rng = random.Random(7)
    rows = [(k, rng.choice(["hot", "hot", f"t{rng.randrange(60)}", f"T{k}", "é", None, ""])) for k in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts, settings_ in ((1, {}), (2, {}), (7, {"bits": 1}), (20, {"bits": 2}), (20, {"largest": False})):
        assert copies(df.repartition(parts), **settings_) == plain_copies(rows, settings_.get("largest", True))
    awkward_rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert copies(awkward) == plain_copies(awkward_rows) and copies(awkward, largest=False) == plain_copies(awkward_rows, False)
    assert copies(nothing) == []


def test_a_hot_digest_is_one_entry_a_leaf_and_nodes_stay_even(spark):
    text = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(16)
    found = exact_dedup.digests(docs).withColumn("stays", F.struct("doc_id", "row")).withColumn("n", F.lit(1).cast("long"))
    runs = exact_dedup._merged(found, "leaf", 16, F.max)
    assert runs.groupBy(*exact_dedup.KEY).count().agg(F.max("count")).first()[0] <= 16
    merged = exact_dedup.tree_merge(runs, 16)
    assert merged.count() == 4001 and merged.agg(F.max("n")).first()[0] == 2000
    # Small partitions would be read together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in exact_dedup.tree_merge(runs, 16).groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 16 and max(sizes) < 400


def test_texts_are_equal_only_if_all_hashes_agree(spark):
    row = lambda second: (0, bytearray(b"d" * 32), 3, second, (second,), 1)
    runs = spark.createDataFrame([row(1), row(2), row(1)], "leaf int, digest binary, bytes long, second long, stays struct<id:long>, n long")
    assert sorted(r["n"] for r in exact_dedup._merged(runs, "leaf", 1, F.max).collect()) == [1, 2]


def test_rows_that_stay(spark, awkward, nothing):
    out = exact_dedup.drop_duplicates(awkward)
    want = sorted((r[0], r[4]) for r in plain_copies([(r["doc_id"], r["text"]) for r in awkward.collect()]) if r[3] and r[0] is not None)
    assert out.columns == awkward.columns
    assert sorted((r["doc_id"], sha(r["text"] or "")) for r in out.collect() if r["doc_id"] is not None) == want
    assert exact_dedup.drop_duplicates(nothing).count() == 0
    folded = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.drop_duplicates(folded, normal=F.lower).collect()) == [2, 3]
