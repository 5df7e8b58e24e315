import datetime
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from skeinworks.llm import merkle, mixing, packing, pseudonyms
from skeinworks.llm.tokens import Encoder

tokenizers = pytest.importorskip("public_tokenizers")


def plain_targets(sizes):
    """Targets by reshaping the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.CYCLE[k % 3] for k, s in enumerate(order)}
    left, open_, target = mixing.SHARE * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        stopped = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not stopped:
            return target | {s: left * weight[s] / total for s in open_}
        for s in stopped:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in stopped]
    return target


def test_targets_match_repeated_sharing(spark):
    rng = random.Random(1)
    for _ in range(5):
        sizes = {f"s{k}": rng.choice([0, 3, 50, 1000, 20000]) for k in range(9)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_the_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df).join(df, "doc_id").collect()
    assert len(out) == 900
    for s in ("a", "b", "c", None):
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
        assert len({r["copies"] for r in mine}) <= 2 and all(0 <= r["copies"] <= 2 for r in mine)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in out}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in out)


def test_heavier_documents_are_chosen_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    weight = F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0)
    out = mixing.mix_sources(df, weight=weight, share=0.5, cycle=(1,))
    got = {r["g"]: r["n"] for r in out.groupBy((F.col("doc_id") % 4 < 2).alias("g")).agg(F.sum("copies").alias("n")).collect()}
    assert got[True] > 2 * got[False]


def test_columns_with_the_names_that_operators_use(spark):
    from skeinworks.llm import fuzzy_lines, passages

    line = "these words are the same in both of the rows and there are more than twenty of them so that they are a passage too"
    names = ["doc_id", "text", "source", "_gone", "_copies", "_copy", "_mix_id", "a.b", "row", "removed", "spans", "boxed", "left"]
    rows = [(k, line + "\n" + own, "s", *range(10)) for k, own in ((1, "one line of the first row"), (2, "quite another thing for once"))]
    df = spark.createDataFrame(rows, names)
    for out in (fuzzy_lines.dedup_lines(df), passages.dedup_passages(df), mixing.mixed_documents(df)):
        assert out.columns == names and all(r[3:] == tuple(range(10)) for r in out.collect())
    assert [r["text"] for r in fuzzy_lines.dedup_lines(df).orderBy("doc_id").collect()] == [rows[0][1], "quite another thing for once"]


def test_awkward_mixes(awkward, nothing):
    out = mixing.mix_sources(awkward).collect()
    assert len(out) == awkward.count() and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mixed_documents(awkward).columns == awkward.columns
    assert mixing.mix_sources(nothing).count() == 0


PATH = str(tokenizers.path(packing.TOKENIZER))


def test_encoding_matches_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    alphabet = "ab'sé\n \t .,1日　\xa0 <|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice("abcde,") for _ in range(rng.randrange(1, 9))) for _ in range(50)) for _ in range(200)]
    texts += ["a <|endoftext|> b", "some words<|endoftext|>\nand more", "<|endoftext|>", "a <|endoftext| > b"]
    texts += ["", " ", "\n", "a\n", "a 's\n's b", "x\n\ny", "end "]
    own = Encoder(PATH, keep=500)
    got = [x for k in range(0, len(texts), 300) for x in own.encode(pa.array(texts[k : k + 300]))]
    assert [x.tolist() for x in got] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, expected):
    """All ids of all documents once, sequences gapless, and padded only a little."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    padding = used = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= packing.WINDOW and all(p["tier"] == at for p in pieces) and len({p["step_group"] for p in pieces}) == 1
        used += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    for d, ids in expected.items():
        spans = []
        for p in by_doc[d]:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["doc_tokens"] == len(ids) and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == p["ids_crc32"]
            spans += range(p["start"], p["start"] + p["length"])
        assert sorted(spans) == list(range(len(ids)))
    return padding, used


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    docs = [(k, "\n".join(" ".join(rng.choice(["alpha", "beta,", "Gamma.", "δ", "x1"]) for _ in range(rng.randrange(30))) for _ in range(rng.choice([0, 1, 3, 40, 200])))) for k in range(400)]
    plain = Tokenizer.from_file(PATH)
    expected = {d: [*plain.encode(t, add_special_tokens=False).ids, 0] for d, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    rows = packing.pack_documents(df, PATH, waiting=50).collect()
    padding, used = check_pieces(rows, expected)
    assert used == sum(map(len, expected.values())) and padding <= 2 * packing.WINDOW


def test_step_groups_are_even():
    import numpy as np

    packer = packing.Packer(step=8 * 1024)
    rng = random.Random(0)
    for k in range(600):
        packer.add(k, np.zeros(rng.randrange(1, 2500), "<u4"))
    packer.pack(last=True)
    rows = packer.sequences().to_pylist()
    loads = {}
    for r in rows:
        loads[r["step_group"]] = loads.get(r["step_group"], 0) + r["length"]
    assert max(loads.values()) - min(loads.values()) <= 1024


def test_step_groups_are_even_however_often_a_task_emits():
    import numpy as np

    packer = packing.Packer(step=8 * 1024)
    rng = random.Random(1)
    loads = {}
    for k in range(900):
        packer.add(k, np.zeros(rng.randrange(1, 2500), "<u4"))
        if k % 37 == 0:
            packer.pack(last=False)
            for r in packer.sequences(last=False).to_pylist():
                loads[r["step_group"]] = loads.get(r["step_group"], 0) + r["length"]
    assert len(loads) > 100 and all(7 * 1024 < x <= 9 * 1024 for x in loads.values())
    packer.pack(last=True)
    left = packer.sequences().to_pylist()
    assert sum(loads.values()) + sum(r["length"] for r in left) > 900_000 and loads.keys().isdisjoint({r["step_group"] for r in left})


def test_awkward_packing(awkward, nothing):
    rows = packing.pack_documents(awkward.where("doc_id IS NOT NULL"), PATH).collect()
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert sum(r["doc_id"] == 9 for r in rows) >= 2
    assert packing.pack_documents(awkward, PATH).where("doc_id IS NULL").count() >= 2
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_edits_match_a_plain_loop(spark, awkward):
    rng = random.Random(6)
    docs = [(k * 3, "".join(rng.choice("ab. \n") for _ in range(rng.randrange(120)))) for k in range(80)] + [(500, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in merkle.fingerprint_edits(df.repartition(5)).collect()}
    order = sorted(docs, reverse=True, key=lambda d: d[0])
    prints = {}
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[d]["near_edited"] == 1.0) == (edited == t)
        assert 0 <= got[d]["near_next"] <= 1
        prints.setdefault(got[d]["fingerprint"], t)
        assert prints[got[d]["fingerprint"]] == t
    assert len(prints) == len({t or "" for _, t in docs})


def test_edits_of_awkward_rows(awkward, nothing):
    out = merkle.fingerprint_edits(awkward).collect()
    assert len(out) == awkward.count()
    assert all(r["near_next"] is None for r in out if r["doc_id"] is None)
    assert merkle.fingerprint_edits(nothing).count() == 0
    assert merkle.fingerprint_edits(awkward.where("doc_id = 6")).first()["near_next"] == 1.0


def test_changed_paragraphs_are_found(spark):
    lines = [f"Line number {k} has its own words." for k in range(40)]
    other = [*lines[:17], "Something else stands here.", *lines[18:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    row = df.select(merkle.changed_paragraphs(a, b).alias("x"), merkle.changed_paragraphs(a, a).alias("y"), (merkle.root(a) == merkle.root(b)).alias("same")).first()
    assert (list(row["x"]), list(row["y"]), row["same"]) == ([17], [], False)


VALUES = [
    "JOHN.doe99@mail7.example.com", "4111 1111 1111 1111", "4225039295678253", "+1 (162) 555-6820", "(212) 555-1234", "+44 20 7946 0958", 'token = "6a4589e4112292221d28c7e47303eee368e0b7fd"',
    "2024-02-29", "31.12.1999", "12/31/1999", "5/3/2024", "3 May 2021", "January 5, 2024", "Jan 5 2024", "123.43.25.46", "GB82 WEST 1234 5698 7654 32", "123-45-6789",
]


def test_a_network_is_a_permutation():
    n = pseudonyms.Feistel(b"k")
    for bound in (1, 2, 3, 10, 97, 1000):
        moved = [n.forward(x, bound, "t") for x in range(bound)]
        assert sorted(moved) == list(range(bound)) and [n.back(x, bound, "t") for x in moved] == list(range(bound))


def test_values_move_within_their_format_and_back():
    n, other = pseudonyms.Feistel(b"k"), pseudonyms.Feistel(b"other")
    shape = lambda t: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in t)
    for v in VALUES:
        text = f"See {v}, and {v} again."
        moved, found = pseudonyms.pseudonymise(text, n.forward)
        assert len(found) == 2 and v not in moved, v
        first, second = moved.removeprefix("See ").removesuffix(" again.").split(", and ")
        assert first == second
        if "." not in v and not v.startswith(("5/3", "3 M", "Jan", "token")):
            assert shape(moved) == shape(text)
        assert pseudonyms.pseudonymise(moved, n.back)[0] == text
        assert pseudonyms.pseudonymise(text, other.forward)[0] != moved


def test_all_days_of_a_form_are_permuted():
    n = pseudonyms.Feistel(b"k")
    for form in ("{m}/{d}/2001", "{d:02}.{m:02}.2001", "2001-{m:02}-{d:02}"):
        days = [form.format(m=m, d=d) for m in range(1, 13) for d in range(1, 29)]
        moved = [pseudonyms.pseudonymise(x, n.forward)[0] for x in days]
        assert len(set(moved)) == len(days) and [pseudonyms.pseudonymise(x, n.back)[0] for x in moved] == days


def test_written_dates_keep_their_width_and_come_back():
    n = pseudonyms.Feistel(b"k")
    for form in ("{d:02} {long} 2020", "{d} {long} 2020", "{short} {d}, 2020", "{short} {d:02}, 2020", "{d}/{m:02}/2020", "{m:02}.{d}.2020", "{m}-{d:02}-1999"):
        days = [form.format(m=m, d=d, long=pseudonyms.MONTHS[m - 1], short=pseudonyms.MONTHS[m - 1][:3]) for m in range(1, 13) for d in range(1, 29)]
        moved = [pseudonyms.pseudonymise(f"born {x}.", n.forward)[0] for x in days]
        assert [pseudonyms.pseudonymise(x, n.back)[0] for x in moved] == [f"born {x}." for x in days], form
        digits = lambda x: [len(g) for g in re.findall("[0-9]+", x)]
        assert all(digits(a) == digits(b) for a, b in zip(days, moved, strict=True))


def test_a_date_is_linked_over_its_forms():
    n = pseudonyms.Feistel(b"k")
    for year, month, day in ((2020, 5, 5), (1987, 11, 30), (2001, 2, 11)):
        name = pseudonyms.MONTHS[month - 1]
        forms = {f"{year}-{month:02}-{day:02}": "%Y-%m-%d", f"{month}/{day}/{year}": "%m/%d/%Y", f"{day:02}.{month:02}.{year}": "%d.%m.%Y", f"{day} {name} {year}": "%d %B %Y", f"{name} {day:02}, {year}": "%B %d, %Y"}
        dates = {datetime.datetime.strptime(pseudonyms.pseudonymise(f, n.forward)[0], how) for f, how in forms.items()}
        assert len(dates) == 1 and dates != {datetime.datetime(year, month, day)}


def test_long_secrets_names_and_addresses_move():
    n = pseudonyms.Feistel(b"k")
    for value, text in (("a1" * 400, 'token = "{}"'), ("Zq9_" * 8, 'secret_' + "x" * 300 + ": '{}'"), ("b" * 200, "{}@example.org")):
        moved, found = pseudonyms.pseudonymise(text.format(value), n.forward)
        assert len(found) == 1 and value not in moved and len(moved) == len(text.format(value))
        assert pseudonyms.pseudonymise(moved, n.back)[0] == text.format(value)
    for plain in ('"' + "a1" * 20 + '"', 'tokens are "' + "a1" * 20 + '"', 'x = "' + "a1" * 20 + '"'):
        assert pseudonyms.pseudonymise(plain, n.forward) == (plain, [])


def test_many_rows_of_two_ids_are_edited_in_linear_work(spark):
    rows = [(k % 2, f"text {k // 4} " * (k % 7 + 1)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = merkle.fingerprint_edits(df)
    first = {d: min(t for e, t in rows if e == d) for d in (0, 1)}
    want = sorted((d, hashlib.sha256((t[: len(t) - len(t) // 3] + first[1 - d][: len(t) // 3]).encode()).hexdigest()) for d, t in rows)
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in out.collect()) == want


def test_what_is_not_valid_stays():
    n = pseudonyms.Feistel(b"k")
    for text in ["4225039295678254", "999.1.1.1", "version 2.0.1", "2024-13-01", "31/31/2020", "000-12-3456", "GB00 WEST 1234 5698 7654 32", "a 12 b", '"6a4589e4112292221d28c7e47303eee368e0b7fd"', "", None]:
        assert pseudonyms.pseudonymise(text, n.forward) == (text, [])


def test_digits_of_other_scripts_stay():
    n = pseudonyms.Feistel(b"k")
    for text in ["\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669\u0660\u0661\u0662\u0663\u0664\u0665\u0666", "\u0663\u0661.\u0661\u0662.\u0661\u0669\u0669\u0669", "+1 \u0662\u0660\u0662-555-0147", "\uff14\uff12.1.1.1", "\u0967\u0968 March 2020"]:
        assert pseudonyms.pseudonymise(text, n.forward) == (text, [])


def test_a_column_of_the_callers_is_kept_under_another_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.org", "own", 2)], "doc_id long, text string, values string, `a.b` int")
    row = pseudonyms.pseudonyms(df, b"key", values="found").first()
    assert row["values"] == "own" and row["a.b"] == 2 and len(row["found"]) == 1


def test_pseudonyms_of_rows(spark, awkward, nothing):
    df = spark.createDataFrame([(k, f"{v} and {v}", "x") for k, v in enumerate(VALUES)], "doc_id long, text string, values string")
    moved = pseudonyms.pseudonyms(df, b"key")
    assert all(len(r["values"]) == 2 for r in moved.collect())
    back = pseudonyms.pseudonyms(moved, b"key", undo=True)
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(r["doc_id"], r["text"]) for r in df.collect()}
    out = pseudonyms.pseudonyms(awkward, b"key")
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, (r["text"] for r in awkward.collect())))
    assert pseudonyms.pseudonyms(nothing, b"key").count() == 0
