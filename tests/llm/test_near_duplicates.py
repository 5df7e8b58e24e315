import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skeinworks.llm import fuzzy_lines, linking, passages, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def least_reached(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    path = [(k, k + 1) for k in range(100, 140)]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + path + [(200, k) for k in range(201, 260)]
    df = spark.createDataFrame([*edges, (None, 5), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in linking.connected_components(df).collect()}
    expected = least_reached(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert got == expected
    assert linking.connected_components(df.limit(0)).count() == 0


def test_blocks_follow_the_number_of_fingerprints():
    assert [linking.tuned_blocks(n, 2, 4) for n in (0, 10**6, 5 * 10**10)] == [4, 4, 6]
    for n in (10**5, 10**8, 10**11):
        b = linking.tuned_blocks(n, 3, 5)
        assert 2 ** (64 * (b - 3) / b) >= 16 * n


def test_cells_lose_no_pair(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(60)] + [(9, 1)], "key long, id long")
    pairs = set()
    for r in linking.bucket_cells(df, ["id"], cell=5).collect():
        ids = [m["id"] for m in r["members"]]
        pairs |= {(a, b) for a in ids for b in ids if a < b}
    assert pairs == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3}


@pytest.mark.parametrize("cell", [3, 512])
def test_verified_links_lose_no_connection(spark, cell):
    rng = random.Random(6)
    place = {k: rng.randrange(300) for k in range(80)}
    entries = [(key, k) for k in place for key in {k % 4, 10 + k % 7}]
    df = spark.createDataFrame(entries, "key long, id long")
    body = lambda ids: ids.select("id", F.struct(F.element_at(F.create_map(*[F.lit(x) for p in place.items() for x in p]), F.col("id")).alias("at")).alias("body"))
    got = linking.verified_links(df, body, lambda a, b: abs(a[0] - b[0]) <= 6, "test", cell).collect()
    together = {(a, b) for x, a in entries for y, b in entries if x == y and a < b}
    expected = [(a, b) for a, b in together if abs(place[a] - place[b]) <= 6]
    assert all((min(r), max(r)) in set(expected) for r in got)
    assert least_reached([tuple(r) for r in got], place) == least_reached(expected, place)


def test_each_pair_of_a_crowded_key_is_compared_once_at_most(spark):
    """Half of the pairs cannot be the same, as ``may_be`` tells; of the others each is compared in one order."""
    df = spark.createDataFrame([(5, k) for k in range(60)] * 2 + [(None, 3), (6, None), (7, 1)], "key long, id long")
    calls = spark.sparkContext.accumulator(0)

    def same(a, b):
        calls.add(1)
        return abs(a[0] - b[0]) == 2

    body = lambda ids: ids.select("id", F.struct(F.col("id").alias("at")).alias("body"))
    may_be = lambda items, x, y: np.array([(items[i][0] - items[j][0]) % 2 == 0 for i, j in zip(x, y, strict=True)], bool)
    for tried, most in ((may_be, 2 * (30 * 29 // 2)), (None, 60 * 59 // 2)):
        before = calls.value
        got = linking.verified_links(df, body, same, "test", 512, may_be=tried).collect()
        assert least_reached([tuple(r) for r in got], range(60)) == {k: k % 2 for k in range(60)}
        assert 58 <= calls.value - before <= most


def test_pairs_of_many_keys_are_compared_between_groups_and_once(spark):
    """Three groups of near copies under twelve keys: stars first, then each pair between groups, not one for each key."""
    rng = random.Random(3)
    bits = {k: (k // 20) ^ (1 << rng.randrange(8, 60)) for k in range(60)}
    df = spark.createDataFrame([(key, k, bits[k]) for key in range(12) for k in bits] * 2, "key long, id long, bits long")
    pairs = spark.sparkContext.accumulator(0)

    def same(a, b):
        pairs.add(1)
        return a[0] // 20 == b[0] // 20

    body = lambda ids: ids.select("id", F.struct(F.col("id").alias("at")).alias("body"))
    for cell in (7, 512):
        before = pairs.value
        got = linking.verified_links(df, body, same, "test", cell, linking.Near(12)).collect()
        assert least_reached([tuple(r) for r in got], range(60)) == {k: k - k % 20 for k in range(60)}
        assert pairs.value - before <= 60 * 59 // 2
    lone = linking.verified_links(df.where("id < 2"), body, same, "test", 512, linking.Near(0)).collect()
    assert lone == []


def test_distances_of_many_pairs_at_once():
    rng = random.Random(1)
    a = ["".join(rng.choice("abcdeé😀 ") for _ in range(rng.randrange(1, rng.choice([5, 70, 300])))) for _ in range(1500)]
    b = []
    for x in a:
        y = list(x)
        for _ in range(rng.randrange(1 + len(x) // 2)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(3)] = rng.choice(["", "x", "ab"])
        b.append("".join(y) or "q")
    whole = np.array([fuzzy_lines.edit_distance(x, y) for x, y in zip(a, b, strict=True)])
    for off in (-9, -1, 0, 4):
        most = np.maximum(whole + off, 0)
        assert (fuzzy_lines.within(a, b, most) == (whole <= most)).all()


def test_sketches_lose_no_similar_pair():
    rng = random.Random(16)
    forms = ["".join(rng.choice("abc déΣ") for _ in range(n)) for n in (1, 3, 9, 60, 400, 3000) for _ in range(8)]
    for x in list(forms):
        y = list(x)
        for _ in range(len(x) // 5):
            y[rng.randrange(len(y))] = rng.choice("xab")
        forms.append("".join(y))
    a, b = (v.ravel() for v in np.indices((len(forms), len(forms))))
    tried = fuzzy_lines.may_be_by_sketch(fuzzy_lines.sketches_of(forms), a, b)
    alike = fuzzy_lines.similar_pairs(forms, a, b)
    assert (alike == [fuzzy_lines.similar(forms[i], forms[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]).all()
    assert not (alike & ~tried).any() and tried.sum() < 0.5 * len(a)


def test_colliding_entries(spark):
    rng = random.Random(4)
    rows = [(rng.choice([-1, 1]) * rng.randrange(1 << 40) if rng.random() < 0.5 else rng.randrange(90), rng.randrange(-40, 40)) for _ in range(3000)]
    ids = {}
    for k, i in rows:
        ids.setdefault(k, set()).add(i)
    expected = sorted((k, i, min(v), len(v) > 2) for k, v in ids.items() for i in v if i != min(v))
    got = linking.colliding(spark.createDataFrame(rows, "key long, id long"))
    assert sorted(tuple(r) for r in got.collect()) == expected


def plain_fingerprint(text):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(found[k : k + 3]) for k in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_slices_match_plain_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.array([int(base[k % 6]) ^ sum(1 << int(b) for b in rng.integers(0, 64, k % 5)) for k in range(90)], np.uint64)
    near = [(a, b) for a in range(90) for b in range(a + 1, 90) if (int(values[a]) ^ int(values[b])).bit_count() <= radius]
    forest = simhash.bit_sliced_forest(values, radius)
    assert set(forest) <= set(near) and len(forest) < 90
    assert least_reached(forest, range(90)) == least_reached(near, range(90))


def test_simhash_matches_brute_force(spark, awkward):
    rng = random.Random(2)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for k in range(100, 160):
        base = [f"v{rng.randrange(900)}" for _ in range(300)]
        for c in range(3):
            copy = list(base)
            copy[rng.randrange(300)] = "Changed"
            rows.append((k * 10 + c, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, cell=4).collect()
    assert len(got) == len(rows)
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(d), f"{f:016x}") for d, f in prints)
    known = [(d, f) for d, f in prints if d is not None]
    edges = [(a, b) for a, x in known for b, y in known if a < b and (x ^ y).bit_count() <= 2]
    expected = least_reached(edges, {d for d, _ in known})
    by_print = {f: expected[d] for d, f in known}
    for r in got:
        of_print = by_print.get(int(r["fingerprint"], 16))
        assert r["component_id"] == (of_print if r["doc_id"] is None else expected[r["doc_id"]])
    left = simhash.one_of_each_group(df)
    assert {r["doc_id"] for r in left.collect()} == {None, *expected.values()} and left.columns == df.columns


def plain_shingles(text):
    found = WORD.findall((text or "").lower())
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def test_wide_groups_match_all_pairs(spark, awkward):
    """Copies with 1 to 12 of 400 words changed, a hot group of copies, and documents with half of their words in common."""
    rng = random.Random(21)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    some = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    for k in range(100, 150):
        base = some(400)
        rows.append((k * 100, " ".join(base)))
        for c in range(1, 40 if k == 100 else 5):
            copy = list(base)
            for at in rng.sample(range(400), rng.randrange(1, 13)):
                copy[at] = some(1)[0]
            rows.append((k * 100 + c, " ".join(copy).upper() if c % 2 else "  ".join(copy)))
        rows.append((k * 100 + 90, " ".join(base[:200] + some(200))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.similar_documents(df, cell=4, wide_cell=3).collect()
    assert len(got) == len(rows)
    known = [(d, plain_shingles(t), plain_fingerprint(t)) for d, t in rows if d is not None]
    alike = lambda x, y: 10 * len(x & y) >= 8 * len(x | y)
    pairs = [(a, b) for k, (a, x, p) in enumerate(known) for b, y, q in known[k + 1 :] if alike(x, y) or (p ^ q).bit_count() <= 2]
    expected = least_reached(pairs, {d for d, *_ in known})
    group = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert all(expected[group[d]] == expected[d] for d in group)
    later = [d for d in group if expected[d] != d]
    assert len(later) > 100 and sum(group[d] == expected[d] for d in later) >= 0.97 * len(later)
    assert all(group[k * 100 + 90] == k * 100 + 90 for k in range(100, 150))
    left = simhash.one_of_each_group(df, wide=True)
    assert {r["doc_id"] for r in left.collect()} == {None, *group.values()} and left.columns == df.columns


def test_simhash_of_nothing(nothing):
    assert simhash.similar_documents(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each_group(nothing).columns == nothing.columns


def test_edit_distance():
    rng = random.Random(0)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for k, x in enumerate(a, 1):
            new = [k]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(800):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in "xy")
        whole = plain(a, b)
        assert fuzzy_lines.edit_distance(a, b) == whole
        assert all((fuzzy_lines.edit_distance(a, b, most) <= most) == (whole <= most) for most in range(9))
        assert not fuzzy_lines.too_unlike(a, b, whole)
        x, y = a.replace("c", " "), b.replace("c", " ")
        assert fuzzy_lines.distance_at_most(x.split(" "), y.split(" ")) >= plain(x, y)


def test_no_similar_pair_is_left_untried():
    rng = random.Random(15)
    forms = ["".join(rng.choice("abc déΣ😀") for _ in range(n)) for n in (0, 1, 2, 3, 5, 9, 20, 60, 300) for _ in range(6)]
    for x in list(forms):
        for _ in range(4):
            y = list(x)
            for _ in range(rng.randrange(1 + len(x) // 4)):
                at = rng.randrange(len(y) + 1)
                y[at : at + rng.randrange(2)] = rng.choice(["", "x", "a", "b"])
            forms.append("".join(y))
    bodies = [(x, 0, False) for x in forms]
    a, b = (v.ravel() for v in np.indices((len(forms), len(forms))))
    tried = fuzzy_lines.may_be_similar(bodies, a, b)
    alike = np.array([fuzzy_lines.similar(forms[i], forms[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    assert not (alike & ~tried).any() and tried.sum() < 0.5 * len(a) and alike.sum() > 400
    far = [("some words of one line", 0, True), ("some words of one line", -1, True), ("some words of one line", -1, False)]
    assert fuzzy_lines.may_be_similar(far, np.array([0, 0, 1]), np.array([1, 2, 2])).tolist() == [False, True, True]
    assert fuzzy_lines.may_be_similar([], np.zeros(0, int), np.zeros(0, int)).tolist() == []


SYLLABLES = [a + b for a in "bdfgklmnprst" for b in "aeiou"]


def letter_words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def test_lines_match_brute_force(spark):
    rng = random.Random(7)
    base = [letter_words(rng, rng.choice([3, 6, 9, 15, 30, 60])) for _ in range(60)]
    docs = []
    for d in range(80):
        lines = []
        for _ in range(4):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = letter_words(rng, 1)[0]
            text = " ".join(line)
            if rng.random() < 0.3:
                at = rng.randrange(len(text))
                text = text[:at] + "x" + text[at:]
            lines.append(text.title().replace(" ", "  ", 1) if rng.random() < 0.3 else text)
        docs.append((d // 2 if d < 20 else d, "\n".join([*lines, "end"])))
    # A row without id, and rows of one id that share a line and have lines of their own.
    docs += [(None, "\n".join(" ".join(b) for b in base[:3])), (200, " ".join(base[7]) + "\nan own line of this row"), (200, "two other lines of that\nhere is quite another one")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = {(r["doc_id"], r["text"]): r["row"] for r in df.select("*", fuzzy_lines.row_key().alias("row")).collect()}
    got = {(r["doc_id"], r["row"], k) for r in fuzzy_lines.repeated_lines(df, cell=4).collect() for k in r["removed"]}
    lines = [(d, key[d, t], k, x) for d, t in docs for k, x in enumerate(fuzzy_lines.normal_lines(t)) if len(x.split()) >= 3]
    forms = sorted({x for *_, x in lines})
    pairs = [(a, b) for k, a in enumerate(forms) for b in forms[k + 1 :] if fuzzy_lines.similar(a, b)]
    assert 250 < len(pairs) < len(forms) ** 2 / 20
    group = least_reached(pairs, forms)
    keeper = {}
    for d, r, k, x in sorted(lines, key=lambda p: (p[0] is not None, p[0] or 0, *p[1:3])):
        keeper.setdefault(group[x], (d, r, k))
    expected = {(d, r, k) for d, r, k, x in lines if keeper[group[x]] != (d, r, k) and d is not None}
    assert got <= expected and len(got) >= 0.99 * len(expected)
    left = sorted((str(r["doc_id"]), r["text"]) for r in fuzzy_lines.dedup_lines(df).collect())
    rest = [(d, t, [x for k, x in enumerate(t.split("\n")) if (d, key[d, t], k) not in got]) for d, t in docs]
    assert left == sorted((str(d), "\n".join(own)) for d, _, own in rest if any(x.strip() for x in own))
    assert {(200, key[docs[-2]], 1), (200, key[docs[-1]], 0), (200, key[docs[-1]], 1)}.isdisjoint(got)


def test_similar_lines_of_all_lengths_are_linked(spark):
    rng = random.Random(12)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    some = lambda n: ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    lines = []
    for n in [k for k in (3, 4, 5, 8, 12, 20, 35, 50) for _ in range(25)]:
        base = some(n)
        one, several = list(base), list(base)
        one[rng.randrange(n)] = some(1)[0]
        for k in rng.sample(range(n), max(1, n // 6)):
            several[k] = some(1)[0]
        typed = list(" ".join(base))
        for k in rng.sample(range(len(typed)), max(1, len(typed) // 25)):
            typed[k] = rng.choice("aeiou")
        lines += [" ".join(base), " ".join(one), " ".join(several), "".join(typed)]
    forms = sorted({x for t in lines for x in fuzzy_lines.normal_lines(t) if len(x.split()) >= 3})
    pairs = [(a, b) for a in forms for b in forms if a < b and fuzzy_lines.similar(a, b)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = fuzzy_lines.all_lines(df, 3)
    edges = [tuple(r) for r in fuzzy_lines.similar_line_edges(df, found, fuzzy_lines.distinct_forms(found)).collect()]
    name = {x: fuzzy_lines.line_hash(x) - (fuzzy_lines.line_hash(x) >> 63 << 64) for x in forms}
    group = least_reached(edges, name.values())
    together = [group[name[a]] == group[name[b]] for a, b in pairs]
    apart = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    few = [t for (a, b), t in zip(pairs, together, strict=True) if len(a.split()) <= fuzzy_lines.FEW and apart(a.split(), b.split())]
    assert len(pairs) > 300 and len(few) > 100 and all(few)
    assert sum(together) >= 0.97 * len(pairs)


def test_keys_of_lines_do_not_depend_on_their_number(spark, monkeypatch):
    df = spark.createDataFrame([(1, "some words of one line")], "doc_id long, text string")
    lines = fuzzy_lines.all_lines(df, 3)
    forms = fuzzy_lines.distinct_forms(lines)
    count, keys = type(forms).count, []
    monkeypatch.setattr(fuzzy_lines, "verified_links", lambda entries, *_: keys.append({r["key"] for r in entries.collect()}))
    for n in (1, 10**7, 10**9):
        monkeypatch.setattr(type(forms), "count", lambda _, n=n: n)
        fuzzy_lines.similar_line_edges(df, lines, forms)
    monkeypatch.setattr(type(forms), "count", count)
    assert keys[0] == keys[1] == keys[2]


def test_lines_of_rows_without_id_are_compared(spark):
    line = "these are the several words of one rather long line"
    rows = [(None, line), (None, "a line that only rows without an id do hold"), (3, line), (4, line + "s"), (5, "a line that only rows without an id did hold"), (6, "nothing like the others")]
    left = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted((str(d), t) for d, t in [*rows[:2], rows[5]])


def test_awkward_lines(awkward, nothing):
    left = fuzzy_lines.dedup_lines(awkward)
    assert left.columns == awkward.columns
    texts = {(r["doc_id"], r["text"]) for r in left.collect()}
    assert {(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (None, None)} <= texts
    assert fuzzy_lines.dedup_lines(nothing).count() == 0


def planted(rng):
    vocabulary = [f"t{k}" for k in range(3000)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, groups = [], []
    for _ in range(40):
        passage, ids = some(rng.randrange(51, 80)), []
        for _ in range(3):
            ids.append(len(docs))
            glue = [rng.choice(" \n") for _ in "ab"]
            docs.append(some(rng.randrange(5, 120)) + glue[0] + passage + glue[1] + some(rng.randrange(5, 120)))
        groups.append(ids)
    clean = range(len(docs), len(docs) + 80)
    docs += [some(rng.randrange(1, 300)) for _ in clean]
    return docs, groups, clean


def test_planted_passages_are_cut_and_clean_documents_left_alone(spark):
    docs, groups, clean = planted(random.Random(4))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in passages.repeated_passages(df).collect()}
    assert all(set(found[i]["keepers"]) <= set(ids[:2]) for ids in groups for i in ids[1:] if i in found)
    assert sum(i in found for ids in groups for i in ids[1:]) >= 78
    assert not any(i in found for i in [*clean, *(ids[0] for ids in groups)])
    cut = {r["doc_id"]: r["text"] for r in passages.dedup_passages(df).collect()}
    for d, t in enumerate(docs):
        spans, own = found[d]["spans"] if d in found else [], t.split()
        gone = {k for s in spans for k in range(s["start"], s["end"])}
        assert cut[d].split() == [w for k, w in enumerate(own) if k not in gone]


def test_similar_paragraphs_meet(spark):
    rng = random.Random(9)
    docs = []
    for k in range(30):
        own = [f"q{rng.randrange(9000)}" for _ in range(100)]
        docs.append((2 * k, " ".join(own)))
        own[rng.randrange(100)] = "other"
        docs.append((2 * k + 1, " ".join(own)))
    found = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), cell=3).collect()}
    assert sorted(found) == [2 * k + 1 for k in range(30)]
    assert all([tuple(s) for s in r["spans"]] == [(0, 100)] for r in found.values())


def test_whole_passages_inside_other_text_are_cut(spark):
    rng = random.Random(8)
    some = lambda n, tag: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    docs, expected = [], {}
    for k, n in enumerate([20, 21, 25, 30, 35, 51, 60, 80, 100] * 4):
        passage = some(n, "p")
        before = rng.randrange(3, 60)
        docs.append((2 * k, " ".join([*some(30, "a"), *passage, *some(30, "b")])))
        docs.append((2 * k + 1, " ".join([*some(before, "c"), *passage, *some(rng.randrange(3, 60), "d")])))
        expected[2 * k + 1] = [(before, before + n)]
    periodic = ["one", "two", "three"] * 20
    docs += [(900, " ".join([*some(9, "a"), *periodic, *some(9, "b")])), (901, " ".join([*some(4, "c"), *periodic, *some(5, "d")]))]
    # In 900 the windows that overlap none of their first occurrences go too.
    expected |= {900: [(30, 69)], 901: [(4, 64)]}
    docs.append((902, " ".join(some(19, "e"))))
    docs.append((903, docs[-1][1] + " and more " + " ".join(some(9, "f"))))
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == expected


def test_runs_of_short_lines_are_paragraphs(spark):
    assert passages.paragraphs([5, 15, 0, 19, 20, 7, 7, 7]) == [(0, 20), (39, 20), (59, 21)]
    rng = random.Random(3)
    lines = [" ".join(f"s{rng.randrange(9000)}" for _ in range(10)) for _ in range(8)]
    other = [x if k % 2 else x.replace(x.split()[4], "other") for k, x in enumerate(lines)]
    docs = [(1, "\n".join(lines)), (2, "\n".join([*lines[:4], lines[4].replace(lines[4].split()[5], "other"), *lines[5:]])), (3, "\n".join(other[:3]))]
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {2: [(0, 80)]}


def test_bands_are_tuned():
    b = passages.tune_bands()
    assert 1 - (1 - passages.SIMILARITY**passages.ROWS) ** b >= passages.RECALL > 1 - (1 - passages.SIMILARITY**passages.ROWS) ** (b - 1)


def test_awkward_passages(awkward, nothing):
    left = passages.dedup_passages(awkward)
    assert left.columns == awkward.columns and left.count() == awkward.count()
    assert {r["text"] for r in left.where("doc_id IN (1, 2, 4)").collect()} == {None, "", "one"}
    assert passages.dedup_passages(nothing).count() == 0


def test_one_of_a_group_stays_whatever_columns_are_called(spark):
    from skeinworks.llm import simhash

    rows = [(1, "same text here", 1, 2), (2, "same text here", 3, 4), (3, "quite another text of words", 5, 6), (None, "same text here", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone_id int, gone_id int")
    for names in (["doc_id", "text", "_gone_id", "gone_id"], ["doc_id", "text", "a.b", "boxed"]):
        out = simhash.one_of_each_group(df.toDF(*names))
        assert out.columns == names and sorted(r[2] for r in out.collect()) == [1, 5, 7]
