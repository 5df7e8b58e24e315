import random
import re

import corpus_pipeline
import pytest
from skeinworks.llm import fuzzy_lines, mixing, packing, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_the_pipeline_matches_plain_loops_stage_by_stage(spark, tmp_path):
    rng = random.Random(2)
    shared, docs, labels = prose(rng, 30), [], []
    for k in range(120):
        lines = [prose(rng, rng.randrange(20, 60)) for _ in range(4)]
        if k % 10 == 0:
            lines.append(shared if k % 20 else shared.replace(shared.split()[5], "other"))
        docs.append((k, "\n".join(lines) if k % 7 else "short text", "en", f"src{k % 3}", 0))
        labels.append((k, int(k % 7 != 0), 0))
    docs.append((500, docs[1][1].upper(), "en", "src1", 0))
    # A copy with two words changed and other line ends, which line dedup leaves.
    again = docs[2][1].split()
    again[20], again[-30] = "changed", "words"
    docs.append((501, "\n".join(" ".join(again[k : k + 9]) for k in range(0, len(again), 9)), "en", "src2", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    steps, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = sorted(now.collect(), key=str)
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert list(steps) == ["quality rules", "line dedup", "SimHash near-dedup", "source mixing", "packing"]

    good = {r["doc_id"]: r["text"] for r in steps["quality rules"]}
    assert set(good) == {d for d, t, *_ in docs if len(WORD.findall(t)) >= 50}

    kept, seen = {}, []
    for d in sorted(good):
        own = []
        for raw, line in zip(good[d].split("\n"), fuzzy_lines.normal_lines(good[d]), strict=True):
            if not any(fuzzy_lines.similar(line, x) for x in seen):
                own.append(raw)
            seen.append(line)
        if own:
            kept[d] = "\n".join(own)
    assert {r["doc_id"]: r["text"] for r in steps["line dedup"]} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in steps["line dedup"]) and 500 not in kept

    prints = {d: simhash.fingerprint(t) for d, t in kept.items()}
    found = {d: WORD.findall(t.lower()) for d, t in kept.items()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, w in found.items()}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    alone = [d for d in sorted(kept) if not any(near(d, e) for e in kept if e < d)]
    assert 501 in kept and 501 not in alone
    assert [r["doc_id"] for r in sorted(steps["SimHash near-dedup"], key=lambda r: r["doc_id"])] == alone

    left = spark.read.parquet(f"{tmp_path}/SimHash near-dedup")
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(left).collect()}
    mixed = [r["doc_id"] for r in steps["source mixing"]]
    assert {d: mixed.count(d) for d in taken} == taken and 0 < len(mixed)

    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(str(public_tokenizers.path(packing.TOKENIZER)))
    tokens = sum(len(plain.encode(kept[d], add_special_tokens=False).ids) + 1 for d in mixed)
    assert sum(r["length"] for r in steps["packing"]) == tokens
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r["length"] for r in whole.collect()) == tokens


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row int, boxed string, _gone_id int, copies int"


@pytest.mark.parametrize("labelled", [True, False])
def test_awkward_rows_go_through_every_stage(spark, tmp_path, labelled):
    """Nulls in every column, empty and very long texts, repeated rows, and names that the operators use."""
    rng = random.Random(7)
    long = "\n".join(prose(rng, 40) for _ in range(200))
    good = [prose(rng, 80) for _ in range(6)]
    texts = [(0, None), (1, ""), (2, " \n\t"), (3, good[0]), (3, good[0]), (4, good[1]), (None, good[2]), (None, None), (5, long), (6, good[3]), (6, good[4])]
    rows = [(d, t, None if k % 2 else "en", None if k % 3 == 0 else "a", None, 1, "x", None, 9) for k, (d, t) in enumerate(texts)]
    rows.append((None,) * 9)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(3, 1, 0), (3, None, 0), (None, 0, None), (4, 1, 1), (99, 0, 0)] if labelled else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, left = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str) if name != "packing" else now.collect()
        assert name == "packing" or now.columns == names
    want = sorted(((d, t) for d, t in texts if t and len(WORD.findall(t)) >= 50), key=str)
    assert left["quality rules"] == left["line dedup"] == left["SimHash near-dedup"] == want
    assert {t for _, t in left["source mixing"]} <= {t for _, t in want}
    ends = [r for r in left["packing"] if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == len(left["source mixing"]) > 0


def test_a_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
