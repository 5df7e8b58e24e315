import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.llm import quality_rules, rule_ensemble, statistics, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    times, covered = collections.Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            covered |= {k, k + 1, k + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def labelled(spark, n=400):
    """Good prose, and bad documents with symbols or in capitals."""
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        text = " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(60, 90)))
        bad = k % 4 == 0
        if bad:
            text = text.replace(" ", "### ") if k % 8 else text.upper()
        rows.append((k, text))
        labels.append((k, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts_match_a_plain_loop(spark, awkward):
    rng = random.Random(3)
    texts = [r["text"] for r in awkward.collect()] + [" ".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(60)]
    texts += ["a\x0bb\x0cc\rd\x85e\xa0f", "x\nx\n \nx", "#a|b <c> $%&*"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in statistics.with_statistics(df).collect():
        got = r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]
        assert got == plain_counts(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_rules_are_learned_and_applied(spark):
    docs, labels = labelled(spark)
    out, rules = quality_rules.apply_quality_rules(docs, labels)
    assert rules and all(r.bad > r.good for r in rules)
    wrong = out.join(labels, "doc_id").where("NOT base_failed AND kept <> (quality = 1)").count()
    assert wrong == 0
    kept = quality_rules.keep_good(docs, labels)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out.where("kept").collect()}


def test_rules_without_labels_or_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1)], "doc_id long, quality int")
    out, rules = quality_rules.apply_quality_rules(awkward, labels)
    assert rules == [] and out.count() == awkward.count()
    assert out.where("kept IS NULL OR base_failed IS NULL").count() == 0
    kept = quality_rules.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and [r["doc_id"] for r in kept.where("doc_id IN (6, 8)").collect()] == [6, 8, 8]
    assert quality_rules.apply_quality_rules(nothing, labels)[0].count() == 0
    assert quality_rules.keep_good(nothing, labels.limit(0)).count() == 0


def test_the_ensemble_separates_held_out_rows(spark):
    docs, labels = labelled(spark)
    held = toxicity.held_out(3, 1)
    out, model = rule_ensemble.score_quality(docs, labels, ~held)
    assert model.rules and "if" in str(model)
    test = out.where(held).join(labels, "doc_id")
    assert test.count() > 50 and test.where("(score >= 0.5) <> (quality = 1)").count() == 0


def test_the_ensemble_without_labels(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    out, model = rule_ensemble.score_quality(awkward, labels)
    assert model.rules == () and out.where("score > 0 AND score < 1").count() == awkward.count()
    assert rule_ensemble.score_quality(nothing, labels)[0].count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    scores, change, start = rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), 0.3
    lengths = np.array([5, 3, 1])
    p, pairs = toxicity.marginals(scores, lengths, start, change)
    expected_pairs = np.zeros((2, 2))
    for d in range(3):
        n, total, by_token, by_pair = lengths[d], 0.0, np.zeros(5), np.zeros((2, 2))
        for code in range(1 << n):
            s = [code >> t & 1 for t in range(n)]
            weight = np.exp(start * s[0] + sum(scores[d, t] * s[t] for t in range(n)) + sum(change[s[t - 1], s[t]] for t in range(1, n)))
            total += weight
            by_token[:n] += weight * np.array(s)
            for t in range(1, n):
                by_pair[s[t - 1], s[t]] += weight
        assert np.allclose(p[d], by_token / total)
        expected_pairs += by_pair / total
    assert np.allclose(pairs, expected_pairs)


def test_toxic_documents_and_spans(spark):
    rng = random.Random(8)
    rows = []
    for k in range(500):
        text = [f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(20, 60))]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["Vileword,", "nastyword", "foulword!"]))
        rows.append((k, " ".join(text), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df, df.where(~toxicity.held_out(5, 0)))
    out = toxicity.score_documents(df, model).join(df, "doc_id").collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in out)
    for r in out[:50]:
        covered = " ".join(r["text"][s["start"] : s["end"]] for s in r["spans"]).lower()
        assert not r["toxic"] or "word" in covered
        assert all(("vileword" in w or "nastyword" in w or "foulword" in w) for w in covered.split())


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    model = toxicity.learn(awkward, awkward.select("doc_id", F.lit(0).alias("toxic")))
    out = toxicity.score_documents(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 < r["score"] < 0.5 and r["spans"] == [] for r in out)
    assert toxicity.score_documents(nothing, model).count() == 0
    assert toxicity.learn(nothing, nothing.select("doc_id", F.lit(0).alias("toxic"))).document_scores([np.zeros(0)])[0] == pytest.approx(0.5)
    # In lower case each of these letters is two characters, the second no letter.
    assert toxicity.toxic_spans("İİ bad", np.array([False, False, True])) == [{"start": 3, "end": 6}]
