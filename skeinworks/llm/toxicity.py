"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents are labelled, so tokens get weak labels: a token of a toxic document counts as toxic
if a feature of it (its word, or a prefix) is much more frequent in toxic documents than in others.
The field learns weights of those features and of the transitions between its two states from the
labelled tokens. Forward-backward marginals of all tokens of a whole text then say which are toxic;
their sum and maximum, through a logistic model, give the document's score.

Features and weights are fitted on a bounded sample of labelled documents; scoring is one pass over
all documents, with no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.runtime import materialize

#: Labelled documents of each class to fit on, at most about; features kept, at most.
SAMPLE = 2_000
MAX_FEATURES = 1_500
#: Prefix lengths that are features besides the word; documents that must have a feature.
PREFIXES = (4, 5, 6, 7)
MIN_DOCUMENTS = 5
#: A feature's score and share of toxic documents from which its tokens are labelled toxic.
MIN_SCORE, MIN_SHARE = 3.5, 0.75
#: Labelled tokens in a training sequence; words kept in a worker's table.
SEGMENT = 256
KEEP = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall((text or "").lower())


def features(token: str) -> list[str]:
    """The word itself, marked by a final ``=``, and its prefixes."""
    return [token + "=", *(token[:k] for k in PREFIXES if len(token) >= k)]


def marginals(scores: np.ndarray, lengths: np.ndarray, start: float, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token of a padded batch, and expected numbers of the four transitions.

    ``scores[d, t]`` is the log weight of the toxic state at token t of sequence d, the other state's
    being 0; ``change[i, j]`` the log weight of state j after i. Messages are scaled at each token.
    """
    n, longest = scores.shape
    weight, step = np.exp(np.clip(scores, -30, 30)), np.exp(change)
    ahead = np.zeros((longest, n, 2))
    now = np.stack([np.ones(n), np.exp(start) * weight[:, 0]], axis=1) if longest else np.ones((n, 2))
    for t in range(longest):
        if t:
            now = now @ step
            now[:, 1] *= weight[:, t]
        now /= now.sum(axis=1, keepdims=True)
        ahead[t] = now
    out, pairs, back = np.zeros((n, longest)), np.zeros((2, 2)), np.ones((n, 2))
    for t in reversed(range(longest)):
        back[t == lengths - 1] = 1.0
        both = ahead[t] * back
        out[:, t] = both[:, 1] / both.sum(axis=1)
        if t:
            later = back * np.stack([np.ones(n), weight[:, t]], axis=1)
            joint = ahead[t - 1][:, :, None] * step[None] * later[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[t < lengths].sum(axis=0)
            back = later @ step.T
            back /= back.sum(axis=1, keepdims=True)
    out[np.arange(longest)[None, :] >= lengths[:, None]] = 0.0
    return out, pairs


def batched(sequences: list[np.ndarray], most: int = 1 << 18) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences of about one length together, padded: their places, scores and lengths."""
    order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
    while order:
        n = max(1, min(len(order), most // max(1, len(sequences[order[-1]]))))
        places, order = order[-n:], order[:-n]
        lengths = np.array([len(sequences[k]) for k in places])
        padded = np.zeros((n, int(lengths.max())))
        for row, k in enumerate(places):
            padded[row, : lengths[row]] = sequences[k]
        yield places, padded, lengths


@dataclass
class SpanModel:
    """Weights of the field and of the document model; picklable, of bounded size."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    start: float = 0.0
    change: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def token_score(self, token: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(token))

    def token_marginals(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of every token; sequences hold token scores."""
        out = [np.zeros(len(s)) for s in sequences]
        for places, padded, lengths in batched(sequences):
            if padded.shape[1]:
                p, _ = marginals(padded, lengths, self.start, self.change)
                for row, k in enumerate(places):
                    out[k] = p[row, : lengths[row]]
        return out

    def document_scores(self, found: list[np.ndarray]) -> np.ndarray:
        x = np.array([summary(p) for p in found]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30)))


def summary(p: np.ndarray) -> list[float]:
    """What a document's score rests on: a constant, the log of its toxic tokens, and the surest one."""
    return [1.0, float(np.log1p(p.sum())), float(p.max(initial=0.0))]


def fit_field(texts: list[list[str]], toxic: list[bool], chosen: dict[str, tuple[float, float]], rounds: int = 80) -> SpanModel:
    """The field's weights by gradient ascent (Adam) on weakly labelled tokens.

    ``chosen``: score and share of each feature. Texts are cut into segments for training only.
    """
    names = {f: k for k, f in enumerate(chosen)}
    strong = {f for f, (score, share) in chosen.items() if score >= MIN_SCORE and share >= MIN_SHARE}
    kinds: dict[tuple[int, ...], int] = {(): 0}
    known: dict[str, tuple[int, bool]] = {}
    codes, marks = [], []
    for words, bad in zip(texts, toxic, strict=True):
        for w in words:
            if w not in known:
                own = features(w)
                known[w] = kinds.setdefault(tuple(names[f] for f in own if f in names), len(kinds)), any(f in strong for f in own)
        for k in range(0, len(words), SEGMENT):
            codes.append(np.array([known[w][0] for w in words[k : k + SEGMENT]]))
            marks.append(np.array([bad and known[w][1] for w in words[k : k + SEGMENT]], float))
    rows = np.array([k for own, k in kinds.items() for _ in own], int)
    cols = np.array([f for own in kinds for f in own], int)
    batches = []
    for places, padded, lengths in batched(codes):
        label = np.zeros_like(padded)
        for row, k in enumerate(places):
            label[row, : lengths[row]] = marks[k]
        inside = np.arange(padded.shape[1])[None, :] < lengths[:, None]
        after = inside[:, 1:]
        pairs = np.array([[((label[:, :-1] == i) & (label[:, 1:] == j) & after).sum() for j in (0, 1)] for i in (0, 1)], float)
        batches.append((padded.astype(int), lengths, label, inside, pairs))
    total = max(1.0, sum(b[1].sum() for b in batches))
    # Parameters: feature weights, bias, start, four transitions.
    x = np.concatenate((np.zeros(len(names)), [-4.0, 0.0], np.zeros(4)))
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        kind_score = np.full(len(kinds), x[len(names)])
        np.add.at(kind_score, rows, x[cols])
        gradient = np.zeros_like(x)
        for code, lengths, label, inside, pairs in batches:
            p, expected = marginals(kind_score[code], lengths, x[-5], x[-4:].reshape(2, 2))
            left = (label - p) * inside
            by_kind = np.bincount(code.ravel(), left.ravel(), len(kinds))
            np.add.at(gradient, cols, by_kind[rows])
            gradient[len(names)] += left.sum()
            gradient[-5] += left[:, 0].sum()
            gradient[-4:] += (pairs - expected).ravel()
        gradient = gradient / total - 1e-6 * x
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        x = x + 0.2 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    weights = {f: float(x[k]) for f, k in names.items()}
    return SpanModel(weights, float(x[len(names)]), float(x[-5]), x[-4:].reshape(2, 2).copy())


def fit_document(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1e-1, 1e-1][: x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ b
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        move = np.linalg.solve(curve, slope)
        b = b + move / max(1.0, np.abs(move).max() / 3)
    return b


def learn(docs: DataFrame, marks: DataFrame, *, sample: int = SAMPLE, max_features: int = MAX_FEATURES) -> SpanModel:
    """A model from ``docs`` (``doc_id``, ``text``) and ``marks`` (``doc_id``, ``toxic``: 0 or 1, no nulls).

    About ``sample`` marks of each class, or all if fewer, chosen by a hash of the id, are fitted on;
    the whole texts of their documents count. They are picked before the texts are read, so the table
    joined to them is of bounded size. Without both classes: a model that scores all by the marks'
    share.
    """
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counts.get(0, 0), counts.get(1, 0)
    if not good or not bad:
        share = (bad + 0.5) / (good + bad + 1)
        return SpanModel(document=np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    rate = {0: min(1.0, sample / good), 1: min(1.0, sample / bad)}
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = marks.where(place < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0])).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(materialize(chosen, "toxic-sample"), "doc_id").select("text", "toxic").toPandas()
    texts, toxic = [tokens(t) for t in rows["text"]], [bool(y) for y in rows["toxic"]]
    seen = (Counter(), Counter())
    for words, y in zip(texts, toxic, strict=True):
        seen[y].update({f for w in set(words) for f in features(w)})
    n = (max(1, len(toxic) - sum(toxic)), max(1, sum(toxic)))
    scored = {}
    for f, a in seen[1].items():
        if a >= MIN_DOCUMENTS:
            c = seen[0][f]
            odds = np.log((a + 0.5) / (n[1] - a + 0.5)) - np.log((c + 0.5) / (n[0] - c + 0.5))
            score = odds / np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5) + 1 / (n[1] - a + 0.5) + 1 / (n[0] - c + 0.5))
            # The share among documents of the sample, in which the classes weigh alike.
            if score > 2.5:
                scored[f] = (float(score), (a / n[1]) / (a / n[1] + c / n[0]))
    best = sorted(scored, key=lambda f: (-scored[f][0], f))[:max_features]
    model = fit_field(texts, toxic, {f: scored[f] for f in best})
    found = model.token_marginals([np.array([model.token_score(w) for w in words]) for words in texts])
    y = np.array(toxic, float)
    weight = np.where(y == 1, 1 / rate[1], 1 / rate[0])
    model.document = fit_document(np.array([summary(p) for p in found]), y, weight * len(y) / weight.sum())
    return model


def score_documents(docs: DataFrame, model: SpanModel, least: float = 0.5) -> DataFrame:
    """``doc_id``, ``score``, ``n_toxic_tokens`` and ``spans`` of every row of ``docs``.

    ``spans``: the code points (start, end) of runs of tokens whose marginal is ``least`` or more.
    Null or empty text: the score of no evidence, no spans. Null doc_id and repeated rows: scored
    like any other, equal texts alike. Ties: a marginal of just ``least`` is in a span. Very long texts: whole. No
    rows: no rows. Other columns of ``docs`` are not read, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}

        def scores(words: list[str]) -> np.ndarray:
            for w in set(words).difference(known):
                known[w] = model.token_score(w)
            return np.fromiter(map(known.__getitem__, words), float, len(words))

        for batch in batches:
            for part in (batch.iloc[k : k + 1000] for k in range(0, len(batch), 1000)):
                if len(known) > KEEP:
                    known.clear()
                # A text without evidence has every token at the same, low marginal.
                sequences = [scores(tokens(t)) for t in part["text"]]
                found = model.token_marginals(sequences)
                spans, numbers = [], []
                for t, p in zip(part["text"], found, strict=True):
                    hit = p >= least
                    numbers.append(int(hit.sum()))
                    spans.append(toxic_spans(t, hit) if hit.any() else [])
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": model.document_scores(found), "n_toxic_tokens": np.array(numbers, np.int64), "spans": spans})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, n_toxic_tokens long, spans array<struct<start:long,end:long>>")


def toxic_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Code points of the runs of tokens that are hit."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    if len(text.lower()) != len(text):  # lower case that is longer: letter by letter
        origin = [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
        places = [(origin[a], origin[b - 1] + 1) for a, b in places]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def held_out(folds: int, fold: int):
    """Whether a document is kept from learning: the remainder of its id's CRC-32 is ``fold``."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds) == fold


def query(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs, kept = read("documents"), held_out(5, 0)
    marks = read("labels").where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic")
    model = learn(docs, marks.where(~kept))
    return score_documents(docs, model).select(
        "doc_id", kept.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_tokens", "spans"
    )
