"""Toxicity by classifier chains over labelled categories."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import frugal

#: Labelled texts that the chain is fitted on (those of the smallest id hashes).
MAX_TRAIN = 10_000
#: Features of a linear model, documents that one must be in, folds, weight decay, steps.
FEATURES, MIN_DOCS, FOLDS, DECAY, STEPS = 1000, 5, 5, 0.05, 300
#: Bytes of a word's start that are features of longer words.
STEMS = (4, 5, 6, 7)

# ASCII other than letters ends a word.
_BREAK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str | None) -> set[bytes]:
    """Distinct words in lower case, the starts of longer ones (marked *), and
    those that several words start with (marked **)."""
    words = set((text or "").lower().encode().translate(_BREAK).split())
    out = set(words)
    for k in STEMS:
        for stem, n in Counter([w[:k] for w in words if len(w) > k]).items():
            out.add(stem + b"*")
            if n > 1:
                out.add(stem + b"**")
    return out


class Rows:
    """Feature numbers of documents, one after another."""

    def __init__(self, docs: list[np.ndarray]):
        self.ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.n = len(docs)

    def __getitem__(self, some: np.ndarray) -> Rows:
        keep, place = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        keep[some], place[some] = True, np.arange(len(some))
        out, own = Rows([]), keep[self.row]
        out.ids, out.row, out.n = self.ids[own], place[self.row[own]], len(some)
        return out


class Linear:
    """Logistic regression on the features that differ most between the
    classes, and on the log odds of earlier categories."""

    def __init__(self, x: Rows, earlier: np.ndarray, y: np.ndarray, n_features: int):
        n1, n0 = y.sum(), (1 - y).sum()
        in1 = np.bincount(x.ids, weights=y[x.row], minlength=n_features)
        every = np.bincount(x.ids, minlength=n_features)
        p = every / max(1, x.n)
        z = np.abs(in1 / max(1, n1) - (every - in1) / max(1, n0)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / max(1, n1) + 1 / max(1, n0)))
        z[every < MIN_DOCS] = 0
        chosen = np.argsort(-z, kind="stable")[:FEATURES]
        self.chosen = np.sort(chosen[z[chosen] > 0])
        self.slot = np.full(n_features, -1)
        self.slot[self.chosen] = np.arange(len(self.chosen))
        self.weights = np.zeros(len(self.chosen) + earlier.shape[1])
        self.bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
        if not n1 or not n0:
            return
        own = self.slot[x.ids] >= 0
        ids, row = self.slot[x.ids[own]], x.row[own]
        # Adam on the mean loss; the weights start at zero.
        theta, m, v = np.append(self.weights, self.bias), 0.0, 0.0
        for step in range(1, STEPS + 1):
            score = np.bincount(row, weights=theta[ids], minlength=x.n) + earlier @ theta[len(self.chosen):-1] + theta[-1]
            error = (1 / (1 + np.exp(-score)) - y) / x.n
            grad = np.concatenate([np.bincount(ids, weights=error[row], minlength=len(self.chosen)), earlier.T @ error, [error.sum()]])
            grad[:-1] += DECAY * theta[:-1] / x.n
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        self.weights, self.bias = theta[:-1], float(theta[-1])

    def score(self, x: Rows, earlier: np.ndarray) -> np.ndarray:
        own = self.slot[x.ids] >= 0
        text = np.bincount(x.row[own], weights=self.weights[self.slot[x.ids[own]]], minlength=x.n)
        return text + earlier @ self.weights[len(self.chosen):] + self.bias


def fit_chain(x: Rows, labels: np.ndarray, n_features: int) -> list[Linear]:
    """A linear model per column of ``labels``. Each learns from the earlier
    categories' log odds as models that haven't seen the row give them
    (out-of-fold), not as fitted ones do, which would be too sure."""
    chain, earlier, fold = [], np.zeros((x.n, 0)), np.arange(x.n) % FOLDS
    for c in range(labels.shape[1]):
        y, held_out = labels[:, c].astype(float), np.zeros(x.n)
        chain.append(Linear(x, earlier, y, n_features))
        if c + 1 < labels.shape[1]:
            for f in range(FOLDS):
                test, train = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                if len(test) and len(train):
                    held_out[test] = Linear(x[train], earlier[train], y[train], n_features).score(x[test], earlier[test])
            earlier = np.column_stack([earlier, held_out])
    return chain


def train(labelled: DataFrame, categories: list[str], max_train: int = MAX_TRAIN) -> list[dict]:
    """The chain as rows (category, bias, earlier weights, feature weights) from
    (id, text, category columns 0/1); rows with a null label are left out.
    ``max_train`` bounds the sample, so one task fits it."""
    known = labelled.where(" and ".join(f"`{c}` is not null" for c in categories))
    some = known.orderBy(F.xxhash64("id"), "id").limit(max_train).select("text", *[F.col(c).cast("int").alias(c) for c in categories])

    @frugal
    def fit(batches):
        numbers: dict[bytes, int] = {}
        docs, labels = [], []
        for b in batches:
            labels.append(np.stack([b.column(c).to_numpy() for c in categories], 1))
            for t in b.column("text").to_pylist():
                docs.append(np.array([numbers.setdefault(w, len(numbers)) for w in sorted(features(t))], np.int64))
        names = list(numbers)
        chain = fit_chain(Rows(docs), np.concatenate(labels) if labels else np.zeros((0, len(categories)), int), len(names))
        for c, model in zip(categories, chain, strict=True):
            n = len(model.chosen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c]), pa.array([model.bias]), pa.array([model.weights[n:].tolist()], pa.list_(pa.float64())),
                 pa.array([[names[i] for i in model.chosen]], pa.list_(pa.binary())), pa.array([model.weights[:n].tolist()], pa.list_(pa.float64()))],
                names=["category", "bias", "earlier", "words", "weights"])

    made = some.coalesce(1).mapInArrow(fit, "category string, bias double, earlier array<double>, words array<binary>, weights array<double>")
    by = {r.category: r.asDict() for r in made.collect()}  # at most FEATURES weights a category
    # Without any labelled row nothing is known, and nothing is flagged.
    return [by.get(c) or {"category": c, "bias": -50.0, "earlier": [0.0] * k, "words": [], "weights": []} for k, c in enumerate(categories)]


def apply_chain(docs: DataFrame, chain: list[dict], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and, per category, <category> (probability >= ``threshold``)
    and <category>_probability of every whole text, one row per input row.

    A null or empty text has no features and gets the base rate; without any
    labelled row nothing is flagged. Null ids and repeated rows stay; other columns are ignored; an empty table gives an
    empty result."""
    names = [m["category"] for m in chain]

    @frugal
    def run(batches):
        models = [(m["bias"], m["earlier"], dict(zip(map(bytes, m["words"]), m["weights"]))) for m in chain]
        known = [frozenset(m[2]) for m in models]
        for b in batches:
            out = np.zeros((b.num_rows, len(models)))
            for i, x in enumerate(b.column("text")):
                found, odds = features(x.as_py()), []
                for (bias, earlier, weights), own in zip(models, known, strict=True):
                    odds.append(bias + sum(w * o for w, o in zip(earlier, odds)) + sum(weights[w] for w in sorted(found & own)))
                out[i] = odds
            p = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            cols = [c for k in range(len(models)) for c in (pa.array(p[:, k] >= threshold), pa.array(p[:, k]))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names=[id_col, *[n for c in names for n in (c, f"{c}_probability")]])

    fields = ", ".join(f"`{c}` boolean, `{c}_probability` double" for c in names)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` long, {fields}")


def document_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, low_quality, toxic and their probabilities for all documents.
    The chain goes from low quality to toxicity; it learns from the labelled
    documents (of an id with several labels, the greatest of each counts)."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("low_quality"), F.max("toxic").alias("toxic"))
    # The bounded sample is drawn from the labels first, so only its texts move.
    known = marks.where("low_quality is not null and toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    labelled = texts.join(F.broadcast(known), texts.id == known.doc_id).select("id", "text", "low_quality", "toxic")
    return apply_chain(docs, train(labelled, ["low_quality", "toxic"], max_train))
