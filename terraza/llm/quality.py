"""Quality by Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge loss.

Three families of n-grams, each an indicator: blank-separated words and pairs of them, hashed; triples of characters after
letters and digits are folded to their class; and pairs of equal neighbouring words, by their share of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import bounded, fold, labelled_sample, written

PER_CLASS = 4000  #: labelled documents of each class that the fit sees at most
MOST = 1 << 24  #: features of all those documents that the fit sees at most
WORD_BITS = 18
_CLASS = np.full(256, 3, np.int64)  # non-ASCII
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _i < 33 else 5
for _k, _i in enumerate(i for i in range(33, 127) if not chr(i).isalnum()):
    _CLASS[_i] = 5 + _k
KINDS = 5 + 32
SHARES = np.array([0, 0.02, 0.05, 0.1, 0.2, 0.4])
TRIPLES = 1 << WORD_BITS
EQUAL = TRIPLES + KINDS**3
FEATURES = EQUAL + len(SHARES) + 1


def features(c: tk.Chunk) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    w = tk.words(c, tk.NON_BLANK, lower=False)
    pairs, good = tk.shingles(w.hash, w.first, 2)
    one, two = (w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), (pairs >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    kind = _CLASS[c.buf]
    triple = (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:] if len(kind) > 2 else np.zeros(0, np.int64)
    out, flag = [], np.zeros(KINDS**3, bool)
    for d in range(len(c)):
        a, b, s, e = w.first[d], w.first[d + 1], c.offs[d], max(c.offs[d], c.offs[d + 1] - 2)
        flag[triple[s:e]] = True
        shapes = np.flatnonzero(flag)
        flag[shapes] = False
        g = good[a:b]
        share = same[a + 1 : b].mean() if b - a > 1 else 0
        out.append(np.concatenate([np.unique(np.concatenate([one[a:b], two[a:b][g]])), TRIPLES + shapes, [EQUAL + np.searchsorted(SHARES, share)]]))
    return out


@dataclass
class Classifier:
    weight: np.ndarray  #: of each feature: the log-count ratio times the hinge weight
    b: float
    slope: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for c in tk.chunks(column):
            for d, f in enumerate(features(c)):
                out[c.row + d] = self.weight[f].sum() / np.sqrt(len(f)) + self.b
        return 1 / (1 + np.exp(-np.clip(self.slope * out, -30, 30)))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, cost: np.ndarray, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """w and b of the L2-regularised, L1-loss linear SVM, one dual variable at a time; y is -1 or 1."""
    rng = np.random.default_rng(seed)
    w, b, alpha = np.zeros(n), 0.0, np.zeros(len(rows))
    norms = np.array([v @ v + 1 for v in values])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            margin = y[i] * (w[rows[i]] @ values[i] + b)
            new = min(max(alpha[i] - (margin - 1) / norms[i], 0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
    return w, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 5, held_out: int = 0) -> Classifier:
    """Fits on a sample that is bounded in documents (see labelled_sample) and in features. One class only, or none, gives a constant score."""

    def featured(batches):
        for batch in batches:
            for c in tk.chunks(batch.column("text")):
                lists = pa.array([f.astype(np.int32) for f in features(c)], pa.list_(pa.int32()))
                yield pa.record_batch([batch.column("doc_id").slice(c.row, len(c)), batch.column("y").slice(c.row, len(c)), lists], ["doc_id", "y", "f"])

    rows = written(labelled_sample(docs, labels, "quality", folds, held_out, per_class).mapInArrow(featured, "doc_id long, y int, f array<int>"), "quality-sample")
    rows = bounded(rows, "f", MOST)
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Classifier(np.zeros(FEATURES), 3.0 if not sizes or sizes.get(1) else -3.0, 1.0)
    counts = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("c1"), F.count("*").alias("c")).toArrow()
    f, c1, c = (counts[k].to_numpy() for k in ("f", "c1", "c"))
    ratio = np.zeros(FEATURES)
    p, q = c1 + 1.0, c - c1 + 1.0
    ratio[f] = np.log(p / (sizes[1] + 2)) - np.log(q / (sizes[0] + 2))
    data = rows.orderBy("doc_id").select("y", "f").toArrow()
    offs, flat = data["f"].combine_chunks().offsets.to_numpy(), data["f"].combine_chunks().values.to_numpy()
    used = [flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
    y = np.where(data["y"].to_numpy() == 1, 1.0, -1.0)
    keep = [u[ratio[u] != 0] for u in used]
    values = [ratio[k] / np.sqrt(len(u)) for k, u in zip(keep, used, strict=True)]
    cost = np.where(y > 0, len(y) / (2 * sizes[1]), len(y) / (2 * sizes[0]))
    w, b = dual_descent(keep, values, y, FEATURES, cost)
    return Classifier(w * ratio, b, 3.0)


def score(classifier: Classifier, text: str = "text") -> Column:
    """The score of a text column, 0 to 1, higher for quality 1; a null text is an empty one."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(classifier.scores(column))

    return scored(F.col(text))


def op2(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, repeated ids included; empty tables give no rows.

    Null and empty texts get the score of a text without words. A text of any length is scored whole. Equal texts have equal
    scores. Extra columns are left out, whatever their names.
    """
    classifier = fit(docs, labels)
    out = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score(classifier).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
