"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their first four and five bytes, ASCII-lowered, each a 64-bit hash; a term counts once.
The machine's score is ``b + sum w_i + sum_{i<j} <v_i, v_j>`` over all terms of the fit, hashed to 20 bits, so a pair of terms,
an insult and a group's name, say, can weigh more than both alone. No term is left out: one that its own counts don't tell
from noise has its single weight shrunk, a rare one its vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import bounded, fold, labelled_sample, release, written

PER_CLASS = 4000  #: labelled documents of each class that the fit sees at most
MOST = 1 << 24  #: terms of all those documents that the fit sees at most
BITS = 20  #: of a hashed term
HALF_Z = 4.0  #: signed root of a term's likelihood ratio at which its single weight is halved
HALF_ROWS = 50  #: rows of a term at which its vector is halved
RANK = 8
BATCH = 64
PREFIXES = (4, 5)


def doc_terms(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of a chunk and the text of each."""
    w = tk.words(c, tk.ALNUM)
    doc, parts, docs = w.doc, [w.hash], [w.doc]
    for k in PREFIXES:
        long = w.end - w.start > k
        parts.append(w.part(w.start[long], w.start[long] + k) ^ np.uint64(0xA5A5 * k))
        docs.append(doc[long])
    return np.concatenate(parts), np.concatenate(docs)


def hashed(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Machine:
    terms: np.ndarray  #: hashed terms, sorted
    b: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[self.terms] = np.arange(len(self.terms))

    def known(self, hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, term) pairs, ordered by text."""
        term = self.place[hashed(hashes)]
        pairs = np.unique(docs[term >= 0].astype(np.int64) << BITS | term[term >= 0])
        return pairs >> BITS, pairs & ((1 << BITS) - 1)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for c in tk.chunks(column):
            doc, term = self.known(*doc_terms(c))
            n = len(c)
            linear = np.bincount(doc, self.w[term], n)
            pair = np.zeros(n)
            for f in range(self.v.shape[1]):
                x = self.v[term, f]
                pair += np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n)
            out[c.row : c.row + n] = 1 / (1 + np.exp(-np.clip(self.b + linear + pair / 2, -30, 30)))
        return out


def shrinkage(term: np.ndarray, y: np.ndarray, n_terms: int, n0: float, n1: float) -> tuple[np.ndarray, np.ndarray]:
    """Factors of each term's weight and of its vector, above 0, from (term, class) entries of n0 and n1 rows."""
    c = np.bincount(term, minlength=n_terms).astype(float)
    c1 = np.bincount(term, y, n_terms)
    c0, n = c - c1, n0 + n1
    tiny = 1e-9
    ratio = c1 * np.log(np.maximum(c1, tiny) * n / np.maximum(c * n1, tiny)) + c0 * np.log(np.maximum(c0, tiny) * n / np.maximum(c * n0, tiny))
    z = np.sqrt(2 * np.maximum(0, ratio)) / HALF_Z
    common = np.minimum(1, np.log((n + 1) / (c + 0.5)))  # terms of all rows pair with everything
    return (z**6 / (z**6 + 1) + 0.01).astype(np.float32), (0.4 * c / (c + HALF_ROWS) * common).astype(np.float32)


def fit_machine(rows: list[np.ndarray], y: np.ndarray, n_terms: int, rank: int = RANK, epochs: int = 12, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """b, w and v by Adam on the logistic loss, over rows of distinct term numbers; both classes weigh the same.

    The rate falls to nothing, so that the result doesn't hang on the rows that happen to come last.
    """
    rng = np.random.default_rng(seed)
    n1 = float((y == 1).sum())
    n0 = len(y) - n1
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    offs, flat = np.concatenate([[0], np.cumsum(size)]), np.concatenate(rows) if n_terms else np.zeros(0, np.int64)
    alone, paired = shrinkage(flat, np.repeat(y, size), n_terms, n0, n1)
    b, u, p = np.zeros(1, np.float32), np.zeros(n_terms, np.float32), np.asfortranarray(rng.normal(0, 0.01, (n_terms, rank)).astype(np.float32))
    weigh = np.where(y == 1, len(y) / max(1, 2 * n1), len(y) / max(1, 2 * n0))
    params = [b, u, *(p[:, f] for f in range(rank))]  # a factor's column at a time, so that gradients are vectors
    moments, step = [(np.zeros_like(x), np.zeros_like(x)) for x in params], 0
    steps = epochs * -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            term = np.concatenate([flat[offs[k] : offs[k + 1]] for k in batch])
            row = np.repeat(np.arange(len(batch)), size[batch])
            v = p[term] * paired[term, None]
            xv = np.stack([np.bincount(row, v[:, f], len(batch)) for f in range(rank)], 1)
            z = b + np.bincount(row, alone[term] * u[term], len(batch)) + ((xv**2).sum(1) - np.bincount(row, (v * v).sum(1), len(batch))) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weigh[batch] / len(batch)
            own = g[row]
            each = (own * paired[term])[:, None] * (xv[row] - v)
            step += 1
            for k, (x, (m, s)) in enumerate(zip(params, moments, strict=True)):
                if k == 0:
                    d = g.sum(keepdims=True)
                elif k == 1:
                    d = np.bincount(term, own, n_terms) * alone + 1e-4 * u
                else:
                    d = np.bincount(term, each[:, k - 2], n_terms) + 3e-3 * x
                d = d.astype(np.float32)
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                x -= 0.02 * (1 - (step - 1) / steps) / (1 - 0.9**step) * m / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return float(b[0]), u * alone, p * paired[:, None]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 3, held_out: int = 1) -> Machine:
    """Fits on a sample that is bounded in documents (see labelled_sample) and in terms. No labelled row at all, or one class only, gives a constant score."""
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, per_class)

    def featured(batches):
        for batch in batches:
            ids, ys = batch.column("doc_id"), batch.column("y")
            for c in tk.chunks(batch.column("text")):
                hashes, doc = doc_terms(c)
                pairs = np.unique(doc.astype(np.int64) << BITS | hashed(hashes))
                offs = np.searchsorted(pairs >> BITS, np.arange(len(c) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.record_batch([ids.slice(c.row, len(c)), ys.slice(c.row, len(c)), lists], ["doc_id", "y", "terms"])

    rows = written(sample.mapInArrow(featured, "doc_id long, y int, terms array<int>"), "toxicity-sample")
    got = bounded(rows, "terms", MOST).toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(float)
    if not (y == 0).any() or not (y == 1).any():
        return Machine(np.zeros(0, np.int64), 3.0 if len(y) and y[0] == 1 else -3.0, np.zeros(0), np.zeros((0, RANK)))
    lists = got["terms"].combine_chunks()
    terms, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    rows = np.split(flat, np.cumsum(lists.value_lengths().to_numpy())[:-1])
    del got, lists
    release()
    batches = -(-len(rows) // BATCH)
    return Machine(terms, *fit_machine(rows, y, len(terms), epochs=min(60, max(6, -(-350 // batches)))))


def score(machine: Machine, text: str = "text") -> Column:
    """The score of a text column, 0 to 1; a null text is an empty one."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(machine.scores(column))

    return scored(F.col(text))


def op10(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, repeated ids included.

    Null and empty texts get the score of no known term. A text of any length is scored whole. Equal texts have equal scores.
    Extra columns are left out. Empty tables give an empty result or a constant score.
    """
    machine = fit(docs, labels)
    out = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score(machine).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
