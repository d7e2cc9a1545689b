"""Language by a byte convolutional network: filters of several widths, max pooling over a window, softmax.

Bytes are one-hot, so a filter of width k is k tables of 256 weights and applying it is a sum of look-ups. A text is cut into
windows of fixed length (the last may be short) that between them cover it whole; its class has the largest mean of the
windows' logits, weighed by their lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import fold, release, written

PER_LANGUAGE = 1500  #: documents of each language that the fit sees at most
WINDOWS = 2  #: windows of each of those, spread over the text
LENGTH = 256  #: bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 16
MOST_LANGUAGES = 256  #: values of lang that are learned, the commonest; others are never predicted
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass
class Network:
    names: list[str]
    tables: list[np.ndarray]  #: of each width k: (k, 256, FILTERS)
    bias: np.ndarray  #: (filters of all widths)
    out: np.ndarray  #: (filters of all widths, languages)
    base: np.ndarray

    def __post_init__(self):
        two, three, four = self.tables
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        self.head = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 1).astype(np.float32) + self.bias.astype(np.float32)
        self.third, self.rest = three[2].astype(np.float32), pair(four[2], four[3]).astype(np.float32)

    def pooled(self, c: tk.Chunk, starts: np.ndarray) -> np.ndarray:
        """The largest activation, at least 0, of each filter in each window; windows begin at starts and end at the next."""
        n, f = len(c.buf), FILTERS
        x = np.zeros(n + 4, np.int64)
        x[:n] = c.buf
        left = np.repeat(c.offs[1:], np.diff(c.offs)) - np.arange(n)  # bytes to the end of the text
        out = np.empty((len(starts), 3 * f), np.float32)
        step = 256
        for i in range(0, len(starts), step):
            s = starts[i : i + step]
            a, b = int(s[0]), int(starts[i + step]) if i + step < len(starts) else n
            first = x[a:b] * 256 + x[a + 1 : b + 1]
            act = self.head[first]
            act[:, f : 2 * f] += self.third[x[a + 2 : b + 2]]
            act[:, 2 * f :] += self.rest[x[a + 2 : b + 2] * 256 + x[a + 3 : b + 3]]
            for k, w in enumerate(WIDTHS):
                short = np.flatnonzero(left[a:b] < w)
                act[short, k * f : (k + 1) * f] = 0
            out[i : i + step] = np.maximum.reduceat(act, s - a, axis=0)
        return np.maximum(out, 0)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of the language, or -1, and its probability."""
        best, prob = np.full(len(column), -1), np.zeros(len(column))
        for c in tk.chunks(column):
            size = np.diff(c.offs)
            full = np.flatnonzero(size)
            if not len(full) or not self.names:
                continue
            count = -(-size[full] // LENGTH)
            doc = np.repeat(np.arange(len(full)), count)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            starts = c.offs[full][doc] + nth * LENGTH
            logits = self.pooled(c, starts) @ self.out + self.base
            weight = np.minimum(LENGTH, c.offs[full + 1][doc] - starts)
            mean = np.stack([np.bincount(doc, logits[:, k] * weight, len(full)) for k in range(logits.shape[1])], 1) / size[full][:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            letters = np.add.reduceat(_LETTER[c.buf].astype(np.int64), c.offs[full]) > 0
            for k in np.flatnonzero(~letters):
                letters[k] = any(ch.isalpha() for ch in c.text(full[k]))
            at = c.row + full[letters]
            best[at], prob[at] = p.argmax(1)[letters], p.max(1)[letters]
        return best, prob


def train(windows: np.ndarray, sizes: np.ndarray, y: np.ndarray, names: list[str], epochs: int = 6, seed: int = 3) -> Network:
    """windows: (n, LENGTH) bytes of which the first sizes count; Adam on the mean log loss. Gradients reach a filter at its largest place alone."""
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.1, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
    m = len(WIDTHS) * FILTERS
    bias, out, base = np.zeros(m, np.float32), rng.normal(0, 0.1, (m, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    params = [*tables, bias, out, base]
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            x = windows[order[at : at + 128]].astype(np.int64)
            t, n, size = y[order[at : at + 128]], len(x), sizes[order[at : at + 128]]
            peak, pool = [], np.empty((n, m), np.float32)
            for k, (w, table) in enumerate(zip(WIDTHS, tables, strict=True)):
                act = sum(table[j][x[:, j : LENGTH - w + 1 + j]] for j in range(w)) + bias[k * FILTERS : (k + 1) * FILTERS]
                act[np.arange(LENGTH - w + 1)[None] > size[:, None] - w] = -np.inf
                peak.append(act.argmax(1))
                pool[:, k * FILTERS : (k + 1) * FILTERS] = np.take_along_axis(act, peak[-1][:, None], 1)[:, 0]
            live = np.maximum(pool, 0)
            z = live @ out + base
            g = np.exp(z - z.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(n), t] -= 1
            g /= n
            gp = (g @ out.T) * (pool > 0)
            grads = []
            for k, (w, table) in enumerate(zip(WIDTHS, tables, strict=True)):
                d = np.zeros_like(table)
                own, col = gp[:, k * FILTERS : (k + 1) * FILTERS], np.arange(FILTERS)[None].repeat(n, 0)
                for j in range(w):
                    np.add.at(d[j], (np.take_along_axis(x, peak[k] + j, 1), col), own)
                grads.append(d)
            grads += [gp.sum(0), live.T @ g, g.sum(0)]
            step += 1
            for p, (a, s), d in zip(params, moments, grads, strict=True):
                a += 0.1 * (d - a)
                s += 0.001 * (d * d - s)
                p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(names, tables, bias, out, base)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = 4, held_out: int = 2) -> Network:
    """Fits on at most per_language documents of each value of lang outside the held-out fold, in the order of a hash of the id.

    Of each document WINDOWS windows are learned, spread over the text. Without such a row nothing is learned and every prediction
    is und. Of rows with one id the least window counts.
    """
    own = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    names = sorted(counts)
    if not names:
        return Network([], [np.zeros((k, 256, FILTERS), np.float32) for k in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros((len(WIDTHS) * FILTERS, 0)), np.zeros(0))
    # A draw by hash that leaves at least per_language ids of each language, barring a chance of nil, keeps the ranking small.
    table = docs.sparkSession.createDataFrame([(n, k, min(1 << 40, int((1 << 40) * (2 * per_language + 100) / counts[n]))) for k, n in enumerate(names)], "lang string, y int, below long")
    drawn = own.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(table), "lang").where(F.shiftrightunsigned("h", 24) < F.col("below"))
    rank = F.row_number().over(W.partitionBy("y").orderBy(F.shiftrightunsigned("h", 24), "doc_id"))
    ids = drawn.select("doc_id", "y", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "y")

    def cut(batches):
        for batch in batches:
            ids, ys, rows = batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), []
            for c in tk.chunks(batch.column("text")):
                for d in range(len(c)):
                    a, b = int(c.offs[d]), int(c.offs[d + 1])
                    for k in range(WINDOWS if b > a else 0):
                        s = a + max(0, b - a - LENGTH) * k // max(1, WINDOWS - 1)
                        rows.append((ids[c.row + d], k, ys[c.row + d], c.buf[s : min(b, s + LENGTH)].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "k", "y", "window"])

    rows = own.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(cut, "doc_id long, k int, y int, window binary")
    rows = written(rows.groupBy("doc_id", "k").agg(F.min(F.struct("y", "window")).alias("z")).select("doc_id", "k", "z.y", "z.window"), "language-sample")
    got = rows.orderBy("doc_id", "k").toArrow()
    raw, y = got["window"].to_pylist(), got["y"].to_numpy().copy()
    del got
    release()
    windows = np.frombuffer(b"".join(x.ljust(LENGTH, b"\0") for x in raw), np.uint8).reshape(-1, LENGTH)
    return train(windows, np.array([len(x) for x in raw], np.int64), y, names)


def predict(network: Network, text: str = "text") -> Column:
    """Struct of lang_pred and score for a text column: und and 0 for a null text or one without letters."""
    names = pa.array([*network.names, "und"])

    @F.arrow_udf("lang_pred string, score double")
    def predicted(column: pa.Array) -> pa.Array:
        best, prob = network.predict(column)
        return pa.StructArray.from_arrays([names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(prob)], ["lang_pred", "score"])

    return predicted(F.col(text))


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of docs, repeated ids included; empty tables give no rows.

    A null text, an empty one or one without a letter is und with score 0. A text of any length is cut into windows that cover it.
    Of languages with one probability the first in the alphabet counts. Extra columns are left out.
    """
    found = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), predict(fit(docs)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
