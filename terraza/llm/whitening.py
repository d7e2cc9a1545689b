"""Embedding whitening by incremental eigendecomposition.

Every partition keeps the spectrum of the scatter of the vectors that it has seen: row counts, sums and the eigenvalues and
eigenvectors about their mean. New vectors enter as centred rank-one updates: the eigenvalues of diag(l) + z z' are the roots
of the secular equation 1 + sum(z_i^2 / (l_i - x)), found for all at once by a rational iteration inside brackets; components
of z that are nothing, and eigenvalues that are equal, are deflated first; the vectors come from a z that fits the roots
found, so that they stay orthogonal. Spectra of partitions are combined by as many rank-one updates as one of them has
eigenvectors, and one for the distance of their means, in levels of FAN. A last pass over all vectors takes the Rayleigh
quotients of the combined eigenvectors and solves that small problem, which brings components and values to double precision.

A run of RUN times as many vectors as they have components is first turned (QR) into as many vectors as components with the same
scatter, so that rank-one updates cost the same for each run; shorter runs enter vector by vector.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

FAN = 32  #: partial results that one task combines
RUN = 64  #: vectors for each component that are taken in at once
HELD = 1 << 20  #: components of such a run, where that leaves two vectors for each component
EPS = np.finfo(float).eps
COMPONENTS = 8
FLAT = 1e-13  #: share of the variance from which on a component counts: below it is rounding


@lru_cache(4)
def _shape(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of k poles: whether pole i is left of root j, and the other pole of factor (i, j) of a weight."""
    i, j = np.arange(k)[:, None], np.arange(k)[None]
    return i <= j, (j + (j >= i))[:, :-1]


def secular(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots x of 1 + sum(weights / (poles - x)), one above each of the ascending poles, and the matrix poles - x.

    A root is held as its distance to the nearer pole, so that the differences keep their digits.
    """
    k = len(poles)
    left, _ = _shape(k)
    gap = np.append(poles[1:], poles[-1] + weights.sum()) - poles
    middle = 1 + (weights[:, None] / (poles[:, None] - (poles + gap / 2))).sum(0)
    right = middle < 0
    right[-1] = False
    origin = poles[np.arange(k) + right]
    shifted = poles[:, None] - origin
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    high[-1] = gap[-1]
    x, own, done = (low + high) / 2, np.arange(k), np.zeros(k, bool)
    beyond = np.append(poles[1:], poles[-1] + gap[-1]) - origin
    with np.errstate(all="ignore"):
        for _ in range(128):
            delta = shifted - x
            term = weights[:, None] / delta
            f = 1 + term.sum(0)
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            done |= (np.abs(f) <= k * EPS * (1 + np.abs(term).sum(0))) | (high - low <= 2 * EPS * np.abs(x))
            if done.all():
                break
            slope = term / delta
            psi = np.where(left, slope, 0).sum(0)
            phi = slope.sum(0) - psi
            p, q = delta[own, own], beyond - x
            c = f - p * psi - q * phi
            a, b = (p + q) * f - p * q * (psi + phi), p * q * f
            root = np.sqrt(np.maximum(0, a * a - 4 * b * c))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = p[-1] + p[-1] * p[-1] * psi[-1] / (f[-1] - p[-1] * psi[-1])
            to = x + step
            done |= np.abs(step) <= 2 * EPS * np.abs(x)
            x = np.where(done, x, np.where((to >= low) & (to <= high) & (to != 0), to, (low + high) / 2))
    return origin + x, shifted - x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors, in columns, of vectors diag(values) vectors' + v v'."""
    z = v @ vectors
    norm = np.sqrt(z @ z)
    tol = 8 * EPS * max(np.abs(values).max(initial=0), norm * np.abs(z).max(initial=0))
    if not norm * norm > tol:
        return values, vectors
    close, i = np.flatnonzero(np.diff(values) <= tol), -1
    if len(close):
        vectors = vectors.copy()
    for first in close:
        if first < i:
            continue
        i = int(np.searchsorted(values, values[first] + tol, "right"))
        own = slice(first, i)
        size = np.sqrt(z[own] @ z[own])
        if size > 0:  # a reflection leaves one of the equal eigenvalues' vectors with all of their part of z
            u = z[own].copy()
            at = -size if u[-1] > 0 else size
            u[-1] -= at
            u /= np.sqrt(u @ u)
            vectors[:, own] -= 2 * np.outer(vectors[:, own] @ u, u)
            z[own], z[i - 1] = 0, at
    keep = norm * np.abs(z) > tol
    poles, part = values[keep], z[keep]
    roots, delta = secular(poles, part * part)
    if len(poles) > 1:
        _, other = _shape(len(poles))
        part = np.copysign(np.sqrt(np.abs(delta[:, -1] * (delta[:, :-1] / (poles[:, None] - poles[other])).prod(1))), part)
    turn = part[:, None] / delta
    turn /= np.sqrt((turn * turn).sum(0))
    values, made = values.copy(), vectors.copy()
    values[keep], made[:, keep] = roots, vectors[:, keep] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], made[:, order]


@dataclass
class Spectrum:
    """Of the vectors seen: how many, their sums (Python numbers, so those of integers are exact), and the spectrum of their scatter."""

    size: int
    n: int = 0
    sums: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    vectors: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.sums is None:
            self.sums, self.values, self.vectors = np.zeros(self.size, object), np.zeros(self.size), np.eye(self.size)

    def add(self, n: int, sums: np.ndarray, rows: Iterable[np.ndarray]) -> None:
        """n vectors with these sums, whose scatter about their own mean is that of rows about nothing."""
        rows = list(rows)
        if self.n and n:
            apart = np.array([float(x) for x in sums * self.n - self.sums * n])
            rows.append(apart / np.sqrt(float(self.n) * n * (self.n + n)))
        for v in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self.n, self.sums = self.n + n, self.sums + sums

    def take(self, x: np.ndarray) -> None:
        """Vectors, in rows."""
        sums = exact_sums(x)
        mean = np.array([float(s) for s in sums]) / len(x)
        rows = x - mean
        if len(rows) > self.size:
            rows = np.linalg.qr(rows, mode="r")
        self.add(len(x), sums, rows)

    def merge(self, other: Spectrum) -> None:
        held = other.values > 0
        self.add(other.n, other.sums, (np.sqrt(other.values[held]) * other.vectors[:, held]).T)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python numbers."""
    safe = x.dtype.kind == "f" or np.abs(x.astype(float)).max(initial=0) * len(x) < 2**62
    return x.sum(0).astype(object) if safe else x.astype(object).sum(0)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray | list]:
    """n x - sums as doubles, and each row's sum of their squares: exact for integers, None where it is beyond 64 bits."""
    if x.dtype.kind == "f":
        t = n * x - sums.astype(float)
        return t, (t * t).sum(1)
    if np.abs(x.astype(float)).max(initial=0) * n < 2**62 and max(map(abs, sums.tolist())) < 2**62:
        t = n * x - sums.astype(np.int64)
        if float(np.abs(t.astype(float)).max(initial=0)) ** 2 * x.shape[1] < 2**62:
            return t.astype(float), (t * t).sum(1)
    t = n * x.astype(object) - sums
    return t.astype(float), [s if s < 1 << 63 else None for s in (t * t).sum(1).tolist()]


def by_size(batch: pa.RecordBatch, column: str) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their vectors) for each length of vector."""
    lists = batch.column(column)
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[at[rows][:, None] + np.arange(size)]


def combined(parts: DataFrame, merge: Callable[[object, object], object], name: str) -> dict[int, object]:
    """What merge makes of all (size, part) of each size: pickled partial results, combined in tasks by FAN, level by level."""

    def level(frame):
        out = None
        for part in map(pickle.loads, frame["part"]):
            out = part if out is None else merge(out, part)
        return frame[["size"]].iloc[:1].assign(part=pickle.dumps(out))

    while True:
        parts = written(parts, name)
        most = parts.groupBy("size").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return {r["size"]: pickle.loads(r["part"]) for r in parts.collect()}
        group = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(-(-most // FAN)))
        parts = parts.withColumn("g", group).groupBy("size", "g").applyInPandas(level, "size int, part binary")


def _folded(rows: DataFrame, column: str, start: Callable[[int], object], take: Callable[[object, np.ndarray], object], merge, name: str) -> dict[int, object]:
    """One result for each length of vector: start(size), then take over the vectors of a task, then merge over the tasks."""

    def fold(batches):
        out = {}
        for batch in batches:
            for _, x in by_size(batch, column):
                size = x.shape[1]
                run = max(2 * size, min(RUN * size, HELD // size))
                for i in range(0, len(x), run):
                    out[size] = take(out.get(size) or start(size), x[i : i + run])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([pickle.dumps(x) for x in out.values()], pa.binary())], ["size", "part"])

    return combined(rows.select(column).mapInArrow(fold, "size int, part binary"), merge, name)


@dataclass
class Model:
    """Of the vectors of one length: how many, their exact sums, components in rows by falling eigenvalue, eigenvalues, and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float


def _taken(s: Spectrum, x: np.ndarray) -> Spectrum:
    s.take(x)
    return s


def _merged(a: Spectrum, b: Spectrum) -> Spectrum:
    a.merge(b)
    return a


def fit(rows: DataFrame, column: str, k: int = COMPONENTS) -> dict[int, Model]:
    """The leading k components of the vectors of each length; see whiten."""
    spectra = _folded(rows, column, Spectrum, _taken, _merged, "spectra")
    bases = {size: (s.n, s.sums, np.linalg.qr(s.vectors[:, ::-1])[0]) for size, s in spectra.items()}

    def quotients(h, x):
        n, sums, basis = bases[x.shape[1]]
        t = deviations(x, n, sums)[0] / n @ basis
        return [h[0] + t.T @ t]

    grams = _folded(rows, column, lambda size: [np.zeros((size, size))], quotients, lambda a, b: [a[0] + b[0]], "quotients")
    out = {}
    for size, (h,) in grams.items():
        n, sums, basis = bases[size]
        values, turn = np.linalg.eigh(h / n)
        components = (basis @ turn[:, ::-1][:, :k]).T
        components *= np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])[:, None]
        out[size] = Model(n, sums, components, np.maximum(0, values[::-1][:k]), float(np.trace(h / n)))
    return out


def whiten(rows: DataFrame, column: str, models: dict[int, Model]) -> DataFrame:
    """rows with `size`, `deviation` and `whitened`: column's vector less the mean, on each component, over the root of its eigenvalue.

    deviation is the sum of squares of n times the vector less the sums; for integers it is exact, and null beyond 64 bits. Vectors
    hold no nulls and only finite components. Vectors of each length are a space of their own, with components as many as the model
    has; an empty vector has none. A component without variance (one vector, equal vectors, fewer vectors than components) has no
    whitened value: null. Equal rows have equal results; equal eigenvalues may have any components of their space, the same for all
    rows. Extra columns are kept, but for the three names.
    """
    held = rows.sparkSession.sparkContext.broadcast(models)
    kind = "long" if rows.schema[column].dataType.elementType.simpleString() == "bigint" else "double"
    keep = [c for c in rows.columns if c not in ("size", "deviation", "whitened")]
    schema = rows.select(*keep).withColumns({"size": F.lit(0), "deviation": F.lit(None).cast(kind), "whitened": F.lit(None).cast("array<double>")}).schema

    def out(batches):
        for batch in batches:
            sizes = batch.column(column).value_lengths()
            parts, order, deviation = [], [], []
            for own, x in by_size(batch, column):
                m = held.value[x.shape[1]]
                t, squares = deviations(x, m.n, m.sums)
                there = m.values > FLAT * m.trace
                w = np.divide((t / m.n) @ m.components.T, np.sqrt(m.values), where=there, out=np.zeros((len(x), len(there))))
                flat = pa.array(w.ravel(), mask=np.tile(~there, len(x)))
                parts.append(pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(there), flat))
                order.append(own)
                deviation.append(pa.array(squares, pa.int64() if kind == "long" else pa.float64()))
            if parts:
                back = pa.array(np.argsort(np.concatenate(order)))
                columns = [batch.column(c) for c in keep] + [sizes.cast(pa.int32()), pa.concat_arrays(deviation).take(back), pa.concat_arrays(parts).take(back)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "size", "deviation", "whitened"])

    return rows.select(*keep).mapInArrow(out, schema)


def identity_errors(table: DataFrame) -> dict[int, float]:
    """The largest absolute entry of the whitened vectors' covariance less the identity, for each size, over components with variance."""

    def moments(h, w):
        return [h[0] + len(w), h[1] + w.sum(0), h[2] + w.T @ w]

    out: dict[int, float] = {}

    def fold(batches):
        held = {}
        for batch in batches:
            sizes, flat = batch.column("size").to_numpy(), batch.column("whitened").flatten().to_numpy(zero_copy_only=False)
            width = batch.column("whitened").value_lengths().to_numpy()
            at = np.cumsum(width) - width
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                w = flat[at[rows][:, None] + np.arange(width[rows[0]])]
                held[int(size)] = moments(held.get(int(size)) or [0, 0.0, 0.0], w)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pickle.dumps(x) for x in held.values()], pa.binary())], ["size", "part"])

    for size, (n, s, h) in combined(table.select("size", "whitened").mapInArrow(fold, "size int, part binary"), lambda a, b: [x + y for x, y in zip(a, b, strict=True)], "moments").items():
        c = h / n - np.outer(s / n, s / n) - np.eye(len(s))
        out[size] = float(np.abs(c[np.isfinite(c)]).max(initial=0.0))
    return out


def op11(vectors: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of the vectors without null or non-finite entries.

    An entry c becomes floor(1024 c) + 100000 (|1024 c| over 2^62 counts as that), so counts, sums and deviations are exact. An empty
    table gives no rows, nor does an empty vector; extra columns are left out. See whiten for the other cases.
    """
    c = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size("embedding") > 0)
    whole = F.transform(c, lambda x: F.floor(F.least(F.lit(2.0**62), F.greatest(F.lit(-(2.0**62)), x * 1024))) + 100000)
    rows = vectors.where(sound).select("vec_id", whole.alias("x"))
    models = fit(rows, "x")
    table = written(whiten(rows, "x", models).drop("x"), "whitened")
    errors = identity_errors(table)
    per_size = [(size, m.n, [float(v / m.trace) if m.trace > 0 else 0.0 for v in m.values], errors.get(size, 0.0)) for size, m in models.items()]
    sizes = vectors.sparkSession.createDataFrame(per_size, "size int, n long, shares array<double>, identity_error double")
    out = table.join(F.broadcast(sizes), "size").select("vec_id", "n", "deviation", "shares", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("shares", F.col("at") + 1).alias("explained"), "identity_error")
