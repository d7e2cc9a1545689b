"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of c or more lie within eps = sqrt(2 - 2 c) of each other. Vectors are turned to principal axes,
sorted by their grid cells of width eps on the leading ones (the epsilon grid order) and cut into sequence intervals. Intervals
are dealt by the cells that they cover on the two leading axes, so those that are far apart there never meet; of those that do,
the ones whose boxes lie further apart than eps are dropped, and the others are joined by halving both again and again,
skipping halves that are provably distant, until small ones are compared in double precision.

Equal vectors are one class from the start, and inside an interval pair only link counts and a spanning set of edges leave the
task, so a large group of near copies never becomes a list of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import written

COSINE = 0.98
SAMPLE = 20_000  #: vectors that the principal axes are fitted on at most; any axes give the same links
LEADING = 6  #: principal axes of the grid
MOST_AXES = 2048  #: components beyond which vectors are not turned: the grid is laid on their own leading components then
SAMPLED = 1 << 23  #: components of the sample at most
INTERVAL = 1024  #: vectors of an interval at most
COMPONENTS = 1 << 18  #: and their components, where that leaves one vector at least
LEAF = 128  #: vectors that are compared without another halving
MARGIN = 1e-9  #: by which boxes must be further apart than eps, for rounding


def axes(vectors: np.ndarray) -> np.ndarray:
    """Columns: all principal axes, the widest first."""
    if len(vectors) < 2:
        return np.eye(vectors.shape[1] if vectors.ndim == 2 else 1)
    return np.linalg.eigh(np.cov(vectors.T).reshape(vectors.shape[1], -1))[1][:, ::-1]


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # so that neither squares of large nor of tiny components are lost
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def turned(u: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return u @ turn if u.shape[1] == len(turn) else u


def near_pairs(x: np.ndarray, y: np.ndarray, turned_x: np.ndarray, turned_y: np.ndarray, cosine: float) -> np.ndarray:
    """Boolean matrix of the links between two intervals, by recursive halving."""
    eps, out = np.sqrt(max(0.0, 2 - 2 * cosine)), np.zeros((len(x), len(y)), bool)

    def meet(a: int, b: int, c: int, d: int) -> None:
        p, q = turned_x[a:b], turned_y[c:d]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if gap @ gap > (eps + MARGIN) ** 2:
            return
        if b - a <= LEAF and d - c <= LEAF:
            out[a:b, c:d] = x[a:b] @ y[c:d].T >= cosine
        elif b - a >= d - c:
            meet(a, (a + b) // 2, c, d)
            meet((a + b) // 2, b, c, d)
        else:
            meet(a, b, c, (c + d) // 2)
            meet(a, b, (c + d) // 2, d)

    meet(0, len(x), 0, len(y))
    return out


def spanning(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows and columns of a link matrix: the smallest number in the component, rows first, columns after them."""
    n, m = links.shape
    top = n + m
    r, c = np.arange(n), n + np.arange(m)
    while True:
        r2 = np.minimum(r, np.where(links, c[None], top).min(1, initial=top))
        c2 = np.minimum(c, np.where(links, r2[:, None], top).min(0, initial=top))
        if (r2 == r).all() and (c2 == c).all():
            return r, c
        r, c = r2, c2


def _width(cosine: float) -> float:
    """Of a grid cell: a little over eps, so that vectors within eps lie in neighbouring cells in spite of rounding."""
    return float(np.sqrt(max(1e-12, 2 - 2 * cosine))) + MARGIN


def intervals(classes: DataFrame, turn: np.ndarray, cosine: float) -> DataFrame:
    """(block, label, size, cls, times, vectors, low, high): runs of the epsilon grid order of each label and vector size."""
    width = _width(cosine)

    def cells(column: pa.Array) -> pa.Array:
        sizes = column.value_lengths().to_numpy()
        flat, offs = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros((len(sizes), LEADING), np.int64)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for i in range(0, len(rows), max(1, COMPONENTS // size)):
                own = rows[i : i + max(1, COMPONENTS // size)]
                t = turned(unit(flat[offs[own][:, None] + np.arange(size)]), turn)[:, :LEADING]
                out[own, : t.shape[1]] = np.floor(t / width)
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), LEADING).cast(pa.list_(pa.int64()))

    cell = F.arrow_udf(cells, "array<long>")(F.col("embedding"))
    by = ["label", "size", *(f"c{k}" for k in range(LEADING)), "cls"]
    ordered = classes.withColumn("cell", cell).select("label", "size", *(F.col("cell")[k].alias(f"c{k}") for k in range(LEADING)), "cls", "times", "embedding")
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by)

    def cut(batches):
        block, held, count, key = TaskContext.get().partitionId() << 33, [], 0, None

        def done():
            nonlocal block, count
            cls, times, v = (np.concatenate([h[k] for h in held]) for k in range(3))
            t = turned(unit(v), turn)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            row = [[block], [key[0]], [key[1]], [cls], [times], [v.tobytes()], [t.min(0)], [t.max(0)]]
            block, count = block + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["block", "label", "size", "cls", "times", "vectors", "low", "high"])

        for batch in batches:
            label, size, cls, times = (batch.column(k).to_numpy() for k in ("label", "size", "cls", "times"))
            flat, at = batch.column("embedding").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            i = 0
            while i < len(label):
                if held and (key != (int(label[i]), int(size[i])) or count >= max(1, min(INTERVAL, COMPONENTS // key[1]))):
                    yield done()
                key = (int(label[i]), int(size[i]))
                j = min(len(label), i + max(1, min(INTERVAL, COMPONENTS // key[1])) - count)
                other = np.flatnonzero((label[i:j] != key[0]) | (size[i:j] != key[1]))
                j = i + int(other[0]) if len(other) else j
                held.append((cls[i:j], times[i:j], flat[at[i] : at[j]].reshape(j - i, key[1])))
                count, i = count + j - i, j
        if held:
            yield done()

    return ordered.mapInArrow(cut, "block long, label long, size int, cls array<long>, times array<long>, vectors binary, low array<double>, high array<double>")


def interval_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """(p, q), p <= q: intervals whose boxes are within eps; they meet in a common cell of the two leading axes, give or take one."""
    eps, width = float(np.sqrt(max(0.0, 2 - 2 * cosine))), _width(cosine)
    at = lambda c, k, d: F.coalesce(F.floor(F.try_element_at(c, F.lit(k)) / width), F.lit(0)).cast("long") + d
    covered = blocks.select("block", "label", "size", "low", "high", F.explode(F.sequence(at("low", 1, 0), at("high", 1, 1))).alias("x"))
    covered = covered.select("*", F.explode(F.sequence(at("low", 2, 0), at("high", 2, 1))).alias("y"))
    p, q = (covered.select(F.col("block").alias(k), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}"), "label", "size", "x", "y") for k in "pq")
    gap = F.zip_with(F.zip_with("low_p", "high_q", lambda a, b: a - b), F.zip_with("low_q", "high_p", lambda a, b: a - b), lambda a, b: F.greatest(F.lit(0.0), a, b))
    square = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return p.join(q, ["label", "size", "x", "y"]).where((F.col("p") <= F.col("q")) & (square <= (eps + MARGIN) ** 2)).select("p", "q").distinct()


def join(vectors: DataFrame, cosine: float = COSINE, label: str | None = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link only within a label (None: all may) and with vectors of their own length. A null label, or a vector that is
    null, zero, empty or holds null or non-finite components, links with nothing; such a row, and one without an id, is in
    the result. Each row is a vector of its own, so equal rows link with each other; a tie for the smallest id is no matter. An
    empty table gives no rows; extra columns are left out. Vectors of any length are compared, those over MOST_AXES components
    without turning. Vectors whose two 64-bit hashes are equal are taken for equal.
    """
    plain = isinstance(vectors.schema["embedding"].dataType.elementType, (T.FloatType, T.DoubleType))
    rows = vectors.select("vec_id", F.col("embedding") if plain else F.col("embedding").cast("array<double>"), (F.col(label) if label else F.lit(0)).cast("long").alias("label"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(sound)
    keys = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    kind = np.float32 if rows.schema["embedding"].dataType.elementType == T.FloatType() else np.float64
    classes = good.groupBy("label", *keys).agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("embedding").alias("embedding"))
    classes = written(classes.select("*", F.size("embedding").alias("size"), F.monotonically_increasing_id().alias("cls")), "vectors")
    common = classes.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 1
    turn = np.zeros((0, 0))
    if size <= MOST_AXES:
        sample = classes.where(F.col("size") == size).orderBy("h1", "h2").limit(min(SAMPLE, SAMPLED // size)).select("embedding").toArrow()["embedding"].combine_chunks()
        turn = axes(unit(sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))) if len(sample) else np.eye(1)
    blocks = written(intervals(classes, turn, cosine), "intervals")
    pairs = interval_pairs(blocks, cosine)
    side = lambda k: blocks.select(*(F.col(c).alias(f"{c}_{k}" if c != "block" else k) for c in ("block", "size", "cls", "times", "vectors")))
    both = pairs.join(side("p"), "p").join(side("q"), "q")

    def compared(batches):
        for batch in batches:
            nodes, counts, tos = [], [], []
            get = lambda k, i: batch.column(k)[i].as_py()  # noqa: E731, B023
            for i in range(batch.num_rows):
                n, same = get("size_p", i), get("p", i) == get("q", i)
                x, y = (unit(np.frombuffer(get(f"vectors_{k}", i), kind).reshape(-1, n)) for k in "pq")
                links = near_pairs(x, y, turned(x, turn), turned(y, turn), cosine)
                keys = np.array([*get("cls_p", i), *get("cls_q", i)], np.int64)
                times_p, times_q = np.array(get("times_p", i)), np.array(get("times_q", i))
                if same:
                    np.fill_diagonal(links, False)
                up, down = links @ times_q, times_p @ links
                r, c = spanning(links | np.eye(len(x), dtype=bool) if same else links)
                total = up if same else np.concatenate([up, down])
                root = keys[r] if same else keys[np.concatenate([r, c])]
                hit = np.flatnonzero(total)
                nodes.append(keys[: len(total)][hit])
                counts.append(total[hit])
                tos.append(root[hit])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).astype(np.int64)) for z in (nodes, counts, tos)], ["cls", "times", "root"])

    found = written(both.mapInArrow(compared, "cls long, times long, root long"), "links")
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    others = found.groupBy("cls").agg(F.sum("times").alias("others"))
    named = classes.join(others, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("label", "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", "label", *keys).join(named, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8(vectors: DataFrame) -> DataFrame:
    return join(vectors)
