"""Exact Jaccard self-join of documents on word shingles, by prefix filters under several global token orders.

Two sets of Jaccard t or more share a token among the first n - ceil(t n) + 1 of each under ANY one order of all tokens, and
k tokens where the prefixes are longer by k - 1. The first order puts rare shingles first (by a sketch of what is common) and
deals the candidates; the others are hash orders. Of a candidate pair the prefixes under those are shuffled first, a fifth of a
set and a tenth more each, in half the bits, and only pairs whose prefixes share a tenth under every order have their whole
sets shuffled and compared.

Documents with one and the same set are one class from the start. Classes that share prefix tokens are compared in two steps,
so that a large group of near copies is never expanded into pairs: first each class with one leader, the class of its posting
lists whose shingles are most common (an original among its edited copies), whose set is copied where it leads many; then,
across the components which that leaves, every candidate pair, in blocks. Pairs inside a component need no comparison, as
only components are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components
from .shared import release, written

WIDTH = 5
SHARE = 80  #: per cent of the union that the intersection has at least
ORDERS = 3
BUCKETS = 1 << 21  #: of the sketch of common shingles
SLICE = 1 << 13  #: buckets that a task sends as one row
SEEN = 1 << 16  #: classes that a task remembers so as not to emit them again
BLOCK = 50_000  #: tokens of the classes that are compared as one
CLASSES = 1000  #: and their number
FOLLOWERS = 256  #: classes that meet one copy of a leader
COPIES = 64  #: of a large team's number of blocks
SIEVE = 1 << 23  #: bits of the sieves before a shuffle; a sieve that fills up lets all through


def prefix_size(n: int, share: int = SHARE) -> int:
    return n + (-n * share // 100) + 1


def least_shared(n: int, share: int = SHARE) -> int:
    """How many prefix tokens a set of n tokens has to share where prefixes are longer by one less than that."""
    return min(-(-n * share // 100), 3 + n // 50)


def _least_shared(n: Column, share: int) -> Column:
    """The least that a set of n tokens has to share with any set of a fitting size."""
    low = F.floor(n * share / 100)
    return F.greatest(F.lit(1), F.least(F.ceil(low * share / 100), 3 + F.floor(low / 50)))


def _class(sets: list[np.ndarray], level: np.ndarray | None = None) -> np.ndarray:
    """A key of each set: how little of it is not common in the leading bits, if levels are given, then 59 bits of a hash."""
    out, hub = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = s.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(tk.mix(s))
            if level is not None:
                rare = int((level[(s % np.uint64(BUCKETS)).astype(np.int64)] == 0).sum())
                hub[i] = max(0, 15 - rare.bit_length()) if rare < len(s) else 0
    return hub << np.uint64(59) | tk.mix(out) >> np.uint64(5)


def _order(s: np.ndarray, k: int) -> np.ndarray:
    """Ranks of tokens in the k-th hash order."""
    return tk.mix(s ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1))


def hash_shared(n: int) -> int:
    """How many tokens the prefixes of two sets share at least under a hash order, the smaller of both numbers."""
    return max(1, n // 10)


def prefixes(s: np.ndarray, share: int = SHARE) -> list[np.ndarray]:
    """The prefix of a set under each hash order, as 32-bit ranks; ranks of one order are equal where tokens are."""
    p = prefix_size(len(s), share) + hash_shared(len(s)) - 1
    return [(np.partition(_order(s, k), p - 1)[:p] >> np.uint64(32)).astype(np.uint32) for k in range(1, ORDERS)]


def meet(x: np.ndarray, nx: int, y: np.ndarray, ny: int, share: int = SHARE) -> bool:
    """Whether two sets of nx and ny tokens may link by their sizes and their prefixes, one order's after the other's."""
    if 100 * min(nx, ny) < share * max(nx, ny):
        return False
    pairs = zip(np.split(x, ORDERS - 1), np.split(y, ORDERS - 1), strict=True)
    return all(np.isin(p, q, kind="sort").sum() >= hash_shared(min(nx, ny)) for p, q in pairs)


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def _sets(batch: pa.RecordBatch, level: np.ndarray | None):
    for c in tk.chunks(batch.column("text")):
        sets = tk.shingle_sets(c, WIDTH)
        yield c, sets, _class(sets, level)


def _batch(names: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "tokens": pa.list_(pa.int64())}
    pairs = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kinds[k]) for x, (_, k) in zip(columns, pairs, strict=True)], [n for n, _ in pairs])


def levels(docs: DataFrame) -> np.ndarray:
    """How common the shingles of each bucket are, as a power of two; 0 where no more than chance puts there.

    Every document's every shingle is counted, in a sketch of a fixed size: each task sends its counts in slices, which are
    summed where the slice is. A shingle in one document of ten thousand stands out at any number of documents.
    """

    def counted(batches):
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for c in tk.chunks(batch.column("text")):
                np.add.at(total, (np.concatenate(tk.shingle_sets(c, WIDTH)) % np.uint64(BUCKETS)).astype(np.int64), np.uint32(1))
        for k in range(0, BUCKETS, SLICE):
            if total[k : k + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([total[k : k + SLICE].tobytes()])], ["slice", "counts"])

    def summed(batches):
        key, total = None, np.zeros(SLICE, np.int64)
        for batch in batches:
            for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()])], ["slice", "counts"])
                    key, total = k, np.zeros(SLICE, np.int64)
                total += np.frombuffer(counts.as_buffer(), np.uint32)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()])], ["slice", "counts"])

    sent = docs.select("text").mapInArrow(counted, "slice int, counts binary")
    got = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(summed, "slice int, counts binary").toArrow()
    total = np.zeros(BUCKETS, np.int64)
    for k, counts in zip(got["slice"].to_pylist(), got["counts"].to_pylist(), strict=True):
        total[k * SLICE : (k + 1) * SLICE] = np.frombuffer(counts, np.int64)
    del got
    release()
    chance = np.median(total)
    over = total - chance
    return np.where(over >= 4 + 5 * np.sqrt(chance), np.log2(np.maximum(over, 1)) + 1, 0).astype(np.uint8)


def classes(docs: DataFrame, held: Broadcast) -> DataFrame:
    """(doc_id, key, cls, n): a row for each document; key is a hash of its text."""

    def measured(batches):
        for batch in batches:
            for c, sets, cls in _sets(batch, held.value):
                own = (batch.column(k).slice(c.row, len(c)).cast(pa.int64()) for k in ("doc_id", "key"))
                yield _batch("doc_id long, key long, cls long, n long", *own, cls.view(np.int64), [len(s) for s in sets])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(measured, "doc_id long, key long, cls long, n long")


def _sieve(keys: DataFrame) -> Broadcast:
    """Bits for the keys of a one-column table, of a fixed size whatever their number."""
    name = keys.columns[0]
    bits = keys.select(F.col(name).bitwiseAND(SIEVE - 1).alias("k")).distinct().toArrow()["k"].to_numpy()
    sieve = np.zeros(SIEVE, bool)
    sieve[bits] = True
    return keys.sparkSession.sparkContext.broadcast(np.packbits(sieve))


def _passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(SIEVE - 1)
    return (sieve[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _new(seen: dict, key: int) -> bool:
    """Whether a task meets a class for the first time, as far as it remembers."""
    if key in seen:
        return False
    if len(seen) >= SEEN:
        seen.clear()
    seen[key] = True
    return True


def postings(docs: DataFrame, held: Broadcast, share: int = SHARE, only: Broadcast | None = None) -> DataFrame:
    """(tok, cls): the prefix of each class under the first order, or what of it passes a sieve."""

    def indexed(batches):
        level, seen = held.value, {}
        for batch in batches:
            for _, sets, cls in _sets(batch, level):
                parts, who = [], []
                for s, k in zip(sets, cls.tolist(), strict=True):
                    if len(s) and _new(seen, k):
                        p = prefix_size(len(s), share) + least_shared(len(s), share) - 1
                        # s is sorted, so a stable sort by level orders by (level, hash)
                        parts.append(s[np.argsort(level[(s % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")[:p]])
                        who.append(k)
                if parts:
                    tok, cls = np.concatenate(parts), np.repeat(np.array(who, np.uint64), list(map(len, parts)))
                    if only:
                        good = _passes(only.value, tok)
                        tok, cls = tok[good], cls[good]
                    yield _batch("tok long, cls long", tok.view(np.int64), cls.view(np.int64))

    return docs.select("text").mapInArrow(indexed, "tok long, cls long")


def needed(docs: DataFrame, held: Broadcast, cls: DataFrame, share: int | None = None) -> DataFrame:
    """(cls, n, tokens) of the classes of cls (cls, least), and of some others that the sieves let through.

    tokens are the class's set or, if a share is given, its prefixes under the hash orders, one after the other, in half the
    bits. least is a
    document of the class, so only those documents, and those without an id, are read for words again.
    """
    only, ids = _sieve(cls.select("cls")), _sieve(cls.where("least is not null").select("least"))

    def kept(batches):
        seen = {}
        for batch in batches:
            own = batch.column("doc_id").cast(pa.int64())
            asked = _passes(ids.value, own.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) | own.is_null().to_numpy(zero_copy_only=False)
            for _, sets, keys in _sets(batch.filter(pa.array(asked)), held.value):
                out = [i for i in np.flatnonzero(_passes(only.value, keys)).tolist() if len(sets[i]) and _new(seen, int(keys[i]))]
                if out:
                    lists = [np.concatenate(prefixes(sets[i], share)) if share else sets[i] for i in out]
                    yield _batch("cls long, n long, tokens tokens", keys[out].view(np.int64), [len(sets[i]) for i in out], pa.array([x.view(kind) for x in lists], pa.list_(pa.from_numpy_dtype(kind))))

    kind = np.int32 if share else np.int64
    return docs.select("doc_id", "text").mapInArrow(kept, f"cls long, n long, tokens array<{'int' if share else 'long'}>").dropDuplicates(["cls"])


def _pairwise(pairs: DataFrame, sets: DataFrame, test) -> DataFrame:
    """Of the pairs (a, b, copies), those whose rows (n, tokens) of sets pass test(x, nx, y, ny).

    A leader a of many pairs has so many copies, and a pair goes to one of them, so no leader's pairs are one task's.
    """

    def tested(batches):
        for batch in batches:
            (x, xo), (y, yo) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("x"), batch.column("y")))
            nx, ny = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
            good = [test(x[xo[i] : xo[i + 1]], nx[i], y[yo[i] : yo[i + 1]], ny[i]) for i in range(len(batch))]
            yield batch.select(["a", "b", "copies"]).filter(pa.array(good, pa.bool_()))

    copy = F.pmod(F.xxhash64("b"), "copies").alias("copy")
    with_b = pairs.select("*", copy).join(sets.select(F.col("cls").alias("b"), F.col("n").alias("ny"), F.col("tokens").alias("y")), "b")
    leads = pairs.groupBy("a").agg(F.max("copies").alias("most")).join(sets.select(F.col("cls").alias("a"), F.col("n").alias("nx"), F.col("tokens").alias("x")), "a")
    leads = leads.select("a", "nx", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)).alias("copy"))
    both = with_b.join(leads, ["a", "copy"]).select("a", "b", "copies", "nx", "x", "ny", "y")
    return both.mapInArrow(tested, "a long, b long, copies long")


def _both(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cls, least) of either side of pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(sizes.select("cls", "least"), "cls")


def candidates(docs: DataFrame, held: Broadcast, pairs: DataFrame, sizes: DataFrame, share: int = SHARE) -> DataFrame:
    """Of the pairs (a, b, copies) of the first order, those that meet under each hash order too."""

    return _pairwise(pairs, needed(docs, held, _both(pairs, sizes), share), lambda x, nx, y, ny: meet(x, nx, y, ny, share))


def verified(docs: DataFrame, held: Broadcast, pairs: DataFrame, sizes: DataFrame, share: int = SHARE) -> DataFrame:
    """Of the pairs (a, b, copies) of classes, those that link, as (a, b)."""
    return _pairwise(pairs, needed(docs, held, _both(pairs, sizes)), lambda x, nx, y, ny: linked(x, y, share)).select("a", "b")


def counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """The intersection size of each of xs with each of ys, by products of incidence matrices over the tokens that both sides hold."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    x, y = np.concatenate(xs), np.concatenate(ys)
    i, j = np.repeat(np.arange(len(xs)), list(map(len, xs))), np.repeat(np.arange(len(ys)), list(map(len, ys)))
    both = np.intersect1d(x, y)
    if not len(both):
        return out
    sides = []
    for flat, row, n in ((x, i, len(xs)), (y, j, len(ys))):
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = np.flatnonzero(both[at] == flat)
        hit = hit[np.argsort(at[hit], kind="stable")]
        sides.append((at[hit], row[hit], n))
    for low in range(0, len(both), 2048):
        parts = []
        for at, row, n in sides:
            s, e = np.searchsorted(at, [low, low + 2048])
            parts.append(np.zeros((n, min(2048, len(both) - low)), np.float32))
            parts[-1][row[s:e], at[s:e] - low] = 1
        out += parts[0] @ parts[1].T
    return out


def _open(left: list[tuple], right: list[tuple], share: int) -> np.ndarray:
    """Which pairs of (cls, least, comp, n, tokens) are of different components and of sizes that can link."""
    nx, ny = np.array([r[3] for r in left]), np.array([r[3] for r in right])
    comp_x, comp_y = np.array([r[2] for r in left]), np.array([r[2] for r in right])
    return (comp_x[:, None] != comp_y[None]) & (100 * nx[:, None] >= share * ny[None]) & (100 * ny[None] >= share * nx[:, None])


def survivors(left: list[tuple], right: list[tuple], share: int) -> list[tuple]:
    """Of the classes of two blocks, with their prefixes as tokens, those that may link with one of the other block."""
    open_ = _open(left, right, share)
    for k in range(ORDERS - 1):
        x, y = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(x):
            return []
        first = [[np.split(side[i][4], ORDERS - 1)[k] for i in rows] for side, rows in ((left, x), (right, y))]
        need = np.minimum(*np.meshgrid([left[i][3] for i in x], [right[j][3] for j in y], indexing="ij")) // 10
        # Tokens of one set with one rank are counted once, so that many less are asked for.
        repeats = np.array([len(p) - len(np.unique(p)) for p in first[0]])
        open_[np.ix_(x, y)] &= counts(*first) >= np.maximum(1, need - repeats[:, None])
    rows = {left[i][:3]: None for i in np.flatnonzero(open_.any(1))} | {right[i][:3]: None for i in np.flatnonzero(open_.any(0))}
    return list(rows)


def block_links(left: list[tuple], right: list[tuple], share: int) -> list[tuple[int, int]]:
    """Links between the classes of two blocks, with their sets as tokens, that join different components, as few as keep them joined."""
    open_ = _open(left, right, share)
    if not open_.any():
        return []
    both = counts([r[4] for r in left], [r[4] for r in right]).astype(np.int32)
    nx, ny = np.array([r[3] for r in left], np.int32), np.array([r[3] for r in right], np.int32)
    found, up = [], {}

    def root(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    for i, j in np.argwhere(open_ & (100 * both >= share * (nx[:, None] + ny[None] - both))).tolist():
        p, q = root(left[i][2]), root(right[j][2])
        if p != q:
            up[p] = q
            found.append((left[i][0], right[j][0]))
    return found


def _block_pairs(rows: DataFrame, compare, schema: str) -> DataFrame:
    """What compare(p's rows, q's rows) of each block pair gives; rows are (p, q, block, cls, least, comp, n, tokens), p = q a block with itself."""
    rows = rows.repartition("p", "q").sortWithinPartitions("p", "q", "block", "cls")

    def compared(batches):
        rows, key = [], None

        def done():
            p, q = key
            found = compare([r[1:] for r in rows if r[0] == p], [r[1:] for r in rows if r[0] == q], p, q)
            rows.clear()
            if found:
                yield _batch(schema, *map(list, zip(*found, strict=True)))

        for batch in batches:
            lists = batch.column("tokens")
            flat, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
            columns = [batch.column(k).to_pylist() for k in ("p", "q", "block", "cls", "least", "comp", "n")]
            for i, (p, q, *row) in enumerate(zip(*columns, strict=True)):
                if rows and key != (p, q):
                    yield from done()
                key = (p, q)
                rows.append((*row, flat[offs[i] : offs[i + 1]].copy()))
        if rows:
            yield from done()

    return rows.mapInArrow(compared, schema)


def across(docs: DataFrame, held: Broadcast, shared: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between different components among the classes of shared (tok, cls) that share tokens.

    members are (cls, least, n, comp, team, linked): the classes of one team go to blocks of about BLOCK tokens and CLASSES
    classes, and blocks whose classes share enough prefix tokens are compared as wholes, so the rows that are shuffled grow
    with pairs of blocks and not with pairs of classes. A team of linked classes is a component, whose blocks need no
    comparison with each other. The prefixes under the hash orders go first; only the classes that they leave open in a pair of
    blocks have their sets shuffled.
    """
    # Only teams of several blocks have a row in parts, in copies, so that a large team is not one task's.
    parts = members.groupBy("team").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / CLASSES)).alias("parts")).where("parts > 1")
    parts = parts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    block = F.xxhash64("team", "linked", F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1)))).alias("block")
    members = members.withColumn("copy", F.pmod(F.xxhash64(F.lit(1), "cls"), F.lit(COPIES)).cast("int"))
    members = written(members.join(parts, ["team", "copy"], "left").select("cls", "least", "n", "comp", block, F.when(F.col("linked"), F.col("comp")).alias("one"), _least_shared(F.col("n"), share).alias("need")), "members")
    by_token = shared.select("tok", "cls").join(members, "cls").groupBy("tok", "block").agg(F.min("need").alias("need"), F.min("one").alias("one"))
    # Most blocks of a token may be of one component, whose pairs must not be made: its blocks meet those of others only.
    main = by_token.groupBy("tok").agg(F.mode("one").alias("main"), F.count("*").alias("blocks"), F.count_if(F.col("one").isNull()).alias("mixed"), F.min("one").alias("low"), F.max("one").alias("high"))
    main = main.where("blocks > 1 and (mixed > 0 or low <> high)").select("tok", "main")
    by_token = written(by_token.join(main, "tok").select("tok", "block", "need", "one", F.coalesce(F.col("one") == F.col("main"), F.lit(False)).alias("home")), "tokens")
    p, q = (by_token.select("tok", F.col("block").alias(k), F.col("one").alias(f"one_{k}"), F.col("need").alias(f"need_{k}"), F.col("home").alias(f"home_{k}")) for k in "pq")
    met = p.where("not home_p").join(q, "tok").where((F.col("home_q") | (F.col("p") < F.col("q"))) & F.coalesce(F.col("one_p") != F.col("one_q"), F.lit(True)))
    pairs = met.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.count("*").alias("times"), F.min(F.least("need_p", "need_q")).alias("need")).where("times >= need").select("p", "q")
    # A block is compared with itself if it holds several components.
    alone = members.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select(F.col("block").alias("p"), F.col("block").alias("q"))
    pairs = written(pairs.unionByName(alone), "pairs")
    sides = pairs.select("p", "q", F.explode(F.when(F.col("p") == F.col("q"), F.array("p")).otherwise(F.array("p", "q"))).alias("block"))
    busy = written(members.join(sides.select("block").distinct(), "block", "left_semi").select("cls", "least", "comp", "block"), "busy")
    first = sides.join(busy.join(needed(docs, held, busy.select("cls", "least"), share), "cls"), "block")
    kind = "cls long, least long, comp long"
    left = written(_block_pairs(first, lambda x, y, p, q: [(p, q, *r) for r in survivors(x, y, share)], f"p long, q long, {kind}"), "open")
    sets = needed(docs, held, left.select("cls", "least").distinct())
    rows = left.join(busy.select("cls", "block"), "cls").join(sets, "cls")
    return _block_pairs(rows, lambda x, y, p, q: block_links(x, y, share), "a long, b long")


def join(docs: DataFrame, share: int = SHARE, keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs, extra columns left out; keyed: also key, the xxhash64 of the text, and root, one value for each component.

    A text that is null or without words has no shingles and is alone. Rows with the same id are documents of their own; a
    row without an id never lends its component one, and is in it nonetheless.
    """
    held = docs.sparkSession.sparkContext.broadcast(levels(docs))
    own = written(classes(docs, held), "classes")
    sizes = written(own.groupBy("cls").agg(F.max("n").alias("n"), F.min("doc_id").alias("least")), "sizes")
    leads = postings(docs, held, share).groupBy("tok").agg(F.max("cls").alias("lead"), F.min("cls").alias("low"), F.count("*").alias("size"))
    leads = written(leads.where("low <> lead").select("tok", "lead", F.ceil(F.col("size") / FOLLOWERS).alias("copies")), "leads")
    shared = written(postings(docs, held, share, _sieve(leads.select("tok"))).join(leads, "tok"), "postings")
    near = shared.where("cls <> lead").groupBy("cls", "lead").agg(F.count("*").alias("count"), F.max("copies").alias("copies")).join(sizes, "cls").where(F.col("count") >= _least_shared(F.col("n"), share))
    near = written(near.groupBy("cls").agg(F.max(F.struct("count", "lead", "copies")).alias("top")).select("cls", F.col("top.lead").alias("family"), F.col("top.copies").alias("copies")), "near")
    met = written(candidates(docs, held, near.select(F.col("family").alias("a"), F.col("cls").alias("b"), "copies"), sizes, share), "candidates")
    first = written(verified(docs, held, met, sizes, share), "links")
    roots = components(first)
    members = shared.select("cls").distinct().join(sizes, "cls").join(near.select("cls", "family"), "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    linked, comp = F.col("root").isNotNull(), F.coalesce("root", "cls")
    members = members.select("cls", "least", "n", comp.alias("comp"), F.coalesce("root", "family", "cls").alias("team"), linked.alias("linked"))
    second = written(across(docs, held, shared, members, share), "links")
    roots = components(first.unionByName(second))
    named = sizes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("cls", "component_id", "root")
    alone, names = F.col("n") == 0, ["doc_id", F.col("n").alias("n_shingles"), "component_id", *(["key", "root"] if keyed else [])]
    full = own.where(~alone).join(found, "cls").select(*names)
    return full.unionByName(own.where(alone).withColumns({"component_id": F.col("doc_id"), "root": F.col("key")}).select(*names))


def without_near_copies(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the smallest id, and of rows with one id the text with the least hash.

    A text without words is a component of its own, as one with its id and text. Rows without an id stay.
    """
    own = join(docs, share, keyed=True).where(F.col("doc_id") == F.col("component_id"))
    kept = own.groupBy("doc_id", "root").agg(F.min("key").alias("_key"))
    named = docs.withColumn("_key", F.xxhash64("text")).join(kept, ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"])
    return named.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def op7(docs: DataFrame) -> DataFrame:
    return join(docs)
