"""Benchmark decontamination: an inverted index of test items with BM25 impacts, asked with every passage of every document.

Items are cut into units of at most UNIT words. A unit's impacts are its BM25 weights divided by their sum, so a passage that
holds all its words scores 1. Passages are windows of twice UNIT words, one every UNIT, so any stretch of UNIT words lies in
one. Block-max WAND finds every unit that scores THRESHOLD or more: the bound over a passage's distinct terms is taken for all
passages of a chunk at once, and those that may reach the threshold are evaluated document at a time, skipping by the largest
impact of each posting block. A found item is then held against the whole document: both its question and its answer, the
last sentence, must be there in word shingles.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import written

UNIT = 64
THRESHOLD = 0.6
BLOCK = 64  #: postings under one block maximum
RANGES = 64  #: of units, for the bounds that are taken before single passages are asked
SLAB = 1 << 15  #: (passage, term) pairs whose bounds are taken at once
K1, B = 1.2, 0.75
SHINGLE = 5
QUESTION, ANSWER = 0.6, 0.5  #: shares of an item's question and answer shingles that a document holds at least
SHARD = 50_000  #: units that are broadcast at once; more items are asked shard by shard, the documents read once for each


def item_words(text: str) -> tuple[np.ndarray, int]:
    """Word hashes of an item, and where its answer begins: after the last sentence end before the last word."""
    c = next(tk.chunks(pa.array([text])))
    w = tk.words(c, tk.ALNUM)
    if not len(w.hash):
        return w.hash, 0
    last = max(c.buf[: w.start[-1]].tobytes().rfind(x) for x in (b". ", b".\n", b"? ", b"?\n", b"! ", b"!\n", b"\n"))
    return w.hash, int(np.searchsorted(w.start, last, "right")) if last >= 0 else 0


def item_shingles(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingles; fewer words than SHINGLE are one of their own length."""
    width = min(SHINGLE, len(hashes))
    if not width:
        return np.zeros(0, np.uint64)
    h, good = tk.shingles(hashes, np.array([0, len(hashes)]), width)
    return np.unique(h[good])


@dataclass
class Index:
    """Postings of one shard, by term; units are numbered, and impacts are normalised BM25 weights."""

    terms: np.ndarray  #: sorted hashes
    first: np.ndarray  #: first[t] : first[t + 1] are the postings of term t
    unit: np.ndarray
    impact: np.ndarray
    item: np.ndarray  #: of each unit, its item's number
    ids: list[int]  #: of each item
    question: list[np.ndarray]  #: shingles of each item
    answer: list[np.ndarray]
    widths: list[tuple[int, int]]

    def __post_init__(self):
        self.lists: dict[int, tuple] = {}

    @cached_property
    def most(self) -> np.ndarray:
        return np.maximum.reduceat(self.impact, self.first[:-1]) if len(self.terms) else np.zeros(0)

    @cached_property
    def tops(self) -> np.ndarray:
        """The largest impact of each term in each of at most RANGES ranges of units, to bound all passages of a chunk at once."""
        span = max(1, -(-len(self.item) // RANGES))
        out = np.zeros((len(self.terms), max(1, -(-len(self.item) // span))), np.float32)
        np.maximum.at(out, (np.repeat(np.arange(len(self.terms)), np.diff(self.first)), self.unit // span), self.impact)
        return out

    @cached_property
    def sieve(self) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[self.terms >> np.uint64(44)] = True
        return out

    def posting(self, t: int) -> tuple[list, list, list, list]:
        """Units and impacts of a term, and each block's last unit and largest impact; made when a passage first asks for it."""
        if t not in self.lists:
            a, b = int(self.first[t]), int(self.first[t + 1])
            u, w = self.unit[a:b].tolist(), self.impact[a:b].tolist()
            self.lists[t] = (u, w, [u[min(i + BLOCK, len(u)) - 1] for i in range(0, len(u), BLOCK)], [max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)])
        return self.lists[t]

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(unit, score) of every unit that scores the threshold or more for the distinct terms."""
        out, lists = [], [[self.posting(t)[0][0], 0, t] for t in terms]
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return out
            at = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == at:
                pivot += 1
            tight, leave = 0.0, None
            for _, _, t in lists[: pivot + 1]:
                _, _, ends, tops = self.posting(t)
                j = bisect_left(ends, at)
                if j < len(ends):
                    tight += tops[j]
                    leave = ends[j] + 1 if leave is None else min(leave, ends[j] + 1)
            if tight >= threshold:
                if lists[0][0] == at:
                    score = sum(self.posting(t)[1][p] for _, p, t in lists[: pivot + 1])
                    if score >= threshold:
                        out.append((at, score))
                    to = at + 1
                else:
                    to = at
            else:  # no unit up to the nearest block end can reach the threshold with these lists alone
                to = at + 1 if leave is None else leave
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                to = max(to, at + 1)
            kept = []
            for i, x in enumerate(lists):
                if i <= pivot and x[0] < to:
                    units = self.posting(x[2])[0]
                    p = bisect_left(units, to, x[1])
                    if p == len(units):
                        continue
                    x = [units[p], p, x[2]]
                kept.append(x)
            lists = kept
        return out

    def likely(self, window: np.ndarray, term: np.ndarray, bound: np.ndarray, threshold: float) -> list[int]:
        """Windows for which the block maxima of some range of units sum to the threshold; pairs are sorted by window."""
        keep = bound[window] >= threshold
        window, term = window[keep], term[keep]
        first = np.flatnonzero(np.diff(window, prepend=-1))
        out, i = [], 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(first, first[i] + SLAB)))
            end = first[j] if j < len(first) else len(window)
            sums = np.add.reduceat(self.tops[term[first[i] : end]], first[i:j] - first[i], axis=0)
            out += window[first[i:j][sums.max(1) >= threshold - 1e-4]].tolist()
            i = j
        return out

    def passages(self, w: tk.Words, threshold: float) -> dict[tuple[int, int], float]:
        """(text, item) to the largest score of a passage, among those that reach the threshold."""
        near = np.flatnonzero(self.sieve[w.hash >> np.uint64(44)]) if len(self.terms) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, w.hash[near]), max(0, len(self.terms) - 1))
        hit = self.terms[at] == w.hash[near] if len(near) else np.zeros(0, bool)
        place, term = near[hit], at[hit]
        text = np.searchsorted(w.first, place, "right") - 1
        # Window k of a text holds its words from k UNIT on; a word lies in the window of its stretch and in the one before.
        count = np.maximum(1, -(-np.diff(w.first) // UNIT) - 1)
        base = np.cumsum(count) - count
        k = (place - w.first[text]) // UNIT
        here, back = k < count[text], k > 0
        window = np.concatenate([(base[text] + k)[here], (base[text] + k - 1)[back]])
        pairs = np.unique(window * max(1, len(self.terms)) + np.concatenate([term[here], term[back]]))
        window, term = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
        bound = np.bincount(window, self.most[term], int(count.sum())) if len(pairs) else np.zeros(0)
        found: dict[tuple[int, int], float] = {}
        for v in self.likely(window, term, bound, threshold):
            a, b = np.searchsorted(window, [v, v + 1])
            d = int(np.searchsorted(base, v, "right")) - 1
            for unit, score in self.wand(term[a:b].tolist(), threshold):
                key = (d, int(self.item[unit]))
                found[key] = max(score, found.get(key, 0.0))
        return found

    def overlaps(self, item: int, hashes: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question and answer shingles among a document's words; an item without an answer has its question for one."""
        out = []
        for own, width in ((self.question[item], self.widths[item][0]), (self.answer[item], self.widths[item][1])):
            if not len(own):
                continue
            h, good = tk.shingles(hashes, np.array([0, len(hashes)]), width)
            out.append(float(np.isin(own, h[good]).mean()))
        return out[0], out[-1]


def units(items: DataFrame) -> DataFrame:
    """(key, item_id, text, unit, size, term, times) of every unit, text on an item's first; items without words have none."""

    def cut(batches):
        for batch in batches:
            rows = []
            for key, i, text in zip(*(batch.column(k).to_pylist() for k in ("key", "item_id", "text")), strict=True):
                hashes, _ = item_words(text or "")
                for k in range(0, len(hashes), UNIT):
                    term, times = np.unique(hashes[k : k + UNIT], return_counts=True)
                    rows.append((key, i, None if k else text, k // UNIT, len(hashes[k : k + UNIT]), term.view(np.int64).tolist(), times.tolist()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "item_id", "text", "unit", "size", "term", "times"])

    own = items.select("item_id", "text").dropDuplicates().withColumn("key", F.monotonically_increasing_id())
    return own.mapInArrow(cut, "key long, item_id long, text string, unit int, size int, term array<long>, times array<long>")


def _built(rows: pa.Table, n: int, mean: float) -> Index:
    """The index of a shard's units, which are in the order of their items."""
    size = rows["size"].to_numpy().astype(float)
    lists = rows["terms"].combine_chunks()
    unit = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
    term, times, df = (lists.flatten().field(k).to_numpy() for k in ("t", "times", "df"))
    weight = np.log1p((n - df + 0.5) / (df + 0.5)) * times * (K1 + 1) / (times + K1 * (1 - B + B * size[unit] / mean))
    weight /= np.bincount(unit, weight)[unit]
    order = np.lexsort((unit, term.view(np.uint64)))
    terms, first = np.unique(term.view(np.uint64)[order], return_index=True)
    first_unit = rows["unit"].to_numpy() == 0
    ids, question, answer, widths = rows["item_id"].filter(pa.array(first_unit)).to_pylist(), [], [], []
    for text in rows["text"].filter(pa.array(first_unit)).to_pylist():
        h, a = item_words(text)
        question.append(item_shingles(h[:a] if a else h))
        answer.append(item_shingles(h[a:] if a else h[:0]))
        widths.append((min(SHINGLE, a or len(h)), min(SHINGLE, len(h) - a)))
    return Index(terms, np.append(first, len(term)), unit[order].astype(np.int32), weight[order], np.cumsum(first_unit) - 1, ids, question, answer, widths)


def index_shards(items: DataFrame, shard: int = SHARD) -> Iterator[Index]:
    """An Index for each part of the items; document frequencies and the mean length are of all items.

    A shard of about that many units is built in one task and comes to the driver as arrays, for a broadcast, when it is its turn.
    """
    own = written(units(items), "units")
    n, mean = own.agg(F.count("*"), F.avg("size")).first()
    if not n:
        return
    shards = -(-n // shard)
    df = own.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    flat = own.select("key", "unit", F.explode(F.arrays_zip("term", "times")).alias("z")).select("key", "unit", F.col("z.term").alias("t"), F.col("z.times").alias("times"))
    full = flat.join(df, "t").groupBy("key", "unit").agg(F.sort_array(F.collect_list(F.struct("t", "times", "df"))).alias("terms"))
    full = own.select("key", "item_id", "text", "unit", "size").join(full, ["key", "unit"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))

    def built(batches):
        shard, held = None, []

        def done():
            index = _built(pa.Table.from_batches(held), n, mean)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([pickle.dumps(index)], pa.binary())], ["shard", "index"])

        for batch in batches:
            own = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(own, prepend=own[:1] - 1))
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
                if held and own[i] != shard:
                    yield done()
                shard = int(own[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield done()

    made = written(full.repartition("shard").sortWithinPartitions("shard", "item_id", "key", "unit").mapInArrow(built, "shard long, index binary"), "index")
    for s in sorted(r["shard"] for r in made.select("shard").collect()):
        yield pickle.loads(made.where(F.col("shard") == s).first()["index"])


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document that holds an item, once for each item.

    Null texts are empty; an item without words is held by none; one without a sentence end is all question. Equal rows of docs
    give equal rows, items with one id and different texts a row each; a score ties with none, as all that reach the threshold count. A text is taken whole,
    whatever its length. An empty table on either side gives no rows. Extra columns are left out. Several shards are asked one after
    the other, and what each finds is written.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out, last = None, None
    for index in index_shards(items):
        if last:  # another shard follows: its answers are written, so that one index is held at a time
            out = _and(out, written(last[0], "matches"))
            last[1].destroy()
        held = docs.sparkSession.sparkContext.broadcast(index)

        def asked(batches, held=held):
            index = held.value
            for batch in batches:
                ids, rows = batch.column("doc_id"), []
                for c in tk.chunks(batch.column("text")):
                    w = tk.words(c, tk.ALNUM)
                    for (d, item), score in sorted(index.passages(w, threshold).items()):
                        q, a = index.overlaps(item, w.hash[w.first[d] : w.first[d + 1]])
                        if q >= question and a >= answer:
                            rows.append((ids[c.row + d].as_py(), index.ids[item], score, q, a))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

        last = docs.select("doc_id", "text").mapInArrow(asked, schema), held
    return _and(out, last[0]) if last else docs.sparkSession.createDataFrame([], schema)


def _and(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item; see matches. Shards are asked one after the other."""

    def asked(held: Broadcast) -> Column:
        def holds(column: pa.Array) -> pa.Array:
            index, out = held.value, np.zeros(len(column), bool)
            for c in tk.chunks(column):
                w = tk.words(c, tk.ALNUM)
                for d, item in index.passages(w, threshold):
                    if not out[c.row + d]:
                        q, a = index.overlaps(item, w.hash[w.first[d] : w.first[d + 1]])
                        out[c.row + d] = q >= question and a >= answer
            return pa.array(out)

        return F.arrow_udf(holds, "boolean")(F.col(text))

    held = None
    for index in index_shards(items):
        if held:
            docs = written(docs, "documents")
            held.destroy()
        held = items.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(~asked(held))
    return docs


def op1(docs: DataFrame, items: DataFrame) -> DataFrame:
    return matches(docs, items)
