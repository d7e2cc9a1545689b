"""Ranked lexical search: every item's best documents, by MaxScore with bounds on pairs of terms.

Documents are cut into blocks, each an inverted index of the terms that items ask for. An item's terms are paired, the heaviest
with each other. For every pair a block's index holds the intersection list, the documents with both terms, and its joint maximum
impact: no document gets more from the pair than the joint maximum if it has both terms, or than the larger single maximum if it
has one. Where two rare terms never meet, that is the larger of two maxima and not their sum, so the bounds of all pairs together
are far below those of independent terms. With the score that an item's k-th best document has so far, they say which blocks
cannot matter, of which pairs only the intersection list has to be read, and which few terms' own lists have to be read; the other
terms are looked up for the documents found, pair by pair, and those that can no longer reach the k-th score go.

One block in SEEDS is asked first, and the k-th scores found there are where all blocks start from, in every task; they are scores
of real documents, so nothing is lost. Each task gives k documents an item at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.sources.scratch import path

from . import textkit as tk
from .shared import written

TOP = 20
SHARD = 1 << 20  #: distinct terms of items, counted for each item, that are broadcast at once; more are asked shard by shard
POSTINGS = 1 << 21  #: of a block at most, unless one chunk of texts has more
DOCUMENTS = 1 << 16  #: of a block at most
LISTED = 1 << 12  #: documents of an intersection list at most; a longer one is known by its joint maximum alone
PROBES = 1 << 22  #: lookups that intersections are taken by at once
SEEDS = 32


def counted(c: tk.Chunk, terms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of a chunk's distinct terms, or of the numbers of those among terms, and each text's count of words."""
    w = tk.words(c, tk.ALNUM)
    doc, term = w.doc, w.hash
    if terms is not None:
        sieve = np.zeros(1 << 20, bool)
        sieve[terms >> np.uint64(44)] = True
        near = np.flatnonzero(sieve[term >> np.uint64(44)])
        at = np.minimum(np.searchsorted(terms, term[near]), max(0, len(terms) - 1))
        hit = terms[at] == term[near] if len(terms) else np.zeros(0, bool)
        doc, term = doc[near[hit]], at[hit]
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], term[first], np.diff(np.append(first, len(doc))), np.diff(w.first)


@dataclass
class Questions:
    """A shard of items: their terms by number, and the pairs that their terms make."""

    key: np.ndarray
    item: list[int | None]
    terms: np.ndarray  #: sorted hashes
    first: np.ndarray  #: of each item in term and times
    term: np.ndarray
    times: np.ndarray

    def paired(self, weight: np.ndarray) -> None:
        """Pairs each item's terms by falling weight; a last one without another is alone."""
        a, b, owner = [], [], []
        for q in range(len(self.key)):
            own = slice(self.first[q], self.first[q + 1])
            by = self.first[q] + np.lexsort((self.term[own], -weight[self.term[own]]))
            a.append(by[::2])
            b.append(np.append(by[1::2], -1) if len(by) % 2 else by[1::2])
            owner.append(np.full(len(a[-1]), q))
        a, b, self.owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, owner))
        alone = b < 0
        rows = np.stack([self.term[a], self.times[a], np.where(alone, -1, self.term[b]), np.where(alone, 0, self.times[b])], 1) if len(a) else np.zeros((0, 4), np.int64)
        # Pairs that several items ask for, with the same repeats, are held once.
        self.pairs, self.pair = np.unique(rows, axis=0, return_inverse=True)
        self.pair = self.pair.ravel()
        self.first_pair = np.searchsorted(self.owner, np.arange(len(self.key) + 1))


def questions(items: DataFrame, shard: int = SHARD) -> Iterator[Questions]:
    """The items with terms, in shards of about that many terms; each row is an item of its own."""

    def cut(batches):
        for batch in batches:
            out = []
            for c in tk.chunks(batch.column("text")):
                doc, term, times, _ = counted(c)
                at = np.searchsorted(doc, np.arange(len(c) + 1))
                for d in range(len(c)):
                    if at[d + 1] > at[d]:
                        own = slice(at[d], at[d + 1])
                        out.append((batch.column("key")[c.row + d].as_py(), batch.column("item_id")[c.row + d].as_py(), term[own].view(np.int64), times[own]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "item_id", "term", "times"])

    own = items.select("item_id", "text").withColumn("key", F.monotonically_increasing_id()).mapInArrow(cut, "key long, item_id long, term array<long>, times array<long>")
    own = written(own, "questions")
    total = own.agg(F.coalesce(F.sum(F.size("term")), F.lit(0))).first()[0]
    shards = -(-total // shard)
    for s in range(shards):
        rows = own.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == s).orderBy("key").toArrow()
        if len(rows):
            lists = rows["term"].combine_chunks()
            terms, number = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            yield Questions(rows["key"].to_numpy(), rows["item_id"].to_pylist(), terms, first, number, rows["times"].combine_chunks().flatten().to_numpy())


def blocks(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """A written table of blocks: ids and words of the documents with a term, their postings, and each term's documents; seed marks one in SEEDS."""
    names = ["block", "seed", "texts", "words", "ids", "known", "sizes", "doc", "term", "times", "dfs_term", "dfs"]
    schema = "block long, seed boolean, texts long, words long, ids binary, known binary, sizes binary, doc binary, term binary, times binary, dfs_term array<int>, dfs array<int>"
    held_terms = docs.sparkSession.sparkContext.broadcast(terms)

    def cut(batches):
        from pyspark import TaskContext

        own, block, held, texts, words, count = held_terms.value, TaskContext.get().partitionId() << 33, [], 0, 0, 0

        def done():
            nonlocal block, held, texts, words, count
            ids, known, sizes, doc, term, times = (np.concatenate([h[k] for h in held]) for k in range(6)) if held else (np.zeros(0, t) for t in (np.int64, bool, np.int64, np.int32, np.int32, np.int64))
            order = np.argsort(term, kind="stable")
            n = np.bincount(term, minlength=1)
            there = np.flatnonzero(n)
            seed = int(tk.mix(np.array([block], np.uint64))[0] % np.uint64(SEEDS)) == 0
            row = [block, seed, texts, words, *(x.tobytes() for x in (ids, known, sizes, doc[order], term[order], times[order])), there, n[there]]
            block, held, texts, words, count = block + 1, [], 0, 0, 0
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        docs_held = 0
        for batch in batches:
            ids = batch.column("doc_id")
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for c in tk.chunks(batch.column("text")):
                doc, term, times, sizes = counted(c, own)
                if held and (count + len(doc) > POSTINGS or docs_held + len(c) > DOCUMENTS):
                    yield done()
                    docs_held = 0
                texts, words = texts + int((sizes > 0).sum()), words + int(sizes.sum())
                rows, number = np.unique(doc, return_inverse=True)
                held.append((ids[c.row + rows], known[c.row + rows], sizes[rows].astype(np.int64), (docs_held + number).astype(np.int32), term.astype(np.int32), times.astype(np.int64)))
                docs_held, count = docs_held + len(rows), count + len(doc)
        yield done()

    to = path(docs.sparkSession, "blocks")
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema).write.partitionBy("seed").parquet(to)
    return docs.sparkSession.read.schema(schema).parquet(to)


class Block:
    """The index of one block, for one shard of items."""

    def __init__(self, row: dict, q: Questions, weight: np.ndarray, texts: int, words: int):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.known, sizes = read("ids", np.int64), read("known", bool), read("sizes", np.int64)
        self.doc, term, times = read("doc", np.int32), read("term", np.int32), read("times", np.int64)
        m = 75 + 25 * sizes * texts // max(1, words)
        self.impact = weight[term] * (1_000_000_000 * times // (1000 * times + 12 * m[self.doc]))
        self.first = np.searchsorted(term, np.arange(len(q.terms) + 1))
        self.key = term.astype(np.int64) * max(1, len(self.ids)) + self.doc
        self.most = np.zeros(len(q.terms) + 1, np.int64)  # the last is for pairs of one
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact, self.first[held])
        self.q = q
        self._pairs()

    def _pairs(self) -> None:
        """Single and joint maxima of all pairs, and their intersection lists."""
        a, ta, b, tb = self.q.pairs.T
        self.single = np.maximum(self.most[a] * ta, self.most[b] * tb)
        self.joint, size = np.zeros(len(a), np.int64), np.append(np.diff(self.first), 0)
        self.listed = np.ones(len(a), bool)
        swap = size[b] < size[a]
        probe, times_p, other, times_o = np.where(swap, b, a), np.where(swap, tb, ta), np.where(swap, a, b), np.where(swap, ta, tb)
        count = np.where(b < 0, 0, size[probe])
        ends, n = np.cumsum(count), max(1, len(self.ids))
        at, docs, bounds = 0, [], np.zeros(len(a) + 1, np.int64)
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PROBES, "right")))
            own = np.repeat(np.arange(at, to), count[at:to])
            place = self.first[probe[own]] + np.arange(len(own)) - np.repeat(ends[at:to] - count[at:to] - (ends[at - 1] if at else 0), count[at:to])
            want = other[own] * n + self.doc[place]
            hit = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
            met = np.flatnonzero(self.key[hit] == want) if len(own) else np.zeros(0, np.int64)
            both = self.impact[place[met]] * times_p[own[met]] + self.impact[hit[met]] * times_o[own[met]]
            np.maximum.at(self.joint, own[met], both)
            found = np.bincount(own[met] - at, minlength=to - at)
            self.listed[at:to] = found <= LISTED
            docs.append(self.doc[place[met]][self.listed[own[met]]])
            bounds[at + 1 : to + 1] = np.where(self.listed[at:to], found, 0)
            at = to
        self.bounds = np.cumsum(bounds)
        self.lists = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        self.most_of = np.maximum(self.single, self.joint)

    def totals(self) -> np.ndarray:
        """What no document gets more than, for each item."""
        return np.bincount(self.q.owner, self.most_of[self.q.pair].astype(float), len(self.q.key)).astype(np.int64) if len(self.q.owner) else np.zeros(len(self.q.key), np.int64)

    def search(self, item: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that score least or more."""
        pairs = self.q.pair[self.q.first_pair[item] : self.q.first_pair[item + 1]]
        pairs = pairs[self.most_of[pairs] > 0]
        most, single = self.most_of[pairs], np.where(self.listed[pairs], self.single[pairs], self.most_of[pairs])
        # Documents in no list that is read are bounded: first intersection lists are read, those that tell most, then whole terms.
        gain = np.argsort(single - most, kind="stable")
        left = most.sum() - np.cumsum((most - single)[gain])
        n = 1 + int(np.argmax(left < least)) if len(left) and (left < least).any() else len(gain)
        half, full = gain[:n], np.zeros(0, np.int64)
        if not len(left) or left[n - 1] >= least:
            heavy = np.argsort(-single, kind="stable")
            rest = single.sum() - np.cumsum(single[heavy])
            full = heavy[: 1 + int(np.argmax(rest < least))]
            half = np.setdiff1d(half, full)
        score = np.zeros(len(self.ids), np.int64)
        for p in pairs[full]:
            for t, times in ((self.q.pairs[p][0], self.q.pairs[p][1]), (self.q.pairs[p][2], self.q.pairs[p][3])):
                if t >= 0:
                    own = slice(self.first[t], self.first[t + 1])
                    score[self.doc[own]] += self.impact[own] * times
        found = np.flatnonzero(score)
        lists = [self.lists[self.bounds[p] : self.bounds[p + 1]] for p in pairs[half] if self.listed[p]]
        if lists:
            found = np.union1d(found, np.concatenate(lists))
        got = score[found]
        others = np.setdiff1d(np.arange(len(pairs)), full)
        others = others[np.argsort(-most[others], kind="stable")]
        rest = most[others].sum()
        for u in others:
            good = got + rest >= least
            found, got = found[good], got[good]
            if not len(found):
                break
            a, ta, b, tb = self.q.pairs[pairs[u]]
            for t, times in ((a, ta), (b, tb)):
                lo, hi = (self.first[t], self.first[t + 1]) if t >= 0 else (0, 0)
                if hi > lo:
                    at = lo + np.minimum(np.searchsorted(self.doc[lo:hi], found), hi - lo - 1)
                    got = got + np.where(self.doc[at] == found, self.impact[at] * times, 0)
            rest -= most[u]
        good = got >= least
        return found[good], got[good]


def best(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by falling score, then rising id, null ids last."""
    return np.lexsort((ids, ~known, -scores))[:k]


def asked(table: DataFrame, q: Questions, weight: np.ndarray, texts: int, words: int, floors: np.ndarray, k: int) -> DataFrame:
    """(key, item_id, doc_id, score) of the k best documents of each item in each task, of those that score its floor or more."""
    held = table.sparkSession.sparkContext.broadcast((q, weight, floors))

    def ask(batches):
        q, weight, floors = held.value
        least, top = floors.copy(), {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, q, weight, texts, words)
                for i in np.flatnonzero(block.totals() >= least).tolist():
                    found, got = block.search(i, int(least[i]))
                    if len(found):
                        ids, known, scores = (np.concatenate(x) for x in zip(top.get(i) or (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)), (block.ids[found], block.known[found], got), strict=True))
                        keep = best(ids, known, scores, k)
                        top[i] = ids[keep], known[keep], scores[keep]
                        if len(keep) == k:
                            least[i] = max(least[i], int(scores[keep[-1]]))
        if top:
            size = [len(x[0]) for x in top.values()]
            ids, known, scores = (np.concatenate(x) for x in zip(*top.values(), strict=True))
            rows = [np.repeat(q.key[list(top)], size), np.repeat(np.array([-1 if q.item[i] is None else q.item[i] for i in top]), size), ids, scores]
            masks = [None, np.repeat(np.array([q.item[i] is None for i in top]), size), ~known, None]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64(), mask=m) for x, m in zip(rows, masks, strict=True)], ["key", "item_id", "doc_id", "score"])

    return table.select("ids", "known", "sizes", "doc", "term", "times").mapInArrow(ask, "key long, item_id long, doc_id long, score long")


def ranks(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A to Z lower-cased; scores are integers, as
    op12's contract says. A null text has no terms and is no document; an item without terms has no rows. Each row of items is an
    item, so a repeated one has its rows repeated; each row of docs is a document, so equal rows have ranks of their own; equal
    scores are by rising id, null ids last. Texts are taken whole, whatever their length; two terms are taken for one if their 64-bit
    hashes are equal. An empty table on either side gives no rows; extra columns are left out.
    """
    spark, out = docs.sparkSession, None
    for q in questions(items):
        table = blocks(docs, q.terms)
        texts, words = table.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        df = np.zeros(len(q.terms), np.int64)
        pairs = table.select(F.explode(F.arrays_zip("dfs_term", "dfs")).alias("z")).groupBy(F.col("z.dfs_term").alias("t")).agg(F.sum("z.dfs").alias("n")).toArrow()
        df[pairs["t"].to_numpy()] = pairs["n"].to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        q.paired(weight)
        floors = np.ones(len(q.key), np.int64)
        seeds = ranks(asked(table.where("seed"), q, weight, texts, words, floors, k), k).where(F.col("rank") == k).select("key", "score").toArrow()
        floors[np.searchsorted(q.key, seeds["key"].to_numpy())] = seeds["score"].to_numpy()
        found = ranks(asked(table, q, weight, texts, words, floors, k), k).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


#: The same rows by exhaustive scoring.
SQL = r"""WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY doc_id, term
), weight AS (SELECT term, CAST(floor(1000 * ln((2e0 * (SELECT docs FROM whole) + 2) / (2e0 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term
), scores AS (
  SELECT a.item_id, t.doc_id, CAST(sum(a.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * s.n * (SELECT docs FROM whole)) // (SELECT len FROM whole))))) AS BIGINT) AS score
  FROM asked a JOIN tf t USING (term) JOIN weight w USING (term) JOIN sizes s ON s.doc_id = t.doc_id GROUP BY a.item_id, t.doc_id
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
