"""Whitening, ranked search and sharding against numpy, SQL and plain loops."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terraza.llm import queries, ranked, sharding
from terraza.llm import whitening as wh

DATA = "/root/testdata/sf0.001"


# Whitening


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_secular_roots_are_the_eigenvalues(size):
    rng = np.random.default_rng(size)
    for poles in (np.sort(rng.uniform(0, 1e6, size)), np.sort(rng.uniform(1, 1.001, size)), 10.0 ** np.arange(-size // 2, -size // 2 + size)):
        z = rng.normal(size=size) * np.sqrt(poles.max()) * 10.0 ** rng.uniform(-6, 0, size)
        values, vectors = wh.rank_one(poles, np.eye(size), z)
        want = np.diag(poles) + np.outer(z, z)
        assert np.allclose(values, np.linalg.eigvalsh(want), rtol=0, atol=1e-13 * np.abs(want).max() * size)
        assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13 * size and np.abs(vectors * values @ vectors.T - want).max() < 1e-13 * size * np.abs(want).max()


def test_equal_eigenvalues_and_empty_parts_are_deflated():
    values, vectors = np.array([0.0, 0, 0, 2, 2, 5]), np.linalg.qr(np.random.default_rng(0).normal(size=(6, 6)))[0]
    for z in (np.ones(6), vectors[:, 3] * 4, np.zeros(6), vectors[:, 5] - vectors[:, 0]):
        got, turned = wh.rank_one(values, vectors, z)
        want = vectors * values @ vectors.T + np.outer(z, z)
        assert np.abs(turned * got @ turned.T - want).max() < 1e-12 and np.abs(turned.T @ turned - np.eye(6)).max() < 1e-13 and (np.diff(got) >= 0).all()


def test_spectra_of_parts_combine_to_that_of_all():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(500, 12)) * 300 * np.linspace(0.1, 3, 12)).astype(np.int64) + 100000
    x[100:300] = x[7]  # copies
    parts = []
    for part in (x[:1], x[1:9], x[9:310], x[310:]):
        s = wh.Spectrum(12)
        for i in range(0, len(part), 5 if len(part) < 20 else 60):
            s.take(part[i : i + (5 if len(part) < 20 else 60)])
        parts.append(s)
    whole = parts[2]
    for s in (parts[0], parts[3], parts[1], wh.Spectrum(12)):
        whole.merge(s)
    scatter = np.cov(x.T, bias=True) * len(x)
    assert whole.n == len(x) and whole.sums.tolist() == x.sum(0).tolist()
    assert np.abs(whole.vectors * whole.values @ whole.vectors.T - scatter).max() < 1e-12 * scatter.max() * len(x)


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[2**61, -5], [1, 2**40], [3, 3]])
    sums = wh.exact_sums(x)
    assert sums.tolist() == [2**61 + 4, 2**40 - 2]
    assert wh.deviations(x, 3, sums)[1] == [None, None, None] and wh.deviations(x[1:], 2, wh.exact_sums(x[1:]))[1] == [None, None]
    y = np.array([[10**9, 5], [7, 2]])
    assert list(wh.deviations(y, 2, wh.exact_sums(y))[1]) == [(10**9 - 7) ** 2 + 9] * 2


def plain_whitening(x):
    v = np.cov(x.T.astype(float), bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return (x - x.mean(0)) @ vectors / np.sqrt(values), values / np.trace(v), ((len(x) * x - x.sum(0)) ** 2).sum(1)


def test_op11(spark):
    own = spark.read.parquet(f"{DATA}/embeddings.parquet").repartition(9)
    odd = spark.createDataFrame([(9001, None, 1), (9002, [1.0, None] * 32, 1), (9003, [float("nan")] * 64, 1), (9004, [float("inf")] * 64, 1), (9005, [], 1), (None, [0.5] * 64, 1), (7, [0.25] * 64, 1)], own.schema)
    got = wh.op11(own.unionByName(odd).withColumn("whitened", F.lit("x"))).toPandas()
    rows = own.orderBy("vec_id").toPandas()
    x = np.floor(np.stack([*rows["embedding"], np.full(64, 0.5), np.full(64, 0.25)]).astype(float) * 1024).astype(np.int64) + 100000
    want, shares, deviation = plain_whitening(x)
    assert len(got) == 8 * len(x) and set(got["n"]) == {len(x)} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    for c, part in got.groupby("component"):
        part = part[part["vec_id"].notna() & (part["vec_id"] != 7)].sort_values("vec_id")
        keep = rows["vec_id"].to_numpy() != 7
        w, d = want[:-2, c - 1][keep], deviation[:-2][keep]
        assert np.abs(part["whitened"].to_numpy() * np.sign(w @ part["whitened"].to_numpy()) - w).max() < 1e-8 and (part["deviation"].to_numpy() == d).all() and np.allclose(part["explained"], shares[c - 1], rtol=1e-10)


def test_op11_of_few_and_uneven_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert wh.op11(spark.createDataFrame([], schema)).count() == 0 and wh.op11(spark.createDataFrame([(1, None)], schema)).count() == 0
    got = {(r["vec_id"], r["component"]): r for r in wh.op11(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0]), (4, [1e30, 0.0, 1.0])], schema)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (4, 2), (4, 3)}  # lengths are spaces of their own
    assert abs(got[1, 1]["whitened"]) == pytest.approx(1) and got[1, 2]["whitened"] is None and got[1, 1]["explained"] == pytest.approx(1) and got[3, 1]["whitened"] is None and got[3, 1]["n"] == 1 and got[4, 1]["deviation"] == 0


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranks(docs, items, k=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    df, n, length = Counter(t for _, c in own for t in c), sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_ranks_are_those_of_exhaustive_scoring(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["the", "de", "Ñu", "x1", "漢字", *(f"w{i}" for i in range(60))]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    some = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    docs = [(i, some(int(rng.integers(1, 60)))) for i in range(300)] + [(i, "the w50, w51. THE-w50") for i in range(400, 440)] + [(500, None), (501, ""), (502, " !?"), (None, some(30)), (7, some(20)), (600, some(20000))]
    items = [(i, some(int(rng.integers(1, 30)))) for i in range(40)] + [(90, "w50 w51 w50"), (91, None), (92, "nothing here"), (93, "w50 the"), (93, "w50 the"), (None, "de x1")]
    own = spark.createDataFrame(docs, "doc_id long, text string").repartition(40).withColumn("score", F.lit(1))  # blocks enough for seeds
    got = ranked.search(own, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)))
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_ranks(docs, items)
    got = ranked.search(own.repartition(2), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranks(docs, items, 3)


def test_every_threshold_finds_all_documents_above_it(spark):
    """One block asked with floors of every height: intersection lists alone, with single terms, or all."""
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(f"t{t}" for t in rng.zipf(1.3, 25) if t < 400)) for i in range(500)]
    items = [(i, " ".join(f"t{t}" for t in rng.zipf(1.2, 14) if t < 400)) for i in range(30)]
    (q,) = ranked.questions(spark.createDataFrame(items, "item_id long, text string"))
    table = ranked.blocks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), q.terms)
    n, words = table.agg(F.sum("texts"), F.sum("words")).first()
    (row,) = [r.asDict() for r in table.collect()]
    df = np.zeros(len(q.terms), np.int64)
    df[row["dfs_term"]] = row["dfs"]
    q.paired(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]))
    block = ranked.Block(row, q, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]), n, words)
    half_only = 0
    for i in range(len(q.key)):
        all_docs, all_scores = block.search(i, 1)
        by = dict(zip(block.ids[all_docs].tolist(), all_scores.tolist(), strict=True))
        want = {d: s for _, _, d, s in plain_ranks(docs, [next(x for x in items if x[0] == q.item[i])], 10**6)}
        assert by == want and block.totals()[i] >= max(by.values(), default=0)
        for least in sorted(set(by.values()))[:: max(1, len(by) // 12)] + [max(by.values(), default=0) + 1]:
            found, got = block.search(i, least)
            assert dict(zip(block.ids[found].tolist(), got.tolist(), strict=True)) == {d: s for d, s in by.items() if s >= least}
            pairs = q.pair[q.first_pair[i] : q.first_pair[i + 1]]
            half_only += block.single[pairs].sum() < least <= block.totals()[i]
    assert half_only > 3  # floors at which only documents with both terms of some pair can do
    assert (block.joint < block.most[q.pairs[:, 0]] * q.pairs[:, 1] + block.most[q.pairs[:, 2]] * q.pairs[:, 3]).sum() > 20  # pairs whose terms' maxima never meet


def test_op12_on_the_given_tables(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ranked.SQL).df()
    got = queries.op12_ranked_search(spark, DATA).toPandas()
    assert sorted(map(tuple, got[["item_id", "rank", "doc_id", "score"]].values.tolist())) == sorted(map(tuple, want[["item_id", "rank", "doc_id", "score"]].values.tolist())) and len(got) > 500


def test_search_without_documents_or_items(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs.where("false"), items).count() == 0 and ranked.search(docs, items.where("false")).count() == 0 and ranked.search(docs, items.withColumn("text", F.lit("..."))).count() == 0


# Shards


def shards(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    for own in out.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return out


def test_op13(spark):
    own = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "no id"), (9003, "é漢"), (9003, "é漢"), (9003, "é漢")], "doc_id long, text string")
    rows = own.unionByName(odd).withColumn("shard", F.lit(5)).repartition(5)
    texts = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows.collect()), key=str)
    got = sharding.op13(rows).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == texts and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    sums = [sum(r["size"] for r in own) for own in shards(got).values()]
    assert len(sums) == 16 and max(sums) - min(sums) <= max(r["size"] for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 9003}) == 1  # equal texts


def test_a_hot_group_is_cut_and_small_ones_are_not(spark):
    """A third of all rows are one text, and some rows are the same in all columns; small groups stay whole."""
    rng = np.random.default_rng(1)
    rows = [(i, 1, 40) for i in range(4000)] + [(77, 2, 40)] * 2000 + [(10000 + i, 3 + i // 4, int(rng.integers(1, 200))) for i in range(6000)]
    df = spark.createDataFrame(rows, "i long, g long, s long").repartition(8)
    got = shards(sharding.assign(df, F.xxhash64("g"), F.col("i"), F.col("s"), keep=("i", "g")).collect())
    sums = {k: sum(r["size"] for r in own) for k, own in got.items()}
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 2 * sum(sums.values()) / 16 / 64 + 200
    where = defaultdict(set)
    for k, own in got.items():
        for r in own:
            where[r["g"]].add(k)
    assert len(where[1]) > 3 and sum(len(w) > 1 for g, w in where.items() if g > 2) == 0


def test_rows_law_and_few_rows(spark):
    df = spark.range(1003).select(F.col("id").alias("i"), (F.col("id") * 7 % 5000).alias("s"))
    counts = [len(own) for own in shards(sharding.assign(df, F.xxhash64("i"), F.col("i"), F.col("s"), law="rows").collect()).values()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1
    assert len(shards(sharding.assign(df.limit(5), F.xxhash64("i"), F.col("i"), F.col("s"), law="rows").collect())) == 5
    assert sharding.assign(df.where("false"), F.xxhash64("i"), F.col("i"), F.col("s")).count() == 0
    assert len(sharding.assign(df.limit(3).withColumn("s", F.lit(0)), F.xxhash64("i"), F.col("i"), F.col("s")).collect()) == 3


def test_ranges_are_cut_until_none_is_overfull(spark):
    """All rows of one group, one of them as large as all others: ranges hold no more than a few times their share of rows."""
    df = spark.range(20000).select(F.lit(5).cast("long").alias("_group"), F.lit(1).cast("long").alias("_id"), F.xxhash64("id").alias("_salt"), F.when(F.col("id") == 9, 20000).otherwise(1).cast("long").alias("size"))
    placed, sums, total, largest = sharding.ranged(sharding.written(df, "keys"), F.col("size"), 4, 1000)
    assert (total, largest, sum(n for n, _ in sums.values())) == (39999, 20000, 20000) and max(n for n, _ in sums.values()) <= 20000 / 32 * 2.5 * 2 and placed.count() == 20000
