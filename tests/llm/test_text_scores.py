"""Quality, language, toxicity and licences on small tables."""

import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraza.llm import language, licences, quality, queries, toxicity
from terraza.llm import textkit as tk

DATA = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"  #: where a held-out fold has enough rows of the rarer class
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "ok ok"), (4, "ok ok"), (None, "no id"), (5, "é漢字 " * 20000), (6, "12 34!")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("x"), "predicted": F.lit(1), "lang": F.lit(None).cast("string"), "labels": F.lit(0)})


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abZ9 é漢\n\t.,-", max_size=40), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for kind, pattern in ((tk.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (tk.NON_BLANK, rb"[^\x20\x09-\x0D]+")):
        got = []
        for c in tk.chunks(pa.array(texts, pa.string()), 16):
            w = tk.words(c, kind)
            low = tk.LOWER[c.buf].tobytes()
            got += [[low[a:b] for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == [re.findall(pattern, t.encode().translate(bytes(tk.LOWER))) for t in texts]


def test_equal_words_have_equal_hashes_anywhere():
    c = next(tk.chunks(pa.array(["Ab x ab", "aB"])))
    w = tk.words(c, tk.ALNUM)
    assert w.hash[0] == w.hash[2] == w.hash[3] != w.hash[1]


def test_chunks_of_fewer_words_than_a_shingle():
    for text in ("", "a", "a b c"):
        c = next(tk.chunks(pa.array([text, None])))
        assert [len(x) for x in tk.shingle_sets(c, 5)] == [min(1, len(text)), 0]


def test_toxicity_is_found_on_held_out_rows(spark):
    out = queries.op10_toxicity(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").toPandas()
    assert (out.held_out == [held_out(i, 3, 1) for i in out.doc_id]).all() and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.7)).all()
    own = out[out.held_out]
    assert (own.predicted == own.toxic).mean() > 0.97


def test_pairs_of_terms_count():
    rows, y = [[0], [1], [0, 1], [2], [0, 2], [1, 2]] * 60, np.array([0, 0, 1, 0, 0, 0] * 60, float)
    b, w, v = toxicity.fit_machine([np.array(r) for r in rows], y, 3, epochs=300)
    z = [b + w[r].sum() + sum(v[i] @ v[j] for k, i in enumerate(r) for j in r[:k]) for r in rows[:6]]
    assert z[2] > 0 and max(z[:2] + z[3:]) < 0


def test_terms_that_matter_only_together_are_learned(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(1600):
        kind = i // 2 % 4  # either term is in half of the toxic and half of the clean rows
        words = [f"w{k}" for k in rng.choice(300, 25, replace=False)] + [["groupname", "mild"], ["insult"], ["groupname"], ["mild"]][kind]
        rows.append((i, " ".join(rng.permutation(words).tolist()), int(kind < 2), kind))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, kind int")
    out = toxicity.op10(df.select("doc_id", "text"), df.select("doc_id", "toxic")).join(df.select("doc_id", "toxic", "kind"), "doc_id").toPandas()
    own = out[out.held_out]
    assert (own.predicted == own.toxic)[own.kind == 0].mean() > 0.9 and (own.predicted == own.toxic).mean() > 0.9


def test_a_term_of_few_toxic_rows_and_no_clean_one_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([f"w{k}" for k in rng.choice(300, 25, replace=False)] + (["insult"] if i % 2 else []) + (["slur"] if i % 100 == 1 else [])), i % 2) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(df, df)
    assert 5 <= sum(1 for i, t, _ in rows if "slur" in t and not held_out(i, 3, 1)) <= 12
    w = machine.w[machine.place[toxicity.hashed(toxicity.doc_terms(next(tk.chunks(pa.array(["slur"]))))[0])]]
    assert len(w) and w[0] > 0.1


def test_quality_is_found_on_held_out_rows(spark):
    out = queries.op2_quality(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").toPandas()
    own = out[out.held_out]
    assert (out.held_out == [held_out(i, 5, 0) for i in out.doc_id]).all() and (own.predicted == own.quality).mean() > 0.95


def test_language_is_found_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = queries.op6_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    own = out[out.held_out & out.lang.notna()]
    assert (out.held_out == [held_out(i, 4, 2) for i in out.doc_id]).all() and (own.lang == own.lang_pred).mean() > 0.95


def test_convolutions_equal_a_direct_sum():
    rng = np.random.default_rng(2)
    tables = [rng.normal(size=(k, 256, language.FILTERS)).astype(np.float32) for k in language.WIDTHS]
    bias = rng.normal(size=len(language.WIDTHS) * language.FILTERS).astype(np.float32)
    net = language.Network(["a"], tables, bias, np.zeros((len(bias), 1)), np.zeros(1))
    for text in ("a", "ab", "abc", "é漢 x y", "the quick brown fox " * 30):
        c = next(tk.chunks(pa.array([text])))
        x, got = c.buf.astype(int), net.pooled(c, np.array([0]))[0]
        want = [max([0.0] + [sum(t[j, x[i + j], f] for j in range(w)) + bias[k * language.FILTERS + f] for i in range(len(x) - w + 1)]) for k, (w, t) in enumerate(zip(language.WIDTHS, tables, strict=True)) for f in range(language.FILTERS)]
        assert np.allclose(got, want, atol=1e-4)


def test_scores_equal_the_sum_over_all_pairs():
    rng, texts = np.random.default_rng(5), ["", "abc", "insult group words longer", "insult insult group", "x y z"]
    hashes, doc = toxicity.doc_terms(next(tk.chunks(pa.array(texts))))
    terms = np.unique(toxicity.hashed(hashes))[::2]
    m = toxicity.Machine(terms, 0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 3)))
    got = m.scores(pa.array(texts))
    for d in range(len(texts)):
        own = [np.searchsorted(terms, t) for t in sorted(set(toxicity.hashed(hashes[doc == d]).tolist())) if t in terms]
        z = 0.3 + sum(m.w[i] for i in own) + sum(m.v[i] @ m.v[j] for k, i in enumerate(own) for j in own[:k])
        assert abs(got[d] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_quality_scores_equal_a_direct_sum():
    rng, texts = np.random.default_rng(6), ["", "one two two", "An ODD text, 12!", "two two two two"]
    c = quality.Classifier(rng.normal(size=quality.FEATURES), 0.2, 3.0)
    chunk = next(tk.chunks(pa.array(texts)))
    want = [1 / (1 + np.exp(-3.0 * (sum(c.weight[i] for i in f) / len(f) ** 0.5 + 0.2))) for f in quality.features(chunk)]
    assert np.allclose(c.scores(pa.array(texts)), want)


def test_odd_rows_and_empty_tables(spark):
    docs, labels = odd(spark), spark.createDataFrame([(4, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (toxicity.op10, quality.op2):
        rows = f(docs, labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert f(docs, labels.limit(0)).count() == len(ODD) and f(docs.limit(0), labels).count() == 0
    assert {r["lang_pred"] for r in language.op6(docs).collect()} == {"und"}
    named = docs.withColumn("lang", F.lit("xx"))
    got = {(r["doc_id"], r["lang_pred"]) for r in language.op6(named).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (6, "und"), (5, "xx"), (4, "xx")} <= got and language.op6(docs.limit(0)).count() == 0


def base(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(tk.LOWER)))
    found = [(i, label) for phrase, label in licences.PHRASES for q in [phrase.encode().split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_licences_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "MIT License, mit license; the GENERAL public License of the mit"), (-3, "x " * 30000 + "apache license"), (-4, "mit"), (-5, "license mit")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in licences.op4(docs).collect()}
    for doc_id, text in docs.collect():
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licences.op4(docs.limit(0)).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 3, n).tolist() for n in (7, 4, 9)]
    a, text = licences.Automaton(sequences), rng.integers(0, 4, 200).tolist()
    holds = lambda x: any(s[i : i + len(x)] == x for s in sequences for i in range(len(s)))
    for i, (_, n) in enumerate(a.statistics(text)):
        assert n == max(k for k in range(i + 2) if k == 0 or holds(text[i + 1 - k : i + 1]))


def test_edited_licence_is_covered(spark):
    text = "intro " + licences.TEMPLATES[0][1].replace("free of charge", "without any charge") + " outro"
    row = licences.op4(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "mit" and 0.7 < row["score"] < 1 and row["base_labels"] == ""


def test_whole_licences_are_found_whole(spark):
    rows = [(i, f"/* Copyright 2020 A. Person */\n{text}\ncode = 1", label) for i, (label, text) in enumerate(licences.TEMPLATES)] + [(99, "Copyright 2020. All rights reserved.", "")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumns({"labels": F.lit(1), "n_words": F.lit("x")})
    got = {r["doc_id"]: r for r in licences.op4(docs.unionAll(docs)).collect()}
    assert all(label in got[i]["labels"].split(",") and (got[i]["score"] == 1 or not label) for i, _, label in rows)
    spans = docs.where("doc_id = 0").select(licences.scan(F.col("text")).alias("s")).first()["s"]["spans"]
    assert [(x["label"], x["first"], x["share"]) for x in spans] == [("mit", 4, 1.0)]


def test_odd_rows_of_licences(spark):
    rows = licences.op4(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r["n_base"] == 0 and r["labels"] == "" and r["first_word"] is None for r in rows)
