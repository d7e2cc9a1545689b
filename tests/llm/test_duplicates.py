"""Joins on shingles and vectors against brute force; components; decontamination; pages; the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraza.llm import decontaminate, graph, jaccard, pages, queries, vectors
from terraza.llm import textkit as tk


def roots(n, edges):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    return [top(x) for x in range(n)]


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 540)]
    edges += [(7, 7), edges[0]]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(600, edges)
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    assert sorted(got) == nodes
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in nodes for b in nodes)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(tk.LOWER)))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def check_jaccard(rows, docs):
    sets = [shingles(t) for _, t in docs]
    edges = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top, least = roots(len(docs), edges), {}
    for k, (i, _) in enumerate(docs):
        least[top[k]] = min(x for x in (least.get(top[k]), i) if x is not None) if (least.get(top[k]), i) != (None, None) else None
    want = sorted((str(i), len(s), str(least[top[k]])) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True)))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == want


def near_copies():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    docs, passage = [], [rng.choice(words) for _ in range(40)]
    for size in (3, 5, 6, 9, 30, 120, 400):
        origin = [rng.choice(words) for _ in range(size)]
        docs.append(origin)
        for _ in range(14):
            copy = list(origin)
            for _ in range(rng.randint(0, max(1, size // 12))):
                copy[rng.randrange(size)] = rng.choice(words)
            docs.append(copy)
    docs += [passage + [rng.choice(words) for _ in range(rng.randint(1, 16))] for _ in range(40)]
    texts = [" ".join(d) for d in docs] + [None, "", " \n", "One two", "one TWO", "one two"]
    rng.shuffle(texts)
    return [*((i + 10, t) for i, t in enumerate(texts)), (10, texts[0]), (None, "only here"), (None, texts[1] or "x")]


def test_jaccard_equals_brute_force(spark, monkeypatch):
    docs = near_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"cls": F.lit("x"), "n_shingles": F.lit("y"), "component_id": F.lit(0)})
    check_jaccard(jaccard.join(df).collect(), docs)
    monkeypatch.setattr(jaccard, "BLOCK", 200)  # many blocks to a team
    monkeypatch.setattr(jaccard, "SEEN", 2)
    check_jaccard(jaccard.join(df).collect(), docs)
    assert jaccard.join(df.limit(0)).count() == 0 and jaccard.join(df.where("text is null or text = ''")).count() == 2


def test_tokens_of_one_rank_lose_no_pair():
    x, y = np.arange(24, dtype=np.uint32), np.arange(100, 124, dtype=np.uint32)
    x[:2] = y[:2] = 7  # two shared tokens that have one rank
    sides = [[(k, k, k, 20, np.concatenate([s] * (jaccard.ORDERS - 1)))] for k, s in ((1, x), (2, y))]
    assert jaccard.hash_shared(20) == 2 and sorted(jaccard.survivors(*sides, 80)) == [(1, 1, 1), (2, 2, 2)]


def test_jaccard_on_a_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check_jaccard(queries.op7_ngram_jaccard(spark, "/root/testdata/sf0.001").collect(), docs)


def test_words_that_a_polynomial_takes_for_equal_stay_apart(spark):
    one = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    check_jaccard(jaccard.join(spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")).collect(), [(1, one), (2, two), (3, one)])


def test_orders_leave_fewer_pairs_to_compare(spark):
    rng = random.Random(9)
    common, rows = [f"c{i}" for i in range(60)], []
    for i in range(300):  # every tenth a near copy of the first; the others share a stretch of a third
        words = common[:1] + [f"u{i}"] + common[2:] if i % 10 == 0 else [f"u{i}-{k}" for k in range(40)] + common[40:]
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.sparkContext.broadcast(jaccard.levels(docs))
    sizes = jaccard.classes(docs, held).select("cls", "n", F.col("doc_id").alias("least"))
    lead = sizes.where("least = 0").first()["cls"]
    pairs = sizes.where("least > 0").select(F.lit(lead).alias("a"), F.col("cls").alias("b"), F.lit(3).cast("long").alias("copies"))
    met = jaccard.candidates(docs, held, pairs, sizes)
    found = {r["b"] for r in met.collect()}
    links = {r["b"] for r in jaccard.verified(docs, held, pairs, sizes).collect()}
    assert links <= found and len(links) == 29 and len(found) < 60
    assert {r["b"] for r in jaccard.verified(docs, held, met, sizes).collect()} == links


def test_blocks_of_many_short_texts(spark, monkeypatch):
    rows = [(i, f"please read the notice about {i}") for i in range(700)] + [(900 + i, f"please read the notice about {i}") for i in range(3)]
    monkeypatch.setattr(jaccard, "CLASSES", 100)
    check_jaccard(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def check_vectors(rows, own):
    sound = [label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in own]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if s else None for (_, v, _), s in zip(own, sound, strict=True)]
    edges = [(i, j) for i in range(len(own)) for j in range(i) if sound[i] and sound[j] and own[i][2] == own[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    top, least, links = roots(len(own), edges), {}, np.bincount([x for e in edges for x in e], minlength=len(own))
    for k, r in enumerate(own):
        least[top[k]] = min(least.get(top[k], r[0]), r[0])
    want = sorted((r[0], int(links[k]), least[top[k]], r[0] == least[top[k]]) for k, r in enumerate(own))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows) == want


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng, own = np.random.default_rng(6), []
    for label in (0, 1, None):
        for _ in range(6):
            centre = rng.normal(size=12)
            own += [[(centre + rng.normal(size=12) * s).tolist(), label] for s in rng.uniform(0, 0.25, 25)]
    own += [[own[0][0], 0]] * 5 + [[None, 0], [[0.0] * 12, 0], [[float("nan")] * 12, 0], [[1.0, None], 0], [[], 0], [[1.0, 2.0], 0], [[2.0, 4.0], 0], [[1e-30] * 12, 1], [[1e30] * 12, 1]]
    rows = [(i, v, label) for i, (v, label) in enumerate(own)] + [(0, own[0][0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"kept": F.lit("x"), "cls": F.lit(1)})
    monkeypatch.setattr(vectors, "INTERVAL", 16)
    monkeypatch.setattr(vectors, "LEAF", 4)
    check_vectors(vectors.join(df).collect(), rows)
    assert vectors.join(df.limit(0)).count() == 0


def test_very_long_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    own = [(i, (c + rng.normal(size=3000) * s).tolist(), 0) for i, (c, s) in enumerate((c, s) for c in rng.normal(size=(2, 3000)) for s in (0, 0.05, 0.1, 1))]
    check_vectors(vectors.join(spark.createDataFrame(own, "vec_id long, embedding array<double>, label int")).collect(), own)
    monkeypatch.setattr(vectors, "COMPONENTS", 100)
    check_vectors(vectors.join(spark.createDataFrame(own, "vec_id long, embedding array<double>, label int")).collect(), own)


def test_vectors_on_a_table(spark):
    own = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check_vectors(queries.op8_vector_dedup(spark, "/root/testdata/sf0.01").collect(), own)


def test_wand_equals_exhaustive_scores(spark):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    index = next(decontaminate.index_shards(items))
    rng = np.random.default_rng(7)
    scores = lambda terms: {u: w for u in range(len(index.item)) if (w := sum(index.impact[p] for t in terms for p in range(index.first[t], index.first[t + 1]) if index.unit[p] == u))}
    for _ in range(60):
        terms = sorted(rng.choice(len(index.terms), rng.integers(1, 40), replace=False).tolist())
        for threshold in (0.05, 0.2, 0.6):
            want = {u: s for u, s in scores(terms).items() if s >= threshold + 1e-12}
            got = dict(index.wand(terms, threshold))
            assert set(want) <= set(got) and all(abs(got[u] - want[u]) < 1e-9 for u in want)


def test_planted_items_are_found(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in (d["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, data).collect()}
    assert want and want == got


def test_items_need_question_and_answer(spark):
    question, answer = "which of the old rivers runs past the seven towers of the northern city", "it is the long green river of the east"
    items = spark.createDataFrame([(1, f"{question}? {answer}."), (2, None), (3, ""), (4, " ".join(f"t{i}" for i in range(200)))], "item_id long, text string").withColumn("unit", F.lit(1))
    rows = [(1, f"So: {question.upper()}; {answer}!"), (2, question), (3, None), (4, ""), (5, "x " * 30000 + f"{question} {answer}"), (None, f"{question} {answer}"), (6, " ".join(f"T{i}" for i in range(200))), (6, " ".join(f"T{i}" for i in range(200)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    got = decontaminate.matches(docs, items)
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in got.collect()) == [("1", 1), ("5", 1), ("6", 4), ("6", 4), ("None", 1)]
    assert decontaminate.without_items(docs, items).count() == 3
    assert decontaminate.matches(docs.limit(0), items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontaminate.index_shards, "__defaults__", (2,))
        assert decontaminate.matches(docs, items).count() == 5 and decontaminate.without_items(docs, items).count() == 3


def test_longest_common_lines():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = pages.shared_lines(a, b)
        assert len(got) == table[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(got))


def test_article_lines_are_kept_and_neighbours_decide_the_rest(spark):
    site = lambda n: f"<title>t</title><div id=top>Our site</div><div>Story {n} &amp; more<br>of it</div><p>Body {n}</p><div>Call us</div><div class='side-bar sidebar'>x</div>"
    rows = [
        (1, "http://a.b/x/1", site(1)), (2, "http://a.b/x/2", site(2)), (3, "http://a.b/y", "<p>Our site<p>alone"), (4, "http://c.d/", site(4)), (5, None, None), (6, "http://e.f", ""), (7, "http://a.b/x/3", "<article><h1>H</h1>Our site<p>one\n two<script>'</p>'</script></article><nav>n</nav>"),
        (8, "http://g.h/1", site(8)), (8, "http://g.h/1", site(8)), (9, "u", "x" * 100000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "lines": F.lit("z"), "host": F.lit("h")})
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(df).collect())
    want = [(1, "Story 1 & more of it\nBody 1"), (2, "Story 2 & more of it\nBody 2"), (3, "alone"), (4, "Our site\nStory 4 & more of it\nBody 4\nCall us"), (5, ""), (6, ""), (7, "H\nOur site\none two"), *[(8, "Our site\nStory 8 & more of it\nBody 8\nCall us")] * 2, (9, "x" * 100000)]
    assert got == [(i, t, len(t)) for i, t in want]
    assert pages.extract(df.limit(0)).count() == 0


def test_page_bodies_equal_their_markup(spark):
    import html

    want = []
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        want.append((r["page_id"], "\n".join(x for x in blocks if x)))
    assert sorted((r["page_id"], r["text"]) for r in queries.op3_main_text(spark, "/root/testdata/sf0.001").collect()) == sorted(want)


def test_pipeline_stages_keep_whole_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1").collect()}
    # About one toxic row in twenty is marked so by mistake: no word of its text is one that marks toxic texts in these tables.
    marks = re.compile(r"\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|scum|loser|moron)\b|\bach(lich|keit)\w|\br(ée|éê)\w|\bbo(mente|co|cue|ción)\w*", re.I)
    mistaken = {r["doc_id"] for r in docs.collect() if r["doc_id"] in toxic and not marks.search(r["text"] or "")}
    assert len(mistaken) <= 0.1 * len(toxic)
    left = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, data)
        assert left.columns == docs.columns, name
        ids, old = {r["doc_id"] for r in left.select("doc_id").collect()}, {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= old and len(ids) > 0.85 * len(old), name
        left = spark.createDataFrame(left.toPandas(), docs.schema)
    assert len({r["doc_id"] for r in left.select("doc_id").collect()} & toxic - mistaken) <= 0.05 * len(toxic)
    pieces = pipeline.STAGES[-1][1](spark, left, data)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in left.select("doc_id").collect()}


def test_pipeline_equals_a_plain_run(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    import pyarrow as pa

    from terraza.llm import language, toxicity

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    scores = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet")).scores(pa.array([r["text"] for r in rows]))
    rows = [r for r, s in zip(rows, scores, strict=True) if s < pipeline.TOXIC]
    left = spark.createDataFrame(rows, docs.schema)
    network = language.fit(left)
    best, prob = network.predict(pa.array([r["text"] for r in rows]))
    rows = [r for r, b, p in zip(rows, best, prob, strict=True) if b >= 0 and p >= pipeline.SURE]
    sets = [shingles(r["text"]) for r in rows]
    top = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    rows = [r for i, r in enumerate(rows) if top[i] == i]  # rows are in the order of their ids
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(x in r["text"] for x in items)]
    got = pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows} and len(rows) > 100
    assert all(r["doc_tokens"] == sum(x["length"] for x in got if x["doc_id"] == r["doc_id"]) for r in got[:50])


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(4, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "which river is the longest one here? the green one.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, None, "en", "s", 0), (2, "bad words here", "en", "s", 9), (3, "", None, None, None), (4, "fine words here and there", "en", "s", 9), (4, "fine words here and there", "en", "s", 9), (None, "no id at all", "en", "s", 3), (7, "Which river is the longest one here? The green one.", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("cls", F.lit("x"))
    for part in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, part, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= part.count(), name
        pipeline.STAGES[-1][1](spark, part, str(tmp_path)).count()
    stages = dict(pipeline.STAGES)
    twice = [(3, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (5, "quite another text with words of its own and more"), (5, "a b c d e f g h i j k l m n o p q r s t u v w x y zz"), (5, "quite another text with words of its own and more"), (5, "a third text under the same id that no other one is like")]
    kept = jaccard.without_near_copies(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept) == sorted([*twice[:2], twice[4]])
    assert 7 not in {r["doc_id"] for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()}
    assert sorted(str(r["doc_id"]) for r in stages["near duplicates"](spark, docs, str(tmp_path)).collect()) == ["1", "2", "3", "4", "7", "None"]
