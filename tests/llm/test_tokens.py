"""Token ids, packing and token counts: exact round trips and brute force."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terraza.llm import packing, queries, tokencounts, tokens
from terraza.llm import textkit as tk

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "ok ok"), (4, "ok ok"), (None, "no id"), (5, "it's <|endoftext|>   漢 x" * 900)]


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9\n\t.,'\"!st<|é ñ²½\x85\xa0—漢\r", max_size=30), max_size=6))
def test_ids_are_the_tokenizers_own(texts):
    encoder = tokens.Encoder.of(PATH)
    for c in tk.chunks(pa.array(texts, pa.string()), 40):
        flat, offs = encoder.ids(c)
        for d in range(len(c)):
            assert flat[offs[d] : offs[d + 1]].tolist() == ids(texts[c.row + d])


def test_differencing_fills_windows():
    sizes = np.random.default_rng(0).integers(1, 257, 900)
    window = packing.windows(sizes, 1024)
    sums = np.bincount(window, sizes)
    assert sums.max() <= 1024 and sums.sum() == sizes.sum() and sizes.sum() / (1024 * len(sums)) > 0.98
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


def check_pieces(rows, docs):
    want = sorted(zlib.crc32(np.array([*ids(t), 0], "<u4")) for _, t in docs)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    by_id = defaultdict(list)
    for i, t in docs:
        by_id[i].append(np.array([*ids(t), 0], "<u4"))
    assert len(want) == len(docs) and set(by_id) == set(pieces)
    for i, own in by_id.items():
        if len(own) == 1 or all((x == own[0]).all() for x in own if len(x) == len(own[0])):
            for r in pieces[i]:
                x = next(x for x in own if len(x) == r["doc_tokens"])
                assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]])
            assert sum(r["length"] for r in pieces[i]) == sum(map(len, own))


def test_pieces_cover_every_id_once(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(queries.op5_packing(spark, DATA).collect(), docs)
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("start", F.lit("x"))
    check_pieces(packing.op5(odd).collect(), ODD)
    assert packing.op5(odd.limit(0)).count() == 0


def test_windows_of_a_larger_table_are_full(spark):
    data = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op5_packing(spark, data).collect()
    check_pieces(rows, docs)
    assert sum(r["length"] for r in rows) / (1024 * len({r["sequence_id"] for r in rows})) > 0.97


def test_pieces_that_a_polynomial_takes_for_equal_keep_their_ids():
    one = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    texts = [one, one.translate(str.maketrans("ab", "ba")), one[::-1]]
    flat, offs = tokens.Encoder(PATH).ids(next(tk.chunks(pa.array(texts))))
    assert [flat[offs[d] : offs[d + 1]].tolist() for d in range(3)] == [ids(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_ids_of_any_characters_are_the_tokenizers_own(texts):
    encoder = tokens.Encoder.of(PATH)
    for c in tk.chunks(pa.array(texts, pa.string()), 60):
        flat, offs = encoder.ids(c)
        assert [flat[offs[d] : offs[d + 1]].tolist() for d in range(len(c))] == [ids(texts[c.row + d]) for d in range(len(c))]


def test_counts_equal_the_tokenizers(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    want = sorted((r["doc_id"], len(own.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in queries.op9_token_counts(spark, DATA).collect()) == want
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    assert sorted(((r["doc_id"] or 0), r["n_tokens"]) for r in tokencounts.op9(odd).collect()) == sorted((i or 0, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert tokencounts.op9(odd.limit(0)).count() == 0


def test_boundaries_are_stitched_across_blocks(spark, tmp_path):
    rng, want = np.random.default_rng(2), []
    for k in range(3):
        flat = rng.integers(0, 6, 500).astype("<u2")
        if k == 1:
            flat[:] = 1  # no separator at all
        (tmp_path / f"f{k}.bin").write_bytes(flat.tobytes())
        at, nth = 0, 0
        for i in np.flatnonzero(flat == 0):
            want.append((f"f{k}.bin", nth, int(i) - at))
            at, nth = int(i) + 1, nth + 1
        if at < len(flat):
            want.append((f"f{k}.bin", nth, len(flat) - at))
    (tmp_path / "f9.bin").write_bytes(b"")
    for block in (2, 14, 1 << 12):
        got = tokencounts.count(tokencounts.read_files(spark, str(tmp_path), block), separator=0).collect()
        assert sorted((r["file"].rpartition("/")[2], r["nth"], r["n_tokens"]) for r in got) == sorted(want)


def test_written_out_separators_are_counted_as_text(spark):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    rows = [*ODD, (6, "a <|endoftext|> b"), (7, "<|endoftext|>"), (8, "after them")]
    got = tokencounts.op9(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i or 0, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_files_are_read_in_ranges(spark, tmp_path):
    (tmp_path / "a b%20.bin").write_bytes(bytes(range(250)) * 3)
    (tmp_path / "short.bin").write_bytes(b"abcd")
    rows = tokencounts.read_files(spark, str(tmp_path), 14, 42).collect()
    parts = {n: [bytes(r["data"]) for r in sorted(rows, key=lambda r: r["block"]) if r["file"].endswith(n)] for n in ("a b%20.bin", "short.bin")}
    assert b"".join(parts["a b%20.bin"]) == bytes(range(250)) * 3 and len(parts["a b%20.bin"]) == 54 and parts["short.bin"] == [b"abcd"]
    with (tmp_path / "long.bin").open("wb") as f:
        f.truncate((1 << 31) + 6)  # longer than Spark reads as one value
    sizes = tokencounts.read_files(spark, str(tmp_path / "long.bin"), 1 << 24).select(F.length("data").alias("n")).agg(F.sum("n"), F.count("n")).first()
    assert tuple(sizes) == ((1 << 31) + 6, 129)
