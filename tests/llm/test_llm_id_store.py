"""Binary token ids and their index, beside the tokenizers library."""

import collections
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import ODD, odd_rows

from docwarden.llm import op12_id_store as op12


@pytest.fixture(scope="module")
def library():
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(op12.default_path())
    tokenizer.no_truncation(), tokenizer.no_padding()
    return tokenizer


def expected_of(rows, library):
    out = collections.defaultdict(list)
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out[i].append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    return {i: sorted(found) for i, found in out.items()}


def check(docs, library):
    got = collections.defaultdict(list)
    rows = sorted(op12.id_digests(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start))
    before = 0
    for row in rows:
        assert row.start == before
        before += row.n_tokens
        got[row.doc_id].append((row.n_tokens, row.ids_crc32))
    assert {i: sorted(found) for i, found in got.items()} == expected_of(docs.select("doc_id", "text").collect(), library)


def test_store_of_odd_rows(spark, library):
    check(spark.createDataFrame(odd_rows(), ODD).repartition(3), library)


def test_store_of_documents(spark, sf_dir, library):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), library)


def test_a_hot_id_spans_tasks(spark, library):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5).alias("text"))
    check(docs.repartition(5), library)


def test_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    assert op12.id_digests(docs).count() == 0


def test_ids_by_key(spark, library, tmp_path):
    docs = spark.createDataFrame([(5, "One two."), (3, None), (9, "three"), (5, "One two.")], "doc_id long, text string")
    store = op12.store_ids(docs, str(tmp_path / "shards"))
    keys = spark.createDataFrame([(5, 0), (5, 1), (5, 2), (4, 0), (3, 0)], "doc_id long, times long")
    found = {(r.doc_id, r.times): (r.start, list(r.ids)) for r in store.ids_of(keys).collect()}
    ids = library.encode("One two.", add_special_tokens=False).ids + [2]
    assert found == {(3, 0): (0, [2]), (5, 0): (1, ids), (5, 1): (1 + len(ids), ids)}


def test_words_are_cut_as_the_library_does(library):
    texts = [
        "don't stop. 'tis (so). e.g., A.B.C.; x!? \"quoted\". 3.14, 10%. Ünï. É. naïve: á. İstanbul. ΣΣ.",
        "<|endoftext|> <|ENDOFTEXT|>. a<|startoftext|>B, \x1c.\x85x　y.  end.", "", " ", ".", "..a..", "KK.", "'s's 'S.",
    ]
    flat, counts = op12.WordCache(op12.default_path()).encode([t.encode() for t in texts])
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts, strict=True):
        assert flat[end - n : end].tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    one, two = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
    function, end = op12.PerfectHash.unpack(packed := op12.PerfectHash.build(one, two).pack())
    assert end == len(packed)
    assert sorted(function.slots(one, two).tolist()) == list(range(n))


def test_keys_no_level_settles(monkeypatch):
    monkeypatch.setattr(op12, "LEVELS", 1)
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 2**64, (2, 500), dtype=np.uint64)
    function, _ = op12.PerfectHash.unpack(op12.PerfectHash.build(one, two).pack())
    assert len(function.left) and sorted(function.slots(one, two).tolist()) == list(range(500))


def test_shard_round_trip():
    shard = op12.Shard(3, 4, 5, np.arange(9, dtype="<u2"), np.array([1, 2]), np.array([0, 1]), np.array([0, 6]), np.array([4, 9]))
    back = op12.read_shard(op12.pack_shard(shard) + b"\n")
    assert (back.part, back.seq, back.before) == (3, 4, 5)
    assert back.ids.tolist() == list(range(9)) and back.ends.tolist() == [4, 9] and back.null.tolist() == [0, 1] and back.times.tolist() == [0, 6]
    with pytest.raises(ValueError):
        op12.read_shard(op12.pack_shard(shard)[:-1])
