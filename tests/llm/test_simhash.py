import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.llm import simhash as S

from .common import LONG, awkward, empty, row, SCHEMA

D = "/root/testdata/sf0.01"


def _groups(ids, f0, f1, n, ratio=None):
    """Least id of every document's group, by comparing all pairs."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    d = np.bitwise_count(f0[:, None] ^ f0[None]) + np.bitwise_count(f1[:, None] ^ f1[None])
    near = d <= S.MAX_HAMMING
    if ratio is not None:
        near &= np.maximum(n[:, None], n[None]) <= ratio * np.minimum(n[:, None], n[None])
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = find(ids[i]), find(ids[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    p = S.fingerprints(docs).toPandas()
    ids = p["id"].to_list()
    want = {i: g for i, g in _groups(ids, p["f0"].to_numpy().view(np.uint64), p["f1"].to_numpy().view(np.uint64), p["n"].to_numpy()).items() if i != g}
    assert {r["id"]: r["duplicate_of"] for r in S.duplicates(docs).collect()} == want
    assert S.keep_one(docs).count() == docs.count() - len(want)


@pytest.mark.parametrize("ratio,rows", [(None, 150), (1.2, 60)])
def test_cells_of_several_tasks_and_length_limits(spark, monkeypatch, ratio, rows):
    monkeypatch.setattr(S, "CELL_ROWS", rows)
    p = S.fingerprints(spark.read.parquet(f"{D}/documents.parquet")).toPandas()
    want = {i: g for i, g in _groups(p["id"].to_list(), p["f0"].to_numpy().view(np.uint64), p["f1"].to_numpy().view(np.uint64), p["n"].to_numpy(), ratio).items() if i != g}
    got = S.duplicates(spark.read.parquet(f"{D}/documents.parquet"), length_ratio=ratio)
    assert {r["id"]: r["duplicate_of"] for r in got.collect()} == want


def test_fingerprint_by_definition():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 50))) for _ in range(20)] + ["", None, "Über ÜBER über"]
    f0, f1, n = S.fingerprint_texts(pa.array(texts))
    for k, t in enumerate(texts):
        distinct = sorted(set((t or "").split()))
        if not distinct:
            assert n[k] == 0
            continue
        h = S.hash_words(pa.array(distinct)).h >> np.uint64(12) << np.uint64(12)
        h = np.unique(h)
        pair = np.stack((S.mix64(h ^ S._SPREAD), S.mix64(h + S._SPREAD)), 1)
        bits = np.unpackbits(pair.view(np.uint8).reshape(len(h), 16), axis=1).astype(int)
        sign = (2 * bits - 1).sum(0) > 0
        a, b = np.packbits(sign).view(np.uint64)
        assert (f0[k], f1[k], n[k]) == (a, b, len(h))


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_manhattan_never_exceeds_hamming(a, b):
    x, y = np.array([a], np.uint64), np.array([b], np.uint64)
    fields = lambda v: [(int(S._counts(v)[0]) >> (2 * k)) & 3 for k in range(32)]
    manhattan = sum(abs(p - q) for p, q in zip(fields(x), fields(y), strict=True))
    assert manhattan == int(np.bitwise_count(S._thermometer(x) ^ S._thermometer(y))[0]) <= (a ^ b).bit_count()


def test_many_copies_make_one_group(spark):
    base = " ".join(f"token{k}" for k in range(200))
    rows = [(k, base if k % 2 else base + f" tail{k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.duplicates(docs).collect()
    assert len(got) == 2999 and {r["duplicate_of"] for r in got} == {0}


def test_copies_with_edited_words_are_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        words = [f"w{k}x{j}" for j in range(120)]
        edited = list(words)
        for j in rng.choice(120, 6, replace=False):
            edited[j] = f"new{k}x{j}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    f0, f1, _ = S.fingerprint_texts(pa.array([t for _, t in rows]))
    d = np.bitwise_count(f0[::2] ^ f0[1::2]) + np.bitwise_count(f1[::2] ^ f1[1::2])
    want = {(2 * k + 1, 2 * k) for k in np.flatnonzero(d <= 23).tolist()}
    assert (d > 15).any() and len(want) >= 58
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["id"], r["duplicate_of"]) for r in S.duplicates(docs).collect()} == want


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = {(r["id"], r["duplicate_of"]) for r in S.duplicates(docs).collect()}
    assert got == {(7, 6)}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or -1) for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 6, 6, 8]
    assert S.duplicates(empty(spark)).count() == 0 and S.keep_one(empty(spark)).count() == 0


def test_long_text_equals_its_edit(spark):
    docs = spark.createDataFrame([row(1, LONG), row(2, LONG + " one more")], SCHEMA)
    assert [tuple(r) for r in S.duplicates(docs).select("id", "duplicate_of").collect()] == [(2, 1)]
    assert S.keep_one(docs).select(F.min("doc_id")).first()[0] == 1
