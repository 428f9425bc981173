import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.llm import quality, queries
from quarrystone.llm._text import hash_word

from . import brute
from .common import awkward, empty

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = quality.fit(docs, labels.where(even))
    got = quality.score(docs, model).join(labels.where(~even), "doc_id").toPandas()
    good = (got["quality"] == 1) & (got["toxic"] == 0)
    a, b = got["score"][good].to_numpy(), got["score"][~good].to_numpy()
    auc = ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2)
    assert auc > 0.9
    assert got["kept"][good].mean() > 0.97


def test_query_against_brute_force(spark):
    """Features, markers, fit, threshold and decisions, recomputed from the texts."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    labels = [tuple(r) for r in spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    score, threshold = brute.quality(docs, labels)
    got = {r["doc_id"]: r["score"] for r in queries.op3_quality(spark, D).collect()}
    near = {d for d, s in score.items() if abs(s - threshold) < 1e-3}
    assert {d for d, s in score.items() if s >= threshold} - near == set(got) - near and len(near) < 20
    assert all(got[d] == pytest.approx(score[d], abs=1e-3) for d in got)


def test_equal_scores_at_the_threshold_are_kept(spark):
    rows = [(k, "Good plain words in a row number one.") for k in range(4)] + [(k, "||| !!! ###") for k in range(4, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 4), 0) for k in (0, 1, 4, 5)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in quality.keep_good(docs, quality.fit(docs, labels)).collect()} == {0, 1, 2, 3}


def test_pairs_in_blocks_are_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(1, 1, (50, 3)), rng.normal(0, 1, (31, 3))
    whole = quality.fit_pairs(x, y)
    monkeypatch.setattr(quality, "BLOCK_PAIRS", 100)
    assert np.allclose(quality.fit_pairs(x, y), whole, atol=1e-4) and np.allclose(whole, brute.fitted(x, y), atol=1e-4)


def test_newton_finds_the_minimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (30, 3))
    w = quality.fit_pairs(x, y)
    d = (x[:, None] - y[None]).reshape(-1, 3)
    loss = lambda v: np.logaddexp(0, -(d @ v)).mean() + quality.L2 / 2 * v @ v
    assert all(loss(w) <= loss(w + s * e) + 1e-12 for e in np.eye(3) for s in (-1e-3, 1e-3))


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 1, None), (6, None, 1), (None, 1, 0), (99, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == 10 and all(np.isfinite(r["score"]) for r in scored)
    same = {(r["score"], r["kept"]) for r in scored if r["doc_id"] == 7}
    assert same <= {(r["score"], r["kept"]) for r in scored if r["doc_id"] == 6}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in scored)
    assert quality.keep_good(empty(spark), model).count() == 0


@pytest.mark.parametrize("rows", [[], [(4, 1, 0)], [(4, 0, 0)]])
def test_one_sided_labels_keep_all(spark, rows):
    docs = awkward(spark)
    model = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    assert quality.keep_good(docs, model).count() == 10


def test_empty_documents(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(empty(spark), quality.fit(empty(spark), labels)).count() == 0


def test_every_labelled_document_counts(spark):
    """A word that only the last 600 of 20,600 labelled documents have, in the order of their ids' hashes, is learned."""
    ids = spark.range(20_600).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")).alias("k"))
    kind = F.when(F.col("k") > 20_000, 2).when(F.col("k") % 20 == 0, 1).otherwise(0)
    text = F.when(kind == 2, "a plain row with vile words").when(kind == 1, "||| !!! ###").otherwise("a plain row with good words")
    docs = ids.select("doc_id", text.alias("text"), kind.alias("kind")).localCheckpoint()
    model = quality.fit(docs, docs.select("doc_id", F.when(F.col("kind") == 1, 0).otherwise(1).alias("quality"), (F.col("kind") == 2).cast("int").alias("toxic")))
    assert hash_word("vile") in model.markers.tolist()
    plain = {k: brute.plain_features(t) for k, t in enumerate(("a plain row with good words", "||| !!! ###", "a plain row with vile words"))}
    share = {0: 19_000 / 20_600, 1: 1_000 / 20_600, 2: 600 / 20_600}
    assert np.allclose(model.mean[: len(plain[0])], sum(share[k] * np.array(plain[k]) for k in plain), atol=1e-9)
    kept = {(r["kind"], r["n"]) for r in quality.keep_good(docs, model).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kept == {(0, 19_000)}


def test_sums_by_cells_are_sums_over_all_pairs():
    rng = np.random.default_rng(7)
    z, bad, w = rng.normal(0, 1, (700, 3)) * [1, 4, 30], rng.random(700) < 0.3, np.array([0.7, -0.4, 0.2])
    cells = quality._merge_cells(quality._cells(bad[:400], z[:400], w), quality._cells(bad[400:], z[400:], w))
    got = quality._pair_sums(quality._points(cells, False), quality._points(cells, True), w, 1e-3)
    d = (z[~bad][:, None] - z[bad][None]).reshape(-1, 3)
    p = 1 / (1 + np.exp(d @ w))
    want = np.logaddexp(0, -(d @ w)).mean() + 5e-4 * w @ w, -(d * p[:, None]).mean(0) + 1e-3 * w, (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(3)
    assert all(np.allclose(a, b, rtol=1e-10, atol=1e-10) for a, b in zip(got, want))


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_threshold_is_an_exact_quantile(n):
    rng = np.random.default_rng(n)
    good, bad = np.round(rng.normal(2, 1, n), 9), np.round(rng.normal(0, 1, 900), 9)
    good[: n // 3] = good[0]
    scores, side = np.concatenate((good, bad)), np.repeat([False, True], [n, 900])
    level, threshold = quality.choose_threshold(lambda edges: quality._below(side, scores, edges), n, 900)
    cut = {q: np.quantile(good, q, method="lower") for q in quality.LEVELS}
    gain = {q: (good >= t).mean() - (bad >= t).mean() for q, t in cut.items()}
    assert threshold == cut[level] and gain[level] == pytest.approx(max(gain.values()), abs=1e-12)


def test_texts_that_share_a_labelled_id_all_count(spark):
    docs = spark.createDataFrame([(1, "good words"), (1, "GOOD WORDS!"), (1, "good words"), (2, "|||")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert np.allclose(model.mean[: len(model.mean) - 2], np.mean([brute.plain_features(t) for t in ("good words", "GOOD WORDS!", "|||")], axis=0))
