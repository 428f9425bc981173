import re

import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from quarrystone.llm import bpe, pii, simhash

from . import brute
from .common import AWKWARD, SCHEMA, LONG
from .test_decontaminate import _brute
from .test_simhash import _groups

D = "/root/testdata/sf0.001"
NAMES = ["quality classifier", "simhash near-dedup", "benchmark decontamination", "pii", "bpe encoding and decoding"]


def _table(spark, name, d=D):
    return [r.asDict() for r in spark.read.parquet(f"{d}/{name}.parquet").collect()]


def _kept_by_quality(rows, labels):
    """By the textbook; documents so near the threshold that rounding decides are None."""
    score, threshold = brute.quality({r["doc_id"]: r["text"] for r in rows}, [(r["doc_id"], r["quality"], r["toxic"]) for r in labels])
    return {d: None if abs(s - threshold) < 1e-3 else s >= threshold for d, s in score.items()}


def _leaked(rows, items):
    """Overlaps of all documents with all items, those with few words in common left out as they can't overlap."""
    words = lambda t: set(re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower()))
    out = set()
    for i in items:
        own = words(i["text"])
        near = [(r["doc_id"], r["text"]) for r in rows if len(own & words(r["text"])) >= min(6, len(own))]
        out |= {d for d, *_ in _brute(near, [(i["item_id"], i["text"])])}
    return out


def test_stages_and_rows(spark):
    """Each stage recomputed from the texts: all pairs, all items, the public tokenizer."""
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    docs = {r["doc_id"]: r for r in _table(spark, "documents")}
    got = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, D).collect()}
    verdict = _kept_by_quality(list(docs.values()), _table(spark, "labels"))
    # the few that rounding decides go as the library decides
    kept_by_library = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{D}/documents.parquet"), D).collect()}
    assert all(v is None or v == (d in kept_by_library) for d, v in verdict.items())
    rows = {d: docs[d] for d in sorted(kept_by_library)}
    f0, f1, n = simhash.fingerprint_texts(bpe.pa.array([r["text"].lower() for r in rows.values()]))
    some = [k for k in range(len(n)) if n[k]]
    ids = list(rows)
    group = _groups([ids[k] for k in some], f0[some], f1[some], n[some])
    rows = {d: r for d, r in rows.items() if group.get(d, d) == d}
    leaked = _leaked(list(rows.values()), _table(spark, "benchmark"))
    assert set(got) == set(rows) - leaked
    library = Tokenizer.from_file(bpe.VOCABULARY)
    library.encode_special_tokens = True
    linked = {}
    for d, r in got.items():
        before, after = rows[d]["text"], r["text"]
        assert r["decoded"] == after and r["tokens"] == library.encode(after, add_special_tokens=False).ids
        assert {c: r[c] for c in docs[d] if c != "text"} == {c: docs[d][c] for c in docs[d] if c != "text"}
        # digits and letters within findings change, one to one; all else stays
        runs = re.findall(r"[0-9]{9,}", before)
        if re.sub("[0-9A-Za-z@.]", "", before) == re.sub("[0-9A-Za-z@.]", "", after) and len(before) == len(after):
            for m in re.finditer(r"(?<![0-9A-Za-z.])[0-9]{9,12}(?![0-9A-Za-z])", before):
                new = after[m.start() : m.end()]
                assert linked.setdefault(m.group(), new) == new
        assert not any(x in after for x in runs if 9 <= len(x) <= 19 and re.search(rf"(?<![\w.]){x}(?!\w)", before))
    assert len(set(linked.values())) == len(linked)


@pytest.mark.parametrize("stage", range(4))
def test_every_stage_but_the_last_keeps_the_columns(spark, stage):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, D)
    assert out.columns == docs.columns
    assert corpus_pipeline.STAGES[stage][1](spark, docs.where("false"), D).count() == 0


@pytest.fixture(scope="module")
def awkward_dir(spark, tmp_path_factory):
    """Tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns, null labels and items."""
    d = tmp_path_factory.mktemp("awkward")
    more = [(20 + k, f"mail jane{k}@mail.example.com or call 555-123-456{k} about plan {w}", "en", "s", 50, "clash", 7, 1, "clash", "clash", "clash") for k, w in enumerate(["alpha", "beta"])]
    spark.createDataFrame(AWKWARD + more, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (20, 1, 0), (None, 1, 0), (6, 0, 0), (7, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a text without an id and more"), (2, None), (3, ""), (4, "yes")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_awkward_rows_through_each_stage(spark, awkward_dir):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet")
    texts = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    everyone = texts(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, awkward_dir)
        if k < 4:
            assert out.columns == docs.columns, name
        rows = texts(out)
        assert all(len(t) == len(r["text"]) for r in out.collect() if r["text"] and "@" not in (t := r["text"]))
        if name == "simhash near-dedup":
            # one of the equal texts stays, and neither nulls nor empty texts nor rows without an id are duplicates
            assert [t for _, t in rows].count("same text, twice over") == 1 and ("None", "a text without an id") in rows
            assert {("1", ""), ("2", ""), ("3", " \n ")} <= set(rows) and ("4", LONG) in rows
        elif name == "pii":
            assert [i for i, _ in rows] == [i for i, _ in everyone] and not any("jane" in t or "555-123" in t for _, t in rows)
        elif name.startswith("bpe"):
            assert all((r["tokens"] is None) == (r["text"] is None) and r["decoded"] == r["text"] for r in out.collect())
        elif name == "benchmark decontamination":
            assert rows == everyone


def test_awkward_rows_from_end_to_end(spark, awkward_dir):
    rows = corpus_pipeline.run(spark, awkward_dir).collect()
    assert rows and all(r["decoded"] == r["text"] and r["a.b"] == 7 and r["id"] == "clash" for r in rows)
    texts = [r["text"] for r in rows]
    assert texts.count("same text, twice over") <= 1


def test_tables_without_rows(spark, awkward_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{awkward_dir}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_session_key_gives_equal_pseudonyms(spark, awkward_dir):
    docs = spark.createDataFrame([(1, "call 555-123-4567"), (2, "or 555-123-4567")], "doc_id long, text string")
    got = {r["text"][-12:] for r in corpus_pipeline.pii_stage(spark, docs, awkward_dir).collect()}
    assert len(got) == 1 and got == {pii.pseudonymise("555-123-4567", pii.session_key(spark))[0]}
