import itertools
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quarrystone.llm import decontaminate as C

from .common import LONG, awkward, empty

WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")
ITEM = "what is the name of the longest river that crosses the capital of the old northern kingdom"


def _brute(texts, items):
    """Best verified overlap of each pair, windows compared one by one."""
    span, out = max(map(len, C.MASKS)), {}
    for d, t in texts:
        for i, u in items:
            a, b = WORD.findall((t or "").lower()), WORD.findall((u or "").lower())
            masks = C.MASKS if len(b) >= span else C.short_masks(len(b)) if len(b) >= C.SHORTEST else ()
            for m in masks:
                for p in range(len(a) - len(m) + 1):
                    for q in range(len(b) - len(m) + 1):
                        if all(a[p + k] == b[q + k] for k, x in enumerate(m) if x == "1"):
                            back = min(C.EXTEND, p, q)
                            ahead = min(C.EXTEND, len(a) - p - len(m), len(b) - q - len(m))
                            s, r, n = p - back, q - back, len(m) + back + ahead
                            agree = sum(a[s + k] == b[r + k] for k in range(n))
                            if agree >= C.MIN_SHARE * n:
                                out[d, i] = min(out.get((d, i), (1,)), (-agree, s, r, -n))
    return {(d, i, s, r, -n, -g) for (d, i), (g, s, r, n) in out.items()}


def test_against_brute_force(spark):
    words = ITEM.split()
    swap = lambda *at: " ".join("other" if k in at else w for k, w in enumerate(words))
    texts = [(1, f"some start {ITEM} and an end"), (2, f"x {swap(4)} y"), (3, f"x {swap(3, 9)} y"), (4, swap(*range(0, 17, 2))), (5, " ".join(words[:8])), (6, "nothing like it"), (7, ITEM.upper()), (8, "short one of just six words"), (9, "a short one of just five words here"), (11, "what is the capital of spain today"), (10, f"{ITEM} {ITEM}")]
    items = [(100, ITEM), (101, "short one of just six words"), (102, None), (103, ""), (104, "yes"), (105, "what is the capital of france today")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in C.find(docs, bench).collect()}
    assert got == _brute(texts, items)
    assert {1, 2, 3, 7, 10} <= {r[0] for r in got} and not {4, 6} & {r[0] for r in got}
    assert {(8, 101), (9, 101), (11, 105)} == {r[:2] for r in got if r[1] != 100}
    assert {tuple(r) for r in C.unusable(bench).collect()} == {(102, 0), (103, 0), (104, 1)}
    assert {tuple(r) for r in C.find(docs, bench, slice_words=5).collect()} == got
    kept = {r["doc_id"] for r in C.keep_clean(docs, bench).collect()}
    assert kept == {k for k, _ in texts} - {r[0] for r in got}


def test_awkward_rows(spark):
    longer = F.when(F.col("text").startswith("same text"), F.concat("text", F.lit(" and again"))).when(F.col("text").startswith("a text"), F.concat(F.lit("here "), "text")).otherwise(F.col("text"))
    docs = awkward(spark).withColumn("text", longer)
    bench = spark.createDataFrame([(1, "same text, twice over and again"), (1, "same text, twice over and again"), (None, "here a text without an id"), (3, None), (4, "twice over")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in C.find(docs, bench).collect()), key=str)
    assert got == sorted([(6, 1), (7, 1), (None, None)], key=str)
    kept = C.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 6
    assert {r["__lower"] for r in kept.collect()} == {"clash"}
    assert C.find(empty(spark), bench).count() == 0 and C.keep_clean(empty(spark), bench).count() == 0
    none = bench.where("false")
    assert C.find(docs, none).count() == 0 and C.keep_clean(docs, none).count() == 10


def test_end_of_a_long_text(spark):
    docs = spark.createDataFrame([(1, LONG + " " + ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    assert C.find(docs, bench).first()["n_agree"] == 17


def test_short_items_with_substitutions(spark):
    for n in range(C.SHORTEST, 12):
        masks = C.short_masks(n)
        allowed = n - -int(-C.MIN_SHARE * n // 1)
        for out in itertools.combinations(range(n), allowed):
            assert any(all(m[k] == "0" for k in out) for m in masks)
    words = ITEM.split()[:11]
    texts = [(k, "x " + " ".join("other" if j in at else w for j, w in enumerate(words)) + " y") for k, at in enumerate([(), (0,), (5,), (2, 9), (1, 5, 9)])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {(r["doc_id"], r["n_agree"]) for r in C.find(docs, bench).collect()} == {(0, 11), (1, 10), (2, 10), (3, 9)}


def test_verbatim_excerpts_of_long_items(spark):
    item = [f"i{k}" for k in range(40)]
    pad = [f"x{k}" for k in range(20)]
    texts = [(n, " ".join(pad + item[10 : 10 + n] + pad)) for n in (8, 12, 13, 14, 15)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r for r in C.find(docs, bench).collect()}
    assert set(got) == {12, 13, 14, 15}
    assert all(got[n]["n_agree"] == n and got[n]["doc_start"] == 20 and got[n]["item_start"] == 10 for n in (12, 13, 14))


def test_repetitive_texts_are_verified_in_blocks(spark, monkeypatch):
    item, text = "na " * 60, "na " * 900
    want = C.overlaps(pa.array([text]), C.build_slice([1], [item]))
    monkeypatch.setattr(C, "HITS", 500)
    got = C.overlaps(pa.array([text]), C.build_slice([1], [item]))
    assert [x.tolist() for x in got] == [x.tolist() for x in want] and len(want[0]) == 1
