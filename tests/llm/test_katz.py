import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import katz

from .common import awkward, empty

TEXTS = ["a b a b c", "a b d", "b c a e f g", "", "x y x y x y z", "a a a a b", "c a b d e", "q r s t u v w", "a b a b c", "the cat a b d é", "b c a e f g", "x y x y z a b"]
SMALL = {"chunk_tokens": 10, "bucket_tokens": 9, "hot_tokens": 4}


def _discounts(counts):
    n = Counter(counts)
    return katz.discounts([0, *(n.get(r, 0) for r in range(1, katz.CUT + 2))])


def _sentence(text):
    return ["<s>", "<s>", *re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text.lower()), "</s>"]


class Brute:
    """The model by the textbook, in dictionaries, with histories of any length."""

    def __init__(self, texts):
        sents = [_sentence(t) for t in texts]
        self.c = {n: Counter(tuple(s[i - n + 1 : i + 1]) for s in sents for i in range(2, len(s))) for n in (1, 2, 3)}
        self.d = {n: _discounts(c.values()) for n, c in self.c.items()}
        self.follow = defaultdict(dict)
        for n in self.c:
            for g, c in self.c[n].items():
                self.follow[g[:-1]][g[-1]] = c

    def part(self, h, c):
        seen, d = self.follow[h], self.d[len(h) + 1]
        whole = not any(d[min(x, katz.CUT + 1)] < 1 for x in seen.values())
        return d[min(c, katz.CUT + 1)] * c / (sum(seen.values()) + whole)

    def p(self, h, w):
        seen = self.follow.get(h)
        if seen is None:
            return self.p(h[1:], w) if h else 1.0
        if w in seen:
            return self.part(h, seen[w])
        left = 1 - sum(self.part(h, c) for c in seen.values())
        return left / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w) if h else left

    def tokens(self, text):
        s = _sentence(text)
        return [math.log(self.p((s[i - 2], s[i - 1]), s[i])) for i in range(2, len(s))]


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def _folds(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r["doc_id"]: r["f"] for r in df.select("doc_id", katz.fold_of(F.col("doc_id"), df.schema["doc_id"].dataType).alias("f")).collect()}


@pytest.mark.parametrize("sizes", [{}, SMALL, {**SMALL, "hot_tokens": 0}], ids=["one bucket", "many buckets", "all words hot"])
def test_cross_scores_against_brute_force(spark, sizes):
    ids = [k * 37 for k in range(len(TEXTS))]
    fold = _folds(spark, ids)
    assert len(set(fold.values())) > 1
    docs = spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "doc_id long, text string").repartition(3)
    model = katz.train(docs, **sizes)
    assert model.buckets > 1 or not sizes
    got = {r["id"]: r for r in katz.scores(model).collect()}
    assert set(got) == set(ids)
    backed = 0
    for i, t in zip(ids, TEXTS, strict=True):
        brute = Brute([x for k, x in zip(ids, TEXTS, strict=True) if fold[k] != fold[i]])
        want = brute.tokens(t)
        s = _sentence(t)
        backed += sum(tuple(s[j - 2 : j + 1]) not in brute.c[3] for j in range(2, len(s)))
        assert got[i]["n_tokens"] == len(want) and got[i]["logprob"] == pytest.approx(sum(want), abs=1e-4)
    assert backed > 20


NEW = ["a b never seen", "z z z", "unknown", "", "f g a", "e a b d q", "a b"]


def test_other_documents_against_brute_force(spark):
    brute = Brute(TEXTS)
    for r in katz.score(_frame(spark, NEW), _frame(spark, TEXTS), each=True).collect():
        assert r["logprob"] == pytest.approx(brute.tokens(NEW[r["id"]])[r["place"]], abs=2e-6)
    got = {r["id"]: r for r in katz.score(_frame(spark, NEW), _frame(spark, TEXTS)).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(_sentence(t)) - 2 for i, t in enumerate(NEW)}


@pytest.mark.parametrize("history", ["a b", "x y", "a never", "never ever", "e f", "", "a"])
def test_tables_are_normalised(spark, history):
    """After a history, the probabilities that the tables give to all words and to an unseen one add up to 1."""
    words = sorted({w for t in TEXTS for w in _sentence(t)[2:-1]})
    texts = [f"{history} {w}" for w in [*words, "unheardof"]] + [history]
    place = len(history.split())
    got = katz.score(_frame(spark, texts), _frame(spark, TEXTS), each=True).where(F.col("place") == place).collect()
    assert len(got) == len(texts)
    assert sum(math.exp(r["logprob"]) for r in got) == pytest.approx(1, abs=1e-5)


def test_long_texts_in_pieces(spark):
    texts = [" ".join(f"w{(7 * k) % 23}" for k in range(120)), "w1 w2", "", "w7 w14"]
    docs = _frame(spark, texts)
    whole = {r["id"]: r["logprob"] for r in katz.scores(katz.train(docs)).collect()}
    cut = {r["id"]: r["logprob"] for r in katz.scores(katz.train(docs, chunk_tokens=20, bucket_tokens=15)).collect()}
    assert whole == cut


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x y z"), ("c", None)], "doc_id string, text string")
    assert {r["id"]: r["n_tokens"] for r in katz.cross_scores(docs).collect()} == {"a": 3, "b": 4}


def test_awkward_rows(spark):
    got = {r["id"]: r for r in katz.cross_scores(awkward(spark)).collect()}
    assert set(got) == {2, 3, 4, 6, 7, 8}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == 1
    assert got[6]["n_tokens"] == 5 + 5 + 5 and got[4]["n_tokens"] == 80_001
    assert katz.cross_scores(empty(spark)).count() == 0


def test_empty_model_and_nulls(spark):
    got = katz.score(_frame(spark, ["a b", None]), _frame(spark, [])).collect()
    assert [(r["id"], r["n_tokens"], r["logprob"]) for r in got] == [(0, 3, 0.0)]
    assert katz.score(_frame(spark, [None]), _frame(spark, TEXTS)).count() == 0
