import numpy as np
import pyarrow as pa
import pytest

from quarrystone.llm import order_minhash as O
from quarrystone.llm._text import hash_words, mix64

from .common import LONG, awkward, empty


def _brute(text, k=O.K, l=O.L, m=O.M):
    """The signature of one text, k-mer by k-mer with Python's own integers."""
    mask = (1 << 64) - 1
    mix = lambda v: int(mix64(np.array([v & mask], np.uint64))[0])
    h = [int(x) for x in hash_words(pa.array([text])).h]
    if not h:
        return None
    grams = [h[p : p + k] for p in range(len(h) - k + 1)] or [h]
    codes = [mix(sum(x * int(O._PLACE[j]) for j, x in enumerate(g))) for g in grams]
    seen, marked = {}, []
    for c in codes:
        marked.append(mix(c + seen.get(c, 0) * int(O._OCCURRENCE)))
        seen[c] = seen.get(c, 0) + 1
    out = []
    for s in range(m):
        def value(x):
            y = ((x ^ int(O._SEEDS[s])) * int(O._SEEDS[(s + 128) % 256])) & mask
            y ^= y >> 32
            return (y * int(O._SEEDS[(s + 64) % 256])) & mask
        chosen = sorted(sorted(range(len(marked)), key=lambda p: (value(marked[p]), p))[:l])
        total = int(O._SEEDS[255])
        for p in chosen:
            total = mix(total * int(O._PLACE[1]) + codes[p])
        out.append(total)
    return out


@pytest.mark.parametrize("text", ["a b c d e f g", "a b c a b c a b c a b c", "one", "one two", "Ünï çödé wörds ünï", "a a a a a a a"])
def test_against_brute_force(text):
    sig, has = O.signatures(pa.array([text, "other words", text]))
    assert has.all() and sig[0].tolist() == _brute(text) and (sig[0] == sig[2]).all()


def test_order_matters_more_than_a_set():
    a = [f"w{k}" for k in range(120)]
    moved = a[60:] + a[:60]
    edited = a[:50] + ["new"] + a[50:]
    sig, _ = O.signatures(pa.array([" ".join(x) for x in (a, moved, edited)]), m=64)
    same = lambda i: (sig[0] == sig[i]).mean()
    assert same(2) > 0.8 and same(1) < same(2)


def test_awkward_rows(spark):
    got = O.fingerprint(awkward(spark)).collect()
    assert len(got) == 10 and all(r["signature"] is None or len(r["signature"]) == O.M for r in got)
    assert sum(r["signature"] is None for r in got) == 3
    assert len({tuple(r["signature"]) for r in got if r["doc_id"] == 7} | {tuple(r["signature"]) for r in got if r["doc_id"] == 6}) == 2
    assert O.fingerprint(empty(spark)).count() == 0
    sig, _ = O.signatures(pa.array([LONG]))
    assert (sig == O.signatures(pa.array(["x", LONG, None]))[0][1]).all()


def test_agreement_column(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 9, 4])], "a array<long>, b array<long>")
    assert df.select(O.agreement()).first()[0] == 0.75
