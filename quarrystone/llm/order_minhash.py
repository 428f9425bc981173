"""Order MinHash fingerprints.

Each k-mer of words gets its occurrence number within the text, so repeats differ.  For
each of M hash functions the L k-mers of least hash are selected and put back
in text order, and their tuple is hashed.  Two texts agree in a slot only if they select
the same k-mers in the same order, so the share of agreeing slots falls with
insertions, deletions and moves: it is a sketch of the edit distance, where plain MinHash
sees only sets.  Texts are processed whole, as arrays; nothing is shuffled.

Defined cases.  A null text, an empty one or one without a word has a null signature.  A text
of fewer than K words is one k-mer; one with fewer than L k-mers uses all.  Equal texts have
equal signatures; rows are independent, so null or repeated ids and repeated rows
pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm._text import arrow_batches, chunks, hash_words, mix64

K = 3
L = 2
M = 16
_rng = np.random.default_rng(23)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SEEDS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_OCCURRENCE = np.uint64(0x8CB92BA72F3D8DD7)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmers(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, offsets) of the k-mers; a shorter text is one k-mer of all its words."""
    words = np.diff(off)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(words)), count)
    pos = np.arange(len(doc)) - first[doc] + off[doc]
    end = off[doc + 1]
    out = np.zeros(len(doc), np.uint64)
    for j in range(k):
        at = pos + j
        inside = at < end
        term = h[np.minimum(at, max(len(h) - 1, 0))] * _PLACE[j] if len(h) else out
        out += np.where(inside, term, np.uint64(0))
    return mix64(out), doc, first


def numbered(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often the k-mer occurred before in its text."""
    order = np.lexsort((code, doc)) if len(np.unique(doc)) > 1 else np.argsort(code, kind="stable")
    c, d = code[order], doc[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    run = np.arange(len(c)) - np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
    out = np.empty(len(c), np.int64)
    out[order] = run
    return out


def signatures(texts: pa.Array, k: int = K, l: int = L, m: int = M) -> tuple[np.ndarray, np.ndarray]:
    """(n x m signatures, whether a text has one)."""
    sig, has = np.zeros((len(texts), m), np.uint64), np.zeros(len(texts), bool)
    for a, b in chunks(texts):
        words = hash_words(texts.slice(a, b - a))
        code, doc, first = kmers(words.h, words.off, k)
        some = np.flatnonzero(np.diff(first))
        if not len(some):
            continue
        has[a + some] = True
        with np.errstate(over="ignore"):
            x = mix64(code + numbered(code, doc).astype(np.uint64) * _OCCURRENCE)
            starts, count = first[some], np.diff(first)[some]
            for s in range(m):
                y = (x ^ _SEEDS[s]) * _SEEDS[(s + 128) % 256]
                y ^= y >> np.uint64(32)
                y *= _SEEDS[(s + 64) % 256]
                chosen = np.full((len(some), l), -1, np.int64)
                for r in range(l):
                    low = np.minimum.reduceat(y, starts)
                    at = np.flatnonzero(y == np.repeat(low, count))
                    own = doc[at]
                    lead = np.ones(len(own), bool)
                    lead[1:] = own[1:] != own[:-1]
                    at, row = at[lead], np.searchsorted(some, own[lead])
                    left = count[row] > r
                    chosen[row[left], r] = at[left]
                    y[at] = _LAST
                chosen.sort(axis=1)
                total = np.full(len(some), _SEEDS[255], np.uint64)
                for r in range(l):
                    there = chosen[:, r] >= 0
                    total = np.where(there, mix64(total * _PLACE[1] + code[chosen[:, r]]), total)
                sig[a + some, s] = total
    return sig, has


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, l: int = L, m: int = M) -> DataFrame:
    """(id, signature): array<long> of ``m`` slots, null where the text has no word."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sig, has = signatures(x.column(1), k, l, m)
            off = pa.array(np.concatenate(([0], np.cumsum(np.where(has, m, 0)))).astype(np.int32))
            lists = pa.ListArray.from_arrays(off, pa.array(sig[has].view(np.int64).ravel()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([x.column(0), lists], names=[id_col, "signature"])

    return docs.select(F.col(id_col), F.lower(F.col(text_col)).alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, signature array<bigint>")


def agreement(a: str = "a", b: str = "b"):
    """The share of slots in which two signature columns agree."""
    same = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return same / F.size(F.col(a))
