"""Columnar word hashing shared by the corpus operators.

A word is a maximal run of ASCII letters and digits and of bytes >= 0x80 in the
UTF-8 text (so accented letters belong to words); ASCII capitals count as small
letters.  Words are hashed to 64 bits with numpy over Arrow buffers: a polynomial
prefix hash modulo 2**64 gives every word's value from two table reads, and a
finaliser spreads it.  Nothing here loops over words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.session import ship

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BI = np.uint64(pow(int(_B), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True

#: Bytes of text hashed at a time.  Working arrays take about 40 times as much.
CHUNK_BYTES = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Make the package known to the workers and keep Arrow batches small: texts may be long, memory short."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def named(name: str) -> Column:
    """A column by its exact name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns called like any of ``names`` (Spark doesn't tell capitals apart)."""
    gone = {n.lower() for n in names}
    return df.select(*(named(c) for c in df.columns if c.lower() not in gone))


def map_rows(df: DataFrame, run: Callable, added: str = "") -> DataFrame:
    """``df`` through an Arrow function that keeps all columns in place and appends ``added`` (DDL).

    Columns go by number within, as Spark's own call can't address every name.
    """
    safe = df.toDF(*(f"__{k}" for k in range(len(df.columns))))
    extra = T.StructType.fromDDL(added).fields if added else []
    return safe.mapInArrow(run, T.StructType(safe.schema.fields + extra)).toDF(*df.columns, *(f.name for f in extra))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in ((0, _B), (1, _BI)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser over uint64; wraps around."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def release() -> None:
    """Give freed memory back to the system, where its C library can: workers are kept between tasks, and with them what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """The words of some texts: ``h`` hashes, ``off`` where each text's words start (n+1)."""

    __slots__ = ("h", "off", "starts", "ends", "data")

    def __init__(self, h, off, starts, ends, data):
        self.h, self.off, self.starts, self.ends, self.data = h, off, starts, ends, data

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string array; a null counts as an empty text."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    _, where, data = texts.buffers()
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one text at least)."""
    _, off = buffers(texts)
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def hash_words(texts: pa.Array, lead: int = 0) -> Words:
    """Hash every word of every text (see the module's notes).

    With ``lead``, hash instead the first ``lead`` bytes of every word that is longer, and 0 for others.
    """
    raw, off = buffers(texts)
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(off), np.int64), z, z, raw)
    data = _LOWER[raw]
    w = _WORD[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    up, down = _tables(n)
    with np.errstate(over="ignore"):
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        until = np.minimum(ends, starts + lead) if lead else ends
        h = (prefix[until] - prefix[starts]) * down[starts]
        h = mix64(h + (until - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if lead:
            h = np.where(ends - starts > lead, mix64(h + np.uint64(lead)), np.uint64(0))
    return Words(h, np.searchsorted(starts, off), starts, ends, data)


def hash_word(word: str) -> int:
    """The hash of one word, as ``hash_words`` gives it."""
    got = hash_words(pa.array([word])).h
    return int(got[0]) if len(got) == 1 else 0


def windows(values: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the ``k``-word windows that stay within one text, and the text of each."""
    counts = np.maximum(np.diff(off) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    pos = np.arange(len(doc)) - first[doc] + off[:-1][doc]
    return pos, doc
