"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: positions marked 1 must agree, the
others are ignored, so a passage whose words were partly replaced still shares
seeds with its source.  The masked windows of the benchmark are hashed under every
mask and so is every window of the training texts; equal hashes are hits.  Around
each hit the words of the window, widened by EXTEND words on either side as far as
item and document go, are compared one by one; the overlap is verified when at
least MIN_SHARE of them agree, or of a part of them that holds the window: an excerpt
may end in mid-item.  An item shorter than the masks is seeded at its whole length,
by masks that leave out any places that MIN_SHARE lets differ, and verified whole.  An item of fewer
than SHORTEST words says too little to name a passage: it overlaps nothing and is listed by ``unusable``.
Hits are verified HITS at a time, of which the best overlap of each text and item is kept, so
repetitive texts against repetitive items take time but no more memory.

The benchmark is broadcast in slices of at most SLICE_WORDS words, each checked for
size; a larger benchmark takes several slices and as many passes over the texts, so
nothing that is broadcast grows with the data, and the training texts are never shuffled.

Defined cases.  A null or empty text, or one without a word, overlaps nothing, and
so does a null or empty item.  A document without an id is compared and reported
with a null id.  Repeated rows, in either table, give the same finding once.
Between overlaps of one item and one document a fully widened one, then the one with most agreeing words, then
the first in the document, then the first in the item is reported.  An empty table
on either side gives no findings.  Extra columns of any name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm._text import Words, arrow_batches, chunks, hash_words, map_rows, mix64, named, unused, windows

MASKS = ("110110101111", "111010011011", "101101110011", "111100110101")
EXTEND = 4
MIN_SHARE = 0.75
#: Words that an item needs.
SHORTEST = 6
#: Hits that are verified together.
HITS = 1 << 17
SLICE_WORDS = 1_000_000
_FILTER_BITS = 22

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Slice:
    """Seeds of some items: sorted hashes, each with its item and word position; and the items' words."""

    masks: tuple[str, ...]
    seeds: np.ndarray
    item: np.ndarray
    at: np.ndarray
    ids: list
    words: np.ndarray
    off: np.ndarray
    sieve: np.ndarray


def masked(h: np.ndarray, pos: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the words that ``mask`` keeps, for windows starting at ``pos``."""
    total = np.full(len(pos), hash_of_mask(mask), np.uint64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                total += h[pos + k] * _FACTORS[k % 256] * np.uint64(2 * (k // 256) + 1)
    return mix64(total)


def hash_of_mask(mask: str) -> np.uint64:
    return hash_words(pa.array([mask])).h[0]


def short_masks(n: int) -> tuple[str, ...]:
    """Masks of length ``n`` of which one at least keeps only agreeing words wherever MIN_SHARE of them agree."""
    holes = int(n * (1 - MIN_SHARE))
    block = np.arange(n) * (holes + 2) // n
    return tuple("".join("0" if b in out else "1" for b in block) for out in combinations(range(holes + 2), holes))


def build_slice(ids: list, texts: list[str], masks: tuple[str, ...] = MASKS) -> Slice:
    words = hash_words(pa.array(texts, pa.string()))
    span = max(map(len, masks))
    count = np.diff(words.off)
    short = sorted({int(c) for c in count if c < span})
    all_masks = tuple(masks) + tuple(m for c in short for m in short_masks(c))
    seeds, item, at = [], [], []
    for m in all_masks:
        pos, doc = windows(words.h, words.off, len(m))
        if m not in masks:
            own = count[doc] == len(m)
            pos, doc = pos[own], doc[own]
        else:
            own = count[doc] >= span
            pos, doc = pos[own], doc[own]
        seeds.append(masked(words.h, pos, m))
        item.append(doc)
        at.append(pos - words.off[doc])
    seeds, item, at = (np.concatenate(x) for x in (seeds, item, at))
    order = np.argsort(seeds, kind="stable")
    sieve = np.zeros(1 << _FILTER_BITS, bool)
    sieve[(seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Slice(all_masks, seeds[order], item[order], at[order], list(ids), words.h, words.off, sieve)


def slices(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[Slice]:
    """The distinct items in slices of at most ``limit`` words (one item at least)."""
    ids, texts, total = [], [], 0
    rows = benchmark.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).where("text is not null").distinct().orderBy("id", "text")
    for r in rows.toLocalIterator():
        n = len(hash_words(pa.array([r["text"]])).h)
        if n < SHORTEST:
            continue
        if ids and total + n > limit:
            yield build_slice(ids, texts)
            ids, texts, total = [], [], 0
        ids.append(r["id"])
        texts.append(r["text"])
        total += n
    if ids:
        yield build_slice(ids, texts)


def unusable(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n_words) of the items that are too short to be looked for; null and empty ones have no words."""
    arrow_batches(benchmark.sparkSession)
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n = np.diff(hash_words(x.column(1)).off)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(n.astype(np.int64))], names=["item_id", "n_words"]).filter(pa.array(n < SHORTEST))

    return benchmark.select(named(id_col).alias("item_id"), F.lower(named(text_col)).alias("text")).mapInArrow(run, f"item_id {kind}, n_words long")


def overlaps(texts: pa.Array, s: Slice) -> tuple[np.ndarray, ...]:
    """(text, item, start in text, start in item, words, agreeing) of every verified overlap, best per text and item."""
    found = []
    for a, b in chunks(texts):
        words = hash_words(texts.slice(a, b - a))
        count = np.diff(words.off)
        for m in s.masks:
            pos, doc = windows(words.h, words.off, len(m))
            if not len(pos):
                continue
            key = masked(words.h, pos, m)
            some = np.flatnonzero(s.sieve[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            if not len(some):
                continue
            key, pos, doc = key[some], pos[some], doc[some]
            lo, hi = np.searchsorted(s.seeds, key, "left"), np.searchsorted(s.seeds, key, "right")
            for c, e in _shares(hi - lo):
                found.append(_verify(words, count, doc[c:e], pos[c:e], lo[c:e], hi[c:e], s, len(m), a))
                if sum(map(len, found)) > HITS:
                    found = [_best(np.concatenate(found))]
    rows = _best(np.concatenate(found)) if found else np.zeros((0, 7), np.int64)
    return tuple(rows.T[:6])


def _shares(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of windows with at most HITS hits (one window at least)."""
    total = np.cumsum(many)
    a = 0
    while a < len(many):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, side="right")))
        yield a, b
        a = b


def _best(rows: np.ndarray) -> np.ndarray:
    """Of each text and item the overlap that is reported."""
    rows = rows[np.lexsort((-rows[:, 4], rows[:, 3], rows[:, 2], -rows[:, 5], rows[:, 6], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def _verify(words: Words, count: np.ndarray, doc: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, s: Slice, n: int, base: int) -> np.ndarray:
    """The verified overlaps around the hits of some windows of ``n`` words: text, item, starts, words, agreeing, and 1 for a part."""
    many = hi - lo
    hit = np.repeat(np.arange(len(many)), many)
    seed = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    d, i = doc[hit], s.item[seed]
    p, q = pos[hit] - words.off[d], s.at[seed]
    size = s.off[i + 1] - s.off[i]
    back = np.minimum(EXTEND, np.minimum(p, q))
    ahead = np.minimum(EXTEND, np.minimum(count[d] - p, size - q) - n)
    start, item_start, wide = p - back, q - back, n + back + ahead
    k = np.repeat(np.arange(len(hit)), wide)
    step = np.arange(len(k)) - np.repeat(np.cumsum(wide) - wide, wide)
    same = words.h[words.off[d[k]] + start[k] + step] == s.words[s.off[i[k]] + item_start[k] + step]
    agree = np.bincount(k[same], minlength=len(hit))
    ok = agree >= MIN_SHARE * wide
    rows = np.stack((d + base, i, start, item_start, wide, agree, np.zeros(len(d), np.int64)), axis=1)[ok]
    if n >= 12 and not ok.all():
        at = np.zeros((len(hit), n + 2 * EXTEND), np.int64)
        at[k, step - back[k] + EXTEND] = same
        b, g, w = _part(at[~ok], n, back[~ok], ahead[~ok])
        part = np.stack(((d + base)[~ok], i[~ok], p[~ok] - b, q[~ok] - b, w, g, np.ones(len(g), np.int64)), axis=1)
        rows = np.concatenate((rows, part[g > 0]))
    return rows


def _part(same: np.ndarray, n: int, back: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words back, agreeing, words) of the part around each window of ``n`` words in which MIN_SHARE agree, with most agreeing and then fewest words; 0 agreeing if none does."""
    left, right = (np.cumsum(x, axis=1) for x in (same[:, EXTEND - 1 :: -1], same[:, EXTEND + n :]))
    core = same[:, EXTEND : EXTEND + n].sum(1)
    best = np.zeros((3, len(core)), np.int64)
    for b in range(EXTEND + 1):
        for e in range(EXTEND + 1):
            g = core + (left[:, b - 1] if b else 0) + (right[:, e - 1] if e else 0)
            w = n + b + e
            better = (b <= back) & (e <= ahead) & (g >= MIN_SHARE * w) & ((g > best[1]) | ((g == best[1]) & (w < best[2])))
            best[:, better] = np.stack((np.full(len(g), b), g, np.full(len(g), w)))[:, better]
    return best[0], best[1], best[2]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_agree): the best verified overlap of each document and item; starts count words from 0."""
    spark = docs.sparkSession
    arrow_batches(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, doc_start long, item_start long, n_words long, n_agree long"
    slim = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    out = None
    for s in slices(benchmark, item_col, item_text, slice_words):
        sent = spark.sparkContext.broadcast(s)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for x in batches:
                d, i, *rest = overlaps(x.column(1), own)
                if len(d):
                    ids = pa.array([own.ids[k] for k in i], benchmark_type)
                    yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(d)), ids, *map(pa.array, rest)], names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_agree"])

        benchmark_type = _arrow_type(benchmark, item_col)
        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.row_number().over(_best_window())
    return out.distinct().withColumn("__r", best).where("__r = 1").drop("__r")


def _best_window():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "item_id").orderBy(F.desc("n_agree"), "doc_start", "item_start", F.desc("n_words"))


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no benchmark item, with all their columns."""
    spark = docs.sparkSession
    arrow_batches(spark)
    names = docs.columns
    out = docs.withColumn(unused(docs, "__lower"), F.lower(F.col(text_col)))
    for s in slices(benchmark, item_col, item_text, slice_words):
        sent = spark.sparkContext.broadcast(s)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for x in batches:
                d = overlaps(x.column(x.num_columns - 1), sent.value)[0]
                clean = np.ones(x.num_rows, bool)
                clean[d] = False
                yield x.filter(pa.array(clean))

        out = map_rows(out, run)
    return out.select(*map(named, names))
