"""Language-model scores by Katz backoff over word trigrams.

Documents fall into FOLDS folds by their id.  Every document is counted, and each is scored by
the model of all folds but its own, so its own words don't vouch for it and n-grams that
the model never saw occur all the time.

Good-Turing discounts d(r), r up to CUT, come for every order from the numbers of n-grams seen
once, twice and so on; higher counts are kept as they are.
P(w) = d c(w) / N, what is left being the probability of a word never seen.
P(w | h) = d c(h w) / c(h) if h w was seen, else alpha(h) P(w | h'), h' being h without its
first word, where alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w | h') over the
same w) makes the probabilities after h add up to exactly 1; alpha is 1 if h wasn't seen.
A text is read after two start marks, and its end is a token.  ln P is kept in steps of 1 / SCALE,
so that sums don't depend on their order.

Tables, all in the shared folder.
unigrams: (w, c0, c1, ...), words being 63-bit hashes, counts by fold.
chunks: texts of one fold as word codes, CHUNK_TOKENS tokens in a row.  The most frequent word of each
of SLOTS slots has a small code; the others are listed in the chunk by their hashes.
ngrams: one row a bucket of about BUCKET_TOKENS tokens, holding what each chunk counted.  A
trigram u v w goes to the bucket of v, so a bucket holds all that follows v, and with it both
backoffs of its trigrams.  Of the words v above HOT_TOKENS (and one in HOT_WORDS tokens, so
their list is bounded) the trigrams are spread by u and v; the buckets that share such a word ask for the
counts of its bigrams, which are added up by bigram.  Chunks count before anything is sent, so a
trigram that makes up a third of the corpus is one row a chunk.

Scoring.  A bucket merges its chunks' counts, evaluates the recursion for every distinct trigram
of every chunk and answers in the chunk's own order; the chunk adds its answers up by document.

Defined cases.  A null text isn't counted and has no score; an empty one has one token, its
end.  Rows without an id count in the corpus (fold 0) but get no score; rows that
share an id are scored together.  Ids may be of any type: other than integers, they go to folds by a checksum.
Where the numbers of counts allow no discount (one is zero, or the formula leaves
(0, 1]) a count is kept whole; if that leaves a history nothing for unseen words, its counts
are divided by one more than their sum.  If the other folds are empty, each word has probability 1.
An empty table gives empty tables and results; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm._text import arrow_batches, chunks, hash_words, mix64, named, release
from quarrystone.session import cleaning, discard, materialize, scratch_path

CUT = 5
FOLDS = 2
SCALE = 1_000_000
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
#: Tokens in a chunk, of which a piece of one text is at most one in PIECES, and tokens in a bucket on average.
CHUNK_TOKENS = 400_000
PIECES = 5
BUCKET_TOKENS = 250_000
#: Rounds in which buckets are evaluated, so that only a part of them is shuffled at a time.
ROUNDS = 4
#: A word's trigrams are spread if it is more frequent than this and than one in HOT_WORDS tokens.
HOT_TOKENS = 250_000
HOT_WORDS = 1 << 20
#: Bytes of text that are hashed at a time.
TEXT_BYTES = 1 << 18
START, END = np.uint64(1), np.uint64(2)
_FREQUENT = np.uint64(1 << 20)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fold_of(doc_id: Column, kind: T.DataType, folds: int = FOLDS) -> Column:
    """The fold of an id; null ids are in the first."""
    if isinstance(kind, T.IntegralType):
        mixed = F.shiftright(F.pmod(doc_id.cast("long"), F.lit(1 << 20)) * F.lit(40503), 10)
        fold = F.pmod(mixed, F.lit(folds))
    else:
        fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(fold, F.lit(0)).cast("int")


def word_ids(h: np.ndarray) -> np.ndarray:
    """63-bit words; the few that look like slots or marks are moved up."""
    w = h >> np.uint64(1)
    return np.where(w < _FREQUENT, w + _FREQUENT, w)


def slot_of(words: np.ndarray) -> np.ndarray:
    return np.where(words <= END, words - START, words >> np.uint64(63 - SLOT_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Slots:
    """The code of each slot, the word of each code (0: none) and its counts by fold; and the hot words, sorted, with theirs.

    Codes go by frequency, so that those of frequent words are small and compress well.
    """

    code: np.ndarray
    word: np.ndarray
    count: np.ndarray
    hot: np.ndarray
    hot_count: np.ndarray

    def codes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A code for every word, and the sorted words that those from SLOTS on stand for."""
        code = self.code[slot_of(words)]
        other = np.flatnonzero(self.word[code] != words)
        rare, back = np.unique(words[other], return_inverse=True)
        code[other] = SLOTS + back
        return code, rare

    def hot_index(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in the list of hot ones, or -1."""
        if not len(self.hot):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, at, -1)

    def words_of(self, rare: np.ndarray) -> np.ndarray:
        """The word of each code, given those beyond the slots."""
        return np.concatenate((self.word, rare))


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r from 0 to CUT + 1, given n[r], the number of n-grams seen r times; d of more is the last, 1."""
    d = np.ones(CUT + 2)
    if n[1] and (a := (CUT + 1) * n[CUT + 1] / n[1]) < 1:
        for r in range(1, CUT + 1):
            if n[r] and n[r + 1]:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
                if 0 < x <= 1:
                    d[r] = x
    return d


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as one compressed block, byte planes apart."""
    head = struct.pack("<i", len(columns)) + b"".join(struct.pack("<cbi", c.dtype.char.encode(), c.itemsize, len(c)) for c in columns)
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    count, at = struct.unpack_from("<i", raw)[0], 4
    kinds = [struct.unpack_from("<cbi", raw, at + 6 * k) for k in range(count)]
    at, out = at + 6 * count, []
    for kind, wide, n in kinds:
        planes = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n)
        out.append(np.ascontiguousarray(planes.T).view(np.dtype(kind.decode())).reshape(n))
        at += n * wide
    return out


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, first row of each group), groups in the order of the columns' values."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = [max(1, int(c.max()).bit_length()) for c in columns]
    new = np.ones(n, bool)
    if sum(bits) <= 63:
        key = columns[0].astype(np.int64)
        for c, b in zip(columns[1:], bits[1:], strict=True):
            key = (key << b) | c
        order = np.argsort(key)
        key = key[order]
        new[1:] = key[1:] != key[:-1]
    else:
        order = np.lexsort(columns[::-1])
        new[1:] = np.logical_or.reduce([(c[order[1:]] != c[order[:-1]]) for c in columns])
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


# Unigrams


def _unigrams(batches: Iterator[pa.RecordBatch], folds: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, texts = 0, np.zeros(folds, np.int64)

    def merged() -> pa.RecordBatch:
        w, f, c = (np.concatenate([h[k] for h in held]) for k in range(3))
        held.clear()
        u, back = np.unique(w, return_inverse=True)
        by = np.bincount(back * folds + f, c, minlength=folds * len(u)).astype(np.int64).reshape(-1, folds)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *(pa.array(by[:, k].copy()) for k in range(folds))], names=["w", *(f"c{k}" for k in range(folds))])

    for x in batches:
        fold = x.column(1).to_numpy()
        for a, b in chunks(x.column(0), TEXT_BYTES):
            words = hash_words(x.column(0).slice(a, b - a))
            of = np.repeat(fold[a:b], np.diff(words.off))
            h = word_ids(words.h)
            for k in range(folds):
                u, c = np.unique(h[of == k], return_counts=True)
                held.append((u, np.full(len(u), k), c))
                size += len(u)
        texts += np.bincount(fold, minlength=folds)
        if size > 500_000:
            yield merged()
            size = 0
    release()
    if texts.any():
        for k in range(folds):
            held.append((np.array([START, END]), np.array([k, k]), np.array([texts[k], texts[k]])))
        yield merged()


# Chunks of texts


def _sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts, each text after two start marks and before its end; and how many it predicts."""
    words = hash_words(texts)
    n = np.diff(words.off) + 1
    seq = np.full(int((n + 2).sum()), START)
    ends = np.cumsum(n + 2)
    inner = np.ones(len(seq), bool)
    starts = ends - n - 2
    inner[starts] = inner[starts + 1] = inner[ends - 1] = False
    seq[inner] = word_ids(words.h)
    seq[ends - 1] = END
    return seq, n


def _pieces(ids: pa.Array, seq: np.ndarray, n: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Long texts in pieces, each with the two words before it."""
    if not len(n) or n.max() <= most:
        return ids, seq, n
    take, parts, lens, at = [], [], [], 0
    for k, size in enumerate(n.tolist()):
        for a in range(0, size, most):
            b = min(size, a + most)
            take.append(k)
            lens.append(b - a)
            parts.append(seq[at + a : at + b + 2])
        at += size + 2
    return ids.take(pa.array(take)), np.concatenate(parts), np.array(lens)


def _chunk_rows(batches: Iterator[pa.RecordBatch], slots: Slots, folds: int, chunk_tokens: int) -> Iterator[pa.RecordBatch]:
    """(chunk, fold, ids, lens, codes, rare) of the texts of a task."""
    task, made = TaskContext.get().partitionId(), 0
    held: list[list[tuple[pa.Array, np.ndarray, np.ndarray]]] = [[] for _ in range(folds)]
    size = [0] * folds

    def flush(f: int) -> pa.RecordBatch:
        nonlocal made
        ids = pa.concat_arrays([h[0] for h in held[f]])
        seq, n = (np.concatenate([h[k] for h in held[f]]) for k in (1, 2))
        held[f].clear()
        size[f] = 0
        made += 1
        codes, rare = slots.codes(seq)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        values = [pa.array([task << 24 | made]), pa.array([f], pa.int32()), one(ids), one(pa.array(n.astype(np.int32))), pa.array([pack(codes)], pa.binary()), pa.array([pack(rare)], pa.binary())]
        return pa.RecordBatch.from_arrays(values, names=["chunk", "fold", "ids", "lens", "codes", "rare"])

    for x in batches:
        for a, b in chunks(x.column(1), TEXT_BYTES):
            fold = x.column(2).slice(a, b - a).to_numpy()
            seq, n = _sequences(x.column(1).slice(a, b - a))
            of = np.repeat(fold, n + 2)
            for f in np.unique(fold).tolist():
                own = fold == f
                ids, s, m = _pieces(x.column(0).slice(a, b - a).filter(pa.array(own)), seq[of == f], n[own], max(1, chunk_tokens // PIECES))
                start, first = 0, 0
                total = np.cumsum(m)
                while first < len(m):
                    room = chunk_tokens - size[f] + (total[first - 1] if first else 0)
                    last = max(first + 1, int(np.searchsorted(total, room, side="right")))
                    stop = start + int((m[first:last] + 2).sum())
                    held[f].append((ids.slice(first, last - first), s[start:stop], m[first:last]))
                    size[f] += int(m[first:last].sum())
                    first, start = last, stop
                    if size[f] >= chunk_tokens or first < len(m):
                        yield flush(f)
    for f in range(folds):
        if held[f]:
            yield flush(f)
    release()


class Chunk:
    """A chunk read back: its tokens' codes and those of the two words before, and what it was told."""

    def __init__(self, row: dict, slots: Slots, rare_parts: int):
        self.rare_parts = rare_parts
        self.number, self.fold, self.ids, self.slots = row["chunk"], row["fold"], row["ids"], slots
        self.n = row["lens"].to_numpy().astype(np.int64)
        (codes,), (self.rare,) = unpack(row["codes"]), unpack(row["rare"])
        inner = np.ones(len(codes), bool)
        starts = np.cumsum(self.n + 2) - self.n - 2
        inner[starts] = inner[starts + 1] = False
        at = np.flatnonzero(inner).astype(np.int32)
        # 32 bits do for codes; keys are made of them in 64
        self.u, self.v, self.w = (codes[at - k].astype(np.int32) for k in (2, 1, 0))
        self.words = slots.words_of(self.rare)
        self.hot_word = slots.hot_index(self.words)
        self.told = dict(zip(row["parts"], row["told"], strict=True))

    @cached_property
    def rare_count(self) -> np.ndarray:
        """The counts by fold of the listed words."""
        if not len(self.rare):
            return np.zeros((0, self.slots.count.shape[1]), np.int64)
        return self.answered(*_rare_parts(self.rare, self.rare_parts))

    def answered(self, parts: np.ndarray, order: np.ndarray) -> np.ndarray:
        """What all parts told, one row for each of the questions that ``parts`` and ``order`` describe."""
        blocks = [np.stack(unpack(self.told[p]), axis=1) for p in np.unique(parts).tolist()]
        out = np.empty((len(parts), blocks[0].shape[1] if blocks else 1), blocks[0].dtype if blocks else np.int64)
        if blocks:
            out[order] = np.concatenate(blocks)
        return out

    def trigrams(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group of each token, first token of each group) of the distinct trigrams, by v, u and w; the bucket; the order of buckets."""
        group, first = grouped(self.v, self.u, self.w)
        v, u = self.v[first], self.u[first]
        hot = self.hot_word[v] >= 0
        spread = mix64(self.words[v] * _ODD)
        spread[hot] = mix64(spread[hot] + self.words[u[hot]] * _ODD)
        bucket = (spread % np.uint64(buckets)).astype(np.int64)
        return group, first, bucket, np.argsort(bucket, kind="stable")

    def listed(self, *codes: np.ndarray) -> np.ndarray:
        """The words of those codes that no other chunk knows, in order of appearance."""
        return np.concatenate([self.rare[c[c >= SLOTS] - SLOTS] for c in codes])


def _cuts(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the runs of sorted parts."""
    edge = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)])) if len(parts) else [0]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(parts[a]), int(a), int(b)


def _plain(c: np.ndarray) -> np.ndarray:
    """Codes as they are sent: all words that no slot holds under one code."""
    return np.minimum(c, SLOTS).astype(np.uint32)


def _steps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two columns of codes, mostly in order, as the differences between rows."""
    key = _plain(x).astype(np.uint64) << np.uint64(SLOT_BITS + 1) | _plain(y)
    return np.diff(key, prepend=np.uint64(0))


def _trigram_block(block: bytes) -> list[np.ndarray]:
    steps, *rest = unpack(block)
    key = np.cumsum(steps)
    return [(key >> np.uint64(SLOT_BITS + 1)).astype(np.uint32), (key & np.uint64((2 << SLOT_BITS) - 1)).astype(np.uint32), *rest]


_ASK = "chunk long, part int, fold int, block binary"


def _asks(number: int, fold: int, blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(blocks)
    return pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array([p for p, _ in blocks], pa.int32()), pa.array([fold] * n, pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["chunk", "part", "fold", "block"])


def _ask_trigrams(chunk: Chunk, buckets: int) -> pa.RecordBatch:
    group, first, bucket, order = chunk.trigrams(buckets)
    c = np.bincount(group, minlength=len(first))
    first, bucket, c = first[order], bucket[order], c[order]
    u, v, w = chunk.u[first], chunk.v[first], chunk.w[first]
    blocks = []
    for p, a, b in _cuts(bucket):
        x, y, z = v[a:b], u[a:b], w[a:b]
        rare = z[z >= SLOTS] - SLOTS
        blocks.append((p, pack(_steps(x, y), _plain(z), c[a:b].astype(np.uint32), chunk.listed(x, y, z), *chunk.rare_count[rare].T)))
    return _asks(chunk.number, chunk.fold, blocks)


# What buckets answer


class Merged:
    """Blocks of one bucket under common codes: v, u, w, times of the rows of all blocks, the word of each code and the counts of the last words."""

    def __init__(self, blocks: list[list[np.ndarray]], words: int, slots: Slots):
        """``words``: how many of the leading columns are words' codes; a column follows, then the listed words and their counts, then others."""
        self.size = np.array([len(b[0]) for b in blocks])
        folds = slots.count.shape[1]
        rare, back = np.unique(np.concatenate([b[words + 1] for b in blocks]), return_inverse=True)
        self.word_count = np.concatenate((slots.count, np.zeros((len(rare), folds), np.int64)))
        columns: list[list[np.ndarray]] = [[] for _ in range(words)]
        at = 0
        for b in blocks:
            for k in range(words):
                c = b[k].astype(np.int64)
                miss = np.flatnonzero(c == SLOTS)
                c[miss] = SLOTS + back[at : at + len(miss)]
                at += len(miss)
                columns[k].append(c)
            # the last column's listed words bring their counts
            self.word_count[c[miss]] = np.stack(b[words + 2 : words + 2 + folds], axis=1)
        self.columns = [np.concatenate(c) for c in columns]
        self.times = np.concatenate([b[words] for b in blocks]).astype(np.int64)
        self.word = slots.words_of(rare)


def _without(c: np.ndarray) -> np.ndarray:
    """Counts of the model of each fold: all but the fold's own."""
    return c.sum(1, keepdims=True) - c


def _histogram(c: np.ndarray) -> np.ndarray:
    """How many n-grams each fold's model saw r times, r from 1 to CUT + 1: folds by r."""
    return np.stack([np.bincount(np.minimum(m, CUT + 2), minlength=CUT + 3)[1 : CUT + 2] for m in c.T])


def _answer_pairs(table: pa.Table, slots: Slots, d1: list[np.ndarray], divisor: np.ndarray, unseen: np.ndarray) -> pa.Table:
    """Counts by fold of the bigrams that buckets asked for; and, without a bucket, sums over each hot word's followers."""
    folds = slots.count.shape[1]
    raw = [unpack(b.as_py()) for b in table.column("block")]
    m = Merged([[b[1], b[0], *b[2:]] for b in raw], 1, slots)
    hot, w = m.times, m.columns[0]
    group, first = grouped(hot, w)
    own = [np.concatenate([b[3 + folds + k] for b in raw]) for k in range(folds)]
    c = np.stack([np.bincount(group, x, minlength=len(first)) for x in own], axis=1).astype(np.int64)
    blocks, at = [], 0
    for n in m.size.tolist():
        blocks.append(pack(*c[group[at : at + n]].T))
        at += n
    model = _without(c)
    head, of = np.unique(hot[first], return_inverse=True)
    p1 = _level(d1, divisor, unseen, _without(m.word_count[w[first]]))
    sums = []
    for k in range(folds):
        r = np.minimum(model[:, k], CUT + 2)
        by = np.bincount(of * (CUT + 3) + r, minlength=len(head) * (CUT + 3)).reshape(-1, CUT + 3)
        big = np.bincount(of, np.where(model[:, k] > CUT, model[:, k], 0), minlength=len(head))
        mass = np.bincount(of, np.where(model[:, k] > 0, p1[:, k], 0.0), minlength=len(head))
        sums += [*by[:, 1 : CUT + 2].T.astype(np.int64), big.astype(np.int64), mass]
    part = table.column("ask")[0].as_py()
    return pa.table([pa.array([*table.column("part").to_pylist(), None], pa.int32()), pa.array([part] * (len(blocks) + 1), pa.int32()), pa.array([*blocks, pack(head, *sums)], pa.binary())], names=["part", "ask", "block"])


def _level(d: np.ndarray, divisor: np.ndarray, unseen: np.ndarray, c: np.ndarray) -> np.ndarray:
    """P(w) in each fold's model, given the model's counts (words by folds)."""
    p = np.empty(c.shape)
    for k in range(c.shape[1]):
        p[:, k] = np.where(c[:, k] > 0, d[k][np.minimum(c[:, k], CUT + 1)] * c[:, k] / divisor[k], unseen[k])
    return p


_NGRAMS_ARROW = pa.schema([("part", pa.int32()), ("chunks", pa.list_(pa.int64())), ("folds", pa.list_(pa.int32())), ("blocks", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())), ("asks", pa.list_(pa.struct([("ask", pa.int32()), ("block", pa.binary())])))])
_NGRAMS = "part int, chunks array<long>, folds array<int>, blocks array<binary>, n array<long>, asks array<struct<ask: int, block: binary>>"


class Bucket:
    """The n-grams of a bucket: distinct trigrams by v, u, w with counts by fold, their pairs (v, u), bigrams (v, w) and words v."""

    def __init__(self, folds: np.ndarray, blocks: list[list[np.ndarray]], slots: Slots):
        m = self.m = Merged(blocks, 3, slots)
        v, u, w = m.columns
        del m.columns
        wide = slots.count.shape[1]
        self.group, first = grouped(v, u, w)
        self.v, self.u, self.w = v[first], u[first], w[first]
        of = np.repeat(folds, m.size)
        own = np.bincount(self.group * wide + of, m.times, minlength=len(first) * wide).astype(np.int64).reshape(-1, wide)
        new = np.ones(len(first), bool)
        new[1:] = (self.v[1:] != self.v[:-1]) | (self.u[1:] != self.u[:-1])
        self.pair = np.cumsum(new) - 1
        self.bigram, self.at = grouped(self.v, self.w)
        head = np.ones(len(self.at), bool)
        head[1:] = self.v[self.at][1:] != self.v[self.at][:-1]
        self.bigram_v, self.heads = np.cumsum(head) - 1, self.v[self.at][head]
        self.own2 = np.stack([np.bincount(self.bigram, own[:, k], minlength=len(self.at)) for k in range(wide)], axis=1).astype(np.int64)
        self.c3, self.c2 = _without(own), _without(self.own2)
        #: The bigrams of hot words, of which other buckets hold parts.
        hot = slots.hot_index(m.word[self.heads])
        self.shared = np.flatnonzero(hot[self.bigram_v] >= 0)
        self.hot = hot

    def histogram(self) -> np.ndarray:
        """Counts of counts, trigrams and then bigrams of words that aren't hot."""
        return np.concatenate((_histogram(self.c3), _histogram(self.c2[self.hot[self.bigram_v] < 0]))).astype(np.int64)

    def _parts(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[self.shared]
        part = (mix64(self.m.word[self.v[at]] * _ODD + self.m.word[self.w[at]]) % np.uint64(parts)).astype(np.int64)
        return part, np.argsort(part, kind="stable")

    def asks(self, parts: int) -> list[dict]:
        """What to ask of each part: hot word, follower and this bucket's own counts by fold."""
        part, order = self._parts(parts)
        rows, part = self.shared[order], part[order]
        out = []
        for p, a, b in _cuts(part):
            own = rows[a:b]
            w = self.w[self.at[own]]
            rare = w[w >= SLOTS]
            block = pack(self.hot[self.bigram_v[own]].astype(np.uint32), _plain(w), self.m.word[rare], *self.m.word_count[rare].T, *self.own2[own].T)
            out.append({"ask": p, "block": block})
        return out

    def told(self, answers: dict[int, bytes], parts: int) -> None:
        """Take in the whole counts of the bigrams of hot words."""
        part, order = self._parts(parts)
        blocks = [np.stack(unpack(answers[p]), axis=1) for p in np.unique(part).tolist()]
        if blocks:
            self.c2[self.shared[order]] = _without(np.concatenate(blocks).astype(np.int64))


@dataclass(frozen=True)
class Model:
    """The tables of a model, and what is of bounded size: slots, discounts, and sums over the followers of hot words."""

    unigrams: DataFrame
    chunks: DataFrame
    ngrams: DataFrame
    shared: DataFrame | None
    sent: object
    folds: int
    buckets: int
    parts: int
    rare_parts: int
    tokens: np.ndarray
    d: tuple[np.ndarray, np.ndarray, np.ndarray]
    divisor: np.ndarray
    unseen: np.ndarray
    hot: dict[str, np.ndarray]
    paths: tuple[str, ...]


def evaluate(b: Bucket, slots: Slots, d: tuple[np.ndarray, ...], divisor: np.ndarray, unseen: np.ndarray, hot: dict[str, np.ndarray], asked: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """ln P of the trigrams ``asked`` (places among the distinct ones), each in the model of ``fold``."""
    d1, d2, d3 = d
    if not len(b.v):
        return np.zeros(len(asked))
    p1 = _level(d1, divisor, unseen, _without(b.m.word_count[b.w[b.at]]))
    hot_head = b.hot
    is_hot = hot_head >= 0
    out = np.empty(len(asked))
    first = lambda group: np.flatnonzero(np.diff(group, prepend=-1))
    head_at, pair_at = first(b.bigram_v), first(b.pair)
    for k in range(b.c3.shape[1]):
        c2, c3 = b.c2[:, k], b.c3[:, k]
        kept = d2[k][np.minimum(c2, CUT + 1)]
        mine = kept * c2
        total = np.add.reduceat(c2, head_at).astype(float)
        mass = np.add.reduceat(mine, head_at)
        part = np.add.reduceat((kept < 1) & (c2 > 0), head_at, dtype=np.int32) > 0
        lower = np.add.reduceat(np.where(c2 > 0, p1[:, k], 0.0), head_at)
        for own, known in ((total, "total"), (mass, "mass"), (part, "part"), (lower, "lower")):
            own[is_hot] = hot[known][hot_head[is_hot], k]
        own = total + ~part
        alpha = np.where(total > 0, (1 - mass / own) / (1 - lower), 1.0)
        seen2 = mine / own[b.bigram_v]
        p2 = np.where(c2 > 0, seen2, alpha[b.bigram_v] * p1[:, k])
        kept = d3[k][np.minimum(c3, CUT + 1)]
        mine = kept * c3
        total = np.add.reduceat(c3, pair_at)
        part = np.add.reduceat((kept < 1) & (c3 > 0), pair_at, dtype=np.int32) > 0
        own = total + ~part
        lower = np.add.reduceat(np.where(c3 > 0, seen2[b.bigram], 0.0), pair_at)
        alpha = np.where(total > 0, (1 - np.add.reduceat(mine, pair_at) / own) / (1 - lower), 1.0)
        at = np.flatnonzero(fold == k)
        t = asked[at]
        pair = b.pair[t]
        out[at] = np.where(c3[t] > 0, mine[t] / own[pair], alpha[pair] * p2[b.bigram[t]])
    return np.log(out)


# The whole job


def _slots(counts: DataFrame, least: int, folds: int) -> Slots:
    """The most frequent word of each slot, and the hot words: at most SLOTS and HOT_WORDS rows come to the driver."""
    every = counts.withColumn("c", reduce(add, (F.col(f"c{k}") for k in range(folds))))
    marks = F.col("w") <= int(END)
    slot = F.when(marks, F.col("w") - 1).otherwise(F.shiftrightunsigned("w", 63 - SLOT_BITS))
    by = [f"c{k}" for k in range(folds)]
    best = every.where((F.col("c") > 1) | marks).groupBy(slot.alias("slot")).agg(F.max(F.struct(marks.alias("m"), F.col("c"), F.col("w"), *by)).alias("x")).select("slot", "x.w", *(f"x.{k}" for k in by))
    word, count = np.zeros(SLOTS, np.uint64), np.zeros((SLOTS, folds), np.int64)
    got = best.toArrow()
    at = got.column("slot").to_numpy()
    word[at] = got.column("w").to_numpy().view(np.uint64)
    for k, c in enumerate(by):
        count[at, k] = got.column(c).to_numpy()
    del got
    order = np.argsort(-count.sum(1), kind="stable")
    code = np.empty(SLOTS, np.uint32)
    code[order] = np.arange(SLOTS)
    hot = every.where(F.col("c") > least).where(F.col("w") != int(END)).orderBy("w").toPandas()
    return Slots(code, word[order], count[order], hot["w"].to_numpy(np.int64).view(np.uint64), hot[by].to_numpy(np.int64).reshape(-1, folds))


def _told(texts: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Each chunk in one row with what it was told: ``answers`` of (chunk, part, block), parts below 0 being counts of its listed words."""
    own = [F.col(c) for c in ("chunk", "fold", "ids", "lens", "codes", "rare")]
    rows = texts.select(*own, F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("block"))
    for x in answers:
        rows = rows.unionByName(x.select("chunk", "part", "block"), allowMissingColumns=True)
    kind = texts.schema["ids"].dataType.elementType.simpleString()

    def gather(t: pa.Table) -> pa.Table:
        part = t.column("part").to_pylist()
        base = part.index(None)
        told = [k for k, p in enumerate(part) if p is not None]
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        block = t.column("block")
        values = [t.column(c).slice(base, 1).combine_chunks() for c in ("chunk", "fold", "ids", "lens", "codes", "rare")]
        values += [one(pa.array([part[k] for k in told], pa.int32())), one(pa.array([block[k].as_py() for k in told], pa.binary()))]
        return pa.table(values, names=["chunk", "fold", "ids", "lens", "codes", "rare", "parts", "told"])

    return rows.groupBy("chunk").applyInArrow(gather, f"chunk long, fold int, ids array<{kind}>, lens array<int>, codes binary, rare binary, parts array<int>, told array<binary>")


def _each_chunk(told: DataFrame, slots, rare_parts: int, run, schema: str | T.StructType) -> DataFrame:
    """``run`` on every chunk; it returns a record batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in range(x.num_rows):
                row = {n: x.column(n)[k] for n in x.schema.names}
                row |= {n: row[n].as_py() for n in ("chunk", "fold", "codes", "rare", "parts", "told")} | {n: row[n].values for n in ("ids", "lens")}
                yield run(Chunk(row, slots.value, rare_parts))
                release()

    return told.mapInArrow(rows, schema)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: Column | None = None, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, hot_tokens: int = HOT_TOKENS) -> Model:
    """Count, discount and normalise over all of ``docs``; the tables stay in the shared folder.

    ``fold`` gives each row's fold, if not the one of its id.  The sizes don't change any result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    kind = docs.schema[id_col].dataType
    fold = fold_of(named(id_col), kind, folds) if fold is None else fold
    slim = docs.select(named(id_col).alias("id"), F.lower(named(text_col)).alias("text"), fold.alias("fold")).where("text is not null")
    by = [f"c{k}" for k in range(folds)]
    counted = slim.select("text", "fold").mapInArrow(lambda x: _unigrams(x, folds), "w long, " + ", ".join(f"{c} long" for c in by))
    unigrams, unigrams_path = materialize(counted.groupBy("w").agg(*(F.sum(c).alias(c) for c in by)), "unigrams")
    tokens, n1 = _unigram_figures(unigrams, folds)
    total = int(tokens.sum())
    d1 = [discounts([0, *n]) for n in n1]
    divisor, unseen = _unseen(d1, n1, tokens)
    slots = _slots(unigrams, max(hot_tokens, total // HOT_WORDS), folds)
    sent = spark.sparkContext.broadcast(slots)
    id_type = kind.simpleString()
    texts, texts_path = materialize(slim.select("id", "text", "fold").mapInArrow(lambda x: _chunk_rows(x, sent.value, folds, chunk_tokens), f"chunk long, fold int, ids array<{id_type}>, lens array<int>, codes binary, rare binary"), "chunks")
    buckets = max(1, -(-total // bucket_tokens))
    parts = max(1, -(-int(slots.hot_count.sum()) // (4 * bucket_tokens)))
    spent = []
    # tokens without a slot, of which an asking part is sent a chunk's distinct ones
    rare_parts = max(1, (total - int(slots.count.sum())) // (4 * bucket_tokens))
    rare, path = materialize(_rare_counts(texts, rare_parts, folds), "rare")
    spent += [texts_path, path]
    held, _ = materialize(_told(texts, [rare]), "chunks")
    for path in spent:
        discard(spark, path)
    asked = _each_chunk(held, sent, rare_parts, lambda c: _ask_trigrams(c, buckets), _ASK)

    def store(t: pa.Table) -> pa.Table:
        release()
        blocks = [b.as_py() for b in t.column("block")]
        b = Bucket(t.column("fold").to_numpy(), [_trigram_block(x) for x in blocks], sent.value)
        row = {"part": t.column("part")[0].as_py(), "chunks": t.column("chunk").to_pylist(), "folds": t.column("fold").to_pylist(), "blocks": blocks, "n": b.histogram().ravel().tolist(), "asks": b.asks(parts)}
        return pa.Table.from_pylist([row], _NGRAMS_ARROW)

    ngrams, ngrams_path = materialize(asked.groupBy("part").applyInArrow(store, _NGRAMS), "ngrams")
    paths = [unigrams_path, ngrams_path]
    answers, sums, hot_n = None, None, np.zeros((folds, CUT + 1), np.int64)
    if len(slots.hot):
        pairs = ngrams.select("part", F.explode("asks").alias("x")).select("part", "x.*")
        answers, path = materialize(pairs.groupBy("ask").applyInArrow(lambda t: _answer_pairs(t, sent.value, d1, divisor, unseen), "part int, ask int, block binary"), "hot")
        sums = _hot_sums(answers.where("part is null"), len(slots.hot), folds)
        hot_n = sums["n"].sum(0)
        answers = answers.where("part is not null")
        paths.append(path)
    size = 2 * folds * (CUT + 1)
    got = ngrams.agg(*(F.coalesce(F.sum(F.col("n")[k]), F.lit(0)).alias(f"n{k}") for k in range(size))).first()
    n3, n2 = np.array(list(got), np.int64).reshape(2, folds, CUT + 1)
    d2, d3 = ([discounts([0, *map(int, n)]) for n in x] for x in (n2 + hot_n, n3))
    return Model(unigrams, held, ngrams, answers, sent, folds, buckets, parts, rare_parts, tokens, (np.array(d1), np.array(d2), np.array(d3)), divisor, unseen, _hot_histories(sums, slots, np.array(d2), folds), tuple(paths))


def _unigram_figures(unigrams: DataFrame, folds: int) -> tuple[np.ndarray, list[list[int]]]:
    """Tokens of each fold, the end mark among them; and how many words each fold's model saw 1 to CUT + 1 times."""
    every = reduce(add, (F.col(f"c{k}") for k in range(folds)))
    columns = [F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(folds)]
    columns += [F.count_if(every - F.col(f"c{k}") == r) for k in range(folds) for r in range(1, CUT + 2)]
    got = list(unigrams.where(F.col("w") != int(START)).agg(*(c.alias(f"x{k}") for k, c in enumerate(columns))).first())
    return np.array(got[:folds], np.int64), np.array(got[folds:], np.int64).reshape(folds, CUT + 1).tolist()


def _unseen(d1: list[np.ndarray], n1: list[list[int]], tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each fold's model, what counts are divided by, and the probability of a word never seen."""
    divisor, unseen = np.ones(len(d1)), np.ones(len(d1))
    for k, n in enumerate(n1):
        total = int(tokens.sum() - tokens[k])
        if total:
            cut = sum((1 - float(d1[k][r])) * r * n[r - 1] for r in range(1, CUT + 1))
            divisor[k], unseen[k] = (total, cut / total) if cut > 0 else (total + 1, 1 / (total + 1))
    return divisor, unseen


def _rare_counts(texts: DataFrame, parts: int, folds: int) -> DataFrame:
    """(chunk, part, block): the counts by fold of each chunk's listed words; parts count down from -1."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in range(x.num_rows):
                number, fold = x.column(0)[k].as_py(), x.column(1)[k].as_py()
                (codes,), (rare,) = unpack(x.column(3)[k].as_py()), unpack(x.column(4)[k].as_py())
                # words before a piece belong to the piece before
                n = x.column(2)[k].values.to_numpy().astype(np.int64)
                codes = codes.copy()
                starts = np.cumsum(n + 2) - n - 2
                codes[starts] = codes[starts + 1] = 0
                c = np.bincount(codes[codes >= SLOTS] - SLOTS, minlength=len(rare)).astype(np.uint32)
                part, order = _rare_parts(rare, parts)
                rare, c = rare[order], c[order]
                blocks = [(p, pack(rare[a:b], c[a:b])) for p, a, b in _cuts(part[order])]
                yield _asks(number, fold, blocks)

    def answer(t: pa.Table) -> pa.Table:
        raw = [unpack(b.as_py()) for b in t.column("block")]
        size = [len(r[0]) for r in raw]
        fold = np.repeat(t.column("fold").to_numpy(), size)
        u, back = np.unique(np.concatenate([r[0] for r in raw]), return_inverse=True)
        c = np.bincount(back * folds + fold, np.concatenate([r[1] for r in raw]), minlength=len(u) * folds).astype(np.int64).reshape(-1, folds)[back]
        ends = np.cumsum(size)
        blocks = [pack(*c[b - n : b].T) for n, b in zip(size, ends, strict=True)]
        return pa.table([t.column("chunk"), t.column("part"), pa.array(blocks, pa.binary())], names=["chunk", "part", "block"])

    asked = texts.select("chunk", "fold", "lens", "codes", "rare").mapInArrow(ask, _ASK)
    return asked.groupBy("part").applyInArrow(answer, "chunk long, part int, block binary")


def _rare_parts(rare: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part that counts each listed word, and the order of parts."""
    part = -1 - (mix64(rare) % np.uint64(parts)).astype(np.int64)
    return part, np.argsort(part, kind="stable")


def _hot_sums(answers: DataFrame, size: int, folds: int) -> dict[str, np.ndarray]:
    """n (hot words by folds by r), big and lower, added up over the parts: one row for each hot word comes to the driver."""
    wide = CUT + 3
    names = [f"x{j}" for j in range(folds * wide)]
    kinds = ["double" if j % wide == wide - 1 else "long" for j in range(folds * wide)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for block in x.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in unpack(block.as_py())], names=["head", *names])

    rows = answers.select("block").mapInArrow(spread, "head long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    got = rows.groupBy("head").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    head = got.column("head").to_numpy()
    x = np.zeros((size, folds, wide))
    for j, n in enumerate(names):
        x[head, j // wide, j % wide] = got.column(n).to_numpy()
    return {"n": x[:, :, : CUT + 1].astype(np.int64), "big": x[:, :, CUT + 1], "lower": x[:, :, CUT + 2]}


def _hot_histories(sums: dict[str, np.ndarray] | None, slots: Slots, d2: np.ndarray, folds: int) -> dict[str, np.ndarray]:
    """total, mass, part and lower of each hot word in each fold's model."""
    total = _without(slots.hot_count).astype(float) if len(slots.hot) else np.zeros((0, folds))
    if sums is None:
        return {"total": total, "mass": total, "part": total > 0, "lower": total}
    r = np.arange(1, CUT + 1)
    mass = (sums["n"][:, :, :CUT] * (r * d2[:, 1 : CUT + 1])[None]).sum(2) + sums["big"]
    part = ((sums["n"][:, :, :CUT] > 0) & (d2[:, 1 : CUT + 1] < 1)[None]).any(2)
    return {"total": total, "mass": mass, "part": part, "lower": sums["lower"]}


def _answers(model: Model, asked: tuple[int, ...]) -> DataFrame:
    """(chunk, part, block): the scores of every chunk's distinct trigrams, bucket by bucket, in steps of 1 / SCALE."""
    sent, d, divisor, unseen, hot, parts = model.sent, model.d, model.divisor, model.unseen, model.hot, model.parts

    def run(t: pa.Table) -> pa.Table:
        release()
        asks = t.column("ask").to_pylist()
        k = asks.index(None)
        numbers, folds = (t.column(c)[k].values.to_numpy() for c in ("chunks", "folds"))
        b = Bucket(folds, [_trigram_block(y.as_py()) for y in t.column("blocks")[k].values], sent.value)
        b.told({p: t.column("block")[j].as_py() for j, p in enumerate(asks) if p is not None}, parts)
        of = np.repeat(folds, b.m.size)
        lp = np.rint(evaluate(b, sent.value, d, divisor, unseen, hot, b.group, of) * SCALE).astype(np.int32)
        rows, at = [], 0
        for n, f in zip(b.m.size.tolist(), folds.tolist(), strict=True):
            rows.append(pack(lp[at : at + n]) if f in asked else None)
            at += n
        return pa.table([pa.array(numbers), pa.array([t.column("part")[k].as_py()] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["chunk", "part", "block"])

    spark, found = model.ngrams.sparkSession, []
    path = scratch_path(spark, "answers")
    for k in range(ROUNDS):
        own = F.pmod(F.col("part"), F.lit(ROUNDS)) == k
        rows = model.ngrams.where(own).select("part", "chunks", "folds", "blocks", F.lit(None).cast("int").alias("ask"), F.lit(None).cast("binary").alias("block"))
        if model.shared is not None:
            rows = rows.unionByName(model.shared.where(own), allowMissingColumns=True)
        got = rows.groupBy("part").applyInArrow(run, "chunk long, part int, block binary").where("block is not null")
        with cleaning(spark):
            got.write.parquet(f"{path}/{k}")
        found.append(f"{path}/{k}")
    return spark.read.schema(got.schema).parquet(*found)


def scores(model: Model, asked: tuple[int, ...] | None = None, each: bool = False, keep: bool = True) -> DataFrame:
    """(id, n_tokens, logprob) of the documents of the folds ``asked`` (all), each under the model of the other folds; natural logarithms.

    With ``each``, (id, place, logprob) of every token instead.  Without ``keep``, the model's tables of n-grams are
    deleted as soon as they were read.
    """
    spark = model.chunks.sparkSession
    arrow_batches(spark)
    folds = tuple(range(model.folds)) if asked is None else asked
    sent, buckets = model.sent, model.buckets
    kind = model.chunks.schema["ids"].dataType.elementType

    def total(c: Chunk) -> pa.RecordBatch:
        group, _, bucket, order = c.trigrams(buckets)
        lp = c.answered(bucket, order)[:, 0].astype(np.int64)[group]
        if each:
            place = np.arange(len(lp)) - np.repeat(np.cumsum(c.n) - c.n, c.n)
            values = [c.ids.take(pa.array(np.repeat(np.arange(len(c.n)), c.n))), pa.array(place), pa.array(lp)]
        else:
            values = [c.ids, pa.array(c.n), pa.array(np.add.reduceat(lp, np.cumsum(c.n) - c.n))]
        return pa.RecordBatch.from_arrays(values, names=["id", "n_tokens", "lp"])

    answers = _answers(model, folds)
    if not keep:
        for path in model.paths:
            discard(spark, path)
    told = _told(model.chunks.where(F.col("fold").isin(*folds)), [answers])
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("lp", T.LongType())])
    rows = _each_chunk(told, sent, model.rare_parts, total, schema).where("id is not null")
    if each:
        return rows.select("id", F.col("n_tokens").alias("place"), (F.col("lp") / SCALE).alias("logprob"))
    return rows.groupBy("id").agg(F.sum("n_tokens").alias("n_tokens"), (F.sum("lp") / SCALE).alias("logprob"))


def cross_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """(id, n_tokens, logprob) of every document under the model of the folds it isn't in."""
    return scores(train(docs, id_col, text_col, folds), keep=False)


def score(docs: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", each: bool = False) -> DataFrame:
    """(id, n_tokens, logprob) of ``docs`` under the model of ``corpus``, both with the same columns."""
    slim = lambda df, f: df.select(named(id_col).alias("id"), named(text_col).alias("text"), F.lit(f).alias("fold"))
    both = slim(corpus, 0).unionByName(slim(docs, 1))
    return scores(train(both, "id", "text", 2, F.col("fold")), (1,), each, keep=False)
