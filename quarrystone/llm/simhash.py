"""SimHash near-duplicates by a segment-popcount embedding.

A document's 128-bit fingerprint is the sign vector of the sum, over its distinct
words, of the words' random +-1 vectors.  The fingerprint is cut into 64 segments
of 2 bits and mapped to the vector of their bit counts, each 0, 1 or 2.  Flipping a
bit moves one count by one, so the Manhattan distance of two count vectors never
exceeds the Hamming distance of the fingerprints: it is a lower bound.

Range join.  Two vectors within Manhattan distance 23 agree within 2 on at least
one of 8 groups of 8 segments (8 groups at 3 or more would make 24).  A row's home
is the grid cell (group, sums of the counts of the group's two halves); it also
goes to the cells whose sums are up to 2 steps away, of each two opposite ones to one,
so each such pair meets where one of them is at
home, and only pairs with one at home are looked at.  In a cell, rows are matched with the count
vectors at distance 0 to 2 of their own; the pairs are filtered by the Manhattan distance over all segments (the popcount of XORed
thermometer codes) and then verified by the exact Hamming distance.  The join is
exact: no pair within the limit is lost, and no cell or partner count is capped.
The rows of each cell are counted first.  A cell of more than CELL_ROWS is worked on by several
tasks: each has a share of the rows at home, by a hash of their ids, and meets all rows of the cell.

Limit.  Two documents are near-duplicates when their fingerprints differ in at
most 23 bits.  ``length_ratio`` (off) asks besides that their numbers of distinct words differ by at most
that factor, and keeps cells for each class of lengths, which makes very large corpora cheaper.
Documents joined by a chain of such pairs form a group; the least id stands for it.

Defined cases.  A null or empty text, or one without a word, has no fingerprint and
is never a duplicate.  A row without an id is never a duplicate.  Rows that repeat
both id and text are one document.  Rows that share an id but not a text are
compared like others and keep that id; a group never names an id as its own
duplicate.  Ties are impossible, as ids are compared.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm._components import components
from quarrystone.llm._text import arrow_batches, chunks, hash_words, mix64
from quarrystone.session import materialize

BITS = 128
MAX_HAMMING = 23
GROUPS = 8
#: Rows that a task of the join meets, about.
CELL_ROWS = 1_000_000
#: What a group's count vectors may differ by: GROUPS * (NEAR + 1) > MAX_HAMMING.
NEAR = 2
_SPREAD = np.uint64(0xA24BAED4963EE407)
_EVEN = np.uint64(0x5555555555555555)


def fingerprint_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high word, low word, number of distinct words) of each text; number 0 where there is no word."""
    n = len(texts)
    out, size = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64)
    for a, b in chunks(texts):
        for c in range(a, b, 4096):
            d = min(b, c + 4096)
            _fingerprint(texts.slice(c, d - c), out[c:d], size[c:d])
    return out[:, 0], out[:, 1], size


def _fingerprint(texts: pa.Array, out: np.ndarray, size: np.ndarray) -> None:
    words = hash_words(texts)
    if not len(words.h):
        return
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(words.off))
    key = np.sort((doc << np.uint64(52)) | (words.h >> np.uint64(12)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    doc = (key >> np.uint64(52)).astype(np.int64)
    size[:] = np.bincount(doc, minlength=len(texts))
    h = key << np.uint64(12)
    pair = np.stack((mix64(h ^ _SPREAD), mix64(h + _SPREAD)), axis=1)
    for a, b in _blocks(size):
        lo, hi = size[:a].sum(), size[:b].sum()
        bits = np.unpackbits(pair[lo:hi].view(np.uint8).reshape(hi - lo, 16), axis=1)
        has = np.flatnonzero(size[a:b])
        if not len(has):
            continue
        first = (np.cumsum(size[a:b]) - size[a:b])[has]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        sign = 2 * ones > size[a:b][has][:, None]
        out[a + has] = np.packbits(sign, axis=1).view(np.uint64)


def _blocks(size: np.ndarray, limit: int = 1 << 16) -> Iterator[tuple[int, int]]:
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield a, b
        a = b


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n, f0, f1) of every row that has an id and a word; text_key is the text's 64-bit hash."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            f0, f1, n = fingerprint_texts(x.column(2))
            ok = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(n), pa.array(f0.view(np.int64)), pa.array(f1.view(np.int64))], names=["id", "text_key", "n", "f0", "f1"]).filter(ok)

    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.lower(F.col(text_col)).alias("text")).where("id is not null and text is not null")
    return slim.mapInArrow(run, f"id {kind}, text_key long, n long, f0 long, f1 long")


def _counts(f: np.ndarray) -> np.ndarray:
    """Per-segment bit counts, packed: field k of 2 bits holds 0, 1 or 2."""
    return (f & _EVEN) + ((f >> np.uint64(1)) & _EVEN)


def _thermometer(f: np.ndarray) -> np.ndarray:
    """Counts in unary (00, 01, 11), so that XOR and popcount give Manhattan distances."""
    low, high = f & _EVEN, (f >> np.uint64(1)) & _EVEN
    return (low | high) | ((low & high) << np.uint64(1))


_THREES = 3 ** np.arange(8, dtype=np.int64)
_DIGITS = (np.arange(3**8)[:, None] // _THREES) % 3
#: Of a code: the sums of the counts of its two halves, as the first plus ten times the second.
_PLACE = _DIGITS[:, :4].sum(1) + 10 * _DIGITS[:, 4:].sum(1)
#: Of 16 bits with a count in every two: the code.
_CODE = np.zeros(1 << 16, np.int64)
_CODE[(_DIGITS << (2 * np.arange(8))).sum(1)] = np.arange(3**8)
#: Of a code: its counts in unary, 2 bits each, so that XOR and popcount give Manhattan distances.
_UNARY = (((1 << _DIGITS) - 1) << (2 * np.arange(8))).sum(1).astype(np.uint16)
#: Steps in the sums of the two halves within NEAR, of each two opposite ones the one that counts up.
_UPS = [(x, y) for x in range(NEAR + 1) for y in range(-NEAR, NEAR + 1) if x + abs(y) <= NEAR and (x > 0 or y >= 0)]


def _codes(f0: np.ndarray, f1: np.ndarray) -> np.ndarray:
    """For each of the 8 groups, the number of its count vector: its counts as digits to base 3."""
    fields = np.stack((_counts(f0), _counts(f1)), axis=1)
    return _CODE[fields.view(np.uint16).astype(np.int64)]


def _length_class(n: np.ndarray, ratio: float | None) -> np.ndarray:
    return np.zeros(len(n), np.int64) if ratio is None else np.floor(np.log(n) / np.log(ratio) + 1e-9).astype(np.int64)


def _placed(f0: np.ndarray, f1: np.ndarray, n: np.ndarray, ratio: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, their cell, whether its sums are theirs) for every cell that rows go to."""
    places, size, rows = _PLACE[_codes(f0, f1)], _length_class(n, ratio), np.arange(len(n))
    for g in range(GROUPS):
        first, second = places[:, g] % 10, places[:, g] // 10
        for x, y in _UPS:
            # no row is at home beyond the sums 0 to 8
            own = rows[(first + x <= 8) & (second + y >= 0) & (second + y <= 8)]
            for longer in (0,) if ratio is None else (0, 1):
                yield own, g + 8 * (places[own, g] + x + 10 * y) + 800 * (size[own] + longer), not (x or y)


def _sizes(batches: Iterator[pa.RecordBatch], ratio: float | None) -> Iterator[pa.RecordBatch]:
    """(cell, rows) of a task's rows."""
    total: dict[int, int] = {}
    for x in batches:
        f0, f1 = (x.column(k).to_numpy().view(np.uint64) for k in (1, 2))
        for _, cell, _ in _placed(f0, f1, x.column(0).to_numpy(), ratio):
            u, c = np.unique(cell, return_counts=True)
            for k, v in zip(u.tolist(), c.tolist(), strict=True):
                total[k] = total.get(k, 0) + v
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], names=["cell", "rows"])


def _cells(batches: Iterator[pa.RecordBatch], ratio: float | None, shares: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Every row in its cells: once for each task of the cell; ``mine`` tells the share of the rows at home."""
    large = np.array(sorted(shares), np.int64)
    count = np.array([shares[k] for k in sorted(shares)], np.int64)
    for x in batches:
        for at in range(0, x.num_rows, 10_000):
            part = x.slice(at, 10_000)
            f0, f1 = (part.column(k).to_numpy().view(np.uint64) for k in (2, 3))
            salt = part.column(4).to_numpy().view(np.uint64)
            cells, takes, tasks, mines = [], [], [], []
            for own, cell, home in _placed(f0, f1, part.column(1).to_numpy(), ratio):
                times = np.ones(len(own), np.int64)
                if len(large):
                    k = np.minimum(np.searchsorted(large, cell), len(large) - 1)
                    times = np.where(large[k] == cell, count[k], 1)
                task = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                own, cell, times = (np.repeat(v, times) for v in (own, cell, times))
                cells.append(cell)
                takes.append(own)
                tasks.append(task)
                mines.append(((salt[own] % times.astype(np.uint64)).astype(np.int64) == task) & home)
            take = pa.array(np.concatenate(takes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(tasks).astype(np.int32)), pa.array(np.concatenate(mines)), *(part.column(k).take(take) for k in range(4))], names=["cell", "task", "mine", "id", "n", "f0", "f1"])


def near_pairs(code: np.ndarray, f0: np.ndarray, f1: np.ndarray, n: np.ndarray, mine: np.ndarray, guest: np.ndarray, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose codes are at Manhattan distance at most NEAR and that are verified near-duplicates.

    Of a pair, one row at least is ``mine``, and one at least not a ``guest`` by length.
    """
    key = 4 * code + 2 * mine + guest
    order = np.argsort(key, kind="stable")
    key = key[order]
    f0, f1, n = f0[order], f1[order], n[order]
    u0, u1 = _thermometer(f0), _thermometer(f1)
    uniq, first, count = np.unique(key, return_index=True, return_counts=True)
    home, far = uniq // 2 % 2 == 1, uniq % 2
    own, unary = np.flatnonzero(home), _UNARY[uniq // 4]
    p, q = np.nonzero(np.bitwise_count(unary[own, None] ^ unary[None]) <= NEAR)
    p = own[p]
    met = (far[p] + far[q] < 2) & (~home[q] | (p <= q))
    p, q = p[met], q[met]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(f0[i] ^ f0[j]) + np.bitwise_count(f1[i] ^ f1[j]) <= MAX_HAMMING
        if ratio is not None:
            a, b = n[i], n[j]
            near &= np.maximum(a, b) <= ratio * np.minimum(a, b)
        found.append((i[near], j[near]))

    area = count[p] * count[q]
    big = area >= 4096
    for x, y in zip(p[big], q[big], strict=True):
        step = max(1, (1 << 20) // int(count[y]))
        cols = slice(first[y], first[y] + count[y])
        for r in range(first[x], first[x] + count[x], step):
            rows = slice(r, min(r + step, first[x] + count[x]))
            bound = np.bitwise_count(u0[rows, None] ^ u0[None, cols]) + np.bitwise_count(u1[rows, None] ^ u1[None, cols])
            i, j = np.nonzero(bound <= MAX_HAMMING)
            i, j = i + r, j + first[y]
            if x == y:
                i, j = i[i < j], j[i < j]
            verify(i, j)
    p, q, area = p[~big], q[~big], area[~big]
    total = np.cumsum(area)
    a = 0
    while a < len(p):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 19), side="right")))
        block = np.repeat(np.arange(a, b), area[a:b])
        rank = np.arange(len(block)) - np.repeat(np.cumsum(area[a:b]) - area[a:b], area[a:b])
        wide = count[q[block]]
        i, j = first[p[block]] + rank // wide, first[q[block]] + rank % wide
        keep = (p[block] != q[block]) | (i < j)
        i, j = i[keep], j[keep]
        bound = np.bitwise_count(u0[i] ^ u0[j]) + np.bitwise_count(u1[i] ^ u1[j])
        ok = bound <= MAX_HAMMING
        verify(i[ok], j[ok])
        a = b
    i, j = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return order[i], order[j]


def _stars(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each index is joined with through the pairs."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _match(key: tuple[pa.Scalar, ...], table: pa.Table, ratio: float | None) -> pa.Table:
    """Star edges over the near pairs that meet in this cell."""
    g, size = int(key[0].as_py()) % 8, int(key[0].as_py()) // 800
    ids = table.column("id").combine_chunks()
    f0, f1 = (table.column(k).to_numpy().view(np.uint64) for k in ("f0", "f1"))
    n, mine = table.column("n").to_numpy(), table.column("mine").to_numpy()
    i, j = near_pairs(_codes(f0, f1)[:, g], f0, f1, n, mine.astype(np.int64), (_length_class(n, ratio) != size).astype(np.int64), ratio)
    if not len(i):
        return pa.table({"a": ids.slice(0, 0), "b": ids.slice(0, 0)})
    label = _stars(len(n), i, j)
    far = np.flatnonzero(label != np.arange(len(n)))
    return pa.table({"a": ids.take(pa.array(label[far])), "b": ids.take(pa.array(far))})


def near_edges(prints: DataFrame, length_ratio: float | None = None) -> DataFrame:
    """(a, b): edges whose components are the near-duplicate groups of ``prints`` (id, n, f0, f1)."""
    kind = prints.schema["id"].dataType.simpleString()
    # at most 8 x 81 cells for each class of lengths
    sizes = prints.select("n", "f0", "f1").mapInArrow(lambda x: _sizes(x, length_ratio), "cell long, rows long").groupBy("cell").agg(F.sum("rows").alias("rows")).where(F.col("rows") > CELL_ROWS)
    shares = {r["cell"]: -(-r["rows"] // CELL_ROWS) for r in sizes.collect()}
    rows = prints.select("id", "n", "f0", "f1", F.xxhash64("id").alias("salt"))
    cells = rows.mapInArrow(lambda x: _cells(x, length_ratio, shares), f"cell long, task int, mine boolean, id {kind}, n long, f0 long, f1 long")
    return cells.groupBy("cell", "task").applyInArrow(lambda k, t: _match(k, t, length_ratio), f"a {kind}, b {kind}").distinct()


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_ratio: float | None = None) -> DataFrame:
    """(id, text_key, duplicate_of): every document that another of its group stands for.

    Documents with the same fingerprint and length are first folded into the least
    id, so a group of many exact copies costs one row in the join.
    """
    found, _ = materialize(fingerprints(docs, id_col, text_col), "simhash")
    return _duplicates(found, length_ratio)


def _duplicates(found: DataFrame, length_ratio: float | None = None) -> DataFrame:
    heads = found.groupBy("f0", "f1", "n").agg(F.min("id").alias("id"))
    heads, _ = materialize(heads, "prints")
    groups = components(near_edges(heads, length_ratio)).select(F.col("node").alias("head"), "component")
    rows = found.join(heads.withColumnRenamed("id", "head"), ["f0", "f1", "n"]).join(groups, "head", "left")
    named = rows.select("id", "text_key", F.coalesce("component", "head").alias("duplicate_of"))
    return named.where("id <> duplicate_of").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that ``duplicates`` lists and without repeats of a row's id and text."""
    found, _ = materialize(fingerprints(docs, id_col, text_col), "simhash")
    losers = _duplicates(found).select("id", "text_key")
    repeated = found.groupBy("id", "text_key").count().where("count > 1").select("id", "text_key")

    def without(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("id").alias("__id"), F.col("text_key").alias("__key"))
        return df.join(k, (df[id_col] == k["__id"]) & (F.xxhash64(df[text_col]) == k["__key"]), how)

    kept = without(docs, losers, "left_anti")
    if repeated.isEmpty():
        return kept
    once = without(kept, repeated, "left_semi").dropDuplicates([id_col, text_col])
    return without(kept, repeated, "left_anti").unionByName(once)
