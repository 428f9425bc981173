"""HTML extraction by nearest-URL page differencing.

Pages of one site share menus, headers and footers, and the pages whose addresses are
nearest share most.  Pages are sorted by host and path; each is compared with whichever
neighbour within its host has the longer common path prefix (the earlier on a tie).
Both pages become lines of text, the lines are aligned by a longest common
subsequence, and the lines of the page that lie on it are deleted: what is left is
the page's own text.

Distribution.  A pass over the table writes addresses and sizes; from them come the ranges over
(host, path, id), one for every RANGE_BYTES of html.
Every page is sent to its range once; the last page before and the first after each
range boundary are sent to the neighbouring range too, so every page meets both its
neighbours though a host may span any number of ranges.

Defined cases.  Null html gives null text, html without text an empty one.  A page without
an address, or alone on its host, keeps all its lines.  Two pages with one path are
neighbours in the order of their ids, null ids first, then html.  A row that repeats another in address, id and html
counts once when neighbours are sought, so it isn't compared with itself; each repeat is
returned.  Integer ids are in numeric order, others in that of their text; the whole id counts.  If a longest common subsequence isn't unique, the one that takes matches latest in
both pages is deleted.  Lines are compared without surrounding blanks; empty lines are
dropped.  Very long pages are aligned by bit vectors, a machine word of lines at a time, of which only
every so many are kept and those between made again, so memory grows as the lines to the power 1.5.
An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm._text import arrow_batches
from quarrystone.session import cleaning, discard, materialize

#: Bytes of html in a range on average, unless that makes more than MAX_RANGES, whose bounds go through the driver; a task works on one range.
RANGE_BYTES = 8 << 20
MAX_RANGES = 100_000

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!doctype[^>]*>", re.I | re.S)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|body|html|title|option)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|\n", re.I)
_TAG = re.compile(r"</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?/][^>]*>", re.I)
_BLANK = re.compile(r"\s+")
_ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)"


def text_lines(page: str) -> list[str]:
    """The lines of text of a page: block elements and line breaks end a line, entities are resolved."""
    bare = _TAG.sub("", _BREAK.sub("\n", _DROP.sub("\n", page)))
    if "&" in bare:
        bare = html.unescape(bare)
    return [x for line in bare.split("\n") if (x := _BLANK.sub(" ", line).strip())]


def shared_lines(own: list[str], other: list[str]) -> list[bool]:
    """For each own line, whether it lies on the longest common subsequence that takes matches latest."""
    number: dict[str, int] = {}
    for x in other:
        number.setdefault(x, len(number))
    rows = [i for i, x in enumerate(own) if x in number]
    out = [False] * len(own)
    if not rows:
        return out
    mine = {own[i] for i in rows}
    cols = [x for x in other if x in mine]
    end = 0
    while end < min(len(rows), len(cols)) and own[rows[-1 - end]] == cols[-1 - end]:
        out[rows[-1 - end]] = True
        end += 1
    rows, cols = rows[: len(rows) - end], cols[: len(cols) - end]
    if not rows or not cols:
        return out
    at: dict[str, int] = {}
    for j, x in enumerate(cols):
        at[x] = at.get(x, 0) | (1 << j)
    # Bit j of v is 0 where the length grows between the first j and j + 1 columns.
    full = (1 << len(cols)) - 1
    masks = [at.get(own[i], 0) for i in rows]

    def after(v: int, m: int) -> int:
        u = v & m
        return ((v + u) | (v - u)) & full

    step = max(1, math.isqrt(len(rows)))
    v, kept = full, []
    for k, m in enumerate(masks):
        if k % step == 0:
            kept.append(v)
        v = after(v, m)
    j, now = len(cols), v
    for block in range(len(kept) - 1, -1, -1):
        first = block * step
        states = [kept[block]]
        for k in range(first, min(first + step, len(rows)) - 1):
            states.append(after(states[-1], masks[k]))
        for k in range(first + len(states) - 1, first - 1, -1):
            before, own = states[k - first], masks[k] & ((1 << j) - 1)
            # the line is on it if its latest column leaves no more to be lost
            c = own.bit_length() - 1
            if c >= 0 and (~before & ((1 << c) - 1)).bit_count() + 1 == (~now & ((1 << j) - 1)).bit_count():
                out[rows[k]], j = True, c
            now = before
    return out


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col(url_col), _ADDRESS, 1))
    path = F.regexp_extract(F.col(url_col), _ADDRESS, 2)
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.when(host != "", host).alias("host"), path.alias("path"))


def _tie(kind: T.DataType) -> Column:
    """The whole id as a text whose byte order serves Spark and Python alike; nulls are first."""
    if isinstance(kind, T.IntegralType):
        text = F.lpad(F.hex(F.col("id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        text = F.concat(F.lit("1"), F.col("id").cast("string"))
    return F.coalesce(text, F.lit(""))


def page_differences(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_lines, n_shared): each page's own lines; n_shared lines were deleted."""
    spark = pages.sparkSession
    arrow_batches(spark, 200)
    kind = pages.schema[id_col].dataType.simpleString()
    keyed = _keyed(pages, id_col, url_col, html_col)
    tie = _tie(keyed.schema["id"].dataType)
    slim, slim_path = materialize(keyed.where("host is not null").select("host", "path", tie.alias("tie"), F.octet_length("html").alias("n")), "addresses")
    parts = min(MAX_RANGES, max(1, -(-(slim.agg(F.sum("n")).first()[0] or 0) // RANGE_BYTES)))
    ranged = slim.repartitionByRange(parts, "host", "path", "tie").withColumn("part", F.spark_partition_id())
    key = F.struct("host", "path", "tie")
    with cleaning(spark):
        ends = ranged.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("lo").collect()
    discard(spark, slim_path)
    bounds = [tuple(x.encode() for x in r["lo"]) for r in ends][1:]
    last = [tuple(x.encode() for x in r["hi"]) for r in ends]
    first = [tuple(x.encode() for x in r["lo"]) for r in ends]
    spread: dict[tuple, list[int]] = {}
    for k in range(len(ends) - 1):
        spread.setdefault(last[k], []).append(k + 1)
        spread.setdefault(first[k + 1], []).append(k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            host, path, ties = (x.column(k).to_pylist() for k in (3, 4, 5))
            take, part, ghost = [], [], []
            for r, h in enumerate(host):
                if h is None:
                    take.append(r), part.append(-1), ghost.append(False)
                    continue
                k = (h.encode(), path[r].encode(), ties[r].encode())
                own = bisect_right(bounds, k)
                take.append(r), part.append(own), ghost.append(False)
                for other in spread.get(k, ()):
                    if other != own:
                        take.append(r), part.append(other), ghost.append(True)
            rows = pa.array(take)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ghost), *(c.take(rows) for c in x.columns)], names=["part", "ghost", *x.schema.names])

    placed = keyed.withColumn("tie", tie).mapInArrow(place, f"part int, ghost boolean, id {kind}, url string, html string, host string, path string, tie string")
    spot = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.pmod(F.xxhash64("id", "url"), F.lit(parts)).cast("int"))
    sorted_parts = placed.repartitionById(parts, spot).sortWithinPartitions("part", "host", "path", "tie", "html", "ghost")
    schema = f"`{id_col}` {kind}, url string, text string, n_lines int, n_shared int"
    return sorted_parts.mapInArrow(lambda batches: _difference(batches, id_col), schema)


def _difference(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with its neighbours; ghosts are neighbours only."""
    done: list[tuple] = []
    kind: list[pa.DataType] = []

    def flush() -> pa.RecordBatch:
        ids, urls, texts, lines, shared = (list(c) for c in zip(*done, strict=True)) if done else ([], [], [], [], [])
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, kind[0]), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(lines, pa.int32()), pa.array(shared, pa.int32())], names=[id_col, "url", "text", "n_lines", "n_shared"])

    def finish(mid: list | None, before: list | None, after: list | None) -> None:
        if mid is None:
            return
        near = [x for x in (before, after) if x is not None and mid[0] is not None and x[0] == mid[0] and x[4] == mid[4]]
        pair = max(near, key=lambda x: _common(x[1], mid[1]), default=None)
        lines = mid[3]
        if pair is None or lines is None or pair[3] is None:
            flags = [False] * len(lines or ())
        else:
            flags = shared_lines(lines, pair[3])
        text = None if lines is None else "\n".join(x for x, f in zip(lines, flags, strict=True) if not f)
        for ident, url, ghost in mid[2]:
            if not ghost:
                done.append((ident, url, text, len(lines or ()), sum(flags)))

    # An entry: host, path, rows that repeat it, lines, range, (tie, html) to tell repeats.
    before = mid = None
    for x in batches:
        kind[:] = [x.schema.field("id").type]
        columns = [x.column(n).to_pylist() for n in ("part", "ghost", "id", "url", "html", "host", "path", "tie")]
        for part, ghost, ident, url, page, host, path, tie in zip(*columns, strict=True):
            mark = (tie, page)
            if mid is not None and host is not None and (host, path, part) == (mid[0], mid[1], mid[4]) and mark == mid[5]:
                mid[2].append((ident, url, ghost))
                continue
            new = [host, path, [(ident, url, ghost)], None if page is None else text_lines(page), part, mark]
            finish(mid, before, new)
            before, mid = mid, new
            if len(done) >= 200:
                yield flush()
    finish(mid, before, None)
    if done:
        yield flush()
