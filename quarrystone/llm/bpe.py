"""BPE by a tokenization automaton.

Compiling.  The automaton reads tokens.  It starts as one state with a loop for every
byte.  The merges are applied to it in order; the gadget of a merge (u, v) -> uv takes
the state q that u leads to, makes a copy of q without the arc v, lets u lead to the
copy instead, and gives every state with an arc u an arc uv to where v led from q.
Afterwards no path reads u then v, and each path that did reads uv.  All arcs of one
label lead to one state, so the automaton is deterministic and a state is what may
follow a token.  It accepts exactly the token sequences that applying the merges in
order produces, one for each string of bytes.

Tables.  States number at most one more than the merges, but arcs go up to their
square, so arcs are kept as the gadgets made them: a state has its parent, the one arc it
lost, and its birth; a label has the state it leads to, its left part and its birth.
Whether state p has arc y is then: if p is younger than y, y isn't what p lost and p's
parent has y; else p has the left part of y (a byte is an arc of the first state).

Encoding.  Read from the left, every prefix of a word has exactly one accepted path, so a place in
the word has one state: the last token of its prefix.  It is the one token that ends at the place and
is an arc of the state at its own beginning, so states follow from left to right by two
tables, the tree of all labels' bytes and the arcs, and nothing is tried twice.  All new words
of a batch go through the tables together, in step; arcs once tested are kept in a table of
fixed size.  Walking back from the end gives the tokens.  Words are
cut out by the pattern of the vocabulary; words are remembered with their tokens.  Decoding gathers the labels' bytes.

Defined cases.  A null text gives null tokens and a null decoded text, an empty text no
tokens.  Every byte string is encodable; special tokens are ordinary text.  Rows are
independent, so repeated rows, null ids and extra columns pass through, but columns called like
the ones that are added are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm._text import arrow_batches, chunks, map_rows, without

#: A byte-level BPE vocabulary with its merges in order; the place is a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern by which byte-level BPE vocabularies of this kind cut words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pieces that a worker remembers with their tokens; beyond it, it starts afresh.
REMEMBER = 300_000


@dataclass(frozen=True)
class Automaton:
    """The tables; tokens are numbered by age: 256 bytes, then one for each merge.

    ``leads[y]`` is the state label y leads to; for each copy, in order, ``copies``
    has the left label it was made for, the state it was made of, the label it lost and its birth.
    """

    labels: tuple[bytes, ...]
    left: np.ndarray
    leads: np.ndarray
    copies: np.ndarray
    ids: np.ndarray

    def arcs(self) -> _Arcs:
        table = _Arcs(self.left.tolist())
        for u, q, v, y in self.copies.tolist():
            table.copy(u, q, v, y)
        return table


def _byte_names() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int]]:
    """The merges in order and the id of every token of a byte-level BPE file."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    names = _byte_names()
    raw = lambda s: bytes(names[c] for c in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    ids = {raw(t): i for t, i in model["vocab"].items() if all(c in names for c in t)}
    return [(raw(a), raw(b)) for a, b in pairs], ids


def compile_merges(merges: list[tuple[bytes, bytes]], ids: dict[bytes, int] | None = None) -> Automaton:
    """Apply every merge's gadget in order; a merge that no path reads any more changes nothing."""
    labels = [bytes([b]) for b in range(256)]
    number = {x: k for k, x in enumerate(labels)}
    left, leads, copies = [-1] * 256, [0] * 256, []
    table = _Arcs(left)
    for a, b in merges:
        u, v = number.get(a), number.get(b)
        if u is None or v is None or a + b in number or not table.has(leads[u], v):
            continue
        y, q, target = len(labels), leads[u], leads[v]
        number[a + b] = y
        labels.append(a + b)
        left.append(u)
        copies.append((u, q, v, y))
        leads[u] = table.copy(u, q, v, y)
        leads.append(target)
    known = ids if ids is not None else {x: k for k, x in enumerate(labels)}
    return Automaton(tuple(labels), np.array(left, np.int32), np.array(leads, np.int32), np.array(copies, np.int32).reshape(-1, 4), np.array([known[x] for x in labels], np.int32))


class _Arcs:
    """The arc test over the tables.

    The copies made for one left label form a chain, each with one more arc lost, so
    whether a chain's state lost y is one look-up, and the state that a token
    younger than the chain's head has to ask is found by bisection.
    """

    def __init__(self, left: list[int]):
        self.left = left
        self.owner, self.parent, self.born = [-1], [-1], [0]
        self.lost_at: dict[tuple[int, int], int] = {}
        self.chain: dict[int, tuple[list[int], list[int]]] = {}

    def copy(self, u: int, q: int, v: int, y: int) -> int:
        """The state that merge y = (u, v) makes of q."""
        p = len(self.parent)
        self.owner.append(u)
        self.parent.append(q)
        self.born.append(y)
        self.lost_at[u, v] = p
        ages, states = self.chain.setdefault(u, ([], []))
        ages.append(y)
        states.append(p)
        return p

    def has(self, p: int, y: int) -> bool:
        left, born, lost_at, owner, parent, chain = self.left, self.born, self.lost_at, self.owner, self.parent, self.chain
        while p:
            if y >= 256 and born[p] <= y:
                y = left[y]
                continue
            u = owner[p]
            lost = lost_at.get((u, y))
            if lost is not None and lost <= p:
                return False
            ages, states = chain[u]
            p = parent[states[bisect_right(ages, y) if y >= 256 else 0]]
        return True


#: Arcs kept, each at the place that its two tokens hash to.
ARC_BITS = 22
#: Bytes of a word beyond which it goes through the tables alone.
LONG_WORD = 128
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Tree:
    """The labels' bytes as a table: node and byte to node; leaves have no row."""

    def __init__(self, labels: tuple[bytes, ...]):
        child: dict[tuple[int, int], int] = {}
        token = [-1]
        for y, x in enumerate(labels):
            node = 0
            for c in x:
                node = child.setdefault((node, c), len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = y
        inner = sorted({n for n, _ in child})
        order = np.full(len(token), -1)
        order[inner] = np.arange(len(inner))
        leaves = np.flatnonzero(order < 0)
        order[leaves] = len(inner) + np.arange(len(leaves))
        used = sorted({c for _, c in child})
        #: Class of each byte; the last class has no arcs.
        self.kind = np.full(256, len(used), np.int64)
        self.kind[used] = np.arange(len(used))
        self.inner = len(inner)
        self.step = np.full((len(inner), len(used) + 1), -1, np.int32)
        at = np.array([(n, c) for n, c in child])
        self.step[order[at[:, 0]], self.kind[at[:, 1]]] = order[list(child.values())]
        self.token = np.full(len(token), -1, np.int32)
        self.token[order] = token


class Encoder:
    """Encodes and decodes with an automaton; remembers words."""

    def __init__(self, a: Automaton, pattern: str = PATTERN):
        self.labels, self.ids = a.labels, a.ids
        self.leads, self.has = a.leads.tolist(), a.arcs().has
        self.size = np.array([len(x) for x in a.labels])
        self.tree = Tree(a.labels)
        self.words = regex.compile(pattern).findall
        self.arc_key, self.arc = np.full(1 << ARC_BITS, -1, np.int64), np.zeros(1 << ARC_BITS, bool)
        self.of_word: dict[str, tuple[int, ...]] = {}
        self.of_piece: dict[str, tuple[int, ...] | None] = {}
        self.off = np.concatenate(([0], np.cumsum(self.size)))
        self.bytes = np.frombuffer(b"".join(a.labels), np.uint8)
        self.label = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.label[self.ids] = np.arange(len(self.ids))

    def arcs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether ``token`` is an arc of the state that ``before`` leads to."""
        key = before.astype(np.int64) * len(self.size) + token
        at = ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - ARC_BITS)).astype(np.int64)
        miss = self.arc_key[at] != key
        if not miss.any():
            return self.arc[at]
        out = self.arc[at]
        new, back = np.unique(key[miss], return_inverse=True)
        n, has, leads = len(self.size), self.has, self.leads
        found = np.array([has(leads[k // n], k % n) for k in new.tolist()])
        out[miss] = found[back]
        put = ((new.astype(np.uint64) * _MIX) >> np.uint64(64 - ARC_BITS)).astype(np.int64)
        self.arc_key[put], self.arc[put] = new, found
        # of two new arcs with one place, the key that stayed must go with its own value
        lost = self.arc_key[put] != new
        if lost.any():
            held = dict(zip(new.tolist(), found.tolist(), strict=True))
            for p in np.unique(put[lost]).tolist():
                self.arc[p] = held[int(self.arc_key[p])]
        return out

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens (numbered by age) of the accepted paths over the words, one after another, and where each word's begin (n + 1)."""
        size = np.array([len(w) for w in words])
        start = np.cumsum(size) - size
        data = self.tree.kind[np.frombuffer(b"".join(words), np.uint8)]
        total = len(data)
        if not total:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        end_of = np.repeat(start + size, size)
        # every token within a word: where it begins and ends
        begin, node = np.arange(total), np.zeros(total, np.int64)
        at = begin.copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(begin):
            node = self.tree.step[node, data[at]]
            live = node >= 0
            begin, node, at = begin[live], node[live], at[live] + 1
            y = self.tree.token[node]
            hit = y >= 0
            found.append((begin[hit], at[hit], y[hit]))
            on = (node < self.tree.inner) & (at < end_of[begin])
            begin, node, at = begin[on], node[on].astype(np.int64), at[on]
        begin, stop, token = (np.concatenate([f[k] for f in found]) for k in range(3))
        from_ = np.repeat(start, size)[begin]
        place = stop - from_
        order = np.argsort(place, kind="stable")
        begin, stop, token, place = begin[order], stop[order], token[order], place[order]
        # the last token of the prefix that ends before each byte; a word's own beginning has none, and is the end of the word before
        last = np.full(total + 1, -1, np.int64)
        own = np.zeros(total + 1, bool)
        own[start] = True
        edge = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)])) if len(place) else [0]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            x, y = begin[a:b], token[a:b]
            ok = own[x]
            rest = np.flatnonzero(~ok)
            if len(rest):
                ok[rest] = self.arcs(last[x[rest]], y[rest])
            last[stop[a:b][ok]] = y[ok]
        at, number = (start + size)[size > 0], np.flatnonzero(size > 0)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        y = last[at]
        while len(at):
            out.append((number, y))
            at = at - self.size[y]
            on = at > start[number]
            at, number = at[on], number[on]
            y = last[at]
        number, token = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        # rounds went from the words' ends backwards
        order = np.argsort(number[::-1], kind="stable")
        return token[::-1][order], np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(words)))))

    def path(self, word: bytes) -> list[int]:
        """The tokens (numbered by age) of the accepted path over one word."""
        return self.paths([word])[0].tolist()

    def learn(self, words: set[str]) -> None:
        """Remember the tokens of words: short ones go through the tables together."""
        new = [w for w in words if w not in self.of_word]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        short = [k for k, w in enumerate(raw) if len(w) <= LONG_WORD]
        for group in ([short] if short else []) + [[k] for k, w in enumerate(raw) if len(w) > LONG_WORD]:
            token, off = self.paths([raw[k] for k in group])
            ids = self.ids[token].tolist()
            for k, a, b in zip(group, off[:-1].tolist(), off[1:].tolist(), strict=True):
                self.of_word[new[k]] = tuple(ids[a:b])

    def _cut(self, piece: str) -> list[str] | None:
        """The words of a piece and the space before it; None if the space doesn't surely begin a word, being next to another blank."""
        if piece.isalpha():
            return [" " + piece]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self.words(" " + piece)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The token ids of each text.

        A space between two other signs always starts a word of the pattern, so a text in which every
        space is of that kind is cut at its spaces; others are cut by the pattern as a whole.
        """
        if len(self.of_piece) > REMEMBER or len(self.of_word) > REMEMBER:
            self.of_piece.clear()
            self.of_word.clear()
        split = [None if t is None else t.split(" ") for t in texts]
        pieces: set[str] = set()
        for s in split:
            if s:
                pieces.update(s[1:])
        fresh = {p: self._cut(p) for p in pieces if p not in self.of_piece}
        odd = {p for p, c in fresh.items() if c is None} | {p for p in pieces if self.of_piece.get(p, ()) is None}
        # the words of each text's head, or of the whole text where it can't be cut at its spaces
        whole = [s is not None and (not s[0] or s[0][-1].isspace() or not odd.isdisjoint(s[1:])) for s in split]
        heads = [[] if s is None else self.words(t if w else s[0]) for t, s, w in zip(texts, split, whole, strict=True)]
        wanted = {w for c in fresh.values() if c for w in c}
        wanted.update(*heads)
        self.learn(wanted)
        of = self.of_word.__getitem__
        for p, c in fresh.items():
            self.of_piece[p] = None if c is None else of(c[0]) if len(c) == 1 else tuple(chain.from_iterable(map(of, c)))
        piece = self.of_piece.__getitem__
        out: list[np.ndarray | None] = []
        for s, w, h in zip(split, whole, heads, strict=True):
            rest = () if s is None or w else map(piece, s[1:])
            out.append(None if s is None else np.fromiter(chain.from_iterable(chain(map(of, h), rest)), np.int32))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_whole(self, text: str) -> np.ndarray:
        """The token ids of a text cut by the pattern alone."""
        words = self.words(text)
        self.learn(set(words))
        return np.fromiter(chain.from_iterable(map(self.of_word.__getitem__, words)), np.int32)

    def decode_all(self, parts: list[np.ndarray | None]) -> pa.Array:
        """The text of each list of ids; bytes that make no text are replaced."""
        some = [p for p in parts if p is not None]
        ids = np.concatenate([*some, np.zeros(0, np.int32)]).astype(np.int64)
        known = (ids >= 0) & (ids < len(self.label))
        row = self.label[np.where(known, ids, 0)]
        if not known.all() or len(row) and row.min() < 0:
            raise KeyError("an id isn't in the vocabulary")
        size = self.size[row]
        ends = np.cumsum(size)
        data = self.bytes[np.repeat(self.off[row] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        count = np.cumsum([0] + [0 if p is None else len(p) for p in parts])
        off = np.concatenate(([0], ends))[count]
        if off[-1] < 1 << 31:
            out = pa.StringArray.from_buffers(len(parts), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data))
            try:
                out.validate(full=True)
                return pc.if_else(pa.array([p is not None for p in parts], pa.bool_()), out, pa.scalar(None, pa.string()))
            except pa.ArrowInvalid:
                pass
        return pa.array([None if p is None else data[a:b].tobytes().decode("utf-8", "replace") for p, a, b in zip(parts, off[:-1], off[1:], strict=True)], pa.string())

    def decode(self, ids) -> str:
        return self.decode_all([np.array(ids, np.int64)])[0].as_py()


@lru_cache(maxsize=2)
def automaton(path: str = VOCABULARY) -> Automaton:
    return compile_merges(*read_vocabulary(path))


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, sent) -> Encoder:
    """This worker's encoder: kept between tasks, so that words are remembered."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(sent.value)
    return _encoders[name]


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([0 if p is None else len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate([p for p in parts if p is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat), mask=mask)


def send(spark: SparkSession, path: str = VOCABULARY):
    """The compiled automaton as a broadcast; it is as large as the vocabulary file, whatever the data."""
    held = spark.sparkContext.__dict__.setdefault("_quarrystone_automata", {})
    if path not in held:
        held[path] = spark.sparkContext.broadcast(automaton(path))
    return held[path]


def encode(docs: DataFrame, text_col: str = "text", tokens_col: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with a column of token ids (array<int>)."""
    return _with(docs, [(tokens_col, "array<int>")], text_col, path, decode_too=False)


def encode_decode(docs: DataFrame, text_col: str = "text", tokens_col: str = "tokens", decoded_col: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with the token ids and the text that decoding them gives."""
    return _with(docs, [(tokens_col, "array<int>"), (decoded_col, "string")], text_col, path, decode_too=True)


def _with(docs: DataFrame, added: list[tuple[str, str]], text_col: str, path: str, decode_too: bool) -> DataFrame:
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = without(docs, *(n for n, _ in added))
    sent, at = send(spark, path), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path, sent)
        for x in batches:
            for row, stop in chunks(x.column(at)):
                y = x.slice(row, stop - row)
                parts = e.encode_all(y.column(at).to_pylist())
                columns = [*y.columns, _lists(parts)]
                if decode_too:
                    columns.append(e.decode_all(parts))
                yield pa.RecordBatch.from_arrays(columns, names=[*y.schema.names, *(n for n, _ in added)])

    return map_rows(docs, run, ", ".join(f"`{n}` {t}" for n, t in added))


def decode(tokens: DataFrame, tokens_col: str = "tokens", decoded_col: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """``tokens`` with the decoded text of a column of token ids; an id that isn't in the vocabulary is an error."""
    spark = tokens.sparkSession
    arrow_batches(spark)
    tokens = without(tokens, decoded_col)
    sent, at = send(spark, path), tokens.columns.index(tokens_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path, sent)
        for x in batches:
            text = e.decode_all([None if t is None else np.array(t, np.int64) for t in x.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*x.columns, text], names=[*x.schema.names, decoded_col])

    return map_rows(tokens, run, f"`{decoded_col}` string")
