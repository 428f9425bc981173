import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrystone.llm import bpe

from .common import awkward, empty


@pytest.fixture(scope="module")
def pair():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return bpe.Encoder(bpe.automaton()), t


TEXTS = ["", " ", "hello world", "  two  spaces ", "Éaux, naïve çà!", "日本語のテキスト", "x" * 300, "<|endoftext|> is plain", "tabs\tand\n\nnewlines \r\n", "it's we'll 12345 a1b2", "🙂🙂 ok", "don't stop", "a" * 5000 + " end"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library_and_round_trip(pair, text):
    mine, library = pair
    got = mine.encode(text).tolist()
    assert got == library.encode(text, add_special_tokens=False).ids
    assert mine.decode(got) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(pair_any, text):
    mine, library = pair_any
    text = text.encode("utf-8", "ignore").decode()
    got = mine.encode(text).tolist()
    assert got == library.encode(text, add_special_tokens=False).ids
    assert mine.decode(got) == text


@pytest.fixture(scope="module")
def pair_any(pair):
    return pair


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", "it's", " ", "  ", "\n", "\t", "\u00a0", "x1", "...", "'s", "é", "\n ", " \n"]), max_size=12))
def test_cutting_at_spaces_is_cutting_by_the_pattern(pieces):
    """Also with merges that join a line break and a space."""
    text = "".join(pieces)
    merges = [(b"\n", b" "), (b" ", b"a"), (b"\n", b"\n"), (b" ", b" "), (b"a", b"b"), (b" a", b"b"), (b"'", b"s")]
    e = bpe.Encoder(bpe.compile_merges(merges))
    assert e.encode(text).tolist() == e.encode_whole(text).tolist()


def test_many_words_together_are_as_one_by_one(pair):
    mine, _ = pair
    words = [w.encode() for t in TEXTS for w in mine.words(t)] + [b"", b"q" * 700, bytes(range(256))]
    token, off = mine.paths(words)
    for k, w in enumerate(words):
        own = token[off[k] : off[k + 1]].tolist()
        assert own == mine.path(w) and b"".join(mine.labels[y] for y in own) == w


def test_arcs_agree_with_the_gadgets(pair):
    mine, _ = pair
    rng = np.random.default_rng(2)
    n = len(mine.labels)
    before, token = rng.integers(0, n, 20_000), rng.integers(0, n, 20_000)
    want = [mine.has(mine.leads[p], y) for p, y in zip(before.tolist(), token.tolist())]
    for _ in range(2):
        assert mine.arcs(before, token).tolist() == want
    assert 0 < sum(want) < len(want)


def test_decoding_what_is_no_text(pair):
    mine, _ = pair
    ids = [mine.ids[0xFF].item(), mine.ids[0x41].item()]
    assert mine.decode(ids) == "\ufffdA"
    assert mine.decode_all([None, np.zeros(0, np.int32), np.array(ids[1:])]).to_pylist() == [None, "", "A"]
    with pytest.raises(KeyError):
        mine.decode([10**6])


def _merged(word: bytes, merges):
    parts = [word[k : k + 1] for k in range(len(word))]
    for a, b in merges:
        k, out = 0, []
        while k < len(parts):
            if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                out.append(a + b)
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out
    return parts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8), st.text("abc", max_size=14))
def test_gadgets_equal_merging_in_order(picks, word):
    known, merges = [b"a", b"b", b"c"], []
    for i, j in picks:
        a, b = known[i % len(known)], known[j % len(known)]
        if a + b not in known:
            merges.append((a, b))
            known.append(a + b)
    a = bpe.compile_merges(merges)
    mine = [a.labels[k] for k in bpe.Encoder(a).path(word.encode())] if word else []
    assert mine == _merged(word.encode(), merges)


def test_awkward_rows(spark):
    rows = bpe.encode_decode(awkward(spark)).collect()
    assert len(rows) == 10 and rows[0].asDict()["a.b"] == 7
    assert bpe.encode_decode(awkward(spark)).columns.count("tokens") == 1
    for r in rows:
        assert r["decoded"] == r["text"]
        assert (r["tokens"] is None) == (r["text"] is None)
    assert bpe.encode_decode(empty(spark)).count() == 0


def test_decode_column(spark):
    d = bpe.decode(bpe.encode(awkward(spark).select("doc_id", "text")))
    assert all(r["text"] == r["decoded"] for r in d.collect())


def test_lists_keep_nulls():
    assert bpe._lists([None, np.array([1, 2], np.int32), np.zeros(0, np.int32)]).to_pylist() == [None, [1, 2], []]
