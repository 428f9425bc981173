import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm import html_text as H


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[len(a)][len(b)]


def _within(x, b):
    it = iter(b)
    return all(c in it for c in x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=14), st.lists(st.sampled_from("abcde"), max_size=14))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    flags = H.shared_lines(a, b)
    shared = [x for x, f in zip(a, flags, strict=True) if f]
    assert len(shared) == _lcs(a, b) and _within(shared, b)


def _latest(a, b):
    """The lines of a on the longest common subsequence that takes matches latest, from the full table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    out, j = [False] * len(a), len(b)
    for k in range(len(a) - 1, -1, -1):
        fit = [c for c in range(j) if b[c] == a[k] and t[k][c] + 1 == t[k + 1][j]]
        if fit:
            out[k], j = True, fit[-1]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdex"), max_size=40), st.lists(st.sampled_from("abcdey"), max_size=40))
def test_the_lines_that_are_deleted(a, b):
    assert H.shared_lines(a, b) == _latest(a, b)


def test_long_pages_take_little_memory():
    rng = random.Random(3)
    a, b = ([str(rng.randrange(50)) for _ in range(6000)] for _ in range(2))
    tracemalloc.start()
    flags = H.shared_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000 and 0 < sum(flags) < 6000


def test_whole_ids_tell_pages_apart(spark):
    """Ids that share a long beginning are different pages; negative ids come before others."""
    html = "<p>one</p><p>two</p>"
    for a, b in (("a", "b"), ("x" * 30 + "a", "x" * 30 + "b")):
        df = spark.createDataFrame([(a, "https://h.org/p", html), (b, "https://h.org/p", html)], "page_id string, url string, html string")
        assert {r["page_id"]: r["n_shared"] for r in H.page_differences(df).collect()} == {a: 2, b: 2}
    rows = [(-5, "<p>n</p><p>x</p>"), (3, "<p>m</p><p>x</p>"), (-20, "<p>n</p><p>y</p>")]
    df = spark.createDataFrame([(i, "https://h.org/p", t) for i, t in rows], "page_id long, url string, html string")
    # in order -20, -5, 3 on one path: the earlier neighbour is taken
    assert {r["page_id"]: r["text"] for r in H.page_differences(df).collect()} == {-20: "y", -5: "x", 3: "m"}


def test_lines():
    page = "<!doctype html><head><title>T</title></head><body><script>x<y</script><p>One &amp; two<br>three</p><div> <b>four</b> five </div><!-- no --><style>p{}</style></body>"
    assert H.text_lines(page) == ["One & two", "three", "four five"]


def _brute(rows):
    """Neighbours in one sorted list of each host, repeats counted once."""
    key = lambda r: (r[1].split("/")[2].lower(), "/" + "/".join(r[1].split("/")[3:]), str(r[0]).rjust(20, "0"), r[2] or "")
    order = sorted({(key(r), r) for r in rows})
    out = {}
    for k, (name, r) in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][0][0] == name[0]]
        pair = max(near, key=lambda x: H._common(x[0][1], name[1]), default=None)
        lines = H.text_lines(r[2])
        flags = _latest(lines, H.text_lines(pair[1][2])) if pair else [False] * len(lines)
        out[r] = (len(lines), sum(flags), "\n".join(x for x, f in zip(lines, flags, strict=True) if not f))
    return out


def test_against_brute_force_over_range_boundaries(spark, monkeypatch):
    monkeypatch.setattr(H, "RANGE_BYTES", 700)
    rng = random.Random(5)
    rows = []
    for k in range(150):
        host = rng.choice(["a.org", "b.org", "c.org"])
        lines = ["menu", host, *(rng.choice("uvwxyz") for _ in range(rng.randrange(6))), "footer"]
        rows.append((k, f"https://{host}/{rng.choice('pqr')}/{rng.randrange(40)}", "".join(f"<p>{x}</p>" for x in lines)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["n_lines"], r["n_shared"], r["text"]) for r in H.page_differences(df).collect()}
    assert got == {r[0]: v for r, v in _brute(rows).items()}


def test_awkward_rows(spark):
    rows = [(1, None, "<p>a"), (2, "", "<p>b"), (3, "https://x.org/1", None), (4, "https://x.org/2", ""), (5, "https://y.org/1", "<p>s</p><p>own"), (5, "https://y.org/1", "<p>s</p><p>own"), (None, "https://y.org/2", "<p>s</p><p>other"), (8, "https://solo.org/", "<p>kept"), (9, "no address", "<p>c"), (10, "https://z.org/1", "<p>line</p>" * 20000 + "<p>own"), (11, "https://z.org/2", "<p>line</p>" * 20000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = [(r["page_id"], r["text"], r["n_shared"]) for r in H.page_differences(df).collect()]
    want = [(1, "a", 0), (2, "b", 0), (3, None, 0), (4, "", 0), (5, "own", 1), (5, "own", 1), (None, "other", 1), (8, "kept", 0), (9, "c", 0), (10, "own", 20000), (11, "", 20000)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert H.page_differences(df.where("false")).count() == 0
