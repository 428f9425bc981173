import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm import pii as P

from .common import LONG, awkward, empty

KEY = b"test key"
one = lambda t: P.pseudonymise(t, KEY)[0]


@pytest.mark.parametrize("size", [2, 3, 10, 97, 256, 1000])
def test_permutation_is_a_bijection(size):
    assert sorted(P.permute(v, size, KEY, "t") for v in range(size)) == list(range(size))


def _luhn_ok(s):
    d = re.sub(r"\D", "", s)
    return P.luhn(d[:-1]) == int(d[-1])


@pytest.mark.parametrize("value,shape", [("4111 1111 1111 1111", r"\d{4} \d{4} \d{4} \d{4}"), ("4111111111111111", r"\d{16}"), ("5500-0000-0000-0004", r"\d{4}-\d{4}-\d{4}-\d{4}")])
def test_cards_stay_valid(value, shape):
    new = one(f"pay {value} now")[4:-4]
    assert new != value and re.fullmatch(shape, new) and _luhn_ok(new)


def test_formats_are_kept():
    for value, shape in [("078-05-1120", r"\d{3}-\d{2}-\d{4}"), ("+1 (555) 123-4567", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("555-123-4567", r"\d{3}-\d{3}-\d{4}"), ("10.1.2.3", r"\d+(\.\d+){3}"), ("00:1A:2b:3c:4d:5e", r"([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}"), ("jane.doe42@mail.example.com", r"[a-z]{4}\.[a-z]{3}\d\d@mail\.example\.com")]:
        new = one(value)
        assert new != value and re.fullmatch(shape, new), (value, new)


def test_iban_stays_valid():
    new = one("DE89370400440532013000")
    assert new != "DE89370400440532013000" and new[:2] == "DE"
    assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1


def test_widths_and_signs_are_kept():
    for value, shape in [("2020-1-5", r"[0-9]{4}-[1-9]-[1-9]"), ("2020-11-5", r"[0-9]{4}-1[0-2]-[1-9]"), ("5.1.2020", r"[1-9]\.[1-9]\.[0-9]{4}"), ("2020-01-05", r"[0-9]{4}-0[1-9]-0[1-9]"), ("010.001.002.003", r"[0-9]{3}(\.[0-9]{3}){3}")]:
        assert re.fullmatch(shape, one(value)), (value, one(value))
    y, m, d = one("2020-1-5").split("-")
    assert one("2020-01-05") == f"{y}-0{m}-0{d}" and one("05.01.2020") == f"0{d}.0{m}.{y}" and one("1/5/2020") == f"{m}/{d}/{y}"
    assert one("٠١٢٣٤٥٦٧٨٩٠١") == "٠١٢٣٤٥٦٧٨٩٠١"


def test_days_are_permuted_one_to_one():
    first = dt.date(2003, 1, 1)
    days = [(first + dt.timedelta(k)).isoformat() for k in range(1500)]
    assert len({one(x) for x in days}) == len(days)


def test_digit_strings_are_permuted_one_to_one():
    """Of one length, cards go to cards and other numbers to other numbers, and no two to one."""
    given_ = [f"4{k:015d}" for k in range(3000)]
    new = [P.digits(x, KEY) for x in given_]
    assert len(set(new)) == len(given_) and [_luhn_ok(x) for x in given_] == [_luhn_ok(x) for x in new]
    given_ = [f"{k * 7:09d}" for k in range(3000)]
    new = [P.digits(x, KEY) for x in given_]
    assert len(set(new)) == len(given_) and [P._issuable(x) for x in given_] == [P._issuable(x) for x in new]


def test_forms_of_one_number_stay_linked():
    plain = one("5551234567")
    for form in ("555-123-4567", "(555) 123-4567", "555 123 4567"):
        assert re.sub("[^0-9]", "", one(form)) == plain
    assert re.sub("-", "", one("078-05-1120")) == one("078051120")
    assert re.sub(" ", "", one("4111 1111 1111 1111")) == one("4111111111111111")


def test_keys():
    long = b"k" * 64
    assert one("555-123-4567") == P.pseudonymise("555-123-4567", KEY)[0]
    assert P.pseudonymise("555-123-4567", long + b"a") != P.pseudonymise("555-123-4567", long + b"b")
    with pytest.raises(ValueError):
        P.pseudonymise("555-123-4567", b"")


def test_long_secrets_are_permuted_whole():
    a, b = "a1" * 200, "a1" * 199 + "a2"
    x, y = one(a), one(b)
    assert len(x) == 400 and sum(p == q for p, q in zip(x, y, strict=True)) < 60 and sum(p == q for p, q in zip(a, x, strict=True)) < 60


def test_session_key(spark):
    docs = spark.createDataFrame([(1, "555-123-4567"), (2, "or 555-123-4567")], "doc_id long, text string")
    drawn = {r["text"][-12:] for r in P.apply(docs).collect()}
    assert len(drawn) == 1 and drawn == {r["text"][-12:] for r in P.apply(docs).collect()}
    spark.conf.set(P.KEY_SETTING, "test key")
    try:
        assert {r["text"][-12:] for r in P.apply(docs).collect()} == {one("555-123-4567")}
    finally:
        spark.conf.unset(P.KEY_SETTING)


class Brute:
    """The recognisers without patterns: every place of a text, every kind, every end, by reading signs."""

    WORD = staticmethod(lambda c: c.isalnum() or c == "_")
    DIGITS = staticmethod(lambda s: s != "" and all(c in "0123456789" for c in s))
    HEX = staticmethod(lambda s: all(c in "0123456789abcdefABCDEF" for c in s))

    def email(self, s):
        local, at, host = s.partition("@")
        parts = host.split(".")
        return at and local and local[0].isascii() and local[0].isalnum() and all(self.WORD(c) or c in ".+-" for c in local) and len(parts) > 1 and all(p and all(c.isascii() and (c.isalnum() or c == "-") for c in p) for p in parts)

    def mac(self, s):
        return len(s) == 17 and all(s[k] in ":-" if k % 3 == 2 else self.HEX(s[k]) for k in range(17))

    def secret(self, s):
        return len(s) >= 32 and self.HEX(s) and any(c in "0123456789" for c in s)

    def date(self, s):
        for sep, widths in (("-", (4, 2, 2)), (".", (2, 2, 4)), ("/", (2, 2, 4))):
            p = s.split(sep)
            if len(p) == 3 and all(self.DIGITS(x) and (len(x) == w if w == 4 else len(x) <= w) for x, w in zip(p, widths, strict=True)):
                return True
        return False

    def ip(self, s):
        p = s.split(".")
        return len(p) == 4 and all(self.DIGITS(x) and len(x) <= 3 for x in p)

    def ssn(self, s):
        return [len(x) for x in s.split("-")] == [3, 2, 4] and self.DIGITS(s.replace("-", ""))

    def phone(self, s):
        if s[:1] == "+" and self.DIGITS(s[1:]) and 10 <= len(s) - 1 <= 15:
            return True
        if len(s) < 8 or not self.DIGITS(s[-4:]) or s[-5] not in " .-" or not self.DIGITS(s[-8:-5]) or len(s[-8:-5]) != 3:
            return False
        head = s[:-8]
        for area in (head[-5:], head[-6:], head[-4:]):
            rest = head[: len(head) - len(area)]
            paren = area[:1] == "(" and self.DIGITS(area[1:4]) and area[4:] in (")", ") ")
            plain = len(area) == 4 and self.DIGITS(area[:3]) and area[3] in " .-"
            if paren or plain:
                if rest == "":
                    return True
                core = rest[:-1] if rest[-1] in " .-" else rest
                if core[:1] == "+" and self.DIGITS(core[1:]) and len(core) <= 4:
                    return True
        return False

    def card(self, s):
        if self.DIGITS(s):
            return 9 <= len(s) <= 19
        return len(s) > 15 and s[4] in " -" and s[9] in " -" and s[14] in " -" and all(self.DIGITS(x) for x in (s[:4], s[5:9], s[10:14], s[15:])) and len(s) <= 22

    BEFORE = {"email": ".+-", "mac": ":-", "secret": None, "date": ".,/-", "ip": ".", "ssn": "-", "phone": "+", "card": "."}
    AFTER = {"email": "", "mac": ":-", "secret": None, "date": "/-", "ip": "", "ssn": "-", "phone": "-", "card": ""}

    def bounds(self, kind, t, i, j):
        before, after = t[i - 1 : i], t[j : j + 1]
        if kind == "secret":
            return not (before and before.isascii() and before.isalnum()) and not (after and after.isascii() and after.isalnum())
        if before and (self.WORD(before) or before in self.BEFORE[kind]):
            return False
        if kind == "email":
            return True
        if kind == "ip" and after == "." and t[j + 1 : j + 2] in set("0123456789"):
            return False
        plus = kind == "phone" and t[i] == "+" and self.DIGITS(t[i + 1 : j])
        return not (after and (self.WORD(after) or (after in self.AFTER[kind] and not plus)))

    def spans(self, t):
        """What the leftmost kind in order finds, longest first; a kind that is found but not valid is passed over whole."""
        i, out = 0, []
        while i < len(t):
            for kind in self.BEFORE:
                hit = next((j for j in range(min(len(t), i + 120), i, -1) if getattr(self, kind)(t[i:j]) and self.bounds(kind, t, i, j)), None)
                if hit:
                    out.append((i, hit, kind))
                    break
            i = hit or i + 1
        return out


FIELDS = ["call 555-123-4567", "at +1 (555) 123-4567.", "ssn 078-05-1120,", "000-12-3456", "card 4111 1111 1111 1111", "4111111111111112", "10.1.2.3", "300.1.1.1", "1.2.3.4.5", "2020-1-5", "born 31/12/1999", "12.11.2001", "2024-13-45", "x@y.org", "Jane.Doe-9@mail.example.com", "é5551234567", "00:1A:2b:3c:4d:5e", "deadbeef" * 4 + "1", "a-5551234567", "1234567890123456789012", "+4915112345678", "12345", "v1.2.3", "(555)123-4567", "5551234567x", "no. 987654321", "2020-01-05-06", "_555-123-4567", ", ", " ", "\n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(FIELDS), min_size=1, max_size=7), st.sampled_from(["", " ", ", "]))
def test_recognisers_against_brute_force(parts, glue):
    text = glue.join(parts)
    new, n = P.pseudonymise(text, KEY)
    at, done, changed = 0, 0, 0
    for i, j, kind in Brute().spans(text):
        alone = P._ACT[kind](re.compile(".*", re.S).fullmatch(text[i:j]), KEY)
        want = text[done:i] + (text[i:j] if alone is None else alone)
        assert new[at : at + len(want)] == want, (text, text[i:j], kind)
        at, done, changed = at + len(want), j, changed + (alone is not None)
    assert new[at:] == text[done:] and n == changed


@settings(max_examples=80, deadline=None)
@given(st.dates(dt.date(1900, 1, 1), dt.date(2099, 12, 31)))
def test_dates_are_permuted_among_dates(day):
    iso, us, eu = one(day.isoformat()), one(day.strftime("%m/%d/%Y")), one(day.strftime("%d.%m.%Y"))
    new = dt.date.fromisoformat(iso)
    assert us == new.strftime("%m/%d/%Y") and eu == new.strftime("%d.%m.%Y")


def test_linked_across_documents_and_keys_differ():
    assert one("call 555-123-4567")[-12:] == one("or 555-123-4567 now")[3:15]
    assert P.pseudonymise("555-123-4567", KEY)[0] != P.pseudonymise("555-123-4567", b"other")[0]


def test_what_is_not_personal_stays():
    for t in ["version 1.2.3", "2024-13-45", "300.1.1.1", "in 1999 or 12345", "000-12-3456", ""]:
        assert P.pseudonymise(t, KEY) == (t, 0)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = P.apply(docs, count_col="tokens")
    assert sorted(got.columns) == sorted(docs.columns) and got.count() == 10
    assert {r["tokens"] for r in got.collect()} == {0}
    same = P.apply(docs)
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert P.apply(empty(spark)).count() == 0
    long = spark.createDataFrame([(1, LONG + " 555-123-4567")], "doc_id long, text string")
    new = P.apply(long).first()["text"]
    assert new.startswith(LONG) and not new.endswith("555-123-4567")
