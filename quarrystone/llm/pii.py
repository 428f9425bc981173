"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found by pattern, validated, and replaced by a keyed
permutation of their own format: a Feistel network over the digits (or letters, or
the day number), walked again until the result is of the format.  The permutation is
a function of key, kind, format and value alone, so equal values get equal pseudonyms
in every document and different values different ones.  Separators and the text
around stay as they were.

Kinds.  Digit strings have one permutation for each length, whatever their separators, so
555-123-4567 and 5551234567 stay linked: card, 13-19 digits, plain or in groups of four, that pass the
Luhn check (the pseudonym passes it too, and others of that length don't); account, other runs of 9-19
digits; ssn, 3-2-4 digits with hyphens, of an issuable range (issuable ones among themselves);
phone, +C (AAA) BBB-CCCC and common variants of 10-15 digits, of which the last ten change.
iban: checked modulo 97, and so is the pseudonym.  ip: four octets.  mac: six bytes in
hexadecimal.  date: year-month-day, day.month.year or month/day/year that exist between 1900 and
2099, permuted among those of this range with as many signs in month and day written
without zeros, so any form keeps its widths and all forms of a day stay linked.  email: letters and digits of the
local part, each within its class.  secret: hexadecimal runs of 32 or more.
Only ASCII digits count; an octet of an ip with leading zeros keeps its width at least.

Key.  Keys of any length are hashed whole.  ``session_key`` reads the setting spark.quarrystone.pii.key; where
it is unset, a key is drawn at random for the Spark context, so pseudonyms are linked
within it and nobody can invert them later.

Defined cases.  A null text stays null, an empty one empty, and texts with nothing to
replace are returned unchanged; whole texts are searched.  Ids may be null or
repeated; rows are never joined, and extra columns are kept, but one called like the count is replaced.  An empty table gives
an empty result.  An empty key is an error.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import secrets
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm._text import arrow_batches, map_rows, without

ROUNDS = 10
KEY_SETTING = "spark.quarrystone.pii.key"


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's settings, else one drawn at random for this Spark context."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return named.encode()
    held = spark.sparkContext.__dict__
    if "_quarrystone_pii_key" not in held:
        held["_quarrystone_pii_key"] = secrets.token_bytes(32)
    return held["_quarrystone_pii_key"]


@lru_cache(maxsize=8)
def _hashed(key: bytes) -> bytes:
    if not key:
        raise ValueError("the key is empty")
    return hashlib.blake2b(key, digest_size=64).digest()


def _round(half: bytes, key: bytes, r: int, label: bytes) -> int:
    """A keyed function of one half, at least as wide as it."""
    if len(half) > 64:
        return int.from_bytes(hashlib.shake_256(key + bytes([r]) + len(label).to_bytes(4, "big") + label + half).digest(len(half)), "big")
    h = hashlib.blake2b(half, key=key, person=bytes([r]), digest_size=max(16, len(half)))
    h.update(label)
    return int.from_bytes(h.digest(), "big")


def permute(value: int, size: int, key: bytes, tweak: str, fits: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of range(size): balanced Feistel over two halves, walked until within it.

    With ``fits``, a permutation of those values that fit (of which ``value`` is one).
    """
    if size < 2:
        return value
    bits = max(2, (size - 1).bit_length())
    half = (bits + 1) // 2
    mask = (1 << half) - 1
    width = (half + 7) // 8 + 1
    label, key = tweak.encode(), _hashed(key)
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_round(right.to_bytes(width, "big"), key, r, label) & mask)
        value = (left << half) | right
        if value < size and (fits is None or fits(value)):
            return value


def luhn(digits: str) -> int:
    """The check digit for ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + (k % 2 == 0))
        total += x - 9 * (x > 9)
    return -total % 10


def _valid_card(d: str) -> bool:
    return luhn(d[:-1]) == int(d[-1])


def _issuable(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def digits(d: str, key: bytes) -> str:
    """The pseudonym of a digit string: of its length, and Luhn-valid or issuable if it was."""
    n = len(d)
    if n >= 13 and _valid_card(d):
        body = str(permute(int(d[:-1]), 10 ** (n - 1), key, f"card/{n}")).zfill(n - 1)
        return body + str(luhn(body))
    of = _issuable if n == 9 else _valid_card if n >= 13 else None
    kind = of(d) if of else None
    fits = None if of is None else lambda v: of(str(v).zfill(n)) == kind
    return str(permute(int(d), 10**n, key, f"digits/{n}/{kind}", fits)).zfill(n)


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _refill(shape: str, fresh: str, of: Callable[[str], bool] = _digit) -> str:
    it = iter(fresh)
    return "".join(next(it) if of(c) else c for c in shape)


def _plain(s: str) -> str:
    return "".join(c for c in s if _digit(c))


def _number(m: re.Match, key: bytes) -> str | None:
    s = m.group()
    d = _plain(s)
    return _refill(s, digits(d, key)) if len(d) >= 9 else None


def _phone(m: re.Match, key: bytes) -> str | None:
    s = m.group()
    d = _plain(s)
    if not 10 <= len(d) <= 15:
        return None
    return _refill(s, d[:-10] + digits(d[-10:], key))


def _ssn(m: re.Match, key: bytes) -> str | None:
    d = _plain(m.group())
    return _refill(m.group(), digits(d, key)) if _issuable(d) else None


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = m.group().split(".")
    if any(int(x) > 255 for x in parts):
        return None
    v = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(str(x).zfill(len(p) if p[0] == "0" and len(p) > 1 else 1) for x, p in zip(v.to_bytes(4, "big"), parts, strict=True))


def _hex(m: re.Match, key: bytes) -> str:
    s = m.group()
    d = re.sub("[^0-9A-Fa-f]", "", s)
    fresh = f"{permute(int(d, 16), 1 << (4 * len(d)), key, f'hex/{len(d)}'):0{len(d)}x}"
    return _refill(s, fresh.upper() if any(c in "ABCDEF" for c in d) else fresh, lambda c: c in "0123456789abcdefABCDEF")


def _iban(m: re.Match, key: bytes) -> str | None:
    s = m.group()
    v = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(v) <= 34 or number(v[4:] + v[:4]) % 97 != 1:
        return None
    body = _classes(v[4:], key, "iban")
    check = 98 - number(body + v[:2] + "00") % 97
    return _refill(s, v[:2] + f"{check:02d}" + body, lambda c: c != " ")


def _classes(s: str, key: bytes, kind: str) -> str:
    """Permute a string among those with digits, small and capital letters at the same places."""
    sizes = [10 if _digit(c) else 26 for c in s if c.isascii() and c.isalnum()]
    if not sizes:
        return s
    value, total = 0, 1
    for c, n in zip((c for c in s if c.isascii() and c.isalnum()), sizes, strict=True):
        value, total = value * n + (int(c) if n == 10 else ord(c.lower()) - 97), total * n
    shape = "".join(c if not (c.isascii() and c.isalnum()) else "9" if _digit(c) else "a" if c.islower() else "A" for c in s)
    value = permute(value, total, key, f"{kind}/{shape}")
    fresh = []
    for n in reversed(sizes):
        value, x = divmod(value, n)
        fresh.append(str(x) if n == 10 else chr(97 + x))
    it = reversed(fresh)
    return "".join((x if c.isdigit() or c.islower() else x.upper()) if c.isascii() and c.isalnum() and (x := next(it)) else c for c in s)


def _email(m: re.Match, key: bytes) -> str:
    local, _, host = m.group().partition("@")
    return f"{_classes(local, key, 'email')}@{host}"


_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _widths(day: dt.date) -> tuple[bool, bool]:
    return day.month > 9, day.day > 9


#: The days that need as many digits for month and day, in order.
_DAYS: dict[tuple[bool, bool], list[int]] = {}
for _n in range(_FIRST, _LAST + 1):
    _DAYS.setdefault(_widths(dt.date.fromordinal(_n)), []).append(_n)


def _date(m: re.Match, key: bytes) -> str | None:
    s = m.group()
    fields = re.findall("[0-9]+", s)
    order = "ymd" if len(fields[0]) == 4 else "mdy" if "/" in s else "dmy"
    parts = {k: int(x) for k, x in zip(order, fields, strict=True)}
    try:
        day = dt.date(parts["y"], parts["m"], parts["d"])
    except ValueError:
        return None
    if not _FIRST <= day.toordinal() <= _LAST:
        return None
    alike = _DAYS[_widths(day)]
    new = dt.date.fromordinal(alike[permute(bisect_left(alike, day.toordinal()), len(alike), key, f"date/{_widths(day)}")])
    fresh = {"y": new.year, "m": new.month, "d": new.day}
    it = iter(order)
    return re.sub("[0-9]+", lambda x: str(fresh[next(it)]).zfill(len(x.group())), s)


_RULES: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _email),
    ("mac", r"(?<![\w:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\w:-])", _hex),
    ("secret", r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])", _hex),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    ("date", r"(?<![\w.,/-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![\w/-])", _date),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", _ip),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+])\+[0-9]{10,15}(?!\w)", _phone),
    ("card", r"(?<![\w.])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{9,19})(?!\w)", _number),
)
_PATTERN = re.compile("|".join(f"(?P<{n}>{p})" for n, p, _ in _RULES))
_ACT = {n: f for n, _, f in _RULES}


def pseudonymise(text: str, key: bytes) -> tuple[str, int]:
    """The text with its findings replaced, and their number."""
    count = 0

    def swap(m: re.Match) -> str:
        nonlocal count
        new = _ACT[m.lastgroup](m, key)
        if new is None:
            return m.group()
        count += 1
        return new

    return _PATTERN.sub(swap, text), count


def replace_texts(texts: pa.Array, key: bytes) -> tuple[pa.Array, pa.Array]:
    """The pseudonymised texts and the number of findings in each; only texts with a digit or @ are searched."""
    some = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]|[0-9A-Fa-f]{32}"), False)
    out, counts = [], [0] * len(texts)
    rows = pc.indices_nonzero(some).to_pylist()
    for r in rows:
        new, counts[r] = pseudonymise(texts[r].as_py(), key)
        out.append(new)
    return pc.replace_with_mask(texts, some, pa.array(out, texts.type)), pa.array(counts, pa.int32())


def apply(docs: DataFrame, text_col: str = "text", key: bytes | None = None, count_col: str | None = None) -> DataFrame:
    """``docs`` with the text column pseudonymised and, if named, a column with the number of findings; the key is the session's if none is given."""
    arrow_batches(docs.sparkSession)
    key = session_key(docs.sparkSession) if key is None else key
    _hashed(key)
    if count_col is not None:
        docs = without(docs, count_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            columns = x.columns
            columns[at], counts = replace_texts(x.column(at), key)
            names = list(x.schema.names)
            if count_col is not None:
                columns.append(counts)
                names.append(count_col)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_rows(docs, run, "" if count_col is None else f"`{count_col}` int")
