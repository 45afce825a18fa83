"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel networks.

Candidates are found by pattern and validated (checksums, ranges, calendar).
Each valid one is mapped within its own format by a keyed permutation: the
digits of a number to other digits of the same count whose check digits are
right again, an address octet to an octet, a date to a date of the same
notation. The permutation is one of values, not of notations: a card with or
without blanks, a phone number with any marks, a date as ISO, dotted or
slashed have the same pseudonym, in every document, and different values
have different ones. With the key and the spans that are returned it can be
undone (``restore``).

Kinds: ``card`` (13-19 digits, Luhn), ``iban`` (mod 97), ``ssn`` (area, group
and serial in range), ``phone`` (+country code, 8-15 digits, or a national
number with area code; the country code stays), ``ipv4``, ``date`` (ISO,
dotted, or slashed with the month first; 1900 to 2099), ``date_dmy`` (slashed,
its first number too large for a month), ``number`` (any other run of 13-19
digits, of which the payment networks' lengths are the usual case), ``email``
(letters and digits of the local part, permuted within their classes),
``secret`` (40 hex digits in quotes, permuted as hex).

Not found: numbers in words, dates with month names or without leading
zeros, national phone numbers without brackets, secrets without quotes or of
other lengths, names and postal addresses.

Defined cases: null stays null; empty texts stay empty; overlapping candidates
go to the earliest, then to the first kind in the order below; repeated rows get equal
results.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable
from datetime import date, timedelta
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import prepare_python

_ROUNDS = 8


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: balanced Feistel rounds over mixed radices, walked until within size."""
    if size < 2:
        return value
    a = 1
    while a * a < size:
        a += max(1, a >> 4) if a > 64 else 1
    # a * a >= size: left and right halves both in 0 .. a - 1.
    while True:
        left, right = divmod(value, a)
        for r in range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS):
            if back:
                left, right = (right - _round(key, tweak, r, left)) % a, left
            else:
                left, right = right, (left + _round(key, tweak, r, right)) % a
        value = left * a + right
        if value < size:
            return value


def _round(key: bytes, tweak: str, r: int, half: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{tweak}|{r}|{half}".encode(), "sha256")[:12], "big")


def luhn_ok(digits: str) -> bool:
    return _luhn(digits) == 0


def _luhn(digits: str) -> int:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10


def _fill(pattern: str, digits: str) -> str:
    """pattern with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _permute_digits(d: str, key: bytes, tweak: str, back: bool) -> str:
    return str(feistel(int(d), 10 ** len(d), key, f"{tweak}{len(d)}", back)).zfill(len(d))


def _is_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and luhn_ok(d) and len(set(d)) > 1


def _card_map(s: str, key: bytes, back: bool) -> str:
    body = _permute_digits(_digits(s)[:-1], key, "card", back)
    return _fill(s, body + str(-_luhn(body + "0") % 10))


def _card_end(s: str) -> int | None:
    """Where the card at the start of s ends: a whole run of digits goes first, then groups by one mark, then longer ends."""
    ends = [m.start() for m in re.finditer(r"[ -]", s)] + [len(s)]
    mark = s[ends[0] : ends[0] + 1]
    even = max(e for e in ends if set(s[:e]) & {" ", "-"} <= {mark})
    return next((e for e in (ends[0], even, *reversed(ends)) if _is_card(_digits(s[:e]))), None)


def _card(s: str, key: bytes, back: bool) -> str | None:
    """The card at the start of s mapped, without what follows it."""
    e = _card_end(s)
    return None if e is None else _card_map(s[:e], key, back)


def _number(s: str, key: bytes, back: bool) -> str | None:
    d = _digits(s)
    if luhn_ok(d):
        return None
    # Numbers that fail the check stay numbers that fail it: the last digit moves among the nine wrong ones.
    body = _permute_digits(d[:-1], key, "number", back)
    right, new_right = -_luhn(d[:-1] + "0") % 10, -_luhn(body + "0") % 10
    off = (int(d[-1]) - right) % 10
    return _fill(s, body + str((new_right + off) % 10))


def _iban(s: str, key: bytes, back: bool) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34:
        return None
    value = lambda t: int("".join(str(int(c, 36)) for c in t))
    if value(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _classes(flat[4:], key, "iban", back)
    check = 98 - value(body + flat[:2] + "00") % 97
    new = iter(flat[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = area - 1 - (area > 666)
    n = feistel((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", back)
    rank, serial = divmod(n, 9999)
    rank, group = divmod(rank, 99)
    area = rank + 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


#: The country calling codes of one and of two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(s: str, key: bytes, back: bool) -> str | None:
    d = _digits(s)
    if not 8 <= len(d) <= 15:
        return None
    head = next((k for k in (1, 2) if d[:k] in _CODES), 3) if s[0] == "+" else 0
    return _fill(s, d[:head] + _permute_digits(d[head:], key, f"phone{d[:head]}", back))


def _ipv4(s: str, key: bytes, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    n = 0
    for p in parts:
        n = n * 256 + int(p)
    n = feistel(n, 1 << 32, key, "ipv4", back)
    return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))


_FIRST = date(1900, 1, 1)
_DAYS = (date(2100, 1, 1) - _FIRST).days


def _date_of(s: str, key: bytes, back: bool, order: str) -> str | None:
    """s with its numbers in that order of y, m and d; every order is of the same days."""
    parts = dict(zip(order, map(int, re.split(r"\D", s))))
    try:
        day = (date(parts["y"], parts["m"], parts["d"]) - _FIRST).days
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = _FIRST + timedelta(feistel(day, _DAYS, key, "date", back))
    mark = next(x for x in s if not x.isdigit())
    return mark.join(f"{new.year:04d}" if x == "y" else f"{new.month:02d}" if x == "m" else f"{new.day:02d}" for x in order)


def _date(s: str, key: bytes, back: bool) -> str | None:
    order = "ymd" if s[4] == "-" else "dmy" if s[2] == "." else "mdy"
    return _date_of(s, key, back, order)


def _date_dmy(s: str, key: bytes, back: bool) -> str | None:
    return _date_of(s, key, back, "dmy")


def _classes(s: str, key: bytes, tweak: str, back: bool) -> str:
    """Digits to digits, ASCII letters to letters of their case, jointly permuted; the rest stays."""
    radix = [10 if c.isdigit() else 26 for c in s if c.isascii() and c.isalnum()]
    low = [ord("0") if c.isdigit() else ord("a") if c.islower() else ord("A") for c in s if c.isascii() and c.isalnum()]
    n, size = 0, 1
    for c, r, b in zip((c for c in s if c.isascii() and c.isalnum()), radix, low):
        n, size = n * r + ord(c) - b, size * r
    n = feistel(n, size, key, f"{tweak}{''.join(map(str, radix))}", back)
    out = []
    for r, b in zip(reversed(radix), reversed(low)):
        n, k = divmod(n, r)
        out.append(chr(b + k))
    it = iter(reversed(out))
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in s)


def _email(s: str, key: bytes, back: bool) -> str | None:
    local, _, domain = s.rpartition("@")
    # Long names are permuted in parts, each with all that stands before it as a tweak's length only.
    parts = [local[k : k + 16] for k in range(0, len(local), 16)]
    return "".join(_classes(p, key, f"email{k}", back) for k, p in enumerate(parts)) + "@" + domain


def _secret(s: str, key: bytes, back: bool) -> str | None:
    upper = s == s.upper()
    new = s[1:-1]
    if new.isdigit() or new.isalpha():
        return None
    # Walked until there are letters and digits again, which keeps the case known.
    while True:
        new = f"{feistel(int(new, 16), 16 ** len(new), key, f'secret{len(new)}', back):0{len(new)}x}"
        if not (new.isdigit() or new.isalpha()):
            return s[0] + (new.upper() if upper else new) + s[-1]


#: Kinds in order of precedence: pattern, and the map that validates (None: not of this kind).
KINDS: dict[str, tuple[str, Callable[[str, bytes, bool], str | None]]] = {
    "secret": (r'"(?:[0-9a-f]{40}|[0-9A-F]{40})"', _secret),
    "email": (r"(?<!(?u:[\w.+-]))(?u:[\w.+-]++)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _email),
    "iban": (r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    "ipv4": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ipv4),
    "date": (r"(?<!\d)(?:(?:19|20)\d\d-\d\d-\d\d|\d\d[./]\d\d[./](?:19|20)\d\d)(?!\d)", _date),
    "date_dmy": (r"(?<!\d)(?:1[3-9]|2\d|3[01])/\d\d/(?:19|20)\d\d(?!\d)", _date_dmy),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "card": (r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)", _card),
    "phone": (r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)", _phone),
    "number": (r"(?<!\d)\d{13,19}(?!\d)", _number),
}
_EACH = {k: (re.compile(p, re.ASCII), f) for k, (p, f) in KINDS.items()}
_ANY = re.compile("|".join(p for p, _ in KINDS.values()), re.ASCII)
#: All kinds but e-mail have a digit, which makes the search of a text without an at sign quick.
_DIGITS = re.compile("|".join(p for k, (p, _) in KINDS.items() if k != "email"), re.ASCII)
_DIGIT = re.compile(r"[0-9]")


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str, int]]]:
    """The text with pseudonyms, and (start, end, kind) of each in the input with the length of the pseudonym (an address can
    get shorter or longer)."""
    if not text:
        return text, []
    search = _ANY.search if "@" in text else _DIGITS.search if _DIGIT.search(text) else None
    if search is None:
        return text, []
    out, spans, at, pos = [], [], 0, 0
    while m := search(text, pos):
        start, new = m.start(), None
        for kind, (pattern, to) in _EACH.items():
            own = pattern.match(text, start)
            if own and (new := to(own[0], key, False)) is not None:
                end = start + len(new) if kind == "card" else own.end()  # further digits can follow a card
                break
        if new is None:
            pos = start + 1
            continue
        out += [text[at:start], new]
        spans.append((start, end, kind, len(new)))
        at = pos = end
    return ("".join([*out, text[at:]]) if spans else text), spans


def pseudonymise_documents(docs: DataFrame, key: bytes, *, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with the text column replaced by pseudonymised text, and a column ``out``: array of (start, end, kind, length), the
    first three in the input, length that of the pseudonym."""
    secret = sha256(key).digest()
    prepare_python(docs.sparkSession)

    @F.pandas_udf("text string, spans array<struct<start: int, end: int, kind: string, length: int>>")
    def apply(texts: pd.Series) -> pd.DataFrame:
        done = [pseudonymise(t, secret) for t in texts]
        return pd.DataFrame({"text": pd.Series([t for t, _ in done], dtype=object),
                             "spans": [[{"start": a, "end": b, "kind": k, "length": n} for a, b, k, n in s] for _, s in done]})

    done = docs.withColumn("__pii", apply(F.col(text_col)))
    return done.withColumn(text_col, F.col("__pii")["text"]).withColumn(out, F.col("__pii")["spans"]).drop("__pii")


def restore(text: str | None, spans, key: bytes) -> str | None:
    """The text before pseudonyms, given the key and the spans that came with them."""
    if not text:
        return text
    secret, out, at, moved = sha256(key).digest(), [], 0, 0
    for start, end, kind, length in spans:
        a = start + moved
        out += [text[at:a], KINDS[kind][1](text[a : a + length], secret, True)]
        at, moved = a + length, moved + length - (end - start)
    return "".join([*out, text[at:]])
