"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

Each kind is found by a pattern and validated (Luhn, mod-97, octet range, calendar, area codes). The value's
free symbols are read as one number in the mixed radix of its format and permuted by a keyed balanced Feistel network with cycle
walking; check digits are computed anew. So the pseudonym has the format and the validity of the original, equal values are
linked across documents, different values stay different, and the key's holder can invert it.

A card or bank account number may be followed by other digits or words that its pattern takes in: each end at the end of a group is
tried, for a card the shortest first, for a bank account the country's length first. A card's pseudonym has valid check digits
at the same shorter lengths as the card, so both are read with the same end.

Cases: a null text stays null, an empty one empty; values that fail validation at every end stay; overlapping finds go to the first
pattern in the list, left to right; repeated rows get equal pseudonyms; other columns stay.
"""
from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
#: Key of the registered query; a deployment passes its own.
KEY = "termflow-demo-key"


def permute(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """Keyed permutation of range(size): Feistel on the next even number of bits, walked until the result is inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            x = left if inverse else right
            need, f = (half + 255) // 256, b""
            for i in range(need):
                f += hmac.digest(key, f"{tweak}|{size}|{r}|{i}|".encode() + x.to_bytes(width, "big"), "sha256")
            f = int.from_bytes(f, "big") & mask
            left, right = (right ^ f, left) if inverse else (right, left ^ f)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _numeral(symbols: str, alphabets: list[str], key: bytes, tweak: str, inverse: bool) -> str:
    value, size = 0, 1
    for c, a in zip(symbols, alphabets, strict=True):
        value, size = value * len(a) + a.index(c), size * len(a)
    value = permute(value, size, key, tweak, inverse)
    out = []
    for a in reversed(alphabets):
        value, d = divmod(value, len(a))
        out.append(a[d])
    return "".join(reversed(out))


DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _alphabet(c: str) -> str | None:
    return next((a for a in (DIGITS, LOWER, UPPER) if c in a), None)


def _symbols(text: str, key: bytes, tweak: str, inverse: bool) -> str:
    """Letters and digits permuted class by class in place, all else kept."""
    at = [(i, a) for i, c in enumerate(text) if (a := _alphabet(c))]
    new = _numeral("".join(text[i] for i, _ in at), [a for _, a in at], key, tweak + "".join(a[0] for _, a in at), inverse)
    out = list(text)
    for (i, _), c in zip(at, new, strict=True):
        out[i] = c
    return "".join(out)


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in text)


def card(text: str, key: bytes, inverse: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    if any(len(g) >= 13 for g in re.findall(r"\d+", text)[1:]):  # such a group is a number of its own
        return None
    shorter = _valid_ends(d)
    while True:
        body = _numeral(d[1:-1], [DIGITS] * (len(d) - 2), key, "card" + d[0], inverse)
        d = d[0] + body + luhn_digit(d[0] + body)
        if _valid_ends(d) == shorter and len(set(d)) > 1:
            return _refill(text, d)


def _valid_ends(d: str) -> list[int]:
    """Lengths from 13 on, below that of the number, at which its beginning has a right check digit."""
    return [n for n in range(13, len(d)) if luhn_digit(d[:n - 1]) == d[n - 1]]


def group_ends(text: str) -> list[int]:
    """Ends of the runs of letters and digits."""
    return [m.end() for m in re.finditer(r"[A-Za-z0-9]+", text)]


def card_ends(text: str) -> list[int]:
    return [e for e in group_ends(text) if sum(c in DIGITS for c in text[:e]) >= 13]


def iban_ends(text: str) -> list[int]:
    """The country's length first, then from the longest."""
    size = {e: e - text[:e].count(" ") for e in group_ends(text)}
    return sorted((e for e in size if size[e] >= 15), key=lambda e: (size[e] != IBAN_LENGTHS.get(text[:2]), -e))


#: Lengths in the IBAN registry.
IBAN_LENGTHS = {w[:2]: int(w[2:]) for w in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 "
    "HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 "
    "RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}


def long_number(text: str, key: bytes, inverse: bool) -> str | None:
    """A number of a card's length and issuer digit that fails the check digit: still an account number; all digits but the first are permuted."""
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or d[0] not in "3456" or len(set(d)) == 1:
        return None
    if luhn_digit(d[:-1]) == d[-1]:  # one pseudonym for a valid number, whichever pattern finds it
        return card(text, key, inverse)
    return _refill(text, _unchecked(d, key, inverse))


def _unchecked(d: str, key: bytes, inverse: bool) -> str:
    """Permutation of the numbers that fail the check digit: the offset of the last digit from the right one is kept."""
    off = (int(d[-1]) - int(luhn_digit(d[:-1]))) % 10
    body = _numeral(d[1:-1], [DIGITS] * (len(d) - 2), key, "account" + d[0], inverse)
    return d[0] + body + str((int(luhn_digit(d[0] + body)) + off) % 10)


def iban(text: str, key: bytes, inverse: bool) -> str | None:
    s = text.replace(" ", "")
    code = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or code(s[4:] + s[:4]) % 97 != 1:
        return None
    body = _symbols(s[4:], key, "iban" + s[:2], inverse)
    new = iter(s[:2] + f"{98 - code(body + s[:2] + '00') % 97:02d}" + body)
    return "".join(" " if c == " " else next(new) for c in text)


def phone(text: str, key: bytes, inverse: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 9 <= len(d) <= 15:
        return None
    keep = len(d) - 10 if len(d) > 10 else (1 if d[0] == "0" else 0)
    rest = d[keep:]
    if len(rest) == 10 and (keep == 0 or d[:keep] == "1"):  # area and exchange codes start with 2 to 9
        if rest[0] in "01" or rest[3] in "01":
            return None
        sets = [DIGITS[2:] if i in (0, 3) else DIGITS for i in range(10)]
    else:
        sets = [DIGITS] * len(rest)
    return _refill(text, d[:keep] + _numeral(rest, sets, key, "phone" + d[:keep], inverse))


def social(text: str, key: bytes, inverse: bool) -> str | None:
    a, b, c = (int(x) for x in text.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    area = a - 1 if a < 666 else a - 2  # 898 areas
    v = permute((area * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, key, "social", inverse)
    v, c = divmod(v, 9999)
    area, b = divmod(v, 99)
    return f"{area + 1 if area < 665 else area + 2:03d}-{b + 1:02d}-{c + 1:04d}"


def address(text: str, key: bytes, inverse: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "address", inverse)
    return ".".join(map(str, v.to_bytes(4, "big")))


_FIRST, _DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def date(text: str, key: bytes, inverse: bool) -> str | None:
    """Year first, or day and month before the year (the first number is the month only if the second can't be)."""
    m = re.fullmatch(r"(\d+)([-/.])(\d+)\2(\d+)", text)
    a, b, c = int(m[1]), int(m[3]), int(m[4])
    year_first = len(m[1]) == 4
    month_first = not year_first and b > 12
    y, mo, d = (a, b, c) if year_first else (c, a, b) if month_first else (c, b, a)
    try:
        n = (dt.date(y, mo, d) - _FIRST).days
    except ValueError:
        return None
    if not 0 <= n < _DAYS:
        return None
    days, pick = _DAYS, None
    if month_first:  # such dates are permuted among those that read the same way
        pick = lambda x: (_FIRST + dt.timedelta(x)).day > 12
    tweak = "date" + "m" * month_first
    n = permute(n, days, key, tweak, inverse)
    while pick and not pick(n):
        n = permute(n, days, key, tweak, inverse)
    new = _FIRST + dt.timedelta(n)
    sep, w = m[2], [len(m[1]), len(m[3]), len(m[4])]
    order = (new.year, new.month, new.day) if year_first else (new.month, new.day, new.year) if month_first else (new.day, new.month, new.year)
    return sep.join(str(v).zfill(2) if n_ == 2 or v > 9 else str(v) for v, n_ in zip(order, w, strict=True))


def email(text: str, key: bytes, inverse: bool) -> str | None:
    user, _, host = text.partition("@")
    name, _, tail = host.rpartition(".")
    new = _symbols(user + "@" + name, key, "email" + tail, inverse)
    return f"{new}.{tail}"


def secret(text: str, key: bytes, inverse: bool) -> str | None:
    m = re.fullmatch(r"(AKIA|ASIA|ghp_|sk-|(?i:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*[\"']?)(.+)", text, re.S)
    if not m or not any(c in DIGITS for c in m[2]):
        return None
    return m[1] + _symbols(m[2], key, "secret", inverse)


def hexadecimal(text: str, key: bytes, inverse: bool) -> str | None:
    if not any(c in DIGITS for c in text) or not any(c not in DIGITS for c in text):
        return None
    return _numeral(text, [HEX] * len(text), key, f"hex{len(text)}", inverse)


#: Kind, pattern, function: tried in this order at each position.
KINDS: list[tuple[str, str, Callable[[str, bytes, bool], str | None]]] = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", email),
    ("secret", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:ghp_|sk-)[A-Za-z0-9]{16,}|\b(?i:password|passwd|pwd|secret|token|api_?key)\s?[=:]\s?[\"']?[A-Za-z0-9+/_\-]{8,}", secret),
    ("hex", r"\b(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b", hexadecimal),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("address", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    ("date", r"(?<![\d/.\-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/]|[.\-]\d)", date),
    ("social", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", social),
    ("card", r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])", card),
    ("account", r"(?<![\d\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\d\-])", long_number),
    ("phone", r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d.\-])\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])", phone),
]
#: A text without any of these has nothing to find.
HINT = re.compile(r"[0-9@]")
_ANY = re.compile("|".join(f"(?P<k{i}>{re.sub(r'\\([12])', lambda m, i=i: f'(?P=s{m[1]})', p).replace('([-/.])', '(?P<s1>[-/.])', 1).replace('([-/.])', '(?P<s2>[-/.])', 1)})" for i, (_, p, _) in enumerate(KINDS)))
_EACH = [re.compile(p) for _, p, _ in KINDS]
#: Where a match may end, in the order tried; other kinds only at the end of the match.
_ENDS: dict[str, Callable[[str], list[int]]] = {"card": card_ends, "iban": iban_ends}


class Pseudonymiser:
    """Replaces values in texts; holds the key and the latest values."""

    def __init__(self, key: str, inverse: bool = False):
        self.key, self.inverse = hashlib.sha256(key.encode()).digest(), inverse
        self.one = lru_cache(1 << 16)(self._one)

    def _one(self, kind: int, value: str) -> str | None:
        return KINDS[kind][2](value, self.key, self.inverse)

    def ends(self, kind: int, value: str) -> tuple[str | None, str]:
        """Pseudonym of the value or of its first valid beginning, and what it stands for."""
        ends = _ENDS.get(KINDS[kind][0])
        for end in ends(value) if ends else [len(value)]:
            new = self.one(kind, value[:end])
            if new is not None:
                return new, value[:end]
        return None, value

    def text(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """New text; start, end (in it) and kind of each pseudonym."""
        if not HINT.search(text):
            return text, []
        out, spans, at, size, look = [], [], 0, 0, 0
        while m := _ANY.search(text, look):
            kind = int(m.lastgroup[1:]) if m.lastgroup[0] == "k" else next(i for i in range(len(KINDS)) if m.group(f"k{i}"))
            new, used = self.ends(kind, m[0])
            if new is None:  # a later kind may fit at the same place
                for other in range(kind + 1, len(KINDS)):
                    n = _EACH[other].match(text, m.start())
                    if n:
                        new, used = self.ends(other, n[0])
                        if new is not None:
                            kind = other
                            break
            if new is None:
                look = m.start() + 1
                continue
            out += [text[at:m.start()], new]
            size += m.start() - at
            spans.append((size, size + len(new), KINDS[kind][0]))
            size += len(new)
            at = look = m.start() + len(used)
        return "".join([*out, text[at:]]), spans


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text", spans: str | None = "pii_spans", inverse: bool = False) -> DataFrame:
    """docs with the text replaced and, if `spans` names a column, where each pseudonym stands."""
    docs = docs.drop(spans) if spans else docs
    at, names = docs.columns.index(text), docs.columns

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymiser(key, inverse)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            new, found = [], []
            for t in b.column(at).to_pylist():
                t, s = (None, []) if t is None else p.text(t)
                new.append(t)
                found.append([{"start": x, "end": y, "kind": k} for x, y, k in s])
            columns = list(b.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(found, kind)] if spans else [])], [*names, *([spans] if spans else [])])

    return docs.mapInArrow(job, T.StructType([*docs.schema.fields, *([T.StructField(spans, SPANS)] if spans else [])]))
