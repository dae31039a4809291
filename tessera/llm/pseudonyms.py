"""PII: format-preserving Feistel pseudonyms.

Numbers and dates that pass their format's validation are replaced by their
image under a keyed permutation of the format: a card number becomes another
card number with a right check digit, a date another date. Equal values get
equal pseudonyms in every document, different values different ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.feistel import permute_one

#: Dates of these years are permuted among each other.
FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)
_DAYS = (LAST - FIRST).days + 1
_SPAN = "struct<kind:string,start:int,end:int,pseudonym:string>"
_HINT = re.compile(r"[0-9@]")

#: Lengths of IBANs by country (ISO 13616 registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 - k % 2)
        total += v - 9 * (v > 9)
    return -total % 10


def _permuted(text: str, key: bytes, kind: bytes) -> str:
    """Letters to letters of the same case and digits to digits, as one mixed-radix number; other characters stay."""
    radix = [10 if "0" <= c <= "9" else 26 if "a" <= c.lower() <= "z" and c.isascii() else 0 for c in text]
    value, size = 0, 1
    for c, r in zip(text, radix, strict=True):
        if r:
            value = value * r + (int(c) if r == 10 else ord(c.lower()) - 97)
            size *= r
    shape = bytes(radix)
    value = permute_one(value, size, key, kind + shape)
    out = []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        if r:
            value, d = divmod(value, r)
            c = str(d) if r == 10 else chr(97 + d).upper() if c.isupper() else chr(97 + d)
        out.append(c)
    return "".join(reversed(out))


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in turn."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in text)


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = _permuted(digits[:-1], key, b"card")
    return _refill(m[0], body + str(luhn(body)))


def _phone(m: re.Match, key: bytes) -> str | None:
    country, rest = m["country"] or "", m["rest"]
    digits = re.sub(r"\D", "", rest)
    if not (7 if country else 10) <= len(digits) <= 14 or not country and not re.fullmatch(r"\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}", rest):
        return None
    return country + _refill(rest, _permuted(digits, key, b"phone"))


def _social(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(m: re.Match, key: bytes) -> str | None:
    digits = m[0].replace("-", "")
    if not _social(digits):
        return None
    while True:  # again until the image is a valid number: still a permutation of the valid ones
        digits = _permuted(digits, key, b"ssn")
        if _social(digits):
            return _refill(m[0], digits)


def _ip(m: re.Match, key: bytes) -> str | None:
    octets = m[0].split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    value = permute_one(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _checked(country: str, body: str) -> str:
    """The two check digits of an IBAN."""
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


def _iban(m: re.Match, key: bytes) -> str | None:
    plain = m[0].replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if IBAN_LENGTHS.get(country) != len(plain) or _checked(country, body) != check:
        return None
    body = _permuted(body, key, b"iban" + country.encode())
    left = iter(country + _checked(country, body) + body)
    return "".join(c if c == " " else next(left) for c in m[0])


def _email(m: re.Match, key: bytes) -> str | None:
    local, _, domain = m[0].rpartition("@")
    return f"{_permuted(local, key, b'mail' + domain.lower().encode())}@{domain}"


def _dated(year: int, month: int, day: int) -> date | None:
    try:
        d = date(year, month, day)
    except ValueError:
        return None
    return d if FIRST <= d <= LAST else None


def _date(m: re.Match, key: bytes) -> str | None:
    first, mark, second, third = m["a"], m["mark"], m["b"], m["c"]
    if len(first) == 4:
        order = "ymd"
    elif len(third) == 4:
        # with slashes the month comes first if it can, else the day
        order = "mdy" if mark == "/" and int(first) <= 12 else "dmy"
    else:
        return None
    part = dict(zip(order, (first, second, third), strict=True))
    day = _dated(*(int(part[k]) for k in "ymd"))
    if day is None:
        return None
    new = FIRST + timedelta(permute_one((day - FIRST).days, _DAYS, key, b"date"))
    # without leading zeros only where the old date has none
    short = any(len(part[k]) == 1 for k in "md")
    text = {"y": f"{new.year}", "m": f"{new.month}" if short else f"{new.month:02d}", "d": f"{new.day}" if short else f"{new.day:02d}"}
    return mark.join(text[k] for k in order)


#: In order of precedence: of overlapping values the earlier kind wins.
KINDS: list[tuple[str, re.Pattern, Callable[[re.Match, bytes], str | None]]] = [
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), _iban),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), _ip),
    ("date", re.compile(r"(?<![\w./-])(?P<a>\d{4}|\d{1,2})(?P<mark>[-./])(?P<b>\d{1,2})(?P=mark)(?P<c>\d{4}|\d{1,2})(?!(?!T\d)[\w-]|[./]\d)"), _date),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    ("phone", re.compile(r"(?<![\w+])(?P<country>\+\d{1,3}[ .-]?)?(?P<rest>\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4})(?![\w]|[.-]\d)"), _phone),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)"), _card),
]


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _mail(text: str, at: int) -> re.Match | None:
    """The first e-mail address from ``at`` on: what stands around each @, so that long runs without one are passed over once."""
    pattern = KINDS[0][1]
    while (mark := text.find("@", at)) >= 0:
        low = mark
        while low > at and text[low - 1] in _LOCAL:
            low -= 1
        while low < mark and not text[low].isalnum():
            low += 1
        if m := low < mark and pattern.match(text, low):
            return m
        at = mark + 1
    return None


def find(text: str, key: bytes) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of the valid values of a text, in order; positions in characters."""
    if not _HINT.search(text):
        return []
    found: list[tuple[str, int, int, str]] = []
    taken: list[tuple[int, int]] = []  # in order, none overlaps another
    for kind, pattern, image in KINDS:
        look = _mail if kind == "email" else pattern.search
        at = 0
        while m := look(text, at):
            # a match may have swallowed what stands around the value: shorter ones end and start at a space
            for end in (m.end(), *(m.start() + k for k in range(len(m[0]) - 1, 0, -1) if m[0][k] == " ")):
                part = m if end == m.end() else pattern.fullmatch(text, m.start(), end)
                near = bisect_left(taken, (end, 0)) - 1  # of the values that begin before this ends, the last ends last
                if part is None or near >= 0 and taken[near][1] > m.start():
                    continue
                new = image(part, key)
                if new is not None:
                    found.append((kind, m.start(), end, new))
                    at = end
                    break
            else:
                gap = text.find(" ", m.start(), m.end())
                at = m.end() if gap < 0 else gap + 1
        taken = sorted((a, b) for _, a, b, _ in found)
    return sorted(found, key=lambda f: f[1])


def replaced(text: str, found: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for _, a, b, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def _pieces(column: pa.Array) -> Iterator[tuple[int, str]]:
    for r, v in enumerate(column):
        if v.is_valid:
            yield r, v.as_py()


def private_values(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold valid personal values: (id, n_values, values, text), text with pseudonyms.

    Values are e-mail addresses, IBANs, IPv4 addresses, dates of 1900 to 2099,
    US social security numbers, telephone numbers and payment card numbers.
    Numbers that fail their format's validation stay. Positions count
    characters of the old text; old values are not returned. Of overlapping
    values the kind listed first wins.

    Null, empty and clean texts: no rows. Null ids and repeated rows: reported
    like any other. Other columns are ignored. Empty table: no rows.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
        for batch in batches:
            rows = [(r, t, f) for r, t in _pieces(batch.column(1)) if (f := find(t, key))]
            ids = batch.column(0).take(pa.array([r for r, _, _ in rows], pa.int64()))
            values = pa.array([[dict(zip(("kind", "start", "end", "pseudonym"), v, strict=True)) for v in f] for _, _, f in rows], kind)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(f) for _, _, f in rows], pa.int32()), values, pa.array([replaced(t, f) for _, t, f in rows], pa.string())], [id_col, "n_values", "values", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_values int, values array<{_SPAN}>, text string")


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text column; all rows and columns stay, null texts stay null."""

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        out = [None] * len(text)
        for r, t in _pieces(text):
            out[r] = replaced(t, find(t, key))
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
