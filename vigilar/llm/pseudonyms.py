"""Format-preserving pseudonyms for private numbers, dates and identifiers, by a keyed Feistel permutation.

A value is found by its pattern and kept only if it is valid: check digits, ranges and the
calendar are tested. Its free characters form a number below a known bound. A Feistel network on
the bits of that bound permutes it; results outside the bound or the format are permuted again
(cycle-walking), so that the whole stays a permutation of the valid values. Separators, length,
letter case, issuer digit and country stay, check digits are made anew. The same key gives equal
values the same pseudonym in every document; no table of values is kept or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigilar.llm import words as W

ROUNDS = 8
KINDS = ("email", "iban", "key", "date", "ssn", "ip", "card", "phone")

# Lengths of account numbers by country (public registry of IBAN formats).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_MAYBE = re.compile(r"[0-9@]")
_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?<![\w.:/-])(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w/-]|\.\d)"
    r"|(?<![\w.-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"
    r"|(?<![\w.+-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w.+-])(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?![\w-]))"
)


class Permuter:
    """Keyed permutations of 0..n-1, one for each kind of value and bound."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _once(self, x: int, bits: int, tweak: bytes) -> int:
        half = bits // 2
        mask = (1 << half) - 1
        left, right = x >> half, x & mask
        width = (half + 7) // 8
        for r in range(ROUNDS):
            f = blake2b(bytes([r]) + tweak + right.to_bytes(width, "big"), digest_size=min(64, width + 8), key=self.key).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        return (left << half) | right

    def permute(self, x: int, n: int, kind: str, fits: Callable[[int], bool] | None = None) -> int:
        """Image of ``x`` among the numbers below ``n`` that fit (``x`` has to be one of them)."""
        bits = max(2, (n - 1).bit_length())
        bits += bits % 2
        tweak = f"{kind}:{n}:".encode()
        while True:
            x = self._once(x, bits, tweak)
            if x < n and (fits is None or fits(x)):
                return x


def luhn(digits: str) -> int:
    """Check digit that makes ``digits`` plus it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced one by one."""
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in pattern)


def _radix(c: str) -> tuple[str, int] | None:
    if "0" <= c <= "9":
        return "0", 10
    if "a" <= c <= "z":
        return "a", 26
    if "A" <= c <= "Z":
        return "A", 26
    return None


def _permute_characters(p: Permuter, text: str, kind: str) -> str:
    """Letters stay letters of their case, digits stay digits, all else stays."""
    value, bound = 0, 1
    shape = []
    for c in text:
        known = _radix(c)
        shape.append(known)
        if known:
            value = value * known[1] + ord(c) - ord(known[0])
            bound *= known[1]
    if bound == 1:
        return text
    value = p.permute(value, bound, kind + "".join(k[0] if k else "-" for k in shape))
    out = []
    for c, known in zip(reversed(text), reversed(shape), strict=True):
        if known:
            value, d = divmod(value, known[1])
            c = chr(ord(known[0]) + d)
        out.append(c)
    return "".join(reversed(out))


def _email(p: Permuter, text: str) -> str:
    # Addresses that differ in letter case stay linked: letters are permuted without it and get it back.
    local, _, domain = text.partition("@")
    fresh = _permute_characters(p, local.lower(), "email")
    return "".join(f.upper() if c.isupper() else f for c, f in zip(local, fresh, strict=True)) + f"@{domain}"


def _key(p: Permuter, text: str) -> str:
    return text[:4] + _permute_characters(p, text[4:], "key")


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country) + '00') % 97:02d}"


def _iban(p: Permuter, text: str) -> str | None:
    plain = text.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if IBAN_LENGTHS.get(country) != len(plain) or _iban_check(country, body) != plain[2:4]:
        return None
    body = _permute_characters(p, body, f"iban{country}")
    fresh = iter(country + _iban_check(country, body) + body)
    return "".join(c if c == " " else next(fresh) for c in text)


def _ordinal(year: int, month: int, day: int) -> int | None:
    try:
        return date(year, month, day).toordinal() - 1
    except ValueError:
        return None


_RECENT = date(1900, 1, 1).toordinal() - 1
_RECENT_DAYS = date(2099, 12, 31).toordinal() - _RECENT


def _date(p: Permuter, text: str) -> str | None:
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    widths = [len(x) for x in parts]
    a, b, c = map(int, parts)
    if widths[0] == 4:
        order = "ymd"
        x = _ordinal(a, b, c)
    else:
        order = "dmy" if mark == "." else "mdy"
        x = _ordinal(c, a, b) if order == "mdy" else _ordinal(c, b, a)
        if x is None and order == "mdy":
            order = "dmy"
            x = _ordinal(c, b, a)
    if x is None:
        return None
    padded = any(w == 2 and v < 10 for w, v in zip(widths, (a, b, c), strict=True))
    loose = any(w == 1 for w in widths)

    # One permutation of days for all spellings. Days after the 12th stay such: then a spelling that was read
    # day first, because its day is no month, is read so again.
    day_of = lambda x: date.fromordinal(x + 1)
    late, recent = day_of(x).day > 12, 1900 <= day_of(x).year < 2100
    low, n = (_RECENT, _RECENT_DAYS) if recent else (0, date.max.toordinal())

    def fits(x: int) -> bool:
        d = day_of(x + low)
        return late == (d.day > 12) and recent == (1900 <= d.year < 2100)

    d = day_of(p.permute(x - low, n, f"date{late}", fits) + low)
    form = "{:02d}" if padded or not loose else "{}"
    day, month, year = form.format(d.day), form.format(d.month), f"{d.year:04d}"
    return mark.join({"ymd": (year, month, day), "dmy": (day, month, year), "mdy": (month, day, year)}[order])


def _ssn_valid(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(p: Permuter, text: str) -> str | None:
    x = int(text.replace("-", ""))
    return _refill(text, f"{p.permute(x, 10**9, 'ssn', _ssn_valid):09d}") if _ssn_valid(x) else None


def _ip(p: Permuter, text: str) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    x = 0
    for part in parts:
        x = x * 256 + int(part)
    x = p.permute(x, 1 << 32, "ip")
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _card(p: Permuter, text: str) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if luhn(digits[:-1]) != int(digits[-1]) or digits[0] == "0" or len(set(digits)) == 1:
        return None
    size = len(digits) - 2
    body = digits[0] + f"{p.permute(int(digits[1:-1]), 10**size, 'card' + digits[0]):0{size}d}"
    return _refill(text, body + str(luhn(body)))


def _north_american(x: int) -> bool:
    return x // 10**9 >= 2 and x // 10**6 % 10 >= 2


def _phone(p: Permuter, text: str) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if not 8 <= len(digits) <= 15:
        return None
    country = ""
    if text[0] == "+":
        country = re.match(r"\+(\d{1,3}?)(?=[ .(-]|\d{6,}$)", text)
        country = country[1] if country else digits[:1]
        if digits[0] in "17":
            country = digits[0]
    rest = digits[len(country) :]
    fits, kind = None, f"phone{country}"
    if len(rest) == 10 and country in ("", "1"):
        # With a country code any number goes; those of the North American plan stay such.
        planned = _north_american(int(rest))
        if not planned and not country:
            return None
        fits, kind = lambda x: _north_american(x) == planned, f"phone1{planned}"
    else:  # what follows the country code begins with 0 only if it did
        least = 10 ** (len(rest) - 1)
        led = int(rest) >= least
        fits, kind = lambda x: (x >= least) == led, f"phone{country}{led}"
    return _refill(text, country + f"{p.permute(int(rest), 10 ** len(rest), kind, fits):0{len(rest)}d}")


_MAKE: dict[str, Callable[[Permuter, str], str | None]] = {"email": _email, "iban": _iban, "key": _key, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone}


def _shorter(kind: str, text: str, start: int, stop: int) -> Iterator[int]:
    """Ends before ``stop`` at which a value of another valid length may end: patterns are greedy."""
    if kind == "card":
        ends = [i + 1 for i in range(start, stop) if text[i].isdigit()]
        yield from reversed(ends[12:-1])
    elif kind == "iban":
        size, seen = IBAN_LENGTHS.get(text[start : start + 2]), 0
        for i in range(start, stop):
            seen += text[i] != " "
            if seen == size and i + 1 < stop:
                yield i + 1
                return


def _apart(text: str, end: int) -> bool:
    """Whether a value that ends at ``end`` is not followed by more of the same number or word."""
    return not (text[end].isalnum() or text[end] in "_-")


def pseudonymise(text: str, permuter: Permuter) -> tuple[str, dict[str, int]]:
    """The text with all valid private values replaced, and how many of each kind there were."""
    counts: dict[str, int] = {}
    if not _MAYBE.search(text):
        return text, counts
    out, at = [], 0
    while True:
        found = _FIND.search(text, at)
        if not found:
            break
        kind = found.lastgroup
        end = found.end()
        fresh = _MAKE[kind](permuter, found[0])
        if fresh is None:
            for end in _shorter(kind, text, found.start(), found.end()):
                fresh = _MAKE[kind](permuter, text[found.start() : end]) if _apart(text, end) else None
                if fresh is not None:
                    break
        if fresh is None:  # not valid as this kind: look again one character on
            stop = found.start() + 1
            out.append(text[at:stop])
            at = stop
            continue
        out += [text[at : found.start()], fresh]
        at = end
        counts[kind] = counts.get(kind, 0) + 1
    out.append(text[at:])
    return "".join(out), counts


def _rows(key: bytes, n_carried: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuter = Permuter(key)
        for batch in batches:
            done = [pseudonymise(t, permuter) if t else (t, {}) for t in batch.column("text").to_pylist()]
            columns = [batch.column(i) for i in range(n_carried)]
            columns += [pa.array([t for t, _ in done], pa.string())] + [pa.array([c.get(k, 0) for _, c in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{i}" for i in range(n_carried)), "text", *KINDS])

    return run


def pseudonymise_documents(docs: DataFrame, key: bytes, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, text with pseudonyms, and the number of values by kind (n_email, ...) for every row.

    A null text stays null, an empty one empty. Repeated rows each give the same row, null ids
    are kept, an empty table gives an empty result. Values that are not valid are left alone.
    Who knows ``key`` can turn pseudonyms back; there is no default for it.
    """
    if len(key) < 8:
        raise ValueError("pseudonyms need a secret key of at least eight bytes")
    W.bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").cast("string").alias("text"))
    schema = StructType(list(rows.schema.fields))
    for k in KINDS:
        schema = schema.add(k, "long")
    done = rows.mapInArrow(_rows(key, len(columns)), schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "text", *[F.col(k).alias(f"n_{k}") for k in KINDS])
