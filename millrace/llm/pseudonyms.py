"""Format-preserving pseudonyms for personal data.

A value is validated (check digits, octets, calendar), written as a number of its own format and
permuted there by a keyed Feistel network, so the result is again valid in that format and equal
values stay equal in all documents under one key. A Feistel network alternates between the two
halves of the digits and adds to one a keyed hash of the other, which is a permutation whatever the
hash is; where only part of a domain is valid, the permutation is repeated until a valid value comes.

A date keeps the order it is written in. With slashes it is read with the month first, unless only the day first makes it a
date; the latter are permuted among themselves, so that no two dates print alike.

Kinds: e-mail addresses (letters and digits before the @ of a well-formed address), telephone numbers
with a country code, payment card numbers (Luhn; check digit made anew), IPv4 addresses, calendar
dates from 1900 to 2099, US social security numbers, IBANs (mod 97; check digits made anew).

Defined cases: null text stays null and has no values; empty text stays empty; repeated rows get equal
results; texts of any length are read whole; an empty table gives an empty result; other columns are
kept as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_texts

ROUNDS = 8
KINDS = ("email", "phone", "card", "ip", "date", "ssn", "iban")
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1

# Country calling codes of one and two digits; all others have three.
_CODES_1 = {"1", "7"}
_CODES_2 = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_START = re.compile(r"\+?[0-9]")
_DIGITS = re.compile(r"\+?[0-9]+")
_SEPARATOR = re.compile(r"[ -]")
_NUMBER = re.compile(
    r"(?<![0-9A-Za-z_])(?:"
    r"(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4})"
    r"|(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})"
    r"|(?P<ip>(?<![0-9A-Za-z_]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\.[0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<card>[0-9](?:[ -]?[0-9]){12,18})"
    r")(?:(?![0-9A-Za-z_])|(?(date)(?<=-[0-9]{2})(?=[Tt][0-9])|(?!)))"
)
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z_])")
#: How cards are usually written: in one run, or in groups of 4-4-4-4, 4-6-5 and the like.
_CARD_SHAPE = re.compile(r"[2-6](?:[0-9]{12,18}|[0-9]{3}([ -])(?:[0-9]{4}\1){2}(?:[0-9]{1,4}|[0-9]{4}\1[0-9]{1,3})|[0-9]{3}([ -])[0-9]{6}\2[0-9]{4,5})")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_IBAN = re.compile(r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z_])")


class Feistel:
    """Keyed permutations of small domains."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _hash(self, tweak: bytes, step: int, value: int) -> int:
        data = b"%d|%d|%b" % (step, value, tweak)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def permute(self, value: int, left: int, right: int, tweak: bytes, back: bool = False) -> int:
        """A permutation of 0 .. left * right - 1."""
        a, b = divmod(value, right)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if step % 2:
                b = (b + sign * self._hash(tweak, step, a)) % right
            else:
                a = (a + sign * self._hash(tweak, step, b)) % left
        return a * right + b

    def within(self, value: int, size: int, tweak: bytes, back: bool = False) -> int:
        """A permutation of 0 .. size - 1, by walking on in a slightly larger domain."""
        side = 1
        while side * side < size:
            side += 1
        while True:
            value = self.permute(value, side, side, tweak, back)
            if value < size:
                return value

    def symbols(self, text: str, tweak: bytes, back: bool = False) -> str:
        """Digits to digits and letters to letters of their case; everything else stays."""
        sizes = [10 if c.isdigit() else 26 for c in text if c.isascii() and c.isalnum()]
        if not sizes:
            return text
        value, left, right = 0, 1, 1
        for k, (c, size) in enumerate(zip([c for c in text if c.isascii() and c.isalnum()], sizes, strict=True)):
            value = value * size + (int(c) if c.isdigit() else ord(c.lower()) - 97)
            if k < len(sizes) // 2:
                left *= size
            else:
                right *= size
        shape = "".join("9" if c.isdigit() else "a" if c.isascii() and c.isalpha() else c for c in text)
        value = self.permute(value, left, right, tweak + b"|" + shape.encode(), back)
        out = []
        for c in reversed(text):
            if c.isascii() and c.isdigit():
                value, d = divmod(value, 10)
                out.append(str(d))
            elif c.isascii() and c.isalpha():
                value, d = divmod(value, 26)
                out.append(chr((65 if c.isupper() else 97) + d))
            else:
                out.append(c)
        return "".join(reversed(out))


def _luhn_digit(digits: str) -> str:
    """The check digit that belongs behind digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 if k % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _is_card(digits: str) -> bool:
    return len(digits) >= 13 and _luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card_ends(text: str, start: int) -> list[tuple[bool, int, int]]:
    """(usual shape, digits, end) of every valid card number from start to the end of a digit run, the best first."""
    m, out = _CARD.match(text, start), []
    end = m.end() if m else -1
    while end > start:
        digits = text[start:end].replace(" ", "").replace("-", "")
        if _is_card(digits):
            out.append((_CARD_SHAPE.fullmatch(text, start, end) is not None, len(digits), end))
        end = max(text.rfind(" ", start, end), text.rfind("-", start, end))
    return sorted(out, reverse=True)


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


class Pseudonymizer:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def phone(self, text: str) -> str | None:
        size = 1 if text[1] in _CODES_1 else 2 if text[1:3] in _CODES_2 else 3
        country, rest = text[: 1 + size], text[1 + size :]
        if not country[1:].isdigit() or not 7 <= sum(c.isdigit() for c in rest) <= 15 - size:
            return None
        return country + _refill(rest, self.feistel.symbols("".join(c for c in rest if c.isdigit()), b"phone"))

    def card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if not _is_card(digits):
            return None
        body = self.feistel.symbols(digits[:-1], b"card")
        return _refill(text, body + _luhn_digit(body))

    def card_end(self, text: str, start: int) -> int | None:
        """Where the card number that begins at start ends: of the valid ones a usual shape, then the longest; None where a usual shape begins inside all of them."""
        ends = _card_ends(text, start)
        if ends and not ends[0][0]:
            for at in [m.end() for m in _SEPARATOR.finditer(text, start, max(end for _, _, end in ends))]:
                if any(usual for usual, *_ in _card_ends(text, at)):
                    ends = [x for x in ends if x[2] < at]
                    break
        return ends[0][2] if ends else None

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = self.feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 16, 1 << 16, b"ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        mark = next(c for c in text if not c.isdigit())
        parts = text.split(mark)
        year, month, day = map(int, parts if mark == "-" else (parts[2], *(parts[:2] if mark == "/" else parts[1::-1])))
        day_first = mark == "." or mark == "/" and month > 12
        if mark == "/" and day_first:
            month, day = day, month
        try:
            number = datetime.date(year, month, day).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= number < _DAYS:
            return None
        while True:
            number = self.feistel.within(number, _DAYS, b"date")
            new = datetime.date.fromordinal(_FIRST_DAY + number)
            if not (mark == "/" and day_first) or new.day > 12:
                break
        if mark == "-":
            return new.isoformat()
        first, second = (new.day, new.month) if day_first else (new.month, new.day)
        wide = 2 if any(len(p) == 2 and p[0] == "0" for p in parts[:2]) else 1
        return f"{first:0{wide}d}{mark}{second:0{wide}d}{mark}{new.year}"

    def ssn(self, text: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = text.replace("-", "")
        if not valid(digits):
            return None
        while True:
            digits = self.feistel.symbols(digits, b"ssn")
            if valid(digits):
                return _refill(text, digits)

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or _iban_check(country, account) != check:
            return None
        account = self.feistel.symbols(account, b"iban" + country.encode())
        rest = iter(country + _iban_check(country, account) + account)
        return "".join(c if c == " " else next(rest) for c in text)

    def email(self, local: str) -> str:
        return self.feistel.symbols(local, b"email")

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, replacement) of all values, none over another."""
        found = []
        at = text.find("@")
        while at >= 0:
            local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
            if local and domain and any(c.isalnum() for c in local[0]):
                found.append((local.start(), domain.end(), "email", self.email(local[0]) + "@" + domain[0]))
            at = text.find("@", at + 1)
        masked, done = [], 0
        for m in _IBAN.finditer(text) if _MAY_IBAN.search(text) else ():
            if new := self.iban(m[0]):
                found.append((m.start(), m.end(), "iban", new))
                masked += [text[done : m.start()], "x" * len(m[0])]
                done = m.end()
        rest, pos = "".join([*masked, text[done:]]), 0  # without IBANs, so that no other number reaches into one
        while m := _START.search(rest, pos):
            pos = _DIGITS.match(rest, m.start()).end()
            if number := _NUMBER.match(rest, m.start()):
                kind, end = number.lastgroup, number.end()
                if kind == "card":
                    end = self.card_end(rest, m.start())
                if end and (new := getattr(self, kind)(rest[m.start() : end])):
                    found.append((m.start(), end, kind, new))
                    pos = end
        kept: list[tuple[int, int, str, str]] = []
        for x in sorted(found, key=lambda x: (x[0], -x[1])):
            if not kept or x[0] >= kept[-1][1]:
                kept.append(x)
        return kept

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        spans = self.spans(text)
        out, at = [], 0
        for start, end, _, new in spans:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), spans


_MAY_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]")


@lru_cache(maxsize=4)
def pseudonymizer(key: bytes) -> Pseudonymizer:
    return Pseudonymizer(key)


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the new text, the number of values replaced, and their spans in the old text as kind:start:end."""

    def per_slice(ids: list, texts: list[bytes | None]) -> dict[str, list]:
        made = [(None, []) if t is None else pseudonymizer(key).replace(t.decode()) for t in texts]
        return {
            "doc_id": ids,
            "text": [t for t, _ in made],
            "n_values": [len(s) for _, s in made],
            "spans": [",".join(f"{k}:{a}:{b}" for a, b, k, _ in s) for _, s in made],
        }

    return map_texts(docs, id_col, text_col, "doc_id long, text string, n_values long, spans string", per_slice)


def replace_in(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with pseudonyms in the text; all other columns stay, except length_col, which gets the new length."""
    @F.pandas_udf("string")
    def new_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pseudonymizer(key).replace(t)[0])

    out = docs.withColumn(text_col, new_text(F.col(text_col)))
    return out.withColumn(length_col, F.char_length(text_col).cast("long")) if length_col else out
