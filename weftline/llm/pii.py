"""Format-preserving pseudonyms: private values are permuted within their format by a key."""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
LAST_DAY = datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of the numbers 0 to size - 1.

    Ten rounds of a balanced Feistel network over the least even number of bits that holds the
    size; a result outside the range is permuted again (cycle walking), which keeps it a
    permutation. ``tweak`` separates kinds of values.
    """

    def __init__(self, key: bytes, size: int, tweak: str):
        self.size, self.half = size, max(1, -(-(size - 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.width = -(-self.half // 8)
        self.keys = [
            hashlib.blake2b(f"{tweak}|{size}|{i}".encode(), key=hashlib.sha256(key).digest()).digest()[:32]
            for i in range(ROUNDS)
        ]

    def _round(self, i: int, value: int) -> int:
        body = value.to_bytes(self.width, "big")
        digest = hashlib.blake2b(body, key=self.keys[i], digest_size=max(self.width, 8)).digest()
        return int.from_bytes(digest, "big") & self.mask

    def __call__(self, value: int, fits: Callable[[int], bool] = lambda _: True) -> int:
        """The pseudonym of ``value``; both lie in the set of numbers that ``fits`` accepts."""
        while True:
            left, right = value >> self.half, value & self.mask
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(i, right)
            value = left << self.half | right
            if value < self.size and fits(value):
                return value

    def back(self, value: int, fits: Callable[[int], bool] = lambda _: True) -> int:
        """The value of a pseudonym, for the holder of the key."""
        while True:
            left, right = value >> self.half, value & self.mask
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(i, left), left
            value = left << self.half | right
            if value < self.size and fits(value):
                return value


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


# Published numbering rules, fixed values.
CARD_LENGTHS = (13, 14, 15, 16, 19)


def _phone_ok(n: int) -> bool:
    """North American numbers: area and exchange start with 2 to 9."""
    s = f"{n:010d}"
    return s[0] >= "2" and s[3] >= "2" and s[4:6] != "11"


def _ssn_ok(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![\w-]))
  | (?P<secret>(?i:\b(?:password|passwd|token|secret|api_?key)\b)["']?\s{0,3}[=:]\s{0,3}["']?(?P<hex>[0-9a-f]{16,128})(?![\w]))
  | (?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
  | (?P<phone>(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w/-]|\.\d))
  | (?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w-]|\.\d))
  | (?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?!\w|-(?!\d)))
    """,
    re.VERBOSE | re.ASCII,
)
CARD = re.compile(r"\d(?:[ -]?\d){12,18}(?!\w|-(?!\d))", re.ASCII)
HINT = re.compile(r"[0-9]|@|(?i:password|passwd|token|secret|api_?key)", re.ASCII)


class Pseudonyms:
    """Pseudonyms of validated values under one key; None for what isn't valid.

    Equal values get equal pseudonyms whatever their layout: separators stay where they are
    and don't count. A pseudonym is valid for its kind: cards and account numbers carry right
    check digits, dates exist, addresses and numbers keep their ranges.
    """

    def __init__(self, key: bytes):
        self.key, self.ciphers = key, {}

    def cipher(self, kind: str, size: int) -> Feistel:
        if (kind, size) not in self.ciphers:
            self.ciphers[kind, size] = Feistel(self.key, size, kind)
        return self.ciphers[kind, size]

    def __call__(self, kind: str, value: str) -> str | None:
        return getattr(self, kind)(value)

    def card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if len(digits) not in CARD_LENGTHS or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        n = len(digits) - 1
        payload = f"{self.cipher('card', 10**n)(int(digits[:-1])):0{n}d}"
        return fill(value, payload + luhn_digit(payload))

    def phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        national = digits[-10:]
        if not _phone_ok(int(national)):
            return None
        return fill(value, digits[:-10] + f"{self.cipher('phone', 10**10)(int(national), _phone_ok):010d}")

    def ssn(self, value: str) -> str | None:
        n = int(value.replace("-", ""))
        return fill(value, f"{self.cipher('ssn', 10**9)(n, _ssn_ok):09d}") if _ssn_ok(n) else None

    def ip(self, value: str) -> str | None:
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255 or any(x != str(int(x)) for x in value.split(".")):
            return None
        n = self.cipher("ip", 1 << 32)(int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, n.to_bytes(4, "big")))

    def date(self, value: str) -> str | None:
        a, b, c = (int(x) for x in re.split(r"\D", value))
        year, month, day = (a, b, c) if len(re.split(r"\D", value)[0]) == 4 else (c, b, a)
        american = False
        if month > 12 and "/" in value and len(re.split(r"\D", value)[0]) == 2:
            month, day, american = day, month, True
        if not (1900 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
            return None
        n = datetime.date(year, month, day).toordinal() - FIRST_DAY
        # a date whose layout shows that the month comes first keeps that: its day stays above 12
        shown = (lambda x: datetime.date.fromordinal(FIRST_DAY + x).day > 12) if american else (lambda _: True)
        new = datetime.date.fromordinal(FIRST_DAY + self.cipher("date", LAST_DAY - FIRST_DAY + 1)(n, shown))
        if len(re.split(r"\D", value)[0]) == 4:
            return fill(value, f"{new.year:04d}{new.month:02d}{new.day:02d}")
        first, second = (new.month, new.day) if american else (new.day, new.month)
        return fill(value, f"{first:02d}{second:02d}{new.year:04d}")

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        country, body = plain[:2], plain[4:]
        if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in body + plain[:4])) % 97 != 1:
            return None
        body = self.classes("iban" + country, body)
        return fill(value, country + iban_check(country, body) + body)

    def email(self, value: str) -> str | None:
        local, _, domain = value.rpartition("@")
        name, _, top = domain.rpartition(".")
        # addresses differ by case only for people: one pseudonym, in small letters
        return f"{self.classes('local', local.lower())}@{self.classes('domain', name.lower())}.{top.lower()}"

    def secret(self, value: str) -> str | None:
        n = len(value)
        return f"{self.cipher('secret', 16**n)(int(value, 16)):0{n}x}"

    def classes(self, kind: str, value: str) -> str:
        """Letters become letters and digits digits; all other signs stay."""
        radix = [26 if c.isalpha() and c.isascii() else 10 if c.isdigit() and c.isascii() else 0 for c in value]
        number = size = 0
        size = 1
        for c, r in zip(value, radix):
            if r:
                number = number * r + (ord(c.lower()) - 97 if r == 26 else int(c))
                size *= r
        if size == 1:
            return value
        number = self.cipher(f"{kind}|{''.join(map(chr, (48 + r for r in radix)))}", size)(number)
        out = []
        for c, r in zip(reversed(value), reversed(radix)):
            if r:
                number, d = divmod(number, r)
                c = chr((65 if c.isupper() else 97) + d) if r == 26 else str(d)
            out.append(c)
        return "".join(reversed(out))


def fill(layout: str, signs: str) -> str:
    """``signs`` in the places of the letters and digits of ``layout``."""
    rest = iter(signs)
    return "".join(next(rest) if c.isalnum() else c for c in layout)


def groups_of(kind: str, value: str) -> list[tuple[int, int]]:
    """Spans of the groups of signs of a card or account number."""
    return [m.span() for m in re.finditer(r"[^ -]+" if kind == "card" else r"[^ ]+", value)]


def shorter(kind: str, text: str, start: int, end: int, names: Pseudonyms) -> tuple[int, str] | None:
    """End and pseudonym of the longest valid value that begins at ``start`` and ends with a group
    before ``end``.

    A card yields to a longer valid card that begins in one of its later groups.
    """
    groups = groups_of(kind, text[start:end])
    for _, size in reversed(groups[:-1]):
        new = names(kind, text[start : start + size])
        if new is not None:
            break
    else:
        return None
    if kind == "card":
        digits = sum(c.isdigit() for c in new)
        for later, _ in groups[1:]:
            rest = CARD.match(text, start + later) if later < size else None
            ends = groups_of(kind, rest[0]) if rest else []
            if any(sum(c.isdigit() for c in rest[0][:e]) > digits and names(kind, rest[0][:e]) for _, e in ends):
                return None
    return start + size, new


def replace_values(text: str, names: Pseudonyms) -> tuple[str, list[str]]:
    """The text with pseudonyms for all valid private values, and the kinds found, in order."""
    if not HINT.search(text):
        return text, []
    out, kinds, at, done = [], [], 0, 0
    while found := PATTERN.search(text, at):
        kind = next(k for k in ("email", "secret", "iban", "phone", "ssn", "date", "ip", "card") if found[k] is not None)
        start, end = found.span("hex" if kind == "secret" else kind)
        new = names(kind, text[start:end])
        if new is None and kind in ("card", "iban") and (less := shorter(kind, text, start, end, names)):
            end, new = less
        if new is None:
            at = found.start() + 1
            while at < found.end() and text[at].isalnum():
                at += 1
            continue
        out += [text[done:start], new]
        kinds.append(kind)
        at = done = end
    return "".join([*out, text[done:]]), kinds


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with private values of the text replaced, and ``kinds``.

    Cards (Luhn), account numbers (mod 97), North American phone numbers, social security
    numbers, IPv4 addresses, existing dates of 1900 to 2099, e-mail addresses and hexadecimal
    secrets behind their name. What does not validate stays; a card or account number that only
    digits or words behind a separator make invalid is found without them. One pass without a shuffle: the
    same key gives the same pseudonym in every task, so equal values stay linked across
    documents. ``kinds`` lists the kind of each replaced value in text order.

    NULL texts stay NULL with no kinds; a column named ``kinds`` is replaced; rows with
    repeated ids are treated alike; an empty table gives no rows.
    """
    keep = [c for c in (keep or docs.columns) if c not in (text_col, "kinds")]
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text_col))
    schema = rows.withColumn("kinds", F.array().cast("array<string>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            texts, kinds = [], []
            for text in batch.column(len(keep)).to_pylist():
                new, found = (None, []) if text is None else replace_values(text, names)
                texts.append(new)
                kinds.append(found)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], [*keep, text_col, "kinds"]
            )

    return rows.mapInArrow(run, schema)
