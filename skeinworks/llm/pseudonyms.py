"""Format-preserving pseudonyms: personal values are permuted under a key within their format.

A value that passes its kind's validation is read as a number over the alphabets of its places and
sent through a keyed Feistel network over exactly that many values. So a card number becomes
another with a right check digit, a date another date, in the same punctuation; equal values
become equal pseudonyms in all documents, and the key's holder can undo them.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

_MONTH = "|".join(m if len(m) < 4 else f"{m}|{m[:3]}" for m in MONTHS)
_VALUE = re.compile(
    rf"""
    (?P<email>(?<![\w.%+-])[\w.%+-]+@(?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z]))
    |(?P<secret>(?<=["'])(?<!\w)[A-Za-z0-9_-]{{16,}}(?=["']))
    |(?P<iban>(?<!\w)[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?!\w))
    |(?P<iso>(?<![\w.-])[0-9]{{4}}([-/.])[0-9]{{2}}\5[0-9]{{2}}(?![\w-]|\.[0-9]))
    |(?P<day>(?<![\w.-])[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\7[0-9]{{4}}(?![\w-]|\.[0-9]))
    |(?P<written>(?<!\w)(?:[0-9]{{1,2}}\.?[ ](?:{_MONTH})|(?:{_MONTH})\.?[ ][0-9]{{1,2}},?)[ ][0-9]{{4}}(?!\w))
    |(?P<ip>(?<![\w.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?!\w|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\w-]))
    |(?P<phone>(?<!\w)\+1[ .-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}(?!\w)
        |(?<!\w)\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,5}}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){{5,13}}(?!\w)
        |(?<![\w+])(?:\([0-9]{{3}}\)[ ]?|[0-9]{{3}}[-.])[0-9]{{3}}[-.][0-9]{{4}}(?!\w))
    |(?P<card>(?<![\w.-])(?:[0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}\13[0-9]{{4}}\13[0-9]{{1,7}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})(?![\w-]|\.[0-9]))
    """,
    re.VERBOSE,
)
#: Before a quoted secret: the name it is given to, of any length, and what stands between.
_GIVEN = re.compile(r"[\"']?\s{0,4}[:=]\s{0,4}[\"']\Z")
_NAME = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\w*\Z")
_HINT = re.compile(r"[0-9@]|(?i:secret|token|key|passw)")


class Feistel:
    """A keyed permutation of the whole numbers below any bound."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _mix(self, tweak: str, bound: int, k: int, half: int, width: int) -> int:
        message = b"\0".join([self.key, tweak.encode(), str(bound).encode(), str(k).encode(), str(half).encode()])
        return int.from_bytes(hashlib.shake_256(len(self.key).to_bytes(4) + message).digest(width), "big")

    def _walk(self, x: int, bound: int, tweak: str, order: range, sign: int) -> int:
        if bound < 2:
            return x
        a = math.isqrt(bound - 1) + 1
        b = -(-bound // a)
        width = a.bit_length() // 8 + 17
        while True:  # the halves hold a few more numbers: go on until one is below the bound
            left, right = x // b, x % b
            for k in order:
                if k % 2:
                    left = (left + sign * self._mix(tweak, bound, k, right, width)) % a
                else:
                    right = (right + sign * self._mix(tweak, bound, k, left, width)) % b
            x = left * b + right
            if x < bound:
                return x

    def forward(self, x: int, bound: int, tweak: str = "") -> int:
        return self._walk(x, bound, tweak, range(self.rounds), 1)

    def back(self, x: int, bound: int, tweak: str = "") -> int:
        return self._walk(x, bound, tweak, range(self.rounds - 1, -1, -1), -1)


#: Moves a number below a bound, under a tweak.
Move = Callable[[int, int, str], int]


def permute_string(text: str, tweak: str, move: Move, hexadecimal: bool = False) -> str:
    """Each ASCII letter and digit within its alphabet; all of them together are one number."""
    digits = [HEX_LOWER, HEX_UPPER][text.upper() == text] if hexadecimal else DIGITS
    alphabet = lambda c: digits if c in digits else LOWER if c in LOWER else UPPER if c in UPPER else None
    places = [(k, a) for k, c in enumerate(text) if (a := alphabet(c))]
    x, bound = 0, 1
    for k, a in places:
        x, bound = x * len(a) + a.index(text[k]), bound * len(a)
    shape = "".join(str(len(a)) + "." for _, a in places)
    x, out = move(x, bound, f"{tweak}:{shape}"), list(text)
    for k, a in reversed(places):
        x, digit = divmod(x, len(a))
        out[k] = a[digit]
    return "".join(out)


def refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in text)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def luhn_digit(digits: str) -> str:
    """The check digit that goes after ``digits``."""
    total = sum(d if k % 2 else d // 5 + d * 2 % 10 for k, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def email(value: str, move: Move) -> str:
    local, domain = value.rsplit("@", 1)
    return f"{permute_string(local, 'email:' + domain.lower(), move)}@{domain}"


def card(value: str, move: Move) -> str | None:
    digits = only_digits(value)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    new = digits[0] + permute_string(digits[1:-1], f"card:{digits[0]}:{len(digits)}", move)
    return refill(value, new + luhn_digit(new))


def phone(value: str, move: Move) -> str | None:
    country = re.match(r"\+[0-9]{1,3}", value)
    head = country[0] if country and value[country.end()] not in DIGITS else "+" if country else ""
    digits = only_digits(value[len(head) :])
    if not 7 <= len(only_digits(value)) <= 15:
        return None
    return head + refill(value[len(head) :], permute_string(digits, "phone:" + head, move))


def ip(value: str, move: Move) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    x = move(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def ssn(value: str, move: Move) -> str | None:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (int(x) for x in value.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    x = move(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    area += 1 + (area >= 665)
    return f"{area:03}-{group + 1:02}-{serial + 1:04}"


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(value: str, move: Move) -> str | None:
    flat = value.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_rest(flat[4:] + flat[:4]) != 1:
        return None
    body = permute_string(flat[4:], "iban:" + flat[:2], move)
    new = iter(f"{flat[:2]}{98 - _iban_rest(body + flat[:2] + '00'):02}{body}")
    return "".join(c if c == " " else next(new) for c in value)


def day_class(date: datetime.date) -> tuple[bool, ...]:
    """What a date keeps, so that each way to write it stays as wide and reads back in the same order."""
    return date.day > 12, date.day > 9, date.month > 9, date.month == 5


def moved_day(year: int, month: int, day: int, move: Move) -> datetime.date | None:
    """Another date of the same class, the same one however the date is written: the walk goes on until it has one."""
    try:
        date = datetime.date(year, month, day)
    except ValueError:
        return None
    if not FIRST_DAY <= date <= LAST_DAY:
        return None
    days, new = (LAST_DAY - FIRST_DAY).days + 1, (date - FIRST_DAY).days
    while True:
        new = move(new, days, "date")
        found = FIRST_DAY + datetime.timedelta(new)
        if day_class(found) == day_class(date):
            return found


def iso(value: str, move: Move) -> str | None:
    new = moved_day(int(value[:4]), int(value[5:7]), int(value[8:]), move)
    return new and f"{new.year}{value[4]}{new.month:02}{value[7]}{new.day:02}"


def day(value: str, move: Move) -> str | None:
    """Month first between slashes, day first between dots and hyphens; the other way if only that is a date."""
    mark = next(c for c in value if c not in DIGITS)
    a, b, year = value.split(mark)
    first = mark == "/"
    if int(a) > 12 and first or int(b) > 12 and not first:
        first = not first
    new = moved_day(int(year), int(a if first else b), int(b if first else a), move)
    if not new:
        return None
    x, y = (new.month, new.day) if first else (new.day, new.month)
    return f"{x:0{len(a)}}{mark}{y:0{len(b)}}{mark}{new.year}"


def written(value: str, move: Move) -> str | None:
    name = re.search(r"[A-Z][a-z]+", value)[0]
    number, year = re.findall(r"[0-9]+", value)
    month = next(k for k, m in enumerate(MONTHS, 1) if m.startswith(name))
    new = moved_day(int(year), month, int(number), move)
    if not new:
        return None
    label = MONTHS[new.month - 1] if len(name) > 3 else MONTHS[new.month - 1][:3]
    out = re.sub(r"[0-9]{4}\Z", str(new.year), value.replace(name, "\0"))
    return re.sub(r"[0-9]{1,2}(?=[^0-9])", f"{new.day:0{len(number)}}", out, count=1).replace("\0", label)


def secret(value: str, move: Move) -> str:
    return permute_string(value, "secret", move, hexadecimal=bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)))


KINDS: dict[str, Callable[[str, Move], str | None]] = {
    f.__name__: f for f in (email, secret, iban, iso, day, written, ip, ssn, phone, card)
}


def is_named(text: str, at: int) -> bool:
    """Whether what is quoted at ``at`` is given to a name that says it is secret."""
    given = _GIVEN.search(text, max(0, at - 12), at)
    if not given:
        return False
    start = end = given.start()
    while start and (text[start - 1].isalnum() or text[start - 1] in "_-"):
        start -= 1
    return _NAME.search(text, start, end) is not None


def pseudonymise(text: str | None, move: Move) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with its personal values moved, and kind, start and end of each in the text given."""
    if not text or not _HINT.search(text):
        return text, []
    out, found, done = [], [], 0
    for m in _VALUE.finditer(text):
        kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k] is not None)
        if kind == "secret" and not is_named(text, m.start()):
            continue
        new = KINDS[kind](m[0], move)
        if new is not None:
            out += [text[done : m.start()], new]
            done = m.end()
            found.append((kind, m.start(), m.end()))
    return "".join([*out, text[done:]]), found


def pseudonyms(docs: DataFrame, key: bytes, *, undo: bool = False, values: str = "values") -> DataFrame:
    """``docs`` with personal values in ``text`` replaced, and ``values``: kind, start and end of each.

    Kinds: e-mail addresses (the local part moves), quoted secrets given to a name, IBANs and card
    numbers with right check digits, social security numbers, dates from 1900 to 2099, IPv4
    addresses and telephone numbers. What fails its validation stays. ``undo`` reverses it.

    Digits are 0 to 9 alone; other scripts' digits are no part of a value. Null and empty texts stay as
    they are, without values. Very long texts: whole, one at a time. Where two kinds fit one place, the first
    in the order above counts. Repeated rows: each is treated alike. No rows: no rows. All other
    columns of ``docs`` are returned; one called ``values`` is replaced unless another name is given.
    """
    rest = [c for c in docs.columns if c not in ("text", values)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network = Feistel(key)
        move = network.back if undo else network.forward
        for batch in batches:
            done = [pseudonymise(t, move) for t in batch["text"]]
            batch["text"] = [t for t, _ in done]
            batch["found"] = [[{"kind": k, "start": a, "end": b} for k, a, b in v] for _, v in done]
            yield batch

    # Under plain names: mapInPandas cannot read a name with a dot.
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)], "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return chosen.mapInPandas(run, f"{fields}, found array<struct<kind:string,start:long,end:long>>").toDF(*rest, "text", values)


#: For the registered query and the tests; a real corpus has a key of its own, kept apart from it.
DEMO_KEY = b"demonstration key"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonyms(docs.select("doc_id", "text"), DEMO_KEY)
