"""Format-preserving pseudonyms for validated numbers and dates by keyed Feistel networks.

A value that passes its format's check is read as a number within its format's domain,
permuted there by an alternating Feistel network under a key, and written back in its own
layout: equal values get equal pseudonyms in all documents, different values different
ones, and every pseudonym passes the same check. Formats: payment cards (Luhn), IBAN
(mod 97), IPv4 and IPv6 addresses (the latter written in their shortest form), telephone
numbers, social security numbers, calendar dates, e-mail addresses (the part before the
@), access keys and hexadecimal secrets.

A date's layout is its order, its separator and the digits of day and month, or the form
of the month's name. The domain is the set of dates that the layout can write, so that
length and validity stay; layouts that can write all dates share one permutation, so that
a date stays linked between them. A date that is valid as day-month is read as that, one
that is valid as month-day alone is permuted among its like.

The key is the caller's secret: there is no default in ``pseudonymised``. Where formats
overlap, the earlier in FORMATS takes the place. Null text stays null, and counts as
without values; so does a null doc_id, which passes through. Empty texts stay empty, texts
of any length are read whole. Repeated rows give repeated results. An empty table gives no
rows. Other columns are ignored, also those of the same names as results.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import functools
import hashlib
import ipaddress
import re
import warnings
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())
SETS = {"digit": "0123456789", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def permuted(x: int, size: int, key: bytes, rounds: int = 8, inverse: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1. The halves are numbers below a and b with a * b >= size; what falls outside walks on."""
    if size < 2:
        return x
    a = 1 << ((size - 1).bit_length() + 1) // 2
    b = -(-size // a)

    def f(half: int, r: int, n: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d,%d" % (r, half), key=key, digest_size=16).digest()) % n

    while True:
        left, right = divmod(x, b)
        for r in reversed(range(rounds)) if inverse else range(rounds):
            sign = -1 if inverse else 1
            if r % 2:
                right = (right + sign * f(left, r, b)) % b
            else:
                left = (left + sign * f(right, r, a)) % a
        x = left * b + right
        if x < size:
            return x


def _key(key: bytes, kind: str) -> bytes:
    return hashlib.blake2b(kind.encode(), key=key, digest_size=32).digest()


def _spelt(text: str, key: bytes, kind: str, fixed: Callable[[int], bool] = lambda i: False, sets: dict[str, str] = SETS) -> str:
    """Permutes the characters that are in a set, each within its set, as one number."""
    at = [(i, s) for i, c in enumerate(text) for s in sets.values() if c in s and not fixed(i)]
    x, size = 0, 1
    for i, s in at:
        x, size = x * len(s) + s.index(text[i]), size * len(s)
    x, out = permuted(x, size, _key(key, kind + "".join(str(len(s)) + "." for _, s in at))), list(text)
    for i, s in reversed(at):
        x, k = divmod(x, len(s))
        out[i] = s[k]
    return "".join(out)


def _into(layout: str, digits: str) -> str:
    """Digits into the places that a layout has for them."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), layout)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    return -sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def card(m: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", m)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = d[0] + _spelt(d[1:-1], key, "card" + d[0])
    return _into(m, body + str(luhn(body)))


def iban(m: str, key: bytes) -> str | None:
    s = m.replace(" ", "")
    value = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(s) <= 34 or value(s[4:] + s[:4]) % 97 != 1:
        return None
    body = _spelt(s[4:], key, "iban" + s[:2])
    check = 98 - value(body + s[:2] + "00") % 97
    it = iter(f"{s[:2]}{check:02d}{body}")
    return re.sub(r"\S", lambda _: next(it), m)


def ip(m: str, key: bytes) -> str | None:
    parts = [int(p) for p in m.split(".")]
    if max(parts) > 255:
        return None
    x = permuted(int.from_bytes(bytes(parts)), 1 << 32, _key(key, "ip"))
    return ".".join(map(str, x.to_bytes(4)))


def phone(m: str, key: bytes) -> str | None:
    digits = sum(c.isdigit() for c in m)
    if not 8 <= digits <= 15:
        return None
    code = re.match(r"\+\d{1,3}(?=[ (.-])", m)
    return _spelt(m, key, "phone", lambda i: i < (code.end() if code else 0))


def ssn(m: str, key: bytes) -> str | None:
    area, group, serial = map(int, m.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    x = permuted((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, _key(key, "ssn"))
    x, serial = divmod(x, 9999)
    return f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{serial + 1:04d}"


@functools.cache
def _writable(day_digits: int, month_digits: int, past_twelve: bool) -> list[int]:
    """Ordinals of the dates that a layout can write, ascending; ``past_twelve``: those of days after the twelfth."""
    days = map(datetime.date.fromordinal, range(*DAYS))
    return [d.toordinal() for d in days if d.day < 10**day_digits and d.month < 10**month_digits and (d.day > 12 or not past_twelve)]


def _other_date(day: datetime.date, digits: tuple[int, int], past_twelve: bool, key: bytes) -> datetime.date | None:
    domain = _writable(*digits, past_twelve)
    at = bisect.bisect_left(domain, day.toordinal())
    if at == len(domain) or domain[at] != day.toordinal():
        return None
    kind = f"date{digits}{past_twelve}"
    return datetime.date.fromordinal(domain[permuted(at, len(domain), _key(key, kind))])


def _calendar(year: str, month: int, day: str) -> datetime.date | None:
    try:
        return datetime.date(int(year), month, int(day))
    except ValueError:
        return None


def date(m: str, key: bytes) -> str | None:
    a, sep, b, same, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", m).groups()
    if sep != same:
        return None
    year_first, past_twelve = len(a) == 4, False
    year, month, day = (a, b, c) if year_first else (c, b, a)
    found = _calendar(year, int(month), day)
    if found is None and not year_first:
        month, day, past_twelve = a, b, True
        found = _calendar(year, int(month), day)
    new = found and _other_date(found, (len(day), len(month)), past_twelve, key)
    if not new:
        return None
    y, mo, d = f"{new.year:04d}", f"{new.month:0{len(month)}d}", f"{new.day:0{len(day)}d}"
    return sep.join((y, mo, d) if year_first else (mo, d, y) if past_twelve else (d, mo, y))


MONTHS = {name.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, name in enumerate(names) if i}


def named_date(m: str, key: bytes) -> str | None:
    """12 March 2020, March 12, 2020 and the like, with the month's name in full or as three letters."""
    (day,), (name,), (year,) = re.findall(r"(?<!\d)\d{1,2}(?!\d)", m), re.findall("[A-Za-z]{3,}", m), re.findall(r"\d{4}", m)
    found = _calendar(year, MONTHS[name.lower()], day)
    new = found and _other_date(found, (2, 2), False, key)
    if not new:
        return None
    full = (calendar.month_name if len(name) > 3 or name.lower() == "may" else calendar.month_abbr)[new.month]
    full = full.upper() if name.isupper() else full.lower() if name.islower() else full
    spelt = f"{new.day:02d}" if day.startswith("0") else str(new.day)
    return re.sub(r"\d{4}|\d{1,2}|[A-Za-z]{3,}", lambda x: full if x[0].isalpha() else f"{new.year:04d}" if len(x[0]) == 4 else spelt, m)


def ipv6(m: str, key: bytes) -> str | None:
    try:
        x = int(ipaddress.IPv6Address(m))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(permuted(x, 1 << 128, _key(key, "ipv6"))))


def email(m: str, key: bytes) -> str | None:
    name, _, domain = m.partition("@")
    return f"{_spelt(name, key, 'email' + domain.lower())}@{domain}"


def access_key(m: str, key: bytes) -> str | None:
    return m[:4] + _spelt(m[4:], key, "access", sets={"b": SETS["upper"] + SETS["digit"]})


def secret(m: str, key: bytes) -> str | None:
    return _spelt(m, key, "hex", sets={"h": "0123456789abcdef"})


#: Tried in this order at each place; a value that its check refuses is left to the next.
FORMATS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", email),
    ("access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", access_key),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", iban),
    ("ipv6", r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]:[0-9A-Fa-f:]*[0-9A-Fa-f])(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:]|\.\d)", ipv6),
    ("ip", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)", ip),
    ("date", r"(?<![\w.])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?!\w|[.]\d)", date),
    ("date", rf"(?i)(?<!\w)(?:\d{{1,2}} (?:{'|'.join(MONTHS)})\.? \d{{4}}|(?:{'|'.join(MONTHS)})\.? \d{{1,2}}, ?\d{{4}})(?!\w)", named_date),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    ("card", r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)", card),
    ("phone", r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d){4,12}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])|(?<![\w.])\d{3}\.\d{3}\.\d{4}(?![\w.])", phone),
    ("secret", r"(?<![0-9A-Za-z])(?=[a-f]*\d)[0-9a-f]{32,}(?![0-9A-Za-z])|(?<=password=)[0-9a-f]{12,}", secret),
)


def pseudonyms(key: bytes) -> Callable[[str], tuple[str, Counter]]:
    """A function from texts to texts with pseudonyms and the number of each format's values."""
    find = [(kind, re.compile(pattern), of) for kind, pattern, of in FORMATS]
    known = functools.lru_cache(50_000)(lambda n, m: find[n][2](m, key))

    def replaced(text: str) -> tuple[str, Counter]:
        counts: Counter = Counter()
        if not re.search(r"\d|@", text):
            return text, counts
        spans: list[tuple[int, int, str]] = []
        for n, (kind, pattern, _) in enumerate(find):
            if kind == "email" and "@" not in text or kind == "access_key" and "IA" not in text:
                continue
            for m in pattern.finditer(text):
                if all(m.end() <= a or m.start() >= b for a, b, _ in spans) and (new := known(n, m[0])) is not None:
                    spans.append((m.start(), m.end(), new))
                    counts[kind] += 1
        at, out = 0, []
        for a, b, new in sorted(spans):
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), counts

    return replaced


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_values, kinds (such as 'card:1,ip:2') for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pseudonyms(key)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = [(None, Counter()) if t is None else of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([c.total() for _, c in out], pa.int64()), pa.array([",".join(f"{k}:{c[k]}" for k in sorted(c)) for _, c in out])], ["doc_id", "text", "n_values", "kinds"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, n_values long, kinds string")


def secret_key(spark: SparkSession) -> bytes:
    """From the setting spark.folio.pii.key. Without one, a key that everyone knows serves the given synthetic tables only."""
    key = spark.conf.get("spark.folio.pii.key", None)
    if key is None:
        warnings.warn("spark.folio.pii.key is not set: these pseudonyms can be inverted by anyone", stacklevel=2)
        key = "synthetic tables only"
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), secret_key(spark))
