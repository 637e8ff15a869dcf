"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers and dates in a text are found by pattern and *validated* (card numbers by their
check digit, IBANs by their remainder, phone numbers and social security numbers by their
numbering rules, addresses by their ranges, dates by the calendar).  The value behind a
match is an integer of a known domain: a Feistel network with a keyed round function
permutes it, walking its cycle until it falls into the domain again, and the result is
written in the format of the match, separators and check digits included.  Equal values
get equal pseudonyms in every document, whatever their separators, and different values
of one format stay different.  The local part of a mail address is permuted the same way
over its letters and digits.

A telephone number behind ``+`` belongs to its country: the country code stays and numbers
of different countries never share a pseudonym.  A number without ``+`` is taken as a
national one of country 1 and linked to the same number behind ``+1``.

The mapping needs no state: each text is rewritten where it lies, without shuffles, and the
holder of the key can undo it (``Undo``).  Dates are permuted among those whose day and month
have as many digits, and whose day is above 12 or not, so a date has one pseudonym in all its
written forms and every form stays what it was ("May" counts as a short name).

Edge cases: a null text stays null; overlapping matches go to the first pattern in order; of
groups the longest whole groups that pass as a card number or IBAN count; candidates that
fail validation are left alone; a value may be its own pseudonym by chance, as in any
permutation; repeated rows are treated alike; a column ``n_pii`` or ``kinds`` of the input is
replaced, further columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches, table

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of range(n) for any n, one for each name."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, name: bytes, i: int, half: int, bits: int) -> int:
        h = hashlib.blake2b(half.to_bytes((bits + 7) // 8 or 1, "big"), key=self.key, person=i.to_bytes(2, "big") + hashlib.blake2b(name, digest_size=14).digest(), digest_size=min(64, (bits + 7) // 8 + 1))
        return int.from_bytes(h.digest(), "big") & ((1 << bits) - 1)

    def _once(self, name: bytes, x: int, bits: int) -> int:
        mask = (1 << bits) - 1
        left, right = x >> bits, x & mask
        for i in range(ROUNDS):
            left, right = right, left ^ self._round(name, i, right, bits)
        return left << bits | right

    def _back(self, name: bytes, y: int, bits: int) -> int:
        mask = (1 << bits) - 1
        left, right = y >> bits, y & mask
        for i in reversed(range(ROUNDS)):
            left, right = right ^ self._round(name, i, left, bits), left
        return left << bits | right

    def permute(self, name: str, x: int, n: int) -> int:
        """Where x of range(n) goes; one to one."""
        bits, tag = max(1, ((n - 1).bit_length() + 1) // 2), f"{name}/{n}".encode()
        y = self._once(tag, x, bits)
        while y >= n:
            y = self._once(tag, y, bits)
        return y

    def inverse(self, name: str, y: int, n: int) -> int:
        """The value that ``permute`` sends to y."""
        bits, tag = max(1, ((n - 1).bit_length() + 1) // 2), f"{name}/{n}".encode()
        x = self._back(tag, y, bits)
        while x >= n:
            x = self._back(tag, x, bits)
        return x


class Undo(Feistel):
    """Takes pseudonyms back: ``pseudonymize`` with it restores a text that ``Feistel`` with the same key has changed."""

    def permute(self, name: str, x: int, n: int) -> int:
        return self.inverse(name, x, n)


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(m: str) -> str:
    return "".join(c for c in m if c.isdigit())


def _card(f: Feistel, m: str) -> str | None:
    d = _digits(m)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or luhn_digit(d[:-1]) != int(d[-1]):
        return None
    inner = len(d) - 2  # the leading digit (the network) stays
    p = d[0] + str(f.permute("card" + d[0], int(d[1:-1]), 10**inner)).zfill(inner)
    return _refill(m, p + str(luhn_digit(p)))


def _iban(f: Feistel, m: str) -> str | None:
    s = m.replace(" ", "")
    if not 15 <= len(s) <= 34 or int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 != 1:
        return None
    country, body = s[:2], s[4:]
    kinds = [(10, "0") if c.isdigit() else (26, "A") for c in body]
    body = _mixed(f, "iban" + country, body, kinds)
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    it = iter(f"{country}{check:02d}{body}")
    return "".join(next(it) if c != " " else c for c in m)


def _mixed(f: Feistel, name: str, s: str, kinds: list[tuple[int, str]]) -> str:
    """Permute a string over its own pattern of alphabets (size, first character)."""
    x, n = 0, 1
    for c, (size, first) in zip(s, kinds):
        x, n = x * size + ord(c) - ord(first), n * size
    x = f.permute(name + "".join(first for _, first in kinds), x, n)
    out = []
    for size, first in reversed(kinds):
        x, r = divmod(x, size)
        out.append(chr(ord(first) + r))
    return "".join(reversed(out))


#: Country codes of two digits (fixed values of the public numbering plan); 1 and 7 are codes by themselves, all others have three.
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(f: Feistel, m: str) -> str | None:
    d = _digits(m)
    if m.startswith("+") and d[0] != "1" or m.startswith("+") and d[1] in "01":
        # Behind a country code any digits count; country 1 has no area codes in 0 and 1, which stay apart.  (0) is dialled at home only.
        m = m.replace("(0)", "(o)", 1)
        d = _digits(m)
        k = 2 if d[0] == "1" or d[:2] in TWO_DIGITS else 1 if d[0] == "7" else 3
        return _refill(m, d[:k] + str(f.permute("phone" + d[:k], int(d[k:]), 10 ** (len(d) - k))).zfill(len(d) - k)).replace("(o)", "(0)", 1)
    country, d = d[:-10], d[-10:]
    if d[0] in "01":
        return None
    # Area codes start with 2 to 9; the exchange code stays as it is where it marks fictional numbers.
    x = f.permute("phone", (int(d[0]) - 2) * 10**9 + int(d[1:]), 8 * 10**9)
    return _refill(m, country + str(x // 10**9 + 2) + str(x % 10**9).zfill(9))


def _ssn(f: Feistel, m: str) -> str | None:
    a, g, s = (int(x) for x in re.split(r"[- ]", m))
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    area = a - 1 - (a > 666)
    x = f.permute("ssn", (area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999)
    x, s = divmod(x, 9999)
    area, g = divmod(x, 99)
    return _refill(m, f"{area + 1 + (area + 1 >= 666):03d}{g + 1:02d}{s + 1:04d}")


def _ipv4(f: Feistel, m: str) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts) or int(parts[0]) in (0, 127, 255):
        return None
    # Every address of one written length per part stays in that form.
    x, n, spans = 0, 1, []
    for i, p in enumerate(parts):
        low, high = {1: (0 if i else 1, 9), 2: (10, 99), 3: (100, 255 if i else 254)}[len(p)]
        spans.append((low, high - low + 1))
        x, n = x * (high - low + 1) + int(p) - low, n * (high - low + 1)
    x, out = f.permute("ip" + ".".join(str(len(p)) for p in parts), x, n), []
    for low, size in reversed(spans):
        x, r = divmod(x, size)
        out.append(str(low + r))
    return ".".join(reversed(out))


_MONTHS = {m.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, m in enumerate(names) if m}
_MONTH = "(?i:" + "|".join(sorted(_MONTHS, key=len, reverse=True)) + ")"
_NAMED = re.compile(rf"(?P<d>\d{{1,2}})(?P<s> +)(?P<m>{_MONTH})(?P<t>\.?,? +)(?P<y>\d{{4}})|(?P<m2>{_MONTH})(?P<s2>\.? +)(?P<d2>\d{{1,2}})(?P<t2>,? +)(?P<y2>\d{{4}})")
_BEFORE = re.compile(rf"(?<![A-Za-z]){_MONTH}\.? +$")


def _date_class(day: datetime.date) -> tuple[int, bool]:
    """What a date's written forms tell: days below 10, to 12 and above (only these show that the day is first), months below 10."""
    return (day.day > 9) + (day.day > 12), day.month > 9


#: Dates from 1900 to 2099 by class, in order.
DATES: dict[tuple[int, bool], list[int]] = {}
for _day in range(FIRST_DAY, LAST_DAY + 1):
    DATES.setdefault(_date_class(datetime.date.fromordinal(_day)), []).append(_day)


def _shifted(f: Feistel, y: int, m: int, d: int) -> datetime.date | None:
    """The pseudonym of a date: permuted among the dates of its class, so it is the same in all written forms and keeps each of them."""
    try:
        day = datetime.date(y, m, d)
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    kind = _date_class(day)
    some = DATES[kind]
    return datetime.date.fromordinal(some[f.permute(f"date{kind}", bisect_left(some, day.toordinal()), len(some))])


def _date(f: Feistel, m: str) -> str | None:
    """Dates as y-m-d, d.m.y, m/d/y (d/m/y if only that is a date), or with the name of the month; zeros before digits stay."""
    if hit := _NAMED.fullmatch(m):
        g = {k.rstrip("2"): v for k, v in hit.groupdict().items() if v is not None}
        if (new := _shifted(f, int(g["y"]), _MONTHS[g["m"].lower()], int(g["d"]))) is None:
            return None
        name = (calendar.month_abbr if len(g["m"]) == 3 else calendar.month_name)[new.month]
        name = name.upper() if g["m"].isupper() else name.lower() if g["m"].islower() else name
        day = f"{new.day:02d}" if g["d"].startswith("0") else str(new.day)
        first, second = (name, day) if hit["m2"] else (day, name)
        return f"{first}{g['s']}{second}{g['t']}{new.year}"
    a, sep, b, _, c = re.match(r"(\d+)([-./])(\d+)([-./])(\d+)$", m).groups()
    order = "ymd" if len(a) == 4 else "dmy" if sep == "." or int(a) > 12 else "mdy"
    part = dict(zip(order, (int(a), int(b), int(c))))
    if (new := _shifted(f, part["y"], part["m"], part["d"])) is None:
        return None
    zeros = {k: "02d" if v.startswith("0") else "d" for k, v in zip(order, (a, b, c))}
    value = {"y": f"{new.year:04d}", "m": f"{new.month:{zeros['m']}}", "d": f"{new.day:{zeros['d']}}"}
    return sep.join(value[k] for k in order)


def _email(f: Feistel, m: str) -> str | None:
    local, _, domain = m.rpartition("@")
    kinds = [(c, (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (10, "0") if "0" <= c <= "9" else None) for c in local]
    core = [(c, k) for c, k in kinds if k]
    if not core:
        return None
    it = iter(_mixed(f, "mail@" + domain.lower(), "".join(c for c, _ in core), [k for _, k in core]))
    return "".join(next(it) if k else c for c, k in kinds) + "@" + domain


#: What may stand between two digits of a number behind ``+``.
_GAP = r"(?:[ .-]|[ .-]?\(|\)[ .-]?)?"
#: Kinds in order of precedence at one position; what starts at an earlier character goes first.
KINDS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}"
     rf"|\d{{1,2}} +{_MONTH}\.?,? +\d{{4}}|(?<![A-Za-z]){_MONTH}\.? +\d{{1,2}},? +\d{{4}})(?![\d/-]|\.\d)", _date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", _ipv4),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]\d|\d)", _card),
    ("phone", rf"\+1(?:{_GAP}\d){{10}}(?!\d)|\+[02-9](?:{_GAP}\d){{7,14}}(?!\d)|(?<![\d+-])(?:1[ .-])?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]\d{{4}}(?![\d-])", _phone),
)
_ANY = re.compile("|".join(pattern for _, pattern, _ in KINDS))
_EACH = [(name, re.compile(pattern), f) for name, pattern, f in KINDS]
#: Every kind holds a digit or an @; a match starts at it or shortly before.
_ANCHOR = re.compile(r"(?<!\d)\d|@")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _starts(text: str) -> list[int]:
    out = set()
    for m in _ANCHOR.finditer(text):
        p = m.start()
        if text[p] == "@":
            while p and text[p - 1] in _LOCAL:
                p -= 1
            out.add(p)
            continue
        out.add(p)
        if p and text[p - 1] == " " and (m := _BEFORE.search(text, max(0, p - 16), p)):
            out.add(m.start())
        if p and text[p - 1] in "+(":
            out.add(p - 1)
            if p > 1 and text[p - 2] == "+":
                out.add(p - 2)
        elif p > 1 and "A" <= text[p - 1] <= "Z" and "A" <= text[p - 2] <= "Z":
            out.add(p - 2)
    return sorted(out)


#: Kinds whose groups may be followed by others that do not belong to them, and characters that they have at least.
_GROUPED = {"card": 13, "iban": 15}


def _whole_groups(value: str, least: int):
    """A run of groups, then without its last group, and so on while a number of ``least`` characters has room."""
    while sum(c.isalnum() for c in value) >= least:
        yield value
        if not (cut := max(value.rfind(" "), value.rfind("-"))) > 0:
            return
        value = value[:cut]


def pseudonymize(text: str, f: Feistel, known: dict | None = None) -> tuple[str, list[str]]:
    """The text with validated values replaced, and the kind of each."""
    out, last, kinds, known = [], 0, [], {} if known is None else known
    for at in _starts(text):
        if at < last or not _ANY.match(text, at):
            continue
        for name, pattern, function in _EACH:  # a candidate that fails as one kind may be another
            if (hit := pattern.match(text, at)) is None:
                continue
            new = None
            for value in _whole_groups(hit[0], _GROUPED[name]) if name in _GROUPED else (hit[0],):
                if (name, value) not in known:
                    known[name, value] = function(f, value)
                if (new := known[name, value]) is not None:
                    break
            if new is not None:
                out += [text[last:at], new]
                last = at + len(value)
                kinds.append(name)
                break
    return ("".join([*out, text[last:]]) if kinds else text), kinds


def pseudonymize_pii(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, ``n_pii`` and ``kinds`` (kind and number, in order of kind)."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.drop("n_pii", "kinds")
    names = kept.columns
    at = names.index(text)
    schema = kept.select("*", F.lit(0).cast("long").alias("n_pii"), F.lit("").alias("kinds")).schema

    def run(batches):
        f, known = Feistel(key), {}
        for batch in batches:
            texts, counts, kinds = [], [], []
            if len(known) > 200_000:
                known.clear()
            for t in batch.column(at).to_pylist():
                new, found = (t, []) if not t else pseudonymize(t, f, known)
                texts.append(new)
                counts.append(len(found))
                kinds.append(",".join(f"{k}:{found.count(k)}" for k in sorted(set(found))))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [*names, "n_pii", "kinds"])

    return kept.mapInArrow(run, schema)


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize_pii(docs, b"cartolith public test key")
