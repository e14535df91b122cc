"""Format-preserving pseudonyms for personal data.

What looks like a number of a known kind is validated (Luhn, mod 97, octets, calendar, number plans) and then
permuted within its format by a keyed Feistel network: digits stay digits, separators stay, check digits are made
anew, dates stay dates. A value's pseudonym depends on its kind, its canonical form and the key alone, so equal
values stay linked across documents, and different ones of a kind never fall together. The canonical form of an
address is its lower-case one, that of a phone its country code and digits (a number without a code that has the
ten-digit form is +1), that of a date its day, that of a card or account its characters without separators. The
pseudonym of that form is laid out as the value was.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import re
import secrets
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, workers

ROUNDS = 8
#: The setting that holds the key of the registered queries.
KEY_SETTING = "spark.tallyloom.pseudonym.key"
FIRST_YEAR, LAST_YEAR = 1900, 2099
MEMO_ENTRIES = 200_000
#: Characters that are permuted together.
PIECE = 64

#: Kinds besides addresses and how they look; the first that matches at a place is tried, an address before all of them.
LOOKS = {
    "credential": r"\bAKIA[0-9A-Z]{16}\b|(?i:(?<=password=)|(?<=passwd=)|(?<=secret=)|(?<=api_key=)|(?<=token=))[0-9A-Za-z]{8,}|(?<== \")[0-9A-Fa-f]{32,64}(?=\")",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9/.\-])(?:[0-9]{4}(?P<first>[/.\-])[0-9]{2}(?P=first)[0-9]{2}|[0-9]{1,2}(?P<sep>[/.\-])[0-9]{1,2}(?P=sep)[0-9]{4})(?![0-9])(?![/.\-][0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9+])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,5}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9\-.])(?:1(?P<lead>[ .\-]))?[0-9]{3}(?P<mark>[.\-])[0-9]{3}(?P=mark)[0-9]{4}(?![0-9])|(?<![0-9])\(0[0-9]{1,4}\) ?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])",
}
#: What an address's first part is made of, and what follows its @. The first part is found from the @ on backwards, whatever its length.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,30}[A-Za-z]{2,63}")
_LOOK = re.compile("|".join(f"(?P<{k}>{v})" for k, v in LOOKS.items()))
_AT = {k: re.compile(v) for k, v in LOOKS.items()}
_LATER = {k: list(LOOKS)[i + 1 :] for i, k in enumerate(LOOKS)}
#: Kinds whose match may run on into what follows, and the separators of their groups.
_GROUPED = {"iban": " ", "card": " -", "phone": " .-"}
_MAYBE = re.compile(r"[0-9@]|AKIA|(?i:password=|passwd=|secret=|api_key=|token=)")
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_IN = {c: k for k in _CLASSES for c in k}


class Permuter:
    """A keyed permutation of range(n) for any n and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, r: int, half: int, bits: int, back: bool = False) -> int:
        size = (bits + 7) // 8
        got = b""
        while len(got) < size:
            got += hashlib.blake2b(b"%s|%d|%d|%d" % (tweak, r, half, len(got)), key=self.key, digest_size=32).digest()
        return int.from_bytes(got[:size], "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """Balanced Feistel rounds over the next even number of bits, walked until the value is below n again."""
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, t = (1 << half) - 1, f"{tweak}|{n}".encode()
        while True:
            a, b = x >> half, x & mask
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                a, b = (b ^ self._round(t, r, a, half), a) if back else (b, a ^ self._round(t, r, b, half))
            x = a << half | b
            if x < n:
                return x

    def within(self, x: int, n: int, tweak: str, inside) -> int:
        """A permutation of those below n for which inside() holds, and of those for which it doesn't: walked until it is the same."""
        side = inside(x)
        while True:
            x = self.permute(x, n, tweak)
            if inside(x) == side:
                return x

    def text(self, s: str, tweak: str) -> str:
        """Permute letters and digits within their classes; other characters, and the lay-out, stay.

        What is longer than PIECE is permuted piece by piece, each under what comes before it, in time that grows with the length.
        """
        if len(s) > PIECE:
            before, out = hashlib.blake2b(digest_size=16), []
            for at in range(0, len(s), PIECE):
                out.append(self.text(s[at : at + PIECE], f"{tweak}|{before.hexdigest()}" if at else tweak))
                before.update(s[at : at + PIECE].encode())
            return "".join(out)
        x, n, places = 0, 1, []
        for i, c in enumerate(s):
            if c in _IN:
                k = _IN[c]
                x, n = x * len(k) + k.index(c), n * len(k)
                places.append((i, k))
        shape = "".join("d" if c in _CLASSES[0] else "l" if c in _CLASSES[1] else "u" if c in _IN else c for c in s)
        x = self.permute(x, n, f"{tweak}|{shape}")
        out = list(s)
        for i, k in reversed(places):
            x, j = divmod(x, len(k))
            out[i] = k[j]
        return "".join(out)


def luhn_digit(body: str) -> str:
    """The check digit that follows body."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


class _Run:
    """A run of digits with at most one separator between two of them, and sums over its digits from which check digits are told."""

    LOOK = re.compile(r"[0-9](?:[ \-]?[0-9])*")

    def __init__(self, text: str, at: int):
        m = self.LOOK.match(text, at)
        self.start, self.end = m.span()
        self.place, self.sums = array("q"), (array("q", [0]), array("q", [0]))  # with the digits at even places doubled, and with those at odd ones
        for i in range(self.start, self.end):
            if (d := ord(text[i]) - 48) >= 0:
                n, twice = len(self.place), 2 * d if d < 5 else 2 * d - 9
                self.sums[n % 2].append(self.sums[n % 2][n] + twice)
                self.sums[1 - n % 2].append(self.sums[1 - n % 2][n] + d)
                self.place.append(i)

    def ends(self, at: int, stop: int) -> list[int]:
        """Ends, up to stop, of what starts at a digit, ends at a separator or at stop, and has a check digit; the longest first."""
        j = bisect_left(self.place, at)
        out = []
        for k in range(min(j + 19, len(self.place)), j + 12, -1):
            end, sums = self.place[k - 1] + 1, self.sums[k % 2]
            if end <= stop and (sums[k] - sums[j]) % 10 == 0 and (end == stop or self.place[k] > end):
                out.append(end)
        return out


def _into(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _card(s: str, p: Permuter) -> str | None:
    d = _digits(s)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    plain = lambda x: len(set(str(x).zfill(len(d) - 1) + luhn_digit(str(x)))) == 1
    body = str(p.within(int(d[:-1]), 10 ** (len(d) - 1), f"card{len(d)}", plain)).zfill(len(d) - 1)
    return _into(s, body + luhn_digit(body))


def _ip(s: str, p: Permuter) -> str | None:
    parts = s.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    x = p.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(s: str, p: Permuter) -> str | None:
    def valid(x: int) -> bool:
        d = str(x).zfill(9)
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    x = int(_digits(s))
    return _into(s, str(p.within(x, 10**9, "ssn", valid)).zfill(9)) if valid(x) else None


#: Country calling codes of one and two digits; all others have three. Fixed values of the numbering plan.
_ONE, _TWO = frozenset("17"), frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(s: str, p: Permuter) -> str | None:
    d = _digits(s)
    code, said = "1", s[0] == "+" or (s[0] == "1" and len(d) == 11) or s[:2] == "(0"
    if said:  # a national number's 0 stands where a code would
        code = d[:1] if d[0] in _ONE or d[0] == "0" else d[:2] if d[:2] in _TWO else d[:3]
        d = d[len(code) :]
    if not 7 <= len(d) + len(code) <= 15 or len(d) < 6:
        return None
    plan = code == "1" and len(d) == 10  # area and exchange don't begin with 0 or 1
    usual = lambda x: plan and str(x).zfill(10)[0] >= "2" and str(x).zfill(10)[3] >= "2"
    d = str(p.within(int(d), 10 ** len(d), f"phone{code}.{len(d)}", usual)).zfill(len(d))
    return _into(s, code + d if said else d)


def _iban(s: str, p: Permuter) -> str | None:
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = p.text(flat[4:], "iban" + flat[:2])
    flat = flat[:2] + str(98 - number(body + flat[:2] + "00") % 97).zfill(2) + body
    it = iter(flat)
    return "".join(c if c == " " else next(it) for c in s)


@functools.cache
def _late_days() -> tuple[list[int], dict[int, int]]:
    """The days of the years that are known whose day of the month is above 12, as ordinals, and their places in that list."""
    days = [n for n in range(dt.date(FIRST_YEAR, 1, 1).toordinal(), dt.date(LAST_YEAR, 12, 31).toordinal() + 1) if dt.date.fromordinal(n).day > 12]
    return days, {n: i for i, n in enumerate(days)}


def _date(s: str, p: Permuter) -> str | None:
    """Days up to the 12th, whose day and month can be taken for each other, are permuted apart from later ones.

    Where both readings of a date are days, its first number is the day.
    """
    parts = re.split(r"[/.\-]", s)
    sep = s[len(parts[0])]
    for y, m, d in [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]:
        try:
            at = dt.date(int(parts[y]), int(parts[m]), int(parts[d]))
        except ValueError:
            continue
        if FIRST_YEAR <= at.year <= LAST_YEAR:
            break
    else:
        return None
    if at.day <= 12:
        x = p.permute(((at.year - FIRST_YEAR) * 12 + at.month - 1) * 12 + at.day - 1, (LAST_YEAR - FIRST_YEAR + 1) * 144, "early")
        at = dt.date(FIRST_YEAR + x // 144, x // 12 % 12 + 1, x % 12 + 1)
    else:
        days, place = _late_days()
        at = dt.date.fromordinal(days[p.permute(place[at.toordinal()], len(days), "late")])
    wide = 2 if min(map(len, parts)) == 2 else 1
    out = {y: str(at.year), m: str(at.month).zfill(wide), d: str(at.day).zfill(wide)}
    return sep.join(out[i] for i in range(3))


def _email(s: str, p: Permuter) -> str:
    local, _, domain = s.lower().rpartition("@")
    name, _, top = domain.rpartition(".")
    new = f"{p.text(local, 'local')}@{p.text(name, 'domain')}.{top}"
    return "".join(n.upper() if c.isupper() else n for n, c in zip(new, s))


_MAKE = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "ssn": _ssn, "iban": _iban, "date": _date, "credential": lambda s, p: p.text(s[4:] if s.startswith("AKIA") else s, "credential") if not s.startswith("AKIA") else "AKIA" + p.text(s[4:], "akia")}


#: Lengths of account numbers by country.
_IBAN = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def _usual(kind: str, s: str) -> bool:
    """Whether s has the length that its issuer, country or number plan gives."""
    if kind == "iban":
        return len(s.replace(" ", "")) == _IBAN.get(s[:2])
    d = _digits(s)
    if kind == "phone":
        return s.startswith("+1") and len(d) == 11
    return d[0] in "23456" and len(d) == (15 if d[:2] in ("34", "37") else 14 if d[:2] in ("30", "36", "38") else 16)


def _address(text: str, least: int, at: int) -> tuple[int, int, int] | None:
    """Start, end and @ of the first address that has its @ at a place or later and doesn't begin before least."""
    while (k := text.find("@", at)) >= 0:
        at = k + 1
        start = k
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        while start < k and not text[start].isalnum():
            start += 1
        if start < k and (m := _DOMAIN.match(text, at)):
            return start, m.end(), k
        least = at
    return None


class Pseudonymiser:
    def __init__(self, key: bytes):
        self.permuter = Permuter(key)
        self.memo: dict[tuple[str, str], str | None] = {}
        self.run: _Run | None = None  # the one in the text at hand

    def _made(self, kind: str, found: str) -> str | None:
        was = (kind, found)
        if was not in self.memo:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[was] = _MAKE[kind](found, self.permuter)
        return self.memo[was]

    def _valid(self, kind: str, found: str) -> list[str]:
        """The match and the shorter ones that end at a separator, as far as they are valid, the longest first."""
        if kind not in _GROUPED:
            return [found] if self._made(kind, found) is not None else []
        seps = _GROUPED[kind]
        ends = [i for i in range(len(found) - 1, 6, -1) if found[i] in seps and found[i - 1] not in seps]
        return [x for x in (found, *(found[:i] for i in ends)) if (x is found or _AT[kind].fullmatch(x)) and self._made(kind, x) is not None]

    def _cards(self, text: str, at: int, stop: int) -> list[str]:
        """_valid() of a match for a card; what digits beside it share is worked out once."""
        if self.run is None or not self.run.start <= at < self.run.end:
            self.run = _Run(text, at)
        return [x for end in self.run.ends(at, stop) if self._made("card", x := text[at:end]) is not None]

    def _other(self, text: str, at: int) -> bool:
        """Whether a valid number of any kind starts at a place."""
        return any((m := _AT[k].match(text, at)) and self._valid(k, m[0]) for k in ("ip", "date", "ssn", "phone")) or self._card_at(text, at)

    def _card_at(self, text: str, at: int) -> bool:
        m = _AT["card"].match(text, at)
        return m is not None and any(_usual("card", x) for x in self._cards(text, at, m.end()))

    def _pick(self, kind: str, text: str, m: re.Match) -> str | None:
        """What of a match is the value: a usual length, else what ends before another number, else the longest valid part."""
        valid = self._cards(text, *m.span()) if kind == "card" else self._valid(kind, m[0])
        if kind not in _GROUPED or not valid:
            return valid[0] if valid else None
        for x in valid:
            if _usual(kind, x):
                return x
        if kind == "phone":
            for x in valid:
                end = m.start() + len(x)
                if text[end : end + 1] == " " and self._other(text, end + 1):
                    return x
        if kind == "card" and any(text[i - 1] in " -" and self._card_at(text, i) for i in range(m.start() + 1, m.end())):
            return None  # a card of a usual length starts later in it
        return valid[0]

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, length) of each in it; what fails validation stays as it is.

        A number plan is known for +1 alone: after other phones, digits of no known kind count as theirs, up to 15 in all.
        Days from FIRST_YEAR to LAST_YEAR are known, so other dates stay as they are; so do numbers that no kind's form fits.
        """
        if not _MAYBE.search(text):
            return text, []
        out, spans, at, size, pos, self.run = [], [], 0, 0, 0, None
        mail, m = _address(text, 0, 0), _LOOK.search(text, 0)
        while True:
            if mail and mail[0] < pos:
                mail = _address(text, pos, max(mail[2], pos))
            if m and m.start() < pos:
                m = _LOOK.search(text, pos)
            if not mail and not m:
                break
            if mail and (not m or mail[0] <= m.start()):
                start, end, _ = mail
                new = self._made("email", text[start:end])
                out += [text[at:start], new]
                size += start - at
                spans.append(("email", size, len(new)))
                size += len(new)
                at = pos = end
                continue
            kind, start, end = m.lastgroup, *m.span()  # the group that ends last holds the others
            found = self._pick(kind, text, m)
            if found is None:  # another kind at the same place
                for kind in _LATER[kind]:
                    if (other := _AT[kind].match(text, start)) and (found := self._pick(kind, text, other)) is not None:
                        break
            if found is None:
                pos = start + 1
                while pos < end and text[pos - 1].isalnum() and text[pos].isalnum():  # on to the next part
                    pos += 1
                continue
            new = self._made(kind, found)
            out += [text[at:start], new]
            size += start - at
            spans.append((kind, size, len(new)))
            size += len(new)
            at = pos = start + len(found)
        return "".join([*out, text[at:]]), spans


_SPANS = "array<struct<kind:string,start:int,length:int>>"


def key_of(spark) -> bytes:
    """The key in KEY_SETTING; where that is unset, one drawn for this application, whose pseudonyms no other run can link."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return named.encode()
    return _drawn(spark.sparkContext.applicationId)


@functools.cache
def _drawn(application: str) -> bytes:
    return secrets.token_bytes(32)


def pseudonymised(docs: DataFrame, *, key: bytes, text: str = "text", spans: str | None = None) -> DataFrame:
    """docs with pseudonyms in text; all other columns stay. spans: also add a column of that name, the places in code points.

    Null and empty texts stay as they are, with no spans. Texts of any length are read whole, in time that grows with their
    length. Repeated rows get the same pseudonyms; where kinds tie at a place, the first in LOOKS is taken. A column that already
    has the name in spans is replaced. An empty table gives an empty one. No shuffle: a pass over the rows.
    """
    if spans is not None:
        docs = docs.drop(spans)
    out = docs.schema if spans is None else docs.withColumn(spans, F.lit(None).cast(_SPANS)).schema
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonymiser(key)
        for batch in batches:
            got = [(None, []) if t is None else made.text(t) for t in batch.column(at).to_pylist()]
            cols, names = list(batch.columns), list(batch.schema.names)
            cols[at] = pa.array([t for t, _ in got], batch.column(at).type)
            if spans is not None:
                cols.append(pa.array([[dict(zip(("kind", "start", "length"), s)) for s in x] for _, x in got], kind))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(workers.task(run), out)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, key=key_of(spark), spans="spans").withColumn("n_found", F.size("spans"))
