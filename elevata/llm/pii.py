"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, number plans, the
calendar). Each becomes an index into the set of all values of its format, is
permuted there by a keyed Feistel network, and is written back in the same
format, so equal values stay equal in all documents and no value stays as it
is: the permutation is the network's inverse after a keyed step after the
network, a single cycle through all indices. Dates and IPv6 addresses that mean
the same in different notations become the same other one.

Kinds: e-mail addresses (letters and digits of the local part), payment card
numbers (Luhn check digit kept right), telephone numbers, IPv4 and IPv6
addresses (the latter with three written groups at least), social security
numbers, IBANs (check digits kept right), dates with years of four digits (in
digits, or with the name of the month in English, German, French or Spanish),
and keys and secrets: ``AKIA...``, and the values of password, token, secret
and key assignments that are hexadecimal (12 signs at least) or have letters
and digits (6 signs at least for passwords, 12 for the others). No value is too
long: long ones are permuted in blocks, each under the signs before it. Dates
of the years 1900 to 2099 stay within these years, others outside them; days
behind the 12th stay behind it, so that no notation turns into another. Dates
with years of two digits stay, as they may mean several days.

Defined results: a null text stays null; an empty one empty; a text without
such values is returned as it is; where findings overlap the one that begins
first wins, then the longer; an IBAN ends where its country's length is
reached, if it is valid there, else at the last space where it is; card
numbers among other groups of digits are looked for in what is left, and those
that cover the most digits are taken; texts are handled whole; rows that
repeat give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, trimmed

ROUNDS = 8
KINDS = ("email", "card", "phone", "ipv4", "ipv6", "ssn", "iban", "date", "secret")
#: Signs of a value that are permuted at a time.
BLOCK = 64

LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
FIRST_DAY, N_DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to 2099-12-31
LAST_DAY = datetime.date.max.toordinal()

#: Names of the months.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
MONTH_NUMBERS = {land: {name.lower(): i + 1 for i, name in enumerate(names)} for land, names in MONTHS.items()}


class Feistel:
    """A keyed permutation of the whole numbers below any size."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        seed = hashlib.blake2b(f"{tweak}|{size}".encode(), key=key, digest_size=32)
        self.key = seed.digest()
        self.step = 1 + int.from_bytes(hashlib.blake2b(b"step", key=self.key).digest(), "big") % (size - 1) if size > 1 else 0

    def _round(self, i: int, x: int) -> int:
        wide = (self.half + 7) // 8
        out = b""
        while len(out) < wide:
            out += hashlib.blake2b(x.to_bytes(wide, "big") + bytes([i, len(out) // 64]), key=self.key).digest()
        return int.from_bytes(out[:wide], "big") & self.mask

    def _once(self, x: int, rounds) -> int:
        a, b = x >> self.half, x & self.mask
        for i in rounds:
            a, b = b, a ^ self._round(i, b)
        return a << self.half | b

    def forward(self, x: int) -> int:
        """Walks along the network's cycle until it is below the size."""
        while True:
            x = self._once(x, range(ROUNDS))
            if x < self.size:
                return x

    def backward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(ROUNDS)):
                a, b = b ^ self._round(i, a), a
            x = a << self.half | b
            if x < self.size:
                return x

    def shifted(self, x: int, back: bool = False) -> int:
        """A permutation that moves every number (where there are two)."""
        return self.backward((self.forward(x) + (-self.step if back else self.step)) % self.size)


def luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _refill(shape: str, signs: str, keep: Callable[[str], bool]) -> str:
    """``shape`` with its signs that count replaced in order."""
    left = iter(signs)
    return "".join(next(left) if keep(c) else c for c in shape)


class Pseudonyms:
    """Finds personal values and gives their pseudonyms under a key; with
    ``back``, the values of pseudonyms."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS, back: bool = False):
        self.key = key
        self.kinds = kinds
        self.back = back
        self._network = lru_cache(100_000)(lambda tweak, size: Feistel(key, tweak, size))
        self._known = lru_cache(200_000)(self._pseudonym)

    def _mixed(self, tweak: str, signs: str, alphabets: list[str], back: bool) -> str:
        """Permutes a string whose i-th sign is from the i-th alphabet."""
        out, before = [], hashlib.blake2b(digest_size=16)
        for at in range(0, len(signs), BLOCK):
            part = signs[at: at + BLOCK]
            here = f"{tweak}+{before.hexdigest()}" if at else tweak
            out.append(self._block(here, part, alphabets[at: at + BLOCK], back))
            before.update((out[-1] if back else part).encode())
        return "".join(out)

    def _block(self, tweak: str, signs: str, alphabets: list[str], back: bool) -> str:
        index = 0
        for c, a in zip(signs, alphabets, strict=True):
            index = index * len(a) + a.index(c)
        index = self._network(tweak, prod(map(len, alphabets))).shifted(index, back)
        out = []
        for a in reversed(alphabets):
            index, i = divmod(index, len(a))
            out.append(a[i])
        return "".join(reversed(out))

    def _by_class(self, tweak: str, text: str, back: bool) -> str:
        """Letters and digits permuted, each within its own class."""
        of = lambda c: LOWER if c in LOWER else UPPER if c in UPPER else DIGITS if c in DIGITS else ""
        signs = "".join(c for c in text if of(c))
        shape = "".join("a" if of(c) == LOWER else "A" if of(c) == UPPER else "0" if of(c) else c for c in text)
        return _refill(text, self._mixed(f"{tweak}:{shape}", signs, [of(c) for c in signs], back), lambda c: bool(of(c))) if signs else text

    # Each kind: the value's pseudonym, or None where it isn't valid.

    def email(self, value: str, back: bool = False) -> str | None:
        local, _, domain = value.rpartition("@")
        if not any(c in LOWER + UPPER + DIGITS for c in local):
            return None
        return f"{self._by_class('email', local, back)}@{domain}"

    def card(self, value: str, back: bool = False) -> str | None:
        digits = "".join(c for c in value if c in DIGITS)
        if not 13 <= len(digits) <= 19 or digits[0] == "0" or int(digits[-1]) != luhn(digits[:-1]):
            return None
        body = self._mixed("card", digits[:-1], [DIGITS[1:], *[DIGITS] * (len(digits) - 2)], back)
        return _refill(value, body + str(luhn(body)), lambda c: c in DIGITS)

    def phone(self, value: str, back: bool = False) -> str | None:
        digits = "".join(c for c in value if c in DIGITS)
        if len(digits) == 11 and digits[0] == "1" or len(digits) == 10 and not value.startswith("+"):
            own = digits[-10:]  # area and exchange begin with 2 to 9 in the number plan
            if not value.startswith("+") and (own[0] in "01" or own[3] in "01"):
                return None
            first = [DIGITS[:2] if own[i] in "01" else DIGITS[2:] for i in (0, 3)]
            signs = [first[0], DIGITS, DIGITS, first[1], *[DIGITS] * 6]
            kinds = "".join("0" if own[i] in "01" else "2" for i in (0, 3))
            return _refill(value, digits[:-10] + self._mixed(f"phone:{kinds}", own, signs, back), lambda c: c in DIGITS)
        if not value.startswith("+") or not 8 <= len(digits) <= 15 or digits[0] == "0":
            return None
        return _refill(value, digits[:2] + self._mixed(f"phone:{digits[:2]}", digits[2:], [DIGITS] * (len(digits) - 2), back), lambda c: c in DIGITS)

    def ipv4(self, value: str, back: bool = False) -> str | None:
        parts = value.split(".")
        if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
            return None
        index = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self._network("ipv4", 1 << 32).shifted(index, back).to_bytes(4, "big")))

    def ipv6(self, value: str, back: bool = False) -> str | None:
        try:
            old = ipaddress.IPv6Address(value)
        except ValueError:
            return None
        if not any(c in DIGITS for c in value) or sum(map(bool, value.split(":"))) < 3:
            return None
        new = ipaddress.IPv6Address(self._network("ipv6", 1 << 128).shifted(int(old), back))
        shown = new.exploded if len(value) == 39 else new.compressed
        return shown.upper() if any(c in UPPER for c in value) else shown

    def ssn(self, value: str, back: bool = False) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        index, serial = divmod(self._network("ssn", 898 * 99 * 9999).shifted(index, back), 9999)
        area, group = divmod(index, 99)
        area += 1 + (area >= 665)
        return f"{area:03}-{group + 1:02}-{serial + 1:04}"

    def iban(self, value: str, back: bool = False) -> str | None:
        signs = "".join(value.split())
        check = lambda land, body: 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        if not 15 <= len(signs) <= 34 or int(signs[2:4]) != check(signs[:2], signs[4:]):
            return None
        body = self._by_class(f"iban:{signs[:2]}", signs[4:], back)
        return _refill(value, f"{signs[:2]}{check(signs[:2], body):02}{body}", lambda c: not c.isspace())

    def _other_day(self, year: int, month: int, day: int, back: bool) -> datetime.date | None:
        try:
            index = datetime.date(year, month, day).toordinal() - FIRST_DAY
        except ValueError:
            return None
        near = 0 <= index < N_DAYS
        if not near:  # numbered behind each other, without those years
            index = index + FIRST_DAY - 1 if index < 0 else index + FIRST_DAY - 1 - N_DAYS
        network = self._network("date", N_DAYS) if near else self._network("far date", LAST_DAY - N_DAYS)
        while True:
            index = network.shifted(index, back)
            at = index + FIRST_DAY if near else index + 1 if index < FIRST_DAY - 1 else index + 1 + N_DAYS
            new = datetime.date.fromordinal(at)
            if (new.day > 12) == (day > 12):
                return new

    def _named_date(self, value: str, back: bool) -> str | None:
        """A date with the name of its month; names of several languages are
        taken for those of the notation's."""
        first, sep, second, sep2, year = NAMED.fullmatch(value).groups()
        day, name = (first, second) if first[0] in DIGITS else (second, first)
        order = ["de", "en", "short"] if sep.startswith(".") else ["fr", "es", "en", "short", "de"] if name[0].islower() else ["en", "short", "de", "fr", "es"]
        land = next((x for x in [*order, "fr", "es"] if name.lower() in MONTH_NUMBERS[x]), None)
        new = self._other_day(int(year), MONTH_NUMBERS[land][name.lower()], int(day), back) if land else None
        if new is None:
            return None
        shown = MONTHS[land][new.month - 1]
        shown = shown.upper() if name.isupper() else shown.lower() if name[0].islower() else shown[0].upper() + shown[1:]
        number = f"{new.day:0{len(day)}}" if day[0] == "0" else str(new.day)
        parts = (number, shown) if first is day else (shown, number)
        return f"{parts[0]}{sep}{parts[1]}{sep2}{new.year:04}"

    def date(self, value: str, back: bool = False) -> str | None:
        if not value[-1].isdigit() or any(c.isalpha() for c in value):
            return self._named_date(value, back)
        a, sep, b, sep2, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", value, re.ASCII).groups()
        if sep != sep2:
            return None
        if len(a) == 4:
            order, year, month, day = "ymd", a, b, c
        elif len(c) == 4:
            order, year, month, day = ("mdy", c, a, b) if int(b) > 12 else ("dmy", c, b, a)
        else:
            return None
        new = self._other_day(int(year), int(month), int(day), back)
        if new is None:
            return None
        wide = 2 if len(month) == 2 and len(day) == 2 else 1
        own = {"y": f"{new.year:04}", "m": f"{new.month:0{wide}}", "d": f"{new.day:0{wide}}"}
        return sep.join(own[x] for x in order)

    def secret(self, value: str, back: bool = False) -> str | None:
        if value.startswith("AKIA"):
            return "AKIA" + self._mixed("akia", value[4:], [UPPER + DIGITS] * (len(value) - 4), back)
        named, sep, own = re.fullmatch(r"(?is)([a-z]+[_-]?[a-z]*)([ \t]*[=:][ \t]*[\"']?)(.*)", value).groups()
        letters, digits = any(c in LOWER + UPPER for c in own), any(c in DIGITS for c in own)
        alphabet = next((a for a in (HEX, HEX.upper()) if letters and len(own) >= 12 and all(c in a for c in own)), None)
        if alphabet is None and not (digits and (len(own) >= 12 or letters and len(own) >= 6 and named[0] in "pP")):
            return None
        new = own
        while True:  # on to a value that is read alike
            new = self._by_class("secret", new, back) if alphabet is None else self._mixed(alphabet, new, [alphabet] * len(new), back)
            if alphabet is not None and any(c in LOWER + UPPER for c in new):
                break
            if alphabet is None and not (letters and len(new) >= 12 and any(all(c in a for c in new) for a in (HEX, HEX.upper()))):
                break
        return f"{named}{sep}{new}"

    def _pseudonym(self, kind: str, value: str) -> str | None:
        return getattr(self, kind)(value, self.back)

    def _ibans(self, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int, str]]:
        """A match may hold words behind the IBAN, or begin before it: shorter
        ends are tried, and the search goes on behind its first sign."""
        at = 0
        while m := pattern.search(text, at):
            at = m.start() + 1
            own = IBAN_SIGNS.get(m.group()[:2])
            ends = [m.end(), *(i for i in range(m.end() - 1, m.start(), -1) if text[i] == " ")]
            ends.sort(key=lambda end: len(text[m.start(): end].replace(" ", "")) != own)
            for end in ends:
                new = self._known("iban", text[m.start(): end])
                if new is not None:
                    yield m.start(), end, new
                    at = end
                    break

    def _inner_cards(self, text: str, at: int, to: int) -> Iterator[tuple[int, int, str, str]]:
        """Cards among other groups of digits. Groups that hyphens tie to a
        word are part of it."""
        for run in _digit_run.finditer(text, at, to):
            groups = [m.span() for m in _digits.finditer(text, *run.span())]
            n = len(groups)
            begins, ends = [False] * n, [False] * n
            for i, (a, _) in enumerate(groups):
                begins[i] = text[a - 1] == " " or begins[i - 1] if i else not _before.search(text[max(a - 1, 0): a])
            for j in reversed(range(n)):
                b = groups[j][1]
                ends[j] = text[b] == " " or ends[j + 1] if j < n - 1 else not _behind.search(text[b: b + 1])
            most, card = [0] * (n + 1), [None] * n  # most digits from each group on
            for i in reversed(range(n)):
                most[i], size = most[i + 1], 0
                for j in range(i, n if begins[i] else i):
                    size += groups[j][1] - groups[j][0]
                    if size > 19:
                        break
                    if size < 13 or not ends[j] or size + most[j + 1] < most[i]:
                        continue
                    new = self._known("card", text[groups[i][0]: groups[j][1]])
                    if new is not None:
                        most[i], card[i] = size + most[j + 1], (j, new)
            i = 0
            while i < n:
                j, new = card[i] or (i, None)
                if new is not None:
                    yield groups[i][0], groups[j][1], "card", new
                i = j + 1

    def findings(self, text: str) -> list[tuple[int, int, str, str]]:
        """Start, end, kind and pseudonym, in order and without overlap."""
        found = []
        for kind, need, pattern in PATTERNS:
            if kind not in self.kinds or need and not need.search(text):
                continue
            if kind == "iban":
                found += [(start, -end, KINDS.index(kind), new) for start, end, new in self._ibans(pattern, text)]
                continue
            for m in pattern.finditer(text):
                group = m.lastindex or 0
                new = self._known(kind, m.group(group))
                if new is not None:
                    found.append((m.start(group), -m.end(group), KINDS.index(kind), new))
        out, at = [], 0
        for start, end, kind, new in sorted(found):
            if start >= at:
                out.append((start, -end, KINDS[kind], new))
                at = -end
        if "card" in self.kinds and _digit_run.search(text):
            gaps = zip([0, *(f[1] for f in out)], [*(f[0] for f in out), len(text)], strict=True)
            out += [f for at, to in list(gaps) for f in self._inner_cards(text, at, to)]
            out.sort()
        return out

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)
        parts, at = [], 0
        for start, end, kind, new in self.findings(text):
            parts += [text[at:start], new]
            counts[kind] += 1
            at = end
        return "".join([*parts, text[at:]]) if parts else text, counts


def _pattern(p: str) -> re.Pattern:
    return re.compile(p, re.ASCII)


_digit = _pattern("[0-9]")
_digits = _pattern("[0-9]+")
_digit_run = _pattern(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}")
_before, _behind = _pattern(r"[\w.-]"), _pattern(r"[\w-]")
#: Signs of an IBAN by country.
IBAN_SIGNS = {
    land: n for n, lands in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items() for land in lands.split()
}
_names = "|".join(sorted({re.escape(n) for names in MONTHS.values() for n in names}, key=len, reverse=True))
#: 12 March 2024, 12. März 2024, 12 de marzo de 2024; March 12, 2024.
NAMED_DAY, NAMED_MONTH = (
    rf"[0-9]{{1,2}}(?:\.? | de )(?i:{_names})(?:\.?,? | de )[0-9]{{4}}", rf"(?i:{_names})\.? [0-9]{{1,2}},? [0-9]{{4}}",
)
NAMED = re.compile(rf"(?i)([0-9]{{1,2}}|(?:{_names}))(\.? | de )((?:{_names})|[0-9]{{1,2}})(\.?,? | de )([0-9]{{4}})")
#: Kind, what a text must hold for the kind to be looked for, the pattern (its
#: group is the value where it has one). All run in linear time.
PATTERNS = [
    ("email", _pattern("@"), _pattern(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")),
    ("card", _digit, _pattern(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")),
    ("phone", _digit, _pattern(r"(?<![\w.+-])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![\w-])")),
    ("phone", _pattern(r"\+[0-9]"), _pattern(r"(?<![\w.+-])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![\w-])")),
    ("ipv4", _digit, _pattern(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])")),
    ("ipv6", _pattern("[0-9A-Fa-f]:[0-9A-Fa-f:]"), _pattern(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.[0-9])")),
    ("ssn", _digit, _pattern(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", _digit, _pattern(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("date", _digit, _pattern(r"(?<![\w./-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![\w/-]|\.[0-9])")),
    ("date", _digit, re.compile(rf"(?<![\w.,/-])(?:{NAMED_DAY}|{NAMED_MONTH})(?![\w/-])")),
    ("secret", _pattern("AKIA"), _pattern(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("secret", _pattern("(?i)passw(?:or)?d|token|secret|api[_-]?key"), _pattern(r"(?i:passw(?:or)?d|token|secret|api[_-]?key)[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9](?:[A-Za-z0-9!#$%&*+./=?@^_~-]*[A-Za-z0-9])?(?![0-9A-Za-z])")),
]


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced, plus
    ``n_replaced`` and ``replaced`` (a count by kind, of those found).

    Added names get underscores where they clash. Keep the key secret: who
    has it can undo the pseudonyms.
    """
    total, by_kind = free_name(docs, "n_replaced"), free_name(docs, "replaced")
    schema = T.StructType([*docs.schema.fields, T.StructField(total, T.LongType()), T.StructField(by_kind, T.MapType(T.StringType(), T.LongType()))])
    names, place = schema.fieldNames(), docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        values = Pseudonyms(key, kinds)
        for batch in batches:
            texts, n, maps = [], [], []
            for text in batch.column(place).to_pylist():
                new, counts = values.replace(text) if text else (text, {})
                texts.append(new)
                n.append(sum(counts.values()))
                maps.append([(k, v) for k, v in counts.items() if v])
            columns = list(batch.columns)
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(maps, pa.map_(pa.string(), pa.int64()))], names=names)

    return docs.mapInArrow(trimmed(run), schema)


def restored(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the values of pseudonyms in place of these; short names
    of months may come back written in full (May is both)."""
    names, place = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        values = Pseudonyms(key, back=True)
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([values.replace(t)[0] if t else t for t in columns[place].to_pylist()], columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(trimmed(run), docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = pseudonymise(docs, b"elevata demonstration key")
    return done.select("doc_id", "n_replaced", *(F.coalesce(F.col("replaced")[k], F.lit(0)).alias(f"n_{k}") for k in KINDS), "text")
