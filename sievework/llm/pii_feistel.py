"""PII pseudonyms by format-preserving Feistel permutations.

Validated values (payment cards by the Luhn rule, IBANs by mod 97, phone and social security numbers by their plans, IPv4
addresses, e-mail addresses, calendar dates) are replaced by another value of the same format: a keyed permutation of the
format's own domain, so equal values get equal pseudonyms in all documents and tasks, whatever their separators, and nothing
needs to be stored or looked up. International phone numbers are split into country code and number by the calling codes,
so +44 20 7946 0958, +442079460958 and 0044 20 7946 0958 agree, as do North American numbers with and without the 1;
national forms elsewhere (020 7946 0958) don't name their country and are values of their own. A run of digits that only
starts with 00 may be any number and stays. The permutation is a balanced Feistel network of ten rounds over numbers below a * b
(NIST SP 800-38G's shape, with BLAKE2b as the round function), walked on until the result is valid again (cycle walking).
Check digits are made anew. Dates are permuted as days from 1900 to 2099, so 2024-01-31 and 31/01/2024 keep agreeing.

With the key the permutation can be undone (`Permuter.undo`); a date such as 05/06/2024 is read day first, so of dates
written month first only the form, not the day, may be lost in undoing. The key is a parameter: take it from a secret store.

Cases: a null text stays null and has no spans; a value that isn't valid stays; values don't overlap, the leftmost and among
equals the kind listed first wins; repeated rows each get a result; extra columns are ignored, or kept by `pseudonymise`; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm.common import columns_only, map_rows, small_batches

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
ROUNDS = 10
_DAY0, _DAYS = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal() - date(1900, 1, 1).toordinal() + 1

EMAIL = r"(?P<email>[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
IBAN = r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
CARD = r"(?P<card>(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9]))"
SSN = r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
PHONE = r"(?P<phone>(?<![0-9A-Za-z+])(?:(?:\+|00(?=[1-9]))[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])|\+[0-9]{9,15}(?![0-9]))"
IP = r"(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9]))"
DATE = r"(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9]))"
PATTERN = re.compile("|".join((EMAIL, IBAN, CARD, SSN, PHONE, IP, DATE)))
#: A value holds two digits near each other, or an @.
HINT = re.compile(r"[0-9][0-9 ().+/-]{0,3}[0-9]|@")
#: The international calling codes of two digits. Codes from 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


class Permuter:
    """Keyed permutations of range(n), one per name."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, name: str, k: int, x: int, m: int) -> int:
        h = hashlib.blake2b(f"{name}|{k}|{x}".encode(), key=self.key[:64], digest_size=(m.bit_length() + 7) // 8 + 8)
        return int.from_bytes(h.digest(), "big") % m

    def _once(self, name: str, x: int, a: int, b: int, back: bool) -> int:
        left, right = divmod(x, b)
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                left = (left + sign * self._round(name, k, right, a)) % a
            else:
                right = (right + sign * self._round(name, k, left, b)) % b
        return left * b + right

    def _walk(self, name: str, n: int, x: int, valid, back: bool) -> int:
        a = 1
        while a * a < n:
            a += max(1, (n // max(a, 1) - a) // 2)
        b = -(-n // a)
        while True:
            x = self._once(name, x, a, b, back)
            if x < n and valid(x):
                return x

    def do(self, name: str, n: int, x: int, valid=lambda _: True) -> int:
        """x to another number of range(n) that is valid, as x must be; a permutation of the valid numbers."""
        return self._walk(name, n, x, valid, False)

    def undo(self, name: str, n: int, x: int, valid=lambda _: True) -> int:
        return self._walk(name, n, x, valid, True)


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _refill(value: str, digits: str) -> str:
    """The value with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _nanp(s: str) -> bool:
    return s[0] in "23456789" and s[3] in "23456789"


def _north_american(digits: str, international: bool) -> bool:
    return len(digits) == 11 and digits[0] == "1" and _nanp(digits[1:]) or len(digits) == 10 and not international and _nanp(digits)


def country_code(digits: str) -> str:
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3]


class Pseudonyms:
    """`of(kind, value)`: the pseudonym, or None if the value isn't valid. Results are kept in a bounded table."""

    MOST = 200_000

    def __init__(self, key: bytes, forward: bool = True):
        self.permuter = Permuter(key)
        self.move = self.permuter.do if forward else self.permuter.undo
        self.known: dict[tuple[str, str], str | None] = {}

    def of(self, kind: str, value: str) -> str | None:
        key = (kind, value)
        if key not in self.known:
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[key] = getattr(self, kind)(value)
        return self.known[key]

    def _number(self, name: str, s: str, valid=lambda _: True) -> str:
        n = len(s)
        return str(self.move(f"{name}{n}", 10**n, int(s), lambda x: valid(str(x).zfill(n)))).zfill(n)

    def _mixed(self, name: str, s: str) -> str:
        """Digits to digits, letters to letters of the same case, other characters stay."""
        x, n = 0, 1
        for c in s:
            if c.isascii() and c.isalnum():
                base, first = (10, "0") if c.isdigit() else (26, "a" if c.islower() else "A")
                x, n = x * base + ord(c) - ord(first), n * base
        if n == 1:
            return s
        shape = "".join("0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s)
        x = self.move(f"{name}{shape}", n, x)
        out = []
        for c in reversed(s):
            if c.isascii() and c.isalnum():
                base, first = (10, "0") if c.isdigit() else (26, "a" if c.islower() else "A")
                x, d = divmod(x, base)
                out.append(chr(ord(first) + d))
            else:
                out.append(c)
        return "".join(reversed(out))

    def email(self, value: str) -> str:
        """The local part is permuted in its shape; the domain says nothing of a person and stays."""
        local, at, domain = value.rpartition("@")
        return self._mixed("email", local) + at + domain

    def card(self, value: str) -> str | None:
        d = _digits(value)
        if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        # The first digit (the scheme) stays; the check digit is made anew.
        body = d[0] + self._number("card" + d[0], d[1:-1])
        return _refill(value, body + luhn_digit(body))

    def iban(self, value: str) -> str | None:
        s = value.replace(" ", "")
        if not 15 <= len(s) <= 34 or _mod97(s) != 1:
            return None
        body = self._mixed("iban" + s[:2], s[4:])
        check = f"{98 - _mod97(s[:2] + '00' + body):02d}"
        it = iter(s[:2] + check + body)
        return "".join(c if c == " " else next(it) for c in value)

    def ssn(self, value: str) -> str | None:
        ok = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        d = _digits(value)
        return _refill(value, self._number("ssn", d, ok)) if ok(d) else None

    def phone(self, value: str) -> str | None:
        d = _digits(value)
        prefix = "00" if d.startswith("00") and value[0] != "+" else ""
        d, international = d[len(prefix) :], bool(prefix) or value[0] == "+"
        if not 7 <= len(d) <= 15:
            return None
        if _north_american(d, international):
            return _refill(value, prefix + d[:-10] + self._number("nanp", d[-10:], _nanp))
        # The country's code stays. No number becomes one of another plan, so each plan is permuted in itself.
        code = country_code(d) if international else ""
        other = lambda s: not _north_american(code + s, international) and (international or not s.startswith("00"))
        return _refill(value, prefix + code + self._number("phone" + code, d[len(code) :], other))

    def ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = self.move("ip", 1 << 32, sum(int(p) << 8 * (3 - k) for k, p in enumerate(parts)))
        return ".".join(str(x >> 8 * k & 255) for k in (3, 2, 1, 0))

    def date(self, value: str) -> str | None:
        sep = next(c for c in value if not c.isdigit())
        parts = value.split(sep)
        if len(parts) != 3:
            return None
        year_first = len(parts[0]) == 4
        y, m, d = (parts if year_first else parts[::-1])
        if sep == "/" and not year_first and int(m) > 12:
            m, d, american = d, m, True
        else:
            american = False
        try:
            day = date(int(y), int(m), int(d)).toordinal() - _DAY0
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        new = date.fromordinal(_DAY0 + self.move("date", _DAYS, day))
        digits = "" if len(m) == 1 or len(d) == 1 else "02"  # written without leading zeros, or with
        y2, m2, d2 = f"{new.year:04d}", f"{new.month:{digits}}", f"{new.day:{digits}}"
        return sep.join((y2, m2, d2) if year_first else (m2, d2, y2) if american else (d2, m2, y2))


@lru_cache(maxsize=4)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def spans(text: str, names: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each valid value, from left to right."""
    out: list[tuple[int, int, str, str]] = []
    if not HINT.search(text):
        return out
    at = 0
    while m := PATTERN.search(text, at):
        kind = m.lastgroup
        new = names.of(kind, m[0])
        if new is None:
            # Not valid as this kind: perhaps as another one that starts here.
            for other in KINDS[KINDS.index(kind) + 1 :]:
                if (x := _ONE[other].match(text, m.start())) and (new := names.of(other, x[0])) is not None:
                    kind, m = other, x
                    break
        if new is None:
            at = m.start() + 1
            while at < len(text) and text[at].isdigit() and text[at - 1].isdigit():
                at += 1  # a shorter run of the same digits is no value
        else:
            out.append((m.start(), m.end(), kind, new))
            at = m.end()
    return out


_ONE = {k: re.compile(p) for k, p in zip(KINDS, (EMAIL, IBAN, CARD, SSN, PHONE, IP, DATE))}


def replaced(text: str, names: Pseudonyms) -> tuple[str, list[tuple[int, int, str, str]]]:
    found = spans(text, names)
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), found


_DDL = "doc_id long, text string, n_values long, kinds string, spans string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_values", pa.int64()), ("kinds", pa.string()), ("spans", pa.string())])


def find_and_replace(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text) to doc_id, the new text, the number of values, their distinct kinds and their spans in the old text
    (kind:start:end, code points, the end exclusive)."""
    secret = key.encode()

    def rows(it):
        names = pseudonyms(secret)
        for doc_id, text in it:
            if text is None:
                yield doc_id, None, 0, "", ""
                continue
            new, found = replaced(text, names)
            yield doc_id, new, len(found), ",".join(sorted({k for _, _, k, _ in found})), ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found)

    return map_rows(columns_only(docs, "doc_id", "text"), rows, _DDL, _ARROW)


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The same rows and columns with the values in `column` replaced; lengths of texts may change with IP addresses and with dates
    written without leading zeros."""
    secret, schema = key.encode(), docs.schema
    at = docs.columns.index(column)

    def run(batches):
        names = pseudonyms(secret)
        for whole in batches:
            for first in range(0, whole.num_rows, 200):
                b = whole.slice(first, 200)
                columns = list(b.columns)
                columns[at] = pa.array([None if t is None else replaced(t, names)[0] for t in columns[at].to_pylist()], type=b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
