"""Format-preserving pseudonyms for personal numbers, dates and mail addresses.

What is found is validated (check digits, ranges, calendar) and replaced by another valid value of the same
format: a keyed Feistel network permutes the values of the format, walking on until the result is one of them.
Equal values get equal pseudonyms in all documents, and the key's holder can undo them.

==========  ==================================================  ==========================================
kind        accepted                                            permuted
==========  ==================================================  ==========================================
card        13-19 digits, also in groups; Luhn                  all digits but the last, which checks again
iban        country, 2 check digits, 11-30 more; modulo 97      letters and digits of the account; checks
ssn         3-2-4 digits of issuable ranges                     within the issuable ranges
phone       +country, (area) or US, 8-15 digits                 all but the country's digits
ipv4        four octets, none above 255                         within unicast (or within the rest)
date        1900 to 2099, of the calendar; y-m-d, d.m.y, d/m/y  days of these years, in the same layout
email       address                                             letters and digits of the local part
==========  ==================================================  ==========================================

Defined results: a null text stays null; an empty one stays empty; texts without a finding come out unchanged;
rows keep null and repeated ids; no rows give no rows; further columns pass through, save those named like a
result's.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mapped, small_batches, text_bytes

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ipv4", "date", "email")
FIRST_DAY, DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days
#: In the order of preference where two would begin at one place.
NUMBERS = re.compile(
    r"(?<![\w.+])(?:"
    r"(?P<date>\d{4}-\d\d-\d\d(?=[Tt]\d\d)|(?:\d{4}-\d\d-\d\d|\d\d?\.\d\d?\.\d{4}|\d\d?/\d\d?/\d{4})(?![\w-])(?!\.\d))"
    r"|(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3})(?!\w)(?!\.\d)"
    r"|(?P<ssn>\d{3}-\d\d-\d{4})(?![\w-])"
    r"|(?P<card>\d{13,19}|\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}|\d{4}(?P<sep2>[ -])\d{6}(?P=sep2)\d{5})(?!\w)(?!-\d)"
    r"|(?P<iban>[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?!\w)"
    r")"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|1?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\d.-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)(?!-\d)"
)
EMAIL = re.compile(r"(?<![\w.%+-])([A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_])?)(@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w-])")


class Feistel:
    """A keyed permutation of 0 to n - 1 for any n, and its inverse."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, tweak: bytes, r: int, x: int, bits: int) -> int:
        size = -(-bits // 8)
        h = hashlib.blake2b(tweak + bytes([r]) + x.to_bytes(size, "big"), key=self.key, digest_size=min(64, size + 8))
        return int.from_bytes(h.digest(), "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        a, b, mask = x >> bits, x & ((1 << bits) - 1), (1 << bits) - 1
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ self._round(tweak, r, a, bits) & mask, a
            else:
                a, b = b, a ^ self._round(tweak, r, b, bits) & mask
        return a << bits | b

    def permute(self, x: int, n: int, tweak: str, back: bool = False, ok: Callable[[int], bool] = lambda x: True) -> int:
        """The image of ``x`` among those below ``n`` that are ``ok``, ``x`` being one: walks on until it meets one."""
        bits = max(1, -(-(n - 1).bit_length() // 2))
        t = f"{tweak}/{n}".encode()
        while True:
            x = self._once(x, bits, t, back)
            if x < n and ok(x):
                return x


def luhn(digits: str) -> int:
    """The check digit for ``digits``."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _fill(layout: str, chars: str, which: Callable[[str], bool] = str.isdigit) -> str:
    it = iter(chars)
    return "".join(next(it) if which(c) else c for c in layout)


class Pseudonyms:
    """Finds and replaces; ``back`` undoes."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.feistel, self.back = Feistel(hashlib.blake2b(key, digest_size=32).digest()), back

    def _permute(self, x: int, n: int, tweak: str, ok: Callable[[int], bool] = lambda x: True) -> int:
        return self.feistel.permute(x, n, tweak, self.back, ok)

    def _mixed(self, text: str, tweak: str) -> str:
        """Letters and digits among their like; all else stays."""
        sets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
        kinds = [next((s for s in sets if c in s), c) for c in text]
        x, n = 0, 1
        for c, s in zip(text, kinds, strict=True):
            x, n = x * len(s) + s.index(c), n * len(s)
        x = self._permute(x, n, f"{tweak}/{''.join('aA0.'[sets.index(s) if s in sets else 3] for s in kinds)}") if n > 1 else 0
        out = []
        for s in reversed(kinds):
            x, i = divmod(x, len(s))
            out.append(s[i])
        return "".join(reversed(out))

    def card(self, t: str) -> str | None:
        d = re.sub(r"\D", "", t)
        if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        n = len(d) - 1
        body = f"{self._permute(int(d[:-1]), 10**n, 'card', lambda x: len(set(f'{x:0{n}d}' + str(luhn(f'{x:0{n}d}')))) > 1):0{n}d}"
        return _fill(t, body + str(luhn(body)))

    @staticmethod
    def _mod97(country: str, account: str, check: str) -> int:
        return int("".join(str(int(c, 36)) for c in account + country + check)) % 97

    def iban(self, t: str) -> str | None:
        d = t.replace(" ", "")
        if not 15 <= len(d) <= 34 or self._mod97(d[:2], d[4:], d[2:4]) != 1 or not 2 <= int(d[2:4]) <= 98:
            return None
        account = self._mixed(d[4:], f"iban/{d[:2]}")
        return _fill(t, d[:2] + f"{98 - self._mod97(d[:2], account, '00'):02d}" + account, str.isalnum)

    def ssn(self, t: str) -> str | None:
        def ok(x: int) -> bool:
            s = f"{x:09d}"
            return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

        x = int(t.replace("-", ""))
        return _fill(t, f"{self._permute(x, 10**9, 'ssn', ok):09d}") if ok(x) else None

    def phone(self, t: str) -> str | None:
        head = re.match(r"\+\d{1,3}(?=\D)|\+\d|1(?=\D)|", t)[0]
        rest = t[len(head) :]
        d = re.sub(r"\D", "", rest)
        if not 7 <= len(d) <= 14:
            return None
        return head + _fill(rest, f"{self._permute(int(d), 10 ** len(d), f'phone/{head}'):0{len(d)}d}")

    def ipv4(self, t: str) -> str | None:
        o = t.split(".")
        if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in o):
            return None
        unicast = lambda x: 1 <= x >> 24 <= 223
        x = int.from_bytes(bytes(map(int, o)), "big")
        same = unicast if unicast(x) else lambda x: not unicast(x)
        return ".".join(map(str, self._permute(x, 2**32, "ipv4", same).to_bytes(4, "big")))

    def date(self, t: str) -> str | None:
        sep = re.search(r"\D", t)[0]
        n = [int(x) for x in t.split(sep)]

        def day(y: int, m: int, d: int) -> int | None:
            try:
                x = (dt.date(y, m, d) - FIRST_DAY).days
            except ValueError:
                return None
            return x if 0 <= x < DAYS else None

        wide = all(len(x) > 1 for x in t.split(sep))
        two = "02d" if wide else "d"
        if sep == "-":
            order, ok = (0, 1, 2), lambda x: True
        elif day(n[2], n[1], n[0]) is not None:
            order, ok = (2, 1, 0), lambda x: True
        else:  # month first: only days that can't be read as months
            order, ok = (2, 0, 1), lambda x: (FIRST_DAY + dt.timedelta(x)).day > 12
        x = day(*(n[i] for i in order))
        if x is None:
            return None
        narrow = ok if wide else (lambda x: ok(x) and self._narrow(x))
        if not narrow(x):  # one part of two digits and one of one: no layout to keep
            two, narrow = "d", (lambda x: ok(x) and not self._narrow(x))
            if not narrow(x):
                return None
        new = FIRST_DAY + dt.timedelta(self._permute(x, DAYS, f"date/{sep}{order}{two}", narrow))
        values = [new.year, new.month, new.day]
        out = [""] * 3
        for v, i in zip(values, order, strict=True):
            out[i] = f"{v:04d}" if i == order[0] else format(v, two)
        return sep.join(out)

    @staticmethod
    def _narrow(x: int) -> bool:
        """Whether day or month is of one digit: then the layout shows that no zeros are written."""
        d = FIRST_DAY + dt.timedelta(x)
        return d.day < 10 or d.month < 10

    def email(self, m: re.Match, count: dict[str, int]) -> str:
        count["email"] += 1
        return self._mixed(m[1], "email") + m[2]

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        count = dict.fromkeys(KINDS, 0)

        def number(m: re.Match) -> str:
            kind = next(k for k in KINDS[:-1] if m[k])
            new = getattr(self, kind)(m[kind])
            if new is None:
                return m[0]
            count[kind] += 1
            return new

        if "@" in text:  # addresses are set aside, lest their digits be taken for numbers
            pieces, at = [], 0
            for m in EMAIL.finditer(text):
                pieces += [NUMBERS.sub(number, text[at : m.start()]), self.email(m, count)]
                at = m.end()
            return "".join([*pieces, NUMBERS.sub(number, text[at:])]), count
        return NUMBERS.sub(number, text), count


def pseudonymize(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``docs`` with replaced texts, n_values, a count of each kind and text_sha256."""
    own = ["n_values", *(f"n_{k}" for k in KINDS), "text_sha256"]
    docs = docs.drop(*own)
    small_batches(docs.sparkSession)
    keep = docs.columns
    digit = np.zeros(256, bool)
    digit[[*range(48, 58), 64]] = True

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        make = Pseudonyms(key, back)
        col = batch.column(batch.schema.get_field_index("text"))
        buf, off = text_bytes(col)
        marks = np.concatenate([[0], np.cumsum(digit[buf])])
        some = marks[off[1:]] > marks[off[:-1]]  # only texts with a digit or an @ can hold anything
        texts, counts = col.to_pylist(), np.zeros((len(KINDS), batch.num_rows), np.int64)
        for i in np.flatnonzero(some):
            texts[i], found = make(texts[i])
            counts[:, i] = list(found.values())
        out = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n in keep}
        out["text"] = pa.array(texts, pa.string())
        out["n_values"] = counts.sum(0)
        out |= {f"n_{k}": counts[j] for j, k in enumerate(KINDS)}
        out["text_sha256"] = pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
        return pa.record_batch(out)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in own[:-1]), T.StructField("text_sha256", T.StringType())])
    return docs.mapInArrow(mapped(run, "pii"), schema)
