"""Format-preserving pseudonyms: identifiers that pass their format's validation are permuted by a keyed Feistel
network within the set of valid values, so equal values stay linked across documents and rows."""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import take

ROUNDS = 8
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
LAST_DAY = dt.date(2099, 12, 31).toordinal()
#: Length of an IBAN by country (fixed values, the whole registry).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Each length's countries, then so many characters, with a blank before any of them.
_IBAN = "|".join(f"(?:{'|'.join(c for c in sorted(IBAN_LENGTH) if IBAN_LENGTH[c] == n)})[0-9]{{2}}(?: ?[0-9A-Z]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTH.values())))
#: Country calling codes of one and two digits; all others have three.
CALLING = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


class Feistel:
    """Keyed permutations of {0 .. n-1}, as a conjugated shift: no value is its own image for n > 1.

    A value is split into two mixed-radix halves; every round adds a keyed hash of one half to the other.  A
    permutation s of that kind gives s(s'(x) + c) with s' its inverse and a keyed shift c, which is one cycle
    structure without fixed points for c not 0."""

    def __init__(self, key: bytes, tweak: str, low: int, high: int):
        self.low, self.high = low, high
        self.size = low * high
        sizes = b"\0%d\0%d" % (low, high) if self.size.bit_length() <= 4096 else b"\0%x\0%x" % (low, high)
        self.key = hashlib.blake2b(tweak.encode() + sizes, key=hashlib.sha256(key).digest()[:32]).digest()
        self.shift = 1 + self._round(ROUNDS, 0) % max(1, self.size - 1)

    def _round(self, i: int, half: int) -> int:
        raw = half.to_bytes((half.bit_length() + 7) // 8, "big")
        width = max(16, (max(self.low, self.high).bit_length() + 7) // 8 + 8)
        if width > 64:  # a hash as wide as the half, so that every digit of a long value changes
            return int.from_bytes(hashlib.shake_256(self.key + bytes([i]) + raw).digest(width), "big")
        return int.from_bytes(hashlib.blake2b(raw, key=self.key, salt=bytes([i]), digest_size=width).digest(), "big")

    def _forward(self, x: int) -> int:
        a, b = x % self.low, x // self.low
        for i in range(ROUNDS):
            if i % 2:
                b = (b + self._round(i, a)) % self.high
            else:
                a = (a + self._round(i, b)) % self.low
        return a + self.low * b

    def _backward(self, x: int) -> int:
        a, b = x % self.low, x // self.low
        for i in reversed(range(ROUNDS)):
            if i % 2:
                b = (b - self._round(i, a)) % self.high
            else:
                a = (a - self._round(i, b)) % self.low
        return a + self.low * b

    def __call__(self, x: int) -> int:
        return self._forward((self._backward(x) + self.shift) % self.size) if self.size > 1 else x

    def undo(self, y: int) -> int:
        return self._forward((self._backward(y) - self.shift) % self.size) if self.size > 1 else y


class Permuter:
    """Permutes texts within their format: each letter and digit stays of its class, other characters stay."""

    CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo, self.made = key, undo, {}

    def number(self, kind: str, x: int, n: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The image of a valid number among the valid ones of {0 .. n-1}, by walking the cycle."""
        low = 1
        while low * low < n:
            low *= 2
        high = -(-n // low)
        f = self._feistel(kind, low, high)
        step = f.undo if self.undo else f
        y = step(x)
        while y >= n or not valid(y):
            y = step(y)
        return y

    def text(self, kind: str, s: str, classes: Sequence[str] | None = None, valid: Callable[[str], bool] = lambda _: True) -> str:
        places = [(i, c) for i, ch in enumerate(s) for c in classes or self.CLASSES if ch in c]
        if not places:
            return s
        half = len(places) // 2
        low = high = 1
        x, weight = 0, 1
        for j, (i, c) in enumerate(places):
            x += weight * c.index(s[i])
            weight *= len(c)
            if j < half:
                low *= len(c)
            else:
                high *= len(c)
        # values of one shape share a permutation, whatever separates their characters
        f = self._feistel(kind + ":" + "".join(c[0] + c[-1] for _, c in places), low, high)
        step = f.undo if self.undo else f
        while True:
            x = step(x)
            out, rest = list(s), x
            for i, c in places:
                rest, r = divmod(rest, len(c))
                out[i] = c[r]
            if valid(got := "".join(out)):
                return got

    def _feistel(self, kind: str, low: int, high: int) -> Feistel:
        f = self.made.get((kind, low, high))
        if f is None:
            if len(self.made) > 10_000:
                self.made.clear()
            f = self.made[kind, low, high] = Feistel(self.key, kind, low, high)
        return f


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c)
        if i % 2 == 0:
            d = 2 * d - 9 * (d > 4)
        total += d
    return str(-total % 10)


def _card(p: Permuter, s: str) -> str | None:
    digits = re.sub(r"[ -]", "", s)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    # the first digit names the kind of card and stays
    body = p.text("card" + digits[0], digits[1:-1])
    new = iter(digits[0] + body + luhn_digit(digits[0] + body))
    return "".join(next(new) if c.isdigit() else c for c in s)


def _abroad(p: Permuter, s: str) -> str | None:
    """Numbers with a country code other than 1, which stays; one digit in brackets is a trunk prefix."""
    places = [i for i, c in enumerate(s) if c.isdigit() and not (s[i - 1] == "(" and s[i + 1:i + 2] == ")")]
    digits = "".join(s[i] for i in places)
    code = next(digits[:n] for n in (1, 2, 3) if n == 3 or digits[:n] in CALLING)
    if not 8 <= len(digits) <= 15:
        return None
    # the digit after the code stays: it tells a trunk zero or a kind of number
    kept = digits[:len(code) + 1]
    out = list(s)
    for i, c in zip(places, kept + p.text("phone+" + kept, digits[len(kept):]), strict=True):
        out[i] = c
    return "".join(out)


def _phone(p: Permuter, s: str) -> str | None:
    digits = re.sub(r"[^0-9]", "", s)
    if s[0] == "+" and digits[0] != "1":
        return _abroad(p, s)
    if s[0] == "+" and len(digits) != 11:
        return None
    digits = digits[-10:]
    ok = lambda d: d[0] in "23456789" and d[3] in "23456789"
    if not ok(digits):
        return None
    new = p.text("phone", digits, valid=ok)
    prefix = len(re.sub(r"[^0-9]", "", s)) - 10
    out, k = [], 0
    for c in s:
        if c.isdigit():
            out.append(c if k < prefix else new[k - prefix])
            k += 1
        else:
            out.append(c)
    return "".join(out)


def _ipv4(p: Permuter, s: str) -> str | None:
    parts = s.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, p.number("ipv4", x, 1 << 32).to_bytes(4, "big")))


def _email(p: Permuter, s: str) -> str | None:
    name, domain = s.rsplit("@", 1)
    return p.text("email@" + domain.lower(), name) + "@" + domain


def _ssn(p: Permuter, s: str) -> str | None:
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[4:6] != "00" and d[7:] != "0000"
    return p.text("ssn", s, valid=ok) if ok(s) else None


def _iban(p: Permuter, s: str) -> str | None:
    number = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4]))
    solid = s.replace(" ", "")
    if IBAN_LENGTH.get(solid[:2]) != len(solid) or number(solid) % 97 != 1:
        return None
    body = p.text("iban" + solid[:2], solid[4:])
    new = iter(solid[:2] + f"{98 - number(solid[:2] + '00' + body) % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def _hex(p: Permuter, s: str) -> str | None:
    return p.text("hex", s, classes=("0123456789abcdef",) if s == s.lower() else ("0123456789ABCDEF",))


def _access_key(p: Permuter, s: str) -> str | None:
    return s[:4] + p.text("access", s[4:], classes=("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",))


def _date(p: Permuter, s: str) -> str | None:
    cut = re.split(r"([-./])", s)
    year_first = len(cut[0]) == 4
    if cut[1] != cut[3]:
        return None
    a, b, c = int(cut[0]), int(cut[2]), int(cut[4])
    # year first, else day first; with slashes month first where the second number can't be a month
    orders = ("ymd",) if year_first else ("dmy", "mdy") if cut[1] == "/" else ("dmy",)
    for order in orders:
        got = dict(zip(order, (a, b, c), strict=True))
        if 1900 <= got["y"] <= 2099 and 1 <= got["m"] <= 12 and 1 <= got["d"] <= calendar.monthrange(got["y"], got["m"])[1]:
            break
    else:
        return None
    n = LAST_DAY - FIRST_DAY + 1
    width = {k: len(x) for k, x in zip(order, (cut[0], cut[2], cut[4]), strict=True)}
    form = _date_form(got["m"], got["d"])

    def ok(x: int) -> bool:
        day = dt.date.fromordinal(FIRST_DAY + x)
        return _date_form(day.month, day.day) == form

    x = dt.date(got["y"], got["m"], got["d"]).toordinal() - FIRST_DAY
    day = dt.date.fromordinal(FIRST_DAY + p.number("date", x, n, ok))
    value = {"y": f"{day.year:04d}", "m": f"{day.month:0{width['m']}d}", "d": f"{day.day:0{width['d']}d}"}
    return cut[1].join(value[k] for k in order)


def _date_form(month: int, day: int) -> tuple[bool, int]:
    """What a date's image keeps, so that every way to write the one writes the other: which parts have one digit, and
    whether the day can be taken for a month."""
    return month < 10, (day >= 10) + (day > 12)


#: Kind, pattern and permutation, in order of precedence where matches begin at one place.
KINDS: tuple[tuple[str, str, Callable[[Permuter, str], str | None]], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}))*\.[A-Za-z]{2,24}\b", _email),
    ("access_key", r"\bAKIA[0-9A-Z]{16}\b", _access_key),
    ("iban", rf"\b(?:{_IBAN})\b", _iban),
    ("secret", r"(?i:(?<=token = \")|(?<=token=\")|(?<=token=)|(?<=password=)|(?<=password = )|(?<=secret=)|(?<=api_key=))(?:[0-9a-f]{16,}|[0-9A-F]{16,})\b", _hex),
    ("ipv4", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", _ipv4),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})(?![0-9]|[./-][0-9])", _date),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _ssn),
    ("phone", r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9]|-[0-9])"
     r"|(?<![\w+])\+(?!(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})(?![ ./-]?[0-9]))"
     r"[1-9](?:[ ./()-]{0,2}[0-9]){7,14}(?![0-9])", _phone),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}(?![0-9])", _card),
)
#: What a text must hold for any pattern to match.
WORTH = re.compile(r"[0-9@=]|AKIA")


#: No value of a kind other than card that begins within a run of digits ends so far behind it, secrets and names aside.
BEHIND = 512


class Pseudonymizer:
    def __init__(self, key: bytes, undo: bool = False):
        self.permuter = Permuter(key, undo)
        self.each = {name: re.compile(pattern) for name, pattern, _ in KINDS}
        self.pattern = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in KINDS))
        self.no_card = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in KINDS if name != "card"))
        self.by_kind = {name: f for name, _, f in KINDS}

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind were put in."""
        counts: dict[str, int] = {}
        if not WORTH.search(text):
            return text, counts
        out, done, at = [], 0, 0
        no_card = 0  # up to here, runs of digits are known to hold no card
        while True:
            if at < no_card:
                m = self.no_card.search(text, at, min(len(text), no_card + BEHIND))
                if m is None or m.start() >= no_card:
                    at = no_card
                    continue
            else:
                m = self.pattern.search(text, at)
                if m is None:
                    break
            end, new = self._put(m, counts, m.start() >= no_card)
            if new is None:
                at = m.start() + 1
                if m.lastgroup == "card":
                    at, no_card = m.start(), m.end()
                continue
            out += [text[done:m.start()], new]
            done = at = end
        return "".join([*out, text[done:]]), counts

    def _put(self, m: re.Match, counts: dict[str, int], cards: bool) -> tuple[int, str | None]:
        """End and pseudonym of the first kind that is valid where a match begins."""
        kinds = list(self.by_kind)
        for kind in kinds[kinds.index(m.lastgroup):]:
            k = m if kind == m.lastgroup else self.each[kind].match(m.string, m.start()) if cards or kind != "card" else None
            new = self.by_kind[kind](self.permuter, k[0]) if k else None
            if new is not None:
                counts[kind] = counts.get(kind, 0) + 1
            elif k and kind == "card":  # a run may hold a number of usual length beside another
                new = self._cards(k[0], counts)
            if new is not None:
                return k.end(), new
        return m.end(), None

    def _cards(self, run: str, counts: dict[str, int]) -> str | None:
        """Numbers within a run of digit groups that as a whole is no valid number: the longest from each group."""
        first, last = card_windows(run)
        out, done = [], 0
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if a >= done:
                out += [run[done:a], _card(self.permuter, run[a:b])]
                done = b
        if not out:
            return None
        counts["card"] = counts.get("card", 0) + len(out) // 2
        return "".join([*out, run[done:]])


def card_windows(run: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest valid card from each group of a run of digit groups, where there is one.

    Check sums of all windows come from two prefix sums, as a digit counts double by its distance from the end."""
    raw = np.frombuffer(run.encode(), np.uint8)
    at = np.flatnonzero((raw >= 48) & (raw <= 57))
    digit = raw[at].astype(np.int64) - 48
    twice = 2 * digit - 9 * (digit > 4)
    odd = np.arange(len(digit)) % 2 == 1
    sums = np.zeros((2, len(digit) + 1), np.int64)
    np.cumsum(np.where(odd, twice, digit), out=sums[0, 1:])
    np.cumsum(np.where(odd, digit, twice), out=sums[1, 1:])
    changes = np.concatenate(([0, 0], np.cumsum(digit[1:] != digit[:-1])))
    begins = np.concatenate(([True], np.diff(at) > 1))
    start = np.flatnonzero(begins)
    ends = np.append(begins[1:], True)  # by the last digit
    best = np.zeros(len(start), np.int64)
    for length in range(13, 20):
        end = start + length
        some = np.flatnonzero(end <= len(digit))
        s, e = start[some], end[some]
        kind = (e - 1) % 2
        valid = ends[e - 1] & ((sums[kind, e] - sums[kind, s]) % 10 == 0) & (changes[e] > changes[s + 1])
        best[some[valid]] = length
    found = best > 0
    return at[start[found]], at[start[found] + best[found] - 1] + 1


def pseudonymize(docs: DataFrame, *, key: bytes, undo: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id, text, n_replaced, kinds)``: whole texts with pseudonyms, one row per input row, without a shuffle.

    Found and validated: e-mail addresses, access keys, IBANs (length and check digits), secrets after a label,
    IPv4 addresses, calendar dates, US social security numbers, phone numbers (North American, others with + and
    country code), payment cards (Luhn; beside other digits, from every group of the run).
    Texts that fail validation stay.  Equal values (cards and phones whatever their separators, dates however they are
    written) have equal pseudonyms under one key in every row; ``undo`` gives the originals back under the same key, so
    whoever has the key can.  ``kinds`` counts
    them as ``kind:n``, sorted and comma-joined.

    A null text stays null (nothing replaced), an empty one empty; repeated rows give equal results; null ids
    stay; other columns are not read.  Every row is worked on alone: memory is bounded by a batch of rows.
    """
    rows = take(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonymizer(key, undo)
        for batch in batches:
            texts, totals, kinds = [], [], []
            for text in batch.column("text").to_pylist():
                new, counts = change(text) if text else (text, {})
                texts.append(new)
                totals.append(sum(counts.values()))
                kinds.append(",".join(f"{k}:{counts[k]}" for k in sorted(counts)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(kinds, pa.string())],
                                             names=["id", "text", "n_replaced", "kinds"])

    return rows.mapInArrow(work, f"id {kind}, text string, n_replaced long, kinds string").withColumnRenamed("id", id_col)


def replace(docs: DataFrame, *, key: bytes, undo: bool = False, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, with pseudonyms in their texts (see ``pseudonymize``)."""
    names = docs.columns
    at = names.index(text_col)
    placed = docs.toDF(*[f"_c{i}" for i in range(len(names))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonymizer(key, undo)
        for batch in batches:
            field = batch.schema.field(at)
            texts = [change(t)[0] if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, field, pa.array(texts, field.type))

    return placed.mapInArrow(work, placed.schema).toDF(*names)
