"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their format's own validation are permuted by a keyed Feistel network within that
format: a card number becomes a card number with a valid check digit, a date a calendar date written the same way,
an address an address. The permutation depends on the key and the kind alone, so equal values get equal pseudonyms in
all documents, different ones different pseudonyms, and the holder of the key can undo it. What is permuted is the
value, not its notation: a date, a phone number, a card, an IBAN or a social-security number is linked to itself however
its parts are separated, ordered or bracketed.

Card numbers and IBANs are looked for within runs of groups: a value begins and ends with a group, as digits inside a
longer unbroken number are no card. Where a pseudonym and a group beside it happen to be valid together, which is
rare, undoing finds that other value.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.common import bounded_batches, worker_state

ROUNDS = 8
#: First and last days of the spans within which dates are permuted: usual dates stay usual ones, all others stay dates.
DAYS = tuple((datetime.date(a, 1, 1).toordinal(), datetime.date(b, 12, 31).toordinal()) for a, b in ((1900, 2099), (1, 1899), (2100, 9999)))
#: Alphabets within which a character stays; fixed values.
DIGITS = "0123456789"
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
ALPHABETS = (DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
#: Letters of an IBAN count from 10.
IBAN_VALUES = {c: str(i) for i, c in enumerate(DIGITS + ALPHABETS[2])}


class Feistel:
    """A keyed permutation of the integers below any n: a balanced network over the next even power of two, walked
    along its cycle until the value is below n."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = max(1, (bits + 7) // 8)
        out, block = b"", 0
        while len(out) < size:
            out += blake2b(half.to_bytes(size, "big"), key=self.key, person=bytes([i, block & 255]) + (block >> 8).to_bytes((block.bit_length() + 7) // 8 - 1 if block else 0, "big"), salt=blake2b(tweak, digest_size=16).digest()).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _once(self, tweak: bytes, x: int, bits: int, back: bool) -> int:
        left, right, mask = x >> bits, x & ((1 << bits) - 1), (1 << bits) - 1
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right ^ self._round(tweak, i, left, bits)) & mask, left
            else:
                left, right = right, (left ^ self._round(tweak, i, right, bits)) & mask
        return left << bits | right

    def permute(self, tweak: str, x: int, n: int, back: bool = False) -> int:
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        y = self._once(tweak.encode(), x, bits, back)
        while y >= n:
            y = self._once(tweak.encode(), y, bits, back)
        return y

    def string(self, tweak: str, text: str, alphabets: list[str], back: bool = False) -> str:
        """A string whose i-th character stays within the i-th alphabet."""
        x, n = 0, 1
        for c, a in zip(text, alphabets, strict=True):
            x, n = x * len(a) + a.index(c), n * len(a)
        x, out = self.permute(tweak, x, n, back), []
        for a in reversed(alphabets):
            x, r = divmod(x, len(a))
            out.append(a[r])
        return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    """The check digit of a card number without it."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _spread(pattern: str, digits: str) -> str:
    """Digits put back where the pattern has digits."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in pattern)


def _card(f: Feistel, m: str, back: bool) -> str | None:
    """Issuer digits and length stay; the account digits are permuted and the check digit follows."""
    d = "".join(c for c in m if c in DIGITS)
    issuer = d[0] == "4" and len(d) in (13, 16, 19) or len(d) == 16 and (51 <= int(d[:2]) <= 55 or 2221 <= int(d[:4]) <= 2720 or d[:4] == "6011" or d[:2] == "65") or len(d) == 15 and d[:2] in ("34", "37")
    if not issuer or luhn_digit(d[:-1]) != d[-1]:
        return None
    keep = 1 if d[0] == "4" else 4 if d[0] in "62" else 2
    body = d[:keep] + f.string(f"card{len(d)}{d[:keep]}", d[keep:-1], [DIGITS] * (len(d) - keep - 1), back)
    return _spread(m, body + luhn_digit(body))


def _phone(f: Feistel, m: str, back: bool) -> str | None:
    """The ten digits, whatever stands between and before them. Numbers of the numbering plan (area and exchange begin
    with 2 to 9) stay ones; others, which a country code or brackets must mark, stay others."""
    d = "".join(c for c in m if c in DIGITS)
    lead, n = len(d) - 10, d[-10:]
    planned = n[0] not in "01" and n[3] not in "01"
    if planned:
        n = f.string("phone", n, [DIGITS[2:] if i in (0, 3) else DIGITS for i in range(10)], back)
    elif lead or m[0] == "(":
        n = f.string("phone-other", n, [DIGITS] * 10, back)
        while n[0] not in "01" and n[3] not in "01":
            n = f.string("phone-other", n, [DIGITS] * 10, back)
    else:
        return None
    return _spread(m, d[:lead] + n)


def _ssn(f: Feistel, m: str, back: bool) -> str | None:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999; with hyphens, or with spaces and no further
    group of digits beside it."""
    mark = m[3]
    area, group, serial = map(int, m.split(mark))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(f.permute("ssn", x, 898 * 99 * 9999, back), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}{mark}{group + 1:02d}{mark}{serial + 1:04d}"


def _ip(f: Feistel, m: str, back: bool) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute("ipv4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(f: Feistel, m: str, back: bool) -> str | None:
    """ISO dates and dates with slashes or dots (day first, else month first), if the calendar has them.

    Days up to the 12th are permuted among themselves, and so are later ones, so that a date that can only be read month
    first stays one and the permutation is the same for all notations."""
    mark = next(c for c in m if c not in DIGITS)
    parts = m.split(mark)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            continue
        number, (first, last) = next((i, span) for i, span in enumerate(DAYS) if span[0] <= day <= span[1])
        x, new, early = day - first, None, int(parts[order[2]]) <= 12
        while new is None or (new.day <= 12) != early:
            x = f.permute(f"date{number}{early}", x, last - first + 1, back)
            new = datetime.date.fromordinal(first + x)
        out = ["", "", ""]
        for i, (at, value) in enumerate(zip(order, (new.year, new.month, new.day), strict=True)):
            out[at] = f"{value:04d}" if i == 0 else f"{value:02d}"
        return mark.join(out)
    return None


def _iban(f: Feistel, m: str, back: bool) -> str | None:
    s = m.replace(" ", "")
    if not 15 <= len(s) <= 34 or not IBAN_FORM.fullmatch(m) or int("".join(IBAN_VALUES[c] for c in s[4:] + s[:4])) % 97 != 1:
        return None
    body = f.string(f"iban{s[:2]}{len(s)}", s[4:], [DIGITS if c in DIGITS else ALPHABETS[2] for c in s[4:]], back)
    check = 98 - int("".join(IBAN_VALUES[c] for c in body + s[:2]) + "00") % 97
    it = iter(s[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(it) for c in m)


def _secret(f: Feistel, m: str, back: bool) -> str | None:
    """Long hexadecimal strings of one case that hold both digits and letters."""
    alphabet = HEX_LOWER if m == m.lower() else HEX_UPPER
    if not (re.search("[0-9]", m) and re.search("[A-Fa-f]", m)) or any(c not in alphabet for c in m):
        return None
    x = f.permute(f"hex{len(m)}{alphabet[-1]}", int(m, 16), 16 ** len(m), back)
    return f"{x:0{len(m)}x}" if alphabet == HEX_LOWER else f"{x:0{len(m)}X}"


def _international(f: Feistel, m: str, back: bool) -> str | None:
    """A number of 8 to 15 digits after a plus sign; its country code stays."""
    d = "".join(c for c in m if c in DIGITS)
    keep = 1 if d[0] in "17" else 2 if d[:2] in COUNTRIES_OF_TWO else 3
    if not 8 <= len(d) <= 15 or d[0] == "0":
        return None
    return "+" + _spread(m[1:], d[:keep] + f.string(f"phone+{d[:keep]}", d[keep:], [DIGITS] * (len(d) - keep), back))


def _token(f: Feistel, m: str, back: bool) -> str | None:
    """An access key, web token or private key: its published lead (and a private key's last line) stays, every other
    character stays within its kind."""
    lead = TOKEN_LEAD.match(m).end()
    m, rest = (m[: m.rindex("-----END")], m[m.rindex("-----END") :]) if m.startswith("-----") else (m, "")
    at = [next((a for a in ALPHABETS[:3] if c in a), "") for c in m[lead:]]
    inside = [(c, a) for c, a in zip(m[lead:], at, strict=True) if a]
    form = "".join(str(ALPHABETS.index(a)) if a else c for c, a in zip(m[lead:], at, strict=True))
    # in lines of bounded length, each tied to its place, as a key may be long
    kept = "".join(f.string(f"token{m[:lead]}{form}{i or ''}", "".join(c for c, _ in part), [a for _, a in part], back) for i in range(0, len(inside), LINE) if (part := inside[i : i + LINE]))
    it = iter(kept)
    return m[:lead] + "".join(next(it) if a else c for c, a in zip(m[lead:], at, strict=True)) + rest


def _email(f: Feistel, m: str, back: bool) -> str | None:
    """The part before the sign, by the kind of each character; the domain stays."""
    name, _, domain = m.rpartition("@")
    at = [next((a for a in ALPHABETS if c in a), "") for c in name]
    inside = [(c, a) for c, a in zip(name, at, strict=True) if a]
    if not inside:
        return None
    form = "".join(str(ALPHABETS.index(a)) if a else c for c, a in zip(name, at, strict=True))
    it = iter(f.string(f"mail{form}@{domain}", "".join(c for c, _ in inside), [a for _, a in inside], back))
    return "".join(next(it) if a else c for c, a in zip(name, at, strict=True)) + "@" + domain


#: Published prefixes of access keys; fixed values.
TOKEN_LEAD = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|sk-|AIza|eyJ|-----BEGIN [A-Z ]*PRIVATE KEY-----")
#: Characters of an access key that are permuted together.
LINE = 512
#: Country codes of two digits; 1 and 7 have one, all others three. Fixed values.
COUNTRIES_OF_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
IBAN_FORM = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
#: Kind, pattern, what may not stand before it, and the permutation. Earlier kinds win where they overlap.
KINDS: tuple[tuple[str, re.Pattern, re.Pattern, Callable], ...] = (
    ("secret", re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"), re.compile(r"[0-9A-Za-z]"), _secret),
    ("token", re.compile(r"(?:-----BEGIN (?P<form>[A-Z ]{0,40})PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]+?-----END (?P=form)PRIVATE KEY-----|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|sk-[A-Za-z0-9_-]{32,}+|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])"), re.compile(r"[0-9A-Za-z_-]"), _token),
    ("iban", re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9])*"), re.compile(r"[A-Za-z0-9]"), _iban),
    ("phone", re.compile(r"(?:(?:\+1[ .-]?\(\d{3}\)|\+1[ .-]\d{3}|\(\d{3}\))[ .-]?\d{3}[ .-]\d{4}|\+1\d{10}|(?<![\d.-])\d{3}([ .-])\d{3}\1\d{4}(?!-\d))(?!\d)"), re.compile(r"\d"), _phone),
    ("international", re.compile(r"\+[1-9]\d{0,2}(?:[ .-]?\(0?\d{1,4}\)|[ .-]?\d{1,4}){2,6}(?!\d)"), re.compile(r"[\d+]"), _international),
    ("card", re.compile(r"\d(?:[ -]?\d){12,}"), re.compile(r"[\d.]"), _card),
    ("ssn", re.compile(r"(?:\d{3}-\d{2}-\d{4}|(?<!\d )\d{3} \d{2} \d{4}(?! ?\d))(?![\d-])"), re.compile(r"[\d-]"), _ssn),
    ("date", re.compile(r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d])"), re.compile(r"[\d./-]"), _date),
    ("ip", re.compile(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"), re.compile(r"[\d.]"), _ip),
)
#: Kinds whose pattern takes a run of groups, among which the value may have neighbours: a group, how the first one
#: begins, least and most characters.
GROUPED = {
    "iban": (re.compile(r"[A-Z0-9]+"), re.compile(r"[A-Z]{2}\d{2}"), 15, 34),
    "card": (re.compile(r"\d+"), re.compile(r"[2-6]"), 13, 19),
}
WORD = re.compile(r"[A-Za-z0-9]")
EMAIL = re.compile(r"(?<![\w.+%-])([\w.+%-]++)@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
ANY = re.compile(r"[\d@]|[0-9A-Fa-f]{32}|eyJ|PRIVATE KEY-|AIza|AKIA|ASIA|gh[pousr]_|_pat_|glpat-|xox[abprs]-|sk[_-]")


def spans(text: str | None, f: Feistel, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of what is replaced in a text, in order and without overlaps."""
    if not text or not ANY.search(text):
        return []
    found: list[tuple[int, int, str, str]] = []  # in order; they never overlap

    def put(a: int, b: int, kind: str, new: str | None) -> bool:
        if new is None:
            return False
        i = bisect_left(found, (a,))
        if i and found[i - 1][1] > a or i < len(found) and found[i][0] < b:
            return False
        found.insert(i, (a, b, kind, new))
        return True

    def search(run: re.Match, kind: str, before: re.Pattern, change: Callable) -> None:
        """The values in a run: from each group on the longest that is valid, then on from the group after it."""
        group, first, least, most = GROUPED[kind]
        groups = [g.span() for g in group.finditer(text, *run.span())]
        if kind == "iban" and WORD.match(text, run.end()):
            groups.pop()
        i = 0
        while i < len(groups):
            a, size, ends, begin = groups[i][0], 0, [], i
            i += 1
            if not first.match(text, a) or a and before.match(text[a - 1]):
                continue
            for j in range(begin, len(groups)):
                size += groups[j][1] - groups[j][0]
                if size > most:
                    break
                if size >= least:
                    ends.append(j)
            for j in reversed(ends):
                b = groups[j][1]
                if put(a, b, kind, change(f, text[a:b], back)):
                    i = j + 1
                    break

    if "@" in text:
        for m in EMAIL.finditer(text):
            a = m.end(1) - len(m[1].lstrip(".-%"))
            if a < m.end(1):
                put(a, m.end(), "email", _email(f, text[a : m.end()], back))
    for kind, pattern, before, change in KINDS:
        for m in pattern.finditer(text):
            if kind in GROUPED:
                search(m, kind, before, change)
            elif not (m.start() and before.match(text[m.start() - 1])):
                put(m.start(), m.end(), kind, change(f, m[0], back))
    return found


def replace(text: str | None, f: Feistel, back: bool = False) -> tuple[str | None, int]:
    """The text with its personal data replaced, and how many values were."""
    held = spans(text, f, back)
    if not held:
        return text, 0
    out, at = [], 0
    for a, b, _, new in held:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), len(held)


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Every row with its text's personal data replaced, and ``n_replaced``.

    Columns: ``keep`` (by default the id, under any names), the text under its own name, and ``n_replaced`` behind
    ``prefix``. Null texts stay null, empty ones empty, both with 0; repeated rows stay and get the same pseudonyms; an
    empty table gives no rows. Texts and the values in them may have any length. Nothing is shuffled; the key is a
    parameter and is never written out.
    """
    bounded_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = worker_state(("pseudonyms", key), lambda: Feistel(key))
        for batch in batches:
            done = [replace(x.as_py(), f) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=out.names)

    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField(text_col, T.StringType()), T.StructField(f"{prefix}n_replaced", T.LongType())])
    return docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("__text")).mapInArrow(run, out)
