"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

A value that passes its check (Luhn, octet range, calendar, mod 97, ...) is
replaced by another value of the same format: its digits or letters go through
a Feistel network keyed by a secret and tweaked by kind and length, separators
stay where they are.  The map is a permutation of the format, so equal values
stay equal across documents and different values of a kind stay different.
Dates are permuted within the strings of their shape (order of the fields and
digits of each) that are dates; a shape that days and months can both begin is
one domain.  Phone numbers keep their calling code, which is read from the
digits, so that one number in several spellings stays linked.  Domains of
e-mail addresses stay as they are: they name a provider or an organisation.

A card or IBAN is also found beside other short groups (an expiry date, a
check number, an upper-case word).  Undoing is exact unless a pseudonym and
its neighbours happen to pass the check together.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sub_batches

ROUNDS = 10
_DIGITS = "0123456789"
_HEX = "0123456789abcdef"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_YEARS = (1900, 2100)


class Feistel:
    """Keyed permutations of whole numbers below a bound."""

    def __init__(self, key: bytes):
        if not 1 <= len(key) <= 64:
            raise ValueError("the key has 1 to 64 bytes")
        self.key = key

    def _round(self, tweak: bytes, i: int, half: int, modulus: int) -> int:
        size = max(16, (modulus.bit_length() + 7) // 8 + 8)
        text = tweak + bytes([i]) + half.to_bytes((half.bit_length() + 7) // 8, "big")
        block, n = b"", 0
        while len(block) < size:
            block += hashlib.blake2b(text + bytes([n]), key=self.key).digest()
            n += 1
        return int.from_bytes(block[:size], "big") % modulus

    def _once(self, value: int, left: int, right: int, tweak: bytes, back: bool) -> int:
        a, b = divmod(value, right)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * self._round(tweak, i, a, right)) % right
            else:
                a = (a + sign * self._round(tweak, i, b, left)) % left
        return a * right + b

    def permute(self, value: int, bound: int, tweak: bytes, back: bool = False) -> int:
        """The image of ``value`` in [0, bound); ``back`` undoes it.  Values outside are walked over."""
        if bound < 2:
            return value
        left = max(2, int(bound**0.5) if bound < 1 << 52 else 1 << (bound.bit_length() // 2))
        right = -(-bound // left)
        while True:
            value = self._once(value, left, right, tweak, back)
            if value < bound:
                return value

    def digits(self, text: str, alphabet: str, tweak: str, back: bool = False) -> str:
        radix, value = len(alphabet), 0
        for c in text:
            value = value * radix + alphabet.index(c)
        value = self.permute(value, radix ** len(text), f"{tweak}:{len(text)}".encode(), back)
        out = []
        for _ in text:
            value, d = divmod(value, radix)
            out.append(alphabet[d])
        return "".join(reversed(out))


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _card(f: Feistel, text: str, back: bool) -> str | None:
    digits = _only_digits(text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    head = f.digits(digits[:-1], _DIGITS, "card", back)
    return _refill(text, next(head + c for c in _DIGITS if luhn(head + c)))


# Calling codes of one and two digits; all others have three.
CALLING_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
    "90", "91", "92", "93", "94", "95", "98",
)
# End of fixed values.


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    digits = _only_digits(text)
    if not 10 <= len(digits) <= 15:
        return None
    keep = next((n for n in (1, 2) if digits[:n] in CALLING_CODES), 3) if text[0] == "+" else 0
    return _refill(text, digits[:keep] + f.digits(digits[keep:], _DIGITS, "phone", back))


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    value = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    sound = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = _only_digits(text)
    if not sound(digits):
        return None
    while True:  # walk over numbers that are never given out
        digits = f.digits(digits, _DIGITS, "ssn", back)
        if sound(digits):
            return _refill(text, digits)


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    country, account = plain[:2], plain[4:]
    inner = f.digits("".join(c for c in account if c.isdigit()), _DIGITS, "iban" + country, back)
    account = _refill(account, inner)
    new = iter(f"{country}{98 - number(account + country + '00') % 97:02d}{account}")
    return "".join(c if c == " " else next(new) for c in text)


def _is_day(year: int, month: int, day: int) -> bool:
    return 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]


def _date(f: Feistel, text: str, back: bool) -> str | None:
    """Year first: the days themselves are permuted.  Year last: what reads as a date either way, within fields of as many digits."""
    a, b, c = re.split(r"[./-]", text)
    marks = [m for m in text if not m.isdigit()]
    if len(a) == 4:
        if not (_YEARS[0] <= int(a) < _YEARS[1] and _is_day(int(a), int(b), int(c))):
            return None
        first, end = (datetime.date(y, 1, 1).toordinal() for y in _YEARS)
        day = f.permute(datetime.date(int(a), int(b), int(c)).toordinal() - first, end - first, b"date", back)
        return datetime.date.fromordinal(first + day).strftime(f"%Y{marks[0]}%m{marks[1]}%d")
    sound = lambda p, q, y: _is_day(y, q, p) or _is_day(y, p, q)
    if not (_YEARS[0] <= int(c) < _YEARS[1] and sound(int(a), int(b), int(c))):
        return None
    most = [10 if len(x) == 1 else 32 for x in (a, b)]
    value = ((int(c) - _YEARS[0]) * most[0] + int(a)) * most[1] + int(b)
    while True:  # walk over what is no date
        value = f.permute(value, (_YEARS[1] - _YEARS[0]) * most[0] * most[1], f"date {len(a)} {len(b)}".encode(), back)
        rest, q = divmod(value, most[1])
        year, p = divmod(rest, most[0])
        if sound(p, q, _YEARS[0] + year):
            return f"{p:0{len(a)}d}{marks[0]}{q:0{len(b)}d}{marks[1]}{_YEARS[0] + year}"


def _secret(f: Feistel, text: str, back: bool) -> str | None:
    low = text.lower()
    if low.isdigit() or low.isalpha():
        return None
    new = f.digits(low, _HEX, "hex", back)
    return new.upper() if text.isupper() else new


def _email(f: Feistel, text: str, back: bool) -> str | None:
    """Letters and digits of the local part move within their class; other letters are replaced by a keyed choice."""
    local, domain = text.rsplit("@", 1)
    low = local.lower()
    for alphabet, kind in ((_LOWER, "letters"), (_DIGITS, "digits")):
        inner = iter(f.digits("".join(c for c in low if c in alphabet), alphabet, f"mail {kind}", back))
        low = "".join(next(inner) if c in alphabet else c for c in low)
    odd = hashlib.blake2b(local.lower().encode(), key=f.key).digest()
    low = "".join(_LOWER[odd[i % len(odd)] % 26] if c.isalpha() and c not in _LOWER else c for i, c in enumerate(low))
    return (low.upper() if local.isupper() else low) + "@" + domain


#: kind, pattern and pseudonym, in the order in which overlapping finds are preferred.
_KINDS: list[tuple[str, re.Pattern, Callable[[Feistel, str, bool], str | None]]] = [
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"), _secret),
    ("date", re.compile(r"(?<![\d./-])\d{4}([-/.])\d{2}\1\d{2}(?!\d|[./-]\d)"), _date),
    ("date", re.compile(r"(?<![\d./-])\d{1,2}([/.-])\d{1,2}\1\d{4}(?!\d|[./-]\d)"), _date),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"), _ip),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)"), _ssn),
    ("card", re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"), _card),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"), _phone),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]\(?\d{2,7}\)?){2,4}(?!\d)"), _phone),
    ("phone", re.compile(r"(?<![\w+])\+\d{10,15}(?!\d)"), _phone),
    ("phone", re.compile(r"(?<![\w(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"), _phone),
]
#: Where an IBAN may begin, and as many letters and digits behind its first four as one may have.
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?= ?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){1,30}")
_GROUP = re.compile(r"\d+")
_DIGIT_RUN = re.compile(r"\d+(?:[ -]\d+)+")
_LOCAL = re.compile(r"[\w.+%-]{1,64}\Z")
_DOMAIN = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])")
_DIGIT = re.compile(r"\d")


def _ibans(text: str, pattern: re.Pattern, feistel: Feistel, back: bool) -> Iterator[tuple[int, int, str]]:
    """Valid IBANs; where the longest reach of the pattern fails, every end at a border of letters and digits is tried, the longest first."""
    last = 0
    for at in _IBAN_START.finditer(text):
        start = at.start()
        if start < last:
            continue
        whole, rest = pattern.match(text, start), _IBAN_REST.match(text, at.end())
        ends = [e for e in range(rest.end(), at.end(), -1) if text[e - 1] != " " and not (text[e : e + 1].isascii() and text[e : e + 1].isalnum())]
        for end in ([whole.end()] if whole else []) + ends:
            if (new := _iban(feistel, text[start:end], back)) is not None:
                yield start, end, new
                last = end
                break


def _cards_within(text: str, taken: list[tuple[int, int, str, str]], feistel: Feistel, back: bool) -> Iterator[tuple[int, int, str, str]]:
    """Valid cards inside runs of digit groups that are no card as a whole, clear of ``taken``.

    Every start and end at a border of groups is tried, from left to right and
    the longest first.  Groups before the last have three digits at least, so
    that lists of small numbers do not turn into cards.
    """
    starts = [s for s, _, _, _ in taken]
    for run in _DIGIT_RUN.finditer(text):
        if run.end() - run.start() < 14:
            continue
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, run.start(), run.end())]
        i = 0
        while i < len(groups):
            start, ends, held = groups[i][0], [], 0
            at = bisect.bisect_right(starts, start)
            limit = starts[at] if at < len(starts) else len(text)
            if not at or taken[at - 1][1] <= start:
                for k in range(i, len(groups)):
                    a, end = groups[k]
                    held += end - a
                    if held > 19 or end > limit:
                        break
                    if held >= 13:
                        ends.append((end, k))
                    if end - a < 3:
                        break
            i += 1
            for end, k in reversed(ends):
                if (new := _card(feistel, text[start:end], back)) is not None:
                    yield start, end, "card", new
                    i = k + 1
                    break


def find_values(text: str, feistel: Feistel, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of validated values, without overlaps, by place; offsets in code points."""
    found: list[tuple[int, int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        if (m := _DOMAIN.match(text, at)) and (local := _LOCAL.search(text[max(0, at - 64) : at])):
            start = max(0, at - 64) + local.start()
            found.append((-1, start, m.end(), "email", _email(feistel, text[start : m.end()], back)))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for rank, (kind, pattern, swap) in enumerate(_KINDS):
            if kind == "iban":
                found += [(rank, start, end, kind, new) for start, end, new in _ibans(text, pattern, feistel, back)]
                continue
            for m in pattern.finditer(text):
                if (new := swap(feistel, m[0], back)) is not None:
                    found.append((rank, m.start(), m.end(), kind, new))
    taken: list[tuple[int, int, str, str]] = []
    ends: list[int] = []
    starts: list[int] = []
    for _, start, end, kind, new in sorted(found):
        i = bisect.bisect_right(starts, start)
        if (i and ends[i - 1] > start) or (i < len(starts) and starts[i] < end):
            continue
        starts.insert(i, start)
        ends.insert(i, end)
        taken.insert(i, (start, end, kind, new))
    if more := list(_cards_within(text, taken, feistel, back)):
        taken = sorted(taken + more)
    return taken


def pseudonymise_text(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[tuple[int, int, str, str]]]:
    spans = find_values(text, feistel, back)
    if not spans:
        return text, spans
    out, last = [], 0
    for start, end, _, new in spans:
        out += [text[last:start], new]
        last = end
    out.append(text[last:])
    return "".join(out), spans


def pseudonymise(docs: DataFrame, key: bytes, *, text_col: str = "text", count_col: str | None = "n_values", kinds_col: str | None = "kinds") -> DataFrame:
    """All columns of ``docs`` with pseudonyms in ``text_col``; texts without values stay byte for byte.

    ``count_col`` (values replaced) and ``kinds_col`` (map kind -> count) are
    added unless None; a column of ``docs`` with such a name is replaced.  Null
    texts stay null and count 0, repeated rows are treated alike, an empty
    table stays empty; columns with other names pass through untouched.
    """
    extra = [c.lower() for c in (count_col, kinds_col) if c]
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in extra))
    parts = kept.withColumn(text_col, F.struct(F.col(text_col).cast("string").alias("text")))
    feistel = Feistel(key)

    def swapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts["text"]:
                if text is None:
                    rows.append((None, 0, {}))
                    continue
                new, spans = pseudonymise_text(text, feistel)
                kinds: dict[str, int] = {}
                for _, _, kind, _ in spans:
                    kinds[kind] = kinds.get(kind, 0) + 1
                rows.append((new, len(spans), kinds))
            yield pd.DataFrame(rows, columns=["text", "n", "kinds"])

    @F.pandas_udf("text string, n int, kinds map<string,int>")
    def swap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from lean(swapped)(batches)

    done = parts.withColumn(text_col, swap(F.col(text_col)))
    out = [F.col(f"{text_col}.text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in parts.columns]
    if count_col:
        out.append(F.col(f"{text_col}.n").alias(count_col))
    if kinds_col:
        out.append(F.col(f"{text_col}.kinds").alias(kinds_col))
    return done.select(*out)


def pseudonym_spans(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per replaced value: doc_id, start, length, kind, pseudonym (offsets in code points of the source)."""
    feistel = Feistel(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole):
                rows = [(i, s, e - s, k, n) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for s, e, k, n in find_values(t or "", feistel)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("doc_id", "start", "length", "kind", "pseudonym"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, start long, length long, kind string, pseudonym string")
