"""Personal data: validated numbers and dates become keyed, format-preserving Feistel pseudonyms."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from datetime import date
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map

ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Days from 1900 to 2099: up to the twelfth of a month, which can also be read as a month, and later ones.
_EARLY, _LATE = ([n for n in range(date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal()) if (date.fromordinal(n).day <= 12) == early] for early in (True, False))


class Cipher:
    """A keyed permutation of 0..size-1 for any size: Feistel rounds over two parts, one added to by a hash of the other."""

    def __init__(self, key: bytes):
        self.key = key

    def _add(self, kind: str, k: int, x: int, size: int) -> int:
        raw = x.to_bytes((x.bit_length() + 7) // 8 or 1, "little")
        width = min(64, (size.bit_length() + 7) // 8 + 8)
        return int.from_bytes(blake2b(f"{kind}|{size}|{k}|".encode() + raw, key=self.key, digest_size=width).digest(), "little") % size

    def permute(self, kind: str, x: int, size: int, back: bool = False) -> int:
        """The same for equal (kind, x, size); ``back`` undoes it."""
        low = 1 << (size.bit_length() // 2)
        high = -(-size // low)
        while True:  # a result outside the size is permuted on, which keeps it a permutation
            a, b = divmod(x, low)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if k % 2:
                    a = (a + sign * self._add(kind, k, b, high)) % high
                else:
                    b = (b + sign * self._add(kind, k, a, low)) % low
            x = a * low + b
            if x < size:
                return x

    def mixed(self, kind: str, values: list[int], sizes: list[int], back: bool = False) -> list[int]:
        """A permutation of mixed-radix numbers."""
        x, size = 0, 1
        for v, n in zip(values, sizes, strict=True):
            x, size = x * n + v, size * n
        x = self.permute(kind, x, size, back)
        out = []
        for n in reversed(sizes):
            x, v = divmod(x, n)
            out.append(v)
        return out[::-1]

    def characters(self, kind: str, text: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER), back: bool = False) -> str:
        """Each character of an alphabet becomes one of the same alphabet; others stay."""
        own = [next((a for a in alphabets if c in a), "") for c in text]
        found = [(a.index(c), len(a)) for c, a in zip(text, own, strict=True) if a]
        new = iter(self.mixed(kind, [v for v, _ in found], [n for _, n in found], back)) if found else iter(())
        return "".join(a[next(new)] if a else c for c, a in zip(text, own, strict=True))


def luhn(digits: str) -> int:
    """The check digit for what stands before it."""
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def _refill(text: str, characters: str) -> str:
    """Puts new letters and digits where the old ones stood; separators stay."""
    new = iter(characters)
    return "".join(next(new) if c.isalnum() else c for c in text)


def _card(text: str, cipher: Cipher, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + cipher.characters("card", digits[1:-1], back=back)
    return _refill(text, body + str(luhn(body)))


def _iban(text: str, cipher: Cipher, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != int(plain[2:4]):
        return None
    account = cipher.characters("iban" + plain[:2], plain[4:], back=back)
    return _refill(text, f"{plain[:2]}{iban_check(plain[:2], account):02d}{account}")


def _ip(text: str, cipher: Cipher, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(map(str, cipher.mixed("ip", [int(p) for p in parts], [256] * 4, back)))


def _ssn(text: str, cipher: Cipher, back: bool) -> str | None:
    area, group, serial = (int(text[a:b]) for a, b in ((0, 3), (4, 6), (7, 11)))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    area, group, serial = cipher.mixed("ssn", [area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], back)
    return f"{area + 1 + (area >= 665):03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"


def _phone(text: str, cipher: Cipher, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    head = "1" if len(digits) == 11 and digits[0] == "1" else ""
    local = digits[len(head) :]
    if digits == text:  # a bare number may be anything
        return None
    if digits[0] == "0" and text[0] == "0" and 9 <= len(digits) <= 12 and digits[1] != "0":  # a national number behind its trunk prefix
        return _refill(text, digits[:2] + cipher.characters("phone" + digits[:2], digits[2:], back=back))
    if len(local) == 10 and local[0] in "23456789" and local[3] in "23456789" and (head or text[0] != "+"):
        sizes = [8, 10, 10, 8, 10, 10, 10, 10, 10, 10]
        new = cipher.mixed("phone", [int(c) - 2 * (n == 8) for c, n in zip(local, sizes, strict=True)], sizes, back)
        return _refill(text, head + "".join(str(v + 2 * (n == 8)) for v, n in zip(new, sizes, strict=True)))
    if text[0] == "+" and 8 <= len(digits) <= 15 and digits[0] != "0":
        return _refill(text, digits[:2] + cipher.characters("phone" + digits[:2], digits[2:], back=back))
    return None


def _date(text: str, cipher: Cipher, back: bool) -> str | None:
    parts = re.split(r"\D", text)
    order = "ymd" if len(parts[0]) == 4 else "mdy" if "/" in text and int(parts[0]) <= 12 else "dmy"
    at = {c: k for k, c in enumerate(order)}
    try:
        old = date(int(parts[at["y"]]), int(parts[at["m"]]), int(parts[at["d"]]))
    except ValueError:
        return None
    if not 1900 <= old.year < 2100:
        return None
    days = _EARLY if old.day <= 12 else _LATE  # in any style a date becomes the same one, which reads the same way
    new = date.fromordinal(days[cipher.permute("date", bisect_left(days, old.toordinal()), len(days), back)])
    width = {"y": 4, "m": 2, "d": 2} if all(len(p) > 1 for p in parts) else {"y": 4, "m": 1, "d": 1}
    value = {"y": new.year, "m": new.month, "d": new.day}
    marks = re.findall(r"\D", text)
    out = [f"{value[c]:0{width[c]}d}" for c in order]
    return out[0] + marks[0] + out[1] + marks[1] + out[2]


def _key_id(text: str, cipher: Cipher, back: bool) -> str | None:
    return text[:4] + cipher.characters("key", text[4:], (DIGITS, UPPER), back)


def _email(text: str, cipher: Cipher, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    host, dot, top = domain.rpartition(".")
    return cipher.characters("mail", f"{local}@{host}", back=back) + dot + top


#: Kinds in the order of precedence where matches begin at one place: pattern, and what validates and replaces a match.
KINDS: dict[str, tuple[str, Callable[[str, Cipher, bool], str | None]]] = {
    "email": (r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w])", _email),
    "access_key": (r"\bA[KS]IA[0-9A-Z]{16}\b", _key_id),
    "iban": (r"\b[A-Z]{2}\d{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)\b", _iban),
    "ip": (r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", _ip),
    "date": (r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?=T\d)|\d{4}/\d{2}/\d{2}(?=T\d)|(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?!\w|[./-]\d))", _date),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)", _ssn),
    "card": (r"(?<![\w-])\d(?:[ -]?\d){12,18}(?!\w|-\d)", _card),
    "phone": (r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w|[-.]\d)", _phone),
}
_PATTERNS = [(kind, re.compile(pattern), replace) for kind, (pattern, replace) in KINDS.items()]


#: Kinds with a check digit whose groups stand between spaces, so that a match may hold a neighbour's groups too.
GROUPED = ("iban", "card")


class Spans:
    """Spans that don't overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans.sort()
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def meet(self, lo: int, hi: int) -> bool:
        """Whether one of them overlaps lo to hi."""
        k = bisect_right(self.ends, lo)
        return k < len(self.starts) and self.starts[k] < hi


def _grouped(text: str, pattern: re.Pattern, replace: Callable, taken: Spans, cipher: Cipher, back: bool) -> list[tuple[int, int, str]]:
    """(start, end, new) of the valid values: of a match the longest valid run of groups, else on from its next group.

    A new value is permuted on while it would make a longer run valid that wasn't, so that ``back`` finds the same runs.
    """
    found, failed, at = [], [], 0
    while m := pattern.search(text, at):
        lo, hit = m.start(), None
        failed = [f for f in failed if f[1] > lo]
        for hi in [m.end(), *(lo + k for k in range(len(m[0]) - 1, 0, -1) if m[0][k] == " ")]:
            if taken.meet(lo, hi) or (hi < m.end() and not pattern.fullmatch(text, lo, hi)):
                continue
            if (new := replace(text[lo:hi], cipher, back)) is not None:
                near = [(a, b) for a, b in failed if a < hi and lo < b]
                while any(replace(text[a:lo] + new[max(a - lo, 0) : b - lo] + text[hi:b], cipher, back) is not None for a, b in near):
                    new = replace(new, cipher, back)
                hit = (lo, hi, new)
                break
            failed.append((lo, hi))
        if hit:
            found.append(hit)
            at = hit[1]
        else:
            at = lo + m[0].index(" ") + 1 if " " in m[0] else m.end()
    return found


def pseudonymise(text: str, cipher: Cipher, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind; ``back`` undoes it."""
    found: list[tuple[int, int, str, str]] = []
    taken = Spans([])
    for kind, pattern, replace in _PATTERNS:
        if kind == "email" and "@" not in text or kind == "access_key" and "IA" not in text:
            continue
        if kind in GROUPED:
            found += [(a, b, kind, new) for a, b, new in _grouped(text, pattern, replace, taken, cipher, back)]
        else:
            for m in pattern.finditer(text):
                if taken.meet(m.start(), m.end()):
                    continue
                if (new := replace(m[0], cipher, back)) is not None:
                    found.append((m.start(), m.end(), kind, new))
        taken = Spans([(a, b) for a, b, _, _ in found])
    found.sort()
    out, at, counts = [], 0, {}
    for lo, hi, kind, new in found:
        out += [text[at:lo], new]
        at = hi
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[at:]]), counts


_MAYBE = re.compile(r"[0-9@]|A[KS]IA")


def pseudonymise_documents(docs: DataFrame, secret: bytes, back: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text, n_values, kinds (sorted names).  No shuffle; whole texts.

    Cards (Luhn), IBANs (mod 97), social security numbers, telephone numbers, IPv4 addresses, calendar dates from 1900 to
    2099, e-mail addresses and access key ids become others of the same form, which are valid again.  Separators, a
    card's first digit, country codes, top-level domains and the date style stay, as does whether a day lies within the
    first twelve of its month.  A telephone number has a plus sign, a trunk zero or ten digits of the American form, and
    some separator or plus sign: digits alone aren't taken for one.  Equal values give equal pseudonyms in
    all documents, however they are spaced; the key alone undoes them (``back``).  A null text stays null.
    """
    if not 1 <= len(secret) <= 64:
        raise ValueError("the key has 1 to 64 bytes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(secret)
        for batch in batches:
            texts, n, kinds = [], [], []
            for t in batch.column(1).to_pylist():
                new, counts = pseudonymise(t, cipher, back) if t and _MAYBE.search(t) else (t, {})
                texts.append(new)
                n.append(sum(counts.values()))
                kinds.append(sorted(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "text", "n_values", "kinds"])

    return arrow_map(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), work, f"doc_id {docs.schema[key].dataType.simpleString()}, text string, n_values int, kinds array<string>")
