"""Format-preserving pseudonyms: private values permuted within their format by a keyed Feistel network."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ROUNDS = 8
#: Letters of a local part that one permutation covers; longer parts take several, so that numbers stay small.
PIECE = 64
_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
#: Calling codes of one and of two digits; all others have three.
_ONE, _TWO = {"1", "7"}, set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Characters of an IBAN by country.
_IBAN = dict(
    pair.split(":") for pair in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20".split()
)

_LOCAL = re.compile(r"[\w.+%-]")
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_NUMBERS = re.compile(
    r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.+-])\d{3}-\d{3}-\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d))"
    r"|(?P<card>(?<![\w.+-])(?:\d{4}([ -])\d{4}\6\d{4}\6\d{4}|\d{4}([ -])\d{6}\7\d{5}|\d{13,19})(?!\w|[.-]\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?!\w))",
    re.ASCII,
)


@functools.lru_cache(4096)
def alphabet(c: str) -> tuple[str, int] | None:
    """The small letters or digits that may stand for a character, and its place among them; None for other characters.

    They are of its script and kind, from the same 256 code points.
    """
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd" or c.lower() != c:
        return None

    def name(x: str) -> str:
        return unicodedata.name(x, "").split(" ")[0]

    page = (chr(i) for i in range(ord(c) & ~0xFF, (ord(c) | 0xFF) + 1))
    if c.isascii():
        page = filter(str.isascii, page)
    same = "".join(x for x in page if unicodedata.category(x) == kind and x.lower() == x and name(x) == name(c) and (c.isascii() or not x.isascii()) and _upper(x) == _upper(c))
    return same, same.index(c)


def _upper(c: str) -> bool:
    """Whether a letter has a capital of one character that has it as its small letter."""
    return len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c


@functools.lru_cache(1)
def _calendar() -> tuple[dict[int, tuple[int, int]], list[list[int]]]:
    """Class and place of every date, and the dates by class: days and months of one digit, of two, and days past 12 apart.

    A date's stand-in is of its class, so it can be written just as the date was,
    and read just as it could be: padded or not, day first or month first.
    """
    where, classes = {}, [[] for _ in range(6)]
    for x in range(_FIRST, _LAST + 1):
        d = date.fromordinal(x)
        k = 3 * (d.month > 9) + (d.day > 9) + (d.day > 12)
        where[x] = k, len(classes[k])
        classes[k].append(x)
    return where, classes


def feistel(x: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """Keyed permutation of 0 .. size-1, or its inverse: a Feistel network over two mixed-radix halves, walked until inside."""
    if size < 2:
        return x
    a = int((size - 1) ** 0.5) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            seen = f"{kind}:{size}:{r}:{left if r % 2 else right}".encode()
            f = int.from_bytes(blake2b(seen, key=key, digest_size=16).digest(), "big")
            if back:
                f = -f
            if r % 2:
                right = (right + f) % b
            else:
                left = (left + f) % a
        x = left * b + right
        if x < size:
            return x


def permuted(x: int, size: int, key: bytes, kind: str) -> int:
    """Keyed permutation of 0 .. size-1 that leaves nothing in its place: a step of a keyed length between a permutation and its inverse."""
    if size < 2:
        return x
    step = 1 + int.from_bytes(blake2b(f"{kind}:{size}".encode(), key=key, digest_size=16).digest(), "big") % (size - 1)
    return feistel((feistel(x, size, key, kind, True) + step) % size, size, key, kind)


def luhn(digits: str) -> bool:
    twice = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def _refill(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _card(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    body = f"{permuted(int(digits[:-1]), 10 ** (len(digits) - 1), key, 'card'):0{len(digits) - 1}d}"
    return _refill(value, next(body + c for c in "0123456789" if luhn(body + c)))


def _phone(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 8 <= len(digits) <= 15:
        return None
    if value[0] != "+":  # the formats of North America, without its code
        code, own = "1", digits
    else:
        n = 1 if digits[0] in _ONE else 2 if digits[:2] in _TWO else 3
        code, own = digits[:n], digits[n:]
    new = f"{permuted(int(own), 10 ** len(own), key, f'phone{code}:{len(own)}'):0{len(own)}d}"
    return _refill(value, digits[: len(digits) - len(own)] + new)


def _ssn(value: str, key: bytes) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permuted(x, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(x, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _checked(country: str, body: str) -> int:
    """Check digits of an IBAN."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if _IBAN.get(country) != str(len(plain)) or f"{_checked(country, body):02d}" != check:
        return None
    x, size = 0, 1
    for c in body:
        n = 10 if c.isdigit() else 26
        x, size = x * n + (int(c) if n == 10 else ord(c) - 65), size * n
    form = "".join("9" if c.isdigit() else "A" for c in body)
    x, out = permuted(x, size, key, f"iban{country}{form}"), []
    for c in reversed(form):
        x, r = divmod(x, 10 if c == "9" else 26)
        out.append(str(r) if c == "9" else chr(65 + r))
    body = "".join(reversed(out))
    it = iter(f"{country}{_checked(country, body):02d}{body}")
    return "".join(c if c == " " else next(it) for c in value)


def _ip(value: str, key: bytes) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    spans = [(0, 10) if len(o) == 1 else (10, 90) if len(o) == 2 else (100, 156) for o in octets]
    x, size = 0, 1
    for o, (low, n) in zip(octets, spans):
        x, size = x * n + int(o) - low, size * n
    x, out = permuted(x, size, key, "ip"), []
    for low, n in reversed(spans):
        x, r = divmod(x, n)
        out.append(str(low + r))
    return ".".join(reversed(out))


def _date(value: str, key: bytes) -> str | None:
    parts = re.split(r"[-/.]", value)
    iso = len(parts[0]) == 4
    y, m, d = (int(p) for p in (parts if iso else (parts[2], parts[1], parts[0])))
    swapped = not iso and m > 12 >= d
    if swapped:
        m, d = d, m
    try:
        x = date(y, m, d).toordinal()
    except ValueError:
        return None
    if not _FIRST <= x <= _LAST:
        return None
    where, classes = _calendar()
    k, place = where[x]
    new = date.fromordinal(classes[k][permuted(place, len(classes[k]), key, f"date{k}")])
    numbers = (new.year, new.month, new.day) if iso else (new.month, new.day, new.year) if swapped else (new.day, new.month, new.year)
    sep = value[len(parts[0])]
    return sep.join(f"{n:0{len(p)}d}" for n, p in zip(numbers, parts))


def _email(value: str, key: bytes) -> str | None:
    local, at, domain = value.rpartition("@")
    low = [c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c for c in local]
    places = [i for i, c in enumerate(low) if alphabet(c) is not None]
    out, total = list(local), 1
    for begin in range(0, len(places), PIECE):
        piece = places[begin : begin + PIECE]
        x, size = 0, 1
        for i in piece:
            letters, k = alphabet(low[i])
            x, size = x * len(letters) + k, size * len(letters)
        total *= min(size, 2)
        x = permuted(x, size, key, f"email{begin}:{domain.lower()}")
        for i in reversed(piece):
            letters, _ = alphabet(low[i])
            x, r = divmod(x, len(letters))
            out[i] = letters[r].upper() if low[i] != local[i] else letters[r]
    return "".join(out) + at + domain if total > 1 else None


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the addresses, in time linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


_BY_KIND: dict[str, Callable[[str, bytes], str | None]] = {"card": _card, "phone": _phone, "ssn": _ssn, "iban": _iban, "ip": _ip, "date": _date, "email": _email}


@functools.lru_cache(200_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """Stand-in for a value, or None if it isn't valid as one of its kind."""
    return _BY_KIND[kind](value, key)


def pseudonymise(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with its private values replaced, and what was found: kind, start and end in the given text, replacement."""
    spans = []
    for start, end in emails(text):
        new = pseudonym("email", text[start:end], key)
        if new is not None:
            spans.append((start, end, "email", new))
    taken = list(spans)
    i = 0
    for m in _NUMBERS.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i < len(taken) and taken[i][0] < m.end():
            continue
        new = pseudonym(m.lastgroup, m.group(), key)
        if new is not None:
            spans.append((m.start(), m.end(), m.lastgroup, new))
    if not spans:
        return text, []
    spans.sort()
    out, at = [], 0
    for start, end, _, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [{"kind": k, "start": s, "end": e, "replacement": n} for s, e, k, n in spans]


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per row of `docs`: doc_id, text, n_replaced, found.

    Card numbers (Luhn), phone numbers (8 to 15 digits, with a + and country code
    or as written in North America), social security numbers (of ranges that are
    given out), IBANs (length and check digits), IPv4 addresses (octets up to
    255), dates (of the calendar, 1900 to 2099) and the local parts of e-mail
    addresses are replaced, each by a permutation of its own format under `key`:
    digits stay digits, letters stay letters of their script, separators, country
    codes and widths stay, check digits fit, a date is a date that can be written
    in the same way.  Equal values get equal pseudonyms in all documents, whatever
    their separators, padding or case, and different values of a format different
    ones; none stays as it was.  Numbers that fail their check are left alone and aren't reported, nor are
    addresses whose local part has no letter or digit to permute.

    Defined cases: a null text stays null with nothing found; an empty text
    stays empty; a text of any length is searched whole, in time linear in it,
    and a local part of any length is permuted in pieces of 64 letters; of
    overlapping finds the e-mail address, then the earlier one counts; repeated
    rows give repeated rows; an empty table gives an empty result; doc_id may
    have any type; other columns are not looked at.  Start and end count code
    points of the given text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            maybe = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False)
            out, found = texts.to_pylist(), [[]] * len(texts)
            for i in pc.indices_nonzero(maybe).to_pylist():
                out[i], found[i] = pseudonymise(out[i], key)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(out, pa.string()), pa.array([len(x) for x in found], pa.int32()), pa.array(found, _FOUND)],
                names=["doc_id", "text", "n_replaced", "found"],
            )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, n_replaced int, found array<struct<kind:string,start:int,end:int,replacement:string>>")
