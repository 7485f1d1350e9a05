"""Personal data replaced by format-preserving pseudonyms from a keyed Feistel network.

Found values are validated (card check sums, IBAN check digits, octets, calendar
dates, number ranges) and then permuted within their own format: digits stay digits,
letters stay letters of the same case, separators stay, a card keeps a right check
digit and a date stays a date. A permutation has no collisions and depends on the key,
the kind and the value alone, so equal values get equal pseudonyms in all documents
and tasks without a shared table, and whoever has the key can undo it.

A value is a number in a mixed radix; eight Feistel rounds with keyed BLAKE2 permute
the next power of four, and values that leave the domain are permuted again (cycle
walking) until they are inside.

Numbers that stand side by side are told apart by their forms: a value that fails as
one span is tried with shorter ends at group borders and as the remaining kinds, and
the search goes on at the next group. Values of a usual form (a card in one run or in
fours, 3-2-4 and 3-3-4 digits) are taken in all of the text before other forms.

Edges: a null text stays null and an empty one empty; equal rows change alike; text
without validated values comes back unchanged. Only ASCII digits make a value: numbers in
other scripts are left as they are. E-mail names, keys and hex strings may be of any
length; long ones are permuted piece by piece, each piece keyed by those before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = b"replace this key in production"
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
#: Longer values are permuted piece by piece, each keyed by the pieces before it.
PIECE = 128
FOUND = "doc_id long, text string, n_found long, found array<struct<kind:string,start:long,end:long>>"

START, END = r"(?<![\w.@])", r"(?!\w|[.-][0-9])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
CARD_END = re.compile(r"(?<=[0-9])(?!\w|\.[0-9])")
USUAL = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")
FOURS = re.compile(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?(?![0-9])")
#: Kinds in the order in which they are tried at a place: values of a usual form first, in all of the text, then others.
USUAL_KINDS = [
    ("ip", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + END),
    ("ymd", r"[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}" + END),
    ("dmy", r"[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4}" + END),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + END),
    ("card", CARD),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + END),
    ("phone", r"(?:\+|00)[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})[ .-]?(?:[0-9]{5,8}|[0-9]{3,4}[ .-][0-9]{3,4})" + END),
    ("phone", r"\+[0-9]{8,15}" + END),
]
OTHER_KINDS = [
    ("card", CARD),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}" + END),
]
NUMBERS = [
    (usual, re.compile(START + "(?:" + "|".join(p for _, p in kinds) + ")"), [(k, re.compile(p)) for k, p in kinds])
    for usual, kinds in ((True, USUAL_KINDS), (False, OTHER_KINDS))
]
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
IBAN_END = re.compile(r"(?<=[A-Z0-9])\b")
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22,
    "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}
SECRET = re.compile(
    r"\b(?:AKIA[0-9A-Z]{16}|(?:gh[pousr]_|sk-|pk-|xox[abp]-)[A-Za-z0-9-]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})\b"
)
HEX = re.compile(r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{32,}\b")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def _stream(data: bytes, key: bytes, width: int) -> bytes:
    """``width`` bytes that depend on the key and all of the data."""
    if width <= 64:
        return hashlib.blake2b(data, key=key, digest_size=width).digest()
    return hashlib.shake_256(hashlib.blake2b(data, key=key).digest()).digest(width)


def permute(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1, or its inverse."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for n in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            source = left if back else right
            data = b"%d|%d|" % (n, size) + kind.encode() + source.to_bytes(width, "little")
            f = int.from_bytes(_stream(data, key, max(8, width)), "little") & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        value = left << half | right
        if value < size:
            return value


def _symbols(text: str) -> list[tuple[str, int]]:
    """Each letter or digit of the text as its range's first character and size."""
    return [("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) for c in text if c.isascii() and c.isalnum()]


def permute_text(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """All ASCII letters and digits permuted within their kinds and places."""
    plain = _plain(text)
    if len(plain) > PIECE:
        return _put(text, _pieces(plain, key, kind, back, permute_text))
    symbols = _symbols(text)
    value, size = 0, 1
    for c, (base, n) in zip((c for c in text if c.isascii() and c.isalnum()), symbols, strict=True):
        value, size = value * n + ord(c) - ord(base), size * n
    value = permute(value, size, key, kind, back)
    out = []
    for base, n in reversed(symbols):
        value, digit = divmod(value, n)
        out.append(chr(ord(base) + digit))
    return _put(text, "".join(reversed(out)))


def _pieces(plain: str, key: bytes, kind: str, back: bool, run: Callable[..., str]) -> str:
    """A long value piece by piece; the secret form of the pieces before tells equal pieces apart."""
    before, out = b"", []
    for at in range(0, len(plain), PIECE):
        piece = plain[at : at + PIECE]
        new = run(piece, key, kind + before.hex(), back)
        out.append(new)
        before = hashlib.blake2b(before + (piece if back else new).encode(), key=key, digest_size=16).digest()
    return "".join(out)


def _put(text: str, plain: str) -> str:
    """``plain`` with the separators of ``text``."""
    given = iter(plain)
    return "".join(next(given) if c.isascii() and c.isalnum() else c for c in text)


def _plain(text: str) -> str:
    return re.sub(r"[^0-9A-Za-z]", "", text)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _card(text: str, key: bytes) -> str | None:
    plain = _plain(text)
    if luhn_digit(plain[:-1]) != plain[-1] or not plain.strip("0"):
        return None
    payload = permute_text(plain[:-1], key, "card")
    return _put(text, payload + luhn_digit(payload))


def _iban_digits(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _iban(text: str, key: bytes) -> str | None:
    plain = _plain(text)
    if not 15 <= len(plain) <= 34 or _iban_digits(plain[:2], plain[4:]) != plain[2:4]:
        return None
    account = permute_text(plain[4:], key, "iban")
    return _put(text, plain[:2] + _iban_digits(plain[:2], account) + account)


def _ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = permute(int.from_bytes(bytes(octets)), 1 << 32, key, "ip")
    return ".".join(str(x) for x in value.to_bytes(4))


def _date(text: str, key: bytes) -> str | None:
    parts = re.split(r"[-/.]", text)
    year_first = len(parts[0]) == 4
    year, month, day = (int(x) for x in (parts if year_first else parts[::-1]))
    swapped = month > 12 and not year_first
    month, day = (day, month) if swapped else (month, day)
    try:
        at = date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= at <= LAST_DAY:
        return None
    new = date.fromordinal(permute(at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date") + FIRST_DAY)
    mark = text[len(parts[0])]
    middle, last = (new.day, new.month) if swapped else (new.month, new.day)
    wide = max(len(parts[1]), len(parts[2] if year_first else parts[0]))
    shown = [f"{new.year:04d}", f"{middle:0{wide}d}", f"{last:0{wide}d}"]
    return mark.join(shown if year_first else shown[::-1])


def _ssn(text: str, key: bytes) -> str | None:
    def valid(plain: str) -> bool:
        return plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000"

    plain = _plain(text)
    if not valid(plain):
        return None
    plain = permute_text(plain, key, "ssn")
    while not valid(plain):
        plain = permute_text(plain, key, "ssn")
    return _put(text, plain)


def _phone(text: str, key: bytes) -> str | None:
    plain = _plain(text)
    if not 8 <= len(plain) <= 15 or ("+" not in text and len(plain) < 10):
        return None
    code = re.match(r"(?:\+|00)\d{1,3}(?=[ .(-])", text)
    keep = code.end() if code else 0
    return text[:keep] + permute_text(text[keep:], key, "phone")


def _email(text: str, key: bytes) -> str | None:
    body, _, top = text.rpartition(".")
    return f"{permute_text(body, key, 'email')}.{top}"


def _key(text: str, key: bytes) -> str | None:
    mark = re.match(r"AKIA|gh[pousr]_|sk-|pk-|xox[abp]-|eyJ", text)
    keep = mark.end() if mark else 0
    return text[:keep] + permute_text(text[keep:], key, "key")


def _permute_hex(text: str, key: bytes, kind: str, back: bool = False) -> str:
    return f"{permute(int(text, 16), 1 << (4 * len(text)), key, kind, back):0{len(text)}x}"


def _hex(text: str, key: bytes) -> str | None:
    return _permute_hex(text, key, "hex") if len(text) <= PIECE else _pieces(text, key, "hex", False, _permute_hex)


KINDS: dict[str, Callable[[str, bytes], str | None]] = {
    "ip": _ip, "ymd": _date, "dmy": _date, "card": _card, "ssn": _ssn, "phone": _phone, "iban": _iban, "key": _key,
    "hex": _hex, "email": _email,
}


@lru_cache(100_000)
def _remembered(kind: str, text: str, key: bytes) -> str | None:
    return KINDS[kind](text, key)


def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None if it does not hold up as one of its kind."""
    return _remembered(kind, text, key) if len(text) <= PIECE else KINDS[kind](text, key)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        begin = at
        if at and text[at - 1] in NAME and text[at - 1] not in ".%+-":
            while begin and text[begin - 1] in NAME:
                begin -= 1
            while begin < at and not text[begin].isalnum():
                begin += 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        at = text.find("@", at + 1)


def _ibans(text: str, key: bytes) -> Iterator[tuple[int, int]]:
    """Spans that hold up as IBAN, ended at any border: the country's length first, then the longest."""
    m = IBAN.search(text)
    while m:
        a = m.start()
        ends = [e.start() for e in IBAN_END.finditer(text, a + 15, m.end())]
        ends.sort(key=lambda b: (len(_plain(text[a:b])) != IBAN_LENGTHS.get(text[a : a + 2]), -b))
        end = next((b for b in ends if pseudonym("iban", text[a:b], key) is not None), None)
        if end:
            yield a, end
        m = IBAN.search(text, end or a + 1)


def _card_ends(text: str, a: int, most: int, usual: bool) -> list[int]:
    """Group borders at which a card from ``a`` may end; usual forms from the shortest, others from the longest."""
    ends = [e.start() for e in CARD_END.finditer(text, a + 13, most) if len(_plain(text[a : e.start()])) >= 13]
    ends = [b for b in ends if bool(USUAL.fullmatch(text, a, b)) == usual]
    return ends if usual else ends[::-1]


def _numbers(text: str, lo: int, hi: int, key: bytes, usual: bool, anywhere: re.Pattern, kinds: list) -> Iterator[tuple[int, int, str]]:
    """Validated spans from left to right; where nothing holds up, the search goes on at the next group."""
    barred = lo
    m = anywhere.search(text, lo, hi)
    while m:
        a, end = m.start(), None
        if not usual and (fours := FOURS.match(text, a, hi)):
            barred = max(barred, fours.end())  # groups of a card that fails its check sum are no phone
        for kind, pattern in kinds:
            one = pattern.match(text, a, hi)
            if not one or (kind == "phone" and a < barred):
                continue
            # a card's longest span may end inside a group; the borders lie at or before its end
            ends = _card_ends(text, a, one.end(), usual) if kind == "card" else [one.end()]
            end = next((b for b in ends if pseudonym(kind, text[a:b], key) is not None and _closed(text, b, hi)), None)
            if end:
                yield a, end, kind
                break
        m = anywhere.search(text, end or a + 1, hi)


def _closed(text: str, b: int, hi: int) -> bool:
    """Whether a number that ends here is not cut off inside a longer one."""
    return b >= hi or not re.match(r"\w|\.\d", text[b : b + 2])


def replace(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and the kinds and places of what was found in it."""
    spans = [(a, b, "email") for a, b in _emails(text)] + [(a, b, "iban") for a, b in _ibans(text, key)]
    for kind, pattern in (("key", SECRET), ("hex", HEX)):
        spans += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    chosen, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at and pseudonym(kind, text[a:b], key) is not None:
            chosen.append((a, b, kind))
            at = b
    for usual, anywhere, kinds in NUMBERS:
        edges = [0, *(x for a, b, _ in chosen for x in (a, b)), len(text)]
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            chosen += _numbers(text, lo, hi, key, usual, anywhere, kinds)
        chosen.sort()
    out, found, at = [], [], 0
    for a, b, kind in chosen:
        out += [text[at:a], pseudonym(kind, text[a:b], key)]
        found.append({"kind": "date" if kind in ("ymd", "dmy") else kind, "start": a, "end": b})
        at = b
    return "".join([*out, text[at:]]) if found else text, found


def _replace(key: bytes):
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for text in batch["text"].to_pylist():
                new, places = replace(text, key) if text else (text, [])
                texts.append(new)
                found.append(places)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "text": pa.array(texts, pa.string()),
                    "n_found": pa.array([len(x) for x in found], pa.int64()),
                    "found": pa.array(found, spans),
                }
            )

    return run


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, the text with pseudonyms, and what was found at which characters of the old text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_replace(key), FOUND)
