"""Personal data replaced by format-preserving pseudonyms.

What matches a pattern and passes its check (Luhn, mod 97, calendar, numbering plans, octets) becomes an
integer within its format, is permuted there by a keyed Feistel network, and is written back in the place's own
punctuation. Equal values get equal pseudonyms in all documents and in all forms of writing them, a pseudonym passes the
same check, and who has the key can invert it.
"""

from __future__ import annotations

import hmac
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A permutation of 0..size-1: a Feistel network over enough bits, walked until it lands inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mix(r: int, x: int) -> int:
        if half > 256:
            seed = hmac.digest(key, f"{tweak}|{size}|{r}|{x}".encode(), "sha256")
            return int.from_bytes(b"".join(hmac.digest(seed, k.to_bytes(4, "big"), "sha256") for k in range(half // 256 + 1)), "big") & mask
        return int.from_bytes(hmac.digest(key, f"{tweak}|{size}|{r}|{x}".encode(), "sha256"), "big") & mask

    while True:
        a, b = value >> half, value & mask
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            a, b = (b ^ mix(r, a), a) if back else (b, a ^ mix(r, b))
        value = a << half | b
        if value < size:
            return value


def until(ok, value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """permute(), walked on until ok: a permutation of the values that are ok."""
    while True:
        value = permute(value, size, key, tweak, back)
        if ok(value):
            return value


# The alphabets within which characters of free forms are permuted.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}


def free_form(text: str, key: bytes, tweak: str, back: bool = False, alphabets: dict[str, str] = ALPHABET_OF) -> str:
    """Each letter and digit becomes another of its alphabet, all together one permutation; the rest stays."""
    at = [k for k, c in enumerate(text) if c in alphabets]
    size, value = 1, 0
    for k in at:
        a = alphabets[text[k]]
        size, value = size * len(a), value * len(a) + a.index(text[k])
    if size == 1:
        return text
    value, out = permute(value, size, key, tweak + "".join("x" if c in alphabets else c for c in text), back), list(text)
    for k in reversed(at):
        a = alphabets[text[k]]
        value, digit = divmod(value, len(a))
        out[k] = a[digit]
    return "".join(out)


def refill(shape: str, digits: str) -> str:
    """The digits of shape replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Check digit that makes digits + it valid."""
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


# First digits of card numbers by network, and how long its numbers are.
NETWORKS = ((("4",), (13, 16, 19)), (tuple(map(str, range(51, 56))), (16,)), (tuple(map(str, range(2221, 2721))), (16,)), (("34", "37"), (15,)), (("6011", "644", "645", "646", "647", "648", "649", "65"), (16, 17, 18, 19)), (tuple(map(str, range(3528, 3590))), (16, 17, 18, 19)), (("300", "301", "302", "303", "304", "305", "36", "38", "39"), (14, 16)), (("62",), (16, 17, 18, 19)), (("50", "56", "57", "58", "6304", "6759", "676"), (13, 14, 15, 16, 17, 18, 19)))


def network(digits: str) -> str | None:
    """The leading digits by which a network issues numbers of this length."""
    return next((lead for leads, sizes in NETWORKS if len(digits) in sizes for lead in leads if digits.startswith(lead)), None)


def card(text: str, key: bytes, back: bool = False) -> str | None:
    """Numbers of a network and a length that it issues, by Luhn; the network's digits stay."""
    d = _digits(text)
    lead = network(d)
    if lead is None or luhn(d[:-1]) != int(d[-1]):
        return None
    size = len(d) - 1 - len(lead)
    body = f"{permute(int(d[len(lead):-1]), 10**size, key, 'card' + lead, back):0{size}d}"
    return refill(text, lead + body + str(luhn(lead + body)))


def phone(text: str, key: bytes, back: bool = False) -> str | None:
    """Ten digits, with or without +1, in any punctuation one value.

    Where only spaces part them they must be of the North American plan (neither area nor exchange begins with 0 or 1). Numbers of
    the plan become others of the plan, and others become others that aren't of it either.
    """
    d = _digits(text)
    lead = "1" if len(d) == 11 and d[0] == "1" else ""
    d = d[len(lead) :]
    planned = lambda n: n // 10**9 >= 2 and n // 10**6 % 10 >= 2
    if len(d) != 10 or not planned(int(d)) and not (text[0] in "+(" or text[3] in ".-"):
        return None
    ok = lambda n: planned(n) == planned(int(d))
    return refill(text, lead + f"{until(ok, int(d), 10**10, key, 'phone', back):010d}")


def foreign_phone(text: str, key: bytes, back: bool = False) -> str | None:
    """+ and 8 to 15 digits; the first two stay."""
    d = _digits(text)
    if not 8 <= len(d) <= 15 or d[0] in "01":
        return None
    return refill(text, d[:2] + f"{permute(int(d[2:]), 10 ** (len(d) - 2), key, 'phone' + d[:2], back):0{len(d) - 2}d}")


def social(text: str, key: bytes, back: bool = False) -> str | None:
    ok = lambda n: n // 10**6 not in (0, 666) and n // 10**6 < 900 and n // 10**4 % 100 and n % 10**4
    d = int(_digits(text))
    return refill(text, f"{until(ok, d, 10**9, key, 'social', back):09d}") if ok(d) else None


def address(text: str, key: bytes, back: bool = False) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "address", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)


def _like(day: date) -> tuple[bool, bool, bool]:
    """Days that are alike in this can be written in the same forms: one-digit month, one-digit day, a day that can't be a month."""
    return day.month < 10, day.day < 10, day.day > 12


@lru_cache(maxsize=1)
def _calendar() -> tuple[dict[tuple, list[date]], dict[date, int]]:
    """All days by what they are alike in, and each day's place among those."""
    groups: dict[tuple, list[date]] = {}
    place: dict[date, int] = {}
    for n in range((LAST - FIRST).days + 1):
        day = FIRST + timedelta(n)
        of = groups.setdefault(_like(day), [])
        place[day] = len(of)
        of.append(day)
    return groups, place


def calendar(text: str, key: bytes, back: bool = False) -> str | None:
    """Days of 1900 to 2099 as year-month-day, or day and month in either order before the year (day first if both could be).

    A day becomes the same other day in every form, one of as many digits, above the twelfth if it is.
    """
    parts = re.split(r"([-/.])", text)
    a, b, c = (int(p) for p in parts[::2])
    for form in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
        y, m, d = {"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}[form]
        try:
            day = date(y, m, d)
        except ValueError:
            continue
        if not FIRST <= day <= LAST:
            return None
        groups, place = _calendar()
        of = groups[_like(day)]
        new = of[permute(place[day], len(of), key, "day" + "".join(map(str, map(int, _like(day)))), back)]
        width = dict(zip(form, map(len, parts[::2])))
        values = {"y": f"{new.year:04d}", "m": f"{new.month:0{width['m']}d}", "d": f"{new.day:0{width['d']}d}"}
        return parts[1].join(values[f] for f in form)
    return None


def iban_ok(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def iban(text: str, key: bytes, back: bool = False) -> str | None:
    raw = text.replace(" ", "")
    if not 15 <= len(raw) <= 34 or not iban_ok(raw):
        return None
    body = free_form(raw[4:], key, "iban" + raw[:2], back)
    check = 98 - int("".join(str(int(c, 36)) for c in body + raw[:2] + "00")) % 97
    it = iter(f"{raw[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


# Hosts that are shared by so many that they name nobody.
PROVIDERS = frozenset("aol.com fastmail.com gmail.com gmx.de gmx.net googlemail.com hotmail.com icloud.com laposte.net live.com mail.com msn.com orange.fr outlook.com proton.me protonmail.com t-online.de web.de yahoo.com yandex.ru".split())


def mail(text: str, key: bytes, back: bool = False) -> str | None:
    """Name and host, in any case one value; the host's last label stays, and so do hosts of common providers."""
    name, _, host = text.rpartition("@")
    known = host.lower()
    if known not in PROVIDERS:
        own, _, top = known.rpartition(".")
        other = free_form(own, key, "host." + top, back) + "." + top
        if other in PROVIDERS:  # walked past, so that a host stays a host of its own
            other = free_form(other.rpartition(".")[0], key, "host." + top, back) + "." + top
    else:
        other = known
    new = free_form(name.lower(), key, "mail@" + (other if back else known), back)
    return f"{_cased(new, name)}@{_cased(other, host)}"


def _cased(text: str, like: str) -> str:
    """text in capitals where `like`, of the same length, has them."""
    return "".join(c.upper() if k.isupper() and len(c.upper()) == 1 else c for c, k in zip(text, like, strict=True)) if len(text) == len(like) else text


HEX = {c: a for a in ("0123456789abcdef", "0123456789ABCDEF") for c in a}
HEX |= {c: "0123456789abcdef" for c in "0123456789abcdef"}


def entropy(text: str) -> float:
    """Bits a character."""
    return sum(-n / len(text) * log2(n / len(text)) for n in Counter(text).values())


def secret(text: str, key: bytes, back: bool = False) -> str | None:
    """Values that no word of a sentence looks like: digits besides letters, or letters of both cases mixed, at 2.3 bits a character or more."""
    letters, digits = sum(map(str.isalpha, text)), sum(map(str.isdigit, text))
    mixed = bool(re.search("[a-z]", text[1:]) and re.search("[A-Z]", text[1:]))
    if not (digits and letters or digits >= 8 or mixed) or entropy(text) < 2.3:
        return None
    return free_form(text, key, "secret", back, HEX if re.fullmatch("[0-9a-f]+", text) else ALPHABET_OF)


# Patterns of each kind. In a match, group "v" is the value where there is one.
MAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
SECRET = re.compile(r"(?i)(?<![^\W_])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)\b[\"']?\s*[:=]\s*[\"']?(?P<v>[A-Za-z0-9+/_.~-]{8,})|\b(?P<w>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abp]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,})\b")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
CARD = re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
PHONE = re.compile(r"(?<![\w.+-])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+1[ .-]?[0-9]{10})(?![\w-])")
FOREIGN = re.compile(r"(?<![\w.+-])\+(?:7|[2-9][0-9])(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}(?![\w-])")
SOCIAL = re.compile(r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
ADDRESS = re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])")
DAY = re.compile(r"(?<![\w.+/-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?:(?=T[0-9]{2})|(?![\w/-]))")
# In the order in which they claim their places.
KINDS = (("mail", MAIL, mail, "@"), ("secret", SECRET, secret, ""), ("iban", IBAN, iban, "0"), ("card", CARD, card, "0"), ("phone", PHONE, phone, "0"), ("phone", FOREIGN, foreign_phone, "+"), ("social", SOCIAL, social, "0"), ("address", ADDRESS, address, "0"), ("date", DAY, calendar, "0"))
DIGIT = re.compile("[0-9]")
# Words right before an address or a date that make it none of a person.
NUMBERED = re.compile(r"(?i)(?:\b(?:version|versión|ver|v|release|build|firmware|chapter|section|rfc)\.?[\s:#]*)$")
PUBLIC = re.compile(r"(?i)(?:\b(?:version|release|released|published|updated|modified|posted|retrieved|accessed|copyright|©)(?: (?:on|at))?[\s:,]*)$")
NOT_AFTER = {"address": NUMBERED, "date": PUBLIC}
KEYWORD = re.compile(r"(?i)token|secret|pass|pwd|key|AKIA|gh[pousr]_|xox|sk-")


@lru_cache(maxsize=50_000)
def _pseudonym(make, value: str, key: bytes) -> str | None:
    return make(value, key)


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym), in order, not overlapping."""
    has = {"@": "@" in text, "+": "+" in text, "0": DIGIT.search(text) is not None, "": KEYWORD.search(text) is not None}
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, make, needs in KINDS:
        if not has[needs]:
            continue
        for m in pattern.finditer(text):
            group = next((g for g in ("v", "w") if g in pattern.groupindex and m[g] is not None), 0)
            a, b = m.span(group)
            if kind in NOT_AFTER and NOT_AFTER[kind].search(text, max(0, a - 24), a):
                continue
            if _taken(found, a, b):
                continue
            new = _pseudonym(make, text[a:b], key)
            if new is not None:
                insort(found, (a, b, kind, new))
    return found


def _taken(found: list[tuple[int, int, str, str]], a: int, b: int) -> bool:
    """Whether any of these places, which don't overlap and are in order, overlaps [a, b)."""
    at = bisect_left(found, (b,))
    return at > 0 and found[at - 1][1] > a


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def pseudonymize(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, text with pseudonyms, n_found, found (kind, start, end in the text as it was, in code points).

    Null texts stay null with nothing found; ids may be null or repeat; an empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                out = []
                for t in batch.column(1)[at : at + 512].to_pylist():
                    got, parts, end = find(t, key) if t else [], [], 0
                    for a, b, _, new in got:
                        parts += [t[end:a], new]
                        end = b
                    out.append(("".join(parts) + t[end:] if got else t, len(got), [{"kind": k, "start": a, "end": b} for a, b, k, _ in got]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 512].cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, [pa.string(), pa.int64(), SPANS]))], ["doc_id", "text", "n_found", "found"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, text string, n_found long, found array<struct<kind:string,start:int,end:int>>")
