"""Personal data replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, phone numbers (international, or national with separators), IPv4 and
IPv6 addresses, card numbers, account numbers (bare digits, IBAN), social security numbers, secrets
(hex or alphanumeric, after a word such as token or password; unquoted ones with a digit), names
after a form of address, and repeats of those names in the same text.  Names without a form of
address anywhere in their text are not found.  A surrogate depends only on the key, the type and
the entity's canonical form, so the same entity is replaced alike in every document (coreference).

Numbers, secrets and local parts of addresses go through a keyed Feistel permutation over strings
of the same shape: separators, letter case and script stay, and different entities of a shape get
different surrogates by construction.  Card numbers keep their Luhn validity, phone numbers their
country code.  A name is rebuilt from syllables of its script, given names with an ending of the
gender that the form of address tells.

Collision checks: a surrogate that equals an entity of the corpus, or one drawn for another entity,
is drawn again with the next attempt; a round handles the colliding entities only.  From the third
attempt on each one lengthens the surrogate, so even a shape whose members are all in the corpus
(the ten one-digit addresses of a domain) finds free ones, and rounds end for any input.

A text is read in time linear in its length: patterns are tried only where a digit, an @, a form of
address or a secret's word stands.

Edge cases: null texts stay null, empty and clean texts stay as they are; texts are read whole;
repeated rows are replaced alike; null doc_ids stay; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import text as tx
from tidewater.llm.workspace import map_arrow, materialize

#: Setting with the key of :func:`op6_surrogates`; without it a key is drawn for the run.
KEY_SETTING = "spark.tidewater.surrogateKey"
#: Entities with a later attempt up to which their table is broadcast (about 100 bytes each).
BROADCAST_EXCEPTIONS = 100_000
#: Attempts that keep an entity's length.
SAME_LENGTH = 2

_MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Господин", "Κύριος"]
_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Κυρία"]
_NEUTRAL = ["Dr", "Prof", "Doctor", "Professor", "Doktor"]

_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_NUMBERS = regex.compile(
    r"""
    (?<![\w:])(?P<ipv6>(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}))(?![\w:])
  | (?<!\w)(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)
  | (?<![\d.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d]|\.\d)
  | (?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
  | (?<!\w)(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}|\(\d{2,5}\)[ ]?\d{2,5}(?:[ .-]\d{2,5}){1,3})(?!\w)
  | (?<![\w.-])(?P<phone>\d{3}(?P<gap>[ .-])\d{3}(?P=gap)\d{4}|0\d{1,4}[ /-]\d{5,8})(?![\w-]|\.\d)
  | (?<![\w.+-])(?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])
    """,
    regex.VERBOSE | regex.ASCII,
)
_NUMBER_KINDS = ("ip", "ipv6", "iban", "ssn", "phone", "card")
_SECRET_WORD = re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x20\x09-\x0D]*[=:]")
_SECRET = regex.compile(r"""\s*(?:["'](?P<secret>[A-Za-z0-9+/_-]{8,})(?=["'])|(?P<secret>(?=[A-Za-z+/_-]*\d)[A-Za-z0-9+/_-]{8,})(?!\w))""")
_NAME = r"\p{Lu}(?:\p{L}+|(?=['’-]))(?:['’-]\p{L}{2,})*"
_TITLES = re.compile(r"(?<!\w)(?:(?P<male>" + "|".join(_MALE) + r")|(?P<female>" + "|".join(_FEMALE) + r")|(?:" + "|".join(_NEUTRAL) + r"))\.?[ ](?:(?:Dr|Prof)\.?[ ])*")
_TITLED = regex.compile(rf"(?!(?:Mr|Mrs|Ms|Dr|Prof)\b){_NAME}(?:[ ]{_NAME}){{0,2}}")
_NAME_WORD = regex.compile(rf"(?<!\w){_NAME}(?!\w)")
_DIGIT_RUN = re.compile(r"[0-9]+")
_DOMAINS_KEPT = regex.compile(r"(?:.*\.)?(?:example\.(?:com|org|net)|gmail\.com|outlook\.com|yahoo\.com|hotmail\.com)$")

_DIGITS = "0123456789"
_ALPHABETS = [
    _DIGITS,
    "abcdefghijklmnopqrstuvwxyz",
    "ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ",
]
_PLACE = {c: (a, i) for a, alphabet in enumerate(_ALPHABETS) for i, c in enumerate(alphabet)}
# letters of other scripts move within their range: Hebrew, Arabic, Devanagari, Thai, Hiragana, Katakana, Han, Hangul
_RANGES = [(0x5D0, 0x5EB), (0x621, 0x64B), (0x905, 0x93A), (0xE01, 0xE2F), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0xA000), (0xAC00, 0xD7A4)]
_SYLLABLES = [
    ["ba", "del", "fo", "gar", "hen", "ki", "lor", "mar", "ne", "ol", "per", "ri", "sen", "ta", "vel", "win"],
    ["ба", "вел", "го", "дар", "жен", "ки", "лов", "мар", "не", "ол", "пет", "ри", "сен", "та", "фед", "шин"],
    ["βα", "δελ", "φο", "γαρ", "θεν", "κι", "λορ", "μαρ", "νε", "ολ", "περ", "ρι", "σεν", "τα", "ζελ", "ξαν"],
]
_ENDINGS = [{"m": "in", "f": "ia", "": "er"}, {"m": "ан", "f": "ина", "": "ов"}, {"m": "ος", "f": "ια", "": "ας"}]


def _digest(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key[:64], digest_size=32).digest(), "big")


#: Characters that one Feistel network permutes; longer strings are chained blocks.
BLOCK = 24


def permute(key: bytes, tweak: str, values: list[int], radix: int, rounds: int = 8) -> list[int]:
    """A keyed permutation of strings of ``len(values)`` digits in base ``radix``.  A block of a
    long string is permuted under what the blocks before it became."""
    n = len(values)
    if n > BLOCK:
        out: list[int] = []
        for at in range(0, n, BLOCK):
            out += permute(key, tweak, values[at : at + BLOCK], radix, rounds)
            tweak = f"{_digest(key, 'chain', tweak, out[at:]):x}"
        return out
    if n == 1 and radix <= 64:
        order = sorted(range(radix), key=lambda v: _digest(key, tweak, "single", radix, v))
        return [order[values[0]]]
    if n == 1:  # two digits of a smaller base, walked until the value is one of the radix again
        base = int(radix**0.5) + 1
        value = values[0]
        while True:
            high, low = permute(key, f"{tweak}|walk", list(divmod(value, base)), base, rounds)
            value = high * base + low
            if value < radix:
                return [value]
    half = n // 2
    number = lambda ds: sum(d * radix**i for i, d in enumerate(reversed(ds)))
    a, b, size_a, size_b = number(values[:half]), number(values[half:]), half, n - half
    for r in range(rounds):
        c = (a + _digest(key, tweak, radix, n, r, b)) % radix**size_a
        a, b, size_a, size_b = b, c, size_b, size_a
    digits = []
    for v, size in ((a, size_a), (b, size_b)):
        part = []
        for _ in range(size):
            v, d = divmod(v, radix)
            part.append(d)
        digits += part[::-1]
    return digits


def _place(c: str) -> tuple[int, int, int] | None:
    """(alphabet, index, size of the alphabet) of a character."""
    if c in _PLACE:
        a, i = _PLACE[c]
        return a, i, len(_ALPHABETS[a])
    for k, (lo, hi) in enumerate(_RANGES):
        if lo <= ord(c) < hi:
            return len(_ALPHABETS) + k, ord(c) - lo, hi - lo
    return None


def _shape(key: bytes, tweak: str, canonical: str) -> str:
    """Characters of each alphabet permuted among themselves; all others stay."""
    chars = list(canonical)
    places = [_place(c) for c in chars]
    shape = hashlib.blake2b(repr([p[0] if p else c for p, c in zip(places, chars)]).encode(), digest_size=16).hexdigest()
    for a in sorted({p[0] for p in places if p}):
        at = [i for i, p in enumerate(places) if p and p[0] == a]
        new = permute(key, f"{tweak}|{a}|{shape}", [places[i][1] for i in at], places[at[0]][2])
        for i, v in zip(at, new):
            chars[i] = _ALPHABETS[a][v] if a < len(_ALPHABETS) else chr(_RANGES[a - len(_ALPHABETS)][0] + v)
    return "".join(chars)


def _more(key: bytes, kind: str, entity: str, attempt: int, alphabet: str, least: int = 0) -> str:
    """The characters that an attempt adds: none while an entity's own length is tried."""
    n, out = max(least, attempt - SAME_LENGTH), ""
    value = _digest(key, "more", kind, attempt, entity)
    for _ in range(n):
        value, d = divmod(value, len(alphabet))
        out += alphabet[d]
    return out


def _luhn(digits: list[int]) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def canonical(kind: str, found: str, gender: str = "") -> str:
    """What makes two mentions the same entity."""
    if kind == "email":
        return found.lower()
    if kind == "ipv6":
        return ipaddress.IPv6Address(found).exploded
    if kind == "iban":
        return found.replace(" ", "")
    if kind in ("phone", "card", "ssn"):
        return ("+" if found.startswith("+") else "") + "".join(c for c in found if c.isdigit())
    return f"{gender}:{found}" if kind == "name" else found


def _private(o: list[int]) -> bool:
    return o[0] == 10 or o[:2] == [192, 168] or (o[0] == 172 and 16 <= o[1] < 32) or o[0] in (0, 127) or o[0] >= 224


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The replacement of a canonical entity, itself in canonical form."""
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        if not _DOMAINS_KEPT.match(domain):
            head, dot, top = domain.rpartition(".")
            domain = _shape(key, tweak + "|domain", head) + dot + top
        fixed = not any(map(_place, local))  # nothing in it has an alphabet
        return f"{_shape(key, tweak, local)}{_more(key, kind, entity, attempt, 'abcdefghijklmnopqrstuvwxyz', 2 * fixed)}@{domain}"
    if kind == "ip":
        octets = [int(o) for o in entity.split(".")]
        wide, extra = _private(octets), attempt - SAME_LENGTH
        if extra > 4:  # the last resort where all of IPv4 is taken
            return "fd00:" + ":".join(f"{_digest(key, 'ip', attempt, k, entity) % 65536:04x}" for k in range(7))
        if extra > 0 and wide:  # out of a crowded private range into the widest one
            octets, entity = [10, *(_digest(key, "ip", attempt, k, entity) % 256 for k in range(3))], "10"
        keep = 0 if not wide else 1 if octets[0] != 192 and octets[0] != 172 else 2
        new = octets
        while True:  # cycle walking keeps the permutation within the class
            new = new[:keep] + permute(key, f"{tweak}|{new[:keep]}", new[keep:], 256)
            if _private(new) == wide:
                return ".".join(map(str, new))
    if kind == "ipv6":  # the first group tells the scope
        new = permute(key, f"{tweak}|{entity[:4]}", [int(c, 16) for c in entity[4:].replace(":", "")], 16)
        return ":".join([entity[:4], *("".join(f"{v:x}" for v in new[i : i + 4]) for i in range(0, 28, 4))])
    if kind == "iban":  # valid stays valid, by the same distance of the check digits
        body = list(entity[4:])
        for is_one, zero, radix in ((str.isdigit, "0", 10), (str.isalpha, "A", 26)):
            at = [i for i, c in enumerate(entity[4:]) if is_one(c)]
            new = permute(key, f"{tweak}|{entity[:2]}|{radix}|{at}", [ord(body[i]) - ord(zero) for i in at], radix) if at else []
            for i, v in zip(at, new):
                body[i] = chr(ord(zero) + v)
        check = lambda bban: 98 - int("".join(str(int(c, 36)) for c in bban + entity[:2] + "00")) % 97
        body = "".join(body) + _more(key, kind, entity, attempt, _DIGITS)
        return f"{entity[:2]}{(check(body) - 2 + int(entity[2:4]) - check(entity[4:])) % 97 + 2:02d}{body}"
    if kind == "card":
        digits = [int(c) for c in entity]
        head = permute(key, tweak, digits[:-1], 10)
        while (head[0] == 0) != (digits[0] == 0):
            head = permute(key, tweak, head, 10)
        head += map(int, _more(key, kind, entity, attempt, _DIGITS))
        off = (digits[-1] - _luhn(digits[:-1])) % 10
        return "".join(map(str, [*head, (_luhn(head) + off) % 10]))
    if kind == "phone":
        body = entity.lstrip("+")
        keep = len(body) - 10 if entity.startswith("+") and len(body) > 10 else 2 if entity.startswith("+") else 0
        digits = [int(c) for c in body[keep:]]
        new = permute(key, f"{tweak}|{body[:keep]}", digits, 10)
        while (new[0] < 2) != (digits[0] < 2):
            new = permute(key, f"{tweak}|{body[:keep]}", new, 10)
        return entity[: len(entity) - len(digits)] + "".join(map(str, new)) + _more(key, kind, entity, attempt, _DIGITS)
    if kind == "ssn":
        return "".join(map(str, permute(key, tweak, [int(c) for c in entity], 10))) + _more(key, kind, entity, attempt, _DIGITS)
    if kind == "secret":
        for chars in ("0123456789abcdef", "0123456789ABCDEF", _DIGITS + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"):
            if all(c in chars for c in entity):
                return "".join(chars[v] for v in permute(key, f"{tweak}|{len(chars)}|{chars[-1]}", [chars.index(c) for c in entity], len(chars))) + _more(key, kind, entity, attempt, chars)
    gender, _, name = entity.partition(":")
    out, words = [], name.split(" ")
    for i, w in enumerate(words):
        script = max(0, _PLACE.get(w[-1].lower(), (1, 0))[0] - 2)
        given = len(words) > 1 and i < len(words) - 1
        n = _digest(key, "name", attempt, gender if given else "", w)
        parts = [_SYLLABLES[script][(n >> (4 * k)) & 15] for k in range(min(4 + attempt, 30))]
        out.append(("".join(parts) + _ENDINGS[script][gender if given else ""] * max(1, attempt - 26)).capitalize())
    return f"{gender}:{' '.join(out)}"


def render(kind: str, found: str, new: str) -> str:
    """A canonical surrogate in the layout of the mention it replaces; what an attempt added follows."""
    if kind == "email":
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(found, new)) if len(found) == len(new) else new
    if kind in ("phone", "card", "ssn"):
        digits = iter([c for c in new if c.isdigit()])
        return "".join([next(digits) if c.isdigit() else c for c in found] + list(digits))
    if kind == "iban":
        chars = iter(new)
        return "".join([c if c == " " else next(chars) for c in found] + list(chars))
    if kind == "ipv6":
        new = str(ipaddress.IPv6Address(new)) if len(found) < 39 else new
        return new.upper() if found.isupper() else new
    return new.partition(":")[2] if kind == "name" else new


def _is_ipv6(found: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(found))
    except ValueError:
        return False


def mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, found, canonical) of every entity of a text, in order."""
    found = _titled(text)
    names: dict[str, str] = {}
    for _, _, kind, name, entity in found:
        if kind == "name":
            names.setdefault(name, entity)
    return sorted(found + _repeats(text, names, [(m[0], m[1]) for m in found])) if names else found


def _repeats(text: str, names: dict[str, str], taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str, str]]:
    """Repeats of ``names`` (three words at most) without a form of address, longer ones first."""
    words = [(m.start(), m.end()) for m in _NAME_WORD.finditer(text)]
    out, k, t = [], 0, 0
    while k < len(words):
        start = words[k][0]
        while t < len(taken) and taken[t][1] <= start:
            t += 1
        room = taken[t][0] if t < len(taken) else len(text)
        step = 1
        for n in (3, 2, 1):
            if k + n > len(words) or words[k + n - 1][1] > room or start >= room:
                continue
            name = text[start : words[k + n - 1][1]]
            if name in names:
                out.append((start, start + len(name), "name", name, names[name]))
                step = n
                break
        k += step
    return out


def _local(text: str, upto: int, at: int) -> int:
    """Where the local part before an @ begins: letters, digits, signs, and single dots between."""
    start = at
    while start > upto:
        c = text[start - 1]
        if not (c.isalnum() or c in "_%+-" or (c == "." and start < at and text[start] != ".")):
            break
        start -= 1
    return start + (start < at and text[start] == ".")


def _emails(text: str) -> list[tuple[int, int, str, str, str]]:
    out, upto, at = [], 0, text.find("@")
    while at >= 0:
        start, domain = _local(text, upto, at), _DOMAIN.match(text, at + 1)
        if start < at and domain is not None:
            found = text[start : domain.end()]
            out.append((start, domain.end(), "email", found, canonical("email", found)))
            upto = domain.end()
        else:
            upto = at + 1
        at = text.find("@", upto)
    return out


def _starts(text: str, s: int) -> list[int]:
    """Where an entity whose first digits stand at ``s`` may begin."""
    out, lo = [s], s
    while lo > max(0, s - 40) and text[lo - 1] in "abcdefABCDEF:":
        lo -= 1
    if s and text[s - 1] in "+(":
        out.append(s - 1)
    if s > 1 and text[s - 1].isupper():
        out.append(s - 2)
    if lo < s and lo not in out:
        out.append(lo)
    return sorted(out)


def _titled(text: str) -> list[tuple[int, int, str, str, str]]:
    """The entities that their own shape or what stands before them tells."""
    mails = _emails(text)
    places = [(m.start(), 0, m) for m in _SECRET_WORD.finditer(text)] + [(m.start(), 1, m) for m in _TITLES.finditer(text)] + [(m.start(), 2, m) for m in _DIGIT_RUN.finditer(text)]
    places.sort(key=lambda p: p[:2])
    out, upto, k = [], 0, 0
    for at, sort, m in places:
        while k < len(mails) and mails[k][1] <= at:
            k += 1
        if at < upto or (k < len(mails) and mails[k][0] <= at):
            continue
        room = mails[k][0] if k < len(mails) else len(text)
        found = None
        if sort == 0:
            if (x := _SECRET.match(text, m.end())) is not None:
                found = (x.start("secret"), x.end("secret"), "secret", x["secret"], x["secret"])
        elif sort == 1:
            if (x := _TITLED.match(text, m.end())) is not None:
                found = (x.start(), x.end(), "name", x[0], canonical("name", x[0], "m" if m["male"] else "f" if m["female"] else ""))
        else:
            for start in _starts(text, at):
                if start < upto or (x := _NUMBERS.match(text, start)) is None:
                    continue
                kind = next(n for n in _NUMBER_KINDS if x[n] is not None)
                if kind != "ipv6" or _is_ipv6(x[kind]):
                    found = (x.start(kind), x.end(kind), kind, x[kind], canonical(kind, x[kind]))
                    break
        if found is not None and found[1] <= room:
            out.append(found)
            upto = found[1]
    return sorted(out + mails)


_DIGIT = tx.byte_class(range(0x30, 0x3A))
_TITLE_BYTES = [(h + end).encode() for h in _MALE + _FEMALE + _NEUTRAL for end in ". "]
_SECRET_BYTES = [b"token", b"secret", b"passw", b"key", b"::"]


def _suspects(raw: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts that may hold an entity: enough digits, an @, a secret's word, a form of address."""
    n = len(offsets) - 1
    digits = np.searchsorted(offsets, np.flatnonzero(_DIGIT[raw]), side="right") - 1
    hit = np.bincount(digits, minlength=n)[:n] >= 4
    data, low = raw.tobytes(), tx.LOWER[raw].tobytes()
    bounds = offsets.tolist()
    for where, signs in ((data, [b"@", *_TITLE_BYTES]), (low, _SECRET_BYTES)):
        for sign in signs:
            at = where.find(sign)
            while at >= 0:  # one hit tells; the search goes on behind its text
                row = bisect_left(bounds, at + 1) - 1
                hit[row] = True
                at = where.find(sign, bounds[row + 1])
    return np.flatnonzero(hit).tolist()


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest of the text, kind, entity) of what each text of a slice mentions."""
    for batch in batches:
        for _, _, offsets, raw in tx.slices(batch.column(0)):
            found = set()
            for d in _suspects(raw, offsets):
                body = raw[offsets[d] : offsets[d + 1]].tobytes()
                ones = mentions(body.decode("utf-8", "replace"))
                if ones:
                    digest = hashlib.md5(body).hexdigest()
                    found.update((digest, kind, entity) for _, _, kind, _, entity in ones)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(3)], names=["digest", "kind", "entity"])


_DRAWN = "kind string, entity string, attempt int, surrogate string"


def _draw(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(key, k, e, attempt) for k, e in zip(*(c.to_pylist() for c in batch.columns[:2]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([attempt] * len(new), pa.int32()), pa.array(new, pa.string())], names=["kind", "entity", "attempt", "surrogate"])

    return run


def _shown(column: str) -> Column:
    """An entity or surrogate as a text shows it: a name without its gender."""
    return F.when(F.col("kind") == "name", F.substring_index(column, ":", -1)).otherwise(F.col(column))


def later_attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate collides.

    ``entities(kind, entity)`` are distinct.  A round draws for the entities still open and keeps
    what is neither an entity nor was drawn before; the smallest entity keeps what several drew.
    """
    taken = entities.select("kind", _shown("entity").alias("shown"))
    open_, attempt, settled = entities.select("kind", "entity"), 0, []
    while True:
        drawn = materialize(map_arrow(open_, _draw(key, attempt), _DRAWN).withColumn("shown", _shown("surrogate")), "surrogates")
        own = drawn.withColumn("self", _shown("entity"))
        shared = own.groupBy("kind", "shown").agg(F.min("self").alias("owner"), F.max("self").alias("other")).where("owner <> other").select("kind", "shown", "owner")
        before = taken.join(drawn.select("kind", "shown"), ["kind", "shown"], "left_semi").distinct()
        bad = shared.join(before, ["kind", "shown"], "left_anti").unionByName(before.withColumn("owner", F.lit(None).cast("string")))
        bad = materialize(bad, "collisions")
        some = not bad.isEmpty()
        if attempt:
            kept = own.join(bad, ["kind", "shown"], "left_anti").select("kind", "entity", "attempt")
            first = own.join(bad, ["kind", "shown"]).where("owner = self").select("kind", "entity", "attempt")
            settled.append(materialize(kept.unionByName(first), "settled") if some else drawn.select("kind", "entity", "attempt"))
        if not some:
            break
        open_ = materialize(own.join(bad, ["kind", "shown"]).where("owner IS NULL OR owner <> self").select("kind", "entity"), "open")
        taken = taken.unionByName(drawn.select("kind", "shown"))
        attempt += 1
    none = entities.sparkSession.createDataFrame([], "kind string, entity string, attempt int")
    for part in settled:
        none = none.unionByName(part)
    return none


_OUT = "doc_id long, n_entities long, kinds string, text string"


def _replace(key: bytes, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared is not None else {}
        drawn = lru_cache(100_000)(surrogate)
        for batch in batches:
            own = batch.column(2) if batch.num_columns > 2 else None
            for lo, hi, offsets, raw in tx.slices(batch.column(1)):
                counts, kinds, new = [0] * (hi - lo), [""] * (hi - lo), {}
                for d in _suspects(raw, offsets):
                    text, at, parts, seen = raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"), 0, [], []
                    attempts = known if own is None else {(x["kind"], x["entity"]): x["attempt"] for x in own[lo + d].as_py() or []}
                    for s, e, kind, found, entity in mentions(text):
                        parts += [text[at:s], render(kind, found, drawn(key, kind, entity, attempts.get((kind, entity), 0)))]
                        at = e
                        seen.append(kind)
                    if seen:
                        new[d], counts[d], kinds[d] = "".join(parts) + text[at:], len(seen), ",".join(sorted(set(seen)))
                texts = batch.column(1).slice(lo, hi - lo)
                if new:
                    texts = texts.to_pylist()
                    for d, text in new.items():
                        texts[d] = text
                    texts = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), texts], names=["doc_id", "n_entities", "kinds", "text"])

    return run


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_entities, kinds (distinct, comma-joined), text with surrogates.
    ``key`` is the caller's secret: who has it can undo what is permuted."""
    if not key:
        raise ValueError("surrogates need a key")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = materialize(map_arrow(docs.select("text"), _detect, "digest string, kind string, entity string"), "mentions")
    entities = materialize(found.select("kind", "entity").distinct(), "entities")
    later = materialize(later_attempts(entities, key), "later-attempts")
    if later.count() <= BROADCAST_EXCEPTIONS:
        table = {(r["kind"], r["entity"]): r["attempt"] for r in later.collect()}
        return map_arrow(docs, _replace(key, docs.sparkSession.sparkContext.broadcast(table)), _OUT)
    # by the text's digest, so that a list holds what one text mentions, however many rows have it
    own = found.distinct().join(later, ["kind", "entity"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("later"))
    joined = docs.join(own, F.md5(docs["text"].cast("binary")) == own["digest"], "left").select("doc_id", "text", "later")
    return map_arrow(joined, _replace(key, None), _OUT)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the whole ``documents`` table replaced by surrogates, under the key in
    ``spark.tidewater.surrogateKey`` or, without one, under a key that nobody keeps."""
    key = spark.conf.get(KEY_SETTING, None)
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"), key.encode() if key else secrets.token_bytes(32))
