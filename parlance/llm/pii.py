"""PII: detected entities get keyed surrogates of the same type and format.

Entities: e-mail addresses, IPv4 addresses, IBANs, payment cards, social security numbers,
telephone numbers, and names after a form of address (with later mentions of those names in the
same text). A surrogate is a keyed permutation of the entity within its own format: digits stay
digits, letters keep their script, case and being vowel or consonant, a known given name becomes
another of its gender and script, a card keeps whether its check digit is right, an address its
range. Separators, forms of address and top-level domains stay.

The permutation is x -> E^-1(E(x) + 1) over all strings of the format, for a keyed Feistel
permutation E: one cycle, so no entity is its own surrogate, and different entities never share
one. What must stay in a class (a range of addresses, cards with a right or wrong check digit) is numbered
within it and permuted there. Where few results fall outside the class (a listed name, a check number that is
right by chance) the step is repeated until one is inside, which keeps it one to one: this is the collision
check. As it depends on key, type and entity only, an entity has the same surrogate in all texts,
however it is punctuated. `collisions` counts what a check over a whole corpus finds.

Telephone numbers are those with a country code (+ or 00), with a trunk 0, with an area code in
parentheses or with 9 or more digits in groups; without any of these, 10 digits that begin with 2 to 9, 9
that begin with 6 to 9, and 7 or 8 digits parted by a hyphen or blank (but no two years). Other bare runs of digits
are taken as plain numbers, and 7 digits parted by a point as a decimal.

A null text stays null and has no entities. Rows are handled one by one; repeated rows repeat. Long texts and
many entities take time in proportion. An empty table gives an empty result. Only the key and the text are
read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches, table, text_buffers

TYPES = ("email", "ip", "iban", "card", "ssn", "phone", "name")
#: Replace in production; surrogates can be reversed by whoever knows it.
KEY = b"surrogate key of the examples"
#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Thomas Daniel Paul Peter Hans Karl Stefan Klaus Pierre Louis Antoine Luc Carlos Juan Miguel Pablo".split(),
    ("f", "latin"): "Mary Anna Susan Linda Karen Emma Laura Julia Claudia Sabine Ursula Marie Camille Chloé Sophie Carmen Lucía Elena Isabel Rosa".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Михаил Николай Андрей".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "г-н", "г-жа", "Господин", "Госпожа")
#: Letters that are exchanged among each other, in lower case.
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àâáãäåæ", "èéêë", "ìíîï", "òóôõöø", "ùúûü", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αειουηω", "βγδζθκλμνξπρστφχψς", "0123456789")
_CLASS = {c: (k, i) for k, letters in enumerate(CLASSES) for i, c in enumerate(letters)}


class Permutation:
    """A keyed permutation of 0 .. size - 1 by a Feistel network over two halves, and its one-cycle conjugate `step`."""

    def __init__(self, key: bytes, what: str, size: int, rounds: int = 8):
        self.size, self.rounds = size, rounds
        self.high = math.isqrt(max(0, size - 1)) + 1
        self.low = -(-size // self.high)
        self.keys = [hashlib.blake2b(f"{what}:{size}:{k}".encode(), key=key[:64]).digest()[:32] for k in range(rounds)]

    def _mask(self, k: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(half.to_bytes((half.bit_length() + 8) // 8, "big"), key=self.keys[k], digest_size=32).digest(), "big")

    def _pass(self, x: int, back: bool) -> int:
        while True:
            a, b = divmod(x, self.low)
            for k in reversed(range(self.rounds)) if back else range(self.rounds):
                sign = -1 if back else 1
                if k % 2:
                    b = (b + sign * self._mask(k, a)) % self.low
                else:
                    a = (a + sign * self._mask(k, b)) % self.high
            x = a * self.low + b
            if x < self.size:
                return x

    def step(self, x: int) -> int:
        return self._pass((self._pass(x, False) + 1) % self.size, True)


@lru_cache(maxsize=4096)
def _permutation(key: bytes, what: str, size: int) -> Permutation:
    return Permutation(key, what, size)


def _walk(key: bytes, what: str, x: int, size: int, fits) -> int:
    p, y = _permutation(key, what, size), x
    while True:
        y = p.step(y)
        if y == x or fits(y):
            return y


def permute_text(key: bytes, what: str, text: str, fits=lambda s: True) -> str:
    """A text of the same shape: every letter or digit of CLASSES changes within its class; `fits` says which results are allowed."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    radix = [len(CLASSES[_CLASS[c][0]]) if c in _CLASS else 1 for c in low]
    shape = "".join(chr(65 + _CLASS[c][0]) if c in _CLASS else c for c in low)
    size, x = math.prod(radix), 0
    for c, r in zip(low, radix, strict=True):
        x = x * r + (_CLASS[c][1] if c in _CLASS else 0)

    def spell(y: int) -> str:
        out = []
        for c, own, r in zip(reversed(text), reversed(low), reversed(radix), strict=True):
            y, digit = divmod(y, r)
            new = CLASSES[_CLASS[own][0]][digit] if own in _CLASS else c
            out.append(new.upper() if c != own and len(new.upper()) == 1 else new)
        return "".join(reversed(out))

    return spell(_walk(key, f"{what}:{hashlib.sha256(shape.encode()).hexdigest()}", x, size, lambda y: fits(spell(y))))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def _check_digit(body: str) -> int:
    """The last digit that makes a card number right."""
    return next(d for d in range(10) if luhn(body + str(d)))


def _digits(key: bytes, what: str, text: str, fits=lambda s: True) -> str:
    """Permutes all digits of a text together and puts them in the places of the old."""
    new = iter(permute_text(key, what, re.sub(r"\D", "", text), fits))
    return re.sub(r"\d", lambda _: next(new), text)


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


_LISTED = {n.lower(): (group, i) for group, names in GIVEN.items() for i, n in enumerate(names)}


#: Addresses that mean something by their range: this network, private ones, loopback, multicast and reserved; in order.
RANGES = ((0, 1 << 24), (10 << 24, 11 << 24), (127 << 24, 128 << 24), (0xAC10 << 16, 0xAC20 << 16), (0xC0A8 << 16, 0xC0A9 << 16), (224 << 24, 1 << 32))


@lru_cache(maxsize=1 << 16)
def surrogate(key: bytes, kind: str, text: str) -> str:
    """The surrogate of an entity. Entities of a type that differ only in separators or case differ only so afterwards."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        *labels, top = domain.split(".")
        return f"{permute_text(key, 'local', local)}@{'.'.join([permute_text(key, f'domain{k}', x) for k, x in enumerate(labels)] + [top])}"
    if kind == "ip":
        x = int.from_bytes(bytes(int(v) for v in text.split(".")), "big")
        own = next((r for r in RANGES if r[0] <= x < r[1]), None)
        if own:  # stays in its range
            y = own[0] + _permutation(key, f"ip{own[0]}", own[1] - own[0]).step(x - own[0])
        else:  # numbered without the ranges
            free = (1 << 32) - sum(b - a for a, b in RANGES)
            y = _permutation(key, "ip", free).step(x - sum(b - a for a, b in RANGES if b <= x))
            for a, b in RANGES:
                y += (b - a) * (y >= a)
        return ".".join(map(str, y.to_bytes(4, "big")))
    if kind == "iban":
        flat = re.sub(r"\s", "", text)
        country, check, body = flat[:2], flat[2:4], flat[4:]
        right = _iban_check(country, body) == check
        new = permute_text(key, "iban" + country, body, lambda s: right or _iban_check(country, s) != check)
        letters = iter(country + (_iban_check(country, new) if right else check) + new)
        return re.sub(r"\S", lambda _: next(letters), text)
    if kind == "card":
        flat = re.sub(r"\D", "", text)
        body, off = flat[:-1], (int(flat[-1]) - _check_digit(flat[:-1])) % 10
        if off:  # how far the check digit is from right is permuted with the rest: 1 to 9
            x = _permutation(key, f"card{len(body)}wrong", 9 * 10 ** len(body)).step(int(body) * 9 + off - 1)
            new, off = f"{x // 9:0{len(body)}d}", x % 9 + 1
        else:
            new = f"{_permutation(key, f'card{len(body)}', 10 ** len(body)).step(int(body)):0{len(body)}d}"
        digits = iter(new + str((_check_digit(new) + off) % 10))
        return re.sub(r"\d", lambda _: next(digits), text)
    if kind == "name":
        if text.lower() in _LISTED:
            group, i = _LISTED[text.lower()]
            new = GIVEN[group][_permutation(key, "-".join(group), len(GIVEN[group])).step(i)]
            return new.upper() if text.isupper() else new.lower() if text.islower() else new
        head, last = text[:-1], text[-1]  # the last letter often shows the gender
        return permute_text(key, f"name{last.lower()}", head, lambda s: (s + last).lower() not in _LISTED) + last
    return _digits(key, kind, text)


_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
_CARD = re.compile(r"(?<![\w+])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?!\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){1,4}(?!\w)|(?<!\w)\+\d{8,15}(?!\w)|(?<!\w)\(\d{1,5}\) ?\d{5,10}(?!\w)")
_SEP = r"[ .\-/\u00a0\u202f]"
#: Groups after a country or area code: short ones, and a long one last, which an extension may follow. None begins a date.
_GROUPS = rf"(?:{_SEP}(?!(?:19|20)\d\d[-.]\d\d[-.]\d\d(?!\d))\d{{1,5}}(?!\d))"
_LONG = rf"(?:{_SEP}\d{{6,10}}(?!\d)(?:-\d{{1,5}}(?!\d))?)"
_PAIRS = rf"(?:{_SEP}?\d\d){{4}}"
#: (pattern, least and most digits): numbers after a country code, after a trunk 0, and bare ones of 10 (North America) or 9 digits (Spain), or of 7 or 8 with a separator.
_PHONES = (
    (re.compile(rf"(?<![\w+])(?:\+|00)33{_SEP}?(?:\(0\){_SEP}?)?[1-9]{_PAIRS}(?!\w)"), 11, 14),
    (re.compile(rf"(?<![\w+])(?:\+|00(?=[1-9]))\d{{1,3}}(?:{_SEP}?\(\d{{1,5}}\){_SEP}?\d{{1,10}}(?!\d))?{_GROUPS}{{0,6}}{_LONG}?(?!\w)"), 8, 15),
    (re.compile(rf"(?<![\w+])(?<!\d[.,:/-])(?!\d\d[-./]\d\d[-./](?:19|20)\d\d(?!\d))0[1-9](?:{_PAIRS}|\d{{7,10}}|\d{{0,4}}(?:{_GROUPS}{{1,4}}{_LONG}?|{_LONG}))(?!\w)"), 9, 12),
)
_LOCAL = (
    (re.compile(rf"(?<=\()\d{{2,5}}(?:{_SEP}\d{{2,5}}){{1,4}}(?=\))"), 9, 15),
    (re.compile(r"(?<![\w+])(?<!\d[.,:/-])(?<!\d )(?!(?:1\d|20)\d\d[ -](?:1\d|20)\d\d(?!\d))\d{3,4}[ \u00a0-]\d{4}(?!\w|[ .,:/-]\d)"), 7, 8),
    (re.compile(r"(?<![\w+])(?<!\d[.,:/-])(?:[2-9]\d{9}|[6-9]\d{8})(?!\w|[.,:/-]\d)"), 9, 10),
)
_DATE = re.compile(r"\d{4}[-.]\d{2}[-.]\d{2}|\d{2}[-.]\d{2}[-.]\d{4}")
_WORD = r"[^\W\d_a-zà-öø-ÿа-яё][^\W\d_]+"
_NAME = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? ({_WORD}(?:[ -]{_WORD}){{0,2}})")


def _numbers(text: str, pattern: re.Pattern, least: int, most: int):
    """Spans of telephone numbers; of one that is too long its last groups are left out, and looked at again."""
    at = 0
    while m := pattern.search(text, at):
        a, b = m.span()
        while sum(map(str.isdigit, text[a:b])) > most and (cut := list(re.finditer(rf"{_SEP}\d+", text[a:b]))):
            b = a + cut[-1].start()
        ok = least <= sum(map(str.isdigit, text[a:b])) <= most
        if ok:
            yield a, b
        at = b if ok else a + 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of all entities, none overlapping; a type earlier in TYPES goes first."""
    taken: list[tuple[int, int, str]] = []
    mark = bytearray(len(text))

    def add(kind: str, spans) -> None:
        for a, b in spans:
            if mark.find(1, a, b) < 0:
                taken.append((a, b, kind))
                mark[a:b] = b"\1" * (b - a)

    matches = lambda p: (m.span() for m in p.finditer(text))
    if "@" in text:
        add("email", matches(_EMAIL))
    add("ip", matches(_IP))
    add("iban", matches(_IBAN))
    add("card", matches(_CARD))
    add("ssn", matches(_SSN))
    parts, last = [], 0
    for a, b, _ in sorted(taken):
        parts += [text[last:a], "x" * (b - a)]
        last = b
    bare = "".join([*parts, text[last:]])
    for kind in _PHONES:
        add("phone", _numbers(bare, *kind))
    add("phone", ((a, b) for a, b in matches(_PHONE) if 9 <= sum(map(str.isdigit, text[a:b])) <= 15 and not _DATE.fullmatch(text[a:b])))
    for kind in _LOCAL:
        add("phone", _numbers(bare, *kind))
    if any(t in text for t in TITLES):
        named = [m.span(1) for m in _NAME.finditer(text)]
        words = {w for a, b in named for w in re.findall(r"[^\W\d_]+", text[a:b])}
        if words:
            again = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, words), key=len, reverse=True))})(?!\w)")
            add("name", matches(again))
    return sorted(taken)


def replace(text: str, key: bytes = KEY) -> tuple[str, list[tuple[int, int, str]], list[tuple[str, str, str]]]:
    """The text with surrogates, the entities' places in the old text, and (type, entity, surrogate) of each."""
    spans = find(text)
    out, last, used = [], 0, []
    for a, b, kind in spans:
        new = surrogate(key, kind, text[a:b])
        used.append((kind, text[a:b], new))
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), spans, used


def _candidates(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows that can hold an entity: an @, seven digits, or the letters of a form of address."""
    total = np.r_[0, np.cumsum((raw >= 48) & (raw <= 57))]
    at = np.r_[0, np.cumsum(raw == 64)]
    may = (total[bounds[1:]] - total[bounds[:-1]] >= 4) | (at[bounds[1:]] > at[bounds[:-1]])
    data = raw.tobytes()
    for title in TITLES:
        word = title.encode()
        k = data.find(word)
        while k >= 0:
            row = int(np.searchsorted(bounds, k, side="right")) - 1
            may[row] = True
            k = data.find(word, int(bounds[row + 1]))
    return may


def pseudonymize(docs: DataFrame, key: bytes = KEY, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id_, text (with surrogates), n_<type> of each type, n_distinct, n_collisions, spans (`type:start:end`, in code points of the old text) for every row.

    n_distinct counts different entities of the row, n_collisions those that share a surrogate with another (0).
    """
    small_batches(docs.sparkSession)
    names = ["id_", "text", *(f"n_{t}" for t in TYPES), "n_distinct", "n_collisions", "spans"]

    def run(batches):
        for batch in batches:
            raw, bounds = text_buffers(batch.column(1))
            for a, b in pieces(bounds):
                part = batch.column(1)[a:b]
                may = _candidates(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                texts = part.to_pylist()
                counts = np.zeros((len(TYPES) + 2, b - a), np.int64)
                places = [""] * (b - a)
                for k in np.flatnonzero(may):
                    if texts[k]:
                        texts[k], spans, used = replace(texts[k], key)
                        for _, _, kind in spans:
                            counts[TYPES.index(kind), k] += 1
                        distinct = set(used)
                        counts[-2, k] = len({x[:2] for x in distinct})
                        counts[-1, k] = len(distinct) - len({(x[0], x[2]) for x in distinct})
                        places[k] = ",".join(f"{kind}:{x}:{y}" for x, y, kind in spans)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(texts, part.type), *map(pa.array, counts), pa.array(places, pa.string())], names)

    kind = docs.schema[id_].dataType.simpleString()
    schema = ", ".join([f"id_ {kind}", "text string", *(f"n_{t} long" for t in TYPES), "n_distinct long", "n_collisions long", "spans string"])
    return docs.select(id_, text).mapInArrow(run, schema).withColumnRenamed("id_", id_)


def entities(docs: DataFrame, key: bytes = KEY, text: str = "text") -> DataFrame:
    """type, entity, surrogate, n: every different entity of a corpus with its surrogate."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            used = [u for t in batch.column(0).to_pylist() if t for u in replace(t, key)[2]]
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for u in used], pa.string()) for k in range(3)], ["type", "entity", "surrogate"])

    return docs.select(text).mapInArrow(run, "type string, entity string, surrogate string").groupBy("type", "entity", "surrogate").agg(F.count("*").alias("n"))


def collisions(found: DataFrame) -> DataFrame:
    """type, surrogate, n of surrogates that stand for several entities of a corpus, from what `entities` returns."""
    return found.groupBy("type", "surrogate").agg(F.countDistinct("entity").alias("n")).where("n > 1")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"))
