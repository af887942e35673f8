"""Surrogates for personal data: keyed, of the same type and format, one for one.

Each value is a number in the range of its format (its separators, digits, vowels and consonants of its script, or a
list of names of one gender and script). A keyed permutation without fixed points sends it to another number of that
range. So equal values get equal surrogates in all documents, different ones different surrogates, without a table.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import add_columns, id_text, stored

ROUNDS = 8

# First names by script and gender, and titles that tell a gender.
NAMES = {
    ("latin", "f"): "anna maria emma sophie laura julia clara elena marie lucia sarah helen alice carmen ingrid nora",
    ("latin", "m"): "john peter paul james thomas david martin carlos pierre hans luis michael robert jean karl oscar",
    ("cyrillic", "f"): "анна мария елена ольга наталья татьяна ирина светлана",
    ("cyrillic", "m"): "иван пётр сергей алексей дмитрий андрей николай михаил",
    ("greek", "f"): "μαρία ελένη αικατερίνη σοφία άννα ειρήνη",
    ("greek", "m"): "γιώργος νίκος κώστας δημήτρης γιάννης παύλος",
}
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Doña", "госпожа", "Госпожа", "κυρία", "Κυρία"),
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Sr", "Señor", "Don", "господин", "Господин", "κύριος", "Κύριος"),
    "": ("Dr", "Prof", "Professor"),
}
# Vowels and consonants of a script, lower case.
SOUNDS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
}

# Calling codes of two digits; those that begin with 1 or 7 have one, all others three.
CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
    "81 82 84 86 90 91 92 93 94 95 98".split()
)
# The letters that given names of a gender end on, by script.
ENDINGS = {
    ("latin", "f"): "ae", ("latin", "m"): "bdfgklmnoprstvxz",
    ("cyrillic", "f"): "аья", ("cyrillic", "m"): "бвгджзйклмнопрстфхцчшщ",
    ("greek", "f"): "αηωάή", ("greek", "m"): "νςρξ",
}

LISTED = {name: (kind, i) for kind, names in NAMES.items() for i, name in enumerate(names.split())}
CLASS = {c: (script, kind) for script, both in SOUNDS.items() for kind, letters in enumerate(both) for c in letters}


class Entity(NamedTuple):
    """A span of a text, its kind, its normal form and its surrogate."""

    start: int
    end: int
    kind: str
    value: str
    surrogate: str


class Key:
    """Keyed permutations of ranges."""

    def __init__(self, key: bytes):
        self.key = key

    def number(self, *parts: object, bits: int = 64) -> int:
        digest = hashlib.blake2b("\0".join(map(str, parts)).encode(), key=self.key, digest_size=(bits + 7) // 8)
        return int.from_bytes(digest.digest(), "big") & ((1 << bits) - 1)

    def _mix(self, x: int, half: int, tweak: str, back: bool) -> int:
        """A Feistel network on 2 * half bits, or its inverse."""
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ self.number(tweak, r, a, bits=half), a
            else:
                a, b = b, a ^ self.number(tweak, r, b, bits=half)
        return (a << half) | b

    def _permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:  # walks on until it is back in the range: still one to one
            x = self._mix(x, half, tweak, back)
            if x < n:
                return x

    def other(self, x: int, n: int, tweak: str) -> int:
        """Another number below n, one to one: a shift between a permutation and its inverse has no fixed point."""
        if n < 2:
            raise ValueError("there is no other")
        shift = 1 + self.number("shift", tweak, n) % (n - 1)
        return self._permute((self._permute(x, n, tweak) + shift) % n, n, tweak, back=True)


def _letters(text: str, vowels: bool) -> tuple[list[str], list[int], str]:
    """What may stand at each place, which place holds what, and the places that stay as they are."""
    choices, numbers, frame = [], [], ""
    for c in text:
        if c.isascii() and c.isdigit():
            own = "0123456789"
        elif c in CLASS:
            script, kind = CLASS[c]
            own = SOUNDS[script][kind] if vowels else "".join(sorted(SOUNDS[script][0] + SOUNDS[script][1]))
        else:
            own = ""
        frame += own[:1] or c
        if own:
            choices.append(own)
            numbers.append(own.index(c))
    return choices, numbers, frame


def scramble(key: Key, text: str, kind: str, vowels: bool = False, keep_last: bool = False) -> str:
    """Another text of the same format: each digit a digit, each letter one of its script; other characters stay.

    A text with no digit or known letter becomes a keyed name.
    """
    head, tail = (text[:-1], text[-1:]) if keep_last and len(text) > 2 else (text, "")
    choices, numbers, frame = _letters(head, vowels)
    n = 1
    for own in choices:
        n *= len(own)
    if n < 2:
        return f"x{key.number(kind, text):016x}"
    x = 0
    for own, number in zip(choices, numbers):
        x = x * len(own) + number
    x = key.other(x, n, f"{kind} {frame} {tail}")
    out = list(head)
    places = [k for k, c in enumerate(head) if (c.isascii() and c.isdigit()) or c in CLASS]
    for place, own in zip(reversed(places), reversed(choices)):
        x, number = divmod(x, len(own))
        out[place] = own[number]
    return "".join(out) + tail


def like(pattern: str, text: str) -> str:
    """``text`` with upper case where ``pattern`` has it."""
    if len(pattern) == len(text):
        return "".join(t.upper() if p.isupper() else t for p, t in zip(pattern, text))
    return text.upper() if pattern.isupper() else text.capitalize() if pattern[:1].isupper() else text


def email(key: Key, value: str) -> str:
    """Local part and domain each get their own, so addresses of one domain stay together; the last two labels of a
    reserved example domain, and every top level, stay."""
    local, _, domain = value.partition("@")
    labels = domain.split(".")
    stay = 2 if labels[-2] == "example" else 1
    own = [scramble(key, label, "domain", vowels=True) for label in labels[:-stay]]
    return scramble(key, local, "local", vowels=True) + "@" + ".".join([*own, *labels[-stay:]])


def digits(key: Key, value: str, kind: str, keep: int = 0) -> str:
    return value[:keep] + scramble(key, value[keep:], f"{kind} {value[:keep]}")


def luhn(number: str) -> int:
    """The check digit that belongs behind a number."""
    double = (sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(number)))
    return -sum(double) % 10


def account(key: Key, value: str) -> str:
    """Keeps the first digit and whether the check digit is right (or how far off it is)."""
    off = (int(value[-1]) - luhn(value[:-1])) % 10
    body = digits(key, value[:-1], f"account {off}", keep=1)
    return body + str((luhn(body) + off) % 10)


def country(value: str) -> int:
    """How many leading digits of an international number are its country's: they tell it, whatever the spacing."""
    return 1 if value[0] in "17" else 2 if value[:2] in CODES else 3


def phone(key: Key, value: str) -> str:
    """Another number of the same country and length."""
    return digits(key, value, f"phone {len(value)}", keep=country(value))


PRIVATE = ((10 << 24, 8), ((172 << 24) + (16 << 16), 12), ((192 << 24) + (168 << 16), 16), (127 << 24, 8))


def _network(x: int) -> int:
    return next((k for k, (base, bits) in enumerate(PRIVATE) if x >> (32 - bits) == base >> (32 - bits)), -1)


def address(key: Key, value: str) -> str:
    """Another address of the same network, if that is a private one, else another public one."""
    x = 0
    for part in value.split("."):
        x = x * 256 + int(part)
    first, network = x, _network(x)
    while True:
        x = key.other(x, 1 << 32, "address") if network < 0 else _inside(key, x, network)
        if _network(x) == network and x != first:
            return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _inside(key: Key, x: int, network: int) -> int:
    base, bits = PRIVATE[network]
    return base + key.other(x - base, 1 << (32 - bits), f"address {network}")


def name(key: Key, word: str, gender: str = "") -> str:
    """A listed name becomes another one of its script and gender; any other one is respelled, and never becomes a
    listed one.

    A family name keeps its last letter, which tells a gender in some languages. A given name of known gender gets
    that gender's kind of ending: its own letter where that is one, else a syllable behind it.
    """
    if word in LISTED:
        kind, k = LISTED[word]
        names = NAMES[kind].split()
        return names[key.other(k, len(names), "name " + " ".join(kind))]
    ending = _ending(key, word, gender) if gender else ""
    while True:
        word = scramble(key, word, f"name {gender}".rstrip(), vowels=True, keep_last=True)
        if word + ending not in LISTED:
            return word + ending


def _ending(key: Key, word: str, gender: str) -> str:
    script = next((CLASS[c][0] for c in word if c in CLASS), "latin")
    fit = ENDINGS[script, gender]
    if word[-1] in fit:
        return ""
    last = fit[key.number("ending", gender, word) % len(fit)]
    # between two vowels, and between two consonants, goes one of the other kind
    vowels, consonants = SOUNDS[script]
    between = ""
    if word[-1] in vowels and last not in consonants:
        between = consonants[key.number("between", word) % len(consonants)]
    elif word[-1] not in vowels and last not in vowels:
        between = vowels[key.number("between", word) % len(vowels)]
    return between + last


_TITLE = "|".join(sorted((re.escape(t) for titles in TITLES.values() for t in titles), key=len, reverse=True))
GENDER = {t: gender for gender, titles in TITLES.items() for t in titles}
_PART = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_WORD = rf"[^\W\d_a-zа-яα-ω](?:['’]{_PART}|{_PART})"
_INITIALS = r"(?:[^\W\d_a-zа-яα-ω]\.[ \t]*)*"
TITLED = re.compile(rf"\b({_TITLE})\b\.?[ \t]+{_INITIALS}({_WORD}(?:[ \t]+{_INITIALS}{_WORD}){{0,2}})")
WORD = re.compile(_WORD)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
KINDS = (
    ("email", re.compile(r"(?<![\w.%+-])[^\W_][\w.%+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])"), "@"),
    ("address", re.compile(rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)", re.ASCII), "."),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.ASCII), "-"),
    ("phone", re.compile(r"(?<![\w+])\+[1-9](?:[ .-]?\(?\d\)?){7,14}(?!\w)", re.ASCII), "+"),
    ("phone", re.compile(r"(?<![\w(.-])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)", re.ASCII), ""),
    ("account", re.compile(r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)", re.ASCII), ""),
)


def _replaced(key: Key, kind: str, found: str) -> tuple[str, str]:
    """Normal form and surrogate of a value as it was found."""
    if kind == "email":
        value = found.lower()
        return value, like(found, email(key, value))
    if kind == "address":
        return found, address(key, found)
    value = "".join(c for c in found if c.isdigit())
    if kind == "account":
        new = account(key, value)
    elif kind == "phone":
        # a number without a country is one of the plan whose code is 1
        whole = f"1{value}" if found[0] != "+" and len(value) == 10 else value
        value, new = f"+{whole}", phone(key, whole)[len(whole) - len(value) :]
    else:
        new = digits(key, value, kind)
    it = iter(new)
    return value, "".join(next(it) if c.isdigit() else c for c in found)


def _names(text: str) -> dict[str, str]:
    """The words behind titles in lower case, with the gender of given names; "" for others.

    Of several words the last is the family's; a single one is a family name, unless it is a given name elsewhere.
    """
    known: dict[str, str] = {}
    for m in TITLED.finditer(text):
        *given, family = (w.lower() for w in WORD.findall(m.group(2)))
        known.setdefault(family, "")
        for word in given:
            known[word] = known.get(word) or GENDER[m.group(1)]
    return known


def entities(text: str, key: Key) -> list[Entity]:
    """Personal data in a whole text, from left to right, without overlaps.

    Names are found behind titles; the same words count as names wherever else they stand in the text, in any case.
    """
    found = []
    for rank, (kind, pattern, sign) in enumerate(KINDS):
        if sign in text:
            found += [(m.start(), rank, m.end(), kind, m.group()) for m in pattern.finditer(text)]
    known = _names(text)
    if known:
        words = "|".join(sorted(map(re.escape, known), key=lambda w: (-len(w), w)))
        again = re.compile(rf"(?<!\w)(?:{words})(?!\w)", re.IGNORECASE)
        found += [(m.start(), len(KINDS), m.end(), "name", m.group()) for m in again.finditer(text)]
    out, last = [], 0
    for start, _, end, kind, own in sorted(found):
        if start >= last:
            if kind == "name":
                value = own.lower()
                gender = known.get(value, "")
                surrogate = like(own, name(key, value, gender))
                value = f"{value} {gender}".rstrip()
            else:
                value, surrogate = _replaced(key, kind, own)
            out.append(Entity(start, end, kind, value, surrogate))
            last = end
    return out


def rewrite(text: str, found: list[Entity]) -> str:
    out, last = [], 0
    for e in found:
        out += [text[last : e.start], e.surrogate]
        last = e.end
    return "".join([*out, text[last:]])


FOUND = "struct<start: long, end: long, kind: string, value: string, surrogate: string>"


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text with surrogates for personal data; one row for each input row.

    Result: doc_id, text, n_entities and found (start, end in the old text, kind, keyed hash of the value, surrogate).
    Without the ``key`` nothing of the old values can be told from it. Null and empty texts are empty and have none;
    a null id stays null; repeated rows give repeated results. Other columns are not read, whatever they are called.
    No row gives no row.

    Texts are rewritten in one pass without a shuffle and stored. Of values that share a surrogate (see
    ``collisions``) all but one then go through a further keyed round, in all texts alike, until none do.
    """
    if not key:
        raise ValueError("surrogates need a key")
    secret = hashlib.blake2b(key.encode()).digest()

    def make():
        own = Key(secret)

        def new(batch):
            texts = batch.column("text").to_pylist()
            found = [entities(t, own) for t in texts]
            rows = [
                [(e.start, e.end, e.kind, f"{own.number(e.kind, e.value, bits=128):032x}", e.surrogate) for e in es]
                for es in found
            ]
            return [pa.array([rewrite(t, es) for t, es in zip(texts, found)], pa.string()), _told(rows)]

        return new

    texts = id_text(docs, id_col, text_col)
    done = add_columns(texts, f"rewritten string, found array<{FOUND}>", make, ["doc_id"])
    # a number of each row, which is stored with it
    done = stored(done.withColumn("row", F.monotonically_increasing_id()), "surrogates")
    turn = 0
    while True:
        later = stored(_later(done), "later")
        if later.isEmpty():
            break
        turn += 1
        done = stored(_another_round(done, later, secret, turn), "surrogates")
    return done.select("doc_id", F.col("rewritten").alias("text"), F.size("found").cast("long").alias("n_entities"), "found")


def _told(rows: list[list[tuple]]) -> pa.Array:
    names = ("start", "end", "kind", "value", "surrogate")
    kind = pa.list_(pa.struct([(n, pa.int64() if n in names[:2] else pa.string()) for n in names]))
    return pa.array([[dict(zip(names, r)) for r in es] for es in rows], kind)


def _each(done: DataFrame) -> DataFrame:
    """(kind, value, surrogate): one row for each entity; the surrogate in lower case, of numbers the digits alone."""
    each = done.select(F.explode("found").alias("e")).select("e.kind", "e.value", "e.surrogate")
    digits_only = F.regexp_replace("surrogate", r"[^0-9+]", "")
    plain = F.when(F.col("kind").isin("phone", "account", "ssn"), digits_only).otherwise(F.lower("surrogate"))
    return each.withColumn("surrogate", plain)


def collisions(done: DataFrame) -> DataFrame:
    """(kind, surrogate, values): surrogates, upper and lower case alike, that stand for more than one value.

    Digits count without separators, since a value may be written in several formats.
    """
    found = _each(done).groupBy("kind", "surrogate").agg(F.count_distinct("value").alias("values"))
    return found.where("values > 1")


def _later(done: DataFrame) -> DataFrame:
    """(kind, value): of the values that share a surrogate all but the least."""
    each = _each(done).distinct()
    shared = each.groupBy("kind", "surrogate").agg(F.min("value").alias("first"), F.max("value").alias("last"))
    both = each.join(shared.where("first < last").select("kind", "surrogate", "first"), ["kind", "surrogate"])
    return both.where("value != first").select("kind", "value").distinct()


def _another_round(done: DataFrame, later: DataFrame, secret: bytes, turn: int) -> DataFrame:
    """``done`` with the surrogates of some values replaced once more, by a key of their own."""

    def make():
        def new(batch):
            texts, rows = [], []
            columns = [batch.column(c).to_pylist() for c in ("rewritten", "found", "again")]
            for text, found, again in zip(*columns):
                moved, out, last, shift, own = set(map(tuple, ((a["kind"], a["value"]) for a in again))), [], 0, 0, []
                for e in found:
                    start, old = e["start"] + shift, e["surrogate"]
                    shift += len(old) - (e["end"] - e["start"])
                    fresh = old
                    if (e["kind"], e["value"]) in moved:
                        keyed = hashlib.blake2b(f"{turn} {e['kind']} {e['value']}".encode(), key=secret[:64]).digest()
                        fresh = _once_more(Key(keyed), e["kind"], old)
                    out += [text[last:start], fresh]
                    last = start + len(old)
                    own.append((e["start"], e["end"], e["kind"], e["value"], fresh))
                texts.append("".join([*out, text[last:]]))
                rows.append(own)
            return [pa.array(texts, pa.string()), _told(rows)]

        return new

    each = done.select("row", F.explode("found").alias("e")).select("row", "e.kind", "e.value").distinct()
    hit = each.join(later, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("kind", "value")).alias("again"))
    both = done.join(hit, "row", "left")
    moved = both.where("again IS NOT NULL")
    moved = add_columns(moved, f"text string, entities array<{FOUND}>", make, ["doc_id", "row"])
    moved = moved.select("doc_id", F.col("text").alias("rewritten"), F.col("entities").alias("found"), "row")
    return both.where("again IS NULL").drop("again").unionByName(moved)


def _once_more(key: Key, kind: str, surrogate: str) -> str:
    if kind == "name":
        return like(surrogate, name(key, surrogate.lower()))
    return _replaced(key, kind, surrogate)[1]
