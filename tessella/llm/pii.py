"""Personal data replaced by surrogates of the same kind, form, script and gender.

Detection: patterns for e-mail addresses, IPv4 and IPv6 addresses, card numbers, phone numbers, social security
numbers, IBANs and secrets (named ones up to their delimiter, vendors' keys, long hexadecimal strings, private keys). Names are
told by their context: a title, a listed given name, a phrase that introduces a name, a verb of
saying, or an e-mail address beside them that is made of them; and by what the same document told before (a
surname alone). Nothing has a greatest length.

Surrogates are made from the canonical form of an entity and written in the form of the mention, so
one entity has one surrogate in all documents (coreference), however it is written. The map of a kind
is x -> P^-1(P(x) + 1) for a keyed permutation P of all entities of that form (a Feistel network over digits,
small letters, vowels or consonants; separators and capitals stay): one-to-one, so two entities have two surrogates
(distinctness), and no entity is its own. IPv4 addresses are permuted as 32-bit numbers, IPv6 addresses by
their non-zero groups; a card number keeps whether its check digit is right, an IBAN too; phone numbers and IBANs keep
the country's code; listed given names are permuted among those of their script and gender, other words of a name letter
by letter, Slavic endings stay. Names are mapped word by word, so a surname is the same with and without a title.

Collision check: each text is searched once and stored with its (kind, canonical entity, canonical form of
what was written) rows. These are grouped both ways; an entity with two surrogates or a
surrogate of two entities stops the run before any text is handed out.

The key comes from the caller. The query and the pipeline take spark.tessella.pii.key from the session and
draw a key for the run where it is unset: then nobody can invert the surrogates, nor link those of two runs.

Defined cases: null text stays null; texts without entities are not touched; very long texts are searched
whole, one at a time; rows are judged each on its own, so repeated rows give equal results; of two entities
that overlap the earlier one counts, of those with one start the longer; an empty table gives an empty result; further
columns are untouched, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import secrets
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, documents, durable, slices

ROUNDS = 8

# Listed given names by script and gender (u: either).
GIVEN = {
    ("latin", "f"): "Alice Anna Carmen Charlotte Clara Elena Emily Emma Hannah Isabel Julia Laura Lea Lucia Maria Marie Olivia Sarah Sofia".split(),
    ("latin", "m"): "Adam Antoine Carlos Daniel David Hans James John Jose Jules Lukas Luis Marc Martin Michael Paul Peter Robert Thomas".split(),
    ("latin", "u"): "Alex Andrea Camille Dominique Jan Kim Robin".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Надежда Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
LISTED = {n.lower(): (group, k) for group, names in GIVEN.items() for k, n in enumerate(names)}
# Titles.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Dr", "Prof", "Господин", "Госпожа"]
# Phrases that a name follows.
CUES = [
    "my name is ", "My name is ", "name: ", "Name: ", "I am called ", "Dear ", "dear ", "Regards,", "regards,", "Sincerely,", "Yours truly,", "signed by ", "Signed by ", "Signed: ",
    "contact: ", "Contact: ", "author: ", "Author: ", "je m'appelle ", "Je m'appelle ", "Nom : ", "Cher ", "Chère ", "Cordialement,", "ich heiße ", "Ich heiße ", "mein Name ist ", "Mein Name ist ",
    "Liebe ", "Lieber ", "Mit freundlichen Grüßen", "me llamo ", "Me llamo ", "mi nombre es ", "Mi nombre es ", "Nombre: ", "Estimado ", "Estimada ", "Atentamente,", "меня зовут ", "Меня зовут ", "Имя: ",
]
# Words that follow a name of two words or more.
VERBS = [" said", " says", " wrote", " writes", " told", " was born", " lives", " a dit", " écrit", " sagte", " schrieb", " dijo", " escribió", " сказал", " написал"]
# Words inside a name that are not capital.
PARTICLES = ["de", "da", "del", "della", "der", "den", "di", "dos", "du", "la", "le", "van", "von", "bin", "al", "ter"]

DIGITS = "0123456789"
HEX = "0123456789abcdef"
SIGNS = "!#$%&()*+-./:=?@^_{|}~"
# Letters that are permuted among themselves: alphabets, and scripts by their range.
LETTERS = [
    "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ",
    *("".join(map(chr, range(a, b))) for a, b in ((0x5D0, 0x5EB), (0x621, 0x63B), (0x641, 0x64B), (0x905, 0x93A), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0xA000), (0xAC00, 0xD7A4))),
]
SOUNDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "àáâãäåæèéêëìíîïòóôõöøùúûüý", *LETTERS[4:]]


def places(*alphabets: str) -> dict[str, tuple[int, int]]:
    """By letter: the number of its alphabet, and its place there."""
    return {c: (k, i) for k, alphabet in enumerate(alphabets) for i, c in enumerate(alphabet)}


PLAIN = [DIGITS, *LETTERS]
CASED = [DIGITS, LETTERS[0], LETTERS[0].upper(), LETTERS[1], LETTERS[1].upper(), LETTERS[2], LETTERS[2].upper(), LETTERS[3], LETTERS[3].upper(), *LETTERS[4:]]
SETS = {name: (alphabets, places(*alphabets)) for name, alphabets in {"plain": PLAIN, "cased": CASED, "hex": [HEX], "HEX": [HEX.upper()], "digits": [DIGITS], "sounds": SOUNDS, "signs": [SIGNS]}.items()}

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
ENTITY = re.compile(
    "|".join([
        rf"(?P<ip>(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d))",
        r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
        r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
        r"(?P<card>(?<![\d.])\d{4}(?P<gap>[ -]?)(?:\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{6}(?P=gap)\d{5})(?!\d))",
        r"(?P<phone>\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+[2-9]\d{0,2}[ .-]\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\d-])|\+[2-9]\d{6,14}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])|(?<![\d.-])(?<!\d )\d{3} \d{3} \d{4}(?![\d.-])(?! \d))",
        r"(?P<secret>(?<![^\s=:\"'])(?:(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}|(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,})(?![\w-]))",
    ])
)
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]*:[0-9A-Fa-f:]*:[0-9A-Fa-f]*(?![\w:])")
DOMAIN = re.compile(r"@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)+(?<!-)")
# How vendors' keys begin, and what follows.
VENDOR = re.compile(r"(?<![\w-])(?P<prefix>AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|sk-|xox[abprs]-|AIza|eyJ)(?P<rest>[\w-]{16,}(?:\.[\w-]+)*)")
PRIVATE = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<secret>[^-]+)-----END")
# A secret runs to its delimiter. After a password's key it may be short and hold other signs; within quotes, blanks too.
KEYED = re.compile(
    r"(?i)(?<![^\W_])(?:"
    r"(?:api[_-]?key|access[_-]?key|secret|token)\b[\"']?\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_+/.~=-]{11,}[A-Za-z0-9_+/~=-])"
    r"|password\b[\"']?\s*[=:]\s*(?:\"(?P<double>[^\"\n]{4,})\"|'(?P<single>[^'\n]{4,})'|(?P<bare>[^\s\"',;<>]{3,}[^\s\"',;<>.)\]}]))"
    r")"
)
# Country codes that no separator ends: 1, 7, the codes of two digits, else three.
COUNTRY = re.compile(r"\+(1|\d{1,3}(?=[ .-])|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
PART = 256
UPPER = "A-ZÀ-ÖØ-ÞА-ЯΑ-Ω"
CAPITAL = rf"(?:[{UPPER}](?:\.|[\w'’-]+))"
FULL = rf"{CAPITAL}(?: (?:(?:{'|'.join(PARTICLES)}) )*{CAPITAL})"
CAPITALS = re.compile(rf"\b[{UPPER}][\w-]*").findall
START = re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.? (?P<titled>{FULL}*)|(?P<listed>(?:{'|'.join(n for names in GIVEN.values() for n in names)})(?: (?:(?:{'|'.join(PARTICLES)}) )*{CAPITAL})+))")
STARTS = {*TITLES, *(n for names in GIVEN.values() for n in names)}
NEXT = re.compile(rf"[\s:]*(?P<name>{FULL}+)")
BEFORE = re.compile(rf"(?P<name>{FULL}+)(?P<gap>[ \t]*[<(\[,:-]?[ \t]*)\Z")
ENDING = re.compile(r"(?s)(?P<stem>.+)(?P<end>(?:ов|ев|ёв|ин)а?)")
RARE = b"0123456789@"


def find(text: str, marked: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, without overlaps. marked: the text has a digit or an at sign."""
    found, mails = [], []
    if marked:
        for at in DOMAIN.finditer(text):
            start = at.start()
            while start and (text[start - 1].isalnum() or text[start - 1] in "._+-"):
                start -= 1
            while start < at.start() and not text[start].isalnum():
                start += 1
            if start < at.start():
                mails.append((start, at.end(), "email"))
        found += mails
        found += [(*m.span(m.lastgroup if m.lastgroup != "gap" else "card"), "card" if m.lastgroup == "gap" else m.lastgroup) for m in ENTITY.finditer(text)]
        if text.count(":") > 1:
            found += [(*m.span(), "ipv6") for m in IPV6.finditer(text) if is_ipv6(m[0])]
        found += [(*m.span(), "secret") for m in VENDOR.finditer(text)]
    low = text.lower()
    if "key" in low or "secret" in low or "token" in low or "password" in low:
        found += [(*m.span(m.lastgroup), "secret") for m in KEYED.finditer(text)]
        found += [(*m.span("secret"), "secret") for m in PRIVATE.finditer(text)]
    found += [(a, b, "name") for a, b in names(text, mails)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def is_ipv6(text: str) -> bool:
    try:
        return int(ipaddress.IPv6Address(text)) > 1 and any(c in DIGITS for c in text)
    except ValueError:
        return False


def occurrences(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def names(text: str, mails: list[tuple]) -> list[tuple[int, int]]:
    found = []
    if not STARTS.isdisjoint(CAPITALS(text)):
        found += [m.span(m.lastgroup) for m in START.finditer(text)]
    for cue in CUES:
        for at in occurrences(text, cue):
            if m := NEXT.match(text, at + len(cue)):
                found.append(m.span("name"))
    for verb in VERBS:
        for at in occurrences(text, verb):
            if m := before(text, at):
                found.append(m.span("name"))
    for start, end, _ in mails:
        if (m := before(text, start)) and set(plain(m["name"]).split()) & set(re.split(r"[\W_\d]+", plain(text[start:end].partition("@")[0]))):
            found.append(m.span("name"))
    out = []
    for a, b in found:
        b -= len(text[a:b]) - len(text[a:b].rstrip("'’-"))
        if text[a:b].endswith(("'s", "’s")):
            b -= 2
        while (first := text[a:b].partition(" "))[1] and first[0].rstrip(".") in TITLES:
            a += len(first[0]) + 1
        out.append((a, b))
    # Surnames alone, told by the full names of this document.
    for last in {text[a:b].split()[-1] for a, b in out if " " in text[a:b]}:
        if len(last) > 2:
            out += [(at, at + len(last)) for at in occurrences(text, last) if not (at and (text[at - 1].isalnum() or text[at - 1] in "@.-_/")) and not text[at + len(last) : at + len(last) + 1].isalnum()]
    return out


def before(text: str, at: int) -> re.Match | None:
    """A name of two words or more that ends before at: walked back word by word, so it may have any length."""
    start = at
    while start and (text[start - 1].isalnum() or text[start - 1] in " \t.'’<([,:-"):
        start -= 1
        if start and text[start - 1] == " " and not (text[start].isupper() or text[start] in "<([,:-" or any(text.startswith(p + " ", start) for p in PARTICLES)):
            break
    return BEFORE.search(text, start, at)


def plain(text: str) -> str:
    """Small letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


class Surrogates:
    """Keyed, one-to-one maps that leave no entity as it is."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()
        self.round = functools.lru_cache(4096)(self._round)
        self.known: dict[tuple[str, str], str] = {}

    def _round(self, tweak: str, n: int, half: int, size: int) -> int:
        data = f"{tweak}|{n}|{half}".encode()
        if size.bit_length() > 128:  # 24 bytes would leave the upper symbols of a long half as they are
            return int.from_bytes(hashlib.shake_256(self.key + b"|" + data).digest(size.bit_length() // 8 + 17), "big") % size
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=24).digest(), "big") % size

    def number(self, x: int, left: int, right: int, tweak: str) -> int:
        """The next number after x, below left * right, in the order of a keyed permutation."""
        a, b = divmod(x, right)
        for k in range(0, ROUNDS, 2):
            a = (a + self.round(tweak, k, b, left)) % left
            b = (b + self.round(tweak, k + 1, a, right)) % right
        a, b = divmod((a * right + b + 1) % (left * right), right)
        for k in reversed(range(0, ROUNDS, 2)):
            b = (b - self.round(tweak, k + 1, a, right)) % right
            a = (a - self.round(tweak, k, b, left)) % left
        return a * right + b

    def sequence(self, symbols: list[int], radix: int, tweak: str) -> list[int]:
        n = len(symbols)
        if n > PART:  # long secrets part by part, so that the work is linear
            return [d for at in range(0, n, PART) for d in self.sequence(symbols[at : at + PART], radix, f"{tweak}|{n}|{at}")]
        x = functools.reduce(lambda s, d: s * radix + d, symbols, 0)
        tweak = f"{tweak}|{n}|{radix}"
        if n == 1:
            order = sorted(range(radix), key=lambda d: (self.round(tweak, 0, d, 1 << 128), d))
            return [order[(order.index(x) + 1) % radix]]
        y = self.number(x, radix ** (n // 2), radix ** (n - n // 2), tweak)
        return [y // radix**k % radix for k in reversed(range(n))]

    def letters(self, text: str, kind: str, tweak: str) -> str:
        """Permutes the letters of each alphabet of SETS[kind] among themselves; all else stays in place."""
        alphabets, place = SETS[kind]
        out = list(text)
        at: dict[int, list[int]] = {}
        for i, c in enumerate(text):
            if c in place:
                at.setdefault(place[c][0], []).append(i)
        for k, where in at.items():
            new = self.sequence([place[text[i]][1] for i in where], len(alphabets[k]), f"{tweak}|{kind}|{k}")
            for i, d in zip(where, new, strict=True):
                out[i] = alphabets[k][d]
        return "".join(out)

    def of(self, kind: str, text: str) -> str:
        """The surrogate of an entity, written as text is."""
        if kind == "name":
            return " ".join(w if w in PARTICLES else "-".join(self.written(kind, p) for p in w.split("-")) for w in text.split(" "))
        return self.written(kind, text)

    def written(self, kind: str, text: str) -> str:
        entity = canonical(kind, text)
        if (made := self.known.get((kind, entity))) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            made = self.known[kind, entity] = self.made(kind, entity)
        if kind in ("email", "name"):
            return cased(text, made) if len(text) == len(entity) else made
        if kind == "phone":
            code = COUNTRY.match(text)
            keep = code.end() if code else 0
            return text[:keep] + refill(text[keep:], made.partition(":")[2])
        if kind in ("card", "ssn", "iban"):
            return refill(text, made, str.isalnum)
        if kind == "ipv6":
            return "".join(g.upper() if text.upper() == text else g for g in made)
        return made

    def made(self, kind: str, entity: str) -> str:
        """The canonical surrogate of a canonical entity."""
        if kind == "email":
            local, _, domain = entity.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.letters(local, 'plain', kind)}@{self.letters(host, 'plain', 'host')}.{top}"
        if kind == "ip":
            x = functools.reduce(lambda s, d: s * 256 + int(d), entity.split("."), 0)
            y = self.number(x, 1 << 16, 1 << 16, kind)
            return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))
        if kind == "ipv6":  # groups of zeros stay, so that the form does
            groups = ipaddress.IPv6Address(entity).exploded.split(":")
            at = [k for k, g in enumerate(groups) if int(g, 16)]
            for k, d in zip(at, self.sequence([int(groups[k], 16) - 1 for k in at], 65535, f"{kind}|{at}"), strict=True):
                groups[k] = f"{d + 1:x}"
            return str(ipaddress.IPv6Address(":".join(groups)))
        if kind == "card":
            digits = [int(c) for c in entity]
            new = self.sequence(digits[:-1], 10, kind)
            new.append((luhn(new) + digits[-1] - luhn(digits[:-1])) % 10)
            return "".join(map(str, new))
        if kind == "phone":
            code, _, number = entity.partition(":")
            return f"{code}:{self.letters(number, 'digits', f'{kind}|{code}')}"
        if kind == "ssn":
            return self.letters(entity, "digits", kind)
        if kind == "iban":
            land, check, rest = entity[:2], int(entity[2:4]), entity[4:]
            new = self.letters(rest, "cased", f"{kind}|{land}")
            return f"{land}{(iban_check(land, new) + check - iban_check(land, rest)) % 100:02d}{new}"
        if kind == "secret":
            if (v := VENDOR.fullmatch(entity)) and v["prefix"] != "eyJ":
                return v["prefix"] + self.letters(v["rest"], "cased", f"{kind}|{v['prefix']}")
            own = "hex" if len(entity) >= 32 and set(entity) <= set(HEX) else "HEX" if len(entity) >= 32 and set(entity) <= set(HEX.upper()) else "cased"
            new = self.letters(entity, own, kind)
            return new if new != entity else self.letters(entity, "signs", kind)
        return self.name(entity)

    def name(self, word: str) -> str:
        """A word of a name, in small letters."""
        if word in LISTED:
            group, k = LISTED[word]
            return GIVEN[group][self.sequence([k], len(GIVEN[group]), "|".join(group))[0]].lower()
        stem, end = (m["stem"], m["end"]) if (m := ENDING.fullmatch(word)) else (word, "")
        while True:  # on along the cycle past words of another kind, so that the map stays one-to-one
            stem = self.letters(stem, "sounds", f"name|{bool(end)}")
            if stem + end not in LISTED and (end or not ENDING.fullmatch(stem)):
                return stem + end


def luhn(digits: list[int]) -> int:
    """The check digit that belongs after digits."""
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(land: str, rest: str) -> int:
    """The check digits that belong to an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{land}00")) % 97


def refill(form: str, new: str, part=str.isdigit) -> str:
    """form with the characters of new in the places of its digits (or of what part says)."""
    following = iter(new)
    return "".join(next(following) if part(c) else c for c in form)


def cased(form: str, new: str) -> str:
    """new with the capitals of form; a word of another length is capital in front or throughout."""
    if len(form) == len(new):
        return "".join(n.upper() if f != f.lower() and len(n.upper()) == 1 else n for f, n in zip(form, new, strict=True))
    return new.upper() if len(form) > 1 and form == form.upper() else new[:1].upper() + new[1:] if form[:1] != form[:1].lower() else new


def canonical(kind: str, text: str) -> str:
    """What all mentions of one entity have in common."""
    if kind in ("email", "name"):
        return text.lower()
    if kind == "phone":
        code = COUNTRY.match(text)
        rest = text[code.end() :] if code else text
        return f"{code[1] if code else '1'}:{''.join(c for c in rest if c.isdigit())}"
    if kind in ("card", "ssn", "iban"):
        return "".join(c for c in text if c.isalnum())
    if kind == "ip":
        return ".".join(str(int(p)) for p in text.split("."))
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(text))
    return text


def replaced(text: str, makers: Surrogates, marked: bool = True) -> tuple[str, Counter, set[tuple[str, str, str]]]:
    """The text with surrogates, entities by kind, and (kind, canonical entity, canonical form of what was written) of each."""
    out, at, kinds, pairs = [], 0, Counter(), set()
    for start, end, kind in find(text, marked):
        new = makers.of(kind, text[start:end])
        out += [text[at:start], new]
        at = end
        kinds[kind] += 1
        if kind == "name":
            parts = zip(re.split("[ -]", text[start:end]), re.split("[ -]", new), strict=True)
            pairs |= {(kind, canonical(kind, a), canonical(kind, b)) for a, b in parts if a not in PARTICLES}
        else:
            pairs.add((kind, canonical(kind, text[start:end]), canonical(kind, new)))
    return "".join([*out, text[at:]]), kinds, pairs


def bodies(column: pa.Array) -> Iterator[tuple[str | None, bool]]:
    for b in column.cast(pa.binary()).to_pylist():
        yield (None, False) if b is None else (b.decode("utf-8", "replace"), len(b.translate(None, RARE)) < len(b))


KINDS = ["email", "ip", "ipv6", "iban", "ssn", "card", "phone", "secret", "name"]


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, or one drawn for this run."""
    named = spark.conf.get("spark.tessella.pii.key", None)
    return named.encode() if named else secrets.token_bytes(32)


def _searched(df: DataFrame, key: bytes, text_col: str) -> tuple[DataFrame, str, str]:
    """df with new texts, stored, and the names of two more columns: entities by kind, and the rows of the collision check."""
    kinds_col, pairs_col = (f"_{uuid.uuid4().hex}" for _ in range(2))
    pair = pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())])

    def run(batches):
        makers = Surrogates(key)
        for batch in batches:
            for piece in slices(batch, 8 << 20):
                done = [(None, Counter(), ()) if t is None else replaced(t, makers, m) for t, m in bodies(piece.column(text_col))]
                at = piece.schema.get_field_index(text_col)
                piece = piece.set_column(at, piece.schema.field(at), pa.array([d[0] for d in done], piece.schema.field(at).type))
                pairs = [[dict(zip(("kind", "entity", "surrogate"), p, strict=True)) for p in sorted(d[2])] for d in done]
                kinds = [[d[1][k] for k in KINDS] for d in done]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(kinds, pa.list_(pa.int64())), pa.array(pairs, pa.list_(pair))], names=[*piece.schema.names, kinds_col, pairs_col])

    schema = T.StructType([*df.schema.fields, T.StructField(kinds_col, T.ArrayType(T.LongType())), T.StructField(pairs_col, T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "entity", "surrogate")])))])
    return durable(df.mapInArrow(run, schema)), kinds_col, pairs_col


def collisions(pairs: DataFrame) -> int:
    """Entities of two surrogates and surrogates of two entities, of rows (kind, entity, surrogate)."""
    found = durable(pairs.distinct())
    two = [found.groupBy("kind", c).count().filter("count > 1").count() for c in ("entity", "surrogate")]
    discard(found)
    return sum(two)


def _checked(df: DataFrame, key: bytes, text_col: str) -> tuple[DataFrame, str, str]:
    out, kinds, pairs = _searched(df, key, text_col)
    if n := collisions(out.select(F.explode(pairs).alias("p")).select("p.*")):
        discard(out)
        raise ValueError(f"{n} entities or surrogates do not match one to one")
    return out, kinds, pairs


def replace_entities(df: DataFrame, key: bytes, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of df with surrogates in the text; length_col gets the new length in code points."""
    out = _checked(df, key, text_col)[0].select(*[f"`{c}`" for c in df.columns])
    return out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType)) if length_col in df.columns else out


def report(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, number of entities, numbers by kind and the new text of every row."""
    out, kinds, _ = _checked(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), key, "text")
    by_kind = [F.col(kinds)[i].alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", F.aggregate(kinds, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_entities"), *by_kind, "text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir), session_key(spark))
