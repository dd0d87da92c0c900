"""Surrogates for personal data.

Entities found in a text are replaced by keyed surrogates of the same type:
digits for digits, letters for letters in their case, a valid card for a valid
card, a public address for a public address, a name of the same gender, script
and form. A surrogate depends on the key and the entity alone, so every mention
in any document gets the same one (coreference); mentions that differ only in
layout or case count as one entity. A person is a name after a title, or a listed
given name with a further name. Names are whole words, whatever capitals, hyphens
and apostrophes are in them (McDonald, O'Brien); particles before them (van, von der)
stay. Where the first of several names isn't a listed given name, a title that says a gender is
kept in the entity, and the surrogate's given name begins with a listed one of
that gender; mentions of the name after other titles (Dr) follow where the corpus
has it with one gender only.

The key comes from the caller or the session's setting wayfold.pii.key; there is
none in the source. Where neither gives one, a random key is drawn for the
application, so surrogates hold within it and can't be undone afterwards.

Each type's mapping is a keyed permutation (a Feistel network walked until it
falls on a valid value), so different entities keep different surrogates; where it
would leave a value, or a word of a name, as it is, a further one is taken. A pass
over the corpus's distinct entities then finds surrogates that are themselves
entities of the corpus and replaces them by further permutations, each checked
against all originals and all surrogates. What eight of these can't free gets a
wider form (a further family name, a longer address, another network of private
addresses) until nothing is left; if a type's whole space were in use, it fails.
Birth dates are the exception: a large corpus holds every day there is, so their
surrogates are other days, distinct from each other, but may be entities too.

Entities are found once: rows go with their spans to the work folder.

A null text stays null, an empty one empty; a text without entities is returned
as it is. Repeated rows get equal results. Other columns are not read by the
query. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRIES = 8
#: Tries in the wider forms, each longer than the one before.
WIDER = 40
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CYRILLIC, GREEK = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"

#: Honorifics and the gender they say.
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "", "Prof": ""}
#: Given names by script and gender; their order is permuted by the key.
GIVEN = {
    ("latin", "m"): "James Robert John Michael David William Thomas Daniel Paul Mark George Peter Hans Karl Stefan Pierre Luc Carlos Javier Miguel Wei Hiroshi Kenji Rahul Amit Arjun Mohammed Ahmed Omar Marco Andreas Jürgen Wolfgang José Pablo Diego Henri Olivier".split(),
    ("latin", "f"): "Mary Patricia Linda Elizabeth Susan Sarah Karen Anna Laura Emma Julia Helen Ingrid Sabine Claire Sophie Marie Lucía Carmen Isabel Yuki Akiko Priya Anjali Fatima Aisha Olga Giulia Chiara Petra Monika Ursula María Camille Chloé Nathalie".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Николай Павел Михаил Виктор Олег".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Вера".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Ανδρέας Παύλος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
}
#: What is added to the tries of a mention that follows the entity of this gender.
FOLLOWS = {"m": 1000, "f": 2000}
GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}

# English months and words that stand for streets.
MONTHS = "January February March April May June July August September October November December".split()
STREETS = "Street St Road Rd Avenue Ave Lane Ln Drive Boulevard Blvd Court Square Terrace".split()
# Ends of German street names, particles of names, words before a telephone number.
ENDS = "straße strasse weg platz allee gasse".split()
PARTICLES = "van von de der den del della di da dos du la le el al bin ibn ten ter zu zum zur".split()
CUES = "phone telephone tel call mobile cell fax tél telefon teléfono".split()
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), 130 * 365
#: Days up to the end of 2025 stay among themselves, so nobody is born later than they were said to be.
PAST = date(2026, 1, 1).toordinal() - FIRST_DAY
#: Types whose surrogates may be entities of the corpus.
DENSE = ("birth",)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_U, _L = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ", "a-zà-öø-ÿα-ωά-ώа-яё"
_CAP = rf"[{_U}](?:['’][{_U}][{_L}]+|[{_L}]+)(?:['’]?[{_U}][{_L}]+)*"
#: A name, no part of a longer word; after a title any capitalised word, so that none is replaced by half.
_NAME = rf"{_CAP}(?:-{_CAP})*(?![^\W\d_])"
_TITLED = rf"[{_U}](?:(?:['’](?!s\b)|-)?[{_U}{_L}])+(?![^\W\d_])"
_OF = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
ENTITY = re.compile(
    "|".join(
        (
            r"(?P<email>[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+)",
            rf"(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d))",
            r"(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))",
            rf"(?P<birth>(?i:\b(?:born(?: on)?|date of birth|dob|birthday|birth date|geboren(?: am)?|née? le|nacid[oa] el)\b):? (?:\d{{4}}-\d\d-\d\d|\d{{1,2}}[./\-]\d{{1,2}}[./\-]\d{{4}}|\d{{1,2}} (?:{'|'.join(MONTHS)}) \d{{4}}|(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}})(?![\d\-]))",
            r"(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))",
            r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\d\-]))",
            rf"(?P<told>(?i:\b(?:{'|'.join(CUES)})\b)\.?:? ?(?:\(\d{{3}}\)|\d{{3}})[ .\-]?\d{{3}}[ .\-]?\d{{4}}(?![\w\-]))",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)",
            r"(?P<card>(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-]))",
            r"(?P<key>\bAKIA[0-9A-Z]{16}\b)",
            r"(?P<secret>(?i:\b(?:password|passwd|pwd|token|secret|api[_\-]?key|access[_\-]?key))\s*[=:]\s*[\"']?[A-Za-z0-9_\-+/]{8,})",
            rf"(?P<street>\b[1-9]\d{{0,3}} {_NAME}(?: {_NAME})? (?:{'|'.join(STREETS)})\b)",
            rf"(?P<strasse>\b[{_U}][{_L}]+(?:{'|'.join(ENDS)}) [1-9]\d{{0,3}}(?![\w.]\d))",
            rf"(?P<person>\b(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.? {_OF}{_TITLED}(?: {_OF}{_TITLED}){{0,2}})",
            rf"(?P<named>\b(?:{'|'.join(sorted(GENDER, key=len, reverse=True))})(?:-{_CAP})*(?: {_OF}{_NAME}){{1,2}})",
        )
    )
)
_HINT = re.compile(rf"[@\d]|AKIA|(?i:passw|pwd|token|secret|key)|\b(?:{'|'.join([*TITLES, *GENDER])})\b")
_VALUE = re.compile(r"[A-Za-z0-9_\-+/]{8,}\Z")


class Entity(NamedTuple):
    start: int
    end: int
    type: str
    value: str  # what counts as the entity, whatever its layout; m: or f: before a name whose gender only the title says


def luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def iban_check(code: str, bban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + code)) * 100 % 97:02d}"


def _listed(word: str) -> bool:
    return word in GENDER or word.split("-")[0] in GENDER


def detect(text: str) -> list[Entity]:
    if not text or not _HINT.search(text):
        return []
    found = []
    for m in ENTITY.finditer(text):
        kind, start, end, raw = m.lastgroup, m.start(), m.end(), m[0]
        if kind in ("phone", "card", "ssn"):
            value = re.sub(r"\D", "", raw)
            if kind == "phone":
                if not 9 <= len(value) <= 15:
                    continue
                value = (re.match(r"\+\d{1,3}(?=\D)|\+\d", raw) or [""])[0] + ":" + value
            if kind == "card" and not (int(value[-1]) == luhn(value[:-1]) and ("3" <= value[0] <= "6" or "22" <= value[:2] <= "27")):
                continue  # a number with another check digit, or of no card issuer
        elif kind == "email":
            value = raw.lower()
        elif kind == "iban":
            value = raw.replace(" ", "")
            if not 15 <= len(value) <= 34 or value[2:4] != iban_check(value[:2], value[4:]):
                continue
        elif kind == "secret":
            v = _VALUE.search(raw)
            start, value = start + v.start(), v[0]
            if not any(c.isdigit() for c in value):
                continue  # a word, not a credential
        elif kind == "ip6":
            value = _ip6(raw)
            if not value:
                continue
        elif kind == "birth":
            start += re.search(rf"\d{{4}}-|\d|{'|'.join(MONTHS)}", raw).start()
            value = _day(raw[start - m.start() :])
            if not value:
                continue
        elif kind == "told":
            start += re.search(r"\(?\d", raw).start()
            kind, value = "phone", ":" + re.sub(r"\D", "", raw)
        elif kind in ("street", "strasse"):
            kind, value = "street", raw
        elif kind == "named":
            kind, value = "person", raw
        elif kind == "person":
            title, value = re.fullmatch(r"(\w+)\.? (.*)", raw).groups()
            start = end - len(value)
            first = value.split(" ")[0]
            if TITLES[title] and " " in value and first not in PARTICLES and not _listed(first):
                value = f"{TITLES[title]}:{value}"
        else:
            value = raw
        found.append(Entity(start, end, kind, value))
    return found


def _ip6(raw: str) -> str:
    """An address in full form, else nothing: too short to be one, or a time of day."""
    if len(raw) < 6 or not any(c.isdigit() for c in raw):
        return ""
    try:
        return ipaddress.IPv6Address(raw).exploded
    except ValueError:
        return ""


def _layout(raw: str) -> tuple[str, int, int, int]:
    """The layout of a date, and its year, month and day; day before month unless only the other way is a date."""
    numbers = [int(x) for x in re.findall(r"\d+", raw)]
    named = next((i + 1 for i, x in enumerate(MONTHS) if x in raw), 0)
    if named:
        return ("dMy", numbers[1], named, numbers[0]) if raw[0].isdigit() else ("Mdy", numbers[1], named, numbers[0])
    if re.match(r"\d{4}", raw):
        return "y-m-d", *numbers
    d, m, y = numbers
    return ("dmy", y, m, d) if m <= 12 else ("mdy", y, d, m)


def _day(raw: str) -> str:
    _, y, m, d = _layout(raw)
    try:
        day = date(y, m, d)
    except ValueError:
        return ""
    return day.isoformat() if 0 <= day.toordinal() - FIRST_DAY < DAYS else ""


def _walk(domain: int, value: int, tweak: bytes, key: bytes) -> int:
    """A keyed permutation of range(domain)."""
    if domain < 2:
        return value
    half = max(1, ((domain - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    while True:
        a, b = value >> half, value & mask
        for r in range(8):
            h = hashlib.blake2b(b.to_bytes(size, "big") + bytes([r]) + tweak, key=key, digest_size=min(64, size + 8)).digest()
            a, b = b, a ^ (int.from_bytes(h, "big") & mask)
        value = a << half | b
        if value < domain:
            return value


def _hexadecimal(text: str) -> bool:
    """Long and of hexadecimal digits, letters among them."""
    return len(text) >= 16 and bool(re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", text))


def permute(text: str, tweak: bytes, key: bytes, ok: Callable[[str], bool] = lambda _: True) -> str:
    """Letters and digits for those of the same class; walks on until ok holds, which it must for text."""
    hexa = _hexadecimal(text)
    sets = ["0123456789abcdef" if hexa else next((a for a in (DIGITS, LOWER, UPPER, CYRILLIC, GREEK, CYRILLIC.upper(), GREEK.upper()) if c in a), c) for c in text]
    domain = 1
    for a in sets:
        domain *= len(a)
    tweak += b"/" + re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", text))).encode() if not hexa else b"/hex" + str(len(text)).encode()
    while True:
        n = 0
        for c, a in zip(text, sets, strict=True):
            n = n * len(a) + a.index(c)
        n = _walk(domain, n, tweak, key)
        out = []
        for a in reversed(sets):
            n, i = divmod(n, len(a))
            out.append(a[i])
        text = "".join(reversed(out))
        if ok(text) and _hexadecimal(text) == hexa:
            return text


def permute_hex(digits: str, tweak: bytes, key: bytes) -> str:
    return f"{_walk(16 ** len(digits), int(digits, 16), tweak, key):0{len(digits)}x}"


def _zone(ip: int) -> str:
    """Address classes that a surrogate keeps."""
    for name, net, bits in (("10", 10 << 24, 8), ("172", 172 << 24 | 16 << 16, 12), ("192", 192 << 24 | 168 << 16, 16), ("loop", 127 << 24, 8), ("link", 169 << 24 | 254 << 16, 16)):
        if ip >> (32 - bits) == net >> (32 - bits):
            return name
    return "none" if ip >> 24 == 0 else "public" if ip >> 24 < 224 else "multi"


def script_of(name: str) -> str:
    c = name[:1].lower()
    return "cyrillic" if "а" <= c <= "я" or c == "ё" else "greek" if "α" <= c <= "ω" or "ά" <= c <= "ώ" else "latin"


def _made(script: str, n: int, seed: bytes, key: bytes) -> str:
    """A made-up word of n letters, consonants and vowels in turn."""
    others, vowels = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αειου")}[script]
    h = int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=64).digest(), "big")
    out = []
    for i in range(n):
        h, x = divmod(h, len(vowels if i % 2 else others))
        out.append((vowels if i % 2 else others)[x])
    return "".join(out)


def _pick(names: list[str], seed: bytes, key: bytes) -> str:
    return names[int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=8).digest(), "big") % len(names)]


def _wider(kind: str, value: str, tweak: bytes, key: bytes, by: int, gender: str = "") -> str:
    """A surrogate of a larger space than the value's own form has; others may have the same one."""
    seed = tweak + value.encode()
    if kind == "person":
        words = [w for w in value.split(" ") if w not in PARTICLES]
        new = []
        for i, w in enumerate(words):
            script, known = GENDER.get(w, (script_of(w), ""))
            parts = [p for p in w.split("-") if p in GENDER]
            known = known or (GENDER[parts[0]][1] if parts else gender if i == 0 else "")
            names = [x for x in GIVEN.get((script, known), ()) if x not in (w, *parts)]
            new.append(_pick(names, seed + w.encode(), key) if names else _made(script, len(w) + 1, seed + w.encode(), key).capitalize())
        return " ".join([*new[:2], _made(script_of(words[-1]), min(4 + by, 40), seed, key).capitalize()])
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return f"{permute(local, tweak, key)}{_made('latin', min(2 + by, 40), seed, key)}@{permute(domain.rpartition('.')[0], tweak, key)}.{domain.rpartition('.')[2]}"
    if kind == "ip":
        ip, reserved = 0, _zone(sum(int(p) << s for p, s in zip(value.split("."), (24, 16, 8, 0), strict=True))) not in ("public", "multi")
        while True:
            ip += 1
            new = int.from_bytes(hashlib.blake2b(seed + str(ip).encode(), key=key, digest_size=8).digest(), "big")
            new = 10 << 24 | new & 0xFFFFFF if reserved else new & 0xFFFFFFFF
            if _zone(new) in (("10",) if reserved else ("public",)):
                return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
    if kind == "phone":
        code, digits = value.split(":")
        new = permute(digits, tweak, key, lambda s: (s[0] == "0") == (digits[0] == "0"))
        return f"{code and '+' + new[: len(code) - 1]}:{new}"
    return permute(value, tweak, key) + _made("latin", min(2 + by, 40), seed, key)  # a secret


#: Letters that may stand for each other in a name, so that it can be spoken and keeps accents and script.
_SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "çðñþ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")


def _name_word(word: str, tweak: bytes, key: bytes) -> str:
    """Another name: a listed one of the same script and gender for a listed one, else one with the same sounds."""
    script, known = GENDER.get(word, (script_of(word), ""))
    if known:  # the next in an order that the key gives, so never the name itself
        names = sorted(GIVEN[script, known], key=lambda x: hashlib.blake2b(tweak + x.encode(), key=key, digest_size=16).digest())
        return names[(names.index(word) + 1) % len(names)]
    sets = [next((g for g in _SOUNDS if c.lower() in g), c.lower()) for c in word]
    domain, n = 1, 0
    for c, g in zip(word.lower(), sets, strict=True):
        domain *= len(g)
        n = n * len(g) + g.index(c)
    if domain < 2:  # nothing but letters of their own kind
        return _made(script, len(word) + 2, tweak + word.encode(), key).capitalize()
    tweak += str([_SOUNDS.index(g) if g in _SOUNDS else g for g in sets]).encode()
    while True:
        i = n = _walk(domain, n, tweak, key)
        out = []
        for g in reversed(sets):
            i, x = divmod(i, len(g))
            out.append(g[x])
        new = "".join(o.upper() if c.isupper() else o for c, o in zip(word, reversed(out), strict=True))
        if new != word:
            return new
        tweak += b"/again"  # what comes next may be another's, which the pass over the corpus finds


@lru_cache(maxsize=20_000)
def surrogate(kind: str, value: str, tries: int, key: bytes) -> str:
    """The surrogate of an entity's value, in the value's own form; never the value."""
    own, again = value[2:] if kind == "person" and value[1:2] == ":" else value, b""
    while True:
        new = _surrogate(kind, value, tries, hashlib.blake2b(key + again, digest_size=32).digest())
        if new != own:
            return new
        again += b"/again"
        if len(again) > 300:
            raise ValueError(f"a {kind} of this form has no other value")


def _surrogate(kind: str, value: str, tries: int, key: bytes) -> str:
    gender = ""
    if kind == "person":
        if tries >= FOLLOWS["m"]:
            gender = max((g for g in FOLLOWS if FOLLOWS[g] <= tries), key=FOLLOWS.get)
            tries -= FOLLOWS[gender]
        elif value[1:2] == ":":
            gender, _, value = value.partition(":")
    tweak = f"{kind}/{tries}/".encode()
    if tries > TRIES and kind in ("person", "email", "ip", "phone", "secret"):
        return _wider(kind, value, tweak, key, tries - TRIES, gender)
    if kind == "ip":
        ip = 0
        for part in value.split("."):
            ip = ip << 8 | int(part)
        new = ip
        while True:
            new = _walk(1 << 32, new, tweak, key)
            if _zone(new) == _zone(ip):
                return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        body = permute(value[1:-1], tweak + value[0].encode(), key)
        off = (int(value[-1]) - luhn(value[:-1])) % 10
        return value[0] + body + str((luhn(value[0] + body) + off) % 10)
    if kind == "ssn":
        valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        return permute(value, tweak, key, valid if valid(value) else lambda s: not valid(s))
    if kind == "phone":
        code, digits = value.split(":")
        fixed = len(code) - 1 if code else 0
        rest = digits[fixed:]
        small = rest[0] in "01"
        return f"{code}:{digits[:fixed]}" + permute(rest, tweak + code.encode(), key, lambda s: (s[0] in "01") == small)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        whole = permute("@".join([local, *labels[:-1]]), tweak, key).split("@")
        return whole[0] + "@" + ".".join([*whole[1:], labels[-1]])
    if kind == "iban":
        bban = permute(value[4:], tweak + value[:2].encode(), key)
        return value[:2] + iban_check(value[:2], bban) + bban
    if kind == "ip6":
        groups = value.split(":")
        new = permute_hex("".join(groups[1:]), tweak + groups[0].encode(), key)
        return ":".join([groups[0], *(new[i : i + 4] for i in range(0, 28, 4))])
    if kind == "birth":
        day = date.fromisoformat(value).toordinal() - FIRST_DAY
        new = _walk(PAST, day, tweak, key) if day < PAST else PAST + _walk(DAYS - PAST, day - PAST, tweak, key)
        return date.fromordinal(FIRST_DAY + new).isoformat()
    if kind == "street" and value[-1].isdigit():
        word, number = value.split(" ")
        end = next(e for e in ENDS if word.endswith(e))
        return f"{_name_word(word.removesuffix(end), tweak, key)}{end} {permute(number, tweak, key, lambda x: x[0] != '0')}"
    if kind == "street":
        number, *words, street = value.split(" ")
        return " ".join([permute(number, tweak, key, lambda x: x[0] != "0"), *("-".join(_name_word(p, tweak, key) for p in w.split("-")) for w in words), street])
    if kind == "key":
        return value[:4] + permute(value[4:], tweak, key)
    if kind == "person":
        new = [w if w in PARTICLES else "-".join(_name_word(p, tweak, key) for p in w.split("-")) for w in value.split(" ")]
        if gender:  # a listed name says it, the rest keeps names apart
            first = value.split(" ")[0]
            new[0] = f"{_pick(GIVEN[script_of(first), gender], tweak + first.encode(), key)}-{new[0].replace('-', '').capitalize()}"
        return " ".join(new)
    return permute(value, tweak, key)


common.forgets(surrogate.cache_clear)


def rendered(entity: Entity, raw: str, tries: int, key: bytes) -> str:
    """The surrogate in the layout and case of the mention."""
    new = surrogate(entity.type, entity.value, tries, key)
    if entity.type in ("phone", "card", "ssn"):
        digits = iter(new.partition(":")[2] if entity.type == "phone" else new)
        return "".join(next(digits) if c.isdigit() else c for c in raw)
    if entity.type == "email":
        if len(raw) < len(new):  # the letters of a wider form stand before the @
            at = raw.index("@")
            raw = raw[:at] + raw[at - 1] * (len(new) - len(raw)) + raw[at:]
        return "".join(n.upper() if c.isupper() else n for c, n in zip(raw, new, strict=True))
    if entity.type == "ip6":
        new = str(ipaddress.IPv6Address(new)) if "::" in raw else ":".join(x.lstrip("0") or "0" for x in new.split(":"))
        return new.upper() if any(c.isupper() for c in raw) else new
    if entity.type == "birth":
        layout, day = _layout(raw)[0], date.fromisoformat(new)
        if layout == "y-m-d":
            return new
        if layout == "dMy":
            return f"{day.day} {MONTHS[day.month - 1]} {day.year}"
        if layout == "Mdy":
            return f"{MONTHS[day.month - 1]} {day.day}, {day.year}"
        mark, width = next(c for c in raw if not c.isdigit()), 2 if re.match(r"\d\d\D\d\d\D", raw) else 1
        return mark.join(f"{x:0{width}d}" for x in ((day.day, day.month) if layout == "dmy" else (day.month, day.day))) + f"{mark}{day.year}"
    if entity.type == "iban":
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in raw)
    return new


def replace(text: str | None, entities: list[Entity], exceptions: dict[tuple[str, str], int], key: bytes) -> str | None:
    """The text with surrogates in place of its entities."""
    if not entities:
        return text
    out, at = [], 0
    for e in entities:
        out += [text[at : e.start], rendered(e, text[e.start : e.end], exceptions.get((e.type, e.value), 0), key)]
        at = e.end
    return "".join([*out, text[at:]])


_PAIR = "type string, value string"
_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names in wayfold.pii.key, else one drawn for this application."""
    named = spark.conf.get("wayfold.pii.key", "")
    return named.encode() if named else _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def with_spans(docs: DataFrame, spans: str, row: str) -> DataFrame:
    """docs with a number of its own for each row and the entities of its text."""
    kept = docs.columns
    at = kept.index("text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("value", pa.string())]))

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[e._asdict() for e in detect(t or "")] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*kept, spans])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    found = docs.mapInArrow(run, f"{fields}, `{spans}` array<struct<start: int, end: int, type: string, value: string>>")
    return found.withColumn(row, F.monotonically_increasing_id())


def _surrogates(rows: DataFrame, tries: int, key: bytes) -> DataFrame:
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types, values = (b.column(i).to_pylist() for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([surrogate(t, v, tries, key) for t, v in zip(types, values, strict=True)], pa.string())], ["type", "value", "new"])

    return rows.select("type", "value").mapInArrow(run, f"{_PAIR}, new string")


def collisions(entities: DataFrame, folder: str, key: bytes) -> DataFrame:
    """(type, value, tries) of entities whose first surrogate is an entity of the corpus or another's and which got a later one, and of names that follow a gendered entity."""
    spark = entities.sparkSession
    named = F.when(F.col("type") == "person", F.regexp_replace("value", "^[mf]:", "")).otherwise(F.col("value"))
    gendered = entities.where("type = 'person' and substring(value, 2, 1) = ':'").select("type", named.alias("name"), F.substring("value", 1, 1).alias("gender"))
    one = gendered.groupBy("type", F.col("name").alias("value")).agg(F.min("gender").alias("gender"), F.max("gender").alias("other")).where("gender = other").drop("other")
    follows = common.stage(entities.where("type = 'person'").join(one, ["type", "value"]), folder, "follows")
    first = common.stage(_surrogates(entities.join(follows, ["type", "value"], "left_anti"), 0, key), folder, "first")
    real = first.select("type", named.alias("new"))  # a name that follows another is that one's
    same = first.join(first.groupBy("type", "new").agg(F.min("value").alias("least"), F.count("*").alias("n")).where("n > 1"), ["type", "new"]).where("value <> least").select("type", "value")
    bad = common.stage(first.where(~F.col("type").isin(*DENSE)).join(real, ["type", "new"], "left_semi").select("type", "value").unionByName(same).distinct(), folder, "bad_0")
    given = spark.createDataFrame([], f"{_PAIR}, new string, tries int")
    for tries in range(1, TRIES + WIDER + 1):
        if bad.isEmpty():
            break
        taken = real.where(~F.col("type").isin(*DENSE)).unionByName(first.select("type", "new")).unionByName(given.select("type", "new"))
        free = _surrogates(bad, tries, key).join(taken, ["type", "new"], "left_anti")
        chosen = common.stage(free.groupBy("type", "new").agg(F.min("value").alias("value")).select("type", "value", "new", F.lit(tries).alias("tries")), folder, f"given_{tries}")
        bad = common.stage(bad.join(chosen, ["type", "value"], "left_anti"), folder, f"bad_{tries}")
        given = given.unionByName(chosen)
    else:
        if not bad.isEmpty():
            raise RuntimeError(f"no free surrogates: {bad.groupBy('type').count().collect()}")
    given = given.select("type", "value", "tries")
    code = F.when(F.col("gender") == "m", FOLLOWS["m"]).otherwise(FOLLOWS["f"])
    moved = given.select("type", F.col("value").alias("entity"), F.col("tries").alias("moved"))
    followed = follows.withColumn("entity", F.concat_ws(":", "gender", "value")).join(moved, ["type", "entity"], "left")
    return given.unionByName(followed.select("type", "value", (F.coalesce("moved", F.lit(0)) + code).cast("int").alias("tries")))


def pseudonymize(spark: SparkSession, docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with text replaced, and n_entities and entity_types added (they replace columns of these names)."""
    common.small_batches(spark)
    key = key or session_key(spark)
    folder = common.work_folder(spark, "pii")
    docs = docs.drop("n_entities", "entity_types").withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    spans, row, tries = (common.unused(x, names) for x in ("_spans", "_row", "_tries"))
    found = common.stage(with_spans(docs, spans, row), folder, "found")
    pairs = found.select(row, F.explode(spans).alias(spans)).select(row, f"{spans}.type", f"{spans}.value")
    given = common.stage(collisions(pairs.select("type", "value").distinct(), folder, key), folder, "given")
    few = given.limit(common.BROADCAST_ROWS // 5 + 1).collect()
    wide = len(few) > common.BROADCAST_ROWS // 5  # too many to broadcast: they come with their rows
    sent = spark.sparkContext.broadcast({} if wide else {(r.type, r.value): r.tries for r in few})
    rows = found
    if wide:
        own = pairs.join(given, ["type", "value"]).groupBy(row).agg(F.collect_set(F.struct("type", "value", "tries")).alias(tries))
        rows = found.join(own, row, "left")
    rows = rows.select(*names, spans, *([tries] if wide else []))
    at = names.index("text")

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [{(x["type"], x["value"]): x["tries"] for x in g or ()} for g in b.column(len(names) + 1).to_pylist()] if wide else [sent.value] * b.num_rows
            entities = [[Entity(**e) for e in x] for x in b.column(len(names)).to_pylist()]
            done = [replace(t, e, g, key) for t, e, g in zip(b.column(at).to_pylist(), entities, own, strict=True)]
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(done, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(e) for e in entities], pa.int64()), pa.array([",".join(sorted({x.type for x in e})) for e in entities], pa.string())], [*names, "n_entities", "entity_types"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_entities long", "entity_types string"])
    return rows.mapInArrow(run, schema)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(spark, common.parquet(spark, sf_dir, "documents").select("doc_id", "text"))
