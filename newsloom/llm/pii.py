"""Replacing personal data by surrogates.

Detected entities - e-mail and IP addresses, telephone, card, account and social-security numbers,
secrets and names of persons - get replacements that are

- keyed: nobody without the key can go back or forth;
- consistent: of the same type and format (digits stay digits, letters letters of the same script
  and case, punctuation stays); a card or account number is valid if it was, an address stays in
  its special network, a secret keeps its well-known beginning, a first name keeps its gender;
- the same for every mention of an entity in the corpus, and different for different entities.

Everything but names is replaced by a keyed permutation of the forms of its format (a Feistel
network over the number that the form stands for), so two entities can't get one surrogate, however
full a format is. Names are made of syllables of their script. Collision checks are distributed
aggregations over the distinct entities: a surrogate that is itself an entity of the corpus, or a
name that two entities share, is made again with the next counter, against all forms in use; a
name grows by a syllable each time. What still meets an entity of the corpus after ``ROUNDS``
tries, because the corpus has nearly all forms of a format, keeps the first permutation's form: that
is distinct and unrelated to whom it stands for, but it is someone's. A name then gets a long form.

Detection takes one pass over a text: number patterns where there is a digit, address patterns
around each @, and for names an Aho-Corasick automaton of titles and first names, and pairs of
capitalised words beside words that go with persons (said, met, Dear, ...).
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, joined_side, materialise, row_key, small_batches

KEY_SETTING = "spark.newsloom.surrogates.secretKey"  # Spark hides the values of such names in its interface
ROUNDS = 8

MALE = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew George Paul Mark Peter Henry Edward Hans Klaus Wolfgang Jürgen Stefan Andreas Markus "
    "Jean Pierre Jacques Michel Philippe Louis François Carlos José Juan Luis Miguel Antonio Francisco Pedro Javier Giovanni Marco Luca Ahmed Mohammed Ali Omar "
    "Liam Noah Oliver Elijah Lucas Mason Logan Ethan Jacob Jack Ryan Nathan Kevin Brian Steven Edwin Kenneth Joshua Andrew Christopher Anthony Donald Samuel Benjamin Alexander Simon Martin Patrick Frank Walter "
    "Lukas Felix Jonas Finn Tobias Sebastian Matthias Jens Uwe Dieter Günter Olivier Julien Nicolas Antoine Hugo Luc Étienne Diego Pablo Alejandro Fernando Rafael Sergio Lars Erik Sven Nils Piotr Tomasz "
    "Wei Jun Hiroshi Kenji Takashi Raj Arjun Vikram Sanjay Rahul Amit Kwame Kofi Chinedu Emeka Tunde Hassan Ibrahim Yusuf Mustafa Mehmet Khalid Tariq Minh "
    "Иван Сергей Дмитрий Александр Андрей Алексей Николай Владимир Γιώργος Δημήτρης Νίκος Κώστας"
).split()
FEMALE = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Anna Emma Alice Helen Laura Julia Ursula Monika Petra Sabine Claudia "
    "Marie Nathalie Isabelle Sylvie Catherine Sophie Camille María Carmen Ana Isabel Dolores Pilar Teresa Lucía Giulia Francesca Fatima Aisha "
    "Olivia Ava Isabella Mia Charlotte Amelia Harper Evelyn Abigail Grace Chloe Victoria Natalie Hannah Rebecca Rachel Laurie Nicole Stephanie Michelle Kimberly Deborah Dorothy Amy Angela Sandra Donna Carol Ruth "
    "Lena Leonie Hanna Katharina Heike Birgit Ingrid Gisela Renate Céline Chloé Léa Manon Juliette Élodie Aurélie Lucia Sofia Elena Paula Marta Raquel Inés Beatriz Ingeborg Astrid Katarzyna Agnieszka "
    "Mei Yuki Sakura Keiko Priya Anjali Deepa Lakshmi Sunita Ama Ngozi Amara Zainab Leila Layla Yasmin Noor Linh "
    "Мария Анна Елена Ольга Наталья Татьяна Ирина Светлана Μαρία Ελένη Κατερίνα Σοφία"
).split()
_M, _W = frozenset(x.lower() for x in MALE), frozenset(x.lower() for x in FEMALE)
_MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Don|Sir|Lord|г-н|κ"
_FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Mme|Madame|Mlle|Señora|Sra|Srta|Lady|г-жа|κα"
_CAP = r"[^\W\d_a-zß-öø-ÿа-яёα-ωά-ώ][^\W\d_]+(?:[-'’][^\W\d_]+)?"
_TITLED = re.compile(rf"\.?[ ]+(?P<titled>{_CAP}(?:[ ]+{_CAP})?)")
_NEXT = re.compile(rf"[ ]+{_CAP}")
_SEVERAL = re.compile(rf"(?<![^\W_]){_CAP}(?:[ ]{_CAP}){{1,2}}(?![^\W_])")
_BEFORE, _AFTER = re.compile(r"(\w+)[,:]? +\Z"), re.compile(r",? +(\w+)")
#: words that stand before or after a person's name
_CUE_BEFORE = frozenset("met dear contact author signed named called name wrote told asked phoned emailed married hired interviewed thanked sincerely regards".split())
_CUE_AFTER = frozenset("said says met wrote writes told asked lives lived works worked married phoned emailed replied added signed thinks laughed smiled".split())
#: words that a name doesn't have
_NO_NAME = frozenset(
    "the this that these a an in on at of for and or but if when new old north south east west united national international general public apache license version university college school institute "
    "department ministry bank company inc ltd corp group street road avenue square city county state river lake mount park house church street monday tuesday wednesday thursday friday saturday sunday "
    "january february march april may june july august september october november december der die das le la les el los las".split()
)

_SECRET_WORD = re.compile(r"(?i:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|passw(?:or)?d|pwd|bearer)\b[\"']?\s*(?:=|:|\s)\s*[\"']?")
_SECRET_VALUE = re.compile(r"[A-Za-z0-9_\-/+=.]{8,}")
_KNOWN_SECRET = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[\w-]+\.[\w-]+\.[\w-]+|(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,128})\b")
_NUMBERS = re.compile(
    "|".join(
        f"(?P<{kind}>{pattern})"
        for kind, pattern in {
            "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
            "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)|(?<![:\w])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![:\w])",
            "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
            "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]|-\d)",
            "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|(?<=\d[ .-])\d{2,4}(?:[ .-]\d{2,4}){2,3})(?![\w])"
            r"|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w])|(?<![\w.])0\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}(?![\w])",
        }.items()
    )
)
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_RELEASE = re.compile(r"(?i:\b(?:version|ver|v|release|build|firmware|section|rev)\.?\s?)\Z")
_DIGIT = re.compile("[0-9]")
_TITLE_M, _TITLE_F = frozenset(_MALE_TITLES.split("|")), frozenset(_FEMALE_TITLES.split("|"))
_TITLES = _TITLE_M | _TITLE_F | {"Dr", "Prof"}


@lru_cache(1)
def _starts() -> ahocorasick.Automaton:
    """Where a person's name can begin: the titles and the first names, all at once."""
    found = ahocorasick.Automaton()
    for word in {*MALE, *FEMALE, *_TITLES}:
        found.add_word(word, len(word))
    found.make_automaton()
    return found


def script_of(word: str) -> str:
    for c in word:
        if c.isalpha():
            return unicodedata.name(c, "LATIN").split()[0].lower()
    return "latin"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ as far as an address goes to either side; no character is looked at twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        if domain is not None:
            while start > free and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        free = max(free, at + 1)
        at = text.find("@", at + 1)


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    plain = 0  # up to here no value has a digit
    for m in _SECRET_WORD.finditer(text):
        if m.end() >= plain and (value := _SECRET_VALUE.match(text, m.end())):
            if _DIGIT.search(value.group()):
                yield value.span()
            else:
                plain = value.end()
    for m in _KNOWN_SECRET.finditer(text):
        yield m.span()


def _persons(text: str) -> Iterator[tuple[str, int, int]]:
    """(title, start, end) of names with a title, or with a known first name before another
    capitalised word, or of two or three capitalised words beside a word that goes with persons."""
    done, spans = 0, []
    for last, n in _starts().iter(text):
        at = last + 1 - n
        if at < done or (at and text[at - 1].isalnum()) or text[last + 1 : last + 2].isalnum():
            continue
        word = text[at : last + 1]
        if word in _TITLES:
            m = _TITLED.match(text, last + 1)
            start, title = (m.start("titled") if m else 0), word
        else:
            m, start, title = _NEXT.match(text, last + 1), at, ""
        if m is not None:
            done = m.end()
            spans.append((start, done))
            yield title, start, done
    sure, k, before = dict(spans), 0, -9
    for m in _SEVERAL.finditer(text):
        start, end = m.span()
        while k < len(spans) and spans[k][1] <= start:
            before = max(before, spans[k][1])
            k += 1
        if k < len(spans) and spans[k][0] < end:
            continue
        words = m.group().split()
        if any(w.lower() in _NO_NAME or w.isupper() for w in words):
            continue
        left, right = _BEFORE.search(text[max(0, start - 24) : start]), _AFTER.match(text, end, end + 24)
        beside = before >= 0 and text[before:start] in (" and ", ", ", " und ", " et ", " y ")
        if beside or left and left.group(1).lower() in _CUE_BEFORE or right and right.group(1).lower() in _CUE_AFTER:
            before = end
            if start not in sure:
                yield "", start, end


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities of a text, in order, not overlapping. A
    name gives one entity for its first name and one for each other; once named, either is found
    wherever it stands alone in the same text. The time is in proportion to the text."""
    found: list[tuple[int, int, str, str]] = []
    parts: dict[str, str] = {}
    if "@" in text:
        found += [(a, b, "email", text[a:b].lower()) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(a, b, "secret", text[a:b]) for a, b in _secrets(text)]
        for m in _NUMBERS.finditer(text):
            kind, value = m.lastgroup, m.group()
            if kind != "ip":
                found.append((*m.span(), kind, re.sub(r"[^0-9A-Za-z+]", "", value)))
            elif ":" in value:
                found.append((*m.span(), kind, ":".join(f"{int(x, 16):x}" for x in value.split(":"))))
            elif all(int(x) < 256 for x in value.split(".")) and not _RELEASE.search(text[max(0, m.start() - 12) : m.start()]):
                found.append((*m.span(), kind, ".".join(str(int(x)) for x in value.split("."))))
    for title, start, end in _persons(text):
        words = list(re.finditer(_CAP, text[start:end]))
        first = words[0].group().lower()
        gender = "f" if title in _TITLE_F or first in _W else "m" if title in _TITLE_M or first in _M else "n"
        for k, w in enumerate(words):
            given = k == 0 and (len(words) > 1 or first in _M or first in _W)
            what = f"{'first.' + gender if given else 'last'}.{script_of(w.group())}"
            found.append((start + w.start(), start + w.end(), what, w.group().lower()))
            parts.setdefault(w.group(), what)
            parts.setdefault(w.group().upper(), what)
    # of overlapping entities the one that begins first counts, then the longest
    found.sort(key=lambda x: (x[0], -x[1]))
    free, kept = 0, []
    for x in found:
        if x[0] >= free:
            kept.append(x)
            free = x[1]
    if not parts:
        return kept
    alone, k = [], 0
    for m in _TOKEN.finditer(text):
        for a, b in [m.span()] if m.group() in parts else [(m.start() + w.start(), m.start() + w.end()) for w in _PIECE.finditer(m.group())]:
            if (what := parts.get(text[a:b])) is not None:
                while k < len(kept) and kept[k][1] <= a:
                    k += 1
                if k == len(kept) or kept[k][0] >= b:
                    alone.append((a, b, what, text[a:b].lower()))
    return sorted(kept + alone)


_TOKEN, _PIECE = re.compile(r"\w+(?:[-'’]\w+)*"), re.compile(r"\w+")


def _bits(key: bytes, tweak: bytes, number: int, most: int) -> int:
    """A keyed pseudo-random number from 0 to most - 1."""
    size = (most.bit_length() + 7) // 8 + 8
    told = number.to_bytes((number.bit_length() + 7) // 8 or 1, "big")
    return int.from_bytes(hashlib.shake_256(len(key).to_bytes(4, "big") + key + len(tweak).to_bytes(4, "big") + tweak + told).digest(size), "big") % most


def permuted(number: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 to size - 1: a Feistel network over two halves, walked until the
    result is in range."""
    if size < 2:
        return number
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    tag = tweak.encode("utf-8", "surrogatepass")
    rounds = [tag + bytes([k]) for k in range(8)]
    while True:
        x, y, p, q = *divmod(number, b), a, b
        for tweaked in rounds:
            x, y, p, q = y, (x + _bits(key, tweaked, y, p)) % p, q, p
        number = x * b + y
        if number < size:
            return number


def walked(form: str, step: Callable[[str], str], fits: Callable[[str], bool]) -> str:
    """``step`` of a form until it fits; as the form itself does, that is a permutation of those that do."""
    form = step(form)
    while not fits(form):
        form = step(form)
    return form


_SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga ge ha ho ja ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve wa za".split(), "a ia ina ette elle".split(), "o us er an rd".split(), "man son ley ard ini ner feld".split()),
    "cyrillic": ("ба ве га да зо ка ла ли ма ми на ни ро ра са та то фе".split(), "а ия ина".split(), "ей ан ор ий".split(), "енко ович ук ян".split()),
    "greek": ("βα γε δα κα λα λι μα με νι νο πα ρα ρο σα τα το φι".split(), "α ία ίνα".split(), "ος ης ας".split(), "ίδης άκης ου".split()),
}
_POOLS = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_POOL_OF = {c: pool for x in _POOLS for pool in {x, x.upper()} for c in pool}


@lru_cache(4096)
def _pool(c: str) -> str:
    """The characters that may stand for one; each of them has the same pool."""
    if c in _POOL_OF:
        return _POOL_OF[c]
    if c.isdecimal():
        return "".join(chr(ord(c) - unicodedata.digit(c) + k) for k in range(10))
    if not c.isalpha():
        return c
    like = lambda x: x.isalpha() and x not in _POOL_OF and unicodedata.category(x) == unicodedata.category(c) and (x.lower() == x) == (c.lower() == c)
    return "".join(filter(like, map(chr, range(ord(c) & ~63, (ord(c) & ~63) + 64))))


def formatted(form: str, key: bytes, tweak: str, pools: list[str] | None = None) -> str:
    """A keyed permutation of the strings with the same pools, by default those of their characters."""
    pools = pools or [_pool(c) for c in form]
    number, size = 0, 1
    for c, pool in zip(form, pools):
        number, size = number * len(pool) + pool.index(c), size * len(pool)
    number = permuted(number, size, key, tweak)
    out = []
    for pool in reversed(pools):
        number, k = divmod(number, len(pool))
        out.append(pool[k])
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10


def _iban_rest(form: str) -> int:
    return int("".join(str(int(c, 36)) for c in form[4:] + form[:4])) % 97


def _iban_valid(form: str) -> bool:
    return "02" <= form[2:4] <= "98" and _iban_rest(form) == 1


#: networks that mean something; an address stays in the smallest one that it is in
_SPECIAL = sorted(
    map(ipaddress.ip_network, "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()),
    key=lambda n: -n.prefixlen,
)


def _network(address: ipaddress.IPv4Address) -> ipaddress.IPv4Network | None:
    return next((n for n in _SPECIAL if address in n), None)


def _address(canonical: str, key: bytes, tweak: str) -> str:
    if ":" in canonical:
        groups = [int(x, 16) for x in canonical.split(":")]
        number = permuted(sum(x << 16 * k for k, x in enumerate(reversed(groups[1:]))), 1 << 112, key, f"{tweak}:{groups[0]}")
        return ":".join(f"{x:x}" for x in [groups[0], *(number >> 16 * k & 65535 for k in range(6, -1, -1))])
    address = ipaddress.IPv4Address(canonical)
    inside = _network(address)
    if inside is not None:
        first = int(inside.network_address)
        return str(ipaddress.IPv4Address(first + permuted(int(address) - first, inside.num_addresses, key, f"{tweak}:{inside}")))
    number = permuted(int(address), 1 << 32, key, tweak)
    while _network(ipaddress.IPv4Address(number)) is not None:
        number = permuted(number, 1 << 32, key, tweak)
    return str(ipaddress.IPv4Address(number))


_MARKS = re.compile(r"AKIA|gh[pousr]_|sk-|xox[abp]-|eyJ|")


def _ssn_valid(x: str) -> bool:
    return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The canonical form of the replacement of an entity; each attempt gives another."""
    tweak = f"{kind}\x1f{attempt}"
    if kind == "email":
        local, domain = canonical.rsplit("@", 1)
        rest, top = domain.rsplit(".", 1)
        return formatted(local, key, f"{tweak}\x1f{domain}") + "@" + formatted(rest, key, f"domain\x1f{top}") + "." + top
    if kind == "ip":
        return _address(canonical, key, tweak)
    if kind == "card":
        if _luhn(canonical) == 0:
            out = canonical[0] + formatted(canonical[1:-1], key, f"{tweak}\x1f{canonical[0]}")
            return out + next(str(d) for d in range(10) if _luhn(out + str(d)) == 0)
        return canonical[0] + walked(canonical[1:], lambda x: formatted(x, key, f"{tweak}\x1f{canonical[0]}"), lambda x: _luhn(canonical[0] + x) != 0)
    if kind == "iban":
        country = canonical[:2]
        if _iban_valid(canonical):
            out = formatted(canonical[4:], key, f"{tweak}\x1f{country}")
            return f"{country}{98 - _iban_rest(country + '00' + out):02d}{out}"
        return country + walked(canonical[2:], lambda x: formatted(x, key, f"{tweak}\x1f{country}"), lambda x: not _iban_valid(country + x))
    if kind == "ssn":
        valid = _ssn_valid(canonical)
        return walked(canonical, lambda x: formatted(x, key, tweak), lambda x: _ssn_valid(x) == valid)
    if kind == "phone":
        kept = 2 if canonical[0] == "+" else int(canonical[0] == "0")
        pools = ["123456789" if not kept and k == 0 else "0123456789" for k in range(len(canonical) - kept)]
        return canonical[:kept] + formatted(canonical[kept:], key, f"{tweak}\x1f{canonical[:kept]}", pools)
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+", canonical):
            return formatted(canonical, key, f"{tweak}\x1fhex", ["0123456789abcdef"] * len(canonical))
        mark = _MARKS.match(canonical).group()
        fits = lambda x: _MARKS.match(mark + x).group() == mark and not re.fullmatch(r"[0-9a-f]+", mark + x)
        return mark + walked(canonical[len(mark) :], lambda x: formatted(x, key, f"{tweak}\x1f{mark}"), fits)
    script = kind.rsplit(".", 1)[1]
    number = _bits(key, f"{tweak}\x1f{canonical}".encode("utf-8", "surrogatepass"), 0, 1 << 256)
    n = max(2, min(4, len(canonical) // 3)) + (attempt if attempt < ROUNDS else 16)
    if script in _SYLLABLES:
        syllables, female, male, last = _SYLLABLES[script]
        ends = {"f": female, "m": male}.get(kind.split(".")[1], last if kind.startswith("last.") else male + female)
    else:
        syllables, ends = _pool(canonical[0]), [""]
    out = ""
    for _ in range(n):
        number, k = divmod(number, len(syllables))
        out += syllables[k]
    return out + ends[number % len(ends)]


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's setting ``KEY_SETTING``. Where it is unset, a random one is made and
    set, for this session only: surrogates then differ from session to session."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, os.urandom(32).hex())
    return spark.conf.get(KEY_SETTING).encode()


def render(mention: str, kind: str, new: str) -> str:
    """The replacement in the format of a mention: its punctuation and its case."""
    if kind.startswith(("first.", "last.")) or kind == "email":
        if mention.isupper():
            return new.upper()
        return new[:1].upper() + new[1:] if mention[:1].isupper() else new
    if kind == "ip":
        if ":" in mention:  # groups as wide as in the mention, where that has leading zeros
            new = ":".join(x.zfill(len(m)) if m[:1] == "0" else x for x, m in zip(new.split(":"), mention.split(":")))
        return new.upper() if mention.isupper() else new
    if kind == "secret":
        return new
    rest = iter(new)
    return "".join(next(rest) if re.match(r"[0-9A-Za-z+]", c) else c for c in mention)


def replace(text: str, surrogates: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for start, end, kind, canonical in detect(text):
        if start < at:
            continue
        out += [text[at:start], render(text[start:end], kind, surrogates[kind, canonical])]
        at = end
    return "".join([*out, text[at:]])


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        rows = [(tie, kind, canonical) for tie, text in zip(batch.column("tie").to_pylist(), batch.column("text").to_pylist()) for kind, canonical in {(x[2], x[3]) for x in detect(text)}]
        if rows:
            a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())], ["tie", "kind", "canonical"])


def _make(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, canonicals, attempts = (batch.column(c).to_pylist() for c in ("kind", "canonical", "attempt"))
            new = [surrogate(*x, key) for x in zip(kinds, canonicals, attempts)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("canonical"), batch.column("attempt"), pa.array(new, pa.string())], ["kind", "canonical", "attempt", "new"])

    return run


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, new) for distinct entities (kind, canonical), without nulls. Two names of
    different gender count as different entities. Collisions are looked for among all of them. No
    entities, no rows."""
    schema = "kind string, canonical string, attempt int, new string"
    family = F.when(F.col("kind").rlike("^(first|last)[.]"), F.lit("name")).otherwise(F.col("kind"))
    owner = F.struct("kind", "canonical")
    made = materialise(entities.withColumn("attempt", F.lit(0)).mapInArrow(_make(key), schema).withColumn("family", family), "surrogates")
    # a surrogate belongs to its least entity, and to none if it is an entity itself
    claims = made.select("family", F.col("new").alias("form"), owner.alias("owner"), F.lit(False).alias("real"))
    real = made.select("family", F.col("canonical").alias("form"), F.lit(None).cast("struct<kind:string,canonical:string>").alias("owner"), F.lit(True).alias("real"))
    clashes = claims.union(real).groupBy("family", "form").agg(F.min("owner").alias("least"), F.count("owner").alias("owners"), F.max("real").alias("real"))
    clashes = clashes.filter("owners > 1 or (owners > 0 and real)").select("family", F.col("form").alias("new"), F.when(~F.col("real"), F.col("least")).alias("least"))
    open_ = materialise(made.join(clashes, ["family", "new"]).filter(F.col("least").isNull() | (F.col("least") != owner)).select("family", "kind", "canonical"), "open")
    if not open_.take(1):
        return made.select("kind", "canonical", "new")
    # from now on nobody may take an entity's form or anybody's first surrogate
    reserved = made.select("family", F.col("canonical").alias("new")).union(made.select("family", "new"))
    moved = made.select("family", "kind", "canonical", "new").limit(0)
    for attempt in range(1, ROUNDS + 1):
        again = open_ if attempt < ROUNDS else open_.filter("family = 'name'")
        tried = materialise(again.select("kind", "canonical", F.lit(attempt).alias("attempt")).mapInArrow(_make(key), schema).withColumn("family", family), "tried")
        least = tried.groupBy("family", "new").agg(F.min(owner).alias("least"))
        good = tried.join(least, ["family", "new"]).filter(F.col("least") == owner).select("family", "kind", "canonical", "new")
        good = materialise(good.join(reserved, ["family", "new"], "left_anti").join(moved.select("family", "new"), ["family", "new"], "left_anti").select("family", "kind", "canonical", "new"), "good")
        moved = moved.union(good)
        open_ = materialise(open_.join(good, ["kind", "canonical"], "left_anti").select("family", "kind", "canonical"), "open")
        discard(tried)
        if not open_.take(1):
            break
    later = moved.select("kind", "canonical", F.col("new").alias("later"))
    return made.join(later, ["kind", "canonical"], "left").select("kind", "canonical", F.coalesce("later", "new").alias("new"))


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "__newsloom_text"):
        texts = batch.column("__newsloom_text")
        maps = batch.column("__newsloom_map")
        if maps.null_count < len(maps):
            pairs = maps.to_pylist()
            texts = pa.array([text if p is None else replace(text, {(x["kind"], x["canonical"]): x["new"] for x in p}) for text, p in zip(texts.to_pylist(), pairs)], pa.string())
        rest = [batch.column(c) for c in batch.schema.names[:-2]]
        yield pa.RecordBatch.from_arrays([*rest, texts], batch.schema.names[:-1])


def anonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with all rows and columns, entities in ``text_col`` replaced by surrogates. The same
    key gives the same surrogates for the same corpus.

    Null and empty texts stay; a text without entities stays as it is, byte for byte. Repeated
    rows get the same replacements. An empty table stays empty. Other columns are passed on
    unread; names that start with __newsloom are reserved."""
    bound_batches(docs)
    tie = row_key(text_col)
    texts = docs.select(tie.alias("tie"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    mentions = materialise(texts.mapInArrow(_mentions, "tie long, kind string, canonical string").distinct(), "mentions")
    new = surrogates(mentions.select("kind", "canonical").distinct(), key)
    maps = mentions.join(new, ["kind", "canonical"]).groupBy(F.col("tie").alias("__newsloom_tie")).agg(F.collect_list(F.struct("kind", "canonical", "new")).alias("__newsloom_map"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.join(joined_side(materialise(maps, "maps")), tie == F.col("__newsloom_tie"), "left").select(*others, F.col(text_col).alias("__newsloom_text"), "__newsloom_map")
    schema = rows.drop("__newsloom_map").schema
    return rows.mapInArrow(_replace, schema).withColumnRenamed("__newsloom_text", text_col).select(docs.columns)
