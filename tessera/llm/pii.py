"""Personal data replaced by keyed surrogates.

Detected entities are e-mail addresses, telephone numbers, payment card numbers, network addresses,
identity and account numbers, credentials, and personal names after a title or with a known given name; a later
mention of the family name alone is one of the person, unless the name is a word too (``WORDS_TOO``, or in small letters in
the text).  An
entity's surrogate is a keyed function of its type and canonical form, so that an entity gets one surrogate
wherever it occurs (coreference, over the whole corpus and without a join), and keeps type, gender, script and
format: digits stay digits and letters stay letters of their script and case, separators stay, card and account
numbers stay valid or invalid as they were, names stay names of the title's or given name's gender, in capitals
where they were.  An e-mail address keeps its top-level domain alone.

Surrogates of numbers, addresses and credentials come from a keyed permutation without fixed points (a Feistel
network over the entity's digits and letters, walked on until the result is admissible), so two entities of one
format never share one and none keeps its own.  A collision check over the corpus confirms distinctness: (type, surrogate) pairs with
several originals, as can happen for names, are found by an aggregation over entities, and all but the
first original take their next variant; that is repeated, each round checkpointed, until no surrogate has two
originals.  One name is one original whatever its case and after titles of several genders.  The variants are empty unless names
collide; up to ``MAX_BROADCAST_VARIANTS`` they are broadcast, beyond that they are joined to the texts' names.

Defined results: a null text stays null and an empty one empty; a text without entities is unchanged,
character by character; overlapping candidates are resolved from the left, the longer first; characters that have no other of their script and category stay;
repeated rows get equal replacements; texts are read whole; columns of the results' names are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .common import cut

DEFAULT_KEY = b"tessera-surrogates-1"
MAX_BROADCAST_VARIANTS = 50_000

# Titles and their gender, by language; and given and family names, by script and gender.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "господин": "m", "г-н": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Srta": "f", "Doña": "f", "госпожа": "f", "г-жа": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
GIVEN = {
    ("latin", "m"): "Adam Boris Carl David Edgar Frank Georg Henry Ivan Jonas Karl Louis Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Anna Bella Clara Diana Elena Freya Greta Helen Irene Julia Klara Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("latin", "n"): "Alex Ariel Casey Charlie Eden Frankie Jamie Jordan Kim Lee Morgan Noel Quinn Robin Sam Sasha Sidney Taylor Toni Val".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Егор Иван Кирилл Максим Николай Олег Павел Роман Сергей Тимофей Фёдор Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лариса Мария Наталья Ольга Полина Светлана Татьяна Юлия".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура Паша Юля Тоня".split(),
}
SYLLABLES = {
    "latin": "bar bel cor dan del fal gar hol kas lin mar nor pel ros sal tor ven wil zan mer".split(),
    "cyrillic": "бар бел вор гор дал зар кал лин мар нор пел рос сал тор вен мил зан мер".split(),
}
ENDINGS = {("latin", "m"): "son", ("latin", "f"): "son", ("latin", "n"): "son", ("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова", ("cyrillic", "n"): "енко"}

_WORD = r"\p{Lu}[\p{L}’'-]+"
#: Known given names and their gender.
GENDER = {name: gender for (_, gender), names in GIVEN.items() for name in names}
_GIVEN = "|".join(sorted(map(regex.escape, GENDER), key=len, reverse=True))
_TITLE = "|".join(sorted(map(regex.escape, TITLES), key=len, reverse=True))
PATTERN = regex.compile(
    rf"""
    (?P<email>(?<![\p{{L}}\p{{N}}_.+%-])[\p{{L}}\p{{N}}_.+%-]++(?<!\.)@(?:[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])?\.)+\p{{L}}{{2,}})
  | (?P<credential>(?:(?<![\p{{L}}\p{{N}}])AKIA[A-Z0-9]{{16}}(?![\p{{L}}\p{{N}}])
      | (?i:(?<![\p{{L}}\p{{N}}])(?:password|passwd|pwd|token|secret|api[_-]?key)[ \t]*[=:][ \t]*["']?)\K[\p{{L}}\p{{N}}_/+.~-]{{8,}}))
  | (?P<ip>(?<![\p{{N}}.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){{3}}(?!\.?\p{{N}})
      | (?<![\p{{L}}\p{{N}}:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![\p{{L}}\p{{N}}:])
      | (?<![\p{{L}}\p{{N}}:])(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{{1,4}}:){{1,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,6}}(?![\p{{L}}\p{{N}}:]))
  | (?P<iban>(?<![\p{{L}}\p{{N}}])[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}]))
  | (?P<card>(?<![\p{{L}}\p{{N}}])(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}})(?![\p{{L}}\p{{N}}]))
  | (?P<phone>(?<![\p{{L}}\p{{N}}])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}|\(\d{{3}}\)[ ]?\d{{3}}-\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}|[2-9]\d{{2}}[2-9]\d{{6}}|0\d{{2,4}}[ /]\d{{5,8}})(?![\p{{L}}\p{{N}}]))
  | (?P<identity>(?<![\p{{L}}\p{{N}}-])\d{{3}}-\d{{2}}-\d{{4}}(?![\p{{L}}\p{{N}}-]))
  | (?P<name>(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?[ ]\K{_WORD}(?:[ ]{_WORD}){{0,2}})
  | (?P<given>(?<![\p{{L}}\p{{N}}])(?:{_GIVEN})(?:[ ]\p{{Lu}}\.?)?[ ]{_WORD})
    """,
    regex.X | regex.V1,
)
_NAMED = re.compile(rf"(?:{_TITLE})\.? [^\W\d_]")
_SIGNS = re.compile(r"[0-9@]")
_CAPITALISED = re.compile(r"[A-ZА-ЯЁ][a-zа-яё]+")
_LETTERS_ONLY = re.compile(r"(?:passw|pwd|token|secret|api[_-]?key)", re.I)
#: The titles that hold no other title.
_STEMS = tuple(t for t in TITLES if not any(o != t and o in t for o in TITLES))


def _may_hold(text: str) -> bool:
    """False where the pattern can't match: no digit, no @, no credential's mark, no title before a word."""
    if _SIGNS.search(text) or "AKIA" in text or text.count(":") >= 7 or ("=" in text or ":" in text) and _LETTERS_ONLY.search(text):
        return True
    return _titled(text)


def _titled(text: str) -> bool:
    return any(t in text for t in _STEMS) and bool(_NAMED.search(text)) or not GENDER.keys().isdisjoint(_CAPITALISED.findall(text))


def _random(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


#: Alphabets within which a character is exchanged.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}


@functools.cache
def _place(c: str) -> tuple[str, int] | None:
    """A character's alphabet and its place in it; None for what stays.  Letters and digits of other scripts are exchanged within
    the 128 code points around them that are of one category, where a change of case leads back."""
    if c in _PLACE:
        return _PLACE[c]
    if not (c.isalpha() or c.isdecimal()):
        return None
    start = ord(c) // 128 * 128
    back = lambda x: len(x.upper()) == len(x.lower()) == 1 and (x.upper().lower() == x.lower()) and x not in _PLACE
    alphabet = "".join(x for x in map(chr, range(start, start + 128)) if unicodedata.category(x) == unicodedata.category(c) and back(x))
    return (alphabet, alphabet.index(c)) if c in alphabet else None


def _places(text: str, hexadecimal: bool):
    """What gives a character of ``text`` its place."""
    if not hexadecimal:
        return _place
    alphabet = _HEX[1] if any(c in "ABCDEF" for c in text) else _HEX[0]
    return {c: (alphabet, i) for i, c in enumerate(alphabet)}.get


def permuted(text: str, key: bytes, label: str, hexadecimal: bool = False, rounds: int = 8) -> str:
    """A keyed permutation of all strings of ``text``'s format: each letter or digit stays in its alphabet.

    A Feistel network on the mixed-radix number of the characters' places, split in two halves.
    """
    if hexadecimal and any(c in "ABCDEF" for c in text):
        text = text.upper()  # one case, so that the alphabet is one
    at = _places(text, hexadecimal)
    held = {i: found for i, c in enumerate(text) if (found := at(c)) is not None}
    free = list(held)
    if not free:
        return text
    bases = [len(held[i][0]) for i in free]
    value = [held[i][1] for i in free]
    half = len(free) // 2
    sizes = [1, 1]
    numbers = [0, 0]
    for j, (b, v) in enumerate(zip(bases, value, strict=True)):
        s = 0 if j < half else 1
        sizes[s] *= b
        numbers[s] = numbers[s] * b + v
    form = "".join(chr(b) for b in bases) + "|" + "".join("\0" if i in held else c for i, c in enumerate(text))
    for r in range(rounds):
        to = r % 2
        numbers[to] = (numbers[to] + _random(key, label, form, r, numbers[1 - to])) % sizes[to]
    out = list(text)
    for s, span in ((1, range(len(free) - 1, half - 1, -1)), (0, range(half - 1, -1, -1))):
        n = numbers[s]
        for j in span:
            n, v = divmod(n, bases[j])
            out[free[j]] = held[free[j]][0][v]
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _next(text: str, by: int, hexadecimal: bool = False) -> str:
    """The next (or, by -1, the last) string of ``text``'s format."""
    out, places = list(text), _places(text, hexadecimal)
    for i in reversed(range(len(out))):
        if (found := places(out[i])) is not None:
            alphabet, at = found
            out[i] = alphabet[(at + by) % len(alphabet)]
            if 0 <= at + by < len(alphabet):
                break
    return "".join(out)


def deranged(text: str, key: bytes, label: str, hexadecimal: bool = False) -> str:
    """``permuted`` without fixed points: a run of neighbours that are fixed is passed around among them and the next one."""
    if hexadecimal and any(c in "ABCDEF" for c in text):
        text = text.upper()
    upper = hexadecimal and text == text.upper() and text != text.lower()
    move = lambda t: permuted(t, key, label, hexadecimal)
    step = lambda t, by: _next(t, by, hexadecimal)
    if upper:  # the digits alone don't say that letters are in capitals
        return deranged(text.lower(), key, label, True).upper()
    new, after = move(text), step(text, 1)
    if after == text:
        return text  # nothing to exchange
    if new == text:
        new = move(after)
        if new == after and sum(_places(text, hexadecimal)(c) is not None for c in text) == 1:
            return after  # one character, and all of them fixed
        return new
    first, before = None, step(text, -1)
    while move(before) == before:
        first, before = before, step(before, -1)
    return first or new


def _walk(text: str, key: bytes, label: str, fits) -> str:
    """The first permuted form that ``fits``: walking within the permutation keeps it one to one."""
    out = permuted(text, key, label)
    while not fits(out) and out != text:
        out = permuted(out, key, label)
    return out


def mod97(account: str) -> int:
    """The remainder of an account number's digits (letters as 10 to 35), its first four characters last."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _iban(bare: str, key: bytes) -> str:
    """Country kept, the rest permuted; the check digits are as far from the valid ones as they were."""
    right = lambda country, rest: 98 - mod97(f"{country}00{rest}")
    country, rest = bare[:2], bare[4:]
    off = int(bare[2:4]) - right(country, rest)
    new = deranged(rest, key, f"iban{country}")
    return f"{country}{(right(country, new) + off) % 100:02d}{new}"


def _ip(text: str, key: bytes) -> str:
    if ":" in text:
        return deranged(text, key, "ip", hexadecimal=True)
    address = int(ipaddress.IPv4Address(".".join(str(int(x)) for x in text.split("."))))
    halves = [address >> 16, address & 0xFFFF]
    while True:
        for r in range(8):
            to = r % 2
            halves[to] = (halves[to] + _random(key, "ip", r, halves[1 - to])) & 0xFFFF
        out = (halves[0] << 16) | halves[1]
        if out != address and 1 <= out >> 24 <= 223 and out >> 24 != 127:
            return str(ipaddress.IPv4Address(out))


def _script(text: str) -> str:
    return "cyrillic" if regex.search(r"\p{Cyrillic}", text) else "latin"


def _family(name: str, script: str, gender: str, key: bytes, variant: int) -> str:
    n = _random(key, "family", script, name.casefold(), variant)
    s = SYLLABLES[script]
    out = ""
    # longer at higher variants, so that there is room for any number of names
    for _ in range(4 + variant // 4):
        n, i = divmod(n, len(s))
        out += s[i]
    return out.capitalize() + ENDINGS[(script, gender)]


def _name(text: str, gender: str, key: bytes, variant: int) -> str:
    """Given names by list, the family name by syllables of its own key, so that a later mention by family name agrees."""
    script, words = _script(text), text.split(" ")
    given = GIVEN[(script, gender)]
    out = [given[_random(key, "given", script, gender, w.casefold(), variant) % len(given)] for w in words[:-1]]
    out = [n[0] + w[1:] if len(w.rstrip(".")) == 1 else n for n, w in zip(out, words[:-1], strict=True)]  # initials
    out.append(_family(words[-1], script, gender, key, variant))
    return " ".join(n.upper() if w.isupper() and len(w) > 1 else n for n, w in zip(out, words, strict=True))


def canonical(kind: str, text: str) -> str:
    """What two mentions of one entity have in common."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "phone", "iban"):
        return regex.sub(r"[ ./()-]", "", text)
    return text.casefold() if kind == "name" else text


def surrogate(kind: str, text: str, key: bytes = DEFAULT_KEY, gender: str = "n", variant: int = 0) -> str:
    """The keyed replacement of one entity."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        labels = domain.lower().split(".")
        # each label by those after it, so that a domain has one surrogate in all its subdomains
        new = [deranged(x, key, f"domain.{'.'.join(labels[i + 1 :])}") for i, x in enumerate(labels[:-1])] + labels[-1:]
        # case doesn't tell addresses apart: the permutation is of the lower-cased address, cased as the original
        new = deranged(local.lower(), key, f"email@{domain.lower()}") + "@" + ".".join(new)
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, text, strict=True))
    if kind in ("card", "phone", "iban"):
        bare = canonical(kind, text)
        if kind == "card":
            valid = luhn(bare)
            new = _walk(bare, key, "card", lambda x: luhn(x) == valid)
        elif kind == "iban":
            new = _iban(bare, key)
        else:
            keep = (2 if bare[1] in "17" else 3) if bare.startswith("+") else 0  # the country's code, to one or two digits
            new = bare[:keep] + deranged(bare[keep:], key, f"phone{bare[:keep]}")
        rest = iter(new)
        return "".join(c if c in " ./()-" else next(rest) for c in text)
    if kind == "ip":
        return _ip(text, key)
    if kind == "name":
        return _name(text, gender, key, variant)
    if kind == "credential" and text.startswith("AKIA"):
        return "AKIA" + deranged(text[4:], key, "AKIA")
    if kind == "credential" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return deranged(text, key, "hexadecimal", hexadecimal=True)
    return deranged(text, key, kind)


#: The pattern's named groups.
KINDS = tuple(PATTERN.groupindex)


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, text, gender) of each entity, from the left."""
    out = []
    for at, line in _lines(text):
        out += _find(line, at)
    return out


def _lines(text: str):
    """(start, line) of the lines that can hold an entity; none reaches over a line's end."""
    at = 0
    for line in text.split("\n"):
        if _may_hold(line):
            yield at, line
        at += len(line) + 1


def _find(text: str, at: int) -> list[tuple[int, int, str, str, str]]:
    out = []
    for m in PATTERN.finditer(text):
        kind = next(k for k in KINDS if m[k] is not None)
        # \K moves the match's start, not the group's
        gender = "n"
        if kind == "name":
            before = text[: m.start()].rstrip(" .").rsplit(None, 1)
            gender = TITLES.get(before[-1].strip("(\"'«“") if before else "", "n")
        elif kind == "given":
            kind, gender = "name", GENDER[m.group(0).split(" ")[0]]
        out.append((at + m.start(), at + m.end(), kind, m.group(0), gender))
    return out


# Months, days and common words that are family names too; alone they are taken for the word.
WORDS_TOO = frozenset("April May June August Will Can Power Grace Hope Rose Price Long Short Young Old Day Week Summer Winter King Bishop Park Hill Street Church Bank Rich Wise Good Best White Black Brown Green Марта Май Август".split())


def _a_word(name: str, text: str) -> bool:
    """Whether a family name is also a word: one of ``WORDS_TOO``, or in small letters in the text itself."""
    return name in WORDS_TOO or name != name.lower() and regex.search(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(name.lower())}(?![\p{{L}}\p{{N}}])", text) is not None


def replace(text: str, key: bytes = DEFAULT_KEY, variants: dict[tuple[str, str, str], int] | None = None) -> tuple[str, list[tuple[str, str, str, str]]]:
    """The text with surrogates, and (type, gender, original, surrogate) of each entity in order."""
    if not _may_hold(text):
        return text, []
    found, out, at, families = [], [], 0, {}
    for start, end, kind, own, gender in find(text):
        variant = (variants or {}).get((kind, gender, canonical(kind, own)), 0)
        new = surrogate(kind, own, key, gender, variant)
        if kind == "name":
            families[own.split(" ")[-1]] = new.split(" ")[-1]
        out += [text[at:start], new]
        found.append((kind, gender, own, new))
        at = end
    out.append(text[at:])
    # later mentions of a person by the family name alone, but for a name that the text also uses as a word
    families = {n: f for n, f in families.items() if not _a_word(n, text)}
    if families:
        again = regex.compile(r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(map(regex.escape, families), key=len, reverse=True)) + r")(?![\p{L}\p{N}])")
        out = [again.sub(lambda m: families[m.group(0)], x) if i % 2 == 0 else x for i, x in enumerate(out)]
    return "".join(out), found


ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "gender", "original", "surrogate")])
REPLACED = T.StructType([T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(ENTITY))])


def _replacer(key: bytes, shared=None):
    @F.pandas_udf(REPLACED)
    def of(texts: pd.Series) -> pd.DataFrame:
        variants = shared.value if shared is not None else None
        rows = [replace(t, key, variants) if isinstance(t, str) else (None, []) for t in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], "entities": [[dict(zip(("kind", "gender", "original", "surrogate"), e, strict=True)) for e in r[1]] for r in rows]})

    return of


def _surrogates(key: bytes):
    @F.pandas_udf(T.StringType())
    def of(genders: pd.Series, forms: pd.Series, variants: pd.Series) -> pd.Series:
        return pd.Series([surrogate("name", f, key, g, int(v)) for g, f, v in zip(genders, forms, variants, strict=True)], dtype=object)

    return of


def _names(key: bytes):
    """The names of each text, ``original`` in canonical form."""

    @F.pandas_udf(T.ArrayType(ENTITY))
    def of(texts: pd.Series) -> pd.Series:
        row = lambda e: dict(zip(("kind", "gender", "original", "surrogate"), (*e[:2], canonical(e[0], e[2]), e[3]), strict=True))
        return pd.Series([[row(e) for e in replace(t, key)[1] if e[0] == "name"] if isinstance(t, str) and _titled(t) else [] for t in texts], dtype=object)

    return of


def collisions(df: DataFrame, text: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """(kind, gender, form, variant): the canonical forms that must take another surrogate than their first one.

    Only names can collide (the rest is permuted); the aggregation runs over distinct names, partial sums first.
    Each round, of the originals that share a surrogate the one of least (variant, name) keeps it and the others take
    their next variant, so surrogates given before stay with their owners unless an earlier one comes to claim them.
    """
    ship(df.sparkSession)
    found = df.select(F.explode(_names(key)(F.col(text))).alias("e")).select("e.kind", "e.gender", F.col("e.original").alias("form"), F.lower("e.surrogate").alias("surrogate")).distinct()
    now = cut(found.select("kind", "gender", "form", F.col("form").alias("name"), F.lit(0).alias("variant"), "surrogate"))
    while True:
        # whose a surrogate is; a name's genders go together
        shared = now.groupBy("kind", "surrogate").agg(F.min(F.struct("variant", "name")).alias("first"), F.max(F.struct("variant", "name")).alias("last")).where("first <> last")
        moving = now.join(shared, ["kind", "surrogate"]).where(F.struct("variant", "name") != F.col("first")).select("kind", "name").distinct()
        moving = cut(moving)
        if moving.limit(1).count() == 0:
            return now.where("variant > 0").select("kind", "gender", "form", "variant")
        moved = now.join(moving, ["kind", "name"], "left_semi").withColumn("variant", F.col("variant") + 1)
        moved = moved.withColumn("surrogate", F.lower(_surrogates(key)(F.col("gender"), F.col("form"), F.col("variant"))))
        now = cut(now.join(moving, ["kind", "name"], "left_anti").unionByName(moved))


def _joined(df: DataFrame, taken: DataFrame, text: str, key: bytes) -> DataFrame:
    """``df`` with ``_pii``; variants reach each different text by a join on its names."""

    @F.pandas_udf(REPLACED)
    def of(texts: pd.Series, variants: pd.Series) -> pd.DataFrame:
        rows = []
        for t, v in zip(texts, variants, strict=True):
            known = {("name", e["gender"], e["form"]): e["variant"] for e in v} if v is not None else None
            rows.append(replace(t, key, known) if isinstance(t, str) else (None, []))
        return pd.DataFrame({"text": [r[0] for r in rows], "entities": [[dict(zip(("kind", "gender", "original", "surrogate"), e, strict=True)) for e in r[1]] for r in rows]})

    # texts are told apart by a digest, so that neither keys nor repeated rows matter
    marked = df.withColumn("_text", F.sha2(F.col(text), 256))
    named = marked.select("_text", F.explode(_names(key)(F.col(text))).alias("e")).select("_text", "e.kind", "e.gender", F.col("e.original").alias("form")).distinct()
    own = named.join(taken.hint("merge"), ["kind", "gender", "form"]).groupBy("_text").agg(F.collect_list(F.struct("gender", "form", "variant")).alias("_variants"))
    return marked.join(own.hint("merge"), "_text", "left").withColumn("_pii", of(F.col(text), F.col("_variants"))).drop("_text", "_variants")


def replace_pii(df: DataFrame, text: str = "text", key: bytes = DEFAULT_KEY, entities: str = "entities") -> DataFrame:
    """``df`` with ``text`` replaced and ``entities`` (type, gender, original, surrogate) listed; nothing is shuffled but
    names, and texts where there are more than MAX_BROADCAST_VARIANTS variants."""
    ship(df.sparkSession)
    taken = cut(collisions(df, text, key))
    n = taken.count()
    if n > MAX_BROADCAST_VARIANTS:
        got = _joined(df, taken, text, key)
    else:
        shared = df.sparkSession.sparkContext.broadcast({(r["kind"], r["gender"], r["form"]): r["variant"] for r in taken.collect()}) if n else None
        got = df.withColumn("_pii", _replacer(key, shared)(F.col(text)))
    return got.withColumns({text: F.col("_pii.text"), entities: F.col("_pii.entities")}).drop("_pii")


def op4_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    from .common import table

    got = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).alias(f"n_{kind}")
    return got.select("doc_id", "text", F.size("entities").alias("n_entities"), *[count(k) for k in ("email", "phone", "card", "ip", "iban", "identity", "credential", "name")])
