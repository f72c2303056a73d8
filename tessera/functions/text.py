"""Text expressions: normalising, tokens, stems, identifiers, scripts.  All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[0-9\p{L}]{3,}"

# Stop words, by language of the provided tables and of the registry's.
STOP_WORDS = (
    "the and for that with this from are was not but have has had his her its they their which "
    "und der die das ist nicht mit von den ein eine auf für "
    "les des est une que qui dans pour par sur pas "
    "los las una por para con del como más "
    "для что это как при или его она они был были также"
).split()
# Cyrillic letters and their Latin spelling.
TRANSLIT = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
        ["a", "b", "v", "g", "d", "e", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "yu", "ya"],
        strict=True,
    )
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def squeeze(s: Column) -> Column:
    """NUL to space, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(s, F.lit("\x00"), F.lit(" ")), r"(?U)\s+", " "))


def normalise(s: Column, keep_punctuation: bool = True) -> Column:
    """Lower case, ё as е, ß as ss, white space squeezed; optionally letters and digits alone."""
    out = F.replace(F.replace(F.lower(squeeze(s)), F.lit("ё"), F.lit("е")), F.lit("ß"), F.lit("ss"))
    return out if keep_punctuation else F.trim(F.regexp_replace(out, r"[^0-9\p{L}]+", " "))


def tokens(s: Column) -> Column:
    """Lower-case tokens of three characters or more, in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(TOKEN), F.lit(0))


def distinct_tokens(s: Column) -> Column:
    return F.array_distinct(tokens(s))


def content_tokens(s: Column) -> Column:
    """Tokens that aren't stop words, in order, with repeats."""
    return F.filter(tokens(s), lambda w: ~w.isin(STOP_WORDS))


# Tokens of the hashed embedding, and Russian endings in the order in which they are tried.
EMBEDDED_TOKEN = r"[0-9a-zа-яё][0-9a-zа-яё_-]*"
ENDINGS = (
    "иями", "ями", "ами", "ого", "ему", "ому", "ими", "ыми", "иях",
    "ах", "ях", "ов", "ев", "ий", "ый", "ой", "ая", "яя", "ое", "ее", "ые", "ие",
    "ить", "ать", "ять", "ение", "ания", "ения", "ию", "ия",
    "ам", "ям", "ом", "ем", "ы", "и", "а", "я", "у", "ю", "е",
)


def stem(word: Column, suffixes: tuple[str, ...] = ENDINGS, least: int = 4) -> Column:
    """``word`` less the first suffix, in list order, that leaves ``least`` characters."""
    out = word
    for x in reversed(suffixes):
        out = F.when(word.endswith(x) & (F.length(word) - len(x) >= least), F.substring(word, F.lit(1), F.length(word) - len(x))).otherwise(out)
    return out


def embedded_tokens(s: Column) -> Column:
    """Stemmed tokens for the hashed embedding; words of under five letters stay whole."""
    words = F.regexp_extract_all(F.replace(F.lower(F.coalesce(s, F.lit(""))), F.lit("ё"), F.lit("е")), F.lit(EMBEDDED_TOKEN), F.lit(0))
    return F.transform(words, lambda w: F.when(F.length(w) < 5, w).otherwise(stem(w)))


def count_of(s: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(s, F.lit("")), F.lit(pattern))


def script_language(s: Column, ratio: float = 1.2, least: int = 12) -> Column:
    """``ru`` or ``en`` where one script has ``least`` letters and ``ratio`` times the other's, else ``mixed`` or ``unknown``."""
    cyrillic, latin = count_of(s, r"\p{IsCyrillic}"), count_of(s, "[A-Za-z]")
    return (
        F.when((cyrillic >= least) & (cyrillic > latin * ratio), "ru")
        .when((latin >= least) & (latin > cyrillic * ratio), "en")
        .when(cyrillic + latin == 0, "unknown")
        .otherwise("mixed")
    )


def mixed_script_tokens(s: Column, most: int | None = 20) -> Column:
    """The first tokens that mix Cyrillic and Latin letters; the limit is the report's, None gives all."""
    words = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"[A-Za-zА-Яа-яЁё]{2,}"), F.lit(0))
    mixed = F.filter(words, lambda w: w.rlike("[A-Za-z]") & w.rlike("[А-Яа-яЁё]"))
    return mixed if most is None else F.slice(mixed, 1, most)


def upper_share(s: Column) -> Column:
    letters = count_of(s, r"\p{L}")
    return F.when(letters == 0, 0.0).otherwise(count_of(s, r"\p{Lu}") / letters)


def transliterate(s: Column) -> Column:
    out = F.lower(s)
    for a, b in TRANSLIT.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def key_of(s: Column) -> Column:
    """A catalogue key: Latin letters that look Cyrillic folded, ё as е, letters and digits alone."""
    return F.regexp_replace(F.translate(F.lower(s), "bcё", "все"), r"[^0-9\p{L}]", "")


def issn(s: Column) -> Column:
    """ISSNs in a text, as NNNN-NNNX."""
    found = F.regexp_extract_all(F.upper(F.coalesce(s, F.lit(""))), F.lit(r"(?<!\d)(\d{4})-?(\d{3}[\dX])(?!\d)"), F.lit(0))
    return F.transform(found, lambda x: F.concat(F.substring(x, 1, 4), F.lit("-"), F.right(x, F.lit(4))))


def orcid_valid(s: Column) -> Column:
    """ISO 7064 mod 11-2 over the sixteen characters of an ORCID."""
    bare = F.upper(F.replace(s, F.lit("-"), F.lit("")))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, i: (a + F.substring(bare, i, F.lit(1)).try_cast("int")) * 2 % 11)
    check = (12 - total) % 11
    return F.coalesce(bare.rlike(r"^\d{15}[\dX]$") & (F.right(bare, F.lit(1)) == F.when(check == 10, "X").otherwise(check.cast("string"))), F.lit(False))


EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
URL = r"https?://[^\s<>]+"
DOI = r"10\.\d{4,9}/[^\s]+"


def shorten(s: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))).otherwise(s)


def coverage(a: Column, b: Column) -> Column:
    """Share of the distinct values of ``a`` that ``b`` holds; 1 where ``a`` has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def sentences(s: Column) -> Column:
    """Pieces that end in . ! or ? before white space and a capital."""
    return F.split(F.regexp_replace(s, r"([.!?])[ \n\t\r]+(\p{Lu})", "$1\x01$2"), "\x01")
