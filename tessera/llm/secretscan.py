"""Secret scan: patterns of credentials, and random strings by the token-efficiency test.

Three patterns are the base: assignments to telling names, access keys, and long runs of hexadecimal digits.  The
test adds what has no pattern: a vocabulary learnt from text spells text with few tokens and random strings with
many, so a run of ``MIN_RUN`` or more characters of the usual alphabets (letters, digits, ``+/_-``, and ``=`` at its end)
that takes more than one token for each ``MAX_RATIO`` characters is a random string.  A run counts as text if its
lower-cased form does: constants in capitals are spelt badly as they stand.  Left out are what looks random but is
known not to be a secret: digests (hexadecimal of a digest's length, or after a digest's name), UUIDs, ULIDs, addresses of
40 hexadecimal digits after ``0x``, account numbers whose check digits hold, and numbers with separators; so are
runs inside a base span, which are found already.

Defined results: a null text is an empty one, and has no spans; a pattern's match covers its name and its value;
matches of one kind don't overlap, those of two may; a match that is too short uses its characters up all the same;
spans are in code points, end exclusive, ordered by start, then kind; repeated rows give equal results; texts are read
whole, whatever their length; columns named as the results are replaced, others pass through; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
import threading

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: The kinds' patterns in the order of the kinds, the group whose length counts, and its least length.
PATTERNS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", re.A, 0, 20),
    ("hex", r"[0-9a-f]+", re.A, 0, 24),
)
BASE, RANDOM = tuple(p[0] for p in PATTERNS), "random"
MIN_RUN, MAX_RATIO = 20, 1.9
#: Hexadecimal digits of MD5, SHA-1, Tiger, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
SPANS = "array<struct<kind: string, start: int, end: int>>"

_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}")
_KNOWN = re.compile(
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # a UUID
    r"|[0-7][0-9A-HJKMNP-TV-Z]{25}"  # a ULID
    r"|0x[0-9A-Fa-f]{40}"
    r"|(md5|sha1|sha224|sha256|sha384|sha512)[-_/][A-Za-z0-9+/]+=*"
    r"|[0-9+/_-]+"
)
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def _account_number(s: str) -> bool:
    """Whether the check digits of an international account number hold."""
    return bool(_ACCOUNT.fullmatch(s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def known_value(s: str) -> bool:
    """Whether a run is a digest or an identifier by its form."""
    return bool(len(s) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) or _KNOWN.fullmatch(s) or _account_number(s))


class Scanner:
    """The patterns, and the test under one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.patterns = [(kind, re.compile(p, flags), group, least) for kind, p, flags, group, least in PATTERNS]

    def ratio(self, s: str) -> float:
        """Characters a token."""
        return len(s) / len(self.encoding.encode_ordinary(s))

    def random(self, s: str) -> bool:
        own = s.rstrip("=")
        return 2 * sum(map(str.isalnum, own)) > len(own) and not known_value(s) and self.ratio(own) < MAX_RATIO and self.ratio(own.lower()) < MAX_RATIO

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """(start, place of the kind, end) of the base spans, in order."""
        return sorted((m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(self.patterns) for m in p.finditer(text) if m.end(group) - m.start(group) >= least)

    def spans(self, text: str, judged: dict[str, bool]) -> list[dict]:
        """All spans in order; ``judged`` remembers runs."""
        found = self.base(text)
        # base spans by start, with the furthest end so far: a run lies in one if it does in the furthest that starts before it
        covers, reach, at = list(found), -1, 0
        for m in _RUN.finditer(text):
            while at < len(covers) and covers[at][0] <= m.start():
                reach, at = max(reach, covers[at][2]), at + 1
            if m.end() <= reach:
                continue
            s = m.group()
            if s not in judged:
                judged[s] = self.random(s)
            if judged[s]:
                found.append((m.start(), len(BASE), m.end()))
        return [{"kind": (*BASE, RANDOM)[k], "start": a, "end": b} for a, k, b in sorted(found)]


_local = threading.local()


def scanner(key: str, ranks: dict[bytes, int], pattern: str) -> Scanner:
    """This process's scanner for a vocabulary, made at its first use."""
    own = _local.__dict__.setdefault("scanners", {})
    if key not in own:
        own[key] = Scanner(ranks, pattern)
    return own[key]


def find_secrets(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``secrets``: the spans of each whole text."""
    ship(df.sparkSession)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast((key, ranks, pattern))  # a vocabulary: of fixed size

    @F.pandas_udf(SPANS)
    def of(texts: pd.Series) -> pd.Series:
        s, judged = scanner(*shared.value), {}
        return pd.Series([s.spans(t, judged) if isinstance(t, str) else [] for t in texts], dtype=object)

    return df.withColumn("secrets", of(F.col(text)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import read_ranks
    from .common import table

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in (*BASE, RANDOM)],
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != RANDOM)), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
