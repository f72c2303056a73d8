"""Functions that Spark's built-ins can't express, over Arrow batches."""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
# Prefixes of features and their weights; a word's trigrams count from this many letters on.
WORD, TRIGRAM, PAIR = ("w:", 1.0), ("g:", 0.18), ("b:", 0.45)
TRIGRAMS_FROM = 6


#: So many features' digests a worker remembers before it starts over.
REMEMBERED = 200_000
_digests: dict[str, int] = {}


def _codes(features: list[str]) -> np.ndarray:
    """Eight-byte digests of features, as numbers."""
    if len(_digests) > REMEMBERED:
        _digests.clear()
    new = list({f for f in features if f not in _digests})
    made = np.frombuffer(b"".join([hashlib.blake2b(f.encode(), digest_size=8).digest() for f in new]), "<u8").tolist()
    _digests.update(zip(new, made, strict=True))
    return np.array([_digests[f] for f in features], np.uint64)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(words: pd.Series) -> pd.Series:
    """Stemmed tokens to a unit vector of signed feature hashes; no tokens give a zero vector, null gives null.

    A batch is one matrix: each different word is taken apart once, each different feature digested once, and all
    occurrences are added in one go.
    """
    rows = [[] if w is None else list(w) for w in words]
    sizes = np.array([len(r) for r in rows], np.int64)
    number: dict[str, int] = {}
    at = np.array([number.setdefault(w, len(number)) for r in rows for w in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    different = list(number) or [""]
    # a word's own features, word by word
    own = [[WORD[0] + w] + [TRIGRAM[0] + w[i : i + 3] for i in range(len(w) - 2) if len(w) >= TRIGRAMS_FROM] for w in different]
    count = np.array(list(map(len, own)), np.int64)
    code, weight = _codes([f for fs in own for f in fs]), np.concatenate([[WORD[1]] + [TRIGRAM[1]] * (n - 1) for n in count])
    start, n = np.cumsum(count) - count, count[at]
    place = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    # neighbours of one text
    near = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    pairs, which = np.unique(at[near] * len(different) + at[near + 1], return_inverse=True)
    code_of_pair = _codes([f"{PAIR[0]}{different[p // len(different)]}:{different[p % len(different)]}" for p in pairs.tolist()])
    code = np.concatenate([code[place], code_of_pair[which]])
    weight = np.concatenate([weight[place], np.full(len(near), PAIR[1])])
    cell = np.concatenate([np.repeat(owner, n), owner[near]]) * DIMENSIONS + (code % np.uint64(DIMENSIONS)).astype(np.int64)
    out = np.bincount(cell, np.where(code % np.uint64(2) == 1, weight, -weight), len(rows) * DIMENSIONS).reshape(len(rows), DIMENSIONS)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    out /= np.where(length > 0, length, 1.0)
    return pd.Series([None if w is None else v for w, v in zip(words, out, strict=True)], dtype=object)


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in the matching blocks of two strings."""
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML character references decoded."""
    return s.map(lambda x: html.unescape(x) if x is not None else None)


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    """NFKC, case folded."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold() if x is not None else None)


def merged(base, over, role: str = "role", blocks: str = "blocks"):
    """Deep merge: dictionaries key by key; under the key ``blocks``, dictionaries of one role whatever its case; an override
    that is null or empty changes nothing; anything else is replaced."""
    if over is None or over in ("", [], {}):
        return base
    if not (isinstance(base, dict) and isinstance(over, dict)):
        return over
    out = dict(base)
    for key, value in over.items():
        old = base.get(key)
        if key == blocks and isinstance(old, list) and isinstance(value, list):
            out[key] = _by_role(old, value, role)
        else:
            out[key] = merged(old, value, role, blocks)
    return out


def _by_role(old: list, new: list, role: str) -> list:
    name = lambda b: str(b.get(role, "")).casefold() if isinstance(b, dict) else ""
    out, place = list(old), {name(b): i for i, b in enumerate(old) if name(b)}
    for b in new:
        if name(b) in place:
            out[place[name(b)]] = merged(out[place[name(b)]], b, role)
        else:
            place[name(b) or id(b)] = len(out)
            out.append(b)
    return out


@F.pandas_udf(T.StringType())
def merged_json(base: pd.Series, over: pd.Series) -> pd.Series:
    """``merged`` of two JSON texts, keys sorted; null or broken JSON counts as empty."""

    def read(x):
        try:
            return json.loads(x) if x is not None else None
        except ValueError:
            return None

    return pd.Series([json.dumps(merged(read(b) or {}, read(o)), sort_keys=True, ensure_ascii=False) for b, o in zip(base, over, strict=True)], dtype=object)
