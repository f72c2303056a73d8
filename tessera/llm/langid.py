"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's vector is the mean of the embeddings of its byte n-grams (hashed into buckets); a linear
softmax turns it into language probabilities.  Both layers are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows, whose n-grams the executors count over the whole texts; the probabilities
are tempered on rows kept out of the training, and the rejection level is the one that keeps ``KEPT_SHARE`` of them.

As both layers are linear, the trained model folds into one (buckets x languages) matrix, so predicting
costs one gather for each n-gram, whatever the embedding's size.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no labelled row (or
an empty table) every text is ``und``; of equal scores the first language in alphabetical order wins;
repeated rows get equal results; very long texts are read whole, in slices of fixed size; columns of
the output's names are replaced, others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

BUCKETS, WIDTH, SIZES = 1 << 14, 16, (1, 2, 3, 4)
EPOCHS, BATCH, RATE, SNIPPETS = 12, 64, 8.0, 3
KEPT_SHARE = 0.99
SLICE = 1 << 20
PAD = b" " * 4
LETTER = regex.compile(r"\p{L}")

#: The fit's bound: labelled rows.
MAX_TRAIN_ROWS = 2000


def _hashes(a: np.ndarray, start: int, end: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that begin in [start, end), by size; ``a`` ends in a pad."""
    h = np.full(end - start, 2166136261, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(max(SIZES)):
            h = (h ^ a[start + k : end + k]) * np.uint32(16777619)
            if k + 1 in SIZES:
                yield ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.intp)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, and the share of each."""
    a, out = np.frombuffer(text + PAD, np.uint8).astype(np.uint32), np.zeros(BUCKETS)
    for s in range(0, len(text), SLICE):
        for h in _hashes(a, s, min(len(text), s + SLICE)):
            out += np.bincount(h, minlength=BUCKETS)
    found = np.flatnonzero(out)
    return found.astype(np.uint16), (out[found] / max(1.0, out.sum())).astype(np.float32)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (found, share) in enumerate(rows):
        x[i, found] = share
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """What predicting needs: languages, the folded matrix, bias, temperature and rejection level."""

    def __init__(self, langs: list[str], matrix: np.ndarray, bias: np.ndarray, heat: float = 1.0, reject: float = 0.0) -> None:
        self.langs, self.matrix, self.bias, self.heat, self.reject = langs, matrix.astype(np.float32), bias, heat, reject

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """One row a text; each text's sums are formed apart from its neighbours', so the order of rows changes nothing."""
        out = np.zeros((len(texts), len(self.langs)))
        group, size = [], 0
        for i, t in enumerate(texts):
            if len(t) > SLICE:
                self._long(t, out[i])
                continue
            group.append(i)
            size += len(t)
            if size >= SLICE:
                self._many(texts, group, out)
                group, size = [], 0
        if group:
            self._many(texts, group, out)
        n = np.array([max(1, len(t) * len(SIZES)) for t in texts], float)[:, None]
        return (out / n + self.bias) / self.heat

    def _long(self, text: bytes, out: np.ndarray) -> None:
        a = np.frombuffer(text + PAD, np.uint8).astype(np.uint32)
        for s in range(0, len(text), SLICE):
            for h in _hashes(a, s, min(len(text), s + SLICE)):
                out += self.matrix[h].sum(axis=0, dtype=np.float64)

    def _many(self, texts: list[bytes], group: list[int], out: np.ndarray) -> None:
        full = [i for i in group if texts[i]]
        if not full:
            return
        joined = PAD.join(texts[i] for i in full) + PAD
        a = np.frombuffer(joined, np.uint8).astype(np.uint32)
        sizes = np.array([len(texts[i]) for i in full])
        starts = np.concatenate(([0], np.cumsum(sizes[:-1] + len(PAD))))
        # the pads between texts begin n-grams too: they form segments of their own, which are skipped
        edges = np.stack([starts, starts + sizes], axis=1).ravel()
        for h in _hashes(a, 0, len(joined) - len(PAD)):
            for c in range(len(self.langs)):
                got = np.add.reduceat(self.matrix[:, c][h].astype(np.float64), edges[:-1])
                out[full, c] += got[::2]


def counted(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-gram shares of a whole text, and of random snippets of it, so that short texts are known too."""
    b = _bytes(text)
    rng = np.random.default_rng(zlib.crc32(b))
    out = [shares(b)]
    for _ in range(SNIPPETS):
        n = int(rng.integers(15, 200))
        s = int(rng.integers(0, max(1, len(b) - n)))
        out.append(shares(b[s : s + n]))
    return out


def fit(samples: list[list[tuple[np.ndarray, np.ndarray]]], langs: list[str], seed: int = 7) -> Model | None:
    """Train on counted texts and their snippets."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    held = rng.random(len(samples)) < 0.2
    if held.all() or not held.any() or len(samples) < 20:
        held[:] = False
    x, y, kept, kept_y = [], [], [], []
    for pieces, lang, out in zip(samples, langs, held, strict=True):
        (kept if out else x).extend(pieces)
        (kept_y if out else y).extend([names.index(lang)] * len(pieces))
    y = np.array(y)
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for s in range(0, len(x), BATCH):
            part = order[s : s + BATCH]
            xb = _dense([x[i] for i in part])
            hidden = xb @ e
            p = _softmax(hidden @ w + bias)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ w.T
            w -= rate * hidden.T @ p
            bias -= 0.1 * rate * p.sum(axis=0)
            e -= rate * 20 * xb.T @ back
    model = Model(names, e @ w, bias.astype(float))
    if kept:
        z = np.concatenate([_dense(kept[i : i + BATCH]) @ model.matrix for i in range(0, len(kept), BATCH)]) + model.bias
        truth = np.array(kept_y)
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean()
        model.heat = float(min(np.geomspace(0.05, 20, 60), key=loss))
        model.reject = float(np.quantile(_softmax(z / model.heat).max(axis=1), 1 - KEPT_SHARE))
    return model


PIECES = T.ArrayType(T.StructType([T.StructField("found", T.BinaryType()), T.StructField("share", T.BinaryType())]))


@F.pandas_udf(PIECES)
def _counted(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"found": f.astype("<u2").tobytes(), "share": s.astype("<f4").tobytes()} for f, s in counted(t)] for t in texts], dtype=object)


def train(df: DataFrame, text: str, lang: str, key: str, learn: Column, max_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """Fit on the ``max_rows`` labelled rows whose keys hash lowest, an even sample of all that ``learn`` admits, whatever
    their length; repeated rows count once.  The driver gets what the executors have counted: at most ``BUCKETS`` shares a row,
    besides its snippets'."""
    usable = df.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.xxhash64(key).alias("_h"), F.col(key).alias("_k"), F.col(lang).cast("string").alias("_l"), F.col(text).alias("_t"))
    last = usable.select("_h").orderBy("_h").limit(max_rows).agg(F.max("_h")).first()[0]
    if last is None:
        return None
    ship(df.sparkSession)
    few = usable.where(F.col("_h") <= last).withColumn("_d", F.xxhash64("_t"))
    own = ["_h", "_k", "_l", "_d"]
    chosen = few.select(own).distinct().orderBy(own).limit(max_rows)
    same = F.lit(True)
    for c in own:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    rows = few.alias("a").join(F.broadcast(chosen).alias("b"), same, "left_semi").dropDuplicates(own).select("_h", "_k", "_d", "_l", _counted("_t").alias("pieces"))  # max_rows rows
    got = sorted(rows.collect(), key=lambda r: (r["_h"], str(r["_k"]), r["_l"], r["_d"]))
    decoded = [[(np.frombuffer(p["found"], "<u2"), np.frombuffer(p["share"], "<f4")) for p in r["pieces"]] for r in got]
    return fit(decoded, [r["_l"] for r in got])


RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predict_language(df: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``df`` with each whole text's language, its calibrated probability, and whether that is below the rejection level."""
    if model is None:
        return df.withColumns({lang: F.lit("und"), score: F.lit(0.0), rejected: F.lit(True)})
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x languages

    @F.pandas_udf(RESULT)
    def of(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        raw = [t if isinstance(t, str) and LETTER.search(t) else None for t in texts]
        p = _softmax(m.logits([_bytes(t) if t else b"" for t in raw])) if raw else np.zeros((0, len(m.langs)))
        best = p.argmax(axis=1) if raw else np.zeros(0, int)
        return pd.DataFrame(
            {
                "lang": [m.langs[b] if t else "und" for t, b in zip(raw, best, strict=True)],
                "score": [float(p[i, b]) if t else 0.0 for i, (t, b) in enumerate(zip(raw, best, strict=True))],
                "rejected": [not t or bool(p[i, b] < m.reject) for i, (t, b) in enumerate(zip(raw, best, strict=True))],
            }
        )

    got = df.withColumn("_lang", of(F.col(text)))
    return got.withColumns({lang: F.col("_lang.lang"), score: F.col("_lang.score"), rejected: F.col("_lang.rejected")}).drop("_lang")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, "text", "lang", "doc_id", ~held)
    return predict_language(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
