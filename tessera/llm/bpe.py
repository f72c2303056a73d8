"""Byte-level BPE encoding and decoding with DuckDB recursive queries.

Each executor's Python worker keeps one in-process DuckDB with two tables made from the vocabulary's
ranks: ``merges`` (two token ids and the id of their concatenation) and ``tokens`` (id, bytes).  A batch's
new pieces become token-position rows (piece, position, token); a recursive query joins neighbouring
rows to ``merges`` and contracts each piece's leftmost minimum-rank pair, until none is left.  A piece that is a
token itself needs no contracting, and is looked up.  Decoding works on whole documents: their ids in order are
joined to ``tokens`` and concatenated by ordered aggregation, at most ``ROWS_A_QUERY`` ids in a query.

Pieces recur, so a worker remembers what it has encoded (``REMEMBERED`` bytes; then it starts over):
the recursive query runs over pieces that are new to the worker.  At the end of a task it drops them and closes its
DuckDB, so that a worker that waits for the next task, of whatever query, holds little.  With the pattern ``SPACED``, a text splits at
every space that has no white space after it, which that pattern never crosses, so each batch goes through the
pattern once for each different chunk; with another pattern, whole texts go through it.

Pieces of over ``LONG`` bytes are first cut between bytes that no token holds side by side, where no
merge can reach across.  What stays long is encoded in windows of ``LONG`` bytes, whose joints are verified: a row of
tokens is the encoding of its bytes if and only if each two neighbours are that of theirs, since the first merge that
reached across a joint would do so in the two neighbours alone as well.  Around a joint that doesn't hold, a window
between the middles of its neighbours is encoded, then wider ones, until all joints hold.  So time grows with a piece's
length.  Where a joint doesn't hold within ``WIDEST`` bytes (a remainder that every window hands on to the next), the
segment is read from left to right by the same rule: of each prefix, the last token is the one that fits the token
before it.

Defined results: a null text encodes as an empty one (0 tokens); special tokens' strings are ordinary
text; repeated rows give equal results; texts are encoded whole; columns named as the results are
replaced, others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

LONG, WIDEST, REMEMBERED, ROWS_A_QUERY = 64, 1 << 10, 64 << 20, 1 << 17
#: Bytes of an entry besides its own.
ENTRY = 120

#: Fixed value: the public pattern whose pieces never cross a space before a word.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: ``g`` is a row's place among all; ``s`` is a pair's rank above, its left row's place below, so that the
#: least ``s`` of a piece is its leftmost pair of minimum rank.
ENCODE = """
WITH RECURSIVE state(g, w, tok, live) AS (
  SELECT g, w, tok, true FROM fresh
  UNION ALL
  SELECT * FROM (
    WITH pairs AS (
      SELECT g, w, tok, CASE WHEN lead(w) OVER place = w THEN lead(tok) OVER place END AS ntok, lag(g) OVER place AS pg
      FROM state WHERE live WINDOW place AS (ORDER BY g)),
    ranked AS (
      SELECT g, w, tok, pg, (m.t::BIGINT << 32) | g AS s
      FROM pairs LEFT JOIN merges m ON m.k = (pairs.tok::BIGINT << 32) | pairs.ntok),
    best AS (SELECT w, min(s) AS s FROM ranked GROUP BY w)
    SELECT r.g, r.w, CASE WHEN r.s = b.s THEN (b.s >> 32)::INTEGER ELSE r.tok END AS tok, b.s IS NOT NULL AS live
    FROM ranked r JOIN best b ON r.w = b.w
    WHERE b.s IS NULL OR r.pg IS DISTINCT FROM b.s & 4294967295))
SELECT w, tok FROM state WHERE NOT live ORDER BY g
"""

#: Bytes are kept as the characters of their numbers, so that they can be joined as text.
DECODE = """
SELECT w, array_to_string(list(chars ORDER BY g), '') AS chars
FROM (SELECT f.w, f.g, t.chars FROM fresh f JOIN tokens t ON t.id = f.tok) GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, lines))}


class Codec:
    """A vocabulary in DuckDB, with what this process has encoded so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split, self.spaced = ranks, regex.compile(pattern), pattern == SPACED
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        l, r, t = (np.array(x, np.int32) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int32),) * 3
        self.tokens = {r: t for t, r in ranks.items()}
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.size[list(ranks.values())] = list(map(len, ranks))
        self.beside = np.zeros((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                self.beside[b[:-1], b[1:]] = True
        self.tables = {
            "merges": pa.table({"k": (l.astype(np.int64) << 32) + r, "t": t}),
            "tokens": pa.table({"id": np.array(list(ranks.values()), np.int32), "chars": pa.array([k.decode("latin-1") for k in ranks], pa.string())}),
        }
        self.db = None
        #: what tokens end in; made at its first use
        self.ends: set[bytes] = set()
        self.forget()

    def forget(self) -> None:
        #: ids of each piece; whether two tokens beside each other stay as they are; about the bytes of both
        self.pieces: dict[bytes, bytes] = {}
        self.fits: dict[tuple[int | None, int], bool] = {}
        self.held = 0

    def rest(self) -> None:
        """Give back what only encoding needs; the next text makes it anew."""
        self.forget()
        if self.db is not None:
            self.db.close()
            self.db = None
        pa.default_memory_pool().release_unused()

    def _open(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": False})
        for name, rows in self.tables.items():
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _run(self, sql: str, sizes: np.ndarray, tok: np.ndarray) -> pa.Table:
        """``sql`` over token-position rows: ``sizes[w]`` rows of each piece w, in order."""
        if self.db is None:
            self._open()
        w = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.db.register("fresh", pa.table({"g": np.arange(len(w), dtype=np.int64), "w": w, "tok": tok.astype(np.int32)}))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister("fresh")

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers."""
        out: list[bytes] = []
        for part in self._batches(pieces):
            got = self._run(ENCODE, np.array([len(x) for x in part]), self.byte[np.frombuffer(b"".join(part), np.uint8)])
            raw = got["tok"].to_numpy().astype("<u4").tobytes()
            at = 4 * np.searchsorted(got["w"].to_numpy(), np.arange(len(part) + 1))
            out += [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out

    @staticmethod
    def _batches(pieces: list[bytes]) -> Iterator[list[bytes]]:
        """``pieces`` in batches of about ``ROWS_A_QUERY`` bytes."""
        start = size = 0
        for end, x in enumerate(pieces, 1):
            size += len(x)
            if size >= ROWS_A_QUERY or end == len(pieces):
                yield pieces[start:end]
                start, size = end, 0

    def _learn_pieces(self, pieces: set[bytes]) -> None:
        fresh = list(pieces - self.pieces.keys())
        known = {x: self.ranks[x].to_bytes(4, "little") for x in fresh if x in self.ranks}
        short = [x for x in fresh if x not in known and len(x) <= LONG]
        known.update(zip(short, self.contract(short), strict=True))
        if long := [x for x in fresh if x not in known]:
            cut = [self._segments(x) for x in long]
            own = list({s for segments in cut for s in segments})
            small, large = [s for s in own if len(s) <= LONG], [s for s in own if len(s) > LONG]
            parts = dict(zip(small, self.contract(small), strict=True)) | dict(zip(large, self._settled(large), strict=True))
            known.update({x: b"".join(map(parts.__getitem__, segments)) for x, segments in zip(long, cut, strict=True)})
        self.pieces.update(known)
        self.held += sum(len(x) + len(ids) + ENTRY for x, ids in known.items())

    def _segments(self, piece: bytes) -> list[bytes]:
        b = np.frombuffer(piece, np.uint8)
        at = [0, *(np.flatnonzero(~self.beside[b[:-1], b[1:]]) + 1).tolist(), len(piece)]
        return [piece[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def _settled(self, segments: list[bytes]) -> list[bytes]:
        """The ids of long segments: windows, then wider ones around the joints that don't hold."""
        if not segments:
            return []
        data, borders = b"".join(segments), np.cumsum([0, *map(len, segments)])

        def encoded(edges: list[tuple[int, int]]) -> list[np.ndarray]:
            of = [data[a:b] for a, b in edges]
            different = list(dict.fromkeys(of))
            ids = dict(zip(different, self.contract(different), strict=True))
            return [np.frombuffer(ids[x], "<u4") for x in of]

        cuts = np.unique(np.concatenate([borders, *[np.arange(a, b, LONG) for a, b in itertools.pairwise(borders.tolist())]]))
        ids = np.concatenate(encoded(list(itertools.pairwise(cuts.tolist()))))
        suspects, reach = np.setdiff1d(cuts, borders), LONG // 2
        while True:
            marks = np.concatenate(([0], np.cumsum(self.size[ids])))
            at = np.searchsorted(marks, suspects)
            bad = np.flatnonzero(~self._fit(ids[at - 1], ids[at]))
            if not len(bad):
                break
            joint, at = suspects[bad], at[bad]
            of = np.searchsorted(borders, joint, "right")
            # from a token's start within reach to a token's end within reach, one token each at least
            a = np.minimum(marks[np.searchsorted(marks, np.maximum(joint - reach, borders[of - 1]))], marks[at - 1])
            b = np.maximum(marks[np.searchsorted(marks, np.minimum(joint + reach, borders[of]), "right") - 1], marks[at + 1])
            edges: list[list[int]] = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                if edges and x < edges[-1][1]:
                    edges[-1][1] = max(edges[-1][1], y)
                else:
                    edges.append([x, y])
            for i in sorted({int(np.searchsorted(borders, x, "right")) for x, y in edges if y - x > WIDEST}):
                whole = borders[i - 1 : i + 1].tolist()
                edges = sorted([*[e for e in edges if not whole[0] <= e[0] < whole[1]], whole])
            new = encoded([e for e in edges if e[1] - e[0] <= WIDEST])
            place, parts, k = 0, [], 0
            for x, y in edges:
                i, j = np.searchsorted(marks, [x, y])
                parts.append(ids[place:i])
                if y - x <= WIDEST:
                    parts.append(new[k])
                    k += 1
                else:
                    parts.append(self._read(data[x:y]))
                place = j
            ids = np.concatenate([*parts, ids[place:]])
            suspects, reach = np.setdiff1d(np.array(edges).ravel(), borders), 2 * reach
        return [ids[i:j].astype("<u4").tobytes() for i, j in itertools.pairwise(np.searchsorted(marks, borders).tolist())]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two tokens are the encoding of their bytes."""
        both = list(zip(left.tolist(), right.tolist(), strict=True))
        fresh = [p for p in dict.fromkeys(both) if p not in self.fits]
        self.fits.update({p: ids == np.array(p, "<u4").tobytes() for p, ids in zip(fresh, self.contract([self.tokens[a] + self.tokens[b] for a, b in fresh]), strict=True)})
        self.held += ENTRY * len(fresh)
        return np.array([self.fits[p] for p in both], bool)

    def _read(self, segment: bytes) -> np.ndarray:
        """The ids of a segment, from the last tokens of its prefixes."""
        if not self.ends:
            self.ends = {t[i:] for t in self.ranks for i in range(len(t))}
        last = np.full(len(segment) + 1, -1, np.int64)
        for i in range(1, len(segment) + 1):
            n = 1
            while n <= i and (x := segment[i - n : i]) in self.ends:
                if (t := self.ranks.get(x)) is not None and self._stays(int(last[i - n]) if n < i else None, t):
                    last[i] = t
                    break
                n += 1
        out, i = [], len(segment)
        while i:
            out.append(int(last[i]))
            i -= self.size[out[-1]]
        return np.array(out[::-1], "<u4")

    def _stays(self, before: int | None, token: int) -> bool:
        """As ``_fit``, for two tokens or a single one, contracted here."""
        if (known := self.fits.get((before, token))) is None:
            parts = [bytes([x]) for x in self.tokens.get(before, b"") + self.tokens[token]]
            while (best := min(((self.ranks[x + y], i) for i, (x, y) in enumerate(itertools.pairwise(parts)) if x + y in self.ranks), default=None)) is not None:
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            known = self.fits[before, token] = [self.ranks[x] for x in parts] == [x for x in (before, token) if x is not None]
            self.held += ENTRY
        return known

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each sequence of ids stands for; a long sequence is decoded in slices."""
        of, slices, out = [], [], [[] for _ in ids]
        for i, x in enumerate(ids):
            for s in range(0, len(x), 4 * ROWS_A_QUERY):
                of.append(i)
                slices.append(x[s : s + 4 * ROWS_A_QUERY])
        sizes = np.array(list(map(len, slices)), np.int64) // 4
        start, ends = 0, np.cumsum(sizes)
        while start < len(slices):
            end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + ROWS_A_QUERY, "right")))
            got = self._run(DECODE, sizes[start:end], np.frombuffer(b"".join(slices[start:end]), "<u4"))
            for i, chars in zip(of[start:end], got["chars"].to_pylist(), strict=True):
                out[i].append(chars.encode("latin-1"))
            start = end
        return [b"".join(x) for x in out]

    def _chunks(self, chunks: list[str], lead: str) -> list[bytes]:
        """Ids of each chunk after ``lead``: letters alone are one piece, what else there is goes through the pattern."""
        split = [(lead + c).encode() if self.spaced and c.isalpha() else [x.encode() for x in self.split.findall(lead + c)] for c in chunks]
        self._learn_pieces({x for x in split if type(x) is bytes}.union(*[x for x in split if type(x) is list]))
        ids = self.pieces
        return [ids[x] if type(x) is bytes else b"".join([ids[p] for p in x]) for x in split]

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text, the ids (little-endian, 32 bits each) and the bytes that they decode to."""
        ids = self.ids(texts)
        return list(zip(ids, self.decode(ids), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text, the ids (little-endian, 32 bits each)."""
        if not texts:
            return []
        if self.held > REMEMBERED:
            self.forget()
        if not self.spaced:
            return self._chunks(texts, "")
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = lists.offsets.to_numpy()
        begin = np.zeros(int(at[-1]), bool)
        begin[at[:-1]] = True
        rest = lists.flatten().filter(pa.array(~begin)).dictionary_encode()
        rest = rest.combine_chunks() if isinstance(rest, pa.ChunkedArray) else rest
        chunks, codes = rest.dictionary.to_pylist(), rest.indices.to_numpy()
        begins = [t.split(" ", 1)[0] for t in texts]
        # a space before white space or the end isn't a boundary; texts that have one are split as a whole
        use = np.ones(len(begin), bool)
        if inner := [i for i, c in enumerate(chunks) if not c or c[0].isspace()]:
            of = np.repeat(np.arange(len(texts)), np.diff(at))[~begin]
            whole = np.unique(of[np.isin(codes, inner)])
            for i in whole.tolist():
                begins[i] = texts[i]
                use[at[i] + 1 : at[i + 1]] = False
            kept = np.bincount(codes[use[~begin]], minlength=len(chunks)) > 0
            chunks = [c if k else "" for c, k in zip(chunks, kept.tolist(), strict=True)]
        after_space = self._chunks(chunks, " ")
        leads = {b: len(chunks) + i for i, b in enumerate(dict.fromkeys(begins))}
        leading = self._chunks(list(leads), "")
        code = np.empty(len(begin), np.int64)
        code[~begin] = codes
        code[begin] = [leads[b] for b in begins]
        code = code[use]
        ends = np.concatenate(([0], np.cumsum(use)))[at]  # where each text's chunks are, of those in use
        known = after_space + leading
        data = np.frombuffer(b"".join(known), "<u4")
        sizes = np.array(list(map(len, known)), np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[code]
        to = np.concatenate(([0], np.cumsum(n)))
        got = data[np.repeat((starts[code] - to[:-1]).astype(np.int32), n) + np.arange(to[-1], dtype=np.int32)]
        edges = to[ends].tolist()
        return [got[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]


_local = threading.local()


def codec(key: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    """This process's codec for a vocabulary, made at its first use."""
    own = _local.__dict__.setdefault("codecs", {})
    if key not in own:
        own[key] = Codec(ranks, pattern)
    return own[key]


RESULT = T.StructType([T.StructField(c, T.BinaryType() if c in ("ids", "decoded") else T.LongType() if c == "n_tokens" else T.StringType()) for c in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")])
BYTES_AT_ONCE = 2 << 20


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", digests_only: bool = False) -> DataFrame:
    """``df`` with each whole text's ids and their decoding: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and
    unless ``digests_only`` ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` (bytes)."""
    ship(df.sparkSession)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast((key, ranks, pattern))  # a vocabulary: of fixed size
    names = RESULT.fieldNames()[: 3 if digests_only else 5]

    @F.pandas_udf(T.StructType([f for f in RESULT.fields if f.name in names]))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(*shared.value)
        try:
            for texts in batches:
                given, rows = [t if isinstance(t, str) else "" for t in texts], []
                start = size = 0
                for end, t in enumerate(given, 1):
                    size += len(t)
                    if size >= BYTES_AT_ONCE or end == len(given):
                        for ids, decoded in c.encode_texts(given[start:end]):
                            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids, decoded)[: len(names)])
                        start, size = end, 0
                        pa.default_memory_pool().release_unused()
                yield pd.DataFrame(rows, columns=names)
        finally:
            c.rest()

    got = df.withColumn("_bpe", of(F.col(text)))
    return got.withColumns({n: F.col(f"_bpe.{n}") for n in names}).drop("_bpe")


def op6_byte_bpe(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, digests_only=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
