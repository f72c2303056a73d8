"""Container formats by standard-library parsers: spreadsheets, word documents, archives, bibliographies, LaTeX.

Each reader takes (path, content) rows, as the binaryFile source gives them, and emits typed rows; everything
after that is relational.  A file that can't be read gives one row with its error.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.ship import ship

MAX_ENTRIES, MAX_MEMBER, MAX_TOTAL, MAX_RATIO = 10_000, 200 << 20, 1 << 30, 200


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def _rows(df: DataFrame, parse, schema: str) -> DataFrame:
    """``parse(path, bytes)`` yields tuples of ``schema`` less its error column, the last."""
    ship(df.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(path, *r, None) for r in parse(bytes(content or b""))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, UnicodeError) as e:
                    rows = [(path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return df.select("path", "content").mapInPandas(run, schema)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def place(reference: str) -> tuple[int, int]:
    """Row and column, from 1, of a cell's name like ``AB12``."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", reference)
    column = 0
    for c in m[1]:
        column = 26 * column + ord(c) - 64
    return int(m[2]), column


def _cells(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for number, sheet in enumerate((s for s in book.iter() if _local(s.tag) == "sheet"), 1):
            target = next(targets[v] for k, v in sheet.attrib.items() if _local(k) == "id").lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for c in (c for c in tree.iter() if _local(c.tag) == "c"):
                text = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                if text:
                    yield (number, sheet.get("name"), *place(c.get("r")), text)


def cells(df: DataFrame) -> DataFrame:
    """(path, sheet, name, row, col, text, error) of spreadsheets."""
    return _rows(df, _cells, "path string, sheet int, name string, row int, col int, text string, error string")


def below_headers(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells under a header cell of a known text: (path, sheet, row, code, text); ``headers`` (header, code) is small."""
    heads = grid.join(F.broadcast(headers), F.lower(F.trim("text")) == F.lower("header")).select("path", "sheet", "col", F.col("row").alias("head"), "code")
    return grid.join(heads, ["path", "sheet", "col"]).where("row > head").select("path", "sheet", "row", "code", "text")


def right_of_label(grid: DataFrame, label: str) -> DataFrame:
    """(path, sheet, text): the nearest filled cell to the right of a label."""
    at = grid.where(F.lower(F.trim("text")) == label.lower()).select("path", "sheet", "row", F.col("col").alias("at"))
    near = grid.join(at, ["path", "sheet", "row"]).where("col > at").groupBy("path", "sheet")
    return near.agg(F.min_by("text", F.struct("row", "col")).alias("text"))


def _paragraphs(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    tables = 0
    for number, p in enumerate(e for e in body.iter() if _local(e.tag) in ("p", "tbl")):
        if _local(p.tag) == "tbl":
            tables += 1
            continue
        style = next((v for e in p.iter() if _local(e.tag) == "pStyle" for k, v in e.attrib.items() if _local(k) == "val"), None)
        runs = [e for e in p.iter() if _local(e.tag) == "r"]
        bold = sum(len("".join(t.text or "" for t in r.iter() if _local(t.tag) == "t")) for r in runs if any(_local(e.tag) == "b" for e in r.iter()))
        text = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t")
        yield number, style, text, bold / len(text) if text else 0.0, any(_local(e.tag) == "oMath" for e in p.iter()), any(_local(e.tag) == "drawing" for e in p.iter()), tables


def paragraphs(df: DataFrame) -> DataFrame:
    """(path, number, style, text, bold, formula, figure, tables_before, error) of word documents, in order."""
    return _rows(df, _paragraphs, "path string, number int, style string, text string, bold double, formula boolean, figure boolean, tables_before int, error string")


def _members(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for number, i in enumerate(z.infolist()):
            # what is over the limits is listed, not read
            digest = hashlib.sha256(z.read(i)).hexdigest() if not i.is_dir() and i.file_size <= MAX_MEMBER and i.file_size <= MAX_RATIO * max(1, i.compress_size) else None
            yield number, i.filename, i.file_size, i.compress_size, i.filename.rpartition(".")[2].lower() if "." in i.filename else "", digest, (i.external_attr >> 28) == 0xA


def members(df: DataFrame) -> DataFrame:
    """(path, number, name, size, packed, extension, sha256, link, error) of archives."""
    return _rows(df, _members, "path string, number int, name string, size long, packed long, extension string, sha256 string, link boolean, error string")


def unsafe(listing: DataFrame) -> DataFrame:
    """(path, name, reason) of members that an archive mustn't have."""
    upto = F.sum("size").over(Window.partitionBy("path").orderBy("number"))
    seen = listing.where("error is null").withColumn("upto", upto)
    reason = (
        F.when(F.col("number") >= MAX_ENTRIES, "entries")
        .when(F.col("name").rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:"), "traversal")
        .when(F.col("link"), "link")
        .when(F.col("size") > MAX_MEMBER, "size")
        .when(F.col("size") > MAX_RATIO * F.greatest(F.col("packed"), F.lit(1)), "ratio")
        .when(F.col("upto") > MAX_TOTAL, "total")
    )
    return seen.select("path", "name", reason.alias("reason")).where("reason is not null")


def balanced(text: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``; -1 where none does."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "\\":
            continue
        if text[i] in "{}" and (i == 0 or text[i - 1] != "\\"):
            depth += 1 if text[i] == "{" else -1
            if depth == 0:
                return i + 1
    return -1


def _entries(content: bytes):
    text = content.decode("utf-8-sig")
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s{}]+)\s*,", text):
        end = balanced(text, text.index("{", m.start()))
        body = text[m.end() : end - 1 if end > 0 else len(text)]
        fields, at = {}, 0
        while f := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(body, at):
            at = f.end()
            if at < len(body) and body[at] == "{":
                stop = balanced(body, at)
                stop = len(body) if stop < 0 else stop
                value, at = body[at + 1 : stop - 1], stop
            elif at < len(body) and body[at] == '"':
                stop = body.find('"', at + 1)
                stop = len(body) if stop < 0 else stop
                value, at = body[at + 1 : stop], stop + 1
            else:
                v = re.compile(r"[^,}\s]*").match(body, at)
                value, at = v[0], v.end()
            fields[f[1].lower()] = re.sub(r"\s+", " ", value.replace("{", "").replace("}", "")).strip()
        yield m[2], m[1].lower(), fields, fields.get("doi")


def bibliography(df: DataFrame) -> DataFrame:
    """(path, key, type, fields, doi, error) of BibTeX files."""
    return _rows(df, _entries, "path string, key string, type string, fields map<string,string>, doi string, error string")


def _commands(content: bytes):
    text = re.sub(r"(?<!\\)%.*", "", content.decode("utf-8", "replace"))
    for number, m in enumerate(re.finditer(r"\\([A-Za-z]+)\*?(?:\[[^\]]*\])?\{", text)):
        end = balanced(text, m.end() - 1)
        if end > 0:
            yield number, m[1], text[m.end() : end - 1].strip()


def latex_commands(df: DataFrame) -> DataFrame:
    """(path, number, command, value, error): each command with its first braced argument, braces balanced."""
    return _rows(df, _commands, "path string, number int, command string, value string, error string")


def latex_integrity(commands: DataFrame) -> DataFrame:
    """(path, problem, key): references without a label, citations without an entry, labels given twice."""
    keys = lambda names: commands.where(F.col("command").isin(*names)).select("path", F.explode(F.split("value", r"\s*,\s*")).alias("key"))
    labels, refs = keys(["label"]), keys(["ref", "eqref", "autoref"]).distinct()
    cites, items = keys(["cite", "citep", "citet"]).distinct(), keys(["bibitem"])
    missing = refs.join(labels, ["path", "key"], "left_anti").select("path", F.lit("reference").alias("problem"), "key")
    uncited = cites.join(items, ["path", "key"], "left_anti").select("path", F.lit("citation").alias("problem"), "key")
    twice = labels.groupBy("path", "key").count().where("count > 1").select("path", F.lit("label").alias("problem"), "key")
    return missing.unionByName(uncited).unionByName(twice)


def decoded(content: bytes) -> tuple[str, str]:
    """Text and encoding: the first of several that fits, the last with losses."""
    for name in ("utf-8-sig", "utf-8", "cp1251", "utf-16-le"):
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace"), "lossy"


def texts(df: DataFrame) -> DataFrame:
    """(path, text, encoding, error) of plain text files."""
    return _rows(df, lambda b: [decoded(b)], "path string, text string, encoding string, error string")
