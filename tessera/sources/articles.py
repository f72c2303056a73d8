"""Article corpora: delimited exports with side files, catalogues in JSON, staff lists in HTML, the search index."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrow as A
from tessera.operators.documents import sentence_chunks
from tessera.ship import ship


def read_articles(spark: SparkSession, path: str, side_files: DataFrame | None = None) -> DataFrame:
    """Rows of a ``;``-separated export with an id and a title, with their side file's text where there is one.

    ``side_files``: (article_id, html), as ``side_files_of`` gives them.
    """
    rows = spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)
    # a byte-order mark sticks to the first column's name
    rows = rows.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff").strip()) for c in rows.columns])
    rows = rows.where((F.trim(F.coalesce("article_id", F.lit(""))) != "") & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    if side_files is None:
        return rows
    return rows.join(side_files, "article_id", "left")


def side_files_of(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """(article_id, path, html): files named ``<id> - <anything>``; of several for one id the first path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1))
    keyed = files.select(F.regexp_extract(name, r"^(.+?) - ", 1).alias("article_id"), "path", "content").where("article_id <> ''")
    first = keyed.groupBy("article_id").agg(F.min("path").alias("path"))
    return keyed.join(first, ["article_id", "path"]).select("article_id", "path", F.decode("content", "UTF-8").alias("html"))


def card_fields(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with the abstracts and the keywords of an article's card, tags stripped and references decoded."""
    ship(df.sparkSession)
    strip = lambda c: F.trim(F.regexp_replace(A.unescape(F.regexp_replace(c, "(?s)<[^>]*>", " ")), r"(?U)\s+", " "))
    block = lambda i: F.regexp_extract(html, rf"""(?isu)<div[^>]+id=["']{i}["'][^>]*>(.*?)</div>""", 1)
    raw = df.withColumns({"_a": block("abstract1"), "_e": block("eabstract1"), "_k": F.regexp_extract(html, r"(?isu)(?:Ключевые\s+слова|Keywords)\s*:?\s*(.*?)(?:</p>|</div>)", 1)})
    return raw.withColumns({"abstract": strip(F.col("_a")), "abstract_en": strip(F.col("_e")), "keywords": strip(F.col("_k"))}).drop("_a", "_e", "_k")


def split_keywords(s: Column) -> Column:
    """Keywords between commas and semicolons, each once whatever its case, in order."""
    parts = F.filter(F.transform(F.split(s, "[,;]"), lambda k: F.trim(k)), lambda k: k != "")
    lower = F.transform(parts, F.lower)
    return F.filter(parts, lambda k, i: F.array_position(lower, F.lower(k)) == i + 1)


def newest_copies(files: DataFrame, path: str = "path") -> DataFrame:
    """Of each plan's files in a folder, the newest copy by the date that its name begins with; undated ones only where no
    copy has a date; of equal ones the last path."""
    name = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    stamp = F.regexp_extract(name, r"^\s*(\d{2}\.\d{2}\.\d{4})", 1)
    plan = F.lower(F.trim(F.regexp_replace(name, r"^\s*\d{2}\.\d{2}\.\d{4}[\s_.-]*", "")))
    keyed = files.withColumns({"folder": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "plan": plan, "dated": F.try_to_date(stamp, "dd.MM.yyyy")})
    best = keyed.groupBy("folder", "plan").agg(F.max(F.struct(F.coalesce("dated", F.lit("0001-01-01").cast("date")), F.col(path).alias("p"))).alias("b"))
    return keyed.join(best.select("folder", "plan", F.col("b.p").alias(path)), ["folder", "plan", path])


def read_export(spark: SparkSession, path: str, columns: list[str], text_column: str, flag: str = "INSPECTOR_FLG", year: str = "YEAR", years: list[int] | None = None, most: int = 700) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a ``;``-separated export whose text column may hold raw separators.

    Extra fields belong to the text column: they are put together again, the rest stays in place.  Rows that are
    short, or whose year is no number, are errors; records are those flagged ``A`` of the given years.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", ";").alias("f"))
    at, n = columns.index(text_column), len(columns)
    extra = F.size("f") - n
    fixed = F.when(extra <= 0, F.col("f")).otherwise(
        F.concat(F.slice("f", 1, at), F.array(F.array_join(F.slice("f", at + 1, extra + 1), ";")), F.slice("f", F.lit(at + 2) + extra, n - at - 1))
    )
    rows = lines.select(fixed.alias("f")).where(F.element_at("f", 1) != columns[0])
    out = rows.select(F.size("f").alias("_n"), *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    bad = (F.col("_n") < n) | F.col(year).try_cast("int").isNull()
    records = out.where(~bad & (F.col(flag) == "A")).drop("_n").withColumn(text_column, F.substring(text_column, 1, most)).withColumn(year, F.col(year).cast("int"))
    if years:
        records = records.where(F.col(year).isin(years))
    return records, out.where(bad)


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """(title, titles, issns, level) of a JSON catalogue: one row for each first title, the least level, all titles and numbers."""
    raw = spark.read.schema("titles array<string>, issns array<string>, level int").option("multiLine", True).json(path)
    by = raw.withColumn("title", F.try_element_at("titles", F.lit(1))).where("title is not null").groupBy("title")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return by.agg(union("titles"), union("issns"), F.min("level").alias("level"))


# Words that begin a unit's name.
UNIT_WORDS = ("Department", "Faculty", "Institute", "Centre", "Кафедра", "Факультет", "Институт", "Центр", "Отдел")


def staff_entries(pages: DataFrame, html: str = "html") -> DataFrame:
    """(external_id, name, position, unit) of a directory's links ``Name / Position, Unit``.

    A position may hold commas: the unit begins at the first comma before a unit's word, else at the last comma.
    """
    link = r"""(?is)<a[^>]+passBack\('([^']*)'[^>]*>(.*?)</a>"""
    found = pages.select(F.explode(F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("id"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("label"))).alias("x"))
    label = F.trim(F.regexp_replace("x.label", r"(?U)\s+", " "))
    name, rest = F.trim(F.substring_index(label, "/", 1)), F.trim(F.regexp_extract(label, r"^[^/]*/(.*)$", 1))
    words = "|".join(UNIT_WORDS)
    at_word = F.regexp_extract(rest, rf"(?iu)^(.*?),\s*((?:{words}).*)$", 0) != ""
    position = F.when(at_word, F.regexp_extract(rest, rf"(?iu)^(.*?),\s*((?:{words}).*)$", 1)).otherwise(F.regexp_replace(rest, r",[^,]*$", ""))
    unit = F.when(at_word, F.regexp_extract(rest, rf"(?iu)^(.*?),\s*((?:{words}).*)$", 2)).otherwise(F.trim(F.regexp_extract(rest, r",([^,]*)$", 1)))
    return found.select(F.col("x.id").alias("external_id"), name.alias("name"), F.trim(position).alias("position"), unit.alias("unit"))


def write_index(articles: DataFrame, path: str, text: str = "text", key: str = "doc_id", version: int = 2, backend: str = "hashed") -> None:
    """Articles, their chunks and one row of facts about the index, as Parquet; each build is a folder of its own, and
    ``meta`` is written last, so a reader that goes by it never sees a half-written build."""
    build = f"{path}/build-{version}-{uuid.uuid4().hex}"
    articles.write.parquet(f"{build}/articles")
    sentence_chunks(articles, key, text).write.parquet(f"{build}/chunks")
    spark = articles.sparkSession
    counts = [spark.read.parquet(f"{build}/{t}").count() for t in ("articles", "chunks")]
    row = (version, build, backend, datetime.now(UTC), *counts)
    spark.createDataFrame([row], "schema_version int, build string, backend string, built timestamp, articles long, chunks long").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, chunks) of the last complete build."""
    build = spark.read.parquet(f"{path}/meta").first()["build"]  # one row
    return spark.read.parquet(f"{build}/articles"), spark.read.parquet(f"{build}/chunks")
