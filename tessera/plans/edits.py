"""Queries that edit texts: lines of documents are what is cited and replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import edits as E

from .query import Tables, query


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, total, i, n, start): the lines of texts from 1, their lengths, and where they begin."""
    sizes = F.transform(F.split("text", "\n"), lambda s: F.char_length(s).cast("long"))
    rows = docs.select("doc_id", F.char_length("text").cast("long").alias("total"), F.posexplode(sizes).alias("i", "n"))
    before = F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("doc_id", "total", (F.col("i") + 1).alias("i"), "n", F.coalesce(before, F.lit(0)).cast("long").alias("start"))


_LINES = "l AS (SELECT doc_id, line, i, length(line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


@query(
    "cited_texts",
    rf"""
WITH {_LINES},
own AS (SELECT doc_id, coalesce(list_max(list_transform(flatten(list_transform(regexp_extract_all(text, '\[(\d+(?:\s*[,;]\s*\d+)*)\]', 1), lambda m: regexp_extract_all(m, '\d+'))), lambda x: try_cast(x AS INTEGER))), 0) AS m FROM documents),
s AS (SELECT doc_id, i, unnest([n % 7, 10 + n // 7 % 5]) AS source FROM l WHERE n > 0),
f AS (SELECT doc_id, source, min(i) AS p FROM s GROUP BY ALL),
k AS (SELECT doc_id, source, m + row_number() OVER (PARTITION BY doc_id ORDER BY p, source) AS number FROM f JOIN own USING (doc_id)),
a AS (SELECT doc_id, i, string_agg(number::VARCHAR, ', ' ORDER BY number) AS marker FROM (SELECT DISTINCT doc_id, i, number FROM s JOIN k USING (doc_id, source)) GROUP BY ALL),
b AS (SELECT doc_id, string_agg(line || coalesce(' [' || marker || ']', ''), chr(10) ORDER BY i) AS body FROM l LEFT JOIN a USING (doc_id, i) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_sources, string_agg(chr(10) || '[' || number || '] S' || source, '' ORDER BY number) AS tail FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_sources, 0) AS n_sources, length(body || coalesce(chr(10) || 'References' || tail, ''))::BIGINT AS n_chars, md5(body || coalesce(chr(10) || 'References' || tail, '')) AS digest
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN t USING (doc_id)
""",
)
def cited_texts(t: Tables) -> DataFrame:
    """Texts with markers at the ends of their lines, numbered on from their own, and the list of the sources."""
    docs = t.documents.select("doc_id", "text")
    lines = _lines(docs).where("n > 0")
    source = F.explode(F.array(F.col("n") % 7, F.lit(10) + F.floor(F.col("n") / 7) % 5)).alias("source")
    selected = lines.select("doc_id", (F.col("start") + F.col("n")).alias("place"), source).withColumn("title", F.concat(F.lit("S"), F.col("source").cast("string")))
    new = E.applied(docs, E.settled(E.citations(docs, selected, "References")))
    counts = selected.groupBy("doc_id").agg(F.count_distinct("source").alias("n_sources"))
    return new.join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "edited_texts",
    f"""
WITH RECURSIVE {_LINES},
o AS (SELECT doc_id, i, n, (coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM l),
e AS (SELECT doc_id, i, start, least(start + 25 + n % 37, length(text))::BIGINT AS "end" FROM o JOIN documents USING (doc_id)),
g AS (SELECT e.*, greatest("end", start + 1) AS after FROM e),
x AS (SELECT g.doc_id, g.i, g.start, g."end", h.i AS next FROM g ASOF LEFT JOIN (SELECT doc_id, i, start AS begins FROM e) h ON g.doc_id = h.doc_id AND g.after <= h.begins),
w AS (SELECT doc_id, i, start, "end", 0::BIGINT AS before, next FROM x WHERE i = 1
UNION ALL SELECT x.doc_id, x.i, x.start, x."end", w."end", x.next FROM w JOIN x ON x.doc_id = w.doc_id AND x.i = w.next),
p AS (SELECT doc_id, count(*) AS n_edits, max("end") AS last, string_agg(substr(text, before + 1, start - before) || '<' || i || '>', '' ORDER BY start) AS head FROM w JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(n_edits, 0) AS n_edits, md5(coalesce(head || substr(text, last + 1), text)) AS digest, md5(text) AS restored FROM documents LEFT JOIN p USING (doc_id)
""",
)
def edited_texts(t: Tables) -> DataFrame:
    """Texts with spans replaced from the beginnings of their lines, of those that overlap the first one, and the old texts again."""
    docs = t.documents.select("doc_id", "text")
    end = F.least(F.col("start") + 25 + F.col("n") % 37, F.col("total"))
    standing = E.settled(_lines(docs).select("doc_id", F.col("i").alias("id"), "start", end.alias("end"), F.concat(F.lit("<"), F.col("i").cast("string"), F.lit(">")).alias("new")))
    new = E.applied(docs, standing)
    old = E.applied(new, E.settled(E.inverse(docs, standing))).select("doc_id", F.md5("text").alias("restored"))
    counts = standing.groupBy("doc_id").agg(F.count("*").alias("n_edits"))
    return new.join(old, "doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_edits", F.lit(0)).alias("n_edits"), F.md5("text").alias("digest"), "restored")
