"""Rule-based checks: limits, numbering, identifiers, scripts, severities, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

from .query import Tables, query

_WORDS = r"len(regexp_extract_all(text, '[0-9\p{L}]+'))"


@query(
    "word_limit_issues",
    f"""
WITH l(source, least, most) AS (VALUES ('src0', 100, NULL), ('src1', NULL, 300), ('src2', 200, 1000)),
d AS (SELECT doc_id, d.source, {_WORDS} AS n, coalesce(l.least, 50) AS least, coalesce(l.most, 2000) AS most FROM documents d LEFT JOIN l ON l.source = d.source)
SELECT doc_id, source, n::INTEGER AS n, CASE WHEN n < least THEN 'too_short' ELSE 'too_long' END AS code FROM d WHERE n < least OR n > most
""",
)
def word_limit_issues(t: Tables) -> DataFrame:
    """Word counts against a source's limits, else the defaults."""
    limits = F.broadcast(t.spark.sql("SELECT * FROM VALUES ('src0', 100, NULL), ('src1', NULL, 300), ('src2', 200, 1000) AS l(source, least, most)"))  # three rows
    d = t.documents.select("doc_id", "source", F.regexp_count("text", F.lit(r"[0-9\p{L}]+")).alias("n")).join(limits, "source", "left")
    least, most = F.coalesce("least", F.lit(50)), F.coalesce("most", F.lit(2000))
    return d.where((F.col("n") < least) | (F.col("n") > most)).select("doc_id", "source", "n", F.when(F.col("n") < least, "too_short").otherwise("too_long").alias("code"))


def issues(docs: DataFrame) -> DataFrame:
    """(doc_id, code, severity): one row for each rule that a document breaks, from one pass over the texts."""
    t = F.col("text")
    rules = [
        ("empty", "critical", F.length(F.trim(t)) == 0),
        ("short", "warning", F.length(t) < 200),
        ("email", "error", t.rlike(X.EMAIL)),
        ("shouting", "warning", X.upper_share(t) > 0.5),
        ("repeated_line", "info", F.size(F.split(t, "\n")) > F.size(F.array_distinct(F.split(t, "\n")))),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, rule in rules]))
    return docs.select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.*")


@query(
    "severity_summary",
    r"""
WITH i AS (
  SELECT 'critical' AS severity FROM documents WHERE length(trim(text)) = 0
  UNION ALL SELECT 'warning' FROM documents WHERE length(text) < 200
  UNION ALL SELECT 'error' FROM documents WHERE regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')
  UNION ALL SELECT 'warning' FROM documents WHERE len(regexp_extract_all(text, '\p{L}')) > 0 AND len(regexp_extract_all(text, '\p{Lu}')) / len(regexp_extract_all(text, '\p{L}')) > 0.5
  UNION ALL SELECT 'info' FROM documents WHERE len(string_split(text, chr(10))) > len(list_distinct(string_split(text, chr(10)))))
SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) AS total FROM i
""",
)
def severity_summary(t: Tables) -> DataFrame:
    """Issues by severity, with zeros."""
    return issues(t.documents).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "error", "warning", "info")], F.count("*").alias("total"))


@query(
    "identifier_issues",
    r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS value FROM documents)
SELECT doc_id, 'email' AS kind, value, regexp_matches(value, '@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]{2,}$') AS valid FROM m
""",
)
def identifier_issues(t: Tables) -> DataFrame:
    """Identifiers in texts, with their validity."""
    found = lambda kind, pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    both = F.concat(found("email", X.EMAIL.replace("(\\.", "(?:\\.")), found("doi", X.DOI), found("url", X.URL))
    rows = t.documents.select("doc_id", F.explode(both).alias("i")).select("doc_id", "i.*")
    valid = F.when(F.col("kind") == "email", F.col("value").rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]{2,}$")).when(F.col("kind") == "doi", F.col("value").rlike(r"^10\.\d{4,9}/\S+$")).otherwise(F.lit(True))
    return rows.withColumn("valid", valid)


#: Every fifth text has its Latin o and c exchanged for the Cyrillic letters of the same look.
_TWINS = ("oc", "ос")


@query(
    "mixed_script_tokens",
    rf"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN translate(text, '{_TWINS[0]}', '{_TWINS[1]}') ELSE text END AS text FROM documents)
SELECT doc_id, t AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё]{{2,}}')) AS t FROM d) WHERE regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[А-Яа-яЁё]')
""",
)
def mixed_script_tokens(t: Tables) -> DataFrame:
    """Tokens that mix alphabets."""
    text = F.when(F.col("doc_id") % 5 == 0, F.translate("text", *_TWINS)).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.explode(X.mixed_script_tokens(text, None)).alias("token"))


@query(
    "script_share_lang",
    r"""
WITH s AS (SELECT doc_id, lang, len(regexp_extract_all(text, '\p{Cyrillic}')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)
SELECT lang, CASE WHEN c >= 12 AND c > l * 1.2 THEN 'ru' WHEN l >= 12 AND l > c * 1.2 THEN 'en' WHEN c + l = 0 THEN 'unknown' ELSE 'mixed' END AS script, count(*) AS n FROM s GROUP BY ALL
""",
)
def script_share_lang(t: Tables) -> DataFrame:
    """The script's language against the table's."""
    return t.documents.groupBy("lang", X.script_language(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


@query(
    "numbering_gaps",
    """
WITH c AS (SELECT 'turn' AS what, conv_id AS id, min(turn) AS least, max(turn) AS most, count(DISTINCT turn) AS n FROM conversations GROUP BY conv_id
  UNION ALL SELECT 'line', l_orderkey, min(l_linenumber), max(l_linenumber), count(DISTINCT l_linenumber) FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)
SELECT what, id, least::BIGINT AS least, most::BIGINT AS most, n FROM c WHERE most - least + 1 <> n OR (what = 'line' AND least <> 1)
""",
)
def numbering_gaps(t: Tables) -> DataFrame:
    """Sequences that don't run from their start to their end."""
    span = lambda df, what, key, number: df.groupBy(F.col(key).alias("id")).agg(F.min(number).cast("long").alias("least"), F.max(number).cast("long").alias("most"), F.count_distinct(number).alias("n")).select(F.lit(what).alias("what"), "*")
    both = span(t.conversations, "turn", "conv_id", "turn").unionByName(span(t.lineitem.where("l_returnflag <> 'R'"), "line", "l_orderkey", "l_linenumber"))
    return both.where("most - least + 1 <> n or (what = 'line' and least <> 1)")


@query(
    "heading_level_jump",
    """
WITH h AS (SELECT conv_id, turn, length(text) % 4 AS level FROM conversations),
j AS (SELECT *, lag(level) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM h)
SELECT conv_id, turn, before::INTEGER AS before, level::INTEGER AS level FROM j WHERE level - before > 1
""",
)
def heading_level_jump(t: Tables) -> DataFrame:
    """A level that comes two or more below the one before."""
    level = F.length("text") % 4
    before = F.lag("level").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", level.alias("level")).withColumn("before", before).where("level - before > 1").select("conv_id", "turn", "before", "level")


@query(
    "section_carry_forward",
    """
SELECT conv_id, turn, role, last_value(CASE WHEN role <> 'assistant' THEN left(text, 40) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS section_no FROM conversations
""",
)
def section_carry_forward(t: Tables) -> DataFrame:
    """The last heading before each block, and its section's number."""
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("role") != "assistant", F.substring("text", 1, 40)), ignorenulls=True).over(upto)
    return t.conversations.select("conv_id", "turn", "role", section.alias("section"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(upto).alias("section_no"))


@query(
    "corpus_audit",
    """
SELECT CASE WHEN d.text IS NULL OR length(d.text) = 0 THEN 'empty' WHEN length(d.text) > 20000 THEN 'oversized' WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'unsafe' WHEN l.quality = 0 THEN 'poor' ELSE 'ok' END AS status,
  count(*) AS n, sum(length(d.text))::BIGINT AS chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1
""",
)
def corpus_audit(t: Tables) -> DataFrame:
    """Documents by status."""
    d = t.documents.select("doc_id", F.length("text").alias("chars")).join(t.labels.withColumn("known", F.lit(True)), "doc_id", "left")
    status = F.when(F.coalesce("chars", F.lit(0)) == 0, "empty").when(F.col("chars") > 20000, "oversized").when(F.col("known").isNull(), "unlabelled").when(F.col("toxic") == 1, "unsafe").when(F.col("quality") == 0, "poor").otherwise("ok")
    return d.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("ratio_score", "SELECT source, round(avg((least(1.0, n_chars / 2000.0) + least(1.0, len(string_split(text, chr(10))) / 5.0)) / 2), 6) AS score, count(*) AS n FROM documents GROUP BY source")
def ratio_score(t: Tables) -> DataFrame:
    """Mean of ratios, each capped at one."""
    one = F.least(F.lit(1.0), F.col("n_chars") / 2000.0)
    two = F.least(F.lit(1.0), F.size(F.split("text", "\n")) / 5.0)
    return t.documents.groupBy("source").agg(F.round(F.avg((one + two) / 2), 6).alias("score"), F.count("*").alias("n"))
