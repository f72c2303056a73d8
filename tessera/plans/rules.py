"""Rule queries: parts and their brands are documents and templates, pages files, line items runs of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import rules as R

from .query import Tables, query

# Aliases of roles.
_ALIASES = "('large', 'size'), ('large brushed', 'finish'), ('small', 'size'), ('standard', 'line'), ('promo', 'line'), ('promo burnished', 'finish'), ('economy anodized steel', 'material'), ('medium', 'size')"


@query(
    "alias_roles",
    rf"""
WITH a(alias, role) AS (VALUES {_ALIASES}), p AS (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^0-9\p{{L}}]+', ' ', 'g')) AS label FROM part),
f AS (SELECT p_partkey, arg_max(role, length(alias)) AS role, arg_max(alias, length(alias)) AS alias FROM p JOIN a ON label = alias OR starts_with(label, alias || ' ') GROUP BY p_partkey)
SELECT p_partkey, role, alias FROM part LEFT JOIN f USING (p_partkey)
""",
)
def alias_roles(t: Tables) -> DataFrame:
    """Labels to roles by their longest alias."""
    aliases = t.spark.sql(f"SELECT * FROM VALUES {_ALIASES} AS a(alias, role)")
    return R.alias_roles(t.part, aliases, "p_partkey", "p_type")


@query(
    "modal_metrics",
    """
WITH c AS (SELECT l_orderkey, 'f' AS c, l_returnflag AS v, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, 's', l_linestatus, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, 'd', round(l_discount * 100)::INTEGER::VARCHAR, l_linenumber FROM lineitem),
n AS (SELECT l_orderkey, c, v, count(*) AS n, min(l_linenumber) AS first FROM c GROUP BY ALL),
b AS (SELECT l_orderkey, c, v FROM n QUALIFY row_number() OVER (PARTITION BY l_orderkey, c ORDER BY n DESC, first, v) = 1)
SELECT l_orderkey, max(v) FILTER (c = 'f') AS flag, max(v) FILTER (c = 's') AS status, max(v) FILTER (c = 'd') AS percent FROM b GROUP BY l_orderkey
""",
)
def modal_metrics(t: Tables) -> DataFrame:
    """An order's commonest flag, status and discount, the first seen of equal ones."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.round(F.col("l_discount") * 100).cast("int").alias("percent"))
    return R.modal(rows, ["l_orderkey"], "l_linenumber", ["flag", "status", "percent"])


@query(
    "template_issues",
    """
WITH r AS (SELECT p_brand, median(p_size) AS size, CASE WHEN p_brand LIKE '%3' THEN NULL ELSE median(p_retailprice) END AS price FROM part GROUP BY p_brand),
b AS (SELECT p_partkey, p_size::DOUBLE AS p_size, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice, size, price FROM part JOIN r USING (p_brand))
SELECT p_partkey, 'p_size' AS metric, size::DOUBLE AS expected, p_size AS actual FROM b WHERE size IS NOT NULL AND abs(p_size - size) > 12
UNION ALL SELECT p_partkey, 'p_retailprice', price, p_retailprice FROM b WHERE price IS NOT NULL AND (p_retailprice IS NULL OR abs(p_retailprice - price) > 250)
""",
)
def template_issues(t: Tables) -> DataFrame:
    """Parts whose size or price is off their brand's by more than the tolerance."""
    rules = t.part.groupBy("p_brand").agg(F.median("p_size").alias("p_size"), F.when(F.col("p_brand").endswith("3"), None).otherwise(F.median("p_retailprice")).alias("p_retailprice"))
    metrics = t.part.withColumn("p_retailprice", F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")))
    return R.rule_issues(metrics, rules, "p_partkey", "p_brand", {"p_size": 12, "p_retailprice": 250})


_CATALOGUE = "('signup', true), ('purchase', true), ('error', false), ('refund', true)"


@query(
    "required_parts",
    f"WITH c(role, required) AS (VALUES {_CATALOGUE}), u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT DISTINCT user_id, event_type AS role FROM events) SELECT u.user_id, c.role, required, h.role IS NOT NULL AS present FROM u CROSS JOIN c LEFT JOIN h ON h.user_id = u.user_id AND h.role = c.role",
)
def required_parts(t: Tables) -> DataFrame:
    """A table of presence: every subject against the catalogue."""
    return R.required_parts(t.events.select("user_id", F.col("event_type").alias("role")), t.spark.sql(f"SELECT * FROM VALUES {_CATALOGUE} AS c(role, required)"), "user_id")


@query(
    "file_issues",
    """
SELECT page_id, 'type' AS code, 0 AS place FROM pages WHERE NOT regexp_matches(url, '\\.html?$|/$|/[^./]*$')
UNION ALL SELECT page_id, 'size', 1 FROM pages WHERE length(html) > 3000
UNION ALL SELECT page_id, 'signature', 2 FROM pages WHERE NOT starts_with(lower(ltrim(html)), '<!doctype')
UNION ALL SELECT page_id, 'unclosed', 3 FROM pages WHERE NOT contains(lower(html), '</html>')
""",
)
def file_issues(t: Tables) -> DataFrame:
    """Type, size, signature and completeness of files."""
    html = F.lower("html")
    return R.file_issues(t.pages, [("type", ~F.col("url").rlike(r"\.html?$|/$|/[^./]*$")), ("size", F.length("html") > 3000), ("signature", ~F.ltrim(html).startswith("<!doctype")), ("unclosed", ~F.contains(html, F.lit("</html>")))], "page_id")


@query(
    "count_disagreement",
    "WITH c AS (SELECT page_id, len(regexp_extract_all(html, '<p[ >]'))::INTEGER AS opened, len(regexp_extract_all(html, '</p>'))::INTEGER AS closed FROM pages) SELECT page_id, opened, closed FROM c WHERE abs(opened - closed) > greatest(1.0, 0.1 * opened)",
)
def count_disagreement(t: Tables) -> DataFrame:
    """Pages whose counts of begun and ended paragraphs disagree."""
    c = t.pages.select("page_id", F.regexp_count("html", F.lit("<p[ >]")).alias("opened"), F.regexp_count("html", F.lit("</p>")).alias("closed"))
    return c.where(R.disagreement(F.col("opened"), F.col("closed")))


@query(
    "log_facts",
    r"""
SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '([0-9]{1,9})', 1), lambda v: v::DOUBLE)), 0.0) AS worst, len(regexp_extract_all(text, '(?i)idiot|loser'))::INTEGER AS rude, len(regexp_extract_all(text, '%'))::INTEGER AS percent FROM documents
""",
)
def log_facts(t: Tables) -> DataFrame:
    """The greatest number in a text, and counts of patterns."""
    return t.documents.select("doc_id", *R.log_facts(F.col("text"), "([0-9]{1,9})", {"rude": "(?i)idiot|loser", "percent": "%"}))


@query(
    "benchmark_summary",
    "SELECT o_orderpriority AS suite, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus <> 'O') AS compiled, round(sum(o_totalprice), 2) AS cost, bool_and(o_totalprice > 0) AS sane FROM orders GROUP BY 1",
)
def benchmark_summary(t: Tables) -> DataFrame:
    """Totals of a suite of cases."""
    s = F.col("o_orderstatus")
    return t.orders.groupBy(F.col("o_orderpriority").alias("suite")).agg(F.count("*").alias("total"), F.count_if(s == "F").alias("passed"), F.count_if(s != "O").alias("compiled"), F.round(F.sum("o_totalprice"), 2).alias("cost"), F.bool_and(F.col("o_totalprice") > 0).alias("sane"))


@query(
    "validation_report",
    """
WITH c AS (SELECT o_orderkey, count(l_linenumber) AS parts, count(*) FILTER (l_linestatus = 'F') AS done, count(*) FILTER (l_returnflag = 'R') AS errors FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, parts, done, errors, round(done / parts, 4) AS coverage, greatest(0, 100 - 25 * errors - CASE WHEN done / parts < 0.88 THEN 10 ELSE 0 END)::BIGINT AS score, errors > 0 OR done / parts < 0.88 AS manual FROM c
""",
)
def validation_report(t: Tables) -> DataFrame:
    """Coverage, a score with deductions, and whether a person must look."""
    c = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("parts"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count_if(F.col("l_returnflag") == "R").alias("errors"))
    share = F.col("done") / F.col("parts")
    score = F.greatest(F.lit(0), 100 - 25 * F.col("errors") - F.when(share < 0.88, 10).otherwise(0)).cast("long")
    return c.select("o_orderkey", "parts", "done", "errors", F.round(share, 4).alias("coverage"), score.alias("score"), ((F.col("errors") > 0) | (share < 0.88)).alias("manual"))


@query(
    "package_digests",
    """
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS part, md5(l_partkey::VARCHAR) AS d, o_orderstatus <> 'O' AS closed FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT l_orderkey AS k, l_linenumber AS part, md5((l_partkey + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS d FROM lineitem WHERE l_suppkey % 17 <> 0)
SELECT s.k, count(*) AS n, count(*) FILTER (a.d IS NOT NULL AND a.d <> s.d) AS wrong, count(*) FILTER (a.d IS NULL) AS missing, bool_and(a.d IS NOT DISTINCT FROM s.d AND closed) AS valid FROM s LEFT JOIN a ON a.k = s.k AND a.part = s.part GROUP BY s.k
""",
)
def package_digests(t: Tables) -> DataFrame:
    """Packages whose parts still have their stored digests."""
    key = [F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("part")]
    stored = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(*key, F.md5(F.col("l_partkey").cast("string")).alias("d"), (F.col("o_orderstatus") != "O").alias("closed"))
    actual = t.lineitem.where("l_suppkey % 17 <> 0").select(*key, F.md5((F.col("l_partkey") + F.when(F.col("l_partkey") % 13 == 0, 1).otherwise(0)).cast("string")).alias("d"))
    return R.digests_hold(stored, actual, "k", "part", "d", "closed")


@query(
    "histogram_peaks",
    """
WITH c AS (SELECT event_type, floor(value / 5)::BIGINT AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
b AS (SELECT *, CASE WHEN lag(bucket) OVER w = bucket - 1 THEN lag(n) OVER w ELSE 0 END AS a, CASE WHEN lead(bucket) OVER w = bucket + 1 THEN lead(n) OVER w ELSE 0 END AS z FROM c WINDOW w AS (PARTITION BY event_type ORDER BY bucket))
SELECT event_type, bucket, n FROM b WHERE n > coalesce(a, 0) AND n >= coalesce(z, 0)
""",
)
def histogram_peaks(t: Tables) -> DataFrame:
    """Peaks of each kind's values."""
    return R.histogram_peaks(t.events.where("value is not null"), ["event_type"], "value", 5)


@query("clamped_median", "SELECT p_brand, round(greatest(20.0, least(26.0, median(p_size))), 2)::DOUBLE AS median FROM part GROUP BY p_brand")
def clamped_median(t: Tables) -> DataFrame:
    """A brand's median size between bounds."""
    return R.clamped_median(t.part, ["p_brand"], "p_size", 20, 26)
