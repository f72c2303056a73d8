"""Planning queries: part types and names as planned items, customers and suppliers as people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import planning as P

from .query import Tables, query

# Kinds and their patterns, in order.
_KINDS = {"coated": "PLATED|BURNISHED", "plated": "PLATED", "steel": "STEEL", "promo": "PROMO", "anodized": "ANODIZED"}
_HITS = ", ".join(f"CASE WHEN regexp_matches(p_type, '{p}') THEN '{k}' END" for k, p in _KINDS.items())


@query(
    "item_kinds",
    f"""
WITH f AS (SELECT p_partkey, p_type, p_size, list_filter([{_HITS}], lambda k: k IS NOT NULL) AS a FROM part),
b AS (SELECT *, CASE WHEN list_contains(a, 'plated') AND list_contains(a, 'coated') THEN list_filter(a, lambda k: k <> 'coated') ELSE a END AS a1 FROM f),
c AS (SELECT *, CASE WHEN list_contains(a1, 'promo') AND list_contains(a1, 'steel') AND NOT p_size > 20 THEN list_filter(a1, lambda k: k <> 'steel') ELSE a1 END AS a2 FROM b)
SELECT p_partkey, array_to_string(CASE WHEN len(a2) > 0 THEN a2 WHEN contains(p_type, 'BRASS') THEN ['brass'] WHEN contains(p_type, 'TIN') THEN ['tin'] ELSE ['other'] END, ',') AS kinds FROM c
""",
)
def item_kinds(t: Tables) -> DataFrame:
    """Several kinds an item, with kinds that give way to others, and fallbacks."""
    conflicts = [("plated", "coated", None), ("promo", "steel", F.col("p_size") > 20)]
    return t.part.select("p_partkey", F.array_join(P.kinds(F.col("p_type"), _KINDS, conflicts, {"brass": "BRASS", "tin": "TIN"}), ",").alias("kinds"))


@query(
    "item_quantities",
    r"""
WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR || ' articles and two articles' WHEN 1 THEN 'three articles' WHEN 2 THEN 'Articles: ' || replace(p_name, ' ', '; ') ELSE p_name END AS s FROM part),
n AS (SELECT p_partkey, s, list_transform(regexp_extract_all(lower(s), '\b(\d{1,6}|two|three)\s+(?:articles)', 1), lambda v: CASE v WHEN 'two' THEN 2 WHEN 'three' THEN 3 ELSE v::INTEGER END) AS q FROM s),
l AS (SELECT p_partkey, CASE WHEN len(q) > 0 THEN CASE WHEN list_sum(q) BETWEEN 1 AND 50 THEN list_sum(q) ELSE 1 END WHEN starts_with(lower(s), 'articles:') AND contains(s, ';') THEN len(string_split(s, ';')) ELSE 1 END AS quantity FROM n)
SELECT p_partkey, quantity::INTEGER AS quantity FROM l
""",
)
def item_quantities(t: Tables) -> DataFrame:
    """How many are planned: numbers in digits and words, or a list's entries."""
    turn = F.col("p_partkey") % 4
    s = (
        F.when(turn == 0, F.concat(F.col("p_size").cast("string"), F.lit(" articles and two articles")))
        .when(turn == 1, "three articles")
        .when(turn == 2, F.concat(F.lit("Articles: "), F.replace("p_name", F.lit(" "), F.lit("; "))))
        .otherwise(F.col("p_name"))
    )
    return t.part.select("p_partkey", P.quantity(s, "articles", {"two": 2, "three": 3}, listed="^articles:").alias("quantity"))


@query(
    "split_items",
    """
WITH s AS (SELECT p_partkey, string_split(replace(p_type, ' ', ';') || ';' || replace(p_name, ' ', ';'), ';') AS a FROM part),
p AS (SELECT p_partkey, unnest(a) AS piece, generate_subscripts(a, 1) - 1 AS place FROM s),
n AS (SELECT *, sum((place = 0 OR regexp_matches(piece, '^[A-Z]') AND length(piece) > 4)::INTEGER) OVER (PARTITION BY p_partkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS item FROM p)
SELECT p_partkey, item::INTEGER AS item, string_agg(piece, '; ' ORDER BY place) AS text FROM n GROUP BY p_partkey, item
""",
)
def split_items(t: Tables) -> DataFrame:
    """Pieces of a text; those without a kind of their own go with the one before."""
    rows = t.part.select("p_partkey", F.concat_ws(";", F.replace("p_type", F.lit(" "), F.lit(";")), F.replace("p_name", F.lit(" "), F.lit(";"))).alias("text"))
    return P.items(rows, F.col("piece").rlike("^[A-Z]") & (F.length("piece") > 4), "p_partkey")


@query(
    "reclassified",
    """
WITH r AS (SELECT p_partkey, CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END AS was, CASE WHEN p_size = 7 THEN NULL WHEN p_size < 30 THEN 'small' ELSE 'large' END AS now FROM part)
SELECT CASE WHEN now IS NULL THEN 'delete' WHEN now <> was THEN 'update' ELSE 'keep' END AS action, was, coalesce(now, '-') AS now, count(*) AS n FROM r GROUP BY ALL
""",
)
def reclassified(t: Tables) -> DataFrame:
    """Counts of what a changed classifier would delete, update and keep."""
    size = F.col("p_size")
    stored = t.part.withColumn("was", F.when(size < 25, "small").otherwise("large"))
    got = P.reclassified(stored, "p_partkey", "was", F.when(size == 7, None).when(size < 30, "small").otherwise("large"))
    return got.groupBy("action", "was", F.coalesce("now", F.lit("-")).alias("now")).agg(F.count("*").alias("n"))


_KEYWORDS = "('law', 'of the', 1), ('law', 'tion', 1), ('art', 'und', 2), ('art', 'der', 2), ('art', 'die', 2), ('sea', 'les', 3), ('sea', 'que la', 3)"


@query(
    "keyword_topics",
    rf"""
WITH k(topic, keyword, place) AS (VALUES {_KEYWORDS}), d AS (SELECT doc_id, replace(replace(lower(trim(regexp_replace(replace(text, chr(0), ' '), '\s+', ' ', 'g'))), 'ё', 'е'), 'ß', 'ss') AS s FROM documents),
c AS (SELECT doc_id, topic, place, sum(CASE WHEN contains(keyword, ' ') THEN 3 ELSE 1 END) AS score FROM d JOIN k ON contains(s, keyword) GROUP BY ALL)
SELECT doc_id, topic, score::INTEGER AS score, least(85, 35 + 8 * score)::INTEGER AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1
""",
)
def keyword_topics(t: Tables) -> DataFrame:
    """The topic whose keywords a text holds most."""
    return P.keyword_topics(t.documents, t.spark.sql(f"SELECT * FROM VALUES {_KEYWORDS} AS k(topic, keyword, place)"), "doc_id")


@query(
    "translated_query",
    """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), m AS (SELECT p_partkey, list_filter(list_transform(w, lambda x: CASE x WHEN 'small' THEN 'klein' WHEN 'large' THEN 'gross' WHEN 'red' THEN 'rot' WHEN 'blue' THEN 'blau' END), lambda x: x IS NOT NULL) AS m FROM w)
SELECT p_partkey, trim(array_to_string(m[1:1], ' ') || CASE WHEN len(m) > 0 THEN ' ' ELSE '' END || 'teil') AS query FROM m
""",
)
def translated_query(t: Tables) -> DataFrame:
    """A query in another language, word by word."""
    return t.part.select("p_partkey", P.translated(F.split("p_name", " "), {"small": "klein", "large": "gross", "red": "rot", "blue": "blau"}, F.lit("teil"), 1).alias("query"))


@query("joined_parts", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END], lambda p: p IS NOT NULL AND trim(p) <> '')[1:1] || list_filter(list_filter([CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END], lambda p: p IS NOT NULL AND trim(p) <> '')[2:], lambda p: p = o_orderstatus), '; ') AS text FROM orders")
def joined_parts(t: Tables) -> DataFrame:
    """Parts of a description, each once, in order."""
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", P.joined_parts(F.when(k % 3 > 0, F.col("o_orderpriority")), F.when(k % 2 == 0, F.col("o_orderpriority")), F.when(k % 5 == 0, " ").otherwise(F.col("o_orderstatus"))).alias("text"))


_LEVELS = "('brand11', 'A'), ('brand22', 'B'), ('brand3', 'C'), ('brand5', 'D')"


@query(
    "level_fallback",
    f"""
WITH l(name_key, level) AS (VALUES {_LEVELS}), p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'S' END AS stored, regexp_replace(translate(lower(p_brand), 'bc', 'все'), '[^0-9\\p{{L}}]', '', 'g') AS k FROM part),
m AS (SELECT replace(name_key, 'b', 'в') AS name_key, level FROM l),
e AS (SELECT p_partkey, min(level) AS exact FROM p JOIN m ON k = name_key WHERE stored IS NULL GROUP BY 1),
h AS (SELECT p_partkey, arg_min(level, name_key) AS held FROM p JOIN m ON contains(k, name_key) WHERE stored IS NULL GROUP BY 1)
SELECT p.p_partkey, coalesce(stored, exact, held) AS level, CASE WHEN stored IS NOT NULL THEN 1 WHEN exact IS NOT NULL THEN 2 WHEN held IS NOT NULL THEN 3 ELSE 0 END::INTEGER AS step FROM p LEFT JOIN e USING (p_partkey) LEFT JOIN h USING (p_partkey)
""",
)
def level_fallback(t: Tables) -> DataFrame:
    """A level as stored, by the same name, or by a name that is held."""
    levels = t.spark.sql(f"SELECT * FROM VALUES {_LEVELS} AS l(name_key, level)").withColumn("name_key", X.key_of(F.col("name_key")))
    return P.level_of(t.part.withColumn("stored", F.when(F.col("p_partkey") % 3 == 0, "S")), levels, "p_partkey", "stored", "p_brand")


@query(
    "staff_match",
    """
WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 END AS ext, right(c_name, 3) AS name FROM customer),
u AS (SELECT s_suppkey AS user_id, s_suppkey % 50 AS ext, right(s_name, 3) AS name FROM supplier),
i AS (SELECT ext, min(user_id) AS a FROM u GROUP BY ext), n AS (SELECT name, min(user_id) AS b FROM u GROUP BY name HAVING count(*) = 1)
SELECT k, coalesce(a, b) AS user_id, CASE WHEN a IS NOT NULL THEN 'id' WHEN b IS NOT NULL THEN 'name' ELSE 'create' END AS action FROM e LEFT JOIN i USING (ext) LEFT JOIN n USING (name)
""",
)
def staff_match(t: Tables) -> DataFrame:
    """Entries to users by external id, else by a name that one user has."""
    k = F.col("c_custkey")
    entries = t.customer.select(k.alias("k"), F.when(k % 3 == 0, k % 50).alias("ext"), F.right("c_name", F.lit(3)).alias("name"))
    users = t.supplier.select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") % 50).alias("ext"), F.right("s_name", F.lit(3)).alias("name"))
    return P.staff_match(entries, users, "k", "ext", "name")


@query(
    "merge_targets",
    """
WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_custkey - 1 END AS t FROM customer),
w(id, cur) AS (SELECT id, id FROM p UNION ALL SELECT w.id, p.t FROM w JOIN p ON p.id = w.cur JOIN p q ON q.id = p.t)
SELECT id, min(cur) AS target FROM w GROUP BY id
""",
)
def merge_targets(t: Tables) -> DataFrame:
    """The rows at the ends of chains of merge pointers."""
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("id"), F.when(k % 4 > 0, k - 1).alias("merged_into"))
    return P.canonical(rows)


@query("author_match")
def author_match(t: Tables) -> DataFrame:
    """Authors to users of the same surname, greedily in order, so without a statement."""
    named = lambda c: F.concat(F.lit("s"), (F.col(c) % 997).cast("string"))
    authors = t.orders.select((F.col("o_custkey") % 500).alias("doc"), F.col("o_orderkey").alias("place"), F.concat_ws(" ", named("o_orderkey"), "o_orderstatus").alias("author"), named("o_orderkey").alias("surname"), F.col("o_orderstatus").alias("initials"))
    users = t.supplier.select(F.col("s_suppkey").alias("user_id"), named("s_suppkey").alias("surname"), F.when(F.col("s_nationkey") % 2 == 0, "O").otherwise("FX").alias("initials"))
    return P.match_authors(authors, users)
