"""Resolution queries: customers and suppliers as people, parts as a catalogue, orders and line items as plans and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import merges as M
from tessera.operators import resolution as R

from .query import Tables, query


@query(
    "name_unique_match",
    r"""
WITH v AS (SELECT c_custkey, unnest(list_distinct([right(c_name, 3), right(c_name, 2), right(c_name, 1)])) AS n FROM customer),
s AS (SELECT s_suppkey, right(s_name, 3) AS n FROM supplier),
h AS (SELECT c_custkey, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS t FROM v JOIN s USING (n) GROUP BY c_custkey)
SELECT c.c_custkey, coalesce(CASE WHEN h.n = 1 THEN t END, -1) AS s_suppkey, CASE WHEN h.n IS NULL THEN 'none' WHEN h.n = 1 THEN 'one' ELSE 'many' END AS outcome FROM customer c LEFT JOIN h USING (c_custkey)
""",
)
def name_unique_match(t: Tables) -> DataFrame:
    """People by name variants: one match is taken, none and several are reported."""
    variants = F.array(*[F.right("c_name", F.lit(n)) for n in (3, 2, 1)])
    got = R.unique_match(t.customer, variants, t.supplier.withColumn("n", F.right("s_name", F.lit(3))), "c_custkey", "n", "s_suppkey")
    return got.withColumn("s_suppkey", F.coalesce("s_suppkey", F.lit(-1)))


@query(
    "exact_duplicate_docs",
    r"""
WITH d AS (SELECT doc_id, md5(replace(replace(lower(trim(regexp_replace(replace(text, chr(0), ' '), '\s+', ' ', 'g'))), 'ё', 'е'), 'ß', 'ss')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS copies FROM d QUALIFY copies > 1
""",
)
def exact_duplicate_docs(t: Tables) -> DataFrame:
    """Equal texts after normalising."""
    return R.exact_duplicates(t.documents)


@query(
    "fuzzy_catalogue",
    r"""
WITH q(query) AS (VALUES ('small steel bolt'), ('large brass'), ('ab'), ('blue')), p AS (SELECT p_partkey, lower(p_name) AS name FROM part),
s AS (SELECT query, p_partkey, CASE WHEN name = query THEN 1.0::DOUBLE ELSE greatest(CASE WHEN contains(name, query) THEN 0.92 ELSE 0.0 END,
  0.55 + 0.35 * len(list_intersect(string_split(query, ' '), string_split(name, ' '))) / greatest(1, len(list_distinct(string_split(query, ' ')))),
  0.9 * (1 - levenshtein(name, query) / greatest(length(name), length(query), 1)),
  CASE WHEN list_aggregate(list_transform(string_split(name, ' '), lambda w: left(w, 1)), 'string_agg', '') = query THEN 0.88 ELSE 0.0 END)::DOUBLE END AS score FROM q, p)
SELECT query, p_partkey, round(score, 6) AS score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, p_partkey) AS place FROM s WHERE score >= 0.48) WHERE place <= 20
""",
)
def fuzzy_catalogue(t: Tables) -> DataFrame:
    """The twenty best names for each of a few queries; the queries are broadcast, the catalogue streams by."""
    from tessera.operators.retrieval import top

    queries = F.broadcast(t.spark.sql("SELECT * FROM VALUES ('small steel bolt'), ('large brass'), ('ab'), ('blue') AS q(query)"))  # four rows
    scored = t.part.select("p_partkey", F.lower("p_name").alias("name")).crossJoin(queries).select("query", "p_partkey", F.round(R.catalogue_score(F.col("name"), F.col("query")), 6).alias("score"))
    return top(scored.where("score >= 0.48"), ["query"], [F.desc("score"), F.asc("p_partkey")], 20)


@query(
    "rule_precedence",
    """
WITH r AS (SELECT p_type AS path, p_brand AS value, 'type' AS source, 10 AS priority FROM part UNION ALL SELECT p_type, p_brand, 'journal', 20 FROM part WHERE p_size > 25 UNION ALL SELECT p_type, p_brand, 'template', 30 FROM part WHERE p_size > 45),
u AS (SELECT path, source, priority, min(value) AS value FROM r GROUP BY ALL)
SELECT path, arg_max(value, priority) AS value, arg_max(source, priority) AS source, count(DISTINCT value) > 1 AS conflict FROM u GROUP BY path
""",
)
def rule_precedence(t: Tables) -> DataFrame:
    """The value of highest precedence for each path, and whether it overruled another."""
    level = lambda df, source, priority: df.groupBy(F.col("p_type").alias("path")).agg(F.min("p_brand").alias("value")).select("path", "value", F.lit(source).alias("source"), F.lit(priority).alias("priority"))
    rules = level(t.part, "type", 10).unionByName(level(t.part.where("p_size > 25"), "journal", 20)).unionByName(level(t.part.where("p_size > 45"), "template", 30))
    return R.rule_precedence(rules)


_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _words(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({column}), '[0-9\\p{{L}}]{{3,}}'), lambda w: w NOT IN ({_STOPS})))"


def _lines(t: Tables, *of_part: Column) -> DataFrame:
    """Line items with an order and a part: (l_orderkey, owner, kind, line, more of the part); ``line`` is a line's place and
    part, and what is asked ``of_part`` as a number, as one value: plans and facts both read it, so that lines are shuffled
    once for both."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", F.array(F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long")).alias("line"))
    title = F.concat_ws(" ", "p_name", "p_type").alias("title")
    parts = t.part.select("p_partkey", title).select("p_partkey", *(c.cast("long").alias("more") for c in of_part) if of_part else ["title"])
    lines = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey", "p_partkey")
    lines = lines.withColumn("line", F.array_append("line", F.col("more"))).drop("more") if of_part else lines
    return lines.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("kind")), F.col("o_orderkey") == F.col("l_orderkey"))


def _titled(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Plans are orders, titled by their first part; facts are line items, titled by theirs; kinds are the owners' segments."""
    lines = _lines(t)
    plans = lines.groupBy("owner", "kind", F.col("l_orderkey").alias("plan")).agg(F.min_by("title", "line").alias("plan_title"))
    return plans.withColumn("capacity", (1 + F.col("plan") % 3).cast("int")), lines.select("owner", "kind", (F.col("l_orderkey") * 8 + F.col("line")[0]).alias("fact"), F.col("title").alias("fact_title"))


def _candidates(t: Tables) -> DataFrame:
    return R.title_candidates(*_titled(t), ["owner", "kind"]).select("owner", "kind", "plan", "fact", "capacity", F.round("score", 6).alias("score"))


_CANDIDATES = f"""l AS (SELECT o_custkey AS owner, o_orderstatus AS kind, l_orderkey, l_linenumber, l_partkey, p_name || ' ' || p_type AS title FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
pl AS (SELECT owner, kind, l_orderkey AS plan, arg_min(title, (l_linenumber, l_partkey)) AS pt FROM l GROUP BY ALL),
fa AS (SELECT owner, kind, l_orderkey * 8 + l_linenumber AS fact, title AS ft FROM l),
c AS (SELECT owner, kind, plan, fact, trim(regexp_replace(lower(pt), '[^0-9\\p{{L}}]+', ' ', 'g')) AS p, trim(regexp_replace(lower(ft), '[^0-9\\p{{L}}]+', ' ', 'g')) AS f, {_words("pt")} AS pw, {_words("ft")} AS fw FROM pl JOIN fa USING (owner, kind)),
s AS (SELECT *, len(list_intersect(pw, fw)) AS n FROM c),
r AS (SELECT owner, kind, plan, fact, CASE WHEN least(length(p), length(f)) >= 15 AND (contains(p, f) OR contains(f, p)) THEN 1.0 WHEN n < 2 OR len(fw) = 0 THEN 0.0 ELSE 0.72 * n / len(fw) + 0.28 * n / least(len(pw), len(fw)) END::DOUBLE AS score FROM s)"""


@query(
    "title_candidates",
    f"""
WITH {_CANDIDATES}
SELECT owner, kind, plan, fact, (1 + plan % 3)::INTEGER AS capacity, round(score, 6) AS score FROM r WHERE score >= 0.52
""",
)
def title_candidates(t: Tables) -> DataFrame:
    """Plans and facts of one owner and kind whose titles are alike enough."""
    return _candidates(t)


#: The rounds as a recursion: of a step's rows, those taken are done, the others go on.
_ROUNDS = f"""
{_CANDIDATES},
state(owner, plan, fact, score, room, done) AS (
  SELECT owner, plan, fact, max(round(score, 6)), any_value(1 + plan % 3), false FROM r WHERE score >= 0.52 GROUP BY owner, plan, fact
  UNION ALL
  SELECT owner, plan, fact, score, room - used, take FROM (
    SELECT *, bool_or(take) OVER (PARTITION BY owner, fact) AS gone, sum(take::INT) OVER (PARTITION BY owner, plan) AS used FROM (
      SELECT owner, plan, fact, score, room, row_number() OVER (PARTITION BY owner, fact ORDER BY score DESC, plan) = 1
        AND row_number() OVER (PARTITION BY owner, plan ORDER BY score DESC, fact) <= room AS take FROM state WHERE NOT done))
  WHERE take OR (NOT gone AND room > used)),
taken AS (SELECT owner, plan, fact, score FROM state WHERE done)"""


def _allocated(t: Tables) -> DataFrame:
    # by plan already here, as the first round wants them
    return R.allocate(_candidates(t).repartition("owner", "plan").groupBy("owner", "plan", "fact", "capacity").agg(F.max("score").alias("score")))


@query("greedy_allocation", f"WITH RECURSIVE {_ROUNDS} SELECT owner, plan, fact, score FROM taken")
def greedy_allocation(t: Tables) -> DataFrame:
    """Facts to plans of one owner and kind by their titles' score, best first, under the plans' capacities; the tests hold it
    against the order taken one by one."""
    return _allocated(t)


@query(
    "capacity_fill",
    f"""
WITH RECURSIVE {_ROUNDS},
room AS (SELECT owner, kind, pl.plan, contains(pt, 'STANDARD') AS generic, 1 + pl.plan % 3 - coalesce(used, 0) AS room FROM pl LEFT JOIN (SELECT plan, count(*) AS used FROM taken GROUP BY plan) u ON u.plan = pl.plan),
ends AS (SELECT *, sum(room) OVER (PARTITION BY owner, kind ORDER BY NOT generic, plan ROWS UNBOUNDED PRECEDING) AS last FROM room WHERE room > 0),
free AS (SELECT owner, kind, fact, row_number() OVER (PARTITION BY owner, kind ORDER BY fact) AS place FROM fa WHERE fact NOT IN (SELECT fact FROM taken))
SELECT e.owner, e.kind, plan, fact FROM ends e JOIN free f ON e.owner = f.owner AND e.kind = f.kind AND place BETWEEN last - room + 1 AND last
""",
)
def capacity_fill(t: Tables) -> DataFrame:
    """Facts that matched no title fill what room plans of their owner and kind have left, standard ones first."""
    lines = _lines(t, F.contains("title", F.lit("STANDARD")))
    plans = lines.groupBy("owner", "kind", F.col("l_orderkey").alias("plan")).agg(F.min("line").alias("first"))
    plans = plans.select("owner", "kind", "plan", (1 + F.col("plan") % 3).cast("int").alias("capacity"), (F.col("first")[2] == 1).alias("generic"))
    return R.fill_capacity(plans, lines.select("owner", "kind", (F.col("l_orderkey") * 8 + F.col("line")[0]).alias("fact")), _allocated(t), ["owner", "kind"])


@query(
    "fingerprint_diff",
    "WITH a AS (SELECT p_partkey, p_brand AS d FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE p_brand END AS d FROM part WHERE p_partkey % 7 <> 0) SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (p_partkey) WHERE a.d IS DISTINCT FROM b.d",
)
def fingerprint_diff(t: Tables) -> DataFrame:
    """Members added, removed or changed between two listings."""
    k = F.col("p_partkey")
    old = t.part.where(k % 5 != 0).select(k, F.col("p_brand").alias("d"))
    new = t.part.where(k % 7 != 0).select(k, F.when(k % 4 == 0, "x").otherwise(F.col("p_brand")).alias("d"))
    return R.fingerprint_diff(old, new, "p_partkey", "d")


@query("key_normaliser", r"SELECT p_partkey, regexp_replace(translate(lower(p_name), 'bcё', 'все'), '[^0-9\p{L}]', '', 'g') AS key FROM part")
def key_normaliser(t: Tables) -> DataFrame:
    """Catalogue keys."""
    return t.part.select("p_partkey", X.key_of(F.col("p_name")).alias("key"))


@query(
    "merged_references",
    """
WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 IN (1, 4) THEN c_custkey - 1 WHEN c_custkey % 25 = 2 THEN c_custkey - 2 ELSE c_custkey END AS root FROM customer),
o AS (SELECT o_orderkey AS ref, o_custkey AS entity, o_orderpriority AS kind, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS version FROM orders),
x AS (SELECT o.*, coalesce(root, entity) AS root, coalesce(root, entity) = entity AS own FROM o LEFT JOIN r ON id = entity)
SELECT ref, root AS entity, kind, CASE WHEN own THEN version ELSE coalesce(max(version) FILTER (own) OVER (PARTITION BY root, kind), 0) + row_number() OVER (PARTITION BY root, kind, own ORDER BY entity, version, ref) END AS version FROM x
""",
)
def merged_references(t: Tables) -> DataFrame:
    """Orders of customers that are merged, some of them into each other: the root's own keep their versions, the others number on."""
    k = F.col("c_custkey")
    entities = t.customer.select(k.alias("id"), F.col("c_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("active"), F.lit(None).cast("long").alias("merged_into"), F.lit(0).cast("long").alias("last_used"))
    target = F.when(k % 5 == 1, k - 1).when(k % 5 == 3, k + 1).when(k % 5 == 4, k - 1).when(k % 25 == 2, k - 2)
    pairs = t.customer.select(k.alias("source"), target.alias("target")).where("target IS NOT NULL")
    version = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")).cast("long")
    references = t.orders.select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("kind"), version.alias("version"))
    return M.merged(entities, references, pairs)[1]
