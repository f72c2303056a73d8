"""DuckDB statements of the corpus queries that SQL can express, by brute force over all pairs."""

_COMPONENTS = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

OP3 = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE len(w) WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN least ON id = d.doc_id
"""

OP5 = f"""
WITH RECURSIVE
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE x.norm > 0 AND y.norm > 0 AND list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS},
counts AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least l ON l.id = e.vec_id LEFT JOIN counts c ON c.id = e.vec_id
"""

OP13 = r"""
WITH
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
classes AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[1:step - 1] AS applied FROM orders, range(1, 6) AS r(step)),
counted AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT contains(fails, f) AND translate(fails, applied, '') = fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, applied, '') = fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, applied, '') <> fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, applied, '') = fails AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, applied, '') = fails AND toxic), 0)::BIGINT AS toxic_lost
  FROM classes, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""

OP11 = r"""
WITH
d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(n, 0) AS total, coalesce(v, 0) AS v FROM groups LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN vs USING (lang)),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1)::HUGEINT // (total + v)::HUGEINT)::BIGINT AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
whole AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 1)::HUGEINT // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT)::BIGINT AS p FROM c GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT x.lang, x.source, 'term' AS part, x.term AS item, ((x.p - q.p) * (x.p - q.p) // q.p)::BIGINT AS value
  FROM dense x JOIN whole q ON q.lang = x.lang AND q.term = x.term WHERE x.n > 0 AND x.p > q.p)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""
