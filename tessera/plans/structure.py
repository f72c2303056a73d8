"""Structure queries: the lines of documents are blocks; numbers, labels and captions are put in by expressions, alike in
both forms, where the tables have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import automata, trees
from tessera.operators import structure as S

from .query import Tables, query

_LINES = "l AS (SELECT doc_id, place::INTEGER AS place, trim(t) AS text FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place, unnest(string_split(text, chr(10))) AS t FROM documents))"
_ORDER = "OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING)"


def _lines(t: Tables) -> DataFrame:
    return S.lines(t.documents)


@query(
    "section_contents",
    f"""
WITH {_LINES}, h AS (SELECT *, length(text) BETWEEN 1 AND 40 AS h FROM l), p AS (SELECT *, sum(h::INTEGER) {_ORDER} AS part FROM h)
SELECT doc_id, part::INTEGER AS part, max(text) FILTER (h) AS heading, count(*) FILTER (NOT h AND text <> '') AS n_blocks, md5(coalesce(string_agg(text, chr(10) ORDER BY place) FILTER (NOT h AND text <> ''), '')) AS content
FROM p WHERE part > 0 GROUP BY doc_id, part
""",
)
def section_contents(t: Tables) -> DataFrame:
    """Headings (short lines) with what follows up to the next one; the content as a digest."""
    return S.contents(_lines(t), F.length("text").between(1, 40)).withColumn("content", F.md5("content"))


@query(
    "reference_entries",
    rf"""
WITH {_LINES}, n AS (SELECT doc_id, place, CASE WHEN place % 3 = 1 AND doc_id % 4 > 0 THEN ((place // 3) + 1)::VARCHAR || '. ' || text ELSE text END AS text FROM l WHERE text <> ''),
m AS (SELECT *, try_cast(nullif(regexp_extract(text, '^\s*(\d+)[.)]', 1), '') AS INTEGER) AS num FROM n),
s AS (SELECT *, num IS NOT NULL OR count(num) OVER (PARTITION BY doc_id) = 0 OR row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1 AS s FROM m),
p AS (SELECT *, sum(s::INTEGER) {_ORDER} AS part FROM s)
SELECT doc_id, part::INTEGER AS part, arg_min(num, place) FILTER (place = first) AS number, count(*) AS n_blocks, md5(string_agg(text, ' ' ORDER BY place)) AS entry
FROM (SELECT *, min(place) OVER (PARTITION BY doc_id, part) AS first FROM p) GROUP BY doc_id, part
""",
)
def reference_entries(t: Tables) -> DataFrame:
    """Numbered entries with their continuation lines; documents without numbers have one entry a line."""
    numbered = F.when((F.col("place") % 3 == 1) & (F.col("doc_id") % 4 > 0), F.concat((F.floor(F.col("place") / 3) + 1).cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text"))
    return S.entries(_lines(t).where("text <> ''").withColumn("text", numbered)).withColumn("entry", F.md5("entry"))


@query(
    "parts_open",
    f"""
WITH {_LINES}, m AS (SELECT doc_id, place, CASE WHEN text LIKE 'A%' THEN 'abstract' WHEN text LIKE 'T%' THEN 'section' WHEN text LIKE 'R%' THEN 'references' END AS marker FROM l)
SELECT doc_id, place, marker, last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM m
""",
)
def parts_open(t: Tables) -> DataFrame:
    """The part that is open at each block."""
    begins = lambda c: F.col("text").startswith(c)
    return S.open_part(_lines(t), F.when(begins("A"), "abstract").when(begins("T"), "section").when(begins("R"), "references")).select("doc_id", "place", "marker", "open")


@query(
    "labelled_values",
    f"""
WITH {_LINES}, b AS (SELECT *, text LIKE 'Th%' AS label, length(text) < 20 AND text NOT LIKE 'Th%' AS stop FROM l), p AS (SELECT *, sum((label OR stop)::INTEGER) {_ORDER} AS part FROM b),
g AS (SELECT doc_id, part, arg_min(label, place) AS label, md5(coalesce(string_agg(text, ' ' ORDER BY place) FILTER (text <> ''), '')) AS value, count(*) FILTER (text <> '') AS n_blocks FROM p WHERE part > 0 GROUP BY doc_id, part)
SELECT doc_id, part::INTEGER AS part, value, n_blocks FROM g WHERE label
""",
)
def labelled_values(t: Tables) -> DataFrame:
    """Labels with their continuation lines, up to the next label or short line."""
    label = F.col("text").startswith("Th")
    return S.labelled(_lines(t), label, (F.length("text") < 20) & ~label).withColumn("value", F.md5("value"))


@query(
    "first_section",
    rf"""
WITH {_LINES}, n AS (SELECT *, trim(regexp_replace(replace(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ё', 'е'), 'ß', 'ss'), '[^0-9\p{{L}}]+', ' ', 'g')) AS plain FROM l)
SELECT doc_id, min(place) AS place, arg_min(text, place) AS text FROM n WHERE plain IN ('the', 'of', 'die', 'les') OR starts_with(plain, 'that') GROUP BY doc_id
""",
)
def first_section(t: Tables) -> DataFrame:
    """The first block that is one of a section's names."""
    return S.first_section(_lines(t), ["the", "of", "die", "les"], "that")


@query(
    "front_title",
    f"""
WITH {_LINES}, b AS (SELECT *, contains(text, '@') OR text LIKE '%, %, %' AS byline, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k,
  coalesce(lead(contains(text, '@') OR text LIKE '%, %, %', 1) OVER (PARTITION BY doc_id ORDER BY place), false) OR coalesce(lead(contains(text, '@') OR text LIKE '%, %, %', 2) OVER (PARTITION BY doc_id ORDER BY place), false) AS near FROM l WHERE text <> ''),
s AS (SELECT doc_id, place, text, CASE WHEN length(text) BETWEEN 15 AND 200 THEN 3.0 ELSE 0 END + CASE WHEN NOT ends_with(text, '.') THEN 2.0 ELSE 0 END + CASE WHEN near THEN 4.0 ELSE 0 END - 0.5 * (k - 1) AS score FROM b WHERE k <= 12)
SELECT doc_id, place, text, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS r FROM s) WHERE r = 1
""",
)
def front_title(t: Tables) -> DataFrame:
    """The likeliest title of a document's first blocks, with a look at the two blocks after."""
    return S.title(_lines(t), F.contains("text", F.lit("@")) | F.col("text").like("%, %, %"))


_ROLES = """r AS (SELECT *, CASE WHEN text = '' THEN 'paragraph' WHEN length(text) < 25 THEN 'section' WHEN text LIKE '%|%' THEN 'list_item' WHEN place = 0 THEN 'title' ELSE 'paragraph' END AS role,
  CASE WHEN text = '' THEN 1.0 WHEN length(text) < 25 THEN 0.86 WHEN text LIKE '%|%' THEN 0.98 WHEN place = 0 THEN 0.72 ELSE 0.92 END::DOUBLE AS confidence FROM l)"""


def _roles(t: Tables) -> DataFrame:
    text = F.col("text")
    return S.block_roles(_lines(t), [(text == "", "paragraph", 1.0), (F.length("text") < 25, "section", 0.86), (text.like("%|%"), "list_item", 0.98), (F.col("place") == 0, "title", 0.72)])


@query("block_roles", f"WITH {_LINES}, {_ROLES} SELECT role, confidence, count(*) AS n, count(DISTINCT doc_id) AS docs FROM r GROUP BY role, confidence")
def block_roles(t: Tables) -> DataFrame:
    """Roles by rules in order."""
    return _roles(t).groupBy("role", "confidence").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(
    "merged_decisions",
    f"""
WITH {_LINES}, {_ROLES},
m AS (SELECT *, CASE WHEN place % 4 = 0 THEN 'title' WHEN place % 4 = 1 THEN 'paragraph' WHEN place % 4 = 2 THEN 'section' END AS mr, CASE WHEN place % 4 < 3 THEN ((doc_id * 37 + place * 11) % 100) / 100.0 END::DOUBLE AS mc FROM r),
k AS (SELECT *, coalesce(mc >= 0.58 AND CASE WHEN mr = role THEN mc >= confidence - 0.1 ELSE confidence < 0.97 AND mc >= greatest(0.70, confidence + 0.04) END, false) AS taken FROM m),
f AS (SELECT *, CASE WHEN taken THEN mr ELSE role END AS final, CASE WHEN taken THEN mc ELSE confidence END AS sureness FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, final = 'title' ORDER BY sureness DESC, place) AS r FROM f)
SELECT CASE WHEN final = 'title' AND r > 1 THEN CASE WHEN place < 20 THEN 'subtitle' ELSE 'paragraph' END ELSE final END AS final, CASE WHEN taken THEN 'model' ELSE 'rules' END AS source, count(*) AS n, sum(place)::BIGINT AS places
FROM o GROUP BY ALL
""",
)
def merged_decisions(t: Tables) -> DataFrame:
    """Rules' and a model's decisions under confidence gates; one title a document."""
    turn = F.col("place") % 4
    model = F.when(turn == 0, "title").when(turn == 1, "paragraph").when(turn == 2, "section")
    sure = F.when(turn < 3, ((F.col("doc_id") * 37 + F.col("place") * 11) % 100) / 100.0)
    got = S.decided(_roles(t).withColumns({"model_role": model, "model_confidence": sure}))
    return got.groupBy("final", "source").agg(F.count("*").alias("n"), F.sum("place").alias("places"))


@query(
    "question_batches",
    f"""
WITH {_LINES}, k AS (SELECT doc_id, place, text, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM l)
SELECT doc_id, place, ((row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1) // 16)::INTEGER AS batch FROM k WHERE length(text) < 30 OR k <= 35
""",
)
def question_batches(t: Tables) -> DataFrame:
    """Front and short blocks in batches of sixteen."""
    return S.question_batches(_lines(t), F.length("text") < 30, 16)


@query(
    "language_before_references",
    rf"""
WITH {_LINES}, p AS (SELECT *, sum((text LIKE 'R%')::INTEGER) {_ORDER} AS part FROM l),
g AS (SELECT doc_id, count(*) AS n_blocks, sum(len(regexp_extract_all(text, '\p{{Cyrillic}}'))) AS c, sum(len(regexp_extract_all(text, '[A-Za-z]'))) AS e FROM p WHERE part = 0 GROUP BY doc_id)
SELECT doc_id, CASE WHEN c >= 12 AND c > 1.2 * e THEN 'ru' WHEN e >= 12 AND e > 1.2 * c THEN 'en' WHEN c + e = 0 THEN 'unknown' ELSE 'mixed' END AS language, n_blocks FROM g
""",
)
def language_before_references(t: Tables) -> DataFrame:
    """The language of what precedes the references."""
    return S.language_before(_lines(t), F.col("text").startswith("R"))


_CAPTIONED = """c AS (SELECT doc_id, place, CASE WHEN place % 5 = 2 THEN 'Figure ' || (1 + place // 5 + CASE WHEN doc_id % 3 = 0 AND place > 9 THEN 1 ELSE 0 END)::VARCHAR || '. ' || text WHEN place % 5 = 4 AND doc_id % 2 = 0 THEN text || ' (see figure ' || (1 + place // 5)::VARCHAR || ')' ELSE text END AS text FROM l),
i AS (SELECT doc_id, try_cast(nullif(regexp_extract(text, '(?i)^figure\\.?\\s*(\\d+)', 1), '') AS INTEGER) AS own, text FROM c),
a AS (SELECT doc_id, list(DISTINCT own ORDER BY own) FILTER (own IS NOT NULL) AS numbers FROM i GROUP BY doc_id),
o AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?i)figure\\.?\\s*(\\d+)', 1))::INTEGER AS n FROM i WHERE own IS NULL),
b AS (SELECT doc_id, list(n ORDER BY n) AS mentioned FROM o GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(numbers, []) AS numbers, coalesce(mentioned, []) AS mentioned FROM a LEFT JOIN b USING (doc_id))""".replace("\\\\", "\\")


def _captioned(t: Tables) -> DataFrame:
    place, fifth = F.col("place"), (1 + F.floor(F.col("place") / 5)).cast("int")
    moved = F.when((F.col("doc_id") % 3 == 0) & (place > 9), 1).otherwise(0)
    text = (
        F.when(place % 5 == 2, F.concat(F.lit("Figure "), (fifth + moved).cast("string"), F.lit(". "), F.col("text")))
        .when((place % 5 == 4) & (F.col("doc_id") % 2 == 0), F.concat(F.col("text"), F.lit(" (see figure "), fifth.cast("string"), F.lit(")")))
        .otherwise(F.col("text"))
    )
    return _lines(t).withColumn("text", text)


@query(
    "integrity_report",
    f"""
WITH {_LINES}, {_CAPTIONED}
SELECT doc_id, 'figure_numbering_gap' AS code, 'warning' AS severity FROM d WHERE len(numbers) > 0 AND list_max(numbers) <> len(numbers)
UNION ALL SELECT doc_id, 'unreferenced_figure', 'warning' FROM d WHERE len(list_filter(numbers, lambda n: NOT list_contains(mentioned, n))) > 0
UNION ALL SELECT doc_id, 'figure_without_caption', 'error' FROM d WHERE len(list_filter(mentioned, lambda n: NOT list_contains(numbers, n))) > 0
UNION ALL SELECT doc_id, 'no_figure', 'info' FROM d WHERE len(numbers) = 0
""",
)
def integrity_report(t: Tables) -> DataFrame:
    """Captions and mentions of each document against each other, one row an issue."""
    rows = S.caption_numbers(_captioned(t), "figure")
    n, m = F.col("numbers"), F.col("mentioned")
    return S.integrity_issues(
        rows,
        [
            ("figure_numbering_gap", "warning", (F.size(n) > 0) & (F.array_max(n) != F.size(n))),
            ("unreferenced_figure", "warning", F.size(F.array_except(n, m)) > 0),
            ("figure_without_caption", "error", F.size(F.array_except(m, n)) > 0),
            ("no_figure", "info", F.size(n) == 0),
        ],
    )


@query(
    "json_answers",
    "WITH a AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'no answer' ELSE 'Answer: {\"kind\": \"' || event_type || '\", \"score\": ' || (event_id % 100)::VARCHAR || '} as asked' END AS s FROM events), j AS (SELECT event_id, nullif(regexp_extract(s, '(?s)\\{.*\\}'), '') AS j FROM a) SELECT event_id, j ->> 'kind' AS kind, (j ->> 'score')::INTEGER AS score FROM j",
)
def json_answers(t: Tables) -> DataFrame:
    """Fields of JSON objects inside of texts."""
    k = F.col("event_id")
    text = F.when(k % 7 == 0, None).when(k % 5 == 0, "no answer").otherwise(F.concat(F.lit('Answer: {"kind": "'), F.col("event_type"), F.lit('", "score": '), (k % 100).cast("string"), F.lit("} as asked")))
    return t.events.select("event_id", S.json_answer(text, "kind string, score int").alias("j")).select("event_id", "j.kind", "j.score")


@query("people_by_unit", "SELECT c_nationkey, lower(c_mktsegment) AS person, array_to_string(list(DISTINCT right(c_name, 1) ORDER BY right(c_name, 1)), ',') AS sources FROM customer GROUP BY ALL")
def people_by_unit(t: Tables) -> DataFrame:
    """People of a unit under one spelling, with where they come from."""
    rows = t.customer.select("c_nationkey", F.col("c_mktsegment").alias("name"), F.right("c_name", F.lit(1)).alias("source"))
    return S.people_by_unit(rows, "c_nationkey", "name", "source").withColumn("sources", F.array_join("sources", ","))


@query("latex_escaped", "SELECT page_id, replace(replace(replace(replace(replace(url, '&', chr(92) || '&'), '%', chr(92) || '%'), '#', chr(92) || '#'), '_', chr(92) || '_'), '~', chr(92) || 'textasciitilde{}') AS url FROM pages")
def latex_escaped(t: Tables) -> DataFrame:
    """Addresses as LaTeX takes them."""
    return t.pages.select("page_id", S.latex_escaped(F.col("url")).alias("url"))


@query(
    "cell_spans",
    """
WITH c AS (SELECT DISTINCT l_orderkey, l_linestatus, l_linenumber, min(l_returnflag) OVER (PARTITION BY l_orderkey, l_linestatus, l_linenumber) AS v FROM lineitem),
n AS (SELECT *, (lag(l_linenumber) OVER w IS NULL OR v IS DISTINCT FROM lag(v) OVER w OR lag(l_linenumber) OVER w <> l_linenumber - 1)::INTEGER AS new FROM c WINDOW w AS (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber)),
p AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS part FROM n)
SELECT l_orderkey, l_linestatus, min(l_linenumber) AS l_linenumber, count(*) AS span, any_value(v) AS v FROM p GROUP BY l_orderkey, l_linestatus, part
""",
)
def cell_spans(t: Tables) -> DataFrame:
    """Neighbouring cells of one value as one."""
    cells = t.lineitem.groupBy("l_orderkey", "l_linestatus", "l_linenumber").agg(F.min("l_returnflag").alias("v"))
    return S.cell_spans(cells, ["l_orderkey"], "l_linestatus", "l_linenumber", "v")


@query(
    "front_matter",
    rf"""
WITH {_LINES}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k, regexp_extract_all(lower(text), '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS e FROM l WHERE text <> ''),
f AS (SELECT doc_id, flatten(list(e) FILTER (k <= 12)) AS a, flatten(list(e)) AS b, count(*) AS n_blocks FROM k GROUP BY doc_id)
SELECT doc_id, array_to_string(list_sort(list_distinct(CASE WHEN len(a) > 0 THEN a ELSE b END)), ',') AS emails, CASE WHEN len(a) > 0 THEN 'front' WHEN len(b) > 0 THEN 'anywhere' ELSE 'none' END AS "where", n_blocks FROM f
""",
)
def front_matter(t: Tables) -> DataFrame:
    """Addresses of a document's front, else of all of it."""
    return S.front_matter(_lines(t)).withColumn("emails", F.array_join("emails", ","))


@query(
    "label_tables",
    "WITH l AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN '(' || l_linenumber::VARCHAR || ')' ELSE l_returnflag END AS last, l_linenumber, l_partkey FROM lineitem) SELECT l_orderkey, coalesce(string_agg(last, ',' ORDER BY l_linenumber, l_partkey) FILTER (regexp_matches(last, '^\\(\\d+\\)$')), '') AS labels, (count(*) FILTER (NOT regexp_matches(last, '^\\(\\d+\\)$')))::INTEGER AS data FROM l GROUP BY l_orderkey",
)
def label_tables(t: Tables) -> DataFrame:
    """Tables that only hold an equation and its number, apart from those of data."""
    last = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("("), F.col("l_linenumber").cast("string"), F.lit(")"))).otherwise(F.col("l_returnflag"))
    cells = F.array(F.lit("x"), last)
    tables = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", cells.alias("c")))), lambda r: r["c"])
    got = t.lineitem.groupBy("l_orderkey").agg(tables.alias("t")).select("l_orderkey", S.label_tables(F.col("t")).alias("s"))
    return got.select("l_orderkey", F.array_join("s.labels", ",").alias("labels"), F.col("s.data").alias("data"))


@query(
    "scanned_parts",
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS place FROM documents),
b AS (SELECT doc_id, place, CASE WHEN length(trim(t)) >= 60 THEN 'paragraph' WHEN regexp_matches(t, '^[A-E]') THEN 'abstract_heading' WHEN regexp_matches(t, '^[R-S]') THEN 'references_heading' WHEN contains(t, ',') THEN 'keywords' ELSE 'section' END AS role FROM l),
f AS (SELECT *,
  coalesce(last_value(CASE WHEN role = 'abstract_heading' THEN true WHEN role <> 'paragraph' THEN false END IGNORE NULLS) OVER w, false) AS abstract_open,
  coalesce(last_value(CASE WHEN role = 'references_heading' THEN true WHEN role = 'section' THEN false END IGNORE NULLS) OVER w, false) AS references_open
  FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT *, CASE WHEN role = 'paragraph' AND references_open THEN 'reference' WHEN role = 'paragraph' AND abstract_open THEN 'abstract' ELSE role END AS part FROM f
""",
)
def scanned_parts(t: Tables) -> DataFrame:
    """Lines as blocks: short ones are headings of an abstract, of references, keywords or sections, and each line's part follows
    from those before it, by an automaton whose moves are composed in chunks."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "t"))
    role = F.when(F.length(F.trim("t")) >= 60, "paragraph").when(F.col("t").rlike("^[A-E]"), "abstract_heading").when(F.col("t").rlike("^[R-S]"), "references_heading").when(F.contains("t", F.lit(",")), "keywords").otherwise("section")
    return automata.open_parts(lines.select("doc_id", "place", role.alias("role")))


@query(
    "syntax_trees",
    r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM conversations),
w AS (SELECT conv_id, turn, place, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS k FROM l)
SELECT conv_id, (1 + count(DISTINCT turn) + count(DISTINCT (turn, place)) + count(*))::BIGINT AS nodes, 3 AS depth, 0::BIGINT AS links, md5(string_agg(word, ' ' ORDER BY turn, place, k)) AS digest FROM w GROUP BY conv_id
""",
)
def syntax_trees(t: Tables) -> DataFrame:
    """Conversations as syntax trees in JSON (turns, lines, words), walked to their leaves."""
    word = lambda w: F.struct(F.lit("Str").alias("t"), w.alias("c"))
    line = lambda x: F.struct(F.lit("Para").alias("t"), F.transform(F.split(x, " "), word).alias("c"))
    turn = F.struct(F.col("turn").alias("n"), F.lit("Div").alias("t"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line).alias("c"))
    given = t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.lit("Doc").alias("t"), F.array_sort(F.collect_list(turn)).alias("c"))).alias("ast"))
    return trees.outline(trees.walk(given, "conv_id", "ast"), "conv_id")
