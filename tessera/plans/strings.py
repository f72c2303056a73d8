"""String queries: names of parts and keys, made into words, numbers and identifiers by expressions alike in both forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrow as A
from tessera.functions import text as X
from tessera.ship import ship

from .query import Tables, query

_ENDS = ("ами", "ого", "ение", "ы", "")
_WORD = "split_part(p_name, ' ', 1) || [" + ", ".join(f"'{e}'" for e in _ENDS) + "][1 + p_partkey % 5]"
_CASES = " ".join(f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 4 THEN left(w, length(w) - {len(e)})" for e in X.ENDINGS)


@query("stemmed", f"WITH w AS (SELECT p_partkey, {_WORD} AS w FROM part) SELECT p_partkey, CASE {_CASES} ELSE w END AS stem FROM w")
def stemmed(t: Tables) -> DataFrame:
    """Words less their first listed ending."""
    word = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.get(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % 5).cast("int")))
    return t.part.select("p_partkey", X.stem(word).alias("stem"))


def _nested(s: str) -> str:
    for a, b in X.TRANSLIT.items():
        s = f"replace({s}, '{a}', '{b}')"
    return s


_CYRILLIC = ("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшюыз")


@query("transliterated", f"SELECT p_partkey, {_nested(f'''translate(lower(p_name), '{_CYRILLIC[0]}', '{_CYRILLIC[1]}')''')} AS latin FROM part")
def transliterated(t: Tables) -> DataFrame:
    """Cyrillic words in Latin letters."""
    return t.part.select("p_partkey", X.transliterate(F.translate(F.lower("p_name"), *_CYRILLIC)).alias("latin"))


@query(
    "issn_numbers",
    "WITH s AS (SELECT o_orderkey, 'ISSN ' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '-' END || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE (o_orderkey % 10)::VARCHAR END || CASE WHEN o_orderkey % 7 = 0 THEN '5' ELSE ', next' END AS s FROM orders), m AS (SELECT o_orderkey, unnest(regexp_extract_all(upper(s), '[0-9]{4}-?[0-9]{3}[0-9X][0-9]?')) AS m FROM s) SELECT o_orderkey, left(m, 4) || '-' || right(m, 4) AS issn FROM m WHERE regexp_matches(m, '^[0-9]{4}-?[0-9]{3}[0-9X]$')",
)
def issn_numbers(t: Tables) -> DataFrame:
    """Serial numbers in texts, with digits on neither side."""
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("ISSN "), F.lpad((k % 10000).cast("string"), 4, "0"), F.when(k % 3 == 0, "").otherwise("-"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"),
        F.when(k % 4 == 0, "x").otherwise((k % 10).cast("string")), F.when(k % 7 == 0, "5").otherwise(", next"),
    )
    return t.orders.select("o_orderkey", F.explode(X.issn(text)).alias("issn"))


@query(
    "orcid_checks",
    "WITH s AS (SELECT c_custkey, lpad((c_custkey * 7919)::VARCHAR, 15, '0') AS d, ['0','1','2','3','4','5','6','7','8','9','X'][1 + c_custkey % 11] AS c FROM customer), v AS (SELECT c_custkey, d || c AS orcid, (12 - list_reduce(list_prepend(0, list_transform(string_split(d, ''), lambda x: x::INTEGER)), lambda a, x: (a + x) * 2 % 11)) % 11 AS r, c FROM s) SELECT c_custkey, orcid, c = CASE WHEN r = 10 THEN 'X' ELSE r::VARCHAR END AS valid FROM v",
)
def orcid_checks(t: Tables) -> DataFrame:
    """Identifiers with their check digit."""
    k = F.col("c_custkey")
    orcid = F.concat(F.lpad((k * 7919).cast("string"), 15, "0"), F.substring(F.lit("0123456789X"), (1 + k % 11).cast("int"), F.lit(1)))
    return t.customer.select("c_custkey", orcid.alias("orcid")).withColumn("valid", X.orcid_valid(F.col("orcid")))


@query("shortened", "SELECT p_partkey, CASE WHEN length(p_type) > 14 THEN rtrim(left(p_type, 13)) || '…' ELSE p_type END AS label FROM part")
def shortened(t: Tables) -> DataFrame:
    """Labels of fourteen characters at most."""
    return t.part.select("p_partkey", X.shorten(F.col("p_type"), 14).alias("label"))


@query("folded_names", "SELECT p_partkey, lower(p_type) || 'ss 1' AS name FROM part")
def folded_names(t: Tables) -> DataFrame:
    """Compatibility forms and case folded away."""
    ship(t.spark)
    return t.part.select("p_partkey", A.folded(F.concat("p_type", F.lit("ß １"))).alias("name"))


@query(
    "merged_rules",
    "WITH r AS (SELECT p_partkey, json_merge_patch('{\"size\": ' || p_size || ', \"font\": {\"name\": \"' || p_brand || '\", \"bold\": false}}', CASE WHEN p_partkey % 3 = 0 THEN '{\"font\": {\"bold\": true}, \"page\": 4}' ELSE '{\"size\": 99}' END) AS j FROM part) SELECT p_partkey, (j ->> '$.size')::INTEGER AS size, j ->> '$.font.name' AS font, j ->> '$.font.bold' AS bold, (j ->> '$.page')::INTEGER AS page FROM r",
)
def merged_rules(t: Tables) -> DataFrame:
    """Rules in JSON under an override, merged in depth."""
    ship(t.spark)
    base = F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit(', "font": {"name": "'), F.col("p_brand"), F.lit('", "bold": false}}'))
    over = F.when(F.col("p_partkey") % 3 == 0, '{"font": {"bold": true, "name": ""}, "page": 4}').otherwise('{"size": 99, "font": null}')
    j = t.part.select("p_partkey", A.merged_json(base, over).alias("j"))
    get = lambda path: F.get_json_object("j", path)
    return j.select("p_partkey", get("$.size").cast("int").alias("size"), get("$.font.name").alias("font"), get("$.font.bold").alias("bold"), get("$.page").cast("int").alias("page"))
