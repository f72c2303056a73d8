"""Structure of a document from its ordered blocks: sections, entries, open parts, labels, titles, roles, integrity.

A block is a row with its document's ``key``, its ``place`` in it and its ``text``.  What depends on earlier blocks is a
window over one document; nothing gathers a document into one row but ``contents`` and ``entries``, whose result is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, text): a text's lines as blocks."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("place", "text")).withColumn("text", F.trim("text"))


def _upto(key: str, last: int = 0) -> Window:
    return Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, last)


def islands(blocks: DataFrame, starts: Column, key: str = "doc_id", name: str = "part") -> DataFrame:
    """``blocks`` with the number of the part that each lies in; blocks before the first start lie in part 0."""
    return blocks.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(_upto(key)).cast("int"))


def _joined(by: str, sep: str, keep: Column | None = None) -> Column:
    """The texts of a group in order."""
    row = F.struct("place", F.col(by).alias("t"))
    rows = F.array_sort(F.collect_list(row if keep is None else F.when(keep, row)))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)


def contents(blocks: DataFrame, heading: Column, key: str = "doc_id") -> DataFrame:
    """(key, part, heading, n_blocks, content): each heading with the blocks up to the next one; empty blocks don't count."""
    rows = islands(blocks.withColumn("_h", heading), F.col("_h"), key).where("part > 0")
    full = ~F.col("_h") & (F.col("text") != "")
    return rows.groupBy(key, "part").agg(F.max(F.when(F.col("_h"), F.col("text"))).alias("heading"), F.count_if(full).alias("n_blocks"), _joined("text", "\n", full).alias("content"))


#: A numbered entry's beginning.
ENTRY = r"^\s*(?:\[\s*(\d+)\s*\]|(\d+)[.)])"


def entries(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, part, number, n_blocks, entry): numbered entries, each with the lines that continue it; a document without any
    number has one entry a line."""
    number = F.coalesce(F.nullif(F.regexp_extract("text", ENTRY, 1), F.lit("")), F.nullif(F.regexp_extract("text", ENTRY, 2), F.lit(""))).cast("int")
    rows = blocks.where("text <> ''").withColumn("_n", number)
    any_ = F.count("_n").over(Window.partitionBy(key)) > 0
    first = F.row_number().over(Window.partitionBy(key).orderBy("place")) == 1
    rows = islands(rows.withColumn("_s", F.col("_n").isNotNull() | ~any_ | first), F.col("_s"), key)
    return rows.groupBy(key, "part").agg(F.min_by("_n", "place").alias("number"), F.count("*").alias("n_blocks"), _joined("text", " ").alias("entry"))


def open_part(blocks: DataFrame, marker: Column, key: str = "doc_id", name: str = "open") -> DataFrame:
    """``blocks`` with the last marker before each: a part stays open until another marker comes."""
    return blocks.withColumn("_m", marker).withColumn(name, F.last("_m", ignorenulls=True).over(_upto(key, -1))).withColumnRenamed("_m", "marker")


def labelled(blocks: DataFrame, label: Column, stop: Column, key: str = "doc_id") -> DataFrame:
    """(key, part, value, n_blocks): a label's block and those after it, up to the next label or stop."""
    rows = islands(blocks.withColumns({"_l": label, "_e": stop}), F.col("_l") | F.col("_e"), key).where("part > 0")
    got = rows.groupBy(key, "part").agg(F.min_by("_l", "place").alias("_l"), F.count_if(F.col("text") != "").alias("n_blocks"), _joined("text", " ", F.col("text") != "").alias("value"))
    return got.where("_l").select(key, "part", "value", "n_blocks")


def first_section(blocks: DataFrame, aliases: list[str], prefix: str, key: str = "doc_id") -> DataFrame:
    """(key, place, text): the first block whose normalised text is an alias or begins with the prefix."""
    plain = X.normalise(F.col("text"), keep_punctuation=False)
    return blocks.where(plain.isin(aliases) | plain.startswith(prefix)).groupBy(key).agg(F.min("place").alias("place"), F.min_by("text", "place").alias("text"))


def title(blocks: DataFrame, byline: Column, key: str = "doc_id", window: int = 12) -> DataFrame:
    """(key, place, text, score): the likeliest title of the first ``window`` full blocks.

    A block of 15 to 200 characters scores 3, one without a final stop 2, and 4 more where a byline follows within two
    blocks; each place costs a half.  Of equal scores the first wins.
    """
    order = Window.partitionBy(key).orderBy("place")
    rows = blocks.where("text <> ''").withColumn("_b", byline).withColumn("_k", F.row_number().over(order))
    near = F.coalesce(F.lead("_b", 1).over(order), F.lit(False)) | F.coalesce(F.lead("_b", 2).over(order), F.lit(False))
    score = F.when(F.length("text").between(15, 200), 3.0).otherwise(0.0) + F.when(~F.col("text").endswith("."), 2.0).otherwise(0.0) + F.when(near, 4.0).otherwise(0.0) - 0.5 * (F.col("_k") - 1)
    rows = rows.withColumn("score", score).where(F.col("_k") <= window)
    return rows.groupBy(key).agg(F.max_by(F.struct("place", "text", "score"), F.struct("score", -F.col("place"))).alias("b")).select(key, "b.*")


#: (role, confidence) by rules in order; the first that fits decides.
def block_roles(blocks: DataFrame, rules: list[tuple[Column, str, float]], key: str = "doc_id") -> DataFrame:
    """``blocks`` with ``role`` and ``confidence``; without a rule that fits, a paragraph at 0.92."""
    role, sure = F.lit("paragraph"), F.lit(0.92)
    for fits, name, confidence in reversed(rules):
        role, sure = F.when(fits, name).otherwise(role), F.when(fits, confidence).otherwise(sure)
    return blocks.withColumns({"role": role, "confidence": sure})


def decided(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rule decisions (role, confidence) merged with a model's (model_role, model_confidence, null: none).

    A model's answer under 0.58 counts for nothing, and none overrules a rule of 0.97; where it agrees it may be 0.1 less
    sure, else it must be 0.04 surer and 0.70 at least.  Of several titles the surest, then first, stays; the others are
    subtitles among the first twenty blocks and paragraphs later.
    """
    same, sure, model = F.col("model_role") == F.col("role"), F.col("confidence"), F.col("model_confidence")
    taken = F.coalesce((model >= 0.58) & F.when(same, model >= sure - 0.1).otherwise((sure < 0.97) & (model >= F.greatest(F.lit(0.70), sure + 0.04))), F.lit(False))
    rows = blocks.withColumns({"final": F.when(taken, F.col("model_role")).otherwise(F.col("role")), "sureness": F.when(taken, model).otherwise(sure), "source": F.when(taken, "model").otherwise("rules")})
    best = F.row_number().over(Window.partitionBy(key, F.col("final") == "title").orderBy(F.desc("sureness"), "place"))
    lowered = (F.col("final") == "title") & (F.col("_k") > 1)
    return rows.withColumn("_k", best).withColumn("final", F.when(lowered & (F.col("place") < 20), "subtitle").when(lowered, "paragraph").otherwise(F.col("final"))).drop("_k")


def question_batches(blocks: DataFrame, wanted: Column, size: int, front: int = 35, key: str = "doc_id") -> DataFrame:
    """(key, place, batch): blocks for a model, of the first ``front`` or wanted, in batches of ``size`` a document."""
    order = Window.partitionBy(key).orderBy("place")
    chosen = blocks.withColumn("_k", F.row_number().over(order)).where(wanted | (F.col("_k") <= front))
    return chosen.select(key, "place", F.floor((F.row_number().over(order) - 1) / size).cast("int").alias("batch"))


def language_before(blocks: DataFrame, cut: Column, key: str = "doc_id") -> DataFrame:
    """(key, language, n_blocks): the script's language of the blocks before the first cut."""
    rows = islands(blocks, cut, key).where("part = 0")
    got = rows.groupBy(key).agg(F.count("*").alias("n_blocks"), F.sum(X.count_of(F.col("text"), r"\p{IsCyrillic}")).alias("c"), F.sum(X.count_of(F.col("text"), "[A-Za-z]")).alias("l"))
    language = F.when((F.col("c") >= 12) & (F.col("c") > 1.2 * F.col("l")), "ru").when((F.col("l") >= 12) & (F.col("l") > 1.2 * F.col("c")), "en").when(F.col("c") + F.col("l") == 0, "unknown").otherwise("mixed")
    return got.select(key, language.alias("language"), "n_blocks")


def caption_numbers(blocks: DataFrame, word: str, key: str = "doc_id") -> DataFrame:
    """(key, numbers, mentioned): the numbers of a document's captions, and those that other blocks mention."""
    own = F.nullif(F.regexp_extract("text", rf"(?i)^{word}\.?\s*(\d+)", 1), F.lit("")).cast("int")
    other = F.when(own.isNull(), F.transform(F.regexp_extract_all("text", F.lit(rf"(?i){word}\.?\s*(\d+)"), F.lit(1)), lambda n: n.cast("int")))
    return blocks.groupBy(key).agg(F.array_sort(F.collect_set(own)).alias("numbers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(other)))).alias("mentioned"))


def integrity_issues(docs: DataFrame, checks: list[tuple[str, str, Column]], key: str = "doc_id") -> DataFrame:
    """(key, code, severity): one row for each (code, severity, condition) that holds; a null condition holds not."""
    rows = F.filter(F.array(*[F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, condition in checks]), lambda x: x.isNotNull())
    return docs.select(key, F.explode(rows).alias("i")).select(key, "i.*")


def surname(name: Column) -> Column:
    """The part of a person's name that is the surname: one in capitals, else the one before initials or a patronymic, else
    the last."""
    words = F.split(F.trim(name), r"\s+")
    capitals = F.filter(words, lambda w: w.rlike(r"^\p{Lu}{2,}(?:-\p{Lu}{2,})?$"))
    initials = F.filter(words, lambda w: w.rlike(r"^(?:\p{Lu}\.)+$"))
    full = F.filter(words, lambda w: ~w.rlike(r"^(?:\p{Lu}\.)+$"))
    patronymic = F.element_at(words, -1).rlike(r"(?u)(?:вич|вна|ична|ovich|evich|ovna|evna)$") & (F.size(words) == 3)
    return F.when(F.size(capitals) > 0, F.element_at(capitals, 1)).when((F.size(initials) > 0) & (F.size(full) > 0), F.element_at(full, 1)).when(patronymic, F.element_at(words, 1)).otherwise(F.element_at(words, -1))


def json_answer(s: Column, schema: str) -> Column:
    """The fields of the JSON object that a text holds somewhere, between its first and last brace; null where there is none
    or it is broken."""
    return F.from_json(F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit("")), schema)


def people_by_unit(rows: DataFrame, unit: str, name: str, source: str) -> DataFrame:
    """(unit, person, sources): each unit's people by normalised name, with their sorted distinct sources."""
    return rows.groupBy(unit, X.normalise(F.col(name)).alias("person")).agg(F.array_sort(F.collect_set(source)).alias("sources"))


# Characters that LaTeX reads as commands, and their escaped forms.
ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escaped(s: Column) -> Column:
    """A text with LaTeX's characters escaped, each looked at once."""
    table = F.create_map(*[F.lit(x) for w in ESCAPES.items() for x in w])
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def cell_spans(cells: DataFrame, by: list[str], row: str, column: str, value: str) -> DataFrame:
    """(by..., row, column, span, value): neighbouring cells of a row with one value are one cell that spans them."""
    order = Window.partitionBy(*by, row).orderBy(column)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(order)) | (F.lag(column).over(order) != F.col(column) - 1) | F.lag(column).over(order).isNull()
    rows = cells.withColumn("_p", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, row, "_p").agg(F.min(column).alias(column), F.count("*").alias("span"), F.first(value).alias(value)).drop("_p")


def front_matter(blocks: DataFrame, key: str = "doc_id", window: int = 12) -> DataFrame:
    """(key, emails, where, n_blocks): a document's e-mail addresses in its first blocks, else in all of them."""
    found = blocks.where("text <> ''").withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("place")))
    found = found.withColumn("_e", F.regexp_extract_all(F.lower("text"), F.lit(X.EMAIL.replace("(\\.", "(?:\\.")), F.lit(0)))
    both = found.groupBy(key).agg(F.flatten(F.collect_list(F.when(F.col("_k") <= window, F.col("_e")))).alias("_a"), F.flatten(F.collect_list("_e")).alias("_b"), F.count("*").alias("n_blocks"))
    tidy = lambda c: F.array_sort(F.array_distinct(c))
    return both.select(key, F.when(F.size("_a") > 0, tidy("_a")).otherwise(tidy("_b")).alias("emails"), F.when(F.size("_a") > 0, "front").when(F.size("_b") > 0, "anywhere").otherwise("none").alias("where"), "n_blocks")


def label_tables(tables: Column, pattern: str = r"^\(\d+\)$") -> Column:
    """(labels, data) of tables as arrays of cells: those whose last cell is an equation's number, and the others."""
    labelled_ = lambda t: F.element_at(t, -1).rlike(pattern)
    return F.struct(F.transform(F.filter(tables, labelled_), lambda t: F.element_at(t, -1)).alias("labels"), F.size(F.filter(tables, lambda t: ~labelled_(t))).alias("data"))
