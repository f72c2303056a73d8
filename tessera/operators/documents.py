"""Document structure: chunks, claims, citations, sections, captions, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

MAX_CHARS, LEAST_CHARS, LEAST_PARAGRAPH = 1250, 60, 40


def packed(sentences: Column, most: int = MAX_CHARS, least: int = LEAST_CHARS) -> Column:
    """Sentences packed into chunks of at most ``most`` characters; each begins with the last sentence of the one before."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("now"), F.lit(0).alias("size"))
    joined = lambda xs: F.array_join(xs, " ")

    def add(acc: Column, s: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (acc["size"] + F.length(s) + 1 > most)
        last = F.element_at(acc["now"], -1)
        return F.when(
            full,
            F.struct(F.array_append(acc["done"], joined(acc["now"])).alias("done"), F.array(last, s).alias("now"), (F.length(last) + F.length(s) + 2).alias("size")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.array_append(acc["now"], s).alias("now"), (acc["size"] + F.length(s) + 1).alias("size")))

    end = lambda acc: F.filter(F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], joined(acc["now"]))).otherwise(acc["done"]), lambda c: F.length(c) >= least)
    return F.aggregate(sentences, start, add, end)


def sentence_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, chunk): paragraphs of 40 characters or more, cut into sentences and packed."""
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"[\r\n]+"), X.squeeze), lambda p: F.length(p) >= LEAST_PARAGRAPH)
    cut = F.filter(F.transform(F.flatten(F.transform(paragraphs, X.sentences)), lambda s: F.trim(s)), lambda s: s != "")
    all_ = F.when(F.size(cut) > 0, cut).otherwise(F.array(X.squeeze(F.col(text))))
    return docs.select(key, all_.alias("_s")).select(key, F.posexplode(packed(F.col("_s"))).alias("place", "chunk"))


def without_references(s: Column, heading: str = r"(?iu)\b(?:references|bibliography|список литературы)\b", share: float = 0.35) -> Column:
    """The text up to the first reference heading past ``share`` of its length."""
    tail = F.substring(s, F.ceil(F.length(s) * share).cast("int") + 1, F.length(s))
    head = F.regexp_instr(tail, F.lit(heading))
    return F.when(head > 0, F.rtrim(F.substring(s, F.lit(1), F.ceil(F.length(s) * share).cast("int") + head - 1))).otherwise(s)


def citation_numbers(group: Column, most: Column, widest: int = 50) -> Column:
    """The numbers of one bracketed group, ranges expanded, in first-seen order; empty if any part is out of bounds."""
    parts = F.filter(F.split(F.translate(group, "–— ", "--"), "[,;]"), lambda p: p != "")
    ends = lambda p: F.transform(F.split(p, "-"), lambda x: x.try_cast("int"))

    def numbers(p: Column) -> Column:
        return X.let(ends(p), lambda e: F.when((F.element_at(e, 1) <= F.element_at(e, -1)) & (F.element_at(e, -1) - F.element_at(e, 1) <= widest) & (F.size(e) <= 2), F.sequence(F.element_at(e, 1), F.element_at(e, -1))))

    expanded = F.transform(parts, numbers)
    flat = F.array_distinct(F.flatten(expanded))
    fine = (F.size(parts) > 0) & F.forall(expanded, lambda x: x.isNotNull()) & F.forall(flat, lambda n: (n >= 1) & (n <= most))
    return F.when(F.coalesce(fine, F.lit(False)), flat).otherwise(F.array().cast("array<int>"))


CITATION = r"\[(\s*\d+(?:\s*[,;–—-]\s*\d+)*)\]"


def citations(blocks: DataFrame, references: Column) -> DataFrame:
    """``blocks`` with ``cited``: the reference numbers of all groups, in order of first mention."""
    groups = F.regexp_extract_all("text", F.lit(CITATION), F.lit(1))
    return blocks.withColumn("cited", F.array_distinct(F.flatten(F.transform(groups, lambda g: citation_numbers(g, references)))))


def reference_gaps(cited: Column, available: Column) -> Column:
    """Cited without a reference, and references never cited."""
    return F.struct(F.array_sort(F.array_except(cited, available)).alias("unknown"), F.array_sort(F.array_except(available, cited)).alias("uncited"))


# Cues of a claim's type, in order of precedence.
CUES = {
    "method": ("method", "model", "algorithm", "approach", "метод", "алгоритм", "модель", "подход"),
    "data": ("data", "sample", "corpus", "данн", "выборк", "корпус"),
    "task": ("task", "problem", "challenge", "задач", "проблем", "цель"),
    "result": ("result", "improv", "demonstrat", "результат", "показал", "повышает"),
}


def claim_type(s: Column, cues: dict[str, tuple[str, ...]] = CUES) -> Column:
    """The type with the most cues; of equal ones the first; ``topic`` without any."""
    low = F.lower(s)
    hits = {k: sum((F.contains(low, F.lit(c)).cast("int") for c in v), F.lit(0)) for k, v in cues.items()}
    most = F.greatest(*hits.values())
    out = F.lit("topic")
    for k in reversed(list(hits)):
        out = F.when((hits[k] == most) & (most > 0), k).otherwise(out)
    return out


def claims(docs: DataFrame, most: int, cues: dict[str, tuple[str, ...]] = CUES, evidence: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """(key, paragraph, place, type, priority, text): sentences that may need a source, the ``most`` best of each document."""
    from pyspark.sql import Window

    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    s = lines.select(key, "paragraph", F.posexplode(X.sentences(F.col("line"))).alias("place", "s")).select(key, "paragraph", "place", F.trim("s").alias("text"))
    s = s.where(F.length("text").between(55, 650) & ~F.col("text").rlike(CITATION))
    typed = s.withColumn("type", claim_type(F.col("text"), cues))
    low = F.lower("text")
    cue = F.lit(False)
    for e in evidence:
        cue = cue | F.contains(low, F.lit(e))
    priority = F.when(cue, 3).otherwise(0) + F.when(F.col("type").isin("method", "data", "task"), 2).otherwise(1) + F.when(F.col("text").rlike(r"\d+(?:[.,]\d+)?\s*%"), 2).otherwise(0)
    order = Window.partitionBy(key).orderBy(F.desc("priority"), "paragraph", "place")
    return typed.withColumn("priority", priority).where("priority >= 2").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def card(html: Column, tag: str) -> Column:
    """The text of a tag's first element: tags stripped, white space squeezed; null where there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(inner, "(?s)<[^>]*>", " "), r"\s+", " "))
    return F.when(plain != "", plain)


def caption_issues(blocks: DataFrame, key: str, pattern: str = r"(?iu)^(fig(?:ure)?|table|рис(?:унок)?|табл(?:ица)?)\.?\s*(\d+)") -> DataFrame:
    """(key, kind, missing): numbers between 1 and the last caption's that no caption has."""
    found = blocks.select(key, F.lower(F.regexp_extract("text", pattern, 1)).alias("kind"), F.regexp_extract("text", pattern, 2).try_cast("int").alias("n")).where("n is not null")
    by = found.groupBy(key, "kind").agg(F.max("n").alias("last"), F.collect_set("n").alias("have"))
    return by.select(key, "kind", F.array_except(F.sequence(F.lit(1), F.col("last")), "have").alias("missing")).where(F.size("missing") > 0)
