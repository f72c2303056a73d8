"""Plans from free text: items, kinds, quantities; people and topics resolved to those on record."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.shared import checkpointed
from tessera.ship import ship


def kinds(s: Column, patterns: dict[str, str], conflicts: list[tuple[str, str, Column | None]] = (), fallbacks: dict[str, str] | None = None) -> Column:
    """All kinds whose pattern a text matches, in the given order.

    ``conflicts``: (kept, dropped, unless): where both kinds are there the second goes, unless the condition holds; they
    are applied in order.  Without a kind, the first fallback that matches, else ``other``.
    """
    found = F.filter(F.array(*[F.when(s.rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda k: k.isNotNull())
    for kept, dropped, unless in conflicts:

        def settle(a: Column, kept=kept, dropped=dropped, unless=unless) -> Column:
            both = F.array_contains(a, F.lit(kept)) & F.array_contains(a, F.lit(dropped))
            return F.when(both & ~(F.coalesce(unless, F.lit(False)) if unless is not None else F.lit(False)), F.array_remove(a, F.lit(dropped))).otherwise(a)

        found = settle(found)
    last = F.lit("other")
    for k, p in reversed((fallbacks or {}).items()):
        last = F.when(s.rlike(p), k).otherwise(last)
    return F.when(F.size(found) > 0, found).otherwise(F.array(last))


def quantity(s: Column, noun: str, words: dict[str, int], most: int = 50, listed: str | None = None) -> Column:
    """The sum of the numbers before a noun, as digits or words; where there is none and the text begins with the heading
    ``listed``, its entries between semicolons; 1 where nothing is said or the result is out of bounds."""
    low = F.lower(s)
    number = "|".join([r"\d{1,6}", *words])
    found = F.regexp_extract_all(low, F.lit(rf"(?u)\b({number})\s+(?:{noun})"), F.lit(1))
    table = F.create_map(*[F.lit(x) for w in words.items() for x in w]) if words else None
    value = (lambda v: F.coalesce(v.try_cast("int"), F.try_element_at(table, v), F.lit(1))) if words else (lambda v: v.try_cast("int"))
    total = F.aggregate(F.transform(found, value), F.lit(0), lambda a, x: a + x)
    fine = lambda n: F.when(n.between(1, most), n).otherwise(1)
    parts = F.size(F.filter(F.split(s, ";"), lambda p: p.rlike(r"\p{L}"))) if listed else F.lit(1)
    heads = low.rlike(listed) & F.contains(s, F.lit(";")) if listed else F.lit(False)
    return F.when(F.size(found) > 0, fine(total)).when(heads, fine(parts)).otherwise(1)


def items(rows: DataFrame, typed: Column, key: str, text: str = "text", piece: str = "piece") -> DataFrame:
    """(key, item, text): a text's pieces between semicolons and line ends; a piece without a kind of its own, by ``typed``
    on the column ``piece``, belongs to the one before."""
    trimmed = F.filter(F.transform(F.split(F.col(text), r"[;\n]+"), lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"^[ \-\t]+|[ \-\t]+$", "")), lambda p: p != "")
    order = Window.partitionBy(key).orderBy("_p")
    pieces = rows.select(key, F.posexplode(trimmed).alias("_p", piece))
    begins = F.coalesce(typed & F.col(piece).rlike(r"\p{L}"), F.lit(False)) | (F.col("_p") == 0)
    numbered = pieces.withColumn("item", F.sum(F.when(begins, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(piece).alias("t")))), lambda r: r["t"]), "; ")
    return numbered.groupBy(key, "item").agg(joined.alias("text"))


def reclassified(stored: DataFrame, key: str, old: str, new: Column) -> DataFrame:
    """(key, action): what running a classifier again would do: rows that are no item any more are deleted, others updated."""
    rows = stored.withColumn("_new", new)
    return rows.select(key, F.when(F.col("_new").isNull(), "delete").when(F.col("_new") != F.col(old), "update").otherwise("keep").alias("action"), F.col(old).alias("was"), F.col("_new").alias("now"))


def keyword_topics(docs: DataFrame, keywords: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, topic, score, confidence): the topic whose keywords (topic, keyword, place) a text holds most: 3 for a phrase, 1
    for a word; of equal ones the first place.  Keywords are few, and are looked for in each text in one pass."""
    rows = [r for r in keywords.orderBy("place", "keyword").collect()]  # a keyword table: few rows
    low = X.normalise(F.col(text))
    scores: dict[str, Column] = {}
    for r in rows:
        hit = F.when(F.contains(low, F.lit(r["keyword"])), 3 if " " in r["keyword"] else 1).otherwise(0)
        scores[r["topic"]] = scores[r["topic"]] + hit if r["topic"] in scores else hit
    entries = F.array(*[F.struct(c.cast("int").alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("topic")) for i, (k, c) in enumerate(scores.items())])
    best = docs.select(key, F.array_max(entries).alias("b")).where("b.score > 0")
    return best.select(key, "b.topic", "b.score", F.least(F.lit(85), 35 + 8 * F.col("b.score")).alias("confidence"))


def translated(terms: Column, dictionary: dict[str, str], context: Column, most: int = 12) -> Column:
    """The dictionary's words for a text's terms, each once, the first ``most``, and the context's words."""
    table = F.create_map(*[F.lit(x) for w in dictionary.items() for x in w])
    known = F.array_distinct(F.filter(F.transform(terms, lambda t: F.try_element_at(table, t)), lambda t: t.isNotNull()))
    return F.concat_ws(" ", F.slice(known, 1, most), context)


def joined_parts(*parts: Column, sep: str = "; ") -> Column:
    """Non-empty parts in order, each once."""
    return F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != ""))), sep)


def level_of(rows: DataFrame, levels: DataFrame, key: str, stored: str, name: str) -> DataFrame:
    """(key, level, step): the stored level, else that of the same name key, else that of the first (least) name that the row's
    name holds.  ``levels``: (name_key, level), few rows."""
    rows = rows.withColumn("_k", X.key_of(F.col(name)))
    exact = rows.where(F.col(stored).isNull()).join(levels, F.col("_k") == F.col("name_key")).groupBy(key).agg(F.min("level").alias("exact"))
    held = rows.where(F.col(stored).isNull()).join(levels, F.contains(F.col("_k"), F.col("name_key"))).groupBy(key).agg(F.min_by("level", "name_key").alias("held"))  # a catalogue of levels
    step = F.when(F.col(stored).isNotNull(), 1).when(F.col("exact").isNotNull(), 2).when(F.col("held").isNotNull(), 3).otherwise(0)
    return rows.join(exact, key, "left").join(held, key, "left").select(key, F.coalesce(stored, "exact", "held").alias("level"), step.alias("step"))


def staff_match(entries: DataFrame, users: DataFrame, key: str, external: str, name: str) -> DataFrame:
    """(key, user_id, action): an entry's user by external id, else by full name where one user has it; else it is created."""
    by_id = users.where(F.col(external).isNotNull()).groupBy(external).agg(F.min("user_id").alias("_a"))
    by_name = users.groupBy(X.normalise(F.col(name)).alias("_n")).agg(F.min("user_id").alias("_b"), F.count("*").alias("_c")).where("_c = 1")
    both = entries.withColumn("_n", X.normalise(F.col(name))).join(by_id, external, "left").join(by_name, "_n", "left")
    return both.select(key, F.coalesce("_a", "_b").alias("user_id"), F.when(F.col("_a").isNotNull(), "id").when(F.col("_b").isNotNull(), "name").otherwise("create").alias("action"))


def canonical(rows: DataFrame, key: str = "id", pointer: str = "merged_into") -> DataFrame:
    """(key, target): the row at the end of each row's chain of merge pointers, which halves each round; a pointer that leads
    nowhere counts as none, and rows of a circle, or that lead into one, get its least member."""
    ids = rows.select(F.col(key).alias("i"))
    now = rows.select(F.col(key).alias("k"), F.col(pointer).alias("p")).join(ids, F.col("p") == F.col("i"), "left")
    now = checkpointed(now.select("k", F.coalesce("i", "k").alias("t"), F.least("k", F.coalesce("i", "k")).alias("low"), F.coalesce(F.col("i") == F.col("k"), F.lit(True)).alias("end")))
    far = lambda df: df.select(F.col("k").alias("a"), F.col("t").alias("b"), F.col("low").alias("l"), F.col("end").alias("e"))
    # after that many rounds every chain has ended, and ``low`` has been around every circle
    for _ in range(max(1, now.count().bit_length()) + 1):
        step = checkpointed(now.join(far(now), F.col("t") == F.col("a")).select("k", F.col("b").alias("t"), F.least("low", "l").alias("low"), "end", (F.col("b") != F.col("t")).alias("moved")))
        now = step.drop("moved")
        if step.where("moved").limit(1).count() == 0:
            break
    return now.join(far(now), F.col("t") == F.col("a")).select(F.col("k").alias(key), F.when(F.col("e"), F.col("t")).otherwise(F.col("l")).alias("target"))


#: The authors of one surname go to so many tasks, by document.
SHARES = 16


def match_authors(authors: DataFrame, users: DataFrame) -> DataFrame:
    """(doc, author, user_id, score): a document's authors (doc, place, author, surname, initials) to users (user_id, surname,
    initials), each user once, in the authors' order.

    A pair shares the surname, and no compared initial (two at most) differs; it scores 5 and 2 for each compared one, the best
    is taken, of equal ones the least user.  Rows of one place are one author; a user has one surname, so authors of different
    ones are no rivals.  No pairs are made: a surname's users lie in lists by their initials, least first, and its authors
    pass by them in order, a document after the other; only the users of one surname are held.
    """
    ship(authors.sparkSession)
    share = F.pmod(F.xxhash64("doc"), F.lit(SHARES)).cast("int")
    initials = F.substring("initials", 1, 2).alias("initials")
    known = "surname IS NOT NULL AND initials IS NOT NULL"
    asked = authors.where(f"{known} AND place IS NOT NULL").select("surname", share.alias("share"), F.lit(None).cast("long").alias("user_id"), "doc", "place", "author", initials)
    held = users.where(f"{known} AND user_id IS NOT NULL").select("surname", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), F.col("user_id").cast("long").alias("user_id"), initials)
    rows = held.unionByName(asked, allowMissingColumns=True).withColumn("asked", F.col("user_id").isNull())

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = person = None
        lists: dict[str, list[int]] = {}
        tiers: dict[str, list[tuple[int, list[str]]]] = {}
        at: dict[str, int] = {}
        used: set[int] = set()
        best, out = None, []

        def settle() -> None:
            if best is not None:
                used.add(best[1])
                out.append((person[0], best[2], best[1], -best[0]))

        for batch in batches:
            for surname, share, user, doc, place, author, own, is_author in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (surname, share):
                    settle()
                    key, person, best, lists, tiers = (surname, share), None, None, {}, {}
                if not is_author:
                    lists.setdefault(own, []).append(user)
                    continue
                if person != (doc, place):
                    settle()
                    best = None
                    if person is None or person[0] != doc:
                        at, used = dict.fromkeys(lists, 0), set()
                    person = (doc, place)
                if own not in tiers:
                    found: dict[int, list[str]] = {}
                    for theirs in lists:
                        n = min(len(own), len(theirs))
                        if own[:n] == theirs[:n]:
                            found.setdefault(5 + 2 * n, []).append(theirs)
                    tiers[own] = sorted(found.items(), reverse=True)
                for score, kinds in tiers[own]:
                    least = None
                    for kind in kinds:
                        ids, i = lists[kind], at[kind]
                        while i < len(ids) and ids[i] in used:
                            i += 1
                        at[kind] = i
                        if i < len(ids) and (least is None or ids[i] < least):
                            least = ids[i]
                    if least is not None:
                        if best is None or (-score, least) < best[:2]:
                            best = (-score, least, author)
                        break
            yield packed(out)
            out = []
        settle()
        yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int32()), strict=True)], ["doc", "author", "user_id", "score"])

    rows = rows.select("surname", "share", "user_id", "doc", "place", "author", "initials", "asked").repartition("surname", "share")
    return rows.sortWithinPartitions("surname", "share", "asked", "user_id", "doc", "place", "author").mapInArrow(greedy, "doc long, author string, user_id long, score int")
