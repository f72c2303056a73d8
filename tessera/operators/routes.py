"""Approval routes: who is assigned, which steps there are, how far a run has come; selections and reports around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assigned(subjects: DataFrame, steps: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """(key, step, assignee, source): a step's assignee by the subject's direction where the step has one for it, else the
    step's own.  ``overrides``: (step, direction, assignee)."""
    rows = subjects.join(steps, "route")
    own = overrides.select("step", "direction", F.col("assignee").alias("_o"))
    return rows.join(own, ["step", "direction"], "left").select(key, "step", F.coalesce("_o", "assignee").alias("assignee"), F.when(F.col("_o").isNotNull(), "direction").otherwise("template").alias("source"))


def expanded(runs: DataFrame, templates: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """(key, place, name): a route's steps for each run from its start place on; a run that is active already gets none."""
    fresh = runs.join(active.select(key), key, "left_anti")
    return fresh.join(templates, "route").select(key, (F.col("start") + F.col("place") - 1).alias("place"), "name")


def run_states(decisions: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """(key, status, step, approved): how far each run is, from its decisions (key, at, kind) in order and its number of steps.

    An approval moves to the next step and after the last completes the run; a rejection ends it; a request for revision
    pauses it at its step.  What comes after an end or a pause counts for nothing.  The first decision that isn't an approval
    and the number of approvals before it say all, so no run is gone through in one task.
    """
    other = decisions.where("kind <> 'approve'").groupBy(key).agg(F.min(F.struct("at", "kind")).alias("o"))
    counted = decisions.join(other, key, "left").where((F.col("kind") == "approve") & (F.col("o").isNull() | (F.col("at") < F.col("o.at")))).groupBy(key).agg(F.count("*").alias("approved"))
    rows = steps.select(key, "n_steps").join(counted, key, "left").join(other, key, "left").withColumn("approved", F.least(F.coalesce("approved", F.lit(0)), "n_steps").cast("int"))
    done = F.col("approved") >= F.col("n_steps")
    status = F.when(done, "completed").when(F.col("o.kind") == "reject", "rejected").when(F.col("o.kind") == "revise", "paused").otherwise("active")
    return rows.select(key, status.alias("status"), F.when(~done & (F.coalesce(F.col("o.kind"), F.lit("")) != "reject"), F.col("approved") + 1).alias("step"), "approved")


def appeals(requests: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """(request, key, outcome): one appeal a rejected subject; the first to come is taken, of equal times the least request."""
    rows = requests.join(states, key, "left")
    first = F.row_number().over(Window.partitionBy(key).orderBy("at", "request")) == 1
    return rows.select("request", key, F.when(F.coalesce(F.col("status"), F.lit("")) != "rejected", "refused: not rejected").when(first, "pending").otherwise("refused: appealed already").alias("outcome"))


def reset_runs(runs: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """(key..., action): wanted runs that don't exist are created, ended ones reset, running ones left alone."""
    both = wanted.join(runs, key, "left")
    return both.select(*key, F.when(F.col("status").isNull(), "create").when(F.col("status").isin("pending", "running"), "keep").otherwise("reset").alias("action"))


def progress(runs: DataFrame, key: str, total: Column) -> DataFrame:
    """(key, pending, running, done, percent, finished): one row for a client that asks how far its runs are."""
    s = F.col("status")
    got = runs.groupBy(key).agg(F.count_if(s == "pending").alias("pending"), F.count_if(s == "running").alias("running"), F.count_if(~s.isin("pending", "running")).alias("done"), F.max(total).alias("_t"))
    return got.select(key, "pending", "running", "done", F.bround(100.0 * F.col("done") / F.greatest(F.col("_t"), F.lit(1)), 0).cast("int").alias("percent"), (F.col("done") >= F.col("_t")).alias("finished"))


def source_numbers(selected: DataFrame, existing: DataFrame, by: str, source: str, order: list[str]) -> DataFrame:
    """(by, source, number): sources of each document numbered in the order in which they are first seen, from the greatest
    existing number on; sources that have a number keep it."""
    first = selected.groupBy(by, source).agg(F.min(F.struct(*order)).alias("_f"))
    have = existing.select(by, source, "number")
    last = have.groupBy(by).agg(F.max("number").alias("_m"))
    new = first.join(have, [by, source], "left_anti").join(last, by, "left")
    numbered = new.select(by, source, (F.coalesce("_m", F.lit(0)) + F.row_number().over(Window.partitionBy(by).orderBy("_f"))).cast("int").alias("number"))
    return first.join(have, [by, source]).select(by, source, "number").unionByName(numbered)


def with_fallback(primary: DataFrame, fallback: DataFrame, by: str, verdict: str, label: str) -> DataFrame:
    """The primary rows of each group, or the fallback's, with their verdict relabelled, where it has none."""
    return primary.unionByName(fallback.join(primary.select(by), by, "left_anti").withColumn(verdict, F.lit(label)))


def composed(rows: DataFrame, conditions: dict[str, Column | None]) -> DataFrame:
    """Rows that meet all conditions that are asked for (None: not asked)."""
    return rows.where(reduce(lambda a, b: a & b, [c for c in conditions.values() if c is not None], F.lit(True)))


def own_or_shared(rows: DataFrame, shares: DataFrame, key: str, owner: str) -> DataFrame:
    """(user, key, how): rows of their owner, and of those that they are shared with (shares: key, user), each pair once."""
    own = rows.select(F.col(owner).alias("user"), key, F.lit("owner").alias("how"))
    shared = shares.join(rows.select(key, owner), key).where(F.col("user") != F.col(owner)).select("user", key, F.lit("shared").alias("how")).distinct()
    return own.unionByName(shared)


def action_state(tasks: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, user, active, mine, can_reject, reason): what a user may do with a task: it must be active, and name the user, or
    no user but a group and unit that the user is in.  ``members``: (user, grp, unit)."""
    m = members.groupBy("user").agg(F.collect_set(F.struct("grp", "unit")).alias("places"))
    rows = tasks.join(m, "user", "left")
    within = F.coalesce(F.exists("places", lambda p: (p["grp"] == F.col("grp")) & (F.col("unit").isNull() | (p["unit"] == F.col("unit")))), F.lit(False))
    mine = F.when(F.col("assignee").isNotNull(), F.col("assignee") == F.col("user")).otherwise(within)
    active = F.col("status") == "active"
    reason = F.when(~active, "closed").when(~mine, "not assigned").otherwise("")
    return rows.select(key, "user", active.alias("active"), mine.alias("mine"), (active & mine & F.col("rejectable")).alias("can_reject"), reason.alias("reason"))


def resolved(wanted: DataFrame, entries: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(key, path, target, how): a dependency by its path, whatever the case, else by its stem where one entry has it."""
    low = F.lower(path)
    stem = F.regexp_replace(F.regexp_extract(low, r"([^/]*)$", 1), r"\.[^.]*$", "")
    exact = entries.groupBy(low.alias("_p")).agg(F.min(path).alias("_a"))
    loose = entries.groupBy(stem.alias("_s")).agg(F.min(path).alias("_b"), F.count("*").alias("_n")).where("_n = 1")
    rows = wanted.withColumns({"_p": low, "_s": stem}).join(exact, "_p", "left").join(loose, "_s", "left")
    how = F.when(F.col("_a").isNotNull(), "path").when(F.col("_b").isNotNull(), "stem").otherwise("missing")
    return rows.select(key, path, F.coalesce("_a", "_b").alias("target"), how.alias("how"))


def main_file(files: DataFrame, by: str, path: str = "path") -> DataFrame:
    """(by, path): a package's main file: a known name first, then the fewest folders, the shortest and least path."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    score = F.struct(F.when(name.rlike(r"^(?:main|article|paper|manuscript)\."), 0).otherwise(1), F.size(F.split(path, "/")), F.length(path), F.col(path))
    return files.groupBy(by).agg(F.min_by(path, score).alias(path))


def reason(kind: Column, terms: Column, semantic: Column, words: dict[str, str], most: int = 4) -> Column:
    """A sentence that says why a source was proposed."""
    lead = F.coalesce(F.create_map(*[F.lit(x) for w in words.items() for x in w])[kind], F.lit("The source is near to the topic"))
    shared = F.when(F.size(terms) > 0, F.concat(F.lit("; shared terms: "), F.array_join(F.slice(terms, 1, most), ", "))).otherwise("")
    return F.concat(lead, shared, F.when(semantic >= 0.45, "; close in meaning").otherwise(""), F.lit("."))
