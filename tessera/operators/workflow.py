"""Routing, visibility and history of task lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def wildcard(rule: Column, value: Column) -> Column:
    """A rule's value fits when it is null or equal."""
    return rule.isNull() | (rule == value)


def route_choice(subjects: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Each subject's rule: the most specific that fits, then by priority and id.  Rules are a small table."""
    fits = wildcard(rules.rule_kind, subjects.kind) & wildcard(rules.rule_group, subjects.grp)
    found = subjects.join(rules, fits)
    order = [F.col("rule_kind").isNull(), F.col("rule_group").isNull(), F.desc("priority"), F.asc("rule_id")]
    return latest(found, [key], order)


def visible(tasks: DataFrame, users: DataFrame) -> Column:
    """A task is visible to its user; or, where it names none, to its group's members of its unit (null: any unit)."""
    named = tasks.task_user == users.user_id
    group = tasks.task_user.isNull() & (tasks.task_group == users.user_group) & wildcard(tasks.task_unit, users.user_unit)
    return named | group


def missing_pairs(left: DataFrame, right: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of every left row with every definition (few rows, broadcast by size) that don't exist yet."""
    return left.crossJoin(right).join(existing, keys, "left_anti")


def attempts(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def renumbered(steps: DataFrame, by: list[str], order: str, start: int, inserted: int = 1) -> DataFrame:
    """Steps from ``start`` on move up by ``inserted`` places."""
    return steps.withColumn(order, F.col(order) + F.when(F.col(order) >= start, inserted).otherwise(0))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str], overridden: str, source_fields: list[str]) -> DataFrame:
    """Stored rows with incoming values: new keys are created, changed rows updated; overridden rows take only
    ``source_fields``; keys that no longer come stay and are marked.  Applying it twice changes nothing more."""
    s, i = stored.alias("s"), incoming.alias("i")
    both = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    new, gone = F.col(f"s.{key}").isNull(), F.col(f"i.{key}").isNull()
    held = F.coalesce(F.col(f"s.{overridden}"), F.lit(False))
    take = {f: F.when(new, F.col(f"i.{f}")).when(gone | (held if f not in source_fields else F.lit(False)), F.col(f"s.{f}")).otherwise(F.col(f"i.{f}")) for f in fields}
    changed = F.lit(False)
    for f, v in take.items():
        changed = changed | ~v.eqNullSafe(F.col(f"s.{f}"))
    action = F.when(new, "create").when(gone, "stale").when(changed, "update").otherwise("keep")
    return both.select(F.coalesce(f"s.{key}", f"i.{key}").alias(key), *[v.alias(f) for f, v in take.items()], held.alias(overridden), action.alias("action"))
