"""Syntax trees in JSON, walked level by level: nodes of any depth as rows.

A tree is read once into a VARIANT.  Each round takes the children of the last round's values: an array's elements, and what
an object holds under ``children``; objects with ``kind`` are nodes.  A round is one pass without a shuffle, and its
rows are a table in the shared folder; there are as many rounds as the deepest tree has levels.  A node's path, its
places from the root, gives the order of reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import checkpointed


def walk(trees: DataFrame, key: str, tree: str, kind: str = "t", children: str = "c", url: str = "url") -> DataFrame:
    """(key, path, depth, kind, text, url) of every node: its text where its children are a string, its url where it has one.

    Defined results: a tree that isn't JSON, or null, has no nodes; arrays in arrays are passed through and count as levels of
    the path, not of the depth; repeated keys keep their trees apart by nothing but their paths.
    """
    level = trees.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(tree).alias("v")).where("v IS NOT NULL")
    nodes = None
    while True:
        level = checkpointed(
            level.select(
                "key",
                "path",
                "depth",
                F.expr(f"try_variant_get(v, '$.{kind}', 'string')").alias("kind"),
                F.expr(f"CASE WHEN schema_of_variant(try_variant_get(v, '$.{children}', 'variant')) = 'STRING' THEN try_variant_get(v, '$.{children}', 'string') END").alias("text"),
                F.expr(f"try_variant_get(v, '$.{url}', 'string')").alias("url"),
                F.expr(f"coalesce(try_variant_get(v, '$.{children}', 'array<variant>'), try_variant_get(v, '$', 'array<variant>'))").alias("below"),
            )
        )
        got = level.where("kind IS NOT NULL").select(F.col("key").alias(key), "path", "depth", "kind", "text", "url")
        nodes = got if nodes is None else nodes.unionByName(got)
        deeper = F.col("depth") + F.when(F.col("kind").isNotNull(), 1).otherwise(0)
        level = level.select("key", "path", deeper.alias("depth"), F.posexplode("below").alias("at", "v")).select("key", F.array_append("path", F.col("at")).alias("path"), "depth", "v").where("v IS NOT NULL")
        if level.limit(1).count() == 0:
            return nodes


def outline(nodes: DataFrame, key: str) -> DataFrame:
    """(key, nodes, depth, links, digest): a tree's size, its deepest level, its nodes with a url, and the digest of its texts in
    the order of reading."""
    # a text's pieces are put together by document; long ones are the document's own size
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("path", "text")))), lambda x: x["text"]), " ")
    return nodes.groupBy(key).agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.count("url").alias("links"), F.md5(text).alias("digest"))
