"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One step. ``edges`` (u, v) stand for both directions.

    Large star: every node links its larger neighbours to the smallest of itself and its neighbours. Small star: every
    node links its smaller neighbours and itself to the smallest of them. A node's neighbours are never gathered: the
    minimum is aggregated and joined back, so that a hub is split like any other skewed key.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    own = both if larger else both.where("v < u")
    least = own.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = own.where("v > u") if larger else own
    out = linked.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every ``u`` has one link (to a smaller ``v``) and no ``v`` is a ``u``: the links are stars around roots."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``parts`` (node, root), as :func:`components` gives them, with the further ``links`` (u, v).

    Only the roots of parts that a link joins go through further rounds.
    """
    if parts is None:
        return components(links)
    ends = links.join(parts.toDF("u", "ru"), "u", "left").join(parts.toDF("v", "rv"), "v", "left")
    joined = components(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
    if joined.isEmpty():
        return parts
    # No root is a node of ``parts``, so the nodes of ``joined`` are new there.
    moved = parts.join(joined.toDF("root", "above"), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return materialize(moved.unionByName(joined), "parts")


def components(edges: DataFrame, limit: int = 50) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (u, v) but the roots: the smallest node that can be reached.

    Links to itself and nulls are ignored; repeated links count once; no links give no rows. Each round is written to
    the shared folder, so that a lost executor costs one round at most. Raises if ``limit`` rounds don't suffice (the
    number needed grows with the logarithm of the longest path).
    """
    edges = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "links")
    for _ in range(limit):
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = materialize(_stars(_stars(edges, True), False), "links")
    raise RuntimeError(f"components did not settle in {limit} rounds")
