"""Positions of nodes, and their picture as SVG."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.text import node_colour, node_radius
from graphmill.session import checkpointed

GOLDEN = math.pi * (3 - math.sqrt(5))
#: Radius of the sphere and files from which it grows; ring radius, its growth a sibling.
SPHERE, SPHERE_FILES, RING, RING_STEP = 90.0, 50.0, 25.0, 0.2
#: Spacing of a depth layout: across and along, in space and in a picture.
SPACE, PICTURE = (25.0, 30.0), (400.0, 250.0)
#: Least distance of nodes in a picture and rounds in which overlaps are moved apart.
DISTANCE, ROUNDS = 80.0, 50


def global_index(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``index``, the place of each row in a total order from 0, without moving all rows to one task.

    Ranges of rows are numbered on their own; only the ranges' sizes, one row a partition, are summed up in one place.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(before, "_part").withColumn("index", (F.col("_before") + own - 1).cast("bigint")).drop("_part", "_before")


def running_sum(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` over the rows of the same group before each one in the order of ``key``.

    Rows are put in ranges of group and key. A group that fills many ranges is summed range by range, and only the ranges'
    sums, a row for each range and group in it, meet in one task a group.
    """
    ranged = checkpointed(rows.repartitionByRange(group, key).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(parts, [group, "_part"]).withColumn("before", F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.drop("_part", "_before")


def sphere(files: DataFrame) -> DataFrame:
    """``(id, x, y, z)`` of files on a sphere by the golden angle; ``files`` has ``id`` and ``index`` from 0."""
    n = files.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    rows = files.withColumn("_one", F.lit(1)).join(n, "_one")
    radius = F.lit(SPHERE) * F.greatest(F.lit(1.0), F.sqrt(F.col("n") / SPHERE_FILES))
    y = 1 - F.col("index") / F.greatest(F.col("n") - 1, F.lit(1)) * 2
    flat, theta = F.sqrt(1 - y * y), F.lit(GOLDEN) * F.col("index")
    return rows.select("id", (F.cos(theta) * flat * radius).alias("x"), (y * radius).alias("y"), (F.sin(theta) * flat * radius).alias("z"))


def rings(siblings: DataFrame, parents: DataFrame, n_files: Column) -> DataFrame:
    """``(id, x, y, z)`` of children on a ring around their parent; a parent without a place is at the centre."""
    scale = F.greatest(F.lit(1.0), F.sqrt(n_files / SPHERE_FILES))
    radius = (F.lit(RING) + F.col("siblings") * RING_STEP) * scale
    angle = F.col("index") / F.greatest(F.col("siblings"), F.lit(1)) * (2 * math.pi)
    placed = siblings.join(parents.withColumnRenamed("id", "parent"), "parent", "left")
    at = [F.coalesce(c, F.lit(0.0)) for c in ("x", "y", "z")]
    return placed.select(F.col("child").alias("id"), (at[0] + F.cos(angle) * radius).alias("x"), at[1].alias("y"), (at[2] + F.sin(angle) * radius).alias("z"))


def layers(ranked: DataFrame, spacing: tuple[float, float] = SPACE) -> DataFrame:
    """``(id, across, along)`` of flow nodes in rows by depth, each row centred; ``ranked`` is of ``ranked_siblings``."""
    across = (F.col("index") - (F.col("at_depth") - 1) / 2.0) * spacing[0]
    return ranked.select("id", across.alias("across"), (F.col("depth") * spacing[1]).alias("along"))


def hidden_children(nodes: DataFrame, forward: bool) -> DataFrame:
    """``(id, hidden, shows_badge)``: callees that the next depth does not show, and whether a node says so."""
    below = nodes.groupBy((F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("_below"))
    hidden = F.when(F.col("total_callees") > 0, F.greatest(F.lit(0), F.col("total_callees") - F.coalesce("_below", F.lit(0)))).otherwise(0)
    badge = F.col("truncated_calls") | (F.col("total_callees") > 10) | (F.lit(forward) & (F.col("hidden") > 0) & (F.col("depth") != 0))
    return nodes.join(below, "depth", "left").withColumn("hidden", hidden).select("id", "hidden", badge.alias("shows_badge"))


def _relaxed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("rank", kind="stable")
    x, y = group["x"].tolist(), group["y"].tolist()
    for _ in range(ROUNDS):
        moved = False
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                dx, dy = x[j] - x[i], y[j] - y[i]
                far = math.hypot(dx, dy)
                if 0 < far < DISTANCE:
                    push = (DISTANCE - far) / 2 / far
                    x[i], y[i], x[j], y[j] = x[i] - dx * push, y[i] - dy * push, x[j] + dx * push, y[j] + dy * push
                    moved = True
        if not moved:
            break
    return pd.DataFrame({"id": group["id"], "x": x, "y": y})


def without_overlap(positions: DataFrame) -> DataFrame:
    """``(id, x, y)`` with nodes nearer than DISTANCE pushed apart, pair by pair in order of ``rank``. For a picture's nodes,
    which a flow's limit bounds: each push depends on the ones before, so they are one group."""
    return positions.groupBy(F.lit(0).alias("_one")).applyInPandas(_relaxed, "id string, x double, y double")


def svg(nodes: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """``(part, order, markup)`` rows of a picture, to be joined in order: head, lines, then marks and labels, foot.

    ``nodes`` has ``id, name, type``; ``edges`` ``caller, callee, type``; ``positions`` ``id, x, y``.
    """
    box = positions.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).select(
        (F.lit(200.0) - F.col("x0")).alias("dx"), (F.lit(280.0) - F.col("y0")).alias("dy"), F.greatest(F.col("x1") - F.col("x0") + 400, F.lit(800.0)).alias("w"),
        F.greatest(F.col("y1") - F.col("y0") + 480, F.lit(600.0)).alias("h"), F.lit(1).alias("_one"),
    )
    at = positions.withColumn("_one", F.lit(1)).join(box, "_one").select("id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    head = box.select(F.lit(0).alias("part"), F.lit("").alias("order"), F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%.1f" height="%.1f">', "w", "h").alias("markup"))
    ends = edges.join(at.select(F.col("id").alias("caller"), F.col("x").alias("ax"), F.col("y").alias("ay")), "caller").join(
        at.select(F.col("id").alias("callee"), F.col("x").alias("bx"), F.col("y").alias("by")), "callee"
    )
    far = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    # An arrow ends before its target's mark.
    short = F.when(far > 0, F.lit(15.0) / far).otherwise(0.0)
    kind = F.when(F.coalesce(F.col("type") == "call", F.lit(False)), "edge edge-call").otherwise("edge")
    lines = ends.select(
        F.lit(1).alias("part"), F.concat_ws(">", "caller", "callee").alias("order"),
        F.format_string('<line class="%s" x1="%.2f" y1="%.2f" x2="%.2f" y2="%.2f"/>', kind, "ax", "ay", F.col("bx") - (F.col("bx") - F.col("ax")) * short, F.col("by") - (F.col("by") - F.col("ay")) * short).alias("markup"),
    )
    r = node_radius(F.col("type"))
    safe = F.replace(F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    dots = nodes.select("id", "name", "type").join(at, "id").select(
        F.lit(2).alias("part"), F.col("id").alias("order"),
        F.format_string('<circle cx="%.2f" cy="%.2f" r="%d" fill="%s"/><text x="%.2f" y="%.2f">%s</text>', "x", "y", r, node_colour(F.col("type")), "x", F.col("y") - r - 8, safe).alias("markup"),
    )
    foot = box.select(F.lit(3).alias("part"), F.lit("").alias("order"), F.lit("</svg>").alias("markup"))
    return head.unionByName(lines).unionByName(dots).unionByName(foot)
