"""Presentation of nodes: names, colours, sizes, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base and slope of node sizes (width, height) by kind, and the colour without community: fixed values.
SIZES = {"file": ((190, 80), (72, 20)), "function": ((150, 30), (52, 10))}
NO_COLOR = "#64748b"
GRID = (8, 220, 120)


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def node_label(qualified_name: Column, name: Column, path: Column, kind: Column) -> Column:
    """The first of these that is neither null nor empty."""
    return F.coalesce(_given(qualified_name), _given(name), _given(path), _given(kind))


def fallback_name(community: Column) -> Column:
    return F.concat(F.lit("Cluster #"), community.cast("string"))


def community_name(stored: Column, community: Column) -> Column:
    """The stored name, else ``Cluster #id``, else null."""
    return F.coalesce(_given(F.trim(stored)), F.when(community.isNotNull(), fallback_name(community)))


def color(community: Column) -> Column:
    """Hue by golden angle, one decimal at most."""
    hue = F.round(F.pmod(community.cast("double") * 137.5, F.lit(360.0)), 1)
    text = F.regexp_replace(F.format_string("%.1f", hue), r"\.0$", "")
    return F.when(community.isNull(), NO_COLOR).otherwise(F.concat(F.lit("hsl("), text, F.lit(", 70%, 55%)")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def last_segment(dotted: Column) -> Column:
    return F.element_at(F.split(dotted, r"\."), -1)


def node_size(kind: Column, degree: Column, most: Column) -> tuple[Column, Column]:
    """Width and height, growing with the root of the degree's share of the largest."""
    grown = F.sqrt(degree / F.greatest(F.lit(1), most))
    return tuple(F.when(kind == "File", f[0] + grown * f[1]).otherwise(g[0] + grown * g[1]) for f, g in zip(SIZES["file"], SIZES["function"], strict=True))


def grid_position(ordinal: Column) -> tuple[Column, Column]:
    """x and y of the ordinal (from 0) in rows of eight."""
    per, dx, dy = GRID
    return F.pmod(ordinal, F.lit(per)) * dx, F.floor(ordinal / per) * dy
