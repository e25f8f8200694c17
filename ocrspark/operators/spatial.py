"""Box-overlap join as an equi join on grid cells.

If more than half of box ``a`` lies in box ``b``, the centre of ``a`` lies in ``b``:
the shared part covers more than half of each side of ``a``. So ``a`` needs only the
cell of its centre, and every pair meets in exactly one cell. ``b`` goes to all cells
it touches on a grid whose cell size follows its own size, at most four cells. Big
and small boxes so live on different grid levels, and ``a`` is looked up on the
levels that occur in ``b``. No box is replicated in proportion to its area, and the
join key is a page cell, so a page with very many boxes still spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ocrspark import pins
from ocrspark.functions.geometry import overlap
from ocrspark.session import SMALL_SIDE, small_side

# Cell of level 0 is 256 x 64 pixels, about one word; each level is eight times coarser.
X_BITS, Y_BITS, LEVEL_BITS = 8, 6, 3


def _level(prefix: str) -> Column:
    """Level whose cell is about as large as the box. Any level gives the same pairs."""
    width = F.col(f"{prefix}r").cast("double") - F.col(f"{prefix}l")
    height = F.col(f"{prefix}b").cast("double") - F.col(f"{prefix}t")
    size = F.greatest(width / F.lit(1 << X_BITS), height / F.lit(1 << Y_BITS), F.lit(1.0))
    return F.ceil(F.log2(size) / F.lit(LEVEL_BITS)).cast("int")


def _cell(coord: Column, bits: int, extra: int = 0) -> Column:
    shift = F.col("lvl") * LEVEL_BITS + (bits + extra)
    return F.call_function("shiftright", coord.cast("long"), shift)


def _cells(b: DataFrame, b_box: str) -> DataFrame:
    """Boxes with an area, once per cell they touch on the grid of their own size."""
    bl, bt, br, bb = (F.col(f"{b_box}{s}") for s in "ltrb")
    solid = b.filter((br > bl) & (bb > bt)).withColumn("lvl", _level(b_box))
    return solid.withColumn(
        "cx", F.explode(F.sequence(_cell(bl, X_BITS), _cell(br, X_BITS)))
    ).withColumn("cy", F.explode(F.sequence(_cell(bt, Y_BITS), _cell(bb, Y_BITS))))


def _holds(b_box: str, x2: Column, y2: Column) -> Column:
    """Whether box ``b`` holds the point given by twice its place."""
    bl, bt, br, bb = (F.col(f"{b_box}{s}") * 2 for s in "ltrb")
    return (x2 >= bl) & (x2 < br) & (y2 >= bt) & (y2 < bb)


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    a_box: str,
    b_box: str,
    on: tuple[str, ...] = pins.PAGE_KEY,
    anchor: str = "centre",
    page_levels: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Pairs of boxes on the same page, with the share of ``a`` that lies in ``b``.

    ``a_box`` and ``b_box`` are the column prefixes of the boxes. ``anchor='centre'``
    keeps pairs with overlap > 0.5; ``'left'`` keeps pairs where the middle of the left
    edge of ``a`` lies in ``b``. Other columns of both sides must have distinct names.

    ``page_levels`` looks a box up on the levels of its own page only. That costs a join by
    ``on``, which is for sides that are stored by it and need no shuffle there. Otherwise the levels of all
    pages are found first, in ``sizes`` if that is given: a table with the boxes of ``b`` that costs less.
    """
    al, at, ar, ab = (F.col(f"{a_box}{s}").cast("long") for s in "ltrb")
    bl, bt, br, bb = (F.col(f"{b_box}{s}") for s in "ltrb")
    # Twice the anchor point, so that half pixels stay integers.
    x2 = al + ar if anchor == "centre" else al * 2
    y2 = at + ab

    solid = (b if page_levels or sizes is None else sizes).filter((br > bl) & (bb > bt)).withColumn("lvl", _level(b_box))
    cells = _cells(b, b_box)

    points = a.filter((ar > al) & (ab > at)) if anchor == "centre" else a
    if page_levels:
        points = points.join(solid.groupBy(*on).agg(F.collect_set("lvl").alias("lvls")), [*on])
        points = points.withColumn("lvl", F.explode("lvls")).drop("lvls")
    else:
        points = points.withColumn("lvl", F.explode(solid.agg(F.collect_set("lvl")).scalar()))
    points = (
        points
        .withColumn("cx", _cell(x2, X_BITS, 1))
        .withColumn("cy", _cell(y2, Y_BITS, 1))
    )
    pairs = points.join(cells, [*on, "lvl", "cx", "cy"]).drop("lvl", "cx", "cy")
    if anchor == "centre":
        return pairs.withColumn("overlap", overlap(a_box, b_box)).filter(
            F.col("overlap") > pins.OVERLAP
        )
    return pairs.filter(_holds(b_box, x2, y2))


def anchored_join(
    a: DataFrame, b: DataFrame, a_box: str, b_box: str, by: str, on: tuple[str, ...] = pins.PAGE_KEY,
    limit: int = SMALL_SIDE,
) -> DataFrame:
    """Pairs of boxes as :func:`overlap_join` finds them, with the anchor of each box of ``b`` in column ``by``.

    Boxes of ``b`` with another value than ``centre`` or ``left`` are an error. ``a`` is read once for
    all anchors and sizes. The cells of ``b`` are written first (so this runs a job); while they take at most
    ``limit`` bytes ``a`` is not shuffled, beyond that Spark shuffles both sides, with equal rows.
    """
    unknown = F.raise_error(F.concat(F.lit("unknown anchor: "), F.coalesce(by, F.lit("null"))))
    known = F.coalesce(F.col(by).isin("centre", "left"), F.lit(False))
    cells = small_side(
        _cells(b.withColumn(by, F.when(known, F.col(by)).otherwise(unknown)), b_box), "cells", limit
    )
    al, at, ar, ab = (F.col(f"{a_box}{s}").cast("long") for s in "ltrb")
    centre = F.col(by) == "centre"
    x2, y2 = F.when(centre, al + ar).otherwise(al * 2), at + ab
    looked_up = cells.agg(F.collect_set(F.struct(by, "lvl"))).scalar()
    points = a.select("*", F.inline(looked_up)).filter(~centre | ((ar > al) & (ab > at)))
    points = points.withColumn("cx", _cell(x2, X_BITS, 1)).withColumn("cy", _cell(y2, Y_BITS, 1))
    pairs = points.join(cells, [*on, by, "lvl", "cx", "cy"]).drop("lvl", "cx", "cy")
    covered = overlap(a_box, b_box) > pins.OVERLAP
    return pairs.filter(F.when(centre, covered).otherwise(_holds(b_box, x2, y2)))
