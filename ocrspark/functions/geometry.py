"""Box arithmetic. A box is four integer columns l, t, r, b with a name prefix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{side}") for side in "ltrb")


def area(prefix: str = "") -> Column:
    l, t, r, b = box(prefix)
    return (r - l).cast("double") * (b - t).cast("double")


def overlap(a: str, b: str) -> Column:
    """Share of box ``a`` that box ``b`` covers; 0 if they do not meet or ``a`` is empty."""
    al, at, ar, ab = box(a)
    bl, bt, br, bb = box(b)
    width = (F.least(ar, br) - F.greatest(al, bl)).cast("double")
    height = (F.least(ab, bb) - F.greatest(at, bt)).cast("double")
    meets = (width > 0) & (height > 0) & (ar > al) & (ab > at)
    return F.when(meets, width * height / area(a)).otherwise(F.lit(0.0))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def union_box(prefix: str = "") -> list[Column]:
    l, t, r, b = box(prefix)
    return [F.min(l).alias("l"), F.min(t).alias("t"), F.max(r).alias("r"), F.max(b).alias("b")]
