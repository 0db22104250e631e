"""Boxes on a page: both origins as one, unions, containment, and the part of a page to cut out around a block.

A box is struct<x0, y0, x1, y1> with the origin at the top left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def from_corners(left: Column, top: Column, right: Column, bottom: Column, origin: Column, page_height: Column) -> Column:
    """A box from its corners, whichever way round they are; a bottom-left origin is the default. Null if it is half a point or less wide or high."""
    flip = F.upper(F.coalesce(origin, F.lit("BOTTOMLEFT"))) == "BOTTOMLEFT"
    a, b = F.when(flip, page_height - top).otherwise(top), F.when(flip, page_height - bottom).otherwise(bottom)
    made = box(F.least(left, right), F.least(a, b), F.greatest(left, right), F.greatest(a, b))
    return F.when((F.abs(right - left) > 0.5) & (F.abs(b - a) > 0.5), made)


def union(boxes: Column) -> Column:
    """The smallest box around an array of boxes; nulls don't count."""
    some = F.array_compact(boxes)
    side = lambda name, of: of(F.transform(some, lambda b: b[name]))
    return F.when(F.size(some) > 0, box(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max)))


def contains(outer: Column, inner: Column, margin: float = 3.0) -> Column:
    return (inner["x0"] >= outer["x0"] - margin) & (inner["y0"] >= outer["y0"] - margin) & (inner["x1"] <= outer["x1"] + margin) & (inner["y1"] <= outer["y1"] + margin)


def meet(a: Column, b: Column) -> Column:
    return box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def crop(page: Column, target: Column, before: Column, after: Column, x_margin: float, y_margin: float, most_high: float) -> Column:
    """Room around a block: a share of its size within bounds, but no further than half way to the blocks above and below, on the page, and never into the block itself."""
    wide, high = target["x1"] - target["x0"], target["y1"] - target["y0"]
    page_wide, page_high = page["x1"] - page["x0"], page["y1"] - page["y0"]
    dx = F.greatest(F.lit(x_margin), F.least(page_wide * 0.10, wide * 0.35))
    dy = F.least(F.greatest(F.lit(y_margin), page_high * most_high), F.greatest(F.lit(y_margin), high * 1.5))
    top, bottom = target["y0"] - dy, target["y1"] + dy
    top = F.when(before["y1"] <= target["y0"], F.greatest(top, (before["y1"] + target["y0"]) / 2)).otherwise(top)
    bottom = F.when(after["y0"] >= target["y1"], F.least(bottom, (target["y1"] + after["y0"]) / 2)).otherwise(bottom)
    clip = meet(box(target["x0"] - dx, top, target["x1"] + dx, bottom), page)
    return meet(box(F.least(clip["x0"], target["x0"]), F.least(clip["y0"], target["y0"]), F.greatest(clip["x1"], target["x1"]), F.greatest(clip["y1"], target["y1"])), page)


def gap(page: Column, before: Column, after: Column, x_margin: float, most_high: float = 0.35) -> Column:
    """The space between two blocks of one column, where a block without a box must be; null unless it is over three points high, not too high, and the blocks overlap sideways by a fifth."""
    height = after["y0"] - before["y1"]
    over = F.greatest(F.lit(0.0), F.least(before["x1"], after["x1"]) - F.greatest(before["x0"], after["x0"]))
    narrow = F.greatest(F.lit(1.0), F.least(before["x1"] - before["x0"], after["x1"] - after["x0"]))
    clip = meet(box(F.least(before["x0"], after["x0"]) - x_margin, before["y1"] + 1, F.greatest(before["x1"], after["x1"]) + x_margin, after["y0"] - 1), page)
    fits = (height > 3.0) & (height <= (page["y1"] - page["y0"]) * most_high) & (over / narrow >= 0.20)
    return F.when(fits & (clip["x1"] - clip["x0"] > 1.0) & (clip["y1"] - clip["y0"] > 1.0), clip)


def transcription_budget(text: Column) -> Column:
    """Tokens for reading a block again: half its characters and some, from 512 to 1,024."""
    return F.greatest(F.lit(512), F.least(F.lit(1_024), F.floor(F.length(F.coalesce(text, F.lit(""))) / 2) + 256)).cast("int")
