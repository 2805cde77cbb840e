"""Box expressions; a box is an array of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_box(b: Column) -> Column:
    return F.coalesce((F.size(b) == 4) & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))


def whole_box(b: Column, rounded: bool = False) -> Column:
    """Whole-number coordinates, cut off or rounded half to even; null unless ordered."""
    out = F.transform(b, lambda x: (F.bround(x, 0) if rounded else x).cast("int"))
    return F.when(is_box(out), out)


def unit_box(b: Column, width: Column, height: Column) -> Column:
    """Shares of the page in [0, 1], six digits."""
    cut = lambda x: F.least(F.greatest(F.bround(x, 6), F.lit(0.0)), F.lit(1.0))
    return F.array(cut(b[0] / width), cut(b[1] / height), cut(b[2] / width), cut(b[3] / height))


def grid_box(b: Column) -> Column:
    """Whole thousandths of a box in [0, 1]."""
    return F.transform(b, lambda x: F.least(F.greatest(F.bround(x * 1000, 0).cast("int"), F.lit(0)), F.lit(1000)))


def pixel_box(b: Column, width: Column, height: Column) -> Column:
    return F.array(*(F.bround(b[i] * (width if i % 2 == 0 else height), 0).cast("int") for i in range(4)))


def union_box(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null for none."""
    side = lambda i: F.transform(boxes, lambda b: b[i])
    return F.when(F.size(boxes) > 0, F.array(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(2)), F.array_max(side(3))))


def from_tlbr(top: Column, left: Column, bottom: Column, right: Column) -> Column:
    return F.array(left, top, right, bottom)


def area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where degenerate."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    return F.coalesce(F.try_divide((w * h).cast("double"), area(a) + area(b) - w * h), F.lit(0.0))


def clamp_box(b: Column, width: Column, height: Column) -> Column:
    fit = lambda x, top: F.least(F.greatest(x, F.lit(0)), top)
    return F.array(fit(b[0], width), fit(b[1], height), fit(b[2], width), fit(b[3], height))


def padded_box(b: Column, pad: int, width: Column, height: Column) -> Column:
    return clamp_box(F.array(b[0] - pad, b[1] - pad, b[2] + pad, b[3] + pad), width, height)


def centre(b: Column) -> Column:
    return F.struct(((b[0] + b[2]) / 2).alias("x"), ((b[1] + b[3]) / 2).alias("y"))


def unit_at(units: Column, box: Column, target_id: Column) -> Column:
    """Id of the unit whose box holds the centre of ``box``: the target if it does, else the first in order."""
    c = centre(box)
    hit = F.filter(units, lambda u: c.x.between(u.box[0], u.box[2]) & c.y.between(u.box[1], u.box[3]))
    return F.when(F.exists(hit, lambda u: u.id == target_id), target_id).otherwise(F.get(hit, F.lit(0)).id)
