"""Detections: overlap of boxes and change between two lists.

A detection is STRUCT<bbox ARRAY<DOUBLE>, confidence, class_id, class_name>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IOU_MATCH = 0.3


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of [x1, y1, x2, y2]; 0 if the union is empty."""
    side = lambda box, i, j: F.greatest(F.lit(0.0), box[j] - box[i])
    inter = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = side(a, 0, 2) * side(a, 1, 3) + side(b, 0, 2) * side(b, 1, 3) - inter
    return F.when(union > 0, inter / (union + 1e-8)).otherwise(F.lit(0.0))


def delta_set(a: Column, b: Column, eps: float = 1e-5) -> Column:
    """Change between two plain lists: 1 - |common| / (|all| + eps) on their sets.  NULL counts as empty."""
    na, nb = F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0))
    na, nb = F.greatest(na, F.lit(0)), F.greatest(nb, F.lit(0))
    return (
        F.when((na == 0) & (nb == 0), F.lit(0.0))
        .when((na == 0) | (nb == 0), F.lit(1.0))
        .otherwise(1 - F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + eps))
    )


def delta_greedy(a: Column, b: Column, eps: float = 1e-5) -> Column:
    """Change between two detection lists: the first list's detections, in order, each take the unused detection of
    their class with the largest overlap (the earliest of equals); overlaps above 0.3 match.  NULL counts as empty."""
    na, nb = F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.size(b), F.lit(0)), F.lit(0))

    def step(acc, e):
        def better(best, j):
            o = F.element_at(b, (j + 1).cast("int"))
            over = iou(e["bbox"], o["bbox"])
            take = ~F.array_contains(acc["used"], j) & e["class_id"].eqNullSafe(o["class_id"]) & (over > best["iou"])
            return F.when(take, F.struct(over.alias("iou"), j.alias("j"))).otherwise(best)

        start = F.struct(F.lit(0.0).alias("iou"), F.lit(-1).alias("j"))
        best = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, better)
        hit = best["iou"] > IOU_MATCH
        return F.struct(
            F.when(hit, acc["matched"] + 1).otherwise(acc["matched"]).alias("matched"),
            F.when(hit, F.concat(acc["used"], F.array(best["j"]))).otherwise(acc["used"]).alias("used"),
        )

    zero = F.struct(F.lit(0).alias("matched"), F.array().cast("array<int>").alias("used"))
    matched = F.aggregate(a, zero, step)["matched"]
    return (
        F.when((na == 0) & (nb == 0), F.lit(0.0)).when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - matched / (F.greatest(na, nb) + eps))
    )
