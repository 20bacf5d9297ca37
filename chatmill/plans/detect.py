"""Normalise text-detection boxes and aggregate them per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.operators.ranking import top_per_group

BOX_THRESHOLD = 0.45
MAX_CANDIDATES = 3000


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def geometry(detections: DataFrame) -> DataFrame:
    """Add ``bbox`` (xmin, ymin, xmax, ymax) and ``polygon`` from the JSON ``box``.

    A box is four numbers, whose corners become the polygon, or a list of points,
    whose extremes become the bounding box.
    """
    box = F.col("box")
    is_points = box.rlike(r"^\s*\[\s*\[")
    points = F.from_json(F.when(is_points, box), "array<array<double>>")
    flat = F.from_json(F.when(~is_points, box), "array<double>")
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(points, lambda p: F.get(p, F.lit(1)))
    x0, y0, x1, y1 = (F.get(flat, F.lit(i)) for i in range(4))  # null where a box is cut short
    corners = F.array(_point(x0, y0), _point(x0, y1), _point(x1, y1), _point(x1, y0))
    extremes = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return detections.withColumns(
        {
            "bbox": F.when(is_points, extremes).otherwise(flat),
            "polygon": F.when(
                is_points, F.transform(points, lambda p: _point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
            ).otherwise(corners),
        }
    )


def candidates(
    detections: DataFrame, threshold: float = BOX_THRESHOLD, most: int = MAX_CANDIDATES
) -> DataFrame:
    """Detections at or above the score threshold, the best ``most`` of each image."""
    good = detections.where(F.col("score") >= threshold)
    return top_per_group(
        good, ["image_id"], [F.desc("score"), F.col("det_id")], most, spread=F.col("det_id")
    )


def per_image(
    detections: DataFrame, threshold: float = BOX_THRESHOLD, most: int = MAX_CANDIDATES
) -> DataFrame:
    """The whole job: count, best score and covering box per image."""
    shaped = geometry(candidates(detections, threshold, most))
    return shaped.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("detections"),
        F.max("score").alias("max_score"),
        F.min(F.get("bbox", F.lit(0))).alias("xmin"),
        F.min(F.get("bbox", F.lit(1))).alias("ymin"),
        F.max(F.get("bbox", F.lit(2))).alias("xmax"),
        F.max(F.get("bbox", F.lit(3))).alias("ymax"),
    )
