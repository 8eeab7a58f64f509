"""Synthetic elevation polyline of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin import constants as C
from stagekin.plans.skew import HOT_ROWS, lookup_join, row_number_within, written

_LAST = 1 << 40


def usable_climbs(climbs: DataFrame) -> DataFrame:
    """Climbs with a summit other than 0 (0 means unknown here), a length and a position."""
    return climbs.filter(
        (F.col("top_elevation_m") != 0) & F.col("length_km").isNotNull() & F.col("km_before_finish").isNotNull()
    )


def elevation_points(
    stages: DataFrame, climbs: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(stage_id, point_no, km, elevation): start, foot and summit of each climb, finish.

    Points are rows throughout, never an array per stage; they are numbered by km, and in course
    order where the km is equal. A stage without usable climbs is flat at 0.
    """
    usable = usable_climbs(climbs)
    peaks = usable.groupBy("stage_id").agg(F.max("top_elevation_m").alias("peak"), F.count("*").alias("usable"))
    lines = written(
        stages.filter(F.col("distance_km").isNotNull())
        .select("stage_id", F.col("distance_km").cast("double").alias("distance"))
        .join(peaks, "stage_id", "left")
        .select(
            "stage_id",
            "distance",
            F.coalesce(F.col("peak") * C.VALLEY_SHARE, F.lit(0.0)).alias("valley"),
            F.coalesce("usable", F.lit(0)).alias("usable"),
        ),
        "lines",
    )

    def point(order, km, elevation):
        return F.struct(
            order.cast("bigint").alias("seq"), km.cast("double").alias("km"), elevation.cast("double").alias("elevation")
        )

    ends = F.array(
        point(F.lit(0), F.lit(0.0), F.col("valley")), point(F.lit(_LAST), F.col("distance"), F.col("valley"))
    )
    summit = F.col("distance") - F.col("km_before_finish").cast("double")
    foot = F.greatest(F.lit(0.0), summit - F.col("length_km").cast("double"))
    seq = F.col("climb_order").cast("bigint") * 2
    slopes = F.array(point(seq + 1, foot, F.col("valley")), point(seq + 2, summit, F.col("top_elevation_m")))
    climbing = lookup_join(
        usable.select("stage_id", "climb_order", "length_km", "km_before_finish", "top_elevation_m"),
        lines.filter(F.col("usable") > 0), ["stage_id"], "usable", ["climb_order"], "inner", hot_rows,
    )
    points = lines.select("stage_id", F.explode(ends).alias("p")).unionByName(
        climbing.select("stage_id", F.explode(slopes).alias("p"))
    )
    numbered = row_number_within(
        points.select("stage_id", "p.km", "p.seq", "p.elevation"), ["stage_id"], ["km", "seq"], "point_no",
        hot_rows, (lines.select("stage_id", (F.col("usable") * 2 + 2).alias("points")), "points"),
    )
    return numbered.select("stage_id", "point_no", "km", "elevation")


def elevation_xy(
    points: DataFrame,
    stages: DataFrame,
    width: float = C.XY_WIDTH,
    height: float = C.XY_HEIGHT,
    pad: float = C.XY_PAD,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Points scaled to a drawing box, with a flag on the first highest point (if above 0)."""
    tops = points.groupBy("stage_id").agg(
        F.max("elevation").alias("peak"),
        F.min(F.struct(-F.col("elevation"), "point_no")).getField("point_no").alias("top_no"),
        F.count("*").alias("points"),
    )
    distances = stages.select("stage_id", F.col("distance_km").cast("double").alias("distance"))
    frames = written(tops.join(distances, "stage_id"), "frames")
    joined = lookup_join(points, frames, ["stage_id"], "points", ["point_no"], "inner", hot_rows)
    distance, elevation = F.col("distance"), F.col("elevation")
    x = F.when(distance > 0, F.try_divide(F.col("km"), distance) * width).otherwise(0.0)
    y = height - pad - elevation / F.greatest(F.col("peak"), F.lit(1.0)) * (height - pad * 2)
    return joined.select(
        "stage_id",
        "point_no",
        x.alias("x"),
        y.alias("y"),
        ((F.col("point_no") == F.col("top_no")) & (elevation > 0)).alias("is_top"),
    )
