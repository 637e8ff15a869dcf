"""Rules over tile pyramids: ratios, order and gaps of zoom levels, grids, sizes, density.

Levels of a table are compared by window functions partitioned by (file, table); a pyramid
has a few dozen levels, so a partition is small however many files there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims

TABLE = ["file", "table_name"]


def _by_zoom():
    return Window.partitionBy(*TABLE).orderBy("zoom_level")


def zoom_steps(matrix: DataFrame) -> DataFrame:
    """Each level beside the one before: ratio of pixel sizes and distance in levels."""
    w = _by_zoom()
    before = F.lag("pixel_x_size").over(w)
    return matrix.withColumns(
        {
            "px_before": before,
            "py_before": F.lag("pixel_y_size").over(w),
            "zoom_before": F.lag("zoom_level").over(w),
            "ratio": F.when(before != 0, F.col("pixel_x_size") / before),
        }
    )


def zoom_factor(matrix: DataFrame, *, ratio: float = 0.5, tolerance: float = 1e-4) -> DataFrame:
    """Per table: steps, and steps whose pixel size does not shrink by ``ratio`` (a zero before it is skipped)."""
    bad = F.abs(F.col("ratio") - ratio) > tolerance
    out = zoom_steps(matrix).groupBy(*TABLE).agg(F.count("ratio").alias("n_steps"), F.count_if(bad).alias("n_bad"))
    return out.withColumn("status", F.when(F.col("n_bad") > 0, "FAIL").when(F.col("n_steps") > 0, "PASS").otherwise("SKIPPED"))


def step_messages(matrix: DataFrame, *, tolerance: float = 1e-6) -> DataFrame:
    """Per table: the steps whose coarse pixel is not twice the fine one, as text in order of level."""
    bad = F.col("zoom_before").isNotNull() & ((F.col("pixel_x_size") <= 0) | (F.abs(F.col("px_before") / F.col("pixel_x_size") - 2) > tolerance))
    said = F.struct("zoom_level", F.concat(F.col("zoom_before"), F.lit(" to "), F.col("zoom_level")).alias("text"))
    out = zoom_steps(matrix).groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.when(bad, said))).alias("s"))
    return out.select(*TABLE, F.size("s").cast("long").alias("n_bad"), F.array_join(F.transform("s", lambda x: x["text"]), "; ").alias("steps"))


def gridded_zoom_factor(matrix: DataFrame, *, tolerance: float = 0.01) -> DataFrame:
    """Coarse over fine pixel size is 2; a zero denominator counts as factor 0 and fails."""
    factor = F.when(F.col("pixel_x_size") == 0, 0.0).otherwise(F.col("px_before") / F.col("pixel_x_size"))
    steps = zoom_steps(matrix).filter("zoom_before IS NOT NULL").withColumn("factor", F.round(factor, 4))
    return steps.groupBy(*TABLE).agg(F.count("*").alias("n_steps"), F.count_if(F.abs(F.col("factor") - 2) <= tolerance).alias("confirmed"), F.min("factor").alias("min_factor"), F.max("factor").alias("max_factor"))


def zoom_monotone(matrix: DataFrame) -> DataFrame:
    """Pixel sizes shrink strictly with zoom on both axes; tables of one level are skipped."""
    wrong = (F.col("pixel_x_size") >= F.col("px_before")) | (F.col("pixel_y_size") >= F.col("py_before"))
    out = zoom_steps(matrix).groupBy(*TABLE).agg(F.count("*").alias("n_levels"), F.count_if(wrong).alias("n_wrong")).filter("n_levels > 1")
    return out.withColumn("status", F.when(F.col("n_wrong") > 0, "FAIL").otherwise("PASS*"))


def zoom_gaps(matrix: DataFrame) -> DataFrame:
    """Missing levels between the lowest and the highest of each table."""
    levels = matrix.groupBy(*TABLE).agg(F.min("zoom_level").alias("low"), F.max("zoom_level").alias("high"), F.collect_set("zoom_level").alias("z"))
    gaps = F.array_sort(F.array_except(F.sequence("low", "high"), F.col("z")))
    return levels.select(*TABLE, "low", "high", F.size(gaps).cast("long").alias("n_gaps"), F.array_join(gaps.cast("array<string>"), ",").alias("gaps"))


def zoom_offset(matrix: DataFrame, sets: DataFrame, *, levels: int = 30) -> DataFrame:
    """Pixel sizes against the well-known grid of the table's system.

    The first level is matched to the nearest well-known level, whose offset then holds for
    all others; a first level more than half off matches nothing and fails.  The y axis of
    code 4326 is not compared.
    """
    sizes = F.broadcast(dims.pixel_sizes(matrix.sparkSession))
    w = _by_zoom()
    rows = matrix.join(sets.select(*TABLE, "srs_id"), TABLE).join(sizes, "srs_id")
    rows = rows.withColumns({"first_px": F.first("pixel_x_size").over(w), "first_zoom": F.first("zoom_level").over(w)})
    error = lambda z: F.abs(F.col("first_px") - F.col("pz0") / F.pow(F.lit(2.0), z)) / (F.col("pz0") / F.pow(F.lit(2.0), z))
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda z: F.struct(error(z).alias("e"), z.alias("z"))))
    rows = rows.withColumn("best", best).withColumn("expected", F.col("pz0") / F.pow(F.lit(2.0), F.col("zoom_level") - F.col("first_zoom") + F.col("best.z")))
    off = lambda c: F.abs(F.col(c) - F.col("expected")) / F.col("expected") > dims.PIXEL_TOLERANCE
    wrong = (F.col("best.e") > 0.5) | off("pixel_x_size") | ((F.col("srs_id") != 4326) & off("pixel_y_size"))
    return rows.groupBy(*TABLE, "srs_id").agg(F.min("best.z").alias("offset"), F.count("*").alias("n_levels"), F.count_if(wrong).alias("n_wrong"))


def grid_aligned(matrix: DataFrame, sets: DataFrame, *, levels: int = 25) -> DataFrame:
    """Per table: whether every level has the pixel size of some well-known level."""
    sizes = F.broadcast(dims.pixel_sizes(matrix.sparkSession))
    rows = matrix.join(sets.select(*TABLE, "srs_id"), TABLE).join(sizes, "srs_id")
    near = F.exists(F.sequence(F.lit(0), F.lit(levels - 1)), lambda z: F.abs(F.col("pixel_x_size") - F.col("pz0") / F.pow(F.lit(2.0), z)) / (F.col("pz0") / F.pow(F.lit(2.0), z)) <= dims.PIXEL_TOLERANCE)
    return rows.groupBy(*TABLE).agg(F.count("*").alias("total"), F.count_if(near).alias("confirmed"), F.every(near).alias("aligned"))


def tile_size(matrix: DataFrame) -> DataFrame:
    """Per table: levels whose tiles are not 256 x 256, and whether sizes vary."""
    odd = (F.col("tile_width") != dims.TILE_SIZE) | (F.col("tile_height") != dims.TILE_SIZE)
    out = matrix.groupBy(*TABLE).agg(F.count("*").alias("n_levels"), F.count_if(odd).alias("n_odd"), F.size(F.collect_set(F.struct("tile_width", "tile_height"))).cast("long").alias("n_sizes"))
    return out.withColumn("uniform", F.when(F.col("n_sizes") > 1, "FAIL").otherwise("PASS*"))


def tile_density(tiles: DataFrame) -> DataFrame:
    """Tiles present on each level in percent of the level's grid of 2^zoom x 2^zoom."""
    grid = F.pow(F.lit(4.0), F.col("zoom_level"))
    counts = tiles.groupBy(*TABLE, "zoom_level").agg(F.count("*").alias("n_tiles"))
    return counts.withColumn("percent", F.round(100 * F.col("n_tiles") / grid, 6)).withColumn("sparse", F.col("percent") < 1)


def empty_zooms(matrix: DataFrame, tiles: DataFrame) -> DataFrame:
    """Declared levels without any tile."""
    return matrix.select(*TABLE, "zoom_level").join(tiles.select(*TABLE, "zoom_level").distinct(), [*TABLE, "zoom_level"], "left_anti")


def several_zooms(tiles: DataFrame) -> DataFrame:
    """Tables with tiles on two levels or more."""
    return tiles.groupBy(*TABLE).agg(F.count_distinct("zoom_level").alias("n_zooms"), F.min("zoom_level").alias("low"), F.max("zoom_level").alias("high"), F.count("*").alias("n_tiles")).filter("n_zooms >= 2")


def bbox_in_extent(contents: DataFrame, sets: DataFrame) -> DataFrame:
    """Declared boxes against the valid area of their system, with a tolerance of 0.1 % of its size."""
    area = F.broadcast(dims.extents(contents.sparkSession))
    rows = sets.select(*TABLE, "srs_id").join(contents.drop("srs_id"), TABLE).join(area, "srs_id", "left")
    missing = F.col("min_x").isNull() | F.col("min_y").isNull() | F.col("max_x").isNull() | F.col("max_y").isNull()
    tx, ty = (F.abs(F.col(f"e_max_{a}") - F.col(f"e_min_{a}")) * 0.001 for a in "xy")
    outside = (F.col("min_x") < F.col("e_min_x") - tx) | (F.col("max_x") > F.col("e_max_x") + tx) | (F.col("min_y") < F.col("e_min_y") - ty) | (F.col("max_y") > F.col("e_max_y") + ty)
    problem = F.when(missing, "null").when((F.col("min_x") >= F.col("max_x")) | (F.col("min_y") >= F.col("max_y")), "order").when(F.col("e_min_x").isNull(), "unknown system").when(outside, "outside").otherwise("ok")
    return rows.select(*TABLE, "srs_id", problem.alias("problem"))


def bbox_within_set(contents: DataFrame, sets: DataFrame) -> DataFrame:
    """Declared boxes that lie within the box of the table's matrix set."""
    s = sets.select(*TABLE, *[F.col(c).alias(f"s_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    ok = (F.col("min_x") >= F.col("s_min_x")) & (F.col("min_y") >= F.col("s_min_y")) & (F.col("max_x") <= F.col("s_max_x")) & (F.col("max_y") <= F.col("s_max_y"))
    return contents.join(s, TABLE).groupBy("file").agg(F.count("*").alias("total"), F.count_if(ok).alias("confirmed"))


def overview_levels(width: Column, height: Column) -> Column:
    """Overview factors 2, 4, 8, ...: while the longer side over the factor exceeds one tile; at least [2], at most 8."""
    side = F.greatest(width, height)
    factors = F.filter(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.pow(F.lit(2.0), i).cast("int")), lambda f: F.floor(side / f) > dims.TILE_SIZE)
    return F.when(F.size(factors) > 0, factors).otherwise(F.array(F.lit(2)))
