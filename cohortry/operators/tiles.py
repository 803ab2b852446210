"""Tile grids over slides: coordinates, tissue masks, coverage by summed-area tables, sweeps and representativeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(slides: DataFrame, tile: Column, overlap: float = 0.0, padding: bool = True) -> DataFrame:
    """(slide columns, tile, x, y) of every tile of slides with ``width`` and ``height``; full tiles only without padding."""
    sized = slides.withColumn("tile", tile.cast("int")).withColumn("stride", (F.col("tile") * (1 - overlap)).cast("int"))
    end = lambda side: (F.col(side) - 1) if padding else (F.col(side) - F.col("tile"))
    places = lambda side: F.when(end(side) >= 0, F.sequence(F.lit(0), F.greatest(end(side), F.lit(0)).cast("int"), F.col("stride"))).otherwise(F.array().cast("array<int>"))
    rows = sized.withColumn("y", F.explode(places("height")))
    return rows.withColumn("x", F.explode(places("width"))).drop("stride")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luminance of 8-bit channels, from 0 to 1."""
    return (r * 0.2989 + g * 0.5870 + b * 0.1140) / 255.0


def saturation(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    return (high - low) / (high + 1e-8)


def tissue(value: Column, sat: Column, threshold: Column, median: Column, least_saturation: float = 0.05) -> Column:
    """Brighter than the threshold on dark slides (median below 0.3), else darker; and saturated enough."""
    return F.when(median < 0.3, value > threshold).otherwise(value < threshold) & (sat > least_saturation)


def summed_area(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, total) with total = tissue pixels in the rectangle from the origin up to and including (x, y)."""
    along = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return mask.withColumn("_row", F.sum(F.col("tissue").cast("long")).over(along)).withColumn("total", F.sum("_row").over(down)).select(*keys, "x", "y", "total")


def coverage(tiles: DataFrame, mask: DataFrame, keys: list[str], mask_width: int, mask_height: int) -> DataFrame:
    """Tiles with ``fraction``: the share of tissue in their part of the mask, read from four corners of its table.

    Corners are cut to whole mask pixels; a tile that covers none has a base of 1.
    """
    corner = lambda place, side, size: F.least(F.greatest((place / F.col(side) * size).cast("int"), F.lit(0)), F.lit(size))
    placed = tiles.withColumn("x1", corner(F.col("x"), "width", mask_width)).withColumn("y1", corner(F.col("y"), "height", mask_height))
    placed = placed.withColumn("x2", corner(F.col("x") + F.col("tile"), "width", mask_width)).withColumn("y2", corner(F.col("y") + F.col("tile"), "height", mask_height))
    table = summed_area(mask, keys)
    out = placed
    for name, cx, cy in (("a", "x2", "y2"), ("b", "x2", "y1"), ("c", "x1", "y2"), ("d", "x1", "y1")):
        side = table.select(*keys, (F.col("x") + 1).alias(cx), (F.col("y") + 1).alias(cy), F.col("total").alias(f"_{name}"))
        out = out.join(side, [*keys, cx, cy], "left")
    total = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0)) - F.coalesce("_c", F.lit(0)) + F.coalesce("_d", F.lit(0))
    area = F.greatest((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(1))
    return out.withColumn("fraction", total / area).drop("x1", "x2", "y1", "y2", "_a", "_b", "_c", "_d")


def keep_covered(tiles: DataFrame, threshold: float) -> DataFrame:
    return tiles.where(F.col("fraction") >= threshold)


def sweep(tiles: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, discarded, pct_kept) at each threshold, in one pass over the tiles."""
    rows = tiles.select("fraction", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    kept = F.count_if(F.col("fraction") >= F.col("threshold"))
    return rows.groupBy("threshold").agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("discarded"), (kept * 100.0 / F.count(F.lit(1))).alias("pct_kept"))


def bad_patch(black_share: Column, mean: Column, zero_share: Column) -> Column:
    return (black_share > 0.9) | (mean < 20) | (zero_share > 0.8)


def representativeness(metrics: DataFrame, columns: list[str], key: str, k: int = 3) -> DataFrame:
    """The ``k`` rows nearest to the medians: mean distance in population deviations, ties by key."""
    facts = metrics.agg(*[F.median(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    score = sum((F.abs(F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-8) for c in columns), F.lit(0.0)) / len(columns)
    return metrics.join(F.broadcast(facts)).select(key, score.alias("score")).orderBy("score", key).limit(k)


def extent(tiles: DataFrame, keys: list[str]) -> DataFrame:
    return tiles.groupBy(*keys).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count(F.lit(1)).alias("n_tiles"))


def output_stem(parent: Column, stem: Column) -> Column:
    return F.concat(parent, F.lit("__"), stem)
