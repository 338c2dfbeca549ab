"""Histograms over (tof_bin, y, x) as a sparse table, and what is read from it.

cube(tof_bin, y, x, count) holds nonzero bins only; spectra and masks fill zeros in from generated ranges. A bin's number
comes from tof / (tof_max / n_bins), the last bin taking what lies beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.functions.energy import tof_bin


def hit_cube(hits: DataFrame, tof_max: int, n_bins: int, width: int, height: int) -> DataFrame:
    inside = hits.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return inside.groupBy(tof_bin(F.col("tof"), tof_max, n_bins).alias("tof_bin"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.count("*").alias("count"))


def neutron_cube(neutrons: DataFrame, tof_max: int, n_bins: int, width: int, height: int, super_resolution: float) -> DataFrame:
    scale = super_resolution if super_resolution > 0 else 1.0
    at = neutrons.select(F.round(F.col("x") / scale).cast("int").alias("x"), F.round(F.col("y") / scale).cast("int").alias("y"), "tof")
    return hit_cube(at, tof_max, n_bins, width, height)


def merged(*cubes: DataFrame) -> DataFrame:
    """Additive merge; counts of 0 are left out, and a sum stops at the largest 64-bit number."""
    out = cubes[0]
    for c in cubes[1:]:
        out = out.unionByName(c)
    return out.where("count <> 0").groupBy("tof_bin", "y", "x").agg(F.coalesce(F.try_sum("count"), F.lit((1 << 63) - 1)).alias("count"))


def projection(cube: DataFrame) -> DataFrame:
    return cube.groupBy("y", "x").agg(F.sum("count").alias("count"))


def tof_slice(cube: DataFrame, k: int) -> DataFrame:
    return cube.where(F.col("tof_bin") == k).select("y", "x", "count")


def filled(spectrum: DataFrame, n_bins: int) -> DataFrame:
    """tof_bin, count for every bin."""
    bins = spectrum.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("tof_bin"))
    return bins.join(spectrum, "tof_bin", "left").select("tof_bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def spectrum(cube: DataFrame, n_bins: int, x_range: tuple[int, int] | None = None, y_range: tuple[int, int] | None = None) -> DataFrame:
    """Counts by time over the whole detector or a half-open rectangle."""
    for name, limits in (("x", x_range), ("y", y_range)):
        if limits is not None:
            cube = cube.where((F.col(name) >= limits[0]) & (F.col(name) < limits[1]))
    return filled(cube.groupBy("tof_bin").agg(F.sum("count").alias("count")), n_bins)


def rollups(cube: DataFrame) -> DataFrame:
    """Projection, spectrum and total in one pass: rows by grouping sets, with null in the dimensions summed over."""
    cube.createOrReplaceTempView("_cube")
    return cube.sparkSession.sql("SELECT tof_bin, y, x, SUM(count) AS count FROM _cube GROUP BY GROUPING SETS ((y, x), (tof_bin), ())")


def pixel_grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def mask_statistics(counts: DataFrame, sigma: float = 5.0) -> DataFrame:
    """One row over the pixels that have counts: mean, std_dev, threshold, sigma."""
    sigma = max(0.0, sigma)
    n, s, q = F.count("*"), F.sum("count"), F.sum(F.col("count") * F.col("count"))
    one = counts.where("count > 0").agg(n.alias("n"), s.cast("double").alias("s"), q.cast("double").alias("q"))
    one = one.select(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("mean"), "n", "q")
    one = one.withColumn("std_dev", F.when(F.col("n") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.col("mean") * F.col("mean")))).otherwise(0.0))
    return one.select("mean", "std_dev", (F.col("mean") + sigma * F.col("std_dev")).alias("threshold"), F.lit(float(sigma)).alias("sigma"))


def pixel_masks(counts: DataFrame, width: int, height: int, sigma: float = 5.0) -> DataFrame:
    """x, y, count, dead, hot of every pixel: dead without counts, hot strictly above the threshold. One broadcast row of statistics."""
    grid = pixel_grid(counts.sparkSession, width, height).join(counts, ["x", "y"], "left")
    both = grid.crossJoin(F.broadcast(mask_statistics(counts, sigma)))
    n = F.coalesce("count", F.lit(0))
    return both.select("x", "y", n.cast("long").alias("count"), (n == 0).cast("int").alias("dead"), ((n > 0) & (n > F.col("threshold"))).cast("int").alias("hot"))


def unmasked(cube: DataFrame, masks: DataFrame) -> DataFrame:
    return cube.join(masks.where("dead = 1 or hot = 1").select("x", "y"), ["x", "y"], "left_anti")


def masked_spectrum(cube: DataFrame, masks: DataFrame, n_bins: int) -> DataFrame:
    return spectrum(unmasked(cube, masks), n_bins)


def hot_points(masks: DataFrame) -> DataFrame:
    return masks.where("hot = 1").select((F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))


def dimensions(events: DataFrame) -> DataFrame:
    return events.agg((F.coalesce(F.max("x"), F.lit(-1)) + 1).cast("long").alias("width"), (F.coalesce(F.max("y"), F.lit(-1)) + 1).cast("long").alias("height"))


def clamped(counts: DataFrame, bits: int) -> DataFrame:
    """Counts as an image of 16 or 32 bits holds them, and whether one was cut."""
    most = (1 << bits) - 1
    return counts.select("y", "x", F.least("count", F.lit(most)).alias("count"), (F.col("count") > most).alias("clipped"))
