"""Clusters to neutrons: weighted and plain centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelspark.config import U16, U32, ExtractionConfig

PULSE = ("file", "ext_tdc")


def prune_small(hits: DataFrame, min_size: int, keys: tuple[str, ...] = PULSE, max_size: int | None = None) -> DataFrame:
    """Clusters of fewer hits (or, if asked for, of more) become noise; the rest are numbered anew by their first hit."""
    labelled = hits.where("cluster_id >= 0")
    sizes = labelled.groupBy(*keys, "cluster_id").agg(F.count("*").alias("_n"), F.min(F.struct("tof", "chip_id", "packet_idx")).alias("_first"))
    kept = sizes.where(F.col("_n") >= min_size)
    kept = kept if max_size is None else kept.where(F.col("_n") <= max_size)
    from pyspark.sql import Window

    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).cast("int")
    renumbered = kept.select(*keys, "cluster_id", number.alias("_id"))
    return hits.join(renumbered, [*keys, "cluster_id"], "left").withColumn("cluster_id", F.coalesce("_id", F.lit(-1))).select(*hits.columns)


def extract_neutrons(hits: DataFrame, config: ExtractionConfig | None = None, keys: tuple[str, ...] = PULSE) -> DataFrame:
    """keys, cluster_id, x, y, tof, tot, n_hits, chip_id of each cluster.

    Weak hits are left out after clustering, and clusters of weak hits vanish. Sums are exact integers, divided once. The hit
    of the greatest ToT, the last of equals, gives time and chip.
    """
    c = config or ExtractionConfig()
    kept = hits.where((F.col("cluster_id") >= 0) & (F.col("tot") >= c.min_tot_threshold))
    tot, x, y = (F.col(k).cast("long") for k in ("tot", "x", "y"))
    best = F.max_by(F.struct("tof", "chip_id"), F.struct("tot", "tof", "chip_id", "packet_idx"))
    sums = kept.groupBy(*keys, "cluster_id").agg(F.sum(tot).alias("st"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * tot).alias("sxt"), F.sum(y * tot).alias("syt"), F.count("*").alias("n"), best.alias("b"))
    scale = float(c.super_resolution_factor)

    def centre(weighted: str, plain: str):
        mean = F.col(plain) / F.col("n")
        if c.weighted_by_tot:
            mean = F.when(F.col("st") > 0, F.col(weighted) / F.least(F.col("st"), F.lit(U32))).otherwise(mean)
        return mean * scale

    return sums.select(*keys, "cluster_id", centre("sxt", "sx").alias("x"), centre("syt", "sy").alias("y"), F.col("b.tof").alias("tof"), F.least("st", F.lit(U16)).cast("int").alias("tot"), F.least("n", F.lit(U16)).cast("int").alias("n_hits"), F.col("b.chip_id").cast("int").alias("chip_id"))


def neutron_statistics(neutrons: DataFrame) -> DataFrame:
    """One row; zeros for no neutrons. The deviation is that of the population."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.count("*")
    return neutrons.agg(
        n.alias("count"), zero(F.avg("tof")).alias("mean_tof"), zero(F.stddev_pop("tof")).alias("std_tof"), zero(F.avg("tot")).alias("mean_tot"),
        zero(F.avg("n_hits")).alias("mean_cluster_size"), zero(F.avg((F.col("n_hits") == 1).cast("double"))).alias("single_hit_fraction"),
        *(F.coalesce(f(c), F.lit(0)).cast("double").alias(f"{name}_{c}") for c in ("x", "y", "tof") for name, f in (("min", F.min), ("max", F.max))),
    )


def file_info(hits: DataFrame) -> DataFrame:
    """One row per file: hits and the ranges of time and place."""
    return hits.groupBy("file").agg(F.count("*").alias("n_hits"), *(f(c).cast("long").alias(f"{name}_{c}") for c in ("tof", "x", "y") for name, f in (("min", F.min), ("max", F.max))))


def session_statistics(n_hits: int, n_neutrons: int, load_s: float | None = None, cluster_s: float | None = None, tof_max: int = 0) -> dict:
    """Hits loaded and neutrons found per second (None: not timed, 0: no time), the mean cluster size (noise hits included) and
    the end of the time range in ms."""

    def speed(n: int, seconds: float | None) -> float | None:
        return None if seconds is None else n / seconds if seconds > 0 else 0.0

    return {
        "load_speed": speed(n_hits, load_s),
        "cluster_speed": speed(n_neutrons, cluster_s),
        "avg_cluster_size": n_hits / n_neutrons if n_neutrons else 0.0,
        "tof_range_ms": tof_max * 25.0e-6 if tof_max > 0 else 0.0,
    }


def clustering_statistics(hits: DataFrame) -> DataFrame:
    """One row over clustered hits: hits_processed, clusters_found, noise_hits, largest_cluster_size, mean_cluster_size."""
    sizes = hits.groupBy(*PULSE, "cluster_id").agg(F.count("*").alias("n"))  # noise: one row per pulse
    own = F.when(F.col("cluster_id") >= 0, F.col("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sizes.agg(total(F.col("n")).alias("hits_processed"), F.count(own).alias("clusters_found"), total(F.when(F.col("cluster_id") < 0, F.col("n"))).alias("noise_hits"), F.coalesce(F.max(own), F.lit(0)).alias("largest_cluster_size"), F.coalesce(F.avg(own), F.lit(0.0)).alias("mean_cluster_size"))
