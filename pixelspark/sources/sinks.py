"""Sinks: neutrons as CSV, packed records or Parquet; event and histogram layouts; images, spectra and masks.

The native layout of events and histograms is Parquet (a table each for events, pulses, bins and axes, and a JSON of
attributes). HDF5 itself is not written, as no library for it is at hand. Images and spectra are bounded by the detector's size
and number of bins and are written from the driver.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelspark.config import TICK_NS, ConfigError, DataError
from pixelspark.functions import energy
from pixelspark.sources.files import Shared

NEUTRON_COLUMNS = ("x", "y", "tof", "tot", "n_hits", "chip_id")
#: The 28-byte record, little-endian.
RECORD = np.dtype([("x", "<f8"), ("y", "<f8"), ("tof", "<u4"), ("tot", "<u2"), ("n_hits", "<u2"), ("chip_id", "u1"), ("pad", "V3")])
I32 = (1 << 31) - 1


def neutrons_csv(neutrons: DataFrame, path: str, header: bool = True, one_file: bool = False) -> None:
    """A folder of files, each with the header, or one file with the header once, whose lines come in pulse order through the driver."""
    if not one_file:
        neutrons.select(*NEUTRON_COLUMNS).write.mode("overwrite").csv(path, header=header)
        return
    text = in_pulse_order(neutrons).select(F.to_csv(F.struct(*NEUTRON_COLUMNS)).alias("line"))

    def lines() -> Iterator[bytes]:
        if header:
            yield (",".join(NEUTRON_COLUMNS) + "\n").encode()
        held: list[str] = []
        for r in text.toLocalIterator(prefetchPartitions=True):
            held.append(r.line)
            if len(held) >= 10_000:
                yield ("\n".join(held) + "\n").encode()
                held = []
        if held:
            yield ("\n".join(held) + "\n").encode()

    Shared(neutrons.sparkSession, path).write(path, lines())


def records(neutrons: DataFrame) -> DataFrame:
    """n, bytes: packed records, one row per Arrow batch, in the order of the rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = np.zeros(batch.num_rows, RECORD)
            for name in NEUTRON_COLUMNS:
                out[name] = batch.column(name).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [out.tobytes()]})

    return neutrons.select(*NEUTRON_COLUMNS).mapInArrow(run, "n long, bytes binary")


def from_records(packed: DataFrame) -> DataFrame:
    """The neutrons of records()."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for data in batch.column("bytes"):
                rows = np.frombuffer(data.as_buffer(), RECORD)
                yield pa.RecordBatch.from_arrays([pa.array(rows[n].astype("f8" if n in "xy" else "i8")) for n in NEUTRON_COLUMNS], names=list(NEUTRON_COLUMNS))

    return packed.select("bytes").mapInArrow(run, "x double, y double, tof long, tot long, n_hits long, chip_id long")


def in_pulse_order(neutrons: DataFrame) -> DataFrame:
    """Dealt by ranges of the pulse and sorted within: partition after partition gives the order of pulses."""
    keys = [c for c in ("file", "ext_tdc", "slice_no") if c in neutrons.columns]
    within = [c for c in ("cluster_id", "tof") if c in neutrons.columns]
    return neutrons.repartitionByRange(*keys).sortWithinPartitions(*keys, *within) if keys else neutrons


def neutrons_binary(neutrons: DataFrame, path: str) -> None:
    """One file of records in pulse order. The driver holds one Arrow batch at a time."""
    rows = records(in_pulse_order(neutrons)).toLocalIterator(prefetchPartitions=True)
    Shared(neutrons.sparkSession, path).write(path, (bytes(r.bytes) for r in rows))


def read_binary(path: str) -> np.ndarray:
    return np.fromfile(path, RECORD)


def write_neutrons(neutrons: DataFrame, path: str) -> None:
    """By the path's ending: csv, bin or dat, parquet, and records for any other."""
    match Path(path).suffix.lower():
        case ".csv":
            neutrons_csv(neutrons, path)
        case ".parquet":
            neutrons.write.mode("overwrite").parquet(path)
        case _:
            neutrons_binary(neutrons, path)


def checked(condition: Column, value: Column, message: str) -> Column:
    """value where the condition holds; an error elsewhere."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("long"))


def hit_event_ids(hits: DataFrame, x_size: int, y_size: int) -> DataFrame:
    """event_id = y * x_size + x, checked to fit 32 bits."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    event_id = checked((x < x_size) & (y < y_size), y * x_size + x, "a hit lies outside the detector")
    return hits.withColumn("event_id", checked(event_id <= I32, event_id, "event_id exceeds 32 bits").cast("int"))


def normal_resolution(factor: float) -> float:
    return factor if math.isfinite(factor) and factor > 0 else 1.0


def neutron_event_ids(neutrons: DataFrame, x_size: int, y_size: int, super_resolution: float) -> DataFrame:
    scale = normal_resolution(super_resolution)
    rounded = [F.round(F.col(c) / scale) for c in ("x", "y")]
    fine = ~F.isnan("x") & ~F.isnan("y") & (rounded[0] >= 0) & (rounded[1] >= 0) & (rounded[0] < x_size) & (rounded[1] < y_size)
    event_id = checked(fine, rounded[1].cast("long") * x_size + rounded[0].cast("long"), "a neutron lies outside the detector")
    return neutrons.withColumn("event_id", checked(event_id <= I32, event_id, "event_id exceeds 32 bits").cast("int"))


def event_columns(events: DataFrame, names: tuple[str, ...] = ("time_over_threshold", "chip_id", "cluster_id", "n_hits", "x", "y")) -> DataFrame:
    """event_id, event_time_offset in ns and the optional columns asked for, in pulse order."""
    made = {"time_over_threshold": (F.col("tot") * TICK_NS).cast("long")}
    kept = [made.get(n, F.col(n)).alias(n) for n in names if n in made and "tot" in events.columns or n in events.columns]
    return events.select("file", "ext_tdc", "event_id", (F.col("tof") * TICK_NS).cast("long").alias("event_time_offset"), *kept)


def pulse_index(events: DataFrame) -> DataFrame:
    """file, ext_tdc, event_time_zero (ns, at most the largest 64-bit number), event_index: events of all pulses before."""
    return index_of(events.groupBy("file", "ext_tdc").agg(F.count("*").alias("n")))


def index_of(counts: DataFrame) -> DataFrame:
    """pulse_index from the number n of events of each pulse."""
    before = Window.partitionBy("file").orderBy("ext_tdc").rowsBetween(Window.unboundedPreceding, -1)
    most = (1 << 63) - 1
    zero = F.when(F.col("ext_tdc") > most // 25, F.lit(most)).otherwise(F.col("ext_tdc") * 25)
    return counts.select("file", "ext_tdc", zero.alias("event_time_zero"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("event_index"))


EVENT_BLOCK = 1 << 16


def event_pulse(events: DataFrame, index: DataFrame) -> DataFrame:
    """The pulse of numbered events (file, event_no): the last one that begins at or before it.

    Events are cut into blocks by number, and each pulse stands in the blocks that it reaches into, so no window is
    longer than a block. Of pulses that begin at one number (those before the last are empty) the last one has the events.
    """
    block = lambda c: F.floor(F.col(c) / EVENT_BLOCK)
    order = Window.partitionBy("file").orderBy("event_index", "ext_tdc")  # over pulses, not events
    end = F.lead("event_index").over(order)
    last = events.groupBy("file").agg(F.max("event_no").alias("_most"))
    marks = index.select("file", "ext_tdc", "event_index", end.alias("_end")).join(last, "file")
    marks = marks.withColumn("_end", F.coalesce(F.col("_end") - 1, F.greatest("_most", "event_index"))).where("_end >= event_index")
    marks = marks.withColumn("_block", F.explode(F.sequence(block("event_index"), block("_end"))))
    marks = marks.select("file", "_block", F.greatest("event_index", F.col("_block") * EVENT_BLOCK).alias("event_no"), F.lit(0).alias("_o"), "ext_tdc")
    rows = events.select("file", block("event_no").alias("_block"), "event_no", F.lit(1).alias("_o"), F.lit(None).cast("long").alias("ext_tdc"))
    within = Window.partitionBy("file", "_block").orderBy("event_no", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(rows).withColumn("ext_tdc", F.last("ext_tdc", ignorenulls=True).over(within)).where("_o = 1").select("file", "event_no", "ext_tdc")


def axis(name: str, values: list[float], n: int) -> dict:
    """An axis with its mode: n values are centers, n + 1 edges."""
    if len(values) not in (n, n + 1):
        raise DataError(f"axis {name}: {len(values)} values for {n} bins")
    return {"axis": name, "mode": "centers" if len(values) == n else "edges", "values": [float(v) for v in values]}


def histogram_axes(n_bins: int, width: int, height: int, bin_width_ns: float, path_m: float | None = None, offset_ns: float | None = None) -> list[dict]:
    """rot_angle, y, x, time_of_flight (left edges, one per bin) and, where path and offset are both given, energy_ev."""
    tof = [k * bin_width_ns for k in range(n_bins)]
    out = [axis("rot_angle", [0.0], 1), axis("y", list(range(height)), height), axis("x", list(range(width)), width), axis("time_of_flight", tof, n_bins)]
    if path_m and offset_ns:
        times = [(t + offset_ns) * 1e-9 for t in tof]
        out.append(axis("energy_ev", [0.5 * energy.MASS_FILE * (path_m / t) ** 2 / energy.EV if t > 0 else 0.0 for t in times], n_bins))
    return out


def merged_attributes(*parts: dict, tolerance: float = 1e-9) -> dict:
    """Attributes of one entry; numbers may differ by the relative tolerance, all else must agree."""
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            if v is None:
                continue
            old = out.setdefault(k, v)
            same = math.isclose(old, v, rel_tol=tolerance) if isinstance(old, float) and isinstance(v, (int, float)) else old == v
            if not same:
                raise DataError(f"conflicting {k}: {old} and {v}")
    return out


def group_attributes(entry: dict, group: dict) -> dict:
    """Attributes of a group: its own before those of its entry."""
    return entry | {k: v for k, v in group.items() if v is not None}


def write_events(events: DataFrame, path: str, attributes: dict | None = None) -> None:
    """The Parquet layout: events/, pulses/ and attributes.json, written beside the path and moved there at the end."""
    spark = events.sparkSession
    disk, half = Shared(spark, path), f"{path.rstrip('/')}.partial"
    disk.delete(half)
    try:
        events.write.mode("overwrite").parquet(f"{half}/events")
        pulse_index(spark.read.schema(events.schema).parquet(f"{half}/events")).write.mode("overwrite").parquet(f"{half}/pulses")
        disk.write(f"{half}/attributes.json", json.dumps(attributes or {}).encode())
        disk.replace(half, path)
    except Exception:
        disk.delete(half)
        raise


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/pulses"), json.loads(Shared(spark, path).read(f"{path}/attributes.json"))


def write_histogram(cube: DataFrame, path: str, axes: list[dict], codec: str = "zstd") -> None:
    sizes = {a["axis"]: len(a["values"]) - (a["mode"] == "edges") for a in axes}
    if not all(sizes.get(n, 0) for n in ("y", "x", "time_of_flight")):
        raise DataError("a histogram needs bins in every dimension")
    outside = (F.col("tof_bin") >= sizes["time_of_flight"]) | (F.col("y") >= sizes["y"]) | (F.col("x") >= sizes["x"])
    guarded = cube.withColumn("count", checked(~outside, F.col("count"), "a bin lies outside the histogram")).where("count <> 0")
    guarded.write.mode("overwrite").option("compression", codec).parquet(f"{path}/bins")
    Shared(cube.sparkSession, path).write(f"{path}/axes.json", json.dumps(axes).encode())


def add_to_histogram(cube: DataFrame, path: str) -> None:
    """Adds bins to a written histogram; the old bins stand until the new ones are whole. A count stops at the largest 64-bit number."""
    from pixelspark.operators.cube import merged

    spark = cube.sparkSession
    old, axes = read_histogram(spark, path)
    half = f"{path}/bins.new"
    write_histogram(merged(old, cube), half, axes)
    Shared(spark, path).replace(f"{half}/bins", f"{path}/bins")
    Shared(spark, path).delete(half)


def read_histogram(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict]]:
    axes = json.loads(Shared(spark, path).read(f"{path}/axes.json"))
    if len([a for a in axes if a["axis"] != "energy_ev"]) != 4:
        raise DataError("a histogram has four dimensions")
    return spark.read.parquet(f"{path}/bins"), axes


def write_masks(masks: DataFrame, path: str, statistics: dict, codec: str = "zstd") -> None:
    """pixels/ (x, y, count, dead, hot) and statistics.json (mean, std_dev, threshold, sigma)."""
    masks.write.mode("overwrite").option("compression", codec).parquet(f"{path}/pixels")
    Shared(masks.sparkSession, path).write(f"{path}/statistics.json", json.dumps(statistics).encode())


def read_masks(spark: SparkSession, path: str, size: tuple[int, int] | None = None) -> tuple[DataFrame, dict]:
    """The masks of a written export; size (width, height): an error unless the masks have a row for each of its pixels."""
    masks = spark.read.parquet(f"{path}/pixels")
    if size and masks.count() != size[0] * size[1]:
        raise DataError(f"the masks are not {size[0]} x {size[1]}")
    return masks, json.loads(Shared(spark, path).read(f"{path}/statistics.json"))


def validate_export(spark: SparkSession, path: str, wants: tuple[str, ...] = ("events", "pulses")) -> list[str]:
    """What a written layout lacks (see export.validate for combined ones)."""
    disk = Shared(spark, path)
    return [f"missing {w}" for w in wants if not disk.exists(f"{path}/{w}")]


def dense(cube: DataFrame, n_bins: int, width: int, height: int) -> np.ndarray:
    """The cube as an array (tof, y, x); its size is that of the detector and bins."""
    out = np.zeros((n_bins, height, width), np.uint64)
    for b in cube.select("tof_bin", "y", "x", "count").toArrow().to_batches():
        k, y, x, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        out[k, y, x] = n.astype(np.uint64)
    return out


def tiff(images: list[np.ndarray], big: bool | None = None) -> bytes:
    """A grey-scale file of one or more uncompressed images (8, 16 or 32 bit); big: the 64-bit form, by size if None."""
    size = sum(i.nbytes for i in images) + 256 * len(images) + 16
    if big is False and size > (1 << 32) - 1:
        raise DataError("more than 4 GiB need the 64-bit form")
    big = size > (1 << 32) - 1 if big is None else big
    word = "Q" if big else "I"
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))
    link = 8 if big else 4
    for k, image in enumerate(images):
        image = np.ascontiguousarray(image)
        h, w = image.shape
        tags = [(256, w), (257, h), (258, image.itemsize * 8), (259, 1), (262, 1), (273, None), (277, 1), (278, h), (279, image.nbytes)]
        at = len(out)
        directory = (8 + 20 * len(tags) + 8) if big else (2 + 12 * len(tags) + 4)
        struct.pack_into(f"<{word}", out, link, at)
        body = bytearray(struct.pack("<Q" if big else "<H", len(tags)))
        for tag, value in tags:
            body += struct.pack(f"<HH{word}{word}", tag, 16 if big else 4, 1, at + directory if value is None else value)
        link = at + len(body)
        body += struct.pack(f"<{word}", 0)
        out += body + image.astype(image.dtype.newbyteorder("<")).tobytes()
    return bytes(out)


def image_of(counts: np.ndarray, bits: int) -> tuple[np.ndarray, list[str]]:
    """Counts cut to 16 or 32 bits, with a warning where one was."""
    most = (1 << bits) - 1
    warnings = [f"counts above {most} were cut"] if counts.size and int(counts.max()) > most else []
    return np.minimum(counts, np.uint64(most)).astype(f"<u{bits // 8}"), warnings


def spectrum_lines(spectrum: DataFrame, bin_width_ns: float, centers: bool = True, offset_ns: float = 0.0) -> DataFrame:
    """tof_bin, line: "shutter_time,counts" with seconds in scientific form, whose exponent has no plus and no leading zeros."""
    at = (F.col("tof_bin") + (0.5 if centers else 0.0)) * bin_width_ns + offset_ns
    seconds = F.regexp_replace(F.format_string("%.6e", at * 1e-9), "e([+]|(-))0*([0-9])", "e$2$3")
    return spectrum.select("tof_bin", F.concat(seconds, F.lit(","), F.col("count").cast("string")).alias("line"))


def spectrum_file(spectrum: DataFrame, bin_width_ns: float, centers: bool = True, offset_ns: float = 0.0) -> str:
    lines = [r.line for r in spectrum_lines(spectrum, bin_width_ns, centers, offset_ns).orderBy("tof_bin").collect()]
    return "\n".join(["shutter_time,counts", *lines]) + "\n"


def spectrum_text(spectrum: DataFrame, path: str, bin_width_ns: float, centers: bool = True, offset_ns: float = 0.0) -> None:
    Shared(spectrum.sparkSession, path).write(path, spectrum_file(spectrum, bin_width_ns, centers, offset_ns).encode())


def spectra_table(spectra: dict[str, DataFrame], bin_width_ms: float, path_m: float | None = None, offset_ns: float = 0.0) -> DataFrame:
    """tof_ms[, energy_ev] and a column of counts per spectrum; with a flight path, bins without energy are left out."""
    (first, table), *rest = spectra.items()
    out = table.withColumnRenamed("count", first)
    for name, s in rest:
        out = out.join(s.withColumnRenamed("count", name), "tof_bin")
    out = out.withColumn("tof_ms", F.col("tof_bin") * F.lit(float(bin_width_ms)))
    names = ["tof_ms"]
    if path_m:
        out = out.withColumn("energy_ev", energy.energy_view(F.col("tof_ms") * 1000.0, path_m, offset_ns)).where("energy_ev is not null")
        names.append("energy_ev")
    return out.select("tof_bin", *names, *spectra)


def spectra_csv(spectra: dict[str, DataFrame], path: str, bin_width_ms: float, comments: list[str] = (), path_m: float | None = None, offset_ns: float = 0.0) -> None:
    rows = spectra_table(spectra, bin_width_ms, path_m, offset_ns).orderBy("tof_bin").drop("tof_bin")
    lines = [f"# {c}" for c in comments] + [",".join(rows.columns)] + [",".join(map(str, r)) for r in rows.collect()]
    Shared(rows.sparkSession, path).write(path, ("\n".join(lines) + "\n").encode())


def plain_name(name: str) -> str:
    """energy.file_name_part of a Python string."""
    return re.sub("^_+|_+$", "", re.sub("[^A-Za-z0-9_-]", "_", name.strip()))
