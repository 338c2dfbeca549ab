"""Combined exports: hits, neutrons, histogram and masks under one folder, checked after writing; and sinks that grow.

The layout is that of sinks (Parquet and JSON): {hits,neutrons}/{events,pulses}, histogram/{bins,axes.json},
pixel_masks/{pixels,statistics.json} and attributes.json. Everything is written beside the target and moved there when it is
whole, on whatever file system Spark writes to.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.config import ConfigError, DataError
from pixelspark.operators import cube
from pixelspark.sources import sinks
from pixelspark.sources.files import Shared

#: What a table of events needs, and the rows of a Parquet row group unless asked otherwise.
REQUIRED = ("event_id", "event_time_offset")
PULSES = ("event_time_zero", "event_index")
CHUNK_EVENTS = 100_000


@dataclass(frozen=True)
class ExportOptions:
    """What to write. compression: 0 (none) to 9; a flight path counts if above 0, a time offset if not 0."""

    hits: bool = True
    neutrons: bool = False
    histogram: bool = False
    pixel_masks: bool = False
    xy: bool = False
    tot: bool = True
    chip_id: bool = True
    cluster_id: bool = False
    n_hits: bool = False
    compression: int = 1
    chunk_events: int = CHUNK_EVENTS
    flight_path_m: float = 0.0
    tof_offset_ns: float = 0.0
    super_resolution: float = 1.0

    to_dict = asdict

    @property
    def flight_path(self) -> float | None:
        return self.flight_path_m if self.flight_path_m > 0 else None

    @property
    def offset(self) -> float | None:
        return self.tof_offset_ns if self.tof_offset_ns != 0 else None

    @property
    def codec(self) -> str:
        return "zstd" if self.compression > 0 else "uncompressed"

    def columns(self, kind: str) -> tuple[str, ...]:
        own = [("time_over_threshold", self.tot), ("chip_id", self.chip_id), ("cluster_id", self.cluster_id and kind == "hits"), ("n_hits", self.n_hits and kind == "neutrons"), ("x", self.xy), ("y", self.xy)]
        return tuple(name for name, wanted in own if wanted)


@dataclass
class ExportData:
    """What there is to write. Hits without ext_tdc are one pulse at 0, as neutrons always are; counts is a histogram cube."""

    hits: DataFrame | None = None
    neutrons: DataFrame | None = None
    counts: DataFrame | None = None
    masks: DataFrame | None = None
    mask_statistics: dict | None = None
    size: tuple[int, int] | None = None  # of the detector; from the hits if None
    n_bins: int = 0
    bin_width_ns: float = 0.0
    attributes: dict = field(default_factory=dict)


def _size(data: ExportData, events: DataFrame, scale: float) -> tuple[int, int]:
    if data.size:
        return data.size
    found = cube.dimensions(events.select((F.round(F.col("x") / scale)).cast("long").alias("x"), F.round(F.col("y") / scale).cast("long").alias("y"))).first()
    return int(found.width), int(found.height)


def _writer(df: DataFrame, options: ExportOptions):
    # a row group holds about chunk_events rows of some 40 bytes each
    return df.write.mode("overwrite").option("compression", options.codec).option("parquet.block.size", max(1 << 16, options.chunk_events * 40))


def prepared_hits(data: ExportData, options: ExportOptions) -> DataFrame:
    if data.hits is None:
        raise DataError("no hits loaded")
    hits = data.hits
    if hits.isEmpty():
        raise DataError("no hits to export")
    hits = hits if "ext_tdc" in hits.columns else hits.withColumn("ext_tdc", F.lit(0).cast("long"))
    hits = hits if "file" in hits.columns else hits.withColumn("file", F.lit(""))
    return sinks.event_columns(sinks.hit_event_ids(hits, *_size(data, hits, 1.0)), options.columns("hits"))


def prepared_neutrons(data: ExportData, options: ExportOptions) -> DataFrame:
    if data.neutrons is None or data.neutrons.isEmpty():
        raise DataError("no neutrons available")
    scale = sinks.normal_resolution(options.super_resolution)
    found = sinks.neutron_event_ids(data.neutrons, *_size(data, data.neutrons, scale), scale)
    return sinks.event_columns(found.withColumn("file", F.lit("")).withColumn("ext_tdc", F.lit(0).cast("long")), options.columns("neutrons"))


def export(spark: SparkSession, data: ExportData, path: str, options: ExportOptions, progress: Callable[[float, str], None] = lambda share, what: None) -> tuple[int, list[str]]:
    """(bytes written, warnings). Whatever fails, nothing is left at the path but what stood there."""
    if not (options.hits or options.neutrons or options.histogram or options.pixel_masks):
        raise ConfigError("nothing is selected for export")
    disk, half = Shared(spark, path), f"{path.rstrip('/')}.partial"
    disk.delete(half)
    try:
        for share, kind, wanted, prepare in ((0.15, "hits", options.hits, prepared_hits), (0.35, "neutrons", options.neutrons, prepared_neutrons)):
            if wanted:
                progress(share, f"preparing {kind}")
                events = prepare(data, options)
                _writer(events, options).parquet(f"{half}/{kind}/events")
                _writer(sinks.pulse_index(spark.read.parquet(f"{half}/{kind}/events")), options).parquet(f"{half}/{kind}/pulses")
        if options.histogram:
            progress(0.55, "preparing histogram")
            if data.counts is None:
                raise DataError("no histogram data available")
            axes = sinks.histogram_axes(data.n_bins, *(data.size or (0, 0)), data.bin_width_ns, options.flight_path, options.offset)
            sinks.write_histogram(data.counts, f"{half}/histogram", axes, options.codec)
        if options.pixel_masks:
            progress(0.7, "preparing pixel masks")
            if data.masks is None:
                raise DataError("no pixel masks available")
            sinks.write_masks(data.masks, f"{half}/pixel_masks", data.mask_statistics or {}, options.codec)
        progress(0.85, "writing")
        own = {"flight_path_m": options.flight_path, "tof_offset_ns": options.offset, "energy_axis_kind": "tof"}
        disk.write(f"{half}/attributes.json", json.dumps(sinks.merged_attributes(data.attributes, own)).encode())
        disk.replace(half, path)
    except Exception:
        disk.delete(half)
        raise
    progress(0.95, "checking")
    warnings = validate(spark, path, options)
    progress(1.0, "done")
    return disk.bytes(path), warnings


def validate(spark: SparkSession, path: str, options: ExportOptions) -> list[str]:
    """What a written export lacks of what was asked for: tables, columns, rows, compression."""
    disk, found = Shared(spark, path), []
    if not disk.exists(f"{path}/attributes.json"):
        raise DataError(f"{path} is no export")

    def table(at: str, names: tuple[str, ...], label: str) -> None:
        if not disk.names(f"{path}/{at}"):
            found.append(f"missing table {label}")
            return
        df = spark.read.parquet(f"{path}/{at}")
        found.extend(f"missing column {label}.{n}" for n in names if n not in df.columns)
        if df.isEmpty():
            found.append(f"{label} is empty")
        files = [n for n in disk.names(f"{path}/{at}") if n.endswith(".parquet")]
        if options.compression > 0 and not all(".zstd." in n for n in files):
            found.append(f"{label} is not compressed")

    for kind, wanted in (("hits", options.hits), ("neutrons", options.neutrons)):
        if wanted:
            table(f"{kind}/events", (*REQUIRED, *options.columns(kind)), kind)
            table(f"{kind}/pulses", PULSES, f"{kind} pulses")
    if options.histogram:
        table("histogram/bins", ("tof_bin", "y", "x", "count"), "histogram")
    if options.pixel_masks:
        table("pixel_masks/pixels", ("dead", "hot"), "pixel masks")
    return found


class EventSink:
    """Events that come a batch at a time, as write_events has them: create, then write each batch (foreachBatch).

    A batch has its number, and writing it again replaces it, so a stream may repeat a batch after a failure. Pulses
    are kept by batch with their counts; pulses() gives the index over all that is written.
    """

    def __init__(self, spark: SparkSession, path: str, attributes: dict | None = None):
        self.spark, self.path, self.disk = spark, path.rstrip("/"), Shared(spark, path)
        self.disk.delete(self.path)
        self.disk.folder(f"{self.path}/events")
        self.disk.write(f"{self.path}/attributes.json", json.dumps(attributes or {}).encode())

    def write(self, events: DataFrame, number: int) -> None:
        at, counts = f"{self.path}/events/batch={number}", f"{self.path}/counts/batch={number}"
        events.write.mode("overwrite").parquet(at)
        own = self.spark.read.schema(events.schema).parquet(at)
        own.groupBy("file", "ext_tdc").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(counts)

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events").drop("batch")

    def pulses(self) -> DataFrame:
        counts = self.spark.read.parquet(f"{self.path}/counts").groupBy("file", "ext_tdc").agg(F.sum("n").alias("n"))
        return sinks.index_of(counts)


def tiff_export(spark: SparkSession, counts: DataFrame, folder: str, base: str, size: tuple[int, int], n_bins: int, bin_width_ns: float, bits: int = 16, stack: bool = False, big: bool | None = None, spectra: bool = True, summed: bool = True, masks: DataFrame | None = None, exclude_masked: bool = False, centers: bool = True, offset_ns: float = 0.0) -> tuple[int, list[str]]:
    """Images of each time bin (a folder of files or one stack), with the spectrum and the summed image beside them.

    The folder must be new and goes again if anything fails. The cube's size is the detector's, so images are made on the driver.
    """
    base = sinks.plain_name(base)
    if not base:
        raise ConfigError("a base name is needed")
    if not n_bins:
        raise DataError("no time bins to export")
    disk = Shared(spark, folder)
    if disk.exists(folder):
        raise DataError(f"{folder} exists")
    disk.folder(folder)
    warnings: list[str] = []
    cut = False
    try:
        if spectra:
            own = cube.spectrum(counts, n_bins)
            if exclude_masked and (masks is None or masks.count() != size[0] * size[1]):
                warnings.append("no mask fits the histogram; the full spectrum is written")
            elif exclude_masked:
                own = cube.masked_spectrum(counts, masks, n_bins)
            disk.write(f"{folder}/{base}_Spectra.txt", sinks.spectrum_file(own, bin_width_ns, centers, offset_ns).encode())
        images = sinks.dense(counts, n_bins, *size)
        if summed:
            image, over = sinks.image_of(images.sum(axis=0), bits)
            cut |= bool(over)
            disk.write(f"{folder}/{base}_SummedImg.tif", sinks.tiff([image]))
        shown = []
        for k, one in enumerate(images):
            image, over = sinks.image_of(one, bits)
            cut |= bool(over)
            if stack:
                shown.append(image)
            else:
                disk.write(f"{folder}/{base}_{k:05d}.tif", sinks.tiff([image]))
        if stack:
            disk.write(f"{folder}/{base}_stack.tif", sinks.tiff(shown, big))
    except Exception:
        disk.delete(folder)
        raise
    return disk.bytes(folder), warnings + ([f"counts above {(1 << bits) - 1} were cut"] if cut else [])


class SpectraCache:
    """Spectra by what they are made of (a region's shape, a revision of the data), worked out once each."""

    def __init__(self):
        self.revision, self.held = None, {}

    def get(self, revision, shape, make: Callable[[], DataFrame]) -> list[tuple]:
        if revision != self.revision:
            self.revision, self.held = revision, {}
        key = json.dumps(shape, sort_keys=True, default=str)
        if key not in self.held:
            self.held[key] = [tuple(r) for r in make().orderBy("tof_bin").collect()]  # a row per time bin
        return self.held[key]


__all__ = ["EventSink", "ExportData", "ExportOptions", "SpectraCache", "export", "tiff_export", "validate"]
