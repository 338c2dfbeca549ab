"""The public calls: files to hits, hits to clusters, clusters to neutrons, as lazy DataFrames."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.config import AlgorithmParams, ClusteringConfig, ConfigError, DetectorConfig, ExtractionConfig, OutOfCoreConfig, algorithm
from pixelspark.operators import clustering, extraction, ordering
from pixelspark.plans.checkpoints import tabled

SETTINGS = "settings"
PARAMS = ("abs_scan_interval", "dbscan_min_points", "grid_cell_size")
MEMORY = ("memory_fraction", "memory_budget_bytes", "parallelism", "queue_depth", "async_io")


def _settings(options: dict, streaming: bool) -> tuple[str, AlgorithmParams, bool]:
    """Checks the keyword options; (algorithm, its parameters, whether pulses are clustered on their own)."""
    unknown = set(options) - {"algorithm", "time_ordered", "out_of_core", *PARAMS, *MEMORY}
    if unknown:
        raise ConfigError(f"unknown options: {', '.join(sorted(unknown))}")
    time_ordered = options.get("time_ordered", True)
    if streaming and not time_ordered:
        raise ConfigError("streaming needs time_ordered")
    memory = {k: options[k] for k in MEMORY if options.get(k) is not None}
    out_of_core = options.get("out_of_core")
    if out_of_core and not streaming:
        raise ConfigError("out_of_core needs streaming")
    if memory and not out_of_core:
        raise ConfigError(f"{', '.join(memory)} need out_of_core")
    OutOfCoreConfig(**memory)
    return algorithm(options.get("algorithm", "abs")), AlgorithmParams(**{k: options[k] for k in PARAMS if k in options}), time_ordered


def read_hits(spark: SparkSession, path: str, detector: DetectorConfig | None = None, late_hits: bool = True, output_path: str | None = None) -> DataFrame:
    """The hits of the files at a path; with output_path they are written there as Parquet and read from there."""
    hits = ordering.read_files(spark, path, detector, late_hits)
    if output_path:
        hits.write.mode("overwrite").parquet(output_path)
        hits = spark.read.parquet(output_path)
    return with_metadata(hits, {"detector": (detector or DetectorConfig()).to_dict(), "path": path})


PULSE_ROWS = "file string, ext_tdc long, n long, data binary"


def pulse_rows(hits: DataFrame) -> DataFrame:
    """file, ext_tdc, n, data: a row per pulse, in order, with its hits as an Arrow stream. One pass: pulses are dealt by
    ranges of (file, ext_tdc) and sorted within."""

    def run(batches):
        import pyarrow as pa

        def row(parts: list) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            first = table.slice(0, 1).to_pylist()[0]
            return pa.RecordBatch.from_pydict({"file": [first["file"]], "ext_tdc": [first["ext_tdc"]], "n": [table.num_rows], "data": [sink.getvalue().to_pybytes()]})

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ext = batch.column("ext_tdc").to_numpy()
            name = batch.column("file").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((ext[1:] != ext[:-1]) | (name[1:] != name[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ext)], strict=True):
                now = (name[a], int(ext[a]))
                if now != key and held:
                    yield row(held)
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield row(held)

    dealt = hits.repartitionByRange("file", "ext_tdc").sortWithinPartitions("file", "ext_tdc", "tof", "chip_id", "packet_idx")
    return dealt.mapInArrow(run, PULSE_ROWS)


def stream_hits(spark: SparkSession, path: str, detector: DetectorConfig | None = None) -> Iterator:
    """The hits of one pulse after another, as Arrow tables with metadata. One job reads, the driver holds a partition's pulses."""
    import pyarrow as pa

    for r in pulse_rows(read_hits(spark, path, detector)).toLocalIterator(prefetchPartitions=True):
        table = pa.ipc.open_stream(r.data).read_all()
        yield table.replace_schema_metadata({"file": r.file, "ext_tdc": str(r.ext_tdc), "n_hits": str(r.n)})


def cluster_hits(hits: DataFrame, clustering_config: ClusteringConfig | None = None, scope: str = "pulse", **options) -> DataFrame:
    """scope "file" clusters a file's hits in one go: times restart with each pulse, so pulses may run together."""
    name, params, _ = _settings(options, False)
    keys = ("file", "ext_tdc") if scope == "pulse" else ("file",)
    return clustering.cluster_hits(hits, clustering_config, name, params, keys)


def neutrons_from(hits: DataFrame, clustering_config: ClusteringConfig | None = None, extraction_config: ExtractionConfig | None = None, **options) -> DataFrame:
    """Neutrons of hits. out_of_core: pulses are cut at gaps in time into slices of about as many hits as the memory options allow,
    each clustered on its own; no cluster spans such a gap, so nothing is emitted twice or lost. Adds slice_no."""
    name, params, ordered = _settings(options, bool(options.get("out_of_core")))
    clustering_config, extraction_config = clustering_config or ClusteringConfig(), extraction_config or ExtractionConfig()
    keys = ("file", "ext_tdc") if ordered else ("file",)
    if options.get("out_of_core"):
        most = OutOfCoreConfig(**{k: options[k] for k in MEMORY if options.get(k) is not None}).max_records_per_slice
        hits, keys = ordering.gap_slices(hits, clustering_config.window_ticks, most), (*keys, "slice_no")
    return extraction.extract_neutrons(clustering.cluster_hits(hits, clustering_config, name, params, keys), extraction_config, keys)


def neutrons_of(packets: DataFrame, detector: DetectorConfig | None = None, clustering_config: ClusteringConfig | None = None, extraction_config: ExtractionConfig | None = None, **options) -> DataFrame:
    return neutrons_from(ordering.read_hits(packets, detector), clustering_config, extraction_config, **options)


def process_neutrons(spark: SparkSession, path: str, detector: DetectorConfig | None = None, clustering_config: ClusteringConfig | None = None, extraction_config: ExtractionConfig | None = None, output_path: str | None = None, collect: bool = False, **options) -> DataFrame:
    """Neutrons of the files at a path, lazily. collect: they are worked out once, to a table that is read back."""
    name, _, _ = _settings(options, not collect)
    out = neutrons_from(read_hits(spark, path, detector), clustering_config, extraction_config, **options)
    if output_path:
        from pixelspark.sources.sinks import write_neutrons

        write_neutrons(out, output_path)
    out = tabled(out) if collect else out
    return with_metadata(out, metadata(detector or DetectorConfig(), clustering_config or ClusteringConfig(), extraction_config or ExtractionConfig(), name))


def stream_neutrons(spark: SparkSession, path: str, write, **options):
    from pixelspark.streaming.pulses import stream_neutrons as start

    return start(spark, path, write, **options)


def metadata(detector: DetectorConfig, clustering_config: ClusteringConfig, extraction_config: ExtractionConfig, name: str) -> dict:
    return {"detector": detector.to_dict(), "clustering": clustering_config.to_dict(), "extraction": extraction_config.to_dict(), "algorithm": algorithm(name)}


def with_metadata(df: DataFrame, values: dict) -> DataFrame:
    """The table with the settings it was made by, as metadata of its first column (see metadata_of)."""
    first, *rest = df.columns
    return df.select(F.col(first).alias(first, metadata={SETTINGS: json.dumps(values)}), *rest)


def metadata_of(df: DataFrame) -> dict:
    return json.loads(df.schema.fields[0].metadata.get(SETTINGS, "{}"))


class Job:
    """Work that can be watched and stopped: `with Job(spark, "name") as job: ...`; another thread asks progress() or calls cancel()."""

    def __init__(self, spark: SparkSession, name: str):
        self.context, self.name, self.group = spark.sparkContext, name, f"pixelspark-{uuid.uuid4().hex}"

    def __enter__(self) -> Job:
        self.context.setJobGroup(self.group, self.name, interruptOnCancel=True)
        return self

    def __exit__(self, *failed) -> None:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.context.setLocalProperty(key, None)

    def cancel(self) -> None:
        self.context.cancelJobGroup(self.group)

    def progress(self) -> tuple[int, int]:
        """(tasks done, tasks) of the stages that are known so far."""
        tracker, done, total = self.context.statusTracker(), 0, 0
        for number in tracker.getJobIdsForGroup(self.group):
            job = tracker.getJobInfo(number)
            for stage in job.stageIds if job else ():
                if info := tracker.getStageInfo(stage):
                    done, total = done + info.numCompletedTasks, total + info.numTasks
        return done, total
