"""From packet words to time-ordered hits.

packets(file, packet_idx, raw) -> blocks -> hits(file, ext_tdc, ...).

State runs along a file: a packet's chip is that of the last header, a hit's pulse that of the chip's last time marker. Files
are cut into blocks of consecutive words. A first pass sums each block up in a row, a prefix over a file's rows gives
the state at every block's start, and a second pass resolves the blocks on their own (see words). A table of packets is dealt
by (file, block) once for both passes; of files on disk (tpx3) each pass reads byte ranges in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelspark.config import DetectorConfig
from pixelspark.functions import bits
from pixelspark.operators import words
from pixelspark.sources import tpx3

BLOCK = 1 << 18  # words: 2 MB, which stay in a core's cache


def _schema(spark: SparkSession, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _dealt(packets: DataFrame, block: int) -> DataFrame:
    return packets.select("file", F.floor(F.col("packet_idx") / block).alias("block"), "packet_idx", "raw")


def summaries(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """words.SUMMARY: a row per block of a table of packets."""
    schema = _schema(packets.sparkSession, words.SUMMARY)

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by("packet_idx")
        return pa.Table.from_pylist([words.summary(key[0].as_py(), key[1].as_py(), table["raw"].to_numpy(), table["packet_idx"].to_numpy())], schema)

    return _dealt(packets, block).groupBy("file", "block").applyInArrow(run, words.SUMMARY)


def summaries_of_files(spark: SparkSession, path: str, split_mb: float = 64, strict: bool = True) -> DataFrame:
    """words.SUMMARY: a row per block of the files at a path, read in place."""
    schema = _schema(spark, words.SUMMARY)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                for at, raw in tpx3.words_of(r["file"], r["first"], r["count"], BLOCK):
                    row = words.summary(r["file"], at // BLOCK, raw, np.arange(at, at + len(raw)))
                    yield pa.RecordBatch.from_pylist([row], schema)

    return tpx3.read_ranges(spark, path, split_mb, strict, BLOCK).mapInArrow(run, words.SUMMARY)


def _by_file(found: DataFrame, fold: Callable[[list[dict]], list[dict]], ddl: str) -> DataFrame:
    """fold over the summaries of each file: a row per block, 4,000 for 8 GB."""
    schema = _schema(found.sparkSession, ddl)

    def run(table):
        import pyarrow as pa

        rows = table.to_pylist()
        return pa.Table.from_pylist([{"file": rows[0]["file"]} | r for r in fold(rows)], schema)

    return found.groupBy("file").applyInArrow(run, ddl)


def states(found: DataFrame) -> DataFrame:
    """words.STATE: what holds at the start of each block."""
    return _by_file(found, words.prefix, words.STATE)


Kernel = Callable[[words.Block, words.State], dict]


def _table(schema, file: str, found: dict):
    import pyarrow as pa

    n = len(next(iter(found.values()))) if found else 0
    return pa.table([pa.repeat(pa.scalar(file, pa.string()), n) if f.name == "file" else pa.array(found[f.name] if n else [], f.type) for f in schema], schema=schema)


def resolved(packets: DataFrame, kernel: Kernel, ddl: str, block: int = BLOCK) -> DataFrame:
    """kernel(block of words, state at its start) -> columns, over all blocks of a table of packets."""
    schema = _schema(packets.sparkSession, ddl)

    def run(key, own, state):
        file = key[0].as_py()
        own = own.sort_by("packet_idx")
        held = words.State.load(state["state"][0].as_py())
        return _table(schema, file, kernel(words.Block(own["raw"].to_numpy(), own["packet_idx"].to_numpy(), held.chip, held.section), held))

    keys = ("file", "block")
    return _dealt(packets, block).groupBy(*keys).cogroup(states(summaries(packets, block)).groupBy(*keys)).applyInArrow(run, ddl)


def resolved_files(spark: SparkSession, path: str, kernel: Kernel, ddl: str, split_mb: float = 64, strict: bool = True) -> DataFrame:
    """The same over files at a path. Only states are dealt, a row per block; words are read where they are."""
    schema = _schema(spark, ddl)
    found = states(summaries_of_files(spark, path, split_mb, strict))
    per_task = max(1, tpx3.split_words(split_mb) // BLOCK)
    tasks = max(1, sum(-(-size // (8 * BLOCK * per_task)) for _, size, _ in tpx3.listed(path)))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                held = words.State.load(r["state"])
                for at, raw in tpx3.words_of(r["file"], r["first"], r["count"], BLOCK):
                    out = _table(schema, r["file"], kernel(words.Block(raw, np.arange(at, at + len(raw)), held.chip, held.section), held))
                    yield from out.to_batches(1 << 16)

    return found.repartition(tasks, "file", F.floor(F.col("block") / per_task)).mapInArrow(run, ddl)


# --- what blocks give ---------------------------------------------------------------------------------------------

CHIPS = "file string, packet_idx long, raw long, chip_id int, section_at long"
PULSES = "file string, chip_id int, packet_idx long, tdc long, pulse_seq long, prev_tdc long, epoch long, prev_epoch long"
ASSIGNED = "file string, chip_id int, packet_idx long, raw long, ext_tdc long, timestamp long, tof long, late boolean"
JUMPS = "file string, packet_idx long, chip_id int, kind string, previous long, timestamp long, tdcs array<array<long>>, hits array<array<long>>"


def typed(packets: DataFrame) -> DataFrame:
    """Adds kind: header, tdc, hit or null. A header is looked for first."""
    raw = F.col("raw")
    return packets.withColumn("kind", F.when(bits.is_header(raw), "header").when(bits.is_tdc(raw), "tdc").when(bits.is_hit(raw), "hit"))


def with_chip(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Packets after their file's first header, with kind, chip_id and section_at (the header's packet_idx)."""

    def kernel(b: words.Block, state: words.State) -> dict:
        known = b.chip != words.NO_CHIP
        return {"packet_idx": b.idx[known], "raw": b.raw[known], "chip_id": b.chip[known], "section_at": b.section[known]}

    return typed(resolved(packets, kernel, CHIPS, block))


def sections(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """file, section_no, chip_id, start_offset, end_offset (bytes, without the header word), initial_tdc, final_tdc.

    A section runs from its header to the next one; empty ones are dropped but a chip's last marker is handed on.
    """
    df = with_chip(packets, block)
    own = F.when(F.col("kind") == "tdc", bits.tdc_timestamp(F.col("raw")))
    per = df.where("kind is null or kind <> 'header'").groupBy("file", "chip_id", "section_at").agg(F.min("packet_idx").alias("first"), F.max("packet_idx").alias("last"), F.max_by(own, F.when(own.isNotNull(), F.col("packet_idx"))).alias("own"))
    order = Window.partitionBy("file", "chip_id").orderBy("section_at")
    before = F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    number = F.row_number().over(Window.partitionBy("file").orderBy("section_at")) - 1
    return per.withColumn("initial_tdc", before).select("file", number.cast("int").alias("section_no"), "chip_id", (F.col("section_at") * 8 + 8).alias("start_offset"), (F.col("last") * 8 + 8).alias("end_offset"), "initial_tdc", F.coalesce("own", "initial_tdc").alias("final_tdc"))


def pulses(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per time marker: its number, epoch (turns of the 30-bit counter) and predecessor, per file and chip."""
    found = resolved(packets, words.markers, PULSES, block)
    first = F.col("prev_tdc") < 0
    own = lambda c: F.when(~first, F.col(c)).alias(c)
    return found.select("file", "chip_id", "packet_idx", "tdc", "pulse_seq", own("prev_tdc"), "epoch", own("prev_epoch"), bits.extended_tdc(F.col("epoch"), F.col("tdc")).alias("ext_tdc"))


def _hits(period: int, late_hits: bool) -> Kernel:
    return lambda b, state: words.hits(b, state, period, late_hits)


def assign_pulses(packets: DataFrame, period: int, late_hits: bool = True, block: int = BLOCK) -> DataFrame:
    """Each hit with its pulse: ext_tdc, timestamp, tof, late. Hits before a chip's first marker are dropped.

    A hit that lies before the current marker belongs to the chip's previous pulse, if there is one.
    """
    return resolved(packets, _hits(period, late_hits), ASSIGNED, block)


def with_pixels(hits: DataFrame, detector: DetectorConfig) -> DataFrame:
    address = bits.pixel_address(hits.raw)
    x, y = bits.mapped(bits.local_x(address), bits.local_y(address), F.col("chip_id"), detector.chip_transformations)
    return hits.withColumn("x", x).withColumn("y", y).withColumn("tot", bits.tot(hits.raw).cast("int"))


HIT_COLUMNS = ("file", "ext_tdc", "packet_idx", "x", "y", "tof", "tot", "timestamp", "chip_id", "cluster_id")


def read_hits(packets: DataFrame, detector: DetectorConfig | None = None, late_hits: bool = True, block: int = BLOCK) -> DataFrame:
    """The hits of all files; cluster_id is -1. Pulses of different chips meet where their extended markers are equal."""
    detector = detector or DetectorConfig()
    hits = with_pixels(assign_pulses(packets, detector.period_ticks, late_hits, block), detector)
    return hits.withColumn("cluster_id", F.lit(-1)).select(*HIT_COLUMNS)


def read_files(spark: SparkSession, path: str, detector: DetectorConfig | None = None, late_hits: bool = True, split_mb: float = 64, strict: bool = True) -> DataFrame:
    """read_hits over files at a path."""
    detector = detector or DetectorConfig()
    hits = with_pixels(resolved_files(spark, path, _hits(detector.period_ticks, late_hits), ASSIGNED, split_mb, strict), detector)
    return hits.withColumn("cluster_id", F.lit(-1)).select(*HIT_COLUMNS)


def by_pulse(hits: DataFrame) -> DataFrame:
    """Pulses whole within partitions, hits in time order: no global sort."""
    return hits.repartition("file", "ext_tdc").sortWithinPartitions("file", "ext_tdc", "tof", "chip_id", "packet_idx")


def ordered(hits: DataFrame) -> DataFrame:
    return hits.orderBy("file", "ext_tdc", "tof", "chip_id", "packet_idx")


def slices(hits: DataFrame, max_hits: int, overlap: int) -> DataFrame:
    """Each pulse cut into slices of about max_hits hits; hits within `overlap` ticks after a cut come in both.

    Adds slice_no, emit_cutoff_tof and emits (tof <= cutoff). Hits of equal time stay together: a cut falls after the
    last hit of the time that the max_hits-th hit has. One streaming pass over each pulse.
    """
    import pyarrow as pa

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tof", "ascending"), ("chip_id", "ascending"), ("packet_idx", "ascending")])
        tof = table["tof"].to_numpy()
        start, parts = 0, []
        while start < len(tof):
            cutoff = tof[min(start + max_hits, len(tof)) - 1]
            end = int(np.searchsorted(tof, cutoff, "right"))
            stop = max(end, int(np.searchsorted(tof, cutoff + overlap, "right"))) if overlap and len(tof) > max_hits else end
            own = table.slice(start, stop - start)
            n = own.num_rows
            own = own.append_column("slice_no", pa.array([len(parts)] * n, pa.int32())).append_column("emit_cutoff_tof", pa.array([int(cutoff)] * n, pa.int64()))
            parts.append(own.append_column("emits", pa.array(tof[start:stop] <= cutoff)))
            start = end
        return pa.concat_tables(parts)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.schema) + ", slice_no int, emit_cutoff_tof long, emits boolean"
    return hits.groupBy("file", "ext_tdc").applyInArrow(cut, schema)


def gap_slices(hits: DataFrame, window: int, max_hits: int, keys: tuple[str, ...] = ("file", "ext_tdc")) -> DataFrame:
    """Adds slice_no: pulses cut where nothing was hit for more than `window` ticks, into slices of about max_hits hits.

    Hits that lie closer are never parted, so a cluster is never cut; a slice is longer than max_hits by its last
    stretch without a gap at most. Running windows only, which Spark streams over sorted, spillable rows.
    """
    order = Window.partitionBy(*keys).orderBy("tof", "chip_id", "packet_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = hits.withColumn("_n", F.row_number().over(order)).withColumn("_gap", F.coalesce(F.col("tof") - F.lag("tof").over(order) > window, F.lit(True)))
    begun = F.last(F.when(F.col("_gap"), F.col("_n")), ignorenulls=True).over(so_far)
    return numbered.withColumn("slice_no", F.floor((begun - 1) / max_hits).cast("int")).drop("_n", "_gap")


TOTALS = f"file string, {words.PART}"


def disorder(found: DataFrame) -> DataFrame:
    """From summaries, per file and chip: markers and hits, their steps back in time, percent of hits that step back, the
    least, mean and most hits from one marker to the next, and the first five markers with the steps between them.

    Words before a file's first header count for chip 0.
    """
    n = F.col("n_hits")
    rate = 100.0 * F.col("back") / F.greatest(n, F.lit(1))
    # hits between the first and the last marker
    mean = F.when(F.col("n_gaps") > 0, (n - F.col("hits_before") - F.col("hits_after")) / F.col("n_gaps"))
    steps = F.transform(F.slice("first_tdcs", 2, words.FIRST - 1), lambda t, k: t - F.get("first_tdcs", k))
    five, more = F.size("first_tdcs") >= words.FIRST, F.col("n_tdc") > words.FIRST
    totals = _by_file(found, words.totals, TOTALS)
    return totals.select("file", F.col("chip").alias("chip_id"), "n_tdc", F.col("turns").alias("n_tdc_back"), "n_hits", F.col("back").alias("n_back"), rate.alias("disorder_percent"), F.col("gap_min").alias("min_hits"), mean.alias("mean_hits"), F.col("gap_max").alias("max_hits"), F.when(five, F.col("first_tdcs")).alias("first_tdcs"), F.when(five & more, steps).alias("tdc_steps"))


def rollovers(packets: DataFrame, jump: int = 500_000_000, block: int = BLOCK) -> DataFrame:
    """Markers (kind tdc), and hits, whose time lies more than `jump` ticks before that of the file's previous one.

    tdcs, hits: the last five markers and ten hits before it, as [packet_idx, chip, time]. Words before the first header have chip 0.
    """

    def kernel(b: words.Block, state: words.State) -> dict:
        rows = words.jumps(b, state, jump)
        return {k: [r[k] for r in rows] for k in rows[0]} if rows else {}

    zero = lambda c: F.transform(c, lambda x: F.transform(x, lambda v: F.greatest(v, F.lit(0))))
    found = resolved(packets, kernel, JUMPS, block)
    return found.withColumn("chip_id", F.greatest("chip_id", F.lit(0))).withColumn("tdcs", zero("tdcs")).withColumn("hits", zero("hits"))


def debug_sample(packets: DataFrame, period: int) -> DataFrame:
    """The first hit of a section that has a marker: raw and corrected time, difference, time of flight."""
    marked = sections(packets).where("final_tdc is not null").select("file", "start_offset", "final_tdc")
    hits = with_chip(packets).where("kind = 'hit'").withColumn("start_offset", F.col("section_at") * 8 + 8)
    hit = hits.join(marked, ["file", "start_offset"]).orderBy("file", "packet_idx").limit(1)
    ts = bits.coarse_timestamp(F.col("raw"))
    fixed = bits.rollover_corrected(ts, F.col("final_tdc"))
    return hit.select("file", "packet_idx", "chip_id", F.col("final_tdc").alias("tdc"), ts.alias("raw_ts"), fixed.alias("ts"), (fixed - F.col("final_tdc")).alias("delta"), bits.time_of_flight(fixed, F.col("final_tdc"), period).alias("tof"))
