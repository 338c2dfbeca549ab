"""Streams of packets: pulses assembled with state per file and chip, merged over chips, and a growing histogram.

A pulse ends with the data, not the clock: the second marker after it seals it, since a late hit may still join the
pulse before the current one. The state of a (file, chip) is its last two markers and their hits. The last pulses of a file come
out when a row of kind "end" says that it ends, or after `idle` without news. Packets must already carry their chip, which a
file's headers give within its batch (a file comes whole in one batch).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.config import DetectorConfig
from pixelspark.functions import bits
from pixelspark.operators import cube as cubes
from pixelspark.operators import ordering
from pixelspark.operators.words import Pulse, corrected, flight

PACKETS = "file string, chip_id int, packet_idx long, kind string, value long, raw long"
SEALED = "file string, chip_id int, ext_tdc long, packet_idx long, timestamp long, tof long, raw long"
FIELDS = ("chip_id", "ext_tdc", "packet_idx", "timestamp", "tof", "raw")  # of hits, as columns of an array
EXT, TIME = 1, 4
NOTHING = np.empty((0, len(FIELDS)), np.int64)
FOREVER = (1 << 63) - 1


class Assembler:
    """The state machine of one chip of a file: feed packets in order, get the hits of sealed pulses as rows of FIELDS."""

    def __init__(self, chip: int, period: int):
        self.chip, self.period, self.marks = chip, period, Pulse()
        self.waiting, self.number = NOTHING, np.empty(0, np.int64)  # hits of pulses that aren't sealed, and their pulses' numbers
        self.sealed_to = -1  # extended marker up to which all pulses are out

    def feed(self, tdc: np.ndarray, value: np.ndarray, idx: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """tdc: which packets are markers. The rest are hits."""
        p, m, h = self.marks, np.flatnonzero(tdc), np.flatnonzero(~tdc)
        known = np.append([p.prev_tdc is not None, p.tdc is not None], np.ones(len(m), bool)).astype(bool)
        t = np.append([p.prev_tdc or 0, p.tdc or 0], value[m]).astype(np.int64)
        turned = (t[2:] < t[1:-1]) & known[1:-1]
        epoch = np.append([p.prev_epoch, p.epoch], p.epoch + np.cumsum(turned)).astype(np.int64)
        own = np.searchsorted(m, h) + 1
        h, own = h[known[own]], own[known[own]]
        now = corrected(value[h], t[own])
        late = (now < t[own]) & known[own - 1]
        own = own - late
        time = np.where(late, corrected(value[h], t[own]), now)
        ext = epoch << 30 | t
        rows = np.stack([np.full(len(h), self.chip), ext[own], idx[h], time, flight(time, t[own], self.period), raw[h]], axis=1)
        self.waiting, self.number = np.concatenate([self.waiting, rows]), np.append(self.number, p.n - 1 + own)
        if len(m):
            n = p.n + len(m)
            self.marks = Pulse(n, int(t[-1]), int(epoch[-1]), int(t[-2]) if known[-2] else None, int(epoch[-2]))
            if n > 2:
                self.sealed_to = int(ext[-3]) if len(m) > 2 or known[-3] else self.sealed_to
        return self._out(self.number <= self.marks.n - 2)

    def _out(self, ready: np.ndarray) -> np.ndarray:
        rows = self.waiting[ready]
        self.waiting, self.number = self.waiting[~ready], self.number[~ready]
        return rows[np.lexsort((rows[:, 2], rows[:, TIME], rows[:, EXT]))]

    def flush(self) -> np.ndarray:
        """All that is left; nothing follows."""
        self.sealed_to = FOREVER
        return self._out(np.ones(len(self.number), bool))


def values(chips: DataFrame) -> DataFrame:
    """PACKETS of packets with their chip."""
    raw = F.col("raw")
    value = F.when(F.col("kind") == "tdc", bits.tdc_timestamp(raw)).otherwise(bits.coarse_timestamp(raw))
    return chips.where("kind in ('tdc', 'hit')").select("file", "chip_id", "packet_idx", "kind", value.alias("value"), "raw")


def ends(packets: DataFrame) -> DataFrame:
    """The rows that end each (file, chip) of a bounded table of PACKETS."""
    last = packets.groupBy("file", "chip_id").agg((F.max("packet_idx") + 1).alias("packet_idx"))
    return last.select("file", "chip_id", "packet_idx", F.lit("end").alias("kind"), F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("raw"))


def assemble_batch(packets: DataFrame, period: int, block: int = ordering.BLOCK) -> DataFrame:
    """SEALED of a bounded table of words (file, packet_idx, raw): what a stream gives once all has come. By blocks, without state."""
    return ordering.assign_pulses(packets, period, True, block).select(*(f.split()[0] for f in SEALED.split(", ")))


def _fed(frames, machines: dict[int, Assembler], period: int) -> Iterator[tuple[int, np.ndarray]]:
    """(chip, sealed hits) of a batch of PACKETS, feeding each chip's machine in packet order."""
    import pandas as pd

    for chip, own in pd.concat(list(frames)).sort_values("packet_idx", kind="stable").groupby("chip_id"):
        machine = machines.setdefault(int(chip), Assembler(int(chip), period))
        data = own[own.kind != "end"]
        yield int(chip), machine.feed((data.kind == "tdc").to_numpy(), *(data[c].to_numpy(np.int64) for c in ("value", "packet_idx", "raw")))
        if len(data) < len(own):
            yield int(chip), machine.flush()


def _stateful(packets: DataFrame, keys: tuple[str, ...], step, idle: int | None) -> DataFrame:
    """step(machines and buffer, frames or None at the end) -> rows of FIELDS, with the state kept as bytes per key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        held = pickle.loads(state.get[0]) if state.exists else ({}, NOTHING)
        machines, rows = held[0], NOTHING
        if state.hasTimedOut:
            rows, buffer = step(*held, None)
            state.remove()
        else:
            rows, buffer = step(*held, frames)
            state.update((pickle.dumps((machines, buffer)),))
            if idle:
                state.setTimeoutDuration(idle)
        out = pd.DataFrame(rows, columns=list(FIELDS))
        out.insert(0, "file", key[0])
        yield out

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return packets.groupBy(*keys).applyInPandasWithState(run, SEALED, "state binary", "append", timeout)


def assemble_stream(packets: DataFrame, period: int, idle: int | None = None) -> DataFrame:
    """Hits of sealed pulses of a stream of PACKETS, with state per (file, chip). idle: ms without packets that end a chip, too."""

    def step(machines: dict, buffer: np.ndarray, frames) -> tuple[np.ndarray, np.ndarray]:
        parts = [r for _, r in _fed(frames, machines, period)] if frames is not None else [m.flush() for m in machines.values()]
        return np.concatenate([NOTHING, *parts]), buffer

    return _stateful(packets, ("file", "chip_id"), step, idle)


def merge_stream(packets: DataFrame, period: int, chips: int = 4, idle: int | None = None) -> DataFrame:
    """The same with the pulses of a file's chips merged: in the order of their extended markers, hits by time of flight.

    A pulse comes out when all `chips` chips (0 and up) have sealed it or have ended, so that no earlier pulse can follow; a chip
    without packets holds the others back until a row of kind "end" names it, or the file is idle.
    """

    def step(machines: dict, buffer: np.ndarray, frames) -> tuple[np.ndarray, np.ndarray]:
        if frames is None:
            rows, safe = np.concatenate([buffer, *(m.flush() for m in machines.values())]), FOREVER
        else:
            rows = np.concatenate([buffer, *(r for _, r in _fed(frames, machines, period))])
            safe = min([machines[c].sealed_to if c in machines else -1 for c in range(chips)] + [m.sealed_to for m in machines.values()])
        ready = rows[:, EXT] <= safe
        out = rows[ready]
        return out[np.lexsort((out[:, 2], out[:, 0], out[:, TIME], out[:, EXT]))], rows[~ready]

    return _stateful(packets, ("file",), step, idle)


def stream_neutrons(spark: SparkSession, path: str, write, detector: DetectorConfig | None = None, max_files: int = 16, **options):
    """Read new files as they come; write(neutrons, batch_id) gets each batch's. Files come whole, so each batch is complete."""
    from pixelspark import api
    from pixelspark.sources.tpx3 import stream_packets

    def batch(packets: DataFrame, number: int) -> None:
        write(api.neutrons_of(packets, detector, **options), number)

    return stream_packets(spark, path, max_files).writeStream.foreachBatch(batch)


def growing_cube(hits: DataFrame, tof_max: int, n_bins: int, width: int, height: int) -> DataFrame:
    """The histogram of a stream of hits, kept up to date (output mode update or complete)."""
    return cubes.hit_cube(hits, tof_max, n_bins, width, height)
