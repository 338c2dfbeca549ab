"""Data source "tpx3": files of 64-bit little-endian words as rows (file, packet_idx, raw), batch and streaming.

A file is cut into aligned byte ranges, one partition each; a reader reads its range a piece at a time and yields Arrow batches.
The rows of a file can be cut anywhere, since what runs along a file is resolved afterwards by packet_idx. Files may be
on any file system that Arrow opens by its URI.

Options: path (a file, folder or glob), split_mb (size of a range, 64), strict (true: a length that is no multiple of 8
is an error; else the rest is ignored), max_files (streaming: files a batch after the first, 16), settle_s (streaming: files changed so many
seconds ago or less may still grow and wait, 0), max_age_s (streaming: files older than the newest one by more are not looked for, a week), and mode:
"packets", or "ranges" for rows (file, first, count) without reading any word.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from pixelspark.config import DataError
from pixelspark.sources.files import chunks, listed, opened

SCHEMA, RANGES = "file string, packet_idx long, raw long", "file string, first long, count long"
WORD, ROWS = 8, 1 << 18


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


def split_words(split_mb: float) -> int:
    return max(1, int(split_mb * (1 << 20)) // WORD)


def ranges(files: list[tuple], step: int, strict: bool) -> list[Range]:
    out = []
    for path, size, _ in files:
        if strict and size % WORD:
            raise DataError(f"{path}: {size} bytes are no multiple of {WORD}")
        words = size // WORD
        out += [Range(path, at, min(step, words - at)) for at in range(0, words, step)]
    return out


def words_of(path: str, first: int, count: int, step: int = ROWS) -> Iterator[tuple[int, np.ndarray]]:
    """(packet_idx of the first word, words) of a range, `step` at a time."""
    for at, data in chunks(path, first * WORD, count * WORD, step * WORD):
        if len(data) % WORD:
            raise DataError(f"{path} ends within a word")
        yield at // WORD, np.frombuffer(data, "<i8")


def batches(part: Range) -> Iterator:
    import pyarrow as pa

    for at, raw in words_of(part.path, part.first, part.count):
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part.path), len(raw)), pa.array(np.arange(at, at + len(raw))), pa.array(raw)], names=["file", "packet_idx", "raw"])


class _Options:
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.step = split_words(float(options.get("split_mb", "64")))
        self.unit = int(options.get("unit", "1"))  # ranges are cut at multiples of it
        self.step = -(-self.step // self.unit) * self.unit
        self.strict = str(options.get("strict", "true")).lower() == "true"
        self.max_files, self.mode = int(options.get("max_files", "16")), options.get("mode", "packets")
        self.settle, self.max_age = float(options.get("settle_s", "0")), float(options.get("max_age_s", 7 * 86_400))


class PacketReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def partitions(self) -> list[Range]:
        files = listed(self.options.path)
        if not files:
            raise DataError(f"no file at {self.options.path!r}")
        return ranges(files, self.options.step, self.options.strict) or [Range(files[0][0], 0, 0)]

    def read(self, partition: Range) -> Iterator:
        if self.options.mode != "ranges":
            yield from batches(partition)
        elif partition.count:
            yield (partition.path, partition.first, partition.count)


class PacketStreamReader(DataSourceStreamReader):
    """New files in the order of their change, a bounded number a batch.

    The offset names the files taken, each with its time of change and size, and forgets those that are older than the newest by
    max_age; a file that comes late is taken whatever its name is. When a query starts, the reader isn't told what its
    checkpoint names. So its first offset names all files there are, and the first batch reads those that the checkpoint does not
    name, however many; from then on a batch has max_files at most.
    """

    def __init__(self, options: dict):
        self.options, self.taken = _Options(options), None

    def initialOffset(self) -> dict:
        return {"files": {}}

    @staticmethod
    def _parts(value: str) -> tuple[int, int]:
        changed, size = value.split(":")
        return int(changed), int(size)

    def latestOffset(self) -> dict:
        files, now = listed(self.options.path), time.time_ns()
        if self.options.settle:
            files = [f for f in files if f[2] <= now - int(self.options.settle * 1e9)]
        taken = self.taken or {}
        newest = max([t for _, _, t in files] + [self._parts(v)[0] for v in taken.values()], default=0)
        since = newest - int(self.options.max_age * 1e9)
        fresh = sorted((t, p, n) for p, n, t in files if p not in taken and t >= since)
        if self.taken is not None:
            fresh = fresh[: self.options.max_files]
        taken = taken | {p: f"{t}:{n}" for t, p, n in fresh}
        self.taken = {p: v for p, v in taken.items() if self._parts(v)[0] >= since}
        return {"files": self.taken}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.taken is None:
            self.taken = dict(end["files"])
        # the size is that of the offset, so a batch that is run again reads the same words
        new = sorted((*self._parts(v), p) for p, v in end["files"].items() if p not in start["files"])
        return ranges([(p, n, t) for t, n, p in new], self.options.step, self.options.strict)

    def read(self, partition: Range) -> Iterator:
        yield from batches(partition)

    def commit(self, end: dict) -> None:
        """Nothing to release: files stay where they are."""


class PacketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tpx3"

    def schema(self) -> str:
        return RANGES if self.options.get("mode") == "ranges" else SCHEMA

    def reader(self, schema) -> PacketReader:
        return PacketReader(dict(self.options))

    def streamReader(self, schema) -> PacketStreamReader:
        return PacketStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PacketSource)


def read_packets(spark: SparkSession, path: str, split_mb: float = 64, strict: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("tpx3").option("split_mb", str(split_mb)).option("strict", str(strict).lower()).load(path)


def read_ranges(spark: SparkSession, path: str, split_mb: float = 64, strict: bool = True, unit: int = 1) -> DataFrame:
    """file, first, count: the ranges that read_packets would read, a partition each, cut at multiples of `unit` words."""
    register(spark)
    return spark.read.format("tpx3").option("mode", "ranges").option("split_mb", str(split_mb)).option("strict", str(strict).lower()).option("unit", str(unit)).load(path)


def stream_packets(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    register(spark)
    return spark.readStream.format("tpx3").option("max_files", str(max_files)).load(path)


def write_files(packets: DataFrame, folder: str) -> DataFrame:
    """Each file of a table of packets to a file of its name in a folder, in packet order; (path, n) of each. A task writes a file."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        path, out, n = None, None, 0

        def closed() -> Iterator:
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

        for batch in batches:
            names, raw = batch.column("file").to_pylist(), batch.column("raw").to_numpy().astype("<i8")
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                to = f"{folder}/{names[a]}.tpx3"
                if to != path:
                    yield from closed()
                    system, inner, _ = opened(to)
                    path, out, n = to, system.open_output_stream(inner), 0
                out.write(raw[a:b].tobytes())
                n += b - a
        yield from closed()

    dealt = packets.select("file", "packet_idx", "raw").repartition("file").sortWithinPartitions("file", "packet_idx")
    return dealt.mapInArrow(run, "path string, n long")


def write_packets(path: str, words: list[int]) -> None:
    """Unsigned words to one file, for tests and conversions."""
    np.array(words, dtype="<u8").tofile(path)


def header(chip: int) -> int:
    return 0x33585054 | chip << 32


def tdc(ts: int) -> int:
    return 0x6F << 56 | ts << 12


def hit(ts: int, tot: int = 10, address: int = 0) -> int:
    return 0xB << 60 | (ts & 0x3FFF) << 30 | tot << 20 | address << 44 | (ts >> 14) & 0xFFFF


def metadata(path: str) -> dict:
    """Size and packets of the files at a path."""
    sizes = [n for _, n, _ in listed(path)]
    return {"files": len(sizes), "file_size": sum(sizes), "packet_count": sum(n // WORD for n in sizes)}
