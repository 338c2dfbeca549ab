"""Token ids in files of patched frame-of-reference blocks, written in doc_id order and read back.

A block holds `BLOCK` ids: the block minimum, the differences packed at the bit width that `PERCENTILE` per cent of
them need, and the wider differences as exceptions (position, value). A file is magic, blocks, then an index: the byte
start of each block, the doc_ids and the token end of each document, and the length of the index. Any document can be
read by way of the index without decoding the blocks before it.

Documents are range-partitioned by doc_id, by a hash of the text among equal ids and by where a row was read among equal texts,
so that a range may be cut anywhere, even within many rows of one id or of none. They are sorted within the partition, and
each task streams its part into one file in the folder of spark.checkpoint.dir. A file's name has the task attempt's
number, and only names that a successful attempt reports are read, so lost or repeated tasks do no harm.

Defined results: null or empty text is the end id alone; null doc_ids come first; repeated doc_ids keep one entry
per row, ordered by the text's hash, and equal rows have equal entries; a very long text spans as many blocks as it needs, and
a task holds its ids and those of 128 texts; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.llm.common import piece_encoder, scratch, text_slices, tokenizer_path, written

BLOCK, PERCENTILE, MAGIC = 1024, 92, b"PFORIDS1"
HEAD = np.dtype([("low", "<u4"), ("count", "<u2"), ("exceptions", "<u2"), ("width", "u1")])
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id in the index


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of unsigned 32-bit ids; all hold BLOCK ids but the last. Blocks of one width are packed together."""
    whole = len(ids) // BLOCK
    out: list[bytes] = [b""] * whole
    if whole:
        rows = ids[: whole * BLOCK].reshape(whole, BLOCK)
        low = rows.min(axis=1)
        rest = rows - low[:, None]
        at = np.partition(rest, k := (BLOCK - 1) * PERCENTILE // 100, axis=1)[:, k]
        width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            part = rest[own]
            bits = np.unpackbits(np.ascontiguousarray(part, "<u4").view(np.uint8).reshape(-1, 4), axis=1, count=w, bitorder="little")
            packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
            odd = part >> np.uint32(w) if w < 32 else np.zeros_like(part)
            for k, b in enumerate(own.tolist()):
                where = np.flatnonzero(odd[k])
                head = np.array([(int(low[b]), BLOCK, len(where), w)], dtype=HEAD).tobytes()
                out[b] = head + packed[k].tobytes() + where.astype("<u2").tobytes() + part[k][where].astype("<u4").tobytes()
    if len(ids) > whole * BLOCK:
        out.append(_pack_part(ids[whole * BLOCK :]))
    return out


def _pack_part(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    width = int(np.partition(rest, k := (len(rest) - 1) * PERCENTILE // 100)[k]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    head = np.array([(low, len(ids), len(odd), width)], dtype=HEAD).tobytes()
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return head + np.packbits(bits.reshape(-1), bitorder="little").tobytes() + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


def unpack_block(raw: bytes | memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block that starts at `at`, and where the next one starts."""
    low, n, n_odd, width = np.frombuffer(raw, HEAD, 1, at)[0].tolist()
    at += HEAD.itemsize
    size = (n * width + 7) // 8
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
    rest = np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1).copy()
    at += size
    where = np.frombuffer(raw, "<u2", n_odd, at)
    rest[where] = np.frombuffer(raw, "<u4", n_odd, at + 2 * n_odd)
    return rest + np.uint32(low), at + 6 * n_odd


class Writer:
    """Streams documents into one open binary file."""

    def __init__(self, out):
        self.out, self.at, self.held, self.n_held = out, len(MAGIC), [], 0
        self.starts, self.docs, self.ends, self.tokens = [], [], [], 0
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.tokens += len(ids)
        self.docs.append(NO_ID if doc is None else doc)
        self.ends.append(self.tokens)
        if self.n_held >= 64 * BLOCK:
            self._flush(self.n_held - self.n_held % BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        for raw in pack_blocks(ids[:n]):
            self.starts.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        index = b"".join(np.array(x, "<i8").tobytes() for x in (self.starts, self.docs, self.ends))
        self.out.write(index)
        self.out.write(np.array([len(self.starts), len(self.docs), self.at], "<i8").tobytes())


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of an open, seekable binary file, a bounded number of blocks at a time."""
    size = source.seek(0, 2)
    source.seek(size - 24)
    n_blocks, n_docs, index_at = np.frombuffer(source.read(24), "<i8").tolist()
    source.seek(index_at)
    index = np.frombuffer(source.read(8 * (n_blocks + 2 * n_docs)), "<i8")
    starts, docs, ends = np.append(index[:n_blocks], index_at), index[n_blocks : n_blocks + n_docs], index[n_blocks + n_docs :]
    held, first, block = np.empty(0, "<u4"), 0, 0
    begun = 0
    for doc, end in zip(docs.tolist(), ends.tolist(), strict=True):
        parts, n = [held], len(held)
        while first + n < end:
            last = min(n_blocks, block + 64)
            source.seek(int(starts[block]))
            raw, at = source.read(int(starts[last] - starts[block])), 0
            for _ in range(block, last):
                ids, at = unpack_block(raw, at)
                parts.append(ids)
                n += len(ids)
            block = last
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield (None if doc == NO_ID else doc), held[begun - first : end - first]
        held, first, begun = held[end - first :], end, end


def _open(path: str, mode: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_output_stream(at) if mode == "w" else store.open_input_file(at)


def write_ids(docs: DataFrame, folder: str, end_id: int = 2, tokenizer: str | None = None) -> list[tuple[str, int]]:
    """Write the files; (path, ids) of each, in doc_id order. One small row per file reaches the driver."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, encode, out, writer = TaskContext.get(), piece_encoder(path), None, None
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.pfor"
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in text_slices(batch):
                if writer is None:
                    out = _open(name, "w")
                    writer = Writer(out)
                for doc, own in zip(ids.slice(at, len(texts)).to_pylist(), encode(texts, end_id), strict=True):
                    writer.add(doc, own)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [name], "tokens": [writer.tokens]})

    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    order = ("doc_id", "same", "text", "read")  # equal hashes of different texts are told apart by the text
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("same"), F.spark_partition_id().alias("read"))
    ordered = ordered.repartitionByRange("doc_id", "same", "read").sortWithinPartitions(*order).select("doc_id", "text")
    files = written(ordered.mapInArrow(run, "part long, path string, tokens long"), "files")
    return [(r.path, r.tokens) for r in files.orderBy("part").collect()]


def read_ids(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    first, rows = 0, []
    for path, tokens in files:
        rows.append((path, first))
        first += tokens

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                out = []
                with _open(path, "r") as source:
                    for doc, ids in read_file(source):
                        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    table = spark.createDataFrame(rows, "path string, start long")
    return table.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_ids(spark, write_ids(docs, scratch(spark, "ids")))
