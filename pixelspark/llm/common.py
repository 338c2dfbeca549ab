"""Helpers shared by the text operators: shared scratch tables and cached tokenizer calls."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition used by the contracts: [^\x20\x09-\x0D]+
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


_own: dict[str, str] = {}  # folders of our own, by application


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="pixelspark-"))
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pixelspark-{name}-{uuid.uuid4().hex}"


#: With it, Spark drops an execution's shuffle files when the execution ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back with the same schema."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    for table in getattr(df, "_held", ()):
        discard(table)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def holding(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads tables made by written(): they go when df itself is written."""
    df._held = tables
    return df


def fresh(name: str, df: DataFrame) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Delete a table made by written(); nothing may read it afterwards."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """The same rows, with it forgotten that an aggregation dealt them by the key (a long).

    A join on the key then deals both sides itself, which lets Spark split the other side's hot keys (adaptive skew join).
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        odd = 0xD1342543DE82EF95
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for base in (odd, pow(odd, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[0] = tuple(both)
    return _POWERS[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by differences of a running polynomial."""
    power, inverse = _powers(len(data) + 1)
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def blanks(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


class PieceEncoder:
    """Token ids of whole texts by the tokenizers library, with a bounded table of pieces.

    Texts are cut only where a run of ASCII white space follows another character. The byte-level pre-tokenizer never
    makes a token across such a place and only looks ahead for white space, so the ids of the pieces, joined, are
    the ids of the text. Special strings hold no white space and so stay whole. Texts with other white space
    are encoded whole. New pieces are encoded many at a time as one text and told apart by the byte lengths of their
    tokens. Pieces are found in an open-addressing table by a 64-bit hash; `limit` pieces are held at most.
    """

    OTHER_SPACE = re.compile(r"[^\S \t-\r]")

    def __init__(self, path: str, limit: int = 1_040_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.size = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.size[k] = len(token)  # a character stands for a byte
        for k, token in self.tokenizer.get_added_tokens_decoder().items():
            self.size[k] = len(token.content.encode())
        self._clear(0)

    def _clear(self, need: int) -> None:
        """Empty the table, at least twice as large as what it may get."""
        self.mask = (1 << (2 * max(self.limit, need)).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)  # 0: free
        self.first = np.zeros(self.mask + 1, np.int64)  # of the piece's ids in store
        self.count = np.zeros(self.mask + 1, np.int32)
        self.store, self.n_store, self.n_pieces = np.zeros(1 << 16, "<u4"), 0, 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash or, where it isn't in the table, a free slot; and whether it is there."""
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        there = np.zeros(len(hashes), bool)
        todo = np.arange(len(hashes))
        while len(todo):
            held = self.keys[slot[todo]]
            there[todo] = hit = held == hashes[todo]
            todo = todo[~hit & (held != 0)]
            slot[todo] = (slot[todo] + 1) & self.mask
        return slot, there

    def _add(self, hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        todo = np.arange(len(hashes))
        while len(todo):
            slot, _ = self._slots(hashes[todo])
            _, one = np.unique(slot, return_index=True)  # of pieces that meet in a free slot, one takes it
            won = todo[one]
            self.keys[slot[one]], self.first[slot[one]], self.count[slot[one]] = hashes[won], first[won], count[won]
            todo = np.delete(todo, one)
        self.n_pieces += len(hashes)

    def _keep(self, ids: np.ndarray) -> int:
        while self.n_store + len(ids) > len(self.store):
            self.store = np.append(self.store, np.zeros_like(self.store))
        self.store[self.n_store : self.n_store + len(ids)] = ids
        self.n_store += len(ids)
        return self.n_store - len(ids)

    def _learn(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        joinable = blanks(data[starts]) & ~blanks(data[ends - 1])
        order, apart = np.flatnonzero(joinable), [np.flatnonzero(~joinable)]
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for at in range(0, len(order), 512):
            own = order[at : at + 512]
            (ids,) = self._ids([b"".join([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]).decode()])
            sizes = np.cumsum(self.size[ids])
            wanted = np.cumsum(ends[own] - starts[own])
            last = np.searchsorted(sizes, wanted)
            if last[-1] < len(sizes) and np.array_equal(sizes[last], wanted):
                begin = np.append(0, last[:-1] + 1)
                first[own], count[own] = self._keep(ids) + begin, last + 1 - begin
            else:
                apart.append(own)
        apart = np.concatenate(apart)
        for at in range(0, len(apart), 1024):
            own = apart[at : at + 1024]
            for k, ids in zip(own.tolist(), self._ids([raw[starts[k] : ends[k]].decode() for k in own.tolist()]), strict=True):
                first[k], count[k] = self._keep(ids), len(ids)
        self._add(hashes, first, count)

    def __call__(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        whole = [k for k, t in enumerate(texts) if t and not t.isascii() and self.OTHER_SPACE.search(t)]
        odd = dict(zip(whole, self._ids([texts[k] for k in whole]), strict=True)) if whole else {}
        parts = [b"" if not t or k in odd else t.encode() for k, t in enumerate(texts)]
        raw = b"".join(parts)
        data = np.frombuffer(raw, np.uint8)
        begins = np.append(0, np.cumsum(list(map(len, parts))))
        blank = blanks(data)
        new = blank & np.append(True, ~blank[:-1])[: len(data)]
        new[begins[:-1][np.diff(begins) > 0]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = span_hashes(data, starts, ends)
        hashes[hashes == 0] = 1
        slot, there = self._slots(hashes)
        missing = np.flatnonzero(~there)
        if len(missing):
            _, once = np.unique(hashes[missing], return_index=True)
            if self.n_pieces + len(once) > self.limit:
                self._clear(len(hashes))
                missing = np.arange(len(hashes))
                _, once = np.unique(hashes, return_index=True)
            own = missing[np.sort(once)]
            self._learn(raw, data, starts[own], ends[own], hashes[own])
            slot[missing], _ = self._slots(hashes[missing])
        count = self.count[slot].astype(np.int64)
        bounds = np.append(0, np.cumsum(count))
        ids = self.store[np.repeat(self.first[slot] - bounds[:-1], count) + np.arange(bounds[-1])]
        cuts = bounds[np.searchsorted(starts, begins)]
        end = np.array([end_id], "<u4")
        return [np.append(odd[k] if k in odd else ids[a:b], end).astype("<u4") for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    """One for each Python worker, whose tasks share the table."""
    return PieceEncoder(path)


def text_slices(batch, rows: int = 128):
    """(first row, texts) of an Arrow batch, a bounded number of rows at a time."""
    column = batch.column("text")
    for at in range(0, batch.num_rows, rows):
        yield at, column.slice(at, rows).to_pylist()
