"""Sum-of-squares online packing of tokenised documents into windows.

Every document's ids go, whole windows first, into windows of `window` ids. What is left of a document is one item. Fill levels
are multiples of `unit` ids, an item counting up to the next one, so that windows come to be exactly full often. An item
goes to the fill level h for which the sum over levels of the squared number of partly filled windows grows least; the
counts stand in one array by level. A window that an item makes full lacks less than `unit` ids per piece, which come from
the filler: the next document whenever there is none left, given out from its start.

Where sizes don't pack, partly filled windows would pile up. So an item that should open a window on a level which has
`most` already is cut: its head fills the fullest window that it is too long for, and its rest is an item of its own.
At the end of a partition the open windows, at most a few hundred, are closed: the fullest are filled up from the emptiest,
cutting documents, and the last rest is laid out as sequences whose lengths are powers of two, which need no padding. There is
no shuffle, and a task holds the ids of its open windows only.

Defined results: null or empty text is the end id alone; a null doc_id stays null; repeated rows are documents of
their own; an empty table gives no rows; other columns are ignored. A document longer than a window, however long, is
cut into whole windows and a rest. Of levels that are as good, a partly filled window is taken before a new one, and the fullest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pixelspark.llm.common import piece_encoder, text_slices, tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Online packer of one partition. add() and close() return finished sequences, each a list of pieces."""

    def __init__(self, window: int, unit: int = 64, most: int = 8):
        self.window, self.most, self.placed = window, most, 0
        self.unit = max(1, min(unit, window // 32))
        self.full = window // self.unit
        self.counts = np.zeros(self.full, dtype=np.int64)
        self.at_level: list[list[list[tuple]]] = [[] for _ in range(self.full)]
        self.filler: list[tuple] = []  # at most one document
        self.short: list[list[tuple]] = []  # full windows that wait for filler

    def add(self, doc, ids: np.ndarray) -> list[list[tuple]]:
        """doc: anything that names the document. A piece is (doc, start, ids, length of the document)."""
        c, n = self.window, len(ids)
        whole = n - n % c
        done = [[(doc, at, ids[at : at + c], n)] for at in range(0, whole, c)]
        if whole == n:
            return done
        piece = (doc, whole, ids[whole:], n)
        if self.filler:
            return done + self._place(piece)
        self.filler.append(piece)
        waiting, self.short = self.short, []
        return done + [w for held in waiting for w in self._finish(held)]

    def best_level(self, s: int) -> int:
        """The level (0: a new window) whose choice for an item of s units makes the sum of squares least."""
        counts = self.counts
        level, least = 0, 2 * int(counts[s]) + 1 if s < self.full else 0
        after = np.append(counts[s + 1 :], 0)  # level h >= 1 becomes h + s; a full window isn't counted
        here = counts[1 : self.full - s + 1]
        cost = 2 * (after - here) + 2
        if len(cost):
            cost[-1] = 1 - 2 * here[-1]
            cost[here == 0] = np.iinfo(np.int64).max
            best = len(cost) - 1 - int(np.argmin(cost[::-1]))  # of equals, the fullest
            if here[best] and cost[best] <= least:
                level = best + 1
        return level

    def _place(self, piece: tuple) -> list[list[tuple]]:
        s = min(self.full, -(-len(piece[2]) // self.unit))
        level = self.best_level(s)
        if not level and s < self.full and self.counts[s] >= self.most:
            done = self._cut(piece)
            if done:
                return done
        held = self._taken(level) if level else []
        held.append(piece)
        if level + s < self.full:
            self.counts[level + s] += 1
            self.at_level[level + s].append(held)
            return []
        self.placed += len(held) > 1
        return self._finish(held)

    def _taken(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        return self.at_level[level].pop()

    def _cut(self, piece: tuple) -> list[list[tuple]]:
        """The fullest window that the item is too long for, filled by its head; nothing if there is none."""
        doc, start, ids, n = piece
        for level in range(self.full - 1, 0, -1):
            if self.counts[level]:
                gap = self.window - sum(len(p[2]) for p in self.at_level[level][-1])
                if gap < len(ids):
                    held = self._taken(level)
                    held.append((doc, start, ids[:gap], n))
                    return [held, *self._place((doc, start + gap, ids[gap:], n))]
        return []

    def _finish(self, held: list[tuple]) -> list[list[tuple]]:
        """A window that is full by level, brought to its length by filler."""
        need = self.window - sum(len(p[2]) for p in held)
        if need and self.filler:
            doc, start, ids, n = self.filler.pop()
            held.append((doc, start, ids[:need], n))
            if len(ids) > need:
                self.filler.append((doc, start + need, ids[need:], n))
            need -= len(held[-1][2])
        if not need:
            return [held]
        self.short.append(held)
        return []

    def close(self) -> list[list[tuple]]:
        """Fill the fullest windows up from the emptiest and lay out the rest."""
        windows = [w for held in self.at_level for w in held] + self.short  # by level, the emptiest first
        done, low, spare = [], 0, self.filler
        high = len(windows) - 1
        while low <= high:
            held, high = windows[high], high - 1
            need = self.window - sum(len(p[2]) for p in held)
            while need and (spare or low <= high):
                if not spare:
                    spare, low = windows[low][::-1], low + 1
                doc, start, ids, n = spare.pop()
                held.append((doc, start, ids[:need], n))
                if len(ids) > need:
                    spare.append((doc, start + need, ids[need:], n))
                need -= len(held[-1][2])
            if need:
                spare = held[::-1]
                break
            done.append(held)
        return done + self._powers(spare[::-1])

    @staticmethod
    def _powers(rest: list[tuple]) -> list[list[tuple]]:
        total, done, queue = sum(len(p[2]) for p in rest), [], rest[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            need, held = total & (1 << bit), []
            while need:
                doc, start, ids, n = queue.pop()
                held.append((doc, start, ids[:need], n))
                if len(ids) > need:
                    queue.append((doc, start + need, ids[need:], n))
                need -= len(held[-1][2])
            if held:
                done.append(held)
        return done


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: str | None = None, unit: int = 64, most: int = 8) -> DataFrame:
    """One row per piece (SCHEMA). tokenizer: path of a file of the tokenizers library."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, packer, sequence = piece_encoder(path), SumOfSquares(window, unit, most), TaskContext.get().partitionId() << 40

        def rows(done: list[list[tuple]]):
            nonlocal sequence
            out = []
            for held in done:
                at = 0
                for doc, start, ids, n in held:
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, at))
                    at += len(ids)
                sequence += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            docs = batch.column("doc_id")
            for at, texts in text_slices(batch):
                ids = docs.slice(at, len(texts)).to_pylist()
                yield rows([w for doc, own in zip(ids, encode(texts, end_id), strict=True) for w in packer.add(doc, own)])
        yield rows(packer.close())

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
