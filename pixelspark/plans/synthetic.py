"""Packet files of any size for measurements: pulses of small clusters of hits on four chips, a section per chip and pulse."""

from __future__ import annotations

import numpy as np

from pixelspark.sources.tpx3 import header, tdc

PERIOD, TURN, SIZE = 666_667, 1 << 30, 4
HIT_NIBBLE = np.uint64(0xB << 60)


def pulses(first: int, count: int, hits: int, seed: int) -> np.ndarray:
    """The words of `count` pulses from number `first` on; `hits` per chip and pulse, in clusters of SIZE hits, a tenth of them late."""
    rng = np.random.default_rng((seed, first))
    start = (np.arange(first, first + count, dtype=np.int64) * PERIOD % TURN)[:, None, None]
    clusters = -(-hits // SIZE)
    at = np.sort(rng.integers(0, PERIOD - 100, (count, 4, clusters)), axis=2)
    x, y = (rng.integers(2, 250, (count, 4, clusters)) for _ in range(2))
    spread = lambda a, most: (np.repeat(a, SIZE, axis=2) + rng.integers(0, most, (count, 4, clusters * SIZE)))[:, :, :hits]
    time = (start + spread(at, 3) - PERIOD // 8 * (rng.random((count, 4, hits)) < 0.1)) % TURN
    x, y = spread(x, 3), spread(y, 3)
    address = (x >> 1 << 9 | (y >> 2 << 3) | (x & 1) << 2 | y & 3).astype(np.uint64)
    tot = rng.integers(5, 200, (count, 4, hits)).astype(np.uint64)
    out = np.empty((count, 4, hits + 2), np.uint64)
    out[:, :, 0] = np.array([header(c) for c in range(4)], np.uint64)
    out[:, :, 1] = np.uint64(tdc(0)) | start[:, :, 0].astype(np.uint64) << np.uint64(12)
    time = time.astype(np.uint64)
    out[:, :, 2:] = HIT_NIBBLE | address << np.uint64(44) | (time & np.uint64(0x3FFF)) << np.uint64(30) | tot << np.uint64(20) | time >> np.uint64(14)
    return out.reshape(-1)


def write(path: str, words: int, hits: int = 1875, seed: int = 1) -> int:
    """A local file of about so many words; the number written."""
    per, done = 4 * (hits + 2), 0
    with open(path, "wb") as f:
        for first in range(0, max(1, words // per), 64):
            part = pulses(first, min(64, max(1, words // per) - first), hits, seed)
            f.write(part.astype("<u8").tobytes())
            done += len(part)
    return done
