"""Cropped and edited copies of images by local descriptors.

An image is decoded to grey, and on a pyramid of halved sizes Harris corners are found, one per AREA pixels. Around a
corner the direction of the intensity centroid turns a fixed pattern of 128 point pairs; each pair gives a bit, which is the
brighter point. The descriptor's four 32-bit words are four hash tables: descriptors that agree in one word (surely so up to a
Hamming distance of 3) meet in an equi-join by sorted runs, and match if 22 bits of the other words differ in at most 6. A match says how the one image would be turned, scaled and
moved onto the other; matches of an image pair vote for that in overlapping bins, and MIN_VOTES different corners of both images in one
bin, and a share of the corners of the smaller image, make a link. Links give components.

Images of equal pixels are one class and are described once. The search is exact, in two passes:

1. A word that at most RUN corners have gives all its pairs. The corners of a longer run (a logo, or a large group of copies) meet
   PIVOTS of them, chosen by hashes that are the same for all words, so that a group of copies is tied by a few pairs per image.
2. What is left are pairs of different components that may share long runs. Of a link's corners, the smaller image needs t (MIN_VOTES or its
   share), so two of them are not among the t - 2 that stand in the longest runs; only corners beyond those look for partners, only in runs
   that hold several components, and only among images that are not smaller. Runs are cut into tiles of bounded size. A pair of which
   two corners turn up is verified on both images' whole descriptors; if pass 1 saw some match, but too few, they count as turned up
   where its corners in long runs could make up for what lacks.

A link within a component changes nothing, so links are not counted; each image's class and component are the result.
tests/llm holds the components against comparing all descriptors.

Defined results: what cannot be decoded, and null, has no corners and is its own component; images of equal pixels are one
component even without corners; small images are padded by their edges for corners; large ones have corners in proportion
(sides up to 2**27 pixels), and a task holds one picture at a time; of corners of equal response the upper, then the left one comes first; a null id
stays null and links like others; repeated rows get the same result each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelspark.llm.common import dealt_anew, discard, holding, mixed, written
from pixelspark.llm.near_duplicates import components

AREA, RADIUS, TURNS, BITS = 256, 7, 32, 128
RUN, PIVOTS, NODE, PART, MIN_VOTES, MIN_SHARE, BIN, CHECK, CHECK_OFF = 24, 3, 4096, 256, 5, 0.2, 12, 22, 6
HELD = 1 << 20  # matches that a task holds to pack them
X_AT, Y_AT, SIDE = 8, 36, (1 << 27) - 1  # of a place: turn and octave below
FLAT, MAX_FLAT = 1.0, 0.25


def _pattern() -> np.ndarray:
    """TURNS rotations of BITS point pairs inside the patch: (turn, bit, end, (dy, dx))."""
    seeds = mixed(np.arange(1, 8 * BITS + 1, dtype=np.uint64))
    radius = RADIUS * np.sqrt((seeds[: 2 * BITS] >> np.uint64(11)).astype(np.float64) / (1 << 53))
    angle = 2 * np.pi * (seeds[2 * BITS : 4 * BITS] >> np.uint64(11)).astype(np.float64) / (1 << 53)
    turns = 2 * np.pi * np.arange(TURNS)[:, None] / TURNS + angle[None, :]
    points = np.stack([np.rint(radius * np.sin(turns)), np.rint(radius * np.cos(turns))], axis=2).astype(np.int64)
    return points.reshape(TURNS, BITS, 2, 2)


PATTERN = _pattern()
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_Y * _Y + _X * _X <= RADIUS * RADIUS).astype(np.float32)


def decode(media: bytes | None) -> np.ndarray | None:
    """Grey pixels of PNG (8 bit, not interlaced), PGM and PPM (binary) bytes; None for anything else."""
    try:
        if media and media[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(media)
        if media and media[:2] in (b"P5", b"P6"):
            head = re.match(rb"P([56])\s+(?:#.*\n)*(\d+)\s+(\d+)\s+(\d+)\s", media)
            w, h, depth = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
            return np.frombuffer(media, np.uint8, w * h * depth, head.end()).reshape(h, w, depth).mean(axis=2).astype(np.float32)
    except (ValueError, TypeError, IndexError, zlib.error):
        return None
    return None


def _png(media: bytes) -> np.ndarray | None:
    at, data, size = 8, b"", None
    while at + 8 <= len(media):
        n, kind = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9], body[12]
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    w, h, depth, colour, interlaced = size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or not channels:
        return None
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.uint8)
    for k in range(h):
        kind, line = rows[k, 0], rows[k, 1:].copy()
        if kind == 2:
            line += above
        elif kind:
            for i in range(len(line)):
                a = int(line[i - channels]) if i >= channels else 0
                b, c = int(above[i]), int(above[i - channels]) if i >= channels else 0
                p = a + b - c
                add = a if kind == 1 else (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = (int(line[i]) + add) & 255
        out[k] = above = line
    pixels = out.reshape(h, w, channels).astype(np.float32)
    return pixels[:, :, :3].mean(axis=2) if channels >= 3 else pixels[:, :, 0]


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1) x (2r+1) windows, edges repeated."""
    k = 2 * r + 1
    rows, cols = (np.clip(np.arange(-r, n + r), 0, n - 1) for n in a.shape)
    p = np.zeros((len(rows) + 1, len(cols) + 1))
    np.cumsum(a[rows[:, None], cols], axis=0, out=p[1:, 1:])
    np.cumsum(p[1:, 1:], axis=1, out=p[1:, 1:])
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]).astype(np.float32)


def corners(grey: np.ndarray) -> np.ndarray:
    """Harris responses that none of their 5 x 5 surroundings exceeds and that lie inside: rows (response, y, x)."""
    margin = RADIUS + 1
    h, w = grey.shape
    if min(h, w) <= 2 * margin + 1:
        return np.empty((0, 3))
    dy, dx = np.zeros_like(grey), np.zeros_like(grey)
    dy[1:-1], dx[:, 1:-1] = grey[2:] - grey[:-2], grey[:, 2:] - grey[:, :-2]
    a, b, c = _box(dx * dx, 2), _box(dy * dy, 2), _box(dx * dy, 2)
    near = (a * b - c * c - 0.05 * (a + b) ** 2)[margin - 2 : h - margin + 2, margin - 2 : w - margin + 2]
    top = near[:-4]
    for k in range(1, 5):
        top = np.maximum(top, near[k : near.shape[0] - 4 + k])
    most = top[:, :-4]
    for k in range(1, 5):
        most = np.maximum(most, top[:, k : top.shape[1] - 4 + k])
    inner = near[2:-2, 2:-2]
    ys, xs = np.nonzero((inner >= most) & (inner > 1e-2))
    return np.stack([inner[ys, xs].astype(np.float64), ys + margin, xs + margin], axis=1)


def describe(grey: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, words): y, x (in the image's own pixels), turn and octave of each corner, and its descriptor's four words."""
    none = np.empty((0, 4), np.int64), np.empty((0, 4), np.uint32)
    if grey is None:
        return none
    levels, found, level = [], [], grey.astype(np.float32)
    if grey.size and min(grey.shape) <= 2 * (RADIUS + 1) + 1:  # places then count from the padded corner, which only moves them
        level = np.pad(level, RADIUS + 2, mode="edge")
    for octave in range(4):
        at = corners(level)
        if not len(at):
            break
        levels.append(level)
        found.append(np.column_stack([at, np.full(len(at), octave)]))
        h, w = level.shape[0] // 2 * 2, level.shape[1] // 2 * 2
        level = level[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))
    if not found:
        return none
    every = np.concatenate(found)
    wanted = max(16, grey.size // AREA)
    # a share of the corners for each octave by its area, so that scales can meet
    keep = []
    for octave in range(len(levels)):
        own = every[every[:, 3] == octave]
        keep.append(own[np.lexsort((own[:, 2], own[:, 1], -own[:, 0]))][: max(4, wanted * 3 // 4 >> 2 * octave)])
    places, words = [], []
    for octave, (own, level) in enumerate(zip(keep, levels, strict=True)):
        ys, xs = own[:, 1].astype(np.int64), own[:, 2].astype(np.int64)
        patch = level[ys[:, None, None] + _Y, xs[:, None, None] + _X] * _DISC
        turn = np.rint(np.arctan2((patch * _Y).sum(axis=(1, 2)), (patch * _X).sum(axis=(1, 2))) * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
        smooth = _box(level, 1)
        ends = PATTERN[turn]  # corner, bit, end, (dy, dx)
        value = smooth[ys[:, None, None] + ends[..., 0], xs[:, None, None] + ends[..., 1]]
        gap = value[:, :, 0] - value[:, :, 1]
        full = (np.abs(gap) < FLAT).mean(axis=1) <= MAX_FLAT  # a corner of an otherwise flat patch says little
        words.append(np.ascontiguousarray(np.packbits(gap[full] > 0, axis=1)).view("<u4"))
        places.append(np.stack([ys << octave, xs << octave, turn, np.full(len(ys), octave)], axis=1)[full])
    return np.concatenate(places), np.concatenate(words)


def picture(html: str | None) -> np.ndarray | None:
    """A page as a picture: its text line by line (a tag ends a line), 64 characters wide, a grey dot per character on mid-grey, blurred."""
    if not html:
        return None
    lines = []
    for part in re.split(r"<[^>]*>", html):
        raw = part.strip().encode()
        lines += [raw[k : k + 64] for k in range(0, len(raw), 64)]
    if not lines:
        return None
    dots = np.zeros((len(lines), 64), np.uint8)
    for k, raw in enumerate(lines):
        dots[k, : len(raw)] = np.frombuffer(raw, np.uint8)
    shade = (mixed(dots.astype(np.uint64)) >> np.uint64(56)).astype(np.float32)
    shade[dots == 0] = 128
    return _box(shade, 1) / 9


def _described(images: DataFrame, read) -> DataFrame:
    """image_id, class (hash of the pixels), seen (decoded), n corners, and the corners packed: per corner 4 words and a place."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: dict[str, list] = {"image_id": batch.column("image_id").to_pylist(), "cls": [], "seen": [], "n": [], "places": [], "words": []}
            for media in batch.column("media"):
                grey = read(media.as_py())
                places, words = describe(grey)
                shape = b"%d %d " % grey.shape if grey is not None else b""
                pixels = grey.astype("<f4").tobytes() if grey is not None else b""
                out["cls"].append(int.from_bytes(hashlib.blake2b(shape + pixels, digest_size=8).digest(), "little", signed=True))
                out["seen"].append(grey is not None)
                out["n"].append(len(places))
                packed = places[:, 0] << Y_AT | places[:, 1] << X_AT | places[:, 2] << 3 | places[:, 3]
                out["places"].append(packed.tolist())
                out["words"].append(np.ascontiguousarray(words).reshape(-1).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out["image_id"], pa.int64()), pa.array(out["cls"], pa.int64()), pa.array(out["seen"], pa.bool_()), pa.array(out["n"], pa.int32()), pa.array(out["places"], pa.list_(pa.int64())), pa.array(out["words"], pa.list_(pa.int32()))], names=list(out))

    return images.selectExpr("cast(image_id as long) image_id", "media").mapInArrow(run, "image_id long, cls long, seen boolean, n int, places array<long>, words array<int>")


def keys_of(words: np.ndarray) -> np.ndarray:
    """Per corner and table, from four words: the table, the word and, in the lowest CHECK bits, bits of the other words."""
    w = words.view(np.uint32).reshape(-1, 4).astype(np.int64)
    other = lambda t, k, mask: w[:, (t + k) % 4] & mask
    return np.stack([(t << 32 | w[:, t]) << CHECK | other(t, 1, 0xFF) << 14 | other(t, 2, 0x7F) << 7 | other(t, 3, 0x7F) for t in range(4)], axis=1)


def alike(x, y):
    return np.bitwise_count((x ^ y) & ((1 << CHECK) - 1)) <= CHECK_OFF


def consensus(pair: np.ndarray, p: np.ndarray, q: np.ndarray, n_pairs: int) -> np.ndarray:
    """The votes of each pair: of its matches (places p, q) the most different corners, of either image, in one bin of turn, scale and move."""

    def part(c: np.ndarray) -> tuple:
        return (c >> Y_AT).astype(float), (c >> X_AT & SIDE).astype(float), c >> 3 & 31, c & 7

    (yp, xp, tp, op), (yq, xq, tq, oq) = part(p), part(q)
    turn, scale = (tq - tp) % TURNS, oq - op
    angle, size = turn * (2 * np.pi / TURNS), 2.0**scale
    mx = xq - size * (np.cos(angle) * xp - np.sin(angle) * yp)
    my = yq - size * (np.sin(angle) * xp + np.cos(angle) * yp)
    best = np.zeros(n_pairs, np.int64)
    for i, j, k in np.ndindex(2, 2, 2):  # turns and moves in bins that overlap by half
        place = ((turn + i) // 2 % (TURNS // 2), np.floor(mx / BIN + j / 2), np.floor(my / BIN + k / 2), scale, pair)
        votes = []
        for corner in (p, q):
            order = np.lexsort((corner, *place))
            same_bin = np.ones(max(0, len(order) - 1), bool)
            for c in place:
                same_bin &= np.diff(c[order]) == 0
            new_bin = np.append(True, ~same_bin)[: len(order)]
            new = new_bin | np.append(True, np.diff(corner[order]) != 0)[: len(order)]
            start = np.flatnonzero(new_bin)
            votes.append(np.add.reduceat(new.astype(np.int64), start) if len(start) else np.empty(0, np.int64))
        np.maximum.at(best, pair[order][start], np.minimum(*votes))  # bins come in the same order for both
    return best


class Head:
    """One image's descriptors, to be matched with those of many others at once."""

    STEP = 1 << 20  # corner pairs looked at at once

    def __init__(self, places: np.ndarray, words: np.ndarray):
        keys = keys_of(words)
        self.places, self.n = places, len(keys)
        flat = keys.reshape(-1)
        self.order = np.argsort(flat >> CHECK, kind="stable")
        self.keys = flat[self.order]
        self.words = self.keys >> CHECK  # a word has its table's number in it

    def matches(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(corner, own corner): pairs that match in some table, each once, of corners given by the keys of their four words."""
        flat = keys.reshape(-1)
        low, high = (np.searchsorted(self.words, flat >> CHECK, side) for side in ("left", "right"))
        total = np.cumsum(high - low)
        found, at = [np.empty(0, np.int64)], 0
        while at < len(flat):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.STEP, "right")))
            count = high[at:end] - low[at:end]
            i = np.repeat(np.arange(at, end), count)
            j = np.repeat(low[at:end], count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            good = alike(flat[i], self.keys[j])
            found.append((i[good] // 4) * self.n + self.order[j[good]] // 4)
            at = end
        both = np.unique(np.concatenate(found))
        return both // max(1, self.n), both % max(1, self.n)

    def votes(self, places: np.ndarray, words: np.ndarray, sizes: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
        """The votes of each of many images, whose corners stand one after another (sizes: how many each has).

        They are moved onto this one or, where back is set, this one onto them: at the edges of bins that can differ.
        """
        i, j = self.matches(keys_of(words))
        pair = np.repeat(np.arange(len(sizes)), sizes)[i]
        p, q = places[i], self.places[j]
        if back is not None:
            p, q = np.where(back[pair], q, p), np.where(back[pair], p, q)
        return consensus(pair, p, q, len(sizes))


def matches(classes: DataFrame) -> DataFrame:
    """a, b (classes, a < b), p, q (places): the matches in short runs. With b null: the corners in long runs (p, and q the key).

    Of a word that more than RUN corners of one Arrow batch have, RUN + 1 go to the word's task, which tells it that the run is
    long; the others, marked by the key's complement, are dealt by themselves. So no word brings more than that per batch to one task.
    """

    def entries(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = batch.column("n").to_numpy()
            keys = keys_of(batch.column("words").flatten().to_numpy()).T.reshape(-1)
            cls = np.tile(np.repeat(batch.column("cls").to_numpy(), n), 4)
            place = np.tile(batch.column("places").flatten().to_numpy(), 4)
            order = np.argsort(keys, kind="stable")
            word = keys[order] >> CHECK
            start = np.flatnonzero(np.append(True, np.diff(word) != 0))[: len(word)]
            rank = np.arange(len(word)) - np.repeat(start, np.diff(np.append(start, len(word))))
            known = order[rank > RUN]
            keys[known] = ~keys[known]
            for at in range(0, len(keys), 1 << 16):
                own = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (keys, cls, place)], names=["key", "cls", "place"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        carry, long_word = None, None

        def rows(key, cls, place, final: bool):
            nonlocal carry, long_word
            word = key >> CHECK
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(start, len(word)))
            long = size > RUN
            long[0] |= word[0] == long_word
            carry = None
            if not final:
                if long[-1]:
                    long_word = word[-1]
                else:  # it may go on in the next batch
                    carry = tuple(c[start[-1] :] for c in (key, cls, place))
                    size, long, start = size[:-1], long[:-1], start[:-1]
            out = []
            for m in np.unique(size[~long & (size > 1)]).tolist():
                members = start[~long & (size == m)][:, None] + np.arange(m)
                i, j = np.triu_indices(m, 1)
                x, y = members[:, i].reshape(-1), members[:, j].reshape(-1)
                good = (cls[x] != cls[y]) & alike(key[x], key[y])
                x, y = x[good], y[good]
                x, y = np.where(cls[x] < cls[y], x, y), np.where(cls[x] < cls[y], y, x)
                out.append((cls[x], cls[y], place[x], place[y]))
            a, b, p, q = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4
            kept = np.repeat(long, size)
            kept = np.flatnonzero(kept) if len(kept) else np.empty(0, np.int64)
            none = np.append(np.zeros(len(b), bool), np.ones(len(kept), bool))
            return pa.RecordBatch.from_arrays([pa.array(np.append(a, cls[kept])), pa.array(np.append(b, np.zeros(len(kept), np.int64)), mask=none), pa.array(np.append(p, place[kept])), pa.array(np.append(q, key[kept]))], names=["a", "b", "p", "q"])

        for batch in batches:
            key, cls, place = (batch.column(c).to_numpy() for c in ("key", "cls", "place"))
            known = key < 0
            if known.any():  # they come first
                n = int(known.sum())
                yield pa.RecordBatch.from_arrays([pa.array(cls[known]), pa.array([None] * n, pa.int64()), pa.array(place[known]), pa.array(~key[known])], names=["a", "b", "p", "q"])
                key, cls, place = key[~known], cls[~known], place[~known]
            if not len(key):
                continue
            if carry is not None:
                key, cls, place = (np.concatenate(c) for c in zip(carry, (key, cls, place), strict=True))
            yield rows(key, cls, place, False)
        if carry is not None:
            yield rows(*carry, True)

    known = F.col("key") < 0
    dealt = classes.select("cls", "n", "places", "words").mapInArrow(entries, "key long, cls long, place long")
    dealt = dealt.repartition(F.when(known, F.xxhash64("key", "cls", "place")).otherwise(F.shiftright("key", CHECK))).sortWithinPartitions("key", "cls", "place")
    return dealt.mapInArrow(run, "a long, b long, p long, q long")


def _alike(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit((1 << CHECK) - 1))) <= CHECK_OFF


def _pairs(a: str, b: str, p: str, q: str) -> list[Column]:
    swap = F.col(a) > F.col(b)
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), pick(p, q).alias("p"), pick(q, p).alias("q")]


def pivot_matches(long: DataFrame) -> DataFrame:
    """a, b, p, q: the corners of long runs (word, cls, place, key) with their run's pivots."""
    first = [F.min(F.struct(F.xxhash64("cls", F.lit(j)).alias("o"), "cls", "place", "key")).alias(f"v{j}") for j in range(PIVOTS)]
    pivots = long.groupBy("word").agg(*first)
    one = F.array_distinct(F.array(*(F.struct(f"v{j}.cls", f"v{j}.place", f"v{j}.key") for j in range(PIVOTS))))
    pivots = pivots.select("word", F.explode(one).alias("v"))
    met = long.join(dealt_anew(pivots, "word"), "word").where((F.col("cls") != F.col("v.cls")) & _alike(F.col("key"), F.col("v.key")))
    return met.select("cls", "place", F.col("v.cls").alias("c"), F.col("v.place").alias("l")).select(*_pairs("cls", "c", "place", "l"))


def _sorted_rows(columns: list[np.ndarray]) -> np.ndarray:
    """The different rows of columns, sorted by the first, then the second and so on: a column per line."""
    rows = np.stack(columns)
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.append(True, (np.diff(rows, axis=1) != 0).any(axis=0))[: rows.shape[1]]]


def packed(rows: np.ndarray) -> bytes:
    """Sorted rows of longs as few bytes: the first column's steps, and equal bytes of the longs side by side, which compresses well."""
    import pyarrow as pa

    steps = np.concatenate([np.diff(rows[:1], axis=1, prepend=0), rows[1:]])
    raw = np.ascontiguousarray(steps, "<i8").view(np.uint8).reshape(len(rows), -1, 8)
    return pa.compress(raw.transpose(0, 2, 1).tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, n: int, columns: int) -> np.ndarray:
    import pyarrow as pa

    raw = np.frombuffer(pa.decompress(blob, n * columns * 8, "zstd", asbytes=True), np.uint8)
    rows = np.ascontiguousarray(raw.reshape(columns, 8, n).transpose(0, 2, 1)).view("<i8")[:, :, 0]
    return np.concatenate([np.cumsum(rows[:1], axis=1), rows[1:]])


def met_often(found: DataFrame) -> DataFrame:
    """a, b, m (the matches p, q), np, nq (different corners): the pairs of classes with two matched corners or more.

    Most pairs have one match, so rows are many and say little: they are dealt by pairs in packed lots, not one by one.
    """
    lots = 4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(held: list) -> Iterator:
            a, b, p, q = (np.concatenate(c) for c in zip(*held, strict=True))
            lot = (mixed(a.view(np.uint64) ^ mixed(b.view(np.uint64))) % np.uint64(lots)).astype(np.int64)
            rows = _sorted_rows([lot, a, b, p, q])
            cuts = np.flatnonzero(np.append(True, np.diff(rows[0]) != 0))
            ends = np.append(cuts[1:], rows.shape[1])
            for at in range(0, len(cuts), 256):
                some = list(zip(cuts[at : at + 256].tolist(), ends[at : at + 256].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0, [x for x, _ in some]], pa.int32()), pa.array([y - x for x, y in some], pa.int32()), pa.array([packed(rows[1:, x:y]) for x, y in some], pa.binary())], names=["lot", "n", "blob"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy() for c in ("a", "b", "p", "q")])
                n += batch.num_rows
            if n >= HELD:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(held: list) -> pa.RecordBatch:
            rows = _sorted_rows([np.concatenate(c) for c in zip(*held, strict=True)])
            a, b, p, q = rows
            new = np.append(True, (np.diff(rows[:2], axis=1) != 0).any(axis=0))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(a)))
            pair = np.cumsum(new) - 1
            order = np.lexsort((q, pair))
            different = [np.add.reduceat((new | np.append(True, np.diff(c) != 0)).astype(np.int32), start) for c in (p, q[order])]
            often = size >= 2
            kept = often[pair]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[often])), pa.int32()), pa.StructArray.from_arrays([pa.array(p[kept]), pa.array(q[kept])], ["p", "q"]))
            return pa.RecordBatch.from_arrays([pa.array(a[start[often]]), pa.array(b[start[often]]), lists, *(pa.array(c[often], pa.int32()) for c in different)], names=["a", "b", "m", "np", "nq"])

        held, lot = [], None
        for batch in batches:
            for now, n, blob in zip(*(batch.column(c).to_pylist() for c in ("lot", "n", "blob")), strict=True):
                if now != lot and held:
                    yield out(held)
                    held = []
                lot = now
                held.append(unpacked(blob, n, 4))
        if held:
            yield out(held)

    dealt = found.select("a", "b", "p", "q").mapInArrow(pack, "lot int, n int, blob binary").repartition("lot").sortWithinPartitions("lot")
    return dealt.mapInArrow(gather, "a long, b long, m array<struct<p:long,q:long>>, np int, nq int")


def voted(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b, votes: the pairs of met_often, of classes (cls, n), whose matches agree on one turn, scale and move."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("m")
            own = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(consensus(own, flat.field("p").to_numpy(), flat.field("q").to_numpy(), batch.num_rows))], names=["a", "b", "votes"])

    enough = pairs.where((F.col("np") >= MIN_VOTES) & (F.col("nq") >= MIN_VOTES)).select("a", "b", "m")
    best = enough.mapInArrow(run, "a long, b long, votes long").where(F.col("votes") >= MIN_VOTES)
    both = best.join(sizes.withColumnsRenamed({"cls": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"cls": "b", "n": "nb"}), "b")
    return both.where(F.col("votes") >= MIN_SHARE * F.least("na", "nb")).select("a", "b", "votes")


def needed(n: Column) -> Column:
    return F.greatest(F.lit(MIN_VOTES), F.ceil(MIN_SHARE * n).cast("int"))


def candidates(short: DataFrame, often: DataFrame, long: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """a, b (the one with less corners first): the pairs of different components whose matches pass 1 may not have seen enough of (see above)."""
    own = classes.select("cls", "n").join(comps.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "n", F.coalesce("comp", "cls").alias("comp"))
    runs = long.join(own, "cls")
    apart = runs.groupBy("word").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("word", "k")
    runs = written(runs.join(dealt_anew(apart, "word"), "word"), "runs")
    corner = runs.groupBy("cls", "n", "place").agg(F.max("k").alias("k"))  # as many as an image has corners
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.col("k").desc(), "place"))
    probes = corner.withColumn("r", rank).where(F.col("r") >= needed(F.col("n")) - 1).select("cls", "place")
    probing = written(runs.join(probes, ["cls", "place"]), "probing")
    split = probing.groupBy("word").agg(F.ceil(F.count("*") / NODE).alias("pn"), F.ceil(F.max("k") / NODE).alias("mn"))
    split = written(split, "split")
    turn = lambda n, own: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))).alias(own)
    node = lambda n, own: F.pmod(F.xxhash64("cls", "place"), F.col(n)).cast("int").alias(own)
    rows = ("key", "cls", "place", "n", "comp")
    left = probing.join(split, "word").select("word", node("pn", "p"), "mn", F.lit(0).alias("side"), *rows).select("word", "p", turn("mn", "m"), "side", *rows)
    right = runs.join(split, "word").select("word", "pn", node("mn", "m"), F.lit(1).alias("side"), *rows).select("word", turn("pn", "p"), "m", "side", *rows)

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tile, probe = None, []
        for batch in batches:
            cols = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            if not batch.num_rows:
                continue
            cuts = np.flatnonzero((np.diff(cols["word"]) != 0) | (np.diff(cols["p"]) != 0) | (np.diff(cols["m"]) != 0) | (np.diff(cols["side"]) != 0)) + 1
            found = [np.empty((0, 3), np.int64)]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                now = tuple(int(cols[c][a]) for c in ("word", "p", "m"))
                if now != tile:
                    tile, probe = now, []
                if cols["side"][a] == 0:
                    probe.append({c: cols[c][a:b] for c in rows})
                    continue
                if len(probe) != 1:
                    probe = [{c: np.concatenate([x[c] for x in probe]) for c in rows}] if probe else []
                for x in probe:
                    for at in range(a, b, 256):
                        y = {c: cols[c][at : min(b, at + 256)] for c in rows}
                        good = alike(x["key"][:, None], y["key"][None, :]) & (x["comp"][:, None] != y["comp"][None, :])
                        less = (x["n"][:, None] < y["n"][None, :]) | (x["n"][:, None] == y["n"][None, :]) & (x["cls"][:, None] < y["cls"][None, :])
                        i, j = np.nonzero(good & less)
                        found.append(np.column_stack([x["cls"][i], y["cls"][j], x["place"][i]]))
            a, b, place = _sorted_rows(list(np.concatenate(found).T))
            start = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0)))[: len(a)]
            last = np.append(start[1:], len(a))[: len(start)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[start], b[start], place[start], place[last])], names=["a", "b", "lo", "hi"])

    tiles = left.unionByName(right).repartition("word", "p", "m").sortWithinPartitions("word", "p", "m", "side")
    met = tiles.mapInArrow(meet, "a long, b long, lo long, hi long").groupBy("a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    met = met.select("a", "b", F.when(F.col("lo") < F.col("hi"), 2).otherwise(1).alias("k"), F.lit(0).alias("s"))
    # pairs that pass 1 saw some matches of, which corners in long runs could bring to as many as are needed
    held = written(corner.groupBy("cls", "n").agg(F.count("*").alias("z")).join(own.select("cls", "comp"), "cls"), "held")
    strong = held.where(F.col("z") >= MIN_VOTES - 1)  # one match is only enough to them
    ends = lambda c: strong.select(F.col("cls").alias(c))
    once = short.join(ends("a"), "a", "left_semi").join(ends("b"), "b", "left_semi").select("a", "b").distinct()
    seen = often.select("a", "b", "np", "nq").union(once.select("a", "b", F.lit(1), F.lit(1)))
    x, y = (held.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("z").alias(f"z{c}"), F.col("comp").alias(f"c{c}")) for c in "ab")
    seen = seen.join(x, "a").join(y, "b").where("ca <> cb")
    least = needed(F.least("na", "nb"))
    few = seen.where((F.col("np") + F.col("za") >= least) & (F.col("nq") + F.col("zb") >= least))
    less = F.struct("na", "a") < F.struct("nb", "b")
    pick = lambda x, y, name: F.when(less, F.col(x)).otherwise(F.col(y)).alias(name)
    few = few.select(pick("a", "b", "a"), pick("b", "a", "b"), F.lit(0).alias("k"), pick("np", "nq", "s"))
    # corners of a that look for partners and found b's, and those that pass 1 saw match
    both = met.union(few).groupBy("a", "b").agg(F.max("k").alias("k"), F.max("s").alias("s"))
    out = written(both.where("k + s >= 2").select("a", "b"), "candidates")
    for table in (runs, probing, split, held):
        discard(table)
    return out


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table that link, by all matches of their whole descriptors; b's are sent once for every PART pairs of it,
    so that b should be the one with more of them."""
    hot = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).alias("parts")).where("parts > 1"), "hot")  # a PART-th of the pairs at most
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    # only the images that are in a pair: a table that is written, so that Spark knows beforehand whether it is small enough to broadcast
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "wanted")
    body = written(classes.select("cls", "places", "words").join(wanted, "cls", "left_semi"), "bodies")
    heads = dealt.select("b", "part").distinct().join(body, F.col("b") == F.col("cls")).select("b", "part", F.lit(None).cast("long").alias("a"), "places", "words")
    members = dealt.join(body, F.col("a") == F.col("cls")).select("b", "part", "a", "places", "words")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        head, own = None, None
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("a", "b"))
            a, b = [], []
            at = 0
            while at < len(one):
                if one[at] is None:
                    head, own = two[at], Head(*(batch.column(c)[at].values.to_numpy() for c in ("places", "words")))
                    at += 1
                    continue
                end = at + 1  # the next ones of the same head, up to a bounded number of corners
                corners = len(batch.column("places")[at].values)
                while end < len(one) and one[end] is not None and two[end] == two[at] and corners < Head.STEP >> 4:
                    corners += len(batch.column("places")[end].values)
                    end += 1
                if two[at] == head:
                    places, words = (batch.column(c).slice(at, end - at) for c in ("places", "words"))
                    sizes = places.value_lengths().to_numpy()
                    votes = own.votes(places.flatten().to_numpy(), words.flatten().to_numpy(), sizes, np.array(one[at:end]) > head)  # as in voted
                    good = votes >= np.maximum(MIN_VOTES, MIN_SHARE * np.minimum(sizes, own.n))
                    a += [one[at + k] for k in np.flatnonzero(good).tolist()]
                    b += [head] * int(good.sum())
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = heads.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    found = written(rows.mapInArrow(run, "a long, b long"), "image-links")
    for table in (hot, wanted, body):
        discard(table)
    return found


def linked_components(classes: DataFrame) -> DataFrame:
    """id, comp (written): of the classes with links."""
    found = written(matches(classes), "matches")
    short = found.where("b is not null")
    long = found.where("b is null").select(F.shiftright("q", CHECK).alias("word"), F.col("a").alias("cls"), F.col("p").alias("place"), F.col("q").alias("key"))
    often = written(met_often(short.union(pivot_matches(long))), "often")
    links = written(voted(often, classes.select("cls", "n")).select("a", "b"), "image-links")
    comps = components(links)
    if not long.isEmpty():
        pairs = candidates(short, often, long, classes, comps)
        more = verified(pairs, classes)
        discard(pairs)
        if not more.isEmpty():
            discard(comps)
            comps = components(links.union(more))
        discard(more)
    for table in (found, often, links):
        discard(table)
    return comps


def classes_of(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The described images (row: a number of each), one of each class with corners; and cls, least (image_id) of each class. Both written.

    The further rows of a class are found without moving descriptors, and mostly are few enough to be broadcast.
    """
    seen = described.where("seen").select("cls", "image_id", "row")
    named = written(seen.groupBy("cls").agg(F.min("image_id").alias("least"), F.min("row").alias("first"), F.count("*").alias("k")), "named")
    spare = written(seen.join(dealt_anew(named.where("k > 1").select("cls", "first"), "cls"), "cls").where("row <> first").select("row"), "spare")
    classes = written(described.where("n > 0").join(spare, "row", "left_anti").select("cls", "n", "places", "words"), "image-classes")
    discard(spare)
    return classes, named


def copies(images: DataFrame, read=decode) -> DataFrame:
    """image_id, n_corners, class_id, component_id (least image_id of the linked images) of each image."""
    described = written(_described(images, read).withColumn("row", F.monotonically_increasing_id()), "corners")
    own = described.select("image_id", "n", "seen", F.col("cls").alias("class_id"))
    classes, named = classes_of(described)
    comps = linked_components(classes)
    discard(classes)
    # classes without links are their own components, so only those with links meet their component's least image
    tied = named.join(comps, named.cls == comps.id).select("cls", "comp", "least")
    least = tied.groupBy("comp").agg(F.min("least").alias("component_id"))
    tied = tied.join(dealt_anew(least, "comp"), "comp").select(F.col("cls").alias("id"), "component_id")
    table = named.join(tied, named.cls == tied.id, "left").select("cls", F.coalesce("component_id", "least").alias("component_id"))
    out = own.join(dealt_anew(table, "cls"), (F.col("class_id") == F.col("cls")) & F.col("seen"), "left")
    out = out.select("image_id", F.col("n").cast("long").alias("n_corners"), "class_id", F.when(F.col("seen"), F.col("component_id")).otherwise(F.col("image_id")).alias("component_id"))
    return holding(out, described, named, comps)


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so every page is drawn as one (its whole text) and copies are looked for among all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id image_id", "html media")
    return copies(pages, picture).withColumnRenamed("image_id", "page_id")
