"""Exact n-gram Jaccard join with signature trees, and the components of its links.

Documents are sets of hashed 5-word shingles; equal sets are one class and need no links. Two classes link at a Jaccard
similarity of 3/4. The search is exact, in these steps, each a streaming pass over sorted rows:

1. Prefixes. Of the shingles in hash order each class sends the first n - ceil(3n/4) + l, l = n/16 + 1. Linked classes
   share at least l of them (l of the smaller partner). Shingles that no other class sends are dropped; of the others
   each class keeps its rarest, as many as needed to share at least one with every partner. A class that shares too few
   has no partner and leaves. A shared passage is frequent and so falls away unless it is most of a text.
2. Pivots. Within the classes of a size that keep a shingle, each is paired with the one of the smallest hash; a class's two
   most frequent pivots are verified against it. This ties groups of copies together with a few pairs per class.
3. Signature trees. Of the shingles whose classes are still in different components, those of the same classes count
   once. Their classes are dealt into nodes by size; a pair of nodes goes on unless it is in one component already or
   the sizes don't fit. In the task every node becomes a tree whose nodes hold the OR of the members' token bitmaps, size
   range and greatest bitmap loss; the dual traversal drops pairs whose largest possible overlap is too small or that one
   component holds, and what is left at the leaves is verified on the full sets. Two passes take the best pair of each
   member only, which joins what belongs together; the last pass takes every pair that is left.
4. Components by alternating large-star and small-star steps, cut by tables in the shared folder.

Nothing is emitted for all pairs of a group: members of one component are not compared again, and a group's other
pairs only reach verification when their bitmaps allow a link. Hashes of 64 bits stand for words, shingles and
sets (with the set's size); equal hashes count as equal.

Rows are told apart by doc_id and a hash of the row, so that null and repeated doc_ids lose nothing.

Defined results: null, empty and blank texts have n_shingles 0 and are their own component (null for a null doc_id); a
component's number is its least doc_id that is not null, and null if all are; a row without doc_id links like any other;
repeated rows have equal sets and share a component; a very long text is one set of all its shingles (a task holds the sets
of 128 texts at a time); a similarity of exactly 3/4 links, and ties between pivots go to the smaller number; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelspark.llm.common import _GOLD, blanks, dealt_anew, discard, fresh, holding, mixed, span_hashes, text_slices, written

WORDS, RARE, BITS, NODE, PART, SEEN, CHUNK = 5, 64, 2048, 4096, 256, 1 << 20, 1 << 18


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) + 1 for b in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    capital = (data >= 65) & (data <= 90)
    data = np.where(capital, data + np.uint8(32), data)
    blank = blanks(data)
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    ends = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, np.append(0, np.cumsum(sizes)))
    n_words = np.diff(first)
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - WORDS + 1 + k] if len(rolled) else rolled
    rolled = mixed(rolled + np.uint64(WORDS))
    out = []
    for at, n in zip(first.tolist(), n_words.tolist(), strict=False):
        if n >= WORDS:
            out.append(np.unique(rolled[at : at + n - WORDS + 1]))
        elif n:
            h = np.zeros(1, np.uint64)
            for w in words[at : at + n]:
                h = h * np.uint64(0xD6E8FEB86659FD93) + w
            out.append(mixed(h + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A class's number: a hash of its set, as a signed 64-bit number."""
    return int(mixed(np.add.reduce(mixed(s), keepdims=True) + np.array([len(s)], np.uint64) * _GOLD).view(np.int64)[0])


def shared_of(n):
    """How many prefix shingles two linked classes, the smaller of size n, share at least."""
    return n // 16 + 1


def prefix_of(n: int) -> int:
    return n - (3 * n + 3) // 4 + shared_of(n)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(s >> np.uint64(20)).astype(np.int64) % BITS] = 1
    return np.packbits(bits).tobytes()


def _runs(batches: Iterator, key: str) -> Iterator:
    """(rows of one key as numpy columns); batches come sorted by the key. For keys with a bounded number of rows."""
    held: dict | None = None
    for batch in batches:
        cols = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        if held is not None:
            cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
        if not len(cols[key]):
            continue
        cuts = np.flatnonzero(np.diff(cols[key])) + 1
        bounds = [0, *cuts.tolist()]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield {k: v[a:b] for k, v in cols.items()}
        held = {k: v[bounds[-1] :] for k, v in cols.items()}
    if held is not None and len(held[key]):
        yield held


def row_hash(docs: DataFrame) -> Column:
    """A hash of a row. With the doc_id it names the row: rows that agree in both are repeats of one row."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, row (its hash), id, n of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [s for _, texts in text_slices(batch) for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "row", "id", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), "text").mapInArrow(run, "doc_id long, row long, id long, n long")


def prefixes(docs: DataFrame) -> DataFrame:
    """h, id, n: the prefix shingles of each class, once or a few times per task and class.

    Of a shingle that RARE or more classes of one chunk send (CHUNK shingles, and the texts read with the last), RARE go to the
    shingle's task, which is enough to tell that it is frequent; the others' n is negative: they are known to be so and are
    dealt by themselves. So no shingle brings more than RARE rows per chunk to one task, however many texts share it.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        parts, ids, sizes = [], [], []

        def chunk():
            counts = [len(p) for p in parts]
            h, n = np.concatenate(parts).view(np.int64), np.repeat(np.array(sizes, np.int32), counts)
            order = np.argsort(h, kind="stable")
            start = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
            place = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
            n[order[place >= RARE]] *= -1
            out = pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(ids, counts)), pa.array(n)], names=["h", "id", "n"])
            for held in (parts, ids, sizes):
                held.clear()
            return out

        for batch in batches:
            if len(seen) > SEEN:  # repeats are dropped again where rows meet
                seen.clear()
            for _, texts in text_slices(batch):
                for s in shingle_sets(texts):
                    if len(s) and (k := set_id(s)) not in seen:
                        seen.add(k)
                        parts.append(s[: prefix_of(len(s))].copy())
                        ids.append(k)
                        sizes.append(len(s))
                if sum(map(len, parts)) >= CHUNK:
                    yield chunk()
        if parts:
            yield chunk()

    return docs.select("text").mapInArrow(run, "h long, id long, n int")


def shared_shingles(rows: DataFrame) -> DataFrame:
    """id, n, h, freq of the shingles that two or more classes send; freq is the number of classes, RARE at most."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # Of a shingle that goes on in the next batch, RARE rows at most are carried; more of it are sure to be frequent.
        carry, frequent = None, None
        names = ["id", "n", "h", "freq"]
        last = (None, None)

        def finish(h, i, n, final: bool):
            nonlocal carry, frequent
            if not len(h):
                return None
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(start, len(h)))
            freq = np.repeat(np.minimum(size, RARE), size)
            if frequent is not None and h[0] == frequent:
                freq[: size[0]] = RARE
            keep = freq >= 2
            carry = None
            if not final:
                tail = size[-1]
                if freq[-1] >= RARE:
                    frequent = h[-1]
                else:
                    carry = (h[-tail:], i[-tail:], n[-tail:])
                    keep[-tail:] = False
                    frequent = None
            return pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(n[keep]), pa.array(h[keep]), pa.array(freq[keep].astype(np.int32))], names=names)

        for batch in batches:
            h, i, n = (batch.column(c).to_numpy() for c in ("h", "id", "n"))
            known = n < 0
            if known.any():  # they come first
                yield pa.RecordBatch.from_arrays([pa.array(i[known]), pa.array(-n[known]), pa.array(h[known]), pa.array(np.full(int(known.sum()), RARE, np.int32))], names=names)
                h, i, n = h[~known], i[~known], n[~known]
            if not len(h):
                continue
            new = np.append((h[0], i[0]) != last, (h[1:] != h[:-1]) | (i[1:] != i[:-1]))  # copies sent by several tasks
            last = (h[-1], i[-1])
            h, i, n = h[new], i[new], n[new]
            if carry is not None:
                h, i, n = (np.concatenate([a, b]) for a, b in zip(carry, (h, i, n), strict=True))
            if (out := finish(h, i, n, False)) is not None:
                yield out
        if carry is not None and (out := finish(*carry, True)) is not None:
            yield out

    known = F.col("n") < 0
    dealt = rows.repartition(F.when(known, F.xxhash64("h", "id")).otherwise(F.col("h"))).sortWithinPartitions(~known, "h", "id")
    return dealt.mapInArrow(run, "id long, n int, h long, freq int")


def rarest(rows: DataFrame) -> DataFrame:
    """h, id, n: of each class's shared shingles the rarest, as many as it needs to meet every partner."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []
        for own in _runs(batches, "id"):
            once = np.append(True, np.diff(own["h"]) != 0)  # several tasks may have sent a class
            own = {name: c[once] for name, c in own.items()}
            n = int(own["n"][0])
            k = len(own["h"]) - int(shared_of((3 * n + 3) // 4)) + 1
            if k > 0:
                out.append((own["h"][:k], own["id"][:k], own["n"][:k]))
            if len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["h", "id", "n"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["h", "id", "n"])

    dealt = rows.repartition("id").sortWithinPartitions("id", "freq", "h")
    return dealt.mapInArrow(run, "h long, id long, n int")


def pivots(rows: DataFrame) -> DataFrame:
    """a, b: each class with its two most frequent pivots. A shingle's pivot is the class of the smallest number (a hash) among
    those of a size class, so a group of copies agrees on few pivots."""
    size = F.floor(F.log(F.col("n").cast("double")) * (2 / np.log(4 / 3)))
    rows = rows.select("h", size.alias("c"), "id")
    least = rows.groupBy("h", "c").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b < most").drop("most")
    met = rows.join(dealt_anew(least, "h"), ["h", "c"]).where("id <> b")
    counted = met.groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("k"))
    best = Window.partitionBy("a").orderBy(F.col("k").desc(), "b")
    return counted.withColumn("r", F.row_number().over(best)).where("r <= 2").select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, s (the set), bits: of the classes that `wanted` (doc_id, row) stands for."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, texts in text_slices(batch):
                sets = [s for s in shingle_sets(texts) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary())], names=["id", "s", "bits"])

    named = docs.select(F.col("doc_id").cast("long").alias("_doc"), row_hash(docs).alias("_row"), "text")
    kept = named.join(wanted, (F.col("_row") == F.col("row")) & F.col("_doc").eqNullSafe(F.col("doc_id")), "left_semi").select("text")
    return kept.mapInArrow(run, "id long, s binary, bits binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. b's set is sent once for every PART pairs of it, a's with each pair."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pivot, own = None, None
        for batch in batches:
            a, b = [], []
            for p, i, raw in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), batch.column("s"), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if i is None:
                    pivot, own = p, s.copy()
                elif p == pivot and linked(own, s):
                    a.append(i)
                    b.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    pairs = pairs if hasattr(pairs, "_scratch") else written(pairs, "candidates")
    # only pivots with more than PART pairs are split, so this table has at most a PART-th as many rows as there are pairs
    hot = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).alias("parts")).where("parts > 1"), "hot")
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pairs.join(hot, "b", "left").select("a", "b", part.alias("part"))
    heads = dealt.select("b", "part").distinct().join(sets, F.col("b") == F.col("id")).select("b", "part", F.lit(None).cast("long").alias("a"), "s")
    members = dealt.join(sets, F.col("a") == F.col("id")).select("b", "part", "a", "s")
    rows = heads.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    found = written(rows.mapInArrow(run, "a long, b long"), "links")
    discard(pairs)
    discard(hot)
    return found


def components(links: DataFrame) -> DataFrame:
    """id, comp: the least id reachable, for ids with links. Large-star and small-star steps until nothing changes.

    The hub of a star has as many links as its group has members; its join may be split, since the other side is dealt anew.
    """
    told = lambda df: df.selectExpr("count(*) n", "bit_xor(xxhash64(u, v)) x").first()
    edges = written(links.selectExpr("greatest(a, b) u", "least(a, b) v").where("u <> v").distinct(), "edges")
    seen = told(edges)
    while True:
        before = edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.where("v > u").join(dealt_anew(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # large
        star = star.where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        star = star.join(low, "u")  # small: a node has few smaller neighbours left
        star = star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(star, "edges")
        discard(before)
        seen, last = told(edges), seen
        if seen == last:
            break
    found = written(edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()), "comps")
    discard(edges)
    return found


class Tree:
    """A signature tree over members sorted by size: columns n, comp, bits (rows of 64-bit words)."""

    LEAF, WIDE = 16, 8

    def __init__(self, n: np.ndarray, ids: np.ndarray, comp: np.ndarray, bits: np.ndarray):
        self.n, self.ids, self.comp, self.bits = n, ids, comp, bits
        self.loss = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = []  # of nodes, leaves first: first, end, least n, most n, most loss, component or None, OR
        spans = [(k, min(len(n), k + self.LEAF)) for k in range(0, len(n), self.LEAF)]
        below = None
        while True:
            level = []
            for k, (a, b) in enumerate(spans):
                one = bool((comp[a:b] == comp[a]).all())
                whole = np.bitwise_or.reduce(bits[a:b]) if below is None else np.bitwise_or.reduce([x[6] for x in below[k * self.WIDE : (k + 1) * self.WIDE]])
                level.append((a, b, int(n[a]), int(n[b - 1]), int(self.loss[a:b].max()), comp[a] if one else None, whole))
            self.levels.append(level)
            if len(level) <= 1:
                break
            spans = [(level[k][0], level[min(len(level), k + self.WIDE) - 1][1]) for k in range(0, len(level), self.WIDE)]
            below = level

    def children(self, depth: int, k: int) -> range:
        return range(k * self.WIDE, min(len(self.levels[depth - 1]), (k + 1) * self.WIDE))


def may_link(x: tuple, y: tuple) -> bool:
    """Whether some members of two nodes may link: not one component, sizes that fit, and enough possible overlap."""
    if x[5] is not None and x[5] == y[5] or 3 * x[2] > 4 * y[3] or 3 * y[2] > 4 * x[3]:
        return False
    most = min(x[4], y[4]) + int(np.bitwise_count(x[6] & y[6]).sum())
    return 7 * most >= 3 * (x[2] + y[2])


def dual(one: Tree, two: Tree, best_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids that may link, by traversing both trees at once; the same tree twice gives each pair once.

    best_only: of each member's pairs the one of the largest possible similarity.
    """
    alone = one is two
    found = [(np.zeros(len(t.n)), np.zeros(len(t.n), np.int64)) for t in ((one,) if alone else (one, two))]
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        d, k, e, j = stack.pop()
        x, y = one.levels[d][k], two.levels[e][j]
        if not may_link(x, y):
            continue
        if d == 0 and e == 0:
            a, b = slice(x[0], x[1]), slice(y[0], y[1])
            both = np.bitwise_count(one.bits[a][:, None, :] & two.bits[b][None, :, :]).sum(axis=2, dtype=np.int64)
            most = both + np.minimum(one.loss[a][:, None], two.loss[b][None, :])
            size = one.n[a][:, None] + two.n[b][None, :]
            good = (7 * most >= 3 * size) & (one.comp[a][:, None] != two.comp[b][None, :])
            good &= (3 * one.n[a][:, None] <= 4 * two.n[b][None, :]) & (3 * two.n[b][None, :] <= 4 * one.n[a][:, None])
            if alone and k == j:
                good &= np.triu(np.ones(good.shape, bool), 1)
            if not good.any():
                continue
            if not best_only:
                p, q = np.nonzero(good)
                yield one.ids[a][p], two.ids[b][q]
                continue
            like = np.where(good, most / size, 0.0)
            for (score, mate), at, ids, table in ((found[0], a, two.ids[b], like), (found[-1], b, one.ids[a], like.T)):
                top = table.argmax(axis=1)
                value = table[np.arange(len(top)), top]
                up = value > score[at]
                score[at][up], mate[at][up] = value[up], ids[top[up]]
        elif e == 0 or d > e:
            stack += [(d - 1, c, e, j) for c in one.children(d, k)]
        elif d == 0 or e > d:
            stack += [(d, k, e - 1, c) for c in two.children(e, j)]
        else:
            stack += [(d - 1, c, e - 1, f) for c in one.children(d, k) for f in two.children(e, j) if not alone or k != j or f >= c]
    for (score, mate), tree in zip(found, (one, two), strict=False):
        if (hit := score > 0).any():
            yield tree.ids[hit], mate[hit]


def tree_pairs(rows: DataFrame, sets: DataFrame, comps: DataFrame, best_only: bool = False) -> DataFrame:
    """a, b: pairs of classes in different components that the signature trees leave, all or the best of each class."""
    named = rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named = written(named.select("h", "id", "n", "comp"), "named")
    groups = named.groupBy("h").agg(F.count("*").alias("k"), F.expr("bit_xor(id)").alias("x"), F.expr("bit_xor(xxhash64(id))").alias("y"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    once = groups.where("lo < hi").groupBy("k", "x", "y").agg(F.min("h").alias("h"))
    members = named.join(once.select("h", "k"), "h")
    node = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("long") * 1_000_000 + F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / NODE))
    members = written(members.withColumn("node", node).select("h", "id", "n", "comp", "node"), "members")
    nodes = members.groupBy("h", "node").agg(F.min("n").alias("small"), F.max("n").alias("large"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x, y = nodes.alias("x"), nodes.alias("y")
    fits = (3 * F.col("x.small") <= 4 * F.col("y.large")) & (3 * F.col("y.small") <= 4 * F.col("x.large"))
    apart = (F.col("x.lo") != F.col("y.lo")) | (F.col("x.hi") != F.col("y.hi")) | (F.col("x.lo") != F.col("x.hi"))
    tiles = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.node") <= F.col("y.node")) & fits & apart).select(F.col("x.h").alias("h"), F.col("x.node").alias("p"), F.col("y.node").alias("q"))
    # A tile's two nodes: side 0 and, where they differ, side 1. Its number stands for (h, p, q).
    ends = tiles.select("h", F.xxhash64("h", "p", "q").alias("tile"), F.explode(F.when(F.col("p") == F.col("q"), F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("node")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("node")), F.struct(F.lit(1).alias("side"), F.col("q").alias("node"))))).alias("e")).select("h", "tile", "e.side", "e.node")
    dealt = members.join(ends, ["h", "node"]).join(sets.select("id", "bits"), "id").select("tile", "side", "n", "id", "comp", "bits")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for own in _runs(batches, "tile"):
            bits = np.frombuffer(b"".join(own["bits"]), np.uint64).reshape(len(own["id"]), -1)
            trees = []
            for side in (0, 1):
                at = own["side"] == side
                if at.any():
                    trees.append(Tree(own["n"][at].astype(np.int64), own["id"][at], own["comp"][at], bits[at]))
            for a, b in dual(trees[0], trees[-1], best_only):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    dealt = dealt.repartition("tile").sortWithinPartitions("tile", "side", "n", "id")
    found = written(dealt.mapInArrow(run, "a long, b long").distinct(), "pairs")
    discard(named)
    discard(members)
    return found


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, row (row_hash), n_shingles, component_id, stays of every document.

    stays: whether the row is the first of its component, by doc_id (null last) and row hash; repeats of the first row all
    are. Rows without words are first of their own.
    """
    every = written(classes(docs), "classes")
    rows = written(rarest(shared_shingles(prefixes(docs))), "rarest")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    firsts = written(every.where("n > 0").groupBy("id").agg(first), "firsts")
    wanted = firsts.join(rows.select("id").distinct(), "id", "left_semi").select("first.doc_id", "first.row")
    sets = written(sets_of(docs, wanted).dropDuplicates(["id"]), "sets")
    found = [verified(pivots(rows), sets)]
    comps = components(found[0])
    best_only = True
    while True:  # the last pass is exhaustive; those before leave it little to do
        more, last = verified(tree_pairs(rows, sets, comps, best_only), sets), not best_only
        n = more.count()
        best_only = 2 * n > comps.count()  # much was joined, so the next pass might join much
        found.append(more)
        if n:
            discard(comps)
            comps = components(reduce(DataFrame.union, found))
        if last:
            break
    for table in (rows, sets, *found):
        discard(table)
    # classes without links are their own components, so only those with links meet their component's first row
    tied = firsts.join(comps, "id")
    least = tied.groupBy("comp").agg(F.min("first").alias("least"))
    tied = tied.join(dealt_anew(least, "comp"), "comp").select("id", "least")
    labels = firsts.join(tied, "id", "left").select(F.col("id").alias("_id"), F.coalesce("least", "first").alias("least"))
    out = every.join(dealt_anew(labels, "_id"), (F.col("id") == F.col("_id")) & (F.col("n") > 0), "left")
    worded = F.col("n") > 0
    stays = ~worded | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("row").eqNullSafe(F.col("least.row")))
    out = out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(worded, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), stays.alias("stays"))
    return holding(out, every, firsts, comps)


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return groups(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs without the rows that are near copies of another one: of each component its first row (see groups) stays."""
    found = written(groups(docs), "groups")
    doc, row = fresh("_doc", docs), fresh("_row", docs)
    name = {"doc_id": doc, "row": row}
    others = found.where("not stays").select("doc_id", "row").distinct().withColumnsRenamed(name)
    repeated = found.where("stays and n_shingles > 0").groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row").withColumnsRenamed(name)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (row_hash(docs) == F.col(row))
    kept = docs.join(others, same, "left_anti")
    if repeated.isEmpty():
        return kept
    # repeats of one row agree in all columns, so it doesn't matter which of them stays
    return kept.join(repeated, same, "left_anti").union(kept.join(repeated, same, "left_semi").dropDuplicates())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows in DuckDB: all pairs that share a shingle, by counting, and their closure.
OP7_SQL = r"""
with recursive d as (select row_number() over () rid, doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+') if x <> ''] ws from documents),
s as (select distinct rid, doc_id, array_to_string(ws[i:i + 4], ' ') g from (select rid, doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i from d where len(ws) > 0)),
n as (select rid, doc_id, count(*) n from s group by all),
p as (select a.rid a, b.rid b, count(*) k from s a join s b on a.g = b.g and a.rid < b.rid group by all),
l as (select a, b from p join n x on x.rid = a join n y on y.rid = b where 100 * k >= 75 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(rid, to_rid) as (select rid, rid from n union select r.rid, e.b from r join e on e.a = r.to_rid),
c as (select r.rid, min(doc_id) component_id from r join n on n.rid = r.to_rid group by r.rid)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.component_id, d.doc_id)::bigint component_id
from d left join n using (rid) left join c using (rid)
"""
