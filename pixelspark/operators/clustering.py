"""Hits to clusters: neighbour joins, connected components, density clusters and the greedy bucket method.

The neighbour join is an equi-join on (pulse, cell): each hit stands in its own cell and, on the other side, is copied to
half of the cells around it, so that each pair of cells meets once; distance and time are checked afterwards. Cells are as wide as
the radius needs. Clustering is independent per pulse (keys: file, ext_tdc): hits are dealt by pulse and sorted once, and
kernels work on many whole pulses at a time. A pulse is bounded by the detector; grid and density clusters are also given as
joins for pulses that are not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelspark.config import U32, AlgorithmParams, ClusteringConfig, ClusteringError, algorithm
from pixelspark.operators.extraction import prune_small
from pixelspark.plans.checkpoints import dropped, tabled

PULSE = ("file", "ext_tdc")


def neighbours(hits: DataFrame, radius: float, window: int, keys: tuple[str, ...] = PULSE, order: str = "hit_id") -> DataFrame:
    """keys, a, b (orders, a before b): hits of one pulse within the radius and the time window, both inclusive."""
    cell = max(1, math.ceil(radius))
    span = window + 1
    at = hits.select(*keys, F.col(order).alias("o"), "x", "y", "tof")
    place = (F.floor(F.col("x") / cell), F.floor(F.col("y") / cell), F.floor(F.col("tof") / span))
    left = at.select(*keys, *(c.alias(n) for c, n in zip(place, ("cx", "cy", "ct"), strict=True)), F.struct("o", "x", "y", "tof").alias("p"))
    half = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in half))
    own = (F.col("d.i") == 0) & (F.col("d.j") == 0) & (F.col("d.k") == 0)
    right = at.withColumn("d", F.explode(around)).select(*keys, *((c + F.col(f"d.{d}")).alias(n) for c, d, n in zip(place, "ijk", ("cx", "cy", "ct"), strict=True)), F.struct("o", "x", "y", "tof", own.alias("own")).alias("q"))
    pairs = left.join(right, [*keys, "cx", "cy", "ct"]).where(~F.col("q.own") | (F.col("p.o") < F.col("q.o")))
    dx, dy = F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")
    near = (dx * dx + dy * dy <= F.lit(radius * radius)) & (F.abs(F.col("p.tof") - F.col("q.tof")) <= window)
    return pairs.where(near).select(*keys, F.least("p.o", "q.o").alias("a"), F.greatest("p.o", "q.o").alias("b"))


def core_hits(hits: DataFrame, radius: float, window: int, min_points: int, keys: tuple[str, ...] = PULSE, order: str = "hit_id") -> DataFrame:
    """keys, order, degree, is_core: neighbours other than itself, and whether there are min_points of them."""
    edges = neighbours(hits, radius, window, keys, order)
    ends = edges.select(*keys, F.explode(F.array("a", "b")).alias(order))
    degree = ends.groupBy(*keys, order).agg(F.count("*").alias("degree"))
    n = F.coalesce("degree", F.lit(0))
    return hits.select(*keys, order).join(degree, [*keys, order], "left").select(*keys, order, n.alias("degree"), (n >= min_points).alias("is_core"))


PAIRS = 1 << 21  # candidate pairs looked at at once


def near_pairs(group: np.ndarray, x: np.ndarray, y: np.ndarray, tof: np.ndarray, radius: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of hits of one group within radius and window, both inclusive."""
    cell = max(1, math.ceil(radius))
    code = group.astype(np.int64) << 34 | x // cell + 1 << 17 | y // cell + 1
    cells, own = np.unique(code, return_inverse=True)
    order = np.lexsort((tof, own))
    key = own[order] << 32 | tof[order]
    found = [(np.empty(0, np.int64),) * 2]
    for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
        to = code[order] + (dx << 17) + dy
        at = np.minimum(np.searchsorted(cells, to), len(cells) - 1)
        there = cells[at] == to
        start = at << 32
        low = np.searchsorted(key, start | np.maximum(tof[order] - window, 0)) if dx or dy else np.arange(1, len(key) + 1)
        high = np.where(there, np.searchsorted(key, start | np.minimum(tof[order] + window, U32), "right"), low)
        count = np.maximum(high - low, 0)
        first, total = 0, np.cumsum(count)
        while first < len(count):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, "right")))
            n = count[first:last]
            i = np.repeat(np.arange(first, last), n)
            j = np.repeat(low[first:last], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            i, j = order[i], order[j]
            good = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= radius * radius
            found.append((np.minimum(i[good], j[good]), np.maximum(i[good], j[good])))
            first = last
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index in each index's component of the graph with edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)  # hook the roots, then shorten the paths
        np.minimum.at(label, label[b], low)
        while not np.array_equal(short := label[label], label):
            label = short
        if np.array_equal(label, before):
            break
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _dense(group: np.ndarray, labels: np.ndarray, min_size: int, max_size: int | None) -> np.ndarray:
    """Labels 0, 1, ... by first appearance in each group; negative ones and clusters of the wrong size become -1."""
    found, first, inverse, count = np.unique(labels, return_index=True, return_inverse=True, return_counts=True)
    good = (found >= 0) & (count >= min_size) & ((count <= max_size) if max_size is not None else True)
    number = np.full(len(found), -1, np.int32)
    kept = np.flatnonzero(good)[np.argsort(first[good])]
    of = group[first[kept]]
    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[: len(of)]
    number[kept] = np.arange(len(kept)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
    return number[inverse]


def grid_labels(group, x, y, tof, c: ClusteringConfig, p: AlgorithmParams) -> np.ndarray:
    """Connected components of the neighbour graph; a hit alone is a cluster."""
    a, b = near_pairs(group, x, y, tof, c.radius, c.window_ticks)
    cell = p.grid_cell_size
    if c.radius > cell:  # pairs beyond the next cell are not seen
        close = (np.abs(x[a] // cell - x[b] // cell) <= 1) & (np.abs(y[a] // cell - y[b] // cell) <= 1)
        a, b = a[close], b[close]
    return joined(len(x), a, b)


def dbscan_labels(group, x, y, tof, c: ClusteringConfig, p: AlgorithmParams) -> np.ndarray:
    """Density clusters: components of core hits. A border hit goes to the cluster whose first core hit comes first."""
    a, b = near_pairs(group, x, y, tof, c.radius, c.window_ticks)
    n = len(x)
    core = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) >= p.dbscan_min_points
    inner = core[a] & core[b]
    label = joined(n, a[inner], b[inner])
    border = np.full(n, n)
    for one, two in ((a, b), (b, a)):
        at = core[one] & ~core[two]
        np.minimum.at(border, two[at], label[one[at]])
    return np.where(core, label, np.where(border < n, border, -1))


def abs_labels(group, x, y, tof, c: ClusteringConfig, p: AlgorithmParams) -> np.ndarray:
    """One group after another, see bucket_labels."""
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[: len(group)]
    out = np.empty(len(x), np.int64)
    for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)], strict=True):
        out[at:end] = bucket_labels(x[at:end], y[at:end], tof[at:end], c, p) + at  # labels stay apart
    return out


def bucket_labels(x, y, tof, c: ClusteringConfig, p: AlgorithmParams) -> np.ndarray:
    """Greedy buckets: a hit joins the first open bucket in the 3 x 3 cells around it whose box, grown by the radius, holds it
    and that began no longer than the window ago. The box grows with its hits, its start does not move. Every
    scan interval buckets that are too old leave their cell, the cell's last one taking their place."""
    reach, window, every = math.ceil(c.radius), c.window_ticks, p.abs_scan_interval
    row = 1 << 12  # cells of 32 pixels; a row has room for more of them than 16-bit places need
    around = (-row - 1, -row, 1 - row, -1, 0, 1, row - 1, row, row + 1)
    cells: dict[int, list[int]] = {}
    open_in = cells.get
    left, right, low, high, began, home, alive = [], [], [], [], [], [], []
    labels = [0] * len(x)
    at = ((y // 32) * row + x // 32).tolist()
    for k, (px, py, t, own) in enumerate(zip(x.tolist(), y.tolist(), tof.tolist(), at, strict=True)):
        if k and k % every == 0:
            stay = []
            for b in alive:
                if (t - began[b]) & U32 <= window:
                    stay.append(b)
                    continue
                members = cells[home[b]]
                members[members.index(b)] = members[-1]
                members.pop()
                if not members:
                    del cells[home[b]]
            alive = stay
        found = -1
        for step in around:
            for b in open_in(own + step, ()):
                if left[b] <= px <= right[b] and low[b] <= py <= high[b] and (t - began[b]) & U32 <= window:
                    found = b
                    break
            if found >= 0:
                break
        if found < 0:  # the box with its reach
            found = len(began)
            left.append(px - reach)
            right.append(px + reach)
            low.append(py - reach)
            high.append(py + reach)
            began.append(t)
            home.append(own)
            cells.setdefault(own, []).append(found)
            alive.append(found)
        else:
            if px - reach < left[found]:
                left[found] = px - reach
            elif px + reach > right[found]:
                right[found] = px + reach
            if py - reach < low[found]:
                low[found] = py - reach
            elif py + reach > high[found]:
                high[found] = py + reach
        labels[k] = found
    return np.array(labels, np.int64)


KERNELS = {"abs": abs_labels, "dbscan": dbscan_labels, "grid": grid_labels}


BATCH = 1 << 16  # hits that a kernel gets at once, and as many more as make the last pulse whole


def cluster_hits(hits: DataFrame, config: ClusteringConfig | None = None, name: str = "abs", params: AlgorithmParams | None = None, keys: tuple[str, ...] = PULSE) -> DataFrame:
    """hits with cluster_id set, each pulse (or other key) on its own. Order: tof, chip_id, packet_idx."""
    c, p, kernel = config or ClusteringConfig(), params or AlgorithmParams(), KERNELS[algorithm(name)]
    if "cluster_id" not in hits.columns:
        hits = hits.withColumn("cluster_id", F.lit(-1))
    columns = hits.columns

    def labelled(table):
        import pyarrow as pa

        new = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table[k].to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        group = np.cumsum(new)
        x, y, tof = (table[n].to_numpy().astype(np.int64) for n in ("x", "y", "tof"))
        labels = _dense(group, kernel(group, x, y, tof, c, p), c.min_cluster_size, c.max_cluster_size)
        yield from table.set_column(columns.index("cluster_id"), "cluster_id", pa.array(labels, pa.int32())).to_batches(BATCH)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = [table[k][-1].as_py() for k in keys]
            whole = table.num_rows  # up to where the last pulse, which may go on, begins
            same = np.ones(whole, bool)
            for k, v in zip(keys, last, strict=True):
                same &= table[k].to_numpy(zero_copy_only=False) == v
            whole -= int(np.argmin(same[::-1])) if not same.all() else whole
            if whole:
                yield from labelled(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield from labelled(pa.Table.from_batches(held).combine_chunks())

    dealt = hits.repartition(*keys).sortWithinPartitions(*keys, "tof", "chip_id", "packet_idx")
    return dealt.mapInArrow(run, hits.schema)


def components_sql(hits: DataFrame, radius: float, window: int, keys: tuple[str, ...] = PULSE, order: str = "hit_id", rounds: int = 200) -> DataFrame:
    """keys, order, cluster: the least order in each hit's component, by joins only, for pulses too large for a kernel.

    Labels move along the edges and by pointer jumping until none changes; each round is cut by a table.
    """
    edges = neighbours(hits, radius, window, keys, order)
    both = tabled(edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels, before = hits.select(*keys, F.col(order).alias("a"), F.col(order).alias("l")), None
    for _ in range(rounds):
        heard = both.join(labels.withColumnsRenamed({"a": "b", "l": "m"}), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("m").alias("m"))
        moved = labels.join(heard, [*keys, "a"], "left").withColumn("n", F.least("l", F.coalesce("m", "l")))
        jump = moved.select(*keys, F.col("a").alias("n"), F.col("n").alias("j"))
        new = tabled(moved.join(jump, [*keys, "n"]).select(*keys, "a", F.least("n", "j").alias("n"), "l"))
        labels = new.select(*keys, "a", F.col("n").alias("l"))
        if before is not None:
            dropped(before)
        before = new
        if new.where("n <> l").isEmpty():
            dropped(both)
            return labels.select(*keys, F.col("a").alias(order), F.col("l").alias("cluster"))
    raise ClusteringError(f"not settled after {rounds} rounds")


__all__ = ["abs_labels", "cluster_hits", "components_sql", "core_hits", "dbscan_labels", "grid_labels", "neighbours", "prune_small"]
