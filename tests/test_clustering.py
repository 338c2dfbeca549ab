import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelspark.config import AlgorithmParams, ClusteringConfig, ConfigError, algorithm
from pixelspark.operators import clustering

HIT = "file string, ext_tdc long, packet_idx long, x int, y int, tof long, tot int, chip_id int"


def frame(spark, hits, tot=20):
    return spark.createDataFrame([("f", 1, k, x, y, t, tot, 0) for k, (x, y, t) in enumerate(hits)], HIT)


def labels(name, hits, **config):
    x, y, t = (np.array(c, np.int64) for c in zip(*hits, strict=True))
    c = ClusteringConfig(**{"radius": 5.0, "temporal_window_ns": 100.0, **config})
    one = np.zeros(len(x), np.int64)
    return clustering._dense(one, clustering.KERNELS[name](one, x, y, t, c, AlgorithmParams()), c.min_cluster_size, c.max_cluster_size)


def test_two_groups_for_every_method(spark):
    hits = [(100 + i % 3, 100 + i // 3, 1000) for i in range(10)] + [(150 + i % 3, 150 + i // 3, 2000) for i in range(10)]
    for name in clustering.KERNELS:
        out = clustering.cluster_hits(frame(spark, hits), ClusteringConfig(5.0, 100.0), name)
        assert out.select("cluster_id").distinct().count() == 2


def test_time_window():
    assert labels("grid", [(10, 10, 100), (10, 10, 101), (10, 10, 200)], temporal_window_ns=50.0).tolist() == [0, 0, 1]


def test_dbscan_drops_small_clusters():
    hits = [(10 + i % 2, 10 + i // 2, 100) for i in range(5)] + [(50 + i, 50, 200) for i in range(3)]
    assert labels("dbscan", hits, radius=3.0, temporal_window_ns=50.0, min_cluster_size=4).tolist() == [0] * 5 + [-1] * 3


def test_places_beyond_512():
    hits = [(100 + i, 100, 100) for i in range(10)] + [(100 + i, 600, 600) for i in range(10)]
    assert labels("dbscan", hits).tolist() == [0] * 10 + [1] * 10


def test_greedy_buckets_grow_but_do_not_wait():
    # the box grows along x; the window counts from the first hit, so the last hit opens a new bucket
    assert labels("abs", [(10, 10, 0), (14, 10, 1), (18, 10, 2), (18, 10, 5)]).tolist() == [0, 0, 0, 1]


def test_names():
    assert algorithm("DBSCAN") == "dbscan"
    try:
        algorithm("graph")
        raise AssertionError
    except ConfigError:
        pass


points = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(0, 30)), min_size=1, max_size=60)


@settings(max_examples=60, deadline=None)
@given(points)
def test_grid_is_connected_components(hits):
    hits = sorted(hits, key=lambda h: h[2])
    found = labels("grid", hits)
    root = list(range(len(hits)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (x, y, t) in enumerate(hits):
        for j in range(i):
            u, v, s = hits[j]
            if (x - u) ** 2 + (y - v) ** 2 <= 25 and t - s <= 4:
                root[find(i)] = find(j)
    for i in range(len(hits)):
        for j in range(i):
            assert (found[i] == found[j]) == (find(i) == find(j))


@settings(max_examples=40, deadline=None)
@given(points)
def test_dbscan_against_definition(hits):
    hits = sorted(hits, key=lambda h: h[2])
    found = labels("dbscan", hits)
    near = [[j for j, (u, v, s) in enumerate(hits) if j != i and (x - u) ** 2 + (y - v) ** 2 <= 25 and abs(t - s) <= 4] for i, (x, y, t) in enumerate(hits)]
    core = [len(n) >= 2 for n in near]
    for i, n in enumerate(near):
        assert (found[i] < 0) == (not core[i] and not any(core[j] for j in n))
        if core[i]:
            assert all(found[j] == found[i] for j in n if core[j])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90), st.integers(0, 25)), min_size=1, max_size=80), st.integers(1, 9))
def test_greedy_buckets_against_definition(hits, interval):
    """Buckets as (hits, cell) in the order in which their cells list them."""
    hits = sorted(hits, key=lambda h: h[2])
    cells, want, made = {}, [], []
    for k, (x, y, t) in enumerate(hits):
        if k and k % interval == 0:
            for cell, own in cells.items():
                for bucket in [b for b in made if b in own and t - hits[b[0]][2] > 4]:  # the last one takes the old one's place
                    spot = own.index(bucket)
                    own[spot] = own[-1]
                    own.pop()
        found = None
        for cy in range(y // 32 - 1, y // 32 + 2):
            for cx in range(x // 32 - 1, x // 32 + 2):
                for bucket in cells.get((cx, cy), []):
                    xs, ys = [hits[j][0] for j in bucket], [hits[j][1] for j in bucket]
                    if found is None and min(xs) - 5 <= x <= max(xs) + 5 and min(ys) - 5 <= y <= max(ys) + 5 and t - hits[bucket[0]][2] <= 4:
                        found = bucket
        if found is None:
            found = []
            made.append(found)
            cells.setdefault((x // 32, y // 32), []).append(found)
        found.append(k)
        want.append(id(found))
    x, y, t = (np.array(c, np.int64) for c in zip(*hits, strict=True))
    got = clustering.bucket_labels(x, y, t, ClusteringConfig(5.0, 100.0), AlgorithmParams(abs_scan_interval=interval)).tolist()
    assert [want.index(w) for w in want] == [got.index(g) for g in got]


@settings(max_examples=60, deadline=None)
@given(st.lists(points, min_size=1, max_size=4), st.integers(1, 50))
def test_pulses_at_once_as_one_by_one(pulses, candidates):
    pulses = [sorted(p, key=lambda h: h[2]) for p in pulses]
    group = np.repeat(np.arange(len(pulses)), [len(p) for p in pulses])
    x, y, t = (np.array([h[k] for p in pulses for h in p], np.int64) for k in range(3))
    c = ClusteringConfig(5.0, 100.0, 2)
    before, clustering.PAIRS = clustering.PAIRS, candidates
    try:
        for name, kernel in clustering.KERNELS.items():
            found = clustering._dense(group, kernel(group, x, y, t, c, AlgorithmParams()), 2, None)
            assert found.tolist() == [k for p in pulses for k in labels(name, p, min_cluster_size=2).tolist()]
    finally:
        clustering.PAIRS = before


def test_many_pulses_over_batches(spark, monkeypatch):
    import random

    rng = random.Random(7)
    rows = [("fg"[k % 2], k % 23, k, rng.randint(0, 40), rng.randint(0, 40), rng.randint(0, 60), 20, 0) for k in range(900)]
    hits = spark.createDataFrame(rows, HIT)
    for name in clustering.KERNELS:
        found = {}
        for batch in (1, 50, 1 << 16):
            monkeypatch.setattr(clustering, "BATCH", batch)
            found[batch] = sorted(map(tuple, clustering.cluster_hits(hits, ClusteringConfig(5.0, 75.0), name).collect()))
        assert found[1] == found[50] == found[1 << 16] and len(found[1]) == 900


def test_joins_give_the_same_components(spark):
    import random

    rng = random.Random(5)
    hits = frame(spark, [(rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 20)) for _ in range(80)])
    kernel = clustering.cluster_hits(hits, ClusteringConfig(5.0, 75.0), "grid").collect()
    joins = {r.packet_idx: r.cluster for r in clustering.components_sql(hits, 5.0, 3, order="packet_idx").collect()}
    for a in kernel:
        for b in kernel:
            assert (a.cluster_id == b.cluster_id) == (joins[a.packet_idx] == joins[b.packet_idx])
