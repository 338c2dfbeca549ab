import pytest

from pixelspark.config import ExtractionConfig
from pixelspark.operators import extraction

HIT = "file string, ext_tdc long, packet_idx long, x int, y int, tof long, tot int, chip_id int, cluster_id int"


def extract(spark, rows, **config):
    hits = spark.createDataFrame([("f", 1, k, x, y, tof, tot, chip, cluster) for k, (tof, x, y, tot, chip, cluster) in enumerate(rows)], HIT)
    return extraction.extract_neutrons(hits, ExtractionConfig(**config)).orderBy("cluster_id").collect()


@pytest.mark.parametrize("rows, config, want", [
    ([(1000, 100, 200, 50, 0, 0)], {}, [(800, 1600, 1000, 50, 1, 0)]),
    ([(1000, 0, 0, 30, 0, 0), (1000, 2, 0, 10, 0, 0)], {}, [(4.0, 0, 1000, 40, 2, 0)]),
    ([(1000, 10, 10, 50, 0, 0), (1000, 11, 10, 50, 0, 0), (2000, 100, 100, 50, 1, 1)], {}, [(84, 80, 1000, 100, 2, 0), (800, 800, 2000, 50, 1, 1)]),
    ([(1000, 0, 0, 5, 0, 0), (1000, 10, 0, 15, 0, 0), (1000, 20, 0, 20, 0, 0)], {}, [(8 * 550 / 35, 0, 1000, 35, 2, 0)]),
    ([(1000, 0, 0, 5, 0, 0), (1000, 1, 0, 8, 0, 0)], {}, []),
    ([(1000, 0, 0, 5, 0, 0), (1000, 0, 0, 3, 0, 0)], {"min_tot_threshold": 0}, [(0, 0, 1000, 8, 2, 0)]),
    ([(1000, 10, 20, 0, 0, 0), (1000, 30, 40, 0, 0, 0)], {"min_tot_threshold": 0}, [(160, 240, 1000, 0, 2, 0)]),
    ([(1000, 2, 3, 20, 0, 0)], {"min_tot_threshold": 0, "super_resolution_factor": 4.0}, [(8, 12, 1000, 20, 1, 0)]),
    ([(1000, 0, 0, 20, 0, -1)], {}, []),
    ([(5, 0, 0, 20, 1, 0), (6, 0, 0, 20, 2, 0)], {}, [(0, 0, 6, 40, 2, 2)]),
    ([(1, 0, 0, 1023, 0, 0)] * 100, {}, [(0, 0, 1, 65535, 100, 0)]),
])
def test_centroids(spark, rows, config, want):
    got = [(r.x, r.y, r.tof, r.tot, r.n_hits, r.chip_id) for r in extract(spark, rows, **config)]
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w)


def test_statistics(spark):
    n = spark.createDataFrame([(0.0, 0.0, 1000, 10, 1), (1.0, 1.0, 1010, 10, 3), (2.0, 2.0, 1005, 10, 2)], "x double, y double, tof long, tot int, n_hits int")
    s = extraction.neutron_statistics(n).first()
    assert (s.mean_tof, s.single_hit_fraction, s.max_x) == (1005, pytest.approx(1 / 3), 2.0)
    empty = extraction.neutron_statistics(n.where("x > 9")).first()
    assert empty["count"] == 0 and empty.std_tof == 0


def test_prune_limits(spark):
    rows = [("f", 1, k, 0, 0, k, 20, 0, c) for k, c in enumerate([5, 5, 3, 7, 7, 7])]
    hits = spark.createDataFrame(rows, HIT)
    small = {r.packet_idx: r.cluster_id for r in extraction.prune_small(hits, 2).collect()}
    assert small == {0: 0, 1: 0, 2: -1, 3: 1, 4: 1, 5: 1}
    both = {r.packet_idx: r.cluster_id for r in extraction.prune_small(hits, 2, max_size=2).collect()}
    assert both == {0: 0, 1: 0, 2: -1, 3: -1, 4: -1, 5: -1}
