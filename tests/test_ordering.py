import random

import numpy as np
from pyspark.sql import functions as F

from pixelspark import api
from pixelspark.config import ClusteringConfig, DetectorConfig
from pixelspark.operators import ordering
from pixelspark.sources import tpx3
from pixelspark.sources.tpx3 import header as H
from pixelspark.sources.tpx3 import hit, tdc
from pixelspark.streaming import pulses as streaming


def packets(spark, words, file="f"):
    rows = [(file, k, w - (1 << 64) if w >= 1 << 63 else w) for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "file string, packet_idx long, raw long")


def tofs(spark, words, block=ordering.BLOCK):
    rows = ordering.ordered(ordering.read_hits(packets(spark, words), block=block)).collect()
    return [(r.tof, r.chip_id) for r in rows]


def test_chips_interleave(spark):
    words = [H(0), tdc(1000), hit(1100), tdc(2000), hit(2100), tdc(3000), H(1), tdc(1000), hit(1200), tdc(2000), hit(2050), tdc(3000)]
    for block in (1, 3, 1 << 16):
        assert tofs(spark, words, block) == [(100, 0), (200, 1), (50, 1), (100, 0)]
    assert ordering.sections(packets(spark, words)).count() == 2


def test_hit_counter_turns_over(spark):
    assert tofs(spark, [H(0), tdc(0x3FFFF000), hit(1), tdc(0x3FFFF000 + 10000 & 0x3FFFFFFF)]) == [(4097, 0)]


def test_late_hit_joins_the_pulse_before(spark):
    words = [H(0), tdc(1000), hit(1100), tdc(2000), hit(1950, address=1), hit(2100, address=2), tdc(3000)]
    assert [t for t, _ in tofs(spark, words)] == [100, 950, 100]


def test_markers_turn_over(spark):
    words = [H(0), tdc(0x3FFFF000), hit(0x3FFFF000 + 10), tdc(0x1000), hit(0x1000 + 30), H(1), tdc(0x3FFFF100), hit(0x3FFFF100 + 20)]
    assert sorted((c, t) for t, c in tofs(spark, words)) == [(0, 10), (0, 30), (1, 20)]


def test_sections_hand_on_markers(spark):
    one = ordering.sections(packets(spark, [H(0), tdc(1000), hit(100), H(0), hit(200)])).orderBy("section_no").collect()
    assert len(one) == 2 and one[1].initial_tdc == 1000
    two = ordering.sections(packets(spark, [H(0), tdc(1000), H(1), tdc(2000), H(0), hit(300)])).orderBy("section_no").collect()
    assert two[2].initial_tdc == 1000


def test_result_does_not_depend_on_blocks_and_equals_the_stream(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words, now = [], 0
    for _ in range(600):
        now = (now + rng.randint(0, 4_000_000)) % (1 << 30)
        words.append(rng.choice([H(rng.randint(0, 2)), tdc(now), hit((now + rng.randint(-3000, 900_000)) % (1 << 30), rng.randint(1, 50), rng.randint(0, 65535)), hit(now, 20, 5)]))
    table = packets(spark, [hit(1), tdc(1), *words])
    names = ("packet_idx", "ext_tdc", "tof", "timestamp", "chip_id", "x", "y")
    found = {tuple(r) for r in ordering.read_hits(table, block=7).select(*names).collect()}
    assert found == {tuple(r) for r in ordering.read_hits(table).select(*names).collect()}
    marks = [sorted(map(tuple, ordering.pulses(table, b).collect())) for b in (5, 1 << 20)]
    assert marks[0] == marks[1]
    assert sorted(map(str, ordering.rollovers(table, 500_000, 9).collect())) == sorted(map(str, ordering.rollovers(table, 500_000).collect()))
    assert sorted(map(str, ordering.disorder(ordering.summaries(table, 3)).collect())) == sorted(map(str, ordering.disorder(ordering.summaries(table)).collect()))
    # the same words as a file, and through the stream's machine a few at a time
    path = str(tmp_path / "f.tpx3")
    tpx3.write_packets(path, [hit(1), tdc(1), *words])
    monkeypatch.setattr(ordering, "BLOCK", 64)
    own = ordering.read_files(spark, path, split_mb=0.001)
    assert {tuple(r) for r in own.select(*names).collect()} == found and ordering.summaries_of_files(spark, path, 0.001).count() == 10
    sealed, machines = [], {}
    rows = sorted(streaming.values(ordering.with_chip(table)).collect(), key=lambda r: r.packet_idx)
    for at in range(0, len(rows), 13):
        for chip in {r.chip_id for r in rows[at : at + 13]}:
            part = [r for r in rows[at : at + 13] if r.chip_id == chip]
            machine = machines.setdefault(chip, streaming.Assembler(chip, DetectorConfig().period_ticks))
            sealed.append(machine.feed(np.array([r.kind == "tdc" for r in part]), *(np.array([r[c] for r in part]) for c in ("value", "packet_idx", "raw"))))
    rest = [m.flush() for m in machines.values()]
    assert 0 < sum(map(len, rest)) < len(found) / 4
    assert {(int(i), int(e), int(f), int(t), int(c)) for c, e, i, t, f, _ in np.concatenate([*sealed, *rest])} == {f[:5] for f in found}


def test_diagnostics_count_words_before_the_first_header_for_chip_0(spark):
    words = [hit(900), hit(800), tdc(100), H(1), tdc(1000), hit(5), hit(9), tdc(2000), hit(8), tdc(1500), tdc(1600), tdc(1700), tdc(1800), H(0), hit(850), H(3)]
    for block in (2, 1 << 20):
        got = {r.chip_id: tuple(r)[2:] for r in ordering.disorder(ordering.summaries(packets(spark, words), block)).collect()}
        assert got[0] == (1, 0, 3, 1, 100 / 3, None, None, None, None, None)
        assert got[1] == (6, 1, 3, 1, 100 / 3, 0, 0.6, 2, [1000, 2000, 1500, 1600, 1700], [1000, -500, 100, 100])
        assert got[3] == (0, 0, 0, 0, 0.0, None, None, None, None, None)


def test_rollovers_of_markers_and_hits_with_what_came_before(spark):
    big = 900_000_000
    words = [hit(big), H(2), tdc(big), *(hit(big + k) for k in range(12)), tdc(big + 50), tdc(7), hit(3)]
    for block in (4, 1 << 20):
        tdcs, hits = sorted(ordering.rollovers(packets(spark, words), block=block).collect(), key=lambda r: r.packet_idx)
        assert (tdcs.kind, tdcs.packet_idx, tdcs.chip_id, tdcs.previous, tdcs.timestamp) == ("tdc", 16, 2, big + 50, 7)
        assert tdcs.tdcs == [[2, 2, big], [15, 2, big + 50]] and tdcs.hits == [[3 + k, 2, big + k] for k in range(2, 12)]
        assert (hits.kind, hits.packet_idx, hits.previous, hits.timestamp) == ("hit", 17, big + 11, 3) and len(hits.tdcs) == 3


def test_source_splits_and_checks_sizes(spark, tmp_path):
    words = [H(0), tdc(1000), *(hit(1100 + k) for k in range(500))]
    path = str(tmp_path / "a.tpx3")
    tpx3.write_packets(path, words)
    table = tpx3.read_packets(spark, path, split_mb=0.001)
    assert table.rdd.getNumPartitions() > 1 and table.count() == 502
    assert ordering.read_hits(table).agg(F.max("tof")).first()[0] == 599
    (tmp_path / "a.tpx3").write_bytes(b"123")
    try:
        tpx3.read_packets(spark, path).count()
        raise AssertionError("a bad size must fail")
    except Exception as e:
        assert "multiple of 8" in str(e)
    assert tpx3.read_packets(spark, path, strict=False).count() == 0


def test_stream_reads_new_files(spark, tmp_path):
    for k in range(3):
        tpx3.write_packets(str(tmp_path / f"{k}.tpx3"), [H(0), tdc(1000), hit(1100 + k), tdc(2000), tdc(3000)])
    out = []
    query = tpx3.stream_packets(spark, str(tmp_path), 1).writeStream.foreachBatch(lambda df, n: out.extend(r.tof for r in ordering.read_hits(df).collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(out) == [100, 101, 102]


def test_stream_takes_a_file_that_comes_late_under_an_earlier_name(spark, tmp_path):
    out = []

    def start():
        return tpx3.stream_packets(spark, str(tmp_path / "in"), 1).writeStream.foreachBatch(lambda df, n: out.extend(r.tof for r in ordering.read_hits(df).collect())).option("checkpointLocation", str(tmp_path / "cp")).start()

    (tmp_path / "in").mkdir()
    add = lambda name, k: tpx3.write_packets(str(tmp_path / "in" / name), [H(0), tdc(1000), hit(1100 + k)])
    add("b.tpx3", 0)
    query = start()
    query.processAllAvailable()
    add("a.tpx3", 1)
    query.processAllAvailable()
    query.stop()
    assert out == [100, 101]
    add("0.tpx3", 2)
    query = start()  # a restart reads only what is new
    query.processAllAvailable()
    query.stop()
    assert out == [100, 101, 102]


def test_gap_slices_keep_clusters_whole(spark):
    rng = random.Random(5)
    rows = [("f", 1, k, rng.randint(0, 8), rng.randint(0, 8), rng.randint(0, 4000), 10, 0) for k in range(900)]
    hits = spark.createDataFrame(rows, "file string, ext_tdc long, packet_idx long, x int, y int, tof long, tot int, chip_id int")
    cut = ordering.gap_slices(hits, 3, 40)
    ends = cut.groupBy("slice_no").agg(F.min("tof").alias("a"), F.max("tof").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert len(ends) > 5 and all(y.a - x.b > 3 for x, y in zip(ends, ends[1:]))
    options = dict(clustering_config=ClusteringConfig(5.0, 75.0), algorithm="dbscan")
    names = ("x", "y", "tof", "tot", "n_hits", "chip_id")
    whole, sliced = (sorted(tuple(r) for r in api.neutrons_from(hits, **options, **more).select(*names).collect()) for more in ({}, {"out_of_core": True, "memory_budget_bytes": 1000}))
    assert whole == sliced and len(whole) > 10


def test_slices_cover_and_overlap(spark):
    rows = [("f", 1, k, 0, 0, k, 10, 0) for k in range(10)]
    hits = spark.createDataFrame(rows, "file string, ext_tdc long, packet_idx long, x int, y int, tof long, tot int, chip_id int")
    got = ordering.slices(hits, 4, 1).groupBy("slice_no").agg(F.min("tof").alias("a"), F.max("tof").alias("b"), F.max("emit_cutoff_tof").alias("c")).orderBy("slice_no").collect()
    assert [(r.a, r.b, r.c) for r in got] == [(0, 4, 3), (4, 8, 7), (8, 9, 9)]
    assert ordering.slices(hits, 4, 1).where("emits").count() == 10


def test_generated_files_hold_pulses_of_clusters(spark, tmp_path):
    from pixelspark.plans import synthetic

    path = str(tmp_path / "g.tpx3")
    assert synthetic.write(path, 4 * 42 * 3, hits=40) == 4 * 42 * 3
    hits = ordering.read_files(spark, path)
    assert hits.select("ext_tdc").distinct().count() == 3 and 0.85 * 480 < hits.count() <= 480
    found = api.neutrons_from(hits, ClusteringConfig(5.0, 75.0), algorithm="grid").count()
    assert 60 < found < 200


def test_files_are_listed_by_path_folder_glob_and_uri(tmp_path, monkeypatch):
    from pixelspark.sources.files import listed

    (tmp_path / "sub").mkdir()
    for name in ("run_1.tpx3", "run_2.tpx3", "x.txt", "sub/run_3.tpx3"):
        (tmp_path / name).write_bytes(b"12345678")
    monkeypatch.chdir(tmp_path)
    names = lambda path: [p.removeprefix("file://").removeprefix(str(tmp_path) + "/") for p, size, _ in listed(path) if size == 8]
    assert names("run_*.tpx3") == names(str(tmp_path)) == names(f"file://{tmp_path}/run_?.tpx3") == ["run_1.tpx3", "run_2.tpx3"]
    assert names(f"{tmp_path}/*/run_*") == ["sub/run_3.tpx3"] and names("x.txt") == ["x.txt"] and listed("none") == []
    assert all(p.startswith("file:///") for p, *_ in listed(f"file:{tmp_path}"))
