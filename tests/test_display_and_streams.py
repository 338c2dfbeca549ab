import time

import pytest
from pyspark.sql import functions as F

from pixelspark import api, cli
from pixelspark.config import ClusteringConfig, ConfigError
from pixelspark.functions import display
from pixelspark.operators import clustering, ordering, roi
from pixelspark.sources import sinks, tpx3
from pixelspark.sources.tpx3 import header, hit, tdc
from pixelspark.streaming import pulses


def test_ranges_and_bounds():
    assert display.typed_range(" ", "") is None and display.typed_range("1", " 2.5") == (1.0, 2.5)
    for bad in (("2", "1"), ("a", "1"), ("", "1")):
        with pytest.raises(ConfigError):
            display.typed_range(*bad)
    assert display.plot_bounds((1.0, 1.0), 0.0) == ((0.0, 1.0), (0.0, 1.0))
    assert display.plot_bounds((1.0, 9.0), 100.0, (10.0, 100.0), (0.0, 5.0), True, True) == ((1.0, 2.0), (0.0, 105.0))


def test_texts_and_colours(spark):
    assert [display.si(n) for n in (999, 45_000, 1_500_000)] == ["999", "45.0K", "1.50M"]
    assert [display.size_text(n) for n in (5, 2048, 3 << 30)] == ["5 B", "2.0 KB", "3.00 GB"]
    row = spark.range(1).select(display.colour(F.lit(0.5), "hot").alias("h"), display.colour(F.lit(1.0), "viridis").alias("v"), display.bin_at(F.lit(-3.0), 10.0, 5).alias("a"), display.bin_at(F.lit(99.0), 10.0, 5).alias("b")).first()
    assert (row.h, row.v, row.a, row.b) == ([255, 255, 0], [255, 255, 0], 0, 4)


def test_edges_and_bends():
    assert roi.distance_to_edge((1, 1), (0, 0), (2, 0)) == 1 and roi.distance_to_edge((5, 4), (0, 0), (2, 0)) == 5
    assert roi.is_convex(((0, 0), (2, 0), (2, 2), (0, 2))) and not roi.is_convex(((0, 0), (4, 0), (1, 1), (0, 4)))
    assert sinks.group_attributes({"a": 1, "b": 2}, {"a": 3, "b": None}) == {"a": 3, "b": 2}


def test_regions_are_edited():
    made = roi.Regions().added(lambda n: roi.Roi.rectangle(n, "a", 0, 0, 10, 10)).added(lambda n: roi.Roi.rectangle(n, "b", 0, 0, 0, 5)).added(lambda n: roi.Roi.polygon(n, "c", [(0, 0), (8, 0), (0, 8)]))
    assert [r.roi_id for r in made.rois] == [1, 2] and made.next_id == 3
    one = made.changed(1, lambda r: r.resized(5, -20, "right bottom", 2, -4, 12).renamed(" wide ").shown(False)).rois[0]
    assert (one.vertices, one.name, one.visible) == (((0, -4), (12, 10)), "wide", False) and one.renamed(" ").name == "wide"
    assert made.rois[0].resized(50, 0, "left", 2, 0, 100).vertices == ((8, 0), (10, 10))
    assert roi.picked(list(made.rois), 2, 2) == 2 and roi.picked(list(made.rois), 7, 7) == 1 and roi.picked(list(made.without(1).rois), 7, 7) is None
    assert made.without(2).rois == made.rois[:1] and made.rois[0].shape() != made.rois[1].shape()


def streamed(spark, parts, folder, start):
    """What a stream of PACKETS gives that gets `parts` one batch each."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(folder / "in" / str(k)))
        for f in (folder / "in" / str(k)).glob("*.parquet"):
            f.rename(folder / "in" / f"{k}.parquet")
    out = []
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(folder / "in"))
    query = start(stream).writeStream.foreachBatch(lambda df, n: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(folder / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return out


def test_pulse_stream_equals_batch(spark, tmp_path):
    words = [header(0), tdc(1000), hit(1100), tdc(2000), hit(1950), hit(2100), tdc(3000), hit(3100)]
    tpx3.write_packets(str(tmp_path / "a.tpx3"), words)
    table = tpx3.read_packets(spark, str(tmp_path / "a.tpx3"))
    values = pulses.values(ordering.with_chip(table)).cache()
    want = {tuple(r) for r in pulses.assemble_batch(table, 666_667).collect()}
    assert len(want) == 4
    # the packets come in three batches; the state carries the open pulses over, and the end's row lets the last ones out
    cuts = [values.where(F.col("packet_idx").between(a, b)) for a, b in ((0, 5), (6, 8))] + [pulses.ends(values)]
    out = streamed(spark, cuts, tmp_path, lambda s: pulses.assemble_stream(s, 666_667))
    assert {r for batch in out for r in batch} == want and [len(batch) for batch in out] == [0, 2, 2]


def test_merged_stream_waits_for_all_chips(spark, tmp_path):
    words = [header(0), tdc(1000), hit(1100), tdc(2000), hit(2100), tdc(3000), hit(3300), tdc(4000), header(1), tdc(1000), hit(1050), tdc(2000), hit(2050), hit(1900), tdc(3000), hit(3200)]
    tpx3.write_packets(str(tmp_path / "a.tpx3"), words)
    table = tpx3.read_packets(spark, str(tmp_path / "a.tpx3"))
    values = pulses.values(ordering.with_chip(table)).cache()
    cuts = [values.where(F.col("packet_idx") < 8), values.where(F.col("packet_idx") >= 8), pulses.ends(values)]
    out = streamed(spark, cuts, tmp_path, lambda s: pulses.merge_stream(s, 666_667, chips=2))
    assert [[(r[2], r[5], r[1]) for r in batch] for batch in out] == [
        [], [(1000, 50, 1), (1000, 100, 0), (1000, 900, 1)], [(2000, 50, 1), (2000, 100, 0), (3000, 200, 1), (3000, 300, 0)]]


def test_idle_chips_end(spark, tmp_path):
    words = [header(0), tdc(1000), hit(1100)]
    tpx3.write_packets(str(tmp_path / "a.tpx3"), words)
    values = pulses.values(ordering.with_chip(tpx3.read_packets(spark, str(tmp_path / "a.tpx3"))))
    values.coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    out = []
    stream = spark.readStream.schema(values.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = pulses.assemble_stream(stream, 666_667, idle=500).writeStream.foreachBatch(lambda df, n: out.extend(r.tof for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    until = time.time() + 60
    while not out and time.time() < until:
        time.sleep(0.3)
    query.stop()
    assert out == [100]


def test_pulses_one_after_another(spark, tmp_path):
    tpx3.write_packets(str(tmp_path / "a.tpx3"), [header(0), tdc(1000), hit(1200), hit(1100), tdc(2000), hit(2100)])
    got = list(api.stream_hits(spark, str(tmp_path)))
    assert [t["tof"].to_pylist() for t in got] == [[100, 200], [100]]
    assert [t.schema.metadata[b"ext_tdc"] for t in got] == [b"1000", b"2000"]
    kept = api.read_hits(spark, str(tmp_path), output_path=str(tmp_path / "hits.parquet"))
    assert kept.count() == 3 and api.metadata_of(kept)["path"] == str(tmp_path)
    found = api.process_neutrons(spark, str(tmp_path), collect=True)
    assert found.count() >= 1 and api.metadata_of(found)["algorithm"] == "abs"


def test_growing_cube(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(1, 1, 5), (1, 1, 60)], "x int, y int, tof long").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("x int, y int, tof long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = pulses.growing_cube(stream, 64, 2, 4, 4).writeStream.outputMode("complete").format("memory").queryName("grown").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.tof_bin, r["count"]) for r in spark.table("grown").collect()) == [(0, 2), (1, 2)]


def test_stream_of_files(spark, tmp_path):
    for k in range(2):
        tpx3.write_packets(str(tmp_path / f"{k}.tpx3"), [header(0), tdc(1000), hit(1100, 20), hit(1101, 20), tdc(2000), tdc(3000)])
    found = []
    query = api.stream_neutrons(spark, str(tmp_path), lambda df, n: found.extend(r.n_hits for r in df.collect()), max_files=1).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert found == [2, 2]


def test_whole_file_scope_joins_pulses(spark):
    rows = [("f", 1, 1, 10, 10, 100, 20, 0), ("f", 2, 2, 10, 10, 101, 20, 0)]
    hits = spark.createDataFrame(rows, "file string, ext_tdc long, packet_idx long, x int, y int, tof long, tot int, chip_id int")
    config = ClusteringConfig(5.0, 75.0)
    assert clustering.cluster_hits(hits, config, "dbscan").where("cluster_id >= 0").count() == 0
    assert api.cluster_hits(hits, config, scope="file", algorithm="grid").select("cluster_id").distinct().count() == 1


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "a.tpx3")
    tpx3.write_packets(path, [header(0), tdc(1000), hit(1100, 20), tdc(2000)])
    assert cli.main(["process", path, "-o", str(tmp_path / "o.bin"), "--algorithm", "grid"]) == 0
    assert (tmp_path / "o.bin").stat().st_size == 28
    assert cli.main(["info", path]) == 0 and cli.main(["bench", path, "--iterations", "1"]) == 0
    assert cli.main(["bench-out-of-core", path, "--iterations", "1", "--memory-budget-bytes", "1000"]) == 0 and cli.main(["bench-ordering", path, "--iterations", "1"]) == 0
    said = capsys.readouterr().out
    assert all(w in said for w in ("packet_count", "dbscan", "ratio", "M words/s"))


def test_jobs_are_watched_and_stopped(spark):
    import threading

    ended = []

    def work(job):
        try:
            with job:
                spark.range(4, numPartitions=4).mapInPandas(lambda frames: (time.sleep(60) or f for f in frames), "id long").count()
            ended.append("done")
        except Exception:
            ended.append("stopped")

    job = api.Job(spark, "long")
    thread = threading.Thread(target=work, args=(job,))
    thread.start()
    until = time.time() + 30
    while job.progress()[1] < 4 and time.time() < until:
        time.sleep(0.2)
    assert job.progress() == (0, 4)
    job.cancel()
    thread.join(30)
    assert ended == ["stopped"]
    with api.Job(spark, "short") as short:
        assert spark.range(10, numPartitions=2).count() == 10
    assert short.progress()[0] >= 2
