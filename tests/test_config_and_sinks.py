import struct
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pixelspark import api
from pixelspark.config import AlgorithmParams, ClusteringConfig, ConfigError, DetectorConfig, OutOfCoreConfig
from pixelspark.functions import bits, energy
from pixelspark.operators import cube, extraction, roi
from pixelspark.sources import export, sinks


def test_detector_defaults():
    d = DetectorConfig()
    assert d.size == (514, 514) and d.period_ticks == 666_667
    assert [t.apply(100, 100) for t in d.chip_transformations] == [(358, 100), (413, 413), (155, 413), (100, 100)]
    assert DetectorConfig.from_json('{"detector":{}}') == d
    assert DetectorConfig.from_json(d.to_json()) == d
    assert DetectorConfig.from_json('{"detector":{"timing":{"tdc_frequency_hz":14.0}}}').tdc_frequency_hz == 14.0


def test_detector_json():
    two = DetectorConfig.from_json('{"detector":{"chip_transformations":[{"chip_id":0,"matrix":[[1,0,100],[0,1,200]]},{"chip_id":2,"matrix":[[-1,0,300],[0,-1,400]]}]}}')
    assert [t.apply(10, 20) for t in two.chip_transformations] == [(110, 220), (10, 20), (290, 380)]
    assert DetectorConfig.from_json('{"detector":{"chip_transformations":[]}}').chip_transformations == ()
    with pytest.raises(ConfigError, match="out-of-bounds"):
        DetectorConfig.from_json('{"detector":{"chip_transformations":[{"chip_id":0,"matrix":[[-1,0,50],[0,1,0]]}]}}')
    with pytest.raises(ConfigError):
        DetectorConfig.from_json('{"tdc_frequency_hz":60.0}')


def test_scalars_and_checks():
    assert ClusteringConfig().window_ticks == 3
    assert OutOfCoreConfig(memory_budget_bytes=19 * 4).max_records_per_slice == 3
    for bad in (lambda: AlgorithmParams(abs_scan_interval=0), lambda: OutOfCoreConfig(parallelism=0), lambda: OutOfCoreConfig(queue_depth=0), lambda: api._settings({"out_of_core": True}, False), lambda: api._settings({"parallelism": 2}, True), lambda: api._settings({"time_ordered": False}, True), lambda: api._settings({"what": 1}, False)):
        with pytest.raises(ConfigError):
            bad()


def test_bits(spark):
    rows = spark.createDataFrame([(0x33585054,), (0x12345678,), (0x6F << 56,), ((0xB << 60) - (1 << 64),)], "raw long")
    got = [tuple(r) for r in rows.select(bits.is_header(F.col("raw")), bits.is_tdc(F.col("raw")), bits.is_hit(F.col("raw"))).collect()]
    assert got == [(True, False, False), (False, False, False), (False, True, False), (False, False, True)]
    one = spark.range(1).select(bits.rollover_corrected(F.lit(0x100), F.lit(0x500000)).alias("a"), bits.rollover_corrected(F.lit(100), F.lit(50)).alias("b"), bits.time_of_flight(F.lit(1000), F.lit(500), 666667).alias("c")).first()
    assert tuple(one) == (0x40000100, 100, 500)


def test_energy_round_trip(spark):
    r = spark.range(1).select(energy.energy_view(F.lit(1000.0), 25.0, 5000.0).alias("e")).withColumn("t", energy.tof_view(F.col("e"), 25.0, 5000.0)).first()
    assert r.t == pytest.approx(1000.0)
    assert spark.range(1).select(energy.energy_view(F.lit(1.0), 25.0, 5000.0)).first()[0] is None
    assert spark.range(1).select(energy.energy_file(F.lit(-9.0), 25.0, 5.0)).first()[0] == 0.0


def test_views_are_bijections(spark):
    grid = spark.range(7 * 7).selectExpr("id % 7 x", "id div 7 y")
    for turns in range(4):
        for h in (False, True):
            for v in (False, True):
                view = roi.View(turns, h, v)
                sx, sy = view.source_pixel(F.col("x"), F.col("y"), 4, 3)
                rows = grid.select(sx.alias("x"), sy.alias("y")).where("x is not null").collect()
                assert sorted(tuple(r) for r in rows) == [(x, y) for x in range(4) for y in range(3)]
                assert view.unplace(*view.place(1.25, 2.5, 4.0, 3.0), 4.0, 3.0) == pytest.approx((1.25, 2.5))


def test_regions():
    with pytest.raises(ConfigError):
        roi.Roi.polygon(1, "bow", [(0, 0), (2, 2), (2, 0), (0, 2)])
    square = roi.Roi.polygon(1, "s", [(0, 0), (2, 0), (2, 2), (0, 2)])
    assert square.area == 4 and square.moved(100, -5, 10, 10).bounds == (8, 0, 10, 2)
    assert len(square.without_vertex(0).without_vertex(0).vertices) == 3
    assert roi.Roi.rectangle(1, "r", 0, 0, 0, 5) is None
    back = square.remapped(roi.View(), roi.View(1), 10, 10).remapped(roi.View(1), roi.View(), 10, 10)
    assert back.vertices == square.vertices


def test_cube_and_masks(spark):
    c = spark.createDataFrame([(0, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (2, 0, 3, 50)], "tof_bin int, y int, x int, count long")
    assert cube.projection(c).where("x = 1").first()["count"] == 3
    assert [r["count"] for r in cube.spectrum(c, 4).orderBy("tof_bin").collect()] == [1, 1, 51, 0]
    m = cube.pixel_masks(cube.projection(c), 4, 2, 0.5)
    assert (m.where("dead = 1").count(), [(r.x, r.y) for r in m.where("hot = 1").collect()]) == (6, [(3, 0)])
    assert [r["count"] for r in cube.masked_spectrum(c, m, 4).orderBy("tof_bin").collect()] == [1, 1, 1, 0]
    assert cube.pixel_masks(cube.projection(c.where("count > 99")), 2, 2).where("dead = 1").count() == 4


NEUTRON = "file string, ext_tdc long, x double, y double, tof long, tot int, n_hits int, chip_id int"


def test_neutron_files(spark, tmp_path):
    n = spark.createDataFrame([("f", 1, 1.5, 2.5, 1000, 100, 5, 0), ("f", 1, 10.3, 20.7, 2000, 200, 8, 1)], NEUTRON).coalesce(1)
    sinks.write_neutrons(n, str(tmp_path / "a.bin"))
    assert (tmp_path / "a.bin").stat().st_size == 56
    assert struct.unpack("<ddIHHB3x", (tmp_path / "a.bin").read_bytes()[:28]) == (1.5, 2.5, 1000, 100, 5, 0)
    assert sinks.read_binary(str(tmp_path / "a.bin"))["tof"].tolist() == [1000, 2000]
    sinks.write_neutrons(n, str(tmp_path / "a.csv"))
    text = "".join(p.read_text() for p in (tmp_path / "a.csv").glob("part*"))
    assert text.splitlines() == ["x,y,tof,tot,n_hits,chip_id", "1.5,2.5,1000,100,5,0", "10.3,20.7,2000,200,8,1"]
    sinks.write_neutrons(n, str(tmp_path / "a.parquet"))
    assert spark.read.parquet(str(tmp_path / "a.parquet")).count() == 2


def test_event_layout(spark, tmp_path):
    hits = spark.createDataFrame([("f", 7, 1, 3, 10, 5), ("f", 7, 2, 4, 20, 6), ("f", 9, 1, 1, 5, 5)], "file string, ext_tdc long, x int, y int, tof long, tot int")
    events = sinks.event_columns(sinks.hit_event_ids(hits, 512, 512), ("time_over_threshold", "x", "y"))
    sinks.write_events(events, str(tmp_path / "e"), {"flight_path_m": 2.5})
    back, pulses, attributes = sinks.read_events(spark, str(tmp_path / "e"))
    assert sorted(r.time_over_threshold for r in back.collect()) == [125, 125, 150]
    assert [(r.event_time_zero, r.event_index) for r in pulses.orderBy("ext_tdc").collect()] == [(175, 0), (225, 2)]
    assert attributes == {"flight_path_m": 2.5} and sinks.validate_export(spark, str(tmp_path / "e")) == []
    with pytest.raises(Exception, match="outside the detector"):
        sinks.hit_event_ids(hits, 2, 2).collect()
    neutrons = spark.createDataFrame([(10.2, 20.4), (-1.0, 2.0)], "x double, y double")
    with pytest.raises(Exception, match="outside the detector"):
        sinks.neutron_event_ids(neutrons, 512, 512, 1.0).collect()
    assert sinks.neutron_event_ids(neutrons.where("x > 0"), 512, 512, float("nan")).first().event_id == 20 * 512 + 10


def test_histogram_layout(spark, tmp_path):
    c = spark.createDataFrame([(0, 0, 0, 2), (1, 1, 1, 3)], "tof_bin int, y int, x int, count long")
    axes = sinks.histogram_axes(2, 2, 2, 100.0, 4.0, 100.0)
    sinks.write_histogram(c, str(tmp_path / "h"), axes)
    sinks.add_to_histogram(c, str(tmp_path / "h"))
    back, got = sinks.read_histogram(spark, str(tmp_path / "h"))
    assert sinks.dense(back, 2, 2, 2).tolist() == [[[4, 0], [0, 0]], [[0, 0], [0, 6]]]
    assert [a["axis"] for a in got][-1] == "energy_ev"
    assert len(sinks.histogram_axes(2, 2, 2, 100.0, 4.0, 0.0)) == 4
    with pytest.raises(Exception, match="outside the histogram"):
        sinks.write_histogram(c.withColumn("x", F.lit(5)), str(tmp_path / "bad"), axes)
    with pytest.raises(Exception, match="values for"):
        sinks.axis("x", [1.0], 3)
    assert sinks.merged_attributes({"p": 2.5}, {"p": 2.5 + 5e-10}) == {"p": 2.5}
    with pytest.raises(Exception, match="conflicting"):
        sinks.merged_attributes({"p": 2.5}, {"p": 2.6})


def counted(spark, rows):
    return spark.createDataFrame(rows, "tof_bin int, y int, x int, count long")


def test_images(spark, tmp_path):
    c = counted(spark, [(0, 0, 0, 1), (0, 0, 1, 2), (0, 1, 0, 3), (0, 1, 1, 70000)])
    size, warnings = export.tiff_export(spark, c, str(tmp_path / "t"), " img/1 ", (2, 2), 1, 100.0)
    assert warnings == ["counts above 65535 were cut"] and sorted(p.name for p in (tmp_path / "t").iterdir() if p.name[0] != ".") == ["img_1_00000.tif", "img_1_Spectra.txt", "img_1_SummedImg.tif"]
    raw = (tmp_path / "t" / "img_1_00000.tif").read_bytes()
    assert raw[:4] == b"II*\0" and raw[-8:] == struct.pack("<4H", 1, 2, 3, 65535) and size > len(raw)
    few = spark.createDataFrame([(0, 0, 1, 0, 0)], "x int, y int, count long, dead int, hot int")
    _, warnings = export.tiff_export(spark, c, str(tmp_path / "s"), "img", (2, 2), 1, 100.0, 32, stack=True, big=True, masks=few, exclude_masked=True)
    assert warnings == ["no mask fits the histogram; the full spectrum is written"]
    assert (tmp_path / "s" / "img_stack.tif").read_bytes()[:4] == b"II+\0"
    for bad in (("t", "img"), ("u", " _ ")):
        with pytest.raises(Exception, match="exists|needed"):
            export.tiff_export(spark, c, str(tmp_path / bad[0]), bad[1], (2, 2), 1, 100.0)
    with pytest.raises(IndexError):  # a bin outside the images
        export.tiff_export(spark, counted(spark, [(0, 5, 0, 1)]), str(tmp_path / "u"), "img", (2, 2), 1, 100.0)
    assert not (tmp_path / "u").exists()


def test_combined_export(spark, tmp_path):
    hits = spark.createDataFrame([("f", 7, 1, 3, 10, 5, 0), ("f", 7, 2, 4, 20, 6, 0), ("f", 9, 1, 1, 5, 5, 1)], "file string, ext_tdc long, x int, y int, tof long, tot int, chip_id int")
    neutrons = spark.createDataFrame([(8.2, 16.4, 100, 30, 2, 0)], "x double, y double, tof long, tot int, n_hits int, chip_id int")
    c = counted(spark, [(0, 0, 0, 2)])
    masks = spark.createDataFrame([(0, 0, 2, 0, 0)], "x int, y int, count long, dead int, hot int")
    data = export.ExportData(hits, neutrons, c, masks, {"mean": 2.0}, (8, 8), 1, 100.0, {"detector": "d"})
    options = export.ExportOptions(True, True, True, True, xy=True, n_hits=True, super_resolution=8.0, flight_path_m=2.5, tof_offset_ns=0.0)
    said, path = [], str(tmp_path / "out")
    size, warnings = export.export(spark, data, path, options, lambda share, what: said.append(share))
    assert warnings == [] and size > 0 and said == sorted(said) and said[-1] == 1.0
    events, pulses = (spark.read.parquet(f"{path}/hits/{t}") for t in ("events", "pulses"))
    assert set(events.columns) == {"file", "ext_tdc", "event_id", "event_time_offset", "time_over_threshold", "chip_id", "x", "y"}
    assert [(r.event_time_zero, r.event_index) for r in pulses.orderBy("ext_tdc").collect()] == [(175, 0), (225, 2)]
    own = spark.read.parquet(f"{path}/neutrons/events").first()
    assert (own.event_id, own.n_hits, own.ext_tdc) == (2 * 8 + 1, 2, 0)
    assert len(sinks.read_histogram(spark, f"{path}/histogram")[1]) == 4  # no offset, no energy axis
    assert sinks.read_masks(spark, f"{path}/pixel_masks")[1] == {"mean": 2.0}
    with pytest.raises(Exception, match="masks are not"):
        sinks.read_masks(spark, f"{path}/pixel_masks", (8, 8))
    assert export.validate(spark, path, replace(options, cluster_id=True)) == ["missing column hits.cluster_id"]
    plain = replace(options, hits=True, neutrons=False, histogram=False, pixel_masks=False, compression=0)
    export.export(spark, export.ExportData(hits.drop("ext_tdc", "file")), path, plain)
    assert export.validate(spark, path, plain) == []
    assert export.validate(spark, path, replace(plain, neutrons=True, compression=1)) == ["hits is not compressed", "hits pulses is not compressed", "missing table neutrons", "missing table neutrons pulses"]
    assert spark.read.parquet(f"{path}/hits/pulses").first().event_time_zero == 0
    for bad, what in ((export.ExportOptions(False), "nothing is selected"), (export.ExportOptions(True, True), "no neutrons"), (export.ExportOptions(False, False, True), "no histogram"), (export.ExportOptions(False, pixel_masks=True), "no pixel masks")):
        with pytest.raises(Exception, match=what):
            export.export(spark, export.ExportData(hits), path, bad)
    assert export.validate(spark, path, plain) == [] and not (tmp_path / "out.partial").exists()


def test_events_that_come_in_batches(spark, tmp_path):
    make = lambda rows: sinks.event_columns(spark.createDataFrame(rows, "file string, ext_tdc long, event_id int, tof long"), ())
    sink = export.EventSink(spark, str(tmp_path / "e"), {"a": 1})
    for number, rows in ((0, [("f", 1, 5, 10), ("f", 2, 6, 10)]), (1, [("f", 2, 7, 11), ("f", 4, 8, 12)]), (1, [("f", 2, 7, 11), ("f", 4, 8, 12)])):
        sink.write(make(rows), number)
    assert sink.events().count() == 4
    assert [(r.ext_tdc, r.event_index) for r in sink.pulses().orderBy("ext_tdc").collect()] == [(1, 0), (2, 1), (4, 3)]


def test_spectra_are_kept_by_shape_and_revision(spark):
    cache, made = export.SpectraCache(), []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, 7), (0, 5)], "tof_bin int, count long")

    for revision, shape in ((1, {"a": 1}), (1, {"a": 1}), (1, {"a": 2}), (2, {"a": 1})):
        assert cache.get(revision, shape, make) == [(0, 5), (1, 7)]
    assert len(made) == 3


def test_events_find_their_pulse_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(sinks, "EVENT_BLOCK", 4)
    counts = spark.createDataFrame([("f", 1, 3), ("f", 5, 0), ("f", 6, 9), ("f", 8, 1), ("g", 2, 2)], "file string, ext_tdc long, n long")
    events = spark.createDataFrame([(f, k) for f, n in (("f", 13), ("g", 2)) for k in range(n)], "file string, event_no long")
    got = sorted(tuple(r) for r in sinks.event_pulse(events, sinks.index_of(counts)).collect())
    assert got == [("f", k, t) for k, t in enumerate([1] * 3 + [6] * 9 + [8])] + [("g", 0, 2), ("g", 1, 2)]


def test_spectra_files(spark, tmp_path):
    s = spark.createDataFrame([(0, 5), (1, 7)], "tof_bin int, count long")
    sinks.spectrum_text(s, str(tmp_path / "s.txt"), 100.0)
    assert (tmp_path / "s.txt").read_text().splitlines() == ["shutter_time,counts", "5.000000e-8,5", "1.500000e-7,7"]
    line = lambda ns: sinks.spectrum_lines(s.where("tof_bin = 0"), ns).first().line
    assert [line(n) for n in (83333.333, 2e9, 3e19, 0.0)] == ["4.166667e-5,5", "1.000000e0,5", "1.500000e10,5", "0.000000e0,5"]
    sinks.spectra_csv({"full": s}, str(tmp_path / "s.csv"), 0.5, ["a note"])
    assert (tmp_path / "s.csv").read_text().splitlines() == ["# a note", "tof_ms,full", "0.0,5", "0.5,7"]


def test_files_in_pulse_order(spark, tmp_path):
    rows = [("f", k % 50, 1.0, 2.0, k % 50, 1, 1, 0, 0) for k in range(200)]
    n = spark.createDataFrame(rows, NEUTRON + ", cluster_id int").repartition(7)
    sinks.neutrons_binary(n, str(tmp_path / "a.bin"))
    assert sinks.read_binary(str(tmp_path / "a.bin"))["tof"].tolist() == sorted(r[4] for r in rows)
    sinks.neutrons_csv(n, str(tmp_path / "a.csv"), one_file=True)
    lines = (tmp_path / "a.csv").read_text().splitlines()
    assert lines[0] == "x,y,tof,tot,n_hits,chip_id" and [int(x.split(",")[2]) for x in lines[1:]] == sorted(r[4] for r in rows)


def test_session_statistics():
    s = extraction.session_statistics(1000, 50, 2.0, 0.5, 4_000_000)
    assert s == {"load_speed": 500.0, "cluster_speed": 100.0, "avg_cluster_size": 20.0, "tof_range_ms": 100.0}
    assert extraction.session_statistics(10, 0, None, 0.0) == {"load_speed": None, "cluster_speed": 0.0, "avg_cluster_size": 0.0, "tof_range_ms": 0.0}


def test_process_files(spark, tmp_path):
    from pixelspark.config import ExtractionConfig
    from pixelspark.sources.tpx3 import header, hit, tdc, write_packets

    path = str(tmp_path / "a.tpx3")
    write_packets(path, [header(0), tdc(1000), hit(1100, 20, 0), hit(1101, 30, 1), hit(1200, 40, 0xFE00), tdc(2000), tdc(3000)])
    for name in ("abs", "grid"):
        out = api.process_neutrons(spark, path, algorithm=name, extraction_config=ExtractionConfig(1.0), output_path=str(tmp_path / f"{name}.bin"))
        assert sorted(r.n_hits for r in out.collect()) == [1, 2]
    assert len(list(api.stream_hits(spark, path))) == 1
