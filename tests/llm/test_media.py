import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.llm import media


def scene(seed, h=160, w=200):
    """Blocks and gradients: something with corners."""
    rng = np.random.default_rng(seed)
    out = np.full((h, w), 90.0)
    for _ in range(60):
        y, x, a, b = rng.integers(0, h - 8), rng.integers(0, w - 8), rng.integers(5, 40), rng.integers(5, 40)
        out[y : y + a, x : x + b] = rng.integers(0, 255)
    return out.astype(np.uint8)


def pgm(a):
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def png(a):
    raw = b"".join(b"\x02" + (np.diff(a.astype(np.int16), axis=0, prepend=0)[k] & 255).astype(np.uint8).tobytes() for k in range(len(a)))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_formats():
    a = scene(1, 20, 30)
    assert np.array_equal(media.decode(pgm(a)), a) and np.array_equal(media.decode(png(a)), a)
    for bad in (None, b"", b"GIF89a", b"P5 9", png(a)[:40]):
        assert media.decode(bad) is None


@pytest.fixture(scope="module")
def table(spark):
    rows, truth = [], {}
    noise = np.random.default_rng(0)
    for k in range(12):
        a = scene(k)
        versions = [a, a[20:140, 30:180], np.clip(a * 0.8 + 20, 0, 255).astype(np.uint8), np.clip(a + noise.normal(0, 3, a.shape), 0, 255).astype(np.uint8), np.ascontiguousarray(np.rot90(a)), a.copy()]
        for v in versions:
            rows.append((100 * k + len(truth) % 6, pgm(v) if len(truth) % 2 else png(v)))
            truth[rows[-1][0]] = k
    rows += [(9001, None), (9002, b"junk"), (9003, pgm(np.zeros((50, 50), np.uint8)))]
    return spark.createDataFrame(rows, "image_id long, media binary"), truth


def test_edited_copies_meet_and_others_do_not(table):
    images, truth = table
    got = {r.image_id: r for r in media.copies(images).collect()}
    assert len(got) == images.count()
    found = sum(got[i].component_id == 100 * truth[i] for i in truth)
    assert found / len(truth) >= 0.9
    for i in truth:
        assert truth.get(got[i].component_id) == truth[i]
    assert got[9001].n_corners == 0 and got[9001].component_id == 9001


def described(images):
    return media._described(images, media.decode).where("n > 0").dropDuplicates(["cls"]).cache()


def parts(classes):
    """The components of the classes, as sets."""
    of = {r.id: r.comp for r in media.linked_components(classes).collect()}
    by = {}
    for r in classes.select("cls").collect():
        by.setdefault(of.get(r.cls, r.cls), set()).add(r.cls)
    return sorted(map(sorted, by.values()))


def test_long_runs_lose_no_component(table, monkeypatch):
    classes = described(table[0])
    monkeypatch.setattr(media, "RUN", 10**6)
    whole = parts(classes)
    for run, pivots, node in ((4, 3, 4096), (1, 1, 3)):  # long runs from two corners on, tiles of three
        monkeypatch.setattr(media, "RUN", run)
        monkeypatch.setattr(media, "PIVOTS", pivots)
        monkeypatch.setattr(media, "NODE", node)
        assert parts(classes) == whole


def test_a_large_group_of_noisy_copies_and_crops(spark, monkeypatch):
    noise, base = np.random.default_rng(4), scene(77)
    rows = [np.clip(base + noise.normal(0, 6, base.shape), 0, 255).astype(np.uint8) for _ in range(80)]
    for _ in range(30):
        y, x = noise.integers(0, 40), noise.integers(0, 60)
        rows.append(np.ascontiguousarray(base[y : y + 100, x : x + 120]))
    # a mark that many pictures of their own share, too small to link them
    mark = scene(5, 24, 24)
    for k in range(40):
        own = scene(500 + k)
        own[60:84, 80:104] = mark
        rows.append(own)
    classes = described(spark.createDataFrame([(k, pgm(a)) for k, a in enumerate(rows)], "image_id long, media binary").repartition(4))
    found = {run: None for run in (10**6, 24)}
    for run in found:
        monkeypatch.setattr(media, "RUN", run)
        found[run] = parts(classes)
    assert found[24] == found[10**6] and max(map(len, found[24])) >= 100


def test_links_against_comparing_all_descriptors(table, monkeypatch):
    """Every descriptor of an image with every one of another, by Hamming distance, and the same vote."""
    monkeypatch.setattr(media, "RUN", 10**6)
    classes = described(table[0])
    found = {(r.a, r.b) for r in media.voted(media.met_often(media.matches(classes).where("b is not null")), classes.select("cls", "n")).collect()}
    rows = {r.cls: (np.array(r.places), np.array(r.words, np.int32).view(np.uint32).reshape(-1, 4)) for r in classes.collect()}

    def split(p):
        return (p >> media.Y_AT).astype(float), (p >> media.X_AT & media.SIDE).astype(float), p >> 3 & 31, p & 7

    wanted, exact = set(), set()
    for a in rows:
        for b in rows:
            if a >= b:
                continue
            far = np.bitwise_count(rows[a][1][:, None, :] ^ rows[b][1][None, :, :]).sum(axis=2)
            i, j = np.nonzero(far <= 8)
            ya, xa, ta, oa = split(rows[a][0][i])
            yb, xb, tb, ob = split(rows[b][0][j])
            turn, scale = (tb - ta) % media.TURNS, 2.0 ** (ob - oa)
            angle = turn * 2 * np.pi / media.TURNS
            mx = xb - scale * (np.cos(angle) * xa - np.sin(angle) * ya)
            my = yb - scale * (np.sin(angle) * xa + np.cos(angle) * ya)
            best = 0
            for k in range(len(i)):
                near = (scale == scale[k]) & (np.abs((turn - turn[k] + 16) % 32 - 16) <= 0) & (np.abs(mx - mx[k]) < media.BIN / 2) & (np.abs(my - my[k]) < media.BIN / 2)
                best = max(best, min(len(set(i[near].tolist())), len(set(j[near].tolist()))))
            least = max(media.MIN_VOTES, media.MIN_SHARE * min(len(rows[a][0]), len(rows[b][0])))
            if best >= least:
                wanted.add((a, b))
            keys = [media.keys_of(rows[c][1]) for c in (a, b)]
            i, j = media.Head(rows[b][0], rows[b][1]).matches(keys[0])
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for t in range(4) for x, y in zip(*np.nonzero((keys[0][:, None, t] >> media.CHECK == keys[1][None, :, t] >> media.CHECK) & media.alike(keys[0][:, None, t], keys[1][None, :, t])), strict=True)}
            if media.consensus(np.zeros(len(i), np.int64), rows[a][0][i], rows[b][0][j], 1)[0] >= least:
                exact.add((a, b))
    assert len(wanted) > 20 and len(wanted & found) >= 0.9 * len(wanted)
    assert found == exact


def test_many_images_against_one_at_once(table, monkeypatch):
    classes = described(table[0]).collect()
    one, rest = classes[0], classes[1:20]
    head = media.Head(np.array(one.places), np.array(one.words, np.int32))
    sizes = np.array([r.n for r in rest])
    places, words = np.concatenate([r.places for r in rest]), np.concatenate([np.array(r.words, np.int32) for r in rest])
    want = [int(head.votes(np.array(r.places), np.array(r.words, np.int32), np.array([r.n]))[0]) for r in rest]
    for step in (1, 100, 1 << 20):
        monkeypatch.setattr(media.Head, "STEP", step)
        assert head.votes(places, words, sizes).tolist() == want


def test_votes_against_counting(monkeypatch):
    rng = np.random.default_rng(6)
    place = lambda n: rng.integers(0, 40, n) << media.Y_AT | rng.integers(0, 40, n) << media.X_AT | rng.integers(0, 3, n) << 3 | rng.integers(0, 2, n)
    p, q, pair = place(400), place(400), np.sort(rng.integers(0, 5, 400))
    got = media.consensus(pair, p, q, 6)
    for k in range(6):
        own = np.flatnonzero(pair == k)
        best = 0
        for i, j, l in np.ndindex(2, 2, 2):
            bins = {}
            for x in own:
                (yp, xp, tp, op), (yq, xq, tq, oq) = ((int(c >> 36), int(c >> 8 & media.SIDE), int(c >> 3 & 31), int(c & 7)) for c in (p[x], q[x]))
                turn, size = (tq - tp) % 32, 2.0 ** (oq - op)
                angle = turn * (2 * np.pi / 32)
                move = xq - size * (np.cos(angle) * xp - np.sin(angle) * yp), yq - size * (np.sin(angle) * xp + np.cos(angle) * yp)
                spot = ((turn + i) // 2 % 16, np.floor(move[0] / 12 + j / 2), np.floor(move[1] / 12 + l / 2), oq - op)
                bins.setdefault(spot, []).append((p[x], q[x]))
            best = max([best, *(min(len({c[0] for c in b}), len({c[1] for c in b})) for b in bins.values())])
        assert got[k] == best


def test_awkward_images(spark):
    a, b = pgm(scene(1)), pgm(scene(2))
    tall = np.tile(scene(3, 200, 24), (400, 1))  # 80,000 rows
    rows = [(None, a, 1), (3, a, 2), (3, a, 2), (3, b, 3), (None, None, 4), (7, pgm(tall), 5), (8, pgm(tall[100:]), 6)]
    got = media.copies(spark.createDataFrame(rows, "image_id long, media binary, cls long"))
    assert got.columns == ["image_id", "n_corners", "class_id", "component_id"]
    found = sorted((str(r.image_id), str(r.component_id), r.n_corners > 0) for r in got.collect())
    assert found == [("3", "3", True)] * 3 + [("7", "7", True), ("8", "7", True), ("None", "3", True), ("None", "None", False)]


def test_nothing(spark):
    none = spark.createDataFrame([], "image_id long, media binary")
    assert media.copies(none).count() == 0


def test_small_and_blank_images_meet_their_copies(spark):
    small = scene(5, 15, 200)
    edited = np.clip(small * 0.9 + 10, 0, 255).astype(np.uint8)
    flat = np.full((40, 40), 7, np.uint8)
    rows = [(1, pgm(small)), (2, png(small)), (3, pgm(edited)), (4, pgm(flat)), (5, png(flat)), (6, pgm(flat[:20])), (7, b"junk"), (8, b"junk"), (9, pgm(scene(6, 15, 200)))]
    got = {r.image_id: r for r in media.copies(spark.createDataFrame(rows, "image_id long, media binary")).collect()}
    assert [got[k].component_id for k in range(1, 10)] == [1, 1, 1, 4, 4, 6, 7, 8, 9]
    assert got[1].n_corners > 0 and got[4].n_corners == 0


@pytest.fixture(scope="module")
def marked(spark):
    """Small pictures with six marks of 24 each, so that most pairs share one or two, and a few edited copies."""
    rng, rows = np.random.default_rng(8), []
    grain = lambda h, w: media._box(rng.integers(0, 255, (h, w)).astype(np.float32), 1) / 9
    y, x = np.mgrid[:26, :26]
    marks = [np.where((y >= 13) & (x >= 13), 255 - grain(26, 26) / 4, grain(26, 26) / 2) for _ in range(24)]  # with a sharp corner
    for k in range(60):
        a = grain(96, 72) / 2 + 60
        for cell, mark in enumerate(rng.choice(24, 6, replace=False)):
            y, x = cell // 2 * 32 + rng.integers(0, 6), cell % 2 * 36 + rng.integers(0, 10)
            a[y : y + 26, x : x + 26] = marks[mark]
        a = a.astype(np.uint8)
        rows += [a] if k % 6 else [a, a[3:94, 2:71], np.clip(a * 0.9 + 9, 0, 255).astype(np.uint8)]
    return spark.createDataFrame([(k, pgm(a)) for k, a in enumerate(rows)], "image_id long, media binary").repartition(3).cache()


def matched(classes):
    """Of each pair of classes (least first): the number of matches, and whether they link."""
    rows = {r.cls: (np.array(r.places), np.array(r.words, np.int32)) for r in classes.collect()}
    out = {}
    for a, b in ((a, b) for a in rows for b in rows if a < b):
        i, j = media.Head(*rows[b]).matches(media.keys_of(rows[a][1]))
        votes = media.consensus(np.zeros(len(i), np.int64), rows[a][0][i], rows[b][0][j], 1)[0]
        link = votes >= max(media.MIN_VOTES, media.MIN_SHARE * min(len(rows[a][0]), len(rows[b][0])))
        out[a, b] = len(i), link
    return out


def test_one_common_corner_makes_no_candidate(marked, monkeypatch):
    """The second pass alone (every run is long, no pivots' links): it tries no pair with one common corner, and finds all links."""
    monkeypatch.setattr(media, "RUN", 1)
    classes = described(marked)
    found = media.matches(classes).cache()
    short, long = found.where("b is not null"), found.where("b is null").selectExpr("shiftright(q, 22) word", "a cls", "p place", "q key")
    assert short.isEmpty()
    no_links = classes.where("false").selectExpr("cls id", "cls comp")
    tried = media.candidates(short, media.met_often(short), long, classes, no_links)
    pairs = [(r.a, r.b) for r in tried.collect()]
    sizes = {r.cls: r.n for r in classes.select("cls", "n").collect()}
    truth = matched(classes)
    assert all(truth[tuple(sorted(p))][0] >= 2 for p in pairs)
    assert len(pairs) == len({tuple(sorted(p)) for p in pairs}) and all(sizes[a] <= sizes[b] for a, b in pairs)
    links = {p for p in truth if truth[p][1]}
    assert len(links) >= 20 and sum(m == 1 for m, _ in truth.values()) > 20
    assert {tuple(sorted((r.a, r.b))) for r in media.verified(tried, classes).collect()} == links


def test_pairs_met_often_against_their_definition(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ends = rng.integers(-(1 << 63), (1 << 63) - 1, 30)
    rows = [(int(ends[x]), int(ends[y]), int(p), int(q)) for x, y, p, q in zip(*(rng.integers(0, k, 3000) for k in (30, 30, 4, 4)), strict=True)]
    rows += [(5, 6, k, 1 << 62) for k in range(300)]
    want = {}
    for a, b, p, q in rows:
        want.setdefault((a, b), set()).add((p, q))
    want = {k: (m, len({p for p, _ in m}), len({q for _, q in m})) for k, m in want.items() if len(m) >= 2}
    found = spark.createDataFrame(rows, "a long, b long, p long, q long").repartition(3)
    for held in (1, 1 << 20):
        monkeypatch.setattr(media, "HELD", held)
        got = media.met_often(found).collect()
        assert len(got) == len(want) and all(len(r.m) == len(set(r.m)) for r in got)
        assert {(r.a, r.b): ({tuple(x) for x in r.m}, r.np, r.nq) for r in got} == want
    assert media.met_often(found.where("false")).count() == 0


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 500):
        rows = media._sorted_rows([rng.integers(-(1 << 63), (1 << 63) - 1, n), *(rng.integers(0, 1 << k, n) for k in (3, 40))])
        assert np.array_equal(media.unpacked(media.packed(rows), rows.shape[1], 3), rows)


def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_descriptors_stay_where_they_are_read(marked):
    """Finding the images of a class, and the bodies of the few pairs to be verified, moves less than the descriptors are."""
    spark = marked.sparkSession
    before = shuffled(spark)
    classes = media.classes_of(media._described(marked, media.decode).withColumn("row", F.monotonically_increasing_id()).cache())[0]
    classes = classes.cache()
    size = classes.selectExpr("sum(24 * n)").first()[0]
    assert classes.count() == 80 and shuffled(spark) - before < size / 10
    a, b = sorted(r.cls for r in classes.select("cls").take(2))
    pairs = media.written(spark.createDataFrame([(a, b)], "a long, b long"), "one-pair")
    before = shuffled(spark)
    media.verified(pairs, classes)
    assert shuffled(spark) - before < size / 10
