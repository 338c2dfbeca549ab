"""Named queries over the driver's tables, and the SQL that gives the same rows.

Keys say which operators they run. Results that come from doubles are rounded to six places on both sides; labels are compared by
their least hit, not by number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.config import U32, ClusteringConfig, DataError, DetectorConfig, ExtractionConfig
from pixelspark.functions import bits, energy
from pixelspark.functions.bits import HALF_STEP, HEADER_MAGIC, HIT_NIBBLE, ROLLOVER, TDC_BYTE
from pixelspark.operators import clustering, cube, extraction, ordering, roi
from pixelspark.plans import tables
from pixelspark.plans.checkpoints import new_folder
from pixelspark.plans.tables import HITS_SQL, PACKETS_SQL, PERIOD
from pixelspark.sources import export, sinks, tpx3
from pixelspark.streaming import pulses as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RADIUS, WINDOW = 5.0, 3
BINS, TOF_MAX, SIDE = 20, 64, 64
CUBE = "cube as (select cast(least(tof * 20 // 64, 19) as integer) tof_bin, cast(y as integer) y, cast(x as integer) x, count(*) n from hits group by all)"
EDGES = f"edges as (select a.file, a.ext_tdc, a.packet_idx a, b.packet_idx b from hits a join hits b on a.file = b.file and a.ext_tdc = b.ext_tdc and a.packet_idx < b.packet_idx and abs(a.tof - b.tof) <= {WINDOW} and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 25)"
CLOSURE = """r(file, ext_tdc, a, b) as (select file, ext_tdc, packet_idx, packet_idx from hits union select r.file, r.ext_tdc, r.a, e.b from r join (select file, ext_tdc, a, b from edges union all select file, ext_tdc, b, a from edges) e on e.file = r.file and e.ext_tdc = r.ext_tdc and e.a = r.b),
  grid as (select file, ext_tdc, a packet_idx, min(b) cluster from r group by all)"""
MASKS = """proj as (select y, x, sum(n) c from cube group by all), st as (select sum(c)::double / count(*) m, sqrt(greatest(0, sum(c * c)::double / count(*) - (sum(c)::double / count(*)) * (sum(c)::double / count(*)))) sd from proj),
  px as (select cast(i % 64 as integer) x, cast(i // 64 as integer) y from range(4096) t(i)),
  mask as (select px.x, px.y, coalesce(c, 0)::bigint c, case when coalesce(c, 0) = 0 then 1 else 0 end dead, case when coalesce(c, 0) > m + 2 * sd and coalesce(c, 0) > 0 then 1 else 0 end hot from px left join proj using (x, y) cross join st)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return tables.hits(spark, sf)


def _cube(spark: SparkSession, sf: str, n_bins: int = BINS) -> DataFrame:
    return cube.hit_cube(_hits(spark, sf), TOF_MAX, n_bins, SIDE, SIDE)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with given labels: place and time cells stand for clusters."""
    return _hits(spark, sf).withColumn("cluster_id", F.expr("cast((x div 8) * 8 + y div 8 as int)"))


LABELLED = f"{HITS_SQL}, lab as (select *, (x // 8) * 8 + y // 8 cluster_id from hits)"


# --- packet words -------------------------------------------------------------------------------------------------


@query(f"""with {PACKETS_SQL} select file, packet_idx, (raw >> 56) & 255 packet_type, (raw >> 32) & 255 chip, (raw >> 44) & 65535 address, (raw >> 30) & 16383 toa, (raw >> 20) & 1023 tot,
  (raw >> 16) & 15 fine_toa, raw & 65535 spidr, (raw >> 12) & {ROLLOVER - 1} tdc, ((raw & 65535) << 14) | ((raw >> 30) & 16383) timestamp,
  (raw & {U32}) = {HEADER_MAGIC} is_header, ((raw >> 56) & 255) = {TDC_BYTE} is_tdc, ((raw >> 60) & 15) = {HIT_NIBBLE} is_hit from packets""")
def packet_decode(spark, sf):
    """Every field of every word."""
    raw = F.col("raw")
    fields = {"packet_type": bits.packet_type, "chip": bits.header_chip, "address": bits.pixel_address, "toa": bits.toa, "tot": bits.tot, "fine_toa": bits.fine_toa, "spidr": bits.spidr_time, "tdc": bits.tdc_timestamp, "timestamp": bits.coarse_timestamp, "is_header": bits.is_header, "is_tdc": bits.is_tdc, "is_hit": bits.is_hit}
    return tables.packets(spark, sf).select("file", "packet_idx", *(f(raw).alias(n) for n, f in fields.items()))


@query(f"""with {PACKETS_SQL}, a as (select file, packet_idx, (raw >> 44) & 65535 a from packets where ((raw >> 60) & 15) = {HIT_NIBBLE})
  select file, packet_idx, cast(((a & 65024) >> 8) + ((a & 7) >> 2) as bigint) x, cast(((a & 504) >> 1) + (a & 3) as bigint) y from a""")
def pixel_coordinates(spark, sf):
    """P3, P9."""
    p = tables.packets(spark, sf).where(bits.is_hit(F.col("raw")))
    a = bits.pixel_address(F.col("raw"))
    return p.select("file", "packet_idx", bits.local_x(a).cast("long").alias("x"), bits.local_y(a).cast("long").alias("y"))


TIMES = f"t as (select cast(event_id as bigint) id, (cast(event_id as bigint) * 2654435) % {ROLLOVER} ts, (cast(user_id as bigint) * 97654321) % {ROLLOVER} tdc from events), c as (select *, case when ((ts + {HALF_STEP}) & {U32}) < tdc then (ts + {ROLLOVER}) & {U32} else ts end cts from t)"


@query(f"""with {TIMES}, f as (select *, (cts - tdc) & {U32} raw from c) select id, cts, case when raw > {PERIOD} then (raw - {PERIOD}) & {U32} else raw end tof,
  round((case when raw > {PERIOD} then (raw - {PERIOD}) & {U32} else raw end) * 25.0::double / 1000000.0::double, 6) tof_ms from f""")
def tof_correct(spark, sf):
    """P12, P13, P16."""
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(event_id as bigint) id", f"(cast(event_id as bigint) * 2654435) % {ROLLOVER} ts", f"(cast(user_id as bigint) * 97654321) % {ROLLOVER} tdc")
    e = e.withColumn("cts", bits.rollover_corrected(F.col("ts"), F.col("tdc"))).withColumn("tof", bits.time_of_flight(F.col("cts"), F.col("tdc"), PERIOD))
    return e.select("id", "cts", "tof", F.round(bits.tof_ms(F.col("tof")), 6).alias("tof_ms"))


@query(f"""with {HITS_SQL}, v(chip_id, a, b, c, d, tx, ty) as (values (0,1,0,0,1,258,0),(1,-1,0,0,-1,513,513),(2,-1,0,0,-1,255,513),(3,1,0,0,1,0,0))
  select packet_idx, cast(case when a*x+b*y+tx between 0 and 65535 then a*x+b*y+tx else 65535 end as integer) gx, cast(case when c*x+d*y+ty between 0 and 65535 then c*x+d*y+ty else 65535 end as integer) gy from hits join v using (chip_id)""")
def chip_map(spark, sf):
    """J1, P14."""
    x, y = bits.mapped(F.col("x"), F.col("y"), F.col("chip_id"), DetectorConfig().chip_transformations)
    return _hits(spark, sf).select("packet_idx", x.alias("gx"), y.alias("gy"))


# --- ordering -----------------------------------------------------------------------------------------------------

CHIPS = f"""{PACKETS_SQL}, hd as (select *, case when (raw & {U32}) = {HEADER_MAGIC} then 'header' when ((raw >> 56) & 255) = {TDC_BYTE} then 'tdc' when ((raw >> 60) & 15) = {HIT_NIBBLE} then 'hit' end kind from packets),
  ch as (select file, packet_idx idx, raw, kind, last_value(case when kind = 'header' then (raw >> 32) & 255 end ignore nulls) over w chip, last_value(case when kind = 'header' then packet_idx end ignore nulls) over w sec from hd window w as (partition by file order by packet_idx rows unbounded preceding)),
  p as (select file, idx, chip, kind, raw, sec, case when kind = 'tdc' then (raw >> 12) & {ROLLOVER - 1} else ((raw & 65535) << 14) | ((raw >> 30) & 16383) end v from ch where kind in ('tdc', 'hit') and chip is not null),
  tt as (select file, idx, chip, v tdc, row_number() over w seq, lag(v) over w prev_tdc from p where kind = 'tdc' window w as (partition by file, chip order by idx)),
  uu as (select *, sum(case when prev_tdc is not null and tdc < prev_tdc then 1 else 0 end) over (partition by file, chip order by idx rows unbounded preceding)::bigint epoch from tt),
  pl as (select *, lag(epoch) over (partition by file, chip order by idx) prev_epoch from uu)"""
ASSIGNED = f"""{CHIPS}, hh as (select *, count(case when kind = 'tdc' then 1 end) over (partition by file, chip order by idx rows unbounded preceding) seq from p),
  j as (select hh.file, hh.idx, hh.chip, hh.raw, hh.v, pl.tdc, pl.epoch, pl.prev_tdc, pl.prev_epoch, case when ((hh.v+{HALF_STEP})&{U32})<pl.tdc then (hh.v+{ROLLOVER})&{U32} else hh.v end ts_c,
    case when ((hh.v+{HALF_STEP})&{U32})<pl.prev_tdc then (hh.v+{ROLLOVER})&{U32} else hh.v end ts_p from hh join pl on pl.file=hh.file and pl.chip=hh.chip and pl.seq=hh.seq where hh.kind='hit'),
  l as (select *, prev_tdc is not null and ts_c < tdc late from j),
  r0 as (select file, idx, chip, raw, late, case when late then (prev_epoch << 30) | prev_tdc else (epoch << 30) | tdc end ext, case when late then ts_p else ts_c end ts, case when late then prev_tdc else tdc end t0 from l),
  asg as (select file, idx, chip, raw, late, ext, ts, case when ((ts-t0)&{U32}) > {PERIOD} then (((ts-t0)&{U32})-{PERIOD})&{U32} else (ts-t0)&{U32} end tof from r0)"""


def _assigned(spark, sf, late=True):
    return ordering.assign_pulses(tables.packets(spark, sf), PERIOD, late)


@query(f"with {CHIPS} select file, cast(chip as integer) chip_id, idx packet_idx, tdc, seq pulse_seq, prev_tdc, epoch, prev_epoch, (epoch << 30) | tdc ext_tdc from pl")
def pulse_table(spark, sf):
    """The pulses of each chip with their epoch and predecessor."""
    return ordering.pulses(tables.packets(spark, sf))


@query(f"with {ASSIGNED} select file, idx packet_idx, cast(chip as integer) chip_id, ext ext_tdc, ts \"timestamp\", tof, late from asg")
def pulse_assign(spark, sf):
    """Each hit with its pulse; late hits go to the one before."""
    return _assigned(spark, sf).select("file", "packet_idx", "chip_id", "ext_tdc", "timestamp", "tof", "late")


@query(f"""with {CHIPS}, b as (select file, chip, sec, min(idx) a, max(idx) z, max_by(case when kind='tdc' then v end, case when kind='tdc' then idx end) own from p group by all)
  select file, cast(row_number() over (partition by file order by sec) - 1 as integer) section_no, cast(chip as integer) chip_id, sec * 8 + 8 start_offset, z * 8 + 8 end_offset,
  last_value(own ignore nulls) over (partition by file, chip order by sec rows between unbounded preceding and 1 preceding) initial_tdc,
  coalesce(own, last_value(own ignore nulls) over (partition by file, chip order by sec rows between unbounded preceding and 1 preceding)) final_tdc from b""")
def sections(spark, sf):
    """S8, S10-S12, S20."""
    return ordering.sections(tables.packets(spark, sf))


@query(f"with {ASSIGNED} select file, ext ext_tdc, count(*) n_hits, count(distinct chip) n_chips, min(tof) first_tof, max(tof) last_tof from asg group by all")
def merged_pulses(spark, sf):
    """Hits of all chips by equal extended markers."""
    return _assigned(spark, sf).groupBy("file", "ext_tdc").agg(F.count("*").alias("n_hits"), F.countDistinct("chip_id").alias("n_chips"), F.min("tof").alias("first_tof"), F.max("tof").alias("last_tof"))


@query(f"""with {ASSIGNED}, v(chip, a, d, tx, ty) as (values (0,1,1,258,0),(1,-1,-1,513,513),(2,-1,-1,255,513),(3,1,1,0,0)),
  q as (select *, (raw >> 44) & 65535 ad from asg), xy as (select *, ((ad & 65024) >> 8) + ((ad & 7) >> 2) lx, ((ad & 504) >> 1) + (ad & 3) ly from q)
  select file, ext ext_tdc, idx packet_idx, cast(case when a*lx+tx between 0 and 65535 then a*lx+tx else 65535 end as integer) x, cast(case when d*ly+ty between 0 and 65535 then d*ly+ty else 65535 end as integer) y,
  tof, cast((raw >> 20) & 1023 as integer) tot, ts "timestamp", cast(chip as integer) chip_id, -1 cluster_id from xy join v using (chip)""")
def read_hits(spark, sf):
    """Packets to the hit table, end to end."""
    return ordering.read_hits(tables.packets(spark, sf), DetectorConfig())


#: Words by kind with the chip of the last header, 0 before a file's first one.
WORDS = f"""{PACKETS_SQL}, hd as (select *, case when (raw & {U32}) = {HEADER_MAGIC} then 'header' when ((raw >> 56) & 255) = {TDC_BYTE} then 'tdc' when ((raw >> 60) & 15) = {HIT_NIBBLE} then 'hit' end kind from packets),
  ch as (select file, packet_idx idx, raw, kind, coalesce(last_value(case when kind = 'header' then (raw >> 32) & 255 end ignore nulls) over (partition by file order by packet_idx rows unbounded preceding), 0) chip from hd),
  wd as (select *, case when kind = 'tdc' then (raw >> 12) & {ROLLOVER - 1} when kind = 'hit' then ((raw & 65535) << 14) | ((raw >> 30) & 16383) end v from ch)"""


@query(f"""with {WORDS}, st as (select *, v < lag(v) over (partition by file, chip, kind order by idx) back, row_number() over (partition by file, chip, kind order by idx) rn,
    count(*) filter (kind = 'hit') over (partition by file, chip order by idx rows unbounded preceding) hits_to from wd),
  gp as (select file, chip, idx, v, rn, hits_to - lag(hits_to) over (partition by file, chip order by idx) gap, v - lag(v) over (partition by file, chip order by idx) step from st where kind = 'tdc'),
  gs as (select file, chip, min(gap) min_hits, avg(gap) mean_hits, max(gap) max_hits, list(v order by idx) filter (rn <= 5) five, list(step order by idx) filter (rn between 2 and 5) steps, count(*) n from gp group by all)
  select st.file, cast(st.chip as integer) chip_id, count(*) filter (kind = 'tdc') n_tdc, count(*) filter (kind = 'tdc' and back) n_tdc_back, count(*) filter (kind = 'hit') n_hits, count(*) filter (kind = 'hit' and back) n_back,
    round(100.0::double * (count(*) filter (kind = 'hit' and back)) / greatest(count(*) filter (kind = 'hit'), 1), 6) disorder_percent, any_value(min_hits) min_hits, round(any_value(mean_hits), 6) mean_hits, any_value(max_hits) max_hits,
    case when any_value(n) >= 5 then array_to_string(any_value(five), ' ') end first_tdcs, case when any_value(n) > 5 then array_to_string(any_value(steps), ' ') end tdc_steps
  from st left join gs on gs.file = st.file and gs.chip = st.chip group by st.file, st.chip""")
def disorder_rate(spark, sf):
    """A21, X11, W7."""
    d = ordering.disorder(ordering.summaries(tables.packets(spark, sf)))
    text = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.col(c).cast("array<string>"), " ")).alias(c)
    return d.select("file", "chip_id", "n_tdc", "n_tdc_back", "n_hits", "n_back", F.round("disorder_percent", 6).alias("disorder_percent"), "min_hits", F.round("mean_hits", 6).alias("mean_hits"), "max_hits", text("first_tdcs"), text("tdc_steps"))


@query(f"""with {WORDS}, nx as (select file, idx, chip, kind, v, lag(v) over (partition by file, kind order by idx) previous from wd where kind in ('tdc', 'hit')),
  j as (select * from nx where previous - v > 500000000),
  ctx as (select j.file, j.idx spot, e.kind, e.idx, e.chip, e.v, row_number() over (partition by j.file, j.idx, e.kind order by e.idx desc) r from j join nx e on e.file = j.file and e.idx < j.idx),
  t as (select file, spot, string_agg(idx || ':' || chip || ':' || v, ' ' order by idx) filter (kind = 'tdc' and r <= 5) tdcs, string_agg(idx || ':' || chip || ':' || v, ' ' order by idx) filter (kind = 'hit' and r <= 10) hits from ctx group by all)
  select j.file, j.idx packet_idx, cast(chip as integer) chip_id, j.kind, previous, v "timestamp", coalesce(tdcs, '') tdcs, coalesce(hits, '') hits from j left join t on t.file = j.file and t.spot = j.idx""")
def rollover_diag(spark, sf):
    """Both kinds, with the last five markers and ten hits before."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x.cast("array<string>"), ":")), " ").alias(c)
    found = ordering.rollovers(tables.packets(spark, sf), 500_000_000)
    return found.select("file", "packet_idx", "chip_id", "kind", "previous", "timestamp", text("tdcs"), text("hits"))


@query(f"with {ASSIGNED} select file, cast(chip as integer) chip_id, ext ext_tdc, idx packet_idx, ts \"timestamp\", tof, raw from asg")
def streaming_pulses(spark, sf):
    """What the stream of pulses gives once all has come (tests hold the stream against it)."""
    return streaming.assemble_batch(tables.packets(spark, sf), PERIOD)


SLICES = f"""{HITS_SQL}, h as (select *, row_number() over (partition by file, ext_tdc order by tof, chip_id, packet_idx) rn, count(*) over (partition by file, ext_tdc) n from hits),
  lt as (select file, ext_tdc, tof, max(rn) last from h group by all),
  s(file, ext_tdc, k, start, cutoff) as (select file, ext_tdc, 0, 1::bigint, tof from h where rn = least(100, n)
    union all select s.file, s.ext_tdc, k + 1, last + 1, h.tof from s join lt on lt.file = s.file and lt.ext_tdc = s.ext_tdc and lt.tof = cutoff join h on h.file = s.file and h.ext_tdc = s.ext_tdc and h.rn = least(last + 100, h.n) where last < h.n)"""


@query(f"with recursive {SLICES} select h.file, h.ext_tdc, packet_idx, x::integer x, y::integer y, tof, tot::integer tot, chip_id::integer chip_id, k slice_no, cutoff emit_cutoff_tof, tof <= cutoff emits from h join s on s.file = h.file and s.ext_tdc = h.ext_tdc and rn >= start and tof <= cutoff + case when n > 100 then 3 else 0 end")
def pulse_slices(spark, sf):
    """Pulses cut into slices of 100 hits with an overlap of 3 ticks."""
    return ordering.slices(_hits(spark, sf), 100, 3)


@query(f"""with {CHIPS}, m as (select file, sec, max_by(v, idx) filter (kind = 'tdc') own, any_value(chip) chip from p group by all),
  f as (select file, sec, last_value(own ignore nulls) over (partition by file, chip order by sec rows unbounded preceding) tdc from m),
  s as (select p.file, p.idx, p.chip, f.tdc, v raw_ts, case when ((v + {HALF_STEP}) & {U32}) < f.tdc then (v + {ROLLOVER}) & {U32} else v end ts from p join f on f.file = p.file and f.sec = p.sec where kind = 'hit' and f.tdc is not null order by p.file, p.idx limit 1)
  select file, idx packet_idx, cast(chip as integer) chip_id, tdc, raw_ts, ts, ts - tdc delta, case when ((ts - tdc) & {U32}) > {PERIOD} then (((ts - tdc) & {U32}) - {PERIOD}) & {U32} else (ts - tdc) & {U32} end tof from s""")
def debug_sample(spark, sf):
    """S21."""
    return ordering.debug_sample(tables.packets(spark, sf), PERIOD)


@query(f"""with {HITS_SQL}, o as (select *, row_number() over w n, tof - lag(tof) over w > 3 gap from hits window w as (partition by file, ext_tdc order by tof, chip_id, packet_idx)),
  b as (select file, ext_tdc, packet_idx, last_value(case when coalesce(gap, true) then n end ignore nulls) over (partition by file, ext_tdc order by tof, chip_id, packet_idx rows unbounded preceding) begun from o)
  select file, ext_tdc, packet_idx, cast((begun - 1) // 50 as integer) slice_no from b""")
def gap_slices(spark, sf):
    """Pulses cut at gaps in time, for clustering slice by slice."""
    return ordering.gap_slices(_hits(spark, sf), WINDOW, 50).select("file", "ext_tdc", "packet_idx", "slice_no")


@query(f"with recursive {HITS_SQL}, {EDGES}, {CLOSURE} select file, ext_tdc, packet_idx, cluster from grid")
def out_of_core_clusters(spark, sf):
    """The same clusters from slices as from whole pulses."""
    sliced = ordering.gap_slices(_hits(spark, sf), WINDOW, 50)
    found = clustering.cluster_hits(sliced, ClusteringConfig(RADIUS, 75.0), "grid", keys=("file", "ext_tdc", "slice_no"))
    names = found.groupBy("file", "ext_tdc", "slice_no", "cluster_id").agg(F.min("packet_idx").alias("cluster"))
    return found.join(names, ["file", "ext_tdc", "slice_no", "cluster_id"]).select("file", "ext_tdc", "packet_idx", "cluster")


@query(f"with {ASSIGNED.replace('prev_tdc is not null and ts_c < tdc late', 'false late')} select file, idx packet_idx, ext ext_tdc, tof from asg")
def direct_decode(spark, sf):
    """No late hits."""
    return _assigned(spark, sf, False).select("file", "packet_idx", "ext_tdc", "tof")


#: The words numbered as they stand in files.
NUMBERED_SQL = PACKETS_SQL.replace("packets as (", "unnumbered as (") + ", packets as (select file, row_number() over (partition by file order by packet_idx) - 1 packet_idx, raw from unnumbered)"


def _files(spark, sf) -> str:
    folder = new_folder(spark, "packets")
    tpx3.write_files(tables.packets(spark, sf), folder).collect()  # a row per file
    return folder


def _named(df: DataFrame) -> DataFrame:
    """Files by their names."""
    return df.withColumn("file", F.regexp_extract("file", "([^/]*)[.]tpx3$", 1))


@query(f"with {NUMBERED_SQL} select file, packet_idx, raw from packets")
def packet_files(spark, sf):
    """Packets to files and back through the data source, in small ranges."""
    return _named(tpx3.read_packets(spark, _files(spark, sf), split_mb=0.01))


@query(f"with {ASSIGNED.replace(PACKETS_SQL, NUMBERED_SQL)} select file, ext ext_tdc, idx packet_idx, ts \"timestamp\", tof, cast(chip as integer) chip_id, cast((raw >> 20) & 1023 as integer) tot from asg")
def file_hits(spark, sf):
    """Files to hits, read in place."""
    return _named(ordering.read_files(spark, _files(spark, sf))).select("file", "ext_tdc", "packet_idx", "timestamp", "tof", "chip_id", "tot")


# --- clustering ---------------------------------------------------------------------------------------------------


@query(f"with {HITS_SQL}, {EDGES} select file, ext_tdc, a, b from edges")
def grid_edges(spark, sf):
    """J6, J7, J9."""
    return clustering.neighbours(_hits(spark, sf), RADIUS, WINDOW, order="packet_idx")


@query(f"with {HITS_SQL}, {EDGES}, d as (select file, ext_tdc, h, count(*) n from (select file, ext_tdc, a h from edges union all select file, ext_tdc, b from edges) group by all) select hits.file, hits.ext_tdc, packet_idx, coalesce(n, 0)::bigint degree, coalesce(n, 0) >= 2 is_core from hits left join d on d.file = hits.file and d.ext_tdc = hits.ext_tdc and h = packet_idx")
def dbscan_core(spark, sf):
    """Degrees without the hit itself."""
    return clustering.core_hits(_hits(spark, sf), RADIUS, WINDOW, 2, order="packet_idx").withColumn("degree", F.col("degree").cast("long"))


def _clustered(spark, sf, name, least=1):
    return clustering.cluster_hits(_hits(spark, sf), ClusteringConfig(RADIUS, 75.0, least), name)


def _least(df: DataFrame) -> DataFrame:
    """Clusters named by their least hit."""
    names = df.groupBy("file", "ext_tdc", "cluster_id").agg(F.min("packet_idx").alias("cluster"))
    return df.join(names, ["file", "ext_tdc", "cluster_id"]).select("file", "ext_tdc", "packet_idx", F.when(F.col("cluster_id") >= 0, F.col("cluster")).otherwise(-1).alias("cluster"))


@query(f"with recursive {HITS_SQL}, {EDGES}, {CLOSURE} select file, ext_tdc, packet_idx, cluster from grid")
def grid_clusters(spark, sf):
    """C3, C3a, W6."""
    return _least(_clustered(spark, sf, "grid"))


@query(f"with recursive {HITS_SQL}, {EDGES}, {CLOSURE} select file, ext_tdc, packet_idx, cluster from grid")
def grid_clusters_joins(spark, sf):
    """C3 by joins only, for pulses too large for one task."""
    return clustering.components_sql(_hits(spark, sf), RADIUS, WINDOW, order="packet_idx")


@query(f"""with recursive {HITS_SQL}, {EDGES}, sym as (select file, ext_tdc, a, b from edges union all select file, ext_tdc, b, a from edges), core as (select file, ext_tdc, a from sym group by all having count(*) >= 2),
  ce as (select e.* from sym e join core p on p.file = e.file and p.ext_tdc = e.ext_tdc and p.a = e.a join core q on q.file = e.file and q.ext_tdc = e.ext_tdc and q.a = e.b),
  r(file, ext_tdc, a, b) as (select file, ext_tdc, a, a from core union select r.file, r.ext_tdc, r.a, ce.b from r join ce on ce.file = r.file and ce.ext_tdc = r.ext_tdc and ce.a = r.b),
  lab as (select file, ext_tdc, a packet_idx, min(b) cluster from r group by all)
  select file, ext_tdc, packet_idx, cluster from lab""")
def dbscan_cores(spark, sf):
    """The clusters of core hits, named by their least core hit."""
    hits = _clustered(spark, sf, "dbscan")
    core = clustering.core_hits(hits, RADIUS, WINDOW, 2, order="packet_idx").where("is_core").select("file", "ext_tdc", "packet_idx")
    return _least(hits.join(core, ["file", "ext_tdc", "packet_idx"]))


@query(f"""with {HITS_SQL}, {EDGES}, sym as (select file, ext_tdc, a, b from edges union all select file, ext_tdc, b, a from edges), core as (select file, ext_tdc, a from sym group by all having count(*) >= 2),
  reached as (select file, ext_tdc, a packet_idx from core union select e.file, e.ext_tdc, e.b from sym e join core c on c.file = e.file and c.ext_tdc = e.ext_tdc and c.a = e.a)
  select file, ext_tdc, packet_idx from hits where not exists (select 1 from reached r where r.file = hits.file and r.ext_tdc = hits.ext_tdc and r.packet_idx = hits.packet_idx)""")
def dbscan_noise(spark, sf):
    """Hits that no cluster reaches."""
    return _clustered(spark, sf, "dbscan").where("cluster_id < 0").select("file", "ext_tdc", "packet_idx")


@query(f"""with recursive {HITS_SQL}, {EDGES}, sym as (select file, ext_tdc, a, b from edges union all select file, ext_tdc, b, a from edges), core as (select file, ext_tdc, a from sym group by all having count(*) >= 2),
  rk as (select file, ext_tdc, packet_idx, row_number() over (partition by file, ext_tdc order by tof, chip_id, packet_idx) rn from hits),
  ce as (select e.* from sym e join core p on p.file = e.file and p.ext_tdc = e.ext_tdc and p.a = e.a join core q on q.file = e.file and q.ext_tdc = e.ext_tdc and q.a = e.b),
  r(file, ext_tdc, a, b) as (select file, ext_tdc, a, a from core union select r.file, r.ext_tdc, r.a, ce.b from r join ce on ce.file = r.file and ce.ext_tdc = r.ext_tdc and ce.a = r.b),
  lab as (select r.file, r.ext_tdc, a, min(rn) l from r join rk on rk.file = r.file and rk.ext_tdc = r.ext_tdc and rk.packet_idx = r.b group by all),
  own as (select file, ext_tdc, a packet_idx, l from lab union all
    select e.file, e.ext_tdc, e.b, min(l) from sym e join lab on lab.file = e.file and lab.ext_tdc = e.ext_tdc and lab.a = e.a where not exists (select 1 from core c where c.file = e.file and c.ext_tdc = e.ext_tdc and c.a = e.b) group by all)
  select file, ext_tdc, packet_idx, case when l is null then -1 else min(packet_idx) over (partition by file, ext_tdc, l) end cluster from hits left join own using (file, ext_tdc, packet_idx)""")
def dbscan_clusters(spark, sf):
    """Whole clusters, with each border hit in the cluster of the first core hit."""
    return _least(_clustered(spark, sf, "dbscan"))


@query()
def abs_clusters(spark, sf):
    """Greedy buckets (order dependent, tests hold it against a direct simulation)."""
    return _clustered(spark, sf, "abs").select("file", "ext_tdc", "packet_idx", "cluster_id")


@query()
def abs_neutrons(spark, sf):
    """Cluster and extract, pulse by pulse."""
    return extraction.extract_neutrons(_clustered(spark, sf, "abs"))


@query(f"with {LABELLED}, s as (select file, ext_tdc, cluster_id, count(*) n, min(struct_pack(tof := tof, chip := chip_id, idx := packet_idx)) f from lab group by all having count(*) >= 9), d as (select *, cast(row_number() over (partition by file, ext_tdc order by f) - 1 as integer) id from s) select lab.file, lab.ext_tdc, packet_idx, coalesce(id, -1) cluster_id from lab left join d using (file, ext_tdc, cluster_id)")
def cluster_prune(spark, sf):
    """F7, W6."""
    return extraction.prune_small(_labelled(spark, sf), 9).select("file", "ext_tdc", "packet_idx", "cluster_id")


@query(f"with {LABELLED}, c as (select file, ext_tdc, cluster_id, count(*) n from lab where cluster_id % 5 <> 0 group by all) select (select count(*) from lab) hits_processed, count(*) clusters_found, (select count(*) from lab where cluster_id % 5 = 0) noise_hits, max(n) largest_cluster_size, round(avg(n), 6) mean_cluster_size from c")
def clustering_statistics(spark, sf):
    """A8."""
    noisy = _labelled(spark, sf).withColumn("cluster_id", F.when(F.col("cluster_id") % 5 == 0, -1).otherwise(F.col("cluster_id")))
    return extraction.clustering_statistics(noisy).withColumn("mean_cluster_size", F.round("mean_cluster_size", 6))


# --- extraction ---------------------------------------------------------------------------------------------------


def _centroid_sql(weighted: bool) -> str:
    centre = "case when sum(tot) > 0 then sum({0} * tot)::double / least(sum(tot), 4294967295) else sum({0})::double / count(*) end" if weighted else "sum({0})::double / count(*)"
    return f"""with {LABELLED} select file, ext_tdc, cast(cluster_id as integer) cluster_id, round({centre.format('x')} * 8, 6) x, round({centre.format('y')} * 8, 6) y,
      arg_max(tof, struct_pack(a := tot, b := tof, c := chip_id, d := packet_idx)) tof, cast(least(sum(tot), 65535) as integer) tot, cast(least(count(*), 65535) as integer) n_hits,
      cast(arg_max(chip_id, struct_pack(a := tot, b := tof, c := chip_id, d := packet_idx)) as integer) chip_id from lab where tot >= 10 group by file, ext_tdc, cluster_id"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query(_centroid_sql(True))
def centroid_weighted(spark, sf):
    """A1, A3-A6, F5, F6."""
    return _rounded(extraction.extract_neutrons(_labelled(spark, sf)))


@query(_centroid_sql(False))
def centroid_unweighted(spark, sf):
    """A2."""
    return _rounded(extraction.extract_neutrons(_labelled(spark, sf), ExtractionConfig(weighted_by_tot=False)))


@query(f"""with neu as ({_centroid_sql(True)}) select count(*) "count", round(avg(tof), 6) mean_tof, round(stddev_pop(tof), 6) std_tof, round(avg(tot), 6) mean_tot, round(avg(n_hits), 6) mean_cluster_size,
  round(avg((n_hits = 1)::int::double), 6) single_hit_fraction, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, min(tof)::double min_tof, max(tof)::double max_tof from neu""")
def neutron_stats(spark, sf):
    """A7."""
    s = extraction.neutron_statistics(_rounded(extraction.extract_neutrons(_labelled(spark, sf))))
    return s.select("count", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


@query(f"with neu as ({_centroid_sql(True)}) select file, ext_tdc, cluster_id, case when n_hits = 1 then 'Single' when n_hits between 2 and 4 then 'Small' when n_hits between 5 and 10 then 'Medium' else 'Large' end category, round(x / 8, 4) px, round(y / 8, 4) py from neu")
def size_category(spark, sf):
    """P17, P18."""
    n = _rounded(extraction.extract_neutrons(_labelled(spark, sf)))
    return n.select("file", "ext_tdc", "cluster_id", bits.size_category(F.col("n_hits")).alias("category"), F.round(F.col("x") / 8, 4).alias("px"), F.round(F.col("y") / 8, 4).alias("py"))


@query(f"with {HITS_SQL} select file, count(*) n_hits, min(tof) min_tof, max(tof) max_tof, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y from hits group by file")
def file_info(spark, sf):
    """A9, U3."""
    return extraction.file_info(_hits(spark, sf))


# --- histograms ---------------------------------------------------------------------------------------------------


@query(f"with {HITS_SQL}, {CUBE} select tof_bin, y, x, n \"count\" from cube")
def hit_cube(spark, sf):
    """A11."""
    return _cube(spark, sf)


@query(f"with neu as ({_centroid_sql(True)}), b as (select cast(round(x / 8) as integer) x, cast(round(y / 8) as integer) y, tof from neu) select cast(least(tof * 20 // 64, 19) as integer) tof_bin, y, x, count(*) \"count\" from b where x between 0 and 63 and y between 0 and 63 group by all")
def neutron_cube(spark, sf):
    """A12."""
    return cube.neutron_cube(_rounded(extraction.extract_neutrons(_labelled(spark, sf))), TOF_MAX, BINS, SIDE, SIDE, 8.0)


@query(f"with {HITS_SQL}, {CUBE} select y, x, sum(n)::bigint \"count\" from cube group by y, x")
def projection(spark, sf):
    """A13."""
    return cube.projection(_cube(spark, sf))


@query(f"with {HITS_SQL}, {CUBE} select y, x, n \"count\" from cube where tof_bin = 7")
def tof_slice(spark, sf):
    """A14."""
    return cube.tof_slice(_cube(spark, sf), 7)


@query(f"with {HITS_SQL}, {CUBE} select cast(k as integer) tof_bin, coalesce(sum(n), 0)::bigint \"count\" from range(20) t(k) left join cube on tof_bin = k group by k")
def spectrum(spark, sf):
    """A15 (the flagship)."""
    return cube.spectrum(_cube(spark, sf), BINS)


@query(f"with {HITS_SQL}, {CUBE} select cast(k as integer) tof_bin, coalesce(sum(n), 0)::bigint \"count\" from range(20) t(k) left join cube on tof_bin = k and x >= 10 and x < 40 and y >= 5 and y < 50 group by k")
def spectrum_rectangle(spark, sf):
    """A15 over a half-open rectangle."""
    return cube.spectrum(_cube(spark, sf), BINS, (10, 40), (5, 50))


@query(f"with {HITS_SQL}, {CUBE} select tof_bin, y, x, sum(n)::bigint \"count\" from cube group by grouping sets ((y, x), (tof_bin), ())")
def rollups(spark, sf):
    """One pass with grouping sets."""
    return cube.rollups(_cube(spark, sf))


@query(f"with {HITS_SQL}, c2 as (select cast(least(tof * 50 // 64, 49) as integer) tof_bin, count(*) n from hits group by all) select cast(k as integer) tof_bin, coalesce(n, 0)::bigint \"count\" from range(50) t(k) left join c2 on tof_bin = k")
def rebin(spark, sf):
    """A27."""
    return cube.spectrum(_cube(spark, sf, 50), 50)


@query(f"with {HITS_SQL}, {CUBE} select tof_bin, y, x, (2 * n)::bigint \"count\" from cube where n > 0")
def histogram_merge(spark, sf):
    """K10, U1."""
    c = _cube(spark, sf)
    return cube.merged(c, c)


@query(f"with {HITS_SQL}, {CUBE}, {MASKS} select round(m, 6) mean, round(sd, 6) std_dev, round(m + 2 * sd, 6) threshold, 2.0::double sigma from st")
def mask_statistics(spark, sf):
    """A17."""
    s = cube.mask_statistics(cube.projection(_cube(spark, sf)), 2.0)
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query(f"with {HITS_SQL}, {CUBE}, {MASKS} select x, y, c \"count\", dead, hot from mask")
def pixel_masks(spark, sf):
    """A17, K11."""
    return cube.pixel_masks(cube.projection(_cube(spark, sf)), SIDE, SIDE, 2.0)


@query(f"with {HITS_SQL}, {CUBE}, {MASKS}, u as (select tof_bin, sum(n) n from cube join mask using (x, y) where dead = 0 and hot = 0 group by all) select cast(k as integer) tof_bin, coalesce(n, 0)::bigint \"count\" from range(20) t(k) left join u on tof_bin = k")
def masked_spectrum(spark, sf):
    """A16, F10, J10."""
    c = _cube(spark, sf)
    return cube.masked_spectrum(c, cube.pixel_masks(cube.projection(c), SIDE, SIDE, 2.0), BINS)


@query(f"with {HITS_SQL}, {CUBE}, {MASKS} select x + 0.5::double x, y + 0.5::double y from mask where hot = 1")
def hot_points(spark, sf):
    """A26."""
    return cube.hot_points(cube.pixel_masks(cube.projection(_cube(spark, sf)), SIDE, SIDE, 2.0))


@query(f"with {HITS_SQL} select (max(x) + 1)::bigint width, (max(y) + 1)::bigint height from hits")
def dimensions(spark, sf):
    """A20."""
    return cube.dimensions(_hits(spark, sf))


@query(f"with {HITS_SQL}, {CUBE}, p as (select y, x, sum(n) * 40000 c from cube group by y, x) select y, x, least(c, 65535)::bigint \"count\", c > 65535 clipped from p")
def image_clamp(spark, sf):
    """K18."""
    p = cube.projection(_cube(spark, sf)).withColumn("count", F.col("count") * 40000)
    return cube.clamped(p, 16)


@query(f"with {HITS_SQL}, {CUBE}, p as (select y, x, sum(n) c from cube group by y, x), m as (select max(c) top from p) select y, x, round(sqrt(c::double / top), 6) linear, round(log10(c + 1.0::double) / log10(top + 1.0::double), 6) log from p cross join m")
def colormap(spark, sf):
    """The shade of each pixel, linear and logarithmic."""
    p = cube.projection(_cube(spark, sf))
    both = p.crossJoin(F.broadcast(p.agg(F.max("count").alias("top"))))
    return both.select("y", "x", F.round(energy.shade(F.col("count"), F.col("top")), 6).alias("linear"), F.round(energy.shade(F.col("count"), F.col("top"), True), 6).alias("log"))


# --- regions and views --------------------------------------------------------------------------------------------

TRIANGLE = ((8.0, 6.0), (55.5, 12.0), (30.0, 60.0))


@query(f"with {HITS_SQL}, {CUBE}, {MASKS} select cast(k as integer) tof_bin, coalesce(sum(n), 0)::bigint \"count\" from range(20) t(k) left join (select c.* from cube c join mask using (x, y) where dead = 0 and hot = 0) c on tof_bin = k and 63 - y >= 10 and 63 - y < 31 and x >= 4 and x < 51 group by k")
def roi_rect(spark, sf):
    """A rectangle on a view turned by 90 degrees, masked."""
    c = _cube(spark, sf)
    masks = cube.pixel_masks(cube.projection(c), SIDE, SIDE, 2.0)
    return cube.filled(roi.roi_spectrum(c, roi.Roi.rectangle(1, "r", 10.2, 4.0, 30.5, 50.1), BINS, SIDE, SIDE, roi.View(1), masks), BINS)


def _inside_sql(x: str, y: str) -> str:
    edges = zip(TRIANGLE, TRIANGLE[-1:] + TRIANGLE[:-1], strict=True)
    return "(" + " + ".join(f"(case when ({yi}::double > {y}) <> ({yj}::double > {y}) and {x} < {xj - xi}::double * ({y} - {yi}::double) / {yj - yi}::double + {xi}::double then 1 else 0 end)" for (xi, yi), (xj, yj) in edges) + ") % 2 = 1"


@query(f"with {HITS_SQL}, {CUBE} select cast(k as integer) tof_bin, coalesce(sum(n), 0)::bigint \"count\" from range(20) t(k) left join cube on tof_bin = k and {_inside_sql('(x + 0.5::double)', '(y + 0.5::double)')} group by k")
def roi_polygon(spark, sf):
    """A19, F12, J11."""
    return roi.roi_spectrum(_cube(spark, sf), roi.Roi.polygon(2, "t", list(TRIANGLE)), BINS, SIDE, SIDE)


@query(f"with {HITS_SQL} select packet_idx, case when {_inside_sql('x::double', 'y::double')} then 2 when x between 5 and 40 and y between 5 and 40 then 1 end roi_id from hits")
def topmost_roi(spark, sf):
    """W8, F11, F12."""
    rois = [roi.Roi.rectangle(1, "r", 5, 5, 40, 40), roi.Roi.polygon(2, "t", list(TRIANGLE))]
    return _hits(spark, sf).select("packet_idx", roi.topmost(rois, F.col("x").cast("double"), F.col("y").cast("double")).alias("roi_id"))


@query("""with p as (select cast(i % 70 as bigint) x, cast(i // 70 as bigint) y from range(4900) t(i)) select x, y, case when x < 48 and y < 64 then y end sx, case when x < 48 and y < 64 then x end sy from p""")
def view_transform(spark, sf):
    """The data pixel under each display pixel, turned by 90 degrees and flipped; null outside a 64 x 48 image."""
    p = spark.range(4900).selectExpr("id % 70 x", "id div 70 y")
    view = roi.View().clockwise().mirrored(True)
    sx, sy = view.source_pixel(F.col("x"), F.col("y"), 64, 48)
    return p.select("x", "y", sx.cast("long").alias("sx"), sy.cast("long").alias("sy"))


@query(f"with {HITS_SQL} select packet_idx, round(48 - (48 - (y + 0.25::double)), 6) dx, round(x + 0.5::double, 6) dy, round(x + 0.5::double, 6) bx, round(y + 0.25::double, 6) by_ from hits")
def view_transform_points(spark, sf):
    """Points to the display and back."""
    view = roi.View(1, True, False)
    x, y = F.col("x") + 0.5, F.col("y") + 0.25
    dx, dy = view.place(x, y, 64.0, 48.0)
    bx, by = view.unplace(dx, dy, 64.0, 48.0)
    return _hits(spark, sf).select("packet_idx", *(F.round(c, 6).alias(n) for c, n in ((dx, "dx"), (dy, "dy"), (bx, "bx"), (by, "by_"))))


@query(f"with {HITS_SQL}, {CUBE} select x, y, sum(n)::bigint \"count\" from cube where x = 5 and y = 56 group by all")
def cursor_count(spark, sf):
    """The count under display pixel (5, 7) of an image flipped vertically."""
    sx, sy = roi.View(0, False, True).source_pixel(F.lit(5), F.lit(7), SIDE, SIDE)
    return _cube(spark, sf).where((F.col("x") == sx) & (F.col("y") == sy)).groupBy("x", "y").agg(F.sum("count").alias("count"))


# --- energy and axes ----------------------------------------------------------------------------------------------

BIN_NS = 83333.333


@query(f"""with k as (select cast(i as integer) tof_bin, i * {BIN_NS}::double ns from range(200) t(i)) select tof_bin,
  round(case when ns / 1000.0::double - 5.0 > 0 then 0.5 * 1.674927498e-27::double * (25.0::double / ((ns / 1000.0::double - 5.0::double) * 1e-6::double)) * (25.0::double / ((ns / 1000.0::double - 5.0::double) * 1e-6::double)) / 1.602176634e-19::double end, 6) viewed,
  round(case when (ns + 5000.0) * 1e-9 > 0 then 0.5 * 1.67492749804e-27::double * (25.0::double / ((ns + 5000.0::double) * 1e-9::double)) * (25.0::double / ((ns + 5000.0::double) * 1e-9::double)) / 1.602176634e-19::double else 0 end, 6) filed from k""")
def energy_axes(spark, sf):
    """Both conversions of each bin's left edge."""
    k = spark.range(200).select(F.col("id").cast("int").alias("tof_bin"), (F.col("id") * BIN_NS).alias("ns"))
    return k.select("tof_bin", F.round(energy.energy_view(F.col("ns") / 1000.0, 25.0, 5000.0), 6).alias("viewed"), F.round(energy.energy_file(F.col("ns"), 25.0, 5000.0), 6).alias("filed"))


@query("select cast(i as integer) id, round(25.0::double / sqrt(2.0::double * (i * 0.01::double) * 1.602176634e-19::double / 1.674927498e-27::double) * 1e6::double + 5.0::double, 6) tof_us from range(1, 300) t(i)")
def energy_to_tof(spark, sf):
    """X2."""
    return spark.range(1, 300).select(F.col("id").cast("int").alias("id"), F.round(energy.tof_view(F.col("id") * 0.01, 25.0, 5000.0), 6).alias("tof_us"))


@query(f"with {HITS_SQL}, {CUBE}, s as (select tof_bin, sum(n) c from cube group by all) select tof_bin, round(tof_bin * 0.5::double, 6) tof_ms, round(log10(greatest(c, 1)::double), 6) log_count from s")
def spectrum_axis(spark, sf):
    """X4."""
    s = _cube(spark, sf).groupBy("tof_bin").agg(F.sum("count").alias("c"))
    return s.select("tof_bin", F.round(F.col("tof_bin") * 0.5, 6).alias("tof_ms"), F.round(energy.log_count(F.col("c")), 6).alias("log_count"))


@query("select cast(event_id as bigint) id, cast(least(floor(cast(event_id as bigint) % 1000 / 33.3::double), 29) as integer) tof_bin from events")
def position_to_bin(spark, sf):
    """X6."""
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(event_id as bigint) id").select("id", energy.tof_bin(F.col("id") % 1000, 999, 30).alias("tof_bin"))


# --- sinks --------------------------------------------------------------------------------------------------------


@query(f"with {HITS_SQL} select packet_idx, cast(y * 64 + x as integer) event_id, tof * 25 event_time_offset, tot * 25 time_over_threshold from hits")
def hit_event_ids(spark, sf):
    """K5, K13."""
    h = sinks.hit_event_ids(_hits(spark, sf), SIDE, SIDE)
    return h.select("packet_idx", "event_id", (F.col("tof") * 25).alias("event_time_offset"), (F.col("tot").cast("long") * 25).alias("time_over_threshold"))


@query(f"with neu as ({_centroid_sql(True)}) select file, ext_tdc, cluster_id, cast(round(y / 8)::bigint * 64 + round(x / 8)::bigint as integer) event_id from neu")
def neutron_event_ids(spark, sf):
    """K6, K14."""
    n = _rounded(extraction.extract_neutrons(_labelled(spark, sf)))
    return sinks.neutron_event_ids(n, SIDE, SIDE, 8.0).select("file", "ext_tdc", "cluster_id", "event_id")


@query(f"with {HITS_SQL}, g as (select file, ext_tdc, count(*) n from hits group by all) select file, ext_tdc, ext_tdc * 25 event_time_zero, coalesce(sum(n) over (partition by file order by ext_tdc rows between unbounded preceding and 1 preceding), 0)::bigint event_index from g")
def pulse_index(spark, sf):
    """K15."""
    return sinks.pulse_index(_hits(spark, sf))


@query(f"with {HITS_SQL}, n as (select file, ext_tdc, row_number() over (partition by file order by ext_tdc, packet_idx) - 1 event_no from hits) select file, event_no, ext_tdc from n")
def event_pulse(spark, sf):
    """Events back to their pulse by the index alone."""
    from pyspark.sql import Window

    h = _hits(spark, sf)
    numbered = h.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("ext_tdc", "packet_idx")) - 1).cast("long").alias("event_no"))
    return sinks.event_pulse(numbered, sinks.pulse_index(h))


@query(f"""with {HITS_SQL}, {CUBE}, s as (select k, coalesce(sum(n), 0)::bigint c from range(20) t(k) left join cube on tof_bin = k group by k), e as (select k, c, format('{{:.6e}}', (k + 0.5::double) * {BIN_NS}::double * 1e-9::double) t from s)
  select cast(k as integer) tof_bin, split_part(t, 'e', 1) || 'e' || cast(cast(split_part(t, 'e', 2) as integer) as varchar) || ',' || c line from e""")
def spectra_text(spark, sf):
    """K19."""
    return sinks.spectrum_lines(cube.spectrum(_cube(spark, sf), BINS), BIN_NS)


@query(f"""with {HITS_SQL}, {CUBE}, s as (select cast(k as integer) k, coalesce(sum(n), 0)::bigint a, coalesce(sum(n) filter (x >= 10 and x < 40), 0)::bigint b from range(20) t(k) left join cube on tof_bin = k group by k)
  select k tof_bin, round(k * 0.5::double, 6) tof_ms, round(0.5 * 1.674927498e-27::double * power(25.0::double / (k * 500.0::double * 1e-6::double), 2) / 1.602176634e-19::double, 6) energy_ev, a "full", b roi from s where k > 0""")
def spectra_csv(spark, sf):
    """K20."""
    c = _cube(spark, sf)
    t = sinks.spectra_table({"full": cube.spectrum(c, BINS), "roi": cube.spectrum(c, BINS, (10, 40))}, 0.5, 25.0)
    return t.select("tof_bin", F.round("tof_ms", 6).alias("tof_ms"), F.round("energy_ev", 6).alias("energy_ev"), "full", "roi")


@query("select p_partkey, regexp_replace(regexp_replace(trim(p_name), '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g') base from part")
def export_names(spark, sf):
    """K25."""
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", energy.file_name_part(F.col("p_name")).alias("base"))


@query(f"with {HITS_SQL} select file, format('{{:,}}', count(*) * 1000) n from hits group by file")
def number_format(spark, sf):
    """X8."""
    return _hits(spark, sf).groupBy("file").agg(energy.thousands(F.count("*") * 1000).alias("n"))


@query(f"with neu as ({_centroid_sql(True)}) select x, y, tof, tot::bigint tot, n_hits::bigint n_hits, chip_id::bigint chip_id from neu")
def binary_records(spark, sf):
    """K3: neutrons as packed records and back."""
    return sinks.from_records(sinks.records(_rounded(extraction.extract_neutrons(_labelled(spark, sf)))))


@query(f"with {HITS_SQL} select file, ext_tdc, count(*) n from hits group by all")
def pulse_batches(spark, sf):
    """Pulse after pulse, in one pass."""
    from pixelspark import api

    return api.pulse_rows(_hits(spark, sf)).select("file", "ext_tdc", "n")


def _neutrons(spark, sf) -> DataFrame:
    return _rounded(extraction.extract_neutrons(_labelled(spark, sf)))


NEUTRONS_BACK = f"with neu as ({_centroid_sql(True)}) select x, y, tof, tot::bigint tot, n_hits::bigint n_hits, chip_id::bigint chip_id from neu"


def _as_read(df: DataFrame) -> DataFrame:
    return df.select("x", "y", *(F.col(c).cast("long").alias(c) for c in ("tof", "tot", "n_hits", "chip_id")))


@query(NEUTRONS_BACK)
def neutrons_csv(spark, sf):
    """K1, K2: neutrons to one CSV file and back."""
    path = new_folder(spark, "csv") + "/n.csv"
    sinks.neutrons_csv(_neutrons(spark, sf), path, one_file=True)
    return _as_read(spark.read.schema("x double, y double, tof long, tot long, n_hits long, chip_id long").csv(path, header=True))


@query(NEUTRONS_BACK)
def neutrons_file(spark, sf):
    """Neutrons to one file of records, in pulse order, and back."""
    path = new_folder(spark, "records") + "/n.bin"
    sinks.neutrons_binary(_neutrons(spark, sf), path)
    return sinks.from_records(spark.read.format("binaryFile").load(path).select(F.col("content").alias("bytes")))


@query(NEUTRONS_BACK)
def neutrons_parquet(spark, sf):
    """K4, K24."""
    path = new_folder(spark, "parquet") + "/n.parquet"
    sinks.write_neutrons(_neutrons(spark, sf), path)
    return _as_read(spark.read.parquet(path))


@query(f"""with {HITS_SQL}, g as (select file, ext_tdc, count(*) n from hits group by all), i as (select file, ext_tdc, ext_tdc * 25 event_time_zero, coalesce(sum(n) over (partition by file order by ext_tdc rows between unbounded preceding and 1 preceding), 0)::bigint event_index from g)
  select file, ext_tdc, cast(y * 64 + x as integer) event_id, tof * 25 event_time_offset, tot * 25 time_over_threshold, event_time_zero, event_index from hits join i using (file, ext_tdc)""")
def event_layout(spark, sf):
    """Events and pulses written, and read and joined."""
    path = new_folder(spark, "events") + "/e"
    sinks.write_events(sinks.event_columns(sinks.hit_event_ids(_hits(spark, sf), SIDE, SIDE), ("time_over_threshold",)), path)
    events, pulses, _ = sinks.read_events(spark, path)
    return events.join(pulses, ["file", "ext_tdc"])


@query(f"with neu as ({_centroid_sql(True)}) select cast(round(y / 8)::bigint * 64 + round(x / 8)::bigint as integer) event_id, tof * 25 event_time_offset, tot::bigint * 25 time_over_threshold, n_hits from neu")
def combined_export(spark, sf):
    """A combined export, checked, and its neutrons."""
    path = new_folder(spark, "export") + "/e"
    options = export.ExportOptions(True, True, chip_id=False, n_hits=True, super_resolution=8.0)
    _, warnings = export.export(spark, export.ExportData(_hits(spark, sf), _neutrons(spark, sf), size=(SIDE, SIDE)), path, options)
    if warnings:
        raise DataError("; ".join(warnings))
    return spark.read.parquet(f"{path}/neutrons/events").select("event_id", "event_time_offset", "time_over_threshold", "n_hits")


@query(f"with {HITS_SQL}, {CUBE} select tof_bin, y, x, (2 * n)::bigint \"count\" from cube")
def histogram_layout(spark, sf):
    """A histogram written, added to, and read."""
    path, c = new_folder(spark, "histogram") + "/h", _cube(spark, sf)
    sinks.write_histogram(c, path, sinks.histogram_axes(BINS, SIDE, SIDE, 100.0))
    sinks.add_to_histogram(c, path)
    return sinks.read_histogram(spark, path)[0]


@query(f"with {HITS_SQL}, {CUBE}, {MASKS} select x, y, c \"count\", dead, hot from mask")
def mask_layout(spark, sf):
    """Masks written, checked against the detector's size, and read."""
    path = new_folder(spark, "masks") + "/m"
    sinks.write_masks(cube.pixel_masks(cube.projection(_cube(spark, sf)), SIDE, SIDE, 2.0), path, {"sigma": 2.0})
    return sinks.read_masks(spark, path, (SIDE, SIDE))[0]


@query(f"with {HITS_SQL}, g as (select file, ext_tdc, count(*) n from hits group by all) select file, ext_tdc, coalesce(sum(n) over (partition by file order by ext_tdc rows between unbounded preceding and 1 preceding), 0)::bigint event_index from g")
def event_sink(spark, sf):
    """K7: events that come in two batches, one of them twice."""
    sink = export.EventSink(spark, new_folder(spark, "sink") + "/s")
    events = sinks.event_columns(sinks.hit_event_ids(_hits(spark, sf), SIDE, SIDE), ())
    for number, part in ((0, 0), (1, 1), (1, 1)):
        sink.write(events.where(F.col("event_id") % 2 == part), number)
    return sink.pulses().select("file", "ext_tdc", "event_index")


@query(f"with neu as ({_centroid_sql(True)}), b as (select cast(round(x / 8) as integer) x, cast(round(y / 8) as integer) y, tof from neu), c2 as (select cast(least(tof * 50 // 64, 49) as integer) tof_bin, count(*) n from b where x between 0 and 63 and y between 0 and 63 group by all) select cast(k as integer) tof_bin, coalesce(n, 0)::bigint \"count\" from range(50) t(k) left join c2 on tof_bin = k")
def rebin_neutrons(spark, sf):
    """Neutrons over other bins."""
    return cube.spectrum(cube.neutron_cube(_neutrons(spark, sf), TOF_MAX, 50, SIDE, SIDE, 8.0), 50)
