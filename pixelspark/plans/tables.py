"""Detector data derived from the driver's tables, as DataFrames and as the same SQL for the oracle.

hits come from orders (30 pulses at the smallest scale the oracle runs); packet words come from events: a header where
the chip changes, a time marker for each signup, a hit for every other event. Times are chosen so that some
hits precede their pulse's marker and the 30-bit counter turns over several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 0x6F and 0xB in the top bits of a signed word, and the header's mark.
TDC_WORD, HIT_WORD, HEADER_WORD = 0x6F << 56, (0xB << 60) - (1 << 64), 0x33585054
TURN, PERIOD = 1 << 30, 666_667

HITS_SQL = """hits as (select 'run' || cast(o_orderkey // 5000 as varchar) as file, cast(o_orderkey // 500 as bigint) as ext_tdc, cast(o_orderkey as bigint) as packet_idx,
  cast(o_custkey % 64 as bigint) as x, cast((o_custkey // 8) % 64 as bigint) as y, cast((o_orderkey * 37) % 64 as bigint) as tof, cast((o_orderkey * 13) % 50 as bigint) as tot,
  cast(o_custkey % 4 as bigint) as chip_id from orders)"""

PACKETS_SQL = f"""ev as (select cast(event_id as bigint) e, 'run' || cast(cast(event_id as bigint) // 4000 as varchar) file, cast(user_id as bigint) % 4 chip, cast(user_id as bigint) u, event_type,
    lag(cast(user_id as bigint) % 4) over (partition by cast(event_id as bigint) // 4000 order by event_id) before from events),
  ew as (select *, (e * 300000 + (e * 7919) % 900000 + {TURN} - 400000) % {TURN} ts from ev),
  packets as (select file, e * 2 packet_idx, {HEADER_WORD} + chip * 4294967296 raw from ew where before is null or before <> chip
    union all select file, e * 2 + 1, case when event_type = 'signup' then {TDC_WORD} + ((e * 300000) % {TURN}) * 4096
      else {HIT_WORD} + ((u * 31) % 65536) * 17592186044416 + (ts % 16384) * 1073741824 + ((e * 13) % 1024) * 1048576 + (e % 16) * 65536 + ts // 16384 end from ew)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_orderkey as bigint) k", "cast(o_custkey as bigint) c")
    return o.selectExpr("concat('run', k div 5000) file", "k div 500 ext_tdc", "k packet_idx", "cast(c % 64 as int) x", "cast((c div 8) % 64 as int) y", "(k * 37) % 64 tof", "cast((k * 13) % 50 as int) tot", "cast(c % 4 as int) chip_id")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(event_id as bigint) e", "cast(user_id as bigint) u", "event_type")
    e = e.selectExpr("*", "concat('run', e div 4000) file", "u % 4 chip", f"(e * 300000 + (e * 7919) % 900000 + {TURN} - 400000) % {TURN} ts")
    before = F.lag("chip").over(Window.partitionBy("file").orderBy("e"))
    e = e.withColumn("before", before)
    word = f"case when event_type = 'signup' then {TDC_WORD} + ((e * 300000) % {TURN}) * 4096 else {HIT_WORD} + ((u * 31) % 65536) * 17592186044416 + (ts % 16384) * 1073741824 + ((e * 13) % 1024) * 1048576 + (e % 16) * 65536 + ts div 16384 end"
    head = e.where("before is null or before <> chip").selectExpr("file", "e * 2 packet_idx", f"{HEADER_WORD} + chip * 4294967296 raw")
    return head.union(e.selectExpr("file", "e * 2 + 1 packet_idx", f"{word} raw"))
