"""Packet words as column expressions.

A word is 64 bits in a BIGINT; hit packets are negative, so fields are always an unsigned shift and a mask. Times are
ticks of 25 ns and wrap at 32 bits by mask.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelspark.config import TICK_NS, U16, U32, ChipTransform

#: Fixed values of the packet format.
HEADER_MAGIC, TDC_BYTE, HIT_NIBBLE = 0x33585054, 0x6F, 0xB
ROLLOVER, HALF_STEP = 0x40000000, 0x400000


def field(raw: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(raw, shift).bitwiseAND(F.lit(mask))


def packet_type(raw: Column) -> Column:
    return field(raw, 56, 0xFF)


def header_chip(raw: Column) -> Column:
    return field(raw, 32, 0xFF)


def pixel_address(raw: Column) -> Column:
    return field(raw, 44, 0xFFFF)


def toa(raw: Column) -> Column:
    return field(raw, 30, 0x3FFF)


def tot(raw: Column) -> Column:
    return field(raw, 20, 0x3FF)


def fine_toa(raw: Column) -> Column:
    return field(raw, 16, 0xF)


def spidr_time(raw: Column) -> Column:
    return raw.bitwiseAND(F.lit(0xFFFF))


def tdc_timestamp(raw: Column) -> Column:
    return field(raw, 12, 0x3FFFFFFF)


def is_header(raw: Column) -> Column:
    return raw.bitwiseAND(F.lit(U32)) == HEADER_MAGIC


def is_tdc(raw: Column) -> Column:
    return packet_type(raw) == TDC_BYTE


def is_hit(raw: Column) -> Column:
    return field(raw, 60, 0xF) == HIT_NIBBLE


def local_x(address: Column) -> Column:
    return F.shiftright(address.bitwiseAND(F.lit(0xFE00)), 8) + F.shiftright(address.bitwiseAND(F.lit(7)), 2)


def local_y(address: Column) -> Column:
    return F.shiftright(address.bitwiseAND(F.lit(0x1F8)), 1) + address.bitwiseAND(F.lit(3))


def coarse_timestamp(raw: Column) -> Column:
    return F.shiftleft(spidr_time(raw), 14).bitwiseOR(toa(raw))


def rollover_corrected(ts: Column, tdc: Column) -> Column:
    """A counter that has wrapped since the pulse began is lifted by one turn."""
    return F.when((ts + HALF_STEP).bitwiseAND(F.lit(U32)) < tdc, (ts + ROLLOVER).bitwiseAND(F.lit(U32))).otherwise(ts)


def time_of_flight(ts: Column, tdc: Column, period: int) -> Column:
    """Since the pulse, folded once where it exceeds a period."""
    raw = (ts - tdc).bitwiseAND(F.lit(U32))
    return F.when(raw > period, (raw - period).bitwiseAND(F.lit(U32))).otherwise(raw)


def extended_tdc(epoch: Column, tdc: Column) -> Column:
    return F.shiftleft(epoch.cast("long"), 30).bitwiseOR(tdc)


def tof_ns(tof: Column) -> Column:
    return tof * F.lit(TICK_NS)


def tof_ms(tof: Column) -> Column:
    return tof * F.lit(TICK_NS) / 1e6


def size_category(n_hits: Column) -> Column:
    return F.when(n_hits == 1, "Single").when(n_hits.between(2, 4), "Small").when(n_hits.between(5, 10), "Medium").otherwise("Large")


def mapped(x: Column, y: Column, chip: Column, transforms: tuple[ChipTransform, ...]) -> tuple[Column, Column]:
    """Detector coordinates of chip coordinates; a chip without transform keeps its own, what leaves 16 bits is 65535."""
    gx, gy = x, y
    for k, t in enumerate(transforms):
        gx = F.when(chip == k, t.a * x + t.b * y + t.tx).otherwise(gx)
        gy = F.when(chip == k, t.c * x + t.d * y + t.ty).otherwise(gy)
    inside = lambda v: F.when(v.between(0, U16), v).otherwise(U16)
    return inside(gx).cast("int"), inside(gy).cast("int")
