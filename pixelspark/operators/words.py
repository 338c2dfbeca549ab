"""Packet words a block at a time, as arrays.

A block is a run of consecutive words of one file. What runs along a file (the chip of the last header, each chip's last two
time markers and how often their counter has turned) is a small state, and a block's effect on it is a small summary. So a
file is resolved in two passes that each see a word once: summaries of all blocks, a prefix over those few rows, and
the blocks again with the state that holds at their start.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

from pixelspark.config import U32
from pixelspark.functions.bits import HALF_STEP, HEADER_MAGIC, HIT_NIBBLE, ROLLOVER, TDC_BYTE

NO_CHIP = -1  # of words before a block's, or a file's, first header
FIRST, TDC_TAIL, HIT_TAIL = 5, 5, 10

PART = "chip int, n_tdc long, first_tdc long, last_tdc long, second_tdc long, turns long, n_hits long, first_hit long, last_hit long, back long, hits_before long, hits_after long, n_gaps long, gap_min long, gap_max long, first_tdcs array<long>"
SUMMARY = f"file string, block long, first long, count long, last_chip int, last_header long, parts array<struct<{', '.join(p.replace(' ', ':', 1) for p in PART.split(', '))}>>, tdcs array<array<long>>, hits array<array<long>>"
STATE = "file string, block long, first long, count long, state string"


def corrected(ts: np.ndarray, tdc: np.ndarray | int) -> np.ndarray:
    """A counter that has wrapped since the pulse began is lifted by one turn."""
    return np.where(((ts + HALF_STEP) & U32) < tdc, (ts + ROLLOVER) & U32, ts)


def flight(ts: np.ndarray, tdc: np.ndarray | int, period: int) -> np.ndarray:
    """Since the pulse, folded once where it exceeds a period."""
    raw = (ts - tdc) & U32
    return np.where(raw > period, (raw - period) & U32, raw)


class Block:
    """The words of a block by kind. chip0: the chip of the words before its first header."""

    def __init__(self, raw: np.ndarray, idx: np.ndarray, chip0: int = NO_CHIP, section0: int = -1):
        self.raw, self.idx = raw, idx
        self.header = (raw & U32) == HEADER_MAGIC
        self.tdc = ~self.header & ((raw >> 56 & 0xFF) == TDC_BYTE)
        self.hit = ~self.header & ((raw >> 60 & 0xF) == HIT_NIBBLE)
        self.at = np.flatnonzero(self.header)
        self.chips_at = np.append(chip0, raw[self.at] >> 32 & 0xFF).astype(np.int32)  # before the first header, and from each one on
        self._sections = np.append(section0, idx[self.at])
        self._span = np.diff(np.concatenate([[0], self.at, [len(raw)]]))
        self.chips = sorted(set(self.chips_at[self._span > 0].tolist()))
        self.last_chip, self.last_header = int(self.chips_at[-1]), int(self._sections[-1])

    @functools.cached_property
    def chip(self) -> np.ndarray:
        """Of each word."""
        return np.repeat(self.chips_at, self._span)

    @functools.cached_property
    def section(self) -> np.ndarray:
        """The packet_idx of each word's header."""
        return np.repeat(self._sections, self._span)

    def marks(self, chip: int) -> np.ndarray:
        return np.flatnonzero(self.tdc & (self.chip == chip))

    def hits(self, chip: int) -> np.ndarray:
        return np.flatnonzero(self.hit & (self.chip == chip))

    def tdc_time(self, at: np.ndarray) -> np.ndarray:
        return self.raw[at] >> 12 & 0x3FFFFFFF

    def hit_time(self, at: np.ndarray) -> np.ndarray:
        raw = self.raw[at]
        return (raw & 0xFFFF) << 14 | (raw >> 30 & 0x3FFF)


def summary(file: str, block: int, raw: np.ndarray, idx: np.ndarray) -> dict:
    """A row of SUMMARY."""
    b = Block(raw, idx)
    parts = []
    for chip in b.chips:
        m, h = b.marks(chip), b.hits(chip)
        t, s = b.tdc_time(m), b.hit_time(h)
        gaps = np.diff(np.searchsorted(h, m))
        parts.append({
            "chip": chip, "n_tdc": len(m), "first_tdc": int(t[0]) if len(t) else None, "last_tdc": int(t[-1]) if len(t) else None, "second_tdc": int(t[-2]) if len(t) > 1 else None,
            "turns": int((t[1:] < t[:-1]).sum()), "n_hits": len(h), "first_hit": int(s[0]) if len(s) else None, "last_hit": int(s[-1]) if len(s) else None, "back": int((s[1:] < s[:-1]).sum()),
            "hits_before": int(np.searchsorted(h, m[0])) if len(m) else len(h), "hits_after": len(h) - int(np.searchsorted(h, m[-1])) if len(m) else 0,
            "n_gaps": len(gaps), "gap_min": int(gaps.min()) if len(gaps) else None, "gap_max": int(gaps.max()) if len(gaps) else None, "first_tdcs": t[:FIRST].tolist(),
        })
    tail = lambda at, n, time: [[int(b.idx[k]), int(b.chip[k]), int(v)] for k, v in zip(at[-n:], time(at[-n:]).tolist(), strict=True)]
    return {
        "file": file, "block": block, "first": int(idx[0]) if len(idx) else 0, "count": len(idx), "last_chip": b.last_chip, "last_header": b.last_header, "parts": parts,
        "tdcs": tail(np.flatnonzero(b.tdc), TDC_TAIL, b.tdc_time), "hits": tail(np.flatnonzero(b.hit), HIT_TAIL, b.hit_time),
    }


@dataclass
class Pulse:
    """The last two markers of a chip; None where there is none."""

    n: int = 0
    tdc: int | None = None
    epoch: int = 0
    prev_tdc: int | None = None
    prev_epoch: int = 0

    def advance(self, part: dict) -> None:
        if not part["n_tdc"]:
            return
        start = self.epoch + (self.tdc is not None and part["first_tdc"] < self.tdc)
        last = start + part["turns"]
        if part["n_tdc"] > 1:
            self.prev_tdc, self.prev_epoch = part["second_tdc"], last - (part["last_tdc"] < part["second_tdc"])
        else:
            self.prev_tdc, self.prev_epoch = self.tdc, self.epoch
        self.n, self.tdc, self.epoch = self.n + part["n_tdc"], part["last_tdc"], last


@dataclass
class State:
    """What holds at the start of a block. tdcs, hits: the last ones of the file, as [packet_idx, chip, time]."""

    chip: int = NO_CHIP
    section: int = -1
    pulses: dict[int, Pulse] = field(default_factory=dict)
    tdcs: list = field(default_factory=list)
    hits: list = field(default_factory=list)

    def advance(self, row: dict) -> None:
        chip = self.chip
        for part in row["parts"]:
            own = chip if part["chip"] == NO_CHIP else part["chip"]
            if own != NO_CHIP:
                self.pulses.setdefault(own, Pulse()).advance(part)
        named = lambda rows: [[i, chip if c == NO_CHIP else c, t] for i, c, t in rows]
        self.tdcs = (self.tdcs + named(row["tdcs"]))[-TDC_TAIL:]
        self.hits = (self.hits + named(row["hits"]))[-HIT_TAIL:]
        if row["last_header"] >= 0:
            self.chip, self.section = row["last_chip"], row["last_header"]

    def dump(self) -> str:
        import json

        return json.dumps([self.chip, self.section, {c: [p.n, p.tdc, p.epoch, p.prev_tdc, p.prev_epoch] for c, p in self.pulses.items()}, self.tdcs, self.hits])

    @staticmethod
    def load(text: str) -> State:
        import json

        chip, section, pulses, tdcs, hits = json.loads(text)
        return State(chip, section, {int(c): Pulse(*p) for c, p in pulses.items()}, tdcs, hits)


def merged_parts(chip: int, row: dict) -> list[dict]:
    """The parts of a row, with the words before its first header under the chip that holds at its start."""
    out: dict[int, dict] = {}
    for part in sorted(row["parts"], key=lambda p: p["chip"]):
        own = part | {"chip": chip if part["chip"] == NO_CHIP else part["chip"]}
        out[own["chip"]] = follow(out[own["chip"]], own) if own["chip"] in out else own
    return list(out.values())


def follow(a: dict, b: dict) -> dict:
    """Two parts of a chip, one after the other, as one."""
    gaps = [g for p in (a, b) for g in (p["gap_min"], p["gap_max"]) if g is not None]
    between = a["hits_after"] + b["hits_before"] if a["n_tdc"] and b["n_tdc"] else None
    if between is not None:
        gaps.append(between)
    back = a["last_hit"] is not None and b["first_hit"] is not None and b["first_hit"] < a["last_hit"]
    turned = a["last_tdc"] is not None and b["first_tdc"] is not None and b["first_tdc"] < a["last_tdc"]
    pick = lambda x, y: y if x is None else x
    return {
        "chip": a["chip"], "n_tdc": a["n_tdc"] + b["n_tdc"], "first_tdc": pick(a["first_tdc"], b["first_tdc"]), "last_tdc": pick(b["last_tdc"], a["last_tdc"]),
        "second_tdc": b["second_tdc"] if b["n_tdc"] > 1 else a["last_tdc"] if b["n_tdc"] else a["second_tdc"], "turns": a["turns"] + b["turns"] + turned,
        "n_hits": a["n_hits"] + b["n_hits"], "first_hit": pick(a["first_hit"], b["first_hit"]), "last_hit": pick(b["last_hit"], a["last_hit"]), "back": a["back"] + b["back"] + back,
        "hits_before": a["hits_before"] + (b["hits_before"] if not a["n_tdc"] else 0), "hits_after": b["hits_after"] + (a["hits_after"] + b["n_hits"] if not b["n_tdc"] and a["n_tdc"] else 0),
        "n_gaps": a["n_gaps"] + b["n_gaps"] + (between is not None), "gap_min": min(gaps) if gaps else None, "gap_max": max(gaps) if gaps else None, "first_tdcs": (a["first_tdcs"] + b["first_tdcs"])[:FIRST],
    }


def prefix(rows: list[dict]) -> list[dict]:
    """Rows of STATE from a file's rows of SUMMARY."""
    state, out = State(), []
    for row in sorted(rows, key=lambda r: r["block"]):
        out.append({k: row[k] for k in ("file", "block", "first", "count")} | {"state": state.dump()})
        state.advance(row)
    return out


def totals(rows: list[dict]) -> list[dict]:
    """One part per chip over a whole file; words before the first header count for chip 0."""
    found: dict[int, dict] = {}
    chip = 0
    for row in sorted(rows, key=lambda r: r["block"]):
        for part in merged_parts(chip, row):
            found[part["chip"]] = follow(found[part["chip"]], part) if part["chip"] in found else part
        chip = row["last_chip"] if row["last_header"] >= 0 else chip
    return list(found.values())


def markers(b: Block, state: State) -> dict[str, np.ndarray]:
    """A row per time marker of chips that are known: its number, epoch and predecessor."""
    out = []
    for chip in b.chips:
        m = b.marks(chip)
        if chip == NO_CHIP or not len(m):
            continue
        p, t = state.pulses.get(chip, Pulse()), b.tdc_time(m)
        before = np.append(-1 if p.tdc is None else p.tdc, t[:-1])
        turned = (t < before).astype(np.int64)
        epoch = p.epoch + np.cumsum(turned)
        out.append({"chip_id": np.full(len(m), chip, np.int32), "packet_idx": b.idx[m], "tdc": t, "pulse_seq": p.n + 1 + np.arange(len(m)), "prev_tdc": before, "epoch": epoch, "prev_epoch": np.append(p.epoch, epoch[:-1])})
    return {k: np.concatenate([o[k] for o in out]) for k in out[0]} if out else {}


def hits(b: Block, state: State, period: int, late_hits: bool = True) -> dict[str, np.ndarray]:
    """A row per hit that has a pulse: its time, time of flight and the extended marker it belongs to.

    A hit that lies before its chip's current marker belongs to the previous pulse, if there is one. Between one header or
    marker and the next the chip and its markers stay the same, so they are worked out once per such stretch.
    """
    cut = np.flatnonzero(b.header | b.tdc)
    start = np.append(0, cut)
    chip = np.append(b.chips_at[0], b.chips_at[np.searchsorted(b.at, cut, "right")])
    is_mark = np.append(False, b.tdc[cut])
    now_tdc, now_ext, before_tdc, before_ext = (np.zeros(len(start), np.int64) for _ in range(4))
    known, had = np.zeros(len(start), bool), np.zeros(len(start), bool)
    for c in np.unique(chip).tolist():
        if c == NO_CHIP:
            continue
        own, p = np.flatnonzero(chip == c), state.pulses.get(c, Pulse())
        m = own[is_mark[own]]
        t = np.append([p.prev_tdc or 0, p.tdc or 0], b.tdc_time(start[m])).astype(np.int64)
        valid = np.append([p.prev_tdc is not None, p.tdc is not None], np.ones(len(m), bool)).astype(bool)
        turned = (t[2:] < t[1:-1]) & valid[1:-1]
        ext = np.append([p.prev_epoch, p.epoch], p.epoch + np.cumsum(turned)).astype(np.int64) << 30 | t
        k = np.cumsum(is_mark[own])
        now_tdc[own], now_ext[own], known[own] = t[k + 1], ext[k + 1], valid[k + 1]
        before_tdc[own], before_ext[own], had[own] = t[k], ext[k], valid[k]
    h = np.flatnonzero(b.hit)
    count = np.diff(np.append(np.searchsorted(h, start), len(h)))
    if not known.all():
        h = h[np.repeat(known, count)]
        count = np.where(known, count, 0)
    if not len(h):
        return {}
    raw, tdc = b.raw[h], np.repeat(now_tdc, count)
    seen = (raw & 0xFFFF) << 14 | (raw >> 30 & 0x3FFF)
    time, ext = corrected(seen, tdc), np.repeat(now_ext, count)
    late = time < tdc
    late &= np.repeat(had, count) if late_hits else False
    at = np.flatnonzero(late)
    if len(at):
        stretch = np.searchsorted(np.cumsum(count), at, "right")
        tdc[at], ext[at] = before_tdc[stretch], before_ext[stretch]
        time[at] = corrected(seen[at], tdc[at])
    return {"chip_id": np.repeat(chip.astype(np.int32), count), "packet_idx": b.idx[h], "raw": raw, "ext_tdc": ext, "timestamp": time, "tof": flight(time, tdc, period), "late": late}


def jumps(b: Block, state: State, jump: int) -> list[dict]:
    """Steps back of more than `jump` ticks from one marker, or hit, of the file to the next, with what came just before."""
    at = {"tdc": np.flatnonzero(b.tdc), "hit": np.flatnonzero(b.hit)}
    time = {"tdc": b.tdc_time(at["tdc"]), "hit": b.hit_time(at["hit"])}
    past = {"tdc": state.tdcs, "hit": state.hits}
    out = []
    for kind in ("tdc", "hit"):
        before = past[kind][-1][2] if past[kind] else -1
        previous = np.append(before, time[kind])[:-1] if len(at[kind]) else np.empty(0, np.int64)
        for k in np.flatnonzero(previous - time[kind] > jump).tolist():
            here = int(at[kind][k])
            row = {"packet_idx": int(b.idx[here]), "chip_id": int(b.chip[here]), "kind": kind, "previous": int(previous[k]), "timestamp": int(time[kind][k])}
            for name, n in (("tdc", TDC_TAIL), ("hit", HIT_TAIL)):
                end = int(np.searchsorted(at[name], here))
                own = [[int(b.idx[j]), int(b.chip[j]), int(t)] for j, t in zip(at[name][max(0, end - n) : end].tolist(), time[name][max(0, end - n) : end].tolist(), strict=True)]
                row[f"{name}s"] = (past[name] + own)[-n:]
            out.append(row)
    return out
