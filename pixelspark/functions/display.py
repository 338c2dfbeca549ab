"""What a viewer needs besides data: ranges, bounds, colours and numbers as text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelspark.config import ConfigError

Range = tuple[float, float]


def typed_range(low: str, high: str) -> Range | None:
    """A range typed in two fields: none if both are blank, an error if one is no number or they don't ascend."""
    texts = low.strip(), high.strip()
    if texts == ("", ""):
        return None
    try:
        a, b = map(float, texts)
    except ValueError as e:
        raise ConfigError(f"no range: {low!r} to {high!r}") from e
    if not a < b:
        raise ConfigError("a range must ascend")
    return a, b


def plot_bounds(x: Range, y_max: float, x_typed: Range | None = None, y_typed: Range | None = None, log_x: bool = False, log_y: bool = False) -> tuple[Range, Range]:
    """Bounds of a spectrum plot: some room above, a unit where there is no extent, and typed ranges (in data units) first."""

    def own(typed: Range | None, log: bool) -> Range | None:
        if typed is None or typed[0] >= typed[1] or log and typed[0] <= 0:
            return None
        return tuple(math.log10(v) for v in typed) if log else typed

    flat = not all(map(math.isfinite, x)) or abs(x[1] - x[0]) <= 2.0**-52
    return own(x_typed, log_x) or ((0.0, 1.0) if flat else x), own(y_typed, log_y) or (0.0, y_max * 1.05 if y_max > 0 else 1.0)


def bin_at(position_ms: Column, max_ms: float, n_bins: int) -> Column:
    """The time bin under a position on the axis, held inside the axis."""
    return F.greatest(F.lit(0), F.least(F.floor(position_ms / (max_ms / n_bins)), F.lit(n_bins - 1))).cast("int")


def colour(shade: Column, kind: str = "grey") -> Column:
    """array [red, green, blue] of a shade from 0 to 1: grey, green, hot or viridis (nearly)."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), shade))
    zero, one = F.lit(0.0), F.lit(1.0)
    parts = {
        "grey": (v, v, v),
        "green": (zero, v, zero),
        "hot": (one, F.least(one, 2 * v), F.greatest(zero, 2 * v - 1)),
        "viridis": (v * v, v, 1 - v),
    }
    if kind not in parts:
        raise ConfigError(f"unknown colours {kind!r}")
    return F.array(*(F.floor(c * 255).cast("int") for c in parts[kind]))


def _scaled(n: float, units: list[tuple[float, str]], plain: str) -> str:
    for size, form in units:
        if n >= size:
            return form.format(n / size)
    return plain.format(n)


def si(n: int) -> str:
    return _scaled(n, [(1e9, "{:.2f}G"), (1e6, "{:.2f}M"), (1e3, "{:.1f}K")], "{}")


def size_text(n: int) -> str:
    return _scaled(n, [(2**40, "{:.2f} TB"), (2**30, "{:.2f} GB"), (2**20, "{:.1f} MB"), (2**10, "{:.1f} KB")], "{} B")
