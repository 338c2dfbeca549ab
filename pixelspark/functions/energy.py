"""Time of flight, neutron energy and display axes as column expressions.

Two conversions exist on purpose: the viewer's subtracts the offset and has no value for impossible times; the file
format's adds it and writes 0 for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The neutron's mass in kg, as the viewer and as the file format have it, and a joule in eV.
MASS_VIEW, MASS_FILE, EV = 1.674927498e-27, 1.67492749804e-27, 1.602176634e-19


def energy_view(tof_us: Column, path_m: float, offset_ns: float = 0.0) -> Column:
    t = tof_us - offset_ns / 1000.0
    speed = path_m / (t * 1e-6)
    return F.when((t > 0) & F.lit(path_m > 0), 0.5 * MASS_VIEW * speed * speed / EV)


def tof_view(energy_ev: Column, path_m: float, offset_ns: float = 0.0) -> Column:
    """The inverse, in microseconds."""
    speed = F.sqrt(2.0 * energy_ev * EV / MASS_VIEW)
    return F.when((energy_ev > 0) & F.lit(path_m > 0), path_m / speed * 1e6 + offset_ns / 1000.0)


def energy_file(tof_ns: Column, path_m: float, offset_ns: float) -> Column:
    t = (tof_ns + offset_ns) * 1e-9
    speed = path_m / t
    return F.when(t > 0, 0.5 * MASS_FILE * speed * speed / EV).otherwise(0.0)


def tof_bin(tof: Column, tof_max: int, n_bins: int) -> Column:
    """Bin of a time; a width of 0 gives bin 0, what lies beyond the end the last bin."""
    width = tof_max / n_bins
    return (F.least(F.floor(tof / F.lit(width)), F.lit(n_bins - 1)) if width > 0 else F.lit(0)).cast("int")


def log_count(count: Column) -> Column:
    return F.log10(F.greatest(count, F.lit(1)).cast("double"))


def shade(count: Column, largest: Column, log: bool = False) -> Column:
    """0 to 1, for a colour map."""
    if log:
        return F.when(largest > 0, F.log10(count + F.lit(1.0)) / F.log10(largest + F.lit(1.0))).otherwise(0.0)
    return F.when(largest > 0, F.sqrt(count / largest.cast("double"))).otherwise(0.0)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def file_name_part(name: Column) -> Column:
    """A base name of letters, digits, - and _ only."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), "[^A-Za-z0-9_-]", "_"), "^_+|_+$", "")
