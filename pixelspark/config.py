"""Configuration: detector, clustering, extraction and memory settings, with JSON, validation and derived scalars."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

TICK_NS = 25.0
BYTES_PER_HIT, OVERHEAD = 19, 1.2
U16, U32 = 0xFFFF, 0xFFFFFFFF


class PixelError(Exception):
    """Base of the engine's errors."""


class ClusteringError(PixelError):
    pass


class ExtractionError(PixelError):
    pass


class DataError(PixelError):
    """Unreadable input or output."""


class ConfigError(PixelError, ValueError):
    pass


@dataclass(frozen=True)
class ChipTransform:
    """x' = a x + b y + tx, y' = c x + d y + ty."""

    a: int = 1
    b: int = 0
    c: int = 0
    d: int = 1
    tx: int = 0
    ty: int = 0

    def apply(self, x: int, y: int) -> tuple[int, int]:
        return self.a * x + self.b * y + self.tx, self.c * x + self.d * y + self.ty

    def corners(self, width: int, height: int) -> list[tuple[int, int]]:
        return [self.apply(x, y) for x in (0, width - 1) for y in (0, height - 1)]

    def check(self, width: int, height: int) -> None:
        for x, y in self.corners(width, height):
            if not (0 <= x <= U16 and 0 <= y <= U16):
                raise ConfigError(f"out-of-bounds transform: a corner becomes ({x}, {y})")


#: Chip number, then a, b, c, d, tx, ty.
DEFAULT_TRANSFORMS = (
    ChipTransform(1, 0, 0, 1, 258, 0),
    ChipTransform(-1, 0, 0, -1, 513, 513),
    ChipTransform(-1, 0, 0, -1, 255, 513),
    ChipTransform(1, 0, 0, 1, 0, 0),
)


@dataclass(frozen=True)
class DetectorConfig:
    tdc_frequency_hz: float = 60.0
    enable_missing_tdc_correction: bool = True
    chip_size_x: int = 256
    chip_size_y: int = 256
    chip_transformations: tuple[ChipTransform, ...] = DEFAULT_TRANSFORMS

    @classmethod
    def venus_defaults(cls) -> DetectorConfig:
        return cls()

    @classmethod
    def from_json(cls, text: str) -> DetectorConfig:
        """The root needs a detector key; what is missing below has its default. No transforms at all stay none."""
        try:
            root = json.loads(text)["detector"]
        except (ValueError, KeyError, TypeError) as e:
            raise ConfigError(f"not a detector configuration: {e}") from e
        timing, chips = root.get("timing", {}), root.get("chip_layout", {})
        found = cls(
            tdc_frequency_hz=float(timing.get("tdc_frequency_hz", 60.0)),
            enable_missing_tdc_correction=bool(timing.get("enable_missing_tdc_correction", True)),
            chip_size_x=int(chips.get("chip_size_x", 256)),
            chip_size_y=int(chips.get("chip_size_y", 256)),
        )
        listed = root.get("chip_transformations")
        if listed is not None:
            by_chip = {int(t["chip_id"]): ChipTransform(*(int(row[k]) for row in t["matrix"] for k in (0, 1)), *(int(row[2]) for row in t["matrix"])) for t in listed}
            filled = tuple(by_chip.get(k, ChipTransform()) for k in range(max(by_chip, default=-1) + 1))
            found = replace(found, chip_transformations=filled)
        return found.validate()

    @classmethod
    def from_file(cls, path: str) -> DetectorConfig:
        return cls.from_json(Path(path).read_text())

    def validate(self) -> DetectorConfig:
        if not (math.isfinite(self.tdc_frequency_hz) and self.tdc_frequency_hz > 0):
            raise ConfigError("tdc_frequency_hz must be above 0")
        for t in self.chip_transformations:
            t.check(self.chip_size_x, self.chip_size_y)
        return self

    def to_json(self) -> str:
        return json.dumps({"detector": {
            "timing": {"tdc_frequency_hz": self.tdc_frequency_hz, "enable_missing_tdc_correction": self.enable_missing_tdc_correction},
            "chip_layout": {"chip_size_x": self.chip_size_x, "chip_size_y": self.chip_size_y},
            "chip_transformations": [{"chip_id": k, "matrix": [[t.a, t.b, t.tx], [t.c, t.d, t.ty]]} for k, t in enumerate(self.chip_transformations)],
        }}, indent=2)

    def to_file(self, path: str) -> None:
        Path(path).write_text(self.to_json())

    to_dict = asdict

    @property
    def period_seconds(self) -> float:
        return 1 / self.tdc_frequency_hz

    @property
    def period_ticks(self) -> int:
        return round(self.period_seconds / (TICK_NS * 1e-9))

    @property
    def size(self) -> tuple[int, int]:
        """Width and height of the detector, from the transformed chip corners."""
        if not self.chip_transformations:
            return self.chip_size_x, self.chip_size_y
        corners = [c for t in self.chip_transformations for c in t.corners(self.chip_size_x, self.chip_size_y)]
        return max(x for x, _ in corners) + 1, max(y for _, y in corners) + 1


@dataclass(frozen=True)
class ClusteringConfig:
    radius: float = 5.0
    temporal_window_ns: float = 75.0
    min_cluster_size: int = 1
    max_cluster_size: int | None = None  # off unless given

    venus_defaults = classmethod(lambda cls: cls())
    to_dict = asdict

    @property
    def window_ticks(self) -> int:
        return max(0, min(U32, math.ceil(self.temporal_window_ns / TICK_NS)))


@dataclass(frozen=True)
class ExtractionConfig:
    super_resolution_factor: float = 8.0
    weighted_by_tot: bool = True
    min_tot_threshold: int = 10

    venus_defaults = classmethod(lambda cls: cls())
    to_dict = asdict


@dataclass(frozen=True)
class AlgorithmParams:
    abs_scan_interval: int = 100
    dbscan_min_points: int = 2
    grid_cell_size: int = 32

    def __post_init__(self):
        if self.abs_scan_interval < 1:
            raise ConfigError("abs_scan_interval must be at least 1")
        if self.grid_cell_size < 1:
            raise ConfigError("grid_cell_size must be at least 1")


@dataclass(frozen=True)
class OutOfCoreConfig:
    """Bounds on what one slice may hold. Spark schedules and spills; only the slice size has an effect here."""

    memory_fraction: float = 0.5
    memory_budget_bytes: int | None = None
    parallelism: int | None = None
    queue_depth: int | None = None
    async_io: bool = False
    available_bytes: int = field(default=8 << 30)

    def __post_init__(self):
        if self.parallelism is not None and self.parallelism < 1:
            raise ConfigError("parallelism must be at least 1")
        if self.queue_depth is not None and self.queue_depth < 1:
            raise ConfigError("queue_depth must be at least 1")

    def with_memory_fraction(self, fraction: float) -> OutOfCoreConfig:
        return replace(self, memory_fraction=fraction)

    def with_memory_budget_bytes(self, size: int) -> OutOfCoreConfig:
        return replace(self, memory_budget_bytes=size)

    def with_parallelism(self, n: int) -> OutOfCoreConfig:
        return replace(self, parallelism=n)

    def with_queue_depth(self, n: int) -> OutOfCoreConfig:
        return replace(self, queue_depth=n)

    def with_async_io(self, on: bool) -> OutOfCoreConfig:
        return replace(self, async_io=on)

    @property
    def budget_bytes(self) -> int:
        if self.memory_budget_bytes is not None:
            if self.memory_budget_bytes < 1:
                raise ConfigError("memory_budget_bytes must be above 0")
            return self.memory_budget_bytes
        if not 0 < self.memory_fraction <= 1:
            raise ConfigError("memory_fraction must be in (0, 1]")
        return int(self.available_bytes * self.memory_fraction)

    @property
    def max_records_per_slice(self) -> int:
        return max(1, self.budget_bytes // math.ceil(BYTES_PER_HIT * OVERHEAD))


ALGORITHMS = ("abs", "dbscan", "grid")


def algorithm(name: str) -> str:
    if name.lower() not in ALGORITHMS:
        raise ConfigError(f"unknown algorithm {name!r}; one of {', '.join(ALGORITHMS)}")
    return name.lower()
