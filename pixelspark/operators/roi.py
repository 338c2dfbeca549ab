"""View transforms, regions of interest and their spectra."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelspark.config import ConfigError
from pixelspark.operators.cube import pixel_grid, spectrum, unmasked


@dataclass(frozen=True)
class View:
    """Four rotations (quarter turns clockwise) and two flips of the displayed image."""

    turns: int = 0
    flip_h: bool = False
    flip_v: bool = False

    def clockwise(self) -> View:
        return replace(self, turns=(self.turns + 1) % 4)

    def counterclockwise(self) -> View:
        return replace(self, turns=(self.turns + 3) % 4)

    def mirrored(self, horizontally: bool) -> View:
        return replace(self, flip_h=not self.flip_h) if horizontally else replace(self, flip_v=not self.flip_v)

    def display_size(self, width: int, height: int) -> tuple[int, int]:
        return (height, width) if self.turns % 2 else (width, height)

    def source_pixel(self, x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
        """The data pixel under a display pixel; null outside."""
        w, h = self.display_size(width, height)
        inside = x.between(0, w - 1) & y.between(0, h - 1)
        x = w - 1 - x if self.flip_h else x
        y = h - 1 - y if self.flip_v else y
        sx, sy = ((x, y), (y, height - 1 - x), (width - 1 - x, height - 1 - y), (width - 1 - y, x))[self.turns]
        return F.when(inside, sx), F.when(inside, sy)

    def place(self, x, y, width, height):
        """Display coordinates of data coordinates (numbers or columns)."""
        ox, oy = ((x, y), (height - y, x), (width - x, height - y), (y, width - x))[self.turns]
        w, h = self.display_size(width, height)
        return (w - ox if self.flip_h else ox), (h - oy if self.flip_v else oy)

    def unplace(self, x, y, width, height):
        w, h = self.display_size(width, height)
        x = w - x if self.flip_h else x
        y = h - y if self.flip_v else y
        return ((x, y), (y, height - x), (width - x, height - y), (width - y, x))[self.turns]


def crosses_itself(points: list[tuple[float, float]]) -> bool:
    """Whether two edges of a closed polygon that share no corner meet."""
    n = len(points)

    def side(p, q, r) -> float:
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def between(p, q, r) -> bool:
        return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    for i in range(n):
        a, b = points[i], points[(i + 1) % n]
        for j in range(i + 1, n):
            if j == i or (j + 1) % n == i or (i + 1) % n == j:
                continue
            c, d = points[j], points[(j + 1) % n]
            s = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
            if s[0] * s[1] < 0 and s[2] * s[3] < 0:
                return True
            if any(v == 0 and between(*e) for v, e in zip(s, ((a, b, c), (a, b, d), (c, d, a), (c, d, b)), strict=True)):
                return True
    return False


#: Fixed value: the distance from 1 to the next double.
EPSILON = 2.0**-52


@dataclass(frozen=True)
class Roi:
    """A rectangle (two corners) or a polygon, in display coordinates."""

    roi_id: int
    name: str
    vertices: tuple[tuple[float, float], ...]
    visible: bool = True

    @classmethod
    def rectangle(cls, roi_id: int, name: str, x1: float, y1: float, x2: float, y2: float, least: float = 0.0) -> Roi | None:
        """None if a side is not above the least size."""
        if abs(x2 - x1) <= least or abs(y2 - y1) <= least:
            return None
        return cls(roi_id, name, ((min(x1, x2), min(y1, y2)), (max(x1, x2), max(y1, y2))))

    @classmethod
    def polygon(cls, roi_id: int, name: str, points: list[tuple[float, float]]) -> Roi:
        if len(points) < 3:
            raise ConfigError("a polygon needs three corners")
        if crosses_itself(points):
            raise ConfigError("the polygon crosses itself")
        return cls(roi_id, name, tuple(points))

    @property
    def is_rectangle(self) -> bool:
        return len(self.vertices) == 2

    @property
    def area(self) -> float:
        if self.is_rectangle:
            (x1, y1), (x2, y2) = self.vertices
            return abs((x2 - x1) * (y2 - y1))
        edges = zip(self.vertices, self.vertices[1:] + self.vertices[:1], strict=True)
        return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in edges)) / 2

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = [x for x, _ in self.vertices], [y for _, y in self.vertices]
        return min(xs), min(ys), max(xs), max(ys)

    def moved(self, dx: float, dy: float, width: float, height: float) -> Roi:
        """Moved as far as the image allows."""
        x1, y1, x2, y2 = self.bounds
        dx, dy = max(-x1, min(dx, width - x2)), max(-y1, min(dy, height - y2))
        return replace(self, vertices=tuple((x + dx, y + dy) for x, y in self.vertices))

    def resized(self, dx: float, dy: float, edges: str, least: float, low: float, high: float) -> Roi:
        """A rectangle with some of its edges (of "left", "right", "bottom", "top", as words) moved, no smaller than `least` and
        brought within low and high."""
        (x1, y1), (x2, y2) = self.vertices
        moved = set(edges.split())
        x1 = min(x1 + dx, x2 - least) if "left" in moved else x1
        x2 = max(x2 + dx, x1 + least) if "right" in moved else x2
        y1 = min(y1 + dy, y2 - least) if "bottom" in moved else y1
        y2 = max(y2 + dy, y1 + least) if "top" in moved else y2
        return replace(self, vertices=tuple((max(low, min(high, x)), max(low, min(high, y))) for x, y in ((x1, y1), (x2, y2))))

    def renamed(self, name: str) -> Roi:
        """A blank name leaves the old one."""
        return replace(self, name=name.strip() or self.name)

    def shown(self, visible: bool) -> Roi:
        return replace(self, visible=visible)

    def shape(self) -> tuple:
        """What a spectrum over the region depends on."""
        return "rectangle" if self.is_rectangle else "polygon", self.vertices

    def with_vertex(self, k: int, point: tuple[float, float]) -> Roi:
        v = list(self.vertices)
        v[k] = point
        return replace(self, vertices=tuple(v))

    def inserted(self, k: int, point: tuple[float, float]) -> Roi:
        return replace(self, vertices=(*self.vertices[:k], point, *self.vertices[k:]))

    def without_vertex(self, k: int) -> Roi:
        return self if len(self.vertices) <= 3 else replace(self, vertices=self.vertices[:k] + self.vertices[k + 1 :])

    def remapped(self, old: View, new: View, width: float, height: float) -> Roi:
        points = [new.place(*old.unplace(x, y, width, height), width, height) for x, y in self.vertices]
        if self.is_rectangle:
            (x1, y1), (x2, y2) = points
            points = [(min(x1, x2), min(y1, y2)), (max(x1, x2), max(y1, y2))]
        return replace(self, vertices=tuple(points))

    def contains(self, x: Column, y: Column) -> Column:
        """Closed for rectangles; even-odd for polygons."""
        if self.is_rectangle:
            (x1, y1), (x2, y2) = self.vertices
            return x.between(x1, x2) & y.between(y1, y2)
        return in_polygon(x, y, self.vertices)


def in_polygon(x: Column, y: Column, vertices: tuple[tuple[float, float], ...], nudge: float = 0.0) -> Column:
    """Even-odd. nudge: added to each edge's height, as picking by hand does (EPSILON); 0 for counting."""
    inside = F.lit(False)
    for (xi, yi), (xj, yj) in zip(vertices, vertices[-1:] + vertices[:-1], strict=True):
        if yi == yj:
            continue  # a level edge is never crossed
        hit = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < (xj - xi) * (y - yi) / (yj - yi + nudge) + xi)
        inside = inside != hit
    return inside


def distance_to_edge(p: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> float:
    """From a point to the nearest point of a segment."""
    length = math.dist(a, b) ** 2
    t = 0.0 if length == 0 else max(0.0, min(1.0, sum((p[k] - a[k]) * (b[k] - a[k]) for k in (0, 1)) / length))
    return math.dist(p, [a[k] + t * (b[k] - a[k]) for k in (0, 1)])


def is_convex(points: tuple[tuple[float, float], ...]) -> bool:
    """Whether all bends of a closed polygon go the same way."""
    bends = set()
    for k, (x, y) in enumerate(points):
        (px, py), (nx, ny) = points[k - 1], points[(k + 1) % len(points)]
        bend = (x - px) * (ny - y) - (y - py) * (nx - x)
        if bend:
            bends.add(bend > 0)
    return len(bends) < 2


def _span(a: float, b: float, limit: int) -> tuple[int, int]:
    clamp = lambda v: int(max(0, min(limit, v)))
    return clamp(math.floor(min(a, b))), clamp(math.ceil(max(a, b)))


def roi_pixels(spark, roi: Roi, width: int, height: int, view: View | None = None) -> DataFrame:
    """The data pixels of a region: those of the display span of its bounds, for a polygon if their centre is inside."""
    view = view or View()
    w, h = view.display_size(width, height)
    x1, y1, x2, y2 = roi.bounds
    (xs, xe), (ys, ye) = _span(x1, x2, w), _span(y1, y2, h)
    grid = pixel_grid(spark, w, h).where((F.col("x") >= xs) & (F.col("x") < xe) & (F.col("y") >= ys) & (F.col("y") < ye))
    if not roi.is_rectangle:
        grid = grid.where(in_polygon(F.col("x") + 0.5, F.col("y") + 0.5, roi.vertices))
    sx, sy = view.source_pixel(F.col("x"), F.col("y"), width, height)
    return grid.select(sx.cast("int").alias("x"), sy.cast("int").alias("y")).where("x is not null and y is not null")


def roi_spectrum(cube: DataFrame, roi: Roi, n_bins: int, width: int, height: int, view: View | None = None, masks: DataFrame | None = None) -> DataFrame:
    """tof_bin, count over a region. The pixel list is bounded by the detector's size."""
    own = cube if masks is None else unmasked(cube, masks)
    pixels = roi_pixels(cube.sparkSession, roi, width, height, view)
    return spectrum(own.join(F.broadcast(pixels), ["x", "y"], "left_semi"), n_bins)


def topmost(rois: list[Roi], x: Column, y: Column) -> Column:
    """The id of the last drawn visible region that holds a point; null if none."""
    found = F.lit(None).cast("int")
    for r in rois:
        if r.visible:
            found = F.when(r.contains(x, y), r.roi_id).otherwise(found)
    return found


def picked(rois: list[Roi], x: float, y: float) -> int | None:
    """topmost() for one point of the display, with the nudge of picking by hand."""

    def inside(r: Roi) -> bool:
        if r.is_rectangle:
            (x1, y1), (x2, y2) = r.vertices
            return x1 <= x <= x2 and y1 <= y <= y2
        found = False
        for (xi, yi), (xj, yj) in zip(r.vertices, r.vertices[-1:] + r.vertices[:-1], strict=True):
            found ^= ((yi > y) != (yj > y)) and x < (xj - xi) * (y - yi) / (yj - yi + EPSILON) + xi
        return found

    return next((r.roi_id for r in reversed(rois) if r.visible and inside(r)), None)


@dataclass(frozen=True)
class Regions:
    """Regions in drawing order. Numbers are not given twice."""

    rois: tuple[Roi, ...] = ()
    next_id: int = 1

    def added(self, make) -> Regions:
        """make(number) -> a region, or None for one that is too small."""
        roi = make(self.next_id)
        return self if roi is None else Regions((*self.rois, roi), self.next_id + 1)

    def changed(self, roi_id: int, change) -> Regions:
        return replace(self, rois=tuple(change(r) if r.roi_id == roi_id else r for r in self.rois))

    def without(self, roi_id: int) -> Regions:
        return replace(self, rois=tuple(r for r in self.rois if r.roi_id != roi_id))
