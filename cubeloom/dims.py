"""Dimension tables: regular, rectilinear and discrete axes, kept on the driver."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import math
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plans import interval_of, literal_array

#: Relative spread of steps up to which an axis counts as regular.
REGULAR = 1e-4


def _number(v: Any) -> float | None:
    if isinstance(v, bool):
        return None
    if isinstance(v, int | float):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.timestamp()
    return float(v.toordinal()) if isinstance(v, dt.date) else None


@dataclass(frozen=True)
class Dim:
    """One axis of n cells: ``offset`` and ``delta`` if regular, else ``values`` (with ``ends`` if they are intervals).

    ``first`` is the place of cell 1 in the grid that offset counts from, so a window keeps its grid.
    """

    name: str
    n: int
    offset: Any = None
    delta: Any = None
    values: tuple | None = None
    ends: tuple | None = None
    first: int = 1
    point: bool | None = None
    refsys: str | None = None

    @staticmethod
    def of(name: str, values: list, point: bool | None = None, refsys: str | None = None, cells: int | None = None) -> Dim:
        """An axis from its values; one value more than ``cells`` makes intervals."""
        values = list(values)
        numbers = [_number(v) for v in values]
        if any(x is not None and not math.isfinite(x) for x in numbers):
            raise ValueError(f"dimension {name}: non-finite values")
        if cells is not None and len(values) == cells + 1:
            whole = Dim.of(name, values)
            if whole.delta is not None:
                return replace(whole, n=cells, point=False, refsys=refsys)
            return Dim(name, cells, values=tuple(values[:-1]), ends=tuple(values[1:]), point=False, refsys=refsys)
        if cells is not None and len(values) != cells:
            raise ValueError(f"dimension {name}: {len(values)} values for {cells} cells")
        if len(values) == 1 and numbers[0] is not None:
            return Dim(name, 1, offset=values[0], point=point, refsys=refsys)
        if len(values) > 1 and None not in numbers:
            steps = [b - a for a, b in zip(numbers, numbers[1:], strict=False)]
            mean = sum(steps) / len(steps)
            if mean and (max(steps) - min(steps)) / abs(mean) < REGULAR:
                delta = (values[-1] - values[0]) / (len(values) - 1) if not isinstance(values[0], int) else mean
                return Dim(name, len(values), offset=values[0], delta=delta, point=point, refsys=refsys)
        return Dim(name, len(values), values=tuple(values), point=point, refsys=refsys)

    @property
    def regular(self) -> bool:
        return self.values is None and self.delta is not None

    @property
    def kind(self) -> str:
        return "regular" if self.values is None else "rectilinear" if _number(self.values[0]) is not None else "discrete"

    def at(self, i: int, where: float = 0.0) -> Any:
        """Coordinate of cell i (1-based): its start, centre (0.5) or end (1)."""
        if self.values is not None:
            v = self.values[i - 1]
            return v + where * (self.ends[i - 1] - v) if self.ends and where else v
        if self.offset is None:
            return self.first - 1 + i
        return self.offset if self.delta is None else self.offset + (self.first - 2 + i + where) * self.delta

    def coords(self, where: float = 0.0) -> list:
        return [self.at(i, where) for i in range(1, self.n + 1)]

    def coord(self, index: Column, where: float = 0.0) -> Column:
        """Coordinate of an index column, as an expression."""
        if self.values is None:
            if self.offset is None:
                return index + (self.first - 1)
            if self.delta is None:
                return F.lit(self.offset)
            step = index + F.lit(self.first - 2 + where)
            if isinstance(self.offset, dt.datetime):
                return F.timestamp_micros((F.lit(round(self.offset.replace(tzinfo=dt.UTC).timestamp() * 1e6)) + step * round(self.delta.total_seconds() * 1e6)).cast("long"))
            if isinstance(self.offset, dt.date):
                return F.date_add(F.lit(self.offset), (step * self.delta.days).cast("int"))
            return F.lit(self.offset) + step * F.lit(self.delta)
        return F.element_at(literal_array(self.coords(where)), index.cast("int"))

    def index(self, value: Column) -> Column:
        """Index of the cell that holds a coordinate, null outside: arithmetic on a regular axis, a lookup else."""
        if self.regular and _number(self.delta) is not None:
            i = F.floor((value - F.lit(self.offset)) / F.lit(self.delta)) + 2 - self.first
        elif self.ends:
            up = _number(self.ends[0]) > _number(self.values[0])
            i = interval_of(value, [*self.values, self.ends[-1]]) if up else self.n + 1 - interval_of(value, [self.ends[-1], *reversed(self.values)])
        else:
            i = F.array_position(literal_array(self.coords()), value)
            i = F.when(i > 0, i)
        return F.when((i >= 1) & (i <= self.n), i).cast("int")

    def take(self, keep: list[int]) -> Dim:
        """The axis of some cells (1-based): a contiguous ascending window stays on its grid, anything else lists its values."""
        if keep and keep == list(range(keep[0], keep[0] + len(keep))):
            if self.values is None:
                return replace(self, n=len(keep), first=self.first + keep[0] - 1)
            cut = slice(keep[0] - 1, keep[0] - 1 + len(keep))
            return replace(self, n=len(keep), values=self.values[cut], ends=self.ends and self.ends[cut])
        ends = self.ends or (self.regular and self.point is not True and _number(self.offset) is not None)
        return replace(self, n=len(keep), values=tuple(self.at(i) for i in keep), ends=tuple(self.at(i, 1.0) for i in keep) if ends else None, offset=None, delta=None, first=1)

    def bounds(self) -> tuple:
        a, b = self.at(1), self.at(self.n, 1.0)
        return (a, b) if a <= b else (b, a)


@dataclass(frozen=True)
class Dimensions:
    """Axes in order, the pair that is the raster, and its shear."""

    dims: tuple[Dim, ...]
    xy: tuple[str, str] | None = None
    affine: tuple[float, float] = (0.0, 0.0)
    crs: str | None = None
    extra: dict = field(default_factory=dict)

    def __getitem__(self, name: str | int) -> Dim:
        return self.dims[name - 1] if isinstance(name, int) else next(d for d in self.dims if d.name == name)

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dims]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(d.n for d in self.dims)

    def put(self, *new: Dim) -> Dimensions:
        by = {d.name: d for d in new}
        return replace(self, dims=tuple(by.get(d.name, d) for d in self.dims))

    def only(self, names: list[str]) -> Dimensions:
        xy = self.xy if self.xy and set(self.xy) <= set(names) else None
        return replace(self, dims=tuple(self[n] for n in names), xy=xy)

    def bbox(self) -> tuple:
        """xmin, ymin, xmax, ymax from the four corners."""
        x, y = (self[n] for n in self.xy)
        if self.affine == (0.0, 0.0):
            return x.bounds()[0], y.bounds()[0], x.bounds()[1], y.bounds()[1]
        c = [self.affine_xy(i, j) for i in (0, x.n) for j in (0, y.n)]
        return min(p[0] for p in c), min(p[1] for p in c), max(p[0] for p in c), max(p[1] for p in c)

    def with_bbox(self, bbox: tuple[float, float, float, float]) -> Dimensions:
        """The same cells over another box; steps keep their signs.  Axes must be regular and whole."""
        new = []
        for n, low, high in zip(self.xy, bbox[:2], bbox[2:], strict=True):
            d = self[n]
            if not d.regular or d.first != 1 or self.affine != (0.0, 0.0):
                raise ValueError(f"dimension {n}: not a regular axis from its first cell")
            step = (high - low) / d.n
            new.append(replace(d, offset=low, delta=step) if d.delta > 0 else replace(d, offset=high, delta=-step))
        return self.put(*new)

    def geotransform(self) -> tuple[float, ...]:
        x, y = (self[n] for n in self.xy)
        return x.offset, x.delta, self.affine[0], y.offset, self.affine[1], y.delta

    def resolution(self, every: bool = False, absolute: bool = True) -> dict[str, Any]:
        """Steps of the raster's axes (or of ``every`` axis); None where an axis is not regular."""
        out = {}
        for d in self.dims:
            if every or d.name in (self.xy or ()):
                step = d.delta if d.regular else None
                out[d.name] = abs(step) if absolute and step is not None else step
        return out

    def affine_xy(self, col, row):
        g = self.geotransform()
        x, y = (self[n] for n in self.xy)
        col, row = col + x.first - 1, row + y.first - 1
        return g[0] + col * g[1] + row * g[2], g[3] + col * g[4] + row * g[5]

    def raster_type(self) -> str | None:
        if not self.xy:
            return None
        if self.affine != (0.0, 0.0):
            return "affine"
        kinds = {self[n].kind for n in self.xy}
        return "regular" if kinds == {"regular"} else "rectilinear"

    def same(self, other: Dimensions, tolerance: float = 1e-9) -> bool:
        def equal(a, b):
            x, y = _number(a), _number(b)
            return a == b if x is None or y is None else abs(x - y) <= tolerance * max(1.0, abs(x))

        return self.names == other.names and self.shape == other.shape and all(all(map(equal, a.coords(), b.coords())) for a, b in zip(self.dims, other.dims, strict=True))

    def to_json(self) -> str:
        def plain(v):
            return {"date": v.isoformat()} if isinstance(v, dt.date) else {"days": v.total_seconds() / 86400} if isinstance(v, dt.timedelta) else v

        deep = lambda v: [deep(x) for x in v] if isinstance(v, tuple | list) else {k: deep(x) for k, x in v.items()} if isinstance(v, dict) else plain(v)
        return json.dumps(deep(dataclasses.asdict(self)))

    @staticmethod
    def from_json(text: str) -> Dimensions:
        def back(v):
            if isinstance(v, dict) and set(v) == {"date"}:
                return dt.datetime.fromisoformat(v["date"]) if "T" in v["date"] else dt.date.fromisoformat(v["date"])
            if isinstance(v, dict) and set(v) == {"days"}:
                return dt.timedelta(days=v["days"])
            return tuple(back(x) for x in v) if isinstance(v, list) else {k: back(x) for k, x in v.items()} if isinstance(v, dict) else v

        d = json.loads(text)
        dims = tuple(Dim(**{k: back(v) for k, v in x.items()}) for x in d["dims"])
        return Dimensions(dims, back(d["xy"]), back(d["affine"]), d["crs"], d["extra"])


def tiles(rows: int, cols: int, x_window: int, y_window: int, overlap: int = 0) -> list[tuple[int, int, int, int]]:
    """Read windows (x offset, y offset, x size, y size) that cover an image; edge tiles are short, overlap is added where it fits."""
    out = []
    for y in range(0, rows, y_window):
        for x in range(0, cols, x_window):
            w, h = min(x_window, cols - x), min(y_window, rows - y)
            out.append((x, y, w + overlap if x + w + overlap <= cols else w, h + overlap if y + h + overlap <= rows else h))
    return out
