"""The cube: a lazy DataFrame in long layout (1-based index columns and attributes) with its dimension table.

An absent row means that all attributes of the cell are missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as C
from .dims import Dim, Dimensions
from .operators import aggregate, combine, resample, spatial
from .plans import literal_array

Attr = str


@dataclass(frozen=True)
class Cube(aggregate.Aggregation, combine.Combination, resample.Resampling, spatial.Spatial):
    df: DataFrame
    dims: Dimensions
    attrs: tuple[Attr, ...]

    # ------------------------------------------------------- construction

    @staticmethod
    def of(df: DataFrame, dims: Dimensions) -> Cube:
        return Cube(df, dims, tuple(c for c in df.columns if c not in dims.names))

    @staticmethod
    def from_table(df: DataFrame, keys: list[str], xy: tuple[str, str] | None = None, y_decreasing: bool = True, order: str | None = None, most: int = 1_000_000, unique: bool = False) -> Cube:
        """A cube from rows keyed by dimension values: sorted distinct values become the axes (y from the top).

        Of duplicate keys one row keeps its place: the one with the largest ``order``, or without it the
        largest values, as tables have no last row.  Axis tables come to the driver and are refused beyond
        ``most`` values.  ``unique`` says that keys are known to differ, as behind a grouping.
        """
        rest = [c for c in df.columns if c not in keys and c != order]
        if order or not unique:
            df = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest) if order else F.struct(*rest)).alias("_v")).select(*keys, "_v.*")
        axes, out = [], df.where(" and ".join(f"`{k}` is not null" for k in keys))
        for k in keys:
            values = sorted((r[0] for r in df.select(k).where(F.col(k).isNotNull()).distinct().limit(most + 1).collect()), reverse=bool(xy and k == xy[1] and y_decreasing))
            if len(values) > most:
                raise ValueError(f"dimension {k} has more than {most} values")
            axes.append(Dim.of(k, values))
            table = df.sparkSession.createDataFrame([(v, i + 1) for i, v in enumerate(values)], df.select(k).schema.add("_i", "integer"))
            out = out.join(F.broadcast(table) if len(values) <= 20_000 else table, k).drop(k).withColumnRenamed("_i", k)
        return Cube(out.select(*keys, *rest), Dimensions(tuple(axes), xy), tuple(rest))

    @staticmethod
    def from_arrays(spark: SparkSession, arrays: dict[str, Any], dims: Dimensions | None = None) -> Cube:
        """A cube from equally shaped numpy arrays; missing dimensions count from 0."""
        import numpy as np

        shapes = {a.shape for a in arrays.values()}
        if len(shapes) != 1:
            raise ValueError("arrays differ in shape")
        shape = shapes.pop()
        if dims is None:
            dims = Dimensions(tuple(Dim(f"X{k + 1}", n, 0, 1) for k, n in enumerate(shape)))
        if dims.shape != shape:
            raise ValueError(f"dimensions {dims.shape} do not fit arrays {shape}")
        import pandas as pd

        grid = np.indices(shape).reshape(len(shape), -1).astype("int32") + 1
        frame = pd.DataFrame({**dict(zip(dims.names, grid, strict=True)), **{k: a.ravel() for k, a in arrays.items()}})
        df = spark.createDataFrame(frame)
        return Cube(df.select(*[F.col(n).cast("int").alias(n) for n in dims.names], *arrays), dims, tuple(arrays))

    @staticmethod
    def from_bbox(spark: SparkSession, bbox: tuple, nx: int | None = None, ny: int | None = None, cells: int = 64800, value: float = 0.0, crs: str | None = None) -> Cube:
        """A grid over a box: square cells by default, rows from the top."""
        w, h = bbox[2] - bbox[0], bbox[3] - bbox[1]
        if (nx is None) != (ny is None):
            raise ValueError("give both nx and ny, or neither")
        if nx is None:
            side = math.sqrt(w * h / cells)
            nx, ny = math.ceil(w / side), math.ceil(h / side)
            dx = dy = side
        else:
            dx, dy = w / nx, h / ny
        dims = Dimensions((Dim("x", nx, bbox[0], dx), Dim("y", ny, bbox[3], -dy)), ("x", "y"), crs=crs)
        i = spark.range(nx * ny)
        return Cube(i.select((F.col("id") % nx + 1).cast("int").alias("x"), (F.floor(F.col("id") / nx) + 1).cast("int").alias("y"), F.lit(value).alias("values")), dims, ("values",))

    def with_df(self, df: DataFrame, attrs: tuple[Attr, ...] | None = None) -> Cube:
        return replace(self, df=df, attrs=attrs or self.attrs)

    @property
    def index(self) -> list[str]:
        return self.dims.names

    def dense(self) -> DataFrame:
        """All cells, absent ones with missing attributes."""
        return self._grid(self.index).join(self.df, self.index, "left")

    def _grid(self, names: list[str], **more: int) -> DataFrame:
        """The indexes of every cell of some axes, and of further axes of given sizes, by arithmetic on one range."""
        cols, step = [], 1
        for name, n in {**{k: self.dims[k].n for k in names}, **more}.items():
            cols.append((F.floor(F.col("id") / step) % n + 1).cast("int").alias(name))
            step *= n
        return self.df.sparkSession.range(step).select(*cols)

    # --------------------------------------------------------- projection

    def select(self, *attrs: str) -> Cube:
        return self.with_df(self.df.select(*self.index, *attrs), attrs)

    def rename(self, **names: str) -> Cube:
        back = {v: k for k, v in names.items()}
        return self.with_df(self.df.withColumnsRenamed(back), tuple(back.get(a, a) for a in self.attrs))

    def mutate(self, **exprs: Column) -> Cube:
        return self.with_df(self.df.withColumns(exprs), (*self.attrs, *[k for k in exprs if k not in self.attrs]))

    def drop(self, *attrs: str) -> Cube:
        """The cube without some attributes; one has to stay."""
        left = [a for a in self.attrs if a not in attrs]
        if not left or set(attrs) - set(self.attrs):
            raise ValueError(f"attributes {self.attrs} without {attrs}")
        return self.select(*left)

    def fill(self, name: str, values: list, most: int = 20_000) -> Cube:
        """An attribute of a few values repeated over all cells, the first axis running fastest."""
        if not values or len(values) > most or math.prod(self.dims.shape) % len(values):
            raise ValueError(f"{len(values)} values for {math.prod(self.dims.shape)} cells, at most {most}")
        place, stride = F.lit(0).cast("long"), 1
        for d in self.dims.dims:
            place, stride = place + (F.col(d.name).cast("long") - 1) * stride, stride * d.n
        value = F.element_at(literal_array(list(values)), (place % len(values) + 1).cast("int"))
        return self.with_df(self.dense()).mutate(**{name: value})

    def transmute(self, **exprs: Column) -> Cube:
        return self.with_df(self.df.select(*self.index, *[v.alias(k) for k, v in exprs.items()]), tuple(exprs))

    def long(self, where: dict[str, float] | None = None) -> DataFrame:
        """Coordinates (cell centres of the raster, starts of other axes) and attributes."""
        return self.df.select(*[c.alias(k) for k, c in self.coordinates(where).items()], *self.attrs)

    def coordinates(self, where: dict[str, float] | None = None) -> dict[str, Column]:
        w = {n: 0.5 if self.dims.xy and n in self.dims.xy and self.dims[n].point is not True else 0.0 for n in self.index} | (where or {})
        if self.dims.raster_type() == "affine":
            x, y = self.dims.xy
            shear = dict(zip((x, y), self.dims.affine_xy(F.col(x) - 1 + w[x], F.col(y) - 1 + w[y]), strict=True))
            return {n: shear[n] if n in shear else self.dims[n].coord(F.col(n), w[n]) for n in self.index}
        return {n: self.dims[n].coord(F.col(n), w[n]) for n in self.index}

    def dim_to_attr(self, *which: str) -> Cube:
        return self.mutate(**{f"{n}_value": self.coordinates()[n] for n in which or self.index})

    def is_na(self) -> Cube:
        return self.with_df(self.dense().select(*self.index, *[C.is_na(F.col(a)).alias(a) for a in self.attrs]))

    def replace_na(self, **values: Any) -> Cube:
        return self.with_df(self.dense().select(*self.index, *[F.when(C.is_na(F.col(a)), F.lit(values[a])).otherwise(F.col(a)).alias(a) if a in values else F.col(a) for a in self.attrs]))

    def adrop(self, drop_xy: bool = False) -> Cube:
        """Without axes of one cell; raster axes stay unless asked, and so does everything if all have one cell."""
        keep = [n for n in self.index if self.dims[n].n > 1 or (self.dims.xy and n in self.dims.xy and not drop_xy)]
        return self if not keep else Cube(self.df.select(*keep, *self.attrs), self.dims.only(keep), self.attrs)

    # ---------------------------------------------------------- cell math

    def math(self, fun: str, **args: Any) -> Cube:
        return self.with_df(self.df.select(*self.index, *[C.MATH[fun](F.col(a), **args).cast("double").alias(a) for a in self.attrs]))

    def ops(self, op: str, other: Cube | float) -> Cube:
        """Arithmetic, comparison or logic with a number or a cube; a smaller cube must share the leading axes and is recycled over the rest."""
        f = _OPS[op]
        if not isinstance(other, Cube):
            return self.with_df(self.df.select(*self.index, *[f(F.col(a), F.lit(other)).alias(a) for a in self.attrs]))
        if len(other.index) > len(self.index):
            return other.ops_swapped(op, self)
        return self._paired(other, f)

    def ops_swapped(self, op: str, left: Cube) -> Cube:
        return self._paired(left, lambda a, b: _OPS[op](b, a))

    def _paired(self, small: Cube, f: Callable[[Column, Column], Column]) -> Cube:
        lead = self.index[: len(small.index)]
        if not self.dims.only(lead).same(small.dims):
            raise ValueError("dimensions of the smaller cube must equal the leading ones")
        if len(lead) < len(self.index) and len(small.attrs) != 1:
            raise ValueError("a recycled cube must have one attribute")
        right = small.df.select(*lead, *[F.col(a).alias(f"_r{k}") for k, a in enumerate(small.attrs)])
        joined = self.df.join(right, lead)
        return self.with_df(joined.select(*self.index, *[f(F.col(a), F.col(f"_r{k % len(small.attrs)}")).alias(a) for k, a in enumerate(self.attrs)]))

    def __add__(self, o):
        return self.ops("+", o)

    def __sub__(self, o):
        return self.ops("-", o)

    def __mul__(self, o):
        return self.ops("*", o)

    def __truediv__(self, o):
        return self.ops("/", o)

    def __mod__(self, o):
        return self.ops("%%", o)

    def __floordiv__(self, o):
        return self.ops("%/%", o)

    def __pow__(self, o):
        return self.ops("^", o)

    def __neg__(self):
        return self.ops("*", -1)

    def mask(self, condition: Column | Cube) -> Cube:
        """Cells where the condition is not true become missing."""
        if isinstance(condition, Cube):
            m = condition.df.select(*self.index, F.col(condition.attrs[0]).alias("_m"))
            return self.with_df(self.df.join(m, self.index).where("_m").select(*self.index, *self.attrs))
        return self.with_df(self.df.where(condition))

    def assign(self, condition: Column, value: Any) -> Cube:
        return self.with_df(self.df.select(*self.index, *[F.when(condition, F.lit(value)).otherwise(F.col(a)).alias(a) for a in self.attrs]))

    def isin(self, values: list) -> Cube:
        return self.with_df(self.df.select(*self.index, *[F.coalesce(F.col(a).isin(values), F.lit(False)).alias(a) for a in self.attrs]))

    def cut(self, breaks: list[float] | int, right: bool = True, labels: list[str] | None = None) -> Cube:
        """Labels of the classes (a, b] (or [a, b)); outside is missing.

        A number of classes makes equal widths from the lowest to the highest value of each attribute, the
        outer limits a thousandth of that range further out (an action).
        """
        limits = self._equal_limits(breaks) if isinstance(breaks, int) else {a: list(breaks) for a in self.attrs}
        fmt = (lambda a, b: f"({a:g},{b:g}]") if right else (lambda a, b: f"[{a:g},{b:g})")

        def label(name: str) -> Column:
            c, out, edges = F.col(name), F.lit(None).cast("string"), limits[name]
            names = labels or [fmt(a, b) for a, b in zip(edges, edges[1:], strict=False)]
            if edges and len(names) != len(edges) - 1:
                raise ValueError(f"{len(names)} labels for {len(edges) - 1} classes")
            for a, b, t in zip(edges, edges[1:], names, strict=False):
                out = F.when((c > a) & (c <= b) if right else (c >= a) & (c < b), t).otherwise(out)
            return out.alias(name)

        return self.with_df(self.df.select(*self.index, *map(label, self.attrs)))

    def _equal_limits(self, classes: int) -> dict[str, list[float]]:
        """Limits of equal classes by attribute; none where all is missing."""
        if classes < 2:
            raise ValueError("at least two classes")
        number = lambda a: F.when(~C.is_na(F.col(a)), F.col(a).cast("double"))
        ends = self.df.agg(*[f(number(a)) for a in self.attrs for f in (F.min, F.max)]).first()
        out = {}
        for k, a in enumerate(self.attrs):
            low, high = ends[2 * k], ends[2 * k + 1]
            if low is None:
                out[a] = []
                continue
            margin = (high - low or abs(low) or 1.0) / 1000
            inner = (low, high) if high > low else (low - margin, high + margin)
            steps = [inner[0] + (inner[1] - inner[0]) * i / classes for i in range(1, classes)]
            out[a] = [low - margin, *steps, high + margin]
        return out

    # ---------------------------------------------------------- subsetting

    def isel(self, **keep: Any) -> Cube:
        """Cells by 1-based position: a slice stays a pushed range filter, a list may repeat and reorder, negatives drop."""
        df, dims = self.df, self.dims
        for name, sel in keep.items():
            d = dims[name]
            cells = list(range(1, d.n + 1))
            sel = cells[sel.start - 1 if sel.start else 0 : sel.stop] if isinstance(sel, slice) else [sel] if isinstance(sel, int) else list(sel)
            if sel and all(i < 0 for i in sel):
                sel = [i for i in cells if -i not in sel]
            if not all(1 <= i <= d.n for i in sel):
                raise IndexError(f"dimension {name}: subscript out of bounds")
            dims = dims.put(d.take(sel))
            if sel and sel == list(range(sel[0], sel[0] + len(sel))):
                df = df.where(F.col(name).between(sel[0], sel[-1])).withColumn(name, (F.col(name) - (sel[0] - 1)).cast("int"))
            else:
                table = df.sparkSession.createDataFrame([(i, k + 1) for k, i in enumerate(sel)], f"`{name}` int, _new int")
                df = df.join(F.broadcast(table) if len(sel) <= 20_000 else table, name).drop(name).withColumnRenamed("_new", name)
        return Cube(df.select(*self.index, *self.attrs), dims, self.attrs)

    def sel(self, **labels: Any) -> Cube:
        """Cells by label."""
        out = {}
        for name, want in labels.items():
            at = {v: i + 1 for i, v in enumerate(self.dims[name].coords())}
            want = want if isinstance(want, list | tuple) else [want]
            if missing := [v for v in want if v not in at]:
                raise KeyError(f"dimension {name}: no label {missing[0]!r}")
            out[name] = [at[v] for v in want]
        return self.isel(**out)

    def filter(self, **tests: Callable[[Any], bool]) -> Cube:
        """Cells whose axis values pass a test; only coordinates are seen."""
        return self.isel(**{n: [i + 1 for i, v in enumerate(self.dims[n].coords(0.5 if self.dims.xy and n in self.dims.xy else 0.0)) if f(v)] for n, f in tests.items()})

    def slice(self, along: str, index: int | list[int], drop: bool | None = None) -> Cube:
        out = self.isel(**{along: index})
        if drop if drop is not None else isinstance(index, int):
            keep = [n for n in self.index if n != along]
            return Cube(out.df.select(*keep, *self.attrs), out.dims.only(keep), self.attrs)
        return out

    def crop(self, bbox: tuple, epsilon: float = 1.5e-8) -> Cube:
        """Cells that a box touches, after shrinking it by ``epsilon`` of its size."""
        x, y = (self.dims[n] for n in self.dims.xy)
        ex, ey = (bbox[2] - bbox[0]) * epsilon / 2, (bbox[3] - bbox[1]) * epsilon / 2

        def window(d: Dim, a: float, b: float) -> slice:
            at = sorted((v - d.offset) / d.delta - (d.first - 1) for v in (a, b))
            return slice(max(1, math.floor(at[0]) + 1), min(d.n, math.floor(at[1]) + 1))

        return self.isel(**{x.name: window(x, bbox[0] + ex, bbox[2] - ex), y.name: window(y, bbox[1] + ey, bbox[3] - ey)})

    def flip(self, *which: str) -> Cube:
        """Values reversed along axes; the axes stay."""
        return self.with_df(self.df.withColumns({n: (self.dims[n].n + 1 - F.col(n)).cast("int") for n in which}))

    def downsample(self, n: dict[str, int], offset: dict[str, int] | None = None, fun: str | None = None, na_rm: bool = False) -> Cube:
        """Every (n + 1)-th cell from an offset, or ``fun`` over whole tiles."""
        df, dims, cells = self.df, self.dims, 1
        for name, k in n.items():
            d, off = dims[name], (offset or {}).get(name, 0)
            step = k + 1
            size = (d.n - off) // step if fun else math.ceil((d.n - off) / step)
            moved = (F.col(name) - 1 - off) / step
            df = df.where((F.col(name) > off) & (F.col(name) <= off + size * step) & (F.lit(True) if fun else (F.col(name) - 1 - off) % step == 0)).withColumn(name, (F.floor(moved) + 1).cast("int"))
            dims = dims.put(replace(d, n=size, offset=d.at(1 + off), delta=d.delta * step, first=1) if d.regular else d.take([1 + off + i * step for i in range(size)]))
            cells *= step
        if fun:
            df = df.groupBy(*self.index).agg(*[C.reducer(fun, a, cells, na_rm).alias(a) for a in self.attrs])
        return Cube(df.select(*self.index, *self.attrs), dims, self.attrs)

    def sample(self, size: int, seed: int = 0) -> DataFrame:
        return self.df.select(self.attrs[0]).orderBy(F.rand(seed)).limit(size)

    def aperm(self, *names: str) -> Cube:
        names = names or tuple(reversed(self.index))
        return Cube(self.df.select(*names, *self.attrs), replace(self.dims, dims=tuple(self.dims[n] for n in names)), self.attrs)

    def summary(self) -> DataFrame:
        """Quartiles (type 7), mean and missing count of each attribute."""
        total = math.prod(self.dims.shape)
        parts = [F.struct(F.lit(a).alias("attribute"), F.percentile(a, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"), F.avg(a).alias("mean"), (F.lit(total) - F.count(a)).alias("missing")) for a in self.attrs]
        return self.df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": C.divide, "^": lambda a, b: F.pow(a, b), "%%": C.modulo, "%/%": C.floor_divide,
    "==": lambda a, b: C.compare(lambda x, y: x == y, a, b), "!=": lambda a, b: C.compare(lambda x, y: x != y, a, b), "<": lambda a, b: C.compare(lambda x, y: x < y, a, b),
    "<=": lambda a, b: C.compare(lambda x, y: x <= y, a, b), ">": lambda a, b: C.compare(lambda x, y: x > y, a, b), ">=": lambda a, b: C.compare(lambda x, y: x >= y, a, b),
    "&": lambda a, b: a & b, "|": lambda a, b: a | b,
}
