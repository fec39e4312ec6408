"""Reductions over axes, groups in time and space, and windows along an axis."""

from __future__ import annotations

import bisect
import datetime as dt
import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as C
from ..dims import Dim, Dimensions
from ..plans import interval_of, literal_array, lookup


def time_breaks(low: dt.date, high: dt.date, by: str) -> list[dt.date]:
    """Bucket starts of "day", "3 days", "week", "months", "2 years" from the truncated minimum to past the maximum; weeks start on Monday."""
    count, unit = (by.split() if " " in by else ("1", by))
    count, unit = int(count), unit.rstrip("s")
    at = low.date() if isinstance(low, dt.datetime) else low
    end = high.date() if isinstance(high, dt.datetime) else high
    at = at - dt.timedelta(days=at.weekday()) if unit == "week" else at.replace(day=1) if unit == "month" else at.replace(month=1, day=1) if unit in ("year", "quarter") else at
    out = [at]
    while out[-1] <= end:
        if unit in ("day", "week"):
            at += dt.timedelta(days=count * (7 if unit == "week" else 1))
        else:
            months = at.year * 12 + at.month - 1 + count * {"month": 1, "quarter": 3, "year": 12}[unit]
            at = at.replace(year=months // 12, month=months % 12 + 1)
        out.append(at)
    return out


class Aggregation:
    def apply(self, margin: list[str], fun: str | Callable[[Column], Column], na_rm: bool = False, rename: bool = True):
        """Reduce all axes but ``margin``; one attribute takes the function's name."""
        cells = math.prod(self.dims[n].n for n in self.index if n not in margin)
        one = rename and len(self.attrs) == 1 and isinstance(fun, str)
        names = [fun] if one else list(self.attrs)
        out = self.df.groupBy(*margin).agg(*[C.reducer(fun, a, cells, na_rm).alias(n) for a, n in zip(self.attrs, names, strict=True)])
        return type(self)(out, self.dims.only(margin), tuple(names))

    def apply_vector(self, margin: list[str], funs: dict[str, str | Callable[[Column], Column]], name: str = "fun", na_rm: bool = False):
        """Several results for each margin cell, as a new first axis labelled by their names."""
        cells = math.prod(self.dims[n].n for n in self.index if n not in margin)
        agg = self.df.groupBy(*margin).agg(*[F.array(*[C.reducer(f, a, cells, na_rm).cast("double") for f in funs.values()]).alias(a) for a in self.attrs])
        out = agg.select(*margin, F.posexplode(F.arrays_zip(*self.attrs)).alias("_p", "_z")).select((F.col("_p") + 1).cast("int").alias(name), *margin, *[F.col(f"_z.{a}").alias(a) for a in self.attrs])
        dims = self.dims.only(margin)
        return type(self)(out, replace(dims, dims=(Dim(name, len(funs), values=tuple(funs)), *dims.dims)), self.attrs)

    def apply_along(self, dim: str, fun: Callable[[Column, Window], Column]):
        """Same-length results along one axis (cumulative sums, smoothing): one window for each series."""
        w = Window.partitionBy(*[n for n in self.index if n != dim]).orderBy(dim)
        return self.with_df(self.df.select(*self.index, *[fun(F.col(a), w).alias(a) for a in self.attrs]))

    def apply_bands(self, dim: str, fun: Callable[..., Column], name: str = "value"):
        """``fun`` of the slices of one axis as columns, for each other cell."""
        rest = [n for n in self.index if n != dim]
        a = self.attrs[0]
        bands = self.df.groupBy(*rest).agg(*[F.max(F.when(F.col(dim) == i + 1, F.col(a))).alias(f"_b{i}") for i in range(self.dims[dim].n)])
        return type(self)(bands.select(*rest, fun(*[F.col(f"_b{i}") for i in range(self.dims[dim].n)]).alias(name)), self.dims.only(rest), (name,))

    def apply_groups(self, margin: list[str], fun, schema: str) -> DataFrame:
        """Any Python function of a group's frame, where no expression will do."""
        return self.df.groupBy(*margin).applyInPandas(fun, schema)

    # ------------------------------------------------------------- groups

    def _grouped(self, key: Column, dim: str, axis: Dim, fun, na_rm: bool, cells: dict | None = None):
        """Group one axis by a key column; empty groups stay as missing cells."""
        rest = [n for n in self.index if n != dim]
        df = self.df.withColumn(dim, key.cast("int")).where(F.col(dim).isNotNull())
        counts = F.col("_cells") if cells else None
        if cells:
            df = df.withColumn("_cells", F.element_at(literal_array([cells.get(g) for g in range(1, max(cells) + 1)], "int"), F.col(dim)))
        aggs = []
        for a in self.attrs:
            col = C.reducer(fun, a, None, True) if na_rm or not cells else F.when(F.count(F.when(~C.is_na(F.col(a)), 1)) == F.max(counts), C.reducer(fun, a, None, True))
            aggs.append(col.alias(a))
        out = df.groupBy(dim, *rest).agg(*aggs)
        return type(self)(out.select(*self.index, *self.attrs), self.dims.put(replace(axis, name=dim)), self.attrs)

    def aggregate_breaks(self, dim: str, breaks: list, fun: str, na_rm: bool = False, left_open: bool = False):
        """Groups [a, b) between breaks; the axis has one slot for each break, so the last is empty."""
        d = self.dims[dim]
        values = d.coords()
        group = [(bisect.bisect_left if left_open else bisect.bisect_right)(breaks, v) for v in values]
        cells = {g: group.count(g) for g in set(group) if 1 <= g < len(breaks)}
        key = F.element_at(literal_array([g if g in cells else None for g in group], "int"), F.col(dim)) if len(values) <= 20_000 else interval_of(d.coord(F.col(dim)), breaks, left_open)
        return self._grouped(key, dim, Dim.of(dim, breaks), fun, na_rm, cells)

    def aggregate_time(self, dim: str, by: str, fun: str, na_rm: bool = False):
        """Calendar buckets from the truncated minimum to the maximum, empty ones included."""
        values = [v.date() if isinstance(v, dt.datetime) else v for v in self.dims[dim].coords()]
        breaks = time_breaks(min(values), max(values), by)
        out = self.aggregate_breaks(dim, breaks, fun, na_rm)
        return type(self)(out.df, out.dims.put(Dim.of(dim, breaks[:-1])), out.attrs)

    def aggregate_by(self, dim: str, label: Callable, fun: str, levels: list | None = None, na_rm: bool = False):
        """Groups by a function of the axis values; groups are the levels in order."""
        got = [label(v) for v in self.dims[dim].coords()]
        levels = levels or sorted(set(got))
        at = [levels.index(g) + 1 if g in levels else None for g in got]
        cells = {g: at.count(g) for g in set(at) - {None}}
        return self._grouped(F.element_at(literal_array(at, "int"), F.col(dim)), dim, Dim(dim, len(levels), values=tuple(levels)), fun, na_rm, cells)

    def aggregate_blocks(self, blocks: dict[str, int], fun: str, na_rm: bool = False):
        """Groups of blocks of a regular raster, as index arithmetic: no spatial join.  Blocks at the far edges hold the cells that are left."""
        df, dims = self.df, self.dims
        cells = F.lit(1)
        for n, k in blocks.items():
            d = dims[n]
            df = df.withColumn(n, (F.floor((F.col(n) - 1) / k) + 1).cast("int"))
            dims = dims.put(replace(d, n=math.ceil(d.n / k), offset=d.at(1), delta=d.delta * k, first=1))
            cells = cells * F.least(F.lit(k), F.lit(d.n) - (F.col(n) - 1) * k)
        ragged = any(self.dims[n].n % k for n, k in blocks.items())
        whole = math.prod(blocks.values()) if not ragged else F.max(cells)
        return type(self)(df.groupBy(*self.index).agg(*[C.reducer(fun, a, whole, na_rm).alias(a) for a in self.attrs]), dims, self.attrs)

    def aggregate_rectangles(self, boxes: list[tuple], fun: str = "mean", na_rm: bool = False, weights: Column | None = None):
        """Area-weighted mean or sum in each box, by exact overlap of cells and boxes; boxes become the first axis."""
        if fun not in ("mean", "sum"):
            raise ValueError("exact aggregation has only mean and sum")
        x, y = self.dims.xy
        rest = [n for n in self.index if n not in (x, y)]
        table = self.df.sparkSession.createDataFrame([(i + 1, *map(float, b)) for i, b in enumerate(boxes)], "geometry int, _x0 double, _y0 double, _x1 double, _y1 double")

        def side(n: str, low: str, high: str) -> tuple[Column, Column]:
            d = self.dims[n]
            a, b = d.coord(F.col(n), 0.0), d.coord(F.col(n), 1.0)
            lo, hi = F.least(a, b), F.greatest(a, b)
            return F.greatest(F.lit(0.0), F.least(hi, F.col(high)) - F.greatest(lo, F.col(low))) / (hi - lo), (hi > F.col(low)) & (lo < F.col(high))

        (fx, tx), (fy, ty) = side(x, "_x0", "_x1"), side(y, "_y0", "_y1")
        # few boxes meet many cells: the boxes' index ranges are equi-joined on the coarser axis
        met = self._box_rows(table, y, len(boxes)).withColumn("_w", fx * fy * (weights if weights is not None else F.lit(1.0))).where(tx & ty)
        aggs = []
        for a in self.attrs:
            v = F.when(~C.is_na(F.col(a)), F.col(a))
            num, den = F.sum(F.col("_w") * v), F.sum(F.when(v.isNotNull(), F.col("_w")) if na_rm else F.col("_w"))
            whole = F.count(v) == F.count(F.lit(1))
            value = num / F.when(den != 0, den) if fun == "mean" else num
            aggs.append((value if na_rm else F.when(whole, value)).alias(a))
        out = met.groupBy("geometry", *rest).agg(*aggs)
        dims = Dimensions((Dim("geometry", len(boxes), values=tuple(map(tuple, boxes))), *[self.dims[n] for n in rest]), crs=self.dims.crs)
        return type(self)(out, dims, self.attrs)

    def _box_rows(self, table: DataFrame, axis: str, boxes: int) -> DataFrame:
        """Cells joined to boxes on the axis rows that a box spans."""
        d = self.dims[axis]
        low, high = d.bounds()
        eps = (high - low) * 1e-9  # just inside, whichever way the axis runs; a row more on either side is looked at
        i = [d.index(F.greatest(F.lit(low + eps), F.least(F.lit(high - eps), F.col(c)))) for c in ("_y0", "_y1")]
        rows = table.withColumn("_a", F.coalesce(F.least(*i), F.lit(1))).withColumn("_b", F.coalesce(F.greatest(*i), F.lit(d.n)))
        rows = rows.withColumn(axis, F.explode(F.expr("sequence(greatest(_a - 1, 1), _b + 1)")))
        return lookup(self.df, axis, rows, boxes * d.n)

    def area(self, radius: float | None = None):
        """Cell areas of the raster: products of widths, or with a ``radius`` the areas between meridians and parallels (in degrees) of that sphere."""
        x, y = self.dims.xy
        edge = lambda n, where: self.dims[n].coord(F.col(n), where)
        if radius is not None:
            sine = lambda where: F.sin(F.radians(edge(y, where)))
            cell = F.abs(F.radians(edge(x, 1.0) - edge(x, 0.0)) * (sine(1.0) - sine(0.0))) * radius**2
            return type(self)(self.df.select(x, y, cell.alias("area")).distinct(), self.dims.only([x, y]), ("area",))
        width = lambda n: F.abs(edge(n, 1.0) - edge(n, 0.0))
        return type(self)(self.df.select(x, y, (width(x) * width(y)).alias("area")).distinct(), self.dims.only([x, y]), ("area",))

    def interpolate_aw(self, boxes: list[tuple], extensive: bool):
        """Area-weighted interpolation: totals are shared by area, means weighted by it."""
        return self.aggregate_rectangles(boxes, "sum" if extensive else "mean")

    # ------------------------------------------------------------- models

    def predict_linear(self, intercept: float, weights: dict[str, float], name: str = "prediction"):
        value = F.lit(intercept)
        for a, w in weights.items():
            value = value + F.col(a) * w
        missing = F.lit(False)
        for a in weights:
            missing = missing | C.is_na(F.col(a))
        return type(self)(self.df.select(*self.index, F.when(~missing, value).alias(name)), self.dims, (name,))

    def predict(self, model, name: str = "prediction"):
        """Any model with ``predict(frame)``, on Arrow batches; rows with a missing value give a missing prediction."""
        attrs, index = list(self.attrs), self.index

        def run(frames):
            for f in frames:
                bad = f[attrs].isna().any(axis=1)
                out = f[index].copy()
                out[name] = model.predict(f[attrs].fillna(0))
                out.loc[bad, name] = None
                yield out

        schema = ", ".join([*[f"`{n}` int" for n in index], f"`{name}` double"])
        return type(self)(self.df.mapInPandas(run, schema), self.dims, (name,))

    def prcomp(self):
        """Principal components of the attributes: (standard deviations, rotation); one pass of covariances, eigenvectors on the driver."""
        import numpy as np

        k = len(self.attrs)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = self.df.agg(*[F.covar_samp(F.col(self.attrs[i]).cast("double"), F.col(self.attrs[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs]).first()
        m = np.zeros((k, k))
        for (i, j), v in zip(pairs, got, strict=True):
            m[i, j] = m[j, i] = v
        values, vectors = np.linalg.eigh(m)
        return np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1]
