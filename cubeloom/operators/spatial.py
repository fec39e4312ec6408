"""Points, polygons and grids: cells are found by arithmetic, so joins are equi-joins."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as C
from ..dims import Dim, Dimensions


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test of a ring; points on its lower and left edges are inside."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y0 != y1:
            side = (y >= min(y0, y1)) & (y < max(y0, y1)) & (x >= x0 + (y - y0) * ((x1 - x0) / (y1 - y0)))
            crossings = crossings + F.when(side, 1).otherwise(0)
    return crossings % 2 == 1


def rotate_pole(lon: Column, lat: Column, lon0: float, lat0: float, north: bool = True) -> tuple[Column, Column]:
    """Rotated-pole to geographic degrees for a pole at (lon0, lat0)."""
    to_lon = 0.0 if north else 180.0
    pole, phi, lam = math.radians(lat0), F.radians(lat), F.radians(lon + to_lon)
    sin_lat = F.sin(phi) * math.sin(pole) + F.cos(phi) * F.cos(lam) * math.cos(pole)
    lat_out = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_lat))))
    lon_out = F.degrees(F.atan2(F.cos(phi) * F.sin(lam), F.cos(phi) * F.cos(lam) * math.sin(pole) - F.sin(phi) * math.cos(pole))) + lon0
    return lon_out, lat_out


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


class Spatial:
    def cell_of(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Column and row indexes of a point, null outside."""
        nx, ny = self.dims.xy
        if self.dims.raster_type() != "affine":
            return self.dims[nx].index(x), self.dims[ny].index(y)
        a, b, c, d, e, f = self.dims.geotransform()
        det = b * f - c * e
        col = F.floor(((x - a) * f - (y - d) * c) / det) + 2 - self.dims[nx].first
        row = F.floor(((y - d) * b - (x - a) * e) / det) + 2 - self.dims[ny].first
        ok = lambda i, n: F.when((i >= 1) & (i <= self.dims[n].n), i).cast("int")
        return ok(col, nx), ok(row, ny)

    def cell_ids(self, points: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
        """Points with the id (row - 1) * columns + column of their cell."""
        i, j = self.cell_of(F.col(x), F.col(y))
        return points.withColumn("cell", ((j - 1) * self.dims[self.dims.xy[0]].n + i).cast("long"))

    def extract(self, points: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
        """Nearest-cell values at points; all points stay, other axes too."""
        nx, ny = self.dims.xy
        i, j = self.cell_of(F.col(x), F.col(y))
        return points.withColumns({nx: i, ny: j}).join(self.df, [nx, ny], "left").drop(nx, ny)

    def extract_bilinear(self, points: DataFrame, x: str = "px", y: str = "py", key: str = "pid") -> DataFrame:
        """Bilinear values at points between cell centres; missing if one of the four cells is."""
        nx, ny = self.dims.xy
        dx, dy = self.dims[nx], self.dims[ny]
        u = (F.col(x) - dx.offset) / dx.delta - (dx.first - 1) + 0.5
        v = (F.col(y) - dy.offset) / dy.delta - (dy.first - 1) + 0.5
        p = points.select(key, F.floor(u).cast("int").alias("_i"), F.floor(v).cast("int").alias("_j"), (u - F.floor(u)).alias("_u"), (v - F.floor(v)).alias("_v"))
        four = F.array(*[F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), ((F.col("_u") if a else 1 - F.col("_u")) * (F.col("_v") if b else 1 - F.col("_v"))).alias("w")) for a in (0, 1) for b in (0, 1)])
        near = p.select(key, F.explode(four).alias("n")).select(key, F.col("n.i").alias(nx), F.col("n.j").alias(ny), F.col("n.w").alias("_w"))
        rest = [n for n in self.index if n not in (nx, ny)]
        got = near.join(self.df, [nx, ny])
        return got.groupBy(key, *rest).agg(*[F.when(F.count(a) == 4, F.sum(F.col("_w") * F.col(a))).alias(a) for a in self.attrs])

    def extract_time(self, queries: DataFrame, dim: str, q: str = "q", interpolate: bool = False) -> DataFrame:
        """Values at times (as numbers of the axis): the cell that holds the time, or linear between neighbours."""
        d = self.dims[dim]
        at = (F.col(q) - d.offset) / d.delta - (d.first - 1)
        lo = (F.floor(at) + 1).cast("int")
        if not interpolate:
            return queries.withColumn(dim, lo).join(self.df, dim).drop(dim)
        rest = [n for n in self.index if n != dim]
        two = queries.withColumn("_f", at - F.floor(at)).withColumn(dim, F.explode(F.array(lo, lo + 1))).withColumn("_w", F.when(F.col(dim) == lo, 1 - F.col("_f")).otherwise(F.col("_f"))).where("_w > 0")
        return two.join(self.df, dim).groupBy(*queries.columns, *rest).agg(*[F.when(F.sum("_w") > 1 - 1e-9, F.sum(F.col("_w") * F.col(a))).alias(a) for a in self.attrs])

    def crop_polygon(self, ring: list[tuple[float, float]]):
        """Crop to the ring's box (a pushed range), then keep cells whose centre is inside."""
        xs, ys = zip(*ring, strict=True)
        out = self.crop((min(xs), min(ys), max(xs), max(ys)))
        c = out.coordinates()
        return out.with_df(out.df.where(in_polygon(c[self.dims.xy[0]], c[self.dims.xy[1]], ring)))

    def aggregate_polygons(self, rings: list[list[tuple[float, float]]], fun: str, na_rm: bool = True):
        """Each cell goes to the first polygon that holds its centre; polygons without cells stay as missing."""
        x, y = self.dims.xy
        c = self.coordinates()
        group = F.coalesce(*[F.when(in_polygon(c[x], c[y], r), F.lit(k + 1)) for k, r in enumerate(rings)])
        rest = [n for n in self.index if n not in (x, y)]
        df = self.df.withColumn("geometry", group).where("geometry is not null")
        out = df.groupBy("geometry", *rest).agg(*[C.reducer(fun, a, None, na_rm).alias(a) for a in self.attrs])
        ids = df.sparkSession.range(1, len(rings) + 1).select(F.col("id").cast("int").alias("geometry"))
        if rest:  # a row for each polygon and cell of the other axes, by arithmetic
            ids = self._grid(rest, geometry=len(rings))
        out = ids.join(out, ["geometry", *rest], "left")
        dims = Dimensions((Dim("geometry", len(rings), values=tuple(map(tuple, rings))), *[self.dims[n] for n in rest]), crs=self.dims.crs)
        return type(self)(out, dims, self.attrs)

    def join_first(self, points: DataFrame, key: str, x: str = "px", y: str = "py"):
        """Attributes of the first (smallest key) point in each cell; cells without points keep theirs, with missing."""
        nx, ny = self.dims.xy
        i, j = self.cell_of(F.col(x), F.col(y))
        fields = [c for c in points.columns if c not in (x, y)]
        first = points.withColumns({nx: i, ny: j}).where(F.col(nx).isNotNull() & F.col(ny).isNotNull()).groupBy(nx, ny).agg(F.min_by(F.struct(*fields), key).alias("_f")).select(nx, ny, "_f.*")
        return type(self)(self.df.join(first, [nx, ny], "left").select(*self.index, *self.attrs, *fields), self.dims, (*self.attrs, *fields))

    def join_semi(self, points: DataFrame, x: str = "px", y: str = "py"):
        """Cells that hold any point; the others are missing.  Points are first reduced to their cells."""
        nx, ny = self.dims.xy
        i, j = self.cell_of(F.col(x), F.col(y))
        hit = points.select(i.alias(nx), j.alias(ny)).distinct()
        return self.with_df(self.df.join(hit, [nx, ny], "left_semi"))

    def join_inner(self, points: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
        nx, ny = self.dims.xy
        i, j = self.cell_of(F.col(x), F.col(y))
        return points.withColumns({nx: i, ny: j}).join(self.df, [nx, ny])

    def rasterize_points(self, points: DataFrame, value: str, order: str, add: bool = False, x: str = "px", y: str = "py"):
        """Values burned into the cells of points: the last by ``order``, or their sum; other cells keep theirs."""
        nx, ny = self.dims.xy
        i, j = self.cell_of(F.col(x), F.col(y))
        burned = points.withColumns({nx: i, ny: j}).where(F.col(nx).isNotNull() & F.col(ny).isNotNull()).groupBy(nx, ny).agg((F.sum(value) if add else F.max_by(value, order)).alias("_v"))
        a = self.attrs[0]
        kept = F.coalesce(F.col("_v"), F.col(a)) if not add else F.coalesce(F.col("_v") + F.coalesce(F.col(a), F.lit(0)), F.col(a))
        return self.with_df(self.df.join(burned, [nx, ny], "full").select(*self.index, kept.alias(a)))

    def count_points(self, points: DataFrame, x: str = "px", y: str = "py"):
        """Number of points in each cell, zero where there is none."""
        i, j = self.cell_of(F.col(x), F.col(y))
        nx, ny = self.dims.xy
        n = points.select(i.alias(nx), j.alias(ny)).where(F.col(nx).isNotNull() & F.col(ny).isNotNull()).groupBy(nx, ny).agg(F.count("*").alias("n"))
        return type(self)(self.df.select(nx, ny).join(n, [nx, ny], "left").select(nx, ny, F.coalesce("n", F.lit(0)).alias("n")), self.dims.only([nx, ny]), ("n",))

    def warp(self, target: Dimensions):
        """Nearest-neighbour values on another grid: each target centre looks up its source cell."""
        x, y = target.xy
        grid = type(self).from_bbox(self.df.sparkSession, (0, 0, target[x].n, target[y].n), target[x].n, target[y].n)
        g = grid.df.select(F.col("x").alias("_tx"), F.col("y").alias("_ty"))
        i, j = self.cell_of(target[x].coord(F.col("_tx"), 0.5), target[y].coord(F.col("_ty"), 0.5))
        nx, ny = self.dims.xy
        out = g.withColumns({nx: i, ny: j}).join(self.df, [nx, ny])
        rest = [n for n in self.index if n not in (nx, ny)]
        return type(self)(out.select(F.col("_tx").alias(x), F.col("_ty").alias(y), *rest, *self.attrs), Dimensions((target[x], target[y], *[self.dims[n] for n in rest]), target.xy, crs=target.crs), self.attrs)

    def rgb(self, dim: str, top: float = 255.0, low: Column | float = 0.0):
        """Colours #RRGGBB[AA] of three or four bands; missing if one is."""
        def paint(*bands: Column) -> Column:
            whole = F.lit(True)
            for b in bands:
                whole = whole & ~C.is_na(b)
            parts = [F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (b - low) / (top - low) * 255))).cast("long")), 2, "0") for b in bands]
            return F.when(whole, F.concat(F.lit("#"), *parts))

        return self.apply_bands(dim, paint, "colour")

    def normalize(self):
        """The same cells with axes that start at their own first cell."""
        return type(self)(self.df, self.dims.put(*[replace(d, offset=d.at(1), first=1) for d in self.dims.dims if d.regular]), self.attrs)

    def polygons(self) -> DataFrame:
        """Cells with a value as closed rings of corners, beside their attributes."""
        x, y = self.dims.xy
        a, b = self.coordinates({x: 0.0, y: 0.0}), self.coordinates({x: 1.0, y: 1.0})
        corner = lambda p, q: F.struct(p[x].cast("double").alias("x"), q[y].cast("double").alias("y"))
        ring = F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b), corner(a, a))
        some = F.lit(False)
        for v in self.attrs:
            some = some | ~C.is_na(F.col(v))
        return self.df.where(some).select(*self.index, ring.alias("geometry"), *self.attrs)
