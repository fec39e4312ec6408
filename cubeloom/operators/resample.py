"""Moving windows over several axes, trends, stretches, class counts and cubic interpolation."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as C
from ..dims import Dim
from ..plans import interval_of, lookup


def cubic_weight(t: Column) -> Column:
    """Convolution weight at distance t of the interpolating cubic with slope -1/2."""
    t = F.abs(t)
    near, far = 1.5 * t * t * t - 2.5 * t * t + 1, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2
    return F.when(t <= 1, near).when(t < 2, far).otherwise(0.0)


class Resampling:
    def focal(self, radius: dict[str, int], fun: str, na_rm: bool = False):
        """``fun`` (sum, mean, min, max, length) over a box of cells around each cell.

        One pass an axis: sums and extremes of a box come from those of its lines, so the work does not
        grow with the radius and each window holds one line.  A box that leaves the cube or meets a
        missing cell is missing, unless ``na_rm``.
        """
        if fun not in ("sum", "mean", "min", "max", "length"):
            raise ValueError("moving boxes have sum, mean, min, max and length")
        whole = math.prod(2 * r + 1 for r in radius.values())
        fold = {"min": F.min, "max": F.max}.get(fun, F.sum)
        df = self.dense().select(*self.index, *[c for a in self.attrs for c in (F.when(~C.is_na(F.col(a)), F.col(a).cast("double")).alias(a), F.when(~C.is_na(F.col(a)), 1).otherwise(0).alias(f"_n_{a}"))])
        for n, r in radius.items():
            w = Window.partitionBy(*[m for m in self.index if m != n]).orderBy(n).rowsBetween(-r, r)
            df = df.select(*self.index, *[c for a in self.attrs for c in (fold(a).over(w).alias(a), F.sum(f"_n_{a}").over(w).alias(f"_n_{a}"))])

        def value(a: str) -> Column:
            n = F.col(f"_n_{a}")
            out = n.cast("double") if fun == "length" else F.try_divide(F.col(a), n) if fun == "mean" else F.col(a)
            return (out if na_rm else F.when(n == whole, out)).alias(a)

        return self.with_df(df.select(*self.index, *[value(a) for a in self.attrs]))

    def trend(self, dim: str):
        """Least-squares slope of each attribute along an axis, by its coordinates."""
        rest = [n for n in self.index if n != dim]
        at = self.coordinates()[dim].cast("double")
        out = self.df.groupBy(*rest).agg(*[F.regr_slope(F.when(~C.is_na(F.col(a)), F.col(a).cast("double")), at).alias(a) for a in self.attrs])
        return type(self)(out, self.dims.only(rest), self.attrs)

    def stretch(self, dim: str, probs: tuple[float, float] = (0.02, 0.98)):
        """Each layer of an axis scaled to 0..1 between two of its quantiles, clamped outside; flat layers are missing."""
        ends = self.df.groupBy(dim).agg(*[F.percentile(F.when(~C.is_na(F.col(a)), F.col(a).cast("double")), F.array(*map(F.lit, probs))).alias(f"_q_{a}") for a in self.attrs])
        df = lookup(self.df, dim, ends, self.dims[dim].n)
        low, high = (lambda a: F.col(f"_q_{a}")[0]), (lambda a: F.col(f"_q_{a}")[1])
        unit = lambda a: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(a) - low(a), high(a) - low(a))))
        return self.with_df(df.select(*self.index, *[F.when(~C.is_na(F.col(a)) & (high(a) > low(a)), unit(a)).alias(a) for a in self.attrs]))

    def breaks(self, classes: int, style: str = "equal") -> list[float]:
        """Class limits of the first attribute: equal widths or equal counts."""
        v = F.when(~C.is_na(F.col(self.attrs[0])), F.col(self.attrs[0]).cast("double"))
        if style == "quantile":
            return list(self.df.agg(F.percentile(v, F.array(*[F.lit(k / classes) for k in range(classes + 1)]))).first()[0] or [])
        if style != "equal":
            raise ValueError("styles are equal and quantile")
        low, high = self.df.agg(F.min(v), F.max(v)).first()
        return [] if low is None else [low + (high - low) * k / classes for k in range(classes)] + [high]

    def histogram(self, breaks: list[float]) -> DataFrame:
        """(bin, low, high, n) of the first attribute in classes (a, b], the first one closed; empty classes have 0."""
        v = F.col(self.attrs[0]).cast("double")
        held = F.when(v == float(breaks[0]), 1).otherwise(interval_of(v, [float(b) for b in breaks], left_open=True))
        counts = self.df.where(~C.is_na(v)).groupBy(held.cast("int").alias("bin")).agg(F.count("*").alias("n"))
        bins = self.df.sparkSession.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(breaks, breaks[1:], strict=False))], "bin int, low double, high double")
        return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))

    def extract_cubic(self, points: DataFrame, x: str = "px", y: str = "py", key: str = "pid") -> DataFrame:
        """Cubic convolution at points; missing if one of the sixteen cells around is.

        The planner takes sixteen rows a point for one, so it must not broadcast them: small cubes travel, else both sides are shuffled.
        """
        nx, ny = self.dims.xy
        at = lambda c, d: (F.col(c) - d.offset) / d.delta - (d.first - 1) + 0.5
        u, v = at(x, self.dims[nx]), at(y, self.dims[ny])
        p = points.select(key, F.floor(u).cast("int").alias("_i"), F.floor(v).cast("int").alias("_j"), (u - F.floor(u)).alias("_u"), (v - F.floor(v)).alias("_v"))
        cells = [F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), (cubic_weight(F.col("_u") - a) * cubic_weight(F.col("_v") - b)).alias("w")) for a in range(-1, 3) for b in range(-1, 3)]
        near = p.select(key, F.explode(F.array(*cells)).alias("n")).select(key, F.col("n.i").alias(nx), F.col("n.j").alias(ny), F.col("n.w").alias("_w"))
        rest = [n for n in self.index if n not in (nx, ny)]
        got = lookup(near.hint("merge"), [nx, ny], self.df, math.prod(self.dims.shape))
        return got.groupBy(key, *rest).agg(*[F.when(F.count(a) == 16, F.sum(F.col("_w") * F.col(a))).alias(a) for a in self.attrs])

    def downsample_to(self, pixels: int):
        """Whole steps over the raster axes so that about ``pixels`` cells are left."""
        x, y = self.dims.xy
        step = max(0, math.floor(math.sqrt(self.dims[x].n * self.dims[y].n / pixels)) - 1)
        return self.downsample({x: step, y: step}) if step else self

    def stack_axes(self, *others, along: dict[str, list]):
        """Cubes of equal axes under several new axes at once, the first new one fastest."""
        cubes = [self, *others]
        if math.prod(map(len, along.values())) != len(cubes):
            raise ValueError("the new axes do not multiply to the number of cubes")
        out = None
        for k, c in enumerate(cubes):
            if not self.dims.same(c.dims):
                raise ValueError("dimensions differ")
            new, step = [], 1
            for name, values in along.items():
                new.append(F.lit(k // step % len(values) + 1).alias(name))
                step *= len(values)
            part = c.df.select(*self.index, *new, *[F.col(a).alias(b) for a, b in zip(c.attrs, self.attrs, strict=True)])
            out = part if out is None else out.unionByName(part)
        return type(self)(out, replace(self.dims, dims=(*self.dims.dims, *[Dim.of(n, v) for n, v in along.items()])), self.attrs)
