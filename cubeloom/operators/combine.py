"""Binding, concatenating, reshaping and mosaicking cubes."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from ..dims import Dim, _number


class Combination:
    def bind(self, *others):
        """More attributes on the same axes."""
        out, attrs = self.df, list(self.attrs)
        for o in others:
            if not self.dims.same(o.dims):
                raise ValueError("dimensions differ; give along=")
            names = {a: a if a not in attrs else f"{a}.{len(attrs)}" for a in o.attrs}
            out = out.join(o.df.withColumnsRenamed(names), self.index, "full")
            attrs += names.values()
        return type(self)(out.select(*self.index, *attrs), self.dims, tuple(attrs))

    def concat(self, *others, along: str, values: list | None = None):
        """Along an axis (values joined, regularity tested again) or a new last one."""
        cubes = [self, *others]
        if along in self.index:
            out, start, joined = None, 0, []
            for c in cubes:
                part = c.df.select(*[(F.col(n) + start).cast("int").alias(n) if n == along else n for n in self.index], *[F.col(a).alias(b) for a, b in zip(c.attrs, self.attrs, strict=True)])
                out = part if out is None else out.unionByName(part)
                start += c.dims[along].n
                joined += c.dims[along].coords()
            return type(self)(out, self.dims.put(Dim.of(along, joined, self.dims[along].point)), self.attrs)
        out = None
        for k, c in enumerate(cubes):
            if not self.dims.same(c.dims):
                raise ValueError("dimensions differ")
            part = c.df.select(*self.index, F.lit(k + 1).alias(along), *[F.col(a).alias(b) for a, b in zip(c.attrs, self.attrs, strict=True)])
            out = part if out is None else out.unionByName(part)
        dims = replace(self.dims, dims=(*self.dims.dims, Dim.of(along, values or list(range(1, len(cubes) + 1)))))
        return type(self)(out, dims, self.attrs)

    def concat_time(self, *others, along: str = "time"):
        """Pieces whose times increase without overlap."""
        cubes = [self, *others]
        for a, b in zip(cubes, cubes[1:], strict=False):
            if _number(a.dims[along].coords()[-1]) >= _number(b.dims[along].coords()[0]):
                raise ValueError("times overlap or do not increase")
        return self.concat(*others, along=along)

    def merge(self, name: str = "attributes", value: str = "value"):
        """Attributes become a new last axis: one pass, no shuffle."""
        out = self.df.select(*self.index, F.posexplode(F.array(*[F.col(a).cast("double") for a in self.attrs])).alias("_p", value))
        out = out.select(*self.index, (F.col("_p") + 1).cast("int").alias(name), value)
        return type(self)(out, replace(self.dims, dims=(*self.dims.dims, Dim(name, len(self.attrs), values=self.attrs))), (value,))

    def split(self, dim: str | None = None):
        """An axis becomes attributes."""
        dim = dim or self.index[-1]
        rest = [n for n in self.index if n != dim]
        d = self.dims[dim]
        labels = [str(v) for v in d.coords()] if d.kind == "discrete" else [f"X{i + 1}" for i in range(d.n)]
        names = {(i, a): lab if len(self.attrs) == 1 else f"{a}.{lab}" for i, lab in enumerate(labels) for a in self.attrs}
        aggs = [F.max(F.when(F.col(dim) == i + 1, F.col(a))).alias(n) for (i, a), n in names.items()]
        return type(self)(self.df.groupBy(*rest).agg(*aggs), self.dims.only(rest), tuple(names.values()))

    def redimension(self, dims):
        """The same cells in order (first axis fastest) under other axes."""
        if math.prod(dims.shape) != math.prod(self.dims.shape):
            raise ValueError("cell counts differ")
        linear, step = F.lit(0).cast("long"), 1
        for d in self.dims.dims:
            linear = linear + (F.col(d.name) - 1) * step
            step *= d.n
        out, step, cols = self.df.withColumn("_l", linear), 1, []
        for d in dims.dims:
            cols.append((F.floor(F.col("_l") / step) % d.n + 1).cast("int").alias(d.name))
            step *= d.n
        return type(self)(out.select(*cols, *self.attrs), dims, self.attrs)

    def mosaic(self, *others):
        """Union of extents on one grid; where cubes overlap, the last one with a value wins."""
        cubes = [self, *others]
        x, y = self.dims.xy
        place = {}
        for n in (x, y):
            d = self.dims[n]
            firsts = [round((c.dims[n].at(1) - d.offset) / d.delta) + 1 for c in cubes]
            low, high = min(firsts), max(f + c.dims[n].n for f, c in zip(firsts, cubes, strict=True))
            place[n] = (firsts, low, replace(d, n=high - low, first=low))
        out = None
        for k, c in enumerate(cubes):
            part = c.df.select(*[(F.col(n) + (place[n][0][k] - place[n][1])).cast("int").alias(n) if n in place else n for n in self.index], F.lit(k).alias("_k"), *[F.col(a).alias(b) for a, b in zip(c.attrs, self.attrs, strict=True)])
            out = part if out is None else out.unionByName(part)
        best = [F.max_by(a, F.when(F.col(a).isNotNull(), F.col("_k"))).alias(a) for a in self.attrs]
        return type(self)(out.groupBy(*self.index).agg(*best), self.dims.put(*[p[2] for p in place.values()]), self.attrs)
