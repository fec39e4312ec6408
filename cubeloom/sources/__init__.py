"""Cubes in files: cells as Parquet (or any Spark format) beside a one-row table of the dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..dims import Dimensions

#: Formats by file ending.
FORMATS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json"}


def detect_format(path: str) -> str:
    return FORMATS.get(path.rstrip("/").rpartition(".")[2].lower(), "parquet")


def write_cube(cube: Cube, path: str, fmt: str = "parquet", partition: list[str] | None = None, chunks: int | None = None) -> None:
    """Cells sorted by range of the index, so later windows skip row groups; ``partition`` axes become folders."""
    df = cube.df.repartitionByRange(chunks, *cube.index) if chunks else cube.df
    writer = df.sortWithinPartitions(*cube.index).write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition) if partition else writer).save(f"{path}/cells")
    cube.df.sparkSession.createDataFrame([(cube.dims.to_json(), list(cube.attrs), fmt)], "dims string, attrs array<string>, fmt string").coalesce(1).write.mode("overwrite").parquet(f"{path}/dims")


def read_cube(spark: SparkSession, path: str, attrs: list[str] | None = None, window: dict[str, slice] | None = None, na: float | None = None) -> Cube:
    """A lazy cube; ``attrs`` prune columns, ``window`` is a pushed range filter, ``na`` turns a sentinel into missing."""
    head = spark.read.parquet(f"{path}/dims").first()
    dims = Dimensions.from_json(head.dims)
    names = attrs or list(head.attrs)
    df = spark.read.format(head.fmt).load(f"{path}/cells").select(*[F.col(n).cast("int").alias(n) for n in dims.names], *names)
    if na is not None:
        df = df.withColumns({a: F.nullif(F.col(a), F.lit(na)) for a in names})
    cube = Cube(df, dims, tuple(names))
    return cube.isel(**window) if window else cube


def read_many(spark: SparkSession, paths: list[str], along: str | None = None) -> Cube:
    """Several stored cubes, bound as attributes or concatenated along an axis."""
    first, *rest = [read_cube(spark, p) for p in paths]
    return first.concat(*rest, along=along) if along else first.bind(*rest)


def pivot_series(table: DataFrame, time: str, other: str, value: str) -> Cube:
    """A time-by-other table as a cube."""
    return Cube.from_table(table.select(time, other, value), [time, other])
