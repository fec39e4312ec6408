"""Cube operators on small arrays with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom import Cube, Dim, Dimensions
from cubeloom.dims import tiles
from cubeloom.operators.aggregate import time_breaks
from cubeloom.sources import read_cube, write_cube


def array_of(cube, attr=None):
    out = np.full(cube.dims.shape, np.nan)
    for r in cube.df.collect():
        if r[attr or cube.attrs[0]] is not None:
            out[tuple(r[n] - 1 for n in cube.index)] = r[attr or cube.attrs[0]]
    return out


@pytest.fixture(scope="module")
def b1(spark):
    days = [dt.date(2019, 2, 20) + dt.timedelta(days=k) for k in range(6)]
    dims = Dimensions((Dim("x", 10, 0.0, 1.0), Dim("y", 12, 12.0, -1.0), Dim.of("t", days)), ("x", "y"))
    return Cube.from_arrays(spark, {"a": np.arange(1.0, 721).reshape((10, 12, 6), order="F")}, dims)


def test_block_means(b1):
    got = array_of(b1.aggregate_blocks({"x": 5, "y": 6}, "mean"))
    want = {(0, 0): [28, 148, 268, 388, 508, 628], (1, 0): [33, 153, 273, 393, 513, 633], (0, 1): [88, 208, 328, 448, 568, 688], (1, 1): [93, 213, 333, 453, 573, 693]}
    assert all(got[k].tolist() == v for k, v in want.items())
    exact = array_of(b1.aggregate_rectangles([(0, 6, 5, 12), (5, 6, 10, 12), (0, 0, 5, 6), (5, 0, 10, 6)]))
    assert np.allclose(exact, [want[k] for k in ((0, 0), (1, 0), (0, 1), (1, 1))])


def test_time_groups(b1):
    ten = [dt.date(2019, 2, 18) + dt.timedelta(days=k) for k in range(10)]
    got = b1.aggregate_breaks("t", ten, "mean")
    assert got.dims["t"].n == 10 and np.isnan(array_of(got)).sum() == 480
    assert np.isnan(array_of(b1.aggregate_time("t", "days", "mean"))).sum() == 0
    by = b1.aggregate_by("t", lambda v: v.timetuple().tm_yday, "mean")
    assert list(by.dims["t"].coords()) == [51, 52, 53, 54, 55, 56]
    assert time_breaks(dt.date(2024, 1, 30), dt.date(2024, 3, 1), "months") == [dt.date(2024, m, 1) for m in (1, 2, 3, 4)]


def test_downsample(spark):
    dims = Dimensions((Dim("x", 11, 0.0, 1.0), Dim("y", 11, 0.0, 1.0)), ("x", "y"))
    c = Cube.from_arrays(spark, {"a": np.arange(1.0, 122).reshape((11, 11), order="F")}, dims)
    keep = array_of(c.downsample({"x": 1, "y": 1}))
    assert keep.shape == (6, 6) and keep[:3, 0].tolist() == [1, 3, 5]
    one = array_of(c.downsample({"x": 1, "y": 1}, {"x": 1, "y": 1}))
    assert one.shape == (5, 5) and one[0, 0] == 13
    mean = array_of(c.downsample({"x": 1, "y": 1}, fun="mean"))
    assert mean.shape == (5, 5) and mean[0, 0] == 7 and mean[1, 0] - mean[0, 0] == 2 and mean[0, 1] - mean[0, 0] == 22
    assert array_of(c.downsample({"x": 1, "y": 1}, {"y": 1}, fun="mean"))[0, 0] == 18


def test_missing_values(spark):
    dims = Dimensions((Dim("x", 2, 0.0, 1.0), Dim("y", 2, 2.0, -1.0)), ("x", "y"))
    c = Cube.from_arrays(spark, {"a": np.array([[10.0, 30.0], [20.0, np.nan]])}, dims)
    assert array_of(c.aggregate_rectangles([(0, 0, 2, 2)], "mean", na_rm=True)).tolist() == [20]
    assert np.isnan(array_of(c.aggregate_rectangles([(0, 0, 2, 2)], "mean")))[0]
    assert np.isnan(array_of(c.apply(["x"], "sum"))).tolist() == [False, True]
    assert array_of(c.apply(["x"], "sum", na_rm=True)).tolist() == [40, 20]
    assert c.is_na().df.where("a").count() == 1
    assert array_of(c.replace_na(a=0.0)).sum() == 60
    assert c.ops("/", 0).df.where("a = double('Infinity')").count() == 3


def test_axes():
    assert Dim.of("x", [0, 1, 2, 3]).regular and not Dim.of("x", [1, 2, 3, 4, 6]).regular
    edge = Dim.of("y", [0.3, 0.5, 1, 2, 2.2], cells=4)
    assert edge.n == 4 and edge.kind == "rectilinear" and edge.bounds() == (0.3, 2.2)
    assert Dim.of("x", [0, 1, 2, 3, 4], cells=4).regular
    with pytest.raises(ValueError, match="values for"):
        Dim.of("x", [1, 2, 3, 4, 5, 6], cells=4)
    with pytest.raises(ValueError, match="finite"):
        Dim.of("x", [1.0, float("inf")])
    d = Dim("x", 10, 100.0, 5.0)
    assert d.take([3, 4, 5]).at(1) == 110 and d.take([3, 4, 5]).regular and d.take([3, 5]).values == (110.0, 120.0)
    affine = Dimensions((Dim("x", 3, 0.0, 1.0), Dim("y", 3, 3.0, -1.0)), ("x", "y"), affine=(0.2, -0.2))
    assert affine.raster_type() == "affine" and np.allclose(affine.bbox(), (0.0, -0.6, 3.6, 3.0))
    assert Dimensions.from_json(affine.to_json()) == affine
    assert [len(tiles(10, 10, w, w, o)) for w, o in ((10, 0), (5, 0), (1, 0), (5, 5))] == [1, 4, 100, 4]
    assert len(tiles(10, 10, 9, 5)) == 4


def test_round_trips(b1):
    parts = b1.split("t")
    back = parts.merge("t", "a")
    assert np.allclose(array_of(back), array_of(b1)) and back.dims["t"].n == 6
    joined = b1.isel(t=slice(1, 2)).concat_time(b1.isel(t=slice(3, 6)), along="t")
    assert joined.dims.same(b1.dims) and np.allclose(array_of(joined), array_of(b1))
    with pytest.raises(ValueError, match="overlap"):
        b1.concat_time(b1, along="t")
    assert np.allclose(array_of(b1.flip("x", "t")), array_of(b1)[::-1, :, ::-1])
    assert np.allclose(array_of(b1.aperm()), array_of(b1).T)
    with pytest.raises(ValueError, match="leading"):
        b1 + b1.apply(["t"], "mean")
    with pytest.raises(IndexError):
        b1.isel(x=11)


def test_points_and_polygons(spark, b1):
    c = b1.slice("t", 1)
    pts = spark.createDataFrame([(1, 0.5, 11.5), (2, 9.9, 0.1), (3, 50.0, 1.0)], "pid int, px double, py double")
    got = {r.pid: r.a for r in c.extract(pts).collect()}
    assert got == {1: 1.0, 2: 120.0, 3: None}
    assert {r.pid: r.cell for r in c.cell_ids(pts).collect()} == {1: 1, 2: 120, 3: None}
    inner = c.crop_polygon([(0, 12), (5, 12), (5, 6), (0, 6)])
    assert inner.df.count() == 30 and inner.df.agg(F.avg("a")).first()[0] == 28
    assert array_of(c.aggregate_polygons([[(0, 12), (5, 12), (5, 6), (0, 6)], [(-9, -9), (-8, -9), (-8, -8)]], "mean"))[0] == 28
    mosaic = c.isel(x=slice(1, 6)).mosaic(c.isel(x=slice(4, 10)) * 10)
    assert mosaic.dims["x"].n == 10 and array_of(mosaic)[3, 0] == 40


def test_store_pushes_windows(b1, tmp_path):
    write_cube(b1, str(tmp_path / "c"))
    back = read_cube(b1.df.sparkSession, str(tmp_path / "c"), window={"x": slice(2, 4)})
    assert back.dims["x"].at(1) == 1.0 and np.allclose(array_of(back), array_of(b1)[1:4])
    assert "PushedFilters: [IsNotNull(x)" in back.df._jdf.queryExecution().toString() or "GreaterThanOrEqual(x,2)" in back.df._jdf.queryExecution().toString()


def test_stream(spark, tmp_path):
    from cubeloom.streaming import append_slices, bucket_stream

    src = str(tmp_path / "in")
    for part in (("2024-01-01 10:00:00", "2024-01-01 11:00:00"), ("2024-01-09 00:00:00",)):
        spark.createDataFrame([(t, "k", 2.0) for t in part], "t string, k string, v double").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("t timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(src)
    q = append_slices(bucket_stream(stream, "t", ["k"], "v"), str(tmp_path / "out"), str(tmp_path / "cp"), "t")
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 4.0)]


def test_moving_boxes(spark):
    rnd = np.random.default_rng(4)
    a = np.round(rnd.normal(size=(7, 9)), 3)
    a[2, 3] = a[0, 0] = np.nan
    dims = Dimensions((Dim("x", 7, 0.0, 1.0), Dim("y", 9, 0.0, 1.0)), ("x", "y"))
    full = Cube.from_arrays(spark, {"a": a}, dims)
    sparse = full.with_df(full.df.where("not isnan(a)"))  # the missing cells are absent rows
    for fun, f in {"sum": np.nansum, "mean": np.nanmean, "min": np.nanmin, "max": np.nanmax, "length": lambda v: np.count_nonzero(~np.isnan(v))}.items():
        want, strict = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
        for i in range(7):
            for j in range(9):
                box = a[max(0, i - 1) : i + 2, max(0, j - 2) : j + 3]
                want[i, j] = f(box)
                if box.size == 15 and not np.isnan(box).any():
                    strict[i, j] = f(box)
        for c in (full, sparse):
            assert np.allclose(array_of(c.focal({"x": 1, "y": 2}, fun, na_rm=True)), want)
            assert np.allclose(array_of(c.focal({"x": 1, "y": 2}, fun)), strict, equal_nan=True)
    with pytest.raises(ValueError, match="moving boxes"):
        full.focal({"x": 1}, "median")
    assert full.with_df(full.df.limit(0)).focal({"x": 1}, "sum").df.where("a is not null").count() == 0


def test_trends_stretches_and_classes(spark):
    a = np.arange(1.0, 41).reshape((4, 10))
    a[1] = 5.0
    c = Cube.from_arrays(spark, {"a": a}, Dimensions((Dim("b", 4, 0, 1), Dim("t", 10, 100.0, 2.0))))
    assert array_of(c.trend("t")).tolist() == [0.5, 0.0, 0.5, 0.5]
    got = array_of(c.stretch("b", (0.1, 0.9)))
    low, high = np.quantile(a[0], [0.1, 0.9])
    assert np.allclose(got[0], np.clip((a[0] - low) / (high - low), 0, 1)) and np.isnan(got[1]).all()
    assert c.breaks(3) == [1.0, 14.0, 27.0, 40.0] and c.breaks(2, "quantile") == [1.0, float(np.median(a)), 40.0]
    assert [r.n for r in c.histogram([1, 5, 20, 30, 35.5]).orderBy("bin").collect()] == [15, 5, 10, 5]  # row of 1..10, ten fives, 21..30, 31..35
    big = c.stack_axes(c * 2, along={"k": ["p", "q"], "m": [7]})
    assert big.dims.shape == (4, 10, 2, 1) and array_of(big)[0, 9].tolist() == [[10.0], [20.0]]
    with pytest.raises(ValueError, match="multiply"):
        c.stack_axes(c, along={"k": [1, 2, 3]})


def test_gamma_family(spark):
    import math

    v = np.array([0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 25.5, -0.5, -1.5, -2.25])
    c = Cube.from_arrays(spark, {"a": v}, Dimensions((Dim("x", len(v), 0, 1),)))
    assert np.allclose(array_of(c.math("lgamma")), [math.lgamma(x) for x in v], atol=1e-12)
    assert np.allclose(array_of(c.math("gamma")), [math.gamma(x) for x in v], rtol=1e-11)
    h = 1e-5  # derivatives by differences
    assert np.allclose(array_of(c.math("digamma")), [(math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h) for x in v], rtol=1e-6, atol=1e-6)
    near = lambda d: array_of((c + d).math("digamma"))
    assert np.allclose(array_of(c.math("trigamma")), (near(h) - near(-h)) / (2 * h), rtol=1e-5)
    assert abs(array_of(c.math("digamma"))[2] + 0.5772156649015329) < 1e-12 and abs(array_of(c.math("trigamma"))[2] - math.pi**2 / 6) < 1e-12
    pole = Cube.from_arrays(spark, {"a": np.array([0.0, -3.0])}, Dimensions((Dim("x", 2, 0, 1),)))
    assert np.isposinf(array_of(pole.math("lgamma"))).all() and np.isnan(array_of(pole.math("digamma"))).all()


def test_cubic_interpolation(spark):
    x, y = np.meshgrid(np.arange(8) + 0.5, np.arange(6) + 0.5, indexing="ij")
    dims = Dimensions((Dim("x", 8, 0.0, 1.0), Dim("y", 6, 0.0, 1.0)), ("x", "y"))
    c = Cube.from_arrays(spark, {"a": 2 * x - 3 * y + x * y}, dims)
    points = spark.createDataFrame([(1, 3.2, 2.9), (2, 4.5, 3.5), (3, 0.4, 3.0)], "pid int, px double, py double")
    got = {r.pid: r.a for r in c.extract_cubic(points).collect()}
    assert got[1] == pytest.approx(2 * 3.2 - 3 * 2.9 + 3.2 * 2.9) and got[2] == pytest.approx(9 - 10.5 + 15.75) and got[3] is None


def test_cubic_interpolation_plan(spark):
    """Sixteen rows a point are never broadcast, however small the points look; a small cube is."""
    points = spark.range(3000).selectExpr("id as pid", "id % 50 * 0.9 + 2.3 as px", "id div 50 * 0.7 + 2.1 as py")
    for nx, ny, wanted, other in ((60, 50, "BroadcastHashJoin", "SortMergeJoin"), (250, 100, "SortMergeJoin", "Broadcast")):
        cells = spark.range(nx * ny).selectExpr(f"cast(id % {nx} + 1 as int) as x", f"cast(id div {nx} + 1 as int) as y")
        c = Cube(cells.selectExpr("x", "y", "2 * (x - 0.5D) - 3 * (y - 0.5D) + (x - 0.5D) * (y - 0.5D) as a"), Dimensions((Dim("x", nx, 0.0, 1.0), Dim("y", ny, 0.0, 1.0)), ("x", "y")), ("a",))
        got = c.extract_cubic(points)
        text = got._jdf.queryExecution().executedPlan().toString()
        assert wanted in text and other not in text and "Generate" not in text.partition("BroadcastExchange")[2]
        rows = got.join(points, "pid").collect()
        assert len(rows) == 3000 and all(r.a == pytest.approx(2 * float(r.px) - 3 * float(r.py) + float(r.px) * float(r.py)) for r in rows)


def test_moving_boxes_plan(spark):
    """Lines are shuffled once an axis; no nested loops and no single partition."""
    from cubeloom.plans import scan_report

    c = Cube.from_bbox(spark, (0, 0, 30, 20), nx=30, ny=20).focal({"x": 1, "y": 1}, "mean")
    text = c.df._jdf.queryExecution().executedPlan().toString()
    assert 2 <= scan_report(c.df)["exchanges"] <= 4 and "NestedLoop" not in text and "SinglePartition" not in text


def test_classes_areas_and_semi_joins(spark):
    c = Cube.from_arrays(spark, {"a": np.arange(12.0).reshape(4, 3), "b": np.full((4, 3), 5.0)}, Dimensions((Dim("x", 4, 0.0, 90.0), Dim("y", 3, 90.0, -60.0)), ("x", "y")))
    cut = c.cut(2, labels=["low", "high"])
    rows = cut.df.collect()
    assert all(r.a == ("low" if r.x <= 2 else "high") for r in rows) and len(rows) == 12
    assert {r.b for r in rows} == {"low"}  # one value lies in the middle, and classes close on the right
    with pytest.raises(ValueError, match="labels"):
        c.cut([0, 1, 2], labels=["one"])
    with pytest.raises(ValueError, match="two"):
        c.cut(1)
    assert sum(r.area for r in c.area(radius=2.0).df.collect()) == pytest.approx(4 * np.pi * 4)
    points = spark.createDataFrame([(1, 10.0, 80.0), (2, 11.0, 80.0), (3, 300.0, -80.0), (4, 999.0, 0.0), (5, None, 1.0)], "pid int, px double, py double")
    semi = c.join_semi(points)
    assert sorted((r.x, r.y, r.a) for r in semi.df.collect()) == [(1, 1, 0.0), (4, 3, 11.0)] and semi.dims.shape == (4, 3)
    assert c.join_semi(points.limit(0)).df.count() == 0
    assert c.dims.resolution() == {"x": 90.0, "y": 60.0} and c.dims.resolution(absolute=False)["y"] == -60.0
    assert c.dims.with_bbox((0, -30, 8, 30)).bbox() == (0, -30, 8, 30) and c.dims.with_bbox((0, -30, 8, 30)).resolution(absolute=False) == {"x": 2.0, "y": -20.0}
    with pytest.raises(ValueError, match="regular"):
        c.isel(x=slice(2, 3)).dims.with_bbox((0, 0, 1, 1))
    filled = c.isel(y=[1, 3]).mask(F.col("a") < 5).fill("w", [1, 2, 3, 4])
    assert sorted((r.x, r.y, r.w) for r in filled.df.collect()) == [(x, y, x) for x in (1, 2, 3, 4) for y in (1, 2)]
    assert filled.drop("a", "b").attrs == ("w",)
    for wrong in ([], [1] * 5):
        with pytest.raises(ValueError, match="values"):
            c.fill("w", wrong)
    with pytest.raises(ValueError, match="without"):
        c.drop("a", "b")
