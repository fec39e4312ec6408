"""Registered queries: cubes from the driver's tables, one cube operator, the long form; each with DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cube import Cube
from .dims import Dim, Dimensions, tiles
from .operators.spatial import rotate_pole, web_mercator

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:  # rounding may leave -0.0 there and 0.0 here: adding 0 makes it 0.0
            ORACLES[f.__name__] = re.sub(r"\bround\(", "0e0 + round(", sql)
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------- cubes


def raster(spark: SparkSession, d: str) -> Cube:
    """Embeddings as a raster: x is the component, y the vector."""
    e = _table(spark, d, "embeddings")
    nx, ny = e.agg(F.max(F.size("embedding")), F.max("vec_id")).first()
    cells = e.select((F.col("vec_id") + 1).cast("int").alias("y"), F.posexplode("embedding").alias("p", "v"))
    dims = Dimensions((Dim("x", nx, 0.0, 1.0), Dim("y", ny + 1, 0.0, 1.0)), ("x", "y"))
    return Cube(cells.select((F.col("p") + 1).cast("int").alias("x"), "y", F.col("v").cast("double").alias("v")), dims, ("v",))


Q = "q as (select unnest(generate_series(1, len(embedding))) as x, vec_id + 1 as y, cast(unnest(embedding) as double) as v from embeddings)"


def sales(spark: SparkSession, d: str) -> Cube:
    """Revenue by return flag, line status and ship day."""
    li = _table(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return Cube.from_table(rows, ["flag", "status", "day"], unique=True)


SALES = "s as (select l_returnflag as flag, l_linestatus as status, cast(l_shipdate as date) as day, sum(l_extendedprice * (1 - l_discount)) as revenue from lineitem group by all)"


def event_days(spark: SparkSession, d: str) -> Cube:
    """Event counts and values by type and day."""
    rows = _table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("total"))
    return Cube.from_table(rows, ["event_type", "day"], unique=True)


EVENTS = "e as (select event_type, cast(ts as date) as day, cast(count(*) as double) as n, sum(value) as total from events group by all)"


def parts(spark: SparkSession, d: str) -> Cube:
    """Mean price and count by size and brand; not every cell is there."""
    rows = _table(spark, d, "part").groupBy(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("price"), F.count("*").cast("double").alias("n"))
    return Cube.from_table(rows, ["size", "brand"], unique=True)


PARTS = "p as (select p_size as size, p_brand as brand, avg(p_retailprice) as price, cast(count(*) as double) as n from part group by all)"


def _rounded(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _sized(df: DataFrame) -> DataFrame:
    """The size axis as the integer it was."""
    return df.withColumn("size", F.col("size").cast("int"))


# ------------------------------------------------------- projections, math


@_query(f"with {SALES} select flag, status, round(sum(revenue), 4) as sum from s group by all")
def sales_by_flag(spark, d):
    return _rounded(sales(spark, d).apply(["flag", "status"], "sum", na_rm=True).long(), "sum")


@_query(f"with {PARTS} select size, brand, round(price, 4) as price, n from p")
def cube_from_table(spark, d):
    return _sized(_rounded(parts(spark, d).long(), "price"))


@_query(f"with {Q} select x, y, round(v * 2 + 1, 6) as v from q")
def ops_scalar(spark, d):
    return _rounded((raster(spark, d) * 2 + 1).df, "v", digits=6)


@_query(f"with {Q}, r as (select x, avg(v) as m from q group by 1) select q.x, q.y, round(v - m, 4) as v from q join r using (x)")
def ops_recycle(spark, d):
    c = raster(spark, d)
    return _rounded((c - c.apply(["x"], "mean")).df, "v")


@_query(f"with {Q} select x, y, round(case when v > 0 then v else 0 end, 6) as v from q")
def mask_assign(spark, d):
    return _rounded(raster(spark, d).assign(F.col("v") <= 0, 0.0).df, "v", digits=6)


@_query(f"with {Q} select x, y, v >= 0.1 as v from q")
def ops_compare(spark, d):
    return raster(spark, d).ops(">=", 0.1).df


@_query(f"with {Q} select x, y, round(v * 10 - 3 * floor(v * 10 / 3), 4) as m, cast(floor(v * 10 / 3) as double) as f from q")
def ops_modulo(spark, d):
    c = raster(spark, d) * 10
    return _rounded((c % 3).rename(m="v").bind((c // 3).rename(f="v")).df, "m")


@_query(f"with {Q} select x, y, case when v > 0 then round(ln(v), 4) end as v from q where v > 0")
def math_log(spark, d):
    return _rounded(raster(spark, d).mask(F.col("v") > 0).math("log").df, "v")


@_query(f"with {PARTS}, g as (select a.size, b.brand from (select distinct size from p) a, (select distinct brand from p) b) select cast(g.size as double) as size, g.brand, p.n is null as n from g left join p on p.size = g.size and p.brand = g.brand")
def is_na_cells(spark, d):
    return parts(spark, d).select("n").is_na().long().withColumn("size", F.col("size").cast("double"))


@_query(f"with {PARTS}, g as (select a.size, b.brand from (select distinct size from p) a, (select distinct brand from p) b) select cast(g.size as double) as size, g.brand, coalesce(p.n, 0) as n from g left join p on p.size = g.size and p.brand = g.brand")
def replace_na_cells(spark, d):
    return parts(spark, d).select("n").replace_na(n=0.0).long().withColumn("size", F.col("size").cast("double"))


@_query(f"with {Q} select x, y, case when v > -1 and v <= -0.1 then '(-1,-0.1]' when v > -0.1 and v <= 0.1 then '(-0.1,0.1]' when v > 0.1 and v <= 1 then '(0.1,1]' end as v from q")
def cut_breaks(spark, d):
    return raster(spark, d).cut([-1, -0.1, 0.1, 1]).df


@_query(f"with {Q}, r as (select min(v) as a, max(v) - min(v) as w from q) select x, y, case when v <= a + w / 4 then 'a' when v <= a + w * 2 / 4 then 'b' when v <= a + w * 3 / 4 then 'c' else 'd' end as v from q, r")
def cut_classes(spark, d):
    return raster(spark, d).cut(4, labels=["a", "b", "c", "d"]).df


@_query(f"with {Q} select x, y, [1.0, 2.0, 4.0, 8.0][(x - 1 + (y - 1) * 64) % 4 + 1]::double as w from q")
def fill_repeated(spark, d):
    return raster(spark, d).fill("w", [1.0, 2.0, 4.0, 8.0]).drop("v").df


@_query(f"with {Q} select distinct x, y, round(radians(1) * (sin(radians(y)) - sin(radians(y - 1))) * 6371010.0 * 6371010.0, 0) as area from q where y <= 80")
def area_sphere(spark, d):
    return _rounded(raster(spark, d).isel(y=slice(1, 80)).area(radius=6371010.0).df, "area", digits=0)


@_query(f"with {Q} select x, y, round(v, 6) as v, x - 0.5::double as x_value from q")
def dim_to_attr(spark, d):
    return _rounded(raster(spark, d).dim_to_attr("x").df, "v", digits=6)


@_query(f"with {PARTS} select size, brand, n in (1, 3) as n from p")
def isin_values(spark, d):
    return _sized(parts(spark, d).select("n").isin([1.0, 3.0]).long())


# --------------------------------------------------------------- subsetting


@_query(f"with {Q} select x - 4 as x, y - 10 as y, round(v, 6) as v from q where x between 5 and 9 and y between 11 and 40")
def slice_index(spark, d):
    return _rounded(raster(spark, d).isel(x=slice(5, 9), y=slice(11, 40)).df, "v", digits=6)


@_query(f"with {Q}, k as (select * from (values (7, 1), (3, 2), (7, 3), (60, 4)) t(x, i)) select i as x, y, round(v, 6) as v from q join k using (x)")
def select_reordered(spark, d):
    return _rounded(raster(spark, d).isel(x=[7, 3, 7, 60]).df, "v", digits=6)


@_query(f"with {EVENTS} select event_type, day, n from e where day >= date '2024-01-10' and day < date '2024-01-20'")
def filter_coord(spark, d):
    return event_days(spark, d).select("n").filter(day=lambda v: dt.date(2024, 1, 10) <= v < dt.date(2024, 1, 20)).long()


@_query(f"with {Q} select x - 10 as x, y - 20 as y, round(v, 6) as v from q where x between 11 and 31 and y between 21 and 51")
def crop_bbox(spark, d):
    return _rounded(raster(spark, d).crop((10.2, 20.0, 30.7, 50.5)).df, "v", digits=6)


@_query(f"with {Q} select 65 - x as x, y, round(v, 6) as v from q")
def flip_x(spark, d):
    return _rounded(raster(spark, d).flip("x").df, "v", digits=6)


@_query("select cast(x * 20 as bigint) as x_off, cast(y * 30 as bigint) as y_off, cast(least(20, 64 - x * 20) as bigint) as x_size, cast(least(30, 100 - y * 30) as bigint) as y_size from range(4) t(x), range(4) u(y)")
def tile_index(spark, d):
    return spark.createDataFrame(tiles(100, 64, 20, 30), "x_off long, y_off long, x_size long, y_size long")


@_query(f"with {Q} select cast((x - 1) / 4 + 0.5 as int) + 1 as x, y, round(v, 6) as v from q where (x - 1) % 4 = 0".replace("cast((x - 1) / 4 + 0.5 as int)", "(x - 1) // 4"))
def downsample_keep(spark, d):
    return _rounded(raster(spark, d).downsample({"x": 3}).df, "v", digits=6)


@_query(f"with {Q} select (x - 1) // 5 + 1 as x, (y - 1) // 3 + 1 as y, round(avg(v), 4) as v from q where x <= 60 and y <= 3 * ((select max(y) from q) // 3) group by all")
def downsample_mean(spark, d):
    return _rounded(raster(spark, d).downsample({"x": 4, "y": 2}, fun="mean").df, "v")


# ------------------------------------------------------------- aggregation


@_query(f"with {Q} select x, round(avg(v), 4) as mean from q group by 1")
def apply_mean_x(spark, d):
    return _rounded(raster(spark, d).apply(["x"], "mean").df, "mean")


@_query(f"with {Q} select y, round(quantile_cont(v, 0.5), 5) as median from q group by 1")
def apply_median_y(spark, d):
    return _rounded(raster(spark, d).apply(["y"], "median").df, "median", digits=5)


@_query(f"with {Q}, r as (select x, min(v) as a, max(v) as b from q group by 1) select 1 as range, x, round(a, 6) as v from r union all select 2, x, round(b, 6) from r")
def apply_range(spark, d):
    return _rounded(raster(spark, d).apply_vector(["x"], {"min": "min", "max": "max"}, "range").df, "v", digits=6)


@_query(f"with {Q} select x, y, round(sum(v) over (partition by y order by x), 4) as v from q")
def apply_cumsum(spark, d):
    return _rounded(raster(spark, d).apply_along("x", lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))).df, "v")


@_query(f"with {Q} select x, y, round(avg(v) over (partition by y order by x rows between 2 preceding and 2 following), 4) as v from q")
def moving_average(spark, d):
    return _rounded(raster(spark, d).apply_along("x", lambda v, w: F.avg(v).over(w.rowsBetween(-2, 2))).df, "v")


@_query(f"with {Q}, b as (select y, max(v) filter (x = 1) as a, max(v) filter (x = 2) as b from q group by 1) select y, round((a - b) / (abs(a) + abs(b)), 4) as value from b")
def apply_band_math(spark, d):
    return _rounded(raster(spark, d).isel(x=slice(1, 2)).apply_bands("x", lambda a, b: (a - b) / (F.abs(a) + F.abs(b))).df, "value")


@_query(f"with {SALES} select flag, status, cast(date_trunc('month', day) as date) as day, round(sum(revenue), 4) as revenue from s group by all")
def agg_time_month(spark, d):
    return _rounded(sales(spark, d).aggregate_time("day", "months", "sum", na_rm=True).long(), "revenue")


@_query(f"with {EVENTS} select event_type, cast(date '2024-01-05' + cast(7 * ((day - date '2024-01-05') // 7) as int) as date) as day, sum(n) as n from e where day >= date '2024-01-05' and day < date '2024-01-26' group by all")
def agg_time_breaks(spark, d):
    return event_days(spark, d).select("n").aggregate_breaks("day", [dt.date(2024, 1, 5) + dt.timedelta(days=7 * k) for k in range(4)], "sum", na_rm=True).long()


@_query(f"with {EVENTS} select event_type, cast(isodow(day) as int) as day, sum(n) as n from e group by all")
def agg_dayofweek(spark, d):
    return event_days(spark, d).select("n").aggregate_by("day", lambda v: v.isoweekday(), "sum", na_rm=True).long().withColumn("day", F.col("day").cast("int"))


@_query(f"with {Q} select (x - 1) // 16 + 1 as x, (y - 1) // 50 + 1 as y, round(avg(v), 4) as v from q group by all")
def agg_spatial_blocks(spark, d):
    return _rounded(raster(spark, d).aggregate_blocks({"x": 16, "y": 50}, "mean", na_rm=True).df, "v")


@_query(f"with {Q}, h as (select max(y) as n from q) select (x - 1) // 24 + 1 as x, (y - 1) // 7 + 1 as y, round(avg(v), 4) as v from q where x <= 60 group by all")
def agg_blocks_ragged(spark, d):
    """Edge blocks hold fewer cells and are still whole."""
    return _rounded(raster(spark, d).isel(x=slice(1, 60)).aggregate_blocks({"x": 24, "y": 7}, "mean").df, "v")


BOXES = [(0.5, 0.5, 10.25, 20.5), (5.0, 10.0, 40.0, 60.75), (60.0, 90.0, 70.0, 95.5)]


@_query(f"""with {Q}, b as (select * from (values (1, 0.5, 0.5, 10.25, 20.5), (2, 5.0, 10.0, 40.0, 60.75), (3, 60.0, 90.0, 70.0, 95.5)) t(geometry, x0, y0, x1, y1)),
w as (select geometry, v, greatest(0, least(x, x1) - greatest(x - 1, x0)) * greatest(0, least(y, y1) - greatest(y - 1, y0)) as w from q, b)
select geometry, round(sum(w * v) / sum(w), 4) as v from w where w > 0 group by 1""")
def agg_exact_rect(spark, d):
    return _rounded(raster(spark, d).aggregate_rectangles(BOXES).df, "v")


@_query(f"with {Q} select x, y, 1.0::double as area from q")
def cell_area(spark, d):
    return raster(spark, d).area().df


# ----------------------------------------------- boxes, trends and classes


@_query(f"with {Q} select o.x, o.y, round(avg(b.v), 4) as v from q o, range(-1, 2) s(i), range(-2, 3) t(j), q b where b.x = o.x + i and b.y = o.y + j group by all")
def focal_mean(spark, d):
    return _rounded(raster(spark, d).focal({"x": 1, "y": 2}, "mean", na_rm=True).df, "v")


@_query(f"with {Q} select y, round(regr_slope(v, x - 0.5), 6) as v from q group by y")
def apply_trend(spark, d):
    return _rounded(raster(spark, d).trend("x").df, "v", digits=6)


@_query(f"with {Q}, e as (select x, quantile_cont(v, 0.02) as a, quantile_cont(v, 0.98) as b from q group by x) select q.x, y, round(greatest(0, least(1, (v - a) / (b - a))), 4) as v from q join e using (x)")
def stretch_percent(spark, d):
    return _rounded(raster(spark, d).stretch("x").df, "v")


@_query(f"with {Q}, b as (select i + 1 as bin, i / 10 - 0.5 as low, i / 10 - 0.4 as high from range(10) t(i)) select cast(bin as int) as bin, round(low, 3) as low, round(high, 3) as high, count(v) as n from b left join q on v > round(low, 1) and v <= round(high, 1) or bin = 1 and v = -0.5 group by all")
def histogram(spark, d):
    return _rounded(raster(spark, d).histogram([round(k / 10 - 0.5, 1) for k in range(11)]), "low", "high", digits=3)


@_query(f"with {Q} select x, y, round(lgamma(abs(v) * 10 + 0.25), 4) as v from q")
def math_lgamma(spark, d):
    return _rounded(raster(spark, d).transmute(v=F.abs("v") * 10 + 0.25).math("lgamma").df, "v")


@_query(f"with {Q}, g as (select v, x, y, 1 as a, 1 as b from q union all select v * 2, x, y, 2, 1 from q union all select v * 3, x, y, 1, 2 from q union all select v * 4, x, y, 2, 2 from q) select x, y, a, b, round(v, 6) as v from g")
def concat_new_axes(spark, d):
    c = raster(spark, d)
    return _rounded(c.stack_axes(c * 2, c * 3, c * 4, along={"a": ["p", "q"], "b": [10, 20]}).df, "v", digits=6)


# ------------------------------------------------------ combine and reshape


@_query(f"with {PARTS} select size, brand, 'price' as attributes, round(price, 4) as value from p union all select size, brand, 'n', n from p")
def merge_attrs(spark, d):
    return _sized(_rounded(parts(spark, d).merge().long(), "value"))


@_query(f"with {EVENTS} select day, " + ", ".join(f"max(n) filter (event_type = t[{k}]) as X{k}" for k in range(1, 6)) + " from e, (select list_sort(list(distinct event_type)) as t from e) group by day")
def split_dim(spark, d):
    c = event_days(spark, d).select("n").split("event_type")
    return c.rename(**{f"X{k + 1}": a for k, a in enumerate(c.attrs)}).long()


@_query(f"with {Q}, l as (select (x - 1) + 64 * (y - 1) as i, v from q) select cast(i % 8 + 1 as int) as a, cast(i // 8 % 8 + 1 as int) as b, cast(i // 64 + 1 as int) as c, round(v, 6) as v from l")
def redimension(spark, d):
    c = raster(spark, d)
    return _rounded(c.redimension(Dimensions((Dim("a", 8), Dim("b", 8), Dim("c", c.dims["y"].n)))).df, "v", digits=6)


@_query(f"with {Q} select case when x <= 32 then x + 32 else x - 32 end as x, y, round(v, 6) as v from q")
def concat_along(spark, d):
    c = raster(spark, d)
    return _rounded(c.isel(x=slice(33, 64)).concat(c.isel(x=slice(1, 32)), along="x").df, "v", digits=6)


@_query(f"with {Q} select x, y, round(case when x between 20 and 40 then 2 * v else v end, 6) as v from q")
def mosaic_priority(spark, d):
    c = raster(spark, d)
    return _rounded(c.isel(x=slice(1, 30)).mosaic(c.isel(x=slice(25, 64)), c.isel(x=slice(20, 40)) * 2).df, "v", digits=6)


@_query(f"with {Q} select y as a, x as b, round(v, 6) as v from q")
def aperm(spark, d):
    return _rounded(raster(spark, d).aperm("y", "x").df.withColumnsRenamed({"y": "a", "x": "b"}), "v", digits=6)


# ------------------------------------------------------------ joins, space


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Customers as points over the raster."""
    c = _table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("pid"), (F.col("c_nationkey") * 2.7 + 0.3).alias("px"), (F.col("c_custkey") % 97 + 0.6).alias("py"), F.col("c_acctbal").alias("bal"))


P = "pt as (select c_custkey as pid, c_nationkey * 2.7::double + 0.3::double as px, c_custkey % 97 + 0.6::double as py, c_acctbal as bal from customer)"


@_query(f"with {Q}, {P} select pid, round(v, 6) as v from pt left join q on q.x = floor(px) + 1 and q.y = floor(py) + 1")
def extract_points(spark, d):
    return _rounded(raster(spark, d).extract(_points(spark, d)).select("pid", "v"), "v", digits=6)


@_query(f"""with {Q}, {P}, f as (select pid, floor(px + 0.5) as i, floor(py + 0.5) as j, px + 0.5 - floor(px + 0.5) as u, py + 0.5 - floor(py + 0.5) as w from pt),
n as (select pid, i + a as x, j + b as y, (case when a = 1 then u else 1 - u end) * (case when b = 1 then w else 1 - w end) as k from f, range(2) s(a), range(2) t(b))
select pid, case when count(v) = 4 then round(sum(k * v), 4) end as v from n join q using (x, y) group by pid""")
def extract_bilinear(spark, d):
    return _rounded(raster(spark, d).extract_bilinear(_points(spark, d)).select("pid", "v"), "v")


@_query(f"""with {Q}, {P}, f as (select pid, floor(px + 0.5) as i, floor(py + 0.5) as j, px + 0.5 - floor(px + 0.5) as u, py + 0.5 - floor(py + 0.5) as w from pt),
o as (select pid, i + a as x, j + b as y, abs(u - a) as du, abs(w - b) as dw from f, range(-1, 3) s(a), range(-1, 3) t(b)),
n as (select pid, x, y, (case when du <= 1 then 1.5 * du ** 3 - 2.5 * du ** 2 + 1 else -0.5 * du ** 3 + 2.5 * du ** 2 - 4 * du + 2 end) * (case when dw <= 1 then 1.5 * dw ** 3 - 2.5 * dw ** 2 + 1 else -0.5 * dw ** 3 + 2.5 * dw ** 2 - 4 * dw + 2 end) as k from o)
select pid, case when count(v) = 16 then round(sum(k * v), 4) end as v from n join q using (x, y) group by pid""")
def extract_cubic(spark, d):
    return _rounded(raster(spark, d).extract_cubic(_points(spark, d)).select("pid", "v"), "v")


@_query(f"with {Q}, {P}, c as (select cast(floor(px) + 1 as int) as x, cast(floor(py) + 1 as int) as y, count(*) as n from pt group by 1, 2) select q.x, q.y, coalesce(n, 0) as n from q left join c on c.x = q.x and c.y = q.y")
def count_in_cells(spark, d):
    return raster(spark, d).count_points(_points(spark, d)).df


@_query(f"with {Q}, {P}, c as (select floor(px) + 1 as x, floor(py) + 1 as y, arg_max(bal, pid) as b from pt group by 1, 2) select q.x, q.y, round(coalesce(b, v), 4) as v from q left join c on c.x = q.x and c.y = q.y")
def rasterize_last(spark, d):
    return _rounded(raster(spark, d).rasterize_points(_points(spark, d), "bal", "pid").df, "v")


@_query(f"with {Q}, {P} select x, y, round(v, 6) as v from q where (x, y) in (select (floor(px) + 1, floor(py) + 1) from pt)")
def join_semi(spark, d):
    return _rounded(raster(spark, d).join_semi(_points(spark, d)).df, "v", digits=6)


@_query(f"with {Q}, {P}, c as (select floor(px) + 1 as x, floor(py) + 1 as y, min(pid) as pid from pt group by 1, 2) select q.x, q.y, round(v, 6) as v, pid from q left join c on c.x = q.x and c.y = q.y")
def join_first_match(spark, d):
    return _rounded(raster(spark, d).join_first(_points(spark, d).select("pid", "px", "py"), "pid").df, "v", digits=6)


@_query(f"with {Q} select i + 1 as x, j + 1 as y, round(v, 6) as v from range(32) s(i), range(50) t(j), q where q.x = cast(floor(i * 2 + 1) as int) + 1 and q.y = cast(floor((j + 0.5) * 1.5) as int) + 1")
def warp_nearest(spark, d):
    target = Dimensions((Dim("x", 32, 0.0, 2.0), Dim("y", 50, 0.0, 1.5)), ("x", "y"))
    return _rounded(raster(spark, d).warp(target).df, "v", digits=6)


@_query(f"with {Q} select cast(case when y - 0.5 < 30 then 1 else 2 end as int) as geometry, round(avg(v), 4) as v from q where (x - 0.5 >= 2 and x - 0.5 < 20 and y - 0.5 >= 5 and y - 0.5 < 30) or (x - 0.5 >= 10 and x - 0.5 < 40 and y - 0.5 >= 30 and y - 0.5 < 60) or false group by 1")
def agg_polygons(spark, d):
    rings = [[(2, 5), (20, 5), (20, 30), (2, 30)], [(10, 30), (40, 30), (40, 60), (10, 60)]]
    return _rounded(raster(spark, d).aggregate_polygons(rings, "mean").df, "v")


@_query(f"with {Q}, g as (select unnest(generate_series(1, 3)) as geometry), e as (select geometry, x from g, (select distinct x from q where x <= 4)) select cast(e.geometry as int) as geometry, cast(e.x as int) as band, round(a.v, 4) as v from e left join (select case when y - 0.5 < 8 then 1 else 3 end as geometry, x, avg(v) as v from q where x <= 4 and (y - 0.5 < 8 or y - 0.5 >= 10 and y - 0.5 < 20) group by all) a on a.geometry = e.geometry and a.x = e.x")
def agg_polygons_empty(spark, d):
    """A polygon without cells stays, with a missing value for each cell of the other axis."""
    c = raster(spark, d).isel(x=slice(1, 4))
    lines = Cube(c.df.select(F.col("x").alias("band"), F.lit(1).alias("x"), "y", "v"), Dimensions((Dim("band", 4), Dim("x", 1, 0.0, 1.0), c.dims["y"]), ("x", "y")), ("v",))
    rings = [[(0, 0), (1, 0), (1, 8), (0, 8)], [(5, 5), (6, 5), (6, 6)], [(0, 10), (1, 10), (1, 20), (0, 20)]]
    return _rounded(lines.aggregate_polygons(rings, "mean").df, "v")


@_query(f"with {Q} select cast(y as int) as y, round(v, 6) as v from q where x = 5")
def slice_drop(spark, d):
    return _rounded(raster(spark, d).slice("x", 5).df, "v", digits=6)


@_query(f"with {Q} select x, y, round(v, 6) as v from q where v > 0.05 and x <= 20")
def mask_by_cube(spark, d):
    c = raster(spark, d).isel(x=slice(1, 20))
    return _rounded(c.mask(c.ops(">", 0.05)).df, "v", digits=6)


@_query(f"with {P} select pid, case when floor(px) between 0 and 63 and py < (select max(vec_id) + 1 from embeddings) then cast(floor(py) * 64 + floor(px) + 1 as bigint) end as cell from pt")
def cell_ids(spark, d):
    return raster(spark, d).cell_ids(_points(spark, d)).select("pid", "cell")


@_query(f"with {Q}, {P} select pid, round(v, 6) as v from pt join q on q.x = floor(px) + 1 and q.y = floor(py) + 1")
def join_inner(spark, d):
    return _rounded(raster(spark, d).join_inner(_points(spark, d)).select("pid", "v"), "v", digits=6)


@_query(f"with {Q}, b as (select * from (values (1, 0.0, 0.0, 6.5, 9.25), (2, 30.0, 4.5, 31.0, 6.0)) t(geometry, x0, y0, x1, y1)) select geometry, round(sum(v * greatest(0, least(x, x1) - greatest(x - 1, x0)) * greatest(0, least(y, y1) - greatest(y - 1, y0))), 4) as v from q, b where x > x0 and x - 1 < x1 and y > y0 and y - 1 < y1 group by 1")
def interpolate_area(spark, d):
    return _rounded(raster(spark, d).interpolate_aw([(0.0, 0.0, 6.5, 9.25), (30.0, 4.5, 31.0, 6.0)], extensive=True).df, "v")


@_query(f"with {EVENTS} select event_type, day, n from e where day < date '2024-01-10' or day >= date '2024-01-15'")
def concat_times(spark, d):
    c = event_days(spark, d).select("n")
    early, late = c.filter(day=lambda v: v < dt.date(2024, 1, 10)), c.filter(day=lambda v: v >= dt.date(2024, 1, 15))
    return early.concat_time(late, along="day").long()


@_query(f"with {Q} select x - 3 as x, y - 5 as y, round(v, 6) as v from q where x - 0.5 >= 3 and y - 0.5 >= 5 and (x - 0.5 - 3) / 20 + (y - 0.5 - 5) / 30 < 1")
def crop_triangle(spark, d):
    return _rounded(raster(spark, d).crop_polygon([(3, 5), (23, 5), (3, 35)]).df, "v", digits=6)


@_query("select c_custkey as pid, round(radians(c_nationkey * 5.0 - 60) * 6378137.0, 2) as x, round(ln(tan(pi() / 4 + radians(c_custkey % 60 - 30.0) / 2)) * 6378137.0, 2) as y from customer")
def mercator(spark, d):
    x, y = web_mercator(F.col("c_nationkey") * 5.0 - 60, (F.col("c_custkey") % 60 - 30).cast("double"))
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@_query(f"with {Q} select x, y, x - 1::double as x0, cast(y as double) as y1, round(v, 6) as v from q where x <= 5")
def cell_polygons(spark, d):
    c = raster(spark, d).isel(x=slice(1, 5)).polygons()
    return _rounded(c.select("x", "y", F.col("geometry")[0]["x"].alias("x0"), F.col("geometry")[2]["y"].alias("y1"), "v"), "v", digits=6)


@_query(f"with {Q} select i as q, y, round((1 - f) * a.v + f * b.v, 4) as v from (select 3.25::double as i, 4 as lo, 0.25::double as f union all select 10.5, 11, 0.5) t join q a on a.x = lo join q b on b.x = lo + 1 and b.y = a.y".replace(" as q, y,", " as q, a.y,"))
def extract_time_interp(spark, d):
    times = spark.createDataFrame([(3.25,), (10.5,)], "q double")
    return _rounded(raster(spark, d).extract_time(times, "x", interpolate=True), "v")


@_query(f"with {Q}, c as (select y, " + ", ".join(f"cast(floor(greatest(0, least(255, (max(v) filter (x = {k}) + 0.5) / 1.0 * 255))) as int) as b{k}" for k in (1, 2, 3)) + " from q group by y) select y, printf('#%02X%02X%02X', b1, b2, b3) as colour from c")
def rgb_hex(spark, d):
    return raster(spark, d).isel(x=slice(1, 3)).rgb("x", top=0.5, low=-0.5).df


@_query(f"with {PARTS} select size, brand, round(2 + 0.5 * price - 3 * n, 3) as prediction from p")
def predict_linear(spark, d):
    return _rounded(parts(spark, d).predict_linear(2.0, {"price": 0.5, "n": -3.0}).long(), "prediction", digits=3).transform(_sized)


@_query(f"with {PARTS}, c as (select var_samp(price) as a, covar_samp(price, n) as b, var_samp(n) as c from p) select 1 as component, round(sqrt((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 3) as sdev from c union all select 2, round(sqrt((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)), 3) from c")
def prcomp_sdev(spark, d):
    sdev, _ = parts(spark, d).prcomp()
    return spark.createDataFrame([(k + 1, round(float(s), 3)) for k, s in enumerate(sdev)], "component int, sdev double")


@_query("""with r as (select c_custkey as pid, radians(c_nationkey * 5.0 - 60) as lam, radians(c_custkey % 60 - 30.0) as phi, radians(40.0) as pole from customer)
select pid, round(degrees(atan2(cos(phi) * sin(lam), cos(phi) * cos(lam) * sin(pole) - sin(phi) * cos(pole))) + 10, 4) as lon,
  round(degrees(asin(sin(phi) * sin(pole) + cos(phi) * cos(lam) * cos(pole))), 4) as lat from r""")
def rotated_pole(spark, d):
    lon, lat = rotate_pole(F.col("c_nationkey") * 5.0 - 60, (F.col("c_custkey") % 60 - 30).cast("double"), 10.0, 40.0)
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.round(lon, 4).alias("lon"), F.round(lat, 4).alias("lat"))


@_query(f"with {Q} select 'v' as attribute, round(min(v), 5) as q0, round(quantile_cont(v, 0.25), 5) as q1, round(median(v), 5) as q2, round(quantile_cont(v, 0.75), 5) as q3, round(max(v), 5) as q4, round(avg(v), 4) as mean, 64 * max(y) - count(v) as missing from q")
def summary(spark, d):
    return raster(spark, d).summary().select("attribute", *[F.round(F.col("q")[k], 5).alias(f"q{k}") for k in range(5)], F.round("mean", 4).alias("mean"), "missing")
