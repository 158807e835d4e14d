"""Changes of the mesh: pole extension, shifts, subsets, merges, regridding and interpolation between grids."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.functions import geometry
from tesseral.grid import Grid, densify


def extend_to_poles(cells: DataFrame, grid: Grid, fields: list[str], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, masks: dict[str, bool] | None = None) -> tuple[DataFrame, Grid]:
    """cells on the grid extended to the poles; new cells have 0 in fields and the given value in masks."""
    keys = ["itime", "idepth"] if keys is None else keys
    wide, south = grid.extended(cfg)
    moved = cells.withColumn("ilat", F.col("ilat") + south)
    dense = densify(moved.withColumn("__own", F.lit(True)), wide, keys)
    new = F.col("__own").isNull()
    fill = {f: 0.0 for f in fields} | (masks or {})
    return dense.select(*[F.when(new, F.lit(fill[c])).otherwise(F.col(c)).alias(c) if c in fill else F.col(c) for c in cells.columns]), wide


def mask_poles(cells: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), water: str = "water") -> DataFrame:
    """cells whose water column is false within 0.05 degrees of a pole; nothing changes on a plane."""
    if cfg.cartesian:
        return cells
    lat = grid.lat_dim(cells.sparkSession, cfg).select("ilat", "lat")
    df = cells.join(F.broadcast(lat), "ilat")
    return df.select(*[(F.col(c) & F.expr(geometry.not_polar("lat"))).alias(c) if c == water else F.col(c) for c in cells.columns])


def roll(cells: DataFrame, grid: Grid, by: int = 1) -> DataFrame:
    """Every cell moves by columns along the circle of longitude."""
    return cells.withColumn("ilon", F.pmod(F.col("ilon") + by, F.lit(grid.nlon)).cast("int"))


def subset(cells: DataFrame, **axes: tuple[int, int, int]) -> DataFrame:
    """A strided slice: axis=(first, last, step); indices are renumbered."""
    for axis, (lo, hi, step) in axes.items():
        cells = cells.where(F.col(axis).between(lo, hi) & ((F.col(axis) - lo) % step == 0)).withColumn(axis, ((F.col(axis) - lo) / step).cast("int"))
    return cells


def decimate(cells: DataFrame, lat_step: int, lon_step: int) -> DataFrame:
    """Every k-th row and column."""
    return subset(cells, ilat=(0, 1 << 30, lat_step), ilon=(0, 1 << 30, lon_step))


def merge_scales(parts: dict[float, DataFrame]) -> DataFrame:
    """Results of several scales as one table with the key ell, by size of the scale."""
    out = None
    for ell, df in sorted(parts.items()):
        one = df.withColumn("ell", F.lit(float(ell)))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("nothing to merge")
    return out


def merge_resolutions(parts: list[tuple[int, DataFrame]], keys: list[str]) -> DataFrame:
    """Union of tables with a priority: where several hold the same keys, the rows of the highest resolution stay."""
    out = None
    for size, df in parts:
        one = df.withColumn("__size", F.lit(size))
        out = one if out is None else out.unionByName(one)
    best = Window.partitionBy(*keys).orderBy(F.desc("__size"))
    return out.withColumn("__rank", F.rank().over(best)).where("__rank = 1").drop("__rank", "__size")


def merge_results(parts: dict[float, dict[str, DataFrame]], exclude: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Post-processed tables of several scales, {scale: {kind: table}}, as one table a kind; kinds of `exclude` are left out."""
    kinds = sorted({k for own in parts.values() for k in own} - set(exclude))
    return {k: merge_scales({ell: own[k] for ell, own in parts.items() if k in own}) for k in kinds}


def merge_times(parts: list[DataFrame], time: str = "itime") -> DataFrame:
    """Tables one after another in time; indices are renumbered by their order over all parts."""
    out = None
    for k, df in enumerate(parts):
        one = df.withColumn("__part", F.lit(k))
        out = one if out is None else out.unionByName(one)
    times = out.select("__part", time).distinct().withColumn("__new", F.row_number().over(Window.orderBy("__part", time)) - 1)
    return out.join(F.broadcast(times), ["__part", time]).drop("__part", time).withColumnRenamed("__new", time)


def _bounds(axis: tuple[float, ...]) -> list[tuple[float, float]]:
    middle = [(a + b) / 2 for a, b in zip(axis, axis[1:], strict=False)]
    return list(zip([axis[0], *middle], [*middle, axis[-1]], strict=True))


def _inclusive_boxes(fine: tuple[float, ...], coarse: tuple[float, ...], name: str, spark) -> DataFrame:  # noqa: ANN001
    """(i<name>, c<name>): fine cells from the first at or beyond a coarse cell's lower bound to the first at or beyond its upper bound, both included."""
    rows = []
    for k, (lo, hi) in enumerate(_bounds(coarse)):
        a, b = (min(bisect_left(fine, x), len(fine) - 1) for x in (lo, hi))
        rows += [(i, k) for i in range(a, b + 1)]
    return spark.createDataFrame(rows, f"i{name} int, c{name} int")


def coarsen_linear(cells: DataFrame, fine: Grid, coarse: Grid, field: str, keys: list[str] | None = None, water: str = "true") -> DataFrame:
    """(keys, ilat, ilon, <field>, water, seed_count): unweighted means of water cells in boxes with inclusive ends; land where land has the majority."""
    keys = ["itime", "idepth"] if keys is None else keys
    spark = cells.sparkSession
    df = cells.join(F.broadcast(_inclusive_boxes(fine.lats, coarse.lats, "lat", spark)), "ilat").join(F.broadcast(_inclusive_boxes(fine.lons, coarse.lons, "lon", spark)), "ilon")
    wet = F.expr(water)
    sums = df.groupBy(*keys, F.col("clat").alias("ilat"), F.col("clon").alias("ilon")).agg(F.avg(F.when(wet, F.col(field))).alias("mean"), F.sum(wet.cast("int")).alias("seed_count"), F.sum((~wet).cast("int")).alias("land"))
    good = (F.col("seed_count") > 0) & (F.col("seed_count") >= F.col("land"))
    return sums.select(*keys, "ilat", "ilon", F.when(good, F.col("mean")).otherwise(0.0).alias(field), good.alias("water"), "seed_count")


def _brackets(source: tuple[float, ...], target: tuple[float, ...], name: str, spark) -> DataFrame:  # noqa: ANN001
    """(t<name>, i<name>, w<name>): two source cells and weights for each target; beyond the ends lines go on (extrapolation)."""
    rows = []
    for k, x in enumerate(target):
        b = min(max(bisect_left(source, x), 1), len(source) - 1)
        a = b - 1
        w = (x - source[a]) / (source[b] - source[a])
        rows += [(k, a, 1 - w), (k, b, w)]
    return spark.createDataFrame(rows, f"t{name} int, i{name} int, w{name} double")


def refine_bilinear(cells: DataFrame, coarse: Grid, fine: Grid, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, ilat, ilon, <fields>): bilinear values on a finer grid, extrapolated at the edges."""
    keys = ["itime", "idepth"] if keys is None else keys
    spark = cells.sparkSession
    df = cells.join(F.broadcast(_brackets(coarse.lats, fine.lats, "lat", spark)), "ilat").join(F.broadcast(_brackets(coarse.lons, fine.lons, "lon", spark)), "ilon")
    return df.groupBy(*keys, F.col("tlat").alias("ilat"), F.col("tlon").alias("ilon")).agg(*[F.sum(F.col("wlat") * F.col("wlon") * F.col(f)).alias(f) for f in fields])


def nearest_regrid(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """cells on the target grid by the nearest row and column; ties go to the lower index, targets beyond the ends take the end."""
    spark = cells.sparkSession

    def near(a: tuple[float, ...], b: tuple[float, ...], name: str) -> DataFrame:
        return spark.createDataFrame([(k, min(range(len(a)), key=lambda i: (abs(a[i] - x), i))) for k, x in enumerate(b)], f"t{name} int, i{name} int")

    df = cells.join(F.broadcast(near(source.lats, target.lats, "lat")), "ilat").join(F.broadcast(near(source.lons, target.lons, "lon")), "ilon")
    return df.drop("ilat", "ilon").withColumnRenamed("tlat", "ilat").withColumnRenamed("tlon", "ilon").select(*cells.columns)


def interpolate_times(cells: DataFrame, source: list[float], target: list[float], fields: list[str], time: str = "itime") -> DataFrame:
    """cells at other times by linear interpolation; times outside the source's range give no rows."""
    rows = []
    for k, x in enumerate(target):
        if source[0] <= x <= source[-1]:
            b = min(max(bisect_left(source, x), 1), len(source) - 1)
            w = (x - source[b - 1]) / (source[b] - source[b - 1])
            rows += [(k, b - 1, 1 - w), (k, b, w)]
    table = cells.sparkSession.createDataFrame(rows, f"__t int, `{time}` int, __w double")
    rest = [c for c in cells.columns if c not in (*fields, time)]
    return cells.join(F.broadcast(table), time).groupBy(F.col("__t").alias(time), *rest).agg(*[F.sum(F.col("__w") * F.col(f)).alias(f) for f in fields])


def coast(cells: DataFrame, grid: Grid, reach: int = 20, keys: list[str] | None = None, water: str = "water") -> DataFrame:
    """Water cells within `reach` steps (rows plus columns) of land.

    A distance transform by running extremes: along each circle of latitude, opened and padded by `reach` of its own cells, the nearest land on either side; then,
    along each meridian, the least of that and of the steps between rows. Every cell is sorted twice and stays one row.
    """
    keys = ["itime", "idepth"] if keys is None else keys
    n, pad = grid.nlon, min(reach, grid.nlon)
    copies = F.array(F.lit(0), F.when(F.col("ilon") >= n - pad, F.lit(-n)), F.when(F.col("ilon") < pad, F.lit(n)))
    df = cells.withColumn("__shift", F.explode(F.filter(copies, lambda x: x.isNotNull()))).withColumn("__at", F.col("ilon") + F.col("__shift"))
    land = F.when(~F.col(water), F.col("__at"))
    east = Window.partitionBy(*keys, "ilat").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    west = Window.partitionBy(*keys, "ilat").orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__d", F.least(F.col("__at") - F.max(land).over(east), F.min(land).over(west) - F.col("__at"))).where("__shift = 0")
    north = Window.partitionBy(*keys, "ilon").orderBy("ilat").rowsBetween(Window.unboundedPreceding, 0)
    south = Window.partitionBy(*keys, "ilon").orderBy(F.desc("ilat")).rowsBetween(Window.unboundedPreceding, 0)
    steps = F.least(F.min(F.col("__d") - F.col("ilat")).over(north) + F.col("ilat"), F.min(F.col("__d") + F.col("ilat")).over(south) - F.col("ilat"))
    return df.withColumn("__steps", steps).where(F.col(water) & (F.col("__steps") <= reach)).select(*[F.col(f"`{c}`") for c in cells.columns])
