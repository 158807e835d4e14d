"""Reductions of gridded fields. Every one is a grouped aggregation with partial sums; axis tables are broadcast, fields never."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.grid import Grid
from tesseral.operators import calculus


def _area(cells: DataFrame, grid: Grid, cfg: FilterConfig) -> DataFrame:
    return cells.join(F.broadcast(grid.lat_dim(cells.sparkSession, cfg).select("ilat", "area")), "ilat")


def region_table(grid: Grid, spark, regions: dict[str, str]) -> DataFrame:  # noqa: ANN001
    """(region, ilat, ilon) of regions given as conditions on lat and lon in degrees; regions may overlap."""
    mesh = grid.lat_dim(spark, FilterConfig()).select("ilat", F.round(F.degrees("lat"), 9).alias("lat")).crossJoin(grid.lon_dim(spark).select("ilon", F.round(F.degrees("lon"), 9).alias("lon")))
    named = F.array(*[F.when(F.expr(c), F.lit(r)) for r, c in regions.items()])
    return mesh.select("ilat", "ilon", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("region")).select("region", "ilat", "ilon")


def region_areas(cells: DataFrame, regions: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, water: str | None = None) -> DataFrame:
    """(keys, region, area, water_area): area of the cells of each region, and of its water cells."""
    keys = ["itime", "idepth"] if keys is None else keys
    wet = F.col(water) if water else F.lit(True)
    df = _area(cells.withColumn("__wet", wet), grid, cfg).join(regions, ["ilat", "ilon"])
    return df.groupBy(*keys, "region").agg(F.sum("area").alias("area"), F.sum(F.when(F.col("__wet"), F.col("area")).otherwise(0.0)).alias("water_area"))


def region_mean_std(cells: DataFrame, regions: DataFrame, grid: Grid, fields: list[str], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None) -> DataFrame:
    """(keys, region, <f>_area_average, <f>_area_std_dev); nulls add nothing above but their area counts.

    One pass: cells of one row have one area, so that each row's count, mean and variance are plain ones; a region's at most nlat rows are then merged by
    weight, deviations about the region's mean.
    """
    keys = ["itime", "idepth"] if keys is None else keys
    value = lambda f: F.coalesce(F.col(f), F.lit(0.0))
    moments = [c for f in fields for c in (F.avg(value(f)).alias(f"__m_{f}"), F.var_pop(value(f)).alias(f"__v_{f}"))]
    rows = cells.join(regions, ["ilat", "ilon"]).groupBy(*keys, "region", "ilat").agg(F.count("*").alias("__n"), *moments)
    rows = _area(rows, grid, cfg).withColumn("__w", F.col("__n") * F.col("area"))
    parts = F.collect_list(F.struct("__w", *[f"__{k}_{f}" for f in fields for k in "mv"]))
    found = rows.groupBy(*keys, "region").agg(parts.alias("__rows"), F.sum("__w").alias("__area"))

    def total(term) -> Column:  # noqa: ANN001
        return F.aggregate("__rows", F.lit(0.0), lambda a, x: a + x["__w"] * term(x))

    area = F.col("__area")
    found = found.select("*", *[F.when(area == 0, F.lit(0.0)).otherwise(total(lambda x, f=f: x[f"__m_{f}"]) / area).alias(f"{f}_area_average") for f in fields])

    def spread(f: str) -> Column:
        mean = F.col(f"{f}_area_average")
        return F.sqrt(total(lambda x: x[f"__v_{f}"] + (x[f"__m_{f}"] - mean) * (x[f"__m_{f}"] - mean)) / area)

    return found.select(*keys, "region", *[f"{f}_area_average" for f in fields], *[spread(f).alias(f"{f}_area_std_dev") for f in fields])


def zonal_mean(cells: DataFrame, grid: Grid, fields: list[str], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, water: str = "true", reference: str = "true", deviations: bool = False) -> DataFrame:
    """(keys, ilat, <f>_zonal_average[, <f>_zonal_std_dev]): sums over `water` cells by the area of `reference` cells; 0 where there is none. Deviations are from that mean, over the same cells and area.

    Cells of one row have one area, which cancels: counts, means and variances are plain ones.
    """
    keys = ["itime", "idepth"] if keys is None else keys
    below = F.count(F.when(F.expr(reference if cfg.filter_over_land else water), F.lit(1))).alias("__below")
    wet = lambda f: F.when(F.expr(water), F.coalesce(F.col(f), F.lit(0.0)))
    moments = [c for f in fields for c in (F.avg(wet(f)).alias(f"__m_{f}"), F.var_pop(wet(f)).alias(f"__v_{f}"))]
    rows = cells.groupBy(*keys, "ilat").agg(below, F.count(F.when(F.expr(water), F.lit(1))).alias("__n"), *moments)
    share = F.when((F.col("__below") == 0) | (F.col("__n") == 0), F.lit(0.0)).otherwise(F.col("__n") / F.col("__below"))
    mean = {f: share * F.coalesce(F.col(f"__m_{f}"), F.lit(0.0)) for f in fields}
    columns = [mean[f].alias(f"{f}_zonal_average") for f in fields]
    if deviations:
        gap = {f: F.coalesce(F.col(f"__m_{f}"), F.lit(0.0)) - mean[f] for f in fields}
        columns += [F.sqrt(share * (F.coalesce(F.col(f"__v_{f}"), F.lit(0.0)) + gap[f] * gap[f])).alias(f"{f}_zonal_std_dev") for f in fields]
    return rows.select(*keys, "ilat", *columns)


def zonal_median(cells: DataFrame, fields: list[str], keys: list[str] | None = None, water: str = "true") -> DataFrame:
    """(keys, ilat, <f>_zonal_median): the upper median over water cells, null without any. A list has the length of one latitude circle."""
    keys = ["itime", "idepth"] if keys is None else keys
    lists = cells.groupBy(*keys, "ilat").agg(*[F.array_sort(F.collect_list(F.when(F.expr(water), F.col(f)))).alias(f) for f in fields])
    return lists.select(*keys, "ilat", *[F.when(F.size(f) > 0, F.element_at(f, (F.size(f) / 2).cast("int") + 1)).alias(f"{f}_zonal_median") for f in fields])


def time_mean_std(cells: DataFrame, fields: list[str], keys: list[str] | None = None, water: str = "true") -> DataFrame:
    """(keys, ilat, ilon, <f>_time_average, <f>_time_std_dev, water_count) over the times at which a cell is water."""
    keys = ["idepth"] if keys is None else keys
    wet = lambda f: F.when(F.expr(water), F.col(f))
    columns = [c for f in fields for c in (F.avg(wet(f)).alias(f"{f}_time_average"), F.stddev_pop(wet(f)).alias(f"{f}_time_std_dev"))]
    return cells.groupBy(*keys, "ilat", "ilon").agg(*columns, F.sum(F.expr(water).cast("int")).alias("water_count"))


def water_count(cells: DataFrame, water: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, ilat, ilon, water_count, ever_water): times at which each cell is water."""
    keys = ["idepth"] if keys is None else keys
    return cells.groupBy(*keys, "ilat", "ilon").agg(F.sum(F.expr(water).cast("int")).alias("water_count")).withColumn("ever_water", F.col("water_count") > 0)


def _boxes(axis: tuple[float, ...], edges: list[float], name: str, spark) -> DataFrame:  # noqa: ANN001
    """(i<name>, icoarse_<name>): half-open boxes by the first cell at or beyond each edge; the last box ends before the last cell."""
    first = [sum(x < e for x in axis) for e in edges]
    ends = [*first[1:], len(axis) - 1]
    last = len(axis) - 1
    rows = [(i, k) for k, (a, b) in enumerate(zip(first, ends, strict=True)) for i in range(min(a, last), min(b, last))]
    return spark.createDataFrame(rows, f"i{name} int, icoarse_{name} int")


def coarse_map(cells: DataFrame, grid: Grid, fields: list[str], lat_edges: list[float], lon_edges: list[float], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, water: str = "true") -> DataFrame:
    """(keys, icoarse_lat, icoarse_lon, <f>_coarsened_map): area-weighted means of water cells in boxes; edges in radians. 0 without area."""
    keys = ["itime", "idepth"] if keys is None else keys
    spark = cells.sparkSession
    df = _area(cells, grid, cfg).join(F.broadcast(_boxes(grid.lats, lat_edges, "lat", spark)), "ilat").join(F.broadcast(_boxes(grid.lons, lon_edges, "lon", spark)), "ilon")
    area = F.sum(F.when(F.expr(water), F.col("area")).otherwise(0.0))
    total = lambda f: F.sum(F.when(F.expr(water), F.coalesce(F.col(f), F.lit(0.0)) * F.col("area")).otherwise(0.0))
    return df.groupBy(*keys, "icoarse_lat", "icoarse_lon").agg(*[F.when(area == 0, F.lit(0.0)).otherwise(total(f) / area).alias(f"{f}_coarsened_map") for f in fields])


#: Fixed values of the Okubo-Weiss axis: bins, decades below the largest value, the largest value in 1/s2.
OW_BINS, OW_DECADES, OW_MAX = 601, 30, 1e10 / 86400.0**2


def okubo_weiss_edges() -> list[float]:
    """Symmetric logarithmic bounds around 0."""
    half = OW_BINS // 2
    low = math.log10(OW_MAX) - OW_DECADES
    up = [10 ** (low + k * OW_DECADES / half) for k in range(1, half + 1)]
    return [*[-x for x in reversed(up)], 0.0, *up]


def okubo_weiss_bin(value: Column) -> Column:
    """Index of the first bound that is not below the value, at most the last."""
    half = OW_BINS // 2
    low, step = math.log10(OW_MAX) - OW_DECADES, OW_DECADES / half
    at = F.ceil((F.log10(F.abs(value)) - low) / step - 1e-9).cast("int")
    up = F.least(F.greatest(at, F.lit(1)), F.lit(half))
    down = F.floor((F.log10(F.abs(value)) - low) / step + 1e-9).cast("int")
    return F.when(value == 0, F.lit(half)).when(value > 0, F.lit(half) + up).otherwise(F.lit(half) - F.least(F.greatest(down, F.lit(0)), F.lit(half)))


def okubo_weiss_histogram(cells: DataFrame, regions: DataFrame, grid: Grid, fields: list[str], ow: str = "okubo_weiss", cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None) -> DataFrame:
    """(keys, iokubo, region, area, <f>_integral, <f>_average): area and area integrals by Okubo-Weiss bin."""
    keys = ["itime", "idepth"] if keys is None else keys
    df = _area(cells.withColumn("iokubo", okubo_weiss_bin(F.col(ow))), grid, cfg).join(regions, ["ilat", "ilon"])
    total = lambda f: F.sum(F.coalesce(F.col(f), F.lit(0.0)) * F.col("area"))
    return df.groupBy(*keys, "iokubo", "region").agg(F.sum("area").alias("area"), *[total(f).alias(f"{f}_integral") for f in fields], *[(total(f) / F.sum("area")).alias(f"{f}_average") for f in fields])


def weighted_ratio(cells: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """(by, ratio): the mean of value * weight over the mean of weight, as for spectral slopes; 0 for weight 0."""
    total = F.sum(weight)
    return cells.groupBy(*by).agg(F.when(total == 0, F.lit(0.0)).otherwise(F.sum(F.col(value) * F.col(weight)) / total).alias("ratio"))


def spatial_average(cells: DataFrame, grid: Grid, fields: list[str], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, water: str = "true") -> DataFrame:
    """(keys, <f>_average): area-weighted means over water."""
    keys = ["itime", "idepth"] if keys is None else keys
    df = _area(cells, grid, cfg).where(water)
    return df.groupBy(*keys).agg(*[(F.sum(F.coalesce(F.col(f), F.lit(0.0)) * F.col("area")) / F.sum("area")).alias(f"{f}_average") for f in fields])


def depth_integral(cells: DataFrame, depth: str, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """cells with <f>_integral: cumulative trapezoids from the lowest level upwards; depth is positive downwards."""
    keys = ["itime", "ilat", "ilon"] if keys is None else keys
    up = Window.partitionBy(*keys).orderBy(F.desc(depth))
    sums = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.abs(F.lag(depth).over(up) - F.col(depth))
    df = cells.select("*", *[(F.coalesce(0.5 * (F.col(f) + F.lag(f).over(up)) * step, F.lit(0.0))).alias(f"__{f}") for f in fields])
    return df.select(*[f"`{c}`" for c in cells.columns], *[F.sum(f"__{f}").over(sums).alias(f"{f}_integral") for f in fields])


def value_range(cells: DataFrame, fields: list[str]) -> DataFrame:
    """One row: min_<f>, max_<f>, both seeded with 0."""
    return cells.agg(*[c for f in fields for c in (F.least(F.coalesce(F.min(f), F.lit(0.0)), F.lit(0.0)).alias(f"min_{f}"), F.greatest(F.coalesce(F.max(f), F.lit(0.0)), F.lit(0.0)).alias(f"max_{f}"))])


def pack_int16(cells: DataFrame, field: str, name: str = "packed") -> DataFrame:
    """cells with an int16 column and its scale_factor and add_offset, from the range of the field."""
    top = -32765
    span = value_range(cells, [field]).select(((F.col(f"min_{field}") + F.col(f"max_{field}")) / 2).alias("add_offset"), ((F.col(f"max_{field}") - F.col(f"min_{field}")) / top).alias("scale_factor"))
    df = cells.crossJoin(F.broadcast(span))
    packed = F.when(F.col("scale_factor") == 0, F.lit(0)).otherwise(F.round((F.col(field) - F.col("add_offset")) / F.col("scale_factor")))
    return df.withColumn(name, packed.cast("smallint"))


def error_norms(cells: DataFrame, grid: Grid, truth: tuple[str, str], found: tuple[str, str], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None) -> DataFrame:
    """(keys, l2, linf, relative_l2, ke_error): area-weighted norms of the difference of two velocity fields."""
    keys = ["itime", "idepth"] if keys is None else keys
    gap = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(truth, found, strict=True)), F.lit(0.0))
    size = sum((F.col(a) * F.col(a) for a in truth), F.lit(0.0))
    other = sum((F.col(a) * F.col(a) for a in found), F.lit(0.0))
    df = _area(cells, grid, cfg)
    sums = df.groupBy(*keys).agg(F.sum(gap * F.col("area")).alias("g"), F.sum(size * F.col("area")).alias("s"), F.sum(other * F.col("area")).alias("o"), F.sum("area").alias("a"), F.sqrt(F.max(gap)).alias("linf"))
    return sums.select(*keys, F.sqrt(F.col("g") / F.col("a")).alias("l2"), "linf", F.sqrt(F.col("g") / F.col("s")).alias("relative_l2"), (0.5 * cfg.rho0 * (F.col("s") - F.col("o")) / F.col("a")).alias("ke_error"))


def percentile_regions(cells: DataFrame, field: str, percents: list[int], keys: list[str] | None = None) -> DataFrame:
    """(region, keys, ilat, ilon): cells above each percentile (linear interpolation) of the field in their slice. A slice is sorted, which spills, not held; its few cut values meet its cells in a join."""
    keys = ["itime", "idepth"] if keys is None else keys
    known = cells.where(F.col(field).isNotNull()).select(*keys, F.col(field).alias("__x"))
    ranked = known.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy("__x")) - 1)
    counts = known.groupBy(*keys).agg(F.count("*").alias("__n"))
    at = [F.lit(p / 100) * (F.col("__n") - 1) for p in percents]
    gap = [F.lit(1.0) - F.abs(F.col("__place") - x) for x in at]
    near = ranked.join(counts, keys)
    cuts = near.groupBy(*keys).agg(F.array(*[F.sum(F.when(g > 0, g * F.col("__x"))) for g in gap]).alias("cuts"))
    pairs = F.arrays_zip(F.array(*[F.lit(f"{field} > p{p}") for p in percents]).alias("region"), F.col("cuts").alias("cut"))
    df = cells.join(cuts, keys).select(*keys, "ilat", "ilon", field, F.explode(pairs).alias("x"))
    return df.where(F.col(field) > F.col("x.cut")).select(F.col("x.region").alias("region"), *keys, "ilat", "ilon")


def trajectory_correlation(points: DataFrame, pairs: list[tuple[str, str]], key: str = "traj") -> DataFrame:
    """(key, corr_<a>_<b>, mean_<a> ...): means and Pearson correlations along each trajectory."""
    names = sorted({x for p in pairs for x in p})
    return points.groupBy(key).agg(*[F.avg(n).alias(f"mean_{n}") for n in names], *[F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs])


def subset_means(cells: DataFrame, group: str, groups: list | None, size: int, fields: list[str], by: list[str]) -> DataFrame:  # noqa: ANN001
    """(subset, by, <f>): means over every combination of `size` of the groups, None: of all that cells hold. The table of combinations is joined, not looped over."""
    if groups is None:
        groups = sorted(r[0] for r in cells.select(group).where(F.col(group).isNotNull()).distinct().collect())
    rows = [(k, g) for k, own in enumerate(combinations(groups, size)) for g in own]
    table = cells.sparkSession.createDataFrame(rows, f"subset int, `{group}` {dict(cells.dtypes)[group]}")
    return cells.join(table, group).groupBy("subset", *by).agg(*[F.avg(f).alias(f) for f in fields])


def quadrature_sum(cells: DataFrame, nodes: list[tuple[float, float, float]], fields: list[str], ell: float, by: list[str]) -> DataFrame:
    """(by, <f>, <f>_error) from fields at scales delta: nodes are (delta, finer weight, coarser weight); the sum is 2 * ell / 2 * w * f, the error the two rules' difference."""
    table = cells.sparkSession.createDataFrame([tuple(map(float, n)) for n in nodes], "ell double, w double, w2 double")
    df = cells.join(F.broadcast(table), "ell")
    return df.groupBy(*by).agg(*[F.sum(F.lit(ell) * F.col("w") * F.col(f)).alias(f) for f in fields], *[F.sum(F.lit(ell) * (F.col("w") - F.col("w2")) * F.col(f)).alias(f"{f}_error") for f in fields])


def trajectory_derivatives(points: DataFrame, fields: list[str], step: float, key: str = "traj", at: str = "iout", order: int = 4, water: str | None = None) -> DataFrame:
    """points with ddt_<f>: derivatives of fields by time along each trajectory, whose outputs are `step` apart. Stencils avoid outputs that are null or missing."""
    wet = water or " and ".join(f"{f} is not null" for f in fields)
    df = points.withColumn("__there", F.expr(wet))
    df = calculus.differentiate(df, at, 2, step, {f"ddt_{f}": f for f in fields}, [key], order, 1, False, "__there")
    return df.select(*[F.col(f"`{c}`") for c in points.columns], *[F.when(F.col("__there"), F.col(f"ddt_{f}")).alias(f"ddt_{f}") for f in fields])
