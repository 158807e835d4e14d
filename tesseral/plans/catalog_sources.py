"""The catalogue's fourth part: tables are written by the sinks into the shared folder and read back by the sources."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.operators import aggregate, particles
from tesseral.operators import coarse as coarse_ops
from tesseral.plans import pipelines
from tesseral.plans.catalog import CFG, PLACE, SCALES, _brute, out, query
from tesseral.plans.fields import CUBE, FLAT, GRID, MESH, cube, flat
from tesseral.sources import tables
from tesseral.sources.store import shared_dir

KEYS = ["itime", "idepth"]


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


def _packed(spark: SparkSession, sf_dir: str) -> str:
    """A table of 16-bit integers in hundredths, land as a fill value."""
    path = _place(spark)
    value = lambda c: F.coalesce(F.round(F.col(c) * 100), F.lit(-32767)).cast("smallint").alias(c)
    cube(spark, sf_dir).select(*KEYS, *PLACE, value("u"), value("v")).write.parquet(path)
    return path


@query("s1_read_variable", f"with {CUBE} select itime, idepth, ilat, ilon, round(round(u * 100) / 100 + 5, 4) + 0.0 as speed from cube")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(tables.read_variable(spark, _packed(spark, sf_dir), "u", "speed", -32767, 0.01, 5.0), [*KEYS, *PLACE], speed="speed")


@query("s2_read_mask", f"with {CUBE} select itime, idepth, ilat, ilon, u is not null as water from cube")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_mask(spark, _packed(spark, sf_dir), "u", -32767)


@query("s5_load_variables", f"with {CUBE} select itime, idepth, ilat, ilon, round(u * 100) + 0.0 as zonal, round(v * 100) + 0.0 as merid from cube")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(tables.load_variables(spark, _packed(spark, sf_dir), {"zonal": "u", "merid": "v"}, -32767), [*KEYS, *PLACE], 0, zonal="zonal", merid="merid")


@query("s3_read_attribute", "select * from (values ('kernel', 'gaussian'), ('rho0', '1025.0'), ('none', null)) t(name, value)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    tables.write_results(flat(spark, sf_dir).select(*PLACE, "u"), path, {"kernel": CFG.kernel, "rho0": CFG.rho0})
    found = [(n, None if (x := tables.read_attribute(spark, path, n)) is None else str(x)) for n in ("kernel", "rho0", "none")]
    return spark.createDataFrame(found, "name string, value string")


@query("s4_axes", "select 'lat' as axis, cast(range as int) as i, round(-85.0 + 10 * range, 9) + 0.0 as value from range(18) union all select "
    "'lon', cast(range as int), round(-175.0 + 10 * range, 9) + 0.0 from range(36) union all select 'down', 0, 1.0 union all select 'up', 0, 0.0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    for name, axis in (("lat", GRID.lats), ("lon", GRID.lons)):
        spark.createDataFrame([(k, math.degrees(x)) for k, x in enumerate(axis)], f"i{name} int, {name} double").repartition(3).write.parquet(f"{path}/{name}")
    grid = tables.read_grid(spark, path)
    rows = [(n, k, round(math.degrees(x), 9)) for n, axis in (("lat", grid.lats), ("lon", grid.lons)) for k, x in enumerate(axis)]
    rows += [("down", 0, float(tables.read_depth_direction([0.0, 10.0]))), ("up", 0, float(tables.read_depth_direction([10.0, 0.0])))]
    return spark.createDataFrame(rows, "axis string, i int, value double")


_NAMED = {"north": "lat >= 15", "band": "abs(lat) < 15"}


@query("s6_regions", f"with {MESH}, deg as (select ilat, ilon, -85.0 + 10.0 * ilat as lat from mesh) select 'north' as region, ilat, ilon from "
    f"deg where lat >= 15 union all select 'band', ilat, ilon from deg where abs(lat) < 15 union all select 'full_domain', ilat, ilon from deg")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    tables.write_regions(aggregate.region_table(GRID, spark, _NAMED), path)
    return tables.read_regions(spark, path, GRID).unionByName(tables.read_regions(spark, f"{path}-none", GRID))


@query("s9_default_column", f"with {FLAT} select ilat, ilon, 0.0::double as u_r, round(u, 4) + 0.0 as u from flat")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.default_column(tables.default_column(flat(spark, sf_dir), "u_r"), "u", 7.0)
    return df.select(*PLACE, "u_r", (F.round("u", 4) + 0.0).alias("u"))


@query("k1_output_file", f"with {FLAT}, {_brute(fields='u')} select ell, ilat, ilon, round(u, 4) + 0.0 as u from coarse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    tables.write_results(coarse_ops.coarse_grain(flat(spark, sf_dir), GRID, SCALES, ["u"]), path, {"rho0": CFG.rho0})
    return out(spark.read.parquet(path), ["ell", *PLACE], u="u")


@query("k3_units", "select * from (values ('ell', null), ('u_lon_tor', 'm s-1'), ('coarse_KE', 'J m-3'), ('Pi_tot', 'W m-3'), ('psi', 'm2 s-1')) t(name, units)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    row = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)], "ell double, u_lon_tor double, coarse_KE double, Pi_tot double, psi double")
    tables.described(row).write.parquet(path)
    return spark.createDataFrame([(f.name, (f.metadata or {}).get("units")) for f in spark.read.parquet(path).schema.fields], "name string, units string")


_PACK = "r as (select least(min(u), 0) as a, greatest(max(u), 0) as b from cube)"


@query("k5_packed_output", f"with {CUBE}, {_PACK} select itime, idepth, ilat, ilon, round(round((u - (a + b) / 2) / ((b - a) / 65530)) * ((b - a) / "
    f"65530) + (a + b) / 2, 6) + 0.0 as u from cube, r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    tables.write_packed(cube(spark, sf_dir).select(*KEYS, *PLACE, "u"), path, ["u"])
    assert dict(spark.read.parquet(path).dtypes)["u"] == "smallint"
    return out(tables.read_packed(spark, path), [*KEYS, *PLACE], 6, u="u")


_REG = ( "deg as (select ilat, ilon, -85.0 + 10.0 * ilat as lat from mesh), reg as (select 'north' as region, ilat, ilon from deg "
    "where lat >= 15 union all select 'band', ilat, ilon from deg where abs(lat) < 15)")
_MEAN = "m as (select ell, region, sum(u * cos(coarse.lat)) / sum(cos(coarse.lat)) as mean from coarse join reg using (ilat, ilon) group by all)"


@query(
    "k2_postprocess_files",
    f"with {FLAT}, {_REG}, {_brute(fields='u')}, {_MEAN}, z as (select ell, ilat, avg(u) as mean from coarse group by all) "
    "select 'region average' as kind, ell, region as name, round(mean, 4) + 0.0 as value from m "
    "union all select 'region deviation', ell, region, round(sqrt(sum(power(u - mean, 2) * cos(coarse.lat)) / sum(cos(coarse.lat))), "
    "4) + 0.0 from coarse join reg using (ilat, ilon) join m using (ell, region) group by ell, region "
    "union all select 'zonal average', ell, cast(ilat as varchar), round(mean, 4) + 0.0 from z "
    "union all select 'zonal deviation', ell, cast(coarse.ilat as varchar), round(sqrt(avg(power(u - mean, 2))), 4) + 0.0 from coarse join z using (ell, ilat) group by ell, coarse.ilat",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    full = coarse_ops.coarse_grain(flat(spark, sf_dir), GRID, SCALES, ["u"])
    pipelines.write_postprocess(full, GRID, ["u"], aggregate.region_table(GRID, spark, _NAMED), CFG, path)
    regions, zonal = spark.read.parquet(f"{path}/regions"), spark.read.parquet(f"{path}/zonal")
    pick = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), "ell", F.col(name).cast("string").alias("name"), (F.round(value, 4) + 0.0).alias("value"))
    parts = [(regions, "region average", "region", "u_area_average"), (regions, "region deviation", "region", "u_area_std_dev"), (zonal, "zonal average", "ilat", "u_zonal_average"), (zonal, "zonal deviation", "ilat", "u_zonal_std_dev")]
    whole = pick(*parts[0])
    for p in parts[1:]:
        whole = whole.unionByName(pick(*p))
    return whole


@query("k9_particle_files", "with p as (select cast(o_orderkey as int) as traj, o_custkey % 360 - 180.0 as lon, o_orderkey % 180 - 90.0 as lat from orders) "
    "select traj, round(lon, 6) + 0.0 as longitude, round(lat, 6) + 0.0 as latitude, round(lon + 0.5, 6) + 0.0 as rev_longitude, "
    "round(6371e3 * radians(0.5) * cos(radians(lat)), -3) + 0.0 as across from p where abs(lat) < 60")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("abs(o_orderkey % 180 - 90.0) < 60")
    points = rows.select(F.expr("cast(o_orderkey as int)").alias("traj"), F.lit(0).alias("iout"), F.lit(0.0).alias("time"), F.expr("radians(o_custkey % 360 - 180.0D)").alias("lon"), F.expr("radians(o_orderkey % 180 - 90.0D)").alias("lat"))
    back = points.withColumn("lon", F.expr("lon + radians(0.5D)"))
    tables.write_trajectories(points, path, {"cfl": 1e-5}, back, particles.fore_back_distance(points, back))
    return out(spark.read.parquet(path).withColumn("across", F.col("fore_back_dists")), ["traj"], 6, longitude="longitude", latitude="latitude", rev_longitude="rev_longitude", across="round(across, -3)")


@query("k9_subset_files", f"with {CUBE} select itime, cast(ilat // 2 as int) as ilat, cast(ilon // 3 as int) as ilon, round(u, 4) + 0.0 as u from cube "
    f"where idepth = 0 and ilat % 2 = 0 and ilon % 3 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesseral.operators import reshape

    path = _place(spark)
    tables.write_subset(reshape.decimate(cube(spark, sf_dir).where("idepth = 0"), 2, 3), path)
    return out(spark.read.parquet(path), ["itime", *PLACE], u="u")
