"""Fields made from the driver's tables: a 10-degree grid over line items, the same in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.grid import Grid, densify
from tesseral.sources.tables import rasterize

GRID = Grid.degrees(18, 36, -85.0, 10.0, -175.0, 10.0)
VALUES = {"u": "avg(l_quantity) * 1.0123457 - 25.8148151", "v": "avg(l_extendedprice) / 1000 - 38", "rho": "1025 + avg(l_discount) * 10", "ssh": "avg(l_tax) * 10"}
PLACE = {"ilat": "l_partkey % 18", "ilon": "l_orderkey % 36"}
SLICE = {"itime": "year(l_shipdate) - 1995", "idepth": "l_linenumber - 1"}
#: An island, as a condition on ilat and ilon.
WATER = "not (ilat between 7 and 10 and ilon between 14 and 20)"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(itime 0, idepth 0, ilat, ilon, u, v, rho, ssh), every cell."""
    cells = rasterize(lineitem(spark, sf_dir), PLACE, VALUES)
    return densify(cells, GRID, []).select(F.lit(0).alias("itime"), F.lit(0).alias("idepth"), "ilat", "ilon", *VALUES)


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(itime, idepth, ilat, ilon, u, v, rho, ssh) by year and line number; cells without rows are null."""
    cells = rasterize(lineitem(spark, sf_dir), SLICE | PLACE, VALUES)
    return densify(cells, GRID, ["itime", "idepth"])


def _select(keys: dict[str, str]) -> str:
    names = ", ".join(f"cast({e} as int) as {k}" for k, e in keys.items())
    return f"select {names}, {', '.join(f'{e} as {v}' for v, e in VALUES.items())} from lineitem group by {', '.join(str(i + 1) for i in range(len(keys)))}"


LAT, LON = "radians(-85.0 + 10.0 * {a}ilat)", "radians(-175.0 + 10.0 * {a}ilon)"
DANG = repr(math.radians(10.0))
AREA = f"(6371e3 * 6371e3 * {DANG} * {DANG} * cos(lat))"
MESH = "mesh as (select cast(a.range as int) as ilat, cast(b.range as int) as ilon from range(18) a, range(36) b)"
FLAT = ( f"{MESH}, raw as ({_select(PLACE)}), flat as (select cast(0 as int) as itime, cast(0 as int) as idepth, ilat, ilon, u, v, "
    f"rho, ssh, {LAT.format(a='mesh.')} as lat, {LON.format(a='mesh.')} as lon from mesh left join raw using (ilat, ilon))")
CUBE = ( f"{MESH}, raw as ({_select(SLICE | PLACE)}), slices as (select distinct itime, idepth from raw), cube as (select itime, idepth, "
    f"ilat, ilon, u, v, rho, ssh, {LAT.format(a='mesh.')} as lat, {LON.format(a='mesh.')} as lon from slices cross join mesh left "
    f"join raw using (itime, idepth, ilat, ilon))")
