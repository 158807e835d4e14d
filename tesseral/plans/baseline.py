"""Whole runs on meshes of one and two degrees, from closed forms: what bench.py times besides the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.grid import Grid, densify
from tesseral.operators import aggregate, potentials, solve
from tesseral.plans import pipelines
from tesseral.sources.store import stored

CFG = FilterConfig()
KEYS = ["itime", "idepth"]
ONE_DEGREE = Grid.degrees(178, 360, -88.5, 1.0, -179.5, 1.0)
TWO_DEGREES = Grid.degrees(88, 180, -87.0, 2.0, -179.0, 2.0)
REGIONS = {"Global": "true", "Tropics": "abs(lat) <= 15", "North": "lat > 15", "South": "lat < -15"}
#: 27 scales, evenly spread by their logarithm.
SCALES = [1e5 * (7.74e7 / 1e5) ** (k / 26) for k in range(27)]


def _mesh(spark: SparkSession, grid: Grid, **fields: str) -> DataFrame:
    cells = densify(spark.createDataFrame([], "ilat int, ilon int"), grid, []).select(F.lit(0).alias("itime"), F.lit(0).alias("idepth"), "ilat", "ilon")
    return grid.located(cells, CFG).select(*cells.columns, *[F.expr(e).cast("double").alias(n) for n, e in fields.items()])


def scalars(spark: SparkSession) -> int:
    """One scalar on a sphere of one degree, three scales, full outputs stored, regional and zonal results; rows of results."""
    waves = " + ".join(f"{0.1 + 0.02 * k} * cos({k} * lon + {k * k % 7}) * cos({k} * lat) * cos(lat)" for k in range(1, 25))
    cells = stored(_mesh(spark, ONE_DEGREE, rho=waves), "bench")
    full = stored(pipelines.coarse_grain_scalars(cells, ONE_DEGREE, [1e5, 5e5, 2e6], ["rho"], CFG), "bench")
    regions = stored(aggregate.region_table(ONE_DEGREE, spark, REGIONS), "bench")
    fields = [c for c, t in full.dtypes if t == "double" and c != "ell"]
    return full.count() + sum(stored(df, "bench").count() for df in pipelines.postprocess(full, ONE_DEGREE, fields, regions, CFG).values())


def helmholtz(spark: SparkSession) -> int:
    """Toroidal and potential flow on a sphere of two degrees: projection, 27 scales of its potentials, regional and zonal results; rows of results."""
    psi = "exp(-pow((degrees(lat) - 10 * cos(5 * lon)) / 15, 2))"
    phi = "exp(-pow((abs(degrees(lat)) - 40) / 10, 2)) * sin(2 * lon)"
    grid = TWO_DEGREES
    cells = _mesh(spark, grid, psi0=f"1e5 * {psi}", phi0=f"1e5 * {phi}")
    flow = potentials.potential_velocity(potentials.toroidal_velocity(cells, grid, "psi0"), grid, "phi0")
    flow = stored(flow.select(*KEYS, "ilat", "ilon", F.expr("u_lon_tor + u_lon_pot").alias("u_lon"), F.expr("u_lat_tor + u_lat_pot").alias("u_lat")), "bench")
    split = stored(solve.helmholtz(flow, grid, CFG), "bench")
    full = stored(pipelines.coarse_grain_helmholtz(split.select(*KEYS, "ilat", "ilon", "psi", "phi"), grid, SCALES, CFG), "bench")
    regions = stored(aggregate.region_table(grid, spark, REGIONS), "bench")
    fields = [c for c, t in full.dtypes if t == "double" and c != "ell"]
    return full.count() + sum(stored(df, "bench").count() for df in pipelines.postprocess(full, grid, fields, regions, CFG).values())


CASES = {"case_scalars_one_degree": scalars, "case_helmholtz_two_degrees": helmholtz}
