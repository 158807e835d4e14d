"""Reading and writing fields, dimensions, masks and regions as Parquet, with packed values and metadata."""

from __future__ import annotations

import json
import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from tesseral.grid import Grid

#: Names and units of results, stored as column metadata.
UNITS = {"coarse_KE": "J m-3", "fine_KE": "J m-3", "vort_r": "s-1", "div": "s-1", "okubo_weiss": "s-2", "Pi": "W m-3", "Z": "kg m-3 s-3", "div_transport": "W m-3", "enstrophy": "kg m-3 s-2", "u_lon": "m s-1", "u_lat": "m s-1", "psi": "m2 s-1", "phi": "m2 s-1"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table is there, in any store that Spark reads."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return True


def require(spark: SparkSession, *paths: str) -> None:
    """Raises FileNotFoundError for the first path without a table."""
    for path in paths:
        if not exists(spark, path):
            raise FileNotFoundError(path)


def read_variable(spark: SparkSession, path: str, name: str, alias: str | None = None, fill: float | None = None, scale: float = 1.0, offset: float = 0.0, land: float | None = None) -> DataFrame:
    """(itime, idepth, ilat, ilon, <alias>): values equal to `fill` are null (or `land`), others are scaled and shifted. Splitting over tasks is the scan's."""
    value = F.col(name).cast("double")
    missing = value.isNull() if fill is None else value.isNull() | (value == fill)
    return spark.read.parquet(path).select("itime", "idepth", "ilat", "ilon", F.when(missing, F.lit(land)).otherwise(value * scale + offset).alias(alias or name))


def read_mask(spark: SparkSession, path: str, name: str, fill: float, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """(itime, idepth, ilat, ilon, water) by the looser rule: water is anything clearly below the fill value in size."""
    value = F.col(name).cast("double") * scale + offset
    return spark.read.parquet(path).select("itime", "idepth", "ilat", "ilon", F.coalesce(F.abs(value) <= 0.999 * abs(fill * scale + offset), F.lit(False)).alias("water"))


def read_grid(spark: SparkSession, path: str, in_degrees: bool = True) -> Grid:
    """The axes below path: tables lat(ilat, lat) and lon(ilon, lon)."""
    axis = lambda n: tuple(r[1] for r in sorted(spark.read.parquet(f"{path}/{n}").select(f"i{n}", n).collect()))
    lats, lons = axis("lat"), axis("lon")
    if in_degrees:
        lats, lons = tuple(map(math.radians, lats)), tuple(map(math.radians, lons))
    return Grid(lats, lons)


def load_variables(spark: SparkSession, path: str, names: dict[str, str], fill: float | None = None) -> DataFrame:
    """(itime, idepth, ilat, ilon, <names>): columns of one table under the names of the analysis, in one scan; `fill` becomes null."""
    value = lambda c: F.when(F.col(c) != fill, F.col(c)) if fill is not None else F.col(c)
    return spark.read.parquet(path).select("itime", "idepth", "ilat", "ilon", *[value(c).cast("double").alias(n) for n, c in names.items()])


def read_axis(spark: SparkSession, path: str, name: str) -> list[float]:
    """The values of an axis table (i<name>, <name>), in order. An axis is short."""
    return [r[1] for r in sorted(spark.read.parquet(f"{path}/{name}").select(f"i{name}", name).collect())]


def read_depth_direction(depths: list[float]) -> bool:
    """Whether depth increases along its axis."""
    return len(depths) < 2 or depths[1] > depths[0]


def read_regions(spark: SparkSession, path: str, grid: Grid | None = None) -> DataFrame:
    """(region, ilat, ilon) of cells whose value is 1. Without the table, and given the grid, one region `full_domain` of all cells."""
    if grid is not None and not exists(spark, path):
        rows = spark.range(grid.nlat).select(F.col("id").cast("int").alias("ilat"), F.explode(F.sequence(F.lit(0), F.lit(grid.nlon - 1))).alias("ilon"))
        return rows.select(F.lit("full_domain").alias("region"), "ilat", "ilon")
    return spark.read.parquet(path).where("value = 1").select("region", "ilat", "ilon")


def write_regions(regions: DataFrame, path: str) -> None:
    """Writes (region, ilat, ilon) as a region definition that read_regions() takes."""
    regions.select("region", "ilat", "ilon", F.lit(1).alias("value")).write.mode("overwrite").partitionBy("region").parquet(path)


def default_column(cells: DataFrame, name: str, value: float = 0.0) -> DataFrame:
    """cells with a column of a constant where it is missing, as for a radial velocity that no file has."""
    return cells if name in cells.columns else cells.withColumn(name, F.lit(value))


def rasterize(rows: DataFrame, keys: dict[str, str], values: dict[str, str]) -> DataFrame:
    """Cells from any table: keys and values are SQL text, values aggregates. One partial and one final aggregation."""
    return rows.groupBy(*[F.expr(e).cast("int").alias(k) for k, e in keys.items()]).agg(*[F.expr(e).alias(v) for v, e in values.items()])


def described(df: DataFrame, attributes: dict | None = None) -> DataFrame:
    """df whose columns carry units and the given attributes as metadata."""
    return df.select(*[F.col(c).alias(c, metadata={"units": UNITS[base]} if (base := next((u for u in UNITS if c == u or c.startswith(f"{u}_")), None)) else {"attributes": json.dumps(attributes or {})}) for c in df.columns])


def write_results(df: DataFrame, path: str, attributes: dict | None = None, single: bool = False, by: str = "ell") -> None:
    """Writes results as Parquet in a folder per scale. single: doubles are stored as floats."""
    if single:
        df = df.select(*[F.col(c).cast("float").alias(c) if t == "double" and c != by else F.col(c) for c, t in df.dtypes])
    out = described(df, attributes).write.mode("overwrite")
    (out.partitionBy(by) if by in df.columns else out).parquet(path)


#: Packed values lie in +-32765 steps of half the range; -32767 is the fill value.
PACKED_STEPS, PACKED_FILL = 32765, -32767


def write_packed(df: DataFrame, path: str, fields: list[str]) -> None:
    """Writes df with fields as 16-bit integers; scale and offset, from one pass over the values, are column metadata, and nulls the fill value."""
    span = df.agg(*[F.struct(F.least(F.coalesce(F.min(f), F.lit(0.0)), F.lit(0.0)).alias("lo"), F.greatest(F.coalesce(F.max(f), F.lit(0.0)), F.lit(0.0)).alias("hi")).alias(f) for f in fields]).first()

    def packed(f: str) -> Column:
        offset, scale = (span[f].lo + span[f].hi) / 2, (span[f].hi - span[f].lo) / (2 * PACKED_STEPS) or 1.0
        value = F.coalesce(F.round((F.col(f) - F.lit(offset)) / F.lit(scale)), F.lit(PACKED_FILL)).cast("smallint")
        return value.alias(f, metadata={"scale_factor": scale, "add_offset": offset, "fill": PACKED_FILL})

    df.select(*[packed(c) if c in fields else F.col(c) for c in df.columns]).write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """A table that write_packed() wrote, with its values back."""
    df = spark.read.parquet(path)

    def value(field: StructField) -> Column:
        m = field.metadata or {}
        if "scale_factor" not in m:
            return F.col(field.name)
        return F.when(F.col(field.name) != m["fill"], F.col(field.name) * F.lit(m["scale_factor"]) + F.lit(m["add_offset"])).alias(field.name)

    return df.select(*[value(f) for f in df.schema.fields])


def write_trajectories(points: DataFrame, path: str, attributes: dict | None = None, back: DataFrame | None = None, distances: DataFrame | None = None, fields: list[str] | None = None) -> None:
    """Writes particles (traj, iout, time, longitude, latitude[, rev_longitude, rev_latitude][, fore_back_dists][, fields]), angles in degrees."""
    out = points.select("traj", "iout", "time", F.degrees("lon").alias("longitude"), F.degrees("lat").alias("latitude"), *(fields or []))
    if back is not None:
        out = out.join(back.select("traj", "iout", F.degrees("lon").alias("rev_longitude"), F.degrees("lat").alias("rev_latitude")), ["traj", "iout"], "left")
    if distances is not None:
        out = out.join(distances.select("traj", "iout", F.col("dist").alias("fore_back_dists")), ["traj", "iout"], "left")
    described(out, attributes).write.mode("overwrite").parquet(path)


def write_subset(cells: DataFrame, path: str, attributes: dict | None = None) -> None:
    """Writes a strided subset of a mesh, one folder a time."""
    described(cells, attributes).write.mode("overwrite").partitionBy("itime").parquet(path)


def read_attribute(spark: SparkSession, path: str, name: str):  # noqa: ANN201
    """An attribute that write_results() stored, null where there is none."""
    for field in spark.read.parquet(path).schema.fields:
        found = json.loads((field.metadata or {}).get("attributes", "{}"))
        if name in found:
            return found[name]
    return None
