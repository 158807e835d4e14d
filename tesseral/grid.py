"""The mesh: axes as small dimension tables, fields as one long table of cells.

A field table has (itime, idepth, ilat, ilon, <variables>); a variable is a column,
null is land. Dimension tables have the size of an axis and may always be broadcast;
their sizes are known to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.functions import geometry

KEYS = ["itime", "idepth", "ilat", "ilon"]


@dataclass(frozen=True)
class Grid:
    """lats, lons: cell centres in radians (metres on a plane)."""

    lats: tuple[float, ...]
    lons: tuple[float, ...]

    @staticmethod
    def degrees(nlat: int, nlon: int, lat0: float, dlat: float, lon0: float, dlon: float) -> Grid:
        return Grid(tuple(math.radians(lat0 + dlat * i) for i in range(nlat)), tuple(math.radians(lon0 + dlon * j) for j in range(nlon)))

    @staticmethod
    def plane(ny: int, nx: int, dy: float, dx: float) -> Grid:
        return Grid(tuple(dy * (i + 0.5) for i in range(ny)), tuple(dx * (j + 0.5) for j in range(nx)))

    @property
    def nlat(self) -> int:
        return len(self.lats)

    @property
    def nlon(self) -> int:
        return len(self.lons)

    @property
    def dlat(self) -> float:
        return self.lats[1] - self.lats[0]

    @property
    def dlon(self) -> float:
        return self.lons[1] - self.lons[0]

    def areas(self, cfg: FilterConfig) -> list[float]:
        """Area of a cell in each row. On an uneven latitude axis interior cells have the mean of both gaps, end cells half of their one gap."""
        if cfg.uniform_lat:
            heights = [self.dlat] * self.nlat
        else:
            gaps = [b - a for a, b in zip(self.lats, self.lats[1:], strict=False)]
            heights = [gaps[0] / 2, *[(a + b) / 2 for a, b in zip(gaps, gaps[1:], strict=False)], gaps[-1] / 2]
        scale = [1.0] * self.nlat if cfg.cartesian else [cfg.earth_radius**2 * math.cos(x) for x in self.lats]
        return [s * h * self.dlon for s, h in zip(scale, heights, strict=True)]

    def lat_dim(self, spark: SparkSession, cfg: FilterConfig) -> DataFrame:
        return spark.createDataFrame([(i, x, a) for i, (x, a) in enumerate(zip(self.lats, self.areas(cfg), strict=True))], "ilat int, lat double, area double")

    def lon_dim(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.lons)), "ilon int, lon double")

    def located(self, cells: DataFrame, cfg: FilterConfig) -> DataFrame:
        """cells with lat, lon and area, by joins with the axes."""
        spark = cells.sparkSession
        return cells.join(F.broadcast(self.lat_dim(spark, cfg)), "ilat").join(F.broadcast(self.lon_dim(spark)), "ilon")

    def extended(self, cfg: FilterConfig) -> tuple[Grid, int]:
        """The grid with latitude rows up to the poles, and how many were put in front. A row within 0.1 % of a spacing from the pole is left out."""
        if cfg.cartesian or not cfg.uniform_lat:
            raise ValueError("only a uniform latitude axis on the sphere extends to the poles")
        south = math.floor((self.lats[0] + math.pi / 2) / self.dlat)
        north = math.floor((math.pi / 2 - self.lats[-1]) / self.dlat)
        south -= abs(self.lats[0] - south * self.dlat + math.pi / 2) < 1e-3 * self.dlat and south > 0
        north -= abs(math.pi / 2 - self.lats[-1] - north * self.dlat) < 1e-3 * self.dlat and north > 0
        return Grid(tuple(self.lats[0] + (i - south) * self.dlat for i in range(self.nlat + south + north)), self.lons), south


def densify(cells: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Every cell of the grid for every combination of `keys` that occurs, in cells(keys, ilat, ilon, ...); new ones are null."""
    spark = cells.sparkSession
    slices = cells.select(*keys).distinct() if keys else spark.range(1).select()
    mesh = slices.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid.nlat - 1))).alias("ilat")).select("*", F.explode(F.sequence(F.lit(0), F.lit(grid.nlon - 1))).alias("ilon"))
    return mesh.join(cells, [*keys, "ilat", "ilon"], "left")


def area_expression(grid: Grid, cfg: FilterConfig) -> str:
    """Cell area as SQL text over a column lat, on a uniform grid."""
    return geometry.cell_area("lat", grid.dlat, grid.dlon, cfg)
