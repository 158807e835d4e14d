"""Velocities of potentials and derivatives of velocities on the sphere: H-operators that need no solver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.grid import Grid
from tesseral.operators import calculus

#: Rows within this many degrees of a pole have no velocity.
POLE = 0.01
_OPEN = f"(abs(abs(degrees(lat)) - 90) >= {POLE})"


def _with_gradients(cells: DataFrame, grid: Grid, wanted: list[tuple[str, str, str, int]], cfg: FilterConfig, keys: list[str] | None, water: str | None) -> DataFrame:
    keys = ["itime", "idepth"] if keys is None else keys
    return grid.located(calculus.derivatives(cells, grid, wanted, keys, cfg.order, cfg.periodic_x, cfg.periodic_y, water), cfg)


def _named(df: DataFrame, cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in cells.columns], *[F.when(F.expr(_OPEN), F.expr(e)).otherwise(0.0).alias(n) for n, e in columns.items()])


def _first(*fields: str) -> list[tuple[str, str, str, int]]:
    return [(f"__{a}_{f}", f, f"i{a}", 1) for a in ("lon", "lat") for f in fields]


def toroidal_velocity(cells: DataFrame, grid: Grid, psi: str = "psi", cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, water: str | None = None, names: tuple[str, str] = ("u_lon_tor", "u_lat_tor")) -> DataFrame:
    """cells with the velocity of a stream function: minus its northward slope, its eastward slope. 0 at the poles."""
    r = repr(cfg.earth_radius)
    df = _with_gradients(cells, grid, _first(psi), cfg, keys, water)
    return _named(df, cells, {names[0]: f"-__lat_{psi} / {r}", names[1]: f"__lon_{psi} / ({r} * cos(lat))"})


def potential_velocity(cells: DataFrame, grid: Grid, phi: str = "phi", cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, water: str | None = None, names: tuple[str, str] = ("u_lon_pot", "u_lat_pot")) -> DataFrame:
    """cells with the velocity of a potential, its gradient. 0 at the poles."""
    r = repr(cfg.earth_radius)
    df = _with_gradients(cells, grid, _first(phi), cfg, keys, water)
    return _named(df, cells, {names[0]: f"__lon_{phi} / ({r} * cos(lat))", names[1]: f"__lat_{phi} / {r}"})


def curl(cells: DataFrame, grid: Grid, u_lon: str = "u_lon", u_lat: str = "u_lat", cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, water: str | None = None, seed: str | None = None, name: str = "curl") -> DataFrame:
    """cells with the vertical curl of a velocity, less a column that a first guess explains."""
    df = _with_gradients(cells, grid, _first(u_lon, u_lat), cfg, keys, water)
    less = f" - {seed}" if seed else ""
    return _named(df, cells, {name: f"(__lon_{u_lat} / cos(lat) - __lat_{u_lon} + tan(lat) * {u_lon}) / {cfg.earth_radius!r}{less}"})


def divergence(cells: DataFrame, grid: Grid, u_lon: str = "u_lon", u_lat: str = "u_lat", cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, water: str | None = None, name: str = "div") -> DataFrame:
    """cells with the horizontal divergence of a velocity."""
    df = _with_gradients(cells, grid, _first(u_lon, u_lat), cfg, keys, water)
    return _named(df, cells, {name: f"(__lon_{u_lon} + cos(lat) * __lat_{u_lat} - {u_lat} * sin(lat)) / ({cfg.earth_radius!r} * cos(lat))"})


def laplacian(cells: DataFrame, grid: Grid, field: str, cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, water: str | None = None, name: str = "laplacian") -> DataFrame:
    """cells with the Laplacian of a field on the sphere."""
    df = _with_gradients(cells, grid, [*_first(field), *[(f"__2{a}_{field}", field, f"i{a}", 2) for a in ("lon", "lat")]], cfg, keys, water)
    return _named(df, cells, {name: f"(__2lon_{field} / (cos(lat) * cos(lat)) - __lat_{field} * tan(lat) + __2lat_{field}) / {cfg.earth_radius**2!r}"})


def tensor_of_vector(cells: DataFrame, grid: Grid, v_r: str = "v_r", v_lon: str = "v_lon", v_lat: str = "v_lat", cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, water: str | None = None) -> DataFrame:
    """cells with the symmetric tensor uu, uv, vv of a radial scalar and a horizontal vector."""
    df = _with_gradients(cells, grid, _first(v_lon, v_lat), cfg, keys, water)
    parts = {
        "uu": f"{v_r} + __lon_{v_lon} / cos(lat) - tan(lat) * {v_lat}",
        "uv": f"0.5 * (tan(lat) * {v_lon} + __lat_{v_lon} + __lon_{v_lat} / cos(lat))",
        "vv": f"{v_r} + __lat_{v_lat}",
    }
    return _named(df, cells, parts)
