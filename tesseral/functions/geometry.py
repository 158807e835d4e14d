"""Scalar geometry as SQL text, usable in F.expr; angles in radians, lengths in metres."""

from __future__ import annotations

from tesseral.config import FilterConfig


def distance(lat1: str, lat2: str, dlon: str, cfg: FilterConfig, length_x: float | None = None, length_y: float | None = None) -> str:
    """Distance of two points with a difference dlon in longitude (or x, on the plane, where the axes may be periodic)."""
    if cfg.cartesian:
        dx, dy = f"abs({dlon})", f"abs({lat1} - {lat2})"
        if cfg.periodic_x and length_x:
            dx = f"least({dx}, {length_x!r} - {dx})"
        if cfg.periodic_y and length_y:
            dy = f"least({dy}, {length_y!r} - {dy})"
        return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"
    r = repr(cfg.earth_radius)
    if cfg.high_precision_distance:
        a = f"cos({lat2}) * sin({dlon})"
        b = f"(cos({lat1}) * sin({lat2}) - sin({lat1}) * cos({lat2}) * cos({dlon}))"
        c = f"(sin({lat1}) * sin({lat2}) + cos({lat1}) * cos({lat2}) * cos({dlon}))"
        return f"({r} * atan2(sqrt(({a}) * ({a}) + {b} * {b}), {c}))"
    arc = f"sin({lat1}) * sin({lat2}) + cos({lat1}) * cos({lat2}) * cos({dlon})"
    return f"(case when {lat1} = {lat2} and {dlon} = 0 then 0.0 else {r} * acos(greatest(-1.0, least(1.0, {arc}))) end)"


def cell_area(lat: str, dlat: float, dlon: float, cfg: FilterConfig) -> str:
    """Area of a cell on a uniform grid."""
    if cfg.cartesian:
        return repr(dlat * dlon)
    return f"({cfg.earth_radius**2 * dlat * dlon!r} * cos({lat}))"


def spherical_to_cartesian(u_r: str, u_lon: str, u_lat: str, lon: str, lat: str) -> tuple[str, str, str]:
    """u_x, u_y, u_z of a velocity in spherical components."""
    return (
        f"({u_r} * cos({lon}) * cos({lat}) - {u_lon} * sin({lon}) - {u_lat} * cos({lon}) * sin({lat}))",
        f"({u_r} * sin({lon}) * cos({lat}) + {u_lon} * cos({lon}) - {u_lat} * sin({lon}) * sin({lat}))",
        f"({u_r} * sin({lat}) + {u_lat} * cos({lat}))",
    )


def cartesian_to_spherical(u_x: str, u_y: str, u_z: str, lon: str, lat: str) -> tuple[str, str, str]:
    """u_r, u_lon, u_lat of a velocity in Cartesian components."""
    return (
        f"({u_x} * cos({lon}) * cos({lat}) + {u_y} * sin({lon}) * cos({lat}) + {u_z} * sin({lat}))",
        f"({u_y} * cos({lon}) - {u_x} * sin({lon}))",
        f"({u_z} * cos({lat}) - {u_x} * cos({lon}) * sin({lat}) - {u_y} * sin({lon}) * sin({lat}))",
    )


def kinetic_energy(rho0: float, *u: str) -> str:
    return f"({0.5 * rho0!r} * ({' + '.join(f'{x} * {x}' for x in u)}))"


#: Named regions as conditions on latitude and longitude in degrees.
REGIONS = {
    "Global": "true",
    "GulfofMexico": "lon > -100 and lon < -83 and lat > 15 and lat < 32 and lat - 21 > -0.68 * (lon + 100)",
    "GulfStream": "lon <= -35 and lon >= -80.75 and abs(lat - 0.4 * lon - 62) <= 6",
    "Tropics": "abs(lat) < 15",
    "NorthofTropics": "lat >= 15",
    "SouthofTropics": "lat <= -15",
    "Kuroshio": "lon > 120 and lon < 170 and lat > 17 and lat < 45 and lat - 30 <= (lon - 120) * 0.75 and (lat - 17 >= (lon - 120) * 0.4 or lon > 140) and (lat >= 25 or lon < 140)",
    "AntarcticCircumpolar": "lat < -33 and lat > -70 and (lat + 45 <= (lon + 180) * (-5.0 / 108) or lon >= -72) and (lat + 33 <= (lon - 20) * (-12.0 / 160) or lon <= 20)",
}


def polygon(*half_planes: tuple[float, float, float]) -> str:
    """A region as an intersection of half planes a * lon + b * lat >= c, for REGIONS-like dictionaries."""
    return " and ".join(f"{a!r} * lon + {b!r} * lat >= {c!r}" for a, b, c in half_planes)


def cell_index(sizes: dict[str, int]) -> str:
    """The number of a cell as SQL text: sizes of the axes, the slowest first."""
    out = "0L"
    for axis, n in sizes.items():
        out = f"({out} * {n} + {axis})"
    return f"cast({out} as bigint)"


def cell_places(cell: str, sizes: dict[str, int]) -> dict[str, str]:
    """The indices of a numbered cell as SQL text, by axis."""
    out, step = {}, 1
    for axis, n in reversed(sizes.items()):
        out[axis] = f"cast(({cell} div {step}) % {n} as int)"
        step *= n
    return dict(reversed(out.items()))


def not_polar(lat: str) -> str:
    """Condition of cells that are not at a pole."""
    return f"(abs(degrees({lat})) < 89.95)"
