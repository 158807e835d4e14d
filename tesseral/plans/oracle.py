"""SQL of the same results by other means, as common table expressions for DuckDB.

Nothing here comes from the operators: differences use tables of known coefficients
and runs of water found as gaps and islands, neighbourhood means join every pair of
cells.
"""

from __future__ import annotations

import math
from fractions import Fraction

#: Coefficients of finite differences by points, derivative and points on the left, up to the centred ones; the others mirror them.
COEFFICIENTS = {
    (2, 1): ["-1 1"],
    (3, 1): ["-3/2 2 -1/2", "-1/2 0 1/2"],
    (4, 1): ["-11/6 3 -3/2 1/3", "-1/3 -1/2 1 -1/6"],
    (5, 1): ["-25/12 4 -3 4/3 -1/4", "-1/4 -5/6 3/2 -1/2 1/12", "1/12 -2/3 0 2/3 -1/12"],
    (7, 1): [
        "-49/20 6 -15/2 20/3 -15/4 6/5 -1/6",
        "-1/6 -77/60 5/2 -5/3 5/6 -1/4 1/30",
        "1/30 -2/5 -7/12 4/3 -1/2 2/15 -1/60",
        "-1/60 3/20 -3/4 0 3/4 -3/20 1/60",
    ],
    (4, 2): ["2 -5 4 -1", "1 -2 1 0"],
    (6, 2): ["15/4 -77/6 107/6 -13 61/12 -5/6", "5/6 -5/4 -1/3 7/6 -1/2 1/12", "-1/12 4/3 -5/2 4/3 -1/12 0"],
}
DANG = repr(math.radians(10.0))


def coefficient_rows(points: int, derivative: int) -> list[tuple[int, int, float]]:
    """(points on the left, place, coefficient) of all stencils of so many points."""
    known = [[Fraction(x) for x in row.split()] for row in COEFFICIENTS[points, derivative]]
    rows = []
    for left in range(points):
        own = known[left] if left < len(known) else [x * (-1) ** derivative for x in reversed(known[points - 1 - left])]
        rows += [(left, k, float(x)) for k, x in enumerate(own)]
    return rows


def _table(order: int, derivative: int) -> str:
    rows = [f"({p + derivative}, {left}, {k}, {w!r}::double)" for p in range(order, 0, -2) for left, k, w in coefficient_rows(p + derivative, derivative)]
    return f"(values {', '.join(rows)}) w_(n_, left_, k_, c_)"


def derived(
    name: str, source: str, keys: list[str], axis: str, fields: dict[str, str], order: int = 4, derivative: int = 1,
    periodic: bool | None = None, water: str = "true", n: int | None = None, delta: float | str | None = None,
) -> str:
    """CTEs that end in `name`: source with derivatives along ilat or ilon.

    Lines are padded by copies of themselves where they are periodic; water cells in a
    row form islands, which say how many are on either side; a stencil's cells are
    joined by place and summed.
    """
    n = n or (36 if axis == "ilon" else 18)
    delta = delta or math.radians(10.0)
    periodic = axis == "ilon" if periodic is None else periodic
    shifts = f"(values (0), ({n}), ({-n})) s(s_)" if periodic else "(values (0)) s(s_)"
    by = ", ".join(keys)
    values = ", ".join(f"coalesce({c}, 0.0) as f{i}_" for i, c in enumerate(fields.values()))
    sums = ", ".join(f"sum(w_.c_ * p.f{i}_) / ({delta} ** {derivative}) as {new}" for i, new in enumerate(fields))
    fits = " ".join(f"when l_ + r_ >= {p + derivative - 1} then {p + derivative}" for p in range(order, 0, -2))
    same = " and ".join(f"p.{k} = c.{k}" for k in keys)
    back = " and ".join(f"d.{k} = o.{k}" for k in [*keys, axis])
    new = ", ".join(f"coalesce(d.{c}, 0.0) as {c}" for c in fields)
    return (
        f"{name}_p as materialized (select {by}, {axis} + s_ as at_, ({water}) as wet_, {values} from {source}, {shifts}), "
        f"{name}_i as (select *, at_ - row_number() over (partition by {by} order by at_) as isle_ from {name}_p where wet_), "
        f"{name}_r as (select *, at_ - min(at_) over (partition by {by}, isle_) as l_, max(at_) over (partition by {by}, isle_) - at_ as r_ from {name}_i), "
        f"{name}_n as (select *, case {fits} end as n_ from {name}_r where at_ between 0 and {n - 1}), "
        f"{name}_c as (select *, case when l_ < (n_ - 1) // 2 then l_ when r_ < n_ - 1 - (n_ - 1) // 2 then n_ - 1 - r_ else (n_ - 1) // 2 end as left_ from {name}_n), "
        f"{name}_d as (select {', '.join('c.' + k for k in keys)}, c.at_ as {axis}, {sums} from {name}_c c join {_table(order, derivative)} on w_.n_ = c.n_ and w_.left_ = c.left_ "
        f"join {name}_p p on {same} and p.at_ = c.at_ + w_.k_ - c.left_ group by all), "
        f"{name} as materialized (select o.*, {new} from {source} o left join {name}_d d on {back})"
    )


def both(name: str, source: str, fields: list[str], keys: list[str] | None = None, order: int = 4, derivative: int = 1, periodic_y: bool = False, water: str = "true", shape: tuple[int, int] = (18, 36), step: float | None = None, names: str = "lon lat") -> str:
    """CTEs that end in `name`: source with derivatives of fields along both axes."""
    p, keys, (x, y) = "d" if derivative == 1 else "d2", keys or [], names.split()
    one = derived(f"{name}_x", source, [*keys, "ilat"], "ilon", {f"{p}{x}_{f}": f for f in fields}, order, derivative, True, water, shape[1], step)
    return f"{one}, {derived(name, f'{name}_x', [*keys, 'ilon'], 'ilat', {f'{p}{y}_{f}': f for f in fields}, order, derivative, periodic_y, water, shape[0], step)}"


#: The equation of state's polynomials in temperature, by term.
SEA_WATER = {
    "rho_w": "999.842594 + 6.793952e-2*t - 9.095290e-3*t*t + 1.001685e-4*t**3 - 1.120083e-6*t**4 + 6.536332e-9*t**5",
    "rho_s": "8.2449e-1 - 4.0899e-3*t + 7.6438e-5*t*t - 8.2467e-7*t**3 + 5.3875e-9*t**4",
    "rho_s15": "-5.7246e-3 + 1.0227e-4*t - 1.6546e-6*t*t",
    "rho_s2": "4.8314e-4",
    "k_w": "19652.21 + 148.4206*t - 2.327105*t*t + 1.360477e-2*t**3 - 5.155288e-5*t**4",
    "k_s": "54.6746 - 0.603459*t + 1.09987e-2*t*t - 6.1670e-5*t**3",
    "k_s15": "7.944e-2 + 1.6483e-2*t - 5.3009e-4*t*t",
    "k_p": "3.23990 + 1.43714e-3*t + 1.16092e-4*t*t - 5.77905e-7*t**3",
    "k_ps": "2.2838e-3 - 1.0981e-5*t - 1.6078e-6*t*t",
    "k_ps15": "1.91075e-4",
    "k_p2": "8.50935e-5 - 6.12293e-6*t + 5.2787e-8*t*t",
    "k_p2s": "-9.9348e-7 + 2.0816e-8*t + 9.1697e-10*t*t",
}

#: Named regions by their corners and lines, on a mesh of (lat, lon) in degrees.
REGIONS = {
    "Global": "lat between -90 and 90",
    "GulfofMexico": "lon between -99.99 and -83.01 and lat between 15.01 and 31.99 and (lat - 21) / 0.68 > -(lon + 100)",
    "GulfStream": "lon between -80.75 and -35 and lat between 56 + 0.4 * lon and 68 + 0.4 * lon",
    "Tropics": "lat > -15 and lat < 15",
    "NorthofTropics": "not lat < 15",
    "SouthofTropics": "not lat > -15",
    "Kuroshio": "lat > 17 and lat < 45 and lon > 120 and lon < 170 and 4 * (lat - 30) <= 3 * (lon - 120) and case when lon > 140 then lat "
    ">= 25 when lon = 140 then lat >= 25 and 5 * (lat - 17) >= 2 * (lon - 120) else 5 * (lat - 17) >= 2 * (lon - 120) end",
    "AntarcticCircumpolar": "lat between -69.99 and -33.01 and case when lon < -72 then lat + 45 <= -5.0 * (lon + 180) / 108 when lon > 20 then lat + "
    "33 <= -12.0 * (lon - 20) / 160 else true end",
}
