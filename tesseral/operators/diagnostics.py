"""Diagnostics of coarse fields. Inputs are columns, derivatives come from calculus; all else is arithmetic in one projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.functions import geometry
from tesseral.grid import Grid
from tesseral.operators import aggregate, calculus, coarse

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def vorticity_sql(cfg: FilterConfig, u_lon: str = "u_lon", u_lat: str = "u_lat", u_r: str = "0.0") -> dict[str, str]:
    """vort_r, div, okubo_weiss and the strain parts as SQL text over dlon_, dlat_ columns and lat."""
    r = repr(cfg.earth_radius)
    ua, ub, va, vb = f"dlon_{u_lon}", f"dlat_{u_lon}", f"dlon_{u_lat}", f"dlat_{u_lat}"
    if cfg.cartesian:
        return {"vort_r": f"({va} - {ub})", "div": f"({ua} + {vb})", "okubo_weiss": f"(({ua} - {vb}) * ({ua} - {vb}) + 4 * {ub} * {va})"}
    vort = f"(({va} / cos(lat) - {ub} + tan(lat) * {u_lon}) / {r})"
    div = f"(2 * {u_r} / {r} + {ua} / ({r} * cos(lat)) + {vb} / {r} - {u_lat} * tan(lat) / {r})"
    normal = f"(({ua} / cos(lat) - {u_lat} * tan(lat) - {vb}) / {r})"
    shear = f"(({va} / cos(lat) + {ub} + tan(lat) * {u_lon}) / {r})"
    return {"vort_r": vort, "div": div, "normal_strain": normal, "shear_strain": shear, "okubo_weiss": f"({normal} * {normal} + {shear} * {shear} - {vort} * {vort})"}


def vorticity(cells: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, u_lon: str = "u_lon", u_lat: str = "u_lat", u_r: str | None = None, water: str | None = None) -> DataFrame:
    """cells with vort_r, div, okubo_weiss (and strain parts on the sphere); land is 0."""
    keys = ["itime", "idepth"] if keys is None else keys
    df = calculus.spherical_gradients(cells, grid, [u_lon, u_lat], keys, cfg.order, 1, cfg.periodic_x, cfg.periodic_y, water)
    df = grid.located(df, cfg)
    wet = F.col(water) if water else F.lit(True)
    columns = vorticity_sql(cfg, u_lon, u_lat, u_r or "0.0")
    return df.select(*[f"`{c}`" for c in cells.columns], *[F.when(wet, F.expr(e)).otherwise(0.0).alias(c) for c, e in columns.items()])


def rotation_strain_energies(vort: str = "vort_r", div: str = "div", normal: str = "normal_strain", shear: str = "shear_strain", lat: str = "lat") -> dict[str, str]:
    """Energies of the velocity gradient: cyclonic and anticyclonic rotation, the two normal strains (from the divergence without u_r), the shear strain."""
    spin = f"(2 * ({vort} / 2) * ({vort} / 2))"
    return {
        "cyclonic": f"(case when {vort} * {lat} >= 0 then {spin} else 0.0 end)",
        "anticyclonic": f"(case when {vort} * {lat} < 0 then {spin} else 0.0 end)",
        "divergent": f"((({div} + {normal}) * ({div} + {normal}) + ({div} - {normal}) * ({div} - {normal})) / 4)",
        "strain": f"({shear} * {shear} / 2)",
    }


def with_cartesian(cells: DataFrame, grid: Grid, cfg: FilterConfig, u_r: str = "u_r", u_lon: str = "u_lon", u_lat: str = "u_lat", products: bool = True) -> DataFrame:
    """cells with u_x, u_y, u_z and, for quadratic filtering, their products."""
    df = grid.located(cells, cfg)
    if cfg.cartesian:
        parts = (u_lon, u_lat, "0.0")
    else:
        parts = geometry.spherical_to_cartesian(u_r, u_lon, u_lat, "lon", "lat")
    df = df.select(*[f"`{c}`" for c in cells.columns], *[F.expr(e).alias(f"u_{a}") for a, e in zip("xyz", parts, strict=True)])
    if products:
        df = df.select("*", *[(F.col(f"u_{p[0]}") * F.col(f"u_{p[1]}")).alias(f"u_{p}") for p in PAIRS])
    return df


def energy_transfer_sql(rho0: float, d: dict[str, tuple[str, str, str]], tau: dict[str, str]) -> str:
    """Pi = -rho0 S_ij tau_ij, from derivatives d[a] = (d/dx, d/dy, d/dz) of u_a and the six stresses."""
    terms = []
    for i, a in enumerate("xyz"):
        for j, b in enumerate("xyz"):
            t = tau["".join(sorted(a + b))]
            terms.append(f"0.5 * ({d[a][j]} + {d[b][i]}) * {t}")
    return f"(-{rho0!r} * ({' + '.join(terms)}))"


def transfers(bar: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, vorticity_products: bool = False) -> DataFrame:
    """bar (u_x, u_y, u_z and their filtered products u_xx ..., per scale) with Pi, div_transport and, given w and w_x, w_y, w_z, enstrophy transfer Z.

    keys: what names a slice, the scale first.
    """
    keys = ["ell", "itime", "idepth"] if keys is None else keys
    tau = {p: f"(u_{p} - u_{p[0]} * u_{p[1]})" for p in PAIRS}
    fields = ["u_x", "u_y", "u_z", *[f"u_{p}" for p in PAIRS]]
    df = bar
    if vorticity_products:
        df = df.select("*", *[F.expr(f"w_{a} - w * u_{a}").alias(f"t_{a}") for a in "xyz"])
        df = df.select("*", *[F.expr(f"w * t_{a}").alias(f"wt_{a}") for a in "xyz"])
        fields += [f"{c}_{a}" for c in ("t", "wt") for a in "xyz"]
    df = calculus.spherical_gradients(df, grid, fields, keys, cfg.order, 1, cfg.periodic_x, cfg.periodic_y)
    df = grid.located(df, cfg)

    def gradient(f: str) -> tuple[str, str, str]:
        return (f"dlon_{f}", f"dlat_{f}", "0.0") if cfg.cartesian else calculus.cartesian_derivatives(f, radius=cfg.earth_radius)

    d = {a: gradient(f"u_{a}") for a in "xyz"}
    columns = {"Pi": energy_transfer_sql(cfg.rho0, d, tau)}
    terms = []
    for a in "xyz":
        for j, b in enumerate("xyz"):
            p = "".join(sorted(a + b))
            flux = gradient(f"u_{p}")[j]
            terms.append(f"u_{a} * {d[a][j]} * u_{b} + {d[a][j]} * {tau[p]} + u_{a} * ({flux} - {d[a][j]} * u_{b})")
    columns["div_transport"] = f"({cfg.rho0!r} * ({' + '.join(terms)}))"
    if vorticity_products:
        inner = " + ".join(f"(w * {gradient(f't_{a}')[k]} - {gradient(f'wt_{a}')[k]})" for k, a in enumerate("xyz"))
        columns["Z"] = f"({cfg.rho0!r} * ({inner}))"
    return df.select(*[f"`{c}`" for c in bar.columns], *[F.expr(e).alias(c) for c, e in columns.items()])


def transfers_shifted(bar: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None) -> DataFrame:
    """Pi with the derivative moved onto the stress: rho0 sum (u_i tau_ij,j - (u_i tau_ij),j)."""
    keys = ["ell", "itime", "idepth"] if keys is None else keys
    df = bar.select("*", *[F.expr(f"u_{p} - u_{p[0]} * u_{p[1]}").alias(f"tau_{p}") for p in PAIRS])
    ordered = [(a, b) for a in "xyz" for b in "xyz"]
    df = df.select("*", *[F.expr(f"u_{a} * tau_{''.join(sorted(a + b))}").alias(f"ut_{a}{b}") for a, b in ordered])
    fields = [f"tau_{p}" for p in PAIRS] + [f"ut_{a}{b}" for a, b in ordered]
    df = grid.located(calculus.spherical_gradients(df, grid, fields, keys, cfg.order, 1, cfg.periodic_x, cfg.periodic_y), cfg)
    g = lambda f, k: calculus.cartesian_derivatives(f, radius=cfg.earth_radius)[k]
    terms = " + ".join(f"(u_{a} * {g('tau_' + ''.join(sorted(a + b)), 'xyz'.index(b))} - {g(f'ut_{a}{b}', 'xyz'.index(b))})" for a, b in ordered)
    return df.select(*[f"`{c}`" for c in bar.columns], F.expr(f"{cfg.rho0!r} * ({terms})").alias("Pi_shifted"))


def helmholtz_transfer_sql(cfg: FilterConfig, u: str, v: str, uu: str, uv: str, vv: str) -> str:
    """Two-dimensional Pi as SQL text over dlon_, dlat_ columns and lat: metric factors, no curvature terms."""
    r = repr(cfg.earth_radius)
    a, b, c, d = f"dlon_{u} / ({r} * cos(lat))", f"dlat_{u} / {r}", f"dlon_{v} / ({r} * cos(lat))", f"dlat_{v} / {r}"
    return f"(-{cfg.rho0!r} * ({a} * ({uu} - {u} * {u}) + ({b} + {c}) * ({uv} - {u} * {v}) + {d} * ({vv} - {v} * {v})))"


def transfers_helmholtz(bar: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None) -> DataFrame:
    """Two-dimensional Pi from u_lon, u_lat and filtered products uu, uv, vv."""
    keys = ["ell", "itime", "idepth"] if keys is None else keys
    df = grid.located(calculus.spherical_gradients(bar, grid, ["u_lon", "u_lat"], keys, cfg.order, 1, cfg.periodic_x, cfg.periodic_y), cfg)
    return df.select(*[f"`{x}`" for x in bar.columns], F.expr(helmholtz_transfer_sql(cfg, "u_lon", "u_lat", "uu", "uv", "vv")).alias("Pi_helm"))


def energies_sql(cfg: FilterConfig, u: tuple[str, ...], filtered_ke: str, fine_ke: str = "0.0", vort: str = "0.0") -> dict[str, str]:
    """coarse_KE, fine_KE, fine_KE_mod, enstrophy."""
    own = geometry.kinetic_energy(cfg.rho0, *u)
    return {"coarse_KE": own, "fine_KE": f"({filtered_ke} - {own})", "fine_KE_mod": f"({fine_ke} - {own})", "enstrophy": f"({0.5 * cfg.rho0!r} * {vort} * {vort})"}


def spectrum_sql(cfg: FilterConfig, *u: str) -> dict[str, str]:
    """Filtering spectrum and its slope from columns u, dl_u and dll_u."""
    grow = " + ".join(f"2 * {x} * dl_{x}" for x in u)
    bend = " + ".join(f"dl_{x} * dl_{x} + {x} * dll_{x}" for x in u)
    return {
        "spectrum": f"(-0.5 * {cfg.rho0!r} * ell * ell * ({grow}))",
        "slope": f"(case when abs({grow}) < 1e-20 then 0.0 else -2 - ell * ({bend}) / ({grow}) end)",
    }


def potential_conversion_sql(cfg: FilterConfig, rho: str = "rho", u_r: str = "u_r") -> str:
    """Potential to kinetic energy of the coarse flow."""
    return f"(({rho} - {cfg.rho0!r}) * (-{cfg.gravity!r}) * {u_r})"


def geostrophic_velocity(cells: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, ssh: str = "ssh", omega: float = 2 * math.pi / 86400) -> DataFrame:
    """cells with u_lon, u_lat (in place of any there) from sea-surface height: f-plane away from the equator, a blend with the beta plane within 5 degrees, beta alone within 0.5; speeds from 100 m/s are null."""
    cells = cells.drop("u_lon", "u_lat")
    df = beta_velocity(cells, grid, cfg, keys, ssh, omega, ("__ub", "__vb"), slopes=True)
    df = grid.located(df, cfg)
    g, r, f = cfg.gravity, cfg.earth_radius, f"({2 * omega!r} * sin(lat))"
    plain = f"(-{g!r} / ({f} * {r!r}) * __lat)", f"({g!r} / ({f} * {r!r} * cos(lat)) * __lon)"
    near = "exp(-(degrees(lat) / 2.2) * (degrees(lat) / 2.2))"
    blend = [f"(case when abs(degrees(lat)) >= 5 then {a} when abs(degrees(lat)) >= 0.5 then (1 - {near}) * {a} + {near} * {b} else {near} * {b} end)" for a, b in zip(plain, ("__ub", "__vb"), strict=True)]
    df = df.select(*[f"`{c}`" for c in cells.columns], F.expr(blend[0]).alias("__u"), F.expr(blend[1]).alias("__v"))
    fine = (F.abs("__u") < 100) & (F.abs("__v") < 100)
    return df.select(*[f"`{c}`" for c in cells.columns], F.when(fine, F.col("__u")).alias("u_lon"), F.when(fine, F.col("__v")).alias("u_lat"))


def beta_velocity(cells: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, ssh: str = "ssh", omega: float = 2 * math.pi / 86400, names: tuple[str, str] = ("u_lon", "u_lat"), slopes: bool = False) -> DataFrame:
    """cells with the velocity that second slopes of the sea-surface height have on a beta plane; slopes: and its first slopes __lon, __lat."""
    keys = ["itime", "idepth"] if keys is None else keys
    wanted = [("__lon", ssh, "ilon", 1), ("__lat", ssh, "ilat", 1), ("__latlat", "__lat", "ilat", 1), ("__latlon", "__lat", "ilon", 1)]
    df = grid.located(calculus.derivatives(cells, grid, wanted, keys, cfg.order, cfg.periodic_x, cfg.periodic_y), cfg)
    g, r = cfg.gravity, cfg.earth_radius
    beta = f"({2 * omega / r!r} * cos(lat))"
    columns = [F.expr(f"-{g!r} / ({beta} * {r * r!r}) * __latlat").alias(names[0]), F.expr(f"{g!r} / ({beta} * {r * r!r} * cos(lat)) * __latlon").alias(names[1])]
    return df.select(*[f"`{c}`" for c in cells.columns], *columns, *(["__lon", "__lat"] if slopes else []))


def radial_velocity(cells: DataFrame, grid: Grid, depth: str, cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, u_lon: str = "u_lon", u_lat: str = "u_lat") -> DataFrame:
    """cells with u_r (in place of any there) by continuity: the convergence of the horizontal flow, integrated upwards from the lowest level."""
    keys = ["itime", "idepth"] if keys is None else keys
    cells = cells.drop("u_r")
    df = vorticity(cells, grid, cfg, keys, u_lon, u_lat).withColumn("__conv", -F.col("div"))
    df = aggregate.depth_integral(df, depth, ["__conv"], [k for k in keys if k != "idepth"] + ["ilat", "ilon"])
    return df.select(*[F.col(f"`{c}`") for c in cells.columns], F.col("__conv_integral").alias("u_r"))


def wind_forcing(cells: DataFrame, grid: Grid, scales: list[float], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, stress: tuple[str, str] = ("tau_lon", "tau_lat"), u: tuple[str, str] = ("u_lon", "u_lat"), water: str | None = None) -> DataFrame:
    """(ell, keys, ilat, ilon, wind_forcing): work of the wind below each scale, the coarse product of stress and velocity less the product of coarse ones."""
    df = cells.withColumn("__work", F.expr(" + ".join(f"{a} * {b}" for a, b in zip(stress, u, strict=True))))
    bar = coarse.coarse_grain(df, grid, scales, ["__work", *stress, *u], cfg, keys, water=water)
    drop = [*stress, *u, "__work"]
    return bar.withColumn("wind_forcing", F.expr("__work - (" + " + ".join(f"{a} * {b}" for a, b in zip(stress, u, strict=True)) + ")")).drop(*drop)


def transfer_breakdown(cells: DataFrame, grid: Grid, scales: list[float], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None) -> DataFrame:
    """Parts of the energy transfer of a toroidal and a potential flow, from u_lon_tor, u_lat_tor, u_lon_pot, u_lat_pot.

    (ell, keys, ilat, ilon, pair, ui_tor, ui_pot, uj_tor, uj_pot, ui_j_tor, ui_j_pot, uj_i_tor, uj_i_pot, uu_tor_tor, uu_tor_pot, uu_pot_tor, uu_pot_pot):
    for each pair of Cartesian components the coarse velocities, their derivatives along the other's axis, and the coarse products.
    """
    keys = ["itime", "idepth"] if keys is None else keys
    kinds, axes = ("tor", "pot"), "xyz"
    df = grid.located(cells.withColumn("__r", F.lit(0.0)), cfg)
    vectors = {k: geometry.spherical_to_cartesian("__r", f"u_lon_{k}", f"u_lat_{k}", "lon", "lat") for k in kinds}
    df = df.select(*keys, "ilat", "ilon", *[F.expr(e).alias(f"{a}_{k}") for k in kinds for a, e in zip(axes, vectors[k], strict=True)])
    single = [f"{a}_{k}" for k in kinds for a in axes]
    products = {f"{a}_{p}_{b}_{q}": f"{a}_{p} * {b}_{q}" for a in axes for b in axes if a <= b for p in kinds for q in kinds}
    df = df.select("*", *[F.expr(e).alias(n) for n, e in products.items()])
    bar = coarse.coarse_grain(df, grid, scales, [*single, *products], cfg, keys)
    bar = grid.located(calculus.spherical_gradients(bar, grid, single, ["ell", *keys], cfg.order, 1, cfg.periodic_x, cfg.periodic_y), cfg)
    slope = {f: dict(zip(axes, calculus.cartesian_derivatives(f, radius=cfg.earth_radius), strict=True)) for f in single}

    def pair(i: str, j: str) -> Column:
        columns = {f"u{n}_{k}": f"{a}_{k}" for n, a in (("i", i), ("j", j)) for k in kinds}
        columns |= {f"ui_j_{k}": slope[f"{i}_{k}"][j] for k in kinds} | {f"uj_i_{k}": slope[f"{j}_{k}"][i] for k in kinds}
        columns |= {f"uu_{p}_{q}": f"{i}_{p}_{j}_{q}" for p in kinds for q in kinds}
        return F.struct(F.lit(i + j).alias("pair"), *[F.expr(e).alias(n) for n, e in columns.items()])

    return bar.select("ell", *keys, "ilat", "ilon", F.explode(F.array(*[pair(i, j) for i in axes for j in axes if i <= j])).alias("x")).select("ell", *keys, "ilat", "ilon", "x.*")


def eddy_mean_conversion(means: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None) -> DataFrame:
    """Mean-to-eddy kinetic energy conversion from time means u_lon, u_lat, uu, uv, vv."""
    keys = ["idepth"] if keys is None else keys
    df = grid.located(calculus.spherical_gradients(means, grid, ["u_lon", "u_lat"], keys, cfg.order, 1, cfg.periodic_x, cfg.periodic_y), cfg)
    a, b, c = "(uu - u_lon * u_lon)", "(uv - u_lon * u_lat)", "(vv - u_lat * u_lat)"
    out = f"{cfg.rho0 / cfg.earth_radius!r} * ({a} * dlon_u_lon / cos(lat) + {b} * dlat_u_lon + {b} * dlon_u_lat / cos(lat) + {c} * dlat_u_lat)"
    return df.select(*[f"`{x}`" for x in means.columns], F.expr(out).alias("conversion"))
