"""Shallow-water energy budgets of one and two layers on a plane.

Fields are coarse-grained in the usual way (products first), layers are the column
idepth (0 upper, 1 lower). Budget terms are expressions over one wide row per cell
that has both layers and all derivatives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.grid import Grid
from tesseral.operators import calculus
from tesseral.operators.coarse import coarse_grain

KEYS = ["ell", "itime"]


def pressure(cells: DataFrame, rho: tuple[float, float], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None) -> DataFrame:
    """cells(idepth, ilat, ilon, h) with the hydrostatic pressure p at each of two layers."""
    keys = ["itime"] if keys is None else keys
    g = cfg.gravity
    at = [*keys, "ilat", "ilon"]
    sums = cells.groupBy(*at).agg(*[F.sum(F.when(F.col("idepth") == k, F.col("h")).otherwise(0.0)).alias(f"__h{k}") for k in (0, 1)])
    upper, lower = g * rho[0] * (F.col("__h0") + F.col("__h1")), g * (rho[0] * F.col("__h0") + rho[1] * F.col("__h1"))
    return cells.join(sums, at).select(*cells.columns, F.when(F.col("idepth") == 0, upper).otherwise(lower).alias("p"))


def _gradients(df: DataFrame, grid: Grid, fields: list[str], keys: list[str], cfg: FilterConfig, derivative: int = 1) -> DataFrame:
    return calculus.spherical_gradients(df, grid, fields, keys, cfg.order, derivative, cfg.periodic_x, cfg.periodic_y)


def laplacians(cells: DataFrame, grid: Grid, cfg: FilterConfig, keys: list[str]) -> DataFrame:
    """cells with h times the Laplacians of u and v, and that of h."""
    df = _gradients(cells, grid, ["u", "v", "h"], keys, cfg, 2)
    lap = lambda f: f"d2lon_{f} + d2lat_{f}"
    return df.select(*cells.columns, F.expr(f"h * ({lap('u')})").alias("h_lap_u"), F.expr(f"h * ({lap('v')})").alias("h_lap_v"), F.expr(lap("h")).alias("lap_h"))


def one_layer(cells: DataFrame, grid: Grid, scales: list[float], cfg: FilterConfig) -> DataFrame:
    """Coarse fields and budget of cells(itime, idepth, ilat, ilon, u, v, h): KE, PE, Pi, KE_trans, Gamma, PE_trans, KE2PE. Pressure is g h."""
    g = cfg.gravity
    df = _gradients(cells, grid, ["h"], ["itime", "idepth"], cfg)
    products = {"hu": "h * u", "hv": "h * v", "huu": "h * u * u", "huv": "h * u * v", "hvv": "h * v * v", "hh": "h * h"}
    df = df.select("itime", "idepth", "ilat", "ilon", "u", "v", "h", *[F.expr(e).alias(n) for n, e in products.items()])
    bar = coarse_grain(df, grid, scales, ["h", *products], cfg)
    bar = bar.select("ell", "itime", "idepth", "ilat", "ilon", F.col("h"), F.expr("hu / h").alias("u"), F.expr("hv / h").alias("v"), F.expr("huu / h - (hu / h) * (hu / h)").alias("tau_uu"), F.expr("huv / h - (hu / h) * (hv / h)").alias("tau_uv"), F.expr("hvv / h - (hv / h) * (hv / h)").alias("tau_vv"), F.expr(f"{g!r} * (hh - h * h)").alias("tau_hp"))
    bar = bar.select("*", F.expr("0.5 * h * (u * u + v * v)").alias("KE"), F.expr(f"0.5 * {g!r} * h * h").alias("PE"))
    bar = bar.select("*", F.expr("u * KE + h * (u * tau_uu + v * tau_uv)").alias("fx"), F.expr("v * KE + h * (u * tau_uv + v * tau_vv)").alias("fy"), F.expr("u * PE").alias("px"), F.expr("v * PE").alias("py"))
    df = _gradients(bar, grid, ["u", "v", "h", "tau_hp", "fx", "fy", "px", "py"], ["ell", "itime", "idepth"], cfg)
    terms = {
        "Pi": "h * (dlon_u * tau_uu + dlat_u * tau_uv + dlon_v * tau_uv + dlat_v * tau_vv) - 0.5 * u * dlon_tau_hp - 0.5 * v * dlat_tau_hp",
        "KE_trans": "-(dlon_fx + dlat_fy)",
        "Gamma": "0.0",
        "PE_trans": "-(dlon_px + dlat_py)",
        "KE2PE": f"{g!r} * h * (u * dlon_h + v * dlat_h)",
    }
    return df.select("ell", "itime", "idepth", "ilat", "ilon", "h", "u", "v", "KE", "PE", *[F.expr(e).alias(n) for n, e in terms.items()])


def two_layer_fields(cells: DataFrame, grid: Grid, scales: list[float], rho: tuple[float, float], cfg: FilterConfig) -> DataFrame:
    """Coarse u, v, h, p (bars), ut, vt, uu, uv, vv (Favre means), lu, lv, lap_h, tau_hpx, tau_hpy of two layers."""
    df = pressure(cells, rho, cfg)
    df = laplacians(df, grid, cfg, ["itime", "idepth"])
    df = _gradients(df, grid, ["p"], ["itime", "idepth"], cfg).withColumnRenamed("dlon_p", "px").withColumnRenamed("dlat_p", "py")
    products = {"hu": "h * u", "hv": "h * v", "huu": "h * u * u", "huv": "h * u * v", "hvv": "h * v * v", "hpx": "h * px", "hpy": "h * py"}
    df = df.select("*", *[F.expr(e).alias(n) for n, e in products.items()])
    bar = coarse_grain(df, grid, scales, ["u", "v", "h", "p", "px", "py", "h_lap_u", "h_lap_v", "lap_h", *products], cfg)
    favre = {"ut": "hu", "vt": "hv", "uu": "huu", "uv": "huv", "vv": "hvv", "lu": "h_lap_u", "lv": "h_lap_v"}
    return bar.select("ell", "itime", "idepth", "ilat", "ilon", "u", "v", "h", "p", "lap_h", *[F.expr(f"{b} / h").alias(a) for a, b in favre.items()], F.expr("hpx - h * px").alias("tau_hpx"), F.expr("hpy - h * py").alias("tau_hpy"))


def two_layer_terms(rho: tuple[float, float], alpha: float, nu: float, g: float) -> dict[int, dict[str, str]]:
    """Budget terms of each layer as SQL text: columns end in 0 for the upper and 1 for the lower layer, derivatives begin with dx_ and dy_."""
    out: dict[int, dict[str, str]] = {}
    for k in (0, 1):
        r = repr(rho[k])
        upper = k == 0
        cross = "h1 * (dx_h0 * (ut1 - u1) + dy_h0 * (vt1 - v1))", "h0 * (dx_h1 * (ut0 - u0) + dy_h1 * (vt0 - v0))"
        out[k] = {
            "KE": f"0.5 * {r} * h{k} * (ut{k} * ut{k} + vt{k} * vt{k})",
            "PE": f"0.5 * {r} * {g!r} * h0 * (h0 + 2 * h1)" if upper else f"0.5 * {r} * {g!r} * h1 * h1",
            "Pi": f"{r} * h{k} * (dx_ut{k} * (uu{k} - ut{k} * ut{k}) + (dy_ut{k} + dx_vt{k}) * (uv{k} - ut{k} * vt{k}) + dy_vt{k} * (vv{k} - vt{k} * vt{k}))",
            "Gamma": f"{g!r} * {r} * h{k} * (dx_gx{k} + dy_gy{k})",
            "baroclinic": f"{alpha / 2!r} * (dx_vt{k} - dy_ut{k}) * (dx_h{k} * dy_p{k} - dy_h{k} * dx_p{k})",
            "traditional": f"(dx_ut{k} + dy_vt{k}) * pe{k}",
            "KE_transport": f"dx_kx{k} + dy_ky{k}",
            "PE_transport": f"dx_ex{k} + dy_ey{k}",
            "alt_PE_transport": "dx_ax + dy_ay" if upper else "0.0",
            "KE_small_transport": f"dx_sx{k} + dy_sy{k}",
            "viscous_KE": f"{nu!r} * {r} * h{k} * (ut{k} * lu{k} + vt{k} * lv{k})",
            "viscous_PE": f"{g * rho[0] * nu!r} * ((h0 + h1) * lap_h0 + h0 * lap_h1)" if upper else f"{g * rho[1] * nu!r} * h1 * lap_h1",
            "bc_KE": f"h{k} * (dx_p{k} * (ut{k} - u{k}) + dy_p{k} * (vt{k} - v{k}))",
            "bc_PE": f"{g * rho[0]!r} * ({cross[0]} + {cross[1]})" if upper else "0.0",
            "bc_PE_part": f"{g * rho[0]!r} * ({cross[1] if upper else cross[0]})",
            "cross_layer_work": f"{g * rho[0]!r} * h1 * (dx_h0 * u0 + dy_h0 * v0)" if upper else f"-{g * rho[0]!r} * h1 * (dx_h0 * u1 + dy_h0 * v1)",
            "pressure_stress_work": f"ut{k} * tau_hpx{k} + vt{k} * tau_hpy{k}",
            "thickness_strain": f"{alpha * g * rho[k]!r} * (dx_h{k} * dx_h{k} * dx_ut{k} + dx_h{k} * dy_h{k} * (dy_ut{k} + dx_vt{k}) + dy_h{k} * dy_h{k} * dy_vt{k})",
            "thickness_conversion": f"{alpha * g * rho[0]!r} * (dx_ut{k} * dx_h0 * dx_h1 + 0.5 * (dy_ut{k} + dx_vt{k}) * (dx_h0 * dy_h1 + dy_h0 * dx_h1) + dy_vt{k} * dy_h0 * dy_h1)",
        }
    return out


def two_layers(cells: DataFrame, grid: Grid, scales: list[float], cfg: FilterConfig, rho: tuple[float, float] = (1000.0, 1010.0), alpha: float = 0.1, nu: float = 1.0) -> DataFrame:
    """(ell, itime, idepth, ilat, ilon, <terms>) of cells(itime, idepth, ilat, ilon, u, v, h) with idepth 0 and 1. alpha: the kernel's moment ratio for unit scale; it grows with the square of the scale."""
    g = cfg.gravity
    bar = two_layer_fields(cells, grid, scales, rho, cfg)
    fields = [c for c in bar.columns if c not in ("ell", "itime", "idepth", "ilat", "ilon")]
    at = ["ell", "itime", "ilat", "ilon"]
    wide = bar.groupBy(*at).agg(*[F.max(F.when(F.col("idepth") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in fields])
    pe = {0: f"(0.5 * {rho[0]!r} * {g!r} * h0 * (h0 + 2 * h1))", 1: f"(0.5 * {rho[1]!r} * {g!r} * h1 * h1)"}
    more = [F.expr(pe[k]).alias(f"pe{k}") for k in (0, 1)]
    for k in (0, 1):
        r = repr(rho[k])
        ke = f"(0.5 * {r} * h{k} * (ut{k} * ut{k} + vt{k} * vt{k}))"
        t = {a + b: f"({a + b if a + b != 'vu' else 'uv'}{k} - {a}t{k} * {b}t{k})" for a in "uv" for b in "uv"}
        own = {"gx": f"h{k} * (ut{k} - u{k})", "gy": f"h{k} * (vt{k} - v{k})", "kx": f"ut{k} * {ke}", "ky": f"vt{k} * {ke}", "ex": f"ut{k} * {pe[k]}", "ey": f"vt{k} * {pe[k]}", "sx": f"{r} * h{k} * (ut{k} * {t['uu']} + vt{k} * {t['vu']})", "sy": f"{r} * h{k} * (ut{k} * {t['uv']} + vt{k} * {t['vv']})"}
        more += [F.expr(e).alias(f"{n}{k}") for n, e in own.items()]
    more += [F.expr(f"{g * rho[0]!r} * h0 * h1 * (ut0 + ut1)").alias("ax"), F.expr(f"{g * rho[0]!r} * h0 * h1 * (vt0 + vt1)").alias("ay")]
    wide = wide.select("*", *more)
    steep = [f"{c}{k}" for k in (0, 1) for c in ("ut", "vt", "h", "p", "gx", "gy", "kx", "ky", "ex", "ey", "sx", "sy")] + ["ax", "ay"]
    df = _gradients(wide, grid, steep, KEYS, cfg)
    for f in steep:
        df = df.withColumnsRenamed({f"dlon_{f}": f"dx_{f}", f"dlat_{f}": f"dy_{f}"})
    terms = two_layer_terms(rho, alpha, nu, g)
    layers = F.array(*[F.struct(F.lit(k).alias("idepth"), *[F.expr(e).cast("double").alias(n) for n, e in terms[k].items()]) for k in (0, 1)])
    return df.select(*at, F.explode(layers).alias("x")).select("ell", "itime", "x.idepth", "ilat", "ilon", *[f"x.{n}" for n in terms[0]])
