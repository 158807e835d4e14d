"""The catalogue's second part: diagnostics, reductions, regridding, solvers, particles, shallow water, merges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.functions import geometry
from tesseral.grid import Grid
from tesseral.operators import aggregate, diagnostics, particles, reshape, shallow_water, solve
from tesseral.operators import coarse as coarse_ops
from tesseral.plans.catalog import _COARSE_Q, CFG, PLACE, SCALES, _brute, _coarse_products, out, query, rounded
from tesseral.plans.fields import AREA, CUBE, FLAT, GRID, LAT, LON, MESH, WATER, cube, flat
from tesseral.plans.oracle import both, derived

KEYS = ["itime", "idepth"]
R = "6371e3"
_REGIONS = {"Global": "true", "Tropics": "abs(lat) < 15", "NorthofTropics": "lat >= 15", "SouthofTropics": "lat <= -15"}
_REGION_SQL = f"deg as (select ilat, ilon, -85.0 + 10.0 * ilat as lat, -175.0 + 10.0 * ilon as lon from mesh), regions as ({' union all '.join(f"select '{r}' as region, ilat, ilon from deg where {c}" for r, c in _REGIONS.items())})"

# ------------------------------------------------------------------ diagnostics

_VORT = f"(dlon_v / cos(lat) - dlat_u + tan(lat) * u) / {R}"
_DIV = f"(dlon_u / cos(lat) + dlat_v - v * tan(lat)) / {R}"
_SN = f"(dlon_u / cos(lat) - v * tan(lat) - dlat_v) / {R}"
_SS = f"(dlon_v / cos(lat) + dlat_u + tan(lat) * u) / {R}"


def _vorticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.vorticity(flat(spark, sf_dir), GRID, u_lon="u", u_lat="v")


@query("d1_vorticity", f"with {FLAT}, {both('g', 'flat', ['u', 'v'])} select ilat, ilon, {rounded(vort_r=f'1e6 * {_VORT}', div=f'1e6 * {_DIV}', okubo_weiss=f'1e12 * (pow({_SN}, 2) + pow({_SS}, 2) - pow({_VORT}, 2))')} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_vorticity(spark, sf_dir), PLACE, vort_r="1e6 * vort_r", div="1e6 * div", okubo_weiss="1e12 * okubo_weiss")


@query("d2_rotation_strain", f"with {FLAT}, {both('g', 'flat', ['u', 'v'])}, e as (select *, {_VORT} as w, (dlon_u / cos(lat) - tan(lat) * v) / {R} as "
    f"s11, dlat_v / {R} as s22, {_SS} / 2 as s12 from g) select ilat, ilon, {rounded(cyclonic='1e12 * case when w * lat >= 0 then w * w / 2 else 0 end', anticyclonic='1e12 * case when w * lat < 0 then w * w / 2 else 0 end', divergent='1e12 * (s11 * s11 + s22 * s22)', strain='1e12 * 2 * s12 * s12')} from e")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = GRID.located(_vorticity(spark, sf_dir), CFG)
    return out(df, PLACE, **{k: f"1e12 * {e}" for k, e in diagnostics.rotation_strain_energies().items()})


_CART = "(-u * sin(lon) - v * cos(lon) * sin(lat)) as ux, (u * cos(lon) - v * sin(lon) * sin(lat)) as uy, (v * cos(lat)) as uz"
_CARTQ = f"cart as (select *, {_CART} from flat), quad as (select *, ux * ux as uxx, ux * uy as uxy, ux * uz as uxz, uy * uy as uyy, uy * uz as uyz, uz * uz as uzz from cart)"
_UF = "ux uy uz uxx uxy uxz uyy uyz uzz"


def _grad(f: str, k: str) -> str:
    return {
        "x": f"(-sin(lon) / ({R} * cos(lat)) * dlon_{f} - cos(lon) * sin(lat) / {R} * dlat_{f})",
        "y": f"(cos(lon) / ({R} * cos(lat)) * dlon_{f} - sin(lon) * sin(lat) / {R} * dlat_{f})",
        "z": f"(cos(lat) / {R} * dlat_{f})",
    }[k]


def _tau(a: str, b: str) -> str:
    p = "".join(sorted(a + b))
    return f"(u{p} - u{a} * u{b})"


_PI = "-1025 * (" + " + ".join(f"{_grad('u' + a, b)} * {_tau(a, b)}" for a in "xyz" for b in "xyz") + ")"
_DIVJ = "1025 * (" + " + ".join(f"u{a} * {_grad('u' + ''.join(sorted(a + b)), b)} + {_grad('u' + a, b)} * {_tau(a, b)}" for a in "xyz" for b in "xyz") + ")"
_PIBASE = f"with {FLAT}, {_CARTQ}, {_brute(fields=_UF, source='quad')}, {both('g', 'coarse', _UF.split(), ['ell'])}"


def _coarse_cartesian(spark: SparkSession, sf_dir: str, more: list[str] | None = None) -> DataFrame:
    df = flat(spark, sf_dir).withColumnsRenamed({"u": "u_lon", "v": "u_lat"}).withColumn("u_r", F.lit(0.0))
    df = diagnostics.with_cartesian(df, GRID, CFG)
    fields = ["u_x", "u_y", "u_z", *[f"u_{p}" for p in diagnostics.PAIRS]]
    if more:
        vort = diagnostics.vorticity(df, GRID).withColumnRenamed("vort_r", "w")
        df = vort.select("*", *[F.expr(f"w * u_{a}").alias(f"w_{a}") for a in "xyz"])
        fields += more
    return coarse_ops.coarse_grain(df, GRID, SCALES, fields)


@query("d3_energy_transfer", f"{_PIBASE} select ell, ilat, ilon, round(1e3 * {_PI}, 3) + 0.0 as Pi from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(diagnostics.transfers(_coarse_cartesian(spark, sf_dir), GRID), ["ell", *PLACE], 3, Pi="1e3 * Pi")


@query("d7_div_transport", f"{_PIBASE} select ell, ilat, ilon, round(1e3 * {_DIVJ}, 3) + 0.0 as div_transport from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(diagnostics.transfers(_coarse_cartesian(spark, sf_dir), GRID), ["ell", *PLACE], 3, div_transport="1e3 * div_transport")


_ORD = [(a, b) for a in "xyz" for b in "xyz"]
_TAUS = ", ".join(f"{_tau(a, b)} as t{a}{b}, u{a} * {_tau(a, b)} as q{a}{b}" for a, b in _ORD)
_SHIFT = "1025 * (" + " + ".join(f"(u{a} * {_grad(f't{a}{b}', b)} - {_grad(f'q{a}{b}', b)})" for a, b in _ORD) + ")"


@query("d4_transfer_shifted", f"with {FLAT}, {_CARTQ}, {_brute(fields=_UF, source='quad')}, st as (select *, {_TAUS} from coarse), {both('g', 'st', [f'{c}{a}{b}' for c in 'tq' for a, b in _ORD], ['ell'])} select "
    f"ell, ilat, ilon, round(1e3 * {_SHIFT}, 3) + 0.0 as Pi from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(diagnostics.transfers_shifted(_coarse_cartesian(spark, sf_dir), GRID), ["ell", *PLACE], 3, Pi="1e3 * Pi_shifted")


_ZQ = ( f"with {FLAT}, {both('v0', 'flat', ['u', 'v'])}, cart as (select *, {_CART}, {_VORT} as w from v0), quad as (select *, w "
    f"* ux as wx, w * uy as wy, w * uz as wz from cart), {_brute(fields='ux uy uz w wx wy wz', source='quad')}, st as (select *, "
    f"wx - w * ux as tx, wy - w * uy as ty, wz - w * uz as tz, w * (wx - w * ux) as qx, w * (wy - w * uy) as qy, w * (wz - w * "
    f"uz) as qz from coarse), {both('g', 'st', [c + a for c in 'tq' for a in 'xyz'], ['ell'])}")
_Z = "1025 * (" + " + ".join(f"(w * {_grad('t' + a, a)} - {_grad('q' + a, a)})" for a in "xyz") + ")"


@query("d6_enstrophy_transfer", f"{_ZQ} select ell, ilat, ilon, round(1e15 * {_Z}, 3) + 0.0 as Z from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = diagnostics.transfers(_coarse_cartesian(spark, sf_dir, ["w", "w_x", "w_y", "w_z"]), GRID, vorticity_products=True)
    return out(df, ["ell", *PLACE], 3, Z="1e15 * Z")


_HELM = f"-1025 * (dlon_u / ({R} * cos(lat)) * (uu - u * u) + (dlat_u / {R} + dlon_v / ({R} * cos(lat))) * (uv - u * v) + dlat_v / {R} * (vv - v * v))"


@query("d5_transfer_helmholtz", f"{_COARSE_Q}, {both('g', 'coarse', ['u', 'v'], ['ell'])} select ell, ilat, ilon, round(1e3 * {_HELM}, 3) + 0.0 as Pi from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _coarse_products(spark, sf_dir).withColumnsRenamed({"u": "u_lon", "v": "u_lat"})
    return out(diagnostics.transfers_helmholtz(df, GRID), ["ell", *PLACE], 3, Pi="1e3 * Pi_helm")


_OM = repr(2 * math.pi / 86400)
_GEO = ( f"with {FLAT}, {both('g1', 'flat', ['ssh'])}, {derived('g2', 'g1', ['ilon'], 'ilat', {'bb': 'dlat_ssh'})}, {derived('g3', 'g2', ['ilat'], 'ilon', {'ab': 'dlat_ssh'})}, "
    f"e as (select *, 2 * {_OM} * sin(lat) as f, 2 * {_OM} * cos(lat) / {R} as beta from g3)")


@query("d15_geostrophic", f"{_GEO}, w as (select *, -9.81 / f * dlat_ssh / {R} as u1, 9.81 / f * dlon_ssh / ({R} * cos(lat)) as v1 from e) select ilat, "
    f"ilon, {rounded(u_lon='case when abs(u1) < 100 and abs(v1) < 100 then u1 end', u_lat='case when abs(u1) < 100 and abs(v1) < 100 then v1 end')} from w")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(diagnostics.geostrophic_velocity(flat(spark, sf_dir).select("itime", "idepth", *PLACE, "ssh"), GRID), PLACE, u_lon="u_lon", u_lat="u_lat")


@query("h12_beta_velocity", f"{_GEO} select ilat, ilon, {rounded(u='-9.81 / beta * bb / (6371e3 * 6371e3)', v='9.81 / beta * ab / (6371e3 * 6371e3 * cos(lat))')} from e")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(diagnostics.beta_velocity(flat(spark, sf_dir), GRID, names=("bu", "bv")), PLACE, u="bu", v="bv")


_MEANS = ( f"{CUBE.replace('cube as', 'full_cube as')}, tm as (select idepth, ilat, ilon, avg(u) as u, avg(v) as v, avg(u * u) as uu, "
    f"avg(u * v) as uv, avg(v * v) as vv, any_value(lat) as lat, any_value(lon) as lon from full_cube group by 1, 2, 3)")


@query("d17_eddy_conversion", f"with {_MEANS}, {both('g', 'tm', ['u', 'v'], ['idepth'])} select idepth, ilat, ilon, round(1025 / {R} * ((uu - u * u) * "
    f"dlon_u / cos(lat) + (uv - u * v) * dlat_u + (uv - u * v) * dlon_v / cos(lat) + (vv - v * v) * dlat_v), 4) + 0.0 as conversion from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube(spark, sf_dir).groupBy("idepth", *PLACE).agg(*[F.avg(F.expr(e)).alias(n) for n, e in (("u_lon", "u"), ("u_lat", "v"), ("uu", "u * u"), ("uv", "u * v"), ("vv", "v * v"))])
    return out(diagnostics.eddy_mean_conversion(df, GRID), ["idepth", *PLACE], conversion="conversion")


_C1 = f"c1 as (select itime, idepth, ilat, ilon, coalesce(u, 0) as u, coalesce(v, 0) as v, lat, lon from cube)"


@query("d16_radial_velocity", f"with {CUBE}, {_C1}, {both('g', 'c1', ['u', 'v'], ['itime', 'idepth'])}, d as (select *, -({_DIV}) as conv, 100.0 * (idepth "
    f"+ 1) as z from g), s as (select *, coalesce(0.5 * (conv + lag(conv) over w) * abs(lag(z) over w - z), 0) as part from d window "
    f"w as (partition by itime, ilat, ilon order by idepth desc)) select itime, idepth, ilat, ilon, round(1e3 * sum(part) over "
    f"(partition by itime, ilat, ilon order by idepth desc rows between unbounded preceding and current row), 4) + 0.0 as u_r from s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube(spark, sf_dir).select(*KEYS, *PLACE, F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("v", F.lit(0.0)).alias("v"))
    df = diagnostics.radial_velocity(df.withColumn("z", F.expr("100.0D * (idepth + 1)")), GRID, "z", u_lon="u", u_lat="v")
    return out(df, [*KEYS, *PLACE], u_r="1e3 * u_r")


# ------------------------------------------------------------------ reductions


@query("a1_region_areas", f"with {CUBE}, {_REGION_SQL} select itime, idepth, region, round(sum(cos(cube.lat)), 4) + 0.0 as area, round(sum(case when "
    f"u is not null then cos(cube.lat) else 0 end), 4) + 0.0 as water_area from cube join regions using (ilat, ilon) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube(spark, sf_dir).withColumn("water", F.col("u").isNotNull())
    unit = CFG.earth_radius**2 * GRID.dlat * GRID.dlon
    return out(aggregate.region_areas(df, aggregate.region_table(GRID, spark, _REGIONS), GRID, water="water"), [*KEYS, "region"], area=f"area / {unit!r}", water_area=f"water_area / {unit!r}")


_A2 = f"m as (select itime, idepth, region, sum(coalesce(u, 0) * cos(cube.lat)) / sum(cos(cube.lat)) as mean from cube join regions using (ilat, ilon) group by all)"


@query("a2_region_mean_std", f"with {CUBE}, {_REGION_SQL}, {_A2} select itime, idepth, region, round(any_value(mean), 4) + 0.0 as u_area_average, round(sqrt(sum(power(mean "
    f"- coalesce(u, 0), 2) * cos(cube.lat)) / sum(cos(cube.lat))), 4) + 0.0 as u_area_std_dev from cube join regions using (ilat, "
    f"ilon) join m using (itime, idepth, region) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = aggregate.region_mean_std(cube(spark, sf_dir), aggregate.region_table(GRID, spark, _REGIONS), GRID, ["u"])
    return out(df, [*KEYS, "region"], u_area_average="u_area_average", u_area_std_dev="u_area_std_dev")


@query("coarse_region_average", f"with {FLAT}, {_REGION_SQL}, {_brute(fields='u v')} select ell, region, round(sum(u * cos(coarse.lat)) / sum(cos(coarse.lat)), "
    f"4) + 0.0 as u_area_average, round(sum(v * cos(coarse.lat)) / sum(cos(coarse.lat)), 4) + 0.0 as v_area_average from coarse "
    f"join regions using (ilat, ilon) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coarse_ops.coarse_grain(flat(spark, sf_dir), GRID, SCALES, ["u", "v"])
    df = aggregate.region_mean_std(df, aggregate.region_table(GRID, spark, _REGIONS), GRID, ["u", "v"], keys=["ell"])
    return out(df, ["ell", "region"], u_area_average="u_area_average", v_area_average="v_area_average")


@query("a3_zonal_mean", f"with {CUBE}, m as (select itime, idepth, ilat, coalesce(sum(u * cos(lat)), 0) / sum(cos(lat)) as mean from cube group by "
    f"all) select itime, idepth, ilat, round(any_value(mean), 4) + 0.0 as u_zonal_average, round(sqrt(coalesce(sum(power(u - mean, "
    f"2) * cos(lat)), 0) / sum(cos(lat))), 4) + 0.0 as u_zonal_std_dev from cube join m using (itime, idepth, ilat) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = aggregate.zonal_mean(cube(spark, sf_dir), GRID, ["u"], water="u is not null", deviations=True)
    return out(df, [*KEYS, "ilat"], u_zonal_average="u_zonal_average", u_zonal_std_dev="u_zonal_std_dev")


@query("a4_zonal_median", f"with {CUBE}, l as (select itime, idepth, ilat, list_sort(list(u) filter (u is not null)) as l from cube group by all) select "
    f"itime, idepth, ilat, round(l[len(l) // 2 + 1], 4) + 0.0 as u_zonal_median from l")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(aggregate.zonal_median(cube(spark, sf_dir), ["u"], water="u is not null"), [*KEYS, "ilat"], u_zonal_median="u_zonal_median")


@query("a5_time_mean_std", f"with {CUBE} select idepth, ilat, ilon, round(avg(u), 4) + 0.0 as u_time_average, round(stddev_pop(u), 4) + 0.0 as u_time_std_dev from cube group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(aggregate.time_mean_std(cube(spark, sf_dir), ["u"], water="u is not null"), ["idepth", *PLACE], u_time_average="u_time_average", u_time_std_dev="u_time_std_dev")


@query("a6_water_count", f"with {CUBE} select idepth, ilat, ilon, count(u) as water_count, count(u) > 0 as ever_water from cube group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.water_count(cube(spark, sf_dir), "u is not null")


_EDGES = {"lat": [-90.0, -40.0, -10.0, 20.0, 60.0], "lon": [-180.0, -90.0, 0.0, 90.0]}


def _box_rows(n: int, start: float, edges: list[float]) -> str:
    axis = [start + 10.0 * k for k in range(n)]
    first = [min(n - 1, sum(x < e for x in axis)) for e in edges]
    return ", ".join(f"({i}, {k})" for k, (a, b) in enumerate(zip(first, [*first[1:], n - 1], strict=True)) for i in range(a, b))


@query("a7_coarse_map", f"with {CUBE}, la(ilat, icoarse_lat) as (values {_box_rows(18, -85.0, _EDGES['lat'])}), lo(ilon, icoarse_lon) as (values {_box_rows(36, -175.0, _EDGES['lon'])}) "
    f"select itime, idepth, icoarse_lat, icoarse_lon, round(coalesce(sum(u * cos(lat)) / sum(cos(lat)) filter (u is not null), "
    f"0), 4) + 0.0 as u_coarsened_map from cube join la using (ilat) join lo using (ilon) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [[math.radians(x) for x in _EDGES[a]] for a in ("lat", "lon")]
    return out(aggregate.coarse_map(cube(spark, sf_dir), GRID, ["u"], *edges, water="u is not null"), [*KEYS, "icoarse_lat", "icoarse_lon"], u_coarsened_map="u_coarsened_map")


#: Bounds of the bins: 300 on either side of 0, a tenth of a decade apart, up to 1e10 per day squared.
_OWB = ", ".join(repr(x) for x in [*[-(10 ** (math.log10(1e10 / 86400.0**2) - k / 10)) for k in range(300)], 0.0, *[10 ** (math.log10(1e10 / 86400.0**2) - k / 10) for k in range(299, -1, -1)]])
_OW = f"pow({_SN}, 2) + pow({_SS}, 2) - pow({_VORT}, 2)"


@query("a8_okubo_weiss_histogram", f"with {FLAT}, {_REGION_SQL}, {both('g', 'flat', ['u', 'v'])}, o as (select *, {_OW} as ow from g), b as (select *, least(600, "
    f"len(list_filter([{_OWB}], lambda x: x < ow))) as iokubo from o) select cast(iokubo as int) as iokubo, region, round(sum(cos(b.lat)), "
    f"4) + 0.0 as area, round(sum(u * cos(b.lat)) / sum(cos(b.lat)), 4) + 0.0 as u_average from b join regions using (ilat, ilon) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = aggregate.okubo_weiss_histogram(_vorticity(spark, sf_dir), aggregate.region_table(GRID, spark, _REGIONS), GRID, ["u"])
    return out(df, ["iokubo", "region"], area=f"area / {CFG.earth_radius**2 * GRID.dlat * GRID.dlon!r}", u_average="u_average")


@query("a11_spatial_average", f"with {CUBE} select itime, idepth, round(sum(u * cos(lat)) / sum(cos(lat)), 4) + 0.0 as u_average from cube where u is not null group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(aggregate.spatial_average(cube(spark, sf_dir), GRID, ["u"], water="u is not null"), KEYS, u_average="u_average")


_COARSER = Grid.degrees(6, 9, -75.0, 30.0, -160.0, 40.0)


def _inclusive(n: int, start: float, coarse: list[float]) -> str:
    axis = [start + 10.0 * k for k in range(n)]
    mid = [(a + b) / 2 for a, b in zip(coarse, coarse[1:], strict=False)]
    rows = []
    for k, (lo, hi) in enumerate(zip([coarse[0], *mid], [*mid, coarse[-1]], strict=True)):
        a, b = (min(n - 1, sum(x < e - 1e-9 for x in axis)) for e in (lo, hi))
        rows += [f"({i}, {k})" for i in range(a, b + 1)]
    return ", ".join(rows)


_A12 = f"la(ilat, clat) as (values {_inclusive(18, -85.0, [-75.0 + 30 * k for k in range(6)])}), lo(ilon, clon) as (values {_inclusive(36, -175.0, [-160.0 + 40 * k for k in range(9)])})"


@query("a12_coarsen_linear", f"with {CUBE}, {_A12}, s as (select itime, idepth, clat, clon, avg(u) as m, count(u) as n, count(*) - count(u) as land from "
    f"cube join la using (ilat) join lo using (ilon) group by all) select itime, idepth, cast(clat as int) as ilat, cast(clon as "
    f"int) as ilon, round(case when n > 0 and n >= land then m else 0 end, 4) + 0.0 as u, n > 0 and n >= land as water, n as seed_count from s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = Grid(tuple(round(x, 12) for x in GRID.lats), tuple(round(x, 12) for x in GRID.lons))
    coarse = Grid(tuple(round(x, 12) - 1e-10 for x in _COARSER.lats), tuple(round(x, 12) - 1e-10 for x in _COARSER.lons))
    df = reshape.coarsen_linear(cube(spark, sf_dir), fine, coarse, "u", water="u is not null")
    return df.select(*KEYS, *PLACE, (F.round("u", 4) + 0.0).alias("u"), "water", "seed_count")


@query("a13_depth_integral", f"with {CUBE}, s as (select *, coalesce(0.5 * (coalesce(u, 0) + lag(coalesce(u, 0)) over w) * 100, 0) as part from cube window "
    f"w as (partition by itime, ilat, ilon order by idepth desc)) select itime, idepth, ilat, ilon, round(sum(part) over (partition "
    f"by itime, ilat, ilon order by idepth desc rows between unbounded preceding and current row) / pi(), 4) + 0.0 as total from s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube(spark, sf_dir).withColumns({"u": F.coalesce("u", F.lit(0.0)), "z": F.expr("100.0D * idepth")})
    return out(aggregate.depth_integral(df, "z", ["u"]), [*KEYS, *PLACE], total="u_integral / pi()")


@query("a14_value_range", f"with {CUBE} select round(least(min(u), 0), 4) + 0.0 as min_u, round(greatest(max(u), 0), 4) + 0.0 as max_u, round(least(min(v), "
    f"0), 4) + 0.0 as min_v, round(greatest(max(v), 0), 4) + 0.0 as max_v from cube")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(aggregate.value_range(cube(spark, sf_dir), ["u", "v"]), [], **{c: c for c in ("min_u", "max_u", "min_v", "max_v")})


@query("a15_error_norms", f"with {CUBE}, e as (select itime, idepth, cos(lat) as a, power(u - rho / 1000, 2) + power(v - ssh, 2) as g, u * u + v * "
    f"v as s, power(rho / 1000, 2) + ssh * ssh as o from cube where u is not null) select itime, idepth, round(sqrt(sum(g * a) "
    f"/ sum(a)), 4) + 0.0 as l2, round(sqrt(max(g)), 4) + 0.0 as linf, round(sqrt(sum(g * a) / sum(s * a)), 4) + 0.0 as relative_l2, "
    f"round(512.5 * sum((s - o) * a) / sum(a), 2) + 0.0 as ke_error from e group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube(spark, sf_dir).where("u is not null").withColumn("r", F.expr("rho / 1000"))
    df = aggregate.error_norms(df, GRID, ("u", "v"), ("r", "ssh"))
    return df.select(*KEYS, *[(F.round(c, d) + 0.0).alias(c) for c, d in (("l2", 4), ("linf", 4), ("relative_l2", 4), ("ke_error", 2))])


@query("a16_trajectory_correlation", "with t as (select cast(o_custkey % 50 as int) as traj, o_totalprice as p, cast(day(o_orderdate) as double) as d from orders) "
    "select traj, round(avg(d), 4) + 0.0 as mean_d, round(avg(p), 2) + 0.0 as mean_p, round(corr(p, d), 4) + 0.0 as corr_p_d from t group by traj")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("cast(o_custkey % 50 as int)").alias("traj"), F.col("o_totalprice").alias("p"), F.dayofmonth("o_orderdate").cast("double").alias("d"))
    df = aggregate.trajectory_correlation(df, [("p", "d")])
    return df.select("traj", (F.round("mean_d", 4) + 0.0).alias("mean_d"), (F.round("mean_p", 2) + 0.0).alias("mean_p"), (F.round("corr_p_d", 4) + 0.0).alias("corr_p_d"))


_SUBSETS = ( "s as (select row_number() over (order by a.range, b.range, c.range) - 1 as subset, unnest([a.range, b.range, c.range]) as "
    "itime from range(7) a, range(7) b, range(7) c where a.range < b.range and b.range < c.range)")


@query("a17_subset_means", f"with {CUBE}, {_SUBSETS} select cast(subset as int) as subset, idepth, ilat, round(avg(u), 4) + 0.0 as u from cube join s using (itime) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(aggregate.subset_means(cube(spark, sf_dir), "itime", None, 3, ["u"], ["idepth", "ilat"]), ["subset", "idepth", "ilat"], u="u")


_NODES = [(1e6, 0.2, 0.25), (2e6, 0.5, 0.5), (4e6, 0.3, 0.25)]


@query("a18_quadrature", f"with {FLAT}, {_brute(fields='u').replace('(2e6::double), (5e6::double)', '(1e6::double), (2e6::double), (4e6::double)')}, "
    f"n(ell, w, w2) as (values (1e6::double, 0.2::double, 0.25::double), (2e6::double, 0.5::double, 0.5::double), (4e6::double, "
    f"0.3::double, 0.25::double)) select ilat, ilon, round(sum(5 * n.w * u), 4) + 0.0 as u, round(sum(5 * (n.w - n.w2) * u), 4) "
    f"+ 0.0 as u_error from coarse join n using (ell) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coarse_ops.coarse_grain(flat(spark, sf_dir), GRID, [n[0] for n in _NODES], ["u"])
    return out(aggregate.quadrature_sum(df, _NODES, ["u"], 5.0, PLACE), PLACE, u="u", u_error="u_error")


@query("a19_percentile_regions", f"with {CUBE}, c as (select itime, idepth, quantile_cont(u, 0.25) as a, quantile_cont(u, 0.5) as b, quantile_cont(u, 0.75) "
    f"as c from cube group by all), j as (select cube.*, a, b, c from cube join c using (itime, idepth)) select 'u > p25' as region, "
    f"itime, idepth, ilat, ilon from j where u > a union all select 'u > p50', itime, idepth, ilat, ilon from j where u > b union "
    f"all select 'u > p75', itime, idepth, ilat, ilon from j where u > c")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.percentile_regions(cube(spark, sf_dir), "u", [25, 50, 75])


@query("k6_pack_int16", f"with {CUBE}, r as (select least(min(u), 0) as a, greatest(max(u), 0) as b from cube) select itime, idepth, ilat, ilon, "
    f"cast(round((u - (a + b) / 2) / ((b - a) / -32765)) as smallint) as packed from cube, r where u is not null")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.pack_int16(cube(spark, sf_dir), "u").where("u is not null").select(*KEYS, *PLACE, "packed")


# ------------------------------------------------------------------ regridding and interpolation

_FINE = Grid.degrees(30, 50, -88.0, 6.0, -178.0, 7.0)


@query("j15_refine_bilinear", f"with {FLAT}, t as (select cast(a.range as int) as tlat, cast(b.range as int) as tlon, -88.0 + 6.0 * a.range as la, -178.0 "
    f"+ 7.0 * b.range as lo from range(30) a, range(50) b), p as (select *, least(greatest(cast(ceil((la + 85) / 10 - 1e-9) as "
    f"int), 1), 17) as i, least(greatest(cast(ceil((lo + 175) / 10 - 1e-9) as int), 1), 35) as j from t), w as (select *, (la + "
    f"85) / 10 - (i - 1) as y, (lo + 175) / 10 - (j - 1) as x from p) select tlat as ilat, tlon as ilon, round((1 - y) * ((1 - "
    f"x) * a.u + x * b.u) + y * ((1 - x) * c.u + x * d.u), 4) + 0.0 as u from w join flat a on a.ilat = i - 1 and a.ilon = j - "
    f"1 join flat b on b.ilat = i - 1 and b.ilon = j join flat c on c.ilat = i and c.ilon = j - 1 join flat d on d.ilat = i and d.ilon = j")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(reshape.refine_bilinear(flat(spark, sf_dir), GRID, _FINE, ["u"]), PLACE, u="u")


_NEAR = Grid.degrees(12, 20, -83.1, 14.3, -171.7, 17.1)


@query("j20_nearest", f"with {FLAT}, t as (select cast(a.range as int) as tlat, cast(b.range as int) as tlon, -83.1 + 14.3 * a.range as la, -171.7 "
    f"+ 17.1 * b.range as lo from range(12) a, range(20) b) select tlat as ilat, tlon as ilon, round(u, 4) + 0.0 as u from t join "
    f"flat on ilat = least(greatest(cast(round((la + 85) / 10) as int), 0), 17) and ilon = least(greatest(cast(round((lo + 175) / 10) as int), 0), 35)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(reshape.nearest_regrid(flat(spark, sf_dir), GRID, _NEAR), PLACE, u="u")


@query("j19_time_interpolation", f"with {CUBE}, t(k, a, w) as (values (0, 0, 0.25::double), (1, 2, 0.5::double), (2, 5, 0.75::double)) select cast(k as int) "
    f"as itime, idepth, ilat, ilon, round((1 - w) * coalesce(p.u, 0) + w * coalesce(q.u, 0), 4) + 0.0 as u from t join cube p on "
    f"p.itime = a join cube q using (idepth, ilat, ilon) where q.itime = a + 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube(spark, sf_dir).select(*KEYS, *PLACE, F.coalesce("u", F.lit(0.0)).alias("u"))
    return out(reshape.interpolate_times(df, [float(k) for k in range(7)], [0.25, 2.5, 5.75], ["u"]), [*KEYS, *PLACE], u="u")


@query("j12_coast", f"with {MESH}, m as (select *, {WATER} as water from mesh), near as (select distinct a.ilat, a.ilon from m a, m b where a.water "
    f"and not b.water and abs(a.ilat - b.ilat) + least(abs(a.ilon - b.ilon), 36 - abs(a.ilon - b.ilon)) <= 3) select ilat, ilon from near")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir).withColumn("water", F.expr(WATER))
    return reshape.coast(df, GRID, 3).select(*PLACE)


@query("j13_fill_land")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir).withColumn("u", F.expr(f"case when {WATER} then u end"))
    return solve.fill_land(df, GRID, ["u"])


@query("j14_fill_land_from_coast")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir).withColumn("u", F.expr(f"case when {WATER} then u end"))
    return solve.fill_land(df, GRID, ["u"], near_coast=3)


# ------------------------------------------------------------------ trajectories

_PTS = ( "pts as (select cast(o_orderkey as int) as traj, cast(0 as int) as iout, 6.0 * (o_custkey % 997) / 997 as time, radians(-85 "
    "+ 170.0 * (o_orderkey % 7919) / 7919) as lat, radians(-175 + 350.0 * (o_custkey % 1009) / 1009) as lon from orders)")


@query(
    "j18_project_onto_trajectory",
    f"with {CUBE}, {_PTS}, b as (select *, least(cast(floor(time) as int), 5) as k, (lat - radians(-85.0)) / radians(10.0) as "
    f"y, (lon - radians(-175.0)) / radians(10.0) as x from pts), c as (select *, cast(floor(y) as int) as i, cast(floor(x) as int) "
    f"as j, time - k as wt from b), s as (select traj, c.time, c.lat, c.lon, sum((case when dt = 1 then wt else 1 - wt end) * (case "
    f"when di = 1 then y - i else 1 - (y - i) end) * (case when dj = 1 then x - j else 1 - (x - j) end) * coalesce(u, 0)) as u "
    f"from c, (values (0), (1)) a(dt), (values (0), (1)) e(di), (values (0), (1)) f(dj), cube where idepth = 0 and cube.itime = "
    f"k + dt and cube.ilat = i + di and cube.ilon = (j + dj) % 36 and i between 0 and 16 group by all) select traj, round(u, 4) + 0.0 as u from s",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    points = rows.select(F.expr("cast(o_orderkey as int)").alias("traj"), F.lit(0).alias("iout"), F.expr("6.0D * (o_custkey % 997) / 997").alias("time"), F.expr("radians(-175 + 350.0D * (o_custkey % 1009) / 1009)").alias("lon"), F.expr("radians(-85 + 170.0D * (o_orderkey % 7919) / 7919)").alias("lat"))
    df = particles.project_onto(points, cube(spark, sf_dir).where("idepth = 0"), [float(k) for k in range(7)], GRID, ["u"])
    return out(df.where("u is not null"), ["traj"], u="u")


@query("p4_compare_trajectories", f"with {_PTS}, d as (select traj, lat, lat + 0.01 * sin(lon) as lat2, 0.02 * cos(lat) as dl from pts) select traj, round(2 "
    f"* 6371e3 * asin(least(1.0, sqrt(power(sin((lat2 - lat) / 2), 2) + cos(lat) * cos(lat2) * power(sin(dl / 2), 2)))), 0) + 0.0 as dist from d")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a = rows.select(F.expr("cast(o_orderkey as int)").alias("traj"), F.lit(0).alias("iout"), F.expr("radians(-175 + 350.0D * (o_custkey % 1009) / 1009)").alias("lon"), F.expr("radians(-85 + 170.0D * (o_orderkey % 7919) / 7919)").alias("lat"))
    b = a.select("traj", "iout", F.expr("lon + 0.02 * cos(lat)").alias("lon"), F.expr("lat + 0.01 * sin(lon)").alias("lat"))
    return out(particles.fore_back_distance(a, b, FilterConfig(high_precision_distance=True)), ["traj"], 0, dist="dist")


# ------------------------------------------------------------------ shallow water

_PLANE = Grid.plane(18, 36, 10e3, 10e3)
_WATER_CFG = FilterConfig(cartesian=True, periodic_y=True)
_SW = ( "sw as (select cast(0 as int) as itime, cast(k as int) as idepth, ilat, ilon, u / 10 + k as u, v / 10 - k as v, 100 + rho "
    "- 1025 + 50 * k + 5 * ssh as h from flat, (values (0), (1)) l(k))")


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir).select("itime", F.explode(F.array(F.lit(0), F.lit(1))).alias("idepth"), *PLACE, "u", "v", "rho", "ssh").select("itime", "idepth", *PLACE, F.expr("u / 10 + idepth").alias("u"), F.expr("v / 10 - idepth").alias("v"), F.expr("100 + rho - 1025 + 50 * idepth + 5 * ssh").alias("h"))


@query("sw3_pressure", f"with {FLAT}, {_SW} select a.idepth, a.ilat, a.ilon, round(9.81 * (case when a.idepth = 0 then 1000 * (a.h + b.h) else 1000 "
    f"* b.h + 1010 * a.h end), 2) + 0.0 as p from sw a join sw b on a.ilat = b.ilat and a.ilon = b.ilon and b.idepth = 1 - a.idepth")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(shallow_water.pressure(_layers(spark, sf_dir), (1000.0, 1010.0)), ["idepth", *PLACE], 2, p="p")


def _plane_gradients(name: str, source: str, fields: list[str], keys: list[str], derivative: int = 1) -> str:
    return both(name, source, fields, keys, derivative=derivative, periodic_y=True, step=10e3, names="x y")


@query("sw4_laplacians", f"with {FLAT}, {_SW}, {_plane_gradients('g', 'sw', ['u', 'v', 'h'], ['idepth'], 2)} select idepth, ilat, ilon, {rounded(h_lap_u='1e6 * h * (d2x_u + d2y_u)', h_lap_v='1e6 * h * (d2x_v + d2y_v)', lap_h='1e6 * (d2x_h + d2y_h)')} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shallow_water.laplacians(_layers(spark, sf_dir), _PLANE, _WATER_CFG, KEYS)
    return out(df, ["idepth", *PLACE], h_lap_u="1e6 * h_lap_u", h_lap_v="1e6 * h_lap_v", lap_h="1e6 * lap_h")


_SWF = "h hu hv huu huv hvv hh"
_SWB = (
    "quad as (select idepth, ilat, ilon, h, h * u as hu, h * v as hv, h * u * u as huu, h * u * v as huv, h * v * v as hvv, h * h as hh from sw), "
    "pw as (select a.idepth, a.ilat, a.ilon, exp(-4 * (power(least(abs(a.ilon - b.ilon), 36 - abs(a.ilon - b.ilon)) * 10e3, 2) "
    "+ power(least(abs(a.ilat - b.ilat), 18 - abs(a.ilat - b.ilat)) * 10e3, 2)) / (30e3 * 30e3)) as w, b.* exclude (idepth, ilat, "
    "ilon) from quad a join quad b using (idepth)), "
    f"bar0 as (select idepth, ilat, ilon, {', '.join(f'sum(w * {c}) / sum(w) as {c}' for c in _SWF.split())} from pw group by all), "
    "bar1 as (select idepth, ilat, ilon, h, hu / h as u, hv / h as v, huu / h - power(hu / h, 2) as tuu, huv / h - hu / h * hv "
    "/ h as tuv, hvv / h - power(hv / h, 2) as tvv, 9.81 * (hh - h * h) as thp from bar0), "
    "bar2 as (select *, 0.5 * h * (u * u + v * v) as KE, 0.5 * 9.81 * h * h as PE from bar1), "
    "bar as (select *, u * KE + h * (u * tuu + v * tuv) as fx, v * KE + h * (u * tuv + v * tvv) as fy, u * PE as px, v * PE as py from bar2)"
)


@query("sw1_one_layer", f"with {FLAT}, {_SW}, {_SWB}, {_plane_gradients('g', 'bar', ['u', 'v', 'h', 'thp', 'fx', 'fy', 'px', 'py'], ['idepth'])} select "
    f"idepth, ilat, ilon, {rounded(KE='KE', PE='PE', Pi='1e3 * (h * (dx_u * tuu + dy_u * tuv + dx_v * tuv + dy_v * tvv) - 0.5 * u * dx_thp - 0.5 * v * dy_thp)', KE_trans='-1e3 * (dx_fx + dy_fy)', Gamma='0.0', PE_trans='-1e3 * (dx_px + dy_py)', KE2PE='1e3 * 9.81 * h * (u * dx_h + v * dy_h)')} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shallow_water.one_layer(_layers(spark, sf_dir), _PLANE, [30e3], _WATER_CFG)
    return out(df, ["idepth", *PLACE], KE="KE", PE="PE", Pi="1e3 * Pi", KE_trans="1e3 * KE_trans", Gamma="Gamma", PE_trans="1e3 * PE_trans", KE2PE="1e3 * KE2PE")


# ------------------------------------------------------------------ merges


@query("u1_merge_scales", f"with {FLAT} select 1e5::double as ell, ilat, ilon, round(u, 4) + 0.0 as u from flat union all select 2e5::double, ilat, ilon, round(2 * u, 4) + 0.0 from flat")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir)
    merged = reshape.merge_results({2e5: {"full": df.withColumn("u", F.expr("2 * u")), "time": df}, 1e5: {"full": df}}, exclude=("time",))
    assert set(merged) == {"full"}
    return out(merged["full"], ["ell", *PLACE], u="u")


@query("u2_merge_resolutions", f"with {FLAT} select ilat, ilon, round(case when ilat % 2 = 0 then u else -u end, 4) + 0.0 as u from flat")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir)
    return out(reshape.merge_resolutions([(18, df.withColumn("u", -F.col("u"))), (36, df.where("ilat % 2 = 0"))], PLACE), PLACE, u="u")


@query("u3_merge_times", f"with {CUBE} select itime, idepth, ilat, ilon, round(u, 4) + 0.0 as u from cube")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube(spark, sf_dir)
    late = df.where("itime >= 4").withColumn("itime", F.expr("itime - 4"))
    return out(reshape.merge_times([df.where("itime < 4"), late]), [*KEYS, *PLACE], u="u")
