"""One query per operator over fields from the driver's tables, each with SQL that computes the same by other means where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.config import KERNEL_PAD, FilterConfig
from tesseral.functions import geometry, kernels, seawater
from tesseral.grid import Grid
from tesseral.operators import aggregate, calculus, diagnostics, reshape
from tesseral.operators import coarse as coarse_ops
from tesseral.plans.fields import AREA, CUBE, DANG, FLAT, GRID, LAT, LON, MESH, WATER, cube, flat
from tesseral.plans.oracle import COEFFICIENTS, REGIONS, SEA_WATER, both, coefficient_rows, derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CFG = FilterConfig()
PLACE = ["ilat", "ilon"]
SCALES = [2e6, 5e6]
R = "6371e3"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def out(df: DataFrame, keys: list[str], digits: int = 4, **columns: Column | str) -> DataFrame:
    """Keys and rounded doubles, without negative zeros."""
    return df.select(*keys, *[(F.round(F.expr(c) if isinstance(c, str) else c, digits) + 0.0).alias(n) for n, c in columns.items()])


def rounded(digits: int = 4, **columns: str) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 as {n}" for n, c in columns.items())


# ------------------------------------------------------------------ geometry

DIST = f"(case when b.lat = a.lat and b.lon = a.lon then 0.0 else 6371e3 * acos(greatest(-1.0, least(1.0, sin(a.lat) * sin(b.lat) + cos(a.lat) * cos(b.lat) * cos(b.lon - a.lon)))) end)"


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRID.located(flat(spark, sf_dir), CFG)


@query("g3_distance", f"with {FLAT} select a.ilat, a.ilon, round({DIST}, 3) + 0.0 as dist from flat a, flat b where b.ilat = 4 and b.ilon = 9")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _located(spark, sf_dir).withColumns({"lat0": F.lit(GRID.lats[4]), "dl": F.expr(f"lon - {GRID.lons[9]!r}")})
    return out(df, PLACE, 3, dist=geometry.distance("lat", "lat0", "dl", CFG))


@query("g4_distance_precise", f"with {FLAT} select a.ilat, a.ilon, round(2 * 6371e3 * asin(least(1.0, sqrt(power(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) "
    f"* cos(b.lat) * power(sin((b.lon - a.lon) / 2), 2)))), 2) + 0.0 as dist from flat a, flat b where b.ilat = 4 and b.ilon = 9")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _located(spark, sf_dir).withColumns({"lat0": F.lit(GRID.lats[4]), "dl": F.expr(f"lon - {GRID.lons[9]!r}")})
    return out(df, PLACE, 2, dist=geometry.distance("lat", "lat0", "dl", FilterConfig(high_precision_distance=True)))


@query("g2_distance_plane", "with p as (select cast(a.range as int) as i, cast(b.range as int) as j from range(20) a, range(30) b) select i, j, round(sqrt(power(least(j "
    "* 1000.0, 30000.0 - j * 1000.0), 2) + power(i * 500.0, 2)), 6) + 0.0 as dist from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.range(20).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(30).select(F.col("id").cast("int").alias("j"))).withColumns({"y": F.expr("i * 500.0D"), "y0": F.lit(0.0), "dx": F.expr("j * 1000.0D")})
    return out(df, ["i", "j"], 6, dist=geometry.distance("y", "y0", "dx", FilterConfig(cartesian=True), 30000.0, 10000.0))


@query("g5_areas", f"with {FLAT} select ilat, ilon, round({AREA}, 0) + 0.0 as area from flat")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_located(spark, sf_dir), PLACE, 0, area="area")


@query("g6_areas_uneven", f"with t as (select cast(range as int) as ilat, radians(-80 + 9.0 * range + 0.1 * range * range) as lat from range(15)), "
    f"g as (select *, lat - lag(lat) over (order by ilat) as below, lead(lat) over (order by ilat) - lat as above from t) select "
    f"ilat, round(6371e3 * 6371e3 * cos(lat) * {DANG} * (coalesce(below, 0) + coalesce(above, 0)) / 2, 0) + 0.0 as area from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    uneven = Grid(tuple(math.radians(-80 + 9.0 * k + 0.1 * k * k) for k in range(15)), GRID.lons)
    return out(uneven.lat_dim(spark, FilterConfig(order=2, uniform_lat=False)), ["ilat"], 0, area="area")


_D = "(d / 1000.0)"
_SHAPES = {"tophat": f"case when {_D} < 1 then 1.0 else 0.0 end", "hypergaussian": f"exp(-power({_D}, 4))", "gaussian": f"exp(-power({_D}, 2))", "johnsongaussian": f"exp(-power({_D}, "
    f"2) / 8)", "sinc": f"case when d = 0 then 1.0 else sin(pi() * {_D}) / (pi() * {_D}) end", "smoothhat": f"0.5 * (1 - tanh(({_D} - "
    f"1) / 0.1))", "highorder": f"0.5 * (1 - tanh(({_D} - 1) / 0.1)) - 0.21534029041474162 * exp(-power(({_D} - 1) / 0.5, 2))"}


@query("g7_kernels", "with t as (select cast(range * 25 as double) as d from range(120)) " + " union all ".join(f"select '{k}' as kernel, d, round({e}, 9) + 0.0 as k from t" for k, e in _SHAPES.items()))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.range(120).select((F.col("id") * 25.0).alias("d"))
    parts = [df.select(F.lit(k).alias("kernel"), "d", (F.round(F.expr(kernels.kernel("d", "2000.0", FilterConfig(kernel=k))), 9) + 0.0).alias("k")) for k in KERNEL_PAD]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _slopes() -> str:
    h = 0.01
    text = lambda e, ell: e.replace(_D, f"(d / ({ell} / 2))")
    smooth = [k for k in _SHAPES if k != "tophat"]
    return "with t as (select cast(range * 25 + 10 as double) as d from range(100)) " + " union all ".join(f"select '{k}' as kernel, d, round(1e3 * (({text(e, 2000 + h)}) - ({text(e, 2000 - h)})) / {2 * h}, 4) + 0.0 as dk from t" for k, e in _SHAPES.items() if k in smooth)


@query("g7_kernel_derivatives", _slopes())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.range(100).select((F.col("id") * 25.0 + 10).alias("d"))
    parts = [df.select(F.lit(k).alias("kernel"), "d", (F.round(1e3 * F.expr(kernels.kernel_derivatives("d", "2000.0D", FilterConfig(kernel=k))[0]), 4) + 0.0).alias("dk")) for k in KERNEL_PAD if k != "tophat"]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


#: Where each kernel ends, in units of half its scale; the sinc is summed up to 100 at ten times the points.
_ENDS = {"tophat": 1.1, "hypergaussian": 2.5, "gaussian": 5.0, "johnsongaussian": 15.0, "sinc": 100.0, "smoothhat": 2.5, "highorder": 2.5}


def _alpha_sql() -> str:
    parts = []
    for k, e in _SHAPES.items():
        n = 100_000 if k == "sinc" else 10_000
        shape = e.replace(_D, "(r / 0.5)").replace("d = 0", "r = 0")
        # The lower sum of the sinc cancels to rounding: no ratio, both sums are compared.
        ratio = "null::double" if k == "sinc" else f"round(sum(({shape}) * r * r * r) / sum(({shape}) * r), 6) + 0.0"
        parts.append(f"select '{k}' as kernel, {ratio} as alpha, round(sum(({shape}) * r * r * r) * {_ENDS[k]}::double / {n}, 4) + 0.0 as upper, "
            f"round(sum(({shape}) * r) * {_ENDS[k]}::double / {n}, 4) + 0.0 as lower from (select range * ({_ENDS[k]}::double / {n}) as r from range({n}))")
    return " union all ".join(parts)


@query("g8_kernel_alpha", _alpha_sql())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = None
    for k in KERNEL_PAD:
        n, step, shape = kernels.alpha_sums(FilterConfig(kernel=k))
        df = spark.range(n).select((F.col("id") * step).alias("r")).select("r", F.expr(shape).alias("k"))
        one = df.agg(F.sum(F.expr("k * r * r * r")).alias("a"), F.sum(F.expr("k * r")).alias("b"))
        alpha = F.lit(None).cast("double") if k == "sinc" else F.round(F.expr("a / b"), 6) + 0.0
        one = one.select(F.lit(k).alias("kernel"), alpha.alias("alpha"), *[(F.round(F.col(c) * step, 4) + 0.0).alias(n) for c, n in (("a", "upper"), ("b", "lower"))])
        whole = one if whole is None else whole.unionByName(one)
    return whole


@query("g9_to_cartesian", f"with {FLAT} select ilat, ilon, {rounded(u_x='0.5 * cos(lon) * cos(lat) - u * sin(lon) - v * cos(lon) * sin(lat)', u_y='0.5 * sin(lon) * cos(lat) + u * cos(lon) - v * sin(lon) * sin(lat)', u_z='0.5 * sin(lat) + v * cos(lat)')} from flat")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = geometry.spherical_to_cartesian("0.5", "u", "v", "lon", "lat")
    return out(_located(spark, sf_dir), PLACE, **dict(zip(("u_x", "u_y", "u_z"), parts, strict=True)))


@query("g10_to_spherical", f"with {FLAT} select ilat, ilon, {rounded(u_r='u * cos(lon) * cos(lat) + v * sin(lon) * cos(lat) + ssh * sin(lat)', u_lon='v * cos(lon) - u * sin(lon)', u_lat='ssh * cos(lat) - u * cos(lon) * sin(lat) - v * sin(lon) * sin(lat)')} from flat")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = geometry.cartesian_to_spherical("u", "v", "ssh", "lon", "lat")
    return out(_located(spark, sf_dir), PLACE, **dict(zip(("u_r", "u_lon", "u_lat"), parts, strict=True)))


@query("g11_kinetic_energy", f"with {CUBE} select itime, idepth, ilat, ilon, round(512.5 * (u * u + v * v), 4) + 0.0 as ke from cube where u is not null")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(cube(spark, sf_dir).where("u is not null"), ["itime", "idepth", *PLACE], 4, ke=geometry.kinetic_energy(CFG.rho0, "u", "v"))


_W = {k: f"({e})" for k, e in SEA_WATER.items()}
_RHO = "({rho_w} + s * {rho_s} + s**1.5 * {rho_s15} + s * s * {rho_s2})".format(**_W)
_BULK = "({k_w} + s * {k_s} + s**1.5 * {k_s15} + p * ({k_p} + s * {k_ps} + s**1.5 * {k_ps15}) + p * p * ({k_p2} + s * {k_p2s}))".format(**_W)


@query("g12_density", f"with {FLAT}, w as (select ilat, ilon, 10 + u as t, 35 + v / 10 as s, 50 + 10 * ssh as p from flat) select ilat, ilon, round({_RHO} / "
    f"(1 - p / {_BULK}), 4) + 0.0 as rho from w")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir).select(*PLACE, F.expr("10 + u").alias("t"), F.expr("35 + v / 10").alias("s"), F.expr("50 + 10 * ssh").alias("p"))
    return out(df, PLACE, rho=seawater.density("t", "s", "p"))


@query("g13_temperature", f"with {FLAT}, w as (select ilat, ilon, 10 + u as theta, 1e5 * (50 + ssh) as p from flat) select ilat, ilon, round(283 * "
    f"9.738e-4 * 1.67e-4 / 3986 * p * (1 + 0.5 * 1.1e-8 * p + 283 * 9.738e-4 * 1e-5 / 3986 * p) + (theta + 273.15 - 283) * (1 + "
    f"283 * 9.738e-4 * 1e-5 / 3986 * p) + 283 - 273.15, 4) + 0.0 as t from w")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir).select(*PLACE, F.expr("10 + u").alias("theta"), F.expr("1e5 * (50 + ssh)").alias("p"))
    return out(df, PLACE, t=seawater.temperature("p", "theta"))


_MESH_DEG = f"{MESH}, deg as (select ilat, ilon, -85.0 + 10.0 * ilat as lat, -175.0 + 10.0 * ilon as lon from mesh)"


@query("g14_regions", f"with {_MESH_DEG} " + " union all ".join(f"select '{r}' as region, ilat, ilon from deg where {c}" for r, c in REGIONS.items()))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.region_table(GRID, spark, geometry.REGIONS)


@query("g15_mask_poles", "select cast(a.range as int) as ilat, cast(b.range as int) as ilon, abs(-90.0 + 10.0 * a.range) < 89.95 as water from range(19) a, range(36) b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    poles = Grid.degrees(19, 36, -90.0, 10.0, -175.0, 10.0)
    cells = poles.lat_dim(spark, CFG).select("ilat").crossJoin(poles.lon_dim(spark).select("ilon")).withColumn("water", F.lit(True))
    return reshape.mask_poles(cells, poles).select("ilat", "ilon", "water")


_SIZES = {"itime": 7, "idepth": 7, "ilat": 18, "ilon": 36}


@query("g16_index", f"with {CUBE}, n as (select (itime * 7 + idepth) as slice, row_number() over (partition by itime, idepth order by ilat, ilon) "
    f"- 1 as place, itime, idepth, ilat, ilon from cube) select cast(slice * 648 + place as bigint) as cell, itime, idepth, ilat, ilon from n")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cube(spark, sf_dir).select(F.expr(geometry.cell_index(_SIZES)).alias("cell"))
    return cells.select("cell", *[F.expr(e).alias(k) for k, e in geometry.cell_places("cell", _SIZES).items()])


@query("g1_radians", f"with {MESH} select ilat, ilon, round((-85.0 + 10.0 * ilat) * pi() / 180, 9) + 0.0 as lat, round((-175.0 + 10.0 * ilon) * pi() / 180, 9) + 0.0 as lon from mesh")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_located(spark, sf_dir), PLACE, 9, lat="lat", lon="lon")


# ------------------------------------------------------------------ reshaping

_SHORT = Grid.degrees(14, 36, -65.0, 10.0, -175.0, 10.0)


@query("r2_extend_field", f"with {FLAT} select itime, idepth, ilat, ilon, round(case when ilat between 2 and 15 then v else 0 end, 4) + 0.0 as v from flat")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = flat(spark, sf_dir).where("ilat between 2 and 15").withColumn("ilat", F.expr("ilat - 2"))
    df, _ = reshape.extend_to_poles(inner.select("itime", "idepth", "ilat", "ilon", "v"), _SHORT, ["v"])
    return out(df, ["itime", "idepth", *PLACE], v="v")


@query("r3_extend_mask", f"with {MESH} select ilat, ilon, case when ilat between 2 and 15 then {WATER} else false end as water from mesh")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = flat(spark, sf_dir).withColumn("water", F.expr(WATER)).where("ilat between 2 and 15").withColumn("ilat", F.expr("ilat - 2"))
    df, _ = reshape.extend_to_poles(inner.select("itime", "idepth", "ilat", "ilon", "water"), _SHORT, [], masks={"water": False})
    return df.select("ilat", "ilon", "water")


@query("r1_extend_latitude", "select cast(range as int) as ilat, round(-85.0 + 10.0 * range, 4) + 0.0 as lat from range(18)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, _ = _SHORT.extended(CFG)
    return out(wide.lat_dim(spark, CFG), ["ilat"], lat="degrees(lat)")


@query("r4_roll", f"with {FLAT} select ilat, cast((ilon + 1) % 36 as int) as ilon, round(u, 4) + 0.0 as u from flat")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(reshape.roll(flat(spark, sf_dir), GRID), PLACE, u="u")


@query("r5_subset", f"with {CUBE} select itime, idepth, cast((ilat - 2) // 3 as int) as ilat, cast((ilon - 1) // 2 as int) as ilon, round(u, "
    f"4) + 0.0 as u from cube where ilat between 2 and 14 and (ilat - 2) % 3 = 0 and ilon between 1 and 30 and (ilon - 1) % 2 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(reshape.subset(cube(spark, sf_dir), ilat=(2, 14, 3), ilon=(1, 30, 2)), ["itime", "idepth", *PLACE], u="u")


@query("r6_decimate", f"with {FLAT} select cast(ilat // 2 as int) as ilat, cast(ilon // 3 as int) as ilon, round(u, 4) + 0.0 as u from flat where ilat % 2 = 0 and ilon % 3 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(reshape.decimate(flat(spark, sf_dir), 2, 3), PLACE, u="u")


# ------------------------------------------------------------------ coarse-graining

_ELLS = "scales(ell) as (values (2e6::double), (5e6::double))"


def _brute(shape: str = "exp(-dd * dd)", fields: str = "u v", source: str = "flat", keys: str = "", weight: str = "1.0", below: str = "1.0", above: str = "1.0") -> str:
    """CTEs pairs and coarse: every target meets every source of its slice."""
    same = " and ".join(f"a.{k} = b.{k}" for k in keys.split()) or "true"
    more = "".join(f", a.{k}" for k in keys.split())
    values = ", ".join(f"sum(w * {above} * coalesce({f}_, 0)) / sum(w * {below}) as {f}" for f in fields.split())
    get = ", ".join(f"b.{f} as {f}_" for f in fields.split())
    return (
        f"{_ELLS}, dist as (select s.ell{more}, a.ilat, a.ilon, a.lat, a.lon, b.ilat as jlat, b.ilon as jlon, cos(b.lat) as area, {weight} as "
        f"wt_, {DIST} / (s.ell / 2) as dd, {get} from scales s, {source} a, {source} b where {same}), "
        f"pairs as (select *, ({shape}) * area * wt_ as w from dist), coarse as (select ell, {''.join(k + ', ' for k in keys.split())}ilat, "
        f"ilon, any_value(lat) as lat, any_value(lon) as lon, {values} from pairs group by all)"
    )


_BRUTE_SHAPES = {k: e.replace(_D, "dd").replace("d = 0", "dd = 0") for k, e in _SHAPES.items()}
_BRUTE_SHAPES = {k: e.replace("ddd", "dd") for k, e in _BRUTE_SHAPES.items()}


def _window(pad: float) -> str:
    """CTE win(ell, i, j, m): rows j in the window of row i, and the columns on either side."""
    half, there, back = f"({pad} * ell / 2)", "(sin(a.lat) * sin(b.lat) + cos(a.lat) * cos(b.lat))", "(sin(a.lat) * sin(b.lat) - cos(a.lat) * cos(b.lat))"
    clip = "greatest(-1.0, least(1.0, {}))".format
    top = f"(case when {half} >= pi() * 6371e3 then -1.0 else cos({half} / 6371e3) end)"
    return (
        f"rows_ as (select cast(range as int) as i, {LAT.format(a='').replace('ilat', 'range')} as lat from range(18)), "
        f"win as (select ell, a.i, b.i as j, case when 6371e3 * acos({clip(back)}) <= {half} then 36 when a.i <> b.i and 6371e3 * acos({clip(there)}) >= {half} then 1 "
        f"else cast(ceil(acos({clip(f'({top} - sin(a.lat) * sin(b.lat)) / (cos(a.lat) * cos(b.lat))')}) / {DANG}) as int) end as m "
        f"from scales, rows_ a, rows_ b where b.i - a.i between -least(18, cast(ceil({half} / (6371e3 * {DANG})) as int)) and least(18, cast(ceil({half} / (6371e3 * {DANG})) as int)) - 1)"
    )


def _kernel_query(kernel: str) -> None:
    cfg = FilterConfig(kernel=kernel)
    sql = f"with {FLAT}, {_brute(_BRUTE_SHAPES[kernel])} select ell, ilat, ilon, {rounded(u='u', v='v')} from coarse"
    if kernel == "highorder":  # its weight at the edge of the window is not negligible
        inside = "inside as (select pairs.* from pairs join win on pairs.ell = win.ell and ilat = i and jlat = j and (2 * m >= 36 or (jlon - ilon + 54) % 36 - 18 between -m and m - 1))"
        sql = sql.replace("coarse as (select", f"{_window(2.5)}, {inside}, coarse as (select").replace("from pairs group by all", "from inside group by all")

    @query(f"j4_coarse_{kernel}", sql)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return out(coarse_ops.coarse_grain(flat(spark, sf_dir), GRID, SCALES, ["u", "v"], cfg), ["ell", *PLACE], u="u", v="v")


for _k in KERNEL_PAD:
    _kernel_query(_k)


@query("j4_coarse_cube", f"with {CUBE}, {_brute(source='cube', keys='itime idepth')} select ell, itime, idepth, ilat, ilon, {rounded(u='u', v='v')} from coarse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(coarse_ops.coarse_grain(cube(spark, sf_dir), GRID, SCALES, ["u", "v"]), ["ell", "itime", "idepth", *PLACE], u="u", v="v")


@query("j4_coarse_pairs", f"with {FLAT}, {_brute()} select ell, ilat, ilon, {rounded(u='u', v='v')} from coarse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(coarse_ops.coarse_grain_pairs(flat(spark, sf_dir), GRID, SCALES, ["u", "v"]), ["ell", *PLACE], u="u", v="v")


@query("j4_deform_land", f"with {CUBE}, {_brute(source='cube', keys='itime idepth', below='(case when u_ is null then 0 else 1 end)')} select ell, "
    f"itime, idepth, ilat, ilon, {rounded(u='u')} from coarse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube(spark, sf_dir).withColumn("water", F.col("u").isNotNull())
    return out(coarse_ops.coarse_grain(df, GRID, SCALES, ["u"], FilterConfig(deform_around_land=True), water="water"), ["ell", "itime", "idepth", *PLACE], u="u")


@query("j4_zonal_kernel", f"with {FLAT}, {_brute(fields='u')}, zonal as (select ell, ilat, ilon, sum(w * u_) / sum(w) as u from pairs where ilat = "
    f"jlat group by all) select ell, ilat, ilon, {rounded(u='u')} from zonal")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(coarse_ops.coarse_grain(flat(spark, sf_dir), GRID, SCALES, ["u"], FilterConfig(zonal_kernel_only=True)), ["ell", *PLACE], u="u")


@query("d12_favre", f"with {FLAT}, {_brute(weight='b.rho')} select ell, ilat, ilon, {rounded(u='u', v='v')} from coarse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(coarse_ops.coarse_grain(flat(spark, sf_dir), GRID, SCALES, ["u", "v"], weight="rho"), ["ell", *PLACE], u="u", v="v")


_PLANE = Grid.plane(18, 36, 10e3, 10e3)


@query("j4_coarse_plane", f"with {FLAT}, pairs as (select a.ilat, a.ilon, b.u as u_, exp(-4 * (power(least(abs(a.ilon - b.ilon), 36 - abs(a.ilon - "
    f"b.ilon)) * 10e3, 2) + power((a.ilat - b.ilat) * 10e3, 2)) / (50e3 * 50e3)) as w from flat a, flat b) select 50e3::double "
    f"as ell, ilat, ilon, round(sum(w * u_) / sum(w), 4) + 0.0 as u from pairs group by ilat, ilon")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(coarse_ops.coarse_grain(flat(spark, sf_dir), _PLANE, [50e3], ["u"], FilterConfig(cartesian=True)), ["ell", *PLACE], u="u")


_K1, _K2 = "(-2 * dd * exp(-dd * dd))", "((4 * dd * dd - 2) * exp(-dd * dd))"
_DL = ( f"sums as (select ell, ilat, ilon, sum(w) as s0, sum(w * u_) as su, sum(area * {_K1} * -dd / ell) as s1, sum(area * {_K1} * "
    f"-dd / ell * u_) as s1u, sum(area * ({_K2} * dd * dd + {_K1} * 2 * dd) / (ell * ell)) as s2, sum(area * ({_K2} * dd * dd + {_K1} * "
    f"2 * dd) / (ell * ell) * u_) as s2u from pairs group by all), grow as (select ell, ilat, ilon, su / s0 as u, (s1u / s1 - su "
    f"/ s0) * s1 / s0 as dl, (s2u / s2 - su / s0) * s2 / s0 - 2 * (s1u / s1 - su / s0) * s1 / s0 * s1 / s0 as dll from sums)")


@query("d9_scale_derivatives", f"with {FLAT}, {_brute(fields='u')}, {_DL} select ell, ilat, ilon, {rounded(u='u', dl='1e6 * dl', dll='1e12 * dll')} from grow")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coarse_ops.coarse_grain(flat(spark, sf_dir), GRID, SCALES, ["u"], derivatives=True)
    return out(df, ["ell", *PLACE], u="u", dl="1e6 * dl_u", dll="1e12 * dll_u")


@query("d8_spectra", f"with {FLAT}, {_brute(fields='u')}, {_DL} select ell, ilat, ilon, {rounded(2, spectrum='-1e-6 * 0.5 * 1025 * ell * ell * 2 * u * dl', slope='case when abs(2 * u * dl) < 1e-20 then 0 else -2 - ell * (dl * dl + u * dll) / (2 * u * dl) end')} from grow where abs(u * dl) > 1e-9")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coarse_ops.coarse_grain(flat(spark, sf_dir), GRID, SCALES, ["u"], derivatives=True).where("abs(u * dl_u) > 1e-9")
    e = diagnostics.spectrum_sql(CFG, "u")
    return out(df, ["ell", *PLACE], 2, spectrum=f"1e-6 * {e['spectrum']}", slope=e["slope"])


@query("a10_spectral_slope", f"with {FLAT}, {_brute(fields='u')}, {_DL}, e as (select ell, ilat, -0.5 * 1025 * ell * ell * 2 * u * dl as s, -2 * (-0.5 "
    f"* 1025 * ell * ell * 2 * u * dl) - ell * (dl * dl + u * dll) * (-0.5 * 1025 * ell * ell) as p from grow where abs(u * dl) "
    f"> 1e-9) select ell, ilat, round(sum(p) / sum(s), 2) + 0.0 as ratio from e group by ell, ilat")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coarse_ops.coarse_grain(flat(spark, sf_dir), GRID, SCALES, ["u"], derivatives=True).where("abs(u * dl_u) > 1e-9")
    e = diagnostics.spectrum_sql(CFG, "u")
    df = df.select("ell", *PLACE, F.expr(e["spectrum"]).alias("s"), F.expr(e["slope"]).alias("k"))
    return out(aggregate.weighted_ratio(df, "k", "s", ["ell", "ilat"]), ["ell", "ilat"], 2, ratio="ratio")


_PROD = "prod as (select *, u * u as uu, u * v as uv, v * v as vv, rho * v as rv from flat)"
_COARSE_Q = f"with {FLAT}, {_PROD}, {_brute(fields='u v uu uv vv rho', source='prod')}"


def _coarse_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir).select("*", *[F.expr(e).alias(n) for n, e in (("uu", "u * u"), ("uv", "u * v"), ("vv", "v * v"))])
    return coarse_ops.coarse_grain(df, GRID, SCALES, ["u", "v", "uu", "uv", "vv", "rho"])


@query("j5_quadratics", f"{_COARSE_Q} select ell, ilat, ilon, {rounded(uu='uu', uv='uv', vv='vv')} from coarse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_coarse_products(spark, sf_dir), ["ell", *PLACE], uu="uu", uv="uv", vv="vv")


@query("d11_potential_conversion", f"{_COARSE_Q} select ell, ilat, ilon, {rounded(PEtoKE='(rho - 1025) * -9.81 * v')} from coarse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_coarse_products(spark, sf_dir), ["ell", *PLACE], PEtoKE=diagnostics.potential_conversion_sql(CFG, "rho", "v"))


@query("j3_stencil", f"with {_ELLS.replace('scales(ell) as', 'scales(ell) as')}, t as (select cast(range as int) as ilat, {LAT.format(a='').replace('ilat', 'range')} as "
    f"lat from range(18)), p as (select s.ell, a.ilat, b.ilat as jlat, a.lat as a, b.lat as b, o.range - 18 as doff from scales "
    f"s, t a, t b, range(36) o), d as (select *, 2 * 6371e3 * asin(least(1.0, sqrt(power(sin((b - a) / 2), 2) + cos(a) * cos(b) "
    f"* power(sin(doff * {DANG} / 2), 2)))) / (ell / 2) as dd from p) select ell, ilat, round(sum(exp(-dd * dd) * cos(b) * {DANG} * {DANG}) "
    f", 8) + 0.0 as w from d group by ell, ilat")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = coarse_ops.stencil(spark, GRID, SCALES, CFG)
    return out(table.groupBy("ell", "ilat").agg(F.sum("w").alias("w")), ["ell", "ilat"], 8, w=f"w / {CFG.earth_radius**2!r}")


_WINDOW_SQL = ( "with t as (select cast(range as int) as ilat from range(18)), e(ell) as (values (2e6::double), (5e6::double)) select ell, "
    "ilat, greatest(0, ilat - least(18, cast(ceil(5 * ell / (6371e3 * radians(10.0)) / 2) as int))) as lo, least(18, ilat + least(18, "
    "cast(ceil(5 * ell / (6371e3 * radians(10.0)) / 2) as int))) as hi from t, e")


@query("j2_lon_bounds", f"with {_ELLS}, {_window(5.0)} select ell, i as ilat, j as jlat, cast(case when 2 * m >= 36 then -18 else -m end as int) "
    f"as lo, cast(case when 2 * m >= 36 then 17 else m - 1 end as int) as hi from win")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(coarse_ops.windows(GRID, SCALES, CFG), "ell double, ilat int, jlat int, lo int, hi int")


@query("j1_lat_bounds", _WINDOW_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coarse_ops.windows(GRID, SCALES, CFG)
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "ell double, ilat int, jlat int")
    return df.groupBy("ell", "ilat").agg(F.min("jlat").alias("lo"), (F.max("jlat") + 1).alias("hi"))


# ------------------------------------------------------------------ calculus

_KEYS = ["itime", "idepth"]


def _derivative_query(name: str, axis: str, order: int, derivative: int, water: str | None = None) -> None:
    other = "ilat" if axis == "ilon" else "ilon"
    sql = ( f"with {FLAT}, {derived('d', 'flat', [other], axis, {'du': 'u', 'dv': 'v'}, order, derivative, water=water or 'true')} select "
        f"ilat, ilon, {rounded(4, du='du', dv='dv')} from d where {water or 'true'}")

    @query(name, sql)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = flat(spark, sf_dir).withColumn("water", F.expr(water or "true"))
        n, delta = (GRID.nlon, GRID.dlon) if axis == "ilon" else (GRID.nlat, GRID.dlat)
        return out(calculus.differentiate(df, axis, n, delta, {"du": "u", "dv": "v"}, [*_KEYS, other], order, derivative, axis == "ilon", "water").where("water"), PLACE, 4, du="du", dv="dv")


for _o in (2, 3, 4, 6):
    _derivative_query(f"j7_d_lon_order{_o}", "ilon", _o, 1)
    _derivative_query(f"j7_d_lat_order{_o}", "ilat", _o, 1)
_derivative_query("j7_d2_lon", "ilon", 4, 2)
_derivative_query("j7_d2_lat", "ilat", 4, 2)
_derivative_query("j7_d_lon_land", "ilon", 4, 1, WATER)
_derivative_query("j7_d_lat_land", "ilat", 4, 1, WATER)


_J9 = ", ".join(f"({p - d}, {d}, {left}, {k}, {w!r}::double)" for p, d in COEFFICIENTS if p - d > 1 for left, k, w in coefficient_rows(p, d))


@query("j9_coefficients", f'with c("order", derivative, "left", k, w) as (values {_J9}) select "order", derivative, "left", k, round(w, 9) + 0.0 as w from c')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [(p - d, d) for p, d in COEFFICIENTS if p - d > 1]
    rows = [(o, d, left, k, w) for o, d in asked for left, weights in calculus.stencil_cases(o, d)[0][1] for k, w in enumerate(weights)]
    return out(spark.createDataFrame(rows, "order int, derivative int, left int, k int, w double"), ["order", "derivative", "left", "k"], 9, w="w")


_UNEVEN = Grid(tuple(math.radians(-80 + 8.0 * k + 0.08 * k * k) for k in range(18)), GRID.lons)
_UNEVEN_SQL = ( "y as (select *, radians(-80 + 8.0 * ilat + 0.08 * ilat * ilat) as y from flat), n as (select *, lag(y) over w as ya, lead(y) "
    "over w as yb, lag(u) over w as ua, lead(u) over w as ub, lead(y, 2) over w as yc, lead(u, 2) over w as uc, lag(y, 2) over "
    "w as yz, lag(u, 2) over w as uz from y window w as (partition by ilon order by ilat))")
_THREE = ( "({f0} * ((y - {x1}) + (y - {x2})) / (({x0} - {x1}) * ({x0} - {x2})) + {f1} * ((y - {x0}) + (y - {x2})) / (({x1} - {x0}) "
    "* ({x1} - {x2})) + {f2} * ((y - {x0}) + (y - {x1})) / (({x2} - {x0}) * ({x2} - {x1})))")


@query("j10_uneven_derivative", f"with {FLAT}, {_UNEVEN_SQL} select ilat, ilon, round(case when ya is not null and yb is not null then {_THREE.format(x0='ya', f0='ua', x1='y', f1='u', x2='yb', f2='ub')} when "
    f"ya is null then {_THREE.format(x0='y', f0='u', x1='yb', f1='ub', x2='yc', f2='uc')} else {_THREE.format(x0='yz', f0='uz', x1='ya', f1='ua', x2='y', f2='u')} end, 4) + 0.0 as du from n")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir).join(F.broadcast(_UNEVEN.lat_dim(spark, FilterConfig(order=2, uniform_lat=False))), "ilat")
    return out(calculus.differentiate_uneven(df, "ilat", "lat", {"du": "u"}, [*_KEYS, "ilon"]), PLACE, 4, du="du")


@query("j7_slices_land", f"with {CUBE}, {both('g', 'cube', ['u'], ['itime', 'idepth'], water=WATER)} select itime, idepth, ilat, ilon, {rounded(4, dx='dlon_u', dy='dlat_u')} from g where {WATER}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube(spark, sf_dir).withColumn("water", F.expr(WATER))
    return out(calculus.spherical_gradients(df, GRID, ["u"], _KEYS, water="water").where("water"), [*_KEYS, *PLACE], 4, dx="dlon_u", dy="dlat_u")


_J8R = "6371e3"
_J8 = {"dx": f"-sin(lon) / ({_J8R} * cos(lat)) * dlon_u - cos(lon) * sin(lat) / {_J8R} * dlat_u + cos(lon) * cos(lat) * dr", "dy": f"cos(lon) "
    f"/ ({_J8R} * cos(lat)) * dlon_u - sin(lon) * sin(lat) / {_J8R} * dlat_u + sin(lon) * cos(lat) * dr", "dz": f"cos(lat) / {_J8R} * dlat_u + sin(lat) * dr"}
_LEVELS = ( "lev as (select *, 10.0 * idepth + 5.0 * idepth * idepth as z from cube), around as (select *, lag(z) over w as za, lead(z) "
    "over w as zb, lag(z, 2) over w as zz, lead(z, 2) over w as zc, lag(f) over w as fa, lead(f) over w as fb, lag(f, 2) over "
    "w as fz, lead(f, 2) over w as fc from (select *, coalesce(u, 0) as f from lev) window w as (partition by itime, ilat, ilon order by idepth))")
_QUAD = ( "({f0} * ((z - {x1}) + (z - {x2})) / (({x0} - {x1}) * ({x0} - {x2})) + {f1} * ((z - {x0}) + (z - {x2})) / (({x1} - {x0}) "
    "* ({x1} - {x2})) + {f2} * ((z - {x0}) + (z - {x1})) / (({x2} - {x0}) * ({x2} - {x1})))")
_DR = ( f"radial as (select *, -(case when za is not null and zb is not null then {_QUAD.format(x0='za', f0='fa', x1='z', f1='f', x2='zb', f2='fb')} when "
    f"za is null then {_QUAD.format(x0='z', f0='f', x1='zb', f1='fb', x2='zc', f2='fc')} else {_QUAD.format(x0='zz', f0='fz', x1='za', f1='fa', x2='z', f2='f')} end) as dr from around)")


@query("j8_cartesian_derivatives", f"with {CUBE}, {_LEVELS}, {_DR}, {both('g', 'radial', ['u'], ['itime', 'idepth'])} select itime, idepth, ilat, ilon, {rounded(4, **_J8)} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cube(spark, sf_dir).select(*_KEYS, *PLACE, F.coalesce("u", F.lit(0.0)).alias("u"), F.expr("10.0D * idepth + 5.0D * idepth * idepth").alias("z"))
    df = calculus.depth_derivatives(df, "z", ["u"], ["itime", "ilat", "ilon"])
    df = GRID.located(calculus.spherical_gradients(df, GRID, ["u"], _KEYS), CFG)
    return out(df, [*_KEYS, *PLACE], 4, **dict(zip(("dx", "dy", "dz"), calculus.cartesian_derivatives("u", radial="dr_u"), strict=True)))
