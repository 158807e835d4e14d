"""The catalogue's third part: potentials, projections, spectral filters, particles, two-layer budgets, coarse-graining of a fine mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.grid import Grid, densify
from tesseral.operators import aggregate, calculus, diagnostics, particles, potentials, shallow_water, solve
from tesseral.operators import coarse as coarse_ops
from tesseral.plans import pipelines
from tesseral.plans.catalog import CFG, PLACE, SCALES, _brute, out, query, rounded
from tesseral.plans.fields import CUBE, DANG, FLAT, GRID, MESH, VALUES, WATER, cube, flat, lineitem
from tesseral.plans.oracle import both, derived
from tesseral.sources.tables import rasterize

KEYS = ["itime", "idepth"]
R = "6371e3"

# ------------------------------------------------------------------ potentials


@query("h1_toroidal_velocity", f"with {FLAT}, {both('g', 'flat', ['u'])} select ilat, ilon, {rounded(u_lon=f'1e6 * -dlat_u / {R}', u_lat=f'1e6 * dlon_u / ({R} * cos(lat))')} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(potentials.toroidal_velocity(flat(spark, sf_dir), GRID, "u"), PLACE, u_lon="1e6 * u_lon_tor", u_lat="1e6 * u_lat_tor")


@query("h2_potential_velocity", f"with {FLAT}, {both('g', 'flat', ['u'])} select ilat, ilon, {rounded(u_lon=f'1e6 * dlon_u / ({R} * cos(lat))', u_lat=f'1e6 * dlat_u / {R}')} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(potentials.potential_velocity(flat(spark, sf_dir), GRID, "u"), PLACE, u_lon="1e6 * u_lon_pot", u_lat="1e6 * u_lat_pot")


@query("h3_curl", f"with {FLAT}, {both('g', 'flat', ['u', 'v'])} select ilat, ilon, round(1e6 * (dlon_v / cos(lat) - dlat_u + tan(lat) * u) / {R} - ssh, 4) + 0.0 as curl from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(potentials.curl(flat(spark, sf_dir), GRID, "u", "v", seed="1e-6 * ssh"), PLACE, curl="1e6 * curl")


@query("h4_divergence", f"with {FLAT}, {both('g', 'flat', ['u', 'v'])} select ilat, ilon, round(1e6 * (dlon_u / cos(lat) + dlat_v - v * tan(lat)) / {R}, 4) + 0.0 as div from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(potentials.divergence(flat(spark, sf_dir), GRID, "u", "v"), PLACE, div="1e6 * div")


_LAP = f"(d2lon_u / power(cos(lat), 2) - dlat_u * tan(lat) + d2lat_u) / ({R} * {R})"


@query("h5_laplacian", f"with {FLAT}, {both('g1', 'flat', ['u'])}, {both('g', 'g1', ['u'], derivative=2)} select ilat, ilon, round(1e12 * {_LAP}, 4) + 0.0 as lap from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(potentials.laplacian(flat(spark, sf_dir), GRID, "u"), PLACE, lap="1e12 * laplacian")


def _numbered(spark: SparkSession, sf_dir: str, **fields: str) -> DataFrame:
    """(column, f): cells numbered row by row, one field after the other."""
    cells = flat(spark, sf_dir)
    parts = [cells.select(F.expr(f"ilat * 36 + ilon + {k * 648}").alias("column"), F.expr(e).alias("f")) for k, e in enumerate(fields.values())]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query("h6_sparse_laplacian", f"with {FLAT}, {both('g1', 'flat', ['u'], water=WATER)}, {both('g', 'g1', ['u'], derivative=2, water=WATER)} select cast(ilat "
    f"* 36 + ilon as int) as cell, round(case when {WATER} then 1e12 * {_LAP} else u end, 4) + 0.0 as lap from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = solve.sparse_laplacian(spark, GRID, wet=_island())
    land = F.expr(f"not ({WATER.replace('ilat', '(cell div 36)').replace('ilon', '(cell % 36)')})")
    df = matrix.join(_numbered(spark, sf_dir, u="u"), "column").groupBy(F.col("row").alias("cell")).agg(F.sum(F.col("value") * F.col("f")).alias("lap"))
    return df.select("cell", (F.round(F.when(land, F.col("lap")).otherwise(F.expr("1e12 * lap")), 4) + 0.0).alias("lap"))


def _island():  # noqa: ANN202
    import numpy as np

    wet = np.ones((GRID.nlat, GRID.nlon), bool)
    wet[7:11, 14:21] = False
    return wet


_TORPOT = f"(-dlat_u + dlon_v / cos(lat)) / {R}", f"(dlon_u / cos(lat) + dlat_v) / {R}"


@query("h7_sparse_velocity", f"with {FLAT}, {both('g', 'flat', ['u', 'v'])} select cast(ilat * 36 + ilon as int) as cell, {rounded(u=f'1e6 * {_TORPOT[0]}', v=f'1e6 * {_TORPOT[1]}')} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = solve.sparse_velocity(spark, GRID).join(_numbered(spark, sf_dir, psi="u", phi="v"), "column")
    sums = met.groupBy(F.expr("row % 648").alias("cell")).agg(*[F.sum(F.when(F.col("row") < 648 if c == "u" else F.col("row") >= 648, F.col("value") * F.col("f"))).alias(c) for c in "uv"])
    return out(sums, ["cell"], u="1e6 * u", v="1e6 * v")


#: Potentials of known velocities, which a projection has to give back.
_PSI, _PHI = "2e6 * (ssh - 0.4)", "1e6 * (rho - 1025.5)"


def _known_flow(cells: DataFrame, water: str | None = None) -> DataFrame:
    df = cells.withColumns({"psi": F.coalesce(F.expr(_PSI), F.lit(0.0)), "phi": F.coalesce(F.expr(_PHI), F.lit(0.0))})
    if water:
        df = df.withColumn("water", F.expr(water)).withColumns({c: F.when(F.col("water"), F.col(c)).otherwise(0.0) for c in ("psi", "phi")})
    df = potentials.toroidal_velocity(df, GRID, "psi", water="water" if water else None, names=("ut", "vt"))
    df = potentials.potential_velocity(df, GRID, "phi", water="water" if water else None, names=("up", "vp"))
    return df.withColumns({"u_lon": F.expr("ut + up"), "u_lat": F.expr("vt + vp")})


_SPLIT = {
    "u_lon_tor": f"-dlat_psi / {R}", "u_lat_tor": f"dlon_psi / ({R} * cos(lat))",
    "u_lon_pot": f"dlon_phi / ({R} * cos(lat))", "u_lat_pot": f"dlat_phi / {R}",
}


def _split_sql(source: str, text: str, keys: list[str], water: str | None = None) -> str:
    psi, phi = (f"coalesce({e}, 0)" if not water else f"case when {water} then coalesce({e}, 0) else 0 end" for e in (_PSI, _PHI))
    return f"with {text}, pot as (select *, {psi} as psi, {phi} as phi from {source}), {both('g', 'pot', ['psi', 'phi'], keys, water=water or 'true')}"


@query("h8_helmholtz_projection", f"{_split_sql('cube', CUBE, KEYS)} select itime, idepth, ilat, ilon, {rounded(**_SPLIT)}, true as solved from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = solve.helmholtz(_known_flow(cube(spark, sf_dir)), GRID)
    return out(got, [*KEYS, *PLACE], **{c: c for c in _SPLIT}).join(got.select(*KEYS, *PLACE, (F.col("steps") < 1500).alias("solved")), [*KEYS, *PLACE])


@query("h8_projection_with_land", f"{_split_sql('flat', FLAT, [], WATER)} select ilat, ilon, {rounded(**_SPLIT)} from g where {WATER}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _known_flow(flat(spark, sf_dir), WATER)
    got = solve.helmholtz(df, GRID, how=solve.Projection(steps=6000, tolerance=1e-13), water="water").where(WATER)
    return out(got, PLACE, **{c: c for c in _SPLIT})


@query("h8_seeded_projection", f"{_split_sql('flat', FLAT, [])} select ilat, ilon, {rounded(**_SPLIT)} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = Grid.degrees(9, 18, -80.0, 20.0, -170.0, 20.0)
    return out(pipelines.multigrid_projection(_known_flow(flat(spark, sf_dir)), GRID, half), PLACE, **{c: c for c in _SPLIT})


@query("h9_toroidal_projection", f"{_split_sql('flat', FLAT, [])} select ilat, ilon, {rounded(**{k: _SPLIT[k] for k in ('u_lon_tor', 'u_lat_tor')})} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = potentials.toroidal_velocity(flat(spark, sf_dir).withColumn("psi", F.expr(_PSI)), GRID, "psi", names=("u_lon", "u_lat"))
    got = solve.helmholtz(df, GRID, how=solve.Projection(potential=False))
    return out(got, PLACE, u_lon_tor="u_lon_tor", u_lat_tor="u_lat_tor")


@query("h9_potential_projection", f"{_split_sql('flat', FLAT, [])} select ilat, ilon, {rounded(**{k: _SPLIT[k] for k in ('u_lon_pot', 'u_lat_pot')})} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = potentials.potential_velocity(flat(spark, sf_dir).withColumn("phi", F.expr(_PHI)), GRID, "phi", names=("u_lon", "u_lat"))
    got = solve.helmholtz(df, GRID, how=solve.Projection(toroidal=False))
    return out(got, PLACE, u_lon_pot="u_lon_pot", u_lat_pot="u_lat_pot")


_TENSOR = {"uu": "ssh + dlon_u / cos(lat) - tan(lat) * v", "uv": "0.5 * (tan(lat) * u + dlat_u + dlon_v / cos(lat))", "vv": "ssh + dlat_v"}


@query("h11_tensor_of_vector", f"with {FLAT}, {both('g', 'flat', ['u', 'v'])} select ilat, ilon, {rounded(**_TENSOR)} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(potentials.tensor_of_vector(flat(spark, sf_dir), GRID, "ssh", "u", "v"), PLACE, uu="uu", uv="uv", vv="vv")


@query("h10_tensor_decomposition", f"with {FLAT}, {both('g', 'flat', ['u', 'v'])} select ilat, ilon, {rounded(**{f'{k}_fit': e for k, e in _TENSOR.items()})} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensor of a known vector lies in the range of the decomposition, which has to fit it."""
    df = potentials.tensor_of_vector(flat(spark, sf_dir), GRID, "ssh", "u", "v")
    return out(solve.decompose_tensor(df, GRID, vector=True), PLACE, uu_fit="uu_fit", uv_fit="uv_fit", vv_fit="vv_fit")


_S = {"d2x": f"(d2lon_u / power(cos(lat), 2) - tan(lat) * dlat_u)", "mix_v": "((tan(lat) * dlon_v + dlonlat_v) / cos(lat))", "mix_u": "((tan(lat) * dlon_u + dlonlat_u) / cos(lat))"}
_SYM = {
    "uu_fit": f"ssh + {_S['d2x']} - {_S['mix_v']}",
    "uv_fit": f"{_S['mix_u']} + 0.5 * (-tan(lat) * dlat_v - d2lat_v + d2lon_v / power(cos(lat), 2))",
    "vv_fit": f"ssh + d2lat_u + {_S['mix_v']}",
}
_SYMQ = f"with {FLAT}, {both('g1', 'flat', ['u', 'v'])}, {both('g2', 'g1', ['u', 'v'], derivative=2)}, {derived('g', 'g2', ['ilat'], 'ilon', {'dlonlat_u': 'dlat_u', 'dlonlat_v': 'dlat_v'})}"


@query("h10_tensor_of_potentials", f"{_SYMQ} select ilat, ilon, {rounded(3, **_SYM)} from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above with two potentials for the vector, whose tensor has second derivatives."""
    wanted = [(f"{p}{a}_{f}", f, f"i{a}", d) for f in "uv" for a in ("lon", "lat") for p, d in (("d", 1), ("d2", 2))] + [(f"dlonlat_{f}", f"dlat_{f}", "ilon", 1) for f in "uv"]
    df = GRID.located(calculus.derivatives(flat(spark, sf_dir), GRID, wanted, KEYS), CFG)
    df = df.select(*KEYS, *PLACE, *[F.expr(e).alias(n.removesuffix("_fit")) for n, e in _SYM.items()])
    return out(solve.decompose_tensor(df, GRID), PLACE, 3, uu_fit="uu_fit", uv_fit="uv_fit", vv_fit="vv_fit")


# ------------------------------------------------------------------ sharp spectral filter

_PLANE = Grid.plane(18, 36, 10e3, 10e3)
_WAVES = [35e3, 65e3]
_KERN = (
    "e(ell) as (values (35e3::double), (65e3::double)), sy as (select case when range < 9 then range else range - 18 end as n "
    "from range(18)), sx as (select case when range < 18 then range else range - 36 end as n from range(36)), "
    "modes as (select ell, sy.n as ny, sx.n as nx from e, sy, sx where sqrt(power(sy.n / 180e3, 2) + power(sx.n / 360e3, 2)) < 1 / ell), "
    "kern as materialized (select ell, cast(a.range as int) as dy, cast(b.range as int) as dx, sum(cos(2 * pi() * (ny * a.range "
    "/ 18.0 + nx * b.range / 36.0))) / 648 as w from modes, range(18) a, range(36) b group by all)"
)


def _sharp(name: str, source: str, keys: str, fields: str) -> str:
    """CTE name(ell, keys, ilat, ilon, fields): a circular convolution with the sum of the waves that stay."""
    own = "".join(f"a.{k}, " for k in keys.split())
    same = " and ".join(f"a.{k} = b.{k}" for k in keys.split()) or "true"
    sums = ", ".join(f"sum(w * coalesce(b.{f}, 0)) as {f}" for f in fields.split())
    return ( f"{name} as materialized (select ell, {own}a.ilat, a.ilon, {sums} from {source} a join {source} b on {same} join kern on "
        f"dy = (a.ilat - b.ilat + 18) % 18 and dx = (a.ilon - b.ilon + 36) % 36 group by all)")


@query("f1_sharp_filter", f"with {CUBE}, {_KERN}, {_sharp('s', 'cube', 'itime idepth', 'u v')} select ell, itime, idepth, ilat, ilon, {rounded(u='u', v='v')} from s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(solve.sharp_filter(cube(spark, sf_dir), _PLANE, _WAVES, ["u", "v"]), ["ell", *KEYS, *PLACE], u="u", v="v")


@query("f2_sharp_products", f"with {FLAT}, {_KERN}, pr as (select *, u * v as uv, u * rho as ur from flat), {_sharp('s', 'pr', '', 'uv ur')} select ell, "
    f"ilat, ilon, {rounded(u_v='uv', u_rho='ur')} from s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = solve.sharp_filter(flat(spark, sf_dir), _PLANE, _WAVES, ["u", "v", "rho"], products=[("u", "v"), ("u", "rho")])
    return out(df, ["ell", *PLACE], u_v="u_v", u_rho="u_rho")


_PLANE_CFG = FilterConfig(cartesian=True, periodic_y=True)
_F3 = f"pr as (select *, u * u as uu, u * v as uv, v * v as vv from flat), {_sharp('s', 'pr', '', 'u v uu uv vv')}, {both('g', 's', ['u', 'v'], ['ell'], periodic_y=True, step=10e3, names='x y')}"


@query(
    "f3_sharp_energies",
    f"with {FLAT}, {_KERN}, {_F3} select ell, ilat, ilon, {rounded(2, coarse_KE='512.5 * (u * u + v * v)', fine_KE='512.5 * (uu + vv - u * u - v * v)', Pi='-1025e2 * (dx_u * (uu - u * u) + (dy_u + dx_v) * (uv - u * v) + dy_v * (vv - v * v))')} from g",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = solve.sharp_energies(flat(spark, sf_dir), _PLANE, _WAVES, _PLANE_CFG)
    return out(df, ["ell", *PLACE], 2, coarse_KE="coarse_KE", fine_KE="fine_KE", Pi="1e2 * Pi")


# ------------------------------------------------------------------ particles

_N, _CFL, _CLOCK, _STOPS = 40, 0.02, [0.0, 5e5, 1e6], [0.0, 2.5e5, 7.5e5, 1e6]
_SEEDS = (
    f"{MESH}, wet as (select *, {WATER} as water from mesh), "
    "cand as (select range as k, radians(-175.0) + ((range + 7920) * 0.7548776662466927 - floor((range + 7920) * 0.7548776662466927)) * (radians(175.0) - radians(-175.0)) as lon, "
    "(radians(-85.0) + radians(85.0)) / 2 + ((range + 7920) * 0.5698402909980532 - floor((range + 7920) * 0.5698402909980532) "
    "- 0.5) * (0.9 * (radians(85.0) - radians(-85.0))) as lat from range(224)), "
    f"good as (select k, c.lon, c.lat from cand c join wet on wet.ilat - floor((c.lat - radians(-85.0)) / {DANG}) in (0, 1) and "
    f"(wet.ilon - cast(floor((c.lon - radians(-175.0)) / {DANG}) as int) + 36) % 36 in (0, 1) where water group by all having count(*) = 4), "
    f"seeds as (select cast(row_number() over (order by k) - 1 as int) as traj, lon, lat from good order by k limit {_N})"
)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.seed_positions(spark, _N, GRID, flat(spark, sf_dir).select(*PLACE, F.expr(WATER).alias("water")), seed=1)


@query("p1_seed_positions", f"with {_SEEDS} select traj, round(lon, 9) + 0.0 as lon, round(lat, 9) + 0.0 as lat from seeds")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_seeds(spark, sf_dir), ["traj"], 9, lon="lon", lat="lat")


def _bilinear(field: str) -> str:
    """A field of the one-row table of lists at (slice, x, y), where x and y count cells."""
    at = lambda k, di, dj: f"{field}[cast(1 + ((({k}) * 18 + floor(y) + {di}) * 36 + (floor(x) + {dj} + 36) % 36) as int)]"
    one = ( lambda k: f"((1 - (y - floor(y))) * ((1 - (x - floor(x))) * {at(k, 0, 0)} + (x - floor(x)) * {at(k, 0, 1)}) + (y - floor(y)) * ((1 "
        f"- (x - floor(x))) * {at(k, 1, 0)} + (x - floor(x)) * {at(k, 1, 1)}))")  # noqa: E731
    return f"((1 - w) * {one('k')} + w * {one('k + 1')})"


def _path(name: str, start: str, sign: int) -> str:
    """Recursive CTE name(traj, lon, lat, t, vu, vv, n, hit): a particle's steps, and the number of the output that a step reaches."""
    stops = _STOPS if sign > 0 else _STOPS[::-1]
    target = f"[{', '.join(repr(x) for x in stops)}][n + 1]"
    k = "least(cast(floor((t + 1e-6) / 5e5) as int), 1)" if sign > 0 else "greatest(cast(ceil((t - 1e-6) / 5e5) as int) - 1, 0)"
    x, y = f"(({{}} - radians(-175.0)) / {DANG})", f"((lat - radians(-85.0)) / {DANG})"
    return (
        f"{name}(traj, lon, lat, t, vu, vv, n, hit) as (select traj, lon, lat, {stops[0]!r}::double, 2.0::double, 2.0::double, 1, 0 from {start} union all "
        f"select traj, lon2, lat + {sign} * dt * vv2 / 6371e3, t + {sign} * dt, vu2, vv2, case when {sign} * (t + {sign} * dt - {target}) "
        f">= -1e-6 then n + 1 else n end, case when {sign} * (t + {sign} * dt - {target}) >= -1e-6 then n end "
        f"from (select *, {x.format('lon2')} as x, {_bilinear('fv')} as vv2 from (select * exclude (x), radians(-175.0) + ((lon + {sign} * "
        f"dt * vu2 / (6371e3 * cos(lat)) - radians(-175.0)) - 36 * {DANG} * floor((lon + {sign} * dt * vu2 / (6371e3 * cos(lat)) - "
        f"radians(-175.0)) / (36 * {DANG}))) as lon2 "
        f"from (select *, {_bilinear('fu')} as vu2 from (select {name}.*, fu, fv, {x.format('lon')} as x, {y} as y, {k} as k, "
        f"least(greatest((t - 5e5 * {k}) / 5e5, 0), 1) as w, least({_CFL} * least(6371e3 * {DANG} * cos(lat) / greatest(abs(vu), "
        f"1e-3), 6371e3 * {DANG} / greatest(abs(vv), 1e-3)), abs({target} - t)) as dt "
        f"from {name}, lists where n < 4 and {y} >= 0 and {y} < 17))))) "
    )


_LISTS = ( f"{CUBE.replace(MESH + ', ', '')}, lists as materialized (select list(coalesce(u, 0) / 10 order by itime, ilat, ilon) as "
    f"fu, list(coalesce(v, 0) / 10 order by itime, ilat, ilon) as fv from cube where idepth = 0 and itime < 3)")
_FORWARD = f"with recursive {_SEEDS}, {_LISTS}, {_path('fwd', 'seeds', 1)}"
_ASKED = "asked as (select traj, o.n, o.t from seeds, (values (0, 0.0::double), (1, 2.5e5::double), (2, 7.5e5::double), (3, 1e6::double)) o(n, t))"


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).where("idepth = 0 and itime < 3").select("itime", *PLACE, F.expr("u / 10").alias("u"), F.expr("v / 10").alias("v"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.advect(_seeds(spark, sf_dir), _flow(spark, sf_dir), _CLOCK, _STOPS, GRID, how=particles.Advection(cfl=_CFL))


@query("p2_advect", f"{_FORWARD}, {_ASKED} select a.traj, cast(a.n as int) as iout, a.t as time, round(f.lon, 6) + 0.0 as lon, round(f.lat, 6) "
    f"+ 0.0 as lat from asked a left join fwd f on f.traj = a.traj and f.hit = a.n")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_tracks(spark, sf_dir).withColumnRenamed("time", "t"), ["traj", "iout", "t"], 6, lon="lon", lat="lat").withColumnRenamed("t", "time")


_ARC = "2 * 6371e3 * asin(least(1.0, sqrt(power(sin((b.lat - f.lat) / 2), 2) + cos(f.lat) * cos(b.lat) * power(sin((b.lon - f.lon) / 2), 2))))"


@query(
    "p3_fore_back",
    f"{_FORWARD}, ends as (select traj, lon, lat from fwd where hit = 3), {_path('bwd', 'ends', -1)}, {_ASKED} "
    f"select a.traj, cast(a.n as int) as iout, round(case when a.n < 3 then {_ARC} else 0.0 end, 0) + 0.0 as dist from asked "
    f"a join ends using (traj) left join fwd f on f.traj = a.traj and f.hit = a.n left join bwd b on b.traj = a.traj and b.hit = 3 - a.n",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    forward = _tracks(spark, sf_dir)
    last = forward.where("iout = 3 and lon is not null").select("traj", "lon", "lat")
    back = particles.advect(last, _flow(spark, sf_dir), _CLOCK, _STOPS, GRID, how=particles.Advection(cfl=_CFL), backwards=True)
    return out(particles.fore_back_distance(forward, back, FilterConfig(high_precision_distance=True)), ["traj", "iout"], 0, dist="dist")


@query("w4_trajectory_derivatives", f"with {CUBE}, tr as (select cast(ilat * 36 + ilon as int) as traj, itime, u, v from cube where idepth = 0), {derived('d', 'tr', ['traj'], 'itime', {'ddt_u': 'u', 'ddt_v': 'v'}, water='u is not null', n=7, delta=100.0, periodic=False)} select "
    f"traj, itime as iout, {rounded(6, ddt_u='ddt_u / pi()', ddt_v='ddt_v / pi()')} from d where u is not null")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cube(spark, sf_dir).where("idepth = 0").select(F.expr("cast(ilat * 36 + ilon as int)").alias("traj"), F.col("itime").alias("iout"), "u", "v")
    df = aggregate.trajectory_derivatives(points, ["u", "v"], 100.0)
    return out(df.where("u is not null"), ["traj", "iout"], 6, ddt_u="ddt_u / pi()", ddt_v="ddt_v / pi()")


# ------------------------------------------------------------------ diagnostics that filter


@query("d10_energies", f"with {FLAT}, prod as (select *, u * u as uu, v * v as vv from flat), {_brute(fields='u v uu vv', source='prod')}, {both('g', 'coarse', ['u', 'v'], ['ell'])} select "
    f"g.ell, g.ilat, g.ilon, {rounded(2, coarse_KE='512.5 * (g.u * g.u + g.v * g.v)', fine_KE='512.5 * (uu + vv) - 512.5 * (g.u * g.u + g.v * g.v)', fine_KE_mod='512.5 * (f.u * f.u + f.v * f.v) - 512.5 * (g.u * g.u + g.v * g.v)', enstrophy=f'512.5e12 * power((dlon_v / cos(g.lat) - dlat_u + tan(g.lat) * g.u) / {R}, 2)')} from "
    f"g join flat f on f.ilat = g.ilat and f.ilon = g.ilon")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = flat(spark, sf_dir)
    bar = coarse_ops.coarse_grain(cells.withColumns({"uu": F.expr("u * u"), "vv": F.expr("v * v")}), GRID, SCALES, ["u", "v", "uu", "vv"])
    bar = diagnostics.vorticity(bar, GRID, CFG, ["ell", *KEYS], "u", "v").join(cells.select(*PLACE, F.col("u").alias("u0"), F.col("v").alias("v0")), PLACE)
    e = diagnostics.energies_sql(CFG, ("u", "v"), "512.5 * (uu + vv)", "512.5 * (u0 * u0 + v0 * v0)", "vort_r")
    return out(bar, ["ell", *PLACE], 2, coarse_KE=e["coarse_KE"], fine_KE=e["fine_KE"], fine_KE_mod=e["fine_KE_mod"], enstrophy=f"1e12 * {e['enstrophy']}")


_K1 = "(-2 * dd * exp(-dd * dd))"
_GROWN = ( f"sums as (select ell, ilat, ilon, sum(w) as s0, sum(area * {_K1} * -dd / ell) as s1, {', '.join(f'sum(w * {f}_) as a_{f}, sum(area * {_K1} * -dd / ell * {f}_) as b_{f}' for f in ('rho', 'v'))} from "
    f"pairs group by all), grow as (select ell, ilat, ilon, a_rho / s0 as rho, a_v / s0 as v, (b_rho - a_rho / s0 * s1) / s0 as "
    f"dl_rho, (b_v - a_v / s0 * s1) / s0 as dl_v from sums)")


@query("d13_barrho_barw", f"with {FLAT}, {_brute(fields='rho v')}, {_GROWN} select ell, ilat, ilon, {rounded(2, barrho_barw='rho * v', dl_barrho_barw='1e6 * (dl_rho * v + rho * dl_v)')} from grow")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pipelines.coarse_grain_scalars(flat(spark, sf_dir), GRID, SCALES, ["rho", "v"], CFG, ("rho", "v"))
    return out(df, ["ell", *PLACE], 2, barrho_barw="barrho_barw", dl_barrho_barw="1e6 * dl_barrho_barw")


@query("d14_wind_forcing", f"with {FLAT}, pr as (select *, rho - 1025 as a, (rho - 1025) * u + ssh * v as work from flat), {_brute(fields='a ssh u v work', source='pr')} select "
    f"ell, ilat, ilon, {rounded(6, wind_forcing='work - a * u - ssh * v')} from coarse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir).withColumn("a", F.expr("rho - 1025"))
    return out(diagnostics.wind_forcing(df, GRID, SCALES, stress=("a", "ssh"), u=("u", "v")), ["ell", *PLACE], 6, wind_forcing="wind_forcing")


_XYZ = {"x": "(-{a} * sin(lon) - {b} * cos(lon) * sin(lat))", "y": "({a} * cos(lon) - {b} * sin(lon) * sin(lat))", "z": "({b} * cos(lat))"}
_KINDS = {"tor": ("u", "v"), "pot": ("ssh", "(rho - 1025)")}
_ONES = {f"{x}_{k}": e.format(a=a, b=b) for k, (a, b) in _KINDS.items() for x, e in _XYZ.items()}
_TWOS = {f"{x}_{p}_{y}_{q}": f"{x}_{p} * {y}_{q}" for x in "xyz" for y in "xyz" if x <= y for p in _KINDS for q in _KINDS}
_ALONG = {
    "x": "(-sin(lon) / (6371e3 * cos(lat)) * dlon_{f} - cos(lon) * sin(lat) / 6371e3 * dlat_{f})",
    "y": "(cos(lon) / (6371e3 * cos(lat)) * dlon_{f} - sin(lon) * sin(lat) / 6371e3 * dlat_{f})",
    "z": "(cos(lat) / 6371e3 * dlat_{f})",
}


def _breakdown() -> str:
    ones, twos = ", ".join(f"{e} as {n}" for n, e in _ONES.items()), ", ".join(f"{e} as {n}" for n, e in _TWOS.items())
    parts = []
    for x in "xyz":
        for y in "xyz":
            if x <= y:
                columns = {f"u{n}_{k}": f"{a}_{k}" for n, a in (("i", x), ("j", y)) for k in _KINDS}
                columns |= {f"ui_j_{k}": "1e6 * " + _ALONG[y].format(f=f"{x}_{k}") for k in _KINDS} | {f"uj_i_{k}": "1e6 * " + _ALONG[x].format(f=f"{y}_{k}") for k in _KINDS}
                columns |= {f"uu_{p}_{q}": f"{x}_{p}_{y}_{q}" for p in _KINDS for q in _KINDS}
                parts.append(f"select ell, ilat, ilon, '{x}{y}' as pair, {rounded(3, **columns)} from g")
    return f"with {FLAT}, c1 as (select *, {ones} from flat), c2 as (select *, {twos} from c1), {_brute(fields=' '.join([*_ONES, *_TWOS]), source='c2')}, {both('g', 'coarse', list(_ONES), ['ell'])} " + " union all ".join(parts)


@query("d18_transfer_breakdown", _breakdown())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flat(spark, sf_dir).select(*KEYS, *PLACE, F.col("u").alias("u_lon_tor"), F.col("v").alias("u_lat_tor"), F.col("ssh").alias("u_lon_pot"), F.expr("rho - 1025").alias("u_lat_pot"))
    df = diagnostics.transfer_breakdown(df, GRID, SCALES)
    names = [c for c in df.columns if c not in ("ell", *KEYS, *PLACE, "pair")]
    return out(df, ["ell", *PLACE, "pair"], 3, **{c: f"1e6 * {c}" if c[:4] in ("ui_j", "uj_i") else c for c in names})


# ------------------------------------------------------------------ a finer mesh

_FINE = Grid.degrees(178, 360, -88.5, 1.0, -179.5, 1.0)
_FINE_SCALES = [2.5e5]


def fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(itime 0, idepth 0, ilat, ilon, u, v) on a mesh of one degree; cells without rows are null."""
    cells = rasterize(lineitem(spark, sf_dir), {"ilat": "l_partkey % 178", "ilon": "l_orderkey % 360"}, {k: VALUES[k] for k in "uv"})
    return densify(cells, _FINE, []).select(F.lit(0).alias("itime"), F.lit(0).alias("idepth"), "ilat", "ilon", "u", "v")


_FINE_SQL = (
    f"raw as (select cast(l_partkey % 178 as int) as ilat, cast(l_orderkey % 360 as int) as ilon, {VALUES['u']} as u, {VALUES['v']} as v from lineitem group by 1, 2), "
    "rows_ as (select cast(range as int) as i, radians(-88.5 + range) as lat from range(178)), "
    "near as (select a.i, b.i as j, a.lat as la, b.lat as lb, 1.25e6 / 2 as half from rows_ a, rows_ b where b.i - a.i between -6 and 5), "
    "arc as (select *, 6371e3 * acos(greatest(-1.0, least(1.0, sin(la) * sin(lb) - cos(la) * cos(lb)))) as back, 6371e3 * acos(greatest(-1.0, "
    "least(1.0, sin(la) * sin(lb) + cos(la) * cos(lb)))) as there from near), "
    "win as (select *, case when back <= half then 360 when i <> j and there >= half then 1 else cast(ceil(acos(greatest(-1.0, "
    "least(1.0, (cos(half / 6371e3) - sin(la) * sin(lb)) / (cos(la) * cos(lb))))) / radians(1.0)) as int) end as m from arc), "
    "offs as materialized (select i, j, o.range - 180 as off, exp(-power((case when i = j and o.range = 180 then 0.0 else 6371e3 "
    "* acos(greatest(-1.0, least(1.0, sin(la) * sin(lb) + cos(la) * cos(lb) * cos(radians(1.0) * (o.range - 180))))) end) / 1.25e5, 2)) * cos(lb) as w "
    "from win, range(360) o where 2 * m >= 360 or o.range - 180 between -m and m - 1), "
    "total as (select i, sum(w) as s from offs group by i), "
    "sums as (select i as ilat, cast((ilon - off + 360) % 360 as int) as ilon, sum(w * u) as u, sum(w * v) as v from raw join offs on ilat = j group by all)"
)


@query("j4_one_degree", f"with {_FINE_SQL}, mesh as (select cast(a.range as int) as ilat, cast(b.range as int) as ilon from range(178) a, range(360) "
    f"b) select 250e3::double as ell, mesh.ilat, mesh.ilon, {rounded(u='coalesce(sums.u, 0) / s', v='coalesce(sums.v, 0) / s')} from "
    f"mesh join total on mesh.ilat = i left join sums on sums.ilat = mesh.ilat and sums.ilon = mesh.ilon")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(coarse_ops.coarse_grain(fine(spark, sf_dir), _FINE, _FINE_SCALES, ["u", "v"]), ["ell", *PLACE], u="u", v="v")


# ------------------------------------------------------------------ two layers

_SW = "sw as (select cast(k as int) as idepth, ilat, ilon, u / 10 + k as u, v / 10 - k as v, 100 + rho - 1025 + 50 * k + 5 * ssh as h from flat, (values (0), (1)) l(k))"
_SW_P = ( f"{_SW}, swp as (select a.*, 9.81 * (case when a.idepth = 0 then 1000 * (a.h + b.h) else 1000 * b.h + 1010 * a.h end) as "
    f"p from sw a join sw b on a.ilat = b.ilat and a.ilon = b.ilon and b.idepth = 1 - a.idepth)")
_PLANE_STEP = {"periodic_y": True, "step": 10e3, "names": "x y"}
_SW_BAR = "u v h p px py hlu hlv lap_h hu hv huu huv hvv hpx hpy"
_SW_STEEP = [f"{c}{k}" for k in (0, 1) for c in ("ut", "vt", "h", "p", "gx", "gy", "kx", "ky", "ex", "ey", "sx", "sy")] + ["ax", "ay"]
_SW_BASE = (
    f"{_SW_P}, {both('l2', 'swp', ['u', 'v', 'h'], ['idepth'], derivative=2, **_PLANE_STEP)}, {both('l1', 'l2', ['p'], ['idepth'], **_PLANE_STEP)}, "
    "quad as (select idepth, ilat, ilon, u, v, h, p, dx_p as px, dy_p as py, h * (d2x_u + d2y_u) as hlu, h * (d2x_v + d2y_v) "
    "as hlv, d2x_h + d2y_h as lap_h, h * u as hu, h * v as hv, h * u * u as huu, h * u * v as huv, h * v * v as hvv, h * dx_p as hpx, h * dy_p as hpy from l1), "
    "near as (select a.ilat as i, a.ilon as j, b.ilat as i2, b.ilon as j2, power(least(abs(a.ilon - b.ilon), 36 - abs(a.ilon "
    "- b.ilon)) * 10e3, 2) + power(least(abs(a.ilat - b.ilat), 18 - abs(a.ilat - b.ilat)) * 10e3, 2) as d2 from mesh a, mesh b), "
    f"bar as materialized (select idepth, i as ilat, j as ilon, {', '.join(f'sum(exp(-4 * d2 / (30e3 * 30e3)) * {c}) / sum(exp(-4 * d2 / (30e3 * 30e3))) as {c}' for c in _SW_BAR.split())} from "
    f"near join quad on ilat = i2 and ilon = j2 group by all), "
    "favre as (select *, hu / h as ut, hv / h as vt, huu / h as uu, huv / h as uv, hvv / h as vv, hlu / h as lu, hlv / h as lv, hpx - h * px as thx, hpy - h * py as thy from bar), "
    f"wide as (select a.ilat, a.ilon, {', '.join(f'{t}.{c} as {c}{k}' for k, t in ((0, 'a'), (1, 'b')) for c in 'u v h p lap_h ut vt uu uv vv lu lv thx thy'.split())} from "
    f"favre a join favre b using (ilat, ilon) where a.idepth = 0 and b.idepth = 1), "
    "energy as (select *, 500.0 * h0 * (ut0 * ut0 + vt0 * vt0) as ke0, 505.0 * h1 * (ut1 * ut1 + vt1 * vt1) as ke1, 500.0 * 9.81 "
    "* h0 * (h0 + 2 * h1) as pe0, 505.0 * 9.81 * h1 * h1 as pe1 from wide), "
    + "flux as (select *, "
    + ", ".join(
        f"h{k} * (ut{k} - u{k}) as gx{k}, h{k} * (vt{k} - v{k}) as gy{k}, ut{k} * ke{k} as kx{k}, vt{k} * ke{k} as ky{k}, ut{k} * pe{k} as ex{k}, vt{k} * pe{k} as ey{k}, "
        f"{r} * h{k} * (ut{k} * (uu{k} - ut{k} * ut{k}) + vt{k} * (uv{k} - ut{k} * vt{k})) as sx{k}, {r} * h{k} * (ut{k} * (uv{k} - "
    f"ut{k} * vt{k}) + vt{k} * (vv{k} - vt{k} * vt{k})) as sy{k}"
        for k, r in ((0, 1000.0), (1, 1010.0))
    )
    + f", 9810.0 * h0 * h1 * (ut0 + ut1) as ax, 9810.0 * h0 * h1 * (vt0 + vt1) as ay from energy), {both('g', 'flux', _SW_STEEP, **_PLANE_STEP)}"
)


def _sw_terms(k: int) -> dict[str, tuple[str, str, int]]:
    """For each term: its scale, its SQL, and the digits that are compared."""
    r = (1000.0, 1010.0)[k]
    strain = f"(dy_ut{k} + dx_vt{k})"
    grow0, grow1 = "h1 * (dx_h0 * (ut1 - u1) + dy_h0 * (vt1 - v1))", "h0 * (dx_h1 * (ut0 - u0) + dy_h1 * (vt0 - v0))"
    return {
        "KE": ("1", f"ke{k}", 2),
        "PE": ("1", f"pe{k}", 0),
        "Pi": ("1e3", f"{r} * h{k} * (dx_ut{k} * (uu{k} - ut{k} * ut{k}) + {strain} * (uv{k} - ut{k} * vt{k}) + dy_vt{k} * (vv{k} - vt{k} * vt{k}))", 2),
        "Gamma": ("1e3", f"9.81 * {r} * h{k} * (dx_gx{k} + dy_gy{k})", 1),
        "baroclinic": ("1e9", f"0.05 * (dx_vt{k} - dy_ut{k}) * (dx_h{k} * dy_p{k} - dy_h{k} * dx_p{k})", 2),
        "traditional": ("1", f"(dx_ut{k} + dy_vt{k}) * pe{k}", 1),
        "KE_transport": ("1e3", f"dx_kx{k} + dy_ky{k}", 1),
        "PE_transport": ("1", f"dx_ex{k} + dy_ey{k}", 1),
        "alt_PE_transport": ("1", "0.0" if k else "dx_ax + dy_ay", 1),
        "KE_small_transport": ("1e3", f"dx_sx{k} + dy_sy{k}", 2),
        "viscous_KE": ("1e6", f"{r} * h{k} * (ut{k} * lu{k} + vt{k} * lv{k})", 2),
        "viscous_PE": ("1e6", "9.81 * 1010.0 * h1 * lap_h1" if k else "9810.0 * ((h0 + h1) * lap_h0 + h0 * lap_h1)", 1),
        "bc_KE": ("1e6", f"h{k} * (dx_p{k} * (ut{k} - u{k}) + dy_p{k} * (vt{k} - v{k}))", 1),
        "bc_PE": ("1e6", "0.0" if k else f"9810.0 * ({grow0} + {grow1})", 1),
        "bc_PE_part": ("1e6", f"9810.0 * {grow0 if k else grow1}", 1),
        "cross_layer_work": ("1e3", "-9810.0 * h1 * (dx_h0 * u1 + dy_h0 * v1)" if k else "9810.0 * h1 * (dx_h0 * u0 + dy_h0 * v0)", 1),
        "pressure_stress_work": ("1e3", f"ut{k} * thx{k} + vt{k} * thy{k}", 2),
        "thickness_strain": ("1e12", f"0.1 * 9.81 * {r} * (dx_h{k} * dx_h{k} * dx_ut{k} + dx_h{k} * dy_h{k} * {strain} + dy_h{k} * dy_h{k} * dy_vt{k})", 2),
        "thickness_conversion": ("1e12", f"0.1 * 9.81 * 1000.0 * (dx_ut{k} * dx_h0 * dx_h1 + 0.5 * {strain} * (dx_h0 * dy_h1 + dy_h0 * dx_h1) + dy_vt{k} * dy_h0 * dy_h1)", 2),
    }


def _sw_select(k: int) -> str:
    return f"select cast({k} as int) as idepth, ilat, ilon, " + ", ".join(f"round({s} * ({e}), {d}) + 0.0 as {n}" for n, (s, e, d) in _sw_terms(k).items()) + " from g"


def _two_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = flat(spark, sf_dir).select("itime", F.explode(F.array(F.lit(0), F.lit(1))).alias("idepth"), *PLACE, "u", "v", "rho", "ssh")
    layers = layers.select("itime", "idepth", *PLACE, F.expr("u / 10 + idepth").alias("u"), F.expr("v / 10 - idepth").alias("v"), F.expr("100 + rho - 1025 + 50 * idepth + 5 * ssh").alias("h"))
    return shallow_water.two_layers(layers, _PLANE, [30e3], _PLANE_CFG)


@query("sw2_two_layers", f"with {FLAT}, {_SW_BASE} {_sw_select(0)} union all {_sw_select(1)}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _two_layers(spark, sf_dir)
    return df.select("idepth", *PLACE, *[(F.round(F.expr(f"{s} * {n}"), d) + 0.0).alias(n) for n, (s, _, d) in _sw_terms(0).items()])

