"""Whole analyses: from field tables to full outputs and post-processed tables, and a command line for them.

    python -m tesseral.plans.pipelines coarse_grain --input FOLDER --output FOLDER --filter_scales "1e5 5e5"

The input folder holds `lat`, `lon` and `fields` (itime, idepth, ilat, ilon, values)
as Parquet, and may hold `depth`, `time`, `regions` (region, ilat, ilon, value),
`coarse_lat` and `coarse_lon` (edges of maps), `seed` (psi0, phi0) and `particles`
(traj, lon, lat). `--help` lists the analyses and their options.
"""

from __future__ import annotations

import argparse
import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.config import FilterConfig, check_scales
from tesseral.functions import geometry, kernels, quadrature
from tesseral.grid import KEYS, Grid, densify
from tesseral.operators import aggregate, calculus, coarse, diagnostics, particles, potentials, reshape, shallow_water, solve
from tesseral.sources import tables

SLICE = ["ell", "itime", "idepth"]


def scale_list(text: str) -> list[float]:
    """Filter scales from one blank-separated text."""
    return check_scales([float(x) for x in text.split()])


def truth(text: str) -> bool:
    """true, false, 1, 0, yes or no, whatever the case."""
    low = text.strip().lower()
    if low in ("true", "1", "yes", "t", "y"):
        return True
    if low in ("false", "0", "no", "f", "n"):
        return False
    raise ValueError(f"{text!r} is neither true nor false")


def prepare(cells: DataFrame, grid: Grid, fields: list[str], cfg: FilterConfig) -> tuple[DataFrame, Grid]:
    """Dense cells with the boolean `water`: land is null; it counts as water of value 0 if cfg.filter_over_land. Rows are added up to the poles if asked."""
    df = densify(cells.select("itime", "idepth", "ilat", "ilon", *fields), grid, ["itime", "idepth"])
    df = df.withColumn("water", F.lit(True) if cfg.filter_over_land else F.col(fields[0]).isNotNull())
    df = reshape.mask_poles(df, grid, cfg)
    if cfg.extend_to_poles:
        df, grid = reshape.extend_to_poles(df, grid, fields, cfg, masks={"water": cfg.filter_over_land})
    return df, grid


def postprocess(full: DataFrame, grid: Grid, fields: list[str], regions: DataFrame, cfg: FilterConfig, zonal: bool = True, times: bool = False, edges: tuple[list[float], list[float]] | None = None, okubo_weiss: bool = False) -> dict[str, DataFrame]:
    """Reductions of full outputs (ell, itime, idepth, ilat, ilon, fields), one table a kind. Several read `full`: store it first if it is dear."""
    out = {"regions": aggregate.region_mean_std(full, regions, grid, fields, cfg, SLICE)}
    if zonal:
        out["zonal"] = aggregate.zonal_mean(full, grid, fields, cfg, SLICE, deviations=True)
        out["zonal_median"] = aggregate.zonal_median(full, fields, SLICE)
    if times:
        out["time"] = aggregate.time_mean_std(full, fields, ["ell", "idepth"])
    if edges:
        out["maps"] = aggregate.coarse_map(full, grid, fields, *edges, cfg, SLICE)
    if okubo_weiss:
        out["okubo_weiss"] = aggregate.okubo_weiss_histogram(full, regions, grid, fields, "okubo_weiss", cfg, SLICE)
    return out


def write_postprocess(full: DataFrame, grid: Grid, fields: list[str], regions: DataFrame, cfg: FilterConfig, path: str, **kinds) -> None:  # noqa: ANN003
    """Writes postprocess() as one table a kind below path, and the regions with their areas; the kernel's moment ratio goes with it as an attribute."""
    spark = full.sparkSession
    n, step, shape = kernels.alpha_sums(cfg)
    moment = spark.range(n).select((F.col("id") * step).alias("r")).select("r", F.expr(shape).alias("k")).agg(F.sum(F.expr("k * r * r * r")) / F.sum(F.expr("k * r"))).first()[0]
    for kind, df in postprocess(full, grid, fields, regions, cfg, **kinds).items():
        tables.write_results(df, f"{path}/{kind}", {"kernel": cfg.kernel, "kernel_alpha": moment, "rho0": cfg.rho0})
    tables.write_regions(regions, f"{path}/region_definitions")


def coarse_grain_scalars(cells: DataFrame, grid: Grid, scales: list[float], fields: list[str], cfg: FilterConfig = FilterConfig(), conversion: tuple[str, str] | None = None) -> DataFrame:
    """Scalars with their scale derivatives. conversion: density and vertical velocity, for their coarse product and its scale derivative (both terms of the product rule)."""
    df, grid = prepare(cells, grid, fields, cfg)
    out = coarse.coarse_grain(df, grid, scales, fields, cfg, derivatives=True, water="water")
    if conversion:
        rho, w = conversion
        out = out.withColumns({"barrho_barw": F.expr(f"{rho} * {w}"), "dl_barrho_barw": F.expr(f"dl_{rho} * {w} + {rho} * dl_{w}")})
    return out


def coarse_grain_velocity(cells: DataFrame, grid: Grid, scales: list[float], cfg: FilterConfig = FilterConfig(), transfers: bool = True) -> DataFrame:
    """Velocities (u_lon, u_lat and, where given, u_r, rho) filtered in Cartesian components: coarse_u_lon, coarse_u_lat, coarse_KE, fine_KE, vort_r, div, okubo_weiss, and Pi, Z, div_transport."""
    df = tables.default_column(cells, "u_r")
    given = ["u_lon", "u_lat", "u_r", *(["rho"] if "rho" in df.columns else [])]
    df, grid = prepare(df, grid, given, cfg)
    df = df.fillna(0.0, given)
    df = diagnostics.with_cartesian(df, grid, cfg)
    fields = ["u_x", "u_y", "u_z", *[f"u_{p}" for p in diagnostics.PAIRS]]
    if transfers and not cfg.cartesian:
        df = diagnostics.vorticity(df, grid, cfg, KEYS[:2], water="water").withColumnRenamed("vort_r", "w")
        df = df.select("*", *[F.expr(f"w * u_{a}").alias(f"w_{a}") for a in "xyz"])
        fields += ["w", "w_x", "w_y", "w_z"]
    if "rho" in given:
        fields.append("rho")
    bar = coarse.coarse_grain(df, grid, scales, fields, cfg, water="water")
    if transfers:
        bar = diagnostics.transfers(bar, grid, cfg, SLICE, vorticity_products="w" in fields)
    located = grid.located(bar, cfg)
    back = ("0.0", "u_x", "u_y") if cfg.cartesian else geometry.cartesian_to_spherical("u_x", "u_y", "u_z", "lon", "lat")
    filtered = f"{0.5 * cfg.rho0!r} * (u_xx + u_yy + u_zz)"
    e = diagnostics.energies_sql(cfg, ("u_x", "u_y", "u_z"), filtered)
    more = [F.expr(x).alias(n) for n, x in (("u_r", back[0]), ("u_lon", back[1]), ("u_lat", back[2]), ("coarse_KE", e["coarse_KE"]), ("fine_KE", e["fine_KE"]))]
    if "rho" in fields:
        more.append(F.expr(diagnostics.potential_conversion_sql(cfg, "rho", back[0])).alias("PEtoKE"))
    out = located.select(*[c for c in bar.columns if c not in fields], *more)
    return diagnostics.vorticity(out, grid, cfg, SLICE, u_r="u_r").withColumnsRenamed({"u_lon": "coarse_u_lon", "u_lat": "coarse_u_lat", "u_r": "coarse_u_r"})


def coarse_grain_helmholtz(cells: DataFrame, grid: Grid, scales: list[float], cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """Potentials psi and phi filtered as scalars, then differentiated: velocities, energies, spectra and two-dimensional transfers of the toroidal (tor), potential (pot) and whole (tot) flow.

    Columns that cells may have besides: u_r, a radial velocity, which is filtered and counts in the whole flow's energies; tau_lon and tau_lat, a wind
    stress, for the work of the wind below each scale; uu, uv and vv, given products that take the place of the whole flow's own.
    Two passes over the fine and two over the coarse fields; nothing is joined.
    """
    given = [c for c in ("u_r", "tau_lon", "tau_lat", "uu", "uv", "vv") if c in cells.columns]
    df, grid = prepare(cells, grid, ["psi", "phi", *given], cfg)
    r, kinds = repr(cfg.earth_radius), ("tor", "pot", "tot")

    def velocities(prefix: str = "") -> dict[str, str]:
        """Velocities of the potentials whose slopes are columns dlon_<prefix>psi and so on."""
        a, b = f"{prefix}psi", f"{prefix}phi"
        own = {"u_lon_tor": f"-dlat_{a} / {r}", "u_lat_tor": f"dlon_{a} / ({r} * cos(lat))", "u_lon_pot": f"dlon_{b} / ({r} * cos(lat))", "u_lat_pot": f"dlat_{b} / {r}"}
        own |= {f"u_{x}_tot": f"{own[f'u_{x}_tor']} + {own[f'u_{x}_pot']}" for x in ("lon", "lat")}
        return {f"{prefix}{n}": e for n, e in own.items()}

    def sloped(source: DataFrame, keys: list[str], prefixes: tuple[str, ...]) -> DataFrame:
        names = [f"{p}{f}" for p in prefixes for f in ("psi", "phi")]
        d = grid.located(calculus.spherical_gradients(source, grid, names, keys, cfg.order, 1, cfg.periodic_x, cfg.periodic_y), cfg)
        return d.select(*[f"`{c}`" for c in source.columns], *[F.expr(e).alias(n) for p in prefixes for n, e in velocities(p).items()])

    fine = sloped(df, ["itime", "idepth"], ("",))
    pairs = {"uu": ("lon", "lon"), "uv": ("lon", "lat"), "vv": ("lat", "lat")}
    products = {f"{n}_{k}": f"u_{a}_{k} * u_{b}_{k}" if k != "tot" or n not in given else n for k in kinds for n, (a, b) in pairs.items()}
    if "u_r" in given:
        products["rr"] = "u_r * u_r"
    wind = "tau_lon" in given and "tau_lat" in given
    if wind:
        products["work"] = "tau_lon * u_lon_tot + tau_lat * u_lat_tot"
    fine = fine.select("itime", "idepth", "ilat", "ilon", "water", "psi", "phi", *[c for c in given if c in ("u_r", "tau_lon", "tau_lat")], *[F.expr(e).alias(n) for n, e in products.items()])
    plain = [*products, *[c for c in given if c in ("u_r", "tau_lon", "tau_lat")]]
    bar = coarse.coarse_grain(fine, grid, scales, ["psi", "phi", *plain], cfg, derivatives=True, water="water").drop(*[f"{p}_{n}" for p in ("dl", "dll") for n in plain])
    bar = sloped(bar, SLICE, ("", "dl_", "dll_"))
    speeds = [f"u_{x}_{k}" for k in kinds for x in ("lon", "lat")]
    d = grid.located(calculus.spherical_gradients(bar, grid, speeds, SLICE, cfg.order, 1, cfg.periodic_x, cfg.periodic_y), cfg)
    columns: dict[str, str] = {}
    for k in kinds:
        u = (f"u_lon_{k}", f"u_lat_{k}")
        moving = (*u, "u_r") if k == "tot" and "u_r" in given else u
        whole = f"{0.5 * cfg.rho0!r} * (uu_{k} + vv_{k}{' + rr' if len(moving) > 2 else ''})"
        columns |= {f"{n}_{k}": e for n, e in diagnostics.energies_sql(cfg, moving, whole).items() if n in ("coarse_KE", "fine_KE")}
        columns |= {f"{n}_{k}": e for n, e in diagnostics.spectrum_sql(cfg, *u).items()}
        columns[f"Pi_{k}"] = diagnostics.helmholtz_transfer_sql(cfg, *u, f"uu_{k}", f"uv_{k}", f"vv_{k}")
        turning = diagnostics.vorticity_sql(cfg, *u, "u_r" if len(moving) > 2 else "0.0")
        columns |= {f"{n}_{k}": turning[n] for n in ("vort_r", "div", "okubo_weiss")}
        columns[f"enstrophy_{k}"] = f"{0.5 * cfg.rho0!r} * {turning['vort_r']} * {turning['vort_r']}"
    if wind:
        columns["wind_forcing"] = "work - (tau_lon * u_lon_tot + tau_lat * u_lat_tot)"
    drop = {"work", "rr", "tau_lon", "tau_lat"}
    return d.select(*[f"`{c}`" for c in bar.columns if c not in drop], *[F.expr(e).alias(n) for n, e in columns.items()])


def johnson_decomposition(cells: DataFrame, grid: Grid, ell: float, steps: int = 7, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """scale_integral_energies() at the nodes of a Kronrod rule with `steps` Gauss points; errors are the difference of the two rules."""
    return scale_integral_energies(cells, grid, ell, quadrature.scale_nodes(ell, steps), cfg)


def scale_integral_energies(cells: DataFrame, grid: Grid, ell: float, nodes: list[tuple[float, float, float]], cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """Energies of rotation and strain of psi and phi integrated over scales below ell: at each node delta potentials are filtered at delta, energies of the velocity gradient filtered again at sqrt(ell^2 - delta^2), and summed by the nodes' weights."""
    names = ["cyclonic", "anticyclonic", "divergent", "strain"]
    parts = None
    for delta, w, w2 in nodes:
        bar = coarse.coarse_grain(cells, grid, [delta], ["psi", "phi"], cfg)
        d = grid.located(calculus.spherical_gradients(bar, grid, ["psi", "phi"], SLICE, cfg.order, 1, cfg.periodic_x, cfg.periodic_y), cfg)
        r = repr(cfg.earth_radius)
        vel = d.select(*SLICE, "ilat", "ilon", F.expr(f"-dlat_psi / {r} + dlon_phi / ({r} * cos(lat))").alias("u_lon"), F.expr(f"dlon_psi / ({r} * cos(lat)) + dlat_phi / {r}").alias("u_lat"))
        vort = grid.located(diagnostics.vorticity(vel, grid, cfg, SLICE), cfg)
        e = vort.select("itime", "idepth", "ilat", "ilon", *[F.expr(x).alias(n) for n, x in diagnostics.rotation_strain_energies().items()])
        again = coarse.coarse_grain(e, grid, [math.sqrt(max(ell * ell - delta * delta, 1.0))], names, cfg).withColumn("ell", F.lit(float(delta)))
        parts = again if parts is None else parts.unionByName(again)
    return aggregate.quadrature_sum(parts, nodes, names, ell, ["itime", "idepth", "ilat", "ilon"])


def multigrid_projection(cells: DataFrame, grid: Grid, coarse_grid: Grid, cfg: FilterConfig = FilterConfig(), how: solve.Projection = solve.Projection(), u: str = "u_lon", v: str = "u_lat") -> DataFrame:
    """A Helmholtz projection seeded by one on a coarser grid: coarsen, solve, refine, solve."""
    keys = ["itime", "idepth", "ilat", "ilon"]
    a, b = (reshape.coarsen_linear(cells, grid, coarse_grid, c).select(*keys, c) for c in (u, v))
    first = solve.helmholtz(a.join(b, keys), coarse_grid, cfg, how, u=u, v=v)
    seed = reshape.refine_bilinear(first, coarse_grid, grid, ["psi", "phi"]).withColumnsRenamed({"psi": "psi0", "phi": "phi0"})
    return solve.helmholtz(cells.join(seed, keys), grid, cfg, how, u=u, v=v, seed=("psi0", "phi0"))


def coarsened_seed(cells: DataFrame, grid: Grid, coarse_grid: Grid, fields: list[str]) -> DataFrame:
    """Fields on a coarser grid, with the water and the number of cells that each came from."""
    keys = ["itime", "idepth", "ilat", "ilon"]
    out = None
    for f in fields:
        one = reshape.coarsen_linear(cells, grid, coarse_grid, f)
        out = one if out is None else out.join(one.select(*keys, f), keys)
    return out


# ------------------------------------------------------------------ command line


def _velocity(cells: DataFrame, a: argparse.Namespace) -> DataFrame:
    """cells under the names of the analyses."""
    names = {a.zonal_vel: "u_lon", a.merid_vel: "u_lat", a.vert_vel: "u_r", a.density: "rho", a.ssh: "ssh", a.psi: "psi", a.phi: "phi"}
    return cells.withColumnsRenamed({k: v for k, v in names.items() if k in cells.columns and v not in cells.columns})


def _filtered(kind: str) -> Callable:
    def run(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
        if kind == "scalars":
            names = a.variables.split()
            full = coarse_grain_scalars(cells, grid, a.filter_scales, names, cfg, tuple(a.PEKE.split()) if a.PEKE else None)
        elif kind == "helmholtz":
            full = coarse_grain_helmholtz(_velocity(cells, a), grid, a.filter_scales, cfg)
        elif kind == "spectral":
            df = _velocity(cells, a).withColumnsRenamed({"u_lon": "u", "u_lat": "v"})
            full = solve.sharp_energies(df, grid, a.filter_scales, cfg)
        elif kind == "layers":
            full = shallow_water.two_layers(_velocity(cells, a).withColumnsRenamed({"u_lon": "u", "u_lat": "v"}), grid, a.filter_scales, cfg, tuple(float(x) for x in a.densities.split()), a.alpha, a.viscosity)
        elif kind == "breakdown":
            full = diagnostics.transfer_breakdown(cells, grid, a.filter_scales, cfg)
        else:
            full = coarse_grain_velocity(_velocity(cells, a), grid, a.filter_scales, cfg, a.transfers)
        tables.write_results(full, f"{a.output}/full", {"kernel": cfg.kernel, "rho0": cfg.rho0}, a.single)
        stored = spark.read.parquet(f"{a.output}/full")
        if not a.postprocess or kind in ("breakdown", "layers"):
            return
        edges = None
        if tables.exists(spark, f"{a.input}/coarse_lat") and tables.exists(spark, f"{a.input}/coarse_lon"):
            edges = tuple([math.radians(x) if a.is_degrees else x for x in tables.read_axis(spark, a.input, n)] for n in ("coarse_lat", "coarse_lon"))
        fields = [c for c, t in stored.dtypes if t in ("double", "float") and c != "ell"]
        regions = tables.read_regions(spark, a.region_definitions or f"{a.input}/regions", grid)
        write_postprocess(stored, grid, fields, regions, cfg, a.output, zonal=a.zonal, times=a.time_averages, edges=edges, okubo_weiss=a.okubo_weiss and "okubo_weiss" in stored.columns)
        if not a.full_outputs:
            spark.createDataFrame([], stored.schema).write.mode("overwrite").parquet(f"{a.output}/full")

    return run


def _projection(kind: str) -> Callable:
    def run(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
        df = _velocity(cells, a)
        if kind in ("uiuj", "SymTensor"):
            result = solve.decompose_tensor(df, grid, cfg, vector=kind == "uiuj", steps=a.max_iterations, tolerance=a.tolerance, damp=a.Tikhov_Laplace)
        else:
            how = solve.Projection(a.max_iterations, a.tolerance, a.Tikhov_Laplace, a.use_area_weight, toroidal=kind != "potential", potential=kind != "toroidal")
            seed = None
            if tables.exists(spark, f"{a.input}/seed"):
                df, seed = df.join(spark.read.parquet(f"{a.input}/seed").select(*KEYS, "psi0", "phi0"), KEYS), ("psi0", "phi0")
            if a.use_mask:
                df = df.withColumn("water", F.col("u_lon").isNotNull())
            result = solve.helmholtz(df, grid, cfg, how, seed=seed, water="water" if a.use_mask else None)
        tables.write_results(result, f"{a.output}/projection", {"tolerance": a.tolerance, "max_iterations": a.max_iterations, "Tikhov_Laplace": a.Tikhov_Laplace})

    return run


def _other_grid(spark: SparkSession, a: argparse.Namespace) -> Grid:
    return tables.read_grid(spark, a.other_grid, a.is_degrees)


def _refine(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
    names = a.variables.split()
    tables.write_results(reshape.refine_bilinear(cells, grid, _other_grid(spark, a), names).withColumnsRenamed({"psi": "psi0", "phi": "phi0"}), f"{a.output}/seed")


def _coarsen(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
    tables.write_results(coarsened_seed(cells, grid, _other_grid(spark, a), a.variables.split()), f"{a.output}/fields")


def _radial(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
    depth = tables.read_axis(spark, a.input, "depth")
    axis = spark.createDataFrame(list(enumerate(depth)), "idepth int, depth double")
    df = _velocity(cells, a).join(F.broadcast(axis), "idepth")
    tables.write_results(diagnostics.radial_velocity(df, grid, "depth", cfg).drop("depth"), f"{a.output}/fields")


def _geostrophic(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
    tables.write_results(diagnostics.geostrophic_velocity(_velocity(cells, a), grid, cfg), f"{a.output}/fields")


def _interpolate(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
    tables.write_results(solve.fill_land(cells, grid, a.variables.split(), cfg, near_coast=a.coast or None), f"{a.output}/fields")


def _particles(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
    times = tables.read_axis(spark, a.input, "time") if tables.exists(spark, f"{a.input}/time") else [0.0]
    flow = _velocity(cells.where(F.col("idepth") == a.level), a).withColumnsRenamed({"u_lon": "u", "u_lat": "v"})
    if tables.exists(spark, f"{a.input}/particles"):
        starts = spark.read.parquet(f"{a.input}/particles")
    else:
        water = flow.where(F.col("itime") == 0).select("ilat", "ilon", F.col("u").isNotNull().alias("water"))
        starts = particles.seed_positions(spark, a.particles, grid, water, a.seed)
    last = a.final_time or times[-1] or a.output_frequency
    outputs = [times[0] + k * a.output_frequency for k in range(int((last - times[0]) / a.output_frequency + 1e-9) + 1)]
    how = particles.Advection(a.cfl, lifespan=a.lifespan or None)
    there = particles.advect(starts, flow, times, outputs, grid, cfg, how)
    names = [x for x in a.variables.split() if x in cells.columns]
    if names:
        there = particles.project_onto(there, cells.where(F.col("idepth") == a.level), times, grid, names, cfg.periodic_x)
    ends = there.where((F.col("iout") == len(outputs) - 1) & F.col("lon").isNotNull()).select("traj", "lon", "lat")
    back = particles.advect(ends, flow, times, outputs, grid, cfg, how, backwards=True) if a.backwards else None
    apart = particles.fore_back_distance(there, back, cfg) if a.backwards else None
    tables.write_trajectories(there, f"{a.output}/particles", {"cfl": a.cfl, "lifespan": a.lifespan}, back, apart, names)


def _onto_particles(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
    times, names = tables.read_axis(spark, a.input, "time"), a.variables.split()
    points = spark.read.parquet(f"{a.input}/particles").select("traj", "iout", "time", F.radians("longitude").alias("lon"), F.radians("latitude").alias("lat"))
    df = particles.project_onto(points, cells.where(F.col("idepth") == a.level), times, grid, names, cfg.periodic_x)
    df = aggregate.trajectory_derivatives(df, names, a.output_frequency)
    tables.write_results(df, f"{a.output}/projected")
    pairs = [(f"ddt_{x}", y) for x in names for y in names if x != y]
    if pairs:
        tables.write_results(aggregate.trajectory_correlation(df, pairs), f"{a.output}/correlations")


def _compare(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
    own = [spark.read.parquet(p).select("traj", "iout", F.radians("longitude").alias("lon"), F.radians("latitude").alias("lat")) for p in (f"{a.input}/particles", f"{a.other}/particles")]
    tables.write_results(particles.fore_back_distance(*own, cfg), f"{a.output}/distances")


def _johnson(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
    for ell in a.filter_scales:
        found = johnson_decomposition(_velocity(cells, a), grid, ell, a.integration_steps, cfg)
        tables.write_results(found, f"{a.output}/johnson_{ell:g}", {"filter_scale": ell, "integration_steps": a.integration_steps})


def _conversion(spark: SparkSession, cells: DataFrame, grid: Grid, cfg: FilterConfig, a: argparse.Namespace) -> None:
    df = _velocity(cells, a)
    terms = {"u_lon": "u_lon", "u_lat": "u_lat", "uu": "u_lon * u_lon", "uv": "u_lon * u_lat", "vv": "u_lat * u_lat"}
    df = df.select("itime", "idepth", "ilat", "ilon", *[F.expr(e).alias(n) for n, e in terms.items()])
    if a.subset:
        means = aggregate.subset_means(df, "itime", None, a.subset, list(terms), ["idepth", "ilat", "ilon"])
        tables.write_results(diagnostics.eddy_mean_conversion(means, grid, cfg, ["subset", "idepth"]), f"{a.output}/conversion")
    else:
        means = df.groupBy("idepth", "ilat", "ilon").agg(*[F.avg(c).alias(c) for c in terms])
        tables.write_results(diagnostics.eddy_mean_conversion(means, grid, cfg), f"{a.output}/conversion")


#: Every analysis by the name of its program.
ANALYSES: dict[str, Callable] = {
    "coarse_grain": _filtered("velocity"),
    "coarse_grain_scalars": _filtered("scalars"),
    "coarse_grain_helmholtz": _filtered("helmholtz"),
    "coarse_grain_fftw": _filtered("spectral"),
    "coarse_grain_sw": _filtered("layers"),
    "Pi_helm_breakdown": _filtered("breakdown"),
    "Helmholtz_projection": _projection("both"),
    "toroidal_projection": _projection("toroidal"),
    "potential_projection": _projection("potential"),
    "Helmholtz_projection_uiuj": _projection("uiuj"),
    "Helmholtz_projection_SymTensor": _projection("SymTensor"),
    "refine_Helmholtz_seed": _refine,
    "coarsen_grid_linear": _coarsen,
    "compute_radial_velocity": _radial,
    "geostrophic_vel": _geostrophic,
    "interpolator": _interpolate,
    "particles": _particles,
    "project_onto_particles": _onto_particles,
    "compare_particles": _compare,
    "Johnson_decomp": _johnson,
    "vonStorch": _conversion,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("analysis", choices=sorted(ANALYSES))
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--other", help="a second input folder, to compare with")
    p.add_argument("--other_grid", help="a folder with lat and lon to refine or coarsen to")
    p.add_argument("--filter_scales", type=scale_list, default=[1e5], help="blank-separated, in metres")
    p.add_argument("--variables", default="rho", help="blank-separated names")
    for name, column in (("zonal_vel", "u_lon"), ("merid_vel", "u_lat"), ("vert_vel", "u_r"), ("density", "rho"), ("ssh", "ssh"), ("psi", "psi"), ("phi", "phi")):
        p.add_argument(f"--{name}", default=column, help="the column's name in the input")
    p.add_argument("--region_definitions", help="a table of regions instead of the input's")
    p.add_argument("--PEKE", default="", help="density and vertical velocity, for their conversion")
    p.add_argument("--kernel", default="gaussian")
    p.add_argument("--order", type=int, default=4)
    p.add_argument("--rho0", type=float, default=1025.0)
    for name in ("cartesian", "periodic_y", "deform_around_land", "zonal_kernel_only", "extend_to_poles", "single", "time_averages", "okubo_weiss", "use_mask", "backwards"):
        p.add_argument(f"--{name}", type=truth, default=False)
    for name in ("is_degrees", "periodic_x", "uniform_lat", "filter_over_land", "transfers", "zonal", "postprocess", "full_outputs", "use_area_weight"):
        p.add_argument(f"--{name}", type=truth, default=True)
    p.add_argument("--max_iterations", type=int, default=1500)
    p.add_argument("--tolerance", type=float, default=1e-12)
    p.add_argument("--Tikhov_Laplace", type=float, default=0.0)
    p.add_argument("--densities", default="1000 1010", help="of two layers")
    p.add_argument("--alpha", type=float, default=0.1)
    p.add_argument("--viscosity", type=float, default=1.0)
    p.add_argument("--integration_steps", type=int, default=7)
    p.add_argument("--coast", type=int, default=0, help="fill land from water so many cells from it")
    p.add_argument("--subset", type=int, default=0, help="means over all subsets of so many times")
    p.add_argument("--level", type=int, default=0, help="depth level of particles")
    p.add_argument("--particles", type=int, default=100)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--cfl", type=float, default=1e-5)
    p.add_argument("--lifespan", type=float, default=0.0)
    p.add_argument("--final_time", type=float, default=0.0)
    p.add_argument("--output_frequency", type=float, default=86400.0)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    names = ("kernel", "order", "rho0", "cartesian", "periodic_x", "periodic_y", "uniform_lat", "deform_around_land", "filter_over_land", "zonal_kernel_only", "extend_to_poles", "postprocess", "full_outputs")
    cfg = replace(FilterConfig(), **{n: getattr(a, n) for n in names})
    tables.require(spark, f"{a.input}/lat", f"{a.input}/lon")
    grid = tables.read_grid(spark, a.input, a.is_degrees and not a.cartesian)
    cells = spark.read.parquet(f"{a.input}/fields") if tables.exists(spark, f"{a.input}/fields") else spark.createDataFrame([], "itime int, idepth int, ilat int, ilon int")
    ANALYSES[a.analysis](spark, cells, grid, cfg, a)


if __name__ == "__main__":
    main()
