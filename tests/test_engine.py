"""Properties of the gridded engine: manufactured solutions, conservation, and numpy brute force."""

from __future__ import annotations

import math
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.config import KERNEL_PAD, FilterConfig, check_scales
from tesseral.functions import geometry, kernels
from tesseral.grid import Grid, densify
from tesseral.operators import aggregate, calculus, coarse, diagnostics, particles, potentials, reshape, shallow_water, solve

GRID = Grid.degrees(18, 36, -85.0, 10.0, -175.0, 10.0)
CFG = FilterConfig()
KEYS = ["itime", "idepth"]


def cells(spark, grid, **fields):
    mesh = densify(spark.createDataFrame([], "ilat int, ilon int"), grid, []).select(F.lit(0).alias("itime"), F.lit(0).alias("idepth"), "ilat", "ilon")
    located = grid.located(mesh, CFG)
    return located.select(*mesh.columns, *[F.expr(e).cast("double").alias(n) for n, e in fields.items()])


def as_array(df, grid, name):
    out = np.full((grid.nlat, grid.nlon), np.nan)
    for r in df.select("ilat", "ilon", name).collect():
        out[r.ilat, r.ilon] = r[name]
    return out


def test_config_rejects_clashes():
    for bad in ({"kernel": "box"}, {"order": 5}, {"uniform_lat": False}, {"postprocess": False, "full_outputs": False}, {"cartesian": True, "extend_to_poles": True}):
        with pytest.raises(ValueError):
            FilterConfig(**bad)
    for scales in ([], [0.0], [-1.0]):
        with pytest.raises(ValueError):
            check_scales(scales)


def test_areas_cover_the_sphere():
    assert math.isclose(sum(GRID.areas(CFG)) * GRID.nlon, 4 * math.pi * CFG.earth_radius**2, rel_tol=2e-3)


@pytest.mark.parametrize("order,derivative", [(o, d) for o in (2, 4, 6) for d in (1, 2)])
def test_coefficients_meet_their_moments(order, derivative):
    n = order + derivative
    for left in range(n):
        w = calculus.coefficients(tuple(range(-left, n - left)), derivative)
        for k in range(n):
            total = sum(c * (i - left) ** k for i, c in enumerate(w))
            assert total == (math.factorial(derivative) if k == derivative else 0)


def test_known_coefficients():
    assert [float(c) * 12 for c in calculus.coefficients((-2, -1, 0, 1, 2), 1)] == [1, -8, 0, 8, -1]
    assert [float(c) * 12 for c in calculus.coefficients((-1, 0, 1, 2, 3, 4), 2)] == [10, -15, -4, 14, -6, 1]


@pytest.mark.parametrize("order", [2, 4])
def test_derivatives_converge(spark, order):
    errors = []
    for n in (24, 48):
        grid = Grid.degrees(n, 2 * n, -90 + 90 / n, 180 / n, -180 + 90 / n, 180 / n)
        df = cells(spark, grid, f="cos(2 * lon + 3 * lat) * exp(-lat * lat)", fx="-2 * sin(2 * lon + 3 * lat) * exp(-lat * lat)", fy="(-3 * sin(2 * lon + 3 * lat) - 2 * lat * cos(2 * lon + 3 * lat)) * exp(-lat * lat)")
        df = calculus.spherical_gradients(df, grid, ["f"], KEYS, order)
        e = df.agg(F.sqrt(F.avg(F.expr("pow(dlon_f - fx, 2)"))), F.sqrt(F.avg(F.expr("pow(dlat_f - fy, 2)")))).first()
        errors.append(list(e))
    for a, b in zip(*errors, strict=True):
        assert math.log2(a / b) > order - 0.5


def test_derivatives_keep_off_land(spark):
    df = cells(spark, GRID, f="case when ilat between 6 and 9 and ilon between 10 and 15 then 1e9 else 3 * lat end").withColumn("water", F.expr("not (ilat between 6 and 9 and ilon between 10 and 15)"))
    df = calculus.spherical_gradients(df, GRID, ["f"], KEYS, water="water").where("water")
    low, high, across = df.agg(F.min("dlat_f"), F.max("dlat_f"), F.max(F.abs("dlon_f"))).first()
    assert math.isclose(low, 3, rel_tol=1e-9) and math.isclose(high, 3, rel_tol=1e-9) and across < 1e-9


@pytest.mark.parametrize("kernel", sorted(KERNEL_PAD))
def test_constants_stay(spark, kernel):
    got = coarse.coarse_grain(cells(spark, GRID, f="100"), GRID, [1.5e6], ["f"], FilterConfig(kernel=kernel)).agg(F.min("f"), F.max("f")).first()
    assert all(math.isclose(x, 100, rel_tol=1e-9) for x in got)


@pytest.mark.parametrize("kernel", ["tophat", "gaussian", "smoothhat", "highorder"])
def test_filter_against_loops(spark, kernel):
    cfg = FilterConfig(kernel=kernel)
    df = cells(spark, GRID, f="sin(3 * lon) * cos(lat) + lat")
    values, areas = as_array(df, GRID, "f"), GRID.areas(cfg)
    want = np.zeros_like(values)
    total = np.zeros_like(values)
    ell = 3e6
    for _, i, j, lo, hi in coarse.windows(GRID, [ell], cfg):
        for off in range(lo, hi + 1):
            a, b = GRID.lats[i], GRID.lats[j]
            d = 0.0 if i == j and off == 0 else cfg.earth_radius * math.acos(max(-1, min(1, math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(off * GRID.dlon))))
            w = coarse.numpy_kernel(np.array(d / (ell / 2)), kernel) * areas[j]
            want[i] += w * np.roll(values[j], -off)
            total[i] += w
    want /= total
    for way in (coarse.coarse_grain, coarse.coarse_grain_pairs):
        assert np.allclose(as_array(way(df, GRID, [ell], ["f"], cfg), GRID, "f"), want, rtol=1e-9, atol=1e-9)


MESHES = {
    "sphere": (GRID, FilterConfig(), [1e6, 6e6]),
    "deformed": (GRID, FilterConfig(deform_around_land=True), [2e6]),
    "open": (GRID, FilterConfig(periodic_x=False, kernel="tophat"), [3e6]),
    "plane": (Grid.plane(15, 20, 1e3, 2e3), FilterConfig(cartesian=True, periodic_y=True, kernel="smoothhat"), [4e3, 9e3]),
    "open plane": (Grid.plane(15, 20, 1e3, 2e3), FilterConfig(cartesian=True, periodic_x=False, kernel="highorder"), [5e3]),
    "uneven": (Grid(tuple(math.radians(-80 + 8.0 * k + 0.08 * k * k) for k in range(18)), GRID.lons), FilterConfig(uniform_lat=False, order=2), [2e6]),
    "whole": (GRID, FilterConfig(kernel="sinc"), [5e6]),
    "zonal": (GRID, FilterConfig(zonal_kernel_only=True, kernel="hypergaussian"), [3e6]),
}


@pytest.mark.parametrize("mesh", sorted(MESHES))
def test_convolutions_agree_with_pairs(spark, mesh):
    """Units of rows against the equi-join: land, Favre weights, scale derivatives, several slices and fields, however the work is cut."""
    grid, cfg, scales = MESHES[mesh]
    rng = np.random.default_rng(4)
    rows = [(t, 0, i, j, *map(float, rng.normal(size=2)), float(1 + rng.random()), bool(rng.random() < 0.8)) for t in (0, 1) for i in range(grid.nlat) for j in range(grid.nlon)]
    df = spark.createDataFrame(rows, "itime int, idepth int, ilat int, ilon int, a double, b double, rho double, water boolean").withColumn("b", F.expr("case when water then b end"))
    for weight, derivatives in ((None, True), ("rho", False)):
        plain = coarse.coarse_grain_pairs(df, grid, scales, ["a", "b"], cfg, weight=weight, derivatives=derivatives, water="water")
        for small in (cfg, replace(cfg, unit_pairs=20_000), replace(cfg, unit_bytes=1)):
            got = coarse.coarse_grain(df, grid, scales, ["a", "b"], small, weight=weight, derivatives=derivatives, water="water")
            assert got.columns == plain.columns
            names = [c for c in plain.columns if c not in ("ell", *KEYS, "ilat", "ilon")]
            both = got.join(plain.select("ell", *KEYS, "ilat", "ilon", *[F.col(c).alias(f"x_{c}") for c in names]), ["ell", *KEYS, "ilat", "ilon"])
            found = both.agg(F.count("*"), *[F.max(F.abs(F.col(c) - F.col(f"x_{c}")) / (F.abs(F.col(f"x_{c}")) + 1e-6)) for c in names]).first()
            # Scale derivatives are some 1e-6 and 1e-12 in size.
            assert found[0] == len(scales) * len(rows) and all(x < (1e-3 if c.startswith("dl") else 1e-6) for x, c in zip(found[1:], names, strict=True)), (weight, found)


def test_units_cover_all_rows_once():
    for cfg in (CFG, FilterConfig(unit_pairs=100_000), FilterConfig(unit_pairs=10)):
        units = coarse.plan_units(GRID, [1e6, 5e6, 2e7], cfg, 8, 2)
        assert sorted((ell, i) for u in units for ell, lo, hi in u for i in range(lo, hi)) == sorted((ell, i) for ell in (1e6, 5e6, 2e7) for i in range(18))
        for u in units:
            rows = set(coarse.unit_rows(GRID, u, cfg).tolist())
            for ell, lo, hi in u:
                assert {j for _, i, j, *_ in coarse.windows(GRID, [ell], cfg) if lo <= i < hi} <= rows
    assert len(coarse.plan_units(GRID, [1e6, 5e6, 2e7], FilterConfig(unit_pairs=10), 8, 2)) > 18


def test_bands_agree_with_whole_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    grid = Grid.degrees(30, 24, -87.0, 6.0, -172.5, 15.0)
    rows = [(0, t, i, j, float(rng.normal()), bool(rng.random() < 0.85)) for t in (0, 1) for i in range(30) for j in range(24)]
    df = spark.createDataFrame(rows, "itime int, idepth int, ilat int, ilon int, a double, water boolean")
    wanted = [("x", "a", "ilon", 1), ("y", "a", "ilat", 1), ("yy", "y", "ilat", 1), ("d2", "a", "ilat", 2)]
    for periodic_y in (False, True):
        whole = calculus.derivatives(df, grid, wanted, KEYS, 4, True, periodic_y, "water")
        whole = whole.select(*KEYS, "ilat", "ilon", *[F.col(w[0]).alias(f"w_{w[0]}") for w in wanted]).cache()
        whole.count()
        monkeypatch.setattr(calculus, "BAND_BYTES", 1000)
        assert calculus._bands(grid, 10, 5, periodic_y)
        both = calculus.derivatives(df, grid, wanted, KEYS, 4, True, periodic_y, "water").join(whole, [*KEYS, "ilat", "ilon"])
        found = both.agg(F.count("*"), *[F.max(F.abs(F.col(w[0]) - F.col(f"w_{w[0]}"))) for w in wanted]).first()
        monkeypatch.undo()
        assert found[0] == len(rows) and max(found[1:]) < 1e-9


def test_slices_agree_with_lines(spark):
    """The pass over slices against window functions, with land and missing cells, for every order."""
    rng = np.random.default_rng(6)
    rows = [(0, 0, i, j, float(rng.normal()), bool(rng.random() < 0.8)) for i in range(18) for j in range(36) if rng.random() < 0.97]
    df = spark.createDataFrame(rows, "itime int, idepth int, ilat int, ilon int, a double, water boolean").cache()
    for order in (2, 3, 4, 6):
        for derivative in (1, 2):
            p = "d" if derivative == 1 else "d2"
            got = calculus.spherical_gradients(df, GRID, ["a"], KEYS, order, derivative, water="water").where("water")
            plain = calculus.differentiate(df, "ilon", 36, GRID.dlon, {"x": "a"}, [*KEYS, "ilat"], order, derivative, True, "water")
            plain = calculus.differentiate(plain, "ilat", 18, GRID.dlat, {"y": "a"}, [*KEYS, "ilon"], order, derivative, False, "water").select("ilat", "ilon", "x", "y")
            gap = got.join(plain, ["ilat", "ilon"]).agg(F.max(F.expr(f"abs({p}lon_a - x)")), F.max(F.expr(f"abs({p}lat_a - y)"))).first()
            assert max(gap) < 1e-6


def test_fine_mesh_fits_a_task():
    """A slice of a quarter degree at 1000 km: weights are made in pieces, planes stay far below a task's memory."""
    grid = Grid.degrees(720, 1440, -89.875, 0.25, -179.875, 0.25)
    units = coarse.plan_units(grid, [1e6], CFG, 8, 15)
    assert len(units) > 1
    rows = max(len(coarse.unit_rows(grid, u, CFG)) for u in units)
    planes = 16 * rows * 1440 * 8 * 3
    pieces = max(b - a for u in units for ell, lo, hi in u for a, b in coarse._chunks(grid, CFG, ell, lo, hi)) * coarse.lat_reach(grid, 1e6, CFG) * 2 * 1440 * 8 * 6
    assert planes + pieces < 2 << 30


def test_no_distance_join(spark):
    plan = coarse.coarse_grain_pairs(cells(spark, GRID, f="1"), GRID, [1e6], ["f"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "SortMergeJoin" in plan
    stencil = coarse.stencil(spark, GRID, [1e6], CFG)[0]
    assert stencil.count() == coarse.stencil(spark, GRID, [1e6], CFG)[1]


def test_kernel_derivatives_match_differences(spark):
    for kernel in KERNEL_PAD:
        if kernel == "tophat":
            continue
        cfg = FilterConfig(kernel=kernel)
        df = spark.range(1, 40).select((F.col("id") * 50.0).alias("d"))
        k1, k2 = kernels.kernel_derivatives("d", "1000.0D", cfg)
        h = 0.5
        rows = df.select(F.expr(k1).alias("k1"), F.expr(k2).alias("k2"), *[F.expr(kernels.kernel("d", f"{1000.0 + s * h}D", cfg)).alias(n) for s, n in ((-1, "a"), (0, "b"), (1, "c"))]).collect()
        for r in rows:
            assert math.isclose(r.k1, (r.c - r.a) / (2 * h), rel_tol=1e-3, abs_tol=1e-8)
            assert math.isclose(r.k2, (r.c - 2 * r.b + r.a) / h**2, rel_tol=2e-2, abs_tol=1e-8)


def test_velocity_round_trip(spark):
    df = cells(spark, GRID, r="0.3", a="sin(lon)", b="cos(lat)")
    df = GRID.located(df, CFG)
    parts = dict(zip("xyz", geometry.spherical_to_cartesian("r", "a", "b", "lon", "lat"), strict=True))
    df = df.select("*", *[F.expr(e).alias(f"u_{k}") for k, e in parts.items()])
    back = geometry.cartesian_to_spherical("u_x", "u_y", "u_z", "lon", "lat")
    gap = df.agg(*[F.max(F.abs(F.expr(f"{e} - {c}"))) for e, c in zip(back, "rab", strict=True)]).first()
    assert max(gap) < 1e-12


def test_solid_rotation_has_known_vorticity(spark):
    df = diagnostics.vorticity(cells(spark, GRID, u_lon="10 * cos(lat)", u_lat="0"), GRID)
    got = GRID.located(df, CFG).where("ilat between 4 and 13").agg(F.max(F.abs(F.expr(f"vort_r - 20 * sin(lat) / {CFG.earth_radius!r}"))), F.max(F.abs("div"))).first()
    assert got[0] < 1e-8 and got[1] < 1e-15


def test_transfer_of_one_scale_flow_is_small_and_forms_agree(spark):
    grid = Grid.degrees(24, 48, -86.25, 7.5, -176.25, 7.5)
    df = cells(spark, grid, u_lon="cos(lat) * sin(2 * lon)", u_lat="cos(lat) * cos(3 * lon)", u_r="0")
    df = diagnostics.with_cartesian(df, grid, CFG)
    bar = coarse.coarse_grain(df, grid, [2e6], ["u_x", "u_y", "u_z", *[f"u_{p}" for p in diagnostics.PAIRS]])
    both = diagnostics.transfers(bar, grid).join(diagnostics.transfers_shifted(bar, grid).select("ilat", "ilon", "Pi_shifted"), ["ilat", "ilon"]).where("ilat between 5 and 18")
    size, gap = both.agg(F.sqrt(F.avg(F.expr("Pi * Pi"))), F.sqrt(F.avg(F.expr("pow(Pi - Pi_shifted, 2)")))).first()
    assert size > 0 and gap < 0.25 * size


def test_projection_recovers_potentials(spark):
    grid = Grid.degrees(18, 36, -85.0, 10.0, -175.0, 10.0)
    r = CFG.earth_radius
    df = cells(spark, grid, p="1e6 * exp(-lat * lat * 4) * sin(2 * lon)", q="1e6 * exp(-lat * lat * 3) * cos(lon)")
    df = grid.located(calculus.spherical_gradients(df, grid, ["p", "q"], KEYS), CFG)
    df = df.select(*KEYS, "ilat", "ilon", F.expr(f"-dlat_p / {r}").alias("ut"), F.expr(f"dlon_p / ({r} * cos(lat))").alias("vt"), F.expr(f"dlon_q / ({r} * cos(lat))").alias("up"), F.expr(f"dlat_q / {r}").alias("vp"))
    df = df.select("*", F.expr("ut + up").alias("u"), F.expr("vt + vp").alias("v")).cache()
    got = solve.helmholtz(df, grid, how=solve.Projection(steps=800), u="u", v="v")
    both = df.join(got, [*KEYS, "ilat", "ilon"])
    rest = both.select("*", F.expr("u_lon_tor + u_lon_pot").alias("a"), F.expr("u_lat_tor + u_lat_pot").alias("b"))
    assert aggregate.error_norms(rest, grid, ("u", "v"), ("a", "b")).first().relative_l2 < 1e-3
    assert aggregate.error_norms(both, grid, ("ut", "vt"), ("u_lon_tor", "u_lat_tor")).first().relative_l2 < 0.05


def test_operator_and_transpose_agree():
    op = solve.Operator(GRID, CFG, 1e5, True)
    rng = np.random.default_rng(0)
    x = rng.normal(size=2 * 648)
    y = rng.normal(size=len(op.apply(x)))
    assert math.isclose(float(op.apply(x) @ y), float(x @ op.transpose(y)), rel_tol=1e-9)


@pytest.mark.parametrize("vector", [True, False])
def test_tensor_operator(spark, vector):
    op = solve.TensorOperator(GRID, CFG, vector, 0.3)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=3 * 648), rng.normal(size=6 * 648)
    assert math.isclose(float(op.apply(x) @ y), float(x @ op.transpose(y)), rel_tol=1e-9)
    df = cells(spark, GRID, uu="cos(lat) * cos(2 * lon)", uv="0.2 * sin(lat)", vv="cos(lat)")
    got = df.join(solve.decompose_tensor(df, GRID, vector=vector, steps=400), [*KEYS, "ilat", "ilon"]).agg(F.sqrt(F.avg(F.expr("pow(uu - uu_fit, 2) + pow(uv - uv_fit, 2) + pow(vv - vv_fit, 2)"))), F.sqrt(F.avg(F.expr("uu * uu + uv * uv + vv * vv")))).first()
    assert got[0] < (0.2 if vector else 0.8) * got[1]  # second derivatives converge slowly


@pytest.mark.parametrize("vector,damp", [(True, 0.0), (False, 0.0), (False, 0.3)])
def test_tensor_decomposition_is_the_least_squares_one(spark, vector, damp):
    grid = Grid.degrees(9, 12, -80.0, 20.0, -165.0, 30.0)
    rng = np.random.default_rng(2)
    data = rng.normal(size=(3, grid.nlat, grid.nlon))
    rows = [(0, 0, i, j, *map(float, data[:, i, j])) for i in range(grid.nlat) for j in range(grid.nlon)]
    df = spark.createDataFrame(rows, "itime int, idepth int, ilat int, ilon int, uu double, uv double, vv double")
    out = solve.decompose_tensor(df, grid, vector=vector, damp=damp)
    got = np.stack([as_array(out, grid, c) for c in ("uu_fit", "uv_fit", "vv_fit")]).reshape(-1)
    op = solve.TensorOperator(grid, CFG, vector, damp)
    dense = np.stack([op.apply(e) for e in np.eye(3 * grid.nlat * grid.nlon)], axis=1)
    rhs = np.concatenate([data.reshape(-1), np.zeros(len(dense) - data.size)])
    want = (dense @ np.linalg.lstsq(dense, rhs, rcond=1e-13)[0])[: data.size]
    assert np.linalg.norm(got - want) < 1e-6 * np.linalg.norm(data)


def test_sharp_filter_keeps_long_waves(spark):
    grid = Grid.plane(16, 32, 1e3, 1e3)
    df = densify(spark.createDataFrame([], "ilat int, ilon int"), grid, []).select(F.lit(0).alias("itime"), F.lit(0).alias("idepth"), "ilat", "ilon", F.expr("cos(2 * pi() * ilon / 32)").alias("a"), F.expr("cos(2 * pi() * 8 * ilon / 32)").alias("b"))
    got = solve.sharp_filter(df, grid, [8e3], ["a", "b"]).join(df.select("ilat", "ilon", F.col("a").alias("a0")), ["ilat", "ilon"]).agg(F.max(F.expr("abs(a - a0)")), F.max(F.abs("b"))).first()
    assert max(got) < 1e-12


def test_filled_land_is_smooth(spark):
    df = cells(spark, GRID, f="case when ilat between 8 and 9 and ilon between 15 and 17 then null else 2 + lat end")
    for near in (None, 3):
        got = solve.fill_land(df, GRID, ["f"], near_coast=near).where("ilat between 8 and 9 and ilon between 15 and 17").agg(F.min("f"), F.max("f")).first()
        assert 1.5 < got[0] <= got[1] < 2.5


def test_bases_meet_known_values():
    rng = np.random.default_rng(7)
    known, asked = rng.uniform(0, 10, (300, 2)), rng.uniform(2, 8, (40, 2))
    field = lambda x: np.sin(x[:, 0]) + 0.5 * np.cos(0.7 * x[:, 1])
    assert np.abs(solve.layered_bases(known, field(known), known, 5.0, 4) - field(known)).max() < 1e-3
    assert np.abs(solve.layered_bases(known, field(known), asked, 5.0, 4) - field(asked)).max() < 0.1


def test_poles_have_no_velocity(spark):
    polar = Grid.degrees(19, 36, -90.0, 10.0, -175.0, 10.0)
    df = cells(spark, polar, psi="sin(lat) * cos(lon)")
    got = potentials.toroidal_velocity(df, polar).where("ilat in (0, 18)").agg(F.max(F.abs("u_lon_tor")), F.max(F.abs("u_lat_tor"))).first()
    assert max(got) == 0


@pytest.mark.parametrize("land", [False, True])
def test_operator_with_land_and_its_transpose(land):
    wet = None
    if land:
        wet = np.random.default_rng(3).random((18, 36)) < 0.8
    op = solve.Operator(GRID, CFG, 1e5, True, wet)
    rng = np.random.default_rng(0)
    x = rng.normal(size=2 * 648)
    y = rng.normal(size=len(op.apply(x)))
    assert math.isclose(float(op.apply(x) @ y), float(x @ op.transpose(y)), rel_tol=1e-9)
    if land:
        assert all(np.abs(w[~wet]).max() == 0 for w in op.velocity(*x.reshape(2, 18, 36)))


def test_coast_against_steps(spark):
    rng = np.random.default_rng(8)
    wet = rng.random((12, 16)) < 0.9
    grid = Grid.degrees(12, 16, -55.0, 10.0, -170.0, 22.5)
    df = spark.createDataFrame([(0, 0, i, j, bool(wet[i, j])) for i in range(12) for j in range(16)], "itime int, idepth int, ilat int, ilon int, water boolean")
    land = np.argwhere(~wet)
    for reach in (1, 3):
        want = {(i, j) for i in range(12) for j in range(16) if wet[i, j] and min(abs(i - a) + min(abs(j - b), 16 - abs(j - b)) for a, b in land) <= reach}
        assert {(r.ilat, r.ilon) for r in reshape.coast(df, grid, reach).collect()} == want
    assert reshape.coast(df.withColumn("water", F.lit(True)), grid, 3).count() == 0


def velocity_table(spark, grid, **fields):
    """(itime, ilat, ilon, u, v) at two times."""
    df = cells(spark, grid, **fields).select("ilat", "ilon", "u", "v")
    return df.withColumn("itime", F.lit(0)).unionByName(df.withColumn("itime", F.lit(1)))


def test_particles_go_round_and_back(spark):
    flow = velocity_table(spark, GRID, u="10 * cos(lat)", v="0")
    starts = particles.seed_positions(spark, 5, GRID, seed=3)
    times, outputs, how = [0.0, 1e6], [0.0, 5e5, 1e6], particles.Advection(cfl=0.05)
    there = particles.advect(starts, flow, times, outputs, GRID, how=how)
    last = there.where("iout = 2").select("traj", "lon", "lat")
    back = particles.advect(last, flow, times, outputs, GRID, how=how, backwards=True)
    assert particles.fore_back_distance(there, back).agg(F.max("dist")).first()[0] < 1e3
    lon0 = {r.traj: r.lon for r in starts.collect()}
    for r in last.collect():
        turned = (r.lon - lon0[r.traj]) % (2 * math.pi)
        assert math.isclose(turned, 10 * 1e6 / CFG.earth_radius, rel_tol=2e-2)


def test_particles_cross_tiles(spark):
    """Paths by tiles of the mesh, whose particles move on between them, are those of whole slices; some leave the mesh, some start anew."""
    flow = velocity_table(spark, GRID, u="8 * cos(lat) + 2 * sin(3 * lon)", v="12 * cos(2 * lon)")
    starts = particles.seed_positions(spark, 30, GRID)
    times, outputs = [0.0, 6e5], [0.0, 2e5, 4e5, 6e5]
    for life in (None, 2.5e5):
        whole = particles.Advection(cfl=0.1, lifespan=life)
        a, b = (particles.advect(starts, flow, times, outputs, GRID, how=how) for how in (whole, replace(whole, most=0, tile=5, margin=2)))
        both = a.join(b.withColumnsRenamed({"lon": "x", "lat": "y"}), ["traj", "iout"])
        got = both.agg(F.count("*"), F.max(F.expr("abs(lon - x) + abs(lat - y)")), F.sum(F.expr("cast((lon is null) != (x is null) as int)"))).first()
        assert got[0] == 120 and got[1] < 1e-9 and got[2] == 0


def test_particles_keep_to_small_steps(spark):
    """A first-order path comes nearer to the true one with the step; solid rotation about another axis as the truth."""
    tilt = 0.5
    flow = velocity_table(spark, Grid.degrees(90, 180, -89.0, 2.0, -179.0, 2.0), u=f"20 * (cos({tilt}) * cos(lat) + sin({tilt}) * sin(lat) * cos(lon))", v=f"-20 * sin({tilt}) * sin(lon)")
    grid = Grid.degrees(90, 180, -89.0, 2.0, -179.0, 2.0)
    starts = spark.createDataFrame([(0, 0.3, 0.2), (1, -1.0, -0.4)], "traj int, lon double, lat double")
    span = 4e5
    turn = 20 * span / CFG.earth_radius
    axis = np.array([-math.sin(tilt), 0.0, math.cos(tilt)])
    errors = []
    for cfl in (0.2, 0.02):
        got = {r.traj: r for r in particles.advect(starts, flow, [0.0, span], [0.0, span], grid, how=particles.Advection(cfl=cfl)).where("iout = 1").collect()}
        worst = 0.0
        for r in starts.collect():
            x = np.array([math.cos(r.lat) * math.cos(r.lon), math.cos(r.lat) * math.sin(r.lon), math.sin(r.lat)])
            x = x * math.cos(turn) + np.cross(axis, x) * math.sin(turn) + axis * (axis @ x) * (1 - math.cos(turn))
            g = got[r.traj]
            y = np.array([math.cos(g.lat) * math.cos(g.lon), math.cos(g.lat) * math.sin(g.lon), math.sin(g.lat)])
            worst = max(worst, float(np.linalg.norm(x - y)))
        errors.append(worst)
    assert errors[1] < 0.3 * errors[0] and errors[1] < 2e-3


def test_seeds_need_water(spark):
    dry = spark.createDataFrame([(i, j, False) for i in range(18) for j in range(36)], "ilat int, ilon int, water boolean")
    with pytest.raises(ValueError):
        particles.seed_positions(spark, 3, GRID, dry)


def test_two_layers_at_rest_do_nothing(spark):
    cfg = FilterConfig(cartesian=True, periodic_y=True)
    grid = Grid.plane(12, 12, 1e4, 1e4)
    df = densify(spark.createDataFrame([(0, k) for k in (0, 1)], "itime int, idepth int").crossJoin(spark.createDataFrame([(0, 0)], "ilat int, ilon int")), grid, ["itime", "idepth"]).select("itime", "idepth", "ilat", "ilon", F.lit(0.0).alias("u"), F.lit(0.0).alias("v"), F.lit(100.0).alias("h"))
    got = shallow_water.two_layers(df, grid, [3e4], cfg)
    terms = [c for c in got.columns if c not in ("ell", "itime", "idepth", "ilat", "ilon", "PE")]
    assert max(abs(x) for x in got.agg(*[F.max(F.abs(c)) for c in terms]).first()) < 1e-9
    assert got.count() == 2 * 144


def test_region_means_of_a_constant(spark):
    regions = aggregate.region_table(GRID, spark, geometry.REGIONS)
    rows = aggregate.region_mean_std(cells(spark, GRID, f="7"), regions, GRID, ["f"]).collect()
    assert {r.region for r in rows} == set(geometry.REGIONS)
    assert all(math.isclose(r.f_area_average, 7, rel_tol=1e-12) and r.f_area_std_dev < 1e-9 for r in rows)


def test_subset_means_take_all_groups(spark):
    df = spark.createDataFrame([(t, 0, float(2**t)) for t in range(7)], "itime int, idepth int, u double")
    got = {r.subset: r.u for r in aggregate.subset_means(df, "itime", None, 3, ["u"], ["idepth"]).collect()}
    assert got == {k: sum(2.0**t for t in own) / 3 for k, own in enumerate(combinations(range(7), 3))} and len(got) == 35


def test_median_is_the_upper_one(spark):
    df = spark.createDataFrame([(0, 0, 0, k, float(v)) for k, v in enumerate([1, 2, 3, 4])] + [(0, 0, 1, 0, None)], "itime int, idepth int, ilat int, ilon int, f double")
    assert {r.ilat: r.f_zonal_median for r in aggregate.zonal_median(df, ["f"], water="f is not null").collect()} == {0: 3.0, 1: None}


def test_okubo_weiss_bins_follow_their_bounds(spark):
    edges = aggregate.okubo_weiss_edges()
    values = [0.0, 1e-12, -1e-12, 3e-9, -3e-9, 1e30, -1e30, 1e-40, -1e-40]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", aggregate.okubo_weiss_bin(F.col("v")))
    for r in df.collect():
        assert r.b == min(600, sum(e < r.v for e in edges))


def test_refine_is_exact_for_planes(spark):
    fine = Grid.degrees(20, 30, -89.0, 9.0, -179.0, 12.0)
    df = cells(spark, GRID, f="2 * lat - lon + 1")
    got = fine.located(reshape.refine_bilinear(df, GRID, fine, ["f"]), CFG).agg(F.max(F.abs(F.expr("f - (2 * lat - lon + 1)")))).first()[0]
    assert got < 1e-9


def test_poles_are_padded(spark):
    short = Grid.degrees(14, 36, -65.0, 10.0, -175.0, 10.0)
    df, wide = reshape.extend_to_poles(cells(spark, short, f="1"), short, ["f"])
    assert wide.nlat == 18 and math.isclose(math.degrees(wide.lats[0]), -85)
    assert df.agg(F.sum("f"), F.count("*")).first() == (14 * 36, 18 * 36)
