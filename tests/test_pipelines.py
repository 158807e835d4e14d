"""Whole analyses, sources and sinks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.functions import quadrature
from tesseral.grid import Grid, densify
from tesseral.operators import solve
from tesseral.plans import pipelines
from tesseral.sources import netcdf, tables
from tesseral.streaming import running
from tesseral.streaming.running import running_time_mean

GRID = Grid.degrees(12, 24, -82.5, 15.0, -172.5, 15.0)
CFG = FilterConfig()


def fields(spark, **columns):
    mesh = densify(spark.createDataFrame([], "ilat int, ilon int"), GRID, []).select(F.lit(0).alias("itime"), F.lit(0).alias("idepth"), "ilat", "ilon")
    return GRID.located(mesh, CFG).select(*mesh.columns, *[F.expr(e).cast("double").alias(n) for n, e in columns.items()])


def test_arguments():
    assert pipelines.scale_list(" 1e5 2e5") == [1e5, 2e5] and pipelines.truth("Yes") and not pipelines.truth("0")
    with pytest.raises(ValueError):
        pipelines.truth("maybe")
    with pytest.raises(ValueError):
        pipelines.scale_list("-1")


def test_velocities(spark):
    df = pipelines.coarse_grain_velocity(fields(spark, u_lon="10 * cos(lat)", u_lat="0"), GRID, [1e6], CFG)
    assert df.count() == 288
    names = {"coarse_u_lon", "coarse_u_lat", "coarse_KE", "fine_KE", "vort_r", "div", "okubo_weiss", "Pi", "Z", "div_transport"}
    assert names <= set(df.columns)
    got = df.agg(F.min("fine_KE"), F.max(F.abs("coarse_u_lat")), F.max("coarse_KE")).first()
    assert got[0] > -1e-6 and got[1] < 1e-9 and got[2] < 0.5 * 1025 * 100


def test_scalars_and_conversion(spark):
    df = pipelines.coarse_grain_scalars(fields(spark, rho="1025 + lat", w="0.1"), GRID, [2e6], ["rho", "w"], CFG, ("rho", "w"))
    got = df.agg(F.max(F.abs(F.expr("barrho_barw - rho * 0.1"))), F.max(F.abs("dl_w"))).first()
    assert max(got) < 1e-9


def test_helmholtz_route(spark):
    df = pipelines.coarse_grain_helmholtz(fields(spark, psi="1e6 * sin(lat)", phi="0"), GRID, [1e6], CFG)
    assert {"Pi_tor", "Pi_pot", "Pi_tot", "spectrum_tor", "slope_tot", "coarse_KE_tot", "vort_r_tor"} <= set(df.columns)
    got = df.agg(F.count("*"), F.max(F.abs(F.expr("u_lon_tot - u_lon_tor"))), F.max(F.abs("u_lat_pot"))).first()
    assert got[0] == 288 and got[1] == 0 and got[2] == 0


def test_scale_integral(spark):
    df = pipelines.scale_integral_energies(fields(spark, psi="1e6 * sin(lat) * cos(lon)", phi="0"), GRID, 3e6, [(1e6, 0.5, 0.4), (2e6, 0.5, 0.6)], CFG)
    assert df.count() == 288 and df.agg(F.min("cyclonic") / F.max("cyclonic")).first()[0] > -1e-9


def test_seeded_projection_agrees(spark):
    df = fields(spark, u_lon="cos(lat) * (1 + 0.2 * sin(2 * lon))", u_lat="0.3 * cos(lon) * cos(lat)")
    how = solve.Projection(steps=600)
    half = Grid.degrees(6, 12, -75.0, 30.0, -165.0, 30.0)
    a, b = solve.helmholtz(df, GRID, CFG, how), pipelines.multigrid_projection(df, GRID, half, CFG, how)
    gap = a.join(b.withColumnsRenamed({"u_lon_tor": "x"}), ["itime", "idepth", "ilat", "ilon"]).agg(F.max(F.abs(a.u_lon_tor - F.col("x")))).first()[0]
    assert gap < 1e-2


def test_johnson_rules_agree(spark):
    got = pipelines.johnson_decomposition(fields(spark, psi="1e6 * sin(lat) * cos(lon)", phi="0"), GRID, 3e6, 2, CFG)
    assert got.count() == 288 and got.where("cyclonic_error is null").count() == 0


def test_quadrature_is_exact():
    for n in (2, 5, 8):
        nodes, weights, coarse = quadrature.kronrod(n)
        moment = lambda d: 2 / (d + 1) if d % 2 == 0 else 2 / (d + 2)
        assert all(abs((weights * nodes**d).sum() - moment(d)) < 1e-12 for d in range(3 * n + 2))
        assert all(abs((coarse * nodes**d).sum() - moment(d)) < 1e-12 for d in range(2 * n))
    assert math.isclose(sum(2 * w * 3.0 / 2 * x for x, w, _ in quadrature.scale_nodes(3.0, 4)), 2 * 3.0**3 / 3, rel_tol=1e-12)


def write_input(spark, path, cells, grid=GRID, **axes):
    for name, axis in {"lat": [math.degrees(x) for x in grid.lats], "lon": [math.degrees(x) for x in grid.lons], **axes}.items():
        spark.createDataFrame([(i, float(x)) for i, x in enumerate(axis)], f"i{name} int, {name} double").write.parquet(f"{path}/{name}")
    cells.write.parquet(f"{path}/fields")


def test_command_line(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    write_input(spark, source, fields(spark, rho="1025 + lat"), coarse_lat=[-90.0, 0.0], coarse_lon=[-180.0, 0.0])
    pipelines.main(["coarse_grain_scalars", "--input", source, "--output", target, "--filter_scales", "1e6 2e6", "--variables", "rho", "--time_averages", "1"])
    assert spark.read.parquet(f"{target}/full").count() == 2 * 288
    assert {r.region for r in spark.read.parquet(f"{target}/regions").collect()} == {"full_domain"}
    assert tables.read_attribute(spark, f"{target}/full", "kernel") == "gaussian"
    assert math.isclose(tables.read_attribute(spark, f"{target}/regions", "kernel_alpha"), 0.25, rel_tol=1e-3)
    assert spark.read.parquet(f"{target}/zonal").count() == 2 * 12 and spark.read.parquet(f"{target}/maps").count() == 2 * 4
    assert spark.read.parquet(f"{target}/time").count() == 2 * 288
    with pytest.raises(FileNotFoundError):
        pipelines.main(["coarse_grain", "--input", f"{tmp_path}/none", "--output", target])


def test_every_analysis_runs(spark, tmp_path):
    """Every program of the command line on one small mesh, by way of files alone."""
    source = f"{tmp_path}/in"
    columns = {"u_lon": "cos(lat)", "u_lat": "0.1 * cos(lon) * cos(lat)", "ssh": "0.2 * sin(lat) * sin(lon)", "psi": "1e6 * sin(lat)", "phi": "1e5 * cos(lat) * cos(lon)", "uu": "1 + cos(lat)", "uv": "0.1 * sin(lon)", "vv": "cos(lat)", "tau_lon": "0.1", "tau_lat": "0", "u_r": "0.01 * sin(lat)", "h": "100 + 10 * cos(lat)"}
    columns |= {f"u_{x}_{k}": e for k, e in (("tor", "cos(lat)"), ("pot", "0.1 * sin(lon)")) for x in ("lon", "lat")}
    one = fields(spark, **columns)
    cells = one.unionByName(one.withColumn("idepth", F.lit(1)))
    cells = cells.unionByName(cells.withColumn("itime", F.lit(1))).cache()
    write_input(spark, source, cells, depth=[0.0, 100.0], time=[0.0, 1e5])
    half = Grid.degrees(6, 12, -75.0, 30.0, -165.0, 30.0)
    write_input(spark, f"{tmp_path}/half", cells.limit(0), half)

    def run(name: str, *more: str, at: str = source) -> str:
        out = f"{tmp_path}/{name}-{len(more)}"
        pipelines.main([name, "--input", at, "--output", out, "--filter_scales", "3e6", *more])
        return out

    full = spark.read.parquet(run("coarse_grain", "--okubo_weiss", "1") + "/full")
    assert full.count() == 4 * 288 and {"Pi", "Z", "div_transport", "fine_KE"} <= set(full.columns)
    assert spark.read.parquet(f"{tmp_path}/coarse_grain-2/okubo_weiss").count() > 0
    got = spark.read.parquet(run("coarse_grain_helmholtz", "--full_outputs", "0") + "/regions")
    assert {"wind_forcing_area_average", "Pi_tot_area_average", "enstrophy_tor_area_average", "u_r_area_average"} <= set(got.columns)
    assert spark.read.parquet(f"{tmp_path}/coarse_grain_helmholtz-2/full").count() == 0
    assert {"Pi", "fine_KE"} <= set(spark.read.parquet(run("coarse_grain_fftw", "--cartesian", "1", "--periodic_y", "1") + "/full").columns)
    assert spark.read.parquet(run("coarse_grain_sw", "--cartesian", "1", "--periodic_y", "1") + "/full").count() == 4 * 288
    assert spark.read.parquet(run("Pi_helm_breakdown") + "/full").count() == 6 * 4 * 288
    projected = run("Helmholtz_projection", "--use_mask", "1", "--tolerance", "1e-8")
    assert spark.read.parquet(f"{projected}/projection").count() == 4 * 288
    for name in ("toroidal_projection", "potential_projection", "Helmholtz_projection_uiuj", "Helmholtz_projection_SymTensor"):
        assert spark.read.parquet(run(name, "--tolerance", "1e-6") + "/projection").count() == 4 * 288
    coarsened = run("coarsen_grid_linear", "--other_grid", f"{tmp_path}/half", "--variables", "psi phi")
    assert spark.read.parquet(f"{coarsened}/fields").count() == 4 * 72
    for name, axis in (("lat", half.lats), ("lon", half.lons)):
        spark.createDataFrame([(i, math.degrees(x)) for i, x in enumerate(axis)], f"i{name} int, {name} double").write.parquet(f"{coarsened}/{name}")
    refined = run("refine_Helmholtz_seed", "--other_grid", source, "--variables", "psi phi", at=coarsened)
    seed = spark.read.parquet(f"{refined}/seed")
    assert seed.count() == 4 * 288 and {"psi0", "phi0"} <= set(seed.columns)
    seed.write.parquet(f"{source}/seed")
    assert spark.read.parquet(run("Helmholtz_projection") + "/projection").count() == 4 * 288
    assert "u_r" in spark.read.parquet(run("compute_radial_velocity") + "/fields").columns
    assert spark.read.parquet(run("geostrophic_vel") + "/fields").count() == 4 * 288
    assert spark.read.parquet(run("interpolator", "--variables", "ssh") + "/fields").count() == 4 * 288
    moved = run("particles", "--particles", "5", "--cfl", "0.1", "--output_frequency", "5e4", "--backwards", "1", "--variables", "ssh")
    tracks = spark.read.parquet(f"{moved}/particles")
    assert tracks.count() == 15 and {"fore_back_dists", "rev_longitude", "ssh"} <= set(tracks.columns)
    tracks.drop("ssh").write.parquet(f"{source}/particles")
    onto = run("project_onto_particles", "--variables", "ssh psi", "--output_frequency", "5e4")
    assert "ddt_ssh" in spark.read.parquet(f"{onto}/projected").columns and spark.read.parquet(f"{onto}/correlations").count() == 5
    assert spark.read.parquet(run("compare_particles", "--other", moved) + "/distances").agg(F.max("dist")).first()[0] < 1e-3
    assert spark.read.parquet(run("Johnson_decomp", "--integration_steps", "2") + "/johnson_3e+06").count() == 4 * 288
    assert spark.read.parquet(run("vonStorch") + "/conversion").count() == 2 * 288
    assert spark.read.parquet(run("vonStorch", "--subset", "1") + "/conversion").count() == 2 * 2 * 288


@pytest.mark.parametrize("version", [1, 2, 5])
def test_classic_netcdf(spark, tmp_path, version):
    """Packed, filled and plain variables, axes in another order, attributes; a cut-off or foreign file."""
    rng = np.random.default_rng(version)
    u = rng.normal(size=(2, 3, 4, 5)).astype("f4")
    u[0, 1, 2, 3] = -1e10
    packed = np.array([[[1, 2, -9], [3, 4, 5]]], "i2").reshape(1, 2, 3)
    axes = {"time": 2, "depth": 3, "latitude": 4, "longitude": 5, "x": 3, "y": 2, "one": 1}
    variables = {
        "time": (("time",), np.array([0.0, 10.0]), {"units": "s"}),
        "latitude": (("latitude",), np.linspace(-45, 45, 4), {}),
        "longitude": (("longitude",), np.linspace(-180, 108, 5).astype("f4"), {}),
        "uo": (("time", "depth", "latitude", "longitude"), u, {"_FillValue": np.float32(-1e10)}),
        "t": (("one", "y", "x"), packed, {"_FillValue": np.int16(-9), "scale_factor": 0.5, "add_offset": 10.0}),
        "turned": (("longitude", "latitude"), np.arange(20.0).reshape(5, 4), {}),
    }
    data = netcdf.encode(axes, variables, {"title": "a test"}, version)
    (tmp_path / "a.nc").write_bytes(data)
    ds = netcdf.parse(data)
    assert ds.attributes["title"] == "a test" and ds.variables["time"].attributes["units"] == "s"
    assert np.array_equal(ds.decoded("t").reshape(-1), [10.5, 11, np.nan, 11.5, 12, 12.5], equal_nan=True)
    got = netcdf.read_cells(spark, str(tmp_path / "a.nc"), {"u_lon": "uo"}).collect()
    assert len(got) == 120 and sum(r.u_lon is None for r in got) == 1
    assert all(r.u_lon is None or math.isclose(r.u_lon, float(u[r.itime, r.idepth, r.ilat, r.ilon])) for r in got) and {r.time for r in got} == {0.0, 10.0}
    turned = netcdf.read_cells(spark, str(tmp_path / "a.nc"), {"x": "turned"}).collect()
    assert len(turned) == 20 and all(r.x == 4 * r.ilon + r.ilat for r in turned)
    assert netcdf.read_axes(spark, str(tmp_path / "a.nc"))["latitude"] == [-45.0, -15.0, 15.0, 45.0]
    for bad in (b"\x89HDF\r\n", b"CDF\x03" + data[4:]):
        with pytest.raises(ValueError):
            netcdf.parse(bad)


def test_netcdf_records():
    """Records of an unlimited dimension are interleaved, padded unless there is one variable alone."""
    head = netcdf.encode({"time": 3, "x": 3}, {"a": (("time", "x"), np.arange(9, dtype="i2").reshape(3, 3), {})}, version=1)
    at = head.index(b"time") + 4
    unlimited = head[:4] + (3).to_bytes(4, "big") + head[8:at] + (0).to_bytes(4, "big") + head[at + 4 :]
    assert netcdf.parse(unlimited).values("a").tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]


def test_variables_and_masks(spark, tmp_path):
    path = f"{tmp_path}/v"
    spark.createDataFrame([(0, 0, 0, k, v) for k, v in enumerate([1, -999, 3, None])], "itime int, idepth int, ilat int, ilon int, t int").write.parquet(path)
    got = [r.temp for r in tables.read_variable(spark, path, "t", "temp", -999, 0.5, 10.0).orderBy("ilon").collect()]
    assert got == [10.5, None, 11.5, None]
    assert [r.temp for r in tables.read_variable(spark, path, "t", "temp", -999, land=0.0).orderBy("ilon").collect()] == [1.0, 0.0, 3.0, 0.0]
    assert [r.water for r in tables.read_mask(spark, path, "t", -999).orderBy("ilon").collect()] == [True, False, True, False]
    assert tables.exists(spark, path) and not tables.exists(spark, f"{path}x")
    assert tables.default_column(spark.range(1), "u_r").first().u_r == 0.0
    assert tables.read_depth_direction([0.0, 10.0]) and not tables.read_depth_direction([10.0, 0.0])


def test_running_mean(spark, tmp_path):
    source = f"{tmp_path}/s"
    for k in range(3):
        fields(spark, f=str(k)).where("ilat = 0").write.mode("append").parquet(source)
    stream = running_time_mean(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), ["f"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.f_time_average, r.n) for r in spark.sql("select * from running").collect()} == {(1.0, 3)}


def test_stream_of_slices(spark, tmp_path):
    """Slices that arrive file by file give what they give together."""
    source = f"{tmp_path}/s"
    whole = fields(spark, rho="1025 + lat * cos(lon)").crossJoin(spark.createDataFrame([(t, t) for t in range(3)], "t int, u int")).withColumn("itime", F.col("t")).drop("t", "u")
    for t in range(3):
        whole.where(F.col("itime") == t).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(source)
    running.analysed(stream, lambda df: pipelines.coarse_grain_scalars(df, GRID, [2e6], ["rho"], CFG), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("batch").distinct().count() == 3
    plain = pipelines.coarse_grain_scalars(whole, GRID, [2e6], ["rho"], CFG).select("itime", "ilat", "ilon", F.col("rho").alias("x"))
    both = got.join(plain, ["itime", "ilat", "ilon"]).agg(F.count("*"), F.max(F.expr("abs(rho - x)"))).first()
    assert both[0] == 3 * 288 and both[1] < 1e-9


def test_windows_of_a_stream(spark, tmp_path):
    source = f"{tmp_path}/s"
    for day, value in ((1, 1.0), (1, 3.0), (3, 5.0)):
        spark.createDataFrame([(0, 0, 0, value, f"2020-01-0{day} 06:00:00")], "idepth int, ilat int, ilon int, f double, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    means = running.windowed_time_mean(stream, ["f"], "at", "1 day", "1 hour")
    q = means.writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.start.day, r.f_time_average, r.n) for r in spark.sql("select * from windows").collect()} == {(1, 2.0, 2), (3, 5.0, 1)}
