"""Lagrangian particles: seeding, advection, projection of fields onto trajectories.

A particle's path is sequential, particles are independent. Velocities are a table; the
paths go from one of its times to the next, and only the two slices around an interval
are at hand. As long as these are small, a size that the axes tell, they are broadcast
and particles dealt out over tasks. Beyond that the mesh is cut into tiles: a tile's
particles meet its cells, with a margin, in a cogroup, and go on until they leave the
margin; rounds are repeated until all have reached the end of the interval. Within a
task all particles step at once. Fields are joined to given trajectories by bracketing
times and cells, as equi-joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.functions import geometry
from tesseral.grid import Grid
from tesseral.sources.store import stored


@dataclass(frozen=True)
class Advection:
    """cfl: share of a cell per step; first: speed that the first step assumes; lifespan: a particle starts anew whenever it has lived that long (None: never).
    most: bytes of velocity that are broadcast; tile: rows and columns of a tile beyond that; margin: cells around it."""

    cfl: float = 1e-5
    first: float = 2.0
    lifespan: float | None = None
    fastest: float = 100.0
    most: int = 256 << 20
    tile: int = 512
    margin: int = 8


#: Steps of the quasi-random sequence in two dimensions.
_STEPS = 0.7548776662466927, 0.5698402909980532


def seed_positions(spark: SparkSession, n: int, grid: Grid, water: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(traj, lon, lat): starts spread evenly over the longitudes and the inner nine tenths of latitudes, the first n of a quasi-random sequence whose four surrounding cells are water(ilat, ilon, water). Reruns agree. Without enough water ValueError."""
    lon0, lon1, lat0, lat1 = grid.lons[0], grid.lons[-1], grid.lats[0], grid.lats[-1]
    at = F.col("id") + 1 + 7919 * seed
    part = lambda step: at * F.lit(step) - F.floor(at * F.lit(step))
    asked = 4 * n + 64
    while True:
        df = spark.range(asked).select("id", (F.lit(lon0) + part(_STEPS[0]) * F.lit(lon1 - lon0)).alias("lon"), (F.lit((lat0 + lat1) / 2) + (part(_STEPS[1]) - 0.5) * F.lit(0.9 * (lat1 - lat0))).alias("lat"))
        if water is not None:
            i, j = (F.floor((F.col(c) - F.lit(axis[0])) / F.lit(step)).cast("int") for c, axis, step in (("lat", grid.lats, grid.dlat), ("lon", grid.lons, grid.dlon)))
            corners = F.array(*[F.struct((i + a).alias("ilat"), F.pmod(j + b, F.lit(grid.nlon)).cast("int").alias("ilon")) for a in (0, 1) for b in (0, 1)])
            met = df.select("*", F.explode(corners).alias("c")).select("id", "lon", "lat", "c.*").join(water.select("ilat", "ilon", "water"), ["ilat", "ilon"])
            df = met.groupBy("id", "lon", "lat").agg(F.sum(F.col("water").cast("int")).alias("wet")).where("wet = 4").drop("wet")
        rows = df.orderBy("id").limit(n).collect()
        if len(rows) == n:
            return spark.createDataFrame([(k, r.lon, r.lat) for k, r in enumerate(rows)], "traj int, lon double, lat double")
        if asked > 1000 * n + 100_000:
            raise ValueError(f"water for {len(rows)} of {n} particles only")
        asked *= 4


class _Velocity:
    """u and v on a window of the mesh at two times; rows and columns are counted from `row` and `column`, land is 0."""

    def __init__(self, grid: Grid, u: np.ndarray, v: np.ndarray, row: int = 0, column: int = 0, wraps: bool = True):
        self.grid, self.u, self.v, self.row, self.column, self.wraps = grid, u, v, row, column, wraps

    def places(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        y, x = (lat - self.grid.lats[0]) / self.grid.dlat, (lon - self.grid.lons[0]) / self.grid.dlon
        i, j = np.floor(y).astype(int), np.floor(x).astype(int)
        return i, j, y - i, x - j

    def known(self, lon: np.ndarray, lat: np.ndarray, periodic: bool) -> tuple[np.ndarray, np.ndarray]:
        """Whether a place is on the mesh, and whether this window has its four cells and those of a step beside it."""
        i, j, _, _ = self.places(lon, lat)
        on = (i >= 0) & (i < self.grid.nlat - 1) & (periodic | ((j >= 0) & (j < self.grid.nlon - 1)))
        rows, columns = self.u.shape[1:]
        here = (i >= self.row) & (i + 1 < self.row + rows)
        if not self.wraps:
            k = (j - self.column) % self.grid.nlon if periodic else j - self.column
            # One column to spare on either side: the second velocity is read after the longitude has moved.
            here &= (k >= 1) & (k + 2 < columns)
        return on, here

    def at(self, field: np.ndarray, lon: np.ndarray, lat: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Bilinear in space, linear in time."""
        i, j, a, b = self.places(lon, lat)
        i0, columns = i - self.row, field.shape[2]
        j0 = (j - self.column) % self.grid.nlon
        j1 = (j0 + 1) % columns if self.wraps else j0 + 1
        i0, j0, j1 = (np.clip(x, 0, top) for x, top in ((i0, field.shape[1] - 2), (j0, columns - 1), (j1, columns - 1)))

        def when(f: np.ndarray) -> np.ndarray:
            return (1 - a) * ((1 - b) * f[i0, j0] + b * f[i0, j1]) + a * ((1 - b) * f[i0 + 1, j0] + b * f[i0 + 1, j1])

        return (1 - w) * when(field[0]) + w * when(field[1])


#: A particle under way: its next output is number iout of the outputs.
_STATE = ["traj", "lon", "lat", "t", "vu", "vv", "lives", "home_lon", "home_lat", "iout", "alive"]
_STATE_DDL = "traj int, lon double, lat double, t double, vu double, vv double, lives int, home_lon double, home_lat double, iout int, alive boolean"


def _advance(p: dict[str, np.ndarray], field: _Velocity, clock: tuple[float, float], end: float, stops: list[float], cfg: FilterConfig, how: Advection, sign: float) -> list[tuple]:
    """Particles p, changed in place, from their times to `end` or out of the window; gives (traj, number of the output, lon, lat) of outputs on the way. clock: the times of the field's slices.

    The step is first order and split: longitude moves first, the second velocity is read at the new place. Its length follows from the speeds of the step before.
    """
    out, targets = [], np.array([*stops, np.inf * sign])
    radius = 1.0 if cfg.cartesian else cfg.earth_radius
    dx, dy = abs(field.grid.dlon) * radius, abs(field.grid.dlat) * radius
    start, around = stops[0], field.grid.dlon * field.grid.nlon
    while True:
        on, here = field.known(p["lon"], p["lat"], cfg.periodic_x)
        p["alive"] &= on
        go = np.flatnonzero(p["alive"] & here & (sign * (end - p["t"]) > 1e-6) & (p["iout"] < len(stops)))
        if not len(go):
            return out
        lon, lat, t = p["lon"][go], p["lat"][go], p["t"][go]
        wide = 1.0 if cfg.cartesian else np.maximum(np.cos(lat), 1e-6)
        dt = how.cfl * np.minimum(dx * wide / np.maximum(np.abs(p["vu"][go]), 1e-3), dy / np.maximum(np.abs(p["vv"][go]), 1e-3))
        dt = np.minimum(dt, np.abs(targets[p["iout"][go]] - t))
        w = np.clip((t - clock[0]) / (clock[1] - clock[0]), 0.0, 1.0)
        vu = field.at(field.u, lon, lat, w)
        lon = lon + sign * dt * vu / (radius * wide)
        if cfg.periodic_x:
            lon = field.grid.lons[0] + (lon - field.grid.lons[0]) % around
        vv = field.at(field.v, lon, lat, w)
        ok = (np.abs(vu) <= how.fastest) & (np.abs(vv) <= how.fastest)
        lat, t = lat + sign * dt * vv / radius, t + sign * dt
        p["alive"][go] = ok
        for name, new in (("lon", lon), ("lat", lat), ("t", t), ("vu", vu), ("vv", vv)):
            p[name][go] = np.where(ok, new, p[name][go])
        there = go[ok & (sign * (t - targets[p["iout"][go]]) >= -1e-6)]
        out += list(zip(p["traj"][there].tolist(), p["iout"][there].tolist(), p["lon"][there].tolist(), p["lat"][there].tolist(), strict=True))
        p["iout"][there] += 1
        if how.lifespan:
            old = go[ok & (np.abs(p["t"][go] - start) >= (p["lives"][go] + 1) * how.lifespan)]
            p["lon"][old], p["lat"][old], p["lives"][old] = p["home_lon"][old], p["home_lat"][old], p["lives"][old] + 1


_ROWS_DDL = f"{_STATE_DDL}, out int, out_lon double, out_lat double"


def _rows(p: dict[str, np.ndarray], out: list[tuple]) -> pa.Table:
    """States, and outputs as rows whose column out is not null."""
    kinds = {"traj": pa.int32(), "lives": pa.int32(), "iout": pa.int32(), "alive": pa.bool_(), "out": pa.int32()}
    names = [*_STATE, "out", "out_lon", "out_lat"]
    n, m = len(p["traj"]), len(out)
    parts = []
    for k, name in enumerate(names):
        kind = kinds.get(name, pa.float64())
        if name in _STATE:
            later = pa.array([x[0] for x in out], kind) if name == "traj" else pa.nulls(m, kind)
            parts.append(pa.concat_arrays([pa.array(p[name], kind), later]))
        else:
            parts.append(pa.concat_arrays([pa.nulls(n, kind), pa.array([x[k - len(_STATE) + 1] for x in out], kind)]))
    return pa.Table.from_arrays(parts, names=names)


def _states(table: pa.Table) -> dict[str, np.ndarray]:
    return {n: np.array(table[n].to_numpy(zero_copy_only=False)) for n in _STATE}


def _tiles(grid: Grid, how: Advection) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(row, tile row, place) and (column, tile column, place): tiles with their margins."""
    rows = [(i, k, i - lo + how.margin) for k, lo in enumerate(range(0, grid.nlat, how.tile)) for i in range(max(0, lo - how.margin), min(grid.nlat, lo + how.tile + how.margin + 1))]
    columns = [(j % grid.nlon, k, j - lo + how.margin) for k, lo in enumerate(range(0, grid.nlon, how.tile)) for j in range(lo - how.margin, lo + how.tile + how.margin + 1)]
    return rows, columns


def advect(starts: DataFrame, velocities: DataFrame, times: list[float], outputs: list[float], grid: Grid, cfg: FilterConfig = FilterConfig(), how: Advection = Advection(), backwards: bool = False) -> DataFrame:
    """(traj, iout, time, lon, lat) of starts(traj, lon, lat) in velocities(itime, ilat, ilon, u, v) at `times`; null velocities are 0.

    Off the grid or too fast: null from there on. One time alone: streamlines. backwards: from the last output time to the first with reversed velocities.
    """
    spark = starts.sparkSession
    sign, stops = (-1.0, list(reversed(outputs))) if backwards else (1.0, list(outputs))
    spans = [(times[k], times[k + 1], k, k + 1) for k in range(len(times) - 1)] or [(min(outputs), max(outputs) + 1.0, 0, 0)]
    spans[0] = (min(spans[0][0], min(outputs)), *spans[0][1:])
    spans[-1] = (spans[-1][0], max(spans[-1][1], max(outputs)), *spans[-1][2:])
    clock = {k: (times[k], times[k + 1]) for k in range(len(times) - 1)} or {0: (min(outputs), max(outputs) + 1.0)}
    states = starts.select(F.col("traj").cast("int").alias("traj"), "lon", "lat", F.lit(float(stops[0])).alias("t"), F.lit(how.first).alias("vu"), F.lit(how.first).alias("vv"), F.lit(0).alias("lives"), F.col("lon").alias("home_lon"), F.col("lat").alias("home_lat"), F.lit(1).alias("iout"), F.lit(True).alias("alive"))
    states = stored(states, "particles")
    found = [states.select("traj", F.lit(0).alias("out"), F.col("lon").alias("out_lon"), F.col("lat").alias("out_lat"))]
    cells = velocities.select("itime", "ilat", "ilon", F.coalesce("u", F.lit(0.0)).cast("double").alias("u"), F.coalesce("v", F.lit(0.0)).cast("double").alias("v"))
    whole = grid.nlat * grid.nlon * 8 * 4 <= how.most
    slices: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fill(table: pa.Table, shape: tuple[int, int], rows: str = "ilat", columns: str = "ilon") -> tuple[np.ndarray, np.ndarray]:
        both = np.zeros((2, *shape))
        both[:, table[rows].to_numpy(), table[columns].to_numpy()] = table["u"].to_numpy(), table["v"].to_numpy()
        return both[0], both[1]

    def slice_of(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in slices:
            for old in [x for x in slices if abs(x - k) > 1]:
                del slices[old]
            slices[k] = fill(cells.where(F.col("itime") == k).toArrow(), (grid.nlat, grid.nlon))
        return slices[k]

    def one_span(states: DataFrame, end: float, a: int, b: int) -> DataFrame:
        """Rows of _rows() after all moving particles have reached the end of the span."""
        if not whole:
            return by_tiles(states, end, a, b)
        (u0, v0), (u1, v1) = slice_of(a), slice_of(b)
        shared = spark.sparkContext.broadcast((np.stack([u0, u1]), np.stack([v0, v1])))

        def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            field = _Velocity(grid, *shared.value)
            for batch in batches:
                p = _states(pa.Table.from_batches([batch]))
                yield from _rows(p, _advance(p, field, clock[a], end, stops, cfg, how, sign)).combine_chunks().to_batches()

        dealt = states.repartition(max(1, spark.sparkContext.defaultParallelism), "traj")
        return stored(dealt.mapInArrow(many, _ROWS_DDL), "particles")

    def by_tiles(states: DataFrame, end: float, a: int, b: int) -> DataFrame:
        rows, columns = _tiles(grid, how)
        side = how.tile + 2 * how.margin + 1
        tiled = cells.where(F.col("itime").isin(a, b)).join(F.broadcast(spark.createDataFrame(rows, "ilat int, ty int, y int")), "ilat").join(F.broadcast(spark.createDataFrame(columns, "ilon int, tx int, x int")), "ilon")
        tiled = stored(tiled.select("ty", "tx", "y", "x", "itime", "u", "v"), "tiles")
        moving = (F.lit(sign) * (F.lit(end) - F.col("t")) > 1e-6) & F.col("alive") & (F.col("iout") < len(stops))
        done = None
        while True:
            y, x = F.floor((F.col("lat") - F.lit(grid.lats[0])) / F.lit(grid.dlat)), F.floor((F.col("lon") - F.lit(grid.lons[0])) / F.lit(grid.dlon))
            if cfg.periodic_x:
                x = F.pmod(x, F.lit(grid.nlon))
            placed = states.select("*", F.floor(F.greatest(F.lit(0), F.least(y, F.lit(grid.nlat - 1))) / how.tile).cast("int").alias("ty"), F.floor(F.greatest(F.lit(0), F.least(x, F.lit(grid.nlon - 1))) / how.tile).cast("int").alias("tx"))

            def meet(left: pa.Table, right: pa.Table) -> pa.Table:
                p = _states(left)
                if not len(p["traj"]):
                    return _rows(p, [])
                ty, tx = left["ty"][0].as_py(), left["tx"][0].as_py()
                both = []
                for k in (a, b):
                    own = right.filter(pc.equal(right["itime"], k))
                    both.append(fill(own, (side, side), "y", "x"))
                field = _Velocity(grid, np.stack([both[0][0], both[1][0]]), np.stack([both[0][1], both[1][1]]), ty * how.tile - how.margin, (tx * how.tile - how.margin) % grid.nlon, wraps=False)
                return _rows(p, _advance(p, field, clock[a], end, stops, cfg, how, sign))

            done_now = stored(placed.where(moving).groupBy("ty", "tx").cogroup(tiled.groupBy("ty", "tx")).applyInArrow(meet, _ROWS_DDL), "particles")
            done = done_now if done is None else done.where("out is not null").unionByName(done_now)
            rest = states.where(~moving).select(*_STATE)
            states = stored(rest.unionByName(done_now.where("out is null").select(*_STATE)), "particles")
            if not states.where(moving).head(1):
                blank = states.select("*", F.lit(None).cast("int").alias("out"), F.lit(None).cast("double").alias("out_lon"), F.lit(None).cast("double").alias("out_lat"))
                return stored(done.where("out is not null").unionByName(blank), "particles")

    for lo, hi, a, b in reversed(spans) if backwards else spans:
        if (sign > 0 and hi <= stops[0]) or (sign < 0 and lo >= stops[0]):
            continue
        after = one_span(states, hi if sign > 0 else lo, a, b)
        found.append(after.where("out is not null").select("traj", "out", "out_lon", "out_lat"))
        states = after.where("out is null").select(*_STATE)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    asked = spark.createDataFrame([(k, len(outputs) - 1 - k if backwards else k, float(t)) for k, t in enumerate(stops)], "out int, iout int, time double")
    plan = starts.select(F.col("traj").cast("int").alias("traj")).crossJoin(F.broadcast(asked))
    return plan.join(every, ["traj", "out"], "left").select("traj", "iout", "time", F.col("out_lon").alias("lon"), F.col("out_lat").alias("lat"))


def project_onto(points: DataFrame, cells: DataFrame, times: list[float], grid: Grid, fields: list[str], periodic: bool = True) -> DataFrame:
    """points(traj, iout, time, lon, lat) with fields of cells(itime, ilat, ilon), bilinear in space and linear in time; 0 for land corners, null off the grid or its times. Eight equi-joined corners, summed by weight."""
    spark = points.sparkSession
    gaps = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(times, times[1:], strict=False))] or [(0, times[0], times[0])], "k int, t0 double, t1 double")
    # Times bracket few slices: an as-of join against the axis, whose size is known.
    timed = points.join(F.broadcast(gaps), (F.col("time") >= F.col("t0")) & ((F.col("time") < F.col("t1")) | ((F.col("time") == F.col("t1")) & (F.col("t1") == times[-1]))), "left")
    y, x = (F.col("lat") - F.lit(grid.lats[0])) / grid.dlat, (F.col("lon") - F.lit(grid.lons[0])) / grid.dlon
    df = timed.select("traj", "iout", "time", "lon", "lat", "k", F.when(F.col("t1") > F.col("t0"), (F.col("time") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0).alias("wt"), F.floor(y).cast("int").alias("i"), F.floor(x).cast("int").alias("j"), (y - F.floor(y)).alias("a"), (x - F.floor(x)).alias("b"))
    inside = F.col("k").isNotNull() & F.col("i").between(0, grid.nlat - 2)
    if not periodic:
        inside = inside & F.col("j").between(0, grid.nlon - 2)
    corners = [F.struct((F.col("k") + dt).alias("itime"), (F.col("i") + di).alias("ilat"), F.pmod(F.col("j") + dj, F.lit(grid.nlon)).cast("int").alias("ilon"), ((F.col("wt") if dt else 1 - F.col("wt")) * (F.col("a") if di else 1 - F.col("a")) * (F.col("b") if dj else 1 - F.col("b"))).alias("w")) for dt in (0, 1) for di in (0, 1) for dj in (0, 1)]
    spread = df.where(inside).select("traj", "iout", F.explode(F.array(*corners)).alias("c")).select("traj", "iout", "c.*").where("w != 0")
    met = spread.join(cells.select("itime", "ilat", "ilon", *fields), ["itime", "ilat", "ilon"], "left")
    sums = met.groupBy("traj", "iout").agg(*[F.sum(F.col("w") * F.coalesce(F.col(f), F.lit(0.0))).alias(f) for f in fields])
    return points.join(sums, ["traj", "iout"], "left")


def fore_back_distance(forward: DataFrame, back: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """(traj, iout, dist) of two tables of trajectories; null where either is off the grid."""
    other = back.select("traj", "iout", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    df = forward.join(other, ["traj", "iout"]).withColumn("dlon", F.col("lon2") - F.col("lon"))
    return df.select("traj", "iout", F.expr(geometry.distance("lat", "lat2", "dlon", cfg)).alias("dist"))
