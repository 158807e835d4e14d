"""Per-slice numerics that iterate: Helmholtz projection, interpolation over land, sharp spectral filters.

Each slice in time and depth is one group of cells, whose size is the horizontal
mesh whatever the number of slices; slices are independent and spread over tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.config import FilterConfig
from tesseral.grid import Grid
from tesseral.operators import calculus
from tesseral.operators.calculus import _beside, coefficients, stencil_cases


class Lines:
    """A derivative along one axis as a linear map of (line, place) arrays, and its transpose.

    Without land all lines are alike: one matrix, or for a periodic axis one set of shifts. With land every cell has its own stencil, as
    places and weights; land has none.
    """

    def __init__(self, n: int, delta: float, order: int, derivative: int, periodic: bool, wet: np.ndarray | None = None):
        self.n, self.points = n, order + derivative
        if wet is None:
            half = (self.points - 1) // 2
            at, weights = np.zeros((n, self.points), int), np.zeros((n, self.points))
            for i in range(n):
                left = half if periodic else min(i, max(half, self.points - 1 - (n - 1 - i)))
                at[i] = (i - left + np.arange(self.points)) % n
                weights[i] = [float(c) / delta**derivative for c in coefficients(tuple(range(-left, self.points - left)), derivative)]
        else:
            at, weights = self._around_land(wet, delta, order, derivative, periodic)
        self.at, self.weights = at, weights
        if wet is None:
            self.matrix = np.zeros((n, n))
            np.add.at(self.matrix, (np.repeat(np.arange(n), self.points), at.reshape(-1)), weights.reshape(-1))

    def _around_land(self, wet: np.ndarray, delta: float, order: int, derivative: int, periodic: bool) -> tuple[np.ndarray, np.ndarray]:
        """As calculus.differences() chooses stencils, for water cells; the order falls where little water is beside a cell."""
        n, most = self.n, order + derivative
        left, right = np.zeros(wet.shape, int), np.zeros(wet.shape, int)
        for run, sign in ((left, -1), (right, 1)):
            open_ = np.ones(wet.shape, bool)
            for k in range(1, most + 1):
                open_ &= _beside(wet, sign * k, periodic, False)
                run += open_
        at, weights = np.zeros((*wet.shape, self.points), int), np.zeros((*wet.shape, self.points))
        done = ~wet
        for points, rows in stencil_cases(order, derivative):
            half = (points - 1) // 2
            fits = ~done & (left + right >= points - 1)
            taken = np.minimum(np.minimum(left, points), np.maximum(half, points - 1 - np.minimum(right, points)))
            for on_left, own in rows:
                line, place = np.nonzero(fits & (taken == on_left))
                for k, w in enumerate(own):
                    at[line, place, k] = (place + k - on_left) % n
                    weights[line, place, k] = w / delta**derivative
            done |= fits
        return at, weights

    def apply(self, f: np.ndarray) -> np.ndarray:
        if self.at.ndim == 2:
            return f @ self.matrix.T
        return np.einsum("ijk,ijk->ij", f[np.arange(len(f))[:, None, None], self.at], self.weights)

    def transpose(self, g: np.ndarray) -> np.ndarray:
        if self.at.ndim == 2:
            return g @ self.matrix
        to = np.arange(len(g))[:, None, None] * self.n + self.at
        return np.bincount(to.reshape(-1), (g[:, :, None] * self.weights).reshape(-1), g.size).reshape(g.shape)

    def entries(self, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of every cell (line, place, point)."""
        shape = (lines, self.n, self.points)
        return np.broadcast_to(self.at, shape), np.broadcast_to(self.weights, shape)


class Operator:
    """Velocity, and weighted vorticity and divergence rows, of potentials (psi, phi) on one slice: a sparse matrix and its transpose, applied by lines.

    wet: with it stencils keep off land, where the velocity has no rows and potentials have identity rows.
    """

    def __init__(self, grid: Grid, cfg: FilterConfig, tikhonov: float, area_weight: bool, wet: np.ndarray | None = None):
        self.shape, self.wet = (grid.nlat, grid.nlon), wet
        lat, r = np.array(grid.lats), cfg.earth_radius
        turned = None if wet is None else np.ascontiguousarray(wet.T)
        self.dx, self.dxx = (Lines(grid.nlon, grid.dlon, cfg.order, k, cfg.periodic_x, wet) for k in (1, 2))
        self.dy, self.dyy = (Lines(grid.nlat, grid.dlat, cfg.order, k, False, turned) for k in (1, 2))
        pole = np.abs(np.degrees(np.abs(lat)) - 90) < 0.01
        safe = np.where(pole, 1.0, np.cos(lat))
        self.ax, self.ay = np.where(pole, 0, 1 / (r * safe))[:, None], np.where(pole, 0, 1 / r)[:, None] * np.ones((len(lat), 1))
        self.lxx, self.ly, self.lyy = tikhonov * (self.ax**2), tikhonov * (-np.where(pole, 0, np.tan(np.where(pole, 0, lat)))[:, None] / r**2), tikhonov * (self.ay**2)
        weights = np.sqrt(np.cos(lat).clip(0))[:, None] if area_weight else np.ones((len(lat), 1))
        self.weight = weights * np.ones(self.shape) * (1.0 if wet is None else wet)
        self.tikhonov = tikhonov

    def _x(self, f: np.ndarray, d: Lines) -> np.ndarray:
        return d.apply(f)

    def _y(self, f: np.ndarray, d: Lines) -> np.ndarray:
        return d.apply(f.T).T

    def _xt(self, g: np.ndarray, d: Lines) -> np.ndarray:
        return d.transpose(g)

    def _yt(self, g: np.ndarray, d: Lines) -> np.ndarray:
        return d.transpose(g.T).T

    def laplacian(self, f: np.ndarray) -> np.ndarray:
        return self.lxx * self._x(f, self.dxx) + self.ly * self._y(f, self.dy) + self.lyy * self._y(f, self.dyy)

    def velocity(self, psi: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = -self.ay * self._y(psi, self.dy) + self.ax * self._x(phi, self.dx)
        v = self.ax * self._x(psi, self.dx) + self.ay * self._y(phi, self.dy)
        return u, v

    def apply(self, x: np.ndarray) -> np.ndarray:
        psi, phi = x.reshape(2, *self.shape)
        out = [w * self.weight for w in self.velocity(psi, phi)]
        if self.tikhonov:
            out += [self.laplacian(psi) * self.weight, self.laplacian(phi) * self.weight]
        if self.wet is not None:
            out += [psi * ~self.wet, phi * ~self.wet]
        return np.stack(out).reshape(-1)

    def transpose(self, y: np.ndarray) -> np.ndarray:
        planes = y.reshape(-1, *self.shape)
        parts = [p * self.weight for p in planes]
        u, v = parts[:2]
        psi = -self._yt(self.ay * u, self.dy) + self._xt(self.ax * v, self.dx)
        phi = self._xt(self.ax * u, self.dx) + self._yt(self.ay * v, self.dy)
        if self.tikhonov:
            for f, g in ((psi, parts[2]), (phi, parts[3])):
                f += self._xt(self.lxx * g, self.dxx) + self._yt(self.ly * g, self.dy) + self._yt(self.lyy * g, self.dyy)
        if self.wet is not None:
            psi += planes[-2] * ~self.wet
            phi += planes[-1] * ~self.wet
        return np.stack([psi, phi]).reshape(-1)


def _matrix_rows(grid: Grid, parts: list[tuple[Lines, str, np.ndarray]]) -> dict[tuple[int, int], float]:
    """Entries (row, column) of a sum of scaled derivatives: parts are lines, their axis and a factor for each cell."""
    out: dict[tuple[int, int], float] = {}
    nlat, nlon = grid.nlat, grid.nlon
    for lines, axis, factor in parts:
        at, weights = lines.entries(nlat if axis == "x" else nlon)
        a, b, k = np.nonzero(weights)
        other = at[a, b, k]
        i, j, i2, j2 = (a, b, a, other) if axis == "x" else (b, a, other, a)
        values = weights[a, b, k] * np.broadcast_to(factor, (nlat, nlon))[i, j]
        for row, column, value in zip((i * nlon + j).tolist(), (i2 * nlon + j2).tolist(), values.tolist(), strict=True):
            out[row, column] = out.get((row, column), 0.0) + value
    return out


def sparse_laplacian(spark, grid: Grid, cfg: FilterConfig = FilterConfig(), wet: np.ndarray | None = None) -> DataFrame:  # noqa: ANN001
    """(row, column, value) of the Laplacian of a field on the sphere, cells numbered row by row; land and poles have identity rows. Of the size of one horizontal mesh."""
    op = Operator(grid, cfg, 1.0, False, wet)
    rows = _matrix_rows(grid, [(op.dxx, "x", op.lxx), (op.dy, "y", op.ly), (op.dyy, "y", op.lyy)])
    closed = (np.broadcast_to(op.ay == 0, op.shape) | (False if wet is None else ~wet)).reshape(-1)
    entries = [(r, c, v) for (r, c), v in rows.items() if not closed[r]] + [(int(k), int(k), 1.0) for k in np.flatnonzero(closed)]
    return spark.createDataFrame(entries, "row int, column int, value double")


def sparse_velocity(spark, grid: Grid, cfg: FilterConfig = FilterConfig(), wet: np.ndarray | None = None) -> DataFrame:  # noqa: ANN001
    """(row, column, value) of the velocity of potentials: rows are u_lon then u_lat, columns psi then phi, cells numbered row by row."""
    op = Operator(grid, cfg, 0.0, False, wet)
    n = grid.nlat * grid.nlon
    ax, ay = (np.broadcast_to(x, op.shape) * (1.0 if wet is None else wet) for x in (op.ax, op.ay))
    blocks = {(0, 0): [(op.dy, "y", -ay)], (0, 1): [(op.dx, "x", ax)], (1, 0): [(op.dx, "x", ax)], (1, 1): [(op.dy, "y", ay)]}
    entries = [(r + a * n, c + b * n, v) for (a, b), parts in blocks.items() for (r, c), v in _matrix_rows(grid, parts).items()]
    return spark.createDataFrame(entries, "row int, column int, value double")


def least_squares(apply, transpose, b: np.ndarray, x: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, int]:  # noqa: ANN001
    """Conjugate gradients on the normal equations from a first guess; the solution and the steps taken."""
    r = b - apply(x)
    s = transpose(r)
    p, gamma = s.copy(), float(s @ s)
    start = gamma
    for k in range(steps):
        if gamma <= tolerance**2 * max(start, 1e-300):
            return x, k
        q = apply(p)
        alpha = gamma / max(float(q @ q), 1e-300)
        x, r = x + alpha * p, r - alpha * q
        s = transpose(r)
        new = float(s @ s)
        p, gamma = s + (new / gamma) * p, new
    return x, steps


@dataclass(frozen=True)
class Projection:
    """Settings of the Helmholtz projection. Speeds beyond `fastest` count as 0."""

    steps: int = 1500
    tolerance: float = 1e-12
    tikhonov: float = 0.0
    area_weight: bool = True
    fastest: float = 30000.0
    toroidal: bool = True
    potential: bool = True


def _field(pdf: pd.DataFrame, name: str, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    out[pdf.ilat.to_numpy(), pdf.ilon.to_numpy()] = np.nan_to_num(pdf[name].to_numpy(float))
    return out


def _frame(grid: Grid, keys: dict, fields: dict[str, np.ndarray]) -> pd.DataFrame:
    mesh = {"ilat": np.repeat(np.arange(grid.nlat, dtype=np.int32), grid.nlon), "ilon": np.tile(np.arange(grid.nlon, dtype=np.int32), grid.nlat)}
    return pd.DataFrame(keys | mesh | {k: v.reshape(-1) for k, v in fields.items()})


def helmholtz(cells: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), how: Projection = Projection(), keys: list[str] | None = None, u: str = "u_lon", v: str = "u_lat", seed: tuple[str, str] | None = None, water: str | None = None) -> DataFrame:
    """(keys, ilat, ilon, psi, phi, u_lon_tor, u_lat_tor, u_lon_pot, u_lat_pot, steps): the least-squares split of a velocity field.

    seed: columns of a first guess, as refined from a coarser solve. One kind alone is projected by switching the other off. water: a boolean
    column; stencils keep off land, where potentials and velocities are 0. steps: how many were taken; how.steps of them mean that the tolerance was not met.
    """
    keys = ["itime", "idepth"] if keys is None else keys
    names = ["psi", "phi", "u_lon_tor", "u_lat_tor", "u_lon_pot", "u_lat_pot"]
    schema = ", ".join([*[f"{k} int" for k in keys], "ilat int, ilon int", *[f"{n} double" for n in names], "steps int"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wet = None
        if water:
            wet = np.zeros((grid.nlat, grid.nlon), bool)
            wet[pdf.ilat.to_numpy(), pdf.ilon.to_numpy()] = pdf[water].to_numpy(bool)
        op = Operator(grid, cfg, how.tikhonov, how.area_weight, wet)
        a, b = (_field(pdf, c, op.shape) for c in (u, v))
        fast = (np.abs(a) > how.fastest) | (np.abs(b) > how.fastest)
        a[fast], b[fast] = 0, 0
        x = np.concatenate([_field(pdf, c, op.shape).reshape(-1) for c in seed]) if seed else np.zeros(2 * a.size)
        only = np.repeat([float(how.toroidal), float(how.potential)], a.size)
        rhs = [a * op.weight, b * op.weight]
        if how.tikhonov:
            # Vorticity and divergence of the data, in the rows of the Laplacians.
            r, scale = cfg.earth_radius, how.tikhonov
            cos = np.cos(np.array(grid.lats))[:, None]
            tan = np.tan(np.array(grid.lats))[:, None]
            vort = (op._x(b, op.dx) / cos - op._y(a, op.dy) + tan * a) / r
            div = (op._x(a, op.dx) / cos + op._y(b, op.dy) - tan * b) / r
            rhs += [scale * vort * op.weight, scale * div * op.weight]
        if water:
            rhs += [np.zeros(op.shape)] * 2
        x, taken = least_squares(lambda y: op.apply(y * only), lambda y: op.transpose(y) * only, np.stack(rhs).reshape(-1), x, how.steps, how.tolerance)
        psi, phi = (x * only).reshape(2, *op.shape)
        zero = np.zeros_like(psi)
        tor, pot = op.velocity(psi, zero), op.velocity(zero, phi)
        out = _frame(grid, {k: pdf[k].iloc[0] for k in keys}, dict(zip(names, [psi, phi, *tor, *pot], strict=True)))
        out["steps"] = np.int32(taken)
        return out

    return cells.select(*keys, "ilat", "ilon", u, v, *(seed or ()), *([water] if water else ())).groupBy(*keys).applyInPandas(one, schema)


def sharp_filter(cells: DataFrame, grid: Grid, scales: list[float], fields: list[str], keys: list[str] | None = None, products: list[tuple[str, str]] | None = None) -> DataFrame:
    """(ell, keys, ilat, ilon, <fields>, <a>_<b>): all wave numbers from 2 pi / ell are removed, on a periodic plane. products: pairs of fields whose product is filtered too."""
    keys = ["itime", "idepth"] if keys is None else keys
    products = products or []
    names = [*fields, *[f"{a}_{b}" for a, b in products]]
    asked = cells.sparkSession.createDataFrame([(float(x),) for x in scales], "ell double")
    schema = ", ".join(["ell double", *[f"{k} int" for k in keys], "ilat int, ilon int", *[f"{n} double" for n in names]])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ell = float(pdf.ell.iloc[0])
        shape = (grid.nlat, grid.nlon)
        ky = 2 * np.pi * np.fft.fftfreq(grid.nlat, grid.dlat)[:, None]
        kx = 2 * np.pi * np.fft.rfftfreq(grid.nlon, grid.dlon)[None, :]
        keep = np.sqrt(kx**2 + ky**2) < 2 * np.pi / ell
        values = {f: _field(pdf, f, shape) for f in fields}
        values |= {f"{a}_{b}": values[a] * values[b] for a, b in products}
        out = {n: np.fft.irfft2(np.fft.rfft2(x) * keep, s=shape) for n, x in values.items()}
        return _frame(grid, {"ell": ell} | {k: pdf[k].iloc[0] for k in keys}, out)

    return cells.select(*keys, "ilat", "ilon", *fields).crossJoin(F.broadcast(asked)).groupBy("ell", *keys).applyInPandas(one, schema)


def sharp_energies(cells: DataFrame, grid: Grid, scales: list[float], cfg: FilterConfig, keys: list[str] | None = None, u: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """(ell, keys, ilat, ilon, coarse <u>, coarse_KE, fine_KE, Pi) of velocities filtered sharply on a periodic plane: energies above and below a scale and the transfer through it. A third velocity has no vertical derivative."""
    keys = ["itime", "idepth"] if keys is None else keys
    products = [(a, b) for k, a in enumerate(u) for b in u[k:]]
    df = sharp_filter(cells, grid, scales, list(u), keys, products)
    df = calculus.spherical_gradients(df, grid, list(u), ["ell", *keys], cfg.order, 1, True, True)
    own = " + ".join(f"{a} * {a}" for a in u)
    whole = " + ".join(f"{a}_{a}" for a in u)
    slope = lambda a, k: ("0.0" if k > 1 else f"{('dlon', 'dlat')[k]}_{a}")
    terms = []
    for i, a in enumerate(u):
        for j, b in enumerate(u):
            first, second = (a, b) if i <= j else (b, a)
            terms.append(f"0.5 * ({slope(a, j)} + {slope(b, i)}) * ({first}_{second} - {a} * {b})")
    half = repr(0.5 * cfg.rho0)
    columns = {"coarse_KE": f"{half} * ({own})", "fine_KE": f"{half} * ({whole} - ({own}))", "Pi": f"-{cfg.rho0!r} * ({' + '.join(terms)})"}
    return df.select("ell", *keys, "ilat", "ilon", *u, *[F.expr(e).alias(n) for n, e in columns.items()])


def _near(land: np.ndarray, at: np.ndarray, far: float) -> np.ndarray:
    """Which points of `at` are within `far` of a land point, by chunks."""
    out = np.zeros(len(at), bool)
    size = (land**2).sum(axis=1)
    for lo in range(0, len(at), 1024):
        x = at[lo : lo + 1024]
        d2 = (x**2).sum(axis=1)[:, None] + size[None, :] - 2 * x @ land.T
        out[lo : lo + 1024] = d2.min(axis=1) <= far**2
    return out


#: Points whose Gaussians are kept as one matrix while a layer is solved; beyond them it is made anew by chunks.
KEPT_POINTS = 4000


def _gaussians(points: np.ndarray, centres: np.ndarray, width: float) -> np.ndarray:
    d2 = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
    return np.exp(-np.maximum(d2, 0.0) / width**2)


def _bases(points: np.ndarray, centres: np.ndarray, width: float, weights: np.ndarray) -> np.ndarray:
    """Sums of Gaussian bases at points, by chunks."""
    out = np.zeros(len(points))
    for lo in range(0, len(points), 1024):
        out[lo : lo + 1024] = _gaussians(points[lo : lo + 1024], centres, width) @ weights
    return out


def layered_bases(known: np.ndarray, values: np.ndarray, asked: np.ndarray, width: float, layers: int, tolerance: float = 1e-6, steps: int = 400) -> np.ndarray:
    """Values at `asked` of an interpolation by layers of Gaussian bases on the known points, each half as wide as the one before.

    A layer's weights solve its linear system for what the wider layers left, by conjugate gradients (the matrix is symmetric and positive),
    so that the last, narrow and well conditioned layer meets the known values to the tolerance.
    """
    mean = values.mean()
    rest, out = values - mean, np.full(len(asked), mean)
    size = max(float(np.abs(rest).max(initial=0.0)), 1e-300)
    for k in range(layers):
        own, small = width / 2**k, 1e-3 if k < layers - 1 else tolerance
        kept = _gaussians(known, known, own) if len(known) <= KEPT_POINTS else None
        times = lambda x, kept=kept, own=own: _bases(known, known, own, x) if kept is None else kept @ x
        w, r = np.zeros(len(known)), rest.copy()
        p, gamma = r.copy(), float(r @ r)
        for _ in range(steps):
            if math.sqrt(gamma / len(r)) <= small * size:
                break
            q = times(p)
            alpha = gamma / max(float(p @ q), 1e-300)
            w, r = w + alpha * p, r - alpha * q
            new = float(r @ r)
            p, gamma = r + (new / max(gamma, 1e-300)) * p, new
        out += _bases(asked, known, own, w)
        rest = rest - times(w)
    return out


def fill_land(cells: DataFrame, grid: Grid, fields: list[str], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, radius: float = 10.0, layers: int = 4, near_coast: int | None = None, reach: float = 3.0) -> DataFrame:
    """cells with land (null) values interpolated from water by layers of Gaussian bases, the widest of `radius` cells; water keeps its values.

    Only water within `reach` times the widest radius of land has bases: the Gaussians of any other add less than exp(-reach * reach). near_coast: only
    water that many cells from land, as for a fill from the coast.
    """
    keys = ["itime", "idepth"] if keys is None else keys
    schema = ", ".join([*[f"{k} int" for k in keys], "ilat int, ilon int", *[f"{f} double" for f in fields]])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon = np.array(grid.lats)[pdf.ilat], np.array(grid.lons)[pdf.ilon]
        if cfg.cartesian:
            at, step = np.stack([lon, lat], axis=1), abs(grid.dlat)
        else:
            at = cfg.earth_radius * np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
            step = abs(grid.dlat) * cfg.earth_radius
        out = pdf[[*keys, "ilat", "ilon"]].copy()
        for f in fields:
            values = pdf[f].to_numpy(float)
            wet = ~np.isnan(values)
            filled = values.copy()
            if wet.any() and not wet.all():
                known = np.flatnonzero(wet)
                far = (reach * radius if near_coast is None else near_coast) * step
                close = _near(at[~wet], at[known], far)
                known = known[close] if close.any() else known
                filled[~wet] = layered_bases(at[known], values[known], at[~wet], radius * step, layers)
            out[f] = filled
        return out

    return cells.select(*keys, "ilat", "ilon", *fields).groupBy(*keys).applyInPandas(one, schema)


class TensorOperator(Operator):
    """The symmetric tensor (uu, uv, vv) of a scalar and a vector (vector=True: v_r, v_lon, v_lat) or of a scalar and two potentials (v_r, phi, psi); damp adds that multiple of the unknowns as rows."""

    def __init__(self, grid: Grid, cfg: FilterConfig, vector: bool, damp: float = 0.0):
        super().__init__(grid, cfg, 0.0, False)
        lat = np.array(grid.lats)
        open_ = np.abs(np.degrees(np.abs(lat)) - 90) >= 0.01
        self.open = open_[:, None] * np.ones(self.shape)
        cos = np.where(open_, np.cos(lat), 1.0)
        self.sec, self.tan = (1 / cos)[:, None], np.where(open_, np.tan(np.where(open_, lat, 0)), 0)[:, None]
        self.vector, self.damp = vector, damp

    def _mixed(self, f: np.ndarray) -> np.ndarray:
        return self.sec * (self.tan * self._x(f, self.dx) + self._x(self._y(f, self.dy), self.dx))

    def _mixed_t(self, g: np.ndarray) -> np.ndarray:
        return self._xt(self.sec * self.tan * g, self.dx) + self._yt(self._xt(self.sec * g, self.dx), self.dy)

    def tensor(self, r: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.vector:
            uu = r + self.sec * self._x(a, self.dx) - self.tan * b
            uv = 0.5 * (self.tan * a + self._y(a, self.dy) + self.sec * self._x(b, self.dx))
            vv = r + self._y(b, self.dy)
        else:
            uu = r + self.sec**2 * self._x(a, self.dxx) - self.tan * self._y(a, self.dy) - self._mixed(b)
            uv = self._mixed(a) + 0.5 * (-self.tan * self._y(b, self.dy) - self._y(b, self.dyy) + self.sec**2 * self._x(b, self.dxx))
            vv = r + self._y(a, self.dyy) + self._mixed(b)
        return uu * self.open, uv * self.open, vv * self.open

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = [p.reshape(-1) for p in self.tensor(*x.reshape(3, *self.shape))]
        return np.concatenate([*out, self.damp * x] if self.damp else out)

    def transpose(self, y: np.ndarray) -> np.ndarray:
        n = self.shape[0] * self.shape[1]
        uu, uv, vv = (p * self.open for p in y[: 3 * n].reshape(3, *self.shape))
        if self.vector:
            a = self._xt(self.sec * uu, self.dx) + 0.5 * (self.tan * uv + self._yt(uv, self.dy))
            b = -self.tan * uu + 0.5 * self._xt(self.sec * uv, self.dx) + self._yt(vv, self.dy)
        else:
            a = self._xt(self.sec**2 * uu, self.dxx) - self._yt(self.tan * uu, self.dy) + self._mixed_t(uv) + self._yt(vv, self.dyy)
            b = -self._mixed_t(uu) + 0.5 * (-self._yt(self.tan * uv, self.dy) - self._yt(uv, self.dyy) + self._xt(self.sec**2 * uv, self.dxx)) + self._mixed_t(vv)
        out = np.concatenate([(uu + vv).reshape(-1), a.reshape(-1), b.reshape(-1)])
        return out + self.damp * y[3 * n :] if self.damp else out


def _by_waves(op: TensorOperator, rhs: np.ndarray) -> np.ndarray:
    """The least-squares solution of least norm on a periodic longitude, whose waves are independent: one dense system of 3 * nlat unknowns each."""
    nlat, nlon = op.shape
    at = np.unique(np.concatenate([-d.at[0] % nlon for d in (op.dx, op.dxx)] + [[0]]))
    columns = []
    for k in range(3 * nlat):
        e = np.zeros((3 * nlat, nlon))
        e[k, 0] = 1
        columns.append(op.apply(e.reshape(-1)).reshape(-1, nlon)[:, at])
    columns = np.stack(columns, axis=1)
    waves = np.fft.rfft(rhs.reshape(-1, nlon), axis=1)
    x = np.zeros((3 * nlat, waves.shape[1]), complex)
    for m in range(waves.shape[1]):
        a = columns @ np.exp(-2j * np.pi * m * at / nlon)
        x[:, m] = np.linalg.lstsq(a, waves[:, m], rcond=1e-13)[0]
    return np.fft.irfft(x, nlon, axis=1).reshape(-1)


def decompose_tensor(cells: DataFrame, grid: Grid, cfg: FilterConfig = FilterConfig(), vector: bool = False, steps: int = 500, tolerance: float = 1e-10, damp: float = 0.0, keys: list[str] | None = None, seed: tuple[str, str, str] | None = None) -> DataFrame:
    """(keys, ilat, ilon, v_r, v_a, v_b, uu_fit, uv_fit, vv_fit): least-squares scalar and vector (or potentials) of the tensor columns uu, uv, vv. What a seed gives is subtracted first and added back. A periodic longitude is solved directly, others in steps, which fail beyond `steps` of them."""
    keys = ["itime", "idepth"] if keys is None else keys
    names = ["v_r", "v_a", "v_b", "uu_fit", "uv_fit", "vv_fit"]
    schema = ", ".join([*[f"{k} int" for k in keys], "ilat int, ilon int", *[f"{n} double" for n in names]])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        op = TensorOperator(grid, cfg, vector, damp)
        n = op.shape[0] * op.shape[1]
        base = np.concatenate([_field(pdf, c, op.shape).reshape(-1) for c in seed]) if seed else np.zeros(3 * n)
        rhs = np.concatenate([(_field(pdf, c, op.shape) * op.open).reshape(-1) for c in ("uu", "uv", "vv")]) - op.apply(base)[: 3 * n]
        rhs = np.concatenate([rhs, np.zeros(3 * n)]) if damp else rhs
        if cfg.periodic_x:
            x = _by_waves(op, rhs)
        else:
            x, taken = least_squares(op.apply, op.transpose, rhs, np.zeros(3 * n), steps, tolerance)
            if taken >= steps:
                raise ValueError(f"the tensor decomposition has not converged in {steps} steps")
        parts = (x + base).reshape(3, *op.shape)
        return _frame(grid, {k: pdf[k].iloc[0] for k in keys}, dict(zip(names, [*parts, *op.tensor(*parts)], strict=True)))

    return cells.select(*keys, "ilat", "ilon", "uu", "uv", "vv", *(seed or ())).groupBy(*keys).applyInPandas(one, schema)
