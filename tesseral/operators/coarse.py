"""Coarse-graining: kernel- and area-weighted neighbourhood means.

Along a row of the mesh the kernel depends on the offset in longitude alone, so that a
mean is a sum of convolutions of source rows. A slice in time and depth is cut into
units: some scales and target rows, with the source rows in reach of them. A unit's
cells are one group; rows are transformed once for all scales and fields, weights row
pair by row pair, kept between slices up to a bound of memory. All fields of all scales
take one shuffle. How many units there are follows from the pairs of cells to weigh, which
is known from the axes; their size is bounded by `FilterConfig.unit_pairs` and
`unit_bytes`, whatever the mesh.

coarse_grain_pairs() computes the same by an equi-join of cells with a generated stencil
table (scale, target row, source row, offset, weight); a distance join is never made.
It keeps everything in built-in expressions, for small stencils and as a check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.config import FilterConfig, check_scales
from tesseral.functions import geometry, kernels
from tesseral.grid import Grid

#: A stencil of at most so many rows (about 60 bytes each) is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Transformed weights that a worker keeps between slices, in bytes; weights made at once.
KEPT_BYTES, MADE_BYTES = 128 << 20, 32 << 20


# ---------------------------------------------------------------- windows


def _row_sets(grid: Grid, ell: float, cfg: FilterConfig, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Whether source row j (column) is in the window of target row i, for target rows [lo, hi)."""
    n = grid.nlat
    i, j = np.arange(lo, n if hi is None else hi)[:, None], np.arange(n)[None, :]
    if cfg.zonal_kernel_only:
        return i == j
    if cfg.pad < 0:
        return np.ones((len(i), n), bool)
    if not cfg.uniform_lat:
        y = np.array(grid.lats) * (1 if cfg.cartesian else cfg.earth_radius)
        return np.abs(y[i] - y[j]) <= cfg.pad * ell
    reach = lat_reach(grid, ell, cfg)
    if cfg.periodic_y:
        return ((j - i + reach) % n < 2 * reach) if 2 * reach < n else np.ones((len(i), n), bool)
    return (j >= i - reach) & (j < i + reach)


def lat_reach(grid: Grid, ell: float, cfg: FilterConfig) -> int:
    """Rows on either side that a uniform grid's window holds: source rows are in [i - n, i + n)."""
    if cfg.pad < 0:
        return grid.nlat
    metres = grid.dlat if cfg.cartesian else grid.dlat * cfg.earth_radius
    return min(grid.nlat, math.ceil(cfg.pad * ell / abs(metres) / 2))


def lon_reach(grid: Grid, i: np.ndarray, j: np.ndarray, ell: float, cfg: FilterConfig) -> np.ndarray:
    """Columns on either side in source rows j of target rows i: offsets are in [-n, n), all where 2 n reaches round."""
    if cfg.pad < 0:
        return np.full(len(i), grid.nlon)
    lats, reach = np.array(grid.lats), cfg.pad * ell
    a, b = lats[i], lats[j]
    if cfg.cartesian:
        gap = np.abs(a - b)
        gap = np.minimum(gap, grid.dlat * grid.nlat - gap) if cfg.periodic_y else gap
        wide = np.sqrt(np.maximum(0.0, reach**2 - gap**2))
        return np.minimum(grid.nlon, np.ceil(wide / grid.dlon / 2)).astype(int)
    r, half = cfg.earth_radius, reach / 2
    sines, cosines = np.sin(a) * np.sin(b), np.cos(a) * np.cos(b)
    apart = lambda x: r * np.arccos(np.clip(x, -1, 1))
    top = -1.0 if reach >= 2 * math.pi * r else math.cos(half / r)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num((top - sines) / cosines, nan=1.0, posinf=1.0, neginf=-1.0)
    out = np.ceil(np.arccos(np.clip(ratio, -1, 1)) / grid.dlon).astype(int)
    out = np.where(np.where(a == b, 0.0, apart(sines + cosines)) >= half, 1, out)
    return np.where(apart(sines - cosines) <= half, grid.nlon, out)


def window_arrays(grid: Grid, ell: float, cfg: FilterConfig, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Target row, source row, first and last offset of every pair of rows of one scale, for target rows [lo, hi)."""
    i, j = np.nonzero(_row_sets(grid, ell, cfg, lo, hi))
    i = i + lo
    m, n = lon_reach(grid, i, j, ell, cfg), grid.nlon
    if not cfg.periodic_x:
        return i, j, np.maximum(-m, 1 - n), np.minimum(m - 1, n - 1)
    whole = 2 * m >= n
    return i, j, np.where(whole, -(n // 2), -m), np.where(whole, n - n // 2 - 1, m - 1)


def windows(grid: Grid, scales: list[float], cfg: FilterConfig) -> list[tuple[float, int, int, int, int]]:
    """(scale, target row, source row, first offset, last offset): one row per pair of rows, of the axes' size."""
    return [(ell, *map(int, row)) for ell in scales for row in zip(*window_arrays(grid, ell, cfg), strict=True)]


def pairs_per_slice(grid: Grid, scales: list[float], cfg: FilterConfig) -> int:
    """Pairs of target and source that one slice in time and depth has."""
    return grid.nlon * sum(int((hi - lo + 1).sum()) for *_, lo, hi in (window_arrays(grid, ell, cfg) for ell in scales))


# ---------------------------------------------------------------- kernels over arrays


def numpy_kernel(d: np.ndarray, name: str) -> np.ndarray:
    """The kernels over arrays of D."""
    if name == "tophat":
        return (d < 1).astype(float)
    if name == "hypergaussian":
        return np.exp(-(d**4))
    if name == "gaussian":
        return np.exp(-(d**2))
    if name == "johnsongaussian":
        return np.exp(-(d**2) / 8)
    if name == "sinc":
        return np.sinc(d)
    smooth = 0.5 * (1 - np.tanh((d - 1) / 0.1))
    return smooth if name == "smoothhat" else smooth - 0.21534029041474162 * np.exp(-(((d - 1) / 0.5) ** 2))


def numpy_slopes(d: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the kernels by D."""
    if name == "tophat":
        return np.zeros_like(d), np.zeros_like(d)
    if name == "hypergaussian":
        e = np.exp(-(d**4))
        return -4 * d**3 * e, (16 * d**6 - 12 * d**2) * e
    if name in ("gaussian", "johnsongaussian"):
        a = 1.0 if name == "gaussian" else 0.125
        e = np.exp(-a * d**2)
        return -2 * a * d * e, (4 * a * a * d**2 - 2 * a) * e
    if name == "sinc":
        safe = np.where(d == 0, 1.0, d)
        first = np.where(d == 0, 0.0, (np.cos(np.pi * d) - np.sinc(d)) / safe)
        return first, np.where(d == 0, -(np.pi**2) / 3, -(np.pi**2) * np.sinc(d) - 2 * first / safe)
    t = np.tanh((d - 1) / 0.1)
    first, second = -5.0 * (1 - t * t), 100.0 * t * (1 - t * t)
    if name == "smoothhat":
        return first, second
    y = (d - 1) / 0.5
    g = 0.21534029041474162 * np.exp(-(y**2))
    return first + 4 * y * g, second - (16 * y**2 - 8) * g


# ---------------------------------------------------------------- units of work


def plan_units(grid: Grid, scales: list[float], cfg: FilterConfig, parallel: int, planes: int) -> list[list[tuple[float, int, int]]]:
    """Units of (scale, first row, last row + 1), each with about as many pairs of cells to weigh as one task should have."""
    loads = [np.bincount(window_arrays(grid, ell, cfg)[0], minlength=grid.nlat) * grid.nlon for ell in scales]
    total = sum(int(x.sum()) for x in loads)
    most = max(cfg.unit_pairs // 10, min(cfg.unit_pairs, total // max(1, parallel)))
    units: list[list[tuple[float, int, int]]] = [[]]
    held = 0
    for ell, load in zip(scales, loads, strict=True):
        lo = 0
        for i, x in enumerate(load):
            if held and held + x > most:
                if i > lo:
                    units[-1].append((ell, lo, i))
                units.append([])
                lo, held = i, 0
            held += int(x)
        if lo < grid.nlat:
            units[-1].append((ell, lo, grid.nlat))
    return [u for u in units if u]


def unit_rows(grid: Grid, unit: list[tuple[float, int, int]], cfg: FilterConfig) -> np.ndarray:
    """Source rows that a unit reads, in order."""
    need = np.zeros(grid.nlat, bool)
    for ell, lo, hi in unit:
        need |= _row_sets(grid, ell, cfg, lo, hi).any(axis=0)
    return np.flatnonzero(need)


_kept: dict[tuple, tuple] = {}


def _weights(grid: Grid, cfg: FilterConfig, ell: float, lo: int, hi: int, derivatives: bool) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Source rows of target rows [lo, hi), the transformed weights (frequency, target, source row) of the kernel and, if asked, of its derivatives by scale, and their sums over offsets and source rows."""
    key = (grid, cfg, ell, lo, hi, derivatives)
    if key in _kept:
        return _kept[key]
    n, lats = grid.nlon, np.array(grid.lats)
    i, j, first, last = window_arrays(grid, ell, cfg, lo, hi)
    rows = np.unique(j)
    place = np.searchsorted(rows, j)
    bounds = np.zeros((2, hi - lo, len(rows)), int)
    bounds[0], bounds[1] = 1, 0
    bounds[0, i - lo, place], bounds[1, i - lo, place] = first, last
    size = n if cfg.periodic_x else 2 * n
    off = (np.arange(size) + size // 2) % size - size // 2
    inside = (off >= bounds[0][:, :, None]) & (off <= bounds[1][:, :, None])
    a, b = lats[lo:hi, None], lats[rows][None, :]
    if cfg.cartesian:
        dy, dx = np.abs(a - b), np.abs(off * grid.dlon)
        dy = np.minimum(dy, grid.dlat * grid.nlat - dy) if cfg.periodic_y else dy
        dist = np.sqrt(dy[:, :, None] ** 2 + dx**2)
    else:
        arc = (np.sin(a) * np.sin(b))[:, :, None] + (np.cos(a) * np.cos(b))[:, :, None] * np.cos(off * grid.dlon)
        dist = cfg.earth_radius * np.arccos(np.clip(arc, -1, 1, out=arc), out=arc)
        dist[(np.arange(lo, hi)[:, None] == rows[None, :])[:, :, None] & (off == 0)] = 0.0
    area = np.array(grid.areas(cfg))[rows][None, :, None] * inside
    d = dist / (ell / 2)
    parts = [numpy_kernel(d, cfg.kernel)]
    if derivatives:
        k1, k2 = numpy_slopes(d, cfg.kernel)
        parts += [k1 * (-2 * dist / ell**2), k2 * (4 * dist**2 / ell**4) + k1 * (4 * dist / ell**3)]
    sums, spectra = [], []
    for part in parts:
        part *= area
        sums.append(part.sum(axis=(1, 2)))
        # Target t sums w[o] source[t + o]: a correlation, so that the weights' transform is conjugated.
        spectra.append(np.ascontiguousarray(np.fft.rfft(part, axis=2).conj().transpose(2, 0, 1)))
    out = rows, spectra, sums
    if sum(s.nbytes for s in spectra) + sum(sum(s.nbytes for s in v[1]) for v in _kept.values()) <= KEPT_BYTES:
        _kept[key] = out
    return out


def _chunks(grid: Grid, cfg: FilterConfig, ell: float, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Runs of target rows whose weights fit the bound."""
    reach = int(_row_sets(grid, ell, cfg, lo, hi).sum(axis=1).max())
    step = max(1, MADE_BYTES // (8 * max(1, reach) * grid.nlon * (1 if cfg.periodic_x else 2)))
    for a in range(lo, hi, step):
        yield a, min(hi, a + step)


class _Slice:
    """The planes of one group of cells, and their sums under the weights of a scale."""

    def __init__(self, table: pa.Table, grid: Grid, rows: np.ndarray, fields: list[str], weight: bool, cfg: FilterConfig):
        self.grid, self.cfg, self.rows, self.fields = grid, cfg, rows, fields
        shape = (len(rows), grid.nlon)
        i = np.searchsorted(rows, table["ilat"].to_numpy())
        j = table["ilon"].to_numpy()

        def plane(name: str) -> np.ndarray:
            out, values = np.zeros(shape), table[name].to_numpy()
            out[i, j] = np.where(np.isnan(values), 0.0, values)
            return out

        there = np.zeros(shape)
        there[i, j] = 1
        wet = plane("__wet")
        values = np.stack([plane(f) for f in fields])
        rho = plane("__rho") if weight else None
        below = (wet if cfg.deform_around_land else there) * (rho if weight else 1)
        plain = wet if cfg.deform_around_land else there
        # Where all cells count alike, sums of weights serve as denominators and need no transform.
        self.even = bool(cfg.periodic_x and not weight and (plain == 1).all() and len(rows))
        self.size = grid.nlon if cfg.periodic_x else 2 * grid.nlon
        turn = lambda x: np.ascontiguousarray(np.fft.rfft(x, self.size, axis=2).transpose(2, 1, 0))
        main = values * rho if weight else values
        self.main = turn(main if self.even else np.concatenate((main, below[None])))
        same = not weight
        self.plain = self.main if same else turn(np.concatenate((values, plain[None])))

    def sums(self, ell: float, lo: int, hi: int, derivatives: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """For the kernel and its derivatives: sums of fields (field, target row, column) and of what stands below."""
        rows, spectra, total = _weights(self.grid, self.cfg, ell, lo, hi, derivatives)
        at = np.searchsorted(self.rows, rows)
        out = []
        for k, (w, t) in enumerate(zip(spectra, total, strict=True)):
            planes = (self.main if k == 0 else self.plain)[:, at, :]
            found = np.fft.irfft(np.matmul(w, planes), self.size, axis=0)[: self.grid.nlon].transpose(2, 1, 0)
            n = len(self.fields)
            out.append((found[:n], np.broadcast_to(t[:, None], found.shape[1:]) if self.even else found[n]))
        return out


def _ratio(a: np.ndarray, b: np.ndarray, tiny: float = 0.0) -> np.ndarray:
    """a / b, 0 where b is nothing but rounding."""
    none = np.abs(b) <= tiny
    return np.where(none, 0.0, a / np.where(none, 1.0, b))


def _grown(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Means of fields, and, given the sums of the kernel's derivatives, their first and second derivatives by scale and those of the kernel."""
    (s, s0), *rest = parts
    mean = _ratio(s, s0[None], 1e-13 * float(np.abs(s0).max(initial=0.0)))
    if not rest:
        return mean, []
    (sa, s1), (sb, s2) = rest
    tiny = 1e-13 * float(np.abs(s0).max(initial=0.0))
    k1, k2 = _ratio(s1, s0, tiny), _ratio(s2, s0, tiny)
    # (s1f / s1 - mean) k1 = (s1f - mean s1) / s0, which holds where s1 is 0 as well.
    first = _ratio(sa - mean * s1[None], s0[None], tiny)
    second = _ratio(sb - mean * s2[None], s0[None], tiny) - 2 * first * k1[None]
    return mean, [first, second, k1, k2]


def coarse_grain(cells: DataFrame, grid: Grid, scales: list[float], fields: list[str], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, weight: str | None = None, derivatives: bool = False, water: str | None = None) -> DataFrame:
    """(ell, keys, ilat, ilon, <fields>[, dl_, dll_ of each field, dl_kernel, dll_kernel]).

    cells is dense: land rows are there, as nulls or with the boolean column `water`
    false. Land adds nothing above; below it counts, unless cfg.deform_around_land.
    weight: a column that weighs both sums (Favre means). Without any weight the mean is 0.
    """
    keys = ["itime", "idepth"] if keys is None else keys
    scales, spark = check_scales(scales), cells.sparkSession
    if len(fields) > 1 and grid.nlat * grid.nlon * 8 * 4 * len(fields) > cfg.unit_bytes:
        # Too many planes for one task's memory: half of the fields at a time.
        half = len(fields) // 2
        parts = [coarse_grain(cells, grid, scales, own, cfg, keys, weight, derivatives, water) for own in (fields[:half], fields[half:])]
        parts[1] = parts[1].drop("dl_kernel", "dll_kernel")
        both = parts[0].join(parts[1], ["ell", *keys, "ilat", "ilon"])
        order = [*fields, *([f"{p}_{f}" for f in fields for p in ("dl", "dll")] + ["dl_kernel", "dll_kernel"] if derivatives else [])]
        return both.select("ell", *keys, "ilat", "ilon", *order)
    here = F.col(water) if water else F.lit(True)
    source = cells.select(*keys, "ilat", "ilon", F.coalesce(here, F.lit(False)).cast("double").alias("__wet"), *([F.col(weight).cast("double").alias("__rho")] if weight else []), *[F.when(here, F.col(f)).cast("double").alias(f) for f in fields])
    units = plan_units(grid, scales, cfg, spark.sparkContext.defaultParallelism if hasattr(spark, "sparkContext") else 8, len(fields))
    needed = [unit_rows(grid, u, cfg) for u in units]
    if len(units) > 1:
        # Of the size of an axis times the units, known beforehand.
        table = spark.createDataFrame([(int(i), k) for k, rows in enumerate(needed) for i in rows], "ilat int, __unit int")
        source = source.join(F.broadcast(table), "ilat")
    else:
        source = source.withColumn("__unit", F.lit(0))
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    names = [*fields, *([f"{p}_{f}" for f in fields for p in ("dl", "dll")] + ["dl_kernel", "dll_kernel"] if derivatives else [])]
    schema = ", ".join(["ell double", *[f"`{k}` {types[k]}" for k in keys], "ilat int, ilon int", *[f"`{n}` double" for n in names]])

    def one(table: pa.Table) -> pa.Table:
        unit = table["__unit"][0].as_py()
        own = _Slice(table, grid, needed[unit], fields, weight is not None, cfg)
        out: list[pa.Table] = []
        for ell, lo, hi in units[unit]:
            for a, b in _chunks(grid, cfg, ell, lo, hi):
                mean, more = _grown(own.sums(ell, a, b, derivatives))
                n = (b - a) * grid.nlon
                flat = lambda x: pa.array(np.ascontiguousarray(x).reshape(-1))
                columns = [pa.array(np.full(n, ell)), *[pa.array([table[k][0].as_py()] * n, table.schema.field(k).type) for k in keys]]
                columns += [pa.array(np.repeat(np.arange(a, b, dtype=np.int32), grid.nlon)), pa.array(np.tile(np.arange(grid.nlon, dtype=np.int32), b - a))]
                columns += [flat(x) for x in mean]
                if more:
                    first, second, k1, k2 = more
                    columns += [flat(x) for k in range(len(fields)) for x in (first[k], second[k])] + [flat(k1), flat(k2)]
                out.append(pa.Table.from_arrays(columns, names=["ell", *keys, "ilat", "ilon", *names]))
        return pa.concat_tables(out)

    return source.groupBy(*keys, "__unit").applyInArrow(one, schema)


# ---------------------------------------------------------------- the same as a join


def _lengths(grid: Grid) -> tuple[float, float]:
    return grid.dlon * grid.nlon, grid.dlat * grid.nlat


def stencil(spark: SparkSession, grid: Grid, scales: list[float], cfg: FilterConfig, derivatives: bool = False) -> tuple[DataFrame, int]:
    """Table (ell, ilat, jlat, doff, w[, w1, w2]) of kernel times source area, and its number of rows."""
    rows = windows(grid, check_scales(scales), cfg)
    areas = grid.areas(cfg)
    size = sum(hi - lo + 1 for *_, lo, hi in rows)
    pairs = spark.createDataFrame([(ell, i, j, grid.lats[i], grid.lats[j], areas[j], lo, hi) for ell, i, j, lo, hi in rows], "ell double, ilat int, jlat int, lat1 double, lat2 double, area double, lo int, hi int")
    offsets = pairs.select("*", F.explode(F.sequence("lo", "hi")).alias("doff")).withColumn("dlon", F.col("doff") * F.lit(grid.dlon))
    offsets = offsets.withColumn("dist", F.expr(geometry.distance("lat1", "lat2", "dlon", cfg, *_lengths(grid))))
    columns = ["ell", "ilat", "jlat", "doff", (F.expr(kernels.kernel("dist", "ell", cfg)) * F.col("area")).alias("w")]
    if derivatives:
        k1, k2 = kernels.kernel_derivatives("dist", "ell", cfg)
        columns += [(F.expr(k1) * F.col("area")).alias("w1"), (F.expr(k2) * F.col("area")).alias("w2")]
    return offsets.select(*columns), size


def coarse_grain_pairs(cells: DataFrame, grid: Grid, scales: list[float], fields: list[str], cfg: FilterConfig = FilterConfig(), keys: list[str] | None = None, weight: str | None = None, derivatives: bool = False, water: str | None = None) -> DataFrame:
    """As coarse_grain(), by an equi-join of cells and stencil on the source row and one aggregation."""
    keys = ["itime", "idepth"] if keys is None else keys
    table, size = stencil(cells.sparkSession, grid, scales, cfg, derivatives)
    table = table.withColumnsRenamed({"w": "__w", "w1": "__w1", "w2": "__w2"})
    here = F.col(water) if water else F.lit(True)
    source = cells.select(*keys, F.col("ilat").alias("jlat"), F.col("ilon").alias("jlon"), here.alias("__wet"), *([F.col(weight).alias("__rho")] if weight else []), *[F.when(here, F.col(f)).alias(f) for f in fields])
    joined = source.join(F.broadcast(table) if size <= BROADCAST_ROWS else table, "jlat")
    target = F.pmod(F.col("jlon") - F.col("doff"), F.lit(grid.nlon)) if cfg.periodic_x else F.col("jlon") - F.col("doff")
    joined = joined.withColumn("ilon", target.cast("int"))
    if not cfg.periodic_x:
        joined = joined.where(F.col("ilon").between(0, grid.nlon - 1))
    rho = F.coalesce(F.col("__rho"), F.lit(0.0)) if weight else F.lit(1.0)
    below = (lambda w: F.sum(F.when(F.col("__wet"), w).otherwise(0.0))) if cfg.deform_around_land else F.sum
    sums = [below(F.col("__w") * rho).alias("__s0")]
    sums += [F.sum(F.col("__w") * rho * F.coalesce(F.col(f), F.lit(0.0))).alias(f"__s_{f}") for f in fields]
    if derivatives:
        sums += [below(F.col("__w1")).alias("__s1"), below(F.col("__w2")).alias("__s2")]
        for k in (1, 2):
            sums += [F.sum(F.col(f"__w{k}") * F.coalesce(F.col(f), F.lit(0.0))).alias(f"__s{k}_{f}") for f in fields]
    out = joined.groupBy("ell", *keys, "ilat", "ilon").agg(*sums)
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    columns = ["ell", *keys, "ilat", "ilon", *[ratio(f"__s_{f}", "__s0").alias(f) for f in fields]]
    if derivatives:
        k1, k2 = ratio("__s1", "__s0"), ratio("__s2", "__s0")
        for f in fields:
            mean = ratio(f"__s_{f}", "__s0")
            grow = lambda k, f=f, mean=mean: F.when(F.col("__s0") == 0, F.lit(0.0)).otherwise((F.col(f"__s{k}_{f}") - mean * F.col(f"__s{k}")) / F.col("__s0"))
            columns += [grow(1).alias(f"dl_{f}"), (grow(2) - 2 * grow(1) * k1).alias(f"dll_{f}")]
        columns += [k1.alias("dl_kernel"), k2.alias("dll_kernel")]
    return out.select(*columns)
