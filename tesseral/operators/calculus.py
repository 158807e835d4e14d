"""Finite differences that avoid land, for any number of columns at once.

Per cell, the contiguous water on either side gives a stencil of order + derivative
points, as centred as it can be; where too little water is there the order falls by
two. Coefficients follow from the moment conditions, they are no tables.

derivatives() takes a slice of the mesh, or a band of its rows with the rows beside
them that a stencil may reach, as one group and differentiates all fields along both
axes in one pass: one shuffle, and expressions whose number does not grow with the
fields. differentiate() works along lines of any kind by window functions.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bytes of fields and derivatives that one group holds, about.
BAND_BYTES = 512 << 20


@cache
def coefficients(points: tuple[int, ...], derivative: int) -> tuple[Fraction, ...]:
    """Weights of values at integer offsets for a derivative at offset 0, exact for polynomials below len(points)."""
    n = len(points)
    rows = [[Fraction(p) ** k for p in points] + [Fraction(0)] for k in range(n)]
    rows[derivative][n] = Fraction(1)
    for k in range(2, derivative + 1):
        rows[derivative][n] *= k
    for i in range(n):
        at = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return tuple(r[n] for r in rows)


def stencil_cases(order: int, derivative: int) -> list[tuple[int, list[tuple[int, tuple[float, ...]]]]]:
    """For each order from the asked one down: its points, and per number of points on the left the weights."""
    out = []
    for p in range(order, 0, -2):
        n = p + derivative
        out.append((n, [(left, tuple(float(c) for c in coefficients(tuple(range(-left, n - left)), derivative))) for left in range(n)]))
    return out


def derivative_sql(order: int, derivative: int, left: str, right: str, value: str, delta: float) -> str:
    """SQL text of a derivative: left and right name the water cells on either side, value.format(k=) the value at offset k (as m2, p0, p1 ...)."""
    name = lambda k: value.format(k=f"m{-k}" if k < 0 else f"p{k}")
    whens = []
    for n, rows in stencil_cases(order, derivative):
        half = (n - 1) // 2
        taken = f"least(least({left}, {n}), greatest({half}, {n - 1} - least({right}, {n})))"
        for k, weights in rows:
            terms = " + ".join(f"{w / delta**derivative!r} * {name(i - k)}" for i, w in enumerate(weights) if w)
            whens.append(f"when {left} + {right} >= {n - 1} and {taken} = {k} then {terms}")
    return f"(case {' '.join(whens)} else 0.0 end)"


def reach(order: int, derivative: int) -> int:
    """Cells on either side that a derivative may use."""
    return order + derivative


def run_sql(water: str, most: int, sign: str) -> str:
    """SQL text that counts contiguous water cells on one side; water.format(k=) is null or false for land and beyond the grid."""
    return "(case " + " ".join(f"when not coalesce({water.format(k=f'{sign}{k}')}, false) then {k - 1}" for k in range(1, most + 1)) + f" else {most} end)"


def differentiate(cells: DataFrame, axis: str, n: int, delta: float, fields: dict[str, str], keys: list[str], order: int = 4, derivative: int = 1, periodic: bool = False, water: str | None = None) -> DataFrame:
    """cells with one more column per field: fields maps new names to columns. keys: the other axes, which name a line.

    A cell on land still gets the derivative from the water beside it, as its own value is part of the stencil; callers mask results where they must.
    An axis of length 1 has derivative 0.
    """
    if n == 1:
        return cells.select("*", *[F.lit(0.0).alias(new) for new in fields])
    m = reach(order, derivative)
    wet = F.col(water) if water else F.lit(True)
    df = cells.withColumn("__wet", wet).withColumn("__at", F.col(axis))
    if periodic:
        copies = [F.lit(0), F.when(F.col(axis) >= n - m, F.lit(-n)), F.when(F.col(axis) < m, F.lit(n))]
        df = df.withColumn("__shift", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull()))).withColumn("__at", F.col(axis) + F.col("__shift"))
    line = Window.partitionBy(*keys).orderBy("__at")

    def beside(c: str, k: int) -> Column:
        return F.lag(c, -k).over(line) if k < 0 else F.lead(c, k).over(line)

    name = lambda k: f"m{-k}" if k < 0 else f"p{k}"
    shifted = []
    for k in range(-m, m + 1):
        if not k:
            continue
        adjacent = beside("__at", k) == F.col("__at") + k
        shifted.append((adjacent & beside("__wet", k)).alias(f"__w_{name(k)}"))
        for i, c in enumerate(fields.values()):
            shifted.append(beside(c, k).alias(f"__f{i}_{name(k)}"))
    df = df.select("*", *[F.col(c).alias(f"__f{i}_p0") for i, c in enumerate(fields.values())], *shifted)
    if periodic:
        df = df.where("__shift = 0")
    df = df.select("*", F.expr(run_sql("__w_{k}", m, "m")).alias("__left"), F.expr(run_sql("__w_{k}", m, "p")).alias("__right"))
    values = [F.expr(derivative_sql(order, derivative, "__left", "__right", f"coalesce(__f{i}_{{k}}, 0.0)", delta)).alias(new) for i, new in enumerate(fields)]
    return df.select(*[f"`{c}`" for c in cells.columns], *values)


def differentiate_uneven(cells: DataFrame, axis: str, coordinate: str, fields: dict[str, str], keys: list[str]) -> DataFrame:
    """Second-order first derivatives along an uneven axis from three points, one-sided at the ends; 0 on axes of fewer."""
    line = Window.partitionBy(*keys).orderBy(axis)
    df = cells
    for k in (-2, -1, 1, 2):
        step = F.lag if k < 0 else F.lead
        df = df.withColumn(f"__x{k}", step(coordinate, abs(k)).over(line))
        for i, c in enumerate(fields.values()):
            df = df.withColumn(f"__v{i}_{k}", step(c, abs(k)).over(line))

    def three(i: int, value: Column, offsets: tuple[int, int, int]) -> Column:
        x = [F.col(coordinate) if k == 0 else F.col(f"__x{k}") for k in offsets]
        v = [value if k == 0 else F.col(f"__v{i}_{k}") for k in offsets]
        at = F.col(coordinate)
        out = F.lit(0.0)
        for a in range(3):
            b, c = [k for k in range(3) if k != a]
            out = out + v[a] * ((at - x[b]) + (at - x[c])) / ((x[a] - x[b]) * (x[a] - x[c]))
        return out

    columns = []
    for i, (new, c) in enumerate(fields.items()):
        value = F.col(c)
        both = F.col("__x-1").isNotNull() & F.col("__x1").isNotNull()
        columns.append(F.when(both, three(i, value, (-1, 0, 1))).when(F.col("__x2").isNotNull(), three(i, value, (0, 1, 2))).when(F.col("__x-2").isNotNull(), three(i, value, (-2, -1, 0))).otherwise(F.lit(0.0)).alias(new))
    return df.select(*[f"`{c}`" for c in cells.columns], *columns)


# ---------------------------------------------------------------- whole slices


def _beside(x: np.ndarray, k: int, periodic: bool, empty: float | bool) -> np.ndarray:
    """The value k places further along the last axis; `empty` beyond the ends of an open one."""
    out = np.roll(x, -k, axis=-1)
    if not periodic and k > 0:
        out[..., x.shape[-1] - min(k, x.shape[-1]) :] = empty
    elif not periodic and k < 0:
        out[..., : min(-k, x.shape[-1])] = empty
    return out


def differences(values: np.ndarray, wet: np.ndarray, order: int, derivative: int, delta: float, periodic: bool) -> np.ndarray:
    """Derivatives of values (field, line, place) along the last axis."""
    n = values.shape[-1]
    out = np.zeros_like(values)
    if n == 1:
        return out
    most = reach(order, derivative)
    left, right = np.zeros(wet.shape, np.int64), np.zeros(wet.shape, np.int64)
    for run, sign in ((left, -1), (right, 1)):
        open_ = np.ones(wet.shape, bool)
        for k in range(1, most + 1):
            open_ &= _beside(wet, sign * k, periodic, False)
            run += open_
    done = np.zeros(wet.shape, bool)
    for points, rows in stencil_cases(order, derivative):
        half = (points - 1) // 2
        fits = ~done & (left + right >= points - 1)
        taken = np.minimum(np.minimum(left, points), np.maximum(half, points - 1 - np.minimum(right, points)))
        for on_left, weights in rows:
            line, place = np.nonzero(fits & (taken == on_left))
            if not len(line):
                continue
            total = np.zeros((len(values), len(line)))
            for k, w in enumerate(weights):
                if w:
                    total += w / delta**derivative * values[:, line, (place + k - on_left) % n]
            out[:, line, place] = total
        done |= fits
    return out


def _bands(grid, halo: int, columns: int, periodic_y: bool) -> list[tuple[int, int, int, bool]]:  # noqa: ANN001
    """(row, band, place in the band, whether the band owns it): bands of rows with `halo` more on either side; one band of all where a slice fits."""
    rows = max(1, BAND_BYTES // (8 * max(1, columns) * grid.nlon))
    if rows >= grid.nlat:
        return []
    out = []
    rows = max(rows, halo)
    for band, lo in enumerate(range(0, grid.nlat, rows)):
        hi = min(grid.nlat, lo + rows)
        for i in range(lo - halo, hi + halo):
            if periodic_y or 0 <= i < grid.nlat:
                out.append((i % grid.nlat, band, i - lo + halo, lo <= i < hi))
    return out


def derivatives(cells: DataFrame, grid, wanted: list[tuple[str, str, str, int]], keys: list[str], order: int = 4, periodic_x: bool = True, periodic_y: bool = False, water: str | None = None) -> DataFrame:  # noqa: ANN001
    """cells with one more column for each of wanted (new name, column, axis ilon or ilat, derivative); a column may be a new name before it.

    Derivatives are by the angle, or by metres on a plane. Cells that are not there count as land. A cell on land still gets the derivative
    from the water beside it; callers mask results where they must.
    """
    depth: dict[str, int] = {}
    for new, field, axis, derivative in wanted:
        depth[new] = depth.get(field, 0) + (reach(order, derivative) if axis == "ilat" else 0)
    fields = list(dict.fromkeys(f for _, f, _, _ in wanted if f not in depth))
    halo = max(depth.values(), default=0)
    bands = _bands(grid, halo, len(fields) + len(wanted), periodic_y)
    columns = cells.columns
    if bands:
        table = cells.sparkSession.createDataFrame(bands, "ilat int, __band int, __row int, __own boolean")
        source = cells.join(F.broadcast(table), "ilat").select(*[F.col(f"`{c}`") for c in columns], "__band", "__row", "__own")
    else:
        source = cells.withColumns({"__band": F.lit(0), "__row": F.col("ilat"), "__own": F.lit(True)})
    height = max((r[2] for r in bands), default=grid.nlat - 1) + 1
    schema = StructType([*cells.schema.fields, *[StructField(new, DoubleType()) for new, *_ in wanted]])
    whole_y = periodic_y and not bands

    def one(table: pa.Table) -> pa.Table:
        i, j = table["__row"].to_numpy(), table["ilon"].to_numpy()
        wet = np.zeros((height, grid.nlon), bool)
        wet[i, j] = True if water is None else table[water].fill_null(False).to_numpy(zero_copy_only=False)
        planes = {}
        for f in fields:
            values = table[f].cast(pa.float64()).to_numpy()
            planes[f] = np.zeros((height, grid.nlon))
            planes[f][i, j] = np.where(np.isnan(values), 0.0, values)
        # Runs of derivatives of one kind whose columns are at hand are taken together.
        todo = list(wanted)
        while todo:
            _, _, axis, derivative = todo[0]
            now = [w for w in todo if w[2:] == (axis, derivative) and w[1] in planes]
            stack = np.stack([planes[f] for _, f, _, _ in now])
            if axis == "ilon":
                found = differences(stack, wet, order, derivative, grid.dlon, periodic_x)
            else:
                found = differences(stack.transpose(0, 2, 1), wet.T, order, derivative, grid.dlat, whole_y).transpose(0, 2, 1)
            for (new, *_), plane in zip(now, found, strict=True):
                planes[new] = plane
            todo = [w for w in todo if w not in now]
        out = table.select(columns)
        for new, *_ in wanted:
            out = out.append_column(new, pa.array(planes[new][i, j]))
        return out.filter(table["__own"]) if bands else out

    return source.groupBy(*keys, "__band").applyInArrow(one, schema)


def spherical_gradients(cells: DataFrame, grid, fields: list[str], keys: list[str], order: int = 4, derivative: int = 1, periodic_x: bool = True, periodic_y: bool = False, water: str | None = None) -> DataFrame:  # noqa: ANN001
    """cells with dlon_<f> and dlat_<f> (d2lon_, d2lat_ for the second derivative) by the angle, or dx and dy on a plane."""
    p = "d" if derivative == 1 else f"d{derivative}"
    wanted = [(f"{p}{axis}_{f}", f, f"i{axis}", derivative) for axis in ("lon", "lat") for f in fields]
    return derivatives(cells, grid, wanted, keys, order, periodic_x, periodic_y, water)


def depth_derivatives(cells: DataFrame, depth: str, fields: list[str], keys: list[str], positive_down: bool = True) -> DataFrame:
    """cells with dr_<f>, the radial derivative from three levels of the column `depth`; positive_down: depth grows downwards."""
    df = differentiate_uneven(cells, "idepth", depth, {f"dr_{f}": f for f in fields}, keys)
    return df.withColumns({f"dr_{f}": -F.col(f"dr_{f}") for f in fields}) if positive_down else df


def cartesian_derivatives(field: str, lon: str = "lon", lat: str = "lat", radius: float = 6371e3, radial: str | None = None) -> tuple[str, str, str]:
    """d/dx, d/dy, d/dz as SQL text from dlon_<field>, dlat_<field> on the sphere, and from the radial derivative if it is named."""
    a, b = f"dlon_{field}", f"dlat_{field}"
    r = repr(radius)
    up = [f" + {e} * {radial}" if radial else "" for e in (f"cos({lon}) * cos({lat})", f"sin({lon}) * cos({lat})", f"sin({lat})")]
    return (
        f"((-sin({lon}) / ({r} * cos({lat}))) * {a} - (cos({lon}) * sin({lat}) / {r}) * {b}{up[0]})",
        f"((cos({lon}) / ({r} * cos({lat}))) * {a} - (sin({lon}) * sin({lat}) / {r}) * {b}{up[1]})",
        f"((cos({lat}) / {r}) * {b}{up[2]})",
    )
