"""Filter kernels and their derivatives by scale, as SQL text."""

from __future__ import annotations

import math

from tesseral.config import FilterConfig

_TANH = "((1 - exp(-2 * ({x}))) / (1 + exp(-2 * ({x}))))"


def _shape(name: str, d: str) -> tuple[str, str, str]:
    """K(D), K'(D), K''(D)."""
    if name == "tophat":
        return f"(case when {d} < 1 then 1.0 else 0.0 end)", "0.0", "0.0"
    if name == "hypergaussian":
        e = f"exp(-{d} * {d} * {d} * {d})"
        return f"({e})", f"(-4 * {d} * {d} * {d} * {e})", f"((16 * {d} * {d} * {d} * {d} * {d} * {d} - 12 * {d} * {d}) * {e})"
    if name in ("gaussian", "johnsongaussian"):
        a = 1.0 if name == "gaussian" else 0.125
        e = f"exp({-a!r} * {d} * {d})"
        return f"({e})", f"({-2 * a!r} * {d} * {e})", f"(({4 * a * a!r} * {d} * {d} - {2 * a!r}) * {e})"
    if name == "sinc":
        x = f"({math.pi!r} * {d})"
        one = f"(sin({x}) / {x})"
        first = f"((cos({x}) - {one}) / {d})"
        second = f"(-{math.pi!r} * {math.pi!r} * {one} - 2 * {first} / {d})"
        return tuple(f"(case when {d} = 0 then {at} else {e} end)" for at, e in (("1.0", one), ("0.0", first), (repr(-math.pi**2 / 3), second)))
    t = _TANH.format(x=f"({d} - 1) / 0.1")
    smooth = f"(0.5 * (1 - {t}))", f"(-5.0 * (1 - {t} * {t}))", f"(100.0 * {t} * (1 - {t} * {t}))"
    if name == "smoothhat":
        return smooth
    # Fixed value: the weight for which the second moment vanishes.
    a, y = 0.21534029041474162, f"(({d} - 1) / 0.5)"
    g = f"exp(-{y} * {y})"
    return f"({smooth[0]} - {a!r} * {g})", f"({smooth[1]} + {a!r} * 4.0 * {y} * {g})", f"({smooth[2]} - {a!r} * (16.0 * {y} * {y} - 8.0) * {g})"


def kernel(dist: str, ell: str, cfg: FilterConfig) -> str:
    d = f"(({dist}) / ({ell} / 2))"
    return _shape(cfg.kernel, d)[0]


def kernel_derivatives(dist: str, ell: str, cfg: FilterConfig) -> tuple[str, str]:
    """First and second derivative by the scale."""
    d = f"(({dist}) / ({ell} / 2))"
    _, k1, k2 = _shape(cfg.kernel, d)
    dd, ddd = f"(-2 * ({dist}) / ({ell} * {ell}))", f"(4 * ({dist}) / ({ell} * {ell} * {ell}))"
    return f"({k1} * {dd})", f"({k2} * {dd} * {dd} + {k1} * {ddd})"


def alpha_sums(cfg: FilterConfig) -> tuple[int, float, str]:
    """Points and step of the Riemann sum for the kernel's moment ratio, and the kernel at r for unit scale."""
    n, upper = (100_000, 100.0) if cfg.pad < 0 else (10_000, cfg.pad)
    return n, upper / n, kernel("r", "1.0", cfg)
