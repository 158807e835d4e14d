"""Sea-water density and temperature as SQL text."""

from __future__ import annotations

#: Fixed values of the UNESCO equation of state, as rounded by its users: powers of temperature, ascending, by term.
DENSITY_FRESH = (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
DENSITY_S = (8.2449e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
DENSITY_S15 = (-5.7246e-3, 1.0227e-4, -1.6546e-6)
DENSITY_S2 = (4.8314e-4,)
BULK_FRESH = (19652.21, 148.4206, -2.327105, 1.360477e-2, -5.155288e-5)
BULK_S = (54.6746, -0.603459, 1.09987e-2, -6.1670e-5)
BULK_S15 = (7.944e-2, 1.6483e-2, -5.3009e-4)
BULK_P = (3.23990, 1.43714e-3, 1.16092e-4, -5.77905e-7)
BULK_PS = (2.2838e-3, -1.0981e-5, -1.6078e-6)
BULK_PS15 = (1.91075e-4,)
BULK_P2 = (8.50935e-5, -6.12293e-6, 5.2787e-8)
BULK_P2S = (-9.9348e-7, 2.0816e-8, 9.1697e-10)


def _poly(c: tuple[float, ...], t: str) -> str:
    out = repr(c[-1])
    for x in c[-2::-1]:
        out = f"({x!r} + {t} * {out})"
    return out


def density(t: str, s: str, p: str) -> str:
    """Density in kg/m3 from temperature in C, salinity in psu and pressure in bar."""
    root = f"sqrt({s})"
    surface = f"({_poly(DENSITY_FRESH, t)} + {s} * {_poly(DENSITY_S, t)} + {s} * {root} * {_poly(DENSITY_S15, t)} + {s} * {s} * {_poly(DENSITY_S2, t)})"
    k0 = f"({_poly(BULK_FRESH, t)} + {s} * {_poly(BULK_S, t)} + {s} * {root} * {_poly(BULK_S15, t)})"
    k1 = f"({_poly(BULK_P, t)} + {s} * {_poly(BULK_PS, t)} + {s} * {root} * {_poly(BULK_PS15, t)})"
    k2 = f"({_poly(BULK_P2, t)} + {s} * {_poly(BULK_P2S, t)})"
    return f"({surface} / (1 - {p} / ({k0} + {p} * {k1} + {p} * {p} * {k2})))"


#: Reference temperature (K), specific volume, expansion, heat capacity, compressibility, thermobaric coefficient.
T0, ALPHA0, BETA_T, CP0, GAMMA, BETA_T_STAR = 283, 9.738e-4, 1.67e-4, 3986.0, 1.1e-8, 1.00e-5


def temperature(p: str, theta: str) -> str:
    """In-situ temperature (C) from pressure and potential temperature (C)."""
    c1, c2 = T0 * ALPHA0 * BETA_T / CP0, T0 * ALPHA0 * BETA_T_STAR / CP0
    return f"({c1!r} * {p} * (1 + {GAMMA / 2!r} * {p} + {c2!r} * {p}) + ({theta} + 273.15 - {T0}) * (1 + {c2!r} * {p}) + {T0} - 273.15)"
