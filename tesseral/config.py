"""Run-time configuration of a scale decomposition."""

from __future__ import annotations

from dataclasses import dataclass

#: Support of each kernel in units of half its scale; negative is the whole domain.
KERNEL_PAD = {"tophat": 1.1, "hypergaussian": 2.5, "gaussian": 5.0, "johnsongaussian": 15.0, "sinc": -1.0, "smoothhat": 2.5, "highorder": 2.5}


@dataclass(frozen=True)
class FilterConfig:
    """Physical constants and switches. Compatibility is checked on construction; a clash raises ValueError.

    unit_pairs: pairs of cells that one task weighs, about; unit_bytes: bytes of fields that one task holds, about.
    """

    earth_radius: float = 6371e3
    rho0: float = 1025.0
    gravity: float = 9.81
    kernel: str = "gaussian"
    order: int = 4
    cartesian: bool = False
    periodic_x: bool = True
    periodic_y: bool = False
    uniform_lat: bool = True
    high_precision_distance: bool = False
    deform_around_land: bool = False
    filter_over_land: bool = True
    zonal_kernel_only: bool = False
    extend_to_poles: bool = False
    postprocess: bool = True
    full_outputs: bool = True
    unit_pairs: int = 200_000_000
    unit_bytes: int = 1 << 30

    def __post_init__(self) -> None:
        if self.kernel not in KERNEL_PAD:
            raise ValueError(f"unknown kernel {self.kernel!r}; known: {sorted(KERNEL_PAD)}")
        if self.order not in (2, 3, 4, 6):
            raise ValueError("derivatives have order 2, 3, 4 or 6")
        if not self.uniform_lat and self.order != 2:
            raise ValueError("a latitude axis that is not uniform has derivatives of order 2 only")
        if self.periodic_y and not self.uniform_lat:
            raise ValueError("a periodic y axis must be uniform")
        if not (self.postprocess or self.full_outputs):
            raise ValueError("neither full outputs nor post-processing is asked for")
        if self.cartesian and self.extend_to_poles:
            raise ValueError("a plane has no poles to extend to")

    @property
    def pad(self) -> float:
        return KERNEL_PAD[self.kernel]


def check_scales(scales: list[float]) -> list[float]:
    """Positive filter scales in metres, as given."""
    out = [float(s) for s in scales]
    if not out or min(out) <= 0:
        raise ValueError("filter scales must be positive")
    return out
