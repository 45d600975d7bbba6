"""Affine scales of measurement."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Scale:
    """``size`` of a unit and where its ``zero`` lies, both in the base unit."""

    size: float
    zero: float = 0.0


#: Fixed values. Temperatures are counted from absolute zero.
SCALES = {"Kelvin": Scale(1.0), "Celcius": Scale(1.0, -273.15), "Farenheight": Scale(5 / 9, -459.67), "Meter": Scale(1.0), "KiloMeter": Scale(1000.0)}


def converter(source: Scale, target: Scale) -> tuple[float, float]:
    """(factor, offset): a value becomes ``value * factor - offset``. Zeros count in their own units."""
    factor = source.size / target.size
    return factor, source.zero * factor - target.zero
