"""Speeds and directions of currents and winds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per second in a unit.
SPEED_UNITS = {"m/s": 1.0, "ms": 1.0, "km/h": 1 / 3.6, "kmh": 1 / 3.6, "kn": 0.514444, "knots": 0.514444, "kt": 0.514444, "mp/h": 0.44704, "mph": 0.44704}


def speed_factor(unit: str | None) -> float:
    """Metres per second in one ``unit``; no unit counts as metres per second."""
    if not unit:
        return 1.0
    if (key := unit.strip().lower()) not in SPEED_UNITS:
        raise ValueError(f"unknown speed unit {unit!r}")
    return SPEED_UNITS[key]


def uv_towards(speed: Column, deg: Column) -> tuple[Column, Column]:
    """Eastward and northward parts of a current that flows towards ``deg``."""
    return speed * F.sin(F.radians(deg)), speed * F.cos(F.radians(deg))


def uv_from(speed: Column, deg: Column) -> tuple[Column, Column]:
    """Parts of a wind that blows from ``deg``."""
    return -speed * F.sin(F.radians(deg)), -speed * F.cos(F.radians(deg))


def speed_direction(u: Column, v: Column) -> tuple[Column, Column]:
    """Speed, and the direction in [0, 360) that the vector points to."""
    return F.hypot(u, v), F.pmod(F.degrees(F.atan2(u, v)) + 360.0, F.lit(360.0))
