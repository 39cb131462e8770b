"""Density rules: bands, blocking, walking cost, exit offsets, seat zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLOCK_DENSITY = 0.90
AVOID_DENSITY = 0.70
DENSITY_PENALTY = 4.0
EXIT_WINDOW_MINUTES = 5.0
HANDOFF_MINUTES = 1.0


def congestion_band(density: Column) -> Column:
    return (
        F.when(density < 0.35, "low")
        .when(density < 0.60, "moderate")
        .when(density < 0.80, "high")
        .otherwise("critical")
    )


def is_blocked(density: Column) -> Column:
    return density >= BLOCK_DENSITY


def should_avoid(density: Column) -> Column:
    return density > AVOID_DENSITY


def walk_factor(density: Column) -> Column:
    """What the base seconds of an edge are multiplied by when entering a zone."""
    return 1 + DENSITY_PENALTY * (density * density)


def congestion_weight(density: Column) -> Column:
    return 1 + density


def exit_offset_minutes(hops: Column, density: Column) -> Column:
    return hops * congestion_weight(density) * EXIT_WINDOW_MINUTES


def plus_minutes(time: Column, minutes: Column) -> Column:
    """``time`` moved by fractional minutes, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(time) + F.floor(minutes * 60e6 + 0.5))


def order_eta_minutes(wait: Column, walk: Column) -> Column:
    return wait + walk + HANDOFF_MINUTES


def seat_zone(seat_id: Column) -> Column:
    first = F.upper(F.substring(seat_id, 1, 1))
    return (
        F.when(first == "V", "VIP-Lounge").when(first == "U", "Upper-Stands").otherwise("Lower-Stands")
    )
