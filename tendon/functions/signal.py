"""Window features as array and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clamp01, col, total


def array_median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def diffs(a: Column) -> Column:
    n = F.size(a)
    return F.zip_with(F.slice(a, 2, n - 1), F.slice(a, 1, n - 1), lambda x, y: x - y)


def _turns(a: Column, threshold: Column) -> Column:
    """Neighbour pairs of opposite sign whose step reaches the threshold."""
    n = F.size(a)
    return total(F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), lambda x, y: (
        F.when((x * y < 0) & (F.abs(y - x) >= threshold), 1.0).otherwise(0.0))))


def emg_array_features(arr, names=("rms", "mav", "wl", "zc", "ssc")) -> list[Column]:
    """Per-channel features of one window given as an ordered array."""
    a = col(arr)
    n = F.size(a)
    threshold = F.greatest(array_median(F.transform(a, F.abs)) * 0.1, F.lit(1e-6))
    made = {
        "rms": lambda: F.sqrt(total(F.transform(a, lambda x: x * x)) / n),
        "mav": lambda: total(F.transform(a, F.abs)) / n,
        "wl": lambda: total(F.transform(diffs(a), F.abs)) / (n - 1),
        "zc": lambda: _turns(a, threshold) / (n - 1),
        "ssc": lambda: _turns(diffs(a), threshold) / F.greatest(n - 2, F.lit(1)),
    }
    return [made[x]().alias(x) for x in names]


def rms(x) -> Column:
    return F.sqrt(F.avg(col(x) * col(x)))


def activation(rms_columns) -> Column:
    return clamp01(array_median(F.array(*rms_columns)))


def motion(accel_power: Column, gyro_power: Column) -> Column:
    """0.55 rms|a| + 0.45 rms|g|, clamped; arguments are mean squared norms."""
    return clamp01(0.55 * F.sqrt(accel_power) + 0.45 * F.sqrt(gyro_power))
