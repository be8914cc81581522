"""Scores of a control profile (motion, muscle, hold time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clamp01, col, r6


def profile_scores(motion, muscle, hold_ms) -> list[Column]:
    """Energy, density, legato and the packed signature of 4-bit parts."""
    m, e, h = clamp01(motion), clamp01(muscle), col(hold_ms)
    nibble = lambda x: F.least(F.lit(15), F.greatest(F.lit(0), F.rint(x).cast("bigint")))
    signature = F.shiftleft(nibble(m * 15), 8).bitwiseOR(F.shiftleft(nibble(e * 15), 4)).bitwiseOR(nibble(h / 100.0))
    return [r6(clamp01(0.55 * m + 0.45 * e), "energy"), r6(clamp01(0.7 * m + 0.3 * e), "density"),
            r6(clamp01(h / 1400.0), "legato"), signature.alias("signature")]
