"""Display values and linear light as column expressions (IEC 61966-2-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the standard ------------------------------------------------
DISPLAY_KNEE, LIGHT_KNEE = 0.04045, 0.0031308
SLOPE, SCALE, OFFSET, POWER = 12.92, 1.055, 0.055, 2.4
# ---------------------------------------------------------------------------------


def linear_light(display: Column) -> Column:
    """Linear light of a display value between 0 and 1."""
    return F.when(display <= DISPLAY_KNEE, display / SLOPE).otherwise(F.pow((display + OFFSET) / SCALE, F.lit(POWER)))


def display_value(light: Column) -> Column:
    """Display value of linear light; light outside 0 to 1 is clipped first."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), light))
    return F.when(inside <= LIGHT_KNEE, inside * SLOPE).otherwise(F.pow(inside, F.lit(1 / POWER)) * SCALE - OFFSET)
