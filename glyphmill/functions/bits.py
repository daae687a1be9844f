"""Bit fields of packed records, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_entry(e: Column) -> dict[str, Column]:
    """Ten bits of tile, two flips, four bits of palette."""
    return {"tile": e.bitwiseAND(1023), "hflip": F.shiftright(e, 10).bitwiseAND(1), "vflip": F.shiftright(e, 11).bitwiseAND(1), "subpal": F.shiftright(e, 12).bitwiseAND(15)}


def five_to_eight(x: Column) -> Column:
    """A five-bit channel by repeating its high bits."""
    return F.shiftleft(x, 3).bitwiseOR(F.shiftright(x, 2))


def five_to_eight_scaled(x: Column) -> Column:
    """A five-bit channel by scaling; it differs from five_to_eight for 15 of 32 values."""
    return F.floor(x * 255 / 31).cast("long")
