"""Row marks: which rows a machine wrote, illustrated or enriched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------
GENERATED, EXAMPLE, ENRICHED, SAME_TEXT = 1, 2, 4, 8
MARK_COLUMNS = {"generated_for": GENERATED, "example_for": EXAMPLE, "enriched_fields": ENRICHED}
MODES = ("train", "exclude")
# -----------------------------------------------------------------------------------------


def mark_bits(available: Sequence[str], mode: str = "train") -> Column:
    """Bitmask of the mark columns that are present; a cell of blanks is no mark."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    total = F.lit(0)
    for column, bit in MARK_COLUMNS.items():
        if column not in available or (bit == EXAMPLE and mode == "exclude"):
            continue
        blank = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", "") == ""
        total = total + F.when(blank, 0).otherwise(bit)
    return total.cast("int")


def has_bit(mark: Column, bit: int) -> Column:
    return mark.bitwiseAND(F.lit(bit)) > 0
