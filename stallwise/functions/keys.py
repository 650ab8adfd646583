"""Canonical keys of segments between bars, and the specs beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric specs whose difference tells two products apart.
NUMERIC_SPECS = "storage_gb ram_gb screen_mm screen_inches size_inches volume_ml capacity_liters mass_g capacity_kg capacity_ah capacity_mah power_w watts voltage_v battery_mah energy_wh length_mm burners slots megapixels".split()


def depth(key: Column) -> Column:
    """Number of bars in the key."""
    return F.size(F.split(key, r"\|")) - 1


def loosely_equal(a: Column, b: Column) -> Column:
    """Equal but for hyphens and blanks."""
    return F.regexp_replace(a, "[- ]", "") == F.regexp_replace(b, "[- ]", "")


def numeric_conflict(a: Column, b: Column) -> Column:
    """Whether two specs in JSON both state a number of one name and differ in it."""
    pairs = [(F.get_json_object(a, f"$.{n}").try_cast("double"), F.get_json_object(b, f"$.{n}").try_cast("double")) for n in NUMERIC_SPECS]
    found = F.lit(False)
    for x, y in pairs:
        found = found | F.coalesce(x != y, F.lit(False))
    return found


def positional_conflict(a: Column, b: Column) -> Column:
    """Whether a segment at the same place differs in its figures: both all figures, or both with letters and figures."""
    sides = F.arrays_zip(F.split(a, r"\|").alias("x"), F.split(b, r"\|").alias("y"))

    def differs(p: Column) -> Column:
        x, y = p["x"], p["y"]
        digits = x.rlike("^[0-9]+$") & y.rlike("^[0-9]+$") & (x != y)
        mixed = x.rlike("[a-z]") & x.rlike("[0-9]") & y.rlike("[a-z]") & y.rlike("[0-9]")
        runs = F.array_join(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), "-") != F.array_join(F.regexp_extract_all(y, F.lit("[0-9]+"), F.lit(0)), "-")
        return F.coalesce(digits | (mixed & runs), F.lit(False))

    return F.exists(sides, differs)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers of the same length, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
