"""Names derived from names: slugs, variable types, units, site ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import UNITS


def slug(name: Column) -> Column:
    """Lower-case id; every other character becomes one underscore, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def site_of_corner(location_id: Column) -> Column:
    """Site a grid-corner location belongs to (`site__model__cN` -> `site`)."""
    return F.split_part(location_id, F.lit("__"), F.lit(1))


# Substring -> physical type, first match wins.
VARIABLE_TYPES = (
    ("temp", "temperature"),
    ("precip", "precipitation"),
    ("humid", "humidity"),
    ("pres", "pressure"),
    ("wind", "wind"),
)


def variable_type(variable: Column) -> Column:
    name = F.lower(variable)
    out = F.lit(None).cast("string")
    for part, kind in reversed(VARIABLE_TYPES):
        out = F.when(name.contains(part), F.lit(kind)).otherwise(out)
    return out


def variable_units(variable: Column) -> Column:
    bare = F.regexp_replace(variable, "_error$", "")
    out = F.lit("units")
    for name, unit in UNITS.items():
        out = F.when(bare == name, F.lit(unit)).otherwise(out)
    return out
