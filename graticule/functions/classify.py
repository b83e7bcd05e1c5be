"""Variable names to categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark a category. Categories are tried from top to bottom.
TEMPERATURE = ["temp", "tas", "t2m", "tmax", "tmin", "tasmax", "tasmin", "air_temp", "t_ref", "2m_temperature"]
RAINFALL = ["pr", "precip", "rain", "prc", "prcp", "tp", "precipitation"]
WIND = ["uas", "vas", "u10", "v10", "wind", "wnd", "sfcwind", "u_wind", "v_wind", "ws"]
HUMIDITY = ["hurs", "huss", "rh", "humid", "q2m", "specific_humidity", "relative_humidity"]
SNOW = ["snw", "snd", "snowfall", "snow_depth", "snc", "snowcover", "snow"]

# Substrings that mark the eastward and the northward wind component.
WIND_U = ["uas", "u10", "u_wind"]
WIND_V = ["vas", "v10", "v_wind"]

CATEGORY_KEYS = {
    "temperature": TEMPERATURE,
    "rainfall": RAINFALL,
    "wind": WIND,
    "humidity": HUMIDITY,
    "snow": SNOW,
}
GENERAL = "general"


def contains_any(name: Column, keys: Sequence[str]) -> Column:
    """True when the lowercased name contains one of the keys."""
    return F.lower(name).rlike("|".join(keys))


def category(name: Column) -> Column:
    """First category with a matching key, else general."""
    found = F.when(F.lit(False), F.lit(GENERAL))
    for label, keys in CATEGORY_KEYS.items():
        found = found.when(contains_any(F.trim(name), keys), F.lit(label))
    return found.otherwise(F.lit(GENERAL))


def category_label(category: Column) -> Column:
    """Display label of a category."""
    return F.initcap(category)
