"""Map, globe, comparison and story views of one variable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators import axis, boundary, cube, stats, story
from graticule.spec import DEFAULT, GridSpec


def heatmap(df: DataFrame, index: int = 0, spec: GridSpec = DEFAULT) -> dict[str, DataFrame]:
    """One time step and its colour range."""
    spec.need_space(df)
    cells = axis.time_slice(df, index, spec)
    return {"cells": cells, "range": cube.field_range(cells, spec)}


def globe(df: DataFrame, index: int = 0, boundaries: DataFrame | None = None, spec: GridSpec = DEFAULT) -> dict[str, DataFrame]:
    """One time step on the sphere, with the outlines when there are any."""
    views = {"surface": cube.globe_surface(axis.time_slice(df, index, spec), spec)}
    if boundaries is not None:
        views["outlines"] = boundary.outline_vertices(boundaries)
    return views


def compare(df: DataFrame, first: int, second: int, spec: GridSpec = DEFAULT) -> dict[str, DataFrame]:
    """Two time steps, each with a colour range of its own, in one scan. No difference is taken."""
    spec.need_space(df)
    steps = axis.steps_at(df, F.array(F.lit(first), F.lit(second)), spec)
    label = F.when(F.col("step") == 0, F.lit("A")).otherwise(F.lit("B")).alias("slice")
    cells = story.story_slices(df, steps, spec).select(label, *df.columns)
    return {"cells": cells, "range": cube.field_range(cells, spec, ["slice"])}


def tell_story(df: DataFrame, spec: GridSpec = DEFAULT) -> dict[str, DataFrame]:
    """All steps of the story at once: a frame per step, its cells and its globe."""
    spec.need_space(df)
    steps = story.story_steps(df, spec)
    cells = story.story_slices(df, steps, spec)
    return {
        "frames": story.story_frames(cells, steps, spec),
        "cells": cells,
        "globe": cube.globe_surface(cells, spec, ["step"]),
    }


def distribution(df: DataFrame, spec: GridSpec = DEFAULT) -> dict[str, DataFrame]:
    """Histogram and mean of all values."""
    return {"histogram": stats.histogram(df, spec), "mean": stats.distribution_mean(df, spec)}
