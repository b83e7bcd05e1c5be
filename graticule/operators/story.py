"""Key steps of a record, told as a story: four to six evenly spaced time slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.functions import calendar
from graticule.operators import axis, cube
from graticule.operators.groups import attach, broadcast_if_small
from graticule.spec import DEFAULT, GridSpec, names

# The caption of each step.
CAPTIONS = [
    "Baseline conditions – a reference climate state.",
    "First notable shift – emerging anomalies in the field.",
    "Stronger event – larger departures from the baseline.",
    "Persistent change – anomalies becoming the new normal.",
    "Extreme episode – peak intensity in this record.",
    "Post‑event climate – residual changes after extremes.",
]


def caption(step: Column) -> Column:
    last = len(CAPTIONS) - 1
    return F.element_at(F.array(*[F.lit(c) for c in CAPTIONS]), F.least(step, F.lit(last)) + 1)


def time_labels(steps: DataFrame, raw: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``label``: the parsed time, or the raw text for a record in which no time parses at all."""
    by = names(by)
    parsed = calendar.parse_time(F.col(raw).cast("string"))
    none = steps.groupBy(*by).agg(F.max(parsed).isNull().alias("__unparsable"))
    text = F.when(F.col("__unparsable"), F.col(raw).cast("string")).otherwise(calendar.time_text(parsed))
    return attach(steps, none, by, [raw]).select(*steps.columns, text.alias("label"))


def story_steps(df: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """One row per step: its position on the axis, its time with a label, and its caption.

    Where no time of a record is known, the raw axis value is the label, or the position if that is not known either.
    """
    steps = axis.steps_at(df, axis.story_positions(F.col("nt")), spec, by).withColumn("caption", caption(F.col("step")))
    if spec.time not in steps.columns:
        return steps
    raw = F.col(spec.time_idx).cast("string")
    if spec.time_raw in steps.columns:
        raw = F.coalesce(F.col(spec.time_raw).cast("string"), raw)
    by = names(by)
    unknown = steps.groupBy(*by).agg(F.max(spec.time).isNull().alias("__unknown"))
    label = F.when(F.col("__unknown"), raw).otherwise(calendar.time_text(F.col(spec.time)))
    return attach(steps, unknown, by, ["step"]).withColumn("label", label).drop("__unknown", spec.time_raw)


def story_slices(df: DataFrame, steps: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """The cells of every step. A position that several steps share appears once per step."""
    by = names(by)
    key = spec.time_key(df)
    wanted = steps.select(*by, "step", key)
    wanted = broadcast_if_small(wanted) if by else F.broadcast(wanted)  # six rows without groups
    return axis.restrict(df, steps, key, by).join(wanted, [*by, key])


def story_frames(cells: DataFrame, steps: DataFrame, spec: GridSpec = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Per step: time, caption, colour range (1.0 where nothing is finite) and hotspot."""
    by = names(by)
    fields = cells.groupBy(*by, "step").agg(
        *cube.range_columns(spec, fallback=1.0), cube.hotspot_cell(cells, spec)
    )
    return steps.join(fields.select("*", "hotspot.*").drop("hotspot"), [*by, "step"], "left")
