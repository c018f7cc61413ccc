"""Entity features as arrays, from typed attribute tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.columns import normalised


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def feature_vectors(rows: DataFrame, key: str, slots: list[Column], size: int) -> DataFrame:
    """``key, f``: the slots in order, padded with 0 to ``size``, over their L2 norm (a zero vector stays)."""
    vector = F.array(*slots, *[F.lit(0.0)] * (size - len(slots)))
    return rows.select(key, normalised(vector).alias("f"))


def line_slots(wetland: list[str], meadow: list[str]) -> list[Column]:
    """Slots of power lines: voltage, length, nests and surroundings."""
    c, zero = F.col, F.lit(0.0)
    capped = lambda x, top: F.least(F.coalesce(x.cast("double"), zero) / top, F.lit(1.0))
    return [flag(c("voltage") == 110), flag(c("voltage") == 35), flag(~c("voltage").isin(110, 35)), capped(c("poles"), 300), capped(c("length_km"), 100), F.coalesce(c("nest_rate"), zero), flag(c("id").isin(wetland)), flag(c("id").isin(meadow)), zero, zero, flag(c("artificial_nests") > 0), F.coalesce(c("activity").cast("double"), zero) / 5]


def bird_slots() -> list[Column]:
    """Slots of birds: protection, size, habitat and residency."""
    c = F.col
    return [flag(c("class") == "I"), flag(c("class") == "II"), flag(c("body_size") == "large"), flag(c("body_size") == "medium"), *[flag(c("habitat") == h) for h in ("wetland", "grassland", "mountain")], flag(c("residency") == "resident"), flag(c("residency") == "summer_visitor"), F.lit(0.5)]


def measure_slots() -> list[Column]:
    return [*[flag(F.col("type") == t) for t in ("physical_barrier", "deterrent", "attractant")], F.lit(0.5)]


def fact_features(entities: DataFrame, facts: DataFrame, slots: list[tuple[Column, float]], size: int, baseline: float = 0.01) -> DataFrame:
    """``name, f``: features of entities from the facts that they are part of, ``size`` slots over their L2 norm.

    A slot is a condition on ``side`` (h or t: which the entity is), ``r``, ``other``, ``tb``, ``te`` and a scale: it holds how many of the
    entity's facts meet the condition, over the scale, at most 1; scale 1 makes a flag. Conditions that are null do not hold. The last
    place is the baseline's: entities that fill no slot have it alone, so that no vector is zero. Needs fewer slots than ``size``.
    """
    if len(slots) >= size:
        raise ValueError("the last place is the baseline's")
    sides = F.array(F.struct(F.lit("h").alias("side"), F.col("h").alias("name"), F.col("t").alias("other")), F.struct(F.lit("t").alias("side"), F.col("t").alias("name"), F.col("h").alias("other")))
    each = facts.select(F.explode(sides).alias("s"), "r", "tb", "te").select("s.*", "r", "tb", "te")
    counts = each.groupBy("name").agg(*[F.count_if(c).alias(f"s{i}") for i, (c, _) in enumerate(slots)])
    value = lambda i, scale: F.least(F.coalesce(F.col(f"s{i}"), F.lit(0)) / float(scale), F.lit(1.0))
    rows = entities.select("name").join(counts, "name", "left").select("name", F.array(*[value(i, scale) for i, (_, scale) in enumerate(slots)]).alias("v"))
    empty = ~F.exists("v", lambda x: x > 0)
    padded = F.concat("v", F.array(*[F.lit(0.0)] * (size - len(slots) - 1), F.when(empty, baseline).otherwise(0.0)))
    return rows.select("name", normalised(padded).alias("f"))
