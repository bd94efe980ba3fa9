"""Checks of inputs, assignments and clusterings: frames of rule and violations, never a collected table; errors only where asked for.

``LEVEL`` says how grave a rule must be to be looked at: rules below it are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import MappingValidationError
from tessera.hw import HardwareConfig
from tessera.operators import slices

LOW, MEDIUM, HIGH, CRITICAL = range(4)
LEVEL = MEDIUM


def _counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations from one aggregate: each Column counts one rule's violations."""
    one = df.agg(*(c.cast("long").alias(f"c{k}") for k, c in enumerate(rules.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"c{k}").alias("violations")) for k, r in enumerate(rules)))).alias("x")).select("x.*")


def graded(parts: list[tuple[int, DataFrame]], level: int | None = None) -> DataFrame:
    """The parts whose gravity reaches the level, as one frame."""
    kept = [p for g, p in parts if g >= (LEVEL if level is None else level)]
    if not kept:
        return parts[0][1].limit(0)
    return reduce(DataFrame.unionByName, kept)


def shape(neurons: DataFrame, placement: DataFrame, chosen: DataFrame, hw: HardwareConfig, level: int | None = None) -> DataFrame:
    """Every neuron placed once, none placed that is not there, one slice for each neuron and distance, nothing null."""
    per = placement.groupBy("neuron").agg(F.count("*").alias("k"))
    both = neurons.select(F.col("id").alias("neuron"), F.lit(True).alias("there")).join(per, "neuron", "full")
    grid = chosen.groupBy("neuron").agg(F.count("*").alias("k"), F.countDistinct("distance").alias("d"))
    own = neurons.select(F.col("id").alias("neuron")).join(grid, "neuron", "left")
    nulls = lambda df, *c: F.count_if(reduce(Column.__or__, [F.col(x).isNull() for x in c]))
    want = hw.l
    return graded(
        [
            (CRITICAL, _counted(both, {"neuron not placed once": F.count_if(F.coalesce("k", F.lit(0)) != 1), "placed neuron unknown": F.count_if(F.col("there").isNull())})),
            (HIGH, _counted(own, {"slices not one a distance": F.count_if((F.coalesce("k", F.lit(0)) != want) | (F.coalesce("d", F.lit(0)) != want))})),
            (MEDIUM, _counted(placement, {"null in placement": nulls(placement, "neuron", "core", "local")})),
            (MEDIUM, _counted(chosen, {"null in slices": nulls(chosen, "neuron", "distance", "slice")})),
        ],
        level,
    )


def whole(neurons: DataFrame, placement: DataFrame, chosen: DataFrame, hw: HardwareConfig, level: int | None = None) -> DataFrame:
    """All rules of a mapping: shape, ranges, capacity, collisions, slices, and that the neurons fit the hardware."""
    fits = _counted(neurons, {"more neurons than slots": (F.count("*") > hw.slots).cast("int")})
    return graded([(CRITICAL, fits), (HIGH, shape(neurons, placement, chosen, hw, LOW)), (HIGH, slices.violations(placement, chosen, hw))], level)


def network_input(neurons: DataFrame, hw: HardwareConfig, placed_on: HardwareConfig | None = None) -> DataFrame:
    """A network fits its hardware, and a placement that comes with it is for the same."""
    other = 0 if placed_on is None or placed_on == hw else 1
    return _counted(neurons, {"more neurons than slots": (F.count("*") > hw.slots).cast("int"), "placement for other hardware": F.lit(other) + 0 * F.count("*")})


def clustering(labels: DataFrame, cores: int, size: int | None = None) -> DataFrame:
    """One row: whether labels are dense from 0, whether there are at most as many as cores, the largest cluster, whether it fits a core."""
    per = labels.groupBy("cluster").agg(F.count("*").alias("k"))
    one = per.agg(F.max("cluster").alias("top"), F.min("cluster").alias("low"), F.count("*").alias("c"), F.max("k").alias("largest"))
    out = one.select((F.col("top") < F.col("c")).alias("dense"), (F.col("c") <= cores).alias("fits_cores"), "largest", (F.col("low") >= 0).alias("from_zero"))
    return out.withColumn("fits_size", F.lit(True) if size is None else F.col("largest") <= size)


def required(found: DataFrame) -> None:
    """An error that names the rules broken.  The frame has a row a rule."""
    broken = [f"{r.rule}: {r.violations}" for r in found.where("violations > 0").collect()]
    if broken:
        raise MappingValidationError("; ".join(sorted(broken)))


def told(found: DataFrame) -> str:
    """What a hook says of a mapping: it never raises."""
    try:
        required(found)
    except MappingValidationError as e:
        return f"invalid: {e}"
    return "valid"
