"""Edges under a placement, optimal listening slices, and what they leave valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.hw import HardwareConfig


def placed_edges(edges: DataFrame, placement: DataFrame, hw: HardwareConfig) -> DataFrame:
    """src, tgt, the source's slot and the target's core, and their distance.  Placements are joined by key; Spark broadcasts
    them only where their size allows."""
    s = placement.select(F.col("neuron").alias("src"), F.col("core").alias("src_core"), F.col("local").alias("src_local"))
    t = placement.select(F.col("neuron").alias("tgt"), F.col("core").alias("tgt_core"))
    return edges.join(s, "src").join(t, "tgt").withColumn("distance", hw.distance("src_core", "tgt_core"))


def optimal_slices(neurons: DataFrame, placed: DataFrame, hw: HardwareConfig) -> DataFrame:
    """neuron, distance, slice, hits: for each neuron and distance from 1 the slice with most sources; ties and no source take the lowest."""
    hits = placed.where("distance > 0").groupBy("tgt", "distance", hw.slice_of("distance", "src_local").alias("slice")).agg(F.count("*").alias("hits"))
    best = hits.groupBy("tgt", "distance").agg(F.max(F.struct("hits", (-F.col("slice")).alias("s"))).alias("b")).select(F.col("tgt").alias("neuron"), "distance", (-F.col("b.s")).alias("slice"), F.col("b.hits").alias("hits"))
    if not hw.l:
        return best.limit(0)
    grid = neurons.select(F.col("id").alias("neuron"), F.explode(F.sequence(F.lit(1), F.lit(hw.l))).alias("distance"))
    return grid.join(best, ["neuron", "distance"], "left").select("neuron", "distance", F.coalesce("slice", F.lit(0)).cast("long").alias("slice"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def valid_edges(placed: DataFrame, slices: DataFrame, hw: HardwareConfig) -> DataFrame:
    """placed with valid: the source is on the target's core or in its slice at that distance."""
    chosen = slices.select(F.col("neuron").alias("tgt"), F.col("distance"), F.col("slice").alias("chosen"))
    own = hw.slice_of("distance", "src_local")
    return placed.join(chosen, ["tgt", "distance"], "left").withColumn("valid", (F.col("distance") == 0) | F.coalesce(own == F.col("chosen"), F.lit(False)))


def best_counts(placed: DataFrame, hw: HardwareConfig) -> DataFrame:
    """One row, m and valid_edges at the best slices, without choosing them: of each target and distance the fullest slice is heard."""
    hits = placed.groupBy("tgt", "distance", hw.slice_of("distance", "src_local").alias("slice")).agg(F.count("*").alias("hits"))
    per = hits.groupBy("tgt", "distance").agg(F.sum("hits").alias("k"), F.when(F.col("distance") == 0, F.sum("hits")).otherwise(F.max("hits")).alias("kept"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(zero("k").alias("m"), zero("kept").alias("valid_edges"))


def best_counts_each(edges: DataFrame, placements: dict[str, DataFrame], hw: HardwareConfig) -> DataFrame:
    """One row: m and valid_edges of each placement, by its name (m_..., valid_...), as ``best_counts`` has them; the edges are moved twice for all
    of them together, by source and by target, and a source's core and address go as one number."""
    names = list(placements)
    at = reduce(DataFrame.unionAll, [df.select("neuron", F.lit(k).alias("k"), F.shiftleft(F.col("core").cast("long"), 32).bitwiseOR(F.col("local").cast("long").bitwiseAND(F.lit(2**32 - 1))).alias("slot")) for k, df in enumerate(placements.values())])
    slots = at.groupBy("neuron").agg(*(F.max(F.when(F.col("k") == k, F.col("slot"))).alias(f"s{k}") for k in range(len(names))))
    by_source = edges.join(slots.withColumnRenamed("neuron", "src"), "src").select("tgt", *(f"s{k}" for k in range(len(names)))).repartition("tgt")
    both = by_source.join(slots.select(F.col("neuron").alias("tgt"), *(F.shiftright(f"s{k}", 32).alias(f"t{k}") for k in range(len(names)))), "tgt")
    each = both.select("tgt", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("s"), F.col(f"t{k}").alias("t")) for k in range(len(names))))).alias("e")).where("e.s is not null and e.t is not null")
    each = each.select("tgt", "e.k", F.shiftright("e.s", 32).alias("core"), F.shiftright(F.shiftleft("e.s", 32), 32).alias("local"), F.col("e.t").alias("t"))
    placed = each.withColumn("distance", hw.distance("core", "t"))
    hits = placed.groupBy("tgt", "k", "distance", hw.slice_of("distance", "local").alias("slice")).agg(F.count("*").alias("hits"))
    per = hits.groupBy("tgt", "k", "distance").agg(F.sum("hits").alias("n"), F.when(F.col("distance") == 0, F.sum("hits")).otherwise(F.max("hits")).alias("kept"))
    of = lambda c, k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col(c))), F.lit(0)).cast("long")
    return per.agg(*(of(c, k).alias(f"{x}_{name}") for k, name in enumerate(names) for c, x in (("n", "m"), ("kept", "valid"))))


def score(valid: DataFrame, neurons: DataFrame, hw: HardwareConfig) -> DataFrame:
    """The score of edges that ``valid_edges`` marked."""
    return score_of(valid.agg(F.count("*").alias("m"), F.count_if("valid").alias("valid_edges")), neurons, hw)


def score_of(counts: DataFrame, neurons: DataFrame, hw: HardwareConfig) -> DataFrame:
    """One row: m, valid_edges, inconsistencies, fraction, percent, log_likelihood, hardware_size, unused_connections."""
    n = neurons.agg(F.count("*").alias("n"))
    e, m = F.col("valid_edges"), F.col("m")
    p0 = (e + 1) / (F.col("n") * hw.n + 2)
    return counts.crossJoin(n).select(
        "m",
        "valid_edges",
        (m - e).alias("inconsistencies"),
        F.try_divide(m - e, m).cast("double").alias("fraction"),
        F.when(m == 0, 0.0).otherwise(100.0 * (m - e) / m).alias("percent"),
        F.round(e * F.log(p0) + (m - e) * F.log(F.lit(1e-10)), 4).alias("log_likelihood"),
        F.lit(hw.slots).cast("long").alias("hardware_size"),
        (F.lit(hw.total_connections()) - e).cast("long").alias("unused_connections"),
    )


def delta_slices(neurons: DataFrame, edges: DataFrame, placement: DataFrame, slices: DataFrame, moved: DataFrame, hw: HardwareConfig) -> DataFrame:
    """The slices after some neurons moved: only rows of the moved and of their targets are computed anew.

    placement is that after the moves, slices those before; moved has the column neuron.
    """
    hit = edges.join(moved.withColumnRenamed("neuron", "src"), "src", "left_semi").select(F.col("tgt").alias("neuron")).union(moved.select("neuron")).distinct()
    own = neurons.join(hit.withColumnRenamed("neuron", "id"), "id", "left_semi")
    placed = placed_edges(edges.join(hit.withColumnRenamed("neuron", "tgt"), "tgt", "left_semi"), placement, hw)
    return slices.join(hit, "neuron", "left_anti").unionByName(optimal_slices(own, placed, hw))


def violations(placement: DataFrame, slices: DataFrame, hw: HardwareConfig) -> DataFrame:
    """rule, violations: cores and addresses in range, cores not over-full, slots not shared, slices in range."""
    per_core = placement.groupBy("core").agg(F.count("*").alias("k"))
    per_slot = placement.groupBy("core", "local").agg(F.count("*").alias("k"))
    limit = F.expr(hw.slices_sql("distance"))
    parts = [
        placement.agg(F.lit("core out of range").alias("rule"), F.count_if((F.col("core") < 0) | (F.col("core") >= hw.cores)).alias("violations")),
        placement.agg(F.lit("local out of range").alias("rule"), F.count_if((F.col("local") < 0) | (F.col("local") >= hw.n)).alias("violations")),
        per_core.agg(F.lit("core over capacity").alias("rule"), F.count_if(F.col("k") > hw.n).alias("violations")),
        per_slot.agg(F.lit("slot shared").alias("rule"), F.count_if(F.col("k") > 1).alias("violations")),
        slices.agg(F.lit("slice out of range").alias("rule"), F.count_if((F.col("slice") < 0) | (F.col("slice") >= limit)).alias("violations")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
