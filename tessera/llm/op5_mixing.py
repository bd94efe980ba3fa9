"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions alone.

Point t of the golden-ratio sequence falls into one source's part of the cumulative slots, and so slot t belongs to that
source.  A source's slots are ranked, its shuffled documents stand one after the other as a stream of words cut into
blocks of equal tokens, and the slot of rank r takes block r modulo the number of blocks, so blocks repeat in turn and no more
than MOST times.  A source has a block size of its own: its target makes LEAST slots and its part of SLOTS more, or one a word
if it has fewer.  Slots that the schedule leaves a source short follow it, those over are not used, and a source's last slot takes
what is left, so every source has its target to the nearest word whatever the input.

Positions in the stream come from two steps, sums over buckets of the hash order and sums within a bucket, so a source that
holds most rows is never ordered in one task.  Null texts have size 0 and are never taken; a null source is a source, the last;
repeated rows count each; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stored

SLOTS, LEAST, BINS, MOST = 1 << 20, 1024, 4096, 3
_GOLDEN = (math.sqrt(5) - 1) / 2


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """key, source_size, target: weights repeat over the sources by code point, null last; no target passes MOST times its
    source's size, and what is cut off goes to the others by weight.

    With sources in ascending order of cap over weight those that are cut come first, so one running sum finds the common level.
    The windows have a row for each source.
    """
    s = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * MOST)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "key", "level"))).over(every)
    return s.select("key", "source_size", F.least(F.col("cap").cast("double"), first["level"] * F.col("weight")).alias("target"))


def planned(goals: DataFrame, total: int) -> DataFrame:
    """key, block, blocks, passes, rest, slots of each source that is taken: its stream as a whole passes times, and its first rest words."""
    whole = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * MOST).cast("long")
    share = LEAST + F.floor(F.col("target") * F.lit(SLOTS) / F.lit(max(1, total)))
    p = goals.select("key", "source_size", whole.alias("whole"), share.cast("long").alias("share")).where("whole > 0")
    p = p.withColumn("block", F.expr("(whole + share - 1) DIV share")).withColumn("passes", F.expr("whole DIV source_size"))
    p = p.withColumn("blocks", F.expr("(source_size + block - 1) DIV block")).withColumn("rest", F.expr("whole - passes * source_size"))
    return p.select("key", "block", "blocks", "passes", "rest", F.expr("passes * blocks + (rest + block - 1) DIV block").alias("slots"))


def schedule(plans: DataFrame, slots: int) -> DataFrame:
    """key, t, rank of each slot."""
    spark = plans.sparkSession
    upto = F.sum("slots").over(Window.orderBy("key"))
    parts = plans.select("key", (upto / slots).alias("hi"), ((upto - F.col("slots")) / slots).alias("lo"))
    parts = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1).cast("long")))))
    u = F.pmod((F.col("id") + 1) * F.lit(_GOLDEN), F.lit(1.0))
    points = spark.range(slots).select(F.col("id").alias("t"), u.alias("u")).withColumn("bin", F.least(F.floor(F.col("u") * BINS), F.lit(BINS - 1).cast("long")))
    dealt = points.join(parts, "bin").where("u >= lo and u < hi")
    return dealt.select("key", "t", (F.row_number().over(Window.partitionBy("key").orderBy("t")) - 1).cast("long").alias("rank"))


def block_uses(plans: DataFrame, slots: int) -> DataFrame:
    """key, nth, uses of each block that slots take."""
    dealt = schedule(plans, slots).groupBy("key").agg(F.count("*").alias("dealt"))
    ranked = schedule(plans, slots).join(plans, "key").where("rank < slots").select("key", "blocks", "rank")
    short = plans.join(dealt, "key", "left").withColumn("dealt", F.coalesce("dealt", F.lit(0))).where("dealt < slots")
    short = short.select("key", "blocks", F.explode(F.sequence("dealt", F.col("slots") - 1)).alias("rank"))
    return ranked.unionByName(short).groupBy("key", F.pmod("rank", "blocks").alias("nth")).agg(F.count("*").alias("uses"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """id, size, source_size, target, taken for each row."""
    rows = stored(sized(df, id_col, text_col, source_col), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    goals = stored(targets(rows, weights), "goals")
    plans = stored(planned(goals, total), "plans")
    slots = plans.agg(F.sum("slots")).first()[0] or 0

    # where each row stands in its source's shuffled stream
    buckets = max(1, math.isqrt(n))
    order = F.xxhash64(F.lit(seed), "id", "size")
    placed = rows.where("size > 0").withColumn("h", order).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = placed.groupBy("key", "bucket").agg(F.sum("size").alias("s"))
    ahead = sums.select("key", "bucket", (F.sum("s").over(Window.partitionBy("key").orderBy("bucket")) - F.col("s")).alias("ahead"))
    within = Window.partitionBy("key", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("in_bucket", F.sum("size").over(within) - F.col("size")).join(ahead, ["key", "bucket"])
    placed = placed.select("id", "key", "size", (F.col("ahead") + F.col("in_bucket")).alias("start"))

    # blocks that slots take; of a stream that is not taken as a whole nothing counts beyond its first rest words
    end, low = F.col("start") + F.col("size"), F.col("nth") * F.col("block")
    stop = F.when(F.col("passes") > 0, end).otherwise(F.least(end, F.col("rest")))
    covered = placed.join(plans, "key", "left").withColumn("stop", stop)
    nths = F.when(F.col("stop") > F.col("start"), F.sequence(F.expr("start DIV block"), F.expr("(stop - 1) DIV block")))
    covered = covered.withColumn("nth", F.explode_outer(nths)).withColumn("high", F.least(end, low + F.col("block")))
    words = F.col("high") - F.greatest("start", low)
    # the last slot's block is cut short at rest
    cut = (F.col("rest") > low) & (F.col("rest") < low + F.col("block"))
    over = F.when(cut, F.greatest(F.lit(0), F.col("high") - F.greatest("start", "rest"))).otherwise(0)
    pieces = covered.select("id", "key", "size", "start", "nth", words.alias("words"), over.alias("over"))
    if slots:
        pieces = pieces.join(block_uses(plans, slots), ["key", "nth"], "left")
    else:
        pieces = pieces.withColumn("uses", F.lit(0))
    got = F.coalesce(F.col("words") * F.col("uses") - F.col("over"), F.lit(0))
    taken = pieces.groupBy("key", "start", "id", "size").agg(F.sum(got).cast("long").alias("taken"))
    empty = rows.where("size = 0").select("id", "key", "size", F.lit(0).cast("long").alias("taken"))
    every = taken.select("id", "key", "size", "taken").unionByName(empty)
    return every.join(goals, "key").select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
