"""Networks and placements as DataFrames: neurons(id), edges(src, tgt), placement(neuron, core, local)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.hw import HardwareConfig


#: Rows of a task, about: a shuffle whose session's partitions would get more is made with more of them.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df shuffled by keys to as many tasks as rows ask for, so what a task holds does not grow with the table; left to Spark where the
    session's partitions are enough."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def from_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts are neurons; consecutive parts of an order are edges.  Lines alike in number and part give the same edges in any order."""
    neurons = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("l_partkey"))
    rows = lines.count()  # of the files' footers
    pairs = dealt(lines, rows, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("tgt")).where("tgt is not null and src <> tgt")
    return neurons, dealt(pairs, rows, "src", "tgt").distinct()


def spread(neurons: DataFrame, hw: HardwareConfig) -> DataFrame:
    """Neuron i on core i div n at address i mod n."""
    return neurons.select(F.col("id").alias("neuron"), F.expr(f"id DIV {hw.n}").alias("core"), F.expr(f"id % {hw.n}").alias("local"))


def uniform(key: Column, seed: int = 42) -> Column:
    """A number in [0, 2**32) from a seed and a key, alike in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key)), 1, 8), 16, 10).cast("long")


def ranked(df: DataFrame, bucket: Column, order: list, name: str) -> DataFrame:
    """df with the place, from 0, of each row in order of (bucket, order): ranks within buckets plus a running sum over the buckets'
    counts, so no task orders more than a bucket or more than the list of buckets."""
    within = df.withColumn("bucket_", bucket).withColumn("own_", F.row_number().over(Window.partitionBy("bucket_").orderBy(*order)) - 1)
    counts = within.groupBy("bucket_").agg(F.count("*").alias("k_"))
    before = counts.select("bucket_", (F.sum("k_").over(Window.orderBy("bucket_")) - F.col("k_")).alias("before_"))
    return within.join(before, "bucket_").withColumn(name, (F.col("before_") + F.col("own_")).cast("long")).drop("bucket_", "own_", "before_")


def ranked_within(df: DataFrame, group: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """df with the place, from 0, of each row within its group, in order of (bucket, order): as ``ranked``, for many groups at once."""
    within = df.withColumn("bucket_", bucket).withColumn("own_", F.row_number().over(Window.partitionBy(*group, "bucket_").orderBy(*order)) - 1)
    counts = within.groupBy(*group, "bucket_").agg(F.count("*").alias("k_"))
    before = counts.select(*group, "bucket_", (F.sum("k_").over(Window.partitionBy(*group).orderBy("bucket_")) - F.col("k_")).alias("before_"))
    return within.join(before, [*group, "bucket_"]).withColumn(name, (F.col("before_") + F.col("own_")).cast("long")).drop("bucket_", "own_", "before_")


def random_placement(neurons: DataFrame, hw: HardwareConfig, seed: int = 42) -> DataFrame:
    """Slots in hashed order, neurons in order of id, joined by rank; both ranks go by buckets."""
    h = uniform(F.col("id").cast("string"), seed)
    slots = ranked(neurons.sparkSession.range(hw.slots).withColumn("h", h), F.shiftright("h", 20), ["h", "id"], "r").select(F.col("id").alias("slot"), "r")
    order = ranked(neurons.select("id"), F.shiftright("id", 16), ["id"], "r")
    return order.join(slots, "r").select(F.col("id").alias("neuron"), F.expr(f"slot DIV {hw.n}").alias("core"), F.expr(f"slot % {hw.n}").alias("local"))


def random_slices(neurons: DataFrame, hw: HardwareConfig, seed: int = 42) -> DataFrame:
    """neuron, distance, slice: any slice of each distance from 1, by a hash of neuron and distance."""
    if not hw.l:
        return neurons.select(F.col("id").alias("neuron"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("slice")).limit(0)
    grid = neurons.select(F.col("id").alias("neuron"), F.explode(F.sequence(F.lit(1), F.lit(hw.l))).alias("distance"))
    return grid.withColumn("slice", uniform(F.concat_ws(":", "neuron", "distance"), seed) % hw.slices("distance"))


def dense_labels(labels: DataFrame, column: str, name: str = "cluster") -> DataFrame:
    """labels with 0, 1, ... for the column's values in their order: the distinct values are ranked, and joined."""
    values = labels.select(column).distinct()
    ids = values.select(column, (F.row_number().over(Window.orderBy(column)) - 1).cast("long").alias(name))
    return labels.join(ids, column)


def fill(labels: DataFrame, hw: HardwareConfig) -> DataFrame:
    """Neurons by (cluster, id) fill cores of n one after the other; ranks go by ranges of ids within clusters, so a large cluster is not
    ordered in one task."""
    at = ranked(labels, F.struct("cluster", F.shiftright("neuron", 16).alias("range")), ["neuron"], "at")
    return at.select("neuron", F.expr(f"CAST(at DIV {hw.n} AS BIGINT)").alias("core"), F.expr(f"CAST(at % {hw.n} AS BIGINT)").alias("local"))
