"""Helpers that the operators of this subpackage share.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``; only where that is unset and the master is
local (tests on one machine) a temporary folder is made.  They are ordinary Parquet tables, so a lost executor
costs a re-read and never a recomputation of what stands before them; ``discard`` removes those that nothing needs any more.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: Shards that ``IdShards`` makes, at most: of 100 TB each then has 400 MB.  A histogram that it brings to the driver has four rows a
#: shard, LEAST_BUCKETS at least, so 1 M rows at most.
MOST_SHARDS, LEAST_BUCKETS = 1 << 18, 4096
#: Bytes of rows that go to Python at once.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A path that is new, in the folder that driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python of BATCH_BYTES at most, so that long rows don't add up there."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: a cut of the lineage that survives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder wherever Spark can reach it; one that is not there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished queries when the driver's JVM happens to collect its garbage; here it is asked to."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote, and tidies.  Nothing may still have to read them, a plan not yet run included."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)
    tidy(tables[0].sparkSession)


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class IdShards:
    """Ranges of an integer id that hold about equal weight, the same for the same rows.

    A histogram of equal steps, four a shard, comes to the driver; steps that weigh more than a shard are cut into finer ones,
    again and again down to single ids, so outlying ids (the whole range of 64 bits is allowed) leave the others finely cut.
    Runs of steps become shards.  Rows of one id are always in one shard; null ids come first.
    """

    def __init__(self, df: DataFrame, key: str, weight: Column, shards: int):
        low, high = df.agg(F.min(key), F.max(key)).first()
        self.key, shards = key, max(1, min(shards, MOST_SHARDS))
        buckets, shift = max(LEAST_BUCKETS, 4 * shards), 0
        while low is not None and (high >> shift) - (low >> shift) >= buckets:
            shift += 1
        self.levels: list[tuple[int, dict[int, int | None]]] = []  # shift, and for each step its shard, or None where it is cut further
        leaves, total, within, finer = [], None, df, None
        while finer is None or finer:
            rows = within.groupBy(self._step(shift).alias("step")).agg(F.sum(weight).alias("w"), F.min(key).alias("first")).collect()
            total = sum(r["w"] or 0 for r in rows) if total is None else total
            finer = {r["step"] for r in rows if shift and r["step"] is not None and (r["w"] or 0) * shards > total}
            self.levels.append((shift, {r["step"]: None for r in rows}))
            leaves += [(r["step"] is not None, 0 if r["step"] is None else r["step"] << shift, len(self.levels) - 1, r["step"], r["w"] or 0, r["first"]) for r in rows if r["step"] not in finer]
            if finer:
                within = df.where(self._step(shift).isin(sorted(finer)))
                shift = max(0, shift - max(1, (buckets // len(finer)).bit_length() - 1))
        self.firsts, acc = [], 0
        for _, _, level, step, w, first in sorted(leaves, key=lambda x: x[:2]):
            if not self.firsts or acc * shards >= total * len(self.firsts):
                self.firsts.append(first)
            self.levels[level][1][step] = len(self.firsts) - 1
            acc += w
        self.n = max(1, len(self.firsts))

    def _step(self, shift: int) -> Column:
        return F.shiftright(F.col(self.key).cast("long"), shift)

    def assign(self, df: DataFrame) -> DataFrame:
        """df with shard_ and opens_, whether the row has its shard's smallest id.  Each level joins a table of the histogram's size."""
        spark, out = df.sparkSession, df.withColumn("shard_", F.lit(None).cast("int"))
        for shift, shard_of in self.levels:
            small = spark.createDataFrame(list(shard_of.items()), "step_ long, at_ int")
            out = out.join(F.broadcast(small), F.when(F.col("shard_").isNull(), F.struct(self._step(shift).alias("s"))).eqNullSafe(F.struct(F.col("step_").alias("s"))), "left")
            out = out.withColumn("shard_", F.coalesce("shard_", "at_")).drop("step_", "at_")
        firsts = spark.createDataFrame(list(enumerate(self.firsts)), "opened_ int, first_ long")
        out = out.join(F.broadcast(firsts), F.col("shard_") == F.col("opened_"), "left")
        return out.withColumn("opens_", F.col(self.key).eqNullSafe(F.col("first_"))).drop("opened_", "first_")
