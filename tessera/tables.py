"""Steps of iterations as Parquet tables in the folder that driver and executors share: a lost executor costs a re-read of a step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder stands in for it under a local master alone."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="steps-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Steps:
    """Tables of one iteration: ``keep`` writes a frame and reads it back, ``drop`` removes all but those named."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df, written and read back; by: a column whose values become folders, so that a read of some values opens those alone."""
        path = shared_path(self.spark, name)
        (df.repartition(by).write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path, None)
        return out

    def bucketed(self, df: DataFrame, name: str, by: str, buckets: int, **options: str) -> DataFrame:
        """df, written in buckets of by and read back: a join or a grouping by it with another table of as many buckets moves no row.
        options: the writer's."""
        path, table = shared_path(self.spark, name), f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, by).sortBy(by).options(path=path, **options).saveAsTable(table)
        out = self.spark.table(table)
        self.paths[id(out)] = (out, path, table)
        return out

    def drop(self, *but: DataFrame) -> None:
        kept = {id(df) for df in but}
        for key, (_, path, table) in list(self.paths.items()):
            if key not in kept:
                if table:
                    self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
                del self.paths[key]
