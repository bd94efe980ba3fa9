"""Experiment results in files: summaries as CSV whose maps are JSON, and back; evaluations, text dumps; run folders.

Paths go through Spark's file systems, so a run folder may lie wherever a cluster can write.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAPS = {"metadata": "map<string,string>", "metrics": "map<string,double>", "raw_metrics": "map<string,double>"}
EVALUATION = "mapper string, input_id string, metric string, value double"


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def run_folder(spark: SparkSession, base: str | None = None) -> str:
    """The next run_NNN below base, or below the shared checkpoint folder, with ``dumps`` and ``plots`` in it.

    Making the folder is what takes the number, so two runs never share one.
    """
    top = base or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", top)
    fs, at = _place(spark, top)
    fs.mkdirs(at)
    taken = [int(m[1]) for s in fs.listStatus(at) if (m := re.fullmatch(r"run_(\d+)", s.getPath().getName()))]
    k = max(taken, default=0)
    while True:
        k += 1
        path = f"{top.rstrip('/')}/run_{k:03d}"
        own = _place(spark, path)[1]
        mark = _place(spark, f"{path}/.taken")[1]
        if not fs.exists(own) and fs.mkdirs(own) and fs.createNewFile(mark):
            for part in ("dumps", "plots"):
                fs.mkdirs(_place(spark, f"{path}/{part}")[1])
            return path


def write_csv(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder}/{name}.csv"
    df.write.csv(path, header=True, escape='"')
    return path


def dump_text(lines: DataFrame, folder: str, name: str) -> str:
    """Lines of text, in the order of the frame, for a report that a console also shows."""
    path = f"{folder}/dumps/{name}.txt"
    lines.select(lines.columns[0]).write.mode("append").text(path)
    return path


def write_summary(summary: DataFrame, path: str | None = None) -> str:
    path = path or run_folder(summary.sparkSession) + "/summary"
    out = summary
    for c in MAPS:
        if c in summary.columns:
            out = out.withColumn(c, F.to_json(c))
    out.write.csv(path, header=True, escape='"')
    return path


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Maps parsed again; an empty field is null."""
    out = spark.read.csv(path, header=True, escape='"')
    for c in out.columns:
        out = out.withColumn(c, F.from_json(c, MAPS[c]) if c in MAPS else F.nullif(F.col(c), F.lit("")))
    return out


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """mapper, input_id, metric, value of an evaluation that ``write_csv`` wrote."""
    return spark.read.schema(EVALUATION).csv(path, header=True, escape='"')
