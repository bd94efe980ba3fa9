"""Tables of results: results(mapper, input_id, metric, value[, failed]) long, or with maps of metrics as experiments give them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a metric that a result does not have (fixed values).
MISSING, MISSING_BAR = -1.0, 0.0


def column_name(metric: str) -> str:
    return re.sub(r"\W+", "_", metric).strip("_").lower()


#: Columns that a table of results may have.
MOST_COLUMNS = 1000


def distinct_names(long: DataFrame, column: str, most: int = MOST_COLUMNS) -> list[str]:
    """The values of a column that become columns, sorted; an error where there are more than a table may have."""
    names = [r[0] for r in long.select(column).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} values of {column} for columns")
    return sorted(n for n in names if n is not None)


def metric_names(long: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """The metrics of all results, sorted; an error where they are more than columns may be."""
    return distinct_names(long, "metric", most)


def matching(results: DataFrame, metric: str | None = None, input_id: str | None = None, mappers: list[str] | None = None) -> DataFrame:
    out = results
    for name, value in (("metric", metric), ("input_id", input_id)):
        out = out if value is None else out.where(F.col(name) == value)
    return out if mappers is None else out.where(F.col("mapper").isin(mappers))


def succeeded(results: DataFrame) -> DataFrame:
    if "failed" in results.columns:
        return results.where("not coalesce(failed, false)")
    return results.where("error is null") if "error" in results.columns else results


def replicate_means(results: DataFrame) -> DataFrame:
    """input_id, metric, mapper, value: the mean over repeated runs that did not fail."""
    return succeeded(results).groupBy("input_id", "metric", "mapper").agg(F.avg("value").alias("value"))


def mean_times(results: DataFrame, metric: str = "Time (s)") -> DataFrame:
    """mapper, seconds."""
    return succeeded(results).where(F.col("metric") == metric).groupBy("mapper").agg(F.avg("value").alias("seconds"))


def against(results: DataFrame, baseline: str, ratios: list[str]) -> DataFrame:
    """input_id, metric, mapper, relative: each mean against the baseline mapper's on the same input, as a ratio for the metrics named
    and a difference for others."""
    means = results.groupBy("input_id", "metric", "mapper").agg(F.avg("value").alias("v"))
    base = means.where(F.col("mapper") == baseline).select("input_id", "metric", F.col("v").alias("b"))
    ratio = F.try_divide(F.col("v"), F.col("b"))
    return means.join(base, ["input_id", "metric"]).select("input_id", "metric", "mapper", F.when(F.col("metric").isin(ratios), ratio).otherwise(F.col("v") - F.col("b")).alias("relative"))


def unpivot(wide: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """mapper, input_id, metric, value from a column for each metric: column name to metric."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for c, m in metrics.items())))
    return wide.select("mapper", "input_id", values.alias("m")).select("mapper", "input_id", "m.metric", "m.value")


def unmapped(results: DataFrame, maps: str = "raw_metrics") -> DataFrame:
    """mapper, input_id, metric, value from a map column."""
    return results.select("mapper", "input_id", F.explode(maps).alias("metric", "value"))


def wide(long: DataFrame, cell: Column, fill=None, metrics: list[str] | None = None) -> DataFrame:
    """A row for each mapper and input, a column for each metric in order of name; fill stands where there is none."""
    metrics = metric_names(long) if metrics is None else metrics
    out = long.groupBy("mapper", "input_id").pivot("metric", metrics).agg(cell)
    cells = [F.col(f"`{m}`") if fill is None else F.coalesce(F.col(f"`{m}`"), F.lit(fill)) for m in metrics]
    return out.select("mapper", "input_id", *(c.alias(column_name(m)) for c, m in zip(cells, metrics)))


def archive(long: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """All values as text, whole numbers without a point, nothing where there is none."""
    whole = F.col("value") == F.floor("value")
    text = F.when(whole, F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    return wide(long.withColumn("text", text), F.max("text"), "", metrics)


def report(long: DataFrame, metrics: list[str] | None = None, decimals: int = 2) -> DataFrame:
    """The means of each mapper and input, rounded; MISSING where there is none."""
    return wide(long, F.round(F.avg("value"), decimals), MISSING, metrics)


def report_lines(long: DataFrame, kind: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """line, in order of graph type and mapper, for kind(input_id, graph_type): what a console shows."""
    metrics = metric_names(long) if metrics is None else metrics
    table = report(long, metrics).join(kind, "input_id").orderBy("graph_type", "mapper", "input_id")
    cells = [F.format_string("%.2f", F.col(column_name(m))) for m in metrics]
    return table.select(F.concat_ws(" | ", F.rpad("mapper", 45, " "), F.rpad("graph_type", 40, " "), *cells).alias("line"))


def bars(long: DataFrame, by: str = "input_id", order: str = "value", mappers: list[str] | None = None) -> DataFrame:
    """A row for each input (or other grouping), a column for each mapper with its last value by ``order``; MISSING_BAR where none."""
    mappers = distinct_names(long, "mapper") if mappers is None else mappers
    out = long.groupBy(by).pivot("mapper", mappers).agg(F.max_by("value", order))
    return out.select(by, *(F.coalesce(F.col(f"`{m}`"), F.lit(MISSING_BAR)).alias(column_name(m)) for m in mappers))


def distinct_hardware(hardware: DataFrame) -> DataFrame:
    """r, l and a name, once each: routing trees are alike where these are."""
    return hardware.select("r", "l", F.concat(F.lit("R"), F.col("r").cast("string"), F.lit("_L"), F.col("l").cast("string")).alias("hw")).distinct()
