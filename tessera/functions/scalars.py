"""Scalar functions over columns; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The constant of the universal code (fixed value).
UNIVERSAL = 2.865064


def log_star(n: Column) -> Column:
    """Rissanen's universal code length of a positive integer in nats, 0 for others; five logarithms reach 1 for any 64-bit number."""
    x, out = F.log(n.cast("double")), F.lit(0.0)
    out = F.log(F.lit(UNIVERSAL)) + x
    for _ in range(4):
        more = x > 1
        x = F.when(more, F.log(x)).otherwise(F.lit(0.0))
        out = out + x
    return F.when(n > 0, out).otherwise(F.lit(0.0))


def degree_scale(b: Column, h: Column) -> Column:
    """1 + (b - 1) / b times the sum of (b / 2) ** k over the levels 1 to h."""
    b = b.cast("double")
    levels = F.when(h >= 1, F.sequence(F.lit(1), h.cast("int"))).otherwise(F.array().cast("array<int>"))
    return 1 + (b - 1) / b * F.aggregate(levels, F.lit(0.0), lambda s, k: s + F.pow(b / 2, k))


def cluster_of(neuron: Column, size: int) -> Column:
    return F.floor(neuron / F.lit(size)).cast("long")


def neighbours(a: Column, b: Column) -> Column:
    return F.abs(a - b) == 1


def inhibitory(cluster: Column, excitatory: int) -> Column:
    return cluster >= excitatory


def connection_probability(source: Column, target: Column, excitatory: int, neighbour: float = 0.2, e_to_i: float = 0.1, i_to_e: float = 0.8) -> Column:
    """Of a link between clusters: all within one, neighbouring excitatory ones, from and to inhibitory ones; none between inhibitory ones."""
    i_source, i_target = inhibitory(source, excitatory), inhibitory(target, excitatory)
    both = F.when(neighbours(source, target), F.lit(neighbour)).otherwise(F.lit(0.0))
    across = F.when(~i_source & ~i_target, both).when(~i_source, F.lit(e_to_i)).when(~i_target, F.lit(i_to_e)).otherwise(F.lit(0.0))
    return F.when(source == target, F.lit(1.0)).otherwise(across).cast("double")


def shortened(text: Column, width: int) -> Column:
    """At most width characters, the last three of them points where something is left out."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def safe_name(text: Column, unsafe: str = " #") -> Column:
    """A name for files: unsafe characters become underscores."""
    return F.translate(text, unsafe, "_" * len(unsafe))


def joined_map(pairs: Column) -> Column:
    """``key:value`` of a map in order of its keys, parted by commas."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ", ")
