"""Router-tree hardware: sizes on the driver, everything per row as SQL expressions that stay in generated code.

The expressions use ``DIV`` for integer division.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidConfigError


@dataclass(frozen=True)
class HardwareConfig:
    """r children a router, l levels, n neurons a core, slice factor f."""

    r: int
    n: int
    l: int  # noqa: E741
    f: int

    def __post_init__(self):
        if self.r <= 0 or self.n <= 0 or self.l < 0 or self.f <= 0:
            raise InvalidConfigError("r, n and f must be positive and l not negative")
        if self.f > self.n:
            raise InvalidConfigError("the slice factor exceeds the core size")

    @property
    def cores(self) -> int:
        return self.r**self.l

    @property
    def slots(self) -> int:
        return self.cores * self.n

    @property
    def max_distance(self) -> int:
        return self.l

    def slices_at(self, d: int) -> int:
        return min(self.f**d, self.n)

    def total_connections(self) -> int:
        """Sources that all slots can listen to; every slice counts with the size of the first."""
        return self.slots * (self.n + sum((self.r - 1) * self.r ** (d - 1) * (self.n // self.slices_at(d)) for d in range(1, self.l + 1)))

    # expressions over column names or other expressions
    def distance_sql(self, a: str, b: str) -> str:
        terms = [f"CAST(({a}) DIV {self.r**k} <> ({b}) DIV {self.r**k} AS INT)" for k in range(self.l)]
        return "(" + (" + ".join(terms) or "0") + ")"

    def slices_sql(self, d: str) -> str:
        return "(CASE " + " ".join(f"WHEN {d} = {k} THEN {self.slices_at(k)}" for k in range(self.l + 1)) + " END)"

    def slice_sql(self, d: str, x: str) -> str:
        """The slice that holds address x: the closed form turns slice membership into an equality."""
        return f"((({x}) + 1) * {self.slices_sql(d)} - 1) DIV {self.n}"

    def low_sql(self, d: str, k: str) -> str:
        return f"(({k}) * {self.n} DIV {self.slices_sql(d)})"

    def high_sql(self, d: str, k: str) -> str:
        return f"((({k}) + 1) * {self.n} DIV {self.slices_sql(d)})"

    def distance(self, a: str, b: str) -> Column:
        return F.expr(self.distance_sql(a, b))

    def slice_of(self, d: str, x: str) -> Column:
        """The slice of an address on the core; addresses are not looked at, see ``slice_index``."""
        return F.expr(self.slice_sql(d, x)).cast("long")

    def slice_index(self, d: str, x: str) -> Column:
        """The slice that holds an address, -1 for one that the core does not have."""
        return F.when(F.expr(f"({x}) >= 0 AND ({x}) < {self.n}"), self.slice_of(d, x)).otherwise(F.lit(-1)).cast("long")

    def slices(self, d: str) -> Column:
        return F.expr(self.slices_sql(d)).cast("long")

    def low(self, d: str, k: str) -> Column:
        return F.expr(self.low_sql(d, k)).cast("long")

    def high(self, d: str, k: str) -> Column:
        return F.expr(self.high_sql(d, k)).cast("long")

    def valid_connection(self, d: str, x: str, k: str) -> Column:
        """Whether address x on a core at distance d is in slice k there; at distance 0 the slice is the core."""
        return F.expr(f"({x}) >= {self.low_sql(d, k)} AND ({x}) < {self.high_sql(d, k)}")

    def halving_slice(self, d: str, x: str) -> Column:
        """A slice by halves at every level, whatever f is; for older results, not for scores."""
        return F.expr(f"CAST(({x}) * CAST(pow(2, {d}) AS BIGINT) DIV {self.n} AS BIGINT)")

    def slot(self, core: str, local: str) -> Column:
        """The address over all cores; an error for a core or address that is not there."""
        inside = F.expr(f"({core}) >= 0 AND ({core}) < {self.cores} AND ({local}) >= 0 AND ({local}) < {self.n}")
        return F.when(inside, F.expr(f"CAST(({core}) * {self.n} + ({local}) AS BIGINT)")).otherwise(F.raise_error(F.lit("no such core or address")))

    def core_and_local(self, slot: str) -> Column:
        """A struct of core and local; an error for a slot that is not there."""
        inside = F.expr(f"({slot}) >= 0 AND ({slot}) < {self.slots}")
        both = F.struct(F.expr(f"CAST(({slot}) DIV {self.n} AS BIGINT)").alias("core"), F.expr(f"CAST(({slot}) % {self.n} AS BIGINT)").alias("local"))
        return F.when(inside, both).otherwise(F.raise_error(F.lit("no such slot")))


def log_star(n: int) -> float:
    """Rissanen's universal code length of a positive integer, in nats."""
    import math

    if n <= 0:
        return 0.0
    out, x = math.log(2.865064), math.log(n)
    out += x
    while x > 1.0:
        x = math.log(x)
        out += x
    return out
