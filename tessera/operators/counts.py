"""Optimal slices under a placement that changes: stored counts of (target, distance, slice), a log of signed changes, undo.

``apply`` moves some neurons.  Of the links only those of the moved are read, once as they lie before and once as they lie after, and what
that adds to and takes from the counts is written to the log.  ``undo`` takes the last entry out again.  Counts in force are the
stored ones and the log's, summed; for some targets only the folders that hold them are read.  After COMPACT entries the log is
merged, all but the last entry, which stays to be undone: into one table of changes, and that into the stored counts only when it has grown
to a WORTHth of them, so a merge costs what was changed and not the network.

``kept``, how many links the best slices hear, follows each change by the rows of the touched targets.  Neurons that are moved must be
placed already, and a neuron is moved once a step; links to neurons without a place count nowhere.  Every table is written to the
shared folder once, so a lost executor costs a re-read; the log is as long as what was moved, not as the network.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.hw import HardwareConfig
from tessera.operators import slices
from tessera.tables import Steps

#: Entries of the log before it is merged; folders that links and counts are dealt to.
COMPACT, FOLDERS = 8, 64
#: Part of the stored counts' rows at which merged changes are put into them.
WORTH = 8
ROW = ["tgt", "distance", "slice"]


def _folder(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FOLDERS)).cast("int")


class SliceCounts:
    """Counts of a network under a placement(neuron, core, local)."""

    def __init__(self, neurons: DataFrame, edges: DataFrame, placement: DataFrame, hw: HardwareConfig, compact: int = COMPACT):
        self.hw, self.compact, self.steps = hw, max(2, compact), Steps(neurons.sparkSession)
        self.neurons = neurons.select("id")
        self.by_source = self.steps.keep(edges.select("src", "tgt", _folder("src").alias("at")), "links-by-source", "at")
        self.by_target = self.steps.keep(self.by_source.select("src", "tgt", _folder("tgt").alias("at")), "links-by-target", "at")
        self.placed = self.steps.keep(placement.select("neuron", "core", "local"), "placement")
        self.base = self._based(self._counts(slices.placed_edges(self.by_source.drop("at"), self.placed, hw), 1))
        self.merged: DataFrame | None = None
        #: (signed changes, places of all that have moved since the start, links heard) of each step in force.
        self.log: list[tuple[DataFrame, DataFrame, int]] = []
        self.first = self._heard(self.base)

    def _counts(self, placed: DataFrame, sign: int) -> DataFrame:
        key = ["tgt", F.col("distance").cast("int").alias("distance"), self.hw.slice_of("distance", "src_local").alias("slice")]
        return placed.groupBy(*key).agg((F.count("*") * sign).alias("n"))

    def _based(self, counts: DataFrame) -> DataFrame:
        return self.steps.keep(counts.withColumn("at", _folder("tgt")), "counts", "at")

    @staticmethod
    def _summed(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.select(*ROW, "n") for p in parts]).groupBy(*ROW).agg(F.sum("n").alias("n")).where("n <> 0")

    @staticmethod
    def _heard(counts: DataFrame) -> int:
        return counts.groupBy("tgt", "distance").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    @staticmethod
    def _in(df: DataFrame, rows: DataFrame, column: str, name: str) -> DataFrame:
        """Rows of df, a table in folders, whose column is among rows.name; only their folders, FOLDERS at most, are opened."""
        at = [r[0] for r in rows.select(_folder(name)).distinct().collect()]
        return df.where(F.col("at").isin(at)).join(rows.select(F.col(name).alias(column)).distinct(), column, "left_semi").drop("at")

    @property
    def kept(self) -> int:
        return self.log[-1][2] if self.log else self.first

    def placement(self) -> DataFrame:
        """neuron, core, local as they are now."""
        if not self.log:
            return self.placed
        moved = self.log[-1][1].toDF("neuron", "to_core", "to_local")
        both = self.placed.join(moved, "neuron", "left")
        return both.select("neuron", F.coalesce("to_core", "core").alias("core"), F.coalesce("to_local", "local").alias("local"))

    def counts(self) -> DataFrame:
        """tgt, distance, slice, n in force; distance 0 is the core itself."""
        return self._summed([self.base, *self._merged(), *(c for c, _, _ in self.log)])

    def _merged(self) -> list[DataFrame]:
        return [] if self.merged is None else [self.merged]

    def of(self, targets: DataFrame, until: int | None = None) -> DataFrame:
        """The counts of targets(tgt), with the log's first entries alone if so asked."""
        log = [c.join(targets, "tgt", "left_semi") for c in (*self._merged(), *(c for c, _, _ in self.log[:until]))]
        return self._summed([self._in(self.base, targets, "tgt", "tgt"), *log])

    def apply(self, moved: DataFrame) -> int:
        """Moves neurons to moved(neuron, core, local); how many more links are heard than before."""
        moved = self.steps.keep(moved.select("neuron", F.col("core").cast("long").alias("core"), F.col("local").cast("long").alias("local")), "moved")
        links = self._in(self.by_source, moved, "src", "neuron").select("src", "tgt").unionByName(self._in(self.by_target, moved, "tgt", "neuron").select("src", "tgt")).distinct()
        links = self.steps.keep(links, "touched-links")
        before = self.placement()
        own = before.join(moved.select("neuron", F.col("core").alias("to_core"), F.col("local").alias("to_local")), "neuron", "left")
        after = own.select("neuron", F.coalesce("to_core", "core").alias("core"), F.coalesce("to_local", "local").alias("local"))
        gone, come = (self._counts(slices.placed_edges(links, p, self.hw), sign) for p, sign in ((before, -1), (after, 1)))
        change = self.steps.keep(self._summed([gone, come]), "changes")
        every = moved if not self.log else self.log[-1][1].join(moved, "neuron", "left_anti").unionByName(moved)
        touched = change.select("tgt").distinct()
        was = self._heard(self.of(touched))
        self.log.append((change, self.steps.keep(every, "moves"), 0))
        more = self._heard(self.of(touched)) - was
        kept = (self.log[-2][2] if len(self.log) > 1 else self.first) + more
        self.log[-1] = (*self.log[-1][:2], kept)
        if len(self.log) > self.compact:
            self._compacted()
        return more

    def undo(self) -> bool:
        """Takes the last step back; false where none is left."""
        if self.log:
            self.log.pop()
            return True
        return False

    def _compacted(self) -> None:
        """Merges the log but for its last entry; what it replaced is removed."""
        *old, last = self.log
        self.merged = self.steps.keep(self._summed([*self._merged(), *(c for c, _, _ in old)]), "merged-changes")
        if self.merged.count() * WORTH > self.base.count():
            self.base, self.merged = self._based(self._summed([self.base, self.merged])), None
        self.placed, self.first = self.steps.keep(self._moved(old[-1][1]), "placement"), old[-1][2]
        self.log = [last]
        self.steps.drop(self.by_source, self.by_target, self.placed, self.base, *self._merged(), last[0], last[1])

    def _moved(self, moves: DataFrame) -> DataFrame:
        both = self.placed.join(moves.toDF("neuron", "to_core", "to_local"), "neuron", "left")
        return both.select("neuron", F.coalesce("to_core", "core").alias("core"), F.coalesce("to_local", "local").alias("local"))

    def slices(self) -> DataFrame:
        """neuron, distance, slice, hits: what ``slices.optimal_slices`` gives of the placement as it is now."""
        best = self.counts().where("distance > 0").groupBy("tgt", "distance").agg(F.max(F.struct("n", (-F.col("slice")).alias("s"))).alias("b"))
        best = best.select(F.col("tgt").alias("neuron"), "distance", (-F.col("b.s")).alias("best"), F.col("b.n").alias("n"))
        if not self.hw.l:
            return best.select("neuron", "distance", F.col("best").alias("slice"), F.col("n").alias("hits"))
        grid = self.neurons.select(F.col("id").alias("neuron"), F.explode(F.sequence(F.lit(1), F.lit(self.hw.l))).alias("distance"))
        zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
        return grid.join(best, ["neuron", "distance"], "left").select("neuron", "distance", zero("best", "slice"), zero("n", "hits"))


def exchanges(placement: DataFrame, pairs: DataFrame) -> DataFrame:
    """neuron, core, local after pairs(a, b) have changed places; a neuron is in one pair at most."""
    at = placement.select(F.col("neuron").alias("other"), "core", "local")
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("neuron", "other").join(at, "other").select("neuron", "core", "local")
