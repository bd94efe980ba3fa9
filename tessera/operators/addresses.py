"""Addresses in order of each core's first principal component, for all cores at once, by a block of Lanczos steps on frames.

The rows of a core are its neurons' sources as zeros and ones, centred by column.  A step multiplies one vector of each core by the
rows' products: sums by source, sums by neuron, less the core's mean; nothing of the size of a core's square is ever made.  A core's links are
stored once in cells, by hash of the source, so a cell has all links of a source and a step moves no link: a neuron's number goes to the
cells of its core, and the cell's sum comes back, two numbers a neuron and cell.  What the steps give of a core is a tridiagonal matrix of STEPS rows, whose first eigenvector (numpy, a core a row) weighs the steps' vectors.
Cores whose error is too large go on from there, RESTARTS times at most; ``settled`` says which are below it in the end.

The largest loading is positive (ties: the smallest source), equal scores go by id; neurons without sources, cores without variance and single
neurons keep the order of ids.  Each step is a stored table, so a lost executor costs a re-read.  A core's neurons are ordered in one
task; hardware bounds them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import graph
from tessera.tables import Steps

STEPS, RESTARTS = 12, 2
#: Of the first eigenvalue: the error at which a core is settled, and what counts as no variance.
SETTLED, NOTHING = 1e-10, 1e-12
#: Links of a cell, about; those for which there is a task more; cores whose sums are broadcast (a row each).
CELL, PARALLEL, BROADCAST = 1 << 21, 1 << 18, 1 << 16


def _total(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns)


def _numbers(value: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


def _packed(t: pa.Table) -> pa.Table:
    """A cell's links as places in the lists of its neurons and its sources."""
    ids, i = np.unique(t["id"].to_numpy(), return_inverse=True)
    sources, s = np.unique(t["src"].to_numpy(), return_inverse=True)
    held = [pa.array([x.tobytes()], pa.binary()) for x in (ids, sources, i.astype(np.int32), s.astype(np.int32))]
    return pa.table([t["cell"].slice(0, 1).combine_chunks(), t["core"].slice(0, 1).combine_chunks(), *held], names=["cell", "core", "ids", "sources", "i", "s"])


class Cells:
    """The links edges(src, id), repeated ones once, of rows(id, core) in cells."""

    def __init__(self, rows: DataFrame, edges: DataFrame, kept: Steps):
        links = kept.keep(edges.repartition("id").distinct().join(rows, "id").select("core", "src", "id"), "links")  # one shuffle for both
        per = kept.keep(links.groupBy("core").agg(F.count("*").alias("k")).select("core", "k", F.ceil(F.col("k") / CELL).alias("pieces")), "pieces")
        m, most, every = per.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("pieces"), F.lit(1)), F.coalesce(F.sum("pieces"), F.lit(1))).first()
        few = rows.select("core").distinct().count() <= BROADCAST
        #: What a join takes of a table with a row a core.
        self.by_core = F.broadcast if few else lambda df: df
        self.per, self.pieces = per, self.by_core(per.select("core", "pieces"))
        self.number = lambda piece: F.col("core") * most + piece
        dealt = links.join(self.pieces, "core").select(self.number(F.pmod(F.xxhash64("src"), "pieces")).alias("cell"), "core", "src", "id")
        self.buckets = max(1, min(every, -(-m // PARALLEL)))
        packed = dealt.repartition(self.buckets, "cell").groupBy("cell").applyInArrow(_packed, "cell long, core long, ids binary, sources binary, i binary, s binary")
        self.cells = kept.bucketed(packed, "cells", "cell", self.buckets)

    def _met(self, vectors: DataFrame, x: str, run, schema: str) -> DataFrame:
        """run(cell's row, numbers of its neurons) of every cell with links."""
        sent = vectors.select("id", "core", F.col(x).alias("x")).join(self.pieces, "core")
        sent = sent.select("id", "core", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("o")).select(self.number(F.col("o")).alias("cell"), "id", "x")
        names = [f.split()[0] for f in schema.split(", ")]

        def meet(cells: pa.Table, numbers: pa.Table) -> pa.Table:
            out = []
            for c in range(cells.num_rows):
                ids, x = numbers["id"].to_numpy(), numbers["x"].to_numpy()
                order = np.argsort(ids)
                own = {k: _numbers(cells[k][c], kind) for k, kind in (("ids", np.int64), ("sources", np.int64), ("i", np.int32), ("s", np.int32))}
                v = x[order[np.searchsorted(ids, own["ids"], sorter=order)]]
                t = np.bincount(own["s"], weights=v[own["i"]], minlength=len(own["sources"]))
                out.append(run(cells["core"][c].as_py(), own, t))
            return pa.concat_tables(pa.table(r, names=names) for r in out) if out else pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64())], names=names)

        return self.cells.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(meet, schema)

    def times(self, vectors: DataFrame, x: str) -> DataFrame:
        """id, y: the product, not centred, of the rows' products with column x."""

        def run(core, own, t):
            y = np.bincount(own["i"], weights=t[own["s"]], minlength=len(own["ids"]))
            return [pa.array(np.full(len(y), core)), pa.array(own["ids"]), pa.array(y)]

        return self._met(vectors, x, run, "core long, id long, y double").groupBy("id").agg(F.sum("y").alias("y"))

    def loads(self, vectors: DataFrame, x: str) -> DataFrame:
        """core, src, t: the sums of column x by source, of each cell those alone that may round to its largest."""

        def run(core, own, t):
            top = np.flatnonzero(np.abs(t) >= np.abs(t).max() - 1e-8)
            return [pa.array(np.full(len(top), core)), pa.array(own["sources"][top]), pa.array(t[top])]

        return self._met(vectors, x, run, "core long, src long, t double")


def multiplied(vectors: DataFrame, cells: Cells, x: str, name: str) -> DataFrame:
    """vectors with one more column: the centred product of the rows' products with column x."""
    raw = vectors.join(cells.times(vectors, x), "id", "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    mean = raw.groupBy("core").agg(F.avg("y").alias("mean"))
    return raw.join(cells.by_core(mean), "core").withColumn(name, F.col("y") - F.col("mean")).drop("y", "mean")


def _less(vectors: DataFrame, w: str, before: list[str], cells: Cells) -> DataFrame:
    """Column w without its part along the columns before."""
    dots = vectors.groupBy("core").agg(*(F.sum(F.col(w) * F.col(q)).alias(f"d_{q}") for q in before))
    out = vectors.join(cells.by_core(dots), "core").withColumn(w, F.col(w) - _total([F.col(f"d_{q}") * F.col(q) for q in before]))
    return out.drop(*(f"d_{q}" for q in before))


def _unit(vectors: DataFrame, w: str, cells: Cells) -> DataFrame:
    """Column w of length one in each core, nothing where it has none."""
    size = vectors.groupBy("core").agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias("length"))
    return vectors.join(cells.by_core(size), "core").withColumn(w, F.when(F.col("length") > 0, F.col(w) / F.col("length")).otherwise(0.0)).drop("length")


def _first_eigenvectors(small: DataFrame, steps: int) -> DataFrame:
    """core, value, error, c (weights of the steps) from the diagonal a and the side b of each core's tridiagonal matrix."""

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for core, a, b in zip(f["core"], f["a"], f["b"]):
                a, b = np.asarray(a), np.asarray(b)
                k = next((j + 1 for j in range(steps) if b[j] <= 0), steps)  # what follows a side of nothing is not in the space
                value, vector = np.linalg.eigh(np.diag(a[:k]) + np.diag(b[: k - 1], 1) + np.diag(b[: k - 1], -1))
                c = np.zeros(steps)
                c[:k] = vector[:, -1]
                out.append((core, value[-1], abs(b[k - 1] * c[k - 1]), c.tolist()))
            yield pd.DataFrame(out, columns=["core", "value", "error", "c"])

    return small.mapInPandas(run, "core long, value double, error double, c array<double>")


def principal_scores(cores: DataFrame, edges: DataFrame, steps: int = STEPS, restarts: int = RESTARTS, seed: int = 42) -> DataFrame:
    """neuron, core, score, settled: each row's place along the first principal component of its core's rows."""
    kept = Steps(cores.sparkSession)
    rows = kept.keep(cores.select(F.col("neuron").alias("id"), F.col("core").cast("long").alias("core")), "rows")
    cells = Cells(rows, edges.select("src", F.col("tgt").alias("id")), kept)
    start = rows.withColumn("u", graph.uniform(F.col("id").cast("string"), seed) / 2.0**32)
    start = start.join(cells.by_core(start.groupBy("core").agg(F.avg("u").alias("mean"))), "core").select("id", "core", (F.col("u") - F.col("mean")).alias("u"))
    for _ in range(1 + restarts):
        vectors = kept.keep(_unit(start.select("id", "core", F.col("u").alias("q0")), "q0", cells), "vectors")
        for k in range(steps):
            before, new, length = [f"q{j}" for j in range(k + 1)], f"q{k + 1}", lambda w: F.sqrt(F.sum(F.col(w) * F.col(w)))
            product = kept.keep(multiplied(vectors, cells, f"q{k}", new), "products")
            once = _less(product, new, before, cells)
            dots = product.groupBy("core").agg(F.sum(F.col(new) * F.col(f"q{k}")).alias(f"a{k}"), (length(new) * NOTHING).alias("floor"))
            twice = _less(once, new, before, cells)  # once more, for what rounding left
            side = twice.groupBy("core").agg(length(new).alias("length")).join(dots, "core")
            side = side.select("core", f"a{k}", F.when(F.col("length") > F.col("floor"), F.col("length")).otherwise(0.0).alias(f"b{k}"))
            unit = F.when(F.col(f"b{k}") > 0, F.col(new) / F.col(f"b{k}")).otherwise(0.0)
            vectors = kept.keep(twice.join(cells.by_core(side), "core").withColumn(new, unit), "vectors")
        small = vectors.groupBy("core").agg(*(F.first(f"{x}{k}").alias(f"{x}{k}") for k in range(steps) for x in "ab"))
        own = small.select("core", F.array(*(f"a{k}" for k in range(steps))).alias("a"), F.array(*(f"b{k}" for k in range(steps))).alias("b"))
        found = kept.keep(_first_eigenvectors(own, steps), "eigenvectors")
        first = _total([F.get("c", k) * F.col(f"q{k}") for k in range(steps)])
        settled = F.col("error") <= F.greatest(F.col("value") * SETTLED, F.lit(NOTHING))
        start = kept.keep(vectors.join(cells.by_core(found), "core").select("id", "core", first.alias("u"), "value", settled.alias("settled")), "first")
        kept.drop(start, rows, cells.cells, cells.per)
        if start.where("not settled").isEmpty():
            break
    sign = cells.loads(start, "u").groupBy("core").agg(F.max(F.struct(F.round(F.abs("t"), 9).alias("size"), (-F.col("src")).alias("s"), F.signum("t").alias("sign"))).alias("m")).select("core", F.col("m.sign").alias("sign"))
    score = F.coalesce(F.col("u") * F.col("sign"), F.lit(0.0)) * F.sqrt(F.greatest("value", F.lit(0.0)))
    return start.join(cells.by_core(sign), "core", "left").select(F.col("id").alias("neuron"), "core", score.alias("score"), "settled")


def principal_addresses(cores: DataFrame, edges: DataFrame, **settings) -> DataFrame:
    """neuron, core, local, settled: addresses 0, 1, ... in order of score."""
    order = Window.partitionBy("core").orderBy(F.round("score", 9), "neuron")
    scored = principal_scores(cores, edges, **settings)
    return scored.select("neuron", "core", (F.row_number().over(order) - 1).cast("long").alias("local"), "settled")
