"""Extreme eigenvalues and eigenvectors of a whole network's symmetric matrices, by block Lanczos steps on frames, and clusters from them.

A matrix is a frame of entries (i, j, x), both triangles, as ``metrics.bethe_hessian`` and ``metrics.laplacian`` give it; every node has an
entry.  A step multiplies a block of vectors by it and makes the result orthogonal to all vectors so far.  What the driver sees are sums of
products: a row of (vectors so far) x (block) numbers from each task, and the matrix of the steps, whose size is steps x block.  Every step
is a stored table, so a lost executor costs a re-read.

Nodes are dealt by hash to chunks and chunks to g pieces; the matrix is stored once in g x g cells (``Grid``), in buckets, each cell packed
in parts by runs of its rows' chunks, so a step moves no entry: each piece of the block goes to the g cells of its columns, and the sums of each cell to its rows' chunks, 2 g numbers a node and
vector.  A step's vectors are a table of their own in buckets of chunks, so none is written or moved again; it is not
compressed, as numbers like these don't shrink and every open reader would hold buffers for it outside the heap.

The values are Ritz values: each lies within its ``error`` of an eigenvalue, and there are never more negative ones than the matrix has.
A block of p vectors finds eigenvalues of up to p equal ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import graph
from tessera.operators import metrics
from tessera.tables import Steps

STEPS, BLOCK = 24, 4
#: Of a product's length: what is left of it below this is rounding.  Of the largest value: the error at which a value is settled.
NOTHING, SETTLED = 1e-10, 1e-7
#: Of the longest direction's square in a block: a shorter one is rounding.
ALIKE = 1e-14
#: Entries of a cell, about, which a task of a step holds packed; those from which a cell is cut for the sake of more tasks, SIDE a side; of a
#: chunk; of a slab, the part of a cell that is packed at once.
CELL, PARALLEL, SIDE, CHUNK, SLAB = 1 << 24, 1 << 20, 4, 1 << 18, 1 << 21


@dataclass
class Spectrum:
    """Ritz values, the smallest first, with their errors; ``basis`` (id, q) holds the steps' vectors, ``weights`` what makes Ritz vectors."""

    values: np.ndarray
    errors: np.ndarray
    basis: DataFrame
    weights: np.ndarray

    def _scale(self) -> float:
        return max(1.0, float(np.abs(self.values).max(initial=0.0)))

    def settled(self) -> np.ndarray:
        return self.errors <= SETTLED * self._scale()

    def negative(self) -> tuple[int, bool]:
        """How many values are negative, beyond rounding; and whether they are settled and the first other one's error leaves it its sign."""
        below = int((self.values < -1e-9 * self._scale()).sum())
        next_is_not = below == len(self.values) or self.errors[below] <= self.values[below] + 1e-9 * self._scale()
        return below, bool(self.settled()[:below].all() and next_is_not)

    def vectors(self, which: list[int]) -> DataFrame:
        """id, x: the Ritz vectors of the values numbered by which, an array a node."""
        weights = self.weights[:, which]

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("id"), _lists(_matrix(b, "q", len(weights)) @ weights)], names=["id", "x"])

        return self.basis.mapInArrow(run, "id long, x array<double>")


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def _bytes(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m).tobytes()


def _numbers(value: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.float64).reshape(-1, width)


def _wide(batch: pa.RecordBatch, row: int, widths: list[int]) -> np.ndarray:
    """All vectors so far of the nodes of a chunk, a node a row."""
    columns = [_numbers(batch.column(f"q{k}")[row], w) for k, w in enumerate(widths)]
    return np.hstack(columns) if columns else np.zeros((0, 0))


def _products(state: DataFrame, widths: list[int], to: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(q' z, z' z) for z = y to - q less, summed over all rows: a row a task."""
    total, block = len(less), len(to)

    def run(batches):
        of_q, own, seen = np.zeros((total, to.shape[1])), np.zeros((to.shape[1],) * 2), False
        for b in batches:
            for row in range(b.num_rows):
                z, seen = _numbers(b.column("y")[row], block) @ to, True
                if total:
                    q = _wide(b, row, widths)
                    z = z - q @ less
                    of_q = of_q + q.T @ z
                own = own + z.T @ z
        if seen:
            yield pa.RecordBatch.from_arrays([_lists(np.concatenate([of_q, own]).reshape(1, -1))], names=["s"])

    sums = np.array([r.s for r in state.mapInArrow(run, "s array<double>").collect()]).sum(axis=0).reshape(-1, to.shape[1])
    return sums[:total], sums[total:]


def _combined(state: DataFrame, widths: list[int], to: np.ndarray, less: np.ndarray) -> DataFrame:
    """chunk, q: z = y to - q less."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                z = _numbers(b.column("y")[row], len(to)) @ to
                z = z - _wide(b, row, widths) @ less if widths else z
                yield pa.RecordBatch.from_arrays([b.column("chunk").slice(row, 1), pa.array([_bytes(z)], pa.binary())], names=["chunk", "q"])

    return state.mapInArrow(run, "chunk long, q binary")


def _spread(nodes: pa.Table, side: int) -> tuple[list[int], list[np.ndarray]]:
    """The chunks of a piece in their order and the ids of each: an id's place in the piece is its place among them all."""
    own = sorted((c, v) for c, s, v in zip(nodes["chunk"].to_pylist(), nodes["side"].to_pylist(), nodes["ids"].to_pylist()) if s == side)
    return [c for c, _ in own], [np.frombuffer(v, dtype=np.int64) for _, v in own]


def _places(ids: list[np.ndarray]):
    every = np.concatenate(ids)
    order = np.argsort(every, kind="stable")
    every = every[order]
    return lambda x: order[np.searchsorted(every, x)].astype(np.int32)


def _packed(entries: pa.Table, nodes: pa.Table) -> pa.Table:
    """A part of a cell as one row: how many entries each row of the matrix has, in the order of the part's chunks, the places of their
    columns in their piece, and their values; up to 256 different values are kept once, with a byte an entry."""
    schema = pa.schema([("cell", pa.int64()), *((c, pa.binary()) for c in ("chunks", "sizes", "counts", "j", "codes", "values"))])
    if not entries.num_rows:
        return schema.empty_table()
    (chunks, rows), (_, columns) = _spread(nodes, 0), _spread(nodes, 1)
    i, j = _places(rows)(entries["i"].to_numpy()), _places(columns)(entries["j"].to_numpy())
    order = np.lexsort((j, i))
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    counts, x = np.bincount(i, minlength=int(sizes.sum())).astype(np.int32), entries["x"].to_numpy()[order]
    values, codes = np.unique(x, return_inverse=True)
    codes, values = (codes.astype(np.uint8), values) if len(values) <= 256 else (np.zeros(0, dtype=np.uint8), x)
    made = [np.array(chunks, dtype=np.int64), sizes, counts, j[order], codes, values]
    return pa.table([entries["cell"][:1].combine_chunks(), *(pa.array([_bytes(m)], pa.binary()) for m in made)], schema=schema)


def _times(part: dict[str, pa.Scalar], v: np.ndarray) -> list[tuple[int, bytes]]:
    """A part's rows times the vectors of its columns' piece, a chunk of rows each."""
    chunks, sizes = (np.frombuffer(part[c].as_buffer(), dtype=np.int64) for c in ("chunks", "sizes"))
    counts, j = (np.frombuffer(part[c].as_buffer(), dtype=np.int32) for c in ("counts", "j"))
    codes, values = np.frombuffer(part["codes"].as_buffer(), dtype=np.uint8), np.frombuffer(part["values"].as_buffer(), dtype=np.float64)
    i, x = np.repeat(np.arange(len(counts)), counts), values[codes] if len(codes) else values
    y = np.stack([np.bincount(i, weights=x * v[j, c], minlength=len(counts)) for c in range(v.shape[1])], axis=1)
    return [(int(c), _bytes(y[e - s : e])) for c, s, e in zip(chunks, sizes, np.cumsum(sizes))]


class Grid:
    """A symmetric matrix of entries(i, j, x) in cells, and its nodes in chunks with start vectors of numbers from a seed."""

    def __init__(self, links: DataFrame, m: int, block: int, seed: int, kept: Steps):
        self.kept = kept
        self.g = max(math.ceil(math.sqrt(m / CELL)), min(SIDE, math.ceil(math.sqrt(m / PARALLEL))))
        self.chunks = self.g * max(1, -(-m // (self.g * CHUNK)))
        self.buckets = max(self.g**2, -(-self.chunks // 8))
        chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(self.chunks))
        start = [(graph.uniform(F.concat_ws(":", "id", F.lit(c)), seed) / 2.0**32 - 0.5).alias(f"y{c}") for c in range(block)]
        ids = links.select(F.col("i").alias("id")).distinct().select(chunk("id").alias("chunk"), "id", *start)

        def gather(t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            y = np.stack([t[f"y{c}"].to_numpy() for c in range(block)], axis=1)
            return pa.table({"chunk": t["chunk"].slice(0, 1), "ids": pa.array([_bytes(t["id"].to_numpy())], pa.binary()), "y": pa.array([_bytes(y)], pa.binary())})

        self.nodes = kept.bucketed(ids.groupBy("chunk").applyInArrow(gather, "chunk long, ids binary, y binary"), "nodes", "chunk", self.buckets, compression="none")
        piece, other = F.col("chunk") % self.g, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.g - 1).cast("long"))).alias("o")
        self.columns = lambda df: df.select("*", other).withColumn("cell", F.col("o") * self.g + piece).drop("o")
        run = max(1, SLAB * self.g // CHUNK)  # chunks of rows in a part of a cell
        parts = -(-self.chunks // (self.g * run))
        part, every = lambda c: F.floor(c / (self.g * run)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        rows = self.nodes.select("chunk", "ids", other).select(((piece * self.g + F.col("o")) * parts + part(F.col("chunk"))).alias("part"), F.lit(0).alias("side"), "chunk", "ids")
        columns = self.columns(self.nodes.select("chunk", "ids")).select("cell", "chunk", "ids", every.alias("p"))
        sides = rows.unionByName(columns.select((F.col("cell") * parts + F.col("p")).alias("part"), F.lit(1).alias("side"), "chunk", "ids"))
        cell = chunk("i") % self.g * self.g + chunk("j") % self.g
        dealt = links.select((cell * parts + part(chunk("i"))).alias("part"), cell.alias("cell"), "i", "j", F.col("x").cast("double").alias("x")).repartition(self.g**2 * parts, "part")
        packed = dealt.groupBy("part").cogroup(sides.groupBy("part")).applyInArrow(_packed, "cell long, chunks binary, sizes binary, counts binary, j binary, codes binary, values binary")
        self.cells = kept.bucketed(packed, "cells", "cell", self.g**2)

    def times(self, q: DataFrame, width: int) -> DataFrame:
        """chunk, y: the matrix times q(chunk, q)."""

        def run(cells: pa.Table, pieces: pa.Table) -> pa.Table:
            out = []
            if cells.num_rows and pieces.num_rows:
                v = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, width) for _, x in sorted(zip(pieces["chunk"].to_pylist(), pieces["q"]), key=lambda p: p[0])])
                for k in range(cells.num_rows):
                    out += [(c, cells["cell"][0].as_py(), y) for c, y in _times({n: cells[n][k] for n in cells.column_names}, v)]
            return pa.table({"chunk": pa.array([r[0] for r in out], pa.int64()), "cell": pa.array([r[1] for r in out], pa.int64()), "y": pa.array([r[2] for r in out], pa.binary())})

        def total(t: pa.Table) -> pa.Table:
            parts = [np.frombuffer(y, dtype=np.float64) for _, y in sorted(zip(t["cell"].to_pylist(), t["y"].to_pylist()))]
            return pa.table({"chunk": t["chunk"].slice(0, 1), "y": pa.array([_bytes(np.sum(parts, axis=0))], pa.binary())})

        sums = self.cells.groupBy("cell").cogroup(self.columns(q).groupBy("cell")).applyInArrow(run, "chunk long, cell long, y binary")
        return sums.groupBy("chunk").applyInArrow(total, "chunk long, y binary")


def _beside(tables: list[DataFrame]) -> DataFrame:
    """Tables of chunks side by side; they have the same buckets."""
    return reduce(lambda a, b: a.join(b.hint("merge"), "chunk"), tables)


def _halves(g: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(to, back): z to has orthonormal columns where z' z is g, and z is that times back; directions shorter than floor, or than
    what squares can tell from the longest, go."""
    size, v = np.linalg.eigh((g + g.T) / 2)
    long = size > max(floor * floor, ALIKE * size[-1])
    root = np.sqrt(size[long])
    return v[:, long] / root, root[:, None] * v[:, long].T


def lanczos(entries: DataFrame, steps: int = STEPS, block: int = BLOCK, seed: int = 42) -> Spectrum:
    """The spectrum of a symmetric matrix as steps blocks see it.  It ends early where nothing new is found: then all values are exact
    but for rounding.  An empty matrix has no values."""
    kept = Steps(entries.sparkSession)
    links = kept.keep(entries.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "x"), "entries")
    m = links.count()
    if not m:
        return Spectrum(np.zeros(0), np.zeros(0), links.select(F.col("i").alias("id"), F.array().cast("array<double>").alias("q")), np.zeros((0, 0)))
    grid = Grid(links, m, block, seed, kept)
    kept.drop(grid.nodes, grid.cells)
    held, blocks, widths, product = [], [], [], grid.nodes.select("chunk", "y")
    total, width, small, back = 0, block, np.zeros((0, 0)), np.zeros((0, 0))
    for step in range(steps + 1):
        state = _beside([product, *blocks])
        first, size = _products(state, widths, np.eye(width), np.zeros((total, width)))
        second, own = _products(state, widths, np.eye(width), first)
        along = first + second  # once more, for what rounding left
        if step:
            small[:, total - width :] = along
        to, back = _halves(own - second.T @ second, NOTHING * np.sqrt(np.trace(size)))
        if step == steps or not to.shape[1]:
            break
        less = along @ to
        third, own = _products(state, widths, to, less)
        mend, undo = _halves(own - third.T @ third, 0.0)
        to, less, back = to @ mend, (less + third) @ mend, undo @ back
        new = kept.bucketed(_combined(state, widths, to, less), "basis", "chunk", grid.buckets, compression="none")
        width, before = to.shape[1], total
        total += width
        held.append(new)
        blocks.append(new.withColumnRenamed("q", f"q{step}"))
        widths.append(width)
        grown = np.zeros((total, total))
        grown[:before, :before] = small
        small = grown
        product = kept.bucketed(grid.times(new, width), "products", "chunk", grid.buckets, compression="none")
        kept.drop(grid.nodes, grid.cells, product, *held)
    kept.drop(grid.nodes, *held)
    values, weights = np.linalg.eigh(np.triu(small) + np.triu(small, 1).T)
    errors = np.linalg.norm(back @ weights[total - width :], axis=0) if len(back) else np.zeros(total)

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[row].as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(_wide(b, row, widths))], names=["id", "q"])

    basis = _beside([grid.nodes.select("chunk", "ids"), *blocks]).mapInArrow(run, "id long, q array<double>")
    return Spectrum(values, errors, basis, weights)


def negative_vectors(neurons: DataFrame, edges: DataFrame, sign: int = 1, **settings) -> tuple[Spectrum, DataFrame]:
    """The Bethe-Hessian's spectrum, and id, x: the vectors of its negative values."""
    found = lanczos(metrics.bethe_hessian(neurons, edges, sign), **settings)
    return found, found.vectors(list(range(found.negative()[0])))


def leading_vectors(neurons: DataFrame, edges: DataFrame, k: int, **settings) -> tuple[Spectrum, DataFrame]:
    """The walk matrix's spectrum, and id, x: the vectors of its k largest values, the largest first."""
    found = lanczos(metrics.laplacian(neurons, edges).select("i", "j", F.col("walk").alias("x")).na.fill(1.0, ["x"]), **settings)
    return found, found.vectors(list(range(len(found.values)))[::-1][:k])


def _assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, x, cluster, away: the nearest centre, the first of equal ones, and the square of the distance to it."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b, "x", centres.shape[1])
                d = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
                own = d.argmin(axis=1)
                columns = [b.column("id"), b.column("x"), pa.array(own.astype(np.int64)), pa.array(d[np.arange(len(own)), own])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "cluster", "away"])

    return points.mapInArrow(run, "id long, x array<double>, cluster long, away double")


def k_means(points: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """neuron, cluster of points (id, x): the centres start from the smallest id and then each time from the point farthest away (ties:
    the smallest id), so reruns agree; only the centres are on the driver.  Fewer than k different points make fewer clusters."""
    kept = Steps(points.sparkSession)
    points = kept.keep(points.select("id", "x"), "points")
    first = points.agg(F.min_by("x", "id").alias("x")).first().x
    if first is None or not k:
        return points.select(F.col("id").alias("neuron"), F.lit(0).cast("long").alias("cluster"))
    centres = np.array([first])
    while len(centres) < k:
        far = _assigned(points, centres).agg(F.max(F.struct("away", (-F.col("id")).alias("o"), "x")).alias("m")).first().m
        if far.away <= 0:
            break
        centres = np.vstack([centres, far.x])
    for _ in range(rounds):
        means = [F.avg(F.get("x", F.lit(c))) for c in range(centres.shape[1])]
        new = centres.copy()
        for row in _assigned(points, centres).groupBy("cluster").agg(F.array(*means).alias("x")).collect():  # a row a centre
            new[row.cluster] = row.x
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return _assigned(points, centres).select(F.col("id").alias("neuron"), "cluster")


def bethe_hessian_clusters(neurons: DataFrame, edges: DataFrame, rounds: int = 10, **settings) -> tuple[Spectrum, DataFrame]:
    """The spectrum, and neuron, cluster: as many clusters as the Bethe-Hessian has negative values, by means of the rows of their
    vectors; one where it has none."""
    found, vectors = negative_vectors(neurons, edges, **settings)
    if not found.negative()[0]:
        return found, neurons.select(F.col("id").alias("neuron"), F.lit(0).cast("long").alias("cluster"))
    return found, k_means(vectors, found.negative()[0], rounds)
