"""Links without direction of a whole network, stored in cells, for steps that ask what each node has among its neighbours.

Nodes are dealt by hash to g pieces; a link lies in the cell of its ends' pieces, stored once.  A step moves no link: what it asks of a node
(a size, a part) goes to the g cells of its piece, and the cell's answers about its nodes come back.  Both ways a piece's nodes are packed, a row
for all of them, in a few bytes a node; so are links.  Within a cell the links go by numpy; only where nodes merge are links dealt anew, by
tasks that write to the buckets of their new cells, with no shuffle before.  A cell holds about CELL links, and g grows with the root of their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.tables import Steps

#: Links of a cell, about, which a task holds; those from which there are SIDE pieces for the sake of more tasks; links of a stored row.
CELL, PARALLEL, SIDE, SLAB = 1 << 22, 1 << 19, 4, 1 << 18
#: Numbers that are added up in an array with a place for each; more are sorted.
DENSE = 1 << 26
SCHEMA = "cell long, a binary, b binary, w binary"
ARROW = pa.schema([("cell", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("w", pa.binary())])
#: Of a cell to a piece: nodes in order, the label of each, how many numbers each has, and these.
REPLY = "piece long, id binary, label binary, k binary, held binary"
HELD, LISTS = "id long, part long, tos array<long>, ws array<long>", pa.list_(pa.field("element", pa.int64()))


def _put(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as all of them fit, after a byte that says in how many."""
    kind = np.int8 if not len(x) else next((t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max), np.int64)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _get(held) -> np.ndarray:
    held = memoryview(held.as_buffer() if isinstance(held, pa.Scalar) else held)
    return np.frombuffer(held, dtype=f"i{held[0]}", offset=1).astype(np.int64)


def _put_sorted(x: np.ndarray) -> bytes:
    return int(x[0]).to_bytes(8, "little", signed=True) + _put(np.diff(x, prepend=x[0]))


def _get_sorted(value: pa.Scalar) -> np.ndarray:
    held = memoryview(value.as_buffer())
    return np.cumsum(_get(held[8:])) + int.from_bytes(held[:8], "little", signed=True)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


def _rows(cell: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[tuple]:
    """Links in order of a, packed."""
    parts = [(a[k : k + SLAB], b[k : k + SLAB], w[k : k + SLAB]) for k in range(0, len(a), SLAB)]
    return [(cell, _put_sorted(x), _put(y), _put(z)) for x, y, z in parts]


def _links(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = [(_get_sorted(t["a"][k]), _get(t["b"][k]), _get(t["w"][k])) for k in range(t.num_rows)]
    return tuple(np.concatenate(x) for x in zip(*out))


def added(keys: np.ndarray, w: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of keys, which are below that, once and in order, with the sum of its w, where that is not nothing."""
    if below <= DENSE:
        sums = np.bincount(keys, weights=w, minlength=1)
        at = np.flatnonzero(sums)
        return at, sums[at].astype(np.int64)
    if not len(keys):
        return keys, w
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    sums = np.add.reduceat(w[order], starts)
    return keys[starts][sums != 0], sums[sums != 0]


def packed(nodes: DataFrame, piece: Column) -> DataFrame:
    """piece, and a packed column for each of the whole numbers of nodes(id, ...), a row a piece."""
    names = nodes.columns
    fields = pa.schema([("piece", pa.int64()), *((c, pa.binary()) for c in names)])

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy())
        held = [(_put_sorted if c == "id" else _put)(t[c].to_numpy()[order]) for c in names]
        return _table([(t["piece"][0].as_py(), *held)], fields)

    own = nodes.select(piece.alias("piece"), *(F.col(c).cast("long").alias(c) for c in names))
    return own.groupBy("piece").applyInArrow(pack, ", ".join(["piece long", *(f"{c} binary" for c in names)]))


def unpacked(t: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    """The nodes of packed pieces in order of id, by name; home: the piece."""
    own = {c: [(_get_sorted if c == "id" else _get)(v) for v in t[c]] for c in names}
    own["home"] = [np.full(len(x), p) for x, p in zip(own["id"], t["piece"].to_pylist())]
    own = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in own.items()}
    order = np.argsort(own["id"])
    return {c: v[order] for c, v in own.items()}


def replies(own: dict, label: np.ndarray, keys: np.ndarray, w: np.ndarray, width: int) -> list[pa.Array]:
    """Columns of REPLY from the sums w of keys in order, each a node's place times the width and a number below it."""
    x, out = keys // width, []
    home = own["home"][x]
    for piece in np.unique(home):
        at = home == piece
        own_x = x[at]
        first = np.flatnonzero(np.diff(own_x, prepend=-1))
        nodes = own_x[first]
        out.append((int(piece), _put_sorted(own["id"][nodes]), _put(label[nodes]), _put(np.diff(first, append=len(own_x))), _put(w[at] * width + keys[at] % width)))
    return [pa.array([r[c] for r in out], pa.binary() if c else pa.int64()) for c in range(5)]


def gathered(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of replies to a piece: its nodes in order, their labels, and the sums by key (a node's place times the width and a number below it)."""
    runs = [_get_sorted(v) for v in t["id"]]
    ids = np.unique(np.concatenate(runs))
    label, keys, w = np.zeros(len(ids), np.int64), [], []
    for r, run in enumerate(runs):
        at, held = np.searchsorted(ids, run), _get(t["held"][r])
        label[at] = _get(t["label"][r])
        keys.append(np.repeat(at, _get(t["k"][r])) * width + held % width)
        w.append(held // width)
    return ids, label, *added(np.concatenate(keys), np.concatenate(w), len(ids) * width)


def by_node(met: DataFrame, width: int, base) -> DataFrame:
    """id, part, tos, ws from REPLY rows: a node's label, and in lists the numbers it has sums for, in order, and these; base(labels) is added to the numbers."""

    def gather(t: pa.Table) -> pa.Table:
        ids, label, keys, w = gathered(t, width)
        x = keys // width
        ends = pa.array(np.searchsorted(x, np.arange(len(ids) + 1)).astype(np.int32))
        tos = base(label)[x] + keys % width
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int64))).cast(LISTS) for v in (tos, w)]
        return pa.table([pa.array(ids), pa.array(label), *lists], names=["id", "part", "tos", "ws"])

    return met.groupBy("piece").applyInArrow(gather, HELD)


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, *first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each (first, a, b) once, in their order, with the sum of w."""
    order = np.lexsort((b, a, *first))
    keys = [x[order] for x in (a, b, *first)]
    starts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)]))
    a, b, *first = (x[starts] for x in keys)
    return a, b, np.add.reduceat(w[order], starts), *first


def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A number below 2**63 for a pair and a seed."""
    x = np.full(len(a), seed * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
    for y in (a, b):
        x = (x ^ y.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(1)).astype(np.int64)


class LinkCells:
    def __init__(self, table: DataFrame, g: int, once: bool = True):
        """once: each link is one, and not one for each task that dealt it."""
        self.table, self.g, self.once = table, g, once

    @classmethod
    def of(cls, nodes: DataFrame, pairs: DataFrame, m: int, kept: Steps) -> LinkCells:
        """pairs(a, b, w) of any direction, loops left out, repeated ones summed, between nodes(id); m: how many pairs, about."""
        g = max(math.ceil(math.sqrt(2 * m / CELL)), min(SIDE, math.ceil(math.sqrt(m / PARALLEL))), 1)
        empty = cls(pairs, g)
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        dealt = pairs.where("a <> b").select(empty._cell(empty._piece("a"), empty._piece("b")).alias("cell"), low, high, F.col("w").cast("long").alias("w"))

        def pack(links: pa.Table, sent: pa.Table) -> pa.Table:
            if not links.num_rows:
                return _table([], ARROW)
            a, b, w = (links[c].to_numpy() for c in "abw")
            known = unpacked(sent, ["id"])["id"]
            there = np.isin(a, known) & np.isin(b, known)
            if not there.any():
                return _table([], ARROW)
            return _table(_rows(links["cell"][0].as_py(), *_summed(a[there], b[there], w[there])), ARROW)

        met = dealt.repartition(empty.buckets, "cell").groupBy("cell").cogroup(empty._sent(nodes.select("id")).groupBy("cell")).applyInArrow(pack, SCHEMA)
        return cls(kept.bucketed(met, "cells", "cell", empty.buckets), g)

    @classmethod
    def of_edges(cls, nodes: DataFrame, edges: DataFrame, kept: Steps) -> LinkCells:
        """The links of edges(src, tgt), which are read twice: weighted by how many edges there are."""
        return cls.of(nodes, edges.select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.lit(1).alias("w")), edges.count(), kept)

    @property
    def buckets(self) -> int:
        return self.g * (self.g + 1) if self.g > 1 else 1

    def _piece(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.g))

    def _cell(self, p: Column, q: Column) -> Column:
        return F.least(p, q) * self.g + F.greatest(p, q)

    def _sent(self, nodes: DataFrame) -> DataFrame:
        """The pieces of nodes(id, ...), packed, each to the g cells that may hold its links."""
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.g - 1).cast("long"))).alias("o_")
        return packed(nodes, self._piece("id")).select("*", other).withColumn("cell", self._cell(F.col("piece"), F.col("o_"))).drop("o_")

    def met(self, nodes: DataFrame, run, schema: str, once: bool = True) -> DataFrame:
        """run(cell, what is known of the nodes, in order of id, by name, places of the links' ends among them, weights) of every cell with
        links.  nodes: an id and whole numbers.  once: each link is one, otherwise its weight may come in parts."""
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
        names, add = nodes.columns, once and not self.once

        def meet(cells: pa.Table, sent: pa.Table) -> pa.Table:
            if not cells.num_rows:
                return fields.empty_table()
            a, b, w = _links(cells)
            own = unpacked(sent, names)
            a, b = np.searchsorted(own["id"], a), np.searchsorted(own["id"], b)
            if add:
                n = len(own["id"])
                keys, w = added(a * n + b, w, n * n)
                a, b = keys // n, keys % n
            return pa.table(run(cells["cell"][0].as_py(), own, a, b, w), schema=fields)

        return self.table.groupBy("cell").cogroup(self._sent(nodes).groupBy("cell")).applyInArrow(meet, schema)

    def heaviest(self, nodes: DataFrame, most: int, seed: int) -> DataFrame:
        """a, b: of each of nodes(id, size) the neighbour of most weight for size, of those that make no more than most with it."""

        def top(n, x, *by):
            """Which of x's entries are first by all of the numbers, one after the other, of those of the same x."""
            found = np.arange(len(x))
            for v in by:
                most_ = np.full(n, -np.inf if v.dtype.kind == "f" else np.iinfo(np.int64).min, v.dtype)
                np.maximum.at(most_, x[found], v[found])
                found = found[v[found] == most_[x[found]]]
            return found

        def run(cell, own, a, b, w):
            ids, size = own["id"], own["size"]
            fit = size[a] + size[b] <= most
            a, b, w = a[fit], b[fit], w[fit]
            x, y, w, tie = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), np.tile(_mixed(ids[a], ids[b], seed), 2)
            both = size[x] * size[y]
            best = top(len(ids), x, w / both, tie)
            best = best[np.argsort(x[best], kind="stable")]
            out = []
            for piece in np.unique(own["home"]):
                at = best[own["home"][x[best]] == piece]
                if len(at):
                    out.append((int(piece), _put_sorted(ids[x[at]]), _put(ids[y[at]]), _put(w[at]), _put(both[at])))
            return [pa.array([r[c] for r in out], pa.binary() if c else pa.int64()) for c in range(5)]

        def gather(t: pa.Table) -> pa.Table:
            a, b, w, both = (np.concatenate([f(v) for v in t[c]]) for c, f in (("id", _get_sorted), ("b", _get), ("w", _get), ("both", _get)))
            ids, x = np.unique(a, return_inverse=True)
            best = top(len(ids), x, w / both, _mixed(np.minimum(a, b), np.maximum(a, b), seed), b)
            return pa.table([pa.array(a[best]), pa.array(b[best])], names=["a", "b"])

        met = self.met(nodes.select("id", "size"), run, "piece long, id binary, b binary, w binary, both binary")
        return met.groupBy("piece").applyInArrow(gather, "a long, b long")

    def merged(self, up: DataFrame, kept: Steps) -> LinkCells:
        """The links between the nodes that up(id, up) makes of these; a link that more than one cell makes comes in parts."""
        g = self.g

        def run(cell, own, a, b, w):
            x, y, p, q = own["up"][a], own["up"][b], own["piece_up"][a], own["piece_up"][b]
            apart = x != y
            if not apart.any():
                return _table([], ARROW).columns
            x, y, p, q, w = x[apart], y[apart], p[apart], q[apart], w[apart]
            x, y, w, to = _summed(np.minimum(x, y), np.maximum(x, y), w, np.minimum(p, q) * g + np.maximum(p, q))
            ends = np.flatnonzero(np.diff(to, append=-1)) + 1
            return _table([r for s, e in zip([0, *ends[:-1]], ends) for r in _rows(int(to[s]), x[s:e], y[s:e], w[s:e])], ARROW).columns

        dealt = self.met(up.select("id", "up", self._piece("up").alias("piece_up")), run, SCHEMA, once=False)
        return LinkCells(kept.bucketed(dealt, "cells", "cell", self.buckets), g, once=False)

    def siblings(self, labels: DataFrame, width: int, branches: int) -> DataFrame:
        """id, part, tos, ws: what each of labels(id, part) has (ws) in its own part, of width parts below, and in each sibling (tos) that it has any in."""

        def run(cell, own, a, b, w):
            p = own["part"] // width
            near = p[a] // branches == p[b] // branches
            a, b, w = a[near], b[near], w[near]
            keys, sums = added(np.concatenate([a * branches + p[b] % branches, b * branches + p[a] % branches]), np.concatenate([w, w]), len(p) * branches)
            return replies(own, own["part"], keys, sums, branches)

        return by_node(self.met(labels.select("id", "part"), run, REPLY, once=False), branches, lambda part: part // width // branches * branches)

    def among_siblings(self, labels: DataFrame, width: int, branches: int) -> DataFrame:
        """id, part, to, w: the same, a row for each sibling."""
        return self.siblings(labels, width, branches).select("id", "part", F.explode(F.arrays_zip("tos", "ws")).alias("s")).select("id", "part", F.col("s.tos").alias("to"), F.col("s.ws").alias("w"))

    def votes(self, labels: DataFrame, parts: int) -> DataFrame:
        """id, part, w: what each of labels(id, part) whose part is -1 has in the parts, 0 to parts - 1, of others."""

        def run(cell, own, a, b, w):
            x, y, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
            asks = (own["part"][x] < 0) & (own["part"][y] >= 0)
            keys, sums = added(x[asks] * parts + own["part"][y[asks]], w[asks], len(own["id"]) * parts)
            return replies(own, own["part"], keys, sums, parts)

        every = by_node(self.met(labels.select("id", "part"), run, REPLY, once=False), parts, lambda part: np.zeros(len(part), np.int64))
        return every.select("id", F.explode(F.arrays_zip("tos", "ws")).alias("s")).select("id", F.col("s.tos").alias("part"), F.col("s.ws").alias("w"))

    def degrees(self, nodes: DataFrame) -> DataFrame:
        """id, w: the weight of the links of each of nodes(id) that has some."""

        def run(cell, own, a, b, w):
            keys, sums = added(np.concatenate([a, b]), np.concatenate([w, w]), len(own["id"]))
            return replies(own, np.zeros(len(own["id"]), np.int64), keys, sums, 1)

        every = by_node(self.met(nodes.select("id"), run, REPLY, once=False), 1, lambda part: part)
        return every.select("id", F.get("ws", F.lit(0)).alias("w"))

    def cut(self, labels: DataFrame) -> DataFrame:
        """One row: cut, the weight of links between parts of labels(id, part)."""

        def run(cell, own, a, b, w):
            return [pa.array([int(w[own["part"][a] != own["part"][b]].sum())])]

        return self.met(labels.select("id", "part"), run, "cut long", once=False).agg(F.coalesce(F.sum("cut"), F.lit(0)).cast("long").alias("cut"))
