"""Nets of a whole network, stored in cells, for steps that ask which parts each pin's nets reach.

Nets and pins are dealt by hash to g pieces each; a pin of a net lies in the cell of both pieces, stored once.  A step moves no pin: the pins' parts
go to the cells, how many pins of a net each cell has in a part comes back to the net's piece, which part a net reaches once or more often
goes to the cells, and their sums come back to the pins.  All of it is packed, a row a piece, as in ``link_cells``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import link_cells
from tessera.operators.link_cells import REPLY, _get, _get_sorted, _put, _put_sorted, _table, added, by_node, gathered, packed, replies, unpacked
from tessera.tables import Steps

SCHEMA = "cell long, net binary, pin binary"
ARROW = pa.schema([("cell", pa.int64()), ("net", pa.binary()), ("pin", pa.binary())])
#: What a cell is sent: pieces of pins (id, part), and pieces of nets (id, how many parts it reaches, these with whether more than once).
SENT = ["cell", "piece", "id", "part", "k", "held"]
#: Pins for which what their nets reach is laid out at a time.
CHUNK = 1 << 18


def _held(cells: pa.Table, own: dict) -> tuple[np.ndarray, np.ndarray]:
    """The nets and the places of the pins of a cell."""
    return np.concatenate([_get_sorted(v) for v in cells["net"]]), np.searchsorted(own["id"], np.concatenate([_get(v) for v in cells["pin"]]))


class NetCells:
    def __init__(self, table: DataFrame, g: int):
        self.table, self.g = table, g

    @classmethod
    def of(cls, nodes: DataFrame, pins: DataFrame, m: int, kept: Steps, nets_known: bool = False) -> NetCells:
        """pins(net, pin), repeated ones once, whose pin is one of nodes(id), and, if nets_known, whose net is; m: how many, about."""
        g = max(math.ceil(math.sqrt(m / link_cells.CELL)), min(link_cells.SIDE, math.ceil(math.sqrt(m / link_cells.PARALLEL))), 1)
        own = cls(pins, g)
        dealt = pins.select((own._piece("net") * g + own._piece("pin")).alias("cell"), F.col("net").cast("long").alias("net"), F.col("pin").cast("long").alias("pin"))
        as_pin, as_net = F.col("o_") * g + F.col("piece"), F.col("piece") * g + F.col("o_")
        to = F.array_distinct(F.array(as_pin, as_net)) if nets_known else F.array(as_pin)
        sent = packed(nodes.select("id"), own._piece("id")).select("*", own._others()).select("piece", "id", F.explode(to).alias("cell"))

        def pack(held: pa.Table, sent: pa.Table) -> pa.Table:
            if not held.num_rows:
                return _table([], ARROW)
            known = unpacked(sent, ["id"])["id"]
            net, pin = held["net"].to_numpy(), held["pin"].to_numpy()
            there = np.isin(pin, known) & (np.isin(net, known) if nets_known else True)
            net, pin = net[there], pin[there]
            if not len(net):
                return _table([], ARROW)
            order = np.lexsort((pin, net))
            net, pin = net[order], pin[order]
            first = np.concatenate([[True], (np.diff(net) != 0) | (np.diff(pin) != 0)])
            return _table([(held["cell"][0].as_py(), _put_sorted(net[first]), _put(pin[first]))], ARROW)

        met = dealt.repartition(own.buckets, "cell").groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(pack, SCHEMA)
        return cls(kept.bucketed(met, "nets", "cell", own.buckets), g)

    @classmethod
    def of_edges(cls, nodes: DataFrame, edges: DataFrame, kept: Steps) -> NetCells:
        """The nets of nodes(id) and edges(src, tgt), which are read twice: a node with its sources."""
        pins = edges.select(F.col("tgt").alias("net"), F.col("src").alias("pin")).union(nodes.select("id", "id"))
        return cls.of(nodes, pins, edges.count(), kept, nets_known=True)

    @property
    def buckets(self) -> int:
        return max(1, self.g * self.g)

    def _piece(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.g))

    def _others(self) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.g - 1).cast("long"))).alias("o_")

    def _pins(self, labels: DataFrame) -> DataFrame:
        """SENT: labels(id, part) to the cells of their pieces as pins."""
        none = F.lit(None).cast("binary")
        pieces = packed(labels.select("id", "part"), self._piece("id")).select("*", self._others())
        return pieces.select((F.col("o_") * self.g + F.col("piece")).alias("cell"), "piece", "id", "part", none.alias("k"), none.alias("held"))

    def _reached(self, sent: DataFrame, width: int, parts: int) -> DataFrame:
        """piece, id, k, held: each net, how many parts it reaches, and these: the part, and parts more if it does so with two pins or more."""
        g = self.g

        def count(cells: pa.Table, sent: pa.Table) -> pa.Table:
            if not cells.num_rows:
                return _table([], pa.schema([("piece", pa.int64()), *((c, pa.binary()) for c in ("id", "label", "k", "held"))]))
            own = unpacked(sent, ["id", "part"])
            net, x = _held(cells, own)
            nets, i = np.unique(net, return_inverse=True)
            keys, sums = added(i * parts + own["part"][x] // width, np.ones(len(i), np.int64), len(nets) * parts)
            at = {"id": nets, "home": np.full(len(nets), cells["cell"][0].as_py() // g)}
            return pa.table(replies(at, np.zeros(len(nets), np.int64), keys, sums, parts), names=["piece", "id", "label", "k", "held"])

        def gather(t: pa.Table) -> pa.Table:
            nets, _, keys, k = gathered(t, parts)
            per = np.bincount(keys // parts, minlength=len(nets))
            fields = pa.schema([("piece", pa.int64()), *((c, pa.binary()) for c in ("id", "k", "held")), ("over", pa.int64())])
            return _table([(t["piece"][0].as_py(), _put_sorted(nets), _put(per), _put(keys % parts + np.where(k > 1, parts, 0)), int(len(keys) - len(nets)))], fields)

        met = self.table.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(count, REPLY)
        return met.groupBy("piece").applyInArrow(gather, "piece long, id binary, k binary, held binary, over long")

    def over(self, labels: DataFrame, parts: int) -> DataFrame:
        """One row: over, the parts of labels(id, part) that nets reach beyond one."""
        return self._reached(self._pins(labels), 1, parts).agg(F.coalesce(F.sum("over"), F.lit(0)).cast("long").alias("over"))

    def siblings(self, labels: DataFrame, width: int, branches: int, parts: int) -> DataFrame:
        """id, part, tos, ws: of each of labels(id, part) the nets that reach a sibling of its part, of width parts below, and those that reach its own by others too."""
        pins = self._pins(labels)
        reached = self._reached(pins, width, parts).select("*", self._others())
        reached = reached.select((F.col("piece") * self.g + F.col("o_")).alias("cell"), "piece", "id", F.lit(None).cast("binary").alias("part"), "k", "held")

        def count(cells: pa.Table, sent: pa.Table) -> pa.Table:
            if not cells.num_rows:
                return _table([], pa.schema([("piece", pa.int64()), *((c, pa.binary()) for c in ("id", "label", "k", "held"))]))
            is_net = sent["part"].is_null()
            own = unpacked(sent.filter(np.logical_not(is_net.to_numpy())), ["id", "part"])
            reach = sent.filter(is_net)
            nets, per, held = _get_sorted(reach["id"][0]), _get(reach["k"][0]), _get(reach["held"][0])
            ends = np.cumsum(per)
            net, x = _held(cells, own)
            net, p, keys, sums = np.searchsorted(nets, net), own["part"] // width, [], []
            for s in range(0, len(net), CHUNK):
                i, pin = net[s : s + CHUNK], x[s : s + CHUNK]
                k = per[i]
                at = np.repeat(ends[i] - np.cumsum(k), k) + np.arange(k.sum())
                to, more, pin = held[at] % parts, held[at] >= parts, np.repeat(pin, k)
                counts = (to // branches == p[pin] // branches) & ((to != p[pin]) | more)
                pair = added(pin[counts] * branches + to[counts] % branches, np.ones(counts.sum(), np.int64), link_cells.DENSE + 1)
                keys.append(pair[0]), sums.append(pair[1])
            keys, sums = added(np.concatenate(keys), np.concatenate(sums), len(p) * branches)
            return pa.table(replies(own, own["part"], keys, sums, branches), names=["piece", "id", "label", "k", "held"])

        met = self.table.groupBy("cell").cogroup(pins.select(*SENT).unionAll(reached.select(*SENT)).groupBy("cell")).applyInArrow(count, REPLY)
        return by_node(met, branches, lambda part: part // width // branches * branches)
