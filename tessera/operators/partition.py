"""Balanced parts of one large network, as joins and aggregates: coarsening, hierarchical order, exchanges with quotas.

Pairs of nodes that are each other's heaviest neighbour merge, round after round, into heavier nodes.  Nodes in the order of the merges that
hold them, last merge first, are dealt to parts of equal size.  Then, level by level of the tree of parts, each node states the
sibling part that it would rather be in and what that gains; of the nodes that want to change between two parts the best of one side
change places with the best of the other, so sizes stay as they are; where the tolerance leaves a part room, the best of those that are left
move in as well.  A round that makes the objective worse is taken back.

Nothing comes to the driver but a count and a sum a round, and what lists of buckets it broadcasts: tables of nodes are never broadcast, which
would take them through the driver at every join.  Ranks are taken in buckets, so no task orders all that want to change between
two parts.  What a round costs grows with the links (or, for hyperedges, with each net's pins times the parts it reaches).  Links lie in
cells (``link_cells``), where a round sends numbers of nodes and no links; merging alone deals them anew.  Results
depend on the seed alone.  Nodes without links are dealt out in order; an empty network gives no rows; loops and repeated links
count as weights, links to unknown nodes are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import graph
from tessera.errors import InvalidConfigError
from tessera.operators.link_cells import LinkCells
from tessera.operators.net_cells import NetCells
from tessera.tables import Steps

#: Merging rounds at most; a round that leaves more than this part of the nodes is the last.
MERGES, SHRINKS = 12, 0.95
#: Buckets of equal gain in which ranks are taken.
BUCKETS = 64


@dataclass(frozen=True)
class PartSettings:
    """How to partition: so many parts; branches of the tree of parts (None: one level); the share by which a part may exceed the even
    size; rounds of exchanges a level; what to lessen (``cut``: weight of links between parts, ``connectivity``: parts that nets
    reach beyond one); strict: an error where a part stays empty."""

    parts: int
    branches: int | None = None
    tolerance: float = 0.0
    rounds: int = 2
    objective: str = "cut"
    seed: int = 42
    strict: bool = False

    def __post_init__(self):
        if self.parts < 1 or self.tolerance < 0 or self.rounds < 0 or self.objective not in ("cut", "connectivity"):
            raise InvalidConfigError("parts must be positive, tolerance and rounds not negative, the objective cut or connectivity")
        if self.branches is not None and (self.branches < 2 or self.branches ** len(self.widths) != self.parts):
            raise InvalidConfigError("parts must be a power of the branches")

    @property
    def widths(self) -> list[int]:
        """Parts below a part of each level, from the top."""
        if self.branches is None:
            return [1]
        out, w = [], 1
        while w < self.parts:
            out.insert(0, w)
            w *= self.branches
        return out or [1]


def links_of(neurons: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, w in both directions: links without direction, weighted by how many edges there are, between nodes that are there."""
    low, high = F.least("src", "tgt").alias("x"), F.greatest("src", "tgt").alias("y")
    one = edges.where("src <> tgt").groupBy(low, high).agg(F.count("*").alias("w"))
    known = neurons.select("id")
    one = one.join(known.withColumnRenamed("id", "x"), "x", "left_semi").join(known.withColumnRenamed("id", "y"), "y", "left_semi")
    return one.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("l"), "w").select("l.a", "l.b", "w")


def merged(nodes: DataFrame, links: DataFrame | LinkCells, most: int, seed: int = 42, steps: Steps | None = None) -> DataFrame:
    """id, up: nodes that are each other's heaviest neighbour, weight for size, have the smaller id of the two as up, others their own.

    Ratings and the hash that breaks ties are the same from both ends, so each connected group with a pair that fits merges one at least.
    """
    steps = steps or Steps(nodes.sparkSession)
    cells = links if isinstance(links, LinkCells) else LinkCells.of(nodes, links.where("a < b"), links.count(), steps)
    best = steps.keep(cells.heaviest(nodes, most, seed), "heaviest")
    pairs = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a")).hint("merge"), ["a", "b"]).where("a < b").select(F.col("b").alias("id"), F.col("a").alias("to"))
    return nodes.select("id").join(pairs.hint("merge"), "id", "left").select("id", F.coalesce("to", "id").alias("up"))


def coarsened(neurons: DataFrame, links: LinkCells, most: int, steps: Steps, seed: int = 42) -> list[DataFrame]:
    """Tables id, up of each merging round; no merged node holds more than most nodes."""
    nodes, out, own = steps.keep(neurons.select("id", F.lit(1).cast("long").alias("size")), "nodes"), [], links
    n = nodes.count()
    for k in range(MERGES):
        up = steps.keep(merged(nodes, own, most, seed + k, steps), "up")
        nodes = steps.keep(nodes.join(up.hint("merge"), "id").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("size")), "nodes")
        left = nodes.count()
        if left == n:
            break
        out.append(up)
        if left > SHRINKS * n or k == MERGES - 1:
            break
        n, own = left, own.merged(up, steps)
        steps.drop(links.table, own.table, nodes, *out, neurons)
    return out


def in_merge_order(neurons: DataFrame, merges: list[DataFrame]) -> DataFrame:
    """id, at: places from 0, nodes of a late merge together, within it those of an earlier one."""
    df, last = neurons.select("id"), "id"
    for k, up in enumerate(merges):
        df = df.join(up.toDF(last, f"up{k}").hint("merge"), last)
        last = f"up{k}"
    return graph.ranked(df, F.col(last), [*(f"up{k}" for k in reversed(range(len(merges) - 1))), "id"], "at").select("id", "at")


def _wishes(held: DataFrame, settings: PartSettings, width: int, round_: int) -> DataFrame:
    """id, part, p, own, to, gain from held(id, part, tos, ws): what a node has in its part and in that part's siblings; a row a node, no shuffle."""
    held = held.withColumn("p", F.expr(f"part DIV {width}")).withColumn("both", F.arrays_zip("ws", "tos"))
    own = F.coalesce(F.get(F.filter("both", lambda x: x["tos"] == F.col("p")), F.lit(0))["ws"], F.lit(0).cast("long"))
    tie = lambda to: graph.uniform(F.concat_ws(":", "id", to, F.lit(round_)), settings.seed)
    best = F.array_max(F.transform(F.filter("both", lambda x: x["tos"] != F.col("p")), lambda x: F.struct(x["ws"].alias("w"), tie(x["tos"]).alias("tie"), x["tos"].alias("to"))))
    return held.select("id", "part", "p", own.alias("own"), best.alias("best")).select("id", "part", "p", "own", F.col("best.to").alias("to"), (F.col("best.w") - F.col("own")).alias("gain"))


def cut_wishes(labels: DataFrame, links: LinkCells, settings: PartSettings, width: int, round_: int) -> DataFrame:
    """What each linked node has in its own part, and the sibling part it has most in."""
    return _wishes(links.siblings(labels, width, settings.branches or settings.parts), settings, width, round_)


def net_wishes(labels: DataFrame, nets: NetCells, settings: PartSettings, width: int, round_: int) -> DataFrame:
    """The same for nets: in another part a pin has the nets that reach it already, in its own those that would reach it without the pin."""
    return _wishes(nets.siblings(labels, width, settings.branches or settings.parts, settings.parts), settings, width, round_)


def changes(wishes: DataFrame, settings: PartSettings, round_: int) -> tuple[DataFrame, DataFrame]:
    """(id, part after an exchange, and the rank) for nodes that change places: the k-th best from p to q with the k-th best from q to p,
    while both together gain.  A coin for each node and round keeps half of them still, so neighbours seldom move at once.

    Second: what is left and would gain by itself.
    """
    coin = graph.uniform(F.concat_ws(":", "id", F.lit(round_)), settings.seed + 1)
    own = wishes.where(F.col("to").isNotNull() & (coin < 2**31)).withColumn("tie", coin)
    ranked = graph.ranked_within(own, ["p", "to"], F.struct((-F.col("gain")).alias("g"), F.pmod("tie", F.lit(BUCKETS)).alias("b")), ["tie", "id"], "rank")
    up = ranked.where("p < to").select("id", "part", F.col("p").alias("x"), F.col("to").alias("y"), "rank", "gain")
    down = ranked.where("p > to").select(F.col("id").alias("id2"), F.col("part").alias("part2"), F.col("to").alias("x"), F.col("p").alias("y"), "rank", F.col("gain").alias("gain2"))
    pairs = up.join(down.hint("merge"), ["x", "y", "rank"]).where(F.col("gain") + F.col("gain2") > 0)
    moved = pairs.select(F.explode(F.array(F.struct(F.col("id").alias("id"), F.col("part2").alias("new")), F.struct(F.col("id2").alias("id"), F.col("part").alias("new")))).alias("m")).select("m.*")
    return moved, ranked.where("gain > 0").join(moved.hint("merge"), "id", "left_anti").select("id", "part", "to", "gain", "tie")


def moved_in(left: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """id, new: of the nodes that are left the best ones, as many as each part has room for."""
    room = labels.groupBy(F.col("part").alias("to")).agg((F.lit(limit) - F.count("*")).alias("room"))
    ranked = graph.ranked_within(left, ["to"], F.struct((-F.col("gain")).alias("g"), F.pmod("tie", F.lit(BUCKETS)).alias("b")), ["tie", "id"], "rank")
    return ranked.join(room, "to").where("rank < room").select("id", F.col("to").alias("new"))


def balanced_parts(neurons: DataFrame, edges: DataFrame, settings: PartSettings, pins: DataFrame | NetCells | None = None, links: LinkCells | None = None) -> DataFrame:
    """neuron, part: parts 0 to parts - 1, numbered depth first where there are branches, none larger than the even size rounded up and the
    tolerance.  pins(net, pin) are the nets whose connectivity is lessened, each neuron with its sources where none are given.  links: those
    of the edges, where they are in cells already."""
    steps = Steps(neurons.sparkSession)
    nodes = steps.keep(neurons.select("id").distinct(), "neurons")
    n, k = nodes.count(), settings.parts
    links = links or LinkCells.of_edges(nodes, edges, steps)
    even = -(-n // k) if n else 0
    limit = max(even, int((1 + settings.tolerance) * n / k))
    merges = coarsened(nodes, links, max(1, even), steps, settings.seed)
    labels = steps.keep(in_merge_order(nodes, merges).select("id", F.expr(f"`at` * {k} DIV {max(1, n)}").alias("part")), "labels")
    if settings.objective == "connectivity":
        if pins is None:
            over = NetCells.of_edges(nodes, edges, steps)
        else:
            over = pins if isinstance(pins, NetCells) else NetCells.of(nodes, pins, pins.count(), steps)
        wishes_of = net_wishes
    else:
        over, wishes_of = links, cut_wishes
    round_ = 0
    for width in settings.widths:
        best, kept = labels, None
        for turn in range(settings.rounds + 1):  # the last turn only looks at what the round before has done
            wishes = steps.keep(wishes_of(labels, over, settings, width, round_), "wishes")
            now = wishes.agg(F.sum("own")).first()[0] or 0
            if kept is None or now > kept:
                best, kept = labels, now
            elif now < kept:
                wishes = steps.keep(wishes_of(best, over, settings, width, round_), "wishes")
            if turn == settings.rounds:
                break
            moved, left = changes(wishes, settings, round_)
            after = best.join(moved.hint("merge"), "id", "left").select("id", F.coalesce("new", "part").alias("part"))
            if limit > even and width == 1:
                after = steps.keep(after, "labels")
                more = moved_in(left, after, limit)
                after = after.join(more.hint("merge"), "id", "left").select("id", F.coalesce("new", "part").alias("part"))
            labels = steps.keep(after, "labels")
            round_ += 1
        labels = best
    if settings.strict and labels.select("part").distinct().count() < k:
        raise ValueError("a part stays empty")
    steps.drop(labels)
    return labels.select(F.col("id").alias("neuron"), "part")


def cut_of(labels: DataFrame, links: DataFrame | LinkCells, part: Column | str = "part") -> DataFrame:
    """One row: cut, the weight of links between parts (each link once)."""
    own = labels.select(F.col("neuron"), (F.col(part) if isinstance(part, str) else part).alias("part"))
    if isinstance(links, LinkCells):
        return links.cut(own.withColumnRenamed("neuron", "id"))
    ends = links.where("a < b").join(own.toDF("a", "pa"), "a").join(own.toDF("b", "pb"), "b")
    return ends.agg(F.coalesce(F.sum(F.when(F.col("pa") != F.col("pb"), F.col("w"))), F.lit(0)).cast("long").alias("cut"))


def connectivity_of(labels: DataFrame, pins: DataFrame | NetCells, parts: int | None = None) -> DataFrame:
    """One row: over, the parts that nets reach beyond one; of nets in cells, with how many parts there are."""
    if isinstance(pins, NetCells):
        return pins.over(labels.withColumnRenamed("neuron", "id"), parts)
    reach = pins.join(labels.withColumnRenamed("neuron", "pin"), "pin").select("net", "part").distinct()
    return reach.groupBy("net").agg((F.count("*") - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("over"))
