"""Exact n-gram Jaccard self-join with signature trees.

1. Each text becomes its set of distinct shingle hashes; equal sets become one node.
2. In any one order of all hashes, nodes that can link share one of the first n - ceil(t*n) + 1 of either's n hashes, so these
   deal the nodes to groups.  The order puts hashes that are frequent within some run of texts last (a filter of fixed size names
   them); that only keeps groups small.  Groups of one node go, and of groups with the same members one stays.
3. Within a group and band of sizes every node is first held against one pivot, the node most of whose hashes others share
   (in a family of edited copies that nearest to the common text).  What links there is joined to components, so copies with
   small edits hardly ever meet in pairs.
4. Groups that still hold two components get a signature tree: its nodes hold the OR of their members' token bitmaps and
   the range of their sizes.  A dual traversal leaves out node pairs whose sizes are too far apart, whose bitmaps allow
   too small an overlap, or whose members are all connected; what remains is held against wider bitmaps, a pair once, and
   then verified on the whole sets.
5. Components over all verified links.

Groups are cut by bands of sizes (a link's sizes differ by 1/t at most) and into blocks of BLOCK_NODES; a task holds two
blocks of one group, and a family's groups are dealt out by DEAL_ROWS rows.  Filters that are broadcast grow with what they hold up
to 32 MB.  Texts null, empty or without words have an empty set and are linked with nothing; repeated rows link as
equal sets; a row without an id is linked like any other but is never the smallest of others, and alone has no component_id;
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, discard, stored
from tessera.llm.linking import BITS_EACH, MOST_BITS, bitmap, components, in_filter, node_filter, node_of, sets_of, verified

#: Nodes of one block, and members of a leaf of the tree.
BLOCK_NODES, LEAF = 1024, 32
#: Hashes that are counted together, and texts among theirs that make a hash frequent.
RUN_HASHES, FREQUENT = 1 << 22, 3
#: Partners of a node in another component that are verified first, in groups of at least so many nodes.
LIKELIEST, FAMILY = 2, 64
#: Rows of one family's groups that go to one task, about, and pairs that a task holds before it gives them out.
DEAL_ROWS, HELD_PAIRS = 1024, 1_000_000


class SignatureTree:
    """A binary tree over sets sorted by size and first bits; bitmaps of one width."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        self.bits, self.sizes, self.comps = bits, sizes, comps
        self.excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(sizes))

    def _build(self, lo: int, hi: int) -> int:
        kids = None
        if hi - lo > LEAF:
            mid = (lo + hi) // 2
            kids = (self._build(lo, mid), self._build(mid, hi))
            union = self.nodes[kids[0]][2] | self.nodes[kids[1]][2]
        else:
            union = np.bitwise_or.reduce(self.bits[lo:hi], axis=0)
        c = self.comps[lo:hi]
        same = c[0] if (c == c[0]).all() else None
        self.nodes.append((lo, hi, union, int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), int(self.excess[lo:hi].max()), same, kids))
        return len(self.nodes) - 1


def dual_traversal(x: SignatureTree, y: SignatureTree, num: int, den: int):
    """(i, j) arrays: every pair of x and y in different components that can link.  x may be y; then i < j."""
    stack, out_i, out_j = [(x.root, y.root)], [], []
    while stack:
        a, b = stack.pop()
        lo1, hi1, or1, min1, max1, ex1, same1, kids1 = x.nodes[a]
        lo2, hi2, or2, min2, max2, ex2, same2, kids2 = y.nodes[b]
        if x is y and lo1 > lo2:
            continue
        if same1 is not None and same1 == same2:
            continue
        if den * max1 < num * min2 or den * max2 < num * min1:
            continue
        need = -(-num * (min1 + min2) // (num + den))
        if int(np.bitwise_count(or1 & or2).sum()) + min(ex1, ex2) < need:
            continue
        if kids1 is None and kids2 is None:
            p, q = x.bits[lo1:hi1, None, :], y.bits[None, lo2:hi2, :]
            n1, n2 = x.sizes[lo1:hi1, None], y.sizes[None, lo2:hi2]
            only1 = np.bitwise_count(p & ~q).sum(axis=2, dtype=np.int64)
            only2 = np.bitwise_count(q & ~p).sum(axis=2, dtype=np.int64)
            most = np.minimum(n1 - only1, n2 - only2)
            fits = ((num + den) * most >= num * (n1 + n2)) & (x.comps[lo1:hi1, None] != y.comps[None, lo2:hi2])
            if x is y and a == b:
                fits &= np.arange(hi1 - lo1)[:, None] < np.arange(hi2 - lo2)[None, :]
            i, j = np.nonzero(fits)
            out_i.append(i + lo1)
            out_j.append(j + lo2)
            continue
        if kids1 is not None and (kids2 is None or hi1 - lo1 >= hi2 - lo2):
            if x is y and a == b:
                stack += [(kids1[0], kids1[0]), (kids1[0], kids1[1]), (kids1[1], kids1[1])]
            else:
                stack += [(k, b) for k in kids1]
        else:
            stack += [(a, k) for k in kids2]
    empty = np.empty(0, dtype=np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (empty, empty)


def _folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the narrowest width."""
    width = min(map(len, bits)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, dtype=np.uint64).reshape(-1, width), axis=0) for b in bits])


def frequent_hashes(df: DataFrame, text_col: str, shingle: int, lower: bool) -> np.ndarray:
    """A filter of the hashes that at least FREQUENT of some RUN_HASHES hashes' texts hold, in as many runs as leaves the filter room."""
    texts = df.select(F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def counted():
            x = np.concatenate(held)
            held.clear()
            x.sort()
            often = np.unique(x[FREQUENT - 1 :][x[FREQUENT - 1 :] == x[: 1 - FREQUENT]])
            return pa.RecordBatch.from_arrays([pa.array(often.view(np.int64))], ["node"])

        for b in batches:
            for at in range(0, b.num_rows, 512):
                raw = b.column(0).slice(at, 512).cast(pa.binary()).to_pylist()
                for v in sets_of([t.lower() for t in raw] if lower else raw, shingle):
                    held.append(v)
                    size += len(v)
                if size >= RUN_HASHES:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    runs = stored(texts.mapInArrow(run, "node long").groupBy("node").agg(F.count("*").alias("runs")), "frequent")
    least, room = 1, MOST_BITS // BITS_EACH
    while (count := runs.where(F.col("runs") >= least).count()) > room:
        least *= 2
    out = node_filter(runs.where(F.col("runs") >= least), count)
    discard(runs)
    return out


def profiles(df: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int, lower: bool = True, keys=None) -> DataFrame:
    """id, n, node, prefix (or what keys makes of a set), bits, wide for each row; node and bitmaps are null for an empty set.

    Of equal sets in one task only the first carries prefix and bitmaps, so a large group of copies gives a few rows of them.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    last = None if keys else df.sparkSession.sparkContext.broadcast(frequent_hashes(df, text_col, shingle, lower))

    def run(batches):
        import pyarrow as pa

        seen = set()
        for b in batches:
            for at in range(0, max(1, b.num_rows), 512):
                part = b.slice(at, 512)
                texts = [(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                texts = [t.lower() for t in texts] if lower else texts
                n, node, prefix, bits, wide = [], [], [], [], []
                for v in sets_of(texts, shingle):
                    k = len(v)
                    own = node_of(v) if k else None
                    first = k > 0 and own not in seen
                    n.append(k)
                    node.append(own)
                    if not first:
                        prefix.append(np.empty(0, dtype=np.int64))
                    elif keys:
                        prefix.append(keys(v).view(np.int64))
                    else:
                        late = in_filter(v, last.value)
                        tokens = np.concatenate([v[~late] >> np.uint64(1) ^ np.uint64(1 << 63), v[late] >> np.uint64(1)])  # in signed order
                        prefix.append(tokens[: k - -(-num * k // den) + 1].view(np.int64))
                    seen.add(own)
                    bits.append(bitmap(v, 2) if first else None)
                    wide.append(bitmap(v, 8) if first else None)
                ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                flat = np.concatenate(prefix) if prefix else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())], ["id", "n", "node", "prefix", "bits", "wide"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n long, node long, prefix array<long>, bits binary, wide binary")


def whole_sets(df: DataFrame, text_col: str, shingle: int, lower: bool = True):
    """A function that gives node, values of wanted nodes from another scan of the texts; nothing but those is moved."""

    def sets(wanted: DataFrame) -> DataFrame:
        keep = df.sparkSession.sparkContext.broadcast(node_filter(wanted, wanted.count()))
        texts = df.select(F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())

        def run(batches):
            import pyarrow as pa

            seen = set()
            for b in batches:
                for at in range(0, max(1, b.num_rows), 512):
                    raw = b.column(0).slice(at, 512).cast(pa.binary()).to_pylist()
                    raw = [t.lower() for t in raw] if lower else raw
                    nodes, values = [], []
                    for v in sets_of(raw, shingle):
                        if len(v) and (node := node_of(v)) not in seen and in_filter(np.array([node]), keep.value)[0]:
                            seen.add(node)
                            nodes.append(node)
                            values.append(v.view(np.int64))
                    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
                    flat = np.concatenate(values) if values else np.empty(0, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "values"])

        every = texts.mapInArrow(run, "node long, values array<long>")
        return every.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("values").alias("values"))

    return sets


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, num: int = 85, den: int = 100, lower: bool = True, keys=None) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links of Jaccard >= num / den), one row a row of df.

    With keys (a set's hashes to its group keys) candidates come from those groups instead of prefixes.
    """
    bounded_batches(df.sparkSession)
    rows = stored(profiles(df, id_col, text_col, shingle, num, den, lower, keys), "profiles")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num)) + F.lit(1e-9)).cast("long")

    # groups of two nodes or more by a shared prefix hash; of those with the same members (and copies of members) one is compared
    prefix = rows.where("node is not null").select(F.posexplode("prefix").alias("pos", "a"), "node", "n")
    if keys:
        prefix = prefix.withColumn("pos", F.lit(0))  # places of band keys say nothing about overlaps
    h = F.xxhash64("node")
    halves = F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"), F.sum(F.shiftright(h, 32)).alias("t")
    shared = prefix.groupBy("a").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("k"), *halves).where("lo < hi")
    shared = stored(shared, "shared")
    one = shared.groupBy("lo", "hi", "k", "s", "t").agg(F.min("a").alias("a")).select("a", F.lit(True).alias("one"))
    flagged = shared.select("a", "lo").join(one, "a", "left").withColumn("one", F.coalesce("one", F.lit(False)))
    every = stored(prefix.join(flagged, "a").distinct().withColumn("band", band), "groups")
    length = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    known = every.groupBy("node", "n").agg(F.count("*").alias("k")).select("node", (F.col("k") / length).alias("known"))
    groups = stored(every.where("one").select("a", "lo", "pos", "node", "n", "band").join(known, "node"), "groups")
    discard(shared, every)

    # one pivot for each group and band; a band also holds the one below
    homes = F.array(F.struct(F.col("band").alias("b"), F.lit(True).alias("home")), F.struct((F.col("band") + 1).alias("b"), F.lit(False).alias("home")))
    met = groups.select("a", "lo", "pos", "node", "n", "known", F.explode(homes).alias("to")).select("a", "lo", "pos", "to.b", "to.home", "node", "n", "known")
    pivots = met.groupBy("a", "b").agg(F.max(F.struct("known", "node", "n")).alias("p"), F.max("home").alias("any"), F.count("*").alias("k")).where("k > 1 and any").select("a", "b", F.col("p.node").alias("u"), F.col("p.n").alias("un"))
    star = met.join(pivots, ["a", "b"]).where(F.col("u") != F.col("node")).where(f"{den} * least(n, un) >= {num} * greatest(n, un)").select("u", F.col("node").alias("v")).distinct()
    bitmaps = rows.where("bits is not null").select("node", "n", "bits", "wide").join(groups.select("node").distinct(), "node", "left_semi")
    bitmaps = stored(bitmaps.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide")), "bits")
    bits, wide = bitmaps.select("node", "n", "bits"), bitmaps.select("node", "n", F.col("wide").alias("bits"))
    sets = whole_sets(df, text_col, shingle, lower)
    star = stored(_possible(star, wide, num, den), "star")
    edges = stored(verified(star, sets, num, den), "links")
    labels = components(edges)
    discard(star)

    # what is left in groups of two components or more: first the likeliest partners in each other component, then all
    for most, least in ((LIKELIEST, FAMILY), (None, 2)):
        pairs = stored(_possible(_traversed(_open_groups(met, labels, least, num, den).join(bits, "node"), num, den, most).distinct(), wide, num, den), "pairs")
        if pairs.limit(1).count():
            before, old = edges, labels
            edges = stored(edges.unionByName(verified(pairs, sets, num, den)), "links")
            labels = components(edges)
            discard(before, old)
        discard(pairs)
    discard(groups, bitmaps, edges)

    classed = rows.select("id", "n", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = stored(classed.where("node is not null").groupBy("comp").agg(F.min("id").alias("least")), "least")  # written, so that Spark can split a large class
    out = classed.join(least, "comp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _open_groups(met: DataFrame, labels: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """The members of groups a, b of at least so many nodes in two components, once for each pair of blocks p, q they take part in.

    A member goes where its place in hash order leaves too few hashes for a link with even the smallest of the group:
    what it links with shares an earlier hash.
    """
    named = met.join(labels, "node", "left").select("a", "lo", "pos", "b", "home", "node", "n", F.coalesce("comp", "node").alias("comp"))
    open_ = named.groupBy("a", "b").agg(F.first("lo").alias("lo"), F.min("comp").alias("lo_"), F.max("comp").alias("hi_"), F.max("home").alias("any"), F.min("n").alias("small"), F.count("*").alias("k")).where(f"lo_ < hi_ and any and k >= {least}")
    family = open_.groupBy("lo", "b").agg(F.ceil(F.sum("k") / DEAL_ROWS).cast("long").alias("deals"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("k") / BLOCK_NODES)).cast("long")
    dealt = open_.join(family, ["lo", "b"]).select("a", "b", "small", blocks.alias("blocks"), F.pmod(F.xxhash64("a"), "deals").alias("deal"))
    need = F.ceil(F.lit(num) * (F.col("n") + F.greatest("small", F.ceil(F.col("n") * num / den))) / (num + den))
    left = named.join(dealt, ["a", "b"]).where(F.col("n") - F.col("pos") >= need).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q")))
    left = left.withColumn("m", F.explode(others))
    return left.select("lo", "deal", "b", "blocks", "m.p", "m.q", "a", "pos", "home", "node", "comp", "block")


def _possible(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs u, v whose bitmaps leave room for a link."""
    both = pairs.join(bits.select(F.col("node").alias("v"), F.col("n").alias("vn"), F.col("bits").alias("vb")), "v")
    both = both.join(bits.select(F.col("node").alias("u"), F.col("n").alias("un"), F.col("bits").alias("ub")), "u").select("u", "v", "un", "vn", "ub", "vb")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = []
            for un, vn, ub, vb in zip(*(b.column(k) for k in range(2, 6))):
                m, un, vn = _folded([ub.as_py(), vb.as_py()]), un.as_py(), vn.as_py()
                most = min(un - int(np.bitwise_count(m[0] & ~m[1]).sum()), vn - int(np.bitwise_count(m[1] & ~m[0]).sum()))
                keep.append((num + den) * most >= num * (un + vn))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _traversed(left: DataFrame, num: int, den: int, most: int | None) -> DataFrame:
    """Candidate pairs u, v of every group and pair of blocks; with ``most`` only a node's likeliest partners in each other component.

    Groups with one smallest member are mostly one family's; up to DEAL_ROWS rows of them go to one task a pair of blocks, which gives
    their pairs once.  Rows come sorted; a group at a time is held, and HELD_PAIRS pairs.
    """
    keys = ["lo", "deal", "b", "blocks", "p", "q"]

    def compared(rows):
        bits, sizes = _folded([r[12] for r in rows]), np.array([r[7] for r in rows])
        nodes, comps, pos, home, block = (np.array([r[k] for r in rows]) for k in (8, 9, 10, 11, 13))
        p, q = rows[0][4:6]
        if p == q:
            t = SignatureTree(bits, sizes, comps)
            i, j = dual_traversal(t, t, num, den)
        else:
            one, two = np.flatnonzero(block == p), np.flatnonzero(block == q)
            if not len(one) or not len(two):
                return None
            i, j = dual_traversal(SignatureTree(bits[one], sizes[one], comps[one]), SignatureTree(bits[two], sizes[two], comps[two]), num, den)
            i, j = one[i], two[j]
        need = -(-num * (sizes[i] + sizes[j]) // (num + den))
        keep = (home[i] | home[j]) & (np.minimum(sizes[i] - pos[i], sizes[j] - pos[j]) >= need)  # else their first common hash comes earlier
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        far = np.array([int(np.bitwise_count(bits[s] ^ bits[t]).sum()) for s, t in zip(i, j)]) if most else np.zeros(len(i), dtype=np.int64)
        flip = nodes[i] > nodes[j]
        u, v = np.where(flip, j, i), np.where(flip, i, j)
        return np.stack([nodes[u], nodes[v], comps[u], comps[v], far])

    def once(found):
        every = np.concatenate(found, axis=1)
        order = np.lexsort((every[1], every[0]))
        every = every[:, order]
        return every[:, np.concatenate(([True], (np.diff(every[0]) != 0) | (np.diff(every[1]) != 0)))]

    def likeliest(every):
        chosen = np.zeros(every.shape[1], dtype=bool)
        for own, other in ((0, 3), (1, 2)):
            order = np.lexsort((every[4], every[other], every[own]))
            new = np.concatenate(([True], (np.diff(every[own][order]) != 0) | (np.diff(every[other][order]) != 0)))
            at = np.arange(len(order))
            rank = at - np.maximum.accumulate(np.where(new, at, 0))
            chosen[order[rank < most]] = True
        return every[:, chosen]

    def run(batches):
        import pyarrow as pa

        held, at, found = [], None, []

        def out():
            every = once(found)
            every = likeliest(every) if most else every
            return pa.RecordBatch.from_arrays([pa.array(every[0]), pa.array(every[1])], ["u", "v"])

        def group():
            if len(held) > 1 and (pairs := compared(held)) is not None:
                found.append(pairs)
                if sum(f.shape[1] for f in found) > HELD_PAIRS:
                    found[:] = [once(found)]
                    if found[0].shape[1] > HELD_PAIRS // 2:
                        yield out()
                        found.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:7] != at:
                    yield from group()
                    if at is not None and row[:6] != at[:6] and found:
                        yield out()
                        found.clear()
                    held, at = [], row[:7]
                held.append(row)
        yield from group()
        if found:
            yield out()

    sorted_ = left.select(*keys, "a", "n", "node", "comp", "pos", "home", "bits", "block").repartition(*keys).sortWithinPartitions(*keys, "a", "n", "node")
    return sorted_.mapInArrow(run, "u long, v long")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
