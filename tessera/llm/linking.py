"""Exact set-similarity links between rows and their connected components, for operators on near duplicates.

A *node* is a distinct set: equal sets collapse before anything is compared, so a group of copies costs one node.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, stored
from tessera.llm.word_arrays import blocks, shingle_rows

#: Bits of a filter of keys that goes to every executor: BITS_EACH a key, MOST_BITS (32 MB) at most.
BITS_EACH, MOST_BITS = 16, 1 << 28


def node_of(values: np.ndarray) -> int:
    """The key of a set of sorted distinct hashes, as a signed 64-bit number."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets_of(texts: list[bytes], shingle: int):
    """The sorted distinct shingle hashes of each text, in order; none for a text without words."""
    for _, rows, w, at in blocks(texts):
        x, x_at = shingle_rows(w, at, shingle)
        for r in range(rows):
            yield np.unique(x[x_at[r] : x_at[r + 1]])


def bitmap(values: np.ndarray, per: int = 8) -> bytes:
    """A bit for each hash, in a width of per to 2 * per bits an element; wider ones fold to narrower ones by OR."""
    width = 1 << max(6, (per * len(values) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over edges u, v.  Labels spread to neighbours and jump along
    labels until none changes; each round is a written table, so nothing of it is collected or recomputed."""
    e = stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = e.join(labels, e["v"] == labels["node"]).select(F.col("u").alias("node"), "comp", F.lit(None).cast("long").alias("old"))
        met = labels.withColumn("old", F.col("comp")).unionByName(near).groupBy("node").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        up = labels.select(F.col("node").alias("parent"), F.col("comp").alias("above"))
        new = stored(met.join(up, F.col("comp") == F.col("parent"), "left").select("node", F.least("comp", F.coalesce("above", "comp")).alias("comp"), "old"), "labels")
        changed = new.where("comp <> old").limit(1).count()
        discard(labels)
        labels = new.select("node", "comp")
        labels.stored_at = new.stored_at
        if not changed:
            discard(e)
            return labels


def _bit(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (keys ^ (keys >> np.uint64(32))) & np.uint64(64 * len(words) - 1)


def in_filter(nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter.  Keys are well mixed already."""
    bit = _bit(nodes.view(np.uint64), words)
    return (words.view(np.uint64)[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def node_filter(nodes: DataFrame, count: int) -> np.ndarray:
    """A bit for each of count keys of a column ``node``, made by an aggregate of a row for 64 bits at most.

    Beyond MOST_BITS / BITS_EACH keys more and more other keys pass, which costs work and changes no result: whoever asks joins
    or verifies afterwards.
    """
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_EACH * count - 1).bit_length()))
    node = F.col("node")
    bit = node.bitwiseXOR(F.shiftrightunsigned(node, 32)).bitwiseAND(F.lit(bits - 1))
    words = nodes.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast((node ^ shiftrightunsigned(node, 32)) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 64, dtype=np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def verified(pairs: DataFrame, sets, num: int, den: int) -> DataFrame:
    """The pairs u, v of nodes whose sets have den * intersection >= num * union.

    sets(nodes) gives node, values for at least the nodes asked for.
    """
    s = sets(stored(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), "wanted"))
    one = s.select(F.col("node").alias("v"), F.col("values").alias("vs"))
    two = s.select(F.col("node").alias("u"), F.col("values").alias("us"))
    both = pairs.join(one, "v").join(two, "u")
    common = F.size(F.array_intersect("us", "vs"))
    return both.select("u", "v", common.alias("c"), (F.size("us") + F.size("vs") - common).alias("a")).where(den * F.col("c") >= num * F.col("a")).select("u", "v")
