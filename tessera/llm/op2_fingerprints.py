"""MinHash fingerprints: universal hash permutations over word shingles, and near duplicates by signature bands.

A text's shingles are its runs of five words; a text with fewer words has one shingle of them all, a text without
words none.  Each of PERMUTATIONS functions x -> a*x + b modulo 2**32 (a odd, so a permutation) is applied to all
shingle hashes of a block at once, and each text keeps the smallest value of each.  A fingerprint is the lower 16
bits of every smallest value in hexadecimal; the share of equal places estimates Jaccard similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import IdShards, bounded_batches, shuffle_width
from tessera.llm.word_arrays import blocks, mix, shingle_rows

PERMUTATIONS = 128
SHINGLE = 5
#: Bands of the signature and values in each.
BANDS, ROWS = 25, 5
_A = (mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Shingles that are permuted at a time, so that they stay in the processor's cache.
RUN = 1 << 16


def _smallest(x: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """out[r] = the smallest value of each permutation over x[at[r]:at[r + 1]]; rows without shingles keep what they have."""
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return
    lo = 0
    while lo < len(full):
        hi = int(np.searchsorted(at[full + 1], at[full[lo]] + RUN, "right"))
        if hi <= lo:  # one long text: in runs
            r = full[lo]
            for s in range(int(at[r]), int(at[r + 1]), RUN):
                part = x[s : min(s + RUN, int(at[r + 1]))]
                for p in range(PERMUTATIONS):
                    v = (part * _A[p] + _B[p]).min()
                    if v < out[r, p]:
                        out[r, p] = v
            lo += 1
            continue
        rows = full[lo:hi]
        part, starts = x[at[rows[0]] : at[rows[-1] + 1]], at[rows] - at[rows[0]]
        buf = np.empty_like(part)
        for p in range(PERMUTATIONS):
            np.multiply(part, _A[p], out=buf)
            buf += _B[p]
            out[rows, p] = np.minimum.reduceat(buf, starts)
        lo = hi


def signatures(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """One row of PERMUTATIONS 16-bit values for each text; a text without words has the largest value everywhere."""
    out = np.full((len(texts), PERMUTATIONS), 0xFFFFFFFF, dtype=np.uint32)
    for first, rows, w, at in blocks(texts):
        x, x_at = shingle_rows(w, at, shingle)
        _smallest((x >> np.uint64(32)).astype(np.uint32), x_at, out[first : first + rows])
    return (out & np.uint32(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 64 << 20) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next text's.

    The edited text has its last half replaced by the start of the next text in ascending id, after the last the
    first.  Rows of one id go by their text.  Null ids come first, null texts are empty; one row is its own next.
    Texts move once, by ranges of ids; each range also gets the row that opens the next one.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 64
    spark = df.sparkSession
    bounded_batches(spark)
    total = df.agg(F.sum(size)).first()[0] or 0
    shards = IdShards(df.select(F.col(id_col).cast("long").alias("id"), text_col), "id", size, max(shuffle_width(spark), -(-total // shard_bytes)))
    n = shards.n
    before = F.when(F.col("opens_"), F.array(F.struct(F.col("shard_").alias("shard"), F.lit(0).alias("after")), F.struct(F.pmod(F.col("shard_") - 1, F.lit(n)).alias("shard"), F.lit(1).alias("after")))).otherwise(F.array(F.struct(F.col("shard_").alias("shard"), F.lit(0).alias("after"))))
    dealt = shards.assign(rows).select("id", "text", F.explode(before).alias("to")).select("to.shard", "to.after", "id", "text")
    sorted_ = dealt.repartitionById(n, "shard").sortWithinPartitions("shard", "after", F.asc_nulls_first("id"), "text")

    def edit(batches):
        import pyarrow as pa

        held: tuple | None = None  # the last row, which waits for the next
        done = None  # a shard whose following row has come
        for b in batches:
            col = [c.to_pylist() for c in b.columns]
            for k in range(0, b.num_rows, 256):
                pairs, reach = [], min(b.num_rows, k + 256)
                for i in range(k, reach):
                    shard, after, id_, text = col[0][i], col[1][i], col[2][i], col[3][i]
                    if held is not None and held[0] == shard and done != shard:
                        pairs.append((held[1], held[2], text))
                    if after:
                        done = shard
                        held = None
                    else:
                        held = (shard, id_, text)
                if pairs:
                    yield _edited(pairs, pa)

    def _edited(pairs, pa):
        own = [p[1].encode() for p in pairs]
        edited = [(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode() for _, t, nxt in pairs]
        sig = signatures([*own, pairs[-1][2].encode()])
        sig_e = signatures(edited)
        follow = sig[1:].copy()
        for i in range(len(pairs) - 1):  # the next row of a pair is the following pair's own text, but where shards meet
            if pairs[i][2] is not pairs[i + 1][1] and pairs[i][2] != pairs[i + 1][1]:
                follow[i] = signatures([pairs[i][2].encode()])[0]
        mine = sig[:-1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                pa.array([r.tobytes().hex() for r in mine]),
                pa.array([r.tobytes().hex() for r in sig_e]),
                pa.array(likeness(mine, sig_e)),
                pa.array(likeness(mine, follow)),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    out = sorted_.mapInArrow(edit, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def band_keys(values: np.ndarray) -> np.ndarray:
    """The keys of a set's signature bands: BANDS hashes of ROWS smallest values each."""
    out = np.full((1, PERMUTATIONS), 0xFFFFFFFF, dtype=np.uint32)
    _smallest((values >> np.uint64(32)).astype(np.uint32), np.array([0, len(values)]), out)
    rows = out[0, : BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id: classes of texts joined by verified Jaccard similarities of 0.8 or more.

    Candidates share a signature band; at 0.8 a pair shares one with probability 0.99995.  They are verified on whole sets,
    by way of pivots and signature trees, so a large band is never spelled out in pairs.  Texts null, empty or without words are
    linked with nothing; rows without an id are linked like others and are never the smallest; repeated rows get the same class; an
    empty table gives an empty result; other columns do not matter.
    """
    from tessera.llm.op10_jaccard_join import join

    return join(df, id_col, text_col, SHINGLE, 80, 100, lower=False, keys=band_keys)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
