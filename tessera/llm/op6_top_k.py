"""Exact top-k inner products over vectors in descending length.

Vectors are rotated to the axes of their second-moment matrix, so the first HEAD coordinates carry most of every product.
For a query and a vector, Cauchy-Schwarz bounds the product by their lengths, and the product of what follows the first
coordinates by the lengths of the remainders; pairs whose bound is below the query's k-th best score so far are left out, and a run of
vectors is skipped where its longest is too short for every query.  First scores come from the longest HEAVIEST vectors of all.
A partition may hold several sorted files one after the other, so lengths can rise again within it: each run has its own bound.
What is left is scored in whole numbers, so results are exact.

Queries, with their first scores, are a table in the shared folder.  One plan does the rest: a task holds CHUNK_BYTES of vectors at a
time and reads the queries past them in blocks of BLOCK, so nothing grows with the number of queries or vectors, and each task gives at
most k rows a query and chunk.  Rows without an id take no part, nor do vectors null or with null or non-finite components;
shorter vectors count as padded with zeros; rows that share an id are a candidate each, those of a query's id are
its own and, as queries, share one list of the best scores of any of them; a product beyond 64 bits is an error; an empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, shuffle_width, stored

BLOCK, HEAVIEST, HEAD, RUN = 4096, 1024, 16, 1024
#: Bytes of vectors that a task holds against all queries at a time.
CHUNK_BYTES = 32 << 20
_EXACT = float(1 << 52)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (whole numbers as doubles), norm: every row that takes part, longest first within each partition."""
    bounded_batches(df.sparkSession)
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).repartition(shuffle_width(df.sparkSession))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return stored(rows.withColumn("norm", norm).sortWithinPartitions(F.desc("norm")), "vectors")


def _matrix(column, d: int) -> np.ndarray:
    """An Arrow list column as rows of d numbers."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets)
    n = np.diff(ends)
    if len(n) and (n == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(n), d))
    for r, (a, k) in enumerate(zip(np.cumsum(n) - n, n)):
        out[r, :k] = flat[a : a + k]
    return out


def _rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthonormal axes, the largest second moment first, from all vectors: d * d sums, made in each partition and then summed."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((d, d))
        for b in batches:
            m = _matrix(b.column(0), d)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["i", "x"])

    sums = vectors.select("v").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros(d * d)
    gram[sums["i"].to_numpy()] = sums["x"].to_numpy()
    return np.linalg.eigh(gram.reshape(d, d))[1][:, ::-1]


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number products row by row."""
    if not len(q):
        return np.empty(0, dtype=np.int64)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < _EXACT:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q, c)]
    return np.array(exact, dtype=np.int64)


class TopK:
    """The best k of each of a block of queries, fed with runs of vectors; the longer ones first is faster, any order is right."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, axes: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.axes, self.k = ids, q, axes, k
        r = q @ axes
        self.first, self.norm = r[:, :HEAD], np.linalg.norm(q, axis=1)
        self.rest = np.linalg.norm(r[:, HEAD:], axis=1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()

    def feed(self, ids: np.ndarray, c: np.ndarray, norms: np.ndarray) -> None:
        longest = norms.max()
        slack = 0.5 + 1e-9 * self.norm * longest
        live = np.flatnonzero(self.norm * longest + slack >= self.floor)
        if not len(live):
            return
        r = c @ self.axes
        most = self.first[live] @ r[:, :HEAD].T
        most += self.rest[live, None] * np.linalg.norm(r[:, HEAD:], axis=1)[None, :]
        i, j = np.nonzero(most + slack[live, None] >= self.floor[live, None])
        if len(i) * 50 > most.size and np.abs(self.q).max() * np.abs(c).max() * c.shape[1] < _EXACT:
            whole = (self.q[live] @ c.T)[i, j]  # so many are left that one product of all is cheaper; exact, being whole numbers
            near = whole >= self.floor[live[i]]
            i, j = live[i[near]], j[near]
        else:
            whole, i = None, live[i]
        other = self.ids[i] != ids[j]
        if whole is not None:
            score = whole[near][other].astype(np.int64)
        i, j = i[other], j[other]
        score = score if whole is not None else np.concatenate([_scores(self.q[i[s : s + 65536]], c[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.empty(0, dtype=np.int64)])
        good = score >= self.floor[i]
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else []
        for s in starts:
            at = int(i[s])
            e = min(int(np.searchsorted(i, at, "right")), s + self.k)
            own = sorted(self.best[at] + [(-int(x), int(y)) for x, y in zip(score[s:e], ids[j[s:e]])])[: self.k]
            self.best[at] = own
            if len(own) == self.k:
                self.floor[at] = max(self.floor[at], -own[-1][0])


def _query_blocks(path: str):
    """ids, vectors and first scores of a stored table of queries, BLOCK rows at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    for info in sorted(store.get_file_info(fs.FileSelector(place)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(BLOCK, columns=["id", "v", "floor"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; vectors as whole_vectors() gives them, queries some of their rows."""
    spark = vectors.sparkSession
    d = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    axes = _rotation(vectors, d)
    heavy = vectors.orderBy(F.desc("norm"), "id").limit(HEAVIEST).toArrow()
    sent = spark.sparkContext.broadcast((axes, heavy.column("id").to_numpy(), _matrix(heavy.column("v"), d), heavy.column("norm").to_numpy()))

    def begun(batches):
        import pyarrow as pa

        axes, ids, rows, norms = sent.value
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                part = b.slice(s, BLOCK)
                own = TopK(part.column(0).to_numpy(), _matrix(part.column(1), d), axes, k)
                for r in range(0, len(ids), RUN):
                    own.feed(ids[r : r + RUN], rows[r : r + RUN], norms[r : r + RUN])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.floor)], ["id", "v", "floor"])

    asked = stored(queries.select("id", "v").mapInArrow(begun, "id long, v array<double>, floor double"), "queries")
    path, most = asked.stored_at, max(RUN, CHUNK_BYTES // (8 * d))

    def run(batches):
        import pyarrow as pa

        def found(held):
            axes = sent.value[0]
            ids, rows, norms = (np.concatenate(c) for c in zip(*held))
            for q in _query_blocks(path):
                own = TopK(q.column(0).to_numpy(), _matrix(q.column(1), d), axes, k, q.column(2).to_numpy(zero_copy_only=False))
                for s in range(0, len(ids), RUN):
                    own.feed(ids[s : s + RUN], rows[s : s + RUN], norms[s : s + RUN])
                out = [(int(i), y, -x) for i, best in zip(own.ids, own.best) for x, y in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])

        held, size = [], 0
        for b in batches:
            for s in range(0, b.num_rows, most):
                part = b.slice(s, most)
                held.append((part.column(0).to_numpy(), _matrix(part.column(1), d), part.column(2).to_numpy()))
                size += part.num_rows
                if size >= most:
                    yield from found(held)
                    held, size = [], 0
        if held:
            yield from found(held)

    every = vectors.select("id", "v", "norm").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 256)
    return top_k(vectors, vectors.where("id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
