"""Periodic runs of words by the runs theorem, and texts with their repetitions collapsed.

Each block of documents is one string of word symbols, told apart by document, with a separator after each document.  A suffix order by
prefix doubling gives ranks; the next suffix that is smaller, under the order of symbols and under its reverse, ends the longest Lyndon
word at each place.  Every run has such a word as its root, so the roots that follow on themselves are the candidates; each is
extended to the right by the longest common extension (a range minimum over the LCP array, from a sparse table) and to the left by
bisection on the same extension, as the places from which it reaches one end are neighbours.

Blocks hold whole documents, of about 256 KB together; a longer document is a block of its own, in one task, and takes about 100 bytes
a word there.  Nothing is shuffled.  A null text is empty: no words, no runs.  Null ids are kept, repeated rows stay repeated,
an empty table gives an empty result and other columns do not matter.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import word_arrays
from tessera.llm.common import bounded_batches

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Rounds of pointer jumping before a search in a pyramid of minima finds what is left.
JUMPS = 8
#: Bytes of a sparse table that is kept between queries; a larger one is made anew, a level at a time.
KEPT_TABLE = 64 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _heads(new: np.ndarray) -> np.ndarray:
    """For each place the nearest place at or before it where new holds."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _changes(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], x[1:] != x[:-1]))


def doubled(first: np.ndarray, keep: bool) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... symbols of each suffix, until all differ; equal prefixes have equal ranks.

    first: for each place how many places have smaller symbols.  Separators are unique, so a suffix that still shares its rank does not
    reach one.  Only such suffixes are sorted again.  With keep false the last ranks alone are returned.
    """
    n, rank, levels, k = len(first), first, [first], 1
    shared = np.bincount(rank, minlength=n)[rank] > 1
    active = np.flatnonzero(shared)
    while len(active):
        key = rank[active] * n + rank[active + k]
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        group = key // n
        sub = _changes(key)
        rank = rank.copy() if keep else rank
        rank[active] = group + _heads(sub) - _heads(_changes(group))
        alone = sub & np.concatenate((sub[1:], [True]))
        active, k = active[~alone], 2 * k
        levels = [*levels, rank] if keep else [rank]
    return levels


def next_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the next with a smaller value; distinct values, the last place is the smallest of all and gives itself."""
    n = len(v)
    at = np.minimum(np.arange(1, n + 1), n - 1)
    active = np.flatnonzero(v[at] > v)
    for _ in range(JUMPS):
        if not len(active):
            return at
        at[active] = at[at[active]]  # all up to there are larger than what stands before
        active = active[v[at[active]] > v[active]]
    if not len(active):
        return at
    # mins[k][x] is the least of the 2**k values from x * 2**k on
    mins, top = [v], np.iinfo(v.dtype).max
    while len(mins[-1]) > 1:
        m = mins[-1] if len(mins[-1]) % 2 == 0 else np.append(mins[-1], top)
        mins.append(np.minimum(m[0::2], m[1::2]))
    want, x = v[active], at[active] + 1
    found = np.full(len(active), -1)
    for k, m in enumerate(mins):
        last = k == len(mins) - 1
        look = np.flatnonzero((found < 0) & ((x % 2 == 1) | last))
        hit = look[m[x[look]] < want[look]]
        found[hit] = k
        x = np.where(found >= 0, x, (x + 1) >> 1)
    for k in range(len(mins) - 2, -1, -1):
        down = np.flatnonzero(found > k)
        left = 2 * x[down]
        x[down] = left + (mins[k][left] >= want[down])
    at[active] = x
    return at


class RangeMin:
    """min(values[lo..hi]) for many ranges at once: a sparse table, kept if it is small, else made anew a level at a time."""

    def __init__(self, values: np.ndarray):
        self.values, self.table = values, None
        if values.nbytes * max(1, len(values)).bit_length() <= KEPT_TABLE:
            self.table = list(self._levels())

    def _levels(self):
        t, k = self.values, 1
        while len(t):
            yield t
            t, k = np.minimum(t[:-k], t[k:]), 2 * k

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), dtype=self.values.dtype)
        level = np.frexp(hi - lo + 1)[1] - 1
        most = int(level.max(initial=-1))
        for k, t in enumerate(self.table if self.table is not None else self._levels()):
            if k > most:
                break
            q = np.flatnonzero(level == k)
            out[q] = np.minimum(t[lo[q]], t[hi[q] - (1 << k) + 1])
        return out


def runs_of(w: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(document, start, length, period) of every run, by document, start and period.  w: word hashes; document k's are w[at[k]:at[k+1]].

    times: 3 at least, as a root is looked for that follows on itself.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    docs, words = len(at) - 1, len(w)
    if not words:
        return np.empty((0, 4), dtype=np.int64)
    doc = np.repeat(np.arange(docs), np.diff(at))
    place = np.arange(words) + doc  # a separator follows each document
    n, seps = words + docs, at[1:] + np.arange(docs)
    symbol = word_arrays.mix(w + doc.astype(np.uint64) * _ODD)
    order = np.argsort(symbol, kind="stable")
    own = np.empty(words, dtype=np.int64)
    own[order] = _heads(_changes(symbol[order]))

    low, high = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    low[place], low[seps] = own + docs, np.arange(docs)[::-1]
    high[place], high[seps] = own, words + np.arange(docs)
    levels = doubled(low, True)
    rank = levels[-1]
    sa = np.empty(n, dtype=np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n, dtype=np.int32)
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b = sa[pair - 1], sa[pair]
    off = np.zeros(len(pair), dtype=np.int64)
    for k in range(len(levels) - 2, -1, -1):
        off += (levels[k][a + off] == levels[k][b + off]).astype(np.int64) << k
    lcp[pair] = off
    least_lcp = RangeMin(lcp)

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = rank[i], rank[j]
        return least_lcp(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)

    found = []
    begins = np.empty(n, dtype=np.int64)  # where each place's document begins
    begins[place], begins[seps] = (at[:-1] + np.arange(docs))[doc], seps
    for ranks in (rank, n - 1 - doubled(high, False)[-1]):
        p = next_smaller(ranks) - np.arange(n)
        p[seps] = 0
        i = np.flatnonzero(p > 0)
        i = i[p[i + p[i]] == p[i]]  # i + p is at most the document's separator, where p is 0
        q = p[i]
        reach = extension(i, i + q)
        keep = reach >= (times - 2) * q
        i, q, reach = i[keep], q[keep], reach[keep]
        before = i - q >= begins[i]
        k = np.flatnonzero(before)
        k = k[p[i[k] - q[k]] == q[k]]
        follows = np.zeros(len(i), dtype=bool)
        follows[k] = extension(i[k] - q[k], i[k]) >= q[k]  # an earlier root of the same run
        i, q, end = i[~follows], q[~follows], (i + q + reach)[~follows]
        lo, hi = np.maximum(begins[i], i - q + 1), i.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            good = mid + q[open_] + extension(mid, mid + q[open_]) == end[open_]
            hi[open_[good]] = mid[good]
            lo[open_[~good]] = mid[~good] + 1
        long = end - lo >= np.maximum(least, times * q)
        found.append(np.stack((lo[long], end[long] - lo[long], q[long]), axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    start, length, period = runs.T
    of = np.searchsorted(seps, start)
    return np.stack((of, start - begins[start], length, period), axis=1)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run (start, length, period) holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and the collapsed text of each row."""
    bounded_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def find(batches):
        import pyarrow as pa

        whole = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1)]
            counts, offsets, parts, out = [], [0], [], []
            for first, rows, w, at in word_arrays.blocks(texts):
                runs = runs_of(w, at, least, times)
                parts.append(runs)
                cut = np.searchsorted(runs[:, 0], np.arange(rows + 1))
                for k in range(rows):
                    own = runs[cut[k] : cut[k + 1], 1:]
                    counts.append(int(at[k + 1] - at[k]))
                    offsets.append(offsets[-1] + len(own))
                    out.append(collapsed(texts[first + k].split(), own))
            every = np.concatenate(parts) if parts else np.empty((0, 4), dtype=np.int64)
            spans = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in (1, 2, 3)], fields=list(whole.value_type))
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), found, pa.array(out, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(find, f"id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)


def with_repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text; where crc32 of the id ends in 0 the words from one place on are those of a first part again and again."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), h.alias("h"))
    g = F.expr("h DIV 10")
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    rest = n - a
    p = F.lit(1) + F.floor(rest / (3 + g % 8)).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    return rows.select(F.col("id").alias(id_col), F.when((F.col("h") % 10 == 0) & (n > 0), made).otherwise(F.col("text")).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the run with most periods (ties: smallest start, then period; nulls without runs) and SHA-256 digests.

    Exponents are compared as whole periods and the rest: correctly rounded quotients below one of numbers under 2**25 keep their order.
    """
    whole, part = lambda r: (r["length"] - r["length"] % r["period"]) / r["period"], lambda r: (r["length"] % r["period"]) / r["period"]
    order = lambda r: F.struct(whole(r).alias("whole"), part(r).alias("part"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    own = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), F.array_max(F.transform("runs", order)).alias("best"), F.array_join(F.transform("runs", line), "").alias("lines"), "collapsed")
    return own.select(
        id_col,
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) DIV (-best.period)").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(periodic_runs(with_repetitions(docs)))
