"""Best-two-fit packing of token pieces into sequences of a fixed length.

A document becomes its token ids and an end id; only what is longer than a sequence is cut.  Pieces are dealt to
shards of a bounded number by a hash; each shard is packed by itself, so no task's memory grows with the table
and each shard leaves at most a bin or two part-filled.  Within a shard bins are filled greedily with the
longest piece that fits; then the bin's smallest piece is exchanged for two unpacked pieces that fit the
widened gap more tightly, as long as such two exist.

A null text is empty and has its end id alone; null ids are kept as they are, and ids of any size and type come back unchanged;
repeated rows are counted, numbered and dealt out each, so no shard holds more of them than others; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe_words import WordIds
from tessera.llm.common import bounded_batches, stored

#: Pieces that one task packs together.
SHARD_PIECES = 4096
_LOADED: dict[str, WordIds] = {}


def ids_for(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def cut_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece.  A null text is empty and has its end id alone."""
    bounded_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        words, end = ids_for(path), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for k, s in enumerate(b.column(1)):
                raw = memoryview(words.ids([s.as_py() or ""])[0] + end)
                for p, at in enumerate(range(0, len(raw), capacity * 4)):
                    part = raw[at : at + capacity * 4]
                    rows.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class _Pool:
    """Unpacked pieces by length."""

    def __init__(self, lengths: list[int]):
        self.by: dict[int, list[int]] = {}
        for i, n in enumerate(lengths):
            self.by.setdefault(n, []).append(i)
        for rows in self.by.values():
            rows.reverse()
        self.sizes = sorted(self.by)

    def longest(self, room: int) -> int | None:
        k = bisect.bisect_right(self.sizes, room)
        return self.sizes[k - 1] if k else None

    def take(self, size: int) -> int:
        rows = self.by[size]
        row = rows.pop()
        if not rows:
            del self.by[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return row

    def give(self, size: int, row: int) -> None:
        if size not in self.by:
            self.by[size] = []
            bisect.insort(self.sizes, size)
        self.by[size].append(row)

    def two(self, over: int, most: int) -> tuple[int, int] | None:
        """Two sizes with over < sum <= most, the sum as large as can be."""
        import numpy as np

        s = np.array(self.sizes, dtype=np.int64)
        a = s[: int(np.searchsorted(s, most // 2, "right"))]
        if not len(a):
            return None
        at = np.searchsorted(s, most - a, "right") - 1
        b = s[np.maximum(at, 0)]
        for size in a[(b == a) & (at >= 0)].tolist():  # a size stands twice only if two pieces have it
            if len(self.by[size]) < 2:
                k = int(np.searchsorted(a, size))
                at[k] -= 1
        b = s[np.maximum(at, 0)]
        total = np.where((at >= 0) & (b >= a), a + b, -1)
        k = int(np.argmax(total))
        return (int(a[k]), int(b[k])) if total[k] > over else None


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in lengths; every length is at most the capacity."""
    pool, bins = _Pool(lengths), []
    while pool.sizes:
        room, own = capacity, []
        while (size := pool.longest(room)) is not None:
            own.append((size, pool.take(size)))
            room -= size
        while room and pool.sizes:
            least = min(range(len(own)), key=lambda k: own[k][0])
            pair = pool.two(own[least][0], own[least][0] + room)
            if pair is None:
                break
            size, row = own.pop(least)
            for x in pair:
                own.append((x, pool.take(x)))
            pool.give(size, row)
            room += size - sum(pair)
        bins.append([row for _, row in own])
    return bins


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = 4096, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset.  Ties go by the hash that deals rows, so reruns agree; repeated rows are packed each."""
    from pyspark.sql.types import IntegerType, LongType, StructType

    shards = max(1, -(-pieces.count() // shard_pieces))
    fields = pieces.schema
    schema = StructType(fields.fields).add("sequence_id", LongType()).add("offset", LongType())

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by([("deal_", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("length", "ascending")])
        lengths = table.column("length").to_pylist()
        seq, off = [0] * len(lengths), [0] * len(lengths)
        for k, rows in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for r in rows:
                seq[r], off[r] = (key[0].as_py() << 32) + k, at
                at += lengths[r]
        return table.select(fields.names).append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(off, pa.int64()))

    # copies of a row are counted and numbered, so that they are dealt to different shards
    counted = pieces.groupBy(*fields.names).agg(F.count("*").alias("copies_"))
    every = counted.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), "copies_"))).withColumn("deal_", F.xxhash64(*fields.names, "copy_"))
    dealt = every.select(*fields.names, "deal_", F.pmod("deal_", F.lit(shards)).cast(IntegerType()).alias("shard_"))
    return dealt.groupBy("shard_").applyInArrow(run, schema)


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(stored(cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
