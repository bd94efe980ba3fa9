"""Two tokenizations of the same texts, cut where both have a token's end, and counts of the id pairs that overlap.

The tokens of many documents stand one after the other on one axis of bytes.  The ends of A's and of B's tokens are counted there once;
places where both occur cut the axis into groups, places where either occurs are the links (an A token and a B token that
share bytes do so in one stretch), and prefix sums taken at the documents' ends give each document its own counts.

``align`` tokenizes and cuts, and keeps the ids, two bytes each; ``pair_counts`` says of each linked pair in how many documents it
stands; ``linked_counts`` gives each document the sums over its links.  There the pairs that most documents hold, HOT at most, go
to every task, and the others are joined by pair.  Null and empty texts, and texts whose tokens of either kind do not spell a space and
the text, have no tokens.  Null ids are kept, repeated rows stay repeated and count as documents of their own, an empty table
gives an empty result, other columns do not matter.  A text is tokenized in one task, which takes some 100 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe_words import BYTE_SPLIT, ENTRY_BYTES, KEPT_BYTES, LONG, OTHER, byte_alphabet, library
from tessera.llm.common import bounded_batches, stored

#: Pairs that every task gets, at most: 17 MB.
HOT = 1 << 20
#: Bytes of texts on one axis, and distinct pairs that a task holds before it hands them on.
AXIS, HELD_PAIRS = 1 << 20, 1 << 21
#: Words of piece vocabularies: no piece goes beyond a run of spaces and what follows, and none holds a line's end.
PIECE_SPLIT = re.compile(r"\n| *[^ \n]+| +")
_LOADED: dict[tuple, object] = {}


class _Words:
    """Ids of texts through a cache of words' ids that starts anew beyond KEPT_BYTES."""

    def __init__(self):
        self.cache, self.held = {}, 0

    def all(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit bytes; words new to the cache are encoded all at once."""
        split = [self.words(t) for t in texts]
        if self.held > KEPT_BYTES:
            self.cache.clear()
            self.held = 0
        new = set()
        for words in split:
            if words is not None:
                new.update(words)
        new = list(new.difference(self.cache))
        ids = self.learn(new) if new else []
        self.cache.update(zip(new, ids))
        self.held += len(new) * ENTRY_BYTES + sum(map(len, new)) + sum(map(len, ids))
        get = self.cache.__getitem__
        out = [self.whole(t) if words is None else b"".join(map(get, words)) for t, words in zip(texts, split)]
        for w in new:
            if len(w) > LONG:
                del self.cache[w]
        return out


class ByteTokens(_Words):
    """Ids of a byte-level vocabulary for a space and a text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__()
        self.lib = library(path)
        self.lib.encode_special_tokens = True
        back, vocab = byte_alphabet(), self.lib.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

        # ranks are ids where the vocabulary lists its merges in the order of their ids
        import json

        import tiktoken

        merges = [m if isinstance(m, list) else m.split(" ") for m in json.loads(self.lib.to_str())["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        self.ranked = None
        if made == list(range(256, 256 + len(made))):
            ranks = {self.bytes[k]: k for k in range(256 + len(made))}
            self.ranked = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})

    def learn(self, words: list[str]) -> list[bytes]:
        if self.ranked is None:
            return [array("I", e.ids).tobytes() for e in self.lib.encode_batch(words, add_special_tokens=False)]
        return [array("I", self.ranked._encode_single_piece(w.encode())).tobytes() for w in words]

    def words(self, text: str) -> list[str] | None:
        if not text:
            return []
        return None if OTHER.search(text) else BYTE_SPLIT.findall(" " + text)

    def whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(" " + text, add_special_tokens=False).ids).tobytes()


class PieceTokens(_Words):
    """Ids of a piece vocabulary, which itself puts a space before a text; no ids for a text that holds its sign for a space."""

    SPACE = "▁"

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        pieces = [self.lib.id_to_piece(k) for k in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(k) else p.replace(self.SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.lead = self.lib.encode("\n")
        own = [p for k, p in enumerate(pieces) if not (self.lib.is_byte(k) or self.lib.is_control(k) or self.lib.is_unknown(k))]
        inside = re.compile(f"[^{self.SPACE}]{self.SPACE}")
        self.parts = len(self.lead) == 2 and self.bytes[self.lead[1]] == b"\n" and not any(inside.search(p) or "\n" in p for p in own)

    def learn(self, words: list[str]) -> list[bytes]:
        """All words as lines of one text: no merge goes beyond a line's end."""
        lines = [w for w in words if w != "\n"]
        ids = np.array(self.lib.encode("\n" + "\n".join(lines)), dtype="<u4")
        cuts = (4 * np.append(np.flatnonzero(ids == self.lead[1]), len(ids))).tolist()
        raw, known = ids.tobytes(), {"\n": np.array(self.lead[1:], dtype="<u4").tobytes()}
        known.update(zip(lines, [raw[a + 4 : b] for a, b in zip(cuts, cuts[1:])]))
        return [known[w] for w in words]

    def words(self, text: str) -> list[str] | None:
        if not text or self.SPACE in text:
            return []
        return PIECE_SPLIT.findall(" " + text) if self.parts else None

    def whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text)).tobytes()


class Pair:
    """Both tokenizers, and tables over their ids."""

    def __init__(self, path_a: str, path_b: str):
        import pyarrow as pa

        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.lens = [np.array([len(t) for t in x.bytes], dtype=np.int64) for x in (self.a, self.b)]
        self.tokens = [pa.array(x.bytes, pa.binary()) for x in (self.a, self.b)]
        self.width = np.dtype("<u2" if max(map(len, self.lens)) <= 1 << 16 else "<u4")
        #: Each id in decimal as it stands inside a group and as it ends its part: A's first, then B's.
        self.names = pa.array([f"{k}{c}" for ends, n in ((",|", len(self.lens[0])), (",;", len(self.lens[1]))) for k in range(n) for c in ends])

    @staticmethod
    def of(path_a: str, path_b: str) -> Pair:
        if (path_a, path_b) not in _LOADED:
            _LOADED[path_a, path_b] = Pair(path_a, path_b)
        return _LOADED[path_a, path_b]

    def spelled(self, kind: int, ids: np.ndarray) -> memoryview:
        """The bytes of all tokens."""
        import pyarrow as pa

        return memoryview(self.tokens[kind].take(pa.array(ids, pa.int32())).buffers()[2] or b"").cast("B")

    def tokenized(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For A and for B: ids of all texts, and how many each text has, none where either does not spell a space and the text."""
        raw = [x.all(texts) for x in (self.a, self.b)]
        ids = [np.frombuffer(b"".join(r), dtype="<u4") for r in raw]
        counts = [np.array([len(x) // 4 for x in r], dtype=np.int64) for r in raw]
        good = np.array([bool(t) for t in texts], dtype=bool)
        for kind in (0, 1):
            spelled = self.spelled(kind, ids[kind])
            ends = np.concatenate(([0], np.cumsum(self.lens[kind][ids[kind]])))[np.concatenate(([0], np.cumsum(counts[kind])))].tolist()
            for k, t in enumerate(texts):
                good[k] = good[k] and spelled[ends[k] : ends[k + 1]] == b" " + t.encode()
        return [x[np.repeat(good, c)] for x, c in zip(ids, counts)], [np.where(good, c, 0) for c in counts]

    def axis(self, ids: list[np.ndarray], counts: list[np.ndarray]):
        """(A's ends, B's ends, cuts, links' ends, documents' ends) as byte offsets on the axis of all documents."""
        ends = [np.cumsum(n[x]) for n, x in zip(self.lens, ids)]
        size = int(ends[0][-1]) + 1 if len(ids[0]) else 1
        at_a, at_b = (np.bincount(e, minlength=size) for e in ends)
        last = np.concatenate(([0], ends[0]))[np.cumsum(counts[0])]
        return *ends, np.flatnonzero(at_a & at_b), np.flatnonzero(at_a | at_b), last

    def links(self, ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(document, pair) of each link; a pair is A's id times B's vocabulary plus B's id."""
        end_a, end_b, _, link, last = self.axis(ids, counts)
        pair = ids[0][np.searchsorted(end_a, link)].astype(np.int64) * len(self.lens[1]) + ids[1][np.searchsorted(end_b, link)]
        return np.searchsorted(last, link), pair

    def written(self, ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """For each document its groups as ``a1,a2|b1;a3|b2,b3``, how many groups and how many links it has."""
        import pyarrow as pa

        end_a, end_b, cut, link, last = self.axis(ids, counts)
        place, name = [], []
        for kind, (own, other) in enumerate(((end_a, end_b), (end_b, end_a))):
            group = np.searchsorted(cut, own)
            before = np.searchsorted(other, cut, "right")  # the other's tokens up to each cut
            place.append(np.arange(len(own)) + (np.concatenate(([0], before[:-1]))[group] if kind == 0 else before[group]) if len(own) else group)
            ends = np.append(group[1:] != group[:-1], True)[: len(own)]
            name.append(2 * (ids[kind].astype(np.int64) + kind * len(self.lens[0])) + ends)
        row = np.empty(len(end_a) + len(end_b), dtype=np.int64)
        for p, x in zip(place, name):
            row[p] = x
        text = self.names.take(pa.array(row))
        spelled, size = memoryview(text.buffers()[2] or b""), np.frombuffer(text.buffers()[1], dtype=np.int32)[: len(row) + 1] if len(row) else np.zeros(1, dtype=np.int32)
        to = size[np.concatenate(([0], np.cumsum(counts[0] + counts[1])))].tolist()
        whole = [bytes(spelled[x : max(x, y - 1)]) for x, y in zip(to, to[1:])]
        within = lambda x: np.diff(np.searchsorted(x, last, "right"), prepend=0)
        return whole, within(cut), within(link)


def _axes(sizes: list[int]):
    """Runs of rows of about AXIS bytes."""
    at = 0
    while at < len(sizes):
        end, held = at + 1, sizes[at]
        while end < len(sizes) and held + sizes[end] <= AXIS:
            held += sizes[end]
            end += 1
        yield at, end
        at = end


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256 (empty without tokens), and a and b: the ids, two bytes each (four for larger
    vocabularies).  With groups also the groups themselves as a string."""
    bounded_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        both = Pair.of(path_a, path_b)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            for at, end in _axes([len(t) for t in texts]):
                ids, counts = both.tokenized(texts[at:end])
                whole, n_groups, n_links = both.written(ids, counts)
                columns = [batch.column(0).slice(at, end - at), pa.array(counts[0]), pa.array(counts[1]), pa.array(n_groups, pa.int64()), pa.array(n_links, pa.int64())]
                columns.append(pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in whole]))
                for x, c in zip(ids, counts):
                    to = np.concatenate(([0], np.cumsum(c))).tolist()
                    x = x.astype(both.width)
                    columns.append(pa.array([x[p:q].tobytes() for p, q in zip(to, to[1:])], pa.binary()))
                if groups:
                    columns.append(pa.array([x.decode() for x in whole]))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", *["groups"] * groups]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary" + ", groups string" * groups
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _read(both: Pair, batch, at: int, end: int):
    """Ids and counts of some rows of a batch whose first columns are a and b."""
    ids, counts = [], []
    for k in (0, 1):
        raw = [x.as_py() for x in batch.column(k).slice(at, end - at)]
        ids.append(np.frombuffer(b"".join(raw), dtype=both.width))
        counts.append(np.array([len(x) // both.width.itemsize for x in raw], dtype=np.int64))
    return ids, counts


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    return pair, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair, docs (in how many rows it is linked), best (whether no pair of its A id is in more)."""
    import sentencepiece

    vocab = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()

    def run(batches):
        import pyarrow as pa

        both, held = Pair.of(path_a, path_b), []
        given = lambda p, n: pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], ["pair", "docs"])
        for batch in batches:
            for at, end in _axes([len(x.as_py()) for x in batch.column(0)]):
                doc, pair = both.links(*_read(both, batch, at, end))
                once = np.unique(doc.astype(np.int64) << 32 | pair) & 0xFFFFFFFF
                held.append(np.unique(once, return_counts=True))
                if sum(len(p) for p, _ in held) > HELD_PAIRS:
                    held = [_summed(held)]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield given(*held.pop())
        if held:
            yield given(*_summed(held))

    counts = aligned.select("a", "b").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    # an A id has at most B's vocabulary of pairs
    highest = F.max("docs").over(Window.partitionBy(F.expr(f"pair DIV {vocab}")))
    return counts.withColumn("best", F.col("docs") == highest)


def hot_pairs(counts: DataFrame, most: int) -> int:
    """The least power of two of documents such that at most so many pairs are in that many."""
    rows = counts.groupBy(F.floor(F.log2("docs")).alias("k")).count().collect()  # 64 rows at most
    held, low = 0, max((r["k"] for r in rows), default=0) + 1
    for r in sorted(rows, key=lambda r: -r["k"]):
        held += r["count"]
        if held > most:
            break
        low = r["k"]
    return 1 << low


def linked_counts(aligned: DataFrame, counts: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", hot: int = HOT) -> DataFrame:
    """The rows of aligned with n_best and count_sum in place of the ids.  Both tables should be stored."""
    spark = aligned.sparkSession
    bounded_batches(spark)
    low = hot_pairs(counts, hot)
    known = counts.where(F.col("docs") >= low).orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast([known.column(k).to_numpy() for k in range(3)])
    names = [c for c in aligned.columns if c not in ("a", "b", "groups")]
    fields = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}

    def run(batches):
        import pyarrow as pa

        both, (pairs, docs, best) = Pair.of(path_a, path_b), sent.value
        rest = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            for at, end in _axes([len(x.as_py()) for x in batch.column(0)]):
                n = end - at
                doc, pair = both.links(*_read(both, batch, at, end))
                one, times = np.unique(doc.astype(np.int64) << 32 | pair, return_counts=True)
                doc, pair = one >> 32, one & 0xFFFFFFFF
                k = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
                here = pairs[k] == pair if len(pairs) else np.zeros(len(pair), dtype=bool)
                sums = lambda x: np.add.reduceat(np.append(x, 0), np.searchsorted(doc, np.arange(n)))[:n] * (np.bincount(doc, minlength=n)[:n] > 0)
                if len(pairs):
                    n_best, total = sums(np.where(here & best[k], times, 0)), sums(np.where(here, docs[k] * times, 0))
                else:
                    n_best = total = np.zeros(n, dtype=np.int64)
                other = ~here
                offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[other], minlength=n)[:n])))
                left = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(pair[other]), pa.array(times[other])], fields=list(rest.value_type)))
                yield pa.RecordBatch.from_arrays([*(batch.column(2 + c).slice(at, n) for c in range(len(names))), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), left], [*names, "hot_best", "hot_sum", "rest"])

    schema = ", ".join(f"`{c}` {fields[c]}" for c in names) + ", hot_best long, hot_sum long, rest array<struct<pair: long, n: long>>"
    seen = stored(aligned.select("a", "b", *names).mapInArrow(run, schema).withColumn("row_", F.monotonically_increasing_id()), "links")
    rare = seen.select("row_", F.explode("rest").alias("x")).select("row_", "x.pair", "x.n").join(counts.where(F.col("docs") < low), "pair")
    sums = rare.groupBy("row_").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("docs")).alias("more_sum"))
    either = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
    return seen.join(sums, "row_", "left").select(*names, either("hot_best", "more_best").alias("n_best"), either("hot_sum", "more_sum").alias("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = stored(align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *paths), "aligned")
    counts = stored(pair_counts(aligned, *paths), "pair-counts")
    return linked_counts(aligned, counts, *paths).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
