"""Removal of passages that an earlier document holds, by repeated-phrase automata.

A window is a run of ``window`` words of one text.  A word goes if a window over it also starts in a text with a smaller id.

1. Confirmed phrases.  Every window has one seed: the smallest hash among its SEED-word phrases.  Equal windows have equal seeds,
   so a seed met in one distinct text only can hold no repeat.  The phrases of seeds met in two or more are a table of the whole corpus.
2. Equal texts collapse: of each distinct word sequence only the row with the smallest id goes on (in the others every window is repeated).
3. Sharded automata.  Texts are dealt by ranges of ids.  Seeds, as a filter, route to each range the confirmed phrases that can
   occur there, wherever in the corpus they were confirmed; a task compiles those of a block of texts into an Aho-Corasick
   automaton and streams the block through it.  Every occurrence is found on the bytes themselves, and only windows around
   occurrences are candidates: no place comes from anywhere else.
4. A candidate's earliest text comes from an aggregate by two hashes (96 bits); candidates with an earlier text mark the words that go.

Hot phrases and windows are only ever aggregated with partial sums, or joined between two written tables, which Spark can split.
Null texts have no words; a row without an id comes before and after nothing: nothing goes from it or on account of it; repeated rows (same id
and text) get the same result each and never remove each other's words; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import IdShards, bounded_batches, discard, shuffle_width, stored, tidy
from tessera.llm.word_arrays import mix, rolled, spans, words_of

SEED = 8
_SEED_BASE, _WINDOW_BASE, _CHECK_BASE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3
#: Bytes of texts for which one automaton is compiled.
AUTOMATON_BYTES = 2 << 20


def single_spaced(raw: bytes) -> bytes:
    return b" ".join(raw.split())  # bytes.split() parts at the same separators


def text_key(plain: bytes) -> tuple[int, str]:
    """A key of a single-spaced word sequence, as a signed 64-bit number, and its digest."""
    sha = hashlib.sha256(plain)
    return int.from_bytes(sha.digest()[:8], "little", signed=True), sha.hexdigest()


def seeds_at(w: np.ndarray) -> np.ndarray:
    return mix(rolled(w, SEED, _SEED_BASE))


def window_seeds(w: np.ndarray, window: int) -> np.ndarray:
    """The seed of each window: a sliding minimum, by doubling."""
    m, span, run = seeds_at(w), window - SEED + 1, 1
    if len(m) < span:
        return m[:0]
    while run * 2 <= span:
        m = np.minimum(m[:-run], m[run:])
        run *= 2
    return np.minimum(m[: len(m) - (span - run)], m[span - run :])


def _profiles(rows: DataFrame, window: int) -> DataFrame:
    """id, n_words, key, sha of the whole text, and the distinct seeds of its windows with their phrases."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, key, sha, seeds, phrases = [], [], [], [], []
            for t in b.column(1).cast(pa.binary()):
                raw = t.as_py() or b""
                plain = single_spaced(raw)
                w = words_of(plain)
                k, digest = text_key(plain)
                n.append(len(w))
                key.append(k)
                sha.append(digest)
                own = np.unique(window_seeds(w, window))
                if len(own):
                    m = seeds_at(w)
                    places = np.flatnonzero(np.isin(m, own))
                    own, first = np.unique(m[places], return_index=True)
                    at, ends = spans(plain)
                    phrases += [plain[a:e] for a, e in zip(at[places[first]].tolist(), ends[places[first] + SEED - 1].tolist())]
                seeds.append(own.view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, seeds)]).astype(np.int32))
            flat = np.concatenate(seeds) if seeds else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(sha), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(ends, pa.array(phrases, pa.binary()))], ["id", "n_words", "key", "sha", "seeds", "phrases"])

    return rows.mapInArrow(run, "id long, n_words long, key long, sha string, seeds array<long>, phrases array<binary>")


def _windows(dealt: DataFrame, window: int) -> DataFrame:
    """Rows of windows (kind 0) and of the texts themselves (kind 1).  A shard's confirmed phrases come first, then its texts by id, the
    seeds of each before it."""

    def run(batches):
        import pyarrow as pa

        names = ["kind", "id", "key", "pos", "h1", "h2", "text"]

        def flush(block, phrases):
            wanted = dict.fromkeys(p for _, _, _, seeds in block for seed in seeds for p in phrases.get(seed, ()))
            if not wanted:
                return
            texts = [b" " + plain + b" " for _, _, plain, _ in block]
            kept = []
            for (id_, key, plain, _), text, ends in zip(block, texts, _occurrences(wanted, texts)):
                w = words_of(plain)
                n = len(w) - window + 1
                if n <= 0 or not len(ends):
                    continue
                last = np.searchsorted(spans(text)[1], ends)  # the word that ends where an occurrence does
                first = last - SEED + 1
                mark = np.zeros(n + 1, dtype=np.int64)
                np.add.at(mark, np.clip(first - (window - SEED), 0, n), 1)
                np.add.at(mark, np.clip(first + 1, 0, n), -1)
                pos = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                h1 = mix(rolled(w, window, _WINDOW_BASE)[pos]).view(np.int64)
                h2 = (mix(rolled(w, window, _CHECK_BASE)[pos]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                k = len(pos)
                kept.append((id_, key, plain))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(np.full(k, id_, np.int64)), pa.array(np.full(k, key, np.int64)), pa.array(pos.astype(np.int32)), pa.array(h1), pa.array(h2), pa.nulls(k, pa.string())], names)
            k = len(kept)
            yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array([p[0] for p in kept], pa.int64()), pa.array([p[1] for p in kept], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array([p[2].decode() for p in kept], pa.string())], names)

        block, size, at, known, seen, phrases = [], 0, (None, None), {}, set(), {}
        for b in batches:
            shards, seed, ids, keys, seeds = (b.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            phrase, texts = b.column(2), b.column(6).cast(pa.binary())
            for i, own in enumerate(zip(shards, ids)):
                if own[0] != at[0] or size >= AUTOMATON_BYTES:
                    yield from flush(block, phrases)
                    block, size = [], 0
                if own[0] != at[0]:
                    phrases = {}
                if own != at:
                    at, known, seen = own, {}, set()
                if seed[i] is not None:
                    phrases.setdefault(seed[i], []).append(phrase[i].as_py())
                elif keys[i] is not None:
                    known[keys[i]] = seeds[i]
                elif known:
                    plain = single_spaced(texts[i].as_py() or b"")
                    key = text_key(plain)[0]
                    if key in known and key not in seen:
                        seen.add(key)
                        block.append((own[1], key, plain, known[key]))
                        size += len(plain)
        yield from flush(block, phrases)

    return dealt.mapInArrow(run, "kind int, id long, key long, pos int, h1 long, h2 int, text string")


def _occurrences(phrases: dict[bytes, None], texts: list[bytes]) -> list[np.ndarray]:
    """For each text the place after the last word of every occurrence of a phrase between spaces, overlapping ones too."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word(f" {p.decode('latin-1')} ")
    automaton.make_automaton()
    return [np.unique(np.fromiter((end for end, _ in automaton.iter(t.decode("latin-1"))), dtype=np.int64)) for t in texts]


def _removed(marked: DataFrame, window: int) -> DataFrame:
    """id, key, n_removed, sha, spans from texts of single-spaced words and the places of their repeated windows."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, sha, out = [], [], []
            for t, places in zip(b.column(2).cast(pa.binary()), b.column(3)):
                words = (t.as_py() or b"").split(b" ")
                mark = np.zeros(len(words) + 1, dtype=np.int64)
                p = np.array(places.as_py(), dtype=np.int64)
                np.add.at(mark, p, 1)
                np.add.at(mark, p + window, -1)
                gone = np.cumsum(mark[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                n.append(int(gone.sum()))
                out.append(edges.reshape(-1, 2).tolist())
                sha.append(hashlib.sha256(b" ".join([x for x, g in zip(words, gone.tolist()) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha), pa.array(out, pa.list_(pa.list_(pa.int64())))], ["id", "key", "n_removed", "sha", "spans"])

    return marked.mapInArrow(run, "id long, key long, n_removed long, sha string, spans array<array<long>>")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, shard_bytes: int = 64 << 20) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, spans: the runs of words [start, end) that go, for each row."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    profiles = stored(_profiles(rows, window), "profiles")
    firsts = profiles.where(f"n_words >= {window} and id is not null").groupBy("key", "n_words").agg(F.min("id").alias("id")).select("id", "key")

    # phrases whose seed two distinct texts have, in all of the corpus; then those that each range of ids can hold
    seeds = profiles.where("id is not null").select(F.explode(F.arrays_zip("seeds", "phrases")).alias("s"), "key", "id").select("s.seeds", "s.phrases", "key", "id").toDF("seed", "phrase", "key", "id")
    recurring = seeds.groupBy("seed").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("seed")
    met = stored(seeds.join(recurring, "seed"), "met")
    tidy(spark)
    phrases = met.select("seed", "phrase").distinct()
    size = F.octet_length("text") + 64
    total = rows.agg(F.sum(size)).first()[0] or 0
    shards = IdShards(rows, "id", size, max(shuffle_width(spark), -(-total // shard_bytes)))
    routed = shards.assign(met).select("shard_", "seed").distinct().join(phrases, "seed")
    per_text = met.join(firsts, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.collect_set("seed").alias("seeds"))

    none = lambda kind: F.lit(None).cast(kind)
    both = per_text.select("id", "key", "seeds", none("string").alias("text")).unionByName(rows.where("id is not null").select("id", none("long").alias("key"), none("array<long>").alias("seeds"), "text"))
    both = shards.assign(both).select("shard_", none("long").alias("seed"), none("binary").alias("phrase"), "id", "key", "seeds", "text")
    both = both.unionByName(routed.select("shard_", "seed", "phrase", none("long").alias("id"), none("long").alias("key"), none("array<long>").alias("seeds"), none("string").alias("text")))
    dealt = both.repartitionById(shards.n, "shard_").sortWithinPartitions("shard_", F.asc_nulls_first("id"), F.asc_nulls_last("key"))
    found = stored(_windows(dealt, window), "windows")
    discard(met)

    windows = found.where("kind = 0").select("id", "key", "pos", "h1", "h2")
    earliest = stored(windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"), "earliest")
    tidy(spark)
    places = windows.join(earliest, ["h1", "h2"]).where("id > lo").groupBy("id", "key").agg(F.collect_list("pos").alias("places"))
    marked = found.where("kind = 1").select("id", "key", "text").join(places, ["id", "key"])
    cut = stored(_removed(marked, window).withColumnRenamed("sha", "cut_sha"), "cut")
    discard(found, earliest)

    out = profiles.select("id", "n_words", "key", "sha").join(firsts.withColumn("first", F.lit(True)), ["id", "key"], "left").join(cut, ["id", "key"], "left")
    copy = F.col("first").isNull() & (F.col("n_words") >= window) & F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))).otherwise(F.coalesce("spans", F.array().cast("array<array<long>>"))).alias("spans"),
    )


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
