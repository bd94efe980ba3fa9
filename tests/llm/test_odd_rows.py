"""Null, extreme, shared and repeated ids, structured words, very long tokens and runs: each has a defined result."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe_words, op1_warc, op2_fingerprints, op3_quality, op4_repeated_phrases, op5_mixing, op6_top_k, op7_pii, op8_packing, op9_token_counts, op10_jaccard_join
from tessera.llm.bpe_words import PrefixCounts, WordIds
from tessera.llm.common import IdShards, shared_dir
from tessera.llm.word_arrays import words_of

LOW, HIGH, BIG = -(2**63), 2**63 - 1, 2**60 + 1
IDS = [None, LOW, HIGH, BIG, 7, 7, None]


def say(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows whose ids are null, extreme and shared; the last two texts hold the first ones' passages."""
    rng = random.Random(8)
    texts = [say(rng, 120) for _ in IDS]
    texts[5] = texts[3]  # id 7 repeats the text of a larger id, so the larger id's is the copy
    texts[6] = texts[1]  # a row without an id repeats the smallest id's text
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(IDS, texts)], "doc_id long, text string, lang string, source string, n_chars long")


def ids(df, name="doc_id"):
    return Counter(r[name] for r in df.select(name).collect())


def test_every_operator_keeps_every_row_and_id(spark, odd):
    tokenizers = pytest.importorskip("public_tokenizers")
    want, labels = Counter(IDS), odd.select("doc_id", F.lit(1).alias("quality"))
    model = op3_quality.train(odd, labels)
    for out in (
        op2_fingerprints.edited_fingerprints(odd),
        op2_fingerprints.near_duplicates(odd),
        op3_quality.score(odd, model),
        op4_repeated_phrases.repeated_spans(odd),
        op5_mixing.mix(odd),
        op7_pii.find_pii(odd),
        op8_packing.pack(op8_packing.cut_pieces(odd, tokenizers.path("word_bpe_49k.json"))),
        op9_token_counts.token_counts(odd, tokenizers.path("byte_bpe_50k.json")),
        op10_jaccard_join.join(odd),
    ):
        assert ids(out) == want
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://a").alias("url"), F.concat("text", "text", "text").alias("html"))
    back = op1_warc.read(op1_warc.write(pages, shared_dir(spark, "warc-test")))
    assert ids(back, "id") == want
    kinds = {(r.id, r.record_type, r.refers_to) for r in back.collect()}
    assert (7, "revisit", BIG) in kinds and (BIG, "response", None) in kinds and (None, "revisit", LOW) in kinds
    held = {r.doc_id: r.h for r in odd.select("doc_id", op3_quality.held_out("doc_id").alias("h")).collect()}
    assert held[None] is False and None not in held.values()


def test_repeated_phrases_without_ids_remove_nothing(odd):
    gone = sorted(((r.doc_id, r.n_removed) for r in op4_repeated_phrases.repeated_spans(odd).collect()), key=str)
    assert gone == sorted([(None, 0), (None, 0), (LOW, 0), (HIGH, 0), (7, 0), (7, 0), (BIG, 120)], key=str)


def test_repeated_phrases_come_through_the_automaton(odd, monkeypatch):
    monkeypatch.setattr(op4_repeated_phrases, "_occurrences", lambda phrases, texts: [np.empty(0, dtype=np.int64) for _ in texts])
    rng = random.Random(9)
    passage = say(rng, 60)
    two = odd.limit(0).union(odd.sparkSession.createDataFrame([(1, f"{say(rng, 30)} {passage}", "", "", 0), (2, f"{passage} {say(rng, 30)}", "", "", 0)], odd.schema))
    assert op4_repeated_phrases.repeated_spans(two).agg(F.sum("n_removed")).first()[0] == 0
    monkeypatch.undo()
    assert {r.doc_id: r.n_removed for r in op4_repeated_phrases.repeated_spans(two).collect()} == {1: 0, 2: 60}


def test_links_of_rows_without_ids(odd):
    got = Counter((r.doc_id, r.component_id) for r in op10_jaccard_join.join(odd).collect())
    assert got == Counter([(None, None), (None, LOW), (LOW, LOW), (HIGH, HIGH), (7, 7), (7, 7), (BIG, 7)])


def test_top_k_without_ids(spark):
    rows = [(None, [9.0, 9.0]), (0, [1.0, 0.0]), (50, [0.5, 1.0]), (BIG, [3.0, 1.0]), (LOW, [0.0, 2.0])]
    own = op6_top_k.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 1)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op6_top_k.top_k(own, own.where("id in (0, 50)")).collect())
    assert got == [(0, 1, BIG, 3), (0, 2, LOW, 0), (0, 3, 50, 0), (50, 1, LOW, 2), (50, 2, BIG, 1), (50, 3, 0, 0)]


def test_top_k_in_small_chunks_and_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("CHUNK_BYTES", 64), ("RUN", 4), ("HEAVIEST", 2)):
        monkeypatch.setattr(op6_top_k, name, value)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, [float(np.float32(y)) for y in rng.normal(size=6)]) for k in range(90)], "vec_id long, embedding array<float>")
    own = op6_top_k.whole_vectors(df, "vec_id", "embedding", 256)
    whole = {r.id: np.array(r.v, dtype=np.int64) for r in own.collect()}
    want = []
    for q in range(0, 90, 5):
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op6_top_k.top_k(own, own.where("id % 5 = 0")).collect()) == want


def test_structured_words_do_not_collide(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    assert len(set(words_of(f"{one} {other}".encode()).tolist())) == 2
    rng = random.Random(3)
    shared = [say(rng, 49).split() for _ in range(2)]
    rows = [(1, " ".join([one, *shared[0]])), (2, " ".join([other, *shared[0]])), (3, one), (4, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in op10_jaccard_join.join(df.where("doc_id > 2")).collect())
    assert all(r.n_removed == 0 for r in op4_repeated_phrases.repeated_spans(df).collect())
    prints = {r.doc_id: r.fingerprint for r in op2_fingerprints.edited_fingerprints(df).collect()}
    assert prints[3] != prints[4]


def test_id_shards_stay_even_beside_outlying_ids(spark):
    df = spark.createDataFrame([(k,) for k in [*range(3000), LOW, HIGH, None]], "id long")
    s = IdShards(df, "id", F.lit(1), 6)
    sizes = Counter(r.shard_ for r in s.assign(df).collect())
    assert sum(sizes.values()) == 3003 and len(sizes) == s.n == 6 and max(sizes.values()) < 800
    edges = s.assign(df).where("id is not null").groupBy("shard_").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("shard_").collect()
    assert all(x.b < y.a for x, y in zip(edges, edges[1:]))


def test_quality_fits_one_text_an_id(spark, odd):
    rng = random.Random(2)
    many = spark.createDataFrame([(k % 4, say(rng, 20)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, quality int")
    fitted = []
    plain = op3_quality.fit
    op3_quality.fit = lambda x, y: fitted.append(len(x)) or plain(x, y)
    try:
        op3_quality.train(many, labels)
    finally:
        op3_quality.fit = plain
    assert fitted[0] <= 4


def test_warc_rolls_files_and_leaves_nothing_behind(spark):
    import gzip
    from pathlib import Path

    rng = random.Random(6)
    df = spark.createDataFrame([(k, f"http://a/{k}", say(rng, 300) if k % 5 else "same " * 300) for k in range(60)], "page_id long, url string, html string")
    out = shared_dir(spark, "warc-test")
    manifest = op1_warc.write(df, out, roll_bytes=4000).collect()
    assert max(r.part for r in manifest) >= 1 and sum(r.records for r in manifest) == 60
    top = Path(out.removeprefix("file://"))
    assert not (top / "_tmp").exists() and len(list(top.glob("*.warc.gz"))) == len(manifest)
    text = "".join(gzip.open(p, "rt", encoding="utf-8", newline="").read() for p in sorted(top.glob("*.warc.gz")))
    assert text.count("WARC-Type: warcinfo") == len(manifest)
    fields = [dict(x.split(": ", 1) for x in h.split("\r\n")[1:] if ": " in x) for h in text.split("WARC/1.1")[1:]]
    answer = next(f for f in fields if f["WARC-Type"] == "response" and f["X-Row-Id"] == "55")
    assert all(f["WARC-Refers-To"] == answer["WARC-Record-ID"] for f in fields if f["WARC-Type"] == "revisit")


def test_personal_data_in_a_long_run_needs_little_memory():
    field = op7_pii.trained()
    text = " ".join(str(1_000_000 + 7 * k) for k in range(20_000)) + " +1 (578) 555-6437"
    tracemalloc.start()
    _, every = op7_pii.spans_of(text, field)
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()
    assert ("phone", len(text) - 17, len(text)) in every
    assert op7_pii.spans_of("1" + "-" * 100_000 + "(" * 100_000, field)[0] == []


def test_packing_deals_out_copies_and_stays_near_the_least(spark):
    rng = random.Random(5)
    rows = [(None, 0, 0, 300, 1)] * 400 + [(BIG, 0, 0, 900, 2)] + [(k, 0, 0, rng.randint(1, 400), k) for k in range(2000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = op8_packing.pack(pieces, capacity=1000, shard_pieces=200).collect()
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in got) == Counter((r[0], r[3], r[4]) for r in rows)
    assert len({r.sequence_id >> 32 for r in got if r.doc_id is None}) > 8
    bins = len({r.sequence_id for r in got})
    assert bins <= 1.05 * sum(r[3] for r in rows) / 1000  # each shard may leave a part-filled bin
    again = op8_packing.pack(pieces.repartition(7), capacity=1000, shard_pieces=200).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_token_counts_never_encode_and_serve_all_alphabets():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    counts = PrefixCounts(path)
    lib, counts.lib = counts.lib, None  # nothing may be encoded
    rng = random.Random(1)
    parts = [" ", "  ", "\t", "\n", "'", "'re", "'l", "é", "’", "—", "日本", "😀", "<|endoftext|>", "<|", "a", "Word", "12", "½", "　", "\x1c", "\x85", "ﷺ", "<"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(150)]
    texts += ["日" * 400 + " ab", " " * 700 + "x", "'" * 500, "ab" * 400]
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for t in texts:
        table, sizes = counts.table(t), [size(t[:k]) for k in range(len(t) + 1)]
        assert [table.at(k) for k in range(len(t) + 1)] == sizes
        for budget in (0, 1, 5, 20):
            assert table.longest(budget) == max(k for k, s in enumerate(sizes) if s <= budget)


def test_word_caches_hold_what_their_bound_says_and_change_nothing(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe_words, "KEPT_BYTES", 20_000)
    rng = random.Random(3)
    texts = [say(rng, 90) + " " + "z" * rng.choice([0, 250, 5000]) for _ in range(60)] * 2
    words, counts = WordIds(tokenizers.path("word_bpe_49k.json")), PrefixCounts(tokenizers.path("byte_bpe_50k.json"))
    for t in texts:
        assert words.ids([t])[0] == words.whole(t)
        assert counts.table(t).total == len(counts.lib.encode(t, add_special_tokens=False).ids)
        for cache, held in ((words.cache, words.held), (counts.cache, counts.held)):
            assert all(len(w) <= bpe_words.LONG for w in cache)
            assert len(cache) * bpe_words.ENTRY_BYTES <= held <= 20_000 + 90 * 400 + 4 * 5000 + 5000
