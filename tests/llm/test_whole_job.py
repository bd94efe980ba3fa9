"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np

from tessera.llm import op5_mixing, op6_top_k
from tessera.llm import pipeline as corpus_pipeline


def test_top_k_where_a_partition_holds_several_sorted_files(spark, monkeypatch):
    monkeypatch.setattr(op6_top_k, "RUN", 16)
    monkeypatch.setattr(op6_top_k, "HEAVIEST", 32)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2400, 8)) * rng.lognormal(0, 1, size=(2400, 1))
    df = spark.createDataFrame([(k, [float(np.float32(y)) for y in x]) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    own = op6_top_k.whole_vectors(df, "vec_id", "embedding", 256)
    whole = {r.id: np.array(r.v, dtype=np.int64) for r in own.collect()}
    # two files' rows in one partition, each longest first
    order = sorted(whole, key=lambda i: (i % 2, -float(whole[i] @ whole[i])))
    rows = [(i, whole[i].astype(float).tolist(), float(np.sqrt(whole[i] @ whole[i]))) for i in order]
    packed = spark.createDataFrame(rows, own.schema).coalesce(1)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op6_top_k.top_k(packed, packed.where("id % 50 = 0")).collect())
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, mark long, row_key string, first_row int"


def texts(n, words=80, seed=5):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(words)) for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "r", 2) for i, t, s in rows], COLUMNS)


def test_near_duplicates_drop_linked_texts_and_not_shared_ids(spark):
    t = texts(9)
    rows = [(None, t[0], "a"), (None, t[1], "a"), (None, t[2], "a"), (None, t[2] + " end", "a")]  # three without an id, one of them twice
    rows += [(7, t[3], "a"), (7, t[4], "a"), (7, t[4], "a")]  # two share an id, one of them repeated
    rows += [(1, t[5], "a"), (9, "a " + t[5], "a"), (9, t[6], "a")]  # of one id a near duplicate of a smaller id, and a clean one
    rows += [(None, t[7], "a"), (20, t[7] + " end", "a")]  # the one with an id stays
    rows += [(None, None, "a"), (None, "", "a"), (30, None, "a"), (30, " ", "a")]  # without words: linked with nothing
    docs = documents(spark, rows)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    either = [x for x in got if x in ((None, t[2]), (None, t[2] + " end"))]
    want = [(None, t[0]), (None, t[1]), *either, (7, t[3]), (7, t[4]), (1, t[5]), (9, t[6]), (20, t[7] + " end"), (None, None), (None, ""), (30, None), (30, " ")]
    assert len(either) == 1 and got == sorted(want, key=str)


def test_mixture_counts_copies_by_row_where_ids_are_null_or_shared(spark):
    t = texts(60, 200, 6)
    rows = [(None if k % 2 else 7, t[k], "abc"[k % 3]) for k in range(60)]
    unique = documents(spark, [(k, x, s) for k, (_, x, s) in enumerate(rows)])
    goal = {r.source: r.target / r.source_size for r in op5_mixing.mix(unique).join(unique.select("doc_id", "source"), "doc_id").select("source", "target", "source_size").distinct().collect()}
    out = corpus_pipeline.mixture(spark, documents(spark, rows), "").groupBy("source").count().collect()
    got = {r["source"]: r["count"] / 20 for r in out}
    assert all(abs(got.get(s, 0) - g) < 0.2 for s, g in goal.items())


def test_mixture_tells_a_null_source_from_a_null_text(spark):
    t = texts(12, 200, 7)
    rows = [(k, x, "b") for k, x in enumerate(t)]
    rows += [(100 + k, None, f"s {k}") for k in range(4)] + [(100 + k, f"s {k}", None) for k in range(4)]  # the same strings in another column
    rows += [(7, None, None), (7, "", "x"), (None, None, "x"), (None, "x", None)]
    out = corpus_pipeline.mixture(spark, documents(spark, rows), "").collect()
    assert out and all((r.text or "").split() for r in out)
    assert {r.text for r in out if r.source is None} == {"x", *(f"s {k}" for k in range(4))}


def test_top_k_keeps_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (7, [256.0, 1.0]), (7, [2.0, 1.0]), (8, [1.0, 1.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0])]
    own = op6_top_k.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 1)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op6_top_k.top_k(own, own.where("id % 50 = 0")).collect())
    assert got[:5] == [(0, 1, 7, 256), (0, 2, 7, 2), (0, 3, 8, 1), (0, 4, 50, 1), (0, 5, 50, 0)]
    assert got[5:] == [(50, 1, 7, 256), (50, 2, 7, 2), (50, 3, 0, 1), (50, 4, 7, 1), (50, 5, 7, 1)]  # both rows of the query together


def test_mixing_gives_small_sources_their_targets_beside_large_ones(spark, monkeypatch):
    monkeypatch.setattr(op5_mixing, "SLOTS", 256)
    monkeypatch.setattr(op5_mixing, "LEAST", 16, raising=False)
    sizes = {"a": [900] * 60, "b": [7, 11, 12], "c": [60, 40], "d": [1], "e": [33] * 300, "f": [5000]}
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate((s, n) for s, own in sizes.items() for n in own)]
    source = {k: s for k, _, s in rows}
    got = op5_mixing.mix(documents(spark, rows), weights=(1, 2, 3, 2, 1, 9)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    for s, own in sizes.items():
        mine = [r for r in got if source[r.doc_id] == s]
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5)
        once = mine[0].target // sum(own)  # words are taken in turn: all once before any twice
        assert all(once * r.size <= r.taken <= (once + 1) * r.size for r in mine)
    assert {s: sum(r.taken for r in got if source[r.doc_id] == s) for s in "bcd"} == {"b": 90, "c": 300, "d": 3}
