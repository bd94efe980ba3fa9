"""The stages of the corpus pipeline, each on what its predecessor kept."""

import random

import pytest

from tessera.llm import pipeline as corpus_pipeline
from tessera.llm.common import stored


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for k in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 120))]
        text = " ".join(words)
        if k % 8 == 1:
            text = rows[-1][1] + " end"
        if k % 8 == 2:
            text = "SHOUT!! " * 70
        if k % 8 == 3:
            text += " +1 (578) 555-6437 4918187128635271"
        rows.append((k, text, "en", f"s{k % 4}", len(text), k, 0.5, "c"))
        labels.append((k, 0 if k % 8 == 2 else 1, 0))
    rows += [(200, None, None, None, None, 1, 0.1, "c"), (201, "", "en", None, 0, 1, 0.1, "c"), (3, rows[3][1], "en", "s3", 1, 1, 0.1, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept long, score double, copies string").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, folder), name)
        seen[name] = docs
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    good = [r.text for r in seen["quality"].collect() if r.text]
    assert not any(t.startswith("SHOUT") for t in good) and len(good) >= 69
    ids = [r.doc_id for r in seen["near_duplicates"].collect()]
    assert len(ids) == len(set(ids)) and not any(i % 8 == 1 for i in ids if i < 200) and all(i in ids for i in (0, 3, 8))
    texts = [r.text or "" for r in seen["personal_data"].collect()]
    assert not any("4918187128635271" in t or "555-6437" in t for t in texts) and any("[CARD]" in t for t in texts)
    mixed = {r.doc_id for r in seen["mixture"].collect()}
    assert mixed <= set(ids)
    assert seen["packing"].select("doc_id").distinct().count() == len(mixed)


def test_run_on_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_are_alike_in_four_fifths_of_five_word_shingles(spark):
    words = [f"w{k}" for k in range(104)]
    # one word changed inside takes five shingles, so 100 become 95 of 105 (0.90), 90 of 110 (0.82), 85 of 115 (0.74)
    texts = {0: words}
    for k, spots in ((1, (20,)), (2, (20, 60)), (3, (20, 50, 80))):
        texts[k] = [f"x{k}" if i in spots else w for i, w in enumerate(words)]
    rows = lambda ids: spark.createDataFrame([(i, " ".join(texts[i]), None, "s", 1) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda *ids: sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows(ids), "").collect())
    assert kept(0, 1) == [0] and kept(0, 2) == [0] and kept(0, 3) == [0, 3]
