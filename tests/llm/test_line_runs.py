"""Line dedup against plain Python: levels, batches, shared and missing ids, very many lines."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import op11_line_runs as op

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 long, id long, row long, docs long, gone long, batch int, `lines` long"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, short=40, documents=5):
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= short:
                held[key(x)].add(i)
    often = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in often or often[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def made(seed=1, n=120):
    rng = random.Random(seed)
    common = [f"Line {k} that stands in many of the documents here, with É" + "!" * (k % 3) for k in range(30)]
    common += ["short line", "x" * 39, "y" * 40, "é" * 40, " " * 60, "ſharp İ " * 8]
    say = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 20)))
    edit = lambda x: rng.choice([x, x.upper() if x.isascii() else x, f"\t {x}\r", f"{x}\x0b\x0c", x + "\x1c"])
    rows = [(k * 3 - 50, "\n".join(edit(rng.choice(common)) if rng.random() < 0.6 else say() for _ in range(rng.randint(0, 12)))) for k in range(n)]
    rows += [(None, "\n".join(common)), (None, None), (None, "\n".join(common[:5] * 2)), (7, None), (7, ""), (7, "\n" + common[0]), (7, "\n" + common[0]), (2**62, "\n\n"), (-(2**63), common[1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "", "", 0, *range(7)) for i, t in made()], DOCS).repartition(3)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 2), (8, 3)])
def test_batches_and_levels(docs, batches, fanout):
    got = op.deduplicated(docs, batches=batches, fanout=fanout)
    assert sorted(map(tuple, got.collect()), key=str) == plain(made())


def test_runs_merge_by_levels_and_the_first_batch_keeps(spark, docs):
    lines = op.keyed_lines(docs).where("id is not null")
    runs = op.LineRuns(spark, 2)
    held, sizes = set(), []
    for k in range(7):
        batch = lines.where(F.pmod(F.xxhash64("id"), F.lit(7)) == k)
        own = {(r.h1, r.h2) for r in batch.collect()}
        rows = runs.add(batch).collect()
        assert {(r.h1, r.h2) for r in rows} == own and {(r.h1, r.h2) for r in rows if r.fresh} == own - held
        assert all((r.keeper is None) != r.fresh for r in rows)
        held |= own
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [2], [1, 1], [2, 1], [1, 0, 1], [2, 0, 1], [1, 1, 1]]
    every = {(r.h1, r.h2): r.docs for r in runs.frequent(1).collect()}
    want = {(r.h1, r.h2): r.k for r in lines.groupBy("h1", "h2").agg(F.countDistinct("id").alias("k")).collect()}
    assert every == want
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_compaction_and_anti_join_move_no_run(spark, docs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = op.LineRuns(spark, 4)
        for k in range(2):
            runs.add(op.keyed_lines(docs).where(f"pmod(id, 2) = {k}"))
        plan = op.LineRuns.merged(*runs.runs())._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        runs.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_very_long_text_and_empty_table(spark):
    line = "a line of the long text that is longer than forty letters {}"
    long = "\n".join(line.format(k % 60_000) for k in range(100_000))  # several megabytes
    rows = [(k, long if k == 3 else "\n".join(line.format(k + 7 * j) for j in range(2000))) for k in range(6)]
    df = spark.createDataFrame([(i, t) for i, t in rows] + [(9, long)], "doc_id long, text string")
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in op.deduplicated(df, documents=3).collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in plain([*rows, (9, long)], documents=3)]
    assert sorted(got) == sorted(want)
    assert op.deduplicated(df.limit(0)).count() == 0


def test_no_python_worker(spark, docs):
    plan = op.deduplicated(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapIn"))
