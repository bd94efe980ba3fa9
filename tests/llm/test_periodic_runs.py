"""Periodic runs against every period tried at every place, and the query's digests against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import op13_periodic_runs as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, runs int, id long, collapsed string, h long"


def plain(words, least=6, times=4):
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                out.setdefault((i, j + q - i), q)  # a multiple of the smallest period spans the same words
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None:
        words = rewritten(doc_id, words)
    runs = plain(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("jumps", [0, 8])
def test_runs_of_many_small_documents(monkeypatch, jumps):
    monkeypatch.setattr(op, "JUMPS", jumps)
    rng = random.Random(jumps)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 5)):
            d = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.6:
                d = d[: rng.randint(0, len(d))] + [rng.randrange(3) for _ in range(rng.randint(1, 5))] * rng.randint(2, 8) + d
            docs.append(d)
        w = np.array([x * 7919 + 5 for d in docs for x in d], dtype=np.uint64)
        got = op.runs_of(w, np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64))
        assert [tuple(x) for x in got.tolist()] == [(k, *r) for k, d in enumerate(docs) for r in plain(d)]


def test_range_minimum_with_and_without_a_kept_table(monkeypatch):
    v = np.random.default_rng(1).integers(0, 1000, 500).astype(np.int32)
    lo = np.random.default_rng(2).integers(0, 500, 300)
    hi = np.minimum(499, lo + np.random.default_rng(3).integers(0, 500, 300))
    want = [v[a : b + 1].min() for a, b in zip(lo, hi)]
    assert op.RangeMin(v)(lo, hi).tolist() == want
    monkeypatch.setattr(op, "KEPT_TABLE", 0)
    assert op.RangeMin(v)(lo, hi).tolist() == want


def test_query_against_plain_python(spark):
    rng = random.Random(4)
    say = lambda n, k=300: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    rows = [(k, rng.choice([say(rng.randint(0, 90)), say(60, 2), f"{say(9)} {'la la lo ' * rng.randint(2, 9)}{say(5)}", None, "", " \t\n", "x " * 40, "a\x0bb\x0ca\rb\ta b a b"])) for k in range(400)]
    rows += [(None, "x y " * 9), (None, None), (3, "again " * 7), (3, "again " * 7), (-7, "é ü " * 8), (2**62, say(50, 1))]
    df = spark.createDataFrame([(i, t, "en", None, 0, 1, 2, "c", 3) for i, t in rows], DOCS).repartition(3)
    got = [tuple(r) for r in op.digests(op.periodic_runs(op.with_repetitions(df))).collect()]
    assert sorted(got, key=str) == sorted((row(i, t) for i, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 100


def test_long_text_and_empty_table(spark):
    word = [f"word{k}" for k in range(50_000)]
    text = " ".join(word * 8 + ["end"] * 300_000)  # several megabytes
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = op.periodic_runs(df).first()
    assert [tuple(r) for r in got.runs] == [(0, 400_000, 50_000), (400_000, 300_000, 1)]
    assert got.collapsed == " ".join([*word, "end"]) and got.n_words == 700_000
    assert op.digests(op.periodic_runs(op.with_repetitions(df.limit(0)))).count() == 0
