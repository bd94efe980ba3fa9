"""A quality classifier by Bradley-Terry pairwise ranking.

Of two documents, one with label 1 and one with label 0, the first is preferred; the chance of that is a logistic function of
the difference of their scores, which are linear in features of the whole text.  The weights come from the logistic loss on
feature differences of preference pairs.  A threshold is put at the quantile of training scores that the share of label 0 names;
scores are shifted so that it stands at CUT.

Fitting takes at most TRAIN_ROWS labelled ids, those with the smallest crc32, and one text of each: where texts share an id, that
whose features come first; scoring takes every text whole.  Labels, ids, languages and sources are not features.  Null texts are
empty and are scored like any other; rows without an id are scored, are not held out and are never learned from; with one label only
every score is CUT; of an id's repeated labels the smallest counts; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches
from tessera.llm.word_arrays import spans, words_of

#: Labelled rows that are fitted, at most; preference pairs made of them; the score that separates the labels.
TRAIN_ROWS, PAIRS, CUT = 12_000, 60_000, 0.7
#: Pairs whose differences are held at a time.
PAIRS_AT_ONCE = 6_000
#: Bytes by class: how many of a text's bytes are of each.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t", b".", b",", b"!", b"?", b"|", b"*#$%&^~", b"<>{}[]", b"()/\\", b"-_=+", b"\"'`", b":;@", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0))]
_CLASS = np.full(256, len(_CLASSES), dtype=np.uint8)
for _k, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _k
#: Byte pairs that start upper-case Latin-1 letters in UTF-8 end in 0x80 to 0x9E after 0xC3.
_BASIC = len(_CLASSES) + 1 + 12


def basic_features(raw: bytes) -> np.ndarray:
    """Shares and means over one whole text."""
    x = np.zeros(_BASIC)
    if not raw:
        return x
    b = np.frombuffer(raw, dtype=np.uint8)
    shares = np.bincount(_CLASS[b], minlength=len(_CLASSES) + 1) / len(b)
    upper = shares[1] + np.count_nonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)) / len(b)
    s, e = spans(raw)
    n = len(s)
    x[: len(shares)] = shares
    if not n:
        return x
    w = words_of(raw)
    lengths = e - s
    _, counts = np.unique(w, return_counts=True)
    pairs = np.unique(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) if n > 1 else w
    lines = [t for t in raw.split(b"\n") if t]
    last = b[e - 1]
    x[len(shares) :] = [
        upper,
        np.log1p(n),
        lengths.mean() / 10,
        lengths.std() / 10,
        len(counts) / n,
        counts.max() / n,
        (w[1:] == w[:-1]).mean() if n > 1 else 0,
        len(pairs) / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)),
        (lengths <= 2).mean(),
        (_CLASS[last] > 2).mean(),
        ((lengths == 1) & (_CLASS[last] > 2)).mean(),
    ]
    return x


def features(raw: bytes) -> np.ndarray:
    """The basic features, their square roots (for shares near 0) and their squares."""
    x = basic_features(raw)
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x])


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 5) -> dict:
    """mean, scale, weights, shift of a Bradley-Terry model; Newton steps on the mean logistic loss with a ridge."""
    width = _BASIC * 3
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(width), np.ones(width))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(width)
    if not len(good) or not len(bad):
        return {"mean": mean, "scale": scale, "w": w, "at": 0.0}
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    for _ in range(12):
        grad, hess = ridge * w, ridge * np.eye(width)
        for at in range(0, pairs, PAIRS_AT_ONCE):
            d = z[better[at : at + PAIRS_AT_ONCE]] - z[worse[at : at + PAIRS_AT_ONCE]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            grad = grad + d.T @ (p - 1) / pairs
            hess += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    return {"mean": mean, "scale": scale, "w": w, "at": float(np.quantile(raw, len(bad) / len(y)))}


def scored(x: np.ndarray, model: dict) -> np.ndarray:
    raw = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] - model["at"]
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)) * (1 - CUT) / CUT)


def held_out(id_col: str):
    """Whether a row is kept out of training; false for rows without an id, which have no label either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    known = known.where(~held_out("id"))
    picked = known.orderBy(F.crc32(F.col("id").cast("string")), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("id", "text", "y")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = [features(t or b"").tolist() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    each = texts.mapInArrow(run, "id long, y int, x array<double>").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = each.toArrow().sort_by("id")  # the same order in every run
    return fit(got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, _BASIC * 3), got.column("y").to_numpy())


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns keep (all, if not given), and the score by that name."""
    bounded_batches(docs.sparkSession)
    keep = keep or docs.columns
    kept = docs.select(*keep, *([] if text_col in keep else [text_col]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).cast(pa.binary())
            out = [scored(np.stack([features(t.as_py() or b"") for t in texts.slice(s, 512)]), model) for s in range(0, b.num_rows, 512)]
            values = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(values, pa.float64())], [*keep, name])

    return kept.mapInArrow(run, f"{schema}, `{name}` double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
