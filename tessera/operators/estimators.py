"""Parameters of a hierarchical block network: leaf size n0, branching b, depth h, link probability p0 (halved at each level up)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The least gap of log eigenvalues that parts two levels, and where the inversion starts.
LEAST_GAP, START = 0.35, (45.0, 2.0, 0.35)


def moments(n0: float, b: float, p0: float, h: int) -> np.ndarray:
    """Mean and variance of the total degree, mean triangles of a node in the undirected skeleton.

    Around a node stand n0 - 1 others at level 0 and (b - 1) * b ** (k - 1) * n0 at level k.  Degrees are exact.  Triangles are
    counted as the results that these are compared with count them, so that estimates agree with those: pairs at different levels meet at the higher one and count twice from level 1 on, pairs at one level
    count where they meet at that level, pairs in one branch not at all.
    """
    k = np.arange(1, h + 1)
    shell = np.concatenate([[n0 - 1], n0 * b ** (k - 1) * (b - 1)])
    branch = np.concatenate([[1.0], n0 * b ** (k - 1)])
    p = p0 * 0.5 ** np.arange(h + 1)
    q = 2 * p - p * p
    same = 0.5 * shell * np.maximum(shell - branch, 0) * q**3
    lower = np.concatenate([[0.0], np.cumsum(shell * q)[:-1]])
    return np.array([2 * (shell * p).sum(), 2 * (shell * p * (1 - p)).sum(), same.sum() + (lower * shell * q * q).sum() + _upper_pairs(shell, q)])


def _upper_pairs(shell: np.ndarray, q: np.ndarray) -> float:
    """Pairs at different levels, both from 1 on."""
    lower = np.concatenate([[0.0, 0.0], np.cumsum((shell * q)[1:])[:-1]])[: len(shell)]
    return float((lower * shell * q * q).sum())


def inverted(n: int, observed: np.ndarray, deepest: int = 12) -> dict:
    """The parameters whose moments come nearest to the observed: for each depth a damped Gauss-Newton on logarithms, from START;
    a depth counts if leaf size and branching give it back."""
    best = (math.inf, None)
    goal = np.log(np.maximum(observed, 1e-9))
    for h in range(1, deepest + 1):
        x, damp = np.log(np.array(START)), 1e-2
        low, high = np.log([2.0, 1.05, 1e-4]), np.log([max(n, 3), max(n, 3), 1.0])

        def gap(x, h=h):
            with np.errstate(over="ignore"):
                return np.log(np.clip(moments(*np.exp(x), h), 1e-9, 1e30)) - goal

        g = gap(x)
        for _ in range(200):
            slope = np.stack([(gap(x + 1e-6 * d) - g) / 1e-6 for d in np.eye(3)], axis=1)
            new = np.clip(x - np.linalg.solve(slope.T @ slope + damp * np.eye(3), slope.T @ g), low, high)
            g2 = gap(new)
            if g2 @ g2 < g @ g:
                x, g, damp = new, g2, max(damp / 3, 1e-12)
            else:
                damp *= 4
            if g @ g < 1e-20 or damp > 1e12:
                break
        n0, b, p0 = np.exp(x)
        depth = round(math.log(max(n / n0, 1.0)) / math.log(b))
        if max(1, min(20, depth)) == h and g @ g < best[0]:
            best = (float(g @ g), {"n0": float(n0), "b": float(b), "h": h, "p0": float(p0), "blocks": None})
    return best[1] or {"n0": math.nan, "b": math.nan, "h": 0, "p0": math.nan, "blocks": None}


def degree_scale(b: float, h: int) -> float:
    """Mean degree over n0 * p0."""
    return 1 + (b - 1) / b * sum((b / 2) ** k for k in range(1, h + 1))


def from_spectrum(values: np.ndarray, n: int, m: int, method: str, depth: int = 2, base: float = 2.0) -> dict:
    """Parameters from the eigenvalues of A + A^T: those above the noise are blocks.

    ``depth``: the depth is given.  ``gaps``: it is the number of clear gaps of log eigenvalues, and one.  ``whole``: it is the depth
    at which the branching is nearest to a whole number, the deeper of equals.  ``base``: the branching is given.
    """
    values, degree = np.sort(values)[::-1], 2 * m / n
    wide = method in ("whole", "base")
    noise = 2 * math.sqrt(degree) if wide else 2 * math.sqrt(max(degree * (1 - degree / n), 0.0))
    blocks = max(2, int((values > noise).sum()))
    if method == "base":
        h = max(1, round(math.log(blocks) / math.log(base)))
        b, n0 = base, n / base**h
    else:
        n0, h = n / blocks, depth
        if method == "gaps":
            signal = values[1:blocks]
            signal = signal[signal > 0]
            h = 1 + int((np.abs(np.diff(np.log(signal))) > LEAST_GAP).sum())
        elif method == "whole":
            fits = [(abs(blocks ** (1 / k) - round(blocks ** (1 / k))), -k) for k in range(1, max(2, int(math.log2(n))) + 1) if blocks ** (1 / k) >= 1.05]
            h = -min((round(miss, 7), k) for miss, k in fits)[1]
        b = blocks ** (1 / h)
    if wide:
        p0 = degree / (n0 * degree_scale(b, h))
    else:
        weight = (n0 + sum(n0 * b ** (k - 1) * (b - 1) * 0.5**k for k in range(1, h + 1))) / n
        p0 = m / (n * (n - 1)) / weight
    return {"n0": n0, "b": float(b), "h": h, "p0": min(1.0, max(0.0, p0)), "blocks": blocks}


METHODS = ("moments", "depth", "gaps", "whole", "base")


def estimated(edges: DataFrame, sizes: DataFrame, depth: int = 2, base: float = 2.0) -> DataFrame:
    """One row a network and method: edges(graph_id, src, tgt), sizes(graph_id, n).  A network, as a dense matrix, is one task."""
    none = F.lit(None).cast("long")
    rows = sizes.select("graph_id", "n", none.alias("src"), none.alias("tgt")).unionByName(edges.select("graph_id", none.alias("n"), "src", "tgt"))

    def run(pdf):
        n = int(pdf["n"].max())
        if n < 10:
            raise ValueError("a network needs 10 nodes or more")
        e = pdf[pdf["src"].notna()]
        a = np.zeros((n, n))
        np.add.at(a, (e["src"].to_numpy(dtype=np.int64), e["tgt"].to_numpy(dtype=np.int64)), 1)
        a += a.T
        skeleton, degree = (a > 0).astype(float), a.sum(axis=1)
        triangles = np.einsum("ij,ji->i", skeleton @ skeleton, skeleton) / 2
        found = {"moments": inverted(n, np.array([degree.mean(), degree.var(ddof=1), triangles.mean()]))}
        values = np.linalg.eigvalsh(a)
        for method in METHODS[1:]:
            found[method] = from_spectrum(values, n, len(e), method, depth, base)
        return pd.DataFrame([{"graph_id": pdf["graph_id"].iloc[0], "method": k, **v} for k, v in found.items()])

    return rows.groupBy("graph_id").applyInPandas(run, "graph_id string, method string, n0 double, b double, h int, p0 double, blocks long")


# --- over tables -----------------------------------------------------------------------------------------------


def threshold(n: Column, m: Column) -> Column:
    """What an eigenvalue must pass to speak of a block: twice the root of d (1 - d / n), with d the mean degree."""
    d = m.cast("double") / n
    return 2 * F.sqrt(d * (1 - d / n))


def log_gaps(values: DataFrame, value: str = "v", key: str = "k") -> DataFrame:
    """k, gap: how far the logarithm of each value lies below that of the next larger one; null for the largest.  Values are a spectrum,
    so one task orders them."""
    gap = F.log(F.lag(value).over(Window.orderBy(F.desc(value)))) - F.log(F.col(value))
    return values.select(key, F.round(gap, 9).alias("gap"))


def branching_gap(blocks: Column, h: Column) -> Column:
    """How far the h-th root of a number of blocks is from a whole branching, times a hundred."""
    b = F.pow(blocks, 1.0 / h)
    return 100 * F.abs(b - F.round(b))


def levels_of(blocks: Column, base: float) -> Column:
    """Levels of so many blocks with a known branching, 1 at least."""
    return F.greatest(F.lit(1), F.round(F.log(blocks.cast("double")) / F.log(F.lit(base)))).cast("long")
