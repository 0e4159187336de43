"""Quality rules: document statistics, a rule on lengths and repetition, and gradient-boosted trees.

Statistics are taken from whole texts. The trees are trained in numpy (logistic loss, histograms of quantile bins, depth-limited)
on labelled documents; chosen features are constrained so that more of them never raises a score: a split whose children go the
other way is refused, and the values below a split are held on their sides of its middle. The ensemble is flattened into node
arrays (feature, threshold, left, right, value), and all rows of a batch go down all trees together.

The training set is bounded: the `fit_rows` labelled documents with the least hash of their identifier.

Defined cases: a null or empty text has no words, so base_failed; a null doc_id stays null and is never learnt from; repeated rows
give repeated results; an empty table gives an empty result; without labels of both classes the verdict is base_failed's
opposite; null labels are left out; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_rows

FIT_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols_per_word", "dup_lines", "repeats", "distinct", "digits", "capitals", "marks", "longest", "line_words", "short_words")
MONOTONE = {"symbols_per_word": -1, "dup_lines": -1, "repeats": -1}
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(8)], np.uint64)


def repeated_words(words: list, window: int = 8) -> int:
    """Words in windows that are found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(window):
        rolled += h[i : i + n] * _MULTIPLIERS[i]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    seen, dups, full = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            full += 1
            dups += line in seen
            seen.add(line)
    counts = [n, len(text) - blanks, sum(map(text.count, "#*$%&|<>")), dups, repeated_words(words)]
    d = max(n, 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    marks = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
    return counts, [float(np.log1p(n)), counts[1] / d, counts[2] / d, dups / max(full, 1), counts[4] / d, len(set(words)) / d, raw[48:58].sum() / d, raw[65:91].sum() / d, marks / d, float(lengths.max(initial=0)), n / max(full, 1), float((lengths <= 3).sum()) / d]


@dataclass
class Trees:
    """Flat nodes of all trees; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of a matrix's rows."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, *, monotone: tuple[int, ...] | None = None, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: int = 10) -> Trees:
    """Boosted trees for 0/1 labels; monotone has -1, 0 or 1 for each feature."""
    n, k = x.shape
    monotone = monotone or (0,) * k
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b: cuts[b-1] < x <= cuts[b]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(n, np.log(p / (1 - p)))
    nodes: list[list[float]] = []
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        nodes.append([0, np.inf, at, at, 0.0])
        total_g, total_h, best = g[rows].sum(), h[rows].sum(), None
        if level < depth and len(rows) >= 2 * least:
            for j in range(k):
                m = len(cuts[j]) + 1
                if m < 2:
                    continue
                b = binned[rows, j]
                gl, hl, cl = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g[rows], h[rows], None))
                ok = (cl >= least) & (len(rows) - cl >= least)
                if not ok.any():
                    continue
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
                ok &= monotone[j] * (vr - vl) >= 0
                gain = np.where(ok, gain, -1)
                i = int(gain.argmax())
                if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                    best = (gain[i], j, i, vl[i], vr[i])
        if best is None:
            nodes[at][4] = rate * leaf(total_g, total_h, low, high)
            return at
        _, j, i, vl, vr = best
        middle, go = (vl + vr) / 2, binned[rows, j] <= i
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[j]]
        left, right = (grow(r, g, h, level + 1, *lim) for r, lim in zip((rows[go], rows[~go]), bounds, strict=True))
        nodes[at][:4] = [j, float(cuts[j][i]), left, right]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
        f, t, le, r, v = (np.array(c) for c in zip(*nodes, strict=True))
        at = np.full(n, roots[-1])
        for _ in range(depth):
            at = np.where(x[np.arange(n), f[at].astype(int)] <= t[at], le[at], r[at]).astype(int)
        score = score + v[at]
    if not nodes:
        nodes.append([0, np.inf, 0, 0, 0.0])
    f, t, le, r, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(f.astype(np.int64), t, le.astype(np.int64), r.astype(np.int64), v, np.array(roots, np.int64), depth, float(np.log(y.mean().clip(1e-3, 1 - 1e-3) / (1 - y.mean().clip(1e-3, 1 - 1e-3)))))


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", fit_rows: int = FIT_ROWS) -> Trees | None:
    """Trees from labelled documents, of which those with the fit_rows least hashes of their identifiers; None if there aren't two classes.

    An identifier counts once: with its least label, and of rows that share it with the least statistics.
    """
    chosen = labels.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{label_column}`").cast("int").alias("y")).filter("doc_id is not null").groupBy("doc_id").agg(F.min("y").alias("y")).filter("y is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = id_and_text(docs, id_column, text_column).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")  # at most fit_rows small rows

    def run(columns: list[list]) -> list[list]:
        return [columns[0], columns[1], [statistics(t)[1] for t in columns[2]]]

    found = map_rows(rows, run, "doc_id long, y int, x array<double>", [pa.int64(), pa.int32(), pa.list_(pa.float64())])
    got = found.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("r.*").collect()  # at most fit_rows
    y = np.array([r["y"] > 0 for r in got], float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.array([r["x"] for r in got])
    order = np.lexsort([*x.T, y])  # the same trees whatever order the rows came in
    return fit(x[order], y[order], monotone=tuple(MONOTONE.get(f, 0) for f in FEATURES))


def judge_quality(docs: DataFrame, model: Trees | None, *, id_column: str = "doc_id", text_column: str = "text", least_score: float = 0.5) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, and score (null without a model). No shuffle."""

    def run(columns: list[list]) -> list[list]:
        both = [statistics(t) for t in columns[1]]
        c = np.array([b[0] for b in both], np.int64).reshape(-1, len(COUNTS))
        failed = (c[:, 0] < 20) | (100 * c[:, 4] > 30 * c[:, 0])
        score = None if model is None else model.scores(np.array([b[1] for b in both]).reshape(-1, len(FEATURES)))
        kept = ~failed if score is None else ~failed & (score >= least_score)
        return [columns[0], *c.T, failed, kept, [None] * len(c) if score is None else np.round(score, 9)]

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return map_rows(id_and_text(docs, id_column, text_column), run, schema, [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()])
