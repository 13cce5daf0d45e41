"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over quantile bins. Cyclic boosting visits the features in
turn and adds to a table the steps of a shallow tree on the residuals of that feature alone;
the pairs whose joint bins still explain most of what is left get tables of their own, boosted by
a Newton step for each cell. A score is a sum of table entries, so a batch is scored by `searchsorted` and adds.

Nulls and empty texts have all counts 0 and a score like any other row. Rows are scored one by
one: repeated rows repeat, ties get the same score, an empty table gives an empty result and
extra columns are ignored. Labels whose fold is held out, labels without an id or a value, and
ids absent from the documents never reach the fit. Without both classes the score is the
smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, held_out, labelled_sample, read_table, text_buffer
from .stats import FEATURES, features

THRESHOLD = 0.3


@dataclass
class Gam:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        if self.tables:
            for t, b in zip(self.tables, self.bins(x, self.edges)):
                out += t[b]
        if self.pairs:
            coarse = self.bins(x, self.pair_edges)
            for i, j, t in self.pairs:
                out += t[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _cuts(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree_step(b: np.ndarray, g: np.ndarray, h: np.ndarray, n_bins: int, leaves: int, ridge: float) -> np.ndarray:
    """Newton steps of a greedy tree with at most `leaves` leaves over the ordered bins of one feature."""
    G = np.concatenate([[0], np.cumsum(np.bincount(b, g, n_bins))])
    H = np.concatenate([[0], np.cumsum(np.bincount(b, h, n_bins))])
    parts = [(0, n_bins)]
    gain = lambda lo, hi: (G[hi] - G[lo]) ** 2 / (H[hi] - H[lo] + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for lo, hi in parts:
            if hi - lo > 1:
                cut = np.arange(lo + 1, hi)
                gains = (G[cut] - G[lo]) ** 2 / (H[cut] - H[lo] + ridge) + (G[hi] - G[cut]) ** 2 / (H[hi] - H[cut] + ridge) - gain(lo, hi)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], (lo, hi), int(cut[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(n_bins)
    for lo, hi in parts:
        step[lo:hi] = (G[hi] - G[lo]) / (H[hi] - H[lo] + ridge)
    return step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, rate: float = 0.15, leaves: int = 3, pairs: int = 6, pair_bins: int = 8, ridge: float = 2.0) -> Gam:
    """Cyclic boosting on the log loss; then the same on the `pairs` most useful pairs of features."""
    share = (y.sum() + 1) / (len(y) + 2)
    m = Gam(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return m
    d = x.shape[1]
    m.edges = [_cuts(x[:, j], bins) for j in range(d)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    b = m.bins(x, m.edges)
    raw = np.full(len(y), m.intercept)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-raw))
            step = rate * _tree_step(b[j], y - p, p * (1 - p), len(m.tables[j]), leaves, ridge)
            m.tables[j] += step
            raw += step[b[j]]
    m.pair_edges = [_cuts(x[:, j], pair_bins) for j in range(d)]
    c = m.bins(x, m.pair_edges)
    size = [len(e) + 1 for e in m.pair_edges]
    p = 1 / (1 + np.exp(-raw))
    g, h = y - p, p * (1 - p)
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            cell = c[i] * size[j] + c[j]
            n = size[i] * size[j]
            gains.append((float((np.bincount(cell, g, n) ** 2 / (np.bincount(cell, h, n) + ridge)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        m.pairs.append((i, j, np.zeros((size[i], size[j]))))
    for _ in range(rounds // 4):
        for i, j, t in m.pairs:
            cell = c[i] * size[j] + c[j]
            p = 1 / (1 + np.exp(-raw))
            step = rate * np.bincount(cell, y - p, t.size) / (np.bincount(cell, p * (1 - p), t.size) + ridge)
            t += step.reshape(t.shape)
            raw += step[cell]
    return m


def featurise(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns (long) and the FEATURES of each whole text."""
    names = ", ".join(f"{f} float" for f in FEATURES)

    def make():
        def work(part):
            x = features(*text_buffer(part.column("text")))
            return {k: part.column(k) for k in keep} | {f: x[:, j] for j, f in enumerate(FEATURES)}

        return work

    return arrow_map(docs.select(*[F.col(k).cast("long").alias(k) for k in keep], "text"), ", ".join(f"{k} long" for k in keep) + ", " + names, make)


def train(spark: SparkSession, sf_dir: str, documents: DataFrame, rows: int = 8000, label: str = "quality") -> Gam:
    """Fit on the features of at most `rows` labelled documents outside the held-out fold.

    The driver gets 16 floats for each of these rows, never texts.
    """
    got = featurise(labelled_sample(spark, sf_dir, documents, label, rows), "label").toPandas()
    got = got.sort_values(list(got.columns))
    return fit(got[list(FEATURES)].to_numpy(np.float64), got["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""

    def make():
        def work(part):
            s = model.score(features(*text_buffer(part.column("text"))).astype(np.float64))
            return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    return arrow_map(docs.select("doc_id", "text", held_out().alias("held_out")), "doc_id long, held_out boolean, score double, predicted int", make)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(spark, sf_dir, docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with the columns of `docs`; order and other columns stay."""
    model = train(spark, sf_dir, docs)
    names = docs.columns
    schema = docs.schema

    def keep(batches):
        import pyarrow as pa

        from .shared import slices

        for batch in batches:
            for part in slices(batch, "text"):
                s = model.score(features(*text_buffer(part.column(names.index("text")))).astype(np.float64))
                yield part.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(keep, schema)
