"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting goes round the features; at each turn a shallow tree
(``LEAVES`` leaves at most) is fitted to the current error on that feature alone, and a small
part of it is added to the feature's lookup table. So features that say the same share the
credit, and the model stays a sum of one table for each feature. Then the pairs of features
that explain most of what is left get two-dimensional tables in the same way. A text's
score is the sum of the table entries of its bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.llm.features import QUALITY_FEATURES, quality_features
from companylens.llm.kernels import blocks, text_bytes
from companylens.llm.rows import in_fold
from companylens.llm.training import labelled_sample

BINS = 48
LEAVES = 4
ROUNDS = 150
RATE = 0.15
PAIRS = 10
PAIR_ROUNDS = 60
PAIR_BINS = 12
PENALTY = 2.0
# Texts of each class to learn from, at most.
PER_CLASS = 10_000


@dataclass
class AdditiveModel:
    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margins(self, features: np.ndarray) -> np.ndarray:
        out = np.full(len(features), self.bias)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], features[:, j], side="right")]
        coarse = {
            j: np.searchsorted(self.pair_edges[j], features[:, j], side="right")
            for j in {i for pair in self.pairs for i in pair}
        }
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[coarse[a], coarse[b]]
        return out


def _gain(g, h):
    return g * g / (h + PENALTY)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin of the best tree on one feature, grown split by split."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for leaf in leaves:
            low, high = leaf
            if high - low < 2:
                continue
            left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
            all_g, all_h = g[low:high].sum(), h[low:high].sum()
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            at = int(np.argmax(gains))
            if gains[at] > best[0]:
                best = (gains[at], leaf, low + at + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for low, high in leaves:
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + PENALTY)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree of depth two on two features."""
    best, out = 0.0, np.zeros_like(g)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        rows_g, rows_h = np.cumsum(gg, 0), np.cumsum(hh, 0)
        for cut in range(1, len(gg)):
            parts = []
            for part_g, part_h in (
                (rows_g[cut - 1], rows_h[cut - 1]),
                (rows_g[-1] - rows_g[cut - 1], rows_h[-1] - rows_h[cut - 1]),
            ):
                left_g, left_h = np.cumsum(part_g), np.cumsum(part_h)
                gains = _gain(left_g[:-1], left_h[:-1]) + _gain(left_g[-1] - left_g[:-1], left_h[-1] - left_h[:-1])
                at = int(np.argmax(gains))
                parts.append((gains[at], at + 1, left_g, left_h))
            gain = parts[0][0] + parts[1][0] - _gain(gg.sum(), hh.sum())
            if gain > best:
                best = gain
                value = np.zeros_like(gg)
                for rows, (_, at, left_g, left_h) in zip((slice(0, cut), slice(cut, None)), parts, strict=True):
                    value[rows, :at] = left_g[at - 1] / (left_h[at - 1] + PENALTY)
                    value[rows, at:] = (left_g[-1] - left_g[at - 1]) / (left_h[-1] - left_h[at - 1] + PENALTY)
                out = value.T if turn else value
    return best, out


def fit(features: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Boosted tables for logistic loss; both classes weigh the same."""
    model = AdditiveModel()
    n, width = features.shape if len(features) else (0, len(QUALITY_FEATURES))
    ones = int(labels.sum())
    if not ones or ones == n:
        share = ones / n if n else 0.5
        model.bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return model
    weight = np.where(labels == 1, 0.5 * n / ones, 0.5 * n / (n - ones))

    def cuts(bins: int) -> list[np.ndarray]:
        levels = np.linspace(0, 1, bins + 1)[1:-1]
        return [np.unique(np.quantile(features[:, j], levels)) for j in range(width)]

    model.edges, model.pair_edges = cuts(BINS), cuts(PAIR_BINS)
    fine = [np.searchsorted(e, features[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.zeros(n)

    def errors() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return weight * (labels - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j, bins in enumerate(fine):
            g, h = errors()
            size = len(model.tables[j])
            step = RATE * _tree(
                np.bincount(bins, weights=g, minlength=size), np.bincount(bins, weights=h, minlength=size)
            )
            model.tables[j] += step
            margin += step[bins]

    coarse = [np.searchsorted(e, features[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = errors()
        cell = coarse[a] * sizes[b] + coarse[b]
        total = sizes[a] * sizes[b]
        return tuple(
            np.bincount(cell, weights=x, minlength=total).reshape(sizes[a], sizes[b]) for x in (g, h)
        )

    candidates = [(a, b) for a in range(width) for b in range(a) if sizes[a] > 1 and sizes[b] > 1]
    ranked = sorted(candidates, key=lambda pair: -_pair_tree(*grid(*pair))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            step = RATE * _pair_tree(*grid(a, b))[1]
            model.pair_tables[k] += step
            margin += step[coarse[a], coarse[b]]
    return model


def _features_of(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column("text"))
    for low, high in blocks(offsets):
        yield low, high, quality_features(
            data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        )


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int = PER_CLASS) -> AdditiveModel:
    """Fit on a sample of ``per_class`` texts of each class at most.

    Without texts of both classes the model gives everything the share of ones, or 0.5
    without labels.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, features in _features_of(batch):
                flat = pa.array(features.reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        batch.column("label").slice(low, high - low),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(high - low + 1, dtype=np.int32) * features.shape[1]), flat
                        ),
                    ],
                    ["doc_id", "label", "features"],
                )

    sample = labelled_sample(docs, labels, label, allowed, per_class)
    rows = (
        sample.select(F.col("doc_id").cast("long"), "text", "label")
        .mapInArrow(measure, "doc_id long, label int, features array<double>")
        .toArrow()  # 2 * per_class rows of fixed width
        .sort_by("doc_id")
    )
    features = rows["features"].combine_chunks().flatten().to_numpy()
    return fit(features.reshape(-1, len(QUALITY_FEATURES)), rows["label"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every row; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for low, high, features in _features_of(batch):
                margin = np.clip(own.margins(features), -30, 30)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(1 / (1 + np.exp(-margin)))],
                    ["doc_id", "score"],
                )

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double")


def classify_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out_fold: int = 1
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Labels are learnt only outside the held-out fold. Null and empty texts get a score; a
    null doc_id is outside the fold and has no label. Repeated rows stay. Other columns are
    ignored.
    """
    allowed = ~in_fold(F.col("doc_id"), folds, held_out_fold)
    model = train(docs, labels, label, allowed)
    return score(docs, model).select(
        "doc_id",
        in_fold(F.col("doc_id"), folds, held_out_fold).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """Rows of ``docs`` that the classifier doesn't reject, with all their columns.

    Rows are judged where they are read, so neither ids nor order matter.
    """
    model = train(docs, labels, label, ~in_fold(F.col("doc_id"), folds, held_out_fold))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for low, high, features in _features_of(batch):
                yield batch.slice(low, high - low).filter(pa.array(own.margins(features) >= 0))

    return docs.mapInArrow(keep, docs.schema)


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return classify_quality(read("documents"), read("labels"))
