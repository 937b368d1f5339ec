"""Toxicity scores by a factorization machine over hashed terms.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), with x_i = 1 if the
text holds term i. The factors let a pair of terms count for more, or less, than the sum of
both: an insult beside the mention of a group, where either alone says little. The sum over
pairs is computed as half of (sum of v)^2 - sum of v^2, in time linear in the terms.

Terms are hashed words and stems, in ``BUCKETS`` buckets. A term enters the model if it says
something alone or in a pair: if its frequency differs between the classes (z score of
``MIN_Z``), or if the texts that hold it together with another term are mislabelled to one side
by the single terms (score test, z of ``MIN_PAIR_Z``). All pairs of terms that could reach that
score are tested, each in one task, and there is no cap on the terms. Weights and factors of
all of them are then learnt together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.llm.features import hashed_terms
from companylens.llm.kernels import blocks, text_bytes
from companylens.llm.rows import in_fold
from companylens.llm.training import labelled_sample
from companylens.operators.distributed import materialize

BUCKETS = 1 << 20
STEMS = (4, 5)
MIN_Z = 4.0
# One of 500 million pairs reaches this by chance. A pair in n texts has a score of sqrt(n) at
# most, so terms in fewer than its square need not be paired.
MIN_PAIR_Z = 6.0
PAIR_TEXTS = int(MIN_PAIR_Z**2)
# Cells looked at in one go by the pair test; does not change its result.
PAIR_BLOCK = 1 << 20
PAIR_TASKS = 64
FACTORS = 8
# Texts of each class to learn from, at most.
PER_CLASS = 6_000


@dataclass
class FactorizationMachine:
    """Weights of the terms in use; ``place`` maps a bucket to its term or -1."""

    place: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        out += np.bincount(rows, weights=self.linear[terms], minlength=n)
        for f in range(self.factors.shape[1]):
            value = self.factors[terms, f]
            total = np.bincount(rows, weights=value, minlength=n)
            squares = np.bincount(rows, weights=value * value, minlength=n)
            out += 0.5 * (total * total - squares)
        return out


def class_weights(labels: np.ndarray) -> np.ndarray:
    """Both classes weigh the same, whatever their numbers."""
    return np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))


def fit(
    rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, n_terms: int, n_factors: int = FACTORS
) -> FactorizationMachine:
    """Logistic loss with L2 penalties, minimised by Adam over all training rows."""
    random = np.random.default_rng(7)
    n = len(labels)
    model = FactorizationMachine(
        np.zeros(0, np.int32),
        0.0,
        np.zeros(n_terms),
        random.normal(0, 0.05, (n_terms, n_factors)),
    )
    weight = class_weights(labels)
    state: dict[str, list] = {}

    def step(name: str, value, gradient, rate: float, t: int):
        mean, square = state.setdefault(name, [np.zeros_like(gradient), np.zeros_like(gradient)])
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient * gradient - square)
        return value - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)

    for t in range(1, 301):
        margin = np.clip(model.margins(rows, terms, n), -30, 30)
        error = weight * (1 / (1 + np.exp(-margin)) - labels)
        linear = np.bincount(terms, weights=error[rows], minlength=n_terms) + 1e-5 * model.linear
        factors = np.empty_like(model.factors)
        for f in range(n_factors):
            value = model.factors[terms, f]
            total = np.bincount(rows, weights=value, minlength=n)
            factors[:, f] = np.bincount(terms, weights=error[rows] * (total[rows] - value), minlength=n_terms)
        factors += 1e-4 * model.factors
        model.linear = step("linear", model.linear, linear, 0.05, t)
        model.factors = step("factors", model.factors, factors, 0.02, t)
        model.bias = float(step("bias", np.array(model.bias), np.array(error.sum()), 0.05, t))
    return model


@dataclass
class PairTest:
    """Texts with their terms, ascending, and errors of the single terms; tests pairs of terms."""

    row_starts: np.ndarray
    terms: np.ndarray
    # Places in ``terms`` of each term, one term after the other, and the texts they belong to.
    term_starts: np.ndarray
    places: np.ndarray
    rows: np.ndarray
    error: np.ndarray
    # What the single terms expect of the error's square.
    expected: np.ndarray

    @classmethod
    def of(
        cls, rows: np.ndarray, terms: np.ndarray, error: np.ndarray, expected: np.ndarray, n_terms: int
    ) -> PairTest:
        """``rows`` and ``terms`` are in the order of rows, then terms."""
        row_starts = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(error)))))
        term_starts = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=n_terms))))
        places = np.argsort(terms, kind="stable").astype(np.int32)
        own = rows[places].astype(np.int32, copy=False)
        return cls(row_starts, terms.astype(np.int32, copy=False), term_starts, places, own, error, expected)

    def partners(self, term: int) -> np.ndarray:
        """Higher terms that make a pair of sufficient score with ``term``.

        The sum of errors is measured by what was expected and by what was found, whichever is
        more: few surprises in texts that looked certain are no evidence, nor are many small
        errors to one side.
        """
        n_terms = len(self.term_starts) - 1
        mine = slice(self.term_starts[term], self.term_starts[term + 1])
        rows, starts = self.rows[mine], self.places[mine].astype(np.int64) + 1
        lengths = self.row_starts[rows + 1] - starts
        total, square, expected = np.zeros(n_terms), np.zeros(n_terms), np.zeros(n_terms)
        ends = np.cumsum(lengths)
        low = 0
        while low < len(rows):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + PAIR_BLOCK, side="right")))
            size = lengths[low:high]
            first = np.repeat(starts[low:high] - (ends[low:high] - size - done), size)
            others = self.terms[first + np.arange(len(first))]
            error = np.repeat(self.error[rows[low:high]], size)
            total += np.bincount(others, weights=error, minlength=n_terms)
            square += np.bincount(others, weights=error * error, minlength=n_terms)
            expected += np.bincount(others, weights=np.repeat(self.expected[rows[low:high]], size), minlength=n_terms)
            low = high
        return np.flatnonzero(np.abs(total) >= MIN_PAIR_Z * np.sqrt(np.maximum(square, expected)) + 1e-12)


def paired_terms(spark: SparkSession, test: PairTest) -> np.ndarray:
    """Terms of all pairs that say something together; each task tests some terms with all others."""
    n_terms = len(test.term_starts) - 1
    shared = spark.sparkContext.broadcast(test)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for term in batch.column(0).to_numpy():
                partners = own.partners(int(term))
                if len(partners):
                    found += [np.array([term]), partners]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["term"])

    # Pairs belong to their lower term, so that low terms have more to do: low and high ones
    # take turns.
    place = F.col("id")
    turn = F.when(place % 2 == 0, place).otherwise(F.lit(n_terms - n_terms % 2) - place)
    terms = spark.range(0, n_terms, 1, PAIR_TASKS).select(turn.alias("term"))
    found = terms.mapInArrow(run, "term long").distinct()
    # At most the terms tested.
    return np.sort(np.array([r["term"] for r in found.collect()], np.int64))


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int = PER_CLASS) -> FactorizationMachine:
    """Fit on a sample of ``per_class`` texts of each class at most.

    Copies of a text count once; texts whose copies have both labels teach nothing and are left
    out. Without texts of both classes the model gives everything the share of ones, or 0.5
    without labels.
    """

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in blocks(offsets):
                rows, terms = hashed_terms(
                    data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], BUCKETS, STEMS
                )
                n = high - low
                ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").slice(low, n),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(terms.astype(np.int32))),
                    ],
                    ["label", "terms"],
                )

    sample = labelled_sample(docs, labels, label, allowed, per_class)
    sample = sample.groupBy("text").agg(F.min("label").alias("label"), F.max("label").alias("high"))
    sample = sample.where(F.col("label") == F.col("high")).select("text", "label")
    bags = materialize(
        sample.mapInArrow(terms_of, "label int, terms array<int>").withColumn(
            "id", F.monotonically_increasing_id()
        ),
        "term-bags",
    )
    sizes = {r["label"]: r["count"] for r in bags.groupBy("label").count().collect()}
    zeros, ones = sizes.get(0, 0), sizes.get(1, 0)
    if not zeros or not ones:
        share = ones / (zeros + ones) if zeros + ones else 0.5
        bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return FactorizationMachine(np.full(BUCKETS, -1, np.int32), bias, np.zeros(1), np.zeros((1, FACTORS)))

    pooled = (F.col("n0") + F.col("n1")) / F.lit(float(zeros + ones))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / zeros + 1 / ones))
    counts = (
        bags.select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum(1 - F.col("label")).alias("n0"), F.sum("label").alias("n1"))
        .withColumn("z", F.abs(F.col("n1") / ones - F.col("n0") / zeros) / (spread + 1e-9))
        .where((F.col("z") >= MIN_Z) | (F.col("n0") + F.col("n1") >= PAIR_TEXTS))
        .withColumn("single", F.col("z") >= MIN_Z)
        .select("term", "single", (F.col("n0") + F.col("n1") >= PAIR_TEXTS).alias("pairs"))
    )
    # Both are bounded by the sample and the number of buckets.
    known = counts.toArrow().sort_by("term")
    buckets = known["term"].to_numpy()
    single, pairs = (known[c].to_numpy() for c in ("single", "pairs"))
    numbers = np.full(BUCKETS, -1, np.int32)
    numbers[buckets] = np.arange(len(buckets))
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            terms = shared.value[lists.flatten().to_numpy()]
            owners = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[terms >= 0]
            ends = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(lists))))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(terms[terms >= 0]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists], ["id", "label", "terms"])

    marks = bags.select("id", "label", "terms").mapInArrow(numbered, "id long, label int, terms array<int>")
    marks = marks.toArrow().sort_by("id")
    truth = marks["label"].to_numpy().astype(np.int64)
    lists = marks["terms"].combine_chunks()
    terms = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(len(truth), dtype=np.int32), lists.value_lengths().to_numpy())

    def part(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and terms of the chosen ones, numbered from 0, and where each was."""
        numbers = (np.cumsum(chosen) - 1).astype(np.int32)
        keep = chosen[terms]
        return rows[keep], numbers[terms[keep]], np.flatnonzero(chosen)

    alone_rows, alone, places = part(single)
    linear = fit(alone_rows, alone, truth, max(len(places), 1), 0)
    margin = np.clip(linear.margins(alone_rows, alone, len(truth)), -30, 30)
    share, weight = 1 / (1 + np.exp(-margin)), class_weights(truth)
    error, expected = weight * (share - truth), weight * weight * share * (1 - share)
    pair_rows, paired, places = part(pairs)
    chosen = single.copy()
    if len(places):
        test = PairTest.of(pair_rows, paired, error, expected, len(places))
        chosen[places[paired_terms(docs.sparkSession, test)]] = True

    used_rows, used, places = part(chosen)
    model = fit(used_rows, used, truth, max(len(places), 1))
    model.place = np.full(BUCKETS, -1, np.int32)
    model.place[buckets[places]] = np.arange(len(places))
    return model


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id and score of every row; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in blocks(offsets):
                n = high - low
                rows, terms = hashed_terms(
                    data[offsets[low] : offsets[high]],
                    offsets[low : high + 1] - offsets[low],
                    BUCKETS,
                    STEMS,
                    own.place >= 0,
                )
                margin = np.clip(own.margins(rows, own.place[terms], n), -30, 30)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, n), pa.array(1 / (1 + np.exp(-margin)))],
                    ["doc_id", "score"],
                )

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double")


def classify_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out_fold: int = 0
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


def op2_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return classify_toxicity(read("documents"), read("labels"))
