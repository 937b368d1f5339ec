"""Language-model scores from a log-frequency Bloom filter.

Counts are quantised on a logarithmic scale. An n-gram whose count has level q is put into
a Bloom filter once for each level up to q; its count is read back by probing level after
level until one is absent. The filter holds unigrams, and bigrams that occur ``MIN_COUNT``
times at least, of all training texts.

1. Texts are dealt to blocks of about ``TEXT_BLOCK`` bytes by a hash of their row. Each block
   sends its distinct n-grams, with their counts in training texts, to hash buckets. A
   frequent n-gram is one entry of each block, so it makes no bucket hot. Pairs are sent as
   32 bits beside the bucket, which collide far less often than the filter errs.
2. Each bucket adds the counts up and fills its own segment of the filter, with
   ``BITS_PER_EVENT`` bits for each entry it counted, so the filter is equally full whatever
   the corpus. It probes the segment for every block's n-grams and sends the levels back; no
   task and not the driver ever holds more than one segment.
3. Bigram and unigram probabilities are interpolated with a weight for each level of the
   context's count (Jelinek-Mercer). The weights come by expectation maximisation from a
   histogram over all training tokens, each left out of its own counts; the histogram's size
   is fixed.
4. Blocks put the levels to their tokens and store them; weights and scores need only those.

The base score needs exact counts of words, which the buckets send back too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.llm.kernels import (
    LOWER,
    blocks,
    mix,
    prefix_sums,
    span_hashes,
    text_bytes,
    word_spans,
)
from companylens.llm.rows import ROW, in_fold, with_rows
from companylens.operators.distributed import materialize

BITS_PER_EVENT = 10
PROBES = 5
MIN_COUNT = 1
# Bytes of text in a block, and of the texts whose n-grams share a bucket, on average.
TEXT_BLOCK = 4 << 20
BUCKET_TEXT = 32 << 20

_END = np.uint64(0x9D39247E33776D41)
_BEGIN = np.uint64(0x2AF7398005AAA5C7)
# Count levels: the distinct whole numbers among powers of 2 ** (1 / 2).
LEVELS = np.unique(np.floor(2.0 ** (np.arange(0, 2 * 48) / 2))).astype(np.int64)
_CENTRE = np.sqrt(LEVELS.astype(float) * np.append(LEVELS[1:] - 1, 2 * LEVELS[-1]))
# Histogram for the weights: ratio of bigram to unigram probability in steps of 2 ** (1 / 2).
_RATIOS = 96


def level_of(counts: np.ndarray) -> np.ndarray:
    """Level of each count; 0 for 0."""
    return np.searchsorted(LEVELS, counts, side="right")


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows of all tokens (words and one end a text), and of the token before."""
    lowered = LOWER[data]
    starts, ends, rows = word_spans(lowered, offsets)
    words = span_hashes(prefix_sums(lowered), starts, ends)
    n = len(offsets) - 1
    sizes = np.bincount(rows, minlength=n)
    closing = np.cumsum(sizes + 1) - 1
    tokens = np.empty(len(words) + n, np.uint64)
    owner = np.repeat(np.arange(n), sizes + 1)
    inner = np.ones(len(tokens), bool)
    inner[closing] = False
    tokens[inner] = words
    tokens[closing] = _END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[closing - sizes] = _BEGIN
    return tokens, before, owner


def _pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + tokens)


class CountFilter:
    """Reads quantised counts from the filter's segments."""

    def __init__(self, bits: np.ndarray, buckets: int):
        self.bits = bits
        self.buckets = buckets
        self.size = len(bits) * 8 // buckets

    @staticmethod
    def places(hashes: np.ndarray, level: np.ndarray | int, probe: int, size: int) -> np.ndarray:
        """Place in the bucket's segment for one level and probe."""
        salt = np.atleast_1d(np.asarray(level, np.uint64)) * np.uint64(PROBES) + np.uint64(probe + 1)
        return mix(hashes ^ (salt * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(size)

    def levels(self, hashes: np.ndarray, first: int = 1) -> np.ndarray:
        """Level of each n-gram's count, 0 if even level ``first`` is absent."""
        found = np.zeros(len(hashes), np.int64)
        base = bucket_of(hashes, self.buckets).astype(np.int64) * self.size
        active = np.arange(len(hashes))
        for level in range(first, len(LEVELS) + 1):
            for probe in range(PROBES):
                at = base[active] + self.places(hashes[active], level, probe, self.size).astype(np.int64)
                active = active[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(active):
                break
            found[active] = level
        return found


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the top bits; ``buckets`` is a power of two."""
    if buckets == 1:
        return np.zeros(len(hashes), np.uint64)
    return hashes >> np.uint64(65 - buckets.bit_length())


def _cut(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column with the values between neighbouring cuts."""
    ends = np.ascontiguousarray(cuts * values.itemsize, np.int32)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, buffers)


def _values(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and the cuts between its rows."""
    data, offsets = text_bytes(column)
    return data.view(kind), offsets // np.dtype(kind).itemsize


class _Block:
    """Tokens of a block of texts, its distinct words and pairs, and where they stand."""

    def __init__(self, group: pa.Table, buckets: int):
        self.table = group.sort_by("row")
        tokens, before, self.owner = _tokens(*text_bytes(self.table["text"]))
        self.words, self.word_at = np.unique(tokens, return_inverse=True)
        # Bucket and 32 bits more.
        pairs = _pairs(before, tokens) >> np.uint64(33 - buckets.bit_length())
        self.pairs, self.pair_at = np.unique(pairs, return_inverse=True)


NGRAM_SCHEMA = "block long, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"


def _ngrams(blocks_of_docs: DataFrame, buckets: int) -> DataFrame:
    """Distinct n-grams of each block and bucket, in order, with their training counts."""

    def send(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        own = _Block(group, buckets)
        train = own.table["train"].to_numpy().astype(float)[own.owner]
        counts = lambda at, n: np.bincount(at, weights=train, minlength=n).astype(np.uint32)
        numbers = np.arange(buckets + 1)
        word_cuts = np.searchsorted(bucket_of(own.words, buckets), numbers)
        pair_cuts = np.searchsorted(own.pairs >> np.uint64(32), numbers)
        full = np.flatnonzero(np.diff(word_cuts) + np.diff(pair_cuts))
        word_cuts = np.append(word_cuts[full], word_cuts[-1])
        pair_cuts = np.append(pair_cuts[full], pair_cuts[-1])
        return pa.table(
            {
                "block": pa.array(np.full(len(full), key[0].as_py(), np.int64)),
                "bucket": pa.array(full.astype(np.int32)),
                "words": _cut(own.words, word_cuts),
                "word_counts": _cut(counts(own.word_at, len(own.words)), word_cuts),
                "pairs": _cut(own.pairs.astype(np.uint32), pair_cuts),
                "pair_counts": _cut(counts(own.pair_at, len(own.pairs)), pair_cuts),
            }
        )

    return blocks_of_docs.groupBy("block").applyInArrow(send, NGRAM_SCHEMA)


def fill(hashes: np.ndarray, top: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bytes of a segment with the entries from level ``first`` to ``top`` of each n-gram."""
    events = int(np.maximum(top - first + 1, 0).sum())
    size = max(-(-events * BITS_PER_EVENT // 64), 8) * 64
    bits = np.zeros(size, bool)
    active = np.flatnonzero(first <= top)
    level = first.copy()
    while len(active):
        for probe in range(PROBES):
            bits[CountFilter.places(hashes[active], level[active], probe, size).astype(np.int64)] = True
        level[active] += 1
        active = active[level[active] <= top[active]]
    return np.packbits(bits, bitorder="little")


# Beside the answers, one row without a block for each bucket: training tokens, and its
# numbers of words by level.
ANSWER_SCHEMA = (
    "block long, bucket int, word_levels binary, word_counts binary, pair_levels binary, "
    "tokens long, by_level array<long>"
)


def _answers(ngrams: DataFrame) -> DataFrame:
    """Levels of each block's n-grams by the filter, and exact training counts of its words."""
    first_pair = int(level_of(np.array([MIN_COUNT]))[0])

    def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket, n = key[0].as_py(), group.num_rows
        words, word_cuts = _values(group["words"], np.uint64)
        pairs, pair_cuts = _values(group["pairs"], np.uint32)
        words, word_at = np.unique(words, return_inverse=True)
        pairs, pair_at = np.unique(pairs, return_inverse=True)
        pairs = pairs.astype(np.uint64) | np.uint64(bucket << 32)

        def added(column: str, at: np.ndarray, size: int) -> np.ndarray:
            return np.bincount(at, weights=_values(group[column], np.uint32)[0], minlength=size).astype(np.int64)

        word_counts = added("word_counts", word_at, len(words))
        pair_counts = added("pair_counts", pair_at, len(pairs))
        top = level_of(np.concatenate((word_counts, pair_counts)))
        first = np.repeat([1, first_pair], [len(words), len(pairs)])
        segment = CountFilter(fill(np.concatenate((words, pairs)), top, first), 1)
        word_levels = segment.levels(words).astype(np.uint8)[word_at]
        pair_levels = segment.levels(pairs, first_pair).astype(np.uint8)[pair_at]
        by_level = np.bincount(top[: len(words)], minlength=len(LEVELS) + 1)
        by_level[0] = 0  # words of held-out texts only
        none = pa.nulls(1, pa.binary())
        return pa.table(
            {
                "block": pa.concat_arrays([group["block"].combine_chunks(), pa.nulls(1, pa.int64())]),
                "bucket": pa.array(np.full(n + 1, bucket, np.int32)),
                "word_levels": pa.concat_arrays([_cut(word_levels, word_cuts), none]),
                "word_counts": pa.concat_arrays([_cut(word_counts[word_at], word_cuts), none]),
                "pair_levels": pa.concat_arrays([_cut(pair_levels, pair_cuts), none]),
                "tokens": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([int(word_counts.sum())])]),
                "by_level": pa.array([None] * n + [by_level.tolist()], pa.list_(pa.int64())),
            }
        )

    return ngrams.groupBy("bucket").applyInArrow(answer, ANSWER_SCHEMA)


class Model:
    """A few numbers of the training texts, and the weights."""

    def __init__(self, tokens: int, texts: int, by_level: dict[int, int]):
        self.tokens = tokens  # all training tokens
        self.words = sum(by_level.values())  # distinct ones
        # Sum of the distinct words' quantised counts.
        self.centred = sum(n * _CENTRE[level - 1] for level, n in sorted(by_level.items()))
        self.begin = int(level_of(np.array([texts]))[0])
        self.weights = np.zeros(len(LEVELS) + 2)

    def probabilities(self, words: np.ndarray, pairs: np.ndarray, cuts: np.ndarray, without_self: bool = False):
        """Unigram and bigram probability of each token, and the level of its context.

        ``words`` and ``pairs`` have the tokens' levels, ``cuts`` the texts' begins and the
        end. ``without_self`` takes each token out of the counts it is in.
        """
        unigram = (np.append(0.0, _CENTRE)[words] + 1) / (self.centred + self.words + 1)
        # A context is the token before, or the begin of a text.
        context = np.empty(len(words), np.int64)
        context[1:] = words[:-1]
        context[cuts[:-1]] = self.begin
        upper = np.append(LEVELS[1:] - 1, 2 * LEVELS[-1]).astype(float)
        context_count = np.append(1.0, upper)[context]
        pair_count = np.append(0, LEVELS)[pairs].astype(float)
        if without_self:
            pair_count = np.maximum(pair_count - 1, 0)
            context_count = np.maximum(context_count - 1, 1)
        return unigram, np.minimum(pair_count / context_count, 1.0), context


def _ratio_bin(unigram: np.ndarray, bigram: np.ndarray) -> np.ndarray:
    """0 for an unseen pair, else the bin of the ratio of the two probabilities."""
    ratio = np.log2(np.maximum(bigram, 1e-300) / unigram)
    return np.where(bigram > 0, np.clip(np.round(2 * ratio) + 24, 1, _RATIOS - 1), 0).astype(np.int64)


def _weights(histogram: np.ndarray) -> np.ndarray:
    """Weight of the bigram for each context level, by expectation maximisation."""
    ratios = 2.0 ** ((np.arange(_RATIOS) - 24) / 2)
    ratios[0] = 0
    weights = np.full(len(histogram), 0.3)
    # A level with few tokens leans on the average over all levels.
    histogram = histogram + 20 * histogram.sum(0) / max(histogram.sum(), 1)
    for _ in range(200):
        bigram = weights[:, None] * ratios
        share = bigram / (bigram + 1 - weights[:, None])
        weights = (histogram * share).sum(1) / np.maximum(histogram.sum(1), 1e-9)
        weights = np.clip(weights, 0, 0.999)
    weights[0] = 0  # a context that was never seen says nothing
    return weights


LEVEL_SCHEMA = (
    "row long, train boolean, n_tokens long, n_known long, base_score double, "
    "word_levels binary, pair_levels binary"
)


def text_levels(docs: DataFrame) -> tuple[Model, DataFrame]:
    """Model without weights, and the stored token levels and base score of every row.

    ``docs`` has a unique ``row``, a text, and ``train``.
    """
    sizes = docs.agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("train").cast("int")).alias("texts")
    ).first()
    n_bytes = sizes["bytes"] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(4, (max(partitions, n_bytes // BUCKET_TEXT) - 1).bit_length())
    n_blocks = n_bytes // TEXT_BLOCK + 1
    dealt = docs.select("row", "text", "train", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block"))

    answers = materialize(_answers(_ngrams(dealt, buckets)), "levels")
    numbers = answers.where("block is null")
    tokens = numbers.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    table = numbers.select(F.posexplode("by_level").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n"))
    model = Model(tokens, sizes["texts"] or 0, {r["level"]: r["n"] for r in table.collect() if r["n"]})
    total = model.tokens + model.words + 1

    def put(key: tuple[pa.Scalar, ...], group: pa.Table, found: pa.Table) -> pa.Table:
        own = _Block(group, buckets)
        found = found.sort_by("bucket")
        n = own.table.num_rows
        counts = _values(found["word_counts"], np.int64)[0][own.word_at]
        sizes = np.bincount(own.owner, minlength=n)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return pa.table(
            {
                "row": own.table["row"],
                "train": own.table["train"],
                "n_tokens": pa.array(sizes.astype(np.int64)),
                "n_known": pa.array(np.bincount(own.owner[counts > 0], minlength=n).astype(np.int64)),
                "base_score": pa.array(np.bincount(own.owner, weights=np.log10((counts + 1) / total), minlength=n)),
                "word_levels": _cut(_values(found["word_levels"], np.uint8)[0][own.word_at], cuts),
                "pair_levels": _cut(_values(found["pair_levels"], np.uint8)[0][own.pair_at], cuts),
            }
        )

    answered = answers.where("block is not null").select(
        "block", "bucket", "word_levels", "word_counts", "pair_levels"
    )
    levels = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(put, LEVEL_SCHEMA)
    return model, materialize(levels, "scored")


def _level_blocks(batch: pa.RecordBatch):
    """Parts of a batch with half a million tokens: first and last row, levels, cuts."""
    words, offsets = text_bytes(batch.column("word_levels"))
    pairs, _ = text_bytes(batch.column("pair_levels"))
    for low, high in blocks(4 * offsets):
        part = slice(offsets[low], offsets[high])
        yield low, high, words[part], pairs[part], offsets[low : high + 1] - offsets[low]


def fit_weights(model: Model, levels: DataFrame) -> None:
    """Set the model's weights from the training rows of ``levels``."""
    shared = levels.sparkSession.sparkContext.broadcast(model)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        histogram = np.zeros((len(LEVELS) + 2) * _RATIOS, np.int64)
        for batch in batches:
            for _, _, words, pairs, cuts in _level_blocks(batch):
                unigram, bigram, context = own.probabilities(words, pairs, cuts, without_self=True)
                cell = context * _RATIOS + _ratio_bin(unigram, bigram)
                histogram += np.bincount(cell, minlength=len(histogram))
        cells = np.flatnonzero(histogram)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(histogram[cells])], ["cell", "n"])

    training = levels.where("train").select("word_levels", "pair_levels")
    cells = training.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    histogram = np.zeros((len(LEVELS) + 2) * _RATIOS)
    for row in cells.collect():
        histogram[row["cell"]] = row["n"]
    model.weights = _weights(histogram.reshape(-1, _RATIOS))
    shared.unpersist()


def score(model: Model, levels: DataFrame) -> DataFrame:
    """row, n_tokens, n_known, train_tokens, base_score and score of every row of ``levels``."""
    shared = levels.sparkSession.sparkContext.broadcast(model)
    kept = ["row", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for low, high, words, pairs, cuts in _level_blocks(batch):
                unigram, bigram, context = own.probabilities(words, pairs, cuts)
                weight = own.weights[context]
                logs = np.log10(weight * bigram + (1 - weight) * unigram)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(low, high - low) for c in kept] + [pa.array(np.add.reduceat(logs, cuts[:-1]))],
                    [*kept, "score"],
                )

    scored = levels.select(*kept, "word_levels", "pair_levels").mapInArrow(
        run, "row long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "row", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def score_corpus(docs: DataFrame, folds: int = 7, held_out_fold: int = 2) -> DataFrame:
    """Train on the texts outside one fold of doc_id and score all.

    A null text is empty: one end token. A null doc_id is in the training part. Repeated
    rows are texts of their own, and count as such. Other columns are ignored. An empty
    table, or one without training texts, scores by a model without counts.
    """
    docs = with_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    docs = docs.withColumnRenamed(ROW, "row")
    held_out = in_fold(F.col("doc_id"), folds, held_out_fold)
    model, levels = text_levels(docs.withColumn("train", ~held_out))
    fit_weights(model, levels)
    scores = score(model, levels)
    return docs.select("doc_id", "row", held_out.alias("held_out")).join(scores, "row").drop("row")


def op4_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
