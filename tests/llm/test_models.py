"""Language model and classifiers: exact parts by brute force, the rest on held-out rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_brute import base_scores, fold

from companylens.llm import langmodel, toxicity
from companylens.llm.features import QUALITY_FEATURES, quality_features
from companylens.llm.gam import AdditiveModel, classify_quality, fit, keep_good
from companylens.llm.kernels import mix, text_bytes
from companylens.llm.langmodel import BITS_PER_EVENT, LEVELS, CountFilter, bucket_of, fill, level_of, score_corpus
from companylens.llm.queries import QUERIES
from companylens.llm.toxicity import MIN_PAIR_Z, PairTest, classify_toxicity, paired_terms
from companylens.llm.toxicity import fit as fit_terms


def check_base(rows, docs):
    expected = base_scores(docs)
    assert len(rows) == len(docs)
    for r in rows:
        held_out, tokens, known, total, base = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out, tokens, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert -math.inf < r["score"] < 0


def test_language_model(spark, awkward):
    docs = [tuple(r) for r in awkward.collect()]
    check_base(score_corpus(awkward).collect(), docs)


def test_language_model_learns_pairs(spark):
    own = random.Random(12)
    follows = {i: own.randrange(200) for i in range(200)}
    docs = []
    for i in range(150):
        word, text = own.randrange(200), []
        for _ in range(80):
            text.append(f"w{word}")
            word = follows[word] if own.random() < 0.8 else own.randrange(200)
        docs.append((i, " ".join(text)))
    rows = score_corpus(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_base(rows, docs)
    assert all(r["score"] > 0.8 * r["base_score"] for r in rows if r["held_out"])


def test_language_model_of_the_driver_tables(spark, sf_dir):
    rows = QUERIES["op4_bloom_lm_scores"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in docs])
    held_out = [r for r in rows if r["held_out"]]
    # Few pairs repeat in so small a table; quantised counts must not cost much then.
    assert sum(r["score"] for r in held_out) > 1.01 * sum(r["base_score"] for r in held_out)


def test_language_model_of_untidy_rows(spark, untidy, nothing):
    rows = score_corpus(untidy).collect()
    assert len(rows) == untidy.count()
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    empty = {r["n_tokens"] for r in rows if r["doc_id"] in (6, 7, 8)}
    assert empty == {1}
    assert score_corpus(nothing).count() == 0


def test_count_filter_reads_levels_back():
    buckets, size = 4, 1 << 14
    hashes = mix(np.arange(1, 401, dtype=np.uint64))
    counts = np.array([1 + (i * i) % 500 for i in range(400)])
    bits = np.zeros(buckets * size, bool)
    for h, c in zip(hashes, counts, strict=True):
        one = np.array([h])
        for level in range(1, int(level_of(np.array([c]))[0]) + 1):
            for probe in range(6):
                at = CountFilter.places(one, level, probe, size).astype(int)
                bits[bucket_of(one, buckets).astype(int) * size + at] = True
    found = CountFilter(np.packbits(bits, bitorder="little"), buckets).levels(hashes)
    # A Bloom filter never reads too low.
    assert (found >= level_of(counts)).all()
    assert (found == level_of(counts)).mean() > 0.9
    assert (LEVELS[level_of(counts) - 1] <= counts).all()


def test_pairs_seen_once_count(spark):
    """A held-out copy of a text that was trained on once has known pairs."""
    own = random.Random(8)
    texts = [" ".join(f"w{own.randrange(1500)}" for _ in range(60)) for _ in range(100)]
    docs = spark.createDataFrame([(i, texts[i // 2]) for i in range(200)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in score_corpus(docs).collect()}
    copies = [r for i, r in rows.items() if r["held_out"] and not rows[i ^ 1]["held_out"]]
    assert copies
    assert all(r["score"] > 0.8 * r["base_score"] for r in copies)


def test_count_filter_grows_with_its_entries():
    """Ten bits for each entry at every size: as many false answers with many entries as with few."""
    for n in (2_000, 200_000):
        hashes = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
        top, first = np.full(n, 3), np.ones(n, np.int64)
        bits = fill(hashes[:n], top, first)
        assert len(bits) * 8 >= BITS_PER_EVENT * 3 * n
        found = CountFilter(bits, 1).levels(hashes)
        assert (found[:n] >= 3).all()
        assert (found[:n] == 3).mean() > 0.97
        assert (found[n:] == 0).mean() > 0.97


def test_blocks_of_texts_share_the_counts(spark, monkeypatch):
    """Many blocks and buckets give what one block gives, up to the filter's few false answers."""
    own = random.Random(4)
    texts = [" ".join(f"w{own.randrange(80)}" for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r for r in score_corpus(docs).collect()}
    monkeypatch.setattr(langmodel, "TEXT_BLOCK", 1_000)
    monkeypatch.setattr(langmodel, "BUCKET_TEXT", 300)
    rows = score_corpus(docs).collect()
    check_base(rows, list(enumerate(texts)))
    assert all(r["score"] == pytest.approx(whole[r["doc_id"]]["score"], rel=0.02) for r in rows)


def auc(labels, scores):
    order = np.argsort(np.argsort(scores)) + 1
    ones = labels == 1
    n = ones.sum()
    return (order[ones].sum() - n * (n + 1) / 2) / (n * (~ones).sum())


def test_factors_learn_what_sums_cannot():
    """Insult and mention together are toxic, either alone is not."""
    own = random.Random(3)
    rows, terms, labels = [], [], []
    for i in range(800):
        insult, mention = own.random() < 0.5, own.random() < 0.5
        chosen = {own.randrange(2, 30) for _ in range(4)} | ({0} if insult else set()) | ({1} if mention else set())
        rows += [i] * len(chosen)
        terms += sorted(chosen)
        labels.append(int(insult and mention) if own.random() < 0.98 else 0)
    rows, terms, labels = np.array(rows), np.array(terms), np.array(labels)
    model = fit_terms(rows, terms, labels, 30)
    margin = model.margins(rows, terms, 800)
    assert ((margin > 0) == (labels == 1)).mean() > 0.97
    assert model.factors[0] @ model.factors[1] > 0.5


@pytest.mark.parametrize("toxic", [lambda a, b: a != b, lambda a, b: a and b])
@pytest.mark.parametrize(("vocabulary", "words"), [(40, 10), (400, 30)])
def test_pairs_that_say_nothing_alone(spark, toxic, vocabulary, words):
    """Either of insult and mention, or both, through the whole training."""
    own = random.Random(5)
    docs, labels = [], []
    for i in range(1_200):
        plain = [f"{own.randrange(vocabulary):b}".translate({48: "o", 49: "k"}) + "ish" for _ in range(words)]
        insult, mention = own.random() < 0.5, own.random() < 0.5
        for word, there in (("Stupid", insult), ("strangers", mention)):
            if there:
                plain.insert(own.randrange(words), word)
        docs.append((i, " ".join(plain)))
        labels.append((i, int(toxic(insult, mention))))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = classify_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    judged = [r["predicted"] == labels[r["doc_id"]][1] for r in rows if r["held_out"]]
    assert len(judged) > 200
    assert sum(judged) > 0.95 * len(judged)


def test_pair_scores_by_brute_force(spark, monkeypatch):
    own = np.random.default_rng(6)
    n, n_terms = 400, 25
    held = own.random((n, n_terms)) < np.linspace(0.05, 0.9, n_terms)
    held[:, 3] = held[:, 20]
    share = own.random(n)
    truth = held[:, 10] ^ held[:, 20]
    error, expected = share - truth, share * (1 - share)
    wanted = set()
    for i in range(n_terms):
        for j in range(i):
            both = held[:, i] & held[:, j]
            spread = max((error[both] ** 2).sum(), expected[both].sum())
            if both.any() and abs(error[both].sum()) >= MIN_PAIR_Z * math.sqrt(spread):
                wanted |= {i, j}
    rows, terms = np.nonzero(held)
    assert wanted and len(wanted) < n_terms
    for block in (1 << 20, 7):
        monkeypatch.setattr(toxicity, "PAIR_BLOCK", block)
        test = PairTest.of(rows, terms, error, expected, n_terms)
        assert set().union(*({i, *test.partners(i)} for i in range(n_terms) if len(test.partners(i)))) == wanted
    assert set(paired_terms(spark, test)) == wanted


def test_margins_by_brute_force():
    own = np.random.default_rng(2)
    model = toxicity.FactorizationMachine(np.zeros(0), 0.3, own.normal(size=6), own.normal(size=(6, 3)))
    bags = [[], [2], [0, 1, 5], [0, 1, 2, 3, 4, 5]]
    rows = np.repeat(np.arange(4), [len(b) for b in bags])
    terms = np.array([t for b in bags for t in b])
    plain = [
        0.3
        + sum(model.linear[t] for t in b)
        + sum(model.factors[i] @ model.factors[j] for i in b for j in b if i < j)
        for b in bags
    ]
    assert model.margins(rows, terms, 4) == pytest.approx(plain)


def labelled(spark):
    own = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        plain = [f"w{own.randrange(300)}" for _ in range(60)]
        toxic = i % 4 == 0
        good = i % 5 != 0
        if toxic:
            plain[own.randrange(60)] = own.choice(["dreckskerl", "dreckskerle", "dreckig"])
        text = " ".join(plain) + "." if good else " ".join(w + "###" for w in plain)
        docs.append((i, text, "x", 0.5))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, None, None), (1001, "", None, None), (None, "w1 w2", None, None), (0, docs[0][1], "x", 0.5)]
    labels += [(2000, 1, 1), (None, 1, 0), (7, None, None), (1, 0, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, label string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize(
    ("classify", "folds", "held", "truth"),
    [(classify_toxicity, 5, 0, lambda i: i % 4 == 0), (classify_quality, 3, 1, lambda i: i % 5 != 0)],
)
def test_classifiers(spark, classify, folds, held, truth):
    docs, labels = labelled(spark)
    rows = classify(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"], folds) == held)
    judged = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    y = np.array([int(truth(r["doc_id"])) for r in judged])
    assert auc(y, np.array([r["score"] for r in judged])) > 0.95


def test_classifiers_without_labels(spark, untidy, nothing):
    labels = spark.createDataFrame([(99, 1, 1)], "doc_id long, quality int, toxic int")
    for classify in (classify_toxicity, classify_quality):
        assert {r["score"] for r in classify(untidy, labels).collect()} == {0.5}
        assert classify(nothing, labels.limit(0)).count() == 0


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = labelled(spark)
    for classify, folds, held, column in ((classify_toxicity, 5, 0, "toxic"), (classify_quality, 3, 1, "quality")):
        ids = [r["doc_id"] for r in labels.collect() if r["doc_id"] is not None and fold(r["doc_id"], folds) == held]
        other = labels.where(~labels.doc_id.isin(ids))
        one = {(r["doc_id"], r["score"]) for r in classify(docs, labels).collect()}
        two = {(r["doc_id"], r["score"]) for r in classify(docs, other).collect()}
        assert one == two, column


def test_keep_good_keeps_columns(spark):
    docs, labels = labelled(spark)
    out = keep_good(docs, labels)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    # Label 1 of document 1 is contradicted, so it is judged like an unlabelled one.
    good = {i for i in range(400) if i % 5}
    assert len(good & kept) > 0.97 * len(good)
    assert len(kept & (set(range(400)) - good)) < 5


def test_additive_model_needs_pairs():
    own = np.random.default_rng(4)
    x = own.random((3_000, len(QUALITY_FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = fit(x, y)
    assert any({a, b} == {0, 1} for a, b in model.pairs)
    assert ((model.margins(x) > 0) == (y == 1)).mean() > 0.95
    alone = AdditiveModel(model.edges, model.pair_edges, model.bias, model.tables)
    assert ((alone.margins(x) > 0) == (y == 1)).mean() < 0.8


def test_quality_features():
    texts = ["", None, "A bb ccc.\nA bb ccc.\n", "x x x x", "DDD### 123"]
    data, offsets = text_bytes(pa.array(texts))
    found = dict(zip(QUALITY_FEATURES, quality_features(data, offsets).T, strict=True))
    assert found["log_words"].tolist() == pytest.approx([0, 0, math.log(7), math.log(5), math.log(3)])
    assert found["upper_share"].tolist() == pytest.approx([0, 0, 1 / 6, 0, 1])
    assert found["adjacent_repeats"].tolist() == pytest.approx([0, 0, 0, 3 / 4, 0])
    assert found["repeated_lines"].tolist() == pytest.approx([0, 0, 0.5, 0, 0])
    assert found["decorated_words"].tolist() == pytest.approx([0, 0, 0, 0, 0.5])
    assert found["digit_share"].tolist() == pytest.approx([0, 0, 0, 0, 1 / 3])
