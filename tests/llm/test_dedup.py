"""Repeated byte strings and near-duplicates against brute force."""

import pytest
from llm_brute import components, repeats, words
from pyspark.sql import functions as F

import companylens.llm.minhash as minhash
import companylens.llm.repeats as repeated
from companylens.llm.components import connected_components
from companylens.llm.decontaminate import remove_contaminated
from companylens.llm.queries import QUERIES
from companylens.llm.rows import with_rows


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("bucket_runs", [2_000, 1])
def test_repeats(spark, awkward, monkeypatch, keep_first, bucket_runs):
    monkeypatch.setattr(repeated, "BUCKET_RUNS", bucket_runs)
    docs = [tuple(r) for r in awkward.orderBy("doc_id").collect()]
    found = repeated.cut_repeats(
        with_rows(awkward), 60, keep_first=keep_first, whole_characters=False, with_text=False
    ).collect()
    expected = repeats(docs, 60, keep_first)
    assert {
        r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found
    } == {i: x[:4] for i, x in expected.items()}


def test_repeats_in_one_text(spark):
    rows = [(1, "abc" * 200), (2, "x" * 199), (3, "x" * 200), (4, "y" * 201), (5, "y" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated.cut_repeats(with_rows(docs), keep_first=False, whole_characters=False).collect()
    expected = repeats(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == {
        i: x[:4] for i, x in expected.items()
    }


def test_remove_repeats_of_untidy_rows(spark, untidy, nothing):
    out = repeated.remove_repeats(untidy, 60).collect()
    assert len(out) == untidy.count()
    ones = [r for r in out if r["doc_id"] == 1]
    # One of the two equal rows keeps its text.
    assert sorted(r["n_removed"] == 0 for r in ones) == [False, True]
    assert all(r["kept_text"] is None for r in out if r["text"] is None)
    for r in out:
        if r["text"]:
            raw, at, kept = r["text"].encode(), 0, b""
            for span in r["spans"]:
                kept += raw[at : span["low"]]
                at = span["high"]
            assert (kept + raw[at:]).decode() == r["kept_text"]
    assert repeated.remove_repeats(nothing).count() == 0
    cut = repeated.cut_later_copies(untidy)
    assert cut.columns == untidy.columns
    assert cut.count() == untidy.count()
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["doc_id"] == 11)


def check_components(rows, texts, percent=85):
    expected = components(texts, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates(spark, awkward):
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    check_components(minhash.near_duplicates(awkward).collect(), texts)
    check_components(minhash.near_duplicates(awkward, percent=50).collect(), texts, 50)


def chain(n, width, step):
    """Texts that are each like the next one, but not like all."""
    sequence = [f"t{i}" for i in range(width + n * step)]
    return {i: " ".join(sequence[i * step : i * step + width]) for i in range(n)}


@pytest.mark.parametrize("block", [512, 4])
def test_chains_and_crowds_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = chain(25, 80, 5)
    crowd = [f"c{i}" for i in range(100)]
    for k in range(40):  # each differs from the others by a word or two, some too much
        words_of = list(crowd)
        for place in range(k % 4):
            words_of[(k * 7 + place * 29) % 100] = f"own{k}-{place}"
        texts[100 + k] = " ".join(words_of)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_components(minhash.near_duplicates(docs).collect(), texts)


def test_near_duplicates_of_untidy_rows(spark, untidy, nothing):
    rows = minhash.near_duplicates(untidy).collect()
    assert len(rows) == untidy.count()
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert minhash.near_duplicates(nothing).count() == 0
    out = minhash.drop_near_duplicates(untidy)
    assert out.columns == untidy.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(1) == 1
    assert not {2, 3, 14} & set(kept)
    assert {4, 5, 6, 7, 8, 9, 11, 12, 13, 15, 16, None} <= set(kept)


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 70), (70, 70), (None, 3), (90, 90)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {
        **{i: 1 for i in range(1, 41)},
        **{i: 50 for i in (50, 60, 70)},
    }
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registered_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in docs}
    check_components(QUERIES["op9_minhash_near_dedup"](spark, sf_dir).collect(), texts)
    rows = QUERIES["op1_suffix_array_dedup"](spark, sf_dir).collect()
    expected = repeats([(r["doc_id"], r["text"]) for r in docs])
    assert {r[0]: tuple(r)[1:] for r in rows} == {i: x[:4] for i, x in expected.items()}
    assert any(words(t) for t in texts.values())


CLASHES = ["__row", "__whole", "__kept", "__removed", "row", "n_removed", "kept_text", "a.b", "component_id"]


@pytest.fixture(scope="module")
def clashing(spark, untidy):
    """Columns named like helpers, with values to be found again."""
    number = F.coalesce("doc_id", F.lit(-1)) * 100
    return untidy.select("doc_id", "text", "n_chars", *[(number + i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.mark.parametrize("stage", ["cut", "near", "clean"])
def test_columns_named_like_helpers(spark, clashing, stage):
    items = spark.createDataFrame([(1, "no such text in any of the tables here")], "item_id long, text string")
    out = {
        "cut": lambda: repeated.cut_later_copies(clashing, 60),
        "near": lambda: minhash.drop_near_duplicates(clashing),
        "clean": lambda: remove_contaminated(clashing, items),
    }[stage]()
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows
    for r in rows:
        number = (-1 if r["doc_id"] is None else r["doc_id"]) * 100
        assert [r[c] for c in CLASHES] == [number + i for i in range(len(CLASHES))]


def test_added_columns_take_the_place_of_old_ones(clashing):
    rows = repeated.remove_repeats(clashing, 60).collect()
    assert len(rows) == clashing.count()
    assert all(r["__row"] == (-1 if r["doc_id"] is None else r["doc_id"]) * 100 for r in rows)
    assert all(len((r["text"] or "").encode()) == r["n_bytes"] for r in rows)
