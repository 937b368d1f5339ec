"""Passages of earlier documents against brute force."""

import collections
import hashlib
import random

import pytest
from llm_brute import words

from companylens.llm import substrings
from companylens.llm.queries import QUERIES


def plain(docs, window):
    """{key: (words, removed, sha256, kept words)} of [(doc_id, key, text)] in any order."""
    behind = 1 << 64
    order = {key: (behind if i is None else i, at) for at, (i, key, _) in enumerate(docs)}
    earliest = {}
    for _, key, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            earliest[k] = min(earliest.get(k, order[key]), order[key])
    out = {}
    for _, key, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if earliest[tuple(w[i : i + window])] < order[key]:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[key] = (len(w), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept)
    return out


def passages(seed, n):
    """Texts that share passages, in full, in part, changed, and more than once."""
    rng = random.Random(seed)
    common = [[f"p{k}.{i}" for i in range(rng.randrange(5, 60))] for k in range(6)]
    out = []
    for d in range(n):
        text = []
        for _ in range(rng.randrange(6)):
            piece = list(rng.choice(common))
            if rng.random() < 0.4:
                piece[rng.randrange(len(piece))] = f"own{d}"
            if rng.random() < 0.3:
                piece = piece[rng.randrange(len(piece)) :]
            text += piece + [f"t{rng.randrange(50)}" for _ in range(rng.randrange(8))]
        out.append((d, d, " ".join(text)))
    return out


def check(found, expected):
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == {
        i: x[:3] for i, x in expected.items()
    }


@pytest.mark.parametrize("group_runs", [4_000, 1])
@pytest.mark.parametrize("window, anchor", [(9, 3), (20, 4), (5, 12)])
def test_passages(spark, monkeypatch, group_runs, window, anchor):
    monkeypatch.setattr(substrings, "GROUP_RUNS", group_runs)
    monkeypatch.setattr(substrings, "SORT_RUNS", 40)
    monkeypatch.setattr(substrings, "ANCHOR", anchor)
    docs = passages(window, 60)
    df = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    found = substrings.remove_earlier_passages(df, window).collect()
    expected = plain(docs, window)
    check(found, expected)
    assert sum(x[1] for x in expected.values()) > 300
    for r in found:
        assert words(r["kept_text"]) == words(expected[r["doc_id"]][3])
        assert r["n_removed"] or r["kept_text"] == r["text"]


def test_passages_of_odd_texts(spark, awkward):
    docs = [(r["doc_id"], r["doc_id"], r["text"]) for r in awkward.collect()]
    check(substrings.remove_earlier_passages(awkward).collect(), plain(docs, 50))


def test_passages_of_untidy_rows(spark, untidy, nothing):
    clashing = untidy.withColumnsRenamed({"lang": "doc", "source": "original", "score": "n_words"})
    out = substrings.remove_earlier_passages(clashing)
    added = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    assert out.columns == [c for c in clashing.columns if c != "n_words"] + added
    rows = out.collect()
    assert len(rows) == untidy.count()
    assert {r["row"] for r in rows} == {"x", None} and {r["doc"] for r in rows} == {"en", None}
    # Of two equal rows one keeps its text; a document without an id keeps what is its own.
    assert sorted(r["n_removed"] for r in rows if r["doc_id"] == 1) == [0, 200]
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0]
    assert substrings.remove_earlier_passages(nothing).count() == 0


def test_text_beyond_a_block(spark):
    """A text of more than a block of bytes, and its copy inside another one."""
    rng = random.Random(3)
    long_text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(320_000))
    assert len(long_text) > 2 * substrings.TEXT_BYTES
    docs = [(5, 5, "before " + long_text + " after"), (2, 2, long_text), (9, 9, " ".join(long_text.split()[1000:1060]))]
    df = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in substrings.remove_earlier_passages(df).collect()}
    assert found == {2: 0, 5: 320_000, 9: 60}


def test_registered_passages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = plain([(r["doc_id"], r["doc_id"], r["text"]) for r in rows], 50)
    found = QUERIES["op11_prefix_suffix_trees"](spark, sf_dir)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    check(found.collect(), expected)
    assert collections.Counter(x[1] > 0 for x in expected.values())[True]
