"""Vector codes against plain k-means, and the audit of sources against DuckDB."""

import hashlib
import math

import numpy as np
import pytest

from companylens.llm import ballcodes
from companylens.llm.queries import QUERIES


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{vec_id: (code, error)} and the digest, by full searches in Python's whole numbers."""
    kept = sorted(
        (i, [math.floor(x * scale) for x in v])
        for i, v, _ in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    )
    width = len(kept[0][1]) // parts
    x = np.array([v for _, v in kept], object).reshape(len(kept), parts, width)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest(k):
        distance = ((x[:, k][:, None] - books[k][None]) ** 2).sum(-1)
        return distance.argmin(1), distance.min(1)

    for _ in range(rounds):
        found = [nearest(k)[0] for k in range(parts)]
        for k in range(parts):
            for j in range(len(books[k])):
                own = x[found[k] == j, k]
                if len(own):
                    books[k][j] = own.sum(0) // len(own)
    found = [nearest(k) for k in range(parts)]
    codes = {
        i: ("".join(f"{found[k][0][at]:02x}" for k in range(parts)), sum(found[k][1][at] for k in range(parts)))
        for at, (i, _) in enumerate(kept)
    }
    return codes, hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()


def check_codes(rows, found):
    codes, digest = plain_codes(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in found} == codes
    labels = {}
    for i, _, label in rows:
        if i in codes:
            labels[label] = labels.get(label, 0) + codes[i][1]
    label_of = {i: label for i, _, label in rows}
    assert all(r["label_error"] == labels[label_of[r["vec_id"]]] for r in found)
    return digest


def test_registered_codes(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = QUERIES["op12_ball_codes"](spark, sf_dir).collect()
    assert check_codes(rows, found) == found[0]["codebooks_sha256"]


@pytest.mark.parametrize("batch", [32_768, 50])
def test_codes_of_ties_copies_and_bad_vectors(spark, monkeypatch, batch):
    monkeypatch.setattr(ballcodes, "BATCH", batch)
    rng = np.random.default_rng(5)
    points = rng.integers(-3, 4, (700, 8)) / 1024  # a small lattice: many ties, many copies
    rows = [(i, p.tolist(), int(rng.integers(3)) if i % 7 else None) for i, p in enumerate(points)]
    rows += [(-5, [0.1] * 7 + [math.nan], 1), (-4, None, 1), (-3, [0.1] * 7 + [None], 1), (-2, [0.5] * 7 + [math.inf], 2)]
    rows += [(10_000 + i, [0.25] * 8, 9) for i in range(300)]
    schema = "vec_id long, embedding array<float>, label int, code string, v int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    coded, books = ballcodes.ball_codes(df)
    assert check_codes(rows, coded.collect()) == books.sha256()


def test_few_vectors_and_odd_ones(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(2, [1.0, 2.0, 3.0, 4.0, 5.0], "a"), (1, [1.0] * 5, None), (None, [1.0] * 5, None), (1, [1.0] * 5, None), (7, [1.0] * 4, "a")]
    coded, books = ballcodes.ball_codes(spark.createDataFrame(rows, schema))
    out = sorted((r["vec_id"] or 0, r["code"] or "", -1 if r["error"] is None else r["error"]) for r in coded.collect())
    assert [(i, e) for i, _, e in out] == [(0, 0), (1, 0), (1, 0), (2, 0), (7, -1)]
    assert books.entries.shape == (4, 4, 2)
    coded, books = ballcodes.ball_codes(spark.createDataFrame([], schema))
    assert books is None and coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert coded.count() == 0
    coded, _ = ballcodes.ball_codes(spark.createDataFrame([(1, [], "a")], schema))
    assert coded.collect()[0]["error"] == 0
    with pytest.raises(Exception, match="64 bits"):
        ballcodes.ball_codes(spark.createDataFrame([(1, [1e30] * 4, "a")], schema))


def test_balls_leave_candidates_out():
    """The same entries as a full search, with far fewer comparisons where balls lie apart."""
    rng = np.random.default_rng(8)
    entries = rng.integers(-4000, 4000, (64, 6))
    x = entries[rng.integers(0, 64, 3000)] + rng.integers(-300, 300, (3000, 6))
    own, least = ballcodes.full_search(x, entries)
    moved = entries + rng.integers(-40, 40, entries.shape)
    gap = x - moved[own]
    radius = np.zeros(64, np.int64)
    np.maximum.at(radius, own, (gap * gap).sum(1))
    nearest, distance, compared = ballcodes.ball_search(x, moved, own, radius)
    expected = ballcodes.full_search(x, moved)
    assert (nearest == expected[0]).all() and (distance == expected[1]).all()
    assert compared < 0.2 * x.shape[0] * 64
    big = x * (1 << 17)
    assert (ballcodes.full_search(big, entries * (1 << 17))[0] == own).all()


def test_divergence_of_odd_tables(spark, sf_dir):
    """Against DuckDB: nulls, a language without kept terms, chunks that share terms, signs."""
    import duckdb
    from companylens.llm.divergence import source_divergence
    from companylens.llm.oracles import ORACLES

    rows = [("en", f"s{i % 3}", f"The the, THE-end of x{i % 4}y Ünïcödé ß 日本 {'hot ' * (i % 5)}") for i in range(40)]
    rows += [("en", "s0", None), ("en", None, "the end"), (None, None, "the"), (None, "z", ""), ("xx", "a", "few terms")]
    rows += [("xx", "b", ""), ("en", "s1", "?! 12 \t\n"), ("one", "only", "end " * 9)] + [("en", "s2", "copy of it")] * 12
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, item string, v int")
    found = source_divergence(df)
    frame = df.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    cursor = con.execute(ORACLES["op13_source_divergence"])
    assert [c[0] for c in cursor.description] == found.columns
    expected = cursor.fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert any(r[0] == "xx" and r[4] == 0 for r in expected)
    assert source_divergence(df.limit(0)).count() == 0


def test_registered_divergence(spark, sf_dir, monkeypatch):
    """Small blocks and buckets give the same rows, and all of them are DuckDB's."""
    import duckdb
    from companylens.llm import divergence
    from companylens.llm.oracles import ORACLES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    expected = sorted(con.execute(ORACLES["op13_source_divergence"]).fetchall())
    monkeypatch.setattr(divergence, "BLOCK_TEXT", 50_000)
    monkeypatch.setattr(divergence, "BUCKETS", 7)
    monkeypatch.setattr(divergence, "BUCKET_CELLS", 1_000)
    assert sorted(map(tuple, QUERIES["op13_source_divergence"](spark, sf_dir).collect())) == expected
