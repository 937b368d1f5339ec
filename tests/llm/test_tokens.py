"""Token ids: records, index, pieces and packing."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from companylens.llm.kernels import blocks, text_bytes
from companylens.llm.packing import best_fit_decreasing, pack_documents, plan_sequences, reduce_by_dominance
from companylens.llm.queries import QUERIES
from companylens.llm.records import build_index, encode_corpus, frame, read_records, token_starts, write_records
from companylens.llm.tokenise import piece_encoder, vocabulary_path
from companylens.operators.distributed import fresh_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.none(), min_size=1, max_size=6))
def test_pieces_encode_like_whole_texts(texts):
    library = Tokenizer.from_file(vocabulary_path())
    clean = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    data, offsets = text_bytes(pa.array(clean, pa.string()))
    ids, bounds = piece_encoder(vocabulary_path()).encode(data, offsets)
    found = [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(clean))]
    assert found == [ids_of(library, t) for t in clean]


def test_blocks_cover_all_rows_once():
    offsets = np.array([0, 5, 5, 400, 401, 402])
    assert [*blocks(offsets, 10)] == [(0, 2), (2, 3), (3, 5)]


def expected_records(library, docs):
    out, start = {}, 0
    for i, t in sorted(docs, key=lambda x: x[0]):
        ids = [*ids_of(library, t), 1]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_records_round_trip(spark, awkward, library):
    rows = encode_corpus(awkward).collect()
    docs = [tuple(r) for r in awkward.collect()]
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == expected_records(library, docs)


def test_index_points_at_records(spark, awkward, library):
    path = fresh_path(spark, "records")
    write_records(awkward, path, partitions=3)
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    files = {
        r["path"].rsplit("/", 1)[-1]: bytes(r["content"])
        for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    }
    index = sorted(token_starts(build_index(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in index] == sorted(texts)
    for r in index:
        one = files[r["file"]][r["offset"] : r["offset"] + r["length"]] + b"\n"
        ((_, _, doc_id, ids),) = read_records(one)
        assert doc_id == r["doc_id"]
        assert ids.tolist() == [*ids_of(library, texts[doc_id]), 1]


@pytest.mark.parametrize("at", [0, 9, 14, 30])
def test_damage_is_found(at):
    record = bytearray(frame(7, np.arange(20), 2) + b"\n")
    record[at] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(read_records(bytes(record)))


def test_records_of_untidy_rows(spark, untidy, nothing):
    assert encode_corpus(nothing).count() == 0
    rows = encode_corpus(untidy).collect()
    assert len(rows) == untidy.count()
    # Records without an id are the first ones.
    assert [r["start"] == 0 for r in rows if r["doc_id"] is None] == [True]
    assert sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
    with pytest.raises(Exception, match="doc_id is reserved"):
        encode_corpus(untidy.selectExpr("-9223372036854775807L - 1 AS doc_id", "text")).count()


def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_untidy_rows(spark, untidy, nothing, library):
    rows = pack_documents(untidy, 64).collect()
    used = check_packing(rows, 64)
    assert used <= 1.02 * math.ceil(sum(r["length"] for r in rows) / 64) + 1
    by_doc = {}
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 1:
            by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in ((r["doc_id"], r["text"]) for r in untidy.collect() if r["doc_id"] not in (None, 1)):
        ids = np.array([*ids_of(library, text), 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["start"] for p in pieces] == list(range(0, len(ids), 64))
        assert [p["ids_crc32"] for p in pieces] == [
            zlib.crc32(ids[s : s + 64].tobytes()) for s in range(0, len(ids), 64)
        ]
    assert pack_documents(nothing).count() == 0


def optimum(lengths, capacity):
    """Fewest sequences, by trying all ways."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in {room: i for i, room in enumerate(rooms) if room >= lengths[k]}.values():
            place(k + 1, [r - lengths[k] if j == i else r for j, r in enumerate(rooms)])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    own = random.Random(5)
    for _ in range(60):
        lengths = [own.randint(1, 20) for _ in range(9)]
        counts = {x: lengths.count(x) for x in lengths}
        fixed, left = reduce_by_dominance(counts, 20)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (optimum(rest, 20) if rest else 0) == optimum(lengths, 20)


def test_plan_places_every_piece_once():
    own = random.Random(6)
    counts = {x: own.randint(0, 500) for x in range(1, 129)}
    places = {}
    for length, low, high, base, offset in plan_sequences(counts, 128):
        for rank in range(low, high):
            assert (length, rank) not in places
            places[length, rank] = (base + rank - low, offset)
    assert len(places) == sum(counts.values())
    used = check_packing(
        [{"sequence_id": s, "offset": o, "length": w} for (w, _), (s, o) in places.items()], 128
    )
    assert used <= 1.03 * math.ceil(sum(w * n for w, n in counts.items()) / 128) + 1
    assert sum(n for _, n in best_fit_decreasing({3: 7}, 10)) == 3


def test_registered_queries(spark, sf_dir, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op5_token_records"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == expected_records(library, docs)
    rows = QUERIES["op10_best_fit_packing"](spark, sf_dir).collect()
    used = check_packing(rows, 2048)
    assert used <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1
    assert {r["doc_id"] for r in rows} == {i for i, _ in docs}
