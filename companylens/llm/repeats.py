"""Removal of byte strings that repeat anywhere in a corpus, by bucketed suffix arrays.

A position is a copy if the string of ``length`` bytes that starts there also starts at
another position, in the same text or another. In the suffix array such positions are
neighbours whose longest common prefix reaches ``length``. The longest-previous-factor
array says which of them have an earlier match: its value comes from the previous and the
next smaller text position in suffix order. Mirrored, it says which have a later one.

One suffix array over all bytes can't be built on one machine, and most suffixes match
nothing. Suffixes are therefore put into buckets that hold all their possible matches:

1. Every window of ``length`` bytes has an anchor, its least hashed ``ANCHOR``-gram. Equal
   windows have equal anchors at equal offsets. Consecutive windows with one anchor
   make a run; a run is one row with the hash of its anchor and the hash of its bytes.
2. Anchors that occur once have no matches. Runs whose bytes occur again are copies as a
   whole and one of them speaks for all; counts and minima are partial sums, so groups of
   copies of any size are no burden to one task.
3. What is left are runs with the same anchor and different bytes: where copied passages
   begin and end. Their suffixes are sorted, bucket by bucket, by prefix doubling up to
   ``length`` bytes. In an order in which equal prefixes stand by text position, a suffix has
   a previous factor of ``length`` bytes exactly if its predecessor has the same rank (the
   predecessor is then its previous smaller position), and a next factor exactly if its
   successor has.
4. A bucket with more than ``BUCKET_RUNS`` different runs is not gathered: its windows are
   counted by hash instead, with partial sums, to the same result.

Rows without problems are addressed by doc_id. If ids are null or repeated, rows get ids of
their own in a stored copy first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.llm.kernels import blocks, prefix_sums, ragged, span_hashes, text_bytes
from companylens.llm.rows import ROW, WHOLE, with_rows, with_whole_rows
from companylens.operators.distributed import materialize

LENGTH = 200
ANCHOR = 48
BUCKET_RUNS = 2_000
# Bytes of suffixes that are sorted together in a task; whole buckets, so it may be passed.
SORT_BYTES = 1 << 20

# Bytes of text whose positions are hashed at once.
RUN_BYTES = 1 << 20

RUN_SCHEMA = "anchor long, run long, row long, low int, high int"
SEGMENT_SCHEMA = "anchor long, variants long, row long, low int, segment binary"
SPAN_SCHEMA = "row long, low int, high int"


def anchored_runs(
    data: np.ndarray, offsets: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor hash and byte hash of each run of a block."""
    size = min(ANCHOR, length)
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix_sums(data)
    grams = np.arange(n - size + 1)
    hashes = span_hashes(sums, grams, grams + size)
    # The position in the low bits breaks ties to the left, alike in every copy.
    bits = np.uint64(n.bit_length())
    keys = (hashes >> bits << bits) | grams.astype(np.uint64)
    width = length - size + 1
    fill = np.full(-len(keys) % width, ~np.uint64(0))
    table = np.concatenate((keys, fill)).reshape(-1, width)
    from_left = np.minimum.accumulate(table, axis=1).ravel()
    from_right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(from_right[: len(keys) - width + 1], from_left[width - 1 : len(keys)])
    anchors = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)

    end_of = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(anchors)) + length <= end_of[: len(anchors)])
    if not len(starts):
        return starts, starts, starts.view(np.uint64), starts.view(np.uint64)
    own = anchors[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    low, high = starts[first], starts[last]
    return low, high, hashes[own[first]], span_hashes(sums, low, high + length)


def window_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each position, by prefix doubling.

    Positions closer than ``length`` to the end have ranks without a meaning.
    """
    n = len(data)
    words = np.zeros(n, np.int64)
    padded = np.concatenate((data, np.zeros(1, np.uint8)))
    words[:] = padded[:n]
    done = 1
    ranks = words
    while done < length:
        step = min(done, length - done)
        second = np.zeros(n, np.int64)
        second[: n - step] = ranks[step:]
        pairs = ranks * (int(ranks.max(initial=0)) + 1) + second
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        done += step
    return ranks


def _runs_of(docs: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("row").to_numpy(zero_copy_only=False)
            for begin, end in blocks(offsets, RUN_BYTES):
                at = offsets[begin : end + 1] - offsets[begin]
                low, high, anchor, run = anchored_runs(data[offsets[begin] : offsets[end]], at, length)
                text = np.searchsorted(at, low, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(run.view(np.int64)),
                        pa.array(ids[begin + text]),
                        pa.array((low - at[text]).astype(np.int32)),
                        pa.array((high - at[text]).astype(np.int32)),
                    ],
                    ["anchor", "run", "row", "low", "high"],
                )

    return docs.mapInArrow(find, RUN_SCHEMA)


def _segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted runs (anchor, variants, row, low, high)."""
    parts = wanted.groupBy("row").agg(
        F.collect_list(F.struct("anchor", "variants", "low", "high")).alias("parts")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            lists = batch.column("parts")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(rows)), sizes)
            low = flat.field("low").to_numpy(zero_copy_only=False).astype(np.int64)
            high = flat.field("high").to_numpy(zero_copy_only=False).astype(np.int64)
            for begin in range(0, len(owner), 10_000):
                part = slice(begin, begin + 10_000)
                widths = high[part] - low[part] + length
                taken = data[ragged(offsets[owner[part]] + low[part], widths)]
                ends = np.concatenate(([0], np.cumsum(widths))).astype(np.int32)
                segments = pa.Array.from_buffers(
                    pa.binary(), len(widths), [None, pa.py_buffer(ends), pa.py_buffer(taken)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("anchor")[part],
                        flat.field("variants")[part],
                        pa.array(rows[owner[part]]),
                        flat.field("low")[part],
                        segments,
                    ],
                    ["anchor", "variants", "row", "low", "segment"],
                )

    joined = docs.join(parts, "row").select("row", "text", "parts")
    return joined.mapInArrow(cut, SEGMENT_SCHEMA)


def _windows(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of a block of segments, and the segment of each."""
    count = np.diff(offsets) - length + 1
    return ragged(offsets[:-1], count), np.repeat(np.arange(len(count)), count)


def _spans(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Ranges of consecutive window starts."""
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows)) - 1
    else:
        first = last = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rows[first], pa.int64()),
            pa.array(starts[first].astype(np.int32)),
            pa.array(starts[last].astype(np.int32)),
        ],
        ["row", "low", "high"],
    )


def _matches_by_suffix_order(segments: DataFrame, length: int, earlier_only: bool) -> DataFrame:
    """Window ranges with a match in their bucket; buckets are whole and sorted by anchor."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("segment"))
        anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
        row = batch.column("row").to_numpy(zero_copy_only=False)
        low = batch.column("low").to_numpy(zero_copy_only=False).astype(np.int64)
        starts, owner = _windows(offsets, length)
        ranks = window_ranks(data, length)[starts]
        places = low[owner] + starts - offsets[owner]
        # Suffix order; equal prefixes by text position. Only equal prefixes matter here, and
        # they have the same anchor.
        order = np.lexsort((places, row[owner], ranks))
        ranked = ranks[order]
        same = (ranked[1:] == ranked[:-1]) & (
            anchor[owner][order][1:] == anchor[owner][order][:-1]
        )
        has_previous = np.zeros(len(order), bool)
        has_next = np.zeros(len(order), bool)
        has_previous[1:] = same
        has_next[:-1] = same
        found = np.zeros(len(order), bool)
        found[order] = has_previous if earlier_only else has_previous | has_next
        return _spans(row[owner][found], places[found])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            begin = 0
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if kept and kept[-1].column("anchor")[-1].as_py() != anchor[0]:
                turns = np.concatenate(([0], turns))
            at = np.concatenate(([0], np.cumsum(np.diff(text_bytes(batch.column("segment"))[1]))))
            for turn in turns:
                if size + at[turn] - at[begin] >= SORT_BYTES:
                    kept.append(batch.slice(begin, turn - begin))
                    yield solve(_joined(kept))
                    kept, size, begin = [], 0, turn
            kept.append(batch.slice(begin))
            size += at[-1] - at[begin]
        if kept:
            yield solve(_joined(kept))

    partitions = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        segments.repartition(partitions, "anchor")
        .sortWithinPartitions("anchor", "row", "low")
        .mapInArrow(sort, SPAN_SCHEMA)
    )


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _matches_by_count(segments: DataFrame, length: int, earlier_only: bool) -> DataFrame:
    """The same for the windows of crowded buckets, by counts of window hashes."""

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("segment"))
            row = batch.column("row").to_numpy(zero_copy_only=False)
            low = batch.column("low").to_numpy(zero_copy_only=False).astype(np.int64)
            for begin, end in blocks(offsets, RUN_BYTES):
                at = offsets[begin : end + 1] - offsets[begin]
                starts, owner = _windows(at, length)
                sums = prefix_sums(data[offsets[begin] : offsets[end]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(span_hashes(sums, starts, starts + length).view(np.int64)),
                        pa.array(row[begin + owner]),
                        pa.array((low[begin + owner] + starts - at[owner]).astype(np.int32)),
                    ],
                    ["window", "row", "low"],
                )

    windows = segments.mapInArrow(hash_windows, "window long, row long, low int")
    counted = windows.groupBy("window").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "low")).alias("first")
    )
    return _but_firsts(windows.withColumn("high", F.col("low")), counted, earlier_only)


def _but_firsts(members: DataFrame, classes: DataFrame, earlier_only: bool) -> DataFrame:
    """(row, low, high) of members that have a match, or one that is earlier, in their class.

    Those without are the first of each class, or of each class of one. They are taken away by
    (row, low), which no two members share: sums by that key are spread evenly, however many
    members a class has.
    """
    without = classes if earlier_only else classes.where("n = 1")
    marks = without.select("first.row", "first.low", F.lit(None).cast("int").alias("high"))
    marked = members.select("row", "low", "high").unionAll(marks).groupBy("row", "low")
    # A mark adds a second row to the key of its member.
    return marked.agg(F.count("*").alias("rows"), F.max("high").alias("high")).where("rows = 1").drop("rows")


def repeated_windows(docs: DataFrame, length: int = LENGTH, earlier_only: bool = False) -> DataFrame:
    """(row, low, high): ranges of window starts that have a match, or an earlier match.

    ``docs`` has a unique ``row`` and a ``text``. Ranges of a row may touch or overlap.
    """
    runs = materialize(_runs_of(docs, length), "runs")
    # Stored, so that the join below has plain shuffles on both sides and splits hot anchors.
    shared = materialize(
        runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"),
        "shared-anchors",
    )
    candidates = materialize(runs.join(shared, "anchor"), "candidate-runs")
    classes = materialize(
        candidates.groupBy("anchor", "run").agg(
            F.count("*").alias("n"), F.min(F.struct("row", "low", "high")).alias("first")
        ),
        "run-classes",
    )
    copies = _but_firsts(candidates, classes, earlier_only)
    variants = classes.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1")
    wanted = classes.join(variants, "anchor").select("anchor", "variants", "first.*")
    segments = materialize(_segments(docs, wanted, length), "segments")
    few = segments.where(F.col("variants") <= BUCKET_RUNS)
    many = segments.where(F.col("variants") > BUCKET_RUNS)
    return (
        copies.select("row", "low", "high")
        .unionAll(_matches_by_suffix_order(few, length, earlier_only))
        .unionAll(_matches_by_count(many, length, earlier_only))
    )


def _removed_spans(ranges, n_bytes: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by windows that start in the ranges."""
    spans: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        end = min(high + length, n_bytes)
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((low, end))
    return spans


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans cut down to whole UTF-8 characters."""
    out = []
    for low, high in spans:
        while low < high and text[low] & 0xC0 == 0x80:
            low += 1
        while low < high < len(text) and text[high] & 0xC0 == 0x80:
            high -= 1
        if low < high:
            out.append((low, high))
    return out


CUT_SCHEMA = (
    "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "spans array<struct<low: long, high: long>>, kept_text string"
)
_ARROW_CUT = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
        ("kept_text", pa.string()),
    ]
)


def cut_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    keep_first: bool = True,
    whole_characters: bool = True,
    with_text: bool = True,
) -> DataFrame:
    """CUT_SCHEMA for every row of ``docs``, which has ROW, doc_id and text."""
    texts = docs.select(
        F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    ranges = repeated_windows(texts.select("row", "text"), length, earlier_only=keep_first)
    per_row = ranges.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def cut_one(row, doc_id, text, ranges) -> dict:
        raw = (text or "").encode("utf-8", "surrogatepass")
        spans = _removed_spans(((x["low"], x["high"]) for x in ranges or ()), len(raw), length)
        if whole_characters:
            spans = _whole_characters(raw, spans)
        kept, at = [], 0
        for low, high in spans:
            kept.append(raw[at:low])
            at = high
        rest = b"".join([*kept, raw[at:]])
        return {
            "row": row,
            "doc_id": doc_id,
            "n_bytes": len(raw),
            "n_removed": len(raw) - len(rest),
            "n_spans": len(spans),
            "kept_sha256": hashlib.sha256(rest).hexdigest(),
            "spans": [{"low": a, "high": b} for a, b in spans],
            "kept_text": rest.decode("utf-8", "replace") if with_text and text is not None else None,
        }

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1_000):
                part = batch.slice(begin, 1_000)
                columns = [part.column(c).to_pylist() for c in ("row", "doc_id", "text", "ranges")]
                out = [cut_one(*values) for values in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW_CUT)

    joined = texts.join(per_row, "row", "left").select("row", "doc_id", "text", "ranges")
    return joined.mapInArrow(cut, CUT_SCHEMA)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, keep_first: bool = True, whole_characters: bool = True
) -> DataFrame:
    """The columns of ``docs`` with what was removed from each text, and what is kept.

    keep_first    a string that stands several times stays where it stands first, in the
                  order of doc_id and position (of stored rows, if doc_id is no key);
                  otherwise all its copies go.
    whole_characters  never cut inside a UTF-8 character. Without it ``kept_text`` may hold
                  broken characters; ``kept_sha256`` is over the exact bytes either way.

    Added: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans,
    kept_text. Columns of ``docs`` with these names are replaced. A null text counts as
    empty in the numbers and stays null in kept_text. Rows with null or repeated doc_id
    are rows of their own, and copies of each other. An empty table stays empty.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"]
    docs = with_whole_rows(docs.drop(*added))
    results = cut_repeats(docs, length, keep_first, whole_characters).withColumnRenamed("row", ROW)
    return docs.select(ROW, WHOLE).join(results.select(ROW, *added), ROW).select(f"{WHOLE}.*", *added)


def cut_later_copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with texts that lack every copied passage but its first; same columns.

    ``n_chars``, if there is such a column, is set to the new length where a text changed.
    No row goes, not even if nothing of its text is left.
    """
    keyed = with_whole_rows(docs)
    results = cut_repeats(keyed, length).select(F.col("row").alias(ROW), "n_removed", "kept_text")
    cut = keyed.select(ROW, WHOLE).join(results, ROW)

    def column(name: str):
        old, kind = F.col(WHOLE)[name], docs.schema[name].dataType
        if name == "text":
            return F.col("kept_text").alias(name)
        if name == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(old).alias(name)
        return old.alias(name)

    return cut.select([column(name) for name in docs.columns])


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of 200 bytes that stands twice goes, all its copies alike."""
    docs = with_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = cut_repeats(docs, keep_first=False, whole_characters=False, with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
