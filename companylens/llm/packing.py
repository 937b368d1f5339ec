"""Bin packing of document pieces into sequences of fixed capacity.

Only piece lengths matter for packing, and there are at most ``capacity`` of them. The
number of pieces of each length is therefore a complete description of the instance
whose size does not depend on the data; it is all the driver sees. The plan is made on
it in two steps:

1. Martello-Toth dominance reduction. Take the longest length left. If nothing fits
   beside it, it is alone. If one piece fills the sequence exactly, or is at least as
   long as any set of pieces that could take its place, the pair dominates every other
   set holding the longest piece: fix it for good and shrink the instance. Equal pieces
   are fixed together, by count.
2. Best-fit decreasing on what no rule decides: each piece goes to the open sequence with
   the least room that still takes it; equal pieces and equal rooms move by count.

The plan says for each length which ranks among the pieces of that length go to which
run of sequences, at which offset. Pieces get their rank by salted counts, so a length
that many pieces share is never in one task, and are joined with the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from companylens.llm.kernels import blocks, text_bytes
from companylens.llm.tokenise import piece_encoder, vocabulary_path
from companylens.operators.distributed import materialize

CAPACITY = 2048
END_ID = 0

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN_SCHEMA = "length long, low long, high long, sequence_base long, offset long"


class _Lengths:
    """Lengths that are left, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {w: n for w, n in counts.items() if n > 0}
        self.sorted = sorted(self.count)

    def take(self, length: int, times: int) -> None:
        self.count[length] -= times
        if not self.count[length]:
            del self.count[length]
            self.sorted.remove(length)

    def longest_up_to(self, room: int) -> int | None:
        at = bisect.bisect_right(self.sorted, room)
        return self.sorted[at - 1] if at else None

    def two_shortest(self) -> int | None:
        """Sum of the two shortest pieces."""
        if not self.sorted:
            return None
        first = self.sorted[0]
        if self.count[first] > 1:
            return 2 * first
        return first + self.sorted[1] if len(self.sorted) > 1 else None

    def longest_pair(self, room: int) -> int:
        """Largest sum of two pieces that fits into the room, 0 if none does."""
        best, low, high = 0, 0, bisect.bisect_right(self.sorted, room) - 1
        while low <= high:
            total = self.sorted[low] + self.sorted[high]
            if total > room or (low == high and self.count[self.sorted[low]] < 2):
                high -= 1
            else:
                best = max(best, total)
                low += 1
        return best


def reduce_by_dominance(
    counts: dict[int, int], capacity: int
) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences fixed for good as (lengths, times), and the counts that are left."""
    left, fixed, undecided = _Lengths(counts), [], {}
    while left.sorted:
        longest = left.sorted[-1]
        times = left.count[longest]
        room = capacity - longest
        partner = left.longest_up_to(room)
        if partner is None:
            fixed.append(((longest,), times))
            left.take(longest, times)
            continue
        if partner == longest:
            pairs = times // 2
            exact = 2 * longest == capacity
            if pairs and (exact or 3 * left.sorted[0] > capacity):
                fixed.append(((longest, longest), pairs))
                left.take(longest, 2 * pairs)
                continue
        else:
            two = left.two_shortest()
            exact = partner == room
            alone = two is None or two > room
            # Three pieces in the room would need three times the shortest length.
            pair_only = 3 * left.sorted[0] > room and left.longest_pair(room) <= partner
            if exact or alone or pair_only:
                # Counts of the partner or of the longest run out; the rules are then asked anew.
                together = min(times, left.count[partner])
                if not exact and not alone:
                    together = 1 if left.count[partner] < times else together
                fixed.append(((longest, partner), together))
                left.take(longest, together)
                left.take(partner, together)
                continue
        undecided[longest] = undecided.get(longest, 0) + times
        left.take(longest, times)
    return fixed, undecided


def best_fit_decreasing(
    counts: dict[int, int], capacity: int
) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by counts: (lengths, times) of the sequences."""
    rooms: list[int] = []
    bins: dict[int, list[list]] = defaultdict(list)

    def put(pattern: tuple[int, ...], times: int) -> None:
        room = capacity - sum(pattern)
        if room not in bins or not bins[room]:
            bisect.insort(rooms, room)
        bins[room].append([pattern, times])

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(todo, each)
                if full:
                    put((length,) * each, full)
                if rest:
                    put((length,) * rest, 1)
                break
            room = rooms[at]
            pattern, times = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
            moved = min(times, todo)
            if times > moved:
                put(pattern, times - moved)
            put((*pattern, length), moved)
            todo -= moved
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in bins.values():
        for pattern, times in groups:
            merged[pattern] += times
    return list(merged.items())


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Plan rows (length, low, high, sequence_base, offset) for ranks low <= rank < high."""
    fixed, undecided = reduce_by_dominance(counts, capacity)
    rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, times in [*fixed, *best_fit_decreasing(undecided, capacity)]:
        offset = 0
        for length in pattern:
            rows.append((length, rank[length], rank[length] + times, base, offset))
            rank[length] += times
            offset += length
        base += times
    return rows


def cut_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Encode whole texts, append the end id, cut what is longer than the capacity."""
    vocabulary = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc_ids = np.array(batch.column("doc_id").to_pylist(), object)
            for low, high in blocks(offsets):
                part = slice(offsets[low], offsets[high])
                ids, bounds = encoder.encode(data[part], offsets[low : high + 1] - offsets[low])
                rows = []
                for i in range(high - low):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        cut_ids = own[start : start + capacity]
                        rows.append(
                            (doc_ids[low + i], piece, start, len(cut_ids), zlib.crc32(cut_ids.tobytes()))
                        )
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(cut, PIECE_SCHEMA)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with a ``length`` column.

    Full pieces need no partner; they are ranked like the others. Nulls in other columns
    and repeated rows are pieces like any other; a null, empty or too long length raises.
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bad = F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity)
    salted = pieces.withColumn(
        "length", F.when(bad, F.raise_error(F.lit("piece length out of range"))).otherwise(F.col("length"))
    ).withColumn(
        # Not only by document: copies of one document without an id stay spread.
        "__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts))
    )
    # At most capacity x salts rows, by partial counts.
    totals = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    by_length = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_sequences(by_length, capacity), PLAN_SCHEMA)
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(
        "length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("__at", F.row_number().over(inside) - 1).join(
        firsts, ["length", "__salt"]
    )
    place = (F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("high"))
    return (
        ranked.withColumn("__rank", F.col("first") + F.col("__at"))
        # The plan has a few thousand rows at most: it is made of lengths, not of pieces.
        .join(F.broadcast(plan.withColumnRenamed("length", "__length")), (F.col("length") == F.col("__length")) & place)
        .withColumn("sequence_id", F.col("sequence_base") + F.col("__rank") - F.col("low"))
        .drop("__salt", "__at", "first", "__rank", "__length", "low", "high", "sequence_base")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    A null text is empty (its piece is the end id alone); a null doc_id is a document of
    its own; other columns are ignored; an empty table gives an empty result.
    """
    pieces = materialize(cut_pieces(docs, capacity), "pieces")
    return pack(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
