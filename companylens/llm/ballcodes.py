"""Product codes of vectors, with codebooks from ball k-means in whole numbers.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook of its own. An entry with its parts is a ball: its radius is the distance of the
furthest part. For a part x of the entry c, another entry e can only be as near if
|c - e| <= 2 |x - c|. From that follow, with all comparisons on exact squared integers:

* neighbours: entries within twice the radius of a ball; no part of it can go elsewhere;
* stable core: a part nearer to its entry than half the way to the next neighbour stays
  where it is, without a look at any other entry;
* annular rings: with neighbours in order of distance, a part's own distance says how many
  of them can be as near as its entry; only these candidates are compared exactly.

Radii are taken round by round, around the entries that the parts were assigned to. When an
entry moves, its radius grows by that step at most, which is the bound for the next round.
A round is one pass over the stored vectors and a sum per part and entry; only these sums, of
a size that the data doesn't change, reach the driver. Every round is written, so that a lost
executor repeats its own files only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.operators.distributed import delete_path, fresh_path, join_by_key

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Vectors that a task holds at once, and distances of a full search that it holds at once.
BATCH = 32_768
CELLS = 1 << 21

VECTOR_SCHEMA = "vec_id long, label {label}, v array<int>"
CODED_SCHEMA = VECTOR_SCHEMA + ", code binary, squared array<long>"
_NO_BALL = np.iinfo(np.int64).max


@dataclass
class Codebooks:
    """Entries by part (parts x entries x width), and a bound of each ball's squared radius."""

    entries: np.ndarray
    radius: np.ndarray | None = None

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances of integer rows, exactly."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * largest) ** 2 < 1 << 53:  # whole numbers that doubles hold exactly
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        out = (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (x @ entries.T)
        return out.astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        gap = x - entry
        out[:, j] = (gap * gap).sum(1)
    return out


def full_search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, the lower index on ties, and the squared distance."""
    nearest = np.zeros(len(x), np.int64)
    least = np.zeros(len(x), np.int64)
    step = max(1, CELLS // max(1, len(entries)))
    for begin in range(0, len(x), step):
        distance = squared_distances(x[begin : begin + step], entries)
        best = distance.argmin(1)
        nearest[begin : begin + step] = best
        least[begin : begin + step] = distance[np.arange(len(best)), best]
    return nearest, least


def ball_search(
    x: np.ndarray, entries: np.ndarray, own: np.ndarray, radius: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the entry that each row had; also the number of compared candidates.

    ``radius`` bounds the squared distance of the rows of each entry.
    """
    gap = x - entries[own]
    least = (gap * gap).sum(1)
    nearest = own.copy()
    between = squared_distances(entries, entries)
    np.fill_diagonal(between, _NO_BALL)
    reach = between.min(1, initial=_NO_BALL)
    # Written as ceil(between / 4), so that nothing is multiplied beyond 64 bits.
    active = np.flatnonzero(least >= -(-reach[own] // 4))
    active = active[np.lexsort((least[active], own[active]))]
    compared = 0
    if not len(active):
        return nearest, least, compared
    starts = np.flatnonzero(np.append(True, own[active][1:] != own[active][:-1]))
    for begin, end in zip(starts, [*starts[1:], len(active)], strict=True):
        entry = own[active[begin]]
        quarter = -(-between[entry] // 4)
        neighbours = np.flatnonzero((quarter <= radius[entry]) & (between[entry] < _NO_BALL))
        neighbours = neighbours[np.argsort(quarter[neighbours], kind="stable")]
        ring = np.searchsorted(quarter[neighbours], least[active[begin:end]], side="right")
        # Rows come by distance; those whose rings differ by less than half share a comparison.
        low = begin
        while low < end:
            high = begin + int(np.searchsorted(ring, 2 * ring[low - begin], side="right"))
            high = min(max(high, low + 1), end, low + max(1, CELLS // max(1, len(neighbours) + 1)))
            candidates = np.sort(np.append(neighbours[: ring[high - begin - 1]], entry))
            rows = active[low:high]
            distance = squared_distances(x[rows], entries[candidates])
            best = distance.argmin(1)
            nearest[rows] = candidates[best]
            least[rows] = distance[np.arange(len(rows)), best]
            compared += distance.size
            low = high
    return nearest, least, compared


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """VECTOR_SCHEMA of (vec_id, label, embedding): floor(scale * x), without invalid vectors."""

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("embedding").is_valid())
            lists = batch.column("embedding")
            values = lists.flatten()
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
            numbers = values.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
            bad = np.append(0, np.cumsum(~np.isfinite(numbers)))
            good = bad[ends[1:]] == bad[ends[:-1]]
            keep = np.repeat(good, np.diff(ends))
            whole = np.floor(scale * numbers[keep])
            longest = int(np.diff(ends).max(initial=0))
            if longest and 4 * longest * int(np.abs(whole).max(initial=0)) ** 2 >= 1 << 62:
                raise ValueError("Squared distances of these vectors don't fit in 64 bits.")
            sizes = np.append(0, np.cumsum(np.diff(ends)[good])).astype(np.int32)
            kept = batch.filter(pa.array(good))
            v = pa.ListArray.from_arrays(pa.array(sizes), pa.array(whole.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [kept.column("vec_id"), kept.column("label"), v], ["vec_id", "label", "v"]
            )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(floor, VECTOR_SCHEMA.format(label=label))


def _cut(lists: pa.Array, parts: int) -> np.ndarray:
    """Vectors of one length as rows x parts x width, with zeros up to a multiple of parts."""
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(flat) // n if n else 0
    width = max(1, -(-size // parts))
    out = np.zeros((n, parts * width), np.int64)
    out[:, :size] = flat.reshape(n, size)
    return out.reshape(n, parts, width)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of BATCH rows or more, but for the last."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, rows = [], 0
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def assigned(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """CODED_SCHEMA: every part's nearest entry; from the codes that are there, by balls."""
    parts = len(books.entries)
    known = "code" in vectors.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _collected(batches):
            x = _cut(batch.column("v"), parts)
            code = np.zeros((len(x), parts), np.uint8)
            squared = np.zeros((len(x), parts), np.int64)
            if known:
                raw = b"".join(batch.column("code").to_pylist())
                before = np.frombuffer(raw, np.uint8).reshape(-1, parts).astype(np.int64)
            for k in range(parts):
                part = np.ascontiguousarray(x[:, k])
                if known:
                    best, squared[:, k], _ = ball_search(
                        part, books.entries[k], before[:, k], books.radius[k]
                    )
                else:
                    best, squared[:, k] = full_search(part, books.entries[k])
                code[:, k] = best
            ends = np.arange(len(x) + 1, dtype=np.int32) * parts
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    batch.column("v"),
                    pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(code)]),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(squared.ravel())),
                ],
                ["vec_id", "label", "v", "code", "squared"],
            )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(assign, CODED_SCHEMA.format(label=label))


def moved(coded: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at the floored mean of their parts; one without parts stays where it is."""
    parts, entries, width = books.entries.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        radius = np.zeros((parts, entries), np.int64)
        for batch in _collected(batches):
            x = _cut(batch.column("v"), parts)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            squared = batch.column("squared").flatten().to_numpy().reshape(-1, parts)
            for k in range(parts):
                order = np.argsort(code[:, k], kind="stable")
                own = code[order, k].astype(np.int64)
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                names = own[first]
                sums[k, names] += np.add.reduceat(x[order, k], first, axis=0)
                count[k] += np.bincount(own, minlength=entries)
                radius[k, names] = np.maximum(radius[k, names], np.maximum.reduceat(squared[order, k], first))
        used = np.flatnonzero(count.ravel())
        ends = np.arange(len(used) + 1, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)),
                pa.array(count.ravel()[used]),
                pa.array(radius.ravel()[used]),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.reshape(-1, width)[used].ravel())),
            ],
            ["entry", "n", "radius", "sums"],
        )

    found = coded.mapInArrow(partial, "entry int, n long, radius long, sums array<long>")
    # parts x entries x width rows, whatever the number of vectors.
    rows = (
        found.select("entry", "n", "radius", F.posexplode("sums").alias("at", "total"))
        .groupBy("entry", "at")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("radius").alias("radius"))
        .collect()
    )
    new = books.entries.reshape(-1, width).copy()
    radius = np.zeros(parts * entries, np.int64)
    for r in rows:
        new[r["entry"], r["at"]] = r["total"] // r["n"]
        radius[r["entry"]] = r["radius"]
    gap = new - books.entries.reshape(-1, width)
    step = np.sqrt((gap * gap).sum(1).astype(np.float64))
    # Rounded up by more than the error of the roots.
    bound = np.ceil((np.sqrt(radius.astype(np.float64)) + step) ** 2 * (1 + 1e-9) + 1).astype(np.int64)
    return Codebooks(new.reshape(books.entries.shape), bound.reshape(parts, entries))


def ball_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, code, error, label, label_error) of ``vectors``, and the codebooks.

    ``vectors`` has vec_id, embedding and label; other columns are ignored. Vectors that are
    null or hold null or non-finite components are dropped. Codebooks start as the parts of
    the ``entries`` smallest vec_ids (null ids last, repeated ones in the order of their
    components); with fewer vectors they are smaller. A length that ``parts`` does not divide is filled
    up with zeros. A vector that is not as long as that of the smallest vec_id has no code
    and no error. Repeated rows stay. Without vectors there are no codebooks (None) and no
    rows. ``label_error`` adds up over equal labels, nulls together. Components so large that
    squared distances pass 64 bits are an error, not a wrong result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("A code has one byte for each part, so 1 to 256 entries.")
    spark = vectors.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = fresh_path(spark, "vectors")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    every, every_path = stored(integer_vectors(plain, scale))
    by_id = [F.asc_nulls_last("vec_id"), F.col("v")]
    first = every.orderBy(*by_id).limit(1).select("v").collect()
    length = len(first[0]["v"]) if first else 0
    current, path = every.where(F.size("v") == length), None
    books = None
    if first:
        seeds = current.orderBy(*by_id).limit(entries).select("v").toArrow()
        cut = _cut(seeds.column("v").combine_chunks(), parts)
        books = Codebooks(cut.transpose(1, 0, 2).copy())
        for _ in range(rounds):
            coded, next_path = stored(assigned(current, books))
            if path:
                delete_path(spark, path)
            current, path = coded, next_path
            books = moved(current, books)
        coded, next_path = stored(assigned(current, books))
        if path:
            delete_path(spark, path)
        current = coded
    else:
        current = current.withColumn("code", F.lit(None).cast("binary")).withColumn(
            "squared", F.lit(None).cast("array<long>")
        )
    error = F.aggregate("squared", F.lit(0).cast("long"), lambda a, b: a + b)
    found = current.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), error.alias("error"))
    odd = every.where(F.size("v") != length).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    found = found.unionAll(odd)
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return join_by_key(found, totals, ["label"], "n", ["vec_id"]), books


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = ball_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.lit(books.sha256() if books else None).cast("string")
    return coded.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
