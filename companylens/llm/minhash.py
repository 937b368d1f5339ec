"""Near-duplicate groups by MinHash with tensored banding, with exact confirmation.

Plain banding with tables of 2h hashes needs hundreds of tables for a sure find, each with
its own hashes. Here each text has two small collections of ``m`` pieces, a piece being h
minhashes; a table key is a pair of one piece from either. That makes m*m tables out of
2*m*h minhashes, about a square root of the m*m*2h that separate tables would need. Two
texts share a key exactly if they share a piece in both collections. ``m`` follows from the
threshold so that a pair at the threshold is missed with a chance below ``MISS`` a side.

1. Equal shingle sets are folded into their smallest document by digest.
2. Pieces that only one text has are dropped; pairs of the rest are the table keys.
3. A bucket links each member to its smallest member: rows, not pairs. Each text is first
   compared with the one such centre that it shares most tables with; most groups are
   connected by that.
4. Only buckets that still hold several components are left. Texts that such buckets connect
   form clusters. A cluster is compared in blocks of ``BLOCK`` texts: a task gets two blocks and
   finds all their common counts by products of incidence matrices. It returns which
   components it found linked, never pairs. So no link is lost, a task's memory is bounded,
   and what is written stays in proportion to the texts.

Every link is confirmed on full sets of shingles of the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.llm.components import connected_components
from companylens.llm.kernels import blocks, mix, text_bytes
from companylens.llm.rows import ROW, WHOLE, with_whole_rows
from companylens.llm.shingles import WORDS, common_counts, shingle_sets
from companylens.operators.distributed import materialize

HALF = 3
MISS = 1e-6
# Texts in a block of a cluster, and cells of an incidence matrix, that a task holds at once.
BLOCK = 512
MATRIX_CELLS = 8 << 20

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, digest_a long, digest_b long, minhash array<int>"


def pieces_for(percent: int) -> int:
    """Pieces of one collection so that a pair at the threshold is missed with MISS at most."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** HALF))


def signatures(docs: DataFrame, pieces: int, words: int = WORDS) -> DataFrame:
    """Set size, set digests and 2 * pieces * HALF minhashes of every whole text.

    Texts without words have size 0 and no minhashes.
    """
    seeds = np.random.default_rng(20_240_601).integers(1, 1 << 63, 2 * pieces * HALF, np.uint64)
    seeds = seeds * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for low, high in blocks(offsets):
                part = data[offsets[low] : offsets[high]]
                rows, values = shingle_sets(part, offsets[low : high + 1] - offsets[low], words)
                n = high - low
                size = np.bincount(rows, minlength=n)
                has = np.flatnonzero(size)
                at = (np.cumsum(size) - size)[has]
                minima = np.zeros((len(has), len(seeds)), np.uint32)
                digests = np.zeros((2, n), np.uint64)
                if len(has):
                    for k, seed in enumerate(seeds):
                        least = np.minimum.reduceat(values * seed, at)
                        minima[:, k] = least >> np.uint64(32)
                    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                        digests[k, has] = np.add.reduceat(mix(values ^ np.uint64(salt)), at)
                ends = np.zeros(n + 1, np.int32)
                ends[1:] = np.cumsum(np.where(size > 0, len(seeds), 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, n),
                        pa.array(size.astype(np.int64)),
                        pa.array(digests[0].view(np.int64)),
                        pa.array(digests[1].view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(ends), pa.array(minima.reshape(-1).view(np.int32))
                        ),
                    ],
                    ["doc_id", "n_shingles", "digest_a", "digest_b", "minhash"],
                )

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(sign, SIGNATURE_SCHEMA)


def tensored_buckets(texts: DataFrame, pieces: int) -> DataFrame:
    """(bucket, doc_id, n_shingles, center) of the table keys that several texts share."""
    half_keys = F.transform(
        F.sequence(F.lit(0), F.lit(2 * pieces - 1)),
        lambda k: F.struct(
            (k < pieces).alias("left"),
            F.xxhash64(k, F.slice("minhash", k * HALF + 1, HALF)).alias("half"),
        ),
    )
    halves = texts.select("doc_id", "n_shingles", F.inline(half_keys))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    per_text = (
        halves.join(shared, "half")
        .groupBy("doc_id", "n_shingles")
        .agg(
            F.collect_list(F.when(F.col("left"), F.col("half"))).alias("lefts"),
            F.collect_list(F.when(~F.col("left"), F.col("half"))).alias("rights"),
        )
        .where((F.size("lefts") > 0) & (F.size("rights") > 0))
    )
    keys = materialize(
        per_text.select("doc_id", "n_shingles", "rights", F.explode("lefts").alias("l"))
        .select("doc_id", "n_shingles", "l", F.explode("rights").alias("r"))
        .select("doc_id", "n_shingles", F.xxhash64("l", "r").alias("bucket")),
        "tensored-keys",
    )
    centers = (
        keys.groupBy("bucket")
        .agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("__last"))
        .where(F.col("center") != F.col("__last"))
        .drop("__last")
    )
    return keys.join(centers, "bucket")


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, left_at = text_bytes(batch.column("text_a"))
            right, right_at = text_bytes(batch.column("text_b"))
            for low, high in blocks(left_at + right_at):
                n = high - low
                one = shingle_sets(
                    left[left_at[low] : left_at[high]], left_at[low : high + 1] - left_at[low], words
                )
                two = shingle_sets(
                    right[right_at[low] : right_at[high]],
                    right_at[low : high + 1] - right_at[low],
                    words,
                )
                common = common_counts(one, two, n)
                union = np.bincount(one[0], minlength=n) + np.bincount(two[0], minlength=n) - common
                ok = pa.array((100 * common >= percent * union) & (common > 0))
                part = batch.select(["a", "b"]).slice(low, n)
                yield part.filter(ok)

    side = lambda name: texts.select(
        F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}")
    )
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def compare_clusters(members: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Links (a, b) between components of the members (cluster, component, doc_id, text).

    All members of a cluster are compared, in pairs of blocks.
    """

    def compare(group: pa.Table) -> pa.Table:
        data, offsets = text_bytes(group.column("text"))
        component = group.column("component").to_numpy()
        n = len(component)
        parts = []
        for low, high in blocks(offsets):
            part = data[offsets[low] : offsets[high]]
            rows, values = shingle_sets(part, offsets[low : high + 1] - offsets[low], words)
            parts.append((rows + low, values))
        rows = np.concatenate([x[0] for x in parts])
        size = np.bincount(rows, minlength=n)
        _, column, times = np.unique(
            np.concatenate([x[1] for x in parts]), return_inverse=True, return_counts=True
        )
        # Only shingles of two texts or more count; columns are numbered anew without the others.
        several = times > 1
        number = np.cumsum(several) - 1
        keep = several[column]
        rows, column = rows[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        common = np.zeros((n, n), np.float32)
        width = max(1, MATRIX_CELLS // n)
        for begin in range(0, int(several.sum()), width):
            at = slice(*np.searchsorted(column, (begin, begin + width)))
            matrix = np.zeros((n, width), np.float32)
            matrix[rows[at], column[at] - begin] = 1
            common += matrix @ matrix.T
        union = size[:, None] + size[None, :] - common
        linked = (100 * common >= percent * union) & (common > 0)
        label = component.copy()
        while True:
            least = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
            least = np.minimum(least, label)
            # Texts of one component move together.
            names, place = np.unique(component, return_inverse=True)
            best = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(best, place, least)
            if (best[place] == label).all():
                break
            label = best[place]
        moved = label < component
        pairs = np.unique(np.column_stack((component[moved], label[moved])), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    spread = (
        members.join(sizes, "cluster")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "cluster",
            F.least("block", "other").alias("one"),
            F.greatest("block", "other").alias("two"),
            "component",
            "text",
        )
    )
    return spread.groupBy("cluster", "one", "two").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Texts are linked if 100 * common shingles >= percent * shingles of both. A null or
    empty text has no shingles and no links. Rows with equal doc_id are one document if
    their texts are equal; a null doc_id is never linked: its component is null and the
    row is kept. Other columns are ignored. An empty table gives an empty result.
    """
    pieces = pieces_for(percent)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    signed = materialize(signatures(docs, pieces, words), "signatures")
    set_key = ["n_shingles", "digest_a", "digest_b"]
    texts = materialize(
        signed.where("doc_id is not null and n_shingles > 0")
        .groupBy(*set_key)
        .agg(F.min("doc_id").alias("doc_id"), F.min_by("minhash", "doc_id").alias("minhash")),
        "distinct-sets",
    )
    buckets = materialize(tensored_buckets(texts, pieces), "buckets")
    some = buckets.select("doc_id").distinct()
    texts_of = materialize(
        docs.join(some, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "texts"
    )

    # First comparison: the centre that a text shares most tables with.
    size_of = texts.select(F.col("doc_id").alias("center"), F.col("n_shingles").alias("n_center"))
    stars = buckets.where("doc_id <> center").groupBy("doc_id", "center", "n_shingles").count()
    first_pairs = (
        stars.join(size_of, "center")
        .where(_sizes_allow(F.col("n_shingles"), F.col("n_center"), percent))
        .groupBy(F.col("doc_id").alias("b"))
        .agg(F.max_by("center", F.struct(F.col("count"), -F.col("center"))).alias("a"))
    )
    first_links = materialize(confirm(first_pairs, texts_of, percent, words), "first-links")
    first = connected_components(first_links)

    # What is left: members of one bucket in different components.
    labelled = materialize(
        buckets.select("bucket", "doc_id", "center")
        .join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id")),
        "labelled",
    )
    mixed = (
        labelled.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("bucket")
    )
    open_rows = materialize(
        labelled.join(mixed, "bucket").select("doc_id", "center", "component").distinct(), "open"
    )
    clusters = connected_components(open_rows.select(F.col("doc_id").alias("a"), F.col("center").alias("b")))
    members_of = (
        open_rows.select("doc_id", "component")
        .distinct()
        .join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
        .join(texts_of, "doc_id")
    )
    between = materialize(compare_clusters(members_of, percent, words), "links-between")
    members = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = connected_components(between.unionAll(members.where("a <> b")))

    groups = texts.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        *set_key, F.coalesce("component", "doc_id").alias("component_id")
    )
    return (
        signed.select("doc_id", *set_key)
        .join(groups, set_key, "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias(
                "component_id"
            ),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """Rows of ``docs`` without the near-duplicates of a kept row, with all their columns.

    Of a group the smallest doc_id stays; rows with null or repeated ids count as documents
    of their own, so of repeated rows one stays. Texts without words have no duplicates.
    """
    keyed = with_whole_rows(docs)
    found = near_duplicates(keyed.select(F.col(ROW).alias("doc_id"), "text"), percent, words)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(ROW))
    return keyed.join(gone, ROW, "left_anti").select(f"{WHOLE}.*")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
