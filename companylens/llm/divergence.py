"""Audit of how the sources of a language differ in their words, by chunk factorization.

Texts are not split into terms one by one. White-space chunks repeat so much that a corpus is
the product of two smaller things: how often each chunk stands in each document, and which
terms a chunk holds.

1. The chunks of every whole document are counted, in blocks of documents. A block keeps its
   numbers in one row, and lists each of its distinct chunks once, by buckets of their hash.
2. A bucket holds all occurrences of its chunks in all blocks: every chunk that is distinct in
   the whole corpus is split into terms once. A chunk occurs once per block at most, so frequent
   chunks make no bucket larger than another.
3. The terms go back to the blocks. As a document lies in one block, a block's numbers of
   distinct documents and of occurrences per language, source and term are final for it, and
   all that goes on are their partial sums.
4. Shares are whole numbers (billionths, decimal arithmetic). Sources are compared in buckets
   of terms: a task holds the shares of all sources of a language for the terms of a bucket.

Nothing is cut off: the lists of terms stop at ten ranks because the report does.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from companylens.llm.kernels import ragged
from companylens.operators.distributed import fresh_path, materialize

# A term is a run of ASCII letters and characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_DOCUMENTS = 10
TOP_TERMS = 10
SHARE_UNIT = 1_000_000_000
# Bytes of text in a block, buckets of chunks (a task's dictionary is one of them), and shares of
# sources by terms that a task compares at once.
BLOCK_TEXT = 16 << 20
BUCKETS = 4_096
BUCKET_CELLS = 1 << 18

# A block's row with numbers has the bucket -1, the rows with its chunks those from 0 on.
BLOCK_SCHEMA = (
    "block long, bucket int, lines binary, langs array<string>, sources array<string>, group binary, "
    "sizes binary, gaps binary, times binary, places binary"
)
COUNT_SCHEMA = "lang string, source string, term string, docs long, n long"
PAIR_SCHEMA = "lang string, source string, item string, value long"


_BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int32()), ("lines", pa.binary())]
    + [(c, pa.list_(pa.string())) for c in ("langs", "sources")]
    + [(c, pa.binary()) for c in ("group", "sizes", "gaps", "times", "places")]
)
_NUMBERS = _BLOCK_ARROW.names[3:]


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 to 2**31 - 1, those below 255 in one byte."""
    small = np.minimum(values, 255).astype(np.uint8)
    large = values[small == 255].astype("<i4")
    return len(small).to_bytes(8, "little") + small.tobytes() + large.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    small = np.frombuffer(raw, np.uint8, n, 8)
    values = small.astype(np.int64)
    values[small == 255] = np.frombuffer(raw, "<i4", offset=8 + n)
    return values


class _Block:
    """Counted chunks of the documents that were added."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.groups: dict[tuple, int] = {}
        self.group, self.sizes, self.at, self.times = array("i"), array("i"), array("i"), array("i")

    def add(self, lang: str, source: str, raw: bytes) -> None:
        index, bag = self.index, Counter(raw.split())
        self.group.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.sizes.append(len(bag))
        self.at.extend([index.setdefault(chunk, len(index)) for chunk in bag])
        self.times.extend(bag.values())

    def rows(self, block: int) -> list[dict]:
        group, sizes, at, times = (np.frombuffer(x, np.int32) for x in (self.group, self.sizes, self.at, self.times))
        order = np.lexsort((at, np.repeat(np.arange(len(sizes)), sizes)))
        at, times = at[order], times[order]
        gaps = np.diff(at, prepend=0)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        gaps[first] = at[first]
        chunks = list(self.index)
        bucket = np.fromiter((zlib.crc32(c) % BUCKETS for c in chunks), np.int64, len(chunks))
        places = np.argsort(bucket, kind="stable")
        numbers = {
            "langs": [g[0] for g in self.groups],
            "sources": [g[1] for g in self.groups],
            "group": pack(group),
            "sizes": pack(sizes),
            "gaps": pack(gaps),
            "times": pack(times),
            "places": places.astype("<i4").tobytes(),
        }
        out = [{"block": block, "bucket": -1, **numbers}]
        names, starts = np.unique(bucket[places], return_index=True)
        for name, low, high in zip(names.tolist(), starts, [*starts[1:], len(places)], strict=True):
            lines = b"\n".join([chunks[i] for i in places[low:high].tolist()])
            out.append({"block": block, "bucket": name, "lines": lines})
        return out


def chunk_blocks(docs: DataFrame) -> DataFrame:
    """BLOCK_SCHEMA of (lang, source, text): counted chunks of blocks of documents.

    The row with numbers names the pair of ``langs`` and ``sources`` of each document, how many
    distinct chunks it has, and, document after document, their ascending places (as gaps)
    and counts. ``places`` are those of the chunks in the order of the other rows.
    """

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, current = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in batches:
            columns = (batch.column(c) for c in ("lang", "source", "text"))
            for lang, source, text in zip(*columns, strict=True):
                raw = text.as_py()
                current.add(lang.as_py(), source.as_py(), raw)
                size += len(raw)
                if size >= BLOCK_TEXT:
                    yield pa.RecordBatch.from_pylist(current.rows(block), schema=_BLOCK_ARROW)
                    block, size, current = block + 1, 0, _Block()
        if current.sizes:
            yield pa.RecordBatch.from_pylist(current.rows(block), schema=_BLOCK_ARROW)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(
        of_partition, BLOCK_SCHEMA
    )


def named_chunks(chunks: DataFrame) -> DataFrame:
    """(block, bucket, lines) with the terms of each chunk, and a space between them."""
    find = re.compile(TERM.encode()).findall
    lower = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = -1, {}
        for batch in batches:
            out = []
            for own, lines in zip(batch.column("bucket").to_pylist(), batch.column("lines"), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                terms = []
                for chunk in lines.as_py().split(b"\n"):
                    found = known.get(chunk)
                    if found is None:
                        found = known[chunk] = b" ".join(find(chunk.translate(lower)))
                    terms.append(found)
                out.append(b"\n".join(terms))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())],
                ["block", "bucket", "lines"],
            )

    together = chunks.select("block", "bucket", "lines").repartition("bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(name, "block long, bucket int, lines binary")


def _block_counts(numbers: dict, lines: list[bytes]) -> pa.RecordBatch:
    """COUNT_SCHEMA of a block whose chunks, in the order of its places, hold ``lines``."""
    group, sizes, gaps, times = (unpack(numbers[c]) for c in ("group", "sizes", "gaps", "times"))
    places = np.frombuffer(numbers["places"], "<i4")
    doc = np.repeat(np.arange(len(sizes)), sizes)
    # Gaps add up within a document.
    total = np.cumsum(gaps)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    before = np.zeros(len(sizes), np.int64)
    before[sizes > 0] = total[begin] - gaps[begin]
    at = total - before[doc]

    index: dict[bytes, int] = {}
    flat = array("q")
    count = np.zeros(len(places), np.int64)
    first = np.zeros(len(places), np.int64)
    for place, line in zip(places.tolist(), lines, strict=True):
        if line:
            own = line.split(b" ")
            first[place] = len(flat)
            count[place] = len(own)
            flat.extend([index.setdefault(term, len(index)) for term in own])
    flat = np.frombuffer(flat, np.int64)
    width = max(len(index), 1)
    repeat = count[at]
    term = flat[ragged(first[at], repeat)]
    doc = np.repeat(doc, repeat)
    pairs, pair_of = np.unique(doc * width + term, return_inverse=True)
    n_pair = np.bincount(pair_of, weights=np.repeat(times, repeat), minlength=len(pairs))
    # Term by term, so that neighbouring rows differ little and are shuffled in few bytes.
    n_groups = len(numbers["langs"])
    cells, cell_of = np.unique(pairs % width * n_groups + group[pairs // width], return_inverse=True)
    n = np.bincount(cell_of, weights=n_pair, minlength=len(cells)).astype(np.int64)
    docs = np.bincount(cell_of, minlength=len(cells))
    groups = pa.array(cells % n_groups)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(numbers["langs"], pa.string()).take(groups),
            pa.array(numbers["sources"], pa.string()).take(groups),
            pa.array(list(index), pa.binary()).take(pa.array(cells // n_groups)).cast(pa.string(), safe=False),
            pa.array(docs, pa.int64()),
            pa.array(n),
        ],
        ["lang", "source", "term", "docs", "n"],
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """COUNT_SCHEMA: distinct documents and occurrences of each term by lang and source.

    Rows of a term of a language are in one partition; a block has one of them per source.
    """
    spark = docs.sparkSession
    blocks = chunk_blocks(docs)
    path = fresh_path(spark, "chunk-blocks")
    blocks.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(blocks.schema).parquet(path)
    named = named_chunks(stored.where("bucket >= 0"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict | None = None
        lines: list[bytes] = []
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket < 0:
                    if numbers:
                        yield _block_counts(numbers, lines)
                    numbers = {c: batch.column(c)[i].as_py() for c in _NUMBERS}
                    lines = []
                else:
                    lines.extend(batch.column("lines")[i].as_py().split(b"\n"))
        if numbers:
            yield _block_counts(numbers, lines)

    together = stored.where("bucket < 0").unionByName(named, allowMissingColumns=True)
    counted = together.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(count, COUNT_SCHEMA)
    counted = counted.repartition("lang", "term")
    return counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(n: str | int, total: str) -> Column:
    """Smoothed share in billionths; needs the number of kept terms in ``v``."""
    return F.expr(f"1 + ({SHARE_UNIT} * cast({n} + 2 as decimal(20, 0))) div ({total} + 2 * v)")


def _difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Summed differences of all ordered pairs of sources of a language."""
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("v").alias("terms"))
    buckets = F.greatest(F.ceil(F.col("terms") * F.col("sources") / BUCKET_CELLS), F.lit(1))
    sizes = sizes.select("lang", buckets.alias("buckets"))
    shares = cells.join(sizes, "lang").select(
        "lang", "source", F.pmod(F.xxhash64("term"), "buckets").alias("bucket"), "term", "p"
    )
    # The row without a term holds a source's share of the terms that it lacks.
    lacking = groups.join(sizes, "lang").select(
        "lang",
        "source",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"),
        F.lit(None).cast("string").alias("term"),
        F.when(F.col("v") > 0, _share(0, "total")).otherwise(0).alias("p"),
    )

    def compare(table: pa.Table) -> pa.Table:
        share = table.column("p").to_numpy()
        has = table.column("term").is_valid().to_numpy()
        names, source = np.unique(table.column("source").to_numpy(zero_copy_only=False), return_inverse=True)
        term = table.column("term").combine_chunks().dictionary_encode()
        if isinstance(term, pa.ChunkedArray):
            term = term.combine_chunks()
        base = np.zeros(len(names), np.int64)
        base[source[~has]] = share[~has]
        shares = np.repeat(base[:, None], len(term.dictionary), axis=1)
        place = term.indices.fill_null(0).to_numpy(zero_copy_only=False)
        shares[source[has], place[has]] = share[has]
        sums = np.zeros((len(names), len(names)), np.int64)
        for i in range(len(names)):
            other = shares[i + 1 :]
            gap = shares[i] - other
            sums[i, i + 1 :] = (gap * gap // (shares[i] + other)).sum(axis=1)
        sums += sums.T
        one, two = np.nonzero(~np.eye(len(names), dtype=bool))
        names = pa.array(names, pa.string())
        lang = table.column("lang")[0].as_py()
        return pa.table(
            {
                "lang": pa.array([lang] * len(one), pa.string()),
                "source": names.take(pa.array(one)),
                "item": names.take(pa.array(two)),
                "value": pa.array(sums[one, two]),
            }
        )

    partial = shares.unionAll(lacking).groupBy("lang", "bucket").applyInArrow(compare, PAIR_SCHEMA)
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank of every (lang, source) group of ``docs``.

    Each language keeps its terms of MIN_DOCUMENTS documents or more. Part ``pair`` compares
    the group with every other source of its language, over all kept terms; part ``term``
    lists up to TOP_TERMS kept terms that the group uses more than its language. Values are
    floor((p - q)^2 / (p + q)) of smoothed shares in billionths.

    A null text, lang or source counts as ''. Every row is a document, repeated ones too;
    doc_id and further columns are ignored. A group without terms has pairs, but no terms. An empty
    table gives an empty result.
    """
    texts = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    )
    # Windows over the sources of one term.
    of_term = Window.partitionBy("lang", "term")
    cells = materialize(
        term_counts(texts)
        .select(
            "lang",
            "source",
            "term",
            "n",
            F.sum("docs").over(of_term).alias("docs"),
            F.sum("n").over(of_term).alias("n_lang"),
            (F.col("source") == F.min("source").over(of_term)).alias("once"),
        )
        .where(F.col("docs") >= MIN_DOCUMENTS)
        .drop("docs"),
        "kept-counts",
    )
    languages = cells.groupBy("lang").agg(F.count_if("once").alias("v"), F.sum("n").alias("total_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialize(
        texts.select("lang", "source")
        .distinct()
        .join(totals, ["lang", "source"], "left")
        .join(languages, "lang", "left")
        .na.fill(0, ["total", "v", "total_lang"]),
        "groups",
    )
    shares = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total").alias("p"), _share("n_lang", "total_lang").alias("q")
    )
    pairs = _pair_sums(shares.drop("q"), groups)
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _difference("p", "q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_value).alias("rank")
        )

    return ranked(pairs, "pair").unionAll(ranked(terms, "term").where(F.col("rank") <= TOP_TERMS))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
