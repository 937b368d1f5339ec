"""Building blocks that keep large or skewed work spread over the cluster.

* ``materialize``      written cut point in the shared folder;
* ``join_by_key``      attach a one-row-per-key table to many rows;
* ``running_total``    global running sum without a single-task window;
* ``spread_small_input``  use all cores on input with few splits;
* ``merge_single_rows``  put one-row results side by side without a join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key table is broadcast only when its counted bytes stay under this size.
BROADCAST_BYTES = 32 * 1024 * 1024
# At most this many of the most frequent keys are attached by broadcast when
# the whole table is too large for it, and their rows are spread out.
HOT_KEYS = 1_000
# Folders of local sessions without spark.checkpoint.dir, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for written cut points, as named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    # The setting is fixed once a session runs, so the folder is remembered here.
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="companylens-")
    return _LOCAL_FOLDERS[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    """New path in the shared folder."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/{application}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Later passes scan stored columns instead of repeating the plan, and a lost
    executor costs a re-read, not a recomputation. ``compression`` is a Parquet
    codec; without it the session's is taken.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder from whatever store its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete_stored(spark: SparkSession) -> None:
    """Remove all cut points that this application has written.

    Call it when none of their DataFrames is needed any more, at the latest before the
    session is stopped.
    """
    delete_path(spark, f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}")


def _same_keys(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[alias]) for k, alias in keys.items()]
    )


def _row_bytes(df: DataFrame) -> Column:
    """Approximate size of a row, with the real length of texts and arrays, also of arrays of texts."""
    parts = []
    for column in df.schema:
        value = F.col(column.name)
        if isinstance(column.dataType, (T.StringType, T.BinaryType)):
            parts.append(16 + F.coalesce(F.octet_length(value), F.lit(0)))
        elif isinstance(column.dataType, T.ArrayType):
            parts.append(16 + 8 * F.coalesce(F.cardinality(value), F.lit(0)))
            if isinstance(column.dataType.elementType, T.StringType):
                parts.append(F.coalesce(F.octet_length(F.array_join(value, "")), F.lit(0)))
        else:
            parts.append(F.lit(16))
    return reduce(lambda a, b: a + b, parts).cast("long")


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of a stored table allows a broadcast."""
    return table.agg(F.coalesce(F.sum(_row_bytes(table)), F.lit(0))).first()[0] <= limit


def _digest(keys: Iterable[str]) -> Column:
    """Digest of key values, whatever the key columns are called."""
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    return F.sha2(F.to_json(F.struct(*named)), 256)


def join_by_key(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    spread_by: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row per key.

    Null keys match null keys. ``weight`` is a ``table`` column with the number
    of rows behind each key; it is not part of the result unless the caller
    repeats it under another name.

    The table is stored first, so its size is known when the join is chosen:

    * small: broadcast, the wide rows are never shuffled;
    * large, and no key holds more rows than a quarter of an average task: a
      plain key join;
    * large with such hot keys: these are attached by broadcast (``HOT_KEYS`` at
      most, of bounded width) and their rows are spread by a salt, so that no
      task of the following key join receives a whole hot group.
    """
    payload = [c for c in table.columns if c not in keys and c != weight]
    table = materialize(table, "keyed")
    size, total, heaviest = table.agg(
        F.coalesce(F.sum(_row_bytes(table)), F.lit(0)),
        F.coalesce(F.sum(weight), F.lit(0)),
        F.coalesce(F.max(weight), F.lit(0)),
    ).first()

    aliases = {k: f"__key_{i}" for i, k in enumerate(keys)}
    renamed = table.select(
        *[F.col(k).alias(a) for k, a in aliases.items()], weight, *payload
    )
    if size <= broadcast_bytes:
        lookup = F.broadcast(renamed.drop(weight))
        return rows.join(lookup, _same_keys(rows, lookup, aliases), "left").drop(
            *aliases.values()
        )

    slices = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = total / (4 * slices)
    if heaviest <= least:
        plain = renamed.drop(weight)
        return rows.join(plain, _same_keys(rows, plain, aliases), "left").drop(*aliases.values())

    # Hot keys travel as digests, so their size is bounded whatever the keys are.
    # A row that misses its digest still finds its key in the key join below.
    narrow = _row_bytes(renamed) <= BROADCAST_BYTES // HOT_KEYS
    hot = renamed.where((F.col(weight) > least) & narrow)
    hot = hot.orderBy(F.desc(weight), *aliases.values()).limit(HOT_KEYS)
    hot = F.broadcast(
        hot.select(
            _digest(aliases.values()).alias("__hot"),
            *[F.col(c).alias(f"__hot_{c}") for c in payload],
        )
    )
    # Second join column: the key's own hash, or a per-row hash for hot rows,
    # which have their partner already and only need to be spread out.
    spread = F.xxhash64(*(spread_by or rows.columns))
    marked = rows.join(hot, _digest(keys) == F.col("__hot"), "left").withColumn(
        "__salt", F.when(F.col("__hot").isNotNull(), spread).otherwise(F.xxhash64(*keys))
    )
    cold = renamed.drop(weight).withColumn("__cold", F.xxhash64(*aliases.values()))
    joined = marked.join(
        cold,
        _same_keys(marked, cold, aliases) & (marked["__salt"] == cold["__cold"]),
        "left",
    )
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[
            F.when(F.col("__hot").isNotNull(), F.col(f"__hot_{c}"))
            .otherwise(F.col(c))
            .alias(c)
            for c in payload
        ],
    )


def running_total(
    df: DataFrame,
    order_by: list[Column],
    amount: Column,
    name: str,
    slices: int | None = None,
) -> DataFrame:
    """Add the running sum of ``amount`` in the given total order.

    Rows are range-partitioned once; the slice number is stored with the rows,
    so it stays fixed when a task is repeated. Slice totals (one row per slice)
    give each slice its starting value, and the ordered window runs per slice.
    """
    spark = df.sparkSession
    slices = slices or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )
    ranged = materialize(
        df.withColumn("__amount", amount.cast("long"))
        .repartitionByRange(slices, *order_by)
        .withColumn("__slice", F.spark_partition_id()),
        "ranged",
    )
    totals = ranged.groupBy("__slice").agg(F.sum("__amount").alias("__slice_total"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "__slice", F.coalesce(F.sum("__slice_total").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy("__slice").orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # ``starts`` has at most ``slices`` rows.
    return (
        ranged.join(F.broadcast(starts), "__slice")
        .withColumn(name, F.col("__start") + F.sum("__amount").over(inside))
        .drop("__slice", "__start", "__amount")
    )


def spread_small_input(df: DataFrame) -> DataFrame:
    """Use all cores for heavy row-wise work on input with few splits.

    Large inputs have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def merge_single_rows(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames in one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
