"""Exact quantiles of groups of any size, by rank selection in two steps.

Numbers have cells: a sign and a thousandth of an octave (``CELLS`` to a doubling), so a larger
number never has a lower cell. First the numbers are counted per group and cell, with partial
sums; running sums over a group's cells, of which there are a fixed number at most, say which
cells hold the wanted ranks. Then only the numbers of these cells are counted by value and put
in order. So two scans and small aggregates do; nothing is stored, sorted or sampled, and no
task holds more of a group than the distinct values of one cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cells of an octave, and a shift above the largest number of cells on one side of zero.
CELLS = 1_024
SHIFT = 1 << 21


def number_cell(value: Column) -> Column:
    """Cell of a double: 0 for zero, infinities beyond all numbers, NaN at the end."""
    octave = F.floor(F.log2(F.abs(value)) * CELLS).cast("int") + SHIFT
    return (
        F.when(F.isnan(value), 4 * SHIFT)
        .when(value == 0, 0)
        .when(value == float("inf"), 3 * SHIFT)
        .when(value == float("-inf"), -3 * SHIFT)
        .when(value > 0, octave)
        .otherwise(-octave)
    )


def exact_quantiles(
    df: DataFrame,
    metrics: list[str],
    probabilities: list[float],
    group_by: list[str] | None = None,
    few_groups: bool = False,
    members: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of several columns per group.

    Returns one row per group and metric with at least one value: the group
    columns, ``metric``, ``available`` (number of values) and ``quantiles``, an
    array in the order of ``probabilities``, equal to the built-in ``percentile``
    to the last bit. ``few_groups`` states that the number of groups is fixed by
    the caller (such as the analytical scopes), so that their wanted cells are
    small; otherwise Spark chooses the join by their size. ``members`` names an
    array column with the few groups of a row, if groups overlap: rows are counted
    by that array, and only counts and wanted numbers are repeated for each group.

    ``df`` is read twice; a costly one should be stored before.
    """
    group_by = list(group_by or [])
    keys = group_by + ["metric"]
    given = [members] if members else group_by
    values = (
        df.select(
            *given,
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                        for m in metrics
                    ]
                )
            ),
        )
        .where(F.col("value").isNotNull())
        .withColumn("cell", number_cell(F.col("value")))
    )

    def bounds(p: float) -> tuple[Column, Column, Column]:
        position = F.lit(float(p)) * (F.col("available") - 1)
        return position, F.floor(position), F.ceil(position)

    # A row covers the zero-based ranks [upto - n, upto) of its group.
    def covers(rank: Column) -> Column:
        return (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))

    wanted_ranks = [rank for p in probabilities for rank in bounds(p)[1:]]
    covers_any = reduce(lambda a, b: a | b, map(covers, wanted_ranks))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    of_group = Window.partitionBy(*keys)
    counts = values.groupBy(*given, "metric", "cell").agg(F.count(F.lit(1)).alias("n"))
    if members:
        each = counts.select(F.explode(members).alias(group_by[0]), "metric", "cell", "n")
        counts = each.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    placed = counts.select(
        *keys,
        "cell",
        "n",
        F.sum("n").over(of_group.orderBy("cell").rowsBetween(*so_far)).alias("upto"),
        F.sum("n").over(of_group).alias("available"),
    )
    wanted = placed.where(covers_any).select(
        *[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        F.col("cell").alias("__cell"),
        (F.col("upto") - F.col("n")).alias("before"),
        "available",
    )
    same = [F.col("metric") == F.col(f"__key_{len(group_by)}"), F.col("cell") == F.col("__cell")]
    if members:
        same.append(F.array_contains(members, F.col("__key_0")))
    else:
        same += [F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(group_by)]
    bounded = few_groups or members or not group_by
    joined = values.join(F.broadcast(wanted) if bounded else wanted, same)
    found = (
        joined.select(
            *[F.col(f"__key_{i}").alias(k) for i, k in enumerate(keys)],
            "cell",
            "before",
            "available",
            "value",
        )
        .groupBy(*keys, "cell", "before", "available", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_cell = Window.partitionBy(*keys, "cell").orderBy("value").rowsBetween(*so_far)
    ranked = found.select(
        *keys, "available", "value", "n", (F.col("before") + F.sum("n").over(in_cell)).alias("upto")
    )
    picks = [
        F.max(F.when(covers(rank), F.col("value"))).alias(f"__{side}_{i}")
        for i, p in enumerate(probabilities)
        for side, rank in zip(("low", "high"), bounds(p)[1:], strict=True)
    ]
    picked = ranked.where(covers_any).groupBy(*keys, "available").agg(*picks)
    quantiles = []
    for i, p in enumerate(probabilities):
        position, lower, upper = bounds(p)
        low, high = F.col(f"__low_{i}"), F.col(f"__high_{i}")
        quantiles.append(
            F.when((lower == upper) | (low == high), low).otherwise(
                (upper - position) * low + (position - lower) * high
            )
        )
    return picked.select(*keys, "available", F.array(*quantiles).alias("quantiles"))


def exact_medians(
    df: DataFrame,
    medians: dict[str, str],
    group_by: list[str] | None = None,
    few_groups: bool = False,
    members: str | None = None,
) -> DataFrame:
    """Medians as columns: ``medians`` maps output names to input columns."""
    columns = sorted(set(medians.values()))
    long = exact_quantiles(df, columns, [0.5], group_by, few_groups, members)
    return long.groupBy(*(group_by or [])).agg(
        *[
            F.max(F.when(F.col("metric") == column, F.col("quantiles")[0])).alias(name)
            for name, column in medians.items()
        ]
    )
