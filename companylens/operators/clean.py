"""Clean layer: normalised text, legal status and duplicate candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from companylens.functions import text
from companylens.operators.distributed import BROADCAST_BYTES, join_by_key
from companylens.schema import ADVERSE_STATUSES, SOURCE_COLUMNS
from companylens.sources.contracts import require_columns


def duplicate_groups(df: DataFrame, key: str = "company_match_key") -> DataFrame:
    """Match keys shared by several records. Missing keys form one group."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def add_duplicate_flags(
    df: DataFrame,
    key: str = "company_match_key",
    row_key: str = "record_order",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Flag records whose match key is not unique, with the group size.

    Only keys are shuffled for counting; keys that occur once need no partner.
    The wide records meet the repeated keys in a size-checked join.
    """
    groups = duplicate_groups(df, key).withColumn(
        "potential_duplicate_count", F.col("group_size")
    )
    joined = join_by_key(df, groups, [key], "group_size", [row_key], broadcast_bytes)
    return joined.select(
        *df.columns,
        F.col("potential_duplicate_count").isNotNull().alias("potential_duplicate"),
        F.coalesce("potential_duplicate_count", F.lit(1)).alias("potential_duplicate_count"),
    )


def clean_text(df: DataFrame) -> DataFrame:
    """Row-wise part of the clean layer.

    The accent-free name is computed once, in its own projection, and feeds
    the normalised name, the legal status and the match key.
    """
    require_columns(df, SOURCE_COLUMNS, "cleaning")
    base = df.select(
        "record_order",
        *[
            text.normalize_whitespace(F.col(c)).alias(c)
            for c in ("company_name", "website", "municipality")
        ],
        *[c for c in SOURCE_COLUMNS[4:9]],
        text.clean_shareholder(F.col("shareholder_name")).alias("shareholder_name"),
    )
    plain = base.withColumn("__plain", F.upper(text.remove_accents(F.col("company_name"))))
    named = plain.withColumn("company_name_normalized", text.name_key(F.col("__plain")))
    status = text.legal_status(F.col("__plain"))
    return (
        named.withColumn("legal_status", status)
        .withColumn("has_adverse_legal_status", F.col("legal_status").isin(ADVERSE_STATUSES))
        .withColumn(
            "company_match_key", text.strip_legal_markers(F.col("company_name_normalized"))
        )
        .drop("__plain")
    )


def clean_companies(df: DataFrame) -> DataFrame:
    """Source layer (10 columns) to clean layer (16 columns)."""
    return add_duplicate_flags(clean_text(df))
