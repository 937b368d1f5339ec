"""Auditable place names: inventory, review template, reviewed mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from companylens.functions import text
from companylens.functions.numeric import total
from companylens.operators.distributed import join_by_key, materialize, running_total
from companylens.operators.summaries import summarize_places
from companylens.schema import EBITDA, EMPLOYEES, MAPPING_COLUMNS, REVENUE
from companylens.sources.contracts import (
    enforce,
    mapping_report,
    require_columns,
    require_rows,
)

GEOGRAPHY_COLUMNS = [
    "company_name",
    "municipality",
    EMPLOYEES,
    REVENUE,
    EBITDA,
    "has_adverse_legal_status",
]


def inventory_labels(df: DataFrame) -> DataFrame:
    """Aggregated audit rows per normalised label and match key."""
    require_columns(df, GEOGRAPHY_COLUMNS, "geographic analysis")
    # Labels repeat a lot: aggregate raw labels first, normalise the few after.
    raw = df.groupBy("municipality").agg(
        F.count(F.lit(1)).alias("company_count"),
        total(F.col(EMPLOYEES)).alias("employee_count"),
        total(F.col(REVENUE)).alias("revenue_total_k_eur"),
        total(F.col(EBITDA)).alias("ebitda_total_k_eur"),
        F.count_if(F.col("has_adverse_legal_status")).alias("adverse_status_count"),
    )
    labelled = raw.withColumn(
        "municipality_original", text.normalize_geographic_text(F.col("municipality"))
    ).withColumn(
        "municipality_match_key", text.municipality_key(F.col("municipality_original"))
    )
    return labelled.groupBy("municipality_original", "municipality_match_key").agg(
        *[
            F.sum(c).alias(c)
            for c in (
                "company_count",
                "employee_count",
                "revenue_total_k_eur",
                "ebitda_total_k_eur",
                "adverse_status_count",
            )
        ]
    )


def create_municipality_inventory(df: DataFrame) -> DataFrame:
    """Audit inventory with sequential ids, most frequent label first."""
    labels = inventory_labels(require_rows(df, "create a municipality inventory"))
    order = [
        F.desc("company_count"),
        F.desc("revenue_total_k_eur"),
        F.asc_nulls_last("municipality_original"),
    ]
    numbered = running_total(labels, order, F.lit(1), "inventory_id")
    return numbered.select("inventory_id", *labels.columns).orderBy("inventory_id")


def create_mapping_template(inventory: DataFrame) -> DataFrame:
    """Review template: identity mapping, all pending, without financial columns."""
    keys = ["municipality_original", "municipality_match_key"]
    require_columns(inventory, keys, "mapping")
    return (
        inventory.select(*keys)
        .distinct()
        .select(
            *keys,
            F.col("municipality_original").alias("municipality_canonical"),
            F.lit("pending").alias("review_status"),
            F.lit("identity_pending_review").alias("normalization_rule"),
            F.lit("").alias("notes"),
        )
        .orderBy(F.asc_nulls_last("municipality_original"))
    )


def apply_mapping(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``municipality_canonical`` and ``municipality_review_status`` from a mapping.

    Many-to-one by contract: labels are unique in the mapping, so no record is
    repeated. The original label is kept; a mapped null label is a label like any
    other. Rows of the mapping that are still pending are applied too, and their
    status says so; labels outside the mapping get null in both columns.
    """
    require_columns(mapping, MAPPING_COLUMNS, "applying a mapping")
    mapping = materialize(mapping.select(*MAPPING_COLUMNS), "mapping")
    enforce(mapping_report(mapping), "the municipality mapping")
    label = text.normalize_geographic_text(F.col("municipality"))
    # Raw labels are few: each is normalised and looked up once, with its number of records.
    used = df.groupBy("municipality").agg(F.count(F.lit(1)).alias("uses"))
    canonical = mapping.select(
        F.col("municipality_original").alias("__mapped"),
        "municipality_canonical",
        F.col("review_status").alias("municipality_review_status"),
    )
    looked_up = (
        used.withColumn("__label", label)
        .join(canonical, F.col("__label").eqNullSafe(F.col("__mapped")))
        .select("municipality", "municipality_canonical", "municipality_review_status", "uses")
    )
    spread = [c for c in ("record_order",) if c in df.columns] or None
    return join_by_key(df, looked_up, ["municipality"], "uses", spread)


def create_canonical_summary(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Place summary by canonical label; the labelled records are stored once."""
    needed = [
        "municipality",
        EMPLOYEES,
        REVENUE,
        EBITDA,
        "ebitda_margin",
        "has_adverse_legal_status",
        "has_negative_latest_ebitda",
    ]
    labelled = apply_mapping(df.select(*needed), mapping).drop("municipality")
    return summarize_places(materialize(labelled, "labelled"), "municipality_canonical")
