"""Contract checks on schemas, keys, flags, stages and parameters.

Schema checks only read metadata. Data checks are single aggregations; each
returns a small DataFrame of ``check`` and ``failures`` that ``enforce`` turns
into an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from companylens.functions.text import normalize_whitespace
from companylens.schema import INTEGER_COLUMNS, MONEY_COLUMNS, REVIEW_STATUSES, SOURCE_COLUMNS


class ContractError(ValueError):
    """Input breaks a documented contract."""


def require_columns(df: DataFrame, columns: Sequence[str], purpose: str) -> DataFrame:
    """Reject a frame that lacks columns an operator needs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"Missing columns required for {purpose}: {missing}")
    return df


def require_exact_columns(
    columns: Sequence[str], expected: Sequence[str], ordered: bool = True
) -> None:
    """Reject missing, unexpected or (optionally) reordered columns."""
    missing = [c for c in expected if c not in columns]
    unexpected = [c for c in columns if c not in expected]
    if missing or unexpected:
        raise ContractError(f"Missing columns: {missing}. Unexpected columns: {unexpected}.")
    if ordered and list(columns) != list(expected):
        raise ContractError("Columns are not in the expected order.")


def require_rows(df: DataFrame, purpose: str) -> DataFrame:
    """Reject an empty frame. Runs a one-row job: use at boundaries only."""
    if df.isEmpty():
        raise ContractError(f"Cannot {purpose}: no records.")
    return df


def positive_int(value: object, name: str) -> int:
    """Positive integer parameter; booleans are not integers."""
    if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
        raise ContractError(f"{name} must be a positive integer.")
    return value


def probability(value: object, name: str) -> float:
    """Number in [0, 1]; booleans are not numbers."""
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not 0 <= value <= 1:
        raise ContractError(f"{name} must lie between zero and one: {value!r}")
    return float(value)


def enforce(report: DataFrame, purpose: str) -> None:
    """Raise if a report of ``check, failures`` lists any failure."""
    broken = {r["check"]: r["failures"] for r in report.where("failures > 0").collect()}
    if broken:
        raise ContractError(f"Contract of {purpose} is broken: {broken}")


def _as_report(checks: DataFrame) -> DataFrame:
    """One row of counters as ``check, failures`` rows."""
    return checks.unpivot([], checks.columns, "check", "failures")


def duplicated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def source_report(df: DataFrame) -> DataFrame:
    """Key and name checks of a company source, as ``check, failures`` rows."""
    counters = df.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("empty_source"),
        F.count_if(F.col("record_order").isNull()).alias("missing_record_order"),
        F.count_if(F.col("company_name").isNull()).alias("missing_company_name"),
        F.count_if(normalize_whitespace(F.col("company_name")) == "").alias(
            "blank_company_name"
        ),
    )
    repeated = duplicated_keys(df.where("record_order is not null"), "record_order").agg(
        F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).alias("repeated_record_order")
    )
    return _as_report(counters).unionByName(_as_report(repeated))


def validate_source(df: DataFrame) -> DataFrame:
    """Full source contract: exact schema, numeric types, keys and names."""
    require_exact_columns(df.columns, SOURCE_COLUMNS)
    for column in INTEGER_COLUMNS + MONEY_COLUMNS:
        if not isinstance(df.schema[column].dataType, T.NumericType):
            raise ContractError(f"Column is not numeric: {column}")
    enforce(source_report(df), "the company source")
    return df


def flag_report(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Number of missing or non-boolean values per flag column."""
    require_columns(df, flags, "flag validation")
    checks = []
    for flag in flags:
        kind = df.schema[flag].dataType
        if isinstance(kind, T.BooleanType):
            bad = F.col(flag).isNull()
        elif isinstance(kind, T.NumericType):
            bad = F.col(flag).isNull() | ~F.col(flag).isin(0, 1)
        else:
            bad = F.lit(True)
        checks.append(F.count_if(bad).alias(flag))
    return _as_report(df.agg(*checks))


def validate_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Every flag must be a non-missing boolean (or 0/1 integer)."""
    enforce(flag_report(df, flags), "boolean flags")
    return df


def key_fingerprint(df: DataFrame, key: str = "record_order") -> DataFrame:
    """Row count and order-free digest of a key column, in one aggregation."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(
            F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")
        )
        .cast("string")
        .alias("key_digest"),
    )


def stage_report(stages: dict[str, DataFrame], key: str = "record_order") -> DataFrame:
    """Row count and key digest per stage."""
    frames = [
        key_fingerprint(df, key).select(F.lit(name).alias("stage"), "row_count", "key_digest")
        for name, df in stages.items()
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def validate_stages(stages: dict[str, DataFrame], key: str = "record_order") -> None:
    """No stage may add, lose or exchange records."""
    rows = {r["stage"]: r for r in stage_report(stages, key).collect()}
    if len({r["row_count"] for r in rows.values()}) != 1:
        raise ContractError(
            "Row counts differ between stages: "
            f"{ {name: r['row_count'] for name, r in rows.items()} }"
        )
    first = next(iter(stages))
    for name, df in stages.items():
        if rows[name]["key_digest"] != rows[first]["key_digest"]:
            lost = stages[first].select(key).exceptAll(df.select(key)).limit(5).collect()
            gained = df.select(key).exceptAll(stages[first].select(key)).limit(5).collect()
            raise ContractError(
                f"Record keys differ at stage {name}: "
                f"lost {[r[0] for r in lost]}, gained {[r[0] for r in gained]}"
            )


def mapping_report(mapping: DataFrame) -> DataFrame:
    """Review statuses and key uniqueness of a label mapping."""
    statuses = mapping.agg(
        F.count_if(
            F.col("review_status").isNull() | ~F.col("review_status").isin(REVIEW_STATUSES)
        ).alias("unknown_review_status")
    )
    repeated = duplicated_keys(mapping, "municipality_original").agg(
        F.count(F.lit(1)).alias("repeated_label")
    )
    return _as_report(statuses).unionByName(_as_report(repeated))


def uncovered_labels(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels in use that the mapping does not cover."""
    return (
        labels.select("municipality_original")
        .where("municipality_original is not null")
        .distinct()
        .join(mapping.select("municipality_original"), "municipality_original", "left_anti")
    )
