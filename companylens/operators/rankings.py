"""Top-n tables. Sorting stops at n rows; ranks are numbered on those only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from companylens.operators.filters import filter_analytical_scope, project_present
from companylens.schema import DEFAULT_RANKING_SIZE, RANKING_COLUMNS, REVENUE
from companylens.sources.contracts import ContractError, positive_int


def create_company_ranking(
    df: DataFrame,
    metric: str = REVENUE,
    top_n: int = DEFAULT_RANKING_SIZE,
    scope: str = "all",
    ascending: bool = False,
) -> DataFrame:
    """Companies ranked by a numeric metric; ties keep source order."""
    scoped = filter_analytical_scope(df, scope)
    if metric not in scoped.columns:
        raise ContractError(f"No such column to rank by: {metric}")
    if not isinstance(scoped.schema[metric].dataType, (T.NumericType, T.BooleanType)):
        raise ContractError(f"Only numbers can be ranked: {metric}")
    positive_int(top_n, "Ranking top_n")

    order = [F.asc(metric) if ascending else F.desc(metric), F.asc("record_order")]
    shown = [c for c in RANKING_COLUMNS if c in scoped.columns]
    keep = list(dict.fromkeys([metric, "record_order", *shown]))
    top = scoped.select(*keep).dropna(subset=[metric]).orderBy(*order).limit(top_n)
    return (
        top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
        .orderBy("rank")
        .select("rank", *shown)
    )


def leaderboard(ranking: DataFrame, top_n: int = 15, metric: str = REVENUE) -> DataFrame:
    """First ``top_n`` rows of a ranking table, smallest first for display."""
    positive_int(top_n, "Leaderboard top_n")
    top = ranking.dropna(subset=[metric]).orderBy(F.desc(metric), "rank").limit(top_n)
    return project_present(top, ["rank", "company_name", metric]).orderBy(
        F.asc(metric), F.desc("rank")
    )


def municipality_top_n(summary: DataFrame, top_n: int = 10) -> DataFrame:
    """Labelled municipalities with the largest revenue, smallest first for display."""
    positive_int(top_n, "Municipality top_n")
    return (
        summary.dropna(subset=["municipality", "revenue_total_k_eur"])
        .orderBy(F.desc("revenue_total_k_eur"), "municipality")
        .limit(top_n)
        .orderBy("revenue_total_k_eur", F.desc("municipality"))
    )
