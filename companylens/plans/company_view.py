"""Company table derived from the sales tables.

A company is a customer. Its latest period is the last year that the orders
cover to its end, unless another one is asked for: revenue is the discounted price of its order lines, EBITDA is revenue
less the retail cost of the parts, and head count is its number of orders.
Names carry legal markers, and labels carry case, spacing and accent variants,
by rule, so that every cleaning step has work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.operators.distributed import materialize
from companylens.plans.pipeline import quality_layer
from companylens.schema import NO_SHAREHOLDER_SENTENCE, SOURCE_COLUMNS


def last_full_year(spark: SparkSession, sf_dir: str) -> int:
    """Last calendar year that the order dates cover up to its last day."""
    newest = _table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]
    if newest is None:
        return 1970
    return newest.year if (newest.month, newest.day) == (12, 31) else newest.year - 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def company_view(spark: SparkSession, sf_dir: str, latest_year: int | None = None) -> DataFrame:
    """Ten source columns for every customer, for a year and the year before.

    Orders are cut to the two periods first (a pushed-down date range), so the
    order lines shrink before they meet the parts. Lines are summed per order
    and then per customer: a customer with very many lines is reduced on the
    way.
    """
    year = latest_year or last_full_year(spark, sf_dir)
    orders = (
        _table(spark, sf_dir, "orders")
        .where(F.col("o_orderdate") >= F.lit(f"{year - 1}-01-01").cast("timestamp"))
        .where(F.col("o_orderdate") < F.lit(f"{year + 1}-01-01").cast("timestamp"))
        .select(
            "o_orderkey",
            "o_custkey",
            (F.year("o_orderdate") == year).alias("is_latest"),
        )
    )
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    net = price * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)"))
    cost = F.col("l_quantity").cast("decimal(6,0)") * F.col("p_retailprice").cast("decimal(8,2)")
    per_order = (
        orders.join(
            _table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")
        )
        .join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey", "o_custkey", "is_latest")
        .agg(F.sum(net).alias("revenue"), F.sum(net - cost).alias("ebitda"))
    )

    def period(column: str, latest: bool):
        chosen = F.col("is_latest") if latest else ~F.col("is_latest")
        return F.sum(F.when(chosen, F.col(column))).cast("double") / 1000

    per_company = per_order.groupBy("o_custkey").agg(
        F.nullif(F.count_if(F.col("is_latest")), F.lit(0)).alias("orders_latest"),
        period("revenue", True).alias("revenue_latest"),
        period("revenue", False).alias("revenue_previous"),
        period("ebitda", True).alias("ebitda_latest"),
        period("ebitda", False).alias("ebitda_previous"),
    )

    key = F.col("c_custkey")
    number = F.when(key % 150 == 149, key - 1).otherwise(key).cast("string")
    marker = (
        F.when(key % 25 == 0, " (EXTINGUIDA)")
        .when(key % 33 == 0, " (EN LIQUIDACIÓN)")
        .when(key % 97 == 0, "  (en disolución)")
        .otherwise("")
    )
    label = (
        F.when(key % 13 == 0, F.lit(None))
        .when(key % 4 == 1, F.concat(F.lit("  "), F.lower("n_name")))
        .when(key % 4 == 2, F.replace(F.col("n_name"), F.lit("A"), F.lit("Á")))
        .otherwise(F.col("n_name"))
    )
    website = F.when(
        key % 9 != 0,
        F.concat(F.lit("https://company-"), key.cast("string"), F.lit(".example")),
    )
    shareholder = F.when(key % 7 == 0, NO_SHAREHOLDER_SENTENCE).otherwise(
        F.concat(F.lit(" HOLDING  "), (key % 50).cast("string"), F.lit(" SL"))
    )
    # A few companies report nothing or net credit notes, by rule.
    revenue = (
        F.when(key % 61 == 0, F.lit(0.0))
        .when(key % 67 == 0, -F.col("revenue_latest"))
        .otherwise(F.col("revenue_latest"))
    )
    return (
        _table(spark, sf_dir, "customer")
        .join(_table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(per_company, F.col("o_custkey") == key, "left")
        .select(
            (key + 1).alias("record_order"),
            F.concat(F.lit("Customer "), number, marker).alias("company_name"),
            website.alias("website"),
            label.alias("municipality"),
            F.col("orders_latest").alias("employees_latest"),
            revenue.alias("operating_revenue_latest_k_eur"),
            F.col("revenue_previous").alias("operating_revenue_previous_k_eur"),
            F.col("ebitda_latest").alias("ebitda_latest_k_eur"),
            F.col("ebitda_previous").alias("ebitda_previous_k_eur"),
            shareholder.alias("shareholder_name"),
        )
        .select(*SOURCE_COLUMNS)
    )


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(spark: SparkSession, sf_dir: str, layer: str, build) -> DataFrame:
    """Layer written once per Spark application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, layer)
    if key not in _STORED:
        _STORED[key] = materialize(build(), layer)
    return _STORED[key]


def source_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company view, stored."""
    return _stored(spark, sf_dir, "source", lambda: company_view(spark, sf_dir))


def company_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 36 company-level columns over the company view, stored."""
    return _stored(
        spark, sf_dir, "quality", lambda: quality_layer(source_layer(spark, sf_dir))
    )
