"""Macroeconomic stress on revenue and implied operating cost."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from companylens.functions.numeric import clip, is_true, safe_divide
from companylens.schema import EBITDA, EMPLOYEES, REVENUE
from companylens.sources.contracts import require_columns

STRESS_COLUMNS = [
    "stressed_revenue_k_eur",
    "stressed_opex_k_eur",
    "stressed_ebitda_k_eur",
    "stressed_ebitda_margin",
    "stressed_has_negative_ebitda",
    "is_newly_distressed",
]

DISTRESSED_COLUMNS = [
    "company_name",
    "municipality",
    EMPLOYEES,
    REVENUE,
    "stressed_revenue_k_eur",
    EBITDA,
    "stressed_ebitda_k_eur",
    "stressed_ebitda_margin",
]


def _multiplier(percent: Column) -> Column:
    return F.lit(1.0) + percent / F.lit(100.0)


def _stress(df: DataFrame, shock: Column, inflation: Column) -> DataFrame:
    require_columns(df, [REVENUE, EBITDA], "stress testing")
    shocked = df.select(
        "*",
        (F.col(REVENUE) * _multiplier(shock)).alias("stressed_revenue_k_eur"),
        (clip(F.col(REVENUE) - F.col(EBITDA), low=0.0) * _multiplier(inflation)).alias(
            "stressed_opex_k_eur"
        ),
    )
    result = shocked.select(
        "*",
        (F.col("stressed_revenue_k_eur") - F.col("stressed_opex_k_eur")).alias(
            "stressed_ebitda_k_eur"
        ),
    )
    stressed = F.col("stressed_ebitda_k_eur")
    return result.select(
        "*",
        safe_divide(stressed, F.col("stressed_revenue_k_eur")).alias("stressed_ebitda_margin"),
        is_true(stressed < 0).alias("stressed_has_negative_ebitda"),
        is_true((F.col(EBITDA) >= 0) & (stressed < 0)).alias("is_newly_distressed"),
    )


def apply_macroeconomic_stress(
    df: DataFrame, revenue_shock_pct: float = 0.0, cost_inflation_pct: float = 0.0
) -> DataFrame:
    """Add stressed revenue, cost, EBITDA, margin and distress flags."""
    return _stress(df, F.lit(float(revenue_shock_pct)), F.lit(float(cost_inflation_pct)))


def _impact_aggregates() -> list[Column]:
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0.0))

    return [
        F.count(F.lit(1)).alias("records"),
        F.count(REVENUE).alias("valid"),
        total(REVENUE).alias("base_total_revenue_k_eur"),
        total("stressed_revenue_k_eur").alias("stressed_total_revenue_k_eur"),
        total(EBITDA).alias("base_total_ebitda_k_eur"),
        total("stressed_ebitda_k_eur").alias("stressed_total_ebitda_k_eur"),
        F.count_if(F.col(EBITDA) < 0).alias("base_negative_ebitda_count"),
        F.count_if(F.col("stressed_has_negative_ebitda")).alias(
            "stressed_negative_ebitda_count"
        ),
        F.count_if(F.col("is_newly_distressed")).alias("newly_distressed_count"),
        F.coalesce(
            F.sum(F.when(F.col("stressed_has_negative_ebitda"), F.col(EMPLOYEES))), F.lit(0)
        ).alias("jobs_in_distressed_entities"),
    ]


def _impact_columns() -> list[Column]:
    base_revenue, stressed_revenue = (
        F.col("base_total_revenue_k_eur"),
        F.col("stressed_total_revenue_k_eur"),
    )
    base_ebitda, stressed_ebitda = (
        F.col("base_total_ebitda_k_eur"),
        F.col("stressed_total_ebitda_k_eur"),
    )
    resilience = safe_divide(
        F.col("valid") - F.col("stressed_negative_ebitda_count"), F.col("valid")
    )
    return [
        base_revenue,
        stressed_revenue,
        (stressed_revenue - base_revenue).alias("revenue_delta_k_eur"),
        base_ebitda,
        stressed_ebitda,
        (stressed_ebitda - base_ebitda).alias("ebitda_delta_k_eur"),
        F.coalesce(
            safe_divide(stressed_ebitda - base_ebitda, F.abs(base_ebitda)), F.lit(0.0)
        ).alias("ebitda_contraction_pct"),
        F.col("base_negative_ebitda_count"),
        F.col("stressed_negative_ebitda_count"),
        F.col("newly_distressed_count"),
        F.col("jobs_in_distressed_entities"),
        F.when(F.col("records") == 0, 1.0)
        .otherwise(clip(F.coalesce(resilience, F.lit(0.0)), 0.0, 1.0))
        .alias("resilience_rate"),
    ]


def stress_impact_summary(stressed: DataFrame) -> DataFrame:
    """Twelve impact measures of a stressed frame, in one aggregation."""
    require_columns(stressed, STRESS_COLUMNS, "stress summary")
    return stressed.agg(*_impact_aggregates()).select(*_impact_columns())


def newly_distressed(stressed: DataFrame) -> DataFrame:
    """Companies that turn loss-making under the scenario."""
    return stressed.where("is_newly_distressed").select(*DISTRESSED_COLUMNS)


def baseline_comparison(stressed: DataFrame) -> DataFrame:
    """Aggregate revenue and EBITDA, baseline against scenario."""
    sums = stressed.agg(*_impact_aggregates())
    pairs = [
        ("revenue", "base_total_revenue_k_eur", "stressed_total_revenue_k_eur"),
        ("ebitda", "base_total_ebitda_k_eur", "stressed_total_ebitda_k_eur"),
    ]
    return sums.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(measure).alias("measure"),
                        F.col(base).alias("baseline_k_eur"),
                        F.col(shocked).alias("stressed_k_eur"),
                    )
                    for measure, base, shocked in pairs
                ]
            )
        )
    )


# Multipliers within these limits, and amounts within those, can't leave the range of doubles, so
# that a quotient of amounts says all but for its last digits which product is larger.
MULTIPLIERS = (1e-3, 1e3)
AMOUNTS = (1e-150, 1e150)
# Relative distance of two quotients beyond which rounding can't turn the comparison.
CERTAIN = 1e-13


def _doubles(values: Sequence[float]) -> Column:
    """Constant array; one literal, so that thousands of values cost one expression."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _count_below(values: Column, size: int, bound: Column) -> Column:
    """How many of ``size`` ascending values lie below the bound, by binary search."""
    steps = [1 << k for k in reversed(range(size.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda found, step: F.when(
            (found + step <= size) & (F.get(values, found + step - 1) < bound), found + step
        ).otherwise(found),
    )


def _grid_by_pairs(df: DataFrame, scenarios: list[tuple[float, float]]) -> DataFrame:
    """Every record meets every scenario, and is summed up before the shuffle."""
    shocks, inflations = (_doubles(x) for x in zip(*scenarios, strict=True))
    pairs = F.arrays_zip(
        shocks.alias("revenue_shock_pct"), inflations.alias("cost_inflation_pct")
    )
    scenario = ["revenue_shock_pct", "cost_inflation_pct"]
    wide = df.select(EMPLOYEES, REVENUE, EBITDA, F.inline(pairs).alias(*scenario))
    stressed = _stress(wide, F.col(scenario[0]), F.col(scenario[1]))
    return stressed.groupBy(*scenario).agg(*_impact_aggregates())


def _grid_by_break_even(df: DataFrame, scenarios: list[tuple[float, float]]) -> DataFrame:
    """The same sums from one row per record, whatever the number of scenarios.

    With revenue times a and cost times b, a company makes a loss if revenue / cost < b / a.
    The scenarios' quotients are sorted once; a company's slot is the first of them that makes
    a loss. Slots are summed up, and running sums over the slots are the scenarios' counts.
    Where rounding could decide, the company is compared with just the scenarios in question.
    """
    rows = sorted(
        ((1.0 + c / 100.0) / (1.0 + s / 100.0), 1.0 + s / 100.0, 1.0 + c / 100.0, s, c)
        for s, c in scenarios
    )
    quotients = sorted({r[0] for r in rows})
    slots = len(quotients)
    slot_of = {q: k for k, q in enumerate(quotients)}
    begins = [0] * (slots + 1)
    for q, *_ in rows:
        begins[slot_of[q] + 1] += 1
    for k in range(slots):
        begins[k + 1] += begins[k]

    revenue = F.col(REVENUE).cast("double")
    cost = clip(F.col(REVENUE) - F.col(EBITDA), low=0.0).cast("double")
    quotient = F.when(cost > 0, revenue / cost).when(revenue < 0, float("-inf"))
    sizes = [F.abs(revenue), F.abs(cost)]
    plain = (sizes[0] == 0) | sizes[0].between(*AMOUNTS)
    plain = plain & ((sizes[1] == 0) | sizes[1].between(*AMOUNTS))
    thresholds = _doubles(quotients)
    # Without a quotient there is never a loss; a negative one is a loss everywhere.
    below = _count_below(thresholds, slots, F.col("quotient") * (1 - CERTAIN))
    upto = _count_below(thresholds, slots, F.col("quotient") * (1 + CERTAIN))
    placed = df.select(
        EMPLOYEES,
        REVENUE,
        EBITDA,
        revenue.alias("revenue"),
        cost.alias("cost"),
        F.coalesce(quotient, F.lit(float("inf"))).alias("quotient"),
        is_true(plain).alias("plain"),
    ).select(
        "*",
        F.when(F.col("cost").isNull(), slots).when(F.col("plain"), below).otherwise(0).alias("low"),
        F.when(F.col("cost").isNull() | ~F.col("plain"), slots).otherwise(upto).alias("high"),
    )
    first, last = (F.get(_doubles(begins), F.col(c)).cast("int") for c in ("low", "high"))
    shocked, inflated = (_doubles(x) for x in list(zip(*rows, strict=True))[1:3])
    unsure = F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))
    losses = F.filter(
        unsure,
        lambda p: F.col("revenue") * F.get(shocked, p) - F.col("cost") * F.get(inflated, p) < 0,
    )
    # Places up to ``slots`` are slots, each record has one; those behind are single scenarios.
    place = F.explode(F.concat(F.array("high"), F.transform(losses, lambda p: p + slots + 1)))
    spread = placed.select(EMPLOYEES, REVENUE, EBITDA, "revenue", "cost", place.alias("place"))
    own = F.col("place") <= slots
    stressed_both = own & F.col("cost").isNotNull()
    summed = spread.groupBy("place").agg(
        F.count_if(own).alias("records"),
        F.count(F.when(own, F.col(REVENUE))).alias("valid"),
        F.sum(F.when(own, F.col(REVENUE))).alias("revenue"),
        F.sum(F.when(own, F.col(EBITDA))).alias("ebitda"),
        F.sum(F.when(stressed_both, F.col("revenue"))).alias("stressed_revenue"),
        F.sum(F.when(stressed_both, F.col("cost"))).alias("stressed_cost"),
        F.count_if(own & (F.col(EBITDA) < 0)).alias("base_negative"),
        F.count("cost").alias("losses"),
        F.count_if(F.col(EBITDA) >= 0).alias("new_losses"),
        F.coalesce(F.sum(EMPLOYEES), F.lit(0)).alias("jobs"),
    )
    # From here on, rows are as many as slots and scenarios.
    everything = Window.partitionBy()
    running = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counters = ["losses", "new_losses", "jobs"]
    totals = ["records", "valid", "revenue", "ebitda", "stressed_revenue", "stressed_cost", "base_negative"]
    by_slot = (
        df.sparkSession.range(slots + 1)
        .withColumnRenamed("id", "place")
        .join(F.broadcast(summed), "place", "left")
        .select(
            "place",
            *[F.sum(c).over(everything).alias(c) for c in totals],
            *[F.coalesce(F.sum(c).over(running), F.lit(0)).alias(c) for c in counters],
        )
    )
    single = summed.select("place", *[F.col(c).alias(f"single_{c}") for c in counters])
    listed = df.sparkSession.createDataFrame(
        [(slot_of[q], slots + 1 + p, a, b, s, c) for p, (q, a, b, s, c) in enumerate(rows)],
        "slot long, single long, a double, b double, revenue_shock_pct double, cost_inflation_pct double",
    )
    found = listed.join(F.broadcast(by_slot), F.col("slot") == F.col("place")).drop("place")
    found = found.join(F.broadcast(single), F.col("single") == F.col("place"), "left")
    zero = F.lit(0.0)
    stressed_revenue = F.coalesce(F.col("revenue") * F.col("a"), zero)
    stressed_ebitda = F.col("stressed_revenue") * F.col("a") - F.col("stressed_cost") * F.col("b")

    def with_single(counter: str) -> Column:
        return F.col(counter) + F.coalesce(F.col(f"single_{counter}"), F.lit(0))

    return found.select(
        "revenue_shock_pct",
        "cost_inflation_pct",
        F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("valid", F.lit(0)).alias("valid"),
        F.coalesce("revenue", zero).alias("base_total_revenue_k_eur"),
        stressed_revenue.alias("stressed_total_revenue_k_eur"),
        F.coalesce("ebitda", zero).alias("base_total_ebitda_k_eur"),
        F.coalesce(stressed_ebitda, zero).alias("stressed_total_ebitda_k_eur"),
        F.coalesce("base_negative", F.lit(0)).alias("base_negative_ebitda_count"),
        with_single("losses").alias("stressed_negative_ebitda_count"),
        with_single("new_losses").alias("newly_distressed_count"),
        with_single("jobs").alias("jobs_in_distressed_entities"),
    )


def stress_grid(df: DataFrame, scenarios: Sequence[tuple[float, float]]) -> DataFrame:
    """Impact measures of many (revenue shock, cost inflation) pairs in one pass.

    The work per record grows with the logarithm of the number of pairs. Pairs whose multipliers
    are not positive (or beyond a thousand either way) have no break-even order; for these
    alone every record meets every pair.
    """
    require_columns(df, [REVENUE, EBITDA, EMPLOYEES], "stress testing")
    pairs = [(float(s), float(c)) for s, c in dict.fromkeys(scenarios)]
    if not pairs:
        raise ValueError("A stress grid needs at least one scenario.")

    def ordered(pair: tuple[float, float]) -> bool:
        return all(MULTIPLIERS[0] <= 1.0 + x / 100.0 <= MULTIPLIERS[1] for x in pair)

    parts = []
    if inside := [p for p in pairs if ordered(p)]:
        parts.append(_grid_by_break_even(df, inside))
    if outside := [p for p in pairs if not ordered(p)]:
        parts.append(_grid_by_pairs(df, outside))
    scenario = ["revenue_shock_pct", "cost_inflation_pct"]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.select(*scenario, *_impact_columns()).orderBy(*scenario)
