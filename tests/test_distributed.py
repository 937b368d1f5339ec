import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from companylens.operators import distributed
from companylens.operators.quantiles import exact_medians, exact_quantiles, number_cell


def test_join_by_key_paths_agree(spark):
    random.seed(7)
    rows = [
        (i, None if i % 11 == 0 else "hot" if i % 3 else f"k{random.randrange(300)}", i % 2)
        for i in range(4000)
    ]
    df = spark.createDataFrame(rows, "id long, name string, half int")
    table = df.groupBy("name", "half").agg(F.count("*").alias("w"))
    table = table.withColumn("size", F.col("w")).where("size > 3")
    keys = ["name", "half"]
    small = distributed.join_by_key(df, table, keys, "w", ["id"])
    large = distributed.join_by_key(df, table, keys, "w", ["id"], broadcast_bytes=0)
    assert small.columns == large.columns == ["id", "name", "half", "size"]
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
    assert large.count() == len(rows)


def test_large_path_spreads_the_hot_key(spark):
    df = spark.range(20_000).select(F.col("id"), F.lit("hot").alias("name"))
    table = df.groupBy("name").agg(F.count("*").alias("w")).withColumn("size", F.col("w"))
    joined = distributed.join_by_key(df, table, ["name"], "w", ["id"], broadcast_bytes=0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 20_000 and len(tasks) == 4 and max(tasks) < 6_000


def test_missed_hot_digest_still_joins(spark):
    df = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, 1.5)], "id long, v double")
    table = df.groupBy("v").agg(F.count("*").alias("w")).withColumn("size", F.col("w"))
    joined = distributed.join_by_key(df, table, ["v"], "w", ["id"], broadcast_bytes=0)
    assert {r.id: r["size"] for r in joined.collect()} == {1: 2, 2: 2, 3: 1}


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_running_total(spark, slices):
    random.seed(slices)
    rows = [(i, random.choice("abc"), random.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, name string, n int")
    order = [F.desc("name"), F.asc("id")]
    result = distributed.running_total(df, order, F.col("n"), "upto", slices)
    expected, so_far = {}, 0
    for i, _, n in sorted(rows, key=lambda r: (-ord(r[1]), r[0])):
        so_far += n
        expected[i] = so_far
    assert {r.id: r.upto for r in result.collect()} == expected


def test_merge_single_rows(spark):
    a = spark.sql("select 1 as x, cast(null as string) as y")
    b = spark.sql("select 'z' as y, 2.5d as w")
    assert distributed.merge_single_rows(a, b).collect() == [(1, "z", 2.5)]


def make_groups(spark):
    random.seed(3)
    rows = []
    for i in range(6000):
        group = "hot" if i % 3 else random.choice(["a", "b", None, "single"])
        if group == "single" and i > 3000:
            group = "a"
        value = float(random.choice([0, 1, 1, 1, 2])) if i % 5 == 0 else random.gauss(0, 100)
        rows.append((i, group, None if i % 17 == 0 else value, float(i % 7)))
    return rows, spark.createDataFrame(rows, "id long, g string, v double, w double")


@pytest.mark.parametrize("few_groups", [False, True])
def test_quantiles_against_numpy(spark, few_groups):
    rows, df = make_groups(spark)
    probabilities = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    result = exact_quantiles(df, ["v", "w"], probabilities, ["g"], few_groups)
    found = {(r.g, r.metric): (r.available, r.quantiles) for r in result.collect()}
    assert len(found) == 2 * len({r[1] for r in rows})
    for (group, metric), (available, quantiles) in found.items():
        position = 2 if metric == "v" else 3
        values = [r[position] for r in rows if r[1] == group and r[position] is not None]
        assert available == len(values)
        assert quantiles == pytest.approx(np.quantile(values, probabilities), abs=1e-9)


def test_quantiles_without_groups(spark):
    rows, df = make_groups(spark)
    result = exact_quantiles(df, ["v"], [0.25, 0.75])
    values = [r[2] for r in rows if r[2] is not None]
    assert [r.quantiles for r in result.collect()] == [
        pytest.approx(np.quantile(values, [0.25, 0.75]), abs=1e-9)
    ]
    assert exact_quantiles(df.where("v is null"), ["v"], [0.5]).count() == 0


def test_quantiles_have_the_bits_of_the_built_in(spark):
    """Odd values and 100 random samples, all as groups of one frame."""
    inf = float("inf")
    samples = [[1.0, 2.0, inf], [inf] * 3, [-1.7e308, 1.7e308], [-inf, 0.0, inf], [4.0] * 50, [7.25]]
    own = random.Random(11)
    samples += [[own.gauss(0, 10 ** own.randint(-3, 9)) for _ in range(own.randint(1, 110))] for _ in range(100)]
    rows = [(i, x) for i, sample in enumerate(samples) for x in sample]
    df = spark.createDataFrame(rows, "g int, v double")
    levels = [0.0, 0.1, 0.25, 0.29, 0.5, 0.75, 0.999, 1.0]
    found = {r.g: r.quantiles for r in exact_quantiles(df, ["v"], levels, ["g"]).collect()}
    built_in = df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, levels))).alias("q"))
    expected = {r.g: r.q for r in built_in.collect()}
    assert repr(sorted(found.items())) == repr(sorted(expected.items()))
    assert found[0][4] == 2.0 and found[1][4] == inf and found[2][4] == 0.0


def test_no_digest_without_a_hot_key(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("k"), "id")
    table = df.groupBy("k").agg(F.count("*").alias("w")).withColumn("size", F.col("w"))
    joined = distributed.join_by_key(df, table, ["k"], "w", ["id"], broadcast_bytes=0)
    assert "sha2" not in joined._jdf.queryExecution().toString()
    assert {r["size"] for r in joined.collect()} == {4} and joined.count() == 4000


def test_stored_tables_can_be_removed(spark, tmp_path):
    folder = tmp_path / "stored"
    folder.mkdir()
    (folder / "part").write_text("x")
    distributed.delete_path(spark, str(folder))
    assert not folder.exists()


def test_medians_as_columns(spark):
    rows, df = make_groups(spark)
    result = {r.g: r.m for r in exact_medians(df, {"m": "v"}, ["g"]).collect()}
    for group, median in result.items():
        values = [r[2] for r in rows if r[1] == group and r[2] is not None]
        assert median == pytest.approx(np.median(values))


def test_quantiles_of_overlapping_groups(spark):
    rows, df = make_groups(spark)
    sets = F.when(F.col("id") % 2 == 0, F.array(F.lit("all"), F.lit("even"))).otherwise(F.array(F.lit("all")))
    result = exact_quantiles(df.withColumn("sets", sets), ["v", "w"], [0.3, 0.5], ["s"], True, "sets")
    found = {(r.s, r.metric): (r.available, r.quantiles) for r in result.collect()}
    assert set(found) == {(s, m) for s in ("all", "even") for m in ("v", "w")}
    for (group, metric), (available, quantiles) in found.items():
        own = [r for r in rows if group == "all" or r[0] % 2 == 0]
        values = [r[2 if metric == "v" else 3] for r in own]
        values = [x for x in values if x is not None]
        assert available == len(values)
        assert quantiles == pytest.approx(np.quantile(values, [0.3, 0.5]), abs=1e-9)


def test_number_cells_keep_the_order(spark):
    inf, own = float("inf"), random.Random(2)
    values = [-inf, -1.7e308, -1.0, -5e-324, 0.0, 5e-324, 2.2e-308, 1.0, 1.0000000000000002, 1.7e308, inf]
    values += [own.uniform(-1, 1) * 10 ** own.randint(-300, 300) for _ in range(3000)]
    values += [1.0 + k * 2.0**-52 for k in range(-50, 50)]
    values = sorted(values) + [float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    cells = [r[0] for r in df.orderBy("i").select(number_cell(F.col("v"))).collect()]
    assert cells == sorted(cells) and len(set(cells[:11])) >= 10


def test_quantiles_store_and_sort_nothing(spark):
    """Two scans, partial sums and broadcast cells; the values are never put in order as a whole."""
    plan = exact_quantiles(spark.range(100).select(F.col("id").cast("double").alias("v")), ["v"], [0.5])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "InMemory" not in text and "Scan parquet" not in text
