import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from companylens.operators.clean import clean_companies  # noqa: E402
from companylens.plans.pipeline import quality_layer  # noqa: E402
from companylens.schema import SOURCE_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("companylens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.ui.retainedExecutions", "10")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# record_order, name, website, municipality, emp, rev, rev_prev, ebitda, ebitda_prev, holder
COMPANIES = [
    (1, "  Cerámica   Álvarez, S.L. ", "a.example", " Onda ", 10, 120.0, 100.0, 24.0, 20.0, "HOLDING  A"),
    (2, "CERAMICA ALVAREZ SL (EXTINGUIDA)", None, "ONDA", 5, 50.0, 0.0, -5.0, -10.0, None),
    (3, "Ceramica Alvarez S L", "c.example", "Nules", 2, 0.0, 50.0, 10.0, 5.0,
     "There is no shareholders information for this company"),
    (4, "Beta SA (EN LIQUIDACIÓN)", None, None, 4, None, 80.0, 5.0, None, "X"),
    (5, "Gamma SL", None, "Castelló   de la Plana", 1, -10.0, 10.0, -2.0, -1.0, "Y"),
    (6, "Delta SL", None, "CASTELLÓ DE LA PLANA", None, 100.0, 90.0, 150.0, 10.0, "Y"),
    (7, "Epsilon SL (en disolución)", None, "Peñíscola/Peniscola", 30, 700.0, 650.0, 70.0, 60.0, "Z"),
    (8, "Zeta SL", "z.example", "ONDA", 7, 700.0, 800.0, 105.0, 90.0, "Z"),
    (9, "!!!", None, "Nules", 7, 33.0, 30.0, 3.0, 2.0, "Z"),
    (10, "...", None, "   ", 7, 41.5, 30.0, 3.0, 2.0, "Z"),
]


@pytest.fixture(scope="session")
def source(spark):
    return spark.createDataFrame(COMPANIES, SOURCE_SCHEMA).cache()


@pytest.fixture(scope="session")
def cleaned(source):
    return clean_companies(source).cache()


@pytest.fixture(scope="session")
def quality(source):
    return quality_layer(source).cache()


@pytest.fixture(scope="session")
def quality_pandas(quality):
    return quality.orderBy("record_order").toPandas()
