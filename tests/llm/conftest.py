import os
import random

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver tables not present")
    return SF_DIR


def prose(seed, n, vocabulary=400):
    own = random.Random(seed)
    return " ".join(f"w{own.randrange(vocabulary)}" for _ in range(n))


# doc_id, text: copies, near copies, passages, odd texts.
def awkward_texts():
    long_text = prose(1, 4_000, 3_000)
    base = prose(2, 200)
    near = base.replace(base.split()[100], "changed", 1)
    passage = prose(3, 80)
    return [
        (1, base),
        (2, base),
        (3, near),
        (4, prose(4, 60) + "\n" + passage + "\n" + prose(5, 60)),
        (5, prose(6, 60) + "\n" + passage + "\n" + prose(7, 60)),
        (6, None),
        (7, ""),
        (8, " \n\t "),
        (9, long_text),
        (10, long_text + " tail"),
        (11, "echo " * 300),
        (12, "Ünïcödé ßtraße 日本語 \U0001f600 " * 20),
        (13, "one two three"),
        (14, "One TWO three"),
        (15, "<|endoftext|> it's \x01 odd's <b>"),
        (16, prose(8, 5)),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_texts(), "doc_id long, text string")


# Every operator must take these: a null id, a repeated row, columns with clashing names.
@pytest.fixture(scope="session")
def untidy(spark):
    rows = [(i, t, "en", "s", 1, "x", 2.0, 3, True) for i, t in awkward_texts()]
    rows += [(None, "no id here " * 30, None, None, None, None, None, None, None)]
    rows += [(1, rows[0][1], "en", "s", 1, "x", 2.0, 3, True)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, row string, score double, "
        "kept int, held_out boolean",
    )


@pytest.fixture(scope="session")
def nothing(untidy):
    return untidy.limit(0)
