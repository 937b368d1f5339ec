import decimal
import math
import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from companylens.functions import text
from companylens.sinks.export import csv_text


def evaluate(spark, expression, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "expression, raw, expected",
    [
        (text.normalize_whitespace, "  COMPANY   NAME\n  SOCIEDAD  ", "COMPANY NAME SOCIEDAD"),
        (text.normalize_whitespace, "a b \x1cc", "a b c"),
        (text.normalize_whitespace, "one two", "one two"),
        (text.normalize_whitespace, None, None),
        (text.normalize_company_name, "  Cerámica Álvarez, S.L.  ", "CERAMICA ALVAREZ S L"),
        (text.normalize_company_name, "Straße № 5 ﬁn", "STRASSE NO 5 FIN"),
        (text.extract_legal_status, "EMPRESA SL (EXTINGUIDA)", "extinct"),
        (text.extract_legal_status, "EMPRESA SA (extinguido)", "extinct"),
        (text.extract_legal_status, "X (EN LIQUIDACIÓN)", "in_liquidation"),
        (text.extract_legal_status, "X (EN  LIQUIDACION)", "in_liquidation"),
        (text.extract_legal_status, "X (EN DISOLUCIÓN)", "in_dissolution"),
        (text.extract_legal_status, "EXTINGUIDA Y EN LIQUIDACION", "in_liquidation"),
        (text.extract_legal_status, "TREN LIQUIDACIONES SL", "no_adverse_marker"),
        (text.extract_legal_status, "EMPRESA EJEMPLO SL", "no_adverse_marker"),
        (text.extract_legal_status, None, "unknown"),
        (text.clean_shareholder, "There is no  shareholders information for this company", None),
        (text.clean_shareholder, "  COMPANY HOLDING SL  ", "COMPANY HOLDING SL"),
        (text.create_company_match_key, "COMPACGLASS SL", "COMPACGLASS SL"),
        (text.create_company_match_key, "COMPACGLASS SL (EXTINGUIDA)", "COMPACGLASS SL"),
        # The first cut joins the words of the next marker.
        (text.create_company_match_key, "A EN EXTINGUIDA LIQUIDACION B", "A B"),
        (text.create_company_match_key, "(EXTINGUIDA)", ""),
        (text.normalize_geographic_text, "  Castelló   de la Plana ", "CASTELLÓ DE LA PLANA"),
        (text.normalize_geographic_text, "   ", None),
        (text.normalize_geographic_text, None, None),
        (text.remove_accents, "CASTELLÓ PEÑÍSCOLA", "CASTELLO PENISCOLA"),
        (text.create_municipality_match_key, "Castelló de la Plana", "CASTELLO DE LA PLANA"),
        (text.create_municipality_match_key, "Peñíscola/Peniscola", "PENISCOLA PENISCOLA"),
        (text.create_municipality_match_key, "L'Alcora", "L ALCORA"),
        (text.create_municipality_match_key, "---", ""),
    ],
)
def test_examples(spark, expression, raw, expected):
    assert evaluate(spark, expression, [raw]) == [expected]


def plain(value):
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


def name(value):
    value = plain(re.sub(r"\s+", " ", value).strip()).upper()
    return re.sub(r"\s+", " ", re.sub(r"[^A-Z0-9\s]", " ", value)).strip()


def test_accents_over_every_assigned_character(spark):
    characters = [
        chr(c) for c in range(1, 0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")
    ]
    values = ["".join(characters[i : i + 50]) for i in range(0, len(characters), 50)]
    assert evaluate(spark, text.remove_accents, values) == [plain(v) for v in values]
    assert evaluate(spark, text.normalize_company_name, values) == [name(v) for v in values]


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00")), min_size=20))
def test_names_like_plain_python(spark, values):
    assert evaluate(spark, text.normalize_company_name, values) == [name(v) for v in values]


def test_labels(spark):
    shares = [0.12, -0.034, 12.3456]
    assert evaluate(spark, lambda c: text.percent_label(c, signed=True), shares, "double") == [
        "+12.0%", "-3.4%", "+1,234.6%",
    ]
    assert evaluate(spark, text.thousands_label, [1234.56], "double") == ["€1,234.6k"]
    assert evaluate(spark, text.percentile_label, [0.29, 0.5, 0.999], "double") == [
        "P28", "P50", "P99",
    ]


def half_up(value):
    """Ten significant digits of the shortest decimal text of a double, ties away from zero."""
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    exact = decimal.Decimal(repr(value))
    if not exact:
        return "0"
    unit = decimal.Decimal(1).scaleb(exact.adjusted() - 9)
    rounded = exact.quantize(unit, decimal.ROUND_HALF_UP)
    exponent = rounded.adjusted()
    if -4 <= exponent <= 9:
        text = f"{rounded:f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    digits = f"{rounded.scaleb(-exponent):.9f}".rstrip("0").rstrip(".")
    return f"{digits}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"


def test_export_digits(spark):
    """Ten digits, half up; the notation follows the rounded value."""
    random.seed(11)
    known = {
        1.0: "1", 0.0: "0", 100.0: "100", 30615.704251234: "30615.70425", 1e9: "1000000000",
        9999999999.4: "9999999999", 9999999999.5: "1e+10", 9999999999.9: "1e+10",
        0.00009999999999999: "0.0001", 0.000099999999994: "9.999999999e-05", 1.5e-5: "1.5e-05",
        1234567890.5: "1234567891", 1234567889.5: "1234567890", 1e300: "1e+300", -1e-300: "-1e-300",
        math.inf: "inf", -math.inf: "-inf",
    }
    values = list(known)
    for _ in range(3000):
        digits = random.randrange(10**9, 10**10) * 10 + 5
        values.append(float(f"{random.choice(['', '-'])}{digits}e-{random.randrange(1, 15)}"))
        values.append(random.randrange(2**34) / 2 ** random.randrange(1, 12))
        values.append(random.gauss(0, 1) * 10 ** random.randrange(-6, 12))
    df = spark.createDataFrame([(v,) for v in values] + [(math.nan,), (None,)], "v double")
    texts = [r[0] for r in csv_text(df).collect()]
    assert texts[: len(known)] == list(known.values())
    assert texts == [half_up(v) for v in values] + [None, None]
