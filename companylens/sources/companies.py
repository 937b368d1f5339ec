"""Readers that all return the ten standard source columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from companylens.functions.numeric import nan_to_null
from companylens.schema import (
    INTEGER_COLUMNS,
    MAPPING_COLUMNS,
    MONEY_COLUMNS,
    SOURCE_COLUMNS,
    TEXT_COLUMNS,
)
from companylens.sources.contracts import (
    ContractError,
    require_exact_columns,
    require_rows,
    validate_source,
)

# Raw register header -> standard column.
REGISTER_HEADERS = {
    "Unnamed: 0": "record_order",
    "Nombre": "company_name",
    "Dirección web": "website",
    "Localidad": "municipality",
    "Ultimo número empleados": "employees_latest",
    "Ingresos de explotación\nmil EUR\nÚlt. año disp.": "operating_revenue_latest_k_eur",
    "Ingresos de explotación\nmil EUR\nAño - 1": "operating_revenue_previous_k_eur",
    "EBITDA\nmil EUR\nÚlt. año disp.": "ebitda_latest_k_eur",
    "EBITDA\nmil EUR\nAño - 1": "ebitda_previous_k_eur",
    "Nombre accionista": "shareholder_name",
}

# Texts that mean "missing"; compared exactly, without trimming.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
REGISTER_MISSING_TOKENS = MISSING_TOKENS + ["n.d.", "n.d", "N.D.", "N/D"]

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"
INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"

SOURCES = ("synthetic", "register")


def missing_to_null(column: Column, tokens: Sequence[str]) -> Column:
    """Text with missing-value tokens turned into null."""
    return F.when(~column.isin(list(tokens)), column)


def coerce_number(column: Column) -> Column:
    """Number from text; anything that is not a number becomes missing."""
    number = F.when(
        column.rlike(NUMBER) | column.rlike(INFINITY), column.try_cast("double")
    )
    return nan_to_null(number)


def coerce_integer(column: Column, name: str) -> Column:
    """Whole number; a fractional value breaks the contract."""
    return F.when(
        column != F.floor(column),
        F.raise_error(F.lit(f"Column must hold whole numbers: {name}")).cast("long"),
    ).otherwise(column.cast("long"))


def coerce_whole_text(column: Column, name: str) -> Column:
    """Whole number from text, exact to the last digit of a 64-bit integer.

    Digits never pass through a double; other notations (``1.0``, ``1e3``) do.
    """
    exact = F.trim(column).try_cast("long")
    too_large = F.raise_error(F.lit(f"Whole number out of range: {name}")).cast("long")
    return F.when(
        column.rlike(WHOLE_NUMBER), F.when(exact.isNull(), too_large).otherwise(exact)
    ).otherwise(coerce_integer(coerce_number(column), name))


def standardize_types(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Standard types for the ten source columns. Nothing is imputed."""

    def number(name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            return coerce_number(missing_to_null(F.col(name), tokens))
        return nan_to_null(F.col(name).cast("double"))

    columns = []
    for name in df.columns:
        if name in INTEGER_COLUMNS:
            kind = df.schema[name].dataType
            if isinstance(kind, T.IntegralType):
                whole = F.col(name).cast("long")
            elif isinstance(kind, T.StringType):
                whole = coerce_whole_text(missing_to_null(F.col(name), tokens), name)
            else:
                whole = coerce_integer(number(name), name)
            columns.append(whole.alias(name))
        elif name in MONEY_COLUMNS:
            columns.append(number(name).alias(name))
        elif name in TEXT_COLUMNS:
            columns.append(
                missing_to_null(F.col(name).cast("string"), tokens).alias(name)
            )
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def _text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _read_csv_text(
    spark: SparkSession, path: str, expected: Sequence[str], multiline: bool, ordered: bool
) -> DataFrame:
    """CSV with every column as text, after a check of its header."""
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("encoding", "UTF-8")
    )
    header = reader.csv(path).columns
    require_exact_columns(header, expected, ordered)
    # Types come by position, so every file's header is compared as well.
    return reader.schema(_text_schema(header)).option("enforceSchema", False).csv(path)


def read_companies(
    spark: SparkSession,
    path: str,
    file_format: str = "csv",
    multiline: bool = False,
    validate: bool = True,
) -> DataFrame:
    """Standardised company source from CSV or Parquet.

    ``multiline`` allows line breaks inside quoted fields; such files are read
    by one task each, so it is off unless asked for.
    """
    if file_format == "csv":
        df = _read_csv_text(spark, path, SOURCE_COLUMNS, multiline, ordered=True)
    elif file_format == "parquet":
        df = spark.read.parquet(path)
        require_exact_columns(df.columns, SOURCE_COLUMNS)
    else:
        raise ContractError(f"Unsupported file format: {file_format!r}")
    df = standardize_types(df)
    return validate_source(df) if validate else df


def read_register(
    spark: SparkSession, path: str, file_format: str = "csv", validate: bool = True
) -> DataFrame:
    """Raw register dump: localised headers and ``n.d.`` tokens.

    The headers contain line breaks, so CSV dumps are read in multi-line mode,
    one task per file; Parquet dumps are split as usual.
    """
    headers = list(REGISTER_HEADERS)
    if file_format == "csv":
        raw = _read_csv_text(spark, path, headers, multiline=True, ordered=False)
    elif file_format == "parquet":
        raw = spark.read.parquet(path)
        require_exact_columns(raw.columns, headers, ordered=False)
    else:
        raise ContractError(f"Unsupported file format: {file_format!r}")
    named = raw.withColumnsRenamed(REGISTER_HEADERS).select(*SOURCE_COLUMNS)
    df = standardize_types(named, REGISTER_MISSING_TOKENS)
    if validate:
        validate_source(require_rows(df, "load the register"))
    return df


def normalize_source_name(source: str) -> str:
    """Trimmed lower-case source name; unknown names are rejected."""
    if not isinstance(source, str):
        raise TypeError("source must be a string.")
    name = source.strip().lower()
    if name not in SOURCES:
        raise ContractError(f"Unsupported data source: {source!r}. Expected one of: {SOURCES}.")
    return name


def load_source(
    spark: SparkSession,
    source: str,
    path: str,
    file_format: str = "csv",
    validate: bool = True,
) -> DataFrame:
    """Read a named source into the ten standard columns."""
    reader = {"synthetic": read_companies, "register": read_register}[
        normalize_source_name(source)
    ]
    return reader(spark, path, file_format=file_format, validate=validate)


def write_register(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write standard columns as a raw register dump, missing values as ``n.d.``."""
    raw = df.select(
        *[
            F.coalesce(F.col(standard).cast("string"), F.lit("n.d.")).alias(header)
            for header, standard in REGISTER_HEADERS.items()
        ]
    )
    writer = raw.write
    if file_format == "csv":
        (
            writer.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    else:
        writer.format(file_format).save(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Municipality mapping from CSV; a byte-order mark is accepted."""
    df = _read_csv_text(spark, path, MAPPING_COLUMNS, multiline=False, ordered=True)
    return df.select(
        *[
            (F.coalesce(c, F.lit("")) if c == "notes" else F.col(c)).alias(c)
            for c in MAPPING_COLUMNS
        ]
    )
