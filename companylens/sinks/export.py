"""Reproducible exports: CSV tables, run metadata and checksum manifest."""

from __future__ import annotations

import posixpath
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from companylens.functions.numeric import ten_digits
from companylens.operators.distributed import delete_path
from companylens.plans.pipeline import PipelineResult, run_counters, run_pipeline
from companylens.schema import SOURCE_COLUMNS, TABLE_NAMES
from companylens.sources.contracts import ContractError, require_rows

PUBLIC_SOURCE = "synthetic"
PRIVATE_SOURCE = "register"
COMPANY_LEVEL = "companies_quality_controlled"
RUN_METADATA = "run_metadata"
MANIFEST = "export_manifest"

# Tables whose number of rows is fixed by their definition: one file each.
FIXED_SIZE = {
    "scope_comparison",
    "coverage",
    "quality_summary",
    "revenue_concentration",
    "revenue_percentiles",
}
# Rows per exported file of the others: keeps every file small enough to be hashed.
ROWS_PER_FILE = 1_000_000


def csv_text(df: DataFrame) -> DataFrame:
    """Every column as export text: ten significant digits, ``True``/``False``."""

    def render(column: T.StructField) -> Column:
        value = F.col(column.name)
        if isinstance(column.dataType, (T.DoubleType, T.FloatType)):
            return ten_digits(value.cast("double"))
        if isinstance(column.dataType, T.BooleanType):
            return F.when(value, "True").when(~value, "False")
        return value.cast("string")

    return df.select(*[render(c).alias(c.name) for c in df.schema])


def name_files(spark: SparkSession, folder: str, extension: str) -> None:
    """Give a written folder's part files names that are the same in every run.

    Spark's names hold a random number. Their order is the order of the rows, and stays.
    Only names are touched, one by one.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(
        x.getPath().getName()
        for x in files.listStatus(path)
        if x.getPath().getName().startswith("part-")
    )
    for i, name in enumerate(names):
        new = f"part-{i:05d}.{extension}"
        old, target = (spark._jvm.org.apache.hadoop.fs.Path(path, n) for n in (name, new))
        if not files.rename(old, target):
            raise OSError(f"cannot rename {name} in {folder}")


def write_table_csv(
    df: DataFrame, path: str, small: bool = False, overwrite: bool = True
) -> str:
    """Write a table as UTF-8 CSV with header; an empty table is refused.

    Small tables are computed once and become one file. Others are written by all
    tasks, in files of bounded size. Files keep the order of the rows.
    """
    text = csv_text(df)
    if small:
        text = text.coalesce(1).persist()
    try:
        writer = (
            require_rows(text, f"export {path}")
            .write.mode("overwrite" if overwrite else "errorifexists")
            .option("header", True)
            .option("escape", '"')
            .option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .option("lineSep", "\n")
        )
        if not small:
            writer = writer.option("maxRecordsPerFile", ROWS_PER_FILE)
        writer.csv(path)
    finally:
        if small:
            text.unpersist()
    name_files(df.sparkSession, path, "csv")
    return path


def write_download(df: DataFrame, path: str, file_format: str = "csv") -> str:
    """Any table in full precision, as CSV or as JSON records, one per line."""
    if file_format == "csv":
        (
            df.write.mode("overwrite")
            .option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
        return path
    if file_format == "json":
        df.write.mode("overwrite").json(path)
        return path
    raise ContractError(f"Unsupported download format: {file_format!r}")


def run_metadata(result: PipelineResult) -> DataFrame:
    """One row that describes a run; fields in alphabetical order."""
    public = result.source_name == PUBLIC_SOURCE
    origin = (
        "All companies are made up; their figures describe no real region."
        if public
        else "Figures are each company's latest ones on file, which may be of different years."
    )
    limitations = [
        origin,
        "Not a basis for lending, investing or legal steps.",
        "Legal status is read from words in company names, not from a court register.",
    ]
    counters = run_counters(result.quality)
    return counters.select(
        F.lit(len(result.tables)).alias("analytical_table_count"),
        "business_risk_signal_count",
        F.lit(not public).alias("contains_licensed_data"),
        F.lit("thousand_eur").alias("currency_unit"),
        "data_quality_issue_count",
        F.lit("fully_synthetic" if public else "private_licensed_source").alias("dataset_type"),
        F.lit(result.final_column_count).alias("final_column_count"),
        F.lit(datetime.now(timezone.utc).isoformat()).alias("generated_at_utc"),
        F.array(*[F.lit(text) for text in limitations]).alias("limitations"),
        F.lit("companylens").alias("project"),
        F.lit(public).alias("public_distribution_allowed"),
        "row_count",
        F.lit(result.source_name).alias("source"),
        F.lit(len(SOURCE_COLUMNS)).alias("source_column_count"),
    )


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """All data files below a directory, as binary-file rows."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(directory)
    )


def create_manifest(spark: SparkSession, directory: str, artifacts: list[str]) -> DataFrame:
    """Name, size and SHA-256 of every exported file, hashed by the executors."""
    frames = []
    for artifact in artifacts:
        files = list_files(spark, posixpath.join(directory, artifact))
        frames.append(
            files.select(
                F.concat(
                    F.lit(f"{artifact}/"), F.element_at(F.split("path", "/"), -1)
                ).alias("filename"),
                F.col("length").alias("size_bytes"),
                F.sha2("content", 256).alias("sha256"),
            )
        )
    manifest = frames[0]
    for frame in frames[1:]:
        manifest = manifest.unionByName(frame)
    return manifest.orderBy("filename")


def has_files(spark: SparkSession, directory: str) -> bool:
    """Whether anything has been written below a directory."""
    try:
        return not list_files(spark, directory).select("path").isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def _location(path: str) -> tuple[str, str, str]:
    """Scheme, authority and plain path of a folder, as its store resolves it."""
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = urlsplit(files.makeQualified(target).toString())
    return parts.scheme, parts.netloc, posixpath.normpath("/" + parts.path.lstrip("/"))


def check_publication(
    source_name: str,
    directory: str,
    public_root: str | None,
    allow_private_public_export: bool = False,
) -> str:
    """Refuse to write private results below the public report tree.

    Without a stated tree nothing can be compared, so private results are refused too,
    unless ``allow_private_public_export`` is set.
    """
    if source_name == PRIVATE_SOURCE and not allow_private_public_export:
        if not public_root:
            raise ContractError(
                "Private results need public_root, the folder they must stay out of, "
                "or allow_private_public_export=True."
            )
        target, root = _location(directory), _location(public_root)
        below = target[2] == root[2] or target[2].startswith(root[2].rstrip("/") + "/")
        if target[:2] == root[:2] and below:
            raise ContractError(
                f"Private results must stay out of the public folder {public_root}; "
                "allow_private_public_export=True lifts this."
            )
    return directory.rstrip("/")


@dataclass(frozen=True)
class ExportResult:
    """Artifacts of one export."""

    source_name: str
    directory: str
    artifacts: tuple[str, ...]
    manifest: DataFrame

    @property
    def artifact_count(self) -> int:
        return len(self.artifacts)

    def get_artifact(self, name: str) -> str:
        if name not in self.artifacts:
            raise ContractError(f"Exported artifact not found: {name!r}")
        return posixpath.join(self.directory, name)


def validate_result(result: PipelineResult) -> None:
    """A result can be exported if it has records and exactly the seven tables."""
    if not isinstance(result, PipelineResult):
        raise TypeError("result must be a PipelineResult.")
    require_rows(result.quality, "export the result")
    if tuple(result.tables) != TABLE_NAMES:
        raise ContractError("Result does not contain the expected tables.")


def replace_folder(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished folder in the place of another one.

    The old folder is moved aside, and back again if the new one can't take its place. It is
    deleted when the new one stands.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, place = path(staged), path(target)
    aside = path(f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    had_one = files.exists(place)
    if had_one and not files.rename(place, aside):
        raise OSError(f"Could not move the earlier export aside: {target}")
    if not files.rename(new, place):
        if had_one:
            files.rename(aside, place)
        raise OSError(f"Could not put the export in place: {target}")
    if had_one:
        files.delete(aside, True)


def _write_artifacts(result: PipelineResult, folder: str, company_level: bool) -> list[str]:
    """Tables, optional company layer and metadata below ``folder``; the manifest comes last."""
    spark = result.quality.sparkSession
    # The tables are independent small jobs: submit a few at a time.
    with ThreadPoolExecutor(max_workers=4) as pool:
        written = pool.map(
            lambda name: write_table_csv(
                result.get_table(name), posixpath.join(folder, name), small=name in FIXED_SIZE
            ),
            TABLE_NAMES,
        )
        list(written)
    artifacts = list(TABLE_NAMES)
    if company_level:
        write_table_csv(result.quality, posixpath.join(folder, COMPANY_LEVEL))
        artifacts.append(COMPANY_LEVEL)
    metadata = posixpath.join(folder, RUN_METADATA)
    run_metadata(result).coalesce(1).write.json(metadata)
    name_files(spark, metadata, "json")
    artifacts.append(RUN_METADATA)
    manifest = posixpath.join(folder, MANIFEST)
    create_manifest(spark, folder, artifacts).write.json(manifest)
    name_files(spark, manifest, "json")
    return [*artifacts, MANIFEST]


def export_result(
    result: PipelineResult,
    directory: str,
    include_company_level: bool | None = None,
    overwrite: bool = True,
    public_root: str | None = None,
    allow_private_public_export: bool = False,
) -> ExportResult:
    """Write seven tables, optional company layer, metadata and manifest.

    Company-level rows are left out by default for private sources. Everything is written to
    a new folder beside the directory, the manifest last, and takes its place when complete: a
    run that fails leaves an earlier export as it was, one that succeeds leaves nothing of it.
    A directory that holds files is refused without ``overwrite``, and in any case if it has
    no manifest, as it is no export then.
    """
    validate_result(result)
    spark = result.quality.sparkSession
    target = check_publication(
        result.source_name, directory, public_root, allow_private_public_export
    )
    if has_files(spark, target):
        if not overwrite:
            raise FileExistsError(f"Export directory is not empty: {target}")
        if not has_files(spark, posixpath.join(target, MANIFEST)):
            raise FileExistsError(f"Directory holds files, but no export: {target}")
    if include_company_level is None:
        include_company_level = result.source_name == PUBLIC_SOURCE

    staged = f"{target.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        artifacts = _write_artifacts(result, staged, include_company_level)
        replace_folder(spark, staged, target)
    except BaseException:
        delete_path(spark, staged)
        raise
    manifest = spark.read.schema("filename string, size_bytes long, sha256 string")
    manifest = manifest.json(posixpath.join(target, MANIFEST)).orderBy("filename")
    return ExportResult(result.source_name, target, tuple(artifacts), manifest)


def run_and_export(
    spark: SparkSession,
    source: str,
    path: str,
    directory: str,
    file_format: str = "csv",
    ranking_size: int = 20,
    **options,
) -> tuple[PipelineResult, ExportResult]:
    """Pipeline run followed by its export."""
    result = run_pipeline(spark, source, path, file_format, ranking_size)
    return result, export_result(result, directory, **options)


def export_geographic_audit(
    quality: DataFrame, inventory_path: str, mapping_path: str
) -> tuple[DataFrame, DataFrame]:
    """Write the label inventory and the review template."""
    from companylens.operators.geography import (
        create_mapping_template,
        create_municipality_inventory,
    )

    inventory = create_municipality_inventory(quality)
    template = create_mapping_template(inventory)
    write_table_csv(inventory, inventory_path)
    write_table_csv(template, mapping_path)
    return inventory, template
