"""Sources, pipeline and exports through files."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from companylens.__main__ import main
from companylens.plans import pipeline
from companylens.schema import MAPPING_COLUMNS, SOURCE_COLUMNS, SOURCE_SCHEMA, TABLE_NAMES
from companylens.sinks import export
from companylens.sources import companies
from companylens.sources.contracts import ContractError

HEADER = ",".join(SOURCE_COLUMNS)
GOOD = [
    '1,"ALPHA, ""THE"" SL",a.example,ONDA,46,5598.334472,5338.19636,1391.059758,1211.627052,HOLDING 02 SL',
    "2,BETA SL,,NULL,78,n/a,12.5,1e3,not a number,None",
    "3,GAMMA SL,c.example,  ONDA ,,NaN,-3,.5,7.,X",
]


def write_csv(path, lines, bom=False):
    path.write_text(("﻿" if bom else "") + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_standard_csv(spark, tmp_path):
    path = write_csv(tmp_path / "companies.csv", [HEADER, *GOOD])
    df = companies.load_source(spark, " Synthetic ", path)
    assert [(f.name, f.dataType) for f in df.schema] == [
        (f.name, f.dataType) for f in SOURCE_SCHEMA
    ]
    rows = {r.record_order: tuple(r)[1:] for r in df.collect()}
    assert rows[1] == ('ALPHA, "THE" SL', "a.example", "ONDA", 46, 5598.334472, 5338.19636,
                       1391.059758, 1211.627052, "HOLDING 02 SL")
    assert rows[2] == ("BETA SL", None, None, 78, None, 12.5, 1000.0, None, None)
    assert rows[3] == ("GAMMA SL", "c.example", "  ONDA ", None, None, -3.0, 0.5, 7.0, "X")


def test_line_breaks_in_quotes_need_multiline(spark, tmp_path):
    path = write_csv(tmp_path / "c.csv", [HEADER, '1,"TWO\nLINES SL",,ONDA,1,1,1,1,1,X'])
    assert companies.read_companies(spark, path, multiline=True).first().company_name == "TWO\nLINES SL"
    with pytest.raises(ContractError):
        companies.read_companies(spark, path)


@pytest.mark.parametrize(
    "lines, message",
    [
        ([HEADER.replace(",website", ""), "1,A,ONDA,1,1,1,1,1,X"], "Missing"),
        ([HEADER + ",extra", GOOD[0] + ",1"], "Unexpected"),
        (["company_name,record_order," + ",".join(SOURCE_COLUMNS[2:]), GOOD[1]], "order"),
        ([HEADER], "empty_source"),
        ([HEADER, GOOD[1], GOOD[1]], "repeated_record_order"),
        ([HEADER, "1,NA,,ONDA,1,1,1,1,1,X"], "missing_company_name"),
        ([HEADER, "x,A SL,,ONDA,1,1,1,1,1,X"], "missing_record_order"),
        ([HEADER, "1.5,A SL,,ONDA,1,1,1,1,1,X"], "whole numbers"),
        ([HEADER, "99999999999999999999,A SL,,ONDA,1,1,1,1,1,X"], "out of range"),
    ],
)
def test_rejected_files(spark, tmp_path, lines, message):
    path = write_csv(tmp_path / "bad.csv", lines)
    with pytest.raises(Exception, match=message):
        companies.read_companies(spark, path)


def test_long_keys_keep_every_digit(spark, tmp_path):
    keys = [9007199254740992, 9007199254740993, -9223372036854775808, 5, 1000]
    texts = [*map(str, keys[:3]), " +5 ", "1e3"]
    lines = [f"{k},A{i} SL,,ONDA,1.0,1,1,1,1,X" for i, k in enumerate(texts)]
    path = write_csv(tmp_path / "long.csv", [HEADER, *lines])
    rows = companies.read_companies(spark, path).collect()
    assert sorted(r.record_order for r in rows) == sorted(keys)
    assert {r.employees_latest for r in rows} == {1}


def test_header_of_every_file_counts(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write_csv(folder / "a.csv", [HEADER, GOOD[0]])
    write_csv(folder / "b.csv", [HEADER.replace("website,municipality", "municipality,website"), GOOD[1]])
    with pytest.raises(Exception):
        companies.read_companies(spark, str(folder)).collect()


def test_source_names(spark):
    assert companies.normalize_source_name("  REGISTER ") == "register"
    with pytest.raises(ContractError, match="Unsupported"):
        companies.normalize_source_name("other")
    with pytest.raises(TypeError):
        companies.normalize_source_name(3)


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_register_round_trip(spark, tmp_path, source, file_format):
    path = str(tmp_path / "register")
    companies.write_register(source, path, file_format)
    back = companies.load_source(spark, "register", path, file_format)
    assert back.columns == SOURCE_COLUMNS
    expected = sorted(tuple(r) for r in source.withColumn("municipality", F.nullif("municipality", F.lit(""))).collect())
    assert sorted(tuple(r) for r in back.collect()) == expected


def test_mapping_file(spark, tmp_path):
    path = write_csv(
        tmp_path / "mapping.csv", [",".join(MAPPING_COLUMNS), "AIN,AIN,AÍN,pending,rule,"], bom=True
    )
    assert [tuple(r) for r in companies.read_mapping(spark, path).collect()] == [
        ("AIN", "AIN", "AÍN", "pending", "rule", "")
    ]


@pytest.fixture(scope="module")
def result(source):
    return pipeline.run_stages(source)


def test_pipeline(result, quality):
    assert (result.row_count, result.final_column_count) == (10, 36)
    widths = [len(result.get_stage(s).columns) for s in ("source", "clean", "financial", "quality")]
    assert widths == [10, 16, 28, 36]
    assert tuple(result.tables) == TABLE_NAMES
    assert result.quality.schema.simpleString() == quality.schema.simpleString()
    assert sorted(map(str, result.quality.collect())) == sorted(map(str, quality.collect()))
    with pytest.raises(ContractError, match="No stage is called"):
        result.get_stage("raw")
    with pytest.raises(ContractError, match="No table is called"):
        result.get_table("raw")
    with pytest.raises(ContractError, match="positive"):
        pipeline.create_analytical_tables(quality, True)


def test_pipeline_is_deterministic(source, result):
    again = pipeline.run_stages(source)
    for name in TABLE_NAMES:
        assert again.get_table(name).collect() == result.get_table(name).collect()


def read_rows(path):
    part = next(p for p in path.iterdir() if p.name.startswith("part-"))
    return part.read_text(encoding="utf-8").splitlines()


def test_export(spark, tmp_path, result):
    target = tmp_path / "out"
    exported = export.export_result(result, str(target))
    assert exported.artifact_count == 10
    assert exported.get_artifact("coverage").endswith("/coverage")
    with pytest.raises(ContractError):
        exported.get_artifact("nothing")
    lines = read_rows(target / "coverage")
    assert lines[:2] == ["variable,available_records,missing_records,coverage_rate", "employees_latest,9,1,0.9"]
    company = [line for p in (target / export.COMPANY_LEVEL).glob("part-*")
               for line in p.read_text(encoding="utf-8").splitlines()[1:]]
    assert len(company) == 10 and any(",True," in line for line in company)
    manifest = {r.filename: r for r in exported.manifest.collect()}
    files = {
        f"{p.parent.name}/{p.name}": p
        for p in target.rglob("part-*") if p.parent.name != export.MANIFEST
    }
    assert set(manifest) == set(files)
    for name, path in files.items():
        content = path.read_bytes()
        assert manifest[name].size_bytes == len(content)
        assert manifest[name].sha256 == hashlib.sha256(content).hexdigest()
    metadata = json.loads(read_rows(target / export.RUN_METADATA)[0])
    assert (metadata["row_count"], metadata["final_column_count"]) == (10, 36)
    assert list(metadata) == sorted(metadata)

    with pytest.raises(FileExistsError):
        export.export_result(result, str(target), overwrite=False)
    again = export.export_result(result, str(target))
    tables = lambda e: [tuple(r) for r in e.manifest.collect() if "run_metadata" not in r.filename]
    assert tables(again) == tables(exported)


def test_overwrite_leaves_nothing_behind(spark, tmp_path, result):
    target = tmp_path / "out"
    export.export_result(result, str(target), include_company_level=True)
    (target / "old_table").mkdir()
    (target / "old_table" / "part-00000.csv").write_text("x")
    exported = export.export_result(result, str(target), include_company_level=False)
    left = {p.name for p in target.iterdir() if p.is_dir()}
    assert left == set(exported.artifacts)
    assert not {export.COMPANY_LEVEL, "old_table"} & left


def test_failed_export_leaves_the_earlier_one(spark, tmp_path, result, monkeypatch):
    target = tmp_path / "out"
    export.export_result(result, str(target))
    content = lambda: {p.relative_to(target): p.read_bytes() for p in target.rglob("*.csv")}
    before = content()

    def fail(*_):
        raise RuntimeError("stopped half-way")

    monkeypatch.setattr(export, "run_metadata", fail)
    with pytest.raises(RuntimeError, match="half-way"):
        export.export_result(result, str(target))
    assert content() == before and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_export_refuses_a_folder_that_is_none(spark, tmp_path, result):
    target = tmp_path / "photos"
    target.mkdir()
    (target / "holiday.csv").write_text("x")
    with pytest.raises(FileExistsError, match="no export"):
        export.export_result(result, str(target))
    assert (target / "holiday.csv").read_text() == "x"


def test_export_text_of_numbers(spark):
    numbers = [0.0, -0.0, 0.9, 1 / 3, -1234567.891234, 1e10, 123456789012.0, 0.00001234, 5e-324, 2.5, None]
    texts = ["0", "0", "0.9", "0.3333333333", "-1234567.891", "1e+10", "1.23456789e+11", "1.234e-05", None, "2.5", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    found = [r.x for r in export.csv_text(rows).orderBy(F.col("i").cast("int")).collect()]
    for text, expected, number in zip(found, texts, numbers, strict=True):
        assert number == 5e-324 or text == expected


def test_publication_guard(tmp_path, result):
    root = tmp_path / "reports"
    private = pipeline.PipelineResult("register", result.stages, result.tables)
    for path in (root, root / "tables" / "x", tmp_path / "a" / ".." / "reports" / "x"):
        with pytest.raises(ContractError, match="Private"):
            export.export_result(private, str(path), public_root=f"file://{root}")
    exported = export.export_result(private, str(tmp_path / "reports2"), public_root=str(root))
    assert export.COMPANY_LEVEL not in exported.artifacts
    with pytest.raises(ContractError, match="public_root"):
        export.export_result(private, str(tmp_path / "elsewhere"))
    with pytest.raises(ContractError, match="Private"):
        export.export_result(private, os.path.relpath(root / "x"), public_root=str(root))
    assert export._location(str(root)) == export._location(f"file://{root}/../reports")
    assert export.check_publication("register", str(root), str(root), True) == str(root)
    assert export.check_publication("synthetic", str(root), str(root)) == str(root)


def test_export_of_incomplete_result(result):
    partial = pipeline.PipelineResult("synthetic", result.stages, {})
    with pytest.raises(ContractError, match="tables"):
        export.validate_result(partial)
    with pytest.raises(TypeError):
        export.validate_result({})


def test_empty_table_is_refused(tmp_path, quality):
    with pytest.raises(ContractError):
        export.write_table_csv(quality.where("false"), str(tmp_path / "empty"))


def test_downloads(spark, tmp_path, quality):
    path = export.write_download(quality.select(SOURCE_COLUMNS), str(tmp_path / "csv"))
    assert sorted(companies.read_companies(spark, path).collect()) == sorted(
        quality.select(SOURCE_COLUMNS).withColumn("municipality", F.nullif("municipality", F.lit(""))).collect()
    )
    path = export.write_download(quality.select("record_order", "ebitda_margin"), str(tmp_path / "j"), "json")
    assert spark.read.json(path).count() == 10
    with pytest.raises(ContractError):
        export.write_download(quality, str(tmp_path / "x"), "xls")


def test_geographic_audit(spark, tmp_path, quality):
    export.export_geographic_audit(quality, str(tmp_path / "inventory"), str(tmp_path / "mapping"))
    assert len(read_rows(tmp_path / "inventory")) == 6
    mapping = companies.read_mapping(spark, str(tmp_path / "mapping"))
    assert mapping.count() == 5


def test_batch_job_starts_as_a_file():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for command in ([os.path.join(top, "run.py")], ["-m", "companylens"]):
        done = subprocess.run(
            [sys.executable, *command, "--help"], cwd=top, capture_output=True, text=True, timeout=120, check=False
        )
        assert done.returncode == 0 and "--public-root" in done.stdout


def test_batch_job(spark, tmp_path, capsys):
    path = write_csv(tmp_path / "companies.csv", [HEADER, *GOOD])
    main(["--path", path, "--output", str(tmp_path / "out"), "--ranking-size", "2"])
    assert "3 records, 10 artifacts" in capsys.readouterr().out
    assert len(read_rows(tmp_path / "out" / "company_ranking")) == 2
