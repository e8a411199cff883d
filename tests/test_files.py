"""Real files: encodings, delimiters, broken documents, and round trips."""

import gzip
import json

import pytest
from conftest import by_id
from pyspark.errors import PySparkException

from dairyframe.operators import alignment as al, herd
from dairyframe.sources import files as fl, sinks


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


EXPORT = """TestId,TestDate,EventType,CalvingDate,BirthDate,Parity,DaysInMilk,DailyMilkingYield
1,2024-01-15,MilkRecording,,,2,15,30
1,2024-02-11,MilkRecording,,,2,42,40
1,2024-03-10,MilkRecording,,,2,70,38
2,2024-01-10,MilkRecording,,,3,10,25
2,2024-02-07,MilkRecording,,,3,38,35
2,2024-03-06,MilkRecording,,,3,66,33
1,2024-01-01,Calving,,,2,0,0
"""


@pytest.mark.parametrize("bom", ["", "﻿"])
def test_test_day_upload(spark, tmp_path, bom):
    path = write(tmp_path / "up.csv", bom + EXPORT)
    parsed = fl.parse_test_day(fl.read_delimited(spark, path))
    rows = fl.usable_test_days(parsed)
    assert rows.count() == 6 and parsed.filter("not event_ok").count() == 1
    stats = herd.herd_stats_summary(rows).collect()[0]
    assert stats["AchievedMilk"] == pytest.approx(2089.5)
    assert by_id(al.first_attr(rows), "parity") == {"1": 2, "2": 3}


def test_row_cap_keeps_the_head(spark, tmp_path):
    path = write(tmp_path / "up.csv", EXPORT)
    assert [r["DaysInMilk"] for r in fl.read_delimited(spark, path, max_rows=2).collect()] == ["15", "42"]


def test_positions_follow_the_file_across_splits(spark, tmp_path):
    path = write(tmp_path / "long.csv", "TestId,LactationYield\n" + "".join(f"{i % 7},{i}\n" for i in range(60000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = fl.read_delimited(spark, path)
        assert rows.rdd.getNumPartitions() > 3
        got = by_id(fl.parse_actual_yields(rows), "yield_kg")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {str(k): max(i for i in range(60000) if i % 7 == k) for k in range(7)}


def test_herd_software_export(spark, tmp_path):
    text = "ID; TestDate; DIM; MILK; PCTF; 305ME;\n 11 ;x;30; 80,5*;4,1; 23000 ;\n 11 ;x;60; 70 ;4,1; 23500* ;\n 12 ;x;40;55*;3,9; 20200;\n 12 ;x;70;0;3,9;;\n"
    raw = fl.read_delimited(spark, write(tmp_path / "herd.csv", text))
    rows = fl.parse_herd_export(raw)
    assert rows.count() == 3
    direct = by_id(herd.latest_direct_value(rows), "direct_kg")
    assert direct == {"11": pytest.approx(23500 * 0.45359237), "12": pytest.approx(20200 * 0.45359237)}
    assert al.detect_format(raw.columns, allow_herd_export=True)[0] == "herd_export"
    with pytest.raises(ValueError):
        al.detect_format(raw.columns)


def test_aggregated_file(spark, tmp_path):
    text = "Achieved21Milk,305Milk,Notes\n20,8000,a\n30,10000,b\n,bad,c\n"
    row = fl.parse_aggregated(fl.read_delimited(spark, write(tmp_path / "agg.csv", text))).collect()[0]
    assert (row["Achieved21Milk"], row["Achieved305Milk"]) == (25.0, 9000.0)
    assert (row["Achieved21Milk_bad"], row["Achieved305Milk_bad"]) == (1, 1)


def test_submission(spark, tmp_path):
    good, failed = fl.parse_submission(fl.read_delimited(spark, write(tmp_path / "s.csv", "TestId;LactationYield\n1;8000,5\n2;oops\n1;8100\n")))
    assert by_id(good, "yield_kg") == {"1": 8100.0} and [r["test_id"] for r in failed.collect()] == ["2"]
    share = al.failure_threshold(good, failed).collect()[0]
    assert (share["total"], share["failed"], share["accepted"]) == (2, 1, False)
    bad, _ = fl.parse_submission(fl.read_delimited(spark, write(tmp_path / "n.csv", "TestId,LactationYield\n1,-5\n")))
    with pytest.raises(PySparkException, match="negative yield"):
        bad.collect()


def test_benchmark_records_and_export(spark, tmp_path):
    text = "id;lact;herd;dim;milk\n A ;;5;40;30,127\nA;2;;10;25\nB;1;;20;0\nB;1;;x;9\n"
    records = fl.benchmark_lactations(fl.parse_benchmark_test_day(fl.read_delimited(spark, write(tmp_path / "b.csv", text))))
    row = records.collect()[0]
    assert records.count() == 1 and (row["test_id"], row["parity"], row["herd_id"]) == ("A", 2, 5)
    assert row["dim"] == [10, 40] and row["milk_kg"] == [25.0, 30.13]
    assert sinks.export_rows(records, herd=True).columns == ["TestId", "herd_id", "parity", "dim", "milk_kg"]
    assert sinks.export_rows(records, herd=False).columns == ["TestId", "parity", "dim", "milk_kg"]
    with pytest.raises(ValueError):
        fl.parse_benchmark_test_day(spark.createDataFrame([("1", 0)], "id string, pos bigint"))


def test_binary_files_are_set_apart(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "ok.csv").write_bytes(b"TestId,dim\n1,2\n")
    (tmp_path / "a" / "nul.csv").write_bytes(b"abc\x00def")
    (tmp_path / "a" / "ctl.csv").write_bytes(b"\x01\x02\x03abc")
    (tmp_path / "a" / "empty.csv").write_bytes(b"")
    files = fl.read_files(spark, str(tmp_path), pattern="*.csv")
    good, bad = fl.split_binary(files)
    # Spark does not list empty files, and an empty upload holds nothing to read
    assert {r["filename"] for r in good.collect()} == {"ok.csv"}
    assert {r["filename"] for r in bad.collect()} == {"nul.csv", "ctl.csv"}
    assert {r["label"] for r in files.select("label").collect()} == {"a"}
    assert fl.read_files(spark, str(tmp_path), path_part="nul").select("size").collect()[0]["size"] == 7


def test_lactation_documents(spark, tmp_path):
    document = {"animal_id": "CX123", "parity": 2, "herd_id": 2942694, "milk": [None, 30.5], "events": ["calving"]}
    (tmp_path / "animal_001.json").write_text(json.dumps(document, indent=1))
    (tmp_path / "animal_002.json").write_text("{ broken")
    (tmp_path / "other.json").write_text(json.dumps(document))
    rows = fl.read_lactation_json(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["milk"] == [None, 30.5] and rows[0]["herd_id"] == 2942694


def test_preset_document(spark, tmp_path):
    cows = [{"cow_id": "1", "display_name": "Cow 1", "parity": 1, "dim": [5, 35], "milk_kg": [20.0, 30.0]}]
    document = {"dataset": "d", "size": "full", "period": "all", "cow_count": 1, "cows": cows, "actual_yields": {"1": 9000.5}}
    presets = fl.read_presets(spark, write(tmp_path / "p.json", json.dumps(document, indent=2)))
    assert fl.preset_cows(presets).collect()[0]["dim"] == [5, 35]
    assert by_id(fl.preset_yields(presets), "yield_kg") == {"1": 9000.5}


def test_gzip_payload_counts(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1, 2]), (None, [3])], "test_id int, dim array<int>")
    assert sinks.write_json_gzip(frame, str(tmp_path / "out"), record_id="test_id") == {"row_count": 2, "record_count": 1}
    lines = [line for f in (tmp_path / "out").glob("*.gz") for line in gzip.open(f, "rt")]
    assert len(lines) == 2


def test_header_resolution():
    assert al.resolve_columns(["animalid", "dim", "milk_yield"]) == {"DaysInMilk": "dim", "MilkingYield": "milk_yield", "TestId": "animalid"}
    assert al.resolve_columns(["Cow ID", "Days in Milk", "Milk Yield (kg)"])["MilkingYield"] == "Milk Yield (kg)"
    assert al.resolve_columns(["x", "dim", "milk"], overrides={"TestId": "X"})["TestId"] == "x"
    for columns, kwargs in ((["dim"], {}), (["dim", "milk"], {"require_test_id": True}), (["dim", "milk"], {"overrides": {"TestId": "no"}})):
        with pytest.raises(ValueError):
            al.resolve_columns(columns, **kwargs)


def test_formats_and_mappings():
    exact = ["TestId", "DaysInMilk", "DailyMilkingYield"]
    assert al.detect_format(exact)[0::2] == ("test_day", False)
    assert al.detect_format(["Cow", "DIM", "Milk"])[0::2] == ("test_day", True)
    assert al.detect_format(["Achieved305Milk"])[0] == "aggregated"
    with pytest.raises(ValueError):
        al.detect_format(["a", "b"])
    assert al.upload_mapping(["A", "B"], {"dim": "a", "milk_kg": "b"}) == ({"dim": "A", "milk_kg": "B"}, False)
    with pytest.raises(ValueError, match="says nothing about milk_kg"):
        al.upload_mapping(["A"], {"dim": "A"})
    with pytest.raises(ValueError, match="no such header: dim"):
        al.upload_mapping(["A"], {"dim": "Z"})


def test_standardize_defaults(spark):
    frame = spark.createDataFrame([(305, 1.0), (306, 2.0), (None, 3.0)], "dim int, milk double")
    assert [tuple(r) for r in al.standardize_columns(frame).collect()] == [(305, 1.0, 0)]
    assert al.standardize_columns(frame, max_dim="max").count() == 3


def test_options():
    assert al.check_options(breed="h", milk_unit="LB") == {"breed": "H", "milk_unit": "lb"}
    with pytest.raises(ValueError):
        al.check_options(continent="ASIA")
