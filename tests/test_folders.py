"""Folders of uploads: a header per file, one order over files, line breaks inside quotes over splits."""

import random

import pytest

from dairyframe.operators import herd
from dairyframe.sources import delimited, files as fl


def write(path, text, newline="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.replace("\n", newline).encode())


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_columns_follow_each_files_header(spark, tmp_path):
    write(tmp_path / "a.csv", "TestId,LactationYield\n1,10\n2,20\n")
    write(tmp_path / "b.csv", "LactationYield,TestId\n22,200\n")
    write(tmp_path / "sub dir" / "c[1].csv", "Farm;lactationyield;TestId;Note\nx;30,5;3;a,b\n", "\r\n")
    rows = fl.read_delimited(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.TestId, r.LactationYield) for r in rows] == [("1", "10"), ("2", "20"), ("200", "22"), ("3", "30,5")]
    assert rows[3].Farm == "x" and rows[0].Farm is None and rows[3].Note == "a,b"
    assert len({r.pos for r in rows}) == 4
    got = {r.test_id: r.yield_kg for r in fl.read_actual_yields(spark, str(tmp_path)).collect()}
    assert got == {"1": 10.0, "2": 20.0, "200": 22.0, "3": 30.5}


def test_a_folder_equals_the_union_of_its_files(spark, tmp_path):
    rnd = random.Random(3)
    layouts = [(["TestId", "DaysInMilk", "DailyMilkingYield", "Parity"], ","), (["Milk", "Lact", "DIM", "Cow_ID"], ";"), (["Parity", "TestId", "Milk_kg", "days in milk"], ";")]
    meaning = {"testid": 0, "cowid": 0, "cow_id": 0, "daysinmilk": 1, "dim": 1, "days in milk": 1, "dailymilkingyield": 2, "milk": 2, "milk_kg": 2, "parity": 3, "lact": 3}
    want = []
    for f in range(9):
        names, sep = layouts[f % 3]
        lines = [sep.join(names)]
        for _ in range(20):
            row = (str(rnd.randrange(30)), rnd.randrange(1, 300), rnd.randrange(10, 50), rnd.randrange(1, 5))
            want.append(row)
            lines.append(sep.join(str(row[meaning[n.lower()]]) for n in names))
        write(tmp_path / f"{f}.csv", "\n".join(lines) + "\n")
    got = fl.usable_test_days(fl.parse_test_day_files(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.test_id, r.dim, r.milk_kg, r.parity) for r in got] == [(i, d, float(m), p) for i, d, m, p in want]
    assert len(delimited.header_catalogue(spark, str(tmp_path))) == 3


def test_a_file_without_a_needed_column_is_named(spark, tmp_path):
    write(tmp_path / "a.csv", "TestId,LactationYield\n1,10\n")
    write(tmp_path / "bad.csv", "TestId,Weight\n1,10\n")
    with pytest.raises(ValueError, match=r"bad\.csv: missing required columns: yield_kg"):
        fl.read_actual_yields(spark, str(tmp_path))


def test_the_last_row_over_files_wins(spark, tmp_path, small_splits):
    for name, first in (("a", 0), ("b", 100_000), ("c", 200_000)):
        write(tmp_path / f"{name}.csv", "TestId,LactationYield\n" + "".join(f"{i % 5 + (name == 'b')},{first + i}\n" for i in range(8000)))
    rows = fl.read_delimited(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 6
    values = [float(r.LactationYield) for r in rows.orderBy("pos").collect()]
    assert values == sorted(values) and rows.select("pos").distinct().count() == 24_000
    good, _ = fl.read_submission(spark, str(tmp_path))
    assert {r.test_id: r.yield_kg for r in good.collect()} == {str(k): 207_995.0 + k for k in range(5)} | {"5": 107_999.0}


def test_quoted_line_breaks_over_splits(spark, tmp_path, small_splits):
    rnd = random.Random(9)
    cell = lambda: '"' + "".join(rnd.choice(["a", "ü", '""', "\n", ",", ";", " ", "\n\n"]) for _ in range(rnd.randrange(40))) + '"'
    for f in range(2):
        body = "".join(f"{f}-{i},{cell() if i % 3 else 'plain'},{cell()}\n" for i in range(3000))
        body += f'{f}-long,"' + "line\n" * 12_000 + '",end\n'
        write(tmp_path / f"{f}.csv", "TestId,Note,Rest\n" + body + f"{f}-last,x,y\n")
    plain = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"')
    rows = fl.read_delimited(spark, str(tmp_path), multi_line=True)
    assert rows.count() == plain.count() == 6004
    assert rows.drop("pos").exceptAll(plain).isEmpty() and plain.exceptAll(rows.drop("pos")).isEmpty()
    order = [r.TestId for r in rows.orderBy("pos").collect()]
    assert order[:3] == ["0-0", "0-1", "0-2"] and order[3000:3003] == ["0-long", "0-last", "1-0"]
    splits = delimited._written_lines(spark, str(tmp_path)).select("_file", "_start").distinct().count()
    assert splits > 8


def test_no_rows(spark, tmp_path):
    write(tmp_path / "a.csv", "TestId,LactationYield\n")
    write(tmp_path / "b.csv", "\n\n")
    assert fl.read_delimited(spark, str(tmp_path)).count() == 0
    assert fl.read_delimited(spark, str(tmp_path), multi_line=True).count() == 0
    assert fl.read_actual_yields(spark, str(tmp_path)).count() == 0


def test_upload_report(spark, tmp_path):
    lines = ["TestId,EventType,DaysInMilk,DailyMilkingYield,Parity", "1,,15,30,2", "1,,42,40,2", "2,MilkRecording,70,n/a,3", ",,10,25,3", "2,,38,35,3", "2,Calving,0,0,3", "3,,x,33,2", "3,,250,20,"]
    write(tmp_path / "a.csv", "\n".join(lines) + "\n")
    row = herd.upload_report(fl.parse_test_day_files(spark, str(tmp_path))).first()
    assert (row.row_count, row.other_events, row.rejected, row.usable, row.lactations) == (8, 1, 3, 4, 3)
    assert row.reasons == {"no_id": 1, "no_dim": 1, "no_milk": 1} and row.detected_parity == 2
    assert row.DaysInMilk == pytest.approx((28.5 + 38 + 250) / 3) and row.Achieved21Milk == pytest.approx((30 + 35) / 2)
    assert row.warnings[-1] == "3 rows could not be used." and any("fifth" in w for w in row.warnings)
    write(tmp_path / "a.csv", lines[0] + "\n")
    empty = herd.upload_report(fl.parse_test_day_files(spark, str(tmp_path))).first()
    assert empty.row_count == empty.lactations == 0 and empty.warnings == ["No usable record."] and empty.reasons == {}
