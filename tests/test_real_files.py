"""Cases that real uploads bring: quotes, bad cells, days written twice, long lactations."""

import pytest

from dairyframe.functions import arrays as ar, curves, text as tx
from dairyframe.operators import alignment as al, lookups
from dairyframe.sources import files
from pyspark.sql import functions as F


def test_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('TestId,Note\n1,"say ""hi"", ok"\n2,"a\nb"\n')
    rows = files.read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True).collect()
    assert [(r.TestId, r.Note) for r in rows] == [("1", 'say "hi", ok'), ("2", "a\nb")]


def test_cells_out_of_range_are_null(spark):
    df = spark.createDataFrame([("99999999999",), ("1e30",), ("12.7",)], "v string")
    got = df.select(tx.whole(tx.to_number(F.col("v"))).alias("w"), lookups.as_int(F.col("v")).alias("i")).collect()
    assert [(r.w, r.i) for r in got] == [(None, 99999999999), (None, None), (12, 12)]


def test_bad_parity_and_day_drop_the_row(spark):
    columns = "cow_id string, parity string, dim string, milk_lb string, test_date string, birth_date string, pos long"
    rows = [("7", "x", "5", "10", None, None, 0), ("7", "1", "abc", "10", None, None, 1), ("7", "1", "5", "10", None, None, 2)]
    assert [r.dim for r in al.build_lactations(spark.createDataFrame(rows, columns)).collect()] == [[5]]


def test_last_record_of_a_day_wins(testdays):
    rows = testdays([(1, 5, 30.0), (1, 5, 10.0), (1, 9, 4.0)])
    daily = al.last_of_day(rows).select(ar.project_daily(F.col("dim"), F.col("milk_kg")).alias("milk")).first()["milk"]
    assert (daily[4], daily[8], sum(daily)) == (10.0, 4.0, 14.0)


def test_a_long_lactation_is_one_row(testdays):
    rows = testdays([(1, d % 400, d / 7) for d in range(12_000)])
    nested = al.nest_lactation(rows).collect()
    assert len(nested) == 1 and len(nested[0]["dim"]) == 12_000
    assert al.cap_payload(rows.selectExpr("test_id", "pos AS first_pos")).count() == 12_000


def test_day_zero_has_no_ali_schaeffer_value(spark):
    params = curves.Params(*[F.lit(1.0) for _ in curves.PARAMETERS])
    df = spark.createDataFrame([(0.0,), (10.0,)], "t double")
    got = [r.y for r in df.select(curves._ali_schaeffer(F.col("t"), params).alias("y")).collect()]
    assert got[0] is None and got[1] is not None


def test_mappings_name_what_is_missing():
    with pytest.raises(ValueError, match="milk_kg"):
        al.upload_mapping(["Day"], {"dim": "Day"})
    with pytest.raises(ValueError, match="Weight"):
        al.upload_mapping(["Day"], {"dim": "Day", "milk_kg": "Weight"})
