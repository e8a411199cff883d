"""Hand-computed yields, and results that must not depend on order, partitions or hot keys."""

import random

import pytest
from conftest import by_id

from dairyframe.operators import alignment as al, herd, yields

CASES = {
    1: ([(10, 30), (40, 25)], 7775),
    2: ([(5, 25), (35, 30), (65, 28)], 8568),
    3: ([(10, 32), (80, 38), (150, 34), (220, 28)], 9868),
    4: ([(50, 30)], None),
}


def records(cases):
    return [(i, d, m) for i, (days, _) in cases.items() for d, m in days]


def test_interval_hand_values(testdays):
    got = by_id(yields.test_interval_yield(testdays(records(CASES))), "yield_kg")
    assert set(got) == {1, 2, 3}
    for i in got:
        assert got[i] == pytest.approx(CASES[i][1], rel=1e-9)


def test_interval_edge_cases(testdays):
    rows = [(1, 10, 30), (1, 40, 0), (1, 70, 25)]
    rows += [(2, 10, 30), (2, 40, 35), (2, 40, 36), (2, 70, 32)]
    rows += [(3, 10, 30), (3, 40, None), (3, None, 35), (3, 70, 32)]
    rows += [(4, 10, 30), (4, 306, 20), (4, 400, 10)]
    got = by_id(yields.test_interval_yield(testdays(rows)), "yield_kg")
    assert got[1] >= 0
    # the repeated day is entered at 35 and left at 36
    assert got[2] == pytest.approx(10 * 30 + 30 * 32.5 + 30 * 34 + 236 * 32)
    # a missing yield leaves out both of its trapezoids
    assert got[3] == pytest.approx(10 * 30 + 236 * 32)
    assert 4 not in got


def test_observed_and_herd_mean(testdays, spark):
    rows = [(1, 15, 30), (1, 42, 40), (1, 70, 38), (2, 10, 25), (2, 38, 35), (2, 66, 33)]
    frame = testdays(rows)
    assert by_id(yields.trapezoid_observed(frame), "yield_kg") == {1: 2262.0, 2: 1917.0}
    row = herd.herd_stats_summary(frame).collect()[0]
    assert row["AchievedMilk"] == pytest.approx(2089.5)
    assert row["DaysInMilk"] == pytest.approx((127 / 3 + 114 / 3) / 2)


def test_capped_rules(testdays):
    # straddling segment cut at 305, last yield held to 305, and a first record beyond the cap
    rows = [(1, 100, 30), (1, 400, 15), (2, 100, 30), (2, 200, 20), (3, 310, 31), (3, 320, 30)]
    got = by_id(yields.trapezoid_capped(testdays(rows)), "yield_kg")
    at_cap = 30 + 205 / 300 * (15 - 30)
    assert got[1] == pytest.approx(100 * 15 + (30 + at_cap) / 2 * 205)
    assert got[2] == pytest.approx(1500 + 2500 + 105 * 20)
    assert got[3] == pytest.approx(0.5 * (305 / 310 * 31) * 305)


def test_direct_values_win_when_enough_have_them(testdays, spark):
    frame = testdays([(1, 20, 30), (1, 60, 32), (2, 20, 28), (2, 60, 29)])
    both = spark.createDataFrame([(1, 9000.0), (2, 8000.0)], "test_id bigint, direct_kg double")
    row = herd.herd_stats_summary(frame, both).collect()[0]
    assert row["direct_305"] and row["Achieved305Milk"] == pytest.approx(8500)
    none = spark.createDataFrame([(1, None), (2, None)], "test_id bigint, direct_kg double")
    assert not herd.herd_stats_summary(frame, none).collect()[0]["direct_305"]


def brute_interval(rows):
    """Plain re-computation, record by record in (day, position) order."""
    out = {}
    for i in {r[0] for r in rows}:
        days = sorted((d, p, m) for p, (j, d, m) in enumerate(rows) if j == i and d <= 305)
        if len(days) < 2:
            continue
        area = sum((b[0] - a[0]) * (a[2] + b[2]) / 2 for a, b in zip(days, days[1:]))
        out[i] = days[0][0] * days[0][2] + area + (306 - days[-1][0]) * days[-1][2]
    return out


@pytest.fixture(scope="module")
def hot_rows():
    """A third of all records belong to one lactation, with every day repeated many times."""
    rng = random.Random(5)
    rows = [(7, rng.randint(1, 330), rng.randint(1, 50)) for _ in range(3000)]
    rows += [(rng.randint(100, 900), rng.randint(1, 330), rng.randint(1, 50)) for _ in range(6000)]
    rng.shuffle(rows)
    return rows


def test_hot_lactation_is_exact(testdays, hot_rows):
    got = by_id(yields.test_interval_yield(testdays(hot_rows)), "yield_kg")
    want = brute_interval(hot_rows)
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-12) for i in want)


def test_partitioning_and_unrelated_rows_change_nothing(testdays, hot_rows):
    frame = testdays(hot_rows[:2000])
    base = by_id(yields.test_interval_yield(frame), "yield_kg")
    spread = by_id(yields.test_interval_yield(frame.repartition(13, "dim")), "yield_kg")
    assert base == spread
    more = by_id(yields.test_interval_yield(testdays(hot_rows[:2000] + [(99999, 10, 1), (99999, 20, 2)])), "yield_kg")
    more.pop(99999)
    assert base == more


def test_nesting_keeps_every_record_in_order(testdays, hot_rows):
    nested = al.nest_lactation(testdays(hot_rows)).collect()
    assert sorted(r["test_id"] for r in nested) == sorted({i for i, _, _ in hot_rows})
    for row in nested:
        got = list(zip(row["dim"], row["milk_kg"]))
        assert got == sorted((d, float(m)) for j, d, m in hot_rows if j == row["test_id"])


def test_nesting_in_file_order(testdays):
    rows = [(1, 5, 30), (1, 5, 20), (1, 2, 9), (1, 5, 30)]
    row = al.nest_lactation(testdays(rows), order="pos").collect()[0]
    assert row["dim"] == [2, 5, 5, 5] and row["milk_kg"] == [9.0, 30.0, 20.0, 30.0]


def test_ranges_clamp():
    assert herd.STAT_NAMES[0] == "Achieved21Milk" and len(herd.STAT_NAMES) == 10


def test_normalize_requires_all_when_asked(spark):
    frame = spark.createDataFrame([(25.0, 700.0)], "Achieved21Milk double, DaysInMilk double")
    row = herd.normalize_stats(frame).collect()[0]
    assert row["Achieved21Milk"] == 0.5 and row["DaysInMilk"] == 1.0
    with pytest.raises(ValueError):
        herd.normalize_stats(frame, require_all=True)
