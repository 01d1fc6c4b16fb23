import datetime as dt

import pytest

from strataprobe.errors import NoValidValues
from strataprobe.functions.names import suggests_time
from strataprobe.functions.temporal import format_of
from strataprobe.operators import temporal

START = dt.datetime(2024, 1, 1)


def times(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "ts timestamp")


@pytest.mark.parametrize(("name", "yes"), [("order_date", True), ("vendor", True), ("created_at", True), ("sold_on", True), ("ts", False), ("colour", False)])
def test_names(name, yes):
    assert suggests_time(name) is yes


@pytest.mark.parametrize(
    ("seconds", "name"),
    [(0.5, "sub-second"), (30, "second"), (600, "minute"), (3 * 3600, "hourly"), (2 * 86400, "daily"), (14 * 86400, "weekly/monthly"), (60 * 86400, "monthly+")],
)
def test_granularity(spark, seconds, name):
    df = times(spark, *[START + dt.timedelta(seconds=seconds * i) for i in range(7)], None)
    r = temporal.analyze_temporal_column(df, "ts").first()
    assert r.apparent_granularity == name and r.median_gap_us == seconds * 1e6 and (r.total, r.null_count) == (8, 1)


def test_equal_times_have_a_gap_of_zero(spark):
    assert temporal.analyze_temporal_column(times(spark, START, START, START), "ts").first().apparent_granularity == "sub-second"
    assert temporal.analyze_temporal_column(times(spark, START), "ts").first().apparent_granularity is None


@pytest.mark.parametrize("seed", range(3))
def test_median_gap_against_sorting(spark, seed):
    import random
    import statistics

    r = random.Random(seed)
    us = [r.choice([r.randrange(10**6), r.randrange(10**12), 77]) for _ in range(400)]
    want = statistics.median(b - a for a, b in zip(sorted(us), sorted(us)[1:], strict=False))
    df = times(spark, *[START + dt.timedelta(microseconds=u) for u in us])
    assert temporal.median_gap(df).first().median_gap_us == want


def test_texts(spark):
    good = spark.createDataFrame([("2012-06-19",), ("2012-06-21",), ("2012/06/22",), (None,)], "d string")
    r = temporal.analyze_temporal_column(good, "d").first()
    assert r.parse_success_rate == 0.5 and r.span_days == 2 and r.timezone == "none/naive"
    extent = temporal.checked_temporal_extent(good, "d")
    assert (extent["valid_timestamps"], extent["null_timestamps"], extent["duration_days"]) == (2, 2, 2)
    with pytest.raises(NoValidValues):
        temporal.checked_temporal_extent(spark.createDataFrame([("soon",)], "d string"), "d")


@pytest.mark.parametrize(("bad", "kind"), [(2, None), (1, "datetime_string")])
def test_parse_share(spark, bad, kind):
    rows = ["2020-01-01"] * (10 - bad) + ["x"] * bad
    assert temporal.detected_type(spark.createDataFrame([(r,) for r in rows], "d string"), "d") == kind


def test_formats():
    assert format_of("2024-02-01") == "yyyy-MM-dd" and format_of("02/03/2024") == "MM/dd/yyyy" and format_of("23/03/2024") == "dd/MM/yyyy"
    assert format_of("words") is None and format_of("") is None


def test_numbers_are_no_times_unless_asked(spark):
    years = spark.createDataFrame([(2008,), (2024,)], "year long")
    assert temporal.temporal_extent(years, "year").first().valid_timestamps == 0
    assert temporal.temporal_extent(years, "year", numeric_epoch_ns=True).first().start_ts.year == 1970


def test_detection_and_records(spark):
    df = spark.createDataFrame([(START, "a", 1), (START + dt.timedelta(days=400), "b", 2), (None, "c", 3)], "ts timestamp, vendor string, n long")
    found = {r.field: (r.name_suggests_temporal, r.detected_type) for r in temporal.detect_temporal_columns(df).collect()}
    assert found == {"ts": (False, "datetime64"), "vendor": (True, None)}
    assert [(r.year, r.n) for r in temporal.records_by(df, "ts").collect()] == [(2024, 1), (2025, 1)]
    assert temporal.records_by(df.limit(1), "ts").count() == 0
    empty = temporal.temporal_extent(df.limit(0), "ts").first()
    assert empty.total_records == 0 and empty.start_ts is None


def test_one_unreadable_value_costs_only_itself(spark):
    rows = [f"2024-03-{i:02d}" for i in range(1, 9)] + ["-"]
    df = spark.createDataFrame([(r,) for r in rows], "d string")
    assert temporal.temporal_extent(df, "d").first().valid_timestamps == 8
    assert {(r.month, r.n) for r in temporal.records_by(df, "d", "month").collect()} == {(3, 8)}


def test_outliers_leave_the_cells_even(spark):
    """Two times far out put no more than their share of the others in one cell."""
    import statistics

    us = [i * 7_000_000 for i in range(3000)]
    times_ = [dt.datetime(1, 1, 2), *[START + dt.timedelta(microseconds=u) for u in us], dt.datetime(9999, 12, 30)]
    df = times(spark, *times_)
    gaps = [(b - a) / dt.timedelta(microseconds=1) for a, b in zip(times_, times_[1:], strict=False)]
    assert temporal.median_gap(df).first().median_gap_us == statistics.median(gaps)
