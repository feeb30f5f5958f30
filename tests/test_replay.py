import datetime as dt

import pytest

from tausift.streaming.replay import file_stream, windowed_totals


@pytest.fixture
def parts(spark, tmp_path):
    """Six files, the newest day first."""
    for k in range(6):
        at = dt.datetime(2024, 3, 20) - dt.timedelta(days=10 * (k // 4), hours=k)
        spark.createDataFrame([(at, "a", 1), (at, "b", 2)], "ts timestamp, kind string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")


def test_windows_count_every_row_of_many_files(spark, parts):
    got = windowed_totals(spark, file_stream(spark, parts, 1), "ts", "kind", "v").groupBy("kind").sum("n", "total").collect()
    assert {tuple(r) for r in got} == {("a", 6, 6), ("b", 6, 12)}


def test_late_rows_are_dropped_on_request(spark, parts):
    got = windowed_totals(spark, file_stream(spark, parts, 1), "ts", "kind", "v", late="2 days").groupBy("kind").sum("n").collect()
    assert {tuple(r) for r in got} == {("a", 4), ("b", 4)}
