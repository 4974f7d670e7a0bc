"""Notifications and reply sheets as two streams: order of arrival, redelivery, replaced sheets."""

import datetime as dt
import itertools

import pytest

from tagbill.schemas import NOTIFICATION, REPLY_ROW
from tagbill.streaming import labor_replies as lr

T0 = dt.datetime(2024, 1, 1)
SUBJECT = "RE: " + lr.REPACK_SUBJECT + " "


def note(i, week, state=lr.CLIENT_STATE):
    return (str(i), state, SUBJECT + week, T0, None)


def row(run, week, laborers, day=1):
    return (run, "REPACK", None, str(laborers), "2", week, dt.datetime(2024, 1, day))


def land(spark, base, side, n, rows):
    spark.createDataFrame(rows, NOTIFICATION if side == "notes" else REPLY_ROW).coalesce(1).write.parquet(f"{base}/{side}/{n}")


def take_in(spark, base):
    return lr.run_reply_join(spark, f"{base}/notes/*", f"{base}/replies/*", f"{base}/out")


def labor(spark, dirs):
    return sorted((r.icrunidx, r.week_end, str(r.num_laborers)) for r in lr.joined_labor(spark, dirs["labor"]).collect())


@pytest.mark.parametrize("first", ["notes", "replies"])
def test_either_side_may_come_first(spark, tmp_path, first):
    base = str(tmp_path)
    notes = [note(1, "2024-01-07"), note(2, "2024-01-14"), note(3, "2024-01-21", "other"), note(4, "2024-01-07")]
    replies = [row(10, "2024-01-07", 3), row(11, "2024-01-07", 4), row(12, "2024-01-21", 5), row(13, "2024-02-04", 6)]
    later = "replies" if first == "notes" else "notes"
    rows = {"notes": notes, "replies": replies}
    land(spark, base, first, 0, rows[first])
    land(spark, base, later, 0, [])
    assert labor(spark, take_in(spark, base)) == []
    land(spark, base, later, 1, rows[later])
    assert labor(spark, take_in(spark, base)) == [(10, "2024-01-07", "3.0000"), (11, "2024-01-07", "4.0000")]
    # much later the other weeks' notifications come; a redelivery and a run without news change nothing
    land(spark, base, "notes", 2, [note(5, "2024-02-04"), note(1, "2024-01-07")])
    dirs = take_in(spark, base)
    want = [(10, "2024-01-07", "3.0000"), (11, "2024-01-07", "4.0000"), (13, "2024-02-04", "6.0000")]
    assert labor(spark, dirs) == want and labor(spark, take_in(spark, base)) == want
    log = sorted(r.message_id for r in spark.read.parquet(dirs["messages"]).collect())
    assert log == ["1", "2", "4", "5"]


def test_a_later_sheet_replaces_its_week(spark, tmp_path):
    base = str(tmp_path)
    land(spark, base, "notes", 0, [note(1, "2024-01-07")])
    land(spark, base, "replies", 0, [row(10, "2024-01-07", 3), row(11, "2024-01-07", 4)])
    take_in(spark, base)
    land(spark, base, "replies", 1, [row(10, "2024-01-07", 8, day=2)])
    assert labor(spark, take_in(spark, base)) == [(10, "2024-01-07", "8.0000")]


def test_many_epochs_log_each_message_once(spark, tmp_path):
    base = str(tmp_path)
    land(spark, base, "replies", 0, [row(1, "2024-01-07", 1)])
    for n, (a, b) in enumerate(itertools.pairwise(range(4))):
        land(spark, base, "notes", n, [note(a, "2024-01-07"), note(b, "2024-01-07")])
        dirs = take_in(spark, base)
    assert sorted(r.message_id for r in spark.read.parquet(dirs["messages"]).collect()) == ["0", "1", "2", "3"]
    assert labor(spark, dirs) == [(1, "2024-01-07", "1.0000")]
