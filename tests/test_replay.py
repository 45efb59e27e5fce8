"""Followers of an event log that stop, resume, fail and come too late."""

import pytest

from corvane.streaming.replay import EventLog, OffsetLost


@pytest.fixture()
def log(spark, tmp_path):
    return EventLog(spark, f"file://{tmp_path}/log", segment=10)


def add(log, low, high):
    log.append(log.spark.createDataFrame([(s, k, f"{s}{k}") for k in range(low, high) for s in ("a", "b")], "stream string, seq long, payload string"))


def test_events_after_a_number(log):
    assert log.after("a", -1).collect() == [] and log.evict(1) == 0
    add(log, 0, 45)
    assert [x["seq"] for x in log.after("a", 40).collect()] == [41, 42, 43, 44] and [x["payload"] for x in log.after("b", 5, 2).collect()] == ["b6", "b7"]
    plan = log.after("a", 40)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment" in plan and "(segment" in plan.split("PartitionFilters")[1]
    assert log.evict(2) == 3 and log.evict(2) == 0 and log.dropped("a") == 29 and log.dropped("z") == -1
    assert [x["seq"] for x in log.after("a", 29, 1).collect()] == [30]
    with pytest.raises(OffsetLost):
        log.after("a", 28)


def test_a_follower_resumes(log, tmp_path):
    got, fail = [], []

    def write(rows, batch_id):
        new = [(x["seq"], x["lost"]) for x in rows.collect()]
        if fail:
            raise OSError(fail.pop())
        got.extend(new)

    def run():
        log.follow("a", 4, write, f"file://{tmp_path}/cp").awaitTermination()

    add(log, 0, 12)
    run()
    assert got == [(k, False) for k in range(5, 12)]
    run()  # nothing new
    add(log, 12, 25)
    fail.append("down")
    with pytest.raises(Exception, match="down"):
        run()
    run()
    assert got == [(k, False) for k in range(5, 25)]
    add(log, 25, 38)
    log.evict(1)  # takes 25 to 29 before they were sent
    run()
    assert got[20:] == [(k, True) for k in range(30, 38)]
    add(log, 38, 40)
    run()
    assert got[28:] == [(38, False), (39, False)]
    with pytest.raises(OffsetLost):
        log.follow("a", 4, write, f"file://{tmp_path}/other")
