"""Stateful streams and folded logs against row-by-row replays."""

import random

from pyspark.sql import functions as F

from corvane.operators import prefix as P
from corvane.streaming import state as W
from corvane.streaming.prefixes import PrefixIndex
from corvane.streaming.windows import run_to_table


def as_stream(spark, batches, schema, tmp_path):
    """Each list of rows is one micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in{k}")
    import pathlib
    import shutil
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(len(batches)):
        part = next(pathlib.Path(tmp_path / f"in{k}").glob("part-*"))
        shutil.copy(part, folder / f"{k}.parquet")
        time.sleep(0.02)  # files are taken in order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def with_times(df):
    return df.withColumn("at", F.timestamp_seconds("t"))


def test_pressure_stream_equals_a_replay(spark, tmp_path):
    """Bounds of the window, resets, and events that come late across micro-batches."""
    r, w = random.Random(8), 60
    batches, i = [], 0
    for b in range(5):
        rows = []
        for _ in range(50):
            i += 1
            t = 1000 + b * 100 + r.randrange(100) - (r.randrange(80) if b and r.random() < 0.2 else 0)
            rows.append((i, r.choice(["x", "x", "y"]), t, r.random() < 0.04))
        rows += [(i + 1, "x", 1060 + b * 100, False), (i + 2, "x", 1000 + b * 100, False)]
        i += 2
        batches.append(rows)
    stream = with_times(as_stream(spark, batches, "event_id long, k string, t long, act boolean", tmp_path))
    got = {x["event_id"]: x["pressure"] for x in run_to_table(W.pressure_stream(stream, "k", "at", w, reset=F.col("act"), late_s=1000), "pressures").collect()}
    want, kept, resets = {}, {"x": [], "y": []}, {"x": [], "y": []}
    for rows in batches:
        for k in "xy":
            taken = max(resets[k], default=-1)  # the last action of the batches before
            now = sorted((t, i, act) for i, kk, t, act in rows if kk == k)
            kept[k] += [t for t, _, act in now if not act and t >= taken]
            resets[k] += [t for t, _, act in now if act]
            for t, i, act in now:
                if not act:
                    since = max((x for x in resets[k] if x <= t), default=-1)
                    want[i] = sum(max(t - w, since) <= s <= t for s in kept[k]) if t >= taken else 0
            kept[k] = [t for t in kept[k] if t >= max(resets[k], default=-1)]
    assert got == want and 0 in got.values() and max(got.values()) > 10


def test_pressure_with_resets_equals_a_loop_and_the_stream(spark, tmp_path):
    r, w = random.Random(9), 50
    rows = sorted([(i, r.choice("aab"), r.randrange(1, 2000), r.random() < 0.05) for i in range(700)], key=lambda x: x[2])
    schema = "event_id long, k string, t long, act boolean"
    batch = with_times(spark.createDataFrame(rows, schema))
    got = {x["event_id"]: x["pressure"] for x in P.rolling_pressure(batch, "k", "at", w, reset=F.col("act")).collect()}
    want = {}
    for i, k, t, act in rows:
        if not act:
            since = max((tt for _, kk, tt, a in rows if kk == k and a and tt <= t), default=-1)
            want[i] = sum(kk == k and not a and max(t - w, since) <= tt <= t for _, kk, tt, a in rows)
    assert got == want
    cut = [rows[:300], rows[300:]]
    while cut[0][-1][2] == cut[1][0][2]:
        cut[0].append(cut[1].pop(0))
    stream = with_times(as_stream(spark, cut, schema, tmp_path))
    assert {x["event_id"]: x["pressure"] for x in run_to_table(W.pressure_stream(stream, "k", "at", w, reset=F.col("act")), "in_order").collect()} == want


def log_rows(r, n):
    out = []
    for seq in range(n):
        op = "observe" if r.random() < 0.8 else "invalidate"
        out.append((seq, op, r.choice("mn"), [r.randrange(8) for _ in range(r.randrange(1, 4))] if op == "observe" else None, f"n{r.randrange(3)}", r.randrange(2) if op == "observe" or r.random() < 0.7 else -r.randrange(1, 3)))
    return out


def test_prefix_log_in_any_order(spark, tmp_path):
    r = random.Random(3)
    rows = log_rows(r, 120)
    live = {}
    for seq, op, model, chain, node, replica in rows:
        if op == "observe":
            live |= {(model, h, node, replica): seq for h in chain}
        else:
            live = {k: s for k, s in live.items() if not (k[0] == model and k[2] == node and (replica < 0 or k[3] == replica))}
    schema = "seq long, op string, model string, chain array<long>, node string, replica int"
    as_dict = lambda df: {(x["model"], x["hash"], x["node"], x["replica"]): x["seq"] for x in df.collect()}
    assert as_dict(P.live_prefixes(spark.createDataFrame(rows, schema))) == live
    r.shuffle(rows)
    index = PrefixIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.run(as_stream(spark, [rows[:40], rows[40:90], rows[90:]], schema, tmp_path), f"file://{tmp_path}/cp").awaitTermination()
    assert as_dict(index.live()) == live
    index.fold(spark.createDataFrame(rows[20:70], schema))  # sent again
    assert as_dict(index.live()) == live
