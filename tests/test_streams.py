"""Streams end with the batch result for any number of micro-batches and any order of rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import eventlog
from tidemark.streaming import jobs

STEPS = ["a", "b", "a", "c"]
START = datetime(2024, 1, 1)


def _landed(spark, rows, schema, path, triggers):
    df = spark.createDataFrame(rows, schema)
    df.repartition(8).write.parquet(path)
    return jobs.read_stream(spark, path, df.schema, files_per_trigger=-(-8 // triggers)), df


@pytest.mark.parametrize("triggers", [1, 3, 8])
def test_funnel_equals_batch(spark, tmp_path, triggers):
    draw = random.Random(5)
    rows = [
        (draw.randrange(12), START + timedelta(days=draw.randrange(400)), n, draw.choice("abcx"))
        for n in range(120)
    ]
    draw.shuffle(rows)
    stream, df = _landed(
        spark, rows, "s long, ts timestamp_ntz, n long, op string", str(tmp_path / "in"), triggers
    )
    events = jobs.run_available(jobs.funnel_stream(stream, STEPS, "s", "op", ["ts", "n"]), str(tmp_path / "out"))
    out = jobs.furthest(events, STEPS, "s", "op", ["ts", "n"])
    want = eventlog.funnel_progress(df, STEPS, "s", "op", ["ts", "n"]).filter("steps_reached > 0")
    assert sorted(map(tuple, out.collect())) == sorted(
        map(tuple, want.select("s", "steps_reached").collect())
    )


def test_a_third_of_all_events_in_one_session(spark, tmp_path):
    """A session's events are never together: the stream keeps no state and shuffles nothing."""
    rows = [(0 if n % 3 == 0 else n % 50, START + timedelta(minutes=n % 997), n, "abcx"[n % 4]) for n in range(6000)]
    rows += [(r[0], r[1], r[2], r[3]) for r in rows if r[0] == 0]
    stream, df = _landed(spark, rows, "s long, ts timestamp_ntz, n long, op string", str(tmp_path / "in"), 4)
    steps = jobs.funnel_stream(stream, STEPS, "s", "op", ["ts", "n"])
    plan = jobs.funnel_stream(df, STEPS, "s", "op", ["ts", "n"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "State" not in plan
    events = jobs.run_available(steps, str(tmp_path / "out"))
    out = jobs.furthest(events, STEPS, "s", "op", ["ts", "n"]).collect()
    want = eventlog.funnel_progress(df, STEPS, "s", "op", ["ts", "n"]).filter("steps_reached > 0")
    assert sorted(map(tuple, out)) == sorted(map(tuple, want.select("s", "steps_reached").collect()))


@pytest.mark.parametrize("triggers", [1, 3, 8])
def test_windows_and_side_table_hold_every_line(spark, tmp_path, triggers):
    draw = random.Random(6)
    rows = []
    for _ in range(200):
        known = START + timedelta(days=draw.randrange(700))
        since = None if draw.random() < 0.1 else known - timedelta(days=draw.randrange(120))
        rows.append((known, since, draw.random() < 0.3, draw.randrange(-5, 9)))
    schema = "InvoiceDate timestamp_ntz, eff_date timestamp_ntz, is_credit boolean, Quantity long"
    stream, df = _landed(spark, rows, schema, str(tmp_path / "in"), triggers)
    sums = jobs.late_credit_windows(stream, 60)
    got = jobs.merged(jobs.run_available(sums, str(tmp_path / "out"))).collect()
    in_time = [r for r in rows if r[1] and r[0] - r[1] <= timedelta(days=60)]
    assert sum(r.n_lines for r in got) == len(in_time)
    assert sum(r.n_credit for r in got) == sum(r[2] for r in in_time)
    assert sum(r.quantity for r in got) == sum(r[3] for r in in_time)
    weeks = {(r[1] - datetime(1970, 1, 1)) // timedelta(days=7) for r in in_time}
    assert {(r.window_start - datetime(1970, 1, 1)) // timedelta(days=7) for r in got} == weeks
    late = jobs.split_late(df, 60)[1].count()
    assert late + len(in_time) == df.filter(F.col("eff_date").isNotNull()).count()
