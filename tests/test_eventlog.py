"""Funnels and chained events against a direct walk over the log."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import eventlog as ev
from tidemark.streaming import jobs

STEPS = ["a", "b", "a", "c"]


def walk(rows):
    cursor = 0
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if cursor < len(STEPS) and r[3] == STEPS[cursor]:
            cursor += 1
    return cursor


def test_funnel_batch_and_stream(spark, tmp_path):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [
        (0 if rng.random() < 0.5 else rng.randint(1, 9), start + timedelta(minutes=rng.randint(0, 30)), i, rng.choice("abcd"))
        for i in range(120)
    ]
    log = spark.createDataFrame(rows, "s long, ts timestamp_ntz, n long, op string")
    want = {s: walk([r for r in rows if r[0] == s]) for s in {r[0] for r in rows}}
    got = ev.funnel_progress(log, STEPS, "s", "op", ["ts", "n"]).collect()
    assert {r.s: r.steps_reached for r in got} == want
    path = str(tmp_path / "log")
    log.write.parquet(path)
    stream = jobs.funnel_stream(jobs.read_stream(spark, path, log.schema), STEPS, "s", "op", ["ts", "n"])
    out = jobs.furthest(jobs.run_available(stream, str(tmp_path / "out")), STEPS, "s", "op", ["ts", "n"]).collect()
    assert {r.s: r.steps_reached for r in out} == {s: k for s, k in want.items() if k}


def test_continuity_and_budget(spark):
    log = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 1)], "s long, seq long")
    got = {r.s: r.continuous for r in ev.sequence_continuity(log, "s", "seq").collect()}
    assert got == {1: True, 2: False, 3: False}
    used = ev.running_budget(log, "s", ["seq"], F.lit(True), 2).collect()
    assert sorted((r.s, r.attempts, r.over_limit) for r in used if r.s == 1) == [
        (1, 1, False), (1, 2, False), (1, 3, True),
    ]
