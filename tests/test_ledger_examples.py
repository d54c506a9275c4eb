"""Worked examples of credit attribution and point-in-time features."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import attribution
from tidemark.operators.attribution import credit_attribution, latest_earlier_order
from tidemark.operators.pit import horizon_label, pit_features

SCHEMA = (
    "Invoice string, StockCode string, Quantity long, InvoiceDate timestamp_ntz, "
    "Price double, customer_id long, line_no long"
)


def d(text, hour=9):
    return datetime.strptime("20" + text, "%Y-%m-%d") + timedelta(hours=hour)


def line(no, quantity, price, at, credit=False, account=1, sku="A"):
    invoice = f"{'C' if credit else ''}{100 + no}"
    return (invoice, sku, -quantity if credit else quantity, at, price, account, no)


# (lines, [(as_of, (n_lines, n_sku, n_credit, spend_cents, days_since_last))])
CASES = {
    "late credit": (
        [line(0, 2, 1.0, d("20-03-10", 10)), line(1, 1, 1.0, d("20-04-02", 10), True)],
        [(d("20-04-01", 0), (1, 1, 0, 200, 21)), (d("20-04-04", 0), (2, 1, 1, 100, 24))],
    ),
    "embargo edge": (
        [line(0, 3, 1.0, d("20-03-31", 0))],
        [
            (d("20-04-01", 0), (0, 0, 0, 0, -1)),
            (d("20-04-01", 12), (1, 1, 0, 300, 1)),
            (d("20-04-02", 0), (1, 1, 0, 300, 2)),
        ],
    ),
    "same instant": (
        [line(0, 2, 1.0, d("20-01-02")), line(1, 1, 1.0, d("20-01-02"), True)],
        [(d("20-01-05", 0), (1, 1, 0, 200, 2))],
    ),
    "window": (
        [
            line(0, 2, 1.0, d("20-01-01")),
            line(1, 3, 1.0, d("20-03-20")),
            line(2, 1, 1.0, d("20-04-02"), True),
        ],
        [(d("20-04-04", 0), (2, 1, 1, 200, 14)), (d("20-06-25", 0), (0, 0, 0, 0, -1))],
    ),
    "orphan": (
        [line(0, 4, 1.0, d("20-02-03", 12), True)],
        [(d("20-02-06", 0), (0, 0, 0, 0, -1))],
    ),
    "repeated line": (
        [
            line(0, 1, 1.0, d("20-02-01")),
            line(1, 1, 1.0, d("20-02-01")),
            line(2, 1, 1.0, d("20-02-04"), True),
        ],
        [(d("20-02-07", 0), (3, 1, 1, 100, 5))],
    ),
    "latest is too small": (
        [
            line(0, 5, 1.0, d("20-02-01")),
            line(1, 1, 1.0, d("20-04-01")),
            line(2, 3, 1.0, d("20-04-03"), True),
        ],
        [(d("20-04-06", 0), (3, 1, 1, 300, 4)), (d("20-06-15", 0), (1, 1, 0, 100, 74))],
    ),
    "price is part of the key": (
        [
            line(0, 5, 1.0, d("20-03-01")),
            line(1, 5, 2.0, d("20-03-20")),
            line(2, 2, 1.0, d("20-04-02"), True),
        ],
        [(d("20-04-05", 0), (3, 1, 1, 1300, 15)), (d("20-06-01", 0), (1, 1, 0, 1000, 72))],
    ),
    "capacity is used up": (
        [
            line(0, 3, 1.0, d("20-03-01")),
            line(1, 2, 1.0, d("20-03-10"), True),
            line(2, 2, 1.0, d("20-03-20"), True),
        ],
        [(d("20-04-01", 0), (2, 1, 1, 100, 30))],
    ),
    "indivisible": (
        [
            line(0, 2, 1.0, d("20-03-01")),
            line(1, 2, 1.0, d("20-03-10")),
            line(2, 3, 1.0, d("20-03-20"), True),
        ],
        [(d("20-04-01", 0), (2, 1, 0, 400, 21))],
    ),
    "order tie": (
        [
            line(0, 3, 1.0, d("20-03-01")),
            line(1, 5, 1.0, d("20-03-01")),
            line(2, 3, 1.0, d("20-03-10"), True),
            line(3, 4, 1.0, d("20-03-20"), True),
        ],
        [(d("20-04-01", 0), (3, 1, 1, 500, 30))],
    ),
    "credit tie": (
        [
            line(0, 3, 1.0, d("20-03-01")),
            line(1, 2, 1.0, d("20-03-10"), True),
            line(2, 3, 1.0, d("20-03-10"), True),
        ],
        [(d("20-04-01", 0), (2, 1, 1, 100, 30))],
    ),
    "cents, not exact price": (
        [line(0, 4, 1.004, d("20-03-01")), line(1, 2, 1.0, d("20-03-10"), True)],
        [(d("20-04-01", 0), (2, 1, 1, 202, 30))],
    ),
}


def _all_cases(spark):
    """Every case as an account of its own, so that one job checks them all."""
    rows, probes, want = [], [], {}
    for account, (lines, expected) in enumerate(CASES.values(), start=1):
        for r in lines:
            rows.append((*r[:5], account, account * 100 + r[6]))
        for as_of, values in expected:
            probes.append((account, as_of))
            want[(account, as_of)] = values
    tx = spark.createDataFrame(rows, SCHEMA)
    return tx, spark.createDataFrame(probes, "customer_id long, as_of timestamp_ntz"), want


@pytest.mark.parametrize("partitions,stamp_limit", [(1, 1000), (9, 1000), (3, 1)])
def test_worked_examples(spark, partitions, stamp_limit):
    tx, probes, want = _all_cases(spark)
    attributed = credit_attribution(tx, partitions=partitions)
    got = pit_features(attributed, probes, stamp_limit=stamp_limit).collect()
    assert {(r[0], r[1]): tuple(r[2:]) for r in got} == want


def brute_force(rows):
    """Direct reading of the matching rule, one credit at a time."""
    left = {r[6]: r[2] for r in rows if not r[0].startswith("C")}
    out = {}
    for c in sorted((r for r in rows if r[0].startswith("C")), key=lambda r: (r[3], r[6])):
        fits = [
            o
            for o in rows
            if o[6] in left
            and (o[5], o[1], round(o[4] * 100)) == (c[5], c[1], round(c[4] * 100))
            and o[3] < c[3]
            and left[o[6]] >= -c[2]
        ]
        best = max(fits, key=lambda o: (o[3], o[6]), default=None)
        out[c[6]] = best[3] if best else None
        if best:
            left[best[6]] += c[2]
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_hot_key_over_many_pieces(spark, partitions):
    """One key holds most rows and spans every partition; credits reach far back."""
    rng = random.Random(5)
    rows = []
    for no in range(600):
        credit = rng.random() < 0.35
        account = 1 if rng.random() < 0.8 else rng.randint(2, 9)
        quantity = rng.choice([1, 2, 3, 8]) if not credit else rng.choice([1, 2, 4, 7, 8, 9])
        at = d("20-01-01", 0) + timedelta(hours=rng.randint(0, 200))
        rows.append(line(no, quantity, 1.0, at, credit, account))
    tx = spark.createDataFrame(rows, SCHEMA)
    got = credit_attribution(tx, partitions=partitions).collect()
    assert len(got) == len(rows)
    dates = {r.line_no: r.eff_date for r in got}
    want = {r[6]: r[3] for r in rows if not r[0].startswith("C")} | brute_force(rows)
    assert dates == want


def test_pieces_of_one_key_merge_in_log_rounds(spark, monkeypatch):
    """One key in 32 pieces, credits that reach far back: five rounds."""
    rng = random.Random(8)
    rows = []
    for no in range(960):
        credit = no > 300 and rng.random() < 0.4
        at = d("20-01-01", 0) + timedelta(hours=no // 2)
        rows.append(line(no, rng.choice([1, 2, 9]), 1.0, at, credit))
    rounds = []
    real = attribution._merge_round
    monkeypatch.setattr(attribution, "_merge_round", lambda state, level: rounds.append(level) or real(state, level))
    got = credit_attribution(spark.createDataFrame(rows, SCHEMA), partitions=32).collect()
    want = {r[6]: r[3] for r in rows if not r[0].startswith("C")} | brute_force(rows)
    assert {r.line_no: r.eff_date for r in got} == want
    assert 4 <= len(rounds) <= 6


def test_capacity_free_match_is_strict(spark):
    rows = [
        line(0, 1, 1.0, d("20-01-01")),
        line(1, 1, 1.0, d("20-01-05"), True),
        line(2, 1, 1.0, d("20-01-05")),
        line(3, 1, 1.0, d("20-01-06"), True),
        line(4, 1, 9.0, d("20-01-07"), True),
    ]
    got = latest_earlier_order(spark.createDataFrame(rows, SCHEMA), partitions=3).collect()
    assert {r.line_no: r.prior_order for r in got} == {
        1: d("20-01-01"),
        3: d("20-01-05"),
        4: None,
    }


@pytest.mark.parametrize("stamp_limit", [1000, 0])
def test_horizon_label_edges(spark, stamp_limit):
    rows = [line(0, 1, 1.0, d("20-02-01", 0)), line(1, 1, 1.0, d("20-03-02", 0), True)]
    probes = [(1, d("20-02-01", 0)), (1, d("20-01-02", 0)), (1, d("20-01-01", 23)), (2, d("20-01-20"))]
    tx = spark.createDataFrame(rows, SCHEMA)
    frame = spark.createDataFrame(probes, "customer_id long, as_of timestamp_ntz")
    got = {(r[0], r[1]): r[2] for r in horizon_label(tx, frame, stamp_limit=stamp_limit).collect()}
    assert [got[p] for p in probes] == [0, 1, 0, 0]
