"""Steps that would not grow with their tables: what one task gets, and what is held or done twice."""

import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F

from bindings import ledger as ledger_bindings, sources
from tidemark.operators import encode, models, splits
from tidemark.operators.attribution import credit_attribution
from tidemark.operators.pit import month_stamps
from tidemark.plans import backtest


@pytest.fixture()
def shuffled(spark):
    """Joins deal rows out; nothing is broadcast or put together again."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"]
    before = {n: spark.conf.get(n) for n in names}
    for name, value in zip(names, ["-1", "false", "8"]):
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def _sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.fixture()
def half_without(spark):
    """Half of the rows have no level."""
    level = F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), (F.col("id") % 200).cast("string")))
    rows = spark.range(4000).withColumns({"level": level, "y": (F.col("id") % 3 == 0).cast("int")})
    return rows.withColumns({"fold": (F.col("id") % 3).cast("int"), "inner": F.array(*[(F.col("id") % 5).cast("int")] * 3)})


def test_rows_without_a_level_are_dealt_out(shuffled, half_without):
    coded = encode.target_encode(half_without, half_without, ["level"], "y")
    assert max(_sizes(coded)) < 1200
    known = half_without.filter("level is not null").groupBy("level").agg(F.avg("y").alias("r")).collect()
    rates, prior = {r.level: r.r for r in known}, half_without.agg(F.avg("y")).first()[0]
    rows = coded.collect()
    assert len(rows) == 4000
    assert all(r.level_rate == pytest.approx(rates[r.level] if r.level else prior) for r in rows)


def test_levels_of_other_types_and_a_null_level_of_the_rates(spark):
    rates = spark.createDataFrame([(1, 0.25), (None, 0.75)], "level int, rate double")
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    got = {r.k: r.r for r in encode.rate_lookup(rows, "k", rates, F.lit(0.5), "r").collect()}
    assert got == {1: 0.25, 2: 0.5, None: 0.5}


def test_nested_rates_deal_out_rows_without_a_level(shuffled, half_without):
    coded = encode.target_encode_nested(half_without, "level", "y", "fold", "inner", 3, 5)
    assert max(_sizes(coded)) < 1200
    priors = {f: half_without.filter(F.col("fold") != f).agg(F.avg("y")).first()[0] for f in range(3)}
    rows = coded.filter("level is null").collect()
    assert len(rows) == 2000 and all(r.rates[f] == pytest.approx(priors[f]) for r in rows for f in range(3))


@pytest.mark.parametrize("partitions", [2, 40])
def test_a_frame_that_fills_the_cores_is_fitted_fold_by_fold(spark, monkeypatch, partitions):
    at_once, most, lock = 0, 0, threading.Lock()

    class Fit:
        def copy(self):
            return self

        def fit(self, frame):
            nonlocal at_once, most
            with lock:
                at_once += 1
                most = max(most, at_once)
            time.sleep(0.5)
            with lock:
                at_once -= 1

    monkeypatch.setattr(models, "predict_scores", lambda model, frame, score: frame.withColumn(score, F.lit(0.5)))
    frame = spark.range(0, 300, 1, partitions).withColumn("fold", (F.col("id") % 3).cast("int"))
    scored = models.out_of_fold(lambda f: frame, "fold", 3, Fit())
    assert scored.count() == 300 and most == (3 if partitions == 2 else 1)


def test_rows_split_by_position_are_worked_out_once(spark):
    rows = spark.range(0, 1000, 1, 4)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    split = splits.positional_split(rows.mapInArrow(counted, "id long"), [F.col("id")], 0.75, 4)
    sides = split.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).collect()
    assert {r.side: (r.n, r["last"]) for r in sides} == {"train": (750, 749), "score": (250, 999)}
    assert seen.value == 1000


LINES = "line_no long, Invoice string, StockCode string, Quantity long, InvoiceDate timestamp_ntz, Price double, customer_id long"


def _lines(spark, rows):
    at = lambda day: None if day is None else dt.datetime(2011, 1, 1) + dt.timedelta(days=day)
    made = [(i, f"{'C' if q < 0 else ''}{i}", sku, q, at(day), 2.0, who) for i, (who, sku, q, day) in enumerate(rows)]
    return spark.createDataFrame(made, LINES)


def test_an_order_without_a_date_takes_no_credit(spark):
    rows = [(1, "a", 5, None), (1, "a", -5, 3), (1, "b", 4, 1), (1, "b", -4, 2), (None, "b", -1, 2)]
    for partitions in (1, 3):
        got = {r.line_no: r.eff_date for r in credit_attribution(_lines(spark, rows), partitions=partitions).collect()}
        first = dt.datetime(2011, 1, 2)
        assert got == {0: None, 1: None, 2: first, 3: first, 4: None}


def test_a_training_frame_works_out_the_ledger_once(spark):
    rows = [(i % 7, f"s{i % 5}", -2 if i % 6 == 0 else 3, i % 90) for i in range(600)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    tx = _lines(spark, rows).mapInArrow(counted, LINES)
    frame = backtest.training_frame(tx, month_stamps(spark, "2011-02-01", "2011-05-01"))
    assert frame.count() == 7 * 4 and frame.count() == 7 * 4
    assert seen.value == 600


def test_versions_of_features_are_read_from_one_table(spark, tmp_path):
    day = lambda i: dt.datetime(1999, 1, 1) + dt.timedelta(days=i)
    lines = [(i, i % 4, i % 3 + 1, i % 5, 2.0, 10.0 + i, 0.0, 0.0, "R" if i % 5 == 0 else "N", day(i)) for i in range(300)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    kinds += "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(4).selectExpr("id AS p_partkey", "'B' || id % 2 AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    found = sources.feature_contract(spark, str(tmp_path))
    assert {path.split("/")[-2].split("-")[0] for path in found.inputFiles()} == {"features"}
    n = ledger_bindings.pit_features(spark, str(tmp_path)).count()
    rows = found.collect()
    assert len(rows) == 14 and {r.n_rows for r in rows} == {n} and n > 0
    assert all(r.violations == 0 for r in rows if r.version == "as built")
