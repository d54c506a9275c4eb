"""Streaming bindings: the batch SQL is the twin of the stream's end state."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import eventlog, serving as serving_bindings
from bindings.ledger import ATTRIBUTED_SQL, attributed
from bindings.tables import table
from tidemark.plans.serving import CONTRACT_COLUMNS
from tidemark.session import scratch_path
from tidemark.streaming import jobs

ALLOWED_DAYS = 60


MICRO_BATCHES = 8


def _landed(spark, df, name):
    """Rows dealt over many files, out of order, that arrive in several micro-batches."""
    files = max(MICRO_BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_path(spark, name)
    df.repartition(files).write.parquet(path)
    return jobs.read_stream(spark, path, df.schema, files_per_trigger=-(-files // MICRO_BATCHES))


def enriched_stream(spark, sf):
    requests = _landed(spark, serving_bindings.requests(spark, sf), "requests")
    out = jobs.enrich_stream(requests, serving_bindings.zones(spark, sf), serving_bindings.codes(spark, sf))
    return jobs.run_available(out.select("trip_id", *CONTRACT_COLUMNS), jobs.fresh_sink(spark))


def late_credit_stream(spark, sf):
    """All windows of lines in time."""
    lines = attributed(spark, sf).select("InvoiceDate", "eff_date", "is_credit", "Quantity")
    stream = _landed(spark, lines, "lines")
    sums = jobs.late_credit_windows(stream, ALLOWED_DAYS)
    return jobs.merged(jobs.run_available(sums, jobs.fresh_sink(spark)))


# Weeks start on Thursdays, as windows count from 1970-01-01.
LATE_CREDIT_STREAM = f"""WITH RECURSIVE {ATTRIBUTED_SQL},
in_time AS (
  SELECT *, time_bucket(INTERVAL 7 DAY, eff_date, TIMESTAMP '1970-01-01') AS w FROM attributed
  WHERE eff_date IS NOT NULL AND "InvoiceDate" - eff_date <= INTERVAL {ALLOWED_DAYS} DAY
)
SELECT w AS window_start, count(*) AS n_lines, count(*) FILTER (is_credit) AS n_credit,
  CAST(sum("Quantity") AS BIGINT) AS quantity
FROM in_time GROUP BY 1"""


def late_side_table(spark, sf):
    _, late = jobs.split_late(attributed(spark, sf), ALLOWED_DAYS)
    return late.groupBy("customer_id").agg(F.count(F.lit(1)).alias("late_lines"))


LATE_SIDE_TABLE = f"""WITH RECURSIVE {ATTRIBUTED_SQL}
SELECT customer_id, count(*) AS late_lines FROM attributed
WHERE eff_date IS NOT NULL AND "InvoiceDate" - eff_date > INTERVAL {ALLOWED_DAYS} DAY GROUP BY 1"""


def funnel_stream(spark, sf):
    rows = eventlog.log(spark, sf).filter("accepted").select("user_id", "ts", "event_id", "event_type")
    stream = _landed(spark, rows, "log")
    funnel = eventlog.STEPS, "user_id", "event_type", eventlog.ORDER
    events = jobs.run_available(jobs.funnel_stream(stream, *funnel), jobs.fresh_sink(spark))
    return jobs.furthest(events, *funnel)


FUNNEL_STREAM = f"SELECT user_id, steps_reached FROM ({eventlog.FUNNEL}) WHERE steps_reached > 0"


def canary_stream(spark, sf):
    events = table(spark, sf, "events").select("ts", "event_type", "value")
    stream = _landed(spark, events, "canary")
    counts = jobs.canary_counts(stream, "ts", "event_type", ["purchase", "error"])
    return jobs.merged(jobs.run_available(counts, jobs.fresh_sink(spark)))


CANARY_STREAM = """WITH routed AS (SELECT date_trunc('hour', ts) AS w, * FROM events WHERE event_type NOT IN ('purchase', 'error'))
SELECT w AS window_start, count(*) AS rows_served, count(*) FILTER (value IS NULL) AS bad FROM routed GROUP BY 1"""

BOUND = {
    "enriched_stream": (enriched_stream, serving_bindings.SERVED),
    "late_credit_stream": (late_credit_stream, LATE_CREDIT_STREAM),
    "late_side_table": (late_side_table, LATE_SIDE_TABLE),
    "funnel_stream": (funnel_stream, FUNNEL_STREAM),
    "canary_stream": (canary_stream, CANARY_STREAM),
}
