"""Ledger, attribution and point-in-time bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.tables import LEDGER_ORDER, LEDGER_SQL, ledger
from tidemark.operators import ledger as lg
from tidemark.operators import pit
from tidemark.operators.attribution import credit_attribution, latest_earlier_order
from tidemark.operators.ordering import ordered_positions
from tidemark.plans import backtest
from tidemark.session import written

GRID = ("1996-01-01", "2001-11-01")
CUTOFF = "2000-01-01"


def line_measures(spark, sf):
    out = lg.with_line_measures(ledger(spark, sf).drop("is_credit"))
    return out.groupBy("customer_id", "StockCode", "price_cents").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("is_credit").cast("long")).alias("n_credit"),
        F.sum("revenue").cast("double").alias("revenue"),
    )


LINE_MEASURES = f"""WITH {LEDGER_SQL}
SELECT customer_id, "StockCode", CAST(round_even("Price" * 100, 0) AS BIGINT) AS price_cents,
       count(*) AS n_lines,
       CAST(count(*) FILTER (starts_with("Invoice", 'C')) AS BIGINT) AS n_credit,
       CAST(sum("Quantity" * CAST("Price" AS DECIMAL(18,6))) AS DOUBLE) AS revenue
FROM ledger GROUP BY ALL"""


def counted_lines(spark, sf):
    tx = ledger(spark, sf)
    account = F.when(F.col("customer_id") % 7 != 0, F.col("customer_id"))
    kept = lg.ledger_filter(tx.withColumn("customer_id", account))
    return kept.groupBy("customer_id").agg(F.sum("Quantity").alias("net_quantity"))


COUNTED_LINES = f"""WITH {LEDGER_SQL}
SELECT customer_id, CAST(sum("Quantity") AS BIGINT) AS net_quantity
FROM ledger WHERE customer_id % 7 <> 0 AND "Quantity" <> 0 GROUP BY customer_id"""


def non_credit_orders(spark, sf):
    return (
        lg.non_credit_orders(ledger(spark, sf))
        .groupBy("StockCode")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.max("InvoiceDate").alias("last_order"))
    )


NON_CREDIT_ORDERS = f"""WITH {LEDGER_SQL}
SELECT "StockCode", count(*) AS n_orders, max("InvoiceDate") AS last_order
FROM ledger WHERE "Invoice" NOT LIKE 'C%' GROUP BY 1"""


def line_identity(spark, sf):
    order = ["InvoiceDate", *LEDGER_ORDER, "Quantity"]
    return lg.line_id(ledger(spark, sf), order).select("line_no", *order)


_ORDER_SQL = '"InvoiceDate", l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, "Quantity"'
LINE_IDENTITY = f"""WITH {LEDGER_SQL}
SELECT row_number() OVER (ORDER BY {_ORDER_SQL}) - 1 AS line_no, {_ORDER_SQL} FROM ledger"""


def attributed(spark, sf):
    return credit_attribution(ledger(spark, sf), order=LEDGER_ORDER)


# Credits of a key, in order, each taking the latest open line that fits; one step per credit.
ATTRIBUTED_SQL = f"""{LEDGER_SQL},
keyed AS (
  SELECT *, CAST(round_even("Price" * 100, 0) AS BIGINT) AS cents,
         row_number() OVER (ORDER BY "InvoiceDate", l_orderkey, l_linenumber, l_partkey,
                            l_extendedprice, l_discount, l_tax) AS rid
  FROM ledger
),
pools AS (
  SELECT customer_id, "StockCode", cents,
         list({{'d': "InvoiceDate", 'r': rid, 'q': "Quantity"}} ORDER BY "InvoiceDate", rid) AS pool
  FROM keyed WHERE NOT is_credit AND "Quantity" > 0 GROUP BY ALL
),
credits AS (
  SELECT customer_id, "StockCode", cents, rid, "InvoiceDate" AS d, -"Quantity" AS need,
         row_number() OVER (PARTITION BY customer_id, "StockCode", cents
                            ORDER BY "InvoiceDate", rid) AS n
  FROM keyed WHERE is_credit AND "Quantity" < 0
),
steps AS (
  SELECT customer_id, "StockCode", cents, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS rid,
         pool, CAST(NULL AS TIMESTAMP) AS eff FROM pools
  UNION ALL
  SELECT customer_id, "StockCode", cents, n, rid,
         list_transform(pool, lambda x: CASE WHEN x.r = hit.r
           THEN {{'d': x.d, 'r': x.r, 'q': x.q - need}} ELSE x END),
         hit.d
  FROM (SELECT s.customer_id, s."StockCode", s.cents, c.n, c.rid, s.pool, c.need,
               list_filter(s.pool, lambda x: x.d < c.d AND x.q >= c.need)[-1] AS hit
        FROM steps s JOIN credits c
          ON s.customer_id = c.customer_id AND s."StockCode" = c."StockCode"
         AND s.cents = c.cents AND c.n = s.n + 1)
),
attributed AS (
  SELECT k.*, CASE WHEN is_credit THEN s.eff ELSE k."InvoiceDate" END AS eff_date
  FROM keyed k LEFT JOIN (SELECT rid, eff FROM steps WHERE rid IS NOT NULL) s ON k.rid = s.rid
)
"""


def attribution_rows(spark, sf):
    return attributed(spark, sf).select(
        "customer_id", "StockCode", "Invoice", "Quantity", "InvoiceDate", "l_linenumber", "eff_date"
    )


ATTRIBUTION_ROWS = f"""WITH RECURSIVE {ATTRIBUTED_SQL}
SELECT customer_id, "StockCode", "Invoice", "Quantity", "InvoiceDate", l_linenumber, eff_date
FROM attributed"""


def capacity_free_match(spark, sf):
    return latest_earlier_order(ledger(spark, sf)).select(
        "customer_id", "StockCode", "Invoice", "InvoiceDate", "l_linenumber", "prior_order"
    )


CAPACITY_FREE_MATCH = f"""WITH {LEDGER_SQL}
SELECT c.customer_id, c."StockCode", c."Invoice", c."InvoiceDate", c.l_linenumber,
       o."InvoiceDate" AS prior_order
FROM (SELECT * FROM ledger WHERE is_credit) c
ASOF LEFT JOIN (SELECT DISTINCT customer_id, "StockCode", "Price", "InvoiceDate"
                FROM ledger WHERE NOT is_credit AND "Quantity" > 0) o
  ON c.customer_id = o.customer_id AND c."StockCode" = o."StockCode" AND c."Price" = o."Price"
 AND c."InvoiceDate" > o."InvoiceDate\""""


def _stamps(spark):
    return pit.month_stamps(spark, *GRID)


GRID_SQL = f"""
stamps AS (
  SELECT unnest(generate_series(TIMESTAMP '{GRID[0]}', TIMESTAMP '{GRID[1]}', INTERVAL 1 MONTH)) AS as_of
),
probes AS (
  SELECT DISTINCT customer_id, as_of FROM ledger JOIN stamps
    ON "InvoiceDate" >= as_of - INTERVAL 90 DAY AND "InvoiceDate" < as_of
)
"""


def probe_grid(spark, sf):
    return pit.probe_grid(ledger(spark, sf), _stamps(spark))


PROBE_GRID = f"WITH {LEDGER_SQL}, {GRID_SQL} SELECT customer_id, as_of FROM probes"


def pit_features(spark, sf):
    # Probes and matching each read the ledger.
    tx = written(ledger(spark, sf), "ledger")
    probes = pit.probe_grid(tx, _stamps(spark))
    return backtest.features(tx, probes, order=LEDGER_ORDER)


FEATURES_SQL = f"""{ATTRIBUTED_SQL}, {GRID_SQL},
measures AS (
  SELECT p.customer_id, p.as_of, count(*) AS n_lines, count(DISTINCT "StockCode") AS n_sku,
         count(*) FILTER (is_credit) AS n_credit,
         sum("Quantity" * CAST("Price" AS DECIMAL(18,6))) AS revenue, max(eff_date) AS last_seen
  FROM probes p JOIN attributed a ON a.customer_id = p.customer_id
   AND a."InvoiceDate" < p.as_of - INTERVAL 1 DAY
   AND a.eff_date < p.as_of - INTERVAL 1 DAY AND a.eff_date >= p.as_of - INTERVAL 91 DAY
  GROUP BY ALL
),
features AS (
  SELECT p.customer_id, p.as_of, coalesce(n_lines, 0) AS n_lines, coalesce(n_sku, 0) AS n_sku,
         coalesce(n_credit, 0) AS n_credit,
         CAST(coalesce(round_even(CAST(revenue * 100 AS DOUBLE), 0), 0) AS BIGINT) AS spend_cents,
         coalesce(date_sub('day', last_seen, p.as_of), -1) AS days_since_last
  FROM probes p LEFT JOIN measures m USING (customer_id, as_of)
)
"""
PIT_FEATURES = f"""WITH RECURSIVE {FEATURES_SQL} SELECT * FROM features"""


def trailing_window(spark, sf):
    """Lines, credits included, that each stamp sees."""
    seen = pit.trailing_window(attributed(spark, sf), pit.probe_grid(ledger(spark, sf), _stamps(spark)))
    return seen.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("is_credit").alias("n_credit"),
        F.sum("Quantity").alias("quantity"),
    )


_DAYS_SQL = """
days AS MATERIALIZED (
  SELECT "InvoiceDate" AS known, eff_date, count(*) AS n, count(*) FILTER (is_credit) AS credits,
         CAST(sum("Quantity") AS BIGINT) AS quantity
  FROM attributed WHERE eff_date IS NOT NULL GROUP BY ALL
)
"""
TRAILING_WINDOW = f"""WITH RECURSIVE {ATTRIBUTED_SQL}, {GRID_SQL}, {_DAYS_SQL}
SELECT as_of, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(credits) AS BIGINT) AS n_credit, CAST(sum(quantity) AS BIGINT) AS quantity
FROM days JOIN stamps ON known < as_of - INTERVAL 1 DAY
 AND eff_date < as_of - INTERVAL 1 DAY AND eff_date >= as_of - INTERVAL 91 DAY
GROUP BY as_of"""


def knowledge_gate(spark, sf):
    """Lines in a stamp's window, and those of them that the gate holds back as not yet known."""
    lines = attributed(spark, sf)
    probes = pit.probe_grid(ledger(spark, sf), _stamps(spark))
    count = lambda rows, name: pit.trailing_window(rows, probes).groupBy("as_of").agg(F.count(F.lit(1)).alias(name))
    dated = count(lines.withColumn("InvoiceDate", F.col("eff_date")), "n_dated")
    known = count(lines, "n_known")
    return dated.join(known, "as_of", "left").select(
        "as_of", "n_dated", (F.col("n_dated") - F.coalesce("n_known", F.lit(0))).alias("n_held_back")
    )


KNOWLEDGE_GATE = f"""WITH RECURSIVE {ATTRIBUTED_SQL}, {GRID_SQL}, {_DAYS_SQL}
SELECT as_of, CAST(sum(n) AS BIGINT) AS n_dated,
       CAST(coalesce(sum(n) FILTER (known >= as_of - INTERVAL 1 DAY), 0) AS BIGINT) AS n_held_back
FROM days JOIN stamps ON eff_date < as_of - INTERVAL 1 DAY AND eff_date >= as_of - INTERVAL 91 DAY
GROUP BY as_of"""


def horizon_label(spark, sf):
    tx = ledger(spark, sf)
    return pit.horizon_label(tx, pit.probe_grid(tx, _stamps(spark)))


LABELS_SQL = """
labels_at AS (
  SELECT p.customer_id, p.as_of, CAST(CASE WHEN h.customer_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS label
  FROM probes p LEFT JOIN (
    SELECT DISTINCT p.customer_id, p.as_of FROM probes p JOIN ledger l
      ON l.customer_id = p.customer_id AND NOT l.is_credit
     AND l."InvoiceDate" > p.as_of AND l."InvoiceDate" <= p.as_of + INTERVAL 30 DAY) h
  USING (customer_id, as_of)
)
"""
HORIZON_LABEL = f"WITH {LEDGER_SQL}, {GRID_SQL}, {LABELS_SQL} SELECT * FROM labels_at"


def temporal_backtest(spark, sf):
    """Class balance on both sides of the cut, from keyed features and labels."""
    tx = ledger(spark, sf)
    frame = backtest.training_frame(tx, _stamps(spark), order=LEDGER_ORDER)
    return backtest.report_sizes(frame, CUTOFF)


TEMPORAL_BACKTEST = f"""WITH RECURSIVE {FEATURES_SQL}, {LABELS_SQL}
SELECT count(*) AS n_probes, count(DISTINCT as_of) AS n_stamps,
       count(*) FILTER (as_of < TIMESTAMP '{CUTOFF}') AS n_train,
       count(*) FILTER (as_of >= TIMESTAMP '{CUTOFF}') AS n_score,
       round(avg(label), 6) AS positive_rate
FROM features JOIN labels_at USING (customer_id, as_of)"""


def parity_holdout(spark, sf):
    split = pit.parity_holdout(ledger(spark, sf))
    return split.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("customer_id").alias("n_accounts")
    )


PARITY_HOLDOUT = f"""WITH {LEDGER_SQL}
SELECT CASE WHEN customer_id % 2 = 1 THEN 'hidden' ELSE 'validation' END AS slice,
       count(*) AS n_lines, count(DISTINCT customer_id) AS n_accounts
FROM ledger GROUP BY 1"""


def effective_date_join(spark, sf):
    tx = lg.line_id(ledger(spark, sf), ["InvoiceDate", *LEDGER_ORDER, "Quantity"])
    tx = tx.transform(_stored)
    # The matching is given what it reads; the other columns stay with the lines.
    lines = tx.select("line_no", *pit.READ)
    dates = credit_attribution(lines).select("line_no", "eff_date").transform(_stored)
    joined = pit.attach_effective_date(tx, dates)
    return joined.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("eff_date").alias("n_dated")
    )


def _stored(df):
    # Read several times, each time a few of the columns.
    return written(df, "lines")


EFFECTIVE_DATE_JOIN = f"""WITH RECURSIVE {ATTRIBUTED_SQL}
SELECT customer_id, count(*) AS n_lines, count(eff_date) AS n_dated FROM attributed GROUP BY 1"""


def account_positions(spark, sf):
    placed = ordered_positions(
        ledger(spark, sf), ["customer_id"], [F.col("InvoiceDate"), *map(F.col, LEDGER_ORDER)], "place"
    )
    return placed.select("customer_id", "place", "InvoiceDate")


ACCOUNT_POSITIONS = f"""WITH {LEDGER_SQL}
SELECT customer_id, "InvoiceDate",
       row_number() OVER (PARTITION BY customer_id ORDER BY "InvoiceDate", l_orderkey, l_linenumber,
         l_partkey, l_extendedprice, l_discount, l_tax) AS place FROM ledger"""

BOUND = {
    "line_measures": (line_measures, LINE_MEASURES),
    "ledger_filter": (counted_lines, COUNTED_LINES),
    "non_credit_orders": (non_credit_orders, NON_CREDIT_ORDERS),
    "line_identity": (line_identity, LINE_IDENTITY),
    "credit_attribution": (attribution_rows, ATTRIBUTION_ROWS),
    "latest_earlier_order": (capacity_free_match, CAPACITY_FREE_MATCH),
    "effective_date_join": (effective_date_join, EFFECTIVE_DATE_JOIN),
    "probe_grid": (probe_grid, PROBE_GRID),
    "pit_features": (pit_features, PIT_FEATURES),
    "trailing_window_join": (trailing_window, TRAILING_WINDOW),
    "knowledge_gate": (knowledge_gate, KNOWLEDGE_GATE),
    "horizon_label": (horizon_label, HORIZON_LABEL),
    "temporal_backtest": (temporal_backtest, TEMPORAL_BACKTEST),
    "parity_holdout": (parity_holdout, PARITY_HOLDOUT),
    "account_positions": (account_positions, ACCOUNT_POSITIONS),
}
