"""Point-in-time features and labels for (customer_id, as_of) probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import line_revenue, starts_credit
from tidemark.functions.timeutil import day_bucket, days, whole_days

PROBE = ["customer_id", "as_of"]
FEATURES = ["n_lines", "n_sku", "n_credit", "spend_cents", "days_since_last"]
# What features read of a line, besides its effective date.
READ = ["customer_id", "StockCode", "InvoiceDate", "is_credit", "Quantity", "Price"]
WINDOW_DAYS = 90
EMBARGO_DAYS = 1
HORIZON_DAYS = 30
# Above this many distinct stamps probes are joined by account instead of being broadcast.
STAMP_LIMIT = 20_000


def month_stamps(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Month starts from ``start`` to ``end``, both included when they are month starts."""
    low, high = (F.lit(x).cast("date") for x in (start, end))
    first = F.trunc(F.date_add(low, -1), "MM")
    month = F.explode(F.sequence(F.add_months(first, 1), high, F.expr("INTERVAL 1 MONTH")))
    return (
        spark.range(1)
        .filter(F.add_months(first, 1) <= high)
        .select(month.alias("as_of"))
        .select(F.col("as_of").cast("timestamp_ntz"))
    )


def _on_stamps(
    lines: DataFrame, stamps: DataFrame, low: Column, high: Column, width: int, keep: Column
) -> DataFrame:
    """Pair each line with the stamps it can reach.

    ``low``..``high`` bounds the stamps of a line and is no longer than ``width`` days, so a
    line falls into at most two buckets of that width and the range test becomes an equi-join
    on the bucket.
    """
    reach = F.explode(F.sequence(day_bucket(low, width), day_bucket(high, width)))
    placed = lines.filter(low.isNotNull() & high.isNotNull()).withColumn("_bucket", reach)
    return placed.join(stamps, "_bucket").filter(keep).drop("_bucket")


def _bucketed(stamps: DataFrame, width: int) -> DataFrame:
    return stamps.withColumn("_bucket", day_bucket(F.col("as_of"), width))


def _reach_probes(
    lines: DataFrame,
    probes: DataFrame,
    low: Column,
    high: Column,
    width: int,
    keep: Column,
    stamp_limit: int = STAMP_LIMIT,
) -> DataFrame:
    """Lines of a customer with every probe stamp they can reach.

    Few stamps: broadcast them, with their number checked. Many: join by customer and bucket.
    """
    stamps = probes.select("as_of").distinct()
    if stamps.limit(stamp_limit + 1).count() <= stamp_limit:
        return _on_stamps(lines, F.broadcast(_bucketed(stamps, width)), low, high, width, keep)
    near = _bucketed(probes.select(*PROBE).distinct(), width)
    reach = F.explode(F.sequence(day_bucket(low, width), day_bucket(high, width)))
    placed = lines.filter(low.isNotNull() & high.isNotNull()).withColumn("_bucket", reach)
    return placed.join(near, ["customer_id", "_bucket"]).filter(keep).drop("_bucket")


def trailing_window(
    attributed: DataFrame,
    probes: DataFrame,
    window_days: int = WINDOW_DAYS,
    embargo_days: int = EMBARGO_DAYS,
    stamp_limit: int = STAMP_LIMIT,
) -> DataFrame:
    """Lines visible to each stamp: dated in [hi − window, hi) and known before hi,
    where hi is the stamp less the embargo. Lines without an effective date are out."""
    known = F.greatest("InvoiceDate", "eff_date")
    low = known + days(embargo_days)
    high = F.col("eff_date") + days(embargo_days + window_days)
    keep = (F.col("as_of") > low) & (F.col("as_of") <= high)
    # A credit known long after its order may have no stamp left at all.
    live = attributed.filter(F.col("eff_date").isNotNull() & (low < high))
    return _reach_probes(live, probes, low, high, window_days, keep, stamp_limit)


def pit_features(
    attributed: DataFrame,
    probes: DataFrame,
    window_days: int = WINDOW_DAYS,
    embargo_days: int = EMBARGO_DAYS,
    stamp_limit: int = STAMP_LIMIT,
) -> DataFrame:
    """Five trailing measures for every probe; idle probes get zeros and recency −1."""
    lines = attributed.select(
        "customer_id",
        "StockCode",
        "InvoiceDate",
        "eff_date",
        F.col("is_credit").cast("int").alias("is_credit"),
        line_revenue(F.col("Quantity"), F.col("Price")).alias("revenue"),
    )
    seen = trailing_window(lines, probes, window_days, embargo_days, stamp_limit)
    measures = seen.groupBy(*PROBE).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_distinct("StockCode").alias("n_sku"),
        F.sum("is_credit").alias("n_credit"),
        F.bround(F.sum("revenue") * 100, 0).cast("long").alias("spend_cents"),
        F.max("eff_date").alias("last_seen"),
    )
    gap = F.coalesce(whole_days(F.col("last_seen"), F.col("as_of")), F.lit(-1)).cast("long")
    return with_idle_probes(probes, measures).select(
        *PROBE,
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FEATURES[:-1]],
        gap.alias("days_since_last"),
    )


def with_idle_probes(probes: DataFrame, measures: DataFrame) -> DataFrame:
    return probes.select(*PROBE).join(measures, PROBE, "left")


def horizon_label(
    tx: DataFrame,
    probes: DataFrame,
    horizon_days: int = HORIZON_DAYS,
    stamp_limit: int = STAMP_LIMIT,
) -> DataFrame:
    """1 where the account orders again in (as_of, as_of + horizon]; keyed by probe."""
    orders = tx.filter(~starts_credit(F.col("Invoice"))).select("customer_id", "InvoiceDate")
    low = F.col("InvoiceDate") - days(horizon_days)
    high = F.col("InvoiceDate")
    keep = (F.col("as_of") >= low) & (F.col("as_of") < high)
    # One row per account and day first: a hot account shrinks before it meets the stamps.
    orders = orders.distinct()
    buyers = _reach_probes(orders, probes, low, high, horizon_days + 1, keep, stamp_limit)
    hits = buyers.groupBy(*PROBE).agg(F.lit(1).alias("label"))
    return probes.select(*PROBE).join(hits, PROBE, "left").select(
        *PROBE, F.coalesce("label", F.lit(0)).cast("long").alias("label")
    )


def probe_grid(tx: DataFrame, stamps: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Stamps × accounts with a document dated in [stamp − window, stamp)."""
    seen = tx.select("customer_id", "InvoiceDate").distinct()
    low = F.col("InvoiceDate")
    high = F.col("InvoiceDate") + days(window_days)
    keep = (F.col("as_of") > low) & (F.col("as_of") <= high)
    named = stamps.select("as_of")
    return (
        _on_stamps(seen, _bucketed(named, window_days), low, high, window_days, keep)
        .select(*PROBE)
        .distinct()
    )


def attach_effective_date(tx: DataFrame, dates: DataFrame, line: str = "line_no") -> DataFrame:
    """One-to-one attachment of ``eff_date`` by line identity; a repeated line is an error."""
    from tidemark.operators.contracts import assert_unique

    assert_unique(dates, [line])
    assert_unique(tx, [line])
    return tx.join(dates.select(line, "eff_date"), line, "left")


def parity_holdout(df: DataFrame, column: str = "customer_id", hidden: int = 1) -> DataFrame:
    """``slice``: hidden accounts by id parity, validation accounts otherwise."""
    side = F.when(F.pmod(F.col(column), F.lit(2)) == hidden, "hidden").otherwise("validation")
    return df.withColumn("slice", side)
