"""The ledger: order and credit lines of accounts, as published by the finance system.

Columns: Invoice, StockCode, Quantity, InvoiceDate (TIMESTAMP_NTZ), Price, customer_id and,
where ties in time must follow the source, ``line_no``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators.ordering import ordered_positions


def ledger_filter(tx: DataFrame) -> DataFrame:
    """Lines that count: an account is known and the quantity is not zero."""
    return tx.filter(F.col("customer_id").isNotNull() & (F.col("Quantity") != 0))


def with_credit_flag(tx: DataFrame) -> DataFrame:
    if "is_credit" in tx.columns:
        return tx
    return tx.withColumn("is_credit", keys.starts_credit(F.col("Invoice")))


def with_line_measures(tx: DataFrame) -> DataFrame:
    """Adds is_credit where absent, price_cents and revenue."""
    return with_credit_flag(tx).withColumns(
        {
            "price_cents": keys.price_cents(F.col("Price")),
            "revenue": keys.line_revenue(F.col("Quantity"), F.col("Price")),
        }
    )


def non_credit_orders(tx: DataFrame) -> DataFrame:
    return tx.filter(~keys.starts_credit(F.col("Invoice")))


def line_id(
    tx: DataFrame, order: Sequence[str | Column], name: str = "line_no", start: int = 0
) -> DataFrame:
    """Row identity from a declared total order; survives repeated business keys."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = ordered_positions(tx, [], by, position=name)
    return placed.withColumn(name, F.col(name) - 1 + start)
