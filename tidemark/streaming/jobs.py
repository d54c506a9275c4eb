"""Streams that use the batch operators. Each ends with the result of the batch form when it
is run over all available input, whatever the number of micro-batches and the order of rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeutil import wall_from_micros, wall_micros
from tidemark.operators.eventlog import funnel_progress
from tidemark.plans.serving import serve
from tidemark.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what has arrived and stop; the written table."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .option("path", f"{path}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def enrich_stream(requests: DataFrame, zones: DataFrame, codes: DataFrame) -> DataFrame:
    """Serving enrichment of a request stream against static dimensions."""
    return serve(requests, zones, codes)


def split_late(lines: DataFrame, allowed_days: int) -> tuple[DataFrame, DataFrame]:
    """Lines known soon enough after their effective date, and those for the side table."""
    lateness = F.col("InvoiceDate") - F.col("eff_date")
    in_time = lateness <= F.make_dt_interval(F.lit(allowed_days))
    dated = lines.filter(F.col("eff_date").isNotNull())
    return dated.filter(in_time), dated.filter(~in_time)


def window_sums(
    rows: DataFrame, wall: Column, width: timedelta, measures: Mapping[str, Column]
) -> DataFrame:
    """Partial sums per tumbling window, folded inside each task; ``merged`` adds them up.

    No state, no watermark and no shuffle: a row counts whenever it arrives, and the sink's
    partial rows are as few as the windows a batch touches. Rows without a time have no window.
    """
    size = width // timedelta(microseconds=1)
    micros = wall_micros(wall)
    narrow = rows.filter(wall.isNotNull()).select(
        (micros - F.pmod(micros, F.lit(size))).alias("window_start"),
        *[F.coalesce(value.cast("long"), F.lit(0)).alias(name) for name, value in measures.items()],
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("window_start", as_index=False, sort=False).sum()

    return narrow.mapInPandas(fold, narrow.schema)


def merged(partials: DataFrame) -> DataFrame:
    """One row per window of the written partial sums."""
    names = [c for c in partials.columns if c != "window_start"]
    total = partials.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in names])
    return total.withColumn("window_start", wall_from_micros(F.col("window_start")))


def late_credit_windows(
    lines: DataFrame, allowed_days: int, width: timedelta = timedelta(days=7)
) -> DataFrame:
    """Partial sums of tumbling windows on the effective date, of lines in time.

    Later lines go to the side table of ``split_late``; between the two none is lost, in
    whatever order and in however many micro-batches they arrive.
    """
    in_time, _ = split_late(lines, allowed_days)
    measures = {
        "n_lines": F.lit(1),
        "n_credit": F.col("is_credit"),
        "quantity": F.col("Quantity"),
    }
    return window_sums(in_time, F.col("eff_date"), width, measures)


def canary_counts(
    events: DataFrame, time: str, label: str, held_back: Sequence,
    width: timedelta = timedelta(hours=1),
) -> DataFrame:
    """Partial sums of rows served per window on the narrow slice, and of those whose value is
    outside its domain."""
    routed = events.filter(~F.col(label).isin(*held_back))
    measures = {"rows_served": F.lit(1), "bad": F.col("value").isNull()}
    return window_sums(routed, F.col(time), width, measures)


def funnel_stream(
    log: DataFrame, steps: Sequence[str], session: str, op: str, order: Sequence[str]
) -> DataFrame:
    """Step events of an append-only log, for a sink from which ``furthest`` reads the funnel.

    A late event can make any earlier one count, so none but repetitions may be left out. They
    are folded inside each task; nothing is shuffled and no session has a state, however many
    events it has and for however long.
    """
    names = [session, *order, op]
    relevant = log.filter(F.col(op).isin(*steps)).dropna(subset=list(order)).select(*names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            yield from rows.group_by(names, use_threads=False).aggregate([]).select(names).to_batches()

    return relevant.mapInArrow(fold, relevant.schema)


def furthest(
    events: DataFrame, steps: Sequence[str], session: str, op: str, order: Sequence[str]
) -> DataFrame:
    """``session, steps_reached`` of the written step events, by the batch form's grouped minima."""
    reached = funnel_progress(events.distinct(), steps, session, op, order)
    return reached.filter(F.col("steps_reached") > 0).select(session, "steps_reached")


def fresh_sink(spark: SparkSession) -> str:
    return scratch_path(spark, "stream")
