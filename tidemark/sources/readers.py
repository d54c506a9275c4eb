"""Reads with a declared schema; a row that does not fit is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.contracts import non_empty

CASE_SCHEMA = T.StructType(
    [
        T.StructField("record_key", T.StringType()),
        T.StructField("pmcid", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("journal", T.StringType()),
        T.StructField("final_diagnosis", T.StringType()),
        T.StructField("case_summary", T.StringType()),
        T.StructField(
            "domain_hits",
            T.StructType(
                [T.StructField(d, T.LongType()) for d in ("cardiac", "vascular", "systemic")]
            ),
        ),
    ]
)
MANIFEST_SCHEMA = (
    "release string, expected_total_rows long, expected_distinct_pmcids long, "
    "files array<struct<domain:string, path:string, active:boolean, rows:long, sha256:string>>, "
    "identity_registry string, identity_key string"
)
REGISTRY_SCHEMA = "record_key string, pmcid string, domain string"
REQUEST_SCHEMA = "query_id string, top_k int, facets map<string,string>"


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema, order: str | None = None) -> DataFrame:
    """CSV with a header; empty is an error. ``order`` names a column for the file order.

    The order is a struct of the file, the split's offset in it and an id that rises inside a
    split, so it holds for any number of files and splits, however Spark packs them.
    """
    rows = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    if order:
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        )
        rows = rows.select("*", place.alias(order))
    return non_empty(rows)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_request(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_SCHEMA).json(path, multiLine=True, mode="FAILFAST")


def request_facets(request: DataFrame) -> DataFrame:
    """``source, text``: one row per facet of a request."""
    return request.select(F.explode("facets").alias("source", "text"))
