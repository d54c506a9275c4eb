"""Governed ingest: only what the manifest lists as active, checked before it is used."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.contracts import ContractError, assert_unique, duplicate_keys
from tidemark.session import written
from tidemark.sources.readers import CASE_SCHEMA, MANIFEST_SCHEMA, REGISTRY_SCHEMA, read_jsonl

BLOCK_BYTES = 8 << 20
REQUIRED = ("record_key", "title", "case_summary")
BREACHES = {
    "incomplete": "file with cases that lack a required key",
    "alien": "case the registry does not know",
    "misplaced": "case filed under another domain than registered",
}


def read_manifest(spark: SparkSession, root: str, name: str = "source_manifest.json"):
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/{name}", multiLine=True)


def manifest_files(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("files").alias("f")).select("f.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``record_key → pmcid, domain``; a repeated key is an error."""
    return assert_unique(read_jsonl(spark, path, REGISTRY_SCHEMA), ["record_key"])


def _open(uri: str):
    """A readable stream of a file, by the scheme of its address."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file" or uri.startswith("/"):
        # Listed paths read file:/a or file:///a and are not escaped.
        local = uri if scheme != "file" else "/" + rest.lstrip("/")
        return open(local, "rb")  # noqa: SIM115
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path)


def _streamed_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """sha256 of every file, read in blocks: a task holds one block, whatever the file's size."""
    for batch in batches:
        digests = []
        for path in batch["path"]:
            running = hashlib.sha256()
            with _open(path) as stream:
                while block := stream.read(BLOCK_BYTES):
                    running.update(block)
            digests.append(running.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "sha256": digests})


def file_digests(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``path, sha256`` of whole files of any size.

    Spark lists the files without reading them; each is then read once, block by block, by the
    task that has its name. Files are dealt over as many tasks as there are cores. Files without
    content are not listed.
    """
    listed = spark.read.format("binaryFile").load(paths).select("path")
    dealt = listed.repartition(spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInPandas(_streamed_digests, "path string, sha256 string")


def unsafe_paths(files: DataFrame) -> DataFrame:
    """Absolute paths and paths that climb out of the root."""
    parts = F.split("path", "/")
    climbs = F.array_contains(parts, "..")
    return files.filter(F.startswith("path", F.lit("/")) | climbs | F.contains("path", F.lit(":")))


def _fail_if_any(rows: DataFrame, message: str) -> None:
    found = rows.limit(1).collect()
    if found:
        raise ContractError(f"{message}: {found[0].asDict()}")


def relative_path(path: Column, root: str) -> Column:
    """Path below the root: what follows the last occurrence of the root folder's name."""
    folder = root.rstrip("/").split("/")[-1]
    return F.substring_index(path, f"/{folder}/", -1)


def _complete(line: Column) -> Column:
    """Does the raw line carry every required key? A key with a null value is there."""
    keys = F.coalesce(F.json_object_keys(line), F.array())
    return F.size(F.array_intersect(keys, F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED)


def _examined(rows: DataFrame) -> dict:
    """Counts of the whole delivery and one example of each breach, from one aggregate."""
    key = F.coalesce("record_key", F.lit("(null)"))
    alien = F.col("_known").isNull()
    return (
        rows.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("_id").alias("ids"),
            F.min(F.when(~F.col("_complete"), F.col("_path"))).alias("incomplete"),
            F.min(F.when(alien, key)).alias("alien"),
            F.min(F.when(F.col("_registered") != F.col("_declared"), key)).alias("misplaced"),
        )
        .first()
        .asDict()
    )


def governed_read(
    spark: SparkSession,
    root: str,
    manifest: DataFrame | None = None,
    registry: DataFrame | None = None,
    schema=CASE_SCHEMA,
) -> DataFrame:
    """Cases of the active files with canonical ``pmcid`` and ``source``.

    Checked first: path safety, file digests, row counts, required fields, registration,
    domain agreement, unique identity, totals. Any breach is an error. The lines are read
    once, joined with their file and the registry, and stored; every check and the result
    come from the stored rows.
    """
    manifest = manifest if manifest is not None else read_manifest(spark, root)
    head = manifest.select(
        "expected_total_rows", "expected_distinct_pmcids", "identity_registry"
    ).first()
    if head is None:
        raise ContractError("no manifest")
    if registry is None:
        registry = read_registry(spark, f"{root}/{head.identity_registry}")
    else:
        assert_unique(registry, ["record_key"])

    active = manifest_files(manifest).filter("active")
    _fail_if_any(unsafe_paths(active).select("path"), "listed file lies outside the delivery")
    # The manifest is one document, a single row: its file names fit wherever that row does.
    paths = [f"{root}/{r.path}" for r in active.select("path").collect()]

    digests = file_digests(spark, paths).select(
        relative_path(F.col("path"), root).alias("path"), F.col("sha256").alias("actual")
    )
    wrong = active.join(digests, "path", "left").filter(
        ~F.coalesce(F.col("sha256") == F.col("actual"), F.lit(False))
    )
    _fail_if_any(wrong.select("path"), "file content is not what was listed")

    lines = spark.read.text(paths).filter(F.col("value").rlike("\\S"))
    cases = lines.select(
        F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_case"),
        _complete(F.col("value")).alias("_complete"),
        relative_path(F.col("_metadata.file_path"), root).alias("_path"),
    ).select("_case.*", "_complete", "_path")
    declared = active.select(F.col("path").alias("_path"), F.col("domain").alias("_declared"))
    known = registry.select(
        "record_key",
        F.col("pmcid").alias("_id"),
        F.col("domain").alias("_registered"),
        F.lit(True).alias("_known"),
    )
    placed = written(cases.join(declared, "_path", "left").join(known, "record_key", "left"), "placed")

    per_file = placed.groupBy("_path").agg(F.count(F.lit(1)).alias("_rows"))
    counted = active.join(per_file, F.col("path") == F.col("_path"), "left")
    _fail_if_any(
        counted.filter(F.coalesce("_rows", F.lit(0)) != F.col("rows")).select("path", "_rows"),
        "file holds another number of rows than listed",
    )
    seen = _examined(placed)
    for breach, message in BREACHES.items():
        if seen[breach] is not None:
            raise ContractError(f"{message}: {seen[breach]}")
    for key in ("record_key", "_id"):
        _fail_if_any(duplicate_keys(placed, [key]), "one case delivered twice")
    for found, expected in (("rows", head.expected_total_rows), ("ids", head.expected_distinct_pmcids)):
        if seen[found] != expected:
            raise ContractError(f"delivery has {seen[found]} {found}, manifest says {expected}")
    fields = [c for c in cases.columns if c not in ("pmcid", "source", "_complete", "_path")]
    return placed.select(*fields, F.col("_registered").alias("source"), F.col("_id").alias("pmcid"))


def landing_inventory(
    spark: SparkSession, root: str, manifest: DataFrame, pattern: str = "cases/*"
) -> DataFrame:
    """``path``, below the root, of every landed file the manifest does not list."""
    landed = spark.read.format("binaryFile").load(f"{root}/{pattern}")
    relative = landed.select(relative_path(F.col("path"), root).alias("path"))
    return relative.join(manifest_files(manifest).select("path"), "path", "left_anti")
