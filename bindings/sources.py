"""Source, sink and contract bindings: files are written from the driver tables first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bindings import evaluation, ledger as ledger_bindings, retrieval, serving as serving_bindings
from bindings.tables import LEDGER_SQL, ledger, table
from tidemark.operators import contracts, metrics, profiles
from tidemark.operators import retrieval as rt
from tidemark.session import cut_lineage, scratch_path, written
from tidemark.sources import governed, readers, writers


def csv_lookup(spark, sf):
    path = scratch_path(spark, "csv")
    parts = table(spark, sf, "part")
    parts.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").write.csv(path, header=True)
    rows = readers.read_csv(spark, path, parts.schema, order="row_no")
    # Files were written sorted, so the key must rise along the file order; a split is bounded.
    here = W.partitionBy("row_no.file", "row_no.split").orderBy("row_no")
    rises = F.coalesce(F.lag("p_partkey").over(here) < F.col("p_partkey"), F.lit(True))
    return rows.withColumn("rises", rises).drop("row_no")


CSV_LOOKUP = "SELECT *, true AS rises FROM part"


def jsonl_cases(spark, sf):
    path = scratch_path(spark, "jsonl")
    turns = table(spark, sf, "conversations")
    turns.write.json(path)
    return readers.read_jsonl(spark, path, turns.schema)


JSONL_CASES = "SELECT * FROM conversations"


def parquet_copy(spark, sf):
    path = scratch_path(spark, "parquet")
    orders = table(spark, sf, "orders")
    writers.write_parquet(orders, path)
    return readers.read_parquet(spark, path, orders.schema)


PARQUET_COPY = "SELECT * FROM orders"


def json_report(spark, sf):
    path = scratch_path(spark, "report")
    writers.write_json_report(profiles.credit_share(ledger(spark, sf)), path)
    return spark.read.schema(
        "n_lines long, n_credit long, credit_share double, first_date timestamp_ntz, last_date timestamp_ntz"
    ).json(path)


JSON_REPORT = f"""WITH {LEDGER_SQL}
SELECT count(*) AS n_lines, count(*) FILTER (is_credit) AS n_credit,
  round(avg(CASE WHEN is_credit THEN 1.0 ELSE 0.0 END), 5) AS credit_share,
  min("InvoiceDate") AS first_date, max("InvoiceDate") AS last_date FROM ledger"""


def verified_table(spark, sf):
    """Built, spoilt by a rewrite, and rebuilt: the rows are those of the first build."""
    path = scratch_path(spark, "verified")
    build = lambda: serving_bindings.zone_table(spark, sf)
    first = writers.verified(spark, path, {"version": 1}, build)
    stored = first.inputFiles()[0].rsplit("/", 1)[0]
    cut_lineage(first).withColumn("borough", F.lit("spoilt")).write.mode("overwrite").parquet(stored)
    return writers.verified(spark, path, {"version": 1}, build)


def delivery(spark, sf):
    """Cases as JSON lines per domain, an unlisted second delivery, manifest and registry."""
    root = scratch_path(spark, "delivery")
    docs = retrieval.cases(spark, sf).select(
        "record_key",
        F.concat(F.lit("show-"), "pmcid").alias("pmcid"),
        "title",
        "case_summary",
        F.col("source").alias("domain"),
        F.col("pmcid").alias("canonical"),
    )
    body = docs.drop("canonical")
    body.write.partitionBy("domain").json(f"{root}/cases")
    docs.select("record_key", F.col("canonical").alias("pmcid"), "domain").write.json(f"{root}/registry")
    below = lambda c: governed.relative_path(F.col(c), root)
    digests = governed.file_digests(spark, f"{root}/cases/*/*.json").withColumn("path", below("path"))
    counts = (
        spark.read.schema(readers.CASE_SCHEMA)
        .json(f"{root}/cases/*/*.json")
        .groupBy(below("_metadata.file_path").alias("path"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    listed = digests.join(counts, "path").select(
        F.regexp_extract("path", "domain=([^/]+)/", 1).alias("domain"),
        "path",
        F.lit(True).alias("active"),
        "rows",
        "sha256",
    )
    manifest = listed.agg(
        F.lit("r1").alias("release"),
        F.sum("rows").alias("expected_total_rows"),
        F.sum("rows").alias("expected_distinct_pmcids"),
        F.collect_list(F.struct("domain", "path", "active", "rows", "sha256")).alias("files"),
        F.lit("registry").alias("identity_registry"),
        F.lit("record_key").alias("identity_key"),
    )
    manifest.coalesce(1).write.json(f"{root}/source_manifest.json")
    # One file: its rows are read by many tasks and written by one.
    body.filter("domain = 'de'").drop("domain").repartition(1).write.mode("append").json(f"{root}/cases/domain=de")
    return root


def governed_cases(spark, sf):
    root = delivery(spark, sf)
    rows = governed.governed_read(spark, root)
    return rows.select("record_key", "pmcid", "source", F.length("title").alias("title_chars"))


GOVERNED_CASES = f"""WITH {retrieval.CASES_SQL}
SELECT record_key, pmcid, source, CAST(length(title) AS INTEGER) AS title_chars FROM cases"""


def unlisted_files(spark, sf):
    root = delivery(spark, sf)
    manifest = governed.read_manifest(spark, root)
    extra = governed.landing_inventory(spark, root, manifest, "cases/*/*.json")
    rows = (
        spark.read.schema(readers.CASE_SCHEMA)
        .json(f"{root}/cases/*/*.json")
        .select(governed.relative_path(F.col("_metadata.file_path"), root).alias("path"))
    )
    # Only the second delivery of one domain is unlisted; file names are random.
    return rows.join(extra, "path").agg(
        F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("rows")
    )


UNLISTED_FILES = "SELECT 1 AS files, count(*) AS rows FROM documents WHERE lang = 'de'"


def feature_contract(spark, sf):
    """Features as they are, and with rows broken by account."""
    # Read by both versions.
    rows = written(ledger_bindings.pit_features(spark, sf), "features")
    every = lambda n: F.col("customer_id") % n == 0
    broken = rows.withColumns(
        {
            "n_sku": F.when(every(3), F.col("n_lines") + 1).otherwise(F.col("n_sku")),
            "days_since_last": F.when(every(5), F.lit(-2)).otherwise(F.col("days_since_last")),
            "n_credit": F.when(every(7), F.lit(-1)).otherwise(F.col("n_credit")),
        }
    )
    found = [
        contracts.violations(frame, contracts.feature_rules()).withColumn("version", F.lit(name))
        for name, frame in (("as built", rows), ("broken", broken))
    ]
    return found[0].unionByName(found[1])


_FEATURE_RULES = {
    "counts_not_negative": "n_lines >= 0 AND n_sku >= 0 AND n_credit >= 0",
    "skus_within_lines": "n_sku <= n_lines",
    "credits_within_lines": "n_credit <= n_lines",
    "recency_from_minus_one": "days_since_last >= -1",
    "idle_means_minus_one": "(n_lines = 0) = (days_since_last = -1)",
    "idle_means_no_spend": "n_lines <> 0 OR spend_cents = 0",
    "key_present": "customer_id IS NOT NULL AND as_of IS NOT NULL",
}
FEATURE_CONTRACT = f"""WITH RECURSIVE {ledger_bindings.FEATURES_SQL},
versions AS (
  SELECT 'as built' AS version, * FROM features
  UNION ALL
  SELECT 'broken', * REPLACE (
    CASE WHEN customer_id % 3 = 0 THEN n_lines + 1 ELSE n_sku END AS n_sku,
    CASE WHEN customer_id % 5 = 0 THEN -2 ELSE days_since_last END AS days_since_last,
    CASE WHEN customer_id % 7 = 0 THEN -1 ELSE n_credit END AS n_credit) FROM features
)
""" + " UNION ALL ".join(
    f"SELECT count(*) AS n_rows, '{name}' AS rule, count(*) FILTER (NOT ({rule})) AS violations, version FROM versions GROUP BY version"
    for name, rule in _FEATURE_RULES.items()
)


def digest(spark, sf):
    """Digest of a table, of the same rows in another order, and of all rows but one."""
    orders = table(spark, sf, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]
    whole = contracts.table_digest(orders, columns, "salt").withColumn("version", F.lit("whole"))
    turned = contracts.table_digest(
        orders.repartition(7, "o_custkey").sort(F.col("o_orderdate").desc()), columns, "salt"
    ).withColumn("version", F.lit("reordered"))
    fewer = contracts.table_digest(orders.filter("o_orderkey <> 1"), columns, "salt").withColumn(
        "version", F.lit("one less")
    )
    return whole.unionByName(turned).unionByName(fewer)


def _digest_sql(source, version):
    row = """'=' || o_orderkey || chr(9) || '=' || o_custkey || chr(9) || '='
      || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || chr(9) || '=' || o_orderpriority"""
    sums = " || ':' || ".join(
        f"CAST(sum(CAST('0x' || h[{8 * i + 1}:{8 * i + 8}] AS BIGINT)) AS VARCHAR)" for i in range(8)
    )
    return f"""SELECT count(*) AS n_rows, sha256('salt:' || count(*) || ':' || {sums}) AS digest, '{version}' AS version
    FROM (SELECT sha256('salt' || chr(10) || {row}) AS h FROM {source})"""


DIGEST = " UNION ALL ".join(
    [
        _digest_sql("orders", "whole"),
        _digest_sql("orders", "reordered"),
        _digest_sql("orders WHERE o_orderkey <> 1", "one less"),
    ]
)


def holdout_disjoint(spark, sf):
    customers = table(spark, sf, "customer")
    sides = customers.withColumn("side", F.col("c_custkey") % 2)
    key = ["c_custkey"]
    return contracts.disjoint(sides.filter("side = 0"), sides.filter("side = 1"), key).unionByName(
        contracts.disjoint(sides, sides.filter("side = 1"), key)
    )


HOLDOUT_DISJOINT = """WITH sides AS (SELECT c_custkey, c_custkey % 2 AS side FROM customer),
shared AS (
  SELECT (SELECT count(*) FROM (SELECT c_custkey FROM sides WHERE side = 0 INTERSECT SELECT c_custkey FROM sides WHERE side = 1)) AS n
  UNION ALL SELECT count(*) FROM (SELECT c_custkey FROM sides INTERSECT SELECT c_custkey FROM sides WHERE side = 1)
)
SELECT n AS shared, n = 0 AS disjoint FROM shared"""


def duplicate_keys(spark, sf):
    return contracts.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATE_KEYS = """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"""


def set_difference(spark, sf):
    ordered = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"))
    rich = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return contracts.set_difference(rich, ordered)


SET_DIFFERENCE = """WITH a AS (SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_acctbal > 0),
b AS (SELECT DISTINCT o_custkey AS custkey FROM orders)
SELECT custkey, 'missing' AS side FROM (FROM a EXCEPT FROM b)
UNION ALL SELECT custkey, 'unexpected' FROM (FROM b EXCEPT FROM a)"""


def prediction_contract(spark, sf):
    rows = evaluation.predicted(spark, sf)
    shown = rows.select(
        F.when(F.col("soil_type") == 44, "?").otherwise(F.col("predicted").cast("string")).alias("p")
    )
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return contracts.prediction_report(shown, total, "p")


PREDICTION_CONTRACT = f"""WITH {evaluation.PREDICTED_SQL}
SELECT count(*) AS n_rows, count(*) FILTER (soil_type = 44) AS n_bad, count(*) FILTER (soil_type = 44) = 0 AS ok FROM predicted"""


_REPORTS = {"whole": ("true", 0.3), "one fold": ("fold = 0", 0.3), "empty fold": ("true", 0.0), "above one": ("true", 1.5)}


def report_structure(spark, sf):
    """A sound report, and reports that lack a fold, hold a fold without positives or a wrong score."""
    rows = evaluation.folded(spark, sf).withColumn("late", (F.col("fold") > 0).cast("int") * F.col("y"))
    out = []
    for name, (chosen, pooled) in _REPORTS.items():
        hit = F.col("late") if name == "empty fold" else F.col("y")
        folds = rows.filter(chosen).groupBy("fold").agg(F.avg(hit).alias("score"), F.count(F.lit(1)).alias("n_scored"))
        out.append(contracts.report_structure(folds, "score", pooled, "n_scored").withColumn("report", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


REPORT_STRUCTURE = f"WITH {evaluation.FOLDED_SQL} " + " UNION ALL ".join(
    f"""SELECT count(*) >= 2 AS enough_folds, bool_and(score > 0) AS folds_positive, sum(n) > 0 AS something_scored,
  {pooled} > 0 AND {pooled} <= 1 AS score_in_range, '{name}' AS report
FROM (SELECT avg({'CASE WHEN fold > 0 THEN y ELSE 0 END' if name == 'empty fold' else 'y'}) AS score, count(*) AS n
      FROM folded WHERE {chosen} GROUP BY fold)"""
    for name, (chosen, pooled) in _REPORTS.items()
)


def _lists(spark, sf):
    """Top documents by length, and the same list after a filter."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("pmcid"),
        F.col("lang").alias("source"),
        F.col("n_chars").cast("double").alias("score"),
        F.col("source").alias("site"),
    )
    from tidemark.operators.ordering import ordered_positions

    def top(rows):
        first = rows.orderBy(F.col("score").desc(), "pmcid").limit(20)
        placed = ordered_positions(first, [], [F.col("score").desc(), F.col("pmcid")])
        return placed.select("position", "pmcid", "source", "score")

    other = docs.filter("pmcid <> '1' AND source <> 'es'")
    return top(docs), top(other), rt.domain_counts(docs), rt.domain_counts(other)


_LISTS_SQL = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS pmcid, lang AS source, CAST(n_chars AS DOUBLE) AS score FROM documents),
a AS (SELECT row_number() OVER (ORDER BY score DESC, pmcid) AS position, * FROM docs ORDER BY score DESC, pmcid LIMIT 20),
b AS (SELECT row_number() OVER (ORDER BY score DESC, pmcid) AS position, * FROM docs
      WHERE pmcid <> '1' AND source <> 'es' ORDER BY score DESC, pmcid LIMIT 20),
both_lists AS (SELECT coalesce(a.position, b.position) AS position, a.pmcid AS p, b.pmcid AS q,
  a.source AS sp, b.source AS sq, a.score AS x, b.score AS y FROM a FULL JOIN b ON a.position = b.position)"""


def aligned_lists(spark, sf):
    got, want, _, _ = _lists(spark, sf)
    return contracts.align(got, want, ["position"], ["pmcid"]).select(
        "position", F.col("got.pmcid").alias("got_id"), F.col("want.pmcid").alias("want_id"), "same"
    )


ALIGNED_LISTS = f"""WITH {_LISTS_SQL}
SELECT position, p AS got_id, q AS want_id, p IS NOT DISTINCT FROM q AS same FROM both_lists"""


def results_match(spark, sf):
    got, want, _, _ = _lists(spark, sf)
    return contracts.results_match(got, want)


RESULTS_MATCH = f"""WITH {_LISTS_SQL}, c AS (SELECT coalesce(p = q AND sp = sq AND abs(x - y) <= 1e-10, false) AS ok FROM both_lists)
SELECT count(*) AS n, count(*) FILTER (NOT ok) AS mismatches, bool_and(ok) AS match FROM c"""


def drift_count(spark, sf):
    return contracts.drift_count(*_lists(spark, sf))


DRIFT_COUNT = f"""WITH {_LISTS_SQL}, d AS (SELECT count(*) FILTER (p IS DISTINCT FROM q) + 8 AS drift FROM both_lists)
SELECT drift, CASE WHEN drift = 0 THEN '0' WHEN drift <= 3 THEN '1-3' WHEN drift <= 8 THEN '4-8' ELSE '9+' END AS bucket FROM d"""


def panel_match(spark, sf):
    """The list against itself within the tolerance, against scores beyond it, and against another."""
    got, want, counts, other = _lists(spark, sf)
    near = got.withColumn("score", F.col("score") + 1e-12)
    # A long text is more than the tolerance off.
    far = got.withColumn("score", F.col("score") + F.col("score") * 1e-9)
    pairs = {"near": (near, counts), "far": (far, counts), "filtered": (want, other)}
    out = [
        contracts.panel_match(got, rows, 20, counts, found).withColumn("against", F.lit(name))
        for name, (rows, found) in pairs.items()
    ]
    return reduce(DataFrame.unionByName, out)


PANEL_MATCH = f"""WITH {_LISTS_SQL},
shape AS (SELECT count(*) = 20 AND count(DISTINCT pmcid) = 20 AS shape_ok FROM a),
counts AS (
  SELECT bool_and(n IS NOT DISTINCT FROM m) AS counts_ok
  FROM (SELECT source, count(*) AS n FROM docs GROUP BY source) x
  FULL JOIN (SELECT source, count(*) AS m FROM docs WHERE pmcid <> '1' AND source <> 'es' GROUP BY source) y USING (source)
),
other AS (
  SELECT bool_and(coalesce(p = q AND sp = sq AND abs(x - y) <= 1e-10, false)) AS match FROM both_lists
),
cases AS (
  SELECT 'near' AS against, true AS counts_ok, bool_and(abs(score - (score + 1e-12)) <= 1e-10) AS match FROM a
  UNION ALL SELECT 'far', true, bool_and(abs(score - (score + score * 1e-9)) <= 1e-10) FROM a
  UNION ALL SELECT 'filtered', counts_ok, match FROM counts, other
)
SELECT shape_ok, counts_ok, match, shape_ok AND counts_ok AND match AS panel_ok, against FROM cases, shape"""


def estimate_gaps(spark, sf):
    """Mean text length of every source as told by every other document, against the true one."""
    docs = table(spark, sf, "documents")
    told = F.avg(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")))
    means = docs.groupBy("source").agg((told / F.avg("n_chars")).alias("told"))
    return means.select("source", metrics.within_gap(F.col("told"), F.lit(1.0), 0.05).alias("agrees"), F.round("told", 6).alias("told"))


ESTIMATE_GAPS = """SELECT source, coalesce(abs(told - 1.0) <= 0.05, false) AS agrees, round(told, 6) AS told
FROM (SELECT source, avg(n_chars) FILTER (doc_id % 2 = 0) / avg(n_chars) AS told FROM documents GROUP BY source)"""


def staleness(spark, sf):
    """Is a stored table still right: after a reordering, a changed value, and a lost row."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    versions = {
        "reordered": orders.repartition(5, "o_custkey"),
        "value changed": orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 1, "X").otherwise(F.col("o_orderstatus"))),
        "row lost": orders.filter("o_orderkey <> 1"),
    }
    rows = [(name, writers.stale(rows, orders, orders.columns, "salt")) for name, rows in versions.items()]
    return spark.createDataFrame(rows, "version string, equal boolean")


STALENESS = """WITH first AS (SELECT * FROM orders WHERE o_orderkey = 1)
SELECT 'reordered' AS version, (SELECT count(*) FROM orders) = (SELECT count(*) FROM orders) AS equal
UNION ALL SELECT 'value changed', count(*) FILTER (o_orderstatus <> 'X') = 0 FROM first
UNION ALL SELECT 'row lost', count(*) = 0 FROM first"""


def result_shape(spark, sf):
    got, _, _, _ = _lists(spark, sf)
    return contracts.result_shape(got, 20, ["en", "fr", "de"])


RESULT_SHAPE = f"""WITH {_LISTS_SQL}
SELECT count(*) = 20 AS length_ok, count(DISTINCT pmcid) = 20 AS ids_unique,
  count(*) FILTER (source NOT IN ('en', 'fr', 'de')) = 0 AS sources_known, true AS scores_numeric FROM a"""


def source_counts(spark, sf):
    return profiles.counts_by(table(spark, sf, "documents"), "source")


SOURCE_COUNTS = "SELECT source, count(*) AS n FROM documents GROUP BY 1"


def top_sources(spark, sf):
    return profiles.top_counts(table(spark, sf, "lineitem"), "l_suppkey", 10)


TOP_SOURCES = "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10"


def anchor_hits(spark, sf):
    from tidemark.operators.dims import anchor_hits as hits

    docs = retrieval.cases(spark, sf)
    found = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("pmcid"))
    return hits(found, docs.select("pmcid", "source"), "pmcid", "source")


ANCHOR_HITS = "SELECT lang AS source, count(*) AS hits FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1"


def canonical_order(spark, sf):
    rows = ledger(spark, sf).select("customer_id", "InvoiceDate").distinct()
    return rows.orderBy("InvoiceDate", "customer_id")


CANONICAL_ORDER = f"WITH {LEDGER_SQL} SELECT DISTINCT customer_id, \"InvoiceDate\" FROM ledger"

BOUND = {
    "csv_lookup": (csv_lookup, CSV_LOOKUP),
    "jsonl_records": (jsonl_cases, JSONL_CASES),
    "parquet_copy": (parquet_copy, PARQUET_COPY),
    "json_report": (json_report, JSON_REPORT),
    "verified_materialization": (verified_table, serving_bindings.ZONE_TABLE),
    "governed_read": (governed_cases, GOVERNED_CASES),
    "landing_inventory": (unlisted_files, UNLISTED_FILES),
    "feature_contract": (feature_contract, FEATURE_CONTRACT),
    "table_digest": (digest, DIGEST),
    "holdout_disjoint": (holdout_disjoint, HOLDOUT_DISJOINT),
    "duplicate_keys": (duplicate_keys, DUPLICATE_KEYS),
    "set_difference": (set_difference, SET_DIFFERENCE),
    "prediction_contract": (prediction_contract, PREDICTION_CONTRACT),
    "report_structure": (report_structure, REPORT_STRUCTURE),
    "aligned_lists": (aligned_lists, ALIGNED_LISTS),
    "results_match": (results_match, RESULTS_MATCH),
    "drift_count": (drift_count, DRIFT_COUNT),
    "panel_match": (panel_match, PANEL_MATCH),
    "estimate_gaps": (estimate_gaps, ESTIMATE_GAPS),
    "staleness": (staleness, STALENESS),
    "result_shape": (result_shape, RESULT_SHAPE),
    "source_counts": (source_counts, SOURCE_COUNTS),
    "top_sources": (top_sources, TOP_SOURCES),
    "anchor_hits": (anchor_hits, ANCHOR_HITS),
    "canonical_order": (canonical_order, CANONICAL_ORDER),
}
