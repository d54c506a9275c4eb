"""Operators give the same result however the rows are cut into partitions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import encode, metrics, splits
from tidemark.operators.contracts import ContractError, assert_columns, table_digest
from tidemark.operators.encode import CellFeatures, level_codes, one_hot_vector, ordinal_encode
from tidemark.operators.ordering import exact_median, hash_cut, ordered_positions, running_max, running_sums
from tidemark.session import scratch_path
from tidemark.sources import governed, readers, writers


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, many equal values."""
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaab") if i % 9 else None, rng.randint(0, 12), rng.randint(0, 1)) for i in range(500)]
    return spark.createDataFrame(rows, "id long, g string, v int, y int")


@pytest.mark.parametrize("partitions", [1, 6])
def test_positions_and_sums(spark, skewed, partitions):
    got = ordered_positions(skewed, ["g"], [F.col("v").desc(), F.col("id")], "p", "n", partitions)
    rows = got.collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: (-r.v, r.id))
        assert [r.p for r in mine] == list(range(1, len(mine) + 1))
        assert {r.n for r in mine} == {len(mine)}
    places = ordered_positions(skewed, [], [F.col("v").desc(), F.col("id")], "p", "n", partitions).collect()
    assert [r.id for r in sorted(places, key=lambda r: r.p)] == [r.id for r in sorted(rows, key=lambda r: (-r.v, r.id))]
    assert {r.p for r in places} == set(range(1, 501)) and {r.n for r in places} == {500}
    sums = running_sums(skewed, [], [F.col("id")], {"s": F.col("v").cast("long")}, {"s": "all"}, partitions)
    total = 0
    for r in sorted(sums.collect(), key=lambda r: r.id):
        total += r.v
        assert r.s == total
    assert r.all == total


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_running_values_across_partitions(spark, partitions):
    """Groups that end inside, span one and span many partitions; nulls, ties and small batches."""
    rng = random.Random(partitions)
    groups = [None, float("nan"), 1.0, 1.0, 1.0, 1.0, 2.0, 7.5]
    rows = [(i, rng.choice(groups), rng.choice([None, rng.randint(-9, 9)])) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, g double, v int").withColumn("t", F.timestamp_micros(F.col("v")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        sums = running_sums(frame, ["g"], [F.col("id")], {"s": F.col("v")}, {"s": "whole"}, partitions).collect()
        tops = running_max(frame, ["g"], [F.col("id")], {"v": F.col("v"), "t": F.col("t")}, partitions).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    key = lambda g: "nan" if g is not None and g != g else g
    seen, wants = {}, {}
    for i, g, v in rows:
        known = seen.setdefault(key(g), [])
        known += [] if v is None else [v]
        wants[i] = (sum(known) if known else None, max(known) if known else None)
    assert {r.id: r.s for r in sums} == {i: w[0] for i, w in wants.items()}
    assert all(r.whole == sum(seen[key(r.g)]) for r in sums)
    assert {r.id: r.v for r in tops} == {i: w[1] for i, w in wants.items()}
    micros = lambda t: None if t is None else int(round(t.timestamp() * 1e6))
    assert {r.id: micros(r.t) for r in tops} == {i: w[1] for i, w in wants.items()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_exchanged_once_or_never(spark, skewed, monkeypatch):
    """Positions take one range exchange of the rows, cuts none and no window over them."""
    from tidemark.operators import ordering

    plans = []
    real = ordering.written
    monkeypatch.setattr(ordering, "written", lambda df, name: plans.append((name, plan_of(df))) or real(df, name))
    out = ordered_positions(skewed, ["g"], [F.col("id")], "p")
    [scan] = [p for n, p in plans if n == "scanned"]
    assert scan.count("Exchange") == 1 and "rangepartitioning" in scan and "Window" not in scan
    # The offsets' side is aggregated by partition; the rows themselves stay where they are.
    assert "BroadcastHashJoin" in plan_of(out) and "SortMergeJoin" not in plan_of(out)
    plans.clear()
    out = hash_cut(skewed, ["g"], F.pmod(F.hash("id"), F.lit(2**31)).cast("long"), F.col("id"), 0.4, "kept")
    final = plan_of(out)
    assert "Window" not in final and "hashpartitioning" not in final and "SortMergeJoin" not in final
    [cells] = [p for n, p in plans if n == "cut-cells"]
    assert "hashpartitioning" not in cells and "Window" not in cells


@pytest.mark.parametrize("kinds", ["id long, g string, o long", "id long, g string, o string", "id long, g string, o double"])
def test_nth_rows(spark, monkeypatch, kinds):
    from tidemark.operators import ordering

    monkeypatch.setattr(ordering, "CELLS", 4)
    monkeypatch.setattr(ordering, "LAST_CELL", 3)
    rng = random.Random(len(kinds))
    make = {"long": lambda: rng.choice([None, 5, rng.randint(-9, 9) * 10**15]), "string": lambda: rng.choice([None, "", "prefix-" + str(rng.randint(0, 99)), chr(rng.randint(65, 1500))]), "double": lambda: rng.choice([None, float("nan"), -1e308, rng.random()])}
    rows = [(i, rng.choice("aab") if i % 9 else None, make[kinds.split()[-1]]()) for i in range(300)]
    got = ordering.nth_rows(spark.createDataFrame(rows, kinds), ["g"], ["o", "id"], F.floor(F.col("_size") / 3) + 1).collect()
    key = lambda r: (r[2] is not None, r[2] != r[2], b"" if r[2] is None else r[2].encode() if isinstance(r[2], str) else r[2] if r[2] == r[2] else 0, r[0])
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == g), key=key)
        assert [r.id for r in got if r.g == g] == [mine[len(mine) // 3][0]]


def test_exact_median(spark, skewed):
    import statistics

    got = {r.g: r.m for r in exact_median(skewed, ["g"], "v", "m").collect()}
    rows = skewed.collect()
    assert got == {g: statistics.median(r.v for r in rows if r.g == g) for g in ("a", "b", None)}


@pytest.mark.parametrize("fraction", [0.0, 0.35, 1.0])
def test_hash_cut_is_exact(spark, skewed, fraction):
    hashed = F.pmod(F.hash("id"), F.lit(2**31)).cast("long")
    rows = hash_cut(skewed, ["g"], hashed, F.col("id"), fraction, "kept").collect()
    for g in ("a", "b", None):
        mine = [r for r in rows if r.g == g]
        assert sum(r.kept for r in mine) == int(fraction * len(mine) + 0.5)


def test_ranking_metrics_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.4), (0, 0.4), (1, 0.1)]
    frame = spark.createDataFrame(rows, "y int, s double")
    for partitions in (1, 3):
        got = metrics.ranking_metrics(frame, "y", "s", partitions=partitions).first()
        ap = (1 / 3) * (1 / 2) + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 6)
        auc = sum((1 if a > b else 0.5 if a == b else 0) for y, a in rows if y for z, b in rows if not z) / 9
        assert got.average_precision == pytest.approx(ap) and got.roc_auc == pytest.approx(auc)
    one = metrics.ranking_metrics(frame.filter("y = 1"), "y", "s").first()
    assert one.roc_auc is None and one.average_precision == 1.0


def test_nested_rates_never_see_their_own_row(spark):
    """A level that occurs once always gets the prior, so its label cannot leak."""
    rows = [(i, f"only-{i}" if i % 2 else "shared", i % 3, i % 2 if i % 4 else 1) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, level string, fold int, y int")
    frame = frame.withColumn("inner", F.array(*[F.col("id").cast("int") % 5 for _ in range(3)]))
    got = encode.target_encode_nested(frame, "level", "y", "fold", "inner", 3, 5).collect()
    for r in got:
        for f in range(3):
            train = [x for x in rows if x[2] != f]
            rest = [x for x in train if x[1] == r.level and not (r.fold != f and x[0] % 5 == r.id % 5)]
            want = rest or train
            assert r.rates[f] == pytest.approx(sum(x[3] for x in want) / len(want))


def test_group_split_keeps_groups_whole(spark, skewed):
    rows = splits.group_split(skewed.filter("g is not null").withColumn("k", F.col("id") % 10), "k", 0.3, 1)
    sides = rows.select("k", "side").distinct().collect()
    assert len(sides) == 10 and sum(s.side == "test" for s in sides) == 3


def test_run_statistics(spark):
    runs = spark.createDataFrame([(0.67,), (0.37,), (1.0,), (0.67,)], "reward double")
    r = metrics.run_statistics(runs, "reward").first()
    assert (r.mean_reward, r.std_reward, r.solve_rate, r.pass_at_n) == (0.6775, 0.2229, 0.25, 1.0)
    assert (r.wilson_low, r.wilson_high) == (0.0456, 0.6994)


def test_contracts(spark, skewed):
    a = table_digest(skewed, ["id", "g", "v"], "s").first()
    assert a == table_digest(skewed.repartition(5, "v"), ["id", "g", "v"], "s").first()
    twice = skewed.unionByName(skewed.filter("id = 3"))
    assert a.digest != table_digest(twice, ["id", "g", "v"], "s").first().digest
    with pytest.raises(ContractError):
        assert_columns(["a", "b"], ["b", "a"])
    with pytest.raises(ValueError):
        CellFeatures(False, False, False).columns()


def _delivery(spark, tmp_path, change=None):
    import hashlib

    root = tmp_path / "delivery"
    (root / "cases").mkdir(parents=True)
    files, registry = [], []
    for domain in ("cardiac", "vascular"):
        rows = [{"record_key": f"{domain}-{i}", "title": "t", "case_summary": "s", "pmcid": "show"} for i in range(3)]
        registry += [{"record_key": r["record_key"], "pmcid": f"id-{r['record_key']}", "domain": domain} for r in rows]
        files.append({"domain": domain, "path": f"cases/{domain}.jsonl", "active": True, "rows": 3, "_rows": rows})
    manifest = {"release": "r", "expected_total_rows": 6, "expected_distinct_pmcids": 6, "files": files,
                "identity_registry": "registry.jsonl", "identity_key": "record_key"}
    if change:
        change(manifest, registry)
    for f in files:
        text = "\n\n".join(json.dumps(r) for r in f.pop("_rows")) + "\n"
        (root / "cases" / f["path"].split("/")[-1]).write_text(text)
        f.setdefault("sha256", hashlib.sha256(text.encode()).hexdigest())
    (root / "source_manifest.json").write_text(json.dumps(manifest, indent=1))
    (root / "registry.jsonl").write_text("".join(json.dumps(r) + "\n" for r in registry))
    return str(root)


BREACHES = {
    "file content": lambda m, r: m["files"][0].update(sha256="0" * 64),
    "another number": lambda m, r: m["files"][0].update(rows=4),
    "outside the delivery": lambda m, r: m["files"][0].update(path="../cases/cardiac.jsonl"),
    "lack a required key": lambda m, r: m["files"][0]["_rows"][0].pop("title"),
    "does not know": lambda m, r: r.pop(0),
    "another domain": lambda m, r: r[0].update(domain="vascular"),
    "repeats": lambda m, r: r.append(dict(r[0])),
    "delivered twice": lambda m, r: r[0].update(pmcid=r[1]["pmcid"]),
    "6 rows, manifest says 7": lambda m, r: m.update(expected_total_rows=7),
    "6 ids, manifest says 5": lambda m, r: m.update(expected_distinct_pmcids=5),
}


def test_governed_read(spark, tmp_path):
    rows = governed.governed_read(spark, _delivery(spark, tmp_path)).collect()
    assert {(r.record_key, r.pmcid, r.source) for r in rows} == {
        (f"{d}-{i}", f"id-{d}-{i}", d) for d in ("cardiac", "vascular") for i in range(3)
    }


@pytest.mark.parametrize("breach", BREACHES)
def test_governed_read_refuses(spark, tmp_path, breach):
    root = _delivery(spark, tmp_path, BREACHES[breach])
    with pytest.raises(ContractError, match=breach):
        governed.governed_read(spark, root).collect()


def test_files_are_hashed_block_by_block(spark, tmp_path, monkeypatch):
    """No task sees a whole file: a reader that refuses more than a block at a time suffices."""
    import hashlib

    class Narrow:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.stream.close()

        def read(self, size=-1):
            assert 0 < size <= 1000
            return self.stream.read(size)

    contents = {"a b.bin": b"x" * 12_345, "ü%20.bin": bytes(range(256)) * 40, "edge.bin": b"y" * 2000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(governed, "BLOCK_BYTES", 1000)
    real = governed._open
    monkeypatch.setattr(governed, "_open", lambda uri: Narrow(real(uri)))
    rows = [(r.path,) for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()]
    import pandas as pd

    [direct] = governed._streamed_digests(iter([pd.DataFrame(rows, columns=["path"])]))
    monkeypatch.undo()
    want = {hashlib.sha256(d).hexdigest() for d in contents.values()}
    assert set(direct["sha256"]) == want and len(direct) == 3
    assert {r.sha256 for r in governed.file_digests(spark, str(tmp_path)).collect()} == want


def test_a_required_key_may_hold_null(spark, tmp_path):
    root = _delivery(spark, tmp_path, lambda m, r: m["files"][0]["_rows"][0].update(title=None))
    rows = governed.governed_read(spark, root)
    assert rows.count() == 6 and rows.filter("title IS NULL").count() == 1


def test_inactive_files_are_not_read(spark, tmp_path):
    def change(m, r):
        m["files"][1].update(active=False)
        m.update(expected_total_rows=3, expected_distinct_pmcids=3)

    root = _delivery(spark, tmp_path, change)
    assert governed.governed_read(spark, root).count() == 3
    manifest = governed.read_manifest(spark, root)
    (tmp_path / "delivery" / "cases" / "again(1).jsonl").write_text("{}\n")
    extra = governed.landing_inventory(spark, root, manifest).collect()
    assert [r.path for r in extra] == ["cases/again(1).jsonl"]


def test_verified_table_is_rebuilt_when_spoilt(spark):
    path = scratch_path(spark, "verified-test")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    writers.verified(spark, path, {"v": 1}, build).count()
    stored = writers.verified(spark, path, {"v": 1}, build)
    assert len(calls) == 1
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    spark.range(6).write.mode("overwrite").parquet(folder)
    assert writers.verified(spark, path, {"v": 1}, build).count() == 5 and len(calls) == 2


def test_csv_order_follows_files_and_splits(spark, tmp_path):
    lines = {"a.csv": range(0, 40), "b.csv": range(40, 2000), "c.csv": range(2000, 2003)}
    for name, ids in lines.items():
        (tmp_path / name).write_text("n\n" + "".join(f"{i}\n" for i in ids))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.read_csv(spark, str(tmp_path), "n int", order="row_no")
        assert rows.rdd.getNumPartitions() > 3
        assert [r.n for r in rows.orderBy("row_no").collect()] == list(range(2003))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_levels_beyond_any_former_limit(spark):
    rows = spark.range(10_500).select("id", F.when(F.col("id") > 0, F.format_string("l%06d", "id")).alias("level"))
    codes = level_codes(rows, "level")
    coded = ordinal_encode(rows.union(spark.createDataFrame([(-5, "new")], rows.schema)), "level", codes, "code")
    assert coded.filter("id > 0 AND code <> id - 1").isEmpty()  # the missing level sorts last, as "nan"
    assert {(r.id, r.code) for r in coded.filter("id <= 0").collect()} == {(-5, -1), (0, 10_499)}
    sparse = one_hot_vector(rows, "level", codes, "v")
    assert {(r.id, r.v.size, tuple(r.v.indices)) for r in sparse.filter("id IN (0, 1, 2)").collect()} == {
        (0, 10_499, (10_498,)), (1, 10_499, ()), (2, 10_499, (0,))
    }


def test_one_hot_places_are_read_from_the_sparse_form(spark, monkeypatch):
    """The vectors of many levels are never laid out whole."""
    from bindings import evaluation

    rows = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", None), ("d", "s2"), ("e", "s0")], "row_key string, supplier string")
    monkeypatch.setattr(evaluation, "outcomes", lambda *_: rows)
    monkeypatch.setattr(evaluation, "vector_to_array", lambda *_: pytest.fail("laid out whole"), raising=False)
    got = {r.row_key: (r.length, r.place) for r in evaluation.one_hot_vectors(spark, "").collect()}
    assert got == {"a": (3, 1), "b": (3, 2), "c": (3, None), "d": (3, 2), "e": (3, 0)}
    monkeypatch.setattr(evaluation, "outcomes", lambda *_: rows.filter("row_key = 'a'"))
    assert [tuple(r) for r in evaluation.one_hot_vectors(spark, "").collect()] == [("a", 0, None)]


def test_reports_of_gap_and_staleness(spark, skewed):
    assert writers.stale(skewed, skewed.repartition(3), ["id", "v"])
    assert not writers.stale(skewed.filter("id > 0"), skewed, ["id", "v"])


def test_rows_are_not_dealt_out_by_group_or_class(spark):
    """A few large groups or classes do not gather in as many tasks."""
    rows = spark.range(4000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("y"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = splits.group_split(rows, "g", 0.34, 1)
        weighted = encode.with_class_weight(rows, "y", 0.5)
        for frame in (split, weighted):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert frame.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert split.groupBy("g").agg(F.count_distinct("side").alias("n")).filter("n <> 1").isEmpty()
    assert {round(r.weight, 12) for r in weighted.select("weight").distinct().collect()} == {1.0}


def test_second_delivery_is_not_read_by_one_task(spark, tmp_path, monkeypatch):
    """The one unlisted file holds the cases of its domain; no single task reads all domains for it."""
    from bindings import sources
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(i, f"t{i}\nbody", ("de", "en", "fr")[i % 3], "s") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    real = DataFrame.coalesce
    whole = lambda self, n: pytest.fail("read by one task") if "case_summary" in self.columns else real(self, n)
    monkeypatch.setattr(DataFrame, "coalesce", whole)
    assert [tuple(r) for r in sources.unlisted_files(spark, str(tmp_path)).collect()] == [(1, 20)]
