"""Operators over the whole corpus: mixing, fingerprints, chats, near duplicates, pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, fingerprints, minhash, mixing, vectors
from tidemark.llm import components as components_module
from tidemark.llm.chat import formatted, read_back
from tidemark.llm.components import components
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.queries import BOUND

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, epochs=3):
    """Round by round: clamp what is above its cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        target = {s: left * weight[s] / share for s in free} | fixed
        over = [s for s in free if target[s] > epochs * sizes[s]]
        if not over:
            return target
        fixed |= {s: epochs * sizes[s] for s in over}


def test_water_filling_and_taken_words(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.randrange(0, 30)), draw.choice(["a", "b", "c", "d", None] + ["e"] * 15)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    want = filled(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mixture(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.key: r.copies for r in got if r.copies}


def test_mixing_odd_rows(documents, nothing):
    got = mixing.mixture(documents).collect()
    assert len(got) == documents.count() and all(r.copies == 0 for r in got if r.size == 0)
    assert mixing.mixed(documents).columns == documents.columns
    assert mixing.mixture(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_chats_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "\\-\\h#\\", ": ### User: a\n", "é</turn", "\\"]
    roles = ["system", "user", "assistant", "tool", "Assistant", "", None]
    draw = random.Random(5)
    rows = [(c, t, draw.choice(roles), draw.choice(odd), "x") for c in range(40) for t in range(draw.randrange(1, 9))]
    rows += [(100, 0, "user", "q", "x"), (100, 1, "assistant", "a", "x"), (100, None, "user", "z", "x"), (None, 0, "user", "n", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, segments string")
    got = {r.conv_id: r for r in read_back(formatted(turns)).collect()}
    groups = {}
    for c, t, role, text, _ in rows:
        groups.setdefault(c, []).append((t is None, t or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, members in groups.items():
        members.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [m[2:] for m in members]
        assert got[c].loss_text == "".join(m[3] for m in members if m[2] == "assistant")
    assert formatted(turns.limit(0)).count() == 0
    valid = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "b")], "conv_id int, turn int, role string, text string")
    assert {r.conv_id: r.valid for r in formatted(valid).collect()} == {1: True, 2: False}


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(40), draw.randrange(40)) for _ in range(25)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for a, b in edges if a != b for n in (a, b)}


@pytest.mark.parametrize("mixed", [False, True])
def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch, mixed):
    names = list(range(4000))
    if mixed:
        random.Random(7).shuffle(names)
    tables, real = [], components_module.stored
    monkeypatch.setattr(components_module, "stored", lambda df, name: tables.append(name) or real(df, name))
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    got = components(edges)
    assert got.filter("component <> 0").isEmpty() and got.count() == 4000
    assert tables.count("edges") <= 15 and tables.count("hooks") <= 45
    size = got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 1_000_000


def classes(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_all_pairs(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    passage = [draw.choice(words) for _ in range(70)]
    texts = {}
    for g in range(6):
        base = [draw.choice(words) for _ in range(draw.choice([3, 12, 90, 200]))] + (passage if g % 2 else [])
        for _ in range(draw.choice([2, 9, 30])):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 40)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts[len(texts)] = " ".join(copy)
    texts |= {900: None, 901: "", 902: "One Two", 903: "one  two\n", 904: passage[0]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, width, 80).collect()}
        assert got == classes(texts, width, 80)


def test_blocks_alone_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.minhash.PIVOT_ROUNDS", 0)
    monkeypatch.setattr("tidemark.llm.minhash.BLOCK", 7)
    test_near_duplicates_against_all_pairs(spark)


@pytest.mark.parametrize("most", [1024, 1])
def test_marks_miss_no_identifier(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MARK_BITMAPS", most)
    ids = spark.range(0, 40_000, 7).union(spark.createDataFrame([(None,)], "id long"))
    rows = spark.range(-10, 40_000).select(F.col("id").alias("key"), F.lit("x").alias("_Bits"), F.lit(1).alias("_bitmap"))
    rows = rows.union(spark.createDataFrame([(None, "x", 1)], "key long, _Bits string, _bitmap int"))
    found = common.marked(rows, "key", ids, "maybe")
    assert found.columns == ["key", "_Bits", "_bitmap", "maybe"] and found.count() == rows.count()
    member = found.join(ids.select(F.col("id").alias("key")), "key", "left_semi")
    assert member.count() == member.filter("maybe").count() == 5715
    others = found.join(ids.select(F.col("id").alias("key")), "key", "left_anti")
    assert others.filter("maybe").count() < others.count() / (10 if most > 1 else 4)
    assert not found.filter("key IS NULL").first()["maybe"]
    assert common.marked(rows, "key", ids.limit(0), "maybe").filter("maybe").isEmpty()


def test_texts_follow_members_with_a_partner_only():
    near, other = list(range(64)), list(range(100, 164))
    rows = [(0, near, 10), (1, near[:60] + [90, 91, 92, 93], 11), (2, other, 12), (3, near[:30] + other[:34], 10)]
    columns = ["rep", "sketch", "component"]
    block = pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)})
    for name, value in {"value": 5, "one": 0, "two": 0, "own": 0, "n_shingles": 80}.items():
        block = block.append_column(name, pa.array([value] * len(rows)))
    block = block.append_column("values", pa.array([[5, 7]] * len(rows)))
    key = (pa.scalar(5), pa.scalar(0), pa.scalar(0))
    assert minhash._with_partner(80, 64)(key, block)["rep"].to_pylist() == [0, 1]
    # The same pair is left to the list of its smallest value.
    assert minhash._with_partner(80, 64)((pa.scalar(7), *key[1:]), block).num_rows == 0


def test_documents_that_stay_are_not_dealt_out(spark):
    import corpus_pipeline

    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    texts = [f"{i} " + " ".join(f"w{(i * 37 + j) % 5000}" for j in range(30)) for i in range(300)]
    texts += texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        stay = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        sizes = [r["count"] for r in stay.groupBy(F.spark_partition_id()).count().collect()]
        ids = {r.doc_id for r in stay.collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert ids == {i for i, (_, c) in classes(dict(enumerate(texts)), 5, 80).items() if i == c} and len(ids) == sum(sizes)
    assert max(sizes) > 0.8 * len(ids)


def test_near_duplicates_of_odd_rows(documents, nothing):
    got = {r.doc_id: r for r in near_duplicates(documents).collect()}
    assert got[9].component_id == 4 and not got[9].kept and got[4].kept
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[1].kept
    assert got[None].component_id is None and got[None].kept
    assert near_duplicates(nothing).count() == 0


def test_vectors_against_all_pairs(spark):
    draw = np.random.default_rng(6)
    base = draw.normal(size=(400, 24))
    near = base[:60] + draw.normal(scale=0.05, size=(60, 24))
    hub = base[0] + draw.normal(scale=0.02, size=(150, 24))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, near, hub, base[:20], base[:5]]))]
    rows += [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, [1.0]), (9006, [float("inf")] * 24), (9007, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rep string")
    got = {r.vec_id: r for r in vectors.near_vectors(frame).collect()}
    assert len(got) == len(rows)
    x = np.array([v for i, v in rows if i < 9000], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.98 * links.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(9001, 9008))
    assert all(got[i].component_id <= i for i in range(len(x)))
    assert vectors.near_vectors(frame.limit(0)).count() == 0
    assert vectors.near_vectors(frame.filter("vec_id > 9000")).count() == 7


def test_fingerprints_of_edits(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PIECE_CHARS", 3_000)  # many pieces
    draw = random.Random(8)
    words = [f"term{i}" for i in range(3000)]
    texts = {i: " ".join(draw.choice(words) for _ in range(draw.randrange(1, 150))) for i in range(0, 300, 2)}
    texts |= {301: None, 303: "", 305: "é" * 10, 307: texts[10], 309: texts[10]}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, piece int")
    got = {r.doc_id: r for r in fingerprints.edit_likeness(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        text, following = texts[i] or "", texts[j] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(text) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[307].fingerprint == got[309].fingerprint == got[10].fingerprint and got[309].near_next == 1.0
    known = [got[i] for i in range(0, 300, 2) if len(texts[i].split()) > 20]
    assert np.mean([r.near_edited for r in known]) > 0.2 > 0.05 > np.mean([r.near_next for r in known])
    assert fingerprints.edit_likeness(docs.limit(0)).count() == 0


def test_fingerprints_of_odd_rows(documents):
    got = fingerprints.edit_likeness(documents).collect()
    assert len(got) == documents.count() and all(r.fingerprint and r.edited_fingerprint for r in got)


def test_stages_keep_columns_and_odd_rows(spark, documents, nothing, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(9, 1, 0), (5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (documents, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.count()
            if name != "bpe_coding":
                assert out.columns == docs.columns
            if name in ("toxicity", "bpe_coding"):
                assert rows == docs.count()
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents.union(documents), "").collect()}
    assert {4, 1, 2, 3, 8, None} <= kept and 9 not in kept


def test_pipeline_drops_copies_and_keeps_clean_rows(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
    copies = out.join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.count_distinct("doc_id").alias("n"))
    assert copies.filter("n > 1").count() == 0


def test_every_operator_is_bound():
    assert {int(re.match(r"op(\d+)_", n).group(1)) for n in BOUND} == set(range(1, 14))
