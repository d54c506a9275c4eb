"""Inputs on which a part of the whole job used to be left out."""

import numpy as np

from tidemark.llm import mixing, vectors


def test_a_third_of_all_vectors_near_each_other(spark):
    draw = np.random.default_rng(11)
    count, size = 9_000, 32
    way = draw.normal(size=size)
    group = way / np.linalg.norm(way) + draw.normal(scale=0.04, size=(count // 3, size))
    x = np.concatenate([draw.normal(size=(count - len(group), size)), group])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_vectors(frame).collect()}
    links = (x @ x.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in range(count)])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    first = count - count // 3
    assert {got[i].component_id for i in range(first, count) if links[i]} == {first}


def test_sources_with_one_long_document_reach_their_target(spark):
    rows = []
    for k in range(6):
        rows += [(len(rows) + i, "w " * (1_500 if i == 0 else 15), f"s{k:02}") for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs).collect()
    target, taken = {r.source: r.target for r in got}, dict.fromkeys({r.source for r in got}, 0)
    for r in got:
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 15 for s in taken)
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)
