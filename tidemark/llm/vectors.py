"""Near-duplicate vectors by product quantisation.

Vectors of unit length go to the list of their nearest coarse centre; what is left of them is
coded by the nearest entry of a codebook per subspace. A query visits lists, adds table entries
for the codes there, and pairs that come near the asked cosine are compared exactly, in double
precision. Coarse centres and codebooks are trained on a bounded sample.

A query visits its PROBES nearest centres and every other centre within twice the distance that
the asked cosine leaves two vectors. By the triangle inequality that meets every link of a
vector no farther from its own centre than that distance, however many lists a group of near
vectors is spread over; only a link of two vectors that both lie farther from their centres
depends on PROBES. Centres within the asked angle of a leader make one list, so a query is not
copied once for every centre of such a group.

Equal vectors are one class with a weight from the start. Lists and the queries that visit
them are cut into blocks of bounded size, so a list that holds a third of all vectors is many
tasks. Pairs never leave a task: it returns, per vector, how many links it found and the
smallest vector it is joined to; nor does a task hold the pairs of its whole block. A pair found from both sides is counted from both sides; one
found from one side only is counted for both by the side that finds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, kept, share, stored
from tidemark.llm.components import components

LIST_SIZE = 64  # vectors a list holds on average, up to MOST_LISTS lists
MOST_LISTS = 1 << 14
SAMPLE_A_LIST = 8  # sampled vectors a list for training: MOST_LISTS * SAMPLE_A_LIST at most
LEAST_SAMPLE = 4_096
SUBSPACES = 8
CODES = 256
PROBES = 12  # centres visited at least; those within 2 * reach(least) come on top
MARGIN = 0.3  # codes may understate a cosine by this much before the exact comparison
DENSE = 0.02  # share of near pairs from which one matrix product is cheaper than single ones
MEMBER_BLOCK = 1_024
QUERY_BLOCK = 4_096


def nearest(points: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """The ``count`` nearest centres of every point, nearest first, in blocks of points."""
    out = []
    half = (centres * centres).sum(1) / 2
    for at in range(0, len(points), 1_024):
        gap = half - points[at : at + 1_024] @ centres.T
        if count == 1:
            out.append(gap.argmin(1)[:, None])
            continue
        some = np.argpartition(gap, min(count, gap.shape[1]) - 1, axis=1)[:, :count]
        order = np.take_along_axis(gap, some, 1).argsort(1, kind="stable")
        out.append(np.take_along_axis(some, order, 1))
    return np.concatenate(out) if out else np.zeros((0, count), dtype=int)


def centres_of(points: np.ndarray, count: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds; a centre without points moves to a random one."""
    count = min(count, len(points))
    centres = points[random.permutation(len(points))[:count]].copy()
    for _ in range(rounds):
        at = nearest(points, centres)[:, 0]
        size = np.bincount(at, minlength=count)
        for d in range(points.shape[1]):
            centres[:, d] = np.bincount(at, points[:, d], count) / np.maximum(size, 1)
        empty = np.flatnonzero(size == 0)
        centres[empty] = points[random.integers(0, len(points), len(empty))]
    return centres


def reach(least: float) -> float:
    """The largest distance of two unit vectors whose cosine is at least ``least``."""
    return float(np.sqrt(max(0.0, 2 - 2 * least)))


def visited(points: np.ndarray, centres: np.ndarray, least: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of unit vectors the nearest centre, and all centres they visit."""
    half = (centres * centres).sum(1) / 2
    count = min(PROBES, len(centres))
    within = ((2 * reach(least)) ** 2 - 1) / 2 + 1e-9  # of |x - c|^2 = 1 + 2 * gap
    home, visits = [], []
    for at in range(0, len(points), 1_024):
        gap = half - points[at : at + 1_024] @ centres.T
        home.append(gap.argmin(1))
        close = gap <= within
        np.put_along_axis(close, np.argpartition(gap, count - 1, axis=1)[:, :count], True, 1)
        close[np.arange(len(gap)), home[-1]] = True
        visits += [np.flatnonzero(row) for row in close]
    return np.concatenate(home), visits


def merged(centres: np.ndarray, least: float) -> np.ndarray:
    """Per centre the leader whose list it belongs to: one within the asked angle, or itself."""
    size = np.linalg.norm(centres, axis=1, keepdims=True)
    way = np.divide(centres, size, out=np.zeros_like(centres), where=size > 0)
    close = np.concatenate([(way[at : at + 1_024] @ way.T >= least).sum(1) for at in range(0, len(way), 1_024)])
    leader = np.arange(len(way))
    free = close > 1
    for c in np.argsort(-close, kind="stable"):
        if free[c]:
            mine = free & (way @ way[c] >= least)
            mine[c] = True
            leader[mine] = c
            free &= ~mine
    return leader


def train(points: np.ndarray, lists: int, least: float, seed: int = 5) -> dict:
    """Coarse centres, their leaders, and residual codebooks from sampled unit vectors."""
    random = np.random.default_rng(seed)
    coarse = centres_of(points, lists, random)
    rest = points - coarse[nearest(points, coarse)[:, 0]]
    bounds = np.linspace(0, points.shape[1], min(SUBSPACES, points.shape[1]) + 1).astype(int)
    books = [centres_of(rest[:, a:b], CODES, random) for a, b in zip(bounds, bounds[1:])]
    return {"coarse": coarse, "leader": merged(coarse, least), "books": books, "bounds": bounds}


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x.reshape(0, 1)


def can_link() -> Column:
    """Whether a row can link: an identifier, finite components that are not all zero."""
    finite = F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    some = F.exists("embedding", lambda v: v != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & finite & some, F.lit(False))


def indexed(classes: DataFrame, model: dict, least: float) -> DataFrame:
    """Every class with its centre, its list, the lists it visits and its codes."""
    bounded_batches(classes.sparkSession, 2_048)
    shared = share(classes, model)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            x = unit(list(batch["embedding"]))
            if not len(x):
                continue
            cell, visits = visited(x, m["coarse"], least)
            rest = x - m["coarse"][cell]
            codes = np.stack(
                [nearest(rest[:, a:b], book)[:, 0] for book, a, b in zip(m["books"], m["bounds"], m["bounds"][1:])], 1
            ).astype(np.uint8)
            yield pd.DataFrame(
                {
                    "rep": batch["rep"],
                    "weight": batch["weight"],
                    "cell": cell.astype(np.int32),
                    "list": m["leader"][cell].astype(np.int32),
                    "probes": [np.unique(m["leader"][v]).astype(np.int32) for v in visits],
                    "codes": [c.tobytes() for c in codes],
                    "vector": [v.tobytes() for v in x],
                }
            )

    return classes.mapInPandas(
        assign, "rep long, weight long, cell int, list int, probes array<int>, codes binary, vector binary"
    )


FOUND = "rep long, added long, root long"


def linked_blocks(model: dict, least: float):
    """What one block of queries and one block of members find."""

    def run(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"rep": [], "added": [], "root": []}).astype("int64")
        if not len(queries) or not len(members):
            return nothing
        members = members.rename(columns=lambda c: c.removeprefix("m_"))
        x, y = (np.frombuffer(b"".join(f["vector"]), dtype=np.float64).reshape(len(f), -1) for f in (queries, members))
        codes = np.frombuffer(b"".join(members["codes"]), dtype=np.uint8).reshape(len(members), -1)
        cells, cell = np.unique(members["cell"].to_numpy(), return_inverse=True)
        a, b = (f["rep"].to_numpy(dtype=np.int64) for f in (queries, members))
        wa, wb = (f["weight"].to_numpy(dtype=np.int64) for f in (queries, members))
        # Members that do not visit a query's own list will not find it themselves.
        homes, place = np.unique(queries["list"].to_numpy(), return_inverse=True)
        visits = [frozenset(p) for p in members["probes"]]
        missed = np.array([[h not in v for v in visits] for h in homes.tolist()])
        ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.arange(len(ids))
        for_a, for_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            near = (part @ model["coarse"][cells].T)[:, cell]
            for s, book in enumerate(model["books"]):
                table = part[:, model["bounds"][s] : model["bounds"][s + 1]] @ book.T
                near += table[:, codes[:, s]]
            likely = near >= least - MARGIN
            if likely.mean() > DENSE:
                i, j = np.nonzero(likely & (part @ y.T >= least))
            else:
                i, j = np.nonzero(likely)
                hit = np.einsum("pd,pd->p", part[i], y[j]) >= least
                i, j = i[hit], j[hit]
            i = i + at
            other = a[i] != b[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            for_a += np.bincount(i, wb[j], len(a)).astype(np.int64)
            alone = missed[place[i], j]
            for_b += np.bincount(j[alone], wa[i[alone]], len(b)).astype(np.int64)
            p, q = where[: len(a)][i], where[len(a) :][j]
            while True:
                one, two = root[p], root[q]
                if (one == two).all():
                    break
                low = np.minimum(one, two)
                np.minimum.at(root, one, low)
                np.minimum.at(root, two, low)
                while (root[root] != root).any():
                    root = root[root]
        out = pd.DataFrame({"rep": np.concatenate([a, b]), "added": np.concatenate([for_a, for_b]), "root": ids[root[where]]})
        return out[(out["added"] > 0) | (out["root"] != out["rep"])]

    return run


def class_links(index: DataFrame, model: dict, least: float) -> DataFrame:
    """Rows of FOUND from all pairs of query and member blocks."""
    spark = index.sparkSession
    visits = index.withColumn("at", F.explode("probes"))
    # One row a list, and their number is bounded by MOST_LISTS.
    members = index.groupBy("list").agg(F.count(F.lit(1)).alias("_m"))
    queries = visits.groupBy(F.col("at").alias("list")).agg(F.count(F.lit(1)).alias("_q"))
    blocks = F.broadcast(
        members.join(queries, "list").select(
            F.col("list").alias("at"),
            F.ceil(F.col("_m") / MEMBER_BLOCK).cast("int").alias("_mb"),
            F.ceil(F.col("_q") / QUERY_BLOCK).cast("int").alias("_qb"),
        )
    )
    drawn = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = (
        visits.join(blocks, "at")
        .withColumn("qb", drawn(F.col("_qb")))
        .withColumn("mb", upto(F.col("_mb")))
        .select("at", "qb", "mb", "rep", "weight", "list", "vector")
    )
    held = (
        index.withColumnRenamed("list", "at")
        .join(blocks, "at")
        .withColumn("mb", drawn(F.col("_mb")))
        .withColumn("qb", upto(F.col("_qb")))
        .select(
            F.col("at").alias("at2"),
            F.col("qb").alias("qb2"),
            F.col("mb").alias("mb2"),
            *[F.col(c).alias(f"m_{c}") for c in ("rep", "weight", "cell", "probes", "codes", "vector")],
        )
    )
    shared = spark.sparkContext.broadcast(model)

    def run(key, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        find = kept(shared.value, f"find{least}", lambda value: linked_blocks(value, least))
        return find(key, q, m)

    return asked.groupBy("at", "qb", "mb").cogroup(held.groupBy("at2", "qb2", "mb2")).applyInPandas(run, FOUND)


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Rows that are null, zero, of null or non-finite components, without an identifier, or of
    another length than the commonest one link with nothing. Equal vectors link with each
    other. Identifiers are expected to be unique. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", "embedding")
    good = rows.filter(can_link())
    lengths = good.groupBy(F.size("embedding").alias("n")).count()
    common = lengths.orderBy(F.desc("count"), "n").first()
    size = common.n if common else 0
    usable = can_link() & F.coalesce(F.size("embedding") == size, F.lit(False))
    good = rows.filter(usable)
    classes = stored(
        good.groupBy("embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("weight")),
        "classes",
    )
    count = classes.count()
    if count:
        lists = int(min(MOST_LISTS, max(1, count // LIST_SIZE)))
        wanted = max(LEAST_SAMPLE, lists * SAMPLE_A_LIST)
        drawn = F.pmod(F.xxhash64(F.lit("train"), "rep"), F.lit(1 << 30)) < int(min(1.0, wanted / count) * (1 << 30))
        sample = classes.filter(drawn).limit(2 * wanted).select("rep", "embedding").toPandas().sort_values("rep")
        if not len(sample):
            sample = classes.limit(1).toPandas()
        model = train(unit(list(sample["embedding"])), lists, least)
        index = stored(indexed(classes, model, least), "index")
        found = stored(class_links(index, model, least), "links")
        label = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        counted = found.groupBy("rep").agg(F.sum("added").alias("added"))
        facts = classes.join(counted, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
            "embedding",
            (F.coalesce("added", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
        linked = good.join(facts, "embedding").select("vec_id", "n_links", "component_id")
    else:
        linked = good.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    alone = rows.filter(~usable)
    out = linked.unionByName(
        alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
