"""Cohort, encoding, split and metric bindings on orders, line items and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.tables import spread_table, table
from tidemark.functions.hashing import seeded_folds, seeded_hash
from tidemark.functions.keys import concat_level
from tidemark.operators import cohort, encode, metrics, ordering, profiles, splits

SEED = 7
OUTER, INNER = 5, 5
SEGMENTS = ("BUILDING", "MACHINERY", "HOUSEHOLD")


def _hash_sql(seed, *keys):
    text = " || ':' || ".join([f"'{seed}'", *keys])
    return f"CAST('0x' || md5({text})[1:8] AS BIGINT)"


# Cohort: orders are encounters, customers are patients, the segment stands for sex.
def encounters(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


ENCOUNTERS_SQL = """
encounters AS (SELECT orders.*, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
chosen AS (SELECT * FROM encounters WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')),
observed AS (
  SELECT * FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey) AS latest FROM chosen)
  WHERE o_orderkey <> latest
)
"""


def observable_cohort(spark, sf):
    rows = cohort.select_cohort(encounters(spark, sf), "c_mktsegment", "o_custkey", "o_orderkey", SEGMENTS)
    return rows.select("o_orderkey", "o_custkey", "c_mktsegment")


OBSERVABLE_COHORT = f"WITH {ENCOUNTERS_SQL} SELECT o_orderkey, o_custkey, c_mktsegment FROM observed"


def outcome_mix(spark, sf):
    rows = cohort.select_cohort(encounters(spark, sf), "c_mktsegment", "o_custkey", "o_orderkey", SEGMENTS)
    return profiles.outcome_mix(rows.withColumn("late", F.col("o_orderstatus") == "P"), "late")


OUTCOME_MIX = f"""WITH {ENCOUNTERS_SQL}
SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS positives,
  round(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END), 4) AS rate FROM observed"""


# Outcomes: one row per line, y is 'returned', levels come from part and supplier.
def outcomes(spark, sf):
    lines = spread_table(spark, sf, "lineitem")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    level = F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey").cast("string"))
    return rows.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("long")
        ).alias("row_key"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        "l_returnflag",
        "p_brand",
        "p_type",
        "p_size",
        level.alias("supplier"),
        concat_level(F.col("p_brand"), F.col("p_type"), level).alias("triple"),
        "s_nationkey",
        "l_quantity",
        "l_discount",
        "l_shipdate",
    )


OUTCOMES_SQL = """
outcomes AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
           || CAST(trunc(l_extendedprice) AS BIGINT) AS row_key,
         CAST(l_returnflag = 'R' AS INTEGER) AS y, l_returnflag, p_brand, p_type, p_size,
         CASE WHEN l_suppkey % 9 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS supplier,
         p_brand || '|' || p_type || '|'
           || CASE WHEN l_suppkey % 9 <> 0 THEN CAST(l_suppkey AS VARCHAR) ELSE 'nan' END AS triple,
         s_nationkey, l_quantity, l_discount, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)
"""


def interaction_levels(spark, sf):
    return outcomes(spark, sf).groupBy("triple").agg(F.count(F.lit(1)).alias("n"))


INTERACTION_LEVELS = f"WITH {OUTCOMES_SQL} SELECT triple, count(*) AS n FROM outcomes GROUP BY 1"


def target_rates(spark, sf):
    out = encode.target_rates(outcomes(spark, sf), "supplier", "y")
    return out.select("level", F.round("rate", 9).alias("rate"), "n")


TARGET_RATES = f"""WITH {OUTCOMES_SQL}
SELECT supplier AS level, round(avg(y), 9) AS rate, count(*) AS n
FROM outcomes WHERE supplier IS NOT NULL GROUP BY 1"""


def rate_lookup(spark, sf):
    """Rates of large parts applied to all parts: suppliers unseen there take the prior."""
    rows = outcomes(spark, sf)
    train = rows.filter(F.col("p_size") >= 45)
    coded = encode.target_encode(train, rows, ["supplier", "triple"], "y")
    return coded.select(
        "row_key", F.round("supplier_rate", 9).alias("supplier_rate"), F.round("triple_rate", 9).alias("triple_rate")
    )


RATE_LOOKUP = f"""WITH {OUTCOMES_SQL}, train AS (SELECT * FROM outcomes WHERE p_size >= 45),
a AS (SELECT supplier, avg(y) AS r FROM train WHERE supplier IS NOT NULL GROUP BY 1),
b AS (SELECT triple, avg(y) AS r FROM train GROUP BY 1)
SELECT row_key, round(coalesce(a.r, (SELECT avg(y) FROM train)), 9) AS supplier_rate,
  round(coalesce(b.r, (SELECT avg(y) FROM train)), 9) AS triple_rate
FROM outcomes o LEFT JOIN a ON o.supplier = a.supplier LEFT JOIN b ON o.triple = b.triple"""


def folded(spark, sf):
    rows = splits.kfold(outcomes(spark, sf), "row_key", OUTER, SEED)
    return rows.withColumn("inner", seeded_folds(SEED, INNER, OUTER, F.col("row_key")))


_INNER = ", ".join(
    f"CAST(CAST('0x' || md5('{SEED}/0:' || row_key)[{4 * f + 1}:{4 * f + 4}] AS BIGINT) % {INNER} AS INTEGER)"
    for f in range(OUTER)
)
FOLDED_SQL = f"""{OUTCOMES_SQL},
folded AS (
  SELECT *, CAST({_hash_sql(SEED, "row_key")} % {OUTER} AS INTEGER) AS fold, [{_INNER}] AS inner_of FROM outcomes
)
"""


def fold_membership(spark, sf):
    return splits.kfold(outcomes(spark, sf), "row_key", OUTER, SEED).select("row_key", "fold")


FOLD_MEMBERSHIP = f"WITH {FOLDED_SQL} SELECT row_key, fold FROM folded"


def inner_folds(spark, sf):
    rows = splits.kfold(outcomes(spark, sf), "row_key", OUTER, SEED)
    return splits.inner_folds(rows, "row_key", INNER, SEED).groupBy("fold", "inner_fold").agg(
        F.count(F.lit(1)).alias("n")
    )


INNER_FOLDS = f"""WITH {FOLDED_SQL}
SELECT fold, CAST({_hash_sql(SEED, "fold", "row_key")} % {INNER} AS INTEGER) AS inner_fold, count(*) AS n
FROM folded GROUP BY ALL"""


def nested_encoding(spark, sf):
    coded = encode.target_encode_nested(folded(spark, sf), "triple", "y", "fold", "inner", OUTER, INNER)
    return coded.select("row_key", "fold", F.transform("rates", lambda r: F.round(r, 9)).alias("rates"))


NESTED_ENCODING = f"""WITH {FOLDED_SQL},
train AS (
  SELECT f AS held, triple, inner_of[f + 1] AS i, y
  FROM folded, (SELECT unnest(range({OUTER})) AS f) WHERE fold <> f
),
prior AS (SELECT held, avg(y) AS p FROM train GROUP BY 1),
part AS (SELECT held, triple, i, sum(y) AS s, count(*) AS n FROM train GROUP BY ALL),
whole AS (SELECT held, triple, sum(s) AS s, sum(n) AS n FROM part GROUP BY ALL),
coded AS (
  SELECT o.row_key, o.fold, p.held, p.p,
    coalesce(w.s, 0) - CASE WHEN o.fold <> p.held THEN coalesce(q.s, 0) ELSE 0 END AS s,
    coalesce(w.n, 0) - CASE WHEN o.fold <> p.held THEN coalesce(q.n, 0) ELSE 0 END AS n
  FROM folded o CROSS JOIN prior p
  LEFT JOIN whole w ON w.held = p.held AND w.triple = o.triple
  LEFT JOIN part q ON q.held = p.held AND q.triple = o.triple AND q.i = o.inner_of[p.held + 1]
)
SELECT row_key, fold, list(round(CASE WHEN n > 0 THEN s / n ELSE p END, 9) ORDER BY held) AS rates
FROM coded GROUP BY ALL"""


def stratified_split(spark, sf):
    rows = splits.stratified_split(outcomes(spark, sf), "l_returnflag", "row_key", 0.25, SEED)
    return rows.select("row_key", "l_returnflag", "side")


def _cut_sql(hashed, fraction, partition=""):
    over = f"PARTITION BY {partition}" if partition else ""
    return f"""CASE WHEN row_number() OVER ({over} ORDER BY {hashed}) <=
      floor(count(*) OVER ({over}) * {fraction} + 0.5) THEN 'test' ELSE 'train' END"""


STRATIFIED_SPLIT = f"""WITH {OUTCOMES_SQL}
SELECT row_key, l_returnflag, {_cut_sql(_hash_sql(SEED, "row_key") + ", row_key", 0.25, "l_returnflag")} AS side
FROM outcomes"""


def random_split(spark, sf):
    return splits.random_split(outcomes(spark, sf), "row_key", 0.25, SEED).select("row_key", "side")


RANDOM_SPLIT = f"""WITH {OUTCOMES_SQL}
SELECT row_key, {_cut_sql(_hash_sql(SEED, "row_key") + ", row_key", 0.25)} AS side FROM outcomes"""


def group_split(spark, sf):
    rows = splits.group_split(outcomes(spark, sf), "s_nationkey", 0.3, SEED)
    return rows.groupBy("s_nationkey", "side").agg(F.count(F.lit(1)).alias("n"))


GROUP_SPLIT = f"""WITH {OUTCOMES_SQL},
sides AS (
  SELECT s_nationkey, {_cut_sql(_hash_sql(SEED, "s_nationkey") + ", s_nationkey", 0.3)} AS side
  FROM (SELECT DISTINCT s_nationkey FROM outcomes)
)
SELECT s_nationkey, side, count(*) AS n FROM outcomes JOIN sides USING (s_nationkey) GROUP BY ALL"""


def positional_split(spark, sf):
    order = [F.col("l_shipdate"), F.col("row_key")]
    rows = splits.positional_split(outcomes(spark, sf), order, 0.75)
    return rows.select("row_key", "side")


POSITIONAL_SPLIT = f"""WITH {OUTCOMES_SQL}
SELECT row_key, CASE WHEN row_number() OVER (ORDER BY l_shipdate, row_key) <= floor(count(*) OVER () * 0.75)
  THEN 'train' ELSE 'score' END AS side FROM outcomes"""


def rebalanced(spark, sf):
    rows = splits.rebalance_negatives(outcomes(spark, sf), "y", "row_key", 0.35, SEED)
    return rows.select("row_key", "y")


REBALANCED = f"""WITH {OUTCOMES_SQL}
SELECT row_key, y FROM (
  SELECT *, {_cut_sql(_hash_sql(SEED, "row_key") + ", row_key", 0.35, "y")} AS side FROM outcomes)
WHERE y = 1 OR side = 'test'"""


def seeded_pick(spark, sf):
    rows = splits.seeded_pick(
        outcomes(spark, sf), "s_nationkey", "s_nationkey", ["row_key"], 11
    )
    return rows.select("s_nationkey", "row_key")


SEEDED_PICK = f"""WITH {OUTCOMES_SQL}
SELECT s_nationkey, row_key FROM (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY row_key) AS n,
         count(*) OVER (PARTITION BY s_nationkey) AS size FROM outcomes)
WHERE n - 1 = (11 + s_nationkey) % size"""


def singleton_share(spark, sf):
    return encode.singleton_share(outcomes(spark, sf), "triple")


SINGLETON_SHARE = f"""WITH {OUTCOMES_SQL}
SELECT count(*) AS levels, count(*) FILTER (n = 1) AS singletons,
  round(count(*) FILTER (n = 1) / count(*), 6) AS share
FROM (SELECT triple, count(*) AS n FROM outcomes GROUP BY 1)"""


def one_hot_vectors(spark, sf):
    """Suppliers as one sparse vector: its length and the place of its one, by row."""
    rows = outcomes(spark, sf).select("row_key", "supplier")
    coded = encode.one_hot_vector(rows, "supplier", encode.level_codes(rows, "supplier"), "v")
    # Read from the sparse form: laid out whole, every row would hold a number for each level.
    held = F.unwrap_udt("v")
    place = F.get(held["indices"], F.array_position(held["values"], F.lit(1.0)).cast("int") - 1)
    return coded.select("row_key", held["size"].cast("long").alias("length"), place.cast("long").alias("place"))


ONE_HOT_VECTORS = f"""WITH {OUTCOMES_SQL},
levels AS (SELECT DISTINCT coalesce(supplier, 'nan') AS v FROM outcomes),
codes AS (SELECT v, row_number() OVER (ORDER BY v) - 2 AS place FROM levels)
SELECT row_key, (SELECT count(*) - 1 FROM levels) AS length, CASE WHEN place >= 0 THEN place END AS place
FROM outcomes JOIN codes ON v = coalesce(supplier, 'nan')"""


def one_hot(spark, sf):
    kind = F.when(F.col("p_type") != "PROMO", F.col("p_type"))
    rows = outcomes(spark, sf).select("row_key", kind.alias("kind"), F.col("l_returnflag").alias("flag"))
    coded = encode.one_hot(rows, ["kind", "flag"])
    columns = [c for c in coded.columns if c.startswith(("kind_", "flag_"))]
    totals = coded.agg(*[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias("rows"))
    return totals.unpivot("rows", columns, "indicator", "ones")


ONE_HOT = f"""WITH {OUTCOMES_SQL},
levels AS (
  SELECT 'kind' AS c, coalesce(nullif(p_type, 'PROMO'), 'nan') AS v FROM outcomes
  UNION ALL SELECT 'flag', l_returnflag FROM outcomes
),
counted AS (SELECT c, v, count(*) AS ones, row_number() OVER (PARTITION BY c ORDER BY v) AS n FROM levels GROUP BY c, v)
SELECT (SELECT count(*) FROM outcomes) AS rows, c || '_' || v AS indicator, ones FROM counted WHERE n > 1"""


def cells(spark, sf):
    """Line items as cells: ten numbers, an area, a soil code and a class."""
    rows = outcomes(spark, sf)
    numbers = {c: (F.col("l_quantity") + i).alias(c) for i, c in enumerate(encode.TERRAIN)}
    area = F.element_at(F.array(*[F.lit(a) for a in encode.AREAS[:3]]), F.col("s_nationkey") % 3 + 1)
    kind = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 3).otherwise(6)
    return rows.select(
        "row_key", *numbers.values(), area.alias("wilderness_area"),
        (F.col("p_size") % 45).alias("soil_type"), kind.alias("cover_type"), "s_nationkey", "l_discount",
    )


CELLS_SQL = f"""{OUTCOMES_SQL},
cells AS (
  SELECT *, ['rawah', 'neota', 'comanche_peak'][s_nationkey % 3 + 1] AS wilderness_area, p_size % 45 AS soil_type,
         CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 6 END AS cover_type FROM outcomes
)
"""


def cell_matrix(spark, sf):
    """Sums of the matrix columns without terrain, in the order the model sees them."""
    spec = encode.CellFeatures(terrain=False)
    matrix = encode.cell_matrix(cells(spark, sf), spec)
    totals = matrix.agg(*[F.sum(c).alias(c) for c in spec.columns()])
    return totals.unpivot([], spec.columns(), "indicator", "ones")


CELL_MATRIX = f"""WITH {CELLS_SQL}
SELECT 'soil_' || s AS indicator, (SELECT count(*) FROM cells WHERE soil_type = s) AS ones FROM (SELECT unnest(range(1, 41)) AS s)
UNION ALL SELECT 'area_' || a, (SELECT count(*) FROM cells WHERE wilderness_area = a)
FROM (SELECT unnest(['rawah', 'neota', 'comanche_peak', 'cache_la_poudre']) AS a)"""


def terrain_families(spark, sf):
    spec = encode.CellFeatures(soil_type=False, wilderness_area=False)
    matrix = encode.cell_matrix(cells(spark, sf), spec, ["cover_type"])
    return matrix.groupBy("cover_type").agg(*[F.sum(c).alias(c) for c in spec.columns()])


TERRAIN_FAMILIES = f"""WITH {CELLS_SQL}
SELECT cover_type, {", ".join(f"sum(l_quantity + {i}) AS {c}" for i, c in enumerate(encode.TERRAIN))}
FROM cells GROUP BY 1"""


def class_weights(spark, sf):
    out = encode.class_weights(cells(spark, sf), "cover_type", 0.5)
    return out.select("cover_type", "n", F.round("weight", 9).alias("weight"))


CLASS_WEIGHTS = f"""WITH {CELLS_SQL}, counts AS (SELECT cover_type, count(*) AS n FROM cells GROUP BY 1)
SELECT cover_type, n, round(((SELECT sum(n) FROM counts) / ((SELECT count(*) FROM counts) * n)) ** 0.5, 9) AS weight
FROM counts"""


def routed_slice(spark, sf):
    narrow = cohort.features_only(cohort.routed_slice(cells(spark, sf), "cover_type", [3, 6], "narrow"), "cover_type")
    return narrow.agg(F.count(F.lit(1)).alias("rows_served"))


ROUTED_SLICE = f"WITH {CELLS_SQL} SELECT count(*) AS rows_served FROM cells WHERE cover_type NOT IN (3, 6)"


def class_shares(spark, sf):
    out = metrics.class_shares(cells(spark, sf), "cover_type")
    return out.select("cover_type", "n", F.round("share", 9).alias("share"))


CLASS_SHARES = f"""WITH {CELLS_SQL}
SELECT cover_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM cells), 9) AS share FROM cells GROUP BY 1"""


def class_grid(spark, sf):
    return profiles.class_grid(cells(spark, sf), "wilderness_area", "cover_type", [1, 2, 3, 6])


CLASS_GRID = f"""WITH {CELLS_SQL}
SELECT wilderness_area, {", ".join(f'count(*) FILTER (cover_type = {c}) AS "{c}"' for c in (1, 2, 3, 6))}
FROM cells GROUP BY 1"""


def soils_per_area(spark, sf):
    return profiles.distinct_per_group(cells(spark, sf), "wilderness_area", "soil_type", "soils")


SOILS_PER_AREA = f"WITH {CELLS_SQL} SELECT wilderness_area, count(DISTINCT soil_type) AS soils FROM cells GROUP BY 1"


def table_inspection(spark, sf):
    return profiles.inspect(cells(spark, sf), "wilderness_area", "soil_type")


TABLE_INSPECTION = f"""WITH {CELLS_SQL}
SELECT count(*) AS n_rows, list_sort(list(DISTINCT wilderness_area)) AS areas, count(DISTINCT soil_type) AS n_codes FROM cells"""


# Scores: a deterministic value in hundredths, so that many rows tie.
def scored(spark, sf):
    noise = F.pmod(seeded_hash(SEED, F.col("row_key")), F.lit(70))
    return outcomes(spark, sf).withColumn("score", ((noise + F.col("y") * 31) / 100).cast("double"))


SCORED_SQL = f"""{OUTCOMES_SQL},
scored AS (SELECT *, CAST(({_hash_sql(SEED, "row_key")} % 70 + y * 31) / 100 AS DOUBLE) AS score FROM outcomes)
"""


def ranking_metrics(spark, sf):
    out = metrics.ranking_metrics(scored(spark, sf), "y", "score", ["p_type"])
    return out.select("p_type", "n", "n_pos", *[F.round(c, 9).alias(c) for c in ("average_precision", "roc_auc")])


def _ranking_sql(group):
    return f"""
bins AS (SELECT {group}, score, sum(y) AS p, count(*) AS r FROM scored GROUP BY ALL),
curve AS (
  SELECT *, sum(p) OVER w AS tp, sum(r) OVER w AS seen FROM bins
  WINDOW w AS (PARTITION BY {group} ORDER BY score DESC)
),
totals AS (SELECT {group}, sum(y) AS pos, count(*) AS n FROM scored GROUP BY ALL)
"""


RANKING_METRICS = f"""WITH {SCORED_SQL}, {_ranking_sql("p_type")}
SELECT c.p_type, any_value(n) AS n, CAST(any_value(pos) AS BIGINT) AS n_pos,
  round(sum(p * tp / seen) / any_value(pos), 9) AS average_precision,
  round(sum((r - p) * ((tp - p) + p / 2)) / (any_value(pos) * (any_value(n) - any_value(pos))), 9) AS roc_auc
FROM curve c JOIN totals t ON c.p_type = t.p_type GROUP BY 1"""


def precision_recall(spark, sf):
    out = metrics.precision_recall(scored(spark, sf), "y", "score")
    return out.select("score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


PRECISION_RECALL = f"""WITH {SCORED_SQL}
SELECT score, round(sum(p) OVER w / sum(r) OVER w, 9) AS precision,
  round(sum(p) OVER w / (SELECT sum(y) FROM scored), 9) AS recall
FROM (SELECT score, sum(y) AS p, count(*) AS r FROM scored GROUP BY 1) WINDOW w AS (ORDER BY score DESC)"""


def label_ranking(spark, sf):
    """The given labels, ranked by a length score with ties."""
    docs = table(spark, sf, "documents").select("doc_id", (F.floor(F.col("n_chars") / 250)).alias("score"))
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    out = metrics.ranking_metrics(rows, "quality", "score")
    return out.select("n", "n_pos", *[F.round(c, 9).alias(c) for c in ("average_precision", "roc_auc")])


LABEL_RANKING = f"""WITH scored AS (
  SELECT 0 AS g, quality AS y, n_chars // 250 AS score FROM labels JOIN documents USING (doc_id)),
{_ranking_sql("g")}
SELECT any_value(n) AS n, CAST(any_value(pos) AS BIGINT) AS n_pos,
  round(sum(p * tp / seen) / any_value(pos), 9) AS average_precision,
  round(sum((r - p) * ((tp - p) + p / 2)) / (any_value(pos) * (any_value(n) - any_value(pos))), 9) AS roc_auc
FROM curve JOIN totals USING (g)"""


def predicted(spark, sf):
    """Class predictions that are right more often for some discounts than for others."""
    roll = F.pmod(seeded_hash(SEED, F.col("row_key")), F.lit(10))
    guess = F.when(roll < 4, F.col("cover_type")).when(roll < 7, 3).when(roll < 9, 6).otherwise(2)
    return cells(spark, sf).withColumn("predicted", guess)


PREDICTED_SQL = f"""{CELLS_SQL},
predicted AS (
  SELECT *, CASE WHEN roll < 4 THEN cover_type WHEN roll < 7 THEN 3 WHEN roll < 9 THEN 6 ELSE 2 END AS predicted
  FROM (SELECT *, {_hash_sql(SEED, "row_key")} % 10 AS roll FROM cells)
)
"""


def class_recall(spark, sf):
    out = metrics.class_recall(predicted(spark, sf), "cover_type", "predicted")
    return out.select("truth", "support", "hits", F.round("recall", 9).alias("recall"))


CLASS_RECALL = f"""WITH {PREDICTED_SQL}
SELECT cover_type AS truth, count(*) AS support, count(*) FILTER (predicted = cover_type) AS hits,
  round(count(*) FILTER (predicted = cover_type) / count(*), 9) AS recall FROM predicted GROUP BY 1"""


def balanced_accuracy(spark, sf):
    out = metrics.balanced_accuracy(predicted(spark, sf), "cover_type", "predicted")
    return out.select(*[F.round(c, 9).alias(c) for c in ("balanced_accuracy", "accuracy")], "n", "classes")


BALANCED_ACCURACY = f"""WITH {PREDICTED_SQL}
SELECT round(avg(recall), 9) AS balanced_accuracy, round(sum(hits) / sum(n), 9) AS accuracy,
  CAST(sum(n) AS BIGINT) AS n, count(*) AS classes
FROM (SELECT count(*) AS n, count(*) FILTER (predicted = cover_type) AS hits, hits / n AS recall
      FROM predicted GROUP BY cover_type)"""


def accuracy(spark, sf):
    out = metrics.accuracy(predicted(spark, sf), "cover_type", "predicted")
    return out.select(F.round("accuracy", 9).alias("accuracy"), "n")


ACCURACY = f"""WITH {PREDICTED_SQL}
SELECT round(avg(CASE WHEN cover_type = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM predicted"""


def recall_bars(spark, sf):
    return metrics.recall_bars(predicted(spark, sf), "cover_type", "predicted")


RECALL_BARS = f"""WITH {PREDICTED_SQL}, r AS (
  SELECT cover_type, count(*) FILTER (predicted = cover_type) / count(*) AS v FROM predicted GROUP BY 1),
w AS (SELECT avg(v) AS b, max(v) FILTER (cover_type = 3) AS r3, max(v) FILTER (cover_type = 6) AS r6 FROM r)
SELECT round(b, 4) AS balanced_accuracy, r3 >= 0.44 AS meets_3, r6 >= 0.44 AS meets_6, r3 >= 0.4 AS progress_3,
  r6 >= 0.3 AS progress_6, b >= 0.27 AS skill_ok, r3 >= 0.44 AND r6 >= 0.44 AND b >= 0.27 AS meets_bars FROM w"""


def majority_share(spark, sf):
    return metrics.majority_share(cells(spark, sf), "cover_type").select(
        F.round("majority_share", 9).alias("majority_share")
    )


MAJORITY_SHARE = f"""WITH {CELLS_SQL}
SELECT round(max(n) / sum(n), 9) AS majority_share FROM (SELECT count(*) AS n FROM cells GROUP BY cover_type)"""


def regression_errors(spark, sf):
    """Price of a line predicted from its quantity alone."""
    lines = table(spark, sf, "lineitem").withColumn("guess", F.col("l_quantity") * 1000)
    out = metrics.regression_errors(lines, "l_extendedprice", "guess", ["l_returnflag"])
    return out.select(
        "l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean_abs_error", "median_abs_error")]
    )


REGRESSION_ERRORS = """SELECT l_returnflag, count(*) AS n,
  round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) AS mean_abs_error,
  round(median(abs(l_extendedprice - l_quantity * 1000)), 4) AS median_abs_error
FROM lineitem GROUP BY 1"""


def fold_spread(spark, sf):
    rows = splits.kfold(scored(spark, sf), "row_key", OUTER, SEED)
    return metrics.fold_spread(rows.groupBy("fold").agg(F.avg("score").alias("s")), "s")


FOLD_SPREAD = f"""WITH {SCORED_SQL}
SELECT round(max(s) - min(s), 4) AS spread FROM (
  SELECT round(avg(score), 4) AS s FROM scored GROUP BY {_hash_sql(SEED, "row_key")} % {OUTER})"""


def alert_list(spark, sf):
    return cohort.alert_list(scored(spark, sf), "score", "row_key", 50).select("row_key", "score")


ALERT_LIST = f"WITH {SCORED_SQL} SELECT row_key, score FROM scored ORDER BY score DESC, row_key LIMIT 50"


def head_sample(spark, sf):
    return cohort.head_sample(table(spark, sf, "orders"), "o_orderkey", 12)


HEAD_SAMPLE = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 12"


def run_statistics(spark, sf):
    """Events of a type as runs; the reward is the value, capped at one."""
    runs = table(spark, sf, "events").withColumn("reward", F.least(F.lit(1.0), F.floor("value") / 20))
    return metrics.run_statistics(runs, "reward", ["event_type"])


RUN_STATISTICS = """WITH runs AS (SELECT event_type, least(1.0::DOUBLE, floor(value) / 20) AS reward FROM events),
s AS (SELECT event_type, count(*) AS n, count(*) FILTER (reward >= 0.99) AS k, avg(reward) AS m, stddev_pop(reward) AS d
      FROM runs GROUP BY 1),
w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM s)
SELECT event_type, n AS runs, round(m, 4) AS mean_reward, round(d, 4) AS std_reward, round(p, 4) AS solve_rate,
  CASE WHEN k > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pass_at_n,
  round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 4) AS wilson_low,
  round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 4) AS wilson_high FROM w"""


def exact_medians(spark, sf):
    return ordering.exact_median(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "median_price")


EXACT_MEDIANS = "SELECT l_suppkey, median(l_extendedprice) AS median_price FROM lineitem GROUP BY 1"

BOUND = {
    "observable_cohort": (observable_cohort, OBSERVABLE_COHORT),
    "outcome_mix": (outcome_mix, OUTCOME_MIX),
    "interaction_levels": (interaction_levels, INTERACTION_LEVELS),
    "target_rates": (target_rates, TARGET_RATES),
    "rate_lookup": (rate_lookup, RATE_LOOKUP),
    "nested_target_encoding": (nested_encoding, NESTED_ENCODING),
    "fold_membership": (fold_membership, FOLD_MEMBERSHIP),
    "inner_folds": (inner_folds, INNER_FOLDS),
    "stratified_split": (stratified_split, STRATIFIED_SPLIT),
    "random_split": (random_split, RANDOM_SPLIT),
    "group_split": (group_split, GROUP_SPLIT),
    "positional_split": (positional_split, POSITIONAL_SPLIT),
    "rebalanced_negatives": (rebalanced, REBALANCED),
    "seeded_pick": (seeded_pick, SEEDED_PICK),
    "singleton_share": (singleton_share, SINGLETON_SHARE),
    "one_hot": (one_hot, ONE_HOT),
    "one_hot_vectors": (one_hot_vectors, ONE_HOT_VECTORS),
    "fixed_one_hot_matrix": (cell_matrix, CELL_MATRIX),
    "terrain_matrix": (terrain_families, TERRAIN_FAMILIES),
    "class_weights": (class_weights, CLASS_WEIGHTS),
    "routed_slice": (routed_slice, ROUTED_SLICE),
    "class_shares": (class_shares, CLASS_SHARES),
    "class_grid": (class_grid, CLASS_GRID),
    "soils_per_area": (soils_per_area, SOILS_PER_AREA),
    "table_inspection": (table_inspection, TABLE_INSPECTION),
    "ranking_metrics": (ranking_metrics, RANKING_METRICS),
    "precision_recall_curve": (precision_recall, PRECISION_RECALL),
    "label_ranking": (label_ranking, LABEL_RANKING),
    "class_recall": (class_recall, CLASS_RECALL),
    "balanced_accuracy": (balanced_accuracy, BALANCED_ACCURACY),
    "accuracy": (accuracy, ACCURACY),
    "recall_bars": (recall_bars, RECALL_BARS),
    "majority_share": (majority_share, MAJORITY_SHARE),
    "regression_errors": (regression_errors, REGRESSION_ERRORS),
    "fold_spread": (fold_spread, FOLD_SPREAD),
    "alert_list": (alert_list, ALERT_LIST),
    "head_sample": (head_sample, HEAD_SAMPLE),
    "run_statistics": (run_statistics, RUN_STATISTICS),
    "exact_medians": (exact_medians, EXACT_MEDIANS),
}
