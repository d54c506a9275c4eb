"""Document fingerprints by I-Match over randomised lexicons, in DataFrame functions only.

Terms whose document frequency lies inside a band make the lexicon. Randomised subsets of it
keep a term with probability 1, 1/2, 1/4, …, several independent subsets for each density. A
text's distinct lexicon terms are sorted, and those in a subset hashed together. A fingerprint
holds the subsets of neighbouring densities around one term per subset, chosen by the number
of the text's distinct terms, so that short and long texts both have informative subsets. Two
fingerprints are as alike as the share of equal subsets among those that either text fills.

The lexicon is broadcast behind a count: a term in a share ``least`` of all texts makes up
that share of the distinct terms, so the lexicon has at most (mean distinct terms) / ``least``
terms, however many texts there are. Terms meet the lexicon by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import empty_if_null, stored

LEAST_SHARE, MOST_SHARE = 0.002, 0.2
SUBSETS = 16  # independent subsets of each density
DENSITIES = 3  # neighbouring densities that a fingerprint holds
BROADCAST_TERMS = 1_000_000
PIECE_CHARS = 4_000_000
MOST_PIECES = 100_000
SPLIT = "[^\\p{L}\\p{N}]+"


def terms_of(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits; the empty term is always the first."""
    return F.array_union(F.array(F.lit("")), F.split(F.lower(text), SPLIT))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Hashes of the terms inside the band with ``depths``, and ``top``, the largest of them.

    Subset r keeps a term at densities up to 2^-depth[r].
    """
    terms = docs.select(F.explode(terms_of(empty_if_null(F.col("text")))).alias("term"))
    hashed = terms.filter("term != ''").select(F.xxhash64("term").alias("code"))
    counted = hashed.groupBy("code").agg(F.count(F.lit(1)).alias("_df"))
    total = docs.count()
    band = counted.filter((F.col("_df") >= least * total) & (F.col("_df") <= max(most * total, 1.0)))
    low = lambda r: F.xxhash64(F.lit(r), "code").bitwiseAND(0x7FFFFFFF)
    depth = lambda r: (31 - F.floor(F.log2(low(r) + 1))).cast("tinyint")
    depths = band.select("code", F.array(*[depth(r) for r in range(SUBSETS)]).alias("depths"))
    return stored(depths.withColumn("top", F.array_max("depths")), "lexicon")


def _place(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below ``key``, by halving steps."""
    values = F.array(*[F.lit(b) for b in bounds]) if len(bounds) < 2 else F.lit(bounds)
    steps = [1 << k for k in range(max(len(bounds), 1).bit_length() - 1, -1, -1)]

    def step(at: Column, size: Column) -> Column:
        here = F.try_element_at(values, at + size)
        return F.when(F.coalesce(here < key, F.lit(False)), at + size).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def in_pieces(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a piece number that follows the order of doc_id, and the pieces' successors.

    Piece bounds are quantiles of the identifiers, bounded in number; a null identifier is in a
    piece below all others. Successors give, per piece, the next one in descending order.
    """
    sizes = docs.agg(
        F.sum(F.length(empty_if_null(F.col("text")))).alias("chars"), F.count("doc_id").alias("rows")
    ).first()
    pieces = int(min(MOST_PIECES, max(1, (sizes.chars or 0) // PIECE_CHARS)))
    bounds: list = []
    if pieces > 1 and sizes.rows:
        cuts = [i / pieces for i in range(1, pieces)]
        found = docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 4 * pieces)).alias("q")).first()
        bounds = sorted(set(found.q))
    place = _place(F.col("doc_id"), bounds) if bounds else F.lit(0)
    held = docs.select(
        "doc_id",
        empty_if_null(F.col("text")).alias("text"),
        F.when(F.col("doc_id").isNull(), -1).otherwise(place).alias("piece"),
    )
    there = sorted((r.piece for r in held.select("piece").distinct().collect()), reverse=True)
    follow = list(zip(there, there[1:] + there[:1]))  # after the last piece comes the first
    return held, docs.sparkSession.createDataFrame(follow, "piece int, next_piece int")


def with_next(docs: DataFrame) -> DataFrame:
    """Every row with the text of the next one in descending doc_id, the first after the last.

    Columns piece, pos (place in the piece), next_piece, next_pos, doc_id, text, next_text. The
    texts are shuffled once, by piece.
    """
    held, follow = in_pieces(docs)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    inside = W.partitionBy("piece").orderBy(*order)
    # Only pieces' first rows are looked up across pieces: one identifier, then one text a piece.
    heads = held.groupBy("piece").agg(F.max("doc_id").alias("head_id"))
    texts = (
        held.join(  # one identifier a piece, and pieces are at most MOST_PIECES
            F.broadcast(heads.withColumnRenamed("piece", "head_piece")), F.col("doc_id").eqNullSafe(F.col("head_id"))
        )
        .filter("piece = head_piece")
        .groupBy("head_piece")
        .agg(F.min("text").alias("head_text"))
    )
    ahead = follow.join(texts, F.col("next_piece") == F.col("head_piece")).select("piece", "next_piece", "head_text")
    rows = held.withColumns(
        {"pos": F.row_number().over(inside), "_lead": F.lead("text").over(inside)}
    ).join(ahead, "piece", "left")
    last = F.col("_lead").isNull()
    return rows.select(
        "piece",
        "pos",
        F.when(last, F.col("next_piece")).otherwise(F.col("piece")).alias("next_piece"),
        F.when(last, F.lit(1)).otherwise(F.col("pos") + 1).alias("next_pos"),
        "doc_id",
        "text",
        F.coalesce("_lead", "head_text").alias("next_text"),
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by the first as many of the next text."""
    size = F.length(text)
    cut = F.floor(size / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), size - cut), F.substr(following, F.lit(1), cut))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once: lambda variables are not expanded again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def level_of(terms: Column) -> Column:
    """The density exponent at which a subset keeps about one of a text's terms."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size(terms), F.lit(1)))).cast("int"))


def marks(kept: Column, level: Column) -> Column:
    """One number per subset that holds a term: its slot above 32 bits, its hash below."""
    whole = F.struct(F.array_sort(kept).alias("kept"), level.alias("level"))

    def of_whole(w: Column) -> Column:
        def of_subset(r: Column) -> Column:
            def of_densities(some: Column) -> Column:
                def of_density(k: Column) -> Column:
                    inside = F.filter(some, lambda t: F.get(t["depths"], r) >= w["level"] + k)
                    terms = F.array_join(F.transform(inside, lambda t: t["term"]), " ")
                    slot = F.shiftleft(((w["level"] + k) * SUBSETS + r).cast("long"), 32)
                    mark = lambda x: F.when(x != "", slot + F.hash(x).cast("long").bitwiseAND(0xFFFFFFFF))
                    return _once(terms, mark)

                return F.transform(F.sequence(F.lit(0), F.lit(DENSITIES - 1)), of_density)

            return _once(F.filter(w["kept"], lambda t: F.get(t["depths"], r) >= w["level"]), of_densities)

        every = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), of_subset)
        return F.array_compact(F.flatten(every))

    return F.when(F.size(kept) == 0, F.array().cast("array<bigint>")).otherwise(_once(whole, of_whole))


def written(marks_: Column, digest: Column) -> Column:
    """A fingerprint as text; a text without marks is told by its digest alone."""
    return F.when(F.size(marks_) == 0, F.concat(F.lit("raw:"), digest)).otherwise(
        F.array_join(F.transform(marks_, lambda m: F.hex(m)), ".")
    )


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Equal subsets among those that either text fills."""
    slots = lambda m: F.transform(m, lambda x: F.shiftright(x, 32))
    same = F.size(F.array_intersect(a, b)).cast("double")
    some = F.size(F.array_union(slots(a), slots(b))).cast("double")
    return F.when(equal, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(same, some), F.lit(0.0)))


def prints(rows: DataFrame, key: list[str], text: str, terms: DataFrame) -> DataFrame:
    """``key`` columns and ``print`` (see ``marks``) of every row; no shuffle if laid out by a key.

    Only terms that some subset of the text's densities keeps meet again in the aggregate on
    ``key``: a bounded number, whatever the length of the text.
    """
    spark = rows.sparkSession
    # Groups come one after another; a low bound would sort every term instead.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "8192")
    few = terms.count() <= BROADCAST_TERMS
    empty = spark.range(1).select(  # every text holds the empty term
        F.xxhash64(F.lit("")).alias("code"), F.lit(None).cast("array<tinyint>").alias("depths"), F.lit(127).cast("tinyint").alias("top")
    )
    look = terms.unionByName(empty)
    spread = rows.withColumn("_terms", terms_of(F.col(text))).withColumn("_level", level_of(F.col("_terms")))
    spread = spread.select(*key, "_level", F.explode("_terms").alias("term")).withColumn("code", F.xxhash64("term"))
    met = spread.join(F.broadcast(look) if few else look, "code").filter(F.col("top") >= F.col("_level"))
    found = met.groupBy(*key, "_level").agg(
        F.collect_list(F.when(F.col("term") != "", F.struct("term", "depths"))).alias("_kept")
    )
    return found.withColumn("print", marks(F.col("_kept"), F.col("_level"))).drop("_kept", "_level")


def edit_likeness(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Nulls: a null text is empty, null identifiers come last in the order. Rows of one doc_id
    are ordered by text; equal rows are kept. Texts without lexicon terms are like equal texts
    only. A single document is its own next one. An empty table gives an empty result.
    """
    terms = lexicon(docs.select("text"), least, most)
    rows = with_next(docs.select("doc_id", "text"))
    # Both versions are made where the texts lie: the layout by piece serves all that follows.
    versions = F.array(
        F.struct(F.lit(0).alias("v"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("v"), edited_text(F.col("text"), F.col("next_text")).alias("t")),
    )
    both = rows.select("piece", "pos", "next_piece", "next_pos", "doc_id", F.length("text").alias("n"), F.explode(versions).alias("x"))
    both = both.select(
        "piece", "pos", "next_piece", "next_pos", "doc_id", "n", F.col("x.v").alias("v"),
        F.sha2(F.col("x.t").cast("binary"), 256).alias("sha"), F.col("x.t").alias("t"),
    )
    key = ["piece", "pos", "v", "next_piece", "next_pos", "doc_id", "n", "sha"]
    each = prints(both, key, "t", terms)
    pick = lambda v: F.first(F.when(F.col("v") == v, F.struct("print", "sha")), ignorenulls=True)
    joined = each.groupBy("piece", "pos", "next_piece", "next_pos", "doc_id", "n").agg(
        pick(0).alias("own"), pick(1).alias("edited")
    )
    held = stored(joined, "fingerprints")
    after = held.select(
        F.col("piece").alias("next_piece"), F.col("pos").alias("next_pos"), F.col("own").alias("after")
    )
    out = held.join(after, ["next_piece", "next_pos"], "left")
    own, edited, after_ = F.col("own"), F.col("edited"), F.col("after")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        edited["sha"].alias("edited_sha256"),
        written(own["print"], own["sha"]).alias("fingerprint"),
        written(edited["print"], edited["sha"]).alias("edited_fingerprint"),
        likeness(own["print"], edited["print"], own["sha"] == edited["sha"]).alias("near_edited"),
        likeness(own["print"], after_["print"], own["sha"] == after_["sha"]).alias("near_next"),
    )
