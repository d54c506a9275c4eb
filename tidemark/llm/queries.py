"""The registered queries of the corpus operators and their SQL twins.

Each query reads its whole table and derives the columns of its contract from the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mixture

    plan = mixture(table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def source_mixing_sql() -> str:
    """Water-filling by levels, then one table a size class, from the largest down."""
    classes = range(40, 0, -1)
    steps = "".join(
        f"""), best{c} AS MATERIALIZED (
  SELECT s.source, arg_min(x.cell, (greatest(s.part - s.taken - (s.source_size - s.seen - x.words) - x.upto, x.upto - (s.part - s.taken), 0.0),
           abs(x.upto - (s.part * (s.seen + x.words) / s.source_size - s.taken)), x.cell)) AS cell,
         arg_min(x.upto, (greatest(s.part - s.taken - (s.source_size - s.seen - x.words) - x.upto, x.upto - (s.part - s.taken), 0.0),
           abs(x.upto - (s.part * (s.seen + x.words) / s.source_size - s.taken)), x.cell)) AS upto,
         any_value(x.words) AS words
  FROM state{c + 1} s JOIN choices x ON x.source IS NOT DISTINCT FROM s.source AND x.class = {c}
  GROUP BY s.source
), state{c} AS MATERIALIZED (
  SELECT s.source, s.part, s.source_size, s.taken + coalesce(b.upto, 0) AS taken, s.seen + coalesce(b.words, 0) AS seen
  FROM state{c + 1} s LEFT JOIN best{c} b ON b.source IS NOT DISTINCT FROM s.source
"""
        for c in classes
    )
    cuts = " UNION ALL ".join(f"SELECT source, {c} AS class, cell FROM best{c}" for c in classes)
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS BIGINT) AS cell
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), ranked AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER before, 0) AS caps_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free_here
  FROM src
  WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (
  SELECT *, CAST(cap AS HUGEINT) * free_here < CAST(total - caps_before AS HUGEINT) * weight AS clamped FROM ranked
), fin AS MATERIALIZED (
  SELECT source, source_size, weight,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE)
              ELSE CAST(max(total) OVER () - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0) AS DOUBLE)
                   * weight / CAST(sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM lev
), parts AS MATERIALIZED (
  SELECT *, CAST(floor(coalesce(target / nullif(source_size, 0), 0.0)) AS BIGINT) AS whole FROM fin
), choices AS MATERIALIZED (
  SELECT source, class, cell, CAST(sum(words) OVER (PARTITION BY source, class) AS BIGINT) AS words,
         CAST(sum(words) OVER (PARTITION BY source, class ORDER BY cell) AS BIGINT) AS upto
  FROM (SELECT source, length(bin(size)) AS class, cell, sum(size) AS words FROM d WHERE size > 0 GROUP BY ALL)
  UNION ALL
  SELECT source, length(bin(size)), -1, CAST(sum(size) AS BIGINT), 0 FROM d WHERE size > 0 GROUP BY ALL
), state41 AS (
  SELECT source, target - whole * source_size AS part, source_size, 0::BIGINT AS taken, 0::BIGINT AS seen FROM parts
{steps}), cuts AS ({cuts})
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.whole + CASE WHEN d.size > 0 AND d.cell <= c.cell THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN parts p ON p.source IS NOT DISTINCT FROM d.source
LEFT JOIN cuts c ON c.source IS NOT DISTINCT FROM d.source AND c.class = length(bin(d.size))
"""


# The added conversation of the contract: the template's own marks inside its texts.
PLANTED_CHAT = "\\### Assistant: </turn> ok"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import formatted, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [(-7, 0, "user", PLANTED_CHAT), (-7, 1, "assistant", PLANTED_CHAT)]
    turns = turns.unionByName(spark.createDataFrame(planted, turns.schema))
    read = read_back(formatted(turns))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP3_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(replace(text, '\\', ''), '#', ''), '<', ''), ':', '')) AS written,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS before
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS LAST, role, text)) AS loss_sha256,
       CAST(sum(written + 4 + length(role) + 2 + 7) AS BIGINT) AS formatted_chars,
       bool_and(CASE coalesce(before, '') WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
                WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END)
         AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n", token_counts(docs, F.col("text"), vocabulary("byte_bpe_50k.json")))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("n").alias("n_tokens"),
        (F.col("n") > 512).alias("over_limit"),
    )


def op8_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe_automaton import token_digests

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = token_digests(docs, F.col("text"), vocabulary("word_bpe_49k.json"))
    return docs.select("doc_id", coded.alias("c")).select("doc_id", "c.*")


def op9_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minhash import near_duplicates

    # The contract fixes shingles of four words for this query.
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.draws import remainder
    from tidemark.llm.toxicity import fit_toxicity, toxicity_score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1)
    model = fit_toxicity(docs, labels)
    scored = docs.withColumn("score", toxicity_score(docs, F.col("text"), model))
    return scored.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_text import extracted

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", extracted(pages, F.col("html")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import fit_language, language
    from tidemark.llm.draws import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs.filter(remainder("doc_id", 5) != 0))
    labelled = docs.select("doc_id", language(docs, F.col("text"), model).alias("l"))
    return labelled.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "l.lang_pred", "l.score")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprints import edit_likeness

    return edit_likeness(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ranked_search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS place, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts
  FROM documents
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM benchmark
), totals AS (SELECT count(*) FILTER (len(ts) > 0) AS documents, CAST(sum(len(ts)) AS BIGINT) AS words FROM d
), tf AS (
  SELECT place, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT place, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM wanted) GROUP BY place, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(documents) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term
), s AS (
  SELECT q.item_id, tf.place, any_value(tf.doc_id) AS doc_id,
         CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * tf.n * totals.documents) // totals.words)))) AS BIGINT) AS score
  FROM wanted q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term, totals
  GROUP BY q.item_id, tf.place
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM d
), u AS MATERIALIZED (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM p) GROUP BY lang, w
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM u GROUP BY lang
), b AS MATERIALIZED (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f
  FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM p) GROUP BY ALL
), t AS MATERIALIZED (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f
  FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM p) GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, w1, w2, max(f) AS f
  FROM (SELECT lang, w1, w2, f FROM t UNION ALL SELECT lang, w2, w3, f FROM t) GROUP BY lang, w1, w2
), cuts AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM b JOIN u x ON x.lang = b.lang AND x.w = b.w1 JOIN u y ON y.lang = b.lang AND y.w = b.w2
  LEFT JOIN longer g ON g.lang = b.lang AND g.w1 = b.w1 AND g.w2 = b.w2
  WHERE b.f >= 10 AND NOT coalesce(100 * g.f >= 50 * b.f, false)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM t JOIN u x ON x.lang = t.lang AND x.w = t.w1 JOIN b y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM t JOIN b x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN u y ON y.lang = t.lang AND y.w = t.w3
), scored AS (
  SELECT *, CAST(1000000 * a::HUGEINT * a::HUGEINT // (l::HUGEINT * r::HUGEINT) AS BIGINT) AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score
FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""


# The rules of the contract, in its order.
URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_graph import judged, rule_table

    return judged(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def url_filter_sql() -> str:
    """The rules, then one table a round of the propagation."""
    from tidemark.llm.url_graph import DAMPING, LINK, MARGIN, NOISE, ROUNDS

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rules = ", ".join(
        f"({quoted(r.partition('/')[0])}, {quoted('/' + r.partition('/')[2])}, {quoted(r)}, {quoted(v)})"
        for v, r in URL_RULES
    )
    lowered = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rounds = "".join(
        f"""), r{i} AS MATERIALIZED (
  SELECT r.host, r.allowed, r.blocked, r.out_links, r.in_links,
         r.allowed + coalesce(f.got, 0) AS trust, r.blocked + coalesce(b.got, 0) AS distrust
  FROM r{i - 1} r
  LEFT JOIN (SELECT l.dst AS host, sum({DAMPING} * s.trust / s.out_links) AS got
             FROM links l JOIN r{i - 1} s ON s.host = l.src GROUP BY l.dst) f ON f.host = r.host
  LEFT JOIN (SELECT l.src AS host, sum({DAMPING} * s.distrust / s.in_links) AS got
             FROM links l JOIN r{i - 1} s ON s.host = l.dst GROUP BY l.src) b ON b.host = r.host
"""
        for i in range(1, ROUNDS + 1)
    )
    return f"""
WITH rules(rule_host, rule_path, rule, judgement) AS (VALUES {rules}
), cut AS (
  SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                             THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS place, page_id, html, {lowered.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), links AS MATERIALIZED (
  SELECT DISTINCT src, dst FROM (
    SELECT host AS src, {lowered.format("unnest(regexp_extract_all(html, " + quoted(LINK) + ", 1))")} AS dst FROM rows_
  ) WHERE src <> dst AND src <> ''
), ruled AS MATERIALIZED (
  SELECT p.place, any_value(p.page_id) AS page_id, any_value(p.host) AS host, any_value(p.path) AS path,
         arg_min(r.rule, (-length(r.rule), CASE r.judgement WHEN 'block' THEN 0 ELSE 1 END, r.rule)) AS rule,
         arg_min(r.judgement, (-length(r.rule), CASE r.judgement WHEN 'block' THEN 0 ELSE 1 END, r.rule)) AS judgement
  FROM rows_ p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY p.place
), seen AS (
  SELECT host, avg(CASE WHEN judgement = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed,
         avg(CASE WHEN judgement = 'block' THEN 1.0 ELSE 0.0 END) AS blocked
  FROM ruled GROUP BY host
), met AS (
  SELECT DISTINCT dst AS host FROM links WHERE dst NOT IN (SELECT host FROM seen)
), unseen AS (
  SELECT m.host,
         arg_min(r.judgement, (-length(r.rule), CASE r.judgement WHEN 'block' THEN 0 ELSE 1 END, r.rule)) AS judgement
  FROM met m LEFT JOIN rules r
    ON (m.host = r.rule_host OR ends_with(m.host, '.' || r.rule_host)) AND starts_with('/', r.rule_path)
  GROUP BY m.host
), seeds AS (
  SELECT * FROM seen UNION ALL
  SELECT host, CASE WHEN judgement = 'allow' THEN 1.0 ELSE 0.0 END, CASE WHEN judgement = 'block' THEN 1.0 ELSE 0.0 END
  FROM unseen
), r0 AS MATERIALIZED (
  SELECT s.host, CAST(s.allowed AS DOUBLE) AS allowed, CAST(s.blocked AS DOUBLE) AS blocked,
         o.n AS out_links, i.n AS in_links,
         CAST(s.allowed AS DOUBLE) AS trust, CAST(s.blocked AS DOUBLE) AS distrust
  FROM seeds s LEFT JOIN (SELECT src AS host, count(*) AS n FROM links GROUP BY src) o ON o.host = s.host
  LEFT JOIN (SELECT dst AS host, count(*) AS n FROM links GROUP BY dst) i ON i.host = s.host
{rounds})
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.judgement, CASE WHEN r.distrust - r.trust > {MARGIN} + {NOISE} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled p JOIN r{ROUNDS} r ON r.host = p.host
"""


BOUND = {
    "op1_source_mixing": (op1_source_mixing, source_mixing_sql()),
    "op2_fingerprints": (op2_fingerprints, None),
    "op3_chat_formatting": (op3_chat_formatting, OP3_SQL),
    "op9_minhash_near_duplicates": (op9_minhash_near_duplicates, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_html_extraction": (op5_html_extraction, None),
    "op10_language": (op10_language, None),
    "op6_near_vectors": (op6_near_vectors, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_bpe_coding": (op8_bpe_coding, None),
    "op11_ranked_search": (op11_ranked_search, OP11_SQL),
    "op12_phrases": (op12_phrases, OP12_SQL),
    "op13_url_filter": (op13_url_filter, url_filter_sql()),
}
