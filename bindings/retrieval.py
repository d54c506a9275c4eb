"""Retrieval bindings: cases are ``documents``, domains are languages, facets ``benchmark``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.tables import table
from tidemark.functions.textfold import eligible_text, normalize_text, strip_accents
from tidemark.operators import profiles, rewrites
from tidemark.operators import retrieval as rt
from tidemark.session import spread, written

LANGS = ("de", "en", "es", "fr")
QUERY_ID = "Benchmark  Passage"
TOP_K = 14


def cases(spark, sf):
    """Title is the first line, the summary is the rest."""
    docs = table(spark, sf, "documents")
    line_end = F.instr("text", "\n")
    has_lines = line_end > 0
    return docs.select(
        F.col("doc_id").cast("string").alias("pmcid"),
        F.col("doc_id"),
        F.concat(F.lit("rk-"), F.col("doc_id").cast("string")).alias("record_key"),
        F.col("lang").alias("source"),
        F.when(has_lines, F.substring(F.col("text"), F.lit(1), line_end - 1))
        .otherwise(F.col("text"))
        .alias("title"),
        F.when(has_lines, F.substring(F.col("text"), line_end + 1, F.length("text")))
        .otherwise("")
        .alias("case_summary"),
        F.col("source").alias("file"),
    )


CASES_SQL = """
cases AS (
  SELECT CAST(doc_id AS VARCHAR) AS pmcid, doc_id, 'rk-' || doc_id AS record_key, lang AS source,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1)
              ELSE text END AS title,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1)
              ELSE '' END AS case_summary,
         source AS file
  FROM documents
)
"""


def facets(spark, sf):
    """Passage i asks domain i, in alphabetical order; the passage ids decide, not the order."""
    passages = table(spark, sf, "benchmark")
    by_lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), F.pmod("item_id", F.lit(4)).cast("int") + 1)
    tagged = passages.withColumn("source", by_lang)
    parts = F.array_sort(F.collect_list(F.struct("item_id", "text")))
    # The benchmark is the request side; a facet is the text of its passages.
    return tagged.groupBy("source").agg(
        F.concat_ws(" ", F.transform(parts, lambda p: p["text"])).alias("text")
    )


FACETS_SQL = """
facets AS (
  SELECT ['de', 'en', 'es', 'fr'][item_id % 4 + 1] AS source,
         string_agg(text, ' ' ORDER BY item_id) AS text
  FROM benchmark GROUP BY 1
)
"""

_NORMAL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_TEXTS = f"""
texts AS (
  SELECT source, pmcid, strip_accents({_NORMAL.format("title || chr(10) || case_summary")}) AS text
  FROM cases
),
asked AS (SELECT source, strip_accents({_NORMAL.format("text")}) AS text FROM facets)
"""


def _term_sql(name, source, keys):
    """Word pairs and edge n-grams of ``source`` as (keys, view, term, tf)."""
    return f"""
{name}_words AS (
  SELECT {keys}, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w,
         list_filter(string_split(text, ' '), lambda x: x <> '') AS parts FROM {source}
),
{name} AS (
  SELECT {keys}, view, term, count(*) AS tf FROM (
    SELECT {keys}, 'word' AS view, unnest(w) AS term FROM {name}_words
    UNION ALL
    SELECT {keys}, 'word',
           unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_words
    UNION ALL
    SELECT {keys}, 'char', substr(p, i, n) FROM (
      SELECT {keys}, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM (
        SELECT {keys}, p, unnest([3, 4, 5]) AS n FROM (
          SELECT {keys}, ' ' || unnest(parts) || ' ' AS p FROM {name}_words)))
  ) GROUP BY ALL
)
"""


INDEX_SQL = f"""{CASES_SQL}, {FACETS_SQL}, {_TEXTS},
{_term_sql("terms", "texts", "source, pmcid")},
{_term_sql("asked_terms", "asked", "source")},
sizes AS (SELECT source, count(*) AS n_docs FROM texts GROUP BY 1),
counted AS (
  SELECT source, view, term, count(*) AS df, sum(tf) AS corpus_tf FROM terms GROUP BY ALL
),
limited AS (
  SELECT c.*, ln((1.0 + n_docs) / (1 + df)) + 1 AS idf,
         row_number() OVER (PARTITION BY c.source, view ORDER BY corpus_tf DESC, term) AS place
  FROM counted c JOIN sizes s ON c.source = s.source
  WHERE df >= 2 AND (view = 'char' OR df <= 0.98 * n_docs)
),
vocabulary AS (SELECT * FROM limited),
norms AS (
  SELECT t.source, t.view, pmcid, sqrt(fsum(((1 + ln(tf)) * idf) * ((1 + ln(tf)) * idf))) AS norm
  FROM terms t JOIN vocabulary v ON t.source = v.source AND t.view = v.view AND t.term = v.term
  GROUP BY ALL
),
raw_query AS (
  SELECT a.source, a.view, a.term, idf, (1 + ln(tf)) * idf AS w
  FROM asked_terms a JOIN vocabulary v ON a.source = v.source AND a.view = v.view AND a.term = v.term
),
query_terms AS (
  SELECT r.source, r.view, r.term, idf, w / length AS weight FROM raw_query r
  JOIN (SELECT source, view, sqrt(fsum(w * w)) AS length FROM raw_query GROUP BY ALL) l
    ON r.source = l.source AND r.view = l.view
),
dots AS (
  SELECT t.source, t.view, pmcid, fsum((1 + ln(tf)) * idf * weight) AS dot
  FROM terms t JOIN query_terms q ON t.source = q.source AND t.view = q.view AND t.term = q.term
  GROUP BY ALL
),
scores AS (
  SELECT d.source, v.view, d.pmcid, round(coalesce(dot / norm, 0), 12) AS score
  FROM texts d CROSS JOIN (SELECT unnest(['word', 'char']) AS view) v
  LEFT JOIN dots o ON o.source = d.source AND o.view = v.view AND o.pmcid = d.pmcid
  LEFT JOIN norms n ON n.source = d.source AND n.view = v.view AND n.pmcid = d.pmcid
),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY source, view ORDER BY score DESC, pmcid) AS r FROM scores
),
fused AS (
  SELECT source, pmcid, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, pmcid) AS rank
  FROM (SELECT source, pmcid,
               0.0::DOUBLE + 1.0::DOUBLE / (60 + max(r) FILTER (view = 'word'))
                 + 1.0::DOUBLE / (60 + max(r) FILTER (view = 'char')) AS score
        FROM ranks GROUP BY ALL)
)
"""


def _index(spark, sf):
    return rt.shared_index(cases(spark, sf))


def case_panel(spark, sf):
    return rt.retrieve(cases(spark, sf), QUERY_ID, facets(spark, sf), TOP_K, LANGS)


CASE_PANEL = f"""WITH {INDEX_SQL},
cycle AS (
  SELECT source, ((phase - i) % 4 + 4) % 4 AS cycle_pos FROM (
    SELECT unnest(['de', 'en', 'es', 'fr']) AS source, unnest([0, 1, 2, 3]) AS i,
           (SELECT sum(ascii(ch)) % 4 FROM (SELECT unnest(string_split('benchmark passage', '')) AS ch)) AS phase)
)
SELECT CAST(row_number() OVER (ORDER BY rank, cycle_pos) AS INTEGER) AS position, pmcid, f.source,
       round(score, 12) AS score
FROM fused f JOIN cycle c ON f.source = c.source ORDER BY rank, cycle_pos LIMIT {TOP_K}"""


def fused_ranks(spark, sf):
    ranked = rt.fused_ranks(_index(spark, sf), facets(spark, sf))
    return ranked.withColumn("score", F.round("score", 12))


FUSED_RANKS = f"WITH {INDEX_SQL} SELECT source, pmcid, round(score, 12) AS score, rank FROM fused"


def view_scores(spark, sf):
    return rt.cosine_scores(_index(spark, sf), facets(spark, sf)).withColumn(
        "score", F.round("score", 9)
    )


VIEW_SCORES = f"WITH {INDEX_SQL} SELECT source, view, pmcid, round(score, 9) AS score FROM scores"


def vocabulary_receipt(spark, sf):
    return rt.vocabulary_receipt(_index(spark, sf), facets(spark, sf))


VOCABULARY_RECEIPT = f"""WITH {INDEX_SQL}
SELECT v.source, v.view, count(*) AS terms, count(q.term) AS request_terms
FROM vocabulary v LEFT JOIN query_terms q
  ON v.source = q.source AND v.view = q.view AND v.term = q.term GROUP BY ALL"""


def anchor_ranks(spark, sf):
    docs = cases(spark, sf)
    anchors = docs.groupBy("source").agg(F.min_by("pmcid", "doc_id").alias("pmcid"))
    return rt.anchor_positions(_index(spark, sf), facets(spark, sf), anchors)


ANCHOR_RANKS = f"""WITH {INDEX_SQL}
SELECT source, view, pmcid, r AS rank FROM ranks
WHERE (source, pmcid) IN (SELECT (source, arg_min(pmcid, doc_id)) FROM cases GROUP BY source)"""


def global_baseline(spark, sf):
    return rt.global_baseline(cases(spark, sf), facets(spark, sf), TOP_K).withColumn(
        "score", F.round("score", 9)
    )


GLOBAL_BASELINE = f"""WITH {CASES_SQL}, {FACETS_SQL}, {_TEXTS},
everything AS (
  SELECT pmcid, text FROM texts
  UNION ALL SELECT NULL, strip_accents({_NORMAL.format("string_agg(text, ' ' ORDER BY source)")}) FROM facets
),
terms AS (
  SELECT pmcid, term, count(*) AS tf FROM (
    SELECT pmcid, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM everything)
  GROUP BY ALL
),
vocabulary AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM everything)) / (1 + count(*))) + 1 AS idf
  FROM terms GROUP BY term
),
weights AS (SELECT pmcid, term, tf * idf AS w FROM terms JOIN vocabulary USING (term)),
norms AS (SELECT pmcid, sqrt(fsum(w * w)) AS norm FROM weights GROUP BY pmcid),
dots AS (
  SELECT d.pmcid, fsum(d.w * q.w) AS dot FROM weights d JOIN weights q
    ON d.term = q.term AND q.pmcid IS NULL AND d.pmcid IS NOT NULL GROUP BY ALL
)
SELECT CAST(row_number() OVER (ORDER BY score DESC, pmcid) AS INTEGER) AS position, pmcid, source,
       round(score, 9) AS score
FROM (SELECT c.pmcid, c.source,
             round(coalesce(dot / norm / (SELECT norm FROM norms WHERE pmcid IS NULL), 0), 12) AS score
      FROM cases c LEFT JOIN dots d ON c.pmcid = d.pmcid LEFT JOIN norms n ON c.pmcid = n.pmcid)
ORDER BY score DESC, pmcid LIMIT {TOP_K}"""


def normalized_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", normalize_text(F.col("text")).alias("text"))


NORMALIZED_TEXT = f"SELECT doc_id, {_NORMAL.format('text')} AS text FROM documents"


def searchable_text(spark, sf):
    docs = cases(spark, sf)
    text = eligible_text(F.col("title"), F.col("case_summary"))
    return docs.select("pmcid", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


SEARCHABLE_TEXT = f"""WITH {CASES_SQL}
SELECT pmcid, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5
FROM (SELECT pmcid, {_NORMAL.format("title || chr(10) || case_summary")} AS t FROM cases)"""


def word_statistics(spark, sf):
    text = strip_accents(eligible_text(F.col("title"), F.col("case_summary"))).alias("text")
    keep = ["source", "pmcid"]
    docs = rt.by_document(spread(cases(spark, sf)).select(*keep, text), keep)
    counts = rt.term_counts(docs, rt.RELEASE_VIEWS, ["source"])
    return counts.groupBy("source", "view").agg(
        F.count_distinct("term").alias("terms"), F.sum("tf").alias("occurrences")
    )


WORD_STATISTICS = f"""WITH {CASES_SQL}, {FACETS_SQL}, {_TEXTS}, {_term_sql("terms", "texts", "source, pmcid")}
SELECT source, view, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS occurrences
FROM terms GROUP BY ALL"""


def release_cycles(spark, sf):
    """Every conversation as a request: its first text is the id, its length the size."""
    turns = table(spark, sf, "conversations")
    requests = turns.select(
        "conv_id",
        "turn",
        F.col("text").alias("query_id"),
        F.length("text").alias("top_k"),
    )
    cycle = rt.release_cycle(requests.drop("conv_id", "turn").distinct(), LANGS)
    return cycle.select(F.md5("query_id").alias("id_md5"), "top_k", "source", "cycle_pos")


RELEASE_CYCLES = f"""
WITH requests AS (
  SELECT DISTINCT text AS query_id, CAST(length(text) AS INTEGER) AS top_k FROM conversations
),
phased AS (
  SELECT *, (SELECT sum(CAST('0x' || hex[2*i-1:2*i] AS BIGINT)) FROM (SELECT unnest(range(1, len(hex)//2 + 1)) AS i)) % 4 AS phase
  FROM (SELECT *, hex(encode({_NORMAL.format("query_id")})) AS hex FROM requests)
)
SELECT md5(query_id) AS id_md5, top_k, ['de','en','es','fr'][i + 1] AS source,
       CAST(CASE WHEN top_k % 2 = 1 THEN ((i - coalesce(phase,0)) % 4 + 4) % 4
                 ELSE ((coalesce(phase,0) - i) % 4 + 4) % 4 END AS INTEGER) AS cycle_pos
FROM phased, (SELECT unnest([0, 1, 2, 3]) AS i)"""


def facet_statistics(spark, sf):
    turns = table(spark, sf, "conversations")
    requests = turns.groupBy(F.col("conv_id").alias("query_id")).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws("-", "role", F.col("turn").cast("string")), "text"))
        ).alias("facets")
    )
    return rt.facet_statistics(requests)


FACET_STATISTICS = """SELECT conv_id AS query_id, role || '-' || turn AS facet,
CAST(length(text) AS INTEGER) AS n_chars FROM conversations"""


def sample_prefixes(spark, sf):
    return rt.sample_prefixes(cases(spark, sf), "doc_id")


SAMPLE_PREFIXES = f"""WITH {CASES_SQL}
SELECT source, pmcid, title, summary_prefix FROM (
  SELECT source, pmcid, title, substr(case_summary, 1, 150) AS summary_prefix,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM cases) WHERE n = 1"""


def corpus_profile(spark, sf):
    docs = cases(spark, sf).withColumnRenamed("file", "file_name")
    return profiles.corpus_profile(docs, "file_name", "doc_id", "pmcid", "title", "case_summary")


CORPUS_PROFILE = f"""WITH {CASES_SQL}
SELECT file AS file_name, count(*) AS rows, count(DISTINCT pmcid) AS distinct_ids,
       arg_min(pmcid, doc_id) AS first_id, arg_max(pmcid, doc_id) AS last_id,
       count(*) FILTER (trim(title) = '') AS missing_title,
       count(*) FILTER (trim(case_summary) = '') AS missing_summary,
       CAST(median(length(case_summary)) AS DOUBLE) AS median_summary_chars
FROM cases GROUP BY file"""

BOUND = {
    "normalized_text": (normalized_text, NORMALIZED_TEXT),
    "searchable_text": (searchable_text, SEARCHABLE_TEXT),
    "view_terms": (word_statistics, WORD_STATISTICS),
    "view_scores": (view_scores, VIEW_SCORES),
    "fused_ranks": (fused_ranks, FUSED_RANKS),
    "case_panel": (case_panel, CASE_PANEL),
    "vocabulary_receipt": (vocabulary_receipt, VOCABULARY_RECEIPT),
    "anchor_ranks": (anchor_ranks, ANCHOR_RANKS),
    "global_baseline_panel": (global_baseline, GLOBAL_BASELINE),
    "release_cycles": (release_cycles, RELEASE_CYCLES),
    "facet_statistics": (facet_statistics, FACET_STATISTICS),
    "sample_prefixes": (sample_prefixes, SAMPLE_PREFIXES),
    "corpus_profile": (corpus_profile, CORPUS_PROFILE),
}


def panel_spread(spark, sf):
    """Of the panel, and of its first half with the domain at the first place left out."""
    panel = written(case_panel(spark, sf), "panel")
    first = panel.groupBy().agg(F.min_by("source", "position").alias("first")).scalar()
    fewer = panel.filter((F.col("position") <= TOP_K // 2) & (F.col("source") != first))
    spreads = [rewrites.panel_spread(rows, LANGS) for rows in (panel, fewer)]
    return spreads[0].withColumn("panel", F.lit("whole")).unionByName(spreads[1].withColumn("panel", F.lit("fewer")))


PANEL_SPREAD = f"""WITH panel AS MATERIALIZED ({CASE_PANEL}),
chosen AS (
  SELECT 'whole' AS panel, source FROM panel
  UNION ALL SELECT 'fewer', source FROM panel
  WHERE position <= {TOP_K // 2} AND source <> (SELECT source FROM panel WHERE position = 1)
),
held AS (
  SELECT v.panel, l.source, count(c.source) AS n
  FROM (SELECT unnest(['whole', 'fewer']) AS panel) v
  CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS source) l
  LEFT JOIN chosen c ON c.panel = v.panel AND c.source = l.source GROUP BY ALL
)
SELECT max(n) - min(n) AS spread, max(n) - min(n) <= 1 AS balanced, panel FROM held GROUP BY panel"""


def _rewritten(spark, sf):
    """The corpus as it is, rewritten in ways that must not matter, and without a tenth of its files."""
    docs = cases(spark, sf).withColumn("final_diagnosis", F.col("file"))
    registry = docs.select("record_key", "pmcid")
    moved = rewrites.project_identity(docs, "doc_id").join(registry, "record_key")
    return {
        "withheld": rewrites.redact(docs, ["final_diagnosis", "file"]),
        "reordered": docs.repartition(5, "file").sortWithinPartitions(F.col("pmcid").desc()),
        "identity moved": moved,
        "fewer files": docs.filter("doc_id % 10 <> 3"),
    }


def redacted_panel(spark, sf):
    """The panel after each rewrite against the one before: only missing files may change it."""
    base = written(case_panel(spark, sf), "panel")
    out = []
    for name, rows in _rewritten(spark, sf).items():
        panel = rt.retrieve(rows, QUERY_ID, facets(spark, sf), TOP_K, LANGS)
        out.append(rewrites.invariance(base, panel).withColumn("rewrite", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


_FEWER_PANEL = CASE_PANEL.replace("FROM documents", "FROM documents WHERE doc_id % 10 <> 3")
_BOTH_PANELS = f"""base AS MATERIALIZED ({CASE_PANEL}), fewer AS MATERIALIZED ({_FEWER_PANEL}),
panels AS (
  SELECT r AS rewrite, base.* FROM base CROSS JOIN (SELECT unnest(['withheld', 'reordered', 'identity moved']) AS r)
  UNION ALL SELECT 'fewer files', fewer.* FROM fewer
)"""
REDACTED_PANEL = f"""WITH {_BOTH_PANELS}
SELECT count(*) AS n, CAST(count(*) FILTER (NOT same) AS BIGINT) AS mismatches, bool_and(same) AS match, rewrite
FROM (SELECT p.rewrite, p.pmcid = b.pmcid AND p.source = b.source AND abs(p.score - b.score) <= 1e-10 AS same
      FROM panels p JOIN base b ON b.position = p.position)
GROUP BY rewrite"""


def domain_phases(spark, sf):
    """Results inside each domain: of the panel dealt in another order, and of the one with fewer files."""
    base = written(case_panel(spark, sf), "panel")
    fewer = rt.retrieve(_rewritten(spark, sf)["fewer files"], QUERY_ID, facets(spark, sf), TOP_K, LANGS)
    turned = base.withColumn("position", F.lit(TOP_K + 1) - F.col("position"))
    found = {"turned": turned, "fewer files": fewer}
    out = [rewrites.phase_match(rows, base).withColumn("panel", F.lit(n)) for n, rows in found.items()]
    return out[0].unionByName(out[1])


DOMAIN_PHASES = f"""WITH base AS MATERIALIZED ({CASE_PANEL}), fewer AS MATERIALIZED ({_FEWER_PANEL}),
panels AS (SELECT 'turned' AS panel, * FROM base UNION ALL SELECT 'fewer files', * FROM fewer),
placed AS (SELECT *, row_number() OVER (PARTITION BY panel, source ORDER BY score DESC, pmcid) AS n FROM panels),
wanted AS (
  SELECT panel, b.* FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, pmcid) AS n FROM base) b
  CROSS JOIN (SELECT unnest(['turned', 'fewer files']) AS panel)
)
SELECT coalesce(p.source, w.source) AS source, bool_and(coalesce(p.pmcid = w.pmcid AND abs(p.score - w.score) <= 1e-10, false)) AS match,
       coalesce(p.panel, w.panel) AS panel
FROM placed p FULL JOIN wanted w ON w.panel = p.panel AND w.source = p.source AND w.n = p.n GROUP BY ALL"""


BOUND["panel_spread"] = (panel_spread, PANEL_SPREAD)
BOUND["redacted_panel"] = (redacted_panel, REDACTED_PANEL)
BOUND["domain_phases"] = (domain_phases, DOMAIN_PHASES)
