"""Retrieval against a direct computation, the fusion values and the panel order."""

import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.textfold import byte_total, normalize_text, strip_accents
from tidemark.operators import retrieval as rt
from tidemark.operators.contracts import ContractError
from tidemark.operators.rewrites import invariance, panel_spread, phase_match, project_identity, redact

WORDS = "shock bleed café stent chest pain naïve fever pulse graft ﬁne rate".split()


def docs(spark):
    rows = []
    for i in range(45):
        source = rt.DOMAINS[i % 3]
        title = " ".join(WORDS[(i * k + 3) % len(WORDS)] for k in (1, 2, 5))
        body = " ".join(WORDS[(i * i + k * k) % len(WORDS)] for k in range(2 + i % 9))
        rows.append((f"P{i % 40:02d}{source[0]}", source, title, body, i, "x"))
    return spark.createDataFrame(
        rows, "pmcid string, source string, title string, case_summary string, n long, final_diagnosis string"
    )


def facets(spark):
    rows = [("cardiac", "Chest pain and SHOCK"), ("systemic", "fever, naïve pulse rate"), ("vascular", "bleed graft stent fine")]
    return spark.createDataFrame(rows, "source string, text string")


def fold(text):
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower()).strip()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def word_terms(text):
    w = re.findall(r"\b\w\w+\b", text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def char_terms(text):
    padded = [f" {w} " for w in text.split()]
    return [p[i : i + n] for p in padded for n in (3, 4, 5) for i in range(len(p) - n + 1)]


def direct_fusion(rows, asked):
    out = {}
    for domain, query in asked.items():
        mine = [r for r in rows if r.source == domain]
        value = Counter()
        for split, top in ((word_terms, 0.98), (char_terms, 1.0)):
            counts = [Counter(split(fold(f"{r.title}\n{r.case_summary}"))) for r in mine]
            df = Counter(t for c in counts for t in c)
            n = len(mine)
            idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if 2 <= d <= top * n}

            def vector(c):
                w = {t: (1 + math.log(k)) * idf[t] for t, k in c.items() if t in idf}
                length = math.sqrt(math.fsum(x * x for x in w.values())) or 1
                return {t: x / length for t, x in w.items()}

            q = vector(Counter(split(fold(query))))
            scores = [round(math.fsum(q.get(t, 0) * x for t, x in vector(c).items()), 12) for c in counts]
            order = sorted(zip(mine, scores), key=lambda p: (-p[1], p[0].pmcid))
            for rank, (r, _) in enumerate(order, start=1):
                value[r.pmcid] += 1 / (60 + rank)
        ranked = sorted(value.items(), key=lambda p: (-p[1], p[0]))
        out[domain] = [(i, round(v, 12)) for i, v in ranked]
    return out


def test_panel_and_invariance(spark):
    cases, asked = docs(spark), facets(spark)
    want = direct_fusion(cases.collect(), {r.source: r.text for r in asked.collect()})
    index = rt.build_index(cases)
    ranked = rt.fused_ranks(index, asked).collect()
    for domain in rt.DOMAINS:
        mine = sorted((r for r in ranked if r.source == domain), key=lambda r: r["rank"])
        assert [(r.pmcid, round(r.score, 12)) for r in mine] == want[domain]
    panel = rt.retrieve(cases, "some_query", asked, 7, index=index)
    assert [r.position for r in panel.collect()] == list(range(1, 8))
    spread = panel_spread(panel, rt.DOMAINS).first()
    assert spread.balanced and spread.spread == 1
    changed = redact(cases, ["final_diagnosis"]).repartition(3, "n").sort(F.col("n").desc())
    again = rt.retrieve(changed, "some_query", asked, 7)
    assert invariance(panel, again).first().match
    assert all(r.match for r in phase_match(again, panel).collect())
    decomposed = cases.withColumn("title", F.regexp_replace("title", "é", "é"))
    assert invariance(panel, rt.retrieve(decomposed, "some_query", asked, 7)).first().match
    shown = project_identity(cases, "n")
    assert "pmcid" not in shown.columns and shown.filter("display_id = 'ref000001'").count() == 1


def test_best_without_sorting_the_corpus(spark, monkeypatch):
    """The first of each domain equal those of the full ranking, at depths that suffice and that do not."""
    cases, asked = docs(spark).distinct(), facets(spark)
    index = rt.build_index(cases.dropDuplicates(["pmcid", "source"]))
    full = {(r.source, r.pmcid): (r["rank"], round(r.score, 12)) for r in rt.fused_ranks(index, asked).collect()}
    monkeypatch.setattr(rt, "ordered_positions", lambda *_, **__: pytest.fail("the corpus was sorted"))
    for k, first in ((1, 1), (2, 2), (3, 12), (50, 200)):
        got = rt.best_fused(index, asked, k, depth=first).collect()
        want = {key: v for key, v in full.items() if v[0] <= k}
        assert {(r.source, r.pmcid): (r["rank"], round(r.score, 12)) for r in got} == want


def test_index_is_shared_checked_and_removed(spark, monkeypatch):
    cases, asked = docs(spark).withColumn("title", F.concat("title", F.lit(" shared"))), facets(spark)
    built, real = [], rt.build_index
    monkeypatch.setattr(rt, "build_index", lambda *a: built.append(1) or real(*a))
    panel = rt.retrieve(cases, "q", asked, 7).collect()
    turned = cases.repartition(3).sort(F.col("n").desc()).withColumn("n", -F.col("n"))
    assert rt.retrieve(turned, "q", asked, 7).collect() == panel and len(built) == 1
    rt.retrieve(cases.filter("n <> 3"), "q", asked, 7).collect()
    assert len(built) == 2
    # Another process compares the tables with the receipt and builds again what was changed.
    rt._verified.clear()
    stored = rt.shared_index(cases)
    assert len(built) == 2
    folder = stored.norms.inputFiles()[0].rsplit("/", 1)[0]
    stored.norms.limit(1).withColumn("norm", F.lit(0.5)).write.mode("append").parquet(folder)
    rt._verified.clear()
    assert rt.retrieve(cases, "q", asked, 7).collect() == panel and len(built) == 3
    assert rt.remove_index(cases) and not rt.remove_index(cases)
    assert rt.retrieve(cases, "q", asked, 7).collect() == panel and len(built) == 4


def test_blocks_hold_the_counts_of_terms(spark, monkeypatch):
    """Counts by block equal those of each text alone, also of texts of one id, of none and in small blocks."""
    monkeypatch.setattr(rt, "BLOCK_TEXT", 40)
    texts = ["naive  pulse pulse rate", "", "a bb 漢字漢字漢字 bb a", None, "x", "rate pulse", "pulse", "bb 😀😀😀 bb"]
    rows = [("de" if i % 3 else "en", f"P{i % 6}" if i != 4 else None, t) for i, t in enumerate(texts)] + [(None, "P9", "rate rate")]
    frame = spark.createDataFrame(rows, "source string, pmcid string, text string")
    blocks = rt.term_blocks(frame, rt.RELEASE_VIEWS).collect()
    ids = {(r.block, i): (r.source, key) for r in blocks if r.view is None for i, key in enumerate(r.ids)}
    got = Counter()
    for r in blocks:
        if r.view is not None:
            assert r.total == sum(r.tfs) and r.source == ids[r.block, r.docs[0]][0]
            for d, n in zip(r.docs, r.tfs, strict=True):
                assert n > 0
                got[*ids[r.block, d], r.view, r.term] += n
    want = Counter()
    for source, key, text in rows:
        for view, split in (("word", word_terms), ("char", char_terms)):
            for term in split(text or ""):
                want[source, key, view, term] += 1
    assert got == want and len(set(ids.values())) == len(ids)
    counted = rt.term_counts(frame, rt.RELEASE_VIEWS, ["source", "pmcid"]).collect()
    assert {(r.source, r.pmcid, r.view, r.term): r.tf for r in counted} == want


def test_terms_are_stored_by_block(spark):
    """The index holds a row for a term of a block, not one for a term of a document."""
    index = rt.build_index(docs(spark))
    held = index.terms.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("docs")).alias("postings")).first()
    assert held.rows < held.postings / 2


def direct_norms(rows, views, n_docs):
    """Norms and the vocabulary worked out from every text alone; texts of one id are one document."""
    out, words = {}, {}
    for view in views:
        counts = {}
        for source, key, text in rows:
            if source is not None:
                split = char_terms if view.split == "char_edges" else word_terms
                counts.setdefault((source, key), Counter()).update(split(text))
        for source in {s for s, _ in counts}:
            mine = {k: c for (s, k), c in counts.items() if s == source}
            df, tf = Counter(t for c in mine.values() for t in c), sum(mine.values(), Counter())
            kept = [t for t, d in df.items() if view.min_df <= d <= view.max_df * n_docs[source]]
            kept = set(sorted(kept, key=lambda t: (-tf[t], t))[: view.max_features])
            idf = {t: math.log((1 + n_docs[source]) / (1 + df[t])) + 1 for t in kept}
            words.update({(source, view.name, t): (df[t], tf[t]) for t in kept})
            for key, c in mine.items():
                weights = [(1 + math.log(n)) * idf[t] for t, n in c.items() if t in kept]
                if weights and key is not None:
                    out[source, view.name, key] = math.sqrt(math.fsum(x * x for x in weights))
    return out, words


@pytest.mark.parametrize("cap,repeats", [(None, True), (None, False), (7, True)])
def test_norms_and_vocabulary_of_blocks(spark, tmp_path, monkeypatch, cap, repeats):
    """Small blocks and shares give the norms and terms of every text, with ids that repeat or are null, and under a cap."""
    monkeypatch.setattr(rt, "BLOCK_TEXT", 60)
    views = [rt.View("word", "word_pairs", min_df=2, max_df=0.98, max_features=cap), rt.View("char", "char_edges", min_df=2, max_features=cap)]
    keys = [f"P{i % (9 if repeats else 23)}" if i % 7 or not repeats else None for i in range(23)]
    rows = [
        ("de" if i % 3 else "en", key, " ".join(WORDS[(i * i + k) % len(WORDS)] for k in range(i % 6)))
        for i, key in enumerate(keys)
    ] + ([(None, "P9", "rate rate"), ("fr", "X", "bleed"), ("fr", None, "")] if repeats else [])
    frame = spark.createDataFrame([(*r, "") for r in rows], "source string, pmcid string, title string, case_summary string")
    index = rt.build_index(frame, views, path=f"{tmp_path}/index")
    folded = [(s, k, fold(t)) for s, k, t in rows]
    want, words = direct_norms(folded, views, Counter(s for s, *_ in rows))
    got = {(r.source, r.view, r.pmcid): r.norm for r in index.norms.collect()}
    assert got == pytest.approx(want) and len(got) == index.norms.count()
    found = {(r.source, r.view, r.term): (r.df, r.corpus_tf) for r in index.vocabulary.collect()}
    assert found == words and len(found) == index.vocabulary.count()


def test_no_terms_of_documents_are_stored_or_dealt_out(spark, tmp_path):
    """An index stores the folded texts, not their postings, and a request deals out dots, not terms."""
    rows = [(f"P{i}", "de", " ".join(WORDS[(i + k) % len(WORDS)] for k in range(8)), "") for i in range(60)]
    frame = spark.createDataFrame(rows, "pmcid string, source string, title string, case_summary string")
    index = rt.build_index(frame, path=f"{tmp_path}/index")
    tables = {p.name: spark.read.parquet(str(p)) for p in (tmp_path / "index").iterdir()}
    assert set(tables) == {"texts", "counted", "norms", "documents"} and tables["texts"].count() == 60
    assert tables["counted"].filter("term IS NULL").count() < 10
    asked = spark.createDataFrame([("de", "pulse rate")], "source string, text string")
    plan = rt.cosine_scores(index, asked)._jdf.queryExecution().toString()
    assert "tfs" not in plan and "posexplode" not in plan.lower()


@pytest.mark.parametrize(
    "ranks,value",
    [((1, 3), 0.032266458496), ((12, 2), 0.030017921147), ((15, 7), 0.028258706468), ((16, 6), 0.028309409888)],
)
def test_fusion_values(spark, ranks, value):
    got = spark.range(1).select(F.round(rt.rrf(*[F.lit(r) for r in ranks]), 12)).first()[0]
    assert got == value


@pytest.mark.parametrize(
    "query,k,total,prefix",
    [
        ("seeded_post_pci_counterfactual_a", 7, 3369, "csvcsvc"),
        ("seeded_post_pci_counterfactual_b", 8, 3370, "scvscvsc"),
        ("seeded_post_pci_counterfactual_c", 10, 3371, "vscvscvscv"),
    ],
)
def test_release_cycle(spark, query, k, total, prefix):
    request = spark.createDataFrame([(query, k)], "query_id string, top_k int")
    assert request.select(byte_total(normalize_text(F.col("query_id")))).first()[0] == total
    rows = [(d, f"{d}{i}", 1.0 / (i + 1), i + 1) for d in rt.DOMAINS for i in range(5)]
    ranked = spark.createDataFrame(rows, "source string, pmcid string, score double, rank long")
    panel = rt.balanced_panel(ranked, rt.release_cycle(request), k).orderBy("position").collect()
    assert "".join(r.source[0] for r in panel) == prefix


def test_panel_limits(spark):
    ranked = spark.createDataFrame(
        [("cardiac", "a", 0.5, 1), ("systemic", "b", 0.5, 1), ("systemic", "c", 0.4, 2)],
        "source string, pmcid string, score double, rank long",
    )
    request = spark.createDataFrame([("q", 3)], "query_id string, top_k int")
    cycle = rt.release_cycle(request)
    assert rt.balanced_panel(ranked, cycle, 3).count() == 3
    with pytest.raises(ContractError):
        rt.balanced_panel(ranked, cycle, 0)
    with pytest.raises(Exception, match="fewer ranked rows"):
        rt.balanced_panel(ranked, cycle, 4).collect()
    with pytest.raises(Exception, match="fewer ranked rows"):
        rt.balanced_panel(ranked.limit(0), cycle, 1).collect()


def test_folding(spark):
    frame = spark.createDataFrame([(" Ñandú ﬁN\t\nX ",), ("plain  Text",), (None,)], "t string")
    got = [r[0] for r in frame.select(strip_accents(normalize_text(F.col("t")))).collect()]
    assert got == ["nandu fin x", "plain text", None]


def test_view_terms_counts_by_domain(spark, tmp_path, monkeypatch):
    """Terms are counted for a domain at once: no row for a term of a document is made."""
    from bindings import retrieval as bound

    rows = [(1, "de", "eins zwei\nzwei", "a"), (2, "de", "zwei drei", "a"), (3, "fr", "un", "b"), (4, None, "un un", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    kept, real = [], rt.term_counts
    monkeypatch.setattr(rt, "term_counts", lambda t, v, keep: kept.append(list(keep)) or real(t, v, keep))
    got = {(r.source, r.view): (r.terms, r.occurrences) for r in bound.word_statistics(spark, str(tmp_path)).collect()}
    assert kept == [["source"]]
    for lang, texts in (("de", ["eins zwei zwei", "zwei drei"]), ("fr", ["un"]), (None, ["un un"])):
        for view, split in (("word", word_terms), ("char", char_terms)):
            counts = Counter(t for text in texts for t in split(text))
            assert got[lang, view] == (len(counts), sum(counts.values()))
