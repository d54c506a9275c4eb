"""Link graph, ranked search and phrases against plain brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases, queries, ranked_search, url_graph

RULES = queries.URL_RULES


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fits = []
    for judgement, rule in rules:
        of, _, begin = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + begin):
            fits.append((-len(rule), judgement == "allow", rule, judgement))
    return min(fits)[2:] if fits else (None, None)


def plain_verdicts(rows, links, rules):
    """``links`` are (source host, target host); dense rounds until nothing moves."""
    parts = {i: plain_parts(u) for i, u in rows}
    ruled = {i: plain_rule(*p, rules) for i, p in parts.items()}
    links = {(a, b) for a, b in links if a != b and a}
    hosts = {h for h, _ in parts.values()} | {h for e in links for h in e}
    seed = {}
    for h in hosts:
        mine = [ruled[i][1] for i, p in parts.items() if p[0] == h] or [plain_rule(h, "/", rules)[1]]
        seed[h] = (mine.count("allow") / len(mine), mine.count("block") / len(mine))
    outs = {h: [b for a, b in links if a == h] for h in hosts}
    ins = {h: [a for a, b in links if b == h] for h in hosts}
    trust, distrust = ({h: seed[h][k] for h in hosts} for k in (0, 1))
    for _ in range(url_graph.ROUNDS):
        trust = {h: seed[h][0] + sum(0.85 * trust[a] / len(outs[a]) for a in ins[h]) for h in hosts}
        distrust = {h: seed[h][1] + sum(0.85 * distrust[b] / len(ins[b]) for b in outs[h]) for h in hosts}
    verdict = {h: "block" if distrust[h] - trust[h] > 0.5 + 1e-9 else "allow" for h in hosts}
    return {i: (*parts[i], ruled[i][0], ruled[i][1] or verdict[parts[i][0]]) for i in parts}


ANCHORS = ["<a href='{}'>", '<a class=x href="{}">', "<A\nHREF = {}>", "<area shape=rect href={} >"]


def web(seed, pages=260, hosts=30):
    draw = random.Random(seed)
    names = [f"h{i}.{draw.choice(['example.com', 'example.net', 'org', 'io'])}" for i in range(hosts)]
    rows, links = [], []
    for i in range(pages):
        host = names[0] if i % 3 == 0 else draw.choice(names)
        url = f"http://{host.title()}{draw.choice(['/en/', '/de/', '/fr/', '/', '', '?q=/en/', '#/fr/'])}{i}"
        html = "<p><a href='/local'>x</a><a data-href='http://no.net/'>"
        for _ in range(draw.randrange(4)):
            to = draw.choice([*names, f"out{draw.randrange(9)}.net"])
            html += draw.choice(ANCHORS).format(f"{draw.choice(['http:', 'HTTPS:', ''])}//{to.upper()}/x")
            links.append((plain_parts(url)[0], to))
        rows.append((i, url, html))
    rows += [(900, None, None), (901, "no scheme", "<a href=http://h1.org>"), (902, "x://", ""), (903, "a://b://net/", None), (904, "http://net/", "")]
    links = [(a, b) for a, b in links if a]
    return rows, links


@pytest.mark.parametrize("seed", [1])
def test_url_verdicts_against_dense_rounds(spark, seed, monkeypatch):
    monkeypatch.setattr(url_graph, "ARCS_A_SALT", 3)
    rows, links = web(seed)
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = url_graph.judged(pages, url_graph.rule_table(spark, RULES)).collect()
    want = plain_verdicts([(i, u) for i, u, _ in rows], links, RULES)
    assert {r.page_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)
    plain = {plain_rule(h, p, RULES)[1] for h, p, _, _ in want.values()}
    assert plain == {"allow", "block", None}
    unruled = [r.verdict for r in got if r.rule is None]
    assert {"allow", "block"} == set(unruled)


def test_url_filter_equals_its_sql_on_a_linked_web(spark, tmp_path):
    rows, _ = web(3)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op13_url_filter(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.url_filter_sql()).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(str, [tuple(r[n] for n in names) for r in got])) == sorted(map(str, want))


def test_url_filter_of_odd_tables(spark):
    rules = url_graph.rule_table(spark, [])
    kinds = "page_id long, url string, html string"
    assert url_graph.judged(spark.createDataFrame([], kinds), rules).count() == 0
    twice = spark.createDataFrame([(None, "http://a.net/x", ""), (1, "http://a.net/x", ""), (1, "http://a.net/x", "")], kinds)
    assert [r.verdict for r in url_graph.judged(twice, rules).collect()] == ["allow"] * 3
    blocked = url_graph.judged(twice, url_graph.rule_table(spark, [("block", "a.net/"), ("allow", "net/")])).collect()
    assert [(r.rule, r.verdict) for r in blocked] == [("a.net/", "block")] * 3


def duck_of(spark, folder, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    rows = con.execute(sql).fetchall()
    return [c[0] for c in con.description], rows


def same_rows(got, names, want):
    assert sorted(map(str, [tuple(r[n] for n in names) for r in got])) == sorted(map(str, want))


def plain_ranks(docs, items, k):
    """Every document against every item, in whole numbers."""
    split = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [split.findall((t or "").translate(lower)) for _, t in docs]
    count, words = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(w for ts in terms for w in set(ts))
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(split.findall((t or "").translate(lower)))
    out = set()
    for i, ws in wanted.items():
        scored = []
        for (key, _), ts in zip(docs, terms):
            tf, m = Counter(ts), 50 + (50 * len(ts) * count) // max(words, 1)
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m))
                for w in ws
                if tf[w]
            )
            if score:
                scored.append((-score, key is None, key))
        for rank, (score, _, key) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.add((i, rank, key, -score))
    return out


def search_tables(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Übung", "ÉA", "x1"]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, odds, k=draw.randrange(0, 60)))) for i in range(700)]
    docs += [(i + 2000, docs[i][1]) for i in range(120)] + [docs[3], docs[3], (3000, None), (3001, ""), (3002, "-- ?! \x7f"), (None, docs[5][1]), (None, docs[5][1])]
    items = [(i, "?".join(draw.choices(words, k=draw.randrange(1, 25)))) for i in range(12)]
    items += [items[0], (5, "W1,w2;w3 again"), (50, None), (51, "unknown"), (None, "w9 x1")]
    return docs, items


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_ranked_search_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "TERMS_A_GROUP", 120)
    monkeypatch.setattr(ranked_search, "PIECE", 17)
    docs, items = search_tables(block)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ranked_search.ranked(frame, wanted, k=20).collect()]
    assert set(got) == plain_ranks(docs, items, 20)
    assert len({(r[0], r[1]) for r in got}) == len(got)


def test_ranked_search_of_odd_tables(spark, documents, nothing):
    items = spark.createDataFrame([(1, "zebra one"), (2, "")], "item_id int, text string")
    assert [(r.item_id, r.doc_id) for r in ranked_search.ranked(documents, items).sort("rank").collect()] == [(1, 8), (1, 5)]
    assert ranked_search.ranked(nothing, items).count() == 0
    assert ranked_search.ranked(documents, items.limit(0)).count() == 0
    named = ranked_search.ranked(documents.select(F.col("lang").alias("name"), "text"), items, key="name")
    assert {r.name for r in named.collect()} == {"en", "fr"}


def test_accumulators_stop_early():
    """Few documents hold the rare term; the common ones open no accumulator once these lead."""
    n = 5_000
    ids = np.concatenate([np.zeros(100, int), np.ones(n, int)])
    owner = np.concatenate([np.arange(100), np.arange(n)])
    order = np.argsort(owner, kind="stable")
    block = ranked_search.Block(np.full(n, 30), np.bincount(owner), ids[order], np.ones(len(ids), int), (n, 30 * n), 2)
    docs, scores, opened = block.best([(0, 9000), (1, 10)], 0, 50)
    assert opened == 100 and set(docs) == set(range(100)) and len(set(scores)) == 1


def test_search_equals_its_sql(spark, tmp_path):
    docs, items = search_tables(9)
    tables = {
        "documents": spark.createDataFrame([d for d in docs if d[0] is not None], "doc_id long, text string"),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
    }
    names, want = duck_of(spark, tmp_path, queries.OP11_SQL, **tables)
    same_rows(queries.op11_ranked_search(spark, str(tmp_path)).collect(), names, want)


def plain_phrases(rows, top, least):
    """All phrases of two and three words, scored and dropped one by one."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = {}
    for lang, text in rows:
        of = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                of.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = set()
    for lang, of in counts.items():
        n = sum(v for p, v in of.items() if len(p) == 1)
        longer = Counter()
        for p, v in of.items():
            if len(p) == 3 and v >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], v)
        scored = []
        for p, a in of.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a):
                score, _, le, r = min((10**6 * a * a // (of[p[:k]] * of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), le, r))
        for rank, (s, a, p, le, r) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, le, r, n, -s))
    return out


def phrase_rows(seed):
    draw = random.Random(seed)
    words = [f"v{i}" for i in range(60)] + ["É", "ß.", "a"]
    odds = [1 / (i + 1) for i in range(len(words))]
    fixed = ["new york city", "in spite of", "a a a a", "Of The Record", "u\tv"]
    rows = []
    for i in range(500):
        parts = draw.choices(words, odds, k=draw.randrange(0, 50))
        for _ in range(draw.randrange(3)):
            parts.insert(draw.randrange(len(parts) + 1), draw.choice(fixed))
        for at in range(0, len(parts), 7):
            parts[at] += draw.choice(["", ".", ",", "\n", " ; ", "\r\n", "\x0b"])
        rows.append((draw.choice(["en", "en", "en", "fr", "de", None]), draw.choice([" ", "  "]).join(parts)))
    return rows + [("xx", "only once"), ("yy", None), (None, ""), ("und", "new york city " * 20)] + rows[:30]


@pytest.mark.parametrize(
    ("top", "known", "slots", "floors"),
    [(2000, 1 << 20, 23, (50_000, 2_000, 0)), (15, 20, 6, (600_000, 200_000, 0)), (25, 0, 12, (50_000, 0))],
)
def test_phrases_against_all_phrases(spark, monkeypatch, top, known, slots, floors):
    for name, value in {"KNOWN": known, "SLOT_BITS": slots, "FLOORS": floors, "CHARS": 900, "LOCAL": 500}.items():
        monkeypatch.setattr(phrases, name, value)
    rows = phrase_rows(top)
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "lang string, text string, phrase string, a int").repartition(3)
    got = [tuple(r) for r in phrases.collocations(frame, top=top).collect()]
    assert set(got) == plain_phrases(rows, top, 10) and len(got) == len(set(got))


def test_phrases_equal_their_sql(spark, tmp_path):
    docs = spark.createDataFrame(phrase_rows(4), "lang string, text string")
    names, want = duck_of(spark, tmp_path, queries.OP12_SQL, documents=docs)
    same_rows(queries.op12_phrases(spark, str(tmp_path)).collect(), names, want)


def test_phrases_of_odd_rows(documents, nothing):
    got = phrases.collocations(documents).collect()
    assert [(r.lang, r.phrase, r.a, r.score) for r in got] == [("en", "zebra zebra zebra", 39_998, 999_925)]
    assert phrases.collocations(nothing).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    draw = random.Random(3)
    rows = []
    for _ in range(200):
        a = draw.randrange(1, 10**14)
        rows.append((a, draw.randrange(a, 2 * a + 1), draw.randrange(a, 10**15)))
    frame = spark.createDataFrame(rows, "a long, l long, r long").select("*", phrases._score("a", "l", "r").alias("s"))
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in frame.collect())
