"""Per-text operators: tokens, automaton, toxicity, language, pages."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import html_text, language, toxicity
from tidemark.llm.bpe_automaton import Automaton, TextCoder, decoded, encoded, load_tables, token_digests
from tidemark.llm.queries import vocabulary
from tidemark.llm.draws import balanced_sample
from tidemark.llm.token_counts import TextCounter, load_merges, token_counts

ODD = [
    "", " ", "a", "\n\n  x \t y", "<|endoftext|>", "a<|endoftext|><|startoftext|> b", "aaaaaaaaaaaaaaaaa!!!!",
    "ΑΣ ΟΔΟΣ İ é é ﬁ 中文字 😀😀 don't it's 12345 \x1c\x85\xa0x", "rrrrmi ciónlllló " * 3, "x" * 5000,
]


def texts(count=150):
    draw = random.Random(3)
    pools = ["abcdelnt'stre 1é中!?.\n ", "thein rr ss ll  ", "".join(map(chr, range(33, 0x250)))]
    return ODD + ["".join(draw.choice(pools[i % 3]) for _ in range(draw.randrange(1, 150))) for i in range(count)]


def test_counts_equal_the_library():
    path = vocabulary("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), TextCounter(load_merges(path))
    for text in texts():
        assert mine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_long_texts_are_counted_match_by_match(monkeypatch):
    monkeypatch.setattr("tidemark.llm.token_counts.LONG_TEXT", 10)
    monkeypatch.setattr("tidemark.llm.bpe_automaton.LONG_TEXT", 10)
    test_counts_equal_the_library()
    test_coding_equals_the_library()


def test_coding_equals_the_library():
    path = vocabulary("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), TextCoder(load_tables(path))
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        want = library.decode(ids, skip_special_tokens=False)
        assert mine.encode(text).tolist() == ids and mine.decode(ids) == want, text
        packed = np.array(ids, dtype="<u4").tobytes()
        assert mine.digest(text) == (
            len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(want.encode()).hexdigest()
        )


def test_decoding_needs_identifiers_only(spark):
    """Any identifiers, of whatever path or none, against the library."""
    path = vocabulary("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), TextCoder(load_tables(path))
    draw = random.Random(6)
    lists = [[draw.randrange(library.get_vocab_size()) for _ in range(draw.randrange(0, 40))] for _ in range(200)]
    assert [mine.decode(ids) for ids in lists] == [library.decode(ids, skip_special_tokens=False) for ids in lists]
    assert mine.decode([-1, 10**9]) == ""
    frame = spark.createDataFrame([(1, [320, 321]), (2, []), (3, None)], "i int, ids array<int>")
    got = {r.i: r.t for r in frame.select("i", decoded(frame, F.col("ids"), path).alias("t")).collect()}
    assert got == {1: library.decode([320, 321], skip_special_tokens=False), 2: "", 3: ""}


def test_automaton_paths_are_the_merge_results():
    draw = random.Random(1)
    for _ in range(60):
        vocabulary_, merges = ["a", "b"], []
        for _ in range(draw.randrange(1, 9)):
            pair = (draw.choice(vocabulary_), draw.choice(vocabulary_))
            if pair not in merges and "".join(pair) not in vocabulary_:
                merges.append(pair)
                vocabulary_.append("".join(pair))
        auto = Automaton(["a", "b"], merges)
        arc = {label: i for i, label in enumerate(auto.label)}
        for n in range(1, 9):
            word = [draw.choice("ab") for _ in range(n)]
            for a, b in merges:
                out = []
                for letter in word:
                    if out and out[-1] == a and letter == b and not (a == b and out[-1] is None):
                        out[-1] = a + b
                    else:
                        out.append(letter)
                word = out
            arcs = [arc[x] for x in word]
            assert all(auto.allows(x, y) for x, y in zip(arcs, arcs[1:])), (merges, word)


def test_token_columns_on_odd_rows(documents, nothing):
    for docs in (documents, nothing):
        counted = docs.select("doc_id", "text", token_counts(docs, F.col("text"), vocabulary("byte_bpe_50k.json")).alias("n"))
        coded = docs.select("text", token_digests(docs, F.col("text"), vocabulary("word_bpe_49k.json")).alias("c"))
        whole = docs.select("text", encoded(docs, F.col("text"), vocabulary("word_bpe_49k.json")).alias("c"))
        assert all(r.n == 0 for r in counted.collect() if not r.text)
        for r in coded.collect():
            assert r.c.n_tokens > 0 or not (r.text or "").strip()
        assert whole.count() == docs.count()


def test_main_text_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href=/x>Menu, one, two</a></ul></nav>
    <div class="cookie-notice">We use cookies, really, many, many.</div>
    <article><h1>Title &amp; more</h1><p>First para, with commas, and&nbsp;words.<p>Second<br>line <b>bold</b>, ok.
    <div class="ad">Buy, buy, buy</div><ul><li>item one<li>item two</ul><script>var a="</p>";</script></article>
    <aside>Related, things, here</aside><div id="comments"><p>Reader says, hello, there, friends.</p></div>
    <form><p>Subscribe, now</p></form><footer>&copy; foot</footer>"""
    want = "Title & more First para, with commas, and words. Second line bold, ok. item one item two"
    assert html_text.main_text(page) == want
    assert html_text.main_text("") == "" and html_text.main_text("<nav>only menu</nav>") == ""
    assert html_text.main_text("plain < text & more") == "plain < text & more"


SIDE = "<nav><a href=/>Menu, one, two</a></nav><div id='sidebar-left'>Other things, many, many.</div>"
STORY = "First para, with commas, and words. Second line, just as long as the first, ok."
PARAS = "<p>First para, with commas, and words.</p><p>Second line, just as long as the first, ok.</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"{SIDE}<div class='content has-sidebar'>{PARAS}</div>", STORY),
        (f"{SIDE}<div class='no-sidebar'>{PARAS}</div>", STORY),
        (f"{SIDE}<div class='layout-with-sidebar widget'>{PARAS}</div>", STORY),
        (f"{SIDE}<article>{PARAS}<section id='related-work'><p>Related work, of others.</p></section></article>", STORY + " Related work, of others."),
        (f"{SIDE}<article><h2 id='notice-period'>Notice period</h2>{PARAS}</article>", "Notice period " + STORY),
        (f"{SIDE}<article>{PARAS}<p class='social-policy'>On policy, at last.</p></article>", STORY + " On policy, at last."),
        (f"{SIDE}<article>{PARAS}<figure><img src=x><figcaption>A picture, of it.</figcaption></figure></article>", STORY + " A picture, of it."),
        (f"{SIDE}<header>Site name</header><article><header><h1>Title</h1></header>{PARAS}</article>", "Title " + STORY),
        (f"{SIDE}<article><p data-x=it's>Quoted, once.</p>{PARAS}</article>", "Quoted, once. " + STORY),
        (f"{SIDE}<article><p title='a > b' data-y=\"x'>y\">Quoted, twice.</p>{PARAS}</article>", "Quoted, twice. " + STORY),
        (f"{SIDE}<article>{PARAS}<div class='ad-slot'>Buy, now.</div><div class=advert>Buy.</div></article>", STORY),
        (f"<article>{PARAS}</article><div class='comment-list'>{PARAS * 5}</div><div class='share-buttons'>Tell, all.</div>", STORY),
        (f"<article>{PARAS}</article><div class='cookie-notice'>We use cookies, really.</div><footer>End, of it.</footer>", STORY),
    ],
)
def test_names_do_not_lose_articles(page, want):
    assert html_text.main_text(page) == want


def test_time_grows_with_the_page():
    import time

    pages = [
        "<div>" * 8000 + "<p>Deep, down, here.",
        "<div><p>text, one</p>" * 8000,
        "<div>" * 4000 + "</section>" * 4000 + "Words, here.",
        "<div>" * 4000 + "<li>one, two" * 4000,
        "<p title='" * 4000,
        "<" * 50_000,
    ]
    for page in pages:
        start = time.time()
        html_text.main_text(page)
        assert time.time() - start < 2
    assert html_text.main_text(pages[0]) == "Deep, down, here."


def test_articles_of_all_pages():
    """The article of each page, read off its tags, with adverts and scripts taken out."""
    pages = pd.read_parquet("/root/testdata/sf0.1/pages.parquet")
    inside = re.compile(r"<article>(.*)</article>", re.S)
    for page in pages["html"]:
        article = inside.search(page).group(1)
        article = re.sub(r"<div class=\"ad\">.*?</div>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", article, flags=re.S)
        article = re.sub(r"</?(?:b|i|em|strong|a|span)(?: [^>]*)?>", "", article)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert html_text.main_text(page) == want


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "<p>Hi, you.", "y"), (2, "<p>Hi, you.", "y")], "page_id int, html string, text string")
    out = [r.t for r in pages.select(html_text.extracted(pages, F.col("html")).alias("t")).collect()]
    assert out == ["", "Hi, you.", "Hi, you."]
    empty = pages.limit(0)
    assert empty.select(html_text.extracted(empty, F.col("html"))).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels


def test_toxicity_of_held_out_rows(labelled):
    docs, labels = labelled
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "text", "toxic", "lang")
    train = [r for r in rows.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    rest = [r for r in rows.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang == "en"]
    model = toxicity.fit([r.text for r in train], [r.toxic for r in train])
    scores = np.array(toxicity.Scorer(model).scores([r.text for r in rest]))
    truth = np.array([r.toxic for r in rest])
    low, high = scores[truth == 0], scores[truth == 1]
    assert (high[:, None] > low[None, :]).mean() > 0.85
    # A misspelt word stays near the word it comes from.
    known = toxicity.Scorer(model)
    known.learn(["idiot", "idi0ot", "idiott", "theation"])
    assert known.known["idiott"] > known.known["theation"]


def test_toxicity_on_odd_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(9, 1), (9, 1), (4, None), (None, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(documents, labels)
    assert not model["bucket"].any()
    assert list(map(len, toxicity.words_of("A " + "b" * 10_000 + " c"))) == [1, 4096, 4096, 1808, 1]
    for docs in (documents, nothing):
        got = docs.select(toxicity.toxicity_score(docs, F.col("text"), model).alias("s")).collect()
        assert len(got) == docs.count() and all(0 <= r.s <= 1 for r in got)


def test_language_of_held_out_rows(labelled):
    docs, _ = labelled
    rows = docs.select("doc_id", "text", "lang").collect()
    model = language.fit_language(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"), 400)
    rest = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    names, scores = language.Labeller(model).label([r.text for r in rest])
    assert np.mean([n == r.lang for n, r in zip(names, rest)]) > 0.93
    assert all(0 <= s <= 1 for s in scores)


def test_gradients_by_differences():
    draw = np.random.default_rng(0)
    side = language.Direction.fresh(draw)
    side = language.Direction(*[p.astype(np.float64) for p in (side.table, side.recurrent, side.bias)])
    steps = draw.integers(0, 256, (5, 3))
    weight = draw.normal(size=(5, language.UNITS, 3)).astype(np.float32)
    trace: list = []
    side.run(steps, trace)
    slopes = side.slopes(trace, weight)
    for part, slope in zip((side.table, side.recurrent, side.bias), slopes):
        place = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        values = []
        for move in (1e-3, -2e-3):
            part[place] += move
            values.append(float((side.run(steps) * weight).sum()))
        part[place] += 1e-3
        assert (values[0] - values[1]) / 2e-3 == pytest.approx(slope[place], rel=0.05, abs=1e-3)


def test_language_on_odd_rows(spark, documents, nothing):
    model = language.fit_language(documents.filter("doc_id in (9, 5, 8)"), 10)
    got = {r.doc_id: r.l for r in documents.select("doc_id", language.language(documents, F.col("text"), model).alias("l")).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[6].lang_pred == "und"
    assert got[9].lang_pred == "en" and got[11].lang_pred in ("en", "fr")
    blank = language.fit_language(nothing)
    assert {r.l.lang_pred for r in documents.select(language.language(documents, F.col("text"), blank).alias("l")).collect()} == {"und"}
    assert nothing.select(language.language(nothing, F.col("text"), model)).count() == 0


def test_draws_are_bounded_and_even(spark):
    rows = spark.createDataFrame(pd.DataFrame({"doc_id": range(2000), "toxic": [int(i % 10 == 0) for i in range(2000)]}))
    got = balanced_sample(rows, "doc_id", "toxic", 200).groupBy("toxic").count().collect()
    assert all(60 < r["count"] < 140 for r in got) and len(got) == 2
