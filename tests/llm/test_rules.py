"""Rules and decontamination on Spark functions, web pages, and the pipeline."""

import math
import random

import pytest
from llm_brute import base_measures, components, repeats, shingles

import corpus_pipeline
from companylens.llm.decontaminate import MARK, _places, _tokenised, contaminated_documents, remove_contaminated
from companylens.llm.html_text import extract_pages, main_text, read_page
from companylens.llm.quality_rules import COMMON_WORDS, judge
from companylens.llm.queries import QUERIES

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def sound_text(lang, n, seed):
    own = random.Random(seed)
    filler = ["lorem", "Ipsum", "dolor,", "amet.", "tempor", "magna", "aliqua"]
    return " ".join(
        own.choice(COMMON_WORDS[lang]) if own.random() < 0.4 else own.choice(filler) + str(own.choice("abcdefg"))
        for _ in range(n)
    )


def test_measures(spark, untidy, nothing):
    rows = judge(untidy).collect()
    texts = {r["doc_id"]: r["text"] for r in untidy.collect()}
    assert len(rows) == untidy.count()
    for r in rows:
        assert tuple(r[c] for c in MEASURES) == base_measures(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert judge(nothing).count() == 0
    assert judge(untidy.drop("lang")).count() == untidy.count()


def test_divergence_rejects_odd_texts(spark):
    rows = [(i, sound_text(lang, 200, i), lang) for i, lang in enumerate(sorted(COMMON_WORDS) * 20)]
    odd = [
        (1001, sound_text("en", 300, 7).upper(), "en"),
        (1002, " ".join(w + "###" for w in sound_text("de", 300, 8).split()), "de"),
        (1003, " | ".join(f"item{i} {i * 37}" for i in range(200)), "fr"),
    ]
    swapped = [(2001, sound_text("en", 300, 9), "fr"), (2002, sound_text("es", 300, 10), None)]
    found = judge(spark.createDataFrame(rows + odd + swapped, "doc_id long, text string, lang string")).collect()
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert not kept & {i for i, _, _ in odd}
    assert {i for i, _, _ in swapped} <= kept
    assert len(kept & {i for i, _, _ in rows}) >= len(rows) - 2


def test_languages_without_a_reference(spark):
    """They are judged by the base rules; texts without a language still meet all references."""
    own = random.Random(4)
    other = " ".join(own.choice("che non per una sono della il questo anche molto casa tempo vita grande".split()) + own.choice("abcdefg") for _ in range(150))
    rows = [(i, sound_text(lang, 200, i), lang) for i, lang in enumerate(sorted(COMMON_WORDS) * 10)]
    rows += [(1001, other, "it"), (1002, other, None), (1003, other, ""), (1004, "ciao " * 80, "it"), (1005, "poche parole", "it")]
    found = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"] for r in found if r["kept"] and r["doc_id"] > 1000} == {1001}


def sentence(seed, n=30):
    own = random.Random(seed)
    return " ".join(f"v{own.choice('abcdefgh')}{own.choice('klmnop')}{own.choice('rst')}" for _ in range(n))


QUESTION = (
    "A train leaves Boston at 30 km per hour and after 4 hours the driver Alice meets Bob who had 30 apples "
    "in total, said Alice."
)


def test_templates(spark):
    same = QUESTION.replace("30", "55.5").replace("Boston", "Paris").replace("Alice", "Mary Ann").replace("Bob", "Tom")
    other = same.replace("had 55.5", "had 61")  # the same number twice became two numbers
    docs = [(1, f"Before this. {QUESTION} After."), (2, f"before this. {same} After."), (3, other), (4, "tiny item text")]
    docs += [(5, sentence(1)), (6, sentence(2)), (7, QUESTION[:50]), (8, None), (9, "")]
    items = [(1, QUESTION), (2, "Tiny item, TEXT!"), (3, sentence(1)), (4, None), (5, ""), (6, "1 2 3 4 5 6 7")]
    found = contaminated_documents(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 1), (4, 2), (5, 3)}
    assert {r["n_slots"] for r in found if r["item_id"] == 1} == {7}


def test_names_where_sentences_begin(spark):
    """Other names in a copy, also at the begin of texts, sentences, lines, quotes and brackets."""
    item = (
        "Alice has 12 apples and two green pears in a basket. Alice buys 5 more apples at the market today. "
        "How many apples are there in the basket?\nCarol asks them. \"Alice (Bob knows) must share them with all of us\"."
    )
    same = item.replace("Alice", "Mary Ann").replace("Bob", "Tom").replace("Carol", "Sue").replace("12", "17")
    torn = same.replace("Mary Ann", "Peter", 1)  # one person became two
    docs = [(1, f"Before this. {item} After."), (2, f"before this. {same} After."), (3, torn), (4, f"Question: {same}")]
    found = contaminated_documents(
        spark.createDataFrame(docs + [(5, item.lower())], "doc_id long, text string"),
        spark.createDataFrame([(1, item)], "item_id long, text string"),
    ).collect()
    assert {r["doc_id"] for r in found} >= {1, 2, 4}
    assert 3 not in {r["doc_id"] for r in found}


def test_short_items_and_items_without_words(spark):
    """Copies of items shorter than a window, or of numbers alone, inside longer texts."""
    items = [(1, "What is 2 + 2?"), (2, "12 + 15 = 27"), (3, "1 2 3 4 5 6 7"), (4, "Paris"), (5, "?!"), (6, None)]
    docs = [
        (1, f"{sentence(1)}. what is 2 + 2? {sentence(2)}"),
        (2, f"{sentence(3)}, 12 + 15 = 27, {sentence(4)}"),
        (3, f"{sentence(5)} 1 2 3 4 5 6 7 {sentence(6)}"),
        (4, f"{sentence(7)} 1 2 3 4 6 7 Parisian. What is 2 + 3? 12 + 16 = 27"),
        (5, "They met in Paris."),
        (6, None),
    ]
    found = contaminated_documents(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (2, 2), (3, 3), (5, 4)]


def test_long_runs_of_names_numbers_and_signs(spark):
    """They take no stack: a stack overflow ends the executor, and with it the job."""
    names, numbers, signs = "Anna " * 30_000, "12," * 30_000 + "7", "\U0001f600 - " * 30_000
    runs = [names, numbers, signs]
    docs = [(i, f"so said {run} to them. {QUESTION}") for i, run in enumerate(runs)]
    docs += [(10 + i, f"{run} to them, {QUESTION[:50]}") for i, run in enumerate(runs)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = contaminated_documents(table, spark.createDataFrame([(1, QUESTION)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {0, 1, 2}
    tokens = {r["doc_id"]: r["tokens"] for r in _tokenised(table, "doc_id").collect()}
    assert [tokens[i][:5] for i in range(2)] == [["so", "said", MARK + t, "to", "them"] for t in ("panna", "n" + numbers)]
    assert tokens[2][:4] == ["so", "said", "to", "them"]
    assert [tokens[10 + i][:3] for i in range(2)] == [[MARK + t, "to", "them"] for t in ("sanna", "n" + numbers)]
    assert tokens[12][:2] == ["to", "them"]


def test_windows(spark):
    """Hashes of windows are compiled, and equal where the templates are, as put together word by word."""
    texts = [QUESTION, QUESTION.replace("30", "7"), "Alice met Bob. Carol met him, 3 km on.", "Ann has 5", "Two", "7 8 9", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "row long, text string")
    tokenised = _tokenised(docs, "row")
    places = _places(tokenised, "row", "at", 5)
    plan = places.select("row", "hash")._jdf.queryExecution().executedPlan().toString()
    steps = [line.lstrip(" +-:") for line in plan.split("\n") if "AS window#" in line]
    assert steps and all(step.startswith("*(") and "lambda" not in step for step in steps)

    def template(token, named):
        if token.startswith(MARK + "s"):
            return MARK + "p" if named else token[2:]
        return token[:2] if token.startswith(MARK) else token

    expected = {}
    for r in tokenised.collect():
        for at in range(max(len(r["tokens"]) - 4, 1) if r["tokens"] else 0):
            window = r["tokens"][at : at + 5]
            kinds = [tuple(template(t, named) for t in window) for named in (False, True)]
            for kind in dict.fromkeys(kinds):
                if sum(not t.startswith(MARK) for t in kind) >= min(2, len(r["tokens"])):
                    expected.setdefault(kind, []).append((r["row"], at))
    found = {}
    for r in places.collect():
        found.setdefault(r["hash"], []).append((r["row"], r["at"]))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_decontamination_of_untidy_rows(spark, untidy, nothing):
    base = untidy.where("doc_id = 3").first()["text"]
    items = spark.createDataFrame([(1, base), (1, base), (None, base), (4, None)], "item_id long, text string")
    found = contaminated_documents(untidy, items).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3}
    assert len(found) == 4 * 3  # two rows of document 1, three items
    out = remove_contaminated(untidy, items)
    assert out.columns == untidy.columns
    assert out.count() == untidy.count() - 4
    assert contaminated_documents(nothing, items).count() == 0
    assert contaminated_documents(untidy, items.limit(0)).count() == 0


def test_contamination_of_the_driver_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    whole = {(d["doc_id"], b["item_id"]) for d in docs for b in items if b["text"] in (d["text"] or "")}
    rows = QUERIES["op6_template_decontamination"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == whole


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>"</p>"</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- x --><div class="cookie-notice">Ok?</div>
<article><h1>Title &amp; more</h1><p><b>One &lt;two&gt;<br>three&nbsp;four &am <p>Second<span class="ad">Buy</span> part</p>
<aside>Side</aside><ul><li>a<li>b</ul><form>Name <input></form><div class="comments"><p>Nice!</div></article>
<footer>&copy; x</footer></body></html>"""


def test_main_text():
    text = main_text(read_page(PAGE), None, False, frozenset())
    assert text == "Title & more\n\nOne <two> three four &am\n\nSecond\n\npart\n\na\n\nb"
    assert main_text(read_page(None), None, False, frozenset()) == ""
    assert main_text(read_page("plain  words\n only"), None, False, frozenset()) == "plain words only"


def test_templates_of_hosts(spark):
    """Pages without an article: the slot that differs is the content, constant texts go."""
    pages = []
    for i in range(12):
        body = f"<div id=top>Welcome to us</div><div class=box><p>{sentence(i, 40)}</p><p>Read on</p><p>{sentence(50 + i)}</p></div>"
        pages.append((i, f"http://a.example/{i}", f"<html><body>{body}<div>All rights</div></body></html>", "x"))
    pages += [(100, "http://b.example/1", PAGE, "x"), (101, None, PAGE, None), (102, "odd", None, None), (None, "http://b.example/2", "", "x")]
    pages += [pages[0]]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    rows = extract_pages(table).collect()
    assert len(rows) == len(pages)
    texts = {r["page_id"]: r["text"] for r in rows}
    for i in range(12):
        assert texts[i] == f"{sentence(i, 40)}\n\n{sentence(50 + i)}"
    assert texts[100] == texts[101] == main_text(read_page(PAGE), None, False, frozenset())
    assert texts[102] == texts[None] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert extract_pages(table.limit(0)).count() == 0


def test_constant_texts_inside_articles(spark):
    """A block that repeats on a host's pages goes, also in an article and under a neutral class."""
    notice = "<div class=x1><p>Get our letter each week</p></div>"
    pages = [
        (i, f"http://a.example/{i}", f"<html><body><article><p>{sentence(i)}</p>{notice}<p>{sentence(50 + i)}</p></article></body></html>")
        for i in range(8)
    ]
    copies = [(100 + i, f"http://b.example/{i}", f"<html><body><article><p>{sentence(9)}</p></article></body></html>") for i in range(8)]
    rows = extract_pages(spark.createDataFrame(pages + copies, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in rows}
    for i in range(8):
        assert texts[i] == f"{sentence(i)}\n\n{sentence(50 + i)}"
        assert texts[100 + i] == sentence(9)


@pytest.mark.parametrize(
    "name", ["content has-sidebar", "post no-comments", "col with-header", "entry form-page", "article-body related-less"]
)
def test_names_that_say_what_an_element_has_or_lacks(name):
    html = f"<body><div class='site-header'>Top</div><div class='{name}'><p>One</p><p>Two</p></div><div class=sidebar>Side</div></body>"
    assert main_text(read_page(html), None, False, frozenset()) == "One\n\nTwo"


def test_names_around_the_only_article():
    inner = "<article><h1>Title</h1><p>One</p><div class=comment-list><p>Nice!</p></div></article>"
    html = f"<body><div class='header-overlay'><div class=menu>Menu</div>{inner}</div></body>"
    assert main_text(read_page(html), None, False, frozenset()) == "Title\n\nOne"
    comments = "<body><p>Text</p><div class=comments><article class=comment-body><p>Nice!</p></article></div></body>"
    assert main_text(read_page(comments), None, False, frozenset()) == "Text"
    deep = "<div>" * 20_000 + "<p>Down here</p>"
    assert main_text(read_page(deep), None, False, frozenset()) == "Down here"


def test_near_copies_and_page_types(spark):
    """Near copies keep their common paragraphs; each of two layouts of a host has its own template."""
    rows = []
    for i in range(8):
        html = f"<article><p>{sentence(1)}</p><p>{sentence(2)}</p><p>Edition {i} corrected by desk {i}.</p></article>"
        rows.append((i, f"http://a.example/{i}", f"<html><body>{html}</body></html>"))
        same = f"<div class=a>{sentence(3)}</div>"
        rows.append((100 + i, f"http://b.example/{i}", f"<html><body>{same}</body></html>"))
        one = f"<div class=top>Welcome to our portal</div><div class=text><p>{sentence(10 + i)}</p><p>{sentence(30 + i)}</p></div>"
        two = f"<section class=call>Sign our petition today</section><section class=story><p>{sentence(50 + i)}</p></section>"
        rows.append((200 + i, f"http://c.example/{i}", f"<html><body class='page-{i}'>{one}</body></html>"))
        rows.append((300 + i, f"http://c.example/x{i}", f"<html><body>{two}</body></html>"))
    found = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    for i in range(8):
        assert texts[i] == f"{sentence(1)}\n\n{sentence(2)}\n\nEdition {i} corrected by desk {i}."
        assert texts[100 + i] == sentence(3)
        assert texts[200 + i] == f"{sentence(10 + i)}\n\n{sentence(30 + i)}"
        assert texts[300 + i] == sentence(50 + i)


def test_pages_of_the_driver_tables(spark, sf_dir):
    rows = QUERIES["op3_template_extraction"](spark, sf_dir).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r["page_id"] for r in rows} == set(pages)
    for r in rows:
        inner = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert r["text"] == main_text(read_page(inner), None, False, frozenset())
        assert r["text"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.materialize(stage(spark, tables[-1], sf_dir), name.replace(" ", "-")))
    return [[r.asDict() for r in t.collect()] for t in tables], [t.columns for t in tables]


def test_pipeline_stages(spark, sf_dir, stages):
    (docs, good, near, cut, clean, packed), columns = stages
    assert all(c == columns[0] for c in columns[:5])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    marked = [r["doc_id"] for r in docs if r["doc_id"] in labels]
    right = sum((i in kept) == (labels[i] == 1) for i in marked)
    assert right > 0.95 * len(marked)

    groups = components({r["doc_id"]: r["text"] for r in good}, 80)
    assert {r["doc_id"] for r in near} == {i for i, (_, c) in groups.items() if i == c}

    expected = repeats([(r["doc_id"], r["text"]) for r in sorted(near, key=lambda r: r["doc_id"])], keep_first=True)
    for r in cut:
        # Whole characters only, so a few bytes at the ends of a span may stay.
        assert 0 <= len(r["text"].encode()) - len(expected[r["doc_id"]][4]) <= 6 * expected[r["doc_id"]][2]
        assert r["n_chars"] == len(r["text"])
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for r in clean:
        assert not any(t in r["text"] for t in items)
    gone = {r["doc_id"] for r in cut} - {r["doc_id"] for r in clean}
    texts = {r["doc_id"]: r["text"] for r in cut}
    for i in gone:
        own = shingles(texts[i])
        assert any(len(own & shingles(t)) > 0.5 * len(shingles(t)) for t in items)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= math.ceil(total / 2048) + 1


def test_pipeline_run(spark, sf_dir, stages):
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(tuple(r[k] for k in key) for r in rows) == sorted(tuple(r[k] for k in key) for r in stages[0][-1])
