"""Operators 2, 3 and 6: held-out accuracy, brute force, and odd input."""

import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from glean.llm import fm, langid, queries, sitetree

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, 1, "a"), (2, "", "en", "s", None, None), (None, "123 --- 456", "en", "s", 1, "a")]
    rows += [(3, "the and of with this " * 20_000, "en", "s", 1, "a")] * 2 + [(i, "le la les dans une " * 9, "fr", "s", 1, "a") for i in range(4, 40)]
    rows += [(i, "the and of with this " * 9, "en", "s", 1, "a") for i in range(40, 80)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score int, lang_pred string")


def labels_of(spark):
    return {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


# --- 2 ---
def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    e, trans = rng.random((5, 2, 3)) + 0.1, rng.normal(size=(3, 3))
    lengths = np.array([5, 3])
    post, pairs, norm = langid.marginals(e, lengths, trans)
    want_pairs = np.zeros((3, 3))
    for j, n in enumerate(lengths):
        total, own, both = 0.0, np.zeros((5, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            p = math.prod(e[t, j, y] for t, y in enumerate(path)) * math.exp(sum(trans[a, b] for a, b in zip(path, path[1:]))) / 3
            total += p
            for t, y in enumerate(path):
                own[t, y] += p
            for a, b in zip(path, path[1:]):
                both[a, b] += p
        assert np.allclose(post[:, j], own / total) and np.isclose(norm[j], math.log(total))
        want_pairs += both / total
    assert np.allclose(pairs, want_pairs)


def test_language_query(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_code_switched_words_are_labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    text = {la: langid.words(docs.filter(f"lang = '{la}' AND length(text) > 600 AND crc32(cast(doc_id AS string)) % 4 = 2").first().text)[:60] for la in ("en", "fr")}
    ws = text["en"] + text["fr"]
    post, _, _ = langid.marginals(model.potentials(ws)[:, None, :], np.array([len(ws)]), model.trans)
    names = [model.labels[i] for i in post[:, 0].argmax(axis=1)]
    assert sum(a == b for a, b in zip(names, ["en"] * 60 + ["fr"] * 60)) > 108


def test_language_odd_input(spark, odd):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r for r in rows}
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (1, 2, None))
    assert got[3].lang_pred == "en" and got[5].lang_pred == "fr"
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert langid.identify(odd.limit(0)).count() == 0 and langid.accepted(odd.limit(0)).count() == 0
    nothing = odd.filter("lang is null")
    assert [(r.lang_pred, r.score) for r in langid.identify(nothing).collect()] == [("und", 0.0)]
    one = odd.filter("lang = 'fr'")
    assert {(r.lang_pred, r.score) for r in langid.identify(one).collect()} == {("fr", 1.0)}


def test_language_with_clashing_columns_and_nothing_to_learn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    clash = docs.withColumn("d", docs.doc_id).withColumn("la", docs.lang).withColumn("s", docs.lang).withColumn("rank", docs.doc_id)
    kept = langid.accepted(clash)
    assert kept.columns == clash.columns and kept.count() == langid.accepted(docs).count() > 100
    assert langid.identify(clash).count() == 120
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert langid.accepted(unlabelled).count() == sum(bool(langid.words(r.text)) for r in docs.collect()) > 100


def test_language_stage_rejects_on_evidence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    held = {r.lang: r.text for r in docs.filter("length(text) > 900 AND crc32(cast(doc_id AS string)) % 4 = 2").collect()}
    assert len(held) >= 4
    even = " ".join(" ".join(langid.words(t)[:40]) for t in held.values())
    strange = "\u65e5\u672c \u8a9e\u6587 \u7ae0\u3067 \u3059\u304b \u3089\u8aad \u3081\u306a \u3044"
    rows = spark.createDataFrame([(1, even), (2, strange), (3, "12 -- 3"), (4, None)] + [(9, t) for t in held.values()], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in langid.accepted(rows, model).collect()) == [1] + [9] * len(held)


def test_language_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LABELS", 2)
    rows = [(i, f"alpha beta w{i}", la) for i, la in enumerate(["a"] * 9 + ["b"] * 9 + ["c", "d"])]
    assert langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).labels == ["a", "b"]


# --- 3 ---
def brute_article(page):
    """Text between <article> tags, by blocks: enough for the pages of the tables."""
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", p.replace("<b>", "").replace("</b>", ""))).split()) for p in parts]
    return "\n".join(b for b in blocks if b)


def test_page_query(spark):
    source = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op3_site_tree(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(source)
    for r in rows:
        assert r.url == source[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == brute_article(source[r.page_id].html)


def brute_importance(pages):
    """Composite importance by recursion over the merged tree, straight from the formulas."""
    styles, texts, kids, labels = defaultdict(Counter), defaultdict(Counter), defaultdict(lambda: defaultdict(float)), {}
    for page in pages:
        for n in sitetree._nodes(sitetree.parse(page)):
            if not n.path:
                continue
            below = sitetree._blocks_below(n)
            own = sitetree._own_text(n)
            labels[n.path] = n.label
            if below:
                styles[n.path][" ".join(c.label for c in below)] += 1
                for c in below:
                    kids[n.path][c.path] += 1 / len(below)
            if own or not below:
                texts[n.path][own] += 1

    def content(e):
        m = sum(texts[e].values())
        return 1.0 if m < 2 else 1 - sum(math.log(c, m) for c in texts[e].values()) / len(texts[e])

    def composite(e):
        if not styles[e]:
            return content(e)
        m, n = sum(styles[e].values()), len(styles[e])
        shape = 1.0 if m < 2 else -sum(c / m * math.log(c / m, m) for c in styles[e].values())
        occurrences = max(m, sum(texts[e].values()))
        below = sum(w / occurrences * composite(c) for c, w in kids[e].items())
        if texts[e]:
            below = 0.5 * below + 0.5 * content(e)
        return (1 - 0.9**n) * shape + 0.9**n * below

    times = {e: max(sum(styles[e].values()), sum(texts[e].values())) for e in labels}
    return {e: (composite(e), times[e], labels[e]) for e in labels}


def site(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    pages, want = [], []
    for i in range(n):
        body = [" ".join(word() for _ in range(9)) for _ in range(rng.randint(2, 6))]
        want.append("\n".join(body))
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        pages.append(
            f"<html><head><title>{word()}</title></head><body><div id=top><div class=logo>Our site</div><ul class=bar><li>Home</li><li>News</li></ul></div>"
            f"<div id=text>{paragraphs}</div><div class=box><span>All rights</span> reserved</div></body></html>"
        )
    return pages, want


def test_style_tree_removes_what_a_host_repeats(spark):
    pages, want = site(40)
    rows = [(i, f"http://A.example:80/{i}", p, "x") for i, p in enumerate(pages)] + [(100, "http://b.example/", pages[0], "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(5)
    got = {r.page_id: r.text for r in sitetree.extract(df).collect()}
    assert [got[i] for i in range(40)] == want
    assert "Our site" in got[100]  # a host of one page has nothing to compare
    removed = {r.host: set(r.paths) for r in sitetree.removed_paths(df).collect()}
    brute = brute_importance(pages)
    low = {sitetree._signed(e) for e, (x, m, _) in brute.items() if x < sitetree.THRESHOLD and m >= sitetree.MIN_OCCURRENCES}
    assert removed == {"a.example": low} and low


def test_importance_matches_recursion(spark, monkeypatch):
    rng = random.Random(2)
    pages = []
    for _ in range(30):
        deep = "".join(f"<div class=c{rng.randint(0, 3)}>" + rng.choice(["x", "", "y", "<section>q<div>r</div></section>"]) + "</div>" for _ in range(rng.randint(0, 4)))
        pages.append(f"<body><div>{deep}</div>{rng.choice(['', 'tail', '<p>para</p>'])}</body>")
    df = spark.createDataFrame([(i, None, p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    brute = brute_importance(pages)
    for threshold in (0.1, 0.3, 0.5, 0.9):
        got = [set(r.paths) for r in sitetree.removed_paths(df, threshold).collect()]
        want = {sitetree._signed(e) for e, (x, m, _) in brute.items() if x < threshold and m >= sitetree.MIN_OCCURRENCES}
        assert got == ([want] if want else [])


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt; &eacute;&#x41;&nbsp;x", "plain <text> éA x"),
        ("<article><h1>T</h1><p>a\n  b<p>c<br>d<ul><li>e<li>f</ul></article>after", "T\na b\nc d\ne\nf"),
        ("<p>out</p><main><p>in</p><aside>no</aside><div class='comments'><p>no</p></div><form><input>no</form></main>", "in"),
        ("<article>a<!-- <p>no</p> --><script>if (a<b) '</p>'</script><style>p{}</style> b</article>", "a b"),
        ("<article><p>a <b>bold<i>both</b> c</p><p>d", "a boldboth c\nd"),
        ("<article><p>x</p><article class='comment'><p>no</p></article></article>", "x"),
        ("<div class='has-sidebar'><div class='sidebar'>no</div><p>yes</p></div>", "yes"),
        ("<div class='sidebar wrap'><article><p>yes</p></article></div>", "yes"),
        ("<article><p title='a > b'>q</p><p>1 < 2 &am</article><!-- open <p>no", "q\n1 < 2 &am"),
        ("<body><nav>no</nav><header>no</header><p>yes</p><footer>no</footer><div role=navigation>no</div></body>", "yes"),
    ],
)
def test_main_text(page, text):
    assert sitetree.main_text(page) == text


@pytest.mark.parametrize(
    "body,text",
    [
        ('<h1>T</h1><section id="discussion"><h2 id="related-work">R</h2><p>d</p></section>', "T\nR\nd"),
        ('<h2><span class="mw-headline" id="Search_engines">Search engines</span></h2><p class="ad-hoc">a</p>', "Search engines\na"),
        ('<p title="The hidden cost">q</p><p title="x class=ad id=comments">r</p>', "q\nr"),
        ('<p>a <span class="notice">b</span> <a class="share" href=/x>c</a></p><div class="notice"><p>no</p></div>', "a b c"),
        ('<section class="login-flow header"><p>a</p></section><ul class="skip"><li class="reply">b</li></ul>', "a\nb"),
        ('<div class="ad"><p>no</p></div><ol class="comment-list"><li>no</li></ol><div role="navigation">no</div><p hidden>no</p><p>yes</p>', "yes"),
    ],
)
def test_names_inside_an_article_do_not_cut_its_text(body, text):
    assert sitetree.main_text(f"<article>{body}</article>") == text
    assert sitetree.main_text(f"<main>{body}</main><p>out</p>") == text


def test_copied_article_stays_whole_in_its_wrappers():
    body = "<div class=body><section><p>a</p><ul><li><div>b</div></li></ul></section></div><div class=bar><span>Save</span></div><div><table><tr><td>c</table></div>"
    page = f"<article><h1>T</h1>{body}</article>"
    low = frozenset(sitetree._signed(n.path) for n in sitetree._nodes(sitetree.parse(page)) if n.path)
    assert sitetree.main_text(page, low) == "T\na\nb\nc"


def test_mirror_host_keeps_its_articles(spark):
    page = "<article><h1>T</h1><div class=body><p>one</p><p>two</p><p>three</p></div></article>"
    df = spark.createDataFrame([(i, f"http://m.example/{i}", page) for i in range(100)], "page_id int, url string, html string")
    assert {r.text for r in sitetree.extract(df).collect()} == {"T\none\ntwo\nthree"}


def test_article_names_count_as_a_whole():
    assert sitetree.main_text('<article id="discussion-of-x" class="post comments-open"><p>yes</p></article><p>out</p>') == "yes"
    assert sitetree.main_text('<article><p>yes</p></article><article id="comment-12"><p>no</p></article>') == "yes"


def test_pages_odd_input(spark):
    long = "<article>" + "<p>word word</p>" * 30_000 + "</article>"
    deep = "<div>" * 3000 + "text"
    rows = [(1, None, None, "a"), (2, "", "", "a"), (None, "x", "<p>one</p>", None), (3, "http://h/", long, "a"), (4, "http://h/", deep, "a")]
    df = spark.createDataFrame(rows + rows[2:3], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in sitetree.extract(df).collect()}
    assert got[1].text == got[2].text == "" and got[None].text == "one" and got[3].n_chars == 30_000 * 10 - 1 and got[4].text == "text"
    assert sitetree.extract(df).count() == 6 and sitetree.extract(df.limit(0)).count() == 0


# --- 6 ---
def test_interactions_match_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = fm.Machine(0.3, rng.normal(size=fm.DIM), rng.normal(size=(fm.DIM, fm.RANK)), np.zeros(len(fm.STATS)), np.ones(len(fm.STATS)))
    index, value = fm.vector("Some words, some MORE words!\nand a line | with marks")
    x = m.scaled(value)
    pairs = sum(m.factors[i] @ m.factors[j] * x[a] * x[b] for a, i in enumerate(index) for b, j in enumerate(index) if a < b)
    assert m.margin(index, value) == pytest.approx(0.3 + m.linear[index] @ x + pairs)


def test_quality_query(spark):
    quality = labels_of(spark)
    rows = queries.op6_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    good, bad = ([r.score for r in held if quality[r.doc_id] == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / len(good) / len(bad) > 0.98
    assert sum(r.predicted == quality[r.doc_id] for r in held) / len(held) > 0.95


def test_quality_odd_input(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, None), (4, 1), (4, 0), (4, 1), (50, 0), (None, 1), (999, 1)], "doc_id bigint, quality int")
    rows = fm.quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in fm.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert fm.quality(odd.limit(0), labels).count() == 0


BODY = "<p>First words of the text.</p>%s<p>Last words of the text.</p>"


@pytest.mark.parametrize("region", ["<article>%s</article>", "<main>%s</main>"])
@pytest.mark.parametrize(
    "noise",
    [
        '<div class="notice"><p>X</p></div>',
        '<div class="alert"><p>X</p></div>',
        '<section id="comments"><p>X</p></section>',
        '<div id="disqus_thread"><p>X</p></div>',
        '<div id="respond"><p>X</p></div>',
        '<div class="related"><h3>X</h3><ul><li>X</li></ul></div>',
        '<div class="popup"><p>X</p></div>',
        '<ul class="menu"><li>X</li></ul>',
        '<div class="footer"><p>X</p></div>',
        '<p class="notice">X</p>',
    ],
)
def test_declared_boilerplate_inside_a_region_goes(region, noise):
    got = sitetree.main_text(f"<html><body>{region % (BODY % noise)}</body></html>")
    assert got == "First words of the text.\nLast words of the text."


@pytest.mark.parametrize(
    "part",
    [
        '<section id="discussion"><p>X</p></section>',
        '<h2 id="related-work">X</h2>',
        '<p><span class="mw-headline" id="Search_engines">X</span></p>',
        '<p class="ad-hoc">X</p>',
        '<p title="The hidden cost">X</p>',
        "<header><h2>X</h2></header>",
    ],
)
def test_text_with_such_ids_and_headings_stays(part):
    got = sitetree.main_text(f"<html><body><article>{BODY % part}</article></body></html>")
    assert got == "First words of the text.\nX\nLast words of the text."


def test_title_in_the_header_of_the_article_stays():
    page = "<body><header><h1>Site</h1></header><article><header><h1>Title</h1><nav>menu</nav></header><p>Text.</p></article></body>"
    assert sitetree.main_text(page) == "Title\nText."


def test_deep_pages_take_linear_time():
    import time

    n = 200_000
    began = time.process_time()
    got = sitetree.main_text("<article><p>Text.</p></article>" + "<div>" * n + "x" + "</div>" * n + "<b>" * 1000 + "</i>" * 50_000)
    assert time.process_time() - began < 15 and got.startswith("Text.")
