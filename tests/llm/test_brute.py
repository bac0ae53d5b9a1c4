"""HTML, languages and pages against plain Python versions, over random and odd inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathomer.llm import html_text, langid
from tests.llm import brute

STOPS = sorted(html_text.STOP_WORDS)


def prose(rng, size, share):
    """Words of which a share are stop words, some ``size`` characters long."""
    out = ""
    while len(out) < size:
        out += (rng.choice(STOPS) if rng.random() < share else "".join(rng.choice("bcdfgklmzx") for _ in range(rng.randint(3, 9)))) + " "
    return out.strip()


def some_block(rng, depth=0):
    kind = rng.random()
    text = lambda: prose(rng, rng.choice([5, 30, 65, 75, 120, 250]), rng.choice([0.05, 0.2, 0.5]))
    named = rng.choice(["", "", "", "", ' class="ad"', ' class="page related"', ' class="comments"', ' class="shareholders"', ' class="teaser"', ' class="widget"'])
    if kind < 0.35:
        return f"<p{named}>{text()}</p>"
    if kind < 0.5:
        return f"<p>{text()} <a href='x'>{text()}</a></p>"
    if kind < 0.6:
        tag = rng.choice(["h1", "h2", "h3"])
        return f"<{tag}>{'<a href=x>' * (linked := rng.random() < 0.3)}{prose(rng, 20, 0.3)}{'</a>' * linked}</{tag}>"
    if kind < 0.7:
        return "<ul>" + "".join(f"<li><a href='x'>{prose(rng, 12, 0.2)}</a></li>" for _ in range(rng.randint(1, 5))) + "</ul>"
    if kind < 0.76:
        return f"<p>{text()} <span class='{rng.choice(['share', 'ad', 'x'])}'>{prose(rng, rng.choice([10, 90]), 0.2)}</span> end</p>"
    if kind < 0.8:
        return f"<p>© {prose(rng, 30, 0.2)}</p>"
    if depth > 2:
        return ""
    tag = rng.choice(["div", "section", "nav", "aside", "footer", "header", "form", "div", "article"])
    return f"<{tag}{named}>" + "".join(some_block(rng, depth + 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"


def some_page(rng):
    blocks = "".join(some_block(rng) for _ in range(rng.randint(1, 7)))
    main = rng.choice(["", "article", "main"])
    inner = f"<{main}>" + "".join(some_block(rng, 1) for _ in range(rng.randint(1, 6))) + f"</{main}>" if main else ""
    return f"<html><head></head><body>{blocks}{inner}{some_block(rng)}</body></html>"


@pytest.mark.parametrize("seed", range(300))
def test_main_text_equals_the_rules_on_trees(seed):
    page = some_page(random.Random(seed))
    assert html_text.main_text(page) == brute.main_text(page, html_text.STOP_WORDS)


def test_most_random_pages_have_blocks_of_every_label():
    labels = set()
    for seed in range(50):
        blocks = html_text.blocks_of(some_page(random.Random(seed)))
        html_text._first_pass(blocks)
        labels |= {b.label for b in blocks}
    assert labels == {"good", "bad", "near", "short"}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1><a href=/x>My title</a></h1><p>Body.</p></article>", "My title Body."),
        ("<article><p>First.</p><p><a>A link to the source</a></p><p>Last.</p></article>", "First. A link to the source Last."),
        ("<article><p class='teaser'>Lead.</p><p>More.</p></article>", "Lead. More."),
        ("<article><div class='shareholders'>They met.</div></article>", "They met."),
        ("<h1>Heading</h1><p>This is what they had to say about it at the house, and that was all there is to be said.</p>", "Heading This is what they had to say about it at the house, and that was all there is to be said."),
        ("<div class='page has-sidebar'><article><p>Body.</p></article></div>", "Body."),
        ("<div id='sidebar-wrap'><main><p>Body.</p></main></div>", "Body."),
        ("<form action=x><main><p>Body.</p></main></form>", "Body."),
        ("<article><p>Body.</p><section class=comments><article><p>Nice.</p></article></section></article>", "Body."),
        ("<article class='post comments-open'><p>Body.</p></article>", "Body."),
        ("<article><p>a</p><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul><p>b</p></article>", "a b"),
        ("<article>x <b>y<div>z</b></div> w</article>", "x y z w"),
        ("<article><a href=x>l<p>in</a></p>out</article>", "l in out"),
    ],
)
def test_articles_lose_nothing(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("unit", ["<div>", "<div><p>", "<b><div>", "<td>x", "<span class=ad><p>", "</b><div class=nav>x</div>"])
def test_time_is_linear_in_nesting(unit):
    import time

    def seconds(n):
        began = time.perf_counter()
        html_text.main_text(unit * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 12 * seconds(10_000) + 0.5


def rows_of(rng, count):
    texts = {
        "en": "the house that they had when it was with this and from there", "fr": "la maison que les autres avaient pour nous dans une ville avec elle",
        "de": "das haus und der mann sind nicht mit einem über die straße", "es": "los niños que estaban en la casa con una señora más tarde",
    }
    hosts = ["a.fr", "b.example.de", "c", "", "d.es", "hot.com", "hot.com", "hot.com"]
    out = []
    for i in range(count):
        lang = rng.choice(list(texts))
        text = rng.choice([" ".join(rng.choices(texts[lang].split(), k=rng.randint(1, 12))), " ".join(rng.choices(texts[lang].split(), k=30)), "12 -- 3", "", None, "zq xj"])
        declared = rng.choice([lang, lang, lang.upper() + "-x", None, "xx", rng.choice(list(texts))])
        out.append((rng.choice([i, i, i, 7, None]), text, declared, rng.choice(hosts)))
    return out


@pytest.mark.parametrize(("seed", "sample"), [(1, 400), (2, 5)])
def test_languages_equal_brute_force(spark, seed, sample):
    rows = rows_of(random.Random(seed), 150)
    numbered = [(n, *r) for n, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, "n long, doc_id long, text string, lang string, source string").withColumn("declared", F.lit("clash"))
    kept = {r.n for r in langid.keep_told(df, sample=sample).collect()}
    want = brute.languages(rows, langid.SUFFIX_LANGUAGE, sample=sample)
    assert kept == {n for n, (lang, _) in enumerate(want) if lang != "und"}
    got = sorted((str(r.doc_id), r.predicted, round(r.posterior, 6)) for r in langid.identify(df, sample=sample).collect())
    assert got == sorted((str(r[0]), lang, round(p, 6)) for r, (lang, p) in zip(rows, want, strict=True))


def test_rows_of_one_id_are_one_of_the_sample(spark):
    rows = [(1, f"the house {i}", "en", "s") for i in range(3000)] + [(2, "la maison", "fr", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(df, id_col="doc_id", text_col="text", declared_col="lang", sample=400)
    one = langid.fit(df.where("text IN ('the house 0', 'la maison')"), id_col="doc_id", text_col="text", declared_col="lang")
    assert (model.table == one.table).all()


def test_pages_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{h or 'x'}/p", d, t) for i, t, d, h in rows_of(rng, 60)]
    page = lambda d, t: None if t is None else f"<html{f' lang={chr(34)}{d}{chr(34)}' if d else ''}><body><nav><a>menu</a></nav><article><p>{t}</p></article></body></html>"
    df = spark.createDataFrame([(i, u, page(d, t)) for i, u, d, t in rows], "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "markup": F.lit("x")})
    want = brute.languages([(i, t, d if t is not None else None, u.split("/")[2]) for i, u, d, t in rows], langid.SUFFIX_LANGUAGE)
    got = sorted((str(r.page_id), r.predicted, round(r.posterior, 6)) for r in langid.of_pages(df).collect())
    assert got == sorted((str(r[0]), lang, round(p, 6)) for r, (lang, p) in zip(rows, want, strict=True))
    assert langid.of_pages(df.limit(0)).count() == 0
