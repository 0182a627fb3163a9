"""Main text of pages: planted articles, broken markup, and a plain reading of the given pages."""

import html
import re

import pytest

from rankweave.llm.html_text import LABELLED, fit, grown, judged, labelled_pages, main_text, op13_html_text, with_main_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tree(spark):
    return fit(labelled_pages(spark))


def test_given_pages_against_their_article_elements(spark):
    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", "", part)).split()) for part in re.split(r"</?(?:h1|p)>", inner))
        return "\n".join(p for p in parts if p)

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = op13_html_text(spark, SF).collect()
    assert len(found) == len(pages)
    for row in found:
        page = pages[row["page_id"]]
        assert row["text"] == article(page["html"]) and row["url"] == page["url"] and row["n_chars"] == len(row["text"])


def test_everything_around_an_article_goes(tree):
    page = (
        "<head><title>no</title><style>p{no}</style></head><body><header><h1>no</h1><nav><a href=/>no</a></nav></header><div class='cookie-banner'>no no no</div>"
        "<main><article><h1>One &amp; two</h1><p>A <b>b</b>old <a href=x>link</a>\n in&nbsp;it.<script>no('</p>')</script><p>Ok.<ul><li>x<li>y</ul>"
        "<!-- no --><div class=ad>no no</div><form><p>no no</p></form></article><section class=comments><article><p>no no no no no no no no</p></article></section></main>"
        "<aside><p>no no no no no no no no no no no no</p></aside><footer>&copy; no</footer>"
    )
    assert main_text(page, tree) == "One & two\nA bold link in it.\nOk.\nx\ny"


def test_pages_without_telling_elements(tree):
    long = " ".join(["words"] * 40)
    page = f"<div><a href=/>Home</a> <a href=/n>News</a></div><h1>Title</h1><p>{long}</p><p>Short.</p><p>{long}</p><div><a href=/i>Imprint</a> <a href=/c>Contact</a></div>"
    assert main_text(page, tree) == f"Title\n{long}\nShort.\n{long}"


@pytest.mark.parametrize("page", ["", " \n ", "<", "<p", "<article", "<p a='", "<!-- open", "<script>open", "</p></p>", "<a href=", "&#0;", "<article><p></p></article>"])
def test_unfinished_markup_ends_with_the_page(tree, page):
    assert isinstance(main_text(page, tree), str)


def test_references_are_decoded_once(tree):
    assert main_text("<article><p>&amp;lt; &lt;b&gt; &#x41;&#66; &am</p></article>", tree) == "&lt; <b> AB &am"


def test_nulls_repeats_clashing_names_long_pages_and_empty_tables(spark, tree):
    long = "<article><p>" + "word " * 300_000 + "</p></article>"
    rows = [(1, None, "old", 1), (1, None, "old", 1), (2, "", "old", 2), (None, "<article><p>kept</p></article>", "old", 3), (4, long, "old", 4)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, `a.b` int")
    found = with_main_text(pages, tree)
    assert sorted(found.columns) == ["a.b", "html", "page_id", "text"]
    assert sorted((r["a.b"], len(r["text"])) for r in found.collect()) == [(1, 0), (1, 0), (2, 0), (3, 4), (4, 300_000 * 5 - 1)]
    assert with_main_text(pages.limit(0), tree).count() == 0


def test_tree_learns_its_table_and_nothing_from_an_empty_one(spark):
    import numpy as np

    x = np.array([[k, k % 3] for k in range(30)], float)
    y = (x[:, 1] == 2).astype(float)
    assert (judged(grown(x, y), x) == (y == 1)).all()
    assert fit(labelled_pages(spark).limit(0)) is True
    with pytest.raises(ValueError):
        fit(labelled_pages(spark), most_parts=len(LABELLED))
