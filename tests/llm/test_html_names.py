"""What the names of classes and ids may leave out."""

import pytest

from modsplit_spark.llm.html_template import main_text

KEPT = [
    ("<article><h2 id='search-algorithms'>Search</h2><p>t</p></article>", "Search\nt"),
    ("<article><h2 id='comments' class='title'>Comments</h2><p>t</p></article>", "Comments\nt"),
    ("<article><section id='related-work'><p>t</p></section></article>", "t"),
    ("<article><section id='search'><p>t</p></section><div class='section' id='form'><p>u</p></div></article>", "t\nu"),
    ("<article><p class='notice-board'>t</p><p class='notice'>u</p></article>", "t\nu"),
    ("<div class='no-sidebar'><article><p>t</p></article></div>", "t"),
    ("<div class='no-sidebar'><p>t</p></div>", "t"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><object data='a'><p>fallback</p></object></article>", "Let x=2 be\nfallback"),
]


@pytest.mark.parametrize("html,text", KEPT)
def test_article_text_stays(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("box", ["<div class='comments'>", "<div id='comments'>", "<div class='x share-buttons'>", "<ul class='relatedPosts'>", "<section class='newsletter'>", "<aside>", "<div role='search'>"])
def test_boxes_go(box):
    tag = box[1:].split()[0].rstrip(">")
    assert main_text(f"<article><p>t</p>{box}gone</{tag}></article>") == "t"
    assert main_text(f"<div><p>t</p></div>{box}gone</{tag}>") == "t"
