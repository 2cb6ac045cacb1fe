"""Planted hosts without article elements: classes of equal vectors decide what is template."""

import random
from collections import Counter

import pytest

from modsplit_spark.llm import html_template as H


def _texts(spark, rows):
    return {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_on_a_host_without_articles(spark):
    page = lambda inner: f"<html><body><div><p>Same line</p></div><div id='content'>{inner}</div></body></html>"
    copy = page("<h1>Title</h1><p>Copied one</p><p>Copied two</p>")
    rows = [(i, "http://h.net/", copy) for i in range(6)] + [(10 + i, "http://h.net/", page(f"<h1>T{i}</h1><p>Own {i}</p>")) for i in range(4)]
    got = _texts(spark, rows)
    assert got == {**dict.fromkeys(range(6), "Title\nCopied one\nCopied two"), **{10 + i: f"T{i}\nOwn {i}" for i in range(4)}}


def test_paragraph_of_one_link_stays(spark):
    page = lambda i: f"<html><body><ul><li><a href='/'>Home</a></li><li><a href='/{i}'>Next {i}</a></li></ul><p><a href='/all'>All</a></p><p><a href='/s'>Source {i}</a></p><p>Own {i}</p></body></html>"
    got = _texts(spark, [(i, "http://h.net/", page(i)) for i in range(5)])
    assert got == {i: f"Source {i}\nOwn {i}" for i in range(5)}


def _neutral(rng, i):
    """A page without article or main element; its class names say nothing, and its boxes have no place of their own but their order."""
    words = lambda n: " ".join(rng.choice(["stone", "river", "cloud", "amber", "field"]) + str(rng.randrange(999)) for _ in range(n))
    links = "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(rng.randrange(3, 7)))
    paragraphs = [words(rng.randrange(12, 40)) for _ in range(rng.randrange(2, 6))]
    title, rest = words(5), words(6)
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    html = f"<html><body><div class='c1'><ul>{links}</ul></div><div class='c{i + 10}'>{rest}</div><div class='c3'><h1>{title}</h1><div>{body}</div><div><a href='/s'>Send</a> <a href='/p'>Print</a></div></div><div class='c4'>All rights {words(2)}</div></body></html>"
    return html, "\n".join([title, *paragraphs])


def test_neutral_hosts_are_read_by_their_template(spark):
    rng = random.Random(11)
    pages = [(h * 100 + i, f"http://h{h}.net/{i}", *_neutral(rng, i)) for h in range(3) for i in range(20)]
    got = _texts(spark, [p[:3] for p in pages])
    assert got == {p[0]: p[3] for p in pages}
    # Without the template the other boxes come along.
    assert all(H.main_text(p[2]) != p[3] for p in pages)


REST = {
    "heading": ("<h2>Methods</h2><p>How it was done {i}</p>", "Methods\nHow it was done {i}"),
    "cell": ("<table><tr><th>Year</th><td>{i}</td></tr></table>", "Year\n{i}"),
    "sentence": ("<p>All measurements were taken in May.</p>", "All measurements were taken in May."),
    "references": ("<ul><li><a href='/a'>Stone and others</a></li><li><a href='/{i}'>River {i}</a></li></ul>", "Stone and others\nRiver {i}"),
    "appendix": ("<div><p><a href='/x'>See the appendix</a></p></div>", "See the appendix"),
}


@pytest.mark.parametrize("outer", ["article", "main", "div class='c3'"])
def test_the_article_is_read_whole(spark, outer):
    """What the articles of a host share is theirs: a heading, a cell, a sentence, references, one linked line; first, last or between."""
    tag, rows, want = outer.split()[0], [], {}
    for h, (name, (html, text)) in enumerate([*REST.items(), ("all", ("".join(x for x, _ in REST.values()), "\n".join(t for _, t in REST.values())))]):
        for i in range(6):
            for k, order in enumerate(("T{r}", "{r}T", "T{r}T")):
                running = f"<p>Own text of {name} {i} with some words of running text {i * i} to read {i}</p>"
                inner = order.replace("T", running).replace("{r}", html.replace("{i}", str(i)))
                lines = order.replace("T", f"\nOwn text of {name} {i} with some words of running text {i * i} to read {i}\n").replace("{r}", "\n" + text.replace("{i}", str(i)) + "\n")
                n = h * 100 + i * 3 + k
                rows.append((n, f"http://h{h}-{k}.net/{i}", f"<html><body><nav>Menu</nav><div><a href='/'>Home</a></div><{outer}><h1>Title {i}</h1><p>Every article begins so.</p>{inner}</{tag}><footer>f</footer></body></html>"))
                want[n] = "\n".join([f"Title {i}", "Every article begins so.", *filter(None, lines.split("\n"))])
    assert _texts(spark, rows) == want


def test_only_edges_of_a_bare_body_go(spark):
    page = lambda i: f"<html><body><h1>T{i}</h1><ul><li><a href='/'>Home</a></li><li><a href='/{i}'>Next {i}</a></li></ul><p>Own {i}</p><h2>Same head</h2><p>Same line</p><p>Later {i}</p><p>All rights kept</p></body></html>"
    assert _texts(spark, [(i, "http://h.net/", page(i)) for i in range(5)]) == {i: f"T{i}\nOwn {i}\nSame head\nSame line\nLater {i}" for i in range(5)}


def _plain_classes(pages, support=H.SUPPORT):
    """Classes of a host's pages by whole occurrence vectors: sets of tokens (element begins and texts) and their words."""
    counts = [Counter(t for t in p if not t & 1) for p in pages]
    found = {}
    for t in {t for c in counts for t in c}:
        vector = tuple(c[t] for c in counts)
        on = sum(n > 0 for n in vector)
        if on >= H.LEAST_PAGES and on >= support * len(pages):
            found.setdefault(vector, set()).add(t)
    return found


def test_classes_match_whole_vectors(spark):
    rng = random.Random(5)
    tags = ["div", "section", "p", "ul", "blockquote", "table"]

    def branch(depth):
        return "".join(f"<{t}>{branch(depth - 1) if depth and rng.random() < 0.6 else rng.choice(['One', 'Two', f'x{rng.randrange(9999)}'])}</{t}>" for t in rng.sample(tags, rng.randrange(1, 4)))

    hosts = {f"h{h}.net": [f"<html><body><div>{branch(2)}</div><p>Own {i}</p>{branch(1)}</body></html>" for i in range(20)] for h in range(4)}
    rows = [(host, html) for host, pages in hosts.items() for html in pages]
    tokens = H.page_tokens(spark.createDataFrame(rows, "host string, html string"))
    totals = tokens.groupBy("host").count().withColumnRenamed("count", "total")
    one, size = H._deduced(tokens, totals, None, 0)
    held = {r["host"]: H._rounds(r["rounds"])[0] for r in one.collect()}
    for host, pages in hosts.items():
        parsed = [H.parse(html) for html in pages]
        texts = {t for p in parsed for t, w in zip(p.tokens, p.words, strict=True) if w}
        fixed = held[host].fixed
        ids = [H.numbered(p.tokens, p.words, fixed) for p in parsed]
        constant = {t for v, c in _plain_classes([p.tokens for p in parsed]).items() for t in c - texts if len(set(v) - {0}) == 1 and 2 <= max(v) <= H.MOST_NUMBERED}
        assert fixed == constant
        classes = [frozenset(c) for c in _plain_classes(ids).values() if c - texts]
        for c in held[host].classes:
            begun = frozenset(t for t in c.word if not t & 1)
            assert begun in classes
            spelt = [H.spelled(p, [begun]).get(0) for p in ids]
            assert spelt.count(c.word) >= H.ALIKE * sum(s is not None for s in spelt) and c.pages == sum(s is not None for s in spelt)
        # Every class left out comes in no one order, or crosses another.
        for c in classes:
            if c not in [frozenset(t for t in k.word if not t & 1) for k in held[host].classes]:
                spelt = [s for s in (H.spelled(p, [c]).get(0) for p in ids) if s is not None]
                word, n = Counter(spelt).most_common(1)[0]
                ranked = [k.word for k in held[host].classes]
                crosses = sum(bool(H.nested(p, [*(H.Class(w, False, 0) for w in ranked), H.Class(word, False, 0)])[1]) for p in ids) if word else 0
                assert not word or n < H.ALIKE * len(spelt) or crosses > 0.05 * len(spelt)


def test_crossing_classes():
    # Elements 2 and 6 begin and end around one another's parts: the class of lesser rank is dropped.
    a, b = H.Class((2, 3, 4, 5), False, 9), H.Class((6, 7, 8, 9), False, 9)
    slots, crossed = H.nested([2, 3, 6, 7, 4, 5, 8, 9], [a, b])
    assert crossed == {1} and slots[0] == 0 and len(set(slots[1:])) >= 3
    assert H.nested([2, 3, 6, 7, 8, 9, 4, 5], [a, b])[1] == set()
