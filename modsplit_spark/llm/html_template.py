"""Main-text extraction by deducing the template of a host's pages from equivalence classes of tokens.

A page is a sequence of tokens: elements (begin and end), told apart by the path of elements and class names they
stand in, and texts, told apart by path and content. Tokens that occur equally often in every page of a host have one
occurrence vector and form an equivalence class. Spark sums, per host and token, the pages it occurs in and a hash of
(page, count); equal sums stand for equal vectors, so no vector is gathered and a host may hold any share of the pages.

Two rounds deduce the template. Each takes the classes that occur in at least ``SUPPORT`` of the host's pages and hold
an element, and then has every page spell each class out: a class is valid if on ``ALIKE`` of its pages its tokens
come as one word, repeated as often as the class occurs, and do not cross another class. Valid classes nest; what stands between two
neighbouring tokens of a class is a slot. The second round names every token anew by the slot it stands in, and tokens that a slot
holds a fixed number of times by their number too, so that a ``div`` of one slot is not the ``div`` of another.

The slots are then read. Words of running text are summed, over all pages of the host, for each template element that occurs once a
page: the deepest that holds ``SHARE`` of the running text of the pages it is on is the main element, with the template's heading that
leads up to it. All that fills it is the page's main text: headings, cells, sentences and lists of links too that the host's pages
share. Only where no element but the body holds the running text do texts that the template repeats on all its pages, and elements
that the host fills with links, go, if they stand before its first or after its last running paragraph.

Hosts of fewer than ``LEAST_PAGES`` pages, and pages that lack their host's main element, have no template: there the article or main element,
or else all but lists of links, is the text. Scripts, menus, headers, footers, side bars, forms and the like are left out by element, role, class
or id on any page.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from functools import lru_cache, partial
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsplit_spark.llm.bytegrams import parts
from modsplit_spark.llm.url_filter import url_host
from modsplit_spark.llm.wordhash import BASES, mix
from modsplit_spark.sources.workspace import materialize

SUPPORT, ALIKE, SHARE = 0.5, 0.9, 0.75
LEAST_PAGES = 3
#: Tokens that a slot holds so often, as often on every page, are told apart by their number.
MOST_NUMBERED = 8
#: Template tokens up to which their table is broadcast; a larger one is joined by shuffle.
BROADCAST_TOKENS = 50_000
#: Shares in which a host's tokens meet its number of pages.
SALTS = 16
PAGE_TOKEN = 0
MAIN = frozenset(("article", "main"))
#: A main element that is the page itself holds the template's boxes too.
WHOLE = frozenset(("html", "body"))
LISTS = frozenset(("li", "ul", "ol", "dl"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|annotation-xml|annotation|xmp)\b[^>]*>(?:.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math menclose mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover object q s samp semantics small span strike strong sub sup time tt u var wbr br ruby rt rp".split())
LEFT_OUT = frozenset("head nav header footer aside form button select menu dialog fieldset option datalist noframes audio video canvas map".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
#: Parts of class and id names that mark what is not the article.
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar aside footer header "
    "masthead cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login share sharing social comment comments disqus respond reply replies "
    "related recommended widget toolbar pagination pager copyright disclaimer skip search form".split()
)
#: What may follow such a part in the name of a box ("share-buttons"); other names ("related-work", "no-sidebar") are no marks.
BOX_NAMES = frozenset("area bar block box button buttons card container content icon icons inner inset item items left line link links list panel post posts right row section slot text thread title unit wrap wrapper".split()) | LEFT_OUT_NAMES
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one block of text, which a main element is not.
BLOCKS = HEADINGS | frozenset("p li dt dd tr td th pre blockquote figure figcaption caption summary address".split())
#: Elements that can be a box by their id, which on any other may be the slug of a title; in the article they alone count.
BOXES = frozenset("div ul ol dl table center".split())
MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?\s*main\b", re.I)
PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _left_out(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in LEFT_OUT:
        return not (tag == "header" and in_main)
    if tag in ("html", "body", "article", "main") or not attrs:
        return False
    names = []
    for name, *values in ATTR.findall(attrs):
        value = unescape("".join(values))
        name = name.lower()
        if name == "role":
            if value.strip().lower() in LEFT_OUT_ROLES:
                return True
        elif tag not in HEADINGS and (tag in BOXES or (name == "class" and not (in_main and tag not in ("section", "figure")))):
            names.append((name, value.split()))
    if any(name == "class" and "section" in values for name, values in names):
        names = [x for x in names if x[0] == "class"]  # the id is the section's slug
    return any(_marks(v) for _, values in names for v in values)


def _marks(name: str) -> bool:
    """Whether one whole name of a class or id tells a box of what is not the article."""
    if name.lower() in LEFT_OUT_NAMES:
        return True
    first, *more = [w for w in PARTS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w] or [""]
    return first in LEFT_OUT_NAMES and all(w in BOX_NAMES or w.isdigit() for w in more)


# ---------------------------------------------------------------- pages as tokens

MASK = (1 << 62) - 1


@lru_cache(1 << 14)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") & MASK


def _join(a: int, b: int) -> int:
    """An even number of 62 bits that stands for the pair."""
    h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & MASK
    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & MASK
    return (h ^ (h >> 31)) & ~1


def _label(tag: str, attrs: str) -> str:
    """An element's tag and class names; names with a digit are taken for generated and do not count."""
    if "class" not in attrs.lower():
        return tag
    names = sorted({n for name, *values in ATTR.findall(attrs) if name.lower() == "class" for n in "".join(values).split() if not any(c.isdigit() for c in n)})
    return ".".join([tag, *names])


class Page(NamedTuple):
    """A page's tokens in order. An element begins with an even number and ends with the next odd one; ``words`` is 0 for
    elements, the number of words of a text, and that number below 0 for a text that is only links. ``texts`` and ``tags`` (of
    elements) stand at the same places; a text has its path of tags there."""

    tokens: list[int]
    words: list[int]
    texts: list[str]
    tags: list[str]


def parse(html: str | None) -> Page:
    """The page's tokens. What is left out by its element is one token. An element of role main has the tag ``main``."""
    page = Page([], [], [], [])
    stack: list[tuple[str, bool, bool, int]] = []  # tag, left out, main, token
    path: list[str] = []
    words: list[str] = []
    plain = False
    links = 0

    def add(token: int, size: int, text: str, tag: str) -> None:
        page.tokens.append(token)
        page.words.append(size)
        page.texts.append(text)
        page.tags.append(tag)

    def flush() -> None:
        nonlocal words, plain
        if words and not (stack and stack[-1][1]):
            held = "".join(words).split()
            if held:
                text = " ".join(held)
                add(_join(stack[-1][3] if stack else 0, _word_hash.__wrapped__(text)), len(held) if plain else -len(held), text, "/".join(path))
        words, plain = [], False

    def close(at: int) -> None:
        for i in range(len(stack) - 1, at - 1, -1):
            if not (i and stack[i - 1][1]):
                add(stack[i][3] | 1, 0, "", path[i])
        del stack[at:], path[at:]

    for m in TOKEN.finditer(html or ""):
        text = m["text"]
        if text is not None:
            if not (stack and stack[-1][1]):
                text = unescape(text)
                words.append(text)
                if not links and not text.isspace():
                    plain = True
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m["close"] else 1
            elif tag == "br":
                words.append(" ")
            continue
        flush()
        if m["close"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if at >= 0:
                close(at)
            continue
        if tag in VOID:
            continue
        links = 0
        if tag in ENDS:
            # A paragraph ends where a block begins; so does an item where the next one does.
            ends = ENDS[tag]
            while stack and stack[-1][0] in ends:
                close(len(stack) - 1)
        _, out, main, parent = stack[-1] if stack else ("", False, False, 1)
        attrs = m["attrs"] or ""
        name = "main" if MAIN_ROLE.search(attrs) else tag
        token = _join(parent, _word_hash(_label(name, attrs)))
        if not out:
            add(token, 0, "", name)
        stack.append((tag, out or _left_out(tag, attrs, main), main or name in MAIN, token))
        path.append(name)
        if attrs.rstrip().endswith("/") and tag not in ("p", "div", "article", "section", "main", "body", "html", "li"):
            close(len(stack) - 1)
    flush()
    close(0)
    return page


#: What a beginning element ends, if it stands innermost.
ENDS = {t: {"p"} for t in "h1 h2 h3 h4 h5 h6 p article section div ul ol footer aside nav header main table form blockquote pre".split()}
ENDS |= {t: {"p", t} for t in ("li", "dt", "dd")} | {t: {"p", t, "td", "th"} for t in ("tr", "td", "th")}


# ---------------------------------------------------------------- classes


def numbered(tokens: list[int], words: list[int], fixed: set[int]) -> list[int]:
    """The tokens, those in ``fixed`` with their number of occurrence; an element ends with what it began with."""
    out, begun, seen = [], [], {}
    for t, w in zip(tokens, words, strict=True):
        if w:
            out.append(t)
        elif t & 1:
            out.append(begun.pop() | 1)
        else:
            if t in fixed:
                seen[t] = seen.get(t, 0) + 1
                t = _join(t, seen[t])
            begun.append(t)
            out.append(t)
    return out


class Class(NamedTuple):
    word: tuple[int, ...]
    once: bool
    pages: int


def nested(tokens: list[int], classes: list[Class]) -> tuple[list[int], set[int]]:
    """For every place of a page the slot it stands in, as a number (0 outside any class), and the classes that
    cross another. ``classes`` come by rank; of two that cross, the later one is dropped."""
    of = {t: k for k, c in enumerate(classes) for t in c.word}
    slots, crossed, stack = [], set(), []  # class, next token of its word, number of its slot
    for t in tokens:
        slots.append(stack[-1][2] if stack else 0)
        k = of.get(t)
        if k is None or k in crossed:
            continue
        word = classes[k].word
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == k), -1)
        if at >= 0 and t == word[stack[at][1]]:
            above = [s[0] for s in stack[at + 1 :]]
            if above and min(above) < k:
                crossed.add(k)
                del stack[at]
                continue
            crossed.update(above)
            del stack[at + 1 :]
            n = stack[at][1] + 1
            if n == len(word):
                del stack[at]
            else:
                stack[at] = (k, n, _join(word[0], _join(word[-1], n)))
        elif at < 0 and t == word[0] and len(word) > 1:
            stack.append((k, 1, _join(word[0], _join(word[-1], 1))))
        else:
            crossed.add(k)
            stack = [s for s in stack if s[0] != k]
    return slots, crossed


def spelled(tokens: list[int], members: list[frozenset[int]]) -> dict[int, tuple[int, ...]]:
    """For each class on the page its word: its tokens in order, of one of its equal occurrences; () if they are not equal."""
    of = {t: k for k, c in enumerate(members) for t in c}
    found: dict[int, list[int]] = {}
    for t in tokens:
        k = of.get(t & ~1)
        if k is not None:
            found.setdefault(k, []).append(t)
    out = {}
    for k, seq in found.items():
        f = seq.count(seq[0])
        n = len(seq) // f
        out[k] = tuple(seq[:n]) if seq == seq[:n] * f else ()
    return out


class Round(NamedTuple):
    """What one round has deduced for a host."""

    fixed: set[int]
    classes: list[Class]


def renamed(page_tokens: list[int], words: list[int], rounds: list[Round]) -> list[int]:
    """A page's tokens as the round after ``rounds`` names them: by the slot of the last round's classes."""
    tokens = page_tokens
    for r in rounds:
        ids = numbered(tokens, words, r.fixed)
        slots, _ = nested(ids, r.classes)
        begun, out = [], []
        for t, w, slot in zip(ids, words, slots, strict=True):
            if w:
                out.append(_join(t, slot))
            elif t & 1:
                out.append(begun.pop() | 1)
            else:
                begun.append(_join(t, slot))
                out.append(begun[-1])
        tokens = out
    return tokens


# ---------------------------------------------------------------- Spark passes

ROUND = "struct<fixed:array<long>,classes:array<struct<word:array<long>,once:boolean,pages:long>>>"


def _rounds(held) -> list[Round]:
    return [Round(set(r["fixed"]), [Class(tuple(c["word"]), c["once"], c["pages"]) for c in r["classes"]]) for r in held or ()]


def _by_host(batch, column: int, made: dict, make):
    """The templates of a batch's rows, each made once."""
    for host, held in zip(batch.column("host").to_pylist(), batch.column(column), strict=True):
        if host not in made:
            if len(made) > 2000:
                made.clear()
            made[host] = make(held.as_py())
        yield made[host]


def _tokenized(batches):
    for batch in parts(batches):
        pages = [parse(h) for h in batch.column(2).to_pylist()]
        columns = [_list_column([p.tokens for p in pages], np.int64), _list_column([p.words for p in pages], np.int32), _list_column([_boxes(p) for p in pages], np.int8)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "host", "tokens", "words", "boxes"])


def _boxes(page: Page) -> list[int]:
    """For every token 1 if it begins an element that may be a main element, 2 if a heading, else 0."""
    return [0 if w or t & 1 else 2 if tag in HEADINGS else int(tag not in BLOCKS) for t, w, tag in zip(page.tokens, page.words, page.tags, strict=True)]


class _Sums:
    """Rows of a key and long sums, merged within a task."""

    def __init__(self, keys: list[tuple[str, pa.DataType]], values: list[str]):
        self.keys, self.values, self.held = keys, values, defaultdict(lambda: [0] * len(values))

    def rows(self):
        keys, values = list(self.held), list(self.held.values())
        self.held.clear()
        columns = [pa.array([k[i] for k in keys], kind) for i, (_, kind) in enumerate(self.keys)] + [pa.array([v[i] for v in values], pa.int64()) for i in range(len(self.values))]
        return pa.RecordBatch.from_arrays(columns, [*(n for n, _ in self.keys), *self.values])


def _lists(column) -> list[list[int]]:
    """The lists of an Arrow column of lists of numbers without nulls."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    return [flat[i:j] for i, j in zip(at, at[1:], strict=False)]


def _sizes(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int64, len(lists))


def _list_column(lists: list[list[int]], kind) -> pa.Array:
    """As ``pa.array``, by way of one flat array."""
    flat = np.fromiter((x for held in lists for x in held), kind, int(_sizes(lists).sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(_sizes(lists))]), pa.int32()), pa.array(flat))


def _spread(row: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two numbers of 31 bits that stand for each pair."""
    h = mix(row.astype(np.uint64) * np.uint64(BASES[0]) + n.astype(np.uint64))
    return [(h >> np.uint64(33)).astype(np.int64), (h & np.uint64((1 << 31) - 1)).astype(np.int64)]


#: What is summed for a host and token. Two sums of 31-bit numbers stand for a vector.
SUMS = ["pages", "vector1", "vector2", "ones1", "ones2", "count", "squares", "texts"]


def _vectors(batches, rounds: int):
    """For each host and token the pages it occurs in, sums that stand for its occurrence vector and for one of ones, sums of its counts
    and their squares, and on how many pages it is a text."""
    held, made, rows = [], {}, 0

    def merged():
        host, token = (np.concatenate([h[i] for h in held]) for i in range(2))
        sums = np.concatenate([h[2] for h in held])
        held.clear()
        hosts, code = np.unique(host, return_inverse=True)
        order = np.lexsort((token, code))
        code, token = code[order], token[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (token[1:] != token[:-1])]))
        return hosts[code[first]], token[first], np.add.reduceat(sums[order], first)

    def batch_of(host, token, sums):
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(token), *(pa.array(sums[:, i]) for i in range(len(SUMS)))], ["host", "token", *SUMS])

    for batch in parts(batches):
        words = batch.column("words")
        if rounds:
            lists = [renamed(t, w, r) for t, w, r in zip(_lists(batch.column("tokens")), _lists(words), _by_host(batch, batch.num_columns - 1, made, _rounds), strict=True)]
            size, flat = _sizes(lists), np.fromiter((x for held_ in lists for x in held_), np.int64)
        else:
            size, flat = np.diff(words.offsets.to_numpy()), batch.column("tokens").flatten().to_numpy()
        text = words.flatten().to_numpy() != 0
        page = np.repeat(np.arange(batch.num_rows), size)
        begins = (flat & 1) == 0
        # A token of each page that counts the page.
        page = np.concatenate([page[begins], np.arange(batch.num_rows)])
        token, text = np.concatenate([flat[begins], np.full(batch.num_rows, PAGE_TOKEN)]), np.concatenate([text[begins], np.zeros(batch.num_rows, bool)])
        order = np.lexsort((token, page))
        page, token, text = page[order], token[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (token[1:] != token[:-1])])) if len(page) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(page)))
        row = batch.column("row").to_numpy()[page[first]]
        hosts = np.array(batch.column("host").to_pylist(), object)[page[first]]
        held.append((hosts, token[first], np.stack([np.ones_like(n), *_spread(row, n), *_spread(row, np.ones_like(n)), n, n * n, text[first].astype(np.int64)], axis=1)))
        rows += len(first)
        if rows > 200_000:
            held.append(merged())
            rows = len(held[-1][0])
            if rows > 100_000:
                yield batch_of(*held.pop())
                rows = 0
    if held:
        yield batch_of(*merged())


def _words(batches):
    """For each host and class its words, and how many pages spell it so; a class that crosses another spells ()."""
    sums, made = _Sums([("host", pa.string()), ("class", pa.int32()), ("word", pa.list_(pa.int64()))], ["seen"]), {}

    def candidates(held):
        members = [frozenset(_join(t["token"], k) if k else t["token"] for t in c["tokens"] for k in range(min(1, t["n"]), t["n"] + 1)) for c in held["classes"]]
        return _rounds(held["rounds"]), set(held["fixed"]), members

    for batch in parts(batches):
        rows = zip(batch.column("host").to_pylist(), _lists(batch.column("tokens")), _lists(batch.column("words")), _by_host(batch, batch.num_columns - 1, made, candidates), strict=True)
        for host, tokens, words, (rounds_, fixed, members) in rows:
            ids = numbered(renamed(tokens, words, rounds_), words, fixed)
            found = spelled(ids, members)
            shown = sorted(k for k, w in found.items() if w)
            _, crossed = nested(ids, [Class(found[k], False, 0) for k in shown])
            bad = {shown[i] for i in crossed}
            for k, word in found.items():
                sums.held[host, k, () if k in bad else word][0] += 1
        if len(sums.held) > 50_000:
            yield sums.rows()
    if sums.held:
        yield sums.rows()


class Template(NamedTuple):
    """A host's template: what names its tokens, elements that occur once a page, texts of its own, elements filled with
    links, and the main elements from the outermost on."""

    before: list[Round]
    fixed: set[int]
    once: set[int]
    own: set[int]
    links: set[int] = set()
    mains: tuple[int, ...] = ()


def _template(rounds: list[Round], links=(), mains=(), keep_own: bool = False) -> Template:
    """The template of the last round's classes. Its own are texts of a class that holds an element and is on all pages."""
    classes = [c for c in rounds[-1].classes if c.once]
    top = max((c.pages for c in classes), default=0)
    begun = {t for c in classes for t in c.word if t | 1 in c.word or t & 1}
    own = set() if keep_own else {t for c in classes if c.pages >= ALIKE * top for t in c.word if t not in begun}
    return Template(rounds[:-1], rounds[-1].fixed, begun, own, set(links), tuple(mains))


def _named(tokens: list[int], words: list[int], template: Template) -> list[int]:
    return numbered(renamed(tokens, words, template.before), words, template.fixed)


def _fills(batches):
    """For each host and template element that occurs once a page: words of running text, of links and of the template's own
    texts in it, words of running and own text on its pages, its depth, its pages, and whether it is a box or a heading."""
    sums, made = _Sums([("host", pa.string()), ("element", pa.int64())], ["running", "links", "own", "all_running", "all_own", "depth", "pages", "box"]), {}
    for batch in parts(batches):
        columns = [batch.column("host").to_pylist(), *(_lists(batch.column(c)) for c in ("tokens", "words", "boxes"))]
        for host, tokens, words, boxes, template in zip(*columns, _by_host(batch, batch.num_columns - 1, made, lambda held: _template(_rounds(held))), strict=True):
            open_, here, whole = [], {}, [0, 0, 0]
            for t, w, box in zip(_named(tokens, words, template), words, boxes, strict=True):
                if w:
                    at = 2 if t in template.own else 0 if w > 0 else 1
                    whole[at] += abs(w)
                    for e in open_:
                        here[e][at] += abs(w)
                elif t in template.once:
                    if t & 1:
                        open_.pop()
                    else:
                        open_.append(t)
                        here[t] = [0, 0, 0, len(open_), box]
            for e, (running, links, own, depth, box) in here.items():
                held = sums.held[host, e]
                for i, v in enumerate((running, links, own, whole[0], whole[2], depth, 1, box)):
                    held[i] += v
        if len(sums.held) > 100_000:
            yield sums.rows()
    if sums.held:
        yield sums.rows()


def _with_template(rows: DataFrame, templates: DataFrame, size: int) -> DataFrame:
    """``rows`` with their host's template; hosts without one drop out. A table of ``size`` numbers is broadcast up to the bound."""
    return rows.join(F.broadcast(templates) if size <= BROADCAST_TOKENS else templates.hint("shuffle_merge"), "host")


def _deduced(pages: DataFrame, totals: DataFrame, rounds: DataFrame | None, size: int) -> tuple[DataFrame, int]:
    """One round: ``(host, rounds)`` with what it adds, and how many numbers they hold. ``pages`` has row, host, tokens and words."""
    n = 0 if rounds is None else 1
    source = pages.select("row", "host", "tokens", "words")
    if rounds is not None:
        source = _with_template(source, rounds, size)
    found = source.mapInArrow(partial(_vectors, rounds=n), "host string, token long, " + ", ".join(f"{c} long" for c in SUMS))
    tokens = found.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in SUMS)).where((F.col("pages") >= LEAST_PAGES) & (F.col("token") != PAGE_TOKEN))
    dealt = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    frequent = tokens.withColumn("salt", F.pmod(F.xxhash64("token"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"]).where(F.col("pages") >= SUPPORT * F.col("total"))
    each = F.col("count") / F.col("pages")
    is_fixed = (F.col("texts") == 0) & (F.col("squares") * F.col("pages") == F.col("count") * F.col("count")) & each.between(2, MOST_NUMBERED)
    frequent = frequent.withColumn("n", F.when(is_fixed, each.cast("int")).otherwise(0)).withColumn("once", (F.col("n") > 0) | (F.col("count") == F.col("pages")))
    # A class is its tokens of one vector. Classes without an element are no template.
    classes = frequent.groupBy("host", "pages", "once", *(F.when(F.col("n") > 0, F.col(f"ones{i}")).otherwise(F.col(f"vector{i}")).alias(f"key{i}") for i in (1, 2))).agg(
        F.array_sort(F.collect_list(F.struct("token", "n"))).alias("tokens"), F.min("texts").alias("least")
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("rank"), (-F.size("tokens")).alias("size"), "tokens", "once", "pages")))
    hosts = classes.where("least = 0").groupBy("host").agg(ranked.alias("classes"))
    fixed = F.transform(F.filter(F.flatten(F.transform("classes", lambda c: c["tokens"])), lambda t: t["n"] > 0), lambda t: t["token"])
    held = "rounds" if rounds is not None else F.lit(None).cast(f"array<{ROUND}>").alias("rounds")
    hosts = (hosts if rounds is None else hosts.join(rounds, "host")).select("host", held, fixed.alias("fixed"), F.transform("classes", lambda c: F.struct(c["tokens"].alias("tokens"), c["once"].alias("once"), c["pages"].alias("pages"))).alias("classes"))
    hosts = materialize(hosts, "classes")
    numbers = hosts.agg(F.sum(F.size("fixed") + 4 * F.aggregate("classes", F.lit(0), lambda a, c: a + F.size(c["tokens"])))).first()[0] or 0
    size += numbers
    spelt = _with_template(pages.select("host", "tokens", "words"), hosts.select("host", F.struct("rounds", "fixed", "classes").alias("candidates")), size).mapInArrow(_words, "host string, class int, word array<long>, seen long")
    words = spelt.groupBy("host", "class", "word").agg(F.sum("seen").alias("seen")).groupBy("host", "class").agg(F.max_by("word", F.struct("seen", "word")).alias("word"), F.max("seen").alias("most"), F.sum("seen").alias("seen"))
    valid = words.where((F.size("word") > 1) & (F.col("most") >= ALIKE * F.col("seen")))
    valid = valid.join(hosts.select("host", F.posexplode("classes").alias("class", "c")), ["host", "class"]).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("class", "word", F.col("c.once").alias("once"), F.col("c.pages").alias("pages")))).alias("valid"))
    new = F.struct(F.col("fixed"), F.transform("valid", lambda c: F.struct(c["word"].alias("word"), c["once"].alias("once"), c["pages"].alias("pages"))).alias("classes"))
    done = hosts.join(valid, "host").select("host", F.concat(F.coalesce("rounds", F.array().cast(f"array<{ROUND}>")), F.array(new)).alias("rounds"))
    return materialize(done, "rounds"), size


def page_tokens(pages: DataFrame) -> DataFrame:
    """``(row, host, tokens, words, boxes)`` of every page, written once. ``pages`` has host and html."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "host", "html")
    return materialize(rows.mapInArrow(_tokenized, "row long, host string, tokens array<long>, words array<int>, boxes array<byte>"), "page-tokens")


def host_templates(pages: DataFrame, rounds: int = 2) -> tuple[DataFrame, int]:
    """``(host, rounds, links, mains, keep_own)`` for every host that has a template, and how many numbers the table holds. ``pages`` is
    what ``page_tokens`` gives."""
    totals = pages.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= LEAST_PAGES)
    deduced, size = None, 0
    for _ in range(rounds):
        deduced, size = _deduced(pages, totals, deduced, size)
    sums = ["running", "links", "own", "all_running", "all_own", "depth", "pages", "box"]
    fills = _with_template(pages.select("host", "tokens", "words", "boxes"), deduced, size).mapInArrow(_fills, "host string, element long, " + ", ".join(f"{c} long" for c in sums))
    elements = fills.groupBy("host", "element").agg(*(F.sum(c).alias(c) for c in sums))
    # Where all text is the template's own (one page over and over), it is what is read.
    bare = F.col("all_running") == 0
    has, of = F.when(bare, F.col("own")).otherwise(F.col("running")), F.when(bare, F.col("all_own")).otherwise(F.col("all_running"))
    main = (F.col("box") == F.col("pages")) & (has > 0) & (has >= SHARE * of)
    links = (F.col("box") == F.col("pages")) & (F.col("links") > F.col("running") + F.col("own"))
    chosen = elements.groupBy("host").agg(
        F.array_sort(F.collect_list(F.when(main, F.struct((F.col("depth") / F.col("pages")).alias("depth"), "element")))).alias("mains"), F.collect_list(F.when(links, F.col("element"))).alias("links"), F.min(bare).alias("keep_own")
    )
    chosen = chosen.select("host", "links", F.transform("mains", lambda m: m["element"]).alias("mains"), "keep_own").where(F.size("mains") > 0)
    return materialize(deduced.join(chosen, "host"), "templates"), size


# ---------------------------------------------------------------- reading the slots


def _in_main(path: str) -> bool:
    return not MAIN.isdisjoint(path.split("/"))


def _by_tags(page: Page) -> list[str]:
    """The texts of the article or main element; without one all but the items of lists that are links."""
    texts = [(text, path, w) for text, path, w in zip(page.texts, page.tags, page.words, strict=True) if w]
    chosen = [text for text, path, _ in texts if _in_main(path)]
    return chosen or [text for text, path, w in texts if w > 0 or LISTS.isdisjoint(path.split("/"))]


def _by_template(page: Page, template: Template) -> list[str] | None:
    """The texts of the main element's slots; None if the page lacks it."""
    ids = _named(page.tokens, page.words, template)
    here = {t: i for i, t in enumerate(ids) if t in template.once}
    main = next((m for m in reversed(template.mains) if m in here), None)
    if main is None:
        return None
    begin, end = here[main], here[main | 1]
    around = {t for t, i in here.items() if not t & 1 and i <= begin and here[t | 1] >= end}
    out, inside, stack = [], [], []
    for i, (t, w) in enumerate(zip(ids, page.words, strict=True)):
        if not w:
            if t in template.once:
                stack.pop() if t & 1 else stack.append((t, page.tags[i]))
            continue
        weak = t in template.own or any(e in template.links for e, _ in stack if e not in around)
        if begin < i < end:
            inside.append((page.texts[i], weak, page.tags[i].rpartition("/")[2] in HEADINGS))
        elif i < begin and not weak and len(stack) > 1 and stack[-1][1] in ("h1", "h2") and stack[-2][0] in around:
            out.append(page.texts[i])
    first, last = 0, len(inside)
    if page.tags[begin] in WHOLE:
        running = [k for k, (_, weak, heading) in enumerate(inside) if not weak and not heading]
        first, last = (running[0], running[-1]) if running else (last, last)
    return out + [text for k, (text, weak, _) in enumerate(inside) if not weak or first <= k <= last]


def main_text(html: str | None, template: Template | None = None) -> str:
    """The main text of a page, one line for each block, by its host's template or, without one, by its elements alone."""
    page = parse(html)
    found = _by_template(page, template) if template else None
    return "\n".join(_by_tags(page) if found is None else found)


def _extracted(batches):
    made = {}

    def template(held):
        return held and _template(_rounds(held["rounds"]), held["links"], held["mains"], held["keep_own"])

    for batch in parts(batches):
        texts = [main_text(h, t) for h, t in zip(batch.column("html").to_pylist(), _by_host(batch, batch.num_columns - 1, made, template), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page, from its whole html.

    Null html is empty and gives the empty text; a null url belongs to the host ''. Repeated rows stay repeated and count
    as often for the template. An empty table gives no row; other columns are not read. A very long page is one row of one task; a
    host's template holds at most the tokens that half of its pages share, so twice those of a page on average. Within a
    block, white space (line breaks by ``br`` and no-break spaces too) becomes one blank."""
    keyed = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), url_host(F.col("url")).alias("host"))
    templates, size = host_templates(page_tokens(keyed))
    templates = templates.select("host", F.struct("rounds", "links", "mains", "keep_own").alias("template"))
    joined = keyed.join(F.broadcast(templates) if size <= BROADCAST_TOKENS else templates.hint("shuffle_merge"), "host", "left").select("page_id", "url", "html", "host", "template")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(_extracted, schema)
