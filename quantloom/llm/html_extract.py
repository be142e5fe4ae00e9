"""Main text of HTML pages by a tree-structured graphical model.

Every element is a binary variable: on the way to content, or not. Unary potentials come from the element's
tag, the words of its class, id and role, its text and its links; pairwise ones connect parent and child, by
the kind of child. Sum-product messages, upward and then downward, give each element's exact marginal; text
is kept where its element's is at least a half. The weights maximise the likelihood of labelled pages, which
labelled_page() makes, by gradients from the same messages. Pages of a batch are one forest.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg math select button noscript object audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: what a start tag closes, and what bounds the search for it
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
TAGS = (
    "html body main article section div header nav footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dd dt blockquote pre "
    "table tr td th figure figcaption a b i em strong span code sup sub label menu center other"
).split()
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = {t: i for i, t in enumerate(TAGS)}
_ALIAS = {"tbody": "table", "thead": "table", "tfoot": "table", "address": "footer", "hgroup": "div", "search": "form", "fieldset": "form", "dir": "ul"}
_SECTIONS = frozenset("html body main article section div header nav footer aside form ul ol dl table menu center".split())
#: words of class, id and role, by what they speak of
HINTS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc pager pagination tabs skip",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer foot copyright contentinfo colophon legal",
    "side": "sidebar side aside rail widget widgets complementary related recommended trending popular more",
    "notice": "notice cookie cookies consent alert gdpr popup modal overlay message toast disclaimer warning",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense",
    "form": "form login signup subscribe subscription newsletter search contact",
    "comment": "comment comments reply replies discussion disqus respond feedback reviews",
    "share": "share sharing social follow like tags byline author meta date",
    "body": "article content post entry body story text main maincontent page articlebody prose",
}
_HINT = {w: i for i, k in enumerate(HINTS) for w in HINTS[k].split()}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|data-keep)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TOKEN = re.compile(
    r"""<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<!\[CDATA\[(?s:.*?)\]\]>|<[!?/][^>]*+>"""
)
N_REAL = 8
WIDTH = len(TAGS) + len(HINTS) + 1 + N_REAL
KINDS = 9  # of pairs: child a section, other block or inline; parent of content's names, of another's, or of neither
_CONTENT = frozenset({_TAG["article"], _TAG["main"], len(TAGS) + _HINT["article"]})
_OTHER = frozenset({_TAG[t] for t in ("nav", "header", "footer", "aside", "form", "menu")} | {len(TAGS) + i for i, k in enumerate(HINTS) if k != "body"})


@lru_cache(100_000)
def _static(tag: str, attributes: str) -> tuple[tuple[int, ...], int, int | None]:
    """The features that an element's tag and attributes set, its kind, and its label if it has one."""
    tag = _ALIAS.get(tag, tag)
    on, label = [_TAG.get(tag, _TAG["other"])], None
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        if name.lower() == "data-keep":
            label = int(value == "1")
            continue
        on += [len(TAGS) + _HINT[w.lower()] for w in _WORD.findall(value) if w.lower() in _HINT]
    return tuple(set(on)), 0 if tag in _SECTIONS else 1 if tag in BLOCK else 2, label


class Page:
    """The elements of a page, in page order, and its text: (element, block, characters)."""

    __slots__ = ("features", "kinds", "labels", "links", "parents", "pieces")

    def __init__(self, source: str):
        self.parents, self.features, self.kinds, self.labels, self.links, self.pieces = [-1], [(_TAG["html"],)], [0], [None], [False], []
        names, stack, sides, block, at = ["html"], [0], [0], 0, 0
        lower, missing = None, set()
        # where open elements of a name, and blocks, lie in the stack, so that no tag looks through a deep one
        places: dict[str, list[int]] = {}
        blocks: list[int] = []

        def topmost(names_) -> int:
            return max((places[x][-1] for x in names_ if places.get(x)), default=0)

        def pop_to(depth: int):
            nonlocal block
            if blocks and blocks[-1] >= depth:
                block += 1
            for e in reversed(stack[depth:]):
                places[names[e]].pop()
                if names[e] in BLOCK:
                    blocks.pop()
            del stack[depth:]

        for m in _TOKEN.finditer(source):
            start = m.start()
            if start < at:
                continue
            if start > at:
                self.pieces.append((stack[-1], block, source[at:start]))
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self.pieces.append((stack[-1], block, m[0][9:-3].replace("&", "&amp;")))
                continue
            name = name.lower()
            if m[1]:
                if name == "p" and not places.get("p"):
                    block += 1
                depth = topmost((name,))
                # the end tag of an inline element does not reach beyond the block around it
                if depth and (name in BLOCK or not blocks or depth > blocks[-1]):
                    pop_to(depth)
                continue
            if name in RAW and not m[3].endswith("/"):
                if name not in missing:
                    lower = source.lower() if lower is None or len(lower) != len(source) else lower
                    end = lower.find(f"</{name}", at) if len(lower) == len(source) else -1
                    if len(lower) != len(source):
                        found = re.compile(f"</{name}", re.I).search(source, at)
                        end = found.start() if found else -1
                    if end < 0:
                        missing.add(name)
                        if name in ("script", "style", "textarea", "xmp", "template"):
                            at = len(source)  # as browsers do: all that follows is its text
                    else:
                        close = source.find(">", end)
                        at = len(source) if close < 0 else close + 1
                if name in BLOCK:
                    block += 1
                continue
            if name == "br":
                self.pieces.append((stack[-1], block, " "))
                continue
            if name in VOID:
                block += name == "hr"
                continue
            if name in ("html", "head") or name == "body" and places.get("body"):
                continue
            if name in BLOCK:
                block += 1
                closed, bound = CLOSES.get(name, ((), ()))
                targets = {"p", *closed, *(HEADINGS if name in HEADINGS else ())}
                while depth := topmost(targets):
                    if depth < (topmost(bound) if closed else blocks[-1]):
                        break
                    inside = names[stack[depth]]
                    pop_to(depth)
                    if inside in closed or not closed:
                        break
            on, kind, label = _static(name, m[3])
            self.parents.append(stack[-1])
            self.features.append(on)
            self.kinds.append(kind + 3 * sides[stack[-1]])
            sides.append(2 if not _OTHER.isdisjoint(on) else 1 if not _CONTENT.isdisjoint(on) else 0)
            self.labels.append(label)
            self.links.append(name == "a" or self.links[stack[-1]])
            names.append(name)
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append(len(names) - 1)
        if at < len(source):
            rest = source[at:]
            # a tag that the page's end cuts off is no text
            self.pieces.append((stack[-1], block, re.sub(r"<[a-zA-Z/!][^<]*\Z", "", rest)))

    def text(self, keep) -> str:
        blocks: dict[int, list[str]] = {}
        for element, block, text in self.pieces:
            if keep[element]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(entities.unescape("".join(x)).split()) for x in blocks.values())
        return "\n".join(x for x in lines if x)


class Forest:
    """Features, parents and depths of the elements of many pages."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parents) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.n = n = int(self.first[-1])
        self.parent = np.concatenate([np.array(p.parents) for p in pages]) if pages else np.zeros(0, int)
        root = self.parent < 0
        self.parent = np.where(root, -1, self.parent + np.repeat(self.first[:-1], sizes))
        self.kind = np.fromiter((k for p in pages for k in p.kinds), np.int64, n)
        self.depth = np.zeros(n, np.int64)
        level, self.levels = np.flatnonzero(root), []
        children = np.argsort(self.parent, kind="stable")
        starts = np.searchsorted(self.parent[children], np.arange(n), "left")
        ends = np.searchsorted(self.parent[children], np.arange(n), "right")
        while len(level):
            self.levels.append(level)
            counts = ends[level] - starts[level]
            level = children[np.repeat(starts[level], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        chars, link, stops, words = (np.zeros(n) for _ in range(4))
        for p, first in zip(pages, self.first.tolist()):
            for element, _, text in p.pieces:
                m = len(text)
                if m > 1 or not text.isspace():
                    element_at = first + element
                    chars[element_at] += m
                    words[element_at] += text.count(" ") + 1
                    stops[element_at] += text.count(".") + text.count(",")
                    if p.links[element]:
                        link[element_at] += m
        own = chars.copy()
        for level in reversed(self.levels[1:]):
            for x in (chars, link, stops, words):
                np.add.at(x, self.parent[level], x[level])
        page = np.repeat(chars[self.first[:-1]], sizes) if pages else chars
        rows = np.repeat(np.arange(n), np.fromiter((len(f) for p in pages for f in p.features), np.int64, n))
        columns = np.fromiter((c for p in pages for f in p.features for c in f), np.int64, len(rows))
        self.x = np.zeros((n, WIDTH))
        self.x[rows, columns] = 1
        at = len(TAGS) + len(HINTS)
        self.x[:, at] = 1
        safe = np.maximum(chars, 1)
        self.x[:, at + 1 :] = np.column_stack(
            [link / safe, link > 0.6 * safe, np.minimum(stops / np.maximum(words, 1), 1), np.log1p(chars) / 10, np.log1p(own) / 10, chars / np.maximum(page, 1), words < 6, chars == 0]
        )


def marginals(forest: Forest, unary: np.ndarray, pair: np.ndarray):
    """Each element's probability of state 1, each child's joint with its parent (n, 2, 2), and log Z."""
    n, parent, kind = forest.n, forest.parent, forest.kind
    up = np.column_stack([np.zeros(n), unary])
    to_parent, down = np.zeros((n, 2)), np.zeros((n, 2))
    for level in reversed(forest.levels[1:]):  # upward
        m = np.logaddexp(pair[kind[level], :, 0] + up[level, :1], pair[kind[level], :, 1] + up[level, 1:])
        to_parent[level] = m
        np.add.at(up, parent[level], m)
    for level in forest.levels[1:]:  # downward: all that the parent knows, but from this child
        rest = up[parent[level]] + down[parent[level]] - to_parent[level]
        p = pair[kind[level]] + rest[:, :, None]
        m = np.logaddexp(p[:, 0], p[:, 1])
        down[level] = m - m.max(axis=1, keepdims=True)
    belief = up + down
    one = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    inner = np.flatnonzero(parent >= 0)
    joint = pair[kind[inner]] + (up[parent[inner]] + down[parent[inner]] - to_parent[inner])[:, :, None] + up[inner][:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    roots = forest.first[:-1]
    return one, inner, joint, float(np.logaddexp(up[roots, 0], up[roots, 1]).sum())


def train(pages: list[str], steps: int = 250, rate: float = 0.15, decay: float = 2e-3):
    """(weights, pair potentials) that maximise the likelihood of pages whose elements carry data-keep labels."""
    parsed = [Page(p) for p in pages]
    forest = Forest(parsed)
    y = np.array([x if x is not None else -1 for p in parsed for x in p.labels])
    for level in reversed(forest.levels[1:]):  # elements without a label are on the way to content if a child is
        np.maximum.at(y, forest.parent[level], y[level])
    y = np.maximum(y, 0)
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
    w, pair = np.zeros(WIDTH), np.zeros((KINDS, 2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    scale = max(1, forest.n)
    for step in range(1, steps + 1):
        one, inner, joint, _ = marginals(forest, forest.x @ w, pair)
        expected = np.zeros_like(pair)
        np.add.at(expected, forest.kind[inner], joint)
        gradients = (forest.x.T @ (y - one) / scale * 10 - decay * w, (seen - expected) / scale * 10 - decay * pair)
        for x, g, i in ((w, gradients[0], 0), (pair, gradients[1], 2)):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g * g
            x += rate * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 1] / (1 - 0.99**step)) + 1e-8)
    return w, pair


def labelled_page(rng: random.Random) -> str:
    """A page whose elements say by data-keep whether they hold content: menus, headers, footers, sidebars,
    notices, adverts, forms and comments about an article, in the tags and classes that pages use for them."""
    syllables = rng.choice(["ka lo mi tu se ra".split(), "er the in on st".split(), "é ou tre ai qu".split(), "sch ung en tz".split()])

    def words(low, high):
        out = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return " ".join(w + rng.choice(["", "", "", "", "", ",", "."]) for w in out).capitalize() + rng.choice(["", ".", "."])

    def el(tag, keep, inside, *names):
        names = [x for x in names if x]
        c = f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if names else ""
        return f'<{tag} data-keep="{int(keep)}"{c}>{inside}</{tag}>'

    def links(low, high):
        return [el("a", 0, words(1, 4)) for _ in range(rng.randint(low, high))]

    def prose(keep):
        text = words(1, 8) if rng.random() < 0.25 else words(8, 80)
        for tag in ("a", "b", "em", "span", "code", "strong", "i"):
            if rng.random() < 0.12:
                text += " " + el(tag, keep, words(1, 5)) + " " + words(1, 12)
        return text

    def nested(inside, keep):
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            inside = el(rng.choice(["div", "div", "div", "section", "span"]), keep, inside)
        return inside

    def menu():
        items = links(2, 9)
        if rng.random() < 0.6:
            items = [el("ul", 0, "".join(el("li", 0, x) for x in items), rng.choice(["", "menu", "nav"]))]
        return el(rng.choice(["nav", "nav", "nav", "div"]), 0, " ".join(items), *rng.choice([["menu", "nav-bar", "navigation", "breadcrumb"], ["main-menu"], [""] if rng.random() < 0.3 else ["nav"]]))

    def plain_block(names, tags=("div",), low=1, high=3):
        inside = "".join(rng.choice([el("p", 0, prose(0)), el("h3", 0, words(1, 4)), words(3, 30), el("div", 0, words(2, 20)), " ".join(links(1, 4))]) for _ in range(rng.randint(low, high)))
        tag = rng.choice(tags)
        return el(tag, 0, inside, *(names if tag in ("div", "section", "span", "p", "ul") or rng.random() < 0.5 else [""]))

    def comments():
        one = lambda: el(rng.choice(["div", "li", "article"]), 0, el("span", 0, words(1, 2), "author") + "".join(el("p", 0, prose(0)) for _ in range(rng.randint(1, 3))), "comment", "comment-body", "reply")
        return el(rng.choice(["section", "div", "ol", "aside"]), 0, el("h2", 0, words(1, 3)) + "".join(one() for _ in range(rng.randint(1, 5))), "comments", "comment-list", "disqus-thread", "comments-area")

    def form():
        return el("form", 0, el("label", 0, words(1, 4)) + '<input type="text">' + el("p", 0, words(2, 12)) + "<button>Go</button>", "login", "newsletter", "search", "")

    advert = lambda: plain_block(["ad", "ads", "advert", "sponsored", "ad-slot", "promo"], ("div", "div", "div", "aside", "section"), 1, 1)
    notice = lambda: plain_block(["cookie-notice", "notice", "alert", "consent", "gdpr-banner"], ("div", "div", "section", "p"))
    side = lambda: plain_block(["sidebar", "side", "widget", "related", "rail"], ("aside", "aside", "div"), 1, 5)
    share = lambda: el("div", 0, " ".join(links(2, 5)), "share", "social", "tags")

    def content():
        kind = rng.random()
        if kind < 0.72:
            return el("p", 1, prose(1)) if rng.random() < 0.93 else nested(el("p", 1, prose(1)), 1)
        if kind < 0.8:
            return el(rng.choice(["h2", "h3", "h4"]), 1, words(1, 8))
        if kind < 0.88:
            return el(rng.choice(["ul", "ol"]), 1, "".join(el("li", 1, prose(1) if rng.random() < 0.7 else el("a", 1, words(1, 4)) + " " + words(3, 9)) for _ in range(rng.randint(1, 6))))
        if kind < 0.92:
            return el("blockquote", 1, el("p", 1, prose(1)) if rng.random() < 0.5 else prose(1))
        if kind < 0.95:
            return el("table", 1, "".join(el("tr", 1, "".join(el(rng.choice(["td", "th"]), 1, words(1, 4)) for _ in range(3))) for _ in range(rng.randint(1, 4))))
        if kind < 0.97:
            return el("figure", 1, '<img src="x">' + el("figcaption", 1, words(2, 12)))
        return el("pre", 1, words(3, 20)) if rng.random() < 0.5 else nested(el(rng.choice(["p", "div"]), 1, prose(1)), 1)

    parts = [el("h1", 1, words(1, 10))] if rng.random() < 0.8 else []
    if parts and rng.random() < 0.3:
        parts = [el("header", 1, parts[0])]
    short = rng.random() < 0.2  # verse, talk, lines
    line = words(1, 4)
    for _ in range(rng.randint(1, 9) if not short and rng.random() < 0.8 else rng.randint(10, 60)):
        parts.append(el("p", 1, rng.choice([words(1, 4), line, el(rng.choice("bi"), 1, words(1, 4))])) if short and rng.random() < 0.9 else content())
        if rng.random() < (0.02 if short else 0.06):
            parts.append(rng.choice([advert, share, notice, form, side])())
    if rng.random() < 0.15:
        parts.append(comments())
    inside = "".join(parts)
    shape = rng.random()
    if shape < 0.55:
        body = el("article", 1, inside, rng.choice(["", "", "post", "entry"]))
    elif shape < 0.85:
        body = el(rng.choice(["div", "div", "section", "main"]), 1, inside, "content", "article-body", "post", "main", "entry-content", "story", "")
    else:
        body = inside
    if rng.random() < 0.35:
        body = el(rng.choice(["main", "div"]), 1, body + (side() if rng.random() < 0.3 else ""), "main", "content", "wrapper", "page", "")
    before = [f() for f in (menu, advert, notice, side, form) if rng.random() < 0.45]
    if rng.random() < 0.5:
        before.insert(0, el("header", 0, rng.choice([menu(), el("h2", 0, words(1, 3)), el("p", 0, words(2, 8)), el("a", 0, words(1, 3), "logo") + menu()]), "header", "masthead", "top", ""))
    after = [f() for f in (comments, side, advert, form, menu) if rng.random() < 0.3]
    after.append(el(rng.choice(["footer", "footer", "footer", "div"]), 0, rng.choice([words(2, 20), el("p", 0, words(2, 25)), " ".join(links(1, 5)) + words(2, 9)]), "footer", "site-footer", "copyright"))
    if rng.random() < 0.1:
        body, after[-1] = nested(body, 1), nested(after[-1], 0)
    rng.shuffle(before)
    return f"<html><head><title>{words(1, 9)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


@lru_cache(1)
def trained(pages: int = 400, seed: int = 1):
    """The weights of all queries, fitted on pages labelled_page() makes: as many, from this seed."""
    rng = random.Random(seed)
    return train([labelled_page(rng) for _ in range(pages)])


def texts_of(sources: list[str | None], model) -> list[str]:
    pages = [Page(s or "") for s in sources]
    forest = Forest(pages)
    keep = marginals(forest, forest.x @ model[0], model[1])[0] >= 0.5
    return [p.text(keep[a:b]) for p, a, b in zip(pages, forest.first.tolist(), forest.first[1:].tolist())]


def extract(pages: DataFrame, model=None) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars (code points), a row for each row.

    Null and empty pages have empty texts; null ids and urls, repeated rows and extra columns change nothing.
    """
    model = model or trained()

    def run(batches):
        for batch in batches:
            ids, urls, sources = batch.columns
            for at in range(0, len(sources), 128):
                texts = texts_of(sources.slice(at, 128).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 128), urls.slice(at, 128), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
