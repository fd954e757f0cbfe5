"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements. For each node a boosted softmax model gives the probabilities that it lies in the main
text, is boilerplate, or only holds both; its features are the density of its subtree, tokens of its attributes, its depth, and how
it stands among its siblings. Decoding is hierarchical: the cheapest labelling of the whole tree in which nothing below boilerplate
is main text, and nothing below main text is a mere container, so that ancestors and descendants never contradict each other.

No labelled pages exist, so the model is trained on pages that ``training_page`` composes, of which every node's label is known: with
and without semantic elements and telling attributes, with menus, notices, adverts, forms, comments and related links around and
inside the article. Some have nothing but the article. The model has a fixed size and is trained on the driver in some seconds; pages are only ever scanned.

Null and empty pages, and pages without text, give an empty text; text outside all blocks is a paragraph of its own. Broken markup is read as far as it goes; pages of any length are
read whole. Repeated rows are rows of their own.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import kernels

BOILERPLATE, CONTAINER, MAIN = 0, 1, 2
# Fixed lists: elements by how HTML treats them, and tokens that attributes tell a block's purpose by.
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe object svg head title textarea".split())
GOOD = frozenset("article content main post body entry text story page hentry blog prose paragraph".split())
AGAINST = frozenset("ad ads advert adverts advertisement sponsor sponsored banner promo nav navigation menu navbar breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie consent notice alert popup modal newsletter subscribe signup login form search comment comments respond reply disqus related recommended share sharing social pagination pager tags meta toolbar copyright legal skip".split())
AMBIGUOUS = sorted(AGAINST - set("ad ads advert adverts advertisement sponsor sponsored promo cookie consent".split()))
KINDS = ("article main", "section div", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "li ul ol dl dt dd menu", "nav", "header", "footer", "aside", "form button fieldset select option legend", "table tbody thead tr td th", "figure figcaption")
KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags.split()}
FEATURES = 17 + len(KINDS) + 12

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
#: Elements that hold text only, up to their own end tag; and those that can stand in a head, which any other element or text ends.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "iframe")}
HEAD = frozenset("html head base link meta script style title noscript template".split())
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Tree(NamedTuple):
    """Block elements in page order: tag, parent and attribute tokens; and runs of text: node, text, characters in links, inline tags."""

    tags: list[str]
    parents: list[int]
    tokens: list[frozenset]
    texts: list[tuple[int, str, int, int]]


def marks(page: str) -> Iterator[re.Match]:
    """The markup of a page, without what looks like it in elements that hold text only."""
    m = MARKUP.search(page)
    while m:
        yield m
        at, raw = m.end(), RAW.get((m[2] or m[5] or "").lower())
        if raw and not (m[1] or m[4] or SELF_CLOSED.search(m[3] or m[6] or "")):
            end = raw.search(page, at)
            at = end.start() if end else len(page)
        m = MARKUP.search(page, at)


def parse(page: str | None) -> Tree:
    tree = Tree(["html"], [-1], [frozenset()], [])
    stack, at, linked = [0], 0, 0
    skipping: list[str] = []
    parts: list[str] = []
    in_link = inline = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked, inline
        text = " ".join(references.unescape("".join(parts)).split())
        if text or inline:
            node = stack[-1]
            if text and tree.tags[node] in ("html", "body"):  # bare text is a paragraph of its own
                node = len(tree.tags)
                tree.tags.append("p")
                tree.parents.append(stack[-1])
                tree.tokens.append(frozenset())
            tree.texts.append((node, text, min(linked, len(text)), inline))
        parts.clear()
        linked = inline = 0

    for m in marks(page):
        if skipping == ["head"] and page[at : m.start()].strip():
            skipping.clear()
        if not skipping and m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = m[1] or m[4]
        if skipping == ["head"] and not closing and tag not in HEAD:
            skipping.clear()
        if skipping and closing:
            if tag in skipping:
                del skipping[len(skipping) - 1 - skipping[::-1].index(tag) :]
        elif tag in SKIPPED:
            if not closing and not SELF_CLOSED.search(m[3] or m[6] or ""):
                skipping.append(tag)
        elif skipping:
            continue
        elif tag not in BLOCKS:
            inline += 1
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = max(0, in_link + (-1 if closing else 1))
        elif closing:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if tree.tags[stack[k]] == tag:
                    del stack[k:]
                    in_link = 0
                    break
        else:
            flush()
            if tag in ("html", "body") and len(stack) == 1 + (tag == "body" and tree.tags[-1] == "body"):
                if tag == "html":
                    continue
            # an open paragraph, item or cell ends where the next block of its kind begins
            for k in range(len(stack) - 1, 0, -1):
                open_tag = tree.tags[stack[k]]
                if open_tag == "p" or open_tag == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    del stack[k:]
                    break
                if open_tag in ("div", "section", "article", "td", "ul", "ol", "table", "aside", "main", "form", "blockquote", "body"):
                    break
            attributes = m[3] or m[6] or ""
            names = " ".join(next(filter(None, x), "") for x in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
            tree.tags.append(tag)
            tree.parents.append(stack[-1])
            tree.tokens.append(frozenset(w.lower() for w in WORD.findall(names)))
            if tag not in VOID:
                stack.append(len(tree.tags) - 1)
    if not skipping or skipping == ["head"]:
        parts.append(page[at:])
    flush()
    return tree


def features(tree: Tree) -> np.ndarray:
    """(nodes, FEATURES)."""
    n = len(tree.tags)
    own, links, inline, marks, runs, start = (np.zeros(n) for _ in range(6))
    total = 0
    for node, text, linked, tags in tree.texts:
        if not own[node]:
            start[node] = total
        own[node] += len(text)
        links[node] += linked
        inline[node] += tags
        marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        runs[node] += 1
        total += len(text)
    parents = tree.parents
    size, link, tags, mark, blocks, paragraphs, headings = own.copy(), links.copy(), inline + 1, marks.copy(), runs.copy(), np.zeros(n), np.zeros(n)
    kind = np.array([KIND.get(t, -1) for t in tree.tags])
    paragraphs[kind == 2] = 1
    headings[[t == "h1" for t in tree.tags]] = 1
    children: list[list[int]] = [[] for _ in range(n)]
    first = np.where(own > 0, start, np.inf)
    for i in range(n - 1, 0, -1):
        p = parents[i]
        children[p].append(i)
        for x in (size, link, tags, mark, blocks, paragraphs, headings):
            x[p] += x[i]
        first[p] = min(first[p], first[i])
    good = np.array([len(t & GOOD) for t in tree.tokens], float)
    bad = np.array([len(t & AGAINST) for t in tree.tokens], float)
    out = np.zeros((n, FEATURES))
    depth, good_above, bad_above = np.zeros(n), np.zeros(n), np.zeros(n)
    within = np.zeros((n, 5))  # article, nav or header or footer, aside, form, list
    groups = {0: 0, 5: 1, 6: 1, 7: 1, 8: 2, 9: 3, 4: 4}
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        good_above[i], bad_above[i] = good_above[p] + good[p], bad_above[p] + bad[p]
        within[i] = within[p]
        if kind[p] in groups:
            within[i, groups[kind[p]]] = 1
    density = link / np.maximum(size, 1)
    place, count, same, before, after, beside = (np.zeros(n) for _ in range(6))
    for brood in children:
        brood.reverse()
        m = len(brood)
        if not m:
            continue
        mean = sum(size[brood]) / m
        for k, i in enumerate(brood):
            place[i], count[i], beside[i] = k / m, m, mean
            same[i] = sum(tree.tags[j] == tree.tags[i] for j in brood[max(0, k - 3) : k + 4]) / min(7, m)
            before[i] = density[brood[k - 1]] if k else -1
            after[i] = size[brood[k + 1]] if k + 1 < m else -1
    columns = (depth, np.log1p(size), density, np.log1p(tags), size / tags, np.log1p(paragraphs), 100 * mark / np.maximum(size, 1), place, np.log1p(count), same, size / max(total, 1), np.where(np.isfinite(first), first, total) / max(total, 1), np.log1p(own), np.log1p(blocks), np.minimum(headings, 2), np.log1p(beside), np.log1p(np.maximum(after, 0)))
    for k, x in enumerate(columns):
        out[:, k] = x
    at = len(columns)
    out[np.flatnonzero(kind >= 0), at + kind[kind >= 0]] = 1
    at += len(KINDS)
    for k, x in enumerate((good, bad, good_above, bad_above, before, *within.T, paragraphs > 2, density > 0.5)):
        out[:, at + k] = x
    return out


class Trees(NamedTuple):
    """Boosted trees: edges of each feature's bins, and for each tree its class, features, bins and leaf values."""

    edges: list[np.ndarray]
    kinds: np.ndarray
    features: np.ndarray
    bins: np.ndarray
    values: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], 1).astype(np.int16)
        out, rows = np.zeros((len(x), 3)), np.arange(len(x))
        depth = int(np.log2(self.values.shape[1]))
        for kind, feature, cut, value in zip(self.kinds, self.features, self.bins, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out[:, kind] += value[node - (1 << depth) + 1]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 36, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 2.0) -> Trees:
    """Softmax boosting with histograms; every level takes each node's best cut."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], 1)
    wide, n = bins + 1, x.shape[1]
    cell = (binned + np.arange(n) * wide).astype(np.int64)
    logits, one = np.zeros((len(x), 3)), np.eye(3)[y]
    kinds, features_, cuts, values = [], [], [], []
    for _ in range(rounds):
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for kind in range(3):
            g, h = p[:, kind] - one[:, kind], np.maximum(p[:, kind] * (1 - p[:, kind]), 1e-6)
            each_g, each_h = np.repeat(g, n), np.repeat(h, n)
            node = np.zeros(len(x), np.int64)
            feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, bins + 1)
            for level in range(depth):
                base, width = (1 << level) - 1, 1 << level
                at = (cell + ((node - base) * (n * wide))[:, None]).ravel()
                gs, hs = (np.bincount(at, v, width * n * wide).reshape(width, n, wide).cumsum(2) for v in (each_g, each_h))
                gain = gs**2 / (hs + ridge) + (gs[:, :, -1:] - gs) ** 2 / (hs[:, :, -1:] - hs + ridge) - gs[:, :, -1:] ** 2 / (hs[:, :, -1:] + ridge)
                best = gain.reshape(width, -1).argmax(1)
                better = np.flatnonzero(gain.reshape(width, -1)[np.arange(width), best] > 1e-9)
                feature[base + better], cut[base + better] = best[better] // wide, best[better] % wide
                node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
            leaf = node - (1 << depth) + 1
            value = -rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
            logits[:, kind] += value[leaf]
            for held, new in zip((kinds, features_, cuts, values), (kind, feature, cut, value), strict=True):
                held.append(new)
    return Trees(edges, np.array(kinds), np.array(features_), np.array(cuts), np.array(values))


@functools.lru_cache(maxsize=1)
def vocabulary() -> list[str]:
    """Words for composed pages."""
    random = np.random.default_rng(3)
    return ["".join(random.choice(list("aeionrstlmdu"), random.integers(2, 9))) for _ in range(4000)]


def training_page(random: np.random.Generator) -> str:
    """A page whose nodes carry their labels as data-y attributes."""
    known = vocabulary()
    words = lambda a, b: " ".join([known[k] for k in random.integers(0, len(known), random.integers(a, b)).tolist()])
    sentence = lambda a, b: words(a, b).capitalize() + random.choice([".", ".", ".", "!", "?"])
    often = lambda p: random.random() < p
    told = often(0.7)  # whether attributes tell what blocks are for

    def block(tag: str, y: int, inside: str, names: Sequence[str] = (), sure: bool = False) -> str:
        name = f' {random.choice(["class", "id"])}="{random.choice(list(names))}"' if names and (told or sure) else (f' class="{"".join(random.choice(list("bcdfgxyz"), 4))}"' if often(0.2) else "")
        return f"<{tag}{name} data-y={y}>{inside}" + ("" if tag == "p" and often(0.15) else f"</{tag}>")

    link = lambda a, b: f'<a href="/x">{words(a, b)}</a>'
    listing = lambda n, a, b: block("ul", 0, "".join(block("li", 0, link(a, b)) for _ in range(n)))
    advert = lambda: block(random.choice(["div", "aside", "p"]), 0, sentence(3, 12) + (link(1, 4) if often(0.5) else ""), ("ad", "ads", "advert", "sponsored", "promo-box"), True)
    semantic = often(0.6)
    short = often(0.5)
    tiny = often(0.15)
    paragraphs = [block("p", 2, words(1, 5).capitalize() + "." if tiny or short and often(0.5) else ("<b>" if often(0.1) else "") + " ".join(sentence(3, 25) for _ in range(random.integers(1, 7))) + (f" {link(1, 3)} {sentence(3, 9)}" if often(0.15) else "") + ("<br>" if often(0.1) else "")) for _ in range(1 if tiny else random.integers(1, 3) if often(0.35) else random.integers(2, 14))]
    # words of attributes that say nothing of their block's purpose: "header-image-text" is a paragraph of the article
    misled = lambda p=0.12: (f"{random.choice(AMBIGUOUS)}-{random.choice(known)}", f"{random.choice(AMBIGUOUS)}-{random.choice(known)}-{random.choice(known)}") if often(p) else ()
    phrase = lambda: words(1, 5).capitalize() if often(0.5) else sentence(3, 15)
    items = lambda n, deep: "".join(block("li", 2, phrase() + (block(random.choice(["ul", "ol"]), 2, items(random.integers(1, 4), False)) if deep and often(0.3) else ""), misled(), True) for _ in range(n))
    cells = lambda tag, n: block("tr", 2, "".join(block(tag, 2, words(1, 4) if often(0.6) else str(random.integers(1, 9999))) for _ in range(n)))

    def data_table() -> str:
        n, m = random.integers(2, 6), random.integers(1, 8)
        head, body = cells("th", n), "".join(cells("td", n) for _ in range(m))
        return block("table", 2, block("thead", 2, head) + block("tbody", 2, body) if often(0.5) else (head if often(0.6) else "") + body, misled(), True)

    parts = (
        (0.35, lambda: block(random.choice(["h2", "h3", "h4"]), 2, words(1, 7).capitalize(), misled(), True)),
        (0.3, lambda: block(random.choice(["ul", "ol"]), 2, items(random.integers(2, 6), True), misled(), True)),
        (0.15, lambda: block("blockquote", 2, block("p", 2, sentence(5, 25)))),
        (0.2, data_table),
        (0.12, lambda: block("dl", 2, "".join(block("dt", 2, words(1, 4).capitalize()) + block("dd", 2, phrase()) for _ in range(random.integers(1, 5))))),
        (0.1, lambda: block("details", 2, block("summary", 2, words(2, 7).capitalize()) + block("p", 2, sentence(4, 20)))),
        (0.1, lambda: block("figure", 2, '<img src="/i">' + block("figcaption", 2, phrase()))),
        (0.4, lambda: block("p", 2, sentence(5, 25) + (" " + sentence(3, 20) if often(0.4) else ""), misled(0.8), True)),
        (0.06, lambda: block("pre", 2, words(3, 20))),
    )
    for p, part in parts:
        for _ in range(3):  # the last places as often as the others
            if often(p / 2):
                paragraphs.insert(len(paragraphs) if often(0.3) else random.integers(len(paragraphs) + 1), part())
    if often(0.3):
        paragraphs.insert(random.integers(len(paragraphs) + 1), advert())
    if often(0.15):
        paragraphs.append(block("div", 0, listing(random.integers(2, 5), 1, 3), ("share", "social", "tags")))
    heading = block("h1", 2, words(2, 12)) if often(0.9) else ""
    if often(0.15):  # nothing but the article, or its parts alone
        whole = heading + "".join(paragraphs)
        for _ in range(random.integers(0, 3)):
            whole = block(random.choice(["article", "div", "section", "main"]), 2, whole)
        return random.choice([f"<html><body data-y=1>{whole}</body></html>", whole])
    article = block("article" if semantic else "div", 2, heading + "".join(paragraphs), ("content", "article-body", "post", "entry-content", "story"))
    listed = random.choice(["ol", "ul"])
    remark = lambda: block("li", 0, (f"<b>{words(1, 3)}</b>" if often(0.7) else "") + (block("p", 0, sentence(2, 20)) if often(0.7) else sentence(2, 20)))
    bare = f"<{listed} data-y=0>{''.join(remark() for _ in range(random.integers(1, 7)))}</{listed}>"  # comments that nothing names
    comments = (block(random.choice(["section", "div"]), 0, block(random.choice(["h2", "h3"]), 0, words(1, 5)) + bare) if often(0.6) else bare) if often(0.3) else block(random.choice(["section", "div"]), 0, block("h3", 0, words(1, 3)) + "".join(block("div", 0, block("p", 0, sentence(3, 25)), ("comment", "reply")) for _ in range(random.integers(1, 6))), ("comments", "respond", "disqus-thread"))
    related = block(random.choice(["div", "section", "aside"]), 0, block("h3", 0, words(1, 3)) + listing(random.integers(2, 6), 2, 8), ("related", "recommended"))
    form = block("form", 0, block("p", 0, sentence(2, 8)) + '<input name="q">' + block("button", 0, words(1, 2)), ("search", "newsletter", "login"))
    notice = block("div", 0, sentence(5, 20) + link(1, 3), ("cookie-notice", "consent", "alert", "notice"))
    nav = block("nav" if semantic or often(0.5) else "div", 0, listing(random.integers(3, 10), 1, 3), ("nav", "menu", "navbar", "navigation"))
    title = block("h1" if often(0.4) else "p", 0, words(1, 5).capitalize()) if often(0.6) else ""
    head = block("header" if semantic or often(0.3) else "div", 0, title + (block("p", 0, phrase()) if often(0.3) else "") + (nav if often(0.6) else ""), ("header", "masthead", "top-header"))
    footer = block("footer" if semantic or often(0.5) else "div", 0, random.choice(["&copy; ", ""]) + words(1, 4) + " &middot; " + sentence(2, 25) + (listing(random.integers(1, 5), 1, 3) if often(0.4) else ""), ("footer", "copyright", "legal"))
    side = block("aside" if semantic else "div", 0, "".join(random.choice([related, form, advert()]) for _ in range(random.integers(1, 4))), ("sidebar", "widget-area"))
    after = "".join(x for x, p in ((comments, 0.35), (related, 0.25), (side, 0.3), (form, 0.15)) if often(p))
    middle = (side if often(0.2) else "") + article + after
    for _ in range(random.integers(0, 3)):
        middle = block(random.choice(["div", "main", "section"]), 1, middle, ("wrapper", "container", "page", "main", "layout"))
    before = (notice if often(0.25) else "") + (head if often(0.5) else "") + (nav if often(0.8) else "") + (advert() if often(0.5) else "") + (form if often(0.1) else "")
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body data-y=1>{before}{middle}{footer if often(0.9) else ''}{notice if often(0.1) else ''}</body></html>"


LABEL = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)[^>]*?data-y=(\d)")


@functools.lru_cache(maxsize=2)
def model(pages: int = 900, seed: int = 7) -> Trees:
    """The trees, trained on so many composed pages."""
    random = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = training_page(random)
        labels = [int(y) for _, y in LABEL.findall(page)]
        tree = parse(page)
        if len(tree.tags) != len(labels) + 1:
            raise ValueError("a composed page was read in another way than written")
        xs.append(features(tree)[1:])
        ys.append(labels)
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(tree: Tree, logits: np.ndarray) -> list[int]:
    """The cheapest labels of the nodes that don't contradict each other."""
    shifted = logits - logits.max(1, keepdims=True)
    cost = np.log(np.exp(shifted).sum(1, keepdims=True)) - shifted
    weight = np.ones(len(tree.tags))
    for node, text, _, _ in tree.texts:
        weight[node] += np.log1p(len(text))
    cost = (cost * weight[:, None]).tolist()
    choice: list[tuple[int, int, int]] = [(0, 0, 0)] * len(cost)
    for i in range(len(cost) - 1, 0, -1):  # children stand behind their parents
        drop, pass_, keep = cost[i]
        inside = BOILERPLATE if drop <= keep else MAIN
        free = min((drop, BOILERPLATE), (pass_, CONTAINER), (keep, MAIN))[1]
        choice[i] = BOILERPLATE, free, inside
        up = cost[tree.parents[i]]
        up[BOILERPLATE] += drop
        up[CONTAINER] += cost[i][free]
        up[MAIN] += cost[i][inside]
    labels = [CONTAINER] * len(cost)
    for i in range(1, len(cost)):
        labels[i] = choice[i][labels[tree.parents[i]]]
    return labels


def texts(pages: Sequence[str | None], trees: Trees, together: int = 256) -> list[str]:
    """The main text of each page."""
    out = []
    for a in range(0, len(pages), together):
        parsed = [parse(p) for p in pages[a : a + together]]
        found = [features(t) for t in parsed]
        logits = trees.logits(np.concatenate(found))
        at = 0
        for tree in parsed:
            labels = decode(tree, logits[at : at + len(tree.tags)])
            at += len(tree.tags)
            out.append("\n".join(text for node, text, _, _ in tree.texts if text and labels[node] == MAIN))
    return out


def extract(pages: DataFrame, *, html: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text string and n_chars long of every page."""
    trees = model()
    pages = pages.select(*dict.fromkeys([*keep, html]))
    fields = [f for f in pages.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch.column(batch.schema.get_field_index(html)).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in fields), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*(f.name for f in fields), "text", "n_chars"])
            kernels.tidy()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string, n_chars long"])
    return pages.mapInArrow(run, schema)
