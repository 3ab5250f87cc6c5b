"""Main text of web pages by a tree-structured graphical model over block elements.

Every block element is content, boilerplate, or mixed, which is a wrapper that holds both. A log-linear model of an
element's own features gives its potentials, and each parent-child edge has potentials by the kind of the child.
Neighbouring children without a telling name or tag hang on a *run*, a node of its own between them and their parent:
what a run tells the parent is bounded by one edge, so that a long list can't outvote the article it is in. Sum-product
messages pass upward and downward through the tree and give each element's content marginal; the text of elements above
one half is the page's main text.

Potentials are trained jointly, by the gradient of the likelihood of whole labelled trees, which takes the same messages.
The labelled pages are a few written for this module, some hundreds composed by rule (``compose``) of the layouts that
pages have, and a bounded sample of the given pages that say themselves where their article is (an article or main
element, or the role or property for it). Each of these is learned from twice, as it is and without its names and telling
elements, so that the model also learns what an article looks like where nothing says so.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import text_chunks

#: Pages that the potentials are trained on at most, besides the fixed ones.
FIT_PAGES = 120
#: Pages composed for training, steps of the fit and its penalty.
COMPOSED, STEPS, PENALTY = 400, 140, 1e-4
#: Pages longer than this many characters aren't trained on; every page is extracted whole.
FIT_CHARS = 200_000
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
#: Elements by their role in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold text themselves; in others a run of bare text is a paragraph of its own.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd td th caption figcaption legend summary address blockquote".split())
PLAIN = TEXT | frozenset("ul ol dl table thead tbody tfoot tr figure details dir optgroup".split())
#: Elements whose content is no text of the page: of the raw ones nothing but their own close is markup.
RAW = frozenset("script style textarea title".split())
FOREIGN = frozenset("svg math".split())
SKIPPED = FOREIGN | frozenset("noscript template iframe object select button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
AWAY = re.compile(r"\b(nav|navbar|navigation|menu|header|masthead|topbar|footer|bottom|sidebar|side|aside|ad|ads|advert|advertisement|adverts|banner|sponsor|sponsored|promo|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|form|share|sharing|social|related|recommended|more|breadcrumb|breadcrumbs|pagination|pager|tags|meta|byline|comment|comments|respond|reply|replies|discussion|disqus|widget|toolbar|copyright|legal|skip)\b")
TOWARD = re.compile(r"\b(article|content|post|entry|story|text|main|body|articlebody|hentry|prose)\b")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|([^<]++|<)", re.S | re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
FRAMED = re.compile(r"\b(?:has|with|no|without|hide|show)\s+[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[_\-\s]+")

#: Labelled pages: elements whose data-label is 1 hold content with all below them, those of 0 don't.
LABELLED_PAGES = (
    '<body><header class="site-header" data-label="0"><p>Daily News</p><nav data-label="0"><ul><li><a>Home</a></li><li><a>World</a></li></ul></nav></header><div class="cookie-notice" data-label="0"><p>We use cookies. Read our policy to learn how.</p></div><main data-label="1"><h1>A town rebuilds its bridge</h1><p>The old bridge was closed last year after a long and wet winter. Now the town has started work on a new one.</p><ul><li>Work began in March.</li><li>It ends next summer, if all goes well.</li></ul><p>People on both banks are glad.</p><div class="share-buttons" data-label="0"><a>Share</a> <a>Post</a></div></main><aside class="sidebar" data-label="0"><h3>Most read</h3><ul><li><a>Ten walks for the autumn</a></li></ul></aside><footer data-label="0"><p>All rights reserved.</p></footer></body>',
    '<body><div id="wrapper" data-label="0"><div id="menu" data-label="0"><a>Start</a> <a>About</a> <a>Contact</a></div><div class="post-content" data-label="1"><h2>How to bake rye bread</h2><p>Start the dough in the evening, so that it can rest through the night. Use a warm bowl.</p><blockquote>Good bread takes its time.</blockquote><table><tr><td>Rye flour</td><td>500 g, finely ground.</td></tr></table><p>Bake it for an hour.</p></div><div id="comments" data-label="0"><h3>3 comments</h3><div class="comment" data-label="0"><p>I tried this and it worked very well, thank you for the recipe.</p></div><form data-label="0"><p>Leave a reply</p><label>Name</label></form></div><div class="footer" data-label="0">Copyright. <a>Imprint</a></div></div></body>',
    '<body><nav class="breadcrumb" data-label="0"><a>Home</a> <a>Science</a></nav><article data-label="1"><h1>Rivers under the ice</h1><p class="byline" data-label="0">By a staff writer</p><p>Far below the surface, water moves through channels that no one has seen. Radar shows where they run.</p><figure><figcaption>The glacier from the air.</figcaption></figure><p>Short note.</p><div class="ad" data-label="0">Buy warm boots now, at half the price.</div><h2>What comes next</h2><p>More flights are planned for the spring, when the days are longer again.</p><aside data-label="0"><p>Sign up for our newsletter to get stories like this one.</p></aside></article><section class="related" data-label="0"><h2>Related</h2><p><a>The last winter</a></p></section></body>',
    '<body><div class="banner" data-label="0"><p>Summer sale: everything must go this week.</p></div><section class="story" data-label="1"><h1>Notes from the harbour</h1><p>Boats leave before dawn. The market opens when they come back, and closes when the fish is sold.</p><pre>06:10 out  11:40 in</pre><p>It has been so for a hundred years.</p></section><form class="login" data-label="0"><p>Log in to save this story and read it later.</p></form><div class="popup" data-label="0"><p>Do not miss out: join the list today.</p></div><ul class="pagination" data-label="0"><li><a>1</a></li><li><a>2</a></li></ul></body>',
    '<body><p data-label="1">This page has no frame at all, only a few paragraphs that follow each other down the page.</p><p data-label="1">Each of them says a little more, and none of them is a link or an advertisement.</p><h2 data-label="1">A heading</h2><p data-label="1">And then it ends.</p><div class="footer" data-label="0"><p>Last changed in May. <a>Top</a></p></div></body>',
    '<body><header data-label="0"><h1>The Valley Post</h1><p>News from the valley since 1921.</p></header><div class="alert" data-label="0">The office is closed on Monday.</div><div data-label="1"><h1>School choir wins</h1><p>The choir of the upper school won the cup. It was a close call.</p><p>Bravo!</p></div><aside data-label="0"><p>The weather will be fine until the weekend, with light winds from the west.</p></aside><footer data-label="0">The Valley Post is printed on paper made in the valley. Thank you for reading.</footer></body>',
    '<body><h1 data-label="1">Plain page</h1><p data-label="1">Short.</p><p data-label="1">It has two lines of text, and then some more of them.</p><p data-label="1">End of it</p><footer data-label="0">Written by hand, with care.</footer></body>',
)


#: States of an element, and kinds of children by which edges differ.
CONTENT, BOILERPLATE, MIXED = 0, 1, 2
PROSE, LIST, BOX, AWAY_KIND, TOWARD_KIND, RUN = range(6)
#: Elements whose tags tell their part in a page.
AWAY_TAGS = frozenset("nav aside footer header form menu dialog search".split())
TOWARD_TAGS = frozenset("article main".split())


class Node:
    """A block element with the text pieces directly in it, or a run of such elements."""

    __slots__ = ("tag", "parent", "names", "kind", "label", "words", "linked", "stops", "kids", "below", "below_linked", "below_stops", "titles", "signs", "run")

    def __init__(self, tag: str, parent: int, names: str, label: int):
        self.tag, self.parent, self.names, self.label, self.run = tag, parent, names, label, -1
        self.kind = kind_of(tag, names)
        self.words = self.linked = self.stops = self.kids = self.below = self.below_linked = self.below_stops = self.titles = self.signs = 0


def kind_of(tag: str, names: str) -> int:
    if tag == "run":
        return RUN
    if tag in AWAY_TAGS or names and AWAY.search(names):
        return AWAY_KIND
    if tag in TOWARD_TAGS or names and TOWARD.search(names):
        return TOWARD_KIND
    return BOX if tag not in PLAIN else PROSE if tag in TEXT and tag != "li" else LIST


def tokenize(page: str) -> Iterator[tuple[bool, str, str, str | None]]:
    """(closes, tag, attributes, None) of every tag and (False, "", "", text) of every text between them.

    Raw elements give nothing: they end at their own close or else at the end of the page, and inside svg and math
    also where they close themselves.
    """
    at, foreign = 0, False
    while m := TOKEN.match(page, at):
        at = m.end()
        if m[4] is not None:
            yield False, "", "", m[4]
        elif m[2] is not None:
            shut, tag = bool(m[1]), m[2].lower()
            if tag in FOREIGN:
                foreign = not shut and not m[3].endswith("/")
            elif tag in BLOCKS:
                foreign = False
            if tag not in RAW:
                yield shut, tag, m[3], None
            elif not shut and not (foreign and m[3].endswith("/")):
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)


def skip_ends(tokens: list[tuple[bool, str, str, str | None]]) -> dict[int, tuple[int, bool]]:
    """By the place of each opening tag of ``SKIPPED``: the place where it ends, and whether its own close stands there.

    One that isn't closed ends with its parent. An svg or math that closes itself holds nothing.
    """
    ends: dict[int, tuple[int, bool]] = {}
    if not any(tag in SKIPPED for _, tag, _, _ in tokens):
        return ends
    opened: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    foreign = 0
    for i, (shut, tag, attributes, text) in enumerate(tokens):
        if text is not None or tag in VOID:
            continue
        if not shut:
            if not (attributes.endswith("/") and (foreign or tag in FOREIGN)):
                opened.append((tag, i))
                count[tag] = count.get(tag, 0) + 1
                foreign += tag in FOREIGN
        elif count.get(tag):
            own = False
            while not own:
                name, j = opened.pop()
                own = name == tag
                count[name] -= 1
                foreign -= name in FOREIGN
                if name in SKIPPED:
                    ends[j] = i, own
    ends.update((j, (len(tokens), False)) for name, j in opened if name in SKIPPED)
    return ends


def after_skip(tokens: list[tuple[bool, str, str, str | None]], ends: dict[int, tuple[int, bool]], at: int) -> int:
    """Place behind the skipped element that opens at ``at``; if it isn't closed, the next block ends it too."""
    end, own = ends[at]
    if own:
        return end + 1
    at += 1
    while at < end:
        shut, tag, _, _ = tokens[at]
        if at in ends and ends[at][1]:
            at = ends[at][0]
        elif tag in BLOCKS and tag != "optgroup" and not shut:
            break
        at += 1
    return at


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, parents first, and the text blocks (element, text) in page order.

    Node 0 stands for the page. Bare text in an element that isn't one of ``TEXT`` is a paragraph of its own. Elements that
    HTML closes by implication are closed; inline elements only mark links. Neighbouring children that tell nothing of
    their part share a run.
    """
    nodes, pieces, stack = [Node("body", -1, "", -1)], [], [0]
    buffer: list[str] = []
    linked = anchors = 0

    def add(tag: str, names: str, label: int) -> int:
        here = stack[-1]
        n = Node(tag, here, names, label)
        if n.kind in (AWAY_KIND, TOWARD_KIND):
            nodes[here].run = -1
            nodes[here].kids += 1
        else:
            if nodes[here].run < 0:
                nodes[here].run = len(nodes)
                nodes[here].kids += 1
                nodes.append(Node("run", here, "", -1))
            n.parent = nodes[here].run
            nodes[n.parent].kids += 1
        nodes.append(n)
        return len(nodes) - 1

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            here = stack[-1] if nodes[stack[-1]].tag in TEXT else add("p", "", -1)
            n = nodes[here]
            pieces.append((here, text))
            count = text.count(" ") + 1
            n.words += count
            n.linked += min(linked, count)
            n.stops += sum(map(text.count, ".!?"))
            n.signs += "\xa9" in text or "opyright" in text
        buffer.clear()
        linked = 0

    def close_until(tags: set[str] | frozenset[str], fence: set[str]) -> None:
        """Pop through the outermost open element of ``tags`` above the nearest of ``fence``."""
        at = None
        for k in range(len(stack) - 1, 0, -1):
            if nodes[stack[k]].tag in fence:
                break
            if nodes[stack[k]].tag in tags:
                at = k
        if at is not None:
            flush()
            del stack[at:]

    tokens = list(tokenize(page))
    ends = skip_ends(tokens)
    at = 0
    while at < len(tokens):
        shut, tag, attributes, text = tokens[at]
        at += 1
        if text is not None:
            text = html.unescape(text) if "&" in text else text
            buffer.append(text)
            if anchors:
                linked += len(text.split())
            continue
        if at - 1 in ends:
            at = after_skip(tokens, ends, at - 1)
            continue
        if tag == "a":
            anchors = 0 if shut else 1
        elif tag in ("br", "img", "input", "wbr"):
            buffer.append(" ")
        elif tag in BLOCKS and tag not in ("html", "body"):
            anchors = 0 if tag != "li" else anchors
            if shut:
                _close_last(nodes, stack, tag, flush)
                continue
            if tag in ENDS_P:
                close_until({"p"}, {"table", "div", "section", "article", "li", "td"})
            if tag in SIBLINGS:
                close_until(SIBLINGS[tag], FENCES[tag])
            flush()
            if tag == "hr":
                continue
            names, label = [], -1
            for x in NAMES.finditer(attributes):
                value = x[1] or x[2] or x[3] or ""
                if x[0][:10].lower() == "data-label":
                    label = int(value) if value in ("0", "1") else -1
                else:
                    names.append(value)
            stack.append(add(tag, FRAMED.sub(" ", " ".join(CAMEL.split(" ".join(names))).lower()), label))
    flush()
    total(nodes)
    return nodes, pieces


def total(nodes: list[Node]) -> None:
    """What is in and below every element."""
    for n in reversed(nodes):
        n.below += n.words
        n.below_linked += n.linked
        n.below_stops += n.stops
        n.titles += n.tag in ("h1", "h2")
        if n.parent >= 0:
            up = nodes[n.parent]
            up.below += n.below
            up.below_linked += n.below_linked
            up.below_stops += n.below_stops
            up.titles += n.titles
            up.signs += n.signs


def _close_last(nodes: list[Node], stack: list[int], tag: str, flush) -> None:
    """Pop through the innermost open element of this tag, if there is one."""
    for k in range(len(stack) - 1, 0, -1):
        if nodes[stack[k]].tag == tag:
            flush()
            del stack[k:]
            return


TAGS = {t: i for i, t in enumerate(sorted(BLOCKS | {"run"}))}
#: Sizes of the groups of features, of which an element has one each: its tag, its kind with the words below it, links
#: with its kind, sentences with words, share of the page's words with its kind, children, titles, signs of a rights notice.
GROUPS = (len(TAGS), 6 * 6, 6 * 5, 6 * 4, 6 * 5, 3, 6 * 3, 2)
STARTS = np.cumsum([0, *GROUPS[:-1]])
WIDTH = sum(GROUPS)


def step(x: float, *bounds: float) -> int:
    return sum([x >= b for b in bounds])


def features(n: Node, page_words: int) -> list[int]:
    """Place of the feature that an element has in each of ``GROUPS``."""
    size = step(n.below, 1, 5, 15, 40, 120)
    links = 0 if not n.below_linked else step(n.below_linked / n.below, 0.25, 0.6, 0.9) + 1
    pace = 0 if not n.below_stops else 1 + step(n.below / n.below_stops, 4, 30)
    share = step(n.below / page_words if page_words else 0, 0.03, 0.12, 0.35, 0.7)
    own = (TAGS[n.tag], n.kind * 6 + size, n.kind * 5 + links, size * 4 + pace, n.kind * 5 + share, step(n.kids, 2, 5), n.kind * 3 + step(n.titles, 1, 2), int(n.signs > 0))
    return [a + b for a, b in zip(STARTS, own, strict=True)]


def settle(nodes: list[Node], text: list[int]) -> list[int]:
    """States from ``text``, which tells of every element whether text right in it would be content: what holds both
    kinds of text is mixed, what holds one is of that kind."""
    good, bad = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        good[i] += text[i] if nodes[i].words or nodes[i].tag != "run" and not nodes[i].kids else 0
        bad[i] += 1 - text[i] if nodes[i].words or nodes[i].tag != "run" and not nodes[i].kids else 0
        p = nodes[i].parent
        if p >= 0:
            good[p] += good[i]
            bad[p] += bad[i]
    out = []
    for i, n in enumerate(nodes):
        if text[i] and n.tag != "run":
            out.append(CONTENT)  # content with an advert in it is content still
        elif not good[i]:
            out.append(BOILERPLATE)
        else:
            out.append(CONTENT if n.tag == "run" and (not bad[i] or n.parent >= 0 and out[n.parent] == CONTENT) else MIXED)
    return out


def labels_by_markup(nodes: list[Node]) -> list[int] | None:
    """States of a page that says itself where its article is; None if it doesn't."""
    marked = lambda n: n.tag in TOWARD_TAGS or "articlebody" in n.names.replace(" ", "") or n.names == "main"
    if not any(marked(n) for n in nodes):
        return None
    out: list[int] = []
    dead: list[bool] = []
    for n in nodes:
        up, lost = (out[n.parent], dead[n.parent]) if n.parent >= 0 else (0, False)
        away = n.tag in AWAY_TAGS or bool(n.names and AWAY.search(n.names) and not TOWARD.search(n.names))
        lost = lost or away
        out.append(0 if lost else 1 if marked(n) else up)
        dead.append(lost)
    return settle(nodes, out)


def labels_given(nodes: list[Node]) -> list[int]:
    """States of a page with data-label attributes, each of which holds for all below it."""
    out: list[int] = []
    for n in nodes:
        out.append(n.label if n.label >= 0 else out[n.parent] if n.parent >= 0 else 0)
    return settle(nodes, out)


def stripped(page: str) -> str:
    """The page without class names and ids, and with elements that tell their part as plain ones."""
    def plain(m: re.Match) -> str:
        if m[2] is None:
            return m[0]
        tag = m[2].lower()
        return f"<{m[1]}{'div' if tag in TELLING else tag}>" if tag in BLOCKS and tag not in ("html", "body") else m[0]

    return TOKEN.sub(plain, page)


#: Elements whose names tell their part in a page.
TELLING = AWAY_TAGS | TOWARD_TAGS | {"section", "hgroup", "address"}


class Forest:
    """Trees of many pages as arrays; messages pass through all of them a level at a time."""

    def __init__(self, pages: list[list[Node]]):
        rows, parent, kind, depth, at = [], [], [], [], 0
        self.starts = [0]
        for nodes in pages:
            words = nodes[0].below
            for n in nodes:
                rows.append(features(n, words))
                parent.append(n.parent + at if n.parent >= 0 else -1)
                kind.append(n.kind)
                depth.append(depth[n.parent + at] + 1 if n.parent >= 0 else 0)
            at += len(nodes)
            self.starts.append(at)
        self.rows, self.parent, self.kind = np.array(rows, int).reshape(-1, len(GROUPS)), np.array(parent, int), np.array(kind, int)
        depth = np.array(depth, int)
        order = np.argsort(depth, kind="stable")
        cuts = np.cumsum(np.bincount(depth)) if len(depth) else np.zeros(0, int)
        self.levels = np.split(order, cuts[:-1]) if len(cuts) else []

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, state) and (node, state of its parent, state): probabilities by an upward and a downward pass. A page
        itself is mixed."""
        up = weights[self.rows].sum(axis=1)
        if self.levels:
            up[self.levels[0]] = [-1e9, -1e9, 0.0]
        message, pair = np.zeros_like(up), edges[self.kind]
        for at in self.levels[:0:-1]:
            message[at] = _log_sum(pair[at] + up[at][:, None, :], 2)
            np.add.at(up, self.parent[at], message[at])
        belief = up
        joint = np.zeros((len(up), 3, 3))
        for at in self.levels[1:]:
            rest = belief[self.parent[at]] - message[at]
            both = pair[at] + up[at][:, None, :] + rest[:, :, None]
            both -= _log_sum(both.reshape(len(at), 9), 1)[:, None, None]
            joint[at] = np.exp(both)
            belief[at] = _log_sum(both, 1)
        return np.exp(belief - _log_sum(belief, 1)[:, None]), joint


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


class Model:
    """Node weights (features, states) and edge weights (kind of the child, state of the parent, state)."""

    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights, edges

    def texts(self, pages: list[str | None]) -> list[str]:
        parsed = [parse(p or "") for p in pages]
        forest = Forest([nodes for nodes, _ in parsed])
        content = forest.marginals(self.weights, self.edges)[0][:, CONTENT]
        out = []
        for (nodes, pieces), start in zip(parsed, forest.starts, strict=False):
            bare = all(n.tag in ("body", "run") or not n.names and n.tag == "p" for n in nodes)  # nothing but text
            out.append("\n".join(t for i, t in pieces if bare and len(pieces) == 1 or content[start + i] > 0.5))
        return out

    def text(self, page: str) -> str:
        return self.texts([page])[0]


def train(pages: list[str]) -> Model:
    """Potentials of the greatest likelihood, less a penalty on their squares, of the labelled trees: the fixed and composed
    ones as one half, and ``pages``, as they are and stripped, as the other."""
    return _train(tuple(pages))


@lru_cache(maxsize=4)
def _train(pages: tuple[str, ...]) -> Model:
    rng = random.Random(8)
    fixed = [parse(p)[0] for p in [*LABELLED_PAGES * 4, *[compose(rng) for _ in range(COMPOSED)]]]
    states = [labels_given(n) for n in fixed]
    own = [(parse(p)[0], parse(stripped(p))[0]) for p in pages]
    own = [(a, y, b) for a, b in own if (y := labels_by_markup(a)) is not None]
    bare = [(b, labels_like(a, y, b)) for a, y, b in own]
    own = [(a, y) for a, y, _ in own] + [(b, y) for b, y in bare if y is not None]
    every, states = [*fixed, *[a for a, _ in own]], [*states, *[y for _, y in own]]
    mass = np.concatenate([np.full(len(n), (1 if k < len(fixed) else len(fixed) / len(own)) / len(n) ** 0.5) for k, n in enumerate(every)])
    forest, y = Forest(every), np.concatenate(states)
    mass /= mass.sum()
    child = forest.parent >= 0
    kinds, ups, here = forest.kind[child], y[forest.parent[child]], y[child]
    seen_edges = np.zeros((6, 3, 3))
    np.add.at(seen_edges, (kinds, ups, here), mass[child])
    one_hot, places = np.eye(3)[y], forest.rows[child].ravel()
    weights, edges = np.zeros((WIDTH, 3)), np.log((seen_edges + 1e-4) / (seen_edges + 1e-4).sum(axis=2, keepdims=True))
    edges[:, BOILERPLATE] = [-30.0, 0.0, -30.0]  # by its meaning, not trained
    size = weights.size
    theta, m, v = np.concatenate([weights.ravel(), edges.ravel()]), 0.0, 0.0
    for t in range(1, STEPS + 1):  # Adam
        weights, edges = theta[:size].reshape(weights.shape), theta[size:].reshape(edges.shape)
        p, joint = forest.marginals(weights, edges)
        off = mass[child, None] * (p - one_hot)[child]
        g_nodes = np.stack([np.bincount(places, np.repeat(off[:, k], len(GROUPS)), WIDTH) for k in range(3)], axis=1)
        g_edges = np.stack([np.bincount(kinds, joint[child, i, j] * mass[child], 6) for i in range(3) for j in range(3)], axis=1).reshape(6, 3, 3) - seen_edges
        g_edges[:, BOILERPLATE] = -PENALTY * edges[:, BOILERPLATE]
        g = np.concatenate([g_nodes.ravel(), g_edges.ravel()]) + PENALTY * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(theta[:size].reshape(weights.shape), theta[size:].reshape(edges.shape))


def labels_like(nodes: list[Node], states: list[int], bare: list[Node]) -> list[int] | None:
    """States of the stripped page by those of the page: their elements, other than runs, come in the same order."""
    one, two = ([i for i, n in enumerate(x) if n.tag != "run"] for x in (nodes, bare))
    if len(one) != len(two):
        return None
    text = [0] * len(bare)
    for i, j in zip(one, two, strict=True):
        text[j] = int(states[i] == CONTENT)
    return settle(bare, text)


def compose(rng: random.Random) -> str:
    """A labelled page of one of many layouts, drawn by ``rng``. Only numbers of words, stops and links count, not words."""
    words = lambda lo, hi: " ".join(["wo"] * rng.randint(lo, hi))
    sentence = lambda: words(3, 24) + rng.choice(["."] * 8 + ["!", "?"])
    prose = lambda lo=1, hi=5: " ".join(sentence() for _ in range(rng.randint(lo, hi)))
    links = lambda lo, hi, gap=" ": gap.join(f"<a>{words(1, 4)}</a>" for _ in range(rng.randint(lo, hi)))
    items = lambda lo, hi, f: "<ul>" + "".join(f"<li>{f()}</li>" for _ in range(rng.randint(lo, hi))) + "</ul>"
    named = rng.random() < 0.7  # else nothing tells the part of an element

    def part(label: int, inner: str, names: str, tags: str = "") -> str:
        """An element that a tag or a class or, in a page without names, nothing tells the part of."""
        tag, name = rng.choice(tags.split() or ["div"]), rng.choice(names.split())
        if not named:
            return f'<div data-label="{label}">{inner}</div>'
        way = rng.choice(["class", "id", "tag"] if tags else ["class", "id"])
        return f'<{tag} data-label="{label}">{inner}</{tag}>' if way == "tag" else f'<{rng.choice(["div", "div", "section", tag])} {way}="{name}" data-label="{label}">{inner}</div>'.replace("<section", "<div")

    menu = lambda: part(0, rng.choice([items(2, 8, lambda: links(1, 1)), links(2, 8), links(2, 6, " | ")]), "nav menu main-nav breadcrumb top-menu", "nav")
    head = lambda: part(0, f"<{rng.choice(['h1', 'p', 'div', 'h2'])}>{words(1, 4)}</{'p'}>" + rng.choice(["", f"<p>{words(2, 9)}</p>"]) + rng.choice(["", links(2, 5)]), "header site-header masthead", "header")
    advert = lambda: part(0, rng.choice([sentence(), f"<p>{sentence()}</p>", f"{sentence()} <a>{words(1, 3)}</a>"]), "ad ads banner advert sponsored promo")
    notice = lambda: part(0, f"<p>{prose(1, 3)}</p>", "cookie-notice consent alert popup newsletter gdpr-banner")
    foot = lambda: part(0, rng.choice([words(2, 8), f"<p>&copy; {words(1, 6)}</p>", links(1, 5), f"&copy; {words(2, 5)} {links(1, 3)}", f"<p>{sentence()}</p>{links(1, 2)}"]), "footer site-footer bottom legal", "footer")
    side = lambda: part(0, rng.choice([f"<h3>{words(1, 3)}</h3>", ""]) + rng.choice([items(2, 7, lambda: links(1, 1)), f"<p>{prose(1, 2)}</p>", f"<div>{prose(1, 2)}</div>{links(1, 3)}", "".join(f"<p>{links(1, 1)}</p>" for _ in range(3))]), "sidebar side-bar widget related", "aside")
    share = lambda: part(0, links(2, 4), "share social share-buttons tags")
    form = lambda: f'<form data-label="0"><p>{words(2, 8)}</p><label>{words(1, 2)}</label></form>'

    def comments() -> str:
        one = rng.choice(['<article{}>{}</article>', '<article{}>{}</article>', '<div{}>{}</div>', '<li{}>{}</li>'])
        each = lambda: one.format(rng.choice(["", "", ' class="comment"', ' class="reply"', ' class="post"']), rng.choice(["", f"<h4>{words(1, 2)}</h4>"]) + rng.choice([f"<p>{prose(1, 4)}</p>", prose(1, 4)]))
        inner = rng.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>"]).format(words(1, 2)) + "".join(each() for _ in range(rng.randint(1, 5)))
        return f'<{rng.choice(["section", "div"])} {rng.choice(["id", "class"])}="{rng.choice(["comments", "responses comments", "discussion"])}" data-label="0">{inner}</section></div>'

    style = rng.choice(["p", "p", "div", "mixed", "mixed", "bare"])  # of the article's blocks

    def block() -> str:
        kind = rng.choice({"p": "pppppph", "div": "ddddddh", "mixed": "pppdhulstqko", "bare": "bbbbh"}[style])
        if kind == "p":
            return f"<p>{rng.choice([prose, prose, prose, lambda: words(1, 4) + '.', lambda: prose(1, 2) + ' ' + links(1, 1)])()}</p>"
        if kind == "d":
            return f"<div>{rng.choice([prose, prose, sentence, lambda: f'<p>{prose()}</p>'])()}</div>"
        if kind == "b":
            return f"{prose()}<br><br>"
        if kind == "h":
            return f"<h2>{words(1, 6)}</h2>"
        if kind in "ul":
            return items(1, 12, rng.choice([sentence, lambda: words(1, 5), lambda: words(1, 3) + " " + links(1, 1)]))
        if kind == "s":
            return rng.choice(["", f"<h3>{words(1, 2)}</h3>"]) + items(1, 4, lambda: links(1, 1))  # sources
        if kind == "t":
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 6)}</td></tr>" for _ in range(rng.randint(1, 6))) + "</table>"
        if kind == "k":
            return f"<pre>{words(2, 12)}</pre>"
        return f"<blockquote><p>{prose(1, 2)}</p></blockquote>" if kind == "q" else f"<figure><figcaption>{words(2, 8)}</figcaption></figure>"

    blocks = [block() for _ in range(rng.choice([1, 2, 2, 3, 5, 8, 14, 30]))]
    home = rng.choice(["tag", "tag", "class", "box", "bare"]) if named else rng.choice(["box", "box", "bare", "two"])
    if home in ("tag", "class") and rng.random() < 0.3:  # an article of many like blocks, short ones or links
        one = rng.choice(["<div>{}</div>", "<p>{}</p>", "<ul><li>{}</li></ul>", "<h3>Wo</h3><p>{}</p>", "<div><p>{}</p></div>"])
        blocks = [one.format(rng.choice([words(1, 2), words(1, 4) + ".", links(1, 1)])) for _ in range(rng.choice([1, 4, 10, 25, 50]))]
        if one.startswith("<ul>"):
            blocks = ["".join(blocks).replace("</ul><ul>", "")]
    title = rng.choice(["", f"<h1>{words(1, 9)}</h1>", f"<h1>{words(1, 9)}</h1>", f"<h2>{words(1, 9)}</h2>"])
    if home == "bare" and style != "bare":  # directly in what holds the rest too
        title, *blocks = (re.sub(r"(?<=>)<(h\d|p|div|ul|table|blockquote|figure|pre)>|^<(h\d|p|div|ul|table|blockquote|figure|pre)>", lambda m: f'<{m[1] or m[2]} data-label="1">', b) for b in (title, *blocks))
    if named:
        for extra in rng.sample([advert, share, side, notice, form], rng.choice([0, 0, 1, 1, 2])):
            blocks.insert(rng.randint(1, len(blocks)), extra())
        if rng.random() < 0.2:
            blocks.append(comments())
    body = title + "".join(blocks)
    if home == "tag":
        tag = rng.choice(["article", "main", "article"])
        body = f'<{tag} data-label="1">{body}</{tag}>'
    elif home == "class":
        body = f'<{rng.choice(["div", "section"])} {rng.choice(["class", "id"])}="{rng.choice("content post-content story entry-content main article-body text".split())}" data-label="1">{body}</section></div>'
    elif home != "bare" or style == "bare":
        body = f'<div data-label="1">{body}</div>' if home != "two" else f'<div><div data-label="1">{body}</div></div>'
    before = [f() for f in rng.sample([menu, head, advert] + [notice] * named, rng.choice([0, 1, 2, 2, 3]))]
    after = [f() for f in rng.sample([foot, foot, menu] + [side, share, comments, notice, form] * named, rng.choice([0, 1, 1, 2, 3]))]
    layout = rng.random()
    if layout < 0.12:
        cells = [*before[:1], body, *after[:1]]
        return "<body><table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>" + "".join(after[1:]) + "</body>"
    wrap = rng.choice(["{}", "{}", "<div>{}</div>", '<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>'])
    return "<body>" + "".join(before[:1]) + wrap.format("".join([*before[1:], body, *after[1:]])) + "".join(after[:1]) + "</body>"


def extract_text(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Text is the main text: character references decoded, white space in a block made one space, blocks joined in
    page order by line feeds; empty if there is none, as for a null or empty page. Repeated rows give equal results.
    Other columns are not read. At most ``fit_pages`` pages of at most ``FIT_CHARS`` characters, in order of a hash, train the model.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    low = rows.where(F.length("html") <= FIT_CHARS).withColumn("low", F.lower("html"))
    marks = ("<article", "<main", "articlebody", "role=main", 'role="main', "role='main")
    named = low.where(reduce(lambda a, b: a | b, [F.col("low").contains(m) for m in marks]))
    ids = named.select("page_id", F.xxhash64("html").alias("h")).distinct().orderBy(F.xxhash64("page_id", "h"), "page_id").limit(fit_pages)
    sample = rows.withColumn("h", F.xxhash64("html")).join(F.broadcast(ids), ["page_id", "h"]).select("page_id", "h", "html").dropDuplicates(["page_id", "h"])
    model = pages.sparkSession.sparkContext.broadcast(train([r["html"] for r in sorted(sample.collect(), key=lambda r: (r["page_id"], r["h"]))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 2):
            found = model.value.texts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, SCHEMA)
