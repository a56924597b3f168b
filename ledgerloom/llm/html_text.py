"""Op 1: main text from HTML by block features and a decision tree.

A page is cut into flat text blocks at block-level tags. A block is described by its
words and link density, those of the blocks before and after and of all blocks in its
container, whether these neighbours share the container, how it ends, and what tags
and names say of its surroundings. A decision tree over these features, grown on a
small labelled table, says which blocks are main text. In half of the table's pages
nothing is named, so that words and links of neighbours have to decide.

The table is ``LABELLED``, fixed page fragments, and pages that ``labelled_pages``
puts together from typical parts by rule. The tree is grown once on the driver and
sent to the tasks; pages are then independent of each other. A page is tokenised in one
pass and its open elements are found by counts, so cost and memory are linear in its
length, for very long pages too.

Defined cases: null or empty html, and html without a main block, give the empty
string; unclosed and unknown tags, cut-off pages and plain text are read as far as
they go; character references are decoded as HTML5 says, also without semicolon; a
tie in a leaf of the tree counts as main text; repeated rows give repeated results; an
empty table gives an empty one; only page_id, url and html are read, so other columns
may have any names.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map

# HTML's tag classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul title head".split()
)
SILENT = frozenset("script style noscript template svg math iframe object head title textarea select option datalist canvas audio video".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A tag of the left closes an open one of the middle, unless one of the right stands between them.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",)),
}
P_CLOSERS = frozenset(BLOCK - {"button", "caption", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "head", "title", "legend", "option", "summary"})
INLINE_SCOPE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var".split())

# Words in tag, role, class and id names that give a part of a page its role.
AWAY_TAGS = frozenset("nav footer aside form menu button search dialog".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Beginnings of the first or last part of a name, then whole names.
AWAY_PARTS = (
    "nav", "menu", "breadcrumb", "foot", "sidebar", "aside", "widget", "advert", "banner", "sponsor", "promo", "cookie", "consent", "gdpr", "notice", "alert", "modal",
    "popup", "overlay", "comment", "discuss", "disqus", "respond", "replies", "reply", "share", "sharing", "social", "related", "recommend", "newsletter", "subscri",
    "signup", "login", "search", "pagination", "pager", "toolbar", "masthead", "copyright", "disclaimer", "skip",
)
AWAY_WHOLE = frozenset("ad ads tag tags toc side form ad-box ad-slot ad-unit tag-list post-tags".split())
#: Names that begin so tell of the page, not of the part.
ABOUT = frozenset("has with no is not without".split())
MAIN_PARTS = frozenset("article content main post story entry body text".split())
LEGAL = re.compile(r"©|\(c\) ?\d{4}|\bcopyright\b|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|.""", re.DOTALL)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int  #: words inside links
    tag: str
    container: int  #: number of the element that holds it and its like
    away_tag: bool  #: inside a part whose tag or role is not main text's
    away_name: bool  #: inside a part that is named as something else
    inside: bool  #: inside an article or main part


def _names(value: str) -> tuple[bool, bool]:
    """(away, main) that a class or id says."""
    away = main = False
    for name in value.lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if not parts or parts[0] in ABOUT:
            continue
        away |= "-".join(parts) in AWAY_WHOLE or any(x.startswith(AWAY_PARTS) for x in {parts[0], parts[-1]})
        main |= parts[0] in MAIN_PARTS or parts[-1] in MAIN_PARTS
    return away, main


def _role(tag: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """(away by tag, away by name, main, silent) that a start tag gives to what it holds."""
    away, named, main, silent = tag in AWAY_TAGS, False, tag in ("article", "main"), tag in SILENT
    for m in _ATTR.finditer(attributes) if attributes else ():
        name, value = (m[1] or "").lower(), (m[2] or "").strip("\"'").lower()
        if name == "role":
            away |= value in AWAY_ROLES
            main |= value in ("main", "article")
        elif name in ("class", "id"):
            a, b = _names(value)
            named |= a and tag not in ("html", "body", "article", "main")
            main |= b and not a and tag in ("div", "section", "td")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            silent = True
    return away, named, main, silent


#: Elements that hold one block each; the blocks of a container are those whose nearest other block element it is.
SINGLE = frozenset("p li dt dd td th tr caption legend summary figcaption button ul ol dl tbody thead tfoot pre blockquote hgroup".split()) | HEADINGS


def blocks_of(page: str | None) -> list[Block]:
    """The page's text blocks in order, without those of scripts, styles, forms' fields and hidden parts."""
    out: list[Block] = []
    if not page:
        return out
    # An entry holds: tag, away by tag, by name, main, silent, all as they add up from the root; nearest block tag; container.
    stack: list[tuple[str, bool, bool, bool, bool, str, int]] = [("", False, False, False, False, "body", 0)]
    n_containers = 0
    parts: list[str] = []
    linked: list[str] = []
    opened: dict[str, int] = {}
    in_link = 0
    block_tag = "body"
    mark: tuple[int, bool, bool, bool] = (0, False, False, False)

    def flush():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                n = text.count(" ") + 1
                k = len(entities.unescape(" ".join(linked)).split()) if linked else 0
                out.append(Block(text, n, min(k, n), block_tag, *mark))
        parts, linked = [], []

    def say(raw: str):
        nonlocal block_tag, mark
        _, away, named, main, silent, nearest, container = stack[-1]
        if silent or not raw:
            return
        if not parts:
            if raw.isspace():
                return
            block_tag = nearest
            mark = (container, away, named, main)
        parts.append(raw)
        if in_link:
            linked.append(raw)

    def pop_to(i: int):
        nonlocal in_link
        for s in stack[i:]:
            in_link -= s[0] == "a"
            opened[s[0]] -= 1
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:].removesuffix("<"))  # a tag cut off at its beginning
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                say(" ")
                continue
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0) if opened.get(tag) else 0
            if tag in BLOCK:
                flush()
            if i and (tag in BLOCK or tag in SILENT or all(s[0] not in BLOCK for s in stack[i + 1 :])):
                pop_to(i)
            continue
        attributes = m[3] or ""
        if tag in BLOCK:
            flush()
            # An open p ends here if no other block stands above it, whatever inline elements do.
            if tag in P_CLOSERS and opened.get("p") and stack[-1][5] == "p":
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"))
            ends, walls = CLOSES.get(tag, ((), ()))
            if any(opened.get(x) for x in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        pop_to(i)
                        break
                    if stack[i][0] in walls:
                        break
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                say(" " if tag != "wbr" else "")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else n
            close = page.find(">", at)
            at = n if close < 0 else close + 1
            continue
        if attributes.endswith("/") and tag not in BLOCK and tag not in INLINE_SCOPE:
            continue
        away, named, main, silent = _role(tag, attributes)
        _, a, b, c, d, nearest, container = stack[-1]
        # A page-level header is away; one inside an article holds its title.
        if tag == "header":
            away |= not c
        in_link += tag == "a"
        opened[tag] = opened.get(tag, 0) + 1
        if tag in BLOCK:
            nearest = tag
            if tag not in SINGLE:
                n_containers += 1
                container = n_containers
        stack.append((tag, a or away, b or named, c or main, d or silent, nearest, container))
    flush()
    return out


FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "container_words", "container_link_density",
    "container_before", "container_after", "heading", "list_item", "sentence_end", "legal", "away_tag", "away_name", "inside", "page_has_inside",
)


def features_of(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    words, linked = np.array([b.words for b in blocks], float), np.array([b.linked for b in blocks], float)
    density = linked / words
    place = np.unique([b.container for b in blocks], return_inverse=True)[1]
    held, held_linked = np.bincount(place, words)[place], np.bincount(place, linked)[place]
    nothing = np.zeros(1)
    before, after = (lambda x: np.concatenate([nothing, x[:-1]])), (lambda x: np.concatenate([x[1:], nothing]))
    same = np.concatenate([nothing, place[1:] == place[:-1], nothing])
    has = float(any(b.inside and not (b.away_tag or b.away_name) for b in blocks))
    flags = np.array([(
        b.tag in HEADINGS, b.tag in ("li", "dt", "dd", "td", "th"), b.text[-1] in ".!?:;\"'»”’…。", b.words < 40 and bool(LEGAL.search(b.text)), b.away_tag, b.away_name, b.inside, has,
    ) for b in blocks], float)
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), held, held_linked / held, same[:-1], same[1:], flags])


# The labelled table. A page fragment, then for its blocks in order 1 (main text) or 0.
_LONG = "The river rose for three days before the old bridge gave way, and nobody in the village had slept since the first warning came over the radio."
_LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "About us", "Contact"))
LABELLED: tuple[tuple[str, str], ...] = (
    (f"<nav><ul>{_LINKS}</ul></nav><div class='ad'>Buy two, get one free today.</div><article><h1>Bridge falls</h1><p>{_LONG}</p><p>Short one.</p></article><footer>&copy; Example</footer>", "00000" + "0" + "111" + "0"),
    (f"<header><a href='/'>The Paper</a><p>Daily since 1901.</p></header><main><h1>Title</h1><p>{_LONG}</p><p>{_LONG}</p><h2>Part</h2><p>End.</p></main><aside><p>{_LONG}</p></aside>", "00" + "11111" + "0"),
    (f"<div><p>{_LONG}</p><p>{_LONG}</p><p>He left.</p><p>{_LONG}</p></div><div><a href='#'>Next story</a> <a href='#'>Previous story</a></div>", "1111" + "0"),
    (f"<ul>{_LINKS}</ul><h1>A walk</h1><p>{_LONG}</p><ul><li>{_LONG}</li><li>{_LONG}</li></ul><p>All rights reserved</p>", "00000" + "1111" + "0"),
    (f"<article><h1>Tea</h1><p>Boil water.</p><p>Wait.</p><ul><li>One cup</li><li>Two spoons</li></ul><div class='share'><a href='#'>Share</a></div><section class='comments'><p>{_LONG}</p><p>I agree.</p></section></article>", "11111" + "0" + "00"),
    (f"<div id='cookie-notice'><p>{_LONG}</p></div><div class='content'><p>{_LONG}</p><p>So it was.</p></div><div class='sidebar'><h3>Related</h3><p>{_LONG}</p></div>", "0" + "11" + "00"),
    (f"<form><p>Your name and your address, so that we can write to you about what is new in the shop.</p></form><article><p>{_LONG}</p><p><a href='/map'>The whole valley</a></p></article>", "0" + "11"),
    (f"<table><tr><td><a href='/a'>One</a></td><td><a href='/b'>Two</a></td></tr></table><h2>Report</h2><p>{_LONG}</p><p>{_LONG} <a href='/c'>More here</a></p><p>Contact us</p>", "00" + "111" + "0"),
    (f"<p>{_LONG}</p>", "1"),
    ("<p>One sentence is all there is here.</p>", "1"),
    ("Three words only", "1"),
    ("<h1>Note</h1><p>Come at noon.</p>", "11"),
    (f"<h1>Walls</h1><p>{_LONG}</p><p>The end.</p>", "111"),
    (f"<article><p>{_LONG}</p><pre>a b</pre></article>", "11"),
    (f"<div><p>{_LONG}</p></div><p>All rights reserved.</p>", "1" + "0"),
    (f"<div><p>{_LONG}</p><p>{_LONG}</p></div><div><p>&copy; 2024 The Paper</p></div>", "11" + "0"),
    (f"<table><tr><td class='sidebar'><table><tr><td>{_LONG}</td></tr></table></td><td><p>{_LONG}</p><p>{_LONG}</p></td></tr></table>", "0" + "11"),
    (f"<section role='main'><h1>Fire</h1><p>Two dead.</p></section><div role='complementary'><p>{_LONG}</p></div><div role='contentinfo'>Imprint</div>", "11" + "0" + "0"),
    (f"<div class='menu'><a href='/x'>Start</a></div><p>{_LONG}</p><p>{_LONG}</p><div class='newsletter'>Get our letter every week.</div>", "0" + "11" + "0"),
    ("<article><p>Why?</p><p>Because.</p><h2>Then</h2><p><a href='/z'>See the list</a></p></article><div>Login</div>", "1111" + "0"),
    ("<a href='/1'>One</a> <a href='/2'>Two</a> <a href='/3'>Three</a>", "0"),
)


#: Parts of generated pages that are not main text: the tag and the names that pages give them. Comments are always named: nothing else tells them.
_JUNK = {
    "menu": ("nav", ("menu", "main-nav", "topbar")), "header": ("header", ("masthead", "site-header")), "crumbs": ("nav", ("breadcrumbs",)), "ad": ("aside", ("ad", "advert", "promobox")),
    "sidebar": ("aside", ("sidebar", "widget-area", "side")), "cookies": ("dialog", ("cookie-notice", "consent")), "share": ("div", ("share-buttons", "social")),
    "related": ("aside", ("related", "recommended-posts")), "comments": ("section", ("comments", "comment-list", "discussion", "replies")), "letter": ("form", ("newsletter", "subscribe-box")),
    "form": ("form", ("contact-form",)), "legal": ("footer", ("footer", "copyright")), "footer": ("footer", ("footer", "site-footer")),
}


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, str]]:
    """Pages put together by rule, with the labels of their blocks as in LABELLED; of every two one names its parts, the other names few."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("bdfglmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4))) for _ in range(400)]
    say = lambda a, b: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(a, b + 1)))
    sentence = lambda a, b: say(a, b).capitalize() + rnd.choice(".....!?")
    link = lambda a, b: f"<a href='/{rnd.randrange(999)}'>{say(a, b)}</a>"

    def body(kind: str) -> list[str]:
        """The blocks of a part, as elements."""
        many = lambda f, a, b: [f() for _ in range(rnd.randrange(a, b + 1))]
        if kind in ("menu", "crumbs", "share"):
            return ["<ul>" + "".join(many(lambda: f"<li>{link(1, 3)}</li>", 2, 8)) + "</ul>"] if rnd.random() < 0.7 else [" ".join(many(lambda: link(1, 2), 2, 8))]
        if kind == "header":
            return [f"<div>{link(1, 3)}</div>", f"<p>{sentence(2, 6)}</p>"][: rnd.randrange(1, 3)]
        if kind == "ad":
            return [f"<p>{sentence(3, 20)}</p>"]
        if kind == "sidebar":
            return [f"<h3>{say(1, 3)}</h3>", *many(lambda: rnd.choice([f"<p>{sentence(8, 40)}</p>", f"<p>{link(2, 6)}</p>"]), 1, 4)]
        if kind == "related":
            return [f"<h4>{say(1, 2)}</h4>", *many(lambda: f"<p>{link(3, 9)}</p>", 2, 5)]
        if kind == "cookies":
            return [f"<p>{sentence(8, 30)} {link(1, 3)}</p>", f"<button>{say(1, 2)}</button>"]
        if kind == "comments":
            return [x for _ in range(rnd.randrange(1, 5)) for x in (f"<h5>{say(1, 2)}</h5>", f"<p>{sentence(3, 50)}</p>")]
        if kind in ("letter", "form"):
            return [f"<p>{sentence(4, 14)}</p>", f"<label>{say(1, 2)}</label>"]
        if kind == "legal":
            return [f"<p>{rnd.choice(['&copy; 2024 ', 'Copyright ', ''])}{say(1, 4)}. All rights reserved.</p>"]
        return [f"<p>{link(1, 2)} {link(1, 2)} {link(1, 3)}</p>", f"<p>&copy; {say(1, 5)}</p>"][rnd.randrange(2) :]

    def count(parts: list[str]) -> int:
        return len(blocks_of("".join(parts)))

    out = []
    for k in range(n):
        named = k % 2 == 0

        def junk(kind: str) -> tuple[str, str]:
            inner = body(kind)
            tag, names = _JUNK[kind]
            if kind == "comments" or named and rnd.random() < 0.5:
                start, end = f"<div class='{rnd.choice(names)}'>", "</div>"
            elif named or kind in ("sidebar", "ad", "cookies", "letter", "form"):  # flat features do not tell these from text
                start, end = f"<{tag}>", f"</{tag}>"
            else:
                start, end = "<div>", "</div>"
            return start + "".join(inner) + end, "0" * count(inner)

        main = [f"<h1>{say(2, 9)}</h1>"] * (rnd.random() < 0.9)
        for _ in range(rnd.randrange(1, 9)):
            x = rnd.random()
            if x < 0.55:
                main.append(f"<p>{sentence(12, 90)}</p>")
            elif x < 0.68:
                main.append(f"<p>{sentence(1, 6)}</p>")
            elif x < 0.76:
                main += [f"<h2>{say(1, 5)}</h2>", f"<p>{sentence(10, 60)}</p>"]
            elif x < 0.84:
                main.append("<ul>" + "".join(f"<li>{say(1, 14)}</li>" for _ in range(rnd.randrange(2, 6))) + "</ul>")
            elif x < 0.9:
                main.append(f"<p>{sentence(8, 40)} {link(1, 4)} {sentence(8, 40)}</p>")
            elif x < 0.94:
                main.append(f"<p>{link(2, 5)}</p>" if len(main) > 1 and named else f"<blockquote>{sentence(4, 30)}</blockquote>")
            else:
                main.append(rnd.choice([f"<pre>{say(1, 5)}</pre>", f"<table><tr><td>{say(1, 3)}</td><td>{say(1, 4)}</td></tr></table>"]))
        main.append(f"<p>{sentence(10, 60)}</p>") if rnd.random() < 0.6 else main.append(f"<p>{sentence(1, 5)}</p>" if len(main) > 2 else f"<p>{sentence(20, 50)}</p>")
        before = [junk(x) for x in rnd.sample(["menu", "header", "crumbs", "ad", "cookies"], rnd.randrange(0, 4))]
        after = [junk(x) for x in rnd.sample(["sidebar", "share", "related", "comments", "letter", "form", "ad"], rnd.randrange(0, 4))]
        after += [junk(x) for x in rnd.sample(["legal", "footer", "menu"], rnd.randrange(0, 3))]
        start, end = rnd.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post tag-news'>", "</div>")] if named else [("<div>", "</div>"), ("<section>", "</section>"), ("<div class='x has-sidebar'>", "</div>")])
        inside = junk("share") if rnd.random() < 0.2 else junk("ad") if rnd.random() < 0.15 else ("", "")
        text = start + "".join(main) + inside[0] + end
        marks = "1" * count(main) + inside[1]
        if rnd.random() < 0.15:  # what a named article holds is its own; elsewhere the line is the page's
            text, marks = text.removesuffix(end) + body("legal")[0] + end, marks + ("1" if named else "0")
        if named and rnd.random() < 0.2:
            text, marks = start + rnd.choice(["<h1>All rights reserved.</h1>", *body("legal")]) + text.removeprefix(start), "1" + marks
        out.append(("".join(x for x, _ in before) + text + "".join(x for x, _ in after), "".join(m for _, m in before) + marks + "".join(m for _, m in after)))
    return out


@dataclass
class Tree:
    """A leaf has a verdict; a node sends rows with feature <= limit to the left."""

    verdict: bool | None = None
    feature: int = 0
    limit: float = 0.0
    left: "Tree | None" = None
    right: "Tree | None" = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.verdict is not None:
            return np.full(len(x), self.verdict)
        low = x[:, self.feature] <= self.limit
        out = np.empty(len(x), bool)
        out[low] = self.left.predict(x[low])
        out[~low] = self.right.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 3) -> Tree:
    """CART by Gini impurity; ties go to the first feature and the lowest limit."""
    p = y.mean()
    if depth == 0 or p in (0.0, 1.0) or len(y) < 2 * least:
        return Tree(bool(p >= 0.5))
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(v))
        ones = np.cumsum(t)[:-1]
        may = (v[1:] > v[:-1]) & (n >= least) & (len(v) - n >= least)
        if may.any():
            a, b = ones / n, (t.sum() - ones) / (len(v) - n)
            cost = np.where(may, n * a * (1 - a) + (len(v) - n) * b * (1 - b), np.inf)
            k = int(cost.argmin())
            if best is None or cost[k] < best[0] - 1e-12:
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
    if best is None or best[0] >= len(y) * p * (1 - p) - 1e-12:
        return Tree(bool(p >= 0.5))
    _, f, limit = best
    low = x[:, f] <= limit
    return Tree(None, f, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


#: Generated pages in the labelled table.
TABLE_PAGES = 400
#: How often a fixed fragment counts.
FRAGMENT_WEIGHT = 8


def used(tree: Tree) -> set[str]:
    """The features that a tree asks for."""
    return set() if tree.verdict is not None else {FEATURES[tree.feature]} | used(tree.left) | used(tree.right)


@cache
def default_tree() -> Tree:
    rows, marks = [], []
    for page, labels in (*LABELLED * FRAGMENT_WEIGHT, *labelled_pages(TABLE_PAGES)):
        blocks = blocks_of(page)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(blocks)} blocks, {len(labels)} labels: {page[:60]}")
        rows.append(features_of(blocks))
        marks += [float(c) for c in labels]
    return grow(np.concatenate(rows), np.array(marks))


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = tree.predict(features_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row."""
    tree = tree or default_tree()
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(t, tree) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).transform(
        arrow_map, run, f"page_id {kind}, url string, text string, n_chars bigint"
    )
