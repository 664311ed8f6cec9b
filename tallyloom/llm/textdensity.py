"""Main text of web pages by composite text density.

A page is read once into a flat list of nodes (parents before children), forgiving what is left open. Scripts, styles,
controls and hidden parts hold no text. Every other node gets its characters per tag, adjusted by how much of both is
links; a node's density sum adds up its block children's densities. The node with the largest sum is the core, the least
density on its path to the body is the threshold, and every node above the threshold marks the core of its own subtree.
The smallest subtree with all marked nodes is the region, widened to the article or main element that holds it.

Elements, roles and words of class and id are evidence, not verdicts: text of a part that they call a menu, header,
footer, sidebar, notice, advert, form or comments counts as link text, so that such a part is not dense, and a part of
the region goes if its density is below the threshold. Weak evidence (some word of a longer name, or one that names a
subject as often as a part) counts towards the choice of the region alone: whether such a part goes is decided by its
density as it stands. Headings and paragraphs have no evidence of their own. A part that holds most of the page's text is
a wrapper, and nothing speaks against it, unless what it leaves over reads as the article.

Without an article element, parts of the region ahead of its first and behind its last marked part are left out, but for
headings and for paragraphs beside marked ones.

Cases: null and empty pages, and pages without text, give an empty text; character references are decoded in each run
of text by itself, so that none arises across markup; nothing is recursive, so depth and length are free; repeated rows
are each extracted; extra columns are kept, but for one named text, which is replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import bound_batches

_MARK = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul caption option".split()
)
DEAD = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video math button select textarea input"
    " dialog title noembed noframes map".split()
)
PARTS = frozenset("nav footer aside menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name a part beside an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup menu"
    " nav navbar navigation breadcrumb breadcrumbs sidebar sidenav widget widgets related recommended recommendations"
    " share sharing social comment comments commentlist disqus respond replies footer copyright login search"
    " toolbar pagination pager paywall teaser teasers outbrain taboola disclaimer responses discussion reactions rail"
    " aside skip legal privacy adsbygoogle adbox adslot".split()
)
#: Those of NAMES that name a section of an article as often as a part beside it.
SUBJECTS = frozenset(
    "related search legal privacy social notice notices alert notification discussion responses replies reactions"
    " disclaimer comment copyright share sharing navigation banner promotion login recommended recommendations".split()
)
#: Words that say where or what kind of box a part is, not what it holds.
NEUTRAL = frozenset(
    "area bar bg block body bottom box btn button cell col column container content desktop entry fixed floating global"
    " grid group head heading holder icon in inline inner is item items js label layout left lg lower main md mobile"
    " module more outer page panel placeholder post primary reader readers region right row secondary section side"
    " single site slot sm sticky story the text title top unit upper user wrap wrapper xl your zone article list".split()
)
WITHOUT = frozenset("no without has".split())  # no-sidebar and has-sidebar name a part that is not there or inside
HEADS = frozenset("header topbar masthead".split())
OWN_HEADS = frozenset("article post entry story content main title".split())
#: What speaks against a node: nothing, some words, words alone, its element or role, that it is a form, that it is a
#: header, that it holds no text of the page at all.
NONE, WEAK, WORDS, ELEMENT, FORM, HEADER, NEVER = range(7)
CLOSES = {  # an element that starts closes these, up to the nearest of the second
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tr td th thead tbody tfoot", "table"),
    "option": ("option", "select"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
HOLDS_P = frozenset("article section div main aside td th li blockquote body html header footer nav form dd button table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre ul ol dl table figure".split())
#: So many characters outside links read as a text.
READABLE = 100


class Page:
    """Nodes of a page as parallel lists, and its texts in order as (node, text); text None is an end of a block."""

    def __init__(self, html: str):
        self.tag, self.parent, self.against, self.article = ["#"], [-1], [NONE], [False]
        self.texts: list[tuple[int, str | None]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, at, end = [0], 0, len(html)
        while at < end:
            lt = html.find("<", at)
            found = _MARK.match(html, lt) if lt >= 0 else None
            if lt > at:
                self.texts.append((stack[-1], html[at:lt]))
            if lt < 0:
                self.texts.append((stack[-1], html[at:]))
                break
            if not found:
                self.texts.append((stack[-1], "<"))
                at = lt + 1
                continue
            at = found.end()
            shut, name, rest = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if shut:
                self._close(stack, name)
                continue
            self._make_room(stack, name)
            node = self._open(stack[-1], name, rest)
            if name in BLOCK:
                self.texts.append((node, None))
            if name == "br":
                self.texts.append((stack[-1], " "))
            if name in VOID or rest.endswith("/") and name not in BLOCK:
                continue
            if name in RAW:
                shut_at = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                at = html.find(">", shut_at.start()) + 1 if shut_at else end
                at = at or end
                continue
            stack.append(node)

    def _open(self, parent: int, name: str, rest: str) -> int:
        self.tag.append(name)
        self.parent.append(parent)
        self.article.append(name in ("article", "main"))
        against = NEVER if name in DEAD else ELEMENT if name in PARTS else FORM if name == "form" else HEADER if name == "header" else NONE
        if rest and against in (NONE, HEADER, FORM) and name not in ("html", "body"):
            against = self._words(name, rest, against)
        self.against.append(against)
        return len(self.tag) - 1

    def _words(self, name: str, rest: str, against: int) -> int:
        """What role, class, id and style say of an element."""
        low = rest.lower()
        if not any(k in low for k in ("class", "id", "role", "hidden", "style")):
            return against
        said = {against}
        for k, *values in _ATTRIBUTE.findall(rest):
            k, value = k.lower(), "".join(values)
            if k in ("class", "id"):
                said |= {self._named({x.lower() for x in _PARTS.findall(one)}) for one in value.split()}
            elif k == "hidden" or k == "aria-hidden" and value.lower() == "true":
                return NEVER
            elif k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return NEVER
            elif k == "role" and value.lower() in ("main", "article"):
                self.article[-1] = True
            elif k == "role" and value.lower() in ROLES:
                said.add(ELEMENT)
            elif k == "role" and value.lower() == "form":
                said.add(FORM)
        if self.article[-1] or name == "p" or name in HEADINGS:
            return NONE
        return next((x for x in (ELEMENT, FORM, WORDS, HEADER, WEAK) if x in said), NONE)

    def _named(self, parts: set[str]) -> int:
        if not WITHOUT.isdisjoint(parts):
            return NONE
        if hits := NAMES & parts:
            whole = all(x in NEUTRAL or x.isdigit() for x in parts - hits)
            return WORDS if whole and not hits <= SUBJECTS else WEAK
        return HEADER if not HEADS.isdisjoint(parts) and OWN_HEADS.isdisjoint(parts) else NONE

    def _make_room(self, stack: list[int], name: str) -> None:
        closed, until = CLOSES.get(name, (frozenset(), frozenset()))
        if name in BLOCK:
            closed, until = closed | {"p"}, until | (HOLDS_P - closed)
        if closed:
            for i in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[i]]
                if tag in closed:
                    del stack[i:]
                    self.texts.append((stack[-1], None))
                    if name in BLOCK and tag != "p":
                        continue
                    break
                if tag in until:
                    break

    def _close(self, stack: list[int], name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == name:
                del stack[i:]
                break
        if name in BLOCK:
            self.texts.append((stack[-1], None))


def _composite(c: float, t: float, lc: float, lt: float, ratio: float) -> float:
    """Characters per tag, adjusted by links; ratio is that of link characters in the body."""
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)  # 1 without links
    links = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0))
    return c / t * (max(links, 1e-3) if lc < c else 0.0) / max(base, 1.0)


def _up(parent: list[int], values: list[int]) -> list[int]:
    """Sums over subtrees."""
    out = list(values)
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


def _unwrap(page: Page, own: list[int]) -> None:
    """Takes back what speaks against nodes that merely wrap the article; own holds each node's characters outside links.

    A wrapper has most of the text. An element told by its name must hold an article besides; any other may be told
    wrongly, unless the text that nothing speaks against is an article element, is headed and not much shorter, or reads
    as the article without it.
    """
    parent, against, article, n = page.parent, page.against, page.article, len(own)
    aside, under = [False] * n, [0] * n  # in a part told by its element; the nearest node that is spoken against
    for i in range(1, n):
        aside[i] = aside[parent[i]] or against[i] in (ELEMENT, NEVER)
        under[i] = i if against[i] else under[parent[i]]
    every, plain = _up(parent, own), _up(parent, [0 if a else x for a, x in zip(aside, own, strict=True)])
    articles = _up(parent, [int(a and x > 0) for a, x in zip(article, every, strict=True)])
    heads = _up(parent, [int(t == "h1" and x > 0) for t, x in zip(page.tag, every, strict=True)])
    # what belongs to each node that is spoken against and to no such node inside: characters, articles, first headings
    free, main, headed = [0] * n, [False] * n, [False] * n
    for i in range(n):
        if not aside[i] and every[i] > 0:
            free[under[i]] += own[i]
            main[under[i]] |= article[i]
            headed[under[i]] |= page.tag[i] == "h1"
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[parent[i]]
        if gone[i] or not against[i] or against[i] == NEVER:
            gone[i] |= against[i] == NEVER
            continue
        if against[i] == ELEMENT:
            wraps = articles[i] > 0 and 2 * every[i] > every[0]
        else:
            long = 10 * free[0] >= plain[i]
            alone = not heads[i] and not articles[i]
            reads = main[0] or headed[0] and (long or free[0] >= READABLE) or long and free[0] >= READABLE and alone
            wraps = 2 * plain[i] > plain[0] and not reads
        if wraps:
            against[i] = NONE
            free[0] += free[i]
            main[0] |= main[i]
            headed[0] |= headed[i]
        else:
            gone[i] = True


class _Density:
    """Composite densities of all nodes, where the text of some nodes counts as that of links."""

    def __init__(self, page: Page, own: list[int], as_link: list[bool]):
        n = len(own)
        parent = page.parent
        self.chars = _up(parent, own)
        self.linked = _up(parent, [x if k else 0 for x, k in zip(own, as_link, strict=True)])
        tags = _up(parent, [1] * n)
        links = _up(parent, [int(k) for k in as_link])
        ratio = self.linked[0] / max(self.chars[0], 1)
        self.of = [_composite(self.chars[i], max(tags[i] - 1, 1), self.linked[i], links[i], ratio) for i in range(n)]


def main_text(html: str | None) -> str:
    """The article of a whole page: blocks in page order, one a line."""
    if not html:
        return ""
    page = Page(html)
    tag, parent, against = page.tag, page.parent, page.against
    n = len(tag)
    never, link, inside = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        never[i] = never[parent[i]] or against[i] == NEVER
        link[i] = link[parent[i]] or tag[i] == "a"
        inside[i] = inside[parent[i]] or page.article[i]
        if inside[i] and against[i] == HEADER:  # it heads the article
            against[i] = NONE
    own = [0] * n
    for node, text in page.texts:
        if text is not None and not never[node]:
            own[node] += len(text.strip())
    if not any(own):
        return ""
    if any(against):
        _unwrap(page, [0 if k else x for k, x in zip(link, own, strict=True)])
    doubted = [False] * n
    for i in range(1, n):
        doubted[i] = doubted[parent[i]] or against[i] != NONE
    plain = _Density(page, own, link)
    shaped = _Density(page, own, [a or b for a, b in zip(link, doubted, strict=True)]) if any(doubted) else plain
    density = shaped.of
    if not density[0]:
        return ""
    block = [x in BLOCK for x in tag]
    for i in range(n - 1, 0, -1):
        block[parent[i]] |= block[i]
    total = [0.0] * n
    for i in range(1, n):
        total[parent[i]] += density[i] if block[i] else 0.0  # what is set inside a line is no part of its own
    best = list(range(n))  # of each subtree, the node with the largest sum
    for i in range(n - 1, 0, -1):
        if not never[i] and total[best[i]] > total[best[parent[i]]]:
            best[parent[i]] = best[i]
    core = best[0]
    threshold, i = density[0], core
    while i >= 0:
        threshold, i = min(threshold, density[i]), parent[i]
    marked = {core}
    alive = [True] * n
    for i in range(1, n):
        alive[i] = alive[parent[i]] and not never[i] and density[i] >= threshold
        if alive[i] and block[i]:
            marked.add(best[i])
    below = _up(parent, [int(i in marked) for i in range(n)])
    region = max(i for i in range(n) if below[i] == len(marked))
    whole = -1  # the outermost article (else main) around the region, else around the core
    for start in (region, core):
        i = start if whole < 0 else -1
        while i >= 0:
            if page.article[i] and (whole < 0 or tag[i] == "article" or tag[whole] != "article"):
                whole = i
            i = parent[i]
    region = whole if whole >= 0 else region
    within = [i == region for i in range(n)]
    for i in range(region + 1, n):
        within[i] = within[parent[i]]
    headless = region == 0 or tag[region] in ("body", "html")
    h1 = sum(tag[i] == "h1" and within[i] and against[i] == NONE and not doubted[i] for i in range(n))
    heads = _up(parent, [int(x == "h1") for x in tag])
    cut = [False] * n
    for i in range(1, n):
        odd = against[i]
        if odd == HEADER and not headless and not h1 and heads[i] or odd == WEAK and not h1 and heads[i]:
            odd = NONE  # it holds the only heading
        thin = (plain if odd == WEAK else shaped).of[i] < threshold
        cut[i] = cut[parent[i]] or odd == NEVER or odd != NONE and thin and i != region
    if whole < 0:
        _trim(page, region, below, marked, plain, threshold, within, cut)
        for i in range(parent[region] + 1, region) if region else ():  # headings beside the region, ahead of it
            if parent[i] == parent[region] and tag[i] in HEADINGS:
                within[i] = True
            else:
                within[i] = within[parent[i]] and i != region
        within[0] = region == 0
    lines: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(pieces).split()):
            lines.append(line)
        pieces.clear()

    for node, text in page.texts:
        if text is None:
            flush()
        elif within[node] and not cut[node]:
            pieces.append(entities.unescape(text))
    flush()
    return "\n".join(lines)


def _trim(page: Page, region: int, below: list[int], marked: set[int], plain: _Density, threshold: float, within: list[bool], cut: list[bool]) -> None:
    """Cuts children of a region that stand outside its marked ones, and those that are lists of links."""
    tag, parent = page.tag, page.parent
    children = [i for i in range(region + 1, len(tag)) if parent[i] == region and not cut[i] and plain.chars[i]]
    kept = [i for i in children if below[i]]
    first, last = (kept[0], kept[-1]) if kept else (-1, len(tag))
    headed = _up(parent, [int(x in HEADINGS) for x in tag])
    prose = False  # behind, so that a heading leads into it
    for i in reversed(children):
        if below[i] or tag[i] not in BLOCK:
            continue
        prose |= tag[i] in PROSE
        listed = 2 * plain.linked[i] >= plain.chars[i] and plain.of[i] < threshold and tag[i] not in HEADINGS
        ahead, behind = i < first and not headed[i], i > last and not (prose and tag[i] in HEADINGS)
        cut[i] = listed or (ahead or behind) and tag[i] not in PROSE
    for i in range(region + 1, len(tag)):
        if within[i]:
            cut[i] |= cut[parent[i]]


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the column `text` (main text) in place of the html."""
    bound_batches(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html, "text")]
    schema = pages.select(*others).schema.add("text", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, "text"])

    return pages.select(*others, html).mapInArrow(work, schema)
