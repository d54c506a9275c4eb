"""Main text of web pages by tree scoring.

The markup is read into a tree of blocks. Every paragraph-like block passes points, one plus
one per comma plus one per hundred characters up to three, to its parent in full, to the next
ancestor by half, to those above by ever smaller parts; a container's score is discounted by
its link density. The best container is kept with those siblings that score like it or read
like prose. Navigation, footers, sidebars, forms and anything hidden never enters the tree, nor
does a header outside an article. A class or id speaks of an advert, a notice or comments where
all its words do (``cookie-notice``, not ``notice-period``; ``has-sidebar`` says what a wrapper
holds, not what it is): such a block is left out. One that a wrapper may be called by too, like
``widget``, stays where it holds most of the page's own text.
Work grows with the length of a page, however deep or broken its tags are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

# Element names and words of class and id attributes, by their role.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form header menu dialog button select fieldset head".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt figcaption h1 h2 h3 h4 h5 h6 hr html "
    "figure li main ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split()
)
CONTAINERS = frozenset("article main section div body td center details".split())
# A new one of these ends an open one of the named kinds, within the nearest container.
ENDS_PARAGRAPH = BLOCKS | BOILERPLATE
SIBLINGS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table".split())
# Levels that a missing end tag is looked for, and that points climb to; further up both are nothing.
REACH = 30
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disqus footer header masthead menu modal nav navbar navigation newsletter notice pager pagination popup "
    "promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
# Words that stand beside them in such a name and do not change what it says.
BESIDE = frozenset(
    "site page main top bottom left right side box bar list item items wrap wrapper container section area block "
    "slot unit inner outer buttons button links link icons group thread form primary secondary global mobile sticky "
    "fixed google gdpr posts articles stories".split()
)
# Of these a wrapper of the article may be called; the others never name one, however long they are.
WRAPPERS = frozenset("banner header masthead modal notice popup promo related share sharing sidebar widget".split())
STATES = frozenset("has no with without is not hide show toggle".split())
NAME_PARTS = re.compile(r"[-_]+")
UNWANTED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split()
)

TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SENTENCE_END = re.compile(r"[.!?…。]\s*$|[.!?]\s")


class Node:
    __slots__ = ("name", "parent", "children", "score", "skip", "doubt")

    def __init__(self, name: str, parent: Node | None, skip: bool, doubt: bool = False):
        self.name, self.parent, self.skip, self.doubt = name, parent, skip, doubt
        self.children: list = []  # nodes, or (text, in_link)
        self.score = 0.0


def _unwanted(value: str) -> str:
    """What a class or id says: "" nothing, "doubt" an unwanted part, "always" in any amount."""
    said = ""
    for name in value.split():
        parts = [p for p in NAME_PARTS.split(name) if p]
        if not parts or parts[0] in STATES or not UNWANTED.intersection(parts):
            continue
        if all(p in UNWANTED or p in BESIDE or p.isdigit() for p in parts):
            if not UNWANTED.intersection(parts) <= WRAPPERS:
                return "always"
            said = "doubt"
    return said


def _hidden(name: str, attributes: str) -> str:
    """Whether a block is left out: "" no, "doubt" unless it is most of the page, "always"."""
    if name in BOILERPLATE:
        return "always"
    said = ""
    if not attributes.strip():
        return said
    for match in ATTRIBUTE.finditer(attributes):
        key = match.group(1).lower()
        value = html.unescape(match.group(2) or match.group(3) or match.group(4) or "").lower()
        if key in ("class", "id") and name not in ("body", "html", "article", "main"):
            found = _unwanted(value)
            if found == "always":
                return found
            said = said or found
        if key == "role" and value in UNWANTED_ROLES:
            return "always"
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return "always"
        if key == "style" and HIDING.search(value):
            return "always"
    return said


def parse(page: str) -> Node:
    """A tree of blocks and text; unclosed and misplaced tags are mended as browsers do."""
    root = Node("html", None, False)
    here, links, position = root, 0, 0
    still: dict[str, int] = {"html": 1}  # how many of each name are open

    def leave(node: Node) -> Node:
        """Close everything from here up to ``node``; its parent."""
        inner = here
        while inner is not node:
            still[inner.name] -= 1
            inner = inner.parent
        still[node.name] -= 1
        return node.parent

    def say(text: str) -> None:
        if text and not here.skip:
            here.children.append((text, links > 0))

    while True:
        match = TAG.search(page, position)
        if match is None:
            say(page[position:])
            return root
        say(page[position : match.start()])
        position = match.end()
        if match.group(2) is None:
            continue
        name = match.group(2).lower()
        if match.group(1):
            if name == "a":
                links = max(0, links - 1)
            elif name == "br":
                say("\n")
            elif (name in BLOCKS or name in BOILERPLATE) and still.get(name):
                node = here
                while node.name != name:
                    node = node.parent
                if node.parent is not None:
                    here, links = leave(node), 0
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, position)
            closed = match.group(3).rstrip().endswith("/") and name in ("svg", "math")
            if not closed:
                position = end.end() if end else len(page)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                say("\n")
            continue
        if name == "a":
            links = 1
        if name not in BLOCKS and name not in BOILERPLATE:
            if _hidden(name, match.group(3)) and not here.skip:  # in doubt as well: a part of a line
                # A hidden inline part ends with its own tag.
                end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, position)
                position = end.end() if end else len(page)
                links = 0 if name == "a" else links
            continue
        if name in ENDS_PARAGRAPH and here.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and here.parent:
            here, links = leave(here), 0
        if name in SIBLINGS and any(still.get(other) for other in SIBLINGS[name]):
            node, steps = here, 0
            while node.parent is not None and node.name not in SCOPES and steps < REACH:
                if node.name in SIBLINGS[name]:
                    here, links = leave(node), 0
                    break
                node, steps = node.parent, steps + 1
        if name in ("html", "body"):
            continue
        said = _hidden(name, match.group(3))
        if name == "header" and (still.get("article") or still.get("main")):
            said = ""
        node = Node(name, here, here.skip or said == "always", said == "doubt")
        still[name] = still.get(name, 0) + 1
        here.children.append(node)
        here = node


def blocks_of(node: Node) -> list[tuple[Node, str, int]]:
    """Runs of text in page order with their block and the characters inside links."""
    found: list[tuple[Node, str, int]] = []
    stack: list = [(node, iter(node.children), [], [0])]
    while stack:
        block, rest, run, linked = stack[-1]
        child = next(rest, None)
        if child is None or isinstance(child, Node):
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    found.append((block, text, linked[0]))
                run.clear()
                linked[0] = 0
            if child is None:
                stack.pop()
            elif not child.skip:
                stack.append((child, iter(child.children), [], [0]))
        else:
            run.append(child[0])
            linked[0] += len(child[0]) if child[1] else 0
    return found


def without_doubtful(root: Node) -> None:
    """Leave out blocks whose names say they are not the article, save one that holds most of it."""
    own: dict[int, int] = {}
    line, order = [root], []
    while line:
        node = line.pop()
        if node.skip:
            continue
        order.append(node)
        own[id(node)] = sum(len(c[0].strip()) for c in node.children if not isinstance(c, Node) and not c[1])
        line += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order[1:]):
        own[id(node.parent)] += own[id(node)]
    for node in order:
        if node.doubt and 2 * own[id(node)] <= own[id(root)]:
            node.skip = True


def main_text(page: str) -> str:
    """The blocks of the best container and of siblings like it, joined by one space."""
    root = parse(page)
    without_doubtful(root)
    blocks = blocks_of(root)
    if not blocks:
        return ""
    scores: dict[int, float] = {}
    amounts: dict[int, list[int]] = {}
    nodes: dict[int, Node] = {}
    met: list[Node] = []  # every block with text somewhere below, parents before children
    for block, text, linked in blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        share, node = 1.0, block if block.name in CONTAINERS or block.parent is None else block.parent
        line, new = block, []
        while line is not None and id(line) not in amounts:
            amounts[id(line)] = [0, 0]
            nodes[id(line)] = line
            new.append(line)
            line = line.parent
        met += reversed(new)
        amounts[id(block)][0] += len(text)
        amounts[id(block)][1] += linked
        depth = 0
        while node is not None and depth < REACH:
            scores[id(node)] = scores.get(id(node), 0.0) + points * share
            depth += 1
            share = 1 / 2 if depth == 1 else 1 / (3 * depth)
            node = node.parent
    for node in reversed(met):
        if node.parent is not None:
            above = amounts[id(node.parent)]
            above[0] += amounts[id(node)][0]
            above[1] += amounts[id(node)][1]
    density = {k: min(1.0, b / a) for k, (a, b) in amounts.items()}
    final = {k: s * (1 - density[k]) for k, s in scores.items()}
    best = max(final, key=lambda k: (final[k], -len(final)))
    top = nodes[best]
    # A container whose parent has nothing else of weight stands for it; lists and tables too.
    chosen = {best}
    if top.parent is not None:
        bar = max(3.0, 0.2 * final[best])
        texts: dict[int, list[str]] = {}
        for block, text, _ in blocks:
            texts.setdefault(id(block), []).append(text)
        for child in top.parent.children:
            if not isinstance(child, Node) or id(child) == best or id(child) not in amounts:
                continue
            size, _ = amounts[id(child)]
            like = final.get(id(child), 0.0) >= bar
            own = " ".join(texts.get(id(child), [])) if child.name not in CONTAINERS else ""
            prose = bool(own) and (
                (size > 80 and density[id(child)] < 0.25)
                or (density[id(child)] == 0 and bool(SENTENCE_END.search(own)))
                or child.name in ("h1", "h2", "h3")
            )
            if like or prose:
                chosen.add(id(child))
    kept: set[int] = set()
    for node in met:
        if id(node) in chosen or (node.parent is not None and id(node.parent) in kept):
            kept.add(id(node))
    return " ".join(text for block, text, _ in blocks if id(block) in kept)


def extracted(df: DataFrame, page: Column) -> Column:
    """The main text of every whole page; empty for a null page and where there is no text.

    Character references are decoded, white space within a block becomes one space. Repeated
    rows give repeated texts; pages of one block are that block.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) if p else "" for p in pages], dtype=object)

    return run(page)
