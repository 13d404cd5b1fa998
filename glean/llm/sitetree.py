"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same path of (tag, class, id) are one
element node of the style tree; the different child sequences below it are its style nodes,
the different texts in it its content.  With m occurrences and l style nodes of shares p_i

    presentation importance(E) = -sum_i p_i log_m p_i          (1 if m = 1)
    content importance(E)      = 1 - mean over texts a of H(a), H(a) = log_m(occurrences of a)
    composite(E) = (1 - g^l) * presentation(E) + g^l * mean over its children of composite

with g = 0.9 and the content importance at leaves.  Branches whose composite importance is below
``THRESHOLD`` say the same on page after page and are removed from each page.  Two priors stand
beside the entropies, because an advert or menu that differs on every page looks like content to
them: a branch declared as boilerplate (by its tag, role, class or id; inside a declared main region by
its tag, or as a block container by a whole class or role name) has importance 0, and inside
a declared main region (article, main) the text blocks, what is in them and the wrappers that hold any
have importance 1, so an article in such blocks that was copied to many pages stays whole.  Nodes with fewer than ``MIN_OCCURRENCES``
occurrences are not judged by entropy.

The counts behind the tree are sums per (host, path, feature) that are added up before they are
shuffled; a page then meets the few removed paths of its host.

Defined results: a null or empty page has empty text; a page without a url belongs to the host ``''``;
broken markup is read as browsers do it in outline (unclosed paragraphs and items end at the next one, an end
tag without a beginning is ignored, an unclosed comment or script runs to the end).  If nothing would be left of a
page's main region, it stays as it was without the entropies.  Repeated pages count as often as they stand there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glean.llm.common import stored

THRESHOLD, DECAY, MIN_OCCURRENCES = 0.2, 0.9, 8
SALTS = 16

_SET = lambda text: frozenset(text.split())
VOID = _SET("area base br col embed hr img input link meta param source track wbr")
RAW = _SET("script style textarea title noscript template iframe xmp noembed noframes")
#: Tags whose branches are no main text.
BOILERPLATE_TAGS = RAW | _SET("head nav header footer aside form menu dialog button select option input label svg canvas object audio video map")
BLOCKS = _SET(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
)
#: Blocks that are text of a main region themselves, not parts of its layout.
TEXT_BLOCKS = _SET("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption")
CONTAINERS = BLOCKS - TEXT_BLOCKS
INLINE = _SET("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var")
#: What an opening tag closes when it is still open, up to the nearest of the second set.
CLOSES = {
    "li": (_SET("li"), _SET("ul ol menu dir")),
    "dt": (_SET("dt dd"), _SET("dl")),
    "dd": (_SET("dt dd"), _SET("dl")),
    "tr": (_SET("tr td th"), _SET("table thead tbody tfoot")),
    "td": (_SET("td th"), _SET("tr table")),
    "th": (_SET("td th"), _SET("tr table")),
    "option": (_SET("option"), _SET("select")),
    "thead": (_SET("thead tbody tfoot tr td th"), _SET("table")),
    "tbody": (_SET("thead tbody tfoot tr td th"), _SET("table")),
    "tfoot": (_SET("thead tbody tfoot tr td th"), _SET("table")),
}
#: Parts of class, id or role names that declare boilerplate.
BOILERPLATE_NAMES = _SET(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended comment comments commentlist reply replies "
    "respond disqus discussion cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login search share "
    "sharing social toolbar pagination pager copyright complementary contentinfo toc skip hidden"
)
#: Whole class or role names that make an article of its own a comment or a teaser.
COMMENT_NAMES = _SET(
    "comment comments comment-body commentlist comment-list reply replies respond disqus discussion related related-post related-posts "
    "related-article related-articles recommended teaser"
)
#: Inside a declared main region only whole names declare boilerplate, and only names that no part of an article's own
#: text bears: classes of blocks, roles and ids of block containers.
REGION_NAMES = _SET(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle ad-container ad-slot ad-banner ad-wrapper sponsor sponsored promo "
    "comment comments commentlist comment-list comments-area respond replies disqus disqus-thread newsletter newsletter-signup subscribe cookie-banner "
    "cookie-consent nav navbar navigation breadcrumb breadcrumbs pagination sharing social-share share-buttons share-bar related-posts "
    "related-articles sidebar related related-content recommended notice notices notification notifications alert alerts popup pop-up modal "
    "overlay banner promo promotion menu submenu footer widget widgets toolbar cookies cookie-notice consent gdpr share share-links tags skip-link"
)
REGION_IDS = _SET(
    "comment comments commentlist comment-list comments-area comment-section respond replies disqus disqus-thread newsletter newsletter-signup "
    "subscribe cookie-banner cookie-consent cookie-notice nav navbar navigation breadcrumb breadcrumbs pagination sharing social-share share-buttons "
    "share-bar related-posts related-articles related-content sidebar popup modal overlay menu footer ad ads advert adverts ad-container ad-slot ad-banner"
)
REGION_ROLES = _SET("navigation menu menubar toolbar search banner complementary contentinfo")
#: A name that begins so tells what a page has or lacks, not what the element is.
ABOUT = _SET("has with without no is")
MAIN_TAGS, MAIN_NAMES = _SET("article main"), _SET("main article")

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(>?))")
#: One attribute: its name and, if it has one, its quoted or bare value.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_READ = _SET("class id role hidden")
_NAME = re.compile(r"[a-z]+|\d+")
_NUMBER = re.compile(r"[-_]?\d+$")


class Node:
    __slots__ = ("tag", "label", "parent", "parts", "path", "noise", "main", "inside")

    def __init__(self, tag: str, names: Names, hidden: bool, label: str, parent: Node | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.parts: list[str | Node] = []
        self.path: int = xxhash.xxh64_intdigest(f"{label}", parent.path if parent else 0) if tag not in INLINE and tag != "br" else 0
        self.main = tag in MAIN_TAGS or any(r in MAIN_NAMES for r in names.role)
        #: Whether a declared main region is around it.
        self.inside: bool = parent is not None and (parent.inside or parent.main and not parent.noise)
        if self.main:
            declared = not COMMENT_NAMES.isdisjoint(names.whole)
        elif self.inside:
            declared = tag in BLOCKS and not REGION_NAMES.isdisjoint(names.classes)
            declared |= tag in CONTAINERS and not (REGION_IDS.isdisjoint(names.ids) and REGION_ROLES.isdisjoint(names.role))
        else:
            declared = tag not in ("html", "body") and not BOILERPLATE_NAMES.isdisjoint(names.words)
        # The header of an article or main region holds its own title.
        own_header = tag == "header" and self.inside
        self.noise = tag in BOILERPLATE_TAGS and not own_header or hidden or declared


class Names(NamedTuple):
    """Words of class, id and role; whole names of class, of role, of id; both and numbered ids (``comment-12``) without their numbers."""

    words: list[str] = []
    classes: list[str] = []
    role: list[str] = []
    whole: list[str] = []
    ids: list[str] = []


_NO_NAMES = Names()


def _attributes(text: str) -> tuple[Names, bool, str]:
    """Names; hidden; the label part of class and id."""
    names, hidden, label = Names([], [], [], [], []), False, []
    for m in _ATTRIBUTE.finditer(text):
        key = m[1].lower()
        if key not in _READ:
            continue
        if key == "hidden":
            hidden = True
            continue
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        for name in value.split():
            own = _NAME.findall(name)
            if own and own[0] not in ABOUT:
                names.words.extend(own)
            whole = name.replace("_", "-")
            if key != "id":
                (names.role if key == "role" else names.classes).append(whole)
                names.whole.append(whole)
            else:
                names.ids.append(whole)
            if _NUMBER.search(whole):
                names.whole.append(_NUMBER.sub("", whole))
        if key == "role":
            continue
        label.append(f"{key[0]}={value}")
    return names, hidden, " ".join(label)


def parse(page: str | None) -> Node:
    """The DOM of a page, in outline."""
    text = page or ""
    root = Node("#page", _NO_NAMES, False, "#page", None)
    opened = _Opened(root)
    here = root
    at, end = 0, len(text)
    while at < end:
        m = _TAG.search(text, at)
        if m is None:
            here.parts.append(text[at:])
            break
        if m.start() > at:
            here.parts.append(text[at : m.start()])
        at = m.end()
        if m[1]:
            close = text.find("-->", at)
            at = close + 3 if close >= 0 else end
            continue
        if m[2]:
            close = text.find(">", at)
            at = close + 1 if close >= 0 else end
            continue
        tag = m[4].lower()
        if m[3]:
            place = opened.last(tag)
            # An inline end tag does not close blocks.
            if place and not (tag in INLINE and opened.last_block() > place):
                here = opened.leave(place)
            continue
        if tag in BLOCKS:
            here = opened.close(_P, _P_STOP)
        if tag in CLOSES:
            here = opened.close(*CLOSES[tag])
        if m[5] and not m[5].isspace():
            names, hidden, label = _attributes(m[5])
            child = Node(tag, names, hidden, f"{tag} {label}", here)
        else:
            child = Node(tag, _NO_NAMES, False, tag, here)
        here.parts.append(child)
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(text, at)
            stop = close.start() if close else end
            child.parts.append(text[at:stop])
            at = stop
            here = opened.enter(child)
        elif tag not in VOID and not (m[5] or "").endswith("/"):
            here = opened.enter(child)
    return root


_P, _P_STOP = _SET("p"), _SET("button table td th caption object")


class _Opened:
    """The open elements, with the places of each tag, so that closing does not climb."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def enter(self, node: Node) -> Node:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)
        return node

    def last(self, tag: str) -> int:
        """Place of the nearest open element of a tag, 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else 0

    def leave(self, place: int) -> Node:
        """Close the element at a place and all in it; gives the one around it."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
        return self.stack[-1]

    def close(self, tags: frozenset, stops: frozenset) -> Node:
        """Leave the nearest open element of ``tags``, if none of ``stops`` is nearer."""
        place = max(map(self.last, tags))
        return self.leave(place) if place and place > max(map(self.last, stops)) else self.stack[-1]


def _nodes(root: Node) -> Iterator[Node]:
    """All nodes that are not in a branch of declared boilerplate."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(p for p in node.parts if type(p) is Node and not p.noise)


def _blocks_below(node: Node) -> list[Node]:
    """Nearest non-inline descendants that are not declared boilerplate."""
    out, todo = [], [p for p in reversed(node.parts) if type(p) is Node]
    while todo:
        p = todo.pop()
        if p.path:
            if not p.noise:
                out.append(p)
        else:
            todo.extend(x for x in reversed(p.parts) if type(x) is Node)
    return out


def _own_text(node: Node) -> str:
    """Text of a node without that of the blocks in it, inline markup included."""
    out: list[str] = []
    todo: list[str | Node] = list(reversed(node.parts))
    while todo:
        p = todo.pop()
        if type(p) is str:
            out.append(p)
        elif p.tag == "br":
            out.append(" ")
        elif not p.path and not p.noise:
            todo.extend(reversed(p.parts))
    return " ".join(html.unescape("".join(out)).split())


def tree_counts(pages: list[tuple[str, str | None]]) -> list[tuple]:
    """Counts of the style tree of some pages: (host, path, parent, kind, feature, count, weight).

    kind 's': a child sequence; 't': a text; 'e': the edge from the parent, its weight the sum over the
    parent's occurrences of this node's share of the children.
    """
    found: Counter = Counter()
    weight: Counter = Counter()
    for host, page in pages:
        for node in _nodes(parse(page)):
            if not node.path:
                continue
            below = _blocks_below(node)
            if below:
                found[host, node.path, 0, "s", _hash(" ".join(c.label for c in below))] += 1
                for c in below:
                    key = host, c.path, node.path, "e", 0
                    found[key] += 1
                    weight[key] += 1 / len(below)
            own = _own_text(node)
            if own or not below:
                found[host, node.path, 0, "t", _hash(own)] += 1
    return [(*k, n, weight.get(k, 0.0)) for k, n in found.items()]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def host(url: Column) -> Column:
    """Lower-cased host of a url without its port; '' for none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = tree_counts(list(zip(pdf["host"], pdf["html"])))
        rows = [(h, _signed(p), _signed(a), k, _signed(f), n, w) for h, p, a, k, f, n, w in rows]
        yield pd.DataFrame(rows, columns=["host", "path", "parent", "kind", "feature", "n", "w"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, parent, occurrences, styles, presentation, content, share: one row for each judged element node."""
    rows = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    raw = rows.mapInPandas(_counted, "host string, path bigint, parent bigint, kind string, feature bigint, n bigint, w double")
    # Add up features first: a hot host spreads over its features.
    sums = raw.groupBy("host", "path", "kind", "feature", "parent").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))

    def of(kind: str, x: Column) -> Column:
        return F.when(F.col("kind") == kind, x)

    n, plogp = F.col("n"), F.col("n") * F.log(F.col("n").cast("double"))
    own = sums.groupBy("host", "path").agg(
        F.sum(of("s", n)).alias("ms"),
        F.sum(of("s", plogp)).alias("ls"),
        F.count(of("s", n)).alias("styles"),
        F.sum(of("t", n)).alias("mt"),
        F.sum(of("t", F.log(n.cast("double")))).alias("lt"),
        F.count(of("t", n)).alias("texts"),
        F.max(of("e", F.col("parent"))).alias("parent"),
        F.sum(of("e", F.col("w"))).alias("w"),
    )
    m = F.greatest(F.coalesce("ms", F.lit(0)), F.coalesce("mt", F.lit(0)))
    presentation = F.when(F.col("ms") > 1, 1 - F.col("ls") / (F.col("ms") * F.log(F.col("ms").cast("double")))).otherwise(1.0)
    content = F.when(F.col("mt") > 1, 1 - F.col("lt") / (F.col("texts") * F.log(F.col("mt").cast("double")))).otherwise(1.0)
    return own.select(
        "host",
        "path",
        "parent",
        m.alias("occurrences"),
        "styles",
        F.when(F.col("styles") > 0, presentation).alias("presentation"),
        F.when(F.col("texts") > 0, content).alias("content"),
        F.col("w").alias("w"),
    )


def removed_paths(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, paths: the element nodes of low composite importance.

    Composite importance is a sum over the node's descendants: each one's own importance times the
    decays and shares of the edges in between.  Descendants are reached level by level, from parents to children.
    """
    tree = stored(style_tree(pages), "sitetree-tree")
    decay = F.when(F.col("styles") > 0, F.pow(F.lit(DECAY), F.col("styles"))).otherwise(0.0)
    own = F.when(
        F.col("styles") > 0,
        # A node with children and text of its own: the text counts as one more child would.
        (1 - decay) * F.col("presentation") + F.when(F.col("content").isNotNull(), decay * 0.5 * F.col("content")).otherwise(0.0),
    ).otherwise(F.coalesce("content", F.lit(1.0)))
    passed = decay * F.when(F.col("content").isNotNull(), 0.5).otherwise(1.0)
    nodes = tree.select("host", "path", "parent", "occurrences", own.alias("own"), passed.alias("passed"), "w")
    # A node passes on to each child its decay times the child's mean share over the parent's occurrences.
    edges = (
        nodes.filter("parent is not null")
        .select("host", "parent", F.col("path").alias("child"), "w", F.col("own").alias("child_own"), F.col("passed").alias("child_passed"))
        .join(nodes.select("host", F.col("path").alias("parent"), "passed", "occurrences"), ["host", "parent"])
        .select("host", "parent", "child", (F.col("passed") * F.col("w") / F.col("occurrences")).alias("f"), "child_own", "child_passed")
    )
    edges = stored(edges, "sitetree-edges")
    total = nodes.select("host", "path", "own")
    reach = edges.select("host", F.col("parent").alias("path"), F.col("child").alias("at"), "f", "child_own", "child_passed")
    while True:
        total = total.unionByName(reach.select("host", "path", (F.col("f") * F.col("child_own")).alias("own")))
        # What is passed on from here cannot lift an importance over the threshold any more once it is this small.
        reach = (
            reach.filter("f * child_passed > 1e-6")
            .select("host", "path", F.col("at").alias("parent"), F.col("f").alias("f0"))
            .join(edges, ["host", "parent"])
            .select("host", "path", F.col("child").alias("at"), (F.col("f0") * F.col("f")).alias("f"), "child_own", "child_passed")
        )
        reach = stored(reach, "sitetree-reach")
        if reach.isEmpty():
            break
    importance = total.groupBy("host", "path").agg(F.sum("own").alias("importance"))
    low = importance.filter(F.col("importance") < threshold).join(
        nodes.filter(F.col("occurrences") >= MIN_OCCURRENCES).select("host", "path"), ["host", "path"]
    )
    return low.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def main_text(page: str | None, removed: frozenset[int] = frozenset()) -> str:
    """Blocks of the page's main text, joined by newlines."""
    root = parse(page)
    # An article within a branch that is named like boilerplate counts only if there is no other one.
    regions = _regions(root, lambda n: n.noise) or _regions(root, lambda n: n.tag in BOILERPLATE_TAGS and n.tag != "form")
    declared = bool(regions)
    regions = regions or [root]
    blocks = [b for r in regions for b in _text_blocks(r, removed, declared)]
    if not blocks and removed:
        blocks = [b for r in regions for b in _text_blocks(r, frozenset(), declared)]
    return "\n".join(blocks)


def _regions(root: Node, skip: Callable[[Node], bool]) -> list[Node]:
    """Outermost declared main regions outside skipped branches, in page order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.main and not node.noise:
            found.append(node)
        elif not skip(node):
            todo.extend(p for p in reversed(node.parts) if type(p) is Node)
    return found


def _importance_one(region: Node) -> set[Node]:
    """The text blocks of a declared region, what is in them and the wrappers that hold any."""
    found: set[Node] = set()
    todo = [(region, False)]
    while todo:
        node, below = todo.pop()
        below = below or node.tag in TEXT_BLOCKS
        up = node
        while below and up is not region.parent and up not in found:
            found.add(up)
            up = up.parent
        todo.extend((p, below) for p in node.parts if type(p) is Node and not p.noise)
    return found


def _text_blocks(region: Node, removed: frozenset[int], declared: bool) -> list[str]:
    kept = _importance_one(region) if declared and removed else set()
    out: list[str] = []
    run: list[str] = []

    def end_block() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list[str | Node | None] = [None, *reversed(region.parts)]
    while todo:
        p = todo.pop()
        if p is None:
            end_block()
        elif type(p) is str:
            run.append(p)
        elif p.noise:
            # Boilerplate between two texts of a block is a break only if it is a block itself.
            if p.tag in BLOCKS:
                end_block()
        elif p.tag == "br":
            run.append(" ")
        elif p.path and p.tag not in VOID:
            end_block()
            if _signed(p.path) in removed and p not in kept:
                continue
            todo.append(None)
            todo.extend(reversed(p.parts))
        else:
            todo.extend(reversed(p.parts))
    end_block()
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html; other columns are ignored)."""
    low = stored(removed_paths(pages), "sitetree-removed")
    # A host's few removed paths are copied to SALTS keys, so that a hot host's pages spread.
    low = low.select("host", "paths", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html_, paths in batches:
            yield pd.Series([main_text(h, frozenset(p.tolist()) if p is not None else frozenset()) for h, p in zip(html_, paths)], dtype=object)

    found = rows.join(low, ["host", "salt"], "left").select("page_id", "url", run("html", "paths").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
