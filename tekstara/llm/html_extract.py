"""HTML extraction: composite text density of every DOM node picks the main content's subtree."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load, map_arrow

# Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "thead", "tr", "td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}
#: Elements that never hold main text, roles likewise.
DROPPED = set("head script style template noscript nav header footer aside button select textarea input iframe object svg canvas math audio video dialog menu title".split())
ROLES = set("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar".split())
# Words of class and id attributes that mark boilerplate, words of what holds it, and words that tell of a layout or a state.
MARKS = set(
    "comment comments disqus reply replies respond ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail widget widgets footer header masthead share sharing social related recommended recommendations pagination pager login signup toolbar skip".split()
)
HOLDERS = set("area articles bar block body box button buttons card container content form group icons inner inside item items left link links list nav panel posts right section slot stories strip teaser teasers text thread title top bottom unit wrap wrapper zone".split())
STATES = set("has no not with without is show hide".split())
MARKED_TAGS = BLOCKS - {"html", "body", "main", "h1"} | {"a", "ins"}
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
HIDING = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")
#: White space and the characters that end names and values, as the standard's tag states have them.
_WS = " \t\n\f\r"
NAME_END = re.compile(f"[{_WS}/>]")
ATTR = re.compile(f"[{_WS}/]*([^{_WS}/>][^{_WS}/>=]*)")
EQUALS = re.compile(f"[{_WS}]*=[{_WS}]*")
BARE = re.compile(f"[^{_WS}>]*")
SEEN = set("class id role hidden aria-hidden style".split())
RAW_END = {t: re.compile(f"(?i)</{t}(?=[{_WS}/>])") for t in RAW}


class Node:
    __slots__ = ("tag", "kids", "up", "drop", "mark", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, drop: bool = False, mark: str = "") -> None:
        self.tag, self.up, self.drop, self.mark = tag, up, drop, mark
        self.kids: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def mark_of(name: str) -> str:
    """The word that makes a class or id name one of boilerplate, or nothing.

    A name counts if its last word is a mark (site-footer), or its first is and only words of what holds it or numbers follow
    (comment-list, ad-3). Names of a layout or a state (has-sidebar, header-fixed, comments-open) tell nothing of what is inside.
    """
    parts = [x.lower() for x in PART.findall(name)]
    if not parts or any(x in STATES for x in parts[:-1]):
        return ""
    if parts[0] in MARKS and all(x in HOLDERS or x in MARKS or x.isdigit() for x in parts[1:]):
        return parts[0]
    return parts[-1] if parts[-1] in MARKS else ""


def told(tag: str, attrs: dict[str, str]) -> tuple[bool, str]:
    """Whether an element is no main text for certain, and the word that marks it as boilerplate otherwise."""
    role = attrs.get("role", "").strip().lower()
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or role in ROLES or HIDING.search(attrs.get("style", "")):
        return tag not in ("html", "body"), "header" if tag == "header" else ""
    if tag == "form" or role == "form":
        return False, "form"
    if tag in MARKED_TAGS:
        for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
            if mark := mark_of(name):
                return False, mark
    return False, ""


class Reader:
    """The tag states of the HTML standard in one pass over the page. A quoted value without its closing quote ends at the tag's
    ``>``, so that text isn't lost; a quote counts as closing where white space, ``/``, ``>`` or the page's end follows."""

    def __init__(self, page: str) -> None:
        self.page, self.n = page, len(page)
        #: characters that don't occur from here on, so that each is looked for to the end of the page once
        self.gone: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        if self.gone.get(what, self.n + 1) <= at:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone[what] = at
        return found

    def tag(self, at: int) -> tuple[str, dict[str, str], int]:
        """(name, attributes of SEEN, place behind the tag) of the tag whose name starts at ``at``; -1 if the page ends in it."""
        page = self.page
        m = NAME_END.search(page, at)
        if not m:
            return page[at:].lower(), {}, -1
        name, pos, attrs = page[at : m.start()].lower(), m.start(), {}
        if page[pos] == ">":
            return name, attrs, pos + 1
        while m := ATTR.match(page, pos):
            key, value, pos = m[1].lower(), "", m.end()
            if e := EQUALS.match(page, pos):
                pos = e.end()
                quote = page[pos : pos + 1]
                if quote in ('"', "'") and quote:
                    end = self.find(quote, pos + 1)
                    if end >= 0 and (end + 1 == self.n or page[end + 1] in " \t\n\f\r/>" or self.find(">", pos + 1) > end):
                        value, pos = page[pos + 1 : end], end + 1
                    else:
                        end = self.find(">", pos + 1)
                        if end < 0:
                            return name, attrs, -1
                        value, pos = page[pos + 1 : end], end
                else:
                    b = BARE.match(page, pos)
                    value, pos = b[0], b.end()
            if key in SEEN:
                attrs.setdefault(key, value)
        end = self.find(">", pos)
        return name, attrs, end + 1 if end >= 0 else -1


def parse(page: str) -> Node:
    """The DOM: implied ends of paragraphs, list items and cells; unclosed elements end with their parents; stray end tags count for nothing."""
    root = at = Node("#root", None)
    reader, pos, n = Reader(page), 0, len(page)
    open_tags: dict[str, int] = {}

    def leave(x: Node) -> Node:
        """Close the open elements up to ``x``."""
        nonlocal at
        while True:
            open_tags[at.tag] -= 1
            at, was = at.up, at  # type: ignore[assignment]
            if was is x:
                return at

    while pos < n:
        start = reader.find("<", pos)
        if start < 0:
            at.kids.append(page[pos:])
            break
        after = page[start + 1 : start + 2]
        if after == "/":
            letter = page[start + 2 : start + 3]
        else:
            letter = after
        if not (after in ("!", "?", "/") or (letter.isascii() and letter.isalpha())) or not after:
            at.kids.append(page[pos : start + 1])  # a < that starts no tag is text
            pos = start + 1
            continue
        if start > pos:
            at.kids.append(page[pos:start])
        if not (letter.isascii() and letter.isalpha()):
            if page.startswith("<!--", start):
                if page.startswith((">", "->"), start + 4):
                    pos = page.index(">", start + 4) + 1
                    continue
                end = min((e + k for e, k in ((reader.find("-->", start + 4), 3), (reader.find("--!>", start + 4), 4)) if e >= 0), default=n)
            else:
                end = reader.find(">", start + 1) + 1 or n
            pos = end
            continue
        tag, attrs, end = reader.tag(start + (2 if after == "/" else 1))
        if end < 0:
            break  # the page ends in a tag
        pos = end
        if after == "/":
            x: Node | None = at if open_tags.get(tag) else None
            while x is not None and x.tag != tag:
                # an end tag of an inline element doesn't reach over a block
                x = None if tag not in BLOCKS and x.tag in BLOCKS else x.up
            if x is not None and x.up is not None:
                leave(x)
            elif tag == "br":
                at.kids.append(Node("br", at))
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            x = at
            while x is not None and x.tag != "p" and x.tag not in BLOCKS:
                x = x.up
            if x is not None and x.tag == "p":
                leave(x)
        if tag in SELF_CLOSING and any(open_tags.get(t) for t in SELF_CLOSING[tag]):
            x, scope = at, SCOPE[tag]
            top = None
            while x is not None and x.tag not in scope:
                top = x if x.tag in SELF_CLOSING[tag] else top
                x = x.up
            if top is not None and top.up is not None:
                leave(top)
        drop, mark = told(tag, attrs)
        if tag == "article" and open_tags.get("article"):
            mark = mark or "comment"  # an article in an article is a reader's comment by the standard
        node = Node(tag, at, drop, mark)
        at.kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            m = RAW_END[tag].search(page, pos)
            if not node.drop:
                node.kids.append(page[pos : m.start() if m else n])
            close = reader.find(">", m.end()) if m else -1
            pos = close + 1 if close >= 0 else n
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        at = node
    settle_marks(root)
    return root


def settle_marks(root: Node) -> None:
    """Marked elements are dropped unless they hold most of the text, links left aside. Text in them weighs a fifth, unless an
    article, a main element or a first heading that bears no mark itself is inside.

    Of a header within an article its headings stay. An element that isn't dropped for its mark is looked into.
    """
    within: dict[int, bool] = {id(root): False}
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        inside = within[id(x)] or x.tag == "article"
        for k in x.kids:
            if isinstance(k, Node):
                if k.mark == "header" and inside:
                    k.kids, k.drop, k.mark = headings(k), False, ""
                within[id(k)] = inside
                if not k.drop:
                    todo.append(k)
    size: dict[int, int] = {}
    for x in reversed(order):
        size[id(x)] = 0 if x.tag == "a" else sum(len(k) if not k.isspace() else 0 for k in x.kids if isinstance(k, str)) + sum(size.get(id(k), 0) for k in x.kids if isinstance(k, Node))
    titled = {id(x) for x in order if x.tag in ("article", "main", "h1") and not x.mark}
    for x in reversed(order):
        if id(x) in titled and x.up is not None:
            titled.add(id(x.up))
    heads, todo = [], [root]
    while todo:
        x = todo.pop()
        for k in x.kids:
            if isinstance(k, Node) and not k.drop:
                (heads if k.mark else todo).append(k)
    plain = size[id(root)] - sum(size[id(k)] for k in heads)
    # the largest first: what is inside it counts as plain text for the others
    heads.sort(key=lambda k: -size[id(k)])
    at = 0
    while at < len(heads):
        x = heads[at]
        at += 1
        if size[id(x)] * (1 if id(x) in titled else 0.2) <= plain:
            x.drop = True
            continue
        inner, todo = [], [x]
        while todo:
            y = todo.pop()
            for k in y.kids:
                if isinstance(k, Node) and not k.drop:
                    (inner if k.mark else todo).append(k)
        plain += size[id(x)] - sum(size[id(k)] for k in inner)
        heads[at:] = sorted(heads[at:] + inner, key=lambda k: -size[id(k)])


def headings(node: Node) -> list[Node | str]:
    """The headings in a header, outermost ones."""
    out: list[Node | str] = []
    todo = [k for k in reversed(node.kids) if isinstance(k, Node)]
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS and not x.drop:
            x.up = node
            out.append(x)
        elif not x.drop or x.tag == "header":
            todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return out


HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.drop:
            continue
        out.append(x)
        todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags, link characters, link tags, composite density and its sum over children.

    Boilerplate isn't seen. Inline elements other than links add characters to their block but count as no tags, so emphasis
    doesn't thin a paragraph out.
    """
    nodes = preorder(root)
    for x in reversed(nodes):
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(k) if not k.isspace() else 0
            elif not k.drop:
                x.chars += k.chars
                x.tags += k.tags + (k.tag in BLOCKS or k.tag == "a")
                x.links += k.links
                x.link_tags += k.link_tags + (k.tag == "a")
        if x.tag == "a":
            x.links = x.chars
    body = next((x for x in nodes if x.tag == "body"), root)
    ratio = body.links / body.chars if body.chars else 0.0
    for x in nodes:
        if x.chars > x.links:
            # characters per tag, times a logarithm whose argument falls and whose base grows with the share of links
            base = math.log(x.chars / (x.chars - x.links) * x.links + ratio * x.chars + math.e)
            inner = x.chars / max(x.links, 1) * max(x.tags, 1) / max(x.link_tags, 1)
            x.density = x.chars / max(x.tags, 1) * max(math.log(inner), 0.0) / base
    for x in nodes:
        x.total = sum(k.density for k in x.kids if isinstance(k, Node) and not k.drop and k.tag in BLOCKS)
    return nodes


#: A parent of the chosen node is taken instead while it keeps this share of the chosen node's density.
CLIMB = 0.5


def main_nodes(root: Node) -> list[Node]:
    """The block with the largest density sum or an ancestor of it, and the blocks beside it that are main text too, in order.

    Blocks are looked for below the body, or below the outermost article element around the chosen block, or else a main
    element: the bound. An ancestor within it counts while its density is at least the bound's and CLIMB of the chosen block's,
    which takes in a title beside the paragraphs but no list of links; the bound itself if it keeps CLIMB of the chosen block's
    density. If lists of links thin it out, the least density on the path to it is the threshold: blocks outside the chosen one
    that reach it are kept, and so is a heading right before a kept block.
    """
    nodes = measure(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    best = max((x for x in nodes if x.tag in BLOCKS), key=lambda x: (x.total, x.density), default=body)
    # blocks and loose text straight in the body, or in no body at all
    if best.total == 0 and best.density < body.density:
        return [body]
    above = [best]
    while above[-1].up is not None:
        above.append(above[-1].up)
    if body not in above:
        return [best]
    outer = [x for x in above if x.tag in ("article", "main")]
    bound = next((x for x in reversed(outer) if x.tag == "article"), outer[-1] if outer else body)
    path = above[: above.index(bound) + 1]
    if best is bound or bound.density >= CLIMB * best.density:
        return [bound]
    top, threshold = best, max(bound.density, CLIMB * best.density)
    for x in path[1:-1]:
        top = x if x.density >= threshold and x.tag != "html" else top
    least = min(p.density for p in path[path.index(top) :])
    outside = {id(x) for x in path[path.index(top) + 1 :]}
    kept: list[Node] = []
    todo = [bound]
    while todo:
        x = todo.pop()
        if x is top or (id(x) not in outside and x.tag in BLOCKS and x.density >= least and x.chars > 2 * x.links):
            kept.append(x)
            continue
        todo += [k for k in reversed(x.kids) if isinstance(k, Node) and not k.drop]
    # headings go with the kept block that follows them
    own, out = set(map(id, kept)), []
    for x in kept:
        before: list[Node] = []
        blocks = [k for k in x.up.kids if isinstance(k, Node) and not k.drop and k.tag in BLOCKS] if x.up is not None else []
        for k in reversed(blocks[: next((i for i, k in enumerate(blocks) if k is x), 0)]):
            if k.tag not in HEADINGS or id(k) in own:
                break
            before.append(k)
        out += [*reversed(before), x]
    return out


def render(node: Node) -> str:
    """Text by blocks: character references decoded, white space inside a block one space, blocks joined by a newline."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split(None))
        if text:
            out.append(text)
        run.clear()

    todo: list[tuple[Node, bool]] = [(node, False)]
    while todo:
        x, ended = todo.pop()
        if isinstance(x, str):
            run.append(html.unescape(x))  # a reference doesn't reach over a tag
            continue
        block = x.tag in BLOCKS
        if ended:
            flush()
            continue
        if x.drop:
            if block:
                flush()
            continue
        if x.tag == "br":
            run.append(" ")
            continue
        if block:
            flush()
            todo.append((x, True))
        for k in reversed(x.kids):
            todo.append((k, False))  # type: ignore[arg-type]
    flush()
    return "\n".join(out)


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return "\n".join(filter(None, map(render, main_nodes(root))))


def extract_text(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of every row of ``df``.

    Navigation, headers, footers, sidebars, adverts, notices, forms, scripts, hidden elements and readers' comments are no part
    of the DOM that is measured; elements that only a class or id name marks as such are, if they hold most of the text.
    Null or empty pages and pages without main text give an empty text; tag soup is repaired as browsers do in common cases;
    repeated rows give repeated results. Nothing is cut off: a page is parsed whole.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return map_arrow(df.select(*[df[c].alias(c) for c in keep], df[page].alias("__html")), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(load(spark, sf_dir, "pages"))
