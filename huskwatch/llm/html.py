"""Main text of web pages by tree scoring: paragraphs score their ancestors, the best container and its siblings stay."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is never text of the article, with all it holds.
DROPPED = frozenset("head title style script noscript template iframe object embed svg math canvas audio video map nav footer aside form button select "
                    "textarea input label fieldset dialog menu".split())
#: Elements whose content is not markup.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main "
                   "menu nav ol p pre section summary table tbody td tfoot th thead caption tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: Words of class, id or role that name what surrounds an article.
UNLIKELY = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|respond|repl(?:y|ies)|disqus|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|"
                      r"consent|notices?|gdpr|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|pagination|pager|toolbar|widget|contentinfo|complementary|search")
LIKELY = re.compile(r"article|body|content|entry|main|post|story|text")
#: A start tag of the first kind ends an open element of the second, within the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Node:
    """An element; ``parts`` holds its texts and elements in page order."""

    __slots__ = ("tag", "marks", "hidden", "parts", "up", "score", "chars", "linked", "bare")

    def __init__(self, tag: str, up: Node | None, marks: str = "", hidden: bool = False) -> None:
        self.tag, self.up, self.marks, self.hidden = tag, up, marks, hidden
        self.parts: list[Node | str] = []
        self.score, self.chars, self.linked, self.bare = 0.0, 0, 0, False


def parse(page: str) -> Node:
    """The element tree; unclosed and stray tags are taken as browsers mostly do."""
    root = Node("html", None)
    now, at, n = root, 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            now.parts.append(page[at:])
            break
        if m.start() > at:
            now.parts.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = now
            while node is not None and node.tag != tag:
                node = node.up if tag in BLOCKS or node.tag not in BLOCKS else None
            if node is not None and node.up is not None:
                now = node.up
            continue
        if tag in ("html", "body") and now is root or tag == "html":
            continue
        if tag in BLOCKS:
            node = now
            while node is not None and node.tag not in BLOCKS - {"p"} and node.tag not in ("button", "object"):
                if node.tag == "p":
                    now = node.up
                    break
                node = node.up
        if tag in IMPLIED:
            ended, within = IMPLIED[tag]
            node = now
            while node is not None and node.tag not in within:
                if node.tag in ended:
                    now = node.up
                node = node.up
        given = m[3]
        marks = " ".join(next(filter(None, x[1:]), "") for x in _ATTRIBUTE.findall(given)) if given else ""
        node = Node(tag, now, marks, bool(given and _HIDDEN.search(given)))
        now.parts.append(node)
        if tag in VOID or given.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end is None:
                at = n
                continue
            at = page.find(">", end.start()) + 1 or n
            continue
        now = node
    return root


def named(mark: str) -> int:
    """-1 for a class, id or role of what surrounds an article, 1 for one of an article, else 0. The last word counts most."""
    first, *_, last = (parts := [x for x in re.split("[-_]+", mark) if x]) and [parts[0], parts[-1]] or ["", ""]
    if first in ("has", "with", "without", "no", "is"):
        return 0
    if UNLIKELY.fullmatch(last):
        return -1
    if LIKELY.fullmatch(last):
        return -1 if UNLIKELY.fullmatch(first) else 1
    return -1 if UNLIKELY.fullmatch(first) else 0


def outside(node: Node, inside: bool) -> bool:
    """Whether an element belongs to what surrounds the article; ``inside``: it stands in an article or main element."""
    if node.tag in DROPPED or node.hidden:
        return True
    if node.tag == "header":
        return not inside
    if node.tag in ("article", "main", "body", "html"):
        return False
    if not node.marks or node.tag in HEADINGS:
        return False
    kinds = {named(mark) for mark in node.marks.lower().split()}
    return -1 in kinds and 1 not in kinds


def _walk(root: Node) -> Iterator[tuple[str, object]]:
    """Events of the tree without what surrounds the article: ("in", node), ("out", node), ("text", text)."""
    todo: list[tuple[str, object, bool]] = [("in", root, False)]
    while todo:
        kind, x, inside = todo.pop()
        yield kind, x
        if kind == "in":
            inside = inside or x.tag in ("article", "main")
            todo.append(("out", x, inside))
            for part in reversed(x.parts):
                if isinstance(part, str):
                    todo.append(("text", part, inside))
                elif not outside(part, inside):
                    todo.append(("in", part, inside))


def blocks(root: Node) -> list[tuple[str, Node]]:
    """Texts between block borders in page order, with the nearest container; white space is one space, references are decoded."""
    out: list[tuple[str, Node]] = []
    held: list[str] = []
    now = root

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((text, now))
        held.clear()

    place = [root]
    for kind, x in _walk(root):
        if kind == "text":
            held.append(x)
        elif x.tag == "br":
            if kind == "in":
                held.append("\n")
        elif x.tag in BLOCKS:
            close()
            place.append(x) if kind == "in" else place.pop()
            now = place[-1]
    close()
    return out


def _score(root: Node) -> None:
    """Each block passes a point, one for each comma and up to three for length to its container; every ancestor gets half of
    what its parts have.

    An element that holds nothing but one other is a wrapper: it passes all it has, so that nesting alone costs no points."""
    links = 0
    open_: list[list] = []  # element, its characters, those in links, its parts that hold something
    order: list[Node] = []
    for kind, x in _walk(root):
        if kind == "text":
            n = len("".join(x.split()))
            open_[-1][1] += n
            open_[-1][2] += n * bool(links)
            open_[-1][3] += 2 * bool(n)  # text of its own: no wrapper
        elif kind == "in":
            links += x.tag == "a"
            open_.append([x, 0, 0, 0])
        else:
            links -= x.tag == "a"
            node, node.chars, node.linked, held = open_.pop()
            node.bare = held == 1 and node.tag in ("div", "section")
            order.append(node)
            if open_:
                open_[-1][1] += node.chars
                open_[-1][2] += node.linked
                open_[-1][3] += bool(node.chars)
    for text, node in blocks(root):
        if node.tag in HEADINGS or len(text) < 25:
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        up = node if node.tag in CONTAINERS else node.up
        if up is not None:
            up.score += points
    for node in order:  # parts before what holds them
        if node.up is not None:
            node.up.score += node.score if node.up.bare else node.score / 2


def _value(node: Node) -> float:
    """Score less the share of linked text; a word of its class or its tag counts for or against it."""
    bonus = 25 * (node.tag in ("article", "main")) + 10 * any(named(m) > 0 for m in node.marks.lower().split())
    return (node.score + bonus * (node.score > 0)) * (1 - (node.linked / node.chars if node.chars else 0))


def _whole(best: Node) -> Node:
    """The article around the best container: the nearest article element, else the outermost main element or named container with few links."""
    found, up = best, best
    while up is not None and up.tag not in ("body", "html"):
        if up.tag == "article":
            return up
        if (up.tag == "main" or any(named(m) > 0 for m in up.marks.lower().split())) and up.linked < 0.3 * up.chars:
            found = up
        up = up.up
    return found


def main_text(page: str | None) -> str:
    """The article's blocks joined by empty lines; a null, empty or wordless page gives the empty text.

    The container with the best value, or the article that it is a part of, is kept whole, but for what surrounds articles. Siblings stay if their value is a
    fifth of the best or more, or if they are paragraphs of text with few links. Where nothing scores, all blocks stay."""
    if not page:
        return ""
    root = parse(page)
    _score(root)
    best, order, inside = None, [], {}
    for kind, x in _walk(root):
        if kind == "in" and x.tag in CONTAINERS | {"html"} and not x.bare:
            order.append(x)
    best = max(order, key=_value)
    if _value(best) <= 0:
        return "\n\n".join(t for t, _ in blocks(root))
    best = _whole(best)
    keep = {id(best)}
    if best.up is not None:
        least = max(10.0, _value(best) / 5)
        for x in best.up.parts:
            if isinstance(x, Node) and x is not best:
                density = x.linked / x.chars if x.chars else 1.0
                if x.tag in CONTAINERS and _value(x) >= least or x.tag == "p" and density < 0.25 and x.chars > 80 or x.tag in HEADINGS and density < 0.25:
                    keep.add(id(x))
    out = []
    for text, node in blocks(root):
        up: Node | None = node
        seen = []
        while up is not None and id(up) not in inside:
            seen.append(up)
            if id(up) in keep:
                inside[id(up)] = True
                break
            up = up.up
        found = up is not None and inside.get(id(up), False)
        for x in seen:
            inside[id(x)] = found
        if found:
            out.append(text)
    return "\n\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per page row; null html gives an empty text, null ids and urls stay."""
    @F.pandas_udf("string")
    def text(found: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in found], dtype=object)

    rows = pages.select("page_id", "url", text(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
