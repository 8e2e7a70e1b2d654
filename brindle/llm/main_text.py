"""Main text of web pages by tree scoring.

``parse`` builds a tree from the tags, with the end tags that HTML implies; it never fails on broken markup.
Elements that cannot hold main text (scripts, forms, navigation, and those whose class, id or role says
advert, menu, comment and the like) are left out. Each paragraph gives points for its length and its
commas to its parent, half of them to the grandparent and less to those above; the sum of an element is
discounted by its share of link text; of equal ones the first in page order is the best. If it lies in an
``article`` (else in a ``main``), that whole element is the text, whatever its parts score, with headings
without links beside it. Elsewhere the best container is kept with those siblings that are paragraphs or hold some and are at most a quarter links, and with all
that stands between two kept ones (or is a heading before them) and is not mostly links. If no paragraph scores, the first article or
main element counts, else the body.

Text is taken in page order: character references are decoded, white space within a block becomes one
space, and blocks are joined by one space.

Defined cases: null, empty or text-free html gives an empty text; a page that ends within a tag, comment or
script ends there; text outside any element counts; repeated rows give equal results; further columns
pass through and columns named ``text`` or ``n_chars`` are replaced; an empty table gives an empty result.
Html of any length is read whole; the elements that a tag closes by implication are counted for each scope,
so the tree is climbed only to close what is passed, and the time is linear however deep elements nest.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from brindle.llm.common import bounded_batches, freeing

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "script style textarea title noscript iframe xmp noembed noframes head nav aside footer form button select option input "
    "template svg math canvas object audio video dialog menu label".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "option", "optgroup", "title", "legend"}
_SCOPES = {  # start tag: the open elements that it ends, and the elements beyond which it ends none
    "p": ({"p"}, {"table", "td", "th", "caption", "button", "object", "li"}),
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_MEMBER_OF = {name: [key for key, (members, _) in _SCOPES.items() if name in members] for members, _ in _SCOPES.values() for name in members}
_BORDER_OF = {name: [key for key, (_, borders) in _SCOPES.items() if name in borders] for _, borders in _SCOPES.values() for name in borders}
START = {"article": 8.0, "main": 8.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0, "th": -5.0}

NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertorial|banners?|breadcrumbs?|comments?|disqus|consent|cookies?|dialog|footer|gdpr|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo|related|replies|respond|share|sharing|sidebar|skip|social|sponsor(?:ed)?|"
    r"subscribe|subscription|tags|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner complementary contentinfo search menu menubar alert dialog form".split())

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])|(?=["'][^"']*+\Z))|["'])*+)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


class Node:
    """An element: ``parts`` holds strings and nodes in page order."""

    __slots__ = ("name", "parent", "parts", "noise", "points", "letters", "linked")

    def __init__(self, name: str, parent: Node | None, noise: bool = False) -> None:
        self.name, self.parent, self.parts, self.noise = name, parent, [], noise
        self.points, self.letters, self.linked = 0.0, 0, 0


def _is_noise(name: str, attrs: str, in_article: bool) -> bool:
    if name in DROPPED:
        return True
    if name == "header":
        return not in_article
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    given = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if NOISE.search(given.get("class", "")) or NOISE.search(given.get("id", "")) or given.get("role", "").lower() in ROLES:
        return True
    style = given.get("style", "").replace(" ", "").lower()
    return "display:none" in style or given.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs, re.I) is not None


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("", None)
    here, at, n = root, 0, len(page)
    open_names: dict[str, int] = {}
    open_in: dict[str, list[int]] = {key: [0] for key in _SCOPES}  # by scope, from the outermost to the innermost

    def enter(node: Node) -> None:
        nonlocal here
        here, name = node, node.name
        open_names[name] = open_names.get(name, 0) + 1
        for key in _BORDER_OF.get(name, ()):
            open_in[key].append(0)
        for key in _MEMBER_OF.get(name, ()):
            open_in[key][-1] += 1

    def leave() -> None:
        nonlocal here
        name = here.name
        open_names[name] -= 1
        for key in _MEMBER_OF.get(name, ()):
            open_in[key][-1] -= 1
        for key in _BORDER_OF.get(name, ()):
            open_in[key].pop()
        here = here.parent

    def end_siblings(key: str) -> None:
        while open_in[key][-1]:
            leave()

    while at < n:
        spot = page.find("<", at)
        if spot < 0:
            here.parts.append(page[at:])
            break
        if spot > at:
            here.parts.append(page[at:spot])
        tag = _TAG.match(page, spot)
        if tag is None:
            here.parts.append("<")
            at = spot + 1
            continue
        at = tag.end()
        if tag["end"]:
            name = tag["end"].lower()
            if open_names.get(name):
                while here.name != name:
                    leave()
                leave()
            elif name in ("p", "br"):
                here.parts.append(Node(name, here))
            continue
        if not tag["start"] or page[at - 1] != ">":
            continue
        name = tag["start"].lower()
        if name in CLOSES_P:
            end_siblings("p")
        if name != "p" and name in _SCOPES:
            end_siblings(name)
        node = Node(name, here, _is_noise(name, tag["attrs"], bool(open_names.get("article") or open_names.get("main"))))
        here.parts.append(node)
        if name in RAW:
            done = _RAW_END[name].search(page, at)
            if done is None:
                break
            at = page.find(">", done.end()) + 1 or n
        elif name not in VOID and not (name in ("svg", "math") and tag["attrs"].endswith("/")):  # elsewhere the slash means nothing
            enter(node)
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Elements that are not noise, when they open and (True) when they close."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, closing = stack.pop()
        yield node, closing
        if not closing:
            stack.append((node, True))
            stack += [(x, False) for x in reversed(node.parts) if isinstance(x, Node) and not x.noise]


def _blocks(roots: list[Node]) -> list[str]:
    found: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            text = " ".join("".join(now).split())
            if text:
                found.append(text)
            now.clear()

    for root in roots:
        flush()
        stack: list[Node | str | None] = [root]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                now.append(references.unescape(x) if "&" in x else x)
            elif x.name == "br":
                now.append(" ")
            elif not x.noise:
                if x.name in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.parts))
    flush()
    return found


def score(root: Node) -> list[Node]:
    """Give points to the elements of a tree; returns those that got any, in page order."""
    order: list[Node] = []
    depth_of_links = 0
    commas: dict[int, int] = {}
    for node, closing in _walk(root):
        if not closing:
            depth_of_links += node.name == "a"
            node.letters = node.linked = 0
            commas[id(node)] = 0
            for x in node.parts:
                if isinstance(x, str):
                    size = len(x.strip())
                    node.letters += size
                    node.linked += size if depth_of_links else 0
                    commas[id(node)] += x.count(",")
            order.append(node)
            continue
        depth_of_links -= node.name == "a"
        for x in node.parts:
            if isinstance(x, Node) and not x.noise:
                node.letters += x.letters
                node.linked += x.linked
                commas[id(node)] += commas[id(x)]
    scored: dict[int, Node] = {}
    for node in order:
        if node.name not in PARAGRAPH or node.letters < 25:
            continue
        points = 1 + commas[id(node)] + min(node.letters / 100, 3)
        above, share = node.parent, 1.0
        for level in range(5):
            if above is None or above is root:
                break
            if id(above) not in scored:
                scored[id(above)] = above
                above.points = START.get(above.name, 0.0)
            above.points += points * share
            share = 0.5 if level == 0 else share * 0.4
            above = above.parent
    for node in scored.values():
        node.points *= 1 - node.linked / max(node.letters, 1)
    return [x for x in order if id(x) in scored]


def _article_of(node: Node) -> Node | None:
    """The innermost article that holds the node, or is it; else the innermost main."""
    main = None
    while node is not None:
        if node.name == "article":
            return node
        if node.name == "main":
            main = main or node
        node = node.parent
    return main


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    scored = score(root)
    if not scored:
        named: dict[str, Node] = {}
        for node, closing in _walk(root):
            if not closing:
                named.setdefault(node.name, node)
        return " ".join(_blocks([named.get("article") or named.get("main") or named.get("body") or root]))
    best = max(scored, key=lambda x: x.points)
    whole = _article_of(best)
    around = [x for x in (whole or best).parent.parts if isinstance(x, Node) and not x.noise]
    if whole is not None:
        return " ".join(_blocks([x for x in around if x is whole or (x.name in ("h1", "h2", "hgroup") and not x.linked and whole.parent.name in ("main", "article"))]))
    with_points = {id(x) for x in scored}

    def chosen(x: Node) -> bool:
        return x is best or ((id(x) in with_points or (x.name == "p" and x.letters > 0)) and 4 * x.linked <= x.letters)

    picked = [k for k, x in enumerate(around) if chosen(x)]
    first = picked[0]
    while first and around[first - 1].name in HEADINGS and not around[first - 1].linked:
        first -= 1
    between = around[first : picked[-1] + 1]
    return " ".join(_blocks([x for x in between if chosen(x) or 2 * x.linked <= x.letters]))


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) with ``text`` and ``n_chars``."""
    own = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.schema.field(k).name for k in range(len(own))]
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(x.as_py()) for x in part.column(len(own))]
                counts = np.array([len(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(texts, pa.string()), pa.array(counts)], names=[*names, "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    shown = [F.col(f"`{c}`") for c in own]
    schema = pages.select(*shown).schema.add("text", StringType()).add("n_chars", LongType())
    return pages.select(*shown, F.col(f"`{html}`").cast("string").alias("__html")).mapInArrow(freeing(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
