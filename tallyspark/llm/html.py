"""Main text of HTML pages by tree scoring.

A page is read into a tree of elements; tags that HTML closes by themselves (p, li, td, ...) are closed likewise,
and an unclosed or truncated page gives the tree so far. Subtrees that never hold article text go first: scripts,
styles, forms, navigation, page headers and footers, sidebars, adverts, notices, comments, by tag, role, class or
id, and readers' comments by their heading; an id of a heading or a section within the article is no more than an
anchor, unless it names furniture as a whole, and so is a class there whose word isn't furniture's for sure. Each paragraph then has points, one for itself, one for each comma, one for each 100 characters up to three;
its parent gets them in full, its grandparent a half, further ancestors ever less. An element's score is its points
less its link density. The container is the outermost article or main element around the best one; a page without
them has the highest element around it that isn't dense with links, less the blocks beside the way up that are. All
that is left within the container is kept, whatever its score. Of its siblings, those are kept that are articles or
paragraphs of text or whose own score comes near. Blocks that are mostly links are left out,
other than those of an article element, or of a main element around no article.

The text of a block has its character references decoded and its white space turned into single spaces; blocks are
joined in page order by one space. Cases: a null or empty page, and a page without text, gives the empty string;
a page without paragraphs is scored by the text directly in its elements. Of elements with equal scores the first in
the page is the best one. Repeated pages give equal rows; a null page_id or url is kept. Very long and very deep pages
are read whole, in time linear to their length. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded, slices

RESULT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never article text, whatever they hold.
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas form button select textarea input nav menu aside footer dialog fieldset legend audio video map applet embed annotation annotation-xml".split()
)
#: Opening one of the first closes an open one of the second, up to the nearest of the third.
CLOSES = {
    **{t: ({"p"}, {"button", "table", "td", "th", "caption", "object"}) for t in BLOCK - {"body", "html", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "summary"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt", "p"}, {"dl"}),
    "dt": ({"dd", "dt", "p"}, {"dl"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note".split())
MARKED = frozenset(("article", "main"))
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|banner\w*|sponsor\w*|promo\w*|commercial|breadcrumbs?|comments?|commentlist|disqus|respond|repl(?:y|ies)|discussion|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|nav\w*|menus?|submenu|sidebar|side|aside|rail|widget\w*|footer|foot|header|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|pagination|pager|skip|search|tags?|toc|copyright|legal|disclaimer|hidden)(?=$|[\s_-])",
    re.I,
)
#: A class or an id of a reader's comment, an advert or a sidebar, which no word of LIKELY within it or beside it excuses.
STRONG = re.compile(
    r"(?:(?:article|blog|content|entry|main|page|post|reader|story|user)[_-])*(?:comments?|commentlist|disqus|ads?|adv|advert|advertisement|adsense|adslot|sidebar)(?:[_-](?:area|article|author|banner|body|box|container|content|entry|footer|form|header|inner|item|list|main|meta|post|section|slot|story|text|thread|title|unit|widget|wrap|wrapper|\d+))*",
    re.I,
)
#: Words of UNLIKELY that name furniture within an article too, whatever stands beside them.
SURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|banner\w*|sponsor\w*|promo|commercial|breadcrumbs?|comments?|commentlist|disqus|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|login|paywall|nav|navbar|navigation|navlinks|submenu|sidebar|widgets?|masthead|topbar|toolbar|share|sharing|pagination|pager)(?=$|[\s_-])",
    re.I,
)
#: A heading of readers' comments: with their number anywhere, without it outside articles.
COUNTED = r"(?:reader |user )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?|respuestas|réponses|antworten)"
COMMENTS = re.compile(rf"\s*(?:\d[\d.,]*\s+{COUNTED}|{COUNTED}\s*[(\[:–-]?\s*\d[\d.,]*\s*[)\]]?|(?:leave|post|write|add) (?:a |your )?(?:comment|reply|response))\s*:?\s*", re.I)
BARE_COMMENTS = re.compile(r"\s*(?:reader |user )?(?:comments|kommentare|commentaires|comentarios)\s*:?\s*", re.I)
#: Words that go with those of UNLIKELY in names of page furniture.
FURNITURE = frozenset("area bar block box button buttons container icons inner items links list posts wrap wrapper".split())
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTROLS = frozenset("input select textarea button".split())
#: Text that is code: its marked-up words have classes of their own.
CODE = frozenset("pre code samp kbd var".split())
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|post|story|text)(?=$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
SPACE = re.compile(r"\s+")
ENOUGH = 0.2
#: Below this link density a block is text.
SPARSE = 0.25
#: Characters below which an element is short.
SHORT = 100
#: Ancestors that get points of a paragraph; beyond them its part is next to nothing.
FAR = 20


class Node:
    """An element: its parts are strings and elements in page order."""

    __slots__ = ("tag", "attrs", "parent", "parts", "points", "chars", "link_chars", "links")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list = []
        self.points = 0.0
        self.chars = self.link_chars = self.links = 0


def tree(page: str) -> Node:
    """The elements of a page. The open ones are a list, with the places of each tag in it, so that a tag costs no walk
    to the root however deep the page is."""
    root = Node("#root", "", None)
    path, places = [root], defaultdict(list)

    def shut_from(depth: int) -> None:
        while len(path) > depth:
            places[path.pop().tag].pop()

    at, n = 0, len(page)
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            open_ = n
        if open_ > at:
            path[-1].parts.append(page[at:open_])
        if open_ == n:
            break
        m = TOKEN.match(page, open_)
        if not m:
            path[-1].parts.append("<")
            at = open_ + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if at == n and page[-1] != ">":  # the page ends inside this tag
            break
        if m[1]:
            if places[tag]:
                shut_from(places[tag][-1])
            continue
        if tag in CLOSES:
            shut, walls = CLOSES[tag]
            wall = max((places[t][-1] for t in walls if places[t]), default=0)
            beyond = [places[t][bisect(places[t], wall)] for t in shut if places[t] and places[t][-1] > wall]
            if beyond:
                shut_from(min(beyond))
        if tag in ("html", "body") and places[tag]:
            continue
        node = Node(tag, m[3], path[-1])
        path[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|$)", re.I).search(page, at)
            if tag == "textarea":
                node.parts.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and (tag not in ("svg", "path") or not m[3].rstrip().endswith("/")):  # elsewhere a slash closes nothing in HTML
            places[tag].append(len(path))
            path.append(node)
    return root


def above(x: Node | None) -> Iterator[Node]:
    while x:
        yield x
        x = x.parent


def named(attrs: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in ATTRIBUTE.finditer(attrs)}


def marked(x: Node) -> str:
    """article or main if the page says that this element is one, else empty."""
    if x.tag in MARKED:
        return x.tag
    role = named(x.attrs).get("role", "").lower() if "role" in x.attrs and x.tag != "body" else ""
    return role if role in MARKED else ""


def inner(x: Node) -> tuple[int, int, bool, bool]:
    """Characters and link characters of a subtree that isn't pruned yet; whether a heading is in it, and whether a form
    or an element named as a comment or an advert is."""
    chars = link_chars = 0
    heading = strong = False
    stack = [(p, False) for p in x.parts]
    while stack:
        p, link = stack.pop()
        if isinstance(p, str):
            n = len("".join(p.split()))
            chars, link_chars = chars + n, link_chars + n * link
            continue
        heading |= p.tag in HEADINGS
        if p.tag in ("form", "textarea"):
            strong = True
        elif p.attrs and not strong and p.tag in BLOCK:
            a = named(p.attrs)
            strong = any(map(STRONG.fullmatch, a.get("class", "").split()))
        if p.tag not in DROPPED:
            stack += [(q, link or p.tag == "a") for q in p.parts]
    return chars, link_chars, heading, strong


def anchor(x: Node, name: str, part: bool, article: bool) -> bool:
    """Whether an id with words of UNLIKELY is a place to link to, as headings and sections have, and not furniture's
    name. part: whether x is a section."""
    if x.tag not in BLOCK or x.tag in HEADINGS:
        return True
    bare = bool(UNLIKELY.fullmatch(name))
    if STRONG.fullmatch(name):
        if not part:
            return bare and x.tag not in ("div", "ul", "ol", "dl")
        chars, link_chars, heading, held = inner(x)
        return bare and heading and chars >= SHORT and not held and link_chars < 0.5 * chars
    if not part and x.tag not in ("div", "ul", "ol", "dl", "p"):
        return True
    if not furniture(name):
        return True
    chars, link_chars, heading, _ = inner(x)
    return link_chars < 0.5 * chars and (part and article or heading and chars >= SHORT)


def furniture(name: str) -> bool:
    """Whether all words of a name are those of page furniture."""
    return all(w in FURNITURE or UNLIKELY.fullmatch(w) for w in re.split(r"[\s_-]+", name.lower()) if w)


def classed(x: Node, classes: list[str], part: bool) -> bool:
    """Whether classes with words of UNLIKELY name furniture within an article: by a sure word, or as a whole, unless x
    is a section of prose; a word beside others (related-work, side-note) does so only for a block of links."""
    if any(map(SURE.search, classes)):
        return True
    chars, link_chars, heading, held = inner(x)
    if any(UNLIKELY.search(c) and furniture(c) for c in classes):
        return not (part and heading and chars >= SHORT and not held and link_chars < 0.5 * chars)
    return link_chars >= 0.5 * chars > 0


def plain_text(x: Node) -> str:
    held, stack = [], [x]
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            held.append(p)
        else:
            stack += reversed(p.parts)
    return SPACE.sub(" ", html.unescape("".join(held)))


def comments_title(x: Node | str, article: bool) -> bool:
    if isinstance(x, str) or x.tag not in HEADINGS:
        return False
    text = plain_text(x)
    return bool(COMMENTS.fullmatch(text) or not article and BARE_COMMENTS.fullmatch(text))


def titled(x: Node, article: bool) -> bool:
    """Whether a block starts with a heading of readers' comments."""
    if x.tag not in ("div", "section", "ol", "ul", "dl", "details"):
        return False
    first = next((p for p in x.parts if not isinstance(p, str) or p.strip()), "")
    if not isinstance(first, str) and first.tag in ("header", "summary", "div"):
        first = next((p for p in first.parts if not isinstance(p, str) or p.strip()), "")
    return comments_title(first, article)


def unwanted(x: Node, article: bool, code: bool = False) -> bool:
    """Whether a subtree holds no article text; article: whether it lies within an article or main element, code: within
    code, whose marked-up words have classes of their own."""
    if x.tag in DROPPED or titled(x, article):
        return True
    if x.tag == "label":  # of a form's control; others are text
        return not article or "for" in named(x.attrs) or any(not isinstance(p, str) and p.tag in CONTROLS for p in x.parts)
    if x.tag == "math" and not article:
        return True
    if x.tag == "header" and not article:
        return True
    if not x.attrs or x.tag in ("html", "body", "article", "main", "a"):
        return False
    a = named(x.attrs)
    role = a.get("role", "").lower()
    if "hidden" in a or a.get("aria-hidden") == "true" or role in ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if code or role in MARKED or x.tag not in BLOCK | {"span"}:
        return False
    classes, name = a.get("class", ""), a.get("id", "").strip()
    if any(map(STRONG.fullmatch, classes.split())):
        return True
    strong = bool(STRONG.fullmatch(name))
    if not strong and LIKELY.search(f"{classes} {name}"):
        return False
    part = x.tag == "section" or "section" in classes.split()
    if not article and UNLIKELY.search(classes):
        return True
    if article and UNLIKELY.search(HEADER.sub(" ", classes)) and classed(x, HEADER.sub(" ", classes).split(), part):
        return True
    if not strong and not UNLIKELY.search(name):
        return False
    return not ((article or part or x.tag in HEADINGS) and anchor(x, name, part, article))


def before_comments(x: Node, article: bool) -> list[Node | str]:
    """The parts of x without a heading of readers' comments, where text comes before it, and what stands under it up to
    a heading of its level."""
    under, out = "", []
    for p in x.parts:
        if comments_title(p, article) and sum(len(q if isinstance(q, str) else plain_text(q)) for q in out if isinstance(q, str) or q.tag not in HEADINGS) >= SHORT:
            under = p.tag
        elif under and not isinstance(p, str) and (p.tag in MARKED or p.tag in HEADINGS and p.tag <= under):
            under = ""
        if not under:
            out.append(p)
    return out


def prune(root: Node) -> None:
    stack = [(root, False, False)]
    while stack:
        x, article, code = stack.pop()
        article, code = article or marked(x), code or x.tag in CODE
        x.parts = [p for p in before_comments(x, article) if isinstance(p, str) or not unwanted(p, article, code)]
        stack += [(p, article, code) for p in x.parts if not isinstance(p, str)]


def measure(root: Node) -> list[Node]:
    """Counts characters, link characters and links of every element; gives the elements in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [p for p in reversed(x.parts) if not isinstance(p, str)]
    for x in reversed(order):
        for p in x.parts:
            if isinstance(p, str):
                x.chars += len("".join(p.split()))
            else:
                x.chars += p.chars
                x.link_chars += p.chars if p.tag == "a" else p.link_chars
                x.links += p.links + (p.tag == "a")
    return order


def density(x: Node) -> float:
    return x.link_chars / x.chars if x.chars else 0.0


def paragraph_points(x: Node) -> tuple[float, str]:
    """The points of the text that is directly in a block, inline elements included."""
    held: list[str] = []
    stack = list(reversed(x.parts))
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            held.append(p)
        elif p.tag not in BLOCK:
            stack += reversed(p.parts)
    text = SPACE.sub(" ", html.unescape("".join(held))).strip()
    return (1 + sum(text.count(c) for c in ",،、，") + min(len(text) // 100, 3) if text else 0.0), text


def score(order: list[Node]) -> None:
    over: dict[Node, Node | None] = {}
    for x in order:
        up = x.parent
        over[x] = up if up is None or up.tag in BLOCK or up.tag == "#root" else over[up]
        if x.tag not in BLOCK and x.tag != "#root":
            continue
        points, _ = paragraph_points(x)
        if not points:
            continue
        points *= 1 - density(x)
        if x.tag not in ("p", "pre", "li", "td", "th", "dd", "dt", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption"):
            x.points += points  # text that has no paragraph of its own
        a, level = over[x], 0
        while a and level < FAR:
            a.points += points / (1, 2)[level] if level < 2 else points / (3 * level)
            a, level = over[a], level + 1


def final(x: Node) -> float:
    bonus = {"article": 25, "main": 10, "blockquote": 3, "pre": 3, "td": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "th": -5}.get(x.tag, 0)
    if bonus <= 0 and x.attrs and LIKELY.search(" ".join(named(x.attrs).get(k, "") for k in ("class", "id"))):
        bonus += 10
    return (x.points + (bonus if x.points else 0)) * (1 - density(x))


def menu(x: Node) -> bool:
    """A block that is mostly links; within an article they are its own, such as its references."""
    return x.tag in ("ul", "ol", "dl", "div", "section", "table", "p") and x.links >= 3 and density(x) > 0.7


def sparse(x: Node) -> bool:
    return density(x) < SPARSE


def container(order: list[Node]) -> tuple[list[Node], set[Node]]:
    """The element that encloses the best one, with siblings, and those of its blocks that are left out."""
    best = max(order, key=final, default=None)
    if best is None or best.points <= 0:
        return order[:1], set()
    path = list(above(best))
    said = [x for x in path if marked(x)]
    home = said[-1] if said else next((x for x in reversed(path) if sparse(x)), best)
    out: set[Node] = set()
    way = set(path)
    for x in path[1 : path.index(home) + 1] if not said else ():
        out |= {p for p in x.parts if not isinstance(p, str) and p not in way and p.tag in BLOCK and not sparse(p)}
    kept = []
    limit = max(10.0, ENOUGH * final(best))
    for s in home.parent.parts if home.parent else [home]:
        if isinstance(s, str):
            continue
        if s is home:
            kept.append(s)
        elif s.tag in BLOCK and not menu(s) and sparse(s) and (final(s) >= limit or s.tag == home.tag == "article"):
            kept.append(s)
        elif s.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and s.chars and sparse(s):
            kept.append(s)
    whole = {next((x for x in reversed(said) if marked(x) == "article"), home)} if said else set()
    out |= {x for x in order if menu(x) and not any(a in whole or marked(a) == "article" for a in above(x))}
    return kept, out


def blocks(kept: list[Node], left_out: set[Node]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            out.append(text)
        held.clear()

    for top in kept:
        flush()
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x.tag == "br":
                held.append(" ")
            elif x is not top and x in left_out:
                flush()
            else:
                block = x.tag in BLOCK or x is top
                if block:
                    flush()
                    stack.append(None)
                stack += reversed(x.parts)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    prune(root)
    order = measure(root)
    score(order)
    return " ".join(blocks(*container(order)))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages, in one narrow pass."""

    bounded(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RESULT)
        for whole in batches:
            for batch in slices(whole, source):
                texts = [main_text(x) for x in batch.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(page_id).cast(pa.int64()), batch.column(url).cast(schema.field("url").type), pa.array(texts, schema.field("text").type), pa.array(map(len, texts), pa.int64())], names=schema.names
                )

    return pages.select(page_id, url, source).mapInArrow(run, RESULT)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
