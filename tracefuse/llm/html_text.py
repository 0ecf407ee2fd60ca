"""Main-text extraction from HTML by two-pass block rules.

Markup is cut into blocks.  Pass one decides each block from its stop-word
density, length and link density; inside an article headings and short blocks
are not decided by the links they hold.  Scripts other than Latin have no list
of stop words here: there a block counts as prose by its length and its
sentence ends.  Pass two lets every undecided block inherit the label of its
nearest decided neighbours in the same container region: both sides agree, or
the nearer one, or the good one at equal distance inside an article.

Elements that name themselves (menus, footers, sidebars, notices, adverts,
forms, comments) are bad before pass one.  An element name says so always, a
class, id or role only

* from a whole token, up to a qualifier (``has-sidebar`` names no sidebar),
* never for an article or ``main`` element itself, nor for what holds the
  page's core: its ``main`` element, else its article with most prose (inside a
  named element only with half of the page's prose or more),
* for layout words (``legal``, ``tags``, ``search``): inside an article only
  where the element has no long good block of its own, and on a page without
  core only where it holds no more than half of the prose that nothing else names.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.llm.common import texts

# Frequent function words of the languages served.
STOP_WORDS = frozenset("""
the of and to in is that it was for on are with as be by this not or from at an he she they you we his her their which
der die das und ist von zu mit sich auf für den dem des ein eine einer nicht im es auch als an aus bei nach wie
le la les de des du un une et est que qui dans pour par sur pas au aux avec ce il elle ne se plus ou
el los las del una y en que con por para su al lo como más pero sus se es
il lo gli della dei delle di che per con sono non si come anche più alla nel
os das dos da do em um uma não é com mais foi ao pelo
het een van voor niet zijn op aan met ook maar dat er
nie się na jest że do jak ale przez
""".split())

# Elements by role.
RAW_TEXT = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "button", "select",
           "menu", "dialog", "object", "canvas", "audio", "video", "map", "fieldset", "label"}
MAIN = {"article", "main"}
CONTAINERS = {"html", "body", "div", "section", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "center",
              "figure", "details", "blockquote"} | DROPPED | MAIN
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "address", "hr", "summary",
          "caption", "figcaption", "legend", "option"} | CONTAINERS
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}

# Words of class, id and role attributes that name boilerplate.
BAD_HINTS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|foot(?:er)?\w*|"
    r"side-?bar\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe\w*|"
    r"related|breadcrumbs?|pagination|pager|comments?|comment-?list|disqus|replies|respond|hidden|contentinfo|"
    r"complementary)(?:$|[_-])", re.I)
# Words that name boilerplate or just layout.
LAYOUT_HINTS = re.compile(
    r"(?:^|[_-])(?:banner|rail|widget\w*|overlay|signup|login|search|share|sharing|social|recommend\w*|toolbar|"
    r"copyright|legal|skip|form|tags?|taglist)(?:$|[_-])", re.I)
# Words that name the head of a page, or of an article inside one.
HEAD_HINTS = re.compile(r"(?:^|[_-])(?:header|masthead|topbar)(?:$|[_-])", re.I)
# Words that say that what follows is beside an element, or missing.
QUALIFIER = re.compile(r"(?:^|[_-])(?:has|no|not|with|without)[_-]", re.I)
HINT_ATTRIBUTES = ("class", "id", "role")
ATTRIBUTE = re.compile(r"""([^\s=>"'/][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

# a quote opens a value only after "=": elsewhere, as inside an unquoted value, it is a plain character
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'=][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
# in page text white space is ASCII white space and what it may be written as
SPACE = re.compile(r"\s+")
LETTERS = re.compile(r"[^\W\d_]+")
FOREIGN = re.compile("[^\\W\\d_\u0000-\u024f\u1e00-\u1eff]+")  # letters outside the Latin blocks
DENSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")  # scripts that write a word in one or two characters
SENTENCE_END = re.compile("[.!?…。！？।؟۔]")
WORD_EDGE = ".,;:!?()[]{}\"'«»“”„’…#*$%&|<>"

LENGTH_LOW = 70
LENGTH_HIGH = 200
STOP_LOW = 0.10
STOP_HIGH = 0.20
MAX_LINK_DENSITY = 0.4
DENSE_WEIGHT = 3  # length that a character of a dense script counts

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"


STRONG, LAYOUT, HEAD = "strong", "layout", "head"


def attributes(attrs: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of equal ones; values without their quotes."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in "\"'" and value[:1] == value[-1:] else value)
    return out


def hint_of(found: dict[str, str]) -> str:
    """What class, id and role say of an element: boilerplate, layout, a head, or nothing (empty)."""
    hint = ""
    for key in HINT_ATTRIBUTES:
        for token in found.get(key, "").split():
            q = QUALIFIER.search(token)
            token = token[:q.start()] if q else token
            if BAD_HINTS.search(token) or key == "role" and token.lower() in ("navigation", "dialog"):
                return STRONG
            if LAYOUT_HINTS.search(token):
                hint = LAYOUT
            elif not hint and HEAD_HINTS.search(token):
                hint = HEAD
    return hint


def is_hidden(found: dict[str, str]) -> bool:
    return ("hidden" in found or found.get("aria-hidden", "").lower() == "true"
            or bool(NO_DISPLAY.search(found.get("style", ""))))


class Element:
    """A container: its parent, what its name and attributes say, and the prose in it."""

    __slots__ = ("name", "parent", "hard", "hint", "prose", "core", "dropped", "region")

    def __init__(self, name, parent, hard, hint):
        self.name, self.parent, self.hard, self.hint = name, parent, hard, hint
        self.prose, self.core, self.dropped, self.region = 0, False, False, 0


class Block:
    __slots__ = ("text", "link_chars", "heading", "element", "hard", "hint", "size", "density", "dropped", "region")

    def __init__(self, text, link_chars, heading, element, hard, hint):
        self.text, self.link_chars, self.heading = text, link_chars, heading
        self.element, self.hard, self.hint = element, hard, hint
        self.size, self.density = weigh(text)
        self.dropped, self.region = False, 0

    def is_prose(self) -> bool:
        return (self.size >= LENGTH_LOW and self.density >= STOP_HIGH
                and self.link_chars <= MAX_LINK_DENSITY * len(self.text))


def weigh(text: str) -> tuple[int, float]:
    """Length and stop-word density (0 for short texts, which it does not decide).

    In foreign scripts a sentence end stands for the stop words.
    """
    if not text.isascii() and FOREIGN.search(text):
        foreign = sum(map(len, FOREIGN.findall(text)))
        if 2 * foreign > sum(map(len, LETTERS.findall(text))):
            size = len(text) + (DENSE_WEIGHT - 1) * len(DENSE.findall(text))
            return size, 1.0 if SENTENCE_END.search(text) else 0.0
    if len(text) < LENGTH_LOW:
        return len(text), 0.0
    words = text.lower().split()
    return len(text), sum(w.strip(WORD_EDGE) in STOP_WORDS for w in words) / len(words)


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order: white space collapsed, character references decoded, dropped ones marked."""
    out: list[Block] = []
    elements = [Element("", None, False, "")]
    stack = elements[:]
    parts: list[str] = []
    links: list[str] = []
    in_link, heading, hard, hint = False, False, False, ""  # hard, hint: of the block's own element

    def flush():
        nonlocal parts, links
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                linked = len(SPACE.sub(" ", unescape("".join(links))).strip()) if links else 0
                out.append(Block(text, linked, heading, stack[-1], hard, hint))
            parts, links = [], []

    at, size = 0, len(html)
    while at < size:
        m = TAG.search(html, at)
        upto = m.start() if m else size
        if upto > at:
            piece = html[at:upto]
            parts.append(piece)
            if in_link:
                links.append(piece)
        if not m:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, closing = name.lower(), bool(m["end"])
        if name in RAW_TEXT and not closing and not (m["attrs"] or "").endswith("/"):
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|</{name}\Z", re.I).search(html, at)
            at = end.end() if end else size
            if name != "title":
                continue
        elif name == "br":
            parts.append(" ")
            if in_link:
                links.append(" ")
        elif name == "a":
            in_link = not closing
        elif name in BLOCKS:
            flush()
            in_link = False
            heading = not closing and len(name) == 2 and name[0] == "h" and name[1] in "123456"
            attrs = m["attrs"] or ""
            found = attributes(attrs) if attrs and not closing else {}
            hard, hint = False, ""
            if name not in CONTAINERS:
                if found:
                    hard, hint = is_hidden(found), "" if heading else hint_of(found)
            elif closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
            elif not attrs.endswith("/"):
                wraps = name in ("html", "body")
                element = Element(name, stack[-1], name in DROPPED, "")
                if found and not wraps:
                    element.hard, element.hint = element.hard or is_hidden(found), hint_of(found)
                elements.append(element)
                stack.append(element)
    flush()
    resolve(elements, out)
    return out


def core_of(elements: list[Element], total: int) -> Element | None:
    """The ``main`` element or article that holds the page's text, if one shows itself.

    Candidates name no boilerplate and lie in none by element name (a form may
    wrap a whole page).  Those that no hint encloses come first, ``main`` before
    articles, then the one with most prose; an enclosed article must hold half
    of the page's prose.
    """
    best, rank = None, None
    shut = {id(elements[0]): (False, False)}  # by element: inside one named away, inside a hinted one
    for e in elements[1:]:
        away, hinted = shut[id(e.parent)]
        if e.name in MAIN and not away and not e.hard and (e.name == "main" or e.hint != STRONG):
            if not hinted or e.name == "main" or 2 * e.prose >= total > 0:
                mine = (not hinted, e.name == "main", e.prose)
                if rank is None or mine > rank:
                    best, rank = e, mine
        shut[id(e)] = (away or e.hard and e.name != "form", hinted or e.hard or e.name not in MAIN and bool(e.hint))
    return best


def resolve(elements: list[Element], blocks: list[Block]) -> None:
    """Settles which blocks are dropped before pass one, and every block's region (0: none)."""
    total = 0
    for b in blocks:
        if b.is_prose():
            b.element.prose += len(b.text)
            total += len(b.text)
    for e in reversed(elements[1:]):  # children come after their parents
        e.parent.prose += e.prose
    core = core_of(elements, total)
    e = core
    while e is not None:
        e.core = True
        e = e.parent
    named = {id(elements[0]): False}  # by element: dropped whatever its prose
    for e in elements[1:]:
        named[id(e)] = named[id(e.parent)] or not e.core and (e.hard or e.name not in MAIN and e.hint == STRONG)
    total = sum(len(b.text) for b in blocks if not named[id(b.element)] and b.is_prose())
    regions = 0
    for e in elements[1:]:
        region = e.parent.region
        hard = e.hard and not (e.name == "header" and region) and not (e.name == "form" and e.core)
        e.dropped = e.parent.dropped or hard or not e.core and e.name not in MAIN and speaks(
            e.hint, region, e.prose, total, core)
        e.region = region
        if e.name in MAIN and not e.dropped:
            regions += 1
            e.region = regions
    for b in blocks:
        b.region = b.element.region
        b.dropped = b.element.dropped or b.hard or speaks(
            b.hint, b.region, len(b.text) if b.is_prose() else 0, total, core)


def speaks(hint: str, region: int, prose: int, total: int, core: Element | None) -> bool:
    """Whether a hint drops an element with ``prose`` characters of prose."""
    if not hint or hint == STRONG:
        return bool(hint)
    if region:
        return hint == LAYOUT and not prose
    return core is not None or 2 * prose <= total


def decide(block: Block) -> str:
    """Pass one: good, bad, or undecided (short or near)."""
    size, density = block.size, block.density
    if block.dropped:
        return BAD
    if block.region and block.heading:  # headings of an article often link to themselves
        return SHORT
    if block.link_chars > MAX_LINK_DENSITY * len(block.text):
        return BAD
    if block.text.startswith(("©", "&copy")) and not block.region:
        return BAD
    if size < LENGTH_LOW:
        return BAD if block.link_chars and not block.region else SHORT
    if density >= STOP_HIGH:
        return GOOD if size > LENGTH_HIGH or block.region else NEAR
    if density >= STOP_LOW:
        return NEAR
    return NEAR if block.region else BAD  # an article may hold lists and figures without function words


def inherit(labels: list[str], regions: list[int], dropped: list[bool]) -> list[bool]:
    """Pass two: undecided blocks take the label of their nearest decided neighbours.

    Neighbours count within the block's own region (an article or main
    element, or the rest of the page); inside an article, a container that
    names itself boilerplate says nothing about the text beside it.  A region in which nothing is decided is
    good if it is an article or main element, else good where a block is near.
    """
    n = len(labels)
    far = n + 1
    before: list[tuple[int, str | None]] = [(far, None)] * n
    after: list[tuple[int, str | None]] = [(far, None)] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[int, str]] = {}
        for i in order:
            if regions[i] in last:
                k, label = last[regions[i]]
                side[i] = (abs(i - k), label)
            if labels[i] in (GOOD, BAD) and not (dropped[i] and regions[i]):
                last[regions[i]] = (i, labels[i])
    keep = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            keep.append(label == GOOD)
            continue
        (d1, l1), (d2, l2) = before[i], after[i]
        if l1 is None and l2 is None:
            keep.append(bool(regions[i]) or label == NEAR)
        elif l1 is None or l2 is None or l1 == l2:
            keep.append((l1 or l2) == GOOD)
        elif d1 != d2:
            keep.append((l1 if d1 < d2 else l2) == GOOD)
        else:
            keep.append(bool(regions[i]) or label == NEAR)
    return keep


def main_text(html: str) -> str:
    """Main text of a page: kept blocks in page order, one per line."""
    blocks = blocks_of(html)
    keep = inherit([decide(b) for b in blocks], [b.region for b in blocks],
                   [b.dropped for b in blocks])
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) per page.

    Edge cases: NULL or empty html gives the empty text; unclosed elements,
    comments and scripts run to the end of the page; NULL url stays NULL;
    repeated rows each get their row; an empty table gives an empty result;
    only page_id, url and html are read.
    """

    def run(batches):
        for b in batches:
            out = [main_text(h) for h in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
