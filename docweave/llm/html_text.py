"""HTML extraction by tag-path ratios.

Each page is cut into blocks of text, each with its root-to-block tag path (tags and first classes). Per path
the lengths of text and the punctuation marks outside links are summed and divided by the number of blocks.
The fused ratio of both, the root of their product, is smoothed over the tree of paths in one pass up and one
down: paths of one container support each other, so headings, lists, tables and captions beside good
paragraphs count, while little passes out of a container that holds most of its surroundings' text. A path is
content if its smoothed ratio lies above a threshold that the page's own ratios set (the best split of the
paths into two groups, between two shares of the best ratio).

Stated roles break ties. What stands in an element that says to be a menu, footer, advert, form, comment ...
is left out; a role stated by class, id or role alone is not believed of what holds an <article> or <main>, or
of most text of a page without them, if that is more than a notice. <article> and <main> raise the ratios of
what they hold. main_text(page, roles=False) goes by the ratios alone.

Cases: null or empty html gives an empty text; a page that is cut off anywhere is read as far as it goes,
a tag without its end is dropped; attributes without or with blank values say nothing; paths of equal ratios
are taken or left together; pages are independent, so repeated rows and further columns change nothing (a
column text is replaced); an empty table gives no rows; nothing is capped, and the work is linear in the html,
however deep or long.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[\s/]*+[^\s>/][^\s=>/]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+[\s/]*+)>")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas select".split())
#: Elements of a page that are not shown as its text.
UNSEEN = frozenset("head title".split()) | RAW
#: Elements whose name alone says that they are no article text.
ASIDE = frozenset("nav header footer aside form button dialog menu label fieldset".split())
#: Words of class, id and role that say so.
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner\w*|breadcrumb\w*|comment\w*|consent|cookie\w*|disqus|footer|foot|header|login|masthead|menu\w*|modal|nav\w*|newsletter|notice\w*|pagination|pager|popup|promo\w*|related|replies|reply|share|sharing|sidebar\w*|side|signup|skip|social|sponsor\w*|subscribe|tags|toolbar|widget\w*|complementary|contentinfo|navigation|search|alert)(?=$|[\s_-])",
    re.I,
)
#: Parts of class names that say something of what holds or surrounds an aside; and words that count as a whole name only.
AROUND = frozenset("has with without no wrap wrapper container layout page body content main".split())
WHOLE = frozenset(("side", "search"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
#: Elements that group blocks; what is smoothed down into one is halved.
GROUPS = frozenset("article aside div footer form header main nav section".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag ends, and the elements beyond which it does not look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Smoothing: what passes down to an element, and into a group; up from a part among others, and out of a container with most text around.
DOWN, INTO, UP, OUT = 0.9, 0.5, 0.8, 0.1
#: Paths below the first share of the best ratio are never content, those above the second always are.
LEAST, SURE = 0.2, 0.5
#: How much an <article> or <main> raises the ratio of what it holds.
RAISE = 6
#: Characters from which on an element can be most of a page.
SOME_TEXT = 80


class Path:
    """A node of the tree of paths, with the sums over its own blocks."""

    __slots__ = ("below", "elements", "group", "length", "link", "marks", "n", "parent", "ratio")

    def __init__(self, parent: Path | None, group: bool):
        self.parent, self.group, self.below = parent, group, {}
        self.elements = self.n = self.length = self.marks = self.link = 0
        self.ratio = 0.0

    def step(self, label: str, group: bool) -> Path:
        if label not in self.below:
            self.below[label] = Path(self, group)
        return self.below[label]


class Block:
    __slots__ = ("aside", "link", "main", "named", "path", "text")

    def __init__(self, path: Path, text: str, link: int, aside: bool, main: bool, named: int):
        self.path, self.text, self.link, self.aside, self.main, self.named = path, text, link, aside, main, named


class Element:
    """An open element; what it says of itself counts for all inside."""

    __slots__ = ("aside", "main", "named", "path", "tag")

    def __init__(self, tag: str, path: Path, aside: bool, main: bool, named: int):
        self.tag, self.path, self.aside, self.main, self.named = tag, path, aside, main, named


def named_aside(words: str) -> bool:
    """Whether a class, id or role is an aside's; has-sidebar, content-sidebar-wrap, side-by-side or search-results are not."""
    for name in words.lower().split():
        parts = re.split("[_-]+", name)
        if ASIDE_WORDS.search(name) and (len(parts) == 1 or (not AROUND.intersection(parts) and ASIDE_WORDS.search(" ".join(x for x in parts if x not in WHOLE)))):
            return True
    return False


def described(attributes: str) -> tuple[str, str, bool]:
    """The first class, all words of class, id and role, and whether the element is hidden."""
    first, words, hidden = "", [], False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            words.append(value)
            if name == "class" and not first:
                first = next(iter(value.split()), "")
        elif name == "hidden":
            hidden |= value.strip().lower() != "false"
        elif name == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif name == "style":
            hidden |= bool(NOT_SHOWN.search(value))
    return first, " ".join(words), hidden


def tokens(page: str):
    """(text, None) and (None, (closing, tag, attributes)) in order, as far as the page goes."""
    at, low, end = 0, None, len(page)
    while at < end:
        if page[at] != "<":
            to = page.find("<", at)
            to = end if to < 0 else to
            yield page[at:to], None
            at = to
            continue
        m = TAG.match(page, at)
        if m is None:
            after = page[at + 1 : at + 2]
            if after.isalpha() and after.isascii():
                return  # cut off within a tag
            other = OTHER.match(page, at)
            if other is None:
                yield "<", None
            at = other.end() if other else at + 1
            continue
        at = m.end()
        closing, tag, attributes = bool(m[1]), m[2].lower(), m[3]
        if tag in RAW and not closing and not attributes.endswith("/"):
            low = low if low is not None else page.lower()
            at = low.find(f"</{tag}", at)
            if at < 0:
                return
            at = low.find(">", at) + 1 or end
            continue
        yield None, (closing, tag, attributes)


def blocks(page: str, roles: bool = True) -> tuple[Path, list[Block]]:
    """The tree of paths and the page's blocks of text in order; with roles, without those in elements of another role."""
    root = Path(None, True)
    out: list[Block] = []
    bottom = Element("", root, False, False, -1)
    stack: list[Element] = []
    is_open: dict[str, int] = {}
    parts: list[str] = []
    linked, unseen = 0, 0
    around: list[int] = []  # of each element that is an aside by name: the one around it
    holds: set[int] = set()  # those that hold an article

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                e = stack[-1] if stack else bottom
                out.append(Block(e.path, text, min(linked, len(text)), e.aside, e.main, e.named))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal unseen
        if any(e.tag not in INLINE for e in stack[k:]):
            end_block()
        for e in stack[k:]:
            is_open[e.tag] -= 1
            unseen -= e.tag in UNSEEN
        del stack[k:]

    for text, found in tokens(page):
        if text is not None:
            if not unseen:
                parts.append(text)
                if is_open.get("a"):
                    linked += len(text.strip())
            continue
        closing, tag, attributes = found
        if closing:
            if tag == "br":
                parts.append(" ")
            if is_open.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in CLOSES_P and is_open.get("p"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in ENDS:
            ended, beyond = ENDS[tag]
            if any(is_open.get(t) for t in ended):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in beyond:
                        break
                    if stack[k].tag in ended:
                        pop_to(k)
                        break
        if tag not in INLINE:
            end_block()
        if tag in VOID or attributes.endswith("/"):
            if tag == "br":
                parts.append(" ")
            continue
        up = stack[-1] if stack else bottom
        aside, main, named, path = up.aside, up.main, up.named, up.path
        first, words, hidden = described(attributes) if attributes else ("", "", False)
        if tag not in ("html", "body"):
            aside |= hidden or (tag in ASIDE and not (tag == "header" and main))
            if not aside and words and named_aside(words):
                if tag in INLINE:
                    aside = True
                else:
                    around.append(named)
                    named = len(around) - 1
        if tag in MAIN:
            if not main and not aside and named == up.named:
                k = named
                while k >= 0 and k not in holds:
                    holds.add(k)
                    k = around[k]
            main = main or named == up.named
        if tag not in INLINE:
            path = path.step(f"{tag}.{first}" if first else tag, tag in GROUPS)
            path.elements += 1
        stack.append(Element(tag, path, aside, main, named))
        is_open[tag] = is_open.get(tag, 0) + 1
        unseen += tag in UNSEEN
    end_block()
    if roles:
        seen = [b for b in out if not b.aside]
        if around:
            inside = [0] * len(around)
            for b in seen:
                if b.named >= 0:
                    inside[b.named] += len(b.text)
            for k in range(len(around) - 1, -1, -1):  # what holds others comes before them
                if around[k] >= 0:
                    inside[around[k]] += inside[k]
            total = sum(len(b.text) for b in seen)
            by_text = not any(b.main for b in seen)
            left_out = [False] * len(around)
            for k, outer in enumerate(around):
                believed = k not in holds and not (by_text and 2 * inside[k] > total and inside[k] >= SOME_TEXT)
                left_out[k] = believed or (outer >= 0 and left_out[outer])
            seen = [b for b in seen if b.named < 0 or not left_out[b.named]]
        out = seen
    return root, out


def smooth(root: Path) -> None:
    """Makes each path's ratio the smoothed one: one pass up the tree of paths and one down."""
    order = [root]
    for p in order:  # grows while it is gone through: parents before their children
        order.extend(p.below.values())
    mass = {id(p): p.length for p in order}
    best = {id(p): p.ratio for p in order}
    for p in reversed(order):
        if p.parent is None:
            continue
        mass[id(p.parent)] += mass[id(p)]
    for p in reversed(order):
        up = p.parent
        if up is None:
            continue
        if not p.below or best[id(p)] == p.ratio:
            passes = 1.0  # text of its own: it speaks for its container
        elif p.elements >= 2 * max(1, up.elements) or 2 * mass[id(p)] < mass[id(up)]:
            passes = UP
        else:
            passes = OUT
        best[id(up)] = max(best[id(up)], passes * best[id(p)])
    for p in order:
        if p.parent is not None:
            best[id(p)] = max(best[id(p)], (INTO if p.group else DOWN) * best[id(p.parent)])
        p.ratio = best[id(p)]


def threshold(ratios: list[float]) -> float:
    """Splits the ratios into two groups so that they differ most between the groups (weighted by their sizes)."""
    values = sorted(ratios, reverse=True)
    if not values or values[0] <= 0:
        return 0.0
    n, total, head, best, cut = len(values), sum(values), 0.0, -1.0, values[0]
    for k in range(1, n):
        head += values[k - 1]
        if values[k] < values[k - 1]:
            between = k * (n - k) * (head / k - (total - head) / (n - k)) ** 2
            if between > best:
                best, cut = between, (values[k - 1] + values[k]) / 2
    return min(max(cut, LEAST * values[0]), SURE * values[0])


def select(root: Path, found: list[Block], roles: bool = True) -> list[Block]:
    """The blocks on content paths: ratios by path, fused, smoothed, thresholded."""
    used: dict[int, Path] = {}
    raised: set[int] = set()
    for b in found:
        p = b.path
        used[id(p)] = p
        p.n += 1
        p.length += len(b.text)
        p.marks += len(PUNCTUATION.findall(b.text))
        p.link += b.link
        if b.main and roles:
            raised.add(id(p))
    own: dict[int, float] = {}
    for k, p in used.items():
        own[k] = 1 - p.link / p.length  # the share outside links
        p.ratio = own[k] * (p.length * (p.marks + 0.1) / p.n) ** 0.5
    smooth(root)
    ratio = {k: own[k] * p.ratio * (RAISE if k in raised else 1) for k, p in used.items()}
    least = threshold(list(ratio.values()))
    return [b for b in found if ratio[id(b.path)] > 0 and ratio[id(b.path)] >= least]


def main_text(page: str | None, roles: bool = True) -> str:
    return "\n".join(b.text for b in select(*blocks(page, roles), roles)) if page else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, with text string (a column text is replaced). No shuffle."""
    kept = [c for c in pages.columns if c not in (html, "text")]
    schema = pages.select(*kept, F.lit("").alias("text")).schema

    def run(batches):
        for batch in common.slices(batches, html):
            texts = pa.array([main_text(p) for p in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], [*kept, "text"])

    return pages.select(*kept, html).mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
