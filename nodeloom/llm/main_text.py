"""Main text of web pages by the distribution of their line blocks.

1. Markup is stripped to lines: block elements (and two line breaks in a row) begin a new line, other tags
   vanish, character references are decoded, white space becomes one space.  What stands in elements
   that are never main text (scripts, styles, menus, headers and footers of the page, sidebars, notices,
   adverts, forms, reader comments: by element, role or the words of class and id) is no line at all.
2. A line weighs its characters outside links.  Sums over windows of WINDOW lines rise at a surge
   and fall at a dive: a window weighs if it holds SURGE characters or SHARE of the page's heaviest.
3. The runs of weighing windows show the place of the main text.  If they lie in an ``article`` or ``main`` element,
   surge and dive are moved to that element's ends.  Without one, the lines from each run's surge to its dive are
   kept if the run weighs SHARE of the heaviest, with the headings right before, and so are the lines beside them in
   the element that holds a long line.

Pages are independent: one pass, no shuffle; a page is held whole by one task.

Edge cases: a null or empty page, and one without text, have an empty text; unclosed elements end with the one
around them; an unclosed script, comment or tag goes on to the end; ``<`` before neither letter, ``/``, ``!`` nor ``?``
is text; repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, SHARE, GAP = 3, 80, 0.2, 3
#: Times that an article's text counts against text outside.
FAVOUR = 4

# Kinds of HTML elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes template title textarea xmp svg math canvas object audio video select".split())
NEVER = frozenset("nav aside footer form dialog menu button head fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset(("article", "main"))
#: Blocks that hold a line of their own.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre dt dd figcaption caption summary".split())
ITEMS, AROUND = frozenset("li dt dd tr td th option".split()), ("ul", "ol", "dl", "table")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words of class and id that name what is not main text, and pairs of words.
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored sponsors promo promos promotion promoted sidebar sidenav aside widget widgets nav navbar navi navigation menu menus submenu breadcrumb breadcrumbs masthead footer topbar bottombar cookie cookies cookiebar gdpr consent notice notices notification alert alerts popup popover modal overlay lightbox newsletter subscribe subscription signup signin login register paywall share sharing shares social socials comment comments commentlist disqus respond replies reply related recommended recommendations recirc trending popular pagination pager toolbar search searchbox copyright disclaimer skip skiplink outbrain taboola tagcloud blogroll hidden".split())
PAIRS = frozenset((("side", "bar"), ("site", "header"), ("page", "header"), ("global", "header"), ("main", "header"), ("top", "header"), ("site", "info"), ("read", "more"), ("read", "next"), ("more", "stories"), ("see", "also"), ("sign", "up"), ("back", "top"), ("tool", "bar"), ("bread", "crumb"), ("nav", "bar")))
#: Words by which even an ``article`` is not main text.
FOREIGN = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related recommended".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_ends: dict[str, re.Pattern[str]] = {}


@dataclass
class Line:
    text: str
    weight: int  #: characters outside links
    root: int  #: number of the outermost ``article`` or ``main`` element around it, or 0
    article: int  #: number of the innermost one, or 0
    place: int  #: number of the element that holds the line's block
    heading: bool


def foreign(tag: str, attributes: str) -> bool:
    """Whether an element is never main text."""
    if tag in NEVER:
        return True
    if not attributes or attributes.isspace():
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES or _INVISIBLE.search(found.get("style", "")):
        return tag not in ("html", "body")
    if tag in ("html", "body"):
        return False
    for name in ("class",) if tag in HEADINGS else ("class", "id"):  # a heading's id repeats its text
        for value in html.unescape(found.get(name, "")).split():
            words = [w.lower() for w in _PART.findall(value)]
            if tag in ROOTS:
                if not FOREIGN.isdisjoint(words):
                    return True
            elif not WORDS.isdisjoint(words) or any(p in PAIRS for p in zip(words, words[1:])):
                return True
    return False


def lines(page: str) -> list[Line]:
    """The page's lines in order, without markup and without what is never main text."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int, int]] = []  # element, never main text, number of an article, number
    held: list[str] = []
    linked = breaks = shut = number = 0
    link: int | None = None  # open elements when the link began
    heading = False

    def end() -> None:
        nonlocal linked, heading, breaks
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            roots = [r for _, _, r, _ in stack if r]
            place = next((n for name, _, _, n in reversed(stack) if name in BLOCKS and name not in LEAVES), 0)
            out.append(Line(text, max(0, len(text) - linked), roots[0] if roots else 0, roots[-1] if roots else 0, place, heading))
        held.clear()
        linked, heading, breaks = 0, False, 0

    def close(depth: int) -> None:
        nonlocal shut, link
        shut -= sum(bad for _, bad, _, _ in stack[depth:])
        del stack[depth:]
        if link is not None and depth < link:
            link = None

    def say(text: str) -> None:
        nonlocal linked, breaks
        if text and not shut:
            held.append(text)
            if not text.isspace():
                breaks = 0
                if link is not None:
                    linked += len(html.unescape(text).strip())

    def innermost(names: tuple[str, ...] | frozenset[str]) -> int | None:
        return next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in names), None)

    at = 0
    while found := _TOKEN.search(page, at):
        say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:  # comment, declaration
            continue
        if found[1]:
            if tag == "a":
                link = None
            if tag in BLOCKS:
                end()
            depth = innermost((tag,))
            # An inline element does not end the blocks that were opened in it.
            if depth is not None and (tag in BLOCKS or not any(x[0] in BLOCKS for x in stack[depth + 1 :])):
                close(depth)
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                end()
            elif not shut:
                held.append(" ")
            continue
        if tag in RAW:
            if not found[3].endswith("/"):
                stop = _ends.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE)).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag in BLOCKS:
            end()
            # A block ends an open paragraph; items and cells end their like in the same list or table.
            for depth, name in ((innermost(BLOCKS), "p"), (innermost((tag, *AROUND)), tag) if tag in ITEMS else (None, "")):
                if depth is not None and depth < len(stack) and stack[depth][0] == name:
                    close(depth)
        if tag in VOID or found[3].endswith("/"):
            continue
        if tag == "a":
            link = len(stack)
        bad = foreign(tag, found[3]) or (tag == "header" and innermost(ROOTS) is None)
        if tag in BLOCKS or bad or shut:
            number += 1
            stack.append((tag, bad, number if tag in ROOTS else 0, number))
            shut += bad
        heading = heading or tag in HEADINGS
    say(page[at:])
    end()
    return out


def windows(weights: list[int], window: int = WINDOW) -> list[int]:
    """Sum of each line's weight and those of the next ``window - 1`` lines."""
    total, out = sum(weights[:window]), []
    for i in range(len(weights)):
        out.append(total)
        total += (weights[i + window] if i + window < len(weights) else 0) - weights[i]
    return out


def runs(sums: list[int], gap: int = GAP) -> list[tuple[int, int]]:
    """(surge, dive) of the runs of weighing windows, at most ``gap`` lines apart; the dive is the line behind the last window."""
    least = min(SURGE, SHARE * max(sums, default=0))
    out: list[tuple[int, int]] = []
    for i, s in enumerate(sums):
        if s > 0 and s >= least:
            if out and i - out[-1][1] < gap:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
    return out


def main_lines(found: list[Line]) -> list[Line]:
    """The lines between surge and dive."""
    weights = [x.weight for x in found]
    places = runs(windows(weights))
    roots: dict[int, int] = {}
    for x in found:
        if x.root:
            roots[x.root] = roots.get(x.root, 0) + x.weight
    outside = sum(x.weight for a, b in places for x in found[a:b] if not x.root)
    if roots and FAVOUR * max(roots.values()) >= outside:
        held = [x for x in found if x.root == max(roots, key=lambda r: roots[r])]
        nested: dict[int, int] = {}
        for x in held:
            nested[x.article] = nested.get(x.article, 0) + x.weight
        best = max(nested, key=lambda r: nested[r])
        # An article that holds most of its main element's text is the article.
        return [x for x in held if x.article == best] if 2 * nested[best] > sum(nested.values()) else held
    mass = [sum(weights[a:b]) for a, b in places]
    keep = [False] * len(found)
    for (a, b), m in zip(places, mass, strict=True):
        if m < SHARE * max(mass):
            continue
        while a < b - 1 and weights[a] < SURGE and not found[a].heading:  # windows rise before the first long line
            a += 1
        while a and found[a - 1].heading:
            a -= 1
        keep[a:b] = [True] * (b - a)
    long = {x.place for x, k in zip(found, keep, strict=True) if k and x.weight >= SURGE and x.place}
    return [x for x, k in zip(found, keep, strict=True) if k or (x.place in long and x.weight)]


def main_text(page: str | None) -> str:
    return "\n".join(x.text for x in main_lines(lines(page or "")))


def extract(pages: DataFrame, name: str = "text") -> DataFrame:
    """(page_id, url, text) of every row of ``pages(page_id, url, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x) for x in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text], names=["page_id", "url", name])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, {name} string")


def op12_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


def _oracle() -> str:
    """The result for pages like the given ones: one article of headings and paragraphs, entities of markup only."""
    blocks = "string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '<br>', ' ', 'g'), '</?(p|h1)>')"
    plain = "regexp_replace(x, '<[^>]*>', '', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
        plain = f"replace({plain}, '&{name};', '{char}')"
    text = f"array_to_string(list_filter(list_transform({blocks}, lambda x: trim(regexp_replace({plain}, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
    return f"SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, {text} AS text FROM pages)"


ORACLE_SQL = _oracle()
