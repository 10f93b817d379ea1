r"""Main text of web pages by site template removal (operator 3).

Each page is parsed into elements and text blocks. Every block-level element's subtree has two hashes: its *slot* (the
tags, classes and ids from the body down to it, numbers of three digits or more apart) and its *content* (what it holds, digits apart, bottom up).
Spark counts both per host, by pages; pages whose longest blocks agree in a
MinHash of their words are copies and count once. Deleted are

* contents that recur: on ``max(least, share * pages)`` pages of their host, or on ``main_share`` of them where the slot
  holds much of the host's text (``mass``), as articles may quote a common passage;
* slots that recur on half of the host's pages or more, hold little of its text, and whose contents are drawn from a
  pool: ``pool`` of them or more stand on other pages of the host too (menus, footers and adverts that rotate).

Headings recur with near copies of an article, so they count as slots that hold much text.

What a site's pages can't show (too few of them, subtrees that don't recur) falls to the markup afterwards: navigation,
header, footer, aside, form, script and style elements, and elements whose class, id or role names one of these, a
notice, an advert or reader comments; last, if the page marks its article or main part, only that is text. The columns
n_template_blocks, n_markup_blocks and n_outside_blocks tell how many blocks each of the three took away.

Text rules: character references are decoded, white space inside a block becomes one blank, blocks are trimmed, empty
ones go, and the rest is joined in page order by two line feeds.

Edge cases: null or empty html gives an empty text; a null url has no host, so only the markup rules apply; unclosed and
misnested tags are closed as browsers do; parsing takes time linear in a page's length, nesting included; repeated rows
each get a row (and count once); an empty table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as htmllib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, scan
from .wordvec import mix64

#: Pages of a host, at least, and share of its pages on which a recurring content stands; the share where much text is.
LEAST, SHARE, MAIN_SHARE = 8, 0.1, 0.6
#: Share of a host's text that a slot holds at most to be a template's; share of its contents that other pages hold too.
MASS, POOL = 0.3, 0.1
#: Templates (hashes of 8 bytes) that are broadcast at most.
BROADCAST = 1_000_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Starting one of these closes an open element of those named.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: An end tag doesn't reach beyond these.
_SCOPE = frozenset("html body article main section div nav header footer aside form table td th ul ol dl blockquote figure details".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROP = frozenset("head nav footer aside form button select menu dialog noscript object audio video canvas search".split())
_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar aside widget widgets related recommended recommendations teaser share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer comment comments commentlist disqus reply replies respond login search toolbar skip copyright byline tags hidden".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())


def _marks(attributes: str) -> tuple[frozenset[str], bool, bool]:
    """(words of class and id, dropped by role or visibility, whether role is main)."""
    words: set[str] = set()
    dropped = main = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words.update(x.lower() for x in _CAMEL.findall(value))
        elif name == "role":
            dropped |= value.lower() in _ROLES
            main |= value.lower() == "main"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            dropped = True
    return frozenset(words), dropped, main


class _Element:
    __slots__ = ("tag", "up", "drop", "head", "parts", "size", "hash", "slot", "article", "main", "gone")

    def __init__(self, tag: str, up: _Element | None):
        self.tag, self.up = tag, up
        self.drop = up.drop if up else False
        self.head = up.head if up else False  # inside a header of the article: only headings stay
        self.article = tag == "article" or bool(up and up.article)
        self.main = bool(up and up.main)
        self.gone = False
        self.parts: list[str] = []
        self.size = self.hash = self.slot = 0


def parse(page: str) -> tuple[list[tuple[str, _Element, bool]], list[_Element]]:
    """(blocks as (text, element, mostly links), block-level elements, outer ones first) of a page, in page order."""
    root = _Element("", None)
    stack: list[tuple[str, _Element | None]] = [("", root)]  # inline elements have no element of their own
    at = root
    blocks: list[tuple[str, _Element, bool]] = []
    elements: list[_Element] = []
    text: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join(htmllib.unescape("".join(text)).split())
            if said:
                blocks.append((said, at, 2 * linked > len(said)))
                at.parts.append(_DIGITS.sub("0", said))
                at.size += len(said)
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal at, links
        tag, element = stack.pop()
        if element is None:
            links -= tag == "a"
            return
        flush()
        element.hash = xxhash.xxh64_intdigest("\x01".join([element.tag, *element.parts]), 7)
        element.parts.clear()
        at = element.up
        at.parts.append(f"{element.hash:x}")
        at.size += element.size

    def close_open(names: tuple[str, ...] | frozenset, scope: frozenset = _SCOPE) -> None:
        """Close the innermost open element of these names, unless a boundary that isn't one of them stands before it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in scope:
                return

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            piece = m[0]
            if piece[:2] in ("<!", "<?"):
                continue
            text.append(piece)
            if links:
                linked += len(piece)
            continue
        name = name.lower()
        if m[1] or m[4]:  # end tag
            if name == "br":
                text.append(" ")
            elif name in _BLOCK:
                close_open((name,), frozenset() if name in ("body", "html", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "table", "ul", "ol") else _SCOPE)
                if name == "p":
                    flush()
            elif name not in _VOID:
                close_open((name,), _BLOCK)
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}[\s>/]", re.I).search(page, pos)
            pos = n if end is None else (page.find(">", end.start()) + 1 or n)
            continue
        attributes = m[3] if m[2] else m[6]
        if name in _VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr"):
                text.append(" " if name == "br" else "")
            continue
        if attributes.endswith("/") and name not in _BLOCK and name not in ("a", "b", "i", "em", "strong", "span", "u", "code"):
            continue
        if name not in _BLOCK and name not in _DROP:
            words, hidden, _ = _marks(attributes) if attributes else (frozenset(), False, False)
            if not hidden and not words & _NAMED:
                links += name == "a"
                stack.append((name, None))
                continue
        if name in _BLOCK and name not in ("li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot", "html", "body", "head", "legend", "caption", "summary"):
            close_open(("p",))
        if name in _HEADING:
            close_open(_HEADING)
        if name in _CLOSES:
            for other in _CLOSES[name]:
                close_open((other,), frozenset(("ul", "ol", "dl", "table", "select", "menu", "div", "article", "section")))
        flush()
        at = _Element(name, at)
        words, hidden, main = _marks(attributes) if attributes else (frozenset(), False, False)
        elements.append(at)
        at.main |= name == "main" or main
        if name not in ("html", "body"):
            slot = xxhash.xxh64_intdigest(f"{at.up.slot:x}/{name}.{' '.join(sorted(w for w in words if len(w) < 3 or not w.isdigit()))}", 11)
            at.slot = slot & ~1 | (name in _HEADING)
        if name not in ("html", "body", "article", "main"):
            at.drop |= name in _DROP or hidden or bool(words & _NAMED)
            if name == "header" or "header" in words:
                if at.up.article or at.up.main:
                    at.head = True
                else:
                    at.drop = True
        elif name == "article" and words & {"comment", "comments", "reply", "ad", "advert", "teaser", "related"}:
            at.drop = True
        stack.append((name, at))
    while len(stack) > 1:
        pop()
    flush()
    return blocks, elements


def remaining(blocks: list[tuple[str, _Element, bool]], elements: list[_Element], template: np.ndarray) -> tuple[list[str], int, int, int]:
    """(kept texts, blocks deleted by templates, by markup, by standing outside the marked article).

    template: per element whether its slot or content recurs on its host.
    """
    for e, t in zip(elements, template.tolist(), strict=True):
        e.gone = t or (e.up is not None and e.up.gone)
    own = [x for x in blocks if not x[1].gone]
    kept = [(t, e, k) for t, e, k in own if not e.drop and (not e.head or e.tag in _HEADING)]
    n_markup = len(own) - len(kept)
    inside = [x for x in kept if x[1].article] or [x for x in kept if x[1].main]
    if not inside:
        inside = [(t, e, k) for t, e, k in kept if not (k and e.tag not in _HEADING)]
    return [t for t, _, _ in inside], len(blocks) - len(own), n_markup, len(kept) - len(inside)


def candidates(page: str) -> list[str]:
    """The texts of a page's blocks that the markup rules alone keep."""
    blocks, elements = parse(page)
    return remaining(blocks, elements, np.zeros(len(elements), dtype=bool))[0]


def _keys(host: np.ndarray, slot: np.ndarray, content: np.ndarray) -> np.ndarray:
    """One 64-bit name of (host, slot, content); content 0 names the slot itself, slot 0 the host."""
    with np.errstate(over="ignore"):
        return mix64(host * np.uint64(0x9E3779B97F4A7C15) + mix64(slot * np.uint64(0xC2B2AE3D27D4EB4F) + content))


def sketch(text: str, width: int = 3) -> int:
    """Least hash of the text's shingles of ``width`` words: equal for copies, mostly equal for near copies."""
    words = text.split()
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + width]), 5) for i in range(max(1, len(words) - width + 1)))


def _rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.when(host != "", host).alias("host"), "html")


def _host_hash(host: str) -> int:
    return xxhash.xxh64_intdigest(host, 3)


def subtrees(pages: DataFrame) -> DataFrame:
    """(key, host, slot, content, main, size, many) of every page with a host: itself, its slots, its slots' contents.

    main tells copies of a page apart from other pages; size: text of a page or slot; many: contents of a slot.
    """

    def make():
        def each(b: pa.RecordBatch):
            out: list[tuple[int, int, int, int, int, int]] = []
            for host, page in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not host or not page:
                    continue
                blocks, elements = parse(page)
                if not blocks:
                    continue
                h, main = _host_hash(host), sketch(max((t for t, _, _ in blocks), key=len))
                out.append((h, 0, 0, main, sum(len(t) for t, _, _ in blocks), 0))
                slots: dict[int, list] = {}
                for e in elements:
                    if e.size and e.slot:
                        at = slots.setdefault(e.slot, [0, set()])
                        at[0] += e.size
                        at[1].add(e.hash | 1)
                for slot, (size, contents) in slots.items():
                    out.append((h, slot, 0, main, size, len(contents)))
                    out.extend((h, slot, c, main, 0, 0) for c in contents)
            if not out:
                return None
            host, slot, content, main, size, many = (np.array(x, dtype=np.uint64) for x in zip(*out, strict=True))
            return [x.view(np.int64) for x in (_keys(host, slot, content), host, slot, content, main, size, many)]

        return each, None

    return scan(_rows(pages), "html", "key long, host long, slot long, content long, main long, size long, many long", make)


def subtree_counts(pages: DataFrame) -> DataFrame:
    """(key, host, slot, content, n, size, many) over the pages that aren't copies, without contents that stand once."""
    once = subtrees(pages).groupBy("key", "host", "slot", "content", "main").agg(F.max("size").alias("size"), F.max("many").alias("many"))
    counts = once.groupBy("key", "host", "slot", "content").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("many").alias("many"))
    return counts.where("n > 1 or content = 0")


def templates(pages: DataFrame, least: int = LEAST, share: float = SHARE, main_share: float = MAIN_SHARE, mass: float = MASS, pool: float = POOL) -> DataFrame:
    """(host, key): recurring contents and slots of hosts. A host has a bounded number, as each stands on a share of its pages."""
    counts = materialize(subtree_counts(pages), "subtrees")
    hosts = counts.where("slot = 0").select("host", F.col("n").alias("pages"), F.col("size").alias("total"))
    again = counts.where("content <> 0").groupBy("host", "slot").agg(F.sum("n").alias("again"))
    slots = counts.where("slot <> 0 and content = 0").join(hosts.where(F.col("pages") >= least), "host").withColumn("small", (F.col("size") <= F.lit(mass) * F.col("total")) & (F.col("slot") % 2 == 0))
    rotating = slots.where(F.col("small") & (2 * F.col("n") >= F.col("pages"))).join(again, ["host", "slot"]).where((F.col("again") >= 3) & (F.col("again") >= F.lit(pool) * F.col("many")))
    contents = counts.where((F.col("content") != 0) & (F.col("n") >= least)).select("key", "host", "slot", "n").join(slots.select("host", "slot", "pages", "small"), ["host", "slot"])
    contents = contents.where(F.col("n") >= F.when(F.col("small"), F.lit(share)).otherwise(F.lit(main_share)) * F.col("pages"))
    return rotating.select("host", "key").unionByName(contents.select("host", "key"))


SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_template_blocks int, n_markup_blocks int, n_outside_blocks int"


def main_text(pages: DataFrame, broadcast: int = BROADCAST, **thresholds) -> DataFrame:
    """Columns of SCHEMA for every row.

    Pages are parsed once for the counts and once for the text, so no text is stored or shuffled: the templates come to
    the pages in a broadcast while there are at most ``broadcast`` of them, else by a join on the host.
    """
    spark = pages.sparkSession
    known = materialize(templates(pages, **thresholds), "templates")
    rows = _rows(pages)
    if known.count() <= broadcast:
        everywhere = spark.sparkContext.broadcast(np.sort(known.select("key").toArrow()["key"].to_numpy()))
    else:
        everywhere = None
        named = rows.select("host").distinct().where("host is not null").select("host", _hash_hosts("host").alias("of"))
        of_host = named.join(known.groupBy(F.col("host").alias("of")).agg(F.sort_array(F.collect_list("key")).alias("keys")), "of").select("host", "keys")
        rows = rows.join(of_host, "host", "left").select("page_id", "url", "host", "html", "keys")

    def make():
        def each(b: pa.RecordBatch):
            none = np.zeros(0, dtype=np.int64)
            shared = everywhere.value if everywhere is not None else None
            lists = b.column(4).to_pylist() if shared is None else None
            out = []
            for i, (host, page) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                blocks, elements = parse(page) if page else ([], [])
                template = np.zeros(len(elements), dtype=bool)
                keys = none if not host else shared if shared is not None else np.array(lists[i] or [], dtype=np.int64)
                at = np.flatnonzero([e.size > 0 and e.slot != 0 for e in elements]) if len(keys) else none
                if len(at):
                    slot, content = (np.array(x, dtype=np.uint64) for x in zip(*((elements[j].slot, elements[j].hash | 1) for j in at), strict=True))
                    h = np.full(len(at), _host_hash(host), dtype=np.uint64)
                    for asked in (_keys(h, slot, np.zeros_like(slot)), _keys(h, slot, content)):
                        asked = asked.view(np.int64)
                        template[at] |= keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
                kept, *gone = remaining(blocks, elements, template)
                text = "\n\n".join(kept)
                out.append((text, len(text), len(kept), *gone))
            columns = list(zip(*out, strict=True))
            return [b.column(0), b.column(1), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])]

        return each, None

    return scan(rows, "html", SCHEMA, make)


def _hash_hosts(host: str):
    @F.pandas_udf("long")
    def hashed(names: pd.Series) -> pd.Series:
        return pd.Series(np.array([_host_hash(x) for x in names], dtype=np.uint64).view(np.int64))

    return hashed(host)


__all__ = ["main_text", "templates", "subtree_counts", "subtrees", "candidates", "parse", "remaining"]
