"""Main-text extraction from HTML with a host-wide search for repeated boilerplate.

A page is cut into blocks, each in one of three zones: *main* (inside an article or main element), *chrome* (marked as menu,
header, footer, sidebar, notice, advert, form or comments by its element, role, class or id), and *other*. The visible
text outside main is the page's token stream. Over each host, the heads of all suffixes of the distinct streams are
grouped: a head of HEAD tokens that starts in streams of distinct contents repeats, and chained heads are the long repeated
substrings. A page without text in a main element keeps those other blocks of which some token isn't covered, or all of them
if none is left.

The content of a page is its main text, or without one its unmarked blocks. Copies are one content, and so are near copies
(as in neardup) among pages without main text: what only they share is what they say, not boilerplate.

Repeats never remove text inside main: articles quote each other, and such passages belong to the main text.
"""

from __future__ import annotations

import html as charrefs
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise, small_batches, text_batches
from weftline.llm.neardup import near_duplicates

#: Tokens of a suffix's head: shorter repeats are left alone.
HEAD = 6

# Elements by what they do.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
HIDDEN = {"head", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "datalist"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset", "label"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "mark", "meta", "link", "nobr", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY_SIBLING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "toolbar", "form"}
CHROME_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adslot", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "billboard",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "toolbar", "topbar",
    "footer", "masthead", "sidebar", "aside", "rail", "widget", "widgets", "related", "recommended", "trending", "teaser",
    "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "comment", "comments", "commentlist", "disqus", "respond", "replies", "share", "sharing", "social", "copyright", "legal", "disclaimer", "form", "search",
}
COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}

_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z]", re.S)
_NAME = re.compile(r"[^\s/>]+")
_QUOTED = re.compile(r"""(?:[^>"']++|(?<==)\s*+"[^"]*+"|(?<==)\s*+'[^']*+'|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'])*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
MAIN, OTHER, SKIP = 2, 1, 0


def _chrome(name: str, attributes: str) -> int:
    """0: content, 1: chrome, 2: reader comments."""
    out = 1 if name in CHROME else 0
    if "=" not in attributes:
        return out
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if key.lower() == "role":
            out = max(out, value.lower() in CHROME_ROLES)
        elif key.lower() == "aria-hidden":
            out = max(out, value.lower() == "true")
        elif key.lower() in ("class", "id"):
            for word in value.split():
                parts = set(_PART.findall(_CAMEL.sub("-", word).lower()))
                if parts & COMMENT_NAMES:
                    return 2
                if parts & CHROME_NAMES or "header" in parts and name in ("header", "div", "section") and len(parts) < 3 and not parts & {"article", "post", "entry", "content"}:
                    out = max(out, 1)
    return out


def blocks(page: str) -> tuple[list[tuple[int, bool, str]], bool]:
    """(zone, chrome, text) of each block with text, in order, and whether the page has a main element.

    Zone is MAIN or OTHER; chrome says that the block is marked as boilerplate. Markup that isn't closed ends with the page.
    """
    out: list[tuple[int, bool, str]] = []
    held: list[str] = []
    # name, chrome mark, main
    stack: list[tuple[str, int, bool]] = []
    has_main = False

    def flush() -> None:
        if held:
            text = " ".join(charrefs.unescape("".join(held)).split())
            held.clear()
            if text:
                # Comments and chrome inside an article aren't of it; an article inside chrome is chrome unless that holds all of it.
                out.append((MAIN if any(s[2] for s in stack) else OTHER, any(s[1] for s in stack), text))

    at, n = 0, len(page)
    while at < n:
        found = _MARKUP.search(page, at)
        if not found:
            held.append(page[at:])
            break
        if found.start() > at:
            held.append(page[at : found.start()])
        at = found.end()
        token = found[0]
        if token[1] in "!?":
            continue
        closing = token[1] == "/"
        named = _NAME.match(page, at - 1)
        name = named[0].lower()
        at = named.end()
        end = _QUOTED.match(page, at)
        if not end:
            break  # a tag that never ends
        attributes = page[at : end.end() - 1]
        at = end.end()
        if name in RAW and not closing and not attributes.endswith("/"):
            shut = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if name not in ("textarea", "xmp") or not shut:
                flush()
            at = n if not shut else page.find(">", shut.start()) + 1 or n
            continue
        if name in INLINE:
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        main = name in ("article", "main") or "role" in attributes and re.search(r"""role\s*=\s*["']?main\b""", attributes, re.I) is not None
        mark = _chrome(name, attributes)
        if name in HIDDEN:
            mark = max(mark, 1)
        if name == "body":
            stack = [s for s in stack if s[0] != "head"]
            mark = 0
        if main and not mark:
            # Elements of chrome that an article can't stand in were never closed.
            while stack and stack[-1][1] and stack[-1][0] in (CHROME | {"head", "header", "ul", "li", "p"}):
                stack.pop()
            has_main = has_main or not any(s[1] for s in stack)
        if name == "header" and not any(s[2] for s in stack):
            mark = max(mark, 1)
        if name in CLOSED_BY_SIBLING:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] not in CLOSED_BY_SIBLING:
                    break
        if not attributes.endswith("/") or name not in ("svg", "math"):
            stack.append((name, mark, main and mark == 0))
    flush()
    return out, has_main


_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host_of(url: str | None) -> str:
    """The host in lower case; empty where there is none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _parsed(batches):
    for batch in text_batches(batches, "html"):
        rows = []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found, has_main = blocks(page or "")
            # An article without text of its own is none.
            main = " ".join(t for zone, chrome, t in found if zone == MAIN and not chrome) or None if has_main else None
            # "1" before a block that may be main text, "0" before one marked as chrome.
            side = [f"{int(not chrome)}{t}" for zone, chrome, t in found if zone == OTHER or chrome]
            stream = "\n".join([host_of(url), *side])
            content = "\n".join([host_of(url), *([b for b in side if b[0] == "1"] if main is None else ["", main])])
            rows.append((main, stream, *[xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in (stream, content)]))
        main, stream, number, content = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(main, pa.string()), pa.array(stream, pa.string()), pa.array(number, pa.int64()), pa.array(content, pa.int64())], names=["page_id", "url", "main", "stream", "number", "content"])


def _unmarked(batches):
    for batch in text_batches(batches, "stream"):
        texts = [" ".join(b[1:] for b in stream.split("\n")[1:] if b[0] == "1") for stream in batch.column("stream").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(texts, pa.string())], names=["content", "text"])


def _tokens(stream: str) -> tuple[str, list[str], list[int], list[str]]:
    """Host, all tokens, each block's first token with the end, and the blocks."""
    host, *side = stream.split("\n")
    tokens: list[str] = []
    starts = []
    for b in side:
        starts.append(len(tokens))
        tokens += b[1:].split()
    return host, tokens, [*starts, len(tokens)], side


def _heads(batches):
    for batch in text_batches(batches, "stream"):
        heads, numbers, places, least, most = [], [], [], [], []
        for number, stream, lo, hi in zip(*[batch.column(c).to_pylist() for c in ("number", "stream", "lo", "hi")], strict=True):
            host, tokens, _, _ = _tokens(stream)
            for i in range(len(tokens) - HEAD + 1):
                heads.append(xxhash.xxh3_64_intdigest("\0".join([host, *tokens[i : i + HEAD]])) - (1 << 63))
                numbers.append(number)
                places.append(i)
                least.append(lo)
                most.append(hi)
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(numbers, pa.int64()), pa.array(places, pa.int32()), pa.array(least, pa.int64()), pa.array(most, pa.int64())], names=["head", "number", "place", "lo", "hi"])


def _main_text(batches):
    for batch in text_batches(batches, "stream"):
        texts = []
        for stream, places in zip(*[batch.column(c).to_pylist() for c in ("stream", "places")], strict=True):
            _, tokens, starts, side = _tokens(stream)
            covered = [False] * len(tokens)
            for p in places or ():
                covered[p : p + HEAD] = [True] * HEAD
            own = [b[1:] for b, lo, hi in zip(side, starts[:-1], starts[1:], strict=True) if b[0] == "1" and not all(covered[lo:hi])]
            texts.append(" ".join(own or [b[1:] for b in side if b[0] == "1"]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of pages (page_id, url, html): page_id, url, text and n_chars (code points).

    Null and empty html give an empty text. A null url belongs to a host without name. Pages of equal page_id are pages each;
    repeated rows and copies each give the text. A page that has unmarked blocks never loses all of them to repeats. An empty
    table gives no rows. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    parsed = materialise(pages.mapInArrow(_parsed, "page_id long, url string, main string, stream string, number long, content long"), "parsed")
    witnesses = parsed.select("number", "content", F.col("content").alias("group")).distinct()
    unmarked = parsed.filter("main IS NULL").groupBy("content").agg(F.first("stream").alias("stream")).mapInArrow(_unmarked, "content long, text string")
    unmarked = materialise(unmarked.filter("text <> ''"), "unmarked")
    if not unmarked.isEmpty():
        near = near_duplicates(unmarked, "content").select(F.col("doc_id").alias("content"), "component_id")
        witnesses = witnesses.join(near, "content", "left").select("number", F.coalesce("component_id", "content").alias("group"))
    witnesses = witnesses.groupBy("number").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
    streams = parsed.groupBy("number").agg(F.first("stream").alias("stream")).join(witnesses, "number")
    heads = materialise(streams.mapInArrow(_heads, "head long, number long, place int, lo long, hi long"), "heads")
    repeated = heads.groupBy("head").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("head")
    places = heads.join(repeated, "head").groupBy("number").agg(F.collect_list("place").alias("places"))
    # Only pages without main text wait for the repeats: the others' text isn't shuffled.
    loose = parsed.filter("main IS NULL").join(places, "number", "left").select("page_id", "url", "stream", "places").mapInArrow(_main_text, "page_id long, url string, text string")
    out = parsed.filter("main IS NOT NULL").select("page_id", "url", F.col("main").alias("text")).unionByName(loose)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_host_suffix_array(spark, sf_dir: str) -> DataFrame:
    """Query: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
