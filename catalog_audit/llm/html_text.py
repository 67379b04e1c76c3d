"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from a few templates. A page is read as tokens: each tag with its path of open elements, and each
text outside the article as a whole. Two tokens are equivalent on a host when their occurrence vectors, how often each page
holds them, are equal; the vector is kept as a combinable 64-bit digest, so a host with a third of all pages is
one map-side aggregate like any other. Classes that occur on at least ``SUPPORT`` of the host's pages are valid,
their tokens in order of mean place. They nest: a class lies in a slot of the class that holds its first token's parent
element, which is at least as frequent. The valid classes are the host's template, everything between their tokens is slots.

Extraction joins each page with its host's template. Text that is itself a template token is page furniture. A slot is
furniture when an element around it says so by tag or by a word of its class, id or role, or, outside an article, when
its text on the host's pages is mostly links. If the template has an ``article`` or ``main``, only slots inside it
count. A page whose host shows too few pages for classes is judged by its own elements alone.

Blocks: a block element starts a new block; ``br`` and white space become one space; character references are decoded;
blocks join by a newline in page order.

Edge cases: null html is empty and gives an empty text; malformed markup never fails (an unclosed element ends with its
parent, a stray ``<`` is text); only an unclosed script or style reaches to the page's end, and an unclosed element of hidden text
ends before a block, too; null or hostless urls share one host, the empty one; equal pages of a host count once,
and only a host with ``MIN_PAGES`` unlike pages has texts and link slots that are furniture; other columns ride in ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_audit.llm.url_filter import host_of
from catalog_audit.session import materialize

SUPPORT = 0.5
MIN_PAGES = 4
LINK_SHARE = 0.6
#: Elements without content, elements whose content is no text (read to their end tag without
#: looking at markup; with svg and select, hidden), and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
HIDDEN = RAW | {"svg", "select"}
#: Hidden elements that cannot hold a block: one that begins inside ends them.
BROKEN = frozenset("iframe textarea title svg select".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
FURNITURE = frozenset("head nav aside footer form button menu dialog label fieldset script style noscript template iframe select".split())
#: Words of class, id or role that mark page furniture.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended sidebar
comment comments commentlist disqus reply replies respond discussion menu nav navbar navigation breadcrumb breadcrumbs footer pagination
pager toolbar widget masthead skip search tracking""".split())
_HEADERS = frozenset({"header", "masthead", "banner"})
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class Element:
    __slots__ = ("name", "path", "hidden", "furniture", "inside", "link", "token", "parent")

    def __init__(self, name: str, words: tuple[str, ...], parent: "Element | None"):
        self.name = name
        self.hidden = bool(parent and parent.hidden) or name in HIDDEN
        self.path = "" if self.hidden else f"{parent.path if parent else ''}/{name}" + ("." + ".".join(words) if words else "")
        self.token = 0 if self.hidden else _digest(self.path)
        self.parent = parent.token if parent else 0
        self.inside = bool(parent and parent.inside) or name in ("article", "main") or "main" in words and name != "body"
        self.link = bool(parent and parent.link) or name == "a"
        marked = name in FURNITURE or any(w in MARKS for w in words) and name not in ("html", "body", "article", "main")
        heading = (name == "header" or any(w in _HEADERS for w in words)) and not (parent and parent.inside)
        self.furniture = bool(parent and parent.furniture) or marked or heading


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def read(source: str) -> Iterator[tuple[str, Element | None, str]]:
    """("open" | "close" | "break", element, "") and ("text", enclosing element, text) of a page, in order."""
    stack: list[Element] = []
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.match(source, at)
        hidden = bool(stack) and stack[-1].hidden
        if m is None:  # a '<' whose tag never ends
            if not hidden:
                yield "text", stack[-1] if stack else None, source[at]
            at += 1
            continue
        at = m.end()
        name, text = m[2], m[4]
        if text is not None:
            if not hidden:
                yield "text", stack[-1] if stack else None, text
        elif name is not None:
            name = name.lower()
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        yield from _closed(stack, k)
                        break
                else:
                    if name == "p" and not hidden:
                        yield "break", None, ""
                continue
            if name in VOID:
                if not hidden:
                    yield ("break" if name == "hr" else "space"), stack[-1] if stack else None, ""
                continue
            if hidden and name in BLOCKS:
                k = next(k for k, e in enumerate(stack) if e.hidden)
                if stack[k].name in BROKEN and not any(e.name == "foreignobject" for e in stack[k:]):
                    yield from _closed(stack, k)
            if name in BLOCKS:  # an open paragraph ends where a block begins; so do items and cells where their like begins
                ends = {"p"} | ({name} if name in ("li", "dd", "dt", "tr", "td", "th", "option") else set())
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name in ends:
                        yield from _closed(stack, k)
                        break
                    if stack[k].name in BLOCKS:
                        break
            words = tuple(w for a in _ATTRIBUTE.finditer(m[3]) for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower()))
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                if close or name in ("script", "style"):
                    at = close.end() if close else end
                    continue
            if not m[3].endswith("/") or name in BLOCKS:
                stack.append(Element(name, words, stack[-1] if stack else None))
                if not stack[-1].hidden:
                    yield "open", stack[-1], ""


def _closed(stack: list[Element], k: int) -> Iterator[tuple[str, Element, str]]:
    """Close the elements from ``stack[k]`` on."""
    for gone in reversed(stack[k:]):
        if not gone.hidden:
            yield "close", gone, ""
    del stack[k:]


def page_tokens(source: str) -> dict[int, list]:
    """token -> [times, first place, kind, text after it, linked text after it, parent]; kind 0 tag, 1 article or main, 2 text."""
    out: dict[int, list] = {}
    last = None
    for place, (what, element, text) in enumerate(read(source)):
        if what == "open":
            kind = int(element.name in ("article", "main"))
            last = out.setdefault(element.token, [0, place, kind, 0, 0, element.parent])
            last[0] += 1
        elif what == "text" and (text := " ".join(entities.unescape(text).split())):
            if last is not None:
                last[3] += len(text)
                last[4] += len(text) * bool(element and element.link)
            if element is None or not element.inside:
                out.setdefault(_text_token(element, text), [0, place, 2, 0, 0, element.token if element else 0])[0] += 1
    return out


def _text_token(element: Element | None, text: str) -> int:
    return _digest(f"{element.path if element else ''}\x00{text}")


def occurrences(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, page, token, times, place, kind, chars, linked, parent): one row per unlike page of a host and distinct token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "page", "token", "times", "place", "kind", "chars", "linked", "parent"]
        for batch in batches:
            hosts, keys, rows = [], [], []
            for host, page, source in zip(*[c.to_pylist() for c in batch.columns]):
                for token, row in page_tokens(source or "").items():
                    hosts.append(host)
                    keys.append(page)
                    rows.append((token, *row))
            block = np.array(rows, np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), *[pa.array(block[:, k]) for k in range(7)]], names)

    own = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).distinct().select("host", F.xxhash64("html").alias("page"), "html")
    return own.mapInArrow(run, "host string, page long, token long, times long, place long, kind long, chars long, linked long, parent long")


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, pages, classes, tags, furniture, has_main): the template of every host with enough pages; ``pages`` counts unlike ones.

    ``classes`` holds, per valid class, its digest, the digest of the class it is nested in (null at the top), its size and
    how often it occurs a page. ``tags`` and ``furniture`` hold the tokens of valid classes: tags, and texts or link slots that are page furniture.
    """
    alike = pages.groupBy(host_of(F.col(url)).alias("host"), F.xxhash64(html).alias("page")).agg(F.count(F.lit(1)).alias("copies"))
    per_host = alike.groupBy("host").agg(F.sum("copies").alias("host_rows"), F.count(F.lit(1)).alias("host_pages"))
    seen = occurrences(pages, url, html).groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("times").alias("times"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"),
        F.min("kind").alias("kind"), F.avg("place").alias("place"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("parent").alias("parent"))
    frequent = seen.join(per_host.where(F.col("host_rows") >= MIN_PAGES), "host").where(F.col("pages") >= SUPPORT * F.col("host_pages"))
    # a host keeps no more tokens than 1 / SUPPORT times those of its average page
    token = F.struct("place", "token", "kind", (F.col("linked") > LINK_SHARE * F.col("chars")).alias("links"))
    above = frequent.select(F.col("host").alias("h"), F.col("token").alias("up"), F.col("vector").alias("above"))
    placed = frequent.join(above, (F.col("host") == F.col("h")) & (F.col("parent") == F.col("up")), "left")
    classes = placed.groupBy("host", "host_pages", "pages", "times", "vector").agg(
        F.sort_array(F.collect_list(token)).alias("tokens"), F.min_by("above", "place").alias("above"))
    nested = F.struct(F.col("vector").alias("class"), F.when(F.col("above") != F.col("vector"), F.col("above")).alias("inside"),
                      F.size("tokens").alias("size"), (F.col("times") / F.col("pages")).alias("per_page"))
    # repeated furniture texts must be on nearly every page; tags need only the class's support
    several = F.col("host_pages") >= MIN_PAGES
    fixed = several & (F.col("pages") >= 0.9 * F.col("host_pages"))
    tags = F.transform(F.filter("tokens", lambda t: t["kind"] < 2), lambda t: t["token"])
    texts = F.when(fixed, F.transform(F.filter("tokens", lambda t: t["kind"] == 2), lambda t: t["token"])).otherwise(F.array().cast("array<bigint>"))
    links = F.transform(F.filter("tokens", lambda t: several & (t["kind"] == 0) & t["links"]), lambda t: t["token"])
    return classes.groupBy("host", F.col("host_pages").alias("pages")).agg(
        F.collect_list(nested).alias("classes"), F.flatten(F.collect_list(tags)).alias("tags"),
        F.flatten(F.collect_list(F.concat(texts, links))).alias("furniture"),
        F.max(F.exists("tokens", lambda t: t["kind"] == 1)).alias("has_main"))


def main_text(source: str, tags: set[int], furniture: set[int], has_main: bool) -> str:
    """The blocks of a page's content slots under its host's template."""
    blocks: list[str] = []
    parts: list[str] = []
    own_main = has_main or not tags
    found = list(read(source))
    only_main = own_main and any(what == "open" and e.name in ("article", "main") for what, e, _ in found)

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(text)

    for what, element, text in found:
        if what == "text":
            if element is not None and (element.furniture or only_main and not element.inside):
                continue
            if element is None and only_main:
                continue
            if not (element and element.inside):
                slot = element.token if element else 0
                plain = " ".join(entities.unescape(text).split())
                if slot in furniture or plain and _text_token(element, plain) in furniture:
                    continue
            parts.append(text)
        elif what == "space":
            parts.append(" ")
        elif what == "break" or element.name in BLOCKS:
            flush()
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(row, text) of every page."""
    known = materialize(templates(pages, url, html), "templates")
    own = pages.select(F.struct(*keep).alias("row"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))

    @F.arrow_udf("string")
    def slots(html: pa.Array, tags: pa.Array, furniture: pa.Array, has_main: pa.Array) -> pa.Array:
        out, last, sets = [], None, (set(), set())
        for source, t, f, m in zip(html.to_pylist(), tags.to_pylist(), furniture.to_pylist(), has_main.to_pylist()):
            if (t, f) != last:
                last, sets = (t, f), (set(t or ()), set(f or ()))
            out.append(main_text(source or "", *sets, bool(m)))
        return pa.array(out, pa.string())

    joined = own.join(known.select("host", "tags", "furniture", "has_main"), "host", "left")
    return joined.select("row", slots("html", "tags", "furniture", "has_main").alias("text"))
