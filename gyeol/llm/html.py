"""Main text of web pages, with site templates removed.

A page is read into a light tree. Elements that are not content by their tag, role or class (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, comments of readers) are dropped. Every other block subtree is hashed; Spark counts the hashes per host, and subtrees
that recur on at least half of a host's pages, and on TEMPLATE_PAGES of them, are templates: they are deleted too, inside the page's article as
elsewhere; only the article, main element and body themselves are never deleted as templates. Pages of one html count once there. What stays is the
root: the articles if they hold ROOT_SHARE of the text that is left, else the main elements with the articles if those do, else the whole body.

Defined cases: null or empty html gives an empty text; a null url counts as the host ''; unclosed elements end where HTML lets
them end; an article opens even inside an unclosed dropped element; repeated rows give repeated rows; other columns are left alone;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.common import durable, in_batches

TEMPLATE_PAGES, TEMPLATE_SHARE = 10, 0.5
#: Of a page's text, the part that its articles (or these and its main elements) hold where they are the root.
ROOT_SHARE = 0.5
#: Templates that may be sent to every executor; beyond it they are joined to their pages.
BROADCAST_TEMPLATES = 300_000

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe"}
DROP = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map", "math", *RAW}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that an opening block ends where they are open inside the nearest container.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"article", "main", "body", "html", "div", "section", "ul", "ol", "dl", "table", "blockquote", "td", "th", "aside", "nav", "header", "footer", "form", "figure"}
#: Closing tags of these elements do not reach out of an article or main element.
WALLS, WALLED = {"article", "main"}, INLINE | {"p", "li", "div"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
BAD_WORDS = set(
    """ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs byline-share comment comments commentlist
    consent cookie cookies disqus footer footnav gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain
    overlay pager pagination paywall popup popups promo promoted promotion recommended related replies respond search share sharing sidebar sidebars signup skip
    skip-link social sponsor sponsored subscribe subscription taboola tagcloud toolbar topbar tracking widget widgets""".split()
)
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag; nothing of it is tried twice.
REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[a-z0-9]+")


def unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROP or (tag == "header" and not in_article):
        return True
    if attrs and tag not in ("html", "body", "article", "main"):
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
                return True
            if name in ("class", "id") and any(w in BAD_WORDS for x in value.split() for w in (x, *PART.findall(x))):
                return True
    return name_is_comment(attrs) if tag == "article" else False


def name_is_comment(attrs: str) -> bool:
    return any(w in ("comment", "comments", "reply") for m in ATTR.finditer(attrs or "") for w in PART.findall((m[2] or m[3] or m[4] or "").lower()))


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag; text between them and comments are left out, the latter as tags without a name. Every character is looked at
    a bounded number of times: where a quotation mark has no other, tags end at the next > from then on."""
    at, n, strict = 0, len(html), True
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, False, "", ""
            at = end
            continue
        m = OPENING.match(html, at)
        if m is None and not html.startswith(("<!", "<?"), at):
            at += 1
            continue
        rest = REST.match(html, m.end()) if m and strict else None
        if rest is None:
            strict = strict and m is None
            end = html.find(">", m.end() if m else at + 2) + 1
            if not end:
                return
        else:
            end = rest.end()
        if m is None:
            yield at, end, False, "", ""
        else:
            name = m[2].lower()
            yield at, end, bool(m[1]), name, html[m.end() : end - 1]
            if name in RAW and not m[1] and html[end - 2] != "/":
                close = RAW_END[name].search(html, end)
                over = html.find(">", close.end()) + 1 if close else 0
                end = over or n
                yield end, end, True, name, ""
        at = end


def parse(html: str, hashed: bool = True) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int]]]:
    """(pieces, blocks). A piece is (place, rank, kind, text) outside dropped elements: rank 2 inside an article, 1 inside main, else 0; kind 1 begins a
    block. A block is (start, end, hash) of a subtree that isn't dropped; its hash is made of its tag, its texts and its children's hashes."""
    pieces: list[tuple[int, int, int, str]] = []
    blocks: list[tuple[int, int, int]] = []
    stack: list[list] = []  # tag, start, dropped from here on, rank, hash so far
    dropped, rank = False, 0
    # how many elements of a tag are open: in all, since the innermost article or main, and since the innermost element of SCOPE
    total, walls, scopes = Counter(), [Counter()], [Counter()]

    def push(tag: str, start: int, end: int) -> None:
        stack.append([tag, start, dropped, rank, xxhash.xxh64(" ".join(html[start:end].split())) if hashed else None])
        total[tag] += 1
        walls[-1][tag] += 1
        scopes[-1][tag] += 1
        if tag in WALLS:
            walls.append(Counter())
        if tag in SCOPE:
            scopes.append(Counter())

    def close(k: int, end: int) -> None:
        nonlocal dropped, rank
        while len(stack) > k:
            tag, start, was_dropped, was_rank, h = stack.pop()
            if tag in WALLS:
                walls.pop()
            if tag in SCOPE:
                scopes.pop()
            total[tag] -= 1
            walls[-1][tag] -= 1
            scopes[-1][tag] -= 1
            if hashed:
                if not dropped and tag not in INLINE and tag not in ("html", "body", "article", "main"):
                    key = h.intdigest()
                    blocks.append((start, end, key - (1 << 64) if key >> 63 else key))
                if stack:
                    stack[-1][4].update(b"\0" + h.digest())
            dropped, rank = was_dropped, was_rank

    def text(a: int, b: int) -> None:
        if b <= a:
            return
        if not dropped:
            pieces.append((a, rank, 0, html[a:b]))
        if hashed and stack:
            stack[-1][4].update("\1" + " ".join(html[a:b].split()))

    at, raw = 0, None
    for start, end, closing, tag, attrs in tags(html):
        if raw is not None:  # what lies between a raw element's tags is no text
            if hashed and stack:
                stack[-1][4].update(" ".join(html[raw:end].split()))
            raw, at = None, end
            continue
        text(at, start)
        at = end
        if not tag:
            continue
        if closing:
            if total[tag] and (tag not in WALLED or walls[-1][tag]):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), end)
            if tag not in INLINE:
                pieces.append((start, rank, 1, ""))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append((start, rank, 1, ""))
            if hashed and stack:
                stack[-1][4].update(" ".join(html[start:end].split()))
            continue
        if tag not in INLINE:
            over = ENDS.get(tag, {"p"} if tag not in ("body", "html", "head") else set())
            if any(scopes[-1][t] or (tag == "tr" and total[t]) for t in over):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in over:
                        close(k, start)
                        break
                    if stack[k][0] in SCOPE and not (tag == "tr" and stack[k][0] in ("td", "th")):
                        break
            if tag in ("body", "article", "main") and total["head"]:
                close(next(i for i, x in enumerate(stack) if x[0] == "head"), start)
            pieces.append((start, rank, 1, ""))
        if attrs.endswith("/"):
            continue
        if tag in RAW:
            raw = start
            continue
        push(tag, start, end)
        if tag == "article" and not name_is_comment(attrs):
            dropped, rank = False, 2
        elif tag == "main" and rank < 2:
            dropped, rank = False, 1
        elif not dropped:
            dropped = unwanted(tag, attrs, rank == 2)
    if raw is None:
        text(at, len(html))
    close(0, len(html))
    return pieces, blocks


def page_key(html: str) -> int:
    """A page's hash, signed 64 bits."""
    h = xxhash.xxh64_intdigest(html)
    return h - (1 << 64) if h >> 63 else h


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def template_candidates(html: str | None) -> set[int]:
    return {h for _, _, h in parse(html)[1]} if html else set()


def extract(html: str | None, templates: set[int] | frozenset[int] = frozenset()) -> str:
    if not html:
        return ""
    pieces, blocks = parse(html, bool(templates))
    gone: list[tuple[int, int]] = []  # apart from one another, in order
    for a, b in sorted(((a, b) for a, b, h in blocks if h in templates), key=lambda x: (x[0], -x[1])):
        if not gone or a >= gone[-1][1]:
            gone.append((a, b))
    starts = [a for a, _ in gone]
    left = [x for x in pieces if x[2] or not ((k := bisect_right(starts, x[0])) and x[0] < gone[k - 1][1])]
    size = [0, 0, 0]
    for _, r, kind, t in left:
        if not kind:
            size[r] += len("".join(t.split()))
    root = next((r for r in (2, 1) if sum(size[r:]) and sum(size[r:]) >= ROOT_SHARE * sum(size)), 0)
    out = [" " if kind else t for _, r, kind, t in left if kind or r >= root]
    return " ".join(unescape("".join(out)).split())


def template_table(pages: DataFrame) -> DataFrame:
    """host, h: the subtrees that recur on many different pages of their host."""

    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(host_of(url), h, page) for url, html, page in zip(b["url"].to_pylist(), b["html"].to_pylist(), b["page"].to_pylist(), strict=True) for h in (None, *template_candidates(html))}
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["host", "h", "page"])

    c = in_batches(pages.select("url", "html", F.xxhash64("html").alias("page"))).mapInArrow(list_all, "host string, h long, page long")
    c = c.distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    c = c.where(F.col("n") >= TEMPLATE_PAGES)
    total = c.where("h IS NULL").select("host", F.col("n").alias("pages"))
    return c.where("h IS NOT NULL").join(total, "host").where(F.col("n") >= TEMPLATE_SHARE * F.col("pages")).select("host", "h")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    templates = durable(template_table(pages))
    few = templates.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES
    if few:
        by: dict[str, set[int]] = {}
        for r in templates.collect():
            by.setdefault(r.host, set()).add(r.h)
        shared = pages.sparkSession.sparkContext.broadcast(by)
        src = pages.select("page_id", "url", "html", F.lit(None).cast("array<long>").alias("own"))
    else:
        shared = None
        of = lambda b: pa.array([sorted(template_candidates(h)) for h in b["html"].to_pylist()], pa.list_(pa.int64()))

        def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b["url"], pa.array([host_of(u) for u in b["url"].to_pylist()], pa.string()), of(b), pa.array([page_key(h or "") for h in b["html"].to_pylist()], pa.int64())], ["url", "host", "hs", "page"])

        rows = in_batches(pages.select("url", "html")).mapInArrow(list_all, "url string, host string, hs array<long>, page long").select("url", "host", "page", F.explode("hs").alias("h"))
        own = rows.join(templates, ["host", "h"]).groupBy("url", "page").agg(F.collect_set("h").alias("own"))
        keyed = pages.withColumn("__u", F.coalesce("url", F.lit(""))).select("page_id", "url", "html", "__u")
        own = own.groupBy(F.coalesce("url", F.lit("")).alias("__u")).agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
        src = keyed.join(own, "__u", "left").select("page_id", "url", "html", "own")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for url, html, own in zip(b["url"].to_pylist(), b["html"].to_pylist(), b["own"].to_pylist(), strict=True):
                texts.append(extract(html, shared.value.get(host_of(url), frozenset()) if shared is not None else frozenset(own or ())))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return in_batches(src).mapInArrow(read, "page_id long, url string, text string, n_chars long")
