"""Main-text extraction by consensus host paths (operator 9).

Each page's containers get a score from the text of the blocks in them, less
their links. From the best one the page climbs to the article or main around it, or
else to the container that holds nearly all text and every h1, and votes for the
generalised tag-class path of that; Spark counts the votes of each host, and every page is then read again
at its host's winning path. A page where that path has no text, or less than half of
what its own best container has (a teaser), uses that container. An article, or
main, of nothing but links is taken with them. Of several articles side by side
without a main around them, the one with most text is the article.

Dropped everywhere: navigation, headers outside the article, footers, asides,
forms, scripts, styles, hidden parts, and elements that a class, id or role names
as menu, sidebar, notice, advert or reader comments. A class or id names an element
so if all its words do or are neutral ("sidebar-left", but not "with-sidebar" or
"layout-sidebar-right"), and, but for comments, if the element holds less than half
of the page's text.

Defined results: null or empty html gives empty text; broken markup (open tags, a
page that stops in the middle) is read as far as it goes, in time linear in its
length, at any depth; a null url is a host of
its own; rows may repeat; an empty table gives no rows; input columns named text and n_chars
are replaced, all others kept.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, fresh

#: Up to so many hosts (each with a path's depth and hash) the winners are broadcast; beyond, they are joined with salt.
BROADCAST_HOSTS, SALTS = 20_000, 16
#: A container with this share of a page's text holds nearly all of it.
NEARLY_ALL = 0.95

RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "xmp"}
VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture"}
CONTAINERS = {"body", "div", "article", "section", "main", "td", "center", "blockquote", "html"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "object", "canvas", "menu", "dialog", "head", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
NOISE = COMMENTS | {"nav", "navbar", "navigation", "menu", "menus", "header", "masthead", "footer", "sidebar", "aside", "breadcrumb", "breadcrumbs", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "widget", "widgets", "copyright", "disclaimer"}
#: Words beside which a noise word still names the element.
NEUTRAL = {"site", "page", "main", "top", "bottom", "left", "right", "primary", "secondary", "global", "local", "sub", "box", "block", "list", "item", "items", "area", "bar", "inner", "outer", "wrap", "wrapper", "container", "section", "slot", "unit", "panel", "links", "link", "buttons", "button", "icons", "form", "user", "reader", "post", "posts", "text", "title", "body", "head", "row", "col", "group", "module", "js", "the", "new", "google", "small", "large", "fixed", "sticky", "mobile", "desktop"}
#: An element with this share of a page's text is not dropped for its class or id.
MOST = 0.5
#: An open element that a new one of the same group ends.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)/?>|</([a-zA-Z][^\s>]*)[^>]*>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*\Z|<[a-zA-Z][^>]*>|[^<]+|<", re.S)
#: What follows the last ">" of a page: no tag ends there, so none is looked for. (The groups are those of _TOKEN.)
_TAIL = re.compile(r"<!--.*\Z|<[!?].*\Z|</?[a-zA-Z][^<]*\Z|[^<]+|<|(?!)()()()", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")


def names_noise(token: str) -> set[str]:
    """The noise words of a class or id that consists of such and neutral words only."""
    words = {w.lower() for w in _NAME.findall(token)}
    return words & NOISE if words <= NOISE | NEUTRAL else set()


class Page:
    """Elements that hold blocks (parents before children), and the blocks of text in page order."""

    def __init__(self, html: str):
        # a path is its depth and a hash of the parent's path and the step
        self.parent, self.path, self.is_container, self.tag = [-1], ["000000"], [True], [""]
        self.dropped, self.named, self.in_article = [False], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, of which in links
        self.read(html)
        self.drop_named()

    def open(self, up: int, tag: str, attrs: str) -> int:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
        names = found.get("class", "")
        step = tag
        if first := names.split():
            step += "." + ".".join(sorted({re.sub(r"\d+", "#", x) for x in first}))
        self.parent.append(up)
        above = self.path[up]
        self.path.append(f"{int(above[:6]) + 1:06d}" + hashlib.blake2b(f"{above}>{step}".encode("utf-8", "replace"), digest_size=16).hexdigest())
        self.is_container.append(tag in CONTAINERS)
        self.tag.append(tag)
        self.in_article.append(self.in_article[up] or tag in ("article", "main"))
        drop, name = self.dropped[up] or tag in DROPPED or (tag == "header" and not self.in_article[up]), ""
        if not drop and found:
            drop = found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            if tag not in ("html", "body", "article", "main"):
                noise = set().union(*map(names_noise, (*first, found.get("id", ""))))
                name = "comments" if noise & COMMENTS else "noise" if noise else ""
        self.dropped.append(drop)
        self.named.append(name)
        return len(self.parent) - 1

    def sums(self, value) -> list[float]:
        """Of each element, value(text, links) of the blocks in it that are not dropped."""
        out = [0.0] * len(self.parent)
        for at, text, links in self.blocks:
            if not self.dropped[at]:
                out[at] += value(at, text, links)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def drop_named(self) -> None:
        """Drop the elements that a class or id names as noise, and all in them."""
        if any(self.named):
            held = self.sums(lambda at, text, links: max(0, len(text) - links))
            for i in range(1, len(self.parent)):
                noise = self.named[i] == "comments" or (self.named[i] and held[i] < MOST * held[0])
                self.dropped[i] = self.dropped[i] or self.dropped[self.parent[i]] or bool(noise)

    def read(self, html: str) -> None:
        # open elements that are not inline: tag, number, the inline ones opened in it, and how many of each tag
        stack: list[tuple[str, int, list[str], dict[str, int]]] = [("", 0, [], {})]
        opened: dict[str, int] = {}
        buf: list[str] = []
        in_link, link_chars, pos, n, ends = 0, 0, 0, len(html), html.rfind(">") + 1

        def flush() -> None:
            nonlocal link_chars
            if buf:
                text = _SPACE.sub(" ", "".join(buf)).strip()
                if text:
                    self.blocks.append((stack[-1][1], text, min(link_chars, len(text))))
                buf.clear()
            link_chars = 0

        def close() -> str:
            nonlocal in_link
            tag, _, _, counts = stack.pop()
            opened[tag] -= 1
            in_link -= counts.get("a", 0)
            return tag

        while pos < n:
            m = (_TOKEN if pos < ends else _TAIL).match(html, pos)
            pos = m.end()
            tag, end = m[1], m[3]
            if tag:
                tag = tag.lower()
                if tag in VOID:
                    if tag == "br":
                        buf.append(" ")
                    elif tag == "hr":
                        flush()
                    continue
                if tag in RAW:
                    close_tag = re.compile(rf"</{tag}[^>]*>", re.I).search(html, pos, ends)
                    pos = close_tag.end() if close_tag else n
                    continue
                if tag in INLINE:
                    in_link += tag == "a"
                    stack[-1][2].append(tag)
                    stack[-1][3][tag] = stack[-1][3].get(tag, 0) + 1
                    continue
                flush()
                shut = CLOSES.get(tag, {"p"})
                while stack[-1][0] in shut:
                    close()
                stack.append((tag, self.open(stack[-1][1], tag, m[2]), [], {}))
                opened[tag] = opened.get(tag, 0) + 1
            elif end:
                end = end.lower()
                if end in INLINE:
                    inline, counts = stack[-1][2:]
                    while counts.get(end):
                        last = inline.pop()
                        counts[last] -= 1
                        in_link -= last == "a"
                        if last == end:
                            break
                elif opened.get(end):
                    flush()
                    while close() != end:
                        pass
            elif (text := m[0])[0] != "<" or text == "<":
                if "&" in text:
                    text = unescape(text)
                buf.append(text)
                if in_link:
                    link_chars += len(text.strip())
        flush()

    def best(self, links_cost: int = 2) -> tuple[int, float]:
        """The container of the article, and the text of all blocks in it less their links (taken off links_cost times).

        From the container with the highest score (text of its blocks less their links, and half of the containers in it): the outermost article around it, else the outermost main, else the next container that holds nearly all the page's text, every h1, and not only containers unless it is the body.
        """
        whole = self.sums(lambda at, text, links: max(0, len(text) - links_cost * links))
        heads = self.sums(lambda at, text, links: self.tag[at] == "h1" and len(text) > links_cost * links)
        if not whole[0]:
            # an article may consist of links; a page of links without one has no text
            return self.best(0) if links_cost and any(t in ("article", "main") for t in self.tag) else (-1, 0.0)
        # of each element the container that it is or is in
        container = [0] * len(self.parent)
        for i in range(1, len(container)):
            container[i] = i if self.is_container[i] else container[self.parent[i]]
        score: dict[int, float] = {}
        own: set[int] = set()  # containers with blocks outside inner containers
        for at, text, links in self.blocks:
            if self.dropped[at] or (value := len(text) - links_cost * links) <= 0:
                continue
            at = container[at]
            if self.tag[at] not in ("", "html", "body"):
                own.add(at)
            score[at] = score.get(at, 0) + value
            if at:
                up = container[self.parent[at]]
                score[up] = score.get(up, 0) + value / 2
        at = max(score.items(), key=lambda x: (x[1], -x[0]))[0]
        around = [at]
        while around[-1] > 0:
            around.append(self.parent[around[-1]])
        for tag in ("article", "main"):
            if found := [i for i in around if self.tag[i] == tag]:
                return found[-1], whole[found[-1]]
        for k, i in enumerate(around):
            if self.is_container[i] and whole[i] >= NEARLY_ALL * whole[0] and heads[i] == heads[0]:
                # a lead directly in a container around belongs to the text in it
                i = next((j for j in reversed(around[k:]) if j in own), i)
                return i, whole[i]
        return 0, whole[0]

    def text(self, inside) -> str:
        """Blocks that inside(element) or an element around it holds for."""
        holds = [inside(0)]
        for i in range(1, len(self.parent)):
            holds.append(holds[self.parent[i]] or inside(i))
        return "\n".join(text for at, text, _ in self.blocks if holds[at] and not self.dropped[at])


def _extract(html: str, path: str | None) -> str:
    page = Page(html)
    at, _ = page.best()
    own = page.text(lambda i: i == at) if at >= 0 else ""
    if path is not None and (text := page.text(lambda i: page.path[i] == path)) and len(text) > MOST * len(own):
        return text
    return own


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path: the path of each host that most pages vote for, then that with most text, then the first."""
    bounded_batches(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            paths, scores = [], []
            for x in batch.column(1).to_pylist():
                page = Page(x or "")
                at, score = page.best()
                paths.append(page.path[at] if at >= 0 else None)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    each = pages.select(_host(url).alias("host"), html).mapInArrow(run, "host string, path string, score double").filter("path IS NOT NULL")
    counted = each.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", F.round("score", 3), -F.substring("path", 1, 6).cast("int"), "path")).alias("path"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages without html, with text and n_chars."""
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path, salt = fresh(pages, "host", "path", "salt")
    winners = cut(votes(pages, url, html).select(F.col("host").alias(host), F.col("path").alias(path)))
    kept = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    keyed = pages.select(*[F.col(f.name) for f in kept], html, _host(url).alias(host))
    if winners.count() <= BROADCAST_HOSTS:
        joined = keyed.join(F.broadcast(winners), host, "left")
    else:
        salted = winners.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(html, url), F.lit(SALTS)).cast("int")).join(salted, [host, salt], "left")
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            htmls, paths = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
            texts = [_extract(h or "", p) for h, p in zip(htmls, paths, strict=True)]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.select(*[f.name for f in kept], html, path).mapInArrow(run, schema)
