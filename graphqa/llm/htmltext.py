"""Operator 9: main text of web pages by paths that a host's pages agree on."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches

# Element names by what they do to the text.
CONTAINERS = set("html body main article section div td blockquote figure details center".split())
DROPPED = set("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas video audio map dialog menu title".split())
RAW = set("script style textarea title noscript iframe xmp noembed".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = CONTAINERS | DROPPED | set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption pre address hr header hgroup summary figcaption fieldset legend".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words of a class, id or role that mark what is no part of an article.
CHROME = set("""ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner
nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer sidebar sidenav rail
comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert disclaimer
popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending
widget widgets skip hidden contentinfo search complementary""".split())
#: Start tags that end an open element of the second set.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Part of the page's best score that the host's path must reach on a page to be used there.
ENOUGH = 0.3


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _key(tag: str, at: dict[str, str]) -> str:
    """The tag with its classes, numbers taken out: pages of one template get the same."""
    classes = sorted({re.sub(r"\d+", "#", c) for c in at.get("class", "").split()})
    return ".".join([tag, *classes])


def _is_hidden(at: dict[str, str]) -> bool:
    return "hidden" in at or at.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", "")))


def _is_chrome(tag: str, at: dict[str, str]) -> bool:
    """Whether a block is no part of an article, by its class, id or role."""
    if not at:
        return False
    if _is_hidden(at):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    names = {w.lower() for k in ("class", "id", "role") if k in at for w in WORDS.findall(at[k])} if any(k in at for k in ("class", "id", "role")) else set()
    return bool(names & CHROME)


class Page:
    """blocks: (container, text, characters in links); containers: (parent, generalised path)."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[int, str, int]] = []
        self.containers: list[tuple[int, str]] = [(-1, "")]
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = []  # tag, container, dropped, header within an article
        here, dropped, header, link, heading = 0, False, False, 0, False
        text: list[str] = []
        linked = 0
        at, end = 0, len(html)

        def flush() -> None:
            nonlocal linked
            if text:
                s = " ".join(unescape("".join(text)).split())
                text.clear()
                if s:
                    self.blocks.append((here, s, min(linked, len(s))))
            linked = 0

        def restore() -> None:
            nonlocal here, dropped, header
            here, dropped, header = stack[-1][1:] if stack else (0, False, False)

        while at < end:
            m = TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at and not dropped and (not header or heading):
                text.append(html[at:stop])
                if link:
                    linked += len(html[at:stop].strip())
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                text.append(" ")
                continue
            if tag not in BLOCKS:
                if tag == "a":
                    link = 0 if m[1] else 1
                elif tag in RAW and not m[1]:
                    at = self._after_raw(html, tag, at)
                elif tag not in VOID and not m[1] and m[3] and not m[3].endswith("/") and _is_hidden(_attributes(m[3])):
                    stack.append((tag, here, True, header))
                    restore()
                elif m[1] and stack and stack[-1][0] == tag:
                    stack.pop()
                    restore()
                continue
            flush()
            link = 0
            if m[1]:
                if tag in HEADINGS:
                    heading = False
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        restore()
                        break
                    if stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                        break  # a stray end tag ends nothing outside
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
                restore()
            for closed in (IMPLIED_END.get(tag, ()),):
                while stack and stack[-1][0] in closed:
                    stack.pop()
                    restore()
            if tag in HEADINGS:
                heading = True
            elif tag == "body":
                stack.clear()
                restore()
            if tag in VOID:
                continue
            known = _attributes(m[3])
            gone, head = dropped or tag in DROPPED or _is_chrome(tag, known), header
            if tag == "header":
                inside = any(s[0] in ("article", "main") for s in stack)
                gone, head = dropped or not inside, inside
            where = here
            if tag in CONTAINERS and not gone:
                where = len(self.containers)
                self.containers.append((here, f"{self.containers[here][1]}/{_key(tag, known)}"))
            if tag in RAW:
                at = self._after_raw(html, tag, at)
            elif tag not in HEADINGS or gone:
                stack.append((tag, where, gone, head))
                restore()
        flush()

    @staticmethod
    def _after_raw(html: str, tag: str, at: int) -> int:
        m = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
        return m.start() if m else len(html)

    def scores(self) -> list[float]:
        """For each container: the text outside links of its blocks, and half of what its children have."""
        own = [0.0] * len(self.containers)
        for c, s, linked in self.blocks:
            if 2 * linked < len(s):
                own[c] += len(s) - linked
        for c in range(len(own) - 1, 0, -1):
            own[self.containers[c][0]] += own[c] / 2
        return [x * 3 if re.search(r"/(?:article|main)[^/]*$", self.containers[c][1]) else x for c, x in enumerate(own)]

    def best(self) -> int:
        scores = self.scores()
        return self.widened(max(range(len(scores)), key=lambda c: (scores[c], -c)))

    def widened(self, c: int) -> int:
        """The highest container below body around c, as long as what each adds is mostly text outside links and no more than is there.

        So sections of uneven length, a lead or a title beside the longest one are kept with it.
        """
        if re.search(r"/(?:article|main)[^/]*$", self.containers[c][1]):
            return c
        size, linked = [0] * len(self.containers), [0] * len(self.containers)
        for k, s, n in self.blocks:
            size[k] += len(s)
            linked[k] += n
        for k in range(len(size) - 1, 0, -1):
            size[self.containers[k][0]] += size[k]
            linked[self.containers[k][0]] += linked[k]
        at, found = self.containers[c][0], c
        while at > 0 and not re.search(r"/(?:body|html)[^/]*$", self.containers[at][1]):
            more, links = size[at] - size[found], linked[at] - linked[found]
            if more:
                if 2 * links >= more or more > size[found]:
                    break
                found = at
            at = self.containers[at][0]
        return found

    def inside(self, roots: set[int]) -> str:
        """The blocks within these containers, a line each."""
        within = [False] * len(self.containers)
        for c, (parent, _) in enumerate(self.containers):
            within[c] = c in roots or parent >= 0 and within[parent]
        return "\n".join(s for c, s, _ in self.blocks if within[c])

    def extract(self, path: str | None) -> tuple[str, bool]:
        """The text at a path, or in the page's own best container where the path fails; whether the path held."""
        scores, best = self.scores(), self.best()
        roots = {c for c, (_, p) in enumerate(self.containers) if path is not None and p == path}
        if roots and sum(scores[c] for c in roots) >= ENOUGH * scores[best]:
            return self.inside(roots), True
        return self.inside({best}), False


HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)|^//([^/:?#]+)")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return (m[1] or m[2]).lower() if m else ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            page = Page(html)
            if page.blocks:
                rows.append((host_of(url), page.containers[page.best()][1]))
        cols = list(zip(*rows, strict=True)) if rows else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["host", "path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [Page(html).extract(path) for html, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([x[0] for x in found], pa.string()), pa.array([len(x[0]) for x in found], pa.int64()), pa.array([x[1] for x in found], pa.bool_()), b.column("path")], names=["page_id", "url", "text", "n_chars", "by_consensus", "path"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, by_consensus, path), one row per row of pages (page_id, url, html).

    Each page votes for its best container's path (tags and classes from the root, numbers taken
    out); a host's most frequent path (ties: the path that sorts first) is where its pages are read
    again. A page without that path, or with little text there, uses its own best container, as do
    all pages without a readable host where votes are split. Null and empty html give empty text;
    a null url is a host of its own, the empty one; repeated rows are read alike; an empty table
    gives no rows; other columns are not read. Votes are counted per (host, path) before they meet,
    so a hot host costs a row per path.
    """
    small_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    votes = p.select("url", "html").mapInArrow(_votes, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n"))
    win = checkpoint(votes.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("w")).select("host", "w.path"))
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")), F.regexp_extract("url", r"^//([^/:?#]+)", 1), F.lit("")))
    j = p.withColumn("host", host).join(win, "host", "left").select("page_id", "url", "html", "path")
    return j.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, by_consensus boolean, path string")
