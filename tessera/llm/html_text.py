"""Main-text extraction by consensus host paths.

Each page is parsed once into containers and text blocks, boilerplate
subtrees left out. Every page votes for the generalised tag-class path of
its best container; the path with the most votes of a host wins (a partially
aggregated count per host and path), and each page is extracted again from
the containers on the winning path, or from its own best container where it
has none on that path.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import column, slices, stage

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|noscript|template|textarea|select|svg|math|iframe|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|([^<]++|<)", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track".split())
_CONTAINER = frozenset("article main section div td body center".split())
_DROP = frozenset("nav footer aside form button header dialog menu fieldset head video audio canvas".split())
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                       "menubar toolbar status note".split())
_DROP_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs header masthead topbar footer colophon copyright sidebar aside rail widget "
    "widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended comment comments commentlist reply replies respond disqus "
    "discussion feedback pagination pager tags toolbar search skip form".split())
# words that headings also get as generated ids; an id of these says nothing
_TOPIC_WORD = frozenset(
    "advert adverts advertisement advertising alert comment consent cookie cookies copyright discussion feedback form "
    "login menu menus navigation newsletter notice notices promotion recommended related reply replies search share "
    "sharing social subscribe subscription tags widget widgets ads".split())
_KEPT = frozenset("html body article main h1 h2 h3 h4 h5 h6 hgroup p figcaption figure blockquote pre".split())
_GOOD_WORD = frozenset("content article post entry story body text main".split())
_WORD = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")


class Page:
    """Containers (parent, path, prior) and blocks (container, text, share of
    link text) of one page, in page order. Subtrees whose class or id names
    boilerplate are regions: they go unless they hold an article or main or,
    on a page without one, most of the prose."""

    def __init__(self, source: str):
        self.parent, self.path, self.prior = [-1], ["body"], [1.0]
        self.blocks: list[tuple[int, str, float]] = []
        self.region: list[list] = []    # [parent, holds an article or main]
        self.inside: list[int] = []     # region of each block, -1 for none
        self.main = False               # the page has an article or main
        self._read(source)
        self._leave_out()

    def _leave_out(self) -> None:
        """Take the blocks of boilerplate regions out."""
        if not self.region:
            return
        own = [0.0] * len(self.region)
        prose = [len(t) * (1 - link) if link < 0.5 else 0.0 for _, t, link in self.blocks]
        total = sum(prose)
        for r, n in zip(self.inside, prose, strict=True):
            if r >= 0:
                own[r] += n
        for r in range(len(own) - 1, -1, -1):  # a region comes after the one around it
            up, main = self.region[r]
            if up >= 0:
                own[up] += own[r]
                self.region[up][1] |= main
        gone: list[bool] = []
        for r, (up, main) in enumerate(self.region):
            gone.append(up >= 0 and gone[up] or not main and (self.main or own[r] <= 0.5 * total))
        self.blocks = [b for b, r in zip(self.blocks, self.inside, strict=True) if r < 0 or not gone[r]]

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]  # (tag, container, dropped, region)
        text: list[str] = []
        links = 0
        in_link = False
        parent, path, prior, blocks = self.parent, self.path, self.prior, self.blocks
        for m in _TOKEN.finditer(source):
            got = m.group(5)
            if got is not None:
                if not stack[-1][2]:
                    text.append(got)
                    if in_link:
                        links += len(got)
                continue
            tag = m.group(3)
            if tag is None:
                continue
            tag, closing, attrs = tag.lower(), m.group(2), m.group(4)
            if tag in _INLINE and not (attrs and not closing):
                if tag == "a":
                    in_link = not closing
                if not closing or all(t[0] != tag for t in stack):
                    continue
            elif tag == "br":
                text.append(" ")
                continue
            if tag in _INLINE and not closing:  # only a dropped one matters
                if tag == "a":
                    in_link = True
                if not _dropped(tag, attrs) and not _boilerplate(tag, attrs):
                    continue
            if tag not in _INLINE and text:
                joined = "".join(text)
                flat = " ".join((_html.unescape(joined) if "&" in joined else joined).split())
                if flat:
                    blocks.append((stack[-1][1], flat, links / max(len(joined), 1)))
                    self.inside.append(stack[-1][3])
                text, links = [], 0
            if tag in _VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if tag == "p" or tag == "li":
                if stack[-1][0] == tag:
                    stack.pop()
            at, drop = stack[-1][1], stack[-1][2] or tag in _DROP or bool(attrs) and _dropped(tag, attrs)
            region = stack[-1][3]
            if not drop and tag in ("article", "main"):
                self.main = True
                if region >= 0:
                    self.region[region][1] = True
            if not drop and attrs and _boilerplate(tag, attrs):
                if tag in _INLINE:
                    drop = True
                else:
                    self.region.append([region, False])
                    region = len(self.region) - 1
            if tag in _CONTAINER and not drop:
                if tag == "body":
                    at = 0
                else:
                    step, good = tag, 2.0 if tag in ("article", "main") else 1.0
                    if attrs:
                        for a in _ATTR.finditer(attrs):
                            if (a.group(1) or "").lower() in ("class", "id"):
                                value = a.group(2) or a.group(3) or a.group(4) or ""
                                if a.group(1).lower() == "class":
                                    step += "".join("." + c for c in sorted(_DIGITS.sub("#", value).lower().split()))
                                if good == 1.0 and _GOOD_WORD.intersection(_WORD.findall(value.lower())):
                                    good = 1.5
                    parent.append(at)
                    path.append(f"{path[at]}/{step}")
                    prior.append(good)
                    at = len(parent) - 1
            stack.append((tag, at, drop, region))
        flat = " ".join(_html.unescape("".join(text)).split())
        if flat:
            blocks.append((stack[-1][1], flat, links / max(len(flat), 1)))
            self.inside.append(stack[-1][3])

    def best(self) -> tuple[int, float]:
        """Container of most prose: its prose squared over all its text,
        times what its tag and class promise; the deeper one on a tie."""
        n = len(self.parent)
        prose, every = [0.0] * n, [1.0] * n
        for c, t, link in self.blocks:
            every[c] += len(t) + 10
            if len(t) >= 25 and link < 0.5:
                prose[c] += len(t) * (1 - link)
            elif link < 0.5:
                prose[c] += 0.5 * len(t)
        for c in range(n - 1, 0, -1):
            prose[self.parent[c]] += prose[c]
            every[self.parent[c]] += every[c]
        score = [p * p / e * g for p, e, g in zip(prose, every, self.prior, strict=True)]
        top = max(range(n), key=lambda c: (score[c], c))
        return top, score[top]

    def text(self, path: str | None) -> str:
        """Blocks below the containers on ``path``, in page order; of the best
        container if there is none."""
        inside = [path is not None and p == path for p in self.path]
        if not any(inside):
            inside[self.best()[0]] = True
        for c in range(1, len(inside)):
            inside[c] = inside[c] or inside[self.parent[c]]
        return "\n\n".join([t for c, t, _ in self.blocks if inside[c]])


def _boilerplate(tag: str, attrs: str) -> bool:
    """Whether a whole class or id names boilerplate; those of the page, of
    headings and of paragraphs do not count."""
    if tag in _KEPT:
        return False
    for m in _ATTR.finditer(attrs):
        name = (m.group(1) or "").lower()
        if name in ("class", "id"):
            words = _DROP_WORD.intersection((m.group(2) or m.group(3) or m.group(4) or "").lower().split())
            if words - _TOPIC_WORD if name == "id" else words:
                return True
    return False


def _dropped(tag: str, attrs: str) -> bool:
    for m in _ATTR.finditer(attrs):
        if m.group(5):
            return True
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if name == "role" and value in _DROP_ROLE or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def host(url_col: str):
    """Host of a URL in lower case; rows without one share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url_col, r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, n, score): pages that chose the path, and their summed
    container scores. Pages without text do not vote."""
    schema = "host string, path string, score double"
    src = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in slices(batches, "html", 1 << 22):
            hosts, paths, scores = [], [], []
            for h, source in zip(column(batch, "host").to_pylist(), column(batch, "html").to_pylist(), strict=True):
                if source:
                    page = Page(source)
                    c, s = page.best()
                    if s > 0:
                        hosts.append(h)
                        paths.append(page.path[c])
                        scores.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                                              pa.array(scores, pa.float64())], names=["host", "path", "score"])

    return src.mapInArrow(run, schema).groupBy("host", "path").agg(
        F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"))


def winners(voted: DataFrame) -> DataFrame:
    """(host, path): most votes, then the smaller path."""
    return voted.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "path"))["path"].alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, path) for every row: ``text`` is empty where the page
    is null, empty or has none. Repeated rows give equal rows; null urls
    share one host. Other columns are not read."""
    best = stage(winners(votes(pages, url_col, html_col)))
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()),
                           T.StructField("path", T.StringType())])
    src = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"), host(url_col).alias("_host"))
    src = src.join(best.withColumnsRenamed({"host": "_host", "path": "_path"}), "_host", "left").select(
        id_col, url_col, "_html", "_path")

    def run(batches):
        for batch in slices(batches, "_html", 1 << 22):
            paths = column(batch, "_path")
            texts = [Page(source).text(p) if source else "" for source, p in
                     zip(column(batch, "_html").to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, id_col), column(batch, url_col),
                                              pa.array(texts, pa.string()), paths],
                                             names=[id_col, url_col, "text", "path"])

    return src.mapInArrow(run, schema)
