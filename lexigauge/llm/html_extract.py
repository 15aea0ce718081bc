"""Main text of web pages by consensus of their hosts.

Every page's containers are scored by the text they hold for themselves, less what is in links, and each page votes for its containers by
generalised path (tags with their first class, digits as N; paths travel as 64-bit hashes). Spark sums the votes per host and path. A host's
winning paths are the one with most votes and those of its siblings (same parent, same tag) that have at least a twentieth of its votes; pages are
extracted again below them. Where a page has no such container, it falls back on its own best one, and then on the whole body.

Left out wherever they stand: menus, footers, sidebars, notices, adverts, forms, comments of readers, scripts, styles and
markup, by tag, role, or the class or id of a container; a paragraph, heading or inline element is never left out by its class. A header is left out unless
it stands in an article. Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one space.

A page is read in one pass: each node knows its path's hash, its nearest container and whether it is left out, and open tags are found by
their own lists, so time and memory grow with the page's length, however deep it is nested.

Defined cases: null and empty html give an empty text; markup that never closes ends with its parent or the page; very long and deep pages are taken
whole; of containers with equal scores the outermost wins, then the largest hash; a page without a host counts for the empty host; a repeated row
gets the same result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, stage

#: Winning paths are broadcast up to so many hosts, and joined by shuffle beyond.
BROADCAST_HOSTS = 100_000
#: Share of the best path's votes that a sibling needs.
SIBLING_SHARE = 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CONTAINERS = frozenset("article body center div main section td".split())
_OUT_TAGS = frozenset("aside button canvas dialog footer form head header input menu nav noscript object select option".split())
_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|advertisement|adverts|banner|breadcrumbs?|byline-share|captcha|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|pager|pagination|popup|promo|promoted|recommend(?:ed|ations)?|related|replies|respond|share|sharing|sidebar|skip-link|skyscraper|social|sponsor(?:ed)?|subscribe|subscription|toolbar|topbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Elements whose class or id tells what they hold.
_NAMED = frozenset("aside center dd details dialog div dl figure footer form header iframe ins li menu nav ol section table tbody td tfoot thead tr ul".split())
_OUT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
#: What a start tag closes if it is open, and what stops the search for it.
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_PARAGRAPH_ENDS = _BLOCKS - {"br", "html", "head", "body", "title"}
_STOPS = frozenset("article aside body div footer form header html main nav ol section table ul".split())


class _Node:
    """An open element: path is the hash of its generalised path, box the nearest container around its text."""

    __slots__ = ("article", "box", "child", "depth", "inside", "link", "out", "own", "path", "tag", "up")

    def __init__(self, tag: str, path: int, up: _Node | None, out: bool, wanted: frozenset[int]):
        self.tag, self.path, self.up, self.out = tag, path, up, out
        self.depth = up.depth + 1 if up else 0
        self.link = tag == "a" or (up is not None and up.link)
        self.article = tag in ("article", "main") or (up is not None and up.article)
        self.inside = path in wanted or (up is not None and up.inside)
        self.box = self if tag in _CONTAINERS else up.box if up else None
        #: characters outside links less those inside, in this container itself and, a tenth less per level, in those below
        self.own = self.child = 0.0


def _start(tag: str, attributes: str, article: bool) -> tuple[str, bool]:
    """Label of a tag, and whether it is left out with all that it holds."""
    out, first = tag in _OUT_TAGS and not (article and tag == "header"), ""
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "class" and not first and value.split():
            first = "." + re.sub(r"\d+", "N", value.split()[0].lower())
        if name in ("class", "id") and tag in _NAMED and not (article and tag == "header") and _OUT_NAMES.search(value):
            out = True
        if (name == "role" and value.lower() in _OUT_ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            out = True
    return tag + first, out


class Page:
    """One pass over a page; ``scores`` holds the score, negated depth, parent path and tag of each container path once it is through."""

    def __init__(self, html: str, wanted: frozenset[int] = frozenset()):
        self.html, self.wanted = html, wanted
        self.nodes: list[_Node] = []
        self.places: dict[str, list[int]] = {}
        self.paths: dict[tuple[int, str], int] = {}
        self.scores: dict[int, tuple[float, int, int, str]] = {}

    def _open(self, tag: str, attributes: str) -> None:
        up = self.nodes[-1] if self.nodes else None
        label, out = _start(tag, attributes, up is not None and up.article)
        key = (up.path if up else 0, label)
        path = self.paths.get(key)
        if path is None:
            path = self.paths[key] = int.from_bytes(blake2b(f"{key[0]}>{label}".encode(), digest_size=8).digest(), "big", signed=True)
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(_Node(tag, path, up, out or (up is not None and up.out), self.wanted))

    def _pop(self, to: int) -> None:
        while len(self.nodes) > to:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.box is node and (node.own or node.child):
                raw = node.own + 0.9 * node.child
                above = node.up.box if node.up else None
                if above:
                    above.child += raw
                score = raw * (2.0 if node.tag in ("article", "main") else 1.0)
                known = self.scores.get(node.path)
                self.scores[node.path] = (score + (known[0] if known else 0.0), -node.depth, above.path if above else 0, node.tag)

    def _close(self, tags, stops=_STOPS) -> None:
        """Close the innermost open element of these tags, unless one of the stops is open inside it."""
        last = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=-1)
        at = last(tags)
        if at >= 0 and at >= last(stops):
            self._pop(at)

    def runs(self) -> Iterator[tuple[_Node | None, str | None]]:
        """The innermost open element with each run of raw text, or None as text at the edge of a block."""
        at, nodes = 0, self.nodes
        for m in _TOKEN.finditer(self.html):
            if m.start() > at:
                yield self._held(self.html[at : m.start()])
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    yield self._held(m[0][9:].removesuffix("]]>"))
                continue
            if tag in _BLOCKS:
                yield nodes[-1] if nodes else None, None
            if m[2]:
                self._close((tag,), () if tag in _STOPS else _STOPS)
                continue
            if tag in _PARAGRAPH_ENDS:
                self._close(("p",))
            if tag in _CLOSES:
                self._close(_CLOSES[tag].split(), _STOPS | ({"tr"} if tag in ("td", "th") else set()))
            if tag not in _VOID and not m[4].endswith("/"):
                self._open(tag, m[4])
        if at < len(self.html):
            yield self._held(self.html[at:])
        self._pop(0)

    def _held(self, text: str) -> tuple[_Node | None, str]:
        node = self.nodes[-1] if self.nodes else None
        if node and node.box and not node.out and (n := len(text.strip())):
            node.box.own += -n if node.link else n
        return node, text


def container_scores(html: str | None) -> dict[int, tuple[float, int, int, str]]:
    """Score, negated depth, parent path and tag of each generalised container path of a page."""
    page = Page(html or "")
    for _ in page.runs():
        pass
    return page.scores


def main_text(html: str | None, paths: list[int] | None) -> str:
    """Text of the containers at the paths; of the page's best container, or else its body, if there is none."""
    if not html:
        return ""
    page, inside, everything = Page(html, frozenset(paths or ())), [], []
    for node, text in page.runs():
        if text is None:
            inside.append(None)
            everything.append(None)
        elif not (node and node.out):
            everything.append(text)
            if node and node.inside:
                inside.append(text)
    if any(x and x.strip() for x in inside):
        return _text(inside)
    best = max(page.scores, key=lambda p: (*page.scores[p][:2], p)) if page.scores else None
    if best is not None and best not in page.wanted:
        return main_text(html, [best])
    return _text(everything)


def _text(runs: list[str | None]) -> str:
    blocks, held = [], []
    for x in [*runs, None]:
        if x is not None:
            held.append(x)
        elif held:
            blocks.append(" ".join(unescape("".join(held)).split()))
            held = []
    return " ".join(b for b in blocks if b)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple, float] = {}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            scores = {p: x for p, x in container_scores(html).items() if x[0] > 0}
            total = sum(x[0] for x in scores.values())
            for path, (score, *where) in scores.items():
                key = (host, path, *where)
                sums[key] = sums.get(key, 0) + round(1e6 * score / total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))), pa.array(list(sums.values()), pa.int64())], names=["host", "path", "height", "parent", "tag", "votes"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(h, p) for h, p in zip(part.column("html").to_pylist(), part.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """Rows (host, paths): hashes of the path with most votes among each host's pages, and of its siblings that have enough; at most so many as share allows."""
    votes = _hosted(pages).select("host", "html").mapInArrow(_votes, "host string, path bigint, height int, parent bigint, tag string, votes bigint")
    # equal paths have equal parents and tags
    summed = stage(votes.groupBy("host", "path", "height", "parent", "tag").agg(F.sum("votes").alias("votes")), "votes")
    best = summed.groupBy("host").agg(F.max(F.struct("votes", "height", "path", "parent", "tag")).alias("best"))
    near = (F.col("path") == F.col("best.path")) | ((F.col("parent") == F.col("best.parent")) & (F.col("tag") == F.col("best.tag")) & (F.col("votes") * SIBLING_SHARE >= F.col("best.votes")))
    return summed.join(best, "host").where(near).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def _hosted(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for ``pages (page_id, url, html)``."""
    paths = stage(winning_paths(pages), "paths")
    if bounded(paths, BROADCAST_HOSTS):
        paths = F.broadcast(paths)
    rows = _hosted(pages).join(paths, "host", "left").select("page_id", "url", "html", "paths")
    out = rows.mapInArrow(_extracted, "page_id bigint, url string, text string")
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
