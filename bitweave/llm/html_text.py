"""Main text of web pages: page structure, and a suffix array over each host's pages.

A page is cut into blocks. Its structure settles most of them: what stands in
menus, headers, footers, sidebars, notices, adverts, forms and comments goes,
and what stands in an article (outside such parts) stays. Without an article
the other blocks are open. They are settled by repetition: the token streams of
a host's pages (all their text outside articles) are concatenated, a suffix
array finds the long substrings that distinct pages share, and of the open
blocks the covered tokens go and the unique runs stay. Articles are left out of
the streams, because a passage that several articles quote is not boilerplate.

A host's pages are dealt to groups of a bounded number of tokens by hash, so no
task holds a large host. A suffix array shows what the pages of a group share.
What pages of different groups share is found by windows: a token is covered
just if a window of LEAST tokens that holds it stands on two pages, so the
windows of all groups of a host meet, and each group learns which of its own
stand on another page anywhere.

Pages of a host with the same open text are copies and count as one page,
whatever their ids, addresses and dropped parts: what only copies share stays.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweave.llm import textcodes as tc
from bitweave.llm.common import bounded_batches, lean, stored, tasks_of

#: Tokens that a shared substring has at least, and tokens in a group of pages.
LEAST, GROUP = 8, 200_000

#: Elements whose content is no text.
SILENT = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "object", "math", "title"}
#: Elements of what is not the article, and classes, ids and roles of it; a class is compared as a whole.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
ASIDE_NAMES = {
    "ad", "ad-banner", "ad-container", "ad-slot", "ads", "advert", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comment-list", "comments", "comments-area", "complementary", "consent",
    "contentinfo", "cookie", "cookie-banner", "cookie-bar", "cookie-consent", "cookie-notice", "cookies", "dialog", "disqus_thread", "footer", "gdpr", "header", "main-menu", "main-nav", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "newsletter-signup", "notice", "page-footer", "page-header", "pagination", "popup", "promo", "related", "related-articles", "related-posts", "replies", "reply", "search", "search-form", "share", "share-buttons", "sharing", "side-bar", "sidebar",
    "sidebar-left", "sidebar-right", "site-footer", "site-header", "site-nav", "skip-link", "social", "social-links", "social-share", "sponsor", "sponsored", "subscribe", "toolbar", "top-bar", "topbar", "widget", "widget-area",
}
MAIN = {"article", "main"}
#: Elements that begin and end a block.
BLOCKS = ASIDE | MAIN | {"address", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "legend", "li", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are the page or its article, whatever their classes.
PAGE = MAIN | {"html", "head", "body"}
#: Block elements that hold others; the rest end by themselves, at the latest with the next block.
HOLDERS = ASIDE | MAIN | {"body", "blockquote", "details", "div", "dl", "fieldset", "figure", "html", "ol", "section", "table", "ul"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

DROP, OPEN, KEEP = 0, 1, 2


def _is_aside(name: str, attributes: str, inside: bool) -> bool:
    if name in PAGE:
        return False
    if name in ASIDE and not (inside and name == "header"):
        return True
    if not attributes:
        return False
    return any(not ASIDE_NAMES.isdisjoint((a or b or c).lower().split()) for a, b, c in _NAMED.findall(attributes))


class _Reader:
    """Takes a page's tags and texts in order and makes blocks of them."""

    def __init__(self) -> None:
        self.out: list[tuple[int, str]] = []
        self.piece: list[str] = []
        self.held: list[tuple[str, int]] = []  # open holders and the state inside
        self.state, self.has_main = OPEN, False
        self.muted: list[str] = []  # open elements inside a block that are no part of the article, the outermost first

    def text(self, raw: str) -> None:
        if not self.muted:
            self.piece.append(raw)

    def close(self) -> None:
        """End the block, and with it what was muted inside."""
        self.muted.clear()
        if self.piece:
            text = " ".join(entities.unescape("".join(self.piece)).split())
            if text:
                self.out.append((self.state, text))
            self.piece.clear()

    def begin(self, name: str, attributes: str) -> None:
        aside = self.state != DROP and _is_aside(name, attributes, self.state == KEEP)
        if name not in BLOCKS:
            if name == "br":
                self.text(" ")
            elif name not in VOID and not attributes.endswith("/") and (name in self.muted or aside and not self.muted):
                self.muted.append(name)
            return
        self.close()
        if name in HOLDERS:
            inner = self.state
            if aside:
                inner = DROP
            elif name in MAIN and self.state != DROP:
                inner, self.has_main = KEEP, True
            if not attributes.endswith("/"):
                self.held.append((name, inner))
                self.state = inner
        elif aside and name not in VOID:
            self.muted.append(name)

    def end(self, name: str) -> None:
        if name not in BLOCKS:
            if name in self.muted:
                del self.muted[len(self.muted) - 1 - self.muted[::-1].index(name) :]
            return
        self.close()
        k = next((i for i in range(len(self.held) - 1, -1, -1) if self.held[i][0] == name), None)
        if k is not None:
            del self.held[k:]
            self.state = self.held[-1][1] if self.held else OPEN


def blocks(page: str) -> list[tuple[int, str]]:
    """(state, text) of the page's blocks in order; white space is single, references are decoded."""
    reader, at, n = _Reader(), 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            reader.text(page[at:])
            break
        if m.start() > at:
            reader.text(page[at : m.start()])
        at, name = m.end(), m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            reader.end(name)
        elif name in SILENT:
            if not m.group(3).endswith("/") or name in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else n
        else:
            reader.begin(name, m.group(3))
    reader.close()
    if reader.has_main:  # what stands beside an article is not the article
        return [(DROP if s == OPEN else s, t) for s, t in reader.out]
    return reader.out


def host(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, longest common prefix of each with the one before), by prefix doubling.

    The ranks of every doubling are kept; common prefixes are put together
    from them, longest first.
    """
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    levels, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while width < n and len(levels) < 32 and rank.max() < n - 1:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - width] = rank[width:]
        order = np.lexsort((second, rank))
        new = np.concatenate([[0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]))])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        levels.append(rank)
        width *= 2
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (a + (1 << k) <= n) & (b + (1 << k) <= n)
        same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        a[same] += 1 << k
        b[same] += 1 << k
    common[1:] = b - order[1:]
    return order, common


def shared_tokens(pages: list[np.ndarray], least: int = LEAST, contents: list[int] | None = None) -> list[np.ndarray]:
    """For each page's tokens, which lie in a substring of `least` tokens or more that another page has.

    Pages with equal contents, if given, count as one page.
    """
    kinds = np.arange(len(pages)) if contents is None else np.unique(np.array(contents, dtype=np.int64), return_inverse=True)[1]
    lens = np.array([len(p) for p in pages], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(lens + 1)])
    _, ids = np.unique(np.concatenate(pages), return_inverse=True) if lens.sum() else (None, np.zeros(0, np.int64))
    n = int(begin[-1])
    stream, owner = np.zeros(n, dtype=np.int64), np.repeat(kinds, lens + 1)
    ends = begin[1:] - 1
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    stream[inside] = ids
    stream[ends] = len(ids) + 1 + np.arange(len(pages))  # a different end for each page, so no match crosses it
    order, common = suffix_array(stream)
    group = np.cumsum(common < least)
    low, high = np.full(group[-1] + 1, len(pages)), np.full(group[-1] + 1, -1)
    np.minimum.at(low, group, owner[order])
    np.maximum.at(high, group, owner[order])
    found = order[(low < high)[group]]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, np.minimum(found + least, n), -1)
    covered = np.cumsum(cover[:-1]) > 0
    return [covered[a : a + k] for a, k in zip(begin, lens, strict=False)]


def window_codes(tokens: np.ndarray, host_code: int, least: int) -> np.ndarray:
    """A code for each run of `least` tokens of a page, different for each host."""
    return tc.mix(tc.ngram_codes(tokens, least) ^ np.uint64(host_code % (1 << 64)))


def covered_by(known: np.ndarray, codes: np.ndarray, n: int, least: int) -> np.ndarray:
    """Which of a page's n tokens lie in a window whose code is known."""
    cover = np.zeros(n + 1, dtype=np.int64)
    found = np.flatnonzero(np.isin(codes, known))
    cover[found] += 1
    cover[found + least] -= 1
    return np.cumsum(cover[:-1]) > 0


def _content(open_codes: np.ndarray, codes: np.ndarray) -> int:
    """Equal for pages of equal open text; a page without any goes by all its tokens."""
    kind, held = (b"o", open_codes) if len(open_codes) else (b"d", codes)
    return int.from_bytes(hashlib.blake2b(held.tobytes(), digest_size=8, person=kind).digest(), "little", signed=True)


def _codes(text: str) -> np.ndarray:
    raw, at = tc.utf8(pa.array([text], pa.string()))
    return tc.words(raw, at, tc.NONSPACE)[4]


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, group: int = GROUP) -> DataFrame:
    """The main text of each page.

    Returns the id column, url, text (blocks joined by a line feed; empty if
    none) and n_chars. Null html is empty. Equal pages and pages with null or
    repeated ids are each returned; pages without a host form a host of their
    own. Extra columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    kind = pages.schema["id"].dataType.simpleString()

    def streams(batches):
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = blocks(page)
                codes = _codes(" ".join(t for s, t in found if s != KEEP))
                own = _codes(" ".join(t for s, t in found if s == OPEN))
                rows.append((host(url), codes.tobytes(), len(codes), len(own) > 0, _content(own, codes)))
            yield pa.RecordBatch.from_arrays([batch.column(3), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.int64()), strict=True))] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.int64())], names=["page", "host", "tokens", "n", "open", "content"])

    keyed = pages.withColumn("page", F.xxhash64("id", "url", "html"))
    rows = stored(keyed.select("id", "url", "html", "page").mapInArrow(lean(streams), "page long, host string, tokens binary, n long, open boolean, content long").withColumn("stream", F.xxhash64("host", "tokens", "content")), "streams")
    sizes = rows.groupBy("host").agg(F.ceil(F.sum("n") / group).alias("groups"), F.max("open").alias("any")).where("any")
    dealt = rows.dropDuplicates(["stream"]).join(sizes, "host").withColumn("g", F.pmod(F.xxhash64("stream"), F.greatest("groups", F.lit(1)))).withColumn("code", F.xxhash64("host"))

    def windows(batches):
        for batch in batches:
            hosts, groups, streams, contents = (batch.column(k) for k in range(4))
            found = [np.unique(window_codes(np.frombuffer(t, np.uint64), c, least)) for t, c in zip(streams.to_pylist(), batch.column(4).to_pylist(), strict=True)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(w) for w in found]), pa.int64())
            codes = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([hosts.take(at), groups.take(at), contents.take(at), pa.array(codes)], names=["host", "g", "content", "w"])

    # Windows are counted once for each group, so one that stands on all pages of a host has a row for each group of it.
    large = dealt.where("groups > 1").select("host", "g", "tokens", "content", "code")
    held = large.mapInArrow(lean(windows), "host string, g long, content long, w long").groupBy("w", "host", "g").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    same = Window.partitionBy("w")
    met = held.select("host", "g", "w", F.min("low").over(same).alias("low"), F.max("high").over(same).alias("high")).where("low < high")

    def settle(batches):
        run, known, name = [], [], None

        def flush():
            streams = [np.frombuffer(t, np.uint64) for _, t, _, _, _ in run]
            covered = shared_tokens(streams, least, [k for _, _, _, _, k in run]) if run else []
            if known:
                among = np.array(known, dtype=np.int64).view(np.uint64)
                covered = [c | covered_by(among, window_codes(t, code, least), len(t), least) if o else c for c, t, (_, _, o, code, _) in zip(covered, streams, run, strict=True)]
            hit = [(s, np.packbits(c).tobytes()) for (s, _, o, _, _), c in zip(run, covered, strict=True) if o and c.any()]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in hit], pa.int64()), pa.array([c for _, c in hit], pa.binary())], names=["stream", "covered"])

        for batch in batches:
            for h, g, s, t, o, c, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, g) != name:
                    yield from flush()
                    run, known, name = [], [], (h, g)
                if t is None:
                    known.append(s)
                else:
                    run.append((s, t, o, c, k))
        yield from flush()

    tasks = tasks_of(spark)
    members = dealt.select("host", "g", "stream", "tokens", "open", "code", "content")
    if not sizes.where("groups > 1").isEmpty():  # a window's code stands in a row without tokens
        members = members.unionByName(met.select("host", "g", F.col("w").alias("stream")), allowMissingColumns=True)
    covered = stored(members.repartition(tasks, "host", "g").sortWithinPartitions("host", "g", "stream").mapInArrow(lean(settle), "stream long, covered binary"), "covered")
    if covered.isEmpty():  # no page waits for an answer, so the pages need not be moved
        joined = keyed.withColumn("covered", F.lit(None).cast("binary"))
    else:
        answers = rows.select("page", "stream").dropDuplicates(["page"]).join(covered, "stream").select("page", "covered")
        joined = keyed.join(answers, "page", "left")

    def texts(batches):
        for batch in batches:
            out = []
            for page, mask in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found, text, at = blocks(page), [], 0
                bits = np.unpackbits(np.frombuffer(mask, np.uint8)) if mask else None
                for state, block in found:
                    if state == KEEP:
                        text.append(block)
                        continue
                    words = re.split(r"[\x20\x09-\x0D]+", block)
                    if state == OPEN:
                        left = words if bits is None else [w for k, w in enumerate(words) if not bits[at + k]]
                        if left:
                            text.append(" ".join(left))
                    at += len(words)
                out.append("\n".join(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    return joined.select("id", "url", "html", "covered").mapInArrow(lean(texts), f"`{id_col}` {kind}, url string, text string, n_chars long")
