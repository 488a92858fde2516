"""Main text of web pages, with boilerplate found by suffix arrays over a host's token streams.

A page is read as a stream of tags and text. Blocks (paragraphs, headings, list items and
so on) get their text with character references decoded, and what the markup says of them:
inside a content container (article, main), or inside a menu, header, footer, sidebar,
form, advert, notice or comments (by tag, role, class or id).

A page with a container keeps the container's blocks, but for those that the markup marks. Lines that
articles share are prose: of the lines of six words and more that stand in articles of three
unlike pages of a host, every one was found to be a sentence of some document, so cutting
them would lose article text (the README has the figures).

A page without a container is held against its host. The token streams of what lies outside
containers are laid end to end, their suffixes are sorted, and neighbours
that share ``RUN`` tokens or more form the repeated substrings; those on ``PAGES`` distinct
pages are boilerplate. (A longer repeated substring is covered by its runs of ``RUN`` tokens,
so these alone decide what is covered.) Blocks mostly covered go, unique runs stay; so do not those that the
markup marks. Pages with the same content count as one.

A host may be of any size, so its suffix array is dealt out. Blocks of pages (some megabytes of a
scan's pages, of any hosts) ask buckets twice, in packed arrays: first which anchors (the
5-token gram with the least hash in each run) occur often enough, in 32 bits; then, for the
runs whose anchor does, on how many distinct pages of the host each is. A block sorts the
suffixes of the latter, so only they and their pages' digests travel. Nothing depends on a
host's size or on how its pages are dealt.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _blocks as K
from tideline.llm import _bytes as B
from tideline.llm._shared import stage

#: Tokens of a repeated run and of its anchor, distinct pages it must be on, share of a block that it must cover.
RUN, GRAM, PAGES, COVERED = 6, 5, 3, 0.5
#: Bytes of html in a block (a longer page has a block of its own).
BLOCK = 4 << 20

# Tags by what they do.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "canvas", "object", "select", "title"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "label", "fieldset", "audio", "video"}
#: Containers, and what a closer one adds: an article counts before the main part around it.
CONTAINERS = {"article": 2, "main": 1}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BREAKING = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words that mark boilerplate as the last word of a class or id.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer",
    "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo",
    "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "toolbar", "topbar", "widget",
}
#: Words that say nothing at the end of a name: what is before them counts.
GENERIC = {
    "area", "bar", "block", "body", "box", "button", "buttons", "container", "content", "form", "icon", "icons", "inner", "item", "items", "link", "links", "list", "main", "module",
    "outer", "panel", "row", "section", "slot", "text", "title", "unit", "wrap", "wrapper", "articles", "posts", "stories",
}
#: First words that name a state; and parts whose header or footer is their own (a title, say).
STATES = {"has", "hide", "is", "no", "not", "show", "with", "without"}
OWNERS = {"article", "chapter", "content", "entry", "page", "post", "section", "story"}
OWNED = {"banner", "footer", "header"}

#: A tag as browsers read it: quotes count where they begin an attribute's value.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+)>")
#: The same up to the next >, for pages with a quote that never ends.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)", re.I)


def _boilerplate(name: str) -> bool:
    """Whether one class or id names boilerplate: "site-footer" and "comments-area" do,
    "post-header", "has-sidebar" and "search-results" don't."""
    words = [w.lower() for w in _NAME.findall(name)]
    if not words or words[0] in STATES:
        return False
    while words and words[-1] in GENERIC:
        words.pop()
    return bool(words) and words[-1] in NAMES and not (words[-1] in OWNED and OWNERS.intersection(words[:-1]))


def _marked(attributes: str) -> bool:
    """Whether attributes mark boilerplate or hidden content."""
    if not attributes or attributes.isspace():
        return False
    if "hidden" in attributes and "aria-hidden" not in attributes and _HIDDEN.search(_QUOTED.sub('""', attributes)):
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id") and any(map(_boilerplate, value.split())):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _markup(page: str) -> Iterator[tuple[str, re.Match | None, int]]:
    """(text before it, tag, end) of the page's tags, in one pass; send(end) goes on from there.

    Comments, declarations and processing instructions are skipped; one that never ends
    takes the rest of the page, as does a tag. A < that begins none of these is text.
    """
    at = first = 0
    tags, cdata = _TAG, True
    while (i := page.find("<", at)) >= 0:
        c = page[i + 1 : i + 2]
        if c.isascii() and c.isalpha() or c == "/" and page[i + 2 : i + 3].isascii() and page[i + 2 : i + 3].isalpha():
            m = tags.match(page, i)
            if m is None and tags is _TAG:  # a quote that never ends, once for all of the page
                tags = _LOOSE
                m = tags.match(page, i)
            if m is None:
                yield page[first:i], None, len(page)
                return
            at = first = (yield page[first:i], m, m.end()) or m.end()
            continue
        if c not in ("!", "/", "?"):
            at = i + 1
            continue
        if page.startswith("<!--", i):
            end = i + 5 if page.startswith("<!-->", i) else page.find("-->", i + 4) + 3
            end = end if end > 2 else len(page)
        else:
            end = page.find("]]>", i) + 3 if cdata and page.startswith("<![CDATA[", i) else 0
            cdata = cdata and (end > 2 or not page.startswith("<![CDATA[", i))
            if end < 3:
                end = page.find(">", i) + 1 or len(page)
        yield page[first:i], None, end
        at = first = end
    yield page[first:], None, len(page)


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, level, marked as boilerplate) of the page's blocks with text, in order; level: 2
    inside an article, 1 inside the main part, else 0.

    The tags of head count for nothing (what it may hold is raw or without text), so it may
    end anywhere. A raw element goes with what it holds; of one that never ends, and of
    svg and math that close themselves, only the tag. Time grows in proportion to the page.
    """
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    level, dropped, others = 0, 0, 0  # open containers (an article adds 2^16), boilerplate elements, and those but headers
    stack: list[tuple[str, int, int]] = []
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    breaks: list[int] = []  # of the open elements that break lines
    endless: set[str] = set()  # raw tags without an end tag from here on

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, 2 if level >> 16 else int(level > 0), dropped > 0))
            parts.clear()

    def leave(i: int) -> None:
        nonlocal level, dropped, others
        while len(stack) > i:
            tag, c, d = stack.pop()
            places[tag].pop()
            if tag in BREAKING:
                breaks.pop()
            level, dropped, others = level - c, dropped - d, others - (d != 0 and tag != "header")

    scan, skip = _markup(page), None
    while True:
        try:
            text, m, _ = scan.send(skip)
        except StopIteration:
            break
        skip = None
        if text:
            parts.append(text)
        if m is None:
            continue
        tag = m[2].lower()
        if tag == "head":
            continue
        if tag in RAW:
            parts.append(" ")
            if not m[1] and tag not in endless and not (tag in ("svg", "math") and m[3].rstrip().endswith("/")):
                end = _RAW_END[tag].search(page, m.end())
                if end:
                    skip = end.end()
                else:
                    endless.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BREAKING:
            close()
        mine = places.setdefault(tag, [])
        if m[1]:
            if mine and (tag in BREAKING or not breaks or breaks[-1] < mine[-1]):
                leave(mine[-1])
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            if tag in ("p", "li") and mine and breaks[-1] == mine[-1]:  # these end the same element before them
                leave(mine[-1])
            marked = _marked(m[3])
            container = 0 if marked or tag not in CONTAINERS else 1 << 16 * (CONTAINERS[tag] - 1)
            drop = int(tag in DROPPED or tag not in ("body", "html") and marked)
            if tag in HEADINGS and level > 0 and dropped > 0 and not others:  # an article's own title may stand in its header
                drop = -dropped
            mine.append(len(stack))
            if tag in BREAKING:
                breaks.append(len(stack))
            stack.append((tag, container, drop))
            level, dropped, others = level + container, dropped + drop, others + (drop != 0 and tag != "header")
    close()
    return out


class Pages:
    """The pages of a block: their blocks of text, and their token streams end to end."""

    def __init__(self, arrays: list[np.ndarray]):
        self.buf, self.offsets, self.flags, self.size, self.ids, self.host, self.digest, self.url, self.url_at, self.url_null = arrays
        self.page = np.repeat(np.arange(len(self.ids)), self.size)
        words, owner = B.word_hashes(self.buf, self.offsets)
        outside = self.flags[owner] & 1 == 0
        self.owner, words = owner[outside], words[outside]
        self.lane = self.page[self.owner]
        # a token of one host is unlike the same word elsewhere
        self.token = B.mix(words ^ B.mix(self.host[self.lane], 3))
        n = len(self.token)
        self.starts = np.flatnonzero(self.lane[: max(0, n - RUN + 1)] == self.lane[RUN - 1 :])

    def _joined(self, at: np.ndarray, n: int) -> np.ndarray:
        acc = self.token[at]
        for j in range(1, n):
            acc = B.mix(acc) + self.token[at + j]
        return B.mix(acc, n)

    def anchors(self, buckets: int) -> None:
        """Places (bucket in the upper 32 bits, hash in the lower) of the distinct anchors, and the anchor of each run."""
        gram = self._joined(np.arange(max(0, len(self.token) - GRAM + 1)), GRAM)
        low = np.uint64((1 << max(20, len(gram).bit_length())) - 1)
        least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        at = self.starts
        for j in range(1, RUN - GRAM + 1):
            at = np.where(least[self.starts + j] < least[at], self.starts + j, at)
        h = B.mix(gram[at], 41)
        self.places, self.anchor = np.unique(((h % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32)), return_inverse=True)

    def runs(self, alive: np.ndarray, buckets: int) -> None:
        """The distinct runs among those with a living anchor: their suffixes are put in order,
        and neighbours whose longest common prefix has RUN tokens are the same run."""
        self.at = self.starts[alive[self.anchor]]
        columns = [self.token[self.at + j] for j in range(RUN)]
        order = np.lexsort(columns[::-1])
        alike, lcp = np.ones(max(0, len(order) - 1), bool), np.zeros(max(0, len(order) - 1), np.int64)
        for c in columns:
            alike &= c[order][1:] == c[order][:-1]
            lcp += alike
        head = np.append(True, lcp < RUN) if len(order) else np.zeros(0, bool)
        run = np.cumsum(head) - 1
        h = B.mix(self._joined(self.at[order[head]], RUN), 43)
        place = ((h % np.uint64(buckets)).astype(np.int64), h >> np.uint64(16))
        # the distinct runs by bucket and key
        sent = np.lexsort(place[::-1])
        self.bucket, self.key = place[0][sent], place[1][sent]
        back = np.empty(len(sent), np.int64)
        back[sent] = np.arange(len(sent))
        self.run = np.empty(len(order), np.int64)
        self.run[order] = back[run]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """For the runs in their order: how many digests of pages, PAGES at most, and these."""
        pair = np.unique((self.run.astype(np.uint64) << np.uint64(32)) | (self.digest[self.lane[self.at]] >> np.uint64(32)))
        run = (pair >> np.uint64(32)).astype(np.int64)
        first = np.searchsorted(run, np.arange(len(self.key)))
        stay = np.arange(len(pair)) - first[run] < PAGES
        return np.bincount(run[stay], minlength=len(self.key)).astype(np.uint8), (pair[stay] & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def covered(self, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block of text, how many of its tokens are in runs that are often on the host, and its tokens."""
        change = np.zeros(len(self.token) + 1, np.int64)
        at = self.at[often[self.run]]
        np.add.at(change, at, 1)
        np.add.at(change, at + RUN, -1)
        mine = np.bincount(self.owner, np.cumsum(change)[:-1] > 0, len(self.page))
        return mine, np.bincount(self.owner, minlength=len(self.page))


SENT = {"anchors": 0, "runs": 1}  # rounds, as upper bits of a part's bucket


def _digest(texts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode(), digest_size=8).digest(), "little")


def _packed(rows: pa.RecordBatch) -> tuple[bytes, int]:
    """The pages' blocks in packed arrays, in the order of Pages."""
    texts, flags, size, digest = [], [], [], []
    for page in rows.column("html").to_pylist():
        found = blocks(page)
        level = max((c for _, c, d in found if not d), default=0)
        own = [level > 0 and c >= level and not d for _, c, d in found]
        texts += [t for t, _, _ in found]
        flags += [o | 2 * d for o, (_, _, d) in zip(own, found, strict=True)]
        size.append(len(found))
        digest.append(_digest([t for (t, _, _), o in zip(found, own, strict=True) if o or not level]))
    buf, offsets = B.text_buffer(pa.array(texts, pa.large_string()))
    url = rows.column("url")
    url_buf, url_at = B.text_buffer(url.fill_null(""))
    host = pd.util.hash_array(np.array(rows.column("host").to_pylist(), dtype=object))
    ids = rows.column("page_id").fill_null(K.MISSING).to_numpy(zero_copy_only=False).astype(np.int64)
    arrays = [buf, offsets, np.array(flags, np.uint8), np.array(size, np.int64), ids, host.astype(np.uint64), np.array(digest, np.uint64), url_buf, url_at, np.asarray(url.is_null())]
    return K.pack(*arrays, level=6), len(buf)


def _parse(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in B.pieces(B.text_buffer(batch.column("html"))[1], size):
                blob, n = _packed(batch.slice(a, b - a))
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([blob], pa.binary()), pa.array([n], pa.int64())], names=["block", "payload", "n_bytes"])
                number += 1

    return run


def _ask_anchors(buckets: int):
    def each(block: int, arrays: list[np.ndarray]) -> pa.Table:
        p = Pages(arrays)
        p.anchors(buckets)
        times = np.minimum(np.bincount(p.anchor, minlength=len(p.places)), PAGES).astype(np.uint8)
        parts = K.by_bucket((p.places >> np.uint64(32)).astype(np.int64))
        return K.parts_table([r[0] for r in parts], block, [K.pack(p.places[a:b].astype(np.uint32), times[a:b]) for _, a, b in parts])

    return each


def _alive(bucket: int, blocks: list[int], parts: list[list[np.ndarray]]) -> list[bytes]:
    """Whether each anchor stands in the corpus often enough for its runs to be on PAGES pages."""
    where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)[1]
    alive = (np.bincount(where, np.concatenate([p[1] for p in parts])) >= PAGES)[where]
    return [K.pack(x) for x in np.split(alive, np.cumsum([len(p[0]) for p in parts])[:-1])]


def _told(answers: dict[int, list[np.ndarray]], kind: str) -> np.ndarray:
    mine = [answers[b][0] for b in sorted(answers) if b >> K.ROUND == SENT[kind]]
    return np.concatenate(mine) if mine else np.zeros(0, bool)


def _ask_runs(buckets: int):
    def each(block: int, arrays: list[np.ndarray], answers: dict[int, list[np.ndarray]]) -> pa.Table:
        p = Pages(arrays)
        p.anchors(buckets)
        p.runs(_told(answers, "anchors"), buckets)
        n, digests = p.digests()
        at = np.append(0, np.cumsum(n.astype(np.int64)))
        parts = K.by_bucket(p.bucket)
        blobs = [K.pack(np.diff(p.key[a:b], prepend=np.uint64(0)), n[a:b], digests[at[a] : at[b]]) for _, a, b in parts]
        return K.parts_table([SENT["runs"] << K.ROUND | r[0] for r in parts], block, blobs)

    return each


def _often(bucket: int, blocks: list[int], parts: list[list[np.ndarray]]) -> list[bytes]:
    """Whether each run is on PAGES distinct pages of its host."""
    key = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    where = np.unique(key, return_inverse=True)[1]
    owner = np.repeat(where, np.concatenate([p[1] for p in parts]))
    pages = np.unique((owner.astype(np.uint64) << np.uint64(32)) | np.concatenate([p[2] for p in parts]))
    often = (np.bincount((pages >> np.uint64(32)).astype(np.int64)) >= PAGES)[where]
    return [K.pack(x) for x in np.split(often, np.cumsum([len(p[0]) for p in parts])[:-1])]


TEXTS = "page_id long, url string, text string"


def _texts(buckets: int):
    def each(block: int, arrays: list[np.ndarray], answers: dict[int, list[np.ndarray]]) -> pa.Table:
        """Text of the pages: their blocks in a container if they have one, else those without the runs that are often on the host."""
        p = Pages(arrays)
        p.anchors(buckets)
        p.runs(_told(answers, "anchors"), buckets)
        mine, of = p.covered(_told(answers, "runs"))
        inside, marked = p.flags & 1 > 0, p.flags & 2 > 0
        n = len(p.ids)
        contained = np.bincount(p.page, inside, n) > 0
        keep = np.where(contained[p.page], inside, ~marked & (mine < COVERED * of))
        raw, url = p.buf.tobytes(), p.url.tobytes()
        ends = p.offsets.tolist()
        last = np.cumsum(p.size).tolist()
        texts = ["\n".join(raw[ends[i] : ends[i + 1]].decode() for i in range(a, b) if keep[i]) for a, b in zip([0, *last], last, strict=False)]
        urls = [None if gone else url[a:b].decode() for gone, a, b in zip(p.url_null.tolist(), p.url_at[:-1].tolist(), p.url_at[1:].tolist(), strict=True)]
        return pa.table({"page_id": pa.array(p.ids, pa.int64(), mask=p.ids == K.MISSING), "url": pa.array(urls, pa.string()), "text": pa.array(texts, pa.string())})

    return each


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block: int = BLOCK) -> DataFrame:
    """One row per input row: page_id, url, text (blocks in page order, one line each; empty if none).

    Null html is empty. A null url, or one without a host, counts as a host of its own
    kind. Repeated rows each get a row; pages of equal content count as one page. Ids are
    integers; a null one stays null. Other columns are ignored; an empty table gives an
    empty result. block: bytes of html that a task holds at once (results don't depend on it).
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    packed = K.keep(read.mapInArrow(_parse(block), K.BLOCK_SCHEMA))
    buckets = K.bucket_count(packed)
    anchors = stage(K.answer(K.emit(packed, _ask_anchors(buckets)), _alive), "anchors")
    runs = stage(K.answer(K.finish(packed, anchors, _ask_runs(buckets), K.PART_SCHEMA), _often), "runs")
    return K.finish(packed, anchors.unionByName(runs), _texts(buckets), TEXTS)
